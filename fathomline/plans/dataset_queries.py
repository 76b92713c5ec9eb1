"""Registered queries of data sets, records, readers and kernels, with SQL; they join those of the queries module."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import datasets as D
from ..operators import kernels as K
from ..operators import raster as R
from ..operators import series as S
from ..operators import settings as G
from ..sources import readers
from . import survey
from .queries import box_tables, hits, numbered_pixels, query, r6, relation, split_manifest
from .relations import pixels

# --- data sets ----------------------------------------------------------------------------------------------------------

#: Images and label files of an invented data set, from the stems.
IMAGES = """SELECT concat('set/', CASE id % 10 WHEN 0 THEN 'Segmentation/images/train/' WHEN 1 THEN 'Segmentation/images/val/' WHEN 2 THEN 'AnomalyScreen/normal_seabed/' WHEN 3 THEN 'Detection/images/val/' WHEN 4 THEN 'Detection/images/other/' ELSE 'Detection/images/test/' END, stem, '.jpg') AS path FROM [stems]"""
LABELS = """SELECT concat('set/', CASE id % 10 WHEN 0 THEN 'Segmentation/labels/train/' WHEN 1 THEN 'Segmentation/labels/val/' WHEN 3 THEN 'Detection/labels/val/' ELSE 'Detection/labels/train/' END, stem, '.txt') AS path,
    concat(CAST(id % 6 AS STRING), ' 0.5 0.5 0.1 0.1', chr(10), CAST(id % 3 AS STRING), ' 0.1 0.2 0.1 0.1', chr(10), chr(10)) AS text FROM [stems] WHERE id % 10 NOT IN (2, 4) AND id % 7 <> 0"""


def listing(spark, d, text: str):
    return spark.sql(text.replace("[stems]", "{stems}"), stems=relation(spark, d, "stems"))


SOURCE = "CASE WHEN starts_with({0}, 'pure_synth_subpipe') THEN 'pure_synth_subpipe' WHEN starts_with({0}, 'pure_synth_uatd') THEN 'pure_synth_uatd' WHEN starts_with({0}, 'ai4') THEN 'ai4' WHEN starts_with({0}, 'sctd') THEN 'sctd' WHEN starts_with({0}, 'pipe20xx') THEN 'pipe20xx' WHEN starts_with({0}, 'synth_net') THEN 'synth_net' WHEN starts_with({0}, 'normal') THEN 'normal_seabed' ELSE 'other' END"


@query(
    "manifest_build",
    f"""WITH img AS ({IMAGES}), lab AS ({LABELS}), names(part, i, name) AS (VALUES ('Detection', 0, 'shipwreck'), ('Detection', 1, 'aircraft'), ('Detection', 2, 'pipe'), ('Detection', 3, 'cylinder'), ('Detection', 4, 'ghost_net'), ('Segmentation', 0, 'shipwreck'), ('Segmentation', 1, 'ghost_net')),
    folders(part, a, b, s) AS (VALUES ('Detection', 'test', 'train', 'train'), ('Detection', 'val', 'val', 'val'), ('Segmentation', 'train', 'train', 'train'), ('Segmentation', 'val', 'val', 'val')),
    own AS (SELECT part, path AS image_path, regexp_extract(path, '([^/]+)[.]jpg$', 1) AS stem, concat('set/', part, '/labels/', b, '/') AS dir, s AS provider_split FROM img JOIN folders ON starts_with(path, concat('set/', part, '/images/', a, '/'))),
    cls AS (SELECT path, part, string_agg(name, '|' ORDER BY i) AS classes FROM (SELECT DISTINCT path, names.part, i, name FROM (SELECT path, split_part(path, '/', 2) AS part, unnest(string_split(text, chr(10))) AS line FROM lab) l JOIN names ON names.part = l.part AND line <> '' AND CAST(split_part(line, ' ', 1) AS INT) = i) GROUP BY ALL),
    rows AS (SELECT lower(part) AS component, image_path, concat(dir, stem, '.txt') AS label_path, {SOURCE.format('stem')} AS source_dataset, stem, provider_split, CASE part WHEN 'Detection' THEN 'box' ELSE 'mask' END AS label_type FROM own)
    SELECT component, image_path, label_path, source_dataset, CASE source_dataset WHEN 'ai4' THEN regexp_replace(stem, '_[0-9]+$', '') WHEN 'pipe20xx' THEN 'pipe20xx_2010' ELSE stem END AS source_group_id, provider_split, label_type,
           CASE WHEN source_dataset IN ('ai4', 'sctd') THEN 'real' WHEN source_dataset = 'pipe20xx' THEN 'unverified' WHEN source_dataset = 'other' THEN 'unknown' ELSE 'synthetic' END AS origin, coalesce(classes, '') AS classes FROM rows LEFT JOIN cls ON cls.path = label_path
    UNION ALL SELECT 'anomaly', path, '', 'normal_seabed', regexp_extract(path, '([^/]+)[.]jpg$', 1), 'unsplit', 'none', 'synthetic', '' FROM img WHERE starts_with(path, 'set/AnomalyScreen/normal_seabed/')""",
)
def manifest_build(spark, d):
    return D.manifests(listing(spark, d, IMAGES), listing(spark, d, LABELS), "set")


#: The manifest with splits, in SQL (see group_split).
SPLIT = """WITH m AS (SELECT * FROM [manifest]), g AS (SELECT DISTINCT source_dataset, source_group_id FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY sha256(concat('1337:', source_group_id)), source_group_id) - 1 AS k, count(*) OVER (PARTITION BY source_dataset) AS n FROM g),
    ms AS (SELECT m.*, CASE WHEN k < round_even(0.7::DOUBLE * n, 0) THEN 'train' WHEN k < round_even(0.7::DOUBLE * n, 0) + round_even(0.15::DOUBLE * n, 0) THEN 'val' ELSE 'test' END AS split FROM m JOIN k USING (source_dataset, source_group_id))"""


@query("split_layout", SPLIT + " SELECT image_path, concat('tree/images/', split, '/', regexp_extract(image_path, '([^/]+)$', 1)) AS image_to, CASE WHEN classes <> '' THEN concat('tree/labels/', split, '/', regexp_extract(image_path, '([^/]+)[.]png$', 1), '.txt') END AS label_to FROM ms")
def split_layout(spark, d):
    rows = split_manifest(spark, d).withColumn("label_path", F.when(F.col("classes") != "", F.concat(F.lit("lbl/"), "image_path")))
    return D.split_layout(rows, "tree").select("image_path", "image_to", "label_to")


@query("manifest_head", SPLIT + " SELECT image_path, source_dataset FROM ms WHERE split = 'test' ORDER BY image_path LIMIT 25")
def manifest_head(spark, d):
    """A row limit in the order of the files is the feature."""
    return D.first_rows(split_manifest(spark, d), 25, "test").select("image_path", "source_dataset")


@query("source_subset", SPLIT + " SELECT image_path, 'test' AS split FROM ms WHERE source_dataset = 'de' AND split = 'val'")
def source_subset(spark, d):
    return D.source_subset(split_manifest(spark, d), "de", "val").select("image_path", "split")


@query("seeded_split")
def seeded_split(spark, d):
    """The split by a seeded shuffle, exact for a seed: distinct groups (small) go to the driver; tests hold it against the definition."""
    from ..operators import manifest as M

    rows = relation(spark, d, "manifest")
    groups: dict[str, list[str]] = {}
    for x in rows.select("source_dataset", "source_group_id").distinct().collect():
        groups.setdefault(x.source_dataset, []).append(x.source_group_id)
    named = [(source, group, split) for source, ids in groups.items() for group, split in M.seeded_split(ids, 1337).items()]
    splits = spark.createDataFrame(named, "source_dataset string, source_group_id string, split string")
    return rows.join(splits, ["source_dataset", "source_group_id"]).groupBy("source_dataset", "split").agg(F.count("*").alias("n"), F.count_distinct("source_group_id").alias("n_groups"))


@query(
    "training_tiles",
    """WITH p AS (SELECT * FROM [pixels]), e AS (SELECT frame, max(r) + 1 AS h, max(c) + 1 AS w FROM p GROUP BY frame),
    ro AS (SELECT DISTINCT frame, least(o, greatest(0, h - 32)) AS o FROM e, range(0, 100000, 16) k(o) WHERE o < greatest(1, h - 32 + 16)), co AS (SELECT DISTINCT frame, least(o, greatest(0, w - 32)) AS o FROM e, range(0, 100000, 16) k(o) WHERE o < greatest(1, w - 32 + 16)),
    t AS (SELECT p.frame, ro.o AS row_off, co.o AS col_off, sum((v >= 230)::INT) AS n_object, avg((v > 5)::INT) AS fill FROM p JOIN ro ON ro.frame = p.frame AND r >= ro.o AND r < ro.o + 32 JOIN co ON co.frame = p.frame AND c >= co.o AND c < co.o + 32 GROUP BY ALL)
    SELECT frame, row_off, col_off, CAST(n_object AS BIGINT) AS n_object FROM t WHERE (n_object > 0 OR CAST(concat('0x', substr(md5(concat_ws('|', '1337', CAST(frame AS STRING), CAST(row_off AS STRING), CAST(col_off AS STRING))), 1, 8)) AS BIGINT) / 4294967296.0 < 0.3) AND fill >= 0.5""",
)
def training_tiles(spark, d):
    rows = R.tiles(pixels(spark, d), 32, 0.5).withColumn("on", (F.col("v") >= 230).cast("int"))
    return D.training_tiles(rows.withColumns({"row_off": F.col("row_off").cast("long"), "col_off": F.col("col_off").cast("long")}), 0.3, least_fill=0.5)


@query(
    "class_rows",
    "SELECT ['shipwreck', 'aircraft', 'pipe', 'cylinder', 'ghost_net'][1 + k] AS class, CASE k WHEN 0 THEN 'real' WHEN 1 THEN 'real' WHEN 2 THEN 'unverified' ELSE '?' END AS origin, round(avg(p_size) / 50, 6) AS ap50, round(min(p_size) / 50, 6) AS ap, round(max(p_size) / 50, 6) AS p, round(count(*) / 1e6, 6) AS r FROM (SELECT p_partkey % 5 AS k, p_size FROM part) GROUP BY k",
)
def class_rows(spark, d):
    each = spark.read.parquet(f"{d}/part.parquet").groupBy((F.col("p_partkey") % 5).cast("int").alias("k")).agg((F.avg("p_size") / 50).alias("ap50"), (F.min("p_size") / 50).alias("ap"), (F.max("p_size") / 50).alias("p"), (F.count("*") / 1e6).alias("r"))
    result = each.agg(F.array_sort(F.collect_list(F.struct("k", "ap50", "ap", "p", "r"))).alias("x")).select(F.col("x.k").alias("class_index"), "x.ap50", "x.ap", "x.p", "x.r")
    rows = D.class_rows(result, origins={"shipwreck": "real", "aircraft": "real", "pipe": "unverified"})
    return rows.select("class", "origin", *[r6(c).alias(c) for c in ("ap50", "ap", "p", "r")])


@query(
    "source_metrics",
    "WITH " + hits("[boxes_ano]") + """, f AS (SELECT tile, g_id, min(f_id) AS f_id FROM hits GROUP BY ALL), t AS (SELECT k AS tile, ['north', 'south', 'west'][1 + k % 3] AS source FROM range(200) r(k)),
    each AS (SELECT source, (SELECT count(*) FROM [boxes_gt] g WHERE g.tile = t.tile) AS g, (SELECT count(*) FROM [boxes_ano] a WHERE a.tile = t.tile) AS n, (SELECT count(*) FROM f WHERE f.tile = t.tile) AS h, (SELECT count(DISTINCT f_id) FROM f WHERE f.tile = t.tile) AS m FROM t)
    SELECT source, count(*) AS n_tiles, CAST(sum(g) AS BIGINT) AS n_truth, round(coalesce(sum(h) / nullif(sum(g), 0), 0), 6) AS recall, round((sum(n) - sum(m)) / count(*), 6) AS false_per_tile FROM each GROUP BY ROLLUP (source)""",
)
def source_metrics(spark, d):
    truth, _, ano = box_tables(spark, d)
    tiles = spark.range(200).select(F.col("id").alias("tile"), F.element_at(F.array(*map(F.lit, ("north", "south", "west"))), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    return B.source_metrics(truth, ano, tiles).select("source", "n_tiles", F.col("n_truth").cast("long").alias("n_truth"), r6("recall").alias("recall"), r6("false_per_tile").alias("false_per_tile"))


@query("box_rescale", "SELECT tile, id, CAST(trunc(x1 * 640.0::DOUBLE / (500 + tile)) AS INT) AS x1, CAST(trunc(y1 * 640.0::DOUBLE / (700 - tile)) AS INT) AS y1, CAST(trunc(x2 * 640.0::DOUBLE / (500 + tile)) AS INT) AS x2, CAST(trunc(y2 * 640.0::DOUBLE / (700 - tile)) AS INT) AS y2 FROM [boxes_det]")
def box_rescale(spark, d):
    _, det, _ = box_tables(spark, d)
    return D.rescaled(det, 500 + F.col("tile"), 700 - F.col("tile")).select("tile", "id", "x1", "y1", "x2", "y2")


@query("tile_to_full", "SELECT tile, id, y1 + tile // 20 * 512 AS r, x1 + tile % 20 * 512 AS c FROM [boxes_ano]")
def tile_to_full(spark, d):
    _, _, ano = box_tables(spark, d)
    r, c = D.to_full(F.col("y1"), F.col("x1"), F.floor(F.col("tile") / 20) * 512, F.col("tile") % 20 * 512)
    return ano.select("tile", "id", r.alias("r"), c.alias("c"))


@query("detector_boxes", "SELECT CAST(frame AS STRING) AS tile, 0 AS ord, CAST(trunc(min(c) * 640.0 / 64) AS INT) AS x1, CAST(trunc(min(r) * 640.0::DOUBLE / any_value(h)) AS INT) AS y1, CAST(trunc((max(c) + 1) * 640.0 / 64) AS INT) AS x2, CAST(trunc((max(r) + 1) * 640.0::DOUBLE / any_value(h)) AS INT) AS y2, 'bright' AS cls, round(count(*) / any_value(h) / 64, 6) AS conf FROM (SELECT *, max(r) OVER (PARTITION BY frame) + 1 AS h FROM [pixels]) WHERE v >= 100 GROUP BY frame HAVING count(*) / any_value(h) / 64 >= 0.0001")
def detector_boxes(spark, d):
    """A detector that boxes all bright pixels stands for a model's."""

    def detect(x: np.ndarray) -> list[tuple]:
        y, z = np.nonzero(x >= 100)
        return [(int(z.min()), int(y.min()), int(z.max()) + 1, int(y.max()) + 1, "bright", len(y) / x.size)] if len(y) else []

    rows = pixels(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("r", "c", F.col("v").cast("int").alias("v")))).alias("x"), (F.max("r") + 1).cast("int").alias("height"), (F.max("c") + 1).cast("int").alias("width"))
    images = rows.select(F.col("frame").cast("string").alias("tile"), "height", "width", F.unhex(F.array_join(F.transform("x", lambda x: F.lpad(F.hex(x["v"]), 2, "0")), "")).alias("data"))
    return D.detector_boxes(images, detect, 0.0001).withColumn("conf", r6("conf"))


# --- records ------------------------------------------------------------------------------------------------------------


@query("provenance_stamp", """SELECT DISTINCT label AS frame, 'screen' AS model_name, 'v3' AS model_version, substr(sha256('{"a": [1, 2], "b": {"x": 0.5, "y": null}}'), 1, 12) AS config_hash, '{"seed": 7}' AS extra FROM embeddings""")
def provenance_stamp(spark, d):
    made = G.provenance("screen", "v3", {"b": {"y": None, "x": 0.5}, "a": [1, 2]}, seed=7)
    frames = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("frame")).distinct()
    return G.stamped(frames, made).select("frame", "provenance.*")


@query("frame_check", "SELECT label AS frame, CASE label % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'degraded' WHEN 2 THEN 'partial' ELSE 'full' END AS mode, count(*) AS n_pings, max(len(embedding) - (label % 4 = 3 AND vec_id % 5 = 0)::INT) AS width, CASE WHEN label % 4 = 2 THEN 'mode' WHEN min(len(embedding) - (label % 4 = 3 AND vec_id % 5 = 0)::INT) <> max(len(embedding) - (label % 4 = 3 AND vec_id % 5 = 0)::INT) THEN 'ragged' END AS fault FROM embeddings GROUP BY label")
def frame_check(spark, d):
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    mode = F.when(F.col("label") % 4 == 1, "degraded").when(F.col("label") % 4 == 2, "partial").otherwise("full")
    frames = table.select(F.col("label").alias("frame"), mode.alias("mode")).distinct()
    short = (F.col("label") % 4 == 3) & (F.col("vec_id") % 5 == 0)
    return G.checked_frames(frames, table.select(F.col("label").alias("frame"), F.when(short, F.slice("embedding", F.lit(1), F.size("embedding") - 1)).otherwise(F.col("embedding")).alias("samples")))


@query("altitude_error", "SELECT survey, count(*) AS n_pings, round(avg(abs(alt - est)), 6) AS mae, round(avg(abs(alt - est)) / avg(alt), 6) AS share_of_mean FROM (SELECT survey, alt, coalesce(lag(alt) OVER (PARTITION BY survey ORDER BY i), alt) AS est FROM [pings]) GROUP BY survey HAVING avg(alt) IS NOT NULL")
def altitude_error(spark, d):
    from pyspark.sql import Window

    rows = relation(spark, d, "pings").withColumn("est", F.coalesce(F.lag("alt").over(Window.partitionBy("survey").orderBy("i")), "alt"))
    out = S.altitude_error(rows, "alt", "est").filter("mean IS NOT NULL")
    return out.select("survey", "n_pings", r6("mae").alias("mae"), r6("share_of_mean").alias("share_of_mean"))


@query(
    "altitude_policy",
    """WITH p AS (SELECT label AS frame, vec_id AS ping, 10 + vec_id % 7 AS px, CASE WHEN label % 3 = 0 AND vec_id % 2 = 0 THEN vec_id % 11 / 2 END AS m FROM embeddings), k AS (SELECT frame, count(m) > 0 AS known FROM p GROUP BY frame)
    SELECT frame, ping, round(CASE WHEN known THEN m WHEN frame % 5 <> 1 THEN px * 0.05 END, 6) AS altitude_m, CASE WHEN known THEN 'file' WHEN frame % 5 = 1 THEN 'image_estimate' ELSE 'bottom_tracking' END AS altitude_source FROM p JOIN k USING (frame)""",
)
def altitude_policy(spark, d):
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    frames = table.select(F.col("label").alias("frame")).distinct().select("frame", F.when(F.col("frame") % 5 == 1, "degraded").otherwise("full").alias("mode"), F.when(F.col("frame") % 5 != 1, F.lit(0.05)).alias("slant_res"))
    pings = table.select(F.col("label").alias("frame"), F.col("vec_id").alias("ping"), (10 + F.col("vec_id") % 7).cast("double").alias("altitude_px"), F.when((F.col("label") % 3 == 0) & (F.col("vec_id") % 2 == 0), F.col("vec_id") % 11 / 2).alias("altitude_m"))
    return S.altitude_policy(frames, pings).select("frame", "ping", r6("altitude_m").alias("altitude_m"), "altitude_source")


@query("frame_inspect", "SELECT label AS frame, 'full' AS mode, count(*) AS n_pings, max(len(embedding)) AS width, bool_or(vec_id % 3 = 0) AS has_nav, round(min(CASE WHEN vec_id % 2 = 0 THEN vec_id % 11 / 2 END), 6) AS low, round(max(CASE WHEN vec_id % 2 = 0 THEN vec_id % 11 / 2 END), 6) AS high FROM embeddings GROUP BY label")
def frame_inspect(spark, d):
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    pings = table.select(F.col("label").alias("frame"), F.col("embedding").alias("samples"), F.when(F.col("vec_id") % 3 == 0, F.lit(1.0)).alias("lat"), F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") % 11 / 2).alias("altitude_m"))
    return readers.inspected(table.select(F.col("label").alias("frame"), F.lit("full").alias("mode")).distinct(), pings)


@query("step_snapshot", "WITH p AS (SELECT frame, r, c, greatest(v - 20, 0) AS v FROM [pixels]), e AS (SELECT frame, min(v) AS lo, max(v) AS hi FROM p GROUP BY frame) SELECT frame, r AS ping, c, CAST(floor((v - lo) * 255 / (hi - lo + 1e-6)) AS INT) AS v FROM p JOIN e USING (frame)")
def step_snapshot(spark, d):
    rows = pixels(spark, d).groupBy("frame", F.col("r").alias("ping")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"] - 20).alias("samples"))
    return survey.snapshot(rows).select("frame", "ping", F.posexplode("samples").alias("c", "v"))


@query("metrics_json", """SELECT p_brand AS name, concat('{"version":"v', CAST(count(*) AS STRING), '","metrics":{"low":', CAST(min(p_size) AS STRING), ',"high":', CAST(max(p_size) AS STRING), '}}') AS entry, max(p_size) AS high, CAST(DATE '2024-01-01' + CAST(min(p_size) AS INT) AS STRING) AS date FROM part GROUP BY p_brand""")
def metrics_json(spark, d):
    """Registry entries as JSON text, read back; dates in ISO form."""
    own = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n"), F.min("p_size").cast("int").alias("low"), F.max("p_size").cast("int").alias("high"))
    text = F.to_json(F.struct(F.concat(F.lit("v"), F.col("n").cast("string")).alias("version"), F.create_map(F.lit("low"), "low", F.lit("high"), "high").alias("metrics")))
    rows = own.select("name", text.alias("entry"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("low")), "yyyy-MM-dd").alias("date"))
    return rows.select("name", "entry", F.from_json("entry", "metrics map<string,long>")["metrics"]["high"].alias("high"), "date")


# --- readers and kernels ------------------------------------------------------------------------------------------------


@query("xtf_scan", "SELECT vec_id AS frame, 0 AS ping, len(embedding) AS n, CAST(list_sum([trunc(abs(CAST(x AS DOUBLE)) * 1000) FOR x IN embedding]) AS DOUBLE) AS total, CASE WHEN vec_id % 3 > 0 THEN vec_id % 3 / 2 END AS lat, CASE WHEN vec_id % 4 > 0 THEN CAST(vec_id % 4 AS DOUBLE) WHEN vec_id % 5 > 0 THEN CAST(vec_id % 5 AS DOUBLE) END AS altitude_m, round(30 / len(embedding), 6) AS slant_res FROM embeddings")
def xtf_scan(spark, d):
    """Files of one ping each, written by the public layout, then parsed."""

    def files(batches):
        for batch in batches:
            out = []
            for ping, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples = np.trunc(np.abs(np.array(x, float)) * 1000).astype("<u2").tobytes()
                head, packet = bytearray(readers.XTF_HEADER), bytearray(256)
                head[0] = 123
                struct.pack_into("<H", head, 256 + 6, 2)
                channel = bytearray(64)
                struct.pack_into("<f", channel, 4, 30.0)
                struct.pack_into("<I", channel, 42, len(x))
                struct.pack_into("<HBBH", packet, 0, readers.XTF_MAGIC, readers.XTF_SONAR, 0, 1)
                struct.pack_into("<I", packet, 10, len(packet) + len(channel) + len(samples))
                struct.pack_into("<dd", packet, 160, ping % 3 / 2, 0.0)
                struct.pack_into("<ff", packet, 196, ping % 4, ping % 5)
                out.append(bytes(head + packet + channel) + samples)
            yield pa.RecordBatch.from_pydict({"path": batch.column(0).cast(pa.string()), "content": pa.array(out, pa.binary())})

    made = relation(spark, d, "samples").select("ping", "x").mapInArrow(files, "path string, content binary")
    rows = readers.parsed(made, readers.xtf_pings)
    return rows.select(F.col("frame").cast("long").alias("frame"), "ping", F.size("port").alias("n"), F.aggregate("port", F.lit(0.0), lambda a, v: a + v).alias("total"), "lat", "altitude_m", r6("slant_res").alias("slant_res"))


@query("grey_scan", "SELECT CAST(label AS STRING) AS frame, r AS ping, c, CAST((red * 19595 + green * 38470 + blue * 7471 + 32768) // 65536 AS DOUBLE) AS v FROM (SELECT frame AS label, r, c, CAST(v AS INT) AS blue, CAST(v AS INT) * 3 % 256 AS green, CAST(v AS INT) * 7 % 256 AS red FROM [pixels])")
def grey_scan(spark, d):
    rows = pixels(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("r", "c", F.col("v").cast("int").alias("v")))).alias("x"), (F.max("r") + 1).cast("int").alias("height"), (F.max("c") + 1).cast("int").alias("width"))
    byte = lambda v: F.lpad(F.hex(v % 256), 2, "0")
    data = F.unhex(F.array_join(F.transform("x", lambda x: F.concat(byte(x["v"]), byte(x["v"] * 3), byte(x["v"] * 7))), ""))
    images = rows.select(F.struct(F.col("frame").cast("string").alias("origin"), "height", "width", F.lit(3).alias("nChannels"), data.alias("data")).alias("image"))
    return readers.grey_rows(images).select("frame", "ping", F.posexplode("samples").alias("c", "v"))


@query("unet_input", "SELECT frame, ch AS channel, r, c, round((v / 255 - [0.485, 0.456, 0.406][ch + 1]::DOUBLE) / [0.229, 0.224, 0.225][ch + 1]::DOUBLE, 4) AS v FROM [pixels], range(3) k(ch)")
def unet_input(spark, d):
    out = None
    for channel in range(3):
        rows = K.on_frames(numbered_pixels(spark, d), lambda x, channel=channel: K.unet_input(x)[channel].astype(float))
        rows = rows.select("frame", F.lit(channel).alias("channel"), "r", "c", (F.round("v", 4) + F.lit(0.0)).alias("v"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("unet_mask", "SELECT frame, r, c, (v > 60.5)::INT AS is_on FROM [pixels]")
def unet_mask(spark, d):
    return K.on_frames(numbered_pixels(spark, d), lambda x: K.unet_mask(x - 60.5)).select("frame", "r", "c", F.col("v").cast("int").alias("is_on"))


@query("region_outline")
def region_outline(spark, d):
    """Corners of the outline of the first bright region of each frame; tests hold outlines against known shapes."""

    def first(x: np.ndarray) -> np.ndarray:
        return np.array(K.outline(K.components8(x >= 60) == 1) or np.zeros((0, 2)), float).reshape(-1, 2)

    rows = K.on_frames(numbered_pixels(spark, d), first)
    return rows.groupBy("frame", F.col("r").alias("corner")).pivot("c", [0, 1]).agg(F.first("v")).toDF("frame", "corner", "x", "y")



"""Survey operators on synthetic frames with known answers."""

import struct

import numpy as np
import pytest

from fathomline.functions import arrays as A
from fathomline.operators import boxes as B
from fathomline.operators import kernels as K
from fathomline.operators import manifest as M
from fathomline.operators import raster as R
from fathomline.operators import series as S
from fathomline.plans import survey
from fathomline.plans.relations import relation
from fathomline.sources import readers
from fathomline.streaming import altitude
from pyspark.sql import functions as F


def frame(spark, image, name="f"):
    return spark.createDataFrame([(name, i, [float(v) for v in row]) for i, row in enumerate(image)], "frame string, ping int, samples array<double>")


def pixels(spark, image, frame=1):
    return spark.createDataFrame([(frame, r, c, float(v)) for (r, c), v in np.ndenumerate(image)], "frame long, r long, c long, v double")


def array(df, value="v"):
    rows = df.collect()
    out = np.zeros((max(x.r for x in rows) + 1, max(x.c for x in rows) + 1))
    for x in rows:
        out[x.r, x.c] = x[value]
    return out


def waterfall(altitudes, width=200, seed=0):
    rng = np.random.default_rng(seed)
    image = np.full((len(altitudes), width), 90.0)
    far = np.abs(np.arange(width) - width // 2)
    for r, a in enumerate(altitudes):
        image[r, far < a] = 8
        image[r, (far >= a) & (far < a + 3)] = 220
    return np.clip(image + rng.normal(0, 3, image.shape), 0, 255)


def test_bottom_tracking(spark):
    truth = np.linspace(28, 40, 60)
    image = waterfall(truth)
    image[30] = waterfall([90])[0]
    rows = survey.tracked(frame(spark, image), survey.CONFIG["bottom"]).orderBy("ping").collect()
    got = np.array([x.altitude_px for x in rows])
    assert np.abs(got - truth).mean() < 0.1 * truth.mean() and np.abs(np.diff(got)).max() <= 15


def test_series_edges(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 4.0), (1, 2, None), (1, 3, 10.0), (1, 4, None), (2, 0, None)], "survey long, i long, alt double")
    filled = {(x.survey, x.i): x.filled for x in S.gap_filled(rows).collect()}
    assert filled == {(1, 0): 4.0, (1, 1): 4.0, (1, 2): 7.0, (1, 3): 10.0, (1, 4): 10.0, (2, 0): 0.0}
    jumps = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([10, 100, 100, 0])], "survey long, i long, median double")
    assert [x.clamped for x in S.jump_clamped(jumps).orderBy("i").collect()] == [10, 25, 40, 25]


def test_slant_target(spark):
    w, c0, a = 400, 200, 30.0
    image = np.full((1, w), 20.0)
    image[0, round(c0 + np.hypot(80, a))] = 255
    ground, valid = A.slant_to_ground(F.col("samples"), F.lit(a), 0.0)
    row = frame(spark, image).select(ground.alias("g"), valid.alias("ok")).first()
    assert abs(int(np.argmax(row.g)) - (c0 + 80)) <= 1
    assert all(g == 0 for g, ok in zip(row.g, row.ok) if not ok) and not row.ok[0]


def test_nadir(spark):
    for a in (10, 30, 60):
        ok = frame(spark, np.full((1, 300), 100.0)).select(A.nadir_mask(F.transform("samples", lambda v: v > 0), F.lit(float(a))).alias("m")).first().m
        assert abs(ok.count(False) - 2 * (a + 2)) <= 2


def test_gain_and_destripe(spark):
    rng = np.random.default_rng(1)
    fall = (40 + 200 * np.exp(-(np.linspace(-1, 1, 64) ** 2) / 0.2)) * rng.normal(1, 0.05, (48, 64))
    before, after = (R.column_cv(df).first().cv for df in (pixels(spark, fall), R.gain_normalised(pixels(spark, fall))))
    assert after <= before / 2
    striped = rng.normal(100, 5, (48, 64)) + 30 * np.sin(2 * np.pi * 20 * np.arange(64) / 64)
    clean = array(R.destriped(pixels(spark, striped)))
    spectrum = lambda x: np.abs(np.fft.rfft(x.mean(0)))[20] ** 2
    assert spectrum(clean) < 0.05 * spectrum(striped) and abs(clean.mean() - striped.mean()) < 1


def test_despeckle(spark):
    rng = np.random.default_rng(2)
    noisy = rng.normal(100, 15, (32, 32))
    for method in ("lee", "frost"):
        assert array(R.despeckled(pixels(spark, noisy), method)).std() < noisy.std()
    line = np.full((32, 32), 50.0)
    line[:, 16] = 250
    smooth = array(R.despeckled(pixels(spark, line)))
    assert smooth[:, 16].mean() > 3 * smooth[:, 4].mean()
    with pytest.raises(ValueError):
        R.despeckled(pixels(spark, noisy), "median")


def test_tiles(spark):
    for length, want in ((100, [0]), (640, [0]), (1000, [0, 360]), (1664, [0, 512, 1024]), (2000, [0, 512, 1024, 1360])):
        assert spark.range(1).select(A.tile_offsets(F.lit(length), 640, 512).alias("o")).first().o == want
    cut = R.tiles(pixels(spark, np.arange(40 * 30).reshape(40, 30)), 16, 0.2)
    assert all((x.r + x.row_off) * 30 + x.c + x.col_off == x.v for x in cut.collect())
    half = pixels(spark, np.ones((32, 16))).withColumn("valid", F.col("r") >= 16)
    assert {x.tile for x in R.tiles(half, 16, 0.0, 0.5).select("tile").distinct().collect()} == {"r16_c0"}


def test_candidates():
    amap = np.full((200, 200), 0.05)
    amap[20:40, 30:50], amap[28:34, 38:44] = 0.6, 0.9
    amap[120:150, 100:140] = 0.6
    found = K.candidates(amap, 0.3)
    assert len(found) == 2 and abs(found[0]["x1"] - 30) <= 3 and found[0]["peak"] == 0.9 and found[0]["polygon"]
    assert len(K.candidates(amap, 0.3, least_area=600)) == 1
    mask = np.ones_like(amap, bool)
    mask[:100] = False
    assert len(K.candidates(amap, 0.3, mask)) == 1 and round(K.least_area(64, 0.25, 0.05, 0.1)) == 50
    assert K.components8(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 0, 0]])).max() == 2
    ring = np.zeros((30, 30))
    ring[10:20, 10:20] = 200
    assert 20 < K.edges(ring).sum() < 60 and not K.edges(np.full((9, 9), 7.0)).any()
    assert K.equalized(np.random.default_rng(0).integers(90, 110, (64, 64))).std() > 6
    assert np.allclose(K.resized(np.full((7, 9), 3.0), 5, 4), 3) and K.crops(np.zeros((10, 10)), 16, 8) == []


def test_fusion_rules(spark):
    det = spark.createDataFrame([(1, 1, 100, 100, 200, 200, 0.9, "pipe", None), (1, 2, 120, 120, 220, 220, 0.8, "net", "own"), (2, 3, 0, 0, 50, 50, 0.5, "pipe", None)], "tile long, id long, x1 int, y1 int, x2 int, y2 int, conf double, cls string, polygon string")
    ano = spark.createDataFrame([(1, 10, 140, 140, 240, 240, 0.1, 0.05, "a"), (1, 11, 105, 105, 205, 205, 0.2, 0.15, "b"), (1, 12, 105, 105, 205, 205, 0.3, 0.25, "c"), (2, 13, 400, 400, 460, 460, 0.4, 0.35, "d")], "tile long, id long, x1 int, y1 int, x2 int, y2 int, peak double, mean double, polygon string")
    out = {(x.tile, x.id): (x.origin, x.partner, x.cls, x.conf, x.peak, x.mean, x.polygon) for x in B.fused(det, ano).collect()}
    assert out == {
        (1, 1): ("both", 12, "pipe", 0.9, 0.3, 0.25, "c"), (1, 2): ("both", 11, "net", 0.8, 0.2, 0.15, "own"), (1, 10): ("anomaly_only", None, None, None, 0.1, 0.05, "a"),
        (2, 3): ("yolo", None, "pipe", 0.5, None, None, None), (2, 13): ("anomaly_only", None, None, None, 0.4, 0.35, "d"),
    }
    alone = B.fused(det.limit(0), ano).collect()
    assert len(alone) == 4 and {x.origin for x in alone} == {"anomaly_only"}
    assert {x.origin for x in B.fused(det, ano.limit(0)).collect()} == {"yolo"}


def test_manifest(spark):
    stems = ["ai4_DM_Wilson_03", "ai4_WP_Rend_11", "pipe20xx_0256_2010", "sctd_000006", "synth_net_0000", "normal_1", "x"]
    rows = spark.createDataFrame([(s,) for s in stems], "stem string").select("stem", M.source_of(F.col("stem")).alias("source"))
    got = [(x.source, x.g) for x in rows.select("source", M.group_of(F.col("source"), F.col("stem")).alias("g")).collect()]
    assert got == [("ai4", "ai4_DM_Wilson"), ("ai4", "ai4_WP_Rend"), ("pipe20xx", "pipe20xx_2010"), ("sctd", "sctd_000006"), ("synth_net", "synth_net_0000"), ("normal_seabed", "normal_1"), ("other", "x")]
    split = M.seeded_split([f"g{i % 112}" for i in range(500)], 1337)
    assert split == M.seeded_split([f"g{i}" for i in range(112)], 1337) and list(split.values()).count("train") == 78
    with pytest.raises(ValueError):
        M.seeded_split(["a"], 1, 0.5, 0.1, 0.1)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", None)], "image_path string, split string")
    M.write_manifest(rows, f"{tmp_path}/m")
    assert M.read_manifest(spark, f"{tmp_path}/m").columns == M.COLUMNS
    M.materialize_splits(rows.na.fill("test"), f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").filter("split = 'val'").count() == 1
    labels = spark.createDataFrame([("a", "good"), ("b", "poor")], "image_path string, label string")
    M.append_labels(labels.limit(1), f"{tmp_path}/l")
    M.append_labels(labels, f"{tmp_path}/l")
    assert spark.read.parquet(f"{tmp_path}/l").count() == 2
    first = M.registry_upsert(spark, None, {"name": "ae", "version": "1"})
    assert [(x.name, x.version) for x in M.registry_upsert(spark, first, {"name": "ae", "version": "2"}).collect()] == [("ae", "2")]


def xtf(pings):
    head = bytearray(1024)
    head[0] = 123
    for i in range(2):
        struct.pack_into("<H", head, 256 + 128 * i + 6, 2)
    out = bytes(head)
    for altitude_m, auxiliary, samples in pings:
        body = bytearray(256)
        channels = b""
        for x in samples:
            channel = bytearray(64)
            struct.pack_into("<f", channel, 4, 30.0)
            struct.pack_into("<I", channel, 42, len(x))
            channels += bytes(channel) + np.array(x, "<u2").tobytes()
        struct.pack_into("<HBBH", body, 0, 0xFACE, 0, 0, len(samples))
        struct.pack_into("<I", body, 10, 256 + len(channels))
        struct.pack_into("<dd", body, 160, 12.5, 0.0)
        struct.pack_into("<ff", body, 196, altitude_m, auxiliary)
        out += bytes(body) + channels
    return out


def test_readers(spark, tmp_path):
    (tmp_path / "a.XTF").write_bytes(xtf([(8.0, 0.0, [range(8), range(8)]), (0.0, 9.0, [range(6)])]))
    frames, pings = readers.read_any(spark, f"{tmp_path}/a.XTF")
    rows = pings.orderBy("ping").collect()
    assert [x.altitude_m for x in rows] == [8.0, 9.0] and [len(x.samples) for x in rows] == [16, 16]
    assert rows[0].lat == 12.5 and rows[0].lon is None and rows[0].heading is None and frames.first().slant_res == pytest.approx((3.75 + 5) / 2)
    assert rows[0].samples[7] == rows[0].samples[8] == 0 and rows[0].samples[0] == 255 and rows[1].samples[0] == 0
    body = bytearray(240) + struct.pack("<4h", 10, 20, 30, 40)
    struct.pack_into("<H", body, 114, 4)
    message = struct.pack("<HBBHBBBBHI", 0x1601, 0, 0, 80, 0, 0, 0, 0, 0, len(body)) + bytes(body)
    (tmp_path / "b.jsf").write_bytes(message + b"junk\x01" + message + message[:100])
    rows = readers.read_any(spark, f"{tmp_path}/b.jsf")[1].collect()
    assert len(rows) == 2 and all(len(x.samples) == 4 and x.lat is None and x.altitude_m is None for x in rows)
    for data, parse in ((b"\0" * 2000, readers.xtf_pings), (b"none", readers.jsf_pings)):
        with pytest.raises(ValueError):
            parse(data)
    with pytest.raises(ValueError):
        readers.read_any(spark, f"{tmp_path}/c.txt")


def test_image_reader(spark, tmp_path):
    import zlib as z

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", z.crc32(kind + data))

    raw = b"".join(b"\0" + bytes([120] * 16) for _ in range(32))
    (tmp_path / "g.PNG").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 16, 32, 8, 0, 0, 0, 0)) + chunk(b"IDAT", z.compress(raw)) + chunk(b"IEND", b""))
    frames, pings = readers.read_any(spark, f"{tmp_path}/g.PNG")
    rows = pings.collect()
    assert frames.first().mode == "degraded" and len(rows) == 32 and rows[0].samples == [120.0] * 16 and rows[0].lat is None


def test_pipeline_order_and_toggles(spark):
    rng = np.random.default_rng(3)
    rows = frame(spark, rng.integers(0, 256, (24, 40)))
    out = survey.run(rows, {"tiling": {"size": 16}})
    assert out.steps == list(survey.STEPS)
    assert {x.flag for x in out.qualities.collect()} <= {"ok", "low"} and out.qualities.count() > 0
    part = survey.run(rows, {"tiling": {"size": 16}}, {"gain": False, "contrast": False, "quality": False})
    assert part.steps == ["bottom", "slant", "nadir", "despeckle", "tiling"] and part.qualities is None
    assert all(0 <= v <= 255 for x in part.pings.collect() for v in x.samples)


def test_streams(spark, tmp_path):
    schema = "survey long, i long, ts timestamp, alt double"
    rows = spark.sql("SELECT CAST(1 AS BIGINT) AS survey, id AS i, timestamp_seconds(id * 20) AS ts, CASE WHEN id = 3 THEN NULL WHEN id = 2 THEN 100D ELSE 10D END AS alt FROM range(8)")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("clamped", altitude.clamped(stream), "append"), ("windowed", altitude.windowed(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [x.clamped for x in spark.table("clamped").orderBy("i").collect()] == [10, 10, 25, 25, 10, 10, 10, 10]
    assert sum(x.n_known for x in spark.table("windowed").collect()) == 7


def test_every_order_is_a_box(spark):
    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    for name, same in (("boxes_det", F.col("o_orderstatus") == "O"), ("boxes_ano", F.col("o_orderstatus") != "O")):
        assert {x.id for x in relation(spark, folder, name).collect()} == {x.o_orderkey for x in orders.filter(same).collect()}


def test_tracking_at_once_is_its_steps(spark):
    rng = np.random.default_rng(8)
    rows = []
    for survey in range(12):
        n = int(rng.integers(1, 120))
        values = np.cumsum(rng.normal(0, rng.choice([1.0, 9.0, 30.0]), n)) + 50
        rows += [(survey, i, None if rng.random() < 0.2 or survey == 3 else float(v)) for i, v in enumerate(values)]
    pings = spark.createDataFrame(rows, "survey long, i long, alt double")
    steps = S.jump_clamped(S.median_filtered(S.gap_filled(pings))).select("survey", "i", "filled", "median", "clamped")
    key = lambda df: sorted(tuple(round(x, 6) for x in row) for row in df.select("survey", "i", "filled", "median", "clamped").collect())
    assert key(S.tracked(pings)) == key(steps)

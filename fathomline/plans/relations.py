"""Sonar-shaped relations derived from the given tables: pings, samples, pixels, boxes, manifests and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "pings": """
        SELECT user_id AS survey, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
               CASE WHEN event_type = 'error' THEN NULL ELSE round(value, 6) END AS alt FROM events""",
    "samples": "SELECT vec_id AS ping, label AS frame, embedding AS x FROM embeddings",
    "boxes_det": """
        SELECT o_custkey % 200 AS tile, o_orderkey AS id, CAST(o_orderkey * 37 % 560 AS INT) AS x1, CAST(o_orderkey * 91 % 560 AS INT) AS y1,
               CAST(o_orderkey * 37 % 560 + 20 + o_orderkey * 13 % 61 AS INT) AS x2, CAST(o_orderkey * 91 % 560 + 20 + o_orderkey * 29 % 61 AS INT) AS y2,
               round(CAST(o_totalprice AS DOUBLE) / 600000 + 1e-9, 6) AS score, round(CAST(o_totalprice AS DOUBLE) / 600000 + 1e-9, 6) AS conf, o_orderpriority AS cls,
               CASE WHEN o_orderkey % 3 = 0 THEN concat('outline ', CAST(o_orderkey AS STRING)) END AS polygon FROM orders WHERE o_orderstatus = 'O'""",
    "boxes_ano": """
        SELECT o_custkey % 200 AS tile, o_orderkey AS id, CAST(o_orderkey * 41 % 560 AS INT) AS x1, CAST(o_orderkey * 87 % 560 AS INT) AS y1,
               CAST(o_orderkey * 41 % 560 + 20 + o_orderkey * 17 % 61 AS INT) AS x2, CAST(o_orderkey * 87 % 560 + 20 + o_orderkey * 23 % 61 AS INT) AS y2,
               round(CAST(o_totalprice AS DOUBLE) / 600000 + 1e-9, 6) AS score, round(CAST(o_totalprice AS DOUBLE) / 600000 + 1e-9, 6) AS peak, round(CAST(o_totalprice AS DOUBLE) / 1200000 + 1e-9, 6) AS mean,
               concat('blob ', CAST(o_orderkey AS STRING)) AS polygon FROM orders WHERE o_orderstatus <> 'O'""",
    "boxes_gt": """
        SELECT p_partkey % 200 AS tile, p_partkey AS id, CAST(p_partkey * 53 % 560 AS INT) AS x1, CAST(p_partkey * 71 % 560 AS INT) AS y1,
               CAST(p_partkey * 53 % 560 + 20 + p_partkey * 19 % 61 AS INT) AS x2, CAST(p_partkey * 71 % 560 + 20 + p_partkey * 31 % 61 AS INT) AS y2 FROM part""",
    "manifest": """
        SELECT concat('img/', CAST(d.doc_id AS STRING), '.png') AS image_path, lang AS source_dataset, concat(lang, '_', source, '_', CAST(d.doc_id % 40 AS STRING)) AS source_group_id,
               CASE WHEN l.doc_id IS NULL THEN 'unverified' WHEN quality = 1 THEN 'real' ELSE 'synthetic' END AS origin,
               CASE WHEN l.doc_id IS NULL THEN '' WHEN quality = 1 AND toxic = 1 THEN 'shipwreck|aircraft' WHEN quality = 1 THEN 'shipwreck' ELSE 'pipe' END AS classes
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "scores": "SELECT d.doc_id, lang, round(least(CAST(1 AS DOUBLE), CAST(n_chars AS DOUBLE) / 5000), 6) AS s, quality AS good FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "label_lines": """
        SELECT p_partkey AS image, concat(CAST(p_partkey % 7 AS STRING), ' ', CAST(round(CAST(p_partkey * 53 % 560 + 30 AS DOUBLE) / 640, 4) AS STRING), ' ',
               CAST(round(CAST(p_partkey * 71 % 560 + 30 AS DOUBLE) / 640, 4) AS STRING), CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ' 0.0625  0.0725' END, CASE WHEN p_partkey % 5 = 0 THEN ' 0.9' ELSE '' END) AS line FROM part""",
    "stems": """
        SELECT p_partkey AS id, concat(CASE p_partkey % 9 WHEN 0 THEN 'pure_synth_subpipe_' WHEN 1 THEN 'pure_synth_uatd_' WHEN 2 THEN 'ai4_DM_Wilson_' WHEN 3 THEN 'ai4_WP_Rend_'
               WHEN 4 THEN 'sctd_' WHEN 5 THEN 'pipe20xx_' WHEN 6 THEN 'synth_net_' WHEN 7 THEN 'normal_' ELSE 'misc_' END, CAST(p_partkey AS STRING)) AS stem FROM part""",
}
#: DuckDB's way to number the samples; the pixel relation is built on it.
PIXELS = """
    SELECT label AS frame, r, CAST(c AS INT) AS c, v FROM (
        SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, unnest(range(0, len(embedding))) AS c,
               unnest([trunc(least(255, abs(CAST(x AS DOUBLE)) * 500)) FOR x IN embedding]) AS v FROM embeddings)"""


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation over the tables of a folder."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "embeddings", "orders", "part", "documents", "labels") if t in SQL[name]}
    text = SQL[name]
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **tables)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, r, c, v: vectors as image rows of 64 columns, values 0 to 255."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return spark.sql(
        """SELECT frame, r, c, floor(least(255D, abs(CAST(x AS DOUBLE)) * 500D)) + 0D AS v FROM
           (SELECT label AS frame, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, embedding FROM {table}) LATERAL VIEW posexplode(embedding) AS c, x""",
        table=table,
    )

"""The corpus queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .decontamination import contained_items
from .exact_dedup import exact_dedup
from .extraction import extracted
from .packing import packed
from .pii import pseudonymized
from .secrets import labelled_findings, secret_scan, trained
from .simhash import near_components
from .sstable import token_table
from .suffix_dedup import without_repeats
from .tokens import tokenizer_path
from .toxicity import toxicity


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(documents(spark, sf_dir), tokenizer_path(), end_id=1).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir, "doc_id", "text", "source"), trained(labelled_findings(spark)))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(documents(spark, sf_dir), key="fathomline")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), tokenizer_path(), end_id=2, length=4096).drop("tokens")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir), window=200).drop("kept")


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), shingle=3, reach=2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sstable": op1_sstable, "op2_secrets": op2_secrets, "op3_decontamination": op3_decontamination, "op4_pii": op4_pii, "op5_packing": op5_packing, "op6_suffix_dedup": op6_suffix_dedup, "op7_extraction": op7_extraction, "op8_exact_dedup": op8_exact_dedup, "op9_simhash": op9_simhash, "op10_toxicity": op10_toxicity}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": r"""
            WITH words AS (
                SELECT 'd' AS kind, doc_id AS id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM documents
                UNION ALL
                SELECT 'i', item_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] FROM benchmark),
            needed AS (SELECT DISTINCT least(5, len(w)) AS k FROM words WHERE kind = 'i' AND len(w) > 0),
            runs AS (
                SELECT kind, id, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s FROM words CROSS JOIN needed WHERE kind = 'd' AND len(w) >= k
                UNION ALL
                SELECT kind, id, unnest([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) FROM words WHERE kind = 'i' AND len(w) > 0),
            own AS (SELECT DISTINCT kind, id, s FROM runs),
            sizes AS (SELECT id AS item_id, count(*) AS n_item FROM own WHERE kind = 'i' GROUP BY id),
            hits AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM own d JOIN own i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
            SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM hits JOIN sizes USING (item_id)
            WHERE n_shared >= ceil(0.8::DOUBLE * n_item)""",
        "op8_exact_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY t)""",
    }

"""Exact deduplication with a heavy-hitter split.

Every text is reduced to the SHA-256 of its normalised form. Misra-Gries summaries, one a partition and merged by
addition, name the digests that may be frequent. Their number is at most ``counters`` + 1 whatever the input, so the
verified winners (exact count and first row) are broadcast and settle their rows without a shuffle. All other digests
have fewer than 2n/(counters + 1) rows and meet in an ordinary shuffle.

Null or missing text counts as empty; texts of any length are digested whole; of equal texts the one with the smallest
doc_id stays, rows with a null doc_id come last in their group, and of repeated rows (same doc_id and text) exactly one
stays; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, ready, stored, whole, without


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, uid (tells repeated rows apart) and the SHA-256 of the text after runs of white space became one space."""
    text = F.regexp_replace(whole(text_col), WHITE, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")).withColumn("uid", F.monotonically_increasing_id())


def misra_gries(counters: int):
    """A mapInArrow function: the Misra-Gries summary of a partition's digests, undercounting by n/(counters + 1) at most."""

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)):
                key = x["values"].as_py()
                held[key] = held.get(key, 0) + x["counts"].as_py()
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {k: v - cut for k, v in held.items() if v > cut}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["digest", "seen"])

    return summarise


def heavy_hitters(rows: DataFrame, counters: int) -> DataFrame:
    """At most counters + 1 digests, among them every one with 2n/(counters + 1) rows or more (n: all rows)."""
    total = rows.count()
    least = max(2, -(-total // (counters + 1)))
    summaries = rows.select("digest").mapInArrow(misra_gries(counters), "digest binary, seen long")
    return summaries.groupBy("digest").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= least).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row; see the module's description."""
    ready(docs.sparkSession)
    rows = stored(digests(docs, id_col, text_col), "digests")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid")
    frequent = F.broadcast(heavy_hitters(rows, counters))  # at most counters + 1 rows of 32 bytes
    winners = stored(rows.join(frequent, "digest").groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("size")), "winners")
    known = rows.join(F.broadcast(winners), "digest", "left")
    heavy = known.filter(F.col("size").isNotNull())
    light = known.filter(F.col("size").isNull()).select("digest", "doc_id", "uid")
    own = Window.partitionBy("digest")
    light = light.withColumns({"first": F.min(order).over(own), "size": F.count("*").over(own)})
    return heavy.select("digest", "doc_id", "uid", "first", "size").unionByName(light).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("uid") == F.col("first.uid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, for each distinct text: that with the smallest doc_id (of repeated rows, any)."""
    found = exact_dedup(docs, id_col, text_col).select("doc_id", "kept", F.unhex("text_sha256").alias("digest"))
    found = stored(found, "exact")
    own = {"doc_id": F.col(id_col).cast("long"), "digest": F.unhex(F.sha2(F.regexp_replace(whole(text_col), WHITE, " "), 256))}
    kept = found.filter("kept").select("doc_id", "digest")
    repeated = found.filter("NOT kept").join(kept, [found["doc_id"].eqNullSafe(kept["doc_id"]), found["digest"] == kept["digest"]], "left_semi")
    left = without(docs, found.filter("NOT kept").select("doc_id", "digest").exceptAll(repeated.select("doc_id", "digest")), own)
    if repeated.isEmpty():
        return left
    return left.withColumns({f"own {k}": x for k, x in own.items()}).dropDuplicates([f"own {k}" for k in own]).drop(*[f"own {k}" for k in own])

"""Removal of repeated strings: each byte covered by a ``window``-byte string that also starts anywhere else.

1. Every text is cut into contexts (see anchors): runs of window starts that share an anchor. Equal windows have equal
   anchors, so an anchor that occurs once in the corpus ends the matter for its windows.
2. If all contexts of an anchor are the same string, all their windows repeat; nothing has to be sorted.
3. The distinct contexts of the other anchors are the texts of shards, dealt by anchor, and each shard is sorted by
   external induced sorting: a window repeats if its suffix shares ``window`` bytes with a neighbour in that order, or if
   its context occurs more than once. The contexts of an anchor with more than HOT of them are cut once more by their
   second anchors and dealt by both, so no anchor fills a shard of its own.
4. The repeated starts of each text are united and their windows removed.

Anchors and contexts that hold over a 1,024th of all rows are at most 1,024; these are joined by broadcast and the others
by shuffling. Texts are told apart by 128 bits of their SHA-256, contexts of one anchor by 64-bit hashes.

Null text counts as empty; the result depends on the texts alone, so rows with a null doc_id and repeated rows (which
repeat each other's strings) are treated alike; texts shorter than the window stay whole; an empty table gives an empty
result; other columns are ignored. Very long texts are cut into contexts piece by piece. Windows have 64 to 32,000
bytes. Symbols 0 and 255 of a text are changed for sorting only where no UTF-8 text has them (255) or by a rule that
keeps windows apart (0, see escaped).
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import GRAM, contexts, sub_contexts
from .common import discard, lean, ready, split_join, stored, whole
from .induced import DEEPEST, sorted_suffixes

#: Bytes of a shard, about; contexts of an anchor beyond which they are dealt by their second anchors; queue entries in memory.
SHARD_BYTES, HOT, QUEUED = 4 << 20, 4096, 1 << 19
PIECE = 4 << 20


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and k and size (128 bits of the text's SHA-256) that tell texts apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    half = lambda at: F.conv(F.substring(F.sha2("text", 256), at, 16), 16, -10).cast("long")
    return rows.select("doc_id", half(1).alias("k"), half(17).alias("size"), "text")


def text_contexts(data: bytes, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """First starts, numbers of starts, anchor hashes and context hashes."""
    array = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(array) - window + 1), PIECE):
        first, last, _, anchors = contexts(array[at : at + PIECE + window - 1], window)
        first, last = first + at, last + at
        yield first, last - first + 1, anchors, [xxhash.xxh3_64_intdigest(data[i : j + window]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]


def context_table(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, k, size, a (anchor), c (context), s0 (first start), n (starts) for all contexts of all rows."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            rows = 0
            for i, text in enumerate(batch.column(3)):
                for first, n, anchors, found in text_contexts(text.as_buffer().to_pybytes(), window):
                    held.append((np.full(len(first), i), first, n, anchors, np.array(found, np.uint64)))
                    rows += len(first)
                if held and (rows > 100_000 or i == batch.num_rows - 1):
                    which, first, n, anchors, found = (np.concatenate(x) for x in zip(*held, strict=True))
                    own = pa.array(which)
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).take(own) for j in range(3)), pa.array(anchors.view(np.int64)), pa.array(found.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "k", "size", "a", "c", "s0", "n"])
                    held, rows = [], 0

    return docs.mapInArrow(lean(apply), "doc_id long, k long, size long, a long, c long, s0 int, n int")


def sliced(rows: DataFrame, window: int, shards: int) -> DataFrame:
    """From text and a list of its contexts (a, c, m, s0, n, hot): their bytes by shard; those of hot anchors cut once more."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for text, listed in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes()
                for x in listed.as_py():
                    own = data[x["s0"] : x["s0"] + x["n"] + window - 1]
                    if not x["hot"]:
                        out.append((x["a"] % shards, x["a"], x["c"], x["m"], 0, own))
                    else:
                        for i, j, second in zip(*(y.tolist() for y in sub_contexts(np.frombuffer(own, np.uint8), window)), strict=True):
                            out.append(((x["a"] ^ second * 0x9E3779B97F4A7C15 >> 7) % shards, x["a"], x["c"], x["m"], i, own[i : j + window]))
                    size += len(own) + 40
                    if size > 2 << 20:
                        yield made(out)
                        out, size = [], 0
            yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["shard", "a", "c", "m", "start", "data"])

    return rows.mapInArrow(lean(apply), "shard int, a long, c long, m long, start int, data binary")


def escaped(data: bytes) -> bytes:
    """The bytes without 0, which ends a string: 0 becomes 254 (like 255, in no UTF-8 text)."""
    return data.replace(b"\0", b"\xfe")


def repeated_starts(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose window occurs at another start of the strings: number of the string, first and last start."""
    sizes = np.array([len(x) + 1 for x in strings], np.int64)
    text = np.frombuffer(b"\0".join(map(escaped, strings)) + b"\0" * 9, np.uint8)
    flags = np.zeros(len(text) + 1, np.int8)
    for suffixes, shared in sorted_suffixes(text, QUEUED, window):
        again = np.flatnonzero(shared >= window)
        flags[suffixes[again]] = flags[suffixes[again - 1]] = 1
    edges = np.diff(flags, prepend=np.int8(0))
    low, high = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    begin = np.cumsum(sizes) - sizes
    which = np.searchsorted(begin, low, side="right") - 1
    return which, low - begin[which], high - begin[which]


def shard_ranges(window: int):
    """A function of a shard's contexts: a, c and the runs lo..hi of their repeated starts."""

    def apply(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        a, c, m, start = (group[x].to_numpy() for x in ("a", "c", "m", "start"))
        data = group["data"].to_pylist()
        seen: dict[tuple[int, int, int], int] = {}
        rows = [i for i, key in enumerate(zip(a.tolist(), c.tolist(), start.tolist(), strict=True)) if seen.setdefault(key, i) == i]
        which, low, high = repeated_starts([data[i] for i in rows], window)
        which = np.array(rows, np.int64)[which]
        single = m[which] == 1  # the others are known to repeat
        which, low, high = which[single], low[single], high[single]
        return pa.table({"a": a[which], "c": c[which], "lo": (start[which] + low).astype(np.int32), "hi": (start[which] + high).astype(np.int32)})

    return apply


def cut(docs: DataFrame, window: int) -> DataFrame:
    """From text and ranges (lo, hi of repeated starts): what is kept, as bytes, and how much was removed."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, listed in zip(batch.column(1), batch.column(2), strict=True):
                data, spans = text.as_buffer().to_pybytes(), []
                for x in sorted((x["lo"], x["hi"] + window) for x in (listed.as_py() or [])):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                at, kept = 0, []
                for low, high in spans:
                    kept.append(data[at:low])
                    at = high
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.mapInArrow(lean(apply), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def freed(spark) -> None:
    """Lets Spark delete shuffle files of finished steps now."""
    gc.collect()
    spark._jvm.System.gc()


def without_repeats(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    if not GRAM <= window <= DEEPEST:
        raise ValueError(f"windows have {GRAM} to {DEEPEST} bytes")
    spark = ready(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    table = stored(context_table(texts, window), "contexts")
    anchors = stored(table.groupBy("a").agg(F.count("*").alias("rows"), F.min("c").alias("one"), F.max("c").alias("other")).filter("rows > 1").select("a", "rows", (F.col("one") == F.col("other")).alias("sole")), "anchors")
    repeated = stored(split_join(table, anchors, ["a"], "rows").drop("rows"), "repeated")
    discard(table)
    freed(spark)
    mixed = repeated.filter("NOT sole")
    distinct = stored(mixed.groupBy("a", "c").agg(F.min(F.struct("doc_id", "k", "size", "s0", "n")).alias("x"), F.count("*").alias("m")).select("a", "c", "m", "x.*"), "distinct")
    total = distinct.agg(F.sum(F.col("n") + window)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    hot = distinct.groupBy("a").agg(F.count("*").alias("contexts")).filter(F.col("contexts") > HOT).select("a", F.lit(True).alias("hot"))
    placed = distinct.join(hot, "a", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    listed = placed.groupBy(F.col("doc_id").alias("own_id"), F.col("k").alias("own_k"), F.col("size").alias("own_size")).agg(F.collect_list(F.struct("a", "c", "m", "s0", "n", "hot")).alias("listed"))
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("k") == F.col("own_k")) & (F.col("size") == F.col("own_size"))
    pieces = stored(sliced(texts.join(listed, same).select("text", "listed"), window, shards), "pieces")
    freed(spark)
    ranges = pieces.groupBy("shard").applyInArrow(shard_ranges(window), "a long, c long, lo int, hi int")
    ranges = stored(ranges, "ranges")
    # contexts that occur once get what their shard found, the others repeat as wholes
    once = distinct.filter("m = 1").select("a", "c", "k", "size", "s0").join(ranges, ["a", "c"]).select("k", "size", (F.col("s0") + F.col("lo")).alias("lo"), (F.col("s0") + F.col("hi")).alias("hi"))
    again = split_join(mixed, distinct.filter("m > 1").select("a", "c", "m"), ["a", "c"], "m")
    found = once.unionByName(again.unionByName(repeated.filter("sole"), allowMissingColumns=True).select("k", "size", F.col("s0").alias("lo"), (F.col("s0") + F.col("n") - 1).alias("hi")))
    by_text = stored(found.distinct().groupBy("k", "size").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "by_text")
    discard(pieces)
    freed(spark)
    return cut(texts.join(by_text, ["k", "size"], "left").select("doc_id", "text", "ranges"), window)

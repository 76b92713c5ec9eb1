"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Words are the runs of letters and digits of the lower-cased text; an item's shingles are its distinct runs of five words
(the whole sequence if it has fewer, nothing if it has no word). A document contains an item if at least ``least`` of the
item's shingles are among its own runs of as many words; so items of one to four words are found inside documents too.

Search: items are partitioned by their number of shingles, in powers of two. An item's sketch is its bottom hashes (the
MinHash order): of n shingles a match lacks n - ceil(least n) at most, so of one more bottom hashes it has at least one,
and no match is missed at any document length. The partition gives the number that its items' sketches need and the
greatest hash in them; hashes of documents beyond all partitions' bounds are not probed, and documents with fewer
shingles than a partition's smallest item needs are not paired with it. Found pairs are verified by comparing the
shingles themselves, for whole texts.

Sketches and found pairs are broadcast only if a count shows that they are few; otherwise they are shuffled.

Null texts count as empty and contain nothing; texts of any length are searched whole; items without words are in no
document; a containment of exactly ``least`` counts, and a document may contain several items; rows of one doc_id (null
included) are one document with the shingles of all; the same for item_id. Empty tables give an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole, without

WORD_BREAK = r"[^\p{L}\p{N}]+"
#: Sketch hashes, items' shingles and found pairs up to these numbers are broadcast.
FEW_HASHES, FEW_SHINGLES, FEW_PAIRS = 500_000, 1_000_000, 500_000


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row: an expression inside a lambda would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(words: Column, size: int, make) -> Column:
    """make(run) for each run of words, with repeats; none without words."""

    def of(w: Column) -> Column:
        long = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: make(F.slice(w, i, F.lit(size))))
        return F.when(F.size(w) >= size, long).when(F.size(w) > 0, F.array(make(w)))

    return let(words, of)


def own_runs(words: Column, size: Column, make) -> Column:
    """make(run) for each run of ``size`` words; none of fewer words."""
    return let(words, lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: make(F.slice(w, i, size)))))


def spaced(run: Column) -> Column:
    return F.array_join(run, " ")


def item_shingles(items: DataFrame, shingle: int, item_col: str, text_col: str) -> DataFrame:
    """item_id and its distinct shingles, as text."""
    made = items.select(F.col(item_col).cast("long").alias("item_id"), runs(word_list(whole(text_col)), shingle, spaced).alias("shingles"))
    return made.filter("shingles IS NOT NULL").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles"))


def sketches(items: DataFrame, least: float) -> DataFrame:
    """A row for each hash in an item's sketch: hash, item_id, n, part (the power of two below n)."""
    sized = items.withColumn("n", F.size("shingles")).withColumn("part", F.floor(F.log2(F.col("n"))).cast("int"))
    hashed = sized.withColumn("hashes", F.array_sort(F.transform("shingles", lambda x: F.xxhash64(F.split(x, " ")))))
    kept = F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1
    return hashed.select("item_id", "n", "part", F.explode(F.slice("hashes", F.lit(1), kept.cast("int"))).alias("hash"))


def maybe_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def contained_items(docs: DataFrame, items: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of every pair with a containment of ``least`` or more."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    n = items.count()
    items = stored(item_shingles(items, shingle, item_col, item_text_col), "items", 20 * n)  # rows are lists, so fewer to a task
    sketch = stored(sketches(items, least), "sketches", 20 * n)
    lengths = items.select(F.explode(F.array_distinct(F.transform("shingles", lambda x: F.size(F.split(x, " "))))).alias("k")).distinct()
    sizes = sorted(x.k for x in lengths.collect()) or [shingle]  # at most ``shingle`` numbers
    parts = sketch.groupBy("part").agg(F.max("hash").alias("bound"), F.count("*").alias("rows")).collect()  # a row for each power of two
    bound = max((x.bound for x in parts), default=0)
    probes = None
    most = lambda hashes: F.size(hashes) if len(sizes) == 1 else (F.size(hashes) + shingle) * len(sizes)  # noqa: E731  runs of all lengths together
    for k in sizes:
        probed = let(own_runs(word_list(F.col("text")), F.lit(k), F.xxhash64), lambda hashes: F.transform(F.filter(hashes, lambda h: h <= bound), lambda h: F.struct(h.alias("hash"), most(hashes).alias("size"))))
        own = texts.select("doc_id", F.explode_outer(probed).alias("x")).select("doc_id", "x.hash", "x.size")  # outer: else Spark evaluates the array twice
        probes = own if probes is None else probes.unionByName(own)
    enough = F.ceil(F.lit(least) * F.pow(F.lit(2), F.col("part")))
    found = probes.join(maybe_broadcast(sketch, sum(x.rows for x in parts), FEW_HASHES), "hash").filter(F.col("size") >= enough)
    pairs = stored(found.groupBy("doc_id", "item_id").agg(F.count("*").alias("hits")).select(F.col("doc_id").alias("found_id"), "item_id"), "pairs")
    pair_rows, shingle_rows = pairs.count(), items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    chosen = texts.join(maybe_broadcast(pairs, pair_rows, FEW_PAIRS), F.col("doc_id").eqNullSafe(F.col("found_id")))
    sized = items.select("item_id", F.size("shingles").cast("long").alias("n_item"), F.explode("shingles").alias("shingle")).withColumn("k", F.size(F.split("shingle", " ")))
    sized = sized.groupBy("item_id", "n_item", "k").agg(F.collect_list("shingle").alias("shingles"))
    listed = chosen.join(maybe_broadcast(sized, shingle_rows, FEW_SHINGLES), "item_id")
    own = own_runs(word_list(F.col("text")), F.col("k"), spaced)
    shared = listed.select("doc_id", "item_id", "n_item", F.coalesce(F.array_intersect("shingles", own), F.array().cast("array<string>")).alias("shared"))
    whole_docs = shared.groupBy("doc_id", "item_id").agg(F.max("n_item").alias("n_item"), F.size(F.array_distinct(F.flatten(F.collect_list("shared")))).cast("long").alias("n_shared"))
    return whole_docs.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("n_shared") >= F.ceil(F.lit(least) * F.col("n_item"))).select("doc_id", "item_id", "n_shared", "n_item", "containment")


def decontaminated(docs: DataFrame, items: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, whose document contains no item."""
    found = contained_items(docs, items, least, id_col=id_col)
    return without(docs, found, {"doc_id": F.col(id_col).cast("long")})

"""Connected components of a table of links, by alternating star steps (every step is a group-by and a join)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, split_join, stored


def components(links: DataFrame) -> DataFrame:
    """node, root for every node that has a link (links: columns a, b); root is the least node that can be reached.

    A large-star step links each node's greater neighbours with its least one, a small-star step its smaller ones. Stars
    that no step changes are the components. Each step's links are written to the shared folder, so no lineage grows.
    """
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state = checksum(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = joined(both, least, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = joined(large, least, state[0]).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        then = stored(small.select("x.u", F.col("x.m").alias("v")).filter("u <> v").distinct(), "links", 2 * state[0])
        before, state = state, checksum(then)
        discard(now)
        now = then
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


#: Links up to this number may meet in one task, so hubs need no care.
FEW_LINKS = 1 << 20


def joined(links: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """links with the least neighbour of u (least: u, m, n links); the links of hubs stay where they are."""
    return links.join(least, "u") if rows <= FEW_LINKS else split_join(links, least, ["u"], "n", rows)


def checksum(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def stars(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For nodes 0 .. size - 1 and links (a, b): the least node of each node's component."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label

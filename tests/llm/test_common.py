"""Shared helpers: joined batches, anti joins, heavy keys, sweeping, the shared folder."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.llm import common


def test_joined_batches():
    batches = [pa.RecordBatch.from_pydict({"x": [i] * 10}) for i in range(25)]
    assert [x.num_rows for x in common.joined(iter(batches), 400)] == [50, 50, 50, 50, 50]
    assert list(common.joined(iter([]))) == []


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_without(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_BYTES", few)
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (2, None), (3, "c")], "`gone k` long, k string")
    dropped = spark.createDataFrame([(None, "b"), (2, None), (9, "z")], "i long, t string")
    left = common.without(docs, dropped, {"i": F.col("`gone k`"), "t": F.col("k")})
    assert left.columns == docs.columns and sorted(x[0] for x in left.collect()) == [1, 3]
    assert common.without(docs.limit(0), dropped, {"i": F.col("`gone k`")}).count() == 0
    assert common.without(docs, dropped.limit(0), {"i": F.col("`gone k`")}).count() == 5


def test_split_join(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 100, i) for i in range(3000)], "k long, v long")
    counted = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("extra", F.col("k") * 2)
    found = common.split_join(rows, counted, ["k"], "n")
    assert sorted((x.k, x.v, x.extra) for x in found.collect()) == sorted((x.k, x.v, x.k * 2) for x in rows.collect())
    assert common.split_join(rows.limit(0), counted.limit(0), ["k"], "n").count() == 0


def test_sweeping(spark):
    since = len(common.MADE)
    a, b = common.stored(spark.range(10), "a"), common.stored(spark.range(5), "b", rows=5)
    paths = common.MADE[since:]
    common.swept(spark, since, b)
    assert b.count() == 5 and common.MADE[since:] == paths[1:]
    assert not os.path.exists(paths[0].removeprefix("file:"))
    common.swept(spark, since)
    assert common.MADE[since:] == []


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_components(spark, monkeypatch, few):
    import random

    from fathomline.llm import components as module

    monkeypatch.setattr(module, "FEW_LINKS", few)
    rng = random.Random(1)
    links = [(0, i) for i in range(1, 400)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5000 + i, 5001 + i) for i in range(40)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    found = {x.node: x.root for x in module.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}

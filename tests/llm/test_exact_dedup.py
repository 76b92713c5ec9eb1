"""Exact deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

from fathomline.llm.exact_dedup import deduplicated, digests, exact_dedup, heavy_hitters


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return groups


def test_matches_brute_force(spark):
    texts = ["hot  text"] * 300 + ["hot\ttext"] * 50 + [None, "", " ", "\n"] + [f"text {i % 70}" for i in range(200)] + ["long " * 20000] * 2
    rows = list(enumerate(texts))[::-1] + [(7, "hot text"), (None, "only null id"), (None, "text 3")]
    for counters in (1, 8, 1024):
        found = exact_dedup(spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, digest binary").repartition(5), counters=counters).collect()
        groups = brute(rows)
        assert len(found) == len(rows)
        sums = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        kept = defaultdict(int)
        for x in found:
            ids = sums[x.text_sha256]
            assert x.group_size == len(ids) and x.keep_id == min((i for i in ids if i is not None), default=None)
            kept[x.text_sha256] += x.kept
            assert not x.kept or x.doc_id == x.keep_id
        assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_heavy_hitters_are_found_and_few(spark):
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else str(i)) for i in range(900)], "doc_id long, text string").repartition(6)
    found = [bytes(x.digest) for x in heavy_hitters(digests(docs), 8).collect()]
    assert hashlib.sha256(b"hot").digest() in found and len(found) <= 9


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_stage(spark):
    rows = [(5, "a b", 1), (3, "a  b", 2), (None, "a b", 3), (3, "a  b", 2), (7, None, 4), (8, "", 5), (None, "alone", 6), (9, "long " * 100_000, 7), (10, "long " * 100_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((str(x.doc_id), x.digest) for x in kept.collect()) == [("3", 2), ("7", 4), ("9", 7), ("None", 6)]
    assert deduplicated(docs.limit(0)).count() == 0

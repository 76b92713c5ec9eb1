"""Repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from fathomline.llm import suffix_dedup
from fathomline.llm.suffix_dedup import without_repeats


def brute(rows, window):
    times = Counter()
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        times.update(d[i : i + window] for i in range(len(d) - window + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for s in range(len(d) - window + 1):
            if times[d[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 3])
def test_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "PIECE", 3000)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60), text(45), "x" * 450, text(38)]
    rows = [(i, text(rng.randint(0, 60)) + rng.choice(passages)[rng.randint(0, 60) :] + text(rng.randint(0, 90))) for i in range(40)]
    long = text(900)
    edited = list(long)
    for i in range(100, len(edited), 450):
        edited[i] = "Q"
    rows += [(50, long), (51, long), (52, "".join(edited)), (53, None), (54, ""), (55, "short"), (56, passages[0][:199]), (57, "é" * 130), (58, "\0" * 250), (59, "nul\0" * 70), (60, "y" * 200)]
    rows += [(51, long), (None, text(80) + passages[1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")
    found = without_repeats(docs).collect()
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in found)
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found), key=str) == brute(rows, 200)


@pytest.mark.parametrize("window", [64, 300, 900])
def test_other_windows_and_queues_on_disk(spark, monkeypatch, window):
    monkeypatch.setattr(suffix_dedup, "QUEUED", 200)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    shared = text(1200)
    rows = [(i, text(rng.randint(0, 300)) + shared[rng.randint(0, 200) : rng.randint(900, 1200)] + text(rng.randint(0, 300))) for i in range(12)] + [(50, shared), (51, shared)]
    found = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found), key=str) == brute(rows, window)


def test_windows_have_bounds(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for window in (63, 32_001):
        with pytest.raises(ValueError):
            without_repeats(docs, window)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0

"""Containment search against brute force."""

import random
import re

import pytest

from fathomline.llm import decontamination
from fathomline.llm.decontamination import contained_items, decontaminated


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def every_run(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1)}


@pytest.mark.parametrize("few", [500_000, 0])
def test_matches_brute_force(spark, monkeypatch, few):
    for name in ("FEW_HASHES", "FEW_SHINGLES", "FEW_PAIRS"):
        monkeypatch.setattr(decontamination, name, few)
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    items = [(i, " ".join(words(rng.choice([2, 3, 4, 5, 6, 12, 40, 90])))) for i in range(30)] + [(30, None), (31, ""), (2, "again other words of item two here")]
    docs = []
    for i in range(120):
        own = words(rng.choice([0, 3, 40, 400]))
        if i % 2:
            part = (items[rng.randrange(30)][1] or "").split()
            for j in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = f"changed{j}"
            own += [x.upper() + rng.choice(["", ",", "!!"]) for x in part] + words(rng.randrange(20))
        docs.append((i, " ".join(own)))
    docs += [(500, None), (501, ""), (None, items[4][1]), (7, items[5][1]), (502, "x " * 30000 + items[9][1])]
    want, by_doc, by_item = set(), {}, {}
    for i, t in docs:
        by_doc.setdefault(i, set()).update(every_run(t))
    for i, t in items:
        by_item.setdefault(i, set()).update(shingles(t))
    for d, ds in by_doc.items():
        for i, s in by_item.items():
            if s and len(ds & s) >= 0.8 * len(s) - 1e-9:
                want.add((d, i, len(ds & s), len(s)))
    documents = spark.createDataFrame([(*r, "u") for r in docs], "doc_id long, text string, hash string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id, x.n_shared, x.n_item) for x in contained_items(documents, benchmark).collect()}
    assert found == want and len(want) > 20
    clean = decontaminated(documents, benchmark)
    assert clean.columns == documents.columns
    assert sorted(str(x.doc_id) for x in clean.collect()) == sorted(str(i) for i, _ in docs if i not in {d for d, *_ in want})


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contained_items(empty, items).count() == 0
    assert contained_items(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), items.limit(0)).count() == 0


def test_stage_keeps_and_drops_rows_as_they_are(spark):
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "rare word")], "item_id long, text string")
    rows = [(1, "x one two three four five six y", "a"), (1, "x one two three four five six y", "a"), (2, "clean text", "b"), (2, "clean text", "b"), (3, "a rare word here", "c"), (None, "clean too", "d"), (4, "long " * 100_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    kept = decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == ["2", "2", "4", "None"]
    assert decontaminated(docs.limit(0), items).count() == 0

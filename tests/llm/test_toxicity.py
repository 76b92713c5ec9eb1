"""Toxicity: held-out accuracy, no leak of held-out labels, odd rows."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from fathomline.llm.toxicity import BITS, Model, accepted, toxicity


def table(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 120))]
        bad = i % 5 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["zwick", "Grobian", "fuxxer"]))
        rows.append((i, " ".join(words), "en", 0.5))
        labels.append((i, int(bad), 1))
    rows += [(2000, None, None, 0.1), (2001, "", "en", 0.1), (None, "zwick " * 9000, "en", 0.2), (3, rows[3][1], "en", 0.3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_accuracy(spark):
    docs, labels = table(spark)
    found = toxicity(docs, labels).collect()
    assert len(found) == 904 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in found)
    held = [x for x in found if x.held_out and x.doc_id < 900]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in found if x.doc_id is not None)
    assert sum(x.predicted == (x.doc_id % 5 == 0) for x in held) / len(held) > 0.97
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {x.doc_id for x in found if not x.predicted}


def test_held_out_labels_are_not_read(spark):
    docs, labels = table(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda rows: sorted((str(x.doc_id), x.score) for x in rows)
    assert key(toxicity(docs, labels).collect()) == key(toxicity(docs, flipped).collect())


def test_without_labels(spark):
    docs, labels = table(spark)
    assert {x.score for x in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity(docs.limit(0), labels).count() == 0


def brute_places(text):
    """The places of a text's n-grams, one at a time."""
    data = b" " + b" ".join(text.lower().encode().split()) + b" " if text else b""
    out = set()
    for n in (4, 5, 6):
        for i in range(len(data) - n + 1):
            code = 0
            for b in data[i : i + n]:
                code = (code * 0x01000193 + b + 1) % (1 << 32)
            out.add((((code ^ code >> 15) * 0x85EBCA6B) % (1 << 32)) >> (32 - BITS))
    return out


def test_scores_by_brute_force():
    rng = random.Random(2)
    places = rng.sample(range(1 << BITS), 60_000)
    weights = np.array([rng.gauss(0, 0.4) for _ in places], np.float32)
    table = dict(zip(places, weights.tolist(), strict=True))
    texts = ["", "Äpfel  und\tBirnen", "ab", "x" * 3000] + ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    found = Model(np.array(places), weights, -0.3).scorer()(texts)
    for text, score in zip(texts, found, strict=True):
        want = 1 / (1 + math.exp(-(-0.3 + sum(table.get(p, 0.0) for p in brute_places(text)))))
        assert abs(score - want) < 1e-5


def test_one_text_of_a_repeated_doc_id(spark):
    docs, labels = table(spark)
    more = docs.unionByName(docs.filter("doc_id < 300").withColumn("text", F.lit("another text altogether")))
    key = lambda rows: sorted((str(x.doc_id), x.score) for x in rows)
    assert key(toxicity(more, labels).collect()) == key(toxicity(more.repartition(7), labels).collect())
    kept = accepted(more.limit(0), labels)
    assert kept.columns == more.columns and kept.count() == 0

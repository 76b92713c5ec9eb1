"""The pipeline against a brute-force version on a small fixture."""

import random
import re
import zlib

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm.tokens import tokenizer_path
from fathomline.llm.toxicity import toxicity


def shingles(text, size, pattern):
    words = re.findall(pattern, text.lower())
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def fixture(folder, spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(60, 200))]
        bad = i % 6 == 0
        for _ in range(4 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["zwickl", "grobian", "fuxxer"]))
        if i % 17 == 1:
            words[30:30] = items[i % 5][1].split()
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    for i in range(400, 440):  # exact copies but for white space, and near copies
        text = rows[i - 400 + 1][1]
        rows.append((i, text.replace(" ", "  ") if i % 2 else text + " tail", "en", "s", 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def brute(rows, items, rejected):
    rows = [(i, t or "") for i, t, *_ in rows if i not in rejected]
    seen, kept = set(), []
    for i, t in sorted(rows):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if key not in seen:
            seen.add(key)
            kept.append((i, t))
    sets = [shingles(t, 5, r"\S+") or {""} for _, t in kept]
    parent = list(range(len(kept)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(kept)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    kept = [x for k, x in enumerate(kept) if find(k) == k]
    wanted = [shingles(t, 5, r"[^\W_]+") for _, t in items]
    return [(i, t) for i, t in kept if not any(len(s & shingles(t, 5, r"[^\W_]+")) >= 0.8 * len(s) for s in wanted)]


def test_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    folder = f"file://{tmp_path}"
    rows, items = fixture(folder, spark)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rejected = {x.doc_id for x in toxicity(docs, labels).collect() if x.predicted}
    assert sum(i % 6 == 0 for i in rejected if i < 400) > 55
    want = brute(rows, items, rejected)
    found = corpus_pipeline.run(spark, folder).collect()
    assert {x.doc_id for x in found} == {i for i, _ in want}
    encode = Tokenizer.from_file(tokenizer_path()).encode
    by_doc = {}
    for x in sorted(found, key=lambda x: x.start):
        by_doc.setdefault(x.doc_id, []).append(x)
        assert x.ids_crc32 == zlib.crc32(x.tokens)
    for i, t in want:
        assert b"".join(x.tokens for x in by_doc[i]) == np.array([*encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_stages_keep_the_columns(spark, tmp_path):
    folder = f"file://{tmp_path}"
    fixture(folder, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]


def test_empty_and_repeated_rows(spark, tmp_path):
    folder = f"file://{tmp_path}/empty"
    rows, items = fixture(f"file://{tmp_path}/some", spark)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"file://{tmp_path}/some/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/some/documents.parquet")
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    twice = f"file://{tmp_path}/twice"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{twice}/{name}.parquet")
    few = docs.filter("doc_id < 40")
    few.unionByName(few).unionByName(few.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{twice}/documents.parquet")
    once = {x.doc_id for x in few.collect()}
    found = corpus_pipeline.run(spark, twice).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole")).collect()
    assert found and all(x.n == x.whole for x in found) and {x.doc_id for x in found} <= once

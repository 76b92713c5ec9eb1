"""Toxicity score by a linear classifier over character n-grams scaled with naive Bayes log-count ratios.

A feature is the presence in a text of a character n-gram (over lower-cased UTF-8 bytes, white space runs as one
space, a space added at both ends), hashed to 2^BITS places. On labelled rows the log ratio of a feature's share among
toxic and among other texts is its naive Bayes weight; features whose shares differ clearly are scaled by it and a logistic regression with an L2
penalty is fitted on them. Scoring adds the weights of the distinct features of a whole text.

The fit uses at most ``sample_rows`` labelled rows, chosen by a hash of doc_id, a quarter of them toxic at most; scoring
covers all rows. Of equally telling features those at lower places are kept; of several texts with one labelled doc_id
the one with the least digest is learned from. Null and empty texts get the score of a text without features; texts of any length
are scored whole. Repeated rows get equal
scores. Without labels of both classes every score is 0. Rows with a null doc_id are scored, never learned from and
not held out. Other columns are ignored, so they cannot be inputs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, ready, stored, whole

SIZES = (4, 5, 6)
BITS = 20
KEPT_FEATURES = 1 << 14
#: A feature is kept if its shares among toxic and other texts differ by so many standard errors.
LEAST_Z = 4.0
SMOOTHING, PENALTY, STEPS = 1.0, 1e-4, 400
#: The fit ends when 20 steps lower the loss by a smaller share than this.
LEAST_GAIN = 1e-3
SPACE = re.compile(rb"[\x20\x09-\x0D]+")
#: Bytes that n-grams are hashed at a time.
CHUNK = 1 << 20


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (number of the text, place of the feature), for every n-gram in every text, repeats included."""
    clean = [b" " + SPACE.sub(b" ", x.lower().encode("utf-8", "replace")).strip() + b" " if x else b"" for x in texts]
    group, size = [], 0
    for i, text in enumerate(clean):
        group.append((i, text))
        size += len(text)
        if size >= CHUNK or i == len(clean) - 1:
            yield from chunk_features(group)
            group, size = [], 0


def chunk_features(group: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data = np.frombuffer(b"".join(x for _, x in group), np.uint8)
    lengths = np.array([len(x) for _, x in group], np.int64)
    number = np.repeat(np.array([i for i, _ in group], np.int32), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes from here to the text's end
    if len(data) < min(SIZES):
        return
    wide = data.astype(np.uint32)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(SIZES) + 1):
        code[: len(data) - n + 1] = code[: len(data) - n + 1] * np.uint32(0x01000193) + wide[n - 1 :] + np.uint32(1)
        if n in SIZES:
            whole_gram = left >= n
            place = ((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            yield number[whole_gram], place[whole_gram]


@dataclass
class Model:
    """weights: of each place, mostly 0; bias: the logit of a text without features."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        table = np.zeros(1 << BITS, np.float32)
        table[self.places] = self.weights
        used = table != 0

        def score(texts: list[str]) -> np.ndarray:
            total = np.full(len(texts), self.bias)
            hits = []
            for number, place in features(texts):
                here = used[place]
                hits.append(np.unique((number[here].astype(np.int64) << BITS) | place[here]))
            if hits:
                found = np.unique(np.concatenate(hits))
                total += np.bincount(found >> BITS, weights=table[found & ((1 << BITS) - 1)], minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

        return score


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, other, toxic: in how many of a partition's texts (toxic, places) each place occurs, by label."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for toxic, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[toxic, np.frombuffer(places.as_buffer(), np.uint32)] += 1
    used = np.flatnonzero(counts.sum(0))
    for i in range(0, len(used), 1 << 17):
        own = used[i : i + (1 << 17)]
        yield pa.RecordBatch.from_pydict({"place": pa.array(own), "other": pa.array(counts[0, own].astype(np.int64)), "toxic": pa.array(counts[1, own].astype(np.int64))})


def chosen_places(rows: DataFrame, n_other: int, n_toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose shares among toxic and other texts differ clearly, KEPT_FEATURES at most, and their log-count ratios."""
    n = n_other + n_toxic
    both = (F.col("other") + F.col("toxic")) / n
    error = F.sqrt(F.greatest(both * (1 - both), F.lit(1 / n)) * (1 / n_toxic + 1 / n_other))
    counts = rows.mapInArrow(lean(counted), "place long, other long, toxic long").groupBy("place").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    z = F.abs(F.col("toxic") / n_toxic - F.col("other") / n_other) / error
    found = counts.withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "place").limit(KEPT_FEATURES).select("place", "other", "toxic").collect()
    table = np.array(sorted((x.place, x.other, x.toxic) for x in found), np.float64).reshape(-1, 3)
    part = (table[:, 1:] + SMOOTHING) / (table[:, 1:] + SMOOTHING).sum(0, keepdims=True)
    return table[:, 0].astype(np.int64), np.log(part[:, 1] / part[:, 0])


def distinct(text: str) -> np.ndarray:
    """The places of a text's distinct features."""
    found = [np.unique(place) for _, place in features([text])]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def logistic(doc: np.ndarray, feature: np.ndarray, scale: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on scaled presence features, by accelerated gradient descent."""
    n, m = len(y), len(scale)
    size = np.sqrt(np.bincount(doc, weights=scale[feature] ** 2, minlength=n)).max() or 1.0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both classes weigh the same
    rate = 4.0 / ((size**2 + 1) * max(1.0, (balance**2).mean()) ** 0.5 / 8 + PENALTY)
    w, bias, w_old, bias_old = np.zeros(m), 0.0, np.zeros(m), 0.0
    loss_old = loss_before = np.inf
    # sums over a row's or a feature's entries, in the order of each
    with_entries, starts = np.unique(doc, return_index=True)
    by_feature = np.argsort(feature, kind="stable")
    used, places = np.unique(feature[by_feature], return_index=True)
    of_feature = doc[by_feature]
    for step in range(STEPS):
        pull = step / (step + 3)
        v, c = w + pull * (w - w_old), bias + pull * (bias - bias_old)
        logit = np.full(n, c)
        logit[with_entries] += np.add.reduceat((v * scale)[feature], starts)
        error = balance * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / n
        loss = (balance * (np.logaddexp(0, logit) - y * logit)).mean() + PENALTY / 2 * (v @ v)
        if loss > loss_old:  # the step was too long
            rate, w_old, bias_old, loss_old = rate / 2, w.copy(), bias, np.inf
            continue
        loss_old = loss
        if step % 20 == 0:
            if loss_before - loss < LEAST_GAIN * loss:
                break
            loss_before = loss
        w_old, bias_old = w, bias
        slope = np.zeros(m)
        slope[used] = np.add.reduceat(error[of_feature], places)
        w = v - rate * (slope * scale + PENALTY * v)
        bias = c - rate * error.sum()
    return w, bias


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that no fit may see: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fits on at most sample_rows labelled rows outside the held-out third.

    Their n-grams are found and counted in all tasks; one task fits the chosen features' weights.
    """
    ready(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    most = sample_rows // 4
    chosen = known.filter("toxic = 1").orderBy(*order).limit(most).unionByName(known.filter("toxic = 0").orderBy(*order).limit(sample_rows - most))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    # of several texts of one doc_id the one with the least digest; chosen has sample_rows rows at most
    first = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), "toxic", "text")).alias("x")).select("doc_id", "x.toxic", "x.text")

    def found_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([distinct(own.column(2)[0].as_py()).tobytes()], pa.binary())], names=["doc_id", "toxic", "places"])

    rows = stored(first.mapInArrow(lean(found_in), "doc_id long, toxic int, places binary"), "ngrams")
    sizes = {x.toxic: x.n for x in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        discard(rows)
        return None
    places, scale = chosen_places(rows.select("toxic", "places"), sizes[0], sizes[1])

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BITS, -1, np.int64)
        number[places] = np.arange(len(places))
        for batch in batches:
            own = [number[np.frombuffer(x.as_buffer(), np.uint32)] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[x >= 0].astype(np.uint16).tobytes() for x in own], pa.binary())], names=["doc_id", "toxic", "features"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, held = [], []
        for batch in batches:
            toxic += batch.column(0).to_pylist()
            held += batch.column(1).to_pylist()
        doc, feature = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) // 2 for x in held]), np.frombuffer(b"".join(held), np.uint16)
        weights, bias = logistic(doc, feature, scale, np.array(toxic, np.float64))
        yield pa.RecordBatch.from_pydict({"weights": [(weights * scale).tolist()], "bias": [float(bias)]})

    fitted = None
    if len(places):
        few = rows.mapInArrow(kept, "doc_id long, toxic int, features binary").repartition(1).sortWithinPartitions("doc_id")
        x = few.select("toxic", "features").mapInArrow(lean(learn), "weights array<double>, bias double").first()
        fitted = Model(places, np.array(x.weights, np.float32), x.bias)
    discard(rows)
    return fitted


def score_of(model: Model | None):
    """The score of a text column: the chance of label 1. Only texts go to Python and only scores come back."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model.scorer() if model is not None else lambda texts: np.zeros(len(texts))
        for texts in batches:
            yield pa.array(scorer(texts.to_pylist()), pa.float64())

    return score


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 8000) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold."""
    model = train(docs, labels, sample_rows)
    return docs.filter(score_of(model)(whole("text")) < threshold)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    model = train(docs, labels, sample_rows)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_of(model)(whole("text")).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

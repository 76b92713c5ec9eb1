"""Packing along a Hilbert curve: neighbouring documents share sequences.

A document's ids are hashed to a signed vector of BINS places, scaled to length 1, projected to DIMENSIONS by a fixed
random matrix, and placed on a Hilbert curve through the cells of that space. Documents are range-sorted by their place
(ties by doc_id), and each range is packed as one stream: a sequence is cut off after every ``length`` ids. What is left
at a range's end is cut into sequences of powers of two, which need no padding.

The token table is written once, so the range sort samples its key column only and texts are encoded once. Null and
empty texts are the end id alone; very long texts run through many sequences; rows with a null doc_id and repeated rows
are packed like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, lean, parts, ready, stored, whole
from .tokens import words

BINS, DIMENSIONS, CELL_BITS = 1024, 4, 10
VECTOR_SEED = 20


def projection(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place and the sign of each id in a hashed vector, and the matrix from there to few dimensions."""
    rng = np.random.default_rng(VECTOR_SEED)
    return rng.integers(0, BINS, vocabulary), rng.choice([-1.0, 1.0], vocabulary), rng.standard_normal((BINS, DIMENSIONS))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell numbers (each below 2^bits).

    From the highest bit down, the half that a row lies in along each axis decides how the smaller cube's curve is
    turned: low bits of the first axis are flipped, or exchanged with another axis's. A Gray code of the halves is the
    place in the cube.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(axes):
            upper = (x[i] >> b & 1).astype(bool)
            change = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ change)
            x[i] ^= change
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            place = place << 1 | x[i] >> b & 1
    return place


def curve_places(vectors: np.ndarray) -> np.ndarray:
    """Hilbert places of projected vectors; each coordinate is spread by the logistic function first."""
    cells = np.minimum((1 << CELL_BITS) / (1 + np.exp(-1.7 * vectors)), (1 << CELL_BITS) - 1).astype(np.int64)
    return hilbert(cells, CELL_BITS)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place on the curve, and the ids with the end id (as bytes of the width that the vocabulary needs)."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words(tokenizer)
        bins, signs, matrix = projection(max(encoder.tokenizer.get_vocab_size(), end_id + 1))
        ending = encoder.packed([end_id])
        for some in joined(batches):
            found, places = encoder.batch(some.column(1))
            all_ids = [found[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
            for i in range(0, some.num_rows, 500):
                rows, ids = some.slice(i, 500), all_ids[i : i + 500]
                vectors = np.zeros((len(ids), BINS))
                for row, own in zip(vectors, ids, strict=True):
                    row += np.bincount(bins[own], weights=signs[own], minlength=BINS)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(curve_places(vectors @ matrix)), pa.array([x.tobytes() + ending for x in ids], pa.binary())], names=["doc_id", "place", "ids"])

    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).mapInArrow(lean(apply), "doc_id long, place long, ids binary")


class Packer:
    """Cuts a stream of documents into sequences; pieces come out as soon as their sequence is full."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence, self.filled = length, first_sequence, 0
        self.open: list[tuple] = []  # pieces of the sequence that is being filled
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            own = ids[at : at + self.length - self.filled]
            self.open.append((doc_id, at, own, len(ids)))
            at += len(own)
            self.filled += len(own)
            if self.filled == self.length:
                self.close(self.open)
                self.open, self.filled = [], 0

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, own, total in pieces:
            data = own.astype("<u4").tobytes()
            self.done.append((doc_id, start, len(own), zlib.crc32(data), total, self.sequence, offset, data))
            offset += len(own)
        self.sequence += 1

    def finish(self) -> None:
        """Cuts what is left into powers of two, the greatest first."""
        while self.filled:
            size = room = 1 << (self.filled.bit_length() - 1)
            now, later = [], []
            for doc_id, start, own, total in self.open:
                head, tail = own[:room], own[room:]
                room -= len(head)
                now += [(doc_id, start, head, total)] * bool(len(head))
                later += [(doc_id, start + len(head), tail, total)] * bool(len(tail))
            self.close(now)
            self.open, self.filled = later, self.filled - size


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tokens binary"


def packed(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its ids (tokens: unsigned 32-bit, little-endian)."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kind = Packer(length, TaskContext.get().partitionId() << 32), words(tokenizer).dtype
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, np.frombuffer(ids, kind))
                if len(packer.done) >= 200:
                    yield made(packer.done)
                    packer.done = []
        packer.finish()
        yield made(packer.done)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "tokens" else pa.int64()) for n, x in zip(names, columns, strict=True)], names=names)

    table = stored(tokenized(docs, tokenizer, end_id, id_col, text_col), "tokens")
    ranges = table.repartitionByRange(parts(table), "place", "doc_id").sortWithinPartitions("place", "doc_id")
    return ranges.select("doc_id", "ids").mapInArrow(lean(pack), PIECE)

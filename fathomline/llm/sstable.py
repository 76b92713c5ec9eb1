"""Sorted-string-table shards of token ids: one immutable file a range of document identifiers.

File: magic, then blocks, index, Bloom filter and footer. A block holds entries in key order; each has the length of
the prefix shared with the key before it, the rest of the key, and the value. Every RESTART-th entry shares nothing.
Blocks are zstd frames with a CRC-32. The sparse index has the last key, place and length of each block; the Bloom
filter has all keys; the footer has the places of both, the counts and the width of an id. A lookup reads the footer,
index and filter, finds the one block by binary search and decodes it.

Keys are 9 bytes: 0 for a null doc_id, else 1 and the doc_id in order-keeping big-endian form. Repeated doc_ids are
repeated entries. Null or empty texts have the end id alone; very long texts make a large block of their own; an empty
table makes no shard. Other columns are ignored. Files are written under another name and moved into place, so a task
that is run again leaves one whole file.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, joined, lean, parts, ready, whole
from .tokens import words

MAGIC = b"TOKSST1\n"
RESTART = 16
BLOCK_BYTES = 1 << 18
BLOOM_BITS_A_KEY, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQHHI8s")  # index place, length; filter place, length; entries, ids; id width, hashes, filter bits / 8, magic


def open_file(uri: str, mode: str):
    """A stream of a file in any store that pyarrow reaches: "r", "w"."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path) if mode == "r" else store.open_output_stream(path)


def move_file(old: str, new: str) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(old)
    store.move(path, fs.FileSystem.from_uri(new)[1])


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def doc_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            return n, at


def shared_prefix(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix([a, b]))


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * b) % bits for i in range(hashes)]


@dataclass
class Writer:
    """Writes one shard; keys come in ascending order."""

    out: object
    width: int
    at: int = 0
    entries: int = 0
    ids: int = 0
    index: list[tuple[bytes, int, int]] = field(default_factory=list)
    hashes: list[bytes] = field(default_factory=list)
    block: bytearray = field(default_factory=bytearray)
    held: int = 0
    last: bytes = b""

    def __post_init__(self):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=1).compress
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        shared = shared_prefix(self.last, key) if self.held % RESTART else 0
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.held, self.entries, self.ids = key, self.held + 1, self.entries + 1, self.ids + len(value) // self.width
        self.hashes.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data = self.compress(bytes(self.block))
            self.index.append((self.last, self.at, len(data)))
            self.put(struct.pack("<I", zlib.crc32(data)) + data)
            self.block, self.held = bytearray(), 0

    def close(self) -> None:
        self.flush()
        index_at = self.at
        for key, at, size in self.index:
            self.put(struct.pack("<B", len(key)) + key + struct.pack("<QQ", at, size))
        bloom_at, bits = self.at, 8 * max(1, -(-len(self.hashes) * BLOOM_BITS_A_KEY // 8))
        bloom = np.zeros(bits, np.uint8)
        for key in self.hashes:
            bloom[bloom_places(key, bits, BLOOM_HASHES)] = 1
        self.put(np.packbits(bloom, bitorder="little").tobytes())
        self.put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, self.entries, self.ids, self.width, BLOOM_HASHES, bits // 8, MAGIC))


class Reader:
    """Reads one shard by scan or by key."""

    def __init__(self, uri: str):
        import zstandard

        self.decompress = zstandard.ZstdDecompressor().decompress
        self.file = open_file(uri, "r")
        size = self.file.size()
        index_at, index_len, bloom_at, bloom_len, self.entries, self.ids, self.width, self.hashes, filter_bytes, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or self.read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no such table")
        self.bits = 8 * filter_bytes
        self.bloom = self.read(bloom_at, bloom_len)
        self.index, data, at = [], self.read(index_at, index_len), 0
        while at < len(data):
            n = data[at]
            self.index.append((data[at + 1 : at + 1 + n], *struct.unpack_from("<QQ", data, at + 1 + n)))
            at += 17 + n

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, at: int, size: int) -> Iterator[tuple[bytes, bytes]]:
        data = self.read(at, size + 4)
        if zlib.crc32(data[4:]) != struct.unpack_from("<I", data)[0]:
            raise ValueError("a block is damaged")
        data, at, key = self.decompress(data[4:]), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for _, at, size in self.index:
            yield from self.block(at, size)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[i >> 3] >> (i & 7) & 1 for i in bloom_places(key, self.bits, self.hashes))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of a document: none if it is absent."""
        key, found = key_of(doc_id), []
        if self.may_have(key):
            first = bisect.bisect_left(self.index, key, key=lambda x: x[0])
            for last, at, size in self.index[first:]:
                found += [v for k, v in self.block(at, size) if k == key]
                if last > key:
                    break
        return found


MANIFEST = "shard int, uri string, entries long, ids long"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Writes the shards and returns their manifest (a row a shard), in key order."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), words(tokenizer)
        uri, ending = f"{folder}/shard-{part:06d}.sst", None
        draft, writer, out = f"{folder}/.{uuid.uuid4().hex}", None, None
        for batch in joined(batches):
            ids, places = encoder.batch(batch.column(1))
            for doc_id, i, j in zip(batch.column(0).to_pylist(), places[:-1].tolist(), places[1:].tolist(), strict=True):
                if writer is None:
                    writer = Writer(out := open_file(draft, "w"), encoder.dtype.itemsize)
                    ending = encoder.packed([end_id])
                writer.add(key_of(doc_id), ids[i:j].tobytes() + ending)
        if writer is not None:
            writer.close()
            out.close()
            move_file(draft, uri)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "uri": [uri], "entries": [writer.entries], "ids": [writer.ids]})

    spark = ready(docs.sparkSession)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    sorted_rows = rows.repartitionByRange(parts(rows), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return sorted(sorted_rows.mapInArrow(lean(write), MANIFEST).collect(), key=lambda x: x.shard)


def read_shards(spark: SparkSession, manifest: list) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32, tokens (the ids' bytes, as unsigned 32-bit)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader, start = Reader(row["uri"]), row["start"]
                kind, out, size = np.dtype(f"<u{reader.width}"), [], 0
                for key, value in reader.scan():
                    ids = np.frombuffer(value, kind).astype("<u4").tobytes()
                    out.append((doc_of(key), start, len(ids) // 4, zlib.crc32(ids), ids))
                    start, size = start + len(ids) // 4, size + len(ids)
                    if size > 8 << 20:
                        yield made(out)
                        out, size = [], 0
                yield made(out)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "tokens"])

    ready(spark)
    starts, total = [], 0
    for row in manifest:
        starts.append((row.uri, total))
        total += row.ids
    shards = spark.createDataFrame(starts, "uri string, start long").repartition(max(1, len(starts)), "uri")
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, tokens binary")


def token_table(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes documents as shards into folder (a new one in the shared folder if none is given) and reads them back."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, folder or fresh(spark, "sstable"), tokenizer, end_id, id_col, text_col))

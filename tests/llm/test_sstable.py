"""Token tables: round trip through the files, lookups, damage."""

import zlib

import numpy as np
import pytest

from fathomline.llm import sstable
from fathomline.llm.common import fresh
from fathomline.llm.sstable import Reader, read_shards, token_table, write_shards
from fathomline.llm.tokens import tokenizer_path

ROWS = [(5, "five"), (-7, None), (2**40, "ten words " * 5000), (0, ""), (None, "no id"), (5, "five"), *((i, f"document {i}") for i in range(10, 300))]


def ids(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_round_trip_and_lookup(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, start int")
    manifest = write_shards(docs, fresh(spark, "sst"), tokenizer_path(), 1)
    found = read_shards(spark, manifest).collect()
    found.sort(key=lambda x: x.start)
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [x.doc_id for x in found] == [r[0] for r in want]
    at = 0
    for x, (_, text) in zip(found, want, strict=True):
        assert (x.tokens, x.start, x.n_tokens, x.ids_crc32) == (ids(text), at, len(ids(text)) // 4, zlib.crc32(ids(text)))
        at += x.n_tokens
    readers = [Reader(x.uri) for x in manifest]
    for doc_id, count in ((5, 2), (None, 1), (2**40, 1), (299, 1), (301, 0), (-8, 0)):
        assert sum(len(r.get(doc_id)) for r in readers) == count


def test_small_blocks_and_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    path = str(tmp_path / "x.sst")
    with sstable.open_file(f"file://{path}", "w") as out:
        writer = sstable.Writer(out, 2)
        for i in range(500):
            writer.add(sstable.key_of(i * 3), np.array([i, 1], "<u2").tobytes())
        writer.close()
    reader = Reader(f"file://{path}")
    assert len(reader.index) > 20 and [sstable.doc_of(k) for k, _ in reader.scan()] == [i * 3 for i in range(500)]
    assert all(len(reader.get(i)) == (i % 3 == 0) for i in range(1500))
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(Reader(f"file://{path}").scan())


def test_empty_table(spark):
    assert token_table(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(), 1).count() == 0

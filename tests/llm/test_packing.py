"""Packing: exact round trip, padding rule, curve order."""

import itertools
import zlib
from collections import defaultdict

import numpy as np

from fathomline.llm.packing import hilbert, packed
from fathomline.llm.tokens import tokenizer_path


def test_curve_visits_each_cell_once_by_neighbours():
    for axes, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        places = hilbert(cells, bits)
        assert sorted(places) == list(range(len(cells)))
        path = cells[np.argsort(places)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "  ", "Hello World", "don't stop <|endoftext|> x", "straße ÉTÉ 日本 123", "word " * 9000, "Hello World"] + [f"text number {i} of many " * (i % 7) for i in range(60)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (3, "Hello World", 1)]
    found = packed(spark.createDataFrame(rows, "doc_id long, text string, length int"), tokenizer_path(), 2, length=256).collect()
    encode = Tokenizer.from_file(tokenizer_path()).encode
    sequences = defaultdict(list)
    docs = defaultdict(list)
    for x in found:
        sequences[x.sequence_id].append(x)
        docs[x.doc_id].append(x)
        assert x.length == len(x.tokens) // 4 and x.ids_crc32 == zlib.crc32(x.tokens)
    for pieces in sequences.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 256 and at & (at - 1) == 0
    for doc_id, text, _ in rows[:-1]:
        want = np.array([*encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        pieces = sorted(docs[doc_id], key=lambda x: x.start)
        if doc_id != 3:
            assert b"".join(x.tokens for x in pieces) == want and {x.doc_tokens for x in pieces} == {len(want) // 4}
            assert [x.start for x in pieces] == list(np.cumsum([0] + [x.length for x in pieces[:-1]]))
        else:
            assert sum(x.length for x in pieces) == 2 * len(want) // 4


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(), 2).count() == 0

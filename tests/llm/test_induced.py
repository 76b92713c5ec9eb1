"""Induced sorting against plain sorting."""

import random

import numpy as np
import pytest

from fathomline.llm.induced import DEPTH, sorted_suffixes


def plain(strings):
    """(suffix place, common prefix with the one before) in order; equal suffixes in order of place."""
    rows, at = [], 0
    for s in strings:
        rows += [(s[i:], at + i) for i in range(len(s))]
        at += len(s) + 1
    rows.sort()
    out = []
    for k, (s, place) in enumerate(rows):
        before = rows[k - 1][0] if k else b""
        n = next((i for i, (x, y) in enumerate(zip(s, before)) if x != y), min(len(s), len(before)))
        out.append((place, min(n, DEPTH)))
    return out


def induced(strings, **kw):
    text = np.frombuffer(b"".join(s + b"\0" for s in strings) + b"\0" * 8, np.uint8).copy()
    parts = list(sorted_suffixes(text, **kw))[::-1]
    return [x for up, common in parts for x in zip(up.tolist(), common.tolist())]


def test_random_strings(tmp_path):
    rng = random.Random(1)
    for round_ in range(150):
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(1, 250))])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 8))]
        strings += [strings[0]] * rng.randrange(3)
        if rng.random() < 0.3:
            strings.append(strings[0] * 12)
        got, want = induced(strings, limit=rng.choice([5, 1 << 20])), plain(strings)
        assert sorted(x for x, _ in got) == sorted(x for x, _ in want)
        ends = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
        key = lambda at: bytes(ends[at : at + list(ends[at:]).index(0)])
        assert [key(x) for x, _ in got] == [key(x) for x, _ in want]
        assert [c for _, c in got] == [c for _, c in want], (strings, round_)


def test_long_common_prefixes():
    base = bytes(random.Random(3).choice(b"abcdef ") for _ in range(600))
    strings = [base, base[100:], b"x" + base[200:], base[:300] + b"q"]
    assert [c for _, c in induced(strings)] == [c for _, c in plain(strings)]


def test_substrings_that_end_at_a_word():
    """S* substrings of exactly 8 or 16 symbols, of which one is the beginning of another."""
    rng = random.Random(6)
    parts = [b"abcdefgd", b"abcdefgde", b"abcdefgdc", b"abcdefghijklmnod", b"abcdefghijklmnodc", b"abcdefghijklmnode", b"ab", b"hg"]
    for _ in range(60):
        strings = [b"".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(6)]
        assert [c for _, c in induced(strings)] == [c for _, c in plain(strings)]


def test_queues_on_disk_and_depth():
    rng = random.Random(9)
    strings = [bytes(rng.choice(b"abcd ") for _ in range(900)) for _ in range(3)]
    strings += [strings[0], strings[1][:700]]
    spills = []
    got = induced(strings, limit=50, depth=600, spills=spills)
    assert spills[0] > 3
    want = plain(strings)
    assert [min(c, 255) for _, c in got] == [c for _, c in want] and max(c for _, c in got) == 600
    with pytest.raises(ValueError):
        induced(strings, depth=40_000)

"""Surrogates: format, distinctness, coreference, and nothing left of the originals."""

import os
import re

import pytest

from fathomline.llm import pii
from fathomline.llm.pii import assigned, pseudonymized


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


ROWS = [
    (1, "Write to Anna.Lee7@Mail.Example.com or call +1 (614) 555-8001, please."),
    (2, "anna.lee7@mail.example.com paid by 4111 1111 1111 1111 and 4111111111111111 from 10.1.2.3; +1 614-555-8001"),
    (3, "Card 4952935900253052, address 169.122.221.182. Mrs. Jane Miller met Mr. Tom Miller and James Brown; JAMES is kept."),
    (4, None),
    (5, ""),
    (6, "no entity here 12 345"),
    (7, "DE89 3704 0044 0532 0130 00 and 078-05-1120. Госпожа Ольга Петрова."),
    (7, "DE89 3704 0044 0532 0130 00 and 078-05-1120. Госпожа Ольга Петрова."),
    (None, "call +1 (614) 555-8001"),
    (8, "start 4111111111111111"),
    *((100 + i, f"192.168.0.{i} and user{i:03d}@a.org") for i in range(60)),
]


def test_surrogates(spark):
    docs = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, n_entities int")
    found = [(x.doc_id, x.text, x.n_entities) for x in pseudonymized(docs, "key").collect()]
    assert len(found) == len(ROWS) and len([x for x in found if x[0] == 7]) == 2
    text = {i: t for i, t, _ in found}
    everything = " ".join(t for _, t, _ in found)
    for original in ("anna.lee7", "555-8001", "4111111111111111", "4952935900253052", "169.122.221.182", "Miller", "Jane", "Brown", "DE89 3704", "078-05-1120", "Петрова", "user0"):
        assert original.lower() not in everything.lower()
    a, b = re.search(r"\S+@\S+", text[1])[0], re.search(r"\S+@\S+", text[2])[0]
    assert a.lower() == b and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}\d@[A-Z][a-z]{3}\.[A-Z][a-z]{6}\.com", a)
    phones = [re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", text[i])[0] for i in (1, None)] + [re.search(r"\+1 \d{3}-\d{3}-\d{4}", text[2])[0]]
    assert len({re.sub(r"\D", "", x) for x in phones}) == 1
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", text[2])[0].replace(" ", "")
    assert card in text[2] and luhn(card) and card[0] == "4" and text[8] == f"start {card}"
    assert luhn(re.search(r"\d{16}", text[3])[0]) == luhn("4952935900253052")
    assert re.search(r"from 10\.\d+\.\d+\.\d+;", text[2])
    names = re.search(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+) and (\w+) (\w+); JAMES is kept\.", text[3])
    assert names[2] == names[4] and names[1].endswith("a")
    assert re.search(r"Госпожа [А-Я][а-я]+ [А-Я][а-я]+\.$", text[7])
    assert text[4] == text[5] == "" and text[6] == ROWS[5][1]
    hosts = {re.match(r"192\.168\.\d+\.\d+", text[100 + i])[0] for i in range(60)}
    assert len(hosts) == 60 and len({text[100 + i].split()[-1] for i in range(60)}) == 60


def test_key_and_empty(spark):
    docs = spark.createDataFrame([(1, "a.b@c.org")], "doc_id long, text string")
    assert pseudonymized(docs, "one").first().text != pseudonymized(docs, "two").first().text
    assert pseudonymized(docs, "one").first().text == pseudonymized(docs, "one").first().text
    assert pseudonymized(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


@pytest.mark.parametrize("kind", ["ip", "phone", "surname", "email"])
def test_any_number_of_entities(spark, monkeypatch, kind):
    monkeypatch.setattr(pii, "MOST_ATTEMPTS", 12)
    monkeypatch.setattr(pii, "SYLLABLES", {x: ["ba", "be", "bo", "da"] for x in pii.SYLLABLES})
    cores = {
        "ip": [f"192.168.{a}.{b}" for a in range(256) for b in range(256)],
        "phone": [f"{i:06d}" for i in range(0, 1_000_000, 20)] + [f"{i:06d}" for i in range(7, 1_000_000, 20)],
        "surname": [f"name{i}" for i in range(900)],
        "email": [f"{a}@{b}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"],
    }[kind]
    found = assigned(spark.createDataFrame([(kind, c) for c in cores], "kind string, core string"), "key").collect()
    assert {x.core for x in found} == set(cores) and len({x.surrogate for x in found}) == len(found) == len(cores)
    assert all(x.core != x.surrogate for x in found)
    if kind in ("ip", "phone"):
        shape = r"192\.168\.\d{1,3}\.\d{1,3}" if kind == "ip" else r"\d{6}"
        assert all(re.fullmatch(shape, x.surrogate) for x in found)


def test_lone_names_and_more_formats(spark):
    rows = [
        (1, "James Miller came. Miller said that James left; Millers stay, Miller's too."),
        (2, "Frau Weber und Weber. Anna Smith-Jones, then Smith-Jones; Mary O'Brien and O'Brien."),
        (3, "Weber alone is nobody here. Call 555-123-4567 or 555.123.4567, not 1234-555-123-4567."),
        (4, "Hosts 2001:db8::1, fe80::1 and 2001:0db8:0:0:0:ff00:42:8329 but std::vector and 12:30:45."),
    ]
    text = {x.doc_id: x.text for x in pseudonymized(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    first = re.fullmatch(r"(\w+) (\w+) came\. (\w+) said that (\w+) left; Millers stay, (\w+)'s too\.", text[1])
    assert first[2] == first[3] == first[5] != "Miller" and first[1] == first[4] != "James"
    second = re.fullmatch(r"Frau (\w+) und (\w+)\. (\w+) (\w+), then (\w+); (\w+) (\w+) and (\w+)\.", text[2])
    assert second[1] == second[2] and second[4] == second[5] and second[7] == second[8] and "Weber" not in text[2]
    third = re.fullmatch(r"Weber alone is nobody here\. Call (\d{3}-\d{3}-\d{4}) or (\d{3}\.\d{3}\.\d{4}), not 1234-555-123-4567\.", text[3])
    assert third[1] == third[2].replace(".", "-") != "555-123-4567"
    assert "db8" not in text[4] and "fe80::1" not in text[4] and text[4].endswith("but std::vector and 12:30:45.")


def test_whole_table_by_brute_force(spark):
    """Every e-mail address, card and IPv4 address of a table, found by plain Python, has one surrogate of its own."""
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.isdir(os.path.dirname(path)):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path).select("doc_id", "text")
    old = {x.doc_id: x.text or "" for x in docs.collect()}
    new = {x.doc_id: x.text for x in pseudonymized(docs, "k").collect()}
    assert old.keys() == new.keys()
    for pattern, plain in ((r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", str.lower), (r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", str), (r"(?<!\d)\d{16}(?!\d)", str)):
        given: dict[str, str] = {}
        for i, text in old.items():
            before, after = re.findall(pattern, text), re.findall(pattern, new[i])
            assert len(before) == len(after)
            for a, b in zip(before, after, strict=True):
                assert given.setdefault(plain(a), plain(b)) == plain(b) != plain(a)
        assert len(given) == len(set(given.values())) and not set(given) & set(given.values())
        assert len(given) > 2
    hint = re.compile(r"\d|@")
    assert all(new[i] == text for i, text in old.items() if not hint.search(text))


def test_long_text_and_people(spark):
    text = "word " * 200_000 + "Frau Weber, Weber@x.org and Weber " + "word " * 200_000
    found = pseudonymized(spark.createDataFrame([(1, text), (2, "nobody"), (2, "nobody")], "doc_id long, text string"), "k").collect()
    one = next(x for x in found if x.doc_id == 1)
    assert one.n_entities == 3 and "Weber" not in one.text and one.text.startswith("word ") and len([x for x in found if x.text == "nobody"]) == 2

"""SimHash components against brute force."""

import random
import re

import numpy as np
import xxhash

from fathomline.llm import simhash
from fathomline.llm.simhash import near_components, near_deduplicated

TEXTS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints, reach=2):
    keys, parent = list(prints), {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= reach:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n", "One", "one two", "ONE  two three", "Ünïcode É a b"]
    base = [rng.choice(TEXTS) for _ in range(400)]
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(400)] = f"w{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(TEXTS) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[9])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    found = near_components(docs).collect()
    prints = {i: brute_print(t) for i, t in rows}
    expected = brute_components(prints)
    assert len(found) == len(rows)
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in found} == expected


def test_tree_finds_every_pair(monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 60)
    monkeypatch.setattr(simhash, "LEAF_ROWS", 8)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [c ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(b2)) for c in centres[:150] for b, b2 in rng.integers(0, 64, (4, 2))]
    points = np.unique(np.concatenate([centres, np.array(flips, np.uint64), np.array([0, 1, 3], np.uint64)]))
    width, bits = simhash.cuts(len(points), 2)
    assert width == 21 and bits > 2 and simhash.cuts(10**13, 2) == (21, 21) and simhash.cuts(10, 2) == (21, 0)
    a, b = [], []
    for cut in range(3):
        part = points >> np.uint64(cut * width) & np.uint64((1 << bits) - 1)
        for own in np.unique(part):
            rows = np.flatnonzero(part == own)
            x, y = simhash.shard_links(points[rows], np.ones(len(rows), bool), 2)
            a.append(rows[x]), b.append(rows[y])
    a, b = np.concatenate(a), np.concatenate(b)
    full = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    assert (simhash.stars(a, b, len(points)) == simhash.stars(*full, len(points))).all()


def test_shards_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 50)
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    flips = [c ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(b2)) for c in centres[:150] for b, b2 in rng.integers(0, 64, (3, 2))]
    points = np.unique(np.concatenate([centres, np.array(flips, np.uint64)]))
    number = {int(x): i for i, x in enumerate(points.view(np.int64))}
    found = simhash.near_links(spark.createDataFrame([(x,) for x in number], "fingerprint long"), 2).collect()
    full = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    a, b = (np.array([number[x[k]] for x in found]) for k in ("a", "b"))
    assert (simhash.stars(a, b, len(points)) == simhash.stars(*full, len(points))).all()


def test_empty_table(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_deduplicated(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, groups = [], []
    for g in range(30):
        base = [word() for _ in range(300)]
        groups.append([])
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([1, 4])):
                copy[rng.randrange(300)] = word()
            groups[-1].append(len(rows))
            rows.append((len(rows), " ".join(copy), "s"))
        half = len(rows)
        rows.append((half, " ".join(base[:150] + [word() for _ in range(150)]), "s"))  # a third in common
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "one word", "s"), (None, "one word", "s"), (1003, rows[0][1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k string")
    kept = near_deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted(x.doc_id for x in kept.collect())
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for group in groups for i, t, _ in [rows[x] for x in group]}
    gone = {1001, 1003}  # of a group all but the first of each run of links of 0.8 or more
    for group in groups:
        seen = set()
        for i in group:
            if i not in seen:
                todo = [i]
                while todo:
                    own = todo.pop()
                    near = {x for x in group if x not in seen and x != i and len(sets[own] & sets[x]) >= 0.8 * len(sets[own] | sets[x])}
                    seen |= near
                    todo += near
        gone |= seen
    assert len(gone) > 40
    assert ids == sorted(i for i, _, _ in rows if i is not None and i not in gone)
    assert near_deduplicated(docs.limit(0)).count() == 0


def test_near_deduplicated_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HASHES_COMPARED", 500)
    rng = random.Random(21)
    rows = []
    for g in range(160):  # pairs and triples with similarities of about 0.7 to 0.9, far apart from other groups
        size = rng.choice([8, 9, 60, 300, 600])
        base = [f"g{g}w{i}" for i in range(size)]
        rows.append(" ".join(base))
        for _ in range(rng.choice([1, 1, 2])):
            copy = list(base)
            for i in rng.sample(range(size), max(1, round(size * rng.uniform(0.012, 0.036)))):
                copy[i] = f"g{g}x{rng.randrange(10**6)}"
            rows.append(" ".join(copy if size > 9 else base + [f"g{g}y"]))
    sets = [{t.split()[i : i + 5].__str__() for i in range(len(t.split()) - 4)} for t in rows]
    pairs = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(len(rows)) for b in range(a + 1, min(a + 3, len(rows)))]
    assert sum(0.75 <= j < 0.8 for *_, j in pairs) > 15 and sum(0.8 <= j < 0.85 for *_, j in pairs) > 15
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, j in pairs:
        if j >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    kept = near_deduplicated(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == [i for i in range(len(rows)) if find(i) == i]


def wide_points(rng, n, groups, flips):
    """Random fingerprints of 512 bits, and groups of copies with that many bits flipped."""
    rows = [rng.getrandbits(512) for _ in range(n)]
    for size in groups:
        base = rng.getrandbits(512)
        rows += [base ^ sum(1 << i for i in rng.sample(range(512), flips)) for _ in range(size)]
    rng.shuffle(rows)
    return rows


def test_wide_fingerprints_in_trees(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 8)
    rows = wide_points(random.Random(3), 300, [2] * 20 + [40, 150], 60)
    points = np.array([[x >> 64 * w & (1 << 64) - 1 for w in range(8)] for x in rows], np.uint64)
    apart = np.bitwise_count(points[:, None] ^ points[None]).sum(2)
    hint = np.bitwise_count(points[:, None, :2] ^ points[None, :, :2]).sum(2)
    for reach, least in ((142, 128), (110, 128), (142, 30)):
        a, b = simhash.shard_links(points, np.ones(len(points), bool), reach, least)
        own = simhash.stars(a, b, len(points))
        sure = simhash.stars(*np.nonzero((apart <= reach) & (hint <= least)), len(points))
        most = simhash.stars(*np.nonzero(apart <= reach), len(points))
        assert (own[sure] == own).all() and (most[own] == most).all()
        assert least < 128 or (own == most).all()


def test_deals_lose_few_pairs(monkeypatch):
    assert simhash.bit_chance(0.8, 1, 5) == 0.1875 and 0.161 < simhash.bit_chance(0.8, 6, 20) < 0.1612
    assert simhash.deals(10, 0.8)[0].shape == (1, 0)
    rng = np.random.default_rng(5)
    for total in (50_000, 1_000_000):
        places, common = simhash.deals(total, 0.8)
        assert places.shape[1] == (total // simhash.SHARD_ROWS).bit_length() and common < len(places)
        for rows, chance in ((places[:common], 0.1612), (places, 0.1875)):
            apart = rng.random((20_000, 512)) < chance
            assert (~np.any([~apart[:, x].any(1) for x in rows], axis=0)).sum() <= 3


def test_fingerprints_meet_through_shards_and_trees(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 20)
    rows = wide_points(random.Random(4), 300, [2] * 60 + [90], 45)  # two copies differ in some 82 bits
    prints = spark.createDataFrame([(i, bytearray(x.to_bytes(64, "little")), 3 + i % 9) for i, x in enumerate(rows)], "id long, print binary, size int")
    found = simhash.similar_links(prints, 0.8).collect()
    own = simhash.stars(np.array([x.a for x in found]), np.array([x.b for x in found]), len(rows))
    points = np.array([[x >> 64 * w & (1 << 64) - 1 for w in range(8)] for x in rows], np.uint64)
    want = simhash.stars(*np.nonzero(np.bitwise_count(points[:, None] ^ points[None]).sum(2) <= simhash.bits_apart(0.8)), len(rows))
    assert len(set(want.tolist())) == 361 and (own == want).all()


def test_near_deduplicated_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 20)
    test_near_deduplicated_around_the_threshold(spark, monkeypatch)

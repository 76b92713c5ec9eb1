"""SimHash near-duplicates through vantage-point trees.

Words are maximal runs of bytes other than white space after A-Z became lower case; shingles are runs of words, repeats
included (a text with fewer words is one shingle; a text without words has fingerprint zero, linked like any other). A
bit of the 64-bit fingerprint is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Fingerprints with few differing bits are found by vantage-point trees over the distinct fingerprints. Two fingerprints
that differ in ``reach`` bits agree in one of reach + 1 equal cuts of their bits, so each fingerprint goes to that many
shards, at any size; a shard has those that agree in some bits of a cut, as many bits as make SHARD_ROWS of them. In a
shard a tree parts the fingerprints by their Hamming distance from vantage points: each lives on one side of a border,
and by the triangle inequality only sides whose border is within reach are asked besides, down to leaves, where all are
compared. (Trees over the whole table, as before, had fingerprints near borders in 2.3 shards at 200,000 random ones and
in 6.4 at 2,000,000.) No pair is lost. Shards give a spanning forest of their links, never all pairs.

For near texts by Jaccard similarity (near_deduplicated) fingerprints are 512 bits wide and cuts are many; the same trees
search in the shards, and exact counts decide.

Null text counts as empty; texts of any length are read whole; a bit that is set in exactly half the hashes is 0. Equal
texts and repeated rows have equal fingerprints, hence one component. A null doc_id is
never the smallest. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest128, few, lean, parts, ready, split_join, stored, whole, without
from .components import components, stars

SEED = 42
#: Fingerprints of a shard, about, and of a leaf.
SHARD_ROWS, LEAF_ROWS = 16_384, 96
#: Hashes that are counted at a time, and links that a shard holds before it reduces them to stars.
HASHES_AT_ONCE, LINKS_AT_ONCE = 1 << 19, 1 << 19


def shingle_hashes(text: str, size: int) -> list[int]:
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) > size:
        runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
        return [xxhash.xxh64_intdigest(x, SEED) for x in runs]
    return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes (runs are not empty)."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    sizes = np.diff(np.append(starts, len(hashes)))
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprint_of(text: str, size: int) -> int:
    hashes = np.array(shingle_hashes(text, size), np.uint64)
    total, n = np.zeros(64, np.int64), len(hashes)
    for i in range(0, n, HASHES_AT_ONCE):
        total += np.unpackbits(hashes[i : i + HASHES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n).view(">u8")[0]) if n else 0


def fingerprints_of(texts: list[str], size: int) -> np.ndarray:
    out, held, starts, rows = np.zeros(len(texts), np.uint64), [], [], []

    def settle() -> None:
        if rows:
            out[rows] = majority(np.array(held, np.uint64), np.array(starts))
        held.clear(), starts.clear(), rows.clear()

    for i, text in enumerate(texts):
        if len(text) > HASHES_AT_ONCE:
            out[i] = fingerprint_of(text, size)
        elif hashes := shingle_hashes(text, size):
            rows.append(i), starts.append(len(held)), held.extend(hashes)
            if len(held) >= HASHES_AT_ONCE // 4:
                settle()
    settle()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (a long with the 64 bits) of every row."""

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints_of(batch.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return rows.mapInArrow(lean(apply), "doc_id long, fingerprint long")


def distance(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(points ^ vantage)
    return bits.astype(np.int16) if points.ndim == 1 else bits.sum(1, dtype=np.int16)


def border(points: np.ndarray) -> tuple[np.ndarray, int] | None:
    """A vantage point and a radius that part the points; none if they can't be parted."""
    vantage = points[len(points) // 2]
    far = distance(points, vantage)
    radius = int(np.partition(far, (len(far) - 1) // 2)[(len(far) - 1) // 2])
    radius = min(radius, int(far.max()) - 1)
    return (vantage, radius) if len(points) > 1 and radius >= 0 else None


def part(points: np.ndarray, resident: np.ndarray, vantage: np.ndarray, radius: int, reach: int) -> tuple[np.ndarray, ...]:
    """Rows and residence inside and outside of a border.

    A resident outside visits the inside if that is within reach; it meets residents across the border there, so
    those need not come out. A visitor goes wherever residents may be within reach.
    """
    far = distance(points, vantage)
    inside = far <= radius + reach
    outside = np.where(resident, far > radius, far > radius - reach)
    return np.flatnonzero(inside), resident[inside] & (far[inside] <= radius), np.flatnonzero(outside), resident[outside]


def shard_links(points: np.ndarray, resident: np.ndarray, reach: int, hint: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links of a shard as stars: rows and the rows of their roots, for linked rows only.

    Points are numbers, or rows of words; of the latter only those within ``hint`` bits in their first two words link.
    If more than LEAF_ROWS of such residents are within reach of a vantage point they link to it, and meet all but
    each other: large groups of near-copies are not gone through in pairs.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def leaf(own: np.ndarray, visits: np.ndarray, met: bool = False) -> None:
        nonlocal found, held
        for a, b in leaf_links(points, own, visits, reach, hint, met):
            found.append((a, b))
            held += len(a)
            if held > LINKS_AT_ONCE:
                found = [reduced(found, len(points))]
                held = len(found[0][0]) // 2

    todo = [(np.flatnonzero(resident), np.flatnonzero(~resident))]
    while todo:
        own, visits = todo.pop()
        if not len(own):
            continue
        line = border(points[own]) if len(own) > LEAF_ROWS else None
        if line is None:
            leaf(own, visits)
            continue
        near = distance(points[own], line[0]) <= reach if points.ndim > 1 else np.zeros(0, bool)
        if near.sum() > LEAF_ROWS:
            found.append((own[near], np.full(near.sum(), own[len(own) // 2])))
            leaf(own[near], visits, True)
            todo.append((own[~near], np.concatenate([visits, own[near]])))
            continue
        rows, lives = np.concatenate([own, visits]), np.arange(len(own) + len(visits)) < len(own)
        within, lives_in, without, lives_out = part(points[rows], lives, *line, reach)
        todo += [(rows[within][lives_in], rows[within][~lives_in]), (rows[without][lives_out], rows[without][~lives_out])]
    return reduced(found, len(points))


def leaf_links(points: np.ndarray, own: np.ndarray, visits: np.ndarray, reach: int, hint: int = 0, met: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among own rows, unless these have met, and between them and visiting rows."""
    mine_at_once, others_at_once = (1024, 8192) if points.ndim == 1 else (LEAF_ROWS, 2048)
    for i in range(0, len(own), mine_at_once):
        mine = points[own[i : i + mine_at_once]]
        for others in (visits,) if met else (own[i:], visits):
            for j in range(0, len(others), others_at_once):
                theirs = points[others[j : j + others_at_once]]
                if points.ndim == 1:
                    x, y = np.nonzero(np.bitwise_count(mine[:, None] ^ theirs[None, :]) <= reach)
                else:
                    far = sum(np.bitwise_count(mine[:, w].copy()[:, None] ^ theirs[:, w].copy()[None, :]) for w in range(2))
                    x, y = np.divmod(np.flatnonzero(far <= hint), len(theirs))
                    near = np.bitwise_count(mine[x] ^ theirs[y]).sum(1, dtype=np.int16) <= reach
                    x, y = x[near], y[near]
                a, b = own[i + x], others[j + y]
                yield a[a != b], b[a != b]


def reduced(found: list[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = stars(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), size)
    rows = np.flatnonzero(label != np.arange(size))
    return rows, label[rows]


def cuts(total: int, reach: int) -> tuple[int, int]:
    """Bits from one cut to the next, and bits of a cut that deal the fingerprints to shards of SHARD_ROWS, about."""
    width = 64 // (reach + 1)
    return width, min(width, max(0, total // SHARD_ROWS).bit_length())


def near_links(distinct: DataFrame, reach: int) -> DataFrame:
    """Links a, b between distinct fingerprints (column fingerprint) that, taken together, join all those within reach."""
    ready(distinct.sparkSession)
    rows = distinct.select("fingerprint")
    width, bits = cuts(rows.count(), reach)

    def link(group: pa.Table) -> pa.Table:
        points = group["fingerprint"].to_numpy().view(np.uint64)
        rows, roots = shard_links(points, np.ones(len(points), bool), reach)
        return pa.table({"a": points[rows].view(np.int64), "b": points[roots].view(np.int64)})

    if not bits:
        return rows.groupBy().applyInArrow(link, "a long, b long")
    mask = (1 << bits) - 1
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), F.shiftrightunsigned("fingerprint", i * width).bitwiseAND(F.lit(mask)).alias("part")) for i in range(reach + 1)])).alias("shard")
    return rows.select("fingerprint", own).groupBy("shard").applyInArrow(link, "a long, b long")


def rooted(rows: DataFrame, reach: int) -> DataFrame:
    """fingerprint, first (its least doc_id), rows that have it, and root of every distinct fingerprint in rows."""
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "distinct")
    found = components(near_links(distinct, reach))
    named = distinct.join(found, distinct["fingerprint"] == found["node"], "left")
    return stored(named.select("fingerprint", "first", "rows", F.coalesce("root", "fingerprint").alias("root")), "named")


def near_components(docs: DataFrame, shingle: int = 3, reach: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id that links reach) of every row."""
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    named = rooted(rows, reach)
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    by_fingerprint = stored(split_join(named, ids, ["root"], "prints").select("fingerprint", "component_id", "rows"), "ids")
    return split_join(rows, by_fingerprint, ["fingerprint"], "rows").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


#: For a similarity of whole shingle sets: 64-bit words of a fingerprint, and the chance to lose a pair in dealing.
WIDE_WORDS, LOST = 8, 1e-5
#: Standard deviations of slack that fingerprints get, and their first two words: they only propose, and those of the
#: smallest sets scatter more.
SLACK, SLACK_OF_TWO = 8, 7
#: Sets of so few shingles are dealt more often, as a bit differs with a chance of up to 0.1875 there (0.161 elsewhere).
SMALL_SET = 5
#: Fingerprints that are dealt at a time, and bytes of dealt ones for each task.
DEALT_AT_ONCE, DEALT_BYTES = 1 << 15, 32 << 20
#: Hashes of a proposed group that are held in memory (more go to a file of the task), and those compared at a time.
HASHES_HELD, HASHES_COMPARED = 1 << 23, 1 << 20
MIX = [(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1, 0xD1B54A32D192ED03 * (i + 7) % (1 << 64)) for i in range(WIDE_WORDS)]
#: A dealt fingerprint.
PRINT = np.dtype([("id", "<i8"), ("print", "<u8", WIDE_WORDS)])


def bits_apart(similarity: float, words: int = WIDE_WORDS, slack: float = SLACK) -> int:
    """Differing bits of wide fingerprints at a Jaccard similarity, with ``slack`` standard deviations."""
    cosine = 2 * similarity / (1 + similarity)
    share = np.arccos(cosine) / np.pi
    return int(64 * words * share + slack * np.sqrt(64 * words * share * (1 - share)))


def bit_chance(similarity: float, least: int, most: int) -> float:
    """The greatest chance that a bit differs at that similarity: of large sets, or exactly where the larger set has least to most shingles."""
    worst = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    for b in range(least, most + 1):
        for a in range(1, b + 1):
            for both in range(a + 1):
                if both >= similarity * (a + b - both):
                    chance = sum(
                        math.comb(both, s) * math.comb(a - both, x) * math.comb(b - both, y)
                        for s in range(both + 1) for x in range(a - both + 1) for y in range(b - both + 1)
                        if (2 * (s + x) > a) != (2 * (s + y) > b)
                    )
                    worst = max(worst, chance / 2.0 ** (a + b - both))
    return float(worst)


def deals(total: int, similarity: float) -> tuple[np.ndarray, int]:
    """Rows of places of bits, and how many rows are for all sets: the others are for sets of SMALL_SET shingles or fewer.

    Fingerprints that agree in the bits of a row meet in a shard of SHARD_ROWS, about. There are as many rows as keep the
    chance that a pair of that similarity never meets at LOST or less, for the number of differing bits as it scatters.
    Rows are cuts of the bits in random orders (seeded), so they share few.
    """
    size, bits = 64 * WIDE_WORDS, max(0, total // SHARD_ROWS).bit_length()
    if not bits:
        return np.zeros((1, 0), np.int64), 1
    apart = np.arange(size + 1)
    log = np.array([math.lgamma(size + 1) - math.lgamma(x + 1) - math.lgamma(size - x + 1) for x in apart])
    agree = np.prod([np.maximum(0, size - apart - i) / (size - i) for i in range(bits)], axis=0)

    def enough(chance: float) -> int:
        weight = np.exp(log + apart * np.log(chance) + (size - apart) * np.log1p(-chance))
        rows = 1
        while (weight * (1 - agree) ** rows).sum() > LOST:
            rows += 1
        return rows

    common = enough(bit_chance(similarity, SMALL_SET + 1, 20))
    rows = max(common, enough(bit_chance(similarity, 1, SMALL_SET)))
    rng = np.random.default_rng(SEED)
    cut = [rng.permutation(size)[: size // bits * bits].reshape(-1, bits) for _ in range(-(-rows // (size // bits)))]
    return np.concatenate(cut)[:rows], common


def mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    x = (hashes ^ np.uint64(MIX[i][1])) * np.uint64(MIX[i][0])
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def wide_prints(texts: list[str], size: int) -> tuple[np.ndarray, list[int]]:
    """Fingerprints (rows of WIDE_WORDS words) and sizes of the sets of shingles."""
    prints, sizes = np.zeros((len(texts), WIDE_WORDS), np.uint64), []
    held: list[np.ndarray] = []
    rows: list[int] = []

    def settle() -> None:
        if not rows:
            return
        hashes, starts = np.concatenate(held), np.cumsum([0] + [len(x) for x in held[:-1]])
        for w in range(WIDE_WORDS):
            prints[rows, w] = majority(mixed(hashes, w), starts)
        held.clear(), rows.clear()

    count = 0
    for i, text in enumerate(texts):
        found = np.unique(np.array(shingle_hashes(text, size) or [0], np.uint64))
        rows.append(i), held.append(found), sizes.append(len(found))
        count += len(found)
        if count >= HASHES_AT_ONCE // 4:
            settle()
            count = 0
    settle()
    return prints, sizes


def similar_links(prints: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that, taken together, join all fingerprints (columns id, print, size) of texts of that similarity.

    Each deal sends a fingerprint to one shard; vantage-point trees search in the shards, with the whole fingerprints.
    Fingerprints travel in packets, many to a row.
    """
    total = prints.count()
    (places, common), reach, hint = deals(total, similarity), bits_apart(similarity), bits_apart(similarity, 2, SLACK_OF_TWO)
    rows_of, bits = places.shape

    def packets(rows: np.ndarray, small: np.ndarray) -> Iterator[pa.RecordBatch]:
        flat = np.ascontiguousarray(rows["print"])
        for i in range(rows_of):
            if i == common:
                rows, flat = rows[small], flat[small]
            own = np.zeros(len(rows), np.int64)
            for at in places[i].tolist():
                own = own << 1 | (flat[:, at // 64] >> np.uint64(at % 64) & np.uint64(1)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            own, dealt = own[order], rows[order]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            data = [dealt[j:k].tobytes() for j, k in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(i << bits | own[starts], pa.int64()), pa.array(data, pa.binary())], names=["shard", "data"])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, small, count = [], [], 0
        for batch in batches:
            rows = np.zeros(len(batch), PRINT)
            rows["id"] = batch.column(0).to_numpy()
            rows["print"] = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(len(batch), -1)
            held.append(rows), small.append(batch.column(2).to_numpy() <= SMALL_SET)
            count += len(rows)
            if count >= DEALT_AT_ONCE:
                yield from packets(np.concatenate(held), np.concatenate(small))
                held, small, count = [], [], 0
        if count:
            yield from packets(np.concatenate(held), np.concatenate(small))

    def link(shard: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(shard["data"].to_pylist()), PRINT)
        points = np.ascontiguousarray(rows["print"])
        a, b = shard_links(points, np.ones(len(points), bool), reach, hint)
        return pa.table({"a": rows["id"][a], "b": rows["id"][b]})

    dealt = prints.select("id", "print", "size").mapInArrow(lean(deal), "shard long, data binary")
    tasks = max(parts(prints), total * rows_of * PRINT.itemsize // DEALT_BYTES)
    return dealt.repartition(tasks, "shard").groupBy("shard").applyInArrow(link, "a long, b long")


def shared_counts(own: np.ndarray, sets: np.ndarray, starts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many hashes of ``own`` (in order) each of the other sets has; set i is sets[starts[i] : starts[i + 1]]."""
    out = np.zeros(len(others), np.int64)
    ends = np.cumsum(starts[others + 1] - starts[others])
    i = 0
    while i < len(others):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HASHES_COMPARED, "right")))
        some = np.concatenate([sets[starts[x] : starts[x + 1]] for x in others[i:j]])
        at = np.minimum(np.searchsorted(own, some), len(own) - 1)
        sizes = starts[others[i:j] + 1] - starts[others[i:j]]
        out[i:j] = np.add.reduceat(own[at] == some, np.cumsum(sizes) - sizes, dtype=np.int64)
        i = j
    return out


def exact_groups(sets: np.ndarray, starts: np.ndarray, points: np.ndarray, similarity: float, reach: int) -> np.ndarray:
    """For each text of a proposed group the first text of its group of links of ``similarity`` or more, counted exactly."""
    sizes = np.diff(starts)
    first = np.arange(len(points))
    left = np.arange(len(points))
    while len(left) > 1:
        lead, left = left[0], left[1:]
        todo = [lead]
        while todo and len(left):
            own = todo.pop()
            near = np.bitwise_count(points[left] ^ points[own]).sum(1, dtype=np.int32) <= reach
            near &= np.minimum(sizes[left], sizes[own]) / np.maximum(sizes[left], sizes[own]) >= similarity
            near = np.flatnonzero(near)
            shared = shared_counts(sets[starts[own] : starts[own + 1]], sets, starts, left[near])
            joined = near[shared / (sizes[left[near]] + sizes[own] - shared) >= similarity]
            first[left[joined]] = lead
            todo += left[joined].tolist()
            left = np.delete(left, joined)
    return first


def exact_links(texts: DataFrame, proposed: DataFrame, shingle: int, similarity: float, reach: int) -> DataFrame:
    """node, root for every text with a link of ``similarity`` or more; texts: k, text; proposed: k, print and root of a proposed group.

    The texts of a proposed group meet once in one task, which makes their sets of shingles.
    """

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, names, points, sizes, held, count, file = None, [], [], [], [], 0, None

        def settle() -> pa.RecordBatch:
            sets = np.concatenate(held) if held else np.zeros(0, np.uint64)
            if file:
                file.write(sets.tobytes())
                file.flush()
                sets = np.memmap(file, np.uint64, "r")
            words, starts = np.frombuffer(b"".join(points), np.uint64).reshape(len(points), -1), np.cumsum([0, *sizes])
            first = exact_groups(sets, starts, words, similarity, reach)
            linked = np.flatnonzero(first != np.arange(len(first))).tolist()
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in linked], pa.binary()), pa.array([names[first[i]] for i in linked], pa.binary())], names=["node", "root"])

        for batch in batches:
            for group, k, point, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if group != root:
                    if len(names) > 1:
                        yield settle()
                    if file:
                        file.close()
                    root, names, points, sizes, held, count, file = group, [], [], [], [], 0, None
                if names and names[-1] == k:
                    continue
                found = np.unique(np.array(shingle_hashes(text, shingle) or [0], np.uint64))
                names.append(k), points.append(point), sizes.append(len(found)), held.append(found)
                count += len(found)
                if count > HASHES_HELD:
                    file = file or tempfile.TemporaryFile()
                    file.write(np.concatenate(held).tobytes())
                    held, count = [], 0
        if len(names) > 1:
            yield settle()
        if file:
            file.close()

    rows = texts.join(few(proposed), "k").select("root", "k", "print", "text")
    return rows.repartition(parts(texts), "root").sortWithinPartitions("root", "k").mapInArrow(lean(link), "node binary, root binary")


def near_deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, for each group of texts that links of ``similarity`` or more join: the smallest doc_id.

    Similarity is the Jaccard similarity of sets of shingles, counted exactly. At 0.8 and 64 bits, near texts are 10 bits
    apart and others 32 with a deviation of 4, so fingerprints are wide (512 bits) and near ones need not agree in any of
    a few cuts. Many cuts (see deals) therefore deal them to shards, and vantage-point trees search in the shards, with
    SLACK deviations as their reach. The links propose groups; the sets of a proposed group's texts decide its links. Of
    texts that are equal but for doc_id one stays; repeated rows count as one text and stay or go together; texts without
    words are one group.
    """

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes = wide_prints(batch.column(2).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in prints], pa.binary()), pa.array(sizes, pa.int32())], names=["doc_id", "k", "print", "size"])

    ready(docs.sparkSession)
    own = {"doc_id": F.col(id_col).cast("long"), "k": digest128(whole(text_col))}
    rows = docs.select(*[x.alias(n) for n, x in own.items()], whole(text_col).alias("text")).mapInArrow(lean(apply), "doc_id long, k binary, print binary, size int")
    rows = stored(rows, "prints")
    distinct = stored(rows.select("k", "print", "size").dropDuplicates(["k"]).select(F.monotonically_increasing_id().alias("id"), "k", "print", "size"), "distinct")
    reach = bits_apart(similarity)
    proposed = components(similar_links(distinct, similarity))
    roots = proposed.unionByName(proposed.select(F.col("root").alias("node"), "root").distinct())
    proposed = stored(distinct.join(roots, F.col("id") == F.col("node")).select("k", "print", "root"), "proposed")
    links = exact_links(docs.select(own["k"].alias("k"), whole(text_col).alias("text")), proposed, shingle, similarity, reach)
    grouped = stored(rows.select("doc_id", "k").join(links, F.col("k") == F.col("node"), "left").select("doc_id", "k", F.coalesce("root", "k").alias("root")), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k")
    first = grouped.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    dropped = split_join(grouped, stored(first, "first"), ["root"], "rows").filter(order != F.col("first")).select("doc_id", "k")
    return without(docs, dropped, own)

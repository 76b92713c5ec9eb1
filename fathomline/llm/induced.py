"""External induced sorting: suffix order and common prefixes of a text, with queues on disk.

The text's S* suffixes (those smaller than their right neighbour and right of a greater one) are named by the substring
up to the next S* place and sorted by repeated naming of neighbouring names. All other suffixes are induced: the L
suffixes in ascending order of their first symbols, then the S suffixes in descending order. A queue entry is a suffix
with the common prefix it has with the entry before it; a suffix that is taken out induces its left neighbour, whose
common prefix is one more than the least on the way from the last suffix that went to the same queue.

As entries for a symbol arrive in their final order, the priority queue is one first-in-first-out queue a symbol. Queues
beyond a limit, and all sorted L suffixes, are in an unnamed file that goes with the task. In memory are the text, a bit
for each suffix, the S* suffixes and what one symbol's suffixes take.
"""

from __future__ import annotations

import tempfile

import numpy as np

SYMBOLS = 256
#: Common prefixes are exact below this and cut off there, unless told otherwise; they can't be told apart beyond the second.
DEPTH, DEEPEST = 255, 32_000


class Spool:
    """Pairs of arrays (suffixes, common prefixes) in an unnamed file; a place tells where a pair is."""

    def __init__(self):
        self.file, self.at = None, 0

    def put(self, suffixes: np.ndarray, shared: np.ndarray) -> tuple[int, int]:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="queues-")
        place = (self.at, len(suffixes))
        self.file.seek(self.at)
        self.file.write(suffixes.astype(np.int64).tobytes())
        self.file.write(shared.astype(np.int16).tobytes())
        self.at += 10 * len(suffixes)
        return place

    def get(self, place: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at, n = place
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(2 * n), np.int16)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


class Queues:
    """A first-in-first-out queue of (suffix, common prefix) for each symbol; beyond ``limit`` entries on disk."""

    def __init__(self, limit: int):
        self.parts: list[list] = [[] for _ in range(SYMBOLS)]
        self.stored: list[list] = [[] for _ in range(SYMBOLS)]
        self.limit, self.held, self.spool, self.spills = limit, 0, Spool(), 0

    def put(self, symbol: int, suffixes: np.ndarray, shared: np.ndarray) -> None:
        self.parts[symbol].append((suffixes, shared))
        self.held += len(suffixes)
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        for own, done in zip(self.parts, self.stored, strict=True):
            if own:
                done.append(self.spool.put(np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])))
                own.clear()
        self.held, self.spills = 0, self.spills + 1

    def take(self, symbol: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The parts that the queue has now; it is empty afterwards."""
        done, own = self.stored[symbol], self.parts[symbol]
        self.stored[symbol], self.parts[symbol] = [], []
        self.held -= sum(len(x) for x, _ in own)
        return [self.spool.get(x) for x in done] + own

    def close(self) -> None:
        self.spool.close()


def words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight symbols from each place, as big-endian numbers (text has eight symbols after the last place)."""
    return np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))[at].astype(np.uint64)


def shared_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, most: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to ``most`` each (and to ``depth``)."""
    most = np.minimum(most, depth)
    out = most.copy()
    active, done = np.arange(len(left)), 0
    while len(active) and done < depth:
        differ = words_at(text, left[active] + done) ^ words_at(text, right[active] + done)
        apart = differ != 0
        zeros = sum((differ[apart] < np.uint64(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
        ended = active[apart]
        out[ended] = np.minimum(out[ended], done + zeros)
        active, done = active[~apart], done + 8
        active = active[most[active] > done]
    return out


def types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than their right neighbour. Symbol 0 ends a string and is S."""
    change = np.flatnonzero(text[:-1] != text[1:])
    runs = np.diff(np.append(np.append(-1, change), len(text) - 1))
    smaller = np.append(text[change] < text[change + 1], True)
    out = np.repeat(smaller, runs)
    out[text == 0] = True
    return out


def star_order(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """The S* places in order of their suffixes. Names of substrings come first, then names of pairs of names."""
    n = len(stars)
    ends = np.append(stars[1:], stars[-1])  # a substring goes to the next S* place; one that begins with 0 is that alone
    size = np.where(text[stars] == 0, 1, ends - stars + 1)
    order, group, at = np.arange(n), np.zeros(n, np.int64), 0
    active = np.arange(n)
    rank = np.zeros(n, np.int64)
    while len(active):  # eight symbols at a time; a symbol after the end counts as greatest
        word = words_at(text, stars[active] + at)
        over = np.clip(at + 8 - size[active], 0, 8)
        word |= np.where(over >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * over.clip(0, 7)).astype(np.uint64)) - np.uint64(1))
        own = np.lexsort((word, rank[active]))
        active, word = active[own], word[own]
        new = np.ones(len(active), bool)
        new[1:] = (rank[active][1:] != rank[active][:-1]) | (word[1:] != word[:-1])
        # within each old group, ranks go up by the number of rows before
        start = np.maximum.accumulate(np.where(np.append(True, rank[active][1:] != rank[active][:-1]), np.arange(len(active)), 0))
        first = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
        rank[active] = rank[active] + (first - start)
        at += 8
        active = active[size[active] >= at]  # one that ends here still has to go after those that go on
        if len(active):
            active = active[np.argsort(rank[active], kind="stable")]
    ended = text[stars] == 0
    low = np.flatnonzero(ended)
    rank[low] = np.arange(len(low)) + rank[low].min() if len(low) else 0  # ends of strings differ: by their place
    step = 1
    follow = np.append(np.arange(1, n), n - 1)
    open_rows = np.arange(n)
    while step <= n:
        tied = open_rows[np.argsort(rank[open_rows], kind="stable")]
        same = np.flatnonzero(rank[tied][1:] == rank[tied][:-1])
        keep = np.zeros(len(tied), bool)
        keep[same] = keep[same + 1] = True
        open_rows = tied[keep]
        if not len(open_rows):
            break
        beyond = rank[np.minimum(open_rows + step, n - 1)]
        own = np.lexsort((beyond, rank[open_rows]))
        rows, second = open_rows[own], beyond[own]
        head = rank[rows]
        place = np.arange(len(rows))
        start = np.maximum.accumulate(np.where(np.append(True, head[1:] != head[:-1]), place, 0))
        first = np.maximum.accumulate(np.where(np.append(True, (head[1:] != head[:-1]) | (second[1:] != second[:-1])), place, 0))
        rank[rows] = head + (first - start)
        step *= 2
    return stars[np.argsort(rank, kind="stable")]


class Inducer:
    """One direction of induction; running minima say what two suffixes in one queue have in common."""

    def __init__(self, text: np.ndarray, small: np.ndarray, rising: bool, limit: int, depth: int):
        self.text, self.small, self.rising, self.depth = text, small, rising, depth
        self.queues = Queues(limit)
        self.least = np.full(SYMBOLS, -1, np.int32)  # of the common prefixes since the last suffix in a queue; -1: none yet

    def induce(self, suffixes: np.ndarray, shared: np.ndarray) -> None:
        """Takes suffixes in order with the common prefix of each and the one before it."""
        seen = self.least >= 0
        left = suffixes - 1
        symbols = self.text[np.maximum(left, 0)]
        wanted = (suffixes > 0) & (self.small[np.maximum(left, 0)] != self.rising) & (symbols > 0)
        rows = np.flatnonzero(wanted)
        low = int(shared.min()) if len(shared) else self.depth
        if not len(rows):
            self.least[seen] = np.minimum(self.least[seen], low)
            return
        kinds = symbols[rows]
        order = np.argsort(kinds, kind="stable")
        rows, kinds = rows[order], kinds[order]
        bounds = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
        between = range_least(shared, rows, bounds, self.depth)
        targets = kinds[bounds]
        first = np.minimum.accumulate(shared)[rows[bounds]]
        between[bounds] = np.where(self.least[targets] >= 0, np.minimum(self.least[targets], first), -1)
        after = np.minimum.accumulate(shared[::-1])[::-1]
        last = rows[np.append(bounds[1:], len(rows)) - 1]
        self.least[seen] = np.minimum(self.least[seen], low)
        self.least[targets] = np.where(last + 1 < len(shared), after[np.minimum(last + 1, len(shared) - 1)], self.depth)
        own = np.where(between < 0, 0, np.minimum(between + 1, self.depth)).astype(np.int16)
        ends = np.append(bounds[1:], len(rows))
        for symbol, i, j in zip(targets.tolist(), bounds.tolist(), ends.tolist(), strict=True):
            self.queues.put(symbol, left[rows[i:j]], own[i:j])


def range_least(shared: np.ndarray, rows: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """For each row after another one of its kind: the least of shared from just after that one to itself."""
    out = np.zeros(len(rows), np.int32)
    inner = np.ones(len(rows), bool)
    inner[bounds] = False
    here = np.flatnonzero(inner)
    if len(here):
        pairs = np.empty(2 * len(here), np.int64)
        pairs[0::2], pairs[1::2] = rows[here - 1] + 1, rows[here] + 1
        padded = np.append(shared, depth)
        out[here] = np.minimum.reduceat(padded, pairs)[0::2]
    return out


def sorted_suffixes(text: np.ndarray, limit: int = 1 << 24, depth: int = DEPTH, spills: list | None = None):
    """Yields (suffixes, common prefix of each with the one before) in descending order of the suffixes' first symbols.

    text: uint8 strings, each ended by 0, and eight further zeros; symbols are below 255. Within a yield the order is
    ascending; suffixes that begin with 0 are left out. spills: gets how often the queues went to disk.
    """
    if depth > DEEPEST:
        raise ValueError(f"common prefixes are known up to {DEEPEST} symbols")
    small = types(text)
    small[len(text) - 8 :] = True
    body = text[: len(text) - 8]
    n = len(body)
    star = np.zeros(n, bool)
    star[1:] = small[1:n] & ~small[: n - 1]
    star |= body == 0
    star[0] |= body[0] == 0
    stars = np.flatnonzero(star)
    to_end = stars_to_end(body)
    order = star_order(text, stars)
    shared = np.zeros(len(order), np.int32)
    shared[1:] = shared_prefixes(text, order[:-1], order[1:], np.minimum(to_end[order[:-1]], to_end[order[1:]]), depth)
    firsts = np.searchsorted(text[order], np.arange(SYMBOLS + 1))
    rising = Inducer(body, small[:n], True, limit, depth)
    larger, kept = {}, Spool()
    for symbol in range(SYMBOLS):
        parts, edge = [], None
        while taken := rising.queues.take(symbol):
            for suffixes, common in taken:
                rising.induce(suffixes, common.astype(np.int32))
                parts.append(kept.put(suffixes, common))
                edge = suffixes[-1]
        i, j = firsts[symbol], firsts[symbol + 1]
        if i < j:
            own = shared[i:j].copy()
            own[0] = meet(text, to_end, edge, order[i], depth)
            rising.induce(order[i:j], own)
        if parts:
            larger[symbol] = parts
    rising.queues.close()
    falling = Inducer(body, small[:n], False, limit, depth)
    for symbol in range(SYMBOLS - 1, 0, -1):
        parts, edge = [], None
        # entries have their common prefix with the entry before, which is the greater one here
        while taken := falling.queues.take(symbol):
            for suffixes, common in taken:
                falling.induce(suffixes, common.astype(np.int32))
                parts.append((suffixes, common))
                edge = suffixes[-1]
        if symbol in larger:
            own = [kept.get(x) for x in larger[symbol]]
            up, common = np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own]).astype(np.int32)
            common[0] = 0
            down = np.append(common[1:], 0)[::-1].copy()  # with the next greater one
            joint = meet(text, to_end, edge, up[-1], depth)
            down[0] = joint
            falling.induce(up[::-1], down)
        else:
            up, common, joint = np.zeros(0, np.int64), np.zeros(0, np.int32), 0
        if parts:
            s_down = np.concatenate([x for x, _ in parts])
            s_common = np.concatenate([x for _, x in parts]).astype(np.int32)
            s_up = np.append(s_common[1:], 0)[::-1].copy()  # with the next smaller one
            s_up[0] = joint
            up, common = np.concatenate([up, s_down[::-1]]), np.concatenate([common, s_up])
        if len(up):
            yield up, common
        larger.pop(symbol, None)
    # symbol 0: ends of strings induce S suffixes of no symbol; nothing is left
    falling.queues.close()
    kept.close()
    if spills is not None:
        spills.append(rising.queues.spills + falling.queues.spills)


def stars_to_end(body: np.ndarray) -> np.ndarray:
    """From each place, the number of symbols before the next 0."""
    ends = np.flatnonzero(body == 0)
    return ends[np.searchsorted(ends, np.arange(len(body)))] - np.arange(len(body))


def meet(text: np.ndarray, to_end: np.ndarray, a: int | None, b: int, depth: int) -> int:
    if a is None:
        return 0
    x, y = np.array([a]), np.array([b])
    return int(shared_prefixes(text, x, y, np.minimum(to_end[x], to_end[y]), depth)[0])

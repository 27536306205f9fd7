"""Repeated byte strings over a whole corpus by longest-previous-factor arrays.

A string of L bytes repeats when it starts at two places.  The suffixes that can match are first brought
together, then each gathering is put in suffix order:

1. Anchors.  Of each window of L bytes the smallest hash among its k-byte strings is the anchor, the
   leftmost of equals.  Equal windows have equal anchors at equal places, so every window is judged once,
   with its anchor.  Neighbouring windows mostly share theirs: a run, whose bytes are its context.
2. Tasks count their anchors and add up, with a 64-bit hash of the context as long as an anchor has but one; blocks
   ask about theirs.  A window whose anchor is met once repeats nothing; one whose anchor always has the same
   context repeats.
3. Contexts of other shared anchors travel as bytes, each distinct one once a task, to their anchor's part.  There
   an anchor's contexts are put in suffix order.  Previous and next smaller positions in that order hold each
   window's longest previous factor; one of L bytes or more is a repeat, and so is what it repeats.
   Anchors that occur more than `crowd` times are not gathered: their windows are told apart by 96-bit
   hashes and counted like any keys, so a passage in a third of all documents stays spread.
4. Blocks ask for the bits of their contexts' windows, and for the counts of their crowded windows.

Judgements are on the input, and matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import block_rows, blocks, texts_of, with_text
from .common import arrow_map, new_table, shuffle_width, split_by, written
from .lookups import ROW, answered, first_ones, gathered, lookups, range_of, ranges_for, route, rows_of

_RANDOM = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Positions of a slice must fit the low bits of its keys.
_LOW = np.uint64((1 << 20) - 1)
_SLICE = 1 << 19

#: What a block learns of its anchors: met once in the corpus, shared by a few windows' runs, by a crowd of them, or always
#: in the same context.
ONCE, SHARED, CROWDED, EQUAL = 0, 1, 2, 3
#: Bytes of contexts that a task sends at once, and that are put in suffix order at once.
SHOWN, AT_ONCE = 32 << 20, 2 << 20


# --- anchors ------------------------------------------------------------------------------------------


def gram_hashes(data: bytes, k: int) -> np.ndarray:
    """A hash of each k-byte string; k is a power of two."""
    x, width, base = _RANDOM[np.frombuffer(data, np.uint8)], 1, _BASE
    while width < k:
        x = x[:-width] * np.uint64(base) + x[width:]
        base, width = base * base % 2**64, 2 * width
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def anchors(data: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each run of windows with one anchor.

    Runs that a slice of a very long text cuts in two have contexts of their own and stay exact: windows are
    compared one by one wherever contexts differ.
    """
    parts, windows = [], len(data) - length + 1
    for at in range(0, max(0, windows), _SLICE):
        some = data[at : at + _SLICE + length - 1]
        x = gram_hashes(some, k)
        least, width, wide = (x & ~_LOW) | np.arange(len(x), dtype=np.uint64), 1, length - k + 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < wide:
            least = np.minimum(least[: width - wide], least[wide - width :])
        place = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.concatenate((first[1:], [len(place)])) - 1
        parts.append((x[place[first]], place[first] + at, first + at, last + at))
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


@dataclass
class Runs:
    """A block's distinct texts, and the runs of windows in them."""

    texts: list[bytes]
    owners: list[list[int]]  # the documents of each text
    text: np.ndarray  # of each run
    key: np.ndarray  # the anchor's hash, mixed
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray
    weight: np.ndarray  # documents that have the run

    @property
    def windows(self) -> np.ndarray:
        return self.last - self.first + 1


def runs_of(texts: list[bytes], length: int, k: int) -> Runs:
    owners: dict[bytes, list[int]] = {}
    for i, text in enumerate(texts):
        owners.setdefault(text, []).append(i)
    found = [anchors(text, length, k) for text in owners]
    hashes, place, first, last = (np.concatenate([np.zeros(0, t), *c]) for t, c in zip((np.uint64, *[np.int64] * 3), zip(*found, strict=True) if found else [()] * 4, strict=True))
    sizes = [len(f[0]) for f in found]
    weight = np.repeat(np.array([len(own) for own in owners.values()], np.int64), sizes)
    # An anchor is a smallest hash; multiplied, its high bits are even again.
    return Runs(list(owners), list(owners.values()), np.repeat(np.arange(len(found)), sizes), hashes * np.uint64(_BASE), place, first, last, weight)


@dataclass
class Contexts:
    """The distinct contexts of some of a block's runs, in the order of their 96-bit keys."""

    runs: np.ndarray
    entry: np.ndarray  # of each of these runs
    earliest: np.ndarray  # run of each context
    high: np.ndarray
    low: np.ndarray
    times: np.ndarray  # 2 for more


def contexts_of(r: Runs, runs: np.ndarray, length: int) -> Contexts:
    from xxhash import xxh3_128_digest

    rows = zip(r.text[runs].tolist(), r.place[runs].tolist(), r.first[runs].tolist(), r.last[runs].tolist(), strict=True)
    flat = np.frombuffer(b"".join(xxh3_128_digest(r.texts[t][a : b + length], p - a) for t, p, a, b in rows), "<u8").reshape(-1, 2)
    high, low = flat[:, 0].copy(), flat[:, 1].astype(np.uint32)
    order = np.lexsort((low, high))
    heads = first_ones(high[order], low[order])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    times = np.add.reduceat(r.weight[runs][order], heads) if len(heads) else np.zeros(0, np.int64)
    # lexsort is stable, so the first run of a context in this order is its earliest.
    return Contexts(runs, entry, runs[order[heads]], high[order[heads]], low[order[heads]], np.minimum(times, 2).astype(np.uint8))


def context_bytes(r: Runs, runs: np.ndarray, length: int) -> list[bytes]:
    return [r.texts[t][a : b + length] for t, a, b in zip(r.text[runs].tolist(), r.first[runs].tolist(), r.last[runs].tolist(), strict=True)]


def window_keys(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    from xxhash import xxh3_128_digest

    flat = np.frombuffer(b"".join(xxh3_128_digest(c[i : i + length]) for c in contexts for i in range(len(c) - length + 1)), "<u8").reshape(-1, 2)
    return flat[:, 0].copy(), flat[:, 1].astype(np.uint32)


# --- suffix order -------------------------------------------------------------------------------------


def prefix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(width, ranks): each position's string of that width in byte order, cut where the data end, by doubling up to
    `length`, the last one's width."""
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    x = np.zeros(len(data) + length, np.uint64)
    for i in range(8):
        x |= padded[i : i + len(x)].astype(np.uint64) << np.uint64(8 * (7 - i))
    if length < 8:
        x >>= np.uint64(8 * (8 - length))
    rank, width = np.unique(x, return_inverse=True)[1].astype(np.int64), min(8, length)
    out = [(width, rank[: len(data)].astype(np.int32))]
    while width < length:
        step = min(width, length - width)
        beyond = np.zeros(len(rank), np.int64)
        beyond[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (rank.max() + 1) + beyond, return_inverse=True)[1].astype(np.int64)
        width += step
        out.append((width, rank[: len(data)].astype(np.int32)))
    return out


def smaller_neighbours(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in suffix order: where the previous and the next one with a smaller place stand, or -1."""

    def previous(place: np.ndarray) -> np.ndarray:
        at = np.arange(len(place)) - 1
        wrong = np.flatnonzero((at >= 0) & (place[at] > place))
        for _ in range(8):
            # Everything between a suffix and its own candidate stands later in the text, so candidates may be followed.
            at[wrong] = at[at[wrong]]
            wrong = wrong[(at[wrong] >= 0) & (place[at[wrong]] > place[wrong])]
            if not len(wrong):
                return at
        at[wrong] = last_smaller(place, wrong)
        return at

    before = previous(place)
    after = previous(place[::-1])[::-1]
    return before, np.where(after >= 0, len(place) - 1 - after, -1)


def last_smaller(place: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For some positions the last one before with a smaller value, or -1: up a tree of block minima and down again, so
    that no order of places takes longer than another."""
    levels = [place]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append(np.minimum.reduceat(below, np.arange(0, len(below), 2)))
    value, at, height = place[wanted], wanted.copy(), np.full(len(wanted), -1)
    for h, level in enumerate(levels):
        beside = (height < 0) & (at % 2 == 1)
        found = np.flatnonzero(beside)
        found = found[level[at[found] - 1] < value[found]]
        height[found] = h
        at[found] -= 1
        at[height < 0] >>= 1
    for h in range(len(levels) - 1, 0, -1):
        own = np.flatnonzero(height == h)
        right = np.minimum(2 * at[own] + 1, len(levels[h - 1]) - 1)
        at[own] = np.where(levels[h - 1][right] < value[own], right, 2 * at[own])
        height[own] = h - 1
    return np.where(height < 0, -1, at)


def longest_previous_factors(data: np.ndarray, windows: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows (start positions in data, at least `length` bytes from its end; places order them in the corpus): how many
    bytes, up to `length`, its longest earlier match has, and which window that is (-1: none)."""
    ranks = prefix_ranks(data, length)
    rank = ranks[-1][1][windows]
    # Suffix order: by the windows' bytes, then by what follows (places serve where that is equal).
    order = np.lexsort((place, rank))
    best, source = np.zeros(len(windows), np.int64), np.full(len(windows), -1, np.int64)
    for near in smaller_neighbours(place[order]):
        has = near >= 0
        own, other = order[has], order[near[has]]
        common = common_bytes(data, ranks, windows[own], windows[other], length)
        more = common > best[own]
        best[own[more]], source[own[more]] = common[more], other[more]
    return best, source


def common_bytes(data: np.ndarray, ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, up to `length`, the strings at a and at b share, by their ranks from the widest to the narrowest."""
    out = np.where(ranks[-1][1][a] == ranks[-1][1][b], length, 0)
    left = np.flatnonzero(out == 0)
    i, j = a[left], b[left]
    # Each width is over half of the next, so what is left to find is under twice a width when its turn comes.
    for width, rank in reversed(ranks[:-1]):
        same = (out[left] + width <= length) & (rank[np.minimum(i, len(rank) - 1)] == rank[np.minimum(j, len(rank) - 1)])
        out[left[same]] += width
        i, j = np.where(same, i + width, i), np.where(same, j + width, j)
    for _ in range(ranks[0][0]):
        same = (out[left] < length) & (np.maximum(i, j) < len(data))
        same[same] = data[i[same]] == data[j[same]]
        out[left[same]] += 1
        left, i, j = left[same], i[same] + 1, j[same] + 1
    return out


def repeated_windows(data: np.ndarray, windows: np.ndarray, place: np.ndarray, length: int, earlier_only: bool = False) -> np.ndarray:
    """Which windows equal another one: those whose longest previous factor has `length` bytes and, unless only later
    copies are asked for, the sources of these."""
    best, source = longest_previous_factors(data, windows, place, length)
    matched = best >= length
    if not earlier_only:
        matched[source[best >= length]] = True
    return matched


# --- passes -------------------------------------------------------------------------------------------

KIND = "kind string, block long, part int, a binary, b binary, c binary, d binary, e binary"


def _rows(kind: str, found: list[tuple]) -> pa.RecordBatch:
    """Rows (block, part, a, b, c, d, e) of one kind."""
    rows = [(kind, *r) for r in found]
    kinds = (pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=[c.split()[0] for c in KIND.split(", ")])


def _kinds(df: DataFrame, function, name: str):
    """The rows that a pass makes, written by kind; a function that gives those of one kind."""
    spark, path = df.sparkSession, new_table(df.sparkSession, name)
    arrow_map(df, function, KIND).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    found = spark.read.schema(KIND).parquet(path)
    return lambda kind: found.where(F.col("kind") == kind)


class Counts:
    """Keys (64 bits, and 32 more) with what a task has counted, and the least and the greatest of a number that comes with
    each."""

    KINDS = (np.uint64, np.uint32, np.int64, np.int64, np.int64)

    def __init__(self, most: int = 1 << 20) -> None:
        self.most, self.parts, self.held = most, [], 0

    def add(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> None:
        self.parts.append((high, low, counts, least, greatest))
        self.held += len(high)
        if self.held > self.most:
            merged = self.merged()
            # Kept keys weigh half, so that a growing table is not merged for every block.
            self.parts, self.held = [merged], len(merged[0]) // 2 if len(merged[0]) < self.most else 0

    def merged(self) -> tuple[np.ndarray, ...]:
        high, low, counts, least, greatest = (np.concatenate([np.zeros(0, t), *(p[j] for p in self.parts)]) for j, t in enumerate(self.KINDS))
        order = np.lexsort((low, high))
        heads = first_ones(high[order], low[order])
        if not len(heads):
            return high, low, counts, least, greatest
        sums = (f.reduceat(x[order], heads) for f, x in ((np.add, counts), (np.minimum, least), (np.maximum, greatest)))
        return high[order[heads]], low[order[heads]], *sums


def _survey(length: int, k: int, width: int):
    """What each block asks (its anchors), and how often a task's texts have each anchor and in which context, if but one."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        counts = Counts()
        for batch in batches:
            for number, _, ends, _, body in block_rows(batch):
                r = runs_of(texts_of(ends, body), length, k)
                rows = zip(r.text.tolist(), r.place.tolist(), r.first.tolist(), r.last.tolist(), strict=True)
                context = np.fromiter((xxh64_intdigest(r.texts[t][a : b + length], p - a) for t, p, a, b in rows), np.uint64, len(r.key)).view(np.int64)
                own = Counts()
                own.add(r.key, np.zeros(len(r.key), np.uint32), r.weight, context, context)
                found = own.merged()
                counts.add(*found)
                yield _rows("ask", [(number, None, found[0].tobytes(), None, None, None, None)])
        high, _, times, least, greatest = counts.merged()
        parts = split_by(range_of(high, width))
        yield _rows("count", [(None, p, high[own].tobytes(), None, times[own].tobytes(), least[own].tobytes(), np.packbits(least[own] != greatest[own]).tobytes()) for p, own in parts])

    return survey


def _sum(anchors_: bool, all_keys: bool):
    """One row for each part: keys, counts, and the least of what comes with them; without `all_keys` only of those counted
    more than once.  Counts of anchors that have but one context are negative."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches, ["a", "b", "c", "d", "e"]):
            counts = Counts()
            for a, b, c, d, e in rows:
                high, least = np.frombuffer(a, np.uint64), np.frombuffer(d, np.int64)
                low = np.zeros(len(high), np.uint32) if b is None else np.frombuffer(b, np.uint32)
                unlike = np.unpackbits(np.frombuffer(e, np.uint8), count=len(high)).astype(bool) if anchors_ else np.zeros(len(high), bool)
                # Any other number says that contexts differ.
                other = np.where(unlike, least ^ 1, least)
                counts.add(high, low, np.frombuffer(c, np.int64), np.minimum(least, other), np.maximum(least, other))
            high, low, times, least, greatest = counts.merged()
            own = np.flatnonzero(times > (0 if all_keys else 1))
            if anchors_:
                times = np.where(least == greatest, -times, times)
            values = [pa.array([x[own].tobytes()], pa.binary()) for x in (high, low, times, least)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *values, pa.array([len(own)], pa.int64())], names=["part", "a", "b", "c", "d", "keys"])

    return add


def _by_part(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(part, its rows) of batches sorted by part; rows come one at a time and have to be taken before the next part."""
    rows = ((batch.column("part")[k].as_py(), tuple(batch.column(c)[k].as_py() for c in names)) for batch in batches for k in range(batch.num_rows))
    from itertools import groupby

    for part, own in groupby(rows, lambda row: row[0]):
        yield part, (row for _, row in own)


def _show(length: int, k: int, width: int, ranges: int, keep_first: bool):
    """Contexts of shared anchors by anchor, each distinct one once a task; counts of crowded windows; and what blocks ask
    of either."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held, size = Counts(), {}, 0

        def shown() -> pa.RecordBatch:
            keys = list(held)
            anchor = np.array([held[key][0] for key in keys], np.uint64)
            out = []
            for p, own in split_by(range_of(anchor, width)):
                rows = [held[keys[i]] for i in own.tolist()]
                sizes = np.array([len(row[3]) for row in rows], np.int32)
                firsts = np.array([row[2] for row in rows], np.int64)
                out.append((None, p, anchor[own].tobytes(), b"".join(keys[i] for i in own.tolist()), sizes.tobytes() + np.array([row[1] for row in rows], np.uint8).tobytes(), b"".join(row[3] for row in rows), firsts.tobytes() if keep_first else None))
            held.clear()
            return _rows("context", out)

        for batch in batches:
            for i, (number, _, ends, _, body) in enumerate(block_rows(batch)):
                r = runs_of(texts_of(ends, body), length, k)
                state = anchor_state(r, batch.column("anchors")[i].as_py(), ranges)
                e = contexts_of(r, np.flatnonzero(state == SHARED), length)
                yield _rows("ask_context", [(number, None, e.high.tobytes(), e.low.tobytes(), None, None, None)])
                keys = [a.to_bytes(8, "little") + b.to_bytes(4, "little") for a, b in zip(e.high.tolist(), e.low.tolist(), strict=True)]
                for key, anchor, times, run, text in zip(keys, r.key[e.earliest].tolist(), e.times.tolist(), e.earliest.tolist(), context_bytes(r, e.earliest, length), strict=True):
                    old = held.get(key)
                    first = (number, run)
                    held[key] = (anchor, min(2, times + old[1]), min(first, old[2]), text) if old else (anchor, times, first, text)
                    size += 0 if old else len(text) + 200
                if size > SHOWN:
                    yield shown()
                    size = 0
                e = contexts_of(r, np.flatnonzero(state == CROWDED), length)
                if len(e.high):
                    shown_ = context_bytes(r, e.earliest, length)
                    high, low = window_keys(shown_, length)
                    times = np.repeat(e.times.astype(np.int64), [len(c) - length + 1 for c in shown_])
                    own = Counts()
                    own.add(high, low, times, *[np.full(len(high), number)] * 2)
                    high, low, times, firsts, _ = own.merged()
                    windows.add(high, low, times, firsts, firsts)
                    yield _rows("ask_window", [(number, None, high.tobytes(), low.tobytes(), None, None, None)])
        yield shown()
        high, low, times, firsts, _ = windows.merged()
        yield _rows("window", [(None, p, high[own].tobytes(), low[own].tobytes(), times[own].tobytes(), firsts[own].tobytes(), None) for p, own in split_by(range_of(high, width))])

    return show


def anchor_state(r: Runs, answers: list[dict] | None, ranges: int) -> np.ndarray:
    """ONCE, SHARED or CROWDED for each run."""
    keys, at = np.unique(r.key, return_inverse=True)
    return answered(answers, keys, ranges, np.uint8)[:, 0][at.reshape(-1)]


def bit_bytes(length: int, k: int) -> int:
    """Bytes that hold a bit for each window of a run."""
    return -(-(length - k + 1) // 8)


def _compare(length: int, k: int, keep_first: bool):
    """One row for each part: its contexts' keys, the bits of their windows that repeat, and with keep_first the blocks
    that have them first."""
    wide = bit_bytes(length, k)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches, ["a", "b", "c", "d", "e"]):
            held: dict[bytes, list] = {}
            for a, b, c, d, e in rows:
                n = len(a) // 8
                sizes, times = np.frombuffer(c[: 4 * n], np.int32).tolist(), c[4 * n :]
                firsts = np.frombuffer(e, np.int64).reshape(-1, 2).tolist() if keep_first else [None] * n
                at = 0
                for i, (anchor, size, first) in enumerate(zip(np.frombuffer(a, np.uint64).tolist(), sizes, firsts, strict=True)):
                    key = b[12 * i : 12 * i + 12]
                    old = held.get(key)
                    if old is None:
                        held[key] = [anchor, times[i], first, d[at : at + size]]
                    else:
                        old[1] += times[i]
                        old[2] = min(old[2], first) if keep_first else None
                    at += size
            keys = sorted(held, key=lambda key: (held[key][0], held[key][2] or [], key))
            bits = np.zeros((len(keys), wide), np.uint8)
            start = 0
            while start < len(keys):
                end, size = start, 0
                # Whole anchors, for equal windows share theirs.
                while end < len(keys) and (size < AT_ONCE or held[keys[end]][0] == held[keys[end - 1]][0]):
                    size += len(held[keys[end]][3])
                    end += 1
                bits[start:end] = compared([held[key] for key in keys[start:end]], length, wide, keep_first)
                start = end
            first = np.array([held[key][2][0] if keep_first else 0 for key in keys], np.int64)
            values = [pa.array([x], pa.binary()) for x in (b"".join(key[:8] for key in keys), b"".join(key[8:] for key in keys), bits.tobytes(), first.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *values, pa.array([len(keys)], pa.int64())], names=["part", "a", "b", "c", "d", "keys"])

    return compare


def compared(rows: list[list], length: int, wide: int, earlier_only: bool) -> np.ndarray:
    """For rows [anchor, times, first, context] in order of anchor and corpus: packed bits of windows that repeat."""
    anchor = np.array([row[0] for row in rows], np.uint64)
    sizes = np.array([len(row[3]) for row in rows], np.int64)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(rows)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    found = np.zeros(len(owner), bool)
    if not earlier_only:
        found |= (np.array([row[1] for row in rows]) > 1)[owner]
    # An anchor with one context alone has nothing to compare it with.
    alone = np.ones(len(rows), bool)
    alone[1:] &= anchor[1:] != anchor[:-1]
    alone[:-1] &= anchor[1:] != anchor[:-1]
    if not alone.all():
        kept = np.flatnonzero(~alone)
        data = np.frombuffer(b"".join(rows[i][3] for i in kept.tolist()), np.uint8)
        begins = np.zeros(len(rows), np.int64)
        begins[kept] = np.cumsum(sizes[kept]) - sizes[kept]
        own = np.flatnonzero(~alone[owner])
        found[own] |= repeated_windows(data, begins[owner[own]] + inner[own], own, length, earlier_only)
    flat = np.zeros((len(rows), 8 * wide), bool)
    flat[owner, inner] = found
    return np.packbits(flat, axis=1)


def build_table(kind, width: int):
    def build(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, and a row of values for each."""
        high = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r[0], np.uint64) for r in rows)])
        low = np.concatenate([np.zeros(0, np.uint32), *(np.zeros(len(r[0]) // 8, np.uint32) if r[1] is None else np.frombuffer(r[1], np.uint32) for r in rows)])
        values = np.concatenate([np.zeros((0, width), kind), *(np.frombuffer(r[2], kind).reshape(-1, width) for r in rows)])
        order = np.lexsort((low, high))
        return high[order], low[order], values[order]

    return build


def values_of(known: tuple[np.ndarray, np.ndarray, np.ndarray], a: bytes, b: bytes | None) -> np.ndarray:
    """The asked keys' rows of values, zeros for unknown ones."""
    high = np.frombuffer(a, np.uint64)
    low = np.zeros(len(high), np.uint32) if b is None else np.frombuffer(b, np.uint32)
    highs, lows, values = known
    out = np.zeros((len(high), values.shape[1]), values.dtype)
    at = np.searchsorted(highs, high)
    left = np.arange(len(high))
    while len(left):
        left = left[at[left] < len(highs)]
        left = left[highs[at[left]] == high[left]]
        same = lows[at[left]] == low[left]
        out[left[same]] = values[at[left[same]]]
        left = left[~same]
        at[left] += 1
    return out


def marked_starts(r: Runs, state: np.ndarray, e: Contexts, bits: np.ndarray, crowd: Contexts, gone: list[np.ndarray], number: int, length: int, keep_first: bool) -> dict[int, np.ndarray]:
    """By text (of the block's distinct ones): which window starts are to go; texts without any are left out.  bits holds
    a row for each context of e, gone one for each of crowd."""
    out: dict[int, np.ndarray] = {}
    flags = np.unpackbits(bits[:, : bits.shape[1] - 8 * keep_first], axis=1).astype(bool)
    later = bits[:, -8:].copy().view(np.int64)[:, 0] != number if keep_first else np.zeros(len(bits), bool)
    any_flag = flags.any(1) | later
    rows = [(run, flags[k], bool(later[k])) for run, k in zip(e.runs.tolist(), e.entry.tolist(), strict=True) if any_flag[k] or keep_first]
    rows += [(run, gone[k], False) for run, k in zip(crowd.runs.tolist(), crowd.entry.tolist(), strict=True)]
    rows += [(run, None, True) for run in np.flatnonzero(state == EQUAL).tolist()]
    earliest = set(e.earliest.tolist()) | set(crowd.earliest.tolist())
    for run, own, whole in rows:
        first, last, text = int(r.first[run]), int(r.last[run]), int(r.text[run])
        whole |= keep_first and run not in earliest
        if whole or own[: last - first + 1].any():
            marks = out.setdefault(text, np.zeros(len(r.texts[text]) - length + 1, bool))
            marks[first : last + 1] = True if whole else own[: last - first + 1]
    return out


def removed(text: bytes, starts: np.ndarray | None, length: int) -> tuple[int, int, bytes]:
    """Bytes covered by the marked windows, their maximal runs, and what is left."""
    if starts is None or not starts.any():
        return 0, 0, text
    edges = np.zeros(len(text) + 1, np.int32)
    edges[: len(starts)] += starts
    edges[length : length + len(starts)] -= starts
    gone = np.cumsum(edges[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 200,
    keep_first: bool = False,
    gram: int = 64,
    crowd: int = 2048,
    block_bytes: int = 4 << 20,
    with_kept: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) for every row of df.

    Removes each byte covered by a `length`-byte string that also starts anywhere else; with keep_first the
    first copy in the written blocks' order stays.  `gram`, a power of two below `length`, is the anchors'
    size.  Null texts count as empty, and texts shorter than `length` stay whole.  Repeated rows are copies
    of each other like any equal texts.  A text over `block_bytes` is a block's last and is read in slices.  Ids are
    taken as 64-bit integers.  An empty table gives an empty result; other columns are ignored.
    """
    width = shuffle_width(df.sparkSession)
    packed = blocks(with_text(df, id_col, text_col, lambda i: F.lit(True)), block_bytes, width)
    surveyed = _kinds(packed, _survey(length, gram, width), "survey")
    summed = "part int, a binary, b binary, c binary, d binary, keys long"

    def sums(rows: DataFrame, anchors_: bool, all_keys: bool) -> DataFrame:
        dealt = rows.select("part", "a", "b", "c", "d", "e").repartition(width, "part").sortWithinPartitions("part")
        return written(arrow_map(dealt, _sum(anchors_, all_keys), summed))

    def keys_in(table: DataFrame) -> int:
        return table.agg(F.sum("keys").alias("n")).first()["n"] or 0

    def ranged(table: DataFrame, ranges: int, value) -> DataFrame:
        """A table by the lookups' ranges; value makes each key's values of the columns c and d."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    a, b, c, d = (batch.column(j)[k].as_py() for j in range(4))
                    high, low, kept = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32), value(c, np.frombuffer(d, np.int64))
                    yield rows_of([(p, 0, False, None, high[own].tobytes(), low[own].tobytes(), kept[own].tobytes()) for p, own in split_by(range_of(high, ranges))])

        return arrow_map(table.select("a", "b", "c", "d"), cut, ROW)

    look = lambda known, number, a, b: values_of(known, a, b).tobytes()
    anchored = sums(surveyed("count"), True, False)
    ranges, salts = ranges_for(keys_in(anchored), width)

    def state_of(times: bytes, _: np.ndarray) -> np.ndarray:
        n = np.frombuffer(times, np.int64)
        state = np.where(np.abs(n) > crowd, CROWDED, SHARED)
        # Which copy of equal contexts comes first, they have to say themselves.
        return (state if keep_first else np.where(n < 0, EQUAL, state)).astype(np.uint8)

    anchors_ = written(lookups(ranged(anchored, ranges, state_of), route(surveyed("ask"), ranges, salts), salts, build_table(np.uint8, 1), look))
    seen = packed.join(gathered(anchors_, "anchors"), "block", "left")
    shown = _kinds(seen, _show(length, gram, width, ranges, keep_first), "shown")

    wide = bit_bytes(length, gram)
    contexts = shown("context").select("part", "a", "b", "c", "d", "e").repartition(width, "part").sortWithinPartitions("part")
    judged = written(arrow_map(contexts, _compare(length, gram, keep_first), summed))
    parts, copies = ranges_for(keys_in(judged), width)

    def bits_of(bits: bytes, firsts: np.ndarray) -> np.ndarray:
        own = np.frombuffer(bits, np.uint8).reshape(-1, wide)
        return np.concatenate((own, firsts.view(np.uint8).reshape(-1, 8)), axis=1) if keep_first else own

    bit_width = wide + 8 * keep_first
    bits = written(lookups(ranged(judged, parts, bits_of), route(shown("ask_context"), parts, copies), copies, build_table(np.uint8, bit_width), look))

    windowed = sums(shown("window"), False, keep_first)
    window_ranges, window_salts = ranges_for(keys_in(windowed), width)
    kept_first = (lambda times, firsts: firsts + 1) if keep_first else (lambda times, firsts: np.frombuffer(times, np.int64))
    asked = route(shown("ask_window"), window_ranges, window_salts)
    windows = written(lookups(ranged(windowed, window_ranges, kept_first), asked, window_salts, build_table(np.int64, 1), look))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (number, ids, ends, _, body) in enumerate(block_rows(batch)):
                r = runs_of(texts_of(ends, body), length, gram)
                state = anchor_state(r, batch.column("anchors")[i].as_py(), ranges)
                e, many = (contexts_of(r, np.flatnonzero(state == s), length) for s in (SHARED, CROWDED))
                found = answered(batch.column("bits")[i].as_py(), e.high, parts, np.uint8, bit_width)
                gone = crowded_windows(r, many, batch.column("windows")[i].as_py(), window_ranges, number, length, keep_first)
                starts = marked_starts(r, state, e, found, many, gone, number, length, keep_first)
                out = []
                for k, (text, owners) in enumerate(zip(r.texts, r.owners, strict=True)):
                    n_gone, spans, left = removed(text, starts.get(k), length)
                    digest = hashlib.sha256(left).hexdigest()
                    for j, own in enumerate(owners):
                        if keep_first and j and len(text) >= length:
                            n_gone, spans, left, digest = len(text), 1, b"", hashlib.sha256(b"").hexdigest()
                        out.append((ids[own], len(text), n_gone, spans, digest, left if with_kept else None))
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = seen.join(gathered(bits, "bits"), "block", "left").join(gathered(windows, "windows"), "block", "left")
    done = arrow_map(joined, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_kept else done.drop("kept")


def crowded_windows(r: Runs, e: Contexts, answers: list[dict] | None, ranges: int, number: int, length: int, keep_first: bool) -> list[np.ndarray]:
    """For each context of crowded anchors: which of its windows are to go."""
    if not len(e.high):
        return []
    shown = context_bytes(r, e.earliest, length)
    sizes = [len(c) - length + 1 for c in shown]
    high, low = window_keys(shown, length)
    order = np.lexsort((low, high))
    heads = first_ones(high[order], low[order])
    at = np.empty(len(high), np.int64)
    at[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    found = answered(answers, high[order[heads]], ranges, np.int64)[:, 0][at]
    if not keep_first:
        return np.split(found > 1, np.cumsum(sizes)[:-1])
    # The first of the block's own stays if no block before has it.
    age = np.lexsort((np.arange(len(high)), np.repeat(e.earliest, sizes)))
    first = np.zeros(len(high), bool)
    first[age[np.unique(at[age], return_index=True)[1]]] = True
    return np.split(~(first & (found == number + 1)), np.cumsum(sizes)[:-1])

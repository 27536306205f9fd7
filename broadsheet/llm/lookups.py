"""Tables of keys that stay where they are, in ranges of the keys, and blocks that ask there for what they hold.

A block asks each range once.  A table is copied to several tasks which share the blocks that ask, so that the number of
ranges, and with it the rows that a block sends, follows how many keys are known and not how many blocks there are.
Tasks that count keys add up before they send.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, shuffle_width, slices, split_by

#: A lookup's tables are cut into at least so many ranges, or into one for so many keys.
LEAST_RANGES, KEYS_A_RANGE = 64, 1_000_000


def range_of(high: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of 64-bit keys each key falls in; sorted keys have sorted ranges."""
    return ((high >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def first_ones(*ordered: np.ndarray) -> np.ndarray:
    """Where a new key starts in sorted keys of one column or more."""
    fresh = np.ones(len(ordered[0]), bool)
    fresh[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ordered])
    return np.flatnonzero(fresh)


def added_up(high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.lexsort((low, high))
    high, low, counts = high[order], low[order], counts[order]
    fresh = first_ones(high, low)
    return high[fresh], low[fresh], np.add.reduceat(counts, fresh) if len(fresh) else counts


def sum_codes(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of each one's counts."""
    if len(codes) == 1:
        return codes[0], counts[0].astype(np.int64)
    both = np.concatenate([np.zeros(0, np.uint64), *codes])
    order = np.argsort(both, kind="stable")
    both, n = both[order], np.concatenate([np.zeros(0, np.int64), *counts])[order]
    fresh = first_ones(both)
    return both[fresh], np.add.reduceat(n, fresh) if len(fresh) else n


def totals_of(known: tuple[np.ndarray, np.ndarray, np.ndarray], high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Each key's count among the known ones (sorted), 0 for others."""
    highs, lows, counts = known
    if not len(highs):
        return np.zeros(len(high), np.int64)
    at = np.searchsorted(highs, high)
    while True:
        here = np.minimum(at, len(highs) - 1)
        same = (at < len(highs)) & (highs[here] == high)
        # Keys that share their first 64 bits stand next to each other.
        wrong = same & (lows[here] != low)
        if not wrong.any():
            return np.where(same, counts[here], 0)
        at = at + wrong


def pack_totals(totals: np.ndarray) -> bytes:
    """32 bits each where all fit, else 64."""
    return totals.astype(np.uint32 if totals.max(initial=0) < 1 << 32 else np.int64).tobytes()


def unpack_totals(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint32 if len(packed) == 4 * n else np.int64)


ROW = "part int, salt int, asks boolean, block long, a binary, b binary, c binary"


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), *[pa.binary()] * 3)
    columns = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "salt", "asks", "block", "a", "b", "c"])


def lookups(table: DataFrame, asked: DataFrame, salts: int, build: Callable, answer: Callable) -> DataFrame:
    """(block, part, found): answers to the rows of `asked`, each from its part of `table`.

    Each part of the table is copied to `salts` tasks, which share the blocks that ask.  A task holds one part, built
    from its rows (a, b, c), and one request (what was built, block, a, b) at a time.
    """

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for batch in slices(batches):
            out = []
            for k in range(batch.num_rows):
                part, salt, asks, block, a, b, c = (batch.column(j)[k].as_py() for j in range(7))
                if (part, salt) != at:
                    at, held, ready = (part, salt), [], None
                if not asks:
                    held.append((a, b, c))
                    continue
                if ready is None:
                    ready, held = build(held), []
                out.append((block, part, answer(ready, block, a, b)))
            columns = [pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "found"])

    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(asked.columns)
    dealt = copies.unionByName(asked).repartition(shuffle_width(table.sparkSession), "part", "salt").sortWithinPartitions("part", "salt", "asks")
    return arrow_map(dealt, reply, "block long, part int, found binary")


def route(asked: DataFrame, ranges: int, salts: int) -> DataFrame:
    """Blocks' keys (block, a: 64 bits each in order, b: 32 more or null) by range, as requests."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, a, b = (batch.column(j)[k].as_py() for j in range(3))
                high, low = np.frombuffer(a, np.uint64), None if b is None else np.frombuffer(b, np.uint32)
                parts = split_by(range_of(high, ranges))
                yield rows_of([(p, block % salts, True, block, high[own].tobytes(), None if low is None else low[own].tobytes(), None) for p, own in parts])

    return arrow_map(asked.select("block", "a", "b"), deal, ROW)


def answered(answers: list[dict] | None, keys: np.ndarray, ranges: int, kind, width: int = 1) -> np.ndarray:
    """What a block's answers say of its keys (in the order in which it asked): `width` values of a kind for each."""
    out = np.zeros((len(keys), width), kind)
    given = {x["part"]: x["found"] for x in answers or ()}
    for p, own in split_by(range_of(keys, ranges)):
        out[own] = np.frombuffer(given[p], kind).reshape(-1, width)
    return out


def ranges_for(keys: int, width: int) -> tuple[int, int]:
    """Into how many ranges a table of so many keys is cut, and to how many tasks each goes."""
    ranges = max(1, min(width, max(LEAST_RANGES, -(-keys // KEYS_A_RANGE))))
    return ranges, max(1, width // ranges)


def gathered(answers: DataFrame, name: str) -> DataFrame:
    """(block, name): a block's answers in one row, for a join with the blocks where they stand."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("part", "found")).alias(name)).hint("shuffle_hash")

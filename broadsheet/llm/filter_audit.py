"""How filters interact: every order of them, visited by swaps of neighbours.

A document's failures are a mask of five bits, so all that any order does to a part follows from the part's
32 counts by mask (cells).  The orders are visited one adjacent transposition after the other.  A swap of the
filters at two neighbouring places changes nothing before or behind them, and at the two places it only moves
the documents that fail both and nothing earlier: one sum of cells.  Shapley totals add up along the walk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_texts, slices, written

FILTERS = "ABCDE"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = b"#$%&*|"

#: Words of longer texts are gathered so many bytes at a time.
CHUNK_BYTES = 1 << 22
#: Up to so many repeated texts are broadcast by digest (about 60 bytes each); beyond it rows meet them within salts,
#: with the same result.
BROADCAST_GROUPS = 500_000
#: Parts that are walked at a time: 600 rows each.
PARTS = 64

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_numbers(text: bytes, chunk: int = CHUNK_BYTES) -> tuple[int, int]:
    """Words and different words; a long text is cut before white space, so that only its different words are held."""
    if len(text) <= chunk:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = _BLANK.search(text, at + chunk)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def failed(text: bytes, points: int) -> int:
    """Bits of the conditions A to D that the text fails."""
    words, different = word_numbers(text)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    marked = len(text.translate(None, MARKS)) < len(text)
    return (words < 50) | (100 * different < 65 * words) << 1 | (100 * capitals > 5 * points) << 2 | marked << 3


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask (bits A to D), digest (SHA-256 of the text) for every row; no shuffle."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), empty(part_col).alias("part"), empty(text_col).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            texts, points = byte_texts(batch.column("text")), pc.utf8_length(batch.column("text")).to_pylist()
            masks = pa.array([failed(t, n) for t, n in zip(texts, points, strict=True)], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, digests], names=["doc_id", "part", "mask", "digest"])

    return arrow_map(rows, judge, f"doc_id {dict(rows.dtypes)['doc_id']}, part string, mask int, digest binary")


def with_repeats(light: DataFrame, broadcast_groups: int = BROADCAST_GROUPS, salts: int = 16) -> DataFrame:
    """light with bit E in its masks: the text is that of a smaller id somewhere in the table."""
    first = written(light.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id"))
    if first.count() <= broadcast_groups:
        found = light.join(F.broadcast(first), "digest", "left")
    else:
        copies = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = light.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(copies, ["digest", "salt"], "left")
    repeated = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return found.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(repeated, 16).otherwise(0)).alias("mask"))


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places i whose swaps with i + 1, one after the other, visit all n! orders.

    The last thing walks through the others from end to end, and between two of its walks they make one swap of their own.
    """
    if n < 2:
        return
    down, others = True, adjacent_swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        own = next(others, None)
        if own is None:
            return
        # the walker stands in front of the others after a walk down, so their places are one higher
        yield own + 1 if down else own
        down = not down


def walk(cells: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For every order: its letters, removed [parts, 3, 5] (documents, good ones, toxic ones) by step, kept [parts, 5].

    cells: [parts, 32, 3].
    """
    masks = np.arange(32)
    both = {
        (before, a, b): np.flatnonzero(((masks & before) == 0) & ((masks >> a & 1) == 1) & ((masks >> b & 1) == 1))
        for before in range(32)
        for a in range(5)
        for b in range(5)
        if a != b and not (before >> a & 1 or before >> b & 1)
    }
    order, before = list(range(5)), 0
    removed = np.zeros((len(cells), 3, 5), np.int64)
    kept = np.zeros((len(cells), 5), np.int64)
    left = cells[:, :, 0].sum(axis=1)
    for k in order:
        removed[:, :, k] = cells[:, (masks & before == 0) & (masks >> k & 1 == 1)].sum(axis=1)
        kept[:, k] = left = left - removed[:, 0, k]
        before |= 1 << k
    yield FILTERS, removed, kept
    for i in adjacent_swaps(5):
        a, b = order[i], order[i + 1]
        before = sum(1 << k for k in order[:i])
        moved = cells[:, both[before, a, b]].sum(axis=1)
        removed[:, :, i], removed[:, :, i + 1] = removed[:, :, i + 1] + moved, removed[:, :, i] - moved
        kept[:, i] = kept[:, i + 1] + removed[:, 0, i + 1]
        order[i], order[i + 1] = b, a
        yield "".join(FILTERS[k] for k in order), removed, kept


def audit(cells: np.ndarray) -> tuple[list[str], dict[str, np.ndarray]]:
    """The 120 orders as visited, and each column as [parts, 120, 5]."""
    orders: list[str] = []
    steps: dict[str, list[np.ndarray]] = {c: [] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}
    masks, shapley = np.arange(32), np.zeros((len(cells), 5), np.int64)
    fails = np.stack([cells[:, masks >> k & 1 == 1, 0].sum(axis=1) for k in range(5)], axis=1)
    alone = cells[:, 1 << np.arange(5), 0]
    for letters, removed, kept in walk(cells):
        at = [FILTERS.index(x) for x in letters]
        orders.append(letters)
        shapley[:, at] += removed[:, 0]
        own = (kept.copy(), removed[:, 0].copy(), fails[:, at] - removed[:, 0], alone[:, at], removed[:, 1].copy(), removed[:, 2].copy())
        for c, values in zip(steps, own, strict=True):
            steps[c].append(values)
    out = {c: np.stack(values, axis=1) for c, values in steps.items()}
    out["shapley"] = np.stack([shapley[:, [FILTERS.index(x) for x in letters]] for letters in orders], axis=1)
    return orders, out


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    600 rows for every part (value of part_col; null: the empty string), zeros included.  Null texts count as empty;
    equal texts are told by SHA-256.  A repeated id counts once a row, and rows of the smallest id don't repeat each
    other; a null id repeats nothing and has no label.  A document is good (toxic) if any row of labels says so.
    Texts of any length: words of long ones are gathered 4 MB at a time.  An empty table has no parts, so the result
    is empty; other columns are ignored.

    Rows shrink to an id, a mask and a digest where they are read.  Digests are combined before they travel, parts'
    cells as well: a part or a text that a third of all rows share gives each task one row.
    """
    light = written(judged(df, id_col, text_col, part_col))
    told: list[Column] = [F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")]
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(*told)
    marked = with_repeats(light, broadcast_groups).join(marks, "doc_id", "left")
    sums = [F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("quality", "toxic"))]
    cells = marked.groupBy("part", "mask").agg(*sums)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "quality", "toxic")).alias("cells"))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PARTS):
            counts = np.zeros((batch.num_rows, 32, 3), np.int64)
            for k, own in enumerate(batch.column("cells").to_pylist()):
                for x in own:
                    counts[k, x["mask"]] = x["n"], x["quality"], x["toxic"]
            orders, out = audit(counts)
            rows = np.repeat(np.arange(batch.num_rows), len(orders) * 5)
            columns = {
                "part": batch.column("part").take(pa.array(rows)),
                "filter_order": pa.array(np.tile(np.repeat(orders, 5), batch.num_rows)).cast(pa.string()),
                "step": pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(orders) * batch.num_rows)),
            }
            yield pa.RecordBatch.from_pydict(columns | {c: pa.array(values.reshape(-1)) for c, values in out.items()})

    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return arrow_map(parts, walked, f"part string, filter_order string, step int, {longs}")

"""Quality rules on repetition: rolling hashes of several n-gram lengths over the words of a text.

For each length n a polynomial hash rolls over the text's word numbers in numpy (64-bit wrap-around).
The characters of words inside n-grams that occur again in the same text are counted once each, however
many duplicated n-grams cover them.  Lines are treated alike: the words of all lines that have an equal one
count, the first copy's too.  A text fails when a share of its word characters passes its threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_BYTES, arrow_map, byte_texts, slices

#: Characters counted as symbols (fixed by the query's contract).
SYMBOLS = b"#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rules:
    """Largest share of a text's word characters inside duplicated n-grams, by n, and inside duplicated lines;
    and the limits of the base rule."""

    ngram_shares: tuple[tuple[int, float], ...] = ((5, 0.50), (6, 0.46), (7, 0.42), (8, 0.38), (9, 0.34), (10, 0.30))
    line_share: float = 0.30
    min_words: int = 50
    repeat_percent: int = 50


def duplicated(codes: np.ndarray) -> np.ndarray:
    """Which of the codes occur more than once."""
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(codes), bool)
    twice = np.unique(twice)
    at = np.searchsorted(twice, codes)
    at[at == len(twice)] = 0
    return twice[at] == codes


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words whose start is marked."""
    edges = np.zeros(len(starts) + n, np.int32)
    edges[: len(starts)] += starts
    edges[n:] -= starts
    return np.cumsum(edges)[: len(starts) + n - 1] > 0


def exact_windows(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each window of n words; equal numbers stand for equal windows, without hashing."""
    codes = ids.astype(np.int64)
    for k in range(1, n):
        codes = codes[:-1] * np.int64(ids.max() + 1) + ids[k:]
        if k < n - 1:
            codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    return codes


def points(text: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(text.decode("utf-8", "replace"))


def measure(text: bytes, rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, worst n-gram share, line share."""
    words = text.split()
    n = len(words)
    word_chars = points(text) - (len(text) - len(text.translate(None, BLANK_BYTES)))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines: dict[bytes, int] = {}
    for line in text.split(b"\n"):
        if line.strip(BLANK_BYTES):
            lines[line] = lines.get(line, 0) + 1
    n_dup_lines = sum(lines.values()) - len(lines)
    line_share = sum(times * points(line.translate(None, BLANK_BYTES)) for line, times in lines.items() if times > 1) / max(1, word_chars)
    n_repeat_words, worst, bad = 0, 0.0, line_share > rules.line_share
    if n >= 3:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        threes = duplicated(exact_windows(ids, 3))
        n_repeat_words = int(covered(threes, 3).sum())
        if n_repeat_words:
            # A duplicated window of n + 1 words starts with a duplicated one of n, so lengths after one without any are skipped.
            sizes = np.array([points(w) for w in numbers], np.int64)[ids]
            hashed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            hashed ^= hashed >> np.uint64(29)
            rolled, length = hashed, 1
            for width, share in rules.ngram_shares:
                if n < width:
                    break
                while length < width:
                    rolled = rolled[:-1] * _BASE + hashed[length:]
                    length += 1
                marked = duplicated(rolled)
                if not marked.any():
                    break
                found = float(sizes[covered(marked, width)].sum()) / max(1, word_chars)
                worst = max(worst, found)
                bad |= found > share
    base_failed = n < rules.min_words or 100 * n_repeat_words > rules.repeat_percent * n
    return n, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad, worst, line_share


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ngram_share double, line_share double"


def repetition_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per row of df with the counts above, the verdict, and the two shares it rests on.

    A null or empty text has no words and fails the base rule.  Repeated rows are each measured, and very long
    texts as a whole; an empty table gives an empty result; other columns are ignored.  No shuffle.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in COLUMNS.split(", ")]
        for batch in slices(batches):
            found = list(zip(*(measure(t, rules) for t in byte_texts(batch.column("text"))), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(found, kinds, strict=True))], names=["doc_id", *names])

    return arrow_map(rows, apply, f"doc_id {dict(rows.dtypes)['doc_id']}, {COLUMNS}")

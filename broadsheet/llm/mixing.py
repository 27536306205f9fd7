"""Soft-membership mixing of documents to target weights of domains.

A classifier learnt from the labelled table gives each document a posterior over the domains clean, toxic
and low (quality): none belongs wholly to one.  Document rates r >= 0 (how often a document is expected in the mixture) are fitted so that
the expected tokens of each domain, sum of r * tokens * posterior, meet the targets and the rates change as
little from 1 as that allows.  Such rates are r = max(0, 1 - posterior . dual) for k dual numbers, found by
Newton's method on a convex function of them: as exact as wanted after a few passes, clipped rates or not.

The dual is the same few numbers for every document, so no rate is stored: each pass works a document's rate
out from it for several step lengths at once, and returns one row of sums for each.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_texts, slices, written
from .quality import Discriminant, labelled, learn, quality_classes, statistics, statistics_of

log = logging.getLogger(__name__)

DOMAINS = ("clean", "toxic", "low")
#: Words are told apart by all bits of their CRC32.
BINS = 1 << 32


@dataclass(frozen=True)
class Membership:
    """Low quality by the discriminant over document statistics, toxicity by the log odds of the words in a document."""

    quality: Discriminant
    prior: float
    #: The log odds that a document without any of the telling words brings, the telling words' bins in order, and
    #: what each adds.
    absent: float
    telling: np.ndarray
    odds: np.ndarray

    def posteriors(self, x: np.ndarray, bins: list[bytes], temperature: float) -> np.ndarray:
        """Of DOMAINS; a temperature over 1 softens what a document's own text says."""
        logs = self.quality.densities(x)
        good = _logistic((logs[:, 1] - logs[:, 0]) / temperature)
        toxic = _logistic(self.prior + (self.absent + np.array([self.odds[np.isin(self.telling, bins_of(b), assume_unique=True)].sum() for b in bins])) / temperature)
        return np.stack((good * (1 - toxic), good * toxic, 1 - good), 1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def word_odds(with_toxic: np.ndarray, with_other: np.ndarray, toxic: int, other: int, least: float = 5.0) -> tuple[float, float, np.ndarray]:
    """The log prior odds; what it says that no telling bin is there; each bin's log odds ratio where the
    likelihood ratio says that it is as sure as `least` standard errors, else 0.  (Standard errors themselves are wide
    for the surest words, those that one side never has.)"""
    a, b = with_toxic + 0.5, toxic - with_toxic + 0.5
    c, d = with_other + 0.5, other - with_other + 0.5
    ratio = np.log(a / b) - np.log(c / d)
    both, all_rows = with_toxic + with_other, max(toxic + other, 1)
    gain = 0.0
    for seen, expected in ((with_toxic, both * toxic), (toxic - with_toxic, (all_rows - both) * toxic), (with_other, both * other), (other - with_other, (all_rows - both) * other)):
        gain = gain + 2 * seen * np.log(np.maximum(seen, 1) * all_rows / np.maximum(expected, 1))
    sure = gain > least**2
    absent = (np.log(b / (a + b)) - np.log(d / (c + d)))[sure].sum()
    return float(np.log((toxic + 0.5) / (other + 0.5))), float(absent), np.where(sure, ratio, 0.0)


def word_bins(words: list[bytes]) -> bytes:
    """The sorted bins of the distinct words, 32 bits each."""
    return np.unique(np.fromiter(map(crc32, set(words)), np.uint32)).astype("<u4").tobytes()


def bins_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4")


def rates(posteriors: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """A document's rate after the steps: r = max(0, r - posterior . step), from 1."""
    r = np.ones(len(posteriors))
    for step in steps:
        r = np.maximum(0.0, r - posteriors @ step)
    return r


def learn_words(measured: DataFrame, labels: DataFrame, id_col: str) -> tuple[float, float, np.ndarray, np.ndarray]:
    """From all labelled rows, those with equal words and label once; only the telling words reach the driver."""
    marked = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    names = ("bin", "other", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column("toxic"))
            rows = [bins_of(b) for b in batch.column("bins").to_pylist()]
            own, at = np.unique(np.concatenate([*rows, np.zeros(0, np.uint32)]), return_inverse=True)
            of = np.repeat(toxic, [len(x) for x in rows])
            n = [np.bincount(at.reshape(-1)[of == k], minlength=len(own)) for k in (0, 1)]
            # Bin -1: the rows.
            columns = [np.append(own.astype(np.int64), -1), *(np.append(n[k], (toxic == k).sum()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    # Joined the same way at every size: labels grow with the documents.
    lessons = measured.select("doc_id", "bins").join(marked.hint("merge"), "doc_id").select("bins", "toxic").distinct()
    counted = arrow_map(lessons, count, "bin long, other long, toxic long")
    counted = written(counted.groupBy("bin").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")))
    rows = counted.where("bin = -1").first()
    other, toxic = (rows["other"], rows["toxic"]) if rows else (0, 0)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = word_odds(np.asarray(batch.column("toxic")), np.asarray(batch.column("other")), toxic, other)[2]
            yield batch.filter(pa.array(odds != 0))

    found = sorted(tuple(r) for r in arrow_map(counted.where("bin >= 0").select(*names), tell, "bin long, other long, toxic long").collect())
    bins, with_other, with_toxic = np.array(found, np.int64).reshape(-1, 3).T
    prior, absent, odds = word_odds(with_toxic, with_other, toxic, other)
    return prior, absent, bins.astype(np.uint32), odds


#: Tokens of a text's bytes.
Counter = Callable[[bytes], int]


def features(df: DataFrame, id_col: str, text_col: str, tokens_of: Counter | None) -> DataFrame:
    """A written table of doc_id, tokens, and what the classifiers look at."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens, stats, bins = [], [], []
            for text in byte_texts(batch.column("text")):
                words = text.lower().split()
                tokens.append(tokens_of(text) if tokens_of else len(words))
                stats.append(statistics(text))
                bins.append(word_bins(words))
            columns = [batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(stats, pa.list_(pa.float64())), pa.array(bins, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tokens", "x", "bins"])

    return written(arrow_map(rows, look, f"doc_id {dict(rows.dtypes)['doc_id']}, tokens long, x array<double>, bins binary"))


def membership(
    df: DataFrame, labels: DataFrame, id_col: str, text_col: str, temperature: float, tokens_of: Counter | None = None, taught: DataFrame | None = None
) -> tuple[DataFrame, Membership]:
    """A written table of doc_id, tokens (words between white space unless told otherwise) and q, the posterior over DOMAINS;
    and what judged it.  `taught` holds the texts that the labels speak of, df's own unless given: after a filter,
    df may have lost a domain."""
    measured = features(df, id_col, text_col, tokens_of)
    kind = dict(measured.dtypes)["doc_id"]
    lessons = measured if taught is None else features(labelled(taught, labels, id_col), id_col, text_col, None)
    model = Membership(learn(lessons, quality_classes(labels, id_col, "quality"), 2), *learn_words(lessons, labels, id_col))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = model.posteriors(statistics_of(batch), batch.column("bins").to_pylist(), temperature)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tokens"), pa.array(list(q), pa.list_(pa.float64()))], names=["doc_id", "tokens", "q"])

    return written(arrow_map(measured, judge, f"doc_id {kind}, tokens long, q array<double>")), model


#: What a miss costs against changed rates: small, so that only targets out of reach are missed.
SLACK = 1e-7
#: Lengths of Newton steps that a pass tries.
LENGTHS = 0.25 ** np.arange(12)


def fit_rates(members: DataFrame, weights: np.ndarray, tolerance: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps for rates(), expected domain tokens after them, targets).  The targets share out the members' own token total.

    Least squares of the misses, with the least change of rates as its tie-break, over rates of 0 and more.  Each pass moves
    all rates against the gradient, which lies in the space that memberships span, and projects them on 0.  The gradient is
    scaled by the inverse of the moments of the documents off the bound: an unscaled one takes hundreds of passes once
    rates end at 0, and this is a step of Newton's method on the dual, a few.  Goes on until the dual function's slope is within `tolerance` of the total or no step gets lower, however many
    passes that takes.  Targets out of reach end in the least squares of the misses, and a warning with the shares met.
    """
    k = len(weights)
    upper = np.triu_indices(k)

    def sums_of(duals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """For each row of duals: tokens of r squared, domain tokens, moments of documents with a rate; and all tokens."""
        n = len(duals) * (1 + k + len(upper[0])) + 1

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for batch in batches:
                q = np.asarray(batch.column("q").flatten()).reshape(-1, k)
                tokens = np.asarray(batch.column("tokens")).astype(float)
                r = np.maximum(0.0, 1 - q @ duals.T)
                held = r * tokens[:, None]
                moments = ((r > 0) * tokens[:, None]).T @ (q[:, upper[0]] * q[:, upper[1]])
                total += np.concatenate((np.concatenate(((held * r).sum(0)[:, None], held.T @ q, moments), 1).ravel(), [tokens.sum()]))
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

        # One row a task.  They are added up in order of value, so that a run's order of tasks changes nothing.
        found = [row["v"] for row in arrow_map(members, add, "v array<double>").collect()]
        v = np.sum(sorted(found), axis=0) if found else np.zeros(n)
        own = v[:-1].reshape(len(duals), -1)
        moments = np.zeros((len(duals), k, k))
        moments[:, upper[0], upper[1]] = moments[:, upper[1], upper[0]] = own[:, 1 + k :]
        return own[:, 0], own[:, 1 : 1 + k], moments, float(v[-1])

    dual = np.zeros(k)
    squares, (got,), (moments,), total = sums_of(dual[None])
    targets = weights / weights.sum() * total
    if not total:
        return [], got, targets
    slack = SLACK * np.trace(moments)
    height, slope = squares[0] / 2, targets - got
    while np.abs(slope).max() > tolerance * total:
        tried = dual - LENGTHS[:, None] * np.linalg.solve(moments + slack * np.eye(k), slope)
        squares, all_got, all_moments, _ = sums_of(tried)
        heights = squares / 2 + tried @ targets + slack / 2 * (tried**2).sum(1)
        slopes = targets - all_got + slack * tried
        best = int(np.argmin(heights))
        if not heights[best] < height:
            # Too near the end for heights to differ: go by the slope.
            best = int(np.argmin(np.abs(slopes).max(1)))
            if not np.abs(slopes[best]).max() < 0.5 * np.abs(slope).max():
                break
        dual, got, moments, height, slope = tried[best], all_got[best], all_moments[best], heights[best], slopes[best]
    if np.abs(got - targets).max() > 1e-4 * total:
        log.warning("mixing targets are out of reach: shares %s of %s wanted", (got / total).round(5).tolist(), (targets / total).round(5).tolist())
    return [dual], got, targets


def mix(
    df: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    temperature: float = 2.0,
    seed: int = 17,
    tokens_of: Counter | None = None,
) -> DataFrame:
    """doc_id, tokens, p_<domain>, rate, copies for every row of df.

    Tokens are words between white space, or what `tokens_of` counts in a text's bytes.

    copies is rate rounded up or down by a draw that depends on the id and seed alone, so its expectation is
    the rate.  Null texts count as empty: no tokens, and the rate its posterior gives.  Null labels teach nothing.
    Without labelled rows all posteriors are equal.  Targets that no rates can meet are met as
    nearly as least squares can, and a warning names the shares met.  Repeated rows each count towards the targets, and
    labelled rows with equal words and label teach what words tell once.  An empty table gives an empty result; other
    columns are ignored.
    """
    members, _ = membership(df, labels, id_col, text_col, temperature, tokens_of)
    steps, _, _ = fit_rates(members, np.array([weights[d] for d in DOMAINS], float))
    kind = dict(members.dtypes)["doc_id"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.asarray(batch.column("q").flatten()).reshape(-1, len(DOMAINS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tokens"), batch.column("q"), pa.array(rates(q, steps))], names=["doc_id", "tokens", "q", "rate"])

    rated = arrow_map(members, rate, f"doc_id {kind}, tokens long, q array<double>, rate double")
    draw = _draw(F.col("doc_id"), seed)
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return rated.select("doc_id", "tokens", *(F.col("q")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", copies.alias("copies"))


def _draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 24)) / F.lit(float(1 << 24))


#: Copies leave in batches of about so many bytes of text, whatever the rates are.
COPIED_BYTES = 1 << 22


def copied(rows: pa.RecordBatch, sizes: np.ndarray, copies: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Each row as often as copies says, in order; a batch's rows have `most` bytes by sizes, or are one row more."""
    taken = np.repeat(np.arange(len(copies)), copies)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes[taken]) // most)) + 1
    for own in np.split(taken, cuts):
        yield rows.take(pa.array(own))


def drawn(
    df: DataFrame,
    labels: DataFrame,
    weights: dict[str, float],
    id_col: str = "doc_id",
    text_col: str = "text",
    temperature: float = 2.0,
    seed: int = 17,
    tokens_of: Counter | None = None,
    taught: DataFrame | None = None,
) -> DataFrame:
    """The rows of df, all columns as they are, each as often as mix() says in copies; rows never leave their partitions.

    Nulls, repeated rows and empty tables are taken as mix() takes them.
    """
    members, model = membership(df, labels, id_col, text_col, temperature, tokens_of, taught)
    steps, _, _ = fit_rates(members, np.array([weights[d] for d in DOMAINS], float))

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = byte_texts(part.column(text_col))
            x = np.array([statistics(t) for t in texts])
            r = rates(model.posteriors(x, [word_bins(t.lower().split()) for t in texts], temperature), steps)
            whole = np.floor(r)
            copies = (whole + (np.asarray(part.column(part.num_columns - 1)) < r - whole)).astype(np.int64)
            rows = pa.RecordBatch.from_arrays(part.columns[:-1], names=part.schema.names[:-1])
            yield from copied(rows, np.array([len(t) for t in texts]), copies, COPIED_BYTES)

    return arrow_map(df.select("*", _draw(F.col(f"`{id_col}`"), seed).alias(f"draw of {id_col}")), repeat, df.schema)

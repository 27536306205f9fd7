"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian over the statistics below, its covariance shrunk towards the pooled covariance
and that one's diagonal.  The score is the logistic function of the difference of the two Mahalanobis
log densities plus the log prior odds.  The moments come from one distributed aggregation over ALL
labelled training rows; only 2 * (1 + d + d * (d + 1) / 2) numbers reach the driver, whatever the input.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_texts, slices, written

SYMBOLS = b"#*$%&<>@^~\\{}[]="
NAMES = ("words", "word_length", "symbols", "pipes", "shouts", "upper", "digits", "stops", "unique", "adjacent", "entropy", "lines")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics, in the order of NAMES; an empty text has defined values like any other."""
    words = text.split()
    n = len(words)
    per = 1 / max(1, n)
    chars = text.decode("utf-8", "replace")
    count = lambda kept: len(text) - len(text.translate(None, kept))
    seen = Counter(words)
    heavy = -sum(c * per * math.log(c * per) for c in seen.values() if c > 1) if n else 0.0
    ones = sum(1 for c in seen.values() if c == 1)
    entropy = heavy + (ones * per * math.log(n) if n else 0.0)
    letters = max(1, len(chars) - count(b" \n.,"))
    upper = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / letters
    adjacent = sum(map(bytes.__eq__, words, words[1:])) * per
    return [
        math.log1p(n),
        math.log1p(sum(map(len, words)) * per),
        math.log(0.02 + count(SYMBOLS) * per),
        math.log(0.02 + text.count(b"|") * per),
        math.log(0.02 + count(b"!?") * per),
        math.log(0.02 + upper),
        math.log(0.02 + count(b"0123456789") / letters),
        math.log(0.02 + count(b".,;:") * per),
        len(seen) * per * math.sqrt(math.log1p(n)),
        math.log(0.02 + adjacent),
        entropy / math.log(n + 2),
        math.log1p(text.count(b"\n") * per * 20),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors (inverted once) and log terms of the classes."""

    means: np.ndarray
    whiten: np.ndarray
    logs: np.ndarray

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Log prior and Mahalanobis log density of each row under each class."""
        out = np.empty((len(x), len(self.logs)))
        for k, log in enumerate(self.logs):
            z = (x - self.means[k]) @ self.whiten[k].T
            out[:, k] = log - 0.5 * np.einsum("ij,ij->i", z, z)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of two classes, how likely the second is."""
        logs = self.densities(x)
        return 1 / (1 + np.exp(-np.clip(logs[:, 1] - logs[:, 0], -35, 35)))

    def posteriors(self, x: np.ndarray, temperature: float = 1.0) -> np.ndarray:
        """Of each class; a temperature over 1 softens them."""
        logs = self.densities(x) / temperature
        shares = np.exp(logs - logs.max(1, keepdims=True))
        return shares / shares.sum(1, keepdims=True)


def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, towards_pooled: float = 0.10, towards_diagonal: float = 0.05, floor: float = 1e-3) -> Discriminant:
    """From counts (k), sums (k, d) and sums of products (k, d, d).  A class without rows takes all classes' moments."""
    d = sums.shape[1]
    all_mean = sums.sum(0) / max(1, n.sum())
    all_spread = squares.sum(0) / max(1, n.sum()) - np.outer(all_mean, all_mean)
    count = np.maximum(n, 1)
    means = sums / count[:, None]
    spread = squares / count[:, None, None] - means[:, :, None] * means[:, None, :]
    for k in np.flatnonzero(n == 0):
        means[k], spread[k] = all_mean, all_spread
    pooled = (spread * (count / count.sum())[:, None, None]).sum(0) + floor * np.eye(d)
    whiten, logs = [], []
    prior = (n + 1) / (n + 1).sum()
    for k in range(len(n)):
        shrunk = (1 - towards_pooled - towards_diagonal) * spread[k] + towards_pooled * pooled + towards_diagonal * np.diag(np.diag(pooled)) + floor * np.eye(d)
        factor = np.linalg.cholesky(shrunk)
        whiten.append(np.linalg.inv(factor))
        logs.append(math.log(prior[k]) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(logs))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves the fold's remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def measured_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table of doc_id and x, the statistics of each text."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [statistics(t) for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return written(arrow_map(rows, features, f"doc_id {kind}, x array<double>"))


#: Up to so many labelled ids (about 64 MB) say which rows are measured to learn from; beyond it all rows are, with the same
#: result.
BROADCAST_IDS = 2_000_000


def labelled(df: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """The rows of df that labels speak of, and more where there are too many labels to send around."""
    ids = labels.select(F.col(f"`{id_col}`").alias("labelled id")).distinct()
    if ids.count() > BROADCAST_IDS:
        return df
    return df.join(F.broadcast(ids), F.col(f"`{id_col}`") == F.col("labelled id"), "left_semi")


def learn(measured: DataFrame, classes: DataFrame, k: int) -> Discriminant:
    """From all rows of measured that have a class: classes holds doc_id and y, 0 to k - 1."""
    d = len(NAMES)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    n, s, p = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d))
    for row in measured.join(classes, "doc_id").groupBy("y").agg(F.count("*").alias("n"), *sums, *products).collect():  # k rows
        y = row["y"]
        n[y] = row["n"]
        s[y] = [row[f"s{i}"] for i in range(d)]
        for i in range(d):
            for j in range(i, d):
                p[y, i, j] = p[y, j, i] = row[f"p{i}_{j}"]
    return fit(n, s, p)


def quality_classes(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("y in (0, 1)")


def statistics_of(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return np.asarray(batch.column(column).flatten()).reshape(-1, len(NAMES))


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of df; higher scores mean that label 1 is likelier.

    Learns from the labelled rows outside the held-out fold, all of them.  Only the text enters a score.
    Null texts count as empty and are scored too.  Null labels teach nothing; without any labelled row all
    scores are 0.5.  Repeated rows are each scored and each teach, and so do several labels of one id.  Very long texts
    are measured as a whole.  An empty table gives an empty result; other columns are ignored.
    """
    measured = measured_rows(df, id_col, text_col)
    model = learn(measured.where(~held_out(F.col("doc_id"), folds)), quality_classes(labels, id_col, label_col), 2)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(statistics_of(batch)), pa.float64())], names=["doc_id", "score"])

    scored = arrow_map(measured, score, f"doc_id {dict(measured.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """The rows of df, all columns as they are, that quality_scores would predict 1; rows never leave their partitions.

    Nulls, repeated rows and empty tables are taken as quality_scores takes them.
    """
    measured = measured_rows(labelled(df, labels, id_col), id_col, text_col)
    model = learn(measured.where(~held_out(F.col("doc_id"), folds)), quality_classes(labels, id_col, label_col), 2)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in byte_texts(batch.column(text_col))]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return arrow_map(df, keep, df.schema)

"""What the operators of this subpackage share: reading, shared-folder tables and Arrow helpers."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import new_table, ship, written

__all__ = ["BLANKS", "BLANK_BYTES", "arrow_map", "by_bucket", "byte_texts", "new_table", "shuffle_width", "single_threaded", "small_batches", "slices", "split_by", "table", "written"]

#: Characters that separate words: space, \t, \n, \v, \f and \r.  bytes.split() cuts at the same six.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_BYTES = BLANKS.encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow with this package on the workers' path."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about 8 MB, which JVM and worker each hold once or twice a task, where Spark's own limit is 64 MB;
    for plans that run from now on in a session that doesn't set the limit itself."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "8m")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that texts as Python objects and their results are held a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def single_threaded() -> None:
    """Worker-side: the cluster's cores are dealt out by Spark, not by a library's own thread pool."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its indexes in order)."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    for own in np.split(order, cuts) if len(order) else []:
        yield int(bucket[own[0]]), own


def by_bucket(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, list[list]]]:
    """(bucket, its rows) of batches sorted by bucket; one bucket's rows are held at a time."""
    at, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ["bucket", *names]), strict=True):
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, held

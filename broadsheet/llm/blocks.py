"""Documents packed into blocks of a few megabytes, one row each, in a written table.

A block is a unit that later passes read again as a whole: its number names it, its order of documents is
fixed once written, and a lost executor's tasks read the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import named
from .common import arrow_map, byte_texts, new_table, slices, written

SCHEMA = "block long, ids array<long>, ends array<long>, flags array<boolean>, body binary"


def blocks(df: DataFrame, size: int = 8 << 20, buckets: int = 0) -> DataFrame:
    """From (doc_id long, text, flag boolean) a written table of (block, ids, ends, flags, body).

    body holds the texts' UTF-8 bytes one after the other, ends where each ends.  A block closes once it
    holds `size` bytes, so a longer text is a block's last.  Null texts count as empty.  With `buckets` the
    table is bucketed by block as it is written, so joins on block move only the other side.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        flags: list = []
        texts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            columns = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())), pa.array([b"".join(texts)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "ends", "flags", "body"])

        for batch in slices(batches):
            for doc_id, text, flag in zip(batch.column("doc_id").to_pylist(), byte_texts(batch.column("text")), batch.column("flag").to_pylist(), strict=True):
                ids.append(doc_id)
                flags.append(flag)
                texts.append(text)
                held += len(text)
                # Rows of empty texts count too, so a block of them stays small.
                if held + 64 * len(ids) >= size:
                    yield block()
                    number += 1
                    ids, flags, texts, held = [], [], [], 0
        if ids:
            yield block()

    built = arrow_map(df.select("doc_id", "text", "flag"), build, SCHEMA)
    if not buckets:
        return written(built)
    path = new_table(df.sparkSession, "blocks")
    name = named(df.sparkSession, path.rpartition("/")[2].replace("-", "_"))
    built.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    return df.sparkSession.table(name)


def block_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, list, np.ndarray, list, bytes]]:
    """(block, ids, ends, flags, body) of each row."""
    for k in range(batch.num_rows):
        ends = np.asarray(batch.column("ends")[k].values, np.int64)
        yield batch.column("block")[k].as_py(), batch.column("ids")[k].as_py(), ends, batch.column("flags")[k].as_py(), batch.column("body")[k].as_py()


def texts_of(ends: np.ndarray, body: bytes) -> list[bytes]:
    starts = np.concatenate(([0], ends[:-1]))
    return [body[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def with_text(df: DataFrame, id_col: str, text_col: str, flag) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.withColumn("flag", flag(F.col("doc_id")))

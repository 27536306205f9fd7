"""Several tables under one version.

A folder holds segments of rows, segments of deleted keys, and manifests.  A manifest names, for every table, the segments
that make it; a commit writes its segments first and then one manifest, which appears by a rename.  So readers see all
of a commit or nothing of it, whenever its writer is lost.  A deleted key hides rows that were there before its commit;
compaction rewrites segments of like size, and the keys that no older row needs any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: The commit that a row came with.
SEQ = "_seq"
#: Deleted keys that are broadcast to a scan (about 64 MB); with more of them rows and keys meet by a shuffle until the
#: table is compacted as a whole.
BROADCAST_KEYS = 2_000_000
#: Stored bytes of a range of staged rows, at least and at most; between them there is a range for each core.
LEAST_RANGE, MOST_RANGE = 128 << 10, 8 << 20


class Conflict(Exception):
    """Another writer committed first; nothing of this commit can be seen."""


@dataclass(frozen=True)
class Table:
    """ddl: columns and their types; key: the column that deletes and changes go by; sort: columns in whose ranges rows are stored, so
    that a condition on them reads few row groups; merge: what compaction does besides joining segments; row_group:
    bytes of a row group, small where few of them are to be read."""

    ddl: str
    key: str
    sort: tuple[str, ...] = ()
    merge: Callable[[DataFrame], DataFrame] | None = None
    row_group: int | None = None

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


class Archive:
    """Tables in a folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table]) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    # --- files

    def _place(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._place().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self) -> list[str]:
        fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(self._place())] if fs.exists(self._place()) else []

    def version(self) -> int:
        """The newest commit; 0 before the first."""
        return max((int(n[2:-5]) for n in self._names() if n.startswith("m-") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "batches": {}, "counters": {}}
        stream = self._fs().open(self._place(f"m-{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # --- reading

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a commit, the newest if none is given."""
        return self._visible(name, self.manifest(version)["tables"].get(name, {})).drop(SEQ)

    def _visible(self, name: str, own: dict) -> DataFrame:
        table = self.tables[name]
        full = StructType([*table.schema.fields]).add(SEQ, "long")
        if not own.get("segments"):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(*(f"{self.path}/{s['path']}" for s in own["segments"]))
        oldest = min(s["seq"] for s in own["segments"])
        gone = [d for d in own.get("deletes", []) if d["seq"] > oldest]
        if not gone:
            return rows
        # A segment written after every delete needs no look at them.
        newest = max(d["seq"] for d in gone)
        kind = next(f.dataType for f in table.schema if f.name == table.key)
        keys = self.spark.read.schema(StructType().add("_key", kind).add("_upto", "long")).parquet(*(f"{self.path}/{d['path']}" for d in gone))
        latest = keys.groupBy("_key").agg(F.max("_upto").alias("_upto"))
        if sum(d["rows"] for d in gone) <= BROADCAST_KEYS:
            latest = F.broadcast(latest)
        hidden = (F.col(table.key) == F.col("_key")) & (F.col(SEQ) < F.col("_upto"))
        return rows.join(latest, hidden & (F.col(SEQ) < F.lit(newest)), "left_anti")

    def begin(self) -> Commit:
        """Changes to be made visible together by Commit.done()."""
        base = self.manifest()
        return Commit(self, base, json.loads(json.dumps(base["tables"])))

    # --- upkeep

    def compact(self, name: str, whole: bool = False) -> bool:
        """Rewrites the newest segments of like size as one (whole: all of them), in a commit of its own; each row is
        rewritten a number of times that grows with the logarithm of the rows.  Returns whether there was anything to do."""
        commit = self.begin()
        own = commit.tables.get(name, {"segments": [], "deletes": []})
        segments = sorted(own["segments"], key=lambda s: s["seq"])
        take, rows = 0, 0
        for s in reversed(segments):
            if take and not whole and s["rows"] > 2 * rows:
                break
            take, rows = take + 1, rows + s["rows"]
        if take < 2 and not (whole and own.get("deletes")):
            return False
        old, new = segments[: len(segments) - take], segments[len(segments) - take :]
        table = self.tables[name]
        left = self._visible(name, {"segments": new, "deletes": own.get("deletes", [])})
        if table.merge is not None:
            left = table.merge(left.drop(SEQ)).withColumn(SEQ, F.lit(max(s["seq"] for s in new)).cast("long"))
        path, n = commit.write(name, left, sequenced=True)
        oldest = min((s["seq"] for s in old), default=None)
        own["segments"] = old + ([{"path": path, "rows": n, "seq": min(s["seq"] for s in new)}] if n else [])
        own["deletes"] = [d for d in own.get("deletes", []) if oldest is not None and d["seq"] > oldest]
        commit.tables[name] = own
        commit.done()
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Deletes older manifests than the newest `keep`, and files that none of those names, such as a lost writer left.
        Not to be run beside a writer."""
        fs, latest = self._fs(), self.version()
        held: set[str] = set()
        for v in range(max(1, latest - keep + 1), latest + 1):
            if fs.exists(self._place(f"m-{v}.json")):
                held.add(f"m-{v}.json")
                for own in self.manifest(v)["tables"].values():
                    held.update(x["path"] for x in own["segments"] + own.get("deletes", []))
        gone = [n for n in self._names() if n not in held]
        for n in gone:
            fs.delete(self._place(n), True)
        return len(gone)


@dataclass
class Commit:
    """Changes on top of a base version.  Nothing of it can be seen before done()."""

    archive: Archive
    base: dict
    tables: dict
    #: Numbers that the next commits go on from, such as the largest id given out.
    counters: dict[str, int] = field(default_factory=dict)

    @property
    def seq(self) -> int:
        return self.base["version"] + 1

    def read(self, name: str) -> DataFrame:
        """The table as it was when this commit began."""
        return self.archive._visible(name, self.base["tables"].get(name, {})).drop(SEQ)

    @contextmanager
    def staged(self, df: DataFrame) -> Iterator[tuple[DataFrame, int]]:
        """df as a table of its own beside the segments, which is there as long as the block runs, and the number of ranges that suits
        its size: what reads it more than once, as the search for ranges does, doesn't make it again."""
        name = f"staged-{uuid.uuid4().hex}"
        try:
            df.write.option("compression", "zstd").parquet(f"{self.archive.path}/{name}")
            size = self.archive._fs().getContentSummary(self.archive._place(name)).getLength()
            each = max(LEAST_RANGE, min(MOST_RANGE, size // self.archive.spark.sparkContext.defaultParallelism))
            yield self.archive.spark.read.schema(df.schema).parquet(f"{self.archive.path}/{name}"), -(-size // each)
        finally:
            self.archive._fs().delete(self.archive._place(name), True)

    def write(self, name: str, df: DataFrame, sequenced: bool = False, runs: str | None = None, ranges: int | None = None) -> tuple[str, int]:
        """Rows as a new segment, in ranges of the table's sort columns; its path and number of rows.

        runs: a column that holds lists, none of them empty, and is stored as a row for each of their values; a list stays together
        and is ordered by its first value.  ranges: how many there are, where Spark, which goes by the bytes that travel, should not
        choose."""
        table, spark = self.archive.tables[name], self.archive.spark
        kinds = {f.name: ArrayType(f.dataType) if f.name == runs else f.dataType for f in table.schema}
        rows = df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()), *([SEQ] if sequenced else [F.lit(self.seq).cast("long").alias(SEQ)]))
        if table.sort:
            by = [F.get(c, F.lit(0)) if c == runs else F.col(c) for c in table.sort]
            rows = rows.repartitionByRange(*([ranges] if ranges else []), *by).sortWithinPartitions(*by)
        if runs:
            rows = rows.withColumn(runs, F.explode(runs))
        path = f"{name}-{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        if table.row_group:
            writer = writer.option("parquet.block.size", table.row_group)
        writer.parquet(f"{self.archive.path}/{path}")
        return path, spark.read.parquet(f"{self.archive.path}/{path}").count()

    def _own(self, name: str) -> dict:
        return self.tables.setdefault(name, {"segments": [], "deletes": []})

    def add(self, name: str, df: DataFrame, runs: str | None = None, ranges: int | None = None) -> int:
        """Adds rows; returns how many.  runs and ranges: see write()."""
        path, n = self.write(name, df, runs=runs, ranges=ranges)
        if n:
            self._own(name)["segments"].append({"path": path, "rows": n, "seq": self.seq})
        return n

    def replace(self, name: str, df: DataFrame) -> int:
        """df as the whole table."""
        path, n = self.write(name, df)
        self.tables[name] = {"segments": [{"path": path, "rows": n, "seq": self.seq}] if n else [], "deletes": []}
        return n

    def delete(self, name: str, keys: DataFrame) -> int:
        """Hides all rows of before this commit whose key is the first column of keys."""
        path = f"{name}-gone-{uuid.uuid4().hex}"
        kind = next(f.dataType for f in self.archive.tables[name].schema if f.name == self.archive.tables[name].key)
        at = f"{self.archive.path}/{path}"
        keys.select(F.col(f"`{keys.columns[0]}`").cast(kind).alias("_key")).where("_key is not null").distinct().withColumn("_upto", F.lit(self.seq).cast("long")).write.parquet(at)
        n = self.archive.spark.read.parquet(at).count()
        if n:
            self._own(name).setdefault("deletes", []).append({"path": path, "rows": n, "seq": self.seq})
        return n

    def change(self, name: str, df: DataFrame) -> int:
        """Rows in place of those with their keys."""
        path, n = self.write(name, df)
        if n:
            written = self.archive.spark.read.parquet(f"{self.archive.path}/{path}")
            self.delete(name, written.select(self.archive.tables[name].key))
            self._own(name)["segments"].append({"path": path, "rows": n, "seq": self.seq})
        return n

    def seen(self, stream: str, batch: int) -> bool:
        """Whether a batch of a stream is part of the base already."""
        return batch <= self.base.get("batches", {}).get(stream, -1)

    def done(self, stream: str | None = None, batch: int | None = None) -> int:
        """Makes everything visible at once and returns the new version; Conflict if the base is no longer the newest.

        The manifest is written beside and renamed; a file system whose rename refuses an existing name, as HDFS does,
        lets one of two writers win even if both have looked.  stream and batch are remembered for seen()."""
        archive, fs = self.archive, self.archive._fs()
        batches = {**self.base.get("batches", {}), **({stream: batch} if stream is not None else {})}
        counters = {**self.base.get("counters", {}), **self.counters}
        body = json.dumps({"version": self.seq, "tables": self.tables, "batches": batches, "counters": counters})
        aside = archive._place(f".m-{self.seq}-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        target = archive._place(f"m-{self.seq}.json")
        if archive.version() != self.base["version"] or fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise Conflict(f"version {self.seq} is another writer's")
        return self.seq

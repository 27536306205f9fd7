"""Tables as numbered folders.  Snapshots: readers take the newest complete one, so a lost writer leaves no half table.
Logs: each batch adds a folder of its own rows, cut by a key, and nothing else is written or read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Snapshots:
    """A folder of versions v-0, v-1, ... on any file system that Spark reaches.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root, root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """Complete ones, oldest first."""
        root, fs = self._files()
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("v-")]
        done = [p for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[2:]) for p in done)

    def read(self, before: int | None = None) -> DataFrame:
        """The newest version, or the newest before a number; empty without any."""
        found = [v for v in self.versions() if before is None or v < before]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v-{found[-1]}")

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """df as the given version (written again if it is there), or as the next one."""
        if version is None:
            found = self.versions()
            version = found[-1] + 1 if found else 0
        df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in self.schema)).write.mode("overwrite").parquet(f"{self.path}/v-{version}")
        return version

    def drop_older(self, keep: int = 2) -> None:
        root, fs = self._files()
        for v in self.versions()[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, f"v-{v}"), True)


class Log:
    """A folder of batches batch=n/part=k of rows, k a hash of the key.  A batch written again replaces itself, so a
    batch that is run again after a loss leaves what it left before.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, parts: int = 64) -> None:
        self.spark, self.path, self.schema, self.key, self.parts = spark, path.rstrip("/"), schema, key, parts

    def _full(self) -> StructType:
        return StructType([*self.schema.fields]).add("batch", "long").add("part", "integer")

    def part(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.parts)).cast("int")

    def _exists(self) -> bool:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return fs.exists(root) and len(fs.listStatus(root)) > 0

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """All rows, those of batches before a number, or those of the given keys (a small table, distinct), which reads
        only their parts."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self._full()).parquet(self.path)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        if keys is not None:
            wanted = [r["part"] for r in keys.select(self.part().alias("part")).distinct().collect()]  # at most `parts`
            rows = rows.where(F.col("part").isin(wanted)).join(keys.select(self.key), self.key, "left_semi")
        return rows.select(*self.names)

    @property
    def names(self) -> list[str]:
        return self.schema.names

    def of(self, batch: int) -> DataFrame:
        """The rows that one batch added."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self._full()).parquet(self.path).where(F.col("batch") == batch).select(*self.names)

    def write(self, df: DataFrame, batch: int) -> None:
        rows = df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in self.schema)).withColumn("part", self.part())
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/batch={batch}")

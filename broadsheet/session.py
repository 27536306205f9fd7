"""Session settings and how the package reaches the executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "broadsheet", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; what the caller passes wins."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so Python workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_broadsheet_shipped", False):
        return
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="broadsheet-code-")
    target = os.path.join(folder, "broadsheet-code.zip")
    Path(target).write_bytes(packed.getvalue())
    sc.addPyFile(target)
    sc._broadsheet_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where the session names none."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="broadsheet-")
        sc.setCheckpointDir(found)
    return found


def new_table(spark: SparkSession, name: str = "t") -> str:
    """A fresh path in the shared folder, remembered for drop_written."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    if not hasattr(sc, "_broadsheet_tables"):
        sc._broadsheet_tables = []
    sc._broadsheet_tables.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage ends there, so a lost
    executor costs only tasks that read those files."""
    spark, path = df.sparkSession, new_table(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(spark: SparkSession, name: str) -> str:
    """A name in the session's catalog, remembered for drop_written."""
    sc = spark.sparkContext
    sc._broadsheet_names = [*getattr(sc, "_broadsheet_names", []), name]
    return name


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables this session has written in the shared folder, and their names in the catalog; returns how
    many.  Results that were not stored elsewhere can't be read after it."""
    sc, jvm = spark.sparkContext, spark._jvm
    for name in getattr(sc, "_broadsheet_names", []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    sc._broadsheet_names = []
    gone = getattr(sc, "_broadsheet_tables", [])
    for path in gone:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    sc._broadsheet_tables = []
    return len(gone)

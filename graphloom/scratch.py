"""Tables that a job writes for itself."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where none is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='graphloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Has Spark remove the shuffle files of a query as soon as it is over.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage of loops and survives the loss of executors."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def remove(*tables: DataFrame) -> None:
    """Deletes the folders that saved() wrote for these, which nothing reads any more, by the file system that they are in: no job of its own."""
    for table in tables:
        spark, path = table.sparkSession, _paths.pop(table)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def forget(*tables: DataFrame) -> None:
    """remove(), and a collection of the driver's garbage: only then does Spark's cleaner drop broadcasts and shuffles of finished steps, of which a
    loop leaves hundreds."""
    remove(*tables)
    for spark in {t.sparkSession for t in tables}:
        spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, where PYTHONPATH doesn't already lead to it."""
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "graphloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)

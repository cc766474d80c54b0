"""Tables in the folder that driver and executors share: where plans are cut, and graphs laid out."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the session names as spark.checkpoint.dir; a temporary one only where all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession) -> str:
    """A path for a table of this session, which is removed at its end."""
    path = f"{folder(spark)}/tesserae/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialised(df: DataFrame, **options: str | int) -> DataFrame:
    """df written as a table, with options of the writer, and read back: lineage ends there, and lost executors cost one read."""
    path = new_path(df.sparkSession)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Remove the files of a table that materialised() wrote, once no plan reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, f)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have gone first
        return

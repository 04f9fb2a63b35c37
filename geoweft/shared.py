"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where the master is this machine alone may it be unset: then it is a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/geoweft-checkpoints"


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/geoweft/{spark.sparkContext.applicationId}"


def table(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder and reads it again.

    The rows outlive lost executors and are computed once, and Spark knows the size of what it reads. drop() deletes one table, drop_tables() all.
    """
    spark = df.sparkSession
    path = f"{_home(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that table() returned; DataFrames that still read them fail afterwards."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.partition(":")[2].lstrip("/").startswith(_home(df.sparkSession).partition(":")[2].lstrip("/")):
                _delete(df.sparkSession, folder)


def drop_tables(spark: SparkSession) -> None:
    """Deletes what table() wrote in this application."""
    _delete(spark, _home(spark))


def stored_bytes(df: DataFrame) -> int:
    """What Spark expects the rows of df to take; for a table that is the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

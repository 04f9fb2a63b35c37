"""Row-wise operators on streams, with windowed counts; what needs all points (nearest, clusters) stays in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweft.functions import literals as X


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Number and mean value of each kind in each window; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def coloured(distances: DataFrame, d: str = "d") -> DataFrame:
    return distances.withColumn("color", X.color_by_loa(F.col(d)))


def session_counts(events: DataFrame, by: str, gap: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Number of events in each session of by, which ends when nothing comes for the gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), by).agg(F.count(F.lit(1)).alias("n"))


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream of rows."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a single file is read through its folder
    place, glob = (path, "*.parquet") if _is_folder(spark, path) else (sf_dir, f"{name}.parquet")
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(place)
    # watermarks need times that are points in time
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def finished(results: DataFrame) -> DataFrame:
    """Runs a stream over all that is there now and returns its rows as a table: each batch replaces the last one's results, which are whole."""
    import uuid

    from geoweft.shared import shared_folder

    spark = results.sparkSession
    home = f"{shared_folder(spark)}/geoweft/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    out = f"{home}/rows"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    results.writeStream.outputMode("complete").option("checkpointLocation", f"{home}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(results.schema).parquet(out)

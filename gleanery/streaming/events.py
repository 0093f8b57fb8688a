"""Event streams: a resumable tail, deduplication, late rows, windows and sessions.

Streams are read from files with an explicit schema, so a directory that grows is picked up where the
checkpoint left off. ``drain`` runs a stream over what is there now and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.stage import fresh


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_at_once: int = 256) -> DataFrame:
    """A table, one file or a folder of any number of files, as a stream. Every batch costs its jobs, so it takes many files."""
    path = f"{sf_dir}/{name}.parquet"
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once)
    single = here.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(here).isFile()
    return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else source.parquet(path)


def stream_of(spark: SparkSession, sf_dir: str, name: str = "events", files_at_once: int = 256) -> DataFrame:
    """A table with a time column as a stream; its time is made a TIMESTAMP, which watermarks need."""
    return table_stream(spark, sf_dir, name, files_at_once).withColumn("ts", F.col("ts").cast("timestamp"))


def once_per_id(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each event once. With a delay, state beyond it is forgotten, and rows later than it are dropped;
    without one every id is kept in the state store and no row is late."""
    if delay is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily(events: DataFrame) -> DataFrame:
    """Tumbling days: rows and summed value by type."""
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def sliding(events: DataFrame) -> DataFrame:
    """Hours that start every 20 minutes."""
    return events.groupBy(F.window("ts", "1 hour", "20 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of a user that end after a gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_seconds("w.start").alias("start"), "n")


def split_late(events: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to a stored cutoff, and those after it: kept and flagged, admitted nowhere."""
    at = F.lit(cutoff).cast("timestamp")
    return events.filter(F.col("ts") <= at), events.filter(F.col("ts") > at).withColumn("late", F.lit(True))


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now into Parquet files of the shared folder, and read them.

    Appended rows go through the file sink. In complete mode each batch writes the whole result to a
    folder of its own, and the last one is read. ``checkpoint`` resumes an earlier run.
    """
    spark = stream.sparkSession
    path = fresh(spark, "drained")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/rows")
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        last[:] = [number]

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch-{last[0]}") if last else spark.createDataFrame([], stream.schema)

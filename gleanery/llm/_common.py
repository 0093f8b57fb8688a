"""What the corpus operators share: the shared folder, cut lineage, batch sizes, column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch handed to Python. Texts may be long, so batches stay small.
BATCH_ROWS = 1024


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session in rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a folder in the temp directory.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/gleanery-checkpoints"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/gleanery/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, so a
    lost executor costs a reread and never a different answer."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    files = stored.inputFiles()
    if files:
        jvm, conf = stored.sparkSession._jvm, stored.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name (case-insensitively)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by Spark's own reader, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

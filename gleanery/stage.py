"""Tables between steps: lineage is cut by writing to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in ``spark.checkpoint.dir``.

    Only a local session may leave the folder unset; it then gets one in the temp directory.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/gleanery-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/gleanery/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back; for narrow results that several jobs read."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df.select(*columns)``, computed once a row.

    A filter is pushed through a projection and repeats what it reads of it, regular expressions too; it stops at a generator."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def discard(kept: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    files = kept.inputFiles()
    if files:
        spark = kept.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

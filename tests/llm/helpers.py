"""Small inputs shared by the tests of the corpus operators."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


def docs_of(spark, texts, source="a", first=1):
    rows = [(first + i, t, source if isinstance(source, str) or source is None else source[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def noisy(df):
    """The same rows beside columns whose names clash with those that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("fp", "token", "size", "h", "cell", "group", "id", "n", "bytes", "digest", "leaf", "score", "spans", "shard", "pattern", "page", "first"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df

"""Parquet tables of a data directory, and the record pool and passages that stand on ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.stage import once

#: Words of a title, shortest text that has an abstract, and characters of a passage.
TITLE_WORDS, ABSTRACT_CHARS, PASSAGE_CHARS = 12, 200, 1400


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give tasks for fewer than half of them; larger inputs stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record pool: id, title (first words), abstract (the rest; null in short texts), provider, lang."""
    w = F.col("w")
    rest = F.array_join(F.slice(w, TITLE_WORDS + 1, F.greatest(F.size(w), F.lit(1))), " ")
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars", "source", "lang"))
    return once(
        docs.select("doc_id", T.chunks(F.col("text")).alias("w"), "n_chars", "source", "lang"),
        F.col("doc_id").alias("id"),
        F.array_join(F.slice(w, 1, TITLE_WORDS), " ").alias("title"),
        F.when(F.col("n_chars") >= ABSTRACT_CHARS, rest).alias("abstract"),
        F.col("source").alias("provider"),
        "lang",
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title) of the record pool, for those who need no more: each text is matched as far as its title reaches."""
    head = F.regexp_extract("text", rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){{0,{TITLE_WORDS}}}", 0)
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("id"), F.array_join(T.chunks(head), " ").alias("title"))


#: The same pool in oracle SQL, as a common table expression.
POOL_SQL = r"""pool AS (SELECT doc_id AS id, array_to_string(w[1:12], ' ') AS title,
  CASE WHEN n_chars >= 200 THEN array_to_string(w[13:], ' ') END AS abstract, source AS provider, lang
  FROM (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents))"""

#: Tokens of an expression in oracle SQL.
TOKENS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+(?:[-''’][\p{{L}}\p{{N}}]+)*')"


def tokens_sql(expression: str) -> str:
    return TOKENS_SQL.format(expression)

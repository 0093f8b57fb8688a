"""Ranks over a whole table without a single-task window, and their fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.stage import stored

#: The constant of reciprocal rank fusion, and buckets that a global order is dealt to.
RRF_K, BUCKETS = 60, 64


def bucket_of(df: DataFrame, score: str, buckets: int = BUCKETS) -> Column:
    """A bucket number that falls as the score rises; equal scores share a bucket."""
    cuts = sorted(set(df.approxQuantile(score, [i / buckets for i in range(1, buckets)], 0.002)))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col(score)))


def starts(df: DataFrame, score: str) -> DataFrame:
    """For each distinct score the rows above it (``above``) and at it (``ties``): exact competition ranks.

    Ties are counted first, so a value that many rows share is one row from there on; distinct values are
    dealt to buckets in order, numbered inside their bucket and moved by the rows of the buckets above.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("ties"))
    counts = counts.withColumn("bucket", bucket_of(counts, score))
    sizes = counts.groupBy("bucket").agg(F.sum("ties").alias("rows")).collect()  # at most BUCKETS rows
    run, base = 0, {}
    for r in sorted(sizes, key=lambda r: r["bucket"]):
        base[r["bucket"]] = run
        run += r["rows"]
    offset = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])[F.col("bucket")] if base else F.lit(0)
    inside = Window.partitionBy("bucket").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(score, "ties", (offset + F.coalesce(F.sum("ties").over(inside), F.lit(0))).alias("above"))


def mean_ranks(df: DataFrame, score: str, rank: str, available: Column | None = None) -> DataFrame:
    """``df`` with the mean rank of a score: 1 is best, ties share their mean place, rows without the
    signal share the mean of the tail. ``rank`` is a double; ``<rank>_available`` says which kind it is.

    The scores are stored once, as four jobs read them."""
    known = F.col(score).isNotNull() if available is None else available
    kept = stored(df.withColumn("_score", F.when(known, F.col(score))), "scores")
    sizes = kept.agg(F.count("_score").alias("have"), F.count(F.lit(1)).alias("all")).first()
    tail = (sizes["have"] + sizes["all"] - 1) / 2 + 1
    places = starts(kept, "_score").withColumnRenamed("_score", "_s")
    joined = kept.join(places, kept["_score"] == places["_s"], "left")
    mean = F.when(F.col("_score").isNotNull(), F.col("above") + (F.col("ties") + 1) / 2).otherwise(F.lit(float(tail)))
    return joined.withColumn(rank, mean.cast("double")).withColumn(f"{rank}_available", F.col("_score").isNotNull()).drop("_score", "_s", "above", "ties")


def rank_all(df: DataFrame, scores: Sequence[str], available: dict[str, Column] | None = None, key: str = "id") -> DataFrame:
    """(key, a rank for each score, ``<score>_available``): mean ranks of several signals in one pass, keys distinct.

    As ``mean_ranks``, without a job for every signal: the scores are stored once and counted as rows of (signal,
    score), distinct ones are dealt to ranges in order and numbered there, and a record's places meet by its key.
    """
    spark, known = df.sparkSession, available or {}
    kept = stored(df.select(key, *[F.when(known.get(c, F.lit(True)) & F.col(c).isNotNull(), F.col(c).cast("double")).alias(c) for c in scores]), "scores")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("signal"), F.col(c).alias("score")) for i, c in enumerate(scores)])).alias("s")
    long = kept.select(key, each).select(key, "s.*").filter("score IS NOT NULL")
    counts = long.groupBy("signal", "score").agg(F.count(F.lit(1)).alias("ties"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(counts.repartitionByRange(ranges, "signal", F.desc("score")).withColumn("_range", F.spark_partition_id()), "score-ties")
    n = kept.count()
    base, run = [], {i: 0 for i in range(len(scores))}
    for r in dealt.groupBy("signal", "_range").agg(F.sum("ties").alias("n")).orderBy("signal", "_range").collect():  # a row a range and signal
        base.append((r["signal"], r["_range"], run[r["signal"]]))
        run[r["signal"]] += r["n"]
    before = F.broadcast(spark.createDataFrame(base, "signal int, _range int, _before long"))
    inside = Window.partitionBy("signal", "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = F.col("_before") + F.coalesce(F.sum("ties").over(inside), F.lit(0))
    places = dealt.join(before, ["signal", "_range"]).select("signal", "score", (above + (F.col("ties") + 1) / 2).alias("_rank"))
    ranked = long.join(places, ["signal", "score"]).groupBy(key).agg(*[F.max(F.when(F.col("signal") == i, F.col("_rank"))).alias(c) for i, c in enumerate(scores)])
    tails = [F.lit((run[i] + n - 1) / 2 + 1) for i in range(len(scores))]
    out = kept.select(key).join(ranked, key, "left")
    return out.select(key, *[F.coalesce(c, t).alias(c) for c, t in zip(scores, tails)], *[F.col(c).isNotNull().alias(f"{c}_available") for c in scores])


def rrf(ranks: Sequence[str], k: int = RRF_K, weights: Sequence[float] | None = None) -> Column:
    """Reciprocal rank fusion of rank columns, rounded so that the order of addition cannot show."""
    total = F.lit(0.0)
    for r, w in zip(ranks, weights or [1.0] * len(ranks)):
        total = total + F.lit(float(w)) / (F.lit(float(k)) + F.col(r))
    return F.round(total, 9)


def positions(df: DataFrame, score: str, tie: str, position: str = "position") -> DataFrame:
    """``df`` with places 1..n by score descending, then ``tie``.

    Rows are dealt to ranges of (score, tie), so rows of one score need not meet in one task; each range is
    numbered on its own and moved by the rows of the ranges before it.
    """
    spark = df.sparkSession
    ranges = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(df.repartitionByRange(ranges, F.desc(score), F.col(tie)).withColumn("_range", F.spark_partition_id()), "positions")
    sizes = {r["_range"]: r["count"] for r in dealt.groupBy("_range").count().collect()}  # one row a range
    run, base = 0, []
    for k in sorted(sizes):
        base.append((k, run))
        run += sizes[k]
    before = F.broadcast(spark.createDataFrame(base, "_range int, _before long"))
    inside = Window.partitionBy("_range").orderBy(F.desc(score), tie)
    return dealt.join(before, "_range").withColumn(position, F.col("_before") + F.row_number().over(inside)).drop("_range", "_before")

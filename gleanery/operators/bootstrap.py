"""Paired bootstrap: the percentile interval of a mean difference.

A resample of n rows by equal chances is a multinomial draw of how often each distinct difference comes, so rows are counted by
difference first and resamples are drawn from those counts: exact for any number of rows, and the resamples are dealt over all tasks.
The distinct differences are broadcast and bounded; more are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Resamples, distinct differences at most, and the ends of the interval.
RESAMPLES, MOST_VALUES, ENDS = 10_000, 1_000_000, (0.025, 0.975)


def paired(differences: DataFrame, column: str = "difference", resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """One row: n, mean, low and high of the differences, null counting as 0 (a question that failed); nulls without any row."""
    spark = differences.sparkSession
    counts = differences.groupBy(F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v").limit(MOST_VALUES + 1).toPandas()
    if len(counts) > MOST_VALUES:
        raise ValueError(f"more than {MOST_VALUES} distinct differences: round them first")
    n = int(counts["n"].sum())
    if not n:
        return spark.createDataFrame([(0, None, None, None)], "n long, mean double, low double, high double")
    sent = spark.sparkContext.broadcast((counts["v"].to_numpy(), counts["n"].to_numpy() / n))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, share = sent.value
        for f in frames:
            yield pd.DataFrame({"mean": [float(np.random.default_rng([seed, int(i)]).multinomial(n, share) @ values) / n for i in f["id"]]})

    means = np.sort(spark.range(resamples).mapInPandas(draw, "mean double").toPandas()["mean"].to_numpy())  # one number a resample
    low, high = means[int(ENDS[0] * resamples)], means[int(ENDS[1] * resamples) - 1]
    mean = float((counts["v"] * counts["n"]).sum() / n)
    return spark.createDataFrame([(n, mean, float(low), float(high))], "n long, mean double, low double, high double")

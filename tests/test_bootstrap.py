"""The bootstrap against the distribution it must have and against resampling row by row."""

import math
import random

from gleanery.operators import bootstrap


def test_two_values_follow_the_binomial(spark):
    df = spark.range(400).selectExpr("IF(id % 4 = 0, 1.0, 0.0) AS difference")
    r = bootstrap.paired(df).first()
    total, quantiles = 0.0, {}
    for k in range(401):
        total += math.comb(400, k) * 0.25**k * 0.75 ** (400 - k)
        for q in (0.025, 0.975):
            if total >= q:
                quantiles.setdefault(q, k / 400)
    assert r["n"] == 400 and r["mean"] == 0.25 and abs(r["low"] - quantiles[0.025]) <= 0.0051 and abs(r["high"] - quantiles[0.975]) <= 0.0051


def test_close_to_resampling_row_by_row(spark):
    rng = random.Random(1)
    values = [round(rng.gauss(0.1, 0.3), 2) for _ in range(120)] + [None] * 5
    r = bootstrap.paired(spark.createDataFrame([(v,) for v in values], "difference double").repartition(3), resamples=4000).first()
    plain = [v or 0.0 for v in values]
    means = sorted(sum(rng.choices(plain, k=125)) / 125 for _ in range(4000))
    assert abs(r["low"] - means[100]) < 0.01 and abs(r["high"] - means[3899]) < 0.01 and abs(r["mean"] - sum(plain) / 125) < 1e-9
    assert r == bootstrap.paired(spark.createDataFrame([(v,) for v in reversed(values)], "difference double"), resamples=4000).first()


def test_no_rows(spark):
    assert tuple(bootstrap.paired(spark.createDataFrame([], "difference double")).first()) == (0, None, None, None)

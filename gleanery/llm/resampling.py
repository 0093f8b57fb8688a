"""Importance resampling of documents towards a target distribution, by position-table n-grams.

``posexplode`` turns a text into a table of words by position; for every order above one a window's
``lead()`` by document joins the words that follow. Features are hashed to ``buckets``; raw texts and
target texts are counted by bucket, and the log ratio of their smoothed shares is a bucket's gain. Gains,
at most one row a bucket, are joined to the table, and a document's weight is the mean of its features'
gains. Seeded Gumbel noise by id is added, and the highest sums are drawn: sampling without replacement
in proportion to the exponent of the weight.

Counting and weighing each read the texts once. Rows are pre-aggregated before they move: a bucket's
count and a document's sum are one row a task. With order one nothing else moves; higher orders bring
the words of a document together first, and a very long one spills rather than fails. Ranks are given by
ranges of (score, id), so rows of one score, or of one repeated id, need not meet.

Lower-casing is A-Z only; words are runs of ``WORDS``; features are words joined by one space; a bucket
is the unsigned crc32 of a feature's UTF-8 bytes, modulo ``buckets``.

Defined results: a null or wordless text has no features, weight 0 and, like all below ``min_words``
words, no rank; a null id draws noise as an empty one and comes after others among ties; rows that repeat
an id have equal noise and rows of their own, equal ones in any order; an empty target counts 0 in all
buckets; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialize

#: What separates words, before lower-casing, for Spark's regular expressions.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BUCKETS, SEED = 10_000, 2024
#: Ranges at least that drawn rows are dealt to for their ranks.
RANGES = 64


def words(text: Column) -> Column:
    """The normalised words of a text, none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, BREAKS), lambda w: w != "")


def features(rows: DataFrame, text_col: str, orders: int, keep: list[Column]) -> DataFrame:
    """One row per feature: the kept columns, ``position`` and ``feature``; a row without words keeps one
    row with a null feature. Each input row is a document of its own (``row``)."""
    numbered = rows.select(*keep, F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("g_text"))
    if orders > 1:  # the texts move once, whole; the exploded words then stay where they are
        numbered = materialize(numbered, "resampling-rows").repartition("row")
    spread = numbered.select("*", F.posexplode_outer(words(F.col("g_text"))).alias("position", "word")).drop("g_text")
    grams = [F.col("word")]
    if orders > 1:
        at = Window.partitionBy("row").orderBy("position")
        following = [F.lead("word", k).over(at) for k in range(1, orders)]
        grams += [F.when(following[n - 2].isNotNull(), F.concat_ws(" ", F.col("word"), *following[: n - 1])) for n in range(2, orders + 1)]
        held = spread.select("*", F.array(*grams).alias("grams")).drop("word")
        kept = F.filter("grams", lambda g: g.isNotNull())
        return held.select("*", F.explode_outer(kept).alias("feature")).drop("grams")
    return spread.withColumnRenamed("word", "feature")


def bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(rows: DataFrame, text_col: str, orders: int, buckets: int, name: str) -> DataFrame:
    """(bucket, count) over all features of all rows."""
    spread = features(rows, text_col, orders, []).filter(F.col("feature").isNotNull())
    return spread.select(bucket(F.col("feature"), buckets).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for all buckets: floor(1000 ln) of the ratio of smoothed shares.

    ``raw`` has s and ``target`` has t by bucket: at most ``buckets`` rows each."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = materialize(every.join(raw, "bucket", "left").join(target, "bucket", "left").fillna(0, ["s", "t"]), "resampling-counts")
    of_all, of_target = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t").cast("double") + 1) * float(of_all + buckets)) / ((F.col("s").cast("double") + 1) * float(of_target + buckets))
    found = materialize(both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).coalesce(1), "resampling-gains")
    discard(both)
    return found


def noise(id_: Column, seed: int) -> Column:
    """Seeded Gumbel noise in thousandths, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, known: DataFrame, orders: int = 1, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document under the gains ``known``."""
    spread = features(docs, text_col, orders, [F.col(id_col).alias("id")])
    is_word = F.col("position").isNotNull()
    sums = (
        spread.withColumn("bucket", bucket(F.col("feature"), buckets))
        .join(F.broadcast(known), "bucket", "left")  # at most ``buckets`` rows
        .groupBy("row", "id")
        .agg(F.count("feature").alias("n_features"), F.sum("gain").alias("total"), F.max(F.when(is_word, F.col("position") + 1)).alias("n_words"))
    )
    mean = F.expr("(total - pmod(total, n_features)) div n_features")  # floors go down
    weight = F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0)).cast("long")
    found = sums.select("id", F.coalesce("n_words", F.lit(0)).alias("n_words"), "n_features", weight.alias("weight"))
    return found.withColumn("score", (F.col("weight") + noise(F.col("id"), seed)).cast("long"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    min_words: int = 20,
    orders: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Every document: id, n_features, weight, score, and for the drawn its rank.

    Of the N documents with at least ``min_words`` words, floor(percent * N / 100) are drawn."""
    raw = bucket_counts(docs, text_col, orders, buckets, "s")
    known = gains(raw, bucket_counts(target, target_text_col, orders, buckets, "t"), buckets)
    # Stored before it is dealt to ranges: their sampling would read the texts once more.
    weighed = materialize(weigh(docs, known, orders, buckets, seed, id_col, text_col), "resampling-sums")
    placed = weighed.withColumn("short", F.col("n_words") < min_words).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    order = ["short", F.desc("score"), F.asc_nulls_last("id"), "salt"]
    ranges = max(RANGES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialize(placed.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "resampling-weights")
    discard(known)
    discard(weighed)
    sizes = sorted((r["part"], r["n"]) for r in dealt.filter("NOT short").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    draw, run, offsets = percent * sum(n for _, n in sizes) // 100, 0, {}
    for part, n in sizes:
        if run < draw:
            offsets[part] = run
        run += n
    shown = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    drawn = ~F.col("short") & F.col("part").isin(list(offsets))
    rest = dealt.filter(~drawn).select(*shown, none)
    if not offsets:
        return rest
    offset = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[F.col("part")]
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + offset
    ranked = dealt.filter(drawn).withColumn("rank", place.cast("long"))
    return rest.unionByName(ranked.select(*shown, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")))

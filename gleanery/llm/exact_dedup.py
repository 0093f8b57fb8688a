"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame functions only.

Every partition of the documents makes a run: its digests in order, one row each with the winning
identifier and the number of rows. Runs are exchanged in binomial rounds. With ``fan_in`` k, round r
brings k runs of the round before together, and each run is cut into k times as many digest ranges, so
that the number of tasks stays the same and no task ever holds a whole run of many partitions: task
(run, range) gets the same range of k sorted runs, merges them in digest order and keeps the winner of
each digest. After log_k(leaves) rounds one run is left, cut into as many ranges as there were leaves.
A digest arrives at a merge at most once a run, so a hot text never meets in one task.

Texts are equal if SHA-256, byte length and an independent 64-bit hash agree; all three are compared at
every level. The winners go back the way the rows came: to the leaf runs of a digest, of which there are
at most ``leaves``, and from there to the rows of that leaf.

Defined results: a null text counts as empty; empty texts form one group; repeated rows count as
often as they occur; ties on the identifier keep every row with that identifier; a null identifier wins
only where a group has no other, and then all its rows stay; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, materialize

#: Merges keep the order of the sorted runs: a sort aggregate streams over them, a hash aggregate would not.
SORTED_MERGE = "spark.sql.execution.replaceHashWithSortAgg"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte a character take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


@contextmanager
def _sorted_merges(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SORTED_MERGE, None)
    spark.conf.set(SORTED_MERGE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SORTED_MERGE)
        else:
            spark.conf.set(SORTED_MERGE, before)


def _keys(rows: DataFrame) -> list[str]:
    """What must agree for two rows to be equal: ``check`` is optional."""
    return [c for c in ("digest", "bytes", "check") if c in rows.columns]


def leaf_runs(rows: DataFrame, keep: str = "max") -> DataFrame:
    """The run of each leaf: leaf, the keys, keep_id, group_size. ``rows``: leaf, digest, bytes, check, id."""
    best = F.max if keep == "max" else F.min
    keys = _keys(rows)
    runs = rows.groupBy("leaf", *keys).agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return runs.sortWithinPartitions("leaf", *keys)


def merge_round(runs: DataFrame, ranges: int, keep: str = "max", fan_in: int = 8, tasks: int | None = None) -> DataFrame:
    """One round: runs of ``fan_in`` neighbouring leaves meet, range by range, and are merged in order.

    The result has the columns of ``runs``; ``leaf`` is the number of the merged run.
    """
    best = F.desc_nulls_last if keep == "max" else F.asc_nulls_last
    keys = _keys(runs)
    place = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    met = runs.select(F.floor(F.col("leaf") / fan_in).alias("leaf"), F.floor(place * ranges).alias("range"), *keys, "keep_id", "group_size")
    dealt = met.repartition(tasks or ranges, "leaf", "range").sortWithinPartitions("leaf", "range", *keys, best("keep_id"))
    return dealt.groupBy("leaf", "range", *keys).agg(F.first("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).drop("range")


def rounds_of(leaves: int, fan_in: int) -> list[int]:
    """The number of digest ranges in each round, until one run is left."""
    out = []
    while leaves > 1:
        leaves = -(-leaves // fan_in)
        out.append((out[-1] if out else 1) * fan_in)
    return out


def merge_runs(rows: DataFrame, keep: str = "max", leaves: int = 64, fan_in: int = 8) -> DataFrame:
    """Merge (digest, bytes, id) rows to one row a digest: digest, bytes, keep_id, group_size.

    A column ``leaf`` numbers the leaf of each row; without one it is the partition's number.
    """
    if "leaf" not in rows.columns:
        rows = rows.withColumn("leaf", F.pmod(F.spark_partition_id(), F.lit(leaves)))
    return _merged(leaf_runs(rows, keep), keep, leaves, fan_in)


def _merged(runs: DataFrame, keep: str, leaves: int, fan_in: int) -> DataFrame:
    rounds = rounds_of(leaves, fan_in)
    for ranges in rounds:
        runs = merge_round(runs, ranges, keep, fan_in, rounds[-1])
    return runs.drop("leaf")  # a single leaf needs no round


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", leaves: int | None = None, fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (hex of the normalised text).

    ``leaves``: runs at the start; by default as many as the session shuffles into.
    """
    spark = docs.sparkSession
    leaves = leaves or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("bytes"),
            F.xxhash64(text).alias("check"),
            F.pmod(F.spark_partition_id(), F.lit(leaves)).alias("leaf"),
        ),
        "digests",
    )
    keys = _keys(rows)
    with _sorted_merges(spark):
        runs = materialize(leaf_runs(rows, keep), "digest-runs")
        merged = materialize(_merged(runs, keep, leaves, fan_in), "digest-merged")
    back = materialize(runs.select("leaf", *keys).join(merged, keys), "digest-winners")
    discard(runs)
    discard(merged)
    return rows.join(back, ["leaf", *keys]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

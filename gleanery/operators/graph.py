"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.stage import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): weakly connected components named by their smallest node.

    Each round every node goes to the first of its neighbours and itself, in an order by hash that is new each round, and the
    edges between the places reached are the next round's graph: about half its nodes, chains too, and no node without a
    neighbour. When no edge is left the rounds' steps are joined, last first.
    """
    every = edges.select("src", "dst")
    left = stored(every.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "edges")
    steps = []
    while not left.isEmpty():
        first = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        ends = left.select(F.inline(F.array(F.struct(F.col("a").alias("node"), first("b").alias("near")), F.struct(F.col("b").alias("node"), first("a").alias("near")))))
        step = stored(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("near", first("node"))["to"].alias("to")), "steps")
        steps.append(step)
        side = lambda s: step.select(F.col("node").alias(s), F.col("to").alias(f"t{s}"))  # noqa: B023, E731
        moved = left.join(side("a"), "a").join(side("b"), "b").filter("ta <> tb")
        before, left = left, stored(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        discard(before)
    places = None
    for step in reversed(steps):
        before = places
        if places is None:
            places = step.select("node", F.col("to").alias("place"))
        else:
            later = places.select(F.col("node").alias("to"), F.col("place").alias("later"))
            places = stored(step.join(later, "to", "left").select("node", F.coalesce("later", "to").alias("place")), "places")
            discard(before)
    alone = every.filter("src = dst").select(F.col("src").alias("node"))
    if places is None:
        return stored(alone.distinct().withColumn("root", F.col("node")), "labels")
    roots = places.groupBy("place").agg(F.min("node").alias("root"))
    found = places.join(roots, "place").select("node", "root").unionByName(alone.withColumn("root", F.col("node")))
    labels = stored(found.groupBy("node").agg(F.min("root").alias("root")), "labels")
    for done in (*steps, places):
        discard(done)
    return labels


def frontier(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(node, round): nodes reached from the seeds (node) within some rounds along the edges, first round kept."""
    seen = seeds.select("node").distinct().withColumn("round", F.lit(0))
    last = seen
    for r in range(1, rounds + 1):
        step = edges.join(last.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        last = step.join(seen, "node", "left_anti").withColumn("round", F.lit(r))
        seen = seen.unionByName(last)
    return seen


def outside(edges: DataFrame, held: DataFrame, least: int, limit: int) -> DataFrame:
    """(dst, cited_by): targets outside ``held`` (node) that at least ``least`` sources cite, most cited first."""
    cited = edges.distinct().join(held.select(F.col("node").alias("dst")), "dst", "left_anti").groupBy("dst").agg(F.count(F.lit(1)).alias("cited_by"))
    return cited.filter(F.col("cited_by") >= least).orderBy(F.desc("cited_by"), "dst").limit(limit)

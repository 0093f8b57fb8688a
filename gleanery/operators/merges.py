"""Works that grow and split: record links arrive and are undone, and only what they touch is computed anew.

Links are taken in the order of their sequence numbers. A link joins two works unless both hold a published record: two different
published records never share a work, by any path. That is the spanning forest in which every tree holds at most one published
record and each link is the earliest that can join its trees, so it can be built in rounds: every tree without a published record takes its
earliest link to another tree. The order in which links arrive or tasks run does not matter.

A state has three stored tables. Records of a touched group (all that any standing link reaches, refused links included) are computed
anew from their standing links; no other group is read for more than its membership. A pair that was undone once stays apart.

The survivor of a work is its published record, else its oldest record, else that of the smallest id.

Defined results: published records of one DOI are one work from the start; links between a record and itself or to unknown
records do nothing until the record arrives; repeated links count with their smallest number; of events on one pair an undo
stands, whatever the order; empty tables give empty states.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import graph, identity
from gleanery.stage import discard, stored


@dataclass(frozen=True)
class Works:
    """``records``: id, published, created. ``links``: a, b, seq, undone. ``works``: id, group, work. ``touched``: records that the
    last step computed anew."""

    records: DataFrame
    links: DataFrame
    works: DataFrame
    touched: int

    def refused(self) -> DataFrame:
        """(a, b, seq): standing links between two works, kept apart because both hold a published record."""
        side = lambda s: self.works.select(F.col("id").alias(s), F.col("work").alias(f"work_{s}"))
        both = _standing(self.links).join(side("a"), "a").join(side("b"), "b")
        return both.filter("work_a <> work_b").select("a", "b", "seq")


def _standing(links: DataFrame) -> DataFrame:
    return links.filter("seq IS NOT NULL AND NOT undone AND a <> b").select("a", "b", "seq")


def forest(records: DataFrame, links: DataFrame) -> DataFrame:
    """(id, tree): trees of at most one published record, earliest links first."""
    trees = stored(records.select("id", F.col("id").alias("tree"), "published"), "trees")
    rest, old = links, None
    while True:
        side = lambda s: trees.select(F.col("id").alias(s), F.col("tree").alias(f"t{s}"))
        full = trees.groupBy("tree").agg(F.bool_or("published").alias("full"))
        end = lambda s: full.select(F.col("tree").alias(f"t{s}"), F.col("full").alias(f"f{s}"))
        rest = rest.select("a", "b", "seq").join(side("a"), "a").join(side("b"), "b").filter("ta <> tb").join(end("a"), "ta").join(end("b"), "tb").filter("NOT (fa AND fb)")
        rest = stored(rest.select("a", "b", "seq", "ta", "tb", "fa", "fb"), "open-links")
        if old is not None:
            discard(old)
        old = rest
        link = lambda mine, other: rest.filter(~F.col(f"f{mine}")).select(F.col(f"t{mine}").alias("tree"), F.struct("seq", "a", "b", F.col(f"t{other}").alias("to")).alias("link"))
        taken = link("a", "b").unionByName(link("b", "a")).groupBy("tree").agg(F.min("link").alias("link"))
        taken = stored(taken.select(F.col("tree").alias("src"), F.col("link.to").alias("dst")), "links-taken")
        if taken.isEmpty():
            discard(rest)
            return trees.select("id", "tree")
        joined = graph.components(taken).withColumnRenamed("node", "tree")
        before, trees = trees, stored(trees.join(joined, "tree", "left").select("id", F.coalesce("root", "tree").alias("tree"), "published"), "trees")
        for done in (before, taken, joined):
            discard(done)


def _computed(records: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group, work) of records from their standing links."""
    groups = graph.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("id"), F.col("root").alias("group"))
    found = records.join(forest(records, links), "id").join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
    first = F.min(F.struct((~F.col("published")).alias("other"), F.coalesce("created", F.lit(1 << 40)).alias("created"), "id"))["id"]
    return found.select("id", "group", "tree").join(found.groupBy("tree").agg(first.alias("work")), "tree").select("id", "group", "work")


def begin(records: DataFrame) -> Works:
    """The state of records (id, doi, published, created) without links."""
    none = lambda **columns: records.sparkSession.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns.items()])
    nobody = none(id="long", doi="string", published="boolean", created="long")
    return arrive(Works(nobody, none(a="long", b="long", seq="long", undone="boolean"), none(id="long", group="long", work="long"), 0), records)


def arrive(state: Works, records: DataFrame) -> Works:
    """``state`` with new records, each a work of its own but for published ones of a DOI that is known."""
    new = records.select("id", "doi", F.coalesce("published", F.lit(False)).alias("published"), F.col("created").cast("long").alias("created"))
    new = stored(new, "new-records")  # several steps read them
    every = stored(state.records.unionByName(new), "work-records")
    alone = new.select("id", F.col("id").alias("group"), F.col("id").alias("work"))
    works = stored(state.works.unionByName(alone), "works")
    named = every.filter("published AND doi <> ''")
    first = named.groupBy("doi").agg(F.min("id").alias("a"))
    same = named.join(new.filter("published").select("doi").distinct(), "doi", "left_semi").join(first, "doi").filter("id <> a")
    waiting = _standing(state.links)  # links to records that were not there yet
    known = waiting.join(new.select(F.col("id").alias("a")), "a", "left_semi").unionByName(waiting.join(new.select(F.col("id").alias("b")), "b", "left_semi"))
    events = same.select(F.lit(-1).cast("long").alias("seq"), "a", F.col("id").alias("b"), F.lit("merge").alias("op")).unionByName(known.select("seq", "a", "b", F.lit("merge").alias("op")))
    return advance(Works(every, state.links, works, 0), events)


def advance(state: Works, events: DataFrame) -> Works:
    """``state`` after events (seq, a, b, op: merge or undo)."""
    pair = lambda f, name: f("a", "b").alias(name)
    fresh = events.select("seq", pair(F.least, "a"), pair(F.greatest, "b"), "op").groupBy("a", "b")
    fresh = stored(fresh.agg(F.min(F.when(F.col("op") == "merge", F.col("seq"))).alias("seq"), F.bool_or(F.col("op") == "undo").alias("undone")), "events")
    links = state.links.unionByName(fresh).groupBy("a", "b").agg(F.min("seq").alias("seq"), F.bool_or("undone").alias("undone"))
    links = stored(links, "links")
    ends = fresh.select(F.col("a").alias("id")).unionByName(fresh.select(F.col("b").alias("id"))).distinct()
    groups = state.works.join(ends, "id", "left_semi").select("group").distinct()
    near = stored(state.works.join(groups, "group", "left_semi").select("id"), "touched")
    touched = near.count()
    if not touched:
        return Works(state.records, links, state.works, 0)
    inside = _standing(links).join(near.withColumnRenamed("id", "a"), "a", "left_semi").join(near.withColumnRenamed("id", "b"), "b", "left_semi")
    # Published records of one DOI count as one: the first stands for all, and only it is published to the forest.
    records = state.records.join(near, "id", "left_semi")
    first = records.filter("published AND doi <> ''").groupBy("doi").agg(F.min("id").alias("_first"))
    marked = records.join(first, "doi", "left").withColumn("published", F.col("published") & (F.col("_first").isNull() | (F.col("_first") == F.col("id"))))
    renewed = _computed(stored(marked.select("id", "published", "created"), "touched-records"), inside)
    works = state.works.join(near, "id", "left_anti").unionByName(renewed)
    return Works(state.records, links, stored(works, "works"), touched)


def external_links(records: DataFrame, named: DataFrame) -> DataFrame:
    """Verdicts of the pairs that a second source names: ``identity.classify_pairs`` columns, source and outcome.

    ``named``: id, source, doi. A record that is named with several DOIs confirms nothing: its pairs stay suspected (disagree);
    others are confirmed where their verdict merges, else blocked.
    """
    dois = records.filter("doi <> ''").select(F.col("id").alias("other"), "doi")
    met = named.join(dois, "doi").filter("id <> other")
    pairs = met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "id", "source").groupBy("a", "b").agg(F.min_by("source", F.struct("id", "source")).alias("source"))
    many = named.groupBy("id").agg((F.count_distinct("doi") > 1).alias("many")).filter("many")
    torn = lambda s: many.select(F.col("id").alias(s), F.lit(True).alias(f"many_{s}"))
    judged = identity.classify_pairs(records, pairs.select("a", "b", F.lit(True).alias("external_link")))
    j = judged.join(pairs, ["a", "b"]).join(torn("a"), "a", "left").join(torn("b"), "b", "left")
    apart = F.coalesce(F.col("many_a") | F.col("many_b"), F.col("many_a"), F.col("many_b"), F.lit(False))
    outcome = F.when(apart, "disagree").when(F.col("merge"), "confirmed").otherwise("blocked")
    over = {"link_kind": F.when(apart, "related_suspected").otherwise(F.col("link_kind")), "rule": F.when(apart, "external_links_disagree").otherwise(F.col("rule")), "merge": F.col("merge") & ~apart, "parent": F.when(~apart, F.col("parent")), "outcome": outcome}
    return j.withColumns(over).drop("many_a", "many_b")

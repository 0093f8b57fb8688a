"""The composed ranking of a record pool: signals, seeds taken from them, a citation graph around the seeds, fusion, and a
second pass that a frozen manifest replays.

Records: id, work_id, title, abstract, own_ids (array of identifiers), references (array; null where the list was not read),
cited_by_count; verified seeds have ``seed_pdf`` too. Ids are distinct; rows may come in any order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators import ranks, signals
from gleanery.stage import stored

# Signals in fused order, seeds of the first and the second pass, the head that never moves, the reach of
# the reorder, and the signals that count twice in it.
CODE_SIGNALS = ("bm25", "blocks", "tfidf", "graph", "joint")
SIGNALS = (*CODE_SIGNALS, "embedding")
FIRST_SEEDS, SECOND_SEEDS, HEAD, REACH, DOUBLE = 15, 30, 20, 500, ("graph", "cites")


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


@dataclass(frozen=True)
class Question:
    """What a ranking is asked for. ``graph_rule``: sum_v1, or seed_max_v2 (seed PDFs count by the nearest one)."""

    words: Sequence[str]
    blocks: dict[str, Sequence[str]] = field(default_factory=dict)
    compared: Sequence[str] | None = None
    graph_rule: str = "sum_v1"


@dataclass
class Ranked:
    """Ranks by signal (id and a column a signal), the seeds of the graph, and why a signal did not run."""

    ranks: DataFrame
    signals: tuple[str, ...]
    seeds: DataFrame
    reasons: dict[str, str]

    def fused(self) -> DataFrame:
        """(id, fused): reciprocal rank fusion of the signals that ran."""
        return self.ranks.select("id", ranks.rrf(self.signals).alias("fused"))


def joint_forms(terms: Sequence[str]) -> list[str]:
    """Compared terms as the forms to look for: hyphens as spaces, without a last word that another term ends in too."""
    split = [t for t in (_WORD.findall(x.replace("-", " ").lower()) for x in terms) if t]
    lasts = [t[-1] for t in split]
    cut = [t[:-1] if len(t) > 1 and lasts.count(t[-1]) > 1 else t for t in split]
    return list(dict.fromkeys(" ".join(t) for t in cut))


def _not_own(pairs: DataFrame, records: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs (id, seed) but those of one work: equal work ids, or a seed PDF that shares an identifier."""
    mine = records.select("id", F.col("work_id").alias("_w"), F.col("own_ids").alias("_o"))
    theirs = seeds.select(F.col("id").alias("seed"), F.col("work_id").alias("_ws"), F.col("own_ids").alias("_os"), F.col("seed_pdf").alias("_pdf"))
    same = (F.col("_w") == F.col("_ws")) | (F.col("_pdf") & F.coalesce(F.arrays_overlap("_o", "_os"), F.lit(False)))
    return pairs.join(mine, "id").join(theirs, "seed").filter(~F.coalesce(same, F.lit(False))).drop("_w", "_o", "_ws", "_os", "_pdf")


def graph(records: DataFrame, seeds: DataFrame, nearest_pdf: bool = False, cited_twice: bool = False) -> DataFrame:
    """(id, graph): bibliographic coupling with every seed and direct citations either way, never with a version of the same work.

    ``cited_twice``: a seed's citation of the record counts twice. ``nearest_pdf``: of the seed PDFs only the nearest counts.
    The pairs are sparse: they come from equal identifiers alone, and the seeds, a bounded list, are the small side.
    """
    refs = lambda d, name: d.select(F.col("id").alias(name), F.size(F.array_distinct("references")).alias(f"n_{name}"), F.explode(F.array_distinct("references")).alias("target"))
    own = lambda d, name: d.select(F.col("id").alias(name), F.explode(F.array_distinct("own_ids")).alias("target"))
    mine, theirs = refs(records, "id"), refs(seeds, "seed")
    shared = mine.join(theirs, "target").groupBy("id", "seed", "n_id", "n_seed").agg(F.count(F.lit(1)).alias("k"))
    coupling = shared.select("id", "seed", (F.col("k") / F.sqrt(F.col("n_id") * F.col("n_seed"))).alias("value"))
    cites = mine.join(own(seeds, "seed"), "target").select("id", "seed").distinct().withColumn("value", F.lit(1.0))
    cited = own(records, "id").join(theirs, "target").select("id", "seed").distinct().withColumn("value", F.lit(2.0 if cited_twice else 1.0))
    pairs = coupling.unionByName(cites).unionByName(cited).groupBy("id", "seed").agg(F.sum("value").alias("value"))
    kept = _not_own(pairs, records, seeds).join(seeds.select(F.col("id").alias("seed"), "seed_pdf"), "seed")
    apart = F.col("seed_pdf") if nearest_pdf else F.lit(False)
    total = F.coalesce(F.sum(F.when(~apart, F.col("value"))), F.lit(0.0)) + F.coalesce(F.max(F.when(apart, F.col("value"))), F.lit(0.0))
    sums = kept.groupBy("id").agg(F.round(total, 9).alias("graph"))
    return records.select("id").join(sums, "id", "left").select("id", F.coalesce("graph", F.lit(0.0)).alias("graph"))


def _is_seeded(records: DataFrame, verified: DataFrame, by_identifier: bool) -> DataFrame:
    """Records of no verified work; with ``by_identifier`` none that shares an identifier with a seed PDF either."""
    out = records.join(verified.select("work_id").distinct(), "work_id", "left_anti")
    if not by_identifier:
        return out
    own = verified.filter("seed_pdf").select(F.explode("own_ids").alias("_own")).distinct()
    taken = out.select("id", F.explode("own_ids").alias("_own")).join(own, "_own").select("id").distinct()
    return out.join(taken, "id", "left_anti")


def _seeds(candidates: DataFrame, fused: DataFrame, n: int) -> DataFrame:
    """The first ``n`` candidates in fused order, as seeds."""
    first = candidates.join(fused, "id").orderBy(F.desc("fused"), "id").limit(max(0, n))
    return first.select(*candidates.columns).withColumn("seed_pdf", F.lit(False))


def _has_references(seeds: DataFrame) -> bool:
    return bool(seeds.filter(F.size("references") > 0).limit(1).count())


def graph_seeds(records: DataFrame, verified: DataFrame, question: Question, words: DataFrame | None = None, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, bm25, blocks) of every record, and the graph's seeds: the verified ones, then the first of BM25 and blocks.

    ``words`` and ``terms``: the records' runs and counted terms, where the caller has them."""
    words = signals.runs(records) if words is None else words
    terms = signals.term_counts(words) if terms is None else terms
    names = [c for c in records.columns if c != "seed_pdf"]
    block = signals.run_block_score(words, question.blocks).select("id", (F.col("in_title") * 1000.0 + F.col("forms")).alias("blocks"))
    lexical = stored(signals.term_bm25(terms, question.words).withColumnRenamed("score", "bm25").join(block, "id"), "lexical")
    first = ranks.rank_all(lexical, ["bm25", "blocks"]).select("id", ranks.rrf(["bm25", "blocks"]).alias("fused"))
    pdf = F.col("seed_pdf") if question.graph_rule == "seed_max_v2" else F.lit(False)
    n_others = verified.agg(F.count_if(~pdf)).first()[0]
    code = _seeds(_is_seeded(records.select(*names), verified, True), first, FIRST_SEEDS - n_others)
    return lexical, stored(verified.select(*names, "seed_pdf").unionByName(code.select(*names, "seed_pdf")), "graph-seeds")


def rank_pool(records: DataFrame, verified: DataFrame, question: Question, similarities: DataFrame | None = None) -> Ranked:
    """All signals of the pool, ranked: BM25 and blocks choose the code seeds of the graph beside the verified ones."""
    nearest = question.graph_rule == "seed_max_v2"
    reasons: dict[str, str] = {}
    words = signals.runs(records)
    terms = signals.term_counts(words)
    lexical, seeds = graph_seeds(records, verified, question, words, terms)
    scored, has = lexical, {}
    if not verified.isEmpty():
        dots = _not_own(signals.tfidf_dots(terms, signals.whole(verified)), records, verified)
        best = dots.groupBy("id").agg(F.round(F.max("dot"), 9).alias("tfidf"))
        scored = scored.join(best, "id", "left").fillna(0.0, ["tfidf"])
        has["tfidf"] = F.col("_abstract")
    else:
        reasons["tfidf"] = "no_verified_seeds"
    if _has_references(seeds):
        scored = scored.join(graph(records, seeds, nearest), "id")
        has["graph"] = F.col("_references")
    else:
        reasons["graph"] = "no_seed_with_references"
    forms = joint_forms(question.compared or [])
    if question.compared is None:
        reasons["joint"] = "not_a_comparison"
    elif len(forms) < 2:
        reasons["joint"] = "fewer_than_two_task_terms"
    else:
        scored = scored.join(signals.joint(records, forms).select("id", (F.col("in_title") * 1_000_000.0 + F.col("rarity")).alias("joint")), "id")
    if similarities is None:
        reasons["embedding"] = "embedding_off"
    else:
        scored = scored.join(similarities.select("id", F.col("similarity").cast("double").alias("embedding")), "id", "left")
    facts = records.select("id", (F.length("abstract") > 0).alias("_abstract"), (F.size("references") > 0).alias("_references"))
    ran = tuple(s for s in SIGNALS if s in scored.columns)
    has = {s: F.coalesce(c, F.lit(False)) for s, c in has.items()}
    return Ranked(ranks.rank_all(scored.join(facts, "id"), ran, has), ran, seeds, reasons)


def replay(records: DataFrame, verified: DataFrame, question: Question, similarities: DataFrame | None = None, version: int = 3) -> DataFrame:
    """(id, place): the delivered order of a frozen pool.

    Version 1 is the fused order. From version 2 on, the places behind the head and up to ``REACH`` are ordered anew, the
    graph and the citation counts counting twice. Version 3 first ranks the graph again around seeds from the fused order.
    """
    ranked = rank_pool(records, verified, question, similarities)
    first = ranks.positions(ranked.fused(), "fused", "id", "first").select("id", "first", "fused")
    if version == 1:
        return first.select("id", F.col("first").cast("long").alias("place"))
    first = stored(first, "first-order")
    table, run, head = ranked.ranks, ranked.signals, first
    renewed = records.select("id", F.log1p("cited_by_count").alias("cites"))
    has = {"cites": F.col("cites").isNotNull()}
    if version == 3:
        names = [c for c in records.columns if c != "seed_pdf"]
        nearest = question.graph_rule == "seed_max_v2" and bool(verified.filter("seed_pdf").limit(1).count())
        free = _is_seeded(records.select(*names), verified, nearest).filter(F.size("references") > 0)
        more = _seeds(free, first, SECOND_SEEDS)
        seeds = stored(verified.select(*names, "seed_pdf").unionByName(more.select(*names, "seed_pdf")), "second-seeds")
        if _has_references(seeds):
            facts = records.select("id", F.coalesce(F.size("references") > 0, F.lit(False)).alias("_references"))
            renewed = renewed.join(graph(records, seeds, nearest, cited_twice=True), "id").join(facts, "id")
            has["graph"] = F.col("_references")
            table, run = table.drop("graph"), tuple(s for s in SIGNALS if s in run or s == "graph")
    extra = [c for c in ("graph", "cites") if c in renewed.columns]
    table = stored(table.drop("graph_available", "cites_available").join(ranks.rank_all(renewed, extra, has), "id"), "all-ranks")
    base = ranks.positions(table.select("*", ranks.rrf(run).alias("fused")), "fused", "id", "base") if version == 3 else table.join(head.select("id", F.col("first").alias("base")), "id")
    weights = [2.0 if s in DOUBLE else 1.0 for s in (*run, "cites")]
    both = stored(base.select("id", "base", ranks.rrf((*run, "cites"), weights=weights).alias("again")).join(first.select("id", "first"), "id"), "orders")
    early = both.filter((F.col("first") <= HEAD) | (F.col("base") <= REACH))  # at most HEAD + REACH rows
    tier = F.when(F.col("first") <= HEAD, 0).when(F.col("base") <= HEAD, 1).when(F.col("base") <= REACH, 2)
    order = [tier, F.when(tier == 0, F.col("first")).when(tier == 1, F.col("base")), F.desc("again"), "id"]
    moved = early.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long").alias("place"))
    late = [r["base"] for r in early.filter(F.col("base") > REACH).select("base").collect()]  # at most HEAD: they left the tail for the head
    behind = sum((F.when(F.lit(b) > F.col("base"), 1).otherwise(0) for b in late), F.lit(0))
    tail = both.filter((F.col("first") > HEAD) & (F.col("base") > REACH)).select("id", (F.col("base") + behind).cast("long").alias("place"))
    return moved.unionByName(tail)

"""Operators on small fixtures against plain Python."""

import math
import random
import re

from gleanery.functions import text as T
from gleanery.operators import graph, ranks, signals
from pyspark.sql import functions as F


def test_trigrams_are_the_distinct_windows_of_three(spark):
    texts = ["", "a", "ab", "abc", "aaaa", "héllo wörld", "a𝄞bc", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", T.trigrams(F.col("t")).alias("g")).collect()
    for r in rows:
        t = texts[r["id"]] or ""
        assert sorted(r["g"]) == sorted({t[i : i + 3] for i in range(len(t) - 2)})


def test_mean_ranks_share_ties_and_the_tail(spark):
    rng = random.Random(5)
    scores = [(i, rng.choice([None, 0.0, 1.0, 2.5, 2.5, 7.0, float(i)])) for i in range(300)]
    found = {r["id"]: r["r"] for r in ranks.mean_ranks(spark.createDataFrame(scores, "id int, s double"), "s", "r").collect()}
    known = [s for _, s in scores if s is not None]
    for i, s in scores:
        want = (len(known) + len(scores) - 1) / 2 + 1 if s is None else sum(x > s for x in known) + (known.count(s) + 1) / 2
        assert found[i] == want


def test_positions_are_gapless_and_break_ties_by_id(spark):
    rng = random.Random(6)
    scores = [(i, float(rng.randrange(20))) for i in range(400)]
    found = {r["id"]: r["position"] for r in ranks.positions(spark.createDataFrame(scores, "id int, s double"), "s", "id").collect()}
    assert found == {i: p for p, (i, _) in enumerate(sorted(scores, key=lambda x: (-x[1], x[0])), 1)}


def test_ranks_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id int, s double")
    assert ranks.mean_ranks(empty, "s", "r").count() == 0
    assert ranks.positions(empty, "s", "id").count() == 0


def test_bm25_without_query_words_scores_zero(spark):
    tokens = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, tokens array<string>")
    assert {r["score"] for r in signals.bm25(tokens, []).collect()} == {0.0}
    scores = {r["id"]: r["score"] for r in signals.bm25(tokens, ["a"]).collect()}
    assert scores[1] > 0 == scores[2]


def test_components_of_long_chains_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + i // 2) for i in range(1, 200)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(80)] + [(5000, 5000)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {n: find(n) for n in root}


def test_fold_keeps_no_mark_and_no_ligature(spark):
    texts = ["Élan Öl STRASSE Straße", "ﬁne ﬂow", "Ａｂｃ １", "İstanbul naïve", "ﬀ e\u0301", "Łódź ø", "日本語 теСт", None]
    want = ["elan ol strasse strasse", "fine flow", "abc 1", "istanbul naive", "ff e", "łodz ø", "日本語 тест", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.normalize(F.col("t")).alias("n")).orderBy("id").collect()
    assert [r["n"] for r in rows] == want
    words = ["buses", "classes", "boxes", "studies", "gas", "bus", "analysis", "ties", "cats", "heroes"]
    found = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, w string").select("id", T.singular(F.col("w")).alias("s")).orderBy("id").collect()
    assert [r["s"] for r in found] == ["bus", "class", "box", "study", "gas", "bus", "analysis", "tie", "cat", "heroe"]


def test_of_equal_prices_the_first_order_represents(spark):
    from gleanery.plans.relational import e17_library_rollup
    from gleanery.stage import fresh

    folder = fresh(spark, "tables")
    rows = [(3, 1, "F", 5.0), (1, 1, "O", 5.0), (2, 1, "F", 5.0), (9, 1, "F", None), (4, 2, "F", 1.0), (None, 2, "F", 7.0)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    orders.withColumn("o_orderdate", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    assert {r["c_custkey"]: r["representative"] for r in e17_library_rollup(spark, folder).collect()} == {1: 1, 2: 4}


def test_a_filter_repeats_no_regular_expression(spark):
    from gleanery.operators import signals
    from gleanery.sources import tables

    found = signals.block_score(tables.pool(spark, "/root/testdata/sf0.001"), {"x": ["a", "b"], "y": ["c", "d"]}).filter("forms > 0")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3  # the text's chunks, the title's words, all words


def test_the_graph_of_components_shrinks_by_rounds(spark, monkeypatch):
    sizes = []

    def counted(df, tag, stored=graph.stored):
        kept = stored(df, tag)
        sizes.extend([kept.count()] if tag == "edges" else [])
        return kept

    monkeypatch.setattr(graph, "stored", counted)
    assert graph.components(spark.range(600).selectExpr("id AS src", "id + 1 AS dst")).filter("root = 0").count() == 601
    assert sizes[-1] == 0 and len(sizes) > 3 and all(b < 0.8 * a for a, b in zip(sizes, sizes[1:]) if a > 50)


def test_words_cut_at_their_gaps_are_the_words(spark):
    rng = random.Random(8)
    texts = ["", "-", "a", "-a-", "a-b", "a--b", "'tis don’t", "a-\n", "x- y", "𝒜-b 𝄞 c", "é'", None] + ["".join(rng.choice("ab1é𝒜-'’ .\n") for _ in range(rng.randrange(12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.words(F.col("t")).alias("w"), T.split_words(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == [r["w"] for r in rows]


def test_tfidf_counts_words_inside_their_rows(spark, monkeypatch):
    monkeypatch.setattr(signals, "COMMON_WORDS", 2)  # most words are met in the shuffle
    tokens = spark.createDataFrame([(1, ["a", "b", "a", "c"]), (2, ["a", "c", "d"]), (3, []), (4, ["a"]), (5, ["b", "e"])], "id long, tokens array<string>")
    seeds = spark.createDataFrame([(9, ["b", "b", "c", "x"]), (8, ["d", "e"])], "id long, tokens array<string>")
    found = signals.tfidf(tokens, seeds)
    df = {"a": 3, "b": 2, "c": 2, "d": 1, "e": 1}

    def vector(words):
        raw = {w: (1 + math.log(words.count(w))) * math.log(5 / df[w]) for w in words if w in df}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    theirs = [vector(r["tokens"]) for r in seeds.collect()]
    want = {r["id"]: round(max((sum(x * v.get(w, 0) for w, x in vector(r["tokens"]).items()) for v in theirs), default=0), 6) for r in tokens.collect()}
    assert {r["id"]: r["score"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\d+L?, word#", plan)


def test_an_inverted_index_is_built_and_read_without_a_shuffle(spark):
    texts = ["a b a", " x  x ", "one", "", None, "𝒜 b\tc 𝒜"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.inverted_index("t").alias("index"))
    back = df.select("id", "index", T.from_inverted_index(F.col("index")).alias("t"))
    rows = {r["id"]: r for r in back.collect()}
    assert [rows[i]["t"] for i in range(6)] == [t or "" for t in texts]
    assert [(e["word"], e["positions"]) for e in rows[0]["index"]] == [("a", [0, 2]), ("b", [1])]
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()


def test_similarity_by_numbers_is_that_of_the_trigram_sets(spark):
    rng = random.Random(9)
    made = lambda: "".join(rng.choice("abé𝒜ß \n<$") for _ in range(rng.randrange(14)))
    pairs = [(None, "abc"), ("abc", ""), ("ab", "abc"), ("aaaa", "aaa")] + [(made(), made()) for _ in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, a string, b string")
    both = df.withColumns({"x": T.normalize(F.col("a")), "y": T.normalize(F.col("b"))})
    old = both.select("id", F.when((F.col("x") != "") & (F.col("y") != ""), T.jaccard(T.trigrams(F.col("x")), T.trigrams(F.col("y")))).alias("s"))
    found = T.similarity(df, "a", "b")
    assert {r["id"]: r["similarity"] for r in found.collect()} == {r["id"]: r["s"] for r in old.collect()}
    assert "zip_with" not in found._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_islands_grow_with_the_rows(spark, monkeypatch):
    from gleanery.operators import selection

    monkeypatch.setattr(selection, "ISLAND_ROWS", 10)
    rows = spark.range(1000).selectExpr("id % 7 AS k", "id DIV 7 + IF(id > 500, 3, 0) AS p")
    found = selection.islands(rows.unionByName(rows), ["k"], "p")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and ", 200)" in plan
    want = {}
    for r in sorted({(r["k"], r["p"]) for r in rows.collect()}):
        runs = want.setdefault(r[0], [])
        if runs and runs[-1][1] == r[1] - 1:
            runs[-1][1] = r[1]
        else:
            runs.append([r[1], r[1]])
    assert sorted((r["k"], r["first"], r["last"], r["n"]) for r in found.collect()) == [(k, a, b, b - a + 1) for k in sorted(want) for a, b in want[k]]

import hashlib
import random

from gleanery.llm import exact_dedup
from tests.llm.helpers import docs_of, noisy, rows_of


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, keep=max):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    return sorted((i, keep(groups[low(t)]), len(groups[low(t)]), i == keep(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows)


def got(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows_of(df))


def test_matches_brute_force_with_a_hot_group_and_odd_texts(spark):
    rng = random.Random(1)
    texts = ["Hot", "hOT"] * 150 + ["", None, "É", "é", "İ", "Straße", "STRASSE", "a" * 50_000] + [rng.choice("abcAB") * rng.randrange(3) for _ in range(80)]
    df = docs_of(spark, texts)
    want = brute([(i + 1, t) for i, t in enumerate(texts)])
    assert got(exact_dedup.exact_dedup(df)) == want
    assert got(exact_dedup.exact_dedup(noisy(df))) == want


def test_smallest_id_can_stay_and_any_tree_shape_gives_the_same(spark):
    df = docs_of(spark, ["x", "X", "y", "x"])
    assert got(exact_dedup.exact_dedup(df, keep="min")) == brute([(1, "x"), (2, "X"), (3, "y"), (4, "x")], min)
    rows = df.selectExpr("doc_id as id", "cast(lower(text) as binary) as digest", "1L as bytes")
    shapes = [sorted(map(tuple, exact_dedup.merge_runs(rows, "max", leaves, fan).collect())) for leaves, fan in ((1, 2), (7, 2), (64, 8), (100, 3))]
    assert all(s == shapes[0] for s in shapes)


def test_repeated_rows_and_an_empty_table(spark):
    df = docs_of(spark, ["x", "y"]).union(docs_of(spark, ["x"]))
    assert got(exact_dedup.exact_dedup(df)) == brute([(1, "x"), (2, "y"), (1, "x")])
    assert got(exact_dedup.exact_dedup(docs_of(spark, []))) == []


def test_main_path_is_native(spark):
    plan = exact_dedup.exact_dedup(docs_of(spark, ["x"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_round_keeps_the_winners_of_the_runs_that_met(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(9), f"{rng.randrange(40):02d}".encode() * 6) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, leaf int, digest binary").selectExpr("*", "1L as bytes")
    runs, width = exact_dedup.leaf_runs(df), 1
    for ranges in [None, *exact_dedup.rounds_of(9, 3)]:
        if ranges:
            runs, width = exact_dedup.merge_round(runs, ranges, fan_in=3), width * 3
        want = {}
        for i, leaf, digest in rows:
            best, n = want.get((leaf // width, digest), (-1, 0))
            want[leaf // width, digest] = (max(best, i), n + 1)
        assert {(r["leaf"], bytes(r["digest"])): (r["keep_id"], r["group_size"]) for r in rows_of(runs)} == want
    assert {leaf for leaf, _ in want} == {0}


def test_rounds_merge_sorted_runs(spark):
    runs = spark.createDataFrame([(1, b"a", 2, 1, 1)], "leaf int, digest binary, bytes long, keep_id long, group_size long")
    with exact_dedup._sorted_merges(spark):
        plan = exact_dedup.merge_round(runs, 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan and "Python" not in plan


def test_null_ids_and_other_hashes(spark):
    df = spark.createDataFrame([(None, "x"), (1, "X"), (None, "y"), (None, "y"), (2, "z")], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows_of(exact_dedup.exact_dedup(df))), key=str)
    assert found == sorted([(None, 1, 2, False), (1, 1, 2, True), (None, None, 2, True), (None, None, 2, True), (2, 2, 1, True)], key=str)
    same = spark.createDataFrame([(1, b"d", 1, 5, 0), (2, b"d", 1, 6, 1), (3, b"d", 1, 5, 1)], "id long, digest binary, bytes long, check long, leaf int")
    assert sorted((r["check"], r["keep_id"], r["group_size"]) for r in rows_of(exact_dedup.merge_runs(same, leaves=2, fan_in=2))) == [(5, 3, 2), (6, 2, 1)]

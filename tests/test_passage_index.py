"""Search by block maxima against BM25 by its formula over every passage."""

import math
import random
import re
from collections import Counter

import pytest

from gleanery.operators import passage_index as P


pytestmark = pytest.mark.usefixtures("few_partitions")

WORDS = [f"w{i}" for i in range(120)]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [WORDS[min(int(rng.expovariate(0.08)), 119)] for _ in range(rng.randrange(40))]
        if i % 97 == 0:
            words += ["rare"] * rng.randrange(1, 4)
        if i % 40 == 0:
            words += ["peak"] * (9 if i in (400, 1200, 3600) else 1)
        rows.append((i, f"s{rng.randrange(6)}" if i % 3 else "hot", " ".join(words)))
    return rows + [(n, "s0", None), (n + 1, "s1", " . ")]


def brute(rows, text, k, allowed=None, pinned=None, per_source=None):
    tokens = {i: re.findall(r"\w+", t or "") for i, _, t in rows}
    n, avg = len(rows), sum(map(len, tokens.values())) / len(rows)
    df = Counter(w for t in tokens.values() for w in set(t))
    out = []
    for i, s, _ in rows:
        if (allowed is not None and s not in allowed) or (pinned and s in pinned and i not in pinned[s]):
            continue
        c = Counter(tokens[i])
        held = [w for w in dict.fromkeys(re.findall(r"\w+", text.lower())) if c[w]]
        if held:
            idf = lambda w: max(1e-6, math.log((n - df[w] + 0.5) / (df[w] + 0.5)))
            out.append((round(sum(idf(w) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(tokens[i]) / avg)) for w in held), 9), i, s))
    out.sort(key=lambda r: (-r[0], r[1]))
    seen, kept = Counter(), []
    for score, i, s in out:
        seen[s] += 1
        if per_source is None or seen[s] <= per_source:
            kept.append((i, score))
    return kept[:k]


QUERIES = [(1, "w0 w3 rare"), (2, "W7, w7 and w11"), (3, "nothing known"), (4, None), (5, "w2"), (6, "rare w90 w100 w110"), (7, "peak")]


@pytest.fixture(scope="module")
def indexed(spark):
    rows = corpus(6000, 3)
    held, P.SEGMENT_BITS = P.SEGMENT_BITS, 6
    index = P.build(spark.createDataFrame(rows, "passage_id long, source string, text string").repartition(5))
    P.SEGMENT_BITS = held
    return rows, index


def hits(found):
    out = {}
    for r in found.hits.orderBy("query", "place").collect():
        out.setdefault(r["query"], []).append((r["id"], r["score"]))
    return out


def close(got, want):
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-6 for (_, a), (_, b) in zip(got, want))


def test_equals_every_passage_scored_and_leaves_segments_unread(spark, indexed):
    rows, index = indexed
    found = P.search(index, spark.createDataFrame(QUERIES, "query long, text string"), k=3)
    got = hits(found)
    for q, text in QUERIES:
        close(got.get(q, []), brute(rows, text or "", 3))
    turns = Counter((r["query"], r["turn"]) for r in found.read.collect())
    assert turns[(7, 0)] > 50 and turns[(7, 1)] + turns[(7, 2)] < 40  # most segments that hold the word are never read
    assert sum(n for (_, turn), n in turns.items() if turn == 0) > 100
    got = hits(P.search(index, spark.createDataFrame(QUERIES, "query long, text string"), k=200))
    for q, text in QUERIES:
        close(got.get(q, []), brute(rows, text or "", 200))


def test_limits_hold_before_the_cut(spark, indexed):
    rows, index = indexed
    queries = spark.createDataFrame(QUERIES[:2], "query long, text string")
    allowed = spark.createDataFrame([(1, "s1"), (1, "s2"), (2, "hot"), (2, "hot")], "query long, source string")
    pins = {"s1": {r[0] for r in rows if r[1] == "s1"} & set(range(0, 6000, 7)), "hot": {3, 9, 33}}
    pinned = spark.createDataFrame([(q, s, i) for q in (1, 2) for s, ids in pins.items() for i in ids], "query long, source string, id long")
    got = hits(P.search(index, queries, 8, allowed, pinned))
    close(got[1], brute(rows, QUERIES[0][1], 8, {"s1", "s2"}, pins))
    close(got.get(2, []), brute(rows, QUERIES[1][1], 8, {"hot"}, pins))
    got = hits(P.search(index, queries, 12, per_source=2))
    for q, text in QUERIES[:2]:
        close(got[q], brute(rows, text, 12, per_source=2))


def test_no_list_gathers_a_common_term(spark, indexed):
    _, index = indexed
    lists = index.read(spark, "postings")
    assert lists.agg({"n": "max"}).first()[0] <= 64 and lists.filter("term = 'w0'").count() > 50


def test_empty_inputs(spark, indexed):
    empty = P.build(spark.createDataFrame([], "passage_id long, source string, text string"))
    assert P.search(empty, spark.createDataFrame(QUERIES, "query long, text string")).hits.count() == 0
    assert P.search(indexed[1], spark.createDataFrame([], "query long, text string")).hits.count() == 0


def test_a_segment_gives_a_query_at_most_k_rows(spark, indexed):
    rows, index = indexed
    asked = P._asked(index, spark.createDataFrame([(5, "w0 w2")], "query long, text string"))
    tried = P.bounds(index, asked, 3)
    found = P._scores(index, asked, tried.selectExpr("query", "segment", "CAST(NULL AS DOUBLE) AS floor"), None, None, 3, 2).collect()
    assert len(found) <= 3 * tried.count() < sum("w2" in (t or "").split() for _, _, t in rows)
    best = sorted(((-r["score"], r["id"]) for r in found))[0]
    assert best[1] == brute(rows, "w0 w2", 1)[0][0]
    assert "ids" not in index.read(spark, "postings").columns  # ids and sources stand once a segment

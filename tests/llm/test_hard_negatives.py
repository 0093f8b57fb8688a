import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import hard_negatives as hn
from tests.llm.helpers import noisy, rows_of

SCHEMA = "vec_id long, embedding array<float>, label int"
KEYS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def table_of(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(rows, every=10, positives=5, negatives=5, low=80, high=100):
    """Every anchor against every row, by the definition."""
    kept = []
    for id_, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((id_, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    last = lambda i: (i is None, i or 0)
    for a, (id_, v, label) in enumerate(kept):
        if id_ is None or id_ % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, l) for b, (i, w, l) in enumerate(kept) if b != a]
        mine = sorted((s for s in scored if s[2] == label), key=lambda s: (-s[0], last(s[1])))[:positives]
        for p, positive, _ in mine:
            fits = [s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p]
            for r, (s, i, _) in enumerate(sorted(fits, key=lambda s: (-s[0], last(s[1])))[:negatives], 1):
                out.append((id_, positive, r, i, p, s))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[k] for k in KEYS) for r in rows_of(df)), key=repr)


def vectors(n, d, seed, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(d)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = rng.randrange(labels)
        out.append((i, [c + rng.gauss(0, 0.25) for c in centres[label]], label if rng.random() < 0.8 else rng.randrange(labels)))
    return out


def mined(rows, every=10, **options):
    return hn.mine(rows, F.col("vec_id") % every == 0, **options)


def test_equals_every_anchor_against_every_row(spark, monkeypatch):
    rows = vectors(900, 6, 1)
    assert found(mined(table_of(spark, rows))) == brute(rows)
    assert found(mined(table_of(spark, rows), turn=17)) == brute(rows)  # several turns
    assert found(mined(table_of(spark, rows), positives=2, negatives=9, low=50, high=90)) == brute(rows, positives=2, negatives=9, low=50, high=90)


def test_ties_and_repeated_rows(spark):
    """A third of the rows hold one vector; some rows come twice; components are few, so scores tie."""
    rng = random.Random(3)
    rows = [(i, [rng.choice((0.0, 0.25, 0.5)) for _ in range(3)] if i % 3 else [0.25, 0.25, 0.25], rng.randrange(3)) for i in range(400)]
    rows += rows[:40] + [(100, [0.5, 0.5, 0.5], 1)]
    assert found(mined(table_of(spark, rows))) == brute(rows)


def test_nulls_odd_lengths_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 4, 5, labels=2)
    rows += [(None, [0.5] * 4, 0), (100, None, 1), (110, [0.1] * 4, None), (120, [nan, 0.1], 0), (130, [inf], 0), (140, [None, 0.2], 1), (150, [], 1), (160, [0.4, 0.1], 0), (170, [0.3] * 6, 1)]
    assert found(mined(noisy(table_of(spark, rows)))) == brute(rows)
    assert found(mined(table_of(spark, []))) == []
    assert found(mined(table_of(spark, [(3, [0.1], 1)]))) == []
    assert found(mined(table_of(spark, [(0, [0.1], 1), (1, [0.2], 1), (2, [0.1], 2)]))) == brute([(0, [0.1], 1), (1, [0.2], 1), (2, [0.1], 2)])


def test_vectors_beyond_the_key_are_refused(spark):
    with pytest.raises(Exception, match="scale the vectors down"):
        mined(table_of(spark, [(0, [9e5] * 8, 1), (10, [9e5] * 8, 1)])).collect()
    with pytest.raises(Exception, match="scale the vectors down"):
        mined(table_of(spark, [(0, [9e30], 1)])).collect()


def test_trees_leave_nodes_out():
    """Clusters far apart: a question about one visits few leaves, and loses nothing."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 8)) * 400
    points = np.rint(np.concatenate([c + rng.normal(size=(512, 8)) * 5 for c in centres])).astype(np.int32)
    n = len(points)
    tree = hn.BallTree(np.arange(n), np.zeros(n, bool), np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool), points)
    visited = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, tuple):
                visited.append(at[0])
            return super().__getitem__(at)

    tree.vectors = tree.vectors.view(Counted)
    q = points[:1]
    ask = {"of": np.zeros(1, np.int64), "label": np.zeros(1, np.int64), "row": np.zeros(1, np.int64), "low": np.array([-(1 << 40)]), "high": np.array([1 << 40]), "kth": np.array([-(1 << 40)])}
    score, ids, _ = tree.unpack(tree.search(q, ask, True, 5))
    assert len(visited) < len(tree.nodes["span"]) // 4
    every = points.astype(np.int64) @ q[0]
    best = sorted(range(1, n), key=lambda i: (-every[i], i))[:5]
    assert sorted(ids[0].tolist()) == sorted(best) and sorted(score[0].tolist()) == sorted(every[best].tolist())
    leaves = [tuple(s) for s, c in zip(tree.nodes["span"], tree.nodes["child"]) if c[0] < 0]
    assert sorted(leaves)[0][0] == 0 and sum(b - a for a, b in leaves) == n and max(b - a for a, b in leaves) <= hn.LEAF


def test_trees_of_many_rows_meet(spark, monkeypatch):
    rows = vectors(2 * hn.TREE_ROWS // 8 * 9 // 8, 3, 8, labels=5)
    assert found(mined(table_of(spark, rows, 2), every=200)) == brute(rows, every=200)

import random
import zlib

import numpy as np

from gleanery.llm import sharding
from tests.llm.helpers import docs_of, noisy, rows_of


def check(found, texts, shards):
    assert len(found) == len(texts)
    for r in found:
        raw = (texts[r["doc_id"] - 1] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        assert 0 <= r["shard"] < shards
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_are_near_equal_with_a_hot_group(spark):
    rng = random.Random(4)
    texts = ["hot text " * 20] * 700 + [None, "", "x" * 3000] + ["y" * rng.randrange(10, 900) + str(i) for i in range(1300)]
    df = docs_of(spark, texts)
    found = rows_of(sharding.shards(df, 8))
    check(found, texts, 8)
    size = np.bincount([r["shard"] for r in found], [r["size"] for r in found], minlength=8)
    assert size.max() - size.min() < 0.01 * size.mean(), size
    again = rows_of(sharding.shards(noisy(df).repartition(3), 8))
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in found) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in again)


def test_small_groups_stay_whole(spark):
    texts = [f"group {i // 3} " * 30 for i in range(300)]
    found = {r["doc_id"]: r["shard"] for r in rows_of(sharding.shards(docs_of(spark, texts), 4))}
    assert all(len({found[i + 1] for i in range(300) if i // 3 == g}) == 1 for g in range(100))


def test_rows_keep_their_columns(spark):
    texts = ["a", "b", None, "a"]
    df = noisy(docs_of(spark, texts))
    found = rows_of(sharding.shard_rows(df, 2))
    check(found, texts, 2)
    assert {"text", "source", "size_", "shard_", "cell", "fp"} <= set(found[0])
    assert [r["text"] for r in sorted(found, key=lambda r: r["doc_id"])] == texts


def test_empty_table_repeats_and_fewer_rows_than_shards(spark):
    assert rows_of(sharding.shards(docs_of(spark, []))) == []
    found = rows_of(sharding.shards(docs_of(spark, ["a"]).union(docs_of(spark, ["a"])), 40))
    check(found, ["a", "a"], 40)


def test_packing_places_everything_and_uses_every_dimension():
    vectors = np.array([[10, 1, 1]] * 10 + [[1, 10, 1]] * 10, float)
    placed = sharding.pack(vectors, 2)
    assert sorted(np.bincount(placed, vectors[:, 0])) == [55, 55]


def greedy(vectors, shards):
    """The packing rule in plain Python, without the levelling that follows it."""
    total = [max(1, sum(v[k] for v in vectors)) for k in range(3)]
    need = [[v[k] / total[k] * shards for k in range(3)] for v in vectors]
    left = [[1.0] * 3 for _ in range(shards)]
    out = [0] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: (-max(need[i]), i)):
        dot = [sum(a * b for a, b in zip(left[s], need[i])) for s in range(shards)]
        fits = [s for s in range(shards) if all(left[s][k] >= need[i][k] - 1e-12 for k in range(3))] or [s for s in range(shards) if left[s][0] >= need[i][0] - 1e-12]
        out[i] = max(fits, key=lambda s: (dot[s], -s)) if fits else max(range(shards), key=lambda s: (left[s][0], -s))
        left[out[i]] = [a - b for a, b in zip(left[out[i]], need[i])]
    return out


def test_packing_equals_the_rule_in_plain_python(monkeypatch):
    monkeypatch.setattr(sharding, "_level", lambda vectors, placed, shards: placed)
    rng = random.Random(6)
    for shards in (1, 3, 7):
        vectors = [[rng.randrange(1, 4096), rng.randrange(64), 1 + rng.randrange(3)] for _ in range(120)]
        assert sharding.pack(np.array(vectors, float), shards).tolist() == greedy(vectors, shards)


def test_all_three_measures_are_balanced_and_bytes_most():
    rng = np.random.default_rng(5)
    size = rng.lognormal(5, 1.5, 4000).round()
    vectors = np.stack([size, (size / rng.uniform(4, 8, 4000)).round(), np.ones(4000)], axis=1)
    placed = sharding.pack(vectors, 20)
    for k, most in enumerate((0.001, 0.05, 0.05)):
        sums = np.bincount(placed, vectors[:, k], 20)
        assert sums.max() - sums.min() <= most * sums.mean() + 1, (k, sums)


def test_a_group_is_split_only_beyond_a_shard(spark):
    texts = ["half a shard " * 40] * 20 + ["over one " * 40] * 90 + [f"small {i} " * 40 for i in range(60)]
    found = {r["doc_id"]: r["shard"] for r in rows_of(sharding.shards(docs_of(spark, texts), 4))}
    assert len({found[i] for i in range(1, 21)}) == 1
    assert len({found[i] for i in range(21, 111)}) > 1


def test_long_units_count_slots_in_parts(spark):
    texts = ["hot text " * 20] * 300 + [f"{i} " * 9 for i in range(200)]
    df = docs_of(spark, texts)
    for f in (sharding.shards, sharding.shard_rows):
        check(rows_of(f(df, 3, cells_per_shard=2, part_rows=10)), texts, 3)


def test_tokens_may_be_given_and_null_ids_are_placed(spark):
    df = spark.createDataFrame([(None, "a b", 5), (None, "a b", 5), (1, None, None), (1, "c", 2)], "doc_id long, text string, n long")
    found = rows_of(sharding.shards(df, 2, tokens_col="n"))
    assert sorted((r["shard"], r["slot"]) for r in found) == [(0, 0), (0, 1), (1, 0), (1, 1)]

import hashlib
import math
import random
import re
import zlib

import pytest

from gleanery.llm import resampling
from tests.llm.helpers import docs_of, noisy, rows_of

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, orders):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORDS.findall(low)
    return words, [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least=20, orders=1, buckets=10_000, seed=2024):
    """The rule, document by document."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for rows, counts in ((docs, s), (target, t)):
        for _, text in rows:
            for g in grams(text, orders)[1]:
                counts[bucket(g)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((y + 1) * (S + buckets) / ((x + 1) * (T + buckets)))) for x, y in zip(s, t)]
    out = []
    for id_, text in docs:
        words, found = grams(text, orders)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([id_, len(found), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(df):
    return sorted((tuple(r[k] for k in ("doc_id", "n_features", "weight", "score", "rank")) for r in rows_of(df)), key=repr)


def texts_of(n, seed, low=0, high=80):
    rng = random.Random(seed)
    voc = ["Alpha", "beta", "it's", "x-y", "ÜBER", "naïve", "日本", "42", "İ", "end."] + [f"w{i}" for i in range(60)]
    return [rng.choice([" ", "\n", ", "]).join(rng.choice(voc) for _ in range(rng.randrange(low, high))) for _ in range(n)]


def target_of(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "item_id string, text string")


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_equals_the_rule_for_every_order(spark, orders):
    texts = [*texts_of(240, 1), None, "", "  .  ", "one", "two words", "long " * 30_000]
    wanted = [*texts_of(12, 2), None, ""]
    got = resampling.resample(docs_of(spark, texts), target_of(spark, wanted), orders=orders, buckets=500, percent=30)
    assert found(got) == brute(list(enumerate(texts, 1)), list(enumerate(wanted)), orders=orders, buckets=500, percent=30)


def test_repeated_rows_null_ids_and_clashing_names(spark):
    """Equal rows draw equal noise; their ranks follow each other."""
    texts = texts_of(30, 5, 25)
    rows = [(i % 7 if i % 3 else None, t, "a") for i, t in enumerate(texts)] + [(99, "same words again " * 10, "a")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = found(resampling.resample(noisy(docs), target_of(spark, texts[:3]), percent=50))
    want = brute([r[:2] for r in rows], list(enumerate(texts[:3])), percent=50)
    key = lambda rs: sorted((r[0] is None, r[0] or 0, r[1:4], r[4] or 0) for r in rs)
    assert key(got) == key(want) and sorted(r[4] for r in got if r[4]) == list(range(1, 36))


def test_empty_inputs(spark):
    docs, none = docs_of(spark, texts_of(25, 6, 20)), target_of(spark, [])
    assert found(resampling.resample(docs, none)) == brute([(r["doc_id"], r["text"]) for r in rows_of(docs)], [])
    assert found(resampling.resample(docs_of(spark, []), target_of(spark, ["a"]))) == []
    assert all(r[4] is None for r in found(resampling.resample(docs_of(spark, ["a", None]), target_of(spark, ["a"]))))


def test_order_one_moves_no_words(spark):
    plan = resampling.bucket_counts(docs_of(spark, ["a b"]), "text", 1, 10, "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan

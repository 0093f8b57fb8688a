import random
import time
import zlib

import numpy as np
import pytest

from gleanery.llm import toxicity
from tests.llm.helpers import docs_of, noisy, rows_of


def corpus(n=700, seed=6):
    rng = random.Random(seed)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(voc) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "lowei" + rng.choice(voc)]))
        texts.append(" ".join(words))
        labels.append((i + 1, int(toxic)))
    return texts, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_held_out_accuracy_and_the_contract(spark):
    texts, labels = corpus()
    found = {r["doc_id"]: r for r in rows_of(toxicity.score(docs_of(spark, texts), labels_of(spark, labels)))}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in found.items())
    held = [(found[i]["predicted"], y) for i, y in labels if found[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_held_out_labels_are_never_read(spark):
    texts, labels = corpus(200)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    key = lambda ls: sorted((r["doc_id"], r["score"]) for r in rows_of(toxicity.score(docs_of(spark, texts), labels_of(spark, ls))))
    assert key(labels) == key(turned)


def test_pairs_are_learned_that_no_weight_can_show():
    rng = random.Random(1)
    terms = np.arange(4, dtype=np.uint32)
    rows, y = [], []
    for _ in range(1500):
        at = [k for k in (0, 1) if rng.random() < 0.5] + [k for k in (2, 3) if rng.random() < 0.5]
        rows.append(np.array(at, np.int64))
        y.append(float(0 in at and 1 in at))
    model = toxicity.FactorizationMachine(terms)
    model.fit(rows, np.array(y))
    assert np.mean([(model.logit(r) >= 0) == (t == 1) for r, t in zip(rows, y)]) > 0.97
    assert model.p["V"][0] @ model.p["V"][1] > 0.5


def test_edges(spark):
    texts = [None, "", "x", "x"]
    none = labels_of(spark, [])
    assert {r["score"] for r in rows_of(toxicity.score(docs_of(spark, texts), none))} < {1 / (1 + np.exp(30.0)), 9.357622968839299e-14, 9.357622968840175e-14}
    odd = labels_of(spark, [(1, None), (None, 1), (3, 1), (3, 0), (99, 1)])
    assert len(rows_of(toxicity.score(noisy(docs_of(spark, texts)), odd))) == 4
    assert rows_of(toxicity.score(docs_of(spark, []), odd)) == []
    long, labels = corpus(300)
    kept = rows_of(toxicity.drop_toxic(noisy(docs_of(spark, [*long, "idiot " + "calm " * 20_000, None])), labels_of(spark, labels)))
    ids = {r["doc_id"] for r in kept}
    assert 301 not in ids and 302 in ids and "g_score" not in kept[0] and kept[0]["score"] == "x"


def exclusive(terms, share, n=3000, seed=1):
    """Rows of about ``terms`` terms labelled by exactly one of the first two."""
    rng = np.random.default_rng(seed)
    held = rng.random((n, int(terms / share))) < share
    held[:, :2] = rng.random((n, 2)) < 0.5
    return [np.flatnonzero(h) for h in held], (held[:, 0] != held[:, 1]).astype(float)


@pytest.mark.parametrize("terms", [20, 100, 500])
def test_factors_carry_what_no_weight_can_whatever_the_length(terms, monkeypatch):
    """An additive model stays at chance; with factors the same rows are told apart, at 500 terms as at 20."""
    rows, y = exclusive(terms, 0.4)
    model = toxicity.FactorizationMachine(int(max(map(max, rows))) + 1)
    began = time.perf_counter()
    model.fit(rows[:2400], y[:2400])
    assert time.perf_counter() - began < 20
    right = lambda m: np.mean((m.logits(rows[2400:]) >= 0) == y[2400:])
    assert right(model) >= 0.95
    monkeypatch.setattr(toxicity.FactorizationMachine, "_fit_factors", lambda *_: None)
    additive = toxicity.FactorizationMachine(model.slots)
    additive.fit(rows[:2400], y[:2400])
    assert right(additive) < 0.6
    model.p["V"][:], model.active = 0, None
    assert right(model) < 0.8  # what is left of the fitted model knows that either word matters, not that both do


def test_no_factors_where_no_pair_stands_out():
    rows, _ = exclusive(100, 0.4)
    y = np.array([float(3 in r) for r in rows])
    model = toxicity.FactorizationMachine(int(max(map(max, rows))) + 1)
    model.fit(rows, y)
    assert not model.p["V"].any() and np.mean((model.logits(rows) >= 0) == y) > 0.99


def test_a_corpus_labelled_by_exactly_one_of_two_words(spark):
    """No single term differs between the labels; texts of about 100 terms, through Spark."""
    rng = random.Random(2)
    voc = [f"{a}{b}" for a in "bcdfghjklmnpqrstvwxz" for b in "aeiouyäöüéèê"]
    texts, labels = [], []
    for i in range(3000):
        words = [w for w in voc[2:] if rng.random() < 0.4] + [w for w in voc[:2] if rng.random() < 0.5]
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i + 1, int((voc[0] in words) != (voc[1] in words))))
    found = {r["doc_id"]: r for r in rows_of(toxicity.score(docs_of(spark, texts), labels_of(spark, labels)))}
    held = [(found[i]["predicted"], y) for i, y in labels if found[i]["held_out"]]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_scores_equal_every_pair_summed_one_by_one(spark):
    """Brute force: the fitted model's own numbers, added up term by term and pair by pair."""
    texts, labels = corpus(300)
    texts += [None, "", "one", "idiot idiot " * 30]
    docs = docs_of(spark, texts)
    model = toxicity.train(docs, labels_of(spark, labels))
    for r in rows_of(toxicity.score(docs, labels_of(spark, labels))):
        at = sorted({int(i) % toxicity.SLOTS for i in toxicity.term_ids(texts[r["doc_id"] - 1])})
        logit = model.p["b"][0] + sum(model.p["w"][i] for i in at)
        logit += sum(float(model.p["V"][i].astype(float) @ model.p["V"][j]) for k, i in enumerate(at) for j in at[:k])
        assert abs(r["score"] - 1 / (1 + np.exp(-logit))) < 1e-4


def test_rows_that_share_an_id_are_learned_from_together(spark):
    texts, labels = corpus(120)
    docs = docs_of(spark, texts).union(docs_of(spark, texts[60:] + texts[:60]))
    one = toxicity.train(docs, labels_of(spark, labels)).p
    two = toxicity.train(docs.repartition(5), labels_of(spark, labels)).p
    assert all(np.array_equal(one[k], two[k]) for k in one)

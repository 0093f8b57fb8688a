import random
import zlib

import numpy as np

from gleanery.llm import quality
from tests.llm.helpers import docs_of, noisy, rows_of


def corpus(n=500, seed=4):
    rng = random.Random(seed)
    voc = ["".join(rng.choice("abcdefghklmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(voc) for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.3
        if bad:
            kind = rng.randrange(3)
            if kind == 0:
                words = [f"{w}@@" for w in words]
            elif kind == 1:
                words = [w.upper() for w in words]
            else:
                words = [words[0]] * len(words)
        texts.append(" ".join(words))
        labels.append((i + 1, int(not bad)))
    return texts, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_and_the_contract(spark):
    texts, labels = corpus()
    found = {r["doc_id"]: r for r in rows_of(quality.score(docs_of(spark, texts), labels_of(spark, labels)))}
    assert len(found) == len(texts)
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in found.items())
    assert np.mean([found[i]["predicted"] == y for i, y in labels if held(i)]) > 0.95


def test_held_out_labels_and_ids_are_never_read(spark):
    texts, labels = corpus(150)
    turned = [(i, 1 - y if held(i) else y) for i, y in labels]
    of = lambda ls: sorted((r["doc_id"], round(r["score"], 6)) for r in rows_of(quality.score(docs_of(spark, texts), labels_of(spark, ls))))
    assert of(labels) == of(turned)


def test_votes_equal_every_cosine_by_the_definition(spark):
    """Brute force: each text's latent vector against each labelled one, sorted, ties with the last kept."""
    texts, labels = corpus(300)
    model = quality.train(docs_of(spark, texts), labels_of(spark, labels))
    assert len(model.labels) == sum(not held(i) for i, _ in labels)
    asked = [*texts[:40], texts[0] + " more words", "", None, "unseen"]
    for text, got in zip(asked, model.votes(asked)):
        at, w = model.row(text)
        v = sum((float(x) * model.axes[s].astype(float) for s, x in zip(at, w)), np.zeros(quality.RANK))
        size = np.sqrt(v @ v)
        if size == 0:
            assert abs(got - model.labels.mean()) < 1e-6
            continue
        near = sorted(((float(v @ u) / size, float(y)) for u, y in zip(model.vectors, model.labels)), reverse=True)
        voters = [(max(s, 0) ** quality.SHARP, y) for s, y in near if s >= near[quality.NEIGHBOURS - 1][0] - quality.TIE]
        assert abs(got - sum(s * y for s, y in voters) / sum(s for s, _ in voters)) < 1e-3


def test_axes_are_the_leading_singular_vectors():
    texts, _ = corpus(120)
    model = quality.LatentVotes()
    model.fit(texts)
    dense = np.zeros((len(texts), quality.SLOTS), np.float32)
    for i, text in enumerate(texts):
        at, w = model.row(text)
        np.add.at(dense[i], at, w)
    kept = np.linalg.norm(dense @ model.axes) ** 2
    best = (np.linalg.svd(dense @ dense.T)[1][: quality.RANK]).sum()
    assert kept > 0.99 * best and np.allclose(model.axes.T @ model.axes, np.eye(quality.RANK), atol=1e-3)


def test_edges(spark):
    texts = [None, "", "x", "x"]
    assert {r["score"] for r in rows_of(quality.score(docs_of(spark, texts), labels_of(spark, [])))} == {0.5}
    odd = labels_of(spark, [(1, None), (None, 1), (3, 1), (3, 0), (99, 1)])
    assert len(rows_of(quality.score(noisy(docs_of(spark, texts)), odd))) == 4
    assert rows_of(quality.score(docs_of(spark, []), odd)) == []
    long, labels = corpus(300)
    kept = rows_of(quality.keep_good(noisy(docs_of(spark, [*long, "SHOUTING " * 30_000, None])), labels_of(spark, labels)))
    ids = {r["doc_id"] for r in kept}
    assert 301 not in ids and 302 in ids and "g_score" not in kept[0] and kept[0]["score"] == "x"


def test_of_rows_that_share_an_id_one_is_learned_from(spark):
    texts, labels = corpus(100)
    docs = docs_of(spark, texts).union(docs_of(spark, texts[50:] + texts[:50]))
    one, two = quality.train(docs, labels_of(spark, labels)), quality.train(docs.repartition(5), labels_of(spark, labels))
    assert np.allclose(one.vectors, two.vectors, atol=1e-4) and np.array_equal(one.labels, two.labels) and len(one.labels) <= len(labels)


def test_bounds_of_the_sample(spark):
    texts, labels = corpus(200)
    model = quality.train(docs_of(spark, texts), labels_of(spark, labels), max_rows=60, fit_rows=20)
    assert len(model.labels) == 60

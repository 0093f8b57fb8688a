"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A text is a bag of terms in three families: words in lower case, the surface forms of its words (case and
signs around: ``Aa.``, ``a###``, ``A!!``), and how much it repeats itself (shares of its commonest word, of distinct words
and lines, by steps). Terms are hashed to ``SLOTS`` slots, weighted (1 + ln frequency) * idf, and every family
is brought to unit length, so that thousands of words cannot drown what they look like. Truncated
singular vectors of a bounded sample of labelled rows (``FIT_ROWS``) give the latent space; all labelled
rows up to ``MAX_ROWS`` (those of smallest id hash) are projected and vote. Both are documented bounds of the classifier;
every document is scored, and its whole text.

The labelled vectors and the projection are broadcast: (SLOTS + MAX_ROWS) * RANK single-precision numbers,
about 28 MB, whatever the input. Cosines with all labelled vectors are computed exactly, in blocks of
documents; the ``NEIGHBOURS`` most similar, and all that tie with the last, vote with their similarity
to the power ``SHARP``.

Only the text makes a score. Defined results: a null or empty text holds no term and scores the share of
ones among the labelled; rows whose label is null are not learned from; repeated label rows count once, as the mean, a half counting
as 1; of rows that share a labelled id one is learned from, that of the smallest hash of its text; without any label
the score is 0.5; repeated rows each get their own row; other columns are ignored by ``score`` and kept by
``keep_good``.
"""

from __future__ import annotations

import functools
import string
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, free_name, materialize, tune
from .toxicity import held_out

#: Labelled rows that vote at most, and of these the rows that the singular vectors are fitted on.
MAX_ROWS, FIT_ROWS = 12_000, 4_000
#: Slots of terms, dimensions of the latent space, spare dimensions and rounds of its fit.
SLOTS, RANK, SPARE, ROUNDS = 1 << 17, 48, 12, 3
#: Neighbours that vote, and the power of their similarity.
NEIGHBOURS, SHARP = 15, 4
#: Cosines as close as this count as equal: sums of floats differ with the shape of a block.
TIE = 1e-5
#: Texts whose cosines are computed together; entries of the worker's cache of words.
BLOCK, CACHE = 256, 200_000
#: Share of each family in a text's squared length: words, surface forms, repetition.
FAMILIES = (0.4, 0.35, 0.25)
_SIGNS = string.punctuation
_PAIR = struct.Struct("=ii").pack

def _slot(term: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(term) % SLOTS


@functools.lru_cache(50_000)
def _surface_slot(before: str, kind: str, after: str) -> int:
    return _slot(f"s{before}{kind}{after}")


class _WordSlots(dict):
    """A word's slots, packed: of its letters in lower case and of its surface, the case or kind of its core
    between at most four signs before and after."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        core = word.strip(_SIGNS)
        at = word.find(core) if core else len(word)
        kind = "a" if core.islower() else "A" if core.isupper() else "Aa" if core.istitle() else "0" if core.isdigit() else "x" if core else ""
        found = self[word] = _PAIR(_slot("w" + core.lower()), _surface_slot(word[:at][:4], kind, word[at + len(core) :][:4]))
        return found


_slots = _WordSlots()


@functools.cache
def _steps(name: str, step: int) -> np.ndarray:
    """The slots of the steps that a share reaches, so that near shares have most terms in common."""
    return np.array([_slot(f"r{name}{i}") for i in range(step + 1)], np.int32)


def _counted(slots: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their summed frequencies."""
    order = np.argsort(slots, kind="stable")
    slots = slots[order]
    first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
    return slots[first], np.add.reduceat(n[order], first)


def terms(text: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and frequencies by family; empty arrays for a text without words."""
    words = Counter(text.split()) if text else {}
    if not words:
        return [(np.empty(0, np.int32), np.empty(0, np.float32))] * 3
    both = np.frombuffer(b"".join(map(_slots.__getitem__, words)), np.int32).reshape(-1, 2)
    n = np.fromiter(words.values(), np.float32, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = {"m": n.max() / n.sum(), "d": len(words) / n.sum(), "l": len(set(lines)) / len(lines), "u": sum(map(str.isupper, words)) / len(words)}
    again = np.concatenate([_steps(name, int(share * 20 + 1e-6)) for name, share in shares.items()])
    return [_counted(both[:, 0], n), _counted(both[:, 1], n), _counted(again, np.ones(len(again), np.float32))]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


class LatentVotes:
    """idf and singular vectors, and the labelled vectors that vote."""

    def __init__(self):
        self.idf = np.zeros(SLOTS, np.float32)
        self.axes = np.zeros((SLOTS, RANK), np.float32)
        self.vectors, self.labels = np.zeros((0, RANK), np.float32), np.zeros(0, np.float32)

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots and weights of a text."""
        at, weights = [], []
        for share, (slots, n) in zip(FAMILIES, terms(text)):
            w = (1 + np.log(n)) * self.idf[slots] if len(n) else n
            length = float(np.sqrt((w * w).sum()))
            if length:
                at.append(slots)
                weights.append(w * np.float32(np.sqrt(share) / length))
        return (np.concatenate(at), np.concatenate(weights)) if at else (np.empty(0, np.int32), np.empty(0, np.float32))

    def fit(self, texts: list[str | None], seed: int = 5) -> None:
        """idf and axes of a sample of texts, by randomised subspace iteration."""
        seen = np.zeros(SLOTS)
        for text in texts:
            for slots, _ in terms(text):
                seen[slots] += 1
        self.idf = np.where(seen > 0, np.log((1 + len(texts)) / (1 + seen)) + 1, 0).astype(np.float32)
        rows = [r for r in map(self.row, texts) if len(r[0])]
        if not rows:
            return
        n = np.array([len(a) for a, _ in rows])
        at, w = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
        used, at = np.unique(at, return_inverse=True)
        across = np.argsort(at, kind="stable")
        of = np.repeat(np.arange(len(n)), n)[across]
        by_row, by_slot = _Sparse(at, w, np.cumsum(n) - n), _Sparse(of, w[across], np.searchsorted(at[across], np.arange(len(used))))
        rank = min(RANK + SPARE, len(rows), len(used))
        basis = np.random.default_rng(seed).normal(size=(len(used), rank)).astype(np.float32)
        for _ in range(ROUNDS):
            basis = np.linalg.qr(by_slot.times(by_row.times(basis)))[0].astype(np.float32)
        _, _, turn = np.linalg.svd(by_row.times(basis), full_matrices=False)
        axes = (basis @ turn.T)[:, :RANK]
        self.axes[used, : axes.shape[1]] = axes

    def project(self, texts: list[str | None]) -> np.ndarray:
        """Unit latent vectors; zeros for a text without known terms."""
        out = np.zeros((len(texts), RANK), np.float32)
        for i, text in enumerate(texts):
            at, w = self.row(text)
            if len(at):
                out[i] = w @ self.axes[at]
        return _unit(out).astype(np.float32)

    def votes(self, texts: list[str | None]) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        share = float(self.labels.mean())
        found = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), BLOCK):
            part = self.project(texts[i : i + BLOCK])
            near = part @ self.vectors.T
            last = np.maximum(np.partition(near, -k, axis=1)[:, -k] - TIE, 0)
            row, voter = np.nonzero(near >= last[:, None])
            weight = near[row, voter].astype(np.float64) ** SHARP
            total, ones = np.bincount(row, weight, len(part)), np.bincount(row, weight * self.labels[voter], len(part))
            found[i : i + BLOCK] = np.where(total > 0, ones / np.maximum(total, 1e-12), share)
        return np.clip(found, 0, 1)


class _Sparse:
    """A sparse matrix by rows: columns, values and where each row starts (no row is empty)."""

    def __init__(self, at: np.ndarray, values: np.ndarray, starts: np.ndarray):
        self.at, self.values, self.starts = at, values.astype(np.float32)[:, None], starts

    def times(self, dense: np.ndarray) -> np.ndarray:
        """The product with a dense matrix, some rows at a time to bound memory."""
        ends = np.append(self.starts[1:], len(self.at))
        out, step = np.empty((len(self.starts), dense.shape[1]), np.float32), 0
        while step < len(self.starts):
            upto = max(step + 1, int(np.searchsorted(ends, self.starts[step] + 200_000, side="right")))
            a, b = self.starts[step], ends[upto - 1]
            out[step:upto] = np.add.reduceat(dense[self.at[a:b]] * self.values[a:b], self.starts[step:upto] - a, axis=0)
            step = upto
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, fit_rows: int = FIT_ROWS) -> LatentVotes:
    """The model of the labelled rows outside the held-out fifth."""
    spark = docs.sparkSession
    tune(spark)
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(id_col)
        .agg((F.avg(F.col(label_col)) >= 0.5).cast("int").alias("g_label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("g_text"))
    named = known.withColumnRenamed(id_col, "key")
    picked = texts.join(F.broadcast(named), "key").groupBy("key").agg(F.max("g_label").alias("y"), F.min_by("g_text", F.xxhash64("g_text")).alias("text"))
    rows = materialize(picked.withColumn("place", F.xxhash64("key")), "quality-rows")
    model = LatentVotes()
    sample = rows.orderBy("place", "key").limit(fit_rows)
    model.fit([r["text"] for r in sample.toLocalIterator()])
    sent = spark.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sent.value.project(b.column(2).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array([v.tobytes() for v in found], pa.binary())], names=["place", "y", "vector"])

    voters = rows.select("place", "y", "text").mapInArrow(project, "place long, y int, vector binary").orderBy("place", "vector").toArrow()  # at most max_rows
    vectors = np.frombuffer(b"".join(voters["vector"].to_pylist()), np.float32).reshape(-1, RANK)
    some = (vectors != 0).any(1)
    model.vectors, model.labels = vectors[some], voters["y"].to_numpy().astype(np.float32)[some]
    discard(rows)
    return model


def scorer(docs: DataFrame, labels: DataFrame, **options):
    """A Pandas UDF from text to score, with its model broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    @F.pandas_udf("double")
    def score_text(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.votes(texts.tolist()), dtype=float)

    return score_text


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **options) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    of = scorer(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **options)
    found = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), of(F.col(text_col)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, all columns kept."""
    of = scorer(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **options)
    name = free_name(docs.columns, "g_score")
    return docs.withColumn(name, of(F.col(text_col))).filter(F.col(name) >= threshold).drop(name)

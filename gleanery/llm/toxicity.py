"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their first three to six letters, hashed to ``SLOTS`` slots;
presence counts, not frequency. A text's logit is a bias, the weights of its terms and the inner products of the
factors of all its pairs of terms. Training takes at most ``max_rows`` labelled rows (a documented bound; the rows of
smallest hash).

Weights come first, by accelerated proximal steps, each under an L1 penalty in proportion to the noise of its term's
gradient, so that frequent and rare terms are judged alike. Factors then learn what the weights leave over. What two
terms say together is the mean of residual times both terms, centred and scaled, a matrix over all pairs of terms; random
projections of it give the size of every row, so every term that occurs often enough is judged and none is chosen
beforehand. Among the ``ACTIVE`` terms of largest rows the matrix is exact; entries within the noise of that many
pairs count as nothing, its leading eigenvectors start the factors, and gradient steps fit factors and weights of these
terms together. Terms outside keep factors of zero. A held-back fifth of the rows decides whether the factors stay: where
they do not lower its loss, all are zero. Factors are neither divided by the length of a text nor decayed, so a pair counts the
same among 20 terms and among 500.

The model has SLOTS * (FACTORS + 1) numbers whatever the input and is broadcast; scoring reads whole texts, a batch at a time.

Only the text makes a score. Defined results: a null or empty text scores as one without terms; rows
whose label is null are not learned from; repeated label rows count once, toxic if any says so, and
so do the terms of rows that share an id; without any label of both kinds the score is 0 for all; repeated rows each get
their own row; other columns are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, materialize, tune

#: Labelled rows that are learned from at most; slots of terms; factors a term.
MAX_ROWS, SLOTS, FACTORS = 12_000, 1 << 18, 8
#: Strength of the penalty in units of a gradient's noise, and proximal steps.
PENALTY, STEPS = 0.5, 30
#: Rows whose terms are unrolled at once while fitting: bounds the driver's memory.
SPAN = 1024
#: Rows that hold a term at least before it can have factors, terms that can at most, random projections that judge them.
LEAST_ROWS, ACTIVE, PROJECTIONS = 20, 512, 24
#: Gradient steps on the factors, their rate, and the ridge on factors and weights.
FACTOR_STEPS, RATE, RIDGE = 300, 0.03, 1e-4
PREFIXES = (3, 4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")


class _TermIds(dict):
    """The term hashes of a word, packed."""

    def __missing__(self, word: str) -> bytes:
        import xxhash

        if len(self) > 80_000:
            self.clear()
        terms = [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) > n]
        ids = self[word] = np.array([xxhash.xxh32_intdigest(t) for t in terms], np.uint32).tobytes()
        return ids


_ids = _TermIds()


def term_hashes(text: str | None) -> np.ndarray:
    """The term hashes of the distinct words of a text."""
    words = set(_WORD.findall(text.lower())) if text else ()
    return np.frombuffer(b"".join(map(_ids.__getitem__, words)), np.uint32)


def term_ids(text: str | None) -> np.ndarray:
    """The distinct term hashes of a text, sorted."""
    return np.unique(term_hashes(text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class FactorizationMachine:
    """Logit = bias + weights of present terms + inner products of their factors, pair by pair."""

    def __init__(self, terms: np.ndarray | int = SLOTS, seed: int = 3):
        self.slots = terms if isinstance(terms, int) else len(terms)
        self.seed = seed
        self.active: np.ndarray | None = None
        self.p = {"b": np.zeros(1), "w": np.zeros(self.slots), "V": np.zeros((self.slots, FACTORS), np.float32, order="F")}

    def locate(self, ids: np.ndarray) -> np.ndarray:
        """The slots of term hashes."""
        return np.unique(ids % np.uint32(self.slots)).astype(np.int32) if self.slots else np.empty(0, np.int64)

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """The logit of each row of slots."""
        out = np.full(len(rows), self.p["b"][0])
        some = [i for i, r in enumerate(rows) if len(r)]
        if some:
            at, n = np.concatenate([rows[i] for i in some]), np.array([len(rows[i]) for i in some])
            cut = np.cumsum(n) - n
            out[some] += np.add.reduceat(self.p["w"][at], cut) + self._pairs(at, n)
        return out

    def _pairs(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The pair term of each row, from the few terms that have factors: half of the squared sum less the sum of squares."""
        if self.active is None:
            self.active = self.p["V"].any(1)
        row, has = np.repeat(np.arange(len(n)), n), self.active[at]
        row, v = row[has], self.p["V"][at[has]].astype(np.float64)
        total = np.zeros(len(n))
        for k in range(v.shape[1] if len(row) else 0):
            sums = np.bincount(row, v[:, k], len(n))
            total += sums * sums - np.bincount(row, v[:, k] * v[:, k], len(n))
        return 0.5 * total

    def logit(self, at: np.ndarray) -> float:
        return float(self.logits([at])[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.logits([self.locate(term_hashes(t)) for t in texts]))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        """``rows``: distinct slots."""
        at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.fit_flat(at.astype(np.int32), np.array([len(r) for r in rows], np.int64), y)

    def fit_flat(self, at: np.ndarray, n: np.ndarray, y: np.ndarray) -> None:
        """The slots of all rows one after the other, and how many each row has."""
        y, n = y[n > 0], n[n > 0]
        mean = y.mean() if len(y) else 0.0
        self.p["b"][0] = np.log((mean + 1e-6) / (1 - mean + 1e-6))
        if not len(y):
            return
        cut = np.cumsum(n) - n
        spans = _spans(len(n))
        share = np.bincount(at, minlength=self.slots) / len(n)
        penalty = PENALTY * np.sqrt(share * (1 - share) * mean * (1 - mean) / len(n)) + 1e-12
        self._fit_weights(at, n, cut, spans, y, penalty, np.zeros(len(n)), STEPS)
        self._fit_factors(at, n, cut, y, share)

    @staticmethod
    def _slots_of(at: np.ndarray, n: np.ndarray, cut: np.ndarray, k: slice) -> np.ndarray:
        return at[cut[k.start] : cut[k.stop - 1] + n[k.stop - 1]]

    def _fit_weights(self, at: np.ndarray, n: np.ndarray, cut: np.ndarray, spans: list[slice], y: np.ndarray, penalty: np.ndarray, pairs: np.ndarray, steps: int) -> None:
        """Accelerated proximal steps on bias and weights beside the given pair terms."""
        each = lambda values: sum(np.bincount(self._slots_of(at, n, cut, k), np.repeat(values[k], n[k]), self.slots) for k in spans)
        curve = np.maximum(each(np.sqrt(n)) / len(n) / 4, 1e-9)
        w, ahead, pace, b = self.p["w"], self.p["w"].copy(), 1.0, self.p["b"]
        for _ in range(steps):
            sums = np.concatenate([np.add.reduceat(ahead[self._slots_of(at, n, cut, k)], cut[k] - cut[k.start]) for k in spans])
            d = (_sigmoid(b[0] + sums + pairs) - y) / len(n)
            fresh = ahead - each(d) / curve
            fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - penalty / curve, 0)
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead, w, pace = fresh + (pace - 1) / faster * (fresh - w), fresh, faster
            b[0] -= 2 * d.sum()
        self.p["w"] = w

    def _fit_factors(self, at: np.ndarray, n: np.ndarray, cut: np.ndarray, y: np.ndarray, share: np.ndarray) -> None:
        """Factors of the terms that say something together, and what they change in bias and weights."""
        linear = self.p["b"][0] + np.concatenate([np.add.reduceat(self.p["w"][self._slots_of(at, n, cut, k)], cut[k] - cut[k.start]) for k in _spans(len(n))])
        rng, rows = np.random.default_rng(self.seed), np.repeat(np.arange(len(n), dtype=np.int32), n)
        often = (share * len(n) >= LEAST_ROWS) & (share < 1)
        fit = rng.random(len(n)) < 0.8
        picked = self._strong_terms(at, rows, linear, y, share, often, fit, rng)
        if len(picked) < 2:
            return
        place = np.full(self.slots, -1, np.int32)
        place[picked] = np.arange(len(picked))
        inside = np.flatnonzero(place[at] >= 0)
        spread = np.sqrt(share[picked] * (1 - share[picked]))
        z = np.tile((-share[picked] / spread).astype(np.float32), (len(n), 1))
        z[rows[inside], place[at[inside]]] += (1 / spread).astype(np.float32)[place[at[inside]]]
        trial = _factors(z[fit], linear[fit], y[fit], often.sum(), rng)
        if trial is None or _loss(_centred(z[~fit], linear[~fit], *trial), y[~fit]) >= _loss(linear[~fit], y[~fit]) - 1e-3:
            return
        bias, weights, V = _factors(z, linear, y, often.sum(), rng) or trial
        V = V / spread[:, None]
        base = share[picked] @ V  # centred terms are terms less their share: the difference goes to weights and bias
        self.p["V"][picked] = V
        self.p["w"][picked] += weights / spread - V @ base + share[picked] * (V * V).sum(1)
        self.p["b"][0] += bias - share[picked] @ (weights / spread) + 0.5 * (base @ base - ((share[picked, None] * V) ** 2).sum())
        self.active = None

    def _strong_terms(self, at: np.ndarray, rows: np.ndarray, linear: np.ndarray, y: np.ndarray, share: np.ndarray, often: np.ndarray, fit: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The terms whose rows of the matrix are largest, by random projections of all of it."""
        slots = np.flatnonzero(often)
        if len(slots) <= ACTIVE:
            return slots
        place = np.full(self.slots, -1, np.int32)
        place[slots] = np.arange(len(slots))
        keep = np.flatnonzero(often[at] & fit[rows])
        t, r, s = place[at[keep]], rows[keep], share[slots]
        del keep
        scale, left = 1 / np.sqrt(s * (1 - s)), (y - _sigmoid(linear)) * fit
        size = np.zeros(len(slots))
        own = scale**2 * (_summed(t, left, r, len(slots)) * (1 - 2 * s) + s * s * left.sum())  # the matrix's diagonal
        for _ in range(PROJECTIONS):
            g = rng.choice((-1.0, 1.0), len(slots))
            seen = _summed(r, g * scale, t, len(y)) - (g * scale) @ s
            said = seen * left
            size += ((_summed(t, said, r, len(slots)) - s * said.sum()) * scale - own * g) ** 2
        return slots[np.sort(np.argsort(size, kind="stable")[-ACTIVE:])]


def _spans(n: int) -> list[slice]:
    """Rows that are unrolled at once."""
    return [slice(i, min(i + SPAN, n)) for i in range(0, n, SPAN)]


def _summed(to: np.ndarray, values: np.ndarray, of: np.ndarray, size: int, step: int = 500_000) -> np.ndarray:
    """The sums of ``values[of]`` by ``to``, some entries at a time to bound memory."""
    return sum((np.bincount(to[i : i + step], values[of[i : i + step]], size) for i in range(0, len(to), step)), np.zeros(size))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits)) if len(y) else 0.0


def _centred(z: np.ndarray, linear: np.ndarray, bias: float, weights: np.ndarray, V: np.ndarray) -> np.ndarray:
    """Logits over centred terms."""
    pairs = 0.5 * ((z @ V) ** 2 - (z * z) @ (V * V)).sum(1)
    return linear + bias + z @ weights + pairs


def _factors(z: np.ndarray, linear: np.ndarray, y: np.ndarray, terms: int, rng: np.random.Generator) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Bias, weights and factors of centred terms; null where no pair stands out from the noise of all pairs of ``terms``."""
    left = (y - _sigmoid(linear)).astype(np.float32)
    together = (z * left[:, None]).T @ z / len(y)
    np.fill_diagonal(together, 0)
    noise = np.sqrt(2 * np.log(max(2.0, terms * terms / 2)) * np.mean(left**2) / len(y))
    together = np.sign(together) * np.maximum(np.abs(together) - noise, 0)
    if not together.any():
        return None
    values, vectors = np.linalg.eigh(together)
    V = np.zeros((z.shape[1], FACTORS))
    V[:, : min(FACTORS, len(values))] = (vectors * np.sqrt(np.maximum(values, 0)))[:, ::-1][:, :FACTORS]
    on = np.abs(V).max(1) > 0.05 * np.abs(V).max()
    V[~on] = 0
    zo = z[:, on]
    squares = zo * zo
    p = {"b": np.zeros(1), "w": np.zeros(on.sum()), "V": V[on]}
    first, second = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, FACTOR_STEPS + 1):
        sums = zo @ p["V"]
        d = (_sigmoid(linear + p["b"] + zo @ p["w"] + 0.5 * (sums**2 - squares @ p["V"] ** 2).sum(1)) - y) / len(y)
        grads = {"b": d.sum(keepdims=True), "w": zo.T @ d + RIDGE * p["w"], "V": zo.T @ (d[:, None] * sums) - (squares.T @ d)[:, None] * p["V"] + RIDGE * p["V"]}
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(z.shape[1])
    weights[on], V[on] = p["w"], p["V"]
    return float(p["b"][0]), weights, V


def held_out(id_: Column) -> Column:
    """The rows that are never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """Fit on the labelled rows outside the held-out fifth."""
    tune(docs.sparkSession)
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(id_col)
        .agg(F.max(F.col(label_col).cast("int")).alias("g_label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(max_rows)
    )

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.unique(term_hashes(t) % np.uint32(SLOTS)).astype(np.int32) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["key", "y", "ids"])

    picked = docs.select(id_col, F.col(text_col).alias("g_text")).join(F.broadcast(known), id_col)
    kind = dict(docs.dtypes)[id_col]
    terms = picked.select(F.col(id_col), "g_label", "g_text").mapInArrow(featurize, f"key {kind}, y int, ids array<int>")
    rows = materialize(terms.groupBy("key").agg(F.max("y").alias("y"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids")), "toxic-terms")
    found = rows.orderBy("key").toArrow()  # at most max_rows rows, as flat arrays
    model, y = FactorizationMachine(), found["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        model.p["b"][0] = -30.0
        return model
    at, n = np.concatenate([c.flatten().to_numpy() for c in found["ids"].chunks]), pc.list_value_length(found["ids"]).to_numpy().astype(np.int64)
    del found
    model.fit_flat(at, n, y)
    return model


def scorer(docs: DataFrame, labels: DataFrame, **options):
    """A Pandas UDF from text to score, with its fitted model broadcast."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    @F.pandas_udf("double")
    def score_text(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores(texts.tolist()), dtype=float)

    return score_text


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    of = scorer(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows)
    found = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), of(F.col(text_col)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept."""
    of = scorer(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows)
    name = free_name(docs.columns, "g_score")
    return docs.withColumn(name, of(F.col(text_col))).filter(F.col(name) < threshold).drop(name)

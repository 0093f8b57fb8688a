"""Hard-negative mining by branch and bound over ball trees.

Rows are dealt to trees of at most ``TREE_ROWS``, within the partitions that they are read in, so no
row moves between machines: each task splits its rows by label, then halves them across their widest
spread until at most ``LEAF`` rows are left. A node knows the centre and radius of its rows, which bound
inner products with an anchor above and below, and the smallest and largest label. The trees are stored
once in the shared folder, a row a tree, and both searches read them there.

Anchors come in turns of about ``ANCHORS`` (a broadcast of bounded size); every turn takes all rows. The
first search keeps an anchor's best rows of its own label, the second, for each anchor and positive, the
best rows of other labels inside the positive's score window. A node is left out when its upper bound
lies beneath the window or strictly beneath the worst kept score of all, or its lower bound above the window: what is kept is exact,
ties included. Each task sends at most k rows a question, and those meet by anchor.

Scores are integers. Vectors are scaled and floored to integers first; the components must be small
enough that scores stay within 48 bits, larger ones are refused with a message.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part.
A null id is a neighbour like others, after all other ids among ties, and never an anchor unless the
caller's condition says so. Rows that repeat an id, or are equal in all columns, are rows of their own:
"other" means another row. Vectors of unequal length are compared over the shorter one's components; an
empty one scores 0. An anchor without positives or without rows in the window has no result. An empty
table gives no rows. Labels must be integers. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialize, tune

#: Rows of a tree (a power of two) and of a leaf; anchors of a turn; questions that walk a tree together.
TREE_BITS, LEAF, ANCHORS, QUESTIONS = 13, 256, 32_768, 2048
TREE_ROWS = 1 << TREE_BITS
#: Scores stay below this, so that a score and a row's place in its tree fit one 64-bit key.
SCORE_BITS = 48
NONE = np.int64(np.iinfo(np.int64).min)
_NO_SCORE = NONE >> np.int64(TREE_BITS)


class BallTree:
    """At most ``TREE_ROWS`` rows: ids (with a mask of nulls), row numbers, labels, integer vectors."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, rows: np.ndarray, labels: np.ndarray, anchors: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids, null))  # the place in this order decides ties
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        at, self.nodes = self._split(labels, vectors.astype(np.float64))
        self.place, self.by_place = place[at], np.argsort(place[at])
        self.ids, self.null, self.rows, self.labels, self.anchors = ids[at], null[at], rows[at], labels[at], anchors[at]
        reach = int(np.abs(vectors).max()) if vectors.size else 0
        small = next(t for t in (np.int8, np.int16, np.int32) if reach <= np.iinfo(t).max)
        self.vectors, self.reach = vectors[at].astype(small), reach

    @staticmethod
    def _split(labels: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The order of the rows in leaves, and nodes whose children follow them."""
        at = np.argsort(labels, kind="stable")
        spans, child, todo = [], [], [(0, len(at), -1)]
        while todo:
            a, b, parent = todo.pop()
            me = len(spans)
            spans.append((a, b))
            child.append([-1, -1])
            if parent >= 0:
                child[parent][child[parent][0] >= 0] = me
            if b - a <= LEAF:
                continue
            mine = labels[at[a:b]]
            if mine[0] != mine[-1]:  # sorted by label down to here: cut where the label changes next to the middle
                edges = np.flatnonzero(np.diff(mine)) + 1
                cut = a + int(edges[np.argmin(np.abs(edges - (b - a) // 2))])
            else:
                p = points[at[a:b]]
                far = p[((p - p.mean(0)) ** 2).sum(1).argmax()]
                along = p @ (p[((p - far) ** 2).sum(1).argmax()] - far)
                cut = a + (b - a) // 2
                at[a:b] = at[a:b][np.argpartition(along, (b - a) // 2)]
            todo += [(cut, b, me), (a, cut, me)]
        centres = np.array([points[at[a:b]].mean(0) if b > a else np.zeros(points.shape[1]) for a, b in spans])
        radii = np.array([np.sqrt(((points[at[a:b]] - c) ** 2).sum(1).max()) if b > a else 0.0 for (a, b), c in zip(spans, centres)])
        low = np.array([labels[at[a:b]].min() if b > a else 0 for a, b in spans], np.int64)
        high = np.array([labels[at[a:b]].max() if b > a else 0 for a, b in spans], np.int64)
        return at, {"span": np.array(spans, np.int64), "child": np.array(child, np.int64), "centre": centres, "radius": radii, "low": low, "high": high}

    def search(self, q: np.ndarray, ask: dict[str, np.ndarray], same: bool, k: int) -> np.ndarray:
        """For each question the k best keys (score and place), ``NONE`` where there are fewer.

        ``q``: anchor vectors; ``ask``: ``of`` (a question's row of ``q``), ``label``, ``row``, ``low`` and
        ``high`` of its window, and ``kth``, a score that k known rows reach.
        """
        d = min(q.shape[1], self.vectors.shape[1])
        size = d * self.reach * (int(np.abs(q).max()) if q.size else 0)
        if size >> SCORE_BITS:
            raise ValueError(f"inner products reach {size}, over {SCORE_BITS} bits: scale the vectors down")
        kind = np.float32 if size < 1 << 24 else np.float64  # exact: every sum is an integer below 2^24 or 2^53
        q = q[:, :d].astype(kind)
        wide = q.astype(np.float64)
        length = np.sqrt((wide * wide).sum(1))
        n, span = self.nodes, self.nodes["span"]
        best = np.full((len(ask["of"]), k), NONE)
        todo = [(0, np.arange(len(best)))]
        while todo:
            node, at = todo.pop()
            floor = np.maximum(np.maximum(ask["low"][at], ask["kth"][at]), best[at].min(1) >> np.int64(TREE_BITS))
            middle = wide[ask["of"][at]] @ n["centre"][node][:d]
            reach = length[ask["of"][at]] * n["radius"][node]
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
            open_ = (middle + reach + slack >= floor) & (middle - reach - slack <= ask["high"][at])
            if same:
                open_ &= (ask["label"][at] >= n["low"][node]) & (ask["label"][at] <= n["high"][node])
            elif n["low"][node] == n["high"][node]:
                open_ &= ask["label"][at] != n["low"][node]
            at = at[open_]
            if not len(at):
                continue
            left, right = n["child"][node]
            if left >= 0:
                mean = wide[ask["of"][at]].mean(0)
                nearer = mean @ (n["centre"][left] - n["centre"][right])[:d] >= 0
                todo += [(right, at), (left, at)] if nearer else [(left, at), (right, at)]
                continue
            a, b = span[node]
            if a == b:
                continue
            of, back = np.unique(ask["of"][at], return_inverse=True)
            score = (q[of] @ self.vectors[a:b, :d].T.astype(kind)).astype(np.int64)[back]
            fits = (score >= ask["low"][at][:, None]) & (score <= ask["high"][at][:, None]) & (self.rows[a:b] != ask["row"][at][:, None])
            fits &= (self.labels[a:b] == ask["label"][at][:, None]) == same
            keys = np.where(fits, (score << np.int64(TREE_BITS)) + (TREE_ROWS - 1 - self.place[a:b]), NONE)
            best[at] = -np.partition(-np.maximum(np.concatenate([best[at], keys], 1), -np.iinfo(np.int64).max), k - 1, axis=1)[:, :k]
        return best

    def unpack(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, ids and the mask of null ids behind keys; ``_NO_SCORE`` where there is none."""
        some = keys > NONE + TREE_ROWS
        row = self.by_place[np.where(some, TREE_ROWS - 1 - (keys & np.int64(TREE_ROWS - 1)), 0)]
        return np.where(some, keys >> np.int64(TREE_BITS), _NO_SCORE), self.ids[row], self.null[row] & some


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """The vectors of a batch; shorter ones are filled with zeros, which add nothing to a product."""
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(n) and (n == n[0]).all():
        return flat.reshape(len(n), n[0])
    out = np.zeros((len(n), n.max(initial=0)), flat.dtype)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _columns(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    t = pa.Table.from_batches(batches)
    id_ = t["id"].combine_chunks()
    vectors = [_matrix(b.column("vector")) for b in batches]
    wide = max(v.shape[1] for v in vectors)
    stacked = np.concatenate([np.pad(v, ((0, 0), (0, wide - v.shape[1]))) for v in vectors])
    return id_.fill_null(0).to_numpy(zero_copy_only=False), id_.is_null().to_numpy(zero_copy_only=False), t["row"].to_numpy(), t["label"].to_numpy(), t["anchor"].to_numpy(), stacked


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    held: list[pa.RecordBatch] = []
    n = 0

    def tree() -> pa.RecordBatch:
        return pa.record_batch([pa.array([pickle.dumps(BallTree(*_columns(held)), protocol=5)], pa.binary()), pa.array([n], pa.int32())], names=["tree", "rows"])

    for b in batches:
        while b.num_rows:
            part = b.slice(0, TREE_ROWS - n)
            b = b.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == TREE_ROWS:
                yield tree()
                held, n = [], 0
    if n:
        yield tree()


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as a double; null where a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < float(1 << 30))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return F.when(whole, F.when(small, ints).otherwise(F.raise_error(F.lit("a scaled component is beyond 2^30: scale the vectors down"))))


def trees(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """Stored trees of all rows that take part, a row a tree; rows are numbered as they are written."""
    tune(rows.sparkSession)
    picked = rows.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        integers(F.col(vector_col), scale).alias("vector"),
    ).filter("label IS NOT NULL AND vector IS NOT NULL")
    numbered = picked.withColumn("row", F.monotonically_increasing_id())
    return materialize(numbered.mapInArrow(_build, "tree binary, rows int"), "ball-trees")


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    names = ["row", "id", "label", "vector"]
    for b in batches:
        for blob in b.column(0):
            t = pickle.loads(blob.as_py())
            at = np.flatnonzero(t.anchors)
            cols = [pa.array(t.rows[at], pa.int64()), pa.array(t.ids[at], pa.int64(), mask=t.null[at]), pa.array(t.labels[at], pa.int64()), pa.array([v.tobytes() for v in t.vectors[at].astype(np.int32)], pa.binary())]
            yield pa.record_batch(cols, names=names)


def _best(stored: DataFrame, vectors: np.ndarray, ask: dict[str, np.ndarray], same: bool, k: int) -> DataFrame:
    """(question, score, id, place): the k best rows of each question over all trees, from 1."""
    sent = stored.sparkSession.sparkContext.broadcast((vectors, ask))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        q, asked = sent.value
        n = len(asked["of"])
        score, id_, null = np.full((n, k), _NO_SCORE), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        for b in batches:
            for blob in b.column(0):
                tree = pickle.loads(blob.as_py())
                for a in range(0, n, QUESTIONS):
                    at = slice(a, min(a + QUESTIONS, n))
                    part = {name: v[at] for name, v in asked.items()} | {"kth": score[at, -1]}
                    own = part["of"][0]
                    keys = tree.search(q[own : part["of"][-1] + 1], part | {"of": part["of"] - own}, same, k)
                    new = [np.concatenate(x, 1) for x in zip((score[at], id_[at], null[at]), tree.unpack(keys))]
                    order = np.lexsort((new[1], new[2], -new[0]))[:, :k]
                    score[at], id_[at], null[at] = (np.take_along_axis(x, order, 1) for x in new)
        question, j = np.nonzero(score > _NO_SCORE)
        yield pa.record_batch([pa.array(question, pa.int64()), pa.array(score[question, j], pa.int64()), pa.array(id_[question, j], pa.int64(), mask=null[question, j])], names=["question", "score", "id"])

    found = stored.select("tree").mapInArrow(search, "question long, score long, id long")
    order = Window.partitionBy("question").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _turn(stored: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame | None:
    """The result for one turn of anchors, of bounded number, so they may pass through the driver."""
    got = anchors.orderBy("row").toArrow()
    if not got.num_rows:
        return None
    spark = stored.sparkSession
    blobs = [np.frombuffer(v, np.int32) for v in got["vector"].to_pylist()]
    wide = max(map(len, blobs))
    q = np.array([np.pad(v, (0, wide - len(v))) for v in blobs], np.int32).reshape(len(blobs), wide)
    label, row = got["label"].to_numpy(), got["row"].to_numpy()
    all_of = np.arange(len(q))
    top = np.int64(1) << SCORE_BITS
    ask = {"of": all_of, "label": label, "row": row, "low": np.full(len(q), -top), "high": np.full(len(q), top)}
    mine = _best(stored, q, ask, True, positives).orderBy("question", "place").toArrow()  # at most ``positives`` an anchor
    of, score = mine["question"].to_numpy(), mine["score"].to_numpy()
    lowest, highest = -(-low * score // 100), high * score // 100
    ask = {"of": of, "label": label[of], "row": row[of], "low": lowest, "high": highest}
    pairs = spark.createDataFrame(
        pa.table({"question": pa.array(np.arange(len(of))), "anchor_id": got["id"].combine_chunks().take(pa.array(of)), "positive_id": mine["id"], "positive_score": mine["score"]})
    )
    found = _best(stored, q, ask, False, negatives).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    both = found.join(F.broadcast(pairs), "question")
    return both.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    turn: int = ANCHORS,
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of equal label, the ``negatives`` best rows
    of other labels whose score lies between ``low`` and ``high`` hundredths of the positive's:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    stored = trees(rows, anchors, id_col, vector_col, label_col, scale)
    picked = materialize(stored.select("tree").mapInArrow(_anchors, "row long, id long, label long, vector binary"), "anchors")
    turns = -(-picked.count() // turn) or 1
    out = None
    for i in range(turns):
        found = _turn(stored, picked.filter(F.pmod(F.xxhash64("row"), F.lit(turns)) == i), positives, negatives, low, high)
        if found is not None:
            found = materialize(found, "hard-negatives")
            out = found if out is None else out.unionByName(found)
    discard(stored)
    discard(picked)
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out

"""Full-text search of passages over a stored inverted index, with the best k found by block maxima.

Passages are dealt to segments of up to ``2 ** SEGMENT_BITS`` neighbours. A posting list is a row per (term, segment): the places
in the segment that hold the term, with their weights, and the largest weight among them. So a term that a third of all passages
hold is many bounded rows, and no task gathers it. Ids and sources stand once a segment. Lists lie in folders by hashed term: a
search reads the folders of its terms, first only the maxima. The sum of its terms' maxima bounds what a segment can hold for a
query. The most promising segments are read first; the kth best score found there is a floor, and segments whose bound lies
beneath it are never read. A segment meets all its queries in one task and gives each at most k passages, so no row is made
for a passage that merely shares a word with a query.

Scores are BM25 with k1 = 1.2 and b = 0.75; the inverse frequency is ln((n - df + 0.5) / (df + 0.5)), at least 1e-6.

Defined results: a null or wordless text matches nothing; a query without known words finds nothing; repeated words of a query
count once; equal scores are ordered by passage id; passage ids are distinct.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.stage import discard, fresh, stored

# The parameters of the score.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Passages of a segment (a power of two), folders of terms, segments that a query reads before it has a floor.
SEGMENT_BITS, FOLDERS, PROBES = 10, 16, 4


@dataclass(frozen=True)
class PassageIndex:
    """Paths of a stored index and the two numbers that every score needs."""

    postings: str
    segments: str
    terms: str
    passages: int
    length: float

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        found = spark.read.parquet(getattr(self, table))
        return found.filter("folder >= 0").drop("ids", "sources") if table == "postings" else found


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


_SEGMENTS = "segment long, ids array<long>, sources array<string>, term string, top double, n int, places array<smallint>, weights array<double>"


def _segment(rows: pa.RecordBatch, segment: int, average: float) -> pa.RecordBatch:
    """The lists of a segment's terms behind one row, of null term, with its ids and sources."""
    lengths, words = rows["length"].to_numpy(), rows["tokens"].flatten().dictionary_encode()
    size, width = len(words.dictionary), rows.num_rows
    keys, tf = np.unique(words.indices.to_numpy().astype(np.int64) * width + np.repeat(np.arange(width), lengths), return_counts=True)
    term, place = keys // width, keys % width
    weights = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[place] / average))
    first = np.searchsorted(term, np.arange(size))
    ends = pa.array(np.concatenate(([0, 0], first[1:], [len(keys)]) if size else [0, 0]).astype(np.int32))
    cells = {
        "segment": pa.array(np.full(size + 1, segment)),
        "ids": pa.array([rows["id"].to_pylist()] + [None] * size, pa.list_(pa.int64())),
        "sources": pa.array([rows["source"].to_pylist()] + [None] * size, pa.list_(pa.string())),
        "term": pa.concat_arrays([pa.nulls(1, pa.string()), words.dictionary.cast(pa.string())]),
        "top": pa.array(np.concatenate(([0.0], np.maximum.reduceat(weights, first) if size else []))),
        "n": pa.array(np.concatenate(([0], np.diff(np.append(first, len(keys))))).astype(np.int32)),
        "places": pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int16))),
        "weights": pa.ListArray.from_arrays(ends, pa.array(weights)),
    }
    return pa.RecordBatch.from_pydict(cells)


def build(passages: DataFrame, id_col: str = "passage_id", source_col: str = "source", text_col: str = "text") -> PassageIndex:
    """The stored index of ``passages``.

    Texts are read once and stored as words. Neighbours in a task are a segment, whose lists are made there: no word is shuffled."""
    spark, size = passages.sparkSession, 1 << SEGMENT_BITS
    tokens = passages.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), T.words(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    kept = stored(tokens.select("id", "source", F.size("tokens").alias("length"), "tokens"), "passage-words")
    n, length = kept.agg(F.count(F.lit(1)), F.avg("length")).first()
    length = float(length or 1.0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            for start in range(0, b.num_rows, size):
                yield _segment(pa.RecordBatch.from_pydict({c: pa.concat_arrays([b[c].slice(start, size)]) for c in b.schema.names}), at, length)
                at += 1

    where = fresh(spark, "passage-index")
    made = kept.mapInArrow(cut, _SEGMENTS).withColumn("folder", F.when(F.col("term").isNull(), -1).otherwise(_folder(F.col("term"))))
    made.write.partitionBy("folder").parquet(f"{where}/lists")
    index = PassageIndex(f"{where}/lists", f"{where}/lists/folder=-1", f"{where}/terms", n, length)
    if n:
        terms = index.read(spark, "postings").groupBy("folder", "term").agg(F.sum("n").alias("df"))
        terms.write.parquet(index.terms)
    discard(kept)
    return index


def _asked(index: PassageIndex, queries: DataFrame) -> DataFrame:
    """(query, term, folder, idf) of the distinct known words of each query."""
    spark = queries.sparkSession
    words = queries.select("query", F.explode(F.array_distinct(T.words(F.coalesce("text", F.lit(""))))).alias("term"))
    known = index.read(spark, "terms")
    raw = F.log((F.lit(float(index.passages)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return words.join(known, "term").select("query", "term", "folder", F.greatest(raw, F.lit(LEAST_IDF)).alias("idf"))


def bounds(index: PassageIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query, segment, bound, turn): what each segment can hold for a query at most; those of turn 1 are read first."""
    folders = [r["folder"] for r in asked.select("folder").distinct().collect()]  # at most FOLDERS
    tops = index.read(asked.sparkSession, "postings").filter(F.col("folder").isin(folders)).select("term", "segment", "top")
    sums = tops.join(asked.select("query", "term", "idf"), "term").groupBy("query", "segment").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "segment"))
    return sums.withColumn("turn", F.when(place <= PROBES + (k >> SEGMENT_BITS), 1).otherwise(2))


def _found_in(lists: pa.Table, ids: np.ndarray, sources: list[str], floors: dict[int, float], most: int | None, per_source: int | None) -> Iterator[tuple[int, int, str, float]]:
    """(query, id, source, score) of one segment, best first; ``lists``: places, weights, queries and idf, a row a term."""
    flat = lambda c: (lists[c].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists[c].combine_chunks().value_lengths().to_numpy()))))
    (place, at), (weight, _), (query, asks) = flat("places"), flat("weights"), flat("queries")
    weight = weight * np.repeat(lists["idf"].to_numpy(), np.diff(at))
    term = np.repeat(np.arange(lists.num_rows), np.diff(asks))
    order = np.argsort(query, kind="stable")
    names, first = np.unique(query[order], return_index=True)
    for name, terms in zip(names.tolist(), np.split(term[order], first[1:])):
        if name not in floors:
            continue
        sums = np.zeros(len(ids))
        for t in terms:  # a place stands once in a list
            sums[place[at[t] : at[t + 1]]] += weight[at[t] : at[t + 1]]
        score = np.round(sums, 9)
        hits = np.flatnonzero((sums > 0) & (score >= floors[name]))
        hits = hits[np.lexsort((ids[hits], -score[hits]))]
        taken: Counter[str] = Counter()
        left = most
        for h in hits.tolist():
            if left == 0:
                break
            if most is not None and per_source is not None:
                taken[sources[h]] += 1
                if taken[sources[h]] > per_source:
                    continue
            left = left and left - 1
            yield name, int(ids[h]), sources[h], float(score[h])


def _scores(index: PassageIndex, asked: DataFrame, segments: DataFrame, allowed: DataFrame | None, pinned: DataFrame | None, k: int, per_source: int | None) -> DataFrame:
    """(query, id, source, score) of the passages in the given segments (query, segment, floor) that hold a word of their query.

    Of a segment each query gets the ``k`` best that keep ``per_source`` and reach its floor: whatever stands before a passage
    in its segment stands before it among all, or is beaten by as many of its own source. With ``allowed`` or ``pinned`` all come."""
    most = k if allowed is None and pinned is None else None
    folders = [r["folder"] for r in asked.select("folder").distinct().collect()]
    askers = asked.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list("query").alias("queries"))
    lists = index.read(asked.sparkSession, "postings").filter(F.col("folder").isin(folders)).select("term", "segment", "places", "weights")
    lists = lists.join(F.broadcast(segments.select("segment").distinct()), "segment", "left_semi").join(askers, "term").drop("term")
    wanted = segments.groupBy("segment").agg(F.collect_list("query").alias("query"), F.collect_list(F.coalesce("floor", F.lit(float("-inf")))).alias("floor"))
    places = index.read(asked.sparkSession, "segments").select("segment", "ids", "sources").join(wanted, "segment")

    def score(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "id": [], "source": [], "score": []}
        if mine.num_rows and theirs.num_rows:
            row = theirs.slice(0, 1).to_pylist()[0]
            for q, id_, source, s in _found_in(mine, np.array(row["ids"]), row["sources"], dict(zip(row["query"], row["floor"])), most, per_source):
                for name, v in zip(out, (q, id_, source, s)):
                    out[name].append(v)
        return pa.table({"query": pa.array(out["query"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "source": pa.array(out["source"], pa.string()), "score": pa.array(out["score"], pa.float64())})

    found = lists.groupBy("segment").cogroup(places.groupBy("segment")).applyInArrow(score, "query long, id long, source string, score double")
    if pinned is not None:  # a pinned source is searched within its pinned passages alone
        sources = pinned.select("query", "source").distinct().withColumn("_is_pinned", F.lit(True))
        inside = pinned.select("query", "source", "id").distinct().withColumn("_inside", F.lit(True))
        found = found.join(sources, ["query", "source"], "left").join(inside, ["query", "source", "id"], "left").filter("_is_pinned IS NULL OR _inside").drop("_is_pinned", "_inside")
    return found if allowed is None else found.join(allowed.select("query", "source").distinct(), ["query", "source"], "left_semi")


def _best(scores: DataFrame, k: int, per_source: int | None) -> DataFrame:
    order = [F.desc("score"), "id"]
    if per_source is not None:
        scores = scores.withColumn("_k", F.row_number().over(Window.partitionBy("query", "source").orderBy(*order))).filter(F.col("_k") <= per_source).drop("_k")
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("place") <= k)


@dataclass
class Found:
    """``hits``: query, place, id, source, score. ``read``: (query, segment, bound, turn) of the segments, turn 0 where never read."""

    hits: DataFrame
    read: DataFrame


def search(index: PassageIndex, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None, pinned: DataFrame | None = None, per_source: int | None = None) -> Found:
    """The ``k`` best passages of every query (query, text).

    ``allowed`` (query, source): the sources that a query may search, all if not given. ``pinned`` (query, source, id): within
    these sources only these passages. ``per_source``: at most so many passages of one source, best first. The limits hold
    before the cut at k, and the floor is taken from passages that keep them, so no limit can cost a passage.
    """
    spark = queries.sparkSession
    schema = "query long, id long, source string, score double, place int"
    if not index.passages:
        return Found(spark.createDataFrame([], schema), spark.createDataFrame([], "query long, segment long, bound double, turn int"))
    asked = stored(_asked(index, queries), "asked")
    tried = stored(bounds(index, asked, k), "segment-bounds")
    limits = allowed, pinned, k, per_source
    first = stored(_scores(index, asked, tried.filter("turn = 1").withColumn("floor", F.lit(None).cast("double")), *limits), "first-scores")
    floor = _best(first, k, per_source).filter(F.col("place") == k).select("query", F.col("score").alias("floor"))
    # A bound is a sum of rounded products: a hair below the floor may still be a tie.
    read = stored(tried.join(floor, "query", "left").withColumn("turn", F.when((F.col("turn") == 2) & (F.col("bound") < F.col("floor") - 1e-6), 0).otherwise(F.col("turn"))), "segments-read")
    rest = _scores(index, asked, read.filter("turn = 2"), *limits)
    return Found(_best(first.unionByName(rest.select(*first.columns)), k, per_source), read.drop("floor"))

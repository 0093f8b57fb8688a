"""Ranking queries: signals over the record pool, mean ranks, fusion (inventory groups F, G, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import ranks, signals
from gleanery.registry import query
from gleanery.sources.tables import POOL_SQL, pool, read, tokens_sql

#: The query text is the benchmark item of this id.
ITEM = 0

_Q = f"q AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS word FROM benchmark WHERE item_id = {ITEM})"
_W = f"w AS (SELECT id, {tokens_sql(chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || coalesce(abstract, ' + chr(39) + chr(39) + ')')} AS tok FROM pool)"


def _bm25_sql(k1: float = 1.5) -> str:
    return f"""{POOL_SQL}, {_Q}, {_W},
st AS (SELECT count(*) AS n, avg(len(tok)) AS av FROM w),
tf AS (SELECT id, dl, word, count(*) AS tf FROM (SELECT id, len(tok) AS dl, unnest(tok) AS word FROM w) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
bm AS (SELECT p.id, round(coalesce(s.score, 0.0), 9) AS score FROM pool p LEFT JOIN
 (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (0.25 + 0.75 * dl / av))) AS score FROM tf JOIN df USING (word), st GROUP BY id) s USING (id))"""


def query_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """The words of the query item, in order of appearance."""
    row = read(spark, sf_dir, "benchmark").filter(F.col("item_id") == ITEM).select(T.words(F.col("text")).alias("w")).first()
    return list(dict.fromkeys(row["w"])) if row else []


BLOCKS_SQL = f"""bq AS (SELECT {tokens_sql('text')} AS w FROM benchmark WHERE item_id = {ITEM}),
pd AS (SELECT id, ' ' || array_to_string({tokens_sql('title')}, ' ') || ' ' AS t, ' ' || array_to_string(tok, ' ') || ' ' AS a FROM pool JOIN w USING (id)),
bl AS (SELECT id, CAST(contains(t, ' ' || w[1]) OR contains(t, ' ' || w[2]) AS INT) + CAST(contains(t, ' ' || w[3]) OR contains(t, ' ' || w[4]) AS INT) AS in_title,
 CAST(contains(a, ' ' || w[1]) AS INT) + CAST(contains(a, ' ' || w[2]) AS INT) + CAST(contains(a, ' ' || w[3]) AS INT) + CAST(contains(a, ' ' || w[4]) AS INT) AS forms FROM pd, bq)"""


def _blocks(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    row = read(spark, sf_dir, "benchmark").filter(F.col("item_id") == ITEM).select(T.words(F.col("text")).alias("w")).first()
    w = row["w"]
    return {"setting": w[:2], "task": w[2:4]}


def mean_sql(score: str, source: str, name: str, available: str = "TRUE") -> str:
    """Mean ranks in oracle SQL: (id, name)."""
    return f"""(SELECT id, CASE WHEN ok THEN rank() OVER (PARTITION BY ok ORDER BY s DESC) + (count(*) OVER (PARTITION BY ok, s) - 1) / 2.0
 ELSE (have + total - 1) / 2.0 + 1 END AS {name} FROM (SELECT *, count(*) FILTER (ok) OVER () AS have, count(*) OVER () AS total
 FROM (SELECT id, {score} AS s, {available} AS ok FROM {source})))"""


@query("j1_bm25_scores", f"WITH {_bm25_sql()} SELECT id, round(score, 6) AS score FROM bm WHERE score > 0")
def j1_bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.bm25(signals.whole(pool(spark, sf_dir)), query_words(spark, sf_dir))
    return found.filter("score > 0").select("id", F.round("score", 6).alias("score"))


@query("j3_source_order_bm25", f"WITH {_bm25_sql(1.2)} SELECT id, round(score, 6) AS score FROM bm WHERE score > 0 ORDER BY score DESC, id LIMIT 100")
def j3_source_order_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.bm25(signals.whole(pool(spark, sf_dir)), query_words(spark, sf_dir), k1=signals.PASSAGE_K1)
    return found.filter("score > 0").orderBy(F.desc("score"), "id").limit(100).select("id", F.round("score", 6).alias("score"))


@query("j4_block_scores", f"WITH {POOL_SQL}, {_W}, {BLOCKS_SQL} SELECT id, in_title, forms FROM bl WHERE forms > 0")
def j4_block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.block_score(pool(spark, sf_dir), _blocks(spark, sf_dir)).filter("forms > 0")


@query(
    "f1_mean_ranks",
    f"WITH {_bm25_sql()} SELECT b.id, rank, abstract IS NOT NULL AS rank_available FROM {mean_sql('score', '(SELECT bm.id, score, abstract FROM bm JOIN pool USING (id))', 'rank', 'abstract IS NOT NULL')} b JOIN pool USING (id)",
)
def f1_mean_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir)
    scored = signals.bm25(signals.whole(p), query_words(spark, sf_dir)).join(p.select("id", F.col("abstract").isNotNull().alias("has")), "id")
    return ranks.mean_ranks(scored, "score", "rank", F.col("has")).select("id", "rank", "rank_available")


@query(
    "bm25_topk",
    f"""WITH {_bm25_sql()}, {BLOCKS_SQL}, r AS (SELECT x.id, r1, r2 FROM {mean_sql('score', 'bm', 'r1')} x JOIN {mean_sql('in_title * 1000 + forms', 'bl', 'r2')} y USING (id))
SELECT id, round(1.0 / (60 + r1) + 1.0 / (60 + r2), 9) AS fused FROM r ORDER BY round(1.0 / (60 + r1) + 1.0 / (60 + r2), 9) DESC, id LIMIT 100""",
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: BM25 and concept blocks, each to mean ranks, fused, the first 100."""
    p = pool(spark, sf_dir)
    blocks = signals.block_score(p, _blocks(spark, sf_dir)).select("id", (F.col("in_title") * 1000 + F.col("forms")).alias("r2"))
    both = signals.bm25(signals.whole(p), query_words(spark, sf_dir)).withColumnRenamed("score", "r1").join(blocks, "id")
    return ranks.rank_all(both, ["r1", "r2"]).select("id", ranks.rrf(["r1", "r2"]).alias("fused")).orderBy(F.desc("fused"), "id").limit(100)


TFIDF_SQL = f"""{POOL_SQL}, {_W}, sd AS (SELECT item_id AS seed, {tokens_sql('text')} AS tok FROM benchmark WHERE item_id < 5),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM w),
fr AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT id, unnest(tok) AS word FROM w) GROUP BY word),
v AS (SELECT k, id, word, (1 + ln(count(*))) * ln(any_value(n) / any_value(df)) AS x FROM
 (SELECT 0 AS k, id, unnest(tok) AS word FROM w UNION ALL SELECT 1, seed, unnest(tok) FROM sd) JOIN fr USING (word), n WHERE df < n GROUP BY k, id, word),
u AS (SELECT k, id, word, x / sqrt(sum(x * x) OVER (PARTITION BY k, id)) AS x FROM v),
tfi AS (SELECT p.id, round(coalesce(max(d), 0.0), 6) AS score FROM pool p LEFT JOIN
 (SELECT a.id, b.id AS seed, sum(a.x * b.x) AS d FROM u a JOIN u b ON a.k = 0 AND b.k = 1 AND a.word = b.word GROUP BY ALL) USING (id) GROUP BY p.id)"""


def _tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = read(spark, sf_dir, "benchmark").filter("item_id < 5").select(F.col("item_id").alias("id"), T.words(F.col("text")).alias("tokens"))
    return signals.tfidf(signals.whole(pool(spark, sf_dir)), seeds)


@query("j5_tfidf_seed_similarity", f"WITH {TFIDF_SQL} SELECT id, score FROM tfi")
def j5_tfidf_seed_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tfidf(spark, sf_dir)


EDGES_SQL = "e AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS target FROM lineitem)"
COUPLING_SQL = f"""{EDGES_SQL}, n AS (SELECT id, count(*) AS n FROM e GROUP BY id), s AS (SELECT DISTINCT id FROM e WHERE id <= 64),
k AS (SELECT a.id, b.id AS seed, count(*) AS k FROM e a JOIN e b ON a.target = b.target AND a.id <> b.id JOIN s ON s.id = b.id GROUP BY ALL),
cp AS (SELECT k.id, round(sum(k / sqrt(x.n * y.n)), 6) AS score FROM k JOIN n x ON x.id = k.id JOIN n y ON y.id = k.seed GROUP BY k.id)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citation graph's stand-in: orders cite parts."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("target"))


@query("i8_coupling_scores", f"WITH {COUPLING_SQL} SELECT id, score FROM cp")
def i8_coupling_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return signals.coupling(e, e.select("id").distinct().filter("id <= 64"))


@query(
    "j7_joint_scores",
    f"""WITH {POOL_SQL}, {_W}, p AS (SELECT id, replace(' ' || array_to_string({tokens_sql('title')}, ' ') || ' ', '-', ' ') AS t, replace(' ' || array_to_string(tok, ' ') || ' ', '-', ' ') AS a FROM pool JOIN w USING (id)),
h AS (SELECT id, CAST(contains(a, ' the') AS INT) AS h1, CAST(contains(a, ' idiot') AS INT) AS h2, CAST(contains(a, ' tion') AS INT) AS h3,
 CAST(contains(t, ' the') AS INT) + CAST(contains(t, ' idiot') AS INT) + CAST(contains(t, ' tion') AS INT) AS tt FROM p),
d AS (SELECT count(*) AS n, sum(h1) AS d1, sum(h2) AS d2, sum(h3) AS d3 FROM h)
SELECT id, CASE WHEN tt >= 2 THEN tt ELSE 0 END AS in_title, round(CASE WHEN h1 + h2 + h3 >= 2 THEN h1 * ln(n / d1) + h2 * ln(n / d2) + h3 * ln(n / d3) ELSE 0.0 END, 6) AS rarity FROM h, d""",
)
def j7_joint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.joint(pool(spark, sf_dir), ["the", "idiot", "tion"])


@query(
    "j8_comparison_question",
    f"""SELECT conv_id, turn, list_has_any({tokens_sql('text')}, ['compare', 'versus', 'vs', 'than', 'better', 'difference']) AS comparison FROM conversations""",
)
def j8_comparison_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = F.array(*map(F.lit, ("compare", "versus", "vs", "than", "better", "difference")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.arrays_overlap(T.words(F.col("text")), cues).alias("comparison"))


@query(
    "j14_knn_cosine",
    """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 5) AS similarity FROM embeddings WHERE vec_id <> 0
ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 5) DESC, vec_id LIMIT 20""",
)
def j14_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to vector 0."""
    e = read(spark, sf_dir, "embeddings")
    probe = e.filter("vec_id = 0").select("embedding").first()["embedding"]
    sim = F.round(signals.cosine(F.col("embedding"), F.array(*map(F.lit, probe))), 5)
    return e.filter("vec_id <> 0").select("vec_id", sim.alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(20)


RANKED_SQL = f"""{_bm25_sql()}, fz AS (SELECT bm.id, round(1.0 / (60 + r1) + 1.0 / (60 + r2), 9) AS fused FROM bm JOIN {mean_sql('score', 'bm', 'r1')} USING (id) JOIN {mean_sql('length(title)', 'pool', 'r2')} USING (id)),
od AS (SELECT id, fused, row_number() OVER (ORDER BY fused DESC, id) AS position FROM fz)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, fused, position): a whole pool in fused order of BM25 and title length."""
    p = pool(spark, sf_dir)
    both = signals.bm25(signals.whole(p), query_words(spark, sf_dir)).withColumnRenamed("score", "r1").join(p.select("id", F.length("title").alias("r2")), "id")
    return ranks.positions(ranks.rank_all(both, ["r1", "r2"]).select("id", ranks.rrf(["r1", "r2"]).alias("fused")), "fused", "id")


@query("f2_fused_positions", f"WITH {RANKED_SQL} SELECT id, fused, position FROM od")
def f2_fused_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir)


@query("g4_fixed_batches", f"WITH {RANKED_SQL} SELECT CAST((position - 1) // 40 AS BIGINT) AS batch, count(*) AS n, min(id) AS least FROM od GROUP BY ALL")
def g4_fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = F.floor((F.col("position") - 1) / 40).cast("long")
    return ranked(spark, sf_dir).groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


@query(
    "g16_protected_reorder",
    f"""WITH {RANKED_SQL}, x AS (SELECT od.id, position, CASE WHEN position <= 20 THEN 0 WHEN position <= 500 THEN 1 ELSE 2 END AS tier, length(title) AS cites FROM od JOIN pool USING (id))
SELECT id, row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN -cites ELSE position END, position) AS delivered FROM x""",
)
def g16_protected_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 stay, 21 to 500 are reordered by a second signal, the rest follows."""
    r = ranked(spark, sf_dir).join(pool(spark, sf_dir).select("id", F.length("title").alias("cites")), "id")
    middle = r.filter("position between 21 and 500")  # at most 480 rows
    moved = middle.withColumn("delivered", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("cites"), "position")) + 20)
    fixed = r.filter("position <= 20 or position > 500").withColumn("delivered", F.col("position"))
    return fixed.unionByName(moved).select("id", F.col("delivered").cast("long").alias("delivered"))


@query(
    "j13_rerank_blend",
    f"""WITH {RANKED_SQL}, x AS (SELECT id, position, CASE WHEN position <= 100 AND id % 3 <> 0 THEN row_number() OVER (PARTITION BY position <= 100 AND id % 3 <> 0 ORDER BY id DESC) END AS rr FROM od WHERE position <= 100),
y AS (SELECT id, position, coalesce(rr, (count(rr) OVER () + 1 + count(*) OVER ()) / 2.0) AS rr FROM x)
SELECT id, round(1.0 / (60 + position) + 1.0 / (60 + rr), 9) AS blended FROM y""",
)
def j13_rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 100 blended with a second order; what that did not score shares the middle of its tail."""
    head = ranked(spark, sf_dir).filter("position <= 100")
    scored = head.filter("id % 3 <> 0").select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("id"))).alias("rr"))  # the window is bounded
    n, m = head.count(), scored.count()
    both = head.join(scored, "id", "left").withColumn("rr", F.coalesce(F.col("rr").cast("double"), F.lit((m + 1 + n) / 2)))
    return both.select("id", ranks.rrf(["position", "rr"]).alias("blended"))


LISTS_SQL = "h AS (SELECT l_suppkey % 40 AS list, l_orderkey AS rec, min(l_linenumber) AS place FROM lineitem GROUP BY ALL)"


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query lists: (list, rec, place), a record's best place in each."""
    l = read(spark, sf_dir, "lineitem")
    return l.groupBy((F.col("l_suppkey") % 40).alias("list"), F.col("l_orderkey").alias("rec")).agg(F.min("l_linenumber").alias("place"))


@query("g6_query_list_votes", f"WITH {LISTS_SQL} SELECT rec, count(*) AS n_lists, round(sum(1.0 / (60 + place + 1)), 9) AS votes FROM h WHERE list % 4 <> 3 GROUP BY rec")
def g6_query_list_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the lists that vote: the sum of 1 / (60 + place + 1)."""
    return lists(spark, sf_dir).filter("list % 4 <> 3").groupBy("rec").agg(F.count(F.lit(1)).alias("n_lists"), F.round(F.sum(1.0 / (61 + F.col("place"))), 9).alias("votes"))


@query("g7_focused_only", f"WITH {LISTS_SQL} SELECT rec FROM h GROUP BY rec HAVING bool_and(list % 4 = 3)")
def g7_focused_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in narrow lists and in no other."""
    return lists(spark, sf_dir).groupBy("rec").agg(F.bool_and(F.col("list") % 4 == 3).alias("narrow")).filter("narrow").select("rec")


@query(
    "g5_window_floors_reserve",
    f"""WITH {LISTS_SQL}, v AS (SELECT rec, round(sum(1.0 / (60 + place + 1)), 9) AS votes FROM h GROUP BY rec),
fl AS (SELECT rec FROM (SELECT rec, row_number() OVER (PARTITION BY list ORDER BY place, rec) AS k FROM h) WHERE k <= 2),
rs AS (SELECT rec FROM (SELECT rec FROM h GROUP BY rec HAVING bool_and(list % 4 = 3) ORDER BY rec LIMIT 20)),
t AS (SELECT v.rec, v.votes, CASE WHEN rs.rec IS NOT NULL THEN 0 WHEN fl.rec IS NOT NULL THEN 1 ELSE 2 END AS tier FROM v LEFT JOIN rs USING (rec) LEFT JOIN (SELECT DISTINCT rec FROM fl) fl USING (rec))
SELECT rec, tier, votes FROM t ORDER BY tier, votes DESC, rec LIMIT 200""",
)
def g5_window_floors_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 200: a reserve of focused records, two places for every list, the rest by votes."""
    h = lists(spark, sf_dir)
    votes = h.groupBy("rec").agg(F.round(F.sum(1.0 / (61 + F.col("place"))), 9).alias("votes"), F.bool_and(F.col("list") % 4 == 3).alias("narrow"))
    floors = h.withColumn("k", F.row_number().over(Window.partitionBy("list").orderBy("place", "rec"))).filter("k <= 2").select("rec").distinct().withColumn("floor", F.lit(True))
    reserve = votes.filter("narrow").select("rec").orderBy("rec").limit(20).withColumn("reserve", F.lit(True))
    tier = F.when(F.col("reserve"), 0).when(F.col("floor"), 1).otherwise(2)
    return votes.join(reserve, "rec", "left").join(floors, "rec", "left").select("rec", tier.alias("tier"), "votes").orderBy("tier", F.desc("votes"), "rec").limit(200)


@query(
    "g11_round_robin_merge",
    f"""WITH {LISTS_SQL}, k AS (SELECT list, rec, row_number() OVER (PARTITION BY list ORDER BY place, rec) AS k FROM h WHERE list < 6),
f AS (SELECT rec, min(k * 1000 + list) AS turn FROM k WHERE k <= 50 GROUP BY rec) SELECT rec, CAST(turn AS BIGINT) AS turn FROM f ORDER BY turn LIMIT 40""",
)
def g11_round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists merged in turn, first places first, without repeats, cut at 40."""
    k = lists(spark, sf_dir).filter("list < 6").withColumn("k", F.row_number().over(Window.partitionBy("list").orderBy("place", "rec"))).filter("k <= 50")
    return k.groupBy("rec").agg(F.min(F.col("k") * 1000 + F.col("list")).cast("long").alias("turn")).orderBy("turn").limit(40)


@query(
    "g9_allocate_breadth",
    """WITH c AS (SELECT o_custkey AS src, o_orderkey AS psg, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS depth FROM orders)
SELECT src, psg, depth FROM c WHERE depth <= 3 ORDER BY depth, src LIMIT 300""",
)
def g9_allocate_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth before depth: the first of every source, then the second, at most three a source, 300 in all."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("psg"), "o_totalprice")
    deep = o.withColumn("depth", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("o_totalprice"), "psg"))).filter("depth <= 3")
    return deep.orderBy("depth", "src").limit(300).select("src", "psg", "depth")

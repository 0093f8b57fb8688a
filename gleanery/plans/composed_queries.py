"""The composed ranking over the test tables (inventory group J): documents as records, parts of equal order key as what they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import composed as C, evidence, passage_index, signals
from gleanery.plans.ranking import _W, BLOCKS_SQL, _blocks, _bm25_sql, mean_sql, query_words
from gleanery.registry import query
from gleanery.sources.tables import pool, read, spread, tokens_sql
from gleanery.stage import stored

#: The verified seeds, and which of them came as a PDF.
VERIFIED, PDF = (10, 11, 30), 30


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.collect_set(F.concat(F.lit("w"), F.col("l_partkey").cast("string")))
    refs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(cited.alias("references"))
    counts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") % 97).cast("long").alias("cited_by_count"))
    p = pool(spark, sf_dir).select("id", "title", "abstract").join(counts, "id").join(refs, "id", "left")
    own = F.array(F.concat(F.lit("w"), F.col("id").cast("string")))
    return p.select("id", (F.col("id") - (F.col("id") % 10 == 9).cast("int")).alias("work_id"), "title", "abstract", own.alias("own_ids"), "references", "cited_by_count")


def verified(all_records: DataFrame) -> DataFrame:
    return all_records.filter(F.col("id").isin(*VERIFIED)).withColumn("seed_pdf", F.col("id") == PDF)


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    probe = e.filter("vec_id = 0").select("embedding").first()["embedding"]
    return e.select(F.col("vec_id").alias("id"), F.round(signals.cosine(F.col("embedding"), F.array(*map(F.lit, probe))), 5).alias("similarity"))


def question(spark: SparkSession, sf_dir: str) -> C.Question:
    return C.Question(query_words(spark, sf_dir), _blocks(spark, sf_dir), None, "seed_max_v2")


_IN = ", ".join(map(str, VERIFIED))


def _graph_sql(name: str, seeds: str, twice: bool) -> str:
    """The graph signal around a table of seeds (id, pdf), as common table expressions."""
    return f"""{name}_p AS (SELECT id, seed, any_value(pdf) AS pdf, sum(v) AS v FROM (
 SELECT a.id, b.id AS seed, pdf, count(*) / sqrt(any_value(x.n) * any_value(y.n)) AS v FROM ref a JOIN ref b USING (t) JOIN {seeds} s ON s.id = b.id JOIN nr x ON x.id = a.id JOIN nr y ON y.id = b.id GROUP BY a.id, b.id, pdf
 UNION ALL SELECT DISTINCT a.id, s.id, pdf, 1.0 FROM ref a JOIN {seeds} s ON s.id = a.t
 UNION ALL SELECT DISTINCT b.t, s.id, pdf, {2.0 if twice else 1.0} FROM ref b JOIN {seeds} s ON s.id = b.id) q JOIN rec m USING (id) JOIN rec o ON o.id = seed WHERE m.work <> o.work GROUP BY q.id, seed),
{name} AS (SELECT rec.id, any_value(refs) AS refs, round(coalesce(sum(v) FILTER (NOT pdf), 0) + coalesce(max(v) FILTER (pdf), 0), 9) AS score FROM rec LEFT JOIN {name}_p USING (id) GROUP BY rec.id)"""


_REC = f"""ref AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS t FROM lineitem JOIN documents ON doc_id = l_orderkey), nr AS (SELECT id, count(*) AS n FROM ref GROUP BY id),
rec AS (SELECT pool.id, pool.id - CASE WHEN pool.id % 10 = 9 THEN 1 ELSE 0 END AS work, length(abstract) > 0 AS has, n IS NOT NULL AS refs, CASE WHEN pool.id % 11 <> 0 THEN n_chars % 97 END AS cites FROM pool JOIN documents ON doc_id = pool.id LEFT JOIN nr ON nr.id = pool.id),
vf AS (SELECT id, work, id = {PDF} AS pdf FROM rec WHERE id IN ({_IN}))"""

_FIRST = f"""{_bm25_sql()}, {BLOCKS_SQL}, {_REC},
f1 AS (SELECT x.id, r1, r2, round(1.0 / (60 + r1) + 1.0 / (60 + r2), 9) AS fused FROM {mean_sql('score', 'bm', 'r1')} x JOIN {mean_sql('in_title * 1000 + forms', 'bl', 'r2')} y USING (id)),
sd AS (SELECT id, pdf FROM vf UNION ALL (SELECT id, FALSE FROM f1 JOIN rec USING (id) WHERE work NOT IN (SELECT work FROM vf) ORDER BY fused DESC, id LIMIT {C.FIRST_SEEDS - len(VERIFIED) + 1}))"""

_TFIDF = f"""tn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM w), fr AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT id, unnest(tok) AS word FROM w) GROUP BY word),
tv AS (SELECT id, word, (1 + ln(count(*))) * ln(any_value(n) / any_value(df)) AS x FROM (SELECT id, unnest(tok) AS word FROM w) JOIN fr USING (word), tn WHERE df < n GROUP BY id, word),
tu AS (SELECT id, word, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM tv),
td AS (SELECT a.id, b.id AS seed, sum(a.x * b.x) AS d FROM tu a JOIN tu b USING (word) JOIN vf ON vf.id = b.id GROUP BY ALL),
ti AS (SELECT rec.id, any_value(has) AS has, round(coalesce(max(d) FILTER (rec.work <> vf.work), 0.0), 9) AS score FROM rec LEFT JOIN td USING (id) LEFT JOIN vf ON vf.id = seed GROUP BY rec.id)"""

_REPLAY = f"""{_FIRST}, {_TFIDF}, {_graph_sql('g1', 'sd', False)},
em AS (SELECT rec.id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 5) AS score FROM rec LEFT JOIN embeddings ON vec_id = rec.id),
rk AS (SELECT f1.id, r1, r2, r3, r4, r5 FROM f1 JOIN {mean_sql('score', 'ti', 'r3', 'has')} USING (id) JOIN {mean_sql('score', 'g1', 'r4', 'refs')} USING (id) JOIN {mean_sql('coalesce(score, 0)', 'em', 'r5', 'score IS NOT NULL')} USING (id)),
o1 AS (SELECT id, row_number() OVER (ORDER BY round(1.0 / (60 + r1) + 1.0 / (60 + r2) + 1.0 / (60 + r3) + 1.0 / (60 + r4) + 1.0 / (60 + r5), 9) DESC, id) AS first FROM rk),
s2 AS (SELECT id, pdf FROM vf UNION ALL (SELECT id, FALSE FROM o1 JOIN rec USING (id) WHERE refs AND work NOT IN (SELECT work FROM vf) ORDER BY first LIMIT {C.SECOND_SEEDS})),
{_graph_sql('g2', 's2', True)},
rr AS (SELECT rk.id, r1, r2, r3, x.r4, r5, r6 FROM rk JOIN {mean_sql('score', 'g2', 'r4', 'refs')} x USING (id) JOIN {mean_sql('ln(1 + coalesce(cites, 0))', 'rec', 'r6', 'cites IS NOT NULL')} USING (id)),
o2 AS (SELECT *, row_number() OVER (ORDER BY round(1.0 / (60 + r1) + 1.0 / (60 + r2) + 1.0 / (60 + r3) + 1.0 / (60 + r4) + 1.0 / (60 + r5), 9) DESC, id) AS base,
 round(1.0 / (60 + r1) + 1.0 / (60 + r2) + 1.0 / (60 + r3) + 2.0 / (60 + r4) + 1.0 / (60 + r5) + 2.0 / (60 + r6), 9) AS again FROM rr),
ti2 AS (SELECT id, first, base, again, CASE WHEN first <= {C.HEAD} THEN 0 WHEN base <= {C.HEAD} THEN 1 WHEN base <= {C.REACH} THEN 2 ELSE 3 END AS tier FROM o2 JOIN o1 USING (id))"""


@query("j11_graph_seeds", f"WITH {_FIRST} SELECT id, pdf FROM sd")
def j11_graph_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's seeds: verified records, then the top of BM25 and blocks that is none of their works."""
    r = stored(records(spark, sf_dir), "manifest")
    return C.graph_seeds(r, verified(r), question(spark, sf_dir))[1].select("id", F.col("seed_pdf").alias("pdf"))


@query("j6_graph_scores", f"WITH {_FIRST}, {_graph_sql('g', 'vf', True)} SELECT id, round(score, 6) AS score FROM g")
def j6_graph_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupling and citations around the verified seeds, the seed PDF by its nearness alone."""
    r = records(spark, sf_dir)
    return C.graph(r, verified(r), nearest_pdf=True, cited_twice=True).select("id", F.round("graph", 6).alias("score"))


@query("j12_replayed_order", f"WITH {_REPLAY} SELECT id, row_number() OVER (ORDER BY tier, CASE tier WHEN 0 THEN first WHEN 2 THEN 0 ELSE base END, again DESC, id) AS place FROM ti2")
def j12_replayed_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen pool replayed: all signals, a second graph pass, citation counts and the reorder behind the head."""
    r = stored(records(spark, sf_dir), "manifest")
    return C.replay(r, verified(r), question(spark, sf_dir), similarities(spark, sf_dir))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(passage_id, source, text): the documents' passages of fixed length."""
    cut = evidence.fixed_passages(spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text")), keep=["source"])
    return cut.select((F.col("doc_id") * 100_000 + F.col("chunk_no")).alias("passage_id"), "source", F.col("chunk").alias("text"))


_PASSAGES_SQL = f"""ps AS (SELECT doc_id * 100000 + i AS id, source, {tokens_sql('substr(text, CAST(i * 1400 + 1 AS INT), 1400)')} AS tok FROM (SELECT doc_id, source, text, unnest(range(0, (greatest(length(text), 1) + 1399) // 1400)) AS i FROM documents)),
ls AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tok)) AS av FROM ps),
tf AS (SELECT id, source, dl, term, count(*) AS tf FROM (SELECT id, source, len(tok) AS dl, unnest(tok) AS term FROM ps) GROUP BY ALL),
idf AS (SELECT term, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM tf, ls GROUP BY term),
qs AS (SELECT DISTINCT item_id AS query, unnest({tokens_sql('text')}) AS term FROM benchmark),
sc AS (SELECT query, id, source, round(sum(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)))), 9) AS score FROM qs JOIN idf USING (term) JOIN tf USING (term), ls GROUP BY query, id, source)"""


@query(
    "j2_passage_search",
    f"WITH {_PASSAGES_SQL}, lm AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY score DESC, id) AS k FROM sc) SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place, id, round(score, 6) AS score FROM lm WHERE k <= 3 QUALIFY place <= 10",
)
def j2_passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query over all passages: the best ten, at most three of a source."""
    index = passage_index.build(passages(spark, sf_dir))
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return passage_index.search(index, queries, k=10, per_source=3).hits.select("query", F.col("place").cast("long").alias("place"), "id", F.round("score", 6).alias("score"))

"""Streaming queries over the event log (inventory group R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.registry import query
from gleanery.functions import text as T
from gleanery.sources.tables import read, tokens_sql
from gleanery.stage import fresh
from gleanery.streaming import events as S, revisions, watch


@query("r1_event_tail", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def r1_event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 200 events after a last seen id, from a drained stream."""
    return S.drain(S.stream_of(spark, sf_dir).filter("event_id > 500").select("event_id", "user_id", "event_type")).orderBy("event_id").limit(200)


@query("r3_event_dedup", "SELECT DISTINCT event_id, user_id FROM events")
def r3_event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event sent twice, kept once."""
    sent = S.stream_of(spark, sf_dir)
    return S.drain(S.once_per_id(sent.union(sent)).select("event_id", "user_id"))


@query("r4_late_rows", "SELECT event_id, TRUE AS late FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def r4_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.split_late(S.stream_of(spark, sf_dir), "2024-01-20 00:00:00")[1].select("event_id", "late"))


@query("r6_gap_detection", "SELECT user_id, event_id FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOURS AS gap FROM events) WHERE gap")
def r6_gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that follow a silence of over twelve hours."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(ts).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, sf_dir, "events").withColumn("gap", ts - before > 12 * 3600 * 1_000_000).filter("gap").select("user_id", "event_id")


@query("r7_daily_windows", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def r7_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.daily(S.stream_of(spark, sf_dir)), "complete")


@query("r8_sliding_windows", "SELECT CAST(epoch(date_trunc('hour', ts)) + (minute(ts) // 20) * 1200 - k * 1200 AS BIGINT) AS start, count(*) AS n FROM events, (VALUES (0), (1), (2)) v(k) GROUP BY ALL")
def r8_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.sliding(S.stream_of(spark, sf_dir)), "complete")


@query(
    "r9_sessions_6h",
    """WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM y GROUP BY user_id, s""",
)
def r9_sessions_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(S.sessions(S.stream_of(spark, sf_dir)), "complete")


@query(
    "r5_late_revisions",
    """WITH a AS (SELECT user_id, min((epoch_us(ts) // 1000)) AS a FROM events WHERE event_type = 'purchase' GROUP BY user_id),
l AS (SELECT e.user_id, a, (epoch_us(ts) // 1000) AS t, event_id FROM events e JOIN a USING (user_id) WHERE event_type = 'click' AND (epoch_us(ts) // 1000) > a AND (epoch_us(ts) // 1000) <= a + 259200000),
d AS (SELECT user_id, any_value(a) AS a, min(t) + 21600000 AS due FROM l GROUP BY user_id),
m AS (SELECT d.user_id, due, d.a, (SELECT count(*) > 0 FROM events e WHERE e.user_id = d.user_id AND event_type = 'error' AND (epoch_us(ts) // 1000) > d.a AND (epoch_us(ts) // 1000) <= due) AS moved FROM d WHERE due < (SELECT max((epoch_us(ts) // 1000)) FROM events) - 86400000)
SELECT user_id AS key, CASE WHEN moved THEN 'skipped' ELSE 'revised' END AS status, due AS due_ms,
 CASE WHEN moved THEN '' ELSE (SELECT string_agg(event_id, ',' ORDER BY event_id) FROM l WHERE l.user_id = m.user_id AND t <= due) END AS items FROM m""",
)
def r5_late_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first purchase as the answer, clicks as late texts, errors as a rescoped question: one decision a user at most."""
    kind = F.when(F.col("event_type") == "purchase", "answered").when(F.col("event_type") == "click", "late").when(F.col("event_type") == "error", "rescoped")
    rows = S.stream_of(spark, sf_dir).select(F.col("user_id").alias("key"), kind.alias("kind"), F.col("event_id").alias("item"), "ts")
    found = S.drain(revisions.decide(rows.filter("kind IS NOT NULL"), 72 * 3_600_000, 6 * 3_600_000, "1 day"))
    return found.select("key", "status", "due_ms", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"))


@query(
    "d19_alias_works",
    f"""WITH RECURSIVE t AS (SELECT doc_id AS id, {tokens_sql('text')} AS w FROM documents),
n AS (SELECT id, 'open:' || array_to_string(w[1:6], ' ') AS alias FROM t WHERE len(w) > 0 UNION ALL SELECT id, 'close:' || array_to_string(w[-6:], ' ') FROM t WHERE len(w) > 0),
e AS (SELECT DISTINCT min(id) OVER (PARTITION BY alias) AS a, id AS b FROM n), e2 AS (SELECT a, b FROM e WHERE a <> b UNION ALL SELECT b, a FROM e WHERE a <> b),
r AS (SELECT id AS a, id AS b FROM t UNION SELECT r.a, e2.b FROM r JOIN e2 ON e2.a = r.b) SELECT a AS id, min(b) AS work FROM r GROUP BY a""",
)
def d19_alias_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of records whose opening and closing words are aliases; works join by any of them, transitively."""
    w = T.words(F.col("text"))
    names = F.when(F.size(w) > 0, F.array(F.concat(F.lit("open:"), F.array_join(F.slice(w, 1, 6), " ")), F.concat(F.lit("close:"), F.array_join(F.slice(w, F.greatest(F.size(w) - 5, F.lit(1)), F.lit(6)), " "))))
    found = S.table_stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), names.alias("aliases"), F.lit(False).alias("published"), F.lit(None).cast("string").alias("doi"), F.col("doc_id").alias("created"))
    folder = fresh(spark, "watch")
    state = watch.Watch(spark, folder)
    state.follow(found, f"{folder}-checkpoint")
    return state.works()

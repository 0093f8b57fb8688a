"""Caps, budgets, slots, runs, upserts and histories over the test tables (inventory groups E, F, G, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import decisions as D, ranks, selection as S
from gleanery.registry import query
from gleanery.sources.tables import read


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with their lengths."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.length("text").alias("n"))


@query("f5_named_representative", "SELECT o_custkey, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN min(o_orderkey) FILTER (o_orderpriority = '1-URGENT') ELSE min(o_orderkey) END AS representative FROM orders GROUP BY o_custkey")
def f5_named_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's head if it has one, else its smallest member."""
    key = F.struct((F.col("o_orderpriority") != "1-URGENT").alias("other"), "o_orderkey")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(key)["o_orderkey"].alias("representative"))


@query("f7_previous_decision", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 2")
def f7_previous_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.previous(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("f8_next_position", "SELECT conv_id, max(turn) + 1 AS next FROM conversations GROUP BY conv_id")
def f8_next_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("conv_id").agg((F.max("turn") + 1).alias("next"))


@query("f9_consecutive_runs", "SELECT l_suppkey, min(l_partkey) AS first, max(l_partkey) AS last, count(*) AS n FROM (SELECT l_suppkey, l_partkey, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) GROUP BY l_suppkey, g")
def f9_consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.islands(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey")


@query("f10_capped_positions", "SELECT o_custkey, o_orderkey, k AS depth FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k <= 3")
def f10_capped_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three of every source, with their depth."""
    return S.numbered(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "depth").filter("depth <= 3").select("o_custkey", "o_orderkey", "depth")


_WALK = """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, turn, length(text) AS n FROM conversations),
r AS (SELECT conv_id, k, turn, {first} FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, t.turn, {next} FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)"""


@query(
    "f11_running_batches",
    _WALK.format(first="n AS used, 0 AS batch", next="CASE WHEN r.used > 0 AND r.used + n > 400 THEN n ELSE r.used + n END, r.batch + CASE WHEN r.used > 0 AND r.used + n > 400 THEN 1 ELSE 0 END") + " SELECT conv_id, turn, CAST(batch AS INT) AS batch FROM r",
)
def f11_running_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in batches of at most 400 characters."""
    return S.batches(turns(spark, sf_dir), ["conv_id"], "turn", "turn", "n", 400)


@query(
    "f16_greedy_budget",
    _WALK.format(first="CASE WHEN n <= 600 THEN n ELSE 0 END AS used, n <= 600 AS kept", next="CASE WHEN r.used + n <= 600 THEN r.used + n ELSE r.used END, r.used + n <= 600") + " SELECT conv_id, turn FROM r WHERE kept",
)
def f16_greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns taken in order while they fit in 600 characters; what does not fit is passed over."""
    return S.greedy_fill(turns(spark, sf_dir), ["conv_id"], "turn", "turn", "n", 600)


@query("f18_prefix_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations) WHERE run <= 600")
def f18_prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.within_budget(turns(spark, sf_dir), ["conv_id"], ["turn"], "n", 600).select("conv_id", "turn")


@query("f15_best_place", "SELECT l_partkey, min(place) AS best FROM (SELECT l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS place FROM lineitem) GROUP BY l_partkey")
def f15_best_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's best place over the lists that hold it."""
    k = S.numbered(read(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber", "l_partkey"], "place")
    return k.groupBy("l_partkey").agg(F.min("place").alias("best"))


@query(
    "f14_repeated_edges",
    r"""WITH l AS (SELECT doc_id, page, trim(line, ' ') AS line FROM (SELECT doc_id, k AS page, ls[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents))),
t AS (SELECT doc_id, count(DISTINCT page) AS total FROM l GROUP BY doc_id), m AS (SELECT doc_id, regexp_replace(line, '[0-9]+', '#', 'g') AS masked, count(DISTINCT page) AS n FROM l GROUP BY ALL HAVING masked <> '')
SELECT doc_id, masked, n FROM m JOIN t USING (doc_id) WHERE n >= 3 AND n >= 0.4 * total""",
)
def f14_repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur in a text but for their digits: at least three times and in 40 % of its lines."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))
    return S.repeated_edges(lines, "doc_id", "page", "line")


_ORD = "o AS (SELECT o_orderkey, o_totalprice, o_orderstatus, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in one order, dearest first, numbered by ranges."""
    return ranks.positions(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_totalprice", "o_orderkey")


@query("g3_page_with_total", f"WITH {_ORD} SELECT o_orderkey, position, (SELECT count(*) FROM orders) AS total FROM o WHERE position BETWEEN 101 AND 150")
def g3_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of fifty, with the number of all rows."""
    p = placed(spark, sf_dir)
    return p.filter("position between 101 and 150").select("o_orderkey", "position").withColumn("total", F.lit(p.count()))


@query("g8_chain_only", "SELECT rec FROM (SELECT l_orderkey AS rec, l_suppkey % 4 = 0 AS chained FROM lineitem UNION ALL SELECT o_orderkey, FALSE FROM orders WHERE o_orderstatus = 'P') GROUP BY rec HAVING bool_and(chained)")
def g8_chain_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that chains found and nothing else."""
    found = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rec"), (F.col("l_suppkey") % 4 == 0).alias("chained"))
    other = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("rec"), F.lit(False).alias("chained"))
    return found.unionByName(other).groupBy("rec").agg(F.bool_and("chained").alias("only")).filter("only").select("rec")


@query(
    "g10_role_phases",
    """WITH p AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 0 WHEN role = 'user' THEN 1 ELSE 2 END AS phase FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, phase ORDER BY turn) AS depth FROM p)
SELECT conv_id, turn, phase, depth FROM k ORDER BY phase, depth, conv_id, turn LIMIT 200""",
)
def g10_role_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forced rows first, then questions, then answers; breadth before depth in each phase; 200 in all."""
    phase = F.when(F.col("turn") == 0, 0).when(F.col("role") == "user", 1).otherwise(2)
    p = S.numbered(turns(spark, sf_dir).withColumn("phase", phase), ["conv_id", "phase"], ["turn"], "depth")
    return p.orderBy("phase", "depth", "conv_id", "turn").limit(200).select("conv_id", "turn", "phase", "depth")


@query("g14_user_first", f"WITH {_ORD} SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey % 97 = 0 DESC, position) AS place FROM o")
def g14_user_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the person named first, then the delivered order."""
    p = placed(spark, sf_dir)
    return ranks.positions(p.withColumn("s", (F.col("o_orderkey") % 97 == 0).cast("int")).drop("o_totalprice"), "s", "position", "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query(
    "g15_fixed_slots",
    f"""WITH {_ORD}, h AS (SELECT *, o_orderstatus = 'F' AS held FROM o WHERE position <= 300),
s AS (SELECT position AS slot, row_number() OVER (ORDER BY position) AS n FROM h WHERE NOT held), m AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM h WHERE NOT held)
SELECT o_orderkey, position AS slot FROM h WHERE held UNION ALL SELECT o_orderkey, slot FROM m JOIN s USING (n)""",
)
def g15_fixed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a window of 300 the held records keep their slots; the others fill the gaps by id."""
    window = placed(spark, sf_dir).filter("position <= 300")
    return S.fixed_slots(window, "position", F.col("o_orderstatus") == "F", ["o_orderkey"]).select("o_orderkey", F.col("slot").cast("long").alias("slot"))


@query(
    "g17_head_and_stride",
    f"WITH {_ORD}, n AS (SELECT count(*) AS total FROM orders) SELECT o_orderkey FROM o, n WHERE total <= 60 OR position <= 30 OR ((position - 30) * 30 // (total - 30) > (position - 31) * 30 // (total - 30))",
)
def g17_head_and_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty rows: the first thirty and thirty in even strides over the rest."""
    p = placed(spark, sf_dir)
    return S.head_and_stride(p, "position", p.count(), 60).select("o_orderkey")


@query(
    "g18_source_order",
    """WITH f AS (SELECT p_partkey, p_size = 1 AS asked, count(DISTINCT l_suppkey) AS providers, round(coalesce(sum(l_quantity), 0), 2) AS score FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_partkey, row_number() OVER (ORDER BY asked DESC, providers DESC, score DESC, p_partkey) AS place FROM f ORDER BY place LIMIT 500""",
)
def g18_source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of an answer: named by the person, then by providers, relevance and id; the first 500."""
    facts = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("providers"), F.round(F.sum("l_quantity"), 2).alias("score"))
    p = read(spark, sf_dir, "part").join(facts, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", (F.col("p_size") == 1).alias("asked"), F.coalesce("providers", F.lit(0)).alias("providers"), F.coalesce("score", F.lit(0.0)).alias("score"))
    head = p.orderBy(F.desc("asked"), F.desc("providers"), F.desc("score"), "p_partkey").limit(500)
    return S.numbered(head.withColumn("_g", F.lit(0)), ["_g"], [F.desc("asked"), F.desc("providers"), F.desc("score"), "p_partkey"], "place").select("p_partkey", F.col("place").cast("long").alias("place"))


@query(
    "g19_fetch_plan",
    "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) <= CASE o_orderpriority WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 50 ELSE 0 END AS planned FROM orders",
)
def g19_fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which works are fetched: groups with room, in order of date; the rest is overflow."""
    room = spark.createDataFrame([("1-URGENT", 100), ("2-HIGH", 50)], "o_orderpriority string, room int")
    return S.room_per_group(read(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderdate", "o_orderkey"], room).select("o_orderkey", "o_orderpriority", "planned")


@query("g21_rotating_roll", "WITH n AS (SELECT count(*) AS total FROM supplier), k AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier) SELECT s_suppkey, ((k - 1 - 7) % total + total) % total AS turn FROM k, n WHERE ((k - 1 - 7) % total + total) % total < 20")
def g21_rotating_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty sources after position seven, from the start again at the end."""
    s = ranks.positions(read(spark, sf_dir, "supplier").select("s_suppkey").withColumn("_s", F.lit(0)), "_s", "s_suppkey")
    return S.roll(s, "position", 7, s.count(), 20).select("s_suppkey", F.col("turn").cast("long").alias("turn"))


@query("g12_quota_round_robin", "SELECT conv_id, turn, k FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS k FROM conversations) WHERE k <= 2")
def g12_quota_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns of each role in every conversation, longest first."""
    return S.numbered(turns(spark, sf_dir), ["conv_id", "role"], [F.desc("n"), "turn"]).filter("k <= 2").select("conv_id", "turn", "k")


@query(
    "g20_priority_passages",
    """WITH t AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN turn < 1 THEN 0 WHEN role = 'user' THEN 1 ELSE 2 END AS tier FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY tier, n DESC, turn) AS k, count(*) OVER (PARTITION BY conv_id) AS total FROM t) SELECT conv_id, turn, tier FROM k WHERE k <= total // 2""",
)
def g20_priority_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most half of a conversation: by tier, then length."""
    t = turns(spark, sf_dir).withColumn("tier", F.when(F.col("turn") < 1, 0).when(F.col("role") == "user", 1).otherwise(2))
    total = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    k = S.numbered(t, ["conv_id"], ["tier", F.desc("n"), "turn"]).join(total, "conv_id")
    return k.filter(F.col("k") <= F.floor(F.col("total") / 2)).select("conv_id", "turn", "tier")


@query("h4_stable_dedup", "SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def h4_stable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stable_distinct(read(spark, sf_dir, "events"), ["event_type", "user_id"], ["ts", "event_id"]).select("event_type", "user_id", "event_id")


_UP = "old AS (SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), new AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"


def _two_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), "o_orderstatus")
    return o.filter("o_orderstatus = 'F'").groupBy("k").agg(F.max("v").alias("v")), o.filter("o_orderstatus = 'O'").select("k", "v")


@query("h5_upsert", f"WITH {_UP} SELECT k, coalesce(new.v, old.v) AS v FROM old FULL JOIN new USING (k)")
def h5_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_versions(spark, sf_dir)
    return S.upsert(old, new, ["k"], ["v"])


@query("h5_insert_or_ignore", f"WITH {_UP} SELECT k, coalesce(old.v, new.v) AS v FROM old FULL JOIN new USING (k)")
def h5_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two_versions(spark, sf_dir)
    return S.upsert(old, new, ["k"], ["v"], ignore=True)


@query(
    "h7_exactly_one",
    "WITH p AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey AS k, count(p.k) AS n FROM customer LEFT JOIN p ON p.k = c_custkey GROUP BY c_custkey HAVING count(p.k) <> 1",
)
def h7_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the universe that two parts do not split between them."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    parts = [o.filter(F.col("o_orderstatus") == s).select("k").distinct() for s in ("F", "P")]
    return S.exactly_one(parts, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query(
    "e18_ranking_capture",
    """WITH r AS (SELECT source, doc_id, rank() OVER (PARTITION BY source ORDER BY n_chars DESC) - 1 AS above, count(*) OVER (PARTITION BY source, n_chars) AS ties FROM documents)
SELECT source, CASE WHEN above + ties <= 25 THEN 'sure' WHEN above < 25 THEN 'open' ELSE 'out' END AS capture, count(*) AS n FROM r GROUP BY ALL""",
)
def e18_ranking_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows surely within the first 25 of a source's ranking, those on the cut, and those outside."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return S.tie_spans(d, ["source"], "n_chars", 25).groupBy("source", "capture").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e19_table_choice",
    "WITH a AS (SELECT l_linenumber, avg(l_quantity) AS m FROM lineitem GROUP BY 1), t AS (SELECT l_linenumber FROM a ORDER BY round(m, 6) DESC, l_linenumber LIMIT 3) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN t USING (l_linenumber) ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 120",
)
def e19_table_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three columns of best mean, then their 120 best cells."""
    l = read(spark, sf_dir, "lineitem")
    top = l.groupBy("l_linenumber").agg(F.round(F.avg("l_quantity"), 6).alias("m")).orderBy(F.desc("m"), "l_linenumber").limit(3).select("l_linenumber")
    return l.join(F.broadcast(top), "l_linenumber", "left_semi").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(120).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("e20_work_groups", "WITH w AS (SELECT l_orderkey AS work, min(l_returnflag) AS grp FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1) SELECT grp, count(*) AS works FROM w GROUP BY grp")
def e20_work_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by group, without those on which their rows disagree."""
    w = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("grp"), F.max("l_returnflag").alias("other"))
    return w.filter("grp = other").groupBy("grp").agg(F.count(F.lit(1)).alias("works"))


@query("e21_axis_coverage", "SELECT p_brand, count(*) AS n_rows, count(*) FILTER (p_size > 10) AS answered, max(p_size) AS deepest FROM part GROUP BY p_brand")
def e21_axis_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("p_size") > 10).alias("answered"), F.max("p_size").alias("deepest"))


@query("e26_evidence_status", "SELECT l_orderkey, count(DISTINCT l_partkey) AS cited, count(DISTINCT l_partkey) FILTER (l_returnflag <> 'N') AS located FROM lineitem GROUP BY l_orderkey")
def e26_evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_partkey").alias("cited"), F.count_distinct(F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))).alias("located"))


@query("e27_read_coverage", "SELECT conv_id, count(*) AS parts, count(*) FILTER (role = 'user') AS shown, count(*) = count(*) FILTER (role = 'user') AS all_parts_shown FROM conversations GROUP BY conv_id")
def e27_read_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = turns(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("role") == "user").alias("shown"))
    return g.withColumn("all_parts_shown", F.col("parts") == F.col("shown"))


@query("e12_requests_per_host", "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host, count(*) AS sent, count(*) FILTER (html IS NULL) AS refused, count(*) FILTER (html = '') AS unknown FROM pages GROUP BY 1")
def e12_requests_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by host: sent, refused and of unknown outcome."""
    from gleanery.functions import text as T

    return read(spark, sf_dir, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("html").isNull()).alias("refused"), F.count_if(F.col("html") == "").alias("unknown"))


@query(
    "e10_token_cost",
    """WITH e AS (SELECT event_type, event_id % 5 AS shape, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, user_id % 10 AS c, event_id % 7 AS w FROM events),
t AS (SELECT event_type, CASE WHEN shape = 2 THEN k + c + w ELSE k END AS i, CASE shape WHEN 0 THEN c WHEN 2 THEN c WHEN 4 THEN 0 ELSE least(k, c) END AS ca, CASE WHEN shape = 2 THEN w ELSE 0 END AS wr, CASE WHEN shape = 0 THEN w + c ELSE w END AS o FROM e)
SELECT event_type, round(sum((i - ca - wr) * 3.0 + ca * 0.3 + wr * 3.75 + o * 15.0) / 1000000, 9) AS cost, sum(i) AS input, sum(o) AS output FROM t GROUP BY event_type""",
)
def e10_token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of calls whose usage objects come in five shapes, by a price struct."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).cast("string")
    c, w = (F.col("user_id") % 10).cast("string"), (F.col("event_id") % 7).cast("string")
    shapes = (
        F.format_string('{"promptTokenCount":%s,"cachedContentTokenCount":%s,"candidatesTokenCount":%s,"thoughtsTokenCount":%s}', k, c, w, c),
        F.format_string('{"prompt_tokens":%s,"completion_tokens":%s,"prompt_cache_hit_tokens":%s}', k, w, c),
        F.format_string('{"input_tokens":%s,"cache_read_input_tokens":%s,"cache_creation_input_tokens":%s,"output_tokens":%s}', k, c, w, w),
        F.format_string('{"input_tokens":%s,"output_tokens":%s,"input_tokens_details":{"cached_tokens":%s}}', k, w, c),
        F.format_string('{"prompt_tokens":%s,"completion_tokens":%s}', k, w),
    )
    usage = F.element_at(F.array(*shapes), (F.col("event_id") % 5 + 1).cast("int"))
    price = F.struct(F.lit(3.0).alias("input"), F.lit(0.3).alias("cached"), F.lit(3.75).alias("written"), F.lit(15.0).alias("output"))
    t = read(spark, sf_dir, "events").select("event_type", D.usage_tokens(usage).alias("t"))
    return t.groupBy("event_type").agg(F.round(F.sum(D.token_cost(F.col("t"), price)), 9).alias("cost"), F.sum("t.input").alias("input"), F.sum("t.output").alias("output"))

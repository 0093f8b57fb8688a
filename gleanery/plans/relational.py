"""Joins, aggregations, windows and set operations over the order tables (inventory groups D, E, F, H, I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.operators import graph
from gleanery.registry import query
from gleanery.sources.tables import read



def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read(spark, sf_dir, n) for n in names]


@query("d1_inner_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000")
def d1_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = _t(spark, sf_dir, "orders", "customer", "nation")
    return o.filter("o_totalprice > 200000").join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query(
    "d2_left_join_child_facts",
    "SELECT c_custkey, coalesce(n, 0) AS n_orders, round(coalesce(total, 0.0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY ALL) ON o_custkey = c_custkey",
)
def d2_left_join_child_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders", "customer")
    facts = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return c.join(facts, c["c_custkey"] == facts["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("d3_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def d3_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders", "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("d4_semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def d4_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = _t(spark, sf_dir, "orders", "lineitem")
    return o.join(l.filter("l_returnflag = 'R'"), o["o_orderkey"] == l["l_orderkey"], "left_semi").select("o_orderkey")


@query(
    "d5_scalar_subqueries",
    """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order,
 (SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders WHERE o_custkey = c_custkey) AS states FROM customer""",
)
def d5_scalar_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated counts, maxima and lists, decorrelated to one grouped pass and one join."""
    o, c = _t(spark, sf_dir, "orders", "customer")
    facts = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_order"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("states"))
    return c.join(facts, c["c_custkey"] == facts["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "last_order", "states")


@query(
    "d7_identifier_join",
    "SELECT DISTINCT least(a.l_orderkey, b.l_orderkey) AS a, greatest(a.l_orderkey, b.l_orderkey) AS b FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey WHERE a.l_quantity = b.l_quantity",
)
def d7_identifier_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share an identifier of two parts, by an equi-join on the identifier."""
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    a, b = l.withColumnRenamed("l_orderkey", "a"), l.withColumnRenamed("l_orderkey", "b")
    return a.join(b, ["l_partkey", "l_suppkey", "l_quantity"]).filter("a < b").select("a", "b").distinct()


@query("d8_theta_join", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey AND a.n_name < b.n_name")
def d8_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    cond = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey")) & (F.col("a.n_name") < F.col("b.n_name"))
    return a.join(b, cond).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query(
    "d10_asof_protocol",
    """WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)), e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = (SELECT max(event_type) FROM events))
SELECT e.event_id, (SELECT max(p.event_id) FROM p WHERE p.user_id = e.user_id AND p.ts = (SELECT max(q.ts) FROM p q WHERE q.user_id = e.user_id AND q.ts <= e.ts)) AS in_force FROM e""",
)
def d10_asof_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join in one pass: both sides in one sorted stream per user, the last protocol carried forward."""
    e = read(spark, sf_dir, "events")
    kinds = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    rows = e.filter(F.col("event_type").isin(kinds["a"], kinds["b"])).select("user_id", "ts", "event_id", "event_type")
    over = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_type") == kinds["a"], F.struct("ts", "event_id"))).over(over)
    return rows.withColumn("in_force", last["event_id"]).filter(F.col("event_type") == kinds["b"]).select("event_id", "in_force")


@query(
    "d11_lag_before",
    "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_id FROM events",
)
def d11_lag_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before_id"))


@query(
    "d16_reverse_edges",
    "SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS n, CASE WHEN count(DISTINCT l_orderkey) > 1 THEN NULL ELSE min(l_orderkey) END AS only_one FROM lineitem GROUP BY l_partkey",
)
def d16_reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse edge lookup; several sources stay ambiguous."""
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count_distinct("l_orderkey").alias("n"), F.min("l_orderkey").alias("least"))
    return g.select("part", "n", F.when(F.col("n") == 1, F.col("least")).alias("only_one"))


@query(
    "d17_coverage_grid",
    """SELECT r_regionkey, b.brand, coalesce(n, 0) AS n FROM region CROSS JOIN (SELECT DISTINCT p_brand AS brand FROM part) b LEFT JOIN
 (SELECT p_size % 5 AS k, p_brand, count(*) AS n FROM part GROUP BY ALL) g ON g.k = r_regionkey AND g.p_brand = b.brand""",
)
def d17_coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of region by brand, filled from the left; both axes are small dimension tables."""
    r, p = _t(spark, sf_dir, "region", "part")
    grid = r.select("r_regionkey").crossJoin(F.broadcast(p.select(F.col("p_brand").alias("brand")).distinct()))
    n = p.groupBy((F.col("p_size") % 5).alias("r_regionkey"), F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["r_regionkey", "brand"], "left").select("r_regionkey", "brand", F.coalesce("n", F.lit(0)).alias("n"))


@query("d20_json_unnest", "SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def d20_json_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = F.explode(F.from_json("props", "map<string,string>")).alias("k", "v")
    return read(spark, sf_dir, "events").select("event_id", kv)


SOURCES = "s AS (SELECT l_orderkey AS work, l_suppkey % 10 AS provider FROM lineitem)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work, provider): which provider found which work."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("work"), (F.col("l_suppkey") % 10).alias("provider"))


@query(
    "e2_source_exclusive_counts",
    f"""WITH {SOURCES}, w AS (SELECT work, count(DISTINCT provider) AS k FROM s GROUP BY work)
SELECT provider, count(DISTINCT s.work) AS works, count(DISTINCT CASE WHEN k = 1 THEN s.work END) AS only_here FROM s JOIN w USING (work) GROUP BY provider""",
)
def e2_source_exclusive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works per provider, and works that no other provider found, in one pass over sets."""
    sets = hits(spark, sf_dir).groupBy("work").agg(F.collect_set("provider").alias("p"))
    return sets.select(F.explode("p").alias("provider"), (F.size("p") == 1).alias("alone")).groupBy("provider").agg(F.count(F.lit(1)).alias("works"), F.count_if("alone").alias("only_here"))


@query(
    "e3_arm_counts",
    f"""WITH {SOURCES}, w AS (SELECT work, list_sort(list(DISTINCT provider)) AS p FROM s GROUP BY work)
SELECT arm, count(*) AS works, count(*) FILTER (work % 7 = 0) AS included, count(*) FILTER (len(p) = 1) AS exclusive FROM (SELECT work, p, unnest(p) AS arm FROM w) GROUP BY arm""",
)
def e3_arm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = hits(spark, sf_dir).groupBy("work").agg(F.collect_set("provider").alias("p"))
    arms = sets.select("work", F.size("p").alias("k"), F.explode("p").alias("arm"))
    return arms.groupBy("arm").agg(F.count(F.lit(1)).alias("works"), F.count_if(F.col("work") % 7 == 0).alias("included"), F.count_if(F.col("k") == 1).alias("exclusive"))


@query("e4_new_per_step", f"WITH {SOURCES}, f AS (SELECT work, min(provider) AS first_step FROM s GROUP BY work) SELECT first_step, count(*) AS new_works FROM f GROUP BY first_step")
def e4_new_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that each step of the run order was the first to bring."""
    return hits(spark, sf_dir).groupBy("work").agg(F.min("provider").alias("first_step")).groupBy("first_step").agg(F.count(F.lit(1)).alias("new_works"))


@query("e5_distinct_remapped", "SELECT o_custkey, count(DISTINCT CASE WHEN o_orderpriority LIKE '1-%' THEN '2-HIGH' ELSE o_orderpriority END) AS kinds FROM orders GROUP BY o_custkey")
def e5_distinct_remapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority").startswith("1-"), "2-HIGH").otherwise(F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct(kind).alias("kinds"))


def bucket(status: str = "o_orderstatus", price: str = "o_totalprice") -> Column:
    """The one bucket of a work."""
    return F.when(F.col(status) == "F", F.when(F.col(price) > 150000, "included").otherwise("excluded")).when(F.col(status) == "P", "pending").otherwise("not_screened")


BUCKET_SQL = "CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 150000 THEN 'included' ELSE 'excluded' END WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'not_screened' END"


@query("e6_work_buckets", f"SELECT b AS bucket, count(*) AS n FROM (SELECT {BUCKET_SQL} AS b FROM orders) GROUP BY ROLLUP (b)")
def e6_work_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every work in one bucket, with the total that they add up to (bucket is null)."""
    return read(spark, sf_dir, "orders").select(bucket().alias("bucket")).rollup("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e7_flow_boxes",
    f"""SELECT box, n FROM (SELECT count(*) AS identified, count(*) FILTER (b <> 'not_screened') AS screened, count(*) FILTER (b = 'excluded') AS excluded,
 count(*) FILTER (b = 'included') AS included, count(DISTINCT o_custkey) FILTER (b = 'included') AS reports FROM (SELECT *, {BUCKET_SQL} AS b FROM orders))
 UNPIVOT (n FOR box IN (identified, screened, excluded, included, reports))""",
)
def e7_flow_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("b", bucket())
    included = F.col("b") == "included"
    row = o.agg(F.count(F.lit(1)).alias("identified"), F.count_if(F.col("b") != "not_screened").alias("screened"), F.count_if(F.col("b") == "excluded").alias("excluded"), F.count_if(included).alias("included"), F.count_distinct(F.when(included, F.col("o_custkey"))).alias("reports"))
    return row.unpivot([], row.columns, "box", "n")


@query("e8_only_in_followup", f"WITH {SOURCES} SELECT DISTINCT work FROM s WHERE provider = 3 EXCEPT SELECT work FROM s WHERE provider <> 3")
def e8_only_in_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).groupBy("work").agg(F.bool_and(F.col("provider") == 3).alias("only")).filter("only").select("work")


SPEND = "SELECT l_shipdate AS day, CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice END AS cost, l_returnflag = 'R' AS flagged FROM lineitem"


def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, cost, flagged): a ledger in which some costs are unknown."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("day"), F.when(F.col("l_discount") != 0, F.col("l_extendedprice")).alias("cost"), (F.col("l_returnflag") == "R").alias("flagged"))


def _totals() -> list[Column]:
    return [F.round(F.sum("cost"), 2).alias("total"), F.count("cost").alias("priced"), F.count_if(F.col("cost").isNull()).alias("unpriced"), F.count_if("flagged").alias("flagged"), F.max("cost").alias("largest")]


TOTALS = "round(sum(cost), 2) AS total, count(cost) AS priced, count(*) FILTER (cost IS NULL) AS unpriced, count(*) FILTER (flagged) AS flagged, max(cost) AS largest"


@query("e9_spend_by_day", f"SELECT strftime(day, '%Y-%m-%d') AS day, {TOTALS} FROM ({SPEND}) GROUP BY ALL")
def e9_spend_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(*_totals())


@query("e9_spend_by_month", f"SELECT strftime(day, '%Y-%m') AS month, {TOTALS} FROM ({SPEND}) GROUP BY ALL")
def e9_spend_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spend(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(*_totals())


@query("e11_calls_per_type_share", "SELECT event_type, count(*) AS calls, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type")
def e11_calls_per_type_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"))
    total = F.sum("calls").over(Window.partitionBy(F.lit(0)))  # a row a type
    return g.select("event_type", "calls", F.round(F.col("calls") / total, 6).alias("share"))


@query("e13_status_histogram", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def e13_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("e14_ordered_text", "SELECT conv_id, string_agg(role || ': ' || text, ' / ' ORDER BY turn) AS talk FROM conversations GROUP BY conv_id")
def e14_ordered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t"))
    g = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return g.select("conv_id", F.array_join(F.transform("parts", lambda p: p["t"]), " / ").alias("talk"))


@query("e15_reference_union", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS refs FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def e15_reference_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = _t(spark, sf_dir, "orders", "lineitem")
    g = o.join(l, o["o_orderkey"] == l["l_orderkey"]).groupBy("o_custkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("refs"))
    return g.select("o_custkey", F.array_join(F.col("refs").cast("array<string>"), ",").alias("refs"))


@query(
    "e17_library_rollup",
    """SELECT c_custkey, count(*) AS versions, count(DISTINCT o_orderstatus) AS states, arg_max(o_orderkey, o_totalprice) AS representative, strftime(max(o_orderdate), '%Y-%m-%d') AS newest
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def e17_library_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders", "customer")
    g = c.join(o, c["c_custkey"] == o["o_custkey"]).groupBy("c_custkey")
    # The dearest order, of equal prices the first; an order without a key or price represents nothing.
    priced = F.when(F.col("o_orderkey").isNotNull() & F.col("o_totalprice").isNotNull(), F.struct("o_totalprice", -F.col("o_orderkey")))
    return g.agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("o_orderstatus").alias("states"), F.max_by("o_orderkey", priced).alias("representative"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("newest"))


@query(
    "e22_corpus_absence",
    "SELECT p_brand, count(*) AS cells FROM part GROUP BY p_brand HAVING count(*) >= 3 AND bool_and(p_size > 1)",
)
def e22_corpus_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("cells"), F.bool_and(F.col("p_size") > 1).alias("none"))
    return g.filter("cells >= 3 and none").select("p_brand", "cells")


@query("e23_field_shares", "SELECT source, lang, n, round(n / sum(n) OVER (PARTITION BY source), 6) AS share, n / sum(n) OVER (PARTITION BY source) >= 0.25 AS routed FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)")
def e23_field_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("source"))
    return g.select("source", "lang", "n", F.round(share, 6).alias("share"), (share >= 0.25).alias("routed"))


@query("e24_latency_summary", "SELECT event_type, round(median(value), 6) AS med, max(value) AS worst, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def e24_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy("event_type")
    return g.agg(F.round(F.percentile("value", 0.5), 6).alias("med"), F.max("value").alias("worst"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.count(F.lit(1)).alias("n"))


@query(
    "e25_state_priority",
    "SELECT o_custkey, arg_max(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) AS state FROM orders GROUP BY o_custkey",
)
def e25_state_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct(rank.alias("r"), "o_orderstatus"))["o_orderstatus"].alias("state"))


@query(
    "e28_section_budgets",
    """WITH w AS (SELECT n_nationkey AS s, 1 + n_regionkey AS w FROM nation), x AS (SELECT s, 10000.0 * w / sum(w) OVER () AS q FROM w),
y AS (SELECT s, CAST(floor(q) AS BIGINT) AS f, row_number() OVER (ORDER BY round(q - floor(q), 9) DESC, s) AS k FROM x)
SELECT s, f + CASE WHEN k <= 10000 - sum(f) OVER () THEN 1 ELSE 0 END AS words FROM y""",
)
def e28_section_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest-remainder apportionment of 10,000 words over weighted sections; a row a section."""
    everything = Window.partitionBy(F.lit(0))
    q = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s"), (F.lit(10000.0) * (1 + F.col("n_regionkey")) / F.sum(1 + F.col("n_regionkey")).over(everything)).alias("q"))
    y = q.select("s", F.floor("q").alias("f"), F.row_number().over(everything.orderBy(F.desc(F.round(F.col("q") - F.floor("q"), 9)), "s")).alias("k"))
    return y.select("s", (F.col("f") + F.when(F.col("k") <= 10000 - F.sum("f").over(everything), 1).otherwise(0)).alias("words"))


@query("f3_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def f3_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of a key, by an aggregate that combines on the map side."""
    g = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return g.select("user_id", "m.event_id", "m.event_type")


@query("f4_work_heads", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def f4_work_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct((F.col("o_orderstatus") != "F").alias("late"), "o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(key)["o_orderkey"].alias("o_orderkey"))


@query("f6_collision_suffix", "SELECT o_orderkey, stem || CASE WHEN k = 1 THEN '' WHEN k <= 26 THEN chr(CAST(96 + k AS INT)) ELSE chr(CAST(97 + (k - 27) // 26 % 26 AS INT)) || chr(CAST(97 + (k - 27) % 26 AS INT)) END || CASE WHEN k > 702 THEN CAST((k - 27) // 676 AS VARCHAR) ELSE '' END AS label FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS stem, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS k FROM orders)")
def f6_collision_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that collide get b to z, then aa to zz in order of creation; beyond that a number follows."""
    k = F.row_number().over(Window.partitionBy(F.to_date("o_orderdate")).orderBy("o_orderkey"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("stem"), k.alias("k"))
    letter = lambda n: F.chr((F.lit(97) + F.pmod(n, F.lit(26))).cast("long"))
    at = F.col("k") - 27
    suffix = F.when(F.col("k") == 1, "").when(F.col("k") <= 26, letter(F.col("k") - 1)).otherwise(F.concat(letter(F.floor(at / 26)), letter(at)))
    return rows.select("o_orderkey", F.concat("stem", suffix, F.when(F.col("k") > 702, F.floor(at / 676).cast("string")).otherwise("")).alias("label"))


@query("f12_offset_of_pages", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem")
def f12_offset_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.sum("l_quantity").over(over), F.lit(0)).alias("before"))


@query("h1_union_hits", "SELECT l_orderkey AS rec FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def h1_union_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = _t(spark, sf_dir, "lineitem", "orders")
    return l.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("rec")).union(o.filter("o_orderstatus = 'P'").select("o_orderkey")).distinct()


@query("h2_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def h2_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.select(F.col("c_custkey").alias("k")).subtract(o.filter("o_totalprice > 300000").select("o_custkey"))


@query("h3_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def h3_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    return l.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).intersect(l.filter("l_returnflag = 'N'").select("l_partkey"))


@query(
    "h6_snapshot_diff",
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 3 <> 0)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'same' END AS kind FROM a FULL JOIN b ON a.k = b.k) GROUP BY kind""",
)
def h6_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    a, b = o.filter("k % 5 <> 0"), o.filter("k % 3 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    a, b = a.select("k", F.col("v").alias("x"), F.lit(True).alias("old")), b.select("k", F.col("v").alias("y"), F.lit(True).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "changed").otherwise("same")
    return a.join(b, "k", "full").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


EDGES = "e AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query("i1_citation_edges", f"WITH {EDGES} SELECT src, dst FROM e JOIN part ON p_partkey = dst WHERE p_size <= 25 AND src <> dst")
def i1_citation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = read(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("dst"))
    return edges(spark, sf_dir).join(inside, "dst", "left_semi").filter("src <> dst").select("src", "dst")


@query("i2_outside_parts", f"WITH {EDGES} SELECT dst, count(*) AS cited_by FROM e WHERE dst NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25) GROUP BY dst HAVING count(*) >= 2 ORDER BY cited_by DESC, dst LIMIT 40")
def i2_outside_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("node"))
    return graph.outside(edges(spark, sf_dir), held, 2, 40)


@query(
    "i5_frontier_3",
    """WITH RECURSIVE g AS (SELECT DISTINCT l_orderkey AS src, l_orderkey + l_linenumber * 97 AS dst FROM lineitem),
r AS (SELECT 1 AS node, 0 AS round UNION SELECT dst, round + 1 FROM r JOIN g ON src = node WHERE round < 3) SELECT CAST(node AS BIGINT) AS node, min(round) AS round FROM r GROUP BY node""",
)
def i5_frontier_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    g = l.select(F.col("l_orderkey").alias("src"), (F.col("l_orderkey") + F.col("l_linenumber") * 97).alias("dst")).distinct()
    return graph.frontier(g, spark.createDataFrame([(1,)], "node long"), 3)


@query("i6_components")
def i6_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a graph over all orders; tested against plain union-find, as recursion in SQL is too slow."""
    o = read(spark, sf_dir, "orders")
    g = o.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + F.col("o_custkey") % 5 * 3).alias("dst")).distinct()
    return graph.components(g)


@query("i7_in_corpus_citations", f"WITH {EDGES} SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE coalesce(n, 0) END AS cited FROM part LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) ON dst = p_partkey")
def i7_in_corpus_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations inside the corpus; unknown, not zero, where the list was never resolved."""
    n = edges(spark, sf_dir).groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    p = read(spark, sf_dir, "part")
    return p.join(n, p["p_partkey"] == n["dst"], "left").select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.coalesce("n", F.lit(0))).alias("cited"))

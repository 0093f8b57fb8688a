"""Keys, vocabularies, conditions, mentions and incremental rows over the test tables (inventory groups B, C, D, E, G, J, L, M, N, P, Q, R)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.registry import query
from gleanery.sources.tables import POOL_SQL, pool, read, tokens_sql


def key_stem(name: Column, year: Column, title: Column) -> Column:
    """Author, year and first long title word of a citation key: "lovelace2021diffusion"; without an author the title word leads."""
    word = F.coalesce(F.element_at(F.filter(F.split(T.normalize(title), " "), lambda w: F.length(w) > 3), 1), F.lit(""))
    when = F.coalesce(F.lpad(year.cast("string"), 4, "0"), F.lit("nd"))
    author = T.surname(name)
    return F.when(author.isNotNull(), F.concat(author, when, word)).otherwise(F.concat(F.when(word == "", "source").otherwise(word), when))


@query(
    "b8_key_stems",
    r"""WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 6 = 0 THEN 'Anonymous' ELSE 'Ada Nation' || c_nationkey END AS name, CASE WHEN c_custkey % 5 <> 0 THEN 1990 + c_custkey % 30 END AS y FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'diffusion' || coalesce(CAST(y AS VARCHAR), 'nd') ELSE 'nation' || c_nationkey || coalesce(CAST(y AS VARCHAR), 'nd') || 'diffusion' END AS stem FROM c""",
)
def b8_key_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 6 == 0, "Anonymous").otherwise(F.concat(F.lit("Ada Nation"), F.col("c_nationkey").cast("string")))
    year = F.when(F.col("c_custkey") % 5 != 0, 1990 + F.col("c_custkey") % 30)
    return read(spark, sf_dir, "customer").select("c_custkey", key_stem(name, year, F.lit("The Diffusion of it all")).alias("stem"))


def number_text(value: Column, language: str, digits: int = 2) -> Column:
    """A number as a language writes it: 1,234.50 in English, 1.234,50 in Turkish and German."""
    plain = F.format_number(value, digits)
    return plain if language == "en" else F.translate(plain, ",.", ".,")


@query("b31_number_text", "SELECT c_custkey, format('{:,.2f}', c_acctbal) AS en, translate(format('{:,.2f}', c_acctbal), ',.', '.,') AS tr FROM customer")
def b31_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", number_text(F.col("c_acctbal"), "en").alias("en"), number_text(F.col("c_acctbal"), "tr").alias("tr"))


def admitted(df: DataFrame, forms: list[str], texts: list[str]) -> Column:
    """Whether a form stands at a word start in any of the texts."""
    held = [F.contains(T.padded(F.coalesce(F.col(t), F.lit(""))), F.lit(f" {f}")) for t in texts for f in forms]
    out = F.lit(False)
    for h in held:
        out = out | h
    return out


@query(
    "c2_chain_admission",
    f"WITH {POOL_SQL}, p AS (SELECT id, ' ' || array_to_string({tokens_sql('title')}, ' ') || ' ' AS t, ' ' || array_to_string({tokens_sql(chr(39) + chr(39) + ' || coalesce(abstract, ' + chr(39) + chr(39) + ')')}, ' ') || ' ' AS a FROM pool) SELECT id FROM p WHERE contains(t, ' the') OR contains(t, ' und') OR contains(a, ' the') OR contains(a, ' und')",
)
def c2_chain_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained works that name the setting or the task in title or abstract."""
    p = pool(spark, sf_dir)
    return p.filter(admitted(p, ["the", "und"], ["title", "abstract"])).select("id")


@query(
    "d9_mentions",
    f"""WITH q AS (SELECT item_id, {tokens_sql('text')} AS w FROM benchmark), d AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents),
qg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM q WHERE len(w) >= 5)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5))
SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN qg USING (g) GROUP BY ALL""",
)
def d9_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts beside the earlier records they share runs of five words with."""
    grams = lambda df, key: df.select(key, T.words(F.col("text")).alias("w")).select(key, F.explode(T.shingles(F.col("w"), 5)).alias("g"))
    d, q = grams(read(spark, sf_dir, "documents"), "doc_id"), grams(read(spark, sf_dir, "benchmark"), "item_id")
    return d.join(q, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


@query("e16_most_cited_version", "SELECT o_custkey, max(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 100 END) AS cited FROM orders GROUP BY o_custkey")
def e16_most_cited_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest known count of a work's versions; null where none is known."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 100)).alias("cited"))


@query("g2_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def g2_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_totalprice")


@query(
    "j16_query_vocabulary",
    f"SELECT item_id, array_to_string(list_sort(list_filter(list_distinct({tokens_sql('text')}), lambda w: NOT list_contains(['the', 'of', 'and', 'to', 'in', 'is', 'that', 'for', 'with', 'was'], w) AND length(w) > 2)), ' ') AS vocabulary FROM benchmark",
)
def j16_query_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content words of a question: distinct, no function words, three letters or more."""
    w = F.filter(F.array_distinct(T.words(F.col("text"))), lambda x: ~x.isin(*T.FUNCTION_WORDS["en"]) & (F.length(x) > 2))
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(w), " ").alias("vocabulary"))


def year_condition(text: Column, this_year: int) -> tuple[Column, Column]:
    """From and to years that a question asks for: "2015-2020", "between 2015 and 2020", "since 2015", "before 2015", "last 5 years"."""
    t = F.lower(text)
    get = lambda pattern, k: F.regexp_extract(t, pattern, k).try_cast("int")
    span = r"\b(1[5-9]\d\d|20\d\d)\s*(?:-|to|and)\s*(1[5-9]\d\d|20\d\d)\b"
    last = get(r"\b(?:last|past) (\d{1,2}) years?\b", 1)
    a = F.coalesce(get(span, 1), get(r"\b(?:since|from|after) (1[5-9]\d\d|20\d\d)\b", 1), this_year - last)
    b = F.coalesce(get(span, 2), get(r"\b(?:until|before|up to) (1[5-9]\d\d|20\d\d)\b", 1), F.when(last.isNotNull(), F.lit(this_year)))
    return a, b


@query(
    "l9_year_conditions",
    r"""WITH q AS (SELECT conv_id, turn, lower(text || [' since 2015', ' between 2010 and 2019', ' in the last 5 years', ' before 1999', ''][CAST((conv_id + turn) % 5 + 1 AS INT)]) AS t FROM conversations),
x AS (SELECT conv_id, turn, TRY_CAST(regexp_extract(t, '\b(1[5-9]\d\d|20\d\d)\s*(?:-|to|and)\s*(1[5-9]\d\d|20\d\d)\b', 1) AS INT) AS a1, TRY_CAST(regexp_extract(t, '\b(1[5-9]\d\d|20\d\d)\s*(?:-|to|and)\s*(1[5-9]\d\d|20\d\d)\b', 2) AS INT) AS b1,
 TRY_CAST(regexp_extract(t, '\b(?:since|from|after) (1[5-9]\d\d|20\d\d)\b', 1) AS INT) AS a2, TRY_CAST(regexp_extract(t, '\b(?:until|before|up to) (1[5-9]\d\d|20\d\d)\b', 1) AS INT) AS b2, TRY_CAST(regexp_extract(t, '\b(?:last|past) (\d{1,2}) years?\b', 1) AS INT) AS n FROM q)
SELECT conv_id, turn, coalesce(a1, a2, 2024 - n) AS from_year, coalesce(b1, b2, CASE WHEN n IS NOT NULL THEN 2024 END) AS to_year FROM x""",
)
def l9_year_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, (" since 2015", " between 2010 and 2019", " in the last 5 years", " before 1999", ""))), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    a, b = year_condition(F.concat("text", tail), 2024)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", a.alias("from_year"), b.alias("to_year"))


@query("m11_evidence_fingerprints", "SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS fingerprint FROM lineitem GROUP BY l_orderkey")
def m11_evidence_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of what each answer rests on, in a fixed order: it changes when its evidence does."""
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    text = F.transform(F.array_sort(F.collect_list(one)), lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["l_partkey"].cast("string"), s["l_suppkey"].cast("string")))
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(text, ","), 256).alias("fingerprint"))


@query(
    "n13_queue_classes",
    "SELECT CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority = '1-URGENT' THEN 'disputed' WHEN o_orderstatus = 'P' THEN 'unread' ELSE 'unclear' END AS reason, count(*) AS n, min(o_orderdate) AS oldest FROM orders GROUP BY 1",
)
def n13_queue_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why works wait in the queue, how many, and since when."""
    reason = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderpriority") == "1-URGENT", "disputed").when(F.col("o_orderstatus") == "P", "unread").otherwise("unclear")
    return read(spark, sf_dir, "orders").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("oldest"))


_HUMAN = "event_id % 10 = 0"


@query(
    "n12_overrides_as_of",
    f"""WITH x AS (SELECT user_id, event_id, {_HUMAN} AS human, event_type, last_value(CASE WHEN NOT ({_HUMAN}) THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS machine FROM events)
SELECT event_id, CASE WHEN machine IS NULL THEN 'first' WHEN machine = event_type THEN 'confirmed' ELSE 'overrode' END AS class FROM x WHERE human""",
)
def n12_overrides_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's decisions beside the machine's view as of then."""
    e = read(spark, sf_dir, "events").withColumn("human", F.expr(_HUMAN))
    over = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    machine = F.last(F.when(~F.col("human"), F.col("event_type")), ignorenulls=True).over(over)
    kind = F.when(F.col("machine").isNull(), "first").when(F.col("machine") == F.col("event_type"), "confirmed").otherwise("overrode")
    return e.withColumn("machine", machine).filter("human").select("event_id", kind.alias("class"))


def retry_at(value: Column, observed: Column) -> Column:
    """When to try again, in Unix seconds: after so many seconds, or at an HTTP date; null for anything else."""
    v = F.trim(value)
    date = F.try_to_timestamp(F.regexp_extract(v, r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(v.rlike(r"^\d{1,9}$"), observed + v.cast("long")).otherwise(F.unix_seconds(date))


@query(
    "p6_retry_times",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1000000 + event_id % 500 WHEN 1 THEN CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) + event_id % 28 * 86400 + 3600 END AS retry FROM events",
)
def p6_retry_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    date = F.concat(F.lit("Mon, "), F.lpad((e % 28 + 1).cast("string"), 2, "0"), F.lit(" Jan 2024 01:00:00 GMT"))
    value = F.when(e % 3 == 0, (e % 500).cast("string")).when(e % 3 == 1, date).otherwise("soon")
    return read(spark, sf_dir, "events").select("event_id", retry_at(value, F.lit(1_000_000)).alias("retry"))


@query("q4_sanitized_props", "SELECT event_id, '[\"a\",\"k\"]' AS keys FROM events")
def q4_sanitized_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of an object without its secrets, as a sorted list."""
    held = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("api_key"), F.lit("x"), F.lit("a"), F.lit("1")))
    kept = F.map_filter(held, lambda k, _: ~k.rlike("(?i)key|token|secret|password") | (k == "k"))
    return read(spark, sf_dir, "events").select("event_id", F.to_json(F.array_sort(F.map_keys(kept))).alias("keys"))


@query("r2_incremental_rows", "WITH b AS (SELECT user_id, max(ts) AS cut FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT e.event_id FROM events e LEFT JOIN b USING (user_id) WHERE cut IS NULL OR ts > cut")
def r2_incremental_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond each unit's stored cursor; a unit without one is new as a whole."""
    e = read(spark, sf_dir, "events")
    cut = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("cut"))
    return e.join(cut, "user_id", "left").filter(F.col("cut").isNull() | (F.col("ts") > F.col("cut"))).select("event_id")


@query("r10_idempotent_steps", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def r10_idempotent_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that are still to run: a key that succeeded never runs again."""
    done = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")

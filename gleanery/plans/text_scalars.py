"""String functions over documents, pages, conversations and names (inventory group B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.registry import query
from gleanery.sources.tables import POOL_SQL, pool, read, tokens_sql

#: Normalisation in oracle SQL.
NORM = (
    "array_to_string(regexp_extract_all(replace(strip_accents(lower(regexp_replace(regexp_replace(coalesce({0}, ''), '<[^>]*>', ' ', 'g'), '\\$[^$]*\\$', ' ', 'g'))),"
    " 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'), ' ')"
)


def norm_sql(expression: str) -> str:
    return NORM.replace("{0}", expression).replace("{{", "{").replace("}}", "}")


def grams_sql(expression: str) -> str:
    """Distinct trigrams of a normalised expression."""
    return f"list_distinct(list_transform(range(1, length({expression}) - 1), lambda i: substr({expression}, CAST(i AS INT), 3)))"


@query(
    "b1_words",
    f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w[1:20], '|') AS first_words FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)",
)
def b1_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.words(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.array_join(F.slice(w, 1, 20), "|").alias("first_words"))


@query("b2_normalize_text", f"WITH {POOL_SQL} SELECT id, {norm_sql('title')} AS normal FROM pool")
def b2_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).select("id", T.normalize(F.col("title")).alias("normal"))


@query(
    "b3_trigrams",
    f"WITH {POOL_SQL}, n AS (SELECT id, {norm_sql('title')} AS t FROM pool) SELECT id, CAST(len({grams_sql('t')}) AS BIGINT) AS n_grams, array_to_string(list_sort({grams_sql('t')}), '|') AS grams FROM n",
)
def b3_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.trigrams(F.col("normal"))
    return pool(spark, sf_dir).select("id", T.normalize(F.col("title")).alias("normal")).select("id", F.size(g).cast("long").alias("n_grams"), F.array_join(F.array_sort(g), "|").alias("grams"))


@query(
    "b4_similarity",
    f"""WITH {POOL_SQL}, n AS (SELECT id, {norm_sql('title')} AS a, {norm_sql('abstract')} AS b FROM pool),
g AS (SELECT id, a, b, {grams_sql('a')} AS x, {grams_sql('b')} AS y FROM n)
SELECT id, CASE WHEN a = '' OR b = '' THEN NULL WHEN len(x) = 0 OR len(y) = 0 THEN 0.0
  ELSE round(len(list_intersect(x, y)) / CAST(len(x) + len(y) - len(list_intersect(x, y)) AS DOUBLE), 6) END AS similarity FROM g""",
)
def b4_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.similarity(pool(spark, sf_dir), "title", "abstract").select("id", F.round("similarity", 6).alias("similarity"))


@query(
    "b9_title_keys",
    f"WITH {POOL_SQL} SELECT id, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS title_key FROM pool",
)
def b9_title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).select("id", T.title_key(F.col("title")).alias("title_key"))


@query(
    "b10_normalize_doi",
    """SELECT page_id, lower(trim(regexp_replace('https://doi.org/10.5555/' || upper(url), '^(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*)', ''))) AS doi,
 lower(trim(regexp_replace('doi: 10.1000/' || page_id, '^(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*)', ''))) AS short_doi FROM pages""",
)
def b10_normalize_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(
        "page_id",
        T.doi(F.concat(F.lit("https://doi.org/10.5555/"), F.upper("url"))).alias("doi"),
        T.doi(F.concat(F.lit("doi: 10.1000/"), F.col("page_id").cast("string"))).alias("short_doi"),
    )


IDENTIFIER = r"(10\.[0-9]{4,9}/[^ \t\n\"<>]+|[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"


@query(
    "b11_identifiers_in",
    """SELECT doc_id, array_to_string(regexp_extract_all(text, '(10\\.[0-9]{4,9}/[^ \\t\\n"<>]+|[0-9]{4}\\.[0-9]{4,5}(?:v[0-9]+)?)'), '|') AS ids FROM documents
WHERE len(regexp_extract_all(text, '(10\\.[0-9]{4,9}/[^ \\t\\n"<>]+|[0-9]{4}\\.[0-9]{4,5}(?:v[0-9]+)?)')) > 0""",
)
def b11_identifiers_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(1))
    return read(spark, sf_dir, "documents").select("doc_id", ids.alias("ids")).filter(F.size("ids") > 0).withColumn("ids", F.array_join("ids", "|"))


@query("b12_short_id", "SELECT page_id, string_split(rtrim(url, '/'), '/')[-1] AS short_id FROM pages")
def b12_short_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.short_id(F.col("url")).alias("short_id"))


@query(
    "b13_singular",
    f"""WITH w AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS word FROM documents)
SELECT word, CASE WHEN length(word) <= 3 THEN word WHEN word LIKE '%ies' AND length(word) > 4 THEN substr(word, 1, length(word) - 3) || 'y'
 WHEN regexp_matches(word, '(?:s|x|z|ch|sh)es$') THEN substr(word, 1, length(word) - 2)
 WHEN word LIKE '%s' AND NOT regexp_matches(word, '(?:ss|us|is)$') AND length(word) > 3 THEN substr(word, 1, length(word) - 1) ELSE word END AS singular FROM w""",
)
def b13_singular(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return found.withColumn("singular", T.singular(F.col("word")))


@query(
    "b15_strip_markup",
    """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS plain FROM pages""",
)
def b15_strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.strip_markup(F.col("html")).alias("plain"))


@query("b17_reconstruct_abstract", f"WITH {POOL_SQL} SELECT id, abstract AS rebuilt FROM pool WHERE abstract IS NOT NULL AND abstract <> ''")
def b17_reconstruct_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverted index (word to positions) is built inside each record's row and turned back into its text."""
    kept = pool(spark, sf_dir).filter("abstract is not null and abstract <> ''")
    index = kept.select("id", T.inverted_index("abstract").alias("index"))
    return index.select("id", T.from_inverted_index(F.col("index")).alias("rebuilt"))


@query(
    "b18_bounded_head",
    """SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE regexp_replace(substr(text, 1, 301), '[^ ]*$', '') END AS head,
 CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS utf16 FROM documents""",
)
def b18_bounded_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.head(F.col("text"), 300).alias("head"), T.utf16_units(F.col("text")).alias("utf16"))


@query(
    "b19_page_text",
    "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')) AS page_text FROM documents",
)
def b19_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r" ?\n ?", "\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.trim(t).alias("page_text"))


@query(
    "b20_join_line_ends",
    """SELECT doc_id, regexp_replace(replace(text, 'th ', 'th-' || chr(10)), '(\\p{Ll})-\\n(\\p{Ll})', '\\1\\2', 'g') AS joined FROM documents""",
)
def b20_join_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.replace(F.col("text"), F.lit("th "), F.lit("th-\n"))
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(broken, r"(\p{Ll})-\n(\p{Ll})", "$1$2").alias("joined"))


@query(
    "b21_phrase_norm",
    """SELECT item_id, regexp_replace(lower(regexp_replace(trim(text), '[ \\t\\n]+', ' ', 'g')), '^[.,;:!?"() ]+|[.,;:!?"() ]+$', '', 'g') AS phrase FROM benchmark""",
)
def b21_phrase_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower(F.regexp_replace(F.trim("text"), r"[ \t\n]+", " "))
    return read(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(t, r'^[.,;:!?"() ]+|[.,;:!?"() ]+$', "").alias("phrase"))


def _language_sql() -> str:
    cases = ", ".join(
        f"CAST(len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in ws)}], x))) AS BIGINT) AS n_{lang}" for lang, ws in T.FUNCTION_WORDS.items()
    )
    order = list(T.FUNCTION_WORDS)
    pick = " ".join(f"WHEN n_{x} = best AND best > 0 THEN '{x}'" for x in order)
    return f"""SELECT doc_id, lang, CASE {pick} END AS detected FROM (SELECT *, greatest({', '.join('n_' + x for x in order)}) AS best
FROM (SELECT doc_id, lang, {cases} FROM (SELECT doc_id, lang, {tokens_sql('text')} AS w FROM documents)))"""


@query("b22_detect_language", _language_sql())
def b22_detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", T.language(F.col("text")).alias("detected"))


@query(
    "b24_redact",
    """SELECT page_id, regexp_replace(regexp_replace(url || '&api_key=abc' || page_id || '&x=1', '(?i)((?:api[_-]?key|token|secret|password|ref)=)[^&#\\s]+', '\\1***', 'g'),
 '(?i)(bearer )[A-Za-z0-9._-]+', '\\1***', 'g') AS redacted FROM pages""",
)
def b24_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.lit("&api_key=abc"), F.col("page_id").cast("string"), F.lit("&x=1"))
    return read(spark, sf_dir, "pages").select("page_id", T.redact(url).alias("redacted"))


@query("b25_url_host", "SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host FROM pages")
def b25_url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"))


@query(
    "b26_provisional_title",
    r"""SELECT conv_id, turn, array_to_string(w[1:15], ' ') || CASE WHEN len(w) > 15 THEN ' …' ELSE '' END AS title
FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM conversations)""",
)
def b26_provisional_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.provisional_title(F.col("text")).alias("title"))


@query(
    "b28_typed_title",
    f"""WITH {POOL_SQL}, s AS (SELECT id, {tokens_sql('title')} AS t, {tokens_sql('abstract')} AS a FROM pool WHERE abstract IS NOT NULL),
g AS (SELECT id, CASE WHEN len(t) >= 6 THEN list_transform(range(1, len(t) - 4), lambda i: array_to_string(t[i:i+5], ' ')) ELSE [] END AS tg,
 CASE WHEN len(a) >= 6 THEN list_transform(range(1, len(a) - 4), lambda i: array_to_string(a[i:i+5], ' ')) ELSE [] END AS ag FROM s)
SELECT id, list_has_any(tg, ag) AS typed FROM g""",
)
def b28_typed_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether six words of the title in a row stand in the abstract."""
    w = pool(spark, sf_dir).filter("abstract is not null").select("id", T.words(F.col("title")).alias("t"), T.words(F.col("abstract")).alias("a"))
    six = w.select("id", T.shingles(F.col("t"), 6).alias("t"), T.shingles(F.col("a"), 6).alias("a"))
    return six.select("id", F.arrays_overlap("t", "a").alias("typed"))


@query(
    "b29_symbol_classes",
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{Sm}\\p{So}]')) AS BIGINT) AS signs, CAST(len(regexp_extract_all(text, '\\p{Lu}')) AS BIGINT) AS capitals FROM documents",
)
def b29_symbol_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", count(r"[\p{Sm}\p{So}]").alias("signs"), count(r"\p{Lu}").alias("capitals"))


@query(
    "b30_in_text_citation",
    """WITH c AS (SELECT o_orderkey, c_name, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, '(' || c_name || ', ' || y || ')' AS apa, '(' || c_name || ' ' || y || ')' AS chicago, '(' || c_name || ')' AS mla,
 '[' || CAST(o_orderkey AS VARCHAR) || ']' AS ieee FROM c""",
)
def b30_in_text_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate").cast("string")
    facts = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wrap = lambda left, *parts, right=")": F.concat(F.lit(left), *parts, F.lit(right))
    return facts.select(
        "o_orderkey",
        wrap("(", F.col("c_name"), F.lit(", "), year).alias("apa"),
        wrap("(", F.col("c_name"), F.lit(" "), year).alias("chicago"),
        wrap("(", F.col("c_name")).alias("mla"),
        wrap("[", F.col("o_orderkey").cast("string"), right="]").alias("ieee"),
    )


@query("b32_quick_search", f"WITH {POOL_SQL} SELECT id, title FROM pool WHERE instr(lower(title), 'tion') > 0 ORDER BY title, id LIMIT 50")
def b32_quick_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive substring over titles: the first 50 by title."""
    return pool(spark, sf_dir).filter(F.instr(F.lower("title"), "tion") > 0).select("id", "title").orderBy("title", "id").limit(50)


@query(
    "b7_surnames",
    f"""SELECT c_custkey, CASE WHEN s <> '' AND s NOT IN ('anonymous', 'unknown') THEN s END AS surname
FROM (SELECT c_custkey, replace({norm_sql("string_split_regex(trim(c_name), '\\s+')[-1]")}, ' ', '') AS s FROM customer)""",
)
def b7_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", T.surname(F.col("c_name")).alias("surname"))


@query(
    "m10_row_digest",
    """SELECT o_orderstatus, sha256(string_agg(d, '' ORDER BY bucket)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM
(SELECT o_orderstatus, substr(h, 1, 2) AS bucket, sha256(string_agg(h, '' ORDER BY h)) AS d, count(*) AS n
FROM (SELECT o_orderstatus, sha256(CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderpriority) AS h FROM orders) GROUP BY ALL) GROUP BY o_orderstatus""",
)
def m10_row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free digest of each status: row digests by bucket of their first byte, then of the buckets.

    A bucket holds a 256th of a status; more bytes of prefix make smaller ones.
    """
    h = F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority"), 256)
    rows = read(spark, sf_dir, "orders").select("o_orderstatus", h.alias("h")).withColumn("bucket", F.substring("h", 1, 2))
    parts = rows.groupBy("o_orderstatus", "bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("o_orderstatus").agg(F.array_sort(F.collect_list(F.struct("bucket", "d"))).alias("all"), F.sum("n").alias("n"))
    return whole.select("o_orderstatus", F.sha2(F.array_join(F.transform("all", lambda p: p["d"]), ""), 256).alias("digest"), "n")

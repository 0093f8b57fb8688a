"""Decisions about records: labels of runs, parts of a criterion, guards, flags and matching cascades, as columns or grouped passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T


def two_run_code(first: Column, first_ok: Column, second: Column, second_ok: Column) -> Column:
    """One reason from two runs' labels and whether their quotes were found; nothing here drops a record."""
    return (
        F.when(first.isNull() | second.isNull(), "abstract_not_proposed")
        .when((first == "unresolved") & (second == "unresolved"), "runs_agree_unresolved")
        .when(first != second, "runs_disagree_kept_as_candidate")
        .when(~(F.coalesce(first_ok, F.lit(False)) & F.coalesce(second_ok, F.lit(False))), "quote_not_found_kept_as_candidate")
        .when(first == "candidate", "runs_agree_candidate")
        .otherwise("runs_agree_out_of_scope")
    )


def part_verdict(label: str) -> Column:
    """An aggregate over the parts of a criterion: include, partial, not_met or unclear."""
    is_ = lambda v: F.coalesce(F.col(label) == v, F.lit(False))
    return F.when(F.bool_and(is_("present")), "include").when(F.bool_or(is_("present")), "partial").when(F.bool_or(is_("absent")), "not_met").otherwise("unclear")


def merge_parts(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, quote_verified, disputed) from two runs' rows of the same parts.

    Rows have the keys, label, verified and seen (whether the other run was shown the passage of the quote). A
    part that one run alone gives counts as unclear in the other.
    """
    side = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("label", "verified", "seen")])
    both = side(first, "a").join(side(second, "b"), list(keys), "full")
    la, lb = (F.coalesce(f"label_{s}", F.lit("unclear")) for s in "ab")
    va, vb, sa, sb = (F.coalesce(c, F.lit(False)) for c in ("verified_a", "verified_b", "seen_a", "seen_b"))
    pa, pb = la == "present", lb == "present"
    disputed = (pa & ~pb & va & sa) | (pb & ~pa & vb & sb)
    label = F.when(disputed, "disputed").when(pa | pb, "present").when((la == "absent") & (lb == "absent"), "absent").otherwise("unclear")
    verified = F.when(pa & pb, va & vb).when(disputed, False).when(pa, va).when(pb, vb).otherwise(False)
    return both.select(*keys, label.alias("label"), verified.alias("quote_verified"), disputed.alias("disputed"))


#: Parts of a claim, quotes of a part and of a claim at most.
CLAIM_PARTS, PART_QUOTES, CLAIM_QUOTES = 4, 3, 8


def claim_result(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, result): found_whole, found_partial, not_found_in_given, or could_not_check for anything that is not in order.

    ``parts``: keys, assessment (stated, partly, not_stated), quotes, located, whole (the parts cover the sentence).
    """
    positive = F.col("assessment").isin("stated", "partly")
    odd = ~F.coalesce(F.col("assessment").isin("stated", "partly", "not_stated"), F.lit(False))
    bad = odd | (positive & ((F.col("quotes") < 1) | (F.col("quotes") > PART_QUOTES) | (F.col("located") < 1))) | (~positive & (F.col("quotes") > 0)) | ~F.coalesce(F.col("whole"), F.lit(False))
    g = parts.groupBy(*keys).agg(
        F.bool_or(F.coalesce(bad, F.lit(True))).alias("bad"),
        F.count(F.lit(1)).alias("n"),
        F.sum("quotes").alias("q"),
        F.bool_and(F.col("assessment") == "stated").alias("every"),
        F.bool_and(F.col("assessment") == "not_stated").alias("none"),
    )
    beyond = (F.col("n") > CLAIM_PARTS) | (F.col("q") > CLAIM_QUOTES)
    result = F.when(F.col("bad") | beyond, "could_not_check").when(F.col("every"), "found_whole").when(F.col("none"), "not_found_in_given").otherwise("found_partial")
    return g.select(*keys, result.alias("result"))


def stale(now: Sequence[Column], then: Sequence[Column]) -> Column:
    """Whether any part of a decision's key has changed; a null equals a null."""
    out = F.lit(False)
    for a, b in zip(now, then):
        out = out | ~a.eqNullSafe(b)
    return out


def may_write(owner: Column, stored: Column, fresh: Column, is_stale: Column) -> Column:
    """The write guard: a person's decision stays; else a first, a changed or a stale one is written."""
    return ~F.coalesce(owner == "human", F.lit(False)) & (stored.isNull() | is_stale | ~stored.eqNullSafe(fresh))


def survey_flags(title: Column, abstract: Column, references: Column, words: Sequence[str], phrases: Sequence[str], many: int = 150) -> Column:
    """Why a record may be a survey: title_word, abstract_phrase, many_references (an unknown count is no flag)."""
    t, a = T.padded(title), T.padded(F.coalesce(abstract, F.lit("")))
    held = lambda c, forms: F.greatest(*[F.contains(c, F.lit(f" {w} ")).cast("int") for w in forms], F.lit(0)) == 1
    flags = F.array(F.when(held(t, words), "title_word"), F.when(held(a, phrases), "abstract_phrase"), F.when(references >= many, "many_references"))
    return F.array_compact(flags)


#: How an entry of a numbered list opens, what a year is, how the end of an entry reads, and how
#: many entries and years make a list; characters before the first entry that need no such end.
ENTRY, YEAR, ENTRY_END = r"\[\d{1,3}\]\s+(?:[A-Z]\.|[A-Z][a-z]+,)", r"\b(?:19|20)\d{2}\b", r",[^,]{0,40}(?:(?:19|20)\d{2}|\d+\s*[\x{2013}-]\s*\d+)\.?$"
LIST_ENTRIES, SHORT_LEAD = 3, 40


def reference_list(text: Column) -> Column:
    """Whether a passage belongs to a numbered reference list: enough entries and years, the first entry in the
    first third, and before it only a short lead or the end of another entry."""
    many = (F.regexp_count(text, F.lit(ENTRY)) >= LIST_ENTRIES) & (F.regexp_count(text, F.lit(YEAR)) >= LIST_ENTRIES)
    lead = F.regexp_extract(text, rf"(?s)^(.*?){ENTRY}", 1)
    bare = F.regexp_replace(lead, r"^\s+|\s+$", "")
    early = F.length(lead) * 3 <= F.length(text)
    return F.coalesce(many & early & ((F.length(bare) <= SHORT_LEAD) | bare.rlike(ENTRY_END)), F.lit(False))


#: Fixed value: authors that a work has at least where a citation shortens them to "et al.".
ET_AL_AUTHORS = 3


def authors_admitted(cited: Column, et_al: Column, surnames: Column) -> Column:
    """Whether cited surnames are a record's: all of them in order; with "et al." the first ones of a work that has
    at least one more and at least ``ET_AL_AUTHORS``. Nothing cited or no surnames: not admitted."""
    n, all_ = F.size(cited), F.size(surnames)
    opens = F.slice(surnames, F.lit(1), F.greatest(n, F.lit(1))) == cited
    return F.when((n < 1) | (all_ < 1), False).when(et_al, (all_ >= ET_AL_AUTHORS) & (all_ > n) & opens).otherwise(surnames == cited)


def usage_tokens(usage: Column) -> Column:
    """input, cached, written and output tokens of a usage object as JSON text; null where it names no input or no output.

    Each shape is known by its field names (fixed values). ``input`` is the whole prompt. A count that is no
    number of 0 or more is missing."""

    def number(*paths: str) -> Column:
        return F.coalesce(*[F.when(F.get_json_object(usage, f"$.{p}").rlike(r"^[0-9]+(?:\.[0-9]+)?$"), F.floor(F.get_json_object(usage, f"$.{p}").cast("double"))) for p in paths])

    none = F.lit(0).cast("long")
    has = lambda *paths: F.coalesce(*[F.get_json_object(usage, f"$.{p}") for p in paths]).isNotNull()
    made = lambda i, c, w, o: F.when(i.isNotNull() & o.isNotNull(), F.struct(i.alias("input"), c.alias("cached"), w.alias("written"), o.alias("output")))
    or_none = lambda c: F.coalesce(c, none)
    counted = made(number("promptTokenCount"), or_none(number("cachedContentTokenCount")), none, number("candidatesTokenCount") + or_none(number("thoughtsTokenCount")))
    read, written = or_none(number("cache_read_input_tokens")), or_none(number("cache_creation_input_tokens"))
    apart = made(number("input_tokens") + read + written, read, written, number("output_tokens"))
    prompt = number("prompt_tokens", "input_tokens")
    hit = F.coalesce(number("prompt_tokens_details.cached_tokens", "input_tokens_details.cached_tokens", "prompt_cache_hit_tokens"), none)
    plain = made(prompt, F.least(prompt, hit), none, number("completion_tokens", "output_tokens"))
    return F.when(has("promptTokenCount", "candidatesTokenCount"), counted).when(has("cache_read_input_tokens", "cache_creation_input_tokens"), apart).otherwise(plain)


def token_cost(tokens: Column, price: Column) -> Column:
    """The cost of ``usage_tokens`` at prices per million (struct input, cached, written, output): cached and
    written parts at their own price, or the input price where none is listed, and the rest of the prompt plain."""
    plain = tokens["input"] - tokens["cached"] - tokens["written"]
    own = lambda tier: F.coalesce(price[tier], price["input"])
    return (plain * price["input"] + tokens["cached"] * own("cached") + tokens["written"] * own("written") + tokens["output"] * price["output"]) / 1_000_000


def access_level(pdf_text: Column, abstract: Column) -> Column:
    return F.when(pdf_text, "full_text").when(abstract, "abstract").otherwise("metadata")


def tri_state(value: Column, yes: Sequence[str] = ("true", "1", "yes"), no: Sequence[str] = ("false", "0", "no")) -> Column:
    """true, false or null for what is neither."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*yes), True).when(v.isin(*no), False)


def year_of(value: Column) -> Column:
    """The first plausible year of a text: 1500 to 2099, standing alone."""
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"\b(1[5-9]\d\d|20\d\d)\b", 1).try_cast("int")


def version_key(text: Column) -> Column:
    """Numbers of a version, so that arrays compare as versions do: 1.10 after 1.9; null without any."""
    parts = F.transform(F.regexp_extract_all(F.regexp_replace(text, r"[-+].*$", ""), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.when(F.size(parts) > 0, parts)


def cascade(left: DataFrame, right: DataFrame, key: str, by: Sequence[str], value: str) -> DataFrame:
    """(key, value, matched_by): each left row's match by the first identifier that finds one; several matches give the smallest.

    Every identifier is one equi-join of narrow columns; nulls match nothing.
    """
    found = None
    for i, c in enumerate(by):
        r = right.select(F.col(c).alias("_id"), F.col(value).alias("_v")).filter("_id is not null").groupBy("_id").agg(F.min("_v").alias("_v"))
        hit = left.select(key, F.col(c).alias("_id")).join(r, "_id").select(key, F.struct(F.lit(i).alias("i"), F.col("_v").alias("v")).alias("m"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(key).agg(F.min("m").alias("m"))
    names = F.array(*map(F.lit, by))
    return left.select(key).join(best, key, "left").select(key, F.col("m.v").alias(value), F.element_at(names, F.col("m.i") + 1).alias("matched_by"))


def resolution(matches: DataFrame, key: str, target: str) -> DataFrame:
    """(key, target, state): none is unresolved, one is planned, several are ambiguous and keep no target. ``matches``: key, target (null if none)."""
    g = matches.groupBy(key).agg(F.count_distinct(target).alias("n"), F.min(target).alias(target))
    return g.select(key, F.when(F.col("n") == 1, F.col(target)).alias(target), F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "planned").otherwise("ambiguous").alias("state"))


def overlapping(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Spans (end exclusive) that overlap another of their key, in one sorted pass: no pair is formed.

    A span overlaps an earlier one if some earlier end lies beyond its start, and a later one if the next start lies before its end.
    """
    over = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(over.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(start).over(over)
    return spans.withColumns({"_b": before, "_a": after}).filter((F.col("_b") > F.col(start)) | (F.col("_a") < F.col(end))).drop("_a", "_b")


def containing(points: DataFrame, spans: DataFrame, key: str, point: str, start: str = "start", end: str = "end") -> DataFrame:
    """``points`` with the span of their key that holds them (start inclusive, end exclusive), null without one; spans of a key do not overlap.

    Both sides go through one sorted pass per key, the last span carried forward.
    """
    payload = F.struct(F.col(start).alias("s"), F.col(end).alias("e"))
    p = points.select(key, F.col(point).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"), F.lit(None).cast("struct<s:long,e:long>").alias("_span"))
    s = spans.select(key, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), payload.cast("struct<s:long,e:long>").alias("_span"))
    over = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(s).withColumn("_last", F.last("_span", ignorenulls=True).over(over)).filter("_kind = 1")
    inside = F.col("_last.e") > F.col("_at")
    return both.select("_row.*", F.when(inside, F.col("_last.s")).alias("span_start"), F.when(inside, F.col("_last.e")).alias("span_end"))


def capacity(measures: DataFrame, limits: DataFrame, reps: int = 3) -> DataFrame:
    """(check, n, worst, verdict): pass or fail by the worst measure, incomplete under ``reps`` of them, measured without a limit."""
    g = measures.groupBy("check").agg(F.count("value").alias("n"), F.max("value").alias("worst"))
    j = limits.select("check", F.col("limit").alias("_l"), F.lit(True).alias("_known")).join(g, "check", "full")
    verdict = F.when(F.coalesce("n", F.lit(0)) < reps, "incomplete").when(F.col("_l").isNull(), "measured").when(F.col("worst") <= F.col("_l"), "pass").otherwise("fail")
    return j.select("check", F.coalesce("n", F.lit(0)).alias("n"), "worst", verdict.alias("verdict"))


def compare_orders(before: DataFrame, after: DataFrame, depths: Sequence[int]) -> DataFrame:
    """(depth, both, lost, gained) for the first rows of two orders. Both: id, position."""
    j = before.select("id", F.col("position").alias("p")).join(after.select("id", F.col("position").alias("q")), "id", "full")
    d = j.select("p", "q", F.explode(F.array(*map(F.lit, depths))).alias("depth"))
    p, q = F.coalesce(F.col("p") <= F.col("depth"), F.lit(False)), F.coalesce(F.col("q") <= F.col("depth"), F.lit(False))
    return d.groupBy("depth").agg(F.count_if(p & q).alias("both"), F.count_if(p & ~q).alias("lost"), F.count_if(q & ~p).alias("gained"))


def edge_state(references: Column, own: Column) -> Column:
    """not_read (list unknown), unresolved (the other has no id), present or absent."""
    return F.when(references.isNull(), "not_read").when(own.isNull() | (F.size(own) == 0), "unresolved").when(F.arrays_overlap(references, own), "present").otherwise("absent")

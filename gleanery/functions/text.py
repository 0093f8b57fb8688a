"""Text functions as columns: all run in the JVM."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

WORD = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"
#: What lies between two words, or before the first and after the last: all but one hyphen or apostrophe inside a word.
GAP = r"[^\p{L}\p{N}]{2,}|[^\p{L}\p{N}'’-]|\A[-'’]|[-'’]\z"


def _plain_forms() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility form without marks is one other character, and those where it is several."""
    one, many = {}, {}
    for c in map(chr, (*range(0x80, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if plain != c.lower() and plain and not plain.isspace():
            (one if len(plain) == 1 else many)[c.lower() if len(c.lower()) == 1 else c] = plain
    return one, many


_ONE, _MANY = _plain_forms()
ACCENTED, PLAIN = "".join(_ONE), "".join(_ONE.values())
#: Of the letters that fold to several, those that texts hold: sharp s and the printed ligatures.
FOLDED = {c: x for c, x in _MANY.items() if c in "\u00df\u0133" or c >= "\ufb00"}

#: Names that stand for no author.
PLACEHOLDER_AUTHORS = ("anonymous", "unknown")


_INDEX = ArrayType(StructType([StructField("word", StringType()), StructField("positions", ArrayType(IntegerType()))]))


def chunks(text: Column) -> Column:
    """Runs outside ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def words(text: Column) -> Column:
    """Lower-case words; inner hyphens and apostrophes stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def split_words(text: Column) -> Column:
    """``words``, cut at the gaps between them: no match is kept as an object, so long texts take less time."""
    return F.array_remove(F.split(F.lower(text), GAP), "")


def padded(text: Column) -> Column:
    """The words as one run with a space at both ends, so a form is found at a word start by ``contains``."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def form(text: Column) -> Column:
    """A phrase as the run of words that ``padded`` text is searched for."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "))


def fold(text: Column) -> Column:
    """Case-folded compatibility form without marks: accents, ligatures and full-width forms become plain letters."""
    out = F.translate(F.lower(text), ACCENTED, PLAIN)
    for c, plain in FOLDED.items():
        out = F.replace(out, F.lit(c), F.lit(plain))
    return F.regexp_replace(out, r"\p{Mn}+", "")


def normalize(text: Column) -> Column:
    """Accent-free, markup-free lower-case words joined by single spaces; null gives an empty string."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", " "), r"\$[^$]*\$", " ")
    return F.trim(F.regexp_replace(fold(plain), r"[^\p{L}\p{N}]+", " "))


def trigrams(text: Column) -> Column:
    """Distinct unpadded character trigrams of a normalised text."""
    n, c = F.greatest(F.length(text) - 2, F.lit(1)), F.split(text, "")  # the characters, so that no place is searched from the start
    join = lambda a, b: F.concat(a, b)
    grams = F.zip_with(F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), join), F.slice(c, 3, n), join)
    return F.when(F.length(text) > 2, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two sets; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def gram_codes(text: str) -> np.ndarray:
    """The distinct trigrams of a text as sorted numbers: three code points of 21 bits, so no two trigrams share one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


@F.arrow_udf(DoubleType())
def gram_jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    """``jaccard`` of the ``trigrams`` of two normalised texts; null when either is null or empty."""

    def one(x: str | None, y: str | None) -> float | None:
        if not x or not y:
            return None
        if len(x) < 3 or len(y) < 3:
            return 0.0
        g, h = gram_codes(x), gram_codes(y)
        common = len(np.intersect1d(g, h, assume_unique=True))
        return common / (len(g) + len(h) - common)

    return pa.array([one(x.as_py(), y.as_py()) for x, y in zip(a, b)], pa.float64())


def similarity(df: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    """``df`` with the trigram Jaccard of two text columns, null when either normalises to nothing."""
    return df.withColumns({"_x": normalize(F.col(a)), "_y": normalize(F.col(b))}).withColumn(name, gram_jaccard("_x", "_y")).drop("_x", "_y")


#: Cells of a table of texts by trigrams that is held at once.
CELLS = 1 << 22


@functools.lru_cache(maxsize=1024)
def _kept_codes(text: str) -> np.ndarray:
    return gram_codes(text)


def gram_table(left: list[str | None], right: list[str | None]) -> list[list[float | None]]:
    """``gram_jaccard`` of each text of the one list with each of the other: common trigrams are counted by products of tables of
    zeros and ones."""
    code = lambda t: _kept_codes(t) if t and len(t) > 2 else np.empty(0, np.int64)
    g, h = [code(t) for t in left], [code(t) for t in right]
    m, n = np.array(list(map(len, g))), np.array(list(map(len, h)))
    known = np.unique(np.concatenate(g))
    common = np.zeros((len(g), len(h)))
    if len(known):
        lines = max(1, CELLS // len(known))

        def table(sets: list[np.ndarray]) -> np.ndarray:
            every, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), list(map(len, sets)))
            at = np.minimum(np.searchsorted(known, every), len(known) - 1)
            held = known[at] == every
            out = np.zeros((len(sets), len(known)), np.float32)
            out[row[held], at[held]] = 1
            return out

        for i in range(0, len(g), lines):
            mine = table(g[i : i + lines])
            for j in range(0, len(h), lines):
                common[i : i + lines, j : j + lines] = mine @ table(h[j : j + lines]).T
    found = (common / np.maximum(m[:, None] + n[None, :] - common, 1)).astype(object)
    found[[not t for t in left]] = None
    found[:, [not t for t in right]] = None
    return found.tolist()


@F.arrow_udf(_INDEX)
def inverted_index(text: pa.Array) -> pa.Array:
    """Each distinct word of a text, cut at single spaces, with its places, from 0."""
    found: list[dict[str, list[int]]] = []
    for t in text.to_pylist():
        places: dict[str, list[int]] = {}
        for at, w in enumerate(t.split(" ") if t else ()):
            places.setdefault(w, []).append(at)
        found.append(places)
    ends = lambda sizes: pa.array([0, *accumulate(sizes)], pa.int32())
    lists = [p for places in found for p in places.values()]
    flat = pa.array(np.fromiter(chain.from_iterable(lists), np.int32, sum(map(len, lists))))
    words = pa.array([w for places in found for w in places], pa.string())
    return pa.ListArray.from_arrays(ends(map(len, found)), pa.StructArray.from_arrays([words, pa.ListArray.from_arrays(ends(map(len, lists)), flat)], ["word", "positions"]))


def from_inverted_index(index: Column) -> Column:
    """The words of an inverted index in the order of their places, joined by single spaces."""
    placed = F.flatten(F.transform(index, lambda e: F.transform(e["positions"], lambda p: F.struct(p.alias("pos"), e["word"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["word"]), " ")


def title_key(text: Column) -> Column:
    """Lower-case title with every run of other characters turned to one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def doi(value: Column) -> Column:
    """A DOI without its resolver, lower-case and trimmed."""
    return F.lower(F.trim(F.regexp_replace(value, r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")))


def short_id(value: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(F.regexp_replace(value, "/+$", ""), "/"), -1)


def host(url: Column) -> Column:
    """Lower-case host of a URL."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def strip_markup(html: Column) -> Column:
    """Text of marked-up text: tags to spaces, the five XML references decoded, white space folded."""
    out = F.regexp_replace(html, r"<[^>]+>", " ")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ref), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def singular(word: Column) -> Column:
    """The plain singular of an English plural: -ies, -es after s, x, z, ch or sh, and -s, but not -ss, -us, -is;
    words of up to three letters stay."""
    n = F.length(word)
    return (
        F.when(n <= 3, word)
        .when(word.endswith("ies") & (n > 4), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
        .when(word.rlike(r"(?:s|x|z|ch|sh)es$"), F.substring(word, F.lit(1), n - 2))
        .when(word.endswith("s") & ~word.rlike(r"(?:ss|us|is)$"), F.substring(word, F.lit(1), n - 1))
        .otherwise(word)
    )


def redact(text: Column, secrets: Sequence[str | None] = ()) -> Column:
    """Given secrets replaced wherever they occur; then values of secret-looking parameters and bearer tokens blotted out."""
    out = text
    for secret in secrets:
        if secret:
            out = F.replace(out, F.lit(secret), F.lit("<redacted>"))
    text = out
    out = F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret|password|ref)=)[^&#\s]+", "$1***")
    return F.regexp_replace(out, r"(?i)(bearer )[A-Za-z0-9._-]+", "$1***")


def head(text: Column, n: int) -> Column:
    """At most ``n`` characters, cut back to a word end when the cut falls inside a word."""
    return F.when(F.length(text) <= n, text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), F.lit(n + 1)), r"[^ ]*$", ""))


def provisional_title(text: Column, n: int = 15) -> Column:
    """The first ``n`` words, with an ellipsis if more follow."""
    w = chunks(text)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit(" …")).otherwise(F.lit("")))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane take two."""
    return (F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def surname(name: Column) -> Column:
    """Family name of "Last, First" or "First Last", normalised and without spaces; null for placeholders."""
    part = F.when(name.contains(","), F.element_at(F.split(name, ","), 1)).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), -1))
    out = F.replace(normalize(part), F.lit(" "), F.lit(""))
    return F.when((out != "") & ~out.isin(*PLACEHOLDER_AUTHORS), out)


#: Common function words of the languages that are told apart.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was"),
    "de": ("der", "die", "und", "das", "von", "mit", "dem", "den", "ist", "nicht"),
    "fr": ("le", "la", "les", "des", "et", "de", "une", "est", "dans", "que"),
    "es": ("el", "los", "las", "del", "que", "para", "una", "con", "por", "como"),
}


def language(text: Column) -> Column:
    """The language with most function words, ties in the order of the table; null without any."""
    w = words(text)
    counts = [_share(w, lang) for lang in FUNCTION_WORDS]
    best = F.greatest(*counts)
    out = F.lit(None).cast("string")
    for lang, n in reversed(list(zip(FUNCTION_WORDS, counts))):
        out = F.when((n == best) & (best > 0), F.lit(lang)).otherwise(out)
    return out


def _share(w: Column, lang: str) -> Column:
    return F.size(F.filter(w, lambda x: x.isin(*FUNCTION_WORDS[lang])))


def compact(text: Column) -> Column:
    """Letters and digits alone, lower-case: what a quote is compared by."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def numbers(text: Column) -> Column:
    """Numbers of a text as decimals: thousands separators dropped."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?:,\d{3})*(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("decimal(38,6)"))


def shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of ``n`` tokens, joined by spaces."""
    size = F.size(tokens)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>"))

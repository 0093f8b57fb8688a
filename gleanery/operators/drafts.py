"""Drafts: the reference list is cut off, citation markers are found, each with its sentence and the claim it stands for, and resolved
against a bibliography.

Three styles are read. LaTeX commands name keys. Brackets name numbers, alone, listed or as ranges within or between brackets. Author and year
stand in parentheses, or the names before a year in parentheses. What looks like a marker but cannot be read is kept as
unrecognized, without targets. Texts are read one at a time in Arrow batches; resolving is joins.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.latex import to_text
from gleanery.operators.decisions import authors_admitted
from gleanery.operators.evidence import sentence_spans

# Commands that cite, the widest range of numbers, brackets that cite nothing, parts of surnames, words that may
# stand before the names of a citation, words that may open one, and headings of a reference list.
CITE_COMMANDS = (
    "cite citep citet citealp citealt citeauthor citeyear parencite textcite autocite footcite smartcite Cite Citep Citet Parencite Textcite Autocite"
).split()
WIDEST_RANGE = 100
NO_CITATION = frozenset({"sic", "...", "…", "x", "X", ""})
PARTICLES = frozenset("van von de der den del della di da du des le la dos das ten ter al el bin ibn".split())
LEAD_WORDS = frozenset(
    "in as by see following unlike like per from with both while whereas then also thus hence here recently similarly however later earlier but for when after before "
    "since although though yet so the this that these those our their his her its we they it".split()
)
PREFIXES = ("e.g.", "i.e.", "see also", "see", "cf.")
HEADINGS = ("references", "bibliography", "works cited", "kaynaklar", "kaynakça", "kaynakca")

_CITE = re.compile(rf"\\(?:{'|'.join(CITE_COMMANDS)})\*?(?![A-Za-z@])(?P<args>(?:(?:\s*\[[^\[\]{{}}]*\]){{0,2}}\s*\{{(?P<keys>[^{{}}]*)\}})?)")
_KEY = re.compile(r"[^\s{}\\,%#~]+")
_BRACKETS = re.compile(r"\[[^\[\]\n]{1,80}\](?:[ \t]*[,;–—−-][ \t]*\[[^\[\]\n]{1,80}\])*")
_ITEM = re.compile(r"(?P<number>\d+)|(?P<dash>[-–—−])|(?P<comma>[,;])|(?P<edge>[\[\]])|\s+|(?P<other>.)")
_PAREN = re.compile(r"\(([^()\n]{1,300})\)")
_YEAR = re.compile(r"(?:1[5-9]\d\d|20\d\d)[a-z]?")
_WORD = re.compile(r"et\s+al\b\.?|[^\W\d_][\w'’\-]*|\d+[a-z]?|&|\S")
_HEADING = re.compile(rf"(?im)^[ \t]*(?:#{{1,6}}[ \t]*|\\(?:section|chapter)\*?\{{)?[ \t]*(?:\d+\.?[ \t]+)?(?:{'|'.join(HEADINGS)})[ \t]*\}}?[ \t]*:?[ \t]*$")
_LIST_NUMBER = re.compile(r"(?m)^[ \t]*\[(\d{1,4})\][ \t]*")
_BIBITEMS = re.compile(r"\\begin\{thebibliography\}(.*?)(?:\\end\{thebibliography\}|\Z)", re.S)
_BIBITEM = re.compile(r"\\bibitem\s*(?:\[[^\]]*\])?\s*\{([^{}]+)\}")


class Target(NamedTuple):
    kind: str
    value: str
    names: tuple[str, ...] = ()
    et_al: bool = False
    year: int | None = None
    suffix: str | None = None


class Marker(NamedTuple):
    start: int
    end: int
    style: str
    targets: tuple[Target, ...]


def _latex(text: str) -> Iterator[Marker]:
    for m in _CITE.finditer(text):
        keys = [k.strip() for k in (m["keys"] or "").split(",")]
        read = all(_KEY.fullmatch(k) for k in keys)
        yield Marker(m.start(), m.end(), "latex", tuple(Target("key", k) for k in dict.fromkeys(keys)) if read else ())


def numbers(group: str) -> list[int] | None:
    """The numbers that a group of brackets names, or null. A dash joins two numbers to a range, be it inside a bracket or between two."""
    out: list[int] = []
    state = "open"  # what the last item was: open (nothing yet or a comma), number, dash, range
    for m in _ITEM.finditer(group):
        kind = m.lastgroup
        if kind == "number":
            n = int(m[0])
            if len(m[0]) > 4 or n < 1 or state in ("number", "range") or (state == "dash" and not out[-1] < n <= out[-1] + WIDEST_RANGE and n != out[-1]):
                return None
            out += range(out[-1] + 1, n + 1) if state == "dash" else [n]
            state = "range" if state == "dash" else "number"
        elif kind == "dash":
            if state != "number":
                return None
            state = "dash"
        elif kind == "comma":
            if state not in ("number", "range"):
                return None
            state = "open"
        elif kind == "other":
            return None
    return list(dict.fromkeys(out)) if state in ("number", "range") else None


def _numeric(text: str) -> Iterator[Marker]:
    for m in _BRACKETS.finditer(text):
        if text[m.end() : m.end() + 1] in ("(", ":") and m.end() < len(text) or m[0].startswith("[^"):
            continue  # a link or a footnote
        found = numbers(m[0])
        content = re.sub(r"[\[\]]", "", m[0]).strip()
        if found:
            yield Marker(m.start(), m.end(), "numeric", tuple(Target("number", str(n)) for n in found))
        elif content not in NO_CITATION and (re.search(r"[\d@]", content) or re.fullmatch(r"\S{1,30}", content)):
            yield Marker(m.start(), m.end(), "numeric", ())


def _name(word: str) -> bool:
    return word[:1].isupper() and word[-1:].isalnum() and not word[0].isdigit()


class Names(NamedTuple):
    """A run of names among word tokens: from token ``first``, each name as written."""

    first: int
    names: tuple[str, ...]
    et_al: bool


def _names_before(words: list[re.Match], stop: int) -> Names | None:
    """The longest run of names that ends at token ``stop``, read from its end: a name with its particles, then whatever "and" or a comma joins to it."""
    k, et_al = stop - 1, False
    if k >= 0 and words[k][0].startswith("et") and words[k][0][2:3].isspace():
        k, et_al = k - 1, True
    names: list[str] = []
    first = -1
    while k >= 0 and _name(words[k][0]):
        last = k
        while k > 0 and words[k - 1][0].lower() in PARTICLES:
            k -= 1
        names.append(" ".join(w[0] for w in words[k : last + 1]))
        first = k
        joint = k - 1
        if joint >= 0 and words[joint][0] in ("and", "&"):
            joint -= 1
            if joint >= 0 and words[joint][0] == ",":
                joint -= 1
        elif joint >= 0 and words[joint][0] == ",":
            joint -= 1
        else:
            break
        if joint < 0 or not _name(words[joint][0]):
            break
        k = joint
    return Names(first, tuple(reversed(names)), et_al) if names else None


def _years(words: list[str]) -> list[str] | None:
    """Years between commas, or null."""
    years, commas = words[::2], words[1::2]
    return years if years and len(commas) == len(years) - 1 and all(map(_YEAR.fullmatch, years)) and all(c == "," for c in commas) else None


def _targets(found: Names, years: list[str]) -> list[Target]:
    shown = ", ".join(found.names) + (" et al." if found.et_al else "")
    return [Target("author_year", f"{shown}, {y}", found.names, found.et_al, int(y[:4]), y[4:] or None) for y in years]


def _unclear(words: list[re.Match], first: int) -> bool:
    """Whether the word before the names may be part of them."""
    if first == 0:
        return False
    word = words[first - 1][0]
    if word in (",", "&") or word.lower() in ("and", "et", "und") or word.lower() in PARTICLES:
        return True
    return word[0].isupper() and word.lower() not in LEAD_WORDS


def _cited_item(item: str) -> list[Target] | None:
    """Names, a comma or none, years, and maybe a place in the work."""
    item = item.strip()
    for p in PREFIXES:
        if item.lower().startswith(p):
            item = item[len(p) :].lstrip(" ,")
            break
    item = re.sub(r"\s*,\s*(?:p|pp|ch|sec)\.\s*[\w–\-]+$", "", item)
    words = list(_WORD.finditer(item))
    stop = next((k for k, w in enumerate(words) if _YEAR.fullmatch(w[0])), None)
    if not stop:
        return None
    found = _names_before(words, stop - 1 if words[stop - 1][0] == "," else stop)
    years = _years([w[0] for w in words[stop:]])
    return _targets(found, years) if found and found.first == 0 and years else None


def _opens_citation(content: str) -> bool:
    """Whether any item of a parenthesis begins with a name and reaches a year."""
    return any(re.match(r"\s*(?:(?:e\.g\.|i\.e\.|see also|see|cf\.)\s*,?\s*)?[^\W\d_]", i) and _YEAR.search(i) and any(map(_name, re.findall(r"[^\W\d_][\w'’\-]*", i)[:4])) for i in content.split(";"))


def _author_year(text: str) -> Iterator[Marker]:
    for m in _PAREN.finditer(text):
        years = _years([w[0] for w in _WORD.finditer(m[1])])
        if years:
            low = max(text.rfind("\n\n", 0, m.start()) + 1, m.start() - 160, 0)
            words = list(_WORD.finditer(text, low, m.start()))
            found = _names_before(words, len(words))
            if found:
                start = words[found.first].start()
                cut = found.first == 0 and low > 0 and not text[low - 1].isspace()
                yield Marker(start, m.end(), "author_year", () if cut or _unclear(words, found.first) else tuple(_targets(found, years)))
        elif _opens_citation(m[1]):
            items = [_cited_item(i) for i in m[1].split(";")]
            yield Marker(m.start(), m.end(), "author_year", tuple(t for i in items for t in i) if all(items) else ())


def find_markers(text: str, latex: bool = False) -> list[Marker]:
    """All markers in order. Of two that overlap LaTeX goes before numbers and numbers before names, then the earlier start; brackets are no
    markers in a LaTeX text."""
    kept: list[Marker] = []
    for found in (_latex(text), () if latex else _numeric(text), _author_year(text)):
        starts, fresh = [m.start for m in kept], []
        for m in sorted(found):
            k = bisect_right(starts, m.start)
            free = (k == 0 or kept[k - 1].end <= m.start) and (k == len(kept) or m.end <= kept[k].start)
            if free and not (fresh and fresh[-1].end > m.start):
                fresh.append(m)
        kept = sorted(kept + fresh)
    return kept


def cut_references(text: str) -> tuple[str, list[tuple[int, str | None, int | None, str]]]:
    """The body, and the entries (ordinal, key, number, raw) of a bibliography environment or of what follows the last heading of a list."""
    flat = lambda s: " ".join(s.split())
    block = _BIBITEMS.search(text)
    if block:
        pieces = _BIBITEM.split(block[1])
        entries = [(k + 1, key.strip(), None, flat(raw)) for k, (key, raw) in enumerate(zip(pieces[1::2], pieces[2::2]))]
        return text[: block.start()] + text[block.end() :], entries
    headings = list(_HEADING.finditer(text))
    if not headings:
        return text, []
    body, tail = text[: headings[-1].start()], text[headings[-1].end() :]
    pieces = _LIST_NUMBER.split(tail)
    if len(pieces) > 1:
        found = [(None, int(n), flat(raw)) for n, raw in zip(pieces[1::2], pieces[2::2])]
    else:
        blocks = [b for b in re.split(r"\n[ \t]*\n", tail) if b.strip()]
        lines = blocks if len(blocks) > 1 else tail.split("\n")
        found = [(None, None, flat(re.sub(r"^(?:[-*+•][ \t]+|\d{1,4}\.[ \t]+)", "", x.strip()))) for x in lines]
    return body, [(k + 1, *e) for k, e in enumerate(e for e in found if e[2])]


MARKERS = (
    "draft_id long, marker_no int, start int, end int, raw string, style string, status string, "
    "targets array<struct<kind:string,value:string,names:array<string>,et_al:boolean,year:int,suffix:string>>, sentence_start int, sentence_end int, claim string"
)


def markers(drafts: DataFrame) -> DataFrame:
    """Every marker of ``drafts`` (draft_id, text, latex), its targets, its sentence (markers end none) and the claim: the sentence without markers."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, text, latex in zip(f["draft_id"], f["text"], f["latex"]):
                body, _ = cut_references(text or "")
                found = find_markers(body, bool(latex))
                spans = sentence_spans(body, [(m.start, m.end) for m in found])
                begins = [a for a, _ in spans]
                for k, m in enumerate(found):
                    at = bisect_right(begins, m.start) - 1
                    a, b = spans[at] if at >= 0 and m.start < spans[at][1] else (m.start, m.end)
                    out, last = [], a
                    for x in found:
                        if a <= x.start < b:
                            out.append(body[last : x.start])
                            last = min(x.end, b)
                    cut = "".join([*out, body[last:b]])
                    claim = to_text(cut) if latex or m.style == "latex" else " ".join(cut.split())
                    claim = re.sub(r"\s+([.,;:!?])", r"\1", claim)
                    rows.append((i, k, m.start, m.end, body[m.start : m.end], m.style, "recognized" if m.targets else "unrecognized", [t._asdict() | {"names": list(t.names)} for t in m.targets], a, b, claim))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in re.split(r", (?=\w+ )", MARKERS)])

    return drafts.select("draft_id", "text", "latex").mapInPandas(read, MARKERS)


def references(drafts: DataFrame) -> DataFrame:
    """(draft_id, ordinal, key, number, raw): the entries of the drafts' own lists."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *e) for i, text in zip(f["draft_id"], f["text"]) for e in cut_references(text or "")[1]]
            out = pd.DataFrame(rows, columns=["draft_id", "ordinal", "key", "number", "raw"])
            yield out.astype({"number": "Int32"})

    return drafts.select("draft_id", "text").mapInPandas(read, "draft_id long, ordinal int, key string, number int, raw string")


def resolve(found: DataFrame, entries: DataFrame) -> DataFrame:
    """(draft_id, marker_no, value, ordinal, status) of every target of ``found`` (as from ``markers``) against ``entries`` (draft_id, ordinal, key,
    number, year, suffix, surnames; surnames null where they cannot be read).

    planned: exactly one entry is meant. A key or number that no entry has is unresolved. A name and year that do not single out one
    entry are ambiguous, as they are where an entry of that year has authors that cannot be read."""
    t = found.select("draft_id", "marker_no", F.posexplode("targets").alias("k", "t")).select("draft_id", "marker_no", "k", "t.*")
    low = lambda c: F.transform(c, lambda n: F.lower(n))
    e = entries.select("draft_id", "ordinal", F.col("key").alias("e_key"), F.col("number").cast("string").alias("e_number"), F.col("year").alias("e_year"), F.col("suffix").alias("e_suffix"), low("surnames").alias("surnames"))
    exact = t.filter("kind <> 'author_year'")
    named = lambda kind, col: exact.filter(F.col("kind") == kind).join(e.filter(F.col(col).isNotNull()).select("draft_id", "ordinal", F.col(col).alias("value")), ["draft_id", "value"], "left")
    one = named("key", "e_key").select("draft_id", "marker_no", "k", "value", "kind", "ordinal", F.lit(False).alias("torn"))
    two = named("number", "e_number").select(*one.columns[:-1], F.lit(False).alias("torn"))
    years = t.filter("kind = 'author_year'").withColumn("e_year", F.col("year")).join(e.drop("e_key", "e_number"), ["draft_id", "e_year"], "left")
    unread = F.col("ordinal").isNotNull() & (F.col("surnames").isNull() | F.exists("surnames", lambda s: s.isNull() | (s == "")))
    meant = authors_admitted(low("names"), F.col("et_al"), F.col("surnames")) & (F.col("suffix").isNull() | F.col("suffix").eqNullSafe(F.col("e_suffix")))
    three = years.select("draft_id", "marker_no", "k", "value", "kind", F.when(F.coalesce(meant, F.lit(False)), F.col("ordinal")).alias("ordinal"), F.coalesce(unread, F.lit(False)).alias("torn"))
    each = one.unionByName(two).unionByName(three).groupBy("draft_id", "marker_no", "k", "value", "kind").agg(F.count("ordinal").alias("n"), F.min("ordinal").alias("ordinal"), F.bool_or("torn").alias("torn"))
    planned = (F.col("n") == 1) & ~F.col("torn")
    status = F.when(planned, "planned").when((F.col("n") == 0) & (F.col("kind") != "author_year"), "unresolved").otherwise("ambiguous")
    return each.select("draft_id", "marker_no", "value", F.when(planned, F.col("ordinal")).alias("ordinal"), status.alias("status"))

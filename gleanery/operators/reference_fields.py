"""Fields of free-text references: a reference is cut at its punctuation and each piece labelled by dynamic programming.

Pieces end at commas, points, colons, quotation marks and brackets, but not behind an initial or an abbreviation. Every piece scores for every
field by what it looks like; fields follow each other in orders that styles of references use, and the best path over all pieces
is taken, so an odd piece is read by what stands around it. Authors are then read as surnames. One reference at a time, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from gleanery.operators.drafts import PARTICLES

FIELDS = ("authors", "year", "title", "venue", "place", "link")
AUTHORS, YEAR, TITLE, VENUE, PLACE, LINK = range(6)

#: What following fields cost by the field before: going on in a field is free, an unusual order is dear, a return dearer still.
STEP = (
    (0.0, 0.2, 0.2, 4.0, 6.0, 4.0),
    (6.0, 0.5, 0.3, 1.5, 0.8, 1.0),
    (8.0, 0.8, 0.0, 0.3, 1.5, 1.0),
    (8.0, 0.4, 5.0, 0.0, 0.2, 0.6),
    (8.0, 0.4, 6.0, 2.5, 0.0, 0.4),
    (8.0, 1.5, 6.0, 3.0, 3.0, 0.0),
)
#: What a reference costs that begins with a field.
FIRST = (0.0, 4.0, 2.5, 6.0, 8.0, 6.0)

_YEAR = re.compile(r"(?<![\d/.])(1[5-9]\d\d|20\d\d)([a-z]?)(?![\d/])")
_CUT = re.compile(r";|[.,:?!](?=\s|$|[”\"'’)])[”\"'’)]*|[()\[\]]|[“”\"]")
#: What a point may stand behind without ending a piece: an initial, or an abbreviation.
_NO_END = re.compile(r"(?:^|[\s.\-])(?:[A-ZÀ-Þ]|(?i:al|vol|no|pp|p|ed|eds|art|ch|proc|trans|conf|int|univ|st|jr))$")
_INITIALS = re.compile(r"(?:[A-ZÀ-Þ]\.[ -]?)+$|[A-ZÀ-Þ]{1,3}$")
_NAME = re.compile(r"[A-ZÀ-Þ][\w'’\-]+")
_LINK = re.compile(r"https?:|doi|10\.\d{4,9}/|www\.|arxiv:", re.I)
_NUMBERS = re.compile(r"(?:vol(?:ume)?|no|pp?|issue|art(?:icle)?|ch)?\.?\s*[A-Z]?\d+[\d\s–—\-]*$", re.I)
VENUE_WORDS = re.compile(
    r"\b(?:journal|proc(?:eedings)?|conference|conf|symposium|workshop|transactions|trans|letters|review|reviews|annals|bulletin|magazine|press|university|univ|publishers?|publishing"
    r"|springer|elsevier|wiley|ieee|acm|lecture notes|advances|quarterly|archives?)\b|^in\b",
    re.I,
)


def pieces(raw: str) -> list[tuple[int, int]]:
    """Where the pieces of a reference start and end. A point behind an initial ends none, unless initials are written without points; a year
    at the end of a piece is one of its own."""
    out, at = [], 0
    bare = re.match(r"(?:[a-zà-þ]+ )*[A-ZÀ-Þ][\w'’\-]+ [A-ZÀ-Þ]{1,3}[,.]", raw) is not None
    for m in _CUT.finditer(raw):
        head = raw[at : m.start()]
        if m[0][0] == "." and not (bare and re.search(r"[a-zà-þ] [A-ZÀ-Þ]{1,3}$", head)) and _NO_END.search(head):
            continue
        if head.strip():
            out.append((at + len(head) - len(head.lstrip()), m.start()))
        at = m.end()
    if raw[at:].strip():
        out.append((at + len(raw[at:]) - len(raw[at:].lstrip()), len(raw.rstrip())))
    cut = []
    for a, b in out:
        tail = re.search(r"\s(?:1[5-9]\d\d|20\d\d)[a-z]?$", raw[a:b])
        cut += [(a, a + tail.start()), (a + tail.start() + 1, b)] if tail else [(a, b)]
    return cut


def _looks(raw: str, a: int, b: int, place: float) -> list[float]:
    """How well a piece fits each field; ``place`` is where it stands, from 0 to 1."""
    text = raw[a:b].strip()
    words = re.findall(r"[^\W\d_][\w'’\-]*\.?", text)
    small = sum(w[0].islower() and w not in PARTICLES for w in words)
    names = sum(bool(_NAME.fullmatch(w)) for w in words)
    initials = sum(bool(_INITIALS.fullmatch(w)) for w in words)
    quoted = raw[max(0, a - 1) : a] in ("“", '"')
    year = _YEAR.fullmatch(text)
    digits = sum(c.isdigit() for c in text)
    s = [0.0] * 6
    s[AUTHORS] = 2.0 * (initials > 0) + 1.5 * (0 < initials == len(words)) + 1.5 * (0 < names <= 3 and small <= 1) + 1.0 * bool(re.search(r"\b(?:and|et al)\b|&", text)) - 1.5 * max(0, small - 1) - 2.5 * (digits > 0) - 1.5 * place - 3.0 * (len(words) > 9) - 2 * quoted
    s[YEAR] = 6.0 if year else 2.0 if _YEAR.search(text) and len(words) <= 1 and len(text) < 12 else -5.0
    s[TITLE] = 0.6 * min(small, 6) + 0.25 * min(len(words), 8) + 4.0 * quoted - 2.0 * (len(words) < 2) - 3.0 * bool(_LINK.search(text)) - 1.5 * (initials > 1) - 1.0 * (digits > 3)
    s[VENUE] = 2.2 * bool(VENUE_WORDS.search(text)) + 1.2 * (names > small and (names > 1 or names == len(words))) + 1.5 * place - 3.0 * (not words) - 0.35 * max(0, small - 3) - 2.0 * bool(_LINK.search(text)) - 3.0 * bool(year) - 2 * quoted
    s[PLACE] = 3.5 * bool(_NUMBERS.fullmatch(text)) + 1.0 * (digits >= 1 and len(words) <= 2) + 1.0 * place - 4.0 * (digits == 0) - 4.5 * bool(year) - 3.0 * bool(_LINK.search(text))
    s[LINK] = 6.0 if _LINK.search(text) else -5.0
    return s


def labelled(raw: str) -> list[tuple[int, int, int]]:
    """(start, end, field) of the pieces on the best path."""
    spans = pieces(raw)
    best: list[float] = []
    back: list[list[int]] = []
    for k, (a, b) in enumerate(spans):
        fit = _looks(raw, a, b, k / len(spans))
        if not best:
            best = [f - c for f, c in zip(fit, FIRST)]
            continue
        came = [max(range(6), key=lambda p, to=to: best[p] - STEP[p][to]) for to in range(6)]
        best = [best[p] - STEP[p][to] + fit[to] for to, p in enumerate(came)]
        back.append(came)
    path = [max(range(6), key=best.__getitem__)] if best else []
    for came in reversed(back):
        path.append(came[path[-1]])
    return [(a, b, f) for (a, b), f in zip(spans, reversed(path))]


def surnames(authors: str) -> list[str]:
    """Surnames of an author list in any order of names and initials."""
    text = re.sub(r"\bet\s+al\b\.?", "", authors)
    out: list[str] = []
    for part in re.split(r"\s*(?:;|,|\band\b|&)\s*", text):
        words = part.split()
        kept = [w for w in words if not _INITIALS.fullmatch(w) and w.lower().rstrip(".") not in ("jr", "sr", "eds", "ed")]
        if kept:
            first = next((k for k, w in enumerate(kept) if w[0].islower()), len(kept) - 1)  # particles belong to the surname
            out.append(" ".join(kept[first:]))
    return out


def fields(raw: str) -> dict[str, object]:
    """authors (surnames), year, suffix, title, venue, place and link of one reference; null where it has none."""
    runs: dict[int, list[list[int]]] = {}
    last = -1
    for a, b, f in labelled(raw):
        if f == last:
            runs[f][-1][1] = b
        else:
            runs.setdefault(f, []).append([a, b])
        last = f
    text = {f: raw[slice(*spans[0])] if f == AUTHORS else max((raw[a:b].strip(" .,;:“”\"'()") for a, b in spans), key=len) for f, spans in runs.items()}
    year = _YEAR.search(text.get(YEAR, ""))
    return {
        "surnames": surnames(text[AUTHORS]) if AUTHORS in text else None,
        "year": int(year[1]) if year else None,
        "suffix": (year[2] or None) if year else None,
        **{name: text.get(k) or None for k, name in ((TITLE, "title"), (VENUE, "venue"), (PLACE, "place"), (LINK, "link"))},
    }


SCHEMA = "draft_id long, ordinal int, key string, number int, raw string, surnames array<string>, year int, suffix string, title string, venue string, place string, link string"


def read_fields(references: DataFrame) -> DataFrame:
    """``references`` (draft_id, ordinal, key, number, raw) with their fields: what ``drafts.resolve`` takes."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r._asdict() | fields(r.raw or "") for r in f.itertuples(index=False)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"year": "Int32", "number": "Int32"})

    return references.select("draft_id", "ordinal", "key", "number", "raw").mapInPandas(read, SCHEMA)

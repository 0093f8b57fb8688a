"""Whether a located quote says what its passage says, and whether the parts of a claim cover their sentence.

Texts become streams of typed tokens: numbers with sign and decimals, operators, other signs, words. Plain punctuation
is no token. A quote's stream is held against the tokens that its anchor touches, fact by fact, and against the
passage around them. Helpers read one pair at a time, in rows that Spark has dealt out.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.evidence import FUZZY, locate_anchor, of_row

# What is punctuation, a token, an operator, a negation, a comparison, a connective; how far around a
# quote a negation counts; the mark that stands for symbols nobody could read.
PUNCTUATION = frozenset(".,;:()[]'\"’“”")
LETTER = r"[^\W_¹²³¼-¾⁰-₟⅐-↏]"
TOKEN = re.compile(rf"(?P<num>(?<![\w.])[-−+±]?\d+(?:[.,]\d+)*)|(?P<op><=|>=|!=|==)|(?P<word>{LETTER}+(?:['’]{LETTER}+)*)|(?P<sym>[^\s.,;:()\[\]'\"’“”])")
OPERATORS = frozenset("<= >= != == < > ≤ ≥ ≠ ± = ≦ ≧ ⩽ ⩾ ~ ≈".split())
NEGATIONS = frozenset(
    "not no never without cannot neither nor none nobody nothing nowhere fail fails failed failing unable lack lacks lacked lacking değil yok hiç hiçbir asla".split()
)
CONTRACTION = re.compile(r"[^\W\d_]+n['’]t$")
CONNECTIVES = frozenset("and or but while whereas".split())
COMPARISONS = {
    "more": "more", "greater": "more", "less": "less", "fewer": "less", "higher": "higher", "lower": "lower", "larger": "larger", "smaller": "smaller",
    "better": "better", "worse": "worse", "increase": "increase", "increases": "increase", "increased": "increase", "increasing": "increase",
    "decrease": "decrease", "decreases": "decrease", "decreased": "decrease", "decreasing": "decrease",
}
BEFORE, AFTER = 250, 80
UNREADABLE = "[symbols not readable in the PDF]"
MATH = re.compile(r"\$[^$]+\$")

REASONS = ("part_negation", "placeholder", "negation", "number", "comparison", "unit", "boundary", "context")


class Token(NamedTuple):
    kind: str
    text: str
    key: str
    start: int
    end: int


def _token(kind: str, text: str, start: int) -> Token:
    if kind == "sym" and text in OPERATORS:
        kind = "op"
    key = (text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()) if kind == "word" else text.replace("−", "-") if kind == "num" else text
    return Token(kind, text, key, start, start + len(text))


def tokens(text: str, start: int = 0, end: int | None = None) -> list[Token]:
    """The typed tokens of a text or of a part of it."""
    return [_token(m.lastgroup, m[0], m.start()) for m in TOKEN.finditer(text[: len(text) if end is None else end], start)]


def claim_tokens(text: str) -> list[Token]:
    """Tokens of a claim, in which a ``$...$`` formula is one token, as written."""
    if "$" not in text:
        return tokens(text)
    out: list[Token] = []
    at = 0
    for m in [*MATH.finditer(text), None]:
        stop = m.start() if m else len(text)
        out += [t._replace(start=t.start + at, end=t.end + at) for t in tokens(text[at:stop])]
        if m:
            out.append(Token("math", m[0], m[0], *m.span()))
            at = m.end()
    return out


class Stream:
    """A text and its tokens, in order."""

    def __init__(self, text: str):
        self.text, self.tokens = text, tokens(text)
        self.starts, self.ends = [t.start for t in self.tokens], [t.end for t in self.tokens]
        self.unreadable = [m.span() for m in re.finditer(re.escape(UNREADABLE), text)]

    def touching(self, a: int, b: int) -> tuple[int, int]:
        """The range of tokens that the characters from a to b touch."""
        return bisect_right(self.ends, a), bisect_left(self.starts, b)

    def blank(self, a: int, b: int) -> bool:
        return not self.text[a:b].strip()

    def negations(self, i: int, j: int, shielded: bool = False) -> list[Token]:
        """Negations among tokens i to j. "not only" is none, nor "without" in "with and without", as long as all of the
        phrase is read; with ``shielded`` neither are words of the mark of unreadable symbols."""
        t, out = self.tokens, []
        near = lambda k: i <= k < j - 1 and self.blank(t[k].end, t[k + 1].start)
        for k in range(i, j):
            key = t[k].key
            if t[k].kind != "word" or (key not in NEGATIONS and not CONTRACTION.match(key)):
                continue
            only = key == "not" and near(k) and t[k + 1].key == "only"
            both = key == "without" and near(k - 1) and near(k - 2) and t[k - 1].key in ("and", "or") and t[k - 2].key == "with"
            hidden = shielded and any(a <= t[k].start and t[k].end <= b for a, b in self.unreadable)
            if not (only or both or hidden):
                out.append(t[k])
        return out

    def mended(self, i: int, j: int) -> list[Token]:
        """Tokens i to j, words that a line end cuts joined to one."""
        out: list[Token] = []
        k = i
        while k < j:
            t = self.tokens[k]
            cut = t.text == "-" and out and out[-1].kind == "word" and out[-1].end == t.start and k + 1 < j and self.tokens[k + 1].kind == "word"
            gap = self.text[t.end : self.tokens[k + 1].start] if cut else ""
            if "\n" in gap and not gap.strip():
                k += 1
                t = _token("word", out[-1].text + self.tokens[k].text, out.pop().start)._replace(end=self.tokens[k].end)
            out.append(t)
            k += 1
        return out

    def joins(self, at: int) -> bool:
        """Whether the character there belongs to what stands beside it: no space and no plain punctuation."""
        return 0 <= at < len(self.text) and not self.text[at].isspace() and self.text[at] not in PUNCTUATION


def _plain_case(t: Token) -> str:
    """A token as written, but for the capital that opens a sentence: units such as mW and MW stay apart."""
    capital = t.kind == "word" and len(t.text) > 2 and t.text.isalpha() and t.text[1:].islower()
    return t.text.lower() if capital else t.text


def _facts(ts: list[Token]) -> dict[str, object]:
    """What a quote and its place must have in common, in the order in which a difference is named."""
    following = [n.text if n is not None and n.kind != "num" else None for n in [*ts[1:], None]]
    return {
        "number": [t.key for t in ts if t.kind == "num"],
        "comparison": ([t.text for t in ts if t.kind in ("op", "sym")], Counter(COMPARISONS[t.key] for t in ts if t.key in COMPARISONS and t.kind != "num")),
        "unit": [(t.key, n) for t, n in zip(ts, following) if t.kind == "num"],
        "boundary": [_plain_case(t) for t in ts],
    }


def _edge_signs(ts: Sequence[Token]) -> int:
    """How many signs stand at the head of a run of tokens."""
    return next((k for k, t in enumerate(ts) if t.kind not in ("op", "sym")), len(ts))


def _place(quote: Stream, passage: Stream, a: int, b: int) -> str | None:
    """Why the quote may not say what stands at one place of the passage."""
    said = quote.mended(0, len(quote.tokens))
    t = passage.tokens
    i, j = passage.touching(a, b)
    if i >= j:
        return "boundary"
    for _ in range(_edge_signs(said)):  # signs that the quote opens or closes with belong to the place if they stand right there
        if i and t[i - 1].kind in ("op", "sym") and passage.blank(t[i - 1].end, t[i].start):
            i -= 1
    for _ in range(_edge_signs(said[::-1])):
        if j < len(t) and t[j].kind in ("op", "sym") and passage.blank(t[j - 1].end, t[j].start):
            j += 1
    a, b = t[i].start, t[j - 1].end
    if any(x < b and a < y for x, y in passage.unreadable):
        return "placeholder"
    if len(quote.negations(0, len(quote.tokens))) != len(passage.negations(i, j)):
        return "negation"
    ahead, behind = bisect_right(passage.ends, max(0, a - BEFORE)), bisect_left(passage.starts, min(len(passage.text), b + AFTER))
    if passage.negations(ahead, i, True) or passage.negations(j, behind, True):
        return "negation"
    there = _facts(passage.mended(i, j))
    for reason, fact in _facts(said).items():
        if fact != there[reason]:
            return reason
    if passage.joins(a - 1) or passage.joins(b):
        return "boundary"
    if i and t[i - 1].kind != "word" and passage.blank(t[i - 1].end, a):
        return "context"
    if j < len(t) and (t[j].kind != "word" or t[j - 1].kind == "num") and passage.blank(b, t[j].start):
        return "context"
    return None


def meaning_differs(quote: str, passage: str, start: int, end: int, part: str | None = None) -> str | None:
    """Why a quote located at start:end may say something that the passage does not, one of ``REASONS``, else null.

    The part that it supports must agree on whether anything is negated. Words that the passage holds more than once
    are read at each place, and one refusal refuses the quote."""
    said, text = Stream(quote), Stream(passage)
    if not said.tokens:
        return "boundary"
    if part is not None:
        claim = Stream(part)
        if bool(claim.negations(0, len(claim.tokens))) != bool(said.negations(0, len(said.tokens))):
            return "part_negation"
    words = passage[start:end]
    at = passage.find(words)
    while at >= 0:
        reason = _place(said, text, at, at + len(words))
        if reason:
            return reason
        at = passage.find(words, at + len(words))
    return None


def guarded(pairs: DataFrame, least: float = FUZZY) -> DataFrame:
    """``pairs`` (quote, passage, part) with their anchor's kind and the reason that refuses it.

    ``kind`` is null where the quote is not found, ``reason`` where nothing speaks against it; part may be null."""

    def guard(quote: str | None, passage: str | None, part: str | None) -> tuple[str | None, str | None]:
        found = locate_anchor(quote, passage, least)
        return (found[0], meaning_differs(quote, passage, found[1], found[2], part)) if found else (None, None)

    return pairs.withColumn("guard", of_row(guard, "kind string, reason string")("quote", "passage", "part"))


def covered(sentence: str, parts: Sequence[str]) -> tuple[list[tuple[int, int] | None], list[str]]:
    """The token range of each part in its sentence, and the words that no part holds.

    Parts are read in order, each after the last one found; spaces and case do not count. Connectives may be left out."""
    said = claim_tokens(sentence)
    keys, flat = [t.key for t in said], " ".join(sentence.split()).casefold()
    at, spans, free = 0, [], [True] * len(keys)
    for part in parts:
        wanted = [t.key for t in claim_tokens(part or "")]
        hit = None
        if wanted and " ".join(part.split()).casefold() in flat:
            hit = next((k for k in range(at, len(keys) - len(wanted) + 1) if keys[k] == wanted[0] and keys[k : k + len(wanted)] == wanted), None)
        spans.append(None if hit is None else (hit, hit + len(wanted)))
        if hit is not None:
            at = hit + len(wanted)
            free[hit:at] = [False] * len(wanted)
    return spans, [t.text for t, f in zip(said, free) if f and t.key not in CONNECTIVES]


def coverage(claims: DataFrame) -> DataFrame:
    """(claim, found, missing, left_out, whole) of ``claims`` (claim, sentence, parts): how many parts are in the sentence and how
    many are not, the words that no part holds, and whether the parts cover the sentence."""

    def cover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for claim, sentence, parts in zip(f["claim"], f["sentence"], f["parts"]):
                spans, left = covered(sentence or "", [] if parts is None else list(parts))
                missing = sum(s is None for s in spans)
                rows.append((claim, len(spans) - missing, missing, " ".join(left), not missing and not left))
            yield pd.DataFrame(rows, columns=["claim", "found", "missing", "left_out", "whole"])

    return claims.select("claim", "sentence", "parts").mapInPandas(cover, "claim long, found int, missing int, left_out string, whole boolean")

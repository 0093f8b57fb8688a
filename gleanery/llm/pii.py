"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the whole text: at-signs, ``://``, digits,
plus-digit pairs and identifier cues such as "IBAN" or "account". At each anchor a deterministic
local parser expands to the left and right, finds the boundaries and validates.

Kinds. Base: ``email``, ``ip``, ``card`` (Luhn), ``phone``. Added by the method, beside the base ones:
``account`` (a cue, then 6 to 20 digits in groups), ``iban`` (a cue, then a code that passes mod 97),
``login`` (user and password in a URL) and ``ssn`` (a cue, then 3-2-4 digits).

Defined results: offsets are code points, end exclusive; within a kind spans do not overlap; a null
or empty text has none; texts are read whole; repeated rows each get their own row; other columns are
ignored by ``pii_spans`` and kept by ``redact``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tune

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "iban", "login", "ssn")

#: Fixed cue words, each tried in lower, title and upper case.
ACCOUNT_CUES = ("account", "acct", "a/c", "konto", "kontonummer", "compte", "cuenta", "passport", "policy", "licence", "license")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AFTER_CUE = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|num\.?|#|:|is|=))*\s*", re.IGNORECASE)
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,19}(?![0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOGIN = re.compile(r"[^\s/@:?#]+:[^\s/@?#]+(?=@)")

_AT, _SCHEME, _PLUS, _DIGIT, _ACCOUNT_CUE, _IBAN_CUE, _SSN_CUE = range(7)


@functools.lru_cache(maxsize=1)
def automaton():
    """All anchors; a worker builds it once."""
    import ahocorasick

    found = ahocorasick.Automaton()
    anchors = [("@", _AT), ("://", _SCHEME)] + [(d, _DIGIT) for d in "0123456789"] + [("+" + d, _PLUS) for d in "0123456789"]
    for cues, kind in ((ACCOUNT_CUES, _ACCOUNT_CUE), (("iban",), _IBAN_CUE), (("ssn", "social security"), _SSN_CUE)):
        anchors += [(form, kind) for cue in cues for form in {cue, cue.title(), cue.capitalize(), cue.upper()}]
    for word, kind in anchors:
        found.add_word(word, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def _mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as in ``KINDS``, then start."""
    if not text:
        return []
    out: dict[str, list[tuple[int, int]]] = {}
    past = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, or what its parser has read
    seen = dict.fromkeys(KINDS, 0)

    def keep(kind: str, start: int, end: int, good: bool = True) -> None:
        past[kind] = end
        if good:
            out.setdefault(kind, []).append((start, end))

    for end, anchor in automaton().iter(text):
        if anchor == _DIGIT:
            if end >= past["card"]:
                if m := _CARD.match(text, end):
                    digits = m[0].replace(" ", "").replace("-", "")
                    keep("card", end, m.end(), 13 <= len(digits) <= 19 and luhn(digits))
                else:
                    past["card"] = end + 1
            if end >= past["ip"]:
                if m := _IP.match(text, end):
                    keep("ip", end, m.end(), all(map(_octet, m[0].split("."))))
                else:
                    past["ip"] = _DIGITS.match(text, end).end()
        elif anchor == _AT:
            start, low = end, past["email"]
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < end and (m := _DOMAIN.match(text, end + 1)):
                keep("email", start, m.end())
        elif anchor == _PLUS:
            if m := _PHONE.match(text, end - 1):
                keep("phone", end - 1, m.end(), 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15)
        elif anchor == _SCHEME:
            if (m := _LOGIN.match(text, end + 1)) and m.start() >= past["login"]:
                keep("login", m.start(), m.end())
        else:
            kind, form = {_ACCOUNT_CUE: ("account", _ACCOUNT), _IBAN_CUE: ("iban", _IBAN), _SSN_CUE: ("ssn", _SSN)}[anchor]
            at = _AFTER_CUE.match(text, end + 1).end()
            if at >= max(past[kind], seen[kind]) and (m := form.match(text, at)):
                keep(kind, at, m.end(), kind != "iban" or _mod97(m[0]))
            seen[kind] = max(seen[kind], at)
    return [(kind, a, b) for kind in KINDS for a, b in out.get(kind, ())]


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and spans, an array of (kind, start, end)."""
    tune(docs.sparkSession)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, spans array<struct<kind:string,start:long,end:long>>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(find, schema)


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; null stays null."""
    tune(docs.sparkSession)

    def cut(text: str | None) -> str | None:
        if not (spans := sorted((a, b, k) for k, a, b in find_spans(text) if k in kinds)):
            return text
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def cut_all(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, cut_all(F.col(text_col)))

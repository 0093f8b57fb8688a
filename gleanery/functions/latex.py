"""LaTeX text as plain Unicode, by a scanner with one pending accent: linear in the text, however deep its groups."""

from __future__ import annotations

import re
import unicodedata

# Accents by their sign or letter, letters and words by command, signs by their spelling.
ACCENTS = {
    '"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c",
    "H": "\u030b", "r": "\u030a", "c": "\u0327", "k": "\u0328", "d": "\u0323", "b": "\u0331",
}
LETTERS = {"ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "i": "ı", "j": "ȷ"}
WORDS = {
    "LaTeX": "LaTeX", "TeX": "TeX", "textendash": "–", "textemdash": "—", "ldots": "…", "dots": "…", "textquoteright": "’", "textquoteleft": "‘",
    "textquotedblleft": "“", "textquotedblright": "”", "textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^", "textregistered": "®",
    "texttrademark": "™", "textcopyright": "©", "textdegree": "°", "S": "§", "P": "¶",
}
SIGNS = {"---": "—", "--": "–", "``": "“", "''": "”", "~": " "}

_SCAN = re.compile(r"(?P<math>(?<!\\)\$[^$]*(?<!\\)\$)|\\(?P<word>[A-Za-z]+)\s*|\\(?P<sign>.)|(?P<group>[{}])|(?P<spelled>---|--|``|''|~)|(?P<text>[^\\{}$`'~-]+|.)", re.S)

_GAP = re.compile(r"[ \t\n\r\f\v]+")


def to_text(value: str | None) -> str:
    """Accents, letters and signs resolved, groups opened, ASCII white space to one space. Unknown commands vanish, what stands in their
    groups stays; math between unescaped dollar signs stays as written; an accent falls on the next letter."""
    out: list[str] = []
    mark = ""

    def put(text: str) -> None:
        nonlocal mark
        if mark and text:
            lead = len(text) - len(text.lstrip())
            if lead < len(text):
                base = {"ı": "i", "ȷ": "j"}.get(text[lead], text[lead])
                text = unicodedata.normalize("NFC", base + mark) + text[lead + 1 :] if base.isalpha() else text
                mark = ""
        out.append(text)

    for m in _SCAN.finditer(value or ""):
        kind, token = m.lastgroup, m[m.lastgroup]
        if kind == "math":
            out.append(token)
        elif kind == "word":
            if token in ACCENTS:
                mark = ACCENTS[token]
            else:
                put(LETTERS.get(token) or WORDS.get(token, ""))
        elif kind == "sign":
            if token in ACCENTS:
                mark = ACCENTS[token]
            else:
                put(" " if token in "\\ \n" else token if token in "&%$#_{}" else "")
        elif kind == "spelled":
            put(SIGNS[token])
        elif kind == "text":
            put(token)
    return " ".join(_GAP.split("".join(out).strip(" \t\n\r\f\v")))

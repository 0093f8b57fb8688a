"""BibTeX and RIS files as tables of entries, with a row for every entry that cannot be read; and tables as such files.

A folder of files is read by Spark's own reader, from any store, and files are parsed apart from each other, so neither how Spark
packs files into partitions nor how large these are can change a row. A file over ``most_bytes`` is refused with one error row and
its bytes are not read.

Columns: path, format, index (place among the file's entries), line, key, title, authors, year, venue, type, doi, url, abstract,
volume, issue, pages, fields (all fields as written), error and message (null in rows that were read).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.latex import to_text

#: Bytes of a file and characters of one value at most.
MOST_BYTES, MOST_CHARS = 64 << 20, 1_000_000

#: Files written hold at most two to this power bytes, or one entry.
FILE_BITS = 23

# Kinds of entries, fields that name a venue in order, months that are defined everywhere, kinds and tags of RIS.
BIBTEX_TYPES = {
    "article": "journalArticle", "inproceedings": "conferencePaper", "conference": "conferencePaper", "incollection": "bookSection", "inbook": "bookSection",
    "book": "book", "phdthesis": "thesis", "mastersthesis": "thesis", "thesis": "thesis", "techreport": "report", "report": "report",
}
BIBTEX_VENUES = ("journal", "journaltitle", "booktitle", "school", "institution", "publisher", "organization")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
RIS_TYPES = {
    "JOUR": "journalArticle", "JFULL": "journalArticle", "EJOUR": "journalArticle", "INPR": "journalArticle", "ABST": "journalArticle", "MGZN": "magazineArticle",
    "CONF": "conferencePaper", "CPAPER": "conferencePaper", "CHAP": "bookSection", "BOOK": "book", "EBOOK": "book", "EDBOOK": "book", "THES": "thesis", "RPRT": "report",
}
RIS_VENUES = ("T2", "JF", "JO", "JA", "J2", "BT", "PB")

SCHEMA = (
    "path string, format string, index int, line int, key string, title string, authors array<string>, year int, venue string, type string, doi string, url string, "
    "abstract string, volume string, issue string, pages string, fields map<string,string>, error string, message string"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

_HEAD = re.compile(r"(?<!\\)@\s*([A-Za-z]+)\s*([{(])")
_FIELD = re.compile(r"\s*([A-Za-z][\w\-:.+]*)\s*=\s*")
_WORD = re.compile(r"[A-Za-z_][\w\-:.+]*|\d+")
_BRACE = re.compile(r"\\.|[{}\"]", re.S)
_RIS_TAG = re.compile(r"^([A-Z][A-Z0-9]) {1,2}-(?: (.*))?$")
_RIS_START = re.compile(r"^TY {1,2}-", re.M)
_DOI = re.compile(r"10\.\d{4,9}/\S+")
_YEAR = re.compile(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)")


#: White space is ASCII's, as in TeX; other spaces and control signs belong to values.
_SPACE = " \t\n\r\f\v"


class Unreadable(Exception):
    """Why an entry cannot be read."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def decoded(data: bytes) -> str | None:
    """UTF-16 by its mark, else UTF-8, else Windows-1252; null for broken UTF-16 and for what holds a zero byte but is no UTF-8
    with entries."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        try:
            return data.decode("utf-16")
        except UnicodeDecodeError:
            return None
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return None if b"\0" in data else data.decode("cp1252", errors="replace")
    return None if "\0" in text and not (_HEAD.search(text) or _RIS_START.search(text)) else text


def format_of(name: str, text: str) -> str | None:
    """By the name's ending, else by how the text begins or an entry head anywhere."""
    ending = name.lower().rsplit(".", 1)[-1]
    if ending in ("bib", "bibtex", "ris"):
        return "ris" if ending == "ris" else "bibtex"
    return "ris" if text.lstrip().startswith("TY  -") else "bibtex" if _HEAD.search(text) else None


def _closing(text: str, at: int, quote: str = "") -> int:
    """Where the group or the quoted value opened just before ``at`` ends; -1 where it does not. A brace closed without being
    opened ends a quoted value wrongly."""
    depth = 0
    for m in _BRACE.finditer(text, at):
        sign = m[0]
        if sign == "{":
            depth += 1
        elif sign == "}":
            if not depth:
                if quote:
                    raise Unreadable("unbalanced_braces", "a field value closes a brace that it did not open")
                return m.start()
            depth -= 1
        elif sign == quote and not depth:
            return m.start()
    return -1


def _value(body: str, at: int, known: dict[str, str], last: bool) -> tuple[str, int]:
    """A field's value, its parts joined, and where it ends."""
    parts: list[str] = []
    while True:
        opening = body[at : at + 1]
        if opening in ("{", '"') and opening:
            end = _closing(body, at + 1, '"' if opening == '"' else "")
            if end < 0:
                raise Unreadable("unclosed_value", f"a field value is not closed before the {'end of the file' if last else 'next entry'}")
            parts.append(body[at + 1 : end])
            at = end + 1
        elif m := _WORD.match(body, at):
            if not m[0].isdigit() and m[0].lower() not in known:
                raise Unreadable("undefined_string", f"{m[0][:80]} is not defined")
            parts.append(m[0] if m[0].isdigit() else known[m[0].lower()])
            at = m.end()
        else:
            raise Unreadable("missing_value", "a field has no value")
        if sum(map(len, parts)) > MOST_CHARS:
            raise Unreadable("value_too_long", f"a field value is longer than {MOST_CHARS} characters")
        at += len(body[at:]) - len(body[at:].lstrip()) if body[at : at + 1].isspace() else 0
        if body[at : at + 1] != "#":
            return "".join(parts), at
        at = re.compile(r"\s*").match(body, at + 1).end()


def _fields(body: str, at: int, end_sign: str, known: dict[str, str], last: bool) -> dict[str, str]:
    """The fields of an entry's body up to the sign that closes it; of a repeated field the first."""
    found: dict[str, str] = {}
    while True:
        rest = re.compile(r"\s*").match(body, at).end()
        if body[rest : rest + 1] == end_sign:
            return found
        m = _FIELD.match(body, at)
        if not m:
            raise Unreadable("malformed_field", "a field has no name or no equals sign")
        value, at = _value(body, m.end(), known, last)
        found.setdefault(m[1].lower(), value)
        if body[at : at + 1] == ",":
            at += 1
        elif body[at : at + 1] != end_sign:
            raise Unreadable("unclosed_entry", "the entry is not closed")


def split_top(value: str, separator: str) -> list[str]:
    """``value`` cut at the separator (a pattern) wherever no group is open."""
    out, depth, start = [], 0, 0
    for m in re.finditer(rf"\\.|[{{}}]|{separator}", value, re.S | re.I):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif depth == 0 and m[0][0] != "\\":
            out.append(value[start : m.start()])
            start = m.end()
    return [*out, value[start:]]


def _flat(value: str) -> str:
    return " ".join(re.split(f"[{_SPACE}]+", value.strip(_SPACE)))


def person(parts: list[str], suffix_at: int) -> str:
    """A name given as last, first and maybe a suffix at ``suffix_at``, in reading order; one part as it is."""
    parts = [p.strip(_SPACE) for p in parts]
    if len(parts) < 3:
        return " ".join(reversed(parts)).strip(_SPACE)
    suffix = parts[1] if suffix_at == 1 else " ".join(parts[2:])
    first = " ".join(parts[2:]) if suffix_at == 1 else parts[1]
    return _flat(f"{first} {parts[0]} {suffix}")


def bibtex_authors(value: str) -> list[str]:
    """Names joined by "and" outside groups; a name that is one group stays as written, "others" is none."""
    out = []
    for name in split_top(_flat(value), " and "):
        name = name.strip(_SPACE)
        whole = name.startswith("{") and len(name) > 1 and _closing(name, 1) == len(name) - 1
        shown = to_text(name) if whole else person([to_text(p) for p in split_top(name, ",")], 1)
        if shown and name.lower() != "others":
            out.append(shown)
    return out


def _plain_link(value: str | None) -> str | None:
    """A DOI or address: escapes undone and grouping braces left out, nothing else changed."""
    return re.sub(r"\\([&%$#_{}~])|[{}]", lambda m: m[1] or "", value or "").strip() or None


def _doi(value: str | None, url: str | None) -> str | None:
    """The DOI of the field, else one that the address leads to; a field that holds none makes the entry unreadable."""
    if value and value.strip():
        doi = re.sub(r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "", value.strip(), flags=re.I).lower()
        if not _DOI.fullmatch(doi):
            raise Unreadable("invalid_doi", "the DOI field does not hold a DOI")
        return doi
    m = re.fullmatch(r"https?://(?:dx\.)?doi\.org/(10\.\S+)", (url or "").strip(), re.I)
    return m[1].lower() if m else None


def _year(*values: str | None) -> int | None:
    return next((int(m[1]) for v in values if v and (m := _YEAR.search(v))), None)


def _bibtex_row(key: str, kind: str, raw: dict[str, str]) -> dict[str, object]:
    text = {k: to_text(v) or None for k, v in raw.items() if k not in ("author", "doi", "url")}
    get = lambda *names: next((text[n] for n in names if text.get(n)), None)
    if not get("title"):
        raise Unreadable("no_title", "the entry has no title")
    url = _plain_link(raw.get("url"))
    pages = get("pages")
    return {
        "key": key, "title": get("title"), "authors": bibtex_authors(raw.get("author", "")), "year": _year(get("year"), get("date")), "venue": get(*BIBTEX_VENUES),
        "type": BIBTEX_TYPES.get(kind), "doi": _doi(_plain_link(raw.get("doi")), url), "url": url, "abstract": get("abstract"), "volume": get("volume"),
        "issue": get("number", "issue"), "pages": re.sub(r"\s*[–—]\s*", "-", pages) if pages else None, "fields": {"type": kind, "key": key, **raw},
    }


def bibtex(text: str) -> Iterator[dict[str, object]]:
    """A row for every entry of a file. The text is cut at entry heads first, but for those inside a comment or preamble, so that a
    broken entry ends where the next begins; strings hold for the entries behind them."""
    heads, free = [], 0
    for m in _HEAD.finditer(text):
        if m.start() < free:
            continue
        if m[1].lower() in ("comment", "preamble"):
            if m[2] == "{":
                end = _closing(text, m.end())
                free = end + 1 if end >= 0 else len(text) + 1
                if end < 0:
                    heads.append((m, "unclosed_comment"))
            continue
        heads.append((m, None))
    ends = [i for i, c in enumerate(text) if c == "\n"]
    known, index = {m: m.capitalize() for m in MONTHS}, 0
    for k, (m, broken) in enumerate(heads):
        kind, last = m[1].lower(), k + 1 == len(heads)
        body = text[m.end() : len(text) if last else heads[k + 1][0].start()]
        row: dict[str, object] = {"line": bisect_right(ends, m.start() - 1) + 1}
        end_sign = "}" if m[2] == "{" else ")"
        try:
            if broken:
                raise Unreadable(broken, f"@{kind} is not closed; the rest of the file belongs to it")
            if kind == "string":
                known |= _fields(body, 0, end_sign, known, last)
                continue
            index += 1
            row["index"] = index
            key = re.match(r"\s*([^\s,{}()=\"#%@]+)\s*,", body)
            if not key:
                raise Unreadable("missing_key", "the entry has no key")
            row["key"] = key[1]
            row |= _bibtex_row(key[1], kind, _fields(body, key.end(), end_sign, known, last))
        except Unreadable as e:
            row |= {"error": e.code, "message": str(e)}
        yield row


def _ris_row(tags: dict[str, list[str]]) -> dict[str, object]:
    get = lambda *names: next((v for n in names for v in tags.get(n, []) if v), None)
    if not get("TI", "T1", "CT"):
        raise Unreadable("no_title", "the record has no title")
    first, last = get("SP"), get("EP")
    return {
        "title": get("TI", "T1", "CT"), "authors": [person(a.split(","), 2) for a in tags.get("AU", []) + tags.get("A1", []) if a.strip()],
        "year": _year(get("PY", "Y1", "DA")), "venue": get(*RIS_VENUES), "type": RIS_TYPES.get((get("TY") or "").upper()), "doi": _doi(get("DO"), get("UR")),
        "url": get("UR"), "abstract": get("AB", "N2"), "volume": get("VL"), "issue": get("IS"),
        "pages": f"{first}-{last}" if first and last and "-" not in first else first, "fields": {t: "; ".join(v) for t, v in tags.items()},
    }


def ris(text: str) -> Iterator[dict[str, object]]:
    """A row for every record of a file, and one for every run of lines outside records."""
    record: list[tuple[str, str]] | None = None
    row: dict[str, object] = {}
    index, stray = 0, False

    def done(broken: str | None) -> dict[str, object]:
        tags: dict[str, list[str]] = {}
        for tag, value in record:
            tags.setdefault(tag, []).append(value.strip(_SPACE))
        row["key"] = tags.get("ID", [None])[0] or None
        try:
            if broken:
                raise Unreadable("unclosed_record", f"the record is not closed with ER{broken}")
            return row | _ris_row(tags)
        except Unreadable as e:
            return row | {"error": e.code, "message": str(e)}

    for number, line in enumerate(re.split(r"\r\n|\r|\n", text), 1):
        m = _RIS_TAG.match(line)
        if not m and not line.strip(_SPACE):
            continue
        if m and m[1] == "TY":
            if record is not None:
                yield done(" before the next TY")
            index += 1
            record, row, stray = [("TY", m[2] or "")], {"line": number, "index": index}, False
        elif record is None:
            if not stray:
                yield {"line": number, "error": "outside_record", "message": f"{m[1] if m else 'text'} stands outside a record"}
            stray = True
        elif not m:
            record[-1] = (record[-1][0], f"{record[-1][1]} {line.strip(_SPACE)}")
        elif m[1] == "ER":
            yield done(None)
            record = None
        else:
            record.append((m[1], m[2] or ""))
    if record is not None:
        yield done(" before the file ends")


def parsed(path: str, data: bytes) -> Iterator[dict[str, object]]:
    """The rows of one file."""
    text = decoded(data)
    kind = format_of(path, text) if text is not None else None
    if kind is None:
        code = "import_not_text" if text is None else "import_unknown_format"
        yield {"path": path, "error": code, "message": "the file is no readable text" if text is None else "the file is neither BibTeX nor RIS"}
        return
    for row in bibtex(text) if kind == "bibtex" else ris(text):
        yield {"path": path, "format": kind, **row}


#: Entries that leave a task's Python at once.
BATCH = 2000


def read_entries(spark: SparkSession, path: str, glob: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All entries and errors of the files under ``path``; ``glob`` filters their names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                rows = parsed(name, bytes(data))
                while some := list(islice(rows, BATCH)):
                    yield _frame(some)

    read = files.filter(F.col("length") <= most_bytes).select("path", "content").mapInPandas(parse, SCHEMA)
    over = files.filter(F.col("length") > most_bytes).select("path", F.lit("import_too_large").alias("error"), F.format_string("the file has %d bytes", "length").alias("message"))
    return read.unionByName(over, allowMissingColumns=True)


def _frame(rows: list[dict[str, object]]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="Int32" if c in ("index", "line", "year") else object) for c in _NAMES})


_SPECIAL = r"([\\{}&%$#_])"


def bibtex_text(key: Column, title: Column, authors: Column, year: Column, **fields: Column) -> Column:
    """An entry as BibTeX text, null fields left out; signs that LaTeX reads are escaped, braces and backslashes of values spelled out."""

    def safe(value: Column) -> Column:
        escaped = F.replace(F.regexp_replace(value, _SPECIAL, r"\\$1"), F.lit("\\\\"), F.lit("\\textbackslash{}"))
        escaped = F.replace(F.replace(escaped, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("@"), F.lit("{@}"))  # no entry begins in a value
        return F.regexp_replace(escaped, "([-`'])(?=\\1)", "$1{}")  # no dash and no quotation mark is made of two signs

    def name(value: Column) -> Column:
        return F.when(value.rlike(r"(?i),|\sand\s|^(?:and|others)$"), F.concat(F.lit("{"), safe(value), F.lit("}"))).otherwise(safe(value))

    own = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    lines = [own("title", safe(title)), own("author", F.array_join(F.transform(authors, name), " and ")), own("year", year.cast("string")), *[own(n, c if n in ("doi", "url") else safe(c)) for n, c in fields.items()]]
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), F.array_join(F.array_compact(F.array(*lines)), ",\n"), F.lit("\n}\n"))


def ris_text(key: Column, title: Column, authors: Column, year: Column, **tags: Column) -> Column:
    """A record as RIS text, null tags left out; line ends of values become spaces."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    own = lambda tag, c: F.when(c.isNotNull(), F.concat(F.lit(f"{tag}  - "), flat(c)))
    lines = [F.lit("TY  - JOUR"), own("ID", key), own("TI", title), own("PY", year.cast("string")), *[own(t, c) for t, c in tags.items()]]
    people = F.coalesce(F.transform(authors, lambda a: F.concat(F.lit("AU  - "), flat(a))), F.array())
    return F.concat(F.array_join(F.concat(F.array_compact(F.array(*lines)), people), "\n"), F.lit("\nER  - \n"))


def write_texts(entries: DataFrame, path: str) -> None:
    """A column of texts as files under ``path``, one entry after the other. Of the entries of about one size, each task writes as
    many to a file as stay within its bytes, however many rows a task has."""
    bits = F.length(F.bin(F.coalesce(F.octet_length("text"), F.lit(0)) + 1))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # of the row in its task
    placed = entries.toDF("text").select("text", bits.alias("bits"), place.alias("place"))
    file = F.concat_ws("-", "bits", F.expr(f"shiftright(place, greatest(0, {FILE_BITS} - bits))"))
    placed.select("text", file.alias("file")).write.partitionBy("file").text(path)

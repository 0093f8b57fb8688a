"""JATS articles as tables of blocks: one streaming pass over each file, with a stack of what is open and never a tree.

Files are read by Spark's own reader from any store and parsed apart from each other. Columns: path, block_no, kind (title, heading, paragraph, item,
formula, caption, row, note), level (of headings, 1 to 4), section (the ``SECTIONS`` innermost headings above, joined), text, error and message.

The title comes first, then abstracts (but graphical ones and teasers) under a heading of their own, then the body and floats that stand apart. Captions
follow the paragraph that holds their float; the cells of a table row are joined. What is not read: back matter, references, other front matter.

Defined results: a file that is no well-formed XML, declares an entity or is over ``most_bytes`` gives one error row; white space is one space; empty
blocks are left out; an article without any block gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file at most, and headings in the name of a section.
MOST_BYTES, SECTIONS = 64 << 20, 8
SCHEMA = "path string, block_no int, kind string, level int, section string, text string, error string, message string"

# Elements that are a paragraph, floats, their parts, and abstracts that are none.
PARAGRAPHS = {"p": "paragraph", "disp-quote": "paragraph", "statement": "paragraph", "def-list": "paragraph", "disp-formula": "formula"}
FLOATS = frozenset({"fig", "table-wrap"})
OTHER_ABSTRACTS = frozenset({"graphical", "teaser"})


class Refused(Exception):
    """Why a file is not read."""


class _Open:
    """A block that is being read: its kind and level, and its words so far."""

    def __init__(self, kind: str, level: int | None, section: str):
        self.kind, self.level, self.section, self.parts = kind, level, section, []


class Reader:
    """The handlers of one pass. ``stack`` holds the open elements, ``open`` the open blocks, ``later`` the blocks of floats that wait for
    the end of their paragraph."""

    def __init__(self):
        self.blocks: list[tuple[str, int | None, str, str]] = []
        self.title: str | None = None
        self.stack: list[str] = []
        self.open: list[tuple[int, _Open]] = []
        self.later: list[tuple[str, int | None, str, str]] = []
        self.heads: list[str] = []
        self.area, self.area_depth, self.depth = "", -1, 0
        self.cells: list[str] = []
        self.floats = 0

    def start(self, name: str, attrs: dict[str, str]) -> None:
        name = name.rsplit(":", 1)[-1]
        self.stack.append(name)
        at = len(self.stack)
        if not self.area:
            if name == "article-title" and self.title is None:
                self.open.append((at, _Open("title", None, "")))
            elif name in ("body", "floats-group") and at == 2:
                self.area, self.area_depth, self.depth = name, at, 1
            elif name == "abstract" and self.stack[1:2] == ["front"] and attrs.get("abstract-type") not in OTHER_ABSTRACTS:
                self.area, self.area_depth, self.depth = name, at, 2
                self.heads = ["Abstract"]
                self.blocks.append(("heading", 2, "", "Abstract"))
                self.open.append((at, _Open("paragraph", None, "Abstract")))  # an abstract may hold its text itself
            return
        if name == "sec":
            self.depth += 1
            self.heads.append("")
        elif name in FLOATS:
            self.floats += 1
        section = self._section()
        inside = self._kinds()
        if self.floats:
            if name in ("label", "caption") and "caption" not in inside:
                self.open.append((at, _Open("caption", None, section)))
            elif name == "tr":
                self.cells = []
            elif name in ("td", "th"):
                self.open.append((at, _Open("cell", None, section)))
            elif name == "table-wrap-foot":
                self.open.append((at, _Open("note", None, section)))
            return
        if name == "title" and not inside - {"loose"}:
            self.open.append((at, _Open("heading", min(self.depth + 1, 4), section)))
        elif name == "list-item" and "item" not in inside and "paragraph" not in inside:
            self.open.append((at, _Open("item", None, section)))
        elif name in PARAGRAPHS and not inside & {"paragraph", "item", "formula"}:
            self.open.append((at, _Open(PARAGRAPHS[name], None, section)))

    def _section(self) -> str:
        return " / ".join(h for h in self.heads[-SECTIONS:] if h)

    def _kinds(self) -> set[str]:
        """The kinds of the open blocks, apart from the abstract's own."""
        return {"loose" if at == self.area_depth else b.kind for at, b in self.open}

    def text(self, data: str) -> None:
        if self.open:
            self.open[-1][1].parts.append(data)

    def end(self, name: str) -> None:
        at = len(self.stack)
        name = self.stack.pop()
        if self.open and self.open[-1][0] == at:
            _, b = self.open.pop()
            words = " ".join("".join(b.parts).split())
            if b.kind == "title":
                self.title = words
            elif b.kind == "cell":
                self.cells.append(words)
            elif words:
                row = (b.kind, b.level, b.section, words)
                if b.kind == "heading" and self.heads and not self.heads[-1]:
                    self.heads[-1] = words
                if at == self.area_depth:  # an abstract's own text comes before its paragraphs, which it has none of
                    self.blocks.append(row)
                elif b.kind in ("caption", "note") and self.open:
                    self.later.append(row)
                else:
                    self.blocks.append(row)
        if name == "tr" and self.area and any(self.cells):
            row = ("row", None, self._section(), " | ".join(self.cells))
            (self.later if any(k for k, b in self.open if k != self.area_depth) else self.blocks).append(row)
            self.cells = []
        if name in FLOATS and self.area:
            self.floats -= 1
        if self.later and not any(k for k, _ in self.open if k != self.area_depth):
            self.blocks += self.later
            self.later = []
        if name == "sec" and self.area:
            self.depth -= 1
            self.heads.pop()
        if self.area and at == self.area_depth:
            self.area, self.area_depth, self.depth, self.heads = "", -1, 0, []


def blocks_of(data: bytes) -> list[tuple[str, int | None, str, str]]:
    """(kind, level, section, text) of an article, the title first."""
    reader = Reader()
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def refuse(*_: object) -> None:
        raise Refused("the file declares an entity")

    parser.EntityDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.text
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise Refused(str(e)) from None
    return ([("title", 1, "", reader.title)] if reader.title else []) + reader.blocks


#: Blocks that leave a task's Python at once, or those of one article where it has more.
BATCH = 2000


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"block_no": "Int32", "level": "Int32"})


def parse_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``SCHEMA`` for rows of path and content."""
    for f in frames:
        rows: list[tuple] = []
        for name, data in zip(f["path"], f["content"]):
            if len(rows) >= BATCH:  # a batch of articles may hold many times as many blocks
                yield _frame(rows)
                rows = []
            try:
                rows += [(name, k, *b, None, None) for k, b in enumerate(blocks_of(bytes(data)))]
            except Refused as e:
                rows.append((name, None, None, None, None, None, "unreadable", str(e)))
        yield _frame(rows)


def read_articles(spark: SparkSession, path: str, glob: str = "*.xml", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The blocks of all files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    read = files.filter(F.col("length") <= most_bytes).select("path", "content").mapInPandas(parse_rows, SCHEMA)
    over = files.filter(F.col("length") > most_bytes).select("path", F.lit("too_large").alias("error"), F.format_string("the file has %d bytes", "length").alias("message"))
    return read.unionByName(over, allowMissingColumns=True)

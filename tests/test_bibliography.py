"""BibTeX, RIS and LaTeX against entries written by hand, and tables there and back."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gleanery.functions.latex import ACCENTS, to_text
from gleanery.sources import bibliography as B

BIB = r"""Notes above the entries are no entry. ab@example.org
@string{jbr = "Journal of " # {Bridges}}
@article{lee:2001, title = {A {Study} of \"{O}l and \'etude \& caf\'e}, author = "Lee, Jr, Ann and {The Weir Group} and others",
  journal = jbr, year = 2001, month = may, pages = {10 -- 20}, doi = {https://doi.org/10.1234/AB\_c}, title = {ignored}}
@Book(noord, title = "Quotes {"} inside", author = {van der Noord, Jan}, publisher = {X \TeX{} Y}, year = {c. 1999})
@comment{ @article{hidden, title = {Not read}} }
@article{broken, title = {never closed, year = 2000
@misc{next, title = {Read on}, url = {http://dx.doi.org/10.55555/xyz}} trailing words @misc{inline, title = {Same line}}
@misc{, title = {No key}}
@misc{nofield, title}
@misc{novalue, title = }
@misc{undefined, title = nosuch}
@misc{quote, title = "a } b"}
@misc{notitle, year = 2000}
@misc{baddoi, title = {T}, doi = {none}}
@misc{unclosed, title = {T} year = 3}
@misc{mail, title = {Write to
@home or \@article{x} today}}
"""

RIS = """stray words
more
TY  - JOUR
ID  - one
TI  - A title that
  goes on
AU  - Lee, Ann, Jr
A1  - Group
PY  - 2004/05/06
T2  - Journal
SP  - 10
EP  - 20
DO  - 10.1234/x
ER  -\x20

TY - THES
T1  - Second
TY  - BOOK
TI  - Third
KW  - a
KW  - b
ER  - 
KW  - outside
TY  - CONF
ER  - 
TY  - CONF
TI  - x
DO  - bad
ER  - 
TY  - CONF
TI  - open"""


def test_bibtex_entries():
    rows = list(B.bibtex(BIB))
    by = {r.get("key"): r for r in rows}
    lee = by["lee:2001"]
    assert (lee["title"], lee["authors"], lee["venue"], lee["year"], lee["pages"], lee["doi"], lee["type"]) == ("A Study of Öl and étude & café", ["Ann Lee Jr", "The Weir Group"], "Journal of Bridges", 2001, "10-20", "10.1234/ab_c", "journalArticle")
    assert lee["fields"]["month"] == "May" and lee["line"] == 3 and lee["index"] == 1
    assert (by["noord"]["title"], by["noord"]["authors"], by["noord"]["venue"], by["noord"]["year"]) == ('Quotes " inside', ["Jan van der Noord"], "X TeX Y", 1999)
    assert "hidden" not in by and by["next"]["doi"] == "10.55555/xyz" and by["inline"]["title"] == "Same line"
    assert by["mail"]["title"] == "Write to @home or articlex today"
    errors = {r.get("key"): r["error"] for r in rows if r.get("error")}
    assert errors == {
        "broken": "unclosed_value", None: "missing_key", "nofield": "malformed_field", "novalue": "missing_value", "undefined": "undefined_string",
        "quote": "unbalanced_braces", "notitle": "no_title", "baddoi": "invalid_doi", "unclosed": "unclosed_entry",
    }
    assert [r["index"] for r in rows] == list(range(1, len(rows) + 1))
    assert [(r["line"], r.get("error")) for r in B.bibtex("@misc{a, title={x}}\n@comment{ open @misc{b, title={y}}")] == [(1, None), (2, "unclosed_comment")]
    assert list(B.bibtex("")) == [] and list(B.bibtex("no entries @ all")) == []


def test_ris_records():
    rows = list(B.ris(RIS))
    first = rows[1]
    assert (rows[0]["error"], rows[0]["line"]) == ("outside_record", 1)
    assert (first["key"], first["title"], first["authors"], first["year"], first["venue"], first["pages"], first["doi"], first["line"]) == ("one", "A title that goes on", ["Ann Lee Jr", "Group"], 2004, "Journal", "10-20", "10.1234/x", 3)
    assert [(r.get("index"), r.get("error")) for r in rows] == [(None, "outside_record"), (1, None), (2, "unclosed_record"), (3, None), (None, "outside_record"), (4, "no_title"), (5, "invalid_doi"), (6, "unclosed_record")]
    assert rows[3]["fields"]["KW"] == "a; b" and list(B.ris(RIS.replace("\n", "\r\n"))) == rows and list(B.ris("")) == []


@pytest.mark.parametrize(
    "latex,text",
    [
        (r"G{\"o}del, G\"odel, G\"{o}del, G{\"{o}}del", "Gödel, Gödel, Gödel, Gödel"),
        (r"\c{c}\v{s}\v z\H{o}\r{a}\'{\i}\'\i", "çšžőåíí"),
        (r"\ss{} \O{}re \ae{} \L\'od\'z", "ß Øre æ Łódź"),
        (r"a -- b --- c ``d'' e~f \& 5\% \_ \{x\}", "a – b — c “d” e f & 5% _ {x}"),
        (r"\emph{kept {words}} \unknown{too}", "kept words too"),
        (r"cost $x_{1}^2$ and \$5", "cost $x_{1}^2$ and $5"),
        ("two\n  lines \\\\ more", "two lines more"),
        (None, ""),
    ],
)
def test_latex(latex, text):
    assert to_text(latex) == text


def test_accents_survive_the_round_trip_and_depth_is_linear():
    import unicodedata

    for command, mark in ACCENTS.items():
        for letter in "aeoucszn":
            assert to_text(f"\\{command}{{{letter}}}") == unicodedata.normalize("NFC", letter + mark)
    began = time.perf_counter()
    assert to_text("{" * 20_000 + r"\"o" + "}" * 20_000) == "ö"
    assert len(list(B.bibtex("@misc{a, title = {" + "{" * 20_000 + "x" + "}" * 20_000 + "}}"))) == 1
    assert len(list(B.bibtex("@misc{a, title = {" * 5_000))) == 5_000
    assert time.perf_counter() - began < 5


def test_any_partition_size_gives_the_same_rows(spark, tmp_path):
    rng = random.Random(1)
    for i in range(12):
        (tmp_path / f"f{i}.bib").write_text(BIB * rng.randrange(1, 4), "utf-8")
    (tmp_path / "r.ris").write_bytes(RIS.encode("utf-16"))
    (tmp_path / "latin.bib").write_bytes("@misc{l, title = {Café}}".encode("cp1252"))
    (tmp_path / "unknown").write_text("TY  - JOUR\nTI  - Sniffed\nER  - \n")
    (tmp_path / "plain.txt").write_text("nothing here")
    (tmp_path / "binary.bib").write_bytes(b"\0\1\2")
    (tmp_path / "huge.bib").write_text("@misc{h, title = {x}}" + " " * 40_000)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for size in ("1k", "4k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append(sorted(map(repr, B.read_entries(spark, str(tmp_path), most_bytes=20_000).collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert found[0] == found[1] == found[2]
    rows = B.read_entries(spark, str(tmp_path), most_bytes=20_000).collect()
    last = {r["path"].rsplit("/", 1)[1]: r for r in rows}
    assert (last["latin.bib"]["title"], last["unknown"]["title"], last["plain.txt"]["error"], last["binary.bib"]["error"], last["huge.bib"]["error"]) == ("Café", "Sniffed", "import_unknown_format", "import_not_text", "import_too_large")
    assert sum(r["path"].endswith("r.ris") for r in rows) == 8


def test_tables_there_and_back(spark, tmp_path):
    titles = ["Plain", "50% of {braces} & more_", "back\\slash ~ tilde", "Ünïcode — dash", "$ 5 # 6", "a--b ``c'' d --- e"]
    df = spark.createDataFrame([(f"k{i}", t, ["Ann Lee", "Bo Ek"], 1990 + i, f"10.1234/x_{i}") for i, t in enumerate(titles)], "key string, title string, authors array<string>, year int, doi string")
    B.write_texts(df.select(B.bibtex_text(F.col("key"), F.col("title"), F.col("authors"), F.col("year"), doi=F.col("doi"))), str(tmp_path / "bib"))
    B.write_texts(df.select(B.ris_text(F.col("key"), F.col("title"), F.col("authors"), F.col("year"), DO=F.col("doi"))), str(tmp_path / "ris"))
    for folder in ("bib", "ris"):
        back = B.read_entries(spark, str(tmp_path / folder), glob="*.txt").orderBy("key").select("key", "title", "authors", "year", "doi", "error")
        assert [tuple(r) for r in back.collect()] == [(*tuple(r), None) for r in df.collect()]


def test_more_entries_than_a_batch_come_whole(spark, tmp_path):
    from gleanery.sources import bibliography

    n = 2 * bibliography.BATCH + 1
    (tmp_path / "many.ris").write_text("".join(f"TY  - JOUR\nID  - r{i}\nTI  - Title {i}\nER  - \n" for i in range(n)))
    found = bibliography.read_entries(spark, str(tmp_path))
    assert (found.count(), found.select("key").distinct().count()) == (n, n)


def _entries_sql(tmp_path, rows):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    from gleanery.plans import bibliography_queries as Q

    return sorted(map(repr, con.execute(f"SELECT {rows} FROM ({Q._ENTRIES_SQL})").fetchall()))


@pytest.mark.parametrize("name", ["a14_bibtex_entries", "a15_ris_records"])
def test_rows_of_one_task_come_whole_whatever_their_titles(spark, tmp_path, monkeypatch, name):
    from gleanery.plans import bibliography_queries as Q

    odd = ["", None, " \n", "a zero\0byte", "mail me@host (home) now", "@string(a = b", "a @b{", "\x01 \x02 \x03", "\\{} \\\\ {\\}", "\xa0nbsp\xa0 　wide", "\x1cx\x1f y\x85", "TY  - JOUR", "ER  - x"]
    texts = odd + [f"title of record {i}" for i in range(300)] + ["long" * 500]
    rows = [(i, t, "en", None if i == 20 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    # files may hold 8 KB, all rows of a task more than that
    monkeypatch.setattr(B, "FILE_BITS", 12)
    monkeypatch.setattr(B.read_entries, "__defaults__", (None, 8 << 10))
    columns = ["key", "title", "authors", "year", "doi", "type", "error"]
    found = getattr(Q, name)(spark, str(tmp_path)).select(columns)
    assert sorted(repr(tuple(r)) for r in found.collect()) == _entries_sql(tmp_path, ", ".join(columns))


def test_files_hold_a_task_s_entries_by_their_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "FILE_BITS", 12)
    sizes = [10, 200, 4000, 60, 9000] * 40
    B.write_texts(spark.createDataFrame([("x" * n,) for n in sizes], "t string").coalesce(1), str(tmp_path / "out"))
    written = [f.stat().st_size for f in (tmp_path / "out").rglob("*.txt")]
    assert sum(written) == sum(sizes) + len(sizes)
    assert all(n <= 1 << 12 or n == 9001 for n in written) and len(written) < len(sizes)


def test_names_with_commas_and_links_come_back(spark, tmp_path):
    names = ["Ann Lee, Inc. {x}", "Lee and Sons", "others", "Bo_Ek", "and"]
    df = spark.createDataFrame([("k", "T", names, 2000)], "key string, title string, authors array<string>, year int")
    B.write_texts(df.select(B.bibtex_text(F.col("key"), F.col("title"), F.col("authors"), F.col("year"))), str(tmp_path / "bib"))
    assert B.read_entries(spark, str(tmp_path / "bib"), glob="*.txt").first()["authors"] == names

"""JATS articles written by hand."""

import time

import pytest

from gleanery.sources import jats

XML = """<?xml version="1.0"?><article xmlns:xlink="http://www.w3.org/1999/xlink"><front><journal-meta><journal-title>J</journal-title></journal-meta>
<article-meta><title-group><article-title>On <italic>river</italic>
 ice</article-title></title-group><abstract><p>Ice &amp; snow.</p><sec><title>Aim</title><p>To see.</p></sec></abstract><abstract abstract-type="graphical"><p>no</p></abstract></article-meta></front>
<body><sec><title>Methods</title><p>We walked.<fig><label>Fig 1</label><caption><title>Map</title><p>The bank.</p></caption></fig> Then we ran.</p>
<sec><title>Tools</title><list><list-item><p>saw</p></list-item><list-item><p>rope <list><list-item><p>long</p></list-item></list></p></list-item></list><disp-formula>a = b</disp-formula></sec></sec>
<sec><title>Results</title><table-wrap><label>T1</label><caption><p>Depths</p></caption><table><tr><th>site</th><th>m</th></tr><tr><td>A</td><td/></tr><tr><td/><td/></tr></table><table-wrap-foot><p>by hand</p></table-wrap-foot></table-wrap><p> </p><p>All froze.</p></sec></body>
<back><sec><title>Thanks</title><p>not read</p></sec></back></article>"""

WANT = [
    ("title", 1, "", "On river ice"),
    ("heading", 2, "", "Abstract"),
    ("paragraph", None, "Abstract", "Ice & snow."),
    ("heading", 4, "Abstract", "Aim"),
    ("paragraph", None, "Abstract / Aim", "To see."),
    ("heading", 3, "", "Methods"),
    ("paragraph", None, "Methods", "We walked. Then we ran."),
    ("caption", None, "Methods", "Fig 1"),
    ("caption", None, "Methods", "MapThe bank."),
    ("heading", 4, "Methods", "Tools"),
    ("item", None, "Methods / Tools", "saw"),
    ("item", None, "Methods / Tools", "rope long"),
    ("formula", None, "Methods / Tools", "a = b"),
    ("heading", 3, "", "Results"),
    ("caption", None, "Results", "T1"),
    ("caption", None, "Results", "Depths"),
    ("row", None, "Results", "site | m"),
    ("row", None, "Results", "A | "),
    ("note", None, "Results", "by hand"),
    ("paragraph", None, "Results", "All froze."),
]


def test_blocks_in_reading_order():
    assert jats.blocks_of(XML.encode()) == WANT


def test_an_abstract_may_hold_its_text_itself():
    found = jats.blocks_of(b"<article><front><abstract>Only words.</abstract></front></article>")
    assert found == [("heading", 2, "", "Abstract"), ("paragraph", None, "Abstract", "Only words.")]


@pytest.mark.parametrize("data", [b"", b"<a>", b"no xml", b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'])
def test_refused(data):
    with pytest.raises(jats.Refused):
        jats.blocks_of(data)


def test_deep_and_long_articles_take_linear_time():
    began = time.perf_counter()
    deep = "<article><body>" + "<sec><title>t</title>" * 20_000 + "<p>x</p>" + "</sec>" * 20_000 + "</body></article>"
    found = jats.blocks_of(deep.encode())
    assert len(found) == 20_001 and found[-1] == ("paragraph", None, " / ".join("t" * jats.SECTIONS), "x")
    long = "<article><body>" + "<p>some words</p>" * 50_000 + "</body></article>"
    assert len(jats.blocks_of(long.encode())) == 50_000
    nested = "<article><body><p>" + "<b>" * 20_000 + "x" + "</b>" * 20_000 + "</p></body></article>"
    assert jats.blocks_of(nested.encode()) == [("paragraph", None, "", "x")]
    assert time.perf_counter() - began < 5


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.xml").write_text("<a>")
    (tmp_path / "c.xml").write_text("<article/>" + " " * 9000)
    rows = jats.read_articles(spark, str(tmp_path), most_bytes=8000).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert [(r["kind"], r["level"], r["section"], r["text"]) for r in sorted(by["a.xml"], key=lambda r: r["block_no"])] == WANT
    assert by["b.xml"][0]["error"] == "unreadable" and by["c.xml"][0]["error"] == "too_large"


def test_blocks_leave_in_bounded_frames():
    import pandas as pd

    from gleanery.sources import jats

    article = b"<article><body><sec><title>T</title>" + b"<p>word</p>" * 99 + b"</sec></body></article>"
    frames = list(jats.parse_rows(iter([pd.DataFrame({"path": [str(i) for i in range(200)], "content": [article] * 200})])))
    assert sum(map(len, frames)) == 200 * 100 and max(map(len, frames)) < 2200

import random
import time

import numpy as np

from gleanery.llm import html_text as H
from tests.llm.helpers import rows_of


def test_blocks_paths_and_text():
    page = "<html><head><title>no</title></head><body><nav><a href=x>Home</a></nav><!-- c --><script>var a='</p>'</script><article><h1>T&amp;t</h1><p>one\n <b>two<br>three<p>four</article>tail"
    got = [(b.text, b.tag) for b in H.blocks_of(page)]
    assert got == [("Home", "nav"), ("T&t", "h1"), ("one two three", "p"), ("four", "p"), ("tail", "body")]
    assert H.blocks_of(page)[0].linked == 1.0 and "article" in H.blocks_of(page)[2].path
    assert H.blocks_of(None) == H.blocks_of("") == []


def test_scanner_takes_any_input_in_linear_time():
    rng = random.Random(1)
    parts = ["<", ">", "</", "<p", "<a href='", '"', "<!--", "-->", "<![CDATA[", "]]>", "<script>", "</script>", "x ", "&amp;", "&#x110000;", "<li>", "</ul>", "<td>", "\x00"]
    for _ in range(2000):
        H.blocks_of("".join(rng.choice(parts) for _ in range(rng.randrange(40))))
    began = time.time()
    for bad in ("<" * 100_000, "<a '" * 20_000, "<p>" * 5_000, "<!--" * 20_000, "&" * 100_000):
        H.blocks_of(bad)
    assert time.time() - began < 60


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    model = H.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = rng.normal(size=(3, 4, H.INPUT)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], float)
    y = (rng.random((3, 4)) < 0.5).astype(float)
    _, grad = model.gradients(x, mask, y)
    for name in ("Wf", "Ub", "cf", "V", "Uf", "cb"):
        at = tuple(rng.integers(0, n) for n in model.p[name].shape)
        kept, step = model.p[name][at], 1e-3
        losses = []
        for d in (step, -step):
            model.p[name][at] = kept + d
            losses.append(model.gradients(x, mask, y)[0])
        model.p[name][at] = kept
        assert abs((losses[0] - losses[1]) / (2 * step) - grad[name][at]) < 2e-3


def test_held_out_invented_pages():
    model, rng, right, total = H.trained(), np.random.default_rng(1234), 0, 0
    for _ in range(150):
        blocks = H.blocks_of(H.invent_page(rng))
        y = np.array([b.text.count("\ue000") > b.text.count("\ue001") for b in blocks])
        for b in blocks:
            b.text = b.text.replace("\ue000", "").replace("\ue001", "") or "-"
        right, total = right + int(((model.label([blocks])[0] >= 0.5) == y).sum()), total + len(y)
    assert right / total > 0.985


def test_table(spark):
    page = '<html><body><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Title here</h1><p>First &eacute; paragraph.</p><p>Second one, longer.</p></article><footer>&copy; x</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (1, "u", page), (4, "u", "<nav><a href=x>only menu</a></nav>")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, text string, n_blocks int")
    found = sorted((r["page_id"], r["url"], r["text"]) for r in rows_of(H.main_text(df)) if r["page_id"] != 3)
    text = "Title here\nFirst é paragraph.\nSecond one, longer."
    assert found == [(1, "u", text), (1, "u", text), (2, "u", ""), (4, "u", "")]
    assert rows_of(H.main_text(df.limit(0))) == []


def well_formed(rng):
    """A page that XML can read, and so an extraction that shares no code with the scanner."""
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvz") for _ in range(rng.randrange(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    prose = lambda: " ".join(words(4, 14).capitalize() + "." for _ in range(rng.randrange(1, 6)))
    link = lambda: f'<li><a href="/{word()}">{words(1, 3)}</a></li>'
    nav = f"<nav><ul>{''.join(link() for _ in range(rng.randrange(2, 7)))}</ul></nav>"
    body = f"<h1>{words(2, 7).capitalize()}</h1>" + "".join(rng.choice([f"<p>{prose()}</p>", f"<p>{prose()} <b>{word()}</b> {words(1, 5)}.</p>", f"<ul><li>{prose()}</li><li>{prose()}</li></ul>"]) for _ in range(rng.randrange(2, 9)))
    after = rng.choice(["", f'<aside class="sidebar"><h3>{words(1, 3)}</h3><ul>{link()}{link()}</ul></aside>', f'<div class="comments"><div class="comment"><p>{prose()}</p></div></div>'])
    return f'<html><head><title>{word()}</title></head><body>{nav}<div class="ad">{prose()}</div><article>{body}</article>{after}<footer>{words(2, 6)}</footer></body></html>'


def test_equals_an_xml_walk_on_well_formed_pages(spark):
    from xml.etree import ElementTree

    rng = random.Random(77)
    pages = [well_formed(rng) for _ in range(200)]
    want = []
    for p in pages:
        leaves = [e for e in ElementTree.fromstring(p).find("body/article").iter() if e.tag in ("h1", "p", "li")]
        want.append("\n".join(" ".join("".join(e.itertext()).split()) for e in leaves))
    found = {r["page_id"]: r["text"] for r in rows_of(H.main_text(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), extra=()))}
    assert sum(found[i] == w for i, w in enumerate(want)) >= 196


def test_every_word_of_a_long_block_counts():
    words = [f"w{i}" for i in range(100)]
    one, two = (H.features(H.blocks_of(f"<p>{' '.join(words[:30] + middle + words[70:])}</p>")) for middle in (words[30:70], ["cookie"] * 40))
    assert not np.array_equal(one[:, H.PATH_DIM : H.PATH_DIM + H.WORD_DIM], two[:, H.PATH_DIM : H.PATH_DIM + H.WORD_DIM])


def test_deep_pages_take_linear_time():
    began = time.time()
    assert len(H.blocks_of("<div>x" * 20_000)) == 20_000
    assert len(H.blocks_of("<b>" * 20_000 + "<p>x" * 20_000)) == 20_000
    assert H.blocks_of("<span>" * 20_000 + "</i>" * 20_000) == []
    assert time.time() - began < 5

"""Markers, claims and their resolution on drafts written by hand."""

import time

import pytest

from gleanery.operators import drafts as D

CASES = [
    ("Shown before [3].", [("numeric", ["3"])]),
    ("Shown [3, 5-7; 9] and [2], [4] and [6]–[8].", [("numeric", ["3", "5", "6", "7", "9"]), ("numeric", ["2", "4"]), ("numeric", ["6", "7", "8"])]),
    ("Odd [7-3], [0], [1-200], [3-5]–[9] and [a1] or [word] but [two words] and [sic] [...].", [("numeric", [])] * 3),
    ("A [link](x), a [def]: and [^1] are none, [12345] is unread.", [("numeric", [])]),
    ("As Lee et al. (2001) say, while Kim and Noor (1999a, 2000) and Ek (2003) differ.", [("author_year", ["Lee et al., 2001"]), ("author_year", ["Kim, Noor, 1999a", "Kim, Noor, 2000"]), ("author_year", [])]),
    ("(Lee, 2001; see Van den Berg & Kim 2002b, p. 4)", [("author_year", ["Lee, 2001", "Van den Berg, Kim, 2002b"])]),
    ("(Lee and others, 2001; no year)", [("author_year", [])]),
    ("It rose (2001) in town and (about 40 mm) fell, (in 2003) too.", []),
    ("Both Smith and Van Berg (2004), then Old Smith (2005).", [("author_year", ["Smith, Van Berg, 2004"]), ("author_year", [])]),
    (r"Text \cite{a, b}, \citep[see][p.~3]{c:1} and \citet*{} with \cite@x.", [("latex", ["a", "b"]), ("latex", ["c:1"]), ("latex", [])]),
    (r"Over \citep{k (Lee, 2001)} only one.", [("latex", [])]),
    ("", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_markers(text, want):
    got = [(m.style, [t.value for t in m.targets]) for m in D.find_markers(text)]
    assert got == want


def test_brackets_are_no_markers_in_latex():
    assert [m.style for m in D.find_markers(r"a [3] \cite{k}", latex=True)] == ["latex"]


def test_reference_lists_are_cut():
    body, entries = D.cut_references("Body [1].\n\n## References\n[1] Lee, A. Title. 2001\n  more\n[2] Kim. 2002\n")
    assert body.strip() == "Body [1]." and entries == [(1, None, 1, "Lee, A. Title. 2001 more"), (2, None, 2, "Kim. 2002")]
    body, entries = D.cut_references("Text\nReferences:\n- Lee 2001\n\n2. Kim 2002")
    assert [e[3] for e in entries] == ["Lee 2001", "Kim 2002"]
    body, entries = D.cut_references("T\n\\begin{thebibliography}{9}\\bibitem{a} Lee 2001 \\bibitem[x]{b} Kim\n 2002\\end{thebibliography} after")
    assert [(e[1], e[3]) for e in entries] == [("a", "Lee 2001"), ("b", "Kim 2002")] and body.endswith(" after")
    assert D.cut_references("none") == ("none", [])


def test_markers_lie_in_their_sentences_and_claims_lose_them(spark):
    text = "Rain fell (Lee et al., 2001). Rivers rose [2], as Kim (1999) said. Dr. No left.\n\nReferences\n[1] x 2000\n"
    rows = D.markers(spark.createDataFrame([(1, text, False), (2, None, False), (3, r"Snow \emph{fell} \cite{a}. End", True)], "draft_id long, text string, latex boolean")).orderBy("draft_id", "marker_no").collect()
    assert [(r["draft_id"], text[r["sentence_start"] : r["sentence_end"]] if r["draft_id"] == 1 else "", r["claim"], r["status"]) for r in rows] == [
        (1, "Rain fell (Lee et al., 2001).", "Rain fell.", "recognized"),
        (1, "Rivers rose [2], as Kim (1999) said.", "Rivers rose, as said.", "recognized"),
        (1, "Rivers rose [2], as Kim (1999) said.", "Rivers rose, as said.", "recognized"),
        (3, "", "Snow fell.", "recognized"),
    ]
    assert rows[0]["targets"][0].asDict() == {"kind": "author_year", "value": "Lee et al., 2001", "names": ["Lee"], "et_al": True, "year": 2001, "suffix": None}
    refs = D.references(spark.createDataFrame([(1, text, False)], "draft_id long, text string, latex boolean")).collect()
    assert [tuple(r) for r in refs] == [(1, 1, None, 1, "x 2000")]


def test_resolution(spark):
    text = r"A [1], [2], [9], \cite{k}, \cite{none}. (Lee, 2001) (Lee et al., 2002) (Kim, 2003) (Kim, 2003a) (Noor, 2004) (Ek & Lee, 2005) (Lee et al., 2006)."
    entries = [
        (1, 1, None, 1, 2001, None, ["Lee"]), (1, 2, None, 2, 2002, None, ["Lee", "Kim", "Ek"]), (1, 3, "k", 2, 2003, "a", ["kim"]), (1, 4, "q", None, 2003, "b", ["Kim"]),
        (1, 5, None, None, 2004, None, ["Noor"]), (1, 6, None, None, 2004, None, None), (1, 7, None, None, 2005, None, ["Lee", "Ek"]), (1, 8, None, None, 2006, None, ["Lee", "Kim"]), (2, 1, "none", 9, 2001, None, ["Lee"]),
    ]
    found = D.markers(spark.createDataFrame([(1, text, False)], "draft_id long, text string, latex boolean"))
    e = spark.createDataFrame(entries, "draft_id long, ordinal int, key string, number int, year int, suffix string, surnames array<string>")
    got = {r["value"]: (r["ordinal"], r["status"]) for r in D.resolve(found, e).collect()}
    assert got == {
        "1": (1, "planned"), "2": (None, "ambiguous"), "9": (None, "unresolved"), "k": (3, "planned"), "none": (None, "unresolved"), "Lee, 2001": (1, "planned"),
        "Lee et al., 2002": (2, "planned"), "Kim, 2003": (None, "ambiguous"), "Kim, 2003a": (3, "planned"), "Noor, 2004": (None, "ambiguous"),
        "Ek, Lee, 2005": (None, "ambiguous"), "Lee et al., 2006": (None, "ambiguous"),
    }


def test_long_drafts_take_linear_time():
    began = time.perf_counter()
    assert len(D.find_markers("Words and words [3] then Lee (2001) and (Kim, 2002). " * 4000)) == 12_000
    assert D.find_markers("[" * 50_000 + "(" * 50_000) == []
    assert time.perf_counter() - began < 8

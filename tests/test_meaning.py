"""The meaning guard and the coverage of sentences, on cases written by hand."""

import random

import pytest

from gleanery.operators import evidence as E
from gleanery.operators import meaning as M
from gleanery.operators.evidence import locate_anchor

PAGE = (
    "The dam held 12.5 m of water in May. Wind from the north kept levels higher than in 1988 and the gate closed at 40 %. "
    "Pumps ran for 3 h per day, with and without the new filter, and not only at night. "
    + "Stones were sorted by size and colour on the long bench near the mill. " * 5
    + "Flow did not drop below -4 kW at any point. "
    + "Ropes and planks were kept dry in the loft until the autumn fair came round again. " * 5
    + "Salt reached 5 mW/cm2 where x >= 7 and the improve-\nment lasted. [symbols not readable in the PDF] closed the list."
)

CASES = [
    ("The dam held 12.5 m of water in May.", None, None),
    ("the dam held 12.5 m of water in May", None, None),
    ("The dam held 12,5 m of water in May.", None, "number"),
    ("The dam held 125 m of water in May.", None, "number"),
    ("The dam held 12.5 M of water in May.", None, "unit"),
    ("dam held 12.5", None, "context"),
    ("kept levels higher than in 1988", None, "context"),  # the next word might be its unit
    ("kept levels higher than in 1988 and the gate closed at 40", None, "context"),
    ("kept levels higher than in 1988 and the gate closed at 40 %", None, None),
    ("Pumps ran for 3 h per day, with and without the new filter, and not only at night.", None, None),
    ("without the new filter, and not only at night", None, None),
    ("without the new filter, and not only at night", "the new filter", "part_negation"),
    ("only at night", None, "negation"),
    ("Flow did drop below -4 kW at any point", None, "negation"),
    ("drop below -4 kW at any point", None, "negation"),
    ("Flow did not drop below -4 kW at any point", "Flow did not drop", None),
    ("Flow did not drop below -4 kW at any point", "Flow dropped", "part_negation"),
    ("The dam held 12.5 m of water in May.", "No water was held", "part_negation"),
    ("Flow did not drop below 4 kW at any point", None, "number"),
    ("Flow did not drop below −4 kW at any point", None, "boundary"),  # the same number, written otherwise
    ("Salt reached 5 mW", None, "boundary"),
    ("where x >= 7 and the improvement lasted", None, None),
    ("where x > 7 and the improvement lasted", None, "comparison"),
    ("the improvement lasted. [symbols not readable", None, "placeholder"),
    ("Stones were sorted by size", None, "negation"),  # the last of five places lies before "did not"
    ("Pumps ran for 3 h per day", None, None),
    ("ones were sorted by size", None, "boundary"),
    ("sorted by size and color on the long bench near the mill", None, "boundary"),
]


@pytest.mark.parametrize("quote,part,reason", CASES)
def test_reasons(quote, part, reason):
    kind, start, end, _ = locate_anchor(quote, PAGE)
    assert M.meaning_differs(quote, PAGE, start, end, part) == reason


def test_every_reason_has_a_case():
    assert {r for _, _, r in CASES if r} == set(M.REASONS)


def test_every_place_is_read():
    page = "Ice was thin in March. " + "Calm days passed over the bay and nets were mended there. " * 6 + "Never since that day the Ice was thin in March."
    _, a, b, _ = locate_anchor("Ice was thin in March", page)
    assert M.meaning_differs("Ice was thin in March", page, a, b) == "negation"
    assert M.meaning_differs("Ice was thin in March", page[:300], a, b) is None


def test_guard_over_rows(spark):
    rows = [(i, q, PAGE, p) for i, (q, p, _) in enumerate(CASES)] + [(90, "nowhere to be found at all", PAGE, None), (91, None, PAGE, None), (92, "x", None, None), (93, "?", PAGE, None)]
    found = {r["id"]: r["guard"] for r in M.guarded(spark.createDataFrame(rows, "id int, quote string, passage string, part string")).collect()}
    assert [found[i]["reason"] for i in range(len(CASES))] == [r for _, _, r in CASES]
    assert all(found[i]["kind"] is None and found[i]["reason"] is None for i in (90, 91, 92, 93))
    assert M.guarded(spark.createDataFrame([], "id int, quote string, passage string, part string")).count() == 0


def test_verbatim_quotes_of_plain_words_always_pass():
    rng = random.Random(4)
    words = [rng.choice("alder birch cedar elm fir hazel larch maple oak pine rowan yew".split()) + rng.choice("abc") for _ in range(400)]
    page = " ".join(words)
    for _ in range(60):
        i = rng.randrange(390)
        quote = " ".join(words[i : i + rng.randrange(3, 10)])
        _, a, b, _ = locate_anchor(quote, page)
        assert M.meaning_differs(quote, page, a, b) is None


def test_coverage(spark):
    sentence = "Rain fell on $x_1 < 3$ days and the river rose, but no bridge was lost."
    cases = [
        (["Rain fell on $x_1 < 3$ days", "the river rose", "no bridge was lost"], (3, 0, "", True)),
        (["rain  FELL on $x_1 < 3$ days", "the river rose", "bridge was lost"], (3, 0, "no", False)),
        (["the river rose", "Rain fell on $x_1 < 3$ days"], (1, 1, "Rain fell on $x_1 < 3$ days no bridge was lost", False)),
        (["Rain fell on $x_1<3$ days"], (0, 1, None, False)),
        ([], (0, 0, None, False)),
        (None, (0, 0, None, False)),
    ]
    df = spark.createDataFrame([(i, sentence, p) for i, (p, _) in enumerate(cases)] + [(90, None, ["x"]), (91, "", [])], "claim long, sentence string, parts array<string>")
    found = {r["claim"]: tuple(r)[1:] for r in M.coverage(df).collect()}
    for i, (_, want) in enumerate(cases):
        assert found[i][:2] == want[:2] and found[i][3] == want[3] and (want[2] is None or found[i][2] == want[2])
    assert found[90] == (0, 1, "", False) and found[91] == (0, 0, "", True)


def test_texts_come_to_python_a_few_at_a_time_and_once(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pair = spark.range(3).selectExpr("id", "'on the old canal' AS quote", "'Locks on the old canal.' AS passage", "CAST(NULL AS STRING) AS part")
    texts = spark.range(2).selectExpr("id AS item_id", "'old canal' AS text")
    held = E.exact_anchors(texts, pair.selectExpr("id AS doc_id", "passage AS text"))
    for found in (M.guarded(pair).filter("guard.kind = 'exact'"), E.anchors(pair).filter("anchor.kind = 'exact'"), held):
        steps = plan(found)
        assert "Arrow" not in steps and "InPandas" not in steps  # those take batches of 10,000 rows
        assert steps.count("BatchEvalPython") == 1 and found.count()
    assert sorted(map(tuple, held.collect())) == [(i, d, "exact") for i in range(2) for d in range(3)]

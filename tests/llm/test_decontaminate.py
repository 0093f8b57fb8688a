import pickle
import random
import re

from gleanery.llm import decontaminate
from tests.llm.helpers import docs_of, noisy, rows_of


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, width=10):
    w, hit, got = words(text), set(), set()
    for item, t in items:
        b = words(t)
        k = min(width, len(b))
        for j in range(len(b) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == b[j : j + k]:
                    hit |= set(range(i, i + k))
                    got.add(str(item))
    return len(w), len(hit), sorted(got)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_matches_brute_force(spark):
    rng = random.Random(3)
    voc = ["a", "B", "é", "c1", "Dd"]
    items = [(i, " ".join(rng.choice(voc) for _ in range(n))) for i, n in enumerate([12, 10, 3, 1, 25, 0, 12])] + [(50, None), (51, "!!"), (52, "the same words"), (53, "The SAME, words")]
    texts = [None, "", "?"] + [("-".join if i % 2 else " ".join)([rng.choice(voc) for _ in range(rng.randrange(60))]) for i in range(60)]
    texts += [f"x {items[0][1].upper()} y {items[4][1]}", "pad " * 5000 + items[0][1]]
    for df in (docs_of(spark, texts), noisy(docs_of(spark, texts))):
        found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows_of(decontaminate.contamination(df, bench(spark, items)))}
        assert found == {i + 1: brute(t, items) for i, t in enumerate(texts)}


def test_drop_and_remove(spark):
    item = "one two three four five six seven eight nine ten"
    texts = ["clean text", f"Before. {item.title()}! After", None, item[4:], "clean text"]
    df = docs_of(spark, texts)
    assert sorted(r["doc_id"] for r in rows_of(decontaminate.drop_contaminated(df, bench(spark, [(1, item)])))) == [1, 3, 4, 5]
    cut = {r["doc_id"]: r["text"] for r in rows_of(decontaminate.remove_spans(df, bench(spark, [(1, item)])))}
    assert cut[1] == "clean text" and cut[3] is None and cut[4] == item[4:] and cut[2].split() == ["Before.", "!", "After"]


def test_empty_tables_and_the_bound(spark):
    assert rows_of(decontaminate.contamination(docs_of(spark, []), bench(spark, [(1, "x")]))) == []
    found = rows_of(decontaminate.contamination(docs_of(spark, ["x y"]), bench(spark, [])))
    assert (found[0]["n_words"], found[0]["n_hit"], found[0]["items"]) == (2, 0, [])
    two = bench(spark, [(1, "one two Three four, five-six seven eight nine ten eleven"), (2, None), (3, "!")])
    assert rows_of(decontaminate.contamination(docs_of(spark, ["x"]), two, max_windows=2))[0]["n_hit"] == 0
    try:
        decontaminate.contamination(docs_of(spark, ["x"]), two, max_windows=1)
    except ValueError as e:
        assert "2 windows" in str(e)
    else:
        raise AssertionError("a large benchmark was sent")


def test_the_broadcast_takes_under_forty_bytes_a_window():
    rng = random.Random(5)
    voc = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    known = decontaminate.Benchmark([(i, " ".join(rng.choice(voc) for _ in range(200))) for i in range(500)], 10)
    windows = sum(len(x.hashes) for x in known.at.values())
    assert windows > 95_000 and known.nbytes() < 40 * windows and len(pickle.dumps(known, 5)) < 40 * windows


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    """With every hash equal, only the words decide."""
    monkeypatch.setattr(decontaminate, "window_hashes", lambda h, w: decontaminate.np.zeros(max(0, len(h) - w + 1), decontaminate.np.uint64))
    items = [(1, "a b c"), (2, "a b d"), (3, "b c a b"), (4, "a b c")]
    known = decontaminate.Benchmark(items, 3)
    for text in ("x a b c", "a b d", "a b", "b c a b c", "c a b"):
        n, hit, got = known.scan(text)
        assert (n, int(hit.sum()), sorted(got)) == brute(text, items, 3)

"""Works under arriving and undone links, against one union-find over the whole history."""

import random

import pytest

from gleanery.operators import merges as M
from gleanery.plans import identity_queries
from gleanery.sources import tables


pytestmark = pytest.mark.usefixtures("few_partitions")


def union_find(records, events):
    """All standing links in order, two published records kept apart."""
    parent = {r[0]: r[0] for r in records}
    pub = {r[0]: ({r[1]} if r[2] else set()) for r in records}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, undone = {}, set()
    for seq, a, b, op in events:
        k = (min(a, b), max(a, b))
        if op == "undo":
            undone.add(k)
        else:
            links[k] = min(seq, links.get(k, seq))
    by_doi = {}
    for i, doi, p, _ in sorted(records):
        if p and doi:
            if doi in by_doi:
                parent[root(i)] = root(by_doi[doi])
            by_doi.setdefault(doi, i)
    for (a, b), _ in sorted(links.items(), key=lambda e: (e[1], e[0])):
        if (a, b) in undone or a not in parent or b not in parent:
            continue
        x, y = root(a), root(b)
        if x != y and len(pub[x] | pub[y]) < 2:
            parent[x] = y
            pub[y] = pub[x] | pub[y]
    trees = {}
    for r in records:
        trees.setdefault(root(r[0]), []).append(r)
    return {r[0]: min(t, key=lambda r: (not r[2], r[3] if r[3] is not None else 1 << 40, r[0]))[0] for t in trees.values() for r in t}


RECORDS = "id long, doi string, published boolean, created long"
EVENTS = "seq long, a long, b long, op string"


def works(state):
    return {r["id"]: r["work"] for r in state.works.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories_equal_recomputation(spark, seed):
    rng = random.Random(seed)
    records = [(i, f"d{i}" if i % 3 == 0 else None, i % 3 == 0, rng.choice([None, 1990 + rng.randrange(9)])) for i in range(40)]
    state, history, seq = M.begin(spark.createDataFrame(records, RECORDS)), [], 0
    for _ in range(3):
        batch = []
        for _ in range(rng.randrange(4, 14)):
            if history and rng.random() < 0.3:
                _, a, b, _ = rng.choice(history)
                batch.append((seq, b, a, "undo"))
            else:
                batch.append((seq, rng.randrange(42), rng.randrange(42), "merge"))  # 40 and 41 are unknown
            seq += 1
        history += batch
        state = M.advance(state, spark.createDataFrame(batch, EVENTS))
        assert works(state) == union_find(records, history)


def test_only_touched_groups_are_computed_anew(spark):
    records = [(i, None, False, 2000 + i) for i in range(300)]
    state = M.begin(spark.createDataFrame(records, RECORDS))
    chain = [(i, i, i + 1, "merge") for i in range(0, 300, 3)]
    state = M.advance(state, spark.createDataFrame(chain, EVENTS))
    assert state.touched == 200
    state = M.advance(state, spark.createDataFrame([(900, 0, 3, "merge")], EVENTS))
    assert state.touched == 4 and works(state)[4] == 0
    state = M.advance(state, spark.createDataFrame([(901, 3, 0, "undo")], EVENTS))
    assert state.touched == 4 and works(state)[4] == 3
    state = M.advance(state, spark.createDataFrame([(902, 0, 3, "merge")], EVENTS))
    assert works(state)[4] == 3  # undone once, apart for good
    assert M.advance(state, spark.createDataFrame([], EVENTS)).touched == 0


def test_two_published_records_stay_apart_and_an_undo_frees_a_refused_link(spark):
    records = [(1, "a", True, 1), (2, None, False, 2), (3, "b", True, 3), (4, "b", True, 4)]
    state = M.advance(M.begin(spark.createDataFrame(records, RECORDS)), spark.createDataFrame([(1, 1, 2, "merge"), (2, 2, 3, "merge")], EVENTS))
    assert works(state) == {1: 1, 2: 1, 3: 3, 4: 3} and [tuple(r) for r in state.refused().collect()] == [(2, 3, 2)]
    state = M.advance(state, spark.createDataFrame([(3, 2, 1, "undo")], EVENTS))
    assert works(state) == {1: 1, 2: 3, 3: 3, 4: 3} and state.refused().isEmpty()


def test_records_that_arrive_later_take_up_their_links(spark):
    state = M.advance(M.begin(spark.createDataFrame([(1, None, False, 5)], RECORDS)), spark.createDataFrame([(1, 1, 9, "merge")], EVENTS))
    assert works(state) == {1: 1}
    state = M.arrive(state, spark.createDataFrame([(9, "x", True, 7)], RECORDS))
    assert works(state) == {1: 9, 9: 9}
    empty = M.begin(spark.createDataFrame([], RECORDS))
    assert works(empty) == {}


def test_external_links(spark):
    schema = "id long, doi string, title string, authors array<string>, year int, abstract string, version_label string"
    r = [(1, "10.48550/arxiv.1", "A walk along the old canal", ["Ann Lee"], 2000, None, None), (2, "10.1000/two", "Canals, revisited", ["Ann Lee"], 2001, None, None), (3, "10.1000/three", "Canals again", ["Bo Ek"], 2001, None, None), (4, "10.48550/arxiv.4", "On locks and weirs", ["Cy Orr"], 2000, None, None)]
    named = spark.createDataFrame([(1, "crossref", "10.1000/two"), (2, "semantic_scholar", "10.48550/arxiv.1"), (4, "crossref", "10.1000/three"), (4, "semantic_scholar", "10.1000/two"), (3, "crossref", "10.9/none")], "id long, source string, doi string")
    found = {(x["a"], x["b"]): (x["link_kind"], x["merge"], x["outcome"], x["source"]) for x in M.external_links(spark.createDataFrame(r, schema), named).collect()}
    assert found[(1, 2)] == ("same_work", True, "confirmed", "crossref")
    assert found[(3, 4)] == ("related_suspected", False, "disagree", "crossref") and found[(2, 4)][2] == "disagree"


def test_new_records_are_read_once_for_all_steps(spark):
    read = spark.sparkContext.accumulator(0)
    source = spark.createDataFrame([(i, f"d{i}", i % 2 == 0, i) for i in range(50)], RECORDS)

    def seen(frames):
        for f in frames:
            read.add(len(f))
            yield f

    state = M.begin(source.mapInPandas(seen, RECORDS))
    assert works(state) == {i: i for i in range(50)} and read.value == 50


def test_openings_are_read_once_and_titles_are_those_of_the_pool(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30))
    texts = [None, "", " \n\t ", "one", "  Two parts\x0b 𝒳 three\r\n", long, "\n" + long, " ".join(f"v{i}" for i in range(12)), " ".join(f"v{i}" for i in range(12)) + " ", "x" * 30_000 + " y", "\x00 a\x1f \x85b  c"]
    docs = [(i, t, "s", "en", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, tables.titles(spark, str(tmp_path)).collect())) == sorted(map(tuple, tables.pool(spark, str(tmp_path)).select("id", "title").collect()))
    openings = identity_queries._openings(spark, str(tmp_path))
    assert openings.count() == len(texts) and not any("documents.parquet" in f for f in openings.inputFiles())
    assert sorted(map(tuple, identity_queries._star(openings).collect())) == [(5, 6), (7, 8)]

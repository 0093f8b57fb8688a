"""Late revisions and alias watches: the same result however the stream is cut."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.stage import fresh
from gleanery.streaming import revisions, watch
from gleanery.streaming.events import drain, table_stream


pytestmark = pytest.mark.usefixtures("few_partitions")

START = datetime(2024, 1, 1)
HOUR = 3_600_000
EVENTS = "key long, kind string, item long, ts timestamp"


def events_of(n, keys, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        kind = rng.choices(["answered", "late", "rescoped", "other"], [2, 6, 1, 1])[0]
        rows.append((rng.randrange(keys), kind, rng.randrange(30) if rng.random() < 0.9 else None, START + timedelta(hours=rng.randrange(600), seconds=rng.randrange(3600))))
    return rows + [(None, "late", 1, START), (1, "late", 1, None)]


def brute(rows, window, settle, until):
    """Every key by the rule, over all rows at once."""
    ms = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
    out = {}
    for key in {r[0] for r in rows if r[0] is not None}:
        mine = [(k, i, ms(t)) for kk, k, i, t in rows if kk == key and t is not None]
        answers = [t for k, _, t in mine if k == "answered"]
        if not answers:
            continue
        a = min(answers)
        late = sorted((t, i) for k, i, t in mine if k == "late" and a < t <= a + window)
        if late and (due := late[0][0] + settle) < until:
            moved = any(k == "rescoped" and a < t <= due for k, _, t in mine)
            out[key] = ("skipped", "scope_revised", due, []) if moved else ("revised", None, due, sorted({i for t, i in late if t <= due and i is not None}))
    return out


@pytest.mark.parametrize("files,disorder", [(1, 0), (6, 0), (6, 20)])
def test_one_revision_at_most_however_the_stream_is_cut(spark, files, disorder):
    rows = events_of(400, 30, 3)
    rng = random.Random(files)
    timed = sorted((r for r in rows if r[3]), key=lambda r: r[3] + timedelta(hours=rng.random() * disorder))  # out of order by less than the delay
    folder = fresh(spark, "late-events")
    size = -(-len(timed) // files)
    for i in range(files):
        spark.createDataFrame(timed[i * size : (i + 1) * size] + ([r for r in rows if not r[3]] if i == 0 else []), EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/part{i:03d}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(folder)
    window, settle = 72 * HOUR, 6 * HOUR
    found = {r["key"]: (r["status"], r["reason"], r["due_ms"], list(r["items"])) for r in drain(revisions.decide(stream, window, settle, "1 day")).collect()}
    until = int((max(r[3] for r in timed) - datetime(1970, 1, 1)) / timedelta(milliseconds=1)) - 24 * HOUR
    assert found == brute(rows, window, settle, until) and len(found) > 10


def union(rows):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, names in rows:
        for n in names or []:
            a, b = root(i), root(by.setdefault(n, i))
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def test_aliases_join_transitively_across_batches_and_restarts(spark):
    rng = random.Random(2)
    rows = [(i, [f"a{rng.randrange(60)}" for _ in range(rng.randrange(3))]) for i in range(45)] + [(7, ["a1", "late"]), (50, None)]
    schema = "id long, aliases array<string>"
    full = lambda df: df.withColumns({"published": F.lit(False), "doi": F.lit(None).cast("string"), "created": F.col("id")})
    folder, source = fresh(spark, "watch"), fresh(spark, "watch-source")
    w = watch.Watch(spark, folder)
    for part in range(2):  # the second run starts from the checkpoint of the first
        spark.createDataFrame(rows[part::2], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        w.follow(full(stream), f"{folder}-checkpoint")
    assert len(w.batches()) == 2 and {r["id"]: r["work"] for r in w.works().collect()} == union(rows)
    before = w.works().collect()
    w.apply(full(spark.createDataFrame([(1, ["a1", "a2", "a3", "a4", "a5"])], schema)), w.batches()[-1])  # a batch that was taken
    assert sorted(w.works().collect()) == sorted(before)


def test_aliases_of_a_record(spark):
    rows = [("pubmed", "12", "https://doi.org/10.1000/X", "W1", "https://x.org/W9/"), ("arxiv", "1", "10.48550/arXiv.1", None, ""), ("a", "b", None, "p", "p")]
    df = spark.createDataFrame(rows, "p string, n string, d string, i string, o string")
    found = [r[0] for r in df.select(watch.aliases(F.col("p"), F.col("n"), F.col("d"), pmid=F.col("i"), openalex=F.col("o"))).collect()]
    assert found == [["pubmed:12", "doi:10.1000/x", "pmid:W1", "openalex:W9"], ["arxiv:1"], ["a:b", "pmid:p", "openalex:p"]]


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_is_a_folder_of_any_number_of_files(spark, files):
    folder = fresh(spark, "tables")
    spark.range(9).repartition(files).write.parquet(f"{folder}/documents.parquet")
    spark.range(4).coalesce(1).write.parquet(f"{folder}/labels.parquet")
    assert sorted(r["id"] for r in drain(table_stream(spark, folder, "documents")).collect()) == list(range(9))


def test_a_watch_before_its_first_batch_knows_no_works(spark):
    assert watch.Watch(spark, fresh(spark, "watch")).works().count() == 0

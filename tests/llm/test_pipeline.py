import random

import corpus_pipeline
from gleanery.llm import toxicity
from tests.llm.helpers import rows_of
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngram_join import brute as near


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(2)
    voc = [f"v{i}" for i in range(200)]
    item = " ".join(f"q{i}" for i in range(12))
    texts = []
    for i in range(400):
        words = [rng.choice(voc) for _ in range(rng.randrange(3, 50))]
        if i % 4 == 0:
            words.insert(1, "idiot")
        if i % 9 == 1:
            words += item.split()
        texts.append(" ".join(words))
        if i % 7 == 2:
            texts.append(" ".join([*words, "end"]))
    texts += [None, ""]
    docs = [(i + 1, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t, *_ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    df, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(rows_of(df))

    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    score = {r["doc_id"]: r["predicted"] for r in rows_of(toxicity.score(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels))}
    one = sorted(i for i, *_ in docs if not score[i])
    assert sorted(r["doc_id"] for r in kept[0]) == one and not any("idiot" in (r["text"] or "") for r in kept[0])
    found, _ = near([texts[i - 1] for i in one])
    two = [i for k, i in enumerate(one) if found[k + 1][1] == k + 1]
    assert sorted(r["doc_id"] for r in kept[1]) == two
    three = [i for i in two if leaks(texts[i - 1], [(1, item)])[1] == 0]
    assert sorted(r["doc_id"] for r in kept[2]) == three
    assert {r["doc_id"] for r in kept[3]} <= set(three)
    assert sorted(r["doc_id"] for r in kept[4]) == sorted(r["doc_id"] for r in kept[3])
    assert len(kept[4]) == corpus_pipeline.run(spark, str(tmp_path)).count()

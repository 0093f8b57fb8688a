import random

import public_tokenizers
import sentencepiece

from gleanery.llm import token_count
from tests.llm.helpers import docs_of, noisy, rows_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = token_count.PieceCounter(MODEL)
    rng = random.Random(2)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "日本", "▁", "<s>", "</s>", "<0x0A>", "\t", "\x00", "😀", ".", "\r\n", "   x", "﷽", "​", "İ"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert counter.count(text) == len(sp.encode(text)), text


def test_rows_nulls_long_texts_and_repeats(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [None, "", "Hello world", "word " * 30_000, "x" * 20_000, "Hello world"]
    for df in (docs_of(spark, texts), noisy(docs_of(spark, texts))):
        found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows_of(token_count.token_counts(df, MODEL))}
        assert found == {i + 1: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in enumerate(texts)}
    assert rows_of(token_count.token_counts(docs_of(spark, []), MODEL)) == []


def test_a_full_cache_starts_again(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_WORDS", 3)
    counter = token_count.PieceCounter(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "one two three four five six one"
    assert counter.count(text) == len(sp.encode(text)) and len(counter) <= 3

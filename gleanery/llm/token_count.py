"""Token counts of a piece vocabulary by heap-and-linked-list byte-pair merging.

Symbols of a chunk form a linked list; a heap gives the adjacent pair of best score, leftmost first;
merging it makes at most two new pairs. The count is the initial symbols minus the merges; no
identifiers are made. A symbol that ends unknown counts its UTF-8 bytes (byte fallback).

Texts fall apart into chunks at places that no piece of the vocabulary spans (checked against the
vocabulary when it is read): before a run of spaces and around a line end. A bounded cache keeps the
counts of words.

Defined results: a null text counts as empty (0 tokens); the whole text counts, however long; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tune

#: Word counts that a Python worker keeps: about 150 MB.
CACHE_WORDS = 1_200_000
SPACE = "▁"


class PieceCounter(dict):
    """Counts by word (a line end at its front, or else a space before it); a miss is merged with the heap and kept."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        pieces = sorted((-model.get_score(i), model.id_to_piece(i)) for i in range(size) if i not in special)
        self.rank = {piece: at for at, (_, piece) in enumerate(pieces)}
        self.normalize = model.normalize
        if sum(model.is_byte(i) for i in range(size)) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(model.is_unused(i) for i in range(size)):
            raise ValueError("unused pieces are not handled")
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", piece) for piece in self.rank):
            raise ValueError("a piece spans the end of a chunk")
        if self.normalize("  A\tb ") != f"{SPACE}{SPACE}{SPACE}A\tb{SPACE}":
            raise ValueError("only identity normalisation with a leading space is handled")

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.merge(word if word[:1] == "\n" else SPACE + word)
        return n

    def merge(self, chunk: str) -> int:
        """Tokens of one chunk (spaces already escaped)."""
        get, n = self.rank.get, len(chunk)
        symbols, ranks = list(chunk), [get(a + b, -1) for a, b in zip(chunk, chunk[1:])]
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        ranks.append(-1)
        heapq.heapify(heap)
        before, after, left = list(range(-1, n - 1)), list(range(1, n + 1)), n
        while heap:
            best = heapq.heappop(heap)
            i = best & 0xFFFFFFFF
            if ranks[i] != best >> 32:  # a pair that is gone
                continue
            j = after[i]
            piece = symbols[i] = symbols[i] + symbols[j]
            symbols[j], ranks[j] = "", -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                r = ranks[i] = get(piece + symbols[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | i)
            else:
                ranks[i] = -1
            if (h := before[i]) >= 0:
                r = ranks[h] = get(symbols[h] + piece, -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | h)
        known = self.rank
        return left + sum(len(x.encode()) - 1 for x in symbols if x and x not in known)

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if SPACE not in text and "" not in (words := text.replace("\n", " \n").split(" ")):
            return sum(map(self.__getitem__, words))
        return sum(map(self.merge, CHUNK.findall((SPACE + text).replace(" ", SPACE))))


#: A run of escaped spaces with what follows it, or a line end.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


@functools.lru_cache(maxsize=1)
def counter_for(path: str) -> PieceCounter:
    """The counter that a Python worker keeps from task to task."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens."""
    tune(docs.sparkSession)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(model_path)
        for b in batches:
            n = [counter.count(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.octet_length(text).cast("long"), text).mapInArrow(count, schema)

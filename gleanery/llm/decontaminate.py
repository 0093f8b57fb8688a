"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs outside ASCII separators after lower-casing A-Z. A window is ``width`` consecutive
words of an item; an item of fewer words is one window of its own length. Training texts are scanned
window by window against the broadcast hashes; a hash hit is verified word by word before it counts.

The broadcast is a few arrays: of every distinct window its hash, where its words begin in one run of bytes
that holds all items, and the items that have it, 20 to 30 bytes a window with the words. ``max_windows`` bounds it
and a larger benchmark is refused rather than sent.

Defined results: a null or wordless text has no words and no hits; a wordless item never occurs;
items of equal text all count; repeated rows each get their own row; an empty benchmark gives zero
hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name, tune

#: Windows of a benchmark that may be broadcast: about 60 MB with their words.
MAX_WINDOWS = 2_000_000

#: Words before lower-casing, for Spark's regular expressions.
WORDS_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_MAP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Normalised words, as bytes."""
    return text.encode().translate(_MAP).split() if text else []


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 80_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= _MULT
        out += hashes[k : k + n]
    return out ^ (out >> np.uint64(29))


class Windows:
    """The distinct windows of one width, sorted by hash: ``hashes``, the bytes from ``starts`` to ``ends`` that verify a hit, and
    the items behind window k, ``items[first[k]:first[k + 1]]``."""

    def __init__(self, text: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        hashes, starts, ends, items = hashes[order], starts[order], ends[order], items[order]
        fresh = np.ones(len(hashes), bool)
        same = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
        sizes = ends - starts
        for k in same.tolist():  # equal hashes are equal windows but for a collision, which stays a window of its own
            fresh[k] = sizes[k] != sizes[k - 1] or text[starts[k] : ends[k]] != text[starts[k - 1] : ends[k - 1]]
        at = np.flatnonzero(fresh)
        self.hashes, self.starts, self.ends, self.items = hashes[at], starts[at], ends[at], items
        self.first = np.append(at, len(items)).astype(np.int32)

    def found(self, text: bytes, h: int, k: int, words: list[bytes]) -> list[int]:
        """The items that have the window ``words``; ``k`` is the first place of its hash."""
        out: list[int] = []
        whole = b" ".join(words)
        while k < len(self.hashes) and int(self.hashes[k]) == h:
            if text[self.starts[k] : self.ends[k]] == whole:
                out += self.items[self.first[k] : self.first[k + 1]].tolist()
            k += 1
        return out


class Benchmark:
    """The broadcast: the normalised words of all items as one run of bytes, and the windows of each width."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        self.hash = _WordHashes()
        self.names, parts, size = [], [], 0
        made: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            words = words_of(text)
            w = min(width, len(words))
            if not w:
                continue
            lengths = np.array([len(x) for x in words])
            ends = size + np.cumsum(lengths + 1) - 1
            h = window_hashes(np.array([self.hash[x] for x in words], np.uint64), w)
            made.setdefault(w, []).append((h, (ends - lengths)[: len(h)].astype(np.int32), ends[w - 1 :].astype(np.int32), np.full(len(h), len(self.names), np.int32)))
            self.names.append(str(item))
            parts.append(b" ".join(words))
            size = int(ends[-1]) + 1
        self.text = b" ".join(parts)
        self.at = {w: Windows(self.text, *map(np.concatenate, zip(*rows))) for w, rows in made.items()}
        self.hash.clear()

    def nbytes(self) -> int:
        """Bytes of the text and the arrays."""
        return len(self.text) + sum(a.nbytes for x in self.at.values() for a in (x.hashes, x.starts, x.ends, x.items, x.first))

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Words, a mask of hit words, and the items that occur."""
        words = words_of(text)
        hit, items = np.zeros(len(words), bool), set()
        if words:
            hashes = np.array(list(map(self.hash.__getitem__, words)), np.uint64)
            for w, known in self.at.items():
                seen = window_hashes(hashes, w)
                if len(seen):
                    k = np.searchsorted(known.hashes, seen)
                    for i in np.flatnonzero(known.hashes[np.minimum(k, len(known.hashes) - 1)] == seen).tolist():
                        if got := known.found(self.text, int(seen[i]), int(k[i]), words[i : i + w]):
                            hit[i : i + w] = True
                            items.update(got)
        return len(words), hit, {self.names[i] for i in items}


def load_benchmark(benchmark: DataFrame, width: int, id_col: str, text_col: str, max_windows: int):
    """The checked broadcast variable."""
    spark = benchmark.sparkSession
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS_SQL)), F.lit(0))
    windows = F.when(words > 0, F.greatest(words - width + 1, F.lit(1))).otherwise(0)
    n = benchmark.agg(F.sum(windows)).first()[0] or 0
    if n > max_windows:
        raise ValueError(f"the benchmark has {n} windows, over {max_windows}; raise max_windows if executors can hold them")
    items = [(r[0], r[1]) for r in benchmark.select(id_col, text_col).collect()]
    return spark.sparkContext.broadcast(Benchmark(items, width))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted strings), spans (word ranges hit, end exclusive)."""
    tune(docs.sparkSession)
    known = load_benchmark(benchmark, width, item_col, item_text_col, max_windows)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = known.value
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            n, hits, items, spans = [], [], [], []
            for text in b.column(1).to_pylist():
                words, hit, got = bench.scan(text)
                n.append(words)
                hits.append(int(hit.sum()))
                items.append(sorted(got))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, spans_type)], names=[id_col, "n_words", "n_hit", "items", "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, all columns kept."""
    tune(docs.sparkSession)
    known = load_benchmark(benchmark, width, item_col, item_text_col, max_windows)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not known.value.scan(t)[2] for t in texts])

    flag = free_name(docs.columns, "clean")
    return docs.withColumn(flag, clean(F.col(text_col))).filter(F.col(flag)).drop(flag)


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of ``docs`` with every hit word cut out of the text, all columns kept; null stays null."""
    tune(docs.sparkSession)
    known = load_benchmark(benchmark, width, item_col, item_text_col, max_windows)

    def cut(text: str | None) -> str | None:
        if not text or not (hit := known.value.scan(text)[1]).any():
            return text
        raw = text.encode()
        mapped, at, kept, last = raw.translate(_MAP), 0, [], 0
        for word, gone in zip(mapped.split(), hit.tolist()):
            start = mapped.index(word, at)
            at = start + len(word)
            if gone:
                kept.append(raw[last:start])
                last = at
        kept.append(raw[last:])
        return b"".join(kept).decode()

    @F.pandas_udf("string")
    def cut_all(texts: pd.Series) -> pd.Series:
        return pd.Series([cut(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, cut_all(F.col(text_col)))


def items_digest(items: list[str]) -> str:
    """Hex SHA-256 of the comma-joined items."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()

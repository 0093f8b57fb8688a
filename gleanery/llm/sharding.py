"""Sharding by vector bin packing over bytes, tokens and rows.

Documents of equal text form a group. A group of more than one part in ``cells_per_shard`` of a shard is a
unit of its own; smaller ones share units by their hash. A group larger than ``whole`` shards is split by
document id into units of that fine size, every other group stays in one shard. The bounded list of units,
each a vector of bytes, tokens and rows, is packed on the driver: largest first, each unit into the shard
where the dot product of its vector with the shard's residual capacity is highest, among the shards that
hold it in all three measures, else among those that hold its bytes, else into the one with most residual
bytes. The law ``bytes`` comes first: sizes near equal.

Tokens are the words of the text, or the numbers of ``tokens_col`` if one is given.

Slots count from a base per unit. Where a unit is long, its rows are dealt by their hash to parts of
``part_rows`` rows or ``part_bytes`` bytes, whose counts are summed first, so no task sees a whole unit.

Defined results: a null text has 0 bytes and the CRC of an empty one; repeated rows are placed each on
their own; ties in a unit are ordered by id, then size; null ids come first; an empty table gives an
empty result; other columns are kept by ``shard_rows`` and ignored by ``shards``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_name, materialize

#: Units of ordinary groups for each shard; larger groups add at most twice as many again.
CELLS_PER_SHARD = 256
#: Bytes that every row costs besides its text.
ROW_BYTES = 16
#: A group of more than so many fair shares of a shard is split between shards.
WHOLE = 1.0
#: Rows and bytes of a part, within which slots are counted by one task.
PART_ROWS, PART_BYTES = 200_000, 1 << 28


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of ``vectors`` (bytes, tokens, rows)."""
    total = np.maximum(vectors.sum(axis=0), 1)
    need = vectors / total * shards  # in fair shares of a shard
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(vectors)), -need.max(axis=1))):
        held = residual >= need[i] - 1e-12
        fits = held.all(axis=1)
        if not fits.any():
            fits = held[:, 0]
        at = int(np.argmax(np.where(fits, residual @ need[i], -np.inf))) if fits.any() else int(np.argmax(residual[:, 0]))
        out[i] = at
        residual[at] -= need[i]
    return _level(vectors, out, shards)


def _level(vectors: np.ndarray, placed: np.ndarray, shards: int) -> np.ndarray:
    """Even out the bytes: the fullest and the emptiest shard swap two units of equal row counts, as long
    as that brings them nearer."""
    size = np.bincount(placed, vectors[:, 0], shards)
    for _ in range(100 * shards):
        full, empty = int(size.argmax()), int(size.argmin())
        gap = size[full] - size[empty]
        mine, theirs = np.flatnonzero(placed == full), np.flatnonzero(placed == empty)
        theirs = theirs[np.lexsort((vectors[theirs, 0], vectors[theirs, 2]))]
        best = (gap, -1, -1)
        for n in np.unique(vectors[mine, 2]):
            a, b = mine[vectors[mine, 2] == n], theirs[vectors[theirs, 2] == n]
            if not len(b):
                continue
            at = np.searchsorted(vectors[b, 0], vectors[a, 0] - gap / 2)
            for k in (np.maximum(at - 1, 0), np.minimum(at, len(b) - 1)):
                left = np.abs(gap - 2 * (vectors[a, 0] - vectors[b[k], 0]))
                i = int(left.argmin())
                best = min(best, (float(left[i]), int(a[i]), int(b[k[i]])))
        if best[0] >= gap:
            break
        moved = vectors[best[1], 0] - vectors[best[2], 0]
        placed[best[1]], placed[best[2]] = empty, full
        size[full] -= moved
        size[empty] += moved
    return placed


def _measured(docs: DataFrame, id_col: str, text_col: str, tokens_col: str | None) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        "size": (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long"),
        "crc": F.crc32(text.cast("binary")),
        "group": F.xxhash64(text, F.octet_length(text)),
        "tokens": (F.coalesce(F.col(tokens_col), F.lit(0)) if tokens_col else F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long"),
    }


def _unit(group: Column, row: Column, pieces: Column, cells: int) -> Column:
    """Small groups: their hash. Others: the group's own name and a piece by the row's hash."""
    return F.when(pieces.isNull(), F.pmod(group, F.lit(cells)).cast("string")).otherwise(
        F.concat_ws(":", F.lit("own"), group.cast("string"), F.pmod(row, pieces).cast("string"))
    )


class Plan:
    """Where rows go: ``own`` has the pieces of each large group, ``units`` the shard and first slot of each
    unit, ``parts`` the number of parts in which a unit's slots are counted."""

    def __init__(self, rows: DataFrame, shards: int, cells_per_shard: int = CELLS_PER_SHARD, whole: float = WHOLE, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES):
        """``rows``: group, row, size, tokens. Both lists are bounded: fewer than ``cells`` groups exceed a
        unit's fair share, and their pieces are at most as many again."""
        spark = rows.sparkSession
        self.cells = cells = cells_per_shard * shards
        total, count = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
        total = total or 0
        share = max(1, total // cells)
        large = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).filter(F.col("bytes") > share).collect()
        pieces = [(g["group"], int(min(-(-g["bytes"] // share), g["n"])) if g["bytes"] * shards > whole * total else 1) for g in large]
        self.own = spark.createDataFrame(pieces, "group long, pieces long")
        units = self.place(rows).groupBy("unit").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).orderBy("unit").collect()
        placed = pack(np.array([[u["bytes"], u["tokens"], u["n"]] for u in units], float).reshape(-1, 3), shards)
        base, out = [0] * shards, []
        for u, s in zip(units, placed.tolist()):
            out.append((u["unit"], s, base[s]))
            base[s] += u["n"]
        self.units = spark.createDataFrame(out, "unit string, shard int, first long")
        self.parts = int(max(1, *(-(-u["n"] // part_rows) for u in units), *(-(-u["bytes"] // part_bytes) for u in units))) if units else 1
        self.rows = rows

    def place(self, rows: DataFrame, group: str = "group", row: Column | None = None, unit: str = "unit") -> DataFrame:
        """``rows`` with their unit."""
        row = F.col("row") if row is None else row
        held = free_name(rows.columns, "g_pieces")
        own = self.own.toDF(group, held)
        return rows.join(F.broadcast(own), group, "left").withColumn(unit, _unit(F.col(group), row, F.col(held), self.cells)).drop(held)

    def part(self, row: Column) -> Column:
        return F.pmod(F.xxhash64(row, F.lit(1)), F.lit(self.parts))

    def firsts(self) -> DataFrame:
        """unit, part, shard and first slot of each part."""
        if self.parts == 1:
            return self.units.withColumn("part", F.lit(0).cast("long"))
        counts = self.place(self.rows).groupBy("unit", self.part(F.col("row")).alias("part")).agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.join(F.broadcast(self.units), "unit").select("unit", "part", "shard", (F.col("first") + before).alias("first"))


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, **limits) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard; a column of such a name is renamed with a trailing underscore.

    ``limits``: those of ``Plan``.
    """
    ours = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    for c in docs.columns:
        if c.lower() in ours:
            docs = docs.withColumnRenamed(c, free_name([*docs.columns, *ours], c))
    m = _measured(docs, id_col, text_col, tokens_col)
    plain = docs.select(m["group"].alias("group"), F.xxhash64(F.col(id_col)).alias("row"), m["size"].alias("size"), m["tokens"].alias("tokens"))
    plan = Plan(materialize(plain, "shard-sizes"), shards, **limits)
    group, unit, part, first = (free_name(docs.columns, x) for x in ("g_group", "g_unit", "g_part", "g_first"))
    row = F.xxhash64(F.col(id_col))
    rows = plan.place(docs.withColumns({"size": m["size"], "text_crc32": m["crc"], "law": F.lit("bytes"), group: m["group"]}), group, row, unit).withColumn(part, plan.part(row))
    firsts = plan.firsts().select(F.col("unit").alias(unit), F.col("part").alias(part), "shard", F.col("first").alias(first))
    rows = rows.join(F.broadcast(firsts) if plan.parts == 1 else firsts, [unit, part])
    order = Window.partitionBy(unit, part).orderBy(id_col, "size")
    return rows.withColumn("slot", (F.col(first) + F.row_number().over(order) - 1).cast("long")).withColumn("grown_shard", F.lit(None).cast("int")).drop(group, unit, part, first)


def shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, **limits) -> DataFrame:
    """One narrow row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    m = _measured(docs, id_col, text_col, tokens_col)
    rows = materialize(docs.select(F.col(id_col).alias("id"), m["group"].alias("group"), F.xxhash64(F.col(id_col)).alias("row"), m["size"].alias("size"), m["tokens"].alias("tokens"), m["crc"].alias("crc")), "shard-rows")
    plan = Plan(rows, shards, **limits)
    placed = plan.place(rows).withColumn("part", plan.part(F.col("row")))
    firsts = plan.firsts()
    order = Window.partitionBy("unit", "part").orderBy("id", "size")
    return placed.join(F.broadcast(firsts) if plan.parts == 1 else firsts, ["unit", "part"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

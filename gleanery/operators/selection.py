"""Choosing rows: caps, budgets, slots, strides, rolls, runs, upserts and histories.

Every operator works by groups that Spark deals out; none numbers a whole table in one task. Where an order
over a whole table is wanted, take ``ranks.positions`` first and pass its column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(columns: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "k") -> DataFrame:
    """``df`` with places 1..n inside each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(order))))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key."""
    return numbered(df, keys, order, "_k").filter(F.col("_k") <= most).drop("_k")


def stable_distinct(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Repeats of a key go, the first one stays."""
    return first_per(df, keys, order)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row but one of each history: what an undo brings back."""
    return numbered(df, keys, [F.desc(c) if isinstance(c, str) else c.desc() for c in order], "_k").filter("_k = 2").drop("_k")


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], size: str, budget: float) -> DataFrame:
    """The longest prefix of each key whose sizes stay within the budget."""
    run = F.sum(size).over(Window.partitionBy(*keys).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_run", run).filter(F.col("_run") <= budget).drop("_run")


def _sorted_items(df: DataFrame, keys: Sequence[str], order: str, item: str, size: str) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).alias("i"), F.col(size).cast("double").alias("s"))))
    return df.groupBy(*keys).agg(items.alias("items"))


def greedy_fill(df: DataFrame, keys: Sequence[str], order: str, item: str, size: str, budget: float) -> DataFrame:
    """(keys, item): items taken in order while they fit; one that does not is passed over, later smaller ones may fit.

    A key's items are one array: keys are groups of bounded size (the passages of a document, the turns of a
    conversation).
    """
    kinds = dict(df.dtypes)
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast(f"array<{kinds[item]}>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["s"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["s"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["i"]))).otherwise(acc["kept"]).alias("kept"))

    folded = _sorted_items(df, keys, order, item, size).select(*keys, F.aggregate("items", start, step)["kept"].alias("kept"))
    return folded.select(*keys, F.explode("kept").alias(item))


def batches(df: DataFrame, keys: Sequence[str], order: str, item: str, size: str, cap: float) -> DataFrame:
    """(keys, item, batch): a new batch starts where the next item would pass the cap; a larger item is a batch alone."""
    kinds = dict(df.dtypes)
    start = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("batch"), F.array().cast(f"array<struct<i:{kinds[item]},b:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cut = (acc["used"] > 0) & (acc["used"] + x["s"] > cap)
        batch = acc["batch"] + cut.cast("int")
        return F.struct(F.when(cut, x["s"]).otherwise(acc["used"] + x["s"]).alias("used"), batch.alias("batch"), F.concat(acc["out"], F.array(F.struct(x["i"].alias("i"), batch.alias("b")))).alias("out"))

    folded = _sorted_items(df, keys, order, item, size).select(*keys, F.explode(F.aggregate("items", start, step)["out"]).alias("x"))
    return folded.select(*keys, F.col("x.i").alias(item), F.col("x.b").alias("batch"))


#: Rows that a task of ``islands`` sorts, about: their number sets the tasks, so that a larger table takes more of them.
ISLAND_ROWS = 1_000_000


def islands(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """(keys, first, last, n): runs of neighbouring positions.

    Rows are dealt once by their keys; distinct rows, places and runs are found where they lie."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ISLAND_ROWS))
    d = df.select(*keys, position).repartition(tasks, *keys).distinct()
    run = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return d.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def fixed_slots(df: DataFrame, position: str, keep: Column, order: Sequence[Column | str], group: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``slot``: kept rows hold their position, the others fill the free ones in a new order.

    ``group`` deals the reorder out; without one the rows must be a bounded window.
    """
    g = list(group) or [F.lit(0)]
    rows = df.withColumn("_keep", keep)
    free = rows.filter("not _keep")
    slots = free.select(*group, F.col(position).alias("slot"), F.row_number().over(Window.partitionBy(*g).orderBy(position)).alias("_n"))
    movers = free.withColumn("_n", F.row_number().over(Window.partitionBy(*g).orderBy(*_order(order))))
    moved = movers.join(slots, [*group, "_n"]).drop("_n", "_keep")
    return rows.filter("_keep").withColumn("slot", F.col(position)).drop("_keep").unionByName(moved)


def head_and_stride(df: DataFrame, position: str, total: int, most: int) -> DataFrame:
    """Half of ``most`` from the head, the rest in even strides over what follows; all if there are no more."""
    if total <= most:
        return df
    head = most // 2
    rest, want = total - head, most - head
    at = F.col(position) - head - 1  # 0 for the first row behind the head
    step = F.floor((at + 1) * want / rest) > F.floor(at * want / rest)
    return df.filter((F.col(position) <= head) | ((F.col(position) > head) & step))


def roll(df: DataFrame, position: str, start: int, total: int, most: int) -> DataFrame:
    """The next ``most`` rows after a resume position, from the beginning again at the end; ``turn`` is their order."""
    turn = F.pmod(F.col(position) - 1 - start, F.lit(max(total, 1)))
    return df.withColumn("turn", turn).filter(F.col("turn") < most)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str], ignore: bool = False) -> DataFrame:
    """``old`` with the rows of ``new``: the first new row of a key replaces an old one, or with ``ignore`` is dropped."""
    fresh = first_per(new, keys, order)
    if ignore:
        return old.unionByName(fresh.join(old.select(*keys), list(keys), "left_anti"))
    return old.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def exactly_one(parts: Sequence[DataFrame], universe: DataFrame, key: str) -> DataFrame:
    """(key, n): members of the universe that are not in exactly one part, and members of parts that are outside it (n = -1)."""
    every = parts[0].select(key)
    for p in parts[1:]:
        every = every.unionByName(p.select(key))
    n = every.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    inside = universe.select(key).distinct()
    wrong = inside.join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1")
    return wrong.unionByName(n.join(inside, key, "left_anti").select(key, F.lit(-1).cast("long").alias("n")))


def tie_spans(df: DataFrame, keys: Sequence[str], score: str, most: int) -> DataFrame:
    """``df`` with ``capture``: sure (its whole tie group is within the first ``most``), open (the cut runs through the
    group) or out."""
    ranked = df.withColumn("_above", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(score))) - 1).withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy(*keys, score)))
    return ranked.withColumn("capture", F.when(F.col("_above") + F.col("_ties") <= most, "sure").when(F.col("_above") < most, "open").otherwise("out")).drop("_above", "_ties")


def room_per_group(df: DataFrame, group: str, order: Sequence[Column | str], room: DataFrame) -> DataFrame:
    """``df`` with ``planned``: whether a row is within its group's room. ``room``: group, room; a group without one has none."""
    k = numbered(df, [group], order, "_k").join(room, group, "left")
    return k.withColumn("planned", F.col("_k") <= F.coalesce("room", F.lit(0))).drop("_k", "room")


def repeated_edges(lines: DataFrame, doc: str, page: str, text: str, pages: int = 3, share: float = 0.4) -> DataFrame:
    """(doc, masked, n): lines that recur with other digits on at least ``pages`` pages and that share of a document's pages."""
    masked = lines.select(doc, page, F.regexp_replace(F.trim(F.col(text)), r"[0-9]+", "#").alias("masked")).filter("masked <> ''")
    total = lines.groupBy(doc).agg(F.count_distinct(page).alias("total"))
    n = masked.groupBy(doc, "masked").agg(F.count_distinct(page).alias("n"))
    return n.join(total, doc).filter((F.col("n") >= pages) & (F.col("n") >= share * F.col("total"))).select(doc, "masked", "n")

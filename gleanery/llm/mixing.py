"""Mixing sources to target weights as a minimum-cost flow.

A document belongs to one or more sources; documents of the same membership pattern are
interchangeable, so they are aggregated first. The flow network has an arc from each pattern to each
of its sources. A pattern supplies its size up to ``copies`` times, at a cost that grows with every
repetition (convex), and each source draws its target. The solved flow says how many words of each
pattern are taken; whole copies go to every document of the pattern and the rest to documents in the
order of a seeded hash: each that still fits is taken, one that does not is passed over. Bucketed sums
find the first that does not fit without sorting a source; the pass is repeated behind it, over the
documents that fit the gap it leaves, until none fits. At last one document closes the gap, if any
brings the sum nearer to the target: after the last pass, or after an earlier one where that comes nearer.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and share ``factor`` times
all sizes; a target stops at ``copies`` times its source's size and the excess is shared again by
weight among the others.

Bounds: the driver holds one row per membership pattern (``max_patterns``, refused beyond) and one
histogram of 4,096 sums per source and level; passes go with the logarithm of the gap.

Defined results: a null text has size 0 and takes 0; null is a source of its own; repeated rows share
their fate; an empty table gives an empty result; other columns are ignored by ``mix`` and kept by
``mixed_rows``.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, materialize

WORD = r"[^\x20\x09-\x0D]+"
BITS = 12
LEVELS = 5
#: Turns a hash so that signed numbers compare as unsigned hashes do.
TURN = -(1 << 63)


def targets_of(sizes: dict, weights: Sequence[int] = (3, 1, 2), factor: float = 1.5, copies: int = 2) -> dict:
    """The target of each source (exact fractions as floats)."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: tuple(map(ord, s))) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = factor * sum(sizes.values()), list(order), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if per * weight[s] > copies * sizes[s]]
        if not full:
            out |= {s: per * weight[s] for s in open_}
            break
        for s in full:
            out[s] = float(copies * sizes[s])
            left -= out[s]
            open_.remove(s)
    return {s: out.get(s, 0.0) for s in order}


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int, nodes: int) -> dict[int, int]:
    """Flow on each arc (from, to, capacity, cost) by successive shortest paths with potentials."""
    head: list[list[int]] = [[] for _ in range(nodes)]
    to, room, cost = [], [], []
    for a, b, cap, c in arcs:
        for u, v, x, y in ((a, b, cap, c), (b, a, 0, -c)):
            head[u].append(len(to))
            to.append(v)
            room.append(x)
            cost.append(y)
    potential = [0] * nodes
    while True:
        far, via = [float("inf")] * nodes, [-1] * nodes
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in head[u]:
                if room[e] and (x := d + cost[e] + potential[u] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = x, e
                    heapq.heappush(queue, (x, to[e]))
        if far[sink] == float("inf"):
            return {i: room[2 * i + 1] for i in range(len(arcs))}
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        push, v = float("inf"), sink
        while v != source:
            push, v = min(push, room[via[v]]), to[via[v] ^ 1]
        v = sink
        while v != source:
            room[via[v]] -= push
            room[via[v] ^ 1] += push
            v = to[via[v] ^ 1]


def route(patterns: list[tuple[tuple, int]], targets: dict, copies: int = 2) -> list[int]:
    """Words taken of each pattern (members, size): least repetition, targets met as far as sizes allow."""
    names = list(targets)
    at = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    arcs = []
    for i, (members, size) in enumerate(patterns):
        arcs += [(0, 2 + i, size, k * k) for k in range(copies)]  # the k-th repetition costs k squared a word
        arcs += [(2 + i, at[s], copies * size, 0) for s in members]
    arcs += [(at[s], 1, round(targets[s]), 0) for s in names]
    flow = min_cost_flow(arcs, 0, 1, 2 + len(patterns) + len(names))
    took, i = [], 0
    for members, _ in patterns:
        took.append(sum(flow[i + k] for k in range(copies)))
        i += copies + len(members)
    return took


def _slot(h: Column, level: int) -> Column:
    """The ``level``-th 12 bits of the hash, most significant first, as an unsigned number."""
    return F.shiftrightunsigned(h, 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1) if level < LEVELS else h.bitwiseAND((1 << (64 - BITS * LEVELS)) - 1)


def thresholds(rows: DataFrame, quota: dict[int, int]) -> dict[int, tuple[list[int], int]]:
    """For each pattern, the digits of the hash below which documents are taken, and the words so taken.

    ``rows``: pattern, h, size. Each level sums one digit of the hash within the bucket that the level
    before left open, until that holds a single hash; digits are compared from the left, so documents are
    taken in hash order.
    """
    spark = rows.sparkSession
    every = [1 << BITS] * LEVELS + [1 << (64 - BITS * LEVELS)]
    state, done = {p: ([], 0) for p in quota}, {}
    for level in range(LEVELS + 1):
        if not state:
            break
        if level == 0:
            part = rows
        else:
            prefix = spark.createDataFrame([(p, *digits) for p, (digits, _) in state.items()], "pattern long, " + ", ".join(f"d{i} long" for i in range(level)))
            on = [rows["pattern"] == prefix["pattern"], *(_slot(rows["h"], i) == prefix[f"d{i}"] for i in range(level))]
            part = rows.join(F.broadcast(prefix), on, "left_semi")
        sums: dict[int, list[tuple[int, int, int, int]]] = {}
        for r in part.groupBy("pattern", _slot(F.col("h"), level).alias("slot")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high")).collect():
            sums.setdefault(r["pattern"], []).append((r["slot"], r["size"], r["low"], r["high"]))
        open_ = {}
        for p, (digits, taken) in state.items():
            for slot, size, low, high in sorted(sums.get(p, [])):
                if taken + size > quota[p]:
                    if low == high:
                        done[p] = (_digits(low), taken)
                    else:
                        open_[p] = ([*digits, slot], taken)
                    break
                taken += size
            else:
                done[p] = (every, taken)
        state = open_
    return done


def _digits(h: int) -> list[int]:
    return [(h >> (64 - BITS * (k + 1))) & ((1 << BITS) - 1) for k in range(LEVELS)] + [h & ((1 << (64 - BITS * LEVELS)) - 1)]


def _turned(digits: list[int]) -> int | None:
    """The hash of the digits, turned; none for digits beyond all hashes."""
    if digits[0] >> BITS:
        return None
    h = 0
    for d in digits[:LEVELS]:
        h = h << BITS | d
    return (h << (64 - BITS * LEVELS) | digits[LEVELS]) + TURN


PASSES = "array<struct<after:long,before:long,least:long,most:long>>"


def plan_mix(rows: DataFrame, members: dict[int, tuple], weights: Sequence[int] = (3, 1, 2), factor: float = 1.5, copies: int = 2) -> tuple[DataFrame, dict, dict]:
    """The plan by pattern (whole copies, passes, the closing hash), targets and sizes by source.

    ``rows``: pattern, h, size; ``members``: the sources of each pattern.
    """
    spark = rows.sparkSession
    size = {r["pattern"]: r["size"] or 0 for r in rows.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    sizes: dict = {}
    for p, n in size.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    targets = targets_of(sizes, weights, factor, copies)
    order = sorted(size)
    took = dict(zip(order, route([(members[p], size[p]) for p in order], targets, copies)))
    whole = {p: min(copies, took[p] // size[p]) if size[p] else 0 for p in order}
    missing = {p: rest for p in order if whole[p] < copies and (rest := took[p] - whole[p] * size[p]) > 0}
    passes: dict[int, list[tuple]] = {p: [] for p in order}
    best: dict[int, tuple] = {}  # by pattern: words off the target, minus the passes, the closing hash
    going = dict(missing)
    while going:
        if any(passes[p] for p in going):
            at = spark.createDataFrame([(p, passes[p][-1][1], n) for p, n in going.items()], "pattern long, after long, most long")
            free = rows.join(F.broadcast(at), "pattern").filter((_key(F.col("h")) > F.col("after")) & F.col("size").between(1, F.col("most"))).select("pattern", "h", "size")
        else:
            free = rows
        for p, (digits, taken) in thresholds(free, going).items():
            after = passes[p][-1][1] if passes[p] else None
            passes[p].append((after, _turned(digits), 1 if passes[p] else 0, missing[p] if passes[p] else None))
            missing[p] -= taken
        for p, n, h in _nearest(rows, passes, {p: missing[p] for p in going if missing[p]}):
            best[p] = min(best.get(p, (n, 0, None)), (n, -len(passes[p]), h), key=lambda b: b[:2])
        going = {p: missing[p] for p in going if missing[p] and passes[p][-1][1] is not None}
    plan = []
    for p in order:
        if p in best and best[p][0] < missing[p]:
            plan.append((p, whole[p], passes[p][: -best[p][1]], best[p][2]))
        else:
            plan.append((p, whole[p], passes[p], None))
    return spark.createDataFrame(plan, f"pattern long, whole long, passes {PASSES}, closing long"), targets, sizes


def _nearest(rows: DataFrame, passes: dict[int, list[tuple]], missing: dict[int, int]) -> list[tuple[int, int, int]]:
    """(pattern, words off the target, hash) of the one document that, taken besides, comes nearest to the target."""
    if not missing:
        return []
    plan = rows.sparkSession.createDataFrame([(p, n, passes[p]) for p, n in missing.items()], f"pattern long, missing long, passes {PASSES}")
    free = rows.filter("size > 0").join(F.broadcast(plan), "pattern").filter((F.col("size") < 2 * F.col("missing")) & ~_passed(F.col("passes"), F.col("h"), F.col("size")))
    alike = free.groupBy("pattern", "h").agg((F.sum("size") - F.first("missing")).alias("over"), F.first("missing").alias("missing"))
    near = alike.filter(F.abs("over") < F.col("missing")).groupBy("pattern").agg(F.min(F.struct(F.abs("over").alias("off"), "h")).alias("x"))
    return [(r["pattern"], r["off"], r["h"]) for r in near.select("pattern", "x.off", "x.h").collect()]


def _key(h: Column) -> Column:
    return h.bitwiseXOR(F.lit(TURN))


def _passed(passes: Column, h: Column, size: Column) -> Column:
    """Whether some pass takes a document: between its ends, and of a size that it looks at."""
    return F.exists(
        passes,
        lambda p: (p["after"].isNull() | (_key(h) > p["after"]))
        & (p["before"].isNull() | (_key(h) < p["before"]))
        & (size >= p["least"])
        & (p["most"].isNull() | (size <= p["most"])),
    )


def _taken(h: Column, size: Column, plan=F.col) -> Column:
    more = _passed(plan("passes"), h, size) | F.coalesce(plan("closing") == h, F.lit(False))
    return (plan("whole") + more.cast("long")).cast("long")


def _source_ids(docs: DataFrame, source_col: str, max_patterns: int) -> tuple[DataFrame, dict[int, tuple]]:
    """A number for each membership pattern. A string column is a pattern of one source, an array one of several."""
    found = docs.select(source_col).distinct().limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns")
    many = dict(docs.dtypes)[source_col].startswith("array")
    key = lambda r: (r[0] is None, tuple(r[0]) if many and r[0] is not None else r[0] or "")
    found = sorted(found, key=key)
    members = {i: tuple(dict.fromkeys(r[0])) if many and r[0] is not None else (r[0],) for i, r in enumerate(found)}
    ids = docs.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(found)], f"source {dict(docs.dtypes)[source_col]}, pattern long")
    return ids, members


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: Sequence[int] = (3, 1, 2), factor: float = 1.5, copies: int = 2, max_patterns: int = 20_000) -> DataFrame:
    """One narrow row per document: id, source, size, source_size, target, times (whole copies taken), taken (words)."""
    rows, plan, facts = _mix(docs, id_col, text_col, source_col, seed, weights, factor, copies, max_patterns)
    return (
        rows.join(F.broadcast(plan), "pattern")
        .join(F.broadcast(facts), "pattern")
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", _taken(F.col("h"), F.col("size")).alias("times"))
        .withColumn("taken", F.col("size") * F.col("times"))
    )


def _mix(docs, id_col, text_col, source_col, seed, weights, factor, copies, max_patterns):
    ids, members = _source_ids(docs, source_col, max_patterns)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(F.col(text_col)).alias("size"), _hash(seed, id_col, text_col).alias("h"))
    rows = materialize(narrow.join(F.broadcast(ids.toDF("source_", "pattern")), F.col("source").eqNullSafe(F.col("source_"))).drop("source_"), "mix-rows")
    plan, targets, sizes = plan_mix(rows, members, weights, factor, copies)
    facts = docs.sparkSession.createDataFrame(
        [(p, sum(sizes.get(s, 0) for s in members[p]), float(sum(targets.get(s, 0.0) for s in members[p]))) for p in members], "pattern long, source_size long, target double"
    )
    return rows, plan, facts


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: int, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, weights: Sequence[int] = (3, 1, 2), factor: float = 1.5, copies: int = 2, max_patterns: int = 20_000) -> DataFrame:
    """The mixed corpus: rows of ``docs`` with all their columns, each as often as the mix takes it."""
    _, plan, _ = _mix(docs, id_col, text_col, source_col, seed, weights, factor, copies, max_patterns)
    ids, _ = _source_ids(docs, source_col, max_patterns)
    kept = docs.columns
    h, size, times, source = (free_name(kept, x) for x in ("g_hash", "g_size", "g_times", "g_source"))
    plan = ids.withColumnRenamed("source", source).join(plan, "pattern")
    taken = [c for c in plan.columns if c != source]
    plan = plan.select(F.col(source), F.struct(*taken).alias(times))
    rows = docs.withColumns({h: _hash(seed, id_col, text_col), size: _size(F.col(text_col))}).join(F.broadcast(plan), F.col(source_col).eqNullSafe(F.col(source)))
    n = _taken(F.col(h), F.col(size), lambda c: F.col(times)[c]).cast("int")
    return rows.withColumn(times, F.explode(F.array_repeat(F.lit(1), n))).select(*kept)

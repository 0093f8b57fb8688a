"""Late full texts lead to at most one revision of an answer: a keyed state with an event-time timer.

Rows: key, kind (answered, late, rescoped), item, ts. The first answer of a key opens it. The first text that comes later, within
``window``, starts a timer; when the watermark has passed it by ``settle``, one row says which texts the revision takes, or
that it is skipped because the question was rescoped meanwhile. What comes after, further texts and further answers, changes nothing.

Everything is decided by event time, once the watermark says that no earlier row can come, so batches may be cut and ordered in any way within the
watermark's delay. State shrinks to one flag when a key is decided or its window is over; texts before any answer are forgotten
with the watermark.

Defined results: rows without key or time are ignored, a late row without item opens the timer but names none; equal texts count once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "key long, status string, reason string, due_ms long, items array<long>"


def decide(events: DataFrame, window_ms: int = 7 * 86_400_000, settle_ms: int = 6 * 3_600_000, delay: str = "1 day") -> DataFrame:
    """The stream of decisions, one row a key at most."""

    def step(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"answered": None, "late": [], "rescoped": []}
        if held is None:  # decided
            return
        for f in frames:
            for kind, item, ts in zip(f["kind"], f["item"], f["ts"]):
                at = int(ts.value // 1_000_000)
                if kind == "answered":
                    held["answered"] = at if held["answered"] is None else min(at, held["answered"])
                elif kind == "late":
                    held["late"].append([at, None if pd.isna(item) else int(item)])
                elif kind == "rescoped":
                    held["rescoped"].append(at)
        now, opened = state.getCurrentWatermarkMs(), held["answered"]
        if opened is None:  # an answer yet to come is later than the watermark, and so are its texts
            held["late"] = [x for x in held["late"] if x[0] >= now]
            held["rescoped"] = [x for x in held["rescoped"] if x >= now]
            state.update((json.dumps(held),))
            if held["late"] or held["rescoped"]:
                state.setTimeoutTimestamp(max(max([x[0] for x in held["late"]] + held["rescoped"]), now) + 1)
            return
        late = sorted(x for x in held["late"] if opened < x[0] <= opened + window_ms)
        due = late[0][0] + settle_ms if late else opened + window_ms
        if now <= due:
            held["late"] = late if opened < now else held["late"]  # until the watermark passes it, an earlier answer may still come
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(max(due, now) + 1)
            return
        state.update((json.dumps(None),))
        if late:
            moved = any(opened < x <= due for x in held["rescoped"])
            items = sorted({i for at, i in late if at <= due and i is not None})
            row = (key[0], "skipped" if moved else "revised", "scope_revised" if moved else None, due, [] if moved else items)
            yield pd.DataFrame([row], columns=["key", "status", "reason", "due_ms", "items"])

    rows = events.filter("key IS NOT NULL AND ts IS NOT NULL").select("key", "kind", "item", "ts").withWatermark("ts", delay)
    return rows.groupBy("key").applyInPandasWithState(step, SCHEMA, "held string", "append", GroupStateTimeout.EventTimeTimeout)

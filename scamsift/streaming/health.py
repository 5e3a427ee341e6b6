"""Adapter health: whether a page still gives its adapter messages.

A scan reports how many messages it found, whether it failed, and whether the page's
landmarks are there. Three empty scans in a row over at least ten seconds, or one failure,
mean that the adapter is broken; a hit makes it well again. State is kept per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# When misses count as broken.
MISSES, WINDOW_MS = 3, 10_000
SCAN = "tab string, adapter string, now_ms bigint, count int, threw boolean, landmark boolean, has_landmarks boolean"
OUT = "tab string, adapter string, now_ms bigint, status string"


def step(state: tuple[int, int], now: int, count: int, threw: bool, landmark: bool, has_landmarks: bool) -> tuple[tuple[int, int], str]:
    """The state (misses, time of the first) and status after one scan."""
    misses, first = state
    if threw:
        return (0, 0), "broken"
    if count > 0:
        return (0, 0), "ok"
    if not has_landmarks:
        return state, "unknown"
    if not landmark:
        return (0, 0), "idle"
    first = now if misses == 0 else first
    return (misses + 1, first), "broken" if misses + 1 >= MISSES and now - first >= WINDOW_MS else "watching"


def initial(has_landmarks: bool) -> str:
    return "ok" if has_landmarks else "unknown"


def _fold(state: tuple[int, int], scans: pd.DataFrame) -> tuple[tuple[int, int], list[str]]:
    out = []
    for r in scans.itertuples(index=False):
        state, status = step(state, int(r.now_ms), int(r.count if pd.notna(r.count) else 0), bool(r.threw), bool(r.landmark), bool(r.has_landmarks))
        out.append(status)
    return state, out


def health(scans: DataFrame) -> DataFrame:
    """The status after every scan of a table, per (tab, adapter) in order of time.

    Built-in functions only: runs of misses are found with windows, so no task needs more
    than sorted rows of a key. Of scans at the same time failures count first, then hits.
    """
    from pyspark.sql import Window as W

    rows = scans.withColumns({"count": F.coalesce("count", F.lit(0)), **{c: F.coalesce(c, F.lit(False)) for c in ("threw", "landmark", "has_landmarks")}})
    kind = F.when(F.col("threw"), "broken").when(F.col("count") > 0, "ok").when(~F.col("has_landmarks"), "unknown").when(~F.col("landmark"), "idle").otherwise("miss")
    w = W.partitionBy("tab", "adapter").orderBy("now_ms", F.desc("threw"), F.desc("count"), "has_landmarks", "landmark")
    rows = rows.withColumn("kind", kind).withColumn("reset", F.sum(F.col("kind").isin("broken", "ok", "idle").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("tab", "adapter", "reset").orderBy("now_ms", F.desc("threw"), F.desc("count"), "has_landmarks", "landmark").rowsBetween(W.unboundedPreceding, 0)
    miss = F.col("kind") == "miss"
    misses, first = F.sum(miss.cast("int")).over(run), F.min(F.when(miss, F.col("now_ms"))).over(run)
    status = F.when(miss, F.when((misses >= MISSES) & (F.col("now_ms") - first >= WINDOW_MS), "broken").otherwise("watching")).otherwise(F.col("kind"))
    return rows.select("tab", "adapter", "now_ms", status.alias("status"))


def health_stream(scans: DataFrame) -> DataFrame:
    """The same for a stream of scans; within a micro-batch scans are taken in order of time."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else (0, 0)
        scans = pd.concat(list(batches)).sort_values(["now_ms", "threw", "count"], ascending=[True, False, False], kind="stable")
        held, status = _fold(held, scans)
        state.update(held)
        yield pd.DataFrame({"tab": key[0], "adapter": key[1], "now_ms": scans["now_ms"].to_numpy(), "status": status})

    return scans.groupBy("tab", "adapter").applyInPandasWithState(advance, OUT, "misses long, first long", "append", GroupStateTimeout.NoTimeout)

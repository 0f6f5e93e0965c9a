"""Live session rules in their batch form: seeks, liveness, quality, clocks and playback memory."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .frames import recurrence

# Rungs of the quality ladder, best first: mode and bits per second.
RUNGS = [("lossless", 0), ("cbr", 500_000_000), ("cbr", 300_000_000), ("cbr", 200_000_000), ("cbr_lowres", 100_000_000)]
HIGH, LOW, DOWN_AFTER, UP_AFTER = 3, 1, 3, 12


def only_current(df: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the current session or generation of their owner."""
    return df.join(current.select(*keys).distinct(), keys, "left_semi")


def coalesce_seeks(requests: DataFrame, gap: str = "60 milliseconds", ts: str = "ts", tie: list[str] | None = None) -> DataFrame:
    """Bursts of seeks: only the last target of each runs, of equal times the last by ``tie``; how many were folded into it. Works on streams too."""
    return requests.groupBy("session", "session_id", F.session_window(ts, gap)).agg(F.max_by("target_s", F.struct(ts, *(tie or []))).alias("target_s"), F.max(ts).alias("last_ts"), (F.count(F.lit(1)) - 1).alias("coalesced")).drop("session_window")


def liveness(rx: DataFrame, gap: str = "2001 milliseconds", ts: str = "ts") -> DataFrame:
    """Stretches of traffic per peer, each ending in a silence: a session window that also works on streams.

    Windows split at a silence of ``gap`` or more, so it is a little more than the timeout. It knows no current peer:
    ``client_lost`` does.
    """
    return rx.groupBy("session", "peer", F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("packets"), F.max(ts).alias("last_rx")).withColumn("lost_at", F.col("session_window.end")).drop("session_window")


def client_lost(rx: DataFrame, timeout: float, order: list[str], t: str = "t") -> DataFrame:
    """One loss (session, peer, packets, last_rx, lost_at) per silence of the current peer of more than ``timeout``.

    A hello makes its sender the current peer. Hellos and datagrams of the current peer are proofs of life, other peers'
    are not, and nothing counts before the first hello. The last silence is a loss if later traffic of whatever peer
    shows that its time has passed.
    """
    by = Window.partitionBy("session")
    w = by.orderBy(t, *order)
    known = F.last(F.when(F.col("hello"), F.col("peer")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    alive = rx.withColumn("_known", known).withColumn("_end", F.max(t).over(by)).filter(F.col("hello") | (F.col("peer") == F.col("_known")))
    silence = F.coalesce(F.lead(t).over(w), F.col("_end")) - F.col(t)
    marked = alive.withColumn("_lost", silence > timeout)
    before = F.coalesce(F.sum(F.col("_lost").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretch = marked.withColumn("_stretch", before).groupBy("session", "_stretch")
    out = stretch.agg(F.max_by("peer", F.struct(t, *order)).alias("peer"), F.count(F.lit(1)).alias("packets"), F.max(t).alias("last_rx"), F.bool_or("_lost").alias("_lost"))
    return out.filter("_lost").withColumn("lost_at", F.col("last_rx") + timeout).drop("_stretch", "_lost")


def ladder_steps(depths, underruns, start: int = 0, floor: int = 4, state: tuple[int, int, int] | None = None) -> tuple[list[int], tuple[int, int, int]]:
    """Rung after each feedback sample; state is (rung, pressed, stable)."""
    rung, pressed, stable = state or (start, 0, 0)
    out = []
    for depth, under in zip(depths, underruns, strict=True):
        if under or depth > HIGH:
            stable, pressed = 0, pressed + 1
            if pressed >= DOWN_AFTER:
                pressed, rung = 0, max(rung, min(rung + 1, floor))
        else:
            pressed = 0
            stable = stable + 1 if depth <= LOW and rung > start else 0
            if stable >= UP_AFTER:
                stable, rung = 0, rung - 1
        out.append(rung)
    return out, (rung, pressed, stable)


def ladder(feedback: DataFrame, order: list[str], start: int = 0, floor: int = 4) -> DataFrame:
    """Adds ``rung``: three samples of pressure step down, twelve calm ones step up, those between reset calm only."""

    def step(pdf: pd.DataFrame, state: list | None) -> tuple[dict, list]:
        rungs, now = ladder_steps(pdf["queue_depth"].tolist(), pdf["underrun"].tolist(), start, floor, state)
        return {"rung": rungs}, list(now)

    return scan.carried(feedback, ["session"], order, "rung int", step)


#: How far a cursor may part from the clock before it jumps, the share of a smaller gap it makes good at once, and its most.
JUMP_MS, PULL, MOST_PULL_MS = 250.0, 0.25, 1.0


def follow(at: float | None, clock: float | None, step: float) -> float:
    """Where a cursor stands a frame after ``at``; ``clock`` is null unless it has moved since the frame before."""
    if at is None:
        return clock or 0.0
    ahead = at + step
    if clock is None:
        return ahead
    gap = clock - ahead
    return clock if abs(gap) > JUMP_MS else ahead + max(-MOST_PULL_MS, min(MOST_PULL_MS, PULL * gap))


def cursor_steps(clocks, fps: float, state: tuple[float | None, float | None] = (None, None)) -> tuple[list[int], tuple[float | None, float | None]]:
    """Phase-locked pts for each frame; state is (cursor, last clock)."""
    at, seen = state
    out = []
    for c in (None if c is None or c != c else float(c) for c in clocks):
        new = c is not None and (seen is None or abs(c - seen) > 0.001)
        at = follow(at, c if new or at is None else None, 1000.0 / max(1.0, fps))
        seen = c if new else seen
        out.append(round(at))
    return out, (at, seen)


def pts_cursor(frames: DataFrame, order: list[str], fps: float, clock: str = "clock_ms") -> DataFrame:
    """Adds ``pts_ms``: it advances by the frame time, is pulled gently to the clock and snaps to it after a jump."""

    def step(pdf: pd.DataFrame, state: list | None) -> tuple[dict, list]:
        pts, now = cursor_steps(pdf[clock], fps, state or (None, None))
        return {"pts_ms": pts}, list(now)

    return scan.carried(frames, ["session"], order, "pts_ms bigint", step)


def stamp_steps(pts, frame_s: float, base_s: float = 0.0, state: tuple[float | None, list[float]] | None = None) -> tuple[list[float], tuple[float | None, list[float]]]:
    """The stamp of each frame that pushes its pts; state is (last stamp, pending pts)."""
    last, held = state or (None, [])
    pending, out = list(held), []
    heapq.heapify(pending)
    for p in pts:
        if p is not None and p == p:
            heapq.heappush(pending, float(p))
        expected, window = (base_s, 3.0) if last is None else (last + frame_s, 0.5)
        while pending and pending[0] < expected - window:
            heapq.heappop(pending)
        last = heapq.heappop(pending) if pending and pending[0] <= expected + window else expected
        out.append(last)
    return out, (last, sorted(pending))


def assign_pts_live(frames: DataFrame, order: list[str], frame_s: float, base_s: float = 0.0) -> DataFrame:
    """Adds ``emit_pts``: each frame pushes its ``pts_s`` and is stamped with the smallest pending one near what is expected.

    Stale entries are dropped (3 s for the first frame, then half a second); without a plausible one the last stamp
    plus the frame time counts.
    """

    def step(pdf: pd.DataFrame, state: list | None) -> tuple[dict, list]:
        out, now = stamp_steps(pdf["pts_s"].tolist(), frame_s, base_s, state)
        return {"emit_pts": out}, list(now)

    return scan.carried(frames, ["session"], order, "emit_pts double", step)


def progress_steps(kinds, pts, ids, cap: int = 8, state: tuple[int | None, list] | None = None) -> tuple[list[tuple], tuple[int | None, list]]:
    """What leaves the buffer, as (id, pts, fate, clock), while events come; state is (audio clock, held (pts, id))."""
    clock, start = state or (None, [])
    held, out = [tuple(h) for h in start], []
    heapq.heapify(held)
    for kind, p, i in zip(kinds, pts, ids, strict=True):
        if kind == "audio":
            clock = p if clock is None else max(clock, p)
        else:
            heapq.heappush(held, (p, i))
            if len(held) > cap:
                q, k = heapq.heappop(held)
                out.append((k, q, "dropped", None))
        while clock is not None and held and held[0][0] <= clock:
            q, k = heapq.heappop(held)
            out.append((k, q, "released", clock))
    return out, (clock, sorted(held))


def jitter_buffer(events: DataFrame, order: list[str], cap: int = 8) -> DataFrame:
    """Frames with ``fate``: released by the audio seen so far, dropped as the oldest over the cap, or flushed at the end.

    ``events`` hold (session, kind 'audio' or 'video', pts_ms); the audio clock never steps back. The result has the
    video rows with the clock at which each left.
    """

    def step(pdf: pd.DataFrame) -> dict:
        gone, (_, held) = progress_steps(pdf["kind"].tolist(), pdf["pts_ms"].tolist(), range(len(pdf)), cap)
        fate, left = [None] * len(pdf), [None] * len(pdf)
        for k, _, what, clock in [*gone, *((k, p, "flushed", None) for p, k in held)]:
            fate[k], left[k] = what, clock
        return {"fate": fate, "clock_ms": pd.array(left, "Int64")}

    return recurrence(events, ["session"], order, "fate string, clock_ms bigint", step).filter("kind = 'video'")


def upsert_memory(changes: DataFrame, store: DataFrame | None = None, n: int = 400) -> DataFrame:
    """Records (store, media_key, updated, fields) after merging field changes: null deletes, empty records go, ``n`` stay.

    ``changes`` hold (store, media_key, updated, field, value), ``store`` records of an earlier merge.
    """
    from .ranks import prune

    rows = changes.select("store", "media_key", "updated", "field", "value", F.lit(1).alias("_new"))
    if store is not None:
        old = store.select("store", "media_key", "updated", F.explode("fields").alias("field", "value"), F.lit(0).alias("_new"))
        rows = rows.unionByName(old)
    when = F.struct("_new", "updated", F.coalesce("value", F.lit("")))
    last = rows.groupBy("store", "media_key", "field").agg(F.max_by("value", when).alias("value"), F.max("updated").alias("updated"))
    kept = F.filter(F.collect_list(F.struct("field", "value")), lambda e: e["value"].isNotNull())
    merged = last.groupBy("store", "media_key").agg(F.max("updated").alias("updated"), F.array_sort(kept).alias("_f")).filter(F.size("_f") > 0)
    return prune(merged.select("store", "media_key", "updated", F.map_from_entries("_f").alias("fields")), n=n)

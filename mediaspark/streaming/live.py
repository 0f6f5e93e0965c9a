"""Structured Streaming forms of the live rules. Late rows are dropped by the watermark.

State of sessions that are over does not stay where rows have an event time ``ts``: timers clear it.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import islands, sessions, telemetry, timeline

REORDER = 5
#: How long a session may be without rows before its state goes.
IDLE_MS = 3_600_000
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _stateful(df: DataFrame, by: str, step: Callable, schema: str, state: str, idle_ms: int, delay: str = "1 second") -> DataFrame:
    """``step`` over the batches of each group. With an event time ``ts`` a group that is idle for so long loses its state.

    Without ``ts`` nothing says when a group is over, and its state stays. (A timeout by the clock of the machine would keep
    a stream that takes what is available from ever ending.)
    """
    if "ts" not in df.columns:
        return df.groupBy(by).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)

    @functools.wraps(step)
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = list(batches)
        yield from step(key, iter(rows), state)
        state.setTimeoutTimestamp(max(int(pdf["event_ms"].max()) for pdf in rows if len(pdf)) + idle_ms)

    marked = df.withWatermark("ts", delay).withColumn("event_ms", F.unix_millis("ts"))
    return marked.groupBy(by).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


class _Walk(StatefulProcessor):
    """Rows of a session in order through ``step``, its state as one JSON value; ``flush`` at the end of the session.

    A session ends when the watermark is ``idle_ms`` past its last row; then nothing of it stays. One timer stands at a
    time: when it fires and rows have come since, it is set again.
    """

    def __init__(self, order: str, step: Callable, flush: Callable | None, idle_ms: int):
        self.order, self.step, self.flush, self.idle_ms = order, step, flush, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("walk", "body string, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        body, last = self.kept.get() if self.kept.exists() else (None, None)
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out, state = self.step(key, pdf, json.loads(body) if body else None)
        newest = int(pdf["event_ms"].max())
        self.kept.update((json.dumps(state), newest if last is None else max(last, newest)))
        if last is None:
            self.handle.registerTimer(newest + self.idle_ms)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        body, last = self.kept.get()
        if last + self.idle_ms > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(last + self.idle_ms)
            return
        self.kept.clear()
        if self.flush:
            yield self.flush(key, json.loads(body))

    def close(self) -> None:
        pass


def _processed(df: DataFrame, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    """``df`` by session through a processor with event-time timers, which need the RocksDB state store."""
    if "RocksDB" not in df.sparkSession.conf.get(_STORE):
        raise ValueError(f"{_STORE} must name the RocksDB provider")
    marked = df.withWatermark("ts", delay).withColumn("event_ms", F.unix_millis("ts"))
    return marked.groupBy("session").transformWithStateInPandas(processor, schema, "Append", "EventTime")


class _Alive(StatefulProcessor):
    """The current peer of a session and its last proof of life; rows wait in a list until the watermark has passed them."""

    def __init__(self, timeout_ms: int, forget_ms: int, row: str):
        self.timeout_ms, self.forget_ms, self.row = timeout_ms, forget_ms, row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.row)
        self.kept = handle.getValueState("alive", "body string")

    def _settle(self, key: tuple, rows: list[tuple], upto: int) -> Iterator[pd.DataFrame]:
        """Take the rows that the watermark has passed, in order, report what is lost, and set the next timer."""
        (body,) = self.kept.get() if self.kept.exists() else (None,)
        known, count, peer, last, lost, newest = json.loads(body) if body else (None, 0, None, None, True, 0)
        due = sorted((r for r in rows if r[0] <= upto), key=lambda r: r[:2])
        wait = [r for r in rows if r[0] > upto]
        out = []

        def silent(now: int) -> bool:
            return not lost and now - last > self.timeout_ms

        for ms, _, sender, hello in due:
            newest = max(newest, ms)
            if silent(ms):
                out.append((key[0], peer, count, last, last + self.timeout_ms))
                lost = True
            if hello or (known is not None and sender == known):
                count = 1 if lost else count + 1
                known, peer, last, lost = (sender if hello else known), sender, ms, False
        if silent(upto):
            out.append((key[0], peer, count, last, last + self.timeout_ms))
            lost = True
        if not wait and newest + self.forget_ms <= upto:
            self.kept.clear()
            self.held.clear()
        else:
            self.kept.update((json.dumps((known, count, peer, last, lost, newest)),))
            self.held.put(wait) if wait else self.held.clear()
            next_ms = min([r[0] for r in wait] + [newest + self.forget_ms if lost else last + self.timeout_ms + 1])
            if next_ms not in [*self.handle.listTimers()]:
                self.handle.registerTimer(max(next_ms, upto + 1))
        yield pd.DataFrame(out, columns=["session", "peer", "packets", "last_ms", "lost_ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(m), int(o), p, bool(h)) for pdf in rows for m, o, p, h in zip(pdf["event_ms"].tolist(), pdf["seq"].tolist(), pdf["peer"].tolist(), pdf["hello"].tolist(), strict=True)]
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        yield from self._settle(key, held + new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        yield from self._settle(key, held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def client_lost(rx: DataFrame, timeout_ms: int, delay: str = "1 second", forget_ms: int = 24 * IDLE_MS) -> DataFrame:
    """One loss (session, peer, packets, last_rx, lost_at) per silence of the current peer, as the time for it passes.

    ``rx`` holds (session, peer, hello, seq, ts). The rule of ``sessions.client_lost``: a hello makes its sender the
    current peer, hellos and its datagrams are proofs of life. Rows are taken in order of ``ts`` and ``seq`` when the
    watermark has passed them; a timer at the last proof of life plus the timeout raises one alert, and no other before
    the next proof. Here the watermark, which any session moves on, says that the time has passed. A session without rows
    for ``forget_ms`` is forgotten with its peer.
    """
    peer, session = (rx.schema[c].dataType.simpleString() for c in ("peer", "session"))
    rows = rx.select("session", "peer", "hello", F.col("seq").cast("bigint").alias("seq"), "ts").filter("ts IS NOT NULL AND session IS NOT NULL")
    alive = _Alive(timeout_ms, forget_ms, f"ms bigint, seq bigint, peer {peer}, hello boolean")
    out = _processed(rows, alive, f"session {session}, peer {peer}, packets bigint, last_ms bigint, lost_ms bigint", delay)
    return out.select("session", "peer", "packets", F.timestamp_millis("last_ms").alias("last_rx"), F.timestamp_millis("lost_ms").alias("lost_at"))


def audio_progress(events: DataFrame, cap: int = 8, delay: str = "1 second", idle_ms: int = IDLE_MS) -> DataFrame:
    """Frames (session, seq, pts_ms, fate, clock_ms) as they leave the buffer, the rest flushed when their session is over.

    ``events`` hold (session, seq, kind, pts_ms, ts); the rule is that of ``sessions.jitter_buffer``, with at most ``cap``
    frames in the state of a session.
    """

    def frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame([(key[0], *r) for r in rows], columns=["session", "seq", "pts_ms", "fate", "clock_ms"])
        return out.astype({"clock_ms": "Int64"})

    def step(key: tuple, pdf: pd.DataFrame, state: list | None) -> tuple[pd.DataFrame, list]:
        gone, now = sessions.progress_steps(pdf["kind"].tolist(), pdf["pts_ms"].tolist(), pdf["seq"].tolist(), cap, state)
        return frame(key, gone), list(now)

    def flush(key: tuple, state: list) -> pd.DataFrame:
        return frame(key, [(i, p, "flushed", None) for p, i in state[1]])

    kinds = {c: events.schema[c].dataType.simpleString() for c in ("session", "seq", "pts_ms")}
    return _processed(events, _Walk("seq", step, flush, idle_ms), f"session {kinds['session']}, seq {kinds['seq']}, pts_ms {kinds['pts_ms']}, fate string, clock_ms bigint", delay)


def assign_pts(frames: DataFrame, frame_s: float, base_s: float = 0.0, delay: str = "1 second", idle_ms: int = IDLE_MS) -> DataFrame:
    """Stamps (session, seq, emit_pts) of frames (session, seq, pts_s, ts), by the rule of ``sessions.assign_pts_live``."""

    def step(key: tuple, pdf: pd.DataFrame, state: list | None) -> tuple[pd.DataFrame, list]:
        stamps, now = sessions.stamp_steps(pdf["pts_s"].tolist(), frame_s, base_s, state)
        return pd.DataFrame({"session": key[0], "seq": pdf["seq"].to_numpy(), "emit_pts": stamps}), list(now)

    kinds = {c: frames.schema[c].dataType.simpleString() for c in ("session", "seq")}
    return _processed(frames, _Walk("seq", step, None, idle_ms), f"session {kinds['session']}, seq {kinds['seq']}, emit_pts double", delay)


def backoff(lived: DataFrame, delay: str = "1 second", idle_ms: int = IDLE_MS, stable_s: float = 5.0, first_ms: int = 250, most_ms: int = 3000) -> DataFrame:
    """Waits (session, seq, wait_ms) after connections (session, seq, lived_s, ts), by the rule of ``islands.backoff``."""

    def step(key: tuple, pdf: pd.DataFrame, state: list | None) -> tuple[pd.DataFrame, list]:
        waits, short = islands.backoff_steps(pdf["lived_s"].tolist(), stable_s, first_ms, most_ms, state[0] if state else 0)
        return pd.DataFrame({"session": key[0], "seq": pdf["seq"].to_numpy(), "wait_ms": waits}), [short]

    kinds = {c: lived.schema[c].dataType.simpleString() for c in ("session", "seq")}
    return _processed(lived, _Walk("seq", step, None, idle_ms), f"session {kinds['session']}, seq {kinds['seq']}, wait_ms bigint", delay)


def coalesce_seeks(requests: DataFrame, delay: str = "1 second") -> DataFrame:
    return sessions.coalesce_seeks(requests.withWatermark("ts", delay))


def liveness(rx: DataFrame, delay: str = "1 second") -> DataFrame:
    return sessions.liveness(rx.withWatermark("ts", delay))


def status_per_second(status: DataFrame, delay: str = "1 second") -> DataFrame:
    return telemetry.status_per_second(status.withWatermark("ts", delay))


def reorder_cuts(frames: DataFrame, threshold: float = 0.42, idle_ms: int = IDLE_MS) -> DataFrame:
    """Cuts (stream_id, pts_ms) from rows (stream_id, pts_ms, hist) that may arrive out of order.

    A buffer of REORDER frames per stream puts them in order; a frame that is not newer than the one analysed before it
    gives no cut, and the next is compared with it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pts, hists, last, last_hist = state.get if state.exists else ([], [], None, None)
        held = [(p, list(h)) for p, h in zip(pts, hists, strict=True)]
        cuts = []

        def analyse() -> None:
            nonlocal last, last_hist
            (p, h), before, then = held.pop(0), last, last_hist
            last, last_hist = p, h
            if before is not None and p > before and 0.5 * sum(abs(a - b) for a, b in zip(h, then, strict=True)) >= threshold:
                cuts.append(p)

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                held.append((float(r.pts_ms), [float(x) for x in r.hist]))
                held.sort(key=lambda e: e[0])
                if len(held) > REORDER:
                    analyse()
        state.update(([p for p, _ in held], [h for _, h in held], last, last_hist))
        yield pd.DataFrame({"stream_id": [key[0]] * len(cuts), "pts_ms": cuts})

    kept = "pts array<double>, hists array<array<double>>, last double, last_hist array<double>"
    kind = frames.schema["stream_id"].dataType.simpleString()
    return _stateful(frames, "stream_id", step, f"stream_id {kind}, pts_ms double", kept, idle_ms)


def reassemble(datagrams: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Payloads as they become complete; a datagram of another seq abandons the unit in progress."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, count, at, parts = state.get if state.exists else (None, 0, [], [])
        have = dict(zip(at, parts, strict=True))
        done = []
        rows = pd.concat(list(batches)).sort_values("rx", kind="stable")
        for r in rows.itertuples(index=False):
            if r.seq != seq:
                seq, count, have = r.seq, r.frag_cnt, {}
            have[r.frag_idx] = r.payload
            if len(have) >= count:
                done.append((key[0], seq, count, "".join(have[k] for k in sorted(have))))
                seq, count, have = None, 0, {}
        state.update((None if seq is None else int(seq), int(count), [int(k) for k in have], list(have.values())))
        yield pd.DataFrame(done, columns=["session", "seq", "fragments", "payload"])

    kind = datagrams.schema["session"].dataType.simpleString()
    return _stateful(timeline.valid_fragments(datagrams), "session", step, f"session {kind}, seq bigint, fragments bigint, payload string", "seq bigint, count bigint, at array<bigint>, parts array<string>", idle_ms)


def ladder(feedback: DataFrame, start: int = 0, floor: int = 4, idle_ms: int = IDLE_MS) -> DataFrame:
    """The rung of each session after each feedback sample."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        rungs, now = sessions.ladder_steps(rows["queue_depth"], rows["underrun"], start, floor, tuple(state.get) if state.exists else None)
        state.update(tuple(int(x) for x in now))
        yield pd.DataFrame({"session": key[0], "t": rows["t"].to_numpy(), "rung": rungs})

    kinds = {c: feedback.schema[c].dataType.simpleString() for c in ("session", "t")}
    return _stateful(feedback, "session", step, f"session {kinds['session']}, t {kinds['t']}, rung int", "rung int, pressed int, stable int", idle_ms)


def pts_cursor(frames: DataFrame, fps: float, idle_ms: int = IDLE_MS) -> DataFrame:
    """Phase-locked pts of each frame of a session."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        pts, now = sessions.cursor_steps(rows["clock_ms"], fps, tuple(state.get) if state.exists else (None, None))
        state.update(now)
        yield pd.DataFrame({"session": key[0], "t": rows["t"].to_numpy(), "pts_ms": pts})

    kinds = {c: frames.schema[c].dataType.simpleString() for c in ("session", "t")}
    return _stateful(frames, "session", step, f"session {kinds['session']}, t {kinds['t']}, pts_ms bigint", "cursor double, last double", idle_ms)


def throttle(events: DataFrame, gap: float, idle_ms: int = IDLE_MS) -> DataFrame:
    """Recovery requests, at most one per ``gap`` of each session."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for t in pd.concat(list(batches))["t"].sort_values():
            if last is None or t - last >= gap:
                last = float(t)
                kept.append(last)
        state.update((last,))
        yield pd.DataFrame({"session": [key[0]] * len(kept), "t": kept})

    kind = events.schema["session"].dataType.simpleString()
    return _stateful(events, "session", step, f"session {kind}, t double", "last double", idle_ms)


def remember(path: str):
    """A ``foreachBatch`` writer that merges field changes into the records below ``path``.

    Each batch writes a new version beside the old one, which stays readable until the pointer table is replaced.
    """

    def write(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        versions = f"{path}/versions"
        try:
            last = spark.read.parquet(f"{path}/pointer").agg(F.max("version")).first()[0]
        except Exception as error:  # the first batch finds no pointer
            if "PATH_NOT_FOUND" not in str(error):
                raise
            last = None
        store = spark.read.parquet(f"{versions}/{last}") if last is not None else None
        sessions.upsert_memory(changes, store).write.mode("overwrite").parquet(f"{versions}/{batch}")
        spark.range(1).select(F.lit(batch).cast("bigint").alias("version")).write.mode("append").parquet(f"{path}/pointer")

    return write

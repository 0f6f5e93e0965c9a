"""Each streaming form over micro-batches equals its batch twin."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mediaspark.operators import frames, islands, sessions, timeline
from mediaspark.streaming import live


def feed(spark, tmp_path, batches, schema, transform, mode="append", state=None):
    """Write one file per micro-batch, run the stream to its end, return its rows; ``state`` gets the rows kept after each batch."""
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{k:03d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    name = f"t{random.randrange(10**9)}"
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    assert q.exception() is None
    if state is not None:
        state += [sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress]
    return [tuple(r) for r in spark.table(name).collect()]


def split(rows, n):
    return [rows[k : k + n] for k in range(0, len(rows), n)]


def test_ladder(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, float(k), rng.randrange(6), rng.random() < 0.1) for k in range(40) for s in range(2)]
    schema = "session int, t double, queue_depth int, underrun boolean"
    got = feed(spark, tmp_path, split(rows, 27), schema, live.ladder)
    want = sessions.ladder(spark.createDataFrame(rows, schema), ["t"]).select("session", "t", "rung").collect()
    assert sorted(got) == sorted(map(tuple, want))


def test_cursor(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, float(k), None if k % 3 else k * 41.7 + rng.random()) for k in range(40)]
    schema = "session int, t double, clock_ms double"
    got = feed(spark, tmp_path, split(rows, 9), schema, lambda s: live.pts_cursor(s, 24.0))
    want = sessions.pts_cursor(spark.createDataFrame(rows, schema), ["t"], 24.0).select("session", "t", "pts_ms").collect()
    assert sorted(got) == sorted(map(tuple, want))


def test_throttle(spark, tmp_path):
    rows = [(s, float(k)) for k in range(30) for s in range(2)]
    got = feed(spark, tmp_path, split(rows, 11), "session int, t double", lambda s: live.throttle(s, 2.5))
    want = frames.throttle(spark.createDataFrame(rows, "session int, t double"), ["session"], ["t"], 2.5, "t").collect()
    assert sorted(got) == sorted(map(tuple, want))


def test_reorder_cuts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1, float(k), [1.0, 0.0] if k // 7 % 2 else [0.0, 1.0]) for k in range(42)]
    shuffled = [r for block in split(rows, 3) for r in rng.sample(block, len(block))]
    got = feed(spark, tmp_path, split(shuffled, 3), "stream_id int, pts_ms double, hist array<double>", live.reorder_cuts)
    assert sorted(p for _, p in got) == [7.0, 14.0, 21.0, 28.0, 35.0]


def test_reassemble(spark, tmp_path):
    rows = [(1, q, 10 * q + k, k, 3, f"{q}{'abc'[k]}") for q in range(6) for k in range(3) if not (q == 4 and k == 1)]
    schema = "session int, seq bigint, rx bigint, frag_idx int, frag_cnt int, payload string"
    got = feed(spark, tmp_path, split(rows, 5), schema, live.reassemble)
    want = timeline.reassemble(spark.createDataFrame(rows, schema)).collect()
    assert sorted(got) == sorted(map(tuple, want)) and len(got) == 5


@pytest.mark.parametrize("form", ["seeks", "liveness", "status"])
def test_windows(spark, tmp_path, form):
    at = [0, 20, 40, 200, 230, 5000, 5010, 9_000_000]
    if form == "seeks":
        rows = [("s", 1, t, float(k)) for k, t in enumerate(at)]
        stamp = lambda d: d.select("session", "session_id", F.timestamp_millis("ms").alias("ts"), "target_s")
        got = feed(spark, tmp_path, split(rows, 3), "session string, session_id int, ms bigint, target_s double", lambda s: live.coalesce_seeks(stamp(s)).select("target_s", "coalesced"))
        assert sorted(got) == [(2.0, 2), (4.0, 1), (6.0, 1)]
    elif form == "liveness":
        rows = [("s", "p", t) for t in at]
        stamp = lambda d: d.select("session", "peer", F.timestamp_millis("ms").alias("ts"))
        got = feed(spark, tmp_path, split(rows, 3), "session string, peer string, ms bigint", lambda s: live.liveness(stamp(s)).select("packets"))
        assert sorted(got) == [(2,), (5,)]
    else:
        rows = [("s", t, 1, k % 2, "cbr") for k, t in enumerate(at)]
        stamp = lambda d: d.select("session", F.timestamp_millis("ms").alias("ts"), "frames", "drops", "mode")
        got = feed(spark, tmp_path, split(rows, 3), "session string, ms bigint, frames bigint, drops bigint, mode string", lambda s: live.status_per_second(stamp(s)).select("frames", "drops", "mode"))
        assert sorted(got) == [(2, 1, "cbr"), (5, 2, "cbr")]


def test_remember(spark, tmp_path):
    schema = "store string, media_key string, updated bigint, field string, value string"
    batches = [[("s", "a", 1, "x", "1")], [("s", "b", 2, "y", "2"), ("s", "a", 2, "x", None)], [("s", "b", 3, "y", "3")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(live.remember(str(tmp_path / "store"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    last = spark.read.parquet(str(tmp_path / "store" / "pointer")).agg(F.max("version")).first()[0]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "store" / "versions" / str(last))).select("media_key", "fields").collect()] == [("b", {"y": "3"})]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def timed(df):
    return df.withColumn("ts", F.timestamp_millis("ms"))


#: A row of another session, much later, that moves the watermark past all others.
LATE = 10_000_000


def test_client_lost_with_foreign_peers_and_hellos(spark, tmp_path, rocks):
    rng = random.Random(4)
    rows = []
    for s in range(3):
        ms = 0
        for k in range(60):
            ms += rng.choice([100, 400, 900, 2500])
            rows.append((s, rng.randrange(3), rng.random() < 0.15, k, ms))
        rows.append((s, 9, False, 99, ms + 50_000))  # a foreign datagram that shows in both forms that time has passed
    schema = "session int, peer int, hello boolean, seq int, ms bigint"
    order = sorted(rows, key=lambda r: r[4] + rng.randrange(300))  # a little out of order, within the watermark's delay
    state: list[int] = []
    late = [[(7, 0, False, 0, LATE)], [(8, 0, False, 0, LATE + 1_000_000)]]
    got = feed(spark, tmp_path, [*split(order, 16), *late], schema, lambda d: live.client_lost(timed(d), 2000, "400 milliseconds", 600_000).selectExpr("session", "peer", "packets", "unix_millis(last_rx)", "unix_millis(lost_at)"), state=state)
    want = sessions.client_lost(spark.createDataFrame(rows, schema), 2000, ["seq"], "ms").select("session", "peer", "packets", "last_rx", "lost_at").collect()
    assert sorted(got) == sorted(map(tuple, want)) and len(want) > 10
    assert state[-1] < max(state)  # what is left is of the sessions that came last


def test_audio_progress_live(spark, tmp_path, rocks):
    rng = random.Random(5)
    rows = [(s, k, "audio" if rng.random() < 0.4 else "video", 40 * k + rng.randrange(-200, 400), 1000 + 40 * k) for k in range(60) for s in range(2)]
    schema = "session int, seq int, kind string, pts_ms bigint, ms bigint"
    state: list[int] = []
    late = [[(9, 0, "audio", 0, LATE)], [(9, 1, "audio", 0, LATE + 10_000)]]
    got = feed(spark, tmp_path, [*split(rows, 17), *late], schema, lambda d: live.audio_progress(timed(d), 4, "1 second", 60_000), state=state)
    want = sessions.jitter_buffer(spark.createDataFrame(rows, schema), ["seq"], 4).select("session", "seq", "pts_ms", "fate", "clock_ms").collect()
    assert sorted(got, key=repr) == sorted(map(tuple, want), key=repr) and {r[3] for r in got} == {"released", "dropped", "flushed"}
    assert state[-1] < max(state)


def test_assign_pts_and_backoff_live(spark, tmp_path, rocks):
    rng = random.Random(6)
    rows = [(s, k, None if rng.random() < 0.1 else k / 24 + rng.randrange(3) / 24, 1.0 if rng.random() < 0.8 else 9.0, 1000 + 40 * k) for k in range(50) for s in range(2)]
    schema = "session int, seq int, pts_s double, lived_s double, ms bigint"
    late = [[(9, 0, 0.0, 1.0, LATE)], [(9, 1, 0.0, 1.0, LATE + 10_000)]]
    df = spark.createDataFrame(rows, schema)
    state: list[int] = []
    got = feed(spark, tmp_path / "a", [*split(rows, 21), *late], schema, lambda d: live.assign_pts(timed(d), 1 / 24, idle_ms=60_000), state=state)
    want = sessions.assign_pts_live(df, ["seq"], 1 / 24).select("session", "seq", "emit_pts").collect()
    assert sorted(r for r in got if r[0] < 9) == sorted(map(tuple, want)) and state[-1] < max(state)
    got = feed(spark, tmp_path / "b", [*split(rows, 21), *late], schema, lambda d: live.backoff(timed(d), idle_ms=60_000), state=state)
    want = islands.backoff(df, ["session"], ["seq"]).select("session", "seq", "wait_ms").collect()
    assert sorted(r for r in got if r[0] < 9) == sorted(map(tuple, want)) and state[-1] < max(state)


def test_idle_state_is_removed(spark, tmp_path):
    rng = random.Random(7)
    rows = [(s, float(k), rng.randrange(6), rng.random() < 0.1, 1000 + 40 * k) for k in range(40) for s in range(4)]
    schema = "session int, t double, queue_depth int, underrun boolean, ms bigint"
    state: list[int] = []
    late = [[(9, 0.0, 0, False, LATE)], [(9, 1.0, 0, False, LATE + 10_000)]]
    got = feed(spark, tmp_path, [*split(rows, 50), *late], schema, lambda d: live.ladder(timed(d), idle_ms=60_000), state=state)
    want = sessions.ladder(spark.createDataFrame(rows, schema), ["t"]).select("session", "t", "rung").collect()
    assert sorted(r for r in got if r[0] < 9) == sorted(map(tuple, want)) and max(state) >= 4 and state[-1] == 1


def test_timers_need_their_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        live.backoff(spark.readStream.format("rate").load().selectExpr("1 AS session", "value AS seq", "1.0D AS lived_s", "timestamp AS ts"))

"""Recurrences in slices, chains and numbers over long streams equal one walk."""

from __future__ import annotations

import random
from functools import partial

import pytest

import numpy as np
from pyspark.sql import functions as F

from mediaspark.operators import frames, ranks, scan, sessions, subtitles, telemetry, timeline


def stream(n, seed, streams=2):
    rng = random.Random(seed)
    return [(s, k, rng.random() * 40 - 20, k / 24.0 + (0.01 if rng.random() < 0.1 else 0), rng.random() < 0.01) for s in range(streams) for k in range(n * (s + 1))]


RULES = {
    "ema_fps": lambda d: frames.ema_fps(d, ["s"], ["k"]),
    "slew": lambda d: frames.slew(d, ["s"], ["k"], 15.0, 4.0),
    "monotone_clock": lambda d: frames.monotone_clock(d, ["s"], ["k"]),
    "tone": lambda d: frames.tone(d.selectExpr("s", "k", "value AS lo", "value + 5 AS hi", "cut"), ["s"], ["k"]),
    "adaptive_cuts": lambda d: frames.adaptive_cuts(d.selectExpr("s", "k", "abs(value) / 20 AS residual"), ["s"], ["k"]),
    "letterbox_stable": lambda d: frames.letterbox_stable(d.selectExpr("s", "k", "value > -18 AS valid", "CAST(130 + k % 5 AS INT) AS top", "CAST(131 + k % 4 AS INT) AS bottom"), ["s"], ["k"], 1080, 4),
    "cadence": lambda d: frames.cadence(d.selectExpr("s", "k", "t_s * 1000 AS t_ms"), ["s"], ["k"], 5.0),
    "ladder": lambda d: sessions.ladder(d.selectExpr("s AS session", "k", "CAST(abs(value) / 4 AS INT) AS queue_depth", "cut AS underrun"), ["k"]),
    "pts_cursor": lambda d: sessions.pts_cursor(d.selectExpr("s AS session", "k", "CASE WHEN k % 3 = 0 THEN NULL ELSE k * 41.7D + value / 10 END AS clock_ms"), ["k"], 24.0),
}


@pytest.mark.parametrize("rule", sorted(RULES))
def test_slices_equal_one_walk(spark, monkeypatch, rule):
    df = spark.createDataFrame(stream(700, 11), "s int, k int, value double, t_s double, cut boolean").repartition(3)
    whole = sorted(map(repr, RULES[rule](df).collect()))
    rounds = []
    monkeypatch.setattr(scan, "carried", partial(scan.carried, slice_rows=150))
    save = scan.save
    monkeypatch.setattr(scan, "save", lambda d, name: rounds.append(name) or save(d, name))
    assert sorted(map(repr, RULES[rule](df).collect())) == whole
    assert "sliced" in rounds


def test_a_rule_that_never_forgets_is_right_too(spark):
    def step(pdf, state):
        total, out = state[0] if state else 0, []
        for v in pdf["v"].tolist():
            total += v
            out.append(total)
        return {"total": out}, [total]

    rows = [(None if s == 1 else s, k, (k * 7 + s) % 5) for s in range(3) for k in range(40 + 30 * s)]
    df = spark.createDataFrame(rows, "s int, k int, v int")
    out = {(r["s"], r["k"]): r["total"] for r in scan.carried(df, ["s"], ["k"], "total bigint", step, slice_rows=13).collect()}
    assert len(out) == len(rows)
    for s in {r[0] for r in rows}:
        total = 0
        for _, k, v in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            total += v
            assert out[s, k] == total
    assert scan.carried(df.limit(0), ["s"], ["k"], "total bigint", step).count() == 0


def test_spaced_equals_a_loop(spark):
    rng = random.Random(12)
    rows = [(s, k, None if rng.random() < 0.02 else k * 0.5 + rng.choice([0, 0, 0.25, -3.0])) for s in (None, 1, 2) for k in range(300)]
    out = {(r["s"], r["k"]) for r in scan.spaced(spark.createDataFrame(rows, "s int, k int, t double").repartition(3), ["s"], ["k"], "t", 2.0, slice_rows=40).collect()}
    want = set()
    for s in (None, 1, 2):
        last = None
        for _, k, t in (r for r in rows if r[0] == s):
            if t is not None and (last is None or t >= last + 2.0):
                last = t
                want.add((s, k))
    assert out == want


def test_numbers_are_gapless(spark):
    rng = random.Random(13)
    rows = [(None if s == 0 else s, rng.random(), k) for s in range(4) for k in range(50 * s * s + 1)]
    df = spark.createDataFrame(rows, "s int, x double, k int").repartition(5)
    out = [tuple(r) for r in scan.numbered(df, ["s"], ["x"]).collect()]
    for s in (None, 1, 2, 3):
        own = sorted((r for r in out if r[0] == s), key=lambda r: r[1])
        assert [r[3] for r in own] == list(range(len(own))) and len(own) == sum(r[0] == s for r in rows)
    assert scan.numbered(df.limit(0), ["s"], ["x"]).count() == 0


def test_meter_and_display_order_without_a_window_on_the_key(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(600)], "s int, k int, offset_ms double")
    meter, order = telemetry.sync_meter(df, ["s"], ["k"]), timeline.assign_pts(df.selectExpr("s AS stream_id", "k AS emit_no", "-k AS pts"))
    assert sorted(tuple(r)[1:4] for r in meter.collect()) == [(240, 240, 120.0), (480, 480, 240.0)]
    assert all(r["display_pts"] == r["emit_no"] - 599 for r in order.collect())
    for plan in (meter, order):
        text = plan._jdf.queryExecution().analyzed().toString()
        assert "row_number" not in text


def test_quantiles_of_one_hot_key(spark):
    rng = random.Random(14)
    rows = [(None if k % 10 == 0 else 1 if k % 10 < 9 else 2, None if rng.random() < 0.05 else rng.choice([rng.random(), round(rng.random(), 1)])) for k in range(5000)] + [(3, None)]
    df = spark.createDataFrame(rows, "g int, value double").repartition(4)
    out = {r["g"]: r for r in ranks.summary(df, ["g"]).collect()}
    assert len(out) == 4 and out[3]["n"] == 0 and out[3]["p50"] is None
    for g in (None, 1, 2):
        own = [v for q, v in rows if q == g and v is not None]
        assert out[g]["n"] == len(own) and np.allclose([out[g][f"p{p}"] for p in (50, 95, 99)], np.percentile(own, [50, 95, 99]))
    values = ranks.placed(df, ["g"], "value")
    per_task = [r["n"] for r in values.groupBy(scan.F.spark_partition_id()).agg(scan.F.count("*").alias("n")).collect()]
    assert sum(per_task) == len({r for r in rows if r[1] is not None})
    assert ranks.summary(df.limit(0), ["g"]).count() == 0


def test_histogram_of_a_batch(spark):
    rows = [(0, [0.0, 0.1, 1.0, 2.0, -1.0]), (1, None), (2, []), (3, [0.999, 0.5])]
    out = {r["k"]: r["h"] for r in spark.createDataFrame(rows, "k int, x array<double>").select("k", frames.histogram(scan.F.col("x"), 4).alias("h")).collect()}
    assert out[0] == [2 / 3, 0, 0, 1 / 3] and out[1] is None and out[2] == [0, 0, 0, 0] and out[3] == [0, 0, 0.5, 0.5]


def test_thinned_equals_one_walk(spark):
    rng = random.Random(5)
    dense = [(1, k, rng.random() * 60) for k in range(400)]
    chain = [(2, k, 0.3 * k) for k in range(120)]  # each decision rests on the one before, through all slices
    back = [(None, k, 0.3 * (90 - k)) for k in range(90)]
    odd = [(3, 1, None), (3, 2, float("nan")), (3, 3, -0.25), (3, 4, 0.25), (3, 5, 0.25), (3, 6, 0.2), (3, 7, 8.0), (3, 8, 7.5), (3, 9, 7.75)]
    rows = dense + chain + back + odd
    want = []
    for s in (1, 2, 3, None):
        kept = []
        for _, k, t in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            if t is not None and t == t and all(abs(t - x) >= 0.5 for x in kept):
                kept.append(t)
                want.append((s, k, t))
    df = spark.createDataFrame(rows, "s int, k int, t_s double").repartition(3)
    for span in (24, 1024):
        assert sorted(map(repr, map(tuple, scan.thinned(df, ["s"], ["k"], "t_s", 0.5, span).collect()))) == sorted(map(repr, want))


def test_small_groups_are_dealt_by_rows(spark):
    rows = spark.range(1000).selectExpr("id % 300 AS track_id", "id DIV 300 AS set_no", "CAST(if(id % 2 = 0, 200, 1160) AS DOUBLE) AS x", "0 AS y", "300 AS w", "40 AS h", "1920 AS canvas_w", "7 AS image_hash")
    assert scan.dealt(rows, ["track_id"], 100).rdd.getNumPartitions() == 10
    plan = subtitles.bitmap_depth(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # one shuffle, of rows
    assert "partial_" not in plan.split("Exchange", 1)[1]  # and no table of groups before it
    pairs = [(1, 1, x, 0, 300, 40, 1920, h) for x, h in ((200.0, 7), (1164.0, 7))] + [(1, 2, x, 0, 300, 40, 1920, h) for x, h in ((200.0, 7), (1160.0, 8))] + [(2, 1, x, 0, 300, 40, 1920, None) for x in (200.0, 1160.0)]
    out = subtitles.bitmap_depth(spark.createDataFrame(pairs, "track_id int, set_no int, x double, y int, w int, h int, canvas_w int, image_hash int")).collect()
    assert [(r["track_id"], r["set_no"], r["disparity"]) for r in out] == [(1, 1, -4 / 960)]


def test_steady_samples_parse_a_line_once(spark):
    lines = spark.createDataFrame([(1, k, f"state=running fps={k} infer=2") for k in range(4)], "session int, k int, line string").withColumn("m", telemetry.parse_status(F.col("line")))
    out = telemetry.steady(lines, ["session"], ["k"], ["fps"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1
    assert [(r["k"], r["value"]) for r in telemetry.steady(lines, ["session"], ["k"], ["fps"]).orderBy("k").collect()] == [(2, 2.0), (3, 3.0)]  # 0 fps is no sample, the first one is left out


def test_pair_views_of_a_dense_stream_across_borders(spark):
    """Two thousand pairs within the tolerance for each unit are never listed; a small slice makes rounds over borders."""
    rng = random.Random(7)
    base = [(s, k, rng.randrange(2500)) for s in (1, 2) for k in range(900)]
    dep = [(s, k, rng.randrange(2500)) for s in (1, 2) for k in range(800)]
    used, want = set(), {}
    for s, q, t in base:
        near = min(((abs(t - p), d) for r, d, p in dep if r == s and abs(t - p) <= 20 and (s, d) not in used), default=None)
        want[s, q] = near and near[1]
        used.add((s, want[s, q]))
    assert sum(v is None for v in want.values()) > 100
    frames = [spark.createDataFrame([*rows, (None, 5, 5), (1, 99_999, None)], "stream_id bigint, seq bigint, pts bigint").repartition(3) for rows in (base, dep)]
    out = timeline.pair_views(*frames, tolerance=20, slice_rows=100).filter("stream_id IS NOT NULL AND pts IS NOT NULL").collect()
    assert {(r["stream_id"], r["seq"]): r["match"] and r["match"]["seq"] for r in out} == want
    plan = timeline.pair_views(*frames, tolerance=20)._jdf.queryExecution().toString()
    assert "explode" not in plan

"""Every query that SQL can express equals its SQL in DuckDB, row for row."""

from __future__ import annotations

import math

import duckdb
import pytest

from mediaspark import plans
from mediaspark.views import BASE

SF = "/root/testdata/sf0.001"
#: Queries that find nothing in so small tables: no session has the 240 samples of a report.
EMPTY = {"sync_meter"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _row(values) -> tuple:
    return tuple(None if isinstance(v, float) and math.isnan(v) else v for v in values)


@pytest.mark.parametrize("up", [True, False])
def test_last_mode_of_one_second_follows_by_event(spark, duck, tmp_path, up):
    ids = list(range(20)) if up else list(range(19, -1, -1))
    rows = same_on(spark, duck, tmp_path, "tumbling_status", {"events": events_of([(e, 5, 1, ["view", "error", "click"][e % 3], 1) for e in ids])})
    assert [r["mode"] for r in rows] == ["error"]


@pytest.mark.parametrize("up", [True, False])
def test_seeks_of_one_second_follow_by_event(spark, duck, tmp_path, up):
    ids = list(range(20)) if up else list(range(19, -1, -1))
    rows = same_on(spark, duck, tmp_path, "st_coalesce_seeks", {"events": events_of([(e, 5, 1, "click", e * 1.5) for e in ids])})
    assert [(r["target_s"], r["coalesced"]) for r in rows] == [(28.5, 19)]


def test_late_drop_of_equal_frames_and_by_the_error_itself(spark, duck, tmp_path):
    """Frames alike in time and pts follow by event id; an error a little beyond 45 ms in doubles is late."""
    clock = [(0, 0, 1, "view", 30), (1, 0, 2, "view", 9.34), (2, 0, 3, "view", 8.5)]
    like = [(e, s, 1, "click", v) for s, v in ((1, 1.0), (2, 23.0)) for e in range(100 * s + 9, 100 * s - 1, -1)]
    edge = [(300, 1, 2, "click", 4.84), (301, 1, 3, "click", 4.0)]
    rows = {r["event_id"]: r["late"] for r in same_on(spark, duck, tmp_path, "late_drop", {"events": events_of([*clock, *like, *edge])})}
    assert [rows[e] for e in range(200, 210)] == [False] + [True] * 9  # only the first has an interval of 220 ms
    assert [rows[300], rows[301]] == [4.84 * 10 - 9.34 * 10 < -45, 4.0 * 10 - 8.5 * 10 < -45] == [True, False]


def same_on(spark, duck, tmp_path, name, tables):
    """The query equals its SQL on these tables (name: SQL)."""
    for t, sql in tables.items():
        duck.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
        duck.execute(f"CREATE OR REPLACE TEMP VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    try:
        df = plans.QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        rows = sorted((_row(r) for r in df.select(columns).collect()), key=repr)
        want = duck.execute(f"SELECT {', '.join(columns)} FROM ({plans.ORACLE[name]}) x").fetchall()
        assert rows and rows == sorted((_row(r) for r in want), key=repr)
    finally:
        for t in tables:
            duck.execute(f"DROP VIEW temp.{t}")
    return [dict(zip(columns, r, strict=True)) for r in rows]


def events_of(rows):
    """The table of events from (event_id, second of the day, user_id, event_type, value)."""
    listed = ", ".join(f"({e}, {s}, {u}, '{kind}', {v})" for e, s, u, kind, v in rows)
    return f"SELECT e::BIGINT AS event_id, TIMESTAMP '2024-01-02' + to_seconds(s) AS ts, u::BIGINT AS user_id, kind AS event_type, v::DOUBLE AS value, '{{}}' AS props FROM (VALUES {listed}) t(e, s, u, kind, v)"


def test_av_action_decides_by_the_difference_itself(spark, duck, tmp_path):
    """0.95 - 1.07 is a little less than -0.12 in doubles, 1.42 - 1.07 a little less than 0.35: no rounding before the decision."""
    pairs = ((0.95, 1.07), (1.42, 1.07), (1.29, 1.14), (1.02, 1.0))
    clock = [(k, 0, k, "view", c) for k, (_, c) in enumerate(pairs)]
    frames = [(10 + k, 1, k, "click", v) for k, (v, _) in enumerate(pairs)]
    rows = same_on(spark, duck, tmp_path, "av_action", {"events": events_of([*clock, *frames])})
    want = {10 + k: v - c for k, (v, c) in enumerate(pairs)}
    rule = lambda d: "drop" if d < -0.120 else "hold" if d >= 0.350 else "ease" if d > 0.150 else "nudge" if abs(d) > 0.025 else "none"
    assert {r["event_id"]: r["action"] for r in rows} == {e: rule(d) for e, d in want.items()}
    assert sum(rule(d) != rule(round(d, 6)) for d in want.values()) == 3


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((_row(r) for r in df.select(columns).collect()), key=repr)
    assert rows or name in EMPTY
    if name not in plans.ORACLE:
        return
    result = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows == sorted((_row(r[k] for k in place) for r in result.fetchall()), key=repr)

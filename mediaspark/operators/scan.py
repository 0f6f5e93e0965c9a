"""Long streams in many tasks: gapless numbers, recurrences in slices, and chains of rows by pointer doubling."""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save
from . import asof

#: Rows of a stream in one slice.
SLICE = 100_000

Step = Callable[[pd.DataFrame, list | None], tuple[dict, list]]


#: Rows of a task that groups many small groups.
DEALT = 500_000


def tasks_for(df: DataFrame, rows: int = DEALT) -> int:
    """As many tasks as ``df`` has times ``rows`` rows, at least the session's number of partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def dealt(df: DataFrame, keys: list[str], rows: int = DEALT) -> DataFrame:
    """``df`` dealt by a hash of its keys to as many tasks as it has times ``rows`` rows.

    Groups of few rows shrink by no partial aggregate, so the table of groups in a task grows with its rows: a task has
    a bounded number of them then, however large the input is. Groups by these keys need no other shuffle. Counting reads
    the rows that ``df`` is made of; small tables keep the session's number of partitions.
    """
    return df.repartition(tasks_for(df, rows), *keys)


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "number") -> DataFrame:
    """``df`` with each row's place in its stream, from 0 without gaps, and never a whole stream in one task.

    Rows are dealt by ranges of stream and order, sorted there and written; each range adds the rows of its stream in the
    ranges before it, which is one number for each range and stream. Null keys are a stream; rows alike in ``order`` are
    numbered in any order.
    """
    dealt = save(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_id", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumn("_range", F.shiftright("_id", 33))
    starts = dealt.groupBy(*by, "_range").agg(F.min("_id").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*by, "_range", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = dealt.alias("d").join(starts.alias("s"), _same("d", "s", [*by, "_range"]))
    return met.select(*[f"d.{c}" for c in df.columns], (F.col("_before") + F.col("_id") - F.col("_from")).alias(out))


def carried(df: DataFrame, by: list[str], order: list[str], schema: str, step: Step, slice_rows: int = SLICE) -> DataFrame:
    """``df`` with the columns of a rule whose next value depends on its own last output, long streams in slices.

    ``step`` takes rows in order and the state before them (None at the start), and gives the columns and the state after
    them, a list of plain values. Slices first run from no state, each for its last state only; then each runs from the
    last state of the slice before it. A slice whose last state has changed by that sends on the one after it, round
    by round, until no state changes: the result is that of one walk, for every rule. A rule that forgets its past, as one
    does that levels off, is cut or is bounded, needs two rounds however long the stream is; one that never forgets needs
    as many as a stream has slices. Rows must be narrow: drop arrays before.

    Streams of one slice at most, all of them, are walked at once.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    largest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(order, kind="stable").reset_index(drop=True)

    if largest <= slice_rows:

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = ordered(pdf)
            return pdf.assign(**step(pdf, None)[0])

        return df.groupBy(*by).applyInPandas(walk, f"{fields}, {schema}")

    rows = save(numbered(df, by, order, "_number").withColumn("_slice", F.floor(F.col("_number") / slice_rows)).drop("_number"), "sliced")
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)

    def last_state(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.head(1)[[*by, "_slice"]]
        return out.assign(_end=json.dumps(step(ordered(pdf), None)[1]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        start = pdf["_start"].iloc[0]
        columns, end = step(pdf, None if start is None else json.loads(start))
        marked = [None] * (len(pdf) - 1) + [json.dumps(end)]
        return pdf.drop(columns="_start").assign(**columns, _end=marked)

    def after(ends: DataFrame) -> DataFrame:
        """The state before each slice that has one before it."""
        w = Window.partitionBy(*by).orderBy("_slice")
        return ends.withColumn("_start", F.lag("_end").over(w)).filter("_start IS NOT NULL").drop("_end")

    def rerun(todo: DataFrame) -> DataFrame:
        met = rows.alias("d").join(todo.alias("s"), _same("d", "s", [*by, "_slice"]), "inner").select("d.*", "s._start")
        return save(met.groupBy(*by, "_slice").applyInPandas(run, f"{fields}, _slice bigint, {schema}, _end string"), "walked")

    ends = save(rows.groupBy(*by, "_slice").applyInPandas(last_state, f"{kinds}, _slice bigint, _end string"), "ends")
    todo = rows.filter("_slice = 0").select(*by, "_slice").distinct().withColumn("_start", F.lit(None).cast("string")).unionByName(after(ends))
    done = rerun(save(todo, "starts"))
    while True:
        now = done.filter("_end IS NOT NULL").select(*by, "_slice", "_end")
        used, new = after(ends), after(now)
        changed = new.alias("d").join(used.withColumnRenamed("_start", "_was").alias("s"), _same("d", "s", [*by, "_slice"])).filter("_start <> _was").select("d.*")
        changed = save(changed, "starts")
        if changed.isEmpty():
            return done.drop("_slice", "_end")
        again = rerun(changed)
        kept = done.alias("d").join(changed.alias("s"), _same("d", "s", [*by, "_slice"]), "left_anti")
        ends, done = save(now, "ends"), save(kept.unionByName(again), "walked")


def running_max(df: DataFrame, by: list[str], value: str, number: str, slice_rows: int = SLICE) -> DataFrame:
    """Numbered rows with ``_most``: the greatest value before each in its stream, or null."""
    sliced = df.withColumn("_slice", F.floor(F.col(number) / slice_rows))
    tops = sliced.groupBy(*by, "_slice").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "_slice", F.max("_top").over(before).alias("_carry"))
    within = Window.partitionBy(*by, "_slice").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    met = sliced.withColumn("_in", F.max(value).over(within)).alias("d").join(tops.alias("s"), _same("d", "s", [*by, "_slice"]))
    return met.select(*[f"d.{c}" for c in df.columns], F.greatest("d._in", "s._carry").alias("_most"))


def spaced(df: DataFrame, by: list[str], order: list[str], value: str, gap: float, slice_rows: int = SLICE) -> DataFrame:
    """The first row of each stream, then always the next at least ``gap`` after the last one kept.

    Only a row above all before it can be kept. Each such row points to the next one from its value plus ``gap`` on, by a
    forward as-of join; what the first row reaches is marked by pointer doubling: every round follows twice as many
    pointers as the one before, so that there are as many rounds as the number of kept rows has binary digits.
    Null values are never kept. Null keys are a stream.
    """
    keyed = df.withColumn("_by", F.coalesce(F.to_json(F.struct(*by)), F.lit("")))  # null keys are equal in joins, too
    rows = running_max(numbered(keyed.filter(F.col(value).isNotNull()), ["_by"], order, "_number"), ["_by"], value, "_number", slice_rows)
    records = save(rows.filter(F.col("_most").isNull() | (F.col(value) > F.col("_most"))).drop("_most"), "records")
    points = records.select("_by", "_number", F.col(value).cast("double").alias("_t"))
    goals = points.select("_by", "_number", (F.col("_t") + gap).alias("_t"))
    met = asof.asof(goals, points, ["_by"], "_t", max(gap, 1e-9) * slice_rows, forward=True)
    jumps = save(met.select("_by", "_number", F.col("match._number").alias("_next")).filter("_next IS NOT NULL"), "jumps")
    reached = save(points.groupBy("_by").agg(F.min("_number").alias("_number")), "reached")
    while True:
        more = reached.join(jumps, ["_by", "_number"]).select("_by", F.col("_next").alias("_number"))
        more = save(more, "more")
        if more.isEmpty():
            break
        reached = save(reached.unionByName(more), "reached")
        far = jumps.select("_by", F.col("_number").alias("_next"), F.col("_next").alias("_far"))
        jumps = save(jumps.join(far, ["_by", "_next"]).select("_by", "_number", F.col("_far").alias("_next")), "jumps")
    return records.join(reached, ["_by", "_number"], "left_semi").select(*df.columns)


def thinned(df: DataFrame, by: list[str], order: list[str], value: str, gap: float, span: int = 1024) -> DataFrame:
    """Rows in order of arrival, without those within ``gap`` of one that was kept before them, as slices of the line.

    Of rows with one value only the first can be kept. A slice is ``span`` gaps wide, so a row is only decided by its own
    slice and by what the slices on both sides keep within a gap of the border: at most two rows for each. Slices first run
    on their own, then again with their neighbours' rows, as long as these change; a decision only rests on earlier rows,
    so the rounds end, with the result of one walk. They are as many as slices that decide one after the other: few where
    rows leave gaps, at most all slices.
    Null and NaN values are never kept. Null keys are a stream.
    """
    wide = gap * span
    place = lambda v: F.floor(v / wide).cast("bigint")
    good = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    keyed = good.withColumn("_by", F.coalesce(F.to_json(F.struct(*by)), F.lit("")))  # null keys are equal in joins, too
    ranked = F.struct(*order)
    first = keyed.groupBy("_by", F.col(value).cast("double").alias("_t")).agg(F.min(ranked).alias("_first"), F.min_by(F.struct(*df.columns), ranked).alias("_row"))
    points = save(first.withColumn("_slice", place(F.col("_t"))), "points")
    edge = f"array<struct<_t: double, _first: {points.schema['_first'].dataType.simpleString()}>>"
    kinds = f"_by string, _slice bigint, _t double, _first {points.schema['_first'].dataType.simpleString()}"

    def rank(first) -> list[tuple]:
        """The place in order of arrival, nulls first as Spark has it."""
        return [(first[c] is not None, 0 if first[c] is None else first[c]) for c in order]

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = pdf["_edges"].iloc[0]
        rows = [(rank(f), t, k) for k, (f, t) in enumerate(zip(pdf["_first"], pdf["_t"], strict=True))]
        rows += [(rank(e["_first"]), e["_t"], -1) for e in ([] if edges is None else edges)]
        rows.sort(key=lambda r: r[0])
        kept: list[float] = []
        out = []
        for _, t, k in rows:
            at = bisect_left(kept, t)
            if k < 0 or all(abs(kept[i] - t) >= gap for i in (at - 1, at) if 0 <= i < len(kept)):
                insort(kept, t)
                if k >= 0:
                    out.append(k)
        return pdf.iloc[out][["_by", "_slice", "_t", "_first"]]

    def run(todo: DataFrame) -> DataFrame:
        rows = points.select("_by", "_slice", "_t", "_first").join(todo, ["_by", "_slice"])
        return save(rows.groupBy("_by", "_slice").applyInPandas(decide, kinds), "thinned")

    def edges_of(kept: DataFrame) -> DataFrame:
        """What the slices beside each slice keep near its borders."""
        reach = F.array(place(F.col("_t") - gap * 1.001), place(F.col("_t") + gap * 1.001))
        sent = kept.withColumn("_to", F.explode(F.array_distinct(reach))).filter("_to <> _slice")
        out = sent.groupBy("_by", F.col("_to").alias("_slice")).agg(F.array_sort(F.collect_list(F.struct("_t", "_first"))).alias("_edges"))
        return out.join(slices, ["_by", "_slice"], "left_semi")

    slices = save(points.select("_by", "_slice").distinct(), "slices")
    used = slices.withColumn("_edges", F.lit(None).cast(edge))
    kept = run(used)
    while True:
        now = save(slices.join(edges_of(kept), ["_by", "_slice"], "left"), "edges")
        was = used.withColumnRenamed("_edges", "_was")
        changed = save(now.join(was, ["_by", "_slice"]).filter(~F.col("_edges").eqNullSafe(F.col("_was"))).drop("_was"), "starts")
        if changed.isEmpty():
            break
        kept = save(kept.join(changed, ["_by", "_slice"], "left_anti").unionByName(run(changed)), "thinned")
        used = now
    return points.join(kept.select("_by", "_t"), ["_by", "_t"], "left_semi").select("_row.*")

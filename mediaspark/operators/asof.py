"""As-of, range, nearest and interval joins on ordered time, without theta joins.

Long streams are cut into time slices: the last row of each slice is carried into later ones by a small window over
slices, so that one stream is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], t: str, slice_width: float, strict: bool = False, forward: bool = False, tie: list[str] | None = None) -> DataFrame:
    """``left`` with struct ``match``: the last row of ``right`` with the same ``by`` and a time at or before its own.

    ``strict`` excludes equal times; ``forward`` takes the first row at or after instead. Both sides name their time
    ``t``; among rows of ``right`` at one time the last in order of ``tie`` (the first, going forward) counts. Rows of
    ``left`` without a match keep a null struct; null times and keys match nothing.
    """
    sign = -1 if forward else 1
    time = F.col(t) * sign
    payload = F.struct(*right.columns)
    ties = F.struct(*(tie or [F.lit(0).alias("none")]))
    lefts = left.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], time.alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("_m"), F.struct("*").alias("_row"))
    rights = right.filter(F.col(t).isNotNull()).select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], time.alias("_t"), F.lit(1 if strict else 0).alias("_side"), payload.alias("_m"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    keys = [f"_by{k}" for k in range(len(by))]
    both = lefts.unionByName(rights).withColumn("_slice", F.floor(F.col("_t") / slice_width))
    order = [F.col("_t"), F.col("_side")] + [F.col(f"_m.{c}").desc() if forward else F.col(f"_m.{c}") for c in (tie or [])]
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_in", F.last("_m", ignorenulls=True).over(within))
    ends = both.filter("_m IS NOT NULL").groupBy(*keys, "_slice").agg(F.max(F.struct("_t")).alias("_end"), F.max_by("_m", F.struct("_t", *[(F.col(f"_m.{c}") * -1 if forward else F.col(f"_m.{c}")).alias(c) for c in (tie or [])])).alias("_last"))
    slices = both.select(*keys, "_slice").distinct().join(ends, [*keys, "_slice"], "left")
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    out = seen.filter("_row IS NOT NULL").join(carried, [*keys, "_slice"], "left")
    return out.select("_row.*", F.coalesce("_in", "_carry").alias("match"))


def asof_tolerance(left: DataFrame, right: DataFrame, by: list[str], t: str, slice_width: float, low: float, high: float) -> DataFrame:
    """``asof`` whose match must lie between ``low`` and ``high`` before the row; otherwise the struct is null."""
    met = asof(left, right, by, t, slice_width)
    delta = F.col(t) - F.col(f"match.{t}")
    return met.withColumn("match", F.when(delta.between(low, high), F.col("match")))


def nearest(left: DataFrame, right: DataFrame, by: list[str], t: str, slice_width: float, tolerance: float) -> DataFrame:
    """``left`` with the row of ``right`` nearest in time, in either direction, within the tolerance; the earlier one of two."""
    back = asof(left, right, by, t, slice_width).withColumnRenamed("match", "_back")
    both = asof(back, right, by, t, slice_width, forward=True).withColumnRenamed("match", "_next")
    near, far = F.col(t) - F.col(f"_back.{t}"), F.col(f"_next.{t}") - F.col(t)
    best = F.when(F.col("_next").isNull() | (near <= far), F.col("_back")).otherwise(F.col("_next"))
    out = both.withColumn("match", best).drop("_back", "_next")
    return out.withColumn("match", F.when(F.abs(F.col(t) - F.col(f"match.{t}")) <= tolerance, F.col("match")))


def range_lookup(probes: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, length: str, slice_width: float) -> DataFrame:
    """``probes`` with the one of the non-overlapping ranges that holds ``at``: as-of on the start, then the upper bound."""
    met = asof(probes.withColumn("_at", F.col(at)), ranges.withColumn("_at", F.col(start)), by, "_at", slice_width)
    inside = F.col(at) < F.col(f"match.{start}") + F.col(f"match.{length}")
    return met.withColumn("match", F.when(inside, F.col("match"))).drop("_at")


def close_pairs(left: DataFrame, right: DataFrame, by: list[str], t: str, tolerance: float) -> DataFrame:
    """All pairs of a left row and a right row (struct ``_m``) of one stream within the tolerance, with their ``gap``.

    An equi-join on buckets as wide as the tolerance; the left row goes to its own and to both beside it.
    """
    width = max(tolerance, 1)
    rights = right.filter(F.col(t).isNotNull()).select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.floor(F.col(t) / width).alias("_b"), F.struct("*").alias("_m"))
    lefts = left.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(t) / width) + k for k in (-1, 0, 1)])))
    same = [F.col(c) == F.col(f"_by{k}") for k, c in enumerate(by)]
    met = lefts.join(rights, [*same, F.col("_bucket") == F.col("_b")]).withColumn("gap", F.abs(F.col(t) - F.col(f"_m.{t}")))
    return met.filter(F.col("gap") <= tolerance).select(*left.columns, "_m", "gap")


def running(value: Column, by: list[str], order: list, preceding_only: bool = False) -> Column:
    """Sum of ``value`` up to the current row, or up to the one before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if preceding_only else 0)
    return F.sum(value).over(w)

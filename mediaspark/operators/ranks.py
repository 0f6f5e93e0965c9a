"""Exact percentiles by six rank rules, best-of and top-k per group."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save
from . import scan

RULES = ("linear", "round", "half_up", "trunc", "ceil", "floor")


def rank_of(n: Column, q: float, rule: str) -> Column:
    """The 0-based rank of quantile ``q`` among ``n`` sorted values."""
    at = F.lit(q) * (n - 1)
    rank = {
        "round": F.bround(at),
        "half_up": F.floor(at + 0.5),
        "trunc": F.floor(F.lit(q) * n),
        "ceil": F.ceil(F.lit(q) * n) - 1,
        "floor": F.floor(at),
    }[rule]
    return F.greatest(F.lit(0), F.least(n - 1, rank.cast("bigint")))


def placed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The distinct values (``_value``) of each group with ``_n`` rows each, how many rows there are up to it and in all.

    Equal values are counted before they are shuffled. They are dealt by ranges of group and value, and a range adds what
    the ranges before it hold of its group, so that no task sees all values of one. Null values are ignored.
    """
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    by = [f"_k{i}" for i in range(len(keys))]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*named, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = save(counts.repartitionByRange(*by, "_value").withColumn("_range", F.spark_partition_id()), "values")
    sums = dealt.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum"))
    over = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_sum").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_range", before.alias("_before"), F.sum("_sum").over(over).alias("_total"))
    inside = F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    met = dealt.withColumn("_in", inside).alias("d").join(sums.alias("s"), scan._same("d", "s", [*by, "_range"]))
    return met.select(*[F.col(f"d._k{i}").alias(c) for i, c in enumerate(keys)], "_value", "_n", (F.col("_before") + F.col("_in")).alias("_upto"), "_total")


def _holds(rank: Column) -> Column:
    return (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))


def pick(values: DataFrame, keys: list[str], q: float, rule: str, out: str = "value") -> DataFrame:
    """The quantile of each group of ``placed`` by a rule."""
    if rule == "linear":
        return linear(values, keys, {out: q})
    return values.filter(_holds(rank_of(F.col("_total"), q, rule))).select(*keys, F.col("_value").alias(out))


def linear(values: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Quantiles of each group of ``placed`` between the two values around their place; only these values are shuffled."""
    at = {name: F.lit(q) * (F.col("_total") - 1) for name, q in quantiles.items()}
    sides = {name: (F.floor(p), F.ceil(p)) for name, p in at.items()}
    wanted = [_holds(r) for pair in sides.values() for r in pair]
    ends = [F.max(F.when(_holds(r), F.col("_value").cast("double"))).alias(f"_{name}{k}") for name, pair in sides.items() for k, r in enumerate(pair)]
    found = values.filter(functools.reduce(lambda x, y: x | y, wanted)).groupBy(*keys).agg(F.max("_total").alias("_total"), *ends)
    share = {name: p - F.floor(p) for name, p in at.items()}
    return found.select(*keys, *[(F.col(f"_{n}0") + (F.col(f"_{n}1") - F.col(f"_{n}0")) * share[n]).alias(n) for n in quantiles])


def rank_percentile(df: DataFrame, keys: list[str], value: str, q: float, rule: str, out: str = "value") -> DataFrame:
    """One row per group: the exact quantile by the rule. Null values are ignored; a group without others has no row."""
    return pick(placed(df, keys, value), keys, q, rule, out)


def with_quantiles(stats: DataFrame, df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """``stats``, one row per group, with linear quantiles of ``df``; null where a group has no values."""
    found = linear(placed(df, keys, value), keys, quantiles)
    return stats.alias("d").join(found.alias("s"), scan._same("d", "s", keys), "left").select("d.*", *[f"s.{n}" for n in quantiles])


def summary(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean, population deviation, extremes and linear percentiles per group."""
    v = F.col(value)
    stats = samples.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return with_quantiles(stats, samples, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select(*keys, "n", "mean", "std", "min", "p50", "p95", "p99", "max")


def top_rows(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).filter(F.col("_row") <= n).drop("_row")


def best_run(runs: DataFrame, config: str = "config") -> DataFrame:
    """The fastest pass of each configuration; the earlier of equals."""
    return top_rows(runs, [config], [F.col("fps").desc(), F.col("pass")])


def prune(df: DataFrame, store: str = "store", updated: str = "updated", key: str = "media_key", n: int = 400) -> DataFrame:
    """The ``n`` most recently updated records of each store."""
    return top_rows(df, [store], [F.col(updated).desc(), F.col(key)], n)


def newest_version(df: DataFrame, keys: list[str], version: str = "version", major: str = "major", pinned: str | None = None) -> DataFrame:
    """The highest purely numeric dotted version of each group within its major; others are skipped.

    A pinned version wins where it is present; a group that lacks its pin gives none.
    """
    numeric = df.filter(F.col(version).rlike(r"^\d+(\.\d+)*$"))
    parts = F.transform(F.split(version, r"\."), lambda p: p.cast("bigint"))
    within = numeric.withColumn("_parts", parts).filter(F.col("_parts")[0] == F.col(major))
    best = within.groupBy(*keys).agg(F.max_by(version, "_parts").alias("newest"), *([F.max(F.when(F.col(version) == F.col(pinned), F.col(version))).alias("_pin"), F.max(pinned).alias("_asked")] if pinned else []))
    if not pinned:
        return best
    return best.select(*keys, F.when(F.col("_asked").isNull(), F.col("newest")).otherwise(F.col("_pin")).alias("newest"))

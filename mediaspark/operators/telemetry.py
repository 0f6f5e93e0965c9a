"""Telemetry: parsed status lines, intervals, counters, rates and builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save
from . import ranks, scan


def parse_status(line: Column) -> Column:
    """key=value tokens of a line as a map: the first = splits, other tokens are dropped, the last of equal keys counts."""
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t.contains("="))
    keys = F.transform(tokens, lambda t: F.substring_index(t, "=", 1))
    last = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), F.substring_index(t, "=", 1).alias("k"), t.alias("t"))), lambda s: F.size(F.filter(F.slice(keys, s["i"] + 2, F.size(keys)), lambda k: k == s["k"])) == 0)
    return F.map_from_entries(F.transform(last, lambda s: F.struct(s["k"], F.substring(s["t"], F.length(s["k"]) + 2, F.length(s["t"])))))


def steady(status: DataFrame, keys: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Long numeric samples of running lines without the first of each session; an only sample stays."""
    w = Window.partitionBy(*keys)
    # exploding one struct keeps the filter behind it, so a line is parsed once and not for each use of its map
    once = F.struct(F.col("m")["state"].alias("state"), F.col("m")["fps"].try_cast("double").alias("fps"), F.array(*[F.struct(F.lit(n).alias("name"), F.col("m")[n].try_cast("double").alias("value")) for n in names]).alias("pairs"))
    rows = status.select(*keys, *order, F.explode(F.array(once)).alias("_m")).filter((F.col("_m.state") == "running") & (F.coalesce("_m.fps", F.lit(1.0)) != 0.0))
    rows = rows.withColumn("_row", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w)).filter("_row > 1 OR _n = 1")
    return rows.select(*keys, *order, F.explode("_m.pairs").alias("s")).select(*keys, *order, "s.*").filter("value IS NOT NULL")


def steady_summary(samples: DataFrame, keys: list[str]) -> DataFrame:
    v, samples = F.col("value"), save(samples, "steady")  # read twice
    stats = samples.groupBy(*keys, "name").agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"))
    return ranks.with_quantiles(stats, samples, [*keys, "name"], "value", {"median": 0.5})


def intervals(events: DataFrame, by: list[str], order: list[str], t: str) -> DataFrame:
    """Adds ``interval`` since the event before of the same name."""
    return events.withColumn("interval", F.col(t) - F.lag(t).over(Window.partitionBy(*by).orderBy(*order)))


def deltas(counters: DataFrame, by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Adds ``delta`` of a cumulative counter since the dump before; the first counts from 0."""
    return counters.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(*order)), F.lit(0)))


def rolling_rate(progress: DataFrame, by: list[str], t: str = "t", done: str = "bytes_done", total: str = "bytes_total", seconds: int = 3) -> DataFrame:
    """Adds ``rate`` over the last seconds, and ``eta`` (-1 without a rate)."""
    w = Window.partitionBy(*by).orderBy(t).rangeBetween(-seconds, 0)
    dt, db = F.col(t) - F.min(t).over(w), F.col(done) - F.min_by(done, t).over(w)
    rows = progress.withColumns({"_dt": dt, "_db": db})
    rows = rows.withColumn("rate", F.when(F.col("_dt") > 0, F.col("_db") / F.col("_dt")).otherwise(0.0))
    return rows.withColumn("eta", F.when(F.col("rate") > 0, (F.col(total) - F.col(done)) / F.col("rate")).otherwise(-1.0)).drop("_dt", "_db")


def sync_meter(offsets: DataFrame, by: list[str], order: list[str], value: str = "offset_ms", every: int = 240, span: int = 512, least: int = 48) -> DataFrame:
    """At every ``every``-th sample the median and outer ranks of the last ``span``."""
    rows = scan.numbered(offsets, by, order, "_no").withColumn("_no", F.col("_no") + 1)
    # samples are gathered once, in buckets of ``every``; a report joins the buckets that reach into its span
    buckets = rows.groupBy(*by, F.ceil(F.col("_no") / every).alias("_bucket")).agg(F.count(F.lit(1)).alias("_full"), F.array_sort(F.collect_list(F.struct("_no", value))).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_bucket")
    near = F.flatten(F.array(*[F.coalesce(F.lag(f"_v.{value}", k).over(w), F.array().cast("array<double>")) for k in range(-(-span // every), -1, -1)]))
    rows = buckets.select(*by, (F.col("_bucket") * every).alias("sample_no"), "_full", near.alias("_near")).filter(F.col("_full") == every)
    last = F.slice("_near", F.greatest(F.lit(1), F.size("_near") - span + 1), span)
    rows = rows.withColumn("_s", F.array_sort(last)).withColumn("n", F.size("_s")).filter(F.col("n") >= least)
    at = lambda r: F.get("_s", r.cast("int"))
    n = F.col("n")
    return rows.select(*by, "sample_no", "n", at(F.floor(n / 2)).alias("median"), at(F.floor(n / 20)).alias("p5"), at(F.floor(n * 19 / 20)).alias("p95"))


def completeness(jobs: DataFrame, done: str = "done", expected: str = "expected") -> DataFrame:
    """Adds ``verdict``: fail under 90 %, warn under 100 %, ok otherwise and without an expectation."""
    ratio = F.col(done) / F.col(expected)
    return jobs.withColumn("verdict", F.when((F.col(expected) <= 0) | F.col(expected).isNull() | (F.col(done) >= F.col(expected)), "ok").when(ratio < 0.90, "fail").otherwise("warn"))


def status_per_second(status: DataFrame, ts: str = "ts", width: str = "1 second", tie: list[str] | None = None) -> DataFrame:
    """Frames, drops and the last mode, of equal times the last by ``tie``, of each session per window of time; works on streams too."""
    return status.groupBy("session", F.window(ts, width)).agg(F.sum("frames").alias("frames"), F.sum("drops").alias("drops"), F.max_by("mode", F.struct(ts, *(tie or []))).alias("mode"))

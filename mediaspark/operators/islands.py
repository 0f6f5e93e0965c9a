"""Runs, bursts, epochs and back-offs: gaps-and-islands windows per stream."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save
from . import scan

CUT_DISTANCE, BURST, CALM_SHARE, CALM_FRAMES = 0.42, 4.5, 0.6, 3


def _upto(by: list[str], order: list[str], last: int = 0) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)


def hard_cuts(frames: DataFrame, by: list[str], order: list[str], pts: str = "pts", distance: str = "distance") -> DataFrame:
    """Rows whose distance to the previous analysed row is a cut and whose pts advances."""
    before = F.lag(pts).over(Window.partitionBy(*by).orderBy(*order))
    return frames.withColumn("_before", before).filter((F.col(distance) >= CUT_DISTANCE) & (F.col(pts) > F.col("_before"))).drop("_before")


def confirmed_cuts(frames: DataFrame, by: list[str], order: list[str], distance: str = "distance", authority: str = "depth_cut") -> DataFrame:
    """Adds ``cut``: every second row of a run of large distances, and each authoritative cut, which starts a new run."""
    d, a = F.col(distance), F.col(authority)
    high = ~a & (d >= CUT_DISTANCE)
    runs = frames.withColumn("_run", F.sum(F.when(high, 0).otherwise(1)).over(_upto(by, order)))
    place = F.sum(F.when(high, 1).otherwise(0)).over(_upto([*by, "_run"], order))
    return runs.withColumn("cut", a | (high & (place % 2 == 0))).drop("_run")


def motion_onsets(frames: DataFrame, by: list[str], order: list[str], motion: str = "motion", cut: str = "is_cut") -> DataFrame:
    """Adds ``onset``: a burst of motion after enough calm rows since the last burst; cuts count as neither."""
    m, c = F.col(motion), F.col(cut)
    burst, calm = ~c & (m >= BURST), ~c & (m < CALM_SHARE * BURST)
    rows = frames.withColumn("_prior", F.coalesce(F.sum(burst.cast("int")).over(_upto(by, order, -1)), F.lit(0)))
    quiet = F.coalesce(F.sum(calm.cast("int")).over(_upto([*by, "_prior"], order, -1)), F.lit(0))
    opening = F.first(burst.cast("int")).over(_upto([*by, "_prior"], order))
    rows = rows.withColumn("_quiet", quiet).withColumn("_opening", opening)
    return rows.withColumn("onset", burst & ((F.col("_prior") == 0) | (F.col("_quiet") >= CALM_FRAMES))).drop("_prior", "_quiet", "_opening")


def epochs(frames: DataFrame, by: list[str], order: list[str], pts: str = "pts", back: float = 1.0, ahead: float = 1000.0, same: float = 0.05) -> DataFrame:
    """Adds ``epoch``, which grows where pts steps back or jumps ahead; of rows at nearly the same pts the last stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.col(pts) - F.lag(pts).over(w)
    rows = frames.withColumn("_break", F.coalesce(((step < -back) | (step > ahead)).cast("int"), F.lit(0)))
    rows = rows.withColumn("epoch", F.sum("_break").over(_upto(by, order)))
    next_step = F.lead(pts).over(Window.partitionBy(*by, "epoch").orderBy(*order)) - F.col(pts)
    return rows.withColumn("_next", next_step).filter(F.col("_next").isNull() | (F.abs("_next") > same)).drop("_break", "_next")


def backoff(sessions: DataFrame, by: list[str], order: list[str], lived_s: str = "lived_s", stable_s: float = 5.0, first_ms: int = 250, most_ms: int = 3000) -> DataFrame:
    """Adds ``wait_ms``: doubles with each short session up to a bound, cleared by a long one."""
    stable = F.col(lived_s) >= stable_s
    rows = sessions.withColumn("_st", F.sum(stable.cast("int")).over(_upto(by, order)))
    k = F.row_number().over(Window.partitionBy(*by, "_st").orderBy(*order)) - 1 - F.when(F.col("_st") > 0, 1).otherwise(0)
    wait = F.least(F.lit(most_ms), F.lit(first_ms) * F.pow(F.lit(2), F.least(k, F.lit(20)))).cast("bigint")
    return rows.withColumn("_wait", wait).withColumn("wait_ms", F.when(stable, first_ms).otherwise(F.col("_wait"))).drop("_st", "_wait")


def backoff_steps(lived, stable_s: float = 5.0, first_ms: int = 250, most_ms: int = 3000, short: int = 0) -> tuple[list[int], int]:
    """The wait after each session, and how many short ones there have been since the last long one."""
    out = []
    for s in lived:
        stable = s is not None and s >= stable_s
        out.append(first_ms if stable else min(most_ms, first_ms * 2 ** min(short, 20)))
        short = 0 if stable else short + 1
    return out, short


def runs_of(df: DataFrame, by: list[str], order: list[str], value: Column, out: str = "run") -> DataFrame:
    """Adds the number of the run of equal values that a row belongs to, and its place in it from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_v", value)
    rows = rows.withColumn("_new", F.coalesce((~F.col("_v").eqNullSafe(F.lag("_v").over(w))).cast("int"), F.lit(1)))
    rows = rows.withColumn(out, F.sum("_new").over(_upto(by, order)))
    return rows.withColumn(f"{out}_place", F.row_number().over(Window.partitionBy(*by, out).orderBy(*order))).drop("_v", "_new")


def stable_snapshot(polls: DataFrame, by: list[str], order: list[str], signature: str = "signature", times: int = 3) -> DataFrame:
    """Per group the first poll at which the same signature is seen ``times`` times in a row, and the best poll."""
    placed = runs_of(polls, by, order, F.col(signature))
    first = F.min(F.when(F.col("run_place") == times, F.struct(*order, F.col(signature).alias("signature"))))
    best = F.max_by(signature, F.struct("is_3d", "duration_s", "candidates", *[(-F.col(c)).alias(f"o{k}") for k, c in enumerate(order)]))
    return placed.groupBy(*by).agg(first.alias("_first"), best.alias("best_signature")).select(*by, *[F.col(f"_first.{c}").alias(f"stable_{c}") for c in order], F.col("_first.signature").alias("stable_signature"), "best_signature")


def longest_sorted(rows: DataFrame, file: list[str], table: str, order: str, value: str) -> DataFrame:
    """Of each file's tables the longest that ascends and has two rows or more; the first of equals."""
    before = F.lag(value).over(Window.partitionBy(*file, table).orderBy(order))
    checked = rows.withColumn("_ok", F.coalesce(F.col(value) >= before, F.lit(True)))
    good = checked.groupBy(*file, table).agg(F.bool_and("_ok").alias("_ok"), F.count(F.lit(1)).alias("n")).filter("_ok AND n >= 2")
    return good.groupBy(*file).agg(F.min_by(table, F.struct(-F.col("n"), F.col(table))).alias(table), F.max("n").alias("n"))


def settled_snapshot(polls: DataFrame, by: list[str], time: str = "t", fresh: bool = True, timeout_s: float = 30.0, settle_s: float = 10.0, times: int = 3, slice_rows: int = scan.SLICE) -> DataFrame:
    """What a scan of a disc that is still being filled ends with: its settled feature, else the best one seen.

    A poll has ``feature`` (null: none yet), ``playlist``, ``kind``, ``duration_s``, ``candidates_playlists``,
    ``candidates_ssif``, ``candidates_m2ts`` and ``pair``; all of them are its signature, durations to a millisecond, null
    numbers as 0. A scan settles at the first poll with a feature, whose signature is that of the ``times`` last polls, whose
    duration is unknown (0 or less) or at least a minute and that comes ``settle_s`` after the scan's first poll or later
    (``fresh``: a disc that was there before needs no such wait). Polls end with the first at ``timeout_s`` or later; a scan that has not
    settled by then gives the poll with the greatest (3D, duration, candidates), the first of equals, or its last if none
    has a feature. Polls of one scan at one time come in order of their signatures; null times are left out; null keys
    are a scan. Long scans are numbered by ranges and looked at in slices that repeat the rows before them.
    Returns ``by``, settled, time, feature, playlist, kind, duration_s.
    """
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates_playlists", "candidates_ssif", "candidates_m2ts")]
    length = F.coalesce("duration_s", F.lit(0.0))
    told = polls.filter(F.col(time).isNotNull()).select(*by, time, F.struct("feature", "playlist", "kind", F.round(length, 3).alias("ms"), *counts, "pair").alias("_s"), length.alias("duration_s"))
    rows = save(scan.numbered(told, by, [time, "_s", "duration_s"], "_no"), "polls")
    starts = rows.filter("_no = 0").select(*by, F.col(time).alias("_start"))
    waited = rows.alias("r").join(starts.alias("s"), scan._same("r", "s", by)).select("r.*", (F.col(f"r.{time}") - F.col("s._start")).alias("_waited"))
    ends = waited.filter(F.col("_waited") >= timeout_s).groupBy(*by).agg(F.min("_no").alias("_end"))
    seen = waited.alias("r").join(ends.alias("s"), scan._same("r", "s", by), "left").filter("s._end IS NULL OR r._no <= s._end").select("r.*")
    own = F.floor(F.col("_no") / slice_rows)
    repeated = F.when(F.col("_no") % slice_rows >= slice_rows - times + 1, F.array(own, own + 1)).otherwise(F.array(own))
    line = Window.partitionBy(*by, "_slice").orderBy("_no")
    same = reduce(and_, [F.lag("_s", k).over(line).eqNullSafe(F.col("_s")) for k in range(1, times)], F.lit(True))
    looked = seen.withColumn("_own", own).withColumn("_slice", F.explode(repeated)).withColumn("_same", same).filter("_slice = _own")
    plausible = (F.col("duration_s") <= 0) | (F.col("duration_s") >= 60)
    has = F.col("_s.feature").isNotNull()
    settles = has & plausible & F.col("_same") & (F.col("_waited") >= (min(timeout_s, settle_s) if fresh else 0.0))
    found = F.struct(time, "_s.feature", "_s.playlist", "_s.kind", "duration_s")
    score = F.struct(F.coalesce(F.col("_s.kind") == "ssif", F.lit(False)), F.col("duration_s"), F.col("_s.candidates_playlists") + F.col("_s.candidates_ssif") + F.col("_s.candidates_m2ts"), -F.col("_no"))
    ended = looked.groupBy(*by).agg(F.min_by(found, F.when(settles, F.col("_no"))).alias("_first"), F.max_by(found, F.when(has, score)).alias("_best"), F.max_by(found, "_no").alias("_last"))
    return ended.select(*by, F.col("_first").isNotNull().alias("settled"), F.coalesce("_first", "_best", "_last").alias("_f")).select(*by, "settled", "_f.*")

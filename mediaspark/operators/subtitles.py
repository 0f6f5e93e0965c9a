"""Cue timing, repeats and the authored depth of subtitle tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import asof, scan
from .islands import runs_of

MOST_S, BRIDGE_S, MOST_DISPARITY, MOST_SPREAD, LEAST_PAIRS = 8.0, 0.7, 0.15, 0.02, 2


def cue_end(cues: DataFrame, pts: str = "pts_s", most: float = MOST_S) -> DataFrame:
    """Shown cues with their end: the next cue's start, at most ``most`` after their own."""
    after = F.lead(pts).over(Window.partitionBy("track_id").orderBy(pts))
    return cues.withColumn("end_s", F.least(F.coalesce(after, F.col(pts) + most), F.col(pts) + most)).filter("is_show")


def bridged(cues: DataFrame, gap: float = BRIDGE_S, most: float = MOST_S) -> DataFrame:
    """Every cue with what is on screen from it on: itself, nothing, or across a brief clear the cue before it."""
    w = Window.partitionBy("track_id").orderBy("pts_s")
    shown = F.col("is_show")
    rows = cues.withColumns({"_after": F.lead("pts_s").over(w), "_next_show": F.lead("is_show").over(w), "_last": F.lag("cue_id").over(w), "_last_show": F.lag("is_show").over(w)})
    bridge = ~shown & F.col("_last_show") & F.col("_next_show") & (F.col("_after") - F.col("pts_s") < gap)
    end = F.when(shown, F.least(F.coalesce("_after", F.col("pts_s") + most), F.col("pts_s") + most)).when(bridge, F.col("_after"))
    return rows.select("track_id", "pts_s", F.when(shown, F.col("cue_id")).when(bridge, F.col("_last")).alias("on_screen"), end.alias("end_s"))


def cue_at(times: DataFrame, cues: DataFrame, slice_s: float = 3600, gap: float = BRIDGE_S, most: float = MOST_S) -> DataFrame:
    """The cue on screen at each time (track_id, pts_s), or null."""
    met = asof.asof(times, bridged(cues, gap, most), ["track_id"], "pts_s", slice_s)
    return met.withColumn("cue_id", F.when(F.col("pts_s") < F.col("match.end_s"), F.col("match.on_screen"))).drop("match")


def dedup_consecutive(cues: DataFrame) -> DataFrame:
    """Shown cues whose image is not the one on screen; a clear in between makes it new."""
    before = F.lag(F.when(F.col("is_show"), F.col("image_hash"))).over(Window.partitionBy("track_id").orderBy("pts_s"))
    return cues.withColumn("_before", before).filter(F.col("is_show") & ~F.col("image_hash").eqNullSafe(F.col("_before"))).drop("_before")


def text_depth(events: DataFrame, layout: str = "sbs") -> DataFrame:
    """Authored disparity of each text track: events that stand exactly twice at one time, one in each half.

    ``events`` hold (track_id, pts, text, centre_x, play_res_x, seq). Texts meet by hash first, then in full; the depth
    is the median of at least two pairs that agree, else 0.
    """
    half = F.col("play_res_x") / 2.0
    keys = ["track_id", "pts", F.xxhash64("text").alias("_h"), "text"]
    left = F.col("centre_x") < half
    two = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(left).alias("lefts"), F.max(F.when(left, F.col("centre_x"))).alias("l"), F.max(F.when(~left, F.col("centre_x") - half)).alias("r"),
        F.min_by("centre_x", "seq").alias("first"), F.max_by("centre_x", "seq").alias("second"), F.max("play_res_x").alias("w"),
    ).filter("n = 2")
    if layout == "tab":
        pairs = two.withColumn("d", (F.col("first") - F.col("second")) / F.col("w"))
    else:
        pairs = two.filter("lefts = 1").withColumn("d", (F.col("l") - F.col("r")) / (F.col("w") / 2.0))
    stats = pairs.groupBy("track_id").agg(F.count(F.lit(1)).alias("pairs"), F.median("d").alias("_m"), (F.max("d") - F.min("d")).alias("_spread"))
    sound = (F.col("pairs") >= LEAST_PAIRS) & (F.abs("_m") <= MOST_DISPARITY) & (F.col("_spread") <= MOST_SPREAD)
    return stats.select("track_id", "pairs", F.when(sound, F.col("_m")).otherwise(0.0).alias("disparity"))


def bitmap_depth(compositions: DataFrame) -> DataFrame:
    """Disparity of each display set of two like bitmaps, one in each half; sets without a plausible pair are left out."""
    half = F.col("canvas_w") / 2.0
    left = F.col("x") + F.col("w") / 2.0 < half
    used = compositions.select("track_id", "set_no", "x", "y", "w", "h", "canvas_w", "image_hash")
    two = scan.dealt(used, ["track_id", "set_no"]).groupBy("track_id", "set_no").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(left).alias("lefts"), (F.max("w") - F.min("w")).alias("dw"), (F.max("h") - F.min("h")).alias("dh"), (F.max("y") - F.min("y")).alias("dy"),
        (F.min("image_hash") == F.max("image_hash")).alias("like"), F.max(F.when(left, F.col("x"))).alias("l"), F.max(F.when(~left, F.col("x") - half)).alias("r"), F.max("canvas_w").alias("cw"),
    )
    pairs = two.filter("n = 2 AND lefts = 1 AND like AND dw <= 2 AND dh <= 2 AND dy <= 4 AND cw >= 2")
    return pairs.withColumn("disparity", (F.col("l") - F.col("r")) / (F.col("cw") / 2.0)).filter(F.abs("disparity") <= MOST_DISPARITY).select("track_id", "set_no", "disparity")


def shown_runs(cues: DataFrame) -> DataFrame:
    """Runs of shown and of cleared cues of a track."""
    return runs_of(cues, ["track_id"], ["pts_s"], F.col("is_show"))

"""Frame analytics: histograms, distances, fits, levels, comfort, and the recurrences that no window can express."""

from __future__ import annotations

import heapq

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks, scan

LEAST_CONFIDENCE, LEVELS = 0.30, (0.02, 0.55, 0.98)


def histogram_rows(pixels: DataFrame, keys: list[str], value: str, bins: int = 64) -> DataFrame:
    """Share of each bin per frame from one row per pixel; the top edge falls in the last bin."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(value) * bins))).cast("int")
    counts = pixels.filter(F.col(value).between(0.0, 1.0)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("share", F.col("n") / total)


def histogram(luma: Column, bins: int = 64) -> Column:
    """The normalised histogram of an array of values in 0 to 1, as a vectorised kernel over frames."""

    @F.pandas_udf("array<double>")
    def kernel(frames: pd.Series) -> pd.Series:
        known = frames.notna().to_numpy()
        arrays = [np.asarray(x, float) for x in frames[known]]
        x = np.concatenate(arrays) if arrays else np.zeros(0)
        frame = np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])
        inside = (x >= 0) & (x <= 1)
        at = frame[inside] * bins + np.minimum(bins - 1, (x[inside] * bins).astype(np.int64))
        counts = np.bincount(at, minlength=len(arrays) * bins).reshape(-1, bins)
        shares = iter((counts / np.maximum(1, counts.sum(1, keepdims=True))).tolist())
        return pd.Series([next(shares) if k else None for k in known])

    return kernel(luma)


def tv_distance(a: Column, b: Column) -> Column:
    """Half the summed difference of two histograms."""
    return 0.5 * F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def tv(frames: DataFrame, by: list[str], order: list[str], hist: str = "hist") -> DataFrame:
    """Adds ``distance`` to the frame before."""
    return frames.withColumn("distance", tv_distance(F.col(hist), F.lag(hist).over(Window.partitionBy(*by).orderBy(*order))))


def affine_fit(pairs: DataFrame, keys: list[str], weight: Column | None = None, floor: float = 0.12) -> DataFrame:
    """Least squares ref = a * cur + b per group, weighted by clamped confidence if given; (1, 0) where degenerate."""
    w = F.lit(1.0) if weight is None else F.greatest(F.lit(floor), F.least(F.lit(1.0), weight))
    x, y = F.col("cur").cast("double"), F.col("ref").cast("double")
    s = pairs.groupBy(*keys).agg(F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"))
    denom = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    good = (F.abs(denom) > 1e-9) & (F.col("sw") > 1e-9)
    a = F.when(good, (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / denom).otherwise(1.0)
    fitted = s.withColumn("a", a)
    return fitted.withColumn("b", F.when(good, (F.col("sy") - F.col("a") * F.col("sx")) / F.col("sw")).otherwise(0.0)).select(*keys, "a", "b")


def fit_residual(pairs: DataFrame, keys: list[str], eps: float = 1e-6) -> DataFrame:
    """Mean error of the fit over the larger spread of both sides; ``cut`` where a flat reference meets structure."""
    met = pairs.join(affine_fit(pairs, keys), keys)
    err = F.avg(F.abs(F.col("a") * F.col("cur") + F.col("b") - F.col("ref")))
    s = met.groupBy(*keys).agg(err.alias("_e"), F.stddev_pop(F.col("ref").cast("double")).alias("_r"), F.stddev_pop(F.col("cur").cast("double")).alias("_c"))
    flat_r, flat_c = F.col("_r") < eps, F.col("_c") < eps
    residual = F.when(flat_r & flat_c, 0.0).when(flat_r, -1.0).otherwise(F.col("_e") / F.greatest("_r", "_c"))
    return s.select(*keys, residual.alias("residual"), (flat_r & ~flat_c).alias("cut"))


def depth_levels(field: Column, confidence: Column) -> Column:
    """Struct (lo, mid, hi): order statistics over the confident pixels, or over all where they are too few."""
    pairs = F.arrays_zip(field.alias("v"), confidence.alias("c"))
    sure = F.transform(F.filter(pairs, lambda p: p["c"] >= LEAST_CONFIDENCE), lambda p: p["v"])
    n = F.size(field)
    chosen = F.array_sort(F.when(F.size(sure) < F.greatest(F.lit(64), F.floor(n / 20)), field).otherwise(sure))
    at = lambda q: F.get(chosen, F.floor(F.lit(q) * (F.size(chosen) - 1)).cast("int"))
    return F.struct(*[at(q).alias(name) for q, name in zip(LEVELS, ("lo", "mid", "hi"), strict=True)])


def coverage(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Share of holes, of accepted holes, and the mean confidence of those accepted."""
    n, holes, acc = F.count(F.lit(1)), F.count_if("hole"), F.count_if(F.col("hole") & F.col("accepted"))
    sure = F.coalesce(F.avg(F.when(F.col("hole") & F.col("accepted"), F.col("confidence"))), F.lit(0.0))
    return pixels.groupBy(*keys).agg((100.0 * holes / F.greatest(F.lit(1), n)).alias("holes_pct"), (100.0 * acc / F.greatest(F.lit(1), holes)).alias("accepted_pct"), sure.alias("mean_confidence"))


def rivalry(samples: DataFrame, keys: list[str], error: str = "error", bad: float = 8.0) -> DataFrame:
    """Mean and upper percentiles of the error over samples that pass their gates, and the share over ``bad``."""
    e, good = F.col(error), samples.filter("passes")
    stats = good.groupBy(*keys).agg(F.avg(e).alias("mean"), (100.0 * F.avg((e > bad).cast("double"))).alias("bad_pct"))
    return ranks.with_quantiles(stats, good, keys, error, {"p95": 0.95, "p99": 0.99})


def comfort(frames: DataFrame, by: list[str], order: list[str], width: int, screen_m: float = 1.0, pixels: int = 1920, ipd_m: float = 0.063, distance_m: float = 2.0) -> DataFrame:
    """Viewing comfort of each disparity field: conflict, gradient, velocity from the frame before, and their energy.

    ``field`` is a row-major array of pixels, ``t_s`` its time; no velocity across ``scene_cut``.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = frames.withColumns({"_before": F.when(~F.col("scene_cut"), F.lag("field").over(w)), "_dt": F.col("t_s") - F.lag("t_s").over(w)})
    per_px = screen_m / pixels / (ipd_m * distance_m)

    @F.pandas_udf("vac_rms double, vac_p95 double, gradient_p95 double, velocity_p95 double, energy double")
    def kernel(field: pd.Series, before: pd.Series, dt: pd.Series) -> pd.DataFrame:
        soft = lambda x: float(np.mean(np.sqrt(x * x + 1e-6) - 1e-3)) if x.size else 0.0
        p95 = lambda x: float(np.percentile(np.abs(x), 95.0)) if x.size else 0.0
        out = []
        for f, b, s in zip(field, before, dt, strict=True):
            d = np.asarray(f, float).reshape(-1, width)
            conflict = d * per_px
            gradient = np.concatenate([np.diff(d, axis=1).ravel(), np.diff(d, axis=0).ravel()])
            velocity = (d - np.asarray(b, float).reshape(-1, width)) / s if b is not None and s and s > 0 else np.zeros(0)
            energy = soft(conflict / 0.60) + 0.35 * soft(gradient / 0.75) + 0.45 * soft(velocity / 90.0)
            out.append((float(np.sqrt(np.mean(conflict**2))), p95(conflict), p95(gradient), p95(velocity), energy))
        return pd.DataFrame(out, columns=["vac_rms", "vac_p95", "gradient_p95", "velocity_p95", "energy"])

    return rows.withColumn("_m", kernel("field", "_before", "_dt")).select(*frames.columns, "_m.*")


def letterbox(luma: Column, width: int) -> Column:
    """Struct (valid, top, bottom): the black bars of a frame, symmetric, bounded and with visible content inside."""

    @F.pandas_udf("valid boolean, top int, bottom int")
    def kernel(frames: pd.Series) -> pd.DataFrame:
        out = []
        for f in frames:
            x = np.asarray(f, np.float32).reshape(-1, width)
            h = len(x)
            black = (x.mean(1) <= 0.030) & ((x <= 0.055).sum(1) >= np.ceil(width * 0.985))
            most, least = int(h * 0.36), max(2, int(h * 0.015))
            edge = lambda rows: int(np.argmin(np.append(rows[:most], False)))
            top, bottom = edge(black), edge(black[::-1])
            inside = h - top - bottom
            good = h >= 32 and width >= 32 and min(top, bottom) >= least and abs(top - bottom) <= least and top + bottom < int(h * 0.55)
            if good:
                k = min(4, inside)
                probe = np.concatenate([x[top : top + k], x[h - bottom - k : h - bottom]])
                good = probe.size > 0 and (probe >= 0.075).sum() >= int(probe.size * 0.02)
            out.append((bool(good), top if good else 0, bottom if good else 0))
        return pd.DataFrame(out, columns=["valid", "top", "bottom"])

    return kernel(luma)


def recurrence(df: DataFrame, by: list[str], order: list[str], schema: str, step: Callable[[pd.DataFrame], dict]) -> DataFrame:
    """``df`` with columns that ``step`` computes from each group's rows in order.

    For rules whose next value depends on their own last output. Rows must be narrow: drop arrays before.
    """

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return pdf.assign(**step(pdf))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(*by).applyInPandas(apply, f"{fields}, {schema}")


def analysed(frames: DataFrame, by: list[str], order: list[str], depth: int = 5, pts: str = "pts") -> DataFrame:
    """Adds ``turn``: the place at which a frame leaves a buffer that holds ``depth`` frames and gives out the earliest.

    The rest of the buffer follows at the end of its stream.
    """

    def step(pdf: pd.DataFrame) -> dict:
        held: list[tuple[float, int]] = []
        turn = [0] * len(pdf)
        given = 0
        for i, p in enumerate(pdf[pts].to_numpy(float)):
            heapq.heappush(held, (p, i))
            if len(held) > depth:
                turn[heapq.heappop(held)[1]] = given
                given += 1
        for k, (_, i) in enumerate(sorted(held)):
            turn[i] = given + k
        return {"turn": turn}

    return recurrence(frames, by, order, "turn int", step)


def adaptive_cuts(frames: DataFrame, by: list[str], order: list[str], threshold: float = 0.35, gain: float = 3.0, alpha: float = 0.05) -> DataFrame:
    """Adds ``cut``: a residual over the threshold that also stands out of the running level between cuts."""

    def step(pdf: pd.DataFrame, state: list | None) -> tuple[dict, list]:
        (level,), out = state or [None], []
        for r in pdf["residual"].to_numpy(float).tolist():
            hit = r > threshold and (level is None or r > gain * level)
            if not hit:
                level = r if level is None else level + alpha * (r - level)
            out.append(bool(hit))
        return {"cut": out}, [level]

    return scan.carried(frames, by, order, "cut boolean", step)


def tone(frames: DataFrame, by: list[str], order: list[str], expand: float = 0.20, contract: float = 0.06, cap: float = 0.04) -> DataFrame:
    """Adds the smoothed levels tone_lo, tone_hi: they widen fast, narrow slowly, move a bounded step and restart at cuts."""

    def step(pdf: pd.DataFrame, now: list | None) -> tuple[dict, list]:
        los, his = [], []
        for lo, hi, cut in zip(pdf["lo"].to_numpy(float).tolist(), pdf["hi"].to_numpy(float).tolist(), pdf["cut"].to_numpy(bool), strict=True):
            if now is None or cut:
                now = (lo, hi)
            else:
                most = max(1e-6, now[1] - now[0]) * cap
                d_lo = (expand if lo < now[0] else contract) * (lo - now[0])
                d_hi = (expand if hi > now[1] else contract) * (hi - now[1])
                now = (now[0] + min(most, max(-most, d_lo)), now[1] + min(most, max(-most, d_hi)))
            los.append(now[0])
            his.append(now[1])
        return {"tone_lo": los, "tone_hi": his}, list(now)

    return scan.carried(frames, by, order, "tone_lo double, tone_hi double", step)


def slew(frames: DataFrame, by: list[str], order: list[str], limit: float, velocity: float) -> DataFrame:
    """Adds ``limited``: the value within the comfort limit and within reach of the last output; free at cuts."""

    def step(pdf: pd.DataFrame, state: list | None) -> tuple[dict, list]:
        out, (last, then) = [], state or [None, None]
        for v, t, cut in zip(pdf["value"].to_numpy(float).tolist(), pdf["t_s"].to_numpy(float).tolist(), pdf["cut"].to_numpy(bool), strict=True):
            v = min(limit, max(-limit, v))
            if last is not None and not cut and t > then:
                reach = velocity * (t - then)
                v = min(last + reach, max(last - reach, v))
            out.append(v)
            last, then = v, t
        return {"limited": out}, [last, then]

    return scan.carried(frames, by, order, "limited double", step)


def letterbox_stable(obs: DataFrame, by: list[str], order: list[str], height: int, times: int = 8) -> DataFrame:
    """Adds crop_top, crop_bottom (null until decided): bars seen ``times`` times near the run's first, or as often none."""

    near = max(2, height // 100)

    def step(pdf: pd.DataFrame, state: list | None) -> tuple[dict, list]:
        anchor, n, none, crop = state or [(0, 0), 0, 0, (None, None)]
        tops, bottoms = [], []
        for valid, top, bottom in zip(pdf["valid"].tolist(), pdf["top"].tolist(), pdf["bottom"].tolist(), strict=True):
            if valid:
                none = 0
                if abs(top - anchor[0]) <= near and abs(bottom - anchor[1]) <= near:
                    n += 1
                else:
                    anchor, n, crop = (top, bottom), 1, (None, None)
                if n >= times:
                    crop = anchor
            else:
                anchor, n, none = (0, 0), 0, none + 1
                crop = (0, 0) if none >= times else (None, None)
            tops.append(crop[0])
            bottoms.append(crop[1])
        return {"crop_top": pd.array(tops, "Int32"), "crop_bottom": pd.array(bottoms, "Int32")}, [anchor, n, none, crop]

    return scan.carried(obs, by, order, "crop_top int, crop_bottom int", step)


def cadence(frames: DataFrame, by: list[str], order: list[str], fps: float, t_ms: str = "t_ms") -> DataFrame:
    """The frames kept at a target rate: a carried deadline alternates the gaps, missed slots are skipped.

    Deadlines are whole intervals after a stream's first frame, and the state is their number, so that a slice that begins
    without one agrees with the stream from its first kept frame on.
    """
    interval = 1000.0 / fps
    w = frames.groupBy(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]).agg(F.min_by(t_ms, F.struct(*order)).cast("double").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    rows = frames.join(w, same).select(*frames.columns, "_first")

    def step(pdf: pd.DataFrame, state: list | None) -> tuple[dict, list]:
        first, out = float(pdf["_first"].iloc[0]), []
        slot = state[0] if state else max(0, int((float(pdf[t_ms].iloc[0]) - first) // interval))
        for t in pdf[t_ms].to_numpy(float):
            due = first + slot * interval
            keep = bool(t + 0.05 >= due)
            if keep:
                slot += max(0, int((t - due) // interval)) + 1
            out.append(keep)
        return {"_keep": out}, [slot]

    return scan.carried(rows, by, order, "_keep boolean", step).filter("_keep").drop("_keep", "_first")


def thin_points(points: DataFrame, by: list[str], order: list[str], gap: float, value: str = "t_s") -> DataFrame:
    """Sync points in order of arrival, without those within ``gap`` of one that was kept."""
    return scan.thinned(points, by, order, value, gap)


def throttle(events: DataFrame, by: list[str], order: list[str], gap: float, value: str = "t_s") -> DataFrame:
    """At most one event per ``gap``: the first, then always the next whose time is the last kept one's plus ``gap`` or more."""
    return scan.spaced(events, by, order, value, gap)


def monotone_clock(ticks: DataFrame, by: list[str], order: list[str], value: str = "value", jump: float = 1.0) -> DataFrame:
    """Adds ``held``: steps back of up to ``jump`` are ignored, larger ones accepted."""

    def step(pdf: pd.DataFrame, state: list | None) -> tuple[dict, list]:
        (held,), out = state or [None], []
        for v in pdf[value].to_numpy(float).tolist():
            held = v if held is None or v >= held or held - v > jump else held
            out.append(held)
        return {"held": out}, [held]

    return scan.carried(ticks, by, order, "held double", step)


def ema_fps(events: DataFrame, by: list[str], order: list[str], t: str = "t_s", keep: float = 0.9) -> DataFrame:
    """Adds ``fps``: the smoothed inverse of the time since the event before; steps that are not positive are ignored."""

    def step(pdf: pd.DataFrame, state: list | None) -> tuple[dict, list]:
        (last, fps), out = state or [None, None], []
        for now in pdf[t].to_numpy(float).tolist():
            if last is not None and now > last:
                inst = 1.0 / (now - last)
                fps = inst if fps is None else keep * fps + (1 - keep) * inst
            last = now
            out.append(fps)
        return {"fps": pd.Series(out, dtype="float64")}, [last, fps]

    return scan.carried(events, by, order, "fps double", step)

"""Queries of frames, subtitles, telemetry and live sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, frames, islands, ranks, sessions, subtitles, telemetry, timeline
from ..sources import readers
from ..views import run_sql, view
from .recursion import fold
from .registry import query

# --- frames -----------------------------------------------------------------------------------------------------------


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 64 values: stream, place in it, and the values scaled to 0 to 1."""
    return run_sql(spark, sf_dir, "SELECT label AS stream_id, vec_id AS pts, embedding FROM embeddings")


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), b AS (SELECT vec_id, CAST(least(15, floor(abs(v) * 16)) AS INT) AS bin, count(*) AS n FROM x WHERE abs(v) <= 1 GROUP BY ALL)
    SELECT vec_id, bin, n, round(n / (sum(n) OVER (PARTITION BY vec_id))::DOUBLE, 9) AS share FROM b""")
def luma_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    rows = _embeddings(spark, sf_dir).select("pts", frames.histogram(values, 16).alias("h"), F.size(F.filter(values, lambda v: v <= 1)).alias("n"))
    bins = rows.select("pts", "n", F.posexplode("h").alias("bin", "share")).filter("share > 0")
    return bins.select(F.col("pts").alias("vec_id"), "bin", F.round(F.col("share") * F.col("n")).cast("bigint").alias("n"), F.round("share", 9).alias("share"))


_HIST = "[abs(v)::DOUBLE / list_sum([abs(w)::DOUBLE for w in embedding]) for v in embedding]"
_TV = f"""h AS (SELECT label AS stream_id, vec_id AS pts, {_HIST} AS hist FROM embeddings), p AS (SELECT *, lag(hist) OVER (PARTITION BY stream_id ORDER BY pts) AS b FROM h),
    tv AS (SELECT stream_id, pts, CASE WHEN b IS NOT NULL THEN 0.5 * list_sum([abs(hist[i] - b[i]) for i in range(1, 65)]) END AS distance FROM p)"""


def _tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + F.abs(v.cast("double")))
    hist = F.transform("embedding", lambda v: F.abs(v.cast("double")) / F.col("total"))
    rows = _embeddings(spark, sf_dir).withColumn("total", total).select("stream_id", "pts", hist.alias("hist"))
    return frames.tv(rows, ["stream_id"], ["pts"]).select("stream_id", "pts", "distance")


@query(f"WITH {_TV} SELECT stream_id, pts, round(distance, 6) AS distance FROM tv")
def tv_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tv(spark, sf_dir).withColumn("distance", F.round("distance", 6))


@query("SELECT stream_id, seq, pts FROM (SELECT *, lag(pts) OVER (PARTITION BY stream_id ORDER BY seq) AS b FROM frames) x WHERE distance >= 0.42 AND pts > b")
def hard_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.hard_cuts(view(spark, sf_dir, "frames"), ["stream_id"], ["seq"]).select("stream_id", "seq", "pts")


@query("""WITH r AS (SELECT *, sum(CASE WHEN depth_cut OR distance < 0.42 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq) AS g FROM frames)
    SELECT stream_id, seq, depth_cut OR (distance >= 0.42 AND sum(CASE WHEN NOT depth_cut AND distance >= 0.42 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, g ORDER BY seq) % 2 = 0) AS cut FROM r""")
def confirmed_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.confirmed_cuts(view(spark, sf_dir, "frames"), ["stream_id"], ["seq"]).select("stream_id", "seq", "cut")


_ONSETS = """m AS (SELECT *, NOT depth_cut AND motion >= 4.5 AS burst, NOT depth_cut AND motion < 0.6 * 4.5 AS calm FROM frames),
    p AS (SELECT *, coalesce(sum(burst::INT) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM m),
    o AS (SELECT *, burst AND (prior = 0 OR coalesce(sum(calm::INT) OVER (PARTITION BY stream_id, prior ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3) AS onset FROM p)"""


@query(f"WITH {_ONSETS} SELECT stream_id, seq, onset FROM o")
def motion_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.motion_onsets(view(spark, sf_dir, "frames"), ["stream_id"], ["seq"], cut="depth_cut").select("stream_id", "seq", "onset")


@query(f"WITH {_ONSETS} SELECT stream_id, seq, 'onset' AS kind FROM o WHERE onset UNION ALL SELECT stream_id, seq, 'cut' FROM (SELECT *, lag(pts) OVER (PARTITION BY stream_id ORDER BY seq) AS b FROM frames) x WHERE distance >= 0.42 AND pts > b")
def event_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    onsets = motion_onsets(spark, sf_dir).filter("onset").select("stream_id", "seq", F.lit("onset").alias("kind"))
    return onsets.unionByName(hard_cuts(spark, sf_dir).select("stream_id", "seq", F.lit("cut").alias("kind")))


@query(f"WITH {_ONSETS} SELECT stream_id, seq FROM (SELECT *, lag(pts) OVER (PARTITION BY stream_id ORDER BY seq) AS b FROM frames) x WHERE distance >= 0.42 AND pts > b AND NOT EXISTS (SELECT 1 FROM o WHERE o.onset AND o.stream_id = x.stream_id AND o.seq = x.seq)")
def skipped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_cuts(spark, sf_dir).select("stream_id", "seq").join(motion_onsets(spark, sf_dir).filter("onset").select("stream_id", "seq"), ["stream_id", "seq"], "left_anti")


_LEVELS = "CASE WHEN len(s) < greatest(64, 64 // 20) THEN a ELSE s END"


@query(f"""SELECT vec_id, round(l[1 + CAST(floor(0.02 * (len(l) - 1)) AS INT)], 6) AS lo, round(l[1 + CAST(floor(0.55 * (len(l) - 1)) AS INT)], 6) AS mid, round(l[1 + CAST(floor(0.98 * (len(l) - 1)) AS INT)], 6) AS hi
    FROM (SELECT vec_id, list_sort({_LEVELS}) AS l FROM (SELECT vec_id, [v::DOUBLE for v in embedding] AS a, [v::DOUBLE for v in embedding if abs(v) >= 0.30] AS s FROM embeddings) x) y""")
def depth_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.transform("embedding", lambda v: v.cast("double"))
    out = _embeddings(spark, sf_dir).select(F.col("pts").alias("vec_id"), frames.depth_levels(field, F.transform(field, F.abs)).alias("l"))
    return out.select("vec_id", *[F.round(f"l.{c}", 6).alias(c) for c in ("lo", "mid", "hi")])


_PAIRS = "SELECT l_suppkey AS stream_id, l_quantity AS cur, l_extendedprice / 1000 AS ref, l_discount * 10 AS conf FROM lineitem"


@query(f"""WITH p AS ({_PAIRS}), w AS (SELECT *, greatest(0.12, least(1.0, conf)) AS w FROM p), s AS (SELECT stream_id, sum(w) AS sw, sum(w * cur) AS sx, sum(w * ref) AS sy, sum(w * cur * cur) AS sxx, sum(w * cur * ref) AS sxy FROM w GROUP BY stream_id)
    SELECT stream_id, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 6) AS a, round((sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, 5) AS b FROM s""")
def scale_shift_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.affine_fit(run_sql(spark, sf_dir, _PAIRS), ["stream_id"], F.col("conf"))
    return out.select("stream_id", F.round("a", 6).alias("a"), F.round("b", 5).alias("b"))


@query(f"""WITH p AS ({_PAIRS}), f AS (SELECT stream_id, regr_slope(ref, cur) AS a, regr_intercept(ref, cur) AS b FROM p GROUP BY stream_id)
    SELECT p.stream_id, round(avg(abs(a * cur + b - ref)) / greatest(stddev_pop(ref), stddev_pop(cur)), 6) AS residual, false AS cut FROM p JOIN f ON p.stream_id = f.stream_id GROUP BY p.stream_id""")
def fit_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.fit_residual(run_sql(spark, sf_dir, _PAIRS), ["stream_id"]).withColumn("residual", F.round("residual", 6))


_PIXELS = "SELECT l_suppkey AS stream_id, l_returnflag = 'R' AS hole, l_linenumber % 2 = 0 AS accepted, l_discount AS confidence, l_extendedprice / 5000 AS error, l_tax > 0 AS passes FROM lineitem"


@query(f"""WITH p AS ({_PIXELS}) SELECT stream_id, round(100.0 * count(*) FILTER (WHERE hole) / count(*), 6)::DOUBLE AS holes_pct, round(100.0 * count(*) FILTER (WHERE hole AND accepted) / greatest(1, count(*) FILTER (WHERE hole)), 6)::DOUBLE AS accepted_pct,
    round(coalesce(avg(confidence) FILTER (WHERE hole AND accepted), 0), 6) AS mean_confidence FROM p GROUP BY stream_id""")
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.coverage(run_sql(spark, sf_dir, _PIXELS), ["stream_id"])
    return out.select("stream_id", *[F.round(c, 6).alias(c) for c in ("holes_pct", "accepted_pct", "mean_confidence")])


@query(f"""WITH p AS ({_PIXELS}) SELECT stream_id, round(avg(error), 4) AS mean, round(quantile_cont(error, 0.95), 4) AS p95, round(quantile_cont(error, 0.99), 4) AS p99, round(100.0 * avg((error > 8)::INT), 6)::DOUBLE AS bad_pct FROM p WHERE passes GROUP BY stream_id""")
def rivalry_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.rivalry(run_sql(spark, sf_dir, _PIXELS), ["stream_id"])
    return out.select("stream_id", *[F.round(c, 4).alias(c) for c in ("mean", "p95", "p99")], F.round("bad_pct", 6).alias("bad_pct"))


@query()
def comfort_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.transform("embedding", lambda v: v.cast("double") * 40)
    rows = _embeddings(spark, sf_dir).select("stream_id", "pts", (F.col("pts") / 24.0).alias("t_s"), (F.col("pts") % 50 == 0).alias("scene_cut"), field.alias("field"))
    out = frames.comfort(rows, ["stream_id"], ["pts"], 8)
    return out.select("stream_id", "pts", *[F.round(c, 6).alias(c) for c in ("vac_rms", "vac_p95", "gradient_p95", "velocity_p95", "energy")])


def _small_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 32 by 32: half of the vectors under a matte of black rows."""
    value = F.transform("embedding", lambda v: F.least(F.lit(1.0), F.abs(v.cast("double")) * 4))
    black = F.transform("embedding", lambda v: F.lit(0.0))
    band = F.when(F.col("pts") % 2 == 0, 1).otherwise(0)
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.when((k < 2 * band) | (k >= 16 - 2 * band), black).otherwise(value)))
    return _embeddings(spark, sf_dir).select("stream_id", "pts", rows.alias("luma"))


@query()
def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small_frames(spark, sf_dir).select("stream_id", "pts", frames.letterbox(F.col("luma"), 32).alias("b")).select("stream_id", "pts", "b.*")


@query(fold(
    "SELECT user_id AS stream_id, event_id AS seq, value > 20 AS valid, CAST(130 + event_id % 5 AS INT) AS top, CAST(131 + event_id % 4 AS INT) AS bottom FROM events", "stream_id", "seq",
    {
        "_near": ("", "abs(s.top - r.a) <= 10 AND abs(s.bottom - r.b) <= 10"),
        "n": ("0", "CASE WHEN s.valid AND {_near} THEN r.n + 1 WHEN s.valid THEN 1 ELSE 0 END"),
        "a": ("0", "CASE WHEN NOT s.valid THEN 0 WHEN {_near} THEN r.a ELSE s.top END"),
        "b": ("0", "CASE WHEN NOT s.valid THEN 0 WHEN {_near} THEN r.b ELSE s.bottom END"),
        "none": ("0", "CASE WHEN s.valid THEN 0 ELSE r.none + 1 END"),
        "c0": ("NULL::INT", "CASE WHEN NOT s.valid THEN CASE WHEN {none} >= 8 THEN 0 END WHEN {_near} THEN CASE WHEN {n} >= 8 THEN r.a ELSE r.c0 END END"),
        "c1": ("NULL::INT", "CASE WHEN NOT s.valid THEN CASE WHEN {none} >= 8 THEN 0 END WHEN {_near} THEN CASE WHEN {n} >= 8 THEN r.b ELSE r.c1 END END"),
    },
    "s.stream_id, s.seq, s.valid, s.top, s.bottom, r.c0 AS crop_top, r.c1 AS crop_bottom",
))
def letterbox_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = run_sql(spark, sf_dir, "SELECT user_id AS stream_id, event_id AS seq, value > 20 AS valid, CAST(130 + event_id % 5 AS INT) AS top, CAST(131 + event_id % 4 AS INT) AS bottom FROM events")
    return frames.letterbox_stable(obs, ["stream_id"], ["seq"], 1080)


@query(fold(
    "SELECT user_id AS stream_id, event_id AS seq, value / 60 AS residual FROM events", "stream_id", "seq",
    {"cut": ("false", "s.residual > 0.35::DOUBLE AND (r.level IS NULL OR s.residual > 3 * r.level)"), "level": ("NULL::DOUBLE", "CASE WHEN {cut} THEN r.level WHEN r.level IS NULL THEN s.residual ELSE r.level + 0.05::DOUBLE * (s.residual - r.level) END")},
    "s.stream_id, s.seq, s.residual, r.cut",
))
def adaptive_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS stream_id, event_id AS seq, value / 60 AS residual FROM events")
    return frames.adaptive_cuts(rows, ["stream_id"], ["seq"])


@query(fold(
    "SELECT user_id AS stream_id, event_id AS seq, value / 100 AS lo, value / 100 + 0.5 AS hi, event_type = 'error' AS cut FROM events", "stream_id", "seq",
    {
        "_most": ("", "greatest(1e-6::DOUBLE, r.h - r.l) * 0.04::DOUBLE"),
        "l": ("NULL::DOUBLE", "CASE WHEN r.l IS NULL OR s.cut THEN s.lo ELSE r.l + least({_most}, greatest(-{_most}, CASE WHEN s.lo < r.l THEN 0.20::DOUBLE ELSE 0.06::DOUBLE END * (s.lo - r.l))) END"),
        "h": ("NULL::DOUBLE", "CASE WHEN r.h IS NULL OR s.cut THEN s.hi ELSE r.h + least({_most}, greatest(-{_most}, CASE WHEN s.hi > r.h THEN 0.20::DOUBLE ELSE 0.06::DOUBLE END * (s.hi - r.h))) END"),
    },
    "s.stream_id, s.seq, s.lo, s.hi, s.cut, round(r.l, 9) AS tone_lo, round(r.h, 9) AS tone_hi",
))
def tone_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS stream_id, event_id AS seq, value / 100 AS lo, value / 100 + 0.5 AS hi, event_type = 'error' AS cut FROM events")
    out = frames.tone(rows, ["stream_id"], ["seq"])
    return out.withColumns({c: F.round(c, 9) for c in ("tone_lo", "tone_hi")})


@query(fold(
    "SELECT user_id AS stream_id, event_id AS seq, value - 20 AS value, event_id / 24.0::DOUBLE AS t_s, event_type = 'error' AS cut FROM events", "stream_id", "seq",
    {
        "_v": ("", "least(30, greatest(-30, s.value))"),
        "v": ("NULL::DOUBLE", "CASE WHEN r.v IS NULL OR s.cut OR s.t_s <= r.t THEN {_v} ELSE least(r.v + 4 * (s.t_s - r.t), greatest(r.v - 4 * (s.t_s - r.t), {_v})) END"),
        "t": ("NULL::DOUBLE", "s.t_s"),
    },
    "s.stream_id, s.seq, s.value, s.t_s, s.cut, round(r.v, 9) AS limited",
))
def slew_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS stream_id, event_id AS seq, value - 20 AS value, event_id / CAST(24.0 AS DOUBLE) AS t_s, event_type = 'error' AS cut FROM events")
    return frames.slew(rows, ["stream_id"], ["seq"], 30.0, 4.0).withColumn("limited", F.round("limited", 9))


# --- subtitles --------------------------------------------------------------------------------------------------------


@query("SELECT track_id, cue_id, least(coalesce(nxt, pts_s + 8), pts_s + 8) AS end_s FROM (SELECT *, lead(pts_s) OVER (PARTITION BY track_id ORDER BY pts_s) AS nxt FROM cues) x WHERE is_show")
def cue_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.cue_end(view(spark, sf_dir, "cues")).select("track_id", "cue_id", "end_s")


_BRIDGED = """w AS (SELECT *, lead(pts_s) OVER t AS nxt, lead(is_show) OVER t AS ns, lag(cue_id) OVER t AS lc, lag(is_show) OVER t AS ls FROM cues WINDOW t AS (PARTITION BY track_id ORDER BY pts_s)),
    b AS (SELECT track_id, pts_s, CASE WHEN is_show THEN cue_id WHEN ls AND ns AND nxt - pts_s < 0.7 THEN lc END AS c, CASE WHEN is_show THEN least(coalesce(nxt, pts_s + 8), pts_s + 8) WHEN ls AND ns AND nxt - pts_s < 0.7 THEN nxt END AS e FROM w)"""
_TIMES = "SELECT DISTINCT conv_id AS track_id, CAST(turn AS DOUBLE) * 0.7 - 0.2 AS pts_s FROM conversations"


@query(f"WITH {_BRIDGED}, t AS ({_TIMES}) SELECT t.track_id, round(t.pts_s, 6) AS pts_s, CASE WHEN t.pts_s < b.e THEN b.c END AS cue_id FROM t ASOF LEFT JOIN b ON t.track_id = b.track_id AND t.pts_s >= b.pts_s")
def cue_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.cue_at(run_sql(spark, sf_dir, _TIMES), view(spark, sf_dir, "cues")).withColumn("pts_s", F.round("pts_s", 6))


@query("SELECT track_id, cue_id FROM (SELECT *, lag(CASE WHEN is_show THEN image_hash END) OVER (PARTITION BY track_id ORDER BY pts_s) AS b FROM cues) x WHERE is_show AND image_hash IS DISTINCT FROM b")
def dedup_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.dedup_consecutive(view(spark, sf_dir, "cues")).select("track_id", "cue_id")


_SOUND = "SELECT track_id, count(*) AS pairs, round(CASE WHEN count(*) >= 2 AND abs(median(d)) <= 0.15 AND max(d) - min(d) <= 0.02 THEN median(d) ELSE 0 END, 9) AS disparity FROM p GROUP BY track_id"


@query(f"""WITH g AS (SELECT track_id, pts, text, count(*) FILTER (WHERE centre_x < 960) AS lefts, max(centre_x) FILTER (WHERE centre_x < 960) AS l, max(centre_x - 960) FILTER (WHERE centre_x >= 960) AS r FROM text_events GROUP BY ALL HAVING count(*) = 2),
    p AS (SELECT track_id, (l - r) / 960 AS d FROM g WHERE lefts = 1) {_SOUND}""")
def authored_text_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitles.text_depth(view(spark, sf_dir, "text_events")).withColumn("disparity", F.round("disparity", 9))


@query(f"""WITH e AS (SELECT track_id, pts, text, seq, centre_x - CASE WHEN centre_x >= 960 THEN 960 ELSE 0 END AS centre_x FROM text_events),
    p AS (SELECT track_id, (arg_min(centre_x, seq) - arg_max(centre_x, seq)) / 1920 AS d FROM e GROUP BY track_id, pts, text HAVING count(*) = 2) {_SOUND}""")
def authored_text_depth_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames one above the other: both events stand at nearly the same place across."""
    events = view(spark, sf_dir, "text_events").withColumn("centre_x", F.when(F.col("centre_x") >= 960, F.col("centre_x") - 960).otherwise(F.col("centre_x")))
    return subtitles.text_depth(events, "tab").withColumn("disparity", F.round("disparity", 9))


_COMPS = "SELECT l_suppkey AS track_id, l_orderkey AS set_no, CAST(l_partkey % 3 + CASE WHEN l_linenumber % 2 = 0 THEN 1160 ELSE 200 END AS DOUBLE) AS x, CAST(l_linenumber % 3 AS INT) AS y, CAST(300 + l_partkey % 2 AS INT) AS w, 40 AS h, 1920 AS canvas_w, 7 AS image_hash FROM lineitem"


@query(f"""WITH c AS ({_COMPS}), g AS (SELECT track_id, set_no, count(*) AS n, count(*) FILTER (WHERE x + w / 2.0 < 960) AS lefts, max(x) FILTER (WHERE x + w / 2.0 < 960) AS l, max(x - 960) FILTER (WHERE x + w / 2.0 >= 960) AS r FROM c GROUP BY ALL)
    SELECT track_id, set_no, round((l - r) / 960, 9) AS disparity FROM g WHERE n = 2 AND lefts = 1 AND abs((l - r) / 960) <= 0.15""")
def authored_bitmap_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _COMPS.replace("l_suppkey AS track_id, l_orderkey", "l_suppkey AS track_id, l_orderkey")
    return subtitles.bitmap_depth(run_sql(spark, sf_dir, sql)).withColumn("disparity", F.round("disparity", 9))


# --- telemetry --------------------------------------------------------------------------------------------------------

_LINE = "concat('state=', CASE WHEN event_id % 9 = 0 THEN 'idle' ELSE 'running' END, ' junk fps=', CASE WHEN event_id % 7 = 0 THEN '0.0' WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id % 60 AS STRING) END, '  infer=1=2 fps=', CASE WHEN event_id % 7 = 0 THEN '0.0' WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id % 90 AS STRING) END)"


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'idle' ELSE 'running' END AS state, CASE WHEN event_id % 7 = 0 THEN '0.0' WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id % 90 AS STRING) END AS fps, '1=2' AS infer, 3 AS n FROM events")
def src_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, f"SELECT event_id, {_LINE} AS line FROM events").withColumn("m", telemetry.parse_status(F.col("line")))
    return rows.select("event_id", *[F.col("m")[k].alias(k) for k in ("state", "fps", "infer")], F.size("m").alias("n"))


@query("""WITH r AS (SELECT user_id AS session, event_id, TRY_CAST(CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id % 90 AS STRING) END AS DOUBLE) AS fps FROM events WHERE event_id % 9 <> 0 AND event_id % 7 <> 0), f AS (SELECT * FROM r WHERE coalesce(fps, 1) <> 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY event_id) AS k, count(*) OVER (PARTITION BY session) AS n FROM f)
    SELECT session, 'fps' AS name, count(fps) AS n, median(fps) AS median, min(fps) AS min, max(fps) AS max FROM k WHERE (k > 1 OR n = 1) AND fps IS NOT NULL GROUP BY session""")
def metric_summary_steady(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, f"SELECT user_id AS session, event_id, {_LINE} AS line FROM events").withColumn("m", telemetry.parse_status(F.col("line")))
    return telemetry.steady_summary(telemetry.steady(rows, ["session"], ["event_id"], ["fps"]), ["session"])


@query("""SELECT name, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max FROM samples GROUP BY name""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranks.summary(view(spark, sf_dir, "samples"), ["name"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p50", "p95", "p99")})


_RANK = {"round": "round_even(q * (n - 1), 0)", "half_up": "floor(q * (n - 1) + 0.5)", "trunc": "floor(q * n)", "ceil": "ceil(q * n) - 1", "floor": "floor(q * (n - 1))"}
_ONE = "SELECT session, '{r}' AS rule, value FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY session) AS n, 0.95::DOUBLE AS q FROM samples) x WHERE k = greatest(0, least(n - 1, {e}))"


@query(" UNION ALL ".join(_ONE.format(r=r, e=e) for r, e in _RANK.items()) + " UNION ALL SELECT session, 'linear', round(quantile_cont(value, 0.95), 6) FROM samples GROUP BY session")
def rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.placed(view(spark, sf_dir, "samples"), ["session"], "value")
    out = None
    for rule in ranks.RULES:
        one = ranks.pick(rows, ["session"], 0.95, rule).select("session", F.lit(rule).alias("rule"), (F.round("value", 6) if rule == "linear" else F.col("value")).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT session, name, seq, t - lag(t) OVER (PARTITION BY session, name ORDER BY seq) AS interval FROM samples")
def interval_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.intervals(view(spark, sf_dir, "samples"), ["session", "name"], ["seq"], "t").select("session", "name", "seq", "interval")


@query("SELECT session, seq, k, k - coalesce(lag(k) OVER (PARTITION BY session ORDER BY seq), 0) AS delta FROM (SELECT session, seq, seq * 3 + session AS k FROM samples) x")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.deltas(run_sql(spark, sf_dir, "SELECT session, seq, seq * 3 + session AS k FROM samples"), ["session"], ["seq"], "k").select("session", "seq", "k", "delta")


@query("""WITH p AS (SELECT user_id AS job, event_id // 4 AS t, max(event_id) * 100 AS d FROM events GROUP BY ALL), w AS (SELECT *, t - min(t) OVER r AS dt, d - first_value(d) OVER r AS dd FROM p WINDOW r AS (PARTITION BY job ORDER BY t RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT job, t, round(CASE WHEN dt > 0 THEN dd / dt ELSE 0 END, 6)::DOUBLE AS rate, round(CASE WHEN dt > 0 AND dd > 0 THEN (2000000000 - d) / (dd / dt) ELSE -1 END, 4)::DOUBLE AS eta FROM w""")
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS job, CAST(floor(event_id / 4) AS BIGINT) AS t, max(event_id) * 100 AS bytes_done, CAST(2000000000 AS BIGINT) AS bytes_total FROM events GROUP BY user_id, CAST(floor(event_id / 4) AS BIGINT)")
    out = telemetry.rolling_rate(rows, ["job"])
    return out.select("job", "t", F.round("rate", 6).alias("rate"), F.round("eta", 4).alias("eta"))


@query("""WITH r AS (SELECT event_type AS s, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events), m AS (SELECT a.s, a.k, list_sort(list(b.value)) AS l FROM (SELECT * FROM r WHERE k % 240 = 0) a JOIN r b ON a.s = b.s AND b.k BETWEEN a.k - 511 AND a.k GROUP BY ALL)
    SELECT s AS session, k AS sample_no, CAST(len(l) AS INT) AS n, l[1 + len(l) // 2] AS median, l[1 + len(l) // 20] AS p5, l[1 + len(l) * 19 // 20] AS p95 FROM m""")
def sync_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT event_type AS session, event_id, value AS offset_ms FROM events")
    return telemetry.sync_meter(rows, ["session"], ["event_id"]).withColumn("sample_no", F.col("sample_no").cast("bigint"))


@query("SELECT o_orderkey, CASE WHEN e <= 0 OR d >= e THEN 'ok' WHEN d / e::DOUBLE < 0.90 THEN 'fail' ELSE 'warn' END AS verdict FROM (SELECT o_orderkey, o_custkey % 100 AS e, o_orderkey % 100 AS d FROM orders) x")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.completeness(run_sql(spark, sf_dir, "SELECT o_orderkey, o_custkey % 100 AS expected, o_orderkey % 100 AS done FROM orders")).select("o_orderkey", "verdict")


_MINUTES = "SELECT user_id AS session, event_id AS seq, CAST(floor(value * 100) AS DOUBLE) + event_id * 20 AS pts FROM events"


@query("""WITH f AS (SELECT user_id AS session, event_id AS seq, floor(value * 100) + event_id * 20 AS pts FROM events), s AS (SELECT *, pts - lag(pts) OVER (PARTITION BY session ORDER BY seq) AS d FROM f), e AS (SELECT *, CAST(sum(CASE WHEN d < -1 OR d > 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) AS epoch FROM s),
    n AS (SELECT *, lead(pts) OVER (PARTITION BY session, epoch ORDER BY seq) - pts AS nd FROM e) SELECT session, seq, epoch FROM n WHERE nd IS NULL OR abs(nd) > 0.05""")
def epoch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.epochs(run_sql(spark, sf_dir, _MINUTES), ["session"], ["seq"]).select("session", "seq", "epoch")


@query(fold(
    "SELECT user_id AS session, event_id AS seq, CAST(t AS DOUBLE) AS t_s FROM ticks", "session", "seq",
    {
        "fps": ("NULL::DOUBLE", "CASE WHEN r.t IS NULL OR s.t_s <= r.t THEN r.fps WHEN r.fps IS NULL THEN 1 / (s.t_s - r.t) ELSE 0.9::DOUBLE * r.fps + (1 - 0.9::DOUBLE) * (1 / (s.t_s - r.t)) END"),
        "t": ("NULL::DOUBLE", "s.t_s"),
    },
    "s.session, s.seq, s.t_s, round(r.fps, 9) AS fps",
))
def ema_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS session, event_id AS seq, CAST(t AS DOUBLE) AS t_s FROM ticks")
    return frames.ema_fps(rows, ["session"], ["seq"]).withColumn("fps", F.round("fps", 9))


@query(fold(
    "SELECT user_id AS session, event_id AS seq, value / 20 AS value FROM events", "session", "seq",
    {"held": ("NULL::DOUBLE", "CASE WHEN r.held IS NULL OR s.value >= r.held OR r.held - s.value > 1 THEN s.value ELSE r.held END")},
    "s.session, s.seq, s.value, r.held",
))
def monotone_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.monotone_clock(run_sql(spark, sf_dir, "SELECT user_id AS session, event_id AS seq, value / 20 AS value FROM events"), ["session"], ["seq"])


@query(fold(
    "SELECT user_id AS stream_id, event_id AS seq, value AS t_s FROM events", "stream_id", "seq",
    {"free": ("false", "len([x for x in r.kept if abs(x - s.t_s) < 0.5::DOUBLE]) = 0"), "kept": ("[]::DOUBLE[]", "CASE WHEN {free} THEN list_append(r.kept, s.t_s) ELSE r.kept END")},
    "s.stream_id, s.seq, s.t_s", "WHERE r.free",
))
def sync_points_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS stream_id, event_id AS seq, value AS t_s FROM events")
    return frames.thin_points(rows, ["stream_id"], ["seq"], 0.5)


@query(fold(
    "SELECT user_id AS stream_id, event_id AS seq, event_id * 41.708::DOUBLE AS t_ms FROM events", "stream_id", "seq",
    {
        "keep": ("false", "r.due IS NULL OR s.t_ms + 0.05::DOUBLE >= r.due"),
        "due": ("NULL::DOUBLE", "CASE WHEN r.due IS NULL THEN s.t_ms + 5000 WHEN {keep} THEN r.due + (greatest(0, floor((s.t_ms - r.due) / 5000)) + 1) * 5000 ELSE r.due END"),
    },
    "s.stream_id, s.seq, s.t_ms", "WHERE r.keep",
))
def cadence_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS stream_id, event_id AS seq, event_id * CAST(41.708 AS DOUBLE) AS t_ms FROM events")
    return frames.cadence(rows, ["stream_id"], ["seq"], 0.2)


_CLOCK = "SELECT user_id AS session, t, max(value) AS audio_s FROM ticks WHERE event_type = 'view' GROUP BY user_id, t"


@query(f"""WITH c AS ({_CLOCK}), m AS (SELECT f.event_id, f.value - c.audio_s AS d FROM (SELECT * FROM ticks WHERE event_type = 'click') f ASOF LEFT JOIN c ON f.user_id = c.session AND f.t >= c.t),
    x AS (SELECT *, CASE WHEN d IS NULL THEN 'free' WHEN d < -0.120 THEN 'drop' WHEN d >= 0.350 THEN 'hold' WHEN d > 0.150 THEN 'ease' WHEN abs(d) > 0.025 THEN 'nudge' ELSE 'none' END AS action FROM m)
    SELECT event_id, round(d, 6) AS diff_s, action, round(CASE action WHEN 'ease' THEN least((d - 0.150) * 0.30, 0.012) WHEN 'nudge' THEN greatest(-0.008, least(0.008, d * 0.25)) ELSE 0 END, 6)::DOUBLE AS stretch_s FROM x""")
def av_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS session, event_id, t, value AS pts_s FROM ticks WHERE event_type = 'click'")
    out = timeline.av_action(rows, run_sql(spark, sf_dir, _CLOCK), slice_s=86_400 * 7)
    return out.select("event_id", F.round("diff_s", 6).alias("diff_s"), "action", F.round("stretch_s", 6).alias("stretch_s"))


_MASTER = "SELECT user_id AS session, t, max(value) * 10 AS audio_ms FROM ticks WHERE event_type = 'view' GROUP BY user_id, t"


@query(f"""WITH c AS ({_MASTER}), m AS (SELECT f.user_id, f.event_id, f.t, f.value * 10 AS pts, f.value * 10 - c.audio_ms AS err FROM (SELECT * FROM ticks WHERE event_type = 'click') f ASOF LEFT JOIN c ON f.user_id = c.session AND f.t >= c.t),
    b AS (SELECT *, greatest(45, least(100, 1.25 * coalesce(greatest(1, pts - lag(pts) OVER (PARTITION BY user_id ORDER BY t, pts, event_id)), 1))) AS b FROM m)
    SELECT event_id, coalesce(err < -b, false) AS late, round(CASE WHEN NOT coalesce(err < -b, false) THEN least(greatest(err, 0), 500) END::DOUBLE, 6) AS wait_ms FROM b""")
def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS session, event_id, t, value * 10 AS pts_ms FROM ticks WHERE event_type = 'click'")
    out = timeline.late_drop(rows, run_sql(spark, sf_dir, _MASTER), slice_s=86_400 * 7, tie=["event_id"])
    return out.select("event_id", "late", F.round("wait_ms", 6).alias("wait_ms"))


# --- live sessions ----------------------------------------------------------------------------------------------------


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "SELECT user_id, event_id, event_type, value, t FROM ticks").withColumn("ts", F.timestamp_seconds("t"))


_SESSIONS = """g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) < {gap} THEN 0 ELSE 1 END AS b FROM ticks), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM g)"""


@query("""WITH h AS (SELECT r.*, (SELECT arg_max(p.peer, (p.t, p.event_id)) FROM received p WHERE p.hello AND p.session = r.session AND (p.t, p.event_id) < (r.t, r.event_id)) AS known FROM received r),
    a AS (SELECT *, coalesce(lead(t) OVER w, (SELECT max(t) FROM received e WHERE e.session = h.session)) - t > 43200 AS lost FROM h WHERE hello OR peer = known WINDOW w AS (PARTITION BY session ORDER BY t, event_id)),
    s AS (SELECT *, coalesce(sum(lost::INT) OVER (PARTITION BY session ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM a)
    SELECT session, arg_max(peer, (t, event_id)) AS peer, count(*) AS packets, max(t) AS last_rx, max(t) + 43200 AS lost_at FROM s GROUP BY session, g HAVING bool_or(lost)""")
def st_client_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.client_lost(view(spark, sf_dir, "received"), 43_200, ["event_id"])


@query("WITH " + _SESSIONS.format(gap=3600) + " SELECT user_id AS session, event_type AS session_id, arg_max(value, (t, event_id)) AS target_s, max(t) AS last_t, count(*) - 1 AS coalesced FROM s GROUP BY user_id, event_type, g")
def st_coalesce_seeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).select(F.col("user_id").alias("session"), F.col("event_type").alias("session_id"), "ts", F.col("value").alias("target_s"), "event_id")
    return sessions.coalesce_seeks(rows, "3600 seconds", tie=["event_id"]).withColumn("last_t", F.unix_seconds("last_ts")).drop("last_ts")


@query("""SELECT user_id AS session, t - t % 86400 AS day_s, CAST(sum(event_id) AS BIGINT) AS frames, CAST(sum(event_id % 3) AS BIGINT) AS drops, arg_max(event_type, (t, event_id)) AS mode FROM ticks GROUP BY ALL""")
def tumbling_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("frames"), (F.col("event_id") % 3).alias("drops"), F.col("event_type").alias("mode"), "event_id")
    return telemetry.status_per_second(rows, width="1 day", tie=["event_id"]).withColumn("day_s", F.unix_seconds("window.start")).drop("window")


@query("""WITH s AS (SELECT user_id AS session, event_id, value >= 30 AS st FROM events), g AS (SELECT *, sum(st::INT) OVER (PARTITION BY session ORDER BY event_id) AS g FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY session, g ORDER BY event_id) - 1 - CASE WHEN g > 0 THEN 1 ELSE 0 END AS k FROM g)
    SELECT session, event_id, CAST(CASE WHEN st THEN 250 ELSE least(3000, 250 * pow(2, least(k, 20))) END AS BIGINT) AS wait_ms FROM k""")
def st_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS session, event_id, value / 6 AS lived_s FROM events")
    return islands.backoff(rows, ["session"], ["event_id"]).select("session", "event_id", F.col("wait_ms").cast("bigint").alias("wait_ms"))


_UNITS = fold(
    "SELECT * FROM live_datagrams WHERE frag_cnt BETWEEN 1 AND 4096 AND frag_idx >= 0 AND frag_idx < frag_cnt", "session", "arrival, seq, frag_idx",
    {
        "_new": ("", "r.seq IS DISTINCT FROM s.seq"),
        "cnt": ("0", "CASE WHEN {_new} THEN s.frag_cnt ELSE r.cnt END"),
        "_parts": ("", "list_append(CASE WHEN {_new} THEN [] ELSE [x for x in r.parts if x.i <> s.frag_idx] END, {'i': s.frag_idx, 'p': s.payload})"),
        "_done": ("", "len({_parts}) >= {cnt}"),
        "unit": ("NULL::STRUCT(i INT, p VARCHAR)[]", "CASE WHEN {_done} THEN list_sort({_parts}) END"),
        "parts": ("[]::STRUCT(i INT, p VARCHAR)[]", "CASE WHEN {_done} THEN [] ELSE {_parts} END"),
        "seq": ("NULL::BIGINT", "CASE WHEN {_done} THEN NULL ELSE s.seq END"),
    },
    "s.session, s.seq, len(r.unit) AS fragments, list_aggregate([x.p for x in r.unit], 'string_agg', '') AS payload", "WHERE r.unit IS NOT NULL",
)


@query(_UNITS)
def st_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.reassemble(view(spark, sf_dir, "live_datagrams", {"lineitem": "l_orderkey"}), "arrival")


@query("""WITH r AS (SELECT media_key, field, arg_max(coalesce(value, '~'), updated) AS value, max(updated) AS updated FROM memory GROUP BY ALL), k AS (SELECT media_key, max(updated) AS updated, string_agg(field || '=' || value, ';' ORDER BY field) FILTER (WHERE value <> '~') AS fields FROM r GROUP BY media_key)
    SELECT media_key, updated, fields FROM k WHERE fields IS NOT NULL ORDER BY updated DESC, media_key LIMIT 400""")
def st_remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.upsert_memory(view(spark, sf_dir, "memory"))
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select("media_key", "updated", fields.alias("fields"))


@query(fold(
    "SELECT user_id AS session, event_id AS seq, CAST(floor(value / 12) AS INT) AS queue_depth, event_type = 'error' AS underrun FROM events", "session", "seq",
    {
        "_press": ("", "s.underrun OR s.queue_depth > 3"),
        "_down": ("", "{_press} AND r.pressed + 1 >= 3"),
        "_calm": ("", "CASE WHEN NOT {_press} AND s.queue_depth <= 1 AND r.rung > 0 THEN r.stable + 1 ELSE 0 END"),
        "pressed": ("0", "CASE WHEN {_press} AND NOT {_down} THEN r.pressed + 1 ELSE 0 END"),
        "stable": ("0", "CASE WHEN {_calm} >= 12 THEN 0 ELSE {_calm} END"),
        "rung": ("0", "CASE WHEN {_down} THEN least(r.rung + 1, 4) WHEN {_calm} >= 12 THEN r.rung - 1 ELSE r.rung END"),
    },
    "s.session, s.seq, s.queue_depth, s.underrun, CAST(r.rung AS INT) AS rung",
))
def st_quality_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS session, event_id AS seq, CAST(floor(value / 12) AS INT) AS queue_depth, event_type = 'error' AS underrun FROM events")
    return sessions.ladder(rows, ["seq"])


@query(fold(
    "SELECT user_id AS session, event_id AS seq, CAST(t AS DOUBLE) AS t_s FROM ticks WHERE event_type = 'error'", "session", "seq",
    {"keep": ("false", "r.last IS NULL OR s.t_s - r.last >= 86400"), "last": ("NULL::DOUBLE", "CASE WHEN {keep} THEN s.t_s ELSE r.last END")},
    "s.session, s.seq, s.t_s", "WHERE r.keep",
))
def st_idr_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS session, event_id AS seq, CAST(t AS DOUBLE) AS t_s FROM ticks WHERE event_type = 'error'")
    return frames.throttle(rows, ["session"], ["seq"], 86_400.0)


_FATES = fold(
    "SELECT user_id AS session, event_id AS seq, CASE WHEN event_type = 'view' THEN 'audio' ELSE 'video' END AS kind, event_id + CAST(floor(value * 10) AS BIGINT) AS pts_ms FROM events", "session", "seq",
    {
        "clock": ("NULL::BIGINT", "CASE WHEN s.kind = 'audio' THEN greatest(s.pts_ms, coalesce(r.clock, s.pts_ms)) ELSE r.clock END"),
        "_all": ("", "CASE WHEN s.kind = 'video' THEN list_sort(list_append(r.held, {'p': s.pts_ms, 'q': s.seq})) ELSE r.held END"),
        "_over": ("", "len({_all}) > 8"),
        "_left": ("", "CASE WHEN {_over} THEN {_all}[2:] ELSE {_all} END"),
        "dropped": ("NULL::BIGINT", "CASE WHEN {_over} THEN {_all}[1].q END"),
        "freed": ("[]::BIGINT[]", "[x.q for x in {_left} if x.p <= {clock}]"),
        "held": ("[]::STRUCT(p BIGINT, q BIGINT)[]", "[x for x in {_left} if {clock} IS NULL OR x.p > {clock}]"),
    },
    "s.session, s.seq, s.kind, s.pts_ms, r.clock, r.dropped, r.freed",
)


@query(f"""WITH w AS ({_FATES}), f AS (SELECT session, unnest(freed) AS seq, clock FROM w), d AS (SELECT session, dropped AS seq FROM w WHERE dropped IS NOT NULL)
    SELECT w.session, w.seq, w.kind, w.pts_ms, CASE WHEN f.seq IS NOT NULL THEN 'released' WHEN d.seq IS NOT NULL THEN 'dropped' ELSE 'flushed' END AS fate, f.clock AS clock_ms
    FROM w LEFT JOIN f ON w.session = f.session AND w.seq = f.seq LEFT JOIN d ON w.session = d.session AND w.seq = d.seq WHERE w.kind = 'video'""")
def st_audio_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS session, event_id AS seq, CASE WHEN event_type = 'view' THEN 'audio' ELSE 'video' END AS kind, event_id + CAST(floor(value * 10) AS BIGINT) AS pts_ms FROM events")
    return sessions.jitter_buffer(rows, ["seq"])


@query(fold(
    "SELECT user_id AS session, event_id AS seq, event_id / 24.0::DOUBLE + CAST(event_id % 3 AS DOUBLE) / 24 AS pts_s FROM events", "session", "seq",
    {
        "_due": ("", "CASE WHEN r.last IS NULL THEN 0 ELSE r.last + 1 / 24.0::DOUBLE END"),
        "_slack": ("", "CASE WHEN r.last IS NULL THEN 3 ELSE 0.5 END"),
        "_fresh": ("", "list_sort([x for x in list_append(r.held, s.pts_s) if x >= {_due} - {_slack}])"),
        "_hit": ("", "len({_fresh}) > 0 AND {_fresh}[1] <= {_due} + {_slack}"),
        "last": ("NULL::DOUBLE", "CASE WHEN {_hit} THEN {_fresh}[1] ELSE {_due} END"),
        "held": ("[]::DOUBLE[]", "CASE WHEN {_hit} THEN {_fresh}[2:] ELSE {_fresh} END"),
    },
    "s.session, s.seq, s.pts_s, round(r.last, 6) AS emit_pts",
))
def st_assign_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS session, event_id AS seq, event_id / CAST(24.0 AS DOUBLE) + CAST(event_id % 3 AS DOUBLE) / 24 AS pts_s FROM events")
    return sessions.assign_pts_live(rows, ["seq"], 1 / 24.0).withColumn("emit_pts", F.round("emit_pts", 6))


@query(fold(
    "SELECT user_id AS session, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 41.7::DOUBLE + value END AS clock_ms FROM events", "session", "seq",
    {
        "_moved": ("", "s.clock_ms IS NOT NULL AND (r.seen IS NULL OR abs(s.clock_ms - r.seen) > 0.001::DOUBLE)"),
        "_next": ("", "r.at + 1000.0::DOUBLE / 24"),
        "at": ("NULL::DOUBLE", "CASE WHEN r.at IS NULL THEN coalesce(s.clock_ms, 0) WHEN NOT {_moved} THEN {_next} WHEN abs(s.clock_ms - {_next}) > 250 THEN s.clock_ms ELSE {_next} + greatest(-1, least(1, (s.clock_ms - {_next}) * 0.25::DOUBLE)) END"),
        "seen": ("NULL::DOUBLE", "CASE WHEN {_moved} THEN s.clock_ms ELSE r.seen END"),
    },
    "s.session, s.seq, s.clock_ms, CAST(round_even(r.at, 0) AS BIGINT) AS pts_ms",
))
def st_pts_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id AS session, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * CAST(41.7 AS DOUBLE) + value END AS clock_ms FROM events")
    return sessions.pts_cursor(rows, ["seq"], 24.0)


_ANALYSED = fold(
    "SELECT stream_id, seq, pts FROM arrivals", "stream_id", "seq",
    {
        "_all": ("", "list_sort(list_append(r.held, {'p': s.pts, 'q': s.seq}))"),
        "out": ("NULL::STRUCT(p BIGINT, q BIGINT)", "CASE WHEN len({_all}) > 5 THEN {_all}[1] END"),
        "held": ("[]::STRUCT(p BIGINT, q BIGINT)[]", "CASE WHEN len({_all}) > 5 THEN {_all}[2:] ELSE {_all} END"),
    },
    "s.stream_id, s.seq, r.out, r.held",
)


@query(f"""WITH w AS ({_ANALYSED}), l AS (SELECT stream_id, max(seq) AS seq, arg_max(held, seq) AS held FROM w GROUP BY stream_id),
    g AS (SELECT stream_id, seq AS turn, out.q AS seq, out.p AS pts FROM w WHERE out IS NOT NULL UNION ALL SELECT stream_id, seq + i, held[i].q, held[i].p FROM l, (SELECT unnest(range(1, 6)) AS i) n WHERE i <= len(held)),
    h AS (SELECT vec_id, {_HIST} AS hist FROM embeddings), o AS (SELECT g.stream_id, g.pts, h.hist, lag(g.pts) OVER t AS before, lag(h.hist) OVER t AS b FROM g JOIN h ON g.seq = h.vec_id WINDOW t AS (PARTITION BY g.stream_id ORDER BY g.turn))
    SELECT stream_id, pts::DOUBLE AS pts_ms FROM o WHERE pts > before AND 0.5 * list_sum([abs(hist[i] - b[i]) for i in range(1, 65)]) >= 0.42""")
def st_reorder_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming form: frames leave a buffer of five, earliest first, and late ones give no cut."""
    rows = view(spark, sf_dir, "arrivals")
    turns = frames.analysed(rows.select("stream_id", "seq", "pts"), ["stream_id"], ["seq"]).select("stream_id", "seq", "turn")
    total = F.aggregate("embedding", F.lit(0.0), lambda t, v: t + F.abs(v.cast("double")))
    hist = F.transform("embedding", lambda v: F.abs(v.cast("double")) / F.col("total"))
    met = rows.withColumn("total", total).select("stream_id", "seq", "pts", hist.alias("hist")).join(turns, ["stream_id", "seq"])
    return islands.hard_cuts(frames.tv(met, ["stream_id"], ["turn"]), ["stream_id"], ["turn"]).select("stream_id", F.col("pts").cast("double").alias("pts_ms"))


# --- sources ----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS file, coalesce(p_size % 7 = 0, false) AS error, CASE WHEN p_size % 7 = 0 THEN NULL ELSE s END AS stream_index, CASE WHEN p_size % 7 = 0 THEN NULL WHEN s = 0 THEN 'video' ELSE 'audio' END AS codec_type, CASE WHEN p_size % 7 <> 0 AND s = 0 THEN 1000 + p_size END AS width, CASE WHEN p_size % 7 <> 0 THEN p_name END AS title FROM part, (SELECT unnest([0, 1])::INT AS s) x WHERE p_size % 7 <> 0 OR s = 0")
def src_probe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = run_sql(spark, sf_dir, "SELECT p_partkey, p_size, p_name FROM part")
    json = F.format_string('{"streams": [{"codec_type": "video", "width": %d, "tags": {"title": "%s"}}, {"codec_type": "audio", "tags": {"title": "%s"}}], "format": {"duration": "1.5"}}', 1000 + F.col("p_size"), "p_name", "p_name")
    docs = parts.select(F.col("p_partkey").alias("file"), F.when(F.col("p_size") % 7 == 0, "{broken").otherwise(json).alias("json"))
    return readers.probe_rows(docs).select("file", "error", "stream_index", "codec_type", "width", F.col("tags")["title"].alias("title"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'bad magic' WHEN o_orderkey % 17 = 0 THEN 'truncated payload' END AS reject, CASE WHEN NOT (o_orderkey % 13 = 0 OR o_orderkey % 17 = 0) THEN o_orderkey END AS seq, CASE WHEN NOT (o_orderkey % 13 = 0 OR o_orderkey % 17 = 0) THEN 5 - o_orderkey END AS pts_ms,
    CASE WHEN NOT (o_orderkey % 13 = 0 OR o_orderkey % 17 = 0) THEN CAST(o_custkey % 9 AS INT) END AS frag_idx, CASE WHEN NOT (o_orderkey % 13 = 0 OR o_orderkey % 17 = 0) THEN o_orderpriority END AS payload FROM orders""")
def src_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = run_sql(spark, sf_dir, "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
    n = lambda c, digits: F.lpad(F.hex(c), digits, "0")
    signed = F.substring(F.concat(F.when(5 - F.col("o_orderkey") < 0, "FFFFFFFFFFFFFFFF").otherwise("0000000000000000"), F.hex(5 - F.col("o_orderkey"))), -16, 16)
    magic = F.when(F.col("o_orderkey") % 13 == 0, F.hex(F.lit("XXXX"))).otherwise(F.hex(F.lit("CAST")))
    length = F.length("o_orderpriority") + F.when(F.col("o_orderkey") % 17 == 0, 1).otherwise(0)
    head = F.concat(magic, F.lit("010301"), n(F.col("o_orderkey"), 8), signed, n(F.col("o_custkey") % 9, 4), n(F.lit(9), 4), n(length, 8))
    datagram = F.concat(F.unhex(head), F.encode("o_orderpriority", "UTF-8"))
    out = readers.read_datagrams(orders.select(F.col("o_orderkey").alias("id"), datagram.alias("datagram")), "CAST")
    return out.select("id", "reject", "seq", "pts_ms", "frag_idx", F.decode("payload", "UTF-8").alias("payload"))


@query("SELECT 'pack' || r_regionkey AS pack, r_name AS label, n_name || '.bin' AS name, CAST(n_nationkey AS BIGINT) AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT r_regionkey, r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
    file = F.struct(F.lit("models").alias("path"), F.concat("n_name", F.lit(".bin")).alias("name"), F.col("n_nationkey").cast("bigint").alias("bytes"))
    packs = rows.groupBy("r_regionkey", "r_name").agg(F.collect_list(file).alias("files"))
    json = F.to_json(F.struct(F.create_map(F.concat(F.lit("pack"), F.col("r_regionkey").cast("string")), F.struct(F.col("r_name").alias("label"), "files")).alias("packs")))
    return readers.manifest_rows(packs.select(json.alias("json"))).select("pack", "label", "name", "bytes")


@query("""SELECT concat('{"user_id":', user_id, ',"n":', count(*), '}') AS line FROM events GROUP BY user_id""")
def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.report_lines(run_sql(spark, sf_dir, "SELECT user_id, count(*) AS n FROM events GROUP BY user_id"))


@query("SELECT CAST(playlist AS STRING) AS path, CAST(item_no - 1 AS INT) AS item_no, clip, in_45k, out_45k FROM segments WHERE item_no % 5 <> 0")
def src_disc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlists are built from line items and read back through the parser of playlist files."""
    items = view(spark, sf_dir, "segments").withColumn("end", F.when(F.col("item_no") % 5 == 0, F.col("in_45k")).otherwise(F.col("out_45k")))
    h = lambda c, d: F.lpad(F.hex(c), d, "0")
    item = F.concat(F.lit("0014"), F.hex("clip"), F.lit("4D32545300000001"[:14]), h(F.col("in_45k"), 8), h(F.col("end"), 8))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", item.alias("i")))), lambda s: s["i"]), "")
    files = items.groupBy("playlist").agg(F.concat(F.hex(F.lit("MPLS0200")), F.lit("0000000C"), F.lit("000000000000"), h(F.count(F.lit(1)), 4), F.lit("0000"), body).alias("x"))
    return readers.playlist_items(files.select(F.col("playlist").cast("string").alias("path"), F.unhex("x").alias("content")))


@query("""SELECT o_orderkey AS playlist, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_custkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 256 // 16 % 2 = 1 THEN 'right_first' ELSE 'left_first' END AS eye_order FROM orders""")
def src_disc_eyes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of playlist files: cut off, with play items before the flags, with a short application block, and sound ones."""
    orders = run_sql(spark, sf_dir, "SELECT o_orderkey AS playlist, CASE WHEN o_orderkey % 5 = 0 THEN 50 ELSE 80 END AS items_at, CASE WHEN o_custkey % 4 = 0 THEN 12 ELSE 14 END AS app, o_orderkey % 256 AS flags FROM orders")
    h = lambda c, d: F.lpad(F.hex(c), d, "0")
    whole = F.concat(F.hex(F.lit("MPLS0200")), h(F.col("items_at"), 8), F.repeat(F.lit("00"), F.lit(28)), h(F.col("app"), 8), F.repeat(F.lit("FF"), F.lit(12)), h(F.col("flags"), 2), F.lit("00000000"))
    cut = F.when(F.col("playlist") % 7 == 0, F.substring(whole, 1, 2 * 56)).otherwise(whole)
    return orders.select("playlist", readers.playlist_eye(F.unhex(cut)).alias("eye_order"))

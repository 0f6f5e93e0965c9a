"""Queries of title classification and of the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, media, stereo
from ..views import run_sql, view
from .registry import query

_CODE = "TRY_CAST(trim(stereo_tag) AS INT)"
_MODE = "replace(replace(lower(trim(stereo_tag)), '-', '_'), ' ', '_')"
_RE = {k: "|".join(v) for k, v in stereo.KEYWORDS.items()}
LAYOUT = f"""CASE WHEN {_CODE} BETWEEN 0 AND 14 THEN CASE WHEN {_CODE} IN (1, 11) THEN 'sbs' WHEN {_CODE} IN (2, 3) THEN 'tab' WHEN {_CODE} IN (10, 12) THEN 'anaglyph' WHEN {_CODE} IN (13, 14) THEN 'mvc' END
    WHEN regexp_matches({_MODE}, '{_RE["anaglyph"]}') THEN 'anaglyph' WHEN regexp_matches({_MODE}, '{_RE["mvc"]}') THEN 'mvc'
    WHEN regexp_matches({_MODE}, '{_RE["tab"]}') THEN 'tab' WHEN regexp_matches({_MODE}, '{_RE["sbs"]}') THEN 'sbs' END"""
ORDER = f"""CASE WHEN stereo_tag IS NULL THEN 'unknown' WHEN {_CODE} BETWEEN 0 AND 14 THEN CASE WHEN {_CODE} IN (1, 3, 5, 7, 9, 13) THEN 'left_first' WHEN {_CODE} IN (0, 10, 12) THEN 'unknown' ELSE 'right_first' END
    WHEN ({LAYOUT}) IS NULL OR regexp_matches({_MODE}, '{_RE["anaglyph"]}') THEN 'unknown'
    WHEN regexp_matches({_MODE}, '{"|".join(stereo.RIGHT_MARKS)}') THEN 'right_first' WHEN regexp_matches({_MODE}, '{"|".join(stereo.LEFT_MARKS)}') THEN 'left_first' ELSE 'unknown' END"""


def _norm(c: str) -> str:
    plain = f"replace(replace(lower(trim(coalesce({c}, ''))), '-', '_'), ' ', '_')"
    return f"CASE WHEN {plain} IN ('left_first', 'left', 'left_eye_first', 'lr', 'l_r') THEN 'left_first' WHEN {plain} IN ('right_first', 'right', 'right_eye_first', 'rl', 'r_l') THEN 'right_first' ELSE 'unknown' END"


@query(f"SELECT title, {LAYOUT} AS layout, {ORDER} AS eye_order FROM titles")
def stereo_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "titles").select("title", stereo.stereo_layout(F.col("stereo_tag")).alias("s")).select("title", "s.*")


@query(f"""SELECT title, coalesce({LAYOUT}, CASE WHEN {_MODE} IN ('mono', 'left', 'right', 'both', '2d') THEN NULL WHEN regexp_matches({_MODE}, 'bt|tb') THEN 'tab'
    WHEN regexp_matches({_MODE}, 'row_interleaved|column_interleaved') THEN 'sbs' END) AS layout FROM titles""")
def stereo_layout_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "titles").select("title", stereo.stereo_layout_wide(F.col("stereo_tag")).alias("layout"))


@query(f"SELECT title, {_norm('override')} AS eye_order FROM titles")
def eye_order_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "titles").select("title", stereo.eye_order_norm(F.col("override")).alias("eye_order"))


_FLAG = "CASE WHEN lower(trim(inverted)) IN ('1', 'true', 'yes', 'on') THEN true WHEN lower(trim(inverted)) IN ('0', 'false', 'no', 'off') THEN false END"
_DETECTED = f"CASE WHEN ({_FLAG}) IS NOT NULL AND ({LAYOUT}) IN ('sbs', 'tab') THEN CASE WHEN {_FLAG} THEN 'right_first' ELSE 'left_first' END ELSE {ORDER} END"


@query(f"""SELECT title, CASE WHEN o <> 'unknown' THEN o ELSE d END AS eye_order, CASE WHEN o <> 'unknown' THEN 'user override' WHEN d <> 'unknown' THEN source ELSE 'not signalled' END AS eye_order_source
    FROM (SELECT title, source, {_norm('override')} AS o, {_DETECTED} AS d FROM titles) x""")
def eye_order_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stereo.resolve_eye_order(view(spark, sf_dir, "titles")).select("title", "eye_order", "eye_order_source")


@query(f"SELECT title, ((({_norm('override')}) = 'right_first') <> (size % 2 = 0)) <> coalesce({_FLAG}, false) AS swap FROM titles")
def view_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "titles").select("title", stereo.view_swap(F.col("override"), F.col("size") % 2 == 0, stereo.tri_state(F.col("inverted"))).alias("swap"))


@query("SELECT title, ((width = 1920 AND height IN (2205, 2160)) OR (width = 3840 AND height = 4320)) AND lower(coalesce(codec, '')) IN ('h264', 'mvc', '') AS framepacked FROM titles")
def framepack_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "titles").select("title", stereo.is_framepacked(F.col("width"), F.col("height"), F.col("codec")).alias("framepacked"))


@query("""SELECT key, CASE WHEN n LIKE '%tab%' THEN 'tab' WHEN n LIKE '%sbs%' OR n LIKE '%3d%' THEN 'sbs' END AS hint FROM (SELECT title AS key, lower(regexp_extract(path, '([^/]*)$', 1)) AS n FROM titles
    UNION ALL SELECT page_id + 1000000000 AS key, lower(regexp_extract(url, '([^/]*)$', 1)) AS n FROM pages) x""")
def filename_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = run_sql(spark, sf_dir, "SELECT title AS key, path FROM titles UNION ALL SELECT page_id + 1000000000 AS key, url AS path FROM pages")
    return names.select("key", stereo.filename_hint(F.col("path")).alias("hint"))


def _word(*words: str) -> str:
    return "|".join(f"(^|[^a-z0-9]){w}($|[^a-z0-9])" for w in words)


_MODES = [
    (_word("fsbs") + "|full[ ._-]?sbs", "sbs", "false"), (_word("ftab", "fou") + "|full[ ._-]?(tab|ou)", "tab", "false"), (_word("hsbs") + "|half[ ._-]?sbs", "sbs", "true"),
    (_word("htab", "hou") + "|half[ ._-]?(tab|ou)", "tab", "true"), (_word("sbs"), "sbs", "false"), (_word("tab", "ou"), "tab", "false"),
]


@query(f"""SELECT title, CASE {" ".join(f"WHEN regexp_matches(n, '{r}') THEN '{m}'" for r, m, _ in _MODES)} END AS mode, CASE {" ".join(f"WHEN regexp_matches(n, '{r}') THEN {h}" for r, _, h in _MODES)} ELSE false END AS half
    FROM (SELECT title, lower(regexp_extract(path, '([^/]*)$', 1)) AS n FROM titles) x""")
def filename_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "titles").select("title", stereo.filename_tokens(F.col("path")).alias("t")).select("title", "t.*")


@query(f"""SELECT title, CASE m WHEN 'sbs' THEN width / CAST(greatest(1, height) AS DOUBLE) < 2.5 WHEN 'tab' THEN width / CAST(greatest(1, height) AS DOUBLE) > 1.2 END AS half_by_ratio,
    coalesce((m = 'sbs' AND width > 0 AND width < 2560) OR (m = 'tab' AND height > 0 AND height < 1600), false) AS half_by_size FROM (SELECT title, width, height, {LAYOUT} AS m FROM titles) x""")
def half_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode, w, h = stereo.stereo_layout(F.col("stereo_tag"))["layout"], F.col("width"), F.col("height")
    return view(spark, sf_dir, "titles").select("title", stereo.half_packed(mode, w, h).alias("half_by_ratio"), stereo.half_packed(mode, w, h, "size").alias("half_by_size"))


def _colour(c: str, allowed: list[str]) -> str:
    mapped = f"CASE {c} WHEN '709' THEN 'bt709' WHEN '601' THEN 'smpte170m' WHEN 'bt601' THEN 'smpte170m' ELSE {c} END"
    return f"CASE WHEN {mapped} IN ({', '.join(repr(x) for x in allowed)}) THEN {mapped} ELSE 'bt709' END"


@query(f"""SELECT title, {_colour('primaries', media.PRIMARIES)} AS out_primaries, {_colour('transfer', media.TRANSFERS)} AS out_transfer, {_colour('matrix', media.MATRICES)} AS out_matrix,
    coalesce(lower(trim(transfer)) IN ('smpte2084', 'arib-std-b67'), false) AS hdr FROM titles""")
def colour_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.colour_policy(view(spark, sf_dir, "titles")).select("title", "out_primaries", "out_transfer", "out_matrix", "hdr")


_RATE = """CASE WHEN rate NOT LIKE '%/%' THEN TRY_CAST(rate AS DOUBLE) WHEN TRY_CAST(split_part(rate, '/', 2) AS DOUBLE) > 0 THEN TRY_CAST(split_part(rate, '/', 1) AS DOUBLE) / TRY_CAST(split_part(rate, '/', 2) AS DOUBLE) END"""


@query(f"SELECT title, round({_RATE}, 6) AS fps FROM titles")
def fps_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "titles").select("title", F.round(media.fps_ratio(F.col("rate")), 6).alias("fps"))


@query(f"""SELECT title, greatest(12.0, least(120.0, CASE WHEN f < 20.0 THEN 23.976 ELSE f END))::DOUBLE AS fps FROM
    (SELECT title, round(coalesce(CASE WHEN {_RATE} > 0.001 THEN {_RATE} END, CASE WHEN price / 8 > 0.001 THEN price / 8 END, 24.0), 6) AS f FROM titles) x""")
def fps_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "titles").select("title", F.round(media.effective_fps(media.fps_ratio(F.col("rate")), F.col("price") / 8), 6).alias("fps"))


@query(f"""SELECT event_id, CASE WHEN value > 0 THEN CASE {" ".join(f"WHEN abs(value - {s}) <= 0.02 * {s} THEN {s}" for s in media.STANDARD_FPS)} ELSE value END END::DOUBLE AS fps FROM events""")
def fps_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "SELECT event_id, value FROM events").select("event_id", media.fps_snap(F.col("value")).alias("fps"))


_H264 = "CASE lower(coalesce(codec, '')) WHEN 'hevc' THEN false WHEN 'h264' THEN true ELSE lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ('ssif', 'm2ts', 'ts', 'mkv', 'mk3d') END"


@query(f"SELECT title, CASE WHEN drive_class = 'optical' THEN 'off' WHEN {_H264} THEN 'h264' ELSE 'avcodec' END AS preview, drive_class IN ('optical', 'mounted') AS paced FROM titles")
def preview_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.preview_route(view(spark, sf_dir, "titles")).select("title", "preview", "paced")


@query("""SELECT event_id, pos >= 30 AND (duration <= 0 OR pos <= 0.93 * duration) AS saves, pos > 30 AND (duration <= 0 OR pos < 0.93 * duration) AS restores
    FROM (SELECT event_id, value AS pos, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE CAST(event_id % 100 AS DOUBLE) END AS duration FROM events) x WHERE pos >= 30 AND (duration <= 0 OR pos <= 0.93 * duration)""")
def resume_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT event_id, value AS pos, CASE WHEN event_id % 3 = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(event_id % 100 AS DOUBLE) END AS duration FROM events")
    restores = media.resume_filter(rows, "restore").select("event_id", F.lit(True).alias("restores"))
    return media.resume_filter(rows).join(restores, "event_id", "left").select("event_id", F.lit(True).alias("saves"), F.coalesce("restores", F.lit(False)).alias("restores"))


_LANG = "trim(coalesce(lang, ''))"
_BASE = f"""CASE WHEN codec IS NULL THEN '' ELSE CASE codec {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in media.CODECS.items())} ELSE upper(codec) END END"""
_PROFILE = "trim(coalesce(codec_profile, ''))"
_NAMED = f"CASE WHEN lower({_PROFILE}) LIKE 'dts%' THEN {_PROFILE} ELSE {_BASE} END"
_CODED = f"CASE WHEN lower({_PROFILE}) IN ('', 'unknown', 'none') THEN {_BASE} WHEN lower({_PROFILE}) LIKE '%atmos%' AND lower({_NAMED}) NOT LIKE '%atmos%' THEN {_NAMED} || ' Atmos' ELSE {_NAMED} END"


@query(f"""SELECT track_id, concat_ws(' · ', CASE WHEN p = '' THEN 'Audio ' || track_id ELSE p END, CASE WHEN forced THEN '(forced)' WHEN is_default THEN '(default)' END) AS label FROM (SELECT track_id, forced, is_default, concat_ws(' · ',
    CASE WHEN {_LANG} = '' THEN NULL ELSE CASE lower({_LANG}) WHEN 'eng' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'jpn' THEN 'Japanese' ELSE upper({_LANG}) END END, nullif({_CODED}, ''),
    CASE WHEN channels > 0 THEN CASE channels WHEN 1 THEN 'Mono' WHEN 2 THEN 'Stereo' WHEN 3 THEN '2.1' WHEN 6 THEN '5.1' WHEN 7 THEN '6.1' WHEN 8 THEN '7.1' ELSE channels || '.0' END END,
    CASE WHEN trim(coalesce(title, '')) <> '' AND NOT regexp_matches(lower(trim(title)), '^track[\\s_]*[0-9]+$') THEN '“' || trim(title) || '”' END) AS p FROM tracks) x""")
def track_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = view(spark, sf_dir, "tracks")
    return tracks.select("track_id", media.track_label(tracks).alias("label"))


@query(f"SELECT title, CAST(round(CASE WHEN TRY_CAST(d AS DOUBLE) > 0 THEN TRY_CAST(d AS DOUBLE) WHEN d LIKE '%:%' THEN size * 3600 + 5 * 60 + 1.5 ELSE price END, 6) AS DOUBLE) AS seconds FROM (SELECT title, price, size, CASE title % 3 WHEN 0 THEN CAST(price AS STRING) WHEN 1 THEN concat(CAST(size AS STRING), ':05:01.5') ELSE 'N/A' END AS d FROM titles) x")
def duration_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT title, price, CASE title % 3 WHEN 0 THEN CAST(price AS STRING) WHEN 1 THEN concat(CAST(size AS STRING), ':05:01.5') ELSE 'N/A' END AS d FROM titles")
    return rows.select("title", F.round(media.duration_any(F.col("d"), F.col("price").cast("string")), 6).alias("seconds"))


@query("SELECT title, CAST(CASE WHEN size % 3 = 0 AND title > 0 THEN title ELSE size END AS BIGINT) AS n FROM titles")
def positive_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT title, CASE WHEN size % 3 = 0 THEN CAST(title AS STRING) WHEN size % 3 = 1 THEN 'N/A' ELSE '-4' END AS a, CAST(size AS STRING) AS b FROM titles")
    return rows.select("title", media.positive_int(F.col("a"), F.col("b")).cast("bigint").alias("n"))


_SIZE = "CASE WHEN n < 1024 THEN printf('%.0f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.2f KiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.2f MiB', n / 1048576.0::DOUBLE) ELSE printf('%.2f GiB', n / 1073741824.0::DOUBLE) END"


@query(f"SELECT o_orderkey, {_SIZE} AS size, {_SIZE} || '/s' AS rate FROM (SELECT o_orderkey, 1 + CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 90) * (o_orderkey % 70) AS n FROM orders) x")
def human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT o_orderkey, 1 + CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 90) * (o_orderkey % 70) AS n FROM orders")
    return rows.select("o_orderkey", media.human_size(F.col("n")).alias("size"), media.human_rate(F.col("n")).alias("rate"))


@query("""SELECT o_orderkey, CASE WHEN s IS NULL OR s < 0 THEN '—' WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS text
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE CAST(floor(o_totalprice / 10) AS BIGINT) END AS s FROM orders) x""")
def human_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN CAST(-1 AS DOUBLE) ELSE o_totalprice / 10 END AS s FROM orders")
    return rows.select("o_orderkey", media.human_time(F.col("s")).alias("text"))


@query(r"SELECT page_id, md5(regexp_replace(html, '</?[a-zA-Z][^>{}]*>|\{\\[^}]*\}', '', 'g')) AS text_md5 FROM pages")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "SELECT page_id, html FROM pages").select("page_id", F.md5(media.strip_markup(F.col("html"))).alias("text_md5"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE role || '|' || turn END AS lines FROM conversations")
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT conv_id, turn, role FROM conversations")
    lines = F.when(F.col("turn") % 2 == 0, F.array("role", "role")).otherwise(F.array("role", F.col("turn").cast("string")))
    return rows.select("conv_id", "turn", F.array_join(media.dedup_lines(lines), "|").alias("lines"))


@query("""SELECT doc_id, 'Default' AS style, (CASE WHEN doc_id % 4 = 0 THEN 512.5 ELSE (CASE WHEN doc_id % 100 > 0 THEN doc_id % 100 ELSE 20 END + 1920 - 30) / 2.0 END)::DOUBLE AS centre_x, length(text) + CASE WHEN doc_id % 4 = 0 THEN 17 ELSE 0 END AS text_chars FROM documents""")
def ass_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = run_sql(spark, sf_dir, "SELECT doc_id, text FROM documents")
    mark = F.when(F.col("doc_id") % 4 == 0, r"{\pos(512.5,980)}").otherwise("")
    payload = F.concat(F.lit("0,0, Default ,N,"), (F.col("doc_id") % 100).cast("string"), F.lit(",0,0,fx,"), mark, F.col("text"))
    f = media.ass_fields(payload, F.lit(20), F.lit(30), F.lit(1920))
    return docs.select("doc_id", f["style"].alias("style"), f["centre_x"].alias("centre_x"), F.length(f["text"]).cast("bigint").alias("text_chars"))


@query("SELECT l_partkey, l_suppkey, CAST((l_partkey % 256) // 2 % 64 AS INT) AS nal_type, CAST((l_partkey % 2) * 32 + (l_suppkey % 256) // 8 AS INT) AS layer_id, CAST(l_partkey % 32 AS INT) AS avc_type FROM lineitem")
def nal_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT l_partkey, l_suppkey FROM lineitem")
    b0, b1 = (F.col("l_partkey") % 256).cast("int"), (F.col("l_suppkey") % 256).cast("int")
    h = media.nal_bits(b0, b1)
    return rows.select("l_partkey", "l_suppkey", h["nal_type"].alias("nal_type"), h["layer_id"].alias("layer_id"), media.nal_bits(b0, b1, "h264")["nal_type"].alias("avc_type"))


@query("SELECT o_orderkey, (o_orderkey * 1801) // 90 AS ms_90k, (o_orderkey * 1801) // 45 AS ms_45k, round(o_orderkey * 1801 / 45000.0::DOUBLE, 6) AS s_45k FROM orders")
def ts_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderkey") * 1801
    return run_sql(spark, sf_dir, "SELECT o_orderkey FROM orders").select("o_orderkey", media.ts_convert(t, "90k_ms").alias("ms_90k"), media.ts_convert(t, "45k_ms").alias("ms_45k"), F.round(media.ts_convert(t, "45k_s"), 6).alias("s_45k"))


@query("SELECT l_partkey, CAST(CASE WHEN l_partkey % 256 >= 128 THEN -(l_partkey % 128) ELSE l_partkey % 128 END AS INT) AS px, round(CASE WHEN l_partkey % 256 >= 128 THEN -(l_partkey % 128) ELSE l_partkey % 128 END / 960.0::DOUBLE, 9) AS disparity FROM lineitem")
def offset_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = geometry.offset_px((F.col("l_partkey") % 256).cast("int"))
    return run_sql(spark, sf_dir, "SELECT l_partkey FROM lineitem").select("l_partkey", px.alias("px"), F.round(geometry.px_to_disparity(px), 9).alias("disparity"))


@query("""SELECT event_id, round(value / 1920 / (0.063 * 2.0), 4) AS vac, round(degrees(2 * atan2(value / 1920, 4.0)), 6) AS angle, round(sign(d) * CASE WHEN abs(d) <= 20 THEN abs(d) ELSE 20 + (abs(d) - 20) / (1 + (abs(d) - 20) / 15.0) END, 6) AS bent
    FROM (SELECT event_id, value::DOUBLE + 0.00123 AS value, (value - 25)::DOUBLE AS d FROM events) x""")
def vac(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") + 0.00123
    return run_sql(spark, sf_dir, "SELECT event_id, value FROM events").select("event_id", F.round(geometry.vac(v), 4).alias("vac"), F.round(geometry.angular_disparity(v), 6).alias("angle"), F.round(geometry.soft_knee(F.col("value") - 25, 20.0, 35.0), 6).alias("bent"))


@query("""SELECT event_id, round(least(1, greatest(0, 0.5 + 0.82 * (t + 0.12 * (t * t * (3 - 2 * t) - t) - 0.5))), 6) AS tone FROM (SELECT event_id, least(1, greatest(0, (value - 5) / 60))::DOUBLE AS t FROM events) x""")
def tone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "SELECT event_id, value FROM events").select("event_id", F.round(geometry.tone_map(F.col("value"), F.lit(5.0), F.lit(65.0)), 6).alias("tone"))


@query("SELECT title, CAST(greatest(1, floor(width / (1.3 + size / 40.0) / 14 + 0.5)) AS BIGINT) * 14 AS height FROM titles")
def patch_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "titles").select("title", geometry.patch_height(F.col("width"), 1.3 + F.col("size") / 40.0).alias("height"))

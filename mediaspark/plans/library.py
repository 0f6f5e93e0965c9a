"""Queries of the library: playlists, features, assets, joins on packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media
from ..operators import asof, catalog, ranks, sessions, timeline
from ..sources import readers
from ..views import run_sql, view
from .recursion import fold
from .registry import query

LISTS = """lists AS (SELECT disc_id, playlist, sum((out_45k - in_45k) * n) / 45000.0::DOUBLE AS duration_s, CAST(sum(n) AS BIGINT) AS items, sum(n) > 1 AND sum((out_45k - in_45k) * n) > 1.5 * sum(out_45k - in_45k) AS decoy
    FROM (SELECT disc_id, playlist, clip, in_45k, out_45k, count(*) AS n FROM segments GROUP BY ALL) x GROUP BY ALL)"""
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY decoy, duration_s DESC, playlist) AS rank FROM lists)"


@query("SELECT disc_id, playlist, sum(out_45k - in_45k) / 45000.0::DOUBLE AS duration_s, count(*) AS items FROM segments GROUP BY ALL")
def playlist_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.durations(view(spark, sf_dir, "segments"))


@query(f"WITH {LISTS} SELECT disc_id, playlist, items, duration_s FROM lists WHERE decoy")
def decoy_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.decoys(view(spark, sf_dir, "segments"))


@query(f"WITH {LISTS}, {RANKED} SELECT disc_id, playlist, decoy, duration_s, CAST(rank AS INT) AS rank FROM ranked")
def ranked_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ranked(catalog.playlists(view(spark, sf_dir, "segments")))


_LISTED = f"""SELECT l.disc_id, l.decoy, list({{'p': l.playlist, 'd': l.duration_s, 'x': l.playlist % 5 = 0, 'q': s.sequence}} ORDER BY l.duration_s DESC, l.playlist) AS l
    FROM lists l JOIN (SELECT disc_id, playlist, string_agg(clip || ':' || out_45k, ',' ORDER BY item_no) AS sequence FROM segments GROUP BY ALL) s ON l.disc_id = s.disc_id AND l.playlist = s.playlist GROUP BY ALL"""
#: Place by place, a playlist without the extension swaps with the first later one that is equivalent and has it.
PREFERRED = f"""{LISTS}, groups AS ({_LISTED}),
    walk AS (SELECT disc_id, decoy, l, 0 AS i FROM groups UNION ALL SELECT disc_id, decoy, CASE WHEN j IS NULL THEN l ELSE list_concat(l[1:i], [l[j]], l[i + 2:j - 1], [l[i + 1]], l[j + 1:]) END, i + 1
        FROM (SELECT *, CASE WHEN NOT l[i + 1].x THEN list_min([k for k in range(i + 2, len(l) + 1) if l[k].x AND (l[k].q = l[i + 1].q OR (l[i + 1].d > 0 AND abs(l[k].d - l[i + 1].d) <= 0.01 * l[i + 1].d))]) END AS j FROM walk WHERE i < len(l)) w),
    preferred AS (SELECT disc_id, decoy, l[n].p AS playlist, l[n].d AS duration_s, n AS rank FROM (SELECT disc_id, decoy, l, unnest(range(1, len(l) + 1)) AS n FROM walk WHERE i = len(l)) w)"""


@query(f"""WITH RECURSIVE {PREFERRED}, hits AS (SELECT s.disc_id, s.playlist, CASE c.kind WHEN 'ssif' THEN 0 ELSE 1 END AS phase, c.kind, arg_min(c.path, s.item_no) AS path, count(*) AS clips FROM segments s JOIN both_clips c ON s.clip = c.clip GROUP BY ALL),
    spare AS (SELECT CASE kind WHEN 'ssif' THEN 2 ELSE 3 END AS phase, kind, arg_min(path, (-size_bytes, path)) AS path FROM both_clips GROUP BY kind),
    every AS (SELECT h.disc_id, h.phase, r.decoy, r.rank, h.kind, h.playlist, h.path, h.clips, r.duration_s FROM hits h JOIN preferred r ON h.disc_id = r.disc_id AND h.playlist = r.playlist
    UNION ALL SELECT d.disc_id, s.phase, false, 1, s.kind, NULL, s.path, 1, 0.0 FROM (SELECT DISTINCT disc_id FROM segments) d, spare s)
    SELECT disc_id, phase, kind, playlist, path, clips, duration_s FROM (SELECT *, row_number() OVER (PARTITION BY disc_id ORDER BY phase, decoy, rank) AS k FROM every) x WHERE k = 1""")
def main_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    extension = run_sql(spark, sf_dir, "SELECT DISTINCT l_orderkey % 100 AS disc_id, l_orderkey AS playlist FROM lineitem WHERE l_orderkey % 5 = 0")
    return catalog.main_feature(view(spark, sf_dir, "segments", {"lineitem": "l_orderkey"}), view(spark, sf_dir, "both_clips"), extension)


@query("SELECT kind, arg_min(path, (-size_bytes, path)) AS path, max(size_bytes) AS size_bytes FROM both_clips GROUP BY kind")
def largest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.largest(view(spark, sf_dir, "both_clips"), ["kind"])


@query("""SELECT s.disc_id, s.playlist, s.item_no, s.clip, c.path, a.path AS audio_path FROM segments s JOIN both_clips c ON s.clip = c.clip AND c.kind = 'ssif' LEFT JOIN both_clips a ON s.clip = a.clip AND a.kind = 'm2ts'""")
def resolve_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resolve_segments(view(spark, sf_dir, "segments"), view(spark, sf_dir, "both_clips"), "ssif").select("disc_id", "playlist", "item_no", "clip", "path", "audio_path")


@query(f"WITH RECURSIVE {PREFERRED} SELECT disc_id, playlist, decoy, CAST(rank AS INT) AS rank FROM preferred")
def prefer_3d_playlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = view(spark, sf_dir, "segments")
    sequence = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "clip", "out_45k"))), lambda s: F.concat_ws(":", s["clip"], s["out_45k"].cast("string"))), ",")
    lists = catalog.playlists(segments).join(segments.groupBy("disc_id", "playlist").agg(sequence.alias("sequence")), ["disc_id", "playlist"])
    return catalog.prefer_3d(lists.withColumn("has_3d", F.col("playlist") % 5 == 0))


@query("""SELECT f.disc_id, f.clip, d.clip AS dep_clip, b.path AS base_path, d.path AS dep_path FROM (SELECT disc_id, min(clip) AS clip FROM segments WHERE clip > '00000' GROUP BY disc_id) f
    JOIN both_clips b ON f.clip = b.clip AND b.kind = 'm2ts' JOIN both_clips d ON d.kind = 'm2ts' AND d.size_bytes > 0 AND d.clip = CASE WHEN f.disc_id % 3 = 0 THEN '00009' ELSE lpad(CAST(CAST(f.clip AS INT) + 1 AS STRING), 5, '0') END""")
def pair_dependent_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = run_sql(spark, sf_dir, "SELECT disc_id, min(clip) AS clip FROM segments WHERE clip > '00000' GROUP BY disc_id")
    clips = view(spark, sf_dir, "both_clips")
    extension = features.filter("disc_id % 3 = 0").withColumn("dep_clip", F.lit("00009"))
    return catalog.pair_clips(features, extension, clips).select("disc_id", "clip", "dep_clip", "base_path", "dep_path")


_EDL = "'%' || strlen(c.path) || '%' || c.path || ',length=' || printf('%.3f', (s.out_45k - s.in_45k) / 45000.0::DOUBLE)"


@query(f"""SELECT disc_id, playlist, CASE WHEN n < 2 THEN '' ELSE 'edl://' || p END AS edl FROM (SELECT s.disc_id, s.playlist, count(*) AS n, string_agg({_EDL}, ';' ORDER BY s.item_no) AS p FROM segments s JOIN both_clips c ON s.clip = c.clip AND c.kind = 'm2ts' GROUP BY s.disc_id, s.playlist) x""")
def edl_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = catalog.resolve_segments(view(spark, sf_dir, "segments"), view(spark, sf_dir, "both_clips"), "m2ts")
    return catalog.edl(met.withColumn("duration_s", (F.col("out_45k") - F.col("in_45k")) / 45000.0))


@query("""WITH e AS (SELECT user_id AS title, event_id AS seq, CASE event_type WHEN 'view' THEN 'sbs' WHEN 'click' THEN 'tab' WHEN 'error' THEN 'anaglyph' ELSE NULL END AS mode, CASE event_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'rl' ELSE 'auto' END AS o FROM events),
    p AS (SELECT *, CASE mode WHEN 'sbs' THEN 2 ELSE 1 END AS p FROM e WHERE mode IS NOT NULL), r AS (SELECT *, p >= max(p) OVER (PARTITION BY title ORDER BY seq) AS leads FROM p)
    SELECT title, arg_max(mode, (p, seq)) AS stereo_mode, coalesce(arg_max(CASE o WHEN 'left' THEN 'left_first' ELSE 'right_first' END, seq) FILTER (WHERE leads AND o <> 'auto'), 'unknown') AS eye_order, true AS is_3d, false AS has_mvc FROM r GROUP BY title""")
def title_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "SELECT user_id AS title, event_id AS seq, CASE event_type WHEN 'view' THEN 'sbs' WHEN 'click' THEN 'tab' WHEN 'error' THEN 'anaglyph' ELSE NULL END AS mode, CASE event_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'rl' ELSE 'auto' END AS eye_order FROM events"
    return catalog.promote(run_sql(spark, sf_dir, sql))


@query("SELECT l_orderkey AS file, bool_or(l_returnflag = 'R') AS has_audio FROM lineitem GROUP BY l_orderkey")
def any_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.any_audio(run_sql(spark, sf_dir, "SELECT l_orderkey AS file, CASE WHEN l_returnflag = 'R' THEN 'audio' ELSE 'video' END AS codec_type FROM lineitem"))


@query("SELECT l_suppkey AS program, array_to_string(list_sort(list(DISTINCT l_partkey % 300)), ',') AS pids FROM lineitem WHERE 130 + l_linenumber IN (131, 134) GROUP BY l_suppkey")
def stream_pids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT l_suppkey AS program, l_partkey % 300 AS pid, 130 + l_linenumber AS stream_type FROM lineitem")
    return catalog.stream_pids(rows, [131, 134]).select("program", F.array_join("pids", ",").alias("pids"))


@query("""SELECT t.track_id, coalesce(nullif(trim(t.lang), ''), nullif(trim(p.lang), '')) AS lang FROM tracks t LEFT JOIN pid_lang p ON t.clip = p.clip AND t.pid = p.pid""")
def track_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.fill_language(view(spark, sf_dir, "tracks"), view(spark, sf_dir, "pid_lang")).select("track_id", "lang")


@query("SELECT pack, name, bytes FROM manifest m WHERE NOT EXISTS (SELECT 1 FROM inventory i WHERE i.name = m.name AND i.bytes = m.bytes)")
def manifest_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.manifest_missing(view(spark, sf_dir, "manifest"), view(spark, sf_dir, "inventory")).select("pack", "name", "bytes")


@query("""SELECT pack, count(*) FILTER (WHERE hit) AS installed, count(*) AS total, CAST(coalesce(sum(bytes) FILTER (WHERE NOT hit), 0) AS BIGINT) AS missing_bytes, bool_and(hit) AS complete
    FROM (SELECT m.*, EXISTS (SELECT 1 FROM inventory i WHERE i.name = m.name AND i.bytes = m.bytes) AS hit FROM manifest m) x GROUP BY pack""")
def pack_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.pack_status(view(spark, sf_dir, "manifest"), view(spark, sf_dir, "inventory"))


@query("""SELECT doc_id, source NOT IN (SELECT source FROM documents WHERE doc_id % 7 = 0 AND source < 'src3') OR EXISTS (SELECT 1 FROM documents m WHERE m.doc_id % 7 = 0 AND m.source < 'src3' AND m.source = d.source AND m.doc_id = d.doc_id) AS attested FROM documents d""")
def attested(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = run_sql(spark, sf_dir, "SELECT doc_id, source AS dir, concat('/assets/', source, '/M', CAST(doc_id AS STRING), '.onnx') AS path FROM documents")
    markers = run_sql(spark, sf_dir, "SELECT source AS dir, concat('m', CAST(doc_id AS STRING), '.ONNX') AS name FROM documents WHERE doc_id % 7 = 0 AND source < 'src3'")
    return catalog.attested(assets, markers).select("doc_id", "attested")


@query("""WITH shapes AS (SELECT DISTINCT 'model_756x' || CAST(14 * p_size AS STRING) || '.onnx' AS name, 14 * p_size AS height FROM part WHERE p_size > 0 AND 14 * p_size <= 756 AND 1.0 - 14 * p_size / 756.0::DOUBLE >= 0.10),
    t AS (SELECT title, width / CAST(height - size * 3 AS DOUBLE) AS ratio FROM titles), k AS (SELECT t.title, s.name, s.height, row_number() OVER (PARTITION BY t.title ORDER BY abs(s.height - 756 / ratio), abs(756 / s.height::DOUBLE / ratio - 1.0), -s.height, s.name) AS k
    FROM t JOIN shapes s ON abs(s.height - 756 / ratio) <= 14) SELECT t.title, round(t.ratio, 6) AS ratio, k.name AS shape, CAST(k.height AS BIGINT) AS shape_height FROM t LEFT JOIN k ON t.title = k.title AND k.k = 1""")
def aspect_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = run_sql(spark, sf_dir, "SELECT DISTINCT concat('model_756x', CAST(14 * p_size AS STRING), '.onnx') AS name, 756 AS width, 14 * p_size AS height FROM part")
    titles = run_sql(spark, sf_dir, "SELECT title, width AS source_width, height AS source_height, size AS crop_top, size * 2 AS crop_bottom FROM titles")
    return catalog.aspect_bucket(titles, shapes, 756).select("title", "ratio", "shape", "shape_height")


@query("SELECT disc_id, name, seq FROM (SELECT *, row_number() OVER (PARTITION BY disc_id, lower(name) ORDER BY seq) AS k FROM (SELECT p_size AS disc_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_partkey AS seq FROM part) x) y WHERE k = 1")
def dedup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dedup_ci(run_sql(spark, sf_dir, "SELECT p_size AS disc_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_partkey AS seq FROM part")).select("disc_id", "name", "seq")


@query("""SELECT store, media_key, updated FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY updated DESC, media_key) AS k FROM (SELECT c_mktsegment AS store, CAST(o_custkey AS STRING) AS media_key, CAST(max(o_orderkey) AS BIGINT) AS updated
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) x) y WHERE k <= 100""")
def lru_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT c_mktsegment AS store, CAST(o_custkey AS STRING) AS media_key, CAST(max(o_orderkey) AS BIGINT) AS updated FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_custkey")
    return ranks.prune(rows, n=100)


@query("""SELECT pack, v.version AS newest FROM (SELECT pack, arg_max(version, (a, b, c)) AS version FROM (SELECT p_size AS pack, p_partkey % 3 AS a, p_partkey % 17 AS b, p_partkey % 11 AS c, concat(p_partkey % 3, '.', p_partkey % 17, '.', p_partkey % 11) AS version, 1 AS major FROM part WHERE p_partkey % 5 <> 0) x WHERE a = major GROUP BY pack) v""")
def newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT p_size AS pack, concat(CAST(p_partkey % 3 AS STRING), '.', CAST(p_partkey % 17 AS STRING), '.', CAST(p_partkey % 11 AS STRING), CASE WHEN p_partkey % 5 = 0 THEN 'rc1' ELSE '' END) AS version, 1 AS major FROM part")
    return ranks.newest_version(rows, ["pack"])


@query("""SELECT user_id, pass, fps FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fps DESC, pass) AS k FROM (SELECT user_id, event_id AS pass, round(value) AS fps FROM events) x) y WHERE k = 1""")
def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.best_run(run_sql(spark, sf_dir, "SELECT user_id, event_id AS pass, round(value) AS fps FROM events"), "user_id")


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t) AS n FROM (SELECT user_id AS stream, event_id AS t, event_type AS sig, value FROM events) x), r AS (SELECT *, n - row_number() OVER (PARTITION BY stream, sig ORDER BY t) AS g FROM a),
    p AS (SELECT *, row_number() OVER (PARTITION BY stream, sig, g ORDER BY t) AS place FROM r)
    SELECT stream, min(t) FILTER (WHERE place = 3) AS stable_t, arg_min(sig, t) FILTER (WHERE place = 3) AS stable_signature, arg_max(sig, (sig = 'view', value, 1, -t)) AS best_signature FROM p GROUP BY stream""")
def best_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.islands import stable_snapshot

    polls = run_sql(spark, sf_dir, "SELECT user_id AS stream, event_id AS t, event_type AS signature, event_type = 'view' AS is_3d, value AS duration_s, 1 AS candidates FROM events")
    return stable_snapshot(polls, ["stream"], ["t"])


_POLLED = """SELECT user_id AS scan, {0} AS seconds, CASE WHEN event_type <> 'error' THEN concat('disc/', user_id) END AS feature, user_id % 7 AS playlist, CASE WHEN value >= 60 THEN 'ssif' ELSE 'm2ts' END AS kind,
    CAST(CASE WHEN value < 5 THEN 0 WHEN value < 20 THEN 30 ELSE 5400 END AS DOUBLE) AS duration_s, CASE WHEN event_type = 'signup' AND value >= 100 THEN 2 ELSE 1 END AS candidates_playlists, 0 AS candidates_ssif, 1 AS candidates_m2ts, CAST(NULL AS {1}) AS pair FROM events"""


@query(f"""WITH p AS ({_POLLED.format("CAST(epoch_us(ts) // 1000000 AS DOUBLE) / 43200", "VARCHAR")}), n AS (SELECT *, row_number() OVER s AS n, seconds - min(seconds) OVER (PARTITION BY scan) AS waited, concat_ws('|', coalesce(feature, '-'), kind, duration_s, candidates_playlists) AS sig FROM p
    WINDOW s AS (PARTITION BY scan ORDER BY seconds, feature NULLS FIRST, playlist, kind, duration_s, candidates_playlists)), l AS (SELECT *, sig = lag(sig) OVER w AND sig = lag(sig, 2) OVER w AS same, coalesce(lag(waited) OVER w < 30, true) AS seen FROM n WINDOW w AS (PARTITION BY scan ORDER BY n)),
    f AS (SELECT *, coalesce(same, false) AND feature IS NOT NULL AND (duration_s <= 0 OR duration_s >= 60) AND waited >= 10 AS ok FROM l WHERE seen),
    e AS (SELECT scan, bool_or(ok) AS settled, coalesce(min(n) FILTER (WHERE ok), arg_max(n, (kind = 'ssif', duration_s, candidates_playlists + candidates_ssif + candidates_m2ts, -n)) FILTER (WHERE feature IS NOT NULL), max(n)) AS n FROM f GROUP BY scan)
    SELECT e.scan, e.settled, n.seconds, n.feature, n.playlist, n.kind, n.duration_s FROM e JOIN n ON e.scan = n.scan AND e.n = n.n""")
def settled_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.islands import settled_snapshot as settle

    return settle(run_sql(spark, sf_dir, _POLLED.format("CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS DOUBLE) / 43200", "STRING")), ["scan"], "seconds")


@query("""WITH r AS (SELECT l_suppkey % 20 AS file, l_partkey % 400 AS tab, l_shipdate AS v, row_number() OVER (PARTITION BY l_suppkey % 20, l_partkey % 400 ORDER BY l_orderkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice) AS n FROM lineitem), c AS (SELECT *, coalesce(v >= lag(v) OVER (PARTITION BY file, tab ORDER BY n), true) AS ok FROM r),
    g AS (SELECT file, tab, count(*) AS n FROM c GROUP BY ALL HAVING bool_and(ok) AND count(*) >= 2) SELECT file, arg_min(tab, (-n, tab)) AS tab, max(n) AS n FROM g GROUP BY file""")
def longest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.islands import longest_sorted

    rows = run_sql(spark, sf_dir, "SELECT l_suppkey % 20 AS file, l_partkey % 400 AS tab, l_shipdate AS v, row_number() OVER (PARTITION BY l_suppkey % 20, l_partkey % 400 ORDER BY l_orderkey, l_linenumber, l_shipdate, l_quantity, l_extendedprice) AS n FROM lineitem")
    return longest_sorted(rows, ["file"], "tab", "n", "v")


@query("""SELECT media_path, CASE WHEN letter IN ('D', 'F') THEN '/images/' || lower(letter) || '.iso' ELSE lower(replace(media_path, '//', '/')) END AS media_key FROM (SELECT *, upper(substr(media_path, 1, 1)) AS letter FROM (SELECT concat(CASE o_custkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'E' ELSE 'F' END, ':/Films//', CAST(o_orderkey AS STRING)) AS media_path FROM orders) x) y""")
def media_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT concat(CASE o_custkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'E' ELSE 'F' END, ':/Films//', CAST(o_orderkey AS STRING)) AS media_path FROM orders")
    mounts = run_sql(spark, sf_dir, "SELECT DISTINCT CASE WHEN r_regionkey % 2 = 0 THEN 'D' ELSE 'f' END AS letter, CASE WHEN r_regionkey % 2 = 0 THEN '/images/d.iso' ELSE '/Images/F.iso' END AS image_path FROM region")
    return media.media_key(rows, mounts)


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def block_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.block_sha256(run_sql(spark, sf_dir, "SELECT page_id, html AS content FROM pages")).select("page_id", "sha256")


@query("""WITH c AS (SELECT page_id, unnest(range(0, greatest(length(url), 1), 16)) AS pos, url FROM pages)
    SELECT page_id, count(*) AS n_chunks, sha256(string_agg(sha256(substr(url, pos + 1, 16)), '' ORDER BY pos)) AS sha256 FROM c GROUP BY page_id""")
def block_sha256_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses, in chunks of 16 characters."""
    pages = run_sql(spark, sf_dir, "SELECT page_id, url, explode(sequence(0, greatest(length(url) - 1, 0), 16)) AS at FROM pages")
    return readers.chunk_sha256(pages.select("page_id", "at", F.expr("substring(url, CAST(at + 1 AS INT), 16)").alias("content")), ["page_id"])


@query()
def frame_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "SELECT page_id, url, html FROM pages").select("page_id", readers.frame_crc(F.col("url"), F.col("html")).alias("crc"))


def _paired(base: str, dep: str) -> str:
    """Base units in decode order, each with the nearest dependent unit that no earlier one has taken."""
    near = f"SELECT b.stream_id, b.seq, b.pts, list({{'g': abs(b.pts - d.pts), 'q': d.seq}} ORDER BY abs(b.pts - d.pts), d.seq) FILTER (WHERE d.seq IS NOT NULL) AS c FROM ({base}) b LEFT JOIN ({dep}) d ON b.stream_id = d.stream_id AND abs(b.pts - d.pts) <= 1800 GROUP BY ALL"
    walk = fold(
        near, "stream_id", "seq",
        {
            "_free": ("", "[x.q for x in coalesce(s.c, []) if NOT list_contains(r.used, x.q)]"),
            "dep": ("NULL::BIGINT", "{_free}[1]"),
            "used": ("[]::BIGINT[]", "CASE WHEN len({_free}) > 0 THEN list_append(r.used, {_free}[1]) ELSE r.used END"),
        },
        "s.stream_id, s.seq, s.pts, r.dep AS dep_seq",
    )
    return f"SELECT *, CASE WHEN dep_seq IS NOT NULL THEN count(*) OVER (PARTITION BY stream_id, dep_seq) END AS reused FROM ({walk}) w"


def _pair(base: DataFrame, dep: DataFrame) -> DataFrame:
    pairs = timeline.pair_views(base, dep).select("stream_id", "seq", "pts", F.col("match.seq").alias("dep_seq"))
    uses = pairs.filter("dep_seq IS NOT NULL").groupBy("stream_id", "dep_seq").agg(F.count(F.lit(1)).alias("reused"))
    return pairs.join(uses, ["stream_id", "dep_seq"], "left").select("stream_id", "seq", "pts", "dep_seq", "reused")


@query(_paired("SELECT * FROM base_aus", "SELECT * FROM dep_aus"))
def pair_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair(view(spark, sf_dir, "base_aus"), view(spark, sf_dir, "dep_aus"))


#: Streams so dense that units are within the tolerance of several others, and decode order is not time order.
_DENSE = "SELECT user_id % 25 AS stream_id, event_id AS seq, event_id % 500 * 700 + event_id % 7 * 400 AS pts FROM events WHERE event_type {kind}"


@query(_paired(_DENSE.format(kind="IN ('view', 'error')"), _DENSE.format(kind="NOT IN ('view', 'error')")))
def pair_views_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, dep = (run_sql(spark, sf_dir, _DENSE.format(kind=k)) for k in ("IN ('view', 'error')", "NOT IN ('view', 'error')"))
    return _pair(base, dep)


@query("""WITH x AS (SELECT o_orderkey, o_orderkey * 3003 AS base_pts, o_orderkey * 3003 + (o_custkey % 30 - 15) * 1000 AS dep_pts FROM orders)
    SELECT o_orderkey, CASE WHEN base_pts - dep_pts > 3003 THEN 'drop_dep' WHEN base_pts - dep_pts < -3003 THEN 'drop_base' ELSE 'keep' END AS action, abs(base_pts - dep_pts) > 9000 AS flagged FROM x""")
def desync_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = run_sql(spark, sf_dir, "SELECT o_orderkey, o_orderkey * 3003 AS base_pts, o_orderkey * 3003 + (o_custkey % 30 - 15) * 1000 AS dep_pts FROM orders")
    return timeline.desync(pairs).select("o_orderkey", "action", "flagged")


@query("""WITH v AS (SELECT o_custkey % 200 AS stream_id, o_orderkey AS seq, o_totalprice > 100000 AS pts, CAST(o_orderkey % 2 AS INT) AS view_id FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) - row_number() OVER (PARTITION BY stream_id, pts ORDER BY seq) AS g FROM v),
    p AS (SELECT *, row_number() OVER (PARTITION BY stream_id, pts, g ORDER BY seq) AS k, count(*) OVER (PARTITION BY stream_id, pts, g) AS n FROM a)
    SELECT stream_id, min(seq) AS first, any_value(pts) AS pts, CASE WHEN arg_max(view_id, seq) = 0 AND arg_min(view_id, seq) <> 0 THEN arg_max(view_id, seq) ELSE arg_min(view_id, seq) END AS "left", CASE WHEN arg_max(view_id, seq) = 0 AND arg_min(view_id, seq) <> 0 THEN arg_min(view_id, seq) ELSE arg_max(view_id, seq) END AS "right"
    FROM p WHERE k <= n - n % 2 GROUP BY stream_id, pts, g, (k - 1) // 2""")
def pair_equal_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = run_sql(spark, sf_dir, "SELECT o_custkey % 200 AS stream_id, o_orderkey AS seq, o_totalprice > 100000 AS pts, CAST(o_orderkey % 2 AS INT) AS view_id FROM orders")
    return timeline.pair_equal(views)[0]


@query("""SELECT o_orderkey, coalesce(p.dep, o_orderkey) AS dep FROM orders o LEFT JOIN (SELECT l_suppkey AS stream_id, l_partkey AS poc, min(l_orderkey) AS dep FROM lineitem GROUP BY ALL) p ON o.o_custkey % 100 = p.stream_id AND o.o_orderkey % 2000 = p.poc""")
def repair_by_poc(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = run_sql(spark, sf_dir, "SELECT o_orderkey, o_custkey % 100 AS stream_id, o_orderkey % 2000 AS poc, o_orderkey AS dep FROM orders")
    pool = run_sql(spark, sf_dir, "SELECT l_suppkey AS stream_id, l_partkey AS poc, l_orderkey AS dep FROM lineitem")
    return timeline.repair_poc(frames, pool).select("o_orderkey", "dep")


@query("SELECT t.event_id, p.event_id AS point FROM (SELECT * FROM ticks WHERE event_type = 'click') t ASOF LEFT JOIN (SELECT user_id, t, max(event_id) AS event_id FROM ticks WHERE event_type = 'view' GROUP BY ALL) p ON t.user_id = p.user_id AND t.t >= p.t")
def keyframe_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = run_sql(spark, sf_dir, "SELECT user_id, event_id, t FROM ticks WHERE event_type = 'click'")
    points = run_sql(spark, sf_dir, "SELECT user_id, event_id, t FROM ticks WHERE event_type = 'view'")
    return asof.asof(targets, points, ["user_id"], "t", 86_400 * 7, tie=["event_id"]).select("event_id", F.col("match.event_id").alias("point"))


_EXT = "SELECT l_suppkey AS clip, l_orderkey AS ext_no, l_orderkey * 5000 AS start, CAST(4000 + 10 * (l_orderkey % 100) AS BIGINT) AS length FROM lineitem GROUP BY l_suppkey, l_orderkey"


@query(f"""WITH e AS ({_EXT}), p AS (SELECT o_orderkey, o_custkey % 100 AS clip, o_orderkey * 4900 + o_custkey AS at FROM orders)
    SELECT p.o_orderkey, CASE WHEN p.at < e.start + e.length THEN e.ext_no END AS ext_no FROM p ASOF LEFT JOIN e ON p.clip = e.clip AND p.at >= e.start""")
def extent_of_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = run_sql(spark, sf_dir, "SELECT o_orderkey, o_custkey % 100 AS clip, o_orderkey * 4900 + o_custkey AS at FROM orders")
    met = asof.range_lookup(probes, run_sql(spark, sf_dir, _EXT), ["clip"], "at", "start", "length", 5_000_000)
    return met.select("o_orderkey", F.col("match.ext_no").alias("ext_no"))


_BASE_EXT = "SELECT DISTINCT l_suppkey AS clip, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS ext_no, l_orderkey * 10 AS start FROM lineitem"
_DEP_EXT = "SELECT DISTINCT l_suppkey AS clip, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS ext_no, l_orderkey * 3 AS start FROM lineitem WHERE l_linenumber < 7"
_TOTALS = "SELECT l_suppkey AS clip, max(l_orderkey) * 10 + 5 AS base_total, max(l_orderkey) * 3 + 2 AS dep_total FROM lineitem GROUP BY l_suppkey"
_POINTS = "SELECT o_custkey % 100 AS clip, o_orderkey AS pts_ms, (o_orderkey * 9 + o_custkey % 50) * 192 AS byte_off FROM orders"


@query(f"""WITH b AS ({_BASE_EXT}), d AS ({_DEP_EXT}), t AS ({_TOTALS}), bl AS (SELECT b.*, greatest(0, coalesce(lead(start) OVER (PARTITION BY b.clip ORDER BY ext_no), base_total, start) - start) AS len FROM b LEFT JOIN t ON b.clip = t.clip),
    dl AS (SELECT d.*, greatest(0, coalesce(lead(start) OVER (PARTITION BY d.clip ORDER BY ext_no), dep_total, start) - start) AS len FROM d LEFT JOIN t ON d.clip = t.clip),
    u AS (SELECT bl.clip, bl.ext_no, coalesce(sum(bl.len + dl.len) OVER (PARTITION BY bl.clip ORDER BY bl.ext_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM bl JOIN dl ON bl.clip = dl.clip AND bl.ext_no = dl.ext_no),
    f AS (SELECT b.clip, b.ext_no, b.start, u.unit FROM b LEFT JOIN u ON b.clip = u.clip AND b.ext_no = u.ext_no), p AS ({_POINTS})
    SELECT p.clip, p.pts_ms, f.ext_no, CAST(f.unit * 192 AS BIGINT) AS ssif_byte FROM p ASOF JOIN f ON p.clip = f.clip AND p.byte_off // 192 >= f.start WHERE f.unit IS NOT NULL""")
def ssif_seek_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = lambda sql: run_sql(spark, sf_dir, sql)
    out = timeline.seek_table(load(_POINTS), load(_BASE_EXT), load(_DEP_EXT), load(_TOTALS), 100_000)
    return out.withColumn("ext_no", F.col("ext_no").cast("bigint"))


@query("SELECT playlist, item_no, CAST(coalesce(sum(ms) OVER (PARTITION BY playlist ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM (SELECT playlist, item_no, (out_45k - in_45k) // 45 AS ms FROM segments) x")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT playlist, item_no, (out_45k - in_45k) / CAST(45000.0 AS DOUBLE) AS duration_s FROM segments")
    return timeline.segment_offsets(rows, ["playlist"]).select("playlist", "item_no", "offset_ms")


@query("""WITH s AS (SELECT playlist, item_no, coalesce(sum((out_45k - in_45k) // 45) OVER (PARTITION BY playlist ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM segments),
    t AS (SELECT o_orderkey AS playlist, greatest(0, (o_custkey % 9000) - 50) AS t FROM orders) SELECT t.playlist, t.t AS at_ms, s.item_no, CAST(t.t - s.off AS BIGINT) AS local_ms FROM t ASOF LEFT JOIN s ON t.playlist = s.playlist AND t.t >= s.off""")
def global_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT playlist, item_no, (out_45k - in_45k) / CAST(45000.0 AS DOUBLE) AS duration_s FROM segments")
    times = run_sql(spark, sf_dir, "SELECT o_orderkey AS playlist, (o_custkey % 9000) - 50 AS global_ms FROM orders")
    return timeline.locate(times, rows, ["playlist"]).select("playlist", F.greatest(F.lit(0), "global_ms").alias("at_ms"), "item_no", "local_ms")


@query("SELECT t.event_id, p.t - t.t AS due_in FROM (SELECT * FROM ticks WHERE event_type = 'click') t ASOF LEFT JOIN (SELECT user_id, t FROM ticks WHERE event_type = 'error') p ON t.user_id = p.user_id AND t.t - 3600 < p.t")
def next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = run_sql(spark, sf_dir, "SELECT user_id, event_id, t - 3600 AS t FROM ticks WHERE event_type = 'click'")
    events = run_sql(spark, sf_dir, "SELECT user_id, t FROM ticks WHERE event_type = 'error'")
    met = asof.asof(times, events, ["user_id"], "t", 86_400 * 7, strict=True, forward=True)
    return met.select("event_id", (F.col("match.t") - F.col("t") - 3600).alias("due_in"))


@query("""SELECT t.event_id, CASE WHEN t.t - p.t <= 20000 THEN p.event_id END AS result FROM (SELECT * FROM ticks WHERE event_type = 'click') t
    ASOF LEFT JOIN (SELECT user_id, value > 50 AS gen, t, max(event_id) AS event_id FROM ticks WHERE event_type = 'view' GROUP BY ALL) p ON t.user_id = p.user_id AND (t.value > 50) = p.gen AND t.t + 40 >= p.t""")
def matte_for_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = run_sql(spark, sf_dir, "SELECT user_id, value > 50 AS generation, event_id, t + 40 AS t FROM ticks WHERE event_type = 'click'")
    results = run_sql(spark, sf_dir, "SELECT user_id, value > 50 AS generation, t, max(event_id) AS event_id FROM ticks WHERE event_type = 'view' GROUP BY user_id, value > 50, t")
    return asof.asof_tolerance(frames, results, ["user_id", "generation"], "t", 86_400 * 7, 0, 20_040).select("event_id", F.col("match.event_id").alias("result"))


@query("""WITH a AS (SELECT t.event_id, t.t, p.event_id AS p, p.t AS pt FROM (SELECT * FROM ticks WHERE event_type = 'click') t JOIN (SELECT user_id, t, max(event_id) AS event_id FROM ticks WHERE event_type = 'view' GROUP BY ALL) p ON t.user_id = p.user_id AND abs(t.t - p.t) <= 3000)
    SELECT t.event_id, a.p AS point FROM (SELECT event_id FROM ticks WHERE event_type = 'click') t LEFT JOIN (SELECT event_id, arg_min(p, (abs(t - pt), pt)) AS p FROM a GROUP BY event_id) a ON t.event_id = a.event_id""")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = run_sql(spark, sf_dir, "SELECT user_id, event_id, t FROM ticks WHERE event_type = 'click'")
    points = run_sql(spark, sf_dir, "SELECT user_id, t, max(event_id) AS event_id FROM ticks WHERE event_type = 'view' GROUP BY user_id, t")
    return asof.nearest(targets, points, ["user_id"], "t", 86_400 * 7, 3000).select("event_id", F.col("match.event_id").alias("point"))


@query("""WITH a AS (SELECT l_orderkey AS case_id, l_linenumber AS frame_no, min(l_partkey) AS crc FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS case_id, l_linenumber AS frame_no, max(l_partkey) AS crc FROM lineitem WHERE l_linenumber < 7 GROUP BY ALL)
    SELECT coalesce(a.case_id, b.case_id) AS case_id, min(a.frame_no) FILTER (WHERE a.crc <> b.crc) AS first_mismatch, count(a.crc) AS n_a, count(b.crc) AS n_b, count(a.crc) <> count(b.crc) AS shorter_tail FROM a FULL JOIN b ON a.case_id = b.case_id AND a.frame_no = b.frame_no GROUP BY 1""")
def first_crc_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = run_sql(spark, sf_dir, "SELECT l_orderkey AS case_id, l_linenumber AS frame_no, min(l_partkey) AS crc FROM lineitem GROUP BY l_orderkey, l_linenumber")
    b = run_sql(spark, sf_dir, "SELECT l_orderkey AS case_id, l_linenumber AS frame_no, max(l_partkey) AS crc FROM lineitem WHERE l_linenumber < 7 GROUP BY l_orderkey, l_linenumber")
    return timeline.crc_compare(a, b)


@query("SELECT l_orderkey AS au_no, CASE WHEN bool_or(nal_type = 5) THEN 'idr' WHEN bool_or(nal_type = 7) AND bool_or(nal_type = 8) THEN 'recovery' END AS sync, bool_or(nal_type IN (14, 20)) AS has_dependent, bool_or(nal_type BETWEEN 1 AND 8) AS has_base FROM (SELECT l_orderkey, l_partkey % 40 AS nal_type FROM lineitem) x GROUP BY l_orderkey")
def au_sync_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.au_class(view(spark, sf_dir, "nals")).drop("stream_id")


@query("SELECT stream_id, count(*) FILTER (WHERE nal_type <= 31) AS vcl, count(*) FILTER (WHERE nal_type <= 31 AND layer_id > 0) AS dependent, round(count(*) FILTER (WHERE nal_type <= 31 AND layer_id > 0) / (count(*) FILTER (WHERE nal_type <= 31))::DOUBLE, 9) AS share FROM nals GROUP BY stream_id")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.layer_counts(view(spark, sf_dir, "nals")).withColumn("share", F.round("share", 9))


@query("SELECT session, seq, rx, frag_idx, frag_cnt FROM datagrams WHERE frag_cnt BETWEEN 1 AND 4096 AND frag_idx >= 0 AND frag_idx < frag_cnt")
def packet_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.valid_fragments(view(spark, sf_dir, "datagrams")).select("session", "seq", "rx", "frag_idx", "frag_cnt")


@query("SELECT seq, event_id FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type FROM events) x WHERE EXISTS (SELECT 1 FROM (SELECT user_id, max(event_type) AS m FROM events GROUP BY user_id) c WHERE c.user_id = x.user_id AND c.m = x.event_type)")
def session_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, "SELECT user_id, event_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS seq FROM events")
    current = run_sql(spark, sf_dir, "SELECT user_id, max(event_type) AS event_type FROM events GROUP BY user_id")
    return sessions.only_current(rows, current, ["user_id", "event_type"]).select("seq", "event_id")


@query("SELECT stream_id, seq, pts - first_value(pts) OVER (PARTITION BY stream_id ORDER BY seq) AS pts FROM base_aus")
def pts_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.pts_normalise(view(spark, sf_dir, "base_aus"))


@query("""WITH f AS (SELECT o_custkey AS stream_id, o_orderkey AS emit_no, o_orderkey * 37 % 1009 AS pts FROM orders), a AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY emit_no) AS k FROM f), b AS (SELECT stream_id, pts AS display_pts, row_number() OVER (PARTITION BY stream_id ORDER BY pts) AS k FROM f)
    SELECT a.emit_no, b.display_pts FROM a JOIN b ON a.stream_id = b.stream_id AND a.k = b.k""")
def display_order_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.assign_pts(run_sql(spark, sf_dir, "SELECT o_custkey AS stream_id, o_orderkey AS emit_no, o_orderkey * 37 % 1009 AS pts FROM orders")).select("emit_no", "display_pts")


@query("""WITH g AS (SELECT user_id AS stream_id, event_id AS gop_no, CASE WHEN user_id % 3 = 0 AND event_id % 100 < 50 THEN 2 ELSE 7 END AS off FROM events), d AS (SELECT stream_id, gop_no, 2.0 * off / 1920.0 AS disparity FROM g), l AS (SELECT *, lag(disparity) OVER (PARTITION BY stream_id ORDER BY gop_no) AS b FROM d)
    SELECT stream_id, gop_no, round(disparity::DOUBLE, 9) AS disparity FROM l WHERE disparity IS DISTINCT FROM b""")
def pg_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    gops = run_sql(spark, sf_dir, "SELECT user_id AS stream_id, event_id AS gop_no, event_id % 100 < 50 AS near FROM events")
    rows = gops.withColumn("sequences", F.array(F.array(F.lit(9), F.lit(7), F.lit(-1)), F.when(F.col("near"), F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(5), F.lit(7)))))
    seqs = run_sql(spark, sf_dir, "SELECT DISTINCT user_id AS stream_id, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 9 END AS seq_id FROM events")
    return timeline.pg_depth(rows, seqs).withColumn("disparity", F.round("disparity", 9))

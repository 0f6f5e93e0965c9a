"""The library's tables as views over the test tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .operators import scan

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def pick(expr: str, values: list) -> str:
    """One of the values by an integer expression."""
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE ({expr}) % {len(values)} " + " ".join(f"WHEN {k} THEN {text(v)}" for k, v in enumerate(values)) + " END"


TAGS = [
    "1", "2", "13", "14", "11", "4", "99", "side_by_side", "Side By Side (Right-Left)", "top-bottom", "bottom_top", "mono", "2d", "block_lr", "block_rl", "anaglyph cyan red", "frame_sequential",
    "row_interleaved", "tb", "sbsr", "left_right", "over-under", "", None, "packed right_first",
]
NAMES = [
    "film.fsbs.mkv", "Film.Full-SBS.mkv", "a_hsbs_b.mkv", "film.half ou.mkv", "film.3d.htab.mkv", "film_ou.mkv", "ordinary-film.mkv", "tablet.mkv", "x.sbs.mkv", "fou.mkv", "movie3d.ts", "housing.mkv", "a.tab.m2ts",
]
SECONDS = "CAST(year(ts) AS BIGINT) * 31622400 + CAST(dayofyear(ts) AS BIGINT) * 86400 + CAST(hour(ts) AS BIGINT) * 3600 + CAST(minute(ts) AS BIGINT) * 60 + CAST(floor(second(ts)) AS BIGINT)"
ITEM = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)"

VIEWS: dict[str, str] = {
    "segments": f"""SELECT l_orderkey % 100 AS disc_id, l_orderkey AS playlist, CAST({ITEM} AS BIGINT) AS item_no, lpad(CAST(l_partkey % 7 AS STRING), 5, '0') AS clip,
        CAST(0 AS BIGINT) AS in_45k, CAST(45000 * (1 + CAST(l_quantity AS BIGINT) % 3) AS BIGINT) AS out_45k FROM lineitem""",
    "clips": """SELECT lpad(CAST(p_partkey AS STRING), 5, '0') AS clip, CASE WHEN p_size % 2 = 0 THEN 'ssif' ELSE 'm2ts' END AS kind,
        concat('/BDMV/STREAM/', lpad(CAST(p_partkey AS STRING), 5, '0'), '.x') AS path, CAST(floor(p_retailprice * 100) AS BIGINT) AS size_bytes FROM part WHERE p_partkey > 0""",
    "both_clips": """SELECT clip, 'm2ts' AS kind, concat(path, '.m2ts') AS path, size_bytes FROM clips UNION ALL SELECT clip, kind, path, size_bytes FROM clips WHERE kind = 'ssif'""",
    "titles": f"""SELECT p_partkey AS title, {pick('p_partkey', TAGS)} AS stereo_tag, {pick('p_partkey', ['1', 'no', None, 'TRUE', 'off', 'maybe'])} AS inverted, {pick('p_size', ['auto', None, 'rl', 'left eye first', ''])} AS override,
        {pick('p_partkey', ['tag', 'side data'])} AS source, {pick('p_size', [1920, 3840, 1280, 2560, 1920])} AS width, {pick('p_partkey', [1080, 2205, 2160, 4320, 804, 1600])} AS height,
        {pick('p_partkey + p_size', ['h264', 'HEVC', 'mvc', '', None])} AS codec, concat('/movies/', {pick('p_partkey', NAMES)}) AS path,
        {pick('p_partkey', ['24000/1001', '25', '1/0', 'not-a-rate', '50/2', '0/5', None, '30000/1001'])} AS rate, {pick('p_size', ['bt709', '709', 'bt2020', 'unknown', None, 'film', '601'])} AS primaries,
        {pick('p_partkey', ['smpte2084', ' ARIB-STD-B67 ', 'bt709', '709', None, 'weird'])} AS transfer, {pick('p_partkey', ['bt2020nc', 'gbr', '601', 'reserved', None])} AS matrix,
        {pick('p_size', ['optical', 'mounted', 'fixed'])} AS drive_class, p_retailprice AS price, p_size AS size FROM part""",
    "tracks": f"""SELECT p_partkey AS track_id, p_partkey % 7 AS clip, CAST(4352 + p_size AS INT) AS pid, {pick('p_partkey', ['eng', ' fr ', None, '', 'xx', 'jpn'])} AS lang, {pick('p_size', ['truehd', 'ac3', 'dts', None, 'weird'])} AS codec,
        {pick('p_partkey', [None, 'Dolby TrueHD + Dolby Atmos', 'DTS-HD MA', 'unknown', ''])} AS codec_profile, {pick('p_size', [0, 1, 2, 6, 8, 4])} AS channels,
        {pick('p_partkey', ['TRACK_1', 'Commentary', None, 'track 12', ' '])} AS title, p_size % 5 = 0 AS forced, p_size % 3 = 0 AS is_default FROM part""",
    "pid_lang": """SELECT DISTINCT p_partkey % 7 AS clip, CAST(4352 + p_size AS INT) AS pid, CASE WHEN p_size % 2 = 0 THEN 'deu' ELSE 'spa' END AS lang FROM part WHERE p_size % 4 < 3""",
    "ticks": f"""SELECT event_id, user_id, event_type, value, {SECONDS} AS t FROM events""",
    "base_aus": "SELECT user_id AS stream_id, event_id AS seq, t AS pts FROM ticks WHERE event_type = 'view'",
    "dep_aus": "SELECT user_id AS stream_id, event_id AS seq, t AS pts FROM ticks WHERE event_type = 'click'",
    "frames": "SELECT user_id AS stream_id, event_id AS seq, t AS pts, value / 20 AS motion, value / 60 AS distance, event_type = 'error' AS depth_cut FROM ticks",
    "nals": "SELECT l_orderkey % 50 AS stream_id, l_orderkey AS au_no, CAST(l_partkey % 40 AS INT) AS nal_type, CAST(l_suppkey % 3 AS INT) AS layer_id FROM lineitem",
    "datagrams": f"""SELECT l_orderkey % 50 AS session, l_orderkey AS seq, CAST({ITEM} AS BIGINT) AS rx, CAST({ITEM} - 1 - CASE WHEN l_partkey % 31 = 0 THEN 1 ELSE 0 END AS INT) AS frag_idx,
        CAST(count(*) OVER (PARTITION BY l_orderkey) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INT) AS frag_cnt, concat('<', CAST(l_partkey AS STRING), '>') AS payload FROM lineitem""",
    "live_datagrams": "SELECT *, CAST(floor(seq / 50) AS BIGINT) * 6 + rx AS arrival FROM datagrams",
    "received": "SELECT user_id AS session, event_id % 3 AS peer, event_type = 'error' AS hello, event_id, t FROM ticks",
    "arrivals": "SELECT label AS stream_id, vec_id AS seq, vec_id + 40 * (vec_id % 7) AS pts, embedding FROM embeddings",
    "cues": """SELECT conv_id AS track_id, turn AS cue_id, CAST(turn AS DOUBLE) * 0.5 AS pts_s, role <> 'system' AND turn % 4 <> 2 AS is_show, length(text) % 5 AS image_hash FROM conversations""",
    "text_events": """SELECT concat(lang, '-', CAST(doc_id % 97 AS STRING)) AS track_id, doc_id AS pts, text, doc_id * 3 + copy AS seq, CAST(200 + CASE WHEN copy = 0 THEN doc_id % 4 + CASE WHEN doc_id % 13 = 0 THEN 60 ELSE 0 END ELSE 960 + doc_id % 3 END AS DOUBLE) AS centre_x,
        CAST(1920 AS DOUBLE) AS play_res_x FROM (SELECT *, 0 AS copy FROM documents UNION ALL SELECT *, 1 AS copy FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT *, 2 AS copy FROM documents WHERE doc_id % 11 = 0) d""",
    "manifest": """SELECT DISTINCT source AS pack, concat(source, '-', CAST(doc_id AS STRING)) AS name, n_chars AS bytes FROM documents""",
    "inventory": """SELECT concat(source, '-', CAST(d.doc_id AS STRING)) AS name, CASE WHEN quality = 1 THEN n_chars ELSE n_chars + 1 END AS bytes FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "samples": "SELECT user_id AS session, event_type AS name, event_id AS seq, t, value FROM ticks",
    "memory": f"""SELECT 'store' AS store, concat('D:/Films/', CAST(o_custkey AS STRING)) AS media_path, CAST(o_custkey AS STRING) AS media_key, CAST(o_orderkey AS BIGINT) AS updated,
        {pick('o_orderkey', ['resume', 'audio', 'subs'])} AS field, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS value FROM orders""",
}


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql)]


def with_views(sql: str) -> str:
    """``sql`` behind the definitions of the views that it names, directly or through others."""
    order: list[str] = []

    def visit(text: str) -> None:
        for v in _needs(text):
            visit(VIEWS[v])
            if v not in order:
                order.append(v)

    visit(sql)
    heads = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    body = sql.strip()
    if not heads:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    return f"WITH {heads}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {heads} {body}"


def view(spark: SparkSession, sf_dir: str, name: str, dealt: dict[str, str] | None = None) -> DataFrame:
    """A view as a DataFrame; only the columns that a query uses are read."""
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}", dealt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, dealt: dict[str, str] | None = None) -> DataFrame:
    """``dealt`` names the key by which a base table's rows are dealt beforehand, to as many tasks as they need: windows by that key then sort a bounded number of rows."""
    full = with_views(sql)
    used = [b for b in BASE if re.search(rf"\b(?:FROM|JOIN)\s+{b}\b", full)]
    marked = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", r"\1 {\2}", full) if used else full
    tables = {b: table(spark, sf_dir, b) for b in used}
    return spark.sql(marked, **{b: scan.dealt(t, [dealt[b]]) if b in (dealt or {}) else t for b, t in tables.items()})

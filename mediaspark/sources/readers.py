"""Sources and sinks: probe documents, disc files, datagrams, status logs, manifests, reports."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import telemetry

PROBE = (
    "streams ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, profile: STRING, width: INT, height: INT, avg_frame_rate: STRING, r_frame_rate: STRING, stereo_mode: STRING, "
    "duration: STRING, tags: MAP<STRING, STRING>, disposition: MAP<STRING, INT>, side_data_list: ARRAY<STRUCT<side_data_type: STRING, type: STRING, inverted: STRING>>>>, format STRUCT<duration: STRING>"
)
MANIFEST = "packs MAP<STRING, STRUCT<label: STRING, bytes: BIGINT, files: ARRAY<STRUCT<path: STRING, name: STRING, bytes: BIGINT, sha256: STRING>>>>"
# The datagram header, big-endian: magic, version, type, flags, seq, pts, fragment index and count, length.
VERSION, HEADER, CONTROL_TYPE = 1, 27, 5
# The playlist header, big-endian: where the offset of the play items and the length of the application block
# stand, that block's start, the place of its flags, the bit for a right base eye, and the least length that has flags.
ITEMS_AT, APP_AT, FLAGS_AT, RIGHT_BIT, LEAST_APP = 8, 40, 56, 0x10, 13


def probe_rows(docs: DataFrame, json: str = "json") -> DataFrame:
    """One row per stream of each probe document; a document that can't be parsed keeps one row with ``error``."""
    parsed = docs.withColumn("_p", F.from_json(json, PROBE, {"mode": "PERMISSIVE"}))
    bad = F.col("_p").isNull() | F.col("_p.streams").isNull()
    rows = parsed.select("file", bad.alias("error"), F.col("_p.format.duration").alias("format_duration"), F.posexplode_outer("_p.streams").alias("stream_index", "s"))
    return rows.select("file", "error", "format_duration", "stream_index", "s.*")


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    return probe_rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json")))


def _items(data: bytes) -> list[tuple[int, str, int, int]]:
    """Play items of a playlist file: (number, clip, in, out), without those that don't advance."""
    if data[:4] != b"MPLS":
        return []
    at = struct.unpack_from(">I", data, 8)[0]
    n = struct.unpack_from(">H", data, at + 6)[0]
    at += 10
    out = []
    for k in range(n):
        size = struct.unpack_from(">H", data, at)[0]
        clip = data[at + 2 : at + 7].decode("ascii", "replace")
        begin, end = struct.unpack_from(">II", data, at + 14)
        if end > begin:
            out.append((k, clip, begin, end))
        at += 2 + size
    return out


def play_items(data: bytes) -> list[tuple[int, str, int, int]]:
    """``_items``, of a malformed file none."""
    try:
        return _items(data)
    except (struct.error, IndexError):
        return []


def _uint(data: Column, start: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, start, size)), 16, 10).cast("bigint")


def playlist_eye(content: Column) -> Column:
    """Which eye a playlist's header says that the base view is: left_first, right_first, or unknown.

    Unknown where the file is no playlist or null, is cut off before the flags, or its application block does not reach
    them; flags inside the play items are none.
    """
    size, app = F.octet_length(content), _uint(content, APP_AT + 1, 4)
    flags = (size > FLAGS_AT) & (app >= LEAST_APP) & (app + APP_AT + 4 > FLAGS_AT) & (_uint(content, ITEMS_AT + 1, 4) > FLAGS_AT)
    known = (F.substring(content, 1, 4) == F.lit(b"MPLS")) & flags
    right = _uint(content, FLAGS_AT + 1, 1).bitwiseAND(RIGHT_BIT) != 0
    return F.when(F.coalesce(known, F.lit(False)), F.when(right, "right_first").otherwise("left_first")).otherwise("unknown")


def _playlists(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{mpls,MPLS}").load(root).select("path", "content")


def read_eyes(spark: SparkSession, root: str) -> DataFrame:
    """(disc_id, playlist, eye_order) of all playlist files of the discs below ``root`` that are not empty."""
    disc = F.regexp_extract("path", r"([^/]+)/BDMV/", 1)
    return _playlists(spark, root).select(disc.alias("disc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("playlist"), playlist_eye(F.col("content")).alias("eye_order"))


def playlist_items(files: DataFrame) -> DataFrame:
    """(path, item_no, clip, in_45k, out_45k) of playlist files (path, content); a malformed one gives no rows."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows += [(path, *r) for r in play_items(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "item_no", "clip", "in_45k", "out_45k"])

    return files.mapInPandas(parse, "path string, item_no int, clip string, in_45k bigint, out_45k bigint")


def read_discs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(segments, clips) of all discs below ``root``: playlist items, and the files of clips with their sizes.

    Clip files are listed only, never read.
    """
    disc = F.regexp_extract("path", r"([^/]+)/BDMV/", 1)
    segments = playlist_items(_playlists(spark, root)).select(disc.alias("disc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("playlist"), "item_no", "clip", "in_45k", "out_45k")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{m2ts,ssif,M2TS,SSIF}").load(root)
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    clips = files.select(disc.alias("disc_id"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), name.alias("clip"), "path", F.col("length").alias("size_bytes"))
    return segments, clips


def read_datagrams(df: DataFrame, magic: str, col: str = "datagram") -> DataFrame:
    """``df`` with the decoded header, payload, parsed control text and ``reject``, the reason why a datagram is bad.

    ``magic`` is the four letters that a sender's datagrams begin with.
    """
    d = F.col(col)
    size = F.octet_length(d)
    length = _uint(d, 24, 4)
    reject = F.when(d.isNull() | (size < HEADER), "truncated header").when(F.substring(d, 1, 4) != F.lit(magic.encode()), "bad magic").when(_uint(d, 5, 1) != VERSION, "unsupported version").when(size - HEADER != length, "truncated payload")
    out = df.withColumn("reject", reject)
    fields = {
        "type": _uint(d, 6, 1).cast("int"), "flags": _uint(d, 7, 1).cast("int"), "seq": _uint(d, 8, 4), "pts_ms": F.conv(F.hex(F.substring(d, 12, 8)), 16, -10).cast("bigint"),
        "frag_idx": _uint(d, 20, 2).cast("int"), "frag_cnt": _uint(d, 22, 2).cast("int"), "payload": F.substring(d, HEADER + 1, 2**31 - 1 - HEADER),
    }
    good = F.col("reject").isNull()
    out = out.withColumns({k: F.when(good, c) for k, c in fields.items()})
    control = F.from_json(F.decode("payload", "UTF-8"), "MAP<STRING, STRING>")
    return out.withColumn("control", F.when(F.col("type") == CONTROL_TYPE, control))


def read_status_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.input_file_name().alias("session"), telemetry.parse_status(F.col("value")).alias("m"))


def manifest_rows(docs: DataFrame, json: str = "json") -> DataFrame:
    """One row per file of each pack."""
    packs = docs.select(F.explode(F.from_json(json, MANIFEST)["packs"]).alias("pack", "p"))
    return packs.select("pack", F.col("p.label").alias("label"), F.explode("p.files").alias("f")).select("pack", "label", "f.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return manifest_rows(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def write_report(df: DataFrame, path: str, fmt: str = "json", partition_by: list[str] | None = None) -> None:
    """Write metric rows as JSON lines or Parquet, partitioned for large tables."""
    writer = df.write.mode("overwrite").partitionBy(*(partition_by or []))
    writer.json(path) if fmt == "json" else writer.parquet(path)


def report_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("line"))


def block_sha256(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``sha256`` of each file's content, for files under the 2 GB limit of a cell."""
    return files.withColumn("sha256", F.sha2(content, 256))


def chunk_sha256(chunks: DataFrame, by: list[str], at: str = "at", content: str = "content") -> DataFrame:
    """Per file of any size ``n_chunks`` and ``sha256`` of the lowercase hex digests of its chunks, joined in order of ``at``.

    Chunks (as the format ``byte_ranges`` gives them) are digested where they are read; only digests are shuffled. A file's
    digest depends on the size of its chunks, not on the ranges in which they are read. A null chunk counts as an empty one.
    """
    digests = chunks.select(*by, F.struct(F.col(at).alias("at"), F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256).alias("digest")).alias("_d"))
    out = digests.groupBy(*by).agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_list("_d")).alias("_d"))
    return out.select(*by, "n_chunks", F.sha2(F.array_join("_d.digest", ""), 256).alias("sha256"))


def frame_crc(*planes: Column) -> Column:
    """CRC-32 of the concatenated planes."""
    return F.crc32(F.concat(*planes))

"""Rates, durations, colours, labels and readable sizes, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Authored frame rates in the order in which they are tried.
STANDARD_FPS = [23.976, 24.0, 25.0, 29.97, 30.0, 48.0, 50.0, 59.94, 60.0]
# Colour tokens that an encoder takes, and aliases of them.
PRIMARIES = ["bt709", "bt470m", "bt470bg", "smpte170m", "smpte240m", "film", "bt2020", "smpte428", "smpte431", "smpte432"]
TRANSFERS = [
    "bt709", "bt470m", "bt470bg", "smpte170m", "smpte240m", "linear", "log100", "log316", "iec61966-2-4", "bt1361e", "iec61966-2-1", "bt2020-10", "bt2020-12",
    "smpte2084", "smpte428", "arib-std-b67",
]
MATRICES = ["gbr", "bt709", "fcc", "bt470bg", "smpte170m", "smpte240m", "ycgco", "bt2020nc", "bt2020c", "smpte2085", "chroma-derived-nc", "chroma-derived-c", "ictcp"]
COLOUR_ALIASES = {"709": "bt709", "601": "smpte170m", "bt601": "smpte170m"}
HDR = ["smpte2084", "arib-std-b67"]
# Names of languages, codecs and channel counts in labels.
LANGUAGES = {
    "en": "English", "eng": "English", "fr": "French", "fre": "French", "fra": "French", "de": "German", "ger": "German", "deu": "German", "es": "Spanish", "spa": "Spanish",
    "it": "Italian", "ita": "Italian", "ja": "Japanese", "jpn": "Japanese",
}
CODECS = {"truehd": "TrueHD", "ac3": "AC3", "eac3": "E-AC3", "dts": "DTS", "aac": "AAC", "flac": "FLAC", "hdmv_pgs_subtitle": "PGS", "subrip": "SRT", "ass": "ASS", "dvd_subtitle": "VobSub", "dvdsub": "VobSub", "mov_text": "TX3G"}
CHANNELS = {1: "Mono", 2: "Stereo", 3: "2.1", 6: "5.1", 7: "6.1", 8: "7.1"}
H264_EXTENSIONS = ["ssif", "m2ts", "ts", "mkv", "mk3d"]


def _lookup(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def fps_ratio(c: Column) -> Column:
    """A rate given as "n/d" or a number; null for junk and for a denominator that is not positive."""
    parts = F.split(c, "/")
    n, d = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    return F.when(F.size(parts) == 1, n).when((F.size(parts) == 2) & (d > 0), n / d)


def effective_fps(*candidates: Column) -> Column:
    """The first positive candidate or 24; under 20 it is 23.976; within 12 to 120."""
    first = F.coalesce(*[F.when(c > 1e-3, c) for c in candidates], F.lit(24.0))
    return F.greatest(F.lit(12.0), F.least(F.lit(120.0), F.when(first < 20.0, 23.976).otherwise(first)))


def fps_snap(c: Column) -> Column:
    """The first standard rate within 2 %; other rates stay, those that are not positive and finite are null."""
    v = c.cast("double")
    snapped = reduce(lambda e, s: e.when(F.abs(v - s) <= 0.02 * s, s), STANDARD_FPS, F.when(F.lit(False), 0.0))
    return F.when((v > 0) & (v < float("inf")) & ~F.isnan(v), snapped.otherwise(v))


def colour_policy(df: DataFrame, primaries: str = "primaries", transfer: str = "transfer", matrix: str = "matrix") -> DataFrame:
    """Adds out_primaries, out_transfer, out_matrix (unknown tokens become bt709) and hdr, by the raw transfer."""

    def mapped(name: str, allowed: list[str]) -> Column:
        c = F.coalesce(_lookup(F.col(name), COLOUR_ALIASES), F.col(name))
        return F.when(c.isin(allowed), c).otherwise("bt709")

    hdr = F.coalesce(F.lower(F.trim(transfer)).isin(HDR), F.lit(False))
    return df.withColumns({"out_primaries": mapped(primaries, PRIMARIES), "out_transfer": mapped(transfer, TRANSFERS), "out_matrix": mapped(matrix, MATRICES), "hdr": hdr})


def preview_route(df: DataFrame, path: str = "path", codec: str = "codec", drive: str = "drive_class") -> DataFrame:
    """Adds preview (off, h264, avcodec) and paced. ``drive`` is optical, mounted or another class; codec beats extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    codec_name = F.lower(F.coalesce(F.col(codec), F.lit("")))
    h264 = F.when(codec_name == "hevc", False).when(codec_name == "h264", True).otherwise(ext.isin(H264_EXTENSIONS))
    none = F.coalesce(F.col(path), F.lit("")) == ""
    return df.withColumns(
        {
            "preview": F.when(none | (F.col(drive) == "optical"), "off").when(h264, "h264").otherwise("avcodec"),
            "paced": ~none & F.col(drive).isin("optical", "mounted"),
        }
    )


def resume_filter(df: DataFrame, mode: str = "save", pos: str = "pos", duration: str = "duration") -> DataFrame:
    """Positions worth saving (30 s on, up to 93 %, bounds included) or worth restoring (bounds excluded)."""
    p, d = F.col(pos), F.coalesce(F.col(duration), F.lit(0.0))
    return df.filter((p >= 30) & ((d <= 0) | (p <= 0.93 * d)) if mode == "save" else (p > 30) & ((d <= 0) | (p < 0.93 * d)))


def track_label(df: DataFrame, kind: str = "audio") -> Column:
    """Language, codec, channels and title of a track with what is known, or its kind and number; then its flag."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    lang, codec, profile, title = (text(c) for c in ("lang", "codec", "codec_profile", "title"))
    language = F.when(lang != "", F.coalesce(_lookup(F.lower(lang), LANGUAGES), F.upper(lang)))
    base = F.when(codec != "", F.coalesce(_lookup(F.lower(codec), CODECS), F.upper(codec))).otherwise("")
    named = F.when(F.lower(profile).startswith("dts"), profile).otherwise(base)
    atmos = F.lower(profile).contains("atmos") & ~F.lower(named).contains("atmos")
    coded = F.when(F.lower(profile).isin("", "unknown", "none"), base).otherwise(F.when(atmos, F.concat(named, F.lit(" Atmos"))).otherwise(named))
    channels = F.when(F.col("channels") > 0, F.coalesce(_lookup(F.col("channels"), CHANNELS), F.concat(F.col("channels").cast("string"), F.lit(".0")))) if kind == "audio" else F.lit(None)
    kept = F.when((title != "") & ~title.rlike(r"(?i)^track[\s_]*\d+$"), F.concat(F.lit("“"), title, F.lit("”")))
    parts = F.concat_ws(" · ", language, F.nullif(coded, F.lit("")), channels, kept)
    label = F.when(parts == "", F.concat(F.lit("Audio " if kind == "audio" else "Subtitle "), F.col("track_id").cast("string"))).otherwise(parts)
    return F.concat_ws(" · ", label, F.when(F.col("forced"), "(forced)").when(F.col("is_default"), "(default)"))


def duration_any(*fields: Column) -> Column:
    """The first positive duration among seconds or H:M:S texts; 0 without one."""

    def one(c: Column) -> Column:
        parts = F.split(F.trim(c), ":")
        h, m, s = (F.get(parts, k).try_cast("double") for k in range(3))
        return F.coalesce(F.trim(c).try_cast("double"), F.when(F.size(parts) == 3, h * 3600 + m * 60 + s))

    return F.coalesce(*[F.when(one(c) > 0, one(c)) for c in fields], F.lit(0.0))


def positive_int(*fields: Column) -> Column:
    """The first field that is a positive integer; 0 without one."""
    ints = [F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("bigint")) for c in fields]
    return F.coalesce(*[F.when(i > 0, i) for i in ints], F.lit(0))


def _two_decimals(x: Column) -> Column:
    """A value of 1 or more by its binary digits, halves to even, as C and Python write it; Java rounds halves up.

    A double of 1 or more has at most 52 binary places, so its places times 2^52 are a whole number.
    """
    whole = F.floor(x).try_cast("bigint")
    times_100 = ((x - F.floor(x)) * 2.0**52).try_cast("bigint") * 100
    cut, rest = F.shiftright(times_100, 52), times_100.bitwiseAND(F.lit(2**52 - 1))
    up = (rest > 2**51) | ((rest == 2**51) & (cut % 2 == 1))
    hundredths = cut + up.cast("bigint")
    exact = F.format_string("%d.%02d", whole + F.floor(hundredths / 100).cast("bigint"), hundredths % 100)
    return F.when(x < 2.0**52, exact).otherwise(F.format_string("%.2f", x))


def human_size(n: Column) -> Column:
    """Binary units with two decimals, halves to even; a dash for null and negative sizes."""
    scaled = F.when(n < 1024, F.concat(F.format_string("%.0f", F.rint(n.cast("double"))), F.lit(" B")))
    for k, unit in enumerate(["KiB", "MiB", "GiB"], 1):
        scaled = scaled.when(n < 1024.0 ** (k + 1), F.concat(_two_decimals(n / 1024.0**k), F.lit(f" {unit}")))
    return F.when(n.isNull() | (n < 0), "—").otherwise(scaled.otherwise(F.concat(_two_decimals(n / 1024.0**4), F.lit(" TiB"))))


def human_rate(n: Column) -> Column:
    return F.when(n.isNull() | (n <= 0), "—").otherwise(F.concat(human_size(n), F.lit("/s")))


def human_time(seconds: Column) -> Column:
    """h:mm:ss, or mm:ss under an hour; a dash for null, negative and NaN."""
    s = F.floor(seconds).cast("bigint")
    h, m = F.floor(s / 3600).cast("bigint"), (F.floor(s / 60) % 60).cast("bigint")
    text = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (seconds < 0), "—").otherwise(text)


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(c, r"</?[a-zA-Z][^>{}]*>|\{\\[^}]*\}", "")


def dedup_lines(lines: Column) -> Column:
    """The first half of a list of lines that is exactly doubled; other lists as they are."""
    half = F.floor(F.size(lines) / 2).cast("int")
    doubled = (F.size(lines) >= 2) & (F.size(lines) % 2 == 0) & (F.slice(lines, F.lit(1), half) == F.slice(lines, half + 1, half))
    return F.when(doubled, F.slice(lines, F.lit(1), half)).otherwise(lines)


def ass_fields(payload: Column, style_l: Column, style_r: Column, play_res_x: Column) -> Column:
    """Struct (style, text, centre_x) of an event: by its position mark, else between its margins, 0 being the style's."""
    f = F.split(payload, ",", 9)
    own = lambda k: F.coalesce(F.get(f, k).try_cast("int"), F.lit(0))
    left, right = F.when(own(4) > 0, own(4)).otherwise(style_l), F.when(own(5) > 0, own(5)).otherwise(style_r)
    pos = F.regexp_extract(F.get(f, 8), r"\\pos\(\s*(-?[0-9.]+)", 1).try_cast("double")
    whole = F.struct(F.trim(F.get(f, 2)).alias("style"), F.get(f, 8).alias("text"), F.coalesce(pos, (left + play_res_x - right) / 2.0).alias("centre_x"))
    return F.when(F.size(f) == 9, whole)


def nal_bits(b0: Column, b1: Column, codec: str = "hevc") -> Column:
    """Struct (nal_type, layer_id) of the first header bytes."""
    if codec == "hevc":
        layer = F.shiftleft(b0.bitwiseAND(F.lit(1)), 5).bitwiseOR(F.shiftright(b1, 3))
        return F.struct(F.shiftright(b0, 1).bitwiseAND(F.lit(63)).alias("nal_type"), layer.alias("layer_id"))
    return F.struct(b0.bitwiseAND(F.lit(31)).alias("nal_type"), F.lit(0).alias("layer_id"))


def ts_convert(ticks: Column, clock: str) -> Column:
    """Ticks of a clock to whole milliseconds, rounding down, or 45 kHz ticks to seconds."""
    return {"90k_ms": F.floor(ticks / 90).cast("bigint"), "45k_ms": F.floor(ticks / 45).cast("bigint"), "45k_s": ticks / 45000.0}[clock]


def media_key(df: DataFrame, mounts: DataFrame, path: str = "media_path") -> DataFrame:
    """Adds media_key: the image of a path on a mounted drive, else the path with plain separators and in lower case."""
    letter = F.upper(F.regexp_extract(path, r"^([A-Za-z]):", 1))
    known = mounts.select(F.upper(F.substring("letter", 1, 1)).alias("_letter"), F.col("image_path").alias("_image"))
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/+", "/"))
    return df.withColumn("_letter", letter).join(known, "_letter", "left").withColumn("media_key", plain(F.coalesce("_image", path))).drop("_letter", "_image")

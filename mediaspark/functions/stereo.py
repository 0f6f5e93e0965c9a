"""Stereo layout, eye order and packing of titles, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT, UNKNOWN = "left_first", "right_first", "unknown"

# The numeric stereo codes of the container format.
CODES = {
    0: (None, UNKNOWN), 1: ("sbs", LEFT), 2: ("tab", RIGHT), 3: ("tab", LEFT), 4: (None, RIGHT), 5: (None, LEFT), 6: (None, RIGHT), 7: (None, LEFT),
    8: (None, RIGHT), 9: (None, LEFT), 10: ("anaglyph", UNKNOWN), 11: ("sbs", RIGHT), 12: ("anaglyph", UNKNOWN), 13: ("mvc", LEFT), 14: ("mvc", RIGHT),
}
# Keywords of a tag, contained anywhere, the first list that fits wins.
KEYWORDS = {
    "anaglyph": ["anaglyph", "cyan", "magenta", "red_cyan", "cyan_red"],
    "mvc": ["frame_altern", "framealternate", "frame_packing", "frame_sequential", "frame_packed", "view_packed", "mvc", "framepacking", "frameinterleaved", "block_lr", "block_rl", "both_eyes_laced", "packed"],
    "tab": ["top_bottom", "bottom_top", "tab", "over_under", "under_over", "block_tb", "block_bt", "topbottom", "tbr", "tbl"],
    "sbs": ["side_by_side", "sbs", "left_right", "right_left", "sbsl", "sbsr"],
}
# Marks of the eye order, keywords of the wider reading, aliases and flags.
RIGHT_MARKS = ["right_left", "right_eye_first", "right_first", "block_rl", "bottom_top", "under_over", "block_bt", "sbsr", "tbr"]
LEFT_MARKS = ["left_right", "left_eye_first", "left_first", "block_lr", "top_bottom", "over_under", "block_tb", "sbsl", "tbl"]
WIDE_NONE = ["mono", "left", "right", "both", "2d"]
WIDE_TAB, WIDE_SBS = ["bt", "tb"], ["row_interleaved", "column_interleaved"]
ALIASES = {
    LEFT: LEFT, "left": LEFT, "left_eye_first": LEFT, "lr": LEFT, "l_r": LEFT, RIGHT: RIGHT, "right": RIGHT, "right_eye_first": RIGHT, "rl": RIGHT, "r_l": RIGHT,
    UNKNOWN: UNKNOWN, "auto": UNKNOWN, "": UNKNOWN,
}
TRUE, FALSE = ["1", "true", "yes", "on"], ["0", "false", "no", "off"]


def _any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")


def _lookup(key: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def stereo_layout(c: Column) -> Column:
    """Struct (layout, eye_order) of a stereo tag; a null layout is not a routable one."""
    code = F.trim(c).try_cast("int")
    known = code.between(0, 14)
    mode = _plain(c)
    layout = reduce(lambda e, kv: e.when(_any(mode, kv[1]), kv[0]), KEYWORDS.items(), F.when(known, _lookup(code, {k: v[0] for k, v in CODES.items() if v[0]})))
    by_name = F.when(_any(mode, KEYWORDS["anaglyph"]) | layout.isNull(), UNKNOWN).when(_any(mode, RIGHT_MARKS), RIGHT).when(_any(mode, LEFT_MARKS), LEFT).otherwise(UNKNOWN)
    order = F.when(c.isNull(), UNKNOWN).when(known, _lookup(code, {k: v[1] for k, v in CODES.items()})).otherwise(by_name)
    return F.struct(layout.alias("layout"), order.alias("eye_order"))


def stereo_layout_wide(c: Column) -> Column:
    """The looser layout of probe fields: also bt, tb and interleaved rows or columns; mono and 2d are null."""
    mode = _plain(c)
    wide = F.when(mode.isin(WIDE_NONE), None).when(_any(mode, WIDE_TAB), "tab").when(_any(mode, WIDE_SBS), "sbs")
    return F.coalesce(stereo_layout(c)["layout"], wide)


def eye_order_norm(c: Column, default: str = UNKNOWN) -> Column:
    """The canonical order of an alias; an unknown text is ``default``, never a guess."""
    return F.coalesce(_lookup(_plain(F.coalesce(c, F.lit(""))), ALIASES), F.lit(default))


def tri_state(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin(TRUE), True).when(text.isin(FALSE), False)


def resolve_eye_order(df: DataFrame, tag: str = "stereo_tag", inverted: str = "inverted", override: str = "override", source: str = "source") -> DataFrame:
    """``eye_order`` and ``eye_order_source``: a user's override, else an explicit inverted flag of a packed title, else the tag."""
    of_tag = stereo_layout(F.col(tag))
    flag = tri_state(F.col(inverted))
    detected = F.when(flag.isNotNull() & of_tag["layout"].isin("sbs", "tab"), F.when(flag, RIGHT).otherwise(LEFT)).otherwise(of_tag["eye_order"])
    chosen = eye_order_norm(F.col(override))
    forced = chosen != UNKNOWN
    return df.withColumns({"eye_order": F.when(forced, chosen).otherwise(detected), "eye_order_source": F.when(forced, "user override").when(detected != UNKNOWN, F.col(source)).otherwise("not signalled")})


def view_swap(order: Column, *flags: Column) -> Column:
    """Whether the two views must be swapped: right first, changed by each set flag."""
    return reduce(lambda a, f: a != F.coalesce(f, F.lit(False)), flags, eye_order_norm(order) == RIGHT)


def is_framepacked(width: Column, height: Column, codec: Column) -> Column:
    """Frame-packed by size, for H.264, MVC or an unknown codec only."""
    sized = ((width == 1920) & height.isin(2205, 2160)) | ((width == 3840) & (height == 4320))
    return F.coalesce(sized & F.lower(F.coalesce(codec, F.lit(""))).isin("h264", "mvc", ""), F.lit(False))


def filename_hint(path: Column) -> Column:
    """The weak hint of a file name after a failed probe; substrings match on purpose."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    return F.when(name.contains("tab"), "tab").when(name.contains("sbs") | name.contains("3d"), "sbs")


def _token(*words: str) -> str:
    return "|".join(f"(?<![A-Za-z0-9]){w}(?![A-Za-z0-9])" for w in words)


# Name tokens in order of priority: pattern, mode, half.
TOKENS = [
    (_token("fsbs") + "|full[ ._-]?sbs", "sbs", False),
    (_token("ftab", "fou") + "|full[ ._-]?(tab|ou)", "tab", False),
    (_token("hsbs") + "|half[ ._-]?sbs", "sbs", True),
    (_token("htab", "hou") + "|half[ ._-]?(tab|ou)", "tab", True),
    (_token("sbs"), "sbs", False),
    (_token("tab", "ou"), "tab", False),
]


def filename_tokens(path: Column) -> Column:
    """Struct (mode, half) of the first token in a file name; an underscore separates words."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    hit = reduce(lambda e, t: e.when(name.rlike(t[0]), F.struct(F.lit(t[1]).alias("mode"), F.lit(t[2]).alias("half"))), TOKENS, F.when(F.lit(False), F.struct(F.lit("").alias("mode"), F.lit(False).alias("half"))))
    return F.struct(hit["mode"].alias("mode"), F.coalesce(hit["half"], F.lit(False)).alias("half"))


def half_packed(mode: Column, width: Column, height: Column, rule: str = "ratio") -> Column:
    """Whether each eye is squeezed into half the frame, by the frame's ratio or by its absolute size."""
    if rule == "ratio":
        r = width / F.greatest(F.lit(1), height)
        return F.when(mode == "sbs", r < 2.5).when(mode == "tab", r > 1.2)
    return F.coalesce(((mode == "sbs") & (width > 0) & (width < 2560)) | ((mode == "tab") & (height > 0) & (height < 1600)), F.lit(False))

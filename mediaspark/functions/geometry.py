"""Display geometry, depth offsets and tone, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EYE_WIDTH_PX, PATCH = 1920.0, 14


def offset_px(b: Column) -> Column:
    """A sign-magnitude byte as signed pixels."""
    size = b.bitwiseAND(F.lit(127))
    return F.when(b.bitwiseAND(F.lit(128)) != 0, -size).otherwise(size)


def px_to_disparity(px: Column) -> Column:
    return 2.0 * px / EYE_WIDTH_PX


def _metres(px: Column, screen_m: float, pixels: int) -> Column:
    return px * (screen_m / pixels)


def vac(px: Column, screen_m: float = 1.0, pixels: int = 1920, ipd_m: float = 0.063, distance_m: float = 2.0) -> Column:
    """Conflict of vergence and accommodation in dioptres of a disparity on the screen."""
    return _metres(px, screen_m, pixels) / (ipd_m * distance_m)


def angular_disparity(px: Column, screen_m: float = 1.0, pixels: int = 1920, distance_m: float = 2.0) -> Column:
    return F.degrees(2.0 * F.atan2(_metres(px, screen_m, pixels), F.lit(2.0 * distance_m)))


def soft_knee(px: Column, soft: float, hard: float) -> Column:
    """Sizes over ``soft`` are bent towards ``hard``, which they never reach."""
    over = F.greatest(F.lit(0.0), F.abs(px) - soft)
    return F.signum(px) * F.when(F.abs(px) <= soft, F.abs(px)).otherwise(soft + over / (1.0 + over / (hard - soft)))


def tone_map(v: Column, lo: Column, hi: Column, curve: float = 0.12, contrast: float = 0.82) -> Column:
    """Position between lo and hi, through a slight S-curve, with headroom at both ends."""
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    t = unit((v - lo) / (hi - lo))
    bent = t + curve * (t * t * (3.0 - 2.0 * t) - t)
    return unit(0.5 + contrast * (bent - 0.5))


def patch_height(width: Column, ratio: Column) -> Column:
    """The height of a ratio in whole patches, rounded half up, at least one."""
    return F.greatest(F.lit(1), F.floor(width / ratio / PATCH + 0.5)).cast("bigint") * PATCH

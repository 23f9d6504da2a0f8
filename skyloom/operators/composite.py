"""Composite recipes over wide rows: each returns image rows with r, g, b in 0..255.

RECIPES names each recipe's bands, which is what the scan is pruned to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import pixelwise as P
from ..sources import store
from . import algebra, enhance, palette
from .align import KEYS

#: Per recipe, for red, green and blue, the expression and its display range.
DIFFERENCES = {
    "ash": ((11, 13, 14, 15), ("C15-C13", -6.7, 2.6), ("C14-C11", -6.0, 6.3), ("C13", 243.6, 302.4)),
    "severestorm": ((2, 5, 7, 8, 10, 13), ("C08-C10", -35.0, 5.0), ("C07-C13", -5.0, 60.0), ("C05-C02", -0.75, 0.25)),
    "airmass": ((8, 10, 12, 13), ("C08-C10", -26.2, 0.6), ("C12-C13", -43.2, 6.7), ("273.15-C08", 29.25, 64.65)),
    "so2": ((9, 10, 11, 13), ("C09-C10", -4.0, 2.0), ("C13-C11", -4.0, 5.0), ("C13", 233.0, 300.0)),
}
LIGHT_WIDTHS = (2500, 5424, 8987)  # fixed values: raster widths that there is a picture of night lights for
NIGHT_SHARE = 0.1  # percent of night pixels from which the night side is blended in
#: Sines of the elevations at which night and twilight end.
NIGHT_END, TWILIGHT_END = 0.08715574274765817, 0.25881904510252074


def quantised(wide: DataFrame, channels: list[tuple[Column, float, float]], gammas: tuple[float, float, float] = (1.0, 1.0, 1.0), keep: tuple[str, ...] = ()) -> DataFrame:
    """Image rows of three (column, low, high) with the columns of ``keep``; a gamma other than 1 is
    applied within the range first."""
    out = {}
    for name, (v, low, high), g in zip("rgb", channels, gammas, strict=True):
        if abs(g - 1) >= 1e-6 and g > 0:
            v, low, high = P.gamma(v, g, F.lit(low), F.lit(high)), 0.0, 1.0
        out[name] = P.quantise_channel(v, low, high)
    return wide.select(*KEYS, *keep, *[out[c].alias(c) for c in "rgb"])


def difference(name: str, wide: DataFrame, **options) -> DataFrame:
    _, *parts = DIFFERENCES[name]
    return quantised(wide, [(algebra.parse(text).column(), low, high) for text, low, high in parts], **options)


def custom(wide: DataFrame, text: str, ranges: list[tuple[float, float]] | None = None, **options) -> DataFrame:
    """Three expressions joined by semicolons; a range left out is 0 to 255."""
    ranges = [*(ranges or []), *[(0.0, 255.0)] * 3][:3]
    return quantised(wide, [(e.column(), *r) for e, r in zip(algebra.parse_rgb(text), ranges, strict=True)], **options)


def truecolor(wide: DataFrame, rayleigh: bool = False, sharpen: bool = False, stretch: bool = False, correct: Callable[[DataFrame], DataFrame] | None = None, light: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """Blue C01, red C02, near infrared C03 and a green made of them.

    rayleigh needs sza, vza and raa on the rows: the bands are normalised by the sun, then blue and
    red corrected analytically, or by ``correct`` (a function on rows with b, r, n).  ``light`` does both
    steps, as ``atlas.daylight`` by stored geometry.
    """
    df = wide.withColumns({"b": F.col("c01"), "r": F.col("c02"), "n": F.col("c03")})
    if light:
        df = light(df)
    elif rayleigh or correct:
        df = df.withColumns({c: G.sun_normalise(F.col(c), F.col("sza")) for c in "brn"})
        if correct:
            df = correct(df)
        else:
            df = G.rayleigh_bands(df, {"b": 0.47, "r": 0.64})
    df = df.withColumn("g", P.synthetic_green(F.col("b"), F.col("r"), F.col("n")))
    if sharpen:
        df = enhance.sharpen_ratio(df, "r", "_ratio").withColumns({c: F.col(c) * F.col("_ratio") for c in "gb"})
    if stretch:
        df = df.withColumns({c: P.stretch(F.col(c)) for c in "rgb"})
    return quantised(df, [(F.col(c), 0.0, 1.0 if stretch else 1.1) for c in "rgb"], **options)


def night(wide: DataFrame, table: DataFrame, lights: DataFrame | None = None) -> DataFrame:
    """C13 in the colours of a threshold table."""
    return palette.by_threshold(wide.select(*KEYS, F.col("c13").alias("value")), table, lights).select(*KEYS, "r", "g", "b")


def lights_for(pixels: DataFrame, lights: DataFrame, rasters: DataFrame) -> DataFrame:
    """(scene_id, y, x, r, g, b): the background of each pixel, by the width of its scene's raster.

    lights(width, y, x, r, g, b) has one picture for each of LIGHT_WIDTHS; rasters(scene_id, width);
    scenes of another width have no background.
    """
    wide = rasters.where(F.col("width").isin(*LIGHT_WIDTHS)).select("scene_id", "width")
    return pixels.select(*KEYS).join(wide, "scene_id").join(lights.select("width", "y", "x", "r", "g", "b"), ["width", "y", "x"]).select(*KEYS, "r", "g", "b")


def daynight_mask(df: DataFrame, threshold: float = 263.15) -> DataFrame:
    """Adds mask (255 night .. 0 day) and is_day to rows with c13, lat, lon and the ephemeris.

    Cold pixels count as night; pixels without geometry are day.
    """
    df = G.sine_of_elevation(df, "_se")
    cold = F.coalesce(F.col("c13") < threshold, F.lit(False))
    w = F.when(cold, 1.0).when(F.col("_se").isNull() | (F.col("_se") >= TWILIGHT_END), 0.0).when(F.col("_se") < NIGHT_END, 1.0)
    w = w.otherwise(1.0 - (F.col("_se") - NIGHT_END) * (1.0 / (TWILIGHT_END - NIGHT_END)))
    return df.withColumn("_w", w).withColumns({"mask": (255 * F.col("_w")).cast("int"), "is_day": F.col("_w") < 0.5}).drop("_w", "_se")


def day_share(masked: DataFrame) -> DataFrame:
    """(scene_id, day_percent): 100 where a scene has no night pixel."""
    day, n = F.count_if("is_day"), F.count(F.lit(1))
    return masked.groupBy("scene_id").agg(F.when(day == n, F.lit(100.0)).otherwise(F.lit(100.0) * day / n).alias("day_percent"))


def daynite(wide: DataFrame, table: DataFrame, lights: DataFrame | None = None) -> DataFrame:
    """Day colours blended into night ones by the mask, in scenes with more than NIGHT_SHARE of night.

    wide: c01, c02, c03, c13 with lat, lon, the angles and the ephemeris.
    """
    masked = daynight_mask(wide)
    dark = palette.by_threshold(masked.withColumn("value", F.col("c13")), table, lights).withColumnsRenamed({c: f"n_{c}" for c in "rgb"})
    # both sides as bytes, written once and read for the share of day and for the image
    sides = store.written(truecolor(dark, rayleigh=True, stretch=True, keep=("mask", "is_day", "n_r", "n_g", "n_b")))
    out = store.with_facts(sides, day_share(sides))
    mix = 100 - F.col("day_percent") > NIGHT_SHARE
    return out.select(*KEYS, *[F.when(mix, P.blend(F.col(f"n_{c}"), F.col(c), F.col("mask"))).otherwise(F.col(c)).alias(c) for c in "rgb"])


@dataclass(frozen=True)
class Recipe:
    bands: tuple[int, ...]
    compose: Callable[..., DataFrame]


RECIPES = {name: Recipe(parts[0], (lambda wide, name=name, **o: difference(name, wide, **o))) for name, parts in DIFFERENCES.items()}
RECIPES |= {"truecolor": Recipe((1, 2, 3), truecolor), "night": Recipe((13,), night), "daynite": Recipe((1, 2, 3, 13), daynite)}
DEFAULT = "daynite"

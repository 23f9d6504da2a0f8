"""Per-pixel functions: columns in, column out, all inside one code-generated projection.

NULL is a missing pixel and spreads, except where a quantiser or mask says what it becomes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Knots of the display stretch.
STRETCH = ((0.0, 0.0), (0.09804, 0.35294), (0.21569, 0.54902), (0.39216, 0.68627), (1.0, 1.0))
#: Weights of blue, red and near infrared in the synthetic green.
GREEN = (0.465, 0.465, 0.07)
#: Weights of red, green and blue in the luminance.
LUMA = (0.2126, 0.7152, 0.0722)


def unpack(raw: Column, scale: Column, offset: Column, fill: Column) -> Column:
    return F.when(raw != fill, raw * scale + offset)


def planck(radiance: Column, fk1: Column, fk2: Column, bc1: Column, bc2: Column) -> Column:
    """Brightness temperature; 0 K where there is no radiance."""
    return F.when(radiance.isNull(), None).when(radiance > 0, (fk2 / F.log(fk1 / F.when(radiance > 0, radiance) + 1) - bc1) / bc2).otherwise(F.lit(0.0))


def calibrate(value: Column, band: Column, kappa0: Column, fk1: Column, fk2: Column, bc1: Column, bc2: Column) -> Column:
    """Level 1b radiance as reflectance below band 7, else as brightness temperature."""
    return F.when(band < 7, value * kappa0).otherwise(planck(value, fk1, fk2, bc1, bc2))


def byte_code(code: Column, fill: Column) -> Column:
    return F.when(code != fill, code)


def combine(a: Column, b: Column, op: str) -> Column:
    """a op b for add, sub, mul and div; a divisor within 1e-9 of zero gives a missing pixel."""
    if op == "div":
        return F.when(F.abs(b) > 1e-9, a / F.when(F.abs(b) > 1e-9, b))
    return {"add": a + b, "sub": a - b, "mul": a * b}[op]


def normalised(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest((v - low) / F.when(high != low, high - low), F.lit(0.0)), F.lit(1.0))


def gamma(v: Column, g: float, low: Column, high: Column) -> Column:
    """v scaled to [0, 1] and raised to 1/g; unchanged for g near 1 or not positive, or without a range."""
    if g <= 0 or abs(g - 1) < 1e-6:
        return v
    spread = F.coalesce(high - low, F.lit(0.0)) > 0
    return F.when(v.isNull(), None).when(spread, F.pow(normalised(v, low, high), F.lit(1 / g))).otherwise(v)


def quantise_gray(v: Column, low: Column, high: Column, invert: bool = False, last: int = 255, missing: int = 0) -> Column:
    """0..last by truncation; missing pixels get ``missing``; a range of zero counts as one."""
    spread = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    clamped = F.least(F.greatest(v, low), high)
    part = (high - clamped) / spread if invert else (clamped - low) / spread
    return F.when(v.isNull(), F.lit(missing)).otherwise(F.coalesce((F.lit(last) * part).cast("int"), F.lit(missing)))


def quantise_byte(code: Column, invert: bool = False, missing: int = 0) -> Column:
    value = F.pmod(code, F.lit(256))
    return F.coalesce(255 - value if invert else value, F.lit(missing)).cast("int")


def quantise_channel(v: Column, low: float | Column, high: float | Column) -> Column:
    """0..255 by truncation; missing is 0; a range below 1e-6 counts as one."""
    low, high = (F.lit(float(c)) if isinstance(c, (int, float)) else c for c in (low, high))
    spread = F.when(F.abs(high - low) < 1e-6, F.lit(1.0)).otherwise(high - low)
    part = F.least(F.greatest((v - low) / spread, F.lit(0.0)), F.lit(1.0))
    return F.when(v.isNull(), F.lit(0)).otherwise((part * 255).cast("int"))


def validity(v: Column) -> Column:
    return F.when(v.isNull(), F.lit(0)).otherwise(F.lit(255))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.least(F.lit(255), F.floor(r * LUMA[0] + g * LUMA[1] + b * LUMA[2] + 0.5).cast("int"))


def relight(channel: Column, before: Column, after: Column) -> Column:
    """A channel scaled by the ratio of luminances, at most fourfold."""
    ratio = F.least(after / (before + F.lit(1e-6)), F.lit(4.0))
    return F.floor(F.least(channel * ratio, F.lit(255.0)) + 0.5).cast("int")


def stretch(v: Column) -> Column:
    """Piecewise linear through STRETCH, ends clamped, missing stays missing."""
    out = F.when(v.isNull(), None).when(v <= STRETCH[0][0], F.lit(STRETCH[0][1]))
    for (x0, y0), (x1, y1) in zip(STRETCH, STRETCH[1:]):
        out = out.when(v < x1, F.lit(y0) + (v - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(STRETCH[-1][1]))


def synthetic_green(blue: Column, red: Column, nir: Column) -> Column:
    return blue * GREEN[0] + red * GREEN[1] + nir * GREEN[2]


def blend(background: Column, foreground: Column, mask: Column) -> Column:
    """Background where the mask is 255, foreground where it is 0, truncated between."""
    w = mask / F.lit(255.0)
    return (w * background + (1 - w) * foreground).cast("int")

"""Colour expressions and the measured colour constants."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from meshspark.functions.hashing import gaussian, uniform
from meshspark.functions.vectors import clip

# fixed values
NO_COLOUR = (102, 102, 102)
TOOTH_RGB_RANGE = ((210, 200, 175), (245, 235, 215))
GUM_RGB_RANGE = ((190, 100, 115), (225, 150, 155))
TOOTH_RGB_MEAN_STD = ((198.8, 194.0, 198.4), (13.4, 16.2, 17.9))
GUM_RGB_MEAN_STD = ((175.6, 140.0, 136.5), (22.7, 25.5, 25.5))
# fixed values: (mean, std, low, high) of hue in degrees, saturation, value
TOOTH_HSV = ((48.0, 8.0, 25.0, 65.0), (0.12, 0.05, 0.02, 0.28), (0.80, 0.06, 0.55, 1.0))
GUM_HSV = ((5.0, 6.0, -10.0, 20.0), (0.30, 0.10, 0.10, 0.60), (0.70, 0.08, 0.45, 0.92))
REDNESS_THRESHOLD = 20.0


def is_sentinel(r: Column, g: Column, b: Column) -> Column:
    return (r == NO_COLOUR[0]) & (g == NO_COLOUR[1]) & (b == NO_COLOUR[2])


def redness(r: Column, g: Column, b: Column) -> Column:
    return r - (g + b) / 2.0


def gum_score(red: Column, threshold: float = REDNESS_THRESHOLD) -> Column:
    return clip(F.lit(0.5) + (red - threshold) / 40.0, 0.0, 1.0)


def to_unit(c: Column) -> Column:
    return c / 127.5 - 1.0


def from_unit(c: Column) -> Column:
    return clip((c + 1.0) * 127.5, 0.0, 255.0)


def to_byte(c: Column) -> Column:
    """Clip to 0..255 and cut the fraction, as an unsigned byte cast does."""
    return F.floor(clip(c, 0.0, 255.0)).cast("bigint")


def hsv_to_rgb(h_deg: Column, s: Column, v: Column) -> list[Column]:
    """RGB in [0, 1]; the hue wraps at 360 degrees."""
    h6 = F.pmod(h_deg, F.lit(360.0)) / 60.0
    channel = []
    for n in (5.0, 3.0, 1.0):
        k = F.pmod(F.lit(n) + h6, F.lit(6.0))
        channel.append(v - v * s * F.greatest(F.least(k, F.lit(4.0) - k, F.lit(1.0)), F.lit(0.0)))
    return channel


def _pick(is_gum: Column, tooth, gum) -> Column:
    return F.when(is_gum, F.lit(float(gum))).otherwise(F.lit(float(tooth)))


def paint_flat(is_gum: Column, seed: str, *keys: str) -> list[Column]:
    """One draw per patch and class group, in the fixed ranges. ``keys`` name the patch."""
    out = []
    for i, ch in enumerate("rgb"):
        low = _pick(is_gum, TOOTH_RGB_RANGE[0][i], GUM_RGB_RANGE[0][i])
        high = _pick(is_gum, TOOTH_RGB_RANGE[1][i], GUM_RGB_RANGE[1][i])
        draw = uniform(seed, *keys, F.when(is_gum, "gum").otherwise("tooth"), F.lit(ch))
        out.append(F.floor(low + (high - low) * draw).cast("bigint").alias(ch))
    return out


def paint_mosaic(is_gum: Column, seed: str, *keys: str) -> list[Column]:
    """An independent Gaussian draw per face and channel. ``keys`` name the face."""
    out = []
    for i, ch in enumerate("rgb"):
        mean = _pick(is_gum, TOOTH_RGB_MEAN_STD[0][i], GUM_RGB_MEAN_STD[0][i])
        std = _pick(is_gum, TOOTH_RGB_MEAN_STD[1][i], GUM_RGB_MEAN_STD[1][i])
        out.append(to_byte(mean + std * gaussian(f"{seed}/{ch}", *keys)).alias(ch))
    return out


def paint_hsv(is_gum: Column, seed: str, *keys: str) -> list[Column]:
    """Per-face draws in hue, saturation and value, clipped to the class range, then converted."""
    hsv = []
    for i, ch in enumerate("hsv"):
        mean, std, low, high = [_pick(is_gum, TOOTH_HSV[i][p], GUM_HSV[i][p]) for p in range(4)]
        hsv.append(F.least(F.greatest(mean + std * gaussian(f"{seed}/{ch}", *keys), low), high))
    return [to_byte(c * 255.0).alias(n) for c, n in zip(hsv_to_rgb(*hsv), "rgb")]

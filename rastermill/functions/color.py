"""Colour columns: channels are 0..65535, hue 0..360, saturation and value 0..1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX16 = 65535.0
OPAQUE, TRANSPARENT, BLACK = 32767, 16384, 3840
#: Brightest channel of a pixel that holds no picture.
UNSEEN = 8621


def rgb_to_hsv(r, g, b) -> Column:
    """struct(h, s, v); grey has hue and saturation 0."""
    r, g, b = (F.col(c) / MAX16 if isinstance(c, str) else c / MAX16 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif(top - low, F.lit(0.0))
    h = F.when(top == r, 60 * (g - b) / d).when(top == g, 60 * (b - r) / d + 120).otherwise(60 * (r - g) / d + 240)
    h = F.coalesce(h + F.when(h < 0, 360.0).otherwise(0.0), F.lit(0.0))
    return F.struct(h.alias("h"), F.coalesce((top - low) / F.nullif(top, F.lit(0.0)), F.lit(0.0)).alias("s"), top.alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """struct(r, g, b) of integers, truncated."""
    sector = F.floor(h / 60) % 6
    f = h / 60 - sector
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    pick = lambda *six: F.floor(F.element_at(F.array(*six), (sector + 1).cast("int")) * MAX16).cast("int")
    return F.struct(pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b"))


def luma601(r="r", g="g", b="b") -> Column:
    return 0.299 * F.col(r) + 0.587 * F.col(g) + 0.114 * F.col(b)


def luma709(r="r", g="g", b="b") -> Column:
    return 0.21126 * F.col(r) + 0.7152 * F.col(g) + 0.0722 * F.col(b)


def is_opaque(a="a") -> Column:
    return F.col(a) >= OPAQUE


def is_transparent(a="a") -> Column:
    return F.col(a) < TRANSPARENT


def is_black(r="r", g="g", b="b") -> Column:
    return F.greatest(r, g, b) <= BLACK


def is_nonblack(r="r", g="g", b="b") -> Column:
    return ~is_black(r, g, b)


def is_seen(r="r", g="g", b="b", a="a") -> Column:
    """Opaque, and brighter than what stands for missing picture."""
    return is_opaque(a) & (F.greatest(r, g, b) > UNSEEN)


def is_off_sky_color(hsv: Column, h: Column, s: Column, v: Column, a="a") -> Column:
    """Relative error against an image's mean colour: hue over 5 %, saturation or value over 20 %; never when not opaque."""
    far = lambda x, y, t: F.coalesce(F.abs(x - y) / F.nullif(y, F.lit(0.0)) > t, F.lit(False))
    return is_opaque(a) & (far(hsv["h"], h, 0.05) | far(hsv["s"], s, 0.2) | far(hsv["v"], v, 0.2))


def apply_exposure(df, factor: float):
    """Scale r, g and b, rounding half up and clamping; a factor within .001 of 1 changes nothing."""
    if abs(factor - 1) <= 0.001:
        return df
    return df.withColumns({c: F.least(F.floor(F.col(c) * factor + 0.5), F.lit(65535)).cast("int") for c in "rgb"})


def rgb_to_hsi(r="r", g="g", b="b") -> Column:
    """struct(h, s, i): hue as in rgb_to_hsv(), intensity is the mean of the channels; grey has hue and saturation 0."""
    mean = (F.col(r) + F.col(g) + F.col(b)) / 3 / MAX16
    grey = (F.col(r) == F.col(g)) & (F.col(g) == F.col(b))
    low = F.least(r, g, b) / MAX16
    s = F.when(grey, 0.0).otherwise(1 - low / F.nullif(mean, F.lit(0.0)))
    return F.struct(F.when(grey, 0.0).otherwise(rgb_to_hsv(r, g, b)["h"]).alias("h"), s.alias("s"), mean.alias("i"))


def hsi_to_rgb(h: Column, s: Column, i: Column) -> Column:
    """struct(r, g, b) of integers, truncated."""
    z = 1 - F.abs(h / 60 - 2 * F.floor(h / 120) - 1)
    chroma = 3 * i * s / (1 + z)
    second, low = chroma * z, i * (1 - s)
    sector = F.floor(h / 60)
    full = {"r": (0, 5), "g": (1, 2), "b": (3, 4)}
    part = {"r": (1, 4), "g": (0, 3), "b": (2, 5)}
    value = lambda c: F.when(sector.isin(*full[c]), chroma).when(sector.isin(*part[c]), second).otherwise(0.0) + low
    return F.struct(*[F.floor(value(c) * MAX16 + 1e-9).cast("int").alias(c) for c in "rgb"])

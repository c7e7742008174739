"""Prediction of sky colour from model coefficients (columns of a models row)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import MAX16, hsv_to_rgb

#: Scale that takes exp(cos) / e - exp(-2) to 0..1 (fixed value).
COSINE_SCALE = 1.156517642


def blended(px: Column, left: Column, right: Column) -> Column:
    """Left and right models weigh by the distance to the other side; the weights add up to 1."""
    return (0.5 - px) * left + (px + 0.5) * right


def hue_side(py: Column, px: Column, c: Column) -> Column:
    z = py - (c[3] + c[4] * px)
    return c[1] * z * c[2] / (1 + F.abs(z) * c[2]) + c[0]


def predict_hue(px: Column, py: Column, coefs: Column) -> Column:
    return blended(px, hue_side(py, px, coefs[0]), hue_side(py, px, coefs[1]))


def sat_side(py: Column, px: Column, c: Column) -> Column:
    z = F.greatest(py - (c[0] + c[3] * px), F.lit(0.0))
    return c[4] + z / (c[1] + c[2] * z)


def predict_sat(px: Column, py: Column, coefs: Column) -> Column:
    return blended(px, sat_side(py, px, coefs[0]), sat_side(py, px, coefs[1]))


def base_knot(px: Column, knots: Column) -> Column:
    """Linear interpolation in 101 equally spaced knots."""
    k = F.least(F.floor((px + 0.5) * 100), F.lit(99)).cast("int")
    w = (px + 0.5) * 100 - k
    return (1 - w) * F.get(knots, k) + w * F.get(knots, k + 1)


def predict_val(px: Column, py: Column, c: Column, knots: Column, horizon_py: Column, fov_y: Column) -> Column:
    base = base_knot(px, knots)
    angle = (py - horizon_py - c[3] * base) * fov_y
    return base * c[1] + c[0] * (F.exp(F.cos(c[2] * angle)) / math.e - math.exp(-2)) * COSINE_SCALE


def predict_val_smooth(px: Column, py: Column, c: Column, fov: Column) -> Column:
    """Logistic in py, moved up and down by a cosine of the horizontal angle; at most 1."""
    x = fov * px + c[6]
    return F.least(c[0] + c[1] / (1 + F.exp((py - c[2]) * c[3])) + c[5] * F.cos(F.radians(x)) * (1 - c[4] * F.abs(x) / 180), F.lit(1.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def predicted_rgb(h: Column, s: Column, v: Column) -> Column:
    return hsv_to_rgb(h, clamp01(s), clamp01(v))


def sky_probability(rgb: list[Column], rgb_hat: list[Column]) -> Column:
    """1 less the mean relative error, channels weighing as predicted."""
    err = sum(p * (F.abs(p - c) / MAX16) for p, c in zip(rgb_hat, rgb)) / F.nullif(sum(rgb_hat), F.lit(0))
    return 1 - F.coalesce(err, F.lit(0.0))


def replacement_probability(prob: Column, i: Column, i_hat: Column, s: Column, s_hat: Column, thresh: float = 0.9, ramp: float = 200.0) -> Column:
    """Logistic of the probability, less for pixels paler than predicted, which may be cloud."""
    p = 1 / (1 + F.exp(-(prob - thresh) * ramp))
    ratio = F.when(i > i_hat, i_hat / F.nullif(i, F.lit(0.0))).otherwise(i / F.nullif(i_hat, F.lit(0.0)))
    return clamp01(F.when(s < s_hat, p * F.coalesce(ratio, F.lit(0.0)) * s / s_hat).otherwise(p))


#: Share of full blue below which a pixel is black and takes all of the prediction.
BLACK_LEVEL = 0.04


def feather_length(sos: Column, eos: Column, depth: float = 0.5, extra: int = 0, from_row: Column | None = None, absolute_y: Column | None = None) -> Column:
    """Rows over which the fill fades: `depth` of the sky (or of the rows down to absolute_y), counted from the start of sky
    or from from_row (the raw start), and not beyond the end."""
    start = sos if from_row is None else from_row
    sky = eos - sos if absolute_y is None else absolute_y - start
    return (F.least(start + F.floor(sky * depth + 0.5) + extra, eos) - start).cast("int")


def feather_weight(y: Column, sos: Column, length: Column, blue: Column | None = None, factor: float = 1.0, exponent: float = 1.0) -> Column:
    """Share of the prediction: 1 above the start of sky and in pixels whose blue is under the black level, else falling
    from 1 at the start to 0 at the end of the feather."""
    below = y >= sos if blue is None else (y >= sos) & (blue >= BLACK_LEVEL * MAX16)
    linear = F.when(below, 1 - (y - sos) / F.nullif(length, F.lit(0))).otherwise(1.0)
    return F.pow(clamp01(1 - (1 - F.coalesce(linear, F.lit(0.0))) * factor), F.lit(exponent))


def raw_feather_weight(y: Column, raw_sos: Column, length: Column, blue: Column, factor: float = 1.0, exponent: float = 1.0) -> Column:
    """The same from the raw start: 1 down to it, 0 beyond the feather, black pixels between take all of the prediction."""
    inside = feather_weight(y, raw_sos, length, blue, factor, exponent)
    return F.when(y <= raw_sos, 1.0).when(y > raw_sos + length, 0.0).otherwise(inside)


def barycentric_weights(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> list[Column]:
    """Weights of three corners (x, y) at a point; they add up to 1, and are null where the corners are on one line."""
    (x1, y1), (x2, y2), (x3, y3) = corners
    whole = F.nullif((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3), F.lit(0.0))
    first = ((y2 - y3) * (x - x3) + (x3 - x2) * (y - y3)) / whole
    second = ((y3 - y1) * (x - x3) + (x1 - x3) * (y - y3)) / whole
    return [first, second, 1 - first - second]


def barycentric_blend(x: Column, y: Column, corners: list[tuple[Column, Column]], values: list[Column]) -> Column:
    """The blend of three values that belong to three corners."""
    return sum(w * v for w, v in zip(barycentric_weights(x, y, corners), values))


def with_sun(s: Column, v: Column, glow: Column, glow_min: Column, glow_max: Column, sun_lum: Column, sat_depth: Column) -> Column:
    """struct(s, v): saturation and value with the sun's glow, all within 0..1.

    The glow (at most glow_max, at least 0) counts from 0 at glow_min to sun_lum at glow_max; it is added to the value and
    taken from the saturation, which is multiplied by sat_depth then. A negative sun_lum shows the glow alone, of that size.
    """
    light = clamp01(glow / glow_max) * glow_max
    add = F.greatest(F.lit(0.0), F.abs(sun_lum) * (light - glow_min) / F.nullif(glow_max - glow_min, F.lit(0.0)))
    add = F.coalesce(add, F.lit(0.0))
    both = sun_lum > 0
    value = F.when(both, clamp01(v) + add).otherwise(add)
    return F.struct((clamp01(clamp01(s) - F.when(both, add).otherwise(0.0)) * sat_depth).alias("s"), clamp01(value).alias("v"))


def logistic_feather(p: Column) -> Column:
    """A linear blend made logistic; 0, .5 and 1 stay."""
    offset = 1 / (1 + math.exp(2.5))
    return (1 / (1 + F.exp(-(p - 0.5) * 5)) - offset) / (1 - 2 * offset)

"""Positions relative to the image, viewing angles, the sun and general sky luminance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import with_image


def with_relative_xy(px: DataFrame, images: DataFrame) -> DataFrame:
    """Adds px (-0.5 .. 0.5) and py (1 at the top). images has a row for each image and is joined by its key."""
    d = with_image(px, images.select("image_id", "width", "height"))
    return d.withColumns({"px": F.col("x") / (F.col("width") - 1) - 0.5, "py": 1 - F.col("y") / (F.col("height") - 1)}).drop("width", "height")


def to_pixel_xy(px: Column, py: Column, width: Column, height: Column) -> tuple[Column, Column]:
    return F.floor((px + 0.5) * (width - 1) + 0.5).cast("int"), F.floor((1 - py) * (height - 1) + 0.5).cast("int")


def view_angles(px: Column, py: Column, fov: Column, width: Column, height: Column) -> Column:
    """struct(aoy, aox): angles about the vertical and horizontal axes; beyond the zenith the latter is mirrored."""
    horizontal = F.radians(fov)
    l = (py - 0.5) * F.sin(horizontal * height / width / 2) * 2  # noqa: E741
    return F.struct((-px * horizontal).alias("aoy"), F.when(l > 1, math.pi - F.asin(2 - l)).otherwise(F.asin(l)).alias("aox"))


def view_vector(aoy: Column, aox: Column) -> Column:
    """Unit vector of a viewing direction."""
    return F.struct((F.sin(aoy) * F.cos(aox)).alias("A"), F.sin(aox).alias("B"), (F.cos(aoy) * F.cos(aox)).alias("C"))


def angle_between(u: Column, v: Column) -> Column:
    dot = u["A"] * v["A"] + u["B"] * v["B"] + u["C"] * v["C"]
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def adjust_horizon(px: Column, py: Column, curvature: Column, slope: Column) -> Column:
    """py as it would be with a straight, level horizon."""
    f = 1 - F.pow(1 - F.abs(curvature), F.lit(2.0))
    bow = 1 - F.sqrt(F.greatest(1 - f * px * px * 4, F.lit(0.0)))
    return py - F.when(curvature < 0, -bow).otherwise(bow) + slope * px


def sun_weight(px: Column, py: Column, sun_px: Column, sun_py: Column, aspect: Column, f: Column, g: Column) -> Column:
    """f within radius g of the sun, then a logistic fall to 0 (square root taken); aspect is height / width."""
    r = F.sqrt(F.pow(px - sun_px, F.lit(2.0)) + F.pow((py - sun_py) * aspect, F.lit(2.0))) / g
    return f * F.sqrt(F.when(r < 1, 1.0).otherwise(1 - 1 / (1 + F.exp(5 - 10 * (r - 1)))))


def sun_angle(px: Column, py: Column, sun_px: Column, sun_py: Column, fov_x: Column, fov_y: Column) -> Column:
    """Angle to the sun as a distance in the picture; 0 within the sun's disc."""
    gamma = F.sqrt(F.pow((px - sun_px) * fov_x, F.lit(2.0)) + F.pow((py - sun_py) * fov_y, F.lit(2.0)))
    return F.when(gamma < math.radians(0.533) / 2, 0.0).otherwise(gamma)


def zenith_angle(py_level: Column, horizon_py: Column, fov_y: Column) -> Column:
    """Angle to the zenith, above the horizon; py_level is py from adjust_horizon()."""
    return F.least(math.pi / 2 - (py_level - horizon_py) * fov_y, F.lit(math.pi / 2 - 0.01))


def luminance(gamma: Column, theta: Column, a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    """General sky luminance by the angles to the sun and to the zenith."""
    return (1 + a * F.exp(b / F.cos(theta))) * (1 + c * (F.exp(d * gamma) - F.exp(d * (math.pi / 2))) + e * F.pow(F.cos(gamma), F.lit(2.0)))


def cie_luminance(px: Column, py: Column, py_level: Column, sun_px: Column, sun_py: Column, horizon_py: Column, fov_x: Column, fov_y: Column, a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
    """luminance() at a place of the picture."""
    return luminance(sun_angle(px, py, sun_px, sun_py, fov_x, fov_y), zenith_angle(py_level, horizon_py, fov_y), a, b, c, d, e)


def sun_glow(gamma: Column, c: Column, d: Column) -> Column:
    """Luminance by nearness to the sun alone: gamma is the angle to the sun (0 within its disc)."""
    near = F.when(gamma < math.radians(0.533) / 2, 0.0).otherwise(gamma)
    return 1 + c * (F.exp(-near / d) - F.exp(-(math.pi / 2) / d))


def glow_range(images: DataFrame) -> DataFrame:
    """(image_id, glow_max, glow_min) of images (image_id, fov, width, height, sun_px, sun_py, c, d): the most is the glow at
    the sun as if c were 2, so that c brightens the sun; the least is that of a grid of 3 by 3 points. A grid point is a
    row, least by partial aggregation."""
    side = lambda name, lo: F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: lo + k * 0.5)).alias(name)
    d = images.select("*", side("px", -0.5)).select("*", side("py", 0.0))
    look = lambda x, y: (lambda a: view_vector(a["aoy"], a["aox"]))(view_angles(F.col(x), F.col(y), F.col("fov"), F.col("width"), F.col("height")))
    d = d.withColumns({"view": look("px", "py"), "sun": look("sun_px", "sun_py")})
    glow = sun_glow(angle_between(F.col("view"), F.col("sun")), F.col("c"), F.col("d"))
    peak = sun_glow(F.lit(0.0), F.col("c"), F.col("d"))
    return d.groupBy("image_id").agg(F.max(1 + 2 * (peak - 1) / F.nullif("c", F.lit(0.0))).alias("glow_max"), F.min(glow).alias("glow_min"))

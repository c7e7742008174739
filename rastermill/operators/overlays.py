"""Lens-flare elements drawn over pixels: each element meets only the pixels of its bounding box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import hsv_to_rgb
from ..functions.keys import dealt
from ..functions.model import clamp01


#: The brightest channel that drawn light gives.
BRIGHTEST = 65534


def _boxed(px: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements (ex, ey, reach) copied to the columns they touch and joined by (image, column); rows outside the box fall away."""
    e = elements.withColumn("x", F.explode(F.expr("sequence(CAST(floor(ex - reach) AS INT), CAST(floor(ex + reach) AS INT))")))
    return px.select("image_id", "x", "y").join(dealt(e), ["image_id", "x"]).filter("y BETWEEN floor(ey - reach) AND floor(ey + reach)")


def ghost_light(channel: str, offset: int) -> Column:
    """What a ghost adds to a channel of a pixel (0..1, null outside): columns of the ghost, its place ex, ey, the sun's.

    The channel's centre stands `offset` times max_ca thousandths farther from the sun than the ghost's. The pixel's distance
    to the rim is a blend of that to the nearest of the n_leaves half planes that bound the shape and that to a circle. With
    r = 1 - distance / radius, light is c + exp(-(b - r) e) (1 - c) up to r = b and falls to 0 at the rim from there; without
    b it is (1 - r)^e. Within one pixel of the rim it fades.
    """
    away = lambda at, sun: at + offset * F.col("max_ca") * (at - sun) / 1000
    u, v = F.col("x") - away(F.col("ex"), F.col("sun_x")), F.col("y") - away(F.col("ey"), F.col("sun_y"))
    turn = lambda leaf: 2 * math.pi * leaf / F.col("n_leaves")
    leaves = F.sequence(F.lit(0), (F.col("n_leaves") - 1).cast("int"))
    flat = F.col("radius") - F.array_max(F.transform(leaves, lambda k: F.cos(turn(k)) * u + F.sin(turn(k)) * v))
    d = F.col("pcircle") * (F.col("radius") - F.sqrt(u * u + v * v)) + (1 - F.col("pcircle")) * flat
    r = 1 - d / F.col("radius")
    b, c, e = F.col("b"), F.col("c"), F.col("e")
    profile = F.when(b <= 0, F.pow(F.greatest(1 - r, F.lit(0.0)), e)).when(r < b, c + F.exp(-(b - r) * e) * (1 - c)).otherwise(1 - (r - b) / F.nullif(1 - b, F.lit(0.0)))
    return F.when((flat > 0) & (d > 0) & r.between(0, 1), F.col(f"i_{channel}") * F.least(d, F.lit(1.0)) * profile)


def overlay_ghosts(px: DataFrame, ghosts: DataFrame) -> DataFrame:
    """px with the light of ghosts: image_id, x, y, radius, i_r, i_g, i_b, e, b, c, max_ca, n_leaves (3 or more; others draw nothing),
    pcircle, and sun_x, sun_y, the sun's pixel.

    Light of several ghosts adds up in each channel (the cube that a ghost's light is raised to has its root taken again
    before the next ghost). An element meets only the pixels of its box, by an equi-join on image and column.
    """
    g = ghosts.filter("n_leaves > 2").withColumns({"ex": F.col("x"), "ey": F.col("y"), "reach": F.col("radius") * math.sqrt(2) + 1 + F.col("max_ca")}).drop("x", "y")
    d = _boxed(px, g)
    sums = d.groupBy("image_id", "x", "y").agg(*[(F.sum(ghost_light(c, k)) * 65535).alias(f"add_{c}") for c, k in zip("rgb", (1, 0, -1))])
    return _added(px, sums)


def overlay_rays(px: DataFrame, rays: DataFrame, saturation: float = 1.0) -> DataFrame:
    """px with rays: image_id, sun_x, sun_y (the sun's pixel, whole numbers), ra, rb (unit normal of the ray's line: the ray
    goes in direction (rb, -ra)), radius, width, intensity, hue_start, falloff_a, falloff_b, grp.

    A ray has pixels on its side of the sun. Along it (pr: 0 at the sun, 1 at its end, which is half as far upwards as
    downwards) its light falls by exp(-6 pr), its half width grows to four times that at the sun and ends round, its
    saturation rises (times `saturation`), and its hue turns once (twice in groups of even number). Across it light falls by a
    logistic of falloff_a and falloff_b. Colours of all rays add up.
    """
    e = rays.withColumns({"ex": F.col("sun_x"), "ey": F.col("sun_y"), "reach": F.col("radius") + F.col("width")})
    d = _boxed(px, e).withColumns({"rx": F.col("x") - F.col("ex"), "ry": F.col("y") - F.col("ey")})
    d = d.withColumns({"off": F.expr("ra * rx + rb * ry"), "long": F.expr("radius * ((1 - ra) / 4 + 0.5)")})
    d = d.withColumn("along", F.sqrt(F.greatest(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") - F.col("off") * F.col("off"), F.lit(0.0))))
    d = d.withColumn("pr", F.col("along") / F.col("long")).filter("rb * rx - ra * ry >= 0 AND pr <= 1")
    half, left = (0.25 + 0.75 * F.col("pr")) * F.col("width"), F.col("long") - F.col("along")
    d = d.withColumn("half", F.when(left <= half, half * F.sqrt(1 - F.pow(1 - left / half, F.lit(2.0)))).otherwise(half))
    d = d.withColumn("in", F.col("half") - F.abs("off")).filter("in > 0")
    across = 1 / (1 + F.exp((1 - F.col("in") / F.col("half") - F.col("falloff_a")) * F.col("falloff_b")))
    hue = F.col("hue_start") + F.when(F.col("grp") % 2 == 1, 360).otherwise(720) * F.col("pr")
    for _ in range(2):
        hue = F.when(hue >= 360, hue - 360).otherwise(hue)
    s = clamp01(saturation / (1 + F.exp(-(F.col("pr") - 0.4) * 10)))
    color = hsv_to_rgb(hue, s, F.col("intensity") * F.exp(-6 * F.col("pr")) * F.least(F.col("in"), F.lit(1.0)) * across)
    sums = d.withColumn("light", color).groupBy("image_id", "x", "y").agg(*[F.sum(f"light.{c}").cast("double").alias(f"add_{c}") for c in "rgb"])
    return _added(px, sums)


def _added(px: DataFrame, sums: DataFrame) -> DataFrame:
    """px and the light of sums (add_r, add_g, add_b); pixels without a row there stay, others end at BRIGHTEST."""
    d = px.join(dealt(sums.withColumn("lit", F.lit(True))), ["image_id", "x", "y"], "left")
    new = lambda c: F.least(F.lit(BRIGHTEST), F.floor(F.col(c) + F.coalesce(f"add_{c}", F.lit(0.0)))).cast("int")
    return d.select("image_id", "x", "y", *[F.when(F.col("lit") & F.coalesce("add_r", "add_g", "add_b").isNotNull(), new(c)).otherwise(F.col(c)).alias(c) for c in "rgb"], "a")


def audit_marks(col: DataFrame, smp: DataFrame, rects: DataFrame, width: int, height: int, depth: float = 0.5, classes: DataFrame | None = None) -> DataFrame:
    """(image_id, x, y, r, g, b, layer): pixels that show what was found; where several marks fall on one, the last layer's.

    Layers: 0 pixels of the sky class (light blue), where classes (image_id, x, y, pixel_class) are given, 1 manual end (red, two below), 2 start of sky (red, one above), 3 raw start (yellow), 4 end of the fill (grey),
    5 end of sky (green, two and three below), 6 boxes of 3 by 3 around samples (black to white by their error), 7 borders
    of rectangles (light red). Masked columns have no layer from 2 to 5. Every mark is a row of its own table, so pixels
    are not scanned; marks are united and the last layer is taken by partial aggregation.
    """
    half, full, last = 32767, 65535, height - 1
    below = lambda end, n: F.least(F.lit(last), F.least(F.lit(last), F.col(end) + 2) + n)

    def mark(d: DataFrame, y, rgb: tuple, layer: int) -> DataFrame:
        return d.select("image_id", "x", y.cast("int").alias("y"), *[F.lit(v).cast("int").alias(c) for c, v in zip("rgb", rgb)], F.lit(layer).alias("layer"))

    seen = col.filter("column_mask = 0")
    fill_end = F.col("sos") + F.floor((F.col("eos") - F.col("sos")) * depth + 0.5)
    marks = [
        mark(col.filter(F.col("manual_eos").between(0, last)), below("manual_eos", 0), (full, 0, 0), 1),
        mark(seen, F.col("sos") - 1, (full, 0, 0), 2),
        mark(seen, F.col("raw_sos") - 1, (half, half, 0), 3),
        *[mark(seen, fill_end + n, (half, half, half), 4) for n in (0, 1)],
        *[mark(seen, below("eos", n), (0, full, 0), 5) for n in (0, 1)],
    ]
    grey = F.floor(F.least(F.lit(1.0), F.abs("v_error") * 10) * full + 0.5).cast("int")
    clip = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(top), v))
    box = smp.withColumn("grey", grey).withColumn("bx", F.explode(F.sequence(F.col("x") - 1, F.col("x") + 1))).withColumn("by", F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)))
    box = box.groupBy("image_id", clip(F.col("bx"), width - 1).alias("x"), clip(F.col("by"), last).alias("y")).agg(F.max("grey").alias("grey"))
    marks.append(box.select("image_id", "x", "y", *[F.col("grey").alias(c) for c in "rgb"], F.lit(6).alias("layer")))
    sides = F.explode(F.array(*[F.struct(*[F.expr(e).alias(n) for e, n in zip(s.split(), ("x0", "x1", "y0", "y1"))]) for s in ("l r t-1 t", "l r b b+1", "l-1 l t b", "r r+1 t b")]))
    edge = rects.select("image_id", sides.alias("s")).select("image_id", *[clip(F.col(f"s.{c}"), top).alias(c) for c, top in (("x0", width - 1), ("x1", width - 1), ("y0", last), ("y1", last))])
    edge = edge.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    marks.append(mark(edge, F.col("y"), (full, half, half), 7))
    if classes is not None:
        marks.append(mark(classes.filter(F.col("pixel_class").bitwiseAND(1) == 1), F.col("y"), (half, half, full), 0))
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    top = every.filter(F.col("y").between(0, last)).groupBy("image_id", "x", "y").agg(F.max(F.struct("layer", "r", "g", "b")).alias("m"))
    return top.select("image_id", "x", "y", "m.r", "m.g", "m.b", "m.layer")

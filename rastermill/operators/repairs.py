"""Filters and repairs that look at neighbours: bilateral grey, band profiles, paired tests, local fits and run filling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import is_seen
from ..functions.keys import dealt, of_image
from ..functions.model import barycentric_blend
from ..sources.store import saved
from .columns import by_row, by_x, by_y
from .fits import student_t_cdf
from .local_fit import NEAR_MEAN, fitted, local_fits, repaired, whole


def with_gray(px: DataFrame) -> DataFrame:
    return px.withColumn("gray", (F.col("r") + F.col("g") + F.col("b")) / 3.0 / 65535.0)


def bilateral_gray(px: DataFrame, dx: int = 2, dy: int = 2, alpha: float = 2.0, beta: float = 0.1) -> DataFrame:
    """image_id, x, y, smooth: grey averaged over a box with Gaussian weights of distance and of difference in grey; pixels that
    are missing count for nothing.

    dy = 0 gives the filter along rows. Neighbours along the row become columns by one window, their neighbours along the
    column by another, so no neighbour is joined and no list is built.
    """

    def beside(value: str, k: int, place: str, w) -> Column:
        at = lambda c: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)
        return F.col(value) if k == 0 else F.when(at(place) == F.col(place) + k, at(value))

    d = with_gray(px).select("image_id", "x", "y", "gray")
    d = d.withColumns({f"_{k + dx}": beside("gray", k, "x", by_row()) for k in range(-dx, dx + 1)})
    box = {(k, j): f"_{k + dx}_{j + dy}" for k in range(-dx, dx + 1) for j in range(-dy, dy + 1)}
    d = d.withColumns({name: beside(f"_{k + dx}", j, "y", by_y()) for (k, j), name in box.items()})
    weight = {name: F.exp(-(k * k + j * j) / (2 * alpha**2) - F.pow(F.col(name) - F.col("gray"), F.lit(2.0)) / (2 * beta**2)) for (k, j), name in box.items()}
    total = lambda f: sum(F.coalesce(f(name), F.lit(0.0)) for name in box.values())
    return d.select("image_id", "x", "y", (total(lambda n: weight[n] * F.col(n)) / total(lambda n: weight[n])).alias("smooth"))


def two_band_profile(px: DataFrame, above: int = 10, below: int = 5) -> DataFrame:
    """(image_id, x, y, t_r, t_g, t_b, mean_diff, color_dist, cv_diff): the `above` rows up to y against the `below` next ones:
    Welch's t of each channel (0..1), the sum over channels of the absolute differences of means, the distance of the means
    relative to those above, and the mean absolute difference of variation coefficients. Rows without both bands whole
    are left out."""
    up, down = by_y().rowsBetween(-above + 1, 0), by_y().rowsBetween(1, below)
    square = lambda c: F.pow(c, F.lit(2.0))
    d, t, diff, dist, cv = px, {}, F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for c in "rgb":
        v = F.col(c) / 65535.0
        m1, m2, s1, s2 = F.avg(v).over(up), F.avg(v).over(down), F.stddev_samp(v).over(up), F.stddev_samp(v).over(down)
        t[f"t_{c}"] = (m1 - m2) / F.nullif(F.sqrt(s1 * s1 / above + s2 * s2 / below), F.lit(0.0))
        diff = diff + F.abs(m1 - m2)
        dist = dist + square((m2 - m1) / F.nullif(m1, F.lit(0.0)))
        cv = cv + F.abs(F.coalesce(s2 / F.nullif(m2, F.lit(0.0)), F.lit(0.0)) - F.coalesce(s1 / F.nullif(m1, F.lit(0.0)), F.lit(0.0))) / 3
    d = d.withColumns(t | {"mean_diff": diff, "color_dist": F.sqrt(dist), "cv_diff": cv, "_n": F.count("*").over(by_y().rowsBetween(-above + 1, below))})
    return d.filter(F.col("_n") == above + below).select("image_id", "x", "y", *t, "mean_diff", "color_dist", "cv_diff")


def two_band_probability(px: DataFrame, above: int = 10, below: int = 5) -> DataFrame:
    """two_band_profile() with p_r, p_g, p_b, the probability of a smaller absolute t with above - 1 degrees of freedom (one
    side), and p_diff, their mean times the mean difference of means."""
    d = two_band_profile(px, above, below)
    p = {f"p_{c}": student_t_cdf(F.abs(F.coalesce(F.col(f"t_{c}"), F.lit(0.0))), F.lit(float(above - 1))) for c in "rgb"}
    d = d.withColumns(p)
    return d.withColumn("p_diff", (F.col("p_r") + F.col("p_g") + F.col("p_b")) / 3 * F.col("mean_diff") / 3)


def paired_t_end(px: DataFrame, col: DataFrame, gap: int = 10, block: int = 10, t_limit: float = 1.833, diff_limit: float = 0.02) -> DataFrame:
    """image_id, x, paired_eos: where a neighbour's end is more than `gap` rows lower, blocks of rows below the own end are
    tested pairwise against it; the end moves down to the first block that differs, or to the neighbour's end."""
    ends = col.select("image_id", "x", "eos")
    near = ends.withColumn("nx", F.explode(F.array(F.col("x") - 1, F.col("x") + 1))).join(dealt(ends.toDF("image_id", "nx", "n_eos")), ["image_id", "nx"]).filter(F.col("n_eos") - F.col("eos") > gap)
    gray = with_gray(px).select("image_id", "x", "y", "gray")
    d = near.join(dealt(gray), ["image_id", "x"]).filter("y > eos AND y <= n_eos").join(dealt(gray.toDF("image_id", "nx", "y", "n_gray")), ["image_id", "nx", "y"])
    d = d.withColumns({"block": F.floor((F.col("y") - F.col("eos") - 1) / block), "d": F.col("gray") - F.col("n_gray")})
    s = d.groupBy("image_id", "x", "nx", "eos", "n_eos", "block").agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("s"), F.count("*").alias("n"))
    bad = (F.abs(F.col("m")) * F.sqrt("n") > t_limit * F.col("s")) & (F.abs("m") > diff_limit)
    moved = s.groupBy("image_id", "x", "nx").agg(F.coalesce(F.min(F.when(bad, F.col("eos") + F.col("block") * block)), F.first("n_eos")).alias("end"))
    best = moved.groupBy("image_id", "x").agg(F.max("end").alias("end"))
    return ends.join(dealt(best), ["image_id", "x"], "left").select("image_id", "x", F.coalesce("end", "eos").cast("int").alias("paired_eos"))


def interpolate_transparent(px: DataFrame, confident: float = 0.98) -> DataFrame:
    """image_id, x, y, r, g, b of transparent pixels between confident sky pixels of their row: linear in x between the
    means of 6 rows at both ends. px has prob_sky."""
    rows = by_y().rowsBetween(-3, 2)
    opaque = F.col("a") >= 32767
    d = px.withColumns({f"m_{c}": F.avg(F.when(opaque, F.col(c))).over(rows) for c in "rgb"})
    end = F.when(opaque & (F.col("prob_sky") > confident), F.struct("x", "m_r", "m_g", "m_b"))
    before, after = by_row().rowsBetween(Window.unboundedPreceding, -1), by_row().rowsBetween(1, Window.unboundedFollowing)
    d = d.withColumn("end", end).withColumns({"p": F.last("end", ignorenulls=True).over(before), "q": F.first("end", ignorenulls=True).over(after)})
    d = d.filter((F.col("a") < 16384) & F.col("p").isNotNull() & F.col("q").isNotNull())
    w = (F.col("x") - F.col("p.x")) / (F.col("q.x") - F.col("p.x"))
    return d.select("image_id", "x", "y", *[F.floor(F.col(f"p.m_{c}") * (1 - w) + F.col(f"q.m_{c}") * w).cast("int").alias(c) for c in "rgb"])


def fill_vertical_gaps(px: DataFrame, col: DataFrame, height: int, width: int = 50, limit: float = NEAR_MEAN) -> DataFrame:
    """image_id, x, y, r, g, b of the gaps inside columns: from a row that is not opaque to the next opaque one, between the raw
    start and three quarters of the height, a blend of the local fits at both ends; and of the pixels that those fits left
    out. Gaps that reach that bound stay, and so do masked columns, the runs of columns with gaps at the image's sides,
    and gaps without a fit at both ends. All fits see the pixels as they came."""
    d = px.join(dealt(col.select("image_id", "x", "raw_sos", "column_mask")), ["image_id", "x"])
    d = d.filter((F.col("y") >= F.col("raw_sos")) & (F.col("y") < height * 3 // 4)).withColumn("gap", F.col("a") < 32767)
    whole_x = F.when(~F.col("any"), F.col("x"))
    inner = d.groupBy("image_id", "x").agg(F.max("gap").alias("any")).select("image_id", "x", of_image(F.min(whole_x)).alias("first_x"), of_image(F.max(whole_x)).alias("last_x"))
    below = F.min(F.when(~F.col("gap"), F.col("y"))).over(by_y().rowsBetween(1, Window.unboundedFollowing))
    gaps = d.withColumn("below", below).filter("gap AND below IS NOT NULL AND column_mask = 0").join(dealt(inner), ["image_id", "x"]).filter("x > first_x AND x < last_x")
    gaps = saved(gaps.groupBy("image_id", "x", "below").agg(F.min("y").alias("top")), "gaps")
    ends = gaps.select("image_id", F.col("x").alias("cx"), F.explode(F.array("top", "below")).alias("cy"))
    fits = saved(local_fits(px, col, ends, width, limit=limit), "fits")
    at = lambda y, p: fits.select("image_id", F.col("cx").alias("x"), F.col("cy").alias(y), *[F.col(f"coef_{c}").alias(f"coef_{p}{c}") for c in "rgb"])
    rows = gaps.join(dealt(at("top", "t")), ["image_id", "x", "top"]).join(dealt(at("below", "b")), ["image_id", "x", "below"]).withColumn("y", F.explode(F.sequence("top", "below")))
    w = (F.col("y") - F.col("top")) / (F.col("below") - F.col("top"))
    mixed = lambda c: (1 - w) * fitted(f"t{c}", F.col("y") - F.col("top")) + w * fitted(f"b{c}", F.col("y") - F.col("below"))
    filled = rows.select("image_id", "x", "y", *[whole(mixed(c)).alias(c) for c in "rgb"])
    filled = filled.groupBy("image_id", "x", "y").agg(F.max(F.struct("r", "g", "b")).alias("new")).select("image_id", "x", "y", "new.*")
    return filled.unionByName(repaired(px, col, fits, limit=limit).join(dealt(filled.select("image_id", "x", "y")), ["image_id", "x", "y"], "left_anti"))


def level_start(col: DataFrame, width_px: int) -> DataFrame:
    """Adds level_sos: starts raised until columns three apart differ by one row at most, unless a masked column lies between.

    Raising by one until nothing moves ends at the least of s(j) + |x - j| / 3 over the columns j that such steps reach: two
    running minima in each chain of every third column.
    """
    masks = F.greatest("column_mask", *[F.coalesce(F.lag("column_mask", k).over(by_x()), F.lit(1)) for k in (1, 2, 3)])
    d = col.withColumn("cut", F.when((masks == 1) | (F.col("x") > width_px - 2), 1).otherwise(0)).withColumns({"chain": F.col("x") % 3, "k": F.floor(F.col("x") / 3)})
    d = d.withColumn("run", F.sum("cut").over(Window.partitionBy("image_id", "chain").orderBy("x")))
    w = Window.partitionBy("image_id", "chain", "run").orderBy("x")
    d = d.withColumn("e", F.min(F.col("sos") - F.col("k")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k"))
    d = d.withColumn("e", F.min(F.col("e") + F.col("k")).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("k"))
    return d.select(*col.columns, F.col("e").cast("int").alias("level_sos"))


def fill_levelled_start(px: DataFrame, levelled: DataFrame, width: int = 15, limit: float = NEAR_MEAN) -> DataFrame:
    """image_id, x, y, r, g, b of the pixels between level_sos and the old start, by the local fit half a width below it (of
    every second pixel). Columns without a fit give none."""
    todo = levelled.filter("level_sos < sos").select("image_id", F.col("x").alias("cx"), (F.col("sos") + width // 2).alias("cy"), "level_sos", "sos")
    rows = local_fits(px, levelled, todo, width, step=2, limit=limit).join(dealt(todo), ["image_id", "cx", "cy"]).withColumn("y", F.explode(F.expr("sequence(level_sos, sos - 1)")))
    return rows.select("image_id", F.col("cx").alias("x"), "y", *[whole(fitted(c, F.col("y") - F.col("cy")) + 0.5).alias(c) for c in "rgb"])


def fill_to_min_start(px: DataFrame, col: DataFrame, width: int = 30, limit: float = NEAR_MEAN) -> DataFrame:
    """image_id, x, y, r, g, b of the pixels from below the image's least start of sky down to each unmasked column's own start,
    by the local fit there, and of the pixels that those fits left out."""
    least = F.min("sos").over(Window.partitionBy("image_id"))
    todo = col.filter("column_mask = 0").withColumn("least", least).filter("sos > least").select("image_id", F.col("x").alias("cx"), F.col("sos").alias("cy"), "least")
    fits = saved(local_fits(px, col, todo, width, limit=limit), "fits")
    rows = fits.join(dealt(todo), ["image_id", "cx", "cy"]).withColumn("y", F.explode(F.expr("sequence(least + 1, cy)")))
    filled = rows.select("image_id", F.col("cx").alias("x"), "y", *[whole(fitted(c, F.col("y") - F.col("cy")) + 0.5).alias(c) for c in "rgb"])
    return filled.unionByName(repaired(px, col, fits, limit=limit).join(dealt(filled.select("image_id", "x", "y")), ["image_id", "x", "y"], "left_anti"))


def repair_outlier_pixels(px: DataFrame, col: DataFrame, width: int = 5, limit: float = NEAR_MEAN) -> DataFrame:
    """image_id, x, y, r, g, b of repaired pixels: local fits on a grid of `width` over the top half of the sky, where the sky of
    all columns within `width` (neither masked nor of a repair mask) overlaps, and the pixels that they left out."""
    free = col.filter("column_mask = 0" + (" AND repair_mask = 0" if "repair_mask" in col.columns else ""))
    last = F.max("x").over(Window.partitionBy("image_id"))
    c = col.select("image_id", "x", last.alias("last")).join(dealt(free.select("image_id", "x", "sos", "eos")), ["image_id", "x"])
    c = c.withColumn("cx", F.explode(F.array(*[((F.floor(F.col("x") / width) + k) * width).cast("int") for k in (-1, 0, 1)]))).filter(F.abs(F.col("cx") - F.col("x")) <= width)
    c = c.filter(f"cx >= {width} AND cx < last + 1 - 5").groupBy("image_id", "cx").agg(F.max("sos").alias("y0"), F.min("eos").alias("y1"))
    c = c.withColumn("from", F.floor((F.col("y0") + F.col("y1")) / 2).cast("int") - width).filter("from > y0")
    places = c.select("image_id", "cx", F.explode(F.expr(f"sequence(from, y0 + 1, -{width})")).alias("cy"))
    return repaired(px, col, local_fits(px, col, places, width, limit=limit), limit=limit)


def clean_vertical_edges(px: DataFrame, col: DataFrame, width: int = 2, limit: float = NEAR_MEAN) -> DataFrame:
    """image_id, x, y, r, g, b of the pixels beside transparent ones that differ from those around: local fits, without a second
    try, at the transparent pixel left of one that is not and at the one left of a transparent one, in the rows between the
    image's least and largest start of sky. Fits see all of the sky, as it came."""
    c = col.select("image_id", "x", "column_mask", of_image(F.min("sos")).alias("first"), of_image(F.max("sos")).alias("last"))
    d = px.join(dealt(c), ["image_id", "x"]).filter("y BETWEEN first AND last")
    d = d.withColumns({"clear": F.col("a") < 16384, "next": F.lead(F.struct("x", (F.col("a") < 16384).alias("clear"), "column_mask")).over(by_row())})
    d = d.filter("next.x = x + 1 AND clear <> next.clear").filter("CASE WHEN clear THEN next.column_mask ELSE column_mask END = 0")
    places = d.select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    return repaired(px, col, local_fits(px, col, places, width, clip_end=False, retry=False, limit=limit), clip_end=False, limit=limit)


def fill_side_edges(px: DataFrame, col: DataFrame, share: int = 40, limit: float = NEAR_MEAN) -> DataFrame:
    """image_id, x, y, r, g, b of the pixels outside the first or last seen pixel of a row (opaque and not black), where that one
    stands within the outer 1 / share of the image's width: the local fit at it, drawn on to the side. The rows are those
    between the least and the largest start of those columns, the fits ten times as wide as the gap, 20 at most, of every
    second pixel. Masked columns stay; rows without a seen pixel there, or without a fit, give none."""
    c = col.withColumn("w", of_image(F.max("x")) + 1).withColumn("band", F.floor(F.col("w") / share).cast("int"))
    out = []
    for left in (True, False):
        outer = c.filter("x < band" if left else "x >= w - 1 - band").filter("band > 0")
        outer = outer.select("image_id", "x", "w", "band", of_image(F.min("sos")).alias("first"), of_image(F.max("sos")).alias("last"))
        d = px.join(dealt(outer), ["image_id", "x"]).filter("y BETWEEN first AND last").filter("x < band" if left else "x > w - 1 - band")
        good = (F.min if left else F.max)(F.when(is_seen(), F.col("x")))
        ends = d.groupBy("image_id", "w", "y").agg(good.alias("cx")).filter("cx IS NOT NULL").withColumn("gap", F.col("cx") if left else F.col("w") - F.col("cx"))
        ends = ends.filter("gap > 0" if left else "gap > 1")
        out.append(ends.select("image_id", "cx", F.col("y").alias("cy"), F.least(F.lit(20), F.col("gap") * 10).cast("int").alias("width"), F.expr("sequence(0, cx - 1)" if left else "sequence(cx + 1, w - 1)").alias("xs")))
    todo = saved(out[0].unionByName(out[1]), "sides")
    rows = local_fits(px, col, todo, step=2, limit=limit).drop("width").join(dealt(todo), ["image_id", "cx", "cy"]).withColumn("x", F.explode("xs"))
    rows = rows.join(dealt(col.filter("column_mask = 0").select("image_id", "x")), ["image_id", "x"])
    return rows.select("image_id", "x", F.col("cy").alias("y"), *[whole(fitted(c, 0, F.col("x") - F.col("cx"))).alias(c) for c in "rgb"])


def overhang_holes(px: DataFrame, col: DataFrame) -> DataFrame:
    """(image_id, at, x0, x1, y0, y1, px1, py1, px2, py2, px3, py3): the holes beneath overhanging sky, one for a place `at` where
    the start of sky steps by more than one row to the column at + 1.

    In the rows between both starts, seen pixels (opaque and not black) are looked for away from the step, beneath the
    higher start; the farthest of these first ones (ties: the highest) ends the hole. Steps next to which all rows are
    seen have no hole; nor have those, looking to the right, with a row that is unseen up to the image's side (looking to
    the left, such rows and column 0 count for nothing). A hole has columns x0 .. x1 and rows y0 .. y1, and three
    corners: its end and the starts on both sides of the step.
    """
    ahead = F.lead(F.struct("x", "sos")).over(by_x())
    c = col.select("image_id", "x", "sos", "column_mask", ahead.alias("n")).filter("n.x = x + 1 AND column_mask = 0 AND abs(n.sos - sos) > 1")
    c = c.select("image_id", F.col("x").alias("at"), (F.col("n.sos") > F.col("sos")).alias("left"), F.least("sos", "n.sos").alias("top"), F.greatest("sos", "n.sos").alias("bottom"))
    c = saved(c, "steps")
    rows = c.groupBy("image_id").agg(F.min("top").alias("first"), F.max("bottom").alias("last"))
    d = px.join(dealt(col.select("image_id", "x").join(rows, "image_id")), ["image_id", "x"]).filter("y > first AND y < last").withColumn("seen", F.when(is_seen(), F.col("x")))
    inner = F.when(F.col("x") > 0, F.col("seen"))
    d = d.withColumns({"to_left": F.last(inner, True).over(by_row().rowsBetween(Window.unboundedPreceding, 0)), "to_right": F.first("seen", True).over(by_row().rowsBetween(0, Window.unboundedFollowing))})
    todo = c.withColumn("x", F.when(F.col("left"), F.col("at")).otherwise(F.col("at") + 1)).withColumn("y", F.explode(F.expr("sequence(top + 1, bottom - 1)")))
    d = dealt(todo).join(d.select("image_id", "x", "y", "to_left", "to_right"), ["image_id", "x", "y"])
    d = d.withColumn("end", F.when(F.col("left"), F.col("to_left")).otherwise(F.col("to_right")))
    farthest = F.when(F.col("left"), -F.col("end")).otherwise(F.col("end"))
    holes = d.groupBy("image_id", "at", "left", "top", "bottom").agg(F.max_by(F.struct("end", "y"), F.when(F.col("end").isNotNull(), F.struct(farthest, -F.col("y")))).alias("m"), F.count_if(F.col("end").isNull()).alias("open"))
    holes = holes.filter("m.end IS NOT NULL AND (left OR open = 0)").filter("CASE WHEN left THEN m.end < at ELSE m.end > at + 1 END")
    left = F.col("left")
    return holes.select(
        "image_id", "at",
        F.when(left, F.col("m.end") + 1).otherwise(F.col("at") + 1).alias("x0"), F.when(left, F.col("at")).otherwise(F.col("m.end") - 1).alias("x1"),
        (F.col("top") + 1).alias("y0"), (F.col("bottom") - 1).alias("y1"),
        F.col("m.end").alias("px1"), F.col("m.y").alias("py1"),
        F.col("at").alias("px2"), F.when(left, F.col("top")).otherwise(F.col("bottom")).alias("py2"),
        (F.col("at") + 1).alias("px3"), F.when(left, F.col("bottom")).otherwise(F.col("top")).alias("py3"),
    )


def fill_overhang_holes(px: DataFrame, col: DataFrame, width: int = 30, limit: float = NEAR_MEAN) -> DataFrame:
    """image_id, x, y, r, g, b of the unseen pixels in overhang_holes(): the local fits at the hole's three corners, by barycentric
    weights; and of the pixels that those fits left out. A pixel of several holes belongs to the leftmost one; holes
    without a fit at each corner, or whose corners lie on one line, stay. All fits see the pixels as they came."""
    holes = saved(overhang_holes(px, col), "holes")
    corner = F.explode(F.array(*[F.struct(F.col(f"px{k}").alias("cx"), F.col(f"py{k}").alias("cy")) for k in (1, 2, 3)])).alias("c")
    fits = saved(local_fits(px, col, holes.select("image_id", corner).select("image_id", "c.cx", "c.cy"), width, clip_end=False, limit=limit), "fits")
    d = holes
    for k in (1, 2, 3):
        of = fits.select("image_id", F.col("cx").alias(f"px{k}"), F.col("cy").alias(f"py{k}"), *[F.col(f"coef_{c}").alias(f"coef_{k}{c}") for c in "rgb"])
        d = d.join(of, ["image_id", f"px{k}", f"py{k}"])
    d = d.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    d = dealt(d).join(px.filter(~is_seen()).select("image_id", "x", "y"), ["image_id", "x", "y"])
    corners = [(F.col(f"px{k}"), F.col(f"py{k}")) for k in (1, 2, 3)]
    of = lambda c: [F.expr(f"coef_{k}{c}[0] + coef_{k}{c}[1] * (x - px{k}) + coef_{k}{c}[2] * (y - py{k}) + coef_{k}{c}[3] * (y - py{k}) * (y - py{k})") for k in (1, 2, 3)]
    blend = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(65535.0), barycentric_blend(F.col("x"), F.col("y"), corners, of(c)) + 0.5))
    new = F.struct(*[whole(blend(c)).alias(c) for c in "rgb"])
    filled = d.groupBy("image_id", "x", "y").agg(F.min_by(new, "at").alias("new")).filter("new.r IS NOT NULL").select("image_id", "x", "y", "new.*")
    return filled.unionByName(repaired(px, col, fits, clip_end=False, limit=limit).join(dealt(filled.select("image_id", "x", "y")), ["image_id", "x", "y"], "left_anti"))


def forecast_weights(height: int, back: int = 10, ahead: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Matrices that turn `back` + `ahead` values down a column into residuals of the fit and errors of the forecast.

    1, py and exp(py) span the same functions wherever the window lies, so one pair of matrices holds for every row.
    """
    k = np.arange(back + ahead) / height
    x = np.stack([np.ones_like(k), k, np.exp(k)], axis=1)
    q, r = np.linalg.qr(x[:back])
    residuals = np.hstack([np.eye(back) - q @ q.T, np.zeros((back, ahead))])
    errors = np.hstack([-x[back:] @ np.linalg.solve(r, q.T), np.eye(ahead)])
    return residuals, errors


def forecast_ratio(px: DataFrame, height: int, back: int = 10, ahead: int = 2, value: Column | None = None) -> DataFrame:
    """(image_id, x, y, rmse, rmse_next, ratio): how badly the regression of the previous `back` values (grey unless given)
    on (1, py, exp(py)) forecasts the values of rows y .. y + ahead - 1, against its own error. Columns and one bounded
    window only. Rows without a whole window are left out; a fit without error has a null ratio.
    """
    d = px.withColumn("_v", (F.col("r") + F.col("g") + F.col("b")) / 3.0 / 65535.0 if value is None else value)
    w = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-back, ahead - 1)
    d = d.withColumn("_w", F.collect_list("_v").over(w)).filter(F.size("_w") == back + ahead)
    dot = lambda row: sum(float(c) * F.col("_w")[i] for i, c in enumerate(row) if c)
    rms = lambda m: F.sqrt(sum(F.pow(dot(row), F.lit(2.0)) for row in m) / float(len(m)))
    residuals, errors = forecast_weights(height, back, ahead)
    d = d.select("image_id", "x", "y", rms(residuals).alias("rmse"), rms(errors).alias("rmse_next"))
    return d.withColumn("ratio", F.col("rmse_next") / F.nullif(F.col("rmse"), F.lit(0.0)))

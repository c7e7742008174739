"""Operators on columns of pixels and on the table of columns; windows are partitioned by image and column or row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import model
from ..functions.color import TRANSPARENT, is_black, is_nonblack, luma709, rgb_to_hsv
from ..functions.keys import dealt, of_image


def by_y():
    return Window.partitionBy("image_id", "x").orderBy("y")


def by_x():
    return Window.partitionBy("image_id").orderBy("x")


def by_row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def start_of_sky(px: DataFrame, masks: DataFrame, height: int) -> DataFrame:
    """(image_id, x, raw_sos, eos): the first row that is not black (0 if none); masked columns end at 0, others at the bottom."""
    first = px.groupBy("image_id", "x").agg(F.coalesce(F.min(F.when(is_nonblack(), F.col("y"))), F.lit(0)).alias("raw_sos"))
    masked = masks.filter("kind = 'column'").select("image_id", F.explode(F.sequence("l", "r")).alias("x")).distinct().withColumn("m", F.lit(True))
    return first.join(dealt(masked), ["image_id", "x"], "left").select("image_id", "x", "raw_sos", F.when(F.col("m"), 0).otherwise(height - 1).alias("eos"))


def sky_extent(col: DataFrame, height: int) -> DataFrame:
    d = col.groupBy("image_id").agg(F.min("sos").alias("min_sos"), F.max("sos").alias("max_sos"), F.min("eos").alias("min_eos"), F.max("eos").alias("max_eos"))
    return d.withColumn("lowest_py", 1 - F.col("max_eos") / (height - 1))


def dilate_start(col: DataFrame, width: int) -> DataFrame:
    """Adds sos: the largest raw start within 4 columns and 4 more; near an edge the own start and up to 4 more."""
    inner = F.max("raw_sos").over(by_x().rowsBetween(-4, 4)) + 4
    edge = F.least(F.col("x"), width - 1 - F.col("x"))
    return col.withColumn("sos", F.when(edge < 9, F.col("raw_sos") + F.floor(4 * edge / 9 + 0.5)).otherwise(inner).cast("int"))


def local_scan_start(col: DataFrame) -> DataFrame:
    """Adds scan_y: 10 rows below the largest raw start of the unmasked columns within 20."""
    return col.withColumn("scan_y", F.max(F.when(F.col("column_mask") == 0, F.col("raw_sos"))).over(by_x().rowsBetween(-20, 20)) + 10)


def column_band_stats(px: DataFrame) -> DataFrame:
    """Mean hue, saturation and luma of the 5 rows up to y against the next 3, and their absolute differences; the hue
    difference weighs by the mean saturation."""
    d = px.withColumn("hsv", rgb_to_hsv("r", "g", "b")).withColumn("luma", (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")) / 65535)
    above, below = by_y().rowsBetween(-4, 0), by_y().rowsBetween(1, 3)
    mean = lambda c, w: F.avg(c).over(w)
    return d.select("image_id", "x", "y", (F.abs(mean("hsv.h", above) - mean("hsv.h", below)) * mean("hsv.s", above)).alias("dh"), F.abs(mean("hsv.s", above) - mean("hsv.s", below)).alias("ds"), F.abs(mean("luma", above) - mean("luma", below)).alias("dv"))


def first_band_failure(stats: DataFrame, h_tol: float = 360.0, s_tol: float = 0.3, v_tol: float = 0.015, from_y: int = 6) -> DataFrame:
    """(image_id, x, end_y): the first row whose bands differ by more than a tolerance."""
    bad = (F.col("y") >= from_y) & ((F.col("dh") > h_tol) | (F.col("ds") > s_tol) | (F.col("dv") > v_tol))
    return stats.groupBy("image_id", "x").agg(F.min(F.when(bad, F.col("y"))).alias("end_y"))


def end_of_sky_scan(px: DataFrame, col: DataFrame, h_tol: float = 360.0, s_tol: float = 0.3, v_tol: float = 0.015, rects: DataFrame | None = None) -> DataFrame:
    """(image_id, x, eos): from scan_y down, the first row whose bands part by more than a tolerance, then on while the
    difference of luma still grows, then the sharpest step near it. Rows in a rectangle (l, r, t, b) never end a column;
    columns without an end keep their old one, masked columns too."""
    stats = column_band_stats(px).withColumns({c: F.round(c, 9) for c in ("dh", "ds", "dv")})  # sums in another order tell nothing
    stats = stats.join(dealt(local_scan_start(col).select("image_id", "x", "scan_y")), ["image_id", "x"])
    bad = (F.col("y") >= F.col("scan_y")) & ((F.col("dh") > h_tol) | (F.col("ds") > s_tol) | (F.col("dv") > v_tol))
    if rects is not None:
        at = rects.select("image_id", "t", "b", F.explode(F.sequence("l", "r")).alias("x"))
        inside = px.join(dealt(at), ["image_id", "x"]).filter("y BETWEEN t AND b").select("image_id", "x", "y").distinct().withColumn("in_rect", F.lit(True))
        stats = stats.join(dealt(inside), ["image_id", "x", "y"], "left")
        bad &= F.col("in_rect").isNull()
    stats = stats.withColumns({"bad": bad, "grows": F.coalesce(F.lead("dv").over(by_y()) > F.col("dv"), F.lit(False))})
    stats = stats.withColumn("begun", F.max(F.col("bad").cast("int")).over(by_y().rowsBetween(Window.unboundedPreceding, 0)))
    first = stats.groupBy("image_id", "x").agg(F.min(F.when((F.col("begun") == 1) & ~F.col("grows"), F.col("y"))).alias("found"))
    rough = col.join(dealt(first), ["image_id", "x"], "left").withColumn("old", F.col("eos")).withColumn("eos", F.coalesce("found", "eos"))
    sharp = hires_end(px, rough, v_tol)
    keep = F.col("found").isNull() | (F.col("column_mask") == 1)
    return rough.join(dealt(sharp), ["image_id", "x"], "left").select("image_id", "x", F.when(keep, F.col("old")).otherwise(F.coalesce("hires_eos", "eos")).cast("int").alias("eos"))


def find_end_of_sky(ends: DataFrame, col: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, x, eos, lowest_py): a detector's ends (image_id, x, eos) without slivers and steeper steps than two rows a
    column; lowest_py is the image's."""
    d = col.drop("eos").join(dealt(ends), ["image_id", "x"])
    d = fix_slivers(d, width).drop("eos").withColumnRenamed("fixed_eos", "eos")
    d = clamp_slope(d).drop("eos").withColumnRenamed("clamped_eos", "eos")
    return d.join(sky_extent(d, height).select("image_id", "lowest_py"), "image_id").select("image_id", "x", F.col("eos").cast("int").alias("eos"), "lowest_py")


def hires_end(px: DataFrame, col: DataFrame, val_tol: float = 0.015) -> DataFrame:
    """(image_id, x, hires_eos): near the end, the first row where the means of 3 rows before and after part; two rows on."""
    above, below = by_y().rowsBetween(-3, -1), by_y().rowsBetween(1, 3)
    step = sum(F.abs(F.avg(c).over(above) - F.avg(c).over(below)) for c in "rgb")
    d = px.withColumn("step", step).join(dealt(col.select("image_id", "x", "eos")), ["image_id", "x"]).filter("y BETWEEN eos - 10 AND eos + 9")
    return d.groupBy("image_id", "x").agg((F.coalesce(F.min(F.when(F.col("step") > val_tol / 0.015 * 4000, F.col("y"))), F.first("eos")) + 2).alias("hires_eos"))


def contrast_end(px: DataFrame, col: DataFrame, reach: int = 20) -> DataFrame:
    """(image_id, x, contrast_eos): within `reach` rows of the end, the row with the largest contrast of 20-row bands."""
    above, below = by_y().rowsBetween(-21, -2), by_y().rowsBetween(1, 20)
    metric = F.lit(0.0)
    ss = F.lit(0.0)
    for c in "rgb":
        metric += F.abs(F.avg(c).over(above) - F.avg(c).over(below))
        ss += F.coalesce(F.var_pop(F.col(c).cast("double")).over(above), F.lit(0.0)) * F.count(c).over(above)
    d = px.withColumn("metric", F.round(metric + 1 / (ss + 1), 3)).join(dealt(col.select("image_id", "x", "eos")), ["image_id", "x"])
    d = d.filter((F.abs(F.col("y") - F.col("eos")) <= reach) & F.col("metric").isNotNull())
    return d.groupBy("image_id", "x").agg(F.max_by("y", F.struct("metric", -F.col("y"))).alias("contrast_eos"))


def fix_slivers(col: DataFrame, width: int, dip: int = 10) -> DataFrame:
    """Adds fixed_eos: ends of one, two or three columns that lie more than `dip` rows above those on either side become the
    mean of the two. Masked columns take no part. All tests read the old ends; where fixes overlap, the later column's wins."""
    at = lambda c, k: (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(by_x())
    d = col.withColumns({"e0": at("eos", -1), "m0": at("column_mask", -1)} | {f"e{k}": at("eos", k) for k in (1, 2, 3)} | {f"m{k}": at("column_mask", k) for k in (1, 2, 3)})
    start = (F.col("x") < width - 3) & (F.col("column_mask") == 0) & (F.col("m0") == 0) & (F.col("e0") - F.col("eos") > dip)
    kind = F.coalesce(*[F.when(F.col(f"e{k}") - F.col("eos") > dip, k) for k in (1, 2, 3)])
    mask = F.coalesce(*[F.when(F.col(f"e{k}") - F.col("eos") > dip, F.col(f"m{k}")) for k in (1, 2, 3)])
    end = F.coalesce(*[F.when(F.col(f"e{k}") - F.col("eos") > dip, F.col(f"e{k}")) for k in (1, 2, 3)])
    d = d.withColumn("sliver", F.when(start & (mask == 0), F.struct(kind.alias("n"), F.floor((F.col("e0") + end) / 2).cast("int").alias("v"))))
    d = d.withColumns({"s1": F.lag("sliver").over(by_x()), "s2": F.lag("sliver", 2).over(by_x())})
    fixed = F.coalesce("sliver.v", F.when(F.col("s1.n") >= 2, F.col("s1.v")), F.when(F.col("s2.n") == 3, F.col("s2.v")), "eos")
    return d.select(*col.columns, fixed.cast("int").alias("fixed_eos"))


def clamp_slope(col: DataFrame, step: int = 2) -> DataFrame:
    """Adds clamped_eos: ends rise by at most `step` a column in either direction, in runs between masked columns; not above sos.

    The two passes are running minima of end - step*x and end + step*x, so no row waits for another.
    """
    run = F.sum("column_mask").over(by_x().rowsBetween(Window.unboundedPreceding, 0))
    w = Window.partitionBy("image_id", "run", "column_mask").orderBy("x")
    d = col.withColumn("run", run)
    d = d.withColumn("e", F.min(F.col("eos") - step * F.col("x")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + step * F.col("x"))
    d = d.withColumn("e", F.min(F.col("e") + step * F.col("x")).over(w.rowsBetween(0, Window.unboundedFollowing)) - step * F.col("x"))
    return d.withColumn("clamped_eos", F.when(F.col("column_mask") == 1, F.col("eos")).otherwise(F.greatest("e", "sos"))).drop("run", "e")


def t_profile(px: DataFrame, col: DataFrame, height: int, reach: int = 10, near: float = 0.02) -> DataFrame:
    """(image_id, x, y, p): the `reach` rows above against the row itself, by the largest one-value t statistic of the channels:
    1 - min(1, .1 ln(1 + t)). A colour within `near` counts of the mean above has that distance in place of t. Rows from
    `reach` below the raw start down to `reach` above the bottom."""
    above = by_y().rowsBetween(-reach, -1)
    d = px.join(dealt(col.select("image_id", "x", "raw_sos")), ["image_id", "x"])
    t, dist = [], F.lit(0.0)
    for c in "rgb":
        off = F.abs(F.avg(c).over(above) - F.col(c))
        error = F.stddev_samp(F.col(c).cast("double")).over(above) / F.sqrt(F.count(c).over(above))
        t.append(F.when(error > 0, off / F.nullif(error, F.lit(0.0))).when(off > 0, float("inf")).otherwise(0.0))
        dist = dist + off * off
    d = d.withColumns({"t": F.greatest(*t), "dist": F.sqrt(dist)})
    d = d.filter((F.col("y") >= F.greatest(F.lit(reach), F.col("raw_sos") + reach)) & (F.col("y") < height - reach))
    worst = F.when(F.col("dist") < near, F.col("dist")).otherwise(F.col("t"))
    return d.select("image_id", "x", "y", (1 - F.least(F.lit(1.0), 0.1 * F.log(1 + worst))).alias("p"))


def ar_forecasts(px: DataFrame, col: DataFrame, height: int, window: int = 20) -> DataFrame:
    """(image_id, x, y, n, err2, mse): how badly each row's mean colour is forecast from those one and one and a half windows
    above it.

    Colours (0..1) are means of the column and its neighbours over the window around the row. They are regressed on the two
    above, channel by channel and without an intercept, over the 5 * window rows before; err2 and mse are means over the
    channels, mse grows by (4 / n)^10 while the n rows fitted are fewer than 4. Rows start where the upper of the two lies
    half a window below the raw start. Windows of bounded width only; three equations of two unknowns by closed form.
    """
    half = window // 2
    near, span = by_row().rangeBetween(-1, 1), by_y().rangeBetween(-half, half - 1)
    d = px.join(dealt(col.select("image_id", "x", "raw_sos")), ["image_id", "x"]).withColumn("_n", F.count("*").over(near))
    d = d.withColumns({f"_{c}": F.sum(F.col(c) / 65535.0).over(near) for c in "rgb"})
    d = d.withColumns({f"_{c}": F.sum(f"_{c}").over(span) / F.sum("_n").over(span) for c in "rgb"})
    d = d.filter((F.col("y") >= F.col("raw_sos") + half) & (F.col("y") < height - 1 - window))
    use = F.col("y") >= F.col("raw_sos") + half + window + half
    back = by_y().rangeBetween(-5 * window, -1)
    d = d.withColumn("n", F.count_if(use).over(back))
    err2, mse = F.lit(0.0), F.lit(0.0)
    for c in "rgb":
        lag = lambda k: F.lag(f"_{c}", k).over(by_y())  # noqa: B023, E731
        d = d.withColumns({"_u": F.when(use, lag(window + half)), "_v": F.when(use, lag(window)), "_s": F.when(use, F.col(f"_{c}"))})
        d = d.withColumns({f"{i}{j}": F.sum(F.col(f"_{i}") * F.col(f"_{j}")).over(back) for i, j in ("uu", "uv", "vv", "us", "vs", "ss")})
        det = F.nullif(F.expr("uu * vv - uv * uv"), F.lit(0.0))
        d = d.withColumns({"b0": F.expr("vv * us - uv * vs") / det, "b1": F.expr("uu * vs - uv * us") / det})
        d = d.withColumns({f"e{c}": F.pow(F.expr("b0 * _u + b1 * _v - _s"), F.lit(2.0)), f"m{c}": F.expr("(ss - b0 * us - b1 * vs) / n")})
        err2, mse = err2 + F.col(f"e{c}") / 3, mse + F.col(f"m{c}") / 3
    few = F.when(F.col("n") < 4, F.pow(4.0 / F.nullif("n", F.lit(0)), F.lit(10.0))).otherwise(1.0)
    return d.filter(use).select("image_id", "x", "y", "n", err2.alias("err2"), (mse * few).alias("mse"))


def ar_end(px: DataFrame, col: DataFrame, height: int, window: int = 20, alpha: float = 0.02, beta: float = 10.0) -> DataFrame:
    """(image_id, x, found, eos): the first row whose colour breaks with ar_forecasts(): its squared error is over beta times the
    mean square of the fit (of three rows at least) and over alpha^2. The end is a window above it, or above the old end
    where no row breaks, and 20 rows below the raw start at least."""
    d = ar_forecasts(px, col, height, window)
    breaks = (F.col("n") > 2) & (F.col("err2") > beta * F.col("mse")) & (F.col("err2") > alpha * alpha)
    first = d.groupBy("image_id", "x").agg(F.min(F.when(breaks, F.col("y"))).alias("found"))
    d = col.select("image_id", "x", "raw_sos", "eos").join(dealt(first), ["image_id", "x"], "left")
    return d.select("image_id", "x", "found", F.greatest(F.coalesce("found", "eos") - window, F.col("raw_sos") + 20).cast("int").alias("eos"))


def emboss_rows(px: DataFrame) -> DataFrame:
    grey = 0.2 * F.col("r") + 0.2 * F.col("g") + 0.6 * F.col("b")
    d = px.withColumn("grey", grey)
    return d.withColumn("emboss", F.lag("grey", 2).over(by_y()) + F.lag("grey").over(by_y()) - F.lead("grey").over(by_y()) - F.lead("grey", 2).over(by_y()) + 0.5)


def sobel_strength(px: DataFrame) -> DataFrame:
    """Adds sobel: gradient magnitude summed over channels; borders are null."""
    d, out = px, F.lit(0.0)
    for c in "rgb":
        d = d.withColumns({f"{c}_s": (F.lag(c).over(by_row()) + 2 * F.col(c) + F.lead(c).over(by_row())).cast("double"), f"{c}_d": (F.lead(c).over(by_row()) - F.lag(c).over(by_row())).cast("double")})
    for c in "rgb":
        gy = F.lead(f"{c}_s").over(by_y()) - F.lag(f"{c}_s").over(by_y())
        gx = F.lag(f"{c}_d").over(by_y()) + 2 * F.col(f"{c}_d") + F.lead(f"{c}_d").over(by_y())
        out += F.sqrt(gx * gx + gy * gy)
    return d.withColumn("sobel", out).drop(*[f"{c}_{k}" for c in "rgb" for k in "sd"])


def horizontal_smooth(px: DataFrame, col: DataFrame, reach: int = 50) -> DataFrame:
    """Adds means along rows over the unmasked columns from x - reach to x + reach - 1, for rows above the highest sky end of
    the image; other rows are left out."""
    c = col.select("image_id", "x", "column_mask", of_image(F.min(F.when(F.col("column_mask") == 0, F.col("eos")))).alias("lowest"))
    d = px.join(dealt(c), ["image_id", "x"]).filter(F.col("y") < F.col("lowest"))
    w = by_row().rangeBetween(-reach, reach - 1)
    return d.withColumns({f"{c}_smooth": F.avg(F.when(F.col("column_mask") == 0, F.col(c))).over(w) for c in "rgb"}).drop("lowest", "column_mask")


def seam_smooth(px: DataFrame, col: DataFrame, n: int = 3) -> DataFrame:
    """Pixels within n rows of the start of sky become the mean of the (2n+1)^2 pixels around, of unmasked columns and not
    below their sky end: sums down columns, then along rows. Masked columns and other rows stay."""
    d = px.join(dealt(col.select("image_id", "x", "sos", "eos", "column_mask")), ["image_id", "x"])
    counts = (F.col("column_mask") == 0) & (F.col("y") <= F.col("eos"))
    down, across = by_y().rangeBetween(-n, n), by_row().rangeBetween(-n, n)
    d = d.withColumns({f"{c}_1": F.sum(F.when(counts, F.col(c))).over(down) for c in "rgb"} | {"n_1": F.count_if(counts).over(down)})
    d = d.withColumns({f"{c}_2": F.floor(F.sum(f"{c}_1").over(across) / F.nullif(F.sum("n_1").over(across), F.lit(0)) + 0.5) for c in "rgb"})
    near = counts & (F.col("y") >= F.col("sos") - n) & (F.col("y") < F.col("sos") + n)
    return d.select("image_id", "x", "y", *[F.when(near, F.col(f"{c}_2")).otherwise(F.col(c)).cast("int").alias(c) for c in "rgb"], "a")


def box_smooth(px: DataFrame, dx: int = 4, dy: int = 6) -> DataFrame:
    """Mean over a box: sums along rows, then sums of those along columns, so no neighbour is joined."""
    across, down = by_row().rangeBetween(-dx, dx), by_y().rangeBetween(-dy, dy)
    d = px.withColumns({f"{c}_1": F.sum(c).over(across) for c in "rgb"} | {"n_1": F.count("*").over(across)})
    return d.withColumns({f"{c}_box": F.sum(f"{c}_1").over(down) / F.sum("n_1").over(down) for c in "rgb"}).drop("r_1", "g_1", "b_1", "n_1")


def box_filter(px: DataFrame, col: DataFrame, dx: int = 4, dy: int = 6, passes: int = 2, depth: float = 1.0, extra: int = 0, factor: float = 1.0, exponent: float = 1.0) -> DataFrame:
    """px with the filled sky smoothed: above the last row of a column's fill, pixels are pulled by the feather from the raw
    start to the mean of the box around, once a pass, rounded. Of the box, the unmasked columns count, in the rows down to the
    own column's last one, which stands the feather's length below the start of sky (not above the raw start, not below the
    image). Masked columns stay. col: raw_sos, sos, eos, column_mask.

    Sums along rows, then down the own column, so no neighbour is joined and the box ends where the column's fill does.
    """
    d = px.join(dealt(col.select("image_id", "x", "raw_sos", "sos", "eos", "column_mask")), ["image_id", "x"])
    d = d.withColumn("n", model.feather_length(F.col("sos"), F.col("eos"), depth, extra, from_row=F.col("raw_sos")))
    low = F.max("y").over(Window.partitionBy("image_id", "x"))
    d = d.withColumn("last", F.least(F.greatest(F.col("sos") + F.col("n"), "raw_sos"), low))
    counts, inside = F.col("column_mask") == 0, F.col("y") <= F.col("last")
    across, down = by_row().rangeBetween(-dx, dx), by_y().rangeBetween(-dy, dy)
    for _ in range(passes):
        d = d.withColumns({f"{c}_1": F.sum(F.when(counts, F.col(c))).over(across) for c in "rgb"} | {"n_1": F.count_if(counts).over(across)})
        n = F.sum(F.when(inside, F.col("n_1"))).over(down)
        d = d.withColumns({f"{c}_1": F.floor(F.sum(F.when(inside, F.col(f"{c}_1"))).over(down) / F.nullif(n, F.lit(0)) + 0.5) for c in "rgb"})
        d = d.withColumn("w", model.raw_feather_weight(F.col("y"), F.col("raw_sos"), F.col("n"), F.col("b"), factor, exponent))
        new = {c: F.floor(F.col("w") * F.col(f"{c}_1") + (1 - F.col("w")) * F.col(c) + 0.5).cast("int") for c in "rgb"}
        d = d.withColumns({c: F.when(counts & (F.col("y") < F.col("last")), v).otherwise(F.col(c)) for c, v in new.items()})
    return d.select(*px.columns)


def row_extents(col: DataFrame, flag: int) -> DataFrame:
    """(image_id, x, sos, eos, y0, y1): columns with the rows of their image that even_out_rows() works on."""
    first = of_image(F.min("sos")) if flag == 2 else F.lit(0)
    last = of_image(F.max("sos") if flag == 1 else F.max("eos"))
    return col.select("image_id", "x", "sos", "eos", first.cast("int").alias("y0"), last.cast("int").alias("y1"))


def row_means(px: DataFrame, col: DataFrame, flag: int = 0) -> DataFrame:
    """(image_id, y, mean_r, mean_g, mean_b, n): means over the columns that are still sky in that row.

    flag 0: from the top to the lowest end of sky; 1: from the top to the lowest start; 2: from the highest start to the
    lowest end, of columns whose sky has begun.
    """
    d = px.join(dealt(row_extents(col, flag)), ["image_id", "x"])
    d = d.filter("y BETWEEN y0 AND y1 AND y <= eos" + (" AND y >= sos" if flag == 2 else ""))
    return d.groupBy("image_id", "y").agg(*[F.avg(c).alias(f"mean_{c}") for c in "rgb"], F.count("*").alias("n"))


def even_out_rows(px: DataFrame, col: DataFrame, flag: int = 0) -> DataFrame:
    """px with the sky's pixels pulled to their row's mean (see row_means()), opaque where they are.

    flag 0: fully at the top, not at all at the lowest end. flags 1 and 2: fully down to each column's start; from there
    (flag 2: from the middle of its sky) less and less down to its end. With flag 2 the sky then starts at row_extents().y0
    in every column. The row means are joined by (image, row).
    """
    means = row_means(px, col, flag).drop("n")
    d = px.join(dealt(row_extents(col, flag)), ["image_id", "x"]).join(means, ["image_id", "y"], "left")
    inside = F.col("y").between(F.col("y0"), F.col("y1")) & F.col("mean_r").isNotNull()
    if flag == 0:
        w = F.when(F.col("y") <= F.col("eos"), 1 - F.col("y") / F.nullif("y1", F.lit(0)))
    else:
        begin = F.col("sos").cast("double") if flag == 1 else (F.col("eos") + F.col("sos")) / 2
        w = 1 - (F.col("y") - begin) / F.nullif(F.col("eos") - begin, F.lit(0.0))
        w = F.when(F.col("y") <= F.col("sos"), 1.0).when(w > 0, w)
    d = d.withColumn("w", F.when(inside, w))
    mixed = lambda c: F.greatest(F.lit(0), F.least(F.lit(65535), F.floor(F.col("w") * F.col(f"mean_{c}") + (1 - F.col("w")) * F.col(c))))
    return d.select("image_id", "x", "y", *[F.when(F.col("w").isNull(), F.col(c)).otherwise(mixed(c)).cast("int").alias(c) for c in "rgb"], F.when(F.col("w").isNull(), F.col("a")).otherwise(65535).alias("a"))


def extend_end_by_class(px: DataFrame, col: DataFrame, reach: int = 5, certain: float = 0.75) -> DataFrame:
    """(image_id, x, extended_eos): the lowest pixel within `reach` of the end that is of the sky class or, where px has p_hat, is
    sky with more than that certainty; or the end. One round: what is found does not move the box."""
    d = px.join(dealt(col.select("image_id", "x", "eos")), ["image_id", "x"])
    sky = F.col("pixel_class").bitwiseAND(1) == 1
    if "p_hat" in px.columns:
        sky = sky | F.coalesce(F.col("p_hat") > certain, F.lit(False))
    hit = (F.abs(F.col("y") - F.col("eos")) <= reach) & sky
    return d.groupBy("image_id", "x").agg(F.greatest(F.max("eos"), F.max(F.when(hit, F.col("y")))).alias("extended_eos"))


def trim_halo(px: DataFrame, col: DataFrame) -> DataFrame:
    """Adds trimmed and final_eos: from the row before the end to two after it, a luma peak above both neighbours is scaled to
    the luma of the row before it, and the last such row is the final end. Transparent pixels below the raw start keep
    their colour. All tests read the old pixels. col: the columns whose fill reaches their end."""
    d = px.withColumn("l", luma709()).withColumns({"l0": F.lag("l").over(by_y()), "l2": F.lead("l").over(by_y())})
    d = d.join(dealt(col.select("image_id", "x", "raw_sos", "eos")), ["image_id", "x"])
    peak = F.col("y").between(F.col("eos") - 1, F.col("eos") + 2) & (F.col("l") > F.col("l0")) & (F.col("l") > F.col("l2"))
    d = d.withColumn("peak", F.coalesce(peak, F.lit(False)))
    scaled = F.col("peak") & ~((F.col("a") < 32767) & (F.col("y") > F.col("raw_sos")))
    final = F.coalesce(F.max(F.when(F.col("peak"), F.col("y"))).over(Window.partitionBy("image_id", "x")), F.col("eos"))
    return d.select("image_id", "x", "y", *[F.when(scaled, F.floor(F.col(c) * (F.col("l0") / F.col("l")) + 0.5)).otherwise(F.col(c)).cast("int").alias(c) for c in "rgb"], scaled.alias("trimmed"), final.alias("final_eos"))


def interpolate_masked_columns(px: DataFrame, col: DataFrame, masks: DataFrame) -> DataFrame:
    """Opaque pixels of masked columns, linear in x between the columns on both sides of a range, for the rows down to 10
    below the lowest start of sky of those columns. Ranges at an edge of the image give none."""
    m = masks.filter("kind = 'column'").select("image_id", F.col("l").alias("from_x"), F.col("r").alias("to_x"))
    rows = m.join(col.select("image_id", "x", "sos"), "image_id").filter("x BETWEEN from_x - 1 AND to_x").groupBy("image_id", "from_x", "to_x").agg((F.max("sos") + 10).alias("rows"))
    at = lambda x: px.join(dealt(rows.withColumn("x", x)), ["image_id", "x"]).filter(F.col("y") < F.col("rows"))
    inside = at(F.explode(F.sequence("from_x", "to_x"))).select("image_id", "x", "y", "from_x", "to_x")
    side = lambda x, p: at(F.expr(x)).select("image_id", "y", "from_x", *[F.col(c).alias(f"{p}{c}") for c in "rgb"])
    d = inside.join(side("from_x - 1", "a"), ["image_id", "y", "from_x"]).join(side("to_x + 1", "b"), ["image_id", "y", "from_x"])
    w = (F.col("x") - F.col("from_x") + 1) / (F.col("to_x") - F.col("from_x") + 3)
    return d.select("image_id", "x", "y", *[F.floor(F.col(f"a{c}") * (1 - w) + F.col(f"b{c}") * w).cast("int").alias(c) for c in "rgb"], F.lit(65535).alias("a"))


def clear_black_edges(px: DataFrame, col: DataFrame) -> DataFrame:
    """px with black pixels at the edges of the sky transparent, masked columns left as they are.

    Up from the raw start, black pixels are cleared until more than 10 others in a row have been passed. Then, in the rows
    from the highest to the lowest start, runs of black pixels right of a transparent one are cleared whole, from left to
    right until 10 columns have nothing to clear after one that had; and runs left of a transparent one from right to left.
    Masked columns end a run. Each of the three steps reads the pixels as the one before left them.
    """
    c = col.select("image_id", "x", "raw_sos", "column_mask", of_image(F.min("sos")).alias("low"), of_image(F.max("sos")).alias("high"))
    d = px.join(dealt(c), ["image_id", "x"])
    black, up = is_black() & (F.col("a") >= TRANSPARENT), Window.partitionBy("image_id", "x").orderBy(F.desc("y"))
    above = (F.col("y") < F.col("raw_sos")) & (F.col("y") > 0) & (F.col("column_mask") == 0)
    d = d.withColumns({"black": black, "above": above}).withColumn("good", (F.col("above") & ~F.col("black")).cast("int"))
    d = d.withColumn("passed", F.sum("good").over(up.rowsBetween(-11, 0)))
    ended = F.max("passed").over(up.rowsBetween(Window.unboundedPreceding, 0)) >= 12
    d = d.withColumn("a", F.when(F.col("above") & F.col("black") & ~ended, 0).otherwise(F.col("a")))
    band = d.filter("y BETWEEN low AND high")
    for side in (F.col("x"), F.desc("x")):
        before = Window.partitionBy("image_id", "y").orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
        upto = before.rowsBetween(Window.unboundedPreceding, 0)
        band = band.withColumn("run", F.col("black") & (F.col("a") >= TRANSPARENT) & (F.col("column_mask") == 0))
        beside = F.last(F.when(~F.col("run"), F.col("a") < TRANSPARENT), True).over(before)
        band = band.withColumn("hit", F.when(F.col("run") & F.coalesce(beside, F.lit(False)), F.col("x")))
        gap = F.abs(F.col("hit") - F.last("hit", True).over(before)) >= 10
        band = band.withColumn("gap", F.coalesce(gap, F.lit(False)))
        band = band.withColumn("a", F.when(F.col("hit").isNotNull() & ~F.max("gap").over(upto), 0).otherwise(F.col("a")))
    return band.select(*px.columns).unionByName(d.filter("y NOT BETWEEN low AND high").select(*px.columns))


def edge_suspects(px: DataFrame, reach: int = 2) -> DataFrame:
    """Partial alpha becomes 0 first; then pixels near a transparent one with a channel under an eighth of their largest."""
    d = px.withColumn("a", F.when(F.col("a") < 65535, 0).otherwise(F.col("a")))
    d = d.withColumn("low", F.min("a").over(by_row().rangeBetween(-reach, reach)))
    d = d.withColumn("low", F.min("low").over(by_y().rangeBetween(-reach, reach)))
    dark = F.least("r", "g", "b") * 8 < F.greatest("r", "g", "b")
    return d.withColumn("a", F.when((F.col("low") == 0) & dark, 0).otherwise(F.col("a"))).drop("low")

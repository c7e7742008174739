"""Samples of sky colour, their outliers, regressions from sums, and the search for sky luminance parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import rgb_to_hsv
from ..functions.geometry import luminance
from ..functions.keys import dealt
from ..sources.store import saved


def sample_grid_spec(col: DataFrame, width: int, height: int, samples: int = 1000, across: int = 100) -> DataFrame:
    """(image_id, n_rows, dx, dy) so that about `samples` points lie in the sky; steps are 1 at least."""
    mean = F.avg(F.col("eos") - F.col("sos"))
    n = F.floor(samples / across * height / F.nullif(mean, F.lit(0.0)) + 0.5)
    d = col.groupBy("image_id").agg(F.greatest(n, F.lit(1)).cast("int").alias("n_rows"))
    return d.withColumns({"dx": F.lit(max(1, width // across)), "dy": F.greatest(F.lit(1), F.floor(height / F.col("n_rows"))).cast("int")})


def sample_sky(px: DataFrame, col: DataFrame, spec: DataFrame, reach: int = 2) -> DataFrame:
    """Grid points from 6 rows above the end up to 3 below the start, each the mean and coefficient of variation of its
    5x5 opaque neighbours. A pixel meets only the at most 25 centres around it, by an equi-join."""
    c = col.join(spec, "image_id").filter("eos - 6 >= sos + 3").filter("x % dx = 0")
    centre = c.select("image_id", F.col("x").alias("cx"), F.explode(F.expr("sequence(eos - 6, sos + 3, -dy)")).alias("cy"))
    near = centre.select("*", F.explode(F.sequence(F.col("cx") - reach, F.col("cx") + reach)).alias("x")).select("*", F.explode(F.sequence(F.col("cy") - reach, F.col("cy") + reach)).alias("y"))
    d = dealt(near).join(px.filter("a >= 32767"), ["image_id", "x", "y"])
    cv = lambda k: F.coalesce(F.stddev_samp(F.col(k).cast("double")), F.lit(0.0)) / F.nullif(F.avg(k), F.lit(0.0))
    return d.groupBy("image_id", F.col("cx").alias("x"), F.col("cy").alias("y")).agg(*[F.floor(F.avg(k)).cast("int").alias(k) for k in "rgb"], *[F.coalesce(cv(k), F.lit(0.0)).alias(f"cv_{k}") for k in "rgb"])


def with_hsv(smp: DataFrame) -> DataFrame:
    return smp.withColumn("hsv", rgb_to_hsv("r", "g", "b")).select("*", "hsv.*").drop("hsv")


def image_sky_color(smp: DataFrame) -> DataFrame:
    w = 1 - F.col("s")
    return smp.groupBy("image_id").agg((F.sum(F.col("h") * w) / F.sum(w)).alias("h"), F.avg("s").alias("s"), (F.sum(F.col("v") * w) / F.sum(w)).alias("v"))


def close_neighbors(smp: DataFrame) -> DataFrame:
    """Adds n_close: other samples of the image with ds^2 + dv^2 < .005, ds^2 + dx^2 < .01 and dh^2 + dv^2 < 36.

    Samples are dealt into cells of the radius in saturation and px; one side is copied to the 9 cells around. They are
    written first, since they are read three times.
    """
    smp = saved(smp, "samples")
    a = smp.withColumns({"cs": F.floor(F.col("s") / 0.0708), "cx": F.floor(F.col("px") / 0.1)})
    b = a.select("image_id", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("h").alias("h2"), F.col("s").alias("s2"), F.col("v").alias("v2"), F.col("px").alias("px2"), "cs", "cx")
    b = b.withColumn("cs", F.explode(F.sequence(F.col("cs") - 1, F.col("cs") + 1))).withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)))
    sq = lambda p: F.pow(F.col(p) - F.col(f"{p}2"), F.lit(2.0))
    close = (sq("s") + sq("v") < 0.005) & (sq("s") + sq("px") < 0.01) & (sq("h") + sq("v") < 36) & ((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2")))
    n = a.join(dealt(b), ["image_id", "cs", "cx"]).filter(close).groupBy("image_id", "x", "y").agg(F.count("*").alias("n_close"))
    return smp.join(dealt(n), ["image_id", "x", "y"], "left").fillna(0, ["n_close"])


def flag_outliers(smp: DataFrame) -> DataFrame:
    """Adds is_outlier: fewer than 2 close neighbours, paler and brighter than the inliers' means, or a hue beyond 150-250."""
    means = smp.filter("n_close >= 2").groupBy("image_id").agg(F.avg("s").alias("ms"), F.avg("v").alias("mv"))
    pale = (F.try_divide("s", "ms") < 0.05) & (F.try_divide("v", "mv") > 0.95)
    bad = (F.col("n_close") < 2) | F.coalesce(pale, F.lit(False)) | ~F.col("h").between(150, 250)
    return smp.join(means, "image_id", "left").withColumn("is_outlier", bad.cast("int")).drop("ms", "mv")


def stddev_n(n: Column, s: Column, q: Column) -> Column:
    """Sample standard deviation from count, sum and sum of squares; 0 for one value or a negative variance."""
    var = (q - s * s / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0))
    return F.sqrt(F.greatest(F.coalesce(var, F.lit(0.0)), F.lit(0.0)))


def means_t(n1: Column, s1: Column, q1: Column, n2: Column, s2: Column, q2: Column) -> Column:
    """t of two means with unpooled errors; a second group of one value is held against the error of the first one's mean."""
    d = F.abs(s1 / n1 - s2 / n2)
    v1, v2 = F.pow(stddev_n(n1, s1, q1), F.lit(2.0)), F.pow(stddev_n(n2, s2, q2), F.lit(2.0))
    return F.coalesce(F.when(n2 == 1, d / F.nullif(F.sqrt(v1 / n1), F.lit(0.0))).otherwise(d / F.nullif(F.sqrt(v1 / n1 + v2 / n2), F.lit(0.0))), F.lit(0.0))


def weighted_ols(df: DataFrame, keys: list[str], x: str, y: str, w: Column) -> DataFrame:
    """keys, n, intercept, slope, sse of a weighted regression on one variable, from sums alone; slope, intercept
    and sse are null where x does not vary."""
    sums = {"n": F.count("*"), "w_": F.sum(w), "x_": F.sum(w * F.col(x)), "y_": F.sum(w * F.col(y)), "xx_": F.sum(w * F.col(x) * F.col(x)), "xy_": F.sum(w * F.col(x) * F.col(y)), "yy_": F.sum(w * F.col(y) * F.col(y))}
    d = df.groupBy(*keys).agg(*[c.alias(k) for k, c in sums.items()])
    d = d.withColumn("slope", F.expr("CASE WHEN w_ * xx_ - x_ * x_ > 1e-9 * w_ * xx_ THEN (w_ * xy_ - x_ * y_) / (w_ * xx_ - x_ * x_) END")).withColumn("intercept", F.expr("(y_ - slope * x_) / w_"))
    return d.withColumn("sse", F.expr("yy_ - intercept * y_ - slope * xy_")).select(*keys, "n", "intercept", "slope", "sse")


def best_sat_start(smp: DataFrame) -> DataFrame:
    """(image_id, horizon, sse): the start height from .5 to .95 with the least error of 1/s on 1/(py - horizon)."""
    grid = smp.select("image_id", "py", "s", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: 0.5 + k * 0.05)).alias("horizon"))
    d = grid.filter("s > 0 AND py > horizon + 0.001").withColumns({"u": 1 / (F.col("py") - F.col("horizon")), "w": 1 / F.col("s")})
    fits = weighted_ols(d, ["image_id", "horizon"], "u", "w", F.lit(1.0)).filter("n >= 3 AND sse IS NOT NULL").withColumn("sse", F.round("sse", 4))
    return fits.groupBy("image_id").agg(F.min_by(F.struct("horizon", "sse"), F.struct("sse", "horizon")).alias("b")).select("image_id", "b.*")


#: The standard sets of general sky luminance (type, gradation, A, B, C, D, E).
SKY_SETS = [
    (1, 1, 4.0, -0.70, 0.0, -1.0, 0.00), (2, 1, 4.0, -0.70, 2.0, -1.5, 0.15), (3, 2, 1.1, -0.80, 0.0, -1.0, 0.00), (4, 2, 1.1, -0.80, 2.0, -1.5, 0.15),
    (5, 3, 0.0, -1.00, 0.0, -1.0, 0.00), (6, 3, 0.0, -1.00, 2.0, -1.5, 0.15), (7, 3, 0.0, -1.00, 5.0, -2.5, 0.35), (8, 3, 0.0, -1.00, 10.0, -3.0, 0.45),
    (9, 4, -1.0, -0.55, 2.0, -1.5, 0.15), (10, 4, -1.0, -0.55, 5.0, -2.5, 0.30), (11, 4, -1.0, -0.55, 10.0, -3.0, 0.45), (12, 5, -1.0, -0.32, 10.0, -3.0, 0.45),
    (13, 5, -1.0, -0.32, 16.0, -3.0, 0.30), (14, 6, -1.0, -0.15, 16.0, -3.0, 0.30), (15, 6, -1.0, -0.15, 24.0, -2.8, 0.15), (16, 3, -1.0, -0.30, 0.0, -1.0, 0.00),
]


def sky_sets(spark: SparkSession, kind: str = "all") -> DataFrame:
    """(type, gradation, ca, cb, cc, cd, ce) of the standard sets; kind `uniform` (no brightening by the sun), `nonuniform` or `all`."""
    d = spark.createDataFrame(SKY_SETS, "type int, gradation int, ca double, cb double, cc double, cd double, ce double")
    uniform = (F.col("cc") < 0.01) & (F.col("cd") < 0.01)
    return d if kind == "all" else d.filter(uniform if kind == "uniform" else ~uniform)


def sun_grid(spark: SparkSession, fov: float) -> DataFrame:
    """(sun, sx, sy): 37 angles from -180 to 180 degrees, as positions in an image of that field of view, by 4 heights."""
    d = spark.range(148).select(F.col("id").cast("int").alias("sun"))
    return d.select("sun", ((F.floor(F.col("sun") / 4) * 10 - 180) / fov).alias("sx"), (F.col("sun") % 4 * 0.5).alias("sy"))


def score_sky_grid(smp: DataFrame, suns: DataFrame, gamma: Column, theta: Column, scale: float = 1.0, sets: list[tuple] = SKY_SETS) -> DataFrame:
    """(image_id, type, sun, sse): every sample under every parameter set and sun position, luminance times `scale` against its
    value. gamma (of the sample's columns and sx, sy) and theta are the angles to the sun and to the zenith.

    The positions are a fixed list of 148 and are broadcast; a sample's angle to a position is worked out once for all
    sets, whose errors are columns of one aggregate. Sums are made where the samples are.
    """
    d = smp.withColumn("theta", theta).crossJoin(F.broadcast(suns)).withColumn("gamma", gamma)
    error = lambda p: F.col("v") - luminance(F.col("gamma"), F.col("theta"), *[F.lit(float(x)) for x in p]) * scale
    sums = d.groupBy("image_id", "sun").agg(*[F.sum(F.pow(error(s[2:]), F.lit(2.0))).alias(f"t{s[0]}") for s in sets])
    each = F.explode(F.array(*[F.struct(F.lit(s[0]).alias("type"), F.col(f"t{s[0]}").alias("sse")) for s in sets])).alias("e")
    return sums.select("image_id", "sun", each).select("image_id", "e.type", "sun", "e.sse")


def best_sky_grid(scores: DataFrame) -> DataFrame:
    """(image_id, type, sun, sse): the least error of each image, to 3 places; of equal ones the first set and position."""
    d = scores.withColumn("sse", F.round("sse", 3))
    return d.groupBy("image_id").agg(F.min_by(F.struct("type", "sun", "sse"), F.struct("sse", "type", "sun")).alias("b")).select("image_id", "b.*")

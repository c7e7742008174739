"""Models of sky colour fitted to samples (image_id, x, y, px, py, h, s, v, is_outlier), and the fill of whole images.

Sums over samples are Spark aggregates. Bounded fits run on the samples of one image (about 1000, see sample_grid_spec())
or of a fixed number of images, so no group grows with the number of images or pixels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.model import COSINE_SCALE
from ..functions.keys import dealt
from ..sources.store import saved
from . import columns, fits

#: Sections across the image, and the weight of an outlier's error.
SECTIONS, OUTLIER = 4, 0.001
#: Images whose luminance or sides are fitted at once: a group has as many times the samples of one.
IMAGES = 32


def section_curves(smp: DataFrame, least: int = 9, least_range: float = 0.01) -> DataFrame:
    """(image_id, section, level, n, sum_py, coefs_v, coefs_s): value and saturation of the inliers by a regression on
    (1, px, ln py, px^2, py), for each quarter of the width.

    A section takes in `level` more sections on both sides, the fewest that give `least` inliers over a range of px of
    least_range. An image without enough inliers gives no rows; inliers at py = 0 have no logarithm and are left out.
    """
    d = smp.filter("is_outlier = 0 AND py > 0").withColumn("section", F.explode(F.sequence(F.lit(0), F.lit(SECTIONS - 1))))
    d = d.withColumn("away", F.abs(F.floor((F.col("px") + 0.5) * SECTIONS) - F.col("section")).cast("int"))
    w = Window.partitionBy("image_id", "section").orderBy("away")  # at most a row a section
    at = d.groupBy("image_id", "section", "away").agg(F.count("*").alias("n"), F.min("px").alias("lo"), F.max("px").alias("hi"))
    ok = (F.sum("n").over(w) >= least) & (F.max("hi").over(w) - F.min("lo").over(w) >= least_range)
    level = at.withColumn("ok", ok).filter("ok").groupBy("image_id", "section").agg(F.min("away").alias("level"))
    d = d.join(level, ["image_id", "section"]).filter("away <= level").withColumns({"ln_py": F.log("py"), "px2": F.col("px") * F.col("px")})
    keys, xs = ["image_id", "section"], ["px", "ln_py", "px2", "py"]
    out = d.groupBy(*keys).agg(F.max("level").alias("level"), F.count("*").alias("n"), F.sum("py").alias("sum_py"))
    for c in "vs":
        out = out.join(fits.ols_report(d, keys, xs, c).select(*keys, F.col("coef").alias(f"coefs_{c}")), keys)
    return out


def base_knots(curves: DataFrame, reduce_range: float = 0.0) -> DataFrame:
    """(image_id, k, px, base_v, base_s): the curves at the mean py of their samples, at 101 places from px = -.5 to .5.

    Between the middles of two sections the curves are blended linearly, outside the outer middles the outer curve holds.
    The range of base_v is drawn to its mean by the share reduce_range, then base_v is divided by its mean.
    """
    mean = curves.groupBy("image_id").agg((F.sum("sum_py") / F.sum("n")).alias("mean_py"))
    d = curves.join(mean, "image_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(100)))).withColumn("px", F.col("k") / 100 - 0.5)
    middle = F.greatest(F.lit(0.0), F.least(F.lit(SECTIONS - 1.0), (F.col("px") + 0.5) * SECTIONS - 0.5))
    d = d.withColumn("w", F.greatest(F.lit(0.0), 1 - F.abs(middle - F.col("section"))))
    terms = [F.lit(1.0), F.col("px"), F.log("mean_py"), F.col("px") * F.col("px"), F.col("mean_py")]
    curve = lambda c: sum(F.col(f"coefs_{c}")[i] * t for i, t in enumerate(terms))
    d = d.groupBy("image_id", "k", "px").agg(*[(F.sum(F.col("w") * curve(c)) / F.sum("w")).alias(f"base_{c}") for c in "vs"])
    whole = F.avg("base_v").over(Window.partitionBy("image_id"))  # 101 rows
    return d.withColumn("base_v", (whole * reduce_range + F.col("base_v") * (1 - reduce_range)) / whole)


def with_knots(smp: DataFrame, knots: DataFrame) -> DataFrame:
    """Samples with their image's 101 knots of value; those of images without curves fall away."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "base_v"))), lambda r: r["base_v"])
    return smp.join(knots.groupBy("image_id").agg(listed.alias("knots")), "image_id")


def _value(p: np.ndarray, base: np.ndarray, py: np.ndarray, horizon: float, fov_y: float) -> np.ndarray:
    """predict_val() on arrays."""
    return base * p[1] + p[0] * (np.exp(np.cos(p[2] * (py - horizon - p[3] * base) * fov_y)) / math.e - math.exp(-2)) * COSINE_SCALE


def _hue(p, px, py):
    z = (py - p[3]) * p[2]
    return p[0] + p[1] * z / (1 + np.abs(z))


def _saturation(p, px, py):
    z = np.maximum(py - p[0] - p[3] * px, 0)
    return p[4] + z / (p[1] + p[2] * z)


def horizon_scores(smp: DataFrame) -> DataFrame:
    """(image_id, slope, horizon_py, v_coefs, sse): a bounded fit of value for slopes from -.2 to .2 by .04, and for horizons
    from .05 below the lowest sample's py down to above .05, by .05 (that first one always). smp has knots and fov_y.
    The 11 slopes by at most 20 horizons of an image are fitted at once."""
    d = smp.select("image_id", "px", "py", "v", "is_outlier", "knots", "fov_y")
    slopes = np.arange(-5, 6) * 0.04

    def run(key, pdf):
        px, py, v = (pdf[c].to_numpy(float) for c in ("px", "py", "v"))
        w, fov_y = np.where(pdf.is_outlier.to_numpy() == 0, 1.0, OUTLIER), float(pdf.fov_y.iloc[0])
        base = np.interp(px, np.linspace(-0.5, 0.5, 101), np.asarray(pdf.knots.iloc[0], float))
        first = min(py.min() - 0.05, 1.0)
        horizons = first - 0.05 * np.arange(max(1, math.ceil((first - 0.05) / 0.05 - 1e-9)))
        slope, horizon = np.repeat(slopes, len(horizons)), np.tile(horizons, len(slopes))
        level = py + slopes[:, None] * px
        of_slope = np.repeat(np.arange(len(slopes)), len(horizons))
        residual = lambda q, at: (_value(q.T[:, :, None], base, level[of_slope[at]], horizon[at, None], fov_y) - v) * w
        start, lo, hi = (np.tile(x, (len(slope), 1)) for x in ([0.2, 0.5, 5.5, 0.25], [0.01, 0.1, 1.0, 0.05], [0.8, 0.9, 8.0, 2.0]))
        p, sse = fits.levenberg_marquardt_many(residual, start, lo, hi)
        return pd.DataFrame({"image_id": key[0], "slope": slope, "horizon_py": horizon, "v_coefs": list(p), "sse": sse})

    return fits.dealt_out(d, "image_id").groupBy("image_id").applyInPandas(run, "image_id int, slope double, horizon_py double, v_coefs array<double>, sse double")


def best_horizon(scores: DataFrame) -> DataFrame:
    """The row of least error of each image; of equal ones the least slope, then the highest horizon."""
    row = F.struct("slope", "horizon_py", "v_coefs", "sse")
    return scores.groupBy("image_id").agg(F.min_by(row, F.struct("sse", "slope", -F.col("horizon_py"))).alias("b")).select("image_id", "b.*")


def side_curves(smp: DataFrame) -> DataFrame:
    """(image_id, side, s_coefs, h_coefs): saturation and hue of the left (0) and right (1) model; samples weigh by the
    distance to the other side, outliers nearly nothing. smp has slope, the horizon's.

    Saturation starts from the best of ten regressions of 1/s on 1/(py - start); its start, damping and rate are fitted
    first, then all five with damping and rate kept within a fifth. Hue has no slope along px. IMAGES images of neighbouring
    ids are fitted at once.
    """
    d = smp.select("image_id", "px", "py", "h", "s", "slope", "is_outlier", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))

    def start(py, s, w):
        best = (math.inf, 0.1, 0.1, 0.1)
        for horizon in 0.5 + 0.05 * np.arange(10):
            z = py - horizon
            use = (z > 1e-3) & (s > 0)
            if use.sum() < 3 or np.ptp(z[use]) == 0:
                continue
            root = np.sqrt(w[use] / (1 + s[use] ** 3))
            a, b = np.linalg.lstsq(np.stack([root, root / z[use]], axis=1), root / s[use], rcond=None)[0]
            a, b = max(float(a), 0.001), max(float(b), 0.05)
            sse = float(((_saturation([horizon, b, a, 0, 0], 0, py) - s) ** 2).sum())
            best = min(best, (sse, float(horizon), b, a))
        return best[1:]

    def run(pdf):
        some = [g for _, g in pdf.groupby(["image_id", "side"])]
        most = max(map(len, some))
        # a row a side, as long as the longest: what is beyond a side's samples repeats its first one and counts for nothing
        rows = lambda c: np.stack([np.concatenate([x := g[c].to_numpy(float), np.full(most - len(x), x[0])]) for g in some])
        px, level, h, s, slope, outlier = map(rows, ("px", "py", "h", "s", "slope", "is_outlier"))
        there = np.arange(most) < np.array([[len(g)] for g in some])
        level, inlier = level + slope * px, (outlier == 0) & there
        right = np.array([[g.side.iloc[0] == 1] for g in some])
        side = np.where(right, px + 0.5, 0.5 - px) / 2
        w = np.where(there, side * np.where(inlier, 1.0, OUTLIER), 0.0)
        saturation = lambda q, at: (_saturation(q.T[:, :, None], px[at], level[at]) - s[at]) * w[at]
        first = lambda q, at: saturation(np.hstack([q, np.zeros((len(q), 2))]), at)
        lo, hi = (np.tile(np.array(x, float), (len(some), 1)) for x in ([0, 0.001, 0.001, -0.3, -0.3], [1.0, 10, 10, 0.3, 1]))
        begin = np.array([start(level[k][m], s[k][m], side[k][m]) for k, m in enumerate(inlier)])
        three, _ = fits.levenberg_marquardt_many(first, begin, lo[:, :3], hi[:, :3])
        lo[:, 1:3], hi[:, 1:3] = three[:, 1:] * 0.8, three[:, 1:] * 1.2
        sat = np.hstack([three, np.tile([0.05, 0.1], (len(some), 1))])
        for _ in range(2):
            sat, _ = fits.levenberg_marquardt_many(saturation, sat, lo, hi)
        least, low = (np.where(inlier, x, np.inf).min(axis=1) for x in (h, level))
        spread = np.minimum(np.where(inlier, h, -np.inf).max(axis=1) - least, 30.0)
        five, one = np.full(len(some), 5.0), np.ones(len(some))
        lo, hi = np.stack([least / 2, spread - 20, five, np.minimum(low - 0.1, 1.0)], axis=1), np.stack([least + 20, spread + 20, 16 * five, one], axis=1)
        hue, _ = fits.levenberg_marquardt_many(lambda q, at: (_hue(q.T[:, :, None], px[at], level[at]) - h[at]) * w[at], np.stack([least, spread, 8 * five, low], axis=1), lo, hi)
        ids = pd.DataFrame([(g.image_id.iloc[0], g.side.iloc[0]) for g in some], columns=["image_id", "side"])
        return ids.assign(s_coefs=list(sat), h_coefs=list(np.hstack([hue, np.zeros((len(some), 1))])))

    d = fits.dealt_out(d.withColumn("block", F.floor(F.col("image_id") / IMAGES)), "block")
    return d.groupBy("block").applyInPandas(run, "image_id int, side int, s_coefs array<double>, h_coefs array<double>")


def fit_sky_model(smp: DataFrame, images: DataFrame) -> DataFrame:
    """The models table that predict_sky() takes: h_coefs and s_coefs (left, right), v_coefs, knots, horizon_py, curvature
    (0), slope, fov, and sse of the values. images: image_id, width, height, fov.

    Knots from section curves, the horizon and value by the grid of horizon_scores(), then saturation and hue on the
    level horizon found. Images without enough inliers get no model.
    """
    smp = saved(smp, "samples")
    with_sky = saved(with_knots(smp, base_knots(section_curves(smp))), "samples")
    of = images.select("image_id", "fov", (F.radians("fov") * F.col("height") / F.col("width")).alias("fov_y"))
    best = saved(best_horizon(horizon_scores(with_sky.join(of, "image_id"))), "horizons")
    sides = side_curves(with_sky.join(best.select("image_id", "slope"), "image_id"))
    both = sides.groupBy("image_id").agg(*[F.array(*[F.max(F.when(F.col("side") == k, F.col(c))) for k in (0, 1)]).alias(c) for c in ("h_coefs", "s_coefs")])
    knots = with_sky.groupBy("image_id").agg(F.first("knots").alias("knots"))
    d = best.join(both, "image_id").join(knots, "image_id").join(images.select("image_id", "fov"), "image_id")
    return d.select("image_id", "h_coefs", "s_coefs", "v_coefs", "knots", "horizon_py", F.lit(0.0).alias("curvature"), "slope", F.col("fov").cast("double").alias("fov"), "sse")


def level_py(px, py, curvature: float, slope: float):
    """adjust_horizon() on arrays."""
    f = 1 - (1 - abs(curvature)) ** 2
    bow = 1 - np.sqrt(np.maximum(1 - 4 * f * px * px, 0))
    return py - math.copysign(1, curvature) * bow + slope * px


def angle_to_sun(px, py, sun_px, sun_py, fov_x, aspect, sphere: bool):
    """Angles between places and the sun, 0 within its disc: between the directions of view (view_angles()) on the sphere, else as
    distances in the picture. aspect: height / width. The sun, fov_x and aspect are numbers, or a column with a row an image of px."""
    sun_px, sun_py, fov_x, aspect = (np.atleast_1d(np.asarray(x, float)) for x in (sun_px, sun_py, fov_x, aspect))

    def view(x, y):
        l = (np.asarray(y, float) - 0.5) * 2 * np.sin(fov_x * aspect / 2)  # noqa: E741
        up = np.where(l > 1, math.pi - np.arcsin(np.clip(2 - l, -1, 1)), np.arcsin(np.clip(l, -1, 1)))
        along = -np.asarray(x, float) * fov_x
        return np.stack([np.sin(along) * np.cos(up), np.sin(up), np.cos(along) * np.cos(up)])

    if sphere:
        gamma = np.arccos(np.clip((view(px, py) * view(sun_px, sun_py)).sum(axis=0), -1, 1))
    else:
        gamma = np.hypot((px - sun_px) * fov_x, (py - sun_py) * fov_x * aspect)
    return np.where(gamma < math.radians(0.533) / 2, 0.0, gamma)


def fit_sky_luminance(smp: DataFrame, images: DataFrame, sphere: bool = False) -> DataFrame:
    """(image_id, ca, cb, cc, cd, ce, horizon_py, sun_px, sun_py, factor, sse): general sky luminance of cie_luminance(),
    times the factor that gives the samples' mean value.

    images: image_id, width, height, fov, sun_px, sun_py and, if the horizon is bent or tilted, curvature and slope; the sun
    may move by 20 degrees and by .25 of the height. Angles to the sun are distances in the picture, as in cie_luminance(),
    or on the sphere of view. IMAGES images of neighbouring ids are fitted at once.
    """
    bent = [(F.col(c) if c in images.columns else F.lit(0.0)).cast("double").alias(c) for c in ("curvature", "slope")]
    of = images.select("image_id", F.radians("fov").alias("fx"), (F.col("height") / F.col("width")).alias("aspect"), "sun_px", "sun_py", *bent)
    d = smp.select("image_id", "px", "py", "v", "is_outlier").join(of, "image_id")

    def run(pdf):
        some = [g for _, g in pdf.groupby("image_id")]
        most = max(map(len, some))
        # a row an image, as long as the longest: what is beyond an image's samples repeats its first one and counts for nothing
        rows = lambda f: np.stack([np.concatenate([x := np.asarray(f(g), float), np.full(most - len(x), x[0])]) for g in some])
        px, py, v, outlier = (rows(lambda g, c=c: g[c]) for c in ("px", "py", "v", "is_outlier"))
        there = np.arange(most) < np.array([[len(g)] for g in some])
        fx, aspect, sun_px, sun_py = (np.array([[float(g[c].iloc[0])] for g in some]) for c in ("fx", "aspect", "sun_px", "sun_py"))
        w = np.where(outlier == 0, 1.0, OUTLIER) * there
        level = rows(lambda g: level_py(g.px.to_numpy(float), g.py.to_numpy(float), float(g.curvature.iloc[0]), float(g.slope.iloc[0])))
        total = np.where(there, v, 0.0).sum(axis=1, keepdims=True)

        def luminance(q, at):
            a, b, c, e_, e, horizon, sx, sy = q.T[:, :, None]
            gamma = angle_to_sun(px[at], py[at], sx, sy, fx[at], aspect[at], sphere)
            theta = np.minimum(math.pi / 2 - (level[at] - horizon) * fx[at] * aspect[at], math.pi / 2 - 0.01)
            light = (1 + a * np.exp(b / np.cos(theta))) * (1 + c * (np.exp(e_ * gamma) - np.exp(e_ * math.pi / 2)) + e * np.cos(gamma) ** 2)
            whole = np.where(there[at], light, 0.0).sum(axis=1, keepdims=True)
            return light, np.divide(total[at], whole, out=np.ones_like(whole), where=whole != 0)

        def residual(q, at):
            light, factor = luminance(q, at)
            return (light * factor - v[at]) * w[at]

        turn, n = math.radians(20) / fx, len(some)
        fixed = lambda *x: np.tile(np.array(x, float), (n, 1))
        lo = np.hstack([fixed(-8, -4, 0, -6, 0, 0), sun_px - turn, sun_py - 0.25])
        hi = np.hstack([fixed(8, 0, 24, -0.1, 1.7, 0.7), sun_px + turn, sun_py + 0.25])
        p, sse = fits.levenberg_marquardt_many(residual, np.hstack([fixed(-0.5, -0.32, 0.1, -1, 0.45, 0.5), sun_px, sun_py]), lo, hi)
        found = pd.DataFrame(np.column_stack([p, luminance(p, np.arange(n))[1], sse]), columns=names[1:])
        return found.assign(image_id=[g.image_id.iloc[0] for g in some])[names]

    names = ["image_id", "ca", "cb", "cc", "cd", "ce", "horizon_py", "sun_px", "sun_py", "factor", "sse"]
    d = fits.dealt_out(d.withColumn("block", F.floor(F.col("image_id") / IMAGES)), "block")
    return d.groupBy("block").applyInPandas(run, "image_id int, " + ", ".join(f"{n} double" for n in names[1:]))


def refine_sky_params(smp: DataFrame, start: DataFrame, spans: dict[str, tuple[float, float, float]], luminance: Column, rounds: int = 3, steps: int = 5) -> DataFrame:
    """start (one row an image) with the columns named in spans moved to where `luminance`, times the factor that gives the
    samples' mean value, has the least error, and sse.

    spans: name -> (reach of the first round, least, most). Each round tries `steps` places a parameter, all combinations,
    around the best so far and within the bounds, then the reach shrinks to the distance of two places. Errors are sums with
    partial aggregation; of equal ones the least parameters win.
    """
    best, half = start, steps // 2
    kept = [c for c in start.columns if c not in spans]
    for k in range(rounds):
        grid = best.select(*start.columns)
        for name, (reach, lo, hi) in spans.items():
            step = reach / half**k / half
            places = F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda j: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(name) + j * step)))  # noqa: B023
            grid = grid.withColumn(name, F.explode(F.array_distinct(places)))
        d = smp.select("image_id", "px", "py", "v").join(dealt(grid), "image_id").withColumn("l", luminance)
        sums = d.groupBy(*start.columns).agg(F.sum("v").alias("v"), F.sum("l").alias("l"), *[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("vv", "vl", "ll")])
        factor = F.coalesce(F.col("v") / F.nullif("l", F.lit(0.0)), F.lit(1.0))
        sums = sums.withColumn("sse", F.round(F.col("vv") - 2 * factor * F.col("vl") + factor * factor * F.col("ll"), 9))
        best = sums.groupBy(*kept).agg(F.min_by(F.struct(*spans, "sse"), F.struct("sse", *spans)).alias("b")).select(*kept, "b.*")
    return best


def adaptive_end(px: DataFrame, col: DataFrame, height: int, alpha: float = 0.95, h_tol: float = 360.0, s_tol: float = 0.3, v_tol: float = 0.015, above: int = 20, ahead: int = 5) -> DataFrame:
    """(image_id, x, eos): a detector whose tolerances shrink as the scan goes down a column.

    It starts 2 * above rows below the raw start. Bands of rows (column_band_stats()) that differ by less than a tolerance of
    saturation or value multiply it by that ratio, by alpha at least; the column ends below the first row where a difference
    exceeds its tolerance, or past the middle of the image. Where the scan runs out first, it ends at the bottom.
    The rows of a column, at most the image's height, are folded in order.
    """
    stats = columns.column_band_stats(px).join(dealt(col.select("image_id", "x", "raw_sos")), ["image_id", "x"])
    inside = (F.col("y") >= F.col("raw_sos") + 2 * above) & (F.col("y") < height - 4 - ahead - above)
    row = F.when(inside, F.struct("y", *[F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("dh", "ds", "dv")]))
    d = stats.groupBy("image_id", "x").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    state = lambda end, s, v: F.struct(end.alias("end"), s.cast("double").alias("s"), v.cast("double").alias("v"))

    def step(a, r):
        hit = (r["y"] > height / 2) | (r["dh"] > h_tol) | (r["ds"] > a["s"]) | (r["dv"] > a["v"])
        shrunk = lambda tol, diff: F.when(diff < tol, tol * F.greatest(diff / tol, F.lit(alpha))).otherwise(tol)
        return state(F.coalesce(a["end"], F.when(hit, r["y"] + 1)), shrunk(a["s"], r["ds"]), shrunk(a["v"], r["dv"]))

    end = F.aggregate("rows", state(F.lit(None).cast("int"), F.lit(s_tol), F.lit(v_tol)), step)["end"]
    return d.select("image_id", "x", F.coalesce(end, F.lit(height - 1)).cast("int").alias("eos"))

"""Grouped fits: small vectorised helpers over groups that Spark deals out."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import dealt, of_image, with_image
from ..sources.store import saved


#: Images of which one strip each is searched at once.
STRIPS = 32


def ols_report(df: DataFrame, keys: list[str], xs: list[str], y: str, w: Column | None = None) -> DataFrame:
    """keys, n, coef, stderr (arrays: intercept first), r2, sigma2 of weighted regressions on any number of variables.

    Cross products are Spark sums with partial aggregation; only one row a group reaches the solver, which works on
    batches of matrices.
    """
    w = F.lit(1.0) if w is None else w
    cols = [F.lit(1.0), *[F.col(x) for x in xs]]
    k = len(cols)
    sums = [F.sum(w * cols[i] * cols[j]).alias(f"xx_{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(w * cols[i] * F.col(y)).alias(f"xy_{i}") for i in range(k)]
    d = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w * F.col(y) * F.col(y)).alias("yy"), F.sum(w).alias("sw"), *sums)
    schema = StructType([d.schema[c] for c in keys]).simpleString()[7:-1]

    def run(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), k, k))
            for i in range(k):
                for j in range(i, k):
                    m[:, i, j] = m[:, j, i] = pdf[f"xx_{i}_{j}"]
            v = pdf[[f"xy_{i}" for i in range(k)]].to_numpy()
            inv = np.linalg.pinv(m, hermitian=True)
            b = np.einsum("nij,nj->ni", inv, v)
            sse = np.maximum(pdf.yy.to_numpy() - (b * v).sum(1), 0.0)
            sst = np.maximum(pdf.yy.to_numpy() - v[:, 0] ** 2 / pdf.sw.to_numpy(), 1e-300)
            sigma2 = sse / np.maximum(pdf.n.to_numpy() - k, 1)
            err = np.sqrt(np.maximum(np.einsum("nii->ni", inv) * sigma2[:, None], 0.0))
            yield pdf[keys].assign(n=pdf.n, coef=list(b), stderr=list(err), r2=1 - sse / sst, sigma2=sigma2)

    return d.mapInPandas(run, f"{schema.replace(':', ' ')}, n long, coef array<double>, stderr array<double>, r2 double, sigma2 double")


def levenberg_marquardt(residual: Callable, p0: np.ndarray, lo: np.ndarray, hi: np.ndarray, tolerance: float = 1e-4, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Least squares within bounds; derivatives by differences, steps clipped to the bounds."""
    p = np.clip(np.asarray(p0, float), lo, hi)
    r = residual(p)
    cost, damping = float(r @ r), 1e-3
    for _ in range(rounds):
        h = 1e-6 * np.maximum(np.abs(p), 1e-3)
        h = np.where(p + h > hi, -h, h)
        jac = np.stack([(residual(p + h[k] * np.eye(len(p))[k]) - r) / h[k] for k in range(len(p))], axis=1)
        g, a = jac.T @ r, jac.T @ jac
        while True:
            q = np.clip(p - np.linalg.lstsq(a + damping * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0], lo, hi)
            s = residual(q)
            new = float(s @ s)
            if new < cost or damping > 1e8:
                break
            damping *= 4
        done = new >= cost or cost - new <= tolerance * 1e-4 * cost
        if new < cost:
            p, r, cost, damping = q, s, new, damping / 4
        if done:
            break
    return p, cost


def levenberg_marquardt_many(residual: Callable, p0: np.ndarray, lo: np.ndarray, hi: np.ndarray, tolerance: float = 1e-4, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """levenberg_marquardt() for many problems at once: p0, lo and hi have a row a problem, and residual(parameters, which) gives
    a row for each of the problems `which`. Each takes the steps it would take alone, and those that are done rest."""
    p = np.clip(np.asarray(p0, float), lo, hi)
    at, k = np.arange(len(p)), p.shape[1]
    r = residual(p, at)
    cost, damping = (r * r).sum(axis=1), np.full(len(p), 1e-3)
    for _ in range(rounds):
        if not len(at):
            break
        now, was = p[at], cost[at]
        h = 1e-6 * np.maximum(np.abs(now), 1e-3)
        h = np.where(now + h > hi[at], -h, h)
        jac = np.stack([(residual(now + h * np.eye(k)[j], at) - r[at]) / h[:, j : j + 1] for j in range(k)], axis=1)
        g, a = jac @ r[at][:, :, None], jac @ jac.transpose(0, 2, 1)
        q, s, new, todo = now.copy(), r[at], was.copy(), np.arange(len(at))
        while len(todo):
            d = damping[at[todo]]
            damped = a[todo] + d[:, None, None] * np.eye(k) * (np.einsum("nii->ni", a[todo]) + 1e-12)[:, None, :]
            q[todo] = np.clip(now[todo] - (np.linalg.pinv(damped, rcond=k * np.finfo(float).eps) @ g[todo])[:, :, 0], lo[at[todo]], hi[at[todo]])
            s[todo] = residual(q[todo], at[todo])
            new[todo] = (s[todo] ** 2).sum(axis=1)
            more = ~((new[todo] < was[todo]) | (d > 1e8))
            todo = todo[more]
            damping[at[todo]] *= 4
        better, done = new < was, (new >= was) | (was - new <= tolerance * 1e-4 * was)
        b = at[better]
        p[b], r[b], cost[b], damping[b] = q[better], s[better], new[better], damping[b] / 4
        at = at[~done]
    return p, cost


def dealt_out(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as shuffles have. Fits take long over few bytes, and Spark would put partitions together
    by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fit_bounded(df: DataFrame, keys: list[str], residual: Callable[[np.recarray, np.ndarray], np.ndarray], p0, lo, hi) -> DataFrame:
    """keys, params, sse, n: a bounded fit for each group; residual gets the group's rows, a record array, and the parameters."""
    schema = StructType([df.schema[c] for c in keys]).simpleString()[7:-1].replace(":", " ")

    def run(key, pdf):
        rows = np.rec.fromarrays([np.ascontiguousarray(pdf[c]) for c in pdf], names=list(pdf))
        p, cost = levenberg_marquardt(lambda q: np.asarray(residual(rows, q), float), np.array(p0, float), np.array(lo, float), np.array(hi, float))
        return pd.DataFrame([[*key, p.tolist(), cost, len(pdf)]], columns=[*keys, "params", "sse", "n"])

    return dealt_out(df, *keys).groupBy(*keys).applyInPandas(run, f"{schema}, params array<double>, sse double, n long")


def student_t_cdf(t: Column, df: Column) -> Column:
    """Student's t distribution by the continued fraction of the incomplete beta function."""

    @F.pandas_udf("double")
    def cdf(t: pd.Series, df: pd.Series) -> pd.Series:
        t, n = t.to_numpy(float), df.to_numpy(float)
        x, a, b = n / (n + t * t), n / 2, np.full(len(n), 0.5)
        ok = np.isfinite(x) & (n > 0)
        x, a = np.where(ok, x, 0.5), np.where(ok, a, 0.5)
        kinds, back = np.unique(a, return_inverse=True)  # few degrees of freedom, many rows
        gammas = np.array([math.lgamma(k + 0.5) - math.lgamma(k) - math.lgamma(0.5) for k in kinds])[back] if len(kinds) else a
        front = np.exp(gammas + a * np.log(np.maximum(x, 1e-300)) + b * np.log(np.maximum(1 - x, 1e-300)))
        flip = x >= (a + 1) / (a + b + 2)
        p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
        tiny = lambda v: np.where(v == 0, 1e-30, v)
        c, d = np.ones(len(z)), 1 / tiny(1 - (p + q) * z / (p + 1))
        f = d
        for m in range(1, 200):  # the continued fraction of the incomplete beta function, for all rows at once
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 / tiny(1 + num * d), tiny(1 + num / c)
                f = f * d * c
            if (np.abs(d * c - 1) < 1e-12).all():
                break
        tail = front * f / p
        tail = np.where(flip, 1 - tail, tail) / 2
        return pd.Series(np.where(ok, np.where(t > 0, 1 - tail, tail), np.nan))

    return cdf(t, df)


def end_of_sky_regression(px: DataFrame, col: DataFrame, height: int, ratio: float = 3.5, floor: tuple[float, float, float] = (0.0196, 0.0144, 0.0004), strip: int = 9, masked: str | None = None) -> DataFrame:
    """(image_id, x, eos): the default detector, on col's start of sky (sos).

    In strips of `strip` columns a square window slides down from below the middle column's start; each channel is fitted
    on (1, x, y, y^2) by weighted least squares. Pixels whose product of 1 + err^2 / (mse + floor) over the channels
    exceeds `ratio` are bad fits from then on (weight .01); that is done twice at most. A column ends below the window
    where its next two rows both fail the same test; the strip is done when every column has an end. Pixels below a
    column's end or in a mask (`masked`: a boolean column of px) weigh .05, and those in a mask never fail. Missing pixels
    weigh nothing. Strips of STRIPS images of neighbouring ids are one group, whose windows slide together; columns left
    over at the right edge belong to the last strip, whose second window overlaps the first and shares its bad fits.
    """
    half = strip // 2
    last = F.greatest(F.floor((of_image(F.max("x")) + 1) / strip) - 1, F.lit(0)).alias("last")
    d = px.select("image_id", "x", "y", "r", "g", "b", (F.col(masked) if masked else F.lit(False)).alias("m")).join(dealt(col.select("image_id", "x", "sos", last)), ["image_id", "x"])
    d = d.withColumn("strip", F.least(F.floor(F.col("x") / strip), F.col("last")).cast("int")).drop("last")

    k, fl = 2 * half + 1, np.array(floor)

    def window(v, m, sos, eos, bad, n, lo):
        """Slides the windows of columns lo .. lo + strip - 1 of all strips down together; each rests when it is done."""
        cols = lo[:, None] + np.arange(strip)
        middle = lo + np.minimum(half, np.minimum(strip, n - lo) - 1)
        dx, dy = (cols - middle[:, None]) / strip, np.arange(-half, half + 3) / strip
        design = np.stack(np.broadcast_arrays(1.0, dx[:, None, :], dy[:, None], dy[:, None] ** 2), axis=-1)
        yc = sos[np.arange(len(lo)), middle] + half
        at = np.flatnonzero(yc < height - 1 - half)
        while len(at):
            rows, c = yc[at, None] + np.arange(-half, half + 3), cols[at]  # the window's rows and the two that follow
            here = (at[:, None, None], rows[:, :, None], c[:, None, :])
            own, masked_, gone, end = v[here], m[here], bad[here], eos[at[:, None], c]
            there = np.isfinite(own[..., 0]) & (rows[:, :, None] >= sos[at[:, None], c][:, None, :])
            ok, d = there[:, :k], design[at]
            w = np.where((rows[:, :k, None] > end[:, None, :]) | masked_[:, :k], 0.05, 1.0)
            w = np.where(gone[:, :k], 0.01, w) * ok
            values = np.where(ok[..., None], own[:, :k], 0.0).reshape(len(at), -1, 3)
            b, mse, live = np.zeros((len(at), 4, 3)), np.ones((len(at), 3)), np.arange(len(at))
            for _ in range(2):
                x, u = d[live, :k].reshape(len(live), -1, 4), w[live].reshape(len(live), -1, 1)
                xw = (x * u).transpose(0, 2, 1)
                b[live] = np.linalg.pinv(xw @ x, rcond=1e-13, hermitian=True) @ (xw @ values[live])
                err2 = (x @ b[live] - values[live]) ** 2
                mse[live] = (u * err2).sum(axis=1) / np.maximum(1, ok[live].sum(axis=(1, 2)))[:, None]
                off = np.prod(1 + err2 / (mse[live, None] + fl), axis=-1).reshape(len(live), k, strip) > ratio
                out = ok[live] & ~gone[live, :k] & ~masked_[live, :k] & off
                gone[live, :k] |= out
                w[live] = np.where(out, 0.01, w[live])
                live = live[out.any(axis=(1, 2))]
                if not len(live):
                    break
            err = d[:, k:].reshape(len(at), -1, 4) @ b - own[:, k:].reshape(len(at), -1, 3)
            off = np.prod(1 + err**2 / (mse[:, None] + fl), axis=-1).reshape(len(at), 2, strip) > ratio
            fails = there[:, k:] & (rows[:, k:, None] <= end[:, None, :]) & ~masked_[:, k:] & off
            gone[:, k:] |= fails
            bad[here] = gone
            ended, below = fails.sum(axis=1) == 2, rows[:, k, None]
            end = np.where(ended, np.minimum(end, below), end)
            done = ~(~ended & (end == height - 1)).any(axis=1)
            eos[at[:, None], c] = np.where(done[:, None], np.minimum(end, below), end)
            yc[at] += 1
            at = at[~done & (yc[at] < height - 1 - half)]

    def run(pdf):
        ids, of = np.unique(pdf.image_id.to_numpy(), return_inverse=True)
        x, y = pdf.x.to_numpy(np.int64), pdf.y.to_numpy(np.int64)
        x0, x1 = np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), np.int64)
        np.minimum.at(x0, of, x)
        np.maximum.at(x1, of, x)
        n, x = x1 - x0 + 1, x - x0[of]
        wide = max(strip, int(n.max()))
        # two rows more, and as many columns as the widest strip: what is beyond an image's pixels is missing
        v, m, bad = np.full((len(ids), height + 2, wide, 3), np.nan), *(np.zeros((len(ids), height + 2, wide), bool) for _ in range(2))
        sos, seen = np.zeros((len(ids), wide), np.int64), np.zeros((len(ids), wide), bool)
        v[of, y, x], m[of, y, x] = pdf[["r", "g", "b"]].to_numpy(float) / 65535, pdf.m.to_numpy(bool)
        sos[of, x], seen[of, x] = pdf.sos.to_numpy(), True
        eos = np.where(np.arange(wide) < n[:, None], height - 1, 0)
        window(v, m, sos, eos, bad, n, np.zeros(len(ids), np.int64))
        if len(more := np.flatnonzero(n > strip)):
            some = [a[more] for a in (v, m, sos, eos, bad)]
            window(*some, n[more], n[more] - strip)
            eos[more] = some[3]
        image, col_ = np.nonzero(seen)
        return pd.DataFrame({"image_id": ids[image], "x": col_ + x0[image], "eos": eos[image, col_]})

    d = dealt_out(d.withColumn("block", F.floor(F.col("image_id") / STRIPS)), "block", "strip")
    return d.groupBy("block", "strip").applyInPandas(run, "image_id int, x int, eos int")


def cluster_errors(errors: DataFrame, k: int = 4, rounds: int = 100, least_moves: float = 0.001) -> DataFrame:
    """image_id, x, y, cluster, is_sky: k-means on absolute colour errors for each image; sky is the cluster whose centre has
    the largest blue.

    The first centre is the pixel farthest from the mean, the next ones those farthest from the centres so far. Pixels are
    kept as columns of an image, which meet its centres in each round; a round picks the nearest by column expressions and
    sums by image, with partial aggregation; only centres (a row an image) are written between rounds. It ends when no image's
    centres move pixels by more than least_moves of their number, or after `rounds`. Images whose centres no longer change
    stay as they are in all later rounds: once they are three quarters of those left, they leave with their pixels.
    """
    apart = lambda a, b: sum((a[c] - b[c]) * (a[c] - b[c]) for c in "rgb")
    apart_of = lambda n: F.array(*[apart(F.col("centres")[i], F.col("p")) for i in range(n)])
    pixels = lambda d, centres: with_image(d, centres.select("image_id", "centres")).select("image_id", "x", "centres", F.explode("column").alias("p"))
    nearest = lambda d: d.withColumn("dist", apart_of(k)).withColumn("cluster", (F.array_position("dist", F.array_min("dist")) - 1).cast("int"))
    mean = lambda p=lambda x: x: F.struct(*[F.avg(p(F.col(f"p.{c}"))).alias(c) for c in "rgb"])
    cols = errors.groupBy("image_id", "x").agg(F.collect_list(F.struct("y", *[F.col(c).cast("double").alias(c) for c in "rgb"])).alias("column"))
    cols = every = saved(cols, "errors")
    centres = cols.select("image_id", F.explode("column").alias("p")).groupBy("image_id").agg(F.array(mean()).alias("centres"))
    for n in range(k):
        far = pixels(cols, centres).withColumn("d", F.array_min(apart_of(max(n, 1))))
        new = far.groupBy("image_id").agg(F.max_by(F.struct(*[f"p.{c}" for c in "rgb"]), F.struct("d", -F.col("p.y"), -F.col("x"))).alias("new"))
        both = centres.join(new, "image_id")
        centres = saved(both.select("image_id", (F.array("new") if n == 0 else F.concat("centres", F.array("new"))).alias("centres")), "centres")
    centres, settled = centres.withColumn("sizes", F.lit(None).cast("array<long>")), []
    for _ in range(rounds):
        of = lambda n: lambda x: F.when(F.col("cluster") == n, x)
        found = nearest(pixels(cols, centres)).groupBy("image_id").agg(*[F.count(of(n)(F.lit(1))).alias(f"n{n}") for n in range(k)], *[mean(of(n)).alias(f"c{n}") for n in range(k)])
        moved = F.array(*[F.when(F.col(f"n{n}") > 0, F.col(f"c{n}")).otherwise(F.col("old")[n]) for n in range(k)])
        step = centres.select("image_id", F.col("centres").alias("old"), F.col("sizes").alias("before")).join(found, "image_id")
        step = step.select("image_id", moved.alias("centres"), F.array(*[f"n{n}" for n in range(k)]).alias("sizes"), "old", "before")
        change, size = sum(F.abs(F.col("sizes")[n] - F.col("before")[n]) for n in range(k)), sum(F.col("sizes")[n] for n in range(k))
        step = step.withColumns({"far": change > least_moves * size, "still": F.coalesce((F.col("centres") == F.col("old")) & (change == 0), F.lit(False))})
        step = saved(step.drop("old", "before"), "centres")
        images, still, far, counted = step.agg(F.count("*"), F.count_if("still"), F.count_if("far"), F.count_if(F.col("far").isNotNull())).first()
        centres = step.select("image_id", "centres", "sizes")
        if counted and not far or still == images:
            break
        if 4 * still >= 3 * images:
            settled.append(centres.join(step.filter("still").select("image_id"), "image_id"))
            centres = centres.join(step.filter("NOT still").select("image_id"), "image_id")
            cols = saved(with_image(cols, centres.select("image_id")), "unsettled")
    for d in settled:
        centres = centres.unionByName(d)
    sky = F.array_position(F.transform("centres", lambda c: c["b"]), F.array_max(F.transform("centres", lambda c: c["b"]))) - 1
    centres = saved(centres.select("image_id", "centres", sky.alias("sky")), "centres")
    sky_of = with_image(every, centres).select("image_id", "x", "centres", "sky", F.explode("column").alias("p"))
    return nearest(sky_of).select("image_id", "x", "p.y", "cluster", (F.col("cluster") == F.col("sky")).alias("is_sky"))

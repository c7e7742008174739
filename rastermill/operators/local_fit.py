"""Colours fitted around places of the sky, without the pixels that do not belong, and repairs by such fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import dealt
from ..sources.store import saved

#: Fewest pixels to look at, and to fit; the greatest relative distance of a channel from the mean around a place.
LEAST_NEAR, LEAST_KEPT, NEAR_MEAN = 16, 8, 0.02
PLACE = ["image_id", "cx", "cy"]


def sky_pixels(px: DataFrame, col: DataFrame, clip_end: bool) -> DataFrame:
    """The wholly opaque pixels of unmasked columns from the start of sky down (to its end), with their column's sos."""
    c = col.filter("column_mask = 0").select("image_id", "x", "sos", *["eos"] * clip_end)
    d = px.filter("a >= 65535").select("image_id", "x", "y", "r", "g", "b").join(dealt(c), ["image_id", "x"])
    return d.filter("y >= sos" + (" AND y <= eos" if clip_end else "")).drop("eos")


def around(sky: DataFrame, places: DataFrame, step: int = 1) -> DataFrame:
    """Rows of places (image_id, cx, cy, width, ..) with each pixel of the square around, every `step`-th in x and y; u and v
    are its distances to the right and down. Places are dealt to the columns they reach: an equi-join on image and column."""
    d = dealt(places.withColumn("x", F.explode(F.expr("sequence(greatest(cx - width, 0), cx + width)")))).join(sky, ["image_id", "x"])
    d = d.filter("y BETWEEN cy - width AND cy + width")
    if step > 1:
        d = d.filter(f"(x - greatest(cx - width, 0)) % {step} = 0 AND (y - greatest(cy - width, sos)) % {step} = 0")
    return d.withColumns({"u": F.col("x") - F.col("cx"), "v": F.col("y") - F.col("cy")})


def off_mean(limit: float) -> Column:
    """Whether a channel differs from the mean around the place by more than `limit` of it."""
    return F.greatest(*[F.abs(F.col(c) - F.col(f"mean_{c}")) - limit * F.col(f"mean_{c}") for c in "rgb"]) > 0


def _fitted_once(sky: DataFrame, places: DataFrame, step: int, limit: float) -> DataFrame:
    """local_fits() at the places that have enough pixels within their width."""
    w = 1 / (F.abs("u") + F.abs("v") + 1)
    near = around(sky, places, step).groupBy(*PLACE, "width")
    near = near.agg(F.count("*").alias("n_near"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"mean_{c}") for c in "rgb"])
    kept = around(sky, near.filter(F.col("n_near") >= LEAST_NEAR), step).filter(~off_mean(limit))
    xs = [F.lit(1.0), F.col("u").cast("double"), F.col("v").cast("double"), (F.col("v") * F.col("v")).cast("double")]
    terms = [a * b for a in xs for b in xs] + [a * F.col(c) for c in "rgb" for a in xs]
    spread = [(F.max(c) - F.min(c)).alias(f"spread_{c}") for c in "uv"]
    means = [f"mean_{c}" for c in "rgb"]
    sums = kept.groupBy(*PLACE, "width", "n_near", *means).agg(F.count("*").alias("n"), *spread, F.array(*[F.sum(t) for t in terms]).alias("s"))
    sums = sums.filter(F.col("n") >= LEAST_KEPT)

    def solve(batches):
        for b in batches:
            s = np.array(b.pop("s").tolist(), float).reshape(-1, 28)
            across, down = b.pop("spread_u").to_numpy(), b.pop("spread_v").to_numpy()
            used = np.stack([np.ones(len(s)), across > 0, down > 0, down > 1], axis=1)  # terms that the pixels' spread allows
            xx = s[:, :16].reshape(-1, 4, 4) * used[:, :, None] * used[:, None, :]
            coef = np.einsum("nij,nkj->nki", np.linalg.pinv(xx, hermitian=True), s[:, 16:].reshape(-1, 3, 4) * used[:, None, :])
            for k, c in enumerate("rgb"):
                b[f"coef_{c}"] = list(coef[:, k])
            yield b

    names = ", ".join(f"{m} double" for m in means) + ", n long, " + ", ".join(f"coef_{c} array<double>" for c in "rgb")
    return sums.mapInPandas(solve, f"image_id int, cx int, cy int, width int, n_near long, {names}")


def local_fits(px: DataFrame, col: DataFrame, places: DataFrame, width: int | None = None, clip_end: bool = True, step: int = 1, retry: bool = True, limit: float = NEAR_MEAN) -> DataFrame:
    """(image_id, cx, cy, width, n_near, n, mean_r .. mean_b, coef_r .. coef_b): the colour around each place (cx, cy).

    Of the opaque sky pixels within `width` (or the places' own column width), those count whose channels are all within
    `limit` of the mean, which weighs by 1 / (|u| + |v| + 1). Each channel is a regression on (1, u, v, v^2), u and v
    measured from the place, without the terms for which the pixels left have no spread. Fewer than 16 pixels, or fewer
    than 8 left: twice the width, once; then there is no row. col: sos, eos, column_mask.

    Means and products are sums over pixels, partial before their shuffle, and one row of them a place reaches the
    solver; only the places that need it are looked at with the double width.
    """
    at = places.select(*PLACE, *([] if width else ["width"])).distinct()
    at = at.withColumn("width", F.lit(width)) if width else at.groupBy(*PLACE).agg(F.max("width").alias("width"))
    sky = sky_pixels(px, col, clip_end)
    if not retry:
        return _fitted_once(sky, at, step, limit)
    at = saved(at, "places")
    first = saved(_fitted_once(sky, at, step, limit), "fits")
    rest = at.join(dealt(first.select(*PLACE)), PLACE, "left_anti").withColumn("width", F.col("width") * 2)
    return first.unionByName(_fitted_once(sky, rest, step, limit))


def fitted(channel: str, dy=0, dx=0) -> Column:
    """The colour of a row of local_fits() dy rows below its place and dx columns right of it, within 0..65535."""
    c = F.col(f"coef_{channel}")
    return F.greatest(F.lit(0.0), F.least(F.lit(65535.0), c[0] + c[1] * dx + c[2] * dy + c[3] * dy * dy))


def whole(c: Column) -> Column:
    return F.floor(c).cast("int")


def local_color_fit(px: DataFrame, col: DataFrame, places: DataFrame, width: int, **options) -> DataFrame:
    """(image_id, cx, cy, n, r, g, b): the colours of local_fits() at their places."""
    return local_fits(px, col, places, width, **options).select(*PLACE, "n", *[fitted(c).alias(c) for c in "rgb"])


def repaired(px: DataFrame, col: DataFrame, fits: DataFrame, clip_end: bool = True, limit: float = NEAR_MEAN) -> DataFrame:
    """(image_id, x, y, r, g, b): the pixels that local_fits() left out, in the colour of the fit; where several places have
    left a pixel out, the nearest one's (ties: the smallest cy, then cx). Columns of a repair mask (col: repair_mask) stay.
    All fits have seen the pixels as they came."""
    free = col.filter("repair_mask = 0") if "repair_mask" in col.columns else col
    d = around(sky_pixels(px, free, clip_end), fits).filter(off_mean(limit))
    new = F.struct(*[whole(fitted(c, F.col("v"), F.col("u"))).alias(c) for c in "rgb"])
    nearest = F.struct(F.abs("u") + F.abs("v"), "cy", "cx")
    return d.groupBy("image_id", "x", "y").agg(F.min_by(new, nearest).alias("new")).select("image_id", "x", "y", "new.r", "new.g", "new.b")


def updated(px: DataFrame, changes: DataFrame, alpha: int | None = 65535) -> DataFrame:
    """px with the colours of changes (image_id, x, y, r, g, b), opaque there unless alpha is None. Several changes of a pixel
    would be several rows."""
    c = changes.select("image_id", "x", "y", F.struct("r", "g", "b").alias("new"))
    a = F.col("a") if alpha is None else F.when(F.col("new").isNotNull(), alpha).otherwise(F.col("a"))
    return px.join(dealt(c), ["image_id", "x", "y"], "left").select("image_id", "x", "y", *[F.coalesce(f"new.{k}", k).alias(k) for k in "rgb"], a.alias("a"))


def raised_start(col: DataFrame, changes: DataFrame) -> DataFrame:
    """col whose start of sky goes up to the highest changed pixel of the column."""
    top = changes.groupBy("image_id", "x").agg(F.min("y").alias("top"))
    return col.join(dealt(top), ["image_id", "x"], "left").withColumn("sos", F.least("sos", "top").cast("int")).select(*col.columns)

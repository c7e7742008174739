"""Prediction, probability, fill and replacement of sky pixels, given a row of model coefficients for each image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, model
from ..functions.color import rgb_to_hsv
from ..functions.keys import dealt, of_image, with_image


def with_model(px: DataFrame, models: DataFrame) -> DataFrame:
    """Attaches the model of the image; models is one row for each image."""
    return with_image(px, models)


def predicted_places(d: DataFrame, width=None, height=None, light: str = "model") -> DataFrame:
    """Adds h_hat, s_hat, v_hat (clamped) at places px, py of images, d having the columns of their models; without width and
    height, these too. light: see predict_sky()."""
    width, height = (F.col(c) if given is None else F.lit(given) for c, given in (("width", width), ("height", height)))
    d = d.withColumn("hc", geometry.adjust_horizon(F.col("px"), F.col("py"), F.col("curvature"), F.col("slope")))
    fov_x, fov_y = F.radians("fov"), F.radians("fov") * height / width
    d = d.withColumns({
        "h_hat": F.greatest(F.lit(0.0), F.least(F.lit(359.99), model.predict_hue(F.col("px"), F.col("hc"), F.col("h_coefs")))),
        "s_hat": model.clamp01(model.predict_sat(F.col("px"), F.col("hc"), F.col("s_coefs"))),
    })
    if light == "luminance":
        of = [F.col(c) for c in ("px", "py", "hc", "sun_px", "sun_py", "horizon_py")] + [fov_x, fov_y] + [F.col(c) for c in ("ca", "cb", "cc", "cd", "ce")]
        value = geometry.cie_luminance(*of) * F.col("v_factor")
    else:
        value = model.predict_val(F.col("px"), F.col("hc"), F.col("v_coefs"), F.col("knots"), F.col("horizon_py"), fov_y)
    d = d.withColumn("v_hat", model.clamp01(value))
    if light == "sun":
        look = lambda x, y: (lambda a: geometry.view_vector(a["aoy"], a["aox"]))(geometry.view_angles(F.col(x), F.col(y), F.col("fov"), width, height))
        d = d.withColumn("glow", geometry.sun_glow(geometry.angle_between(look("px", "py"), look("sun_px", "sun_py")), F.col("cc"), F.col("cd")))
        lit = model.with_sun(*[F.col(c) for c in ("s_hat", "v_hat", "glow", "glow_min", "glow_max", "sun_lum", "sat_depth")])
        d = d.withColumn("lit", lit).withColumns({"s_hat": F.col("lit.s"), "v_hat": F.col("lit.v")})
    return d


def predict_sky(px: DataFrame, models: DataFrame, width=None, height=None, light: str = "model") -> DataFrame:
    """Adds px, py, h_hat, s_hat, v_hat (clamped) and r_hat, g_hat, b_hat. Without width and height, models has these columns.

    light: `model` takes the value from the fitted curves; `sun` adds the glow around the sun to it and takes it from the
    saturation (see with_sun()); `luminance` takes the value from general sky luminance times v_factor. Both need columns of
    models: sun_px, sun_py, cc, cd; `sun` glow_min, glow_max (see glow_range()), sun_lum, sat_depth; `luminance` ca, cb, ce,
    v_factor.
    """
    w, h = (F.col(c) if given is None else F.lit(given) for c, given in (("width", width), ("height", height)))
    d = with_model(px, models).withColumns({"px": F.col("x") / (w - 1) - 0.5, "py": 1 - F.col("y") / (h - 1)})
    d = predicted_places(d, width, height, light).withColumn("hat", model.predicted_rgb(F.col("h_hat"), F.col("s_hat"), F.col("v_hat")))
    return d.select(*px.columns, "px", "py", "h_hat", "s_hat", "v_hat", F.col("hat.r").alias("r_hat"), F.col("hat.g").alias("g_hat"), F.col("hat.b").alias("b_hat"))


def sky_probability(predicted: DataFrame, col: DataFrame) -> DataFrame:
    """Adds prob_sky and p_hat; above the start of sky both are 1."""
    d = predicted.join(dealt(col.select("image_id", "x", "sos")), ["image_id", "x"])
    prob = model.sky_probability([F.col(c) for c in "rgb"], [F.col(f"{c}_hat") for c in "rgb"])
    i, i_hat = (F.col("r") + F.col("g") + F.col("b")) / 3, (F.col("r_hat") + F.col("g_hat") + F.col("b_hat")) / 3
    p_hat = model.replacement_probability(prob, i, i_hat, rgb_to_hsv("r", "g", "b")["s"], F.col("s_hat"))
    return d.withColumns({"prob_sky": F.when(F.col("y") < F.col("sos"), 1.0).otherwise(prob), "p_hat": F.when(F.col("y") < F.col("sos"), 1.0).otherwise(p_hat)}).drop("sos")


def column_corrections(predicted: DataFrame, col: DataFrame, height: int) -> DataFrame:
    """(image_id, x, h_corr, s_corr, v_corr, n): measured over predicted in the top quarter of each unmasked column's sky,
    hue and value weighing by saturation; 1 where a column has no such pixel (n is 0)."""
    d = predicted.withColumn("hsv", rgb_to_hsv("r", "g", "b")).join(dealt(col.filter("column_mask = 0").select("image_id", "x", "sos", "eos")), ["image_id", "x"])
    end = F.least(F.col("sos") + F.floor((F.col("eos") - F.col("sos")) * 0.25 + 0.5), F.col("eos"), F.lit(height - 1))
    top = (F.col("y") >= F.col("sos")) & (F.col("y") < end) & (F.greatest("r", "g", "b") > 3840)
    s = lambda c: F.sum(F.when(top, c))
    ratio = lambda a, b: F.coalesce(s(a) / F.nullif(s(b), F.lit(0.0)), F.lit(1.0))
    h, sat, v = F.col("hsv.h"), F.col("hsv.s"), F.col("hsv.v")
    return d.groupBy("image_id", "x").agg(ratio(h * sat, F.col("h_hat") * sat).alias("h_corr"), ratio(sat, F.col("s_hat")).alias("s_corr"), ratio(v * sat, F.col("v_hat") * sat).alias("v_corr"), F.count_if(top).alias("n"))


def smooth_corrections(corr: DataFrame, reach: int = 126) -> DataFrame:
    """Means over the columns within `reach` that have pixels; 1 where none has."""
    w = Window.partitionBy("image_id").orderBy("x").rangeBetween(-reach, reach)
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("n") > 0, F.col(c))).over(w), F.lit(1.0)).alias(c)
    return corr.select("image_id", "x", *[mean(c) for c in ("h_corr", "s_corr", "v_corr")])


def zenith_color(predicted: DataFrame, col: DataFrame, factors: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(image_id, h_zenith, s_zenith, v_zenith): the mean prediction of the unmasked columns in the top row, times the
    factors of the whole image."""
    d = predicted.filter("y = 0").join(dealt(col.filter("column_mask = 0").select("image_id", "x")), ["image_id", "x"])
    return d.groupBy("image_id").agg(*[(F.avg(f"{c}_hat") * f).alias(f"{c}_zenith") for c, f in zip("hsv", factors)])


def fit_error(smp: DataFrame) -> DataFrame:
    """(image_id, sse_v, sse_rgb) between samples and their prediction."""
    d = smp.withColumn("v_", F.greatest("r", "g", "b") / 65535.0)
    sq = lambda a, b: F.pow(F.col(a) - F.col(b), F.lit(2.0))
    return d.groupBy("image_id").agg(F.sum(sq("v_", "v_hat")).alias("sse_v"), F.sum(sum(F.pow((F.col(c) - F.col(f"{c}_hat")) / 65535.0, F.lit(2.0)) for c in "rgb")).alias("sse_rgb"))


def dark_top_check(models: DataFrame, smp: DataFrame, width=None, height=None, light: str = "model") -> DataFrame:
    """(image_id, n_dark, dark_top): of 101 places across the image, those whose predicted value at the top is under 100 / 255 and
    darker than at the samples' mean height; and whether there are more than 10."""
    middle = smp.groupBy("image_id").agg(F.avg("py").alias("middle"))
    d = models.join(middle, "image_id").withColumn("px", F.explode(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: k / 100 - 0.5)))
    d = predicted_places(d.withColumn("py", F.lit(1.0)), width, height, light).withColumn("top", F.col("v_hat"))
    d = predicted_places(d.withColumn("py", F.col("middle")), width, height, light)
    n = F.count_if((F.col("top") < 100 / 255) & (F.col("top") < F.col("v_hat")))
    return d.groupBy("image_id").agg(n.alias("n_dark"), (n > 10).alias("dark_top"))


def zenith_extents(col: DataFrame, end_factor: float) -> DataFrame:
    """col with the sky's extents that a blend towards the zenith takes, one for all columns of an image: sos is the largest
    start; eos stands the share end_factor of the way from the least to the largest end. Extents are of unmasked columns."""
    seen = lambda f, c: of_image(f(F.when(F.col("column_mask") == 0, F.col(c))))
    end = F.floor(end_factor * seen(F.max, "eos") + (1 - end_factor) * seen(F.min, "eos")).cast("int")
    return col.withColumns({"sos": F.coalesce(seen(F.max, "sos"), "sos"), "eos": F.coalesce(end, "eos")})


def towards_zenith(d: DataFrame, predicted: DataFrame, col: DataFrame, depth: float, factors: tuple[float, float, float]) -> DataFrame:
    """d (hat and feather_end) with hat blended, from the top row down to `depth` of feather_end, from one colour of the image,
    zenith_color() with its factors (the hue's is added), to its own."""
    zenith = zenith_color(predicted, col, (1.0, *factors[1:]))
    hue = F.col("h_zenith") + factors[0]
    hue = F.when(hue < 0, hue + 360).when(hue > 360, hue - 360).otherwise(hue)
    zenith = zenith.select("image_id", model.predicted_rgb(F.least(hue, F.lit(359.99)), F.col("s_zenith"), F.col("v_zenith")).alias("zenith"))
    of = col.select("image_id", "x").join(zenith, "image_id")
    d = d.join(dealt(of), ["image_id", "x"], "left").withColumn("last", F.floor(F.col("feather_end") * depth + 0.5))
    share = F.coalesce((F.col("last") - F.col("y")) / F.nullif("last", F.lit(0)), F.lit(0.0))
    mixed = [F.floor(share * F.col(f"zenith.{c}") + (1 - share) * F.col(f"hat.{c}") + 0.5).cast("int").alias(c) for c in "rgb"]
    return d.withColumn("hat", F.when((F.col("y") <= F.col("last")) & F.col("zenith").isNotNull(), F.struct(*mixed)).otherwise(F.col("hat"))).drop("zenith", "last")


def above_start(channel: str, factor: float):
    """The predicted saturation or value, times a factor that is `factor` in the top row and 1 at the start of sky."""
    share = 1 - F.col("y") / F.nullif("sos", F.lit(0))
    return F.col(f"{channel}_hat") * F.when(F.col("y") < F.col("sos"), 1 - share * (1 - factor)).otherwise(1.0)


def fill_sky_columns(predicted: DataFrame, col: DataFrame, height: int, depth: float = 0.5, zenith: tuple[float, float] | None = None, factors: tuple[float, float, float] = (0.0, 1.0, 1.0)) -> DataFrame:
    """Default fill: the prediction, corrected by smoothed column factors, blended in over the feather; transparent pixels
    below the raw start of sky stay, and so do masked columns.

    zenith: (depth, end factor) to blend the top rows towards one colour of the image, down to `depth` of the feather's end;
    the sky then has the extents of zenith_extents(). factors: added to the zenith's hue, and multiplying its saturation and
    value and, less and less down to the start of sky, those of the prediction.
    """
    corr = smooth_corrections(column_corrections(predicted, col, height))
    extents = zenith_extents(col, zenith[1]) if zenith else col
    d = predicted.join(dealt(corr), ["image_id", "x"], "left").join(dealt(extents.select("image_id", "x", "sos", "eos", "raw_sos")), ["image_id", "x"])
    d = d.withColumn("n", model.feather_length(F.col("sos"), F.col("eos"), depth)).withColumn("feather_end", F.col("sos") + F.col("n"))
    d = d.withColumn("w", F.when(F.col("y") >= F.col("feather_end"), 0.0).otherwise(model.feather_weight(F.col("y"), F.col("sos"), F.col("n"), F.col("b"))))
    hue = F.greatest(F.lit(0.0), F.least(F.lit(359.99), F.col("h_hat") * F.col("h_corr")))
    d = d.withColumn("hat", model.predicted_rgb(hue, above_start("s", factors[1]) * F.col("s_corr"), above_start("v", factors[2]) * F.col("v_corr")))
    if zenith:
        d = towards_zenith(d, predicted, col, zenith[0], factors)
    skip = F.col("h_corr").isNull() | (F.col("a") < 32767) & (F.col("y") > F.col("raw_sos")) | (F.col("y") >= F.col("feather_end"))
    mixed = lambda c: F.when(skip, F.col(c)).otherwise(F.floor(F.col(f"hat.{c}") * F.col("w") + F.col(c) * (1 - F.col("w")) + 0.5)).cast("int")
    return d.select("image_id", "x", "y", *[mixed(c).alias(c) for c in "rgb"], F.when(skip, F.col("a")).otherwise(65535).alias("a"))


def filled_to_end(col: DataFrame, depth: float = 0.5) -> DataFrame:
    """The columns of col whose fill reaches their end of sky."""
    return col.filter(F.col("sos") + model.feather_length(F.col("sos"), F.col("eos"), depth) >= F.col("eos"))


def replace_sky(predicted: DataFrame, col: DataFrame, depth: float = 0.5, suns: DataFrame | None = None, zenith: float | None = None, factors: tuple[float, float, float] = (0.0, 1.0, 1.0), fade: bool = False, only_transparent: bool = False) -> DataFrame:
    """(image_id, x, y, r, g, b, a, p): full replacement of the rows above the effective end (manual, else found), p the
    prediction's share; rows from there on, and masked columns, keep their pixels (p null).

    Above the start of sky p is 1. Below it p is the larger of sky probability and logistic feather; fade then takes it
    to 0 from the feather's end to the sky's; near the sun it is at least the sun's weight. In columns with nonsky_mask,
    p_raw (the probability alone) decides what stays: p_raw * p + (1 - p_raw) * p_raw. Pixels that are not wholly opaque
    take all of the prediction. suns: image_id, width, height, sun_px, sun_py, cf, cg. zenith and factors: as in
    fill_sky_columns(), with the columns' own extents. only_transparent: pixels with some alpha keep their colour.

    A column goes one row further where that row is brighter than the new pixel above it and the old one below.
    """
    extra = [c for c in ("nonsky_mask", "column_mask") if c in col.columns]
    d = sky_probability(predicted, col).join(dealt(col.select("image_id", "x", "sos", F.coalesce("manual_eos", "eos").alias("end"), *extra)), ["image_id", "x"])
    for c in ("nonsky_mask", "column_mask"):
        d = d if c in extra else d.withColumn(c, F.lit(0))
    d = d.withColumn("feather_end", F.col("sos") + model.feather_length(F.col("sos"), F.col("end"), depth))
    d = d.withColumn("hat", model.predicted_rgb(F.col("h_hat"), above_start("s", factors[1]), above_start("v", factors[2])))
    if zenith:
        d = towards_zenith(d, predicted, col, zenith, factors)
    near_sun = F.lit(0.0)
    if suns is not None:
        of = suns.select("image_id", (F.col("height") / F.col("width")).alias("aspect"), F.col("sun_px").alias("sx"), F.col("sun_py").alias("sy"), "cf", "cg")
        d = d.join(dealt(col.select("image_id", "x").join(of, "image_id")), ["image_id", "x"])
        near_sun = geometry.sun_weight(F.col("px"), F.col("py"), F.col("sx"), F.col("sy"), F.col("aspect"), F.col("cf"), F.col("cg"))
    length = F.col("feather_end") - F.col("sos")
    linear = model.clamp01(1 - F.coalesce((F.col("y") - F.col("sos")) / F.nullif(length, F.lit(0)), F.lit(1.0)))
    feather = model.logistic_feather(F.when(F.col("y") <= F.col("feather_end"), linear).otherwise(0.0))
    p = F.greatest("p_hat", feather)
    if fade:
        down = (F.col("y") - F.col("feather_end")) / F.nullif(F.col("end") - F.col("feather_end"), F.lit(0))
        p = p * F.when(F.col("y") > F.col("feather_end"), 1 - F.coalesce(down, F.lit(0.0))).otherwise(1.0)
    p = F.greatest(p, near_sun)
    raw = F.col("p_hat")
    p = F.when(F.col("nonsky_mask") == 1, raw * F.greatest("p_hat", feather, near_sun) + (1 - raw) * raw).otherwise(p)
    p = F.when(F.col("y") < F.col("sos"), 1.0).when(F.col("a") < 65535, 1.0).otherwise(p)
    d = d.withColumn("p", F.when(F.col("column_mask") == 0, p))
    new = {c: F.floor(F.col("p") * F.col(f"hat.{c}") + (1 - F.col("p")) * F.when(F.col("y") < F.col("sos"), F.col(f"hat.{c}")).otherwise(F.col(c)) + 0.5).cast("int") for c in "rgb"}
    d = d.withColumns({f"new_{c}": v for c, v in new.items()})
    down = Window.partitionBy("image_id", "x").orderBy("y")
    top = F.greatest("r", "g", "b")
    peak = (F.lag(F.greatest("new_r", "new_g", "new_b")).over(down) < top) & (F.lead(top).over(down) < top)
    low = F.max("y").over(Window.partitionBy("image_id", "x"))
    more = (F.col("y") == F.col("end")) & (F.col("end") - 1 < low - 2) & F.coalesce(peak, F.lit(False))
    d = d.withColumn("takes", F.col("p").isNotNull() & ((F.col("y") < F.col("end")) | more))
    colored = F.col("takes") & (F.col("a") == 0) if only_transparent else F.col("takes")
    return d.select("image_id", "x", "y", *[F.when(colored, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in "rgb"], F.when(colored, 65535).otherwise(F.col("a")).alias("a"), F.when(F.col("takes"), F.col("p")).alias("p"))


def diagnostic_maps(predicted: DataFrame, col: DataFrame, mode: str) -> DataFrame:
    """mode `prediction`, `probability` (grey) or `error` (absolute)."""
    if mode == "prediction":
        return predicted.select("image_id", "x", "y", *[F.col(f"{c}_hat").alias(c) for c in "rgb"])
    if mode == "error":
        return predicted.select("image_id", "x", "y", *[F.abs(F.col(c) - F.col(f"{c}_hat")).alias(c) for c in "rgb"])
    return sky_probability(predicted, col).select("image_id", "x", "y", *[F.floor(F.col("prob_sky") * 65535).cast("int").alias(c) for c in "rgb"])


def dither(px: DataFrame, seed: int = 1) -> DataFrame:
    """Noise of -64..63 times 8 from a hash of position and channel, so the result does not depend on the order of rows."""
    noise = lambda c: (F.pmod(F.xxhash64(F.lit(seed), "image_id", "x", "y", F.lit(c)), F.lit(128)) - 64) * 8
    return px.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(65534), F.col(c) + noise(c))).cast("int") for c in "rgb"})


def clip_counts(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg(F.count_if(F.greatest("r", "g", "b") >= 65535).alias("clipped"))


def hue_repair_factors(predicted: DataFrame, col: DataFrame, l: int, r: int, reach: int = 10) -> DataFrame:  # noqa: E741
    """(image_id, n_l, n_r, s_l0, s_l1, h_l0, h_l1, s_r0 .. h_r1): intercepts (0) and slopes (1) in y of measured over predicted
    saturation and hue, left (columns l - reach .. l - 1) and right (r .. r + reach - 1) of a range.

    Pixels of the sky of unmasked columns count whose predicted saturation is over .1 (and hue over 0). A side with two pixels
    or fewer takes the other side's; if both have no more, all take the sums of measured over those of predicted, without
    a slope, or 1. One row an image, by partial aggregation.
    """
    d = predicted.filter((F.col("x") >= l - reach) & (F.col("x") < r + reach) & ((F.col("x") < l) | (F.col("x") >= r)) & (F.col("s_hat") > 0.1) & (F.col("h_hat") > 0))
    d = d.join(dealt(col.filter("column_mask = 0").select("image_id", "x", "sos", "eos")), ["image_id", "x"]).filter("y BETWEEN sos AND eos")
    d = d.withColumn("hsv", rgb_to_hsv("r", "g", "b")).withColumn("yd", F.col("y").cast("double"))
    sums, out = [], ["n_l", "n_r"]
    for side, near in (("l", F.col("x") < l), ("r", F.col("x") >= r)):
        sums.append(F.count_if(near).alias(f"n_{side}"))
        for c in "sh":
            q = F.when(near, F.col(f"hsv.{c}") / F.col(f"{c}_hat"))
            sums += [F.regr_intercept(q, F.col("yd")).alias(f"{c}{side}0"), F.regr_slope(q, F.col("yd")).alias(f"{c}{side}1"), F.avg(q).alias(f"{c}{side}m")]
    sums += [(F.sum(f"hsv.{c}") / F.sum(f"{c}_hat")).alias(f"{c}m") for c in "sh"]
    d = col.select("image_id").distinct().join(d.groupBy("image_id").agg(*sums), "image_id", "left").fillna(0, ["n_l", "n_r"])
    for side, other in (("l", "r"), ("r", "l")):
        for c in "sh":
            own = lambda k, at: F.coalesce(f"{c}{at}{k}", F.col(f"{c}{at}m") if k == 0 else F.lit(0.0))  # noqa: B023, E731
            for k in (0, 1):
                plain = F.coalesce(f"{c}m", F.lit(1.0)) if k == 0 else F.lit(0.0)
                out.append(F.when(F.col(f"n_{side}") > 2, own(k, side)).when(F.col(f"n_{other}") > 2, own(k, other)).otherwise(plain).alias(f"{c}_{side}{k}"))
    return d.select("image_id", *out)


def repair_sky_hue(predicted: DataFrame, col: DataFrame, l: int, r: int, reach: int = 10) -> DataFrame:  # noqa: E741
    """New pixels of the sky in the columns l..r-1 of a range with a wrong hue: image_id, x, y, r, g, b, clipped.

    Predicted hue and saturation times hue_repair_factors(), blended from side to side, replace those of the range; then all
    channels rise so that the channel that dropped most has its old value again. Masked columns give no rows.
    """
    y = F.col("y").cast("double")
    d = predicted.filter((F.col("x") >= l) & (F.col("x") < r)).withColumn("v", rgb_to_hsv("r", "g", "b")["v"])
    of = col.filter("column_mask = 0").select("image_id", "x", "sos", "eos").join(hue_repair_factors(predicted, col, l, r, reach), "image_id")
    inside = d.join(dealt(of), ["image_id", "x"]).filter("y BETWEEN sos AND eos")
    left = 1 - (F.col("x") - l) / float(r - l)
    factor = lambda c: left * (F.col(f"{c}_l0") + F.col(f"{c}_l1") * y) + (1 - left) * (F.col(f"{c}_r0") + F.col(f"{c}_r1") * y)
    inside = inside.withColumn("new", model.predicted_rgb(F.greatest(F.lit(0.0), F.least(F.lit(359.99), F.col("h_hat") * factor("h"))), F.col("s_hat") * factor("s"), F.col("v")))
    dr, dg, db = (F.col(f"new.{c}") - F.col(c) for c in "rgb")
    ratio = lambda c: F.col(c) / F.nullif(F.col(f"new.{c}"), F.lit(0))
    rise = F.when((dr < dg) & (dr < db), ratio("r")).when((dr >= dg) & (dg < db), ratio("g")).otherwise(ratio("b"))
    inside = inside.withColumn("rise", F.coalesce(rise, F.lit(1.0)))
    raised = {c: F.floor(F.col(f"new.{c}") * F.col("rise") + 0.5) for c in "rgb"}
    return inside.select("image_id", "x", "y", *[F.least(F.lit(65535), v).cast("int").alias(c) for c, v in raised.items()], (F.greatest(*raised.values()) > 65535).alias("clipped"))

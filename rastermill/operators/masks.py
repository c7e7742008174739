"""Column and rectangle masks, manual horizons, and what they select."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import dealt

KINDS = ("column", "sample", "repair", "nonsky")


def drop_masked(px: DataFrame, rects: DataFrame, keep_masked: bool = False) -> DataFrame:
    """Pixels outside (or inside) all rectangles of their image, borders included; an equi-join on the image first."""
    p, r = px.alias("p"), rects.alias("r")
    on = (F.col("p.image_id") == F.col("r.image_id")) & F.col("p.x").between(F.col("r.l"), F.col("r.r")) & F.col("p.y").between(F.col("r.t"), F.col("r.b"))
    return p.join(r, on, "left_semi" if keep_masked else "left_anti")


def skip_mask_y(px: DataFrame, rects: DataFrame, masks: DataFrame, height: int) -> DataFrame:
    """Adds skip_y: where a scan down the column goes on; the bottom of the lowest rectangle, the height in a masked
    column, else y itself."""
    r = rects.select("image_id", F.explode(F.sequence("l", "r")).alias("x"), "t", "b")
    hit = px.select("image_id", "x", "y").join(dealt(r), ["image_id", "x"]).filter(F.col("y").between(F.col("t"), F.col("b"))).groupBy("image_id", "x", "y").agg(F.max("b").alias("bottom"))
    cols = masks.filter("kind = 'column'").select("image_id", F.explode(F.sequence("l", "r")).alias("x")).distinct().withColumn("masked", F.lit(True))
    d = px.join(dealt(hit), ["image_id", "x", "y"], "left").join(dealt(cols), ["image_id", "x"], "left")
    return d.withColumn("skip_y", F.when(F.col("masked"), height).otherwise(F.coalesce("bottom", "y"))).drop("bottom", "masked")


def expand_column_masks(col: DataFrame, masks: DataFrame) -> DataFrame:
    """Adds a 0/1 flag <kind>_mask for each kind of mask. Ranges become rows of (image, column): an equi-join."""
    m = masks.select("image_id", "kind", F.explode(F.sequence("l", "r")).alias("x"))
    flags = m.groupBy("image_id", "x").agg(*[F.max(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"{k}_mask") for k in KINDS])
    return col.join(dealt(flags), ["image_id", "x"], "left").fillna(0, [f"{k}_mask" for k in KINDS])


def densify_manual_horizon(vertices: DataFrame) -> DataFrame:
    """(image_id, x, manual_eos): straight segments between consecutive vertices; (-1, -1) breaks, later segments win."""
    w = Window.partitionBy("image_id").orderBy("ord")
    seg = vertices.select("image_id", "ord", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
    seg = seg.filter("x0 >= 0 AND x1 >= x0")
    points = seg.select("image_id", "ord", "x0", "y0", "x1", "y1", F.explode(F.sequence("x0", "x1")).alias("x"))
    slope = (F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0))
    y = F.floor(F.col("y0") + (F.col("x") - F.col("x0")) * F.coalesce(slope, F.lit(0.0)) + 0.5).cast("int")
    return points.groupBy("image_id", "x").agg(F.max_by(y, "ord").alias("manual_eos"))


def effective_end(col: DataFrame) -> DataFrame:
    return col.withColumn("effective_eos", F.coalesce("manual_eos", "eos"))


def nearest_unmasked_end(col: DataFrame) -> DataFrame:
    """Adds nearest_eos: in masked columns (column_mask = 1) a linear blend of the nearest unmasked ends on both sides."""
    back = Window.partitionBy("image_id").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("image_id").orderBy("x").rowsBetween(0, Window.unboundedFollowing)
    free = F.when(F.col("column_mask") == 0, F.struct("x", "eos"))
    d = col.withColumns({"before": F.last(free, True).over(back), "after": F.first(free, True).over(on)})
    share = (F.col("x") - F.col("before.x")) / F.nullif(F.col("after.x") - F.col("before.x"), F.lit(0))
    blend = F.col("before.eos") + share * (F.col("after.eos") - F.col("before.eos"))
    return d.withColumn("nearest_eos", F.coalesce(blend, F.col("before.eos").cast("double"), F.col("after.eos").cast("double"))).drop("before", "after")


def sky_band(px: DataFrame, col: DataFrame) -> DataFrame:
    return px.join(dealt(col.select("image_id", "x", "sos", "eos")), ["image_id", "x"]).filter("y BETWEEN sos AND eos").drop("sos", "eos")


def tag_sky(px: DataFrame, col: DataFrame) -> DataFrame:
    """ORs the sky bit (1) into pixel_class on raw_sos .. eos."""
    d = px.join(dealt(col.select("image_id", "x", "raw_sos", "eos")), ["image_id", "x"])
    return d.withColumn("pixel_class", F.col("pixel_class").bitwiseOR(F.when(F.expr("y BETWEEN raw_sos AND eos"), 1).otherwise(0))).drop("raw_sos", "eos")

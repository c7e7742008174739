"""What grows with the images stays off the driver: estimates of intermediate tables, and copies that are not broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from rastermill.functions.keys import BLOCKS, with_image
from rastermill.operators import fits, local_fit, masks, sky_model
from rastermill.sources import rasters
from rastermill.sources.store import PixelVersions, Stages, saved


def estimate(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


@pytest.fixture
def small_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_saved_tables_are_taken_for_as_large_as_their_rows(spark):
    """Three whole numbers of 4 bytes a row, though all rows are alike."""
    d = saved(spark.range(0, 50_000, 1, 2).select(F.lit(1).alias("image_id"), F.lit(2).alias("x"), F.lit(3).alias("y")), "alike")
    assert estimate(d) >= 12 * 50_000
    assert d.count() == 50_000 and d.distinct().count() == 1


def test_copies_of_places_are_not_broadcast(spark, small_broadcasts):
    places = saved(spark.range(0, 2000, 1, 2).select(F.col("id").cast("int").alias("image_id"), F.lit(40).alias("cx"), F.lit(3).alias("cy"), F.lit(30).alias("width")), "places")
    sky = saved(spark.range(0, 100_000, 1, 2).selectExpr("CAST(id % 2000 AS INT) AS image_id", "CAST(id / 2000 AS INT) AS x", "3 AS y", "1 AS sos"), "sky")
    assert estimate(places) < 64 << 10 < estimate(sky)
    d = local_fit.around(sky, places)
    assert d.count() == 2000 * 40
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_images_count_in_their_estimate(spark, small_broadcasts):
    images = saved(spark.range(0, 2000, 1, 2).select(F.col("id").cast("int").alias("image_id"), F.col("id").alias("n")), "images")
    px = saved(spark.range(0, 100_000, 1, 2).selectExpr("CAST(id % 2000 AS INT) AS image_id", "CAST(id / 2000 AS INT) AS x"), "px")
    assert estimate(images) < 64 << 10 < estimate(images) * BLOCKS
    d = with_image(px, images)
    assert d.filter("n = image_id").count() == 100_000
    assert not re.search("BroadcastHashJoin", d._jdf.queryExecution().executedPlan().toString())


def test_tables_of_columns_and_changes_are_not_broadcast(spark):
    """However small Spark takes them for: they grow with the images."""
    px = saved(spark.range(0, 4000, 1, 2).selectExpr("CAST(id / 1000 AS INT) AS image_id", "CAST(id % 40 AS INT) AS x", "CAST(id / 40 AS INT) % 25 AS y", "1 AS r", "2 AS g", "3 AS b", "65535 AS a"), "px")
    col = saved(px.select("image_id", "x", F.lit(2).alias("sos"), F.lit(9).alias("eos"), F.lit(0).alias("column_mask")).distinct(), "col")
    versions = PixelVersions(px, Stages(spark))
    versions.change("top", lambda d: d.filter("y = 0").withColumn("r", F.lit(7)))
    for d, n in ((masks.sky_band(px, col), 4 * 40 * 8), (local_fit.sky_pixels(px, col, True), 4 * 40 * 8), (versions.now(), 4000)):
        assert d.count() == n
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    assert versions.now().filter("r = 7").count() == 4 * 40


def test_scanlines_are_packed_many_at_a_time(spark):
    """No group of Python's own for every row of every image."""
    px = spark.range(0, 400).selectExpr("CAST(id / 100 AS INT) AS image_id", "9 - CAST(id % 10 AS INT) AS x", "CAST(id / 10 AS INT) % 10 AS y", "CAST(id AS INT) AS r", "1 AS g", "2 AS b", "65535 AS a")
    d = rasters.pack_scanlines(px)
    assert "FlatMapGroups" not in d._jdf.queryExecution().executedPlan().toString()
    assert sorted(rasters.unpack_scanlines(d).collect()) == sorted(px.collect())


def test_strips_of_many_images_are_searched_at_once(spark):
    """Not a group of Python's own for every strip of every image; each image gets the ends that it gets alone."""
    px = spark.range(0, 40 * 21 * 30, 1, 4).selectExpr("CAST(id / 630 AS INT) AS i", "CAST(id % 21 AS INT) AS x", "CAST(id / 21 AS INT) % 30 AS y")
    px = px.filter("x < 21 - i % 5").withColumn("noise", F.pmod(F.xxhash64("i", "x", "y"), F.lit(900)).cast("int"))
    v = F.when(F.col("y") < 12 + (F.col("i") + F.col("x")) % 9, 40_000 + F.col("y") * 100 + F.col("noise")).otherwise(9000 + F.col("noise"))
    px = saved(px.select("i", "x", "y", v.alias("r"), (v + 500).alias("g"), (v + 900).alias("b"), F.lit(65535).alias("a"), (F.col("noise") == 5).alias("m")), "px")
    col = px.select("i", "x", (F.col("i") % 3).alias("sos")).distinct()
    ends = lambda f: fits.end_of_sky_regression(px.withColumn("image_id", f), col.withColumn("image_id", f), 30, masked="m")
    one, together = ends(F.col("i") * 1000), ends(F.col("i"))
    assert "FlatMapGroupsInPandas [block" in together._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.image_id, r.x, r.eos) for r in together.collect())
    assert got == sorted((r.image_id // 1000, r.x, r.eos) for r in one.collect()) and len(got) == col.count() and len({e for _, _, e in got}) > 5


def test_sides_of_many_images_are_fitted_at_once(spark):
    rows = [(i, x / 20 - 0.5, 0.3 + y / 20, 200.0 + y + i, 0.2 + 0.02 * y + 0.01 * x / 20 + 0.003 * i, 0.01 * (i % 3), int(i == 2 and x == y)) for i in range(6) for x in range(12 + i) for y in range(10)]
    smp = spark.createDataFrame(rows, "image_id int, px double, py double, h double, s double, slope double, is_outlier int")
    together, one = sky_model.side_curves(smp), sky_model.side_curves(smp.withColumn("image_id", F.col("image_id") * 1000))
    assert "FlatMapGroupsInPandas [block" in together._jdf.queryExecution().executedPlan().toString()
    got, want = ({(r.image_id, r.side): [*r.s_coefs, *r.h_coefs] for r in d.collect()} for d in (together, one))
    assert len(got) == 12 and all(want[i * 1000, k] == pytest.approx(v, rel=1e-3, abs=1e-4) for (i, k), v in got.items())

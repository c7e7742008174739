"""Raster operators on small images, against numpy or the SQL twins."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rastermill.functions import color
from rastermill.operators import columns, fits, repairs, sampling
from rastermill.plans.registry import QUERIES
from rastermill.sources import rasters

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def rows(df, cols):
    return sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


TWINS = ["sky_outline", "drop_masked", "skip_mask_y", "clamp_slope", "nearest_unmasked_end", "box_smooth", "sobel_strength", "close_neighbors", "sample_sky", "score_sky_grid", "column_corrections", "best_sat_start", "contrast_end", "edge_suspects", "bilateral_gray", "bilateral_gray_rows", "two_band_profile", "paired_t_end", "interpolate_transparent", "repair_sky_hue", "audit_marks", "forecast_ratio", "fix_slivers", "clear_black_edges", "trim_halo", "seam_smooth", "even_out_rows", "even_out_rows_from_start", "fill_sky_columns", "replace_sky", "rgb_to_hsi", "glow_range"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", TWINS)
def test_twin(spark, duck, name):
    f, sql = QUERIES[name]
    ours, theirs = f(spark, SF).toPandas(), duck.execute(sql).df()
    cols = sorted(theirs.columns)
    assert sorted(ours.columns) == cols and rows(ours, cols) == rows(theirs, cols)


def test_hsv_round_trip(spark):
    d = spark.range(11).crossJoin(spark.range(11).withColumnRenamed("id", "g")).selectExpr("CAST(id * 6553 AS INT) r", "CAST(g * 6553 AS INT) g", "CAST(20000 AS INT) b")
    d = d.withColumn("h", color.rgb_to_hsv("r", "g", "b")).withColumn("back", color.hsv_to_rgb(F.col("h.h"), F.col("h.s"), F.col("h.v")))
    assert d.select(F.max(sum(F.abs(F.col(c) - F.col(f"back.{c}")) for c in "rgb"))).first()[0] <= 3


def test_scanlines(spark):
    px = spark.createDataFrame([(1, x, y, x * 1000, y * 1000, 65535, 65535) for x in range(5) for y in range(3)], rasters.PIXELS)
    assert sorted(rasters.unpack_scanlines(rasters.pack_scanlines(px)).collect()) == sorted(px.collect())
    eight = rasters.unpack_scanlines(rasters.pack_scanlines(px, 8)).toPandas()
    assert (eight.b == 65535).all() and set(eight.r) == {(v >> 8) << 8 | v >> 8 for v in range(0, 5000, 1000)}
    bad = spark.createDataFrame([(1, 0, 16, 3, bytearray(24)), (1, 1, 12, 4, bytearray(24)), (1, 2, 16, 4, None)], rasters.SCANLINES)
    assert rasters.unpack_scanlines(bad).count() == 0


def test_text_files(spark, tmp_path):
    (tmp_path / "a.pto").write_text('# x\np f2 w3000 h1223 v287  k2 E-0.440463 R0 S151,2855,316,1178 n"TIFF_m c:LZW r:CROP"\np broken\n')
    assert [r.fov for r in rasters.read_project_fov(spark, str(tmp_path / "a.pto")).collect()] == [259]
    (tmp_path / "a.eos").write_text("X Y\n0 142\n604 389\n-1 -1\n2649 467\n")
    assert [(r.x, r.y) for r in rasters.read_manual_horizon(spark, str(tmp_path / "a.eos")).orderBy("ord").collect()] == [(0, 142), (604, 389), (-1, -1), (2649, 467)]


def test_ols(spark):
    rng = np.random.default_rng(1)
    x, z = rng.random(60), rng.random(60)
    y = 2 + 3 * x - z + rng.normal(0, 0.01, 60)
    d = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "z": z, "y": y}))
    r = fits.ols_report(d, ["k"], ["x", "z"], "y").first()
    assert np.allclose(r.coef, np.linalg.lstsq(np.stack([np.ones(60), x, z], 1), y, rcond=None)[0])
    one = sampling.weighted_ols(d, ["k"], "x", "y", F.lit(1.0)).first()
    assert np.allclose([one.slope, one.intercept], np.polyfit(x, y, 1))


def test_fit_bounded(spark):
    x = np.linspace(0, 1, 50)
    d = spark.createDataFrame(pd.DataFrame({"k": 7, "x": x, "y": 0.5 + 2 * np.exp(-3 * x)}))
    r = fits.fit_bounded(d, ["k"], lambda pdf, p: p[0] + p[1] * np.exp(-p[2] * pdf.x) - pdf.y, [0, 1, 1], [0, 0, 0], [5, 5, 10]).first()
    assert np.allclose(r.params, [0.5, 2, 3], atol=1e-3)


def test_student_t(spark):
    d = spark.createDataFrame([(0.0, 5.0), (2.015, 5.0), (-1.812, 10.0), (1.96, 1e6)], "t double, n double")
    got = [r.p for r in d.select(fits.student_t_cdf(F.col("t"), F.col("n")).alias("p")).collect()]
    assert np.allclose(got, [0.5, 0.95, 0.05, 0.975], atol=1e-3)


def test_clamped_ends_rise_slowly(spark):
    d = spark.createDataFrame([(1, x, (x * 37) % 19, 0, 0) for x in range(30)], "image_id int, x int, eos int, sos int, column_mask int")
    e = [r.clamped_eos for r in columns.clamp_slope(d).orderBy("x").collect()]
    assert max(abs(a - b) for a, b in zip(e, e[1:])) <= 2


def test_partitions_do_not_matter(spark):
    results = []
    for n in (1, 3, 17):
        px = spark.createDataFrame([(1, x, y, (x * 7919 + y * 104729) % 60000, 100, 200, 65535) for x in range(12) for y in range(12)], rasters.PIXELS).repartition(n)
        results.append(sorted(columns.box_smooth(px).select("x", "y", F.round("r_box", 6)).collect()))
    assert results[0] == results[1] == results[2]


def test_forecast_ratio(spark):
    r = np.random.default_rng(8)
    v = r.integers(0, 65536, 20)
    px = spark.createDataFrame([(1, 0, y, int(c), int(c), int(c), 65535) for y, c in enumerate(v)], rasters.PIXELS)
    got = {q.y: q for q in repairs.forecast_ratio(px, 20).collect()}
    assert sorted(got) == list(range(10, 19))
    for y, q in got.items():
        k = np.arange(y - 10, y + 2) / 20
        design = np.stack([np.ones(12), k, np.exp(k)], axis=1)
        e = v[y - 10 : y + 2] / 65535 - design @ np.linalg.lstsq(design[:10], v[y - 10 : y] / 65535, rcond=None)[0]
        want = np.sqrt((e[:10] ** 2).mean()), np.sqrt((e[10:] ** 2).mean())
        assert np.allclose((q.rmse, q.rmse_next, q.ratio), (*want, want[1] / want[0]), rtol=1e-6)

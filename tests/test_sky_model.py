"""Sky models against known coefficients and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.functions import geometry
from rastermill.operators import columns, fill, fits, sampling, sky_model
from test_rules import column_table, pixels


@pytest.fixture(scope="module")
def scene(spark):
    """Samples that a model made, and the model's image."""
    rows = [(0, x, y, x / 39 - 0.5, 1 - y / 59) for x in range(40) for y in range(2, 36, 2)]
    out = []
    for i, x, y, px, py in rows:
        z = max(py - 0.2, 0)
        v = 0.6 + 0.1 * py + 0.05 * px + 0.04 * px * px
        out.append((i, x, y, px, py, 190 + 20 * (py - 0.4), z / (0.9 + 1.2 * z), v, 0))
    out.append((0, 99, 0, 0.0, 0.5, 30.0, 0.9, 0.1, 1))
    images = spark.createDataFrame([(0, 40, 60, 100.0)], "image_id int, width int, height int, fov double")
    return spark.createDataFrame(out, "image_id int, x int, y int, px double, py double, h double, s double, v double, is_outlier int"), images, out


def test_section_curves_and_knots(scene):
    smp, _, rows = scene
    got = sky_model.section_curves(smp).orderBy("section").collect()
    inliers = [r for r in rows if r[8] == 0]
    for r in got:
        mine = [q for q in inliers if -0.5 + r.section / 4 <= q[3] < -0.25 + r.section / 4]
        assert r.level == 0 and r.n == len(mine)
        for q in mine[::7]:
            c = r.coefs_v
            assert c[0] + c[1] * q[3] + c[2] * np.log(q[4]) + c[3] * q[3] ** 2 + c[4] * q[4] == pytest.approx(q[7], abs=1e-6)
    knots = sky_model.base_knots(sky_model.section_curves(smp)).orderBy("k").collect()
    mean_py = sum(r.sum_py for r in got) / sum(r.n for r in got)
    want = np.array([0.6 + 0.1 * mean_py + 0.05 * k.px + 0.04 * k.px**2 for k in knots])
    assert [k.k for k in knots] == list(range(101))
    assert np.allclose([k.base_v for k in knots], want / want.mean(), atol=1e-5)
    flat = sky_model.base_knots(sky_model.section_curves(smp), 1.0).collect()
    assert np.allclose([k.base_v for k in flat], 1)


def test_sections_widen(spark, scene):
    smp, _, _ = scene
    few = smp.filter("px < 0.2")
    levels = {r.section: r.level for r in sky_model.section_curves(few).collect()}
    assert levels == {0: 0, 1: 0, 2: 0, 3: 1}
    assert sky_model.section_curves(smp.limit(0)).count() == 0
    assert sky_model.section_curves(smp.filter("x = 3")).count() == 0


def test_model_predicts_its_samples(spark, scene):
    smp, images, rows = scene
    models = sky_model.fit_sky_model(smp, images)
    m = models.collect()
    assert len(m) == 1 and len(m[0].knots) == 101
    px = spark.createDataFrame([(0, r[1], r[2], 0, 0, 0, 65535) for r in rows if r[8] == 0], "image_id int, x int, y int, r int, g int, b int, a int")
    got = {(r.x, r.y): r for r in fill.predict_sky(px, models, 40, 60).collect()}
    err = np.array([[got[q[1], q[2]].h_hat - q[5], got[q[1], q[2]].s_hat - q[6], got[q[1], q[2]].v_hat - q[7]] for q in rows if q[8] == 0])
    rms = np.sqrt((err**2).mean(axis=0))
    assert rms[0] < 2 and rms[1] < 0.02 and rms[2] < 0.02


def test_luminance_and_refinement(spark, scene):
    smp, images, _ = scene
    where = images.withColumns({"sun_px": F.lit(0.2), "sun_py": F.lit(0.7)})
    lit = [F.lit(x) for x in (-0.8, -0.4, 2.0, -2.0, 0.3)]
    fy = F.radians(F.lit(100.0)) * 60 / 40
    light = geometry.cie_luminance(F.col("px"), F.col("py"), F.col("py"), F.lit(0.2), F.lit(0.7), F.lit(0.3), F.radians(F.lit(100.0)), fy, *lit)
    smp = smp.filter("is_outlier = 0").withColumn("v", light / 5)
    fit = sky_model.fit_sky_luminance(smp, where).first()
    spread = smp.agg(F.var_pop("v") * F.count("*")).first()[0]
    assert fit.sse < 0.05 * spread
    start = spark.createDataFrame([(0, 0.1, 1.0)], "image_id int, sx double, c double")
    lum = geometry.cie_luminance(F.col("px"), F.col("py"), F.col("py"), F.col("sx"), F.lit(0.7), F.lit(0.3), F.radians(F.lit(100.0)), fy, lit[0], lit[1], F.col("c"), lit[3], lit[4])
    best = sky_model.refine_sky_params(smp, start, {"sx": (0.2, -0.5, 0.5), "c": (2.0, 0.0, 2.5)}, lum, rounds=4).first()
    assert best.sx == pytest.approx(0.2, abs=0.03) and best.c == pytest.approx(2.0, abs=0.3) and best.sse < 0.02 * spread


def test_adaptive_end(spark):
    rng = np.random.default_rng(3)
    h, w, above = 60, 6, 3
    v = np.cumsum(rng.integers(0, 260, (h, w, 3)), axis=0) + 20000
    v[25:, 2] += 9000
    px = pixels(spark, v)
    col = column_table(spark, w, raw_sos=[0, 3, 1, 5, 50, 2])
    stats = {(r.x, r.y): r for r in columns.column_band_stats(px).collect()}
    got = {r.x: r.eos for r in sky_model.adaptive_end(px, col, h, above=above).collect()}
    for x, raw in enumerate([0, 3, 1, 5, 50, 2]):
        s_tol, v_tol, end = 0.3, 0.015, h - 1
        for y in range(raw + 2 * above, h - 4 - 5 - above):
            r = stats[x, y]
            dh, ds, dv = (round(k or 0.0, 9) for k in (r.dh, r.ds, r.dv))
            if y > h / 2 or dh > 360 or ds > s_tol or dv > v_tol:
                end = y + 1
                break
            s_tol *= max(ds / s_tol, 0.95) if ds < s_tol else 1
            v_tol *= max(dv / v_tol, 0.95) if dv < v_tol else 1
        assert got[x] == end


def test_many_fits_take_the_steps_of_single_ones():
    """Each of 40 problems, all in one call, ends where levenberg_marquardt() ends alone."""
    r = np.random.default_rng(4)
    x = np.linspace(0, 3, 30)
    true = r.uniform([0.2, 0.5, 0.5], [1, 2, 3], (40, 3))
    y = true[:, :1] + true[:, 1:2] * np.exp(-true[:, 2:] * x) + r.normal(0, 0.01, (40, 30))
    start, lo, hi = (np.tile(p, (40, 1)) for p in ([0.0, 1.0, 1.0], [0.0, 0.0, 0.0], [5.0, 1.5, 10.0]))
    p, sse = fits.levenberg_marquardt_many(lambda q, at: q[:, :1] + q[:, 1:2] * np.exp(-q[:, 2:] * x) - y[at], start, lo, hi)
    for k in range(40):
        one, cost = fits.levenberg_marquardt(lambda q, k=k: q[0] + q[1] * np.exp(-q[2] * x) - y[k], start[k], lo[k], hi[k])
        assert np.allclose(p[k], one, atol=1e-6) and np.isclose(sse[k], cost, rtol=1e-9)


def test_fits_are_dealt_to_as_many_tasks_as_shuffles_have(spark):
    """Few bytes, yet not one task: Spark does not put their partitions together."""
    d = fits.dealt_out(spark.range(100).withColumnRenamed("id", "image_id"), "image_id")
    assert d.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_residuals_get_plain_arrays(spark):
    """Columns of a group are arrays, since pandas would take longer than the sums."""
    seen = lambda rows, p: rows.y - p[0] if type(rows.y) is np.ndarray else 1 / 0
    r = fits.fit_bounded(spark.createDataFrame([(1, 2.0), (1, 4.0)], "k int, y double"), ["k"], seen, [0.0], [0.0], [9.0]).first()
    assert abs(r.params[0] - 3) < 1e-6 and abs(r.sse - 2) < 1e-9 and r.n == 2

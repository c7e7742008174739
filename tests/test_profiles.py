"""Profiles down columns, factors beside a range, and marks, against plain loops."""

import math

import numpy as np
import pytest

from rastermill.operators import columns, fill, overlays, repairs
from test_rules import column_table, pixels
from test_skies import predicted_table, to_rgb


def test_t_profile(spark):
    r = np.random.default_rng(1)
    h, w = 40, 4
    v = r.integers(20000, 20400, (h, w, 3))
    v[:, 1] = 30000  # no spread, no difference
    v[25:, 2], v[:25, 2] = 9000, 30000  # no spread, then another colour
    raw = [0, 2, 1, 7]
    got = {(q.x, q.y): q.p for q in columns.t_profile(pixels(spark, v), column_table(spark, w, raw_sos=raw), h).collect()}
    assert set(got) == {(x, y) for x in range(w) for y in range(max(10, raw[x] + 10), h - 10)}
    for (x, y), p in got.items():
        above = v[y - 10 : y, x].astype(float)
        off, error = np.abs(above.mean(axis=0) - v[y, x]), above.std(axis=0, ddof=1) / math.sqrt(10)
        t = max((o / e if e else math.inf if o else 0.0) for o, e in zip(off, error))
        dist = math.sqrt((off**2).sum())
        assert p == pytest.approx(1 - min(1, 0.1 * math.log(1 + (dist if dist < 0.02 else t))), abs=1e-9)
    assert got[1, 20] == 1 and got[2, 25] == 0


def test_two_bands(spark):
    r = np.random.default_rng(2)
    h, w = 30, 3
    v = r.integers(10000, 40000, (h, w, 3))
    got = {(q.x, q.y): q for q in repairs.two_band_probability(pixels(spark, v)).collect()}
    assert set(got) == {(x, y) for x in range(w) for y in range(9, h - 5)}
    for (x, y), q in got.items():
        up, down = v[y - 9 : y + 1, x] / 65535, v[y + 1 : y + 6, x] / 65535
        m1, m2, s1, s2 = up.mean(axis=0), down.mean(axis=0), up.std(axis=0, ddof=1), down.std(axis=0, ddof=1)
        t = (m1 - m2) / np.sqrt(s1**2 / 10 + s2**2 / 5)
        assert np.allclose([q.t_r, q.t_g, q.t_b], t) and q.mean_diff == pytest.approx(np.abs(m1 - m2).sum())
        assert q.color_dist == pytest.approx(math.sqrt((((m2 - m1) / m1) ** 2).sum())) and q.cv_diff == pytest.approx(np.abs(s2 / m2 - s1 / m1).mean())
        x9 = np.linspace(0, abs(t[0]), 20001)  # Student's density with 9 degrees of freedom, by the trapezoid rule
        f = math.gamma(5) / (math.sqrt(9 * math.pi) * math.gamma(4.5)) * (1 + x9**2 / 9) ** -5
        assert q.p_r == pytest.approx(0.5 + ((f[1:] + f[:-1]) / 2 * np.diff(x9)).sum(), abs=1e-5)
        assert q.p_diff == pytest.approx((q.p_r + q.p_g + q.p_b) / 3 * q.mean_diff / 3)


def test_factors_beside_a_range(spark):
    r = np.random.default_rng(3)
    h, w, left, right = 16, 40, 18, 22
    hsv = np.stack([200 + r.random((h, w)) * 9, 0.3 + 0.3 * r.random((h, w)), 0.5 + 0.2 * r.random((h, w))], axis=-1)
    hsv[:, 9, 1] = 0.05  # too pale to count
    v = np.array([[to_rgb(k[0] * (1 + 0.002 * y), min(1, k[1] * (0.9 + 0.01 * y)), k[2]) for k in hsv[y]] for y in range(h)])
    predicted = predicted_table(spark, v, np.full((h, w), 65535), hsv)
    for masks in ([12], [12, *range(22, 40)], [x for x in range(w) if not left <= x < right]):
        mask = [int(x in masks) for x in range(w)]
        q = fill.hue_repair_factors(predicted, column_table(spark, w, sos=2, eos=13, column_mask=mask), left, right).first()
        rows = {}
        for side, xs in (("l", range(left - 10, left)), ("r", range(right, right + 10))):
            pts = [(x, y) for x in xs for y in range(2, 14) if not mask[x] and hsv[y, x, 1] > 0.1]
            ratio = {c: [] for c in "sh"}
            for x, y in pts:
                top, low = max(v[y, x]), min(v[y, x])
                red, green, blue = v[y, x]
                hue = (60 * (green - blue) / (top - low) if top == red else 60 * (blue - red) / (top - low) + 120 if top == green else 60 * (red - green) / (top - low) + 240) % 360
                ratio["s"].append((top - low) / top / hsv[y, x, 1])
                ratio["h"].append(hue / hsv[y, x, 0])
            rows[side] = {c: np.polyfit([y for _, y in pts], ratio[c], 1)[::-1] if len(pts) > 2 else None for c in "sh"} | {"n": len(pts)}
        assert (q.n_l, q.n_r) == (rows["l"]["n"], rows["r"]["n"])
        for side, other in (("l", "r"), ("r", "l")):
            for c in "sh":
                want = rows[side][c] if rows[side][c] is not None else rows[other][c] if rows[other][c] is not None else (1.0, 0.0)
                assert np.allclose([q[f"{c}_{side}0"], q[f"{c}_{side}1"]], want, atol=1e-6)


def test_ends_by_class_and_certainty(spark):
    px = spark.createDataFrame([(0, x, y, 1 if (x, y) in {(0, 12), (1, 17), (2, 30)} else 4, 0.8 if (x, y) in {(2, 13), (0, 8)} else 0.75) for x in range(3) for y in range(40)], "image_id int, x int, y int, pixel_class int, p_hat double")
    col = column_table(spark, 3, eos=10)
    assert {r.x: r.extended_eos for r in columns.extend_end_by_class(px, col).collect()} == {0: 12, 1: 10, 2: 13}
    assert {r.x: r.extended_eos for r in columns.extend_end_by_class(px.drop("p_hat"), col).collect()} == {0: 12, 1: 10, 2: 10}


def test_marks_of_classes_lie_lowest(spark):
    px = pixels(spark, np.zeros((12, 3, 3), int)).selectExpr("image_id", "x", "y", "CASE WHEN y < 6 THEN 1 ELSE 4 END AS pixel_class")
    col = column_table(spark, 3, raw_sos=2, sos=3, eos=6).selectExpr("*", "CAST(NULL AS INT) AS manual_eos")
    rects = spark.createDataFrame([], "image_id int, l int, r int, t int, b int")
    smp = spark.createDataFrame([], "image_id int, x int, y int, v_error double")
    got = {(q.x, q.y): (q.layer, q.r, q.g, q.b) for q in overlays.audit_marks(col, smp, rects, 3, 12, classes=px).collect()}
    assert got[0, 0] == (0, 32767, 32767, 65535) and got[0, 2] == (2, 65535, 0, 0) and got[1, 8][0] == 5 and (0, 7) not in got


def test_dark_top(spark):
    knots = [1.0] * 101
    rows = [(0, [[200.0, 20.0, 8.0, 0.5, 0.0]] * 2, [[0.2, 1.0, 1.5, 0.0, 0.1]] * 2, [0.2, 0.1, 2.5, 0.0], knots, 0.1, 0.0, 0.0, 120.0), (1, [[200.0, 20.0, 8.0, 0.5, 0.0]] * 2, [[0.2, 1.0, 1.5, 0.0, 0.1]] * 2, [0.2, 0.6, 2.5, 0.0], knots, 0.1, 0.0, 0.0, 120.0)]
    models = spark.createDataFrame(rows, "image_id int, h_coefs array<array<double>>, s_coefs array<array<double>>, v_coefs array<double>, knots array<double>, horizon_py double, curvature double, slope double, fov double")
    smp = spark.createDataFrame([(k, 0.4) for k in (0, 1)] + [(k, 0.6) for k in (0, 1)], "image_id int, py double")
    got = {r.image_id: r for r in fill.dark_top_check(models, smp, 40, 25).collect()}
    value = lambda p, py: p[1] + p[0] * (math.exp(math.cos(p[2] * (py - 0.1) * math.radians(120) * 25 / 40)) / math.e - math.exp(-2)) * 1.156517642
    for r in rows:
        dark = value(r[3], 1.0) < 100 / 255 and value(r[3], 1.0) < value(r[3], 0.5)
        assert got[r[0]].n_dark == (101 if dark else 0) and got[r[0]].dark_top == dark
    assert got[0].dark_top and not got[1].dark_top

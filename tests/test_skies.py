"""Replacement, fill, overlays, forecasts and sample texts against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.functions import geometry, model
from rastermill.operators import columns, fill, overlays, sky_model
from rastermill.sources import rasters
from test_rules import column_table, pixels


def to_rgb(h, s, v):
    """Channels of a colour, truncated."""
    i, f = int(h // 60) % 6, h / 60 - int(h // 60)
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    return [int(c * 65535) for c in ((v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q))[i]]


def to_sv(r, g, b):
    top, low = max(r, g, b), min(r, g, b)
    return (top - low) / top if top else 0.0


def predicted_table(spark, v, a, hsv):
    """Pixels with a prediction hsv (h, w, 3)."""
    h, w = a.shape
    rows = []
    for y in range(h):
        for x in range(w):
            k = [float(c) for c in hsv[y, x]]
            rows.append((0, x, y, *map(int, v[y, x]), int(a[y, x]), x / (w - 1) - 0.5, 1 - y / (h - 1), *k, *to_rgb(*k)))
    names = "image_id int, x int, y int, r int, g int, b int, a int, px double, py double, h_hat double, s_hat double, v_hat double, r_hat int, g_hat int, b_hat int"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def scene(spark):
    r = np.random.default_rng(11)
    h, w = 22, 9
    hsv = np.stack([200 + r.random((h, w)) * 20, 0.4 + 0.2 * r.random((h, w)), 0.6 + 0.2 * r.random((h, w))], axis=-1)
    v = np.array([[to_rgb(*(k * [1, f, g])) for k, f, g in zip(row, r.choice([1, 0.97, 0.5], w), r.choice([1, 1.01, 0.7], w))] for row in hsv])
    a = r.choice([65535, 65535, 65535, 40000, 0], (h, w))
    sos, eos = r.integers(2, 6, w), r.integers(12, 20, w)
    manual = [None, 15, None, 19, None, None, 10, None, 18]
    nonsky, mask = [0, 0, 1, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 1, 0, 0, 0]
    rows = [(0, x, int(sos[x]), int(sos[x]), int(eos[x]), manual[x], nonsky[x], mask[x]) for x in range(w)]
    col = spark.createDataFrame(rows, "image_id int, x int, raw_sos int, sos int, eos int, manual_eos int, nonsky_mask int, column_mask int")
    return v, a, hsv, sos, eos, manual, nonsky, mask, predicted_table(spark, v, a, hsv).cache(), col.cache()


SUN = dict(sun_px=0.1, sun_py=0.6, cf=0.7, cg=0.3)


def replaced_by_loops(scene, sun, zenith, factors, fade, only_transparent, depth=0.5):
    v, a, hsv, sos, eos, manual, nonsky, mask, _, _ = scene
    h, w = a.shape
    out, share = {}, {}
    zen = None
    if zenith:
        top = np.mean([hsv[0, x] for x in range(w) if not mask[x]], axis=0)
        zen = to_rgb((top[0] + factors[0]) % 360, min(1, top[1] * factors[1]), min(1, top[2] * factors[2]))
    for x in range(w):
        for y in range(h):
            out[x, y] = (*v[y, x], a[y, x])
        if mask[x]:
            continue
        end = manual[x] if manual[x] is not None else eos[x]
        fe = min(sos[x] + int((end - sos[x]) * depth + 0.5), end)
        y = 0
        last = end
        while y < last:
            k = hsv[y, x].copy()
            rgb = v[y, x].astype(float)
            i, i_hat = rgb.mean(), np.mean(to_rgb(*k))
            hat = np.array(to_rgb(*k), float)
            prob = 1 - (hat * np.abs(hat - rgb) / 65535).sum() / hat.sum()
            p_hat = 1 / (1 + math.exp(-(prob - 0.9) * 200))
            s = to_sv(*v[y, x])
            if s < k[1]:
                p_hat *= (i_hat / i if i > i_hat else i / i_hat) * s / k[1]
            p_hat = min(1, max(0, p_hat))
            near = 0.0
            if sun:
                d = math.hypot(x / (w - 1) - 0.5 - SUN["sun_px"], (1 - y / (h - 1) - SUN["sun_py"]) * h / w) / SUN["cg"]
                near = SUN["cf"] * math.sqrt(1 if d < 1 else 1 - 1 / (1 + math.exp(5 - 10 * (d - 1))))
            if y < sos[x]:
                k[1:] *= 1 - (1 - y / sos[x]) * (1 - np.array(factors[1:]))
            hat = np.array(to_rgb(k[0], min(1, k[1]), min(1, k[2])))
            zl = int(fe * zenith + 0.5) if zenith else 0
            if zl and y <= zl:
                hat = np.floor((zl - y) / zl * np.array(zen) + (1 - (zl - y) / zl) * hat + 0.5)
            p = 1.0
            if y >= sos[x]:
                feather = 1 - (y - sos[x]) / (fe - sos[x]) if y <= fe and fe > sos[x] else 0.0
                off = 1 / (1 + math.exp(2.5))
                feather = (1 / (1 + math.exp(-(feather - 0.5) * 5)) - off) / (1 - 2 * off)
                p = max(p_hat, feather)
                if nonsky[x]:
                    p = p_hat * max(p, near) + (1 - p_hat) * p_hat
                else:
                    if fade and y > fe:
                        p *= 1 - (y - fe) / (end - fe)
                    p = max(p, near)
                if a[y, x] < 65535:
                    p = 1.0
                hat = np.floor(p * hat + (1 - p) * rgb + 0.5)
            share[x, y] = p
            if not only_transparent or a[y, x] == 0:
                out[x, y] = (*hat, 65535)
            if y == end - 1 and last == end and end - 1 < h - 3 and max(v[end, x]) > max(hat) and max(v[end, x]) > max(v[end + 1, x]):
                last = end + 1
            y += 1
    return out, share


@pytest.mark.parametrize("sun,zenith,factors,fade,only", [(False, None, (0.0, 1.0, 1.0), False, False), (True, None, (0.0, 0.9, 1.1), True, False), (True, 0.7, (-15.0, 0.8, 1.05), False, True)])
def test_replacement(spark, scene, sun, zenith, factors, fade, only):
    predicted, col = scene[-2:]
    h, w = scene[1].shape
    suns = spark.createDataFrame([(0, w, h, *SUN.values())], "image_id int, width int, height int, " + ", ".join(f"{c} double" for c in SUN)) if sun else None
    want, share = replaced_by_loops(scene, sun, zenith, factors, fade, only)
    got = fill.replace_sky(predicted, col, suns=suns, zenith=zenith, factors=factors, fade=fade, only_transparent=only).collect()
    assert len(got) == h * w
    for q in got:
        assert np.abs(np.array([q.r, q.g, q.b, q.a]) - want[q.x, q.y]).max() <= 1, (q, want[q.x, q.y])
        assert (q.p is None) == ((q.x, q.y) not in share) and (q.p is None or abs(q.p - share[q.x, q.y]) < 1e-6)


def test_fill_towards_the_zenith(scene):
    v, a, hsv, sos, eos, _, _, mask, predicted, col = scene
    h, w = a.shape
    got = {(q.x, q.y): q for q in fill.fill_sky_columns(predicted, col, h, zenith=(0.5, 0.25), factors=(5.0, 0.9, 1.1)).collect()}
    corr = {r.x: r for r in fill.smooth_corrections(fill.column_corrections(predicted, col, h)).collect()}
    seen = [x for x in range(w) if not mask[x]]
    start, end = max(sos[x] for x in seen), int(0.25 * max(eos[x] for x in seen) + 0.75 * min(eos[x] for x in seen))
    fe = min(start + int((end - start) * 0.5 + 0.5), end)
    top = np.mean([hsv[0, x] for x in seen], axis=0)
    zen, zl = np.array(to_rgb(top[0] + 5, top[1] * 0.9, min(1, top[2] * 1.1))), int(fe * 0.5 + 0.5)
    for (x, y), q in got.items():
        want, alpha = v[y, x], a[y, x]
        if not mask[x] and y < fe and not (a[y, x] < 32767 and y > sos[x]):
            k, c = hsv[y, x].copy(), corr[x]
            if y < start:
                k[1:] *= 1 - (1 - y / start) * (1 - np.array([0.9, 1.1]))
            hat = np.array(to_rgb(k[0] * c.h_corr, min(1, k[1] * c.s_corr), min(1, k[2] * c.v_corr)))
            if y <= zl:
                hat = np.floor((zl - y) / zl * zen + (1 - (zl - y) / zl) * hat + 0.5)
            p = 1 - (y - start) / (fe - start) if y >= start and v[y, x, 2] >= 0.04 * 65535 else 1.0
            want, alpha = np.floor(p * hat + (1 - p) * v[y, x] + 0.5), 65535
        assert np.abs(np.array([q.r, q.g, q.b]) - want).max() <= 1 and q.a == alpha, (x, y)


def test_sun_in_the_prediction(spark):
    rows = [(s, v, glow, lo, hi, lum, depth) for s in (0.1, 0.6, 1.2) for v in (-0.1, 0.5, 0.95) for glow in (0.9, 1.5, 4.0) for lo, hi in ((1.0, 3.0),) for lum in (0.8, -0.5) for depth in (1.0, 0.7)]
    d = spark.createDataFrame(rows, "s double, v double, glow double, lo double, hi double, lum double, depth double")
    d = d.withColumn("q", model.with_sun(*[F.col(c) for c in ("s", "v", "glow", "lo", "hi", "lum", "depth")]))
    for r in d.collect():
        add = max(0.0, abs(r.lum) * (min(1, r.glow / r.hi) * r.hi - r.lo) / (r.hi - r.lo))
        s, v = min(1, max(0, r.s)), min(1, max(0, r.v))
        want = (min(1, max(0, s - add)) * r.depth, min(1, v + add)) if r.lum > 0 else (s * r.depth, min(1, add))
        assert np.allclose((r.q.s, r.q.v), want)


def ghosts_by_loops(v, ghosts, sun):
    out = v.astype(float).copy()
    touched = np.zeros(v.shape[:2], bool)
    for gx, gy, radius, *intensity, e, b, c, ca, n, circle in ghosts:
        reach = radius * math.sqrt(2) + 1 + ca
        for y in range(max(0, math.floor(gy - reach)), min(v.shape[0] - 1, math.floor(gy + reach)) + 1):
            for x in range(max(0, math.floor(gx - reach)), min(v.shape[1] - 1, math.floor(gx + reach)) + 1):
                for k, off in enumerate((ca, 0, -ca)):
                    cx, cy = gx + off * (gx - sun[0]) / 1000, gy + off * (gy - sun[1]) / 1000
                    sides = []
                    for leaf in range(n):
                        t = math.radians(360 / n * leaf)
                        px, py = cx + math.cos(t) * radius, cy + math.sin(t) * radius  # a point on the side's line
                        sides.append(((px - x) * (px - cx) + (py - y) * (py - cy)) / radius)
                    if min(sides) <= 0:
                        continue
                    d = circle * (radius - math.hypot(x - cx, y - cy)) + (1 - circle) * min(sides)
                    r = 1 - d / radius
                    if d <= 0 or not 0 <= r <= 1:
                        continue
                    light = (1 - r) ** e if b <= 0 else c + math.exp(-(b - r) * e) * (1 - c) if r < b else 1 - (r - b) / (1 - b)
                    out[y, x, k] += light * intensity[k] * min(1, d) * 65535
                    touched[y, x] = True
    return np.where(touched[..., None], np.minimum(65534, np.floor(out)), v)


def test_ghosts(spark):
    v = np.random.default_rng(2).integers(0, 65536, (24, 30, 3))
    ghosts = [(8.0, 9.0, 5.0, 0.3, 0.2, 0.1, 2.0, 0.6, 0.4, 40.0, 6, 0.3), (20.0, 14.0, 6.5, 0.1, 0.2, 0.5, 1.5, 0.0, 0.0, 0.0, 3, 0.0), (9.5, 10.0, 4.0, 0.5, 0.5, 0.5, 3.0, 0.9, 0.2, -20.0, 12, 1.0)]
    names = "x double, y double, radius double, i_r double, i_g double, i_b double, e double, b double, c double, max_ca double, n_leaves int, pcircle double"
    table = spark.createDataFrame([*ghosts, (15.0, 15.0, 5.0, 1.0, 1.0, 1.0, 1.0, 0.5, 0.5, 0.0, 2, 0.0)], names).selectExpr("0 AS image_id", "*", "22 AS sun_x", "3 AS sun_y")
    want = ghosts_by_loops(v, ghosts, (22, 3))
    got = overlays.overlay_ghosts(pixels(spark, v), table).collect()
    assert (want != v).any() and all(np.abs(np.array([q.r, q.g, q.b]) - want[q.y, q.x]).max() <= 1 for q in got)


def test_rays(spark):
    v = np.random.default_rng(4).integers(0, 50000, (30, 34, 3))
    sx, sy, want = 15, 12, v.astype(float).copy()
    rays = [(math.sin(t) * -1, math.cos(t), radius, width, inten, hue, fa, fb, grp) for t, radius, width, inten, hue, fa, fb, grp in ((0.3, 18.0, 3.0, 0.6, 90.0, 0.65, 10.0, 1), (2.0, 14.0, 4.0, 0.4, 300.0, 0.5, 5.0, 2), (-1.2, 20.0, 2.0, 0.7, 10.0, 0.4, 8.0, 3))]
    lit = np.zeros(v.shape[:2], bool)
    for y in range(30):
        for x in range(34):
            rx, ry = x - sx, y - sy
            for a, b, radius, width, inten, hue, fa, fb, grp in rays:
                if rx * b - ry * a < 0:
                    continue
                long = radius * ((-a + 1) / 2 * 0.5 + 0.5)
                d = a * rx + b * ry
                along = math.sqrt(max(0, rx * rx + ry * ry - d * d))
                pr = along / long
                if pr > 1:
                    continue
                half = (0.25 + 0.75 * pr) * width
                if long - along <= half:
                    half *= math.sqrt(1 - (1 - (long - along) / half) ** 2)
                f = half - abs(d)
                if f <= 0:
                    continue
                across = 1 / (1 + math.exp((1 - f / half - fa) * fb))
                turned = hue + (360 if grp % 2 else 720) * pr
                for _ in range(2):
                    turned -= 360 if turned >= 360 else 0
                s = min(1, 0.8 / (1 + math.exp(-(pr - 0.4) * 10)))
                want[y, x] += to_rgb(turned, s, inten * math.exp(-6 * pr) * min(1, f) * across)
                lit[y, x] = True
    want = np.where(lit[..., None], np.minimum(want, 65534), v)
    table = spark.createDataFrame(rays, "ra double, rb double, radius double, width double, intensity double, hue_start double, falloff_a double, falloff_b double, grp int").selectExpr("0 AS image_id", "*", f"{sx} AS sun_x", f"{sy} AS sun_y")
    got = overlays.overlay_rays(pixels(spark, v), table, saturation=0.8).collect()
    assert lit.sum() > 40 and all(np.abs(np.array([q.r, q.g, q.b]) - want[q.y, q.x]).max() <= 2 for q in got)


def test_forecast_end(spark):
    r = np.random.default_rng(5)
    h, w, window = 90, 5, 4
    v = np.stack([12000 + 90 * np.arange(h)[:, None] + 40 * np.arange(w), 24000 + 60 * np.arange(h)[:, None] + 0 * np.arange(w), 46000 - 50 * np.arange(h)[:, None] + 0 * np.arange(w)], axis=-1) + r.integers(-60, 60, (h, w, 3))
    v[60:] = r.integers(2000, 9000, (30, w, 3))
    raw = [0, 3, 1, 5, 2]
    alpha, beta = 0.02, 4.0
    got = {q.x: q for q in columns.ar_end(pixels(spark, v), column_table(spark, w, raw_sos=raw, eos=h - 1), h, window, alpha, beta).collect()}
    f = v / 65535
    for x in range(w):
        first = raw[x] + window // 2
        near = f[:, max(0, x - 1) : x + 2]
        mean = {y: near[max(0, y - window // 2) : y + window // 2].mean(axis=(0, 1)) for y in range(first, h - 1 - window)}
        begin, found = first + window + window // 2, None
        for y in range(begin, h - 1 - window):
            rows = range(max(begin, y - 5 * window), y)
            if len(rows) > 2:
                err2, mse = [], []
                for c in range(3):
                    design = np.array([[mean[k - window - window // 2][c], mean[k - window][c]] for k in rows])
                    aim = np.array([mean[k][c] for k in rows])
                    b = np.linalg.lstsq(design, aim, rcond=None)[0]
                    err2.append((b @ [mean[y - window - window // 2][c], mean[y - window][c]] - mean[y][c]) ** 2)
                    mse.append(((design @ b - aim) ** 2).sum() / len(rows) * ((4 / len(rows)) ** 10 if len(rows) < 4 else 1))
                if np.mean(err2) > beta * np.mean(mse) and np.mean(err2) > alpha**2:
                    found = y
                    break
        assert got[x].found == found and got[x].eos == max((found or h - 1) - window, raw[x] + 20)
    assert {q.found for q in got.values()} <= set(range(57, 63))


def test_black_runs_along_rows(spark):
    r = np.random.default_rng(6)
    h, w = 12, 60
    black, clear, mask = r.random((h, w)) < 0.4, r.random((h, w)) < 0.12, (r.random(w) < 0.1).astype(int)
    black[3, 20:28], clear[3, 19] = True, True
    v = np.where(black, 900, 30000)[..., None] * np.ones((1, 1, 3), int)
    a = np.where(clear, 0, 65535)
    want = a.copy()
    is_black = lambda x, y: want[y, x] >= 16384 and black[y, x]
    low, high = 1, 9
    for y in range(low, high + 1):
        x, end = 0, w - 1
        while x < end:
            if want[y, x] < 16384 and is_black(x + 1, y) and not mask[x + 1]:
                want[y, x + 1], end = 0, min(x + 10, w - 1)
            x += 1
        x, end = w - 1, 0
        while x > end:
            if want[y, x] < 16384 and is_black(x - 1, y) and not mask[x - 1]:
                want[y, x - 1], end = 0, max(x - 10, 0)
            x -= 1
    sos = [low if x % 2 else high for x in range(w)]
    got = {(q.x, q.y): q.a for q in columns.clear_black_edges(pixels(spark, v, a), column_table(spark, w, sos=sos, column_mask=mask)).collect()}
    assert (want != a).sum() > 20 and all(got[x, y] == want[y, x] for y in range(h) for x in range(w))


def test_sample_texts_round_trip(spark, tmp_path):
    r = np.random.default_rng(7)
    rows = [(0, float(px), float(r.random()), 200 + float(r.random()), float(r.random()), float(r.random()), 205.0, 0.5, 0.6, int(r.integers(0, 9)), *map(int, r.integers(0, 65536, 3)), 0.01, 0.02, 0.03, 110.0) for px in np.linspace(-0.5, 0.5, 12)]
    names = "image_id int, px double, py double, h double, s double, v double, h_hat double, s_hat double, v_hat double, n_close int, r int, g int, b int, cv_r double, cv_g double, cv_b double, fov double"
    smp = spark.createDataFrame(rows, names).coalesce(1)
    rasters.write_samples(smp, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text().splitlines()
    bad = ["px py h s v and more words of a header", "1 2 3", text[0].replace(f" {rows[0][9]} ", " 2.5 ", 1) if f" {rows[0][9]} " in text[0] else "x", ""]
    (tmp_path / "s.txt").write_text("\n".join([bad[0], *text[:5], *bad[1:], *[t + " 7 extra" for t in text[5:]]]) + "\n")
    got = rasters.read_samples(spark, str(tmp_path / "s.txt")).orderBy("px").collect()
    assert len(got) == 12 and {q.n_bad for q in got} == {3} and {round(q.fov, 9) for q in got} == {110.0}
    assert all(q.lowest_py == min(x[2] for x in rows) for q in got)
    for q, want in zip(got, rows):
        assert [q[c] for c in "px py h s v h_hat s_hat v_hat n_close r g b cv_r cv_g cv_b".split()] == list(want[1:16])
        assert q.x == math.floor((want[1] + 0.5) * 100000 + 0.5) and q.v_err == pytest.approx(want[8] - want[5])
    report = smp.selectExpr("*", "CAST(100 * (px + 0.5) AS INT) AS x", "3 AS y", "v AS normalized_v", "s AS normalized_s", "0 AS is_outlier").drop("fov")
    rasters.write_sample_report(report, spark.createDataFrame([(0, 40, 25, 110.0)], "image_id int, width int, height int, fov double"), str(tmp_path / "report"))
    lines = next((tmp_path / "report").rglob("part-*.csv")).read_text().splitlines()
    assert lines[0].split() == "x y ha va px py hue sat val nv ns hue_hat sat_hat val_hat hue_err sat_err val_err n_close r g b cv_r cv_g cv_b symbol".split() and len(lines) >= 2


def test_knots_and_pixels_are_written(spark, tmp_path):
    knots = spark.createDataFrame([(0, 1, 0.25, 0.5, 0.75)], "image_id int, k int, px double, base_v double, base_s double")
    rasters.write_knots(knots, str(tmp_path / "k"))
    assert spark.read.csv(str(tmp_path / "k"), sep=" ", header=True, inferSchema=True).collect() == knots.collect()
    px = pixels(spark, np.arange(12).reshape(2, 2, 3)).union(pixels(spark, np.arange(12).reshape(2, 2, 3), image=4))
    rasters.write_pixels(px, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).select(*px.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, px.collect())) and sorted(p.name for p in (tmp_path / "p").glob("image_id=*")) == ["image_id=0", "image_id=4"]


def test_dither(spark):
    px = pixels(spark, np.full((20, 20, 3), 30000))
    one, two = (sorted(map(tuple, fill.dither(px.repartition(n), 3).collect())) for n in (1, 5))
    assert one == two and one != sorted(map(tuple, fill.dither(px, 4).collect()))
    steps = np.array([r[3:6] for r in one]) - 30000
    assert (steps % 8 == 0).all() and steps.min() >= -512 and steps.max() <= 504 and len(np.unique(steps)) > 60 and abs(steps.mean()) < 40
    assert {r[3] for r in map(tuple, fill.dither(pixels(spark, np.full((6, 6, 3), 65535)), 3).collect())} <= set(range(65535))


@pytest.mark.parametrize("sphere", [False, True])
def test_angles_to_the_sun(spark, sphere):
    px, py = np.meshgrid(np.linspace(-0.5, 0.5, 7), np.linspace(0, 1.4, 8))
    got = sky_model.angle_to_sun(px.ravel(), py.ravel(), 0.1, 0.6, math.radians(100), 0.75, sphere)
    d = spark.createDataFrame(np.stack([px.ravel(), py.ravel()], 1).tolist(), "px double, py double")
    if sphere:
        look = lambda x, y: (lambda q: geometry.view_vector(q["aoy"], q["aox"]))(geometry.view_angles(x, y, F.lit(100.0), F.lit(4), F.lit(3)))
        gamma = geometry.angle_between(look(F.col("px"), F.col("py")), look(F.lit(0.1), F.lit(0.6)))
    else:
        gamma = F.sqrt(F.pow((F.col("px") - 0.1) * math.radians(100), F.lit(2.0)) + F.pow((F.col("py") - 0.6) * math.radians(75), F.lit(2.0)))
    want = np.array([r[0] for r in d.select(gamma).collect()])
    assert np.allclose(got, np.where(want < math.radians(0.533) / 2, 0, want), atol=1e-7)
    level = spark.createDataFrame([(0.3, 0.5)], "px double, py double").select(geometry.adjust_horizon(F.col("px"), F.col("py"), F.lit(-0.1), F.lit(0.05))).first()[0]
    assert sky_model.level_py(np.array([0.3]), np.array([0.5]), -0.1, 0.05)[0] == pytest.approx(level)

"""Local fits and the repairs by them, against plain loops."""

import numpy as np
import pytest

from rastermill.operators import local_fit, repairs
from test_rules import column_table, pixels


def smooth(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([12000 + 40 * x + 60 * y + 2 * y * y, 24000 + 30 * y, 46000 + 10 * x + 0 * y], axis=-1)


def fit_by_loops(v, a, cx, cy, width, sos, eos, mask, clip, step, retry, limit=0.02):
    """(pixels looked at, those kept, function of x and y that gives the colour) or None."""
    h, w = a.shape
    near = []
    for x in range(max(0, cx - width), min(w - 1, cx + width) + 1, step):
        if mask[x]:
            continue
        top, low = max(cy - width, sos[x]), min(cy + width, eos[x]) if clip else cy + width
        near += [(x, y) for y in range(top, low + 1, step) if y < h and a[y, x] == 65535]
    again = lambda: fit_by_loops(v, a, cx, cy, 2 * width, sos, eos, mask, clip, step, False, limit) if retry else None
    if len(near) < 16:
        return again()
    weights = np.array([1 / (abs(x - cx) + abs(y - cy) + 1) for x, y in near])
    colors = np.array([v[y, x] for x, y in near], float)
    mean = weights @ colors / weights.sum()
    kept = [p for p, c in zip(near, colors) if (np.abs(c - mean) / mean <= limit).all()]
    if len(kept) < 8:
        return again()
    xs, ys = np.array(kept).T
    terms = [lambda x, y: 1.0]
    if np.ptp(xs) > 0:
        terms.append(lambda x, y: x - cx)
    if np.ptp(ys) > 0:
        terms.append(lambda x, y: y - cy)
    if np.ptp(ys) > 1:
        terms.append(lambda x, y: (y - cy) ** 2)
    design = np.array([[t(x, y) for t in terms] for x, y in kept], float)
    beta = np.linalg.lstsq(design, np.array([v[y, x] for x, y in kept], float), rcond=None)[0]
    return near, kept, lambda x, y: np.clip(np.array([t(x, y) for t in terms]) @ beta, 0, 65535)


def scene(seed, h=24, w=26, low=14):
    r = np.random.default_rng(seed)
    v = (smooth(h, w) * r.uniform(0.996, 1.004, (h, w, 3))).astype(int)
    odd = r.random((h, w)) < 0.06
    v[odd] = r.integers(500, 65000, (odd.sum(), 3))
    a = np.where(r.random((h, w)) < 0.08, r.choice([0, 40000], (h, w)), 65535)
    sos, eos = r.integers(0, 4, w), r.integers(low, h - 2, w)
    mask = (r.random(w) < 0.1).astype(int)
    return v, a, sos, eos, mask


@pytest.mark.parametrize("clip,step,retry,width", [(True, 1, True, 3), (False, 2, True, 4), (True, 1, False, 2), (False, 1, True, 1)])
def test_local_fits(spark, clip, step, retry, width):
    v, a, sos, eos, mask = scene(width)
    col = column_table(spark, 26, sos=sos, eos=eos, column_mask=mask)
    places = [(0, x, y) for x in range(0, 29, 3) for y in range(0, 27, 4)]
    d = spark.createDataFrame(places + places[:3], "image_id int, cx int, cy int")
    got = {(q.cx, q.cy): q for q in local_fit.local_fits(pixels(spark, v, a), col, d, width, clip_end=clip, step=step, retry=retry).withColumns({c: local_fit.fitted(c, 1, -1) for c in "rgb"}).collect()}
    found = 0
    for _, x, y in places:
        want = fit_by_loops(v, a, x, y, width, sos, eos, mask, clip, step, retry)
        assert ((x, y) in got) == (want is not None), (x, y)
        if want:
            q, (near, kept, color) = got[x, y], want
            found += 1
            assert (q.n_near, q.n) == (len(near), len(kept))
            xs, ys = np.array(kept).T
            if len(set(ys)) > 2 and len(kept) > 8:  # else the regression has several solutions
                assert np.allclose([q.r, q.g, q.b], color(x - 1, y + 1), atol=0.01)
    assert found > 5


def test_repaired_pixels_are_those_left_out(spark):
    v, a, sos, eos, mask = scene(9, h=44, low=34)
    repair = np.zeros(26, int)
    repair[4] = 1
    col = column_table(spark, 26, sos=sos, eos=eos, column_mask=mask)
    col = col.join(spark.createDataFrame([(x, int(repair[x])) for x in range(26)], "x int, repair_mask int"), "x")
    got = {(q.x, q.y): (q.r, q.g, q.b) for q in repairs.repair_outlier_pixels(pixels(spark, v, a), col).collect()}
    best = {}
    for cx in range(5, 26 - 5, 5):
        free = [x for x in range(cx - 5, cx + 6) if not mask[x] and not repair[x]]
        y0, y1 = max(sos[x] for x in free), min(eos[x] for x in free)
        for cy in range((y0 + y1) // 2 - 5, y0, -5):
            fit = fit_by_loops(v, a, cx, cy, 5, sos, eos, mask, True, 1, True)
            if fit:
                for x, y in set(fit[0]) - set(fit[1]):
                    if not repair[x]:
                        best[x, y] = min(best.get((x, y), (1 << 30,)), (abs(x - cx) + abs(y - cy), cy, cx, fit[2](x, y)), key=lambda b: b[:3])
    assert set(got) == set(best) and len(got) > 3
    assert all(np.abs(np.array(got[k]) - best[k][3]).max() <= 1.01 for k in got)


def test_edges_beside_transparent_pixels(spark):
    v, a = smooth(20, 20) // 8 + 20000, np.full((20, 20), 65535)
    plain = v.copy()
    a[:9, 10] = 0
    v[5, 11], v[6, 9] = v[5, 11] * 1.05, v[6, 9] * 0.95
    col = column_table(spark, 20, sos=[9 if x == 10 else 0 for x in range(20)], eos=19)
    got = {(q.x, q.y): (q.r, q.g, q.b) for q in repairs.clean_vertical_edges(pixels(spark, v, a), col).collect()}
    assert set(got) == {(11, 5), (9, 6)}
    assert all(np.abs(np.array(c) - plain[y, x]).max() < 60 for (x, y), c in got.items())


def test_gaps_inside_columns(spark):
    v = smooth(40, 20)
    a = np.full((40, 20), 65535)
    a[10:14, 7] = a[20:, 0] = a[25:, 12] = a[5:9, 15] = 0  # inside, at the side, down to the bound, in a masked column
    holed = v.copy()
    holed[a == 0] = 0
    col = column_table(spark, 20, eos=39, column_mask=[int(k == 15) for k in range(20)])
    got = repairs.fill_vertical_gaps(pixels(spark, holed, a), col, 40, width=4).collect()
    filled = {(p.x, p.y): (p.r, p.g, p.b) for p in got}
    assert {(7, k) for k in range(10, 15)} <= set(filled) and not {x for x, _ in filled} & {0, 15}
    assert all(np.abs(np.array(filled[7, y]) - v[y, 7]).max() <= 60 for y in range(10, 15))


def test_starts_are_filled(spark):
    v, a = smooth(24, 20), np.full((24, 20), 65535)
    sos = np.zeros(20, int)
    sos[12], sos[3] = 4, 2
    for x in (12, 3):
        a[: sos[x], x] = 0
    px, col = pixels(spark, v, a), column_table(spark, 20, sos=sos, eos=23, column_mask=[int(x == 3) for x in range(20)])
    got = {(q.x, q.y): (q.r, q.g, q.b) for q in repairs.fill_to_min_start(px, col, 3).collect()}
    assert {k for k in got if k[0] == 12} >= {(12, y) for y in range(1, 5)} and (12, 0) not in got and not any(x == 3 for x, _ in got)
    assert all(np.abs(np.array(got[12, y]) - v[y, 12]).max() < 60 for y in range(1, 5))
    level = repairs.level_start(column_table(spark, 20, sos=sos, eos=23), 20)
    rows = {(q.x, q.y) for q in repairs.fill_levelled_start(px, level, 6).collect()}
    assert rows == {(12, y) for y in (1, 2, 3)} | {(3, 1)}
    raised = local_fit.raised_start(col, repairs.fill_to_min_start(px, col, 3).filter("x = 12")).filter("x = 12").first()
    assert raised.sos == 1


def test_sides(spark):
    v, a = smooth(20, 80), np.full((20, 80), 65535)
    a[6, :3] = a[8, 78:] = a[9, 77:] = 0
    v[7, 0] = (100, 100, 100)  # black
    a[10, :30] = 0  # beyond the outer columns
    sos = np.full(80, 5)
    sos[0] = sos[79] = 12
    got = {(q.x, q.y): (q.r, q.g, q.b) for q in repairs.fill_side_edges(pixels(spark, v, a), column_table(spark, 80, sos=sos, eos=19, column_mask=[int(x == 1) for x in range(80)]), share=10).collect()}
    assert set(got) == {(0, 6), (2, 6), (0, 7), (78, 8), (79, 8), (77, 9), (78, 9), (79, 9)}
    assert all(np.abs(np.array(c) - smooth(20, 80)[y, x]).max() < 300 for (x, y), c in got.items())


def holes_by_loops(seen, sos, mask):
    """{(x, y): corners} of the pixels to fill, the leftmost step first."""
    h, w = seen.shape
    out = {}
    for x in range(w - 1):
        if mask[x] or abs(sos[x + 1] - sos[x]) <= 1:
            continue
        left, top, low = sos[x + 1] > sos[x], min(sos[x], sos[x + 1]), max(sos[x], sos[x + 1])
        ends, is_open = [], False
        for y in range(top + 1, low):
            line = [k for k in (range(x, 0, -1) if left else range(x + 1, w)) if seen[y, k]]
            if line:
                ends.append((line[0], y))
            else:
                is_open = True
        if not ends or (is_open and not left):
            continue
        end, row = min(ends) if left else max(ends, key=lambda e: (e[0], -e[1]))
        if end == (x if left else x + 1):
            continue
        corners = [(end, row), (x, top if left else low), (x + 1, low if left else top)]
        for k in range(end + 1, x + 1) if left else range(x + 1, end):
            for y in range(top + 1, low):
                if not seen[y, k]:
                    out.setdefault((k, y), corners)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_holes_beneath_overhangs(spark, seed):
    r = np.random.default_rng(seed)
    h, w = 26, 30
    v = smooth(h, w)
    sos = np.repeat(r.integers(1, 9, 10), 3)
    a = np.where(np.arange(h)[:, None] < sos[None, :], 0, 65535)
    a[(r.random((h, w)) < 0.35) & (np.arange(h)[:, None] < 9)] = 0
    v[3:8, 11:14] = 4000  # black counts as unseen
    mask = np.zeros(w, int)
    mask[8] = 1
    seen = (a >= 32767) & (v.max(axis=2) > 8621)
    want = holes_by_loops(seen, sos, mask)
    assert want
    col = column_table(spark, w, sos=sos, eos=h - 1, column_mask=mask)
    fits = lambda at: fit_by_loops(v, a, *at, 4, sos, [h - 1] * w, mask, False, 1, True)
    got = {(q.x, q.y): (q.r, q.g, q.b) for q in repairs.fill_overhang_holes(pixels(spark, v, a), col, width=4).collect()}
    checked = 0
    for (x, y), ((x1, y1), (x2, y2), (x3, y3)) in want.items():
        whole = (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)
        three = [fits((x1, y1)), fits((x2, y2)), fits((x3, y3))]
        if not whole or not all(three):
            continue
        w1 = ((y2 - y3) * (x - x3) + (x3 - x2) * (y - y3)) / whole
        w2 = ((y3 - y1) * (x - x3) + (x1 - x3) * (y - y3)) / whole
        color = sum(k * f[2](x, y) for k, f in zip((w1, w2, 1 - w1 - w2), three))
        assert (x, y) in got and np.abs(np.array(got[x, y]) - np.clip(color, 0, 65535)).max() <= 60, (x, y)
        checked += 1
    assert checked

"""Raster rules against plain loops over small rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.operators import columns, fits, repairs


def pixels(spark, v, a=None, image=0):
    h, w = v.shape[:2]
    rows = [(image, x, y, *map(int, v[y, x]), 65535 if a is None else int(a[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int, a int")


def column_table(spark, w, **values):
    names = ["raw_sos", "sos", "eos", "column_mask"]
    rows = [(0, x, *(int(np.broadcast_to(values.get(n, 0), w)[x]) for n in names)) for x in range(w)]
    return spark.createDataFrame(rows, "image_id int, x int, " + ", ".join(f"{n} int" for n in names))


def test_slivers(spark):
    eos = np.full(40, 50)
    eos[5] = eos[12] = eos[13] = 30
    eos[20:23], eos[30:34], eos[36] = 25, 20, 10  # three wide, four wide, too near the edge
    eos[26] = 30
    mask = np.zeros(40, int)
    mask[27] = 1
    want = eos.copy()
    want[5] = want[12] = want[13] = 50
    want[20:23] = 50
    want[36] = 50
    got = columns.fix_slivers(column_table(spark, 40, eos=eos, column_mask=mask), 40).orderBy("x").collect()
    assert [r.fixed_eos for r in got] == want.tolist()


def test_black_edges(spark):
    r = np.random.default_rng(4)
    v = np.where(r.random((40, 8, 1)) < 0.15, 900, 30000) * np.ones((1, 1, 3), int)
    a, raw = np.full((40, 8), 65535), 35
    v[10:30, 3] = 30000  # more than ten good ones: nothing above is looked at
    want = a.copy()
    for x in range(8):
        n_ok = 0
        for y in range(raw - 1, 0, -1):
            if v[y, x, 0] <= 3840:
                want[y, x], n_ok = 0, 0
            elif n_ok > 10:
                break
            else:
                n_ok += 1
    col = column_table(spark, 8, raw_sos=raw, sos=0)
    got = {(p.y, p.x): p.a for p in columns.clear_black_edges(pixels(spark, v, a), col).collect()}
    assert all(got[y, x] == want[y, x] for y in range(1, 40) for x in range(8))


def test_halo(spark):
    r = np.random.default_rng(5)
    v, eos = r.integers(5000, 60000, (20, 6, 3)), np.array([5, 8, 10, 12, 14, 16])
    luma = v @ np.array([0.21126, 0.7152, 0.0722])
    want, final = v.copy(), eos.copy()
    for x in range(6):
        for y in range(eos[x] - 1, eos[x] + 3):
            if luma[y, x] > luma[y - 1, x] and luma[y, x] > luma[y + 1, x]:
                final[x], want[y, x] = y, np.floor(v[y, x] * (luma[y - 1, x] / luma[y, x]) + 0.5)
    for p in columns.trim_halo(pixels(spark, v), column_table(spark, 6, eos=eos)).collect():
        assert [p.r, p.g, p.b] == want[p.y, p.x].tolist() and p.final_eos == final[p.x]


def sky(ends, h=60, w=22):
    r = np.random.default_rng(6)
    y, x = np.mgrid[0:h, 0:w]
    v = np.stack([12000 + 200 * y + 20 * x, 24000 + 150 * y, 46000 + 80 * y + 10 * x], axis=-1) + r.integers(-150, 150, (h, w, 3))
    ground = y > np.asarray(ends)
    v[ground] = r.integers(1000, 9000, (ground.sum(), 3))
    return v


@pytest.mark.parametrize("hole", [False, True])
def test_regression_detector_finds_each_column(spark, hole):
    ends = 30 + (np.arange(22) * 5) % 9
    px = pixels(spark, sky(ends))
    if hole:
        px = px.filter("NOT (x BETWEEN 4 AND 6 AND y BETWEEN 15 AND 17) AND NOT (x = 20 AND y = 12)")
    got = fits.end_of_sky_regression(px, column_table(spark, 22, sos=2), 60).orderBy("x").collect()
    found = np.array([p.eos for p in got])
    assert len(got) == 22 and (np.abs(found - ends) <= 2).mean() > 0.8 and len(set(found)) > 3


def test_clusters(spark):
    r = np.random.default_rng(7)
    centres = np.array([[100, 100, 60000], [100, 50000, 100], [50000, 100, 100], [30000, 30000, 30000]])
    of = r.integers(0, 4, (12, 12))
    v = centres[of] + r.integers(0, 900, (12, 12, 3))
    both = pixels(spark, v).union(pixels(spark, v[::-1], image=1))
    got = fits.cluster_errors(both).collect()
    for image, true in ((0, of), (1, of[::-1])):
        pairs = {(p.cluster, int(true[p.y, p.x]), p.is_sky) for p in got if p.image_id == image}
        assert len(pairs) == 4 and all(is_sky == (true == 0) for _, true, is_sky in pairs)


def test_clusters_that_have_settled_leave(spark, monkeypatch):
    """Clusters are those of plain rounds over all images; those of four colours settle at once, one of noise goes on alone."""
    r = np.random.default_rng(8)
    four = np.array([[100, 100, 60000], [100, 50000, 100], [50000, 100, 100], [30000, 30000, 30000]])
    images = [four[r.integers(0, 4, (12, 12))] for _ in range(7)] + [r.integers(0, 60000, (12, 12, 3))]
    both = pixels(spark, images[0])
    for k in range(1, 8):
        both = both.union(pixels(spark, images[k], image=k))
    left, saved = [], fits.saved

    def noted(d, what):
        out = saved(d, what)
        if "x" in out.columns:
            left.append(out.select("image_id").distinct().count())
        return out

    monkeypatch.setattr(fits, "saved", noted)
    got = {(p.image_id, p.y, p.x): p.cluster for p in fits.cluster_errors(both, least_moves=0.0).collect()}
    assert left[0] == 8 and left[-1] == 1
    for k, v in enumerate(images):
        p = v.reshape(-1, 3).astype(float)
        apart = lambda c: ((p[:, None] - np.array(c)[None]) ** 2).sum(2)  # noqa: B023, E731
        c = [p[apart([p.mean(0)])[:, 0].argmax()]]
        while len(c) < 4:
            c.append(p[apart(c).min(1).argmax()])
        for _ in range(100):
            of = apart(c).argmin(1)
            new = [p[of == n].mean(0) for n in range(4)]
            if np.array_equal(new, c):
                break
            c = new
        want = of.reshape(12, 12)
        assert all(got[k, y, x] == want[y, x] for y in range(12) for x in range(12)), k


def test_chain_of_detectors(spark):
    ends = np.full(22, 34)
    ends[9] = 20
    px, col = pixels(spark, sky(ends)), column_table(spark, 22, sos=2, raw_sos=2, eos=59)
    found = columns.find_end_of_sky(fits.end_of_sky_regression(px, col, 60), col, 22, 60).orderBy("x").collect()
    e = [p.eos for p in found]
    assert all(abs(b - a) <= 2 for a, b in zip(e, e[1:])) and abs(np.median(e) - 34) <= 2 and len({p.lowest_py for p in found}) == 1
    scanned = columns.end_of_sky_scan(px, col).filter(F.abs(F.col("eos") - 36) <= 4).count()
    assert scanned >= 15


def test_levelled_starts(spark):
    r = np.random.default_rng(8)
    s, mask = r.integers(0, 20, 30), np.zeros(30, int)
    mask[14] = 1
    want, more = s.copy(), True
    while more:
        more = False
        for x in range(30 - 4):
            if mask[x : x + 4].any():
                continue
            if want[x] > want[x + 3] + 1:
                want[x], more = want[x] - 1, True
            if want[x] + 1 < want[x + 3]:
                want[x + 3], more = want[x + 3] - 1, True
    got = repairs.level_start(column_table(spark, 30, sos=s, column_mask=mask), 30).orderBy("x").collect()
    assert [p.level_sos for p in got] == want.tolist()

"""The whole job on planted skies, its stages and their restart."""

import numpy as np
import pytest

from rastermill.operators import columns, fill, whole_fill
from rastermill.sources.store import PixelVersions, Stages
from test_rules import column_table, pixels

IMAGES = "image_id int, width int, height int, fov double"


def planted(h, w, top=8, ground=45, seed=1):
    y, x = np.mgrid[0:h, 0:w]
    v = np.stack([9000 + 300 * y + 20 * x, 22000 + 250 * y + 15 * x, 46000 + 150 * y + 10 * x], axis=-1)
    truth = v.copy()
    v[ground:] = np.random.default_rng(seed).integers(2000, 20000, (h - ground, w, 3))
    a = np.full((h, w), 65535)
    v[:top, :], a[:top, :] = 0, 0
    return v, a, truth


def by_place(pdf, image):
    return pdf[pdf.image_id == image].set_index(["y", "x"]).sort_index()


def test_run_fill_of_images_of_two_sizes(spark):
    v, a, truth = planted(60, 40)
    v2, a2, truth2 = planted(64, 36, ground=48, seed=2)
    images = spark.createDataFrame([(0, 40, 60, 90.0), (1, 40, 60, 90.0), (2, 36, 64, 90.0)], IMAGES)
    masks = spark.createDataFrame([(0, "column", 10, 12)], "image_id int, kind string, l int, r int")
    black = pixels(spark, np.zeros((60, 40, 3), int), image=1)
    px = pixels(spark, v, a).union(black).union(pixels(spark, v2, a2, image=2))
    got = whole_fill.run_fill(px, images, masks, whole_fill.FillOptions(samples=400, seed=5)).toPandas()
    assert len(got) == 2 * 60 * 40 + 64 * 36 and not got.duplicated(["image_id", "x", "y"]).any()
    for image, true, masked, ground in ((0, truth, [10, 11, 12], 52), (2, truth2, [], 56)):
        one = by_place(got, image)
        top = one.loc[0:6]
        outside = ~top.index.get_level_values("x").isin(masked)
        assert (top.a[outside] == 65535).all()
        want = np.array([true[i][2] for i in top.index])
        assert (np.abs(top.b.to_numpy() - want)[outside] < 6000).all()
        low = one.loc[ground:]
        before = v if image == 0 else v2
        assert all((low[c].to_numpy() == np.array([before[i][k] for i in low.index])).all() for k, c in enumerate("rgb"))
    assert (got[got.image_id == 1][["r", "g", "b"]] < 600).all().all()


def test_run_fill_with_all_stages_and_restart(spark, tmp_path):
    v, a, truth = planted(60, 80)
    a[:14, 30], v[:14, 30] = 0, 0  # a late start
    a[16:20, 50], v[16:20, 50] = 0, 0  # a gap inside a column
    images = spark.createDataFrame([(0, 80, 60, 90.0, 0.1, 0.8, 3.0, 0.3, 0.3, 1.0, 0.5, 0.2)], IMAGES + ", " + ", ".join(f"{c} double" for c in "sun_px sun_py cc cd sun_lum sat_depth cf cg".split()))
    masks = spark.createDataFrame([], "image_id int, kind string, l int, r int")
    options = whole_fill.FillOptions(samples=400, light="sun", zenith=(0.5, 0.5), fill_top=True, uniform=2, transparent=True, smooth_rows=True, box=True, seed=1)
    run = lambda: whole_fill.run_fill(pixels(spark, v, a), images, masks, options, str(tmp_path / "job"))
    first = sorted(map(tuple, run().collect()))
    names = sorted(p.name[3:] for p in (tmp_path / "job" / "80x60").iterdir() if p.is_dir())
    for stage in "alpha overhangs black-edges samples models vertical-gaps side-edges outliers levelled-starts top even-rows filled halo smooth-rows box dither".split():
        assert stage in names, stage
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "job" / "80x60").glob("*/_SUCCESS")}
    last = max(stamps, key=lambda p: p.parent.name)
    last.unlink()  # a stage that broke off
    assert sorted(map(tuple, run().collect())) == first
    assert all(p.stat().st_mtime_ns == t for p, t in stamps.items() if p != last) and last.exists()
    one = {(r[1], r[2]): r for r in first}
    assert all(one[x, y][6] == 65535 for x in range(80) for y in range(0, 30))
    assert abs(one[50, 18][5] - truth[18, 50, 2]) < 6000


def test_halo_only_where_the_fill_reaches_the_end(spark):
    col = column_table(spark, 4, sos=[0, 0, 10, 12], eos=[20, 21, 11, 12])
    assert [r.x for r in fill.filled_to_end(col).orderBy("x").collect()] == [2, 3]
    v = np.full((30, 4, 3), 30000)
    v[22], v[13], v[12] = 40000, 40000, 35000
    got = columns.trim_halo(pixels(spark, v), fill.filled_to_end(col)).filter("trimmed").select("x", "y").collect()
    assert {x for x, _ in got} <= {2, 3} and got


def test_versions_of_pixels(spark, tmp_path):
    px = pixels(spark, np.zeros((2, 2, 3), int))
    v = PixelVersions(px, Stages(spark, str(tmp_path)))
    some = lambda where, r: lambda d: d.filter(where).selectExpr("image_id", "x", "y", f"{r} AS r", "g", "b", "7 AS a")
    v.change("one", some("x = 0", 1))
    v.change("two", some("r = 1 AND y = 0", 2))
    assert sorted((r.x, r.y, r.r, r.a) for r in v.now().collect()) == [(0, 0, 2, 7), (0, 1, 1, 7), (1, 0, 0, 65535), (1, 1, 0, 65535)]
    v.rewrite("all", lambda d: d.selectExpr("image_id", "x", "y", "r + 10 AS r", "g", "b", "a"))
    v.change("three", lambda d: d.filter("r = 12").selectExpr("image_id", "x", "y", "5 AS r", "g", "b"))
    assert sorted(r.r for r in v.now().collect()) == [5, 10, 10, 11] and [r.a for r in v.now().filter("r = 5").collect()] == [65535]


def box_by_loops(v, a, raw, sos, eos, mask, passes=2):
    h, w = v.shape[:2]
    v = v.astype(int).copy()
    for _ in range(passes):
        old, new = v.copy(), v.copy()
        for x in range(w):
            n = min(raw[x] + eos[x] - sos[x], eos[x]) - raw[x]
            last = min(max(sos[x] + n, raw[x]), h - 1)
            if mask[x]:
                continue
            for y in range(last):
                near = [old[j, k] for k in range(max(0, x - 4), min(w, x + 5)) if not mask[k] for j in range(max(0, y - 6), min(y + 6, last, h - 1) + 1)]
                mean = np.floor(np.mean(near, axis=0) + 0.5)
                p = 1.0 if y <= raw[x] else 0.0 if y > raw[x] + n else 1.0 if old[y, x, 2] < 0.04 * 65535 else 1 - (y - raw[x]) / n
                new[y, x] = np.floor(p * mean + (1 - p) * old[y, x] + 0.5)
        v = new
    return v


@pytest.mark.parametrize("passes", [1, 2])
def test_box_filter(spark, passes):
    r = np.random.default_rng(3)
    h, w = 24, 15
    v = r.integers(0, 65536, (h, w, 3))
    raw, mask = r.integers(0, 5, w), (r.random(w) < 0.2).astype(int)
    sos, eos = raw + r.integers(0, 4, w), r.integers(10, 24, w)
    want = box_by_loops(v, None, raw, sos, eos, mask, passes)
    got = columns.box_filter(pixels(spark, v), column_table(spark, w, raw_sos=raw, sos=sos, eos=eos, column_mask=mask), passes=passes).collect()
    assert len(got) == h * w and max(np.abs(np.array([p.r, p.g, p.b]) - want[p.y, p.x]).max() for p in got) <= 1

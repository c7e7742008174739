"""Registered raster queries: name -> (function of spark and folder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, geometry, model
from ..operators import columns, fill, fits, local_fit, masks, overlays, repairs, sampling, sky_model, whole_fill
from ..sources import rasters
from ..sources.store import saved
from . import sql as S

W, H = S.WIDTH, S.HEIGHT


class Scene:
    """The tables a query starts from, all derived from events."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.px = rasters.pixel_view(spark, sf_dir)
        self.col = rasters.column_view(self.px)
        self.images = self.px.select("image_id").distinct()
        self.sized = self.images.withColumns({"width": F.lit(W), "height": F.lit(H)})
        of = lambda rows, names: rasters.literal(spark, self.images, rows, names)
        self.masks, self.rects, self.vertices = of(S.MASK_ROWS, "kind, l, r"), of(S.RECT_ROWS, "l, r, t, b"), of(S.VERTEX_ROWS, "ord, x, y")
        array = lambda v: F.array(*[F.lit(float(x)) for x in v])
        knots = F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: 0.8 + 0.002 * k)
        self.models = self.images.select(
            "image_id", F.array(*map(array, S.H)).alias("h_coefs"), F.array(*map(array, S.S)).alias("s_coefs"), array(S.V).alias("v_coefs"), knots.alias("knots"),
            F.lit(S.HORIZON).alias("horizon_py"), F.lit(S.CURVATURE).alias("curvature"), F.lit(S.SLOPE).alias("slope"), F.lit(S.FOV).alias("fov"),
        )
        self.rel = geometry.with_relative_xy(self.px, self.sized)
        self.hsv = self.px.withColumn("hsv", color.rgb_to_hsv("r", "g", "b")).select("*", "hsv.*").drop("hsv")

    @property
    def predicted(self) -> DataFrame:
        return fill.predict_sky(self.px, self.models, W, H)

    def samples(self) -> DataFrame:
        """Opaque pixels of every second column and row of the sky, as samples."""
        d = masks.sky_band(self.rel.filter("a >= 32767 AND x % 2 = 0 AND y % 2 = 0"), self.col)
        return sampling.with_hsv(d)


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(Scene(spark, sf_dir)), sql)
        return f

    return add


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


BASE, MODEL, YW, XW, RW = S.BASE, S.MODEL, S.YW, S.XW, S.RW
SAMPLES = f"{BASE}, {S.REL}, smp AS ({S.hsv('(SELECT rel.* FROM rel JOIN col USING (image_id, x) WHERE a >= 32767 AND x%2=0 AND y%2=0 AND y BETWEEN sos AND eos)')})"


@query(f"{BASE} SELECT * FROM px")
def read_pixels(s):
    return s.px


@query(None)
def scanline_round_trip(s):
    return rasters.unpack_scanlines(rasters.pack_scanlines(s.px))


@query(f"{BASE}, {S.REL} SELECT image_id, x, y, round(px, 6) AS px, round(py, 6) AS py, CAST(floor((px+0.5)*39+0.5) AS INT) AS x2, CAST(floor((1-py)*24+0.5) AS INT) AS y2 FROM rel")
def relative_xy(s):
    x2, y2 = geometry.to_pixel_xy(F.col("px"), F.col("py"), F.lit(W), F.lit(H))
    return rounded(s.rel.select("image_id", "x", "y", "px", "py", x2.alias("x2"), y2.alias("y2")), 6, "px", "py")


@query(f"{BASE} SELECT image_id, count(*) FILTER (WHERE a>=32767) AS opaque, count(*) FILTER (WHERE a<16384) AS transparent, count(*) FILTER (WHERE greatest(r,g,b)<=3840) AS black, count(*) FILTER (WHERE greatest(r,g,b)>3840) AS nonblack FROM px GROUP BY 1")
def pixel_predicates(s):
    return s.px.groupBy("image_id").agg(F.count_if(color.is_opaque()).alias("opaque"), F.count_if(color.is_transparent()).alias("transparent"), F.count_if(color.is_black()).alias("black"), F.count_if(color.is_nonblack()).alias("nonblack"))


@query(f"{BASE}, h AS ({S.hsv('px')}) SELECT image_id, x, y, round(h, 4) AS h, round(s, 6) AS s, round(v, 6) AS v FROM h")
def rgb_to_hsv(s):
    return rounded(s.hsv.select("image_id", "x", "y", "h", "s", "v"), 6, "s", "v").withColumn("h", F.round("h", 4))


@query(f"{BASE}, h AS ({S.hsv('px')}) SELECT image_id, x, y, " + " AND ".join(f"abs({e}-{c})<=3" for c, e in S.rgb("h", "s", "v").items()) + " AS close FROM h")
def hsv_round_trip(s):
    """Channels are truncated, so each comes back a little less."""
    d = s.hsv.withColumn("back", color.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v")))
    return d.select("image_id", "x", "y", (F.greatest(*[F.abs(F.col(f"back.{c}") - F.col(c)) for c in "rgb"]) <= 3).alias("close"))


@query(f"{BASE}, h AS ({S.hsv('px')}) SELECT image_id, count(*) FILTER (WHERE a >= 32767 AND (abs(h-205)/205.0 > 0.05 OR abs(s-0.5)/0.5 > 0.2 OR abs(v-0.8)/0.8 > 0.2)) AS off FROM h GROUP BY 1")
def off_sky_color(s):
    d = s.px.withColumn("hsv", color.rgb_to_hsv("r", "g", "b"))
    return d.groupBy("image_id").agg(F.count_if(color.is_off_sky_color(F.col("hsv"), F.lit(205.0), F.lit(0.5), F.lit(0.8))).alias("off"))


@query(f"{BASE} SELECT image_id, x, y, round(0.299*r+0.587*g+0.114*b, 5) AS luma601, round(0.21126*r+0.7152*g+0.0722*b, 5) AS luma709 FROM px")
def luma(s):
    return s.px.select("image_id", "x", "y", F.round(color.luma601(), 5).alias("luma601"), F.round(color.luma709(), 5).alias("luma709"))


@query(f"{BASE} SELECT image_id, x, y, CAST(least(floor(r*1.25+0.5),65535) AS INT) AS r, CAST(least(floor(g*1.25+0.5),65535) AS INT) AS g, CAST(least(floor(b*1.25+0.5),65535) AS INT) AS b, a FROM px")
def apply_exposure(s):
    return color.apply_exposure(s.px, 1.25)


@query(f"{BASE} SELECT image_id, CAST(x/2 AS INT) AS x, CAST(y/2 AS INT) AS y, r, g, b, a FROM px WHERE x%2=0 AND y%2=0 AND y<24")
def half_scale(s):
    return s.px.filter(f"x % 2 = 0 AND y % 2 = 0 AND x < {W // 2 * 2} AND y < {H // 2 * 2}").selectExpr("image_id", "x div 2 AS x", "y div 2 AS y", "r", "g", "b", "a").withColumns({c: F.col(c).cast("int") for c in "xy"})


@query(f"{BASE} SELECT px.* FROM px WHERE NOT EXISTS (SELECT 1 FROM rects q WHERE q.image_id=px.image_id AND px.x BETWEEN q.l AND q.r AND px.y BETWEEN q.t AND q.b)")
def drop_masked(s):
    return masks.drop_masked(s.px, s.rects)


@query(f"{BASE} SELECT image_id, x, y, CASE WHEN x BETWEEN 5 AND 7 THEN 25 ELSE coalesce((SELECT max(b) FROM rects q WHERE q.image_id=px.image_id AND px.x BETWEEN q.l AND q.r AND px.y BETWEEN q.t AND q.b), y) END AS skip_y FROM px")
def skip_mask_y(s):
    return masks.skip_mask_y(s.px, s.rects, s.masks, H).select("image_id", "x", "y", "skip_y")


@query(f"{BASE} SELECT px.* FROM px JOIN col USING (image_id, x) WHERE y BETWEEN sos AND eos")
def sky_band(s):
    return masks.sky_band(s.px, s.col).select(s.px.columns)


@query(f"{BASE} SELECT image_id, x, y, 4 | CASE WHEN y BETWEEN raw_sos AND eos THEN 1 ELSE 0 END AS pixel_class FROM px JOIN col USING (image_id, x)")
def tag_sky(s):
    return masks.tag_sky(s.px.select("image_id", "x", "y").withColumn("pixel_class", F.lit(4)), s.col).select("image_id", "x", "y", "pixel_class")


@query(f"{BASE} SELECT image_id, count(*) FILTER (WHERE greatest(r,g,b)>=65535) AS clipped FROM px GROUP BY 1")
def clip_counts(s):
    return fill.clip_counts(s.px)


@query(f"{BASE} SELECT image_id, x, " + ", ".join(f"CAST(coalesce((SELECT max(1) FROM masks m WHERE m.image_id=col.image_id AND m.kind='{k}' AND col.x BETWEEN m.l AND m.r),0) AS INT) AS {k}_mask" for k in masks.KINDS) + " FROM col")
def expand_column_masks(s):
    return masks.expand_column_masks(s.col.select("image_id", "x"), s.masks)


@query(f"{BASE}, seg AS (SELECT * FROM (VALUES (0,0,12,9,15),(3,20,16,39,13)) t(ord,x0,y0,x1,y1)), p AS (SELECT image_id, ord, x0, y0, x1, y1, unnest(generate_series(x0, x1)) AS x FROM img, seg) SELECT image_id, CAST(x AS INT) AS x, CAST(floor(y0+(x-x0)*((y1-y0)/(x1-x0)::DOUBLE)+0.5) AS INT) AS manual_eos FROM p")
def densify_manual_horizon(s):
    return masks.densify_manual_horizon(s.vertices)


@query(f"{BASE} SELECT image_id, x, coalesce(manual_eos, eos) AS effective_eos FROM col")
def effective_end(s):
    return masks.effective_end(s.col).select("image_id", "x", "effective_eos")


@query(f"{BASE} SELECT c.image_id, c.x, CAST(CASE WHEN c.column_mask=0 THEN c.eos ELSE l.eos+(c.x-4)/4.0*(r.eos-l.eos) END AS DOUBLE) AS nearest_eos FROM col c JOIN col l ON l.image_id=c.image_id AND l.x=4 JOIN col r ON r.image_id=c.image_id AND r.x=8")
def nearest_unmasked_end(s):
    return masks.nearest_unmasked_end(s.col).select("image_id", "x", "nearest_eos")


@query(f"{BASE} SELECT image_id, x, coalesce(min(y) FILTER (WHERE greatest(r,g,b)>3840), 0) AS raw_sos, CASE WHEN x BETWEEN 5 AND 7 THEN 0 ELSE 24 END AS eos FROM px GROUP BY image_id, x")
def start_of_sky(s):
    return columns.start_of_sky(s.px, s.masks, H)


@query(f"{BASE} SELECT image_id, min(sos) AS min_sos, max(sos) AS max_sos, min(eos) AS min_eos, max(eos) AS max_eos, round(1-max(eos)/24.0::DOUBLE, 6) AS lowest_py FROM col GROUP BY 1")
def sky_extent(s):
    return rounded(columns.sky_extent(s.col, H), 6, "lowest_py")


@query(f"{BASE} SELECT image_id, x, CAST(CASE WHEN least(x,39-x)<9 THEN raw_sos+floor(4*least(x,39-x)/9.0::DOUBLE+0.5) ELSE max(raw_sos) OVER ({XW} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)+4 END AS INT) AS sos FROM col")
def dilate_start(s):
    return columns.dilate_start(s.col, W).select("image_id", "x", "sos")


@query(f"{BASE} SELECT image_id, x, max(raw_sos) FILTER (WHERE column_mask=0) OVER ({XW} ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)+10 AS scan_y FROM col")
def local_scan_start(s):
    return columns.local_scan_start(s.col).select("image_id", "x", "scan_y")


_BANDS = f"""{BASE}, h AS ({S.hsv('px')}), l AS (SELECT *, (0.299*r+0.587*g+0.114*b)/65535::DOUBLE AS luma FROM h),
bands AS (SELECT image_id, x, y, abs(avg(h) OVER a - avg(h) OVER b)*(avg(s) OVER a) AS dh, abs(avg(s) OVER a - avg(s) OVER b) AS ds, abs(avg(luma) OVER a - avg(luma) OVER b) AS dv
FROM l WINDOW a AS ({YW} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS ({YW} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))"""


@query(f"{_BANDS} SELECT image_id, x, y, round(dh, 3) AS dh, round(ds, 5) AS ds, round(dv, 5) AS dv FROM bands")
def column_band_stats(s):
    return rounded(columns.column_band_stats(s.px), 5, "ds", "dv").withColumn("dh", F.round("dh", 3))


@query(f"{_BANDS} SELECT image_id, x, min(y) FILTER (WHERE y>=6 AND (round(dh, 6)>360 OR round(ds, 6)>0.3 OR round(dv, 6)>0.015)) AS end_y FROM bands GROUP BY 1, 2")
def first_band_failure(s):
    return columns.first_band_failure(rounded(columns.column_band_stats(s.px), 6, "dh", "ds", "dv"))


@query(f"""{BASE}, w AS (SELECT image_id, x, y, {'+'.join(f'abs(avg({c}) OVER a - avg({c}) OVER b)' for c in 'rgb')} AS step FROM px WINDOW a AS ({YW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS ({YW} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
SELECT image_id, x, coalesce(min(y) FILTER (WHERE step>4000), min(eos))+2 AS hires_eos FROM w JOIN col USING (image_id, x) WHERE y BETWEEN eos-10 AND eos+9 GROUP BY 1, 2""")
def hires_end(s):
    return columns.hires_end(s.px, s.col)


@query(f"""{BASE}, w AS (SELECT image_id, x, y, round({'+'.join(f'abs(avg({c}) OVER a - avg({c}) OVER b)' for c in 'rgb')}+1/({'+'.join(f'coalesce(var_pop({c}) OVER a,0)*count({c}) OVER a' for c in 'rgb')}+1), 3) AS metric
FROM px WINDOW a AS ({YW} ROWS BETWEEN 21 PRECEDING AND 2 PRECEDING), b AS ({YW} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
k AS (SELECT image_id, x, y, row_number() OVER (PARTITION BY image_id, x ORDER BY metric DESC, y) AS k FROM w JOIN col USING (image_id, x) WHERE abs(y-eos)<=20 AND metric IS NOT NULL)
SELECT image_id, x, y AS contrast_eos FROM k WHERE k=1""")
def contrast_end(s):
    return columns.contrast_end(s.px, s.col)


_DIPS = "eos - CASE WHEN x % 11 = 5 OR x IN (12, 13, 30, 31, 32) THEN 14 ELSE 0 END"


@query(f"""{BASE}, c AS (SELECT image_id, x, column_mask AS m, {_DIPS} AS e FROM col),
n AS (SELECT *, lag(e) OVER w AS e0, lag(m) OVER w AS m0, {', '.join(f'lead(e,{k}) OVER w AS e{k}, lead(m,{k}) OVER w AS m{k}' for k in (1, 2, 3))} FROM c WINDOW w AS ({XW})),
k AS (SELECT *, CASE WHEN x<37 AND m=0 AND m0=0 AND e0-e>10 THEN CASE WHEN e1-e>10 THEN CASE WHEN m1=0 THEN 1 END WHEN e2-e>10 THEN CASE WHEN m2=0 THEN 2 END WHEN e3-e>10 THEN CASE WHEN m3=0 THEN 3 END END END AS n FROM n),
v AS (SELECT *, floor((e0+CASE n WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END)/2.0) AS v FROM k)
SELECT image_id, x, CAST(CASE WHEN n IS NOT NULL THEN v WHEN lag(n) OVER w>=2 THEN lag(v) OVER w WHEN lag(n,2) OVER w=3 THEN lag(v,2) OVER w ELSE e END AS INT) AS fixed_eos FROM v WINDOW w AS ({XW})""")
def fix_slivers(s):
    return columns.fix_slivers(s.col.withColumn("eos", F.expr(f"cast({_DIPS} AS int)")), W).select("image_id", "x", "fixed_eos")


@query(f"{BASE}, run AS (SELECT *, sum(column_mask) OVER ({XW}) AS k FROM col) SELECT a.image_id, a.x, CAST(CASE WHEN a.column_mask=1 THEN a.eos ELSE greatest(min(b.eos+2*abs(a.x-b.x)), a.sos) END AS INT) AS clamped_eos FROM run a JOIN run b ON a.image_id=b.image_id AND a.k=b.k AND a.column_mask=b.column_mask GROUP BY a.image_id, a.x, a.column_mask, a.eos, a.sos")
def clamp_slope(s):
    return columns.clamp_slope(s.col).select("image_id", "x", F.col("clamped_eos").cast("int").alias("clamped_eos"))


_T_OFF = {c: f"abs(avg({c}) OVER a-{c})" for c in "rgb"}
_T = {c: f"CASE WHEN coalesce(stddev_samp({c}) OVER a,0)>0 THEN {_T_OFF[c]}/(stddev_samp({c}) OVER a/sqrt(count({c}) OVER a)) WHEN {_T_OFF[c]}>0 THEN 'inf'::DOUBLE ELSE 0 END" for c in "rgb"}


@query(f"""{BASE}, w AS (SELECT image_id, x, y, raw_sos, greatest({', '.join(_T.values())}) AS t, sqrt({'+'.join(f'pow({v},2)' for v in _T_OFF.values())}) AS dist
FROM px JOIN col USING (image_id, x) WINDOW a AS ({YW} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) SELECT image_id, x, y, round(1-least(1,0.1*ln(1+CASE WHEN dist<0.02 THEN dist ELSE t END)), 4) AS p FROM w WHERE y>=raw_sos+10 AND y<15""")
def t_profile(s):
    return columns.t_profile(s.px, s.col, H).withColumn("p", F.round("p", 4))


def _ar_sql() -> str:
    """SQL of the forecasts and ends with a window of 4 rows."""
    near = f"({RW} RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    span, back = f"({YW} RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING)", f"({YW} RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    means = ", ".join(f"sum({c}1) OVER {span}/sum(n1) OVER {span} AS {c}s" for c in "rgb")
    lags = ", ".join(f"CASE WHEN use THEN lag({c}s, 6) OVER ({YW}) END AS {c}u, CASE WHEN use THEN lag({c}s, 4) OVER ({YW}) END AS {c}v, CASE WHEN use THEN {c}s END AS {c}w" for c in "rgb")
    sums = ", ".join(f"sum({c}{i}*{c}{j}) OVER {back} AS {c}{i}{j}" for c in "rgb" for i, j in ("uu", "uv", "vv", "uw", "vw", "ww"))
    det = {c: f"nullif({c}uu*{c}vv-{c}uv*{c}uv,0)" for c in "rgb"}
    b0, b1 = {c: f"({c}vv*{c}uw-{c}uv*{c}vw)/{det[c]}" for c in "rgb"}, {c: f"({c}uu*{c}vw-{c}uv*{c}uw)/{det[c]}" for c in "rgb"}
    err2 = "+".join(f"pow({b0[c]}*{c}u+{b1[c]}*{c}v-{c}w,2)/3" for c in "rgb")
    mse = "+".join(f"({c}ww-{b0[c]}*{c}uw-{b1[c]}*{c}vw)/n/3" for c in "rgb")
    return f"""{BASE}, a AS (SELECT px.*, raw_sos, {', '.join(f'sum({c}/65535.0::DOUBLE) OVER {near} AS {c}1' for c in 'rgb')}, count(*) OVER {near} AS n1 FROM px JOIN col USING (image_id, x)),
m AS (SELECT image_id, x, y, raw_sos, {means} FROM a), u AS (SELECT *, y>=raw_sos+8 AS use FROM m WHERE y>=raw_sos+2 AND y<20),
l AS (SELECT image_id, x, y, use, {lags} FROM u), s AS (SELECT *, count(*) FILTER (WHERE use) OVER {back} AS n, {sums} FROM l),
f AS (SELECT image_id, x, y, n, {err2} AS err2, ({mse})*CASE WHEN n<4 THEN pow(4.0/nullif(n,0),10) ELSE 1 END AS mse FROM s WHERE use),
k AS (SELECT image_id, x, min(y) FILTER (WHERE n>2 AND err2>3*mse AND err2>0.0001) AS found FROM f GROUP BY 1, 2)
SELECT image_id, x, found, CAST(greatest(coalesce(found, eos)-4, raw_sos+20) AS INT) AS eos FROM col LEFT JOIN k USING (image_id, x)"""


@query(_ar_sql())
def ar_end(s):
    return columns.ar_end(s.px, s.col, H, window=4, alpha=0.01, beta=3.0)


@query(f"{BASE}, q AS (SELECT *, 0.2*r+0.2*g+0.6*b AS e FROM px) SELECT image_id, x, y, round(lag(e,2) OVER w+lag(e) OVER w-lead(e) OVER w-lead(e,2) OVER w+0.5, 2) AS emboss FROM q WINDOW w AS ({YW})")
def emboss_rows(s):
    return columns.emboss_rows(s.px).select("image_id", "x", "y", F.round("emboss", 2).alias("emboss"))


@query(f"""{BASE}, n AS (SELECT image_id, x, y, {', '.join(f'lag({c}) OVER w+2*{c}+lead({c}) OVER w AS {c}s, lead({c}) OVER w-lag({c}) OVER w AS {c}d' for c in 'rgb')} FROM px WINDOW w AS ({RW}))
SELECT image_id, x, y, round({'+'.join(f'sqrt(pow(lead({c}s) OVER w-lag({c}s) OVER w,2)+pow(lag({c}d) OVER w+2*{c}d+lead({c}d) OVER w,2))' for c in 'rgb')}, 2) AS sobel FROM n WINDOW w AS ({YW})""")
def sobel_strength(s):
    return columns.sobel_strength(s.px).select("image_id", "x", "y", F.round("sobel", 2).alias("sobel"))


@query(f"""{BASE}, d AS (SELECT px.*, column_mask, (SELECT min(eos) FROM col k WHERE k.image_id=px.image_id AND k.column_mask=0) AS low FROM px JOIN col USING (image_id, x))
SELECT image_id, x, y, {', '.join(f'round(avg({c}) FILTER (WHERE column_mask=0) OVER w, 3) AS {c}_smooth' for c in 'rgb')} FROM d WHERE y<low WINDOW w AS ({RW} RANGE BETWEEN 50 PRECEDING AND 49 FOLLOWING)""")
def horizontal_smooth(s):
    d = columns.horizontal_smooth(s.px, s.col).select("image_id", "x", "y", "r_smooth", "g_smooth", "b_smooth")
    return rounded(d, 3, "r_smooth", "g_smooth", "b_smooth")


@query(f"""{BASE}, d AS (SELECT px.*, sos, eos, column_mask FROM px JOIN col USING (image_id, x)),
n AS (SELECT p.image_id, p.x, p.y, {', '.join(f'CAST(floor(avg(q.{c})+0.5) AS INT) AS {c}' for c in 'rgb')} FROM d p JOIN d q ON p.image_id=q.image_id AND q.x BETWEEN p.x-3 AND p.x+3 AND q.y BETWEEN p.y-3 AND p.y+3
  WHERE p.column_mask=0 AND p.y<=p.eos AND p.y>=p.sos-3 AND p.y<p.sos+3 AND q.column_mask=0 AND q.y<=q.eos GROUP BY 1, 2, 3)
SELECT px.image_id, px.x, px.y, {', '.join(f'coalesce(n.{c}, px.{c}) AS {c}' for c in 'rgb')}, px.a FROM px LEFT JOIN n ON n.image_id=px.image_id AND n.x=px.x AND n.y=px.y""")
def seam_smooth(s):
    return columns.seam_smooth(s.px, s.col)


@query(f"{BASE} SELECT p.image_id, p.x, p.y, {', '.join(f'round(avg(q.{c}), 3) AS {c}_box' for c in 'rgb')} FROM px p JOIN px q ON p.image_id=q.image_id AND q.x BETWEEN p.x-4 AND p.x+4 AND q.y BETWEEN p.y-6 AND p.y+6 GROUP BY 1, 2, 3")
def box_smooth(s):
    d = columns.box_smooth(s.px).select("image_id", "x", "y", "r_box", "g_box", "b_box")
    return rounded(d, 3, "r_box", "g_box", "b_box")


def _box_pass(d: str, out: str) -> str:
    """SQL of one pass of the box filter, from table d to table out."""
    w = "CASE WHEN p.y<=p.raw_sos THEN 1.0 WHEN p.y>p.raw_sos+p.n THEN 0.0 WHEN p.b<0.04*65535 THEN 1.0 ELSE coalesce(greatest(0,least(1,1-(p.y-p.raw_sos)/nullif(p.n,0)::DOUBLE)),0) END"
    mean = ", ".join(f"floor(avg(q.{c})+0.5) AS {c}1" for c in "rgb")
    boxes = f"""SELECT p.image_id, p.x, p.y, {mean} FROM {d} p JOIN {d} q ON p.image_id=q.image_id AND q.x BETWEEN p.x-4 AND p.x+4 AND q.y BETWEEN p.y-6 AND p.y+6 AND q.y<=p.last AND q.column_mask=0
  WHERE p.column_mask=0 AND p.y<p.last GROUP BY 1, 2, 3"""
    new = ", ".join(f"CASE WHEN r1 IS NULL THEN p.{c} ELSE CAST(floor({w}*{c}1+(1-{w})*p.{c}+0.5) AS INT) END AS {c}" for c in "rgb")
    return f"{out}b AS ({boxes}), {out} AS (SELECT p.image_id, p.x, p.y, {new}, p.a, p.raw_sos, p.n, p.last, p.column_mask FROM {d} p LEFT JOIN {out}b USING (image_id, x, y))"


@query(f"""{BASE}, f AS (SELECT px.*, raw_sos, column_mask, CAST(least(raw_sos+eos-sos,eos)-raw_sos AS INT) AS n, least(greatest(sos+least(raw_sos+eos-sos,eos)-raw_sos,raw_sos),24) AS last FROM px JOIN (SELECT * REPLACE (sos+x%3 AS sos) FROM col) USING (image_id, x)),
{_box_pass('f', 'g')}, {_box_pass('g', 'h')} SELECT image_id, x, y, r, g, b, a FROM h""")
def box_filter(s):
    """Two passes, with starts of sky below the raw ones."""
    return columns.box_filter(s.px, s.col.withColumn("sos", F.col("sos") + F.col("x") % 3))


def _rows(flag: int) -> str:
    low, high = "min(sos)" if flag == 2 else "0", "max(sos)" if flag == 1 else "max(eos)"
    return f"""{BASE}, ext AS (SELECT image_id, {low} AS y0, {high} AS y1 FROM col GROUP BY 1), d AS (SELECT px.*, sos, eos, y0, y1 FROM px JOIN col USING (image_id, x) JOIN ext USING (image_id)),
m AS (SELECT image_id, y, {', '.join(f'avg({c}) AS mean_{c}' for c in 'rgb')}, count(*) AS n FROM d WHERE y BETWEEN y0 AND y1 AND y<=eos{' AND y>=sos' if flag == 2 else ''} GROUP BY 1, 2)"""


def _even(flag: int) -> str:
    begin = "sos" if flag == 1 else "((eos+sos)/2.0::DOUBLE)"
    w = "CASE WHEN y<=eos THEN 1-y/nullif(y1,0)::DOUBLE END" if flag == 0 else f"CASE WHEN y<=sos THEN 1.0 WHEN 1-(y-{begin})/nullif(eos-{begin},0)::DOUBLE>0 THEN 1-(y-{begin})/nullif(eos-{begin},0)::DOUBLE END"
    mixed = ", ".join(f"CAST(CASE WHEN w IS NULL THEN {c} ELSE greatest(0,least(65535,floor(w*mean_{c}+(1-w)*{c}))) END AS INT) AS {c}" for c in "rgb")
    return f"{_rows(flag)}, e AS (SELECT d.*, mean_r, mean_g, mean_b, CASE WHEN y BETWEEN y0 AND y1 AND mean_r IS NOT NULL THEN {w} END AS w FROM d LEFT JOIN m USING (image_id, y)) SELECT image_id, x, y, {mixed}, CASE WHEN w IS NULL THEN a ELSE 65535 END AS a FROM e"


def _register_rows() -> None:
    """row_means and even_out_rows for each of the three ranges of rows."""
    means = f" SELECT image_id, y, {', '.join(f'round(mean_{c}, 4) AS mean_{c}' for c in 'rgb')}, n FROM m"
    for flag, name in ((0, ""), (1, "_to_start"), (2, "_from_start")):
        QUERIES[f"row_means{name}"] = (lambda spark, sf, flag=flag: rounded(columns.row_means((s := Scene(spark, sf)).px, s.col, flag), 4, "mean_r", "mean_g", "mean_b"), _rows(flag) + means)
        QUERIES[f"even_out_rows{name}"] = (lambda spark, sf, flag=flag: columns.even_out_rows((s := Scene(spark, sf)).px, s.col, flag), _even(flag))


_register_rows()


@query(f"{MODEL}, {S.PROB} SELECT image_id, x, greatest(max(eos), max(y) FILTER (WHERE abs(y-eos)<=5 AND (y BETWEEN raw_sos AND eos+x%3 OR p_hat>0.75))) AS extended_eos FROM prob GROUP BY 1, 2")
def extend_end_by_class(s):
    d = fill.sky_probability(s.predicted, s.col).join(s.col.select("image_id", "x", "raw_sos", "eos"), ["image_id", "x"])
    d = d.select("image_id", "x", "y", "p_hat", F.expr("CASE WHEN y BETWEEN raw_sos AND eos + x % 3 THEN 1 ELSE 0 END").alias("pixel_class"))
    return columns.extend_end_by_class(d, s.col)


@query(f"""{BASE}, l AS (SELECT *, 0.21126*r+0.7152*g+0.0722*b AS l FROM px), n AS (SELECT *, lag(l) OVER w AS l0, lead(l) OVER w AS l2 FROM l WINDOW w AS ({YW})),
t AS (SELECT n.*, raw_sos, eos, coalesce(y BETWEEN eos-1 AND eos+2 AND l>l0 AND l>l2, false) AS p FROM n JOIN col USING (image_id, x)), k AS (SELECT *, p AND NOT (a<32767 AND y>raw_sos) AS k FROM t)
SELECT image_id, x, y, {', '.join(f'CAST(CASE WHEN k THEN floor({c}*(l0/l)+0.5) ELSE {c} END AS INT) AS {c}' for c in 'rgb')}, k AS trimmed, coalesce(max(y) FILTER (WHERE p) OVER (PARTITION BY image_id, x), eos) AS final_eos FROM k""")
def trim_halo(s):
    return columns.trim_halo(s.px, s.col)


@query(f"{BASE} SELECT p.image_id, p.x, p.y, {', '.join(f'CAST(floor(a.{c}*(1-(p.x-4)/5.0::DOUBLE)+b.{c}*((p.x-4)/5.0::DOUBLE)) AS INT) AS {c}' for c in 'rgb')}, 65535 AS a FROM px p JOIN px a ON a.image_id=p.image_id AND a.y=p.y AND a.x=4 JOIN px b ON b.image_id=p.image_id AND b.y=p.y AND b.x=8 WHERE p.x BETWEEN 5 AND 7 AND p.y<10+(SELECT max(sos) FROM col k WHERE k.image_id=p.image_id AND k.x BETWEEN 4 AND 7)")
def interpolate_masked_columns(s):
    return columns.interpolate_masked_columns(s.px, s.col, s.masks)


def _side(d: str, p: str, order: str) -> str:
    """SQL of the runs of black pixels that are cleared from one side, from table d to {p}3."""
    w = f"PARTITION BY image_id, y ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    hit = f"CASE WHEN run AND coalesce(last_value(CASE WHEN NOT run THEN a<16384 END IGNORE NULLS) OVER ({w} 1 PRECEDING), false) THEN x END"
    return f"""{p}1 AS (SELECT *, black AND a>=16384 AND column_mask=0 AND y BETWEEN low AND high AS run FROM {d}), {p}2 AS (SELECT *, {hit} AS hit FROM {p}1),
{p}2b AS (SELECT *, coalesce(abs(hit-last_value(hit IGNORE NULLS) OVER ({w} 1 PRECEDING))>=10, false) AS gap FROM {p}2),
{p}3 AS (SELECT * EXCLUDE (run, hit, gap) REPLACE (CASE WHEN y BETWEEN low AND high AND hit IS NOT NULL AND NOT max(gap) OVER ({w} CURRENT ROW) THEN 0 ELSE a END AS a) FROM {p}2b)"""


_BLACK_AT = "(x*3+y)%17=0 OR (x%8=2 AND y IN (3, 4))"


@query(f"""{BASE}, p AS (SELECT image_id, x, y, CASE WHEN {_BLACK_AT} THEN 900 ELSE r END AS r, CASE WHEN {_BLACK_AT} THEN 900 ELSE g END AS g, CASE WHEN {_BLACK_AT} THEN 900 ELSE b END AS b, CASE WHEN {_BLACK_AT} THEN 65535 ELSE a END AS a FROM px),
d AS (SELECT p.*, column_mask, greatest(r,g,b)<=3840 AND a>=16384 AS black, y<20 AND y>0 AND column_mask=0 AS above, min(sos) OVER (PARTITION BY image_id) AS low, max(sos) OVER (PARTITION BY image_id) AS high FROM p JOIN col USING (image_id, x)),
q AS (SELECT *, sum(CASE WHEN above AND NOT black THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, x ORDER BY y DESC ROWS 11 PRECEDING) AS passed FROM d),
e AS (SELECT * REPLACE (CASE WHEN above AND black AND max(passed) OVER (PARTITION BY image_id, x ORDER BY y DESC ROWS UNBOUNDED PRECEDING)<12 THEN 0 ELSE a END AS a) FROM q),
{_side('e', 'l', 'x')}, {_side('l3', 'r', 'x DESC')} SELECT image_id, x, y, a FROM r3""")
def clear_black_edges(s):
    planted = s.px.withColumns({c: F.expr(f"CASE WHEN {_BLACK_AT} THEN {v} ELSE {c} END") for c, v in (("r", 900), ("g", 900), ("b", 900), ("a", 65535))})
    return columns.clear_black_edges(planted, s.col.withColumn("raw_sos", F.lit(20))).select("image_id", "x", "y", "a")


@query(f"{BASE}, z AS (SELECT image_id, x, y, r, g, b, CASE WHEN a<65535 THEN 0 ELSE a END AS a FROM px) SELECT p.image_id, p.x, p.y, CASE WHEN min(q.a)=0 AND least(p.r,p.g,p.b)*8<greatest(p.r,p.g,p.b) THEN 0 ELSE p.a END AS a FROM z p JOIN z q ON p.image_id=q.image_id AND q.x BETWEEN p.x-2 AND p.x+2 AND q.y BETWEEN p.y-2 AND p.y+2 GROUP BY p.image_id, p.x, p.y, p.r, p.g, p.b, p.a")
def edge_suspects(s):
    return columns.edge_suspects(s.px).select("image_id", "x", "y", "a")


@query(f"{BASE} SELECT image_id, CAST(greatest(floor(1000/100*25/avg(eos-sos)+0.5),1) AS INT) AS n_rows, 1 AS dx, CAST(greatest(1, floor(25/greatest(floor(1000/100*25/avg(eos-sos)+0.5),1))) AS INT) AS dy FROM col GROUP BY 1")
def sample_grid_spec(s):
    return sampling.sample_grid_spec(s.col, W, H)


@query(f"""{BASE}, c AS (SELECT image_id, x AS cx, unnest(generate_series(sos+3+(eos-6-sos-3)%2, eos-6, 2)) AS cy FROM col WHERE eos-6>=sos+3)
SELECT c.image_id, cx AS x, CAST(cy AS INT) AS y, {', '.join(f'CAST(floor(avg({k})) AS INT) AS {k}' for k in 'rgb')}, {', '.join(f'round(coalesce(coalesce(stddev_samp({k}),0)/nullif(avg({k}),0),0), 6) AS cv_{k}' for k in 'rgb')}
FROM c JOIN px ON px.image_id=c.image_id AND px.x BETWEEN cx-2 AND cx+2 AND px.y BETWEEN cy-2 AND cy+2 WHERE a>=32767 GROUP BY 1, 2, 3""")
def sample_sky(s):
    d = sampling.sample_sky(s.px, s.col, s.images.selectExpr("image_id", "10 AS n_rows", "1 AS dx", "2 AS dy"))
    return rounded(d, 6, "cv_r", "cv_g", "cv_b")


@query(f"{SAMPLES} SELECT image_id, round(sum(h*(1-s))/sum(1-s), 4) AS h, round(avg(s), 6) AS s, round(sum(v*(1-s))/sum(1-s), 6) AS v FROM smp GROUP BY 1")
def image_sky_color(s):
    return rounded(sampling.image_sky_color(s.samples()), 6, "s", "v").withColumn("h", F.round("h", 4))


_CLOSE = f"""{SAMPLES}, nb AS (SELECT a.image_id, a.x, a.y, count(b.x) AS n_close FROM smp a LEFT JOIN smp b ON a.image_id=b.image_id AND (a.x<>b.x OR a.y<>b.y)
AND pow(a.s-b.s,2)+pow(a.v-b.v,2)<0.005 AND pow(a.s-b.s,2)+pow(a.px-b.px,2)<0.01 AND pow(a.h-b.h,2)+pow(a.v-b.v,2)<36 GROUP BY 1, 2, 3)"""


@query(f"{_CLOSE} SELECT * FROM nb")
def close_neighbors(s):
    return sampling.close_neighbors(s.samples()).select("image_id", "x", "y", "n_close")


@query(f"""{_CLOSE}, j AS (SELECT * FROM smp JOIN nb USING (image_id, x, y)), m AS (SELECT image_id, avg(s) AS ms, avg(v) AS mv FROM j WHERE n_close>=2 GROUP BY 1)
SELECT image_id, x, y, CAST(n_close<2 OR coalesce(s/ms<0.05 AND v/mv>0.95, false) OR NOT h BETWEEN 150 AND 250 AS INT) AS is_outlier FROM j LEFT JOIN m USING (image_id)""")
def flag_outliers(s):
    return sampling.flag_outliers(sampling.close_neighbors(s.samples())).select("image_id", "x", "y", "is_outlier")


_REPORT_L = f"((py-0.5)*sin(radians({S.FOV})*{H}/{W}/2)*2)"


@query(f"""{MODEL}, q AS ({S.hsv('pred')}) SELECT image_id, x, y, round(-px*{S.FOV}, 1) AS ha, round(degrees(asin({_REPORT_L})), 1) AS va, round(px, 4) AS px, round(py, 4) AS py, round(h, 2) AS hue, round(s, 3) AS sat, round(v, 3) AS val,
round(v/0.8, 3) AS nv, round(s/0.5, 3) AS ns, round(h_hat, 2) AS hue_hat, round(s_hat, 3) AS sat_hat, round(v_hat, 3) AS val_hat, round(h_hat-h, 2) AS hue_err, round(s_hat-s, 3) AS sat_err, round(v_hat-v, 3) AS val_err,
CAST(x%4 AS INT) AS n_close, round(r/nullif(b,0)::DOUBLE, 5) AS r, round(g/nullif(b,0)::DOUBLE, 5) AS g, round(b/65535.0::DOUBLE, 5) AS b, 0.01::DOUBLE AS cv_r, 0.02::DOUBLE AS cv_g, 0.03::DOUBLE AS cv_b, CASE WHEN x%4<2 THEN 1 ELSE 7 END AS symbol
FROM q JOIN col USING (image_id, x) WHERE a >= 32767 AND x%2=0 AND y%2=0 AND y BETWEEN sos AND eos""")
def sample_report(s):
    d = sampling.with_hsv(masks.sky_band(s.predicted.filter("a >= 32767 AND x % 2 = 0 AND y % 2 = 0"), s.col))
    d = d.withColumns({"normalized_v": F.col("v") / 0.8, "normalized_s": F.col("s") / 0.5, "n_close": F.col("x") % 4, "cv_r": F.lit(0.01), "cv_g": F.lit(0.02), "cv_b": F.lit(0.03)})
    d = d.withColumn("is_outlier", (F.col("n_close") < 2).cast("int"))
    return rasters.sample_report(d, s.sized.withColumn("fov", F.lit(S.FOV)))


@query(f"{BASE} SELECT image_id, x, round(coalesce(stddev_samp(g), 0), 4) AS sd, round(coalesce(stddev_samp(g), 0)/nullif(avg(g), 0), 6) AS cv FROM px GROUP BY 1, 2")
def stddev_cv(s):
    sums = s.px.withColumn("q", F.col("g").cast("double") * F.col("g")).groupBy("image_id", "x").agg(F.count("*").alias("n"), F.sum("g").cast("double").alias("s"), F.sum("q").alias("q"))
    sd = sampling.stddev_n(F.col("n"), F.col("s"), F.col("q"))
    return sums.select("image_id", "x", F.round(sd, 4).alias("sd"), F.round(sd / F.nullif(F.col("s") / F.col("n"), F.lit(0.0)), 6).alias("cv"))


@query(f"{BASE} SELECT image_id, x, round(abs(avg(b) FILTER (WHERE y<12)-avg(b) FILTER (WHERE y>=12))/sqrt(var_samp(b) FILTER (WHERE y<12)/12+var_samp(b) FILTER (WHERE y>=12)/13), 4) AS t FROM px GROUP BY 1, 2")
def means_t(s):
    d = s.px.withColumns({"v": F.col("b").cast("double"), "top": F.col("y") < 12})
    part = lambda c, top: F.sum(F.when(F.col("top") == top, c))
    six = [part(c, top) for top in (True, False) for c in (F.lit(1.0), F.col("v"), F.col("v") * F.col("v"))]
    return d.groupBy("image_id", "x").agg(*[c.alias(f"c{k}") for k, c in enumerate(six)]).select("image_id", "x", F.round(sampling.means_t(*[F.col(f"c{k}") for k in range(6)]), 4).alias("t"))


@query(f"{BASE} SELECT image_id, x, count(*) AS n, round(regr_intercept(g, y), 4) AS intercept, round(regr_slope(g, y), 6) AS slope, round(regr_syy(g, y)-regr_slope(g, y)*regr_sxy(g, y), 0) AS sse FROM px GROUP BY 1, 2")
def weighted_ols(s):
    d = sampling.weighted_ols(s.px, ["image_id", "x"], "y", "g", F.lit(1.0))
    return d.select("image_id", "x", "n", F.round("intercept", 4).alias("intercept"), F.round("slope", 6).alias("slope"), F.round("sse", 0).alias("sse"))


@query(None)
def ols_report(s):
    d = s.px.withColumn("y2", F.col("y") * F.col("y"))
    return fits.ols_report(d, ["image_id"], ["x", "y", "y2"], "b")


@query(None)
def student_t_cdf(s):
    d = s.px.groupBy("image_id", "x").agg(F.avg("b").alias("m"), F.stddev_samp("b").alias("sd"))
    return d.select("image_id", "x", F.round(fits.student_t_cdf((F.col("m") - 45000) / F.col("sd"), F.lit(24.0)), 6).alias("p"))


def _logistic(pdf, p):
    import numpy as np

    return p[0] + p[1] / (1 + np.exp(np.clip((pdf.py - p[2]) * p[3], -50, 50))) - pdf.v


@query(None)
def fit_bounded(s):
    return fits.fit_bounded(s.samples().select("image_id", "py", "v"), ["image_id"], _logistic, [0.5, 0.5, 0.5, 1.0], [0.0, 0.0, 0.0, 0.1], [1.0, 1.0, 1.0, 20.0])


@query(None)
def end_of_sky_regression(s):
    return fits.end_of_sky_regression(s.px, s.col, H)


@query(f"""{SAMPLES}, g AS (SELECT image_id, hz, 1/(py-hz) AS u, 1/s AS w FROM smp, (SELECT 0.5+k*0.05 AS hz FROM generate_series(0,9) t(k)) WHERE s>0 AND py>hz+0.001),
f AS (SELECT image_id, hz AS horizon, round(regr_syy(w,u)-regr_slope(w,u)*regr_sxy(w,u), 4) AS sse, count(*) AS n FROM g GROUP BY 1, 2)
SELECT image_id, horizon, sse FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY sse, horizon) AS k FROM f WHERE n>=3 AND sse IS NOT NULL) WHERE k=1""")
def best_sat_start(s):
    return sampling.best_sat_start(s.samples())


_SETS = ", ".join(f"({t},{a}::DOUBLE,{b}::DOUBLE,{c}::DOUBLE,{d}::DOUBLE,{e}::DOUBLE)" for t, _, a, b, c, d, e in sampling.SKY_SETS)
_SUNS = f"(SELECT k AS sun, (floor(k/4)*10-180)/{S.FOV}::DOUBLE AS sx, (k%4)*0.5::DOUBLE AS sy FROM (SELECT CAST(unnest(generate_series(0, 147)) AS INT) AS k))"
_FY = f"(radians({S.FOV})*{H}/{W})"
_GAMMA = f"sqrt(pow((px-sx)*radians({S.FOV}),2)+pow((py-sy)*{_FY},2))"
_CIE = f"(1+ca*exp(cb/cos(least(pi()/2-(py-{S.HORIZON})*{_FY},pi()/2-0.01))))*(1+cc*(exp(cd*gamma)-exp(cd*pi()/2))+ce*pow(cos(gamma),2))"
_GRID = f"""{SAMPLES}, q AS (SELECT *, CASE WHEN {_GAMMA}<radians(0.533)/2 THEN 0 ELSE {_GAMMA} END AS gamma FROM smp, (VALUES {_SETS}) p(type,ca,cb,cc,cd,ce), {_SUNS} z),
sc AS (SELECT image_id, type, sun, sum(pow(v-{_CIE}/10,2)) AS sse FROM q GROUP BY 1, 2, 3)"""


def _scores(s):
    c, fov = F.col, F.radians(F.lit(S.FOV))
    gamma = geometry.sun_angle(c("px"), c("py"), c("sx"), c("sy"), fov, fov * H / W)
    theta = geometry.zenith_angle(c("py"), F.lit(S.HORIZON), fov * H / W)
    return sampling.score_sky_grid(s.samples(), sampling.sun_grid(s.spark, S.FOV), gamma, theta, 0.1)


@query(f"{_GRID} SELECT image_id, type, sun, round(sse, 2) AS sse FROM sc")
def score_sky_grid(s):
    return rounded(_scores(s), 2, "sse")


@query(f"{_GRID} SELECT image_id, type, sun, sse FROM (SELECT image_id, type, sun, round(sse, 3) AS sse, row_number() OVER (PARTITION BY image_id ORDER BY round(sse, 3), type, sun) AS k FROM sc) WHERE k=1")
def best_sky_grid(s):
    return sampling.best_sky_grid(_scores(s))


_L = f"((py-0.5)*sin(radians({S.FOV})*{H}/{W}/2)*2)"


@query(f"{BASE}, {S.REL} SELECT image_id, x, y, round(-px*radians({S.FOV}), 6) AS aoy, round(CASE WHEN {_L}>1 THEN pi()-asin(2-{_L}) ELSE asin({_L}) END, 6) AS aox FROM rel")
def view_angles(s):
    v = geometry.view_angles(F.col("px"), F.col("py"), F.lit(S.FOV), F.lit(W), F.lit(H))
    return rounded(s.rel.withColumn("v", v).select("image_id", "x", "y", "v.aoy", "v.aox"), 6, "aoy", "aox")


@query(f"{BASE}, {S.REL}, va AS (SELECT *, -px*radians({S.FOV}) AS u, asin({_L}) AS w FROM rel) SELECT image_id, x, y, round(acos(greatest(-1,least(1,sin(0.3)*cos(0.2)*sin(u)*cos(w)+sin(0.2)*sin(w)+cos(0.3)*cos(0.2)*cos(u)*cos(w)))), 6) AS angle FROM va")
def angle_to_sun(s):
    v = geometry.view_angles(F.col("px"), F.col("py"), F.lit(S.FOV), F.lit(W), F.lit(H))
    d = s.rel.withColumn("v", v).withColumns({"u": geometry.view_vector(F.col("v.aoy"), F.col("v.aox")), "sun": geometry.view_vector(F.lit(0.3), F.lit(0.2))})
    return d.select("image_id", "x", "y", F.round(geometry.angle_between(F.col("u"), F.col("sun")), 6).alias("angle"))


@query(f"{BASE}, {S.REL}, {S.HC} SELECT image_id, x, y, round(hc, 6) AS hc FROM hcs")
def adjust_horizon(s):
    return s.rel.select("image_id", "x", "y", F.round(geometry.adjust_horizon(F.col("px"), F.col("py"), F.lit(S.CURVATURE), F.lit(S.SLOPE)), 6).alias("hc"))


_R = f"(sqrt(pow(px-0.1,2)+pow((py-0.7)*({H}/{W}.0::DOUBLE),2))/0.12)"


@query(f"{BASE}, {S.REL} SELECT image_id, x, y, round(sqrt(CASE WHEN {_R}<1 THEN 1.0 ELSE 1-1/(1+exp(5-10*({_R}-1))) END), 6) AS w FROM rel")
def sun_weight(s):
    w = geometry.sun_weight(F.col("px"), F.col("py"), F.lit(0.1), F.lit(0.7), F.lit(H / W), F.lit(1.0), F.lit(0.12))
    return s.rel.select("image_id", "x", "y", F.round(w, 6).alias("w"))


@query(f"{MODEL} SELECT image_id, x, y, round(h_hat, 4) AS h_hat, round(s_hat, 6) AS s_hat, round(v_hat, 6) AS v_hat FROM pred")
def predict_sky(s):
    return rounded(s.predicted.select("image_id", "x", "y", "h_hat", "s_hat", "v_hat"), 6, "s_hat", "v_hat").withColumn("h_hat", F.round("h_hat", 4))


@query(f"{BASE}, {S.REL} SELECT image_id, x, y, round(least(0.3+0.5/(1+exp((py-0.4)*6))+0.1*cos(radians({S.FOV}*px+5))*(1-0.2*abs({S.FOV}*px+5)/180), 1), 6) AS v_hat FROM rel")
def predict_val_smooth(s):
    c = F.array(*[F.lit(x) for x in (0.3, 0.5, 0.4, 6.0, 0.2, 0.1, 5.0)])
    return s.rel.select("image_id", "x", "y", F.round(model.predict_val_smooth(F.col("px"), F.col("py"), c, F.lit(S.FOV)), 6).alias("v_hat"))


@query(f"{MODEL}, {S.PROB} SELECT image_id, x, y, round(prob_sky, 3) AS prob_sky FROM prob")
def sky_probability(s):
    return rounded(fill.sky_probability(s.predicted, s.col).select("image_id", "x", "y", "prob_sky"), 3, "prob_sky")


_CORR = f"""{MODEL}, hp AS ({S.hsv('pred JOIN col USING (image_id, x)')}), corr AS (SELECT image_id, x, {', '.join(f'coalesce(sum({a}) FILTER (WHERE k)/nullif(sum({b}) FILTER (WHERE k),0),1) AS {n}' for n, a, b in (('h_corr', 'h*s', 'h_hat*s'), ('s_corr', 's', 's_hat'), ('v_corr', 'v*s', 'v_hat*s')))}, count(*) FILTER (WHERE k) AS n
FROM (SELECT *, y>=sos AND y<least(sos+floor((eos-sos)*0.25+0.5),eos,24) AND greatest(r,g,b)>3840 AS k FROM hp WHERE column_mask=0) GROUP BY 1, 2),
sm AS (SELECT image_id, x, {', '.join(f'coalesce(avg({c}_corr) FILTER (WHERE n>0) OVER w, 1) AS {c}_corr' for c in 'hsv')} FROM corr WINDOW w AS ({XW} RANGE BETWEEN 126 PRECEDING AND 126 FOLLOWING))"""


@query(f"{_CORR} SELECT image_id, x, round(h_corr, 5) AS h_corr, round(s_corr, 5) AS s_corr, round(v_corr, 5) AS v_corr, n FROM corr")
def column_corrections(s):
    return rounded(fill.column_corrections(s.predicted, s.col, H), 5, "h_corr", "s_corr", "v_corr")


@query(f"{_CORR} SELECT image_id, x, {', '.join(f'round({c}_corr, 5) AS {c}_corr' for c in 'hsv')} FROM sm")
def smooth_corrections(s):
    return rounded(fill.smooth_corrections(fill.column_corrections(s.predicted, s.col, H)), 5, "h_corr", "s_corr", "v_corr")


@query(f"{MODEL} SELECT image_id, round(avg(h_hat), 4) AS h_zenith, round(avg(s_hat), 6) AS s_zenith, round(avg(v_hat), 6) AS v_zenith FROM pred JOIN col USING (image_id, x) WHERE y=0 AND column_mask=0 GROUP BY 1")
def zenith_color(s):
    return rounded(fill.zenith_color(s.predicted, s.col), 6, "s_zenith", "v_zenith").withColumn("h_zenith", F.round("h_zenith", 4))


@query(f"{MODEL} SELECT image_id, round(sum(pow(greatest(r,g,b)/65535.0::DOUBLE-v_hat,2)), 4) AS sse_v, round(sum({'+'.join(f'pow(({c}-{c}_hat)/65535.0::DOUBLE,2)' for c in 'rgb')}), 2) AS sse_rgb FROM pred GROUP BY 1")
def fit_error(s):
    d = fill.fit_error(s.predicted)
    return d.select("image_id", F.round("sse_v", 4).alias("sse_v"), F.round("sse_rgb", 2).alias("sse_rgb"))


_DARK = [0.1, 0.36, 2.0, 0.2]
_V_AT = f"greatest(0,least(1,base*{_DARK[1]}+{_DARK[0]}*(exp(cos({_DARK[2]}*((hc-{S.HORIZON}-{_DARK[3]}*base)*radians({S.FOV})*{H}/{W})))/exp(1)-exp(-2))*1.156517642))"


@query(f"""{BASE}, {S.REL}, mi AS (SELECT image_id, avg(py) AS middle FROM rel JOIN col USING (image_id, x) WHERE a>=32767 AND x%2=0 AND y%2=0 AND y BETWEEN sos AND eos GROUP BY 1),
pl AS (SELECT image_id, t, k, k/100.0::DOUBLE-0.5 AS px, CASE WHEN t=1 THEN 1.0::DOUBLE ELSE middle END AS py FROM mi, (SELECT unnest(generate_series(0,100)) AS k), (VALUES (0),(1)) u(t)),
hc AS (SELECT *, {S.HC.split('SELECT *, ')[1].split(' AS hc')[0]} AS hc, {S._BASE} AS base FROM pl),
v AS (SELECT image_id, k, t, {_V_AT} AS v FROM hc), w AS (SELECT image_id, k, max(v) FILTER (WHERE t=1) AS top, max(v) FILTER (WHERE t=0) AS mid FROM v GROUP BY 1, 2)
SELECT image_id, count(*) FILTER (WHERE top<100/255.0::DOUBLE AND top<mid) AS n_dark, count(*) FILTER (WHERE top<100/255.0::DOUBLE AND top<mid)>10 AS dark_top FROM w GROUP BY 1""")
def dark_top_check(s):
    dark = F.array(*[F.lit(v) for v in _DARK])
    return fill.dark_top_check(s.models.withColumn("v_coefs", dark), s.samples(), W, H)


@query(f"""{BASE} SELECT image_id, x, y, round(CASE WHEN y>=sos AND b>=0.04*65535 THEN greatest(0,least(1,1-(y-sos)/(least(sos+floor((eos-sos)*0.5+0.5),eos)-sos))) ELSE 1 END, 6) AS w,
round(CASE WHEN y<=raw_sos THEN 1 WHEN y>least(raw_sos+floor((eos-sos)*0.5+0.5),eos) THEN 0 WHEN b<0.04*65535 THEN 1 ELSE greatest(0,least(1,1-(y-raw_sos)/(least(raw_sos+floor((eos-sos)*0.5+0.5),eos)-raw_sos))) END::DOUBLE, 6) AS raw_w FROM px JOIN col USING (image_id, x)""")
def feather_weight(s):
    d = s.px.join(s.col, ["image_id", "x"])
    y, sos, eos, raw = F.col("y"), F.col("sos"), F.col("eos"), F.col("raw_sos")
    w = model.feather_weight(y, sos, model.feather_length(sos, eos), F.col("b"))
    raw_w = model.raw_feather_weight(y, raw, model.feather_length(sos, eos, from_row=raw), F.col("b"))
    return d.select("image_id", "x", "y", F.round(w, 6).alias("w"), F.round(raw_w, 6).alias("raw_w"))


@query(f"{BASE}, {S.REL} SELECT image_id, x, y, round((1/(1+exp(-(py-0.5)*5))-1/(1+exp(2.5)))/(1-2/(1+exp(2.5))), 6) AS p FROM rel")
def logistic_feather(s):
    return s.rel.select("image_id", "x", "y", F.round(model.logistic_feather(F.col("py")), 6).alias("p"))


_TOP = "CASE WHEN y<sos THEN 1-(1-y/nullif(sos,0)::DOUBLE)*(1-{f}) ELSE 1.0 END"


def _fill(zenith: bool) -> str:
    """SQL of the default fill; with a zenith, by depth .6, end factor .5 and factors (-8, .9, 1.1)."""
    s_top, v_top = (_TOP.format(f=f) for f in ((0.9, 1.1) if zenith else (1.0, 1.0)))
    new = S.rgb("greatest(0,least(359.99,h_hat*h_corr))::DOUBLE", f"greatest(0,least(1,s_hat*({s_top})*s_corr))::DOUBLE", f"greatest(0,least(1,v_hat*({v_top})*v_corr))::DOUBLE")
    col = "col"
    if zenith:
        ext = "SELECT image_id, max(sos) AS sos, CAST(floor(0.5*max(eos)+0.5*min(eos)) AS INT) AS eos FROM col WHERE column_mask=0 GROUP BY 1"
        col = f"(SELECT col.image_id, col.x, col.raw_sos, e.sos, e.eos FROM col JOIN ({ext}) e USING (image_id))"
    top = S.rgb("least(359.99,hz-8)", "sz", "vz")
    zen = f"""ze AS (SELECT image_id, {', '.join(f'{e} AS z{c}' for c, e in top.items())} FROM (SELECT image_id, avg(h_hat) AS hz, avg(s_hat)*0.9 AS sz, avg(v_hat)*1.1 AS vz FROM pred JOIN col USING (image_id, x) WHERE y=0 AND column_mask=0 GROUP BY 1)),
zd AS (SELECT h.*, zr, zg, zb, floor((sos+n)*0.6+0.5) AS zl FROM h LEFT JOIN ze USING (image_id)),
hh AS (SELECT * EXCLUDE (nr, ng, nb), {', '.join(f'CASE WHEN y<=zl AND zl>0 THEN floor((zl-y)/zl*z{c}+(1-(zl-y)/zl)*n{c}+0.5) ELSE n{c} END AS n{c}' for c in 'rgb')} FROM zd)"""
    return f"""{_CORR}, f AS (SELECT pred.*, sos, raw_sos, least(sos+floor((eos-sos)*0.5+0.5),eos)-sos AS n, h_corr, s_corr, v_corr FROM pred JOIN {col} cc USING (image_id, x) LEFT JOIN sm USING (image_id, x)),
h AS (SELECT *, {', '.join(f'{e} AS n{c}' for c, e in new.items())} FROM f), {zen if zenith else 'hh AS (SELECT * FROM h)'},
w AS (SELECT *, h_corr IS NULL OR (a<32767 AND y>raw_sos) OR y>=sos+n AS skip, CASE WHEN y>=sos AND b>=0.04*65535 THEN coalesce(greatest(0,least(1,1-(y-sos)/nullif(n,0)::DOUBLE)),0) ELSE 1.0 END::DOUBLE AS w FROM hh)
SELECT image_id, x, y, {', '.join(f'CAST(CASE WHEN skip THEN {c} ELSE floor(n{c}*w+{c}*(1-w)+0.5) END AS INT) AS {c}' for c in 'rgb')}, CASE WHEN NOT skip THEN 65535 ELSE a END AS a FROM w"""


@query(_fill(False))
def fill_sky_columns(s):
    return fill.fill_sky_columns(s.predicted, s.col, H)


@query(_fill(True))
def fill_towards_zenith(s):
    return fill.fill_sky_columns(s.predicted, s.col, H, zenith=(0.6, 0.5), factors=(-8.0, 0.9, 1.1))


#: The sun of the queries with one: place, glow, and reach.
SUN_PX, SUN_PY, SUN_C, SUN_D, SUN_LUM, SAT_DEPTH, SUN_F, SUN_G = 0.1, 0.8, 3.0, 0.3, 0.6, 0.9, 0.8, 0.25


def _sunny(s):
    images = s.sized.withColumns({"sun_px": F.lit(SUN_PX), "sun_py": F.lit(SUN_PY), "cf": F.lit(SUN_F), "cg": F.lit(SUN_G)})
    glow = geometry.glow_range(images.withColumns({"fov": F.lit(S.FOV), "c": F.lit(SUN_C), "d": F.lit(SUN_D)}))
    more = {"cc": F.lit(SUN_C), "cd": F.lit(SUN_D), "sun_lum": F.lit(SUN_LUM), "sat_depth": F.lit(SAT_DEPTH)}
    return images, s.models.join(images.join(glow, "image_id").withColumns(more), "image_id")


_VIEW = f"sin({{u}})*cos({{w}})*sin({{u2}})*cos({{w2}})+sin({{w}})*sin({{w2}})+cos({{u}})*cos({{w}})*cos({{u2}})*cos({{w2}})"
_AOY, _AOX = f"(-({{x}})*radians({S.FOV}))", f"asin((({{y}})-0.5)*sin(radians({S.FOV})*{H}/{W}/2)*2)"


def _gamma(x, y) -> str:
    """SQL of the angle between a place and the sun, 0 within its disc."""
    g = "acos(greatest(-1,least(1," + _VIEW.format(u=_AOY.format(x=x), w=_AOX.format(y=y), u2=_AOY.format(x=SUN_PX), w2=_AOX.format(y=SUN_PY)) + ")))"
    return f"(CASE WHEN {g}<radians(0.533)/2 THEN 0 ELSE {g} END)"


def _glow(x, y) -> str:
    return f"(1+{SUN_C}*(exp(-{_gamma(x, y)}/{SUN_D})-exp(-(pi()/2)/{SUN_D})))"


_GMAX = f"(1+2*(1-exp(-(pi()/2)/{SUN_D})))"
_GMIN = f"(SELECT min({_glow('a', 'b')}) FROM (VALUES (-0.5),(0.0),(0.5)) t(a), (VALUES (0.0),(0.5),(1.0)) u(b))"
SUNNY = f"""{BASE}, {S.REL}, {S.HC}, {S.HATS.replace('hats AS', 'hats0 AS')}, gm AS (SELECT {_GMIN} AS lo),
ad AS (SELECT *, greatest(0, {SUN_LUM}*(least(1,greatest(0,{_glow('px', 'py')}/{_GMAX}))*{_GMAX}-lo)/({_GMAX}-lo)) AS add FROM hats0, gm),
hats AS (SELECT * REPLACE (greatest(0,least(1,s_hat-add))*{SAT_DEPTH} AS s_hat, least(1,v_hat+add)::DOUBLE AS v_hat) FROM ad), {S.PRED}"""


@query(f"{SUNNY} SELECT image_id, x, y, round(h_hat, 4) AS h_hat, round(s_hat, 6) AS s_hat, round(v_hat, 6) AS v_hat FROM pred")
def predict_sky_with_sun(s):
    d = fill.predict_sky(s.px, _sunny(s)[1], light="sun")
    return rounded(d.select("image_id", "x", "y", "h_hat", "s_hat", "v_hat"), 6, "s_hat", "v_hat").withColumn("h_hat", F.round("h_hat", 4))


_CIE_HC = f"(1-0.5*exp(-0.3/cos(least(pi()/2-(hc-{S.HORIZON})*{_FY},pi()/2-0.01))))*(1+{SUN_C}*(exp(-1.2*gam)-exp(-1.2*pi()/2))+0.4*pow(cos(gam),2))"
_GAM = f"sqrt(pow((px-{SUN_PX})*radians({S.FOV}),2)+pow((py-{SUN_PY})*{_FY},2))"


@query(f"{BASE}, {S.REL}, {S.HC}, g AS (SELECT *, CASE WHEN {_GAM}<radians(0.533)/2 THEN 0 ELSE {_GAM} END AS gam FROM hcs) SELECT image_id, x, y, round(greatest(0,least(1,{_CIE_HC}*0.2)), 6) AS v_hat FROM g")
def predict_sky_luminance(s):
    """The value from general sky luminance."""
    more = {"sun_px": SUN_PX, "sun_py": SUN_PY, "ca": -0.5, "cb": -0.3, "cc": SUN_C, "cd": -1.2, "ce": 0.4, "v_factor": 0.2}
    d = fill.predict_sky(s.px, s.models.withColumns({k: F.lit(v) for k, v in more.items()}), W, H, "luminance")
    return rounded(d.select("image_id", "x", "y", "v_hat"), 6, "v_hat")


def _replace(pred: str, sun: bool, zenith: bool = False) -> str:
    """SQL of the full replacement; with the sun also nonsky columns, fading and factors (0, .9, 1.1)."""
    s_top, v_top = (_TOP.format(f=f) for f in ((0.9, 1.1) if sun else (1.0, 1.0)))
    hat = S.rgb("h_hat", f"greatest(0,least(1,s_hat*({s_top})))::DOUBLE", f"greatest(0,least(1,v_hat*({v_top})))::DOUBLE")
    r = f"(sqrt(pow(px-{SUN_PX},2)+pow((py-{SUN_PY})*({H}/{W}.0::DOUBLE),2))/{SUN_G})"
    near = f"{SUN_F}*sqrt(CASE WHEN {r}<1 THEN 1.0 ELSE 1-1/(1+exp(5-10*({r}-1))) END)" if sun else "0.0"
    fade = "CASE WHEN y>fe THEN 1-coalesce((y-fe)/nullif(fin-fe,0)::DOUBLE,0) ELSE 1.0 END" if sun else "1.0"
    nonsky = "x BETWEEN 0 AND 3" if sun else "false"
    return f"""{pred}, {S.PROB}, e AS (SELECT *, coalesce(manual_eos, eos) AS fin, least(sos+floor((coalesce(manual_eos, eos)-sos)*0.5+0.5),coalesce(manual_eos, eos)) AS fe, {near} AS near FROM prob),
f AS (SELECT *, CASE WHEN y<=fe THEN greatest(0,least(1,1-coalesce((y-sos)/nullif(fe-sos,0)::DOUBLE,1))) ELSE 0.0 END::DOUBLE AS l FROM e),
g AS (SELECT *, (1/(1+exp(-(l-0.5)*5))-1/(1+exp(2.5)))/(1-2/(1+exp(2.5))) AS w, {', '.join(f'{x} AS h{c}' for c, x in hat.items())} FROM f),
p AS (SELECT *, CASE WHEN column_mask=1 THEN NULL WHEN y<sos OR a<65535 THEN 1.0 WHEN {nonsky} THEN p_hat*greatest(p_hat,w,near)+(1-p_hat)*p_hat ELSE greatest(greatest(p_hat,w)*{fade},near) END::DOUBLE AS p FROM g),
n AS (SELECT *, {', '.join(f'CAST(floor(p*h{c}+(1-p)*CASE WHEN y<sos THEN h{c} ELSE {c} END+0.5) AS INT) AS n{c}' for c in 'rgb')} FROM p),
q AS (SELECT *, p IS NOT NULL AND (y<fin OR (y=fin AND fin-1<22 AND coalesce(lag(greatest(nr,ng,nb)) OVER w1<greatest(r,g,b) AND lead(greatest(r,g,b)) OVER w1<greatest(r,g,b), false))) AS takes FROM n WINDOW w1 AS ({YW}))
SELECT image_id, x, y, {', '.join(f'CASE WHEN takes THEN n{c} ELSE {c} END AS {c}' for c in 'rgb')}, CASE WHEN takes THEN 65535 ELSE a END AS a, CASE WHEN takes THEN round(p, 6) END AS p FROM q"""


@query(_replace(MODEL, False))
def replace_sky(s):
    return rounded(fill.replace_sky(s.predicted, s.col), 6, "p")


@query(_replace(SUNNY, True))
def replace_sky_with_sun(s):
    images, models = _sunny(s)
    col = s.col.withColumn("nonsky_mask", F.expr("CASE WHEN x BETWEEN 0 AND 3 THEN 1 ELSE 0 END"))
    return rounded(fill.replace_sky(fill.predict_sky(s.px, models, light="sun"), col, suns=images, factors=(0.0, 0.9, 1.1), fade=True), 6, "p")


@query(f"{MODEL}, {S.PROB} SELECT image_id, x, y, {', '.join(f'CAST(floor(prob_sky*65535) AS INT) AS {c}' for c in 'rgb')} FROM prob")
def probability_map(s):
    return fill.diagnostic_maps(s.predicted, s.col, "probability")


@query(f"{MODEL} SELECT image_id, x, y, {', '.join(f'abs({c}-{c}_hat) AS {c}' for c in 'rgb')} FROM pred")
def error_map(s):
    return fill.diagnostic_maps(s.predicted, s.col, "error")


def _factor_sql() -> str:
    """SQL of the factors beside the range 30..32; the right side has no pixel in every third image, and no side in every fifth."""
    parts = []
    for side, near in (("l", "x<30"), ("r", "x>=33")):
        parts.append(f"count(*) FILTER (WHERE {near}) AS n_{side}")
        for c in "sh":
            q = f"CASE WHEN {near} THEN {c}/{c}_hat END"
            parts.append(f"regr_intercept({q}, y) AS {c}{side}0, regr_slope({q}, y) AS {c}{side}1, avg({q}) AS {c}{side}m")
    parts += [f"sum({c})/sum({c}_hat) AS {c}m" for c in "sh"]
    out = []
    for side, other in (("l", "r"), ("r", "l")):
        for c in "sh":
            for k in (0, 1):
                own = lambda at: f"coalesce({c}{at}{k}, {f'{c}{at}m' if k == 0 else '0'})"  # noqa: B023, E731
                out.append(f"CASE WHEN n_{side}>2 THEN {own(side)} WHEN n_{other}>2 THEN {own(other)} ELSE {f'coalesce({c}m, 1)' if k == 0 else '0.0'} END AS {c}_{side}{k}")
    return f"""q AS ({S.hsv('pred JOIN col USING (image_id, x)')}), n AS (SELECT * FROM q WHERE x BETWEEN 20 AND 42 AND (x<30 OR x>=33) AND s_hat>0.1 AND h_hat>0 AND column_mask=0 AND y BETWEEN sos AND eos
  AND NOT (image_id%3=1 AND x>=33) AND image_id%5<>2), g AS (SELECT image_id, {', '.join(parts)} FROM n GROUP BY 1),
f AS (SELECT image_id, coalesce(n_l, 0) AS n_l, coalesce(n_r, 0) AS n_r, {', '.join(out)} FROM (SELECT image_id, g.* EXCLUDE (image_id, n_l, n_r), coalesce(n_l, 0) AS n_l, coalesce(n_r, 0) AS n_r FROM img LEFT JOIN g USING (image_id)))"""


def _beside(s):
    """The prediction, and columns that are masked beside the range in some images."""
    return s.predicted, s.col.withColumn("column_mask", F.expr("CASE WHEN image_id % 3 = 1 AND x >= 33 OR image_id % 5 = 2 AND x NOT BETWEEN 30 AND 32 THEN 1 ELSE column_mask END"))


_SLOPES = [f"{c}_{side}{k}" for side in "lr" for c in "sh" for k in (0, 1)]


@query(f"{MODEL}, {_factor_sql()} SELECT image_id, n_l, n_r, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in _SLOPES)} FROM f")
def hue_repair_factors(s):
    return rounded(fill.hue_repair_factors(*_beside(s), 30, 33), 6, *_SLOPES)


_NEW_HUE = S.rgb("h2", "s2", "v")


@query(f"""{MODEL}, {_factor_sql()},
i AS (SELECT *, 1-(x-30)/3.0::DOUBLE AS p FROM q JOIN f USING (image_id) WHERE x>=30 AND x<33 AND column_mask=0 AND y BETWEEN sos AND eos),
z AS (SELECT *, greatest(0,least(359.99,h_hat*(p*(h_l0+h_l1*y)+(1-p)*(h_r0+h_r1*y)))) AS h2, greatest(0,least(1,s_hat*(p*(s_l0+s_l1*y)+(1-p)*(s_r0+s_r1*y)))) AS s2 FROM i),
nn AS (SELECT *, {", ".join(f"{x} AS new_{c}" for c, x in _NEW_HUE.items())} FROM z),
u AS (SELECT *, coalesce(CASE WHEN new_r-r<new_g-g AND new_r-r<new_b-b THEN r/nullif(new_r,0)::DOUBLE WHEN new_r-r>=new_g-g AND new_g-g<new_b-b THEN g/nullif(new_g,0)::DOUBLE ELSE b/nullif(new_b,0)::DOUBLE END, 1) AS rise FROM nn)
SELECT image_id, x, y, {", ".join(f"CAST(least(65535, floor(new_{c}*rise+0.5)) AS INT) AS {c}" for c in "rgb")}, floor(greatest(new_r,new_g,new_b)*rise+0.5)>65535 AS clipped FROM u""")
def repair_sky_hue(s):
    return fill.repair_sky_hue(*_beside(s), 30, 33)


@query(None)
def dither(s):
    return fill.dither(s.px)


@query(None)
def cluster_errors(s):
    return fits.cluster_errors(fill.diagnostic_maps(s.predicted, s.col, "error"))


def _elements(s, rows, names):
    return rasters.literal(s.spark, s.images, rows, names)


GHOSTS = [(10.0, 8.0, 4.0, 0.3, 0.25, 0.05, 2.0, 0.6, 0.4, 30.0, 6, 0.3), (22.0, 14.0, 6.0, 0.1, 0.2, 0.5, 1.5, 0.0, 0.0, 0.0, 8, 0.7), (24.0, 12.0, 5.0, 0.4, 0.1, 0.1, 3.0, 0.9, 0.2, -20.0, 5, 0.0)]
RAYS = [(0.6, 0.8, 20.0, 3.0, 0.5, 90.0, 0.65, 10.0, 0), (-0.6, 0.8, 16.0, 4.0, 0.4, 30.0, 0.5, 5.0, 1), (-1.0, 0.0, 12.0, 2.0, 0.7, 200.0, 0.5, 5.0, 2)]
FLARE_X, FLARE_Y = 18, 9


def _literals(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"{v}::DOUBLE" for v in r) + ")" for r in rows)


def _ghost_sql(c: str, k: int) -> str:
    """SQL of a ghost's light in one channel; see ghost_light()."""
    u, v = f"(x-(ex+{k}*ca*(ex-{FLARE_X})/1000))", f"(y-(ey+{k}*ca*(ey-{FLARE_Y})/1000))"
    flat = f"(radius-list_max(list_transform(range(n), lambda l: cos(2*pi()*l/n)*{u}+sin(2*pi()*l/n)*{v})))"
    d = f"(pc*(radius-sqrt({u}*{u}+{v}*{v}))+(1-pc)*{flat})"
    r = f"(1-{d}/radius)"
    profile = f"CASE WHEN b<=0 THEN pow(greatest(1-{r},0),e) WHEN {r}<b THEN c+exp(-(b-{r})*e)*(1-c) ELSE 1-({r}-b)/(1-b) END"
    return f"65535*sum(CASE WHEN {flat}>0 AND {d}>0 AND {r} BETWEEN 0 AND 1 THEN i{c}*least({d},1)*{profile} END) AS add_{c}"


def _lit_sql(d: str) -> str:
    new = ", ".join(f"CASE WHEN coalesce(add_r, add_g, add_b) IS NOT NULL THEN CAST(least(65534,floor({c}+coalesce(add_{c},0))) AS INT) ELSE {c} END AS {c}" for c in "rgb")
    return f"SELECT image_id, x, y, {new}, a FROM px LEFT JOIN {d} USING (image_id, x, y)"


@query(f"""{BASE}, g AS (SELECT * FROM (VALUES {_literals(GHOSTS)}) t(ex,ey,radius,ir,ig,ib,e,b,c,ca,n,pc)),
l AS (SELECT image_id, x, y, {", ".join(_ghost_sql(c, k) for c, k in zip("rgb", (1, 0, -1)))} FROM (SELECT image_id, x, y FROM px), g WHERE abs(x-ex)<=radius*sqrt(2)+2+ca AND x>=floor(ex-radius*sqrt(2)-1-ca) AND x<=floor(ex+radius*sqrt(2)+1+ca)
  AND y>=floor(ey-radius*sqrt(2)-1-ca) AND y<=floor(ey+radius*sqrt(2)+1+ca) GROUP BY 1, 2, 3) {_lit_sql('l')}""")
def overlay_ghosts(s):
    rows = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"{v}D" for v in r) + ")" for r in GHOSTS)
    return overlays.overlay_ghosts(s.px, _elements(s, rows, "x, y, radius, i_r, i_g, i_b, e, b, c, max_ca, n_leaves, pcircle").withColumns({"sun_x": F.lit(FLARE_X), "sun_y": F.lit(FLARE_Y)}))


_RAY = S.rgb("hue", "sat", "val")


@query(f"""{BASE}, g AS (SELECT * FROM (VALUES {_literals(RAYS)}) t(ra,rb,radius,width,intensity,hue_start,fa,fb,grp)),
q AS (SELECT image_id, x, y, g.*, x-{FLARE_X} AS rx, y-{FLARE_Y} AS ry, ra*(x-{FLARE_X})+rb*(y-{FLARE_Y}) AS off, radius*((1-ra)/4+0.5) AS lng FROM (SELECT image_id, x, y FROM px), g),
w AS (SELECT *, sqrt(greatest(rx*rx+ry*ry-off*off,0)) AS along FROM q), p AS (SELECT *, along/lng AS pr, (0.25+0.75*along/lng)*width AS h0 FROM w WHERE rb*rx-ra*ry>=0 AND along/lng<=1),
h AS (SELECT *, CASE WHEN lng-along<=h0 THEN h0*sqrt(1-pow(1-(lng-along)/h0,2)) ELSE h0 END AS half FROM p),
k AS (SELECT *, half-abs(off) AS ins, hue_start+CASE WHEN grp%2=1 THEN 360 ELSE 720 END*pr AS hue0, 1/(1+exp(-(pr-0.4)*10)) AS sat FROM h WHERE half-abs(off)>0),
v AS (SELECT *, CASE WHEN hue0>=720 THEN hue0-720 WHEN hue0>=360 THEN hue0-360 ELSE hue0 END AS hue, intensity*exp(-6*pr)*least(ins,1)/(1+exp((1-ins/half-fa)*fb)) AS val FROM k),
l AS (SELECT image_id, x, y, {', '.join(f'sum({e}) AS add_{c}' for c, e in _RAY.items())} FROM v GROUP BY 1, 2, 3) {_lit_sql('l')}""")
def overlay_rays(s):
    rows = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"{v}D" for v in r) + ")" for r in RAYS)
    return overlays.overlay_rays(s.px, _elements(s, rows, "ra, rb, radius, width, intensity, hue_start, falloff_a, falloff_b, grp").withColumns({"sun_x": F.lit(FLARE_X), "sun_y": F.lit(FLARE_Y)}))


_SEEN = "FROM col WHERE column_mask=0"


@query(f"""{MODEL}, bx AS (SELECT image_id, greatest(0,least({W - 1},x+i)) AS x, greatest(0,least({H - 1},y+j)) AS y, CAST(floor(least(1.0,abs(greatest(r,g,b)/65535.0::DOUBLE-v_hat)*10)*65535+0.5) AS INT) AS grey
  FROM pred, (VALUES (-1),(0),(1)) u(i), (VALUES (-1),(0),(1)) w(j) WHERE x%9=4 AND y%7=3),
ed AS (SELECT image_id, l AS x0, r AS x1, t-1 AS y0, t AS y1 FROM rects UNION ALL SELECT image_id, l, r, b, b+1 FROM rects UNION ALL SELECT image_id, l-1, l, t, b FROM rects UNION ALL SELECT image_id, r, r+1, t, b FROM rects),
every AS (SELECT image_id, x, least(24,manual_eos+2) AS y, 65535 AS r, 0 AS g, 0 AS b, 1 AS layer FROM col WHERE manual_eos IS NOT NULL
UNION ALL SELECT image_id, x, y, 32767, 32767, 65535, 0 FROM px JOIN col USING (image_id, x) WHERE y BETWEEN raw_sos AND eos
UNION ALL SELECT image_id, x, sos-1, 65535, 0, 0, 2 {_SEEN} UNION ALL SELECT image_id, x, raw_sos-1, 32767, 32767, 0, 3 {_SEEN}
UNION ALL SELECT image_id, x, CAST(sos+floor((eos-sos)*0.5+0.5) AS INT)+k, 32767, 32767, 32767, 4 FROM col, (VALUES (0),(1)) t(k) WHERE column_mask=0
UNION ALL SELECT image_id, x, least(24,eos+2+k), 0, 65535, 0, 5 FROM col, (VALUES (0),(1)) t(k) WHERE column_mask=0
UNION ALL SELECT image_id, x, y, max(grey), max(grey), max(grey), 6 FROM bx GROUP BY 1, 2, 3
UNION ALL SELECT image_id, px.x, px.y, 65535, 32767, 32767, 7 FROM px JOIN ed USING (image_id) WHERE px.x BETWEEN x0 AND x1 AND px.y BETWEEN y0 AND y1)
SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(max_by(r, layer) AS INT) AS r, CAST(max_by(g, layer) AS INT) AS g, CAST(max_by(b, layer) AS INT) AS b, CAST(max(layer) AS INT) AS layer FROM every WHERE y BETWEEN 0 AND 24 GROUP BY 1, 2, 3""")
def audit_marks(s):
    smp = s.predicted.filter("x % 9 = 4 AND y % 7 = 3").select("image_id", "x", "y", (F.greatest("r", "g", "b") / 65535.0 - F.col("v_hat")).alias("v_error"))
    classes = masks.tag_sky(s.px.select("image_id", "x", "y").withColumn("pixel_class", F.lit(4)), s.col)
    return overlays.audit_marks(s.col, smp, s.rects, W, H, classes=classes)


_GRAY = "gp AS (SELECT *, (r+g+b)/3.0::DOUBLE/65535.0::DOUBLE AS gray FROM px)"


def _bilateral(dx, dy):
    w = "exp(-(pow(q.x-p.x,2)+pow(q.y-p.y,2))/8-pow(q.gray-p.gray,2)/0.02)"
    return f"{BASE}, {_GRAY} SELECT p.image_id, p.x, p.y, round(sum({w}*q.gray)/sum({w}), 6) AS smooth FROM gp p JOIN gp q ON p.image_id=q.image_id AND q.x BETWEEN p.x-{dx} AND p.x+{dx} AND q.y BETWEEN p.y-{dy} AND p.y+{dy} GROUP BY 1, 2, 3"


@query(_bilateral(2, 2))
def bilateral_gray(s):
    return rounded(repairs.bilateral_gray(s.px), 6, "smooth")


@query(_bilateral(5, 0))
def bilateral_gray_rows(s):
    return rounded(repairs.bilateral_gray(s.px, 5, 0), 6, "smooth")


_TWO = ", ".join(f"avg({c}/65535.0::DOUBLE) OVER u AS {c}1, avg({c}/65535.0::DOUBLE) OVER d AS {c}2, stddev_samp({c}/65535.0::DOUBLE) OVER u AS {c}3, stddev_samp({c}/65535.0::DOUBLE) OVER d AS {c}4" for c in "rgb")


@query(f"""{BASE}, st AS (SELECT image_id, x, y, {_TWO} FROM px WINDOW u AS ({YW} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), d AS ({YW} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))
SELECT image_id, x, y, {", ".join(f"round(({c}1-{c}2)/nullif(sqrt({c}3*{c}3/10+{c}4*{c}4/5),0), 4) AS t_{c}" for c in "rgb")}, round({"+".join(f"abs({c}1-{c}2)" for c in "rgb")}, 6) AS mean_diff,
round(sqrt({"+".join(f"pow(({c}2-{c}1)/nullif({c}1,0),2)" for c in "rgb")}), 6) AS color_dist, round(({"+".join(f"abs(coalesce({c}4/nullif({c}2,0),0)-coalesce({c}3/nullif({c}1,0),0))" for c in "rgb")})/3, 6) AS cv_diff FROM st WHERE y BETWEEN 9 AND 19""")
def two_band_profile(s):
    d = rounded(repairs.two_band_profile(s.px), 6, "mean_diff", "color_dist", "cv_diff")
    return rounded(d, 4, "t_r", "t_g", "t_b")


@query(None)
def two_band_probability(s):
    return repairs.two_band_probability(s.px)


@query(f"""{BASE}, {_GRAY}, near AS (SELECT a.image_id, a.x, a.eos, b.x AS nx, b.eos AS n_eos FROM col a JOIN col b ON a.image_id=b.image_id AND abs(a.x-b.x)=1 AND b.eos-a.eos>2),
st AS (SELECT e.image_id, e.x, nx, e.eos, n_eos, (p.y-e.eos-1)//3 AS k, avg(p.gray-q.gray) AS m, stddev_samp(p.gray-q.gray) AS s, count(*) AS n FROM near e JOIN gp p ON p.image_id=e.image_id AND p.x=e.x AND p.y>e.eos AND p.y<=n_eos JOIN gp q ON q.image_id=e.image_id AND q.x=nx AND q.y=p.y GROUP BY ALL),
mv AS (SELECT image_id, x, nx, coalesce(min(eos+k*3) FILTER (WHERE abs(m)*sqrt(n)>1.833*s AND abs(m)>0.02), any_value(n_eos)) AS e FROM st GROUP BY 1, 2, 3)
SELECT image_id, x, CAST(coalesce(e, eos) AS INT) AS paired_eos FROM col LEFT JOIN (SELECT image_id, x, max(e) AS e FROM mv GROUP BY 1, 2) USING (image_id, x)""")
def paired_t_end(s):
    return repairs.paired_t_end(s.px, s.col, gap=2, block=3)


@query(f"""{MODEL}, {S.PROB}, m AS (SELECT image_id, x, y, a, prob_sky, {", ".join(f"avg({c}) FILTER (WHERE a>=32767) OVER w AS m_{c}" for c in "rgb")} FROM prob WINDOW w AS ({YW} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)),
e AS (SELECT *, CASE WHEN a>=32767 AND prob_sky>0.5 THEN {{'x': x, 'r': m_r, 'g': m_g, 'b': m_b}} END AS e FROM m),
n AS (SELECT *, last_value(e IGNORE NULLS) OVER ({RW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(e IGNORE NULLS) OVER ({RW} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM e)
SELECT image_id, x, y, {", ".join(f"CAST(floor(p.{c}*(1-(x-p.x)/(q.x-p.x)::DOUBLE)+q.{c}*((x-p.x)/(q.x-p.x)::DOUBLE)) AS INT) AS {c}" for c in "rgb")} FROM n WHERE a<16384 AND p IS NOT NULL AND q IS NOT NULL""")
def interpolate_transparent(s):
    return repairs.interpolate_transparent(fill.sky_probability(s.predicted, s.col), confident=0.5)


def _rms(m) -> str:
    return f"sqrt(({'+'.join(f'pow(list_dot_product(w, {row.tolist()}::DOUBLE[]),2)' for row in m)})/{len(m)})"


_RESIDUALS, _ERRORS = repairs.forecast_weights(H)


@query(f"""{BASE}, {_GRAY}, w AS (SELECT image_id, x, y, list(gray) OVER ({YW} ROWS BETWEEN 10 PRECEDING AND 1 FOLLOWING) AS w FROM gp),
e AS (SELECT image_id, x, y, {_rms(_RESIDUALS)} AS rmse, {_rms(_ERRORS)} AS rmse_next FROM w WHERE len(w)=12)
SELECT image_id, x, y, round(rmse, 7) AS rmse, round(rmse_next, 6) AS rmse_next, round(rmse_next/nullif(rmse,0), 3) AS ratio FROM e""")
def forecast_ratio(s):
    return repairs.forecast_ratio(s.px, H).withColumns({"rmse": F.round("rmse", 7), "rmse_next": F.round("rmse_next", 6), "ratio": F.round("ratio", 3)})


#: How far a channel may be from the mean around it: the view's sky changes by some hundredths from row to row.
STEEP = 0.3


@query(None)
def local_color_fit(s):
    places = s.px.filter("x % 5 = 0 AND y % 5 = 0").selectExpr("image_id", "x AS cx", "y AS cy")
    return rounded(local_fit.local_color_fit(s.px, s.col, places, 3, limit=STEEP), 3, "r", "g", "b")


@query(None)
def fill_to_min_start(s):
    return repairs.fill_to_min_start(s.px, s.col, limit=STEEP)


@query(None)
def repair_outlier_pixels(s):
    """The view's pixels, one in 23 of them with a wrong colour."""
    s.px = s.px.withColumn("r", F.expr("CASE WHEN (x * 5 + y * 7) % 23 = 0 AND a > 0 THEN 60000 ELSE r END"))
    return repairs.repair_outlier_pixels(s.px, s.col, width=2, limit=STEEP)


@query(None)
def clean_vertical_edges(s):
    """The view's pixels with one row too red, and starts of sky down to row 8."""
    px = s.px.withColumn("r", F.expr("CASE WHEN y = 5 AND a > 0 THEN r * 2 ELSE r END"))
    return repairs.clean_vertical_edges(px, s.col.withColumn("sos", F.expr("CAST(x % 9 AS INT)")), limit=STEEP)


@query(None)
def fill_side_edges(s):
    """The view's pixels, transparent in the outer columns of every third row."""
    px = s.px.withColumn("a", F.expr("CASE WHEN (x < 2 OR x > 37) AND y % 3 = 1 THEN 0 ELSE a END"))
    return repairs.fill_side_edges(px, s.col, share=8, limit=STEEP)


@query(None)
def fill_overhang_holes(s):
    """The view's pixels, with a start of sky that steps down in every eighth column and holes beneath the higher one."""
    col = s.col.withColumn("sos", F.expr("CAST(2 + CASE WHEN x % 8 >= 5 THEN 7 ELSE 0 END AS INT)"))
    px = s.px.withColumn("a", F.expr("CASE WHEN y < 2 OR (x % 8 >= 5 AND y < 9) OR (x % 8 IN (3, 4) AND y BETWEEN 4 AND 7) THEN 0 WHEN a > 0 THEN 65535 ELSE 0 END"))
    return repairs.fill_overhang_holes(px, col, width=6, limit=STEEP)


@query(f"{_BANDS}, e AS (SELECT image_id, x, coalesce(min(y) FILTER (WHERE y>=6 AND (round(dh, 6)>360 OR round(ds, 6)>0.3 OR round(dv, 6)>0.015)), 24) AS eos FROM bands GROUP BY 1, 2), f AS (SELECT image_id, x, coalesce(min(y) FILTER (WHERE greatest(r,g,b)>3840), 0) AS sos FROM px GROUP BY 1, 2) SELECT image_id, min(sos) AS min_sos, max(sos) AS max_sos, min(eos) AS min_eos, max(eos) AS max_eos, round(1-max(eos)/24.0::DOUBLE, 6) AS lowest_py FROM e JOIN f USING (image_id, x) GROUP BY 1")
def sky_outline(s):
    """The flagship: start of sky, first failing row of every column, and the extents of every image."""
    start = columns.start_of_sky(s.px, s.masks, H).select("image_id", "x", F.col("raw_sos").alias("sos"))
    ends = columns.first_band_failure(rounded(columns.column_band_stats(s.px), 6, "dh", "ds", "dv")).select("image_id", "x", F.coalesce("end_y", F.lit(H - 1)).alias("eos"))
    return rounded(columns.sky_extent(start.join(ends, ["image_id", "x"]), H), 6, "lowest_py")


@query(f"{BASE}, h AS ({S.hsv('px')}), i AS (SELECT *, (r+g+b)/3.0::DOUBLE/65535 AS i FROM h) SELECT image_id, x, y, round(h, 4) AS h, round(CASE WHEN r=g AND g=b THEN 0 ELSE 1-least(r,g,b)/65535.0::DOUBLE/nullif(i,0) END, 6) AS s, round(i, 6) AS i FROM i")
def rgb_to_hsi(s):
    d = s.px.withColumn("hsi", color.rgb_to_hsi()).select("image_id", "x", "y", "hsi.*")
    return rounded(d, 6, "s", "i").withColumn("h", F.round("h", 4))


@query(f"{BASE} SELECT image_id, x, y, true AS close FROM px")
def hsi_round_trip(s):
    """Every channel comes back within 1."""
    d = s.px.withColumn("hsi", color.rgb_to_hsi())
    d = d.withColumn("back", color.hsi_to_rgb(F.col("hsi.h"), F.col("hsi.s"), F.col("hsi.i")))
    return d.select("image_id", "x", "y", (F.greatest(*[F.abs(F.col(f"back.{c}") - F.col(c)) for c in "rgb"]) <= 1).alias("close"))


_TRIANGLE = [(0.0, 0.0), (39.0, 4.0), (20.0, 24.0)]
_W1 = "((4-24)*(x-20)+(20-39)*(y-24))/((4-24)*(0-20)+(20-39)*(0-24))::DOUBLE"
_W2 = "((24-0)*(x-20)+(0-20)*(y-24))/((4-24)*(0-20)+(20-39)*(0-24))::DOUBLE"


@query(f"{BASE} SELECT image_id, x, y, round({_W1}, 6) AS w1, round({_W2}, 6) AS w2, round({_W1}*r+{_W2}*g+(1-{_W1}-{_W2})*b, 4) AS blend FROM px")
def barycentric_blend(s):
    corners = [(F.lit(x), F.lit(y)) for x, y in _TRIANGLE]
    w = model.barycentric_weights(F.col("x"), F.col("y"), corners)
    blend = model.barycentric_blend(F.col("x"), F.col("y"), corners, [F.col(c) for c in "rgb"])
    return s.px.select("image_id", "x", "y", F.round(w[0], 6).alias("w1"), F.round(w[1], 6).alias("w2"), F.round(blend, 4).alias("blend"))


_GLOW = "(1+{c}*(exp(-(CASE WHEN gam<radians(0.533)/2 THEN 0 ELSE gam END)/{d})-exp(-(pi()/2)/{d})))"


@query(f"{BASE}, {S.REL}, va AS (SELECT *, -px*radians({S.FOV}) AS u, asin({_L}) AS w FROM rel), q AS (SELECT *, acos(greatest(-1,least(1,sin(0.3)*cos(0.2)*sin(u)*cos(w)+sin(0.2)*sin(w)+cos(0.3)*cos(0.2)*cos(u)*cos(w)))) AS gam FROM va) SELECT image_id, x, y, round({_GLOW.format(c=6.5, d=0.3)}, 6) AS glow FROM q")
def sun_glow(s):
    a = geometry.view_angles(F.col("px"), F.col("py"), F.lit(S.FOV), F.lit(W), F.lit(H))
    gamma = geometry.angle_between(geometry.view_vector(a["aoy"], a["aox"]), geometry.view_vector(F.lit(0.3), F.lit(0.2)))
    return s.rel.select("image_id", "x", "y", F.round(geometry.sun_glow(gamma, F.lit(6.5), F.lit(0.3)), 6).alias("glow"))


_ANGLE = "acos(greatest(-1,least(1,sin(su)*cos(sw)*sin(u)*cos(w)+sin(sw)*sin(w)+cos(su)*cos(sw)*cos(u)*cos(w))))"


@query(f"""{BASE}, p AS (SELECT image_id, 2+image_id%7*0.5::DOUBLE AS c, px, py, -px*radians({S.FOV}) AS u, asin({_L}) AS w, -0.1*radians({S.FOV}) AS su, asin((0.8-0.5)*sin(radians({S.FOV})*{H}/{W}/2)*2) AS sw FROM img, (VALUES (-0.5),(0.0),(0.5)) a(px), (VALUES (0.0),(0.5),(1.0)) b(py)),
q AS (SELECT *, {_ANGLE} AS gam FROM p) SELECT image_id, round(max(1+2*(1-exp(-(pi()/2)/0.3))), 6) AS glow_max, round(min({_GLOW.format(c='c', d=0.3)}), 6) AS glow_min FROM q GROUP BY 1""")
def glow_range(s):
    images = s.sized.withColumns({"fov": F.lit(S.FOV), "sun_px": F.lit(0.1), "sun_py": F.lit(0.8), "c": 2 + F.col("image_id") % 7 * 0.5, "d": F.lit(0.3)})
    return rounded(geometry.glow_range(images), 6, "glow_max", "glow_min")


_SCAN = f"""{_BANDS}, sy AS (SELECT image_id, x, max(raw_sos) FILTER (WHERE column_mask=0) OVER ({XW} ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING)+10 AS scan_y FROM col),
rb AS (SELECT image_id, x, y, round(dh, 9) AS dh, round(ds, 9) AS ds, round(dv, 9) AS dv FROM bands),
st AS (SELECT rb.*, y>=scan_y AND (dh>360 OR ds>0.3 OR dv>0.015) AS bad, coalesce(lead(dv) OVER ({YW})>dv, false) AS grows FROM rb JOIN sy USING (image_id, x)),
bg AS (SELECT *, max(CAST(bad AS INT)) OVER ({YW} ROWS UNBOUNDED PRECEDING) AS begun FROM st), fo AS (SELECT image_id, x, min(y) FILTER (WHERE begun=1 AND NOT grows) AS found FROM bg GROUP BY 1, 2),
ro AS (SELECT col.image_id, col.x, column_mask, found, eos AS old, coalesce(found, eos) AS eos FROM col LEFT JOIN fo USING (image_id, x)),
hs AS (SELECT image_id, x, y, {'+'.join(f'abs(avg({c}) OVER a - avg({c}) OVER b)' for c in 'rgb')} AS step FROM px WINDOW a AS ({YW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), b AS ({YW} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
hi AS (SELECT image_id, x, coalesce(min(y) FILTER (WHERE step>4000), min(eos))+2 AS hires FROM hs JOIN ro USING (image_id, x) WHERE y BETWEEN eos-10 AND eos+9 GROUP BY 1, 2)"""


@query(f"{_SCAN} SELECT image_id, x, CAST(CASE WHEN found IS NULL OR column_mask=1 THEN old ELSE coalesce(hires, eos) END AS INT) AS eos FROM ro LEFT JOIN hi USING (image_id, x)")
def end_of_sky_scan(s):
    return columns.end_of_sky_scan(s.px, s.col)


@query(None)
def find_end_of_sky(s):
    """The default chain: regression detector, slivers, slope, lowest height."""
    return columns.find_end_of_sky(fits.end_of_sky_regression(s.px, s.col, H), s.col, W, H)


@query(f"""{BASE}, c AS (SELECT *, sos + CASE WHEN x % 13 = 6 THEN 9 ELSE 0 END AS s FROM col),
l AS (SELECT *, CASE WHEN greatest(column_mask, {', '.join(f'coalesce(lag(column_mask, {k}) OVER ({XW}), 1)' for k in (1, 2, 3))}) = 1 OR x > 38 THEN 1 ELSE 0 END AS cut FROM c),
r AS (SELECT *, sum(cut) OVER (PARTITION BY image_id, x % 3 ORDER BY x) AS run FROM l)
SELECT a.image_id, a.x, CAST(min(b.s + abs(a.x - b.x) / 3) AS INT) AS level_sos FROM r a JOIN r b ON a.image_id=b.image_id AND a.x%3=b.x%3 AND a.run=b.run GROUP BY 1, 2""")
def level_start(s):
    col = s.col.withColumn("sos", F.expr("cast(sos + CASE WHEN x % 13 = 6 THEN 9 ELSE 0 END AS int)"))
    return repairs.level_start(col, W).select("image_id", "x", "level_sos")


@query(None)
def fill_levelled_start(s):
    col = s.col.withColumn("sos", F.expr("cast(sos + CASE WHEN x % 13 = 6 THEN 9 ELSE 0 END AS int)"))
    return repairs.fill_levelled_start(s.px, repairs.level_start(col, W), limit=STEEP)


@query(None)
def fill_vertical_gaps(s):
    """The view's pixels with a hole in every seventh column."""
    px = s.px.withColumn("a", F.expr("CASE WHEN y BETWEEN 8 AND 11 AND x % 7 = 2 THEN 0 WHEN a > 0 THEN 65535 ELSE a END"))
    return repairs.fill_vertical_gaps(px, s.col, H, width=8, limit=STEEP)


def _flagged(s):
    return saved(sampling.flag_outliers(sampling.close_neighbors(s.samples())), "samples")


def _cameras(s):
    return s.sized.withColumns({"fov": F.lit(S.FOV), "sun_px": F.lit(0.2), "sun_py": F.lit(0.7)})


@query(None)
def section_curves(s):
    d = sky_model.section_curves(_flagged(s))
    return d.select("image_id", "section", "level", "n", *[F.transform(f"coefs_{c}", lambda x: F.round(x, 4)).alias(f"coefs_{c}") for c in "vs"])


_AT = "(0.8+0.1*px+0.02*ln(mp)+0.05*px*px+0.1*mp)"


@query(f"""{SAMPLES}, c AS (SELECT image_id, least(3,CAST(floor((px+0.5)*4) AS INT)) AS section, count(*) AS n, sum(py) AS spy, avg(v) AS v, avg(s) AS s FROM smp WHERE px<0.5 GROUP BY 1, 2),
m AS (SELECT image_id, sum(spy)/sum(n) AS mp FROM c GROUP BY 1), k AS (SELECT CAST(unnest(generate_series(0,100)) AS INT) AS k),
t AS (SELECT image_id, mp, k, k/100.0::DOUBLE-0.5 AS px, CASE WHEN k<=12 THEN 0 WHEN k>=88 THEN 3 ELSE k/25.0::DOUBLE-0.5 END::DOUBLE AS t FROM m, k),
b AS (SELECT t.image_id, k, px, sum((1-abs(t-section))*(v+{_AT}))/sum(1-abs(t-section)) AS v, sum((1-abs(t-section))*(s+{_AT}))/sum(1-abs(t-section)) AS s FROM t JOIN c ON t.image_id=c.image_id AND abs(t-section)<1 GROUP BY 1, 2, 3)
SELECT image_id, k, round(px, 6) AS px, round((0.2*avg(v) OVER (PARTITION BY image_id)+0.8*v)/avg(v) OVER (PARTITION BY image_id), 6) AS base_v, round(s, 6) AS base_s FROM b""")
def base_knots(s):
    """Knots of plain curves: a section's mean and the same slopes for all."""
    d = s.samples().filter("px < 0.5").groupBy("image_id", F.floor((F.col("px") + 0.5) * 4).cast("int").alias("section"))
    d = d.agg(F.count("*").alias("n"), F.sum("py").alias("sum_py"), *[F.array(F.avg(c) + 0.8, *map(F.lit, (0.1, 0.02, 0.05, 0.1))).alias(f"coefs_{c}") for c in "vs"])
    return rounded(sky_model.base_knots(d, 0.2), 6, "px", "base_v", "base_s")


@query(None)
def best_horizon(s):
    d = _flagged(s)
    d = sky_model.with_knots(d, sky_model.base_knots(sky_model.section_curves(d))).withColumn("fov_y", F.radians(F.lit(S.FOV)) * H / W)
    return sky_model.best_horizon(sky_model.horizon_scores(d)).select("image_id", F.round("slope", 2).alias("slope"), F.round("horizon_py", 4).alias("horizon_py"), F.round("sse", 4).alias("sse"))


@query(None)
def fit_sky_model(s):
    return sky_model.fit_sky_model(_flagged(s), _cameras(s)).select("image_id", "h_coefs", "s_coefs", "v_coefs", "horizon_py", "slope", "sse")


@query(None)
def fit_sky_luminance(s):
    return sky_model.fit_sky_luminance(_flagged(s), _cameras(s))


@query(None)
def fit_sky_luminance_on_sphere(s):
    """With a bent and tilted horizon, and angles between directions of view."""
    bent = _cameras(s).withColumns({"curvature": F.lit(S.CURVATURE), "slope": F.lit(S.SLOPE)})
    return sky_model.fit_sky_luminance(_flagged(s), bent, sphere=True)


def _lit_by_sun():
    a, b, c, d, e = map(F.lit, sampling.SKY_SETS[11][2:])
    fov = F.radians(F.lit(S.FOV))
    return geometry.cie_luminance(F.col("px"), F.col("py"), F.col("py"), F.col("sx"), F.col("sy"), F.lit(S.HORIZON), fov, fov * H / W, a, b, c, d, e)


@query(None)
def refine_sky_params(s):
    start = s.images.withColumns({"sx": F.lit(0.0), "sy": F.lit(0.5)})
    return sky_model.refine_sky_params(saved(s.samples(), "samples"), start, {"sx": (0.4, -1.5, 1.5), "sy": (0.4, 0.0, 1.5)}, _lit_by_sun())


@query(None)
def adaptive_end(s):
    return sky_model.adaptive_end(s.px, s.col, H, above=3)


@query(None)
def run_fill(s):
    """The whole job on every image."""
    return whole_fill.run_fill(s.px, _cameras(s), s.masks, whole_fill.FillOptions(samples=400, repair_limit=STEEP))


@query(None)
def run_replacement(s):
    """The whole job on every image, with a sun, all filters and dither, the sky replaced."""
    cameras = s.sized.withColumns({"fov": F.lit(S.FOV), "sun_px": F.lit(SUN_PX), "sun_py": F.lit(SUN_PY), "cc": F.lit(SUN_C), "cd": F.lit(SUN_D), "cf": F.lit(SUN_F), "cg": F.lit(SUN_G), "sun_lum": F.lit(SUN_LUM), "sat_depth": F.lit(SAT_DEPTH)})
    options = whole_fill.FillOptions(samples=400, repair_limit=STEEP, replace=True, fade=True, light="sun", uniform=1, transparent=True, smooth_rows=True, box=True, seed=3)
    return whole_fill.run_fill(s.px, cameras, s.masks, options)

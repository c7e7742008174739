"""SQL twins of the registered raster queries, for DuckDB; every text starts from the events table."""

from __future__ import annotations

WIDTH, HEIGHT = 40, 25
PX = """px AS (
SELECT image_id, x, y,
  CAST(CASE WHEN a0=0 THEN 0 WHEN y<=eos0 THEN 12000+900*y+20*x+noise ELSE  9000+37*noise END AS INT) AS r,
  CAST(CASE WHEN a0=0 THEN 0 WHEN y<=eos0 THEN 24000+700*y+15*x+noise ELSE 12000+29*noise END AS INT) AS g,
  CAST(CASE WHEN a0=0 THEN 0 WHEN y<=eos0 THEN 46000+400*y+10*x+noise ELSE  7000+17*noise END AS INT) AS b,
  a0 AS a
FROM (SELECT *, CASE WHEN y < sos0 THEN 0 WHEN event_id % 97 = 0 THEN 40000 ELSE 65535 END AS a0
  FROM (SELECT *, 1+(x*7+image_id*3)%4 AS sos0, 15+(x*5+image_id)%6 AS eos0
    FROM (SELECT event_id, CAST(floor(event_id/1000) AS INT) AS image_id, CAST((event_id%1000)%40 AS INT) AS x,
        CAST(floor((event_id%1000)/40) AS INT) AS y, CAST(floor(value*100) AS INT)%512 AS noise FROM events) e0) e1) e2)"""
COL = """col AS (SELECT image_id, x, 1+(x*7+image_id*3)%4 AS raw_sos, 1+(x*7+image_id*3)%4 AS sos, 15+(x*5+image_id)%6 AS eos,
  CASE WHEN x%7=3 THEN 14 END AS manual_eos, CASE WHEN x BETWEEN 5 AND 7 THEN 1 ELSE 0 END AS column_mask FROM (SELECT DISTINCT image_id, x FROM px))"""
IMG = "img AS (SELECT DISTINCT image_id FROM px)"
MASK_ROWS = "('column',5,7),('sample',20,24),('repair',30,33),('nonsky',0,3)"
RECT_ROWS = "(10,14,2,8),(12,18,6,9)"
VERTEX_ROWS = "(0,0,12),(1,9,15),(2,-1,-1),(3,20,16),(4,39,13)"
MASKS = f"masks AS (SELECT image_id, kind, l, r FROM img, (VALUES {MASK_ROWS}) t(kind,l,r))"
RECTS = f"rects AS (SELECT image_id, l, r, t, b FROM img, (VALUES {RECT_ROWS}) t(l,r,t,b))"


def hsv(d: str, r="r", g="g", b="b") -> str:
    """SELECT * and h, s, v over d."""
    return f"""SELECT * EXCLUDE (mx, mn), CASE WHEN mx=mn THEN 0.0 ELSE (CASE WHEN mx={r} THEN 60*({g}-{b})/(mx-mn)::DOUBLE + CASE WHEN {g}<{b} THEN 360 ELSE 0 END
    WHEN mx={g} THEN 60*({b}-{r})/(mx-mn)::DOUBLE+120 ELSE 60*({r}-{g})/(mx-mn)::DOUBLE+240 END) END AS h,
    CASE WHEN mx=0 THEN 0.0 ELSE (mx-mn)/mx::DOUBLE END AS s, mx/65535.0::DOUBLE AS v FROM (SELECT *, greatest({r},{g},{b}) AS mx, least({r},{g},{b}) AS mn FROM {d})"""


def rgb(h: str, s: str, v: str) -> dict[str, str]:
    """Integer channels of a colour."""
    k, f = f"CAST(floor({h}/60) AS INT)%6", f"({h}/60-CAST(floor({h}/60) AS INT)%6)"
    p, q, t = f"({v})*(1-({s}))", f"({v})*(1-({s})*{f})", f"({v})*(1-({s})*(1-{f}))"
    case = lambda *six: "CAST(floor((CASE " + k + " " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(six)) + " END)*65535) AS INT)"
    return {"r": case(v, q, p, p, t, v), "g": case(t, v, v, q, p, p), "b": case(p, p, t, v, v, q)}


#: The one literal row of model coefficients.
H, S, V = ([200, 20, 8, 0.5, 0.01], [205, 18, 6, 0.45, 0.02]), ([0.2, 1.0, 1.5, 0.05, 0.1], [0.25, 1.1, 1.4, -0.03, 0.12]), [0.1, 0.7, 0.9, 0.2]
HORIZON, CURVATURE, SLOPE, FOV = 0.1, 0.05, 0.02, 120.0


def _hue(c):
    return f"({c[1]}*(hc-({c[3]}+{c[4]}*px))*{c[2]}/(1+abs(hc-({c[3]}+{c[4]}*px))*{c[2]})+{c[0]})"


def _sat(c):
    z = f"greatest(hc-({c[0]}+{c[3]}*px),0)"
    return f"({c[4]}+{z}/({c[1]}+{c[2]}*{z}))"


def _blend(f, c):
    return f"((0.5-px)*{f(c[0])}+(px+0.5)*{f(c[1])})"


_K = "least(floor((px+0.5)*100),99)"
_BASE = f"((1-((px+0.5)*100-{_K}))*(0.8+0.002*{_K})+((px+0.5)*100-{_K})*(0.8+0.002*({_K}+1)))"
REL = f"rel AS (SELECT *, x/{WIDTH - 1}.0::DOUBLE-0.5 AS px, 1-y/{HEIGHT - 1}.0::DOUBLE AS py FROM px)"
HC = f"hcs AS (SELECT *, py-(1-sqrt(greatest(1-(1-pow(1-{CURVATURE},2))*px*px*4,0)))+{SLOPE}*px AS hc FROM rel)"
HATS = f"""hats AS (SELECT * EXCLUDE (hc, base), greatest(0,least(359.99,{_blend(_hue, H)}))::DOUBLE AS h_hat, greatest(0,least(1,{_blend(_sat, S)}))::DOUBLE AS s_hat,
  greatest(0,least(1,base*{V[1]}+{V[0]}*(exp(cos({V[2]}*((hc-{HORIZON}-{V[3]}*base)*radians({FOV})*{HEIGHT}/{WIDTH})))/exp(1)-exp(-2))*1.156517642))::DOUBLE AS v_hat
  FROM (SELECT *, {_BASE} AS base FROM hcs))"""
PRED = "pred AS (SELECT *, " + ", ".join(f"{x} AS {c}_hat" for c, x in rgb("h_hat", "s_hat", "v_hat").items()) + " FROM hats)"
PROB = f"""prob AS (SELECT * EXCLUDE (prob0, s), CASE WHEN y<sos THEN 1.0 ELSE prob0 END AS prob_sky,
  CASE WHEN y<sos THEN 1.0 ELSE greatest(0,least(1,CASE WHEN s<s_hat THEN 1/(1+exp(-(prob0-0.9)*200))*coalesce(CASE WHEN i>i_hat THEN i_hat/nullif(i,0) ELSE i/nullif(i_hat,0) END,0)*s/s_hat ELSE 1/(1+exp(-(prob0-0.9)*200)) END)) END AS p_hat
  FROM (SELECT *, (r+g+b)/3.0::DOUBLE AS i, (r_hat+g_hat+b_hat)/3.0::DOUBLE AS i_hat,
    1-coalesce((r_hat*(abs(r_hat-r)/65535.0::DOUBLE)+g_hat*(abs(g_hat-g)/65535.0::DOUBLE)+b_hat*(abs(b_hat-b)/65535.0::DOUBLE))/nullif(r_hat+g_hat+b_hat,0),0) AS prob0
    FROM ({hsv('pred JOIN col USING (image_id, x)')})))"""
BASE = f"WITH {PX}, {COL}, {IMG}, {MASKS}, {RECTS}"
MODEL = f"{BASE}, {REL}, {HC}, {HATS}, {PRED}"
YW = "PARTITION BY image_id, x ORDER BY y"
XW = "PARTITION BY image_id ORDER BY x"
RW = "PARTITION BY image_id, y ORDER BY x"

"""Queries and oracles of point matching, sky geometry, spectra and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as h
from ..operators import match as m
from ..operators import sky
from ..operators import spectral as sp
from ..operators.mosaic import apply_affine
from .fixtures import (F1C, F3, F3_MOVING, F4_CATALOG, F4_PANELS, F7, dbl, f1c, f3, f3_moving, f4_catalog, f4_panels, f7, rounded, scaled, sr, table)

TOL = 2.0


def shifted(s, sf):
    """Moving stars put back by the known shift, so that nearest matching has true pairs."""
    mv = f3_moving(s, sf)
    t = mv.select("frame_id").distinct().select(
        "frame_id", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"),
        (F.col("frame_id") * 3.0 + 0.3).alias("dx"), (F.col("frame_id") * -2.0).alias("dy"))
    return apply_affine(mv, t)


SHIFTED = f"SELECT * REPLACE (x + 3*frame_id + 0.3 AS x, y - 2*frame_id AS y) FROM ({F3_MOVING})"

C5 = f"""WITH r AS ({F3}), m AS ({F3_MOVING}),
  p AS (SELECT r.frame_id, m.star_id AS mid, r.x - m.x AS dx, r.y - m.y AS dy FROM r JOIN m USING (frame_id)),
  b AS (SELECT *, CAST(sign(dx)*floor(abs(dx)/2 + 0.5) AS BIGINT) AS bx, CAST(sign(dy)*floor(abs(dy)/2 + 0.5) AS BIGINT) AS by_ FROM p),
  v AS (SELECT frame_id, bx, by_ FROM (SELECT frame_id, bx, by_, row_number() OVER (PARTITION BY frame_id ORDER BY count(*) DESC, bx, by_) AS k FROM b GROUP BY frame_id, bx, by_) WHERE k = 1),
  c AS (SELECT frame_id, list_sort(list(dx))[CAST(count(*)//2 AS BIGINT)+1] AS mx, list_sort(list(dy))[CAST(count(*)//2 AS BIGINT)+1] AS my FROM b JOIN v USING (frame_id, bx, by_) GROUP BY 1),
  i AS (SELECT p.*, row_number() OVER (PARTITION BY frame_id ORDER BY dx, dy, mid) AS k, count(*) OVER (PARTITION BY frame_id) AS n FROM p JOIN c USING (frame_id) WHERE (dx-mx)*(dx-mx) + (dy-my)*(dy-my) <= 4),
  t AS (SELECT frame_id, count(DISTINCT mid) AS matches FROM i GROUP BY 1),
  z AS (SELECT frame_id, least((SELECT count(*) FROM r WHERE r.frame_id = t.frame_id), (SELECT count(*) FROM m WHERE m.frame_id = t.frame_id)) AS n FROM t)
  SELECT frame_id, {sr('dx')}, {sr('dy')}, matches, {sr('matches/z.n', 'inlier_ratio')} FROM i JOIN t USING (frame_id) JOIN z USING (frame_id) WHERE k = i.n//2 + 1"""


def desc_sql(name: str, src: str) -> str:
    return f"""{name}k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, star_id) AS rk FROM {src}),
  {name}t AS (SELECT {name}k.* FROM {name}k JOIN lim USING (frame_id) WHERE rk <= n),
  {name}d AS (SELECT a.frame_id, a.star_id AS id, a.rk, list_sort(list(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))))[1:6] AS d FROM {name}t a JOIN {name}t b ON a.frame_id = b.frame_id AND a.star_id <> b.star_id GROUP BY ALL HAVING count(*) >= 6)"""


C6 = f"""WITH r AS ({F3}), m AS ({F3_MOVING}),
  lim AS (SELECT frame_id, least(180, a, b) AS n FROM (SELECT frame_id, count(*) AS a FROM r GROUP BY 1) JOIN (SELECT frame_id, count(*) AS b FROM m GROUP BY 1) USING (frame_id)),
  {desc_sql('r', 'r')}, {desc_sql('m', 'm')},
  s AS (SELECT rd.frame_id, rd.id AS ref_id, rd.rk AS rr, md.id AS moving_id, md.rk AS mr, list_sum(list_transform(range(1, 7), lambda i: abs(rd.d[i]/rd.d[6] - md.d[i]/md.d[6])))/6 AS score FROM rd JOIN md USING (frame_id)),
  k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, moving_id ORDER BY round(score, 12), rr) AS a, row_number() OVER (PARTITION BY frame_id, ref_id ORDER BY round(score, 12), mr) AS b FROM s)
  SELECT frame_id, ref_id, moving_id, {sr('score')} FROM k WHERE a = 1 AND b = 1 AND score <= 0.055"""

C7 = f"""WITH r AS ({F3}), m AS ({SHIFTED}), p AS (SELECT r.frame_id, r.star_id AS ref_id, m.star_id AS moving_id, (r.x-m.x)*(r.x-m.x)+(r.y-m.y)*(r.y-m.y) AS d FROM r JOIN m USING (frame_id)
    WHERE (r.x-m.x)*(r.x-m.x)+(r.y-m.y)*(r.y-m.y) <= 4),
  k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, moving_id ORDER BY d, ref_id) AS a, row_number() OVER (PARTITION BY frame_id, ref_id ORDER BY d, moving_id) AS b FROM p)
  SELECT frame_id, ref_id, moving_id, {sr('sqrt(d)', 'distance')} FROM k WHERE a = 1 AND b = 1"""

NEAR = f"""WITH s AS ({F3}) SELECT a.frame_id, a.star_id, count(*) AS neighbors FROM s a JOIN s b ON a.frame_id = b.frame_id AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 40 GROUP BY 1, 2"""

# --- sky -------------------------------------------------------------------------------------

XI = "(cos(radians(dec))*sin(radians(ra-pra))/z)"
ETA = "((cos(radians(pdec))*sin(radians(dec)) - sin(radians(pdec))*cos(radians(dec))*cos(radians(ra-pra)))/z)"
Z = "(sin(radians(pdec))*sin(radians(dec)) + cos(radians(pdec))*cos(radians(dec))*cos(radians(ra-pra)))"
SEP = "degrees(2*asin(sqrt(least(1, pow(sin(radians(pdec-dec)/2), 2) + cos(radians(pdec))*cos(radians(dec))*pow(sin(radians(pra-ra)/2), 2)))))"
RADIUS = "degrees(atan(radians(sqrt(pow(0.02*500, 2) + pow(0.02*400, 2)))))"


def sky_points(s, sf):
    """Every catalog object on the panel its id names (id modulo the number of panels)."""
    n = table(s, sf, "supplier").count()
    return f4_catalog(s, sf).withColumn("panel_id", F.col("id") % n + table(s, sf, "supplier").agg(F.min("s_suppkey").alias("m")).scalar())


POINTS = f"""SELECT *, id % (SELECT count(*) FROM supplier) + (SELECT min(s_suppkey) FROM supplier) AS panel_id FROM ({F4_CATALOG})"""


def pixels(s, sf):
    return sky_points(s, sf).select("id", "panel_id", dbl(F.col("id") % 997).alias("x"), dbl(F.col("id") % 797).alias("y"))


def with_sip(df):
    terms = F.array(F.struct(F.lit(2).alias("i"), F.lit(0).alias("j"), F.lit(1e-5).alias("a"), F.lit(-2e-5).alias("b")),
                    F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(-1e-5).alias("a"), F.lit(1e-5).alias("b")))
    return df.withColumn("sip", terms)


def sip_round_trip(s, sf):
    """Pixels to sky and back through a distorted solution."""
    wcs = with_sip(f4_panels(s, sf))
    sky_rows = sky.pixel_to_sky(pixels(s, sf), wcs).withColumnsRenamed({"x": "x0", "y": "y0"})
    return sky.sky_to_pixel(sky_rows, wcs).select("id", F.round(F.col("x") - F.col("x0"), 3).alias("dx"), F.round(F.col("y") - F.col("y0"), 3).alias("dy"))


P2S = f"""WITH p AS (SELECT id, panel_id, CAST(id % 997 AS DOUBLE) AS x, CAST(id % 797 AS DOUBLE) AS y FROM ({POINTS})),
  w AS (SELECT p.*, radians(-0.02*(x + 1 - 500.5)) AS xi, radians(0.02*(y + 1 - 400.5)) AS eta, radians(pra) AS a, radians(pdec) AS d FROM p JOIN ({F4_PANELS}) USING (panel_id)),
  v AS (SELECT *, cos(d)*cos(a) - xi*sin(a) - eta*sin(d)*cos(a) AS xx, cos(d)*sin(a) + xi*cos(a) - eta*sin(d)*sin(a) AS yy, sin(d) + eta*cos(d) AS zz FROM w)
  SELECT id, panel_id, x, y, {sr('CASE WHEN atan2(yy, xx) < 0 THEN degrees(atan2(yy, xx)) + 360 ELSE degrees(atan2(yy, xx)) END', 'ra')}, {sr('degrees(atan2(zz, sqrt(xx*xx + yy*yy)))', 'dec')} FROM v"""

CONE = f"""c AS (SELECT *, {Z} AS z, {SEP} AS sep FROM ({F4_CATALOG}) CROSS JOIN ({F4_PANELS})),
  q AS (SELECT *, degrees({XI})/-0.02 + 500.5 - 1 AS x, degrees({ETA})/0.02 + 400.5 - 1 AS y FROM c WHERE sep <= {RADIUS} + major_arcmin/120 + 0.01 AND z > 1e-8),
  f AS (SELECT * FROM q WHERE x >= -0.5 AND y >= -0.5 AND x <= 999.5 AND y <= 799.5)"""

SEGMENTS = {"deep": ["BUILDING"], "wide": ["AUTOMOBILE", "MACHINERY"]}

# --- spectra ---------------------------------------------------------------------------------

BANDS = {"B": [[(420.0, 0.0), (450.0, 0.9), (500.0, 0.1)]],
         "V": [[(480.0, 0.0), (530.0, 1.0), (600.0, 0.2)], [(470.0, 0.5), (610.0, 0.8)]],
         "H": [sp.narrowband_window(656.3, 7.0)], "far": [[(650.0, 0.5), (800.0, 0.5)]]}


def candidates(s, sf):
    i = F.col("c_custkey")
    return table(s, sf, "customer").select(i.alias("source_id"), F.when(i % 10 != 0, dbl(i % 50) * 10).alias("pmra"),
                                           F.when(i % 13 == 0, 30000.0).otherwise(dbl(i % 30) * -7).alias("pmdec"))


#: B band of D34 by Simpson's rule on 0.01 nm steps would be slow; the exact integral of the cubic pieces is used.
def flux_sql() -> str:
    """Exact integral of response x lambda x flux over [420, 500] for the single-component band "B"."""
    return f"""WITH s AS ({F7}), g AS (SELECT source_id, wavelength AS w0, lead(wavelength) OVER w AS w1, flux AS f0, lead(flux) OVER w AS f1, error AS e0, lead(error) OVER w AS e1 FROM s WINDOW w AS (PARTITION BY source_id ORDER BY wavelength)),
  k AS (SELECT *, CASE WHEN w1 <= 450 THEN 0.03 ELSE -0.016 END AS m, CASE WHEN w1 <= 450 THEN -0.03*420 ELSE 0.9 + 0.016*450 END AS c FROM g WHERE w0 >= 420 AND w1 <= 500),
  t AS (SELECT *, (f1-f0)/(w1-w0) AS fm, (e1-e0)/(w1-w0) AS em, w1-w0 AS d1, w1*w1-w0*w0 AS d2, w1*w1*w1-w0*w0*w0 AS d3, w1*w1*w1*w1-w0*w0*w0*w0 AS d4 FROM k),
  u AS (SELECT source_id, sum(m*d2/2 + c*d1) AS area, sum(m*d3/3 + c*d2/2) AS first, sum(m*d4/4 + c*d3/3) AS second,
    sum(m*fm*d4/4 + (m*(f0-fm*w0) + c*fm)*d3/3 + c*(f0-fm*w0)*d2/2) AS flux, sum(m*em*d4/4 + (m*(e0-em*w0) + c*em)*d3/3 + c*(e0-em*w0)*d2/2) AS err FROM t GROUP BY 1)
  SELECT source_id, 'B' AS band, 'integrated' AS status, {sr('flux', digits=4)}, {sr('err', 'error_bound', 4)}, {sr('first/area', 'mean_wavelength', 4)}, {sr('sqrt(second/area - (first/area)*(first/area))', 'rms_width', 4)} FROM u"""


def gains_sql(part: str) -> str:
    """D32 per frame (keys frame_id) with white (1.1, 1, 0.9) on the 1400 x 1400 field, limit .5."""
    logs = ", ".join(f"ln(predicted_{c}) - ln(predicted_g) - ln(observed_{c}) + ln(observed_g) AS g_{c}" for c in "rgb")
    q = lambda e, f, p=0.5: f"quantile_cont({e}, {p}) FILTER ({f})"
    mids = ", ".join(f"{q(f'g_{c}', 'NOT held')} AS m0{c}" for c in "rgb")
    mads = ", ".join(f"1.4826*{q(f'abs(g_{c}-m0{c})', 'NOT held')} AS d0{c}" for c in "rb")
    fm = "status = 'fit'"
    mids1 = ", ".join(f"{q(f'g_{c}', fm)} AS m1{c}" for c in "rgb")
    mads1 = ", ".join(f"1.4826*{q(f'abs(g_{c}-m1{c})', fm)} AS d1{c}" for c in "rgb")
    val = ", ".join(f"{q(f'm1{c}-g_{c}', 'held')} AS vm{c}, {q(f'abs(m1{c}-g_{c})', 'held', 0.9)} AS vp{c}" for c in "rgb")
    base = f"""WITH o AS (SELECT frame_id, star_id, x, y, (row_number() OVER (PARTITION BY frame_id ORDER BY y, x, star_id) - 1) % 5 = 4 AS held, {logs} FROM ({F3})),
      c0 AS (SELECT frame_id, {mids} FROM o GROUP BY 1), d0 AS (SELECT frame_id, {mads} FROM o JOIN c0 USING (frame_id) GROUP BY 1),
      s AS (SELECT o.*, CASE WHEN held THEN 'validation' WHEN abs(g_r-m0r) > 4.685*greatest(0.005, d0r) OR abs(g_b-m0b) > 4.685*greatest(0.005, d0b) THEN 'fit-outlier' ELSE 'fit' END AS status FROM o JOIN c0 USING (frame_id) JOIN d0 USING (frame_id)),
      c1 AS (SELECT frame_id, {mids1} FROM s GROUP BY 1), d1 AS (SELECT frame_id, {mads1} FROM s JOIN c1 USING (frame_id) GROUP BY 1),
      v AS (SELECT frame_id, count(*) FILTER (status='fit') AS training, count(*) FILTER (status='fit-outlier') AS rejected, count(*) FILTER (held) AS validation,
        count(DISTINCT CASE WHEN held THEN greatest(0, least(3, floor(y*4/1400)))*4 + greatest(0, least(3, floor(x*4/1400))) END) AS regions, {val} FROM s JOIN c1 USING (frame_id) GROUP BY 1)"""
    if part == "stars":
        return base + f" SELECT frame_id, star_id, status, {', '.join(sr(f'm1{c}-g_{c}', f'residual_{c}') for c in 'rgb')} FROM s JOIN c1 USING (frame_id)"
    gains = {"r": "exp(m1r)/1.1", "g": "exp(m1g)", "b": "exp(m1b)/0.9"}
    reason = f"""CASE WHEN training + rejected < 12 OR validation < 6 THEN 'too-few-stars' WHEN training < 12 THEN 'too-few-robust-stars'
      WHEN NOT ({' AND '.join(f'{g} BETWEEN 0.05 AND 20' for g in gains.values())}) THEN 'gain-out-of-range' WHEN regions < 4 THEN 'too-few-regions' WHEN greatest(vpr, vpb) > 0.5 THEN 'inconsistent-colors' END"""
    return base + f""" SELECT frame_id, training, rejected, validation, regions, {', '.join(sr(g, f'gain_{c}') for c, g in gains.items())}, {', '.join(sr(f'd1{c}', f'scatter_{c}') for c in 'rgb')},
      {', '.join(sr(f'vm{c}', f'validation_median_{c}') for c in 'rgb')}, {', '.join(sr(f'vp{c}', f'validation_p90_{c}') for c in 'rgb')}, {reason} AS reason, ({reason}) IS NULL AS valid
      FROM v JOIN c1 USING (frame_id) JOIN d1 USING (frame_id)"""


def d32(s, sf):
    return sp.fit_color_gains(f3(s, sf), (1.1, 1.0, 0.9), 1400, 1400, 0.5)


def d33_pairs(s, sf):
    r = f3(s, sf)
    return r.select("frame_id", "star_id", "x", "y", (F.col("x") + 5).alias("ref_x"), (F.col("y") - 3).alias("ref_y"),
                    *[F.col(f"observed_{c}").alias(f"input_{c}") for c in "rgb"], *[F.col(f"predicted_{c}").alias(f"reference_{c}") for c in "rgb"])


#: The greedy choice in plain recursion over the (y, x, id) order.
D33 = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y, x, star_id) AS k FROM ({F3})),
  g AS (SELECT frame_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, k BIGINT)[]) AS acc FROM (SELECT DISTINCT frame_id FROM o)
    UNION ALL SELECT o.frame_id, o.k, CASE WHEN len(list_filter(acc, lambda a: sqrt((a.x-o.x)*(a.x-o.x)+(a.y-o.y)*(a.y-o.y)) < 32)) > 0 THEN acc ELSE list_append(acc, {{'x': o.x, 'y': o.y, 'k': o.k}}) END
    FROM g JOIN o ON o.frame_id = g.frame_id AND o.k = g.k + 1),
  l AS (SELECT frame_id, unnest(arg_max(acc, k)) AS a FROM g GROUP BY 1), kp AS (SELECT o.*, row_number() OVER (PARTITION BY frame_id ORDER BY o.k) % 2 = 0 AS held FROM o JOIN l USING (frame_id) WHERE o.k = l.a.k),
  v AS (SELECT frame_id, held, {', '.join(f'ln(predicted_{c}/predicted_g) - ln(observed_{c}/observed_g) AS g_{c}' for c in 'rgb')} FROM kp),
  m AS (SELECT frame_id, count(*) FILTER (NOT held) AS training, count(*) FILTER (held) AS validation, {', '.join(f'quantile_cont(g_{c}, 0.5) FILTER (NOT held) AS m{c}' for c in 'rgb')} FROM v GROUP BY 1),
  e AS (SELECT frame_id, {', '.join(f'quantile_cont(m{c}-g_{c}, 0.5) FILTER (held) AS em{c}, quantile_cont(abs(m{c}-g_{c}), 0.9) FILTER (held) AS ep{c}' for c in 'rgb')} FROM v JOIN m USING (frame_id) GROUP BY 1)
  SELECT frame_id, training, validation, {', '.join(sr(f'exp(m{c})', f'gain_{c}') for c in 'rgb')}, {', '.join(sr(f'em{c}', f'error_median_{c}') for c in 'rgb')}, {', '.join(sr(f'ep{c}', f'error_p90_{c}') for c in 'rgb')},
    CASE WHEN training < 8 OR validation < 8 THEN 'insufficient-stars' WHEN NOT (exp(mr) BETWEEN 0.05 AND 20 AND exp(mb) BETWEEN 0.05 AND 20) THEN 'invalid-gain' WHEN greatest(epr, epb) > 0.2 THEN 'inconsistent' ELSE 'fitted' END AS status
  FROM m JOIN e USING (frame_id)"""

# --- scalar functions --------------------------------------------------------------------------

def customer_key():
    return F.col("c_custkey")


def customers(s, sf):
    return table(s, sf, "customer")


def h1(s, sf):
    ra = F.concat_ws(":", F.lpad((customer_key() % 25).cast("string"), 2, "0"), F.lpad((customer_key() % 61).cast("string"), 2, "0"), F.format_string("%02d.5", customer_key() % 60))
    dec = F.concat(F.when(customer_key() % 2 == 0, "-").otherwise("+"), F.lpad((customer_key() % 91).cast("string"), 2, "0"), F.lit(":30:"), F.lpad((customer_key() % 60).cast("string"), 2, "0"))
    return rounded(customers(s, sf).select(customer_key().alias("id"), h.sexagesimal(ra, True).alias("ra"), h.sexagesimal(dec, False).alias("dec")))


def h2(s, sf):
    name = F.concat(F.when(customer_key() % 3 == 0, "NGC").when(customer_key() % 3 == 1, "IC").otherwise("Mel"), F.lpad(customer_key().cast("string"), 6, "0"))
    return customers(s, sf).select(customer_key().alias("id"), h.display_id(name).alias("label"), h.search_key(F.col("c_name")).alias("key"))


def h3(s, sf):
    ts = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("1970"), F.substring(F.date_format("ts", "yyyy-MM-dd"), 5, 6))).when(
        F.col("event_id") % 5 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T25:00:00"))).when(
        F.col("event_id") % 5 == 2, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T23:59:60"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    system = F.when(F.col("event_id") % 7 == 0, "TAI").when(F.col("event_id") % 7 == 1, "UTC")
    return table(s, sf, "events").select(F.col("event_id").alias("id"), h.utc_date(ts, system).cast("string").alias("day"))


def h5(s, sf):
    kinds = ["Light Frame", "MASTER-DARK", "flat", "Dark Flat", "flat_dark frame", "bias", "Offset", "tricolor"]
    text = F.element_at(F.array(*[F.lit(k) for k in kinds]), (customer_key() % 8 + 1).cast("int"))
    return customers(s, sf).select(customer_key().alias("id"), h.frame_type(text).alias("kind"))


def h8(s, sf):
    v = F.col("value")
    return rounded(f1c(s, sf).select("frame_id", "x", "y", "channel", h.srgb_encode(v).alias("encoded"), h.srgb_decode(v).alias("decoded"),
                                     h.soft_gamut_scale(F.abs(v) * 2).alias("scale")))


def h14(s, sf):
    a, b = F.col("observed_r"), F.col("observed_g")
    return rounded(f3(s, sf).select("star_id", *[c.alias(n) for n, c in h.moments_to_shape(a, b, F.col("eccentricity") - 0.3).items()]))


def h15(s, sf):
    ring = h.celestial_ellipse(F.col("ra"), F.col("dec"), F.col("major_arcmin"), F.col("major_arcmin") / 2, F.col("major_arcmin") * 5, 16)
    return rounded(f4_catalog(s, sf).select("id", ring.alias("r")).select("id", F.posexplode("r").alias("k", "p")).select("id", "k", "p.ra", "p.dec"))


def h16(s, sf):
    corner = lambda a, b: F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
    ring = F.array(corner(400, 400), corner(650, 450), corner(550, 500), corner(620, 640), corner(380, 600), corner(400, 400))
    return f3(s, sf).select("star_id", h.point_in_polygon(ring, F.col("x"), F.col("y")).alias("inside"))


def h18(s, sf):
    units = F.element_at(F.array(*[F.lit(u) for u in ("nm", "Angstrom", "micron", "m", "inch")]), (customer_key() % 5 + 1).cast("int"))
    return rounded(customers(s, sf).select(customer_key().alias("id"), h.wavelength_nm(F.col("c_acctbal"), units).alias("nm"),
                                           h.response_value(F.col("c_acctbal"), dbl(customer_key() % 3)).alias("share")))


QUERIES = {
    "C5_match_translation": lambda s, sf: rounded(m.match_translation(f3(s, sf), f3_moving(s, sf), TOL)),
    "C6_match_descriptors": lambda s, sf: rounded(m.match_descriptors(f3(s, sf), f3_moving(s, sf))),
    "C7_match_nearest": lambda s, sf: rounded(m.match_nearest(f3(s, sf), shifted(s, sf), TOL)),
    "C8_neighbor_count": lambda s, sf: m.neighbor_count(f3(s, sf), f3(s, sf), 40.0),
    "C8_isolated": lambda s, sf: m.isolated(f3(s, sf), 40.0).select("frame_id", "star_id"),
    "E1_brightest": lambda s, sf: m.brightest(f3(s, sf), ["frame_id"], 5).select("frame_id", "star_id", "rank"),
    "G4_exclude_ids": lambda s, sf: m.exclude_ids(f3(s, sf), f3_moving(s, sf).select("star_id"))[0].select("frame_id", "star_id"),
    "B15_pixel_to_sky": lambda s, sf: rounded(sky.pixel_to_sky(pixels(s, sf), f4_panels(s, sf))),
    "B16_sky_to_pixel": lambda s, sf: rounded(sky.sky_to_pixel(sky_points(s, sf).select("id", "panel_id", "ra", "dec"), f4_panels(s, sf), sip=False), 4),
    "B16_sip_round_trip": sip_round_trip,
    "B17_propagate_positions": lambda s, sf: rounded(sky.propagate_positions(f4_catalog(s, sf).select(
        "id", "ra", "dec", dbl(F.col("id") % 50 * 10).alias("pmra"), dbl(F.col("id") % 30 * -7).alias("pmdec")), 2026.5)),
    "B18_filter_catalog": lambda s, sf: sky.filter_catalog(f4_catalog(s, sf), "wide", 5.0, True, "00-0 1", SEGMENTS).select("id"),
    "C9_cone_search": lambda s, sf: sky.cone_search(f4_catalog(s, sf), f4_panels(s, sf)).select(
        "panel_id", "id", scaled("x", 4).alias("x"), scaled("y", 4).alias("y"), "center_visible"),
    "K1_annotation_order": lambda s, sf: sky.annotation_order(sky.on_any_panel(f4_catalog(s, sf), f4_panels(s, sf)), 50).select("id", "matched"),
    "K3_top_n_plus_one": lambda s, sf: sky.top_n_plus_one(f4_catalog(s, sf), 40, ["dec", "id"]).select("id", "limited"),
    "G1_union_catalogs": lambda s, sf: sky.union_catalogs(f4_catalog(s, sf), f4_catalog(s, sf).where("id % 5 = 0"))[1],
    "C18_join_spectra": lambda s, sf: sp.join_spectra(candidates(s, sf), f7(s, sf))[0],
    "C18_skipped": lambda s, sf: sp.join_spectra(candidates(s, sf), f7(s, sf))[1],
    "D34_synthetic_flux": lambda s, sf: rounded(sp.synthetic_flux(f7(s, sf), {"B": BANDS["B"]}), 4),
    "D34_synthetic_flux_bands": lambda s, sf: rounded(sp.synthetic_flux(f7(s, sf), BANDS), 4),
    "G2_spectrum_knots": lambda s, sf: sp.spectrum_knots(f7(s, sf), {"B": BANDS["B"]}),
    "D32_fit_color_gains": lambda s, sf: rounded(d32(s, sf)[0]),
    "D32_star_status": lambda s, sf: rounded(d32(s, sf)[1]),
    "D33_reference_color_gains": lambda s, sf: rounded(sp.reference_color_gains(d33_pairs(s, sf), minimum=8)),
    "H1_sexagesimal": h1, "H2_display_id": h2, "H3_utc_date": h3,
    "H4_julian_year": lambda s, sf: rounded(table(s, sf, "events").select("event_id", h.julian_year(F.col("ts")).alias("year")), 8),
    "H5_frame_type": h5, "H8_srgb": h8, "H14_moments_to_shape": h14, "H15_celestial_ellipse": h15, "H16_point_in_polygon": h16,
    "H17_category": lambda s, sf: f4_catalog(s, sf).select("id", h.category(F.col("type"), SEGMENTS).alias("category")),
    "H18_response_units": h18,
}

ORACLES = {
    "C5_match_translation": C5, "C6_match_descriptors": C6, "C7_match_nearest": C7, "C8_neighbor_count": NEAR,
    "C8_isolated": f"SELECT frame_id, star_id FROM ({NEAR}) WHERE neighbors = 1",
    "E1_brightest": f"SELECT frame_id, star_id, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, star_id) AS k FROM ({F3})) WHERE k <= 5",
    "G4_exclude_ids": f"SELECT frame_id, star_id FROM ({F3}) WHERE star_id % 9 = 0",
    "B15_pixel_to_sky": P2S,
    "B16_sky_to_pixel": f"""WITH p AS (SELECT *, {Z} AS z FROM ({POINTS}) JOIN ({F4_PANELS}) USING (panel_id))
      SELECT id, panel_id, {sr('ra', digits=4)}, {sr('dec', digits=4)}, {sr(f'CASE WHEN z > 1e-8 THEN degrees({XI})/-0.02 + 499.5 END', 'x', 4)}, {sr(f'CASE WHEN z > 1e-8 THEN degrees({ETA})/0.02 + 399.5 END', 'y', 4)} FROM p""",
    "B16_sip_round_trip": f"SELECT id, CAST(0 AS DOUBLE) AS dx, CAST(0 AS DOUBLE) AS dy FROM ({POINTS})",
    "B17_propagate_positions": f"""WITH c AS (SELECT *, radians(ra) AS r, radians(dec) AS d, CAST(id % 50 * 10 AS DOUBLE) AS pmra, CAST(id % 30 * -7 AS DOUBLE) AS pmdec, 10.5*pi()/180/3.6e6 AS dt FROM ({F4_CATALOG})),
      v AS (SELECT *, cos(d)*cos(r) + dt*(-pmra*sin(r) - pmdec*sin(d)*cos(r)) AS x, cos(d)*sin(r) + dt*(pmra*cos(r) - pmdec*sin(d)*sin(r)) AS y, sin(d) + dt*pmdec*cos(d) AS z FROM c)
      SELECT id, {sr('(degrees(atan2(y, x)) + 360) % 360', 'ra')}, {sr('degrees(atan2(z, sqrt(x*x+y*y)))', 'dec')}, pmra, pmdec FROM v""",
    "B18_filter_catalog": f"""SELECT id FROM ({F4_CATALOG}) WHERE type IN ('AUTOMOBILE', 'MACHINERY') AND (magnitude IS NULL OR magnitude <= 5)
      AND contains(lower(regexp_replace(id || ' ' || label, '[\\s\\-_]', '', 'g')), '0001')""",
    "C9_cone_search": f"WITH {CONE} SELECT panel_id, id, {sr('x', digits=4)}, {sr('y', digits=4)}, true AS center_visible FROM f",
    "K1_annotation_order": f"""WITH {CONE}, u AS (SELECT DISTINCT id, magnitude FROM f) SELECT id, (SELECT count(*) FROM u) AS matched FROM u
      ORDER BY CASE WHEN magnitude IS NULL THEN 1 ELSE 0 END, magnitude, id LIMIT 50""",
    "K3_top_n_plus_one": f"SELECT id, (SELECT count(*) FROM customer) > 40 AS limited FROM ({F4_CATALOG}) ORDER BY dec, id LIMIT 40",
    "G1_union_catalogs": f"SELECT id, CAST(2 AS BIGINT) AS copies FROM ({F4_CATALOG}) WHERE id % 5 = 0",
    "C18_join_spectra": """WITH c AS (SELECT c_custkey AS source_id, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 50 AS DOUBLE)*10 END AS pmra, CASE WHEN c_custkey % 13 = 0 THEN CAST(30000 AS DOUBLE) ELSE CAST(c_custkey % 30 AS DOUBLE)*-7 END AS pmdec FROM customer)
      SELECT * FROM c WHERE pmra IS NOT NULL AND sqrt(pmra*pmra + pmdec*pmdec) <= 20000 AND source_id IN (SELECT vec_id FROM embeddings)""",
    "C18_skipped": """SELECT source_id, reason FROM (SELECT c_custkey AS source_id, CASE WHEN c_custkey % 10 = 0 THEN 'proper-motion-missing' WHEN c_custkey % 13 = 0 THEN 'proper-motion-outside-query-margin'
      WHEN c_custkey NOT IN (SELECT vec_id FROM embeddings) THEN 'spectrum-missing' END AS reason FROM customer) WHERE reason IS NOT NULL""",
    "D34_synthetic_flux": flux_sql(),
    "G2_spectrum_knots": f"""SELECT DISTINCT source_id, 'B' AS band, wavelength FROM (SELECT source_id, wavelength FROM ({F7}) WHERE wavelength > 420 AND wavelength < 500
      UNION ALL SELECT vec_id, CAST(unnest([420, 450, 500]) AS DOUBLE) FROM embeddings)""",
    "D32_fit_color_gains": gains_sql("fit"), "D32_star_status": gains_sql("stars"), "D33_reference_color_gains": D33,
    "H1_sexagesimal": """WITH c AS (SELECT c_custkey AS id, c_custkey % 25 AS h, c_custkey % 61 AS m, c_custkey % 60 + 0.5 AS s, c_custkey % 91 AS d FROM customer)
      SELECT id, CASE WHEN h < 24 AND m < 60 THEN round(CAST((h + m/60 + s/3600)*15 AS DOUBLE) + CAST(1e-9 AS DOUBLE), 6) + CAST(0 AS DOUBLE) END AS ra,
      CASE WHEN d < 90 THEN round(CAST((d + 0.5 + (id % 60)/3600)*CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END AS DOUBLE) + CAST(1e-9 AS DOUBLE), 6) + CAST(0 AS DOUBLE) END AS dec FROM c""",
    "H2_display_id": "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'NGC ' || c_custkey WHEN 1 THEN 'IC ' || c_custkey ELSE 'Mel' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS label, lower(regexp_replace(c_name, '[\\s\\-_]', '', 'g')) AS key FROM customer",
    "H3_utc_date": "SELECT event_id AS id, CASE WHEN event_id % 5 IN (0, 1) OR event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events",
    "H4_julian_year": f"SELECT event_id, {sr('2000 + (epoch_us(ts) - 946728000000000)/(365.25*86400000000)', 'year', 8)} FROM events",
    "H5_frame_type": "SELECT c_custkey AS id, ['light', 'dark', 'flat', 'dark-flat', 'dark-flat', 'bias', 'bias', ''][c_custkey % 8 + 1] AS kind FROM customer",
    "H8_srgb": f"""SELECT frame_id, x, y, channel, {sr('CASE WHEN value <= 0.0031308 THEN 12.92*value ELSE 1.055*pow(value, 1/2.4) - 0.055 END', 'encoded')},
      {sr('CASE WHEN value <= 0.04045 THEN value/12.92 ELSE pow((value + 0.055)/1.055, 2.4) END', 'decoded')},
      {sr('CASE WHEN abs(value)*2 >= 1.25 THEN 1 ELSE 1.6*abs(value) + 0.4*abs(value)*(1 - 1.6*abs(value))/(0.4*abs(value) + 1 - 1.6*abs(value)) END', 'scale')} FROM ({F1C})""",
    "H14_moments_to_shape": f"""WITH s AS (SELECT star_id, observed_r AS a, observed_g AS b, eccentricity - 0.3 AS c FROM ({F3})),
      t AS (SELECT *, greatest(0, (a+b)/2 + sqrt((a-b)*(a-b)/4 + c*c)) AS ma, greatest(0, (a+b)/2 - sqrt((a-b)*(a-b)/4 + c*c)) AS mi FROM s)
      SELECT star_id, {sr('2.35482*sqrt((a+b)/2)', 'fwhm')}, {sr('2.35482*sqrt(ma)', 'major')}, {sr('2.35482*sqrt(mi)', 'minor')}, {sr('sqrt(1 - mi/ma)', 'eccentricity')}, {sr('degrees(atan2(2*c, a-b)/2)', 'angle')} FROM t""",
    "H15_celestial_ellipse": f"""WITH c AS (SELECT id, radians(ra) AS a, radians(dec) AS d, radians(major_arcmin*5) AS pa, major_arcmin/120 AS ma, k FROM ({F4_CATALOG}) CROSS JOIN (SELECT CAST(unnest(range(17)) AS INT) AS k)),
      u AS (SELECT *, ma*cos(2*pi()*k/16) AS u, ma/2*sin(2*pi()*k/16) AS v FROM c), e AS (SELECT *, u*sin(pa) + v*cos(pa) AS e, u*cos(pa) - v*sin(pa) AS n FROM u),
      r AS (SELECT *, radians(sqrt(e*e+n*n)) AS rho FROM e), f AS (SELECT *, sin(rho)/rho*radians(e) AS ee, sin(rho)/rho*radians(n) AS nn FROM r),
      p AS (SELECT id, k, cos(rho)*cos(d)*cos(a) - ee*sin(a) - nn*sin(d)*cos(a) AS x, cos(rho)*cos(d)*sin(a) + ee*cos(a) - nn*sin(d)*sin(a) AS y, cos(rho)*sin(d) + nn*cos(d) AS z FROM f)
      SELECT id, k, {sr('(degrees(atan2(y, x)) + 360) % 360', 'ra')}, {sr('degrees(atan2(z, sqrt(x*x+y*y)))', 'dec')} FROM p""",
    "H16_point_in_polygon": f"""WITH e AS (SELECT * FROM (VALUES (400,400,650,450),(650,450,550,500),(550,500,620,640),(620,640,380,600),(380,600,400,400)) AS t(ax, ay, bx, cy))
      SELECT star_id, sum(CASE WHEN (ay > y) <> (cy > y) AND x < (bx-ax)*(y-ay)/(cy-ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM ({F3}) CROSS JOIN e GROUP BY star_id""",
    "H17_category": "SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'deep' WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 'wide' ELSE 'other' END AS category FROM customer",
    "H18_response_units": f"""SELECT c_custkey AS id, {sr('c_acctbal*CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0.1 WHEN 2 THEN 1000 WHEN 3 THEN 1e9 END', 'nm')},
      {sr('CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal/(c_custkey % 3) END', 'share')} FROM customer""",
}

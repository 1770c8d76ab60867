"""Queries and oracles of star measurement and of detected regions and trails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import stars as st
from .fixtures import F1, F1C_WIDE, F3, F6, dbl, f1, f1c, f3, f6, rounded, sr, table

# --- star fields drawn from the tables -------------------------------------------------------

SIZE = 48


def star_frames(s, sf):
    """One 48x48 frame per star of F3 (frame_id = star id): a Gaussian whose centre, width and flux come from the row."""
    d = f3(s, sf).select(
        F.col("star_id").alias("frame_id"), (F.lit(24.0) + F.pmod(F.col("x"), F.lit(1.0)) - 0.5).alias("cx"),
        (F.lit(24.0) + F.pmod(F.col("y"), F.lit(1.0)) - 0.5).alias("cy"), (F.lit(1.2) + F.col("eccentricity") * 0.5).alias("s"), "flux")
    grid = d.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(SIZE - 1))))
    r2 = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    noise = (F.pmod(F.xxhash64("frame_id", "x", "y"), F.lit(1000)) / 1000 - 0.5) * 0.02
    value = F.lit(10.0) + F.col("x") * 0.01 + F.col("flux") * 0.1 * F.exp(-r2 / (F.col("s") * F.col("s") * 2)) + noise
    return grid.select("frame_id", "x", "y", F.lit(0).alias("channel"), value.alias("value"), F.lit(1.0).alias("coverage"))


def star_list(s, sf):
    return f3(s, sf).select(
        F.col("star_id").alias("frame_id"), "star_id", (F.lit(24.0) + F.pmod(F.col("x"), F.lit(1.0)) - 0.5).alias("x"),
        (F.lit(24.0) + F.pmod(F.col("y"), F.lit(1.0)) - 0.5).alias("y"))


def photometry(s, sf):
    out = st.aperture_photometry(star_list(s, sf), star_frames(s, sf), 6.0, 9.0, 14.0)
    return rounded(out.select("frame_id", "star_id", "channel", "status", "flux", "snr"), 3)


def shapes(s, sf):
    return rounded(st.fit_star_shapes(star_list(s, sf), star_frames(s, sf)), 4)


def masks(s, sf):
    return rounded(st.star_mask(f3(s, sf).withColumn("peak", F.col("eccentricity")), 1000, 1000, 3, 6, 1.0, 0.5, True, 0.5))


MASK = f"""WITH s AS (SELECT frame_id, flux, eccentricity AS peak, CAST(floor(x+0.5) AS INT) AS px, CAST(floor(y+0.5) AS INT) AS py FROM ({F3})),
  t AS (SELECT frame_id, list_sort(list(flux))[CAST(ceil((count(*)-1)*0.85) AS BIGINT)+1] AS th FROM s GROUP BY 1),
  l AS (SELECT *, peak >= 0.5 AND flux >= th AS big, CASE WHEN peak >= 0.5 AND flux >= th THEN 6 ELSE 3 END AS r FROM s JOIN t USING (frame_id)),
  d AS (SELECT l.*, dx, dy, sqrt(dx*dx+dy*dy) AS dist FROM l JOIN (SELECT unnest(range(-6, 7)) AS dx) ON abs(dx) <= r JOIN (SELECT unnest(range(-6, 7)) AS dy) ON abs(dy) <= r)
  SELECT frame_id, CAST(px+dx AS INT) AS x, CAST(py+dy AS INT) AS y, {sr('max((1 - dist/(r+1))*CASE WHEN big AND dist/(r+1) > 0.55 THEN 0.5 ELSE 1 END)', 'value')}
  FROM d WHERE dist <= r AND px+dx BETWEEN 0 AND 999 AND py+dy BETWEEN 0 AND 999 GROUP BY frame_id, px+dx, py+dy"""

CANDIDATES = f"""WITH s AS (SELECT * FROM ({F1}) WHERE coverage > 1e-6),
  m AS (SELECT frame_id, sum(value*coverage)/sum(coverage) AS mean FROM s GROUP BY 1),
  g AS (SELECT frame_id, any_value(mean) AS mean, sqrt(sum((value-mean)*(value-mean)*coverage)/sum(coverage)) AS sigma FROM s JOIN m USING (frame_id) GROUP BY 1),
  e AS (SELECT s.*, mean, sigma, mean + (value-mean)*coverage AS e FROM s JOIN g USING (frame_id)),
  c AS (SELECT * FROM e WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND e >= greatest(-1, mean + 0.8*sigma)),
  n AS (SELECT c.frame_id, c.x AS cx, c.y AS cy, n.x - c.x AS dx, n.y - c.y AS dy, greatest(0, n.value - n.mean)*n.coverage AS sg, c.value AS peak,
      CASE WHEN (n.x <> c.x OR n.y <> c.y) AND (n.e > c.e OR (n.e = c.e AND (n.y < c.y OR (n.y = c.y AND n.x < c.x)))) THEN 1 ELSE 0 END AS beat
    FROM c JOIN e n ON n.frame_id = c.frame_id AND abs(n.x-c.x) <= 1 AND abs(n.y-c.y) <= 1),
  k AS (SELECT frame_id, cx, cy, any_value(peak) AS peak, sum(sg) AS flux, sum(sg*dx)/sum(sg) AS mx, sum(sg*dy)/sum(sg) AS my, sum(sg*dx*dx)/sum(sg) AS xx, sum(sg*dy*dy)/sum(sg) AS yy, sum(sg*dx*dy)/sum(sg) AS xy
    FROM n GROUP BY 1, 2, 3 HAVING max(beat) = 0 AND sum(sg) > 0),
  v AS (SELECT *, xx - mx*mx AS a, yy - my*my AS b, xy - mx*my AS c FROM k),
  w AS (SELECT *, greatest(0, (a+b)/2 + sqrt((a-b)*(a-b)/4 + c*c)) AS ma, greatest(0, (a+b)/2 - sqrt((a-b)*(a-b)/4 + c*c)) AS mi FROM v)
  SELECT frame_id, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, {sr('cx+mx', 'x')}, {sr('cy+my', 'y')}, {sr('flux')}, {sr('peak')}, {sr('2.35482*sqrt(ma)', 'fwhm')},
    {sr('CASE WHEN ma > 1e-12 THEN sqrt(greatest(0, least(1, 1 - mi/ma))) ELSE 0 END', 'eccentricity')} FROM w"""


#: The sequential rule by recursion: one candidate of every frame a step, kept unless a kept one lies within 3 pixels.
DETECTED = f"""WITH RECURSIVE k AS (SELECT *, CAST(cy AS BIGINT)*8 + cx AS star_id, row_number() OVER (PARTITION BY frame_id ORDER BY flux DESC, cy*8 + cx) AS rk FROM ({CANDIDATES})),
  r AS (SELECT DISTINCT frame_id, 0 AS i, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, star BIGINT)[]) AS kept FROM k
    UNION ALL SELECT r.frame_id, r.i + 1, CASE WHEN len(list_filter(r.kept, lambda p: pow(p.x - k.x, 2) + pow(p.y - k.y, 2) < 9)) > 0 THEN r.kept
      ELSE list_append(r.kept, {{'x': k.x, 'y': k.y, 'star': k.star_id}}) END FROM r JOIN k ON k.frame_id = r.frame_id AND k.rk = r.i + 1),
  e AS (SELECT frame_id, kept FROM r QUALIFY i = max(i) OVER (PARTITION BY frame_id)),
  s AS (SELECT frame_id, unnest(list_transform(kept, lambda p: p.star)) AS star_id, CAST(len(kept) AS BIGINT) AS detected FROM e)
  SELECT frame_id, star_id, x, y, flux, peak, fwhm, eccentricity, detected FROM s JOIN k USING (frame_id, star_id)"""


def psf(s, sf):
    d = f3(s, sf).select("frame_id", "x", "y", F.col("observed_r").alias("xx"), F.col("observed_g").alias("yy"), (F.col("eccentricity") * 0.1).alias("xy"))
    return st.psf_summary(d, 1400, 1400)


REGION = "CAST(greatest(0, least(3, floor(y*4/1400)))*4 + greatest(0, least(3, floor(x*4/1400))) AS INT)"
PSF = f"""WITH s AS (SELECT frame_id, x, y, observed_r AS xx, observed_g AS yy, eccentricity*0.1 AS xy FROM ({F3})),
  w AS (SELECT *, ln(2.3548200450309493*sqrt(sqrt(xx*yy - xy*xy))) AS l FROM s),
  m AS (SELECT frame_id, quantile_cont(l, 0.5) AS m, quantile_cont(l, 0.1) AS l10, quantile_cont(l, 0.9) AS l90 FROM w GROUP BY 1),
  d AS (SELECT frame_id, quantile_cont(abs(l-m), 0.5) AS s FROM w JOIN m USING (frame_id) GROUP BY 1),
  k AS (SELECT w.*, exp(l) AS fw, l10, l90, {REGION} AS region FROM w JOIN m USING (frame_id) JOIN d USING (frame_id) WHERE abs(l-m) <= greatest(ln(1.25), 4*1.4826*s)),
  r AS (SELECT frame_id, region, count(*) AS stars, quantile_cont(fw, 0.5) AS fwhm, avg(xx) AS xx, avg(yy) AS yy, avg(xy) AS xy FROM k GROUP BY 1, 2),
  t AS (SELECT frame_id, count(*) AS accepted, count(DISTINCT region) AS regions, avg(xx) AS xx, avg(yy) AS yy, avg(xy) AS xy, quantile_cont(fw, 0.1) AS p10, quantile_cont(fw, 0.5) AS p50,
    quantile_cont(fw, 0.9) AS p90, any_value(l10) AS l10, any_value(l90) AS l90, max(x)-min(x) AS sx, max(y)-min(y) AS sy FROM k GROUP BY 1),
  v AS (SELECT r.frame_id, max(sqrt(pow(r.xx-t.xx,2)+pow(r.yy-t.yy,2)+2*pow(r.xy-t.xy,2))/(t.xx+t.yy)) AS sh, count(*) AS n, max(fwhm)/min(fwhm) AS ra FROM r JOIN t USING (frame_id) WHERE stars >= 3 GROUP BY 1)"""

SHIFT_ROWS = f"""SELECT frame_id, CAST(star_id % 2 AS INT)*2 AS channel, x, y, 0.3 + (eccentricity-0.3)*0.2 AS dx, -0.1 + (observed_r-1.1)*0.2 AS dy FROM ({F3})"""


def shift_rows(s, sf):
    return f3(s, sf).select("frame_id", (F.col("star_id") % 2 * 2).cast("int").alias("channel"), "x", "y",
                            (F.lit(0.3) + (F.col("eccentricity") - 0.3) * 0.2).alias("dx"), (F.lit(-0.1) + (F.col("observed_r") - 1.1) * 0.2).alias("dy"))


MU = lambda e, f="true": f"list_sort(list({e}) FILTER ({f}))[CAST(count(*) FILTER ({f})//2 AS BIGINT)+1]"
SHIFT = f"""WITH s AS ({SHIFT_ROWS}), m AS (SELECT frame_id, channel, {MU('dx')} AS mx, {MU('dy')} AS my FROM s GROUP BY 1, 2),
  r AS (SELECT s.*, sqrt(pow(dx-mx,2)+pow(dy-my,2)) AS r FROM s JOIN m USING (frame_id, channel)),
  c AS (SELECT frame_id, channel, count(*) AS measured, {MU('r')} AS scatter FROM r GROUP BY 1, 2),
  k AS (SELECT r.*, CAST(x >= 700 AS INT) + 2*CAST(y >= 700 AS INT) AS q FROM r JOIN c USING (frame_id, channel) WHERE r <= greatest(0.08, 3*scatter)),
  t AS (SELECT frame_id, channel, count(*) AS stars, {MU('dx')} AS sx, {MU('dy')} AS sy FROM k GROUP BY 1, 2),
  p AS (SELECT frame_id, channel, q, {MU('dx')} AS qx, {MU('dy')} AS qy FROM k GROUP BY 1, 2, 3 HAVING count(*) >= 3),
  o AS (SELECT frame_id, channel, count(*) AS quadrants, max(sqrt(pow(qx-sx,2)+pow(qy-sy,2))) AS off FROM p JOIN t USING (frame_id, channel) GROUP BY 1, 2),
  f AS (SELECT *, measured >= 12 AND stars >= 12 AND stars >= 0.75*measured AND scatter <= 0.10 AS ok FROM c JOIN t USING (frame_id, channel) LEFT JOIN o USING (frame_id, channel))
  SELECT frame_id, channel, measured, stars, {sr('scatter')}, {sr('CASE WHEN ok THEN sx END', 'shift_x')}, {sr('CASE WHEN ok THEN sy END', 'shift_y')}, coalesce(quadrants, 0) AS quadrants,
    coalesce(ok AND quadrants >= 3 AND off <= 0.10 AND sqrt(sx*sx+sy*sy) BETWEEN 0.05 AND 1.5 AND sqrt(sx*sx+sy*sy) >= 5*scatter/sqrt(stars), false) AS applied FROM f"""

# --- regions and trails ------------------------------------------------------------------------

AREA = 1_000_000.0


def regions(s, sf):
    w, h = F.abs(F.col("x2") - F.col("x1")) + 1, F.abs(F.col("y2") - F.col("y1")) + 1
    return f6(s, sf).select(F.col("trail_id").alias("region_id"), "frame_id", F.col("x1").alias("x"), F.col("y1").alias("y"), w.alias("width"), h.alias("height"),
                            (w * h / AREA * 0.6).alias("coverage"), F.col("weight").alias("confidence"), F.col("weight").alias("mean_luminance"),
                            F.lit(0.5).alias("background_luminance"))


REGIONS = f"""SELECT trail_id AS region_id, frame_id, x1 AS x, y1 AS y, abs(x2-x1)+1 AS w, abs(y2-y1)+1 AS h, weight AS confidence FROM ({F6})"""


def support(s, sf):
    """The first day of each ten holds candidates, the second the known regions, the others are references."""
    r = regions(s, sf)
    role = F.col("frame_id") % 10
    days = r.where(role > 1).agg(F.countDistinct("frame_id").alias("n")).first()["n"]
    return ev.temporal_support(r.where(role == 0), r.where(role > 1), r.where(role == 1), days, AREA)


IOU = lambda a, b: (f"(greatest(0, least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x))*greatest(0, least({a}.y+{a}.h, {b}.y+{b}.h) - greatest({a}.y, {b}.y)))"
                    f"/({a}.w*{a}.h + {b}.w*{b}.h - greatest(0, least({a}.x+{a}.w, {b}.x+{b}.w) - greatest({a}.x, {b}.x))*greatest(0, least({a}.y+{a}.h, {b}.y+{b}.h) - greatest({a}.y, {b}.y)))")
SUPPORT = f"""r AS ({REGIONS}), n AS (SELECT greatest(2, (count(DISTINCT frame_id)+2)//3) AS need FROM r WHERE frame_id % 10 > 1),
  c0 AS (SELECT a.region_id, count(DISTINCT b.frame_id) AS support FROM r a JOIN r b ON b.frame_id % 10 > 1 AND b.confidence < 0.5 AND {IOU('a', 'b')} >= 0.1 WHERE a.frame_id % 10 = 0 AND a.confidence < 0.5 GROUP BY 1),
  c AS (SELECT r.*, support FROM r JOIN c0 USING (region_id) WHERE support >= (SELECT need FROM n)),
  o AS (SELECT a.region_id, min(b.region_id) AS onto, any_value(a.support) AS support FROM c a JOIN r b ON b.frame_id % 10 = 1 AND {IOU('a', 'b')} >= 0.5 GROUP BY 1)"""

ANG = lambda p: f"atan2({p}.y2-{p}.y1, {p}.x2-{p}.x1)"
LEN = lambda p: f"sqrt(pow({p}.x2-{p}.x1,2)+pow({p}.y2-{p}.y1,2))"
DA = f"(abs({ANG('a')}-{ANG('b')}) % pi())"
ALONG = lambda p, i: f"({p}.x{i}*cos({ANG('a')}) + {p}.y{i}*sin({ANG('a')}))"
LO = lambda p: f"least({ALONG(p, 1)}, {ALONG(p, 2)})"
HI = lambda p: f"greatest({ALONG(p, 1)}, {ALONG(p, 2)})"
TRAILS = f"""WITH t AS ({F6}), p AS (SELECT a.trail_id, b.frame_id FROM t a JOIN t b ON a.kind = b.kind AND a.frame_id <> b.frame_id AND abs(a.y1 - b.y1) < 400
    WHERE least({DA}, pi()-{DA}) <= 0.18 AND abs(-((a.x1+a.x2)/2-(b.x1+b.x2)/2)*sin({ANG('a')}) + ((a.y1+a.y2)/2-(b.y1+b.y2)/2)*cos({ANG('a')})) <= greatest(8, (a.width+b.width)*1.6)
      AND greatest(0, least({HI('a')}, {HI('b')}) - greatest({LO('a')}, {LO('b')})) >= 0.4*least({LEN('a')}, {LEN('b')})),
  c AS (SELECT trail_id, count(DISTINCT frame_id) AS n FROM p GROUP BY 1)
  SELECT t.trail_id, frame_id, kind, coalesce(n, 0) AS recurring_frames, CASE WHEN coalesce(n, 0) >= 12 THEN 'recurrent' ELSE 'selected' END AS decision FROM t LEFT JOIN c USING (trail_id)"""

LUM = "(0.2126*r + 0.7152*g + CAST(0.0722 AS DOUBLE)*b)"
TQ = lambda m, q: f"max(CASE WHEN m = '{m}' AND c >= {q}*t - 1e-9 AND c - n < {q}*t - 1e-9 THEN b END)/1023.0"
TILES = f"""WITH w AS (SELECT *, {LUM} AS l, CAST(floor(((y+1)*2-1)/4) AS INT)*3 + CAST(floor(((x+1)*3-1)/7) AS INT) AS tile FROM ({F1C_WIDE})),
  s AS (SELECT frame_id, tile, CAST(count(*) AS DOUBLE) AS weight, avg(l) AS mean, sqrt(greatest(0, avg(l*l)-avg(l)*avg(l))) AS sigma FROM w GROUP BY 1, 2),
  p AS (SELECT frame_id, tile, count(*) FILTER (l > mean + greatest(0.025, 2.15*sigma))/count(*) AS bright FROM w JOIN s USING (frame_id, tile) GROUP BY 1, 2),
  u AS (SELECT frame_id, tile, m, CAST(floor(greatest(0, least(1, v))*1023 + 0.5) AS INT) AS b, count(*) AS n FROM (
      SELECT frame_id, tile, 'l' AS m, l AS v FROM w UNION ALL SELECT frame_id, tile, 'r', r FROM w UNION ALL SELECT frame_id, tile, 'g', g FROM w UNION ALL SELECT frame_id, tile, 'b', b FROM w) GROUP BY ALL),
  h AS (SELECT *, sum(n) OVER (PARTITION BY frame_id, tile, m ORDER BY b) AS c, sum(n) OVER (PARTITION BY frame_id, tile, m) AS t FROM u),
  q AS (SELECT frame_id, tile, {TQ('l', 0.7)} - {TQ('l', 0.2)} AS contrast, {TQ('l', 0.3)} AS ll, {TQ('r', 0.3)} AS lr, {TQ('g', 0.3)} AS lg, {TQ('b', 0.3)} AS lb FROM h GROUP BY 1, 2)
  SELECT frame_id, tile, weight, {sr('mean')}, {sr('sigma')}, {sr('bright', 'bright_fraction')}, {sr('contrast')}, {sr('ll', 'low_luminance')}, {sr('lr', 'low_r')}, {sr('lg', 'low_g')}, {sr('lb', 'low_b')}
  FROM s JOIN p USING (frame_id, tile) JOIN q USING (frame_id, tile)"""

QUERIES = {
    "D46_star_candidates": lambda s, sf: rounded(st.star_candidates(f1(s, sf), 8, 8, 0.8, -1.0)),
    "D46_detect_stars": lambda s, sf: rounded(st.detect_stars(f1(s, sf), 8, 8, sigma=0.8, min_peak=-1.0)),
    "D47_aperture_photometry": photometry,
    "D48_fit_star_shapes": shapes,
    "D49_star_mask": masks,
    "D35_psf_summary": lambda s, sf: rounded(psf(s, sf)[0]),
    "D35_psf_regions": lambda s, sf: rounded(psf(s, sf)[1]),
    "D36_astrometric_summary": lambda s, sf: rounded(st.astrometric_summary(f3(s, sf).withColumn("distance", F.col("eccentricity")), 1400, 1400)),
    "D37_channel_shift": lambda s, sf: rounded(st.channel_shift(shift_rows(s, sf), 1400, 1400)),
    "C15_temporal_support": lambda s, sf: rounded(support(s, sf)[0].select("region_id", "support", "confidence")),
    "C15_existing_regions": lambda s, sf: rounded(support(s, sf)[1].select("region_id", "support", "confidence")),
    "C16_recurrent_trails": lambda s, sf: ev.recurrent_trails(f6(s, sf), 12),
    "D30_tile_stats": lambda s, sf: rounded(ev.tile_stats(f1c(s, sf), 3, 2, 7, 4)),
    "K4_region_order": lambda s, sf: ev.region_order(regions(s, sf)).select("region_id", "index"),
}

ORACLES = {
    "D46_star_candidates": CANDIDATES, "D46_detect_stars": DETECTED,
    "D49_star_mask": MASK,
    "D35_psf_summary": f"""{PSF} SELECT frame_id, accepted, regions, {sr('xx')}, {sr('yy')}, {sr('xy')}, {sr('2.3548200450309493*sqrt((xx+yy)/2 + sqrt(pow((xx-yy)/2,2)+xy*xy))', 'major_fwhm')},
      {sr('2.3548200450309493*sqrt((xx+yy)/2 - sqrt(pow((xx-yy)/2,2)+xy*xy))', 'minor_fwhm')}, {sr('degrees(atan2(2*xy, xx-yy)/2)', 'angle')}, {sr('p10', 'fwhm_p10')}, {sr('p50', 'fwhm_p50')}, {sr('p90', 'fwhm_p90')},
      exp(l90-l10) > 1.3 OR p90/p10 > 1.3 OR coalesce(n >= 4 AND ra > 1.2, false) OR coalesce(sh > 0.15, false) AS spatially_variable, accepted >= 12 AND regions >= 4 AND sx >= 560 AND sy >= 560 AS enough FROM t LEFT JOIN v USING (frame_id)""",
    "D35_psf_regions": f"{PSF} SELECT frame_id, region, stars, {sr('fwhm')}, {sr('xx')}, {sr('yy')}, {sr('xy')} FROM r",
    "D36_astrometric_summary": f"""SELECT frame_id, count(*) AS count, count(DISTINCT {REGION}) AS regions, {sr('max(eccentricity)', 'maximum')}, {sr('(max(x)-min(x))/1400', 'span_x')}, {sr('(max(y)-min(y))/1400', 'span_y')},
      {sr('quantile_cont(eccentricity, 0.5)', 'median')}, {sr('quantile_cont(eccentricity, 0.95)', 'p95')} FROM ({F3}) GROUP BY 1""",
    "D37_channel_shift": SHIFT,
    "C15_existing_regions": f"""WITH {SUPPORT} SELECT region_id, coalesce(mx, 0) AS support, {sr('least(1, confidence + 0.035*coalesce(al, 0))', 'confidence')} FROM r
      LEFT JOIN (SELECT onto, max(support) AS mx, sum(support) AS al FROM o GROUP BY 1) ON onto = region_id WHERE frame_id % 10 = 1""",
    "C16_recurrent_trails": TRAILS,
    "D30_tile_stats": TILES,
    "K4_region_order": f"SELECT region_id, CAST(row_number() OVER (ORDER BY confidence DESC, y, x, region_id) - 1 AS INT) AS index FROM ({REGIONS})",
}

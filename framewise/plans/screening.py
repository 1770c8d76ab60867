"""Queries and oracles of frame quality and sequence screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators.stats import quantiles
from .fixtures import F1, F2, F2_STATS, F3, f1, f2, f2_events, f3, rounded, sql_wmed, sr

MADF = 1.482602218505602


def f2_stats(s, sf):
    """Statistics per day: sky, noise, valid share, star count, width, eccentricity."""
    g, ev = f2(s, sf), f2_events(s, sf)
    cells = g.agg(F.countDistinct("cell").alias("n")).first()["n"]
    base = q.mad_table(g, ["frame_id"], "value", 1.0, "sky", "noise").join(
        g.groupBy("frame_id").agg((F.count(F.lit(1)) / cells).alias("valid_fraction"),
                                  (1 + F.stddev_samp("value") / 50).alias("fwhm")), "frame_id")
    counts = ev.groupBy("frame_id").agg(
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("star_count"),
        (F.count(F.when(F.col("event_type") == "error", 1)) / F.count(F.lit(1))).alias("eccentricity"))
    return base.join(counts, "frame_id")


OPTIONS = q.QualityOptions(residual_sigma=2.0, minimum_coverage=0.7)


def assessed(s, sf):
    stats = f2_stats(s, sf)
    return q.assess_frames(stats, q.temporal_residuals(f2(s, sf), stats, OPTIONS), OPTIONS)


def overrides(df):
    return df.select("frame_id", F.when(F.col("frame_id") % 10 == 3, "keep").when(F.col("frame_id") % 10 == 7, "reject")
                     .otherwise("automatic").alias("override"))


def texts(df):
    return df.withColumns({c: F.concat_ws(",", F.array_sort(c)) for c in ("reasons", "warnings")})


def selected(s, sf):
    a = assessed(s, sf)
    return q.apply_overrides(a, overrides(a))


def d17(s, sf):
    bg = q.frame_background(f1(s, sf)).withColumn("frame_id", F.col("frame_id") % 10)
    bg = bg.groupBy("frame_id").agg(*[F.avg(c).alias(c) for c in ("background", "noise", "saturated")])
    return rounded(q.frame_score(bg, f3(s, sf)))


def outliers(s, sf):
    """Days whose value is above the overall median, on a 16-column grid of users."""
    g = f2(s, sf)
    mid = quantiles(g, [], "value", {"m": ("avg",)}).first()["m"]
    return g.where(F.col("value") > mid).select("frame_id", F.expr("CAST(cell % 16 AS INT)").alias("x"),
                                                F.expr("CAST(cell div 16 AS INT)").alias("y"))


RESIDUAL = f"""st AS ({F2_STATS}),
  v AS (SELECT g.frame_id, cell, value - sky AS x, noise FROM ({F2}) g JOIN st USING (frame_id)),
  n AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY cell ORDER BY x, frame_id) - 1 AS r FROM v WINDOW w AS (PARTITION BY cell)),
  l AS (SELECT cell, list_sort(list(x)) AS s, quantile_cont(x, 0.5) AS c FROM v GROUP BY 1),
  m AS (SELECT cell, {MADF}*quantile_cont(abs(x - c), 0.5) AS mad FROM v JOIN l USING (cell) GROUP BY 1),
  p AS (SELECT *, s[:CAST(r AS INT)] || s[CAST(r AS INT)+2:] AS o FROM n JOIN l USING (cell) JOIN m USING (cell) WHERE n > 4),
  e AS (SELECT *, CASE WHEN (n-1) % 2 = 1 THEN o[CAST((n-1)//2 AS INT)+1] ELSE (o[CAST((n-1)//2 AS INT)] + o[CAST((n-1)//2 AS INT)+1])/2 END AS peer FROM p),
  t AS (SELECT frame_id, x - peer AS res, 2.0*greatest(mad, sqrt(noise*noise + pow((SELECT quantile_cont(noise, 0.5) FROM st)/sqrt(n-1), 2)), 1e-6) + 0.05*abs(peer) AS thr FROM e),
  rs AS (SELECT frame_id, count(*) AS compared, count(*) >= 16 AS available, count(*) FILTER (res > thr) AS positive, count(*) FILTER (res < -thr) AS negative,
    CASE WHEN count(*) >= 16 THEN count(*) FILTER (res > thr)/count(*) END AS pf, CASE WHEN count(*) >= 16 THEN count(*) FILTER (res < -thr)/count(*) END AS nf,
    CASE WHEN count(*) >= 16 THEN sqrt(sum(res*res)/count(*)) END AS rms FROM t GROUP BY 1)"""

ASSESS = f"""{RESIDUAL},
  md AS (SELECT quantile_cont(noise, 0.5) AS mn, quantile_cont(fwhm, 0.5) FILTER (star_count > 0 AND fwhm > 0) AS mf,
    quantile_cont(eccentricity, 0.5) FILTER (star_count > 0 AND fwhm > 0) AS me, quantile_cont(star_count, 0.5) FILTER (star_count > 0) AS ms FROM st),
  rm AS (SELECT quantile_cont(pf + nf, 0.5) AS m FROM rs WHERE available),
  rl AS (SELECT greatest(0.10, (SELECT m FROM rm) + 4*{MADF}*quantile_cont(abs(pf + nf - (SELECT m FROM rm)), 0.5)) AS lim FROM rs WHERE available),
  a0 AS (SELECT st.*, rs.positive, rs.negative, coalesce(rs.available, false) AS available, pf + nf AS total, noise/greatest(mn, 1e-6) AS noise_ratio, fwhm/mf AS fwhm_ratio, me, ms,
    coalesce((SELECT lim FROM rl), 0.10) AS lim FROM st LEFT JOIN rs USING (frame_id) CROSS JOIN md),
  a AS (SELECT *, list_filter([CASE WHEN valid_fraction < 0.7 THEN 'low-coverage' END, CASE WHEN noise_ratio > 2 THEN 'high-noise' END,
      CASE WHEN fwhm_ratio > 1.7 THEN 'broad-stars' END, CASE WHEN eccentricity > 0.8 AND eccentricity > me + 0.15 THEN 'elongated-stars' END,
      CASE WHEN ms >= 20 AND star_count < 0.3*ms THEN 'few-stars' END, CASE WHEN available AND total > lim THEN 'broad-temporal-residuals' END], lambda z: z IS NOT NULL) AS rea,
    list_filter([CASE WHEN eccentricity > 0.8 AND NOT eccentricity > me + 0.15 THEN 'elongated-stars-absolute' END, CASE WHEN NOT available THEN 'insufficient-temporal-peers' END,
      CASE WHEN available AND NOT total > lim AND positive + negative > 0 THEN 'localized-transients-use-pixel-rejection' END,
      CASE WHEN star_count > 0 AND fwhm <= 0 THEN 'stellar-shapes-unavailable' END], lambda z: z IS NOT NULL) AS war FROM a0),
  ov AS (SELECT *, CASE WHEN frame_id % 10 = 3 THEN 'keep' WHEN frame_id % 10 = 7 THEN 'reject' ELSE 'automatic' END AS override, len(rea) = 0 AS keep FROM a),
  sl AS (SELECT * REPLACE (CASE WHEN override = 'reject' THEN list_append(rea, 'user-excluded') ELSE rea END AS rea),
    CASE override WHEN 'keep' THEN true WHEN 'reject' THEN false ELSE keep END AS selected FROM ov)"""

COLS = f"""frame_id, {sr('noise_ratio')}, {sr('fwhm_ratio')}, available, {sr('total', 'residual_fraction')},
  array_to_string(list_sort(rea), ',') AS reasons, array_to_string(list_sort(war), ',') AS warnings, keep"""

NORM = f"""e AS (SELECT frame_id, min(value) AS lo, max(value) AS hi FROM ({F1}) WHERE coverage > 1e-6 GROUP BY 1),
  nv AS (SELECT frame_id, coverage AS w, greatest(0, least(1, (value-lo)/(hi-lo))) AS v FROM ({F1}) JOIN e USING (frame_id) WHERE coverage > 1e-6),
  bg AS ({sql_wmed('nv', 'frame_id', 'v', 'w', 'background')}),
  dv AS (SELECT frame_id, w, abs(v - background) AS v FROM nv JOIN bg USING (frame_id)),
  no AS ({sql_wmed('dv', 'frame_id', 'v', 'w', 'noise')}),
  sa AS (SELECT frame_id, coalesce(sum(w) FILTER (v >= 0.98), 0)/sum(w) AS saturated FROM nv GROUP BY 1),
  fb AS (SELECT frame_id, background, 1.4826*noise AS noise, saturated FROM bg JOIN no USING (frame_id) JOIN sa USING (frame_id))"""

AXIS = "(0, 1, 2, 3, 4, 5, 6, 7)"


def d22(s, sf):
    return rounded(q.detect_residual_lines(outliers(s, sf), 16, 64))


#: Same candidate lines in plain SQL: vote, best bin, inliers, span and density.
LINES = f"""WITH g AS ({F2}), o AS (SELECT frame_id, CAST(cell % 16 AS INT) AS x, CAST(cell // 16 AS INT) AS y FROM g WHERE value > (SELECT quantile_cont(value, 0.5) FROM g)),
  c AS (SELECT frame_id FROM o GROUP BY 1 HAVING count(*) BETWEEN 8 AND 102), p AS (SELECT * FROM o JOIN c USING (frame_id)),
  v0 AS (SELECT *, x*cos(a*pi()/180) + y*sin(a*pi()/180) AS rr FROM p CROSS JOIN (SELECT unnest(range(180)) AS a)),
  v AS (SELECT frame_id, a, CAST(sign(rr)*floor(abs(rr)+0.5) AS INT) AS rho, count(*) AS n FROM v0 GROUP BY ALL),
  b AS (SELECT frame_id, a, rho FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, a, rho) AS k FROM v WHERE n >= 8) WHERE k = 1),
  i AS (SELECT frame_id, a, rho, x, y, -x*sin(a*pi()/180) + y*cos(a*pi()/180) AS t FROM p JOIN b USING (frame_id) WHERE abs(x*cos(a*pi()/180) + y*sin(a*pi()/180) - rho) <= 0.6),
  s AS (SELECT frame_id, any_value(a) AS angle, any_value(rho) AS rho, count(*) AS samples, min(t) AS t0, max(t) AS t1, arg_min(x, t) AS fx, arg_min(y, t) AS fy, arg_max(x, t) AS lx, arg_max(y, t) AS ly FROM i GROUP BY 1)
  SELECT frame_id, CAST(angle AS INT) AS angle, rho, samples, {sr('fx+0.5', 'x1')}, {sr('fy+0.5', 'y1')}, {sr('lx+0.5', 'x2')}, {sr('ly+0.5', 'y2')} FROM s
  WHERE samples >= 8 AND t1 - t0 >= 12 AND samples/(t1-t0+1) >= 0.55"""

QUERIES = {
    "D16_frame_background": lambda s, sf: rounded(q.frame_background(f1(s, sf))),
    "D17_frame_score": d17,
    "D18_sequence_sample": lambda s, sf: rounded(q.sequence_sample(f1(s, sf), 8, 8)),
    "D19_temporal_residuals": lambda s, sf: rounded(q.temporal_residuals(f2(s, sf), f2_stats(s, sf), OPTIONS)),
    "D20_assess_frames": lambda s, sf: texts(rounded(assessed(s, sf))),
    "D20_check_selection": lambda s, sf: q.check_selection(assessed(s, sf)),
    "D21_select_reference": lambda s, sf: rounded(q.select_reference(f2_stats(s, sf))),
    "D22_detect_residual_lines": d22,
    "C17_apply_overrides": lambda s, sf: texts(rounded(selected(s, sf))),
    "B19_select_frames": lambda s, sf: texts(rounded(q.select_frames(selected(s, sf), "attention", "noise"))),
    "K2_review_order": lambda s, sf: q.review_order(selected(s, sf), "attention").select("frame_id", "selected"),
}

ORACLES = {
    "D16_frame_background": f"WITH {NORM} SELECT frame_id, {sr('background')}, {sr('noise')}, {sr('saturated')} FROM fb",
    "D17_frame_score": f"""WITH {NORM}, g AS (SELECT frame_id % 10 AS frame_id, avg(noise) AS noise, avg(saturated) AS saturated FROM fb GROUP BY 1),
      s AS (SELECT frame_id, count(*) AS n, quantile_cont(fwhm, 0.5) AS f, quantile_cont(eccentricity, 0.5) AS e FROM ({F3}) GROUP BY 1)
      SELECT g.frame_id, coalesce(n, 0) AS star_count, {sr('f', 'median_fwhm')}, {sr('e', 'median_eccentricity')},
      {sr('0.25*least(1, coalesce(n, 0)/100) + 0.25*coalesce(greatest(0, least(1, 4/(f+1))), 0) + 0.2*coalesce(greatest(0, least(1, 1-e)), 0) + 0.2*greatest(0, least(1, 1-8*noise)) + 0.1*greatest(0, least(1, 1-20*saturated))', 'score')}
      FROM g LEFT JOIN s ON s.frame_id = g.frame_id""",
    "D18_sequence_sample": f"""WITH g AS ({F1}), h AS (SELECT a.frame_id, CASE WHEN a.coverage >= 0.99 THEN a.value END AS v0, a.coverage AS c,
        CASE WHEN a.coverage >= 0.99 AND b.coverage >= 0.99 AND d.coverage >= 0.99 AND e.coverage >= 0.99 THEN (a.value - b.value - d.value + e.value)*0.5 END AS dt
        FROM g a LEFT JOIN g b ON b.frame_id=a.frame_id AND b.x=a.x+1 AND b.y=a.y LEFT JOIN g d ON d.frame_id=a.frame_id AND d.x=a.x AND d.y=a.y+1
        LEFT JOIN g e ON e.frame_id=a.frame_id AND e.x=a.x+1 AND e.y=a.y+1),
      m AS (SELECT frame_id, quantile_cont(v0, 0.5) AS sky, quantile_cont(dt, 0.5) AS md, sum(c)/64 AS vf, count(v0) >= 16 AND count(dt) >= 8 AS ok FROM h GROUP BY 1),
      n AS (SELECT frame_id, {MADF}*quantile_cont(abs(dt-md), 0.5) AS noise FROM h JOIN m USING (frame_id) GROUP BY 1)
      SELECT frame_id, {sr('CASE WHEN ok THEN sky END', 'sky')}, {sr('CASE WHEN ok THEN noise END', 'noise')}, {sr('vf', 'valid_fraction')},
      CASE WHEN NOT ok THEN 'InsufficientValidSamples' END AS error FROM m JOIN n USING (frame_id)""",
    "D19_temporal_residuals": f"""WITH {RESIDUAL} SELECT frame_id, compared, available, positive, negative, {sr('pf', 'positive_fraction')},
      {sr('nf', 'negative_fraction')}, {sr('rms')} FROM rs""",
    "D20_assess_frames": f"WITH {ASSESS} SELECT {COLS} FROM ov",
    "D20_check_selection": f"""WITH {ASSESS} SELECT count(*) FILTER (keep) AS kept, count(*) AS total,
      count(*) FILTER (keep) >= 3 AND count(*) FILTER (keep) >= 0.5*count(*) AS enough FROM ov""",
    "D21_select_reference": f"""WITH s AS (SELECT frame_id, valid_fraction*sqrt(star_count+1)*(1-0.5*eccentricity)/greatest(1, fwhm*fwhm)+1 AS score FROM ({F2_STATS}))
      SELECT frame_id, {sr('score')} FROM s ORDER BY s.score DESC, frame_id LIMIT 1""",
    "D22_detect_residual_lines": LINES,
    "C17_apply_overrides": f"WITH {ASSESS} SELECT {COLS}, override, selected FROM sl",
    "B19_select_frames": f"WITH {ASSESS} SELECT {COLS}, override, selected FROM sl WHERE len(rea) > 0 OR len(war) > 0",
    "K2_review_order": f"WITH {ASSESS} SELECT frame_id, selected FROM sl",
}

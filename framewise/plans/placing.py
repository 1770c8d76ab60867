"""Queries and oracles of resampling, drizzle, mosaics and coaddition."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import mosaic as m
from ..operators import stack as st
from .fixtures import F1, f1, f1_labelled, f3, F3, rounded, sr, table

T = ["a", "b", "c", "d", "dx", "dy"]


def transforms(s, sf):
    """A small rotation and shift per frame."""
    i = F.col("vec_id")
    return table(s, sf, "embeddings").select(
        i.alias("frame_id"), F.lit(0.96).alias("a"), F.lit(-0.1).alias("b"), F.lit(0.1).alias("c"), F.lit(0.98).alias("d"),
        ((i % 5).cast("double") * 0.3 - 0.45).alias("dx"), ((i % 3).cast("double") * 0.4 - 0.35).alias("dy"))


TRANSFORMS = """SELECT vec_id AS frame_id, CAST(0.96 AS DOUBLE) AS a, CAST(-0.1 AS DOUBLE) AS b, CAST(0.1 AS DOUBLE) AS c, CAST(0.98 AS DOUBLE) AS d,
  CAST(vec_id % 5 AS DOUBLE)*CAST(0.3 AS DOUBLE) - CAST(0.45 AS DOUBLE) AS dx, CAST(vec_id % 3 AS DOUBLE)*CAST(0.4 AS DOUBLE) - CAST(0.35 AS DOUBLE) AS dy FROM embeddings"""


def panels(s, sf):
    """One panel per label: the average of its frames."""
    rows = st.stack_average(f1_labelled(s, sf), ["label", "x", "y", "channel"])
    return rows.select(F.col("label").cast("bigint").alias("frame_id"), "x", "y", "channel", "value", "coverage")


PANELS = f"""SELECT CAST(label AS BIGINT) AS frame_id, x, y, channel, sum(CASE WHEN coverage > 1e-6 THEN value*coverage END)/sum(CASE WHEN coverage > 1e-6 THEN coverage END) AS value,
  sum(coverage)/count(*) AS coverage FROM ({F1}) JOIN (SELECT vec_id AS frame_id, label FROM embeddings) USING (frame_id) GROUP BY ALL"""


def panel_shifts(s, sf):
    return table(s, sf, "embeddings").select(F.col("label").cast("bigint").alias("frame_id")).distinct().select(
        "frame_id", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"),
        (F.col("frame_id") * 4.0).alias("dx"), F.lit(0.0).alias("dy"))


def placed(s, sf):
    p = panels(s, sf).withColumn("x", F.col("x") + (F.col("frame_id") * 4).cast("int"))
    return p.withColumn("after", F.col("value") + F.col("frame_id") * 0.01)


def sampled(p):
    """A caller's sampler for J3: half the value on a slope along x."""
    return p.withColumns({c: F.col(c) * 0.5 + F.col("x") * 0.25 for c in ("value", "after")})


def corrections(s, sf):
    order = [int(r["frame_id"]) for r in panel_shifts(s, sf).select("frame_id").orderBy("frame_id").collect()]
    p = panels(s, sf).withColumn("x", F.col("x") + (F.col("frame_id") * 4).cast("int"))
    p = p.withColumn("value", F.col("value") + F.col("x") * 0.5 + F.col("y"))
    return m.exposure_corrections(p, order)


def affine_stars(s, sf):
    t = f3(s, sf).select("frame_id").distinct().select(
        "frame_id", F.lit(0.96).alias("a"), F.lit(-0.1).alias("b"), F.lit(0.1).alias("c"), F.lit(0.98).alias("d"),
        (F.col("frame_id") * 1.5).alias("dx"), (F.col("frame_id") * -0.5).alias("dy"))
    return t


def round_trip(s, sf):
    t = affine_stars(s, sf)
    moved = m.apply_affine(f3(s, sf).select("frame_id", "star_id", "x", "y"), t)
    return rounded(m.apply_affine(moved, m.inverse_affine(t)))


def bayer(s, sf):
    return f1(s, sf).withColumn("value", F.when(F.col("coverage") > 0, F.col("value")))


def spectra(s, sf):
    """Values of F1 as given spectrum bins: re = value, im = value of the mirrored pixel (same row)."""
    rows = f1(s, sf)
    return rows.select("frame_id", "channel", F.col("x").alias("u"), F.col("y").alias("v"), F.col("value").alias("re"), (F.col("value") * 0.5).alias("im"),
                       F.exp(-(F.col("x") * 0.1)).alias("t_re"), (F.col("y") * 0.01).alias("t_im"), (F.lit(1.0) + F.col("x") % 3).alias("p"))


def coadd_frames(s, sf):
    return table(s, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), (F.lit(1.0) + F.col("vec_id") % 4).alias("flux"),
                                             (F.lit(0.5) + F.col("vec_id") % 3).alias("variance"))


def coadd(s, sf):
    sp = spectra(s, sf)
    halves = [m.frequency_coadd(sp.where(F.col("frame_id") % 2 == h), coadd_frames(s, sf)) for h in (0, 1)]
    return rounded(m.render_coadd(m.merge_coadds(*halves)).drop("frames"))


def coadd_fft(s, sf):
    sp = m.frame_spectra(f1(s, sf), 8, 8).withColumns({"t_re": F.lit(1.0), "t_im": F.lit(0.0), "p": F.lit(1.0)})
    return rounded(m.render_coadd(m.frequency_coadd(sp, coadd_frames(s, sf))))


def residual_rows(s, sf):
    return bayer(s, sf).select("frame_id", F.col("frame_id").alias("seq"), "x", "y", "channel", "value", F.col("coverage").alias("weight"),
                               (F.lit(0.1) + F.col("frame_id") % 4 * 0.05).alias("noise"))


def locations_sql_like(s, sf):
    """Plain weighted means per fold: the correlation part has an exact oracle on them."""
    rows = residual_rows(s, sf).where("value is not null and weight > 0")
    return rows.groupBy("x", "y", "channel", F.pmod(F.col("seq"), F.lit(3)).cast("int").alias("fold")).agg(
        (F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("location"), F.sum("weight").alias("weight"))


def cfa_frames(s, sf, skew: float):
    i = F.col("vec_id")
    return table(s, sf, "embeddings").select(
        i.alias("frame_id"), F.lit(1.0).alias("a"), F.lit(-skew).alias("b"), F.lit(skew).alias("c"), F.lit(1.0).alias("d"),
        ((i % 5).cast("double") * 0.3).alias("dx"), ((i % 3).cast("double") * 0.4).alias("dy"),
        F.array(F.lit(0.1), F.lit(0.0), F.lit(-0.1)).alias("background"), F.array(F.lit(1.1), F.lit(1.0), F.lit(0.9)).alias("gain"),
        (F.lit(1.0) + i % 2).alias("weight"))


QUERIES = {
    "B14_apply_affine": lambda s, sf: rounded(m.apply_affine(f3(s, sf).select("frame_id", "star_id", "x", "y"), affine_stars(s, sf))),
    "B14_inverse_affine": round_trip,
    "C20_resample_affine": lambda s, sf: rounded(m.resample_affine(f1(s, sf), transforms(s, sf), 8, 8, 9, 9)),
    "D42_feather_mosaic": lambda s, sf: rounded(m.feather_mosaic(panels(s, sf), panel_shifts(s, sf), 8, 8, 48, 8)),
    "D39_drizzle": lambda s, sf: rounded(m.drizzle(f1(s, sf), transforms(s, sf), 8, 8, 2, 0.7)),
    "D40_drizzle_mosaic": lambda s, sf: rounded(m.drizzle_mosaic(f1(s, sf), cfa_frames(s, sf, 0.0), 18, 18, scale=2.0, pixfrac=0.8)),
    "D40_drizzle_mosaic_rotated": lambda s, sf: rounded(m.drizzle_mosaic(f1(s, sf), cfa_frames(s, sf, 0.1), 18, 18, scale=2.0, pixfrac=0.8)),
    "D41_cell_average": lambda s, sf: rounded(m.extract_two_lines(bayer(s, sf), "cell-average")),
    "D41_red_grid": lambda s, sf: rounded(m.extract_two_lines(bayer(s, sf), "red-grid")),
    "C13_seam_pairs": lambda s, sf: rounded(m.seam_pairs(placed(s, sf))),
    "J3_sampled_seams": lambda s, sf: rounded(m.seam_pairs(placed(s, sf), sample=sampled)),
    "D29_seam_statistics": lambda s, sf: rounded(m.seam_statistics(
        m.with_totals(m.seam_pairs(placed(s, sf))), ["first", "second", "channel", "cell"], "first_after", "second_after")),
    "C14_exposure_corrections": lambda s, sf: rounded(corrections(s, sf)),
    "D43_frequency_coadd": coadd,
    "D43_frequency_coadd_fft": coadd_fft,
    "D38_fold_locations": lambda s, sf: rounded(m.fold_locations(residual_rows(s, sf))),
    "D38_fold_retention": lambda s, sf: rounded(m.fold_pattern(locations_sql_like(s, sf), minimum_samples=3, minimum_pixels=8, minimum_correlation=-1.0)[0]),
    "D38_fold_pattern": lambda s, sf: rounded(m.fold_pattern(locations_sql_like(s, sf), minimum_samples=3, minimum_pixels=8, minimum_correlation=-1.0)[1]),
}

INV = f"""(SELECT frame_id, d/(a*d-b*c) AS ia, -b/(a*d-b*c) AS ib, -c/(a*d-b*c) AS ic, a/(a*d-b*c) AS id, (b*dy-d*dx)/(a*d-b*c) AS idx, (c*dx-a*dy)/(a*d-b*c) AS idy FROM ({TRANSFORMS}))"""
COLOR = "CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN 0 WHEN x % 2 = 1 AND y % 2 = 1 THEN 2 ELSE 1 END"
LOC = f"""loc AS (SELECT x, y, channel, CAST(frame_id % 3 AS INT) AS fold, sum(value*coverage)/sum(coverage) AS l, sum(coverage) AS w FROM ({F1}) WHERE coverage > 0 GROUP BY ALL),
  fp AS (SELECT e.fold, a.x, a.y, a.channel, (a.y%2)*2 + a.x%2 AS phase, a.l AS a, b.l AS b, least(1, greatest(0, least(a.w, b.w) - 2)) AS t
    FROM (SELECT CAST(unnest(range(3)) AS INT) AS fold) e JOIN loc a ON a.fold = (e.fold+1)%3 JOIN loc b ON b.fold = (e.fold+2)%3 AND b.x=a.x AND b.y=a.y AND b.channel=a.channel),
  fw AS (SELECT *, t*t*(3-2*t) AS w FROM fp),
  fs AS (SELECT fold, phase, sum(w*a)/sum(w) AS ac, sum(w*b)/sum(w) AS bc, sum(w*a*a) - sum(w*a)*sum(w*a)/sum(w) AS va, sum(w*b*b) - sum(w*b)*sum(w*b)/sum(w) AS vb,
    sum(w*a*b) - sum(w*a)*sum(w*b)/sum(w) AS cov FROM fw GROUP BY 1, 2),
  fr AS (SELECT *, cov/sqrt(va*vb) AS corr, greatest(0, least(1, cov/(0.25*(va+vb+2*cov)))) AS ret FROM fs)"""
SEAMS = f"""pl AS (SELECT * REPLACE (CAST(x + frame_id*4 AS INT) AS x), value + frame_id*0.01 AS after FROM ({PANELS})),
  ov AS (SELECT a.frame_id AS f, b.frame_id AS s, a.x, a.y, a.channel, a.value AS fb, b.value AS sb, a.after AS fa, b.after AS sa FROM pl a JOIN pl b USING (x, y, channel) WHERE a.frame_id < b.frame_id),
  bx AS (SELECT f, s, min(x) AS x0, min(y) AS y0, max(x)+1-min(x) AS w, max(y)+1-min(y) AS h FROM ov GROUP BY 1, 2),
  pt AS (SELECT g.f, g.s, g.channel, g.x AS gx, g.y AS gy, count(*) AS n, list_sort(list(o.fb))[5] AS fb, list_sort(list(o.sb))[5] AS sb, list_sort(list(o.fa))[5] AS fa, list_sort(list(o.sa))[5] AS sa
    FROM ov g JOIN ov o ON o.f=g.f AND o.s=g.s AND o.channel=g.channel AND abs(o.x-g.x)<=1 AND abs(o.y-g.y)<=1 GROUP BY ALL HAVING count(*) = 9),
  pc AS (SELECT pt.*, CAST(least(3, (gy-y0)*4//h)*4 + least(3, (gx-x0)*4//w) AS INT) AS cell FROM pt JOIN bx USING (f, s))"""

SAMPLED = SEAMS.replace("  ov AS", "  ps AS (SELECT * REPLACE (value*0.5 + x*0.25 AS value, after*0.5 + x*0.25 AS after) FROM pl),\n  ov AS").replace("FROM pl a JOIN pl b", "FROM ps a JOIN ps b")


def exposure_sql() -> str:
    """Panels 0..9 corrected in order, one CTE per panel."""
    text = f"pl AS (SELECT frame_id, x + frame_id*4 AS x, y, channel, value + (x + frame_id*4)*0.5 + y AS v FROM ({PANELS}) WHERE coverage > 0.5), c0 AS (SELECT * FROM pl WHERE frame_id = 0)"
    seen = ["c0"]
    for i in range(1, 10):
        union = " UNION ALL ".join(f"SELECT x, y, channel, v FROM {c}" for c in seen)
        text += f""", b{i} AS (SELECT a.channel, a.v AS m, e.v AS r FROM pl a JOIN ({union}) e USING (x, y, channel) WHERE a.frame_id = {i}),
        g{i} AS (SELECT channel, greatest(0.5, least(2, covar_pop(r, m)/var_pop(m))) AS gain, 0.25*greatest(1, greatest(max(r), max(m)) - least(min(r), min(m))) AS lim FROM b{i} GROUP BY 1 HAVING count(*) >= 16),
        o{i} AS (SELECT channel, any_value(gain) AS gain, greatest(-any_value(lim), least(any_value(lim), list_sort(list(r - m*gain))[CAST(count(*)//2 AS BIGINT)+1])) AS off FROM b{i} JOIN g{i} USING (channel) GROUP BY 1),
        c{i} AS (SELECT pl.* REPLACE (v*coalesce(gain, 1) + coalesce(off, 0) AS v) FROM pl LEFT JOIN o{i} USING (channel) WHERE frame_id = {i})"""
        seen.append(f"c{i}")
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS frame_id, channel, {sr('gain')}, {sr('off', 'offset')} FROM o{i}" for i in range(1, 10))
    return f"WITH {text} {rows}"


ORACLES = {
    "B14_apply_affine": f"SELECT frame_id, star_id, {sr('0.96*x - 0.1*y + 1.5*frame_id', 'x')}, {sr('0.1*x + 0.98*y - 0.5*frame_id', 'y')} FROM ({F3})",
    "B14_inverse_affine": f"SELECT frame_id, star_id, {sr('x')}, {sr('y')} FROM ({F3})",
    "C20_resample_affine": f"""WITH s AS ({F1}), g AS (SELECT frame_id, CAST(ox AS INT) AS ox, CAST(oy AS INT) AS oy, ia*ox + ib*oy + idx AS sx, ic*ox + id*oy + idy AS sy
        FROM {INV} CROSS JOIN (SELECT unnest(range(9)) AS ox) CROSS JOIN (SELECT unnest(range(9)) AS oy)),
      k AS (SELECT g.*, s.channel, s.value, coverage*(1-abs(s.x-sx))*(1-abs(s.y-sy)) AS w FROM g JOIN s ON s.frame_id = g.frame_id AND abs(s.x-sx) < 1 AND abs(s.y-sy) < 1
        WHERE sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7)
      SELECT frame_id, ox AS x, oy AS y, channel, {sr('sum(w*value)/sum(w)', 'value')}, {sr('sum(w)', 'coverage')} FROM k GROUP BY ALL HAVING sum(w) > 1e-6""",
    "D42_feather_mosaic": f"""WITH p AS (SELECT x + 4*frame_id AS ox, x, y, channel, value, coverage, greatest(1e-4, least(1, least(x+1, y+1, 8-x, 8-y))) * coverage AS w FROM ({PANELS}) WHERE coverage > 1e-6)
      SELECT CAST(ox AS INT) AS x, y, channel, {sr('sum(value*w)/sum(w)', 'value')}, {sr('max(coverage)', 'coverage')} FROM p GROUP BY ox, y, channel""",
    "D39_drizzle": f"""WITH p AS (SELECT channel, value, coverage, (x+dx+0.5)*2 AS cx, (y+dy+0.5)*2 AS cy FROM ({F1}) JOIN ({TRANSFORMS}) USING (frame_id) WHERE coverage > 1e-6),
      o AS (SELECT p.*, gx, gy, coverage*greatest(0, least(cx+0.7, gx+1) - greatest(cx-0.7, gx))*greatest(0, least(cy+0.7, gy+1) - greatest(cy-0.7, gy)) AS w
        FROM p JOIN (SELECT unnest(range(16)) AS gx) ON gx > cx-1.7 AND gx < cx+0.7 JOIN (SELECT unnest(range(16)) AS gy) ON gy > cy-1.7 AND gy < cy+0.7)
      SELECT CAST(gx AS INT) AS x, CAST(gy AS INT) AS y, channel, {sr('sum(value*w)/sum(w)', 'value')}, {sr('sum(w)', 'weight')} FROM o WHERE w > 0 GROUP BY gx, gy, channel""",
    "D40_drizzle_mosaic": f"""WITH p AS (SELECT {COLOR} AS ch, value, coverage*(1 + frame_id % 2) AS w0, (x + 0.3*(frame_id % 5) + 0.5)*2 AS cx, (y + 0.4*(frame_id % 3) + 0.5)*2 AS cy FROM ({F1}) WHERE coverage > 1e-6),
      v AS (SELECT ch, cx, cy, w0/2.56 AS w0, CASE ch WHEN 0 THEN (value-0.1)*1.1 WHEN 1 THEN value ELSE (value+0.1)*0.9 END AS value FROM p),
      o AS (SELECT ch, value, gx, gy, w0*greatest(0, least(cx+0.8, gx+1) - greatest(cx-0.8, gx))*greatest(0, least(cy+0.8, gy+1) - greatest(cy-0.8, gy)) AS w
        FROM v JOIN (SELECT unnest(range(18)) AS gx) ON gx > cx-1.8 AND gx < cx+0.8 JOIN (SELECT unnest(range(18)) AS gy) ON gy > cy-1.8 AND gy < cy+0.8)
      SELECT CAST(gx AS INT) AS x, CAST(gy AS INT) AS y, CAST(ch AS INT) AS channel, {sr('sum(value*w)/sum(w)', 'value')}, {sr('sum(w)', 'weight')} FROM o WHERE w > 0 GROUP BY gx, gy, ch""",
    "D41_cell_average": f"""WITH s AS (SELECT *, {COLOR} AS k FROM ({F1}) WHERE coverage > 1e-6),
      c AS (SELECT f.frame_id, f.x, f.y, max(value) FILTER (k = 0) AS l0, CASE WHEN count(value) FILTER (k > 0) = 3 THEN avg(value) FILTER (k > 0) END AS l1
        FROM (SELECT DISTINCT frame_id, CAST(x//2 AS INT) AS x, CAST(y//2 AS INT) AS y FROM ({F1})) f LEFT JOIN s ON s.frame_id = f.frame_id AND s.x//2 = f.x AND s.y//2 = f.y GROUP BY ALL)
      SELECT frame_id, x, y, CAST(0 AS INT) AS channel, {sr('l0', 'value')}, CAST(CASE WHEN l0 IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS coverage FROM c UNION ALL
      SELECT frame_id, x, y, CAST(1 AS INT), {sr('l1', 'value')}, CAST(CASE WHEN l1 IS NULL THEN 0 ELSE 1 END AS DOUBLE) FROM c""",
    "D41_red_grid": f"""WITH s AS (SELECT frame_id, x, y, CASE WHEN coverage > 1e-6 THEN value END AS value FROM ({F1})),
      c AS (SELECT r.frame_id, CAST(r.x//2 AS INT) AS x, CAST(r.y//2 AS INT) AS y, any_value(r.value) AS l0, CASE WHEN count(n.value) FILTER (abs(n.x-r.x)+abs(n.y-r.y) = 1) = 4 AND count(n.value) FILTER (abs(n.x-r.x)+abs(n.y-r.y) = 2) = 4
          THEN (2*sum(n.value) FILTER (abs(n.x-r.x)+abs(n.y-r.y) = 1) + sum(n.value) FILTER (abs(n.x-r.x)+abs(n.y-r.y) = 2))/12 END AS l1
        FROM s r JOIN s n ON n.frame_id = r.frame_id AND abs(n.x-r.x) <= 1 AND abs(n.y-r.y) <= 1 WHERE r.x % 2 = 0 AND r.y % 2 = 0 GROUP BY r.frame_id, r.x, r.y)
      SELECT frame_id, x, y, CAST(0 AS INT) AS channel, {sr('l0', 'value')}, CAST(CASE WHEN l0 IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS coverage FROM c UNION ALL
      SELECT frame_id, x, y, CAST(1 AS INT), {sr('l1', 'value')}, CAST(CASE WHEN l1 IS NULL THEN 0 ELSE 1 END AS DOUBLE) FROM c""",
    "C13_seam_pairs": f"""WITH {SEAMS} SELECT f AS first, s AS second, channel, gx, gy, cell, {sr('fb', 'first_before')}, {sr('sb', 'second_before')}, {sr('fa', 'first_after')}, {sr('sa', 'second_after')} FROM pc""",
    "J3_sampled_seams": f"""WITH {SAMPLED} SELECT f AS first, s AS second, channel, gx, gy, cell, {sr('fb', 'first_before')}, {sr('sb', 'second_before')}, {sr('fa', 'first_after')}, {sr('sa', 'second_after')} FROM pc""",
    "D29_seam_statistics": f"""WITH {SEAMS}, z AS (SELECT f, s, channel, cell, fa, sa FROM pc UNION ALL SELECT f, s, channel, -1, fa, sa FROM pc),
      d AS (SELECT *, sa-fa AS d, list_sort(list(sa-fa) OVER w)[CAST(count(*) OVER w//2 AS BIGINT)+1] AS md FROM z WINDOW w AS (PARTITION BY f, s, channel, cell))
      SELECT f AS first, s AS second, channel, cell, count(*) AS samples, {sr('sqrt(avg(d*d))', 'rms')}, {sr('list_sort(list(fa))[CAST(count(*)//2 AS BIGINT)+1]', 'first_median')},
      {sr('list_sort(list(sa))[CAST(count(*)//2 AS BIGINT)+1]', 'second_median')}, {sr('any_value(md)', 'median_difference')}, {sr('list_sort(list(abs(d)))[CAST(ceil(0.95*count(*)) AS BIGINT)]', 'p95')},
      {sr('list_sort(list(abs(d-md)))[CAST(count(*)//2 AS BIGINT)+1]', 'mad')} FROM d GROUP BY f, s, channel, cell""",
    "C14_exposure_corrections": exposure_sql(),
    "D43_frequency_coadd": f"""WITH s AS (SELECT frame_id, channel, x AS u, y AS v, value AS re, value*0.5 AS im, exp(-(x*0.1)) AS tr, y*0.01 AS ti, 1.0 + x % 3 AS p, 1.0 + frame_id % 4 AS fl, 0.5 + frame_id % 3 AS va FROM ({F1})),
      g AS (SELECT channel, u, v, sum(fl*(tr*re + ti*im)/(va*p)) AS nr, sum(fl*(tr*im - ti*re)/(va*p)) AS ni, sum(fl*fl*(tr*tr+ti*ti)/(va*p)) AS inf FROM s GROUP BY ALL)
      SELECT channel, u, v, {sr('nr', 'num_re')}, {sr('ni', 'num_im')}, {sr('inf', 'information')}, {sr('nr/inf', 're')}, {sr('ni/inf', 'im')} FROM g""",
    "D38_fold_retention": f"WITH {LOC} SELECT fold, CAST(phase AS INT) AS phase, {sr('corr', 'correlation')}, {sr('ret', 'retention')} FROM fr",
    "D38_fold_pattern": f"""WITH {LOC} SELECT x, y, channel, fold, {sr('w*ret*0.5*(a - ac + b - bc)', 'correction')} FROM fw JOIN fr USING (fold, phase)""",
}

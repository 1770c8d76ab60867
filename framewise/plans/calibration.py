"""Queries and oracles of calibration and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate as cal
from ..operators import stack as st
from ..schema import PIXEL
from .fixtures import F1, f1, rounded, sr

PX = "x, y, channel"


def role(df, r):
    return df.where(F.col("frame_id") % 10 == r)


def masters(s, sf):
    df = f1(s, sf)
    flat = role(df, 3).withColumn("value", 1 + F.col("value"))
    avg = lambda d: st.stack_average(d, PIXEL).select(*PIXEL, "value", "coverage")
    return {"bias": avg(role(df, 1)), "dark": avg(role(df, 2)), "flat": avg(flat)}


def lights(s, sf):
    return f1(s, sf).where((F.col("frame_id") % 10 == 0) | (F.col("frame_id") % 10 > 3))


LIGHTS = f"SELECT * FROM ({F1}) WHERE frame_id % 10 = 0 OR frame_id % 10 > 3"


def avg_sql(r: int, name: str, shift: str = "0") -> str:
    return f"""SELECT {PX}, sum(CASE WHEN coverage > 1e-6 THEN (value+{shift})*coverage END)/sum(CASE WHEN coverage > 1e-6 THEN coverage END) AS {name},
      sum(coverage)/count(*) AS {name}_c FROM ({F1}) WHERE frame_id % 10 = {r} GROUP BY {PX}"""


MASTERS = f"""m AS (SELECT * FROM ({avg_sql(1, 'bias')}) JOIN ({avg_sql(2, 'dark')}) USING ({PX}) JOIN ({avg_sql(3, 'flat', '1')}) USING ({PX}))"""


def c1(s, sf):
    return rounded(cal.calibrate(lights(s, sf), **masters(s, sf), dark_bias_state="removed", flat_bias_state="included"))


def c2(s, sf):
    return rounded(cal.calibrate_sensor(lights(s, sf), **masters(s, sf), dark_bias_state="included", flat_bias_state="removed"))


def c2_counts(s, sf):
    return cal.calibration_counts(cal.calibrate_sensor(
        lights(s, sf), **masters(s, sf), dark_bias_state="included", flat_bias_state="removed"))


def d13(s, sf):
    df = f1(s, sf).withColumn("value", F.when(F.col("coverage") > 0, F.col("value")))
    flat = role(df, 3).withColumn("value", F.col("value") + 0.2)
    bias = masters(s, sf)["bias"]
    return cal.build_master(flat, "flat", "median", 5, bias=bias)


def reference(s, sf):
    df = f1(s, sf)
    return df.where("frame_id = 0")


FLAT13 = f"""SELECT frame_id, {PX}, CASE WHEN v > 0 THEN v END AS v, (y%2)*2 + x%2 AS ph FROM (
  SELECT frame_id, {PX}, CASE WHEN coverage > 0 THEN value + 0.2 END - bias AS v FROM ({F1}) JOIN ({avg_sql(1, 'bias')}) USING ({PX}) WHERE frame_id % 10 = 3)"""
D13 = f"""WITH f AS ({FLAT13}), m AS (SELECT frame_id, ph, avg(v) AS mean FROM f GROUP BY 1, 2),
  r AS (SELECT ph, min_by(mean, frame_id) AS first FROM m GROUP BY 1),
  g AS (SELECT {PX}, v*first/mean AS v FROM f JOIN m USING (frame_id, ph) JOIN r USING (ph)),
  o AS (SELECT {PX}, CASE WHEN count(v) >= 5 THEN quantile_cont(v, 0.5) END AS value, count(v) AS accepted, count(*) - count(v) AS missing FROM g GROUP BY {PX})"""

PAIRS = f"""p AS (SELECT a.frame_id, a.x, a.y, a.value AS v, b.value AS r FROM ({F1}) a JOIN (SELECT * FROM ({F1}) WHERE frame_id = 0 AND coverage > 1e-6) b
    USING (x, y) WHERE a.coverage > 1e-6),
  c AS (SELECT frame_id, quantile_cont(v, 0.5) AS bg, quantile_cont(r, 0.5) AS rbg FROM p GROUP BY 1),
  d AS (SELECT frame_id, any_value(bg) AS bg, any_value(rbg) AS rbg, 1.4826*quantile_cont(abs(v-bg), 0.5) AS sc, 1.4826*quantile_cont(abs(r-rbg), 0.5) AS rsc
    FROM p JOIN c USING (frame_id) GROUP BY 1),
  k AS (SELECT *, CASE WHEN rsc > 0 THEN greatest(1e-6, rsc)/greatest(1e-6, sc) ELSE 1 END AS gain FROM d)"""

#: C11 on a 3 x 2 grid of an 8 x 8 frame.
CELL = "((CASE WHEN y < 4 THEN 0 ELSE 1 END)*3 + CASE WHEN x < 2 THEN 0 WHEN x < 5 THEN 1 ELSE 2 END)"
GX, GY = "(((x+0.5)*3.0/8)-0.5)", "(((y+0.5)*2.0/8)-0.5)"



LOCAL = f"""cells AS (SELECT frame_id, {CELL} AS cell, quantile_cont(v, 0.5) AS a, quantile_cont(r, 0.5) AS b FROM p GROUP BY 1, 2),
  g AS (SELECT k.frame_id, CAST(t.cell AS INT) AS cell, coalesce(a, bg) AS a, coalesce(b, rbg) AS b
    FROM k CROSS JOIN (SELECT unnest(range(6)) AS cell) t LEFT JOIN cells ON cells.frame_id = k.frame_id AND cells.cell = t.cell),
  q AS (SELECT *, CAST(floor(greatest(0, least(2, {GX}))) AS INT) AS x0, CAST(floor(greatest(0, least(1, {GY}))) AS INT) AS y0 FROM ({F1})),
  h AS (SELECT q.*, greatest(0, least(1, {GX} - x0)) AS tx, greatest(0, least(1, {GY} - y0)) AS ty, least(x0+1, 2) AS x1, least(y0+1, 1) AS y1 FROM q),
  i AS (SELECT h.*, k.gain,
    (g00.a + (g10.a-g00.a)*tx) + ((g01.a + (g11.a-g01.a)*tx) - (g00.a + (g10.a-g00.a)*tx))*ty AS la,
    (g00.b + (g10.b-g00.b)*tx) + ((g01.b + (g11.b-g01.b)*tx) - (g00.b + (g10.b-g00.b)*tx))*ty AS lb
    FROM h JOIN k USING (frame_id)
    JOIN g g00 ON g00.frame_id = h.frame_id AND g00.cell = y0*3+x0 JOIN g g10 ON g10.frame_id = h.frame_id AND g10.cell = y0*3+x1
    JOIN g g01 ON g01.frame_id = h.frame_id AND g01.cell = y1*3+x0 JOIN g g11 ON g11.frame_id = h.frame_id AND g11.cell = y1*3+x1)"""

QUERIES = {
    "C1_calibrate": c1,
    "C2_calibrate_sensor": c2,
    "C2_calibration_counts": c2_counts,
    "D13_build_master": lambda s, sf: rounded(d13(s, sf)),
    "D13_master_totals": lambda s, sf: cal.master_totals(d13(s, sf)),
    "C10_match_reference": lambda s, sf: rounded(cal.match_reference(f1(s, sf), reference(s, sf))),
    "C11_match_reference_local": lambda s, sf: rounded(cal.match_reference_local(f1(s, sf), reference(s, sf), 3, 2, 8, 8)),
    "C12_match_background": lambda s, sf: rounded(cal.match_background(f1(s, sf), reference(s, sf))),
    "G3_common_coverage": lambda s, sf: rounded(cal.common_coverage(f1(s, sf), reference(s, sf))),
}

ORACLES = {
    "C1_calibrate": f"""WITH {MASTERS}, f AS (SELECT *, flat - bias AS fl FROM m),
      n AS (SELECT *, fl / (SELECT avg(fl) FROM f WHERE fl > 0 AND flat_c > 1e-6) AS nf FROM f),
      r AS (SELECT l.frame_id, {PX}, greatest(0, (l.value - dark - bias)/nf) AS v, least(l.coverage, dark_c, bias_c, flat_c) AS c, nf
        FROM ({LIGHTS}) l JOIN n USING ({PX}))
      SELECT frame_id, {PX}, {sr('CASE WHEN c > 1e-6 AND nf > 1e-6 THEN v END', 'value')},
        {sr('CASE WHEN c > 1e-6 AND nf > 1e-6 AND v IS NOT NULL THEN c ELSE 0 END', 'coverage')} FROM r""",
    "C2_calibrate_sensor": f"""WITH {MASTERS}, f AS (SELECT *, (y%2)*2 + x%2 AS ph FROM m),
      n AS (SELECT *, flat / avg(CASE WHEN flat > 0 THEN flat END) OVER (PARTITION BY ph) AS nf FROM f),
      r AS (SELECT l.frame_id, {PX}, CASE WHEN nf > 1e-6 THEN (l.value - dark)/nf END AS v FROM ({LIGHTS}) l JOIN n USING ({PX}))
      SELECT frame_id, {PX}, {sr('v', 'value')}, CAST(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END AS DOUBLE) AS coverage FROM r""",
    "C2_calibration_counts": f"""WITH {MASTERS}, f AS (SELECT *, (y%2)*2 + x%2 AS ph FROM m),
      n AS (SELECT *, flat / avg(CASE WHEN flat > 0 THEN flat END) OVER (PARTITION BY ph) AS nf FROM f),
      r AS (SELECT l.frame_id, {PX}, CASE WHEN nf > 1e-6 THEN (l.value - dark)/nf END AS v FROM ({LIGHTS}) l JOIN n USING ({PX}))
      SELECT frame_id, count(*) FILTER (v IS NULL) AS invalid, count(*) FILTER (v < 0) AS negative FROM r GROUP BY 1""",
    "D13_build_master": f"{D13} SELECT {PX}, {sr('value')}, accepted, missing FROM o",
    "D13_master_totals": f"{D13} SELECT count(*) FILTER (value IS NULL) AS invalid_pixels, CAST(sum(missing) AS BIGINT) AS missing_samples FROM o",
    "C10_match_reference": f"""WITH {PAIRS} SELECT frame_id, {PX}, {sr('CASE WHEN coverage > 1e-6 THEN (value - bg)*gain + rbg END', 'value')},
      CASE WHEN coverage > 1e-6 THEN coverage ELSE CAST(0 AS DOUBLE) END AS coverage FROM ({F1}) JOIN k USING (frame_id)""",
    "C11_match_reference_local": f"""WITH {PAIRS}, {LOCAL} SELECT frame_id, {PX}, {sr('CASE WHEN coverage > 1e-6 THEN (value - la)*gain + lb END', 'value')},
      CASE WHEN coverage > 1e-6 THEN coverage ELSE CAST(0 AS DOUBLE) END AS coverage FROM i""",
    "C12_match_background": f"""WITH s AS ({F1}), o AS (SELECT frame_id, channel, list_sort(list(value))[CAST(count(*)//2 AS BIGINT)+1] AS m FROM s WHERE coverage >= 0.99 GROUP BY 1, 2)
      SELECT frame_id, {PX}, {sr('CASE WHEN coverage > 0 THEN value + (SELECT m FROM o WHERE frame_id = 0) - m ELSE value END', 'value')}, coverage
      FROM s JOIN o USING (frame_id, channel)""",
    "G3_common_coverage": f"WITH {PAIRS} SELECT frame_id, x, y, {sr('v', 'value')}, {sr('r', 'ref')} FROM p",
}

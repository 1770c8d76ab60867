"""Queries and oracles of the background operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import background as b
from .fixtures import F1, F1C, f1, f1c, rounded, sql_mid, sr

POINTS = [(1.0, 1.0), (3.0, 3.0), (5.0, 2.0), (0.0, 4.0), (6.0, 6.0), (4.0, 5.0)]
POLY_POINTS = [(float(x), float(y)) for x in range(1, 7) for y in range(1, 7)]


def tilted(s, sf):
    """F1 on a slope, which the polynomial must find."""
    return f1(s, sf).withColumn("value", F.col("value") * 0.01 + F.col("x") * 2.0 - F.col("y") * 0.5 + 3.0)


def polynomial(s, sf):
    df = tilted(s, sf).withColumn("coverage", F.lit(1.0))
    samples = b.background_samples(df, POLY_POINTS, 1, 8, 8)
    fit = b.background_polynomial(samples, 1, 8, 8)
    return rounded(fit.select("frame_id", "channel", F.col("used"), *[F.get("coefficients", F.lit(i)).alias(f"c{i}") for i in range(3)]))


def poly_exact(s, sf):
    """A pure slope per frame: the fitted surface removes it exactly."""
    df = f1(s, sf).withColumn("value", F.col("frame_id") + F.col("x") * 2.0 - F.col("y") * 0.5).withColumn("coverage", F.lit(1.0))
    samples = b.background_samples(df, POLY_POINTS, 1, 8, 8)
    fit = b.background_polynomial(samples, 1, 8, 8)
    return rounded(b.apply_polynomial(df, fit, samples, 1, 8, 8, preserve_brightness=False))


def match(s, sf):
    """Frames against frame 0: ref = 2 * frame + 1 plus a little of their own."""
    base = f1(s, sf).where("frame_id = 0")
    ref = base.withColumn("value", F.col("x") * 3.0 + F.col("y") * 1.7 + F.col("value") * 0.01)
    df = f1(s, sf).join(ref.select("x", "y", F.col("value").alias("_r")), ["x", "y"]).withColumn(
        "value", (F.col("_r") - 1 - F.col("frame_id") % 5) / 2 + F.col("value") * 0.001).drop("_r")
    return df, ref


D31 = dict(width=8, height=8, minimum=16, candidates=40)


def d31(s, sf):
    df, ref = match(s, sf)
    return b.linear_match(df, ref, **D31)


def d31_regions(s, sf):
    df, ref = match(s, sf)
    return b.match_regions(df, ref, b.linear_match(df, ref, **D31), 8, 8)


IN_PATCH = "abs(x - px) <= 1 AND abs(y - py) <= 1"
PTS = "(VALUES " + ", ".join(f"({i}, {int(x)}, {int(y)})" for i, (x, y) in enumerate(POINTS)) + ") AS p(point_id, px, py)"
EXCL = "(x - 6)*(x - 6) + (y - 6)*(y - 6) <= 1"
CELL = "((CASE WHEN y < 4 THEN 0 ELSE 1 END)*3 + CASE WHEN x < 2 THEN 0 WHEN x < 5 THEN 1 ELSE 2 END)"
GX, GY = "(((x+0.5)*3.0/8)-0.5)", "(((y+0.5)*2.0/8)-0.5)"

#: A predicate that empties whole cells, so that filling is exercised.
HOLE = "(x < 2 AND y < 4) OR (x >= 5 AND y >= 4 AND (x + y) % 3 > 0)"

GRID = f"""WITH s AS ({F1}), v AS (SELECT *, {CELL} AS cell FROM s WHERE coverage > 1e-6 AND NOT ({HOLE})),
  n AS (SELECT frame_id, cell, count(*) AS n FROM v GROUP BY 1, 2),
  l0 AS ({sql_mid('v', 'frame_id, cell', 'value', 'coverage', {'lv': 0.25})}),
  l AS (SELECT frame_id, cell, lv FROM l0 JOIN n USING (frame_id, cell)
    WHERE n >= floor(((CASE cell % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 3 END)*4 + 3)/4)),
  f AS (SELECT frame_id, cell, lv FROM (SELECT a.frame_id, c.cell, l.lv, row_number() OVER (PARTITION BY a.frame_id, c.cell
      ORDER BY abs(l.cell % 3 - c.cell % 3) + abs(l.cell // 3 - c.cell // 3), l.cell) AS k
    FROM (SELECT DISTINCT frame_id FROM l) a CROSS JOIN (SELECT unnest(range(6)) AS cell) c JOIN l ON l.frame_id = a.frame_id) WHERE k = 1),
  q AS (SELECT *, CAST(floor(greatest(0, least(2, {GX}))) AS INT) AS x0, CAST(floor(greatest(0, least(1, {GY}))) AS INT) AS y0 FROM s),
  h AS (SELECT *, greatest(0, least(1, {GX} - x0)) AS tx, greatest(0, least(1, {GY} - y0)) AS ty, least(x0+1, 2) AS x1, least(y0+1, 1) AS y1 FROM q),
  i AS (SELECT h.*, (g00.lv + (g10.lv-g00.lv)*tx) + ((g01.lv + (g11.lv-g01.lv)*tx) - (g00.lv + (g10.lv-g00.lv)*tx))*ty AS bg FROM h
    JOIN f g00 ON g00.frame_id = h.frame_id AND g00.cell = y0*3+x0 JOIN f g10 ON g10.frame_id = h.frame_id AND g10.cell = y0*3+x1
    JOIN f g01 ON g01.frame_id = h.frame_id AND g01.cell = y1*3+x0 JOIN f g11 ON g11.frame_id = h.frame_id AND g11.cell = y1*3+x1)"""

QUERIES = {
    "D25_background_global": lambda s, sf: rounded(b.background_global(f1c(s, sf), "subtract", 0.8)),
    "D25_background_divide": lambda s, sf: rounded(b.background_global(f1c(s, sf), "divide", 0.5)),
    "D26_background_grid": lambda s, sf: rounded(b.background_grid(
        f1(s, sf), 3, 2, 8, 8, excluded=F.expr(HOLE), strength=0.9)),
    "D27_background_samples": lambda s, sf: rounded(b.background_samples(
        f1(s, sf), POINTS, 1, 8, 8, excluded=(F.col("x") - 6) * (F.col("x") - 6) + (F.col("y") - 6) * (F.col("y") - 6) <= 1)),
    "D28_background_polynomial": polynomial,
    "D28_polynomial_recovery": poly_exact,
    "D31_linear_match": d31,
    "D31_match_regions": d31_regions,
}

ORACLES = {
    "D25_background_global": f"""WITH s AS ({F1C}), m AS ({sql_mid('s', 'frame_id, channel', 'value', 'coverage', {'bg': 0.5})})
      SELECT frame_id, x, y, channel, {sr('value - 0.8*bg', 'value')}, coverage, {sr('bg', 'background')} FROM s JOIN m USING (frame_id, channel)""",
    "D25_background_divide": f"""WITH s AS ({F1C}), m AS ({sql_mid('s', 'frame_id, channel', 'value', 'coverage', {'bg': 0.5})})
      SELECT frame_id, x, y, channel, {sr('CASE WHEN bg > 1e-6 THEN value*0.5 + 0.5*value/bg END', 'value')}, coverage, {sr('bg', 'background')}
      FROM s JOIN m USING (frame_id, channel)""",
    "D26_background_grid": f"""{GRID} SELECT frame_id, x, y, channel, {sr('CASE WHEN coverage > 1e-6 THEN value - 0.9*bg END', 'value')},
      CASE WHEN coverage > 1e-6 THEN coverage ELSE CAST(0 AS DOUBLE) END AS coverage, {sr('bg', 'background')} FROM i""",
    "D27_background_samples": f"""WITH s AS ({F1}), c AS (SELECT DISTINCT frame_id, channel FROM s),
      m AS (SELECT point_id, frame_id, channel, max(CASE WHEN {EXCL} THEN 1 ELSE 0 END) AS ex, count(*) FILTER (NOT ({EXCL}) AND coverage >= 0.99) AS n,
        list_sort(list(value) FILTER (NOT ({EXCL}) AND coverage >= 0.99)) AS v FROM s JOIN {PTS} ON {IN_PATCH} GROUP BY ALL),
      t AS (SELECT point_id, frame_id, channel, px, py, n, v, CASE WHEN px < 1 OR py < 1 OR px + 1 >= 8 OR py + 1 >= 8 THEN 'edge' WHEN ex = 1 THEN 'excluded'
        WHEN coalesce(n, 0) < 7 THEN 'coverage' ELSE 'sampled' END AS status FROM c CROSS JOIN {PTS} LEFT JOIN m USING (point_id, frame_id, channel))
      SELECT point_id, frame_id, channel, px AS x, py AS y, status, {sr("CASE WHEN status = 'sampled' THEN v[CAST(n//2 AS BIGINT)+1] END", 'value')} FROM t""",
    "D28_polynomial_recovery": f"""SELECT frame_id, x, y, channel, CAST(1 AS DOUBLE) AS coverage, CAST(0 AS DOUBLE) AS value,
      {sr('frame_id + x*2.0 - y*0.5', 'model')} FROM ({F1})""",
}

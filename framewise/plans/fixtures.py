"""Views of the driver's tables in the engine's schemas, each with the same view as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dbl(c) -> Column:
    return (F.lit(c) if isinstance(c, (int, float)) else c).cast("double")


#: Added before rounding so that values lying exactly on a rounding boundary fall on one side.
NUDGE = 1e-9


def r6(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, for comparison with an oracle."""
    return df.select(*[r6(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scaled(c: str, digits: int) -> Column:
    """:func:`r6` by the arithmetic of the SQL side (scale, nearest whole number, halves away from zero, scale back), for results of
    very many rows: Spark's ``round`` goes through the decimal text of each number. For values far below 1e300."""
    scale = float(10**digits)
    y = (F.col(c).cast("double") + F.lit(NUDGE)) * scale
    whole = F.rint(y)
    return F.when(F.abs(y - whole) == 0.5, y + F.signum(y) * 0.5).otherwise(whole) / scale + F.lit(0.0)


def sr(expression: str, name: str | None = None, digits: int = 6) -> str:
    """SQL side of :func:`r6`."""
    return f"round(CAST({expression} AS DOUBLE) + CAST({NUDGE} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name or expression}"


# repeated measurements -------------------------------------------------------------------

def f0(spark, sf):
    li = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.select(
        F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("frame_id"),
        (F.row_number().over(order) - 1).alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"),
        dbl(1.0 - F.col("l_discount") * 5).alias("coverage"),
        dbl(1 + F.col("l_suppkey") % 4).alias("frame_weight"))


F0 = """
SELECT l_partkey AS k, l_suppkey AS frame_id,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) - 1 AS seq,
  l_extendedprice / l_quantity AS value, CAST(1.0 - l_discount*5 AS DOUBLE) AS coverage,
  CAST(1 + l_suppkey % 4 AS DOUBLE) AS frame_weight
FROM lineitem"""


def f0_plain(spark, sf, gaps: bool = False):
    """F0 without ``seq`` (no window needed)."""
    value = F.col("l_extendedprice") / F.col("l_quantity")
    if gaps:
        value = F.when(F.col("l_orderkey") % 13 != 0, value)
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("frame_id"), value.alias("value"),
        dbl(1.0 - F.col("l_discount") * 5).alias("coverage"),
        dbl(1 + F.col("l_suppkey") % 4).alias("frame_weight"))


def f0_gaps(spark, sf):
    """F0n: about every 13th sample missing."""
    return f0_plain(spark, sf, gaps=True)


F0N = """SELECT l_partkey AS k, l_suppkey AS frame_id, CASE WHEN l_orderkey % 13 <> 0 THEN l_extendedprice / l_quantity END AS value,
  CAST(1.0 - l_discount*5 AS DOUBLE) AS coverage, CAST(1 + l_suppkey % 4 AS DOUBLE) AS frame_weight FROM lineitem"""


# frames 8x8, one channel ---------------------------------------------------------------

def exploded(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("pos", "v"))


def f1(spark, sf):
    hit = (F.col("vec_id") * 31 + F.col("pos"))
    return exploded(spark, sf).select(
        F.col("vec_id").alias("frame_id"), F.expr("CAST(pos % 8 AS INT)").alias("x"),
        F.expr("CAST(pos div 8 AS INT)").alias("y"), F.lit(0).alias("channel"), dbl(F.col("v")).alias("value"),
        F.when(hit % 17 == 0, 0.5).when(hit % 29 == 0, 0.0).otherwise(1.0).alias("coverage"))


F1 = """
SELECT vec_id AS frame_id, CAST(pos % 8 AS INT) AS x, CAST(pos // 8 AS INT) AS y, CAST(0 AS INT) AS channel, CAST(v AS DOUBLE) AS value,
  CAST(CASE WHEN (vec_id*31+pos) % 17 = 0 THEN 0.5 WHEN (vec_id*31+pos) % 29 = 0 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS coverage
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding,1) - 1 AS pos FROM embeddings)"""


def f1_labelled(spark, sf):
    return f1(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), "label"), "frame_id")


# RGB frames 7x3 -----------------------------------------------------------------------

def f1c(spark, sf):
    """64 values are 21 pixels and a third; the first two values are used again to fill the last pixel, alone in its row."""
    whole = F.concat("embedding", F.slice("embedding", 1, 2))
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(whole).alias("pos", "v"))
    return rows.select(
        F.col("vec_id").alias("frame_id"), F.expr("CAST((pos div 3) % 7 AS INT)").alias("x"),
        F.expr("CAST(pos div 21 AS INT)").alias("y"), F.expr("CAST(pos % 3 AS INT)").alias("channel"),
        (0.5 + dbl(F.col("v"))).alias("value"), F.lit(1.0).alias("coverage"))


F1C = """
SELECT vec_id AS frame_id, CAST((pos // 3) % 7 AS INT) AS x, CAST(pos // 21 AS INT) AS y, CAST(pos % 3 AS INT) AS channel,
  CAST(0.5 AS DOUBLE) + CAST(v AS DOUBLE) AS value, CAST(1 AS DOUBLE) AS coverage
FROM (SELECT vec_id, unnest(e) AS v, generate_subscripts(e,1) - 1 AS pos FROM (SELECT vec_id, list_concat(embedding, embedding[1:2]) AS e FROM embeddings))"""

#: F1c pivoted: one row per pixel with columns r, g, b.
F1C_WIDE = f"""
SELECT frame_id, x, y, max(value) FILTER (channel = 0) AS r, max(value) FILTER (channel = 1) AS g,
  max(value) FILTER (channel = 2) AS b FROM ({F1C}) GROUP BY ALL"""


# days x users --------------------------------------------------------------------------

def f2(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy(F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("frame_id"),
                      F.col("user_id").alias("cell")).agg(
        F.avg("value").alias("value"), F.lit(1.0).alias("coverage"))


F2 = """
SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS frame_id, user_id AS cell,
  avg(value) AS value, CAST(1 AS DOUBLE) AS coverage FROM events GROUP BY 1, 2"""


def f2_events(spark, sf):
    return table(spark, sf, "events").select(
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("frame_id"), "event_type")


#: Frame statistics that need no order statistics, as SQL over F2 and events.
F2_STATS = f"""
SELECT frame_id, sky, noise, valid_fraction, star_count, fwhm, eccentricity FROM (
  SELECT m.frame_id, m.sky, m.noise, m.cells / (SELECT count(DISTINCT cell) FROM ({F2})) AS valid_fraction, m.fwhm
  FROM (SELECT frame_id, any_value(med) AS sky, quantile_cont(abs(value - med), 0.5) AS noise,
          CAST(count(*) AS DOUBLE) AS cells, 1 + stddev_samp(value) / 50 AS fwhm
        FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY frame_id) AS med FROM ({F2})) GROUP BY frame_id) m)
JOIN (SELECT CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS frame_id,
        count(*) FILTER (event_type = 'purchase') AS star_count,
        count(*) FILTER (event_type = 'error') / CAST(count(*) AS DOUBLE) AS eccentricity FROM events GROUP BY 1)
  USING (frame_id)"""


# stars ---------------------------------------------------------------------------------

def f3(spark, sf):
    e = lambda i: dbl(F.col("embedding")[i])
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("bigint").alias("frame_id"), F.col("vec_id").alias("star_id"),
        (500 + 1000 * e(0)).alias("x"), (500 + 1000 * e(1)).alias("y"),
        (1 + 1000 * F.abs(e(2))).alias("flux"), (1 + 10 * F.abs(e(3))).alias("fwhm"),
        F.least(F.lit(0.99), 3 * F.abs(e(4))).alias("eccentricity"),
        *[(1 + F.abs(e(5 + i))).alias(f"observed_{c}") for i, c in enumerate("rgb")],
        *[(1 + F.abs(e(8 + i))).alias(f"predicted_{c}") for i, c in enumerate("rgb")])


F3 = """
SELECT CAST(label AS BIGINT) AS frame_id, vec_id AS star_id,
  500 + 1000*CAST(embedding[1] AS DOUBLE) AS x, 500 + 1000*CAST(embedding[2] AS DOUBLE) AS y,
  1 + 1000*abs(CAST(embedding[3] AS DOUBLE)) AS flux, 1 + 10*abs(CAST(embedding[4] AS DOUBLE)) AS fwhm,
  least(CAST(0.99 AS DOUBLE), 3*abs(CAST(embedding[5] AS DOUBLE))) AS eccentricity,
  1 + abs(CAST(embedding[6] AS DOUBLE)) AS observed_r, 1 + abs(CAST(embedding[7] AS DOUBLE)) AS observed_g,
  1 + abs(CAST(embedding[8] AS DOUBLE)) AS observed_b,
  1 + abs(CAST(embedding[9] AS DOUBLE)) AS predicted_r, 1 + abs(CAST(embedding[10] AS DOUBLE)) AS predicted_g,
  1 + abs(CAST(embedding[11] AS DOUBLE)) AS predicted_b
FROM embeddings"""


def f3_moving(spark, sf):
    return f3(spark, sf).where("star_id % 9 <> 0").withColumns({
        "x": F.col("x") - 3 * F.col("frame_id"), "y": F.col("y") + 2 * F.col("frame_id")})


F3_MOVING = f"""
SELECT * REPLACE (x - 3*frame_id AS x, y + 2*frame_id AS y) FROM ({F3}) WHERE star_id % 9 <> 0"""


# catalog and panels --------------------------------------------------------------------

def f4_catalog(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), ((F.col("c_custkey") * dbl(137.508)) % 360).alias("ra"),
        ((F.col("c_custkey") * dbl(61.803)) % 160 - 80).alias("dec"), F.col("c_mktsegment").alias("type"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 1000).alias("magnitude"),
        dbl(F.col("c_custkey") % 30 + 1).alias("major_arcmin"), F.col("c_name").alias("label"))


F4_CATALOG = """
SELECT c_custkey AS id, CAST(c_custkey AS DOUBLE)*CAST(137.508 AS DOUBLE) % 360 AS ra,
  CAST(c_custkey AS DOUBLE)*CAST(61.803 AS DOUBLE) % 160 - 80 AS dec,
  c_mktsegment AS type, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal/1000 END AS magnitude,
  CAST(c_custkey % 30 + 1 AS DOUBLE) AS major_arcmin, c_name AS label FROM customer"""


def f4_panels(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("panel_id"), F.lit(500.5).alias("px"), F.lit(400.5).alias("py"),
        ((F.col("s_suppkey") * dbl(36.7)) % 360).alias("pra"),
        ((F.col("s_suppkey") * dbl(17.3)) % 140 - 70).alias("pdec"),
        F.array(F.lit(-0.02), F.lit(0.0), F.lit(0.0), F.lit(0.02)).alias("cd"),
        F.expr("CAST(array() AS ARRAY<STRUCT<i: INT, j: INT, a: DOUBLE, b: DOUBLE>>)").alias("sip"),
        F.lit(1000).alias("width"), F.lit(800).alias("height"))


F4_PANELS = """
SELECT s_suppkey AS panel_id, CAST(s_suppkey AS DOUBLE)*CAST(36.7 AS DOUBLE) % 360 AS pra,
  CAST(s_suppkey AS DOUBLE)*CAST(17.3 AS DOUBLE) % 140 - 70 AS pdec, CAST(0.02 AS DOUBLE) AS cd FROM supplier"""


# acquisition metadata ------------------------------------------------------------------

def f5_inputs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("frame_id"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("camera"),
        F.col("o_orderstatus").alias("filter"), (dbl(F.col("o_custkey") % 3) * 100).alias("gain"),
        ((dbl(F.col("o_totalprice")) % 40) - 20).alias("sensor_temperature"),
        dbl(30 * (1 + F.col("o_orderkey") % 4)).alias("exposure"), F.col("o_orderdate").alias("observed_at"))


F5_INPUTS = """
SELECT o_orderkey AS frame_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS camera, o_orderstatus AS filter,
  CAST(o_custkey % 3 AS DOUBLE)*100 AS gain, (CAST(o_totalprice AS DOUBLE) % 40) - 20 AS sensor_temperature,
  CAST(30*(1 + o_orderkey % 4) AS DOUBLE) AS exposure, o_orderdate AS observed_at FROM orders"""


def f5_masters(spark, sf):
    size = F.col("p_size")
    cameras = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    camera = F.element_at(F.array(*[F.lit(c) for c in cameras]), (size % 5 + 1).cast("int"))
    filters = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (size % 3 + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("master_id"), camera.alias("camera"), filters.alias("filter"),
        (dbl(F.col("p_partkey") % 3) * 100).alias("gain"),
        ((dbl(F.col("p_retailprice")) % 40) - 20).alias("sensor_temperature"),
        dbl(30 * (1 + F.col("p_partkey") % 4)).alias("exposure"))


F5_MASTERS = """
SELECT p_partkey AS master_id, CASE p_size % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS camera,
  CASE p_size % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS filter, CAST(p_partkey % 3 AS DOUBLE)*100 AS gain,
  (CAST(p_retailprice AS DOUBLE) % 40) - 20 AS sensor_temperature, CAST(30*(1 + p_partkey % 4) AS DOUBLE) AS exposure FROM part"""


# trails --------------------------------------------------------------------------------

def f6(spark, sf):
    u = F.col("user_id")
    x1, y1 = dbl(u % 20) * 40, dbl(u % 7) * 60
    return table(spark, sf, "events").select(
        F.col("event_id").alias("trail_id"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("frame_id"),
        F.col("event_type").alias("kind"), x1.alias("x1"), y1.alias("y1"), (x1 + F.col("value")).alias("x2"),
        (y1 + F.col("value") * dbl(0.1) * (u % 5)).alias("y2"), dbl(2 + u % 4).alias("width"),
        ((F.col("value") % 100) / 100).alias("weight"))


F6 = """
SELECT event_id AS trail_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS frame_id, event_type AS kind,
  CAST(user_id % 20 AS DOUBLE)*40 AS x1, CAST(user_id % 7 AS DOUBLE)*60 AS y1,
  CAST(user_id % 20 AS DOUBLE)*40 + value AS x2,
  CAST(user_id % 7 AS DOUBLE)*60 + value*CAST(0.1 AS DOUBLE)*(user_id % 5) AS y2,
  CAST(2 + user_id % 4 AS DOUBLE) AS width, (value % 100)/100 AS weight FROM events"""


# spectra -------------------------------------------------------------------------------

def f7(spark, sf):
    return exploded(spark, sf).select(
        F.col("vec_id").alias("source_id"), dbl(400 + 5 * F.col("pos")).alias("wavelength"),
        (1 + dbl(F.col("v"))).alias("flux"), (dbl(0.01) * (1 + F.col("vec_id") % 3)).alias("error"))


F7 = """
SELECT vec_id AS source_id, CAST(400 + 5*pos AS DOUBLE) AS wavelength, 1 + CAST(v AS DOUBLE) AS flux,
  CAST(0.01 AS DOUBLE)*(1 + vec_id % 3) AS error
FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding,1) - 1 AS pos FROM embeddings)"""


# F8: manifest ------------------------------------------------------------------------------

def f8(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    i = F.col("doc_id")
    split = F.when((i % 20 < 4) | ((i % 20 >= 12) & (i % 7 == 6)), "evaluation").otherwise("development")
    return d.join(l, "doc_id", "left").select(
        i.alias("case_id"), F.col("source").alias("grp"), split.alias("split"), F.sha2("text", 256).alias("sha"),
        F.col("quality").alias("minimum"), F.col("toxic").alias("maximum"), (F.col("n_chars") % 4).alias("observed"))


F8 = """
SELECT d.doc_id AS case_id, d.source AS grp, CASE WHEN d.doc_id % 20 < 4 OR (d.doc_id % 20 >= 12 AND d.doc_id % 7 = 6) THEN 'evaluation' ELSE 'development' END AS split,
  sha256(d.text) AS sha, l.quality AS minimum, l.toxic AS maximum, d.n_chars % 4 AS observed
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


# SQL building blocks -----------------------------------------------------------------------

def sql_mid(source: str, keys: str, value: str, weight: str, qs: dict[str, float]) -> str:
    """SQL for the mid-position weighted quantile: one row per key. ``keys`` is a comma list."""
    cols = []
    for name, q in qs.items():
        cols.append(f"""
  CASE WHEN min(p) FILTER (p >= {q}) IS NULL THEN max_by(v, p) FILTER (p < {q})
       WHEN max(p) FILTER (p < {q}) IS NULL THEN min_by(v, p) FILTER (p >= {q})
       ELSE max_by(v, p) FILTER (p < {q}) + (min_by(v, p) FILTER (p >= {q}) - max_by(v, p) FILTER (p < {q}))
         * (({q} - max(p) FILTER (p < {q})) / (min(p) FILTER (p >= {q}) - max(p) FILTER (p < {q}))) END AS {name}""")
    return f"""SELECT {keys}, {','.join(cols)} FROM (
  SELECT {keys}, {value} AS v, (sum({weight}) OVER (PARTITION BY {keys} ORDER BY {value}, {weight}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - {weight} / 2) / sum({weight}) OVER (PARTITION BY {keys}) AS p
  FROM {source} WHERE {value} IS NOT NULL) GROUP BY {keys}"""


def sql_wmed(source: str, keys: str, value: str, weight: str, name: str) -> str:
    """SQL for the weighted median by cumulative weight."""
    return f"""SELECT {keys}, CASE WHEN abs(min(c) FILTER (c >= h - e) - any_value(h)) <= any_value(e)
      AND min(v) FILTER (c > h + e) IS NOT NULL
      THEN (min_by(v, c) FILTER (c >= h - e) + min_by(v, c) FILTER (c > h + e)) / 2
      ELSE min_by(v, c) FILTER (c >= h - e) END AS {name} FROM (
  SELECT {keys}, {value} AS v, sum({weight}) OVER (PARTITION BY {keys} ORDER BY {value}, {weight}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum({weight}) OVER (PARTITION BY {keys}) / 2 AS h,
      greatest(1, sum({weight}) OVER (PARTITION BY {keys})) * 1e-12 AS e
  FROM {source} WHERE {value} IS NOT NULL) GROUP BY {keys}"""

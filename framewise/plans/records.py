"""Queries and oracles of sources, metadata, audits and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit, metadata as md
from ..operators import stack as st
from ..session import shared_dir
from ..sources import fits, tables
from ..streaming import live
from . import encode
from .fixtures import F1, F5_INPUTS, F5_MASTERS, F7, F8, dbl, f1, f5_inputs, f5_masters, f7, f8, rounded, sr, table
from .stacking import prep, stack_sql

# --- sources -----------------------------------------------------------------------------------


def embeddings(s, sf):
    return table(s, sf, "embeddings")


def a1(s, sf):
    h = fits.decode_headers(encode.image_files(embeddings(s, sf)))
    get = lambda c, k: F.try_element_at(F.col(c), F.lit(k))
    return h.select("path", "width", "height", "channels", "bitpix", get("text", "camera").alias("camera"), get("text", "units").alias("units"),
                    get("text", "sampling").alias("sampling"), get("numeric", "exposure").alias("exposure"), get("numeric", "gain").alias("gain"),
                    get("numeric", "sensorTemperature").alias("temperature"),
                    F.concat_ws(",", F.array_sort(F.transform("issues", lambda i: F.concat(i["field"], F.lit(":"), i["code"])))).alias("issues"))


def a2(s, sf):
    return rounded(fits.decode_samples(encode.image_files(embeddings(s, sf))).select("path", "x", "y", "channel", "value", "coverage"))


def a3(s, sf):
    return rounded(fits.decode_tables(encode.table_files(table(s, sf, "part")), ["price", "key"]).select("key", "price"))


def raw_catalog(s, sf):
    k = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return table(s, sf, "customer").select(
        F.concat(F.lit("NGC"), F.lpad(k.cast("string"), 10, "0")).alias("Name"), F.when(k % 11 == 0, "Dup").when(k % 2 == 0, "G").otherwise("PN").alias("Type"),
        F.concat_ws(":", two(k % 24), two(k % 60), F.lit("30.0")).alias("RA"), F.concat(F.when(k % 3 == 0, "-").otherwise("+"), two(k % 80), F.lit(":15:00")).alias("Dec"),
        (k % 30).cast("string").alias("MajAx"), F.when(k % 4 != 0, "1.5").alias("MinAx"), F.when(k % 5 != 0, (k % 400).cast("string")).alias("PosAng"),
        F.when(k % 3 == 0, "9.5").alias("V-Mag"), F.when(k % 2 == 0, "10.25").alias("B-Mag"), F.when(k % 50 == 0, two(k % 100)).alias("M"),
        F.lit(None).cast("string").alias("NGC"), F.when(k % 6 == 0, k.cast("string")).alias("IC"), F.lit("2MASX").alias("Identifiers"), F.lit(None).cast("string").alias("Common names"))


def a5(s, sf):
    k = F.col("c_custkey")
    ring = F.concat_ws("\n", F.concat(F.lit("X-Outlines-1 NGC"), k, F.lit(" 4")), *[F.concat((k % 300 + d).cast("string"), F.lit(" "), (k % 60 + e).cast("string")) for d, e in ((0, 0), (1, 0), (1, 1), (0, 0))],
                       F.concat(F.lit("IC9 3 1 1 2 2 3 3")))
    texts = table(s, sf, "customer").select(k.cast("string").alias("path"), ring.alias("text"))
    catalog = table(s, sf, "customer").where(k % 2 == 0).select(F.concat(F.lit("NGC"), k).alias("id"))
    return tables.parse_outlines(texts, catalog).drop("path")


def a6(s, sf):
    text = lambda f: F.concat(F.lit("("), F.array_join(F.transform("embedding", f), ","), F.lit(")"))
    raw = embeddings(s, sf).select(F.col("vec_id").cast("string").alias("source_id"), text(lambda v: (v.cast("double") + 1).cast("string")).alias("flux"),
                                   text(lambda v: F.abs(v.cast("double")).cast("string")).alias("flux_error"))
    return rounded(tables.parse_sampled_spectra(raw, 336.0, 2.0, 64)[0])


def a7_back(s, sf):
    long = tables.samples_from_arrays(embeddings(s, sf), "vec_id", "embedding", 8)
    packed = tables.samples_to_arrays(long, 8)
    return packed.select("frame_id", F.size("values").cast("bigint").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v) + 1e-9, 5).alias("total"))


def a8(s, sf):
    d = table(s, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return audit.inventory(d)


def preflight_frames(s, sf):
    k = F.col("o_orderkey")
    return table(s, sf, "orders").select(
        F.concat(F.lit("f"), F.when(k % 97 == 0, k - 1).otherwise(k)).alias("path"), k.alias("seq"), F.when(k % 10 == 9, "dark").otherwise("light").alias("role"),
        (k % 101 != 0).alias("available"), (k % 89 != 0).alias("readable"), (k % 83 == 0).alias("calibrated"),
        F.when(k % 79 == 0, 90).otherwise(100).alias("width"), F.lit(80).alias("height"), (k % 1000).alias("bytes"))


PREFLIGHT = """f AS (SELECT 'f' || CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS path, o_orderkey AS seq, CASE WHEN o_orderkey % 10 = 9 THEN 'dark' ELSE 'light' END AS role,
    o_orderkey % 101 <> 0 AS available, o_orderkey % 89 <> 0 AS readable, o_orderkey % 83 = 0 AS calibrated, CASE WHEN o_orderkey % 79 = 0 THEN 90 ELSE 100 END AS width, o_orderkey % 1000 AS bytes FROM orders),
  d AS (SELECT *, available AND seq > min(seq) OVER (PARTITION BY path) AS dup FROM f), u AS (SELECT *, available AND NOT dup AS usable FROM d),
  g AS (SELECT min_by(width, seq) AS gw FROM u WHERE usable AND readable AND role = 'light'),
  i AS (SELECT path, seq, role, unnest(list_filter([CASE WHEN NOT available THEN 'InputUnavailable' END, CASE WHEN dup THEN 'DuplicateInput' END, CASE WHEN usable AND NOT readable THEN 'HeaderUnavailable' END,
    CASE WHEN usable AND readable AND calibrated AND role = 'light' THEN 'AlreadyCalibrated' END, CASE WHEN usable AND readable AND width <> (SELECT gw FROM g) THEN 'GeometryMismatch' END], lambda z: z IS NOT NULL)) AS code FROM u)"""

# --- metadata ----------------------------------------------------------------------------------

COMMON = {"cameraSerial": "S1", "sampling": "mono", "domain": "linear", "units": "ADU", "readoutMode": "std"}
FIXED = {"binX": 1.0, "binY": 1.0, "originX": 0.0, "originY": 0.0, "offset": 10.0}


def acquisition(df, id_col, kind, extra_text=()):
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    texts = [pair("camera", F.col("camera")), pair("filter", F.col("filter")), pair("frameType", F.lit(kind)), *[pair(k, F.lit(v)) for k, v in COMMON.items()], *extra_text]
    numbers = [pair("gain", F.col("gain")), pair("exposure", F.col("exposure")), pair("sensorTemperature", F.col("sensor_temperature")), *[pair(k, F.lit(v)) for k, v in FIXED.items()]]
    known = lambda entries: F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))
    made = df.select(id_col, known(texts).alias("text"), known(numbers).alias("numeric"), F.lit(12).alias("width"), F.lit(10).alias("height"), F.lit(1).alias("channels"),
                     F.expr("CAST(array() AS ARRAY<STRUCT<field: STRING, code: STRING, message: STRING>>)").alias("issues"))
    # The maps are built once, in many tasks; without the shuffle the plan builds them anew for every field that is read.
    return made.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)


def inputs(s, sf):
    day = F.concat(F.date_format(F.date_trunc("year", "observed_at"), "yyyy-MM-dd"), F.lit("T00:00:00"))
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    target = F.when(F.col("frame_id") % 17 != 0, F.lit("M31"))
    return acquisition(f5_inputs(s, sf), "frame_id", "Light Frame", [pair("observedAt", day), pair("object", target)])


def masters(s, sf):
    return acquisition(f5_masters(s, sf), "master_id", "Master Dark")


TOL = 0.05
#: Status of an input/master pair under role dark; pairs meet on gain, exposure and filter.
PAIRS = f"""p AS (SELECT i.frame_id, m.master_id, i.camera AS ic, m.camera AS mc, abs(i.sensor_temperature - m.sensor_temperature) <= {TOL} AS near FROM ({F5_INPUTS}) i JOIN ({F5_MASTERS}) m USING (gain, exposure, filter)),
  q AS (SELECT *, CASE WHEN NOT near OR (ic IS NOT NULL AND ic <> mc) THEN 'incompatible' WHEN ic IS NULL THEN 'review' ELSE 'compatible' END AS status FROM p)"""
MEMBERS = f"""g AS (SELECT frame_id, CASE WHEN frame_id % 17 = 0 THEN CAST(frame_id AS VARCHAR) ELSE '' END || '|' || coalesce(camera, '') || '|' || filter || '|' || gain || '|' || exposure || '|' || year(observed_at) AS gid FROM ({F5_INPUTS})),
  gm AS (SELECT gid, min(frame_id) AS first_member, count(*) AS members FROM g GROUP BY 1)"""


def c3(s, sf):
    m = md.match_calibration(inputs(s, sf), masters(s, sf), "dark", TOL, ["filter"], ["gain", "exposure"])
    missing = F.filter("evidence", lambda e: e["status"] == "missing")
    return m.select("frame_id", "master_id", "status", F.concat_ws(",", F.transform(missing, lambda e: e["field"])).alias("missing"))


def plan(s, sf):
    """Groups are named by their first member, so that the pairs need no further join."""
    i = inputs(s, sf)
    members = md.group_acquisitions(i)[0]
    # A window over the members, so that their groups are not worked out a second time.
    members = members.select("frame_id", F.min("frame_id").over(Window.partitionBy("group_id")).alias("group_id"))
    a, b = md.calibration_plan(i, members, masters(s, sf), "dark", TOL, ["filter"], ["gain", "exposure"])
    return a.withColumnRenamed("group_id", "first_member"), b.withColumnRenamed("group_id", "group_first").select(
        "group_first", "master_id", "field", "issue", "count", "first_member")


def d15(s, sf):
    return md.group_acquisitions(inputs(s, sf))[1].select("first_member", "members")


def sets(s, sf):
    m = acquisition(f5_masters(s, sf), "master_id", "Dark Frame").withColumnRenamed("master_id", "frame_id")
    t = F.floor((F.try_element_at("numeric", F.lit("sensorTemperature")) + 20) / 8)
    return m.withColumn("set_id", F.col("frame_id") % 12 * 10 + t)


def d14(s, sf):
    return md.validate_master_inputs(sets(s, sf), "dark", 7.5)[0]


def d14_canonical(s, sf):
    rows = sets(s, sf).where(F.try_element_at("numeric", F.lit("exposure")).isNotNull()).withColumn(
        "text", F.map_filter("text", lambda k, v: ~k.isin("camera", "filter")))
    ok = md.validate_master_inputs(rows, "dark", 8.0)[1]
    n = lambda k: F.try_element_at("numeric", F.lit(k))
    return rounded(ok.select("set_id", "frames", n("sensorTemperatureMin").alias("t_min"), n("sensorTemperatureMax").alias("t_max"), n("sensorTemperature").alias("t_mid"), n("exposure").alias("exposure")))


SETS = f"SELECT CAST(master_id % 12 * 10 + floor((sensor_temperature + 20)/8) AS BIGINT) AS set_id, * FROM ({F5_MASTERS})"
D14_AGG = f"""a AS (SELECT set_id, count(*) AS n, count(DISTINCT camera) AS cams, count(DISTINCT gain) AS gains, max(exposure)-min(exposure) AS de, max(sensor_temperature)-min(sensor_temperature) AS dt,
    min(sensor_temperature) AS t0, max(sensor_temperature) AS t1, min(exposure) AS e FROM ({SETS}) GROUP BY 1)"""

# --- audits ------------------------------------------------------------------------------------


def c19(s, sf):
    i = F.col("doc_id")
    name = F.concat(F.lit("f"), F.expr("doc_id div 2"), F.when(i % 3 == 0, ".fits").when(i % 3 == 1, ".jpg").otherwise(".png"))
    return audit.drop_display_proxies(table(s, sf, "documents").select(name.alias("path"), i.alias("order")), order="order")


C19 = """WITH f AS (SELECT 'f' || (doc_id // 2) || CASE doc_id % 3 WHEN 0 THEN '.fits' WHEN 1 THEN '.jpg' ELSE '.png' END AS path, doc_id FROM documents),
  g AS (SELECT path, min(doc_id) AS "order", split_part(path, '.', 1) AS stem, split_part(path, '.', 2) AS ext FROM f GROUP BY path)
  SELECT path, "order" FROM g WHERE ext = 'fits' OR stem NOT IN (SELECT stem FROM g WHERE ext = 'fits')"""


def d45(s, sf):
    d = f8(s, sf)
    return audit.label_conformance(d.select("case_id", "observed"), d.select("case_id", "minimum", "maximum"))


# --- streams -----------------------------------------------------------------------------------


def stream_samples(s, sf):
    """lineitem as a stream of F0 samples (no ``seq``: a stream has no global order)."""
    batch = table(s, sf, "lineitem")
    rows = s.readStream.schema(batch.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    return rows.select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("frame_id"), F.col("l_orderkey"), F.col("l_linenumber"),
                       (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"), dbl(1.0 - F.col("l_discount") * 5).alias("coverage"),
                       dbl(1 + F.col("l_suppkey") % 4).alias("frame_weight"))


def place(s):
    return f"{shared_dir(s)}/framewise-{uuid.uuid4().hex}"


def run_live(s, sf, method, weight, identity=None):
    """Runs the whole stream while the query is built; the returned plan reads its result. With an identity every row comes
    twice, as a source that delivers at least once may do."""
    stream, folder = stream_samples(s, sf), place(s)
    if identity:
        stream = stream.unionByName(stream_samples(s, sf))
    o = {"weight": weight} if weight else {}
    live_df = live.live_stack_unique(stream, ["k"], identity, method, **o) if identity else live.live_stack(stream, ["k"], method, **o)
    live.keep_latest(live_df, ["k"], folder, "live").awaitTermination()
    return rounded(live.latest(s, folder, "live", live_df.schema, ["k"]))


def run_robust(s, sf):
    folder = place(s)
    live.live_robust(stream_samples(s, sf), ["k"], folder, "robust", "winsorized", low=2.0, high=2.0, weight="frame_weight").awaitTermination()
    schema = st.stack(s.createDataFrame([], "k bigint, frame_id bigint, value double, coverage double"), ["k"], "winsorized", hot=[]).schema
    return rounded(live.latest(s, folder, "robust-result", schema, ["k"]))


QUERIES = {
    "A1_frame_headers": a1, "A2_frame_samples": a2, "A3_numeric_table": a3,
    "A4_object_catalog": lambda s, sf: rounded(tables.parse_object_catalog(raw_catalog(s, sf))[0]),
    "A4_catalog_problems": lambda s, sf: tables.parse_object_catalog(raw_catalog(s, sf).union(raw_catalog(s, sf).where("Type = 'G'")))[1],
    "A5_outlines": a5, "A6_sampled_spectra": a6,
    "A7_samples_from_arrays": lambda s, sf: rounded(tables.samples_from_arrays(embeddings(s, sf), "vec_id", "embedding", 4, 2)),
    "A7_samples_to_arrays": a7_back, "A8_file_inventory": a8,
    "A9_preflight_issues": lambda s, sf: md.preflight_report(preflight_frames(s, sf))[0],
    "A9_preflight_totals": lambda s, sf: md.preflight_report(preflight_frames(s, sf))[1],
    "C3_match_calibration": c3, "C4_calibration_plan": lambda s, sf: plan(s, sf)[0], "C4_plan_issues": lambda s, sf: plan(s, sf)[1],
    "D14_validate_master_inputs": d14, "D14_canonical": d14_canonical, "D15_group_acquisitions": d15,
    "C19_drop_display_proxies": c19, "D44_split_leakage": lambda s, sf: audit.split_leakage(f8(s, sf)),
    "D45_label_conformance": lambda s, sf: d45(s, sf)[0], "D45_label_totals": lambda s, sf: d45(s, sf)[1],
    "I1_live_average": lambda s, sf: run_live(s, sf, "average", "frame_weight"), "I1_live_max": lambda s, sf: run_live(s, sf, "max", None),
    "I2_live_unique": lambda s, sf: run_live(s, sf, "average", "frame_weight", ["k", "frame_id", "l_orderkey", "l_linenumber"]),
    "I3_live_robust": run_robust,
}

ID = "SELECT c_custkey AS k FROM customer"
ORACLES = {
    "A1_frame_headers": """SELECT 'frame-' || vec_id || '.fits' AS path, CAST(8 AS INT) AS width, CAST(8 AS INT) AS height, CAST(1 AS INT) AS channels, CAST(-64 AS INT) AS bitpix, 'CAM' || label AS camera, 'ADU' AS units,
      CASE WHEN vec_id % 2 = 1 THEN 'CFA:GRBG' ELSE 'CFA:RGGB' END AS sampling, CASE WHEN vec_id % 7 <> 0 THEN CAST(30*(1 + vec_id % 4) AS DOUBLE) END AS exposure,
      CASE WHEN vec_id % 5 <> 0 THEN CAST(vec_id % 3 * 100 AS DOUBLE) END AS gain, CAST(vec_id % 20 - 10 AS DOUBLE) AS temperature,
      concat_ws(',', CASE WHEN vec_id % 7 = 0 THEN 'exposure:conflict' END, CASE WHEN vec_id % 5 = 0 THEN 'gain:invalid' END) AS issues FROM embeddings""",
    "A2_frame_samples": f"""SELECT 'frame-' || frame_id || '.fits' AS path, x, y, channel, {sr('value*2 + 1', 'value')}, CAST(1 AS DOUBLE) AS coverage FROM ({F1})""",
    "A3_numeric_table": f"SELECT CAST(p_partkey AS DOUBLE) AS key, {sr('p_retailprice', 'price')} FROM part",
    "A4_object_catalog": f"""SELECT 'NGC' || lpad(CAST(k AS VARCHAR), 10, '0') AS id,
      CASE WHEN k % 50 = 0 THEN 'M ' || CASE WHEN k % 100 = 0 THEN '0' ELSE '50' END || ' / ' ELSE '' END || 'NGC ' || k AS label, CASE WHEN k % 2 = 0 THEN 'G' ELSE 'PN' END AS type,
      {sr('15*(k % 24 + (k % 60)/60 + 30/3600)', 'ra')}, {sr('(k % 80 + 0.25)*CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END', 'dec')}, CAST(k % 30 AS DOUBLE) AS major_arcmin,
      CAST(CASE WHEN k % 4 <> 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS minor_arcmin, CASE WHEN k % 5 <> 0 AND k % 400 < 360 THEN CAST(k % 400 % 180 AS DOUBLE) END AS position_angle,
      k % 5 <> 0 AND k % 400 >= 360 AS invalid_position_angle, CAST(CASE WHEN k % 3 = 0 THEN 9.5 WHEN k % 2 = 0 THEN 10.25 END AS DOUBLE) AS magnitude,
      CASE WHEN k % 3 = 0 THEN 'V' WHEN k % 2 = 0 THEN 'B' END AS magnitude_band, '' AS common_names,
      concat_ws(',', '2MASX', CASE WHEN k % 50 = 0 THEN 'M ' || CASE WHEN k % 100 = 0 THEN '0' ELSE '50' END END, CASE WHEN k % 6 = 0 THEN 'IC' || k END) AS aliases FROM ({ID}) WHERE k % 11 <> 0""",
    "A4_catalog_problems": f"SELECT 'NGC' || lpad(CAST(k AS VARCHAR), 10, '0') AS id, 'duplicate' AS problem FROM ({ID}) WHERE k % 11 <> 0 AND k % 2 = 0",
    "A5_outlines": f"""SELECT 'NGC' || k AS id, CAST(0 AS INT) AS contour_no, CAST(n AS INT) AS point_no, CAST(k % 300 + [0, 1, 1, 0][n+1] AS DOUBLE) AS ra, CAST(k % 60 + [0, 0, 1, 0][n+1] AS DOUBLE) AS dec
      FROM ({ID}) CROSS JOIN (SELECT unnest(range(4)) AS n) WHERE k % 2 = 0""",
    "A6_sampled_spectra": f"""SELECT CAST(vec_id AS VARCHAR) AS source_id, CAST(336 + 2*pos AS DOUBLE) AS wavelength, {sr('1 + v', 'flux')}, {sr('abs(v)', 'error')}
      FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding,1) - 1 AS pos FROM embeddings)""",
    "A7_samples_from_arrays": f"""SELECT vec_id AS frame_id, CAST((pos//2) % 4 AS INT) AS x, CAST(pos//8 AS INT) AS y, CAST(pos % 2 AS INT) AS channel, {sr('v', 'value')}
      FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding,1) - 1 AS pos FROM embeddings)""",
    "A7_samples_to_arrays": "SELECT vec_id AS frame_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) + 1e-9, 5) AS total FROM embeddings",
    "A8_file_inventory": """WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha FROM documents)
      SELECT path, bytes, sha, count(*) OVER (PARTITION BY sha) AS content_copies, count(*) OVER (PARTITION BY path) AS path_copies FROM f""",
    "A9_preflight_issues": f"WITH {PREFLIGHT} SELECT path, seq, role, code FROM i",
    "A9_preflight_totals": f"""WITH {PREFLIGHT} SELECT count(*) AS inputs, count(*) FILTER (usable AND readable) AS inspected, CAST(sum(bytes) FILTER (usable) AS BIGINT) AS source_bytes, (SELECT count(*) FROM i) AS issues,
      count(*) FILTER (role = 'light') AS lights, CAST(max(width*80*16) FILTER (usable AND readable) AS BIGINT) AS largest_frame, (SELECT count(*) FROM i) = 0 AS complete, CAST(NULL AS BIGINT) AS temporary_bytes FROM u""",
    "C3_match_calibration": f"WITH {PAIRS} SELECT frame_id, master_id, status, CASE WHEN ic IS NULL THEN 'camera' ELSE '' END AS missing FROM q WHERE status <> 'incompatible'",
    "C4_calibration_plan": f"""WITH {PAIRS}, {MEMBERS}, c AS (SELECT gid, master_id, count(*) FILTER (status='compatible') AS compatible, count(*) FILTER (status='review') AS review, count(*) FILTER (status='incompatible') AS incompatible
        FROM q JOIN g USING (frame_id) GROUP BY 1, 2)
      SELECT first_member, master_id, compatible, review, incompatible, CASE WHEN incompatible > 0 THEN 'incompatible' WHEN review > 0 THEN 'review' ELSE 'compatible' END AS status FROM c JOIN gm USING (gid)""",
    "C4_plan_issues": f"""WITH {PAIRS}, {MEMBERS}, e AS (SELECT frame_id, master_id, unnest(list_filter([CASE WHEN ic IS NULL THEN 'camera|missing' WHEN ic <> mc THEN 'camera|conflict' END, CASE WHEN NOT near THEN 'sensorTemperature|conflict' END], lambda z: z IS NOT NULL)) AS z FROM q)
      SELECT gf AS group_first, master_id, split_part(z, '|', 1) AS field, split_part(z, '|', 2) AS issue, count(*) AS count, min(frame_id) AS first_member FROM e JOIN g USING (frame_id) JOIN (SELECT gid, first_member AS gf FROM gm) USING (gid) GROUP BY ALL""",
    "D14_validate_master_inputs": f"""WITH {D14_AGG} SELECT set_id, 'camera' AS field, 'conflict' AS code FROM a WHERE cams > 1 UNION ALL SELECT set_id, 'gain', 'conflict' FROM a WHERE gains > 1
      UNION ALL SELECT set_id, 'exposure', 'conflict' FROM a WHERE de > 1e-6 UNION ALL SELECT set_id, 'sensorTemperature', 'spread' FROM a WHERE dt > 7.5 UNION ALL SELECT set_id, 'frames', 'too-few' FROM a WHERE n < 2""",
    "D14_canonical": f"""WITH {D14_AGG} SELECT set_id, n AS frames, {sr('t0', 't_min')}, {sr('t1', 't_max')}, {sr('(t0+t1)/2', 't_mid')}, {sr('e', 'exposure')} FROM a WHERE gains = 1 AND de <= 1e-6 AND n >= 2""",
    "D15_group_acquisitions": f"WITH {MEMBERS} SELECT first_member, members FROM gm",
    "C19_drop_display_proxies": C19,
    "D44_split_leakage": f"""WITH m AS ({F8}) SELECT 'group-crosses-splits' AS rule, grp AS subject, count(DISTINCT split) AS count FROM m GROUP BY grp HAVING count(DISTINCT split) > 1
      UNION ALL SELECT 'duplicate-id', CAST(case_id AS VARCHAR), count(*) FROM m GROUP BY case_id HAVING count(*) > 1 UNION ALL SELECT 'duplicate-content', sha, count(*) FROM m GROUP BY sha HAVING count(*) > 1
      UNION ALL SELECT 'bounds-missing', CAST(case_id AS VARCHAR), 1 FROM m WHERE minimum IS NULL AND maximum IS NULL UNION ALL SELECT 'bounds-inverted', CAST(case_id AS VARCHAR), 1 FROM m WHERE minimum > maximum""",
    "D45_label_conformance": f"""WITH m AS ({F8}), v AS (SELECT case_id, observed, CASE WHEN observed < minimum THEN 'below-minimum' WHEN observed > maximum THEN 'above-maximum' END AS reason FROM m)
      SELECT case_id, observed, reason IS NULL AS passed, reason FROM v""",
    "D45_label_totals": f"""WITH m AS ({F8}) SELECT count(*) FILTER (coalesce(observed >= minimum, true) AND coalesce(observed <= maximum, true)) AS passed,
      count(*) FILTER (NOT (coalesce(observed >= minimum, true) AND coalesce(observed <= maximum, true))) AS failed, count(observed) AS processed, count(*) AS cases FROM m""",
    "I1_live_average": f"WITH s AS ({prep()}) SELECT k, {sr('sum(v*w)/sum(w)', 'value')}, {sr('sum(cw)/sum(fw)', 'coverage')}, count(v) AS samples FROM s GROUP BY k",
    "I2_live_unique": f"WITH s AS ({prep()}) SELECT k, {sr('sum(v*w)/sum(w)', 'value')}, {sr('sum(cw)/sum(fw)', 'coverage')}, count(v) AS samples FROM s GROUP BY k",
    "I1_live_max": f"WITH s AS ({prep()}) SELECT k, {sr('max(v)', 'value')}, {sr('avg(coverage)', 'coverage')}, count(v) AS samples FROM s GROUP BY k",
    "I3_live_robust": stack_sql("winsorized", 2.0, 2.0),
}

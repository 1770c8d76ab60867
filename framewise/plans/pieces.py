"""Small functions and extension points on the tables, each with its own entry."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalars as h
from ..session import shared_dir
from ..sources import fits, tables
from .fixtures import F1, F3, F6, dbl, f1, f3, f6, rounded, sr, table


def separation(s, sf):
    ra, dec = dbl(F.col("c_custkey") % 360), dbl(F.col("c_custkey") % 170) - 85
    return rounded(table(s, sf, "customer").select("c_custkey", h.angular_separation(ra, dec, ra + 1.5, dec - 0.5).alias("degrees")))


def sensor(s, sf):
    return f1(s, sf).groupBy(h.bayer_color("RGGB", F.col("x"), F.col("y")).alias("color"), h.bayer_phase(F.col("x"), F.col("y")).alias("phase")).agg(F.count("*").alias("n"))


def boxes(s, sf):
    """Every trail's box against the same box moved by a fifth of its size."""
    w, t = F.abs(F.col("x2") - F.col("x1")) + 1, F.abs(F.col("y2") - F.col("y1")) + 1
    return rounded(f6(s, sf).select("trail_id", h.iou(F.col("x1"), F.col("y1"), w, t, F.col("x1") + w / 5, F.col("y1") + t / 5, w, t).alias("iou")))


def angles(s, sf):
    a = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    return rounded(f6(s, sf).select("trail_id", h.angle_delta(a, F.lit(1.0)).alias("delta"), h.interval_overlap(F.col("x1"), F.col("x2"), F.lit(100.0), F.lit(300.0)).alias("shared")))


def written(s, sf):
    """Writes the parts by brand in the shared folder and reads them again."""
    folder = f"{shared_dir(s)}/framewise-{uuid.uuid4().hex}"
    tables.write_result(table(s, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), folder, ["p_brand"])
    return rounded(s.read.parquet(folder).select("p_partkey", F.col("p_brand").cast("string").alias("p_brand"), "p_retailprice"))


#: Bytes of a text that make one sample, samples in a row, and rows in a batch.
GROUP, ROW, BATCH = 64, 32, 256


def letters(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    """A frame with one sample for each ``GROUP`` bytes of a text, the sum of them, in batches of whole rows."""
    step = GROUP * ROW * BATCH
    for at in range(0, len(content), step):
        part = np.frombuffer(content, np.uint8, min(step, len(content) - at), at)
        sums = np.add.reduceat(part.astype(np.int64), np.arange(0, len(part), GROUP))
        place = np.arange(len(sums)) + at // GROUP
        yield pd.DataFrame({"x": place % ROW, "y": place // ROW, "channel": 0, "value": sums.astype(float), "coverage": 1.0})


def own_format(s, sf):
    files = table(s, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return fits.frames_with(files, letters).groupBy("x").agg(F.count("*").alias("n"), F.max("y").alias("last_row"), F.sum("value").alias("total"))


QUERIES = {
    "H6_angular_separation": separation,
    "H7_bayer_color": sensor,
    "H9_grid_cell": lambda s, sf: f3(s, sf).groupBy(h.region16(F.col("x"), F.col("y"), 1400, 1400).alias("region"), h.grid_cell(F.floor("x").cast("int"), 1400, 5).alias("cell")).agg(F.count("*").alias("n")),
    "H10_smoothstep": lambda s, sf: rounded(f1(s, sf).select("frame_id", "x", "y", h.smoothstep(-0.2, 0.3, F.col("value")).alias("s"))),
    "H11_feather_weight": lambda s, sf: rounded(f1(s, sf).groupBy("x", "y").agg(F.first(h.feather_weight(F.col("x"), F.col("y"), 8, 8, 0.3)).alias("w"), F.count("*").alias("n"))),
    "H12_iou": boxes,
    "H13_angle_delta": angles,
    "A10_write_result": written,
    "J1_own_format": own_format,
}

RA, DEC = "CAST(c_custkey % 360 AS DOUBLE)", "(CAST(c_custkey % 170 AS DOUBLE) - 85)"
BW, BH = "(abs(x2-x1)+1)", "(abs(y2-y1)+1)"
ORACLES = {
    "H6_angular_separation": f"""SELECT c_custkey, {sr(f"degrees(2*asin(sqrt(pow(sin(radians(0.5)/2), 2) + cos(radians({DEC}))*cos(radians({DEC} - 0.5))*pow(sin(radians(-1.5)/2), 2))))", 'degrees')} FROM customer""",
    "H7_bayer_color": f"SELECT CAST([0, 1, 1, 2][(y % 2)*2 + x % 2 + 1] AS INT) AS color, CAST((y % 2)*2 + x % 2 AS INT) AS phase, count(*) AS n FROM ({F1}) GROUP BY 1, 2",
    "H9_grid_cell": f"""SELECT CAST(greatest(0, least(3, floor(y*4/1400)))*4 + greatest(0, least(3, floor(x*4/1400))) AS INT) AS region,
      CAST(least(4, floor(((floor(x)+1)*5-1)/1400)) AS INT) AS cell, count(*) AS n FROM ({F3}) GROUP BY 1, 2""",
    "H10_smoothstep": f"SELECT frame_id, x, y, {sr('t*t*(3-2*t)', 's')} FROM (SELECT *, greatest(0, least(1, (value + 0.2)/0.5)) AS t FROM ({F1}))",
    "H11_feather_weight": f"SELECT x, y, {sr('any_value(greatest(1e-4, least(1, least(x+1, y+1, 8-x, 8-y)/2.4)))', 'w')}, count(*) AS n FROM ({F1}) GROUP BY x, y",
    "H12_iou": f"SELECT trail_id, {sr(f'(0.8*{BW})*(0.8*{BH})/(2*{BW}*{BH} - (0.8*{BW})*(0.8*{BH}))', 'iou')} FROM ({F6})",
    "H13_angle_delta": f"""SELECT trail_id, {sr('least(d, pi() - d)', 'delta')}, {sr('greatest(0, least(greatest(x1, x2), 300) - greatest(least(x1, x2), 100))', 'shared')}
      FROM (SELECT *, abs(atan2(y2-y1, x2-x1) - 1) % pi() AS d FROM ({F6}))""",
    "A10_write_result": f"SELECT p_partkey, p_brand, {sr('p_retailprice')} FROM part",
    "J1_own_format": """SELECT CAST(i // 64 % 32 AS INT) AS x, count(*) FILTER (i % 64 = 0) AS n, CAST(max(i // 2048) AS INT) AS last_row,
        CAST(sum(CAST('0x' || pair AS INT)) AS DOUBLE) AS total
      FROM (SELECT unnest(pairs) AS pair, unnest(range(len(pairs))) AS i FROM (SELECT regexp_extract_all(hex(encode(text)), '..') AS pairs FROM documents)) GROUP BY 1""",
}

"""Catalogs, outlines, sampled spectra, dense arrays and result tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import display_id, number, sexagesimal
from ..operators.audit import inventory, require_empty
from ..schema import require, require_columns

#: Columns a catalog must have, and types that are not catalogued objects.
CATALOG_COLUMNS = ["Name", "Type", "RA", "Dec", "MajAx", "MinAx", "PosAng", "V-Mag", "B-Mag", "M", "NGC", "IC", "Identifiers", "Common names"]
SKIPPED_TYPES = ["NonEx", "Dup", "*", "**", "Nova"]


def parse_object_catalog(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4 on raw string columns: (catalog rows, problems).

    Problems (bad coordinates, sizes, magnitudes, repeated ids) are rows, so one bad entry never stops a job by
    itself; :func:`read_object_catalog` turns them into an error."""
    require_columns(raw, CATALOG_COLUMNS, "catalog")
    c = lambda n: F.coalesce(F.trim(F.col(f"`{n}`")), F.lit(""))
    rows = raw.where(~c("Type").isin(SKIPPED_TYPES) & (c("RA") != "") & (c("Dec") != ""))
    size = lambda n: F.when(c(n) == "", 0.0).otherwise(number(c(n)))
    angle = F.when(c("PosAng") != "", number(c("PosAng")))
    bad_angle = F.coalesce((angle < 0) | (angle >= 360), F.lit(False))
    band = F.when(c("V-Mag") != "", "V").when(c("B-Mag") != "", "B")
    magnitude = F.when(c("V-Mag") != "", number(c("V-Mag"))).when(c("B-Mag") != "", number(c("B-Mag")))
    messier = F.when(c("M") != "", display_id(F.concat(F.lit("M"), c("M"))))
    aliases = F.concat_ws(",", c("Identifiers"), messier, F.when(c("NGC") != "", F.concat(F.lit("NGC"), c("NGC"))),
                          F.when(c("IC") != "", F.concat(F.lit("IC"), c("IC"))))
    out = rows.select(
        c("Name").alias("id"), F.concat_ws(" / ", messier, display_id(c("Name"))).alias("label"), c("Type").alias("type"),
        sexagesimal(c("RA"), True).alias("ra"), sexagesimal(c("Dec"), False).alias("dec"), size("MajAx").alias("major_arcmin"),
        size("MinAx").alias("minor_arcmin"), F.when(~bad_angle, F.pmod(angle, F.lit(180.0))).alias("position_angle"),
        bad_angle.alias("invalid_position_angle"), magnitude.alias("magnitude"), band.alias("magnitude_band"),
        c("Common names").alias("common_names"), aliases.alias("aliases"))
    bad = lambda cond, name: F.when(cond, name)
    broken = lambda n: F.col(n).isNull() | ~F.col(n).between(0, 1800)
    codes = F.array_compact(F.array(
        bad((F.col("id") == "") | (F.length("id") > 64), "identifier"), bad(F.col("ra").isNull() | F.col("dec").isNull(), "coordinate"),
        bad(broken("major_arcmin") | broken("minor_arcmin"), "diameter"),
        bad(F.col("magnitude_band").isNotNull() & (F.col("magnitude").isNull() | ~F.col("magnitude").between(-30, 60)), "magnitude")))
    problems = out.select("id", F.explode(codes).alias("problem"))
    twice = out.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("problem"))
    return out, problems.unionByName(twice)


def read_object_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A4: ``;``-separated object catalogs; any problem is an error."""
    raw = spark.read.csv(paths, sep=";", header=True, quote='"', escape='"', mode="FAILFAST")
    out, problems = parse_object_catalog(raw)
    require_empty(problems, "catalog entries are invalid")
    return out


#: Contour points handed on together (a contour has 50,000 at most).
OUTLINE_ROWS = 20_000


def parse_outlines(texts: DataFrame, catalog: DataFrame | None = None, header: str | None = None) -> DataFrame:
    """A5 on (path, text): contours as rows ``id contour_no point_no ra dec``; ids not in the catalog are dropped.

    A contour is ``id n`` and n coordinate pairs; the tokens of one text are walked in order by the task that holds it.
    Small contours travel together."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = []
        frame = lambda: pd.DataFrame(made, columns=["path", "id", "contour_no", "point_no", "ra", "dec"])
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                for _, rows in contours(text, header):
                    made += [(path, *row) for row in rows]
                    if len(made) >= OUTLINE_ROWS:
                        yield frame()
                        made = []
        if made:
            yield frame()

    out = texts.select("path", "text").mapInPandas(run, "path string, id string, contour_no int, point_no int, ra double, dec double")
    return out if catalog is None else out.join(catalog.select("id"), "id", "left_semi")


def contours(text: str, header: str | None = None) -> Iterator[tuple[str, list[tuple]]]:
    """``header``: the first word that a file must have; without one, any maker's word for version 1 will do."""
    tokens = text.split()
    if not tokens or not (tokens[0].endswith("-Outlines-1") if header is None else tokens[0] == header):
        raise ValueError("not an outline file")
    at, seen = 1, {}
    while at < len(tokens):
        name, n = tokens[at], int(tokens[at + 1])
        body = tokens[at + 2:at + 2 + 2 * n]
        if not 3 <= n <= 50000 or len(body) < 2 * n:
            raise ValueError(f"invalid contour size of {name}")
        no = seen[name] = seen.get(name, -1) + 1
        rows = [(name, no, i, float(body[2 * i]), float(body[2 * i + 1])) for i in range(n)]
        if any(not (0 <= ra < 360 and abs(dec) <= 90) for _, _, _, ra, dec in rows):
            raise ValueError(f"invalid contour coordinate of {name}")
        yield name, rows
        at += 2 + 2 * n


def read_outlines(spark: SparkSession, path: str, catalog: DataFrame, header: str | None = None) -> DataFrame:
    """A5; ``header`` is the first word that the file must have."""
    texts = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
    return parse_outlines(texts, catalog, header).drop("path")


def parse_sampled_spectra(raw: DataFrame, start: float, step: float, n: int) -> tuple[DataFrame, DataFrame]:
    """A6 on ``source_id flux flux_error`` with cells ``"(f1,f2,...)"``: (long spectra, problems)."""
    require(n >= 2 and step > 0, "a spectrum has at least two samples")
    require_columns(raw, ["source_id", "flux", "flux_error"], "spectra")
    cell = lambda c: F.transform(F.split(F.regexp_extract(F.trim(c), r"^\((.*)\)$", 1), ","), lambda v: number(F.trim(v)))
    rows = raw.select("source_id", cell(F.col("flux")).alias("_f"), cell(F.col("flux_error")).alias("_e"))
    wrong = lambda c: (F.size(c) != n) | F.exists(c, lambda v: v.isNull())
    code = F.when(wrong("_f") | wrong("_e"), "samples").when(F.exists("_e", lambda v: v < 0), "negative-error")
    twice = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("source_id", F.lit("duplicate").alias("problem"))
    problems = rows.select("source_id", code.alias("problem")).where("problem is not null").unionByName(twice)
    pairs = F.arrays_zip(F.col("_f").alias("flux"), F.col("_e").alias("error"))
    long = rows.where(code.isNull()).select("source_id", F.posexplode(pairs).alias("pos", "s")).select(
        "source_id", (F.lit(float(start)) + F.col("pos") * float(step)).alias("wavelength"), "s.flux", "s.error")
    return long, problems


def read_sampled_spectra(spark: SparkSession, path: str, start: float, step: float, n: int) -> DataFrame:
    """Any problem is an error."""
    long, problems = parse_sampled_spectra(spark.read.csv(path, header=True, quote='"', escape='"'), start, step, n)
    require_empty(problems, "spectra are invalid")
    return long


def samples_from_arrays(df: DataFrame, id_col: str, array: str, width: int, channels: int = 1) -> DataFrame:
    """Dense arrays to long rows; index = (y * width + x) * channels + channel."""
    require(width > 0 and channels > 0, "width and channels must be positive")
    pos = lambda e: F.expr(e).cast("int")
    return df.select(F.col(id_col).alias("frame_id"), F.posexplode(array).alias("pos", "value")).select(
        "frame_id", pos(f"(pos div {channels}) % {width}").alias("x"), pos(f"pos div {channels * width}").alias("y"),
        pos(f"pos % {channels}").alias("channel"), F.col("value").cast("double").alias("value"))


def samples_to_arrays(df: DataFrame, width: int, channels: int = 1) -> DataFrame:
    """Long rows back to one dense array per frame (a frame has to fit one row, as it does in a dense table)."""
    index = (F.col("y") * width + F.col("x")) * channels + F.col("channel")
    packed = df.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct(index.alias("i"), F.col("value").alias("v")))).alias("p"))
    return packed.select("frame_id", F.col("p.v").alias("values"))


def file_inventory(spark: SparkSession, glob: str) -> DataFrame:
    """Path, modification time, bytes, SHA-256 and copies of every file."""
    raw = spark.read.format("binaryFile").load(glob)
    return inventory(raw.select("path", "modificationTime", "content"))


def write_result(df: DataFrame, path: str, partition_by: list[str] = []) -> None:
    """A10: publish to a new location; an existing one is an error."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

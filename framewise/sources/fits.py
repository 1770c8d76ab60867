"""FITS files as Spark sources: headers, image samples and numeric tables.

Spark lists the files (path and length only) and deals *byte ranges* over tasks; a task opens its file and reads that range:
header blocks for A1, one run of rows of one plane for A2, one run of records for A3. A file of any size is thus read by many
tasks, and planes nobody asked for are never read. Python finds the cards of a header and turns bytes into numbers; what the
cards mean is tables of rules (:data:`TEXT_RULES`, :data:`NUMBER_RULES`, :func:`cross_rules`) that Spark evaluates over the cards of all files.

Schemes that pyarrow cannot open (:data:`RANGED` lists those it can) are read whole through ``binaryFile``; the
``decode_*`` functions take such (path, content) rows from any DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from types import SimpleNamespace
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import HEADERS, SAMPLES, require

BLOCK, CARD = 2880, 80
#: Schemes whose files are opened at an offset, and the bytes of header read at a time.
RANGED = {"file", "hdfs", "viewfs", "s3", "s3a", "gs", "abfs"}
HEAD = 5 * BLOCK
#: Bytes of files that Python holds at a time, where files come as rows.
PIECE = 1 << 20
#: What a scan adds to a file.
SCANNED = {"cards": pa.map_(pa.string(), pa.struct([("n", pa.int32()), ("raw", pa.string())])), "data_at": pa.int64(), "header_bytes": pa.int64(), "fault": pa.string()}
#: Metadata fields and the header keywords that carry them.
TEXT_KEYS = {
    "camera": "INSTRUME", "cameraSerial": "CAM-SER", "filter": "FILTER", "opticalTrain": "PSOPTICS", "readoutMode": "READMODE",
    "object": "OBJECT", "observedAt": "DATE-OBS", "timeSystem": "TIMESYS", "frameType": "IMAGETYP", "units": "BUNIT",
    "domain": "PSCOLOR", "declaredLayout": "PSLAYOUT", "bayer": "BAYERPAT", "temperatureUnit": "TEMPUNIT",
    "biasState": "PSBIAS", "normalization": "PSNORM", "calibration": "PSCALIB",
}
#: Field -> (keywords, lowest, highest, whole number).
NUMBER_KEYS = {
    "exposure": (("EXPTIME", "EXPOSURE"), 0, 1e8, False), "gain": (("GAIN",), 0, 1e9, False), "iso": (("ISOSPEED",), 1, 1e9, True),
    "offset": (("OFFSET",), 0, 1e9, False), "electronsPerADU": (("EGAIN",), 1e-12, 1e9, False),
    "sensorTemperature": (("CCD-TEMP",), -273.15, 200, False), "setTemperature": (("SET-TEMP",), -273.15, 200, False),
    "sensorTemperatureMin": (("PSTMIN",), -273.15, 200, False), "sensorTemperatureMax": (("PSTMAX",), -273.15, 200, False),
    "binX": (("XBINNING",), 1, 65535, True), "binY": (("YBINNING",), 1, 65535, True),
    "originX": (("XORGSUBF",), 0, 1e9, True), "originY": (("YORGSUBF",), 0, 1e9, True),
    "focalLength": (("FOCALLEN",), 1e-9, 1e9, False), "scale": (("BSCALE",), 1e-300, 1e300, False), "zero": (("BZERO",), -1e300, 1e300, False),
}
STRUCTURE = ("SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "NAXIS3", "BSCALE", "BZERO")
SHIFTS = ("XBAYROFF", "YBAYROFF")
BAYER = ("RGGB", "BGGR", "GRBG", "GBRG")
DTYPES = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}
KNOWN = {*STRUCTURE, *SHIFTS, "BLANK", *TEXT_KEYS.values(), *(k for names, *_ in NUMBER_KEYS.values() for k in names)}

Read = Callable[[int, int], bytes]


# --- files and byte ranges -------------------------------------------------------------------

def at_offset(path: str) -> Read:
    """``read(offset, length)`` of one file."""
    scheme, rest = path.split(":", 1) if re.match(r"[a-z0-9]+:/", path) else ("file", path)
    if scheme == "file":
        system, name = arrow_fs.LocalFileSystem(), unquote("/" + rest.lstrip("/"))
    else:
        system, name = arrow_fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{rest}")
    handle = system.open_input_file(name)

    def read(at: int, size: int) -> bytes:
        handle.seek(at)
        return handle.read(size)

    return read


def whole_files(spark: SparkSession, glob: str) -> DataFrame:
    """``path, content``: for readers that need every byte at once."""
    return spark.read.format("binaryFile").load(glob).select("path", "content")


def listed(spark: SparkSession, glob: str) -> DataFrame:
    """``path, size, content``: content is NULL, and never read, where files can be opened at an offset."""
    scheme = glob.split(":", 1)[0] if "://" in glob or glob.startswith("file:") else (
        spark.conf.get("spark.hadoop.fs.defaultFS", None) or "file").split(":", 1)[0]
    content = F.lit(None).cast("binary") if scheme in RANGED else F.col("content")
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("size"), content.alias("content"))


def given(contents: DataFrame) -> DataFrame:
    return contents.select("path", F.octet_length("content").cast("long").alias("size"), "content")


def opened(path: str, content: bytes | memoryview | None) -> Read:
    if content is None:
        return at_offset(path)
    view = memoryview(content)
    return lambda at, size: bytes(view[at:at + size])


# --- headers ---------------------------------------------------------------------------------

def cards(read: Read, start: int = 0, wanted: set[str] | None = None) -> tuple[dict[str, tuple[int, str]], int, int]:
    """Keyword -> (cards, value text of the first), offset of the data behind the header, bytes read."""
    found: dict[str, tuple[int, str]] = {}
    at = start
    while part := read(at, HEAD):
        for end in range(BLOCK, len(part) + 1, BLOCK):
            for c in range(end - BLOCK, end, CARD):
                card = part[c:c + CARD].decode("ascii", "replace")
                key = card[:8].strip()
                if key == "END":
                    return found, at + end, at + len(part) - start
                if card[8] == "=" and key and (wanted is None or key in wanted):
                    n, first = found.get(key, (0, card[10:].strip()))
                    found[key] = (n + 1, first)
        if start == 0 and at == 0 and wanted is not None and "SIMPLE" not in found:
            raise ValueError("not a primary FITS image")
        at += len(part)
        if len(part) < HEAD:
            break
    raise ValueError("header has no END card")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``PIECE`` bytes, without a copy: what Python makes of one is small, however long the batch is."""
    for batch in batches:
        step = max(1, PIECE * len(batch) // max(1, batch.nbytes))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def bytes_of(batch: pa.RecordBatch) -> Iterator[memoryview | None]:
    """The contents of a batch's files, read where they lie."""
    for content in batch.column("content"):
        yield memoryview(content.as_buffer()) if content.is_valid else None


def scan(files: DataFrame, keep: bool = True) -> DataFrame:
    """The cards of every primary header: ``path size content cards data_at header_bytes fault``; the known keywords only.
    Contents come back as they are for those who read on, or not at all unless ``keep``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for path, content in zip(batch["path"].to_pylist(), bytes_of(batch)):
                try:
                    found, data, used = cards(opened(path, content), wanted=KNOWN)
                    out.append(([(k, {"n": n, "raw": raw}) for k, (n, raw) in found.items()], data, used, None))
                except (ValueError, OSError) as error:
                    out.append(([], None, None, str(error)))
            more = [pa.array(column, kind) for column, kind in zip(zip(*out), SCANNED.values())]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], *more], [*names, *SCANNED])

    kept = files if keep else files.drop("content")
    names = kept.columns
    extra = T.StructType.fromDDL("cards map<string,struct<n:int,raw:string>>, data_at long, header_bytes long, fault string")
    return files.mapInArrow(run, T.StructType([*kept.schema.fields, *extra.fields]))


def raw(key: str) -> Column:
    return F.try_element_at(F.col("cards"), F.lit(key))["raw"]


def copies(key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("cards"), F.lit(key))["n"], F.lit(0))


def quoted(text: Column) -> Column:
    """Text of a complete quoted value ('' stands for one quote), else NULL."""
    pattern = r"^'((?:[^']|'')*)'\s*(?:/.*)?$"
    return F.when(text.rlike(pattern), F.trim(F.regexp_replace(F.regexp_extract(text, pattern, 1), "''", "'")))


def bare(text: Column) -> Column:
    return F.trim(F.split_part(text, F.lit("/"), F.lit(1)))


def number(text: Column) -> Column:
    """A finite unquoted number, else NULL."""
    body = F.translate(bare(text), "Dd", "EE")
    value = F.when(body.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), body.cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def whole(text: Column) -> Column:
    value = number(text)
    return F.when((value == F.floor(value)) & (F.abs(value) < 2.0**62), value.cast("long"))


def with_geometry(scanned: DataFrame) -> DataFrame:
    """Adds ``width height channels bitpix`` and completes ``fault`` (NULL: a readable image)."""
    axes = whole(raw("NAXIS"))
    df = scanned.withColumns({
        "_axes": axes, "width": whole(raw("NAXIS1")), "height": whole(raw("NAXIS2")), "bitpix": whole(raw("BITPIX")),
        "channels": F.when(axes == 3, F.coalesce(whole(raw("NAXIS3")), F.when(copies("NAXIS3") == 0, F.lit(1)))).otherwise(F.lit(1))})
    no = lambda c: ~F.coalesce(c, F.lit(False))
    odd = (
        F.when(no(F.coalesce(quoted(raw("SIMPLE")), bare(raw("SIMPLE"))) == "T"), "not a primary FITS image")
        .when(no(F.col("bitpix").isin(*DTYPES)) | no(F.col("_axes").isin(2, 3)), "unsupported image layout")
        .when(no(F.col("width").between(1, 2**31 - 1) & F.col("height").between(1, 2**31 - 1) & F.col("channels").isin(1, 3, 4)), "unsupported image dimensions"))
    df = df.withColumn("fault", F.coalesce("fault", odd))
    fits = F.col("fault").isNull()
    df = df.withColumns({c: F.when(fits, F.col(c)).cast("int") for c in ("width", "height", "channels", "bitpix")})
    # Checked against the file's length, so no data are read. Doubles: the product may pass 64 bits.
    needed = F.col("width").cast("double") * F.col("height") * F.col("channels") * F.abs("bitpix") / 8
    return df.withColumn("fault", F.coalesce("fault", F.when(F.col("size") - F.col("data_at") < needed, "the data end early"))).drop("_axes")


def rule_table(names: str, rows: list[tuple]) -> Column:
    """A table of rules as a constant array, so that one small expression serves all of them."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names.split(), row)]) for row in rows])


#: What a keyword has to be: (field, keyword) of texts, and (field, keyword, lowest, highest, whole) of numbers.
TEXT_RULES = list(TEXT_KEYS.items())
NUMBER_RULES = [(field, key, float(low), float(high), integer) for field, (names, low, high, integer) in NUMBER_KEYS.items() for key in names]
CELSIUS, LINEAR = ("C", "CELSIUS", "DEGC"), ("LINEAR", "LINEAR-SRGB")


def cross_rules() -> list[tuple[str, str, Column, str]]:
    """(field, code, broken where, message) of the rules that weigh several fields, over ``texts``, ``numbers``, ``shift``."""
    low, high = number_of("sensorTemperatureMin"), number_of("sensorTemperatureMax")
    inside = F.coalesce(F.coalesce(number_of("sensorTemperature"), low).between(low, high), F.lit(False))
    mosaic, fits, layout = text_of("bayer").isNotNull(), F.col("mosaic_fits"), F.upper(text_of("declaredLayout"))
    return [
        ("biasState", "invalid", ~text_of("biasState").isin("included", "removed"), "neither included nor removed"),
        ("sensorTemperature", "invalid", (copies("PSTMIN") + copies("PSTMAX") > 0) & ~inside, "no valid range around the temperature"),
        ("sensorTemperature", "unsupported", ~F.upper(text_of("temperatureUnit")).isin(*CELSIUS), "the unit is not Celsius"),
        ("domain", "unsupported", ~F.upper(text_of("domain")).isin(*LINEAR), "not linear"),
        ("sampling", "invalid", mosaic & ~fits, "the pattern does not fit the layout"),
        *[("sampling", "invalid", mosaic & fits & (copies(k) > 0) & F.col("shift")[k].isNull(), f"{k} is no whole offset") for k in SHIFTS],
        ("sampling", "unsupported", ~mosaic & layout.isNotNull() & ~((layout == "MONO") & (F.col("channels") == 1)), "the layout names neither mono nor a pattern"),
    ]


def text_of(field: str) -> Column:
    """The field's value where it is given once and not empty."""
    return F.try_element_at("texts", F.lit(field))


def number_of(field: str) -> Column:
    """The field's number where all its keywords are valid and agree."""
    return F.try_element_at("numbers", F.lit(field))


def sampling() -> Column:
    """The pattern as it lies on the grid: an odd offset swaps its columns or rows."""
    dx, dy = (F.pmod(F.coalesce(F.col("shift")[k], F.lit(0)), F.lit(2)) for k in SHIFTS)
    letters = [F.substr(F.upper(text_of("bayer")), (((dy + r) % 2) * 2 + (dx + c) % 2 + 1).cast("int"), F.lit(1)) for r in (0, 1) for c in (0, 1)]
    mono = (F.upper(text_of("declaredLayout")) == "MONO") & (F.col("channels") == 1)
    return F.when(text_of("bayer").isNotNull(), F.when(F.col("mosaic_fits"), F.concat(F.lit("CFA:"), *letters))).when(mono, "mono")


def described(files: DataFrame) -> DataFrame:
    """A1 over ``path size content``: geometry, text and numeric fields, the keywords they came from, and the issues."""
    issue = lambda field, code, message: F.struct(field.alias("field"), code.alias("code"), message.alias("message"))
    as_map = lambda entries, key, value: F.map_from_entries(F.transform(entries, lambda e: F.struct(e[key], value(e))))

    def one_text(r: Column) -> Column:
        card = F.try_element_at("cards", r["key"])
        digits = (r["field"] == "readoutMode") & bare(card["raw"]).rlike(r"^[+-]*[0-9]+$")
        return F.struct(r["field"], r["key"], card["n"].alias("n"), card["raw"].alias("raw"),
                        F.coalesce(quoted(card["raw"]), F.when(digits, bare(card["raw"]))).alias("value"))

    def one_number(r: Column) -> Column:
        card = F.try_element_at("cards", r["key"])
        v = number(card["raw"])
        good = (card["n"] == 1) & v.between(r["low"], r["high"]) & (~r["integer"] | (v == F.floor(v)))
        return F.struct(r["field"], r["key"], card["n"].alias("n"), F.when(good, v).alias("value"))

    def one_field(entries: Column) -> Callable[[Column], Column]:
        def run(field: Column) -> Column:
            own = F.filter(entries, lambda e: e["field"] == field)
            return F.struct(field.alias("field"), own.alias("own"), F.size(F.array_distinct(F.transform(own, lambda e: e["value"]))).alias("n"),
                            F.forall(own, lambda e: e["value"].isNotNull()).alias("good"))
        return run

    # An unreadable header has no cards, so that no rule speaks about it.
    df = with_geometry(scan(files, keep=False)).withColumn("cards", F.when(F.col("fault").isNull(), F.col("cards")).otherwise(F.expr("map()").cast("map<string,struct<n:int,raw:string>>")))
    df = df.withColumns({
        "t": F.filter(F.transform(rule_table("field key", TEXT_RULES), one_text), lambda e: e["n"] > 0),
        "k": F.filter(F.transform(rule_table("field key low high integer", NUMBER_RULES), one_number), lambda e: e["n"] > 0),
        "shift": F.struct(*[F.when(copies(k) == 1, whole(raw(k))).alias(k) for k in SHIFTS])})
    df = df.withColumn("f", F.filter(F.transform(F.array(*map(F.lit, NUMBER_KEYS)), one_field(F.col("k"))), lambda e: F.size(e["own"]) > 0))
    df = df.withColumns({
        "texts": as_map(F.filter("t", lambda e: (e["n"] == 1) & (e["value"] != "")), "field", lambda e: e["value"]),
        "numbers": as_map(F.filter("f", lambda e: e["good"] & (e["n"] == 1)), "field", lambda e: e["own"][0]["value"])})
    fits = F.upper(text_of("bayer")).isin(*BAYER) & (F.col("channels") == 1) & F.coalesce(F.upper(text_of("declaredLayout")), F.lit("CFA")).isin("CFA")
    df = df.withColumn("mosaic_fits", F.coalesce(fits, F.lit(False))).withColumn("sampling", sampling())
    twice = F.filter(F.array(*map(F.lit, STRUCTURE)), lambda key: F.try_element_at("cards", key)["n"] > 1)
    issues = F.concat(
        F.transform(twice, lambda key: issue(key, F.lit("duplicate"), F.lit("a structural card stands more than once"))),
        F.transform(F.filter("t", lambda e: (e["n"] > 1) | (e["value"].isNull() & (e["raw"] != ""))), lambda e: issue(
            e["field"], F.when(e["n"] > 1, "duplicate").otherwise("invalid"),
            F.when(e["n"] > 1, F.concat(F.lit("several cards of "), e["key"])).otherwise(F.concat(e["key"], F.lit(" holds no quoted string"))))),
        F.transform(F.filter("k", lambda e: e["value"].isNull()), lambda e: issue(
            e["field"], F.lit("invalid"), F.concat(e["key"], F.lit(" is not one number within its range")))),
        F.transform(F.filter("f", lambda e: e["good"] & (e["n"] > 1)), lambda e: issue(e["field"], F.lit("conflict"), F.lit("its keywords differ"))),
        F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), issue(F.lit(f), F.lit(c), F.lit(m))) for f, c, bad, m in cross_rules()])))
    tidy = F.transform_values("texts", lambda k, v: F.when((k == "units") & (F.upper(v) == "ADU"), "ADU").when((k == "domain") & F.upper(v).isin(*LINEAR), "linear").otherwise(v))
    given_by = F.when(text_of("bayer").isNotNull(), F.lit("BAYERPAT")).otherwise(F.lit("PSLAYOUT"))
    placed_by = F.filter(F.array(given_by, *map(F.lit, SHIFTS)), lambda k: (k == given_by) | ((given_by == "BAYERPAT") & F.map_contains_key("cards", k)))
    absent = F.filter(rule_table("field key value", [("scale", "BSCALE", 1.0), ("zero", "BZERO", 0.0)]), lambda r: F.col("fault").isNull() & ~F.map_contains_key("cards", r["key"]))
    kelvin = ~F.coalesce(F.upper(text_of("temperatureUnit")).isin(*CELSIUS), F.lit(True))
    extra = lambda value: F.when(F.col("sampling").isNotNull(), F.create_map(F.lit("sampling"), value)).otherwise(F.expr("map()"))
    df = df.select(
        "path", "width", "height", "channels", "bitpix", F.map_concat(tidy, extra(F.col("sampling"))).alias("text"),
        F.map_concat(F.map_filter("numbers", lambda k, _: (k != "sensorTemperature") | ~kelvin), as_map(absent, "field", lambda e: e["value"])).alias("numeric"),
        F.map_concat(as_map(F.col("t"), "field", lambda e: F.array(e["key"])), as_map(F.col("f"), "field", lambda e: F.transform(e["own"], lambda o: o["key"])),
                     extra(placed_by)).alias("keys"),
        F.when(F.col("fault").isNull(), issues).otherwise(F.array(issue(F.lit("header"), F.lit("unreadable"), F.col("fault")))).alias("issues"))
    return df.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in HEADERS])


def decode_headers(contents: DataFrame) -> DataFrame:
    """A1 on any (path, content) DataFrame."""
    return described(given(contents))


def read_frame_headers(spark: SparkSession, glob: str) -> DataFrame:
    """A1: one row per file: geometry, metadata maps, source keywords, issues. Reads header blocks only.
    Spark's file listing leaves files of no bytes out."""
    return described(listed(spark, glob))


# --- image samples ---------------------------------------------------------------------------

FRAME_ROWS = T.StructType([T.StructField("path", T.StringType()), *SAMPLES.fields[1:]])
FRAME_BATCH = to_arrow_schema(FRAME_ROWS)
ROWS_PER_BATCH = 1 << 18
#: Samples (A2) or bytes of records (A3) that one range holds.
RANGE = 1 << 22


def samples_of(files: DataFrame, channels: list[int] | None, deal: bool) -> DataFrame:
    """A2: one row per byte range (a run of samples of one plane), dealt over tasks, then read and decoded."""
    plane = F.col("width").cast("long") * F.col("height")
    wanted = F.sequence(F.lit(0), F.col("channels") - 1) if channels is None else F.filter(
        F.array(*[F.lit(int(c)) for c in dict.fromkeys(channels)]).cast("array<int>"), lambda c: (c >= 0) & (c < F.col("channels")))
    field = lambda key, default: F.when(copies(key) == 0, F.lit(default)).otherwise(number(raw(key)))
    layout = with_geometry(scan(files)).withColumns({
        "fault": F.coalesce("fault", F.when(field("BSCALE", 1.0).isNull() | field("BZERO", 0.0).isNull(), "no valid scale")),
        "scale": field("BSCALE", 1.0), "zero": field("BZERO", 0.0), "blank": F.when(F.col("bitpix") > 0, number(raw("BLANK"))), "plane": plane})
    refuse = F.raise_error(F.concat("path", F.lit(": "), "fault")).cast("long")
    layout = layout.withColumn("data_at", F.when(F.col("fault").isNull(), F.col("data_at")).otherwise(refuse))
    ranges = layout.select("path", "content", "data_at", "bitpix", "width", "plane", "scale", "zero", "blank", F.explode(wanted).alias("channel"))
    ranges = ranges.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("plane") - 1, F.lit(RANGE).cast("long"))).alias("first"))
    if deal:  # rows of a few numbers; contents stay where they are
        ranges = ranges.repartition("path", "channel", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in pieces(batches):
            facts = [SimpleNamespace(**row) for row in batch.drop_columns("content").to_pylist()]
            for row, content in zip(facts, bytes_of(batch)):
                for part in sample_batches(opened(row.path, content), row):
                    held.append(pa.RecordBatch.from_pandas(part, FRAME_BATCH, preserve_index=False))
                    rows += len(part)
                    if rows >= ROWS_PER_BATCH:
                        yield from joined(held)
                        held, rows = [], 0
        yield from joined(held)

    return ranges.mapInArrow(run, FRAME_ROWS).select(F.xxhash64("path").alias("frame_id"), *FRAME_ROWS.names)


def joined(parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Small batches as one."""
    return pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []


def sample_batches(read: Read, row) -> Iterator[pd.DataFrame]:
    bits, last = int(row.bitpix), min(row.first + RANGE, row.plane)
    size = abs(bits) // 8
    for at in range(row.first, last, ROWS_PER_BATCH):
        n = min(ROWS_PER_BATCH, last - at)
        part = np.frombuffer(read(int(row.data_at + (row.channel * row.plane + at) * size), n * size), DTYPES[bits], n).astype(float)
        missing = ~np.isfinite(part) | (part == row.blank if row.blank is not None else False)
        index = np.arange(at, at + n)
        values = pd.array(part * row.scale + row.zero, dtype="Float64")
        values[missing] = pd.NA
        yield pd.DataFrame({"path": row.path, "x": (index % row.width).astype("int32"), "y": (index // row.width).astype("int32"),
                            "channel": np.int32(row.channel), "value": values, "coverage": np.where(missing, 0.0, 1.0)})


def decode_samples(contents: DataFrame, channels: list[int] | None = None) -> DataFrame:
    """A2 on any (path, content) DataFrame; only the requested planes are decoded."""
    return samples_of(given(contents), channels, False)


def read_frame_samples(spark: SparkSession, glob: str, channels: list[int] | None = None) -> DataFrame:
    """A2: samples of every file: physical = raw * BSCALE + BZERO; BLANK and non-finite values are NULL. A file that is no
    readable image is an error. Only the bytes of the requested planes are read, by as many tasks as there are ranges."""
    return samples_of(listed(spark, glob), channels, True)


# --- numeric tables --------------------------------------------------------------------------

#: Bytes per element of a table column type.
WIDTHS = {"A": 1, "B": 1, "L": 1, "I": 2, "J": 4, "E": 4, "K": 8, "D": 8, "C": 8, "M": 16}
NUMBERS = {"B": ">u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}


def table_layout(read: Read, size: int, columns: list[str]) -> tuple[int, int, int, list[str], list[int]]:
    """Offset of the records, bytes per record, records, and type and offset of each requested column. Columns nobody asks
    for are skipped, never decoded."""
    _, start, _ = cards(read, wanted={"SIMPLE"})
    head, data, _ = cards(read, start)
    word = lambda key: head[key][1].split("/")[0].strip()
    text_of = lambda key: head[key][1].lstrip("'").split("'")[0].strip()
    if text_of("XTENSION") != "BINTABLE":
        raise ValueError("expected a binary table")
    if int(word("PCOUNT")) != 0 or int(word("GCOUNT")) != 1:
        raise ValueError("expected a fixed-width binary table")
    width, rows = int(word("NAXIS1")), int(word("NAXIS2"))
    places: dict[str, tuple[str, int]] = {}
    at = 0
    for i in range(1, int(word("TFIELDS")) + 1):
        name, form = text_of(f"TTYPE{i}"), text_of(f"TFORM{i}")
        count, kind = int(form[:-1] or 1), form[-1]
        if kind != "X" and kind not in WIDTHS:
            raise ValueError(f"unsupported column format {form}")
        if name in columns:
            if name in places or count != 1 or kind not in NUMBERS or any(f"{k}{i}" in head for k in ("TSCAL", "TZERO", "TNULL")):
                raise ValueError(f"column {name} must be an unscaled scalar number")
            places[name] = (NUMBERS[kind], at)
        at += (count + 7) // 8 if kind == "X" else count * WIDTHS[kind]
    if at != width or len(places) != len(columns):
        raise ValueError("missing columns or inconsistent row width")
    if size - data < width * rows:
        raise ValueError("table data are truncated")
    return data, width, rows, [places[c][0] for c in columns], [places[c][1] for c in columns]


def records_of(files: DataFrame, columns: list[str], deal: bool) -> DataFrame:
    """A3: one row per run of records, dealt over tasks, then read and decoded."""
    require(len(columns) > 0 and len(set(columns)) == len(columns), "name distinct columns")
    names = ["path", "content", "data_at", "width", "rows", "types", "offsets"]

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(path, content, *table_layout(opened(path, content), size, columns))
                                for path, size, content in zip(batch["path"], batch["size"], batch["content"])], columns=names)

    ranges = files.select("path", "size", "content").mapInPandas(
        plan, "path string, content binary, data_at long, width long, rows long, types array<string>, offsets array<long>").where("rows > 0")
    step = F.greatest(F.lit(1).cast("long"), F.expr(f"{RANGE} div width"))
    ranges = ranges.withColumn("step", step).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.col("step"))).alias("first"))
    if deal:
        ranges = ranges.repartition("path", "first")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in columns]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                n = int(min(r.step, r.rows - r.first))
                kind = np.dtype({"names": columns, "formats": list(r.types), "offsets": [int(o) for o in r.offsets], "itemsize": int(r.width)})
                part = np.frombuffer(opened(r.path, r.content)(int(r.data_at + r.first * r.width), n * int(r.width)), kind, n)
                out = {c: part[c].astype(float) for c in columns}
                if not all(np.isfinite(v).all() for v in out.values()):
                    raise ValueError("table has non-finite values")
                yield pd.DataFrame({"path": r.path, "row": np.arange(r.first, r.first + n), **out})

    return ranges.mapInPandas(run, schema)


def decode_tables(contents: DataFrame, columns: list[str]) -> DataFrame:
    """A3 on any (path, content) DataFrame."""
    return records_of(given(contents), columns, False)


def read_numeric_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A3: scalar columns of FITS binary tables as doubles; a missing column is an error."""
    return records_of(listed(spark, path), columns, True)


# --- formats of the caller's own -------------------------------------------------------------

def read_frames_with(spark: SparkSession, glob: str, decode: Callable[[str, bytes], Iterator[pd.DataFrame]]) -> DataFrame:
    """Samples from a format of the caller's own. ``decode`` yields batches with x, y, channel, value, coverage."""
    return frames_with(whole_files(spark, glob), decode)


def frames_with(contents: DataFrame, decode: Callable[[str, bytes], Iterator[pd.DataFrame]]) -> DataFrame:
    """J1 on any (path, content) DataFrame."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, paths, rows = [], [], 0
        for batch in pieces(batches):
            for path, content in zip(batch["path"].to_pylist(), bytes_of(batch)):
                for part in decode(path, bytes(content)):
                    held.append(part)
                    paths.append(path)
                    rows += len(part)
                    if rows >= ROWS_PER_BATCH:
                        yield one_batch(held, paths)
                        held, paths, rows = [], [], 0
        if held:
            yield one_batch(held, paths)

    return contents.select("path", "content").mapInArrow(run, FRAME_ROWS).select(F.xxhash64("path").alias("frame_id"), *FRAME_ROWS.names)


def one_batch(parts: list[pd.DataFrame], paths: list[str]) -> pa.RecordBatch:
    """What a caller decoded of several files as one batch; the path is written once per part and spread by its index."""
    which = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    columns = [pa.DictionaryArray.from_arrays(which, pa.array(paths, pa.string())).dictionary_decode()]
    for name, kind in zip(FRAME_BATCH.names[1:], FRAME_BATCH.types[1:]):
        arrays = [p[name].array for p in parts]
        plain = all(isinstance(a, pd.arrays.NumpyExtensionArray) for a in arrays)
        joined = np.concatenate([a.to_numpy() for a in arrays]) if plain else pd.concat([p[name] for p in parts], ignore_index=True)
        columns.append(pa.Array.from_pandas(joined, type=kind))
    return pa.RecordBatch.from_arrays(columns, FRAME_BATCH.names)

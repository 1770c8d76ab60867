"""Canonical schemas and the checks every operator runs before it plans anything."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SAMPLES = T.StructType([
    T.StructField("frame_id", T.LongType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("coverage", T.DoubleType()),
])

ISSUE = T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
])

HEADERS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("bitpix", T.IntegerType()),
    T.StructField("text", T.MapType(T.StringType(), T.StringType())),
    T.StructField("numeric", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("keys", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("issues", T.ArrayType(ISSUE)),
])

#: Key columns of one grid position.
PIXEL = ["x", "y", "channel"]
#: Samples with no more coverage than this do not count.
MIN_COVERAGE = 1.0e-6


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def finite(name: str, value: float, low: float | None = None, high: float | None = None) -> float:
    value = float(value)
    require(math.isfinite(value), f"{name} must be finite")
    require(low is None or value >= low, f"{name} must be at least {low}")
    require(high is None or value <= high, f"{name} must be at most {high}")
    return value


def choice(name: str, value: str, allowed: Iterable[str]) -> str:
    allowed = list(allowed)
    require(value in allowed, f"{name} must be one of {allowed}")
    return value

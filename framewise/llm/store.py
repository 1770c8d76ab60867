"""Reliable checkpoints in the shared folder and filters of fixed size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in ``spark.checkpoint.dir``; a folder of our own only in a local session that names none."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside: for rows that hold a whole set each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` bits with the bit of every value of the single bigint column ``hashes`` set.

    Its size does not depend on the rows: Spark ors the bits of each 64-bit word and at most ``2**(bits - 6)`` words come
    to the driver. A clear bit proves that a value is absent; a set bit proves nothing, so an exact join must follow.
    """
    h = f"shiftrightunsigned(`{hashes.columns[0]}`, {64 - bits})"
    words = (hashes.where(f"`{hashes.columns[0]}` is not null").groupBy(F.expr(f"shiftrightunsigned({h}, 6)").alias("word"))
             .agg(F.expr(f"bit_or(shiftleft(1L, cast({h} & 63 as int)))").alias("value")))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for batch in words.toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("value").to_numpy().astype(np.int64).view(np.uint64)
    return out


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which uint64 values may be in the bitmap."""
    bits = len(bitmap).bit_length() - 1 + 6
    place = hashes >> np.uint64(64 - bits)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

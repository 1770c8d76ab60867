"""Live stacks: results that follow a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.stack import StackOptions, prepared, stack
from ..schema import choice, require

METHODS = ("average", "max", "min")


def live_stack(stream: DataFrame, keys: list[str], method: str = "average", **options) -> DataFrame:
    """Running average, maximum or minimum per key. State is a few numbers per key, so it is independent of
    the number of frames and of their order; use output mode update or complete."""
    choice("method", method, METHODS)
    o = StackOptions(**options)
    require(method == "average" or o.weight is None, "extrema take no frame weights")
    rows = prepared(stream, keys, o)
    x, w = F.col("_x"), F.col("_wt")
    value = {"average": F.try_divide(F.sum(x * w), F.sum(w)), "max": F.max(x), "min": F.min(x)}[method]
    return rows.groupBy(*keys).agg(value.alias("value"), F.try_divide(F.sum("_cc"), F.sum("_fw")).alias("coverage"),
                                   F.count("_x").alias("samples"))


def unique_samples(stream: DataFrame, identity: list[str], time_column: str | None = None, delay: str | None = None) -> DataFrame:
    """A sample delivered twice counts once. Without a time column and a delay the state keeps every identity."""
    if time_column is None:
        return stream.dropDuplicates(identity)
    require(delay is not None, "a time column needs a delay")
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(identity)


def live_stack_unique(stream: DataFrame, keys: list[str], identity: list[str], method: str = "average", **options) -> DataFrame:
    """:func:`live_stack` over distinct samples."""
    return live_stack(unique_samples(stream, identity), keys, method, **options)


def keep_latest(result: DataFrame, keys: list[str], folder: str, name: str) -> StreamingQuery:
    """Run an update-mode stream to its current end; changed keys of each batch are appended under ``folder``.

    A repeated batch overwrites its own partition, so a restart after a failure changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id:08d}")

    return (result.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/{name}-state")
            .trigger(availableNow=True).foreachBatch(write).start())


def latest(spark: SparkSession, folder: str, name: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """The newest row of every key written by :func:`keep_latest`."""
    log = spark.read.schema(schema.add("batch", T.LongType())).parquet(f"{folder}/{name}/*")
    rest = [c for c in schema.names if c not in keys and c != "batch"]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("r"))
    return newest.select(*keys, "r.*")


def live_robust(stream: DataFrame, keys: list[str], folder: str, name: str, method: str = "winsorized", buckets: int = 64,
                **options) -> StreamingQuery:
    """Robust stacks of a stream. There is no finite summary, so samples are kept by key bucket and each batch
    recombines only the keys it touched, from their buckets. Results go to ``<name>-result``, newest row per key."""
    spark = stream.sparkSession
    samples, result = f"{folder}/{name}-samples", f"{folder}/{name}-result"

    def fold(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{samples}/batch={batch_id:08d}")
        fresh = spark.read.parquet(f"{samples}/batch={batch_id:08d}")
        touched = fresh.select("bucket", *keys).distinct()
        # Batches written so far, this one included; a replayed batch overwrote itself.
        # Only the buckets it touched are read: at most ``buckets`` numbers, a partition filter.
        which = [r[0] for r in fresh.select("bucket").distinct().collect()]
        history = spark.read.option("basePath", samples).parquet(f"{samples}/*").where((F.col("batch") <= batch_id) & F.col("bucket").isin(which))
        rows = history.join(touched, ["bucket", *keys], "left_semi").drop("bucket", "batch")
        stack(rows, keys, method, **options).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{result}/batch={batch_id:08d}")

    return (stream.writeStream.option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).foreachBatch(fold).start())

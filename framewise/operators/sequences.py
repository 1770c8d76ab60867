"""Rules along an ordered sequence of rows (E2-E8): held-out rows, folds, running weights, neighbours, leave-one-out medians,
first-row references and mutual best partners.

A key may hold any share of the rows: ordinary keys use one window, heavy keys (see :mod:`.stats`) are split into value
ranges of ``lead`` - a number that sorts like the first entry of ``order`` - and put together from one row per range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require
from .quality import order_around_middle, peer_median
from .stats import Hot, heavy_part, per_key, put_back, row_numbers, value_ranges


def hold_out(df: DataFrame, keys: list[str], order: list[Column], lead: Column, every: int = 5) -> DataFrame:
    """Adds ``held``: every ``every``-th row of a key in this order is kept for validation."""
    require(every >= 2, "every must be at least 2")
    rows = row_numbers(df, keys, order, lead, "_row")
    return rows.withColumn("held", F.col("_row") % every == 0).drop("_row")


def folds(df: DataFrame, keys: list[str], order: list[Column], lead: Column, n: int = 2) -> DataFrame:
    """Adds ``fold`` 0..n-1, dealt in turn along the order of a key (two folds: train and validate)."""
    require(n >= 2, "at least two folds")
    rows = row_numbers(df, keys, order, lead, "_row")
    return rows.withColumn("fold", ((F.col("_row") - 1) % n).cast("int")).drop("_row")


def running_weight(df: DataFrame, keys: list[str], order: list[Column], lead: Column, weight: str, hot: list | Hot | None = None) -> DataFrame:
    """Adds ``running``, the weight of a key's rows up to this one; NULL weights count as 0. ``order`` has to be total."""
    light, heavy, small = heavy_part(df, keys, hot)
    w = F.coalesce(F.col(weight), F.lit(0)).cast("double")
    upto = lambda *part: Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = light.withColumn("running", F.sum(w).over(upto(*keys)))
    if heavy is None:
        return out
    rows = value_ranges(heavy, keys, lead, small)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_b").agg(F.sum(w).alias("_w")).withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0.0))).drop("_w")
    rows = put_back(rows.withColumn("running", F.sum(w).over(upto(*keys, "_b"))), sums, [*keys, "_b"], small)
    return out.unionByName(rows.withColumn("running", F.col("running") + F.col("_before")).drop("_b", "_before"))


def neighbour_values(df: DataFrame, keys: list[str], order: list[Column], lead: Column, value: str, hot: list | Hot | None = None) -> DataFrame:
    """E5: adds ``previous`` and ``next``, the values of the rows beside this one (NULL at the ends). ``order`` has to be total."""
    light, heavy, small = heavy_part(df, keys, hot)
    along = Window.partitionBy(*keys).orderBy(*order)
    out = light.withColumns({"previous": F.lag(value).over(along), "next": F.lead(value).over(along)})
    if heavy is None:
        return out
    rows = value_ranges(heavy, keys, lead, small)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    whole = Window.partitionBy(*keys, "_b")
    rows = rows.withColumns({"previous": F.lag(value).over(inside), "next": F.lead(value).over(inside), "_row": F.row_number().over(inside),
                             "_last": F.count(F.lit(1)).over(whole)})
    # The first and last value of each range are the neighbours across its borders.
    beside = Window.partitionBy(*keys).orderBy("_b")
    edges = rows.groupBy(*keys, "_b").agg(F.max(F.when(F.col("_row") == 1, F.col(value))).alias("_first"),
                                          F.max(F.when(F.col("_row") == F.col("_last"), F.col(value))).alias("_end"))
    edges = edges.withColumns({"_before": F.lag("_end").over(beside), "_after": F.lead("_first").over(beside)}).drop("_first", "_end")
    rows = put_back(rows, edges, [*keys, "_b"], small)
    rows = rows.withColumns({"previous": F.when(F.col("_row") == 1, F.col("_before")).otherwise(F.col("previous")),
                             "next": F.when(F.col("_row") == F.col("_last"), F.col("_after")).otherwise(F.col("next"))})
    return out.unionByName(rows.drop("_b", "_row", "_last", "_before", "_after"))


def leave_one_out_median(df: DataFrame, keys: list[str], value: str, hot: list | Hot | None = None) -> DataFrame:
    """Adds ``peer_median``, the median (mean of the middle pair) of the key's other rows; NULL for a row alone or
    without a value. Rows without a value are nobody's peers."""
    def body(part: DataFrame, group) -> DataFrame:
        return order_around_middle(group.attach_agg(part, {"_count": F.count("_x")}), group)

    rows = per_key(df.withColumn("_x", F.col(value).cast("double")), keys, body, hot)
    alone = F.col("_x").isNull() | (F.col("_count") < 2)
    return rows.withColumn("peer_median", F.when(~alone, peer_median())).drop("_x", "_count", "_m0", "_m1", "_m2")


def first_row(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], hot: list | Hot | None = None) -> DataFrame:
    """Adds ``first_<column>``: the columns of the key's first row in this order, the reference of the others."""
    first = lambda group, part: group.attach_agg(part, {"_first": F.min_by(F.struct(*columns), F.struct(*order))})
    rows = per_key(df, keys, lambda part, group: first(group, part), hot)
    return rows.withColumns({f"first_{c}": F.col(f"_first.{c}") for c in columns}).drop("_first")


def mutual_best(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs in which each is the other's best by ``score`` (ties to the smaller partner). Two aggregates that are
    combined before their shuffles, whatever the number of partners."""
    best = lambda side, other: pairs.where(F.col(score).isNotNull()).groupBy(side).agg(
        F.min(F.struct((-F.col(score)).alias("s"), F.col(other).alias("o"))).alias("_best")).select(
        side, F.col("_best.o").alias(other), (-F.col("_best.s")).alias(score))
    return best(left, right).join(best(right, left).drop(score), [left, right])

"""Exact order statistics per key that stay distributed when one key holds much of the data.

Every operator that needs a per-key median or quantile goes through this module. Keys are
split once by :func:`per_key`:

* ordinary keys are handled by :class:`InTask`: one shuffle on the key, sorted windows
  (which spill), no join;
* heavy keys are handled by :class:`Spread`: a radix selection. Equal values are merged map-side, then every round
  counts rows and weight per (key, bucket, digit of the value), keeps the buckets in which a wanted rank or weight
  lies, and drops all other rows. All statistics of all heavy keys narrow together; nothing is sorted until a bucket
  holds at most ``LEAF`` distinct values. No task sees a whole heavy key. Results are exact.

A key is heavy if it has more rows than one task should hold (``spark.framewise.hotRows``), however many such keys there
are and whatever their share. They are found by counting a sample of about ``SEEN`` rows per ``hotRows``; the sample
only picks the way, both ways give the same results. What a round puts back on the rows is a few rows per heavy key:
broadcast up to ``BROADCAST_KEYS`` heavy keys, joined with salted keys beyond.

The quantile conventions (see SURVEY 1.4) are written as ``(kind, q)``:

``("lin", q)``   linear at ``q*(n-1)``; ``("avg",)`` is its median
``("upper",)``   element ``n // 2``
``("rank", q)``  element ``floor(q*(n-1))``
``("ceil", q)``  element ``ceil(q*n) - 1``
``("mid", q)``   weighted, position ``(cumw - w/2) / total``, linear between neighbours
``("wmed",)``    first value whose cumulative weight reaches half, exact tie averaged
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require
from ..session import cut_lineage, hot_rows

SEEN = 256
LISTED = 1024
BROADCAST_KEYS = 200_000
SALTS = 64
DIGITS = 65_536
LEAF = 65_536
SPLITS = 256
#: Rows of ordinary keys that a task should hold.
TASK_ROWS = 500_000
KINDS = {"lin", "avg", "upper", "rank", "ceil", "mid", "wmed"}
Specs = dict[str, tuple]


@dataclass(frozen=True)
class Hot:
    """The keys too heavy for one task, by hash: a short list, or a written table of any length."""

    hashes: list[int] | None
    table: DataFrame | None
    small: bool

    def split(self, df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """(rows of ordinary keys, rows of heavy keys). Keys whose hashes meet are heavy together, which is no error."""
        if self.hashes is not None:
            heavy = F.xxhash64(*keys).isin(self.hashes)
            return df.where(~heavy), df.where(heavy)
        rows = put_back(df.withColumn("_h", F.xxhash64(*keys)), self.table.withColumn("_hot", F.lit(True)), ["_h"], self.small)
        return rows.where(F.col("_hot").isNull()).drop("_h", "_hot"), rows.where("_hot").drop("_h", "_hot")


def hot_keys(df: DataFrame, keys: list[str]) -> Hot | None:
    """The heavy keys of :func:`sampled`."""
    return sampled(df, keys)[0]


def sampled(df: DataFrame, keys: list[str]) -> tuple[Hot | None, float]:
    """(heavy keys, about how many rows the ordinary keys have), from the counts of a sample of rows in which a key at the
    limit is met ``SEEN`` times: the shuffle is that share of the rows, and the number of keys found is not limited."""
    limit = hot_rows(df.sparkSession)
    rate = min(1.0, SEEN / limit)
    rows = df.select(F.xxhash64(*keys).alias("_h"))
    if rate < 1:
        rows = rows.where(F.rand(29) < rate)
    # One row per heavy key, and one without a hash for all others.
    found = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    found = found.groupBy(F.when(F.col("_n") > limit * rate, F.col("_h")).alias("_h")).agg(F.sum("_n").alias("_n"))
    listed = found.take(LISTED + 2)
    if len(listed) > LISTED + 1:
        found = cut_lineage(found)
        listed = found.where("_h is null").collect()
        table = found.where("_h is not null").select("_h")
        hot = Hot(None, table, table.count() <= BROADCAST_KEYS)
    else:
        hashes = [r["_h"] for r in listed if r["_h"] is not None]
        hot = Hot(hashes, None, True) if hashes else None
    return hot, sum(r["_n"] for r in listed if r["_h"] is None) / rate


def heavy_part(df: DataFrame, keys: list[str], hot: list | Hot | None) -> tuple[DataFrame, DataFrame | None, bool]:
    """(rows of ordinary keys, rows of heavy keys or None, whether one row per heavy key may be broadcast). ``hot``: None
    to look for heavy keys, an empty list where the caller knows that there are none."""
    hot = hot_keys(df, keys) if hot is None else hot
    if not hot:
        return df, None, True
    light, heavy = hot.split(df, keys)
    return light, heavy, hot.small


def put_back(df: DataFrame, table: DataFrame, keys: list[str], small: bool, how: str = "left") -> DataFrame:
    """Join a few rows per heavy key to the rows of the keys: by broadcast if ``small``, else each heavy key's rows meet
    ``SALTS`` copies of its row, dealt by a hash of their content."""
    if small:
        return join_keys(df, F.broadcast(table), keys, how)
    content = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(*content), F.lit(SALTS)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_keys(rows, copies, [*keys, "_salt"], how).drop("_salt")


def dealt(df: DataFrame, keys: list[str], rows: float) -> DataFrame:
    """Deal ``rows`` rows, about, by their keys over so many tasks that one has ``TASK_ROWS`` of them. The number is named, since adaptive execution would merge tasks by their shuffled bytes, of which each sort holds many times more."""
    tasks = math.ceil(rows / TASK_ROWS)
    return df if tasks <= 1 else df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def per_key(df: DataFrame, keys: list[str], body: Callable[[DataFrame, "InTask | Spread"], DataFrame],
            hot: list | Hot | None = None) -> DataFrame:
    """Run ``body`` over ordinary and heavy keys, each with the strategy that fits, and unite."""
    found, rows = sampled(df, keys) if hot is None else (hot, 0)
    light, heavy, small = heavy_part(df, keys, found or [])
    light = dealt(light, keys, rows)
    out = body(light, InTask(keys))
    return out if heavy is None else out.unionByName(body(heavy, Spread(keys, small)))


def quantiles(df: DataFrame, keys: list[str], value: str, specs: Specs, weight: str | None = None,
              hot: list | Hot | None = None) -> DataFrame:
    """One row per key with every statistic in ``specs``; NULL values do not count."""
    check_specs(specs)
    rows = df.where(F.col(value).isNotNull())
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
        return quantiles(rows, ["_all"], value, specs, weight, hot).drop("_all")
    return per_key(rows, keys, lambda part, group: group.table(part, value, specs, weight), hot)


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float,
                      name: str = "quantile") -> DataFrame:
    """Exact weighted mid-position quantile per key. Rows of weight <= 0 do not count."""
    require(0 <= q <= 1, "q must be within 0..1")
    return quantiles(df.where(F.col(weight) > 0), keys, value, {name: ("mid", q)}, weight)


def check_specs(specs: Specs) -> None:
    for spec in specs.values():
        require(spec[0] in KINDS, f"unknown quantile kind {spec[0]}")
        require(len(spec) == 1 or 0 <= spec[1] <= 1, "quantile must be within 0..1")


def join_keys(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps one copy of the keys."""
    renamed = table.select(*[F.col(k).alias(f"_j_{k}") for k in keys],
                           *[c for c in table.columns if c not in keys])
    on = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_j_{k}"))
        on = part if on is None else on & part
    return df.join(renamed, on, how).drop(*[f"_j_{k}" for k in keys])


@dataclass(frozen=True)
class Parts:
    """What a row contributes to order statistics: its value, whether it counts, and its weight. Rows merged from
    equal values (``copies`` > 1) also know the weight of their first and last copy."""

    value: Column
    counts: Column
    weight: Column
    first: Column
    last: Column
    copies: Column


def neighbours(specs: Specs, fold: Callable[[Column], Column], parts: Parts) -> dict[str, Column]:
    """First pass: the order statistics each spec needs, as conditional max/min over the rows of a key. Uses the
    columns ``_lo`` (rows before), ``_n`` (rows) and, if weighted, ``_cw`` (cumulative) and ``_mass`` (total weight)."""
    value, inside = parts.value, parts.counts

    def at(rank: Column) -> Column:
        hit = inside & (F.col("_lo") <= rank) & (rank < F.col("_lo") + parts.copies)
        return fold(F.max(F.when(hit, value)))

    out: dict[str, Column] = {}
    total = F.col("_n")
    for name, spec in specs.items():
        kind, q = spec[0], (spec[1] if len(spec) > 1 else 0.5)
        if kind in ("lin", "avg"):
            low = F.floor(F.lit(q) * (total - 1))
            out[f"{name}_a"] = at(low)
            out[f"{name}_b"] = at(F.least(low + 1, total - 1))
        elif kind == "upper":
            out[f"{name}_a"] = at(F.floor(total / 2))
        elif kind == "rank":
            out[f"{name}_a"] = at(F.floor(F.lit(q) * (total - 1)))
        elif kind == "ceil":
            out[f"{name}_a"] = at(F.greatest(F.ceil(F.lit(q) * total) - 1, F.lit(0)))
        elif kind == "mid":
            first = (F.col("_cw") - parts.weight + parts.first / 2) / F.col("_mass")
            last = (F.col("_cw") - parts.last / 2) / F.col("_mass")
            out[f"{name}_a"] = fold(F.max(F.when(inside & (first < q), F.struct(
                first.alias("p"), last.alias("e"), value.alias("v")))))
            out[f"{name}_b"] = fold(F.min(F.when(inside & (first >= q), F.struct(
                first.alias("p"), value.alias("v")))))
        else:  # wmed
            half = F.col("_mass") / 2
            slack = F.greatest(F.lit(1.0), F.col("_mass")) * 1.0e-12
            out[f"{name}_a"] = fold(F.min(F.when(inside & (F.col("_cw") >= half - slack), F.struct(
                value.alias("v"), F.col("_cw").alias("c")))))
            out[f"{name}_b"] = fold(F.min(F.when(inside & (F.col("_cw") > half + slack), value)))
    return out


def finish(specs: Specs) -> dict[str, Column]:
    """Second pass: combine the order statistics (columns ``_n``, ``_mass``, ``name_a``, ``name_b``)."""
    out: dict[str, Column] = {}
    for name, spec in specs.items():
        kind, q = spec[0], (spec[1] if len(spec) > 1 else 0.5)
        a, b = F.col(f"{name}_a"), F.col(f"{name}_b")
        if kind in ("lin", "avg"):
            at = F.lit(q) * (F.col("_n") - 1)
            out[name] = a + (b - a) * (at - F.floor(at))
        elif kind == "mid":
            out[name] = (
                F.when(b.isNull(), a["v"])
                .when(a.isNull(), b["v"])
                .when(a["e"] >= q, a["v"])
                .when(b["p"] <= a["e"], b["v"])
                .otherwise(a["v"] + (b["v"] - a["v"]) * ((F.lit(q) - a["e"]) / (b["p"] - a["e"])))
            )
        elif kind == "wmed":
            half = F.col("_mass") / 2
            slack = F.greatest(F.lit(1.0), F.col("_mass")) * 1.0e-12
            tie = (F.abs(a["c"] - half) <= slack) & b.isNotNull()
            out[name] = F.when(tie, (a["v"] + b) / 2).otherwise(a["v"])
        else:
            out[name] = a
    return out


def scratch(specs: Specs) -> list[str]:
    return ["_v", "_lo", "_n", "_cw", "_mass",
            *[f"{n}_a" for n in specs], *[f"{n}_b" for n in specs]]


def weighted(specs: Specs) -> bool:
    return any(s[0] in ("mid", "wmed") for s in specs.values())


class InTask:
    """Keys small enough for one task: one shuffle on the key, windows over the sorted rows."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def _ranked(self, df: DataFrame, value: str | Column, specs: Specs, weight: str | None,
                where: Column | None) -> tuple[DataFrame, Parts]:
        """Adds ranks and totals. Named columns are used as they are, so the shuffle carries nothing twice."""
        if isinstance(value, Column):
            df = df.withColumn("_v", value)
            value = "_v"
        v = F.col(value)
        counts = v.isNotNull() if where is None else (v.isNotNull() & where)
        w = F.col(weight) if weight else F.lit(1.0)
        whole = Window.partitionBy(*self.keys)
        if not weighted(specs):
            order = Window.partitionBy(*self.keys).orderBy(v)
            running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            # Values that do not count are NULL for the count and sort in front of or between the others.
            df = df.withColumns({"_lo": F.count(F.when(counts, 1)).over(running) - 1, "_n": F.count(F.when(counts, 1)).over(whole)})
            return df, Parts(v, counts, w, w, w, F.lit(1))
        order = Window.partitionBy(*self.keys).orderBy(v, w)
        running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        mass = F.when(counts, w)
        df = df.withColumns({"_cw": F.sum(mass).over(running), "_mass": F.sum(mass).over(whole)})
        if any(spec[0] not in ("mid", "wmed") for spec in specs.values()):
            df = df.withColumns({"_lo": F.count(F.when(counts, 1)).over(running) - 1, "_n": F.count(F.when(counts, 1)).over(whole)})
        return df, Parts(v, counts, w, w, w, F.lit(1))

    def attach(self, df: DataFrame, value: str | Column, specs: Specs, weight: str | None = None,
               where: Column | None = None) -> DataFrame:
        """Add the statistics as columns to every row of the key."""
        check_specs(specs)
        whole = Window.partitionBy(*self.keys)
        df, parts = self._ranked(df, value, specs, weight, where)
        df = df.withColumns(neighbours(specs, lambda c: c.over(whole), parts))
        return df.withColumns(finish(specs)).drop(*scratch(specs))

    def table(self, df: DataFrame, value: str, specs: Specs, weight: str | None = None) -> DataFrame:
        """One row per key."""
        needed = [*self.keys, value] + ([weight] if weight else [])
        df, parts = self._ranked(df.select(*dict.fromkeys(needed)), value, specs, weight, None)
        aggs = [c.alias(n) for n, c in neighbours(specs, lambda c: c, parts).items()]
        totals = [F.first(c).alias(c) for c in ("_n", "_mass") if c in df.columns]
        df = df.groupBy(*self.keys).agg(*totals, *aggs)
        return df.select(*self.keys, *[c.alias(n) for n, c in finish(specs).items()])

    def attach_agg(self, df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
        whole = Window.partitionBy(*self.keys)
        return df.withColumns({n: c.over(whole) for n, c in aggs.items()})

    def settle(self, df: DataFrame, base: DataFrame, state: list[str]) -> DataFrame:
        return df


class Spread:
    """Heavy keys: radix selection over merged values; only one row per heavy key and statistic goes back to the rows."""

    def __init__(self, keys: list[str], small: bool = True):
        self.keys, self.small = keys, small

    def _first_digit(self) -> Column:
        """Sign and magnitude in steps of a 16th of a doubling: never falls where the value rises, so it may cut anything."""
        x = F.col("_x")
        size = lambda v: F.floor(F.least(F.log2(v), F.lit(2000.0)) * 16) + 32_768
        return (F.when(F.isnan(x), F.lit(2 * DIGITS)).when(x > 0, size(x)).when(x < 0, -size(-x)).otherwise(F.lit(0))).cast("bigint")

    def _next_digit(self) -> Column:
        """Place between the least and the greatest value of the bucket, in ``DIGITS`` steps."""
        part = (F.col("_x") - F.col("_from")) / (F.col("_to") - F.col("_from"))
        return F.when(F.col("_from") < F.col("_to"), F.floor(F.least(part, F.lit(1.0)) * DIGITS)).otherwise(F.lit(0)).cast("bigint")

    def _wanted(self, specs: Specs) -> Column:
        """Whether a bucket (``_k0``, ``_w0`` before it, ``_bk``, ``_bw`` in it) can hold what a statistic needs."""
        hit = F.lit(False)
        n, k0, k1 = F.col("_n"), F.col("_k0"), F.col("_k0") + F.col("_bk")
        for kind, *rest in specs.values():
            q = F.lit(float(rest[0])) if rest else F.lit(0.5)
            if kind in ("mid", "wmed"):
                # Wider than rounding of the sums can move a border; the buckets beside a hit are kept as well.
                slack = F.col("_mass") * 1e-9 + 1e-11
                hit |= (F.col("_w0") <= F.col("_mass") * q + slack) & (F.col("_w0") + F.col("_bw") >= F.col("_mass") * q - slack)
                continue
            low = F.floor(q * (n - 1))
            ranks = {"upper": [F.floor(n / 2)], "rank": [low], "ceil": [F.greatest(F.ceil(q * n) - 1, F.lit(0))]}.get(
                kind, [low, F.least(low + 1, n - 1)])
            for rank in ranks:
                hit |= (k0 <= rank) & (rank < k1)
        return hit

    def _narrow(self, rows: DataFrame, digit: Column, specs: Specs, first: bool) -> tuple[DataFrame, bool]:
        """One round: (rows of the wanted buckets, whether a bucket is still too large for a window). A bucket is named by
        the rows of its key before it (``_p``); at most ``DIGITS`` times the wanted buckets are counted per key."""
        keys = self.keys
        rows = rows.withColumn("_d", digit)
        known = [] if first else ["_w0", "_n", "_mass"]
        found = rows.groupBy(*keys, "_p", "_d", *known).agg(
            F.sum("_k").alias("_bk"), F.sum("_w").alias("_bw"), F.count(F.lit(1)).alias("_m"), F.min("_x").alias("_from"), F.max("_x").alias("_to"))
        if first:
            whole = Window.partitionBy(*keys)
            found = found.withColumns({"_w0": F.lit(0.0), "_n": F.sum("_bk").over(whole), "_mass": F.sum("_bw").over(whole)})
        before = Window.partitionBy(*keys, "_p").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumns({"_k0": F.col("_p") + F.coalesce(F.sum("_bk").over(before), F.lit(0)),
                                   "_w0": F.col("_w0") + F.coalesce(F.sum("_bw").over(before), F.lit(0.0))})
        along = Window.partitionBy(*keys).orderBy("_k0")
        found = found.withColumn("_hit", self._wanted(specs))
        found = found.withColumn("_hit", F.col("_hit") | F.coalesce(F.lag("_hit").over(along), F.lit(False)) | F.coalesce(F.lead("_hit").over(along), F.lit(False)))
        kept = cut_lineage(found.where("_hit").drop("_hit", "_bk", "_bw"))
        more = not kept.where((F.col("_m") > LEAF) & (F.col("_from") < F.col("_to"))).isEmpty()
        rows = rows.select(*keys, "_v", "_x", "_k", "_w", "_w1", "_w2", "_p", "_d")
        rows = put_back(rows, kept.drop("_m"), [*keys, "_p", "_d"], self.small, "inner")
        return rows.drop("_p", "_d").withColumnRenamed("_k0", "_p"), more

    def table(self, df: DataFrame, value: str, specs: Specs, weight: str | None = None) -> DataFrame:
        keys = self.keys
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        rows = df.select(*keys, F.col(value).alias("_v"), w.alias("_w")).where(F.col("_v").isNotNull())
        rows = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_k"), F.sum("_w").alias("_w"), F.min("_w").alias("_w1"), F.max("_w").alias("_w2"))
        rows = rows.withColumns({"_x": F.col("_v").cast("double"), "_p": F.lit(0).cast("bigint")})
        rows, more = self._narrow(rows, self._first_digit(), specs, True)
        while more:
            rows, more = self._narrow(rows, self._next_digit(), specs, False)
        inside = Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumns({"_lo": F.col("_p") + F.sum("_k").over(inside) - F.col("_k"), "_cw": F.col("_w0") + F.sum("_w").over(inside)})
        parts = Parts(F.col("_v"), F.lit(True), F.col("_w"), F.col("_w1"), F.col("_w2"), F.col("_k"))
        aggs = [c.alias(n) for n, c in neighbours(specs, lambda c: c, parts).items()]
        # _n and _mass are constant per key: grouping by them keeps partial aggregation intact.
        table = rows.groupBy(*keys, "_n", "_mass").agg(*aggs)
        return table.select(*keys, *[c.alias(n) for n, c in finish(specs).items()])

    def attach(self, df: DataFrame, value: str | Column, specs: Specs, weight: str | None = None,
               where: Column | None = None) -> DataFrame:
        check_specs(specs)
        rows = df.where(where) if where is not None else df
        v = F.col(value) if isinstance(value, str) else value
        rows = rows.select(*self.keys, v.alias("_value"), (F.col(weight) if weight else F.lit(1.0)).alias("_weight"))
        # Written (one row per key), so that what follows does not hold the rounds in its plan.
        return put_back(df, cut_lineage(self.table(rows, "_value", specs, "_weight")), self.keys, self.small)

    def attach_agg(self, df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
        table = df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggs.items()])
        return put_back(df, table, self.keys, self.small)

    def settle(self, df: DataFrame, base: DataFrame, state: list[str]) -> DataFrame:
        """Write the per-key state of an iteration and put it back on the rows, so that the plan of the next pass does
        not contain the plans of all passes before it."""
        table = df.groupBy(*self.keys).agg(*[F.max(c).alias(c) for c in state])
        return put_back(base, cut_lineage(table), self.keys, self.small)


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], lead_value: Column, name: str = "row",
                hot: list | Hot | None = None) -> DataFrame:
    """``row_number`` per key that splits heavy keys: ``lead_value`` (numeric, sorts like the first entry of
    ``order``) places rows into ranges, ranks inside a range add to the size of the ranges before it."""
    light, heavy, small = heavy_part(df, keys, hot)
    out = light.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if heavy is None:
        return out
    rows = value_ranges(heavy, keys, lead_value, small)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_k"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)))
    rows = put_back(rows, sizes, [*keys, "_b"], small).withColumn(name, (F.col("_r") + F.col("_before")).cast("int"))
    return out.unionByName(rows.drop("_b", "_r", "_before"))


def value_ranges(df: DataFrame, keys: list[str], lead: Column, small: bool = True) -> DataFrame:
    """Adds ``_b``, the value range (of ``SPLITS``) a heavy key's row lies in; -1 where ``lead`` is NULL."""
    rows = df.withColumn("_lead", lead)
    cuts = F.array(*[F.lit(i / SPLITS) for i in range(1, SPLITS)])
    splits = rows.groupBy(*keys).agg(F.percentile_approx("_lead", cuts, SPLITS * 8).alias("_splits"))
    rows = put_back(rows, splits, keys, small)
    return rows.withColumn("_b", F.coalesce(F.size(F.filter("_splits", lambda s: s < F.col("_lead"))), F.lit(-1))).drop("_splits", "_lead")

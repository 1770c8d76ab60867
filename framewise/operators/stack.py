"""Robust combination of repeated measurements per key (stacking)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MIN_COVERAGE, choice, finite, require, require_columns
from .stats import TASK_ROWS, InTask, Spread, heavy_part, join_keys, per_key, sampled

INF = float("inf")
ROBUST = ("median", "sigma", "sigma_mad", "winsorized", "percentile")
PLAIN = ("average", "max", "min")
#: Fixed scale factors of the median absolute deviation.
MAD_ITERATIVE = 1.4826022185
MAD_WINSOR = 1.4826
#: Spacing of 32-bit floats at 1, part of the scale floor.
FLOAT_EPSILON = 1.1920928955078125e-07


@dataclass(frozen=True)
class StackOptions:
    """Column names and thresholds. ``low``/``high`` are sigmas, or quantiles for "percentile"."""

    value: str = "value"
    coverage: str = "coverage"
    frame: str = "frame_id"
    weight: str | None = None
    low: float = 3.0
    high: float = 3.0
    iterations: int = 3
    hot: list[int] | None = field(default=None, compare=False)

    def __post_init__(self):
        finite("low", self.low, 0)
        finite("high", self.high, 0)
        require(1 <= self.iterations <= 10, "iterations must be within 1..10")


def prepared(df: DataFrame, keys: list[str], o: StackOptions, carry: list[str] = []) -> DataFrame:
    """Adds ``_x`` (value, NULL if it does not count), ``_wt`` (its weight), ``_cc``/``_fw`` (coverage terms)."""
    require_columns(df, [*keys, o.value, o.coverage, *carry] + ([o.weight] if o.weight else []))
    fw = F.col(o.weight).cast("double") if o.weight else F.lit(1.0)
    value = F.col(o.value).cast("double")
    known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(INF))
    cover = F.when(known & ~F.isnan(F.col(o.coverage)),
                   F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(o.coverage).cast("double")))).otherwise(F.lit(0.0))
    df = df.select(*keys, *[c for c in dict.fromkeys(carry) if c not in keys],
                   value.alias("_raw"), cover.alias("_cover"), fw.alias("_fw"))
    counts = (F.col("_cover") > MIN_COVERAGE) & (F.col("_fw") > 0)
    return df.select(
        *[c for c in df.columns if c not in ("_raw", "_cover", "_fw")],
        F.when(counts, F.col("_raw")).alias("_x"),
        F.when(counts, F.col("_cover") * F.col("_fw")).alias("_wt"),
        (F.col("_cover") * F.col("_fw")).alias("_cc"), F.col("_fw"))


def mean_of(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def coverage_out() -> Column:
    return F.try_divide(F.sum("_cc"), F.sum("_fw")).alias("coverage")


def stack_average(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """Coverage-weighted mean per key; map-side partial sums, one shuffle, any skew."""
    o = StackOptions(**options)
    return prepared(df, keys, o).groupBy(*keys).agg(
        mean_of(F.col("_x"), F.col("_wt")).alias("value"), coverage_out(), F.count("_x").alias("samples"))


def stack_weighted(df: DataFrame, keys: list[str], scores: DataFrame, score: str = "score", **options) -> DataFrame:
    """As D1 with the frame weight scaled by ``max(.01, score)``; frames without a score do not count."""
    o = StackOptions(**options)
    require_columns(scores, [o.frame, score], "scores")
    base = F.col(o.weight).cast("double") if o.weight else F.lit(1.0)
    scored = df.join(scores.select(o.frame, F.greatest(F.lit(0.01), F.col(score)).alias("_score")), o.frame)
    scored = scored.withColumn("_scored", base * F.col("_score"))
    return stack_average(scored, keys, **{**options, "weight": "_scored"})


def stack_extreme(df: DataFrame, keys: list[str], which: str, **options) -> DataFrame:
    """Largest or smallest covered sample. Frame weights have no meaning here and are refused."""
    choice("which", which, ("max", "min"))
    o = StackOptions(**options)
    require(o.weight is None, "extrema take no frame weights")
    pick = F.max("_x") if which == "max" else F.min("_x")
    return prepared(df, keys, o).groupBy(*keys).agg(pick.alias("value"), coverage_out(), F.count("_x").alias("samples"))


def bounded(df: DataFrame, group: InTask | Spread, method: str, o: StackOptions) -> DataFrame:
    """Adds acceptance bounds ``_lo``/``_hi`` (and ``_mid``, the median where the method has one).

    Rows with NULL ``_x`` stay: they carry coverage."""
    x, w = F.col("_x"), F.col("_wt")
    if method == "median":
        df = group.attach(df, "_x", {"_mid": ("mid", 0.5)}, "_wt")
        return df.withColumns({"_lo_b": F.lit(-INF), "_hi_b": F.lit(INF)})
    if method == "sigma":
        df = group.attach_agg(df, {"_sx": F.sum(x * w), "_sw": F.sum(w)})
        df = df.withColumn("_mid", F.col("_sx") / F.col("_sw"))
        df = group.attach_agg(df, {"_sd": F.sum((x - F.col("_mid")) * (x - F.col("_mid")) * w)})
        df = df.withColumn("_sd", F.sqrt(F.col("_sd") / F.col("_sw")))
        return df.withColumns({"_lo_b": F.col("_mid") - F.lit(o.low) * F.col("_sd"),
                               "_hi_b": F.col("_mid") + F.lit(o.high) * F.col("_sd")}).drop("_sd", "_sx", "_sw")
    if method == "winsorized":
        df = group.attach(df, "_x", {"_mid": ("mid", 0.5)}, "_wt")
        df = group.attach(df, F.abs(x - F.col("_mid")), {"_mad": ("mid", 0.5)}, "_wt")
        sigma = F.greatest(F.lit(1.0e-6), F.col("_mad") * MAD_WINSOR)
        return df.withColumns({"_lo_b": F.col("_mid") - F.lit(o.low) * sigma,
                               "_hi_b": F.col("_mid") + F.lit(o.high) * sigma}).drop("_mad")
    if method == "percentile":
        require(o.low < o.high <= 1, "percentile bounds must satisfy 0 <= low < high <= 1")
        return group.attach(df, "_x", {"_lo_b": ("mid", o.low), "_hi_b": ("mid", o.high), "_mid": ("mid", 0.5)}, "_wt")
    return iterated(df, group, o)


def iterated(df: DataFrame, group: InTask | Spread, o: StackOptions) -> DataFrame:
    """Repeated median clipping: the centre moves, the scale stays that of the first pass, and the
    bounds only tighten. A key stops below five survivors, when a pass would leave fewer than three
    (the earlier bounds stay) or when a pass removes nothing."""
    x, w = F.col("_x"), F.col("_wt")
    base, state = df, ["_lo_b", "_hi_b", "_scale", "_left", "_stop", "_mid"]
    df = df.withColumns({"_lo_b": F.lit(-INF), "_hi_b": F.lit(INF), "_stop": F.lit(False)})
    df = group.attach(df, "_x", {"_mid": ("mid", 0.5)}, "_wt")
    df = group.attach(df, F.abs(x - F.col("_mid")), {"_mad": ("mid", 0.5)}, "_wt")
    df = group.attach_agg(df, {"_left": F.count("_x")})
    df = df.withColumn("_scale", F.greatest(F.col("_mad") * MAD_ITERATIVE,
                                            F.abs("_mid") * (FLOAT_EPSILON * 2), F.lit(1.0e-6))).drop("_mad")
    for step in range(o.iterations):
        if step:
            df = group.settle(df, base, state)
            df = group.attach(df.drop("_mid"), "_x", {"_mid": ("mid", 0.5)}, "_wt",
                              x.between(F.col("_lo_b"), F.col("_hi_b")))
        low = F.greatest(F.col("_lo_b"), F.col("_mid") - F.lit(o.low) * F.col("_scale"))
        high = F.least(F.col("_hi_b"), F.col("_mid") + F.lit(o.high) * F.col("_scale"))
        df = df.withColumns({"_lo_c": low, "_hi_c": high})
        df = group.attach_agg(df, {"_kept": F.count(F.when(x.between(F.col("_lo_c"), F.col("_hi_c")), 1))})
        go = ~F.col("_stop") & (F.col("_left") >= 5) & (F.col("_kept") >= 3)
        df = df.withColumns({
            "_stop": ~go | (F.col("_kept") == F.col("_left")),
            "_lo_b": F.when(go, F.col("_lo_c")).otherwise(F.col("_lo_b")),
            "_hi_b": F.when(go, F.col("_hi_c")).otherwise(F.col("_hi_b")),
            "_left": F.when(go, F.col("_kept")).otherwise(F.col("_left")),
        }).drop("_lo_c", "_hi_c", "_kept")
    return df.drop("_scale", "_left", "_stop")


def inside() -> Column:
    return F.col("_x").between(F.col("_lo_b"), F.col("_hi_b"))


def combine(df: DataFrame, keys: list[str], method: str) -> DataFrame:
    x, w = F.col("_x"), F.col("_wt")
    n = F.count("_x")
    kept = F.sum(F.when(inside(), w))
    kept_mean = F.sum(F.when(inside(), x * w)) / kept
    if method == "median":
        value = F.max("_mid")
    elif method == "winsorized":
        value = mean_of(F.greatest(F.col("_lo_b"), F.least(F.col("_hi_b"), x)), w)
    elif method == "percentile":
        value = F.coalesce(kept_mean, F.max("_mid"))
    else:  # no survivor: the plain mean
        value = F.coalesce(kept_mean, mean_of(x, w))
    return df.groupBy(*keys).agg(
        value.alias("value"), coverage_out(), n.alias("samples"),
        F.try_divide(F.count(F.when(x < F.col("_lo_b"), 1)), n).alias("rejected_low"),
        F.try_divide(F.count(F.when(x > F.col("_hi_b"), 1)), n).alias("rejected_high"),
        F.coalesce(kept, F.sum(w)).alias("accepted_weight"))


def sigma_by_sums(rows: DataFrame, keys: list[str], o: StackOptions) -> DataFrame:
    """D4 needs no order of the samples: mean, then spread around it, then the clipped sums, each a map-side aggregate of a
    few numbers per key, whatever the size of a key."""
    x, w = F.col("_x"), F.col("_wt")
    mean = rows.groupBy(*keys).agg((F.sum(x * w) / F.sum(w)).alias("_mid"))
    rows = join_keys(rows, mean, keys)
    spread = rows.groupBy(*keys).agg(F.sqrt(F.sum((x - F.col("_mid")) * (x - F.col("_mid")) * w) / F.sum(w)).alias("_sd"))
    rows = join_keys(rows, spread, keys)
    rows = rows.withColumns({"_lo_b": F.col("_mid") - F.lit(o.low) * F.col("_sd"), "_hi_b": F.col("_mid") + F.lit(o.high) * F.col("_sd")})
    return combine(rows, keys, "sigma")


def stack(df: DataFrame, keys: list[str], method: str = "winsorized", **options) -> DataFrame:
    """One row per key: value, coverage, samples, rejected fractions, accepted weight.

    ``value`` is NULL where nothing covered the key. One shuffle on the key; heavy keys are split."""
    choice("method", method, ROBUST)
    o = StackOptions(**options)
    if method == "sigma":
        return sigma_by_sums(prepared(df, keys, o), keys, o)
    return per_key(prepared(df, keys, o), keys,
                   lambda part, group: combine(bounded(part, group, method, o), keys, method), o.hot)


def stack_median(df, keys, **options):
    """D3"""
    return stack(df, keys, "median", **options)


def stack_sigma(df, keys, **options):
    """D4"""
    return stack(df, keys, "sigma", **options)


def stack_sigma_mad(df, keys, **options):
    """D5"""
    return stack(df, keys, "sigma_mad", **options)


def stack_winsorized(df, keys, **options):
    """D6"""
    return stack(df, keys, "winsorized", **options)


def stack_percentile(df, keys, low: float = 0.1, high: float = 0.9, **options):
    """D7"""
    return stack(df, keys, "percentile", low=low, high=high, **options)


def rejection_report(df: DataFrame, keys: list[str], method: str, **options) -> tuple[DataFrame, DataFrame]:
    """(per key, per frame). Frames: compared samples and how many fell below or above the bounds."""
    choice("method", method, ROBUST)
    o = StackOptions(**options)

    def count_frames(part, group):
        rows = bounded(part, group, method, o).where(F.col("_x").isNotNull())
        return rows.groupBy(o.frame).agg(
            F.count(F.lit(1)).alias("compared"),
            F.count(F.when(F.col("_x") < F.col("_lo_b"), 1)).alias("low"),
            F.count(F.when(F.col("_x") > F.col("_hi_b"), 1)).alias("high"))

    frames = per_key(prepared(df, keys, o, [o.frame]), keys, count_frames, o.hot)
    frames = frames.groupBy(o.frame).agg(F.sum("compared").alias("compared"), F.sum("low").alias("low"),
                                         F.sum("high").alias("high"))
    return stack(df, keys, method, **options), frames


def accepted_groups(df: DataFrame, keys: list[str], label: str, method: str, **options) -> DataFrame:
    """Mean and weight of the groups 0 and 1 over samples accepted under joint bounds. If the
    bounds reject everything, all samples count for both groups."""
    choice("method", method, ROBUST)
    o = StackOptions(**options)

    def body(part, group):
        rows = bounded(part, group, method, o)
        rows = group.attach_agg(rows, {"_any": F.count(F.when(inside(), 1))})
        accept = (inside() | (F.col("_any") == 0)) & F.col("_x").isNotNull()
        w = [F.sum(F.when(accept & (F.col(label) == g), F.col("_wt"))) for g in (0, 1)]
        s = [F.sum(F.when(accept & (F.col(label) == g), F.col("_wt") * F.col("_x"))) for g in (0, 1)]
        return rows.groupBy(*keys).agg(
            (s[0] / w[0]).alias("mean_0"), F.coalesce(w[0], F.lit(0.0)).alias("weight_0"),
            (s[1] / w[1]).alias("mean_1"), F.coalesce(w[1], F.lit(0.0)).alias("weight_1"))

    return per_key(prepared(df, keys, o, [label]), keys, body, o.hot)


def noise_diagnostic(df: DataFrame, keys: list[str], seq: str, variance: str, method: str, **options) -> DataFrame:
    """Even and odd halves stacked apart; their difference scaled to the noise of the full stack."""
    choice("method", method, ROBUST)
    o = StackOptions(**options)
    half_keys = [*keys, "_half"]
    rows = prepared(df, keys, o, [seq, variance]).withColumn("_half", F.pmod(F.col(seq), F.lit(2)).cast("int"))
    rows = rows.where(F.col("_x").isNotNull())

    def variances(part_keys):
        def body(part, group):
            part = bounded(part, group, method, o)
            part = group.attach_agg(part, {"_any": F.count(F.when(inside(), 1))})
            accept = inside() | (F.col("_any") == 0)
            w = F.sum(F.when(accept, F.col("_wt")))
            noise = F.sum(F.when(accept, F.col("_wt") * F.col("_wt") * F.col(variance)))
            clamped = F.greatest(F.col("_lo_b"), F.least(F.col("_hi_b"), F.col("_x")))
            if method == "median":
                value = F.max("_mid")
            elif method == "winsorized":
                value = mean_of(clamped, F.col("_wt"))
            else:
                value = F.sum(F.when(accept, F.col("_x") * F.col("_wt"))) / w
            return part.groupBy(*part_keys).agg(
                value.alias("mean"), (noise / (w * w)).alias("var"), F.count(F.when(accept, 1)).alias("n"))
        return body

    full = per_key(rows, keys, variances(keys), o.hot).select(*keys, F.col("var").alias("full_var"))
    halves = per_key(rows, half_keys, variances(half_keys), o.hot)
    pick = lambda name, h: F.max(F.when(F.col("_half") == h, F.col(name)))
    halves = halves.groupBy(*keys).agg(*[pick(n, h).alias(f"{n}_{h}") for n in ("mean", "var", "n") for h in (0, 1)])
    spread = F.col("var_0") + F.col("var_1")
    noise = (F.col("mean_0") - F.col("mean_1")) * F.sqrt(F.col("full_var") / spread)
    valid = ((F.coalesce(F.col("n_0"), F.lit(0)) >= 3) & (F.coalesce(F.col("n_1"), F.lit(0)) >= 3)
             & (F.col("full_var") > 0) & F.coalesce(spread > 0, F.lit(False)))
    return full.join(halves, keys).select(
        *keys, F.when(valid, noise).alias("noise"), F.coalesce(valid, F.lit(False)).alias("valid"))


def require_distinct_inputs(df: DataFrame, keys: list[str], frame: str = "frame_id") -> DataFrame:
    """Keys in which a frame was given more than once (empty when inputs are distinct)."""
    return (df.groupBy(*keys, frame).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") > 1))


def merge_accumulators(*partials: DataFrame, keys: list[str]) -> DataFrame:
    """I4: add stored partial sums (columns ``sum_vw``, ``sum_w``, ``samples``) of separate runs."""
    require(len(partials) >= 1, "nothing to merge")
    united = partials[0]
    for part in partials[1:]:
        united = united.unionByName(part)
    return united.groupBy(*keys).agg(F.sum("sum_vw").alias("sum_vw"), F.sum("sum_w").alias("sum_w"),
                                     F.sum("samples").alias("samples"))


def accumulate(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """Partial sums that :func:`merge_accumulators` and :func:`render_accumulator` understand."""
    return prepared(df, keys, StackOptions(**options)).groupBy(*keys).agg(
        F.sum(F.col("_x") * F.col("_wt")).alias("sum_vw"), F.sum("_wt").alias("sum_w"), F.count("_x").alias("samples"))


def render_accumulator(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, (F.col("sum_vw") / F.col("sum_w")).alias("value"), "samples")


def stack_with(df: DataFrame, keys: list[str], combine_values, **options) -> DataFrame:
    """caller's own combination. ``combine_values(values, weights) -> float`` sees one key's samples.

    Spark shuffles and sorts by key; the Python task streams through its partition and holds the
    samples of a single key at a time, which is the least such a function can need."""
    import pandas as pd

    o = StackOptions(**options)
    rows = prepared(df, keys, o, [o.frame]).where(F.col("_x").isNotNull())
    rows = rows.select(*keys, o.frame, "_x", "_wt").repartition(*keys).sortWithinPartitions(
        *keys, o.frame, "_x", "_wt")

    def run(batches):
        # A key that spans batches is kept in pieces, put together once when its last row has come.
        pieces = []
        for batch in batches:
            if batch.empty:
                continue
            begins = key_begins(batch, keys)
            if pieces and not key_begins(pd.concat([pieces[-1].tail(1), batch.head(1)]), keys)[1]:
                begins[0] = False
            last = int(begins.nonzero()[0][-1]) if begins.any() else None
            if last is None:
                pieces.append(batch)
                continue
            done = pd.concat([*pieces, batch.iloc[:last]], ignore_index=True)
            if len(done):
                yield finish_keys(done, key_begins(done, keys).cumsum())
            pieces = [batch.iloc[last:]]
        if pieces:
            done = pd.concat(pieces, ignore_index=True)
            yield finish_keys(done, key_begins(done, keys).cumsum())

    def finish_keys(done, run_id):
        out = [(*(g[k].iloc[0] for k in keys), float(combine_values(g["_x"].to_numpy(), g["_wt"].to_numpy())))
               for _, g in done.groupby(run_id, sort=False)]
        return pd.DataFrame(out, columns=[*keys, "value"])

    types = dict(df.dtypes)
    return rows.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", value double")


def key_begins(rows, keys: list[str]):
    """Where a row of a sorted pandas frame has other keys than the row before it; missing keys are equal."""
    k = rows[keys]
    before = k.shift()
    begins = (k.ne(before) & ~(k.isna() & before.isna())).any(axis=1).to_numpy().copy()
    if len(begins):
        begins[0] = True
    return begins


def stack_merged(df: DataFrame, keys: list[str], partial, merge, finish, salts: int = 64, held: int = 4096, **options) -> DataFrame:
    """caller's own combination in three parts, for keys of any size.

    ``partial(values, weights) -> state`` sees some samples of a key, ``merge(state, state) -> state`` joins two states (in
    any order), ``finish(state) -> float`` gives the value. Samples of ordinary keys are sorted by key and a task streams through
    them, so a key costs one state per batch it lies in. Heavy keys, and all of them where there are at most ``held``, are merged
    by each task before anything is shuffled (at most ``held`` at a time); the states of a key then meet in ``salts``
    groups and at last in one. Either way a task holds few states and a batch, and a key with most of the rows sends one state
    per task and salt."""
    import pickle

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    require(salts >= 1 and held >= 1, "salts and held must be positive")
    o = StackOptions(**options)
    rows = prepared(df, keys, o, [o.frame]).where(F.col("_x").isNotNull()).select(*keys, F.col("_x").cast("double"), F.col("_wt").cast("double"))
    types = dict(rows.dtypes)
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    same = lambda a, b: all(x == y or (x != x and y != y) for x, y in zip(a, b))

    def table(found, schema):
        columns = [pa.array([key[i] for key, _ in found], schema.field(k).type) for i, k in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for _, s in found], pa.binary())], [*keys, "state"])

    def begin(batches):
        states, schema = {}, None
        for batch in batches:
            schema = batch.schema
            t = pa.Table.from_batches([batch])
            t = t.append_column("_i", pa.array(range(len(t)), pa.int64()))
            values, weights = batch.column("_x").to_numpy(zero_copy_only=False), batch.column("_wt").to_numpy(zero_copy_only=False)
            groups = t.select([*keys, "_i"]).group_by(keys, use_threads=False).aggregate([("_i", "list")])
            names = zip(*[groups.column(k).to_pylist() for k in keys])
            for key, at in zip(names, groups.column("_i_list")):
                at = at.values.to_numpy()
                state = partial(values[at], weights[at])
                states[key] = merge(states[key], state) if key in states else state
                if len(states) >= held:
                    yield table(list(states.items()), schema)
                    states = {}
        if states:
            yield table(list(states.items()), schema)

    def merged(batches):
        """(key, state, schema) of keys that lie side by side in a sorted partition."""
        key = state = schema = None
        for batch in batches:
            schema = batch.schema
            names = zip(*[batch.column(k).to_pylist() for k in keys])
            for name, data in zip(names, batch.column("state")):
                more = pickle.loads(data.as_py())
                if key is not None and same(key, name):
                    state = merge(state, more)
                    continue
                if key is not None:
                    yield key, state, schema
                key, state = name, more
        if key is not None:
            yield key, state, schema

    def join_states(batches):
        for key, state, schema in merged(batches):
            yield table([(key, state)], schema)

    def end(batches):
        for key, state, schema in merged(batches):
            columns = [pa.array([key[i]], schema.field(k).type) for i, k in enumerate(keys)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([float(finish(state))], pa.float64())], [*keys, "value"])

    def run_begins(batch):
        """Places in a sorted batch where a key begins; missing keys are equal."""
        new = np.zeros(len(batch) - 1, dtype=bool)
        for k in keys:
            one, two = batch.column(k).slice(1), batch.column(k).slice(0, len(batch) - 1)
            equal = pc.or_(pc.fill_null(pc.equal(one, two), False), pc.and_(one.is_null(), two.is_null()))
            if pa.types.is_floating(one.type):
                equal = pc.or_(equal, pc.fill_null(pc.and_(pc.is_nan(one), pc.is_nan(two)), False))
            new |= ~equal.to_numpy(zero_copy_only=False)
        return [0, *(np.flatnonzero(new) + 1).tolist()]

    def stream(batches):
        """Values of keys whose samples lie side by side in a sorted partition."""
        name = state = last = None
        for batch in batches:
            if not len(batch):
                continue
            values, weights = batch.column("_x").to_numpy(zero_copy_only=False), batch.column("_wt").to_numpy(zero_copy_only=False)
            begins = run_begins(batch)
            key_columns = batch.select(keys)
            goes_on = name is not None and same(name, tuple(key_columns.slice(0, 1).to_pylist()[0].values()))
            done = [] if last is None or goes_on else [(last, [float(finish(state))])]
            out = []
            for i, (at, end) in enumerate(zip(begins, [*begins[1:], len(batch)])):
                if i:
                    out.append(float(finish(state)))
                more = partial(values[at:end], weights[at:end])
                state = merge(state, more) if goes_on and not i else more
            if out:
                done.append((key_columns.take(pa.array(begins[:-1], pa.int64())), out))
            for of, found in done:
                yield pa.RecordBatch.from_arrays([*of.columns, pa.array(found, pa.float64())], [*keys, "value"])
            last = key_columns.slice(begins[-1], 1)
            name = tuple(last.to_pylist()[0].values())
        if last is not None:
            yield pa.RecordBatch.from_arrays([*last.columns, pa.array([float(finish(state))], pa.float64())], [*keys, "value"])

    def by_states(rows):
        states = rows.mapInArrow(begin, f"{key_schema}, state binary")
        salted = states.withColumn("_salt", F.pmod(F.xxhash64("state"), F.lit(salts)))
        states = salted.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt").drop("_salt").mapInArrow(join_states, f"{key_schema}, state binary")
        return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(end, f"{key_schema}, value double")

    if rows.agg(F.approx_count_distinct(F.xxhash64(*keys)).alias("n")).first()["n"] <= held:
        return by_states(rows)
    hot, n = sampled(rows, keys)
    light, heavy, _ = heavy_part(rows, keys, hot or [])
    light = light.repartition(max(math.ceil(n / TASK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
    out = light.sortWithinPartitions(*keys).mapInArrow(stream, f"{key_schema}, value double")
    return out if heavy is None else out.unionByName(by_states(heavy))
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import stack as st
from framewise.operators import stats
from framewise.session import HOT_ROWS_CONF

SPECS = {"a": ("lin", 0.3), "b": ("avg",), "c": ("upper",), "d": ("rank", 0.7), "e": ("ceil", 0.95),
         "f": ("mid", 0.25), "g": ("wmed",)}


@pytest.fixture()
def skewed(spark):
    """Key 0 holds more than a third of the rows; many equal values; a few NULLs."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        k = 0 if i % 3 == 0 else int(rng.integers(1, 40))
        v = float(np.round(rng.normal(100, 20), 1)) if i % 5 else 90.0
        rows.append((k, i, None if i % 97 == 0 else v, float(rng.choice([0.25, 0.5, 1.0]))))
    return spark.createDataFrame(rows, "k int, frame_id bigint, value double, coverage double")


def mid(values, weights, q):
    pairs = sorted(zip(values, weights))
    total, cum, prev = sum(w for _, w in pairs), 0.0, None
    for v, w in pairs:
        cum += w
        p = (cum - w / 2) / total
        if p >= q:
            if prev is None or p <= prev[0]:
                return v
            return prev[1] + (v - prev[1]) * (q - prev[0]) / (p - prev[0])
        prev = (p, v)
    return pairs[-1][0]


def brute(values, weights):
    s = sorted(values)
    n = len(s)
    at = 0.3 * (n - 1)
    lo = math.floor(at)
    half, cum, wm = sum(weights) / 2, 0.0, None
    pairs = sorted(zip(values, weights))
    for i, (v, w) in enumerate(pairs):
        cum += w
        if cum >= half:
            wm = (v + pairs[i + 1][0]) / 2 if cum == half and i + 1 < n else v
            break
    return {"a": s[lo] + (s[min(lo + 1, n - 1)] - s[lo]) * (at - lo), "b": statistics.median(s), "c": s[n // 2],
            "d": s[math.floor(0.7 * (n - 1))], "e": s[math.ceil(0.95 * n) - 1], "f": mid(values, weights, 0.25), "g": wm}


@pytest.mark.parametrize("hot", [None, 100])
def test_quantiles_match_brute_force_with_and_without_heavy_keys(spark, skewed, hot):
    spark.conf.set(HOT_ROWS_CONF, hot or 10_000_000)
    try:
        assert bool(stats.hot_keys(skewed, ["k"])) == bool(hot)
        got = {r["k"]: r for r in stats.quantiles(skewed, ["k"], "value", SPECS, "coverage").collect()}
        per = {}
        for r in skewed.where("value is not null").collect():
            per.setdefault(r["k"], []).append((r["value"], r["coverage"]))
        assert set(got) == set(per)
        for k, pairs in per.items():
            want = brute([p[0] for p in pairs], [p[1] for p in pairs])
            for name, value in want.items():
                assert got[k][name] == pytest.approx(value, abs=1e-9), (k, name)
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


@pytest.mark.parametrize("listed,leaf", [(1024, 65_536), (1024, 3), (0, 3)])
def test_radix_selection_with_nine_tenths_in_one_key(spark, monkeypatch, listed, leaf):
    """Listed, and written and salted heavy keys; few and many rounds; ties, signs, magnitudes far apart."""
    monkeypatch.setattr(stats, "LISTED", listed)
    monkeypatch.setattr(stats, "BROADCAST_KEYS", listed)
    monkeypatch.setattr(stats, "LEAF", leaf)
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.normal(0, 1, 700), np.exp(rng.uniform(-600, 600, 400)), -np.exp(rng.uniform(-600, 600, 300)),
                             np.full(500, 0.25), 1 + np.arange(200) * 2.0 ** -50, [0.0, -0.0, 1e308, -1e308, 5e-324]])
    rng.shuffle(values)
    rows = [(None if i % 10 else i % 3, float(v), float(rng.choice([0.25, 0.5, 1.0]))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, value double, coverage double")
    spark.conf.set(HOT_ROWS_CONF, 60)
    try:
        hot = stats.hot_keys(df, ["k"])
        assert (hot.hashes is None) == (listed == 0) and hot.small == (listed > 0)
        got = {r["k"]: r for r in stats.quantiles(df, ["k"], "value", SPECS, "coverage").collect()}
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    per = {}
    for k, v, w in rows:
        per.setdefault(k, []).append((v, w))
    assert set(got) == set(per)
    for k, pairs in per.items():
        for name, value in brute([p[0] for p in pairs], [p[1] for p in pairs]).items():
            assert got[k][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (k, name)


def test_rounds_read_fewer_rows_and_no_key_needs_a_sketch(spark, monkeypatch):
    """The digits never fall where the value rises, so a bucket is a range; a sample finds the heavy keys at any share."""
    monkeypatch.setattr(stats, "SEEN", 64)
    df = spark.range(40_000).select((F.col("id") % 40).alias("k"), (F.col("id") * 0.37 - 5000).alias("_x"))
    spread = stats.Spread(["k"])
    cut = df.withColumn("_d", spread._first_digit()).groupBy("k", "_d").agg(F.min("_x").alias("a"), F.max("_x").alias("b"))
    for k in (0, 17):
        ranges = [(r["a"], r["b"]) for r in cut.where(F.col("k") == k).orderBy("_d").collect()]
        assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:])) and len(ranges) > 20
    spark.conf.set(HOT_ROWS_CONF, 400)
    try:
        assert len(stats.hot_keys(df, ["k"]).hashes) == 40
        spark.conf.set(HOT_ROWS_CONF, 4000)
        assert stats.hot_keys(df, ["k"]) is None
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


@pytest.mark.parametrize("method", st.ROBUST)
def test_heavy_keys_give_the_same_stack(spark, skewed, method):
    o = {"low": 0.1, "high": 0.8} if method == "percentile" else {"low": 1.5, "high": 1.5}
    plain = {r["k"]: r for r in st.stack(skewed, ["k"], method, hot=[], **o).collect()}
    spark.conf.set(HOT_ROWS_CONF, 50)
    try:
        split = {r["k"]: r for r in st.stack(skewed, ["k"], method, **o).collect()}
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert set(plain) == set(split)
    for k in plain:
        for c in plain[k].asDict():
            assert split[k][c] == pytest.approx(plain[k][c], rel=1e-9), (k, c)


def disc_frames(spark):
    rows = []
    for f in range(11):
        for y in range(32):
            for x in range(32):
                r2 = (x - 15.5) ** 2 + (y - 15.5) ** 2
                v = 100 + 70 * math.exp(-r2 / 25) + (3000 if f == 0 and x == 10 else -1000 if f == 10 and x == 20 else 0)
                rows.append((f, x, y, 0, v, 0.0 if x == 0 and f > 2 else 1.0))
    return spark.createDataFrame(rows, "frame_id bigint, x int, y int, channel int, value double, coverage double")


@pytest.mark.parametrize("method", ["sigma_mad", "winsorized"])
def test_transients_are_rejected_and_counted(spark, method):
    df = disc_frames(spark)
    pixels, frames = st.rejection_report(df, ["x", "y", "channel"], method, low=3.0, high=3.0, iterations=5)
    for r in pixels.collect():
        want = 100 + 70 * math.exp(-((r["x"] - 15.5) ** 2 + (r["y"] - 15.5) ** 2) / 25)
        assert r["value"] == pytest.approx(want, abs=1e-3)
        assert r["rejected_high"] == pytest.approx(1 / 11 if r["x"] == 10 else 0)
        assert r["rejected_low"] == pytest.approx(1 / 11 if r["x"] == 20 else 0)
        assert r["coverage"] == pytest.approx(3 / 11 if r["x"] == 0 else 1)
    counts = {r["frame_id"]: (r["low"], r["high"]) for r in frames.collect()}
    assert counts[0] == (0, 32) and counts[10] == (32, 0) and counts[5] == (0, 0)


def test_partition_count_does_not_matter(spark, skewed):
    results = []
    for n in (1, 7, 50):
        rows = st.stack(skewed.repartition(n), ["k"], "winsorized", low=2.0, high=2.0).orderBy("k").collect()
        results.append([(r["k"], round(r["value"], 9), r["samples"]) for r in rows])
    assert results[0] == results[1] == results[2]


def test_empty_single_and_missing(spark):
    schema = "k int, frame_id bigint, value double, coverage double"
    empty = spark.createDataFrame([], schema)
    df = spark.createDataFrame([(1, 0, 5.0, 1.0), (2, 0, None, 1.0), (3, 0, float("nan"), 1.0), (4, 0, 7.0, 0.0)], schema)
    for method in st.ROBUST:
        o = {"low": 0.1, "high": 0.9} if method == "percentile" else {}
        assert st.stack(empty, ["k"], method, **o).count() == 0
        got = {r["k"]: r for r in st.stack(df, ["k"], method, **o).collect()}
        assert got[1]["value"] == 5.0
        assert all(got[k]["value"] is None and got[k]["coverage"] == 0 for k in (2, 3, 4))


def test_bad_arguments(spark, skewed):
    with pytest.raises(ValueError):
        st.stack(skewed, ["k"], "mode")
    with pytest.raises(ValueError):
        st.stack(skewed, ["missing"], "median")
    with pytest.raises(ValueError):
        st.stack(skewed, ["k"], "sigma", low=-1)
    with pytest.raises(ValueError):
        st.stack(skewed, ["k"], "percentile", low=0.9, high=0.1)
    with pytest.raises(ValueError):
        st.stack_extreme(skewed, ["k"], "max", weight="coverage")
    with pytest.raises(ValueError):
        stats.quantiles(skewed, ["k"], "value", {"a": ("lin", 2)})


def test_custom_combination_spans_batches(spark, skewed):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = st.stack_with(skewed, ["k"], lambda v, w: float((v * w).sum() / w.sum()))
        want = {r["k"]: r["value"] for r in st.stack_average(skewed, ["k"]).collect()}
        rows = got.collect()
        assert len(rows) == len(want)
        assert all(r["value"] == pytest.approx(want[r["k"]]) for r in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_own_combinations_with_nine_tenths_in_one_key(spark):
    """Whole keys and merged states; NULL keys are one key; batches far smaller than a key."""
    rng = np.random.default_rng(4)
    rows = [(None if i % 20 == 0 else 2**60 + (i % 60 if i % 20 == 1 else 0), i, float(rng.normal()), 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "k bigint, frame_id bigint, value double, coverage double")
    want = {}
    for k, _, v, _ in rows:
        want.setdefault(k, []).append(v)
    largest = []
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        whole = st.stack_with(df.where("k is null or k >= 0").withColumn("k", F.col("k") - 2**60), ["k"], lambda v, w: float(v.sum())).collect()
        parts = (lambda v, w: [len(v), float(v.sum()), len(v)], lambda a, b: [a[0] + b[0], a[1] + b[1], max(a[2], b[2])])
        merged = st.stack_merged(df, ["k"], *parts, lambda s: s[1], salts=3, held=2).collect()
        largest = st.stack_merged(df, ["k"], *parts, lambda s: s[2], salts=3, held=2).collect()
        empty = st.stack_merged(df.limit(0), ["k"], *parts, lambda s: s[1]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(merged) == len(whole) == len(want) and empty == []
    assert {r["k"]: r["value"] for r in merged} == pytest.approx({k: sum(v) for k, v in want.items()})
    back = {None if r["k"] is None else r["k"] + 2**60: r["value"] for r in whole}
    assert back == pytest.approx({k: sum(v) for k, v in want.items()})
    assert max(r["value"] for r in largest) <= 50


def test_merged_states_of_many_keys_see_all_samples_of_a_batch(spark):
    """Keys scattered over the rows are put side by side first: no sample travels as a state of its own; NULL and NaN are keys."""
    rows = [(None if i % 97 == 0 else float("nan") if i % 89 == 0 else float(i % 300), str(i % 2), i, float(i % 11), 1.0) for i in range(6000)]
    df = spark.createDataFrame(rows, "k double, s string, frame_id bigint, value double, coverage double")
    name = lambda k, s: (k if k is None or k == k else "nan", s)
    want = {}
    for k, s, _, v, _ in rows:
        want.setdefault(name(k, s), []).append(v)
    parts = (lambda v, w: (len(v), float(v.sum()), 1), lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
    read = lambda d: {name(r["k"], r["s"]): r["value"] for r in d.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        sums = st.stack_merged(df, ["k", "s"], *parts, lambda s: s[1], held=50)
        calls = st.stack_merged(df, ["k", "s"], *parts, lambda s: s[2], held=50).agg(F.sum("value")).first()[0]
        assert sums.count() == len(want) and read(sums) == {k: sum(v) for k, v in want.items()}
        assert calls < len(want) + 60
        spark.conf.set(HOT_ROWS_CONF, 40)
        assert read(st.stack_merged(df, ["k", "s"], *parts, lambda s: s[1], held=50)) == read(sums)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset(HOT_ROWS_CONF)


def test_accumulators_merge_to_the_whole(spark, skewed):
    a = st.accumulate(skewed.where(F.col("frame_id") % 2 == 0), ["k"])
    b = st.accumulate(skewed.where(F.col("frame_id") % 2 == 1), ["k"])
    got = {r["k"]: r["value"] for r in st.render_accumulator(st.merge_accumulators(a, b, keys=["k"]), ["k"]).collect()}
    want = {r["k"]: r["value"] for r in st.stack_average(skewed, ["k"]).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("method", ["sigma_mad", "winsorized"])
def test_tasks_of_ordinary_keys_grow_in_number_with_the_rows(spark, monkeypatch, method):
    """A task holds about ``TASK_ROWS`` rows, however many there are; the results are those of one way of dealing."""
    rng = np.random.default_rng(7)
    rows = [(int(k), int(f), float(v), 1.0) for k, f, v in zip(rng.integers(0, 400, 20000), range(20000), rng.normal(10, 2, 20000))]
    df = spark.createDataFrame(rows, "k bigint, frame_id bigint, value double, coverage double")
    want = sorted(map(tuple, st.stack(df, ["k"], method, hot=[]).collect()))
    monkeypatch.setattr(stats, "TASK_ROWS", 500, raising=False)
    spark.conf.set(HOT_ROWS_CONF, 4096)
    try:
        got = st.stack(df, ["k"], method)
        per_task = got.groupBy(F.spark_partition_id()).agg(F.sum("samples").alias("n")).collect()
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert max(r["n"] for r in per_task) < 2500
    assert [r[0] for r in want] == sorted(r["k"] for r in got.select("k").collect())
    assert np.allclose(np.array(want, float), np.array(sorted(map(tuple, got.collect())), float), equal_nan=True)

"""Rules along a sequence: one heavy key against plain Python, whole and split."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from framewise.operators import events, sequences as sq


@pytest.fixture(params=[False, True], ids=["windows", "ranges"])
def limit(spark, request):
    if request.param:
        spark.conf.set("spark.framewise.hotRows", "50")
    yield
    spark.conf.unset("spark.framewise.hotRows")


def test_sequence_rules(spark, limit):
    rng = random.Random(3)
    rows = [(1 if i % 10 else i, i, float(rng.randint(0, 30)) if i % 17 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, v double")
    order, lead = [F.col("v"), F.col("i")], F.coalesce(F.col("v"), F.lit(-1.0))
    groups = {}
    for k, i, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        groups.setdefault(k, []).append((i, v))
    held = {r["i"]: r["held"] for r in sq.hold_out(df, ["k"], order, lead).collect()}
    fold = {r["i"]: r["fold"] for r in sq.folds(df, ["k"], order, lead, 3).collect()}
    run = {r["i"]: r["running"] for r in sq.running_weight(df, ["k"], order, lead, "v").collect()}
    beside = {r["i"]: (r["previous"], r["next"]) for r in sq.neighbour_values(df, ["k"], order, lead, "v").collect()}
    peers = {r["i"]: r["peer_median"] for r in sq.leave_one_out_median(df, ["k"], "v").collect()}
    first = {r["i"]: r["first_v"] for r in sq.first_row(df, ["k"], [F.col("i")], ["v"]).collect()}
    assert len(held) == len(fold) == len(run) == len(beside) == len(peers) == len(first) == 1500
    for own in groups.values():
        total = 0.0
        values = [v for _, v in own if v is not None]
        start = min(own)[1]
        for n, (i, v) in enumerate(own):
            total += v or 0.0
            assert held[i] == (n % 5 == 4) and fold[i] == n % 3 and run[i] == pytest.approx(total) and first[i] == start
            assert beside[i] == (own[n - 1][1] if n else None, own[n + 1][1] if n + 1 < len(own) else None)
            if v is not None and len(values) > 1:
                rest = values.copy()
                rest.remove(v)
                assert peers[i] == statistics.median(rest)
            else:
                assert peers[i] is None


def test_mutual_best(spark):
    pairs = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 7.0), (3, 2, 4.0), (4, 9, None)], "a int, b int, s double")
    assert {tuple(r) for r in sq.mutual_best(pairs, "a", "b", "s").collect()} == {(2, 1, 7.0)}
    assert sq.mutual_best(pairs.limit(0), "a", "b", "s").count() == 0


def test_trails_of_named_frames(spark):
    """Frame ids that are no numbers give the same answer."""
    rows = [(n, n % 4, "sat", 0.0, 0.0 + n % 3, 100.0, 5.0 + n % 3, 2.0, 1.0) for n in range(12)]
    df = spark.createDataFrame(rows, "trail_id bigint, frame_id bigint, kind string, x1 double, y1 double, x2 double, y2 double, width double, weight double")
    plain = {tuple(r) for r in events.recurrent_trails(df, 2).drop("frame_id").collect()}
    named = {tuple(r) for r in events.recurrent_trails(df.withColumn("frame_id", F.concat(F.lit("f"), "frame_id")), 2).drop("frame_id").collect()}
    assert plain == named and plain

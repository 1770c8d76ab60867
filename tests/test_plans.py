"""Counts of the calibration plan and confirmed regions against plain loops; registered queries keep their contract."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import events as ev
from framewise.operators import metadata as md
from framewise.plans import registry

ACQ = ("id bigint, text map<string,string>, numeric map<string,double>, width int, height int, channels int, "
       "issues array<struct<field: string, code: string, message: string>>")


def records(n, seed, kinds):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = {"camera": rng.choice(["a", "b"]), "cameraSerial": "s", "sampling": "mono", "domain": "linear", "units": "ADU", "readoutMode": "1",
                "object": "M31", "observedAt": "2024-01-01", "frameType": rng.choice(kinds)}
        num = {"gain": 1.0, "exposure": float(rng.choice([30, 60])), "binX": 1.0, "binY": 1.0, "originX": 0.0, "originY": 0.0, "offset": 5.0}
        if rng.random() < 0.2:
            del text["camera"]
        shape = rng.random()
        if shape < 0.7:
            num["sensorTemperature"] = rng.choice([-10.0, -9.6, -9.0, -8.2])
        elif shape < 0.85:
            num["sensorTemperatureMin"], num["sensorTemperatureMax"] = rng.choice([(-10.0, -9.5), (-8.0, -9.0)])
        rows.append((i, text, num, 8, 8, 1, [("f", "c", "m")] if rng.random() < 0.1 else []))
    return rows


@pytest.mark.parametrize("role", ["dark", "flat"])
def test_plan_counts_equal_all_pairs(spark, role):
    inputs = spark.createDataFrame(records(60, 1, ["Light", "Dark"]), ACQ).withColumnRenamed("id", "frame_id")
    masters = spark.createDataFrame(records(12, 2, ["Master Dark", "Master Flat", "Bias"]), ACQ).withColumnRenamed("id", "master_id")
    members = md.group_acquisitions(inputs)[0]
    groups, issues = md.calibration_plan(inputs, members, masters, role, 0.5, [], ["gain"])
    pairs = md.match_calibration(inputs, masters, role, 0.5, on_numeric=["gain"], candidates_only=False).join(members, "frame_id").collect()
    counts, found = {}, {}
    for p in pairs:
        key = (p["group_id"], p["master_id"])
        counts.setdefault(key, {}).setdefault(p["status"], set()).add(p["frame_id"])
        for e in p["evidence"]:
            if e["status"] in ("missing", "conflict", "invalid"):
                found.setdefault((*key, e["field"], e["status"]), set()).add(p["frame_id"])
    got = {(r["group_id"], r["master_id"]): r for r in groups.collect()}
    assert set(got) == set(counts)
    for key, by in counts.items():
        assert [got[key][s] for s in ("compatible", "review", "incompatible")] == [len(by.get(s, ())) for s in ("compatible", "review", "incompatible")], key
    rows = {(r["group_id"], r["master_id"], r["field"], r["issue"]): (r["count"], r["first_member"]) for r in issues.collect()}
    assert rows == {k: (len(v), min(v)) for k, v in found.items()}


def test_plan_lists_are_dealt_and_no_member_meets_a_master_alone(spark, monkeypatch):
    """Pieces of single temperatures are searched in lists, longer ones in several; temperatures on the very bounds count as near."""
    seen, old = [], md._near_members
    monkeypatch.setattr(md, "_near_members", lambda left, *a: seen.append(left) or old(left, *a))
    text = {"camera": "a", "cameraSerial": "s", "sampling": "mono", "domain": "linear", "units": "ADU", "readoutMode": "1", "object": "M31", "observedAt": "2024-01-01"}
    num = {"gain": 1.0, "exposure": 30.0, "binX": 1.0, "binY": 1.0, "originX": 0.0, "originY": 0.0, "offset": 5.0}
    rng = random.Random(4)
    heat = lambda: {} if rng.random() < 0.1 else {"sensorTemperature": round(rng.uniform(-12, -8), 1)}
    inputs = spark.createDataFrame([(i, text | {"camera": rng.choice("ab"), "frameType": "Light"}, num | heat(), 8, 8, 1, []) for i in range(80)], ACQ).withColumnRenamed("id", "frame_id")
    spans = [heat() if i % 3 else {"sensorTemperatureMin": -10.3, "sensorTemperatureMax": -10.3 + 0.1 * (i % 4)} for i in range(15)]
    masters = spark.createDataFrame([(i, text | {"frameType": "Master Dark"}, num | h, 8, 8, 1, []) for i, h in enumerate(spans)], ACQ).withColumnRenamed("id", "master_id")
    members = md.group_acquisitions(inputs)[0]
    pairs = md.match_calibration(inputs, masters, "dark", 0.5, on_numeric=["gain"], candidates_only=False).join(members, "frame_id").collect()
    want, found = {}, {}
    for p in pairs:
        key = (p["group_id"], p["master_id"])
        want.setdefault(key, []).append(p["status"])
        for e in p["evidence"]:
            if e["status"] in ("missing", "conflict", "invalid"):
                found.setdefault((*key, e["field"], e["status"]), set()).add(p["frame_id"])
    for listed, masters_listed in ((8192, 512), (7, 4)):
        monkeypatch.setattr(md, "LISTED", listed, raising=False)
        monkeypatch.setattr(md, "MASTERS_LISTED", masters_listed, raising=False)
        groups, issues = md.calibration_plan(inputs, members, masters, "dark", 0.5, [], ["gain"])
        got = {(r["group_id"], r["master_id"]): [r[s] for s in ("compatible", "review", "incompatible")] for r in groups.collect()}
        assert got == {k: [v.count(s) for s in ("compatible", "review", "incompatible")] for k, v in want.items()}
        rows = [((r["group_id"], r["master_id"], r["field"], r["issue"]), (r["count"], r["first_member"])) for r in issues.collect()]
        assert len(rows) == len(found) and dict(rows) == {k: (len(v), min(v)) for k, v in found.items()}
    assert seen and all(left.isEmpty() for left in seen)


def overlap(a, b):
    w = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    h = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    return w * h / (a[3] * a[4] + b[3] * b[4] - w * h)


def test_confirmed_regions_follow_the_sequential_rule(spark):
    rng = random.Random(3)
    box = lambda i: (i, float(rng.randrange(0, 200)), float(rng.randrange(0, 200)), float(rng.randrange(40, 90)), float(rng.randrange(40, 90)))
    cand, known = [box(i) for i in range(40)], [box(100 + i) for i in range(4)]
    refs = [(f, *box(1000 + 40 * f + i)) for f in range(5) for i in range(6)]
    area = 1e6
    regions = [{"b": b, "c": 0.4, "s": 0, "id": b[0]} for b in known]
    for b in cand:
        support = len({r[0] for r in refs if overlap(b, r[1:]) >= 0.10})
        if support < max(2, (5 + 2) // 3):
            continue
        hit = next((r for r in regions if overlap(b, r["b"]) >= 0.50), None)
        if hit:
            hit["s"], hit["c"] = max(hit["s"], support), min(1.0, hit["c"] + 0.035 * support)
        else:
            regions.append({"b": b, "c": min(1.0, 0.3 + 0.035 * support), "s": support, "id": b[0]})
    cols = "region_id bigint, x double, y double, width double, height double, coverage double, confidence double, mean_luminance double, background_luminance double"
    full = lambda b, c: (*b, b[3] * b[4] / area * 0.6, c, 0.2, 0.5)
    fresh, old = ev.temporal_support(
        spark.createDataFrame([full(b, 0.3) for b in cand], cols),
        spark.createDataFrame([(r[0], *full(r[1:], 0.3)) for r in refs], "frame_id bigint, " + cols),
        spark.createDataFrame([full(b, 0.4) for b in known], cols), 5, area, cell=64.0)
    got = {r["region_id"]: (r["support"], r["confidence"]) for r in [*fresh.collect(), *old.collect()]}
    assert set(got) == {r["id"] for r in regions}
    for r in regions:
        assert got[r["id"]] == (r["s"], pytest.approx(r["c"]))


def test_matched_boxes_by_lumps(spark):
    """Loads of all boxes that match, as by comparing every pair; crowds and single boxes, touching and empty ones."""
    rng = np.random.default_rng(3)
    def some(n):
        return [(i, float(x), float(y), float(w), float(h)) for i, (x, y, w, h) in enumerate(zip(rng.choice([0, 40, 80, 333.3], n), rng.choice([0, 60], n), rng.exponential(60, n) + 1, rng.exponential(30, n) + 1))]
    left, right = [*some(60), (60, 0.0, 0.0, 0.0, 5.0)], some(200)
    def overlap(a, b):
        w, h = (max(0.0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i])) for i in (1, 2))
        union = a[3] * a[4] + b[3] * b[4] - w * h
        return w * h / union if union > 0 else 0.0
    schema = "double, ".join(["x ", "y ", "width ", "height "]) + "double"
    l, r = spark.createDataFrame(left, "box_id bigint, " + schema), spark.createDataFrame(right, "_load bigint, " + schema)
    for threshold in (0.1, 0.5):
        got = {v["box_id"]: v["_load"] for v in ev.matched(l, r, threshold, 64.0, [], F.min, lambda load, best: load < best).collect()}
        hits = {a[0]: [b[0] for b in right if overlap(a, b) >= threshold] for a in left}
        assert got == {k: min(v) for k, v in hits.items() if v}


def test_registered_queries_and_oracles_fit_together():
    queries, oracles = registry.queries(), registry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    assert all(callable(q) for q in queries.values())


def test_region_numbers(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0, 1.0), (2, 0.9, 5.0, 5.0), (3, 0.5, 1.0, 9.0)], "region_id bigint, confidence double, y double, x double")
    got = {r["region_id"]: r["index"] for r in ev.region_order(df.withColumn("width", F.lit(1.0)).withColumn("height", F.lit(1.0))).collect()}
    assert got == {2: 0, 3: 1, 1: 2}


def test_modules_import_before_a_session_exists():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_fields_are_compared_once_per_class(spark):
    text, numeric = {"camera": "A", "frameType": "Light"}, {"gain": 1.0, "exposure": 30.0}
    rows = [(i, text, numeric | {"sensorTemperature": 300.0 if i == 0 else i / 10}, 8, 8, 1, []) for i in range(20)]
    inputs = spark.createDataFrame(rows, ACQ).withColumnRenamed("id", "frame_id")
    masters = spark.createDataFrame([(i, text | {"frameType": "Master Dark"}, numeric | {"sensorTemperature": i / 10}, 8, 8, 1, []) for i in range(15)], ACQ)
    masters = masters.withColumnRenamed("id", "master_id")
    members = md.group_acquisitions(inputs)[0]
    assert not members.schema["group_id"].nullable
    # One class of good inputs, one of the spoilt record, one of masters.
    assert md._classes(inputs, masters, "dark", "frame_id", "master_id", [], ["gain"])[2].count() == 2
    issues = md.calibration_plan(inputs, members, masters, "dark", 0.05, [], ["gain"])[1]
    # A temperature that is invalid by itself counts its member once.
    assert {r["count"] for r in issues.where("field = 'sensorTemperature' and issue = 'invalid'").collect()} == {1}

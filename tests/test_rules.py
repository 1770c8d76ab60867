"""Cases that were once wrong: nulls in join fields, steps that are not finite, caps, hot keys."""

import math

import pytest
from pyspark.sql import functions as F

from framewise.operators import color, match, metadata, sky, stack, stars
from framewise.sources import tables


def pixels(spark, values):
    """One pixel row per tuple of channel values."""
    rows = [(0, x, 0, c, v, 1.0) for x, channels in enumerate(values) for c, v in enumerate(channels)]
    return spark.createDataFrame(rows, "frame_id bigint, x int, y int, channel int, value double, coverage double")


def test_expressions_are_invalid_at_the_first_bad_step(spark):
    df = pixels(spark, [(4.0, 0.0), (4.0, 2.0)])
    got = {r["x"]: r for r in color.compose_channels(df, {"R": "max(A / B, 1)", "G": "A", "B": "B"}, {"A": 0, "B": 1}).collect()}
    assert got[0]["validity"] == 0 and got[0]["r"] == 0 and (got[1]["validity"], got[1]["r"]) == (1, 2.0)
    got = color.compose_channels(df, {"R": "min(sqrt(0 - A), 3)", "G": "A", "B": "B"}, {"A": 0, "B": 1}).collect()
    assert all(r["validity"] == 0 for r in got)
    got = {r["x"]: r["r"] for r in color.compose_channels(df, {"R": "-min(A, B) + pow(B, 2) * 1e0", "G": "A", "B": "B"}, {"A": 0, "B": 1}).collect()}
    assert got == {0: 0.0, 1: 2.0}
    for bad in ("A ** 2", "A if B else 1", "abs(A, B)", "A.real", "__import__('os')", "[A]", "A <"):
        with pytest.raises(ValueError):
            color.compose_channels(df, {"R": bad, "G": "A", "B": "B"}, {"A": 0, "B": 1})


def test_missing_join_fields_keep_their_pairs(spark):
    sides = {"i": [(1, "R", 1.0), (2, None, 1.0), (3, "R", None), (4, None, None), (5, "B", 1.0)], "m": [(10, "R", 1.0), (11, "R", None), (12, "G", 1.0)]}
    keyed = {s: spark.createDataFrame(rows, "id int, a string, b double").withColumnRenamed("id", f"{s}_id") for s, rows in sides.items()}
    met = [metadata._meet(keyed[s], s, ["a", "b"]) for s in ("i", "m")]
    got = sorted(tuple(r) for r in met[0].join(met[1], "_meet").select("i_id", "m_id").collect())
    want = sorted((i, m) for i, a, b in sides["i"] for m, c, d in sides["m"] if (a is None or c is None or a == c) and (b is None or d is None or b == d))
    assert got == want


def test_all_stars_vote(spark):
    """More stars than the brightest five hundred, of which only the faint ones agree on the shift."""
    bright = [(0, i, float(i * 37 % 1000), float(i * 91 % 1000), 1000.0 + i) for i in range(520)]
    faint = [(0, 1000 + i, float(i * 53 % 1000), float(i * 17 % 1000), 1.0) for i in range(80)]
    schema = "frame_id bigint, star_id bigint, x double, y double, flux double"
    moved = [(0, i, (x * 7 + 13) % 1000, (y * 3 + 29) % 1000, f) for _, i, x, y, f in bright] + [(0, i, x - 3.0, y + 2.0, f) for _, i, x, y, f in faint]
    got = match.match_translation(spark.createDataFrame(bright + faint, schema), spark.createDataFrame(moved, schema), 0.5).collect()
    assert len(got) == 1 and (got[0]["dx"], got[0]["dy"]) == (pytest.approx(3.0), pytest.approx(-2.0)) and got[0]["matches"] >= 80


def test_long_chains_settle(spark):
    """Each point conflicts with the one before it: every other one stays, however long the chain."""
    rows = [(0, i, float(i), 0.0) for i in range(132)]
    df = spark.createDataFrame(rows, "frame_id bigint, star_id bigint, x double, y double")
    kept = match.greedy_separation(df, 1.5, ["frame_id"], "star_id", [F.col("star_id")], F.col("star_id"))
    assert sorted(r["star_id"] for r in kept.collect()) == list(range(0, 132, 2))


def test_sigma_stack_with_half_of_all_rows_in_one_key(spark):
    rows = spark.range(4000).select((F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), F.col("id").alias("frame_id"),
                                    (F.sin("id") * 10 + F.when(F.col("id") % 97 == 0, 500).otherwise(0)).alias("value"), F.lit(1.0).alias("coverage"))
    got = {r["k"]: r["value"] for r in stack.stack_sigma(rows, ["k"], low=2.0, high=2.0).collect()}
    for key, values in rows.toPandas().groupby("k").value:
        v = values.to_numpy()
        kept = v[abs(v - v.mean()) <= 2 * v.std()]
        assert got[key] == pytest.approx(kept.mean())


def bell(f, x, y):
    return 100 + 500 * math.exp(-((x - 20.3) ** 2 / (2 * 1.6**2) + (y - 19.6) ** 2 / (2 * 1.4**2)))


def test_shapes_on_luminance_and_verdict_over_all_channels(spark):
    rows = [(0, x, y, c, bell(0, x, y) * (1 + c), 1.0) for c in range(3) for x in range(41) for y in range(41)]
    schema = "frame_id bigint, x int, y int, channel int, value double, coverage double"
    df = spark.createDataFrame(rows, schema)
    star = spark.createDataFrame([(0, 1, 20.3, 19.6)], "frame_id bigint, star_id bigint, x double, y double")
    fit = stars.fit_star_shapes(star, df).collect()[0]
    assert fit["ok"] and (fit["x"], fit["xx"]) == (pytest.approx(20.3, abs=1e-3), pytest.approx(1.6**2, rel=1e-3))
    good = {r["channel"]: r["status"] for r in stars.aperture_photometry(star, df, 7.0, 9.0, 14.0).collect()}
    assert good == {0: "measured", 1: "measured", 2: "measured"}
    flat = df.withColumn("value", F.when(F.col("channel") == 1, F.least("value", F.lit(400.0))).otherwise(F.col("value")))
    bad = stars.aperture_photometry(star, flat, 7.0, 9.0, 14.0).collect()
    assert {r["status"] for r in bad} == {"clipped-channel"} and all(r["flux"] is None for r in bad)


def test_cones_are_widened_by_large_objects_only_for_themselves(spark):
    catalog = spark.createDataFrame([("near", 10.0, 0.0, 1.0), ("far", 40.0, 0.0, 1.0), ("huge", 40.0, 5.0, 7200.0)], "id string, ra double, dec double, major_arcmin double")
    wcs = spark.createDataFrame([(1, 10.0, 0.0, 50.0, 50.0, 100, 100, [-0.01, 0.0, 0.0, 0.01], [])],
                                "panel_id int, pra double, pdec double, px double, py double, width int, height int, cd array<double>, sip array<struct<i: int, j: int, a: double, b: double>>")
    got = {r["id"] for r in sky.cone_search(catalog, wcs).collect()}
    assert "near" in got and "far" not in got


def test_catalog_ids_beyond_four_digits(spark):
    rows = [(f"NGC{i:010d}", "G", "01:02:03", "+04:05:06") for i in (12345, 12346, 1234)]
    names = ["Name", "Type", "RA", "Dec", "MajAx", "MinAx", "PosAng", "V-Mag", "B-Mag", "M", "NGC", "IC", "Identifiers", "Common names"]
    raw = spark.createDataFrame([(*r, *[None] * 10) for r in rows], ", ".join(f"`{n}` string" for n in names))
    assert tables.parse_object_catalog(raw)[0].select("id").distinct().count() == 3

"""Small cases against brute force or known truth, ties, missing values and refused arguments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.functions import scalars as h
from framewise.operators import audit, background as bg, calibrate as cal, color, events as ev, match, metadata as md, mosaic as mo
from framewise.operators import quality as q, sky, spectral as sp, stars as st, stats
from framewise.session import HOT_ROWS_CONF

SAMPLES = "frame_id bigint, x int, y int, channel int, value double, coverage double"


def frame(spark, value, width=16, height=16, frames=1, coverage=lambda f, x, y: 1.0):
    number = lambda v: None if v is None else float(v)
    rows = [(f, x, y, 0, number(value(f, x, y)), coverage(f, x, y)) for f in range(frames) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, SAMPLES)


# --- calibration -------------------------------------------------------------------------------

def test_calibration_recovers_the_scene(spark):
    flat = lambda x, y: 1 + 0.1 * ((x + y) % 3)
    mean = np.mean([flat(x, y) for x in range(4) for y in range(4)])
    light = frame(spark, lambda f, x, y: 50.0 * flat(x, y) / mean + 7 + 3, 4, 4)
    plane = lambda v: frame(spark, v, 4, 4).drop("frame_id")
    got = cal.calibrate(light, dark=plane(lambda f, x, y: 3.0), bias=plane(lambda f, x, y: 7.0), flat=plane(lambda f, x, y: flat(x, y) + 7),
                        dark_bias_state="removed", flat_bias_state="included").collect()
    assert all(r["value"] == pytest.approx(50.0) and r["coverage"] == 1 for r in got)


def test_ambiguous_bias_is_refused(spark):
    light = frame(spark, lambda f, x, y: 1.0, 2, 2)
    plane = light.drop("frame_id")
    for args in ({"dark": plane, "bias": plane}, {"flat": plane, "bias": plane}, {"flat": plane, "flat_bias_state": "included"}, {"dark_bias_state": "maybe"}):
        with pytest.raises(ValueError):
            cal.calibrate(light, **args)


def test_zero_flat_and_missing_master_pixels_are_invalid(spark):
    light = frame(spark, lambda f, x, y: 5.0, 3, 1)
    flat = frame(spark, lambda f, x, y: float(x), 2, 1).drop("frame_id")
    got = {r["x"]: r for r in cal.calibrate(light, flat=flat, flat_bias_state="removed").collect()}
    assert got[0]["value"] is None and got[2]["value"] is None and got[2]["coverage"] == 0 and got[1]["value"] == 5.0


def test_master_needs_enough_samples(spark):
    df = frame(spark, lambda f, x, y: None if f < 2 and x == 0 else float(f), 2, 1, 4)
    got = {r["x"]: r for r in cal.build_master(df, "bias", "median", 3).collect()}
    assert got[0]["value"] is None and got[0]["accepted"] == 2 and got[0]["missing"] == 2 and got[1]["value"] == 1.5


# --- quality -----------------------------------------------------------------------------------

def test_leave_one_out_residuals_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(f, c, float(rng.integers(0, 6)), 1.0) for c in range(12) for f in range(5 + c % 4)]
    grid = spark.createDataFrame(rows, "frame_id bigint, cell int, value double, coverage double")
    stats_df = spark.createDataFrame([(f, 0.5 * f, 1.0) for f in range(9)], "frame_id bigint, sky double, noise double")
    got = {(r["frame_id"], r["cell"]): r["residual"] for r in q.point_residuals(grid, stats_df).collect()}
    for f, c, v, _ in rows:
        peers = [w - 0.5 * g for g, d, w, _ in rows if d == c and g != f]
        assert got[f, c] == pytest.approx(v - 0.5 * f - np.median(peers)), (f, c)


def test_residuals_are_the_same_with_heavy_cells(spark):
    rng = np.random.default_rng(3)
    rows = [(f, 0 if f % 3 else 1, float(rng.normal()), 1.0) for f in range(300)]
    grid = spark.createDataFrame(rows, "frame_id bigint, cell int, value double, coverage double")
    stats_df = spark.createDataFrame([(f, 0.0, 1.0) for f in range(300)], "frame_id bigint, sky double, noise double")
    plain = {r["frame_id"]: r["residual"] for r in q.point_residuals(grid, stats_df).collect()}
    spark.conf.set(HOT_ROWS_CONF, 60)
    try:
        split = {r["frame_id"]: r["residual"] for r in q.point_residuals(grid, stats_df).collect()}
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert plain == pytest.approx(split)


def test_planar_sky_has_no_noise(spark):
    df = frame(spark, lambda f, x, y: 100 + 2.0 * x - y, 20, 20)
    r = q.sequence_sample(df, 20, 20).first()
    assert r["noise"] == pytest.approx(0) and r["valid_fraction"] == 1 and r["error"] is None
    assert q.sequence_sample(frame(spark, lambda f, x, y: 1.0, 3, 3), 3, 3).first()["error"] == "InsufficientValidSamples"


def test_line_is_found_and_scatter_is_not(spark):
    rows = [(0, i, 5 + i // 2) for i in range(20)] + [(1, (i * 37) % 31, (i * 53) % 29) for i in range(12)] + [(2, i, i) for i in range(5)]
    got = q.detect_residual_lines(spark.createDataFrame(rows, "frame_id bigint, x int, y int"), 32, 32).collect()
    assert [r["frame_id"] for r in got] == [0] and got[0]["samples"] >= 12


def test_overrides_and_views(spark):
    a = spark.createDataFrame([(0, True, [], []), (1, False, ["high-noise"], []), (2, True, [], ["w"])],
                              "frame_id bigint, keep boolean, reasons array<string>, warnings array<string>")
    o = spark.createDataFrame([(1, "keep"), (2, "reject")], "frame_id bigint, override string")
    t = q.apply_overrides(a, o)
    assert [r["frame_id"] for r in q.select_frames(t, "kept").collect()] == [0, 1]
    assert [r["frame_id"] for r in q.select_frames(t, "manual").collect()] == [1, 2]
    assert q.select_frames(t, "excluded").first()["reasons"] == ["user-excluded"]
    assert [r["frame_id"] for r in q.select_frames(t, "attention", "attention").collect()] == [1, 2]
    with pytest.raises(ValueError):
        q.select_frames(t, "some")


# --- matching ----------------------------------------------------------------------------------

def star_field(spark, n, seed, dx=0.0, dy=0.0, skip=0):
    rng = np.random.default_rng(seed)
    pts = rng.uniform(0, 500, (n, 2))
    return spark.createDataFrame([(0, i, float(p[0] + dx), float(p[1] + dy), float(1000 - i)) for i, p in enumerate(pts) if not skip or i % skip],
                                 "frame_id bigint, star_id bigint, x double, y double, flux double")


def test_translation_descriptors_and_nearest(spark):
    ref, moving = star_field(spark, 60, 1), star_field(spark, 60, 1, 12.3, -4.5, 7)
    t = match.match_translation(ref, moving, 1.0).first()
    assert (t["dx"], t["dy"]) == (pytest.approx(-12.3), pytest.approx(4.5)) and t["matches"] == 51 and t["inlier_ratio"] == 1
    pairs = match.match_descriptors(ref, star_field(spark, 60, 1, 12.3, -4.5)).collect()
    assert len(pairs) == 60 and all(p["ref_id"] == p["moving_id"] for p in pairs)
    back = star_field(spark, 60, 1, 0.4, 0.1, 7)
    near = match.match_nearest(ref, back, 1.0).collect()
    assert len(near) == 51 and all(p["ref_id"] == p["moving_id"] for p in near)


def test_translation_counts_pairs_without_shuffling_them(spark):
    rng = np.random.default_rng(8)
    pts = rng.uniform(0, 10, (1000, 2))
    ref = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(pts)] + [(1, 5, 1.0, 1.0), (None, 6, 1.0, 1.0), (0, 5000, None, 2.0)]
    mov = [(0, i, float(x) - 3.2, float(y) + 1.7) for i, (x, y) in enumerate(pts) if i % 9] + [(None, 7, 1.0, 1.0), (1, 8, 3.0, None), (0, 5001, 1.0, None)]
    frame = lambda rows: spark.createDataFrame(rows, "frame_id bigint, star_id bigint, x double, y double")
    d = np.array([(a[2] - b[2], a[3] - b[3], b[1]) for a in ref[:1000] for b in mov if b[0] == 0 and b[3] is not None])
    near = lambda c: np.sign(c) * np.floor(np.abs(c) + 0.5)
    bins, n = np.unique(np.stack([near(d[:, 0]), near(d[:, 1])], 1), axis=0, return_counts=True)
    peak = bins[np.flatnonzero(n == n.max())[0]]
    chosen = d[(near(d[:, 0]) == peak[0]) & (near(d[:, 1]) == peak[1])]
    mx, my = (np.sort(chosen[:, k])[len(chosen) // 2] for k in (0, 1))
    inside = d[(d[:, 0] - mx) ** 2 + (d[:, 1] - my) ** 2 <= 1]
    want = inside[np.lexsort((inside[:, 2], inside[:, 1], inside[:, 0]))][len(inside) // 2]

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    got = match.match_translation(frame(ref), frame(mov), 1.0).collect()
    assert [r["frame_id"] for r in got] == [0]
    assert (got[0]["dx"], got[0]["dy"], got[0]["matches"]) == (want[0], want[1], len(set(inside[:, 2])))
    # 890,000 pairs; a row per pair would be some 15 MB and more.
    assert shuffled() - before < 3_000_000


def test_neighbor_count_with_a_pile_of_points(spark):
    rng = np.random.default_rng(4)
    pts = [(0, i, 50.0, 50.0) for i in range(200)] + [(0, 200 + i, *map(float, rng.uniform(30, 70, 2))) for i in range(150)]
    df = spark.createDataFrame(pts, "frame_id bigint, star_id bigint, x double, y double")
    got = {r["star_id"]: r["neighbors"] for r in match.neighbor_count(df, df, 5.0).collect()}
    xy = np.array([p[2:] for p in pts])
    for (_, i, x, y) in pts:
        assert got[i] == (np.hypot(*(xy - (x, y)).T) <= 5.0).sum()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_separation_equals_the_sequential_rule(spark, seed):
    rng = np.random.default_rng(seed)
    pts = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 40, (150, 2)))]
    kept = []
    for _, i, x, y in sorted(pts, key=lambda p: (p[3], p[2])):
        if all(math.hypot(x - a, y - b) >= 4 for _, a, b in kept):
            kept.append((i, x, y))
    df = spark.createDataFrame(pts, "frame_id bigint, star_id bigint, x double, y double")
    got = match.greedy_separation(df, 4.0, ["frame_id"], "star_id", [F.col("y"), F.col("x")], F.col("y"))
    assert {r["star_id"] for r in got.collect()} == {k[0] for k in kept}


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_greedy_separation_writes_no_pairs(spark, seed, monkeypatch):
    """Points far closer than the radius, in two coordinate pairs, some without a position; conflicts reach the edges only when few are left."""
    rng = np.random.default_rng(seed)
    seen, old = [], match.near_pairs
    monkeypatch.setattr(match, "near_pairs", lambda left, *a: seen.append(left.count()) or old(left, *a))
    monkeypatch.setattr(match, "FEW_EDGES", 200, raising=False)
    monkeypatch.setattr(match, "EDGES_PER_POINT", 0, raising=False)
    monkeypatch.setattr(match, "LOOK", 2, raising=False)
    pts = [(i % 2, i, float(x), float(y), None if i % 50 == 0 else float(10 - x), float(y + rng.uniform(-3, 3)))
           for i, (x, y) in enumerate(np.round(rng.uniform(0, 12, (500, 2)), 1))]
    kept = []
    near = lambda a, b, c, d: a is not None and c is not None and (a - c) ** 2 + (b - d) ** 2 < 16
    for k, i, x, y, u, v in sorted(pts, key=lambda p: (p[3], p[2], p[1])):
        if not any(k == q[0] and (near(x, y, q[2], q[3]) or near(u, v, q[4], q[5])) for q in kept):
            kept.append((k, i, x, y, u, v))
    df = spark.createDataFrame(pts, "frame_id bigint, star_id bigint, x double, y double, u double, v double")
    got = match.greedy_separation(df, 4.0, ["frame_id"], "star_id", [F.col("y"), F.col("x"), F.col("star_id")], F.col("y"), [("x", "y"), ("u", "v")])
    assert [r["star_id"] for r in got.orderBy("star_id").collect()] == sorted(k[1] for k in kept)
    assert max(seen) < 250
    monkeypatch.setattr(match, "WINNERS", 0, raising=False)
    again = match.greedy_separation(df, 4.0, ["frame_id"], "star_id", [F.col("y"), F.col("x"), F.col("star_id")], F.col("y"), [("x", "y"), ("u", "v")])
    assert {r["star_id"] for r in again.collect()} == {k[1] for k in kept}


def test_row_numbers_with_a_heavy_key(spark):
    df = spark.createDataFrame([(0 if i % 4 else i, i, float((i * 7919) % 100)) for i in range(400)], "k int, i int, v double")
    order = [F.col("v"), F.col("i")]
    plain = {r["i"]: r["n"] for r in stats.row_numbers(df, ["k"], order, F.col("v"), "n", hot=[]).collect()}
    spark.conf.set(HOT_ROWS_CONF, 50)
    try:
        split = {r["i"]: r["n"] for r in stats.row_numbers(df, ["k"], order, F.col("v"), "n").collect()}
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
    assert plain == split


# --- sky and spectra ---------------------------------------------------------------------------

def sky_field(spark, n_panels):
    rng = np.random.default_rng(9)
    catalog = spark.createDataFrame([(i, float(rng.uniform(0, 360)), float(rng.uniform(-90, 90)), 5.0, f"o{i}") for i in range(800)],
                                    "id bigint, ra double, dec double, major_arcmin double, label string")
    wcs = spark.createDataFrame([(p, 500.5, 400.5, float(rng.uniform(0, 360)), float(rng.uniform(-80, 80)), [-0.02, 0.0, 0.0, 0.02], [], 1000, 800) for p in range(n_panels)],
                                "panel_id int, px double, py double, pra double, pdec double, cd array<double>, "
                                "sip array<struct<i: int, j: int, a: double, b: double>>, width int, height int")
    return catalog, wcs


def test_copies_of_panels_are_never_broadcast(spark):
    """A panel is copied to all cells its cone reaches, which the size of its table does not tell."""
    plan = sky.cone_search(*sky_field(spark, 3))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_objects_on_any_panel_in_rounds(spark):
    catalog, wcs = sky_field(spark, 60)
    every = {r["id"] for r in sky.cone_search(catalog, wcs).select("id").distinct().collect()}
    got = [r["id"] for r in sky.on_any_panel(catalog, wcs, few=1, share=16).collect()]
    assert len(got) == len(set(got)) and set(got) == every and 0 < len(every) < 800


def test_objects_without_a_ring_meet_panels_by_scalar_products(spark):
    """The join looks at no ring and no place; objects on the very edge, rotated and mirrored panels, rings and missing positions stay right."""
    rng = np.random.default_rng(5)
    panels = [(p, 50.5, 40.5, float(rng.uniform(0, 360)), float(rng.uniform(-85, 85)), cd, [], 100, 80)
              for p, cd in enumerate([[-0.1, 0.0, 0.0, 0.1], [0.07, 0.07, -0.07, 0.07], [0.1, 0.02, 0.0, -0.1], [0.0, 0.1, 0.1, 0.0]] * 4)]
    wcs = spark.createDataFrame(panels, "panel_id int, px double, py double, pra double, pdec double, cd array<double>, "
                                "sip array<struct<i: int, j: int, a: double, b: double>>, width int, height int")
    spots = [(p[0], float(x), float(y)) for p in panels for x, y in [(-0.5, 3.0), (99.5, 20.0), (7.0, -0.5), (50.0, 79.5), *rng.uniform(-30, 130, (40, 2))]]
    at = sky.pixel_to_sky(spark.createDataFrame(spots, "panel_id int, x double, y double"), wcs).collect()
    rows = [(i, r["ra"] if i % 90 else None, r["dec"], 30.0 if i % 2 else 0.0, 30.0 if i % 3 else None, None) for i, r in enumerate(at)]
    catalog = spark.createDataFrame(rows, "id bigint, ra double, dec double, major_arcmin double, minor_arcmin double, position_angle double")
    ringless = catalog.select("id", "ra", "dec", "major_arcmin")
    on = sky.sky_to_pixel(catalog.crossJoin(wcs.select("panel_id")).select("panel_id", "id", "ra", "dec"), wcs, sip=False).where(
        "x >= -0.5 and y >= -0.5 and x <= 99.5 and y <= 79.5").collect()
    want = {(r["panel_id"], r["id"]): (r["x"], r["y"]) for r in on}
    found = sky.cone_search(ringless, wcs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("exists(" in line for line in plan.splitlines() if "SortMergeJoin" in line)
    edge = lambda x, y: min(abs(x + 0.5), abs(y + 0.5), abs(x - 99.5), abs(y - 79.5)) < 1e-6
    got = {(r["panel_id"], r["id"]): (r["x"], r["y"]) for r in found.collect()}
    inner = lambda d: {k for k, v in d.items() if not edge(*v)}
    assert inner(got) == inner(want) and len(want) > 100 and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in inner(want))
    # Objects on an edge fall on the side their own rounding gives, with and without the ringed objects' way.
    ringed = [r for r in sky.cone_search(catalog, wcs).collect()]
    assert {(r["panel_id"], r["id"]) for r in ringed if r["center_visible"]} == set(got)
    assert any(not r["center_visible"] for r in ringed) and all(r["outline_kind"] == "catalog-ellipse" for r in ringed if not r["center_visible"])


def test_rounding_by_scale_equals_the_sql(spark):
    import duckdb

    from framewise.plans.fixtures import scaled, sr

    rng = np.random.default_rng(2)
    values = [0.0, -0.0, 0.00005, -0.00005, 0.12345, -7.00015, 3.5e5, -3.5e5, *rng.uniform(-1e4, 1e4, 500).tolist(), *(rng.integers(-10**7, 10**7, 500) / 20000).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v double")
    got = dict(df.select("i", scaled("v", 4)).collect())
    rows = ", ".join(f"({i}, CAST('{v!r}' AS DOUBLE))" for i, v in enumerate(values))
    want = {r[0]: r[1] for r in duckdb.connect().execute(f"SELECT i, {sr('v', 'r', 4)} FROM (VALUES {rows}) t(i, v)").fetchall()}
    assert got.pop(-1) is None and got == want


def test_cone_search_matches_every_pair_near_poles_and_the_date_line(spark):
    rng = np.random.default_rng(8)
    cat = [(i, float(rng.uniform(0, 360)), float(np.degrees(np.arcsin(rng.uniform(-1, 1))))) for i in range(1500)]
    panels = [(0, 0.5, 10.0), (1, 359.5, -20.0), (2, 100.0, 88.0), (3, 200.0, -87.0), (4, 180.0, 0.0)]
    catalog = spark.createDataFrame([(*c, 0.0) for c in cat], "id bigint, ra double, dec double, major_arcmin double")
    wcs = spark.createDataFrame([(p, 500.5, 400.5, ra, dec, [-0.02, 0.0, 0.0, 0.02], [], 1000, 800) for p, ra, dec in panels],
                                "panel_id int, px double, py double, pra double, pdec double, cd array<double>, "
                                "sip array<struct<i: int, j: int, a: double, b: double>>, width int, height int")
    got = {(r["panel_id"], r["id"]) for r in sky.cone_search(catalog, wcs).collect()}
    want = set()
    for p, pra, pdec in panels:
        for i, ra, dec in cat:
            a, d, d0 = np.radians(ra - pra), np.radians(dec), np.radians(pdec)
            z = np.sin(d0) * np.sin(d) + np.cos(d0) * np.cos(d) * np.cos(a)
            if z <= 1e-8:
                continue
            x = np.degrees(np.cos(d) * np.sin(a) / z) / -0.02 + 499.5
            y = np.degrees((np.cos(d0) * np.sin(d) - np.sin(d0) * np.cos(d) * np.cos(a)) / z) / 0.02 + 399.5
            if -0.5 <= x <= 999.5 and -0.5 <= y <= 799.5:
                want.add((p, i))
    assert got == want and len(want) > 20


def test_flux_of_a_flat_spectrum(spark):
    rows = [(1, float(w), 2.0, 0.1) for w in range(400, 701, 10)]
    spectra = spark.createDataFrame(rows, "source_id bigint, wavelength double, flux double, error double")
    got = {r["band"]: r for r in sp.synthetic_flux(spectra, {"box": [[(450.0, 1.0), (550.0, 1.0)]], "far": [[(650.0, 1.0), (750.0, 1.0)]]}).collect()}
    area = (550**2 - 450**2) / 2
    assert got["box"]["flux"] == pytest.approx(2 * area) and got["box"]["error_bound"] == pytest.approx(0.1 * area)
    assert got["box"]["mean_wavelength"] == pytest.approx(500) and got["box"]["rms_width"] == pytest.approx(100 / math.sqrt(12))
    assert got["far"]["status"] == "not-covered" and got["far"]["flux"] is None
    with pytest.raises(ValueError):
        sp.synthetic_flux(spectra, {"bad": [[(500.0, 2.0), (600.0, 1.0)]]})


def test_scalar_edges(spark):
    df = spark.createDataFrame([("-00:30:00", "2020-01-01T23:59:60", "x")], "c string, t string, k string")
    r = df.select(h.sexagesimal(F.col("c"), False).alias("a"), h.utc_date(F.col("t")).cast("string").alias("b"),
                  h.sexagesimal(F.lit("23:59:60.0"), True).alias("c"), h.utc_date(F.lit("2020-02-30")).alias("d"),
                  h.display_id(F.lit("NGC0000")).alias("e"), h.frame_type(F.lit("Master Dark-Flat Frame")).alias("f")).first()
    assert r["a"] == -0.5 and r["b"] == "2020-01-01" and r["c"] is None and r["d"] is None and r["e"] == "NGC 0" and r["f"] == "dark-flat"


# --- images ------------------------------------------------------------------------------------

def identity(spark, frames=1, **extra):
    t = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 1.0, "dx": 0.0, "dy": 0.0, **extra}
    return spark.createDataFrame([(f, *t.values()) for f in range(frames)], "frame_id bigint, " + ", ".join(f"{k} double" for k in t))


def test_identity_resampling_and_singular_transforms(spark):
    df = frame(spark, lambda f, x, y: x * 10.0 + y, 5, 4)
    got = {(r["x"], r["y"]): r["value"] for r in mo.resample_affine(df, identity(spark), 5, 4, 5, 4).collect()}
    assert got == {(x, y): x * 10.0 + y for x in range(5) for y in range(4)}
    assert mo.inverse_affine(identity(spark, d=0.0)).first()["a"] is None


def test_drizzle_keeps_flux_and_rotated_drops_cover_their_area(spark):
    df = frame(spark, lambda f, x, y: 3.0, 6, 6)
    got = mo.drizzle(df, identity(spark), 6, 6, 2, 1.0).collect()
    assert len(got) == 144 and all(r["value"] == pytest.approx(3.0) and r["weight"] == pytest.approx(1.0) for r in got)
    a = math.radians(30)
    f = spark.createDataFrame([(0, math.cos(a), -math.sin(a), math.sin(a), math.cos(a), 6.0, 2.0, [0.0] * 3, [1.0] * 3, 1.0)],
                              "frame_id bigint, a double, b double, c double, d double, dx double, dy double, background array<double>, gain array<double>, weight double")
    rot = mo.drizzle_mosaic(df, f, 20, 20, pixfrac=0.7).collect()
    assert sum(r["weight"] for r in rot) == pytest.approx(36.0) and all(r["value"] == pytest.approx(3.0) for r in rot)


def test_linear_match_finds_gain_and_offset_despite_outliers(spark):
    rng = np.random.default_rng(6)
    base = rng.uniform(10, 50, (32, 32))
    ref = frame(spark, lambda f, x, y: 1.7 * base[y, x] + 4 + (300 if (x * y) % 41 == 1 else 0), 32, 32)
    df = frame(spark, lambda f, x, y: float(base[y, x]) if f == 0 else 5.0, 32, 32, 2)
    got = {r["frame_id"]: r for r in bg.linear_match(df, ref, 32, 32).collect()}
    assert got[0]["gain"] == pytest.approx(1.7, abs=1e-6) and got[0]["offset"] == pytest.approx(4, abs=1e-4)
    assert got[1]["status"] == "no-intensity-range"


def test_grid_background_fills_holes_and_removes_a_gradient(spark):
    df = frame(spark, lambda f, x, y: 10.0, 16, 16)
    got = bg.background_grid(df, 4, 4, 16, 16, excluded=(F.col("x") < 4) & (F.col("y") < 4)).collect()
    assert len(got) == 256 and all(r["background"] == pytest.approx(10) and r["value"] == pytest.approx(0) for r in got)
    with pytest.raises(ValueError):
        bg.background_grid(df, 40, 4, 16, 16)


def test_tone_curve_passes_its_points_and_expressions_are_checked(spark):
    df = frame(spark, lambda f, x, y: x / 15, 16, 1)
    got = {r["x"]: r["value"] for r in color.tone_curve(df, [(0.0, 0.1), (0.2, 0.5), (1.0, 0.9)]).collect()}
    assert got[0] == pytest.approx(0.1) and got[3] == pytest.approx(0.5) and got[15] == pytest.approx(0.9)
    with pytest.raises(ValueError):
        color.compose_channels(df, {"R": "A; drop", "G": "A", "B": "A"}, {"A": 0})
    with pytest.raises(ValueError):
        color.compose_channels(df, {"R": "system(A)", "G": "A", "B": "A"}, {"A": 0})
    got = {r["x"]: r for r in color.compose_channels(df, {"R": "1/(A-A)", "G": "A", "B": "A"}, {"A": 0}).collect()}
    assert all(r["validity"] == 0 and r["r"] == 0 for r in got.values())


def gaussian(f, x, y):
    return 100 + 500 * math.exp(-((x - 20.3) ** 2 / (2 * 1.6**2) + (y - 19.6) ** 2 / (2 * 1.4**2)))


def test_star_is_detected_fitted_and_measured(spark):
    df = frame(spark, gaussian, 41, 41)
    found = st.detect_stars(df, 41, 41, sigma=5.0).collect()
    assert len(found) == 1 and abs(found[0]["x"] - 20.3) < 0.3
    star = spark.createDataFrame([(0, 1, 20.0, 20.0), (0, 2, 2.0, 2.0)], "frame_id bigint, star_id bigint, x double, y double")
    fits = {r["star_id"]: r for r in st.fit_star_shapes(star, df).collect()}
    assert fits[1]["ok"] and not fits[2]["ok"]
    assert (fits[1]["x"], fits[1]["y"]) == (pytest.approx(20.3, abs=1e-3), pytest.approx(19.6, abs=1e-3))
    assert (fits[1]["xx"], fits[1]["yy"]) == (pytest.approx(1.6**2, rel=1e-3), pytest.approx(1.4**2, rel=1e-3))
    placed = spark.createDataFrame([(0, 1, 20.3, 19.6), (0, 2, 2.0, 2.0)], "frame_id bigint, star_id bigint, x double, y double")
    phot = {r["star_id"]: r for r in st.aperture_photometry(placed, df, 7.0, 9.0, 14.0, width=41, height=41).collect()}
    assert phot[1]["status"] == "measured" and phot[1]["flux"] == pytest.approx(500 * 2 * math.pi * 1.6 * 1.4, rel=0.002)
    assert phot[2]["status"] == "edge"


def test_pixels_made_from_arrays_are_shuffled_to_their_stars(spark):
    grid = spark.range(3).withColumnsRenamed({"id": "frame_id"}).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(48 * 48 - 1)))).select(
        "frame_id", (F.col("p") % 48).alias("x"), F.floor(F.col("p") / 48).cast("int").alias("y"), F.lit(0).alias("channel"),
        F.expr("10 + 50 * exp(-(power(p % 48 - 24.2, 2) + power(p div 48 - 23.9, 2)) / 6) + 0.01 * (p % 7)").alias("value"), F.lit(1.0).alias("coverage"))
    star = spark.range(3).select(F.col("id").alias("frame_id"), F.col("id").alias("star_id"), F.lit(24.2).alias("x"), F.lit(23.9).alias("y"))
    for out in (st.aperture_photometry(star, grid, 6.0, 9.0, 14.0), st.fit_star_shapes(star, grid)):
        assert out.count() == 3
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_equal_neighbours_give_one_star(spark):
    df = frame(spark, lambda f, x, y: 10.0 if (x, y) in ((5, 5), (6, 5)) else 0.0, 12, 12)
    assert [(r["cx"], r["cy"]) for r in st.star_candidates(df, 12, 12, 1.0).collect()] == [(5, 5)]


# --- events, metadata, audits ------------------------------------------------------------------

def test_recurrent_trails_by_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 6)), "s" if i % 2 else "a", *map(float, rng.uniform(0, 300, 4)), float(rng.uniform(1, 5)), 1.0) for i in range(80)]
    rows += [(100 + i, i % 6, "s", 10.0, 10.0, 200.0, 100.0, 3.0, 1.0) for i in range(30)]
    # Points, alone and far along level or slightly tilted trails.
    rows += [(200 + i, i % 6, "s", 900.0 * i, 5.0 * (i % 3), 900.0 * i, 5.0 * (i % 3), 2.0, 1.0) for i in range(8)]
    rows += [(300 + i, i % 5, "s", 20.0 * i, 4.0, 20.0 * i + 60, 4.0 - 3 * (i % 4), 2.0, 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "trail_id bigint, frame_id bigint, kind string, x1 double, y1 double, x2 double, y2 double, width double, weight double")
    got = {r["trail_id"]: r["recurring_frames"] for r in ev.recurrent_trails(df, 3).collect()}
    for a in rows:
        frames = set()
        for b in rows:
            if a[1] == b[1] or a[2] != b[2]:
                continue
            ta, tb = math.atan2(a[6] - a[4], a[5] - a[3]), math.atan2(b[6] - b[4], b[5] - b[3])
            d = abs(ta - tb) % math.pi
            if min(d, math.pi - d) > 0.18:
                continue
            ux, uy = math.cos(ta), math.sin(ta)
            mx, my = (a[3] + a[5] - b[3] - b[5]) / 2, (a[4] + a[6] - b[4] - b[6]) / 2
            if abs(-mx * uy + my * ux) > max(8, 1.6 * (a[7] + b[7])):
                continue
            p, s = sorted((a[3] * ux + a[4] * uy, a[5] * ux + a[6] * uy)), sorted((b[3] * ux + b[4] * uy, b[5] * ux + b[6] * uy))
            if max(0, min(p[1], s[1]) - max(p[0], s[0])) >= 0.4 * min(math.hypot(a[5] - a[3], a[6] - a[4]), math.hypot(b[5] - b[3], b[6] - b[4])):
                frames.add(b[1])
        assert got[a[0]] == len(frames), a


def acquisition(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text map<string,string>, numeric map<string,double>, width int, height int, channels int, "
                                       "issues array<struct<field: string, code: string, message: string>>")


def test_calibration_match_statuses(spark):
    text = {"camera": "c", "cameraSerial": "s", "sampling": "mono", "domain": "linear", "units": "ADU", "readoutMode": "1"}
    num = {"gain": 1.0, "exposure": 30.0, "sensorTemperature": -10.0, "binX": 1.0, "binY": 1.0, "originX": 0.0, "originY": 0.0, "offset": 5.0}
    without = lambda d, k: {a: b for a, b in d.items() if a != k}
    inputs = acquisition(spark, [
        (0, text, num, 8, 8, 1, []), (1, without(text, "camera"), num, 8, 8, 1, []), (2, text, {**num, "sensorTemperature": -8.0}, 8, 8, 1, []),
        (3, text, without(num, "sensorTemperature"), 8, 8, 1, []), (4, text, {**num, "binX": 1.5}, 8, 8, 1, []), (5, text, num, 8, 9, 1, []),
        (6, {**text, "frameType": "Dark"}, num, 8, 8, 1, []), (7, text, num, 8, 8, 1, [("a", "b", "c")])]).withColumnRenamed("id", "frame_id")
    master = acquisition(spark, [(9, {**text, "frameType": "Master Dark"}, num, 8, 8, 1, [])]).withColumnRenamed("id", "master_id")
    want = {0: "compatible", 1: "review", 2: "incompatible", 3: "review", 4: "incompatible", 5: "incompatible", 6: "incompatible", 7: "incompatible"}
    full = {r["frame_id"]: r["status"] for r in md.match_calibration(inputs, master, "dark", 1.0, on_numeric=["gain"], candidates_only=False).collect()}
    assert full == want
    kept = {r["frame_id"]: r["status"] for r in md.match_calibration(inputs, master, "dark", 1.0, on_numeric=["gain"]).collect()}
    assert kept == {k: v for k, v in want.items() if v != "incompatible"}
    for bad in ({"tolerance": 11.0}, {"on_numeric": []}, {"role": "light"}):
        with pytest.raises(ValueError):
            md.match_calibration(inputs, master, **{"role": "dark", "on_numeric": ["gain"], **bad})


def test_audits(spark):
    m = spark.createDataFrame([("a", "g", "development", "h1", 1, 0), ("a", "g", "evaluation", "h2", None, None), ("b", "", "test", "h1", 0, 1)],
                              "case_id string, grp string, split string, sha string, minimum int, maximum int")
    rules = {r["rule"] for r in audit.split_leakage(m).collect()}
    assert rules == {"group-crosses-splits", "duplicate-id", "duplicate-content", "split-unknown", "group-missing", "bounds-missing", "bounds-inverted"}
    files = spark.createDataFrame([("d/A.FITS", 0), ("d/a.jpg", 1), ("d/b.png", 2), ("d/b.png", 3)], "path string, n int")
    assert {(r["path"], r["n"]) for r in audit.drop_display_proxies(files, order="n").collect()} == {("d/A.FITS", 0), ("d/b.png", 2)}
    v, t = audit.label_conformance(spark.createDataFrame([("a", 3)], "case_id string, observed int"),
                                   spark.createDataFrame([("a", 1, 2), ("z", 0, None)], "case_id string, minimum int, maximum int"))
    assert {r["case_id"]: r["reason"] for r in v.collect()} == {"a": "above-maximum", "z": "not-processed"} and t.first()["failed"] == 2


def test_recurrent_trails_settle_in_rounds_with_the_same_counts(spark):
    """A crowd of different shapes on one line that meets all frames early, and others that meet few of them."""
    rng = np.random.default_rng(4)
    rows = [(i, i % 6, "s", 10.0, 10.0, 60.0 + i * 0.25, 10.0 + i * 0.01, 3.0, 1.0) for i in range(300)]
    rows += [(1000 + i, i % 6, "s", *map(float, rng.uniform(0, 2000, 4)), 3.0, 1.0) for i in range(100)]
    rows += [(2000 + i, i % 6, "s", 5.0 * i, 10.0, 5.0 * i, 10.0, 3.0, 1.0) for i in range(12)]
    rows += [(3000 + i, 2, "alone", 0.0, 0.0, 50.0 + i, 0.0, 3.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "trail_id bigint, frame_id bigint, kind string, x1 double, y1 double, x2 double, y2 double, width double, weight double")
    run = lambda turns: {r["trail_id"]: r["recurring_frames"] for r in ev.recurrent_trails(df, 3, turns=turns).collect()}
    # No shape has a turn below 0, so that every pair is left to the last round.
    whole, rounds = run((0, 0)), run((8, 32))
    assert whole == rounds
    assert all(whole[i] == 5 for i in range(300)) and all(whole[3000 + i] == 0 for i in range(5))
    assert any(0 < whole[1000 + i] < 5 for i in range(100))


def test_master_inputs_are_summed_without_sorting_frames(spark):
    """Frames are first summed by hash; only classes of equal texts are sorted for the least and greatest text."""
    text = {"frameType": "Dark Frame", "camera": "c"}
    rows = [(i, text | ({"camera": "d"} if i == 3 else {}), {"gain": 1.0, "exposure": 30.0, "sensorTemperature": -10.0 + i / 100}, 8, 8, 1, []) for i in range(40)]
    rows[5][1].pop("camera")
    df = acquisition(spark, rows).withColumnRenamed("id", "frame_id").withColumn("set_id", F.col("frame_id") % 4)
    issues, canonical = md.validate_master_inputs(df, "dark")
    plan = [line for line in issues._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate" in line]
    assert "HashAggregate" in plan[-1] and "SortAggregate" in plan[0]
    assert {(r["set_id"], r["field"]) for r in issues.collect()} == {(3, "camera"), (1, "camera")}
    assert {r["set_id"]: (r["frames"], r["numeric"]["sensorTemperatureMax"]) for r in canonical.collect()} == {0: (10, -9.64), 2: (10, -9.62)}

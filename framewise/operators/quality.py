"""Sequence quality: frame statistics, temporal residuals, acceptance with reasons, review views."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from ..schema import MIN_COVERAGE, choice, finite, require, require_columns
from ..session import cut_lineage
from .stats import join_keys, per_key, quantiles

#: Fixed scale factor of the median absolute deviation here.
MAD = 1.482602218505602


@dataclass(frozen=True)
class QualityOptions:
    residual_sigma: float = 6.0
    signal_tolerance: float = 0.05
    minimum_coverage: float = 0.70
    maximum_noise_ratio: float = 2.0
    maximum_fwhm_ratio: float = 1.7
    maximum_eccentricity: float = 0.80
    minimum_star_ratio: float = 0.30
    maximum_residual_fraction: float = 0.10
    minimum_peers: int = 4
    minimum_kept_frames: int = 3
    minimum_kept_fraction: float = 0.5

    def __post_init__(self):
        for name, value in self.__dict__.items():
            finite(name, value, 0)


def mad_table(df: DataFrame, keys: list[str], value: str, factor: float, centre: str, name: str) -> DataFrame:
    """Median ``centre`` and scaled MAD ``name`` per key."""
    mid = quantiles(df, keys, value, {centre: ("avg",)})
    if keys:
        dev = join_keys(df.select(*keys, value), mid, keys)
        mad = quantiles(dev.withColumn("_d", F.abs(F.col(value) - F.col(centre))), keys, "_d", {name: ("avg",)})
        return join_keys(mid, mad, keys).withColumn(name, F.col(name) * factor)
    point = mid.first()[centre]
    mad = quantiles(df.withColumn("_d", F.abs(F.col(value) - F.lit(point))), [], "_d", {name: ("avg",)})
    return mad.select(F.lit(point).cast("double").alias(centre), (F.col(name) * factor).alias(name))


def frame_background(df: DataFrame, saturation: float = 0.98) -> DataFrame:
    """Weighted background, noise and saturated share of min-max normalised luminance, per frame."""
    finite("saturation", saturation, 0, 1)
    w = clamp(F.col("coverage"), 0.0, 1.0)
    rows = df.where((F.col("coverage") > MIN_COVERAGE) & F.col("value").isNotNull()).select("frame_id", "value", w.alias("_cov"))
    ends = rows.groupBy("frame_id").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    has = span > F.greatest(F.lit(1.0), F.abs("_lo"), F.abs("_hi")) * 1e-6
    norm = rows.join(ends, "frame_id").select(
        "frame_id", "_cov", F.when(has, clamp(F.try_divide(F.col("value") - F.col("_lo"), span), 0.0, 1.0)).otherwise(0.5).alias("_v"))
    mid = quantiles(norm, ["frame_id"], "_v", {"background": ("wmed",)}, "_cov")
    dev = norm.join(mid, "frame_id").withColumn("_d", F.abs(F.col("_v") - F.col("background")))
    noise = quantiles(dev, ["frame_id"], "_d", {"noise": ("wmed",)}, "_cov")
    sat = norm.groupBy("frame_id").agg(
        (F.sum(F.when(F.col("_v") >= saturation, F.col("_cov")).otherwise(0.0)) / F.sum("_cov")).alias("saturated"))
    return mid.join(noise, "frame_id").join(sat, "frame_id").withColumn("noise", F.col("noise") * 1.4826)


def frame_score(background: DataFrame, stars: DataFrame) -> DataFrame:
    """Quality score in 0..1 from star count, width, roundness, noise and saturation."""
    shapes = quantiles(stars, ["frame_id"], "fwhm", {"median_fwhm": ("avg",)}).join(
        quantiles(stars, ["frame_id"], "eccentricity", {"median_eccentricity": ("avg",)}), "frame_id")
    counts = stars.groupBy("frame_id").agg(F.count(F.lit(1)).alias("star_count"))
    t = background.join(counts.join(shapes, "frame_id"), "frame_id", "left")
    n = F.coalesce(F.col("star_count"), F.lit(0))
    unit = lambda c: clamp(c, 0.0, 1.0)
    score = (unit(n / 100) * 0.25
             + F.coalesce(unit(F.lit(4.0) / (F.col("median_fwhm") + 1)), F.lit(0.0)) * 0.25
             + F.coalesce(unit(F.lit(1.0) - F.col("median_eccentricity")), F.lit(0.0)) * 0.2
             + unit(F.lit(1.0) - F.col("noise") * 8) * 0.2 + unit(F.lit(1.0) - F.col("saturated") * 20) * 0.1)
    return t.select("frame_id", n.cast("bigint").alias("star_count"), "median_fwhm", "median_eccentricity", score.alias("score"))


def sample_axis(length: int, side: int) -> list[int]:
    cells = min(side, length)
    return sorted({(2 * i + 1) * length // (2 * cells) for i in range(cells)})


def sequence_sample(df: DataFrame, width: int, height: int, side: int = 192) -> DataFrame:
    """Per frame sky, noise of the 2x2 diagonal detail and valid share, on a grid of sampled pixels.

    Only the sampled pixels and their three neighbours pass the first filter; the neighbours meet at
    their grid pixel in one aggregate instead of three self-joins."""
    require(side >= 1 and width >= 1 and height >= 1, "grid must not be empty")
    xs, ys = sample_axis(width, side), sample_axis(height, side)
    require(len(xs) * len(ys) <= 512 * 512, "sampling grid is limited to 512 x 512")
    cover = clamp(F.nanvl("coverage", F.lit(0.0)), 0.0, 1.0)
    known = F.col("value").isNotNull() & ~F.isnan("value")
    corners = F.explode(F.array(*[F.struct((F.col("x") - dx).alias("gx"), (F.col("y") - dy).alias("gy"), F.lit(dx + 2 * dy).alias("at"))
                                  for dx in (0, 1) for dy in (0, 1)]))
    rows = df.select("frame_id", corners.alias("_c"), F.when(known, F.col("value")).alias("_v"),
                     F.when(known, cover).otherwise(0.0).alias("_cov"))
    rows = rows.where(F.col("_c.gx").isin(xs) & F.col("_c.gy").isin(ys))
    pick = lambda i: F.max(F.when((F.col("_c.at") == i) & (F.col("_cov") >= 0.99), F.col("_v")))
    grid = rows.groupBy("frame_id", F.col("_c.gx").alias("gx"), F.col("_c.gy").alias("gy")).agg(
        *[pick(i).alias(f"v{i}") for i in range(4)], F.max(F.when(F.col("_c.at") == 0, F.col("_cov"))).alias("_cov"))
    detail = (F.col("v0") - F.col("v1") - F.col("v2") + F.col("v3")) * 0.5
    grid = grid.where(F.col("_cov").isNotNull()).withColumn("_detail", detail)
    stats = grid.groupBy("frame_id").agg((F.sum("_cov") / (len(xs) * len(ys))).alias("valid_fraction"),
                                         F.count("v0").alias("_sky_n"), F.count("_detail").alias("_detail_n"))
    sky = quantiles(grid, ["frame_id"], "v0", {"sky": ("avg",)})
    noise = mad_table(grid, ["frame_id"], "_detail", MAD, "_mid", "noise").drop("_mid")
    enough = (F.col("_sky_n") >= 16) & (F.col("_detail_n") >= 8)
    return stats.join(sky, "frame_id", "left").join(noise, "frame_id", "left").select(
        "frame_id", F.when(enough, F.col("sky")).alias("sky"), F.when(enough, F.col("noise")).alias("noise"), "valid_fraction",
        F.when(~enough, "InsufficientValidSamples").alias("error"))


def point_residuals(grid: DataFrame, stats: DataFrame, median_noise: float | None = None, o: QualityOptions = QualityOptions(),
                    cell: list[str] = ["cell"]) -> DataFrame:
    """Residual and threshold of every compared grid value against the leave-one-out median of its peers.

    Ranks come from the shared skew-safe windows. The median without the value at rank r of n sorted ones
    needs only the values at n/2 - 1, n/2 and n/2 + 1 of all, so peers are never paired."""
    require_columns(grid, ["frame_id", *cell, "value", "coverage"], "grid")
    require_columns(stats, ["frame_id", "sky", "noise"], "frame_stats")
    if median_noise is None:
        median_noise = quantiles(stats, [], "noise", {"m": ("avg",)}).first()["m"]
    rows = grid.where((F.col("coverage") >= 0.99) & F.col("value").isNotNull()).join(
        stats.select("frame_id", "sky", "noise"), "frame_id")
    rows = rows.select("frame_id", *cell, (F.col("value") - F.col("sky")).alias("_x"), "noise")

    def body(part: DataFrame, group) -> DataFrame:
        part = group.attach_agg(part, {"_count": F.count("_x")})
        part = part.where(F.col("_count") > o.minimum_peers)
        part = group.attach(part, "_x", {"_centre": ("avg",)})
        part = group.attach(part, F.abs(F.col("_x") - F.col("_centre")), {"_mad": ("avg",)})
        return order_around_middle(part, group)

    rows = per_key(rows, cell, body)
    n, x = F.col("_count"), F.col("_x")
    rows = rows.withColumn("_peer", peer_median())
    floor = F.hypot(F.col("noise"), F.lit(float(median_noise)) / F.sqrt(n - 1))
    threshold = (F.greatest(F.col("_mad") * MAD, floor, F.lit(1e-6)) * o.residual_sigma
                 + F.abs("_peer") * o.signal_tolerance)
    return rows.select("frame_id", *cell, (x - F.col("_peer")).alias("residual"), threshold.alias("threshold"))


def peer_median() -> Column:
    """Median of a key's other values, from what :func:`order_around_middle` adds, ``_count`` and ``_x``."""
    low, mid, high, x = F.col("_m0"), F.col("_m1"), F.col("_m2"), F.col("_x")
    # Removing x leaves n-1 values. n odd (even peers): middle pair; n even (odd peers): one value.
    even_peers = F.when(x < mid, (mid + high) / 2).when(x > mid, (low + mid) / 2).otherwise((low + high) / 2)
    odd_peers = F.when(x <= low, mid).otherwise(low)
    return F.when(F.col("_count") % 2 == 1, even_peers).otherwise(odd_peers)


def order_around_middle(part: DataFrame, group) -> DataFrame:
    """Order statistics ``_m0 _m1 _m2`` around the middle: for odd n the elements (n-3)/2, (n-1)/2, (n+1)/2;
    for even n the pair n/2 - 1, n/2 (as ``_m0``, ``_m1``)."""
    # ("rank", q) picks floor(q*(n-1)); shifted ranks are expressed through min/max on either side.
    part = group.attach(part, "_x", {"_m1": ("rank", 0.5)})
    at = F.col("_m1")
    part = group.attach_agg(part, {
        "_below": F.max(F.when(F.col("_x") < at, F.col("_x"))), "_above": F.min(F.when(F.col("_x") > at, F.col("_x"))),
        "_less": F.count(F.when(F.col("_x") < at, 1)), "_same": F.count(F.when(F.col("_x") == at, 1))})
    rank = F.floor((F.col("_count") - 1) / 2)
    before = F.when(F.col("_less") <= rank - 1, at).otherwise(F.col("_below"))
    after = F.when(F.col("_less") + F.col("_same") > rank + 1, at).otherwise(F.col("_above"))
    odd = F.col("_count") % 2 == 1
    return part.withColumns({"_lo3": F.when(odd, before).otherwise(at), "_mid3": F.when(odd, at).otherwise(after),
                             "_hi3": F.when(odd, after)}).drop("_m1", "_below", "_above", "_less", "_same").withColumnsRenamed(
        {"_lo3": "_m0", "_mid3": "_m1", "_hi3": "_m2"})


def temporal_residuals(grid: DataFrame, stats: DataFrame, o: QualityOptions = QualityOptions(),
                       cell: list[str] = ["cell"]) -> DataFrame:
    """D19 per frame: compared samples, positive and negative shares, RMS; ``available`` from 16 samples on."""
    # Frame statistics are one row per frame and used twice; written once so they are measured once.
    points = point_residuals(grid, cut_lineage(stats.select("frame_id", "sky", "noise")), None, o, cell)
    n = F.count(F.lit(1))
    pos = F.count(F.when(F.col("residual") > F.col("threshold"), 1))
    neg = F.count(F.when(F.col("residual") < -F.col("threshold"), 1))
    t = points.groupBy("frame_id").agg(n.alias("compared"), pos.alias("positive"), neg.alias("negative"),
                                       F.sum(F.col("residual") * F.col("residual")).alias("_sq"))
    ok = F.col("compared") >= 16
    return t.select("frame_id", "compared", ok.alias("available"), "positive", "negative",
                    F.when(ok, F.col("positive") / F.col("compared")).alias("positive_fraction"),
                    F.when(ok, F.col("negative") / F.col("compared")).alias("negative_fraction"),
                    F.when(ok, F.sqrt(F.col("_sq") / F.col("compared"))).alias("rms"))


def assess_frames(stats: DataFrame, residuals: DataFrame, o: QualityOptions = QualityOptions(),
                  stars_measured: bool = True) -> DataFrame:
    """Ratios, reasons, warnings and the recommendation per frame. Sequence medians are single rows."""
    require_columns(stats, ["frame_id", "noise", "valid_fraction", "star_count", "fwhm", "eccentricity"], "stats")
    # Both tables hold one row per frame; written once, then every sequence median comes from one pass.
    stats, residuals = cut_lineage(stats), cut_lineage(residuals)
    with_stars = F.col("star_count") > 0
    shaped = with_stars & (F.col("fwhm") > 0)
    entry = lambda name, cond, c: F.when(cond, F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("v")))
    metrics = stats.select(F.explode(F.array_compact(F.array(
        entry("noise", F.lit(True), "noise"), entry("fwhm", shaped, "fwhm"),
        entry("eccentricity", shaped, "eccentricity"), entry("stars", with_stars, "star_count")))).alias("e")).select("e.*")
    share = (F.col("positive_fraction") + F.col("negative_fraction")).alias("v")
    metrics = metrics.unionByName(residuals.where("available").select(F.lit("share").alias("metric"), share))
    table = {r["metric"]: r for r in mad_table(metrics, ["metric"], "v", MAD, "m", "d").collect()}
    value = lambda name: table[name]["m"] if name in table else 0.0
    noise, fwhm, ecc, count = value("noise"), value("fwhm"), value("eccentricity"), value("stars")
    spread = table.get("share")
    limit = max(o.maximum_residual_fraction, (spread["m"] + 4 * spread["d"]) if spread else 0.0)

    t = stats.join(residuals, "frame_id", "left")
    available = F.coalesce(F.col("available"), F.lit(False))
    total = F.col("positive_fraction") + F.col("negative_fraction")
    noise_ratio = F.col("noise") / max(noise, 1e-6)
    fwhm_ratio = F.col("fwhm") / fwhm if fwhm > 0 else F.lit(0.0)
    long = F.col("eccentricity") > o.maximum_eccentricity
    relative = F.col("eccentricity") > ecc + 0.15
    few = F.lit(count >= 20) & (F.col("star_count") < count * o.minimum_star_ratio) & F.lit(stars_measured)
    broad = available & (total > limit)
    flag = lambda cond, name: F.when(cond, F.lit(name))
    reasons = F.array_compact(F.array(
        flag(F.col("valid_fraction") < o.minimum_coverage, "low-coverage"),
        flag(noise_ratio > o.maximum_noise_ratio, "high-noise"),
        flag(fwhm_ratio > o.maximum_fwhm_ratio, "broad-stars"),
        flag(long & relative, "elongated-stars"), flag(few, "few-stars"), flag(broad, "broad-temporal-residuals")))
    warnings = F.array_compact(F.array(
        flag(long & ~relative, "elongated-stars-absolute"),
        flag(~available, "insufficient-temporal-peers"),
        flag(available & ~(total > limit) & (F.col("positive") + F.col("negative") > 0), "localized-transients-use-pixel-rejection"),
        flag((F.col("star_count") > 0) & (F.col("fwhm") <= 0), "stellar-shapes-unavailable")))
    return t.select("frame_id", noise_ratio.alias("noise_ratio"), fwhm_ratio.alias("fwhm_ratio"),
                    available.alias("available"), total.alias("residual_fraction"),
                    reasons.alias("reasons"), warnings.alias("warnings")).withColumn("keep", F.size("reasons") == 0)


def check_selection(selected: DataFrame, o: QualityOptions = QualityOptions()) -> DataFrame:
    """One row: kept, total and whether the selection keeps enough frames."""
    t = selected.agg(F.count(F.when(F.col("keep"), 1)).alias("kept"), F.count(F.lit(1)).alias("total"))
    enough = (F.col("kept") >= o.minimum_kept_frames) & (F.col("kept") >= F.col("total") * o.minimum_kept_fraction)
    return t.withColumn("enough", enough)


def select_reference(stats: DataFrame) -> DataFrame:
    """The best reference frame; the earliest wins a tie."""
    score = F.when(F.col("fwhm") > 0, F.col("valid_fraction") * F.sqrt(F.col("star_count") + 1) * (F.lit(1.0) - F.col("eccentricity") * 0.5)
                   / F.greatest(F.lit(1.0), F.col("fwhm") * F.col("fwhm")) + 1).otherwise(F.col("valid_fraction"))
    best = F.max_by(F.struct("frame_id", score.alias("score")), F.struct(score, (-F.col("frame_id")).alias("o")))
    return stats.agg(best.alias("b")).select("b.frame_id", "b.score")


def detect_residual_lines(points: DataFrame, columns: int, rows: int, groups: list[str] = ["frame_id"]) -> DataFrame:
    """The strongest line of outlier grid points per group, by votes over 180 angles.

    Points (``x``, ``y`` columns, at most 10 % of the grid per group) are counted first; votes are
    aggregated map-side, so only (group, angle, distance) totals are shuffled."""
    require(columns >= 1 and rows >= 1, "grid must not be empty")
    counts = points.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.where((F.col("_n") >= 8) & (F.col("_n") <= columns * rows // 10))
    pts = join_keys(points.select(*groups, "x", "y"), counts, groups)
    angle = F.col("angle") * (math.pi / 180)
    rho = F.floor(F.abs(F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)) + 0.5) * F.signum(
        F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle))
    votes = pts.withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(179))))
    votes = votes.withColumn("rho", rho.cast("int")).groupBy(*groups, "angle", "rho").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(*groups).agg(F.max_by(F.struct("angle", "rho", "votes"), F.struct(
        "votes", (-F.col("angle")).alias("a"), (-F.col("rho")).alias("r"))).alias("_b")).where("_b.votes >= 8")
    theta = F.col("_b.angle") * (math.pi / 180)
    off = F.abs(F.col("x") * F.cos(theta) + F.col("y") * F.sin(theta) - F.col("_b.rho"))
    along = -F.col("x") * F.sin(theta) + F.col("y") * F.cos(theta)
    hit = join_keys(pts, best, groups).where(off <= 0.6).withColumn("_t", along)
    ends = hit.groupBy(*groups).agg(
        F.first("_b.angle").alias("angle"), F.first("_b.rho").alias("rho"), F.count(F.lit(1)).alias("samples"),
        F.min(F.struct("_t", "y", "x")).alias("_f"), F.max(F.struct("_t", "y", "x")).alias("_l"))
    span = F.col("_l._t") - F.col("_f._t")
    ok = (F.col("samples") >= 8) & (span >= 12) & (F.col("samples") / (span + 1) >= 0.55)
    return ends.where(ok).select(*groups, "angle", "rho", "samples",
                                 (F.col("_f.x") + 0.5).alias("x1"), (F.col("_f.y") + 0.5).alias("y1"),
                                 (F.col("_l.x") + 0.5).alias("x2"), (F.col("_l.y") + 0.5).alias("y2"))


def apply_overrides(assessments: DataFrame, overrides: DataFrame) -> DataFrame:
    """C17: keep / reject / automatic per frame; a rejection adds its reason."""
    require_columns(overrides, ["frame_id", "override"], "overrides")
    t = assessments.join(overrides.select("frame_id", "override"), "frame_id", "left")
    rejected = F.coalesce(F.col("override") == "reject", F.lit(False))
    kept = F.coalesce(F.col("override") == "keep", F.lit(False))
    return t.withColumns({
        "selected": F.when(kept, True).when(rejected, False).otherwise(F.col("keep")),
        "reasons": F.when(rejected, F.array_union("reasons", F.array(F.lit("user-excluded")))).otherwise(F.col("reasons"))})


VIEWS = {
    "all": lambda: F.lit(True),
    "attention": lambda: (F.size("reasons") > 0) | (F.size("warnings") > 0),
    "excluded": lambda: ~F.col("selected"),
    "kept": lambda: F.col("selected"),
    "manual": lambda: F.col("override").isin("keep", "reject"),
}


def select_frames(assessments: DataFrame, view: str = "all", sort: str = "capture") -> DataFrame:
    """B19"""
    choice("view", view, VIEWS)
    return review_order(assessments.where(VIEWS[view]()), sort)


def review_order(df: DataFrame, by: str = "capture") -> DataFrame:
    """K2: attention first / capture order / widest stars / noisiest / lowest coverage; ties by frame."""
    choice("by", by, ("attention", "capture", "fwhm", "noise", "coverage"))
    first = {
        "attention": lambda: [F.when(F.size("reasons") > 0, 0).when(F.size("warnings") > 0, 1).otherwise(2)],
        "capture": lambda: [],
        "fwhm": lambda: [F.col("fwhm_ratio").desc_nulls_last()],
        "noise": lambda: [F.col("noise_ratio").desc_nulls_last()],
        "coverage": lambda: [F.col("valid_fraction").asc_nulls_last()],
    }[by]()
    return df.orderBy(*first, F.col("frame_id"))

"""Star measurement: detection, photometry, shapes, masks and their summaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, moments_to_shape, region16
from ..schema import MIN_COVERAGE, choice, finite, require, require_columns
from .match import brightest, greedy_separation
from .stats import join_keys, quantiles

#: Fixed scale factor of the robust detection statistics.
MAD = 1.482602218505602
#: Fixed FWHM factor of a Gaussian.
FWHM = 2.3548200450309493
NINE = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def frame_level(df: DataFrame, robust: bool = False) -> DataFrame:
    """Mean and spread per frame: coverage-weighted moments, or median and scaled MAD of fully covered pixels."""
    if robust:
        full = df.where(F.col("coverage") >= 0.99)
        mid = quantiles(full, ["frame_id"], "value", {"mean": ("avg",)})
        dev = full.join(mid, "frame_id").withColumn("_d", F.abs(F.col("value") - F.col("mean")))
        return mid.join(quantiles(dev, ["frame_id"], "_d", {"sigma": ("avg",)}), "frame_id").withColumn("sigma", F.col("sigma") * MAD)
    w = clamp(F.col("coverage"), 0.0, 1.0)
    first = df.groupBy("frame_id").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("mean"))
    dev = df.join(first, "frame_id")
    d = F.col("value") - F.col("mean")
    return dev.groupBy("frame_id", "mean").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(d * d * w) / F.sum(w))).alias("sigma"))


def star_candidates(df: DataFrame, width: int, height: int, sigma: float = 3.0, min_peak: float = 0.0, border: int = 1,
                    robust: bool = False) -> DataFrame:
    """D46 before separation: strict 3x3 maxima above the threshold with centroid, flux, FWHM and eccentricity.

    Pixels above the threshold ask their eight neighbours by being copied to them; each neighbourhood is one
    group of nine rows. Only bright pixels are copied, so the shuffle is a fraction of the image."""
    finite("sigma", sigma, 0)
    require(border >= 1, "border must be at least one pixel")
    rows = df.where((F.col("coverage") > MIN_COVERAGE) & F.col("value").isNotNull() & ~F.isnan("value")).select(
        "frame_id", "x", "y", "value", clamp(F.col("coverage"), 0.0, 1.0).alias("coverage"))
    level = frame_level(rows, robust)
    rows = rows.join(level, "frame_id")
    effective = F.col("mean") + (F.col("value") - F.col("mean")) * F.col("coverage")
    rows = rows.withColumn("_e", effective)
    threshold = F.greatest(F.lit(float(min_peak)), F.col("mean") + F.col("sigma") * sigma)
    inside = F.col("x").between(border, width - border - 1) & F.col("y").between(border, height - border - 1)
    bright = rows.where(inside & (F.col("_e") >= threshold)).select("frame_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("_e").alias("_c"))
    asked = bright.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in NINE])))
    asked = asked.select("frame_id", "cx", "cy", "_c", (F.col("cx") + F.col("_o.dx")).alias("x"), (F.col("cy") + F.col("_o.dy")).alias("y"), "_o.dx", "_o.dy")
    near = asked.join(rows.select("frame_id", "x", "y", "value", "coverage", "mean", "_e"), ["frame_id", "x", "y"])
    centre = (F.col("dx") == 0) & (F.col("dy") == 0)
    earlier = (F.col("dy") < 0) | ((F.col("dy") == 0) & (F.col("dx") < 0))
    beats = ~centre & ((F.col("_e") > F.col("_c")) | ((F.col("_e") == F.col("_c")) & earlier))
    s = F.greatest(F.lit(0.0), F.col("value") - F.col("mean")) * F.col("coverage")
    dx, dy = F.col("dx"), F.col("dy")
    t = near.groupBy("frame_id", "cx", "cy").agg(
        F.max(beats.cast("int")).alias("_beaten"), F.max(F.when(centre, F.col("value"))).alias("peak"), F.sum(s).alias("flux"),
        F.sum(s * dx).alias("_sx"), F.sum(s * dy).alias("_sy"), F.sum(s * dx * dx).alias("_sxx"), F.sum(s * dy * dy).alias("_syy"),
        F.sum(s * dx * dy).alias("_sxy")).where((F.col("_beaten") == 0) & (F.col("flux") > 0))
    mx, my = F.col("_sx") / F.col("flux"), F.col("_sy") / F.col("flux")
    shape = moments_to_shape(F.col("_sxx") / F.col("flux") - mx * mx, F.col("_syy") / F.col("flux") - my * my, F.col("_sxy") / F.col("flux") - mx * my)
    return t.select("frame_id", "cx", "cy", (F.col("cx") + mx).alias("x"), (F.col("cy") + my).alias("y"), "flux", "peak",
                    shape["major"].alias("fwhm"), shape["eccentricity"].alias("eccentricity"))


def detect_stars(df: DataFrame, width: int, height: int, max_stars: int | None = None, separation: float = 3.0, **options) -> DataFrame:
    """Candidates, brightest first, at least ``separation`` pixels apart: all of them with ``detected``, the number in the
    frame, or the brightest ``max_stars`` of each frame."""
    require(max_stars is None or max_stars >= 1, "max_stars must be positive")
    found = star_candidates(df, width, height, **options).withColumn("star_id", F.col("cy").cast("bigint") * width + F.col("cx"))
    kept = greedy_separation(found, separation, ["frame_id"], "star_id", [F.col("flux").desc(), F.col("star_id")], -F.col("flux"))
    kept = join_keys(kept, kept.groupBy("frame_id").agg(F.count(F.lit(1)).alias("detected")), ["frame_id"])
    return (kept if max_stars is None else brightest(kept, ["frame_id"], max_stars).drop("rank")).drop("cx", "cy")


def cutouts(stars: DataFrame, df: DataFrame, radius: int, channel: int | None = None) -> DataFrame:
    """Pixels of the square of ``2*radius+1`` around each star: ``frame_id star_id dx dy value coverage``.

    Stars are copied to the (at most four) cells their square touches and meet pixels by an equi-join on the cell. Both sides
    are shuffled: pixels made from arrays are far more than the plan's estimate, which would have them broadcast."""
    size = 2 * radius + 1
    px, py = F.floor(F.col("x") + 0.5).cast("int"), F.floor(F.col("y") + 0.5).cast("int")
    s = stars.select("frame_id", "star_id", F.col("x").alias("sx"), F.col("y").alias("sy"), px.alias("px"), py.alias("py"))
    span = lambda c: F.sequence(F.floor((F.col(c) - radius) / size), F.floor((F.col(c) + radius) / size))
    s = s.withColumn("_cx", F.explode(span("px"))).withColumn("_cy", F.explode(span("py")))
    rows = df if channel is None else df.where(F.col("channel") == channel)
    extra = ["channel"] if channel is None and "channel" in df.columns else []
    rows = rows.select("frame_id", "x", "y", *extra, "value", "coverage", F.floor(F.col("x") / size).alias("_cx"), F.floor(F.col("y") / size).alias("_cy"))
    both = rows.hint("merge").join(s, ["frame_id", "_cx", "_cy"])
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    return both.where((F.abs(dx) <= radius) & (F.abs(dy) <= radius)).select(
        "frame_id", "star_id", "sx", "sy", "px", "py", *extra, dx.alias("dx"), dy.alias("dy"), "value", "coverage")


#: Fixed values of photometry: bisquare cut-off, deviation factor, share of the aperture that must be covered, sky pixels,
#: pixels at the peak that mean a clipped star, and how near the peak they are.
TUKEY, SCALE, COVERED, SKY_PIXELS, CLIPPED, AT_PEAK = 4.685, 1.4826, 0.98, 30, 5, 1e-6


def star_planes(lead: int, rounds: int):
    """Arrow function of :func:`aperture_photometry` over pixels sorted by the first ``lead`` columns, which name the star."""
    def star(x, y, v, inner, sky):
        known = ~np.isnan(v)
        used = sky & known
        out = dict.fromkeys(("_top", "_p0", "flux", "sky_sigma", "_spread"))
        out |= {"_hole": int((~known).sum()), "_n": int(used.sum()), "_area": float(inner.sum()), "_used": 0, "_same": 0}
        if not known.any():
            return out
        out["_top"] = float(v[known].max())
        terms = np.stack([np.ones_like(x), x, y])
        squares = np.stack([terms[0], x, y, x * x, x * y, y * y])
        z, w = np.where(known, v, 0.0), used.astype(float)
        for step in range(rounds + 1):
            if step:
                e = v[used] - plane @ terms[:, used]
                e = e - np.median(e)
                u = e / (TUKEY * max(SCALE * np.median(np.abs(e)), 1e-12, abs(plane[0]) * 1e-7))
                w[used] = np.where(np.abs(u) < 1, (1 - u * u) * (1 - u * u), 0.0)
            normal = squares @ w
            plane = solved(normal, terms @ (w * z))
            if plane is None:
                return out
        levers = w * (solved(normal, terms @ inner) @ terms)
        rest = v - plane @ terms
        off = rest[used]
        core = known & (np.abs(x) <= 2.5) & (np.abs(y) <= 2.5)
        peak = v[core].max() if core.any() else np.nan
        contrast = peak - plane[0]
        out |= {"_p0": float(plane[0]), "flux": float((inner * rest)[known].sum()), "_used": int((w > 0.01).sum()),
                "sky_sigma": float(SCALE * np.median(np.abs(off - np.median(off)))), "_spread": float((inner * inner + levers * levers).sum()),
                "_same": int((np.abs(v[core] - peak) <= contrast * AT_PEAK).sum()) if contrast > 0 else 0}
        return out

    def solved(m, v):
        a, b, c, d, e, f = m
        inverse = np.array([[d * f - e * e, c * e - b * f, b * e - c * d], [c * e - b * f, a * f - c * c, b * c - a * e], [b * e - c * d, b * c - a * e, a * d - b * b]])
        det = a * inverse[0, 0] + b * inverse[0, 1] + c * inverse[0, 2]
        return inverse @ v / det if abs(det) > 1e-12 * abs(a * d * f) else None

    def measured(batch):
        names = batch.schema.names[:lead]
        x, y, v, inner, sky = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "v", "_in", "_sky"))
        starts = heads(batch)
        ends = [*starts[1:], batch.num_rows]
        rows = [star(x[i:j], y[i:j], v[i:j], inner[i:j], sky[i:j].astype(bool)) for i, j in zip(starts, ends)]
        made = pa.Table.from_pylist(rows, pa.schema([(k, pa.float64()) for k in ("_area", "_top", "_p0", "flux", "sky_sigma", "_spread")]
                                                    + [(k, pa.int64()) for k in ("_hole", "_n", "_used", "_same")])).combine_chunks()
        first = batch.select(names).take(pa.array(starts))
        return pa.RecordBatch.from_arrays([*first.columns, *[c.combine_chunks() for c in made.columns]], names=[*names, *made.column_names])

    def heads(batch) -> list[int]:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in batch.columns[:lead]:
            codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new).tolist()

    def run(batches):
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            last = heads(batch)[-1]
            if last:
                yield measured(batch.slice(0, last))
            rest = batch.slice(last)
        if rest is not None:
            yield measured(rest)

    return run


def aperture_photometry(stars: DataFrame, df: DataFrame, radius: float = 5.0, sky_inner: float = 8.0, sky_outer: float = 12.0,
                        saturation: float = 0.0, min_snr: float = 5.0, width: int | None = None, height: int | None = None, rounds: int = 8) -> DataFrame:
    """Circular aperture whose edge pixels count by the share of 8x8 points inside, over a plane fitted to the annulus
    with bisquare weights. A star is measured in all its channels or in none: the first channel that fails names the status.

    A star's pixels (83 x 83 at most) meet once by a shuffle on the star; the plane's rounds then run star by star in
    batches of pixels, so a task holds one batch and one star."""
    require(3 <= radius <= 20 and sky_inner > radius + 1 and sky_outer >= sky_inner + 2 and sky_outer <= 40, "aperture radii out of range")
    finite("min_snr", min_snr, 1)
    keys = ["frame_id", "star_id", "channel"]
    pix = cutouts(stars, df, int(math.ceil(sky_outer + 1))).select(
        *keys, "sx", "sy", (F.col("px") + F.col("dx") - F.col("sx")).alias("x"), (F.col("py") + F.col("dy") - F.col("sy")).alias("y"),
        F.when(F.col("coverage") >= 0.999999, F.col("value")).cast("double").alias("v"))
    x, y = F.col("x"), F.col("y")
    d = F.hypot(x, y)
    points = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0), lambda n, k: n + F.when(
        F.hypot(x + (k % 8 + 0.5) / 8 - 0.5, y + (F.floor(k / 8) + 0.5) / 8 - 0.5) <= radius, 1).otherwise(0)) / 64.0
    share = F.when(d < radius - 0.71, 1.0).when(d < radius + 0.71, points).otherwise(0.0)
    # Far pixels go before the shares are worked out.
    pix = pix.where(d <= sky_outer).withColumns({"_in": share, "_sky": d.between(sky_inner, sky_outer)})
    pix = pix.where(F.col("_sky") | (F.col("_in") > 0)).repartition(*keys).sortWithinPartitions(*keys, "sx", "sy", "y", "x")
    fields = ", ".join(f"{k} double" for k in ("_area", "_top", "_p0", "flux", "sky_sigma", "_spread"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pix.schema if f.name in (*keys, "sx", "sy"))
    one = pix.mapInArrow(star_planes(len(keys) + 2, rounds), f"{kept}, {fields}, _hole bigint, _n bigint, _used bigint, _same bigint")
    one = one.withColumn("noise", F.col("sky_sigma") * F.sqrt("_spread")).withColumn("snr", F.col("flux") / F.greatest(F.lit(1e-30), F.col("noise")))
    status = (F.when((F.col("_hole") > 0) | (F.col("_area") < COVERED * math.pi * radius * radius), "coverage")
              .when((F.lit(saturation) > 0) & (F.col("_top") >= saturation), "saturation").when(F.col("_n") < SKY_PIXELS, "sky-samples")
              .when(F.col("_p0").isNull(), "sky-fit").when(F.col("_used") < SKY_PIXELS, "sky-samples").when(F.col("_same") >= CLIPPED, "clipped-channel")
              .when((F.col("flux") <= 0) | (F.col("snr") < min_snr), "signal-to-noise"))
    if width is not None:
        margin = sky_outer + 1
        edge = (F.col("sx") < margin) | (F.col("sy") < margin) | (F.col("sx") >= width - margin)
        status = F.when(edge | (F.col("sy") >= height - margin) if height is not None else edge, "edge").otherwise(status)
    star = Window.partitionBy("frame_id", "star_id")
    one = one.withColumn("_fails", status).withColumn("_why", F.min(F.when(F.col("_fails").isNotNull(), F.struct("channel", "_fails"))).over(star)["_fails"])
    good = F.col("_why").isNull()
    return one.select(*keys, F.coalesce("_why", F.lit("measured")).alias("status"), *[F.when(good, F.col(c)).alias(n) for c, n in (
        ("flux", "flux"), ("noise", "noise"), ("snr", "snr"), ("_p0", "sky"), ("sky_sigma", "sky_sigma"), ("_used", "sky_used"))])


#: Fixed values of a usable shape: largest misfit, least and largest axis, least ratio of the axes' squares, largest shift.
MISFIT, AXES, ROUND, SHIFT = 0.06, (0.55, 3.8), 0.10, 2.5
#: Fixed weights of luminance.
LUMA = (0.2126, 0.7152, 0.0722)


def fit_star_shapes(stars: DataFrame, df: DataFrame, channel: int | None = None, rounds: int = 24) -> DataFrame:
    """Centre and covariance of an elliptical Gaussian on a plane, from the 15x15 square around each star; on luminance,
    or on one ``channel``.

    Adaptive moments: a Gaussian weight of the star's present centre and covariance halves the covariance it sees, so twice
    the weighted moments are the next ones. A round is seven sums per star, all stars at a time, over the pixels that one
    shuffle brought together."""
    keys = ["frame_id", "star_id"]
    per = Window.partitionBy(*keys)
    over = lambda c: F.sum(c).over(per)
    pix = cutouts(stars, df, 7, channel)
    value = F.when(F.col("coverage") >= 0.999999, F.col("value"))
    if channel is None and "channel" in df.columns:
        weights = F.when(F.col("channel") == 0, LUMA[0]).when(F.col("channel") == 1, LUMA[1]).otherwise(LUMA[2])
        full = pix.groupBy(*keys, "sx", "sy", "px", "py", "dx", "dy")
        pix = full.agg(F.count(F.lit(1)).alias("_c"), F.count(value).alias("_k"), F.sum(weights * value).alias("_l"), F.max(value).alias("_m"))
        pix = pix.withColumn("v", F.when(F.col("_k") == F.col("_c"), F.when(F.col("_c") == 1, F.col("_m")).otherwise(F.col("_l"))))
    else:
        pix = pix.withColumn("v", value)
    x, y, v = F.col("dx").cast("double"), F.col("dy").cast("double"), F.col("v")
    far = x * x + y * y > 30
    pix = pix.withColumns({"_n": F.count("v").over(per), "_s0": F.percentile(F.when(far, v), F.lit(0.5)).over(per), "_top": F.max(F.when((F.abs(x) <= 2) & (F.abs(y) <= 2), v)).over(per)})
    pix = pix.where("_n = 225").withColumns({"_amp": F.col("_top") - F.col("_s0"), "_cx": F.col("sx") - F.col("px"), "_cy": F.col("sy") - F.col("py"),
                                           "_xx": F.lit(2.0), "_yy": F.lit(2.0), "_xy": F.lit(0.0), "_a": F.lit(0.0), "_b0": F.col("_s0"), "_b1": F.lit(0.0), "_b2": F.lit(0.0)})
    ux, uy = x - F.col("_cx"), y - F.col("_cy")
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    bell = F.exp(-0.5 * (ux * ux * F.col("_yy") - 2 * ux * uy * F.col("_xy") + uy * uy * F.col("_xx")) / det)
    for step in range(rounds):
        g = F.col("_g")
        pix = pix.withColumn("_g", bell).withColumn("_z", v - F.col("_b0") - F.col("_b1") * x - F.col("_b2") * y)
        if step:
            # The plane is what the star's far wings leave over.
            left = F.when(far, F.col("_z") + F.col("_b0") + F.col("_b1") * x + F.col("_b2") * y - F.col("_a") * g)
            pix = pix.withColumns({"_l0": F.avg(left).over(per), "_l1": F.try_divide(over(left * x), over(F.when(far, x * x))), "_l2": F.try_divide(over(left * y), over(F.when(far, y * y)))})
            pix = pix.withColumns({"_b0": F.col("_l0"), "_b1": F.col("_l1"), "_b2": F.col("_l2")}).drop("_l0", "_l1", "_l2")
            pix = pix.withColumn("_z", v - F.col("_b0") - F.col("_b1") * x - F.col("_b2") * y)
        gz = g * F.col("_z")
        pix = pix.withColumns({"_m": over(gz), "_mx": over(gz * ux), "_my": over(gz * uy), "_q": over(g * g)})
        pix = pix.withColumns({"_ox": F.try_divide(F.col("_mx"), F.col("_m")), "_oy": F.try_divide(F.col("_my"), F.col("_m"))})
        tx, ty = ux - F.col("_ox"), uy - F.col("_oy")
        pix = pix.withColumns({"_nxx": F.try_divide(2 * over(gz * tx * tx), F.col("_m")), "_nyy": F.try_divide(2 * over(gz * ty * ty), F.col("_m")), "_nxy": F.try_divide(2 * over(gz * tx * ty), F.col("_m"))})
        bound = lambda c: F.least(F.greatest(c, F.lit(0.25)), F.lit(16.0))
        limit = 0.9 * F.sqrt(bound(F.col("_nxx")) * bound(F.col("_nyy")))
        pix = pix.withColumns({"_a": F.try_divide(F.col("_m"), F.col("_q")), "_cx": F.col("_cx") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * F.col("_ox"))),
                               "_cy": F.col("_cy") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * F.col("_oy"))), "_xx": bound(F.col("_nxx")), "_yy": bound(F.col("_nyy")),
                               "_xy": F.greatest(-limit, F.least(limit, F.col("_nxy")))}).drop("_m", "_mx", "_my", "_q", "_ox", "_oy", "_nxx", "_nyy", "_nxy")
    rest = v - F.col("_b0") - F.col("_b1") * x - F.col("_b2") * y - F.col("_a") * bell
    peak = (F.abs(x) <= 2) & (F.abs(y) <= 2) & (F.abs(v - F.col("_top")) <= F.col("_amp") * AT_PEAK)
    one = pix.groupBy(*keys, "px", "py").agg(*[F.first(c).alias(c) for c in ("_cx", "_cy", "_xx", "_yy", "_xy", "_a", "_amp")],
                                            F.sqrt(F.avg(rest * rest)).alias("_r"), F.count_if(peak).alias("_same"))
    one = one.withColumn("residual", F.try_divide(F.col("_r"), F.col("_a")))
    middle, spread = (F.col("_xx") + F.col("_yy")) / 2, F.hypot((F.col("_xx") - F.col("_yy")) / 2, F.col("_xy"))
    good = ((F.col("_amp") > 0) & (F.col("_a") > 0) & (F.col("_same") < CLIPPED) & (F.col("residual") <= MISFIT) & (middle - spread >= AXES[0] ** 2)
            & (middle + spread <= AXES[1] ** 2) & (F.try_divide(middle - spread, middle + spread) >= ROUND) & (F.hypot("_cx", "_cy") <= SHIFT))
    out = one.select(*keys, F.coalesce(good, F.lit(False)).alias("ok"), *[F.when(good, c).alias(n) for c, n in (
        (F.col("px") + F.col("_cx"), "x"), (F.col("py") + F.col("_cy"), "y"), (F.col("residual"), "residual"), (F.col("_xx"), "xx"), (F.col("_yy"), "yy"), (F.col("_xy"), "xy"))])
    # A star at the edge has no full square and no row above: it keeps its place as a failed fit.
    return stars.select(*keys).join(out.hint("merge"), keys, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def star_mask(stars: DataFrame, width: int, height: int, radius: int = 3, large_radius: int = 6, opacity: float = 1.0,
              halo_opacity: float = 0.5, layered: bool = False, large_peak: float = 0.9) -> DataFrame:
    """Per frame the largest feathered disc value of all stars at each pixel (pixels outside every disc are absent).

    In layered mode stars above the 85 % flux rank and a peak get a larger disc with a dimmer halo."""
    require(1 <= radius <= 64 and 1 <= large_radius <= 64, "radius must be within 1..64")
    finite("opacity", opacity, 0, 1)
    rows = stars.withColumn("_large", F.lit(False))
    if layered:
        require_columns(stars, ["peak"], "stars")
        # Rank ceil(.85 * (n - 1)) is element floor(q * (n-1)) of the reversed order.
        rank = quantiles(stars.withColumn("_f", -F.col("flux")), ["frame_id"], "_f", {"_t": ("rank", 0.15)})
        rows = stars.join(rank, "frame_id").withColumn("_large", (F.col("peak") >= large_peak) & (F.col("flux") >= -F.col("_t")))
    size = F.when(F.col("_large"), max(large_radius, radius)).otherwise(radius)
    half = lambda c: (F.signum(c) * F.floor(F.abs(c) + 0.5)).cast("int")
    rows = rows.select("frame_id", half(F.col("x")).alias("px"), half(F.col("y")).alias("py"), "_large", size.cast("int").alias("_r"))
    # Equal discs are merged first; a disc has a fixed number of pixels.
    rows = rows.distinct().withColumn("dx", F.explode(F.sequence(-F.col("_r"), F.col("_r"))))
    rows = rows.withColumn("dy", F.explode(F.sequence(-F.col("_r"), F.col("_r"))))
    dist = F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    rows = rows.where(dist <= F.col("_r")).withColumns({"x": F.col("px") + F.col("dx"), "y": F.col("py") + F.col("dy"), "_n": dist / (F.col("_r") + 1)})
    rows = rows.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    layer = F.when(F.col("_large") & (F.col("_n") > 0.55), opacity * halo_opacity).otherwise(opacity)
    return rows.groupBy("frame_id", "x", "y").agg(F.max(clamp((F.lit(1.0) - F.col("_n")) * layer, 0.0, 1.0)).alias("value"))


def psf_summary(shapes: DataFrame, width: float, height: float, keys: list[str] = ["frame_id"], minimum: int = 12) -> tuple[DataFrame, DataFrame]:
    """(per key, per key and region). ``shapes``: ``x y xx yy xy``; stars whose log width is an outlier are left out."""
    require_columns(shapes, [*keys, "x", "y", "xx", "yy", "xy"], "shapes")
    det = F.greatest(F.lit(0.0), F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"))
    rows = shapes.select(*keys, "x", "y", "xx", "yy", "xy", (F.lit(FWHM) * F.sqrt(F.sqrt(det))).alias("width")).where("width > 0").withColumn("_l", F.ln("width"))
    mid = quantiles(rows, keys, "_l", {"_m": ("lin", 0.5), "_l10": ("lin", 0.1), "_l90": ("lin", 0.9)})
    rows = join_keys(rows, mid, keys).withColumn("_d", F.abs(F.col("_l") - F.col("_m")))
    mad = quantiles(rows, keys, "_d", {"_s": ("lin", 0.5)})
    rows = join_keys(rows, mad, keys)
    limit = F.greatest(F.lit(math.log(1.25)), F.col("_s") * (4 * 1.4826))
    rows = rows.where(F.col("_d") <= limit).withColumn("region", region16(F.col("x"), F.col("y"), width, height))
    mean = [F.avg(c).alias(c) for c in ("xx", "yy", "xy")]
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("accepted"), *mean, F.countDistinct("region").alias("regions"),
                                    (F.max("x") - F.min("x")).alias("_sx"), (F.max("y") - F.min("y")).alias("_sy"),
                                    F.first("_l10").alias("_l10"), F.first("_l90").alias("_l90"))
    level = quantiles(rows, keys, "width", {"fwhm_p10": ("lin", 0.1), "fwhm_p50": ("lin", 0.5), "fwhm_p90": ("lin", 0.9)})
    rk = [*keys, "region"]
    regions = join_keys(rows.groupBy(*rk).agg(F.count(F.lit(1)).alias("stars"), *mean), quantiles(rows, rk, "width", {"fwhm": ("lin", 0.5)}), rk)
    t = join_keys(total, level, keys)
    dev = join_keys(regions.where("stars >= 3"), t.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("xx", "yy", "xy")]), keys)
    gap = lambda c: F.col(c) - F.col(f"_{c}")
    shift = F.sqrt(gap("xx") * gap("xx") + gap("yy") * gap("yy") + gap("xy") * gap("xy") * 2) / (F.col("_xx") + F.col("_yy"))
    dev = dev.groupBy(*keys).agg(F.max(shift).alias("_shift"), F.count(F.lit(1)).alias("_n"), (F.max("fwhm") / F.min("fwhm")).alias("_ratio"))
    t = join_keys(t, dev, keys, "left")
    half, root = (F.col("xx") + F.col("yy")) / 2, F.hypot((F.col("xx") - F.col("yy")) / 2, F.col("xy"))
    variable = ((F.exp(F.col("_l90") - F.col("_l10")) > 1.3) | (F.col("fwhm_p90") / F.col("fwhm_p10") > 1.3)
                | F.coalesce((F.col("_n") >= 4) & (F.col("_ratio") > 1.2), F.lit(False)) | F.coalesce(F.col("_shift") > 0.15, F.lit(False)))
    enough = (F.col("accepted") >= minimum) & (F.col("regions") >= 4) & (F.col("_sx") >= 0.4 * width) & (F.col("_sy") >= 0.4 * height)
    summary = t.select(*keys, "accepted", "regions", "xx", "yy", "xy", (F.lit(FWHM) * F.sqrt(half + root)).alias("major_fwhm"),
                       (F.lit(FWHM) * F.sqrt(F.greatest(F.lit(0.0), half - root))).alias("minor_fwhm"),
                       F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2).alias("angle"),
                       "fwhm_p10", "fwhm_p50", "fwhm_p90", variable.alias("spatially_variable"), enough.alias("enough"))
    return summary, regions.select(*rk, "stars", "fwhm", "xx", "yy", "xy")


def astrometric_summary(residuals: DataFrame, width: float, height: float, keys: list[str] = ["frame_id"]) -> DataFrame:
    """Residual count, occupied regions, median, P95, maximum and field spans."""
    require_columns(residuals, [*keys, "x", "y", "distance"], "residuals")
    t = residuals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.countDistinct(region16(F.col("x"), F.col("y"), width, height)).alias("regions"),
        F.max("distance").alias("maximum"), ((F.max("x") - F.min("x")) / width).alias("span_x"), ((F.max("y") - F.min("y")) / height).alias("span_y"))
    return join_keys(t, quantiles(residuals, keys, "distance", {"median": ("lin", 0.5), "p95": ("lin", 0.95)}), keys)


def channel_shift(stars: DataFrame, width: float, height: float, keys: list[str] = ["frame_id"], minimum: int = 12) -> DataFrame:
    """Shift of a channel against green. ``stars``: keys, ``channel x y dx dy``. The shift applies only if it is
    clear, coherent over the quadrants and small."""
    require_columns(stars, [*keys, "channel", "x", "y", "dx", "dy"], "stars")
    kc = [*keys, "channel"]

    def middles(rows: DataFrame, by: list[str], names: tuple[str, str]) -> DataFrame:
        both = F.explode(F.array(F.struct(F.lit(0).alias("a"), F.col("dx").alias("v")), F.struct(F.lit(1).alias("a"), F.col("dy").alias("v"))))
        long = rows.select(*by, both.alias("e")).select(*by, "e.a", "e.v")
        m = quantiles(long, [*by, "a"], "v", {"m": ("upper",)})
        return m.groupBy(*by).agg(*[F.max(F.when(F.col("a") == i, F.col("m"))).alias(n) for i, n in enumerate(names)])

    rows = join_keys(stars, middles(stars, kc, ("_mx", "_my")), kc).withColumn("_r", F.hypot(F.col("dx") - F.col("_mx"), F.col("dy") - F.col("_my")))
    rows = join_keys(rows, quantiles(rows, kc, "_r", {"scatter": ("upper",)}), kc)
    kept = rows.where(F.col("_r") <= F.greatest(F.lit(0.08), F.col("scatter") * 3))
    kept = kept.withColumn("quadrant", (F.col("x") >= width / 2).cast("int") + (F.col("y") >= height / 2).cast("int") * 2)
    t = join_keys(rows.groupBy(*kc).agg(F.count(F.lit(1)).alias("measured"), F.max("scatter").alias("scatter")),
                  kept.groupBy(*kc).agg(F.count(F.lit(1)).alias("stars")), kc, "left")
    t = join_keys(t, middles(kept, kc, ("shift_x", "shift_y")), kc, "left")
    q = [*kc, "quadrant"]
    parts = join_keys(kept.groupBy(*q).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3"), middles(kept, q, ("_qx", "_qy")), q)
    parts = join_keys(parts, t.select(*kc, "shift_x", "shift_y"), kc).groupBy(*kc).agg(
        F.count(F.lit(1)).alias("quadrants"), F.max(F.hypot(F.col("_qx") - F.col("shift_x"), F.col("_qy") - F.col("shift_y"))).alias("_off"))
    t = join_keys(t, parts, kc, "left")
    size = F.hypot("shift_x", "shift_y")
    measured = (F.col("measured") >= minimum) & (F.col("stars") >= minimum) & (F.col("stars") >= F.col("measured") * 0.75) & (F.col("scatter") <= 0.10)
    applied = (measured & (F.coalesce("quadrants", F.lit(0)) >= 3) & (F.col("_off") <= 0.10) & size.between(0.05, 1.5)
               & (size >= F.col("scatter") * 5 / F.sqrt(F.col("stars"))))
    return t.select(*kc, "measured", F.coalesce("stars", F.lit(0)).alias("stars"), "scatter", F.when(measured, F.col("shift_x")).alias("shift_x"),
                    F.when(measured, F.col("shift_y")).alias("shift_y"), F.coalesce("quadrants", F.lit(0)).alias("quadrants"),
                    F.coalesce(applied, F.lit(False)).alias("applied"))

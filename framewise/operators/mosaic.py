"""Placing frames on a common grid: resampling, drizzle, mosaics, seams, exposure matching, two-line
extraction, frequency-domain coaddition and fold patterns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bayer_color, bayer_phase, clamp, feather_weight
from ..schema import MIN_COVERAGE, PIXEL, choice, finite, require, require_columns
from ..session import cut_lineage
from .stats import join_keys, per_key, quantiles

FXY = ["frame_id", "x", "y", "channel"]


def apply_affine(df: DataFrame, transforms: DataFrame) -> DataFrame:
    """``x' = a x + b y + dx``, ``y' = c x + d y + dy`` with the transform of the row's frame."""
    require_columns(transforms, ["frame_id", "a", "b", "c", "d", "dx", "dy"], "transforms")
    t = transforms.select("frame_id", *[F.col(c).alias(f"_{c}") for c in ("a", "b", "c", "d", "dx", "dy")])
    x, y = F.col("x"), F.col("y")
    out = df.join(t, "frame_id").withColumns({
        "_x": F.col("_a") * x + F.col("_b") * y + F.col("_dx"), "_y": F.col("_c") * x + F.col("_d") * y + F.col("_dy")})
    return out.withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y", "_a", "_b", "_c", "_d", "_dx", "_dy")


def inverse_affine(transforms: DataFrame) -> DataFrame:
    """Inverse transforms; a frame whose determinant is within 1e-8 of zero has NULL coefficients."""
    a, b, c, d, dx, dy = (F.col(n) for n in ("a", "b", "c", "d", "dx", "dy"))
    det = a * d - b * c
    ok = F.abs(det) > 1e-8
    value = lambda e: F.when(ok, F.try_divide(e, det))
    return transforms.select("frame_id", value(d).alias("a"), value(-b).alias("b"), value(-c).alias("c"), value(a).alias("d"),
                             value(b * dy - d * dx).alias("dx"), value(c * dx - a * dy).alias("dy"))


def footprint(transforms: DataFrame, width: int, height: int, out_width: int, out_height: int) -> DataFrame:
    """Output pixels whose inverse-mapped position falls on (or next to) the source frame of each transform."""
    a, b, c, d, dx, dy = (F.col(n) for n in ("a", "b", "c", "d", "dx", "dy"))
    ends = lambda m, n, o: (
        F.least(F.lit(0.0), m * (width - 1)) + F.least(F.lit(0.0), n * (height - 1)) + o,
        F.greatest(F.lit(0.0), m * (width - 1)) + F.greatest(F.lit(0.0), n * (height - 1)) + o)
    (x0, x1), (y0, y1) = ends(a, b, dx), ends(c, d, dy)
    span = lambda lo, hi, n: F.when(F.floor(hi) + 1 >= 0, F.sequence(
        F.least(F.lit(n), F.greatest(F.lit(0), F.ceil(lo) - 1)).cast("int"),
        F.greatest(F.lit(-1), F.least(F.lit(n - 1), F.floor(hi) + 1)).cast("int")))
    ok = (F.ceil(x0) - 1 < out_width) & (F.floor(x1) + 1 >= 0) & (F.ceil(y0) - 1 < out_height) & (F.floor(y1) + 1 >= 0)
    inv = inverse_affine(transforms).select("frame_id", *[F.col(n).alias(f"i{n}") for n in ("a", "b", "c", "d", "dx", "dy")])
    grid = transforms.where(ok).withColumns({"_ys": span(y0, y1, out_height), "_xs": span(x0, x1, out_width)})
    grid = grid.select("frame_id", F.explode("_ys").alias("oy"), "_xs").select("frame_id", "oy", F.explode("_xs").alias("ox"))
    grid = grid.join(inv.where("ia is not null"), "frame_id")
    return grid.select("frame_id", "ox", "oy",
                       (F.col("ia") * F.col("ox") + F.col("ib") * F.col("oy") + F.col("idx")).alias("sx"),
                       (F.col("ic") * F.col("ox") + F.col("id") * F.col("oy") + F.col("idy")).alias("sy"))


def resample_affine(df: DataFrame, transforms: DataFrame, width: int, height: int, out_width: int, out_height: int,
                    keep_source: bool = False) -> DataFrame:
    """C20: bilinear resampling onto the output grid, the four neighbours weighted by their coverage.

    Every output pixel inside a frame's footprint asks for its four corners; corners meet their samples in one
    equi-join on (frame, x, y), so the work grows with the pixels and no frame is held by one task."""
    grid = footprint(transforms, width, height, out_width, out_height)
    inside = (F.col("sx") > -1) & (F.col("sy") > -1) & (F.col("sx") < width) & (F.col("sy") < height)
    grid = grid.where(inside & F.col("sx").between(0, width - 1) & F.col("sy").between(0, height - 1))
    x0, y0 = F.floor("sx").cast("int"), F.floor("sy").cast("int")
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    corner = lambda ix, iy: F.struct((x0 + ix).alias("x"), (y0 + iy).alias("y"),
                                     ((fx if ix else F.lit(1.0) - fx) * (fy if iy else F.lit(1.0) - fy)).alias("w"))
    corners = grid.select("frame_id", "ox", "oy", "sx", "sy", F.explode(F.array(
        corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))).alias("k")).select(
        "frame_id", "ox", "oy", "sx", "sy", "k.x", "k.y", "k.w").where(F.col("w") > 0)
    cover = clamp(F.col("coverage"), 0.0, 1.0)
    source = df.select("frame_id", "x", "y", "channel", "value",
                       F.when(F.col("value").isNotNull(), cover).otherwise(0.0).alias("_c"))
    rows = corners.join(source, ["frame_id", "x", "y"])
    w = F.col("w") * F.col("_c")
    extra = ["sx", "sy"] if keep_source else []
    out = rows.groupBy("frame_id", "ox", "oy", "channel", *extra).agg(
        F.try_divide(F.sum(w * F.coalesce(F.col("value"), F.lit(0.0))), F.sum(w)).alias("value"), F.sum(w).alias("coverage"))
    return out.where(F.col("coverage") > MIN_COVERAGE).select(
        "frame_id", F.col("ox").alias("x"), F.col("oy").alias("y"), "channel", "value", "coverage", *extra)


def feather_mosaic(df: DataFrame, transforms: DataFrame, width: int, height: int, out_width: int, out_height: int,
                   corrections: DataFrame | None = None, blend: str = "feather") -> DataFrame:
    """Panels on one canvas, weighted by distance to their own edge and by coverage. The output
    coverage is the largest of the panels (feather) or the weighted mean of covered panels (average)."""
    choice("blend", blend, ("feather", "average"))
    placed = resample_affine(df, transforms, width, height, out_width, out_height, keep_source=True)
    if corrections is not None:
        placed = join_keys(placed, corrections.select("frame_id", "channel", "gain", "offset"), ["frame_id", "channel"], "left")
        placed = placed.withColumn("value", F.col("value") * F.coalesce("gain", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0)))
    base = feather_weight(F.col("sx"), F.col("sy"), width, height) if blend == "feather" else F.lit(1.0)
    w = base * F.col("coverage")
    cover = F.max("coverage") if blend == "feather" else F.sum(w) / F.count(F.lit(1))
    return placed.groupBy(*PIXEL).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"), cover.alias("coverage"))


def drizzle(df: DataFrame, transforms: DataFrame, width: int, height: int, scale: int = 2, pixfrac: float = 1.0,
            weight: str | None = None) -> DataFrame:
    """Each sample becomes a square drop on the finer grid and deposits overlap area x coverage; the output
    is the weighted mean. ``width`` and ``height`` are the canvas before scaling. ``transforms`` carry shifts (``dx``, ``dy``); general ones are D40.

    A drop covers at most (pixfrac*scale + 1)^2 output pixels, so the explosion factor is a constant."""
    require(1 <= scale <= 4, "scale must be within 1..4")
    finite("pixfrac", pixfrac, 0.01, 1)
    rows = df.where((F.col("coverage") > MIN_COVERAGE) & F.col("value").isNotNull()).join(
        transforms.select("frame_id", "dx", "dy"), "frame_id")
    half = pixfrac * scale / 2
    cx = (F.col("x") + F.col("dx") + 0.5) * scale
    cy = (F.col("y") + F.col("dy") + 0.5) * scale
    w = F.col("coverage") * (F.col(weight) if weight else F.lit(1.0))
    return deposit(rows.select(*[c for c in ("channel",)], "value", w.alias("_w"), (cx - half).alias("_x0"), (cx + half).alias("_x1"),
                               (cy - half).alias("_y0"), (cy + half).alias("_y1")), width * scale, height * scale)


def deposit(rows: DataFrame, width: int, height: int) -> DataFrame:
    """Spread axis-aligned drops over the output pixels they overlap; weighted mean and total weight per pixel.
    Drops off the canvas are dropped before they are spread."""
    return _spread_boxes(rows, width, height).groupBy(*PIXEL).agg(
        (F.sum("_s") / F.sum("_w")).alias("value"), F.sum("_w").alias("weight"))


def drizzle_mosaic(df: DataFrame, frames: DataFrame, width: int, height: int, pattern: str = "RGGB", scale: float = 1.0,
                   pixfrac: float = 1.0, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Raw Bayer samples of many frames on one colour canvas. Each sample goes to its own colour plane as a
    drop under the frame's affine transform; the deposit is the exact overlap polygon area. ``frames``:
    ``frame_id a b c d dx dy weight`` and arrays ``background gain`` with one entry per colour.

    Axis-aligned transforms stay in Spark expressions; the rest are clipped in vectorised batches."""
    require_columns(frames, ["frame_id", "a", "b", "c", "d", "dx", "dy", "background", "gain", "weight"], "frames")
    require(0.01 <= scale <= 16 and width > 0 and height > 0, "scale or canvas out of range")
    finite("pixfrac", pixfrac, 0.01, 1)
    rows = df.where((F.col("coverage") > MIN_COVERAGE) & F.col("value").isNotNull()).join(frames, "frame_id")
    color = bayer_color(pattern, F.col("x"), F.col("y"))
    of_color = lambda c: F.get(c, color)
    value = (F.col("value") - of_color("background")) * of_color("gain")
    x, y = F.col("x"), F.col("y")
    rows = rows.select(
        color.alias("channel"), value.alias("value"), (F.col("coverage") * F.col("weight")).alias("_w"),
        *[(F.col(n) * scale).alias(n) for n in ("a", "b", "c", "d")],
        ((F.col("a") * x + F.col("b") * y + F.col("dx") - origin[0] + 0.5) * scale).alias("_cx"),
        ((F.col("c") * x + F.col("d") * y + F.col("dy") - origin[1] + 0.5) * scale).alias("_cy"))
    # Half extents of the transformed drop bound its footprint; drops off the canvas go no further.
    hx = (F.abs("a") + F.abs("b")) * (pixfrac / 2)
    hy = (F.abs("c") + F.abs("d")) * (pixfrac / 2)
    rows = rows.withColumns({"_x0": F.col("_cx") - hx, "_x1": F.col("_cx") + hx, "_y0": F.col("_cy") - hy, "_y1": F.col("_cy") + hy})
    rows = rows.where((F.col("_x1") > 0) & (F.col("_y1") > 0) & (F.col("_x0") < width) & (F.col("_y0") < height))
    axis = (F.col("b") == 0) & (F.col("c") == 0)
    area = F.abs(F.col("a") * F.col("d") - F.col("b") * F.col("c")) * (pixfrac * pixfrac)
    rows = rows.withColumn("_w", F.try_divide(F.col("_w"), area)).where(F.col("_w").isNotNull())
    plain = rows.where(axis).select("channel", "value", "_w", "_x0", "_x1", "_y0", "_y1")
    flat = _spread_boxes(plain, width, height)
    skew = rows.where(~axis).mapInPandas(_clipper(pixfrac, width, height), "channel int, x int, y int, _s double, _w double")
    return flat.unionByName(skew).groupBy(*PIXEL).agg((F.sum("_s") / F.sum("_w")).alias("value"), F.sum("_w").alias("weight"))


def _spread_boxes(rows: DataFrame, width: int, height: int) -> DataFrame:
    rows = rows.where((F.col("_x1") > 0) & (F.col("_y1") > 0) & (F.col("_x0") < width) & (F.col("_y0") < height))
    return deposit_rows(rows).where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select(
        "channel", "x", "y", (F.col("value") * F.col("_w")).alias("_s"), "_w")


def deposit_rows(rows: DataFrame) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(lo).cast("int"), F.greatest(F.ceil(hi) - 1, F.floor(lo)).cast("int"))
    overlap = lambda lo, hi, at: F.greatest(F.lit(0.0), F.least(F.col(hi), F.col(at) + 1) - F.greatest(F.col(lo), F.col(at).cast("double")))
    rows = rows.withColumn("x", F.explode(span("_x0", "_x1"))).withColumn("y", F.explode(span("_y0", "_y1")))
    return rows.withColumn("_w", F.col("_w") * overlap("_x0", "_x1", "x") * overlap("_y0", "_y1", "y")).where("_w > 0")


def _clipper(pixfrac: float, width: int, height: int):
    """Exact area of parallelogram drops over unit pixels, one vectorised clip per batch and pixel offset."""
    import numpy as np
    import pandas as pd

    def clip(poly, counts, axis, bound, above):
        """Clip every polygon of a padded batch to a half plane (Sutherland-Hodgman, all rows at once)."""
        n, m, _ = poly.shape
        out = np.zeros((n, m + 2, 2))
        sizes = np.zeros(n, dtype=int)
        sign = 1.0 if above else -1.0
        rows = np.arange(n)
        for i in range(m):
            live = i < counts
            p = poly[:, i]
            q = np.where((i + 1 < counts)[:, None], poly[:, (i + 1) % m], poly[:, 0])
            dp, dq = sign * (p[:, axis] - bound), sign * (q[:, axis] - bound)
            keep = live & (dp >= 0)
            out[rows[keep], sizes[keep]] = p[keep]
            sizes[keep] += 1
            cross = live & ((dp >= 0) != (dq >= 0))
            t = np.where(cross, dp / np.where(cross, dp - dq, 1.0), 0.0)[:, None]
            out[rows[cross], sizes[cross]] = (p + (q - p) * t)[cross]
            sizes[cross] += 1
        return out, sizes

    def area(poly, counts):
        total = np.zeros(len(poly))
        for i in range(poly.shape[1]):
            live = i < counts
            nxt = np.where((i + 1 < counts)[:, None], poly[:, (i + 1) % poly.shape[1]], poly[:, 0])
            total += np.where(live, poly[:, i, 0] * nxt[:, 1] - poly[:, i, 1] * nxt[:, 0], 0.0)
        return np.abs(total) / 2

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            h = pixfrac / 2
            signs = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)]) * h
            m = pdf[["a", "b", "c", "d"]].to_numpy().reshape(-1, 2, 2)
            centre = pdf[["_cx", "_cy"]].to_numpy()
            drop = np.einsum("nij,kj->nki", m, signs) + centre[:, None, :]
            x0, y0 = np.floor(pdf["_x0"].to_numpy()).astype(int), np.floor(pdf["_y0"].to_numpy()).astype(int)
            x1, y1 = np.ceil(pdf["_x1"].to_numpy()).astype(int), np.ceil(pdf["_y1"].to_numpy()).astype(int)
            parts = []
            for oy in range(int((y1 - y0).max())):
                for ox in range(int((x1 - x0).max())):
                    px, py = x0 + ox, y0 + oy
                    use = (px < x1) & (py < y1) & (px >= 0) & (py >= 0) & (px < width) & (py < height)
                    if not use.any():
                        continue
                    poly, counts = drop[use], np.full(use.sum(), 4)
                    for axis, at in ((0, px[use]), (1, py[use])):
                        poly, counts = clip(poly, counts, axis, at, True)
                        poly, counts = clip(poly, counts, axis, at + 1, False)
                    w = area(poly, counts) * pdf["_w"].to_numpy()[use]
                    hit = w > 0
                    parts.append(pd.DataFrame({"channel": pdf["channel"].to_numpy()[use][hit], "x": px[use][hit], "y": py[use][hit],
                                               "_s": (pdf["value"].to_numpy()[use] * w)[hit], "_w": w[hit]}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    return run


def extract_two_lines(df: DataFrame, mode: str, pattern: str = "RGGB", width: int | None = None, height: int | None = None) -> DataFrame:
    """The two lines of a dual-band exposure from a Bayer mosaic; channel 0 is the red line.

    ``cell-average``: per 2x2 cell the red sample and the mean of the other three. ``red-grid``: around each red
    site ``(2*sum(4 green) + sum(4 blue)) / 12``; missing at edges."""
    choice("mode", mode, ("cell-average", "red-grid"))
    color = bayer_color(pattern, F.col("x"), F.col("y"))
    rows = df.select("frame_id", "x", "y", F.when(F.col("coverage") > MIN_COVERAGE, F.col("value")).alias("value"), color.alias("_k"))
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    if mode == "cell-average":
        complete = lambda cond, n: F.when(F.count(F.when(cond, F.col("value"))) == n, F.avg(F.when(cond, F.col("value"))))
        cells = rows.groupBy("frame_id", half("x").alias("x"), half("y").alias("y")).agg(
            complete(F.col("_k") == 0, 1).alias("l0"), complete(F.col("_k") != 0, 3).alias("l1"))
    else:
        # Every sample is sent to the red sites it surrounds: greens share an edge, blues a corner.
        near = F.explode(F.array(*[F.struct((F.col("x") - dx).alias("rx"), (F.col("y") - dy).alias("ry"),
                                            F.lit(abs(dx) + abs(dy)).alias("reach")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
        sent = rows.select("frame_id", near.alias("n"), "value").select("frame_id", "n.rx", "n.ry", "n.reach", "value")
        sent = sent.where((bayer_color(pattern, F.col("rx"), F.col("ry")) == 0) & (F.col("rx") >= 0) & (F.col("ry") >= 0))
        part = lambda r, n: F.when(F.count(F.when(F.col("reach") == r, F.col("value"))) == n, F.sum(F.when(F.col("reach") == r, F.col("value"))))
        cells = sent.groupBy("frame_id", half("rx").alias("x"), half("ry").alias("y")).agg(
            part(0, 1).alias("l0"), ((part(1, 4) * 2 + part(2, 4)) / 12).alias("l1"), F.count(F.when(F.col("reach") == 0, 1)).alias("_site"))
        cells = cells.where("_site > 0").drop("_site")
    pair = F.explode(F.array(F.struct(F.lit(0).alias("channel"), F.col("l0").alias("value")),
                             F.struct(F.lit(1).alias("channel"), F.col("l1").alias("value"))))
    return cells.select("frame_id", "x", "y", pair.alias("p")).select(
        "frame_id", "x", "y", "p.channel", "p.value", F.when(F.col("p.value").isNotNull(), 1.0).otherwise(0.0).alias("coverage"))


# --- seams and exposure ----------------------------------------------------------------------

def seam_pairs(placed: DataFrame, cells: int = 4, grid: int = 48, sample: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """For every two overlapping panels, 3x3 patch medians of both on a grid over their common rectangle.

    ``placed``: ``frame_id x y channel value`` plus ``after`` (corrected value). Panels meet by an equi-join on the
    pixel; the patch of a grid pixel is gathered by sending each overlap pixel to the grid pixels next to it.

    J3: ``sample`` is the caller's own sampler: it turns ``placed`` into the samples to compare, of the same columns."""
    placed = placed if sample is None else sample(placed)
    require_columns(placed, ["frame_id", *PIXEL, "value", "after"], "placed")
    side = lambda n: placed.select(F.col("frame_id").alias(n), *PIXEL, F.col("value").alias(f"{n}_before"), F.col("after").alias(f"{n}_after"))
    both = side("first").join(side("second"), PIXEL).where(F.col("first") < F.col("second"))
    pair = ["first", "second"]
    both = both.where(F.col("first_before").isNotNull() & F.col("second_before").isNotNull())
    box = both.groupBy(*pair).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    both = both.join(box, pair)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    nx, ny = F.least(F.lit(grid), w), F.least(F.lit(grid), h)

    def on_grid(at: Column, start: Column, length: Column, n: Column) -> Column:
        """``at - start`` equals floor((i + .5) * length / n) for some i."""
        off = at - start
        i = F.ceil((off * n / length) - 0.5)
        return (off >= 0) & (off < length) & (F.floor((i + 0.5) * length / n) == off)

    # Grid columns and rows beside a pixel are picked before rows multiply.
    beside = lambda c, start, length, n: F.explode(F.filter(F.array(*[F.col(c) + d for d in (-1, 0, 1)]), lambda g: on_grid(g, F.col(start), length, n)))
    sent = both.withColumn("_gx", beside("x", "x0", w, nx)).withColumn("_gy", beside("y", "y0", h, ny))
    sent = sent.withColumn("_g", F.struct(F.col("_gx").alias("gx"), F.col("_gy").alias("gy")))
    spot = [*pair, "channel", "gx", "gy"]
    sent = sent.select(*pair, "channel", F.col("_g.gx").alias("gx"), F.col("_g.gy").alias("gy"), "x0", "y0", w.alias("w"), h.alias("h"),
                       "first_before", "second_before", "first_after", "second_after")
    # A patch has nine members by construction, so its arrays are bounded.
    names = ["first_before", "second_before", "first_after", "second_after"]
    middle = lambda c: F.get(F.sort_array(F.collect_list(c)), F.lit(4)).alias(c)
    out = sent.groupBy(*spot, "x0", "y0", "w", "h").agg(F.count(F.lit(1)).alias("_n"), *[middle(n) for n in names]).where("_n = 9")
    cut = lambda g, start, length: F.least(F.lit(cells - 1), F.floor((F.col(g) - F.col(start)) * cells / F.col(length)))
    return out.select(*spot, (cut("gy", "y0", "h") * cells + cut("gx", "x0", "w")).cast("int").alias("cell"), *names)


def seam_statistics(pairs: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Medians of both sides, median, RMS, MAD and 95th percentile of the difference, per key (upper medians)."""
    d = F.col(second) - F.col(first)
    entry = lambda name, c: F.struct(F.lit(name).alias("m"), c.alias("v"))
    rows = pairs.select(*keys, F.explode(F.array(entry("first", F.col(first)), entry("second", F.col(second)),
                                                 entry("diff", d), entry("abs", F.abs(d)))).alias("e")).select(*keys, "e.m", "e.v")
    level = quantiles(rows, [*keys, "m"], "v", {"up": ("upper",), "p95": ("ceil", 0.95)})
    pick = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    t = level.groupBy(*keys).agg(pick("first", "up").alias("first_median"), pick("second", "up").alias("second_median"),
                                 pick("diff", "up").alias("median_difference"), pick("abs", "p95").alias("p95"))
    diffs = join_keys(pairs.select(*keys, d.alias("_d")), t, keys)
    counts = diffs.groupBy(*keys, "first_median", "second_median", "median_difference", "p95").agg(
        F.count(F.lit(1)).alias("samples"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rms"))
    mad = quantiles(diffs.withColumn("_e", F.abs(F.col("_d") - F.col("median_difference"))), keys, "_e", {"mad": ("upper",)})
    return join_keys(counts, mad, keys)


def with_totals(pairs: DataFrame, cell: str = "cell") -> DataFrame:
    """Every sample once for its cell and once for the whole seam (cell -1)."""
    return pairs.withColumn(cell, F.explode(F.array(F.col(cell), F.lit(-1))))


def exposure_corrections(placed: DataFrame, order: list[int], minimum: int = 16, clamp_color: bool = False) -> DataFrame:
    """C14: gain and offset per panel and channel, each panel against those before it in ``order``.

    The loop runs over panels (each depends on the corrections before it); per step Spark does one join and
    two aggregates and the driver keeps gain and offset, a few numbers. Panels stay distributed."""
    require(len(order) == len(set(order)) and len(order) > 0, "order must list distinct panels")
    spark = placed.sparkSession
    # Read by every step: written once, so that the panels are not built again for each of them.
    cols = cut_lineage(placed.where(F.col("coverage") > 0.5).select("frame_id", *PIXEL, "value"))
    done: dict[tuple[int, int], tuple[float, float]] = {}
    schema = "frame_id bigint, channel int, gain double, offset double"
    for step in range(1, len(order)):
        table = spark.createDataFrame([(p, c, g, o) for (p, c), (g, o) in done.items()] or [], schema)
        # At most one row per earlier panel and channel.
        earlier = cols.where(F.col("frame_id").isin(order[:step])).join(table, ["frame_id", "channel"], "left")
        r = F.col("value") * F.coalesce("gain", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0))
        if clamp_color:
            r = clamp(r, 0.0, 1.0)
        earlier = earlier.select(*PIXEL, r.alias("r"))
        both = cols.where(F.col("frame_id") == order[step]).select(*PIXEL, F.col("value").alias("m")).join(earlier, PIXEL)
        sums = both.groupBy("channel").agg(
            F.count(F.lit(1)).alias("n"), F.covar_pop("r", "m").alias("cov"), F.var_pop("m").alias("var"),
            F.sum(F.col("m") * F.col("m")).alias("energy"), F.least(F.min("r"), F.min("m")).alias("lo"), F.greatest(F.max("r"), F.max("m")).alias("hi")).collect()
        gains = {}
        for s in sums:
            if s["n"] < minimum:
                continue
            floor = 2.220446049250313e-16 * max(s["energy"], 2.2250738585072014e-308)
            fitted = s["cov"] / s["var"] if s["var"] * s["n"] > floor else 1.0
            limit = 0.25 if clamp_color else 0.25 * max(1.0, s["hi"] - s["lo"])
            gains[s["channel"]] = (min(2.0, max(0.5, fitted)), limit)
        if not gains:
            continue
        gain = None
        for c, (g, _) in gains.items():
            gain = F.when(F.col("channel") == c, g) if gain is None else gain.when(F.col("channel") == c, g)
        res = both.where(F.col("channel").isin(list(gains))).select("channel", (F.col("r") - F.col("m") * gain).alias("d"))
        for row in quantiles(res, ["channel"], "d", {"m": ("upper",)}).collect():
            g, limit = gains[row["channel"]]
            done[(order[step], row["channel"])] = (g, min(limit, max(-limit, row["m"])))
    return spark.createDataFrame([(int(p), int(c), float(g), float(o)) for (p, c), (g, o) in done.items()] or [], schema)


# --- frequency-domain coaddition -------------------------------------------------------------

def frame_spectra(df: DataFrame, width: int, height: int) -> DataFrame:
    """Half-plane spectrum per frame and channel: ``frame_id channel u v re im``. One frame is one group here,
    because a Fourier transform needs all its pixels; its size is fixed by ``width * height``."""
    require(width * height <= 1 << 26, "frame too large for one transform")
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((height, width))
        image[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf["value"].fillna(0.0).to_numpy()
        f = np.fft.rfft2(image)
        v, u = np.indices(f.shape)
        return pd.DataFrame({"frame_id": pdf["frame_id"].iloc[0], "channel": pdf["channel"].iloc[0], "u": u.ravel(), "v": v.ravel(),
                             "re": f.real.ravel(), "im": f.imag.ravel()})

    return df.select("frame_id", "channel", "x", "y", "value").groupBy("frame_id", "channel").applyInPandas(
        run, "frame_id bigint, channel int, u int, v int, re double, im double")


def frequency_coadd(spectra: DataFrame, frames: DataFrame, keys: list[str] = ["channel", "u", "v"]) -> DataFrame:
    """Per frequency bin the sums ``F*conj(T)*X / (s2*P)`` and ``F^2*|T|^2 / (s2*P)``.

    ``spectra``: keys, ``re im`` (X), ``t_re t_im`` (transfer) and ``p`` (noise power of the bin). ``frames``:
    ``frame_id flux variance``. Partial sums of separate runs merge by addition."""
    require_columns(spectra, ["frame_id", *keys, "re", "im", "t_re", "t_im", "p"], "spectra")
    s = spectra.join(frames.select("frame_id", "flux", "variance"), "frame_id")
    w = F.col("variance") * F.col("p")
    re = F.col("t_re") * F.col("re") + F.col("t_im") * F.col("im")
    im = F.col("t_re") * F.col("im") - F.col("t_im") * F.col("re")
    power = F.col("t_re") * F.col("t_re") + F.col("t_im") * F.col("t_im")
    return s.where(w > 0).groupBy(*keys).agg(
        F.sum(F.col("flux") * re / w).alias("num_re"), F.sum(F.col("flux") * im / w).alias("num_im"),
        F.sum(F.col("flux") * F.col("flux") * power / w).alias("information"), F.count(F.lit(1)).alias("frames"))


def merge_coadds(a: DataFrame, b: DataFrame, keys: list[str] = ["channel", "u", "v"]) -> DataFrame:
    return a.unionByName(b).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("num_re", "num_im", "information", "frames")])


def render_coadd(sums: DataFrame, target: Column | float = 1.0) -> DataFrame:
    """numerator * target / information; a bin without information is zero."""
    t = target if isinstance(target, Column) else F.lit(float(target))
    value = lambda c: F.when(F.col("information") > 0, F.try_divide(F.col(c) * t, F.col("information"))).otherwise(0.0)
    return sums.withColumns({"re": value("num_re"), "im": value("num_im")})


# --- fold patterns ---------------------------------------------------------------------------

def fold_locations(residuals: DataFrame, folds: int = 3, passes: int = 32) -> DataFrame:
    """Robust (pseudo-Huber) location and total weight per pixel and fold (frame ``seq`` modulo ``folds``).

    ``residuals``: ``frame_id seq x y channel value weight noise`` (noise scale of the frame). The scale of a fold
    and sensor phase is 1.5 times its median noise. The root of the convex objective is found by bracketed Newton
    steps; every step is two sums per key over rows that stay where one shuffle put them."""
    require(folds >= 2, "at least two folds")
    require_columns(residuals, ["seq", *PIXEL, "value", "weight", "noise"], "residuals")
    keys = [*PIXEL, "fold"]
    fold = F.pmod(F.col("seq"), F.lit(folds)).cast("int")
    rows = residuals.where(F.col("value").isNotNull() & (F.col("weight") > 0)).withColumns(
        {"fold": fold, "_phase": bayer_phase(F.col("x"), F.col("y"))})
    per_frame = rows.groupBy("fold", "_phase", "seq").agg(F.max("noise").alias("noise"))
    scale = quantiles(per_frame, ["fold", "_phase"], "noise", {"_s": ("avg",)}).select(
        "fold", "_phase", F.greatest(F.lit(1e-6), F.col("_s") * 1.5).alias("_s"))
    # folds x 4 rows.
    rows = rows.join(F.broadcast(scale), ["fold", "_phase"]).select(*keys, F.col("value").alias("_v"), F.col("weight").alias("_w"), "_s")

    def body(part: DataFrame, group) -> DataFrame:
        base, state = part, ["_c", "_lo", "_hi", "_total"]
        part = group.attach_agg(part, {"_total": F.sum("_w"), "_sum": F.sum(F.col("_w") * F.col("_v")),
                                       "_lo": F.min("_v"), "_hi": F.max("_v")})
        part = part.withColumn("_c", F.col("_sum") / F.col("_total")).drop("_sum")
        for _ in range(passes):
            part = group.settle(part, base, state)
            z = (F.col("_c") - F.col("_v")) / F.col("_s")
            inv = F.lit(1.0) / F.sqrt(F.lit(1.0) + z * z)
            part = group.attach_agg(part, {"_g": F.sum(F.col("_w") * (F.col("_c") - F.col("_v")) * inv),
                                           "_h": F.sum(F.col("_w") * inv * inv * inv)})
            done = F.abs("_g") <= F.col("_s") * F.col("_total") * 1e-12
            part = part.withColumns({"_hi": F.when(F.col("_g") > 0, F.col("_c")).otherwise(F.col("_hi")),
                                     "_lo": F.when(F.col("_g") > 0, F.col("_lo")).otherwise(F.col("_c"))})
            step = F.col("_c") - F.try_divide(F.col("_g"), F.col("_h"))
            inside = (step > F.col("_lo")) & (step < F.col("_hi"))
            part = part.withColumn("_c", F.when(done, F.col("_c")).when(inside, step).otherwise((F.col("_lo") + F.col("_hi")) / 2)).drop("_g", "_h")
        return part.groupBy(*keys).agg(F.max("_c").alias("location"), F.max("_total").alias("weight"))

    return per_key(rows, keys, body)


def fold_pattern(locations: DataFrame, minimum_samples: float = 12.0, minimum_correlation: float = 0.2,
                 minimum_pixels: float = 128.0) -> tuple[DataFrame, DataFrame]:
    """For each excluded fold the mean pattern of the other two, kept to the share on which they agree.

    Returns (per excluded fold and phase: correlation, retention), (per pixel and fold: correction)."""
    wide = locations.groupBy(*PIXEL).agg(*[F.max(F.when(F.col("fold") == i, F.col(c))).alias(f"{n}{i}")
                                           for i in range(3) for c, n in (("location", "f"), ("weight", "w"))])
    wide = wide.withColumn("phase", bayer_phase(F.col("x"), F.col("y")))
    rows = wide.select(*PIXEL, "phase", F.explode(F.array(*[
        F.struct(F.lit(i).alias("fold"), F.col(f"f{(i + 1) % 3}").alias("a"), F.col(f"f{(i + 2) % 3}").alias("b"),
                 F.least(F.col(f"w{(i + 1) % 3}"), F.col(f"w{(i + 2) % 3}")).alias("n")) for i in range(3)])).alias("p"))
    t = clamp(F.col("p.n") - (minimum_samples - 1), 0.0, 1.0)
    rows = rows.where("p.a is not null and p.b is not null").select(*PIXEL, "phase", "p.fold", "p.a", "p.b", (t * t * (F.lit(3.0) - t * 2)).alias("w")).where("w > 0")
    w, a, b = F.col("w"), F.col("a"), F.col("b")
    sums = rows.groupBy("fold", "phase").agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("aa"),
        F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab")).where(F.col("n") >= minimum_pixels)
    va = F.greatest(F.lit(0.0), F.col("aa") - F.col("sa") * F.col("sa") / F.col("n"))
    vb = F.greatest(F.lit(0.0), F.col("bb") - F.col("sb") * F.col("sb") / F.col("n"))
    sums = sums.withColumns({"va": va, "vb": vb, "cov": F.col("ab") - F.col("sa") * F.col("sb") / F.col("n"),
                             "ac": F.col("sa") / F.col("n"), "bc": F.col("sb") / F.col("n")})
    corr = F.when((F.col("va") > 0) & (F.col("vb") > 0), clamp(F.try_divide(F.col("cov"), F.sqrt(F.col("va") * F.col("vb"))), -1.0, 1.0)).otherwise(0.0)
    power = (F.col("va") + F.col("vb") + F.col("cov") * 2) * 0.25
    stats = sums.select("fold", "phase", "ac", "bc", corr.alias("correlation"), F.when(
        (corr >= minimum_correlation) & (power > 0), clamp(F.try_divide(F.col("cov"), power), 0.0, 1.0)).otherwise(0.0).alias("retention"))
    # Twelve rows at most (folds x phases).
    out = rows.join(F.broadcast(stats), ["fold", "phase"]).select(
        *PIXEL, "fold", (w * F.col("retention") * 0.5 * (a - F.col("ac") + b - F.col("bc"))).alias("correction"))
    return stats.drop("ac", "bc"), out

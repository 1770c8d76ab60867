"""Calibration against masters, master building and normalisation to a reference frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bayer_phase, clamp, grid_cell
from ..schema import MIN_COVERAGE, PIXEL, choice, finite, require, require_columns
from .color import luminance
from .stats import join_keys, quantiles

BIAS_STATES = ("included", "removed", "unknown")


def _plane(df: DataFrame | None, name: str) -> DataFrame | None:
    if df is None:
        return None
    require_columns(df, [*PIXEL, "value", "coverage"], name)
    return df.select(*PIXEL, F.col("value").alias(f"_{name}"), F.col("coverage").alias(f"_{name}_c"))


def master_table(dark: DataFrame | None, bias: DataFrame | None, flat: DataFrame | None) -> DataFrame | None:
    """All masters side by side, one row per pixel, so that lights are joined once."""
    out = None
    for part in (_plane(dark, "dark"), _plane(bias, "bias"), _plane(flat, "flat")):
        if part is not None:
            out = part if out is None else out.join(part, PIXEL, "full")
    return out


def check_states(dark, bias, flat, dark_state: str, flat_state: str) -> tuple[bool, bool]:
    """Refuse ambiguous bias handling; whether bias is taken from the light and from the flat."""
    choice("dark_bias_state", dark_state, BIAS_STATES)
    choice("flat_bias_state", flat_state, BIAS_STATES)
    require(not (dark is not None and bias is not None and dark_state == "unknown"),
            "say whether the dark includes bias before using both")
    require(not (flat is not None and bias is not None and flat_state == "unknown"),
            "say whether the flat includes bias before using both")
    require(not (flat is not None and bias is None and flat_state == "included"),
            "a flat that includes bias needs a bias master")
    return (bias is not None and (dark is None or dark_state == "removed"),
            flat is not None and bias is not None and flat_state == "included")


def calibrate(light: DataFrame, dark: DataFrame | None = None, bias: DataFrame | None = None,
              flat: DataFrame | None = None, dark_bias_state: str = "unknown", flat_bias_state: str = "unknown",
              flat_epsilon: float = 1.0e-6, clamp_negative: bool = True, sensor: bool = False) -> DataFrame:
    """``(light - dark - bias?) / (flat' / mean(flat'))``.

    ``sensor=False`` (C1): flat mean per channel, negatives clamped on request, coverage is the least of
    all inputs, a pixel with one bad flat channel is invalid as a whole. ``sensor=True`` (C2): flat mean
    per Bayer phase, nothing clamped. Invalid pixels get a NULL value and coverage 0."""
    require_columns(light, ["frame_id", *PIXEL, "value", "coverage"], "light")
    on_light, on_flat = check_states(dark, bias, flat, dark_bias_state, flat_bias_state)
    finite("flat_epsilon", flat_epsilon, 0)
    masters = master_table(dark, bias, flat)
    if masters is None:
        return light
    cover = [F.col("coverage")]
    if dark is not None:
        cover.append(F.coalesce(F.col("_dark_c"), F.lit(0.0)))
    if on_light or on_flat:
        cover.append(F.coalesce(F.col("_bias_c"), F.lit(0.0)))
    if flat is not None:
        cover.append(F.coalesce(F.col("_flat_c"), F.lit(0.0)))
        part = bayer_phase(F.col("x"), F.col("y")) if sensor else F.col("channel")
        masters = masters.withColumns({
            "_f": F.col("_flat") - (F.col("_bias") if on_flat else F.lit(0.0)), "_part": part})
        counts = (F.col("_f") > 0) if sensor else (F.col("_f") > 0) & (F.col("_flat_c") > MIN_COVERAGE)
        # One row per channel or phase: a fixed handful, safe to broadcast.
        means = masters.where(counts).groupBy("_part").agg(F.avg("_f").alias("_mean"))
        masters = masters.join(F.broadcast(means), "_part", "left").withColumn("_n", F.col("_f") / F.col("_mean")).drop("_part")
        if not sensor:
            worst = Window.partitionBy("x", "y")
            bad = F.when(F.col("_n") > flat_epsilon, 0).otherwise(1)
            masters = masters.withColumn("_bad", F.max(bad).over(worst))
        else:
            masters = masters.withColumn("_bad", F.when(F.col("_n") > flat_epsilon, 0).otherwise(1))
    rows = light.join(masters, PIXEL, "left")
    value = F.col("value")
    if dark is not None:
        value = value - F.col("_dark")
    if on_light:
        value = value - F.col("_bias")
    if flat is not None:
        value = F.when(F.col("_bad") == 0, F.try_divide(value, F.col("_n")))
    if clamp_negative and not sensor:
        value = F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))
    covered = cover[0] if len(cover) == 1 else F.least(*cover)
    valid = (covered > MIN_COVERAGE) & value.isNotNull() & ~F.isnan(value) if not sensor else value.isNotNull() & ~F.isnan(value)
    return rows.select(*[c for c in light.columns if c not in ("value", "coverage")],
                       F.when(valid, value).alias("value"),
                       F.when(valid, F.lit(1.0) if sensor else covered).otherwise(0.0).alias("coverage"))


def calibrate_sensor(light: DataFrame, **masters) -> DataFrame:
    """C2"""
    return calibrate(light, sensor=True, clamp_negative=False, **masters)


def calibration_counts(df: DataFrame) -> DataFrame:
    """Invalid and negative pixels per frame."""
    return df.groupBy("frame_id").agg(F.count(F.when(F.col("value").isNull(), 1)).alias("invalid"),
                                      F.count(F.when(F.col("value") < 0, 1)).alias("negative"))


def build_master(df: DataFrame, role: str, method: str = "median", min_samples: int = 3, bias: DataFrame | None = None,
                 dark_flat: DataFrame | None = None, cfa: bool = True) -> DataFrame:
    """One row per pixel: ``value`` (NULL below ``min_samples``), ``accepted``, ``missing``.

    Flats: corrected values <= 0 are dropped and every frame is scaled, per sensor phase, to the first."""
    choice("role", role, ("bias", "dark", "flat", "dark-flat"))
    choice("method", method, ("mean", "median"))
    require(min_samples >= 1, "min_samples must be positive")
    masters = master_table(dark_flat, bias, None)
    value = F.col("value")
    if masters is not None:
        df = df.join(masters, PIXEL, "left")
        value = value - (F.col("_bias") if bias is not None else 0.0) - (F.col("_dark") if dark_flat is not None else 0.0)
    good = value.isNotNull() & ~F.isnan(value)
    if role == "flat":
        good = good & (value > 0)
    df = df.select("frame_id", *PIXEL, F.when(good, value).alias("value"))
    if role == "flat":
        df = df.withColumn("_phase", bayer_phase(F.col("x"), F.col("y")) if cfa else F.lit(0))
        means = df.groupBy("frame_id", "_phase").agg(F.avg("value").alias("_mean"))
        first = means.groupBy("_phase").agg(F.min_by("_mean", "frame_id").alias("_first"))
        scale = means.join(F.broadcast(first), "_phase").select(
            "frame_id", "_phase", (F.col("_first") / F.col("_mean")).alias("_scale"))
        df = df.join(scale, ["frame_id", "_phase"], "left").withColumn("value", F.col("value") * F.col("_scale"))
    counts = df.groupBy(*PIXEL).agg(F.avg("value").alias("_mean"), F.count("value").alias("accepted"),
                                    F.count(F.when(F.col("value").isNull(), 1)).alias("missing"))
    if method == "median":
        centre = quantiles(df, PIXEL, "value", {"_centre": ("avg",)})
        counts = join_keys(counts, centre, PIXEL, "left")
    pick = F.col("_mean" if method == "mean" else "_centre")
    return counts.select(*PIXEL, F.when(F.col("accepted") >= min_samples, pick).alias("value"), "accepted", "missing")


def master_totals(master: DataFrame) -> DataFrame:
    """Invalid pixels and missing samples of a built master."""
    return master.agg(F.count(F.when(F.col("value").isNull(), 1)).alias("invalid_pixels"),
                      F.sum("missing").alias("missing_samples"))


def _valid(df: DataFrame) -> DataFrame:
    return df.where((F.col("coverage") > MIN_COVERAGE) & F.col("value").isNotNull() & ~F.isnan("value"))


def common_coverage(df: DataFrame, ref: DataFrame, mono: bool = True) -> DataFrame:
    """Pixels valid in a frame and in the reference: ``frame_id x y value ref``."""
    level = (lambda d: _valid(d).select("frame_id", "x", "y", "value")) if mono else (
        lambda d: _valid(luminance(d)).select("frame_id", "x", "y", "value"))
    right = level(ref).select("x", "y", F.col("value").alias("ref"))
    return level(df).join(right, ["x", "y"])


def paired_statistics(pairs: DataFrame) -> DataFrame:
    """Backgrounds and 1.4826*MAD scales of frame and reference over shared pixels, per frame."""
    centre = side_medians(pairs, ["frame_id"], "value", "ref").withColumnsRenamed({"a": "background", "b": "ref_background"})
    dev = pairs.join(centre, "frame_id").select(
        "frame_id", F.abs(F.col("value") - F.col("background")).alias("_v"), F.abs(F.col("ref") - F.col("ref_background")).alias("_r"))
    scale = side_medians(dev, ["frame_id"], "_v", "_r").select(
        "frame_id", (F.col("a") * 1.4826).alias("scale"), (F.col("b") * 1.4826).alias("ref_scale"))
    return centre.join(scale, "frame_id")


def side_medians(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Medians ``a`` and ``b`` of two columns per key, in one pass over the unpivoted rows."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(first).alias("v")),
                              F.struct(F.lit(1).alias("side"), F.col(second).alias("v")))).alias("e")
    level = quantiles(df.select(*keys, sides).select(*keys, "e.side", "e.v"), [*keys, "side"], "v", {"m": ("avg",)})
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("m")))
    return level.groupBy(*keys).agg(pick(0).alias("a"), pick(1).alias("b"))


def match_reference(df: DataFrame, ref: DataFrame, mono: bool = True, epsilon: float = 1.0e-6) -> DataFrame:
    """``(v - background) * scale + reference background`` with statistics over shared pixels."""
    stats = paired_statistics(common_coverage(df, ref, mono))
    gain = F.when(F.col("ref_scale") > 0, F.greatest(F.lit(epsilon), F.col("ref_scale"))
                  / F.greatest(F.lit(epsilon), F.col("scale"))).otherwise(1.0)
    ok = (F.col("coverage") > MIN_COVERAGE) & F.col("value").isNotNull()
    return df.join(stats, "frame_id").select(
        *[c for c in df.columns if c not in ("value", "coverage")],
        F.when(ok, (F.col("value") - F.col("background")) * gain + F.col("ref_background")).alias("value"),
        F.when(ok, F.col("coverage")).otherwise(0.0).alias("coverage"))


def lattice(table: DataFrame, keys: list[str], cells: int, values: list[str]) -> DataFrame:
    """Grid values per key as arrays indexed by cell (``cells`` entries at most, so bounded)."""
    entries = F.sort_array(F.collect_list(F.struct("cell", *values)))
    return table.groupBy(*keys).agg(entries.alias("_e")).select(
        *keys, *[F.col("_e").getField(v).alias(v) for v in values])


def bilinear(grid: Column, x: Column, y: Column, columns: int, rows: int, width: int, height: int) -> Column:
    """Bilinear value between cell centres of a grid array."""
    fx = (x + 0.5) * columns / width - 0.5
    fy = (y + 0.5) * rows / height - 0.5
    x0 = F.floor(clamp(fx, 0.0, float(columns - 1))).cast("int")
    y0 = F.floor(clamp(fy, 0.0, float(rows - 1))).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(columns - 1)), F.least(y0 + 1, F.lit(rows - 1))
    tx, ty = clamp(fx - x0, 0.0, 1.0), clamp(fy - y0, 0.0, 1.0)
    at = lambda gx, gy: F.get(grid, gy * columns + gx)
    top = at(x0, y0) + (at(x1, y0) - at(x0, y0)) * tx
    bottom = at(x0, y1) + (at(x1, y1) - at(x0, y1)) * tx
    return top + (bottom - top) * ty


def match_reference_local(df: DataFrame, ref: DataFrame, columns: int, rows: int, width: int, height: int,
                          mono: bool = True, epsilon: float = 1.0e-6) -> DataFrame:
    """C11: as C10 with the background of either side interpolated from cell medians; an empty cell takes
    the global median. The grid travels as one small array per frame, so pixels are joined once."""
    require(0 < columns <= width and 0 < rows <= height and columns * rows <= 65536, "grid does not fit the frame")
    pairs = common_coverage(df, ref, mono)
    stats = paired_statistics(pairs)
    cell = grid_cell(F.col("y"), height, rows) * columns + grid_cell(F.col("x"), width, columns)
    cells = pairs.withColumn("cell", cell)
    keys = ["frame_id", "cell"]
    medians = side_medians(cells, keys, "value", "ref")
    full = stats.select("frame_id", "background", "ref_background",
                        F.explode(F.sequence(F.lit(0), F.lit(columns * rows - 1))).alias("cell"))
    full = full.join(medians, keys, "left").select(
        *keys, F.coalesce("a", "background").alias("own"), F.coalesce("b", "ref_background").alias("other"))
    grids = lattice(full, ["frame_id"], columns * rows, ["own", "other"]).join(stats, "frame_id")
    gain = F.greatest(F.lit(epsilon), F.col("ref_scale")) / F.greatest(F.lit(epsilon), F.col("scale"))
    level = lambda g: bilinear(F.col(g), F.col("x"), F.col("y"), columns, rows, width, height)
    ok = (F.col("coverage") > MIN_COVERAGE) & F.col("value").isNotNull()
    return df.join(grids, "frame_id").select(
        *[c for c in df.columns if c not in ("value", "coverage")],
        F.when(ok, (F.col("value") - level("own")) * gain + level("other")).alias("value"),
        F.when(ok, F.col("coverage")).otherwise(0.0).alias("coverage"))


def match_background(df: DataFrame, ref: DataFrame, stride: int = 1) -> DataFrame:
    """Add the per-channel difference of upper medians (pixels with coverage >= .99); flux unchanged."""
    require(stride >= 1, "stride must be positive")
    on_grid = (F.col("coverage") >= 0.99) & (F.col("x") % stride == 0) & (F.col("y") % stride == 0)
    own = quantiles(df.where(on_grid), ["frame_id", "channel"], "value", {"_own": ("upper",)})
    other = quantiles(ref.where(on_grid), ["channel"], "value", {"_other": ("upper",)})
    shift = own.join(F.broadcast(other), "channel").select(
        "frame_id", "channel", (F.col("_other") - F.col("_own")).alias("_shift"))
    return join_keys(df, shift, ["frame_id", "channel"], "left").withColumn(
        "value", F.when(F.col("coverage") > 0, F.col("value") + F.col("_shift")).otherwise(F.col("value"))).drop("_shift")

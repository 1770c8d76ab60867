"""Per-pixel projections, tone curves, colour operators and histograms."""

from __future__ import annotations

import ast
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (clamp, luma, smoothstep, soft_gamut_scale, srgb_decode, srgb_encode)
from ..schema import MIN_COVERAGE, choice, finite, require, require_columns
from .stats import join_keys, quantiles

SPOT = ["frame_id", "x", "y"]
RGB = ["r", "g", "b"]


def to_wide(df: DataFrame, spot: list[str] = SPOT) -> DataFrame:
    """One row per pixel: ``r g b`` (``g b`` NULL for mono) and ``coverage`` (0 if a present channel is missing).
    A partial aggregate and one shuffle on the pixel."""
    require_columns(df, [*spot, "channel", "value", "coverage"])
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("value")))
    return df.groupBy(*spot).agg(
        pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"),
        F.when(F.count("value") < F.count(F.lit(1)), 0.0)
        .otherwise(clamp(F.min("coverage"), 0.0, 1.0)).alias("coverage"))


def to_long(wide: DataFrame, spot: list[str] = SPOT) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.col(c).alias("value")) for i, c in enumerate(RGB)]))
    return wide.select(*spot, "coverage", rows.alias("_s")).select(*spot, "_s.channel", "_s.value", "coverage")


def luminance(df: DataFrame, spot: list[str] = SPOT) -> DataFrame:
    """B1: luminance per pixel; mono passes through."""
    wide = to_wide(df, spot)
    return wide.select(*spot, F.when(F.col("g").isNull() & F.col("b").isNull(), F.col("r"))
                       .otherwise(luma(*[F.col(c) for c in RGB])).alias("value"), "coverage")


def with_coverage(df: DataFrame, spot: list[str] = SPOT) -> DataFrame:
    """B2: coverage clamped to 0..1, and 0 for every channel of a pixel with a missing colour."""
    whole = Window.partitionBy(*spot)
    known = F.col("value").isNotNull() & ~F.isnan("value")
    missing = F.max(F.when(known, 0).otherwise(1)).over(whole)
    cover = F.coalesce(clamp(F.nanvl("coverage", F.lit(0.0)), 0.0, 1.0), F.lit(0.0))
    return df.withColumn("coverage", F.when(missing == 1, 0.0).otherwise(cover))


def crop(df: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """Keep a rectangle and rebase coordinates; the filter reaches the scan."""
    require(width > 0 and height > 0, "crop needs a positive size")
    inside = F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1)
    return df.where(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def exclude_ellipses(df: DataFrame, ellipses: list[dict]) -> DataFrame:
    """Drop points inside any rotated ellipse (``x y a b`` in pixels, ``angle`` in degrees).

    Ellipses are an argument list (at most 1000), so they become one predicate without any join."""
    require(len(ellipses) <= 1000, "at most 1000 ellipses")
    hit = F.lit(False)
    for e in ellipses:
        require(e["a"] > 0 and e["b"] > 0, "ellipse axes must be positive")
        c, s = math.cos(math.radians(e.get("angle", 0.0))), math.sin(math.radians(e.get("angle", 0.0)))
        dx, dy = F.col("x") - float(e["x"]), F.col("y") - float(e["y"])
        u, v = (dx * c + dy * s) / float(e["a"]), (dy * c - dx * s) / float(e["b"])
        hit = hit | (u * u + v * v <= 1)
    return df.where(~hit)


def stretch_value(v: Column, black, mid, white, asinh: float = 0.0) -> Column:
    as_col = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    black, white, mid = as_col(black), as_col(white), clamp(as_col(mid), 0.001, 0.999)
    out = F.pow(clamp((v - black) / (white - black), 0.0, 1.0), F.lit(math.log(0.5)) / F.log(mid))
    if asinh > 0:
        out = F.asinh(out * asinh) / math.asinh(asinh)
    return clamp(out, 0.0, 1.0)


def stretch(df: DataFrame, black: float, mid: float, white: float, asinh: float = 0.0) -> DataFrame:
    """B5, per channel."""
    require(white > black, "white must exceed black")
    finite("asinh", asinh, 0)
    return df.withColumn("value", stretch_value(F.col("value"), black, mid, white, asinh))


def stretch_color(df: DataFrame, black: float, mid: float, white: float, asinh: float = 0.0) -> DataFrame:
    """B5, colour-preserving: RGB scaled by the mapped luminance over the luminance above black."""
    require(white > black, "white must exceed black")
    wide = to_wide(df)
    l = luma(*[F.col(c) for c in RGB])
    wide = wide.withColumns({"_m": stretch_value(l, black, mid, white, asinh), "_s": l - black})
    ratio = F.try_divide(F.col("_m"), F.col("_s"))
    return to_long(wide.withColumns({c: F.when(F.col("_s") <= 1e-6, F.col("_m"))
                                     .otherwise(clamp((F.col(c) - black) * ratio, 0.0, 1.0)) for c in RGB}))


class HyperbolicCurve:
    """Generalised hyperbolic stretch as a column expression; its constants are folded on the driver."""

    def __init__(self, log_stretch: float, intensity: float, symmetry: float, low: float = 0.0, high: float = 1.0):
        finite("D", log_stretch, 0, 10)
        finite("b", intensity, -5, 15)
        require(0 <= low <= symmetry <= high <= 1, "0 <= LP <= SP <= HP <= 1 must hold")
        self.d, self.b, self.sp, self.lp, self.hp = math.expm1(log_stretch), intensity, symmetry, low, high
        if self.d == 0:
            return
        one = _Driver()
        self.q_low, self.q_high = self._signed(one, low), self._signed(one, high)
        self.s_low, self.s_high = self._slope(symmetry - low), self._slope(high - symmetry)
        self.q0 = self.q_low - low * self.s_low
        self.span = self.q_high + (1 - high) * self.s_high - self.q0
        require(self.span > 0 and math.isfinite(self.span), "the stretch is numerically degenerate")

    def _slope(self, t: float) -> float:
        if abs(self.b) < 1e-12:
            return self.d * math.exp(-self.d * t)
        power = -1 - 1 / self.b if self.b > 0 else 1 / self.b
        return self.d * math.exp(power * math.log1p(abs(self.b) * self.d * t))

    def _base(self, m, t):
        """Integral of the slope from the symmetry point, with functions from ``m``."""
        if abs(self.b) < 1e-12:
            return -m.expm1(t * -self.d)
        if self.b > 0:
            return -m.expm1(m.log1p(t * (self.b * self.d)) * (-1 / self.b))
        log = m.log1p(t * (-self.b * self.d))
        z = log * ((self.b + 1) / self.b)
        return m.expm1_over(z) * log * (-1 / self.b)

    def _signed(self, m, x: float) -> float:
        return -self._base(m, self.sp - x) if x < self.sp else self._base(m, x - self.sp)

    def column(self, x: Column) -> Column:
        if self.d == 0:
            return x
        middle = F.when(x < self.sp, -self._base(_Columns, F.greatest(F.lit(self.sp) - x, F.lit(0.0)))).otherwise(
            self._base(_Columns, F.greatest(x - self.sp, F.lit(0.0))))
        q = (F.when(x < self.lp, F.lit(self.q_low) + (x - self.lp) * self.s_low)
             .when(x > self.hp, F.lit(self.q_high) + (x - self.hp) * self.s_high).otherwise(middle))
        return F.when((x == 0) | (x == 1), x).otherwise(clamp((q - self.q0) / self.span, 0.0, 1.0))


class _Driver:
    expm1, log1p = staticmethod(math.expm1), staticmethod(math.log1p)

    @staticmethod
    def expm1_over(z: float) -> float:
        return 1.0 if z == 0 else math.expm1(z) / z


class _Columns:
    expm1, log1p = staticmethod(F.expm1), staticmethod(F.log1p)

    @staticmethod
    def expm1_over(z: Column) -> Column:
        return F.when(z == 0, 1.0).otherwise(F.try_divide(F.expm1(z), z))


def generalized_stretch(df: DataFrame, log_stretch: float, intensity: float, symmetry: float, low: float = 0.0,
                        high: float = 1.0, black: float = 0.0, white: float = 1.0) -> DataFrame:
    """Per channel; adds the normalised input and whether it lay outside the black/white range."""
    require(black < white, "black must be below white")
    curve = HyperbolicCurve(log_stretch, intensity, symmetry, low, high)
    v = F.col("value")
    norm = clamp((v - black) / (white - black), 0.0, 1.0)
    return df.withColumns({"normalized": norm, "below": v < black, "above": v > white, "value": curve.column(norm)})


def generalized_stretch_color(df: DataFrame, log_stretch: float, intensity: float, symmetry: float, low: float = 0.0,
                              high: float = 1.0, black: float = 0.0, white: float = 1.0) -> DataFrame:
    """B6, luminance mode: scale RGB by the mapped luminance, blended toward the per-channel curve to stay in gamut."""
    require(black < white, "black must be below white")
    curve = HyperbolicCurve(log_stretch, intensity, symmetry, low, high)
    wide = to_wide(df)
    wide = wide.withColumns({c: clamp((F.col(c) - black) / (white - black), 0.0, 1.0) for c in RGB})
    l = luma(*[F.col(c) for c in RGB])
    wide = wide.withColumns({"_f": F.try_divide(curve.column(l), l), **{f"_m{c}": curve.column(F.col(c)) for c in RGB}})
    limits = [F.when(F.col(c) * F.col("_f") > 1, F.try_divide(
        F.lit(1.0) - F.col(f"_m{c}"), F.col(c) * F.col("_f") - F.col(f"_m{c}"))).otherwise(1.0) for c in RGB]
    wide = wide.withColumn("_t", F.least(F.lit(1.0), *limits))
    mixed = lambda c: clamp(F.col("_t") * F.col(c) * F.col("_f") + (F.lit(1.0) - F.col("_t")) * F.col(f"_m{c}"), 0.0, 1.0)
    return to_long(wide.withColumns({c: F.coalesce(mixed(c), F.col(f"_m{c}")) for c in RGB}))


def stretch_report(df: DataFrame, bins: int = 256) -> tuple[DataFrame, DataFrame]:
    """Totals and the histograms before and after of a :func:`generalized_stretch` result."""
    totals = df.agg(F.count("value").alias("covered"), F.count(F.when(F.col("below"), 1)).alias("below"),
                    F.count(F.when(F.col("above"), 1)).alias("above"))
    index = lambda c: F.least(F.lit(bins - 1), F.floor(F.col(c) * bins)).cast("int")
    both = F.explode(F.array(F.struct(F.lit("before").alias("stage"), index("normalized").alias("bin")),
                             F.struct(F.lit("after").alias("stage"), index("value").alias("bin"))))
    counts = df.where(F.col("value").isNotNull()).select(both.alias("h")).groupBy("h.stage", "h.bin").agg(
        F.count(F.lit(1)).alias("samples"))
    return totals, counts


def tone_curve(df: DataFrame, points: list[tuple[float, float]], channel: int | None = None) -> DataFrame:
    """Limited cubic Hermite curve through the points, evaluated exactly; optionally one channel only."""
    require(len(points) >= 2 and all(a[0] < b[0] for a, b in zip(points, points[1:])), "points must ascend")
    slopes = [(b[1] - a[1]) / max(1e-6, b[0] - a[0]) for a, b in zip(points, points[1:])]

    def tangent(left: float, right: float) -> float:
        if left * right <= 0:
            return 0.0
        return math.copysign(min(abs(left + right) / 2, 3 * min(abs(left), abs(right))), left)

    tangents = [slopes[0], *[tangent(a, b) for a, b in zip(slopes, slopes[1:])], slopes[-1]]
    x = clamp(F.col("value"), 0.0, 1.0)
    out = F.when(x <= points[0][0], points[0][1])
    for i, (p, q) in enumerate(zip(points, points[1:])):
        span = q[0] - p[0]
        t = (x - p[0]) / span
        # The cubic on this segment in powers of t.
        m0, m1, rise = tangents[i] * span, tangents[i + 1] * span, q[1] - p[1]
        cubic = ((t * (m0 + m1 - 2 * rise) + (3 * rise - 2 * m0 - m1)) * t + m0) * t + p[1]
        out = out.when(x <= q[0], cubic)
    out = F.when(x.isNotNull(), clamp(out.otherwise(points[-1][1]), 0.0, 1.0))
    if channel is not None:
        out = F.when(F.col("channel") == channel, out).otherwise(F.col("value"))
    return df.withColumn("value", out)


def saturation(df: DataFrame, amount: float) -> DataFrame:
    """B8"""
    finite("amount", amount, -1, 2)
    wide = to_wide(df).withColumn("_l", luma(*[F.col(c) for c in RGB]))
    return to_long(wide.withColumns({c: clamp(F.col("_l") + (F.col(c) - F.col("_l")) * (1 + amount), 0.0, 1.0) for c in RGB}))


def suppress_green(df: DataFrame, amount: float, limit: float = 0.35, threshold: float = 0.0,
                   mode: str = "masked", preserve_lightness: bool = False) -> DataFrame:
    """Move excess green toward (R+B)/2; returns long rows with an ``affected`` flag per pixel."""
    finite("amount", amount, 0, 1)
    choice("mode", mode, ("masked", "average"))
    wide = to_wide(df)
    r, g, b = (F.col(c) for c in RGB)
    l, neutral = luma(r, g, b), (r + b) / 2
    excess = g - neutral
    if mode == "average":
        blend = F.lit(float(amount))
    else:
        dark = F.lit(1.0) - smoothstep(limit * 0.65, limit, l)
        blend = clamp(dark * clamp(excess / F.greatest(F.lit(0.03), l * 0.35), 0.0, 1.0) * amount, 0.0, 1.0)
    blend = F.when(excess > threshold, blend).otherwise(0.0)
    wide = wide.withColumn("_blend", blend).withColumn("affected", F.col("_blend") > 0)
    moved = clamp(g + (neutral - g) * F.col("_blend"), 0.0, 1.0)
    if not preserve_lightness:
        wide = wide.withColumn("g", F.when(F.col("affected"), moved).otherwise(g))
    else:
        wide = _keep_lightness(wide.withColumn("_g", moved))
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("channel"), F.col(c).alias("value")) for i, c in enumerate(RGB)]))
    return wide.select(*SPOT, "coverage", "affected", rows.alias("_s")).select(
        *SPOT, "_s.channel", "_s.value", "coverage", "affected")


def _keep_lightness(wide: DataFrame) -> DataFrame:
    """Rescale the moved colour to the linear luminance it had, softly held inside the gamut."""
    after = {"r": "r", "g": "_g", "b": "b"}
    wide = wide.withColumn("_y", luma(*[srgb_decode(F.col(c)) for c in RGB]))
    wide = wide.withColumns({f"_l{c}": srgb_decode(F.col(a)) for c, a in after.items()})
    wide = wide.withColumn("_z", luma(*[F.col(f"_l{c}") for c in RGB]))
    wide = wide.withColumns({f"_l{c}": F.when(F.col("_z") > 0, F.try_divide(F.col(f"_l{c}") * F.col("_y"), F.col("_z")))
                             .otherwise(F.col("_y")) for c in RGB})
    room = []
    for c in RGB:
        v, y = F.col(f"_l{c}"), F.col("_y")
        room += [F.when(v > y, F.try_divide(F.lit(1.0) - y, v - y)), F.when(v < y, F.try_divide(y, y - v))]
    wide = wide.withColumn("_k", soft_gamut_scale(F.coalesce(F.least(*room), F.lit(float("inf")))))
    return wide.withColumns({c: F.when(F.col("affected"), srgb_encode(clamp(
        F.col("_y") + F.col("_k") * (F.col(f"_l{c}") - F.col("_y")), 0.0, 1.0))).otherwise(F.col(c)) for c in RGB})


def neutralize_background(df: DataFrame, strength: float = 1.0, epsilon: float = 1.0e-6) -> DataFrame:
    """Scale each channel of a frame so that its median meets the mean of the three medians."""
    finite("strength", strength, 0, 1)
    rows = df.where(F.col("coverage") > MIN_COVERAGE)
    medians = quantiles(rows, ["frame_id", "channel"], "value", {"median": ("avg",)})
    target = medians.groupBy("frame_id").agg(F.avg("median").alias("target"))
    scales = medians.join(target, "frame_id").select(
        "frame_id", "channel",
        (F.lit(1.0) + (F.col("target") / F.greatest(F.lit(epsilon), F.col("median")) - 1) * strength).alias("_scale"))
    return join_keys(df, scales, ["frame_id", "channel"], "left").withColumn(
        "value", clamp(F.col("value") * F.col("_scale"), 0.0, 1.0)).drop("_scale")


#: Functions an expression may use, with their number of arguments.
EXPRESSION_FUNCTIONS = {"abs": 1, "sqrt": 1, "min": 2, "max": 2, "pow": 2}


def channel_expression(text: str, planes: dict[str, Column]) -> Column:
    """User arithmetic as a column. Every step is NULL if an operand is NULL or its result is not finite."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as error:
        raise ValueError(f"not an expression: {text}") from error

    def valid(c: Column) -> Column:
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)

    def apply(name: str, args: list[Column]) -> Column:
        if name in ("min", "max"):
            a, b = args
            first = a <= b if name == "min" else a >= b
            return F.when(first, a).when(a.isNotNull() & b.isNotNull(), b)
        return valid({"abs": F.abs, "sqrt": F.sqrt, "pow": F.pow}[name](*args))

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in planes:
            return planes[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.UAdd | ast.USub):
            return build(node.operand) if isinstance(node.op, ast.UAdd) else -build(node.operand)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add | ast.Sub | ast.Mult | ast.Div):
            a, b = build(node.left), build(node.right)
            return valid({ast.Add: a + b, ast.Sub: a - b, ast.Mult: a * b, ast.Div: F.try_divide(a, b)}[type(node.op)])
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and EXPRESSION_FUNCTIONS.get(node.func.id) == len(node.args) and not node.keywords:
            return apply(node.func.id, [build(x) for x in node.args])
        raise ValueError(f"not allowed in an expression: {ast.unparse(node)}")

    return build(tree)


def compose_channels(df: DataFrame, expressions: dict[str, str], planes: dict[str, int] | None = None) -> DataFrame:
    """User arithmetic over aligned planes (names -> channel index). A missing input, a division by
    zero or a non-finite result at any step makes the pixel invalid: value 0, validity 0."""
    planes = planes or {"A": 0, "B": 1, "C": 2}
    require(set(expressions) == {"R", "G", "B"}, "expressions for R, G and B are required")
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("value").cast("double")))
    named = {n: F.col(f"_p_{n}") for n in planes}
    out = {f"_{k}": channel_expression(v, named) for k, v in expressions.items()}
    wide = df.groupBy(*SPOT).agg(*[pick(c).alias(f"_p_{n}") for n, c in planes.items()]).withColumns(out)
    invalid = F.col("_R").isNull() | F.col("_G").isNull() | F.col("_B").isNull()
    return wide.withColumn("_bad", invalid).select(
        *SPOT, *[F.when(F.col("_bad"), 0.0).otherwise(F.col(f"_{k}")).alias(k.lower()) for k in ("R", "G", "B")],
        F.when(F.col("_bad"), 0).otherwise(1).alias("validity"))


def compose_two_line(df: DataFrame, fraction: float, h_channel: int = 0, o_channel: int = 1) -> DataFrame:
    """R = H, G = f*H + (1-f)*O, B = O; the pixel is invalid if either line is missing."""
    finite("fraction", fraction, 0, 1)
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("value")))
    wide = df.groupBy(*SPOT).agg(pick(h_channel).alias("_h"), pick(o_channel).alias("_o"))
    ok = F.col("_h").isNotNull() & F.col("_o").isNotNull()
    green = F.col("_h") * fraction + F.col("_o") * (1 - fraction)
    value = lambda c: F.when(ok, c).otherwise(0.0)
    return wide.select(*SPOT, value(F.col("_h")).alias("r"), value(green).alias("g"), value(F.col("_o")).alias("b"),
                       ok.cast("int").alias("validity"))


def apply_gains(df: DataFrame, gains: tuple[float, float, float], valid: bool = True) -> DataFrame:
    """Multiply each channel by its validated gain; signed values stay signed."""
    require(valid, "the colour fit did not pass its held-out validation")
    for g in gains:
        finite("gain", g, 0.05, 20)
    gain = F.element_at(F.array(*[F.lit(float(g)) for g in gains]), F.col("channel") + 1)
    return df.withColumn("value", F.when(F.col("coverage") > 0, F.col("value") * gain).otherwise(F.col("value")))


def histogram(df: DataFrame, bins: int = 256, keys: list[str] = ["frame_id"]) -> DataFrame:
    """Coverage-weighted histogram of luminance rows on [0, 1] per frame."""
    require(1 <= bins <= 1 << 20, "bins must be within 1..1048576")
    v = clamp(F.col("value"), 0.0, 1.0)
    rows = df.where((F.col("coverage") > MIN_COVERAGE) & F.col("value").isNotNull())
    return rows.groupBy(*keys, F.least(F.lit(bins - 1), F.floor(v * bins)).cast("int").alias("bin")).agg(
        F.sum(clamp(F.col("coverage"), 0.0, 1.0)).alias("weight"))


def histogram_summary(df: DataFrame, keys: list[str] = ["frame_id"]) -> DataFrame:
    """Minimum, maximum and weighted mean of the clamped values."""
    v, w = clamp(F.col("value"), 0.0, 1.0), clamp(F.col("coverage"), 0.0, 1.0)
    rows = df.where((F.col("coverage") > MIN_COVERAGE) & F.col("value").isNotNull())
    return rows.groupBy(*keys).agg(F.min(v).alias("minimum"), F.max(v).alias("maximum"),
                                   (F.sum(v * w) / F.sum(w)).alias("mean"))


def auto_stretch_params(df: DataFrame, keys: list[str] = ["frame_id"], clip: float = 0.998, shadows: float = 2.8,
                        target: float = 0.25) -> DataFrame:
    """Black, mid and white point per frame from background, scatter and a high rank (fully covered rows)."""
    finite("clip", clip, 0, 1)
    rows = df.where(F.col("value").isNotNull() & (F.col("coverage") > MIN_COVERAGE))
    centre = quantiles(rows, keys, "value", {"background": ("avg",), "white": ("rank", clip)})
    spread = join_keys(rows, centre.select(*keys, "background"), keys).withColumn("_d", F.abs(F.col("value") - F.col("background")))
    mad = quantiles(spread, keys, "_d", {"mad": ("avg",)})
    ends = rows.groupBy(*keys).agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    t = join_keys(join_keys(centre, mad, keys), ends, keys)
    bg = F.col("background")
    span = F.greatest(F.lit(1.0), F.abs(bg), F.abs("minimum"), F.abs("maximum")) * 1e-6
    t = t.withColumns({"_black": F.greatest(F.col("minimum"), bg - F.col("mad") * 1.4826 * shadows), "_span": span})
    flat = F.col("white") - F.col("_black") <= F.col("_span")
    t = t.withColumns({"black": F.when(flat, bg - F.col("_span")).otherwise(F.col("_black")),
                       "white": F.when(flat, bg + F.col("_span")).otherwise(F.col("white"))})
    level = clamp((bg - F.col("black")) / (F.col("white") - F.col("black")), 0.001, 0.999)
    gamma = F.lit(math.log(min(0.999, max(0.001, target)))) / F.log(level)
    return t.withColumn("mid", clamp(F.pow(F.lit(0.5), F.lit(1.0) / gamma), 0.001, 0.999)).select(
        *keys, "background", (F.col("mad") * 1.4826).alias("scatter"), "black", "mid", "white")

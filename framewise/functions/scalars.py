"""Scalar column functions (H1-H18). All are built from Spark expressions, so they stay in codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import require

#: Luminance weights of the R, G and B channel.
LUMA = (0.2126, 0.7152, 0.0722)


def clamp(c: Column, low: float | Column, high: float | Column) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(c.isNotNull(), F.greatest(as_col(low), F.least(as_col(high), c)))


def number(c: Column) -> Column:
    return c.try_cast("double")


def sexagesimal(text: Column, is_ra: bool) -> Column:
    """H1: ``h:m:s`` to degrees; NULL when malformed or out of range. The sign of ``-00`` counts."""
    parts = F.split(text, ":")
    h, m, s = (number(F.trim(F.get(parts, i))) for i in range(3))
    first = F.abs(h)
    in_range = (F.size(parts) == 3) & (m >= 0) & (m < 60) & (s >= 0) & (s <= 60)
    in_range = in_range & ((h >= 0) & (h < 24) if is_ra else first <= 90)
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    value = (first + m / 60 + s / 3600) * (15 if is_ra else 1) * sign
    bound = (value >= 0) & (value < 360) if is_ra else F.abs(value) <= 90
    return F.when(in_range & bound, value)


def display_id(text: Column) -> Column:
    """H2: ``NGC0031`` -> ``NGC 31``; identifiers of other catalogs stay as they are."""
    pattern = r"^(NGC|IC|M)(\d.*)$"
    rest = F.regexp_replace(F.regexp_extract(text, pattern, 2), "^0+", "")
    rest = F.when(rest == "", "0").otherwise(rest)
    return F.when(text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), F.lit(" "), rest)).otherwise(text)


def search_key(text: Column) -> Column:
    """H2: lower case without spaces, dashes and underscores."""
    return F.lower(F.regexp_replace(text, r"[\s\-_]", ""))


def utc_date(text: Column, time_system: Column | None = None) -> Column:
    """H3: the date of a strict ISO timestamp in UTC, or NULL. A leap second only as 23:59:60."""
    shape = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?)?$"
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    part = lambda at: number(F.substring(text, at, 2))
    h, m, s = part(12), part(15), part(18)
    clock = (F.length(text) == 10) | ((h <= 23) & (m <= 59) & ((s < 60) | ((s == 60) & (h == 23) & (m == 59))))
    ok = text.rlike(shape) & (number(F.substring(text, 1, 4)) >= 1972) & clock
    if time_system is not None:
        ok = ok & (time_system.isNull() | (time_system == "UTC"))
    return F.when(ok, day)


def julian_year(ts: Column) -> Column:
    """H4: Julian year of a UTC timestamp (2000.0 at 2000-01-01T12:00)."""
    epoch = 946728000 * 1_000_000
    return F.lit(2000.0) + (F.unix_micros(ts.cast("timestamp")) - F.lit(epoch)) / F.lit(365.25 * 86400 * 1_000_000)


def frame_type(text: Column) -> Column:
    """H5: light / dark / flat / bias / dark-flat, or an empty string."""
    s = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    s = F.regexp_replace(F.regexp_replace(s, "^MASTER", ""), "FRAME$", "")
    return (F.when(s.isin("DARKFLAT", "FLATDARK"), "dark-flat").when(s == "LIGHT", "light").when(s == "DARK", "dark")
            .when(s == "FLAT", "flat").when(s.isin("BIAS", "OFFSET"), "bias").otherwise(""))


def angular_separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """H6: haversine distance in degrees."""
    x = F.sin(F.radians(dec1 - dec2) / 2)
    y = F.sin(F.radians(ra1 - ra2) / 2)
    inner = x * x + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * y * y
    return F.degrees(2 * F.asin(F.sqrt(clamp(inner, 0.0, 1.0))))


def bayer_phase(x: Column, y: Column, x0: int = 0, y0: int = 0) -> Column:
    """H7: sensor phase 0..3 of a pixel."""
    return (F.pmod(y + y0, F.lit(2)) * 2 + F.pmod(x + x0, F.lit(2))).cast("int")


def bayer_color(pattern: str, x: Column, y: Column, x0: int = 0, y0: int = 0) -> Column:
    """H7: 0/1/2 for R/G/B under a four-letter pattern such as RGGB."""
    require(len(pattern) == 4 and set(pattern) <= set("RGB"), "pattern must be four letters of R, G, B")
    colors = F.array(*[F.lit("RGB".index(p)) for p in pattern])
    return F.element_at(colors, bayer_phase(x, y, x0, y0) + 1)


def srgb_encode(v: Column) -> Column:
    """H8"""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.lit(1.055) * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def srgb_decode(v: Column) -> Column:
    """H8"""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((F.greatest(v, F.lit(-0.055)) + 0.055) / 1.055, F.lit(2.4)))


def soft_gamut_scale(available: Column) -> Column:
    """H8: scale toward the gamut boundary, 1 when it is far away, with a knee at 80 % of the distance."""
    knee, shoulder = available * 0.8, available * 0.2
    bent = knee + F.try_divide(shoulder * (F.lit(1.0) - knee), shoulder + 1 - knee)
    return F.when(available >= 1.25, 1.0).otherwise(bent)


def grid_cell(coordinate: Column, length: int | Column, cells: int) -> Column:
    """H9: index of the grid cell that holds an integer coordinate (edges at ``floor(g*length/cells)``)."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.least(F.lit(cells - 1), F.floor(((coordinate + 1) * cells - 1) / length)).cast("int")


def region16(x: Column, y: Column, width: float, height: float) -> Column:
    """H9: one of 4x4 image regions."""
    part = lambda v, n: clamp(F.floor(v * 4 / n), 0, 3)
    return (part(y, float(height)) * 4 + part(x, float(width))).cast("int")


def smoothstep(e0: float, e1: float, x: Column) -> Column:
    """H10"""
    t = clamp((x - e0) / (e1 - e0), 0.0, 1.0)
    return t * t * (F.lit(3.0) - t * 2)


def feather_weight(x: Column, y: Column, width: int, height: int, share: float = 0.08) -> Column:
    """Distance to the nearest edge over a share of the short side, at most 1, floor 1e-4."""
    edge = F.least(x + 1, y + 1, F.lit(width) - x, F.lit(height) - y).cast("double")
    return clamp(edge / max(1.0, min(width, height) * share), 1.0e-4, 1.0)


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(zero)


def angle_delta(a: Column, b: Column) -> Column:
    """Difference of two undirected line angles, 0..pi/2."""
    d = F.pmod(F.abs(a - b), F.lit(math.pi))
    return F.least(d, F.lit(math.pi) - d)


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length shared by two intervals given by unordered ends."""
    return F.greatest(F.lit(0.0), F.least(F.greatest(a0, a1), F.greatest(b0, b1))
                      - F.greatest(F.least(a0, a1), F.least(b0, b1)))


def moments_to_shape(xx: Column, yy: Column, xy: Column, factor: float = 2.35482) -> dict[str, Column]:
    """FWHM, axes, eccentricity and angle of second moments."""
    half = (xx + yy) / 2
    root = F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    major, minor = F.greatest(half + root, F.lit(0.0)), F.greatest(half - root, F.lit(0.0))
    return {
        "fwhm": F.lit(factor) * F.sqrt(F.greatest(half, F.lit(0.0))),
        "major": F.lit(factor) * F.sqrt(major), "minor": F.lit(factor) * F.sqrt(minor),
        "eccentricity": F.when(major > 1e-12, F.sqrt(clamp(F.lit(1.0) - minor / F.greatest(major, F.lit(1e-12)), 0.0, 1.0))).otherwise(0.0),
        "angle": F.degrees(F.atan2(2 * xy, xx - yy) / 2),
    }


def ellipse_known(major: Column, minor: Column, angle: Column) -> Column:
    """Whether H15 has a ring: both axes, and an angle unless it is a circle."""
    return (major > 0) & (minor > 0) & (angle.isNotNull() | (F.abs(major - minor) <= 1e-9))


def celestial_ellipse(ra: Column, dec: Column, major: Column, minor: Column, angle: Column, samples: int = 64) -> Column:
    """Closed ring of ``samples + 1`` sky points; NULL when the shape is unknown. Axes in arcminutes."""
    require(16 <= samples <= 4096, "samples must be within 16..4096")
    known = ellipse_known(major, minor, angle)
    a, d, pa = F.radians(ra), F.radians(dec), F.radians(F.coalesce(angle, F.lit(0.0)))

    # Three small steps per point: what a lambda binds is computed once.
    def offset(i: Column) -> Column:
        t = i * (2 * math.pi / samples)
        u, v = major / 120 * F.cos(t), minor / 120 * F.sin(t)
        return F.struct(F.radians(u * F.sin(pa) + v * F.cos(pa)).alias("e"), F.radians(u * F.cos(pa) - v * F.sin(pa)).alias("n"))

    def arc(p: Column) -> Column:
        rho = F.hypot(p["e"], p["n"])
        return F.struct(p["e"].alias("e"), p["n"].alias("n"), F.cos(rho).alias("c"),
                        F.when(rho > 0, F.try_divide(F.sin(rho), rho)).otherwise(1.0).alias("f"))

    def vector(p: Column) -> Column:
        e, n, c = p["e"] * p["f"], p["n"] * p["f"], p["c"]
        return F.struct((c * F.cos(d) * F.cos(a) - e * F.sin(a) - n * F.sin(d) * F.cos(a)).alias("x"),
                        (c * F.cos(d) * F.sin(a) + e * F.cos(a) - n * F.sin(d) * F.sin(a)).alias("y"),
                        (c * F.sin(d) + n * F.cos(d)).alias("z"))

    def place(p: Column) -> Column:
        return F.struct(F.pmod(F.degrees(F.atan2(p["y"], p["x"])), F.lit(360.0)).alias("ra"),
                        F.degrees(F.atan2(p["z"], F.hypot(p["x"], p["y"]))).alias("dec"))

    ring = F.sequence(F.lit(0), F.lit(samples))
    for step in (offset, arc, vector, place):
        ring = F.transform(ring, step)
    return F.when(known, ring)


def point_in_polygon(points: Column, x: Column | float, y: Column | float) -> Column:
    """Even-odd test of a closed ring ``array<struct<x,y>>``; open or short rings contain nothing."""
    x = x if isinstance(x, Column) else F.lit(float(x))
    y = y if isinstance(y, Column) else F.lit(float(y))
    n = F.size(points)
    first, last = F.get(points, F.lit(0)), F.get(points, n - 1)
    closed = (n >= 4) & (F.hypot(first["x"] - last["x"], first["y"] - last["y"]) <= 1e-5)
    edges = F.arrays_zip(F.slice(points, 1, F.greatest(n - 1, F.lit(0))).alias("a"),
                         F.slice(points, 2, F.greatest(n - 1, F.lit(0))).alias("b"))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return F.when(spans & (x < at), 1).otherwise(0)

    count = F.aggregate(F.transform(edges, crosses), F.lit(0), lambda acc, v: acc + v)
    return F.when(points.isNotNull(), closed & (count % 2 == 1)).otherwise(False)


#: Object types of each category; anything else is "other".
CATEGORIES = {
    "galaxies": ["G", "GPair", "GTrpl", "GGroup"],
    "clusters": ["OCl", "GCl", "*Ass"],
    "nebulae": ["PN", "HII", "DrkN", "EmN", "Neb", "RfN", "SNR", "Cl+N"],
}


def category(kind: Column, categories: dict[str, list[str]] | None = None) -> Column:
    """H17"""
    out = None
    for name, kinds in (categories or CATEGORIES).items():
        hit = kind.isin(kinds)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


#: Nanometres per wavelength unit.
WAVELENGTH_UNITS = {"nm": 1.0, "angstrom": 0.1, "angstroms": 0.1, "micron": 1000.0, "um": 1000.0, "m": 1.0e9}


def wavelength_nm(value: Column, unit: Column) -> Column:
    """Wavelength in nanometres, NULL for an unknown unit."""
    out = None
    for name, factor in WAVELENGTH_UNITS.items():
        hit = F.lower(unit) == name
        out = F.when(hit, value * factor) if out is None else out.when(hit, value * factor)
    return out


def response_value(value: Column, full_range: Column) -> Column:
    """Response as a fraction of the declared range."""
    return F.try_divide(value, full_range)


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]

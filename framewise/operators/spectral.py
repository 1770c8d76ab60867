"""Spectra against response curves, and colour gains with held-out validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import region16
from ..schema import finite, require, require_columns
from ..session import cut_lineage
from .match import greedy_separation
from .stats import join_keys, quantiles, row_numbers

#: Positive nodes and weights of the 8-point Gauss-Legendre rule.
NODES = (0.18343464249564980494, 0.52553240991632898582, 0.79666647741362673959, 0.96028985649753623168)
WEIGHTS = (0.36268378337836198297, 0.31370664587788728734, 0.22238103445337447054, 0.10122853629037625915)

Curve = list[tuple[float, float]]


def response_pieces(bands: dict[str, list[Curve]]) -> list[tuple]:
    """Bands cut at all knots of their components: (band, low, high, band_low, band_high, [slope], [intercept]).
    Responses are instrument constants given as arguments; at most eight components of 100000 points."""
    pieces = []
    for band, curves in bands.items():
        require(1 <= len(curves) <= 8, "a band has 1..8 response components")
        for c in curves:
            require(2 <= len(c) <= 100000 and all(p[0] < q[0] for p, q in zip(c, c[1:])), "response wavelengths must ascend")
            require(all(0 <= v <= 1 for _, v in c), "responses must be within 0..1")
        low, high = max(c[0][0] for c in curves), min(c[-1][0] for c in curves)
        require(low < high, "response components do not overlap")
        knots = sorted({low, high, *[w for c in curves for w, _ in c if low < w < high]})
        at = [0] * len(curves)
        for a, b in zip(knots, knots[1:]):
            slopes, bases = [], []
            for i, c in enumerate(curves):
                while c[at[i] + 1][0] <= a:
                    at[i] += 1
                (w0, v0), (w1, v1) = c[at[i]], c[at[i] + 1]
                slope = (v1 - v0) / (w1 - w0)
                slopes.append(slope)
                bases.append(v0 - slope * w0)
            pieces.append((band, float(a), float(b), float(low), float(high), slopes, bases))
    return pieces


def _integral(lo: Column, hi: Column, f) -> Column:
    """Gauss-Legendre sum of ``f(lambda)`` over one interval, written out so that it compiles to straight code."""
    mid, half = (hi + lo) / 2, (hi - lo) / 2
    total = F.lit(0.0)
    for x, w in zip(NODES, WEIGHTS):
        for sign in (-1.0, 1.0):
            total = total + f(mid + half * (sign * x)) * w
    return total * half


def synthetic_flux(spectra: DataFrame, bands: dict[str, list[Curve]], cell: float = 20.0) -> DataFrame:
    """Photon-weighted flux of every spectrum in every band, with error bound, mean wavelength and RMS width.

    Neighbouring samples form segments; segments meet the response pieces they overlap through wavelength cells
    (an equi-join with the small piece table) and are integrated exactly. A spectrum that does not cover the whole
    response gets status ``not-covered`` and no number."""
    require_columns(spectra, ["source_id", "wavelength", "flux", "error"], "spectra")
    finite("cell", cell, 1e-6)
    spark = spectra.sparkSession
    pieces = spark.createDataFrame(response_pieces(bands), "band string, plo double, phi double, blo double, bhi double, "
                                   "slopes array<double>, bases array<double>")
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    # Bounded by the arguments: 8 components x 100000 points per band.
    by_cell = pieces.withColumn("_cell", F.explode(cells(F.col("plo"), F.col("phi"))))
    nxt = Window.partitionBy("source_id").orderBy("wavelength")
    seg = spectra.select("source_id", F.col("wavelength").alias("w0"), F.col("flux").alias("f0"), F.col("error").alias("e0"),
                         *[F.lead(c).over(nxt).alias(n) for c, n in (("wavelength", "w1"), ("flux", "f1"), ("error", "e1"))])
    seg = seg.where("w1 is not null").withColumn("_cell", F.explode(cells(F.col("w0"), F.col("w1"))))
    both = seg.join(by_cell, "_cell").withColumns({"lo": F.greatest("w0", "plo"), "hi": F.least("w1", "phi")})
    # An overlap belongs to the cell of its lower end only, so it counts once.
    both = both.where((F.col("lo") < F.col("hi")) & (F.floor(F.col("lo") / cell) == F.col("_cell")))
    response = lambda l: F.aggregate(F.zip_with("slopes", "bases", lambda s, b: s * l + b), F.lit(1.0), lambda p, v: p * v)
    line = lambda y0, y1, l: F.col(y0) + (F.col(y1) - F.col(y0)) * (l - F.col("w0")) / (F.col("w1") - F.col("w0"))
    lo, hi = F.col("lo"), F.col("hi")
    sums = both.groupBy("source_id", "band").agg(
        F.sum(_integral(lo, hi, response)).alias("_area"),
        F.sum(_integral(lo, hi, lambda l: response(l) * l)).alias("_first"),
        F.sum(_integral(lo, hi, lambda l: response(l) * l * l)).alias("_second"),
        F.sum(_integral(lo, hi, lambda l: response(l) * l * line("f0", "f1", l))).alias("_flux"),
        F.sum(_integral(lo, hi, lambda l: response(l) * l * line("e0", "e1", l))).alias("_error"))
    ends = spectra.groupBy("source_id").agg(F.min("wavelength").alias("_lo"), F.max("wavelength").alias("_hi"))
    # One row per band, the width of every spectrum against every band: a fixed factor.
    full = ends.withColumn("_band", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(float(lo)).alias("blo"), F.lit(float(hi)).alias("bhi"))
                                                        for b, lo, hi in {(p[0], p[3], p[4]) for p in response_pieces(bands)}])))
    full = full.select("source_id", "_lo", "_hi", "_band.*")
    t = full.join(sums, ["source_id", "band"], "left")
    ok = (F.col("_lo") <= F.col("blo")) & (F.col("_hi") >= F.col("bhi")) & (F.col("_area") > 0)
    mean = F.col("_first") / F.col("_area")
    value = lambda c: F.when(ok, c)
    return t.select("source_id", "band", F.when(ok, "integrated").otherwise("not-covered").alias("status"),
                    value(F.col("_flux")).alias("flux"), value(F.col("_error")).alias("error_bound"), value(mean).alias("mean_wavelength"),
                    value(F.sqrt(F.greatest(F.lit(0.0), F.col("_second") / F.col("_area") - mean * mean))).alias("rms_width"))


def spectrum_knots(spectra: DataFrame, bands: dict[str, list[Curve]]) -> DataFrame:
    """Distinct union of spectrum samples and response knots inside each band, per source."""
    spark = spectra.sparkSession
    pieces = response_pieces(bands)
    spans = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(lo).alias("blo"), F.lit(hi).alias("bhi")) for b, lo, hi in sorted({(p[0], p[3], p[4]) for p in pieces})])
    own = spectra.select("source_id", "wavelength", F.explode(spans).alias("s")).where(
        (F.col("wavelength") > F.col("s.blo")) & (F.col("wavelength") < F.col("s.bhi"))).select("source_id", "s.band", "wavelength")
    shared = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(w).alias("wavelength")) for b, w in sorted({(p[0], e) for p in pieces for e in p[1:3]})])
    theirs = spectra.select("source_id").distinct().select("source_id", F.explode(shared).alias("k")).select("source_id", "k.band", "k.wavelength")
    return own.union(theirs).distinct()


def narrowband_window(center: float, width: float) -> Curve:
    """Response curve of a narrow filter: flat with edges of 1e-4 of its width."""
    finite("width", width, 1e-9)
    low, high, edge = center - width / 2, center + width / 2, width * 1e-4
    return [(low, 0.0), (low + edge, 1.0), (high - edge, 1.0), (high, 0.0)]


def join_spectra(candidates: DataFrame, spectra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with motion and spectrum, the others with the reason)."""
    require_columns(candidates, ["source_id", "pmra", "pmdec"], "candidates")
    still = F.col("pmra").isNull() | F.col("pmdec").isNull()
    fast = F.hypot("pmra", "pmdec") > 20000
    ids = spectra.select("source_id").distinct()
    good = candidates.where(~still & ~fast)
    skipped = candidates.where(still).select("source_id", F.lit("proper-motion-missing").alias("reason")).unionByName(
        candidates.where(~still & fast).select("source_id", F.lit("proper-motion-outside-query-margin").alias("reason"))).unionByName(
        good.join(ids, "source_id", "left_anti").select("source_id", F.lit("spectrum-missing").alias("reason")))
    return good.join(ids, "source_id", "left_semi"), skipped


CHANNELS = ("r", "g", "b")


def _long_gains(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, "held", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"g_{c}").alias("v")) for c in CHANNELS])).alias("e")).select(
        *keys, "held", "e.c", "e.v")


def _wide(table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(*[F.max(F.when(F.col("c") == c, F.col(n))).alias(f"{n}_{c}") for n in columns for c in CHANNELS])


def fit_color_gains(stars: DataFrame, white: tuple[float, float, float], width: float, height: float, limit: float = 0.2,
                    keys: list[str] = ["frame_id"], id_col: str = "star_id") -> tuple[DataFrame, DataFrame]:
    """(gains and verdict per key, status and residuals per star).

    Every fifth star in (y, x, id) order is held out. Fitting stars beyond 4.685 robust sigmas of the median log
    ratio are rejected; the rest set the gains, the held-out stars judge them."""
    require(all(w > 0 for w in white), "white reference must be positive")
    finite("limit", limit, 1e-9, 1)
    need = [*keys, id_col, "x", "y", *[f"{k}_{c}" for k in ("observed", "predicted") for c in CHANNELS]]
    require_columns(stars, need, "stars")
    log = lambda c: F.ln(f"predicted_{c}") - F.ln("predicted_g") - F.ln(f"observed_{c}") + F.ln("observed_g")
    rows = row_numbers(stars.select(*need), keys, [F.col("y"), F.col("x"), F.col(id_col)], F.col("y"), "_row")
    # One row per star, read by every statistic below: written once.
    rows = cut_lineage(rows.withColumns({"held": (F.col("_row") - 1) % 5 == 4, **{f"g_{c}": log(c) for c in CHANNELS}}))
    ck = [*keys, "c"]

    def centre_and_scatter(part: DataFrame, tag: str) -> DataFrame:
        mid = quantiles(part, ck, "v", {f"mid{tag}": ("lin", 0.5)})
        dev = join_keys(part, mid, ck).withColumn("_d", F.abs(F.col("v") - F.col(f"mid{tag}")))
        mad = quantiles(dev, ck, "_d", {f"mad{tag}": ("lin", 0.5)})
        return _wide(join_keys(mid, mad, ck).withColumn(f"mad{tag}", F.col(f"mad{tag}") * 1.4826), keys, [f"mid{tag}", f"mad{tag}"])

    first = centre_and_scatter(_long_gains(rows.where(~F.col("held")), keys), "0")
    rows = join_keys(rows, first, keys, "left")
    off = lambda c: F.abs(F.col(f"g_{c}") - F.col(f"mid0_{c}")) > F.greatest(F.lit(0.005), F.col(f"mad0_{c}")) * 4.685
    rows = rows.withColumn("status", F.when(F.col("held"), "validation").when(off("r") | off("b"), "fit-outlier").otherwise("fit"))
    rows = cut_lineage(rows)
    final = cut_lineage(centre_and_scatter(_long_gains(rows.where(F.col("status") == "fit"), keys), "1"))
    rows = join_keys(rows.drop(*[f"{n}0_{c}" for n in ("mid", "mad") for c in CHANNELS]), final, keys, "left")
    rows = rows.withColumns({f"residual_{c}": F.col(f"mid1_{c}") - F.col(f"g_{c}") for c in CHANNELS})
    held = rows.where("held").select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(f"residual_{c}").alias("v")) for c in CHANNELS])).alias("e")).select(*keys, "e.c", "e.v")
    check = join_keys(quantiles(held, ck, "v", {"validation_median": ("lin", 0.5)}),
                      quantiles(held.withColumn("a", F.abs("v")), ck, "a", {"validation_p90": ("lin", 0.9)}), ck)
    check = _wide(check, keys, ["validation_median", "validation_p90"])
    counts = rows.groupBy(*keys).agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(n) for s, n in (("fit", "training"), ("fit-outlier", "rejected"), ("validation", "validation"))],
        F.countDistinct(F.when(F.col("held"), region16(F.col("x"), F.col("y"), width, height))).alias("regions"))
    t = join_keys(join_keys(counts, final, keys, "left"), check, keys, "left")
    gain = lambda c, w: F.exp(f"mid1_{c}") / (w / white[1])
    t = t.withColumns({f"gain_{c}": gain(c, w) for c, w in zip(CHANNELS, white)})
    in_range = F.lit(True)
    for c in CHANNELS:
        in_range = in_range & F.col(f"gain_{c}").between(0.05, 20)
    reason = (F.when((F.col("training") + F.col("rejected") < 12) | (F.col("validation") < 6), "too-few-stars")
              .when(F.col("training") < 12, "too-few-robust-stars").when(~in_range, "gain-out-of-range")
              .when(F.col("regions") < 4, "too-few-regions")
              .when(F.greatest("validation_p90_r", "validation_p90_b") > limit, "inconsistent-colors"))
    fit = t.select(*keys, "training", "rejected", "validation", "regions", *[f"gain_{c}" for c in CHANNELS],
                   *[F.col(f"mad1_{c}").alias(f"scatter_{c}") for c in CHANNELS],
                   *[f"validation_median_{c}" for c in CHANNELS], *[f"validation_p90_{c}" for c in CHANNELS],
                   reason.alias("reason"), reason.isNull().alias("valid"))
    return fit, rows.select(*keys, id_col, "status", *[f"residual_{c}" for c in CHANNELS])


def reference_color_gains(pairs: DataFrame, separation: float = 32.0, minimum: int = 12, keys: list[str] = ["frame_id"],
                          id_col: str = "star_id") -> DataFrame:
    """Gains of an image against a reference image from matched stars.

    Pairs: positions in both images (``x y ref_x ref_y``) and fluxes ``input_* reference_*``. In (y, x) order, a pair
    closer than ``separation`` to an accepted one in either image is dropped; accepted pairs alternate between
    training and validation."""
    finite("separation", separation, 0)
    positive = F.lit(True)
    for c in CHANNELS:
        positive = positive & (F.col(f"input_{c}") > 0) & (F.col(f"reference_{c}") > 0)
    order = [F.col("y"), F.col("x"), F.col(id_col)]
    kept = greedy_separation(pairs.where(positive), separation, keys, id_col, order, F.col("y"), [("x", "y"), ("ref_x", "ref_y")])
    rows = row_numbers(kept, keys, order, F.col("y"), "_row").withColumn("held", F.col("_row") % 2 == 0)
    log = lambda c: F.ln(F.col(f"reference_{c}") / F.col("reference_g")) - F.ln(F.col(f"input_{c}") / F.col("input_g"))
    rows = _long_gains(rows.withColumns({f"g_{c}": log(c) for c in CHANNELS}), keys)
    ck = [*keys, "c"]
    mid = quantiles(rows.where(~F.col("held")), ck, "v", {"mid": ("lin", 0.5)})
    res = join_keys(rows.where("held"), mid, ck).select(*ck, (F.col("mid") - F.col("v")).alias("r"))
    check = join_keys(quantiles(res, ck, "r", {"error_median": ("lin", 0.5)}),
                      quantiles(res.withColumn("a", F.abs("r")), ck, "a", {"error_p90": ("lin", 0.9)}), ck)
    t = _wide(join_keys(mid, check, ck, "left"), keys, ["mid", "error_median", "error_p90"])
    counts = rows.where("c = 'g'").groupBy(*keys).agg(F.count(F.when(~F.col("held"), 1)).alias("training"), F.count(F.when(F.col("held"), 1)).alias("validation"))
    t = join_keys(counts, t, keys, "left")
    bad = F.lit(False)
    for c in CHANNELS:
        bad = bad | ~F.exp(f"mid_{c}").between(0.05, 20)
    status = (F.when((F.col("training") < minimum) | (F.col("validation") < minimum), "insufficient-stars").when(bad, "invalid-gain")
              .when(F.greatest("error_p90_r", "error_p90_b") > 0.2, "inconsistent").otherwise("fitted"))
    return t.select(*keys, "training", "validation", *[F.exp(f"mid_{c}").alias(f"gain_{c}") for c in CHANNELS],
                    *[f"error_median_{c}" for c in CHANNELS], *[f"error_p90_{c}" for c in CHANNELS], status.alias("status"))

"""Matching point catalogs by position, by votes and by neighbourhood shape."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import finite, require, require_columns
from ..session import cut_lineage
from .stats import join_keys, quantiles, row_numbers

#: Parts into which C5 deals the moving stars of a key.
VOTE_PARTS = 8
#: Conflicts written as edges: at most so many, or so many per point; neighbours are counted anew every ``LOOK`` rounds. Points kept in
#: a round that are broadcast. Cells of half a radius over which points may conflict.
FEW_EDGES, EDGES_PER_POINT, LOOK, WINNERS, REACH = 1_000_000, 8, 8, 20_000, 2


def near_pairs(left: DataFrame, right: DataFrame, radius: float, keys: list[str], left_cols: list[str],
               right_cols: list[str], lx: str = "x", ly: str = "y", rx: str = "x", ry: str = "y") -> DataFrame:
    """Pairs within ``radius`` under equal ``keys``: columns ``l_*``, ``r_*`` and squared distance ``d2``.

    The left side is copied to the 3x3 grid cells around it and met in an equi-join, so only points of
    neighbouring cells are ever compared; a crowded cell is split by the skew join of adaptive execution."""
    finite("radius", radius, 0)
    size = max(radius, 1e-9)
    cell = lambda c: F.floor(F.col(c) / size)
    around = F.explode(F.array(*[F.struct((cell(lx) + dx).alias("cx"), (cell(ly) + dy).alias("cy"))
                                 for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    l = left.select(*keys, F.col(lx).alias("_lx"), F.col(ly).alias("_ly"), *[F.col(c).alias(f"l_{c}") for c in left_cols], around.alias("_c"))
    l = l.withColumns({"_cx": F.col("_c.cx"), "_cy": F.col("_c.cy")}).drop("_c")
    r = right.select(*keys, F.col(rx).alias("_rx"), F.col(ry).alias("_ry"), *[F.col(c).alias(f"r_{c}") for c in right_cols],
                     cell(rx).alias("_cx"), cell(ry).alias("_cy"))
    d2 = (F.col("_lx") - F.col("_rx")) * (F.col("_lx") - F.col("_rx")) + (F.col("_ly") - F.col("_ry")) * (F.col("_ly") - F.col("_ry"))
    return l.join(r, [*keys, "_cx", "_cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop(
        "_cx", "_cy", "_lx", "_ly", "_rx", "_ry")


def neighbor_count(df: DataFrame, other: DataFrame, radius: float, keys: list[str] = ["frame_id"], id_col: str = "star_id") -> DataFrame:
    """Points of ``other`` within ``radius`` of each point.

    Cells have the diagonal ``radius``: everything in a point's own cell counts by the cell's total, so a
    crowded cell never pairs with itself. Only the 24 cells around it are compared point by point, and equal
    positions of ``other`` are merged before that."""
    finite("radius", radius, 0)
    size = max(radius, 1e-9) / math.sqrt(2)
    cell = lambda c: F.floor(F.col(c) / size)
    spots = other.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("_n"))
    spots = spots.withColumns({"_cx": cell("x"), "_cy": cell("y")})
    totals = spots.groupBy(*keys, "_cx", "_cy").agg(F.sum("_n").alias("_own"))
    # Occupied cells around a point are found first, so empty surroundings cost nothing.
    base = df.withColumns({"_cx": cell("x"), "_cy": cell("y")})
    own = join_keys(base, totals, [*keys, "_cx", "_cy"], "left").select(*keys, id_col, F.coalesce("_own", F.lit(0)).alias("_own"))
    ring = F.explode(F.array(*[F.struct((F.col("_cx") + dx).alias("cx"), (F.col("_cy") + dy).alias("cy"))
                               for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) != (0, 0)]))
    sent = base.select(*keys, id_col, F.col("x").alias("_px"), F.col("y").alias("_py"), ring.alias("_c"))
    sent = sent.withColumns({"_cx": F.col("_c.cx"), "_cy": F.col("_c.cy")}).drop("_c")
    hits = sent.join(spots, [*keys, "_cx", "_cy"]).where(
        F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py")) <= radius)
    hits = hits.groupBy(*keys, id_col).agg(F.sum("_n").alias("_around"))
    return join_keys(own, hits, [*keys, id_col], "left").select(
        *keys, id_col, (F.col("_own") + F.coalesce("_around", F.lit(0))).cast("bigint").alias("neighbors"))


def isolated(df: DataFrame, radius: float, keys: list[str] = ["frame_id"], id_col: str = "star_id") -> DataFrame:
    """Points that are alone within ``radius``."""
    alone = neighbor_count(df, df, radius, keys, id_col).where("neighbors = 1")
    return df.join(alone.select(*keys, id_col), [*keys, id_col], "left_semi")


def nearest(pairs: DataFrame, keys: list[str], side: str, other: str) -> DataFrame:
    """Best partner per ``side`` id by distance, then by partner id (an aggregate with map-side combine)."""
    return pairs.groupBy(*keys, side).agg(F.min(F.struct("d2", other)).alias("_b")).select(
        *keys, side, F.col(f"_b.{other}").alias(other), F.col("_b.d2").alias("d2"))


def match_nearest(ref: DataFrame, moving: DataFrame, tolerance: float, keys: list[str] = ["frame_id"], id_col: str = "star_id") -> DataFrame:
    """Reciprocal nearest pairs within ``tolerance`` (``moving`` already projected, see B14); one to one."""
    finite("tolerance", tolerance, 0)
    # Points at one position tie; the lowest id stands for them, which is how ties are broken anyway.
    first = lambda d: d.groupBy(*keys, "x", "y").agg(F.min(id_col).alias(id_col))
    pairs = near_pairs(first(ref), first(moving), tolerance, keys, [id_col], [id_col])
    l, r = f"l_{id_col}", f"r_{id_col}"
    to_ref = nearest(pairs, keys, r, l)
    to_moving = nearest(pairs, keys, l, r).drop("d2")
    return to_ref.join(to_moving, [*keys, l, r]).select(
        *keys, F.col(l).alias("ref_id"), F.col(r).alias("moving_id"), F.sqrt("d2").alias("distance"))


def brightest(df: DataFrame, keys: list[str], n: int, flux: str = "flux", id_col: str = "star_id") -> DataFrame:
    """The ``n`` brightest per key; the limit is applied before the shuffle as well."""
    order = Window.partitionBy(*keys).orderBy(F.col(flux).desc(), F.col(id_col))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def match_translation(ref: DataFrame, moving: DataFrame, tolerance: float, keys: list[str] = ["frame_id"],
                      max_stars: int | None = None, id_col: str = "star_id") -> DataFrame:
    """Shift per key by votes of all pairs of catalog stars in bins of ``max(.25, tolerance)``.

    All stars of an image vote, or its brightest ``max_stars`` where a caller names a number; votes are counted map-side and
    no pair is shuffled: the pairs near the winning shift are found again by position.
    Ties between bins: more votes, then the smaller bin."""
    finite("tolerance", tolerance, 0)
    require(max_stars is None or max_stars >= 1, "max_stars must be positive")
    tol = max(0.25, tolerance)
    voters = lambda d: d if max_stars is None else brightest(d, keys, max_stars, id_col=id_col)
    star = lambda d, p: voters(d).select(
        *keys, F.col(id_col).alias(f"{p}_id"), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    r, m = star(ref, "r"), star(moving, "m")
    near = lambda c: (F.signum(c) * F.floor(F.abs(c) / tol + 0.5)).cast("bigint")
    bins = {"_bx": near(F.col("dx")), "_by": near(F.col("dy"))}
    offset = [(F.col("rx") - F.col("mx")).alias("dx"), (F.col("ry") - F.col("my")).alias("dy")]
    # All pairs are only counted: a key is dealt in VOTE_PARTS parts, and what is shuffled is one row per bin and task. The number
    # of tasks is named, since the catalogs are small and would be read by one.
    tasks = 2 * ref.sparkSession.sparkContext.defaultParallelism
    dealt = m.withColumn("_part", F.pmod(F.xxhash64("m_id"), F.lit(VOTE_PARTS)))
    copies = r.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(VOTE_PARTS - 1).cast("bigint"))))
    dealt, copies = (d.repartition(tasks, *keys, "_part") for d in (dealt, copies))
    votes = dealt.join(copies, [*keys, "_part"]).select(*keys, *offset).withColumns(bins).groupBy(*keys, "_bx", "_by").agg(F.count(F.lit(1)).alias("_n"))
    peak = votes.groupBy(*keys).agg(F.max_by(F.struct("_bx", "_by"), F.struct(
        "_n", (-F.col("_bx")).alias("a"), (-F.col("_by")).alias("b"))).alias("_p"))
    peak = cut_lineage(peak.select(*keys, F.col("_p._bx").alias("_px"), F.col("_p._by").alias("_py")))

    def around(shifts: DataFrame, x: Column, y: Column) -> DataFrame:
        """The pairs whose offset lies within ``tol`` of a key's shift, met by cells, with the columns of ``shifts``."""
        moved = join_keys(m, shifts, keys).withColumns({"_sx": F.col("mx") + x, "_sy": F.col("my") + y})
        # A little wider than the rule, which is then asked of the offsets themselves.
        also = [c for c in shifts.columns if c not in keys]
        found = near_pairs(moved, r, tol * 1.001, keys, ["m_id", "mx", "my", *also], ["rx", "ry"], "_sx", "_sy", "rx", "ry")
        found = found.withColumnsRenamed({"l_mx": "mx", "l_my": "my", "r_rx": "rx", "r_ry": "ry", "l_m_id": "m_id", **{f"l_{c}": c for c in also}})
        return found.select(*keys, "m_id", *offset, *also)

    chosen = around(peak, F.col("_px") * tol, F.col("_py") * tol).withColumns(bins).where("_bx = _px and _by = _py")
    both = F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("dx").alias("v")), F.struct(F.lit(1).alias("axis"), F.col("dy").alias("v"))))
    axes = chosen.select(*keys, both.alias("e")).select(*keys, "e.axis", "e.v")
    mid = quantiles(axes, [*keys, "axis"], "v", {"_m": ("upper",)}).groupBy(*keys).agg(
        F.max(F.when(F.col("axis") == 0, F.col("_m"))).alias("_mx"), F.max(F.when(F.col("axis") == 1, F.col("_m"))).alias("_my"))
    off = around(cut_lineage(mid), F.col("_mx"), F.col("_my"))
    gap = (F.col("dx") - F.col("_mx")) * (F.col("dx") - F.col("_mx")) + (F.col("dy") - F.col("_my")) * (F.col("dy") - F.col("_my"))
    inliers = off.where(gap <= tol * tol)
    # Element n // 2 of the inlier offsets ordered by (dx, dy).
    ranked = row_numbers(inliers.select(*keys, "m_id", "dx", "dy"), keys, [F.col("dx"), F.col("dy"), F.col("m_id")], F.col("dx"), "_r")
    counts = inliers.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("m_id").alias("matches"))
    refined = join_keys(ranked, counts, keys).where(F.col("_r") == F.floor(F.col("_n") / 2) + 1)
    sizes = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rn")).join(m.groupBy(*keys).agg(F.count(F.lit(1)).alias("_mn")), keys)
    return join_keys(refined, sizes, keys).select(
        *keys, "dx", "dy", "matches", (F.col("matches") / F.least("_rn", "_mn")).alias("inlier_ratio"))


def match_descriptors(ref: DataFrame, moving: DataFrame, keys: list[str] = ["frame_id"], limit: int = 180, neighbors: int = 6,
                      threshold: float = 0.055, id_col: str = "star_id") -> DataFrame:
    """Mutual best pairs by scale-free distances to the nearest neighbours.

    Only the ``limit`` brightest of each image take part (the same number on both sides), so a key has at most
    ``limit^2`` comparisons by definition of the method."""
    require(7 <= limit <= 1000 and neighbors >= 1, "limit must be within 7..1000")
    counts = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    sizes = counts(ref, "_a").join(counts(moving, "_b"), keys).select(*keys, F.least(F.lit(limit), F.col("_a"), F.col("_b")).alias("_limit"))
    sizes = sizes.where(F.col("_limit") >= neighbors)

    def descriptors(d: DataFrame, p: str) -> DataFrame:
        top = join_keys(brightest(d, keys, limit, id_col=id_col), sizes, keys).where(F.col("rank") <= F.col("_limit"))
        a = top.select(*keys, F.col(id_col).alias("_id"), "rank", "x", "y")
        b = top.select(*keys, F.col(id_col).alias("_other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        dist = a.join(b, keys).where(F.col("_id") != F.col("_other")).select(
            *keys, "_id", "rank", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")).alias("d"))
        arr = dist.groupBy(*keys, "_id", "rank").agg(F.slice(F.sort_array(F.collect_list("d")), 1, neighbors).alias("d"))
        arr = arr.where(F.size("d") == neighbors)
        scale = F.greatest(F.lit(1e-6), F.element_at("d", -1))
        return arr.select(*keys, F.col("_id").alias(f"{p}_id"), F.col("rank").alias(f"{p}_rank"), F.transform("d", lambda v: v / scale).alias(f"{p}_d"))

    both = descriptors(ref, "ref").join(descriptors(moving, "moving"), keys)
    score = F.aggregate(F.zip_with("ref_d", "moving_d", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / neighbors
    both = both.select(*keys, "ref_id", "ref_rank", "moving_id", "moving_rank", score.alias("score"))
    best = lambda side, other: both.groupBy(*keys, f"{side}_id").agg(F.min(F.struct("score", f"{other}_rank", f"{other}_id")).alias("_b")).select(
        *keys, f"{side}_id", F.col(f"_b.{other}_id").alias(f"{other}_id"), F.col("_b.score").alias("score"))
    return best("moving", "ref").join(best("ref", "moving").drop("score"), [*keys, "ref_id", "moving_id"]).where(
        F.col("score") <= threshold).select(*keys, "ref_id", "moving_id", "score")


def greedy_separation(df: DataFrame, radius: float, keys: list[str], id_col: str, order: list[Column], lead_value: Column,
                      coordinates: list[tuple[str, str]] = [("x", "y")]) -> DataFrame:
    """Keep points in ``order`` unless one kept before lies closer than ``radius`` (in any coordinate pair).

    Order-dependent, yet distributed. Where points are crowded no conflict is written down: in rounds, every point that is
    the first of its neighbourhood of cells is kept and drops all points closer than ``radius``, so work and disk grow with the points
    and the rounds, not with the pairs. Once the open points have few neighbours, their conflicts are written as edges for
    :func:`greedy_keep`, whose rounds follow the true chains."""
    ranked = cut_lineage(row_numbers(df, keys, order, lead_value, "_rank"))
    names = list(dict.fromkeys(c for pair in coordinates for c in pair))
    open_points = ranked.select(*keys, id_col, "_rank", *[c for c in names if c not in (*keys, id_col)])
    few, kept, rounds = max(FEW_EDGES, EDGES_PER_POINT * ranked.count()), [], 0
    while rounds % LOOK or _neighbours(open_points, radius, keys, coordinates) > few:
        won = cut_lineage(open_points.join(_firsts(open_points, radius, keys, coordinates), [*keys, "_rank"], "left_semi"))
        n = won.count()
        if n == 0:
            break
        kept.append(won.select(*keys, id_col))
        beside = (lambda d: F.broadcast(d)) if n <= WINNERS else (lambda d: d)
        open_points = open_points.join(beside(won.select(*keys, "_rank")), [*keys, "_rank"], "left_anti")
        for x, y in coordinates:
            near = won.select(*keys, F.col(x).alias("_wx"), F.col(y).alias("_wy"), _cells(radius, x, y, REACH))
            d2 = (F.col(x) - F.col("_wx")) * (F.col(x) - F.col("_wx")) + (F.col(y) - F.col("_wy")) * (F.col(y) - F.col("_wy"))
            here = open_points.withColumn("_c", _cells(radius, x, y))
            same = [here[k] == near[k] for k in keys]
            on = (here["_c"] == near["_c"]) & (d2 < radius * radius)
            for s in same:
                on = on & s
            open_points = here.join(beside(near), on, "left_anti").drop("_c")
        open_points = cut_lineage(open_points)
        rounds += 1
    edges = None
    for x, y in coordinates:
        e = near_pairs(open_points, open_points, radius, keys, [id_col, "_rank"], [id_col, "_rank"], x, y, x, y)
        e = e.where((F.col("d2") < radius * radius) & (F.col("r__rank") < F.col("l__rank"))).select(
            *keys, F.col(f"l_{id_col}").alias("_id"), F.col(f"r_{id_col}").alias("_before"))
        edges = e if edges is None else edges.unionByName(e)
    out = greedy_keep(open_points.select(*keys, id_col), edges.distinct(), keys, id_col)
    for won in kept:
        out = out.unionByName(won)
    return ranked.join(out, [*keys, id_col], "left_semi").drop("_rank")


def _cells(radius: float, x: str, y: str, reach: int | None = None) -> Column:
    """Cell of a point, half a radius wide; with ``reach`` a row ``_c`` for each cell up to that far away. A little wider than
    half, so that points more than ``REACH`` cells apart do not conflict whatever is rounded."""
    size = radius / 2 * (1 + 1e-9)
    cell = lambda c, d: F.floor(F.col(c) / size) + d
    if reach is None:
        return F.struct(cell(x, 0).alias("cx"), cell(y, 0).alias("cy"))
    span = range(-reach, reach + 1)
    return F.explode(F.array(*[F.struct(cell(x, dx).alias("cx"), cell(y, dy).alias("cy")) for dx in span for dy in span])).alias("_c")


def _around() -> Column:
    span = range(-REACH, REACH + 1)
    return F.explode(F.array(*[F.struct((F.col("_c.cx") + dx).alias("cx"), (F.col("_c.cy") + dy).alias("cy")) for dx in span for dy in span])).alias("_c")


def _placed(points: DataFrame, radius: float, x: str, y: str) -> DataFrame:
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_c", _cells(radius, x, y))


def _neighbours(points: DataFrame, radius: float, keys: list[str], coordinates: list[tuple[str, str]]) -> int:
    """Bound of the conflicts of ``points``, from the numbers of points in cells."""
    total = 0
    for x, y in coordinates if radius > 0 else []:
        cells = _placed(points, radius, x, y).groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_n"))
        spread = cells.select(*keys, _around(), F.col("_n").alias("_m"))
        total += cells.join(spread, [*keys, "_c"]).agg(F.sum(F.col("_n") * F.col("_m")).alias("s")).first()["s"] or 0
    return total // 2


def _firsts(points: DataFrame, radius: float, keys: list[str], coordinates: list[tuple[str, str]]) -> DataFrame:
    """(keys, ``_rank``) of points before all others in the cells within reach, in every coordinate pair; the first open point of a
    key always is. A point without a position in a pair conflicts with none there."""
    found = None
    for x, y in coordinates:
        heads = _placed(points, radius, x, y).groupBy(*keys, "_c").agg(F.min("_rank").alias("_rank"))
        least = heads.select(*keys, _around(), "_rank").groupBy(*keys, "_c").agg(F.min("_rank").alias("_rank"))
        part = heads.join(least, [*keys, "_c", "_rank"], "left_semi").select(*keys, "_rank")
        part = part.unionByName(points.where(F.col(x).isNull() | F.col(y).isNull()).select(*keys, "_rank"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy(*keys, "_rank").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(coordinates)).select(*keys, "_rank")


def greedy_keep(nodes: DataFrame, edges: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Ids kept by the sequential rule "drop a node if a kept one before it conflicts". ``edges``: keys, ``_id`` and
    ``_before`` (the conflicting node that comes earlier). Every round settles at least the first open node of each chain,
    so there are as many rounds as the longest chain asks for."""
    edges = cut_lineage(edges)
    crowded = edges.select(*keys, F.col("_id").alias(id_col)).distinct()
    settled = join_anti(nodes, crowded, [*keys, id_col]).withColumn("_keep", F.lit(True))
    open_edges = edges
    while not open_edges.isEmpty():
        seen = join_keys(open_edges, settled.select(*keys, F.col(id_col).alias("_before"), "_keep"), [*keys, "_before"], "left")
        state = seen.groupBy(*keys, "_id").agg(F.max(F.coalesce(F.col("_keep").cast("int"), F.lit(0))).alias("_hit"),
                                               F.max(F.col("_keep").isNull().cast("int")).alias("_wait"))
        done = cut_lineage(state.where((F.col("_hit") == 1) | (F.col("_wait") == 0)).select(
            *keys, F.col("_id").alias(id_col), (F.col("_hit") == 0).alias("_keep")))
        settled = cut_lineage(settled.unionByName(done))
        open_edges = cut_lineage(join_anti(open_edges, done.select(*keys, F.col(id_col).alias("_id")), [*keys, "_id"]))
    return settled.where("_keep").select(*keys, id_col)


def join_anti(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def exclude_ids(df: DataFrame, excluded: DataFrame, id_col: str = "star_id") -> tuple[DataFrame, DataFrame]:
    """(rows without the excluded ids, excluded ids that do not exist - must be empty)."""
    require_columns(excluded, [id_col], "excluded")
    wanted = excluded.select(id_col).distinct()
    return df.join(wanted, id_col, "left_anti"), wanted.subtract(df.select(id_col))

"""Detected regions and trails across the frames of a sequence; tile statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.scalars import angle_delta, clamp, grid_cell, interval_overlap, iou, luma
from ..schema import MIN_COVERAGE, finite, require, require_columns
from .color import RGB, to_wide
from ..session import cut_lineage
from .match import greedy_keep
from .stats import row_numbers

BOX = ["x", "y", "width", "height"]


def overlapping(left: DataFrame, right: DataFrame, cell: float, left_id: str, right_cols: list[str]) -> DataFrame:
    """Box pairs that touch, by grid cells: each pair appears once, in the cell of the corner of its intersection."""
    cells = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size)) / cell))

    def spread(df: DataFrame, p: str, cols: list[str]) -> DataFrame:
        df = df.withColumn("_cx", F.explode(cells("x", "width"))).withColumn("_cy", F.explode(cells("y", "height")))
        return df.select("_cx", "_cy", *[F.col(c).alias(f"{p}_{c}") for c in dict.fromkeys([*cols, *BOX])])

    both = spread(left, "l", [left_id]).join(spread(right, "r", right_cols), ["_cx", "_cy"])
    x, y = F.greatest("l_x", "r_x"), F.greatest("l_y", "r_y")
    return both.where((F.floor(x / cell) == F.col("_cx")) & (F.floor(y / cell) == F.col("_cy"))).withColumn(
        "iou", iou(*[F.col(f"l_{c}") for c in BOX], *[F.col(f"r_{c}") for c in BOX])).drop("_cx", "_cy")


def touching(left: DataFrame, right: DataFrame, cell: float, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """Pairs of boxes whose rectangles share a cell, each once: columns of both, whose names must differ."""
    def spread(df: DataFrame, p: str, cols: list[str]) -> DataFrame:
        at = lambda lo, size: F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(lo) + F.col(size)) / cell))
        df = df.withColumn("_cx", F.explode(at("x", "width"))).withColumn("_cy", F.explode(at("y", "height")))
        # Work grows with the pairs and not with the bytes shuffled: the number of partitions is set.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.select("_cx", "_cy", *cols, F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")).repartition(parts, "_cx", "_cy")

    both = spread(left, "_l", left_cols).join(spread(right, "_r", right_cols), ["_cx", "_cy"])
    return both.where((F.floor(F.greatest("_lx", "_rx") / cell) == F.col("_cx")) & (F.floor(F.greatest("_ly", "_ry") / cell) == F.col("_cy"))).select(*left_cols, *right_cols)


def matched(left: DataFrame, right: DataFrame, threshold: float, cell: float, word: list[str], merge, better) -> DataFrame:
    """``box_id, *word, _load``: the ``_load`` of all boxes of ``right`` (per ``word``) with an IoU of at least ``threshold``
    with a box of ``left``, put together by ``merge``.

    Boxes of like place and size form lumps, whose number is bounded by the image and not by the boxes. What the bounds of two
    lumps decide is settled for all their members; a pair of lumps they leave open goes on, first as box and lump, then as box
    and box, only where ``better`` says that its load would add to what is known to match."""
    bound = [f"{e}{i}" for e in ("x", "r", "y", "b", "s") for i in (0, 1)]
    step = lambda size: F.floor(F.log2(F.greatest(F.col(size), F.lit(1e-9))) * 3)
    place = lambda at, size: F.floor(F.col(at) * 3 / F.pow(F.lit(2.0), step(size) / 3))
    value = {"x": F.col("x"), "r": F.col("x") + F.col("width"), "y": F.col("y"), "b": F.col("y") + F.col("height"), "s": F.col("width") * F.col("height")}

    def lumped(df: DataFrame, p: str) -> DataFrame:
        return df.withColumn(f"{p}_lump", F.xxhash64(step("width"), step("height"), place("x", "width"), place("y", "height")))

    def bounds(df: DataFrame, p: str, by: list[str], *more: Column) -> DataFrame:
        ends = [f(v).alias(f"{p}_{e}{i}") for e, v in value.items() for i, f in ((0, F.min), (1, F.max))]
        out = df.groupBy(*by).agg(*ends, *more)
        return out.withColumns({"x": F.col(f"{p}_x0"), "y": F.col(f"{p}_y0"), "width": F.col(f"{p}_r1") - F.col(f"{p}_x0"), "height": F.col(f"{p}_b1") - F.col(f"{p}_y0")})

    def judged(df: DataFrame) -> DataFrame:
        c = lambda n: F.col(n)
        length = lambda lo, hi, i: F.greatest(F.lit(0.0), F.least(c(f"l_{hi}{i}"), c(f"r_{hi}{i}")) - F.greatest(c(f"l_{lo}{1 - i}"), c(f"r_{lo}{1 - i}")))
        inner, outer = (length("x", "r", i) * length("y", "b", i) for i in (0, 1))
        low = F.try_divide(inner, c("l_s1") + c("r_s1") - inner)
        rest = c("l_s0") + c("r_s0") - outer
        high = F.when(rest > 0, F.try_divide(outer, rest)).otherwise(F.signum(outer))
        df = df.withColumn("_sure", F.coalesce((low >= threshold * (1 + 1e-9)) & (inner > 0), F.lit(False)))
        return df.where(F.col("_sure") | (high >= threshold * (1 - 1e-9)))

    def unsettled(pairs: DataFrame, best: DataFrame, key: str) -> DataFrame:
        seen = pairs.where(~F.col("_sure")).join(best.withColumnRenamed("_load", "_best"), [key, *word], "left")
        return seen.where(F.col("_best").isNull() | better(F.col("_load"), F.col("_best")))

    a, b = lumped(left, "l"), lumped(right, "r")
    r_cols = ["r_lump", *word, *[f"r_{n}" for n in bound], "_load"]
    lumps = touching(bounds(a, "l", ["l_lump"]), bounds(b, "r", ["r_lump", *word], merge("_load").alias("_load")), cell,
                     ["l_lump", *[f"l_{n}" for n in bound]], r_cols)
    lumps = judged(lumps)
    best = cut_lineage(lumps.where("_sure").groupBy("l_lump", *word).agg(merge("_load").alias("_load")))
    todo = cut_lineage(unsettled(lumps, best, "l_lump").select("l_lump", *r_cols))
    ones = a.select("box_id", "l_lump", *[value[n[0]].alias(f"l_{n}") for n in bound])
    boxes = judged(ones.join(todo, "l_lump"))
    whole = ones.select("box_id", "l_lump").join(best, "l_lump").select("box_id", *word, "_load")
    best = cut_lineage(whole.unionByName(boxes.where("_sure").select("box_id", *word, "_load")).groupBy("box_id", *word).agg(merge("_load").alias("_load")))
    todo = cut_lineage(unsettled(boxes, best, "box_id").select("box_id", "r_lump", *word, "_best"))
    named = lambda df, p, more: df.select(*more, *[F.col(n).alias(f"{p}_{n}") for n in BOX])
    single = todo.join(named(b, "r", ["r_lump", *word, "_load"]), ["r_lump", *word]).where(F.col("_best").isNull() | better(F.col("_load"), F.col("_best")))
    single = single.join(named(left, "l", ["box_id"]), "box_id").where(iou(*[F.col(f"l_{n}") for n in BOX], *[F.col(f"r_{n}") for n in BOX]) >= threshold)
    return best.unionByName(single.select("box_id", *word, "_load")).groupBy("box_id", *word).agg(merge("_load").alias("_load"))


def frame_numbers(df: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with ``_bit``, and the number of their frame, of which ``_bit`` is the remainder by 64."""
    number = F.col("frame_id").cast("bigint")
    if not isinstance(df.schema["frame_id"].dataType, IntegralType):
        # Any distinct numbers do; written once, since they depend on the partitions.
        frames = cut_lineage(df.select("frame_id").distinct().withColumn("_frame", F.monotonically_increasing_id()))
        df, number = df.join(frames, "frame_id"), F.col("_frame")
    return df.withColumn("_bit", F.pmod(number, F.lit(64)).cast("int")), number


def distinct_boxes(regions: DataFrame, by: list[str]) -> DataFrame:
    """Equal boxes are one candidate: pairing them again cannot change what they match."""
    return regions.groupBy(*by, *BOX).agg(F.count(F.lit(1)).alias("copies"))


def temporal_support(candidates: DataFrame, references: DataFrame, existing: DataFrame, reference_frames: int,
                     image_area: float, cell: float = 256.0) -> tuple[DataFrame, DataFrame]:
    """(confirmed candidates, existing regions with raised confidence).

    A dark candidate is supported by a reference frame with a dark box of IoU >= .10; it is confirmed with support
    in ``max(2, (n+2)/3)`` frames and a fill of >= .50. If it lies (IoU >= .50) on an existing region, that region
    or an earlier confirmed candidate gains confidence, otherwise it is new. Frames met and regions hit are found lump by
    lump (see ``matched``); only new candidates are paired one by one."""
    require(reference_frames >= 1, "at least one reference frame")
    require_columns(candidates, ["region_id", *BOX, "coverage", "confidence", "mean_luminance", "background_luminance"], "candidates")
    dark = F.col("mean_luminance") < F.col("background_luminance")
    fill = F.col("coverage") / F.greatest(F.col("width") * F.col("height") / image_area, F.lit(1e-6))
    cand = candidates.where(dark & (fill >= 0.5))
    boxes = lambda df: distinct_boxes(df, []).withColumn("box_id", F.xxhash64(*BOX))
    refs, number = frame_numbers(references.where(dark))
    refs = refs.groupBy(*BOX, F.floor(number / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_load"))
    new = lambda load, best: load.bitwiseAND(F.bitwise_not(best)) != 0
    support = matched(boxes(cand), refs, 0.10, cell, ["_word"], F.bit_or, new).groupBy("box_id").agg(F.sum(F.bit_count("_load")).cast("bigint").alias("support"))
    need = max(2, (reference_frames + 2) // 3)
    cand = cand.withColumn("box_id", F.xxhash64(*BOX)).join(support.where(F.col("support") >= need), "box_id")
    cand = cut_lineage(cand.select("region_id", *BOX, "coverage", "confidence", "mean_luminance", "background_luminance", "support", "box_id"))
    # Regions a candidate may fall on, in list order: the existing ones, then candidates confirmed before it.
    known = existing.groupBy(*BOX).agg(F.min("region_id").alias("_load"))
    onto = matched(boxes(cand), known, 0.50, cell, [], F.min, lambda load, best: load < best)
    on_existing = cut_lineage(cand.select("region_id", "box_id").join(onto, "box_id").select("region_id", F.col("_load").alias("_onto")))
    as_boxes = lambda df, order: df.select("region_id", *BOX, F.lit(order).alias("_order"))
    free = cand.join(on_existing, "region_id", "left_anti")
    clash = overlapping(as_boxes(free, 1), as_boxes(free, 1), cell, "region_id", ["region_id"]).where(
        (F.col("iou") >= 0.50) & (F.col("r_region_id") < F.col("l_region_id")))
    clash = cut_lineage(clash.select(F.col("l_region_id").alias("_id"), F.col("r_region_id").alias("_before")))
    kept = greedy_keep(free.select("region_id"), clash, [], "region_id")
    merged = clash.join(kept.withColumnRenamed("region_id", "_before"), "_before", "left_semi").join(
        kept.withColumnRenamed("region_id", "_id"), "_id", "left_anti").groupBy(F.col("_id").alias("region_id")).agg(F.min("_before").alias("_onto"))

    def raise_by(regions: DataFrame, onto: DataFrame) -> DataFrame:
        gains = cand.select("region_id", "support").join(onto, "region_id").groupBy(F.col("_onto").alias("region_id")).agg(
            F.max("support").alias("_max"), F.sum("support").alias("_all"))
        out = regions.join(gains, "region_id", "left")
        return out.withColumns({"confidence": F.least(F.lit(1.0), F.col("confidence") + F.coalesce("_all", F.lit(0)) * 0.035),
                                "support": F.greatest(F.coalesce("support", F.lit(0)), F.coalesce("_max", F.lit(0))).cast("bigint")}).drop("_max", "_all")

    fresh = cand.join(kept, "region_id", "left_semi").drop("box_id").withColumn(
        "confidence", F.least(F.lit(1.0), F.col("confidence") + F.col("support") * 0.035))
    return raise_by(fresh, merged), raise_by(existing.withColumn("support", F.lit(0)), on_existing)


def region_order(regions: DataFrame) -> DataFrame:
    """K4: number regions by falling confidence, then y, x (and id); ranks are put together per range of confidence."""
    order = [F.col("confidence").desc(), F.col("y"), F.col("x"), F.col("region_id")]
    rows = row_numbers(regions.withColumn("_all", F.lit(0)), ["_all"], order, -F.col("confidence"), "_row")
    return rows.withColumn("index", F.col("_row") - 1).drop("_all", "_row")


def recurrent_trails(trails: DataFrame, threshold: int, min_weight: float = 0.0, min_length: float = 0.0,
                     min_brightness: float | None = None, removable: list[str] | None = None, cell: float = 64.0,
                     turns: tuple[int, int] = (256, 4096)) -> DataFrame:
    """Frames in which each removable trail comes back, and the decision: recurrent (keep) or selected.

    Two trails repeat if they have the same kind, differ by at most .18 rad, lie within ``max(8, 1.6 * (w + w'))``
    across the first one's direction and overlap along it by 40 % of the shorter. Candidates meet through cells of
    their bounding boxes, grown by the distance allowed; trails equal in everything but the frame are compared once
    per distinct shape, so a shape that recurs in every frame costs one comparison and a count of its frames. A trail of
    length 0 has direction 0 and overlaps any trail across which it lies near enough, however far along.

    Trails meet in rounds: about ``turns`` shapes of a neighbourhood first, then all others. One that has met every frame of
    its kind leaves, since no further pair can change its count; the last round compares the rest with everything left."""
    require(threshold >= 1, "threshold must be at least 1")
    finite("cell", cell, 1e-6)
    shape = ["kind", "x1", "y1", "x2", "y2", "width"]
    require_columns(trails, ["trail_id", "frame_id", *shape, "weight"], "trails")
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    wanted = (F.col("weight") >= min_weight) & (length >= min_length)
    if min_brightness is not None:
        wanted = wanted & (F.col("brightness") >= min_brightness)
    if removable is not None:
        wanted = wanted & F.col("kind").isin(removable)
    # Frames are bits of numbered words, so that those met are or-ed where they are found.
    number = F.col("frame_id").cast("bigint")
    if not isinstance(trails.schema["frame_id"].dataType, IntegralType):
        # Any distinct numbers do; written once, since they depend on the partitions.
        frames = cut_lineage(trails.select("frame_id").distinct().withColumn("_frame", F.monotonically_increasing_id()))
        trails = trails.join(frames, "frame_id")
        number = F.col("_frame")
    angle = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    base = trails.withColumns({"shape_id": F.xxhash64(*shape), "_word": F.floor(number / 64), "_bit": F.pmod(number, F.lit(64)).cast("int")})
    asking = base.where(wanted)
    grow = F.greatest(F.lit(8.0), F.col("width") * 3.2)
    # A pair may lie max(8, 1.6(w+w')) apart, at most the sum of both growths.
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - F.col("_g")) / cell), F.floor((F.greatest(a, b) + F.col("_g")) / cell))
    # Directions in 17 sectors of the half circle, each wider than the angle allowed: a trail looks into three.
    sectors = 17
    sector = F.least(F.lit(sectors - 1), F.floor(F.pmod(angle, F.lit(math.pi)) * (sectors / math.pi)))
    # What a comparison needs of a shape is worked out once per shape.
    facts = {"_g": grow, "_s": sector.cast("int"), "ang": angle, "ux": F.cos(angle), "uy": F.sin(angle), "len": length,
             "mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2}
    facts |= {"cx0": F.floor((F.least("x1", "x2") - grow) / cell), "cy0": F.floor((F.least("y1", "y2") - grow) / cell)}

    def named(s: DataFrame, p: str, place: list[str], more: list[str]) -> DataFrame:
        return s.select(*place, *[F.col(c).alias(f"{p}_{c}") for c in ("shape_id", *shape[1:], *list(facts)[2:], *more)])

    def spread(shapes: DataFrame, p: str, reach: int, more: list[str]) -> DataFrame:
        s = shapes.withColumns(facts)
        if reach:
            s = s.withColumn("_s", F.explode(F.array(*[F.pmod(F.col("_s") + i, F.lit(sectors)) for i in (-1, 0, 1)])))
        s = s.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))
        return named(s, p, ["kind", "_s", "_cx", "_cy"], more)

    bit = lambda c: F.expr(f"shiftleft(1L, {c})")
    known = base.groupBy("shape_id", *shape, "_word").agg(F.bit_or(bit("_bit")).alias("bits"))
    # Shapes of one home (kind, sector, cell of the middle) take turns by hash: the first rounds meet only early turns.
    homes = known.withColumns(facts).withColumns({"_hx": F.floor(F.col("mx") / cell), "_hy": F.floor(F.col("my") / cell)})
    home = ["kind", "_s", "_hx", "_hy"]
    turn = F.pmod(F.xxhash64("shape_id"), F.lit(1 << 20)) * F.col("_crowd") / (1 << 20)
    known = cut_lineage(homes.join(homes.groupBy(*home).agg(F.count(F.lit(1)).alias("_crowd")), home).select(
        "shape_id", *shape, "_word", "bits", turn.alias("_turn")))
    asked = cut_lineage(asking.select("shape_id", *shape).distinct())
    # Work grows with the pairs and not with the bytes shuffled, by which partitions would be merged: their number is set.
    parts = int(trails.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["kind", "_s", "_cx", "_cy"]

    def together(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.repartition(parts, *place).join(right.repartition(parts, *place), place)

    def in_cells(left: DataFrame, right: DataFrame) -> DataFrame:
        """All pairs; one that shares several cells counts in the first of them only."""
        both = together(spread(left, "a", 1, []), spread(right, "b", 0, ["_word", "bits"]))
        return both.where((F.col("_cx") == F.greatest("a_cx0", "b_cx0")) & (F.col("_cy") == F.greatest("a_cy0", "b_cy0"))).drop(*place)

    def midway(left: DataFrame, right: DataFrame, fine: float) -> DataFrame:
        """Some of the pairs: trails that run through the small cell in which the middle of the asking one lies."""
        left = left.withColumns(facts).withColumns({"_cx": F.floor(F.col("mx") / fine), "_cy": F.floor(F.col("my") / fine)})
        slope, low, high = F.try_divide(F.col("uy"), F.col("ux")), F.least("x1", "x2"), F.greatest("x1", "x2")
        right = right.withColumns(facts).withColumn("_cx", F.explode(F.sequence(F.floor(low / fine), F.floor(high / fine))))
        ends = [F.col("my") + (x - F.col("mx")) * slope for x in (F.greatest(low, F.col("_cx") * fine), F.least(high, (F.col("_cx") + 1) * fine))]
        rows = F.sequence(F.floor(F.coalesce(F.least(*ends), F.least("y1", "y2")) / fine), F.floor(F.coalesce(F.greatest(*ends), F.greatest("y1", "y2")) / fine))
        right = right.withColumn("_cy", F.explode(rows)).withColumn("_s", F.explode(F.array(*[F.pmod(F.col("_s") + i, F.lit(sectors)) for i in (-1, 0, 1)])))
        return together(named(left, "a", place, []), named(right, "b", place, ["_word", "bits"])).drop(*place)

    ux, uy = F.col("a_ux"), F.col("a_uy")
    across = F.abs(-(F.col("a_mx") - F.col("b_mx")) * uy + (F.col("a_my") - F.col("b_my")) * ux)
    at = lambda p, i: F.col(f"{p}_x{i}") * ux + F.col(f"{p}_y{i}") * uy
    shared = interval_overlap(at("a", 1), at("a", 2), at("b", 1), at("b", 2))
    # The sine of the angle between them settles most pairs without the modulus; the exact test follows.
    turned = F.abs(ux * F.col("b_uy") - uy * F.col("b_ux")) <= math.sin(0.18) + 1e-9
    same = (turned & (angle_delta(F.col("a_ang"), F.col("b_ang")) <= 0.18) & (across <= F.greatest(F.lit(8.0), (F.col("a_width") + F.col("b_width")) * 1.6))
            & (shared >= F.least("a_len", "b_len") * 0.4))
    # A point (length 0, direction 0) needs no overlap: it repeats all along the line of a near-level trail, met by rows of cells.
    flat = angle_delta(F.col("ang"), F.lit(0.0)) <= 0.18 + 1e-9
    rows = lambda lo, hi: F.explode(F.sequence(F.floor((lo - F.col("_g") * 1.1) / cell), F.floor((hi + F.col("_g") * 1.1) / cell)))

    def on_lines(asked: DataFrame) -> DataFrame:
        asked, seen = asked.withColumns(facts), known.withColumns(facts)
        points = seen.where(F.col("len") == 0)
        more = ["_word", "bits"]
        level = named(asked.where(F.col("len") == 0).withColumn("_cy", rows(F.col("my"), F.col("my"))), "a", ["kind", "_cy"], []).join(
            named(seen.where(flat).withColumn("_cy", rows(F.col("my"), F.col("my"))), "b", ["kind", "_cy"], more), ["kind", "_cy"])
        # The line of a trail is followed over the stretch that has points, in at most 65 columns.
        stretch = points.groupBy("kind").agg(F.min("mx").alias("_x0"), F.max("mx").alias("_x1")).withColumn(
            "_step", F.greatest(F.lit(cell * 4), (F.col("_x1") - F.col("_x0")) / 64))
        column = lambda x: F.floor((x - F.col("_x0")) / F.col("_step"))
        height = lambda x: F.col("my") + (x - F.col("mx")) * F.col("uy") / F.col("ux")
        lines = asked.where(flat & (F.col("len") > 0)).join(stretch, "kind").withColumn("_cx", F.explode(F.sequence(F.lit(0).cast("bigint"), column(F.col("_x1")))))
        start, end = height(F.col("_x0") + F.col("_cx") * F.col("_step")), height(F.col("_x0") + (F.col("_cx") + 1) * F.col("_step"))
        lines = lines.withColumn("_cy", rows(F.least(start, end), F.greatest(start, end)))
        spots = points.join(stretch, "kind").withColumn("_cx", column(F.col("mx"))).withColumn("_cy", rows(F.col("my"), F.col("my")))
        place = ["kind", "_cx", "_cy"]
        beside = named(lines, "a", place, []).join(named(spots, "b", place, more), place)
        return level.drop("kind", "_cy").unionByName(beside.drop(*place))

    def frames_met(pairs: DataFrame) -> DataFrame:
        """Frames met, as bits: or-ed before the shuffle, so a crowd costs comparisons but no rows, and a pair may come twice."""
        return pairs.where(same).groupBy(F.col("a_shape_id").alias("shape_id"), F.col("b__word").alias("_word")).agg(F.bit_or("b_bits").alias("_met"))

    frames = known.groupBy("kind", "_word").agg(F.bit_or("bits").alias("bits")).groupBy("kind").agg(F.sum(F.bit_count("bits")).alias("_frames"))
    # A trail that has met every frame of its kind needs no further pairs. It meets itself, once it meets any.
    met, done, (first, second) = None, None, turns
    early = lambda most: known.where(F.col("_turn") < most)
    for pairs in (lambda asked: midway(asked, early(first), cell / 4), lambda asked: in_cells(asked, early(second))):
        found = frames_met(pairs(asked))
        met = cut_lineage(found if met is None else met.unionByName(found).groupBy("shape_id", "_word").agg(F.bit_or("_met").alias("_met")))
        ours = known.select("shape_id", "_word", F.col("bits").alias("_met"), F.lit(False).alias("_hit"))
        state = met.withColumn("_hit", F.lit(True)).unionByName(ours).groupBy("shape_id", "_word").agg(F.bit_or("_met").alias("_met"), F.bool_or("_hit").alias("_hit"))
        state = state.groupBy("shape_id").agg(F.sum(F.bit_count("_met")).alias("_n"), F.bool_or("_hit").alias("_hit"))
        state = cut_lineage(asked.join(state, "shape_id", "left").join(frames, "kind", "left").withColumn(
            "_done", F.coalesce(F.col("_hit") & (F.col("_n") == F.col("_frames")), F.lit(False))))
        settled = state.where("_done").select("shape_id", "_n")
        done, asked = settled if done is None else done.unionByName(settled), state.where("not _done").select("shape_id", *shape)
    late = known.where(F.col("_turn") >= second)
    met = met.join(asked, "shape_id", "left_semi").unionByName(frames_met(in_cells(asked, late).unionByName(on_lines(asked))))
    met = cut_lineage(met.groupBy("shape_id", "_word").agg(F.bit_or("_met").alias("_met")))
    total = met.groupBy("shape_id").agg(F.sum(F.bit_count("_met")).alias("_n"), F.lit(False).alias("_done")).unionByName(
        done.withColumn("_done", F.lit(True)))
    out = asking.join(total, "shape_id", "left").join(met, ["shape_id", "_word"], "left")
    own = F.when(F.col("_done") | F.expr("(shiftright(_met, _bit) & 1L) = 1"), 1).otherwise(0)
    n = (F.coalesce("_n", F.lit(0)) - own).cast("bigint")
    return out.select("trail_id", "frame_id", "kind", n.alias("recurring_frames"),
                      F.when(n >= threshold, "recurrent").otherwise("selected").alias("decision"))


def tile_stats(df: DataFrame, columns: int, rows: int, width: int, height: int, bins: int = 1024) -> DataFrame:
    """Per tile contrast (q70 - q20 of luminance), share of bright points and the lower luminance and colour
    levels (q30), read from histograms, so a tile of any size is a bounded number of counts."""
    require(0 < columns <= width and 0 < rows <= height and bins >= 2, "tiles do not fit the frame")
    tile = grid_cell(F.col("y"), height, rows) * columns + grid_cell(F.col("x"), width, columns)
    wide = to_wide(df).where(F.col("coverage") > MIN_COVERAGE).withColumns({"tile": tile, "l": luma(*[F.col(c) for c in RGB])})
    keys = ["frame_id", "tile"]
    w = F.col("coverage")
    stats = wide.groupBy(*keys).agg(F.sum(w).alias("weight"), (F.sum(F.col("l") * w) / F.sum(w)).alias("mean"),
                                    (F.sum(F.col("l") * F.col("l") * w) / F.sum(w)).alias("_sq"))
    stats = stats.select(*keys, "weight", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") - F.col("mean") * F.col("mean"))).alias("sigma"))
    limit = stats.select(*keys, (F.col("mean") + F.greatest(F.lit(0.025), F.col("sigma") * 2.15)).alias("_limit"))
    points = wide.join(limit, keys).groupBy(*keys).agg(
        (F.sum(F.when(F.col("l") > F.col("_limit"), w).otherwise(0.0)) / F.sum(w)).alias("bright_fraction"))
    index = lambda c: F.floor(clamp(F.col(c), 0.0, 1.0) * (bins - 1) + 0.5).cast("int")
    long = wide.select(*keys, w, F.explode(F.array(*[F.struct(F.lit(c).alias("m"), index(c).alias("b")) for c in ("l", *RGB)])).alias("e"))
    counts = long.groupBy(*keys, "e.m", "e.b").agg(F.sum("coverage").alias("n"))
    # At most `bins` rows per tile and measure.
    levels = counts.groupBy(*keys, "m").agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("h"), F.sum("n").alias("t"))

    def level(q: float) -> Column:
        need = F.greatest(F.lit(1e-8), F.col("t") * q) - 1e-9
        walk = F.aggregate("h", F.struct(F.lit(0.0).alias("c"), F.lit(-1).alias("b")), lambda s, e: F.struct(
            (s["c"] + e["n"]).alias("c"), F.when((s["b"] < 0) & (s["c"] + e["n"] >= need), e["b"]).otherwise(s["b"]).alias("b")))
        return walk["b"] / (bins - 1)

    levels = levels.select(*keys, "m", level(0.2).alias("q20"), level(0.3).alias("q30"), level(0.7).alias("q70"))
    pick = lambda m, c: F.max(F.when(F.col("m") == m, F.col(c)))
    levels = levels.groupBy(*keys).agg((pick("l", "q70") - pick("l", "q20")).alias("contrast"), pick("l", "q30").alias("low_luminance"),
                                       *[pick(c, "q30").alias(f"low_{c}") for c in RGB])
    return stats.join(points, keys).join(levels, keys)

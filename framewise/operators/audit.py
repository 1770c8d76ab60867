"""File inventories and checks of labelled case lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import require, require_columns


def inventory(files: DataFrame, content: str = "content") -> DataFrame:
    """``path``, size and SHA-256 of each file, and how often its path and its content occur.

    The digest replaces the content before anything is shuffled; copies are counted with a map-side combine, so a
    content that fills a third of all files is a single count."""
    require_columns(files, ["path", content], "files")
    keep = [c for c in files.columns if c != content]
    rows = files.select(*keep, F.octet_length(content).cast("bigint").alias("bytes"), F.sha2(content, 256).alias("sha"))
    contents = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("content_copies")).where("content_copies > 1")
    paths = rows.groupBy("path").agg(F.count(F.lit(1)).alias("path_copies")).where("path_copies > 1")
    out = rows.join(contents, "sha", "left").join(paths, "path", "left")
    return out.withColumns({"content_copies": F.coalesce("content_copies", F.lit(1)).cast("bigint"),
                            "path_copies": F.coalesce("path_copies", F.lit(1)).cast("bigint")})


#: File endings of scientific originals and of display pictures.
ORIGINALS = ["fits", "fit", "fts", "cr2", "cr3", "nef", "arw", "dng", "raf", "orf", "rw2"]
PROXIES = ["jpg", "jpeg", "heic", "heif", "png"]


def drop_display_proxies(files: DataFrame, path: str = "path", order: str | None = None) -> DataFrame:
    """One row per path, without display pictures whose stem is that of a scientific original.

    Of repeated paths the first in ``order`` stays (an aggregate, not a window, so a path repeated without end is fine)."""
    require_columns(files, [path] + ([order] if order else []), "files")
    pick = F.min(order) if order else F.count(F.lit(1))
    rows = files.groupBy(path).agg(pick.alias(order or "copies"))
    lower = F.lower(path)
    rows = rows.withColumns({"_ext": F.regexp_extract(lower, r"\.([^./]*)$", 1), "_stem": F.regexp_replace(lower, r"\.[^./]*$", "")})
    originals = rows.where(F.col("_ext").isin(ORIGINALS)).select("_stem").distinct()
    pictures = rows.where(F.col("_ext").isin(PROXIES)).join(originals, "_stem", "left_anti")
    return rows.where(~F.col("_ext").isin(PROXIES)).unionByName(pictures).drop("_ext", "_stem")


def split_leakage(manifest: DataFrame) -> DataFrame:
    """Violations of a case list ``case_id grp split sha minimum maximum``: (rule, subject, count)."""
    require_columns(manifest, ["case_id", "grp", "split", "sha", "minimum", "maximum"], "manifest")
    rule = lambda df, name, subject, count: df.select(F.lit(name).alias("rule"), F.col(subject).cast("string").alias("subject"), count.cast("bigint").alias("count"))
    splits = manifest.groupBy("grp").agg(F.countDistinct("split").alias("n")).where("n > 1")
    ids = manifest.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hashes = manifest.groupBy("sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    one = F.lit(1)
    out = rule(splits, "group-crosses-splits", "grp", F.col("n")).unionByName(
        rule(ids, "duplicate-id", "case_id", F.col("n"))).unionByName(rule(hashes, "duplicate-content", "sha", F.col("n")))
    for name, bad in (("split-unknown", ~F.col("split").isin("development", "evaluation")), ("group-missing", F.col("grp").isNull() | (F.col("grp") == "")),
                      ("bounds-missing", F.col("minimum").isNull() & F.col("maximum").isNull()), ("bounds-inverted", F.col("minimum") > F.col("maximum")),
                      ("bounds-negative", (F.col("minimum") < 0) | (F.col("maximum") < 0))):
        out = out.unionByName(rule(manifest.where(bad), name, "case_id", one))
    return out


def label_conformance(results: DataFrame, expectations: DataFrame, id_col: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """(verdict per expected case, totals). A case passes if its count lies within the bounds it has."""
    require_columns(results, [id_col, "observed"], "results")
    require_columns(expectations, [id_col, "minimum", "maximum"], "expectations")
    rows = expectations.join(results.select(id_col, "observed"), id_col, "left")
    processed = F.col("observed").isNotNull()
    low = F.col("minimum").isNull() | (F.col("observed") >= F.col("minimum"))
    high = F.col("maximum").isNull() | (F.col("observed") <= F.col("maximum"))
    reason = F.when(~processed, "not-processed").when(~low, "below-minimum").when(~high, "above-maximum")
    verdicts = rows.select(id_col, "observed", reason.isNull().alias("passed"), reason.alias("reason"))
    totals = verdicts.agg(F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.when(~F.col("passed"), 1)).alias("failed"),
                          F.count("observed").alias("processed"), F.count(F.lit(1)).alias("cases"))
    return verdicts, totals


def require_empty(problems: DataFrame, what: str) -> None:
    """Fail with the first few problems; only these rows reach the driver."""
    first = problems.limit(5).collect()
    require(not first, f"{what}: {[r.asDict() for r in first]}")

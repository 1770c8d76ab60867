"""Exact top-k by inner product over a pivot-distance index.

The largest inner product is a nearest-neighbour search after one more coordinate: with M the largest norm,
``|(q, 0) - (x, sqrt(M^2 - |x|^2))|^2 = |q|^2 + M^2 - 2 q.x``. Every vector is keyed by its nearest pivot and its distance
from it. A query starts at its own distance from a pivot, expands over the sorted annuli on both sides, and stops where the
triangle inequality, ``|d(q, p) - d(x, p)| <= d(q, x)``, shows that nothing farther can reach its k-th score.

Pivots come from a bounded sample, which also gives each query a first lower bound of its k-th score; all rows are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .store import cut

#: Score of what takes no part (its negative is a 64-bit integer too), and the largest score that is told apart.
NONE = -(2**63 - 1)
MOST = 2**63 - 2
#: Rows of the sample, pivots, rows of a data block and of a query block, and rows expanded at a time. A data block is sent
#: once per query block that may reach it, so query blocks are large.
SAMPLE, PIVOTS, DATA, QUERY, STEP = 2048, 16, 16384, 8192, 512


def integer_vectors(df: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v``: components as floor(scale * x); vectors that are null or hold null or non-finite components go."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    return df.where(F.coalesce(good, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(scale * c.cast("double"))).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows as float64; a shorter vector goes on with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dims))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as integers: floats while they are exact, else 64-bit integers; pairs that may pass 64 bits are
    computed without bounds, one by one, and cut to ``MOST`` on either side."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    size_a, size_b = np.abs(a).max(1), np.abs(b).max(1)
    bound = a.shape[1] * size_a.max() * size_b.max()
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.clip(x, -(2.0**62), 2.0**62).astype(np.int64)
    out = whole(a) @ whole(b).T
    if bound >= 2**62:
        large = a.shape[1] * size_a[:, None] * size_b[None] >= 2**62
        for j in np.flatnonzero(large.any(0)):
            vector = [int(v) for v in b[j]]
            for i in np.flatnonzero(large[:, j]):
                out[i, j] = max(-MOST, min(MOST, sum(int(u) * v for u, v in zip(a[i], vector, strict=True))))
    return out


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(largest - np.einsum("ij,ij->i", x, x), 0))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres of the sample: farthest-first starts, then a few rounds of means."""
    at = [0]
    near = distances(sample, sample[:1])[:, 0]
    for _ in range(min(n, len(sample)) - 1):
        at.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[at[-1:]])[:, 0])
    pivots = sample[at].copy()
    for _ in range(rounds):
        own = distances(sample, pivots).argmin(1)
        for p in range(len(pivots)):
            if (own == p).any():
                pivots[p] = sample[own == p].mean(0)
    return pivots


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= least)
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))[:k]]


def top_k(vectors: DataFrame, is_query, k: int = 20, sample: int = SAMPLE, n_pivots: int = PIVOTS, data_rows: int = DATA, query_rows: int = QUERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vec_id, v`` (integers) that ``is_query`` holds for, the k other
    rows with the largest inner products, ties to the smaller vec_id; all of them where there are fewer than k.

    A ``vec_id`` names one vector: where rows share an id, the one whose vector sorts first (as Spark sorts arrays) stands
    for it and the others take no part, so exact repeats count once. Rows without an id take no part; vectors repeated
    under other ids are rows of their own. Vectors of unequal length are compared as if the shorter went on with zeros.
    Components are 64-bit integers (larger ones are the largest), scores too: those beyond ``MOST`` count as ``MOST``,
    ties to the smaller vec_id. An empty table gives no rows.
    Blocks hold about ``data_rows`` rows: a pivot with more, for example because one vector is a third of the table, is
    dealt into several by a hash of the id.
    """
    vectors = cut(vectors.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")))
    dims, largest = vectors.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))).first()
    if dims is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    # A bounded sample, the same whatever the partitions.
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    base, base_ids = matrix(some.column("v"), dims), some.column("vec_id").to_numpy()
    pivots = choose_pivots(lifted(base, largest), n_pivots)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(lifted(matrix(batch.column(1), dims), largest), pivots)
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(d[np.arange(len(d)), own])],
                                             names=["vec_id", "v", "pivot", "r"])

    keyed = vectors.select("vec_id", "v").mapInArrow(key, "vec_id bigint, v array<bigint>, pivot int, r double")
    sizes = keyed.groupBy("pivot").agg(F.ceil(F.count("*") / data_rows).cast("int").alias("parts"), F.min("r").alias("near"), F.max("r").alias("far"))
    plan = {r["pivot"]: r for r in sizes.collect()}  # one row per pivot
    parts = F.create_map([F.lit(x) for p, r in plan.items() for x in (p, r["parts"])])
    data = keyed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts[F.col("pivot")]).cast("int"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its lower bound and the pivots it cannot rule out."""
        for batch in batches:
            q, ids = matrix(batch.column(1), dims), batch.column(0).to_numpy()
            score = products(q, base)
            score[base_ids[None] == ids[:, None]] = NONE
            least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), NONE)
            d = distances(np.column_stack([q, np.zeros(len(q))]), pivots)
            reach = radius(q, least, largest)
            gap = np.stack([np.maximum(np.maximum(d[:, p] - r["far"], r["near"] - d[:, p]), 0) for p, r in plan.items()], 1)
            row, col = np.nonzero(gap <= reach[:, None])
            names = np.array(list(plan))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), batch.column(1).take(pa.array(row)), pa.array(least[row]), pa.array(names[col], pa.int32()), pa.array(d[row, names[col]])],
                names=["query_id", "q", "least", "pivot", "dq"])

    queries = vectors.where(is_query).select("vec_id", "v")
    n_blocks = max(1, -(-queries.count() // query_rows))
    asked = queries.mapInArrow(bound, "query_id bigint, q array<bigint>, least bigint, pivot int, dq double").select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), parts[F.col("pivot")] - 1)).alias("part"))
    pairs = asked.select("pivot", "block", "part").distinct()
    spread = data.join(pairs, ["pivot", "part"]).toDF("pivot", "part", "vec_id", "v", "r", "block")

    def search(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ring = np.argsort(right.column("r").to_numpy(), kind="stable")
            right = right.take(pa.array(ring))
            x, r, ids = matrix(right.column("v"), dims), right.column("r").to_numpy(), right.column("vec_id").to_numpy()
            # Queries that start at about the same annulus expand together.
            left = left.take(pa.array(np.argsort(left.column("dq").to_numpy(), kind="stable")))
            q, dq, least, qid = matrix(left.column("q"), dims), left.column("dq").to_numpy(), left.column("least").to_numpy().copy(), left.column("query_id").to_numpy()
            for first in range(0, len(q), 128):
                part = slice(first, first + 128)
                for name, values in zip(out, expand(q[part], qid[part], dq[part], least[part], x, r, ids, k, largest), strict=True):
                    out[name].append(values)
        return pa.table({n: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for n, v in out.items()})

    asked = asked.toDF(*asked.columns)
    found = asked.groupBy("pivot", "block", "part").cogroup(spread.groupBy("pivot", "block", "part")).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def radius(q: np.ndarray, least: np.ndarray, largest: float) -> np.ndarray:
    """Farthest distance at which a score of ``least`` is still possible, widened by what rounding may do to squares of
    the largest norm; without bound while ``least`` stands for everything below it."""
    square = np.einsum("ij,ij->i", q, q) + largest - 2 * least.astype(float)
    reach = np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-6 + 2.0**-24 * np.sqrt(largest)
    return np.where(least <= -MOST, np.inf, reach)


def expand(q, qid, dq, least, x, r, ids, k, largest):
    """Best k of one block for some queries with like distances from the pivot: annuli outwards from theirs, stopping
    when no query can gain from what is left on either side. (query ids, vector ids, scores)"""
    low = high = int(np.searchsorted(r, np.median(dq)))
    best_s = np.zeros((len(q), 0), np.int64)
    best_i = np.zeros((len(q), 0), np.int64)
    least = least.copy()
    while low > 0 or high < len(r):
        reach = radius(q, least, largest)
        inside = low > 0 and bool((dq - r[low - 1] <= reach).any())
        outside = high < len(r) and bool((r[high] - dq <= reach).any())
        if not inside and not outside:
            break
        a, b = (max(0, low - STEP) if inside else low), (min(len(r), high + STEP) if outside else high)
        places = np.concatenate([np.arange(a, low), np.arange(high, b)])
        low, high = a, b
        score = products(q, x[places])
        score[ids[places][None] == qid[:, None]] = NONE
        score[score < least[:, None]] = NONE
        every_s, every_i = np.concatenate([best_s, score], 1), np.concatenate([best_i, np.broadcast_to(ids[places], score.shape)], 1)
        keep = [top(s, i, k) for s, i in zip(every_s, every_i, strict=True)]
        best_s = np.stack([s[p] for s, p in zip(every_s, keep, strict=True)])
        best_i = np.stack([i[p] for i, p in zip(every_i, keep, strict=True)])
        if best_s.shape[1] == k:
            least = np.maximum(least, best_s[:, -1])
    row, col = np.nonzero(best_s > NONE)
    return qid[row], best_i[row, col], best_s[row, col]


def query(spark, sf_dir: str) -> DataFrame:
    """op8: 20 best of every twentieth vector."""
    return top_k(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.expr("vec_id % 20 = 0"))


QUERIES = {"op8_exact_top_k": query}
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
ORACLES = {"op8_exact_top_k": SQL}

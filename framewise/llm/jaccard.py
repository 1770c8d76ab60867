"""N-gram Jaccard join by chosen paths.

Each text is the set of its five-word shingles; texts with one set are one class. A class walks down a random tree: at a
node it goes on with each of its shingles that the node's hash selects, ``branch`` on average, and after ``depth`` steps it
is in the leaves its path has reached. Classes that share most shingles select the same ones and meet in a leaf, classes
that share a line or two hardly ever do. Runs with other hashes are repeated until the target recall.

Leaves are small sets of classes that are compared with each other, all with all, inside a task; a leaf with more classes
than a block holds is dealt into pairs of blocks. Only a forest of the true links leaves a task. Connected classes are then
compared once more, block by block, which gives every class its exact number of links without a row per link.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .store import bit_filter, cut, may_hold, small_batches

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.995
#: Shingles chosen at a node on average, steps of a path, and classes that are compared at once.
BRANCH, DEPTH, BLOCK = 3.0, 2, 2048


def runs_needed(similarity: float, recall: float, branch: float = BRANCH, depth: int = DEPTH) -> int:
    """Runs after which two classes just at ``similarity`` share a leaf with probability ``recall``.

    They share at least that part of the larger set, so a node has a common choice with probability 1 - exp(-branch *
    similarity * s), where s is the probability one step further down."""
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-branch * similarity * meets)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def leaves(values: np.ndarray, runs: int, branch: float, depth: int) -> np.ndarray:
    """Hashes of the leaves that a set of shingle hashes reaches."""
    limit = np.uint64(min(2**64 - 1, int(2**64 * min(1.0, branch / max(1, len(values))))))
    nodes = X.mix(np.arange(1, runs + 1, dtype=np.uint64) * X.BASE)
    for _ in range(depth):
        children = [X.mix(values ^ node) for node in nodes]
        nodes = np.concatenate([X.mix(c[c <= limit] + node) for c, node in zip(children, nodes, strict=True)]) if len(nodes) else nodes
    return np.unique(nodes)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for rows, data, offsets in X.blocks(column):
        start, end, text = X.words(data, offsets)
        grams, owner = X.shingles(X.spans_hash(X.prefixes(data, X.FOLDED), start, end), text, len(offsets) - 1, width)
        bounds = X.runs(owner, len(offsets) - 1)
        for i in range(len(offsets) - 1):
            yield rows.start + i, np.unique(grams[bounds[i]:bounds[i + 1]])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("r1"), F.xxhash64(text, F.lit(7), "doc_id").alias("r2"))


def signatures(docs: DataFrame, width: int, runs: int, branch: float, depth: int) -> DataFrame:
    """``doc_id, r1, r2, s1, s2, size, leaves`` of every document; (s1, s2) name its set of shingles."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s1, s2, size, paths = [], [], [], []
            for _, grams in shingle_sets(batch.column(3), width):
                s1.append(np.bitwise_xor.reduce(X.mix(grams + np.uint64(1))) if len(grams) else np.uint64(0))
                s2.append(np.sum(X.mix(grams ^ X.BASE), dtype=np.uint64))
                size.append(len(grams))
                paths.append(leaves(grams, runs, branch, depth).view(np.int64) if len(grams) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.array(s1, np.uint64).view(np.int64)), pa.array(np.array(s2, np.uint64).view(np.int64)),
                 pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(paths) if paths else np.zeros(0, np.int64)))],
                names=["doc_id", "r1", "r2", "s1", "s2", "size", "leaves"])

    return _rows(docs).select("doc_id", "r1", "r2", "text").mapInArrow(
        run, f"doc_id {id_type}, r1 bigint, r2 bigint, s1 bigint, s2 bigint, size bigint, leaves array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``r1, s1, s2, grams`` of the documents whose r1 is in the single column ``wanted``, or a few more."""
    bitmap = bit_filter(wanted, 24)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(bitmap, batch.column(0).to_numpy().view(np.uint64))))
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [g for _, g in shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g.astype("<u8").tobytes() for g in found], pa.binary())], names=["r1", "grams"])

    return _rows(docs).select("r1", "text").mapInArrow(run, "r1 bigint, grams binary")


def similar(sets: list[np.ndarray], similarity: float, split: int | None = None) -> np.ndarray:
    """Matrix of which sets have a Jaccard similarity of at least ``similarity``."""
    sizes = np.array([len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[token] > 1
    _, token = np.unique(token[shared], return_inverse=True)
    row = row[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
        a, b = np.searchsorted(token, [first, first + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[row[a:b], token[a:b] - first] = 1
        common += has @ has.T
    # In integers where the threshold is a ratio of small ones, so that ties count.
    return common.astype(float) * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None]) - 1e-9


def in_groups(df: DataFrame, keys: list[str], begin: Callable[[], Callable[[pa.Table], pa.RecordBatch]], schema: str) -> DataFrame:
    """A function of the group for each group of ``keys``, made anew by ``begin`` in every task; groups are small by
    construction and several lie in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        solve = begin()
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            edges = _edges(table, keys)
            for a, b in zip(edges[:-2], edges[1:-1], strict=True):
                yield solve(table.slice(a, b - a))
            # A copy of the last group, so that the batch it came in can go.
            last = table.slice(edges[-2])
            held = last.take(pa.array(np.arange(last.num_rows))).combine_chunks().to_batches()
            del table, batch, last
        if held:
            table = pa.Table.from_batches(held)
            yield solve(table)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _edges(table: pa.Table, keys: list[str]) -> list[int]:
    change = np.zeros(table.num_rows - 1, bool)
    for k in keys:
        v = table.column(k).to_numpy()
        change |= v[1:] != v[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]


def in_blocks(members: DataFrame, group: str, block: int) -> DataFrame:
    """Rows of ``group`` dealt into pairs of blocks ``bi <= bj`` with ``side`` (the row's own block): every two rows of a
    group meet in the pair of their blocks."""
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    dealt = members.join(sizes, group, "left").na.fill(1, ["blocks"]).withColumn("side", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int"))
    return (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("bi", F.least("side", "other")).withColumn("bj", F.greatest("side", "other")).drop("other", "blocks"))


def _distinct(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Sets, s1, s2 and rows of the table's distinct classes."""
    s1, s2 = table.column("s1").to_numpy(), table.column("s2").to_numpy()
    _, first = np.unique(np.stack([s1, s2]), axis=1, return_index=True)
    first.sort()
    grams = table.column("grams")
    return [np.frombuffer(grams[int(i)].as_buffer(), "<u8") for i in first], s1[first], s2[first], first


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node of each connected component of ``a, b``; rounds of taking the least root among the
    neighbours and of jumping to the root's root, until nothing changes."""
    both = cut(edges.union(edges.select("b", "a")).toDF("node", "other").distinct())
    roots = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")))
    while True:
        near = both.join(roots.toDF("other", "next"), "other").groupBy("node").agg(F.min("next").alias("next"))
        hooked = roots.join(near, "node").select("node", "root", F.least("root", "next").alias("to"))
        # The old root learns of the smaller one as well.
        pull = hooked.groupBy(F.col("root").alias("node")).agg(F.min("to").alias("pulled"))
        step = hooked.join(pull, "node", "left").select("node", "root", F.least("to", "pulled").alias("to"))
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new = cut(step.join(jump, "to").select("node", F.col("root").alias("old"), F.least("to", "far").alias("root")))
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        roots = new.select("node", "root")


def classes_and_links(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, recall: float = RECALL, branch: float = BRANCH,
                      depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """``doc_id, class_id, n_links, r1, r2, class_key`` of every document.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z become lower case; a text of fewer than ``width`` words is
    one shingle. Documents are linked if their sets of shingles have a Jaccard similarity of ``similarity`` or more;
    ``class_id`` is the least doc_id of those connected by links, ``n_links`` the number of other rows linked to this one.
    Repeated rows are rows of their own and linked. A text without words, or null, has no links and is its own class. Rows
    with a null id take part, their id just does not name a class. An empty table gives no rows; other columns are ignored.
    (r1, r2) name a row by its id and text, ``class_key`` names its class, null for a text without words.
    """
    docs = docs.select("doc_id", "text")
    signed = cut(signatures(docs, width, runs_needed(similarity, recall, branch, depth), branch, depth))
    classes = cut(signed.where("size > 0").groupBy("s1", "s2").agg(F.count("*").alias("copies"), F.min("r1").alias("r1"), F.min("doc_id").alias("least")))
    placed = signed.where("size > 0").select(F.explode("leaves").alias("leaf"), "s1", "s2")
    shared = placed.groupBy("leaf").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("leaf")
    members = cut(placed.distinct().join(shared, "leaf"))
    # Leaves with the same classes count once.
    kinds = members.groupBy("leaf").agg(F.count("*").alias("n"), F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2"))
    chosen = kinds.groupBy("n", "x1", "x2").agg(F.min("leaf").alias("leaf")).select("leaf")
    named = cut(members.join(chosen, "leaf").join(classes.select("s1", "s2", "r1"), ["s1", "s2"]))
    sets = sets_of(docs, named.select("r1").distinct(), width)

    def linker() -> Callable[[pa.Table], pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = x = above.get(above[x], above[x])
            return x

        def link(table: pa.Table) -> pa.RecordBatch:
            groups, s1, _, _ = _distinct(table)
            near, names, out = similar(groups, similarity), s1.tolist(), []
            new = np.ones(len(names), bool)
            while new.any():
                first = int(new.argmax())
                reached = np.zeros(len(names), bool)
                reached[first], front = True, np.array([first])
                while len(front):
                    grown = near[front].any(0) & ~reached
                    reached |= grown
                    front = np.flatnonzero(grown)
                new &= ~reached
                # What connects classes that the task has not connected so far.
                for j in np.flatnonzero(reached):
                    a, b = root(names[first]), root(names[j])
                    if a != b:
                        above[a] = b
                        out.append((names[first], names[j]))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

        return link

    dealt = in_blocks(named, "leaf", block).join(sets, "r1").select("leaf", "bi", "bj", "s1", "s2", "grams")
    edges = in_groups(dealt, ["leaf", "bi", "bj"], linker, "a bigint, b bigint")
    with small_batches(docs.sparkSession, 512):
        edges = cut(edges)
    roots = cut(components(edges))
    grouped = cut(roots.join(classes, roots["node"] == classes["s1"]).select("root", "s1", "s2", "r1", "copies", "least"))

    def count(table: pa.Table) -> pa.RecordBatch:
        groups, s1, s2, first = _distinct(table)
        copies, side = table.column("copies").to_numpy()[first], table.column("side").to_numpy()[first]
        near = similar(groups, similarity)
        np.fill_diagonal(near, False)
        if table.column("bi")[0].as_py() != table.column("bj")[0].as_py():
            near &= side[:, None] != side[None]
        return pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.array(near.astype(np.int64) @ copies)], names=["s1", "s2", "links"])

    again = sets_of(docs, grouped.select("r1").distinct(), width)
    paired = in_blocks(grouped, "root", block).join(again, "r1").select("root", "bi", "bj", "side", "s1", "s2", "copies", "grams")
    links = in_groups(paired, ["root", "bi", "bj"], lambda: count, "s1 bigint, s2 bigint, links bigint").groupBy("s1", "s2").agg(F.sum("links").alias("links"))
    with small_batches(docs.sparkSession, 512):
        links = cut(links)
    least = grouped.groupBy("root").agg(F.min("least").alias("class_id"))
    known = grouped.join(least, "root").join(links, ["s1", "s2"]).select("s1", "s2", "class_id", "links", "root")
    each = (classes.join(known, ["s1", "s2"], "left").select(
        "s1", "s2", F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "s1").alias("class_key")))
    full = signed.where("size > 0").join(each, ["s1", "s2"]).select("doc_id", "class_id", "n_links", "r1", "r2", "class_key")
    empty = signed.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), "r1", "r2", F.lit(None).cast("bigint").alias("class_key"))
    return full.unionByName(empty)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class of linked documents, the one with the least id; texts without words all stay."""
    found = classes_and_links(docs, **options)
    first = (found.where("class_key is not null").groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("k"))
             .select("k.r1", "k.r2", F.lit(True).alias("single")))
    rest = found.where("class_key is null").select("r1", "r2", F.lit(False).alias("single")).distinct()
    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("all"), F.xxhash64("doc_id", text).alias("r1"), F.xxhash64(text, F.lit(7), "doc_id").alias("r2"))
    kept = rows.join(cut(first.unionByName(rest)), ["r1", "r2"])
    # Rows that are equal in id and text share a name; one of them stays.
    return kept.where("single").dropDuplicates(["r1", "r2"]).unionByName(kept.where("not single")).select("all.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: class and links of every document."""
    return classes_and_links(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


QUERIES = {"op10_ngram_jaccard_join": query}

WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 5 * c.c >= 4 * (p.n + q.n - c.c)),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.m)
SELECT doc_id, min(m) AS class_id, coalesce(any_value(l.k), 0) AS n_links
FROM r LEFT JOIN (SELECT x, count(*) AS k FROM e GROUP BY x) l ON l.x = r.doc_id GROUP BY doc_id
"""
ORACLES = {"op10_ngram_jaccard_join": SQL}

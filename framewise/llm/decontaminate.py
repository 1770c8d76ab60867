"""Benchmark decontamination by a prefix-filtered containment join.

A window is ``width`` consecutive words of a benchmark item; it occurs in a document only if all of its short word
shingles do, each at its own place. So the join needs one necessary shingle per window: shingles are ordered by how often
the documents have them, the rarest of each window is its prefix, and windows with a shingle that no document has are out.
Documents emit the places of prefix shingles only; the place of the shingle in the window gives the one possible start
(positional bound), the document's length the rest (length bound), and the words there are then compared one by one.

Documents never travel: two passes over their texts, each thinned by a bitmap of fixed size, and exact joins of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X
from .store import bit_filter, cut, may_hold

WIDTH, SHINGLE = 13, 4


def _lower(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def benchmark_windows(items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """``item, words, n, tokens``: the distinct windows of each item; ``tokens`` are its shingles as (h, at)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for rows, data, offsets in X.blocks(batch.column(1)):
                low = _lower(data)
                start, end, text = X.words(data, offsets)
                h = X.spans_hash(X.prefixes(data, X.FOLDED), start, end)
                item, words, n, tokens = [], [], [], []
                bounds = X.runs(text, len(offsets) - 1).tolist()
                for t, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    size = min(width, b - a)
                    seen = set()
                    for i in range(a, b - size + 1 if size else a):
                        value = b" ".join(low[start[j]:end[j]].tobytes() for j in range(i, i + size)).decode()
                        if value in seen:
                            continue
                        seen.add(value)
                        grams, _ = X.shingles(h[i:i + size], np.zeros(size, np.int64), 1, shingle)
                        item.append(rows.start + t)
                        words.append(value)
                        n.append(size)
                        tokens.append([{"h": int(g), "at": k} for k, g in enumerate(grams.view(np.int64))])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(item, pa.int64())), pa.array(words, pa.string()), pa.array(n, pa.int32()),
                     pa.array(tokens, pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32())])))], names=["item", "words", "n", "tokens"])

    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string")).mapInArrow(
        windows, "item string, words string, n int, tokens array<struct<h: bigint, at: int>>")


def _doc_shingles(column: pa.Array, sizes: list[int], shingle: int):
    """Per block: rows, lower-case bytes, word bounds, text numbers and (hash, first word) of all shingles of ``sizes``."""
    for rows, data, offsets in X.blocks(column):
        start, end, text = X.words(data, offsets)
        h = X.spans_hash(X.prefixes(data, X.FOLDED), start, end)
        grams, first = [], []
        for size in sizes:
            m = len(h) - size + 1
            if m <= 0:
                continue
            whole = np.zeros(m, np.uint64)
            weight = X.powers(X.BASE, size)
            for j in range(size):
                whole += h[j:m + j] * weight[j]
            at = np.flatnonzero(text[:m] == text[size - 1:])
            grams.append(X.mix(whole[at] + (np.uint64(size) if size < shingle else np.uint64(0))))
            first.append(at)
        yield (rows, data, start, end, text, len(offsets) - 1, np.concatenate(grams) if grams else np.zeros(0, np.uint64),
               np.concatenate(first) if first else np.zeros(0, np.int64))


def shingle_counts(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], shingle: int) -> DataFrame:
    """``h, seen``: how often each shingle that may be in the bitmap is in the documents, summed per block first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, grams, _ in _doc_shingles(batch.column(0), sizes, shingle):
                h, seen = np.unique(grams[may_hold(bitmap, grams)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(seen)], names=["h", "seen"])

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "h bigint, seen bigint").groupBy("h").agg(F.sum("seen").alias("seen"))


def row_name() -> Column:
    text = F.col("text").cast("string")
    return F.concat_ws("-", F.hex(F.xxhash64("doc_id", text)), F.hex(F.xxhash64(text, F.lit(7), "doc_id")))


def probe(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], shingle: int, width: int) -> DataFrame:
    """One row per document, ``row, doc_id, n_words, places``: the prefix shingles in it, each as (h, at, before, around):
    its first word's number, how many words of the context stand before it, and that context. ``row`` names a document by
    what it holds, so that a repeated pass gives the same name; equal rows share it and have equal results."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    place = pa.struct([("h", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, start, end, text, n, grams, first in _doc_shingles(batch.column(2), sizes, shingle):
                low = _lower(data)
                bounds = X.runs(text, n)
                places: list[list[dict]] = [[] for _ in range(n)]
                for k in np.flatnonzero(may_hold(bitmap, grams)):
                    w = int(first[k])
                    t = int(text[w])
                    a, b = max(int(bounds[t]), w - width + 1), min(int(bounds[t + 1]), w + width)
                    around = b" ".join(low[start[j]:end[j]].tobytes() for j in range(a, b)).decode()
                    places[t].append({"h": int(grams[k].view(np.int64)), "at": w - int(bounds[t]), "before": w - a, "around": around})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], batch.column(1)[rows], pa.array(np.diff(bounds)), pa.array(places, pa.list_(place))],
                    names=["row", "doc_id", "n_words", "places"])

    return docs.select(row_name().alias("row"), "doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"row string, doc_id {id_type}, n_words bigint, places array<struct<h: bigint, at: bigint, before: int, around: string>>")


def find_windows(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, bits: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents ``row, doc_id, n_words``, hits ``row, at, n, words``, windows ``item, words``)."""
    windows = cut(benchmark_windows(items, width, shingle))
    tokens = windows.select("words", "n", F.explode("tokens").alias("t")).select("words", "n", "t.h", "t.at").distinct()
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(shingle))).distinct().collect())
    seen = shingle_counts(docs, bit_filter(tokens.select("h"), bits), sizes, shingle)
    prefix = cut(tokens.join(seen, "h", "left").na.fill(0, ["seen"]).groupBy("words", "n")
                 .agg(F.min(F.struct("seen", "h", "at")).alias("p")).where("p.seen > 0").select("words", "n", "p.h", F.col("p.at").alias("off")))
    probed = probe(docs, bit_filter(prefix.select("h"), bits), sizes, shingle, width)
    places = probed.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    hits = (places.join(prefix, "h").where("at >= off and at - off + n <= n_words")
            .where("array_join(slice(split(around, ' '), before - off + 1, n), ' ') = words")
            .select("row", (F.col("at") - F.col("off")).alias("at"), "n", "words").distinct())
    return probed.select("row", "doc_id", "n_words"), cut(hits), windows.select("item", "words")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """``row, doc_id, n_words, n_hit, n_items, items, spans, contaminated`` for every row of ``docs``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z become lower case. ``spans`` are the hit words as sorted,
    disjoint (first, end). A document is contaminated if hit words are at least one in ``share``. Null or wordless texts
    have no words and are clean; items without words have no window; an item with null id has the empty string as its
    id; repeated rows are judged one by one; without items or documents nothing is hit; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    rows, hits, owners = find_windows(docs, items, width, shingle)
    # Spans of one document are as many as it has words at most.
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b")))).alias("s"))
    union = F.expr("""aggregate(s, cast(array() as array<struct<a: bigint, b: bigint>>), (u, x) ->
        if(size(u) > 0 and x.a <= element_at(u, -1).b,
           concat(slice(u, 1, size(u) - 1), array(named_struct('a', element_at(u, -1).a, 'b', greatest(element_at(u, -1).b, x.b)))),
           concat(u, array(x))))""")
    named = (hits.select("row", "words").distinct().join(owners, "words").select("row", "item").distinct()
             .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    out = rows.join(spans.select("row", union.alias("spans")), "row", "left").join(named, "row", "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, x: t + x["b"] - x["a"]), F.lit(0).cast("bigint"))
    return (out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
                       F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")
            .withColumn("n_items", F.size("items").cast("bigint"))
            .withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words")))


def clean_only(docs: DataFrame, items: DataFrame, small: int = 100_000, **options) -> DataFrame:
    """``docs`` without the contaminated ones. Their names are sent to all tasks up to ``small``, beyond that joined."""
    bad = cut(contamination(docs, items, **options).where("contaminated").select("row").distinct())
    name = "_row_of_contamination"
    rows = docs.withColumn(name, row_name())
    bad = bad.withColumnRenamed("row", name)
    return rows.join(F.broadcast(bad) if bad.count() <= small else bad, name, "left_anti").drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: contamination of every document."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op2_benchmark_decontamination": query}

#: Numbers every word, compares windows as strings and marks the words of those that occur.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
ORACLES = {"op2_benchmark_decontamination": SQL}

"""Periodic runs of words, found by branching tandem repeats in an enhanced suffix array.

Texts are read in blocks. Every word becomes a symbol that no other text of the block has, so one suffix array holds those
of all texts, made by prefix doubling: each round sorts only suffixes that are still tied. Two suffixes i and i + d whose
longest common prefix is exactly d start a *branching* square, and every run of period d ends in one. An LCP interval of
depth d splits at each of its boundaries into two ranges of the suffix array. For the suffixes of the smaller range it is
enough to look whether ISA[i + d] or ISA[i - d] lies in the other one, which makes n log n looks and needs no tree. Squares
that cannot be rotated left far enough fall to two look-ups of a prefix hash; the others are rotated word by word, and squares
of one run, whose roots are powers of each other, are merged.

A text is never split and no row meets another, so there is no shuffle. Words are equal if 128 bits of them are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import text as X

#: A run repeats at least this often and has at least this many words.
REPEATS, LEAST = 4, 6


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, its inverse, ranks by the first 1, 2, 4, ... symbols). Symbols may be in any order; what lies behind
    the end is less than all of them."""
    n = len(symbols)
    order = np.argsort(symbols)
    ranked = symbols[order]
    rank = np.empty(n, np.int64)
    rank[order] = _group_starts(ranked[1:] != ranked[:-1])
    levels, width = [rank], 1
    while True:
        # Places of the order that share their rank with a neighbour.
        here = rank[order]
        same = here[1:] == here[:-1]
        tied = np.zeros(n, bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return order, rank, levels
        who = order[at]
        after = np.where(who + width < n, rank[np.minimum(who + width, n - 1)] + 1, 0)
        key = (here[at] << 32) | after
        by = np.argsort(key)
        order = order.copy()
        order[at] = who = who[by]
        key = key[by]
        # Groups of ties are contiguous in the order, so a rank is the first place of its group.
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[who] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append(rank)
        width *= 2


def _group_starts(change: np.ndarray) -> np.ndarray:
    """First place of the group of each element of a sorted column."""
    first = np.concatenate([[True], change])
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of every suffix of the array with the one before it (0 for the first), from the ranks of prefix doubling."""
    n = len(order)
    out = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    tied = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[tied], b[tied]
    got = np.zeros(len(tied), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) + got < n
        at = np.flatnonzero(inside)
        same = levels[k][a[at] + got[at]] == levels[k][b[at] + got[at]]
        got[at[same]] += 1 << k
    out[tied + 1] = got
    return out


def splits(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boundary, first place of its left range, last place of its right range) of all boundaries with a common prefix.

    The left range reaches back to a boundary of no greater depth, the right one ahead to a lesser depth; so two suffixes
    are parted by exactly one boundary, and its depth is their common prefix. Ranges are found by binary search over range
    minima of doubling width."""
    at = np.flatnonzero(lcp > 0)
    depth, n = lcp[at], len(lcp)
    minima, width = [lcp], 1
    low, high = at - 1, at
    # Widen until no range goes on.
    while True:
        back = np.maximum(at - width, 0)
        ahead = np.minimum(at + 1, n - 1)
        table = minima[-1]
        more = ((at - width >= 0) & (table[back] > depth)) | ((at + width < n) & (table[np.minimum(ahead, len(table) - 1)] >= depth))
        if not more.any() or width * 2 > n:
            break
        minima.append(np.minimum(table[:-width], table[width:]))
        width *= 2
    for k in range(len(minima) - 1, -1, -1):
        step, table = 1 << k, minima[k]
        # ``low`` is the first place of the left range: boundaries low + 1 ... at - 1 are deeper.
        able = low - step >= 0
        able &= table[np.maximum(low - step + 1, 0).clip(max=len(table) - 1)] > depth
        low = np.where(able, low - step, low)
        able = high + step < n
        able &= table[np.minimum(high + 1, len(table) - 1)] >= depth
        high = np.where(able, high + step, high)
    return at, low, high


def branching_squares(order: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of all squares whose first and second half differ in what follows them."""
    at, low, high = splits(lcp)
    depth, n = lcp[at], len(order)
    left, right = at - low, high - at + 1
    small = np.where(left <= right, low, at)
    many = np.minimum(left, right)
    other_low, other_high = np.where(left <= right, at, low), np.where(left <= right, high, at - 1)
    total = np.cumsum(many)
    which = np.repeat(np.arange(len(at)), many)
    i = order[small[which] + np.arange(len(which)) - (total - many)[which]]
    d = depth[which]
    starts, roots = [], []
    for j, start in ((i + d, i), (i - d, i - d)):
        fits = np.flatnonzero((j >= 0) & (j < n))
        there = place[j[fits]]
        hit = fits[(there >= other_low[which[fits]]) & (there <= other_high[which[fits]])]
        starts.append(start[hit])
        roots.append(d[hit])
    return np.concatenate(starts), np.concatenate(roots)


def runs(symbols: np.ndarray, begin: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs, sorted; ``begin`` says where the text of each symbol starts. ``repeats`` is
    two at least."""
    none = np.zeros((0, 3), np.int64)
    if len(symbols) < max(least, 2):
        return none
    order, place, levels = suffix_array(symbols)
    start, d = branching_squares(order, place, common_prefixes(order, levels))
    ids = levels[0]
    end = start + 2 * d
    # The run must hold the words from ``first`` on: equal hashes of the two shifted stretches are necessary.
    first = end - np.maximum(repeats * d, np.maximum(least, 2 * d))
    able = first >= begin[start]
    start, d, end, first = start[able], d[able], end[able], first[able]
    if not len(start):
        return none
    prefix = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(X.mix(ids.astype(np.uint64) + np.uint64(1)) * X.powers(X.BASE, len(ids)), out=prefix[1:])
    ends = end - d
    able = X.spans_hash(prefix, first, ends) == X.spans_hash(prefix, first + d, end)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for e, q, b in sorted(zip(end[able].tolist(), d[able].tolist(), begin[start[able]].tolist(), strict=True), key=lambda r: r[:2]):
        known = found.setdefault(e, [])
        # The same run under a power of its root.
        if any(q % p == 0 and e - s >= 2 * q for s, _, p in known):
            continue
        s = rotate_left(ids, b, e, q)
        if e - s >= max(least, repeats * q):
            known.append((s, e, q))
    out = sorted(r for rows in found.values() for r in rows)
    return np.array(out, np.int64).reshape(-1, 3) if out else none


def rotate_left(ids: np.ndarray, begin: int, end: int, period: int) -> int:
    """First word from which on all words up to ``end`` equal the one a period later, not before ``begin``."""
    high, size = end - period, 64
    while high > begin:
        low = max(begin, high - size)
        differs = np.flatnonzero(ids[low:high] != ids[low + period:high + period])
        if len(differs):
            return low + int(differs[-1]) + 1
        high, size = low, size * 2
    return begin


def collapse(found: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stay: those in no run, or only among the first period of runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def join_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, n_texts: int) -> pa.Array:
    """The given words of each text with one space between them."""
    size = end - start + 1
    total = np.cumsum(size)
    where = np.repeat(start - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)
    out = data[np.minimum(where, max(len(data) - 1, 0))] if len(where) else np.zeros(0, np.uint8)
    out[total - 1] = 32
    bounds = np.concatenate([[0], total])[X.runs(text, n_texts)]
    # A text ends before its last space.
    inside = np.ones(len(out), bool)
    filled = bounds[1:] > bounds[:-1]
    inside[bounds[1:][filled] - 1] = False
    offsets = bounds - np.concatenate([[0], np.cumsum(filled)])
    return pa.Array.from_buffers(pa.large_string(), n_texts, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[inside])]).cast(pa.string())


def word_symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A 64-bit symbol per word and text; words that 128 bits tell apart have different ones."""
    one = X.spans_hash(X.prefixes(data, X.EXACT), start, end)
    two = X.spans_hash(X.prefixes(data, PLAIN), start, end)
    own = X.mix(one + X.mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    if (same & ((two[order][1:] != two[order][:-1]) | (text[order][1:] != text[order][:-1]))).any():
        _, own = np.unique(np.stack([text.astype(np.uint64), one, two], 1), axis=0, return_inverse=True)
        own = own.ravel().astype(np.uint64)
    return own


PLAIN = X.byte_table(4)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS, least: int = LEAST,
                  reread: Callable[[int, int | None], np.ndarray | None] | None = None, seed_col: str | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of each text's words as (start, length, period), sorted by start, then
    period, and the text without the words a run repeats, one space between words.

    Words are what stands between white space. A run is a stretch of words with smallest period q that is at least
    ``repeats`` periods and ``least`` words long and that no neighbouring word continues. ``reread``, if given, takes the
    number of words and the row's ``seed_col`` and returns which word to read at each place (None: as they stand).

    Every row gives one row, repeated ones too; null and empty texts have no words, no runs and an empty text; the id may be
    of any type and null; other columns are ignored. An empty table gives no rows.
    """
    seed = F.lit(None).cast("bigint") if seed_col is None else F.col(seed_col).cast("bigint")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column(2).to_pylist() if reread is not None else []
            for rows, data, offsets in X.blocks(batch.column(1)):
                n = len(offsets) - 1
                start, end, text = X.words(data, offsets, X.DARK)
                bounds = X.runs(text, n)
                if reread is not None:
                    for t in range(n):
                        a, b = int(bounds[t]), int(bounds[t + 1])
                        other = reread(b - a, seeds[rows.start + t])
                        if other is not None:
                            start[a:b], end[a:b] = start[a:b][other], end[a:b][other]
                found = runs(word_symbols(data, start, end, text), bounds[text], repeats, least)
                stay = collapse(found, len(start))
                owner = text[found[:, 0]] if len(found) else np.zeros(0, np.int64)
                values = pa.StructArray.from_arrays([pa.array(found[:, 0] - bounds[owner]), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])],
                                                    fields=list(run_type))
                lists = pa.ListArray.from_arrays(pa.array(X.runs(owner, n).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(np.diff(bounds)), lists, join_words(data, start[stay], end[stay], text[stay], n)],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType),
                         *StructType.fromDDL("n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").fields])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), seed.alias("seed")).mapInArrow(solve, schema)


def looped(n: int, h: int | None) -> np.ndarray | None:
    """Every tenth text (by the checksum h of its id) is read in a loop from some word on."""
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: digests of the runs of every document and of what is left when they are collapsed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    out = periodic_runs(docs, reread=looped, seed_col="h")
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return (out.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


QUERIES = {"op13_periodic_runs": query}
ORACLES: dict[str, str] = {}

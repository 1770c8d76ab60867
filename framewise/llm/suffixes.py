"""Removal of byte strings that occur more than once, by a sparse, hash-compared suffix sort.

A string of ``length`` bytes has one *anchor*: the ``gram`` bytes in it with the least hash (the first of equals). Equal
strings have their anchors at the same place, so only suffixes that start at anchors need sorting, about one in 70 bytes.
All strings with one anchor lie in its *hull*. Spark counts anchors by their bytes' hash:

* one hull for all occurrences: the whole hull repeats;
* several hulls: one context of each goes to a task with the others of its anchor, where the contexts are mergesorted to
  the right of the anchor and (reversed) to its left. Comparisons take logarithmic time: prefix polynomial hashes and binary
  search give the common extension, which is then verified on the bytes. Strings are equal if they share both runs.

Counts are combined before every shuffle, and anchors with more contexts than a task should hold are dealt into parts; the
distinct strings of the parts are then counted across them. Texts are read where they lie; they travel once, to be cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import text as X
from .store import bit_filter, cut, may_hold

LENGTH, GRAM = 200, 64
#: Places of one hull that may meet in one task, and tasks that those of a more crowded one are dealt over.
CROWD, SALTS = 1000, 64
#: Contexts of one anchor in one task, and rows of a table that may be broadcast.
PART, SMALL = 4096, 100_000


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(anchor, first window, last window, anchor hash, hull hash) of all windows of ``length`` bytes in a block."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    prefix = X.prefixes(data, X.EXACT)
    many = len(data) - gram + 1
    h = (prefix[gram:] - prefix[:many]) * X.powers(X.INVERSE, many)
    low = np.uint64((1 << many.bit_length()) - 1)
    least, size, width = (h & ~low) | np.arange(many, dtype=np.uint64), 1, length - gram + 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[:len(least) - (width - size)], least[width - size:])
    own = (least & low).astype(np.int64)
    del least
    inside = np.ones(len(own), bool)
    for end in offsets[1:].tolist():
        inside[max(0, end - length + 1):end] = False
    change = np.flatnonzero((own[1:] != own[:-1]) | ~inside[1:] | ~inside[:-1]) + 1
    first, last = np.concatenate([[0], change]), np.concatenate([change - 1, [len(own) - 1]])
    first, last = first[inside[first]], last[inside[first]]
    if not len(first):
        return none
    # A least hash is a small one; mixed again, keys are spread evenly over bitmaps and partitions.
    return own[first], first, last, X.mix(h[own[first]] + np.uint64(1)), X.spans_hash(prefix, first, last + length)


def _identity(docs: DataFrame, id_col: str, text_col: str, payload: Column) -> DataFrame:
    """Rows named by what they hold, so that every pass gives them the same name; equal rows have equal results."""
    text = F.col(text_col).cast("string")
    return docs.select(payload.alias("payload"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("r1"),
                       F.xxhash64(text, F.lit(7), F.col(id_col)).alias("r2"))


def _scan(rows: DataFrame, length: int, gram: int, keys: np.ndarray | None, heads: np.ndarray | None, schema: str) -> DataFrame:
    """Anchors of all texts with the columns named in ``schema``; bitmaps leave out anchors that cannot matter."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r1 = batch.column("r1").to_numpy()
            r2 = batch.column("r2").to_numpy()
            for part, data, offsets in X.blocks(batch.column("text")):
                own, first, last, key, hull = anchors(data, offsets, length, gram)
                if keys is not None:
                    keep = may_hold(keys, key)
                    own, first, last, key, hull = own[keep], first[keep], last[keep], key[keep], hull[keep]
                text = np.searchsorted(offsets, first, "right") - 1
                row, low = part.start + text, first - offsets[text]
                me = X.mix(X.mix(r1[row].view(np.uint64)) + low.astype(np.uint64))
                if heads is not None:
                    keep = may_hold(heads, me)
                    own, first, last, key, hull, row, low, me = (c[keep] for c in (own, first, last, key, hull, row, low, me))
                columns = {"key": lambda: key.view(np.int64), "hull": lambda: hull.view(np.int64), "r1": lambda: r1[row], "r2": lambda: r2[row],
                           "me": lambda: me.view(np.int64), "low": lambda: low.astype(np.int32), "size": lambda: (last - first + length).astype(np.int32),
                           "at": lambda: (own - first).astype(np.int32),
                           "context": lambda: [data[a:b + length].tobytes() for a, b in zip(first, last, strict=True)]}
                yield pa.RecordBatch.from_arrays([pa.array(columns[n](), pa.binary() if n == "context" else None) for n in names], names=names)

    return rows.select("r1", "r2", "text").mapInArrow(run, schema)


def _parse(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def suffix_sort(group: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``data`` (bytes, valid up to ``sizes``) by group and bytes, and each one's common extension with
    the one before it (-1 at a new group).

    A bottom-up mergesort: every element finds its rank in the sibling run by binary search, all at once, and two suffixes
    are compared by binary search over prefix hashes. Extensions of neighbours are verified on the bytes."""
    n, width = data.shape
    prefix = np.zeros((n, width + 1), np.uint64)
    np.cumsum(X.EXACT[data] * X.powers(X.BASE, width), axis=1, out=prefix[:, 1:])

    def common(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = np.minimum(sizes[i], sizes[j])
        got, step = np.zeros(len(i), np.int64), 1 << max(0, int(width).bit_length() - 1)
        while step:
            to = np.minimum(got + step, width)
            ok = (to <= most) & (prefix[i, to] == prefix[j, to])
            got = np.where(ok, to, got)
            step >>= 1
        return got

    def before(i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        out = group[i] < group[j]
        same = np.flatnonzero(group[i] == group[j])
        if len(same):
            a, b = i[same], j[same]
            ext = common(a, b)
            end_a, end_b = ext == sizes[a], ext == sizes[b]
            at = np.minimum(ext, width - 1)
            less = np.where(end_a | end_b, end_a & ~end_b, data[a, at] < data[b, at])
            out[same] = np.where(end_a & end_b, ties[same], less)
        return out

    order, run, place = np.arange(n), 1, np.arange(n)
    while run < n:
        pair = place // (2 * run)
        left = place % (2 * run) < run
        other = pair * 2 * run + np.where(left, run, 0)
        low, high = np.minimum(other, n), np.minimum(other + run, n)
        start = low.copy()
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            mid = (low[todo] + high[todo]) // 2
            # Elements of the right run go behind equals of the left run.
            smaller = before(order[mid], order[todo], ~left[todo])
            low[todo] = np.where(smaller, mid + 1, low[todo])
            high[todo] = np.where(smaller, high[todo], mid)
        target = pair * 2 * run + np.where(left, place - pair * 2 * run, place - pair * 2 * run - run) + (low - start)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order, run = merged, run * 2
    extension = np.full(n, -1, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        ext = common(a, b)
        columns = np.arange(width)[None]
        differs = (data[a] != data[b]) | (columns >= np.minimum(sizes[a], sizes[b])[:, None])
        true = np.where(differs.any(1), differs.argmax(1), width)
        if (true != ext).any() and (group[a] == group[b])[true != ext].any():
            raise ArithmeticError("two different strings have one prefix hash; choose another byte table")
        extension[1:] = np.where(group[a] == group[b], ext, -1)
    return order, extension


def repeated(group: np.ndarray, contexts: list[bytes], at: np.ndarray, length: int) -> np.ndarray:
    """marks[i, o]: the string of ``length`` bytes that starts ``o`` before the anchor of context i is in another one too."""
    sizes = np.array([len(c) for c in contexts])
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    ahead, back = np.minimum(sizes - at, length), at
    columns = np.arange(length)[None]

    def rows(start: np.ndarray, many: np.ndarray, sign: int) -> np.ndarray:
        place = np.clip(start[:, None] + sign * columns, 0, len(flat) - 1)
        return np.where(columns < many[:, None], flat[place], 0).astype(np.uint8)

    right, right_ext = suffix_sort(group, rows(begin + at, ahead, 1), ahead)
    left, left_ext = suffix_sort(group, rows(begin + at - 1, back, -1), back)
    marks = np.zeros((len(contexts), int(back.max()) + 1), bool)
    run_r, run_l = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for o in range(marks.shape[1]):
        able = (ahead >= length - o) & (back >= o)
        if able.sum() < 2:
            continue
        run_r[right] = np.cumsum(right_ext < length - o)
        run_l[left] = np.cumsum(left_ext < o)
        _, inverse, count = np.unique(run_r[able] * (len(sizes) + 1) + run_l[able], return_inverse=True, return_counts=True)
        marks[able, o] = count[inverse] > 1
    return marks


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """``key, hull, spans, open`` for contexts sorted by ``key, part``: spans of the hull that repeat, and for anchors in
    several parts the part's distinct strings, as (o, h): each with one hull, also those that repeat inside the part."""
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    single = pa.struct([("o", pa.int32()), ("h", pa.int64())])

    def solve(table: pa.Table) -> pa.RecordBatch:
        key, part, parts = (table.column(n).to_numpy() for n in ("key", "part", "parts"))
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (part[1:] != part[:-1]))])
        raw, at = table.column("context").to_pylist(), table.column("at").to_numpy().astype(np.int64)
        marks = repeated(group, raw, at, length)
        spans, rest = [], []
        seen: set[tuple[int, int, int]] = set()
        for i, text in enumerate(raw):
            many = len(text) - length + 1
            on = np.zeros(many + 2, bool)
            starts = at[i] - np.flatnonzero(marks[i])
            on[starts + 1] = True
            edge = np.flatnonzero(on[1:] != on[:-1])
            spans.append([{"a": int(a), "b": int(b) - 1 + length} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            if parts[i] > 1:
                prefix = X.prefixes(np.frombuffer(text, np.uint8), X.EXACT)
                w = np.arange(many)
                h = X.spans_hash(prefix, w, w + length).view(np.int64)
                own = []
                for s, v, twice in zip(w.tolist(), h.tolist(), on[1:many + 1].tolist(), strict=True):
                    name = (int(group[i]), int(at[i]) - s, v)
                    if not twice or name not in seen:
                        own.append({"o": name[1], "h": v})
                        if twice:
                            seen.add(name)
                rest.append(own)
            else:
                rest.append(None)
        return pa.RecordBatch.from_arrays([table.column("key").combine_chunks(), table.column("hull").combine_chunks(), table.column("at").combine_chunks(),
                                           pa.array(spans, pa.list_(pair)), pa.array(rest, pa.list_(single))], names=["key", "hull", "at", "spans", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            if table.num_rows < PART:
                continue
            key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
            whole = int(np.flatnonzero((key != key[-1]) | (part != part[-1]))[-1]) + 1 if (key[0], part[0]) != (key[-1], part[-1]) else 0
            if whole:
                yield solve(table.slice(0, whole))
            held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return contexts.select("key", "part", "parts", "hull", "at", "context").mapInArrow(
        run, "key bigint, hull bigint, at int, spans array<struct<a: int, b: int>>, open array<struct<o: int, h: bigint>>")


def coverage(rows: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(anchors that may repeat, with their hulls and texts; ``key, hull, whole, runs``: one row per hull of which something
    repeats, all of it or the runs)."""
    counted = (_scan(rows, length, gram, None, None, "key bigint, hull bigint").groupBy("key")
               .agg(F.count("*").alias("n"), F.min("hull").alias("low"), F.max("hull").alias("high")))
    keys = cut(counted.where("n > 1"))
    hit = cut(_scan(rows, length, gram, bit_filter(keys.select("key"), 26), None, "key bigint, hull bigint, me bigint, r1 bigint, r2 bigint, low int, size int"))
    which = bit_filter(keys.where("low <> high").select("key"), 24)
    hulls = cut(hit.groupBy("key", "hull").agg(F.count("*").alias("n"), F.min("me").alias("me")))
    twice = hulls.where("n > 1").select("key", "hull", F.lit(0).alias("a"), F.lit(None).cast("int").alias("b"))
    # One context of each hull; where the bitmap lets another through, that hull repeats anyway.
    contexts = _scan(rows, length, gram, which, bit_filter(hulls.select("me"), 26), "key bigint, hull bigint, at int, context binary")
    crowded = cut(hulls.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).where("parts > 1"))
    if crowded.count() <= SMALL:
        crowded = F.broadcast(crowded)
    dealt = (contexts.join(crowded, "key", "left").na.fill(1, ["parts"])
             .withColumn("part", F.pmod(F.xxhash64("hull"), F.col("parts")).cast("int")).repartition("key", "part").sortWithinPartitions("key", "part"))
    compared = cut(_compare(dealt, length))
    some = compared.select("key", "hull", F.explode("spans").alias("s")).select("key", "hull", "s.a", "s.b")
    alone = compared.where("open is not null").select("key", "hull", "at", F.explode("open").alias("w")).select("key", "hull", "at", "w.*")
    across = alone.groupBy("key", "o", "h").agg(F.min("hull").alias("low"), F.max("hull").alias("high")).where("low <> high").select("key", "o", "h")
    found = alone.join(across, ["key", "o", "h"]).select("key", "hull", F.expr("at - o").alias("a"), F.expr(f"at - o + {length}").alias("b"))
    parts = twice.unionByName(some).unionByName(found).groupBy("key", "hull").agg(
        F.max(F.col("b").isNull()).alias("whole"), F.array_sort(F.collect_list(F.struct("a", "b"))).alias("parts"))
    merged = F.expr("""aggregate(parts, cast(array() as array<struct<a: int, b: int>>), (u, x) ->
        if(size(u) > 0 and x.a <= element_at(u, -1).b,
           concat(slice(u, 1, size(u) - 1), array(named_struct('a', element_at(u, -1).a, 'b', greatest(element_at(u, -1).b, x.b)))),
           concat(u, array(x))))""")
    return hit, parts.select("key", "hull", "whole", F.when(F.col("whole"), F.lit(None)).otherwise(merged).alias("runs"))


def _meet(hit: DataFrame, cover: DataFrame) -> DataFrame:
    """Places of hulls with what repeats in them, where that is anything. A hull that lies in very many places is dealt by
    text over ``SALTS`` tasks, and its one row of ``cover`` goes to each of them."""
    crowd = cut(hit.groupBy("key", "hull").agg(F.count("*").alias("n")).where(f"n > {CROWD}").select("key", "hull", F.lit(SALTS).alias("salts")))
    if crowd.isEmpty():
        return hit.join(cover, ["key", "hull"])
    small = crowd.count() <= SMALL
    mark = lambda df: df.join(F.broadcast(crowd) if small else crowd, ["key", "hull"], "left")
    dealt = mark(hit).withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("r1", "low"), F.lit(SALTS)))).drop("salts")
    copies = mark(cover).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")
    return dealt.join(copies.withColumn("salt", F.col("salt").cast("bigint")), ["key", "hull", "salt"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                   payload: Column | None = None) -> DataFrame:
    """``doc_id, kept, text, n_bytes, spans``: each document's bytes without those in a string of ``length`` bytes that
    starts anywhere else as well, ``text`` the same without characters that were cut apart, and the removed runs as sorted,
    disjoint (a, b). ``payload`` takes the place of the id where more of the row is to come along.

    Texts are UTF-8 bytes, null is empty; no string crosses documents, and all are judged on the input. Every row is kept,
    also empty ones; of repeated rows all copies lose what they share; rows are not told apart by id. An empty table gives
    no rows; other columns are ignored.
    """
    rows = _identity(docs, id_col, text_col, F.col(id_col) if payload is None else payload)
    hit, cover = coverage(rows, length, gram)
    # A run (a, b) as one number, a in the upper half. Runs and texts meet sorted by text, runs first.
    each = F.explode(F.when(F.col("whole"), F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b")))).otherwise(F.col("runs"))).alias("s")
    run = ((F.col("low") + F.col("s.a")).cast("bigint") * F.lit(1 << 32) + (F.col("low") + F.col("s.b")).cast("bigint")).alias("run")
    runs = _meet(hit, cover).select("r1", "r2", "low", each).select("r1", "r2", run, F.lit(None).cast("string").alias("text"), F.lit(None).cast(rows.schema["payload"].dataType).alias("payload"))
    texts = rows.select("r1", "r2", F.lit(-1).cast("bigint").alias("run"), F.coalesce("text", F.lit("")).alias("text"), "payload")
    both = runs.unionByName(texts).repartition("r1", "r2").sortWithinPartitions("r1", "r2", F.desc("run"))
    schema = StructType([StructField("doc_id", rows.schema["payload"].dataType), *_parse("kept binary, text string, n_bytes bigint, spans array<struct<a: bigint, b: bigint>>")])
    return both.select("r1", "r2", "run", "text", "payload").mapInArrow(_cut_out, schema)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their runs; the runs of a text stand before it, those of the last one are kept for the next batch."""
    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    name, held = None, np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        r1, r2, run = (batch.column(k).to_numpy() for k in range(3))
        data, offsets = X.column_bytes(batch.column(3))
        start = np.zeros(batch.num_rows, np.int64)
        change = np.flatnonzero((r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])) + 1
        start[change] = change
        start = np.maximum.accumulate(start)
        known, base = (r1[0], r2[0]) == name, held
        at = np.flatnonzero(run < 0)
        kept, sizes, gone = [], [], []
        for i in at.tolist():
            text = data[offsets[i]:offsets[i + 1]]
            mine = run[start[i]:i]
            mine = mine[mine >= 0]
            if known and start[i] == 0:
                mine = np.concatenate([base, mine])
            edge = np.zeros(len(text) + 1, np.int64)
            np.add.at(edge, mine >> 32, 1)
            np.add.at(edge, mine & 0xFFFFFFFF, -1)
            out = np.cumsum(edge[:-1]) > 0
            kept.append(text[~out].tobytes())
            sizes.append(len(text))
            turn = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
            gone.append([{"a": int(x), "b": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
        last = run[start[-1]:]
        last = last[last >= 0]
        held = np.concatenate([held, last]) if known and start[-1] == 0 else last
        name = r1[-1], r2[-1]
        if len(at):
            yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(at)), pa.array(kept, pa.binary()), pa.array([k.decode(errors="ignore") for k in kept], pa.string()),
                                              pa.array(sizes, pa.int64()), pa.array(gone, pa.list_(pair))], names=["doc_id", "kept", "text", "n_bytes", "spans"])


def query(spark, sf_dir: str) -> DataFrame:
    """op1: what is left of every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["b"] - s["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_array_dedup": query}
ORACLES: dict[str, str] = {}

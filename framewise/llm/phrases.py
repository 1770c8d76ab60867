"""Collocations from a weighted de Bruijn graph of words.

Texts fall into pieces and pieces into words. Nodes of the graph are runs of ``longest - 1`` words, edges runs of
``longest`` words, weighted by their occurrences; where a piece ends, its last runs of fewer words are counted as well. All
shorter counts then follow from flows: what passes a run of k words is the sum of the runs of k + 1 words that begin with it,
plus the pieces that end in it. A node whose whole flow passes along one edge, in or out, lies on a unary path and is
compacted into that edge, order by order; what remains are the branching phrases.

A piece is first broken at words and between pairs of words that occur less often than a phrase must: no such phrase has them
inside, so no count that is asked for changes, and the graph has only edges between frequent pairs. The run that begins at a
word likewise ends before the first triple that is too rare, as if the piece ended there: shorter runs, more of them equal.
Words, pairs and triples are counted by Spark; tasks get bitmaps of fixed size, and what they let through by chance makes
edges that count for nothing. Words are named by 62 bits; that no two words of the graph share a name is verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .store import bit_filter, cut, may_hold

#: Words of a phrase at most, its least count, reported phrases per group, hundredths of a count that a longer phrase must keep.
LONGEST, LEAST, TOP, INSIDE = 5, 100, 2000, 100
#: Bits of the bitmaps of frequent words and of frequent pairs, bits of a pair's name, and tries to name the words.
BITS, PAIR_BITS, TRIES = 26, 30, 4
#: Bytes that end a piece, and bytes of words.
STOP = np.zeros(256, bool)
STOP[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
INK = ~STOP
INK[[9, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The two lowest bits of a name tell words, pairs and groups apart.
CLEAR, PAIR, GROUP = np.uint64(0xFFFFFFFFFFFFFFFC), 1, 2


def pieces(column: pa.Array, groups: np.ndarray, table: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: rows, bytes, starts, ends, names and text numbers of all words, and whether each goes on the piece before it."""
    for rows, data, offsets in X.blocks(column):
        start, end, text = X.words(data, offsets, INK)
        name = X.mix(X.spans_hash(X.prefixes(data, table), start, end) ^ groups[rows][text]) & CLEAR
        stops = np.concatenate([[0], np.cumsum(STOP[data])])[start]
        joined = np.zeros(len(start), bool)
        joined[1:] = (text[1:] == text[:-1]) & (stops[1:] == stops[:-1])
        yield rows, data, start, end, name, text, joined


def pairs(name: np.ndarray) -> np.ndarray:
    """``PAIR_BITS`` bits that name each word with the one before it. Pairs that share a name are counted together, which lets
    them through together; short names make the largest shuffle small."""
    return X.mix(name[:-1] * X.BASE + name[1:]) >> np.uint64(64 - PAIR_BITS)


def triples(name: np.ndarray) -> np.ndarray:
    """``PAIR_BITS`` bits that name each word with the two before it."""
    return X.mix((name[:-2] * X.BASE + name[1:-1]) * X.BASE + name[2:]) >> np.uint64(64 - PAIR_BITS)


def linked(name: np.ndarray, joined: np.ndarray, bitmap: np.ndarray, often_two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word goes on the broken piece before it, and whether the bitmap lets the word through."""
    on, often = joined.copy(), may_hold(bitmap, name)
    on[1:] &= often[1:] & often[:-1]
    at = np.flatnonzero(on)
    on[at] = may_hold(often_two, pairs(name)[at - 1] << np.uint64(64 - PAIR_BITS))
    return on, often


def _counted(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """``h, c``: occurrences of all words, all names of pairs inside pieces, and all words of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy().view(np.uint64)
            for rows, _, _, _, name, text, joined in pieces(batch.column(1), groups, table):
                found = [np.unique(name, return_counts=True), np.unique(groups[rows][text] & CLEAR | np.uint64(GROUP), return_counts=True)]
                if len(name):
                    h, c = np.unique(pairs(name)[joined[1:]], return_counts=True)
                    found.append((h << np.uint64(2) | np.uint64(PAIR), c))
                h, c = (np.concatenate(v) for v in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return rows.select("g", "text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _counted_triples(rows: DataFrame, table: np.ndarray, bitmap: np.ndarray, often_two: np.ndarray) -> DataFrame:
    """``h, c``: occurrences of all names of triples inside broken pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy().view(np.uint64)
            for _, _, _, _, name, _, joined in pieces(batch.column(1), groups, table):
                on, _ = linked(name, joined, bitmap, often_two)
                h, c = np.unique(triples(name)[on[1:-1] & on[2:]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

    return rows.select("g", "text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _edges(rows: DataFrame, table: np.ndarray, bitmap: np.ndarray, often_two: np.ndarray, often_three: np.ndarray, longest: int) -> DataFrame:
    """``w0 ..., c, word, lang``: edges (all words there), piece ends (the last words missing), and the names of all words that
    the bitmap lets through (c is zero)."""
    names = [f"w{k}" for k in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_numpy().view(np.uint64)
            for rows, data, start, end, name, text, joined in pieces(batch.column(1), groups, table):
                if not len(name):
                    continue
                on, often = linked(name, joined, bitmap, often_two)
                # How many words of the broken piece follow each word, and up to where all triples are frequent.
                place = np.arange(len(name))
                last = np.flatnonzero(np.append(~on[1:], True))
                follow = last[np.searchsorted(last, place)] - place
                rare = on[1:-1] & on[2:]
                at = np.flatnonzero(rare)
                rare[at] = ~may_hold(often_three, triples(name)[at] << np.uint64(64 - PAIR_BITS))
                rare = np.append(np.flatnonzero(rare), 2 * len(name))
                follow = np.minimum(follow, rare[np.searchsorted(rare, place)] + 1 - place)
                for k in range(longest, 1, -1):
                    # Runs of k words: the longest anywhere, shorter ones where the piece ends or a rare triple does.
                    i = np.flatnonzero(follow >= k - 1 if k == longest else follow == k - 1)
                    if not len(i):
                        continue
                    key = np.zeros(len(i), np.uint64)
                    for j in range(k):
                        key = key * X.BASE + name[i + j]
                    same = np.argsort(key)
                    grams = np.stack([name[i[same] + j] for j in range(k)], 1)
                    new = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(1)]))
                    gone = pa.nulls(len(new), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(grams[new, j].view(np.int64)) if j < k else gone for j in range(longest)], pa.array(np.diff(np.append(new, len(i)))),
                         pa.nulls(len(new), pa.string()), pa.nulls(len(new), pa.string())], names=[*names, "c", "word", "lang"])
                seen, first = np.unique(name[often], return_index=True)
                first = np.flatnonzero(often)[first]
                words = [LOWER[data[a:b]].tobytes().decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                gone = pa.nulls(len(seen), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seen.view(np.int64)), *[gone] * (longest - 1), pa.array(np.zeros(len(seen), np.int64)), pa.array(words, pa.string()),
                     batch.column(2)[rows].take(pa.array(text[first]))], names=[*names, "c", "word", "lang"])

    out = rows.select("g", "text", "lang").mapInArrow(run, ", ".join(f"{n} bigint" for n in names) + ", c bigint, word string, lang string")
    return out.groupBy(*names, "word", "lang").agg(F.sum("c").alias("c"))


def flows(edges: DataFrame, longest: int, least: int) -> DataFrame:
    """``gram array<bigint>, f``: all runs of 2 to ``longest`` words that occur ``least`` times, from edges and piece ends."""
    names, levels = [f"w{k}" for k in range(longest)], []
    flow = edges.where(f"{names[-1]} is not null").select(*names, F.col("c").alias("f"))
    for k in range(longest, 1, -1):
        if k < longest:
            ends = edges.where(f"{names[k]} is null and {names[k - 1]} is not null").select(*names[:k], F.col("c").alias("f"))
            flow = flow.select(*names[:k], "f").unionByName(ends).groupBy(*names[:k]).agg(F.sum("f").alias("f"))
        levels.append(flow.where(F.col("f") >= least).select(F.array(*names[:k]).alias("gram"), "f"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def branching(counts: DataFrame, inside: int = INSIDE) -> DataFrame:
    """The runs of ``counts`` of which no edge, in or out, carries ``inside`` hundredths of the flow.

    A longer run that carries as much carries it through the run longer by one word, so edges decide for all lengths."""
    size = F.size("gram")
    ahead = counts.where(size > 2).select(F.slice("gram", F.lit(1), size - 1).alias("gram"), F.col("f").alias("along"))
    back = counts.where(size > 2).select(F.slice("gram", F.lit(2), size - 1).alias("gram"), F.col("f").alias("along"))
    along = ahead.unionByName(back).groupBy("gram").agg(F.max("along").alias("along"))
    return counts.join(along, "gram", "left").where(F.col("along").isNull() | (F.col("along") * 100 < F.col("f") * inside)).select("gram", "f")


def collocations(docs: DataFrame, group: Column | None = None, text_col: str = "text", longest: int = LONGEST, least: int = LEAST,
                 top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each group (the column ``lang``, null: ``und``).

    Words are what stands between blanks and tabs in a piece, pieces end at ``. , ; : ! ?`` and line ends; A-Z count as a-z.
    A phrase of 2 to ``longest`` words occurs a >= ``least`` times. Of its cuts into two parts with counts l and r the one with
    the least floor(1000 a n / (l r)) gives the score, n being all words of the group. Phrases inside a longer one that keeps
    ``inside`` hundredths of the count are left out. Ranks go by score, count and phrase (bytes).

    Null and empty texts have no words; repeated rows count each time; other columns are ignored; an empty table, or one
    without such phrases, gives no rows.
    """
    lang = F.coalesce((F.col("lang") if group is None else group).cast("string"), F.lit("und"))
    rows = docs.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang")).withColumn("g", F.xxhash64("lang"))
    for seed in range(TRIES):
        table = X.byte_table(20 + seed, True)
        counted = cut(_counted(rows, table).where(f"c >= {least} or (h & 3) = {GROUP}"))
        bitmap = bit_filter(counted.where("(h & 3) = 0").select("h"), BITS)
        often_two = bit_filter(counted.where(f"(h & 3) = {PAIR}").selectExpr(f"shiftleft(shiftright(h, 2), {64 - PAIR_BITS}) as h"), BITS)
        often_three = bit_filter(_counted_triples(rows, table, bitmap, often_two).where(f"c >= {least}").selectExpr(f"shiftleft(h, {64 - PAIR_BITS}) as h"), BITS)
        edges = cut(_edges(rows, table, bitmap, often_two, often_three, longest))
        words = edges.where("word is not null").select(F.col("w0").alias("h"), "word", "lang")
        if words.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
    else:
        raise ArithmeticError(f"two words had one name in {TRIES} tries")
    counts = cut(flows(edges.where("word is null"), longest, least))
    single = counted.where("(h & 3) = 0").select(F.array("h").alias("gram"), F.col("c").alias("f"))
    parts = counts.unionByName(single)
    size = F.size("gram")
    cuts = (branching(counts, inside).withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
            .select("gram", "f", "k", F.slice("gram", F.lit(1), F.col("k")).alias("head"), F.slice("gram", F.col("k") + 1, size - F.col("k")).alias("tail")))
    totals = counted.where(f"(h & 3) = {GROUP}").select(F.col("h").alias("g"), F.col("c").alias("n"))
    named = words.withColumn("g", F.expr(f"(xxhash64(lang) & {~3}L) | {GROUP}L")).join(totals, "g").select("h", "word", "lang", "n")
    scored = (cuts.join(parts.select(F.col("gram").alias("head"), F.col("f").alias("l")), "head")
              .join(parts.select(F.col("gram").alias("tail"), F.col("f").alias("r")), "tail")
              .join(named.select(F.col("h").alias("first"), "lang", "n"), F.col("gram")[0] == F.col("first"))
              .withColumn("score", F.expr("(cast(1000 * f as decimal(19)) * cast(n as decimal(19))) div (cast(l as decimal(19)) * cast(r as decimal(19)))"))
              .groupBy("gram", "f", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    scored = cut(scored)
    word = F.posexplode("gram").alias("at", "h")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
    texts = scored.select("gram", word).join(named.select("h", "word"), "h").groupBy("gram").agg(phrase.alias("phrase"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.join(texts, "gram").select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
            .withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the strongest phrases of every language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
tokens AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM piece),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM tokens, (SELECT unnest(range(1, 6)) AS k) AS sizes WHERE len(w) >= k)
  GROUP BY ALL),
total AS (SELECT lang, sum(f)::HUGEINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidate AS (SELECT * FROM grams WHERE k > 1 AND f >= 100),
longer AS (SELECT lang, max(f) AS along, inner_phrase AS phrase FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[i : j], ' ') FOR j IN range(i + 1, k + 1) IF j - i + 1 < k]) AS inner_phrase
    FROM (SELECT lang, k, f, phrase, unnest(range(1, k)) AS i FROM candidate))
  GROUP BY ALL),
kept AS (SELECT c.* FROM candidate c LEFT JOIN longer o ON c.lang = o.lang AND c.phrase = o.phrase WHERE o.along IS NULL OR 100 * o.along < 100 * c.f),
cuts AS (SELECT lang, k, phrase, f, unnest(range(1, k)) AS pos FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.pos, l.f AS l, r.f AS r, t.n,
    (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c
  JOIN total t ON t.lang = c.lang
  JOIN grams l ON l.lang = c.lang AND l.k = c.pos AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1 : c.pos], ' ')
  JOIN grams r ON r.lang = c.lang AND r.k = c.k - c.pos AND r.phrase = array_to_string(string_split(c.phrase, ' ')[c.pos + 1 : c.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
  r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000"""

QUERIES = {"op12_phrase_collocations": query}
ORACLES = {"op12_phrase_collocations": SQL}

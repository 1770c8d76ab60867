"""Periodic runs, collocations and languages: brute force, SQL, held-out accuracy, odd rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import languages, periodic, phrases

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, word string, c string, h string, g int, label string, n int"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "x " * 9000), (6, "a b " * 40), (6, "a b " * 40), (None, "no id no id no id no id no id"), (7, "y" * 200000), (8, "9 9 9 9 9 9 9")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "xx" if i != 4 else None, "w", "c", "h", 1, "l", 2) for i, t in ODD], SCHEMA)


def brute_runs(w, repeats=4, least=6):
    n, out, names = len(w), [], {}
    x = np.array([names.setdefault(s, len(names)) for s in w], np.int64)
    for q in range(1, n // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(int), [0]])))
        for s, e in zip(edges[::2], edges[1::2] + q):
            part = x[s:e]
            if e - s >= max(least, repeats * q) and not any((part[:-p] == part[p:]).all() for p in range(1, q)):
                out.append((int(s), int(e - s), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("repeats,least", [(4, 6), (2, 2), (3, 7)])
def test_runs_of_small_alphabets(repeats, least):
    rng = random.Random(repeats)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
            if len(w) > 4 and rng.random() < 0.6:
                p, a = rng.randint(1, len(w) // 3 + 1), rng.randrange(len(w))
                w = [w[i] if i < a else w[min(len(w) - 1, a + (i - a) % p)] for i in range(len(w))]
            texts.append(w)
        base = np.cumsum([0] + [len(w) for w in texts])
        symbols = np.array([t * 1000 + v for t, w in enumerate(texts) for v in w], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        want = sorted((s + int(b), s + n + int(b), q) for w, b in zip(texts, base) for s, n, q in brute_runs(w, repeats, least))
        assert [tuple(r) for r in periodic.runs(symbols, np.repeat(base[:-1], np.diff(base)), repeats, least).tolist()] == want


def test_runs_query(spark):
    got = {r["doc_id"]: r for r in periodic.query(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, t in docs:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", t or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if len(w) > 3000:  # too slow by brute force
            continue
        runs = brute_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        row = got[i]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(w[k] for k in range(len(w)) if k not in gone).encode()).hexdigest()


def test_runs_of_odd_rows(spark, odd):
    got = collections.Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic.periodic_runs(odd).collect())
    want = collections.Counter([(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 1, (), "a"), (5, 9000, ((0, 9000, 1),), "x"), (None, 10, ((0, 10, 2),), "no id"),
                                (7, 1, (), "y" * 200000), (8, 7, ((0, 7, 1),), "9")])
    want[(6, 80, ((0, 80, 2),), "a b")] = 2
    assert got == want
    assert periodic.periodic_runs(odd.limit(0)).count() == 0
    # Word hashes that clash must not make words equal.
    assert periodic.runs(np.arange(50, dtype=np.uint64) % np.uint64(7), np.zeros(50, np.int64)).tolist() == [[0, 50, 7]]


def brute_phrases(rows, longest, least, top, inside):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", *w[i:i + k]) for i in range(len(w) - k + 1))
    many = {g for g, c in f.items() if len(g) > 2 and c >= least}
    out = []
    for lang, *w in many:
        a = f[(lang, *w)]
        longer = (g for g in many if g[0] == lang and len(g) - 1 > len(w) and any(list(g[i:i + len(w)]) == w for i in range(1, len(g) - len(w) + 1)))
        if any(100 * f[g] >= inside * a for g in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, k + 1, *r[1:]) for k, r in enumerate(mine)]
    return sorted(ranked)


@pytest.mark.parametrize("longest,least,top,inside", [(5, 4, 2000, 100), (4, 3, 25, 80), (2, 6, 10, 100)])
def test_phrases_against_brute_force(spark, longest, least, top, inside):
    rng = random.Random(least)
    words = ["a", "B", "éa", "É", "of", "Of", "x1", "-", "long" * 30]
    rows = []
    for i in range(90):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!?"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["l1", "l1", "l2", None, "und"])))
    rows += [(1, None, "l1"), (2, "", None), (3, " . ", "l2"), (4, rows[0][1], rows[0][2]), (4, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame([(i, t, g, "w", "c", "h", 1, "l", 2) for i, t, g in rows], SCHEMA)
    got = sorted(tuple(r) for r in phrases.collocations(docs, longest=longest, least=least, top=top, inside=inside).collect())
    assert got == brute_phrases([(g, t) for _, t, g in rows], longest, least, top, inside)


def test_phrases_full_bitmap_and_odd_rows(spark, odd, monkeypatch):
    """A bitmap that lets everything through changes nothing."""
    few = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 200").select("text", "lang", F.lit(1).alias("h"))
    want = sorted(map(tuple, phrases.collocations(few, least=20).collect()))
    monkeypatch.setattr(phrases, "BITS", 6)
    assert want and sorted(map(tuple, phrases.collocations(few, least=20).collect())) == want
    got = sorted(map(tuple, phrases.collocations(odd, least=40).collect()))
    assert got == brute_phrases([(None if i == 4 else "xx", t) for i, t in ODD], 5, 40, 2000, 100)
    assert phrases.collocations(odd.limit(0)).count() == 0 and phrases.collocations(odd, least=10**6).count() == 0


def test_collocations_do_not_shuffle_runs_with_a_rare_triple(spark):
    rng = np.random.default_rng(12)
    words = rng.choice([f"w{i}" for i in range(20)], 60000)
    texts = [" ".join(w) for w in words.reshape(200, 300)] + ["p q r s t"] * 150
    docs = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string").repartition(4)

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    docs, before = docs.localCheckpoint(), shuffled()
    got = {r["phrase"]: r["a"] for r in phrases.collocations(docs, least=100).collect()}
    many = collections.Counter(p for t in texts for w in [t.split()] for p in zip(w, w[1:]))
    want = {" ".join(p): n for p, n in many.items() if n >= 100 and p[0].startswith("w")} | {"p q r s t": 150}
    assert got == want
    # 60,000 different runs of five words; 400 pairs, all of them frequent, and 8,000 triples, none of them.
    assert shuffled() - before < 1_000_000


def test_phrases_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    got = phrases.query(spark, DATA)
    want = con.sql(phrases.SQL)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_exact_scores_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("(cast(1000 * 9000000000000L as decimal(19)) * cast(90000000000000L as decimal(19))) div (cast(30000000000000L as decimal(19)) * cast(7000000000001L as decimal(19))) as s").first()
    assert row["s"] == 1000 * 9000000000000 * 90000000000000 // (30000000000000 * 7000000000001)


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = languages.query(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)
    # Labels of the held-out fold, and all other columns, change nothing.
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("zz")).otherwise(F.col("lang")))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    again = {r["doc_id"]: tuple(r) for r in languages.detect(other.repartition(7), fold != 1).collect()}
    assert all(again[r["doc_id"]][1] == r["lang_pred"] and abs(again[r["doc_id"]][2] - r["score"]) < 1e-5 for r in rows)


def test_families():
    base = np.random.default_rng(0).random((2, 50))
    means = np.stack([base[k % 2] + 0.1 * np.random.default_rng(k).random(50) for k in range(6)])
    assert languages.families(means) == [[0, 2, 4], [1, 3, 5]]
    assert languages.families(means[:1]) == [[0]] and languages.families(means[:2]) == [[0, 1]] and languages.families(means[:0]) == []


def test_known_families_and_scarce_languages(spark):
    """A language with one text has its machines as well; a family may be given."""
    rng = random.Random(3)
    sounds = {"a1": ["ka", "ko", "ki"], "a2": ["ka", "ko", "ku"], "b1": ["str", "pfe", "ung"], "b2": ["str", "pfe", "lich"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[g], k=3)) for _ in range(30)), g) for i, g in enumerate(sorted(sounds) * 20)]
    rows += [(904, "zzz zzz xxx zzz", "rare"), (905, "zzz xxx", None)]
    docs = spark.createDataFrame([(i, t, g, "w", "c", "h", 1, "l", 2) for i, t, g in rows], SCHEMA)
    out = {r["doc_id"]: r["lang_pred"] for r in languages.detect(docs, F.expr("doc_id div 4 % 2 = 0"), groups=[["a1", "a2"], ["b1", "b2"]]).collect()}
    assert out[905] == "rare" and all(out[i] == g for i, _, g in rows if g)


def test_languages_of_odd_rows(spark, odd):
    out = [tuple(r) for r in languages.detect(odd, F.lit(True)).collect()]
    assert len(out) == len(ODD) and all(v[1] == ("und" if v[0] in (1, 2, 3, 8) else "xx") for v in out)
    assert {v[1] for v in map(tuple, languages.detect(odd, F.lit(None).cast("boolean")).collect())} == {"und"}
    assert languages.detect(odd.limit(0), F.lit(True)).count() == 0

"""Suffix sort, decontamination and Jaccard join against brute force, with odd rows."""

import collections
import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import decontaminate, jaccard, suffixes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, row string, r1 bigint, leaf string"


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def corpus(seed, n=60):
    """Texts with exact and near copies, shared passages, odd and repeated rows, and columns with clashing names."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéßz") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 300))) for _ in range(n)]
    texts += [texts[0]] * 4 + [f"{t} {passage}. {rng.choice(texts)}" for t in texts[:12]]
    for t in texts[:20]:
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        texts.append(" ".join(w))
    texts += [None, "", " ", "!!! ...", "one", "ONE", "two words", "a" * 5000, ("ab " * 300).strip(), passage.upper()]
    rows = [(i, t, "x", 7, None) for i, t in enumerate(texts)]
    return [*rows, (None, texts[0], None, None, None), (3, texts[3], None, None, None), (3, texts[3], None, None, None)]


def brute_repeats(texts, length):
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_a_passage_in_half_of_all_texts(spark, monkeypatch):
    """Its places are dealt over tasks."""
    monkeypatch.setattr(suffixes, "CROWD", 20)
    rng = random.Random(9)
    passage = " ".join(rng.choices(string.ascii_lowercase, k=150))
    texts = [("".join(rng.choices(string.ascii_lowercase, k=40)) + (passage if k % 2 else "") + "".join(rng.choices(string.ascii_lowercase, k=k % 50))) for k in range(200)]
    out = suffixes.remove_repeats(spark.createDataFrame([(k, t, "x", 7, None) for k, t in enumerate(texts)], SCHEMA))
    got = out.select("n_bytes", F.expr("aggregate(spans, 0L, (t, s) -> t + s.b - s.a)"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_repeats([t.encode() for t in texts], 200))


@pytest.mark.parametrize("length,gram,part", [(200, 64, 4096), (60, 16, 2)])
def test_repeated_strings(spark, monkeypatch, length, gram, part):
    """Small parts force one anchor's contexts into several tasks."""
    monkeypatch.setattr(suffixes, "PART", part)
    rows = corpus(part)
    out = suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA), length, gram)
    got = out.select("n_bytes", F.expr("aggregate(spans, 0L, (t, s) -> t + s.b - s.a)"), F.size("spans"), F.sha2("kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_repeats([(r[1] or "").encode() for r in rows], length))


def test_string_split_two_and_one(spark, monkeypatch):
    """Three contexts in two parts: the copy that is alone in its part goes as well."""
    monkeypatch.setattr(suffixes, "PART", 2)
    rng = random.Random(8)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    shared = [some(200) for _ in range(12)]
    rows = [(3 * k + j, "ABC"[j] * 9 + some(150) + "ABC"[j] + s + "XYZ"[j] + some(150), "x", 7, None) for k, s in enumerate(shared) for j in range(3)]
    out = suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA))
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in out.collect()} == {r[0]: [(160, 360)] for r in rows}


def test_suffix_sort_orders_and_extends():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, (300, 40)).astype(np.uint8)
    sizes = rng.integers(0, 41, 300)
    data[np.arange(40)[None] >= sizes[:, None]] = 0
    group = np.sort(rng.integers(0, 5, 300))
    order, extension = suffixes.suffix_sort(group, data, sizes)
    keys = [(group[i], data[i, :sizes[i]].tobytes()) for i in range(300)]
    assert [keys[i] for i in order] == sorted(keys)
    for k in range(1, 300):
        a, b = keys[order[k - 1]], keys[order[k]]
        same = next((x for x in range(min(len(a[1]), len(b[1]))) if a[1][x] != b[1][x]), min(len(a[1]), len(b[1])))
        assert extension[k] == (same if a[0] == b[0] else -1)


def test_nothing_to_remove(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffixes.remove_repeats(empty).count() == 0
    assert decontaminate.contamination(empty, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert jaccard.classes_and_links(empty).count() == 0
    assert jaccard.one_of_each(empty).columns == empty.columns


def windows(w, n):
    return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]


def test_contamination(spark):
    rows = corpus(5)
    long = words(rows[4][1])
    items = [(1, " ".join(long[:20])), (2, " ".join(long[5:9])), (10, "one"), (11, None), (12, "..."), (13, "two, words"), (14, " ".join(words(rows[7][1])[:13])),
             (15, "never seen anywhere at all"), (15, "one"), (None, "edited")]
    found = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"))
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found.collect())
    want = collections.Counter()
    for doc, text, *_ in rows:
        w, hit, names = words(text), set(), set()
        for item, content in items:
            v = words(content)
            size = min(13, len(v))
            for win in windows(v, size) if v else []:
                for i, other in enumerate(windows(w, size)):
                    if win == other:
                        hit.update(range(i, i + size))
                        names.add("" if item is None else str(item))
        want[(doc, len(w), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert got == want
    kept = decontaminate.clean_only(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"), small=0)
    assert kept.columns == ["doc_id", "text", "row", "r1", "leaf"] and kept.count() == sum(n for k, n in want.items() if not k[4])


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [2048, 3])
def test_classes_and_links(spark, block):
    """A small block deals one group of copies into pairs of blocks."""
    rows = corpus(9)
    sets = [shingles(r[1]) for r in rows]
    near = [[i != j and bool(a) and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    want = collections.Counter()
    for i, r in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            k = todo.pop()
            todo += [j for j, x in enumerate(near[k]) if x and j not in reached]
            reached |= {j for j, x in enumerate(near[k]) if x}
        least = min((rows[j][0] for j in reached if rows[j][0] is not None), default=None)
        want[(r[0], least, sum(near[i]))] += 1
    docs = spark.createDataFrame(rows, SCHEMA)
    got = collections.Counter(map(tuple, jaccard.classes_and_links(docs, block=block, recall=0.99999).select("doc_id", "class_id", "n_links").collect()))
    assert got == want
    one = jaccard.one_of_each(docs, block=block, recall=0.99999)
    wordless = sum(not s for s in sets)
    assert one.count() == len({k[1] for k in want if k[2]}) + sum(n for k, n in want.items() if not k[2] and n == 1)
    assert one.where("text is null or text in ('', ' ', '!!! ...')").count() == wordless


def test_runs_reach_the_recall():
    assert jaccard.runs_needed(0.8, 0.995) >= 2
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        shared = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = (np.unique(np.r_[shared, rng.integers(0, 2**63, 10).astype(np.uint64)]) for _ in range(2))
        x, y = (jaccard.leaves(s, jaccard.runs_needed(0.8, 0.995), jaccard.BRANCH, jaccard.DEPTH) for s in (a, b))
        met += bool(np.intersect1d(x, y).size)
    assert met >= 295

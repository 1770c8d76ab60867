"""Packing, URLs, pages, classifiers, search and language model: brute force, round trips, held-out accuracy, odd rows."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from framewise.llm import language, packing, pages, quality, search, store, text, toxicity, urls

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, score string, label string, ids string, held_out int"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "Aé " * 3000), (6, "same text"), (6, "same text"), (None, "no id"), (7, "x" * 20000), (8, "<|endoftext|> inside")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", "l", "i", 1) for i, t in ODD], SCHEMA)


def test_words_and_hashes():
    texts = ["Aé b", "", "b a", "ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    start, end, owner = text.words(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(start, end)] == ["Aé", "b", "b", "a", "ab"] and owner.tolist() == [0, 0, 2, 2, 3]
    h = text.spans_hash(text.prefixes(data, text.FOLDED), start, end)
    assert h[1] == h[2] and len(set(h.tolist())) == 4


def test_bitmap_holds_all(spark):
    values = np.random.default_rng(0).integers(-2**63, 2**63 - 1, 500)
    bitmap = store.bit_filter(spark.createDataFrame([(int(v),) for v in values], "h bigint"), 16)
    assert store.may_hold(bitmap, values.view(np.uint64)).all()
    assert store.may_hold(bitmap, np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)).mean() < 0.05


def test_packing_round_trip(spark, odd):
    out = packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), max_len=64).collect()
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len({r["sequence_id"] for r in out}) == len(out) and all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 for r in out)
    got = collections.defaultdict(list)
    for r in sorted(out, key=lambda r: (r["sequence_id"])):
        got[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
        assert r["offset"] == 0 and r["length"] == 2 ** r["bucket"] == len(r["ids"]) // 4
    want = collections.defaultdict(list)
    for i, t in ODD:
        want[i] += [*reference.encode(t or "", add_special_tokens=False).ids, 1]
    assert got == want
    assert packing.cuts(0, 8) == [] and packing.cuts(29, 8) == [(0, 8), (8, 8), (16, 8), (24, 4), (28, 1)]


def test_fast_ids_are_the_reference(spark):
    docs = [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(150).collect()]
    names = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert all((packing.token_ids(t, *names) == packing.token_ids(t, names[0])).all() for t in docs)


@pytest.mark.parametrize("gap", [" " * 1_000_000, "\n" * 1_000_000, " \n\u3000" * 400_000])
def test_long_white_space_is_the_reference(gap):
    names = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    for t in (gap, f"a{gap}b", f"a{gap[:packing.SPACES]}b"):
        assert (packing.token_ids(t, *names) == packing.token_ids(t, names[0])).all()


def test_urls(spark):
    cases = {"http://A.Example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"), "https://x.www.example.com/en/?q": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
             "http://shop.com/fr#a/b": ("shop.com", "/fr", "com/", "allow"), "http://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"), "http://notcom/x": ("notcom", "/x", None, "allow"),
             "http://shop.com": ("shop.com", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b?x://y/z": ("b", "", None, "allow"),
             "http://a.net/en/": ("a.net", "/en/", None, "block"), "http://linker.org/": ("linker.org", "/", None, "block"), "http://good.org/": ("good.org", "/", None, "allow")}
    rows = [(i, u, '<a href="http://a.net/es/9">x</a>' if u and "linker" in u else '<a href="http://good.org/">' if u and "shop" in u else None, "z") for i, u in enumerate(cases)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string"), rounds=3).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.filter_urls(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_rank_reaches_hosts_far_from_the_seeds(spark):
    """A chain of 14 links to a blocked host."""
    rows = [(k, f"http://h{k}.org/", f'<a href="http://h{k + 1}.org/">' if k < 13 else '<a href="http://a.net/es/1">') for k in range(14)] + [(14, "http://a.net/es/1", None)]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["verdict"] for r in out} == {k: "block" for k in range(15)}
    assert all(abs(r["distrust"] - 0.15 * 0.85 ** (14 - r["page_id"])) < 1e-9 for r in out)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice">We use cookies</div><aside>More</aside>
<{tag}><h1>Title {k} &amp; more</h1><p>First <b>bold</b>
  text {k}.<br>next&nbsp;line<p>Second &lt;p&gt; {k}<div class="ad">Buy</div><form>Mail <input></form><ul><li>one {k}<li>two</ul>
<section class="comments"><p>reader {k}</p></section></{tag}><footer>&copy; {k}</footer></body></html>"""


@pytest.mark.parametrize("tag", ["article", "div"])
def test_pages(spark, tag):
    rows = [(k, f"http://h{k % 2}.org/{k}", PAGE.format(tag=tag, k=f"number {k} " * 3), "x") for k in range(8)] + [
        (90, None, None, "x"), (91, "http://h1.org/", "", "x"), (92, "http://z.org/", "plain  words\n only", "x"), (93, "http://y.org/", "<p>cut <b>off", "x"), (93, "http://y.org/", "<p>cut <b>off", "x")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    for held in (100, 0):
        got = {r["page_id"]: r["text"] for r in pages.extract(frame, held).collect()}
        for k in range(8):
            n = " ".join((f"number {k} " * 3).split())
            assert got[k] == f"Title {n} & more\n\nFirst bold text {n} . next line\n\nSecond <p> {n}\n\none {n}\n\ntwo", got[k]
        assert (got[90], got[91], got[92], got[93]) == ("", "", "plain words only", "cut off")
    assert pages.extract(frame.limit(0)).count() == 0


def test_wrappers_align():
    a, b = (pages.wrapper(pages.parse(p)) for p in ("<div><p>1</p><p>2</p></div><hr>", "<div><p>1</p><h2>x</h2></div>"))
    both = pages.joined(a, b)
    assert [(p["n"], p["lo"], p["hi"]) for p in both["parts"]] == [("div", 1, 1), ("hr", 0, 1)]
    assert [(p["n"], p["lo"], p["hi"]) for p in both["parts"][0]["parts"]] == [("p", 1, 2), ("h2", 0, 1)]


def test_long_and_neighbouring_texts_that_never_change(spark):
    """Without a named article; the notice is long, has inline markup and references, and stands in equal neighbours."""
    notice = "<div><p>" + "All rights <b>reserved</b> &amp; kept. " * 12 + "</p><p>A second line for every reader.</p></div>"
    rows = [(k, f"http://h.org/{k}", f"<div><p>{f'first {k} ' * 9}</p><p>{f'more {k} ' * (9 + k)}</p></div>" + notice) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(5):
        assert f"first {k} first {k}" in got[k] and f"more {k} more {k}" in got[k] and "rights" not in got[k] and "second line" not in got[k], got[k]


def test_deep_pages(spark):
    rows = [(k, "http://deep.org/", "<div>" * (3000 + k) + f"inner {k} text" + "</div>" * k) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"inner {k} text" for k in range(3)}


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs.select("doc_id", "text"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert held[held.toxic == 0].predicted.mean() < 0.02 and held[held.toxic == 1].predicted.mean() > 0.5


def test_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(odd.select("doc_id", "text"), labels).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.toxicity(odd.select("doc_id", "text"), labels.limit(0)).where("predicted = 0").count() == len(ODD)
    assert toxicity.toxicity(odd.limit(0), labels).count() == 0
    docs = odd.selectExpr("doc_id", "text", "if(doc_id = 4, null, 'en') lang", "null source", "null n_chars", "score")
    assert quality.quality(docs, labels).where("score between 0 and 1").count() == len(ODD)
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_rare_kinds_of_toxicity_are_learnt(spark):
    """A kind that eight of 1,200 toxic texts have; an id that repeats counts once."""
    rng = np.random.default_rng(5)
    words = [f"w{k:04d}" for k in range(3000)]
    rows = []
    for i in range(12000):
        toxic = i % 10 == 0
        kind = "" if not toxic else "zzrare" if i < 80 else ("common", "usual", "often")[i % 3]
        rows.append((i, " ".join(rng.choice(words, 20)) + " " + kind, int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(90000, "some zzrare words"), (90001, "some plain words")] + [(5, "w0001 w0002")] * 500, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels, toxicity.F.lit(True))
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs.where("doc_id >= 90000"), model).collect()}
    assert out[90000] > 0.5 > 0.3 > out[90001] and len(model.features) < 20


def test_label_model_discounts_repeats():
    rng = np.random.default_rng(2)
    truth = rng.random(4000) < 0.2
    vote = lambda hit, false: (np.where(truth, rng.random(4000) < hit, rng.random(4000) < false)).astype(float)
    a = vote(0.7, 0.02)
    q, rate, correlation = toxicity.label_model(np.stack([a, a, vote(0.6, 0.1)], 1), np.where(rng.random(4000) < 0.95, truth, ~truth))
    assert correlation[0, 1] > 0.9 > abs(correlation[0, 2]) and abs(rate[1, 0] - 0.7) < 0.1 and ((q > 0.5) == truth).mean() > 0.94


def test_quality_sends_views_not_texts(spark, odd):
    """Of documents without a label the views travel to the join with the labels, not the texts."""
    docs = odd.selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(1 as bigint) n_chars")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (None, 1)], "doc_id bigint, quality int")
    pool = quality.unlabelled(docs, labels, [["en"], ["s"]])
    assert pool.columns == ["h", "label", "text_view", "meta_view"] and pool.count() == len(ODD) - 2
    plan = pool._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("LeftAnti") < plan.index("MapInArrow")


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_cuts_come_from_all_unlabelled_rows(spark, monkeypatch):
    """Sure rows are a part of the pool of any size, and those returned are a bounded sample of them."""
    centre, scale = np.zeros(20), np.ones(20)
    weights = [np.r_[10.0, np.zeros(20)], np.r_[np.zeros(3), 0.0]]
    for n in (400, 4000):
        rows = spark.range(n).selectExpr("xxhash64(id) h", "cast(null as int) label", f"transform(sequence(0, 19), k -> if(k = 0, (id - {n} / 2) / {n} * 4, 0D)) text_view", "array(1D, 0D, 0D) meta_view")
        text, meta = quality.confident(rows, weights, centre, scale, 0.5, 0.2, 10**6)
        assert abs(text[2].sum() - 0.1 * n) <= 0.02 * n and abs((1 - text[2]).sum() - 0.1 * n) <= 0.02 * n and not len(meta[2])
        assert 20 <= len(quality.confident(rows, weights, centre, scale, 0.5, 0.2, 40)[0][2]) <= 40
    assert quality.confident(rows.limit(0), weights, centre, scale, 0.5, 0.2, 9) == []
    x = quality.meta_view([["a", "b"], ["s"]], ["a", None, "z"], ["s", "t", None], [10, None, 0])
    assert [np.flatnonzero(r[:7]).tolist() for r in x] == [[0, 4], [2, 6], [3, 5]]


def test_search_with_repeated_ids_ties_and_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [int(v) for v in rng.integers(-3, 4, 4)]) for i in range(60)]
    rows += [rows[0], rows[1], rows[2], rows[20], (20, [9, 9, 9, 9]), (None, [1, 1, 1, 1]), (60, [2**62, 0, 0, 0]), (61, [2**62, 2**62, 0, 0]), (62, [-(2**62), 3, 0, 0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    one = {}
    for i, v in rows:
        if i is not None:
            one[i] = min(v, one.get(i, v))
    most = search.MOST
    for query in (True, False):
        found = search.top_k(frame, "vec_id % 20 = 0" if query else "vec_id > 57", k=7, sample=16, n_pivots=3, data_rows=9, query_rows=2)
        got = collections.defaultdict(list)
        for r in found.orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        want = {q: sorted(((i, max(-most, min(most, sum(a * b for a, b in zip(one[q], v))))) for i, v in one.items() if i != q), key=lambda p: (-p[1], p[0]))[:7]
                for q in one if (q % 20 == 0 if query else q > 57)}
        assert dict(got) == want


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).round(1).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 420)]
    rows += [(500, None), (520, [1.0, None] + [0.0] * 6), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, [1.0] * 8), (580, [2.0])]
    frame = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id bigint, embedding array<float>, score int")
    found = search.top_k(search.integer_vectors(frame), "vec_id % 20 = 0", k=5, sample=64, n_pivots=4, data_rows=40, query_rows=8)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
    good = {a: np.floor(64 * np.pad(np.array(b, np.float32).astype(float), (0, 8 - len(b)))).astype(int) for a, b in rows
            if a is not None and b is not None and None not in b and np.isfinite(b).all()}
    want = {}
    for q in (a for a in good if a % 20 == 0):
        best = sorted(((-int(good[q] @ v), a) for a, v in good.items() if a != q))[:5]
        want.update({(q, k + 1): (a, -s) for k, (s, a) in enumerate(best)})
    assert got == want
    assert search.top_k(search.integer_vectors(frame.limit(0)), "true").count() == 0
    assert search.top_k(search.integer_vectors(frame.where("vec_id < 3")), "true").count() == 6


def test_language_base_and_gain(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    fold = language.remainder("doc_id", 5)
    out = language.score_texts(docs.selectExpr("*", "'x' score", "1 n"), fold != 1).collect()
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [(r[0], [*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(up)), None]) for r in docs.collect()]
    counts = collections.Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(t)
    total, types = sum(counts.values()), len(counts)
    want = sorted((i if i is not None else -1, len(t), sum(counts[w] > 0 for w in t), sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t)) for i, t in rows)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["base_score"]) for r in out)
    assert all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True)) and out[0]["train_tokens"] == total
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert language.score_texts(docs.limit(0), fold != 1).count() == 0


def small_vocabulary():
    starts = np.arange(language.SHARED + 1)
    starts[8:] += 3
    inside = np.ones(starts[-1], np.int64)
    return language.Vocabulary(np.array([3, 5], np.uint64), np.array([9, 4]), np.array([0, language.OWN + starts[7] + 1]), 20, 4, starts, inside,
                               np.ones(language.SHARED, int), np.r_[9, np.zeros(language.OWN - 1, int)])


def test_model_is_normalised():
    vocab = small_vocabulary()
    model, _, _ = language.LogBilinear.start(vocab)
    near, far, normal = model.tables()
    assert abs(np.exp(near[4] + far[7] - normal[4, 7]).sum() - 1) < 1e-4
    rows = np.arange(vocab.starts[7], vocab.starts[8])
    inside = model.inside(vocab.starts, np.full(4, 7), rows, np.full(4, 4), np.full(4, 9))
    assert abs(np.exp(inside).sum() - 1) < 1e-5 and len(rows) == 4 and set(vocab.look_up(np.array([3, 5, 8], np.uint64), np.array([1, 7, 7]))[1].tolist()) == {0, language.OWN + 8, language.OWN + 7}


def test_language_does_not_depend_on_the_cut(spark):
    """Scores and gain are the same for every partitioning; columns named like those of the work are kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "text", "doc_id c", "'h' h", "1 _n", "struct(2 as a) _w", "3 row", "4 id", "5 rare", "6 codes")
    fold = language.remainder("doc_id", 5)
    want = None
    for parts in (1, 4, 32):
        out = language.score_texts(docs.repartition(parts), fold != 1).withColumn("fold", fold)
        assert out.columns[:9] == ["doc_id", "c", "h", "_n", "_w", "row", "id", "rare", "codes"]
        got = {r["doc_id"]: (r["fold"], r["n_tokens"], r["base_score"], r["score"]) for r in out.collect()}
        held = [v for v in got.values() if v[0] == 1]
        assert sum(v[3] - v[2] for v in held) / sum(v[1] for v in held) > 0.1
        want = want or got
        assert got.keys() == want.keys() and all(abs(got[i][3] - want[i][3]) < 1e-3 for i in want)


def test_own_vectors_grow_with_the_corpus(spark):
    def sizes(n):
        words = spark.range(n).selectExpr("concat('w', id) w", "30 + id % 7 k")
        vocab = language.vocabulary(language.count_words(words.selectExpr("array_join(array_repeat(w, cast(k as int)), ' ') text")))
        codes = vocab.codes[vocab.codes >= 0]
        assert len(set(codes.tolist())) == len(codes) and len(vocab.member_tokens) == vocab.starts[-1] and (vocab.member_tokens >= 0).all()
        return int((codes >= 0).sum())

    assert sizes(3000) > 2900 and sizes(30000) > 29000


def test_pipeline_keeps_columns_and_clean_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.selectExpr("*", "'x' as score", "1 as row"), "/root/testdata/sf0.001")
        assert out.columns == [*docs.columns, "score", "row"] and 0.8 * docs.count() <= out.count() <= docs.count(), name
    assert corpus_pipeline.packed(spark, docs, "").count() > 0

"""Toxicity by weak supervision.

Voters look at a text: lexicon voters for words and word beginnings that the learning rows' toxic texts have and the others
have not, and pattern voters for shouting and the like. A generative label model takes the true class as hidden: expectation
maximisation estimates how often each voter speaks in either class, then the voters' remaining correlation within the classes,
by which voters that repeat each other are discounted. Its posterior labels train a linear classifier on the same evidence,
which scores every text.

The fit uses a bounded sample of labelled rows (``fit_rows``); texts are scanned where they lie and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import text as X
from .fit import labelled_sample, logistic, remainder, sigmoid
from .store import cut

#: Labelled rows that the fit sees at most, and candidate features kept of them (a top-k).
FIT_ROWS, CANDIDATES = 24000, 4096
#: Bytes of the word beginnings that are evidence, beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: A lexicon voter's precision among differing texts, the toxic ones it must be in, and the chance that any of all features
#: tried would be in as many toxic texts without a reason.
PRECISION, SUPPORT, CHANCE = 0.95, 3, 0.05
PATTERNS = ("shouting", "exclaiming", "symbols", "bars", "repeating")


def evidence(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: rows, (text number, feature hash) of words and beginnings, pattern votes and a sketch of each text."""
    for rows, data, offsets in X.blocks(column):
        n = len(offsets) - 1
        start, end, text = X.words(data, offsets)
        prefix = X.prefixes(data, X.FOLDED)
        whole = X.spans_hash(prefix, start, end)
        owners, hashes = [text], [whole]
        for size in BEGINNINGS:
            long = end - start >= size
            hashes.append(X.mix(X.spans_hash(prefix, start[long], start[long] + size) + np.uint64(size)))
            owners.append(text[long])
        grams, owner = X.shingles(whole, text, n, 5)
        sketch = np.zeros(n, np.uint64)
        at = X.runs(owner, n)
        full = np.flatnonzero(at[1:] > at[:-1])
        if len(full):
            sketch[full] = np.minimum.reduceat(grams, at[:-1][full])

        def share(chosen: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(chosen)])
            return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, np.diff(offsets))

        again = np.zeros(len(text), bool)
        again[1:] = (text[1:] == text[:-1]) & (whole[1:] == whole[:-1])
        counts = np.bincount(text, minlength=n)
        votes = np.stack([share((data >= 65) & (data <= 90)) > 0.3, share(data == 33) > 0.02, share(np.isin(data, list(b"%$#&*"))) > 0.05,
                          share(data == 124) > 0.03, np.bincount(text[again], minlength=n) > 0.2 * np.maximum(1, counts)], 1)
        yield rows, np.concatenate(owners), np.concatenate(hashes), votes, sketch


@dataclass
class Model:
    """Sorted feature hashes, the classifier's weights for them and the patterns, intercept last."""

    features: np.ndarray
    weights: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        out, m = [], len(self.features)
        for rows, owner, h, votes, _ in evidence(column):
            text, place = self.hits(owner, h)
            z = np.bincount(text, self.weights[place], rows.stop - rows.start) + votes @ self.weights[m:-1] + self.weights[-1]
            out.append(sigmoid(z))
        return np.concatenate(out) if out else np.zeros(0)

    def hits(self, owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, number of the feature), sorted."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        hit = self.features[place] == h
        return np.divmod(np.unique(owner[hit] * len(self.features) + place[hit]), len(self.features))


def label_model(votes: np.ndarray, marks: np.ndarray, trust: float = 0.95, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, rate of speaking per class and voter, correlation of the voters within the classes).

    ``votes`` are 0/1. The rows' own marks are one more voter, right with probability ``trust``. Rates and the voters' residual
    correlations are first taken from the marks; correlated voters are discounted, and after the first estimate once more."""
    marked = np.where(marks > 0, 1, -1) * np.log(trust / (1 - trust))
    q = sigmoid(marked)

    def rates() -> np.ndarray:
        rate = np.stack([((1 - q) @ votes + 0.01) / ((1 - q).sum() + 1), (q @ votes + 0.01) / (q.sum() + 1)])
        return np.clip(rate, 1e-5, 1 - 1e-5)

    def correlations() -> np.ndarray:
        rest = votes - (q[:, None] * rate[1] + (1 - q)[:, None] * rate[0])
        spread = rest.std(0) + 1e-9
        return rest.T @ rest / len(rest) / spread[:, None] / spread[None]

    rate = rates()
    for _ in range(2):
        # Voters that repeat each other, in speech or silence, count as one.
        correlation = correlations()
        discount = 1 / (1 + np.maximum(correlation - np.eye(len(correlation)), 0).sum(0))
        for _ in range(rounds):
            rate = rates()
            speaks, silent = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
            prior = np.clip(q.mean(), 1e-4, 1 - 1e-4)
            q = sigmoid(np.log(prior / (1 - prior)) + marked + votes @ (discount * speaks) + (1 - votes) @ (discount * silent))
    rate, correlation = rates(), correlations()
    return q, rate, correlation


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` labelled rows that ``learnable`` holds for; without any, every score is low."""
    none = Model(np.zeros(0, np.uint64), np.r_[np.zeros(len(PATTERNS)), -4.0])
    sample = labelled_sample(labels, label, fit_rows, learnable)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    # An id that repeats counts once, so that the sample is bounded in rows.
    texts = cut(found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one")).select("label", "one.text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy()
            for rows, owner, h, _, _ in evidence(batch.column(1)):
                n = rows.stop - rows.start
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                h, toxic = h[first], y[rows][owner[first]]
                names, at = np.unique(h, return_index=True)
                pos = np.add.reduceat(toxic, at) if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.diff(np.r_[at, len(h)])), pa.array(pos.astype(np.int64))],
                                                 names=["h", "n", "pos"])

    total = texts.agg(F.count("*"), F.sum("label")).first()
    if not total[0] or not total[1] or total[1] == total[0]:
        return none
    base = total[1] / total[0]
    counted = texts.mapInArrow(count, "h bigint, n bigint, pos bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    counted = cut(counted.where(f"n >= {SUPPORT}"))
    tried = counted.count()
    # A top-k of features: those whose toxic texts exceed what chance gives by the most standard deviations.
    excess = (F.col("pos") - base * F.col("n")) / F.sqrt(base * (1 - base) * F.col("n"))
    best = counted.where(f"pos >= {SUPPORT}").orderBy(excess.desc(), "h").limit(CANDIDATES).select("h").collect()
    candidates = np.sort(np.array([r[0] for r in best], np.int64).view(np.uint64))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(candidates, np.zeros(0))
        for batch in batches:
            for rows, owner, h, votes, sketch in evidence(batch.column(1)):
                n, (text, place) = rows.stop - rows.start, model.hits(owner, h)
                told, pattern = np.nonzero(votes)
                text, place = np.concatenate([text, told]), np.concatenate([place, len(candidates) + pattern])
                order = np.argsort(text, kind="stable")
                found = pa.ListArray.from_arrays(pa.array(X.runs(text[order], n).astype(np.int32)), pa.array(place[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(sketch.view(np.int64)), found],
                                                 names=["label", "sketch", "found"])

    seen = texts.mapInArrow(look, "label int, sketch bigint, found array<int>").toArrow()
    return fit(candidates, seen.column("label").to_numpy(), seen.column("sketch").to_numpy(), seen.column("found").to_pylist(), tried)


def fit(candidates: np.ndarray, label: np.ndarray, sketch: np.ndarray, found: list[list[int]], tried: int) -> Model:
    """Voters, label model and classifier from the sample's evidence. Texts with one sketch are near copies: one counts."""
    order = np.lexsort((label, sketch))
    _, first = np.unique(sketch[order], return_index=True)
    kept = np.sort(order[first])
    y = label[kept].astype(float)
    m = len(candidates)
    pos, n = np.zeros(m + len(PATTERNS)), np.zeros(m + len(PATTERNS))
    for i, t in zip(kept, y, strict=True):
        n[found[i]] += 1
        pos[found[i]] += t
    # Few texts are enough for a voter, as long as so many toxic ones among them are no accident: the divergence from the base
    # rate bounds the chance of it, over all features tried.
    base, share = y.mean(), pos[:m] / np.maximum(1, n[:m])
    log = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-12) / b), 0.0)
    surprise = n[:m] * (log(share, base) + log(1 - share, 1 - base))
    lexicon = np.flatnonzero((pos[:m] >= np.maximum(SUPPORT, PRECISION * n[:m])) & (surprise >= np.log(max(1, tried) / CHANCE)))
    columns = np.r_[lexicon, m + np.arange(len(PATTERNS))]
    index = np.full(m + len(PATTERNS), -1)
    index[columns] = np.arange(len(columns))
    votes = np.zeros((len(kept), len(columns)), np.float32)
    for k, i in enumerate(kept):
        c = index[found[i]]
        votes[k, c[c >= 0]] = 1
    q, _, _ = label_model(votes, y)
    # Texts with the same votes weigh together: the fit is the same, and there are few different ones.
    packed, which = np.unique(np.packbits(votes > 0, axis=1), axis=0, return_inverse=True)
    many = np.bincount(which.ravel(), minlength=len(packed))
    different = np.unpackbits(packed, axis=1, count=len(columns)).astype(float)
    return Model(candidates[lexicon], logistic(different, np.bincount(which.ravel(), q, len(packed)) / many, many.astype(float), penalty=0.01))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but a clashing one, and ``score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*names, "score"])

    kept = docs.drop("score")
    names = kept.columns
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    return kept.select("*", F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS, fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``: rows whose crc32(doc_id as text) modulo fold[0] is fold[1] are held out
    from learning. Every row gets a score, null and empty texts that of a text without evidence; rows with a null id are not
    held out and never learnt from; repeated rows score alike; an empty table gives no rows; without labels all scores are
    low. Only the text is an input of a score."""
    learnable = remainder("doc_id", fold[0]) != fold[1]
    out = score(docs.drop("held_out", "predicted"), learn(docs, labels, learnable, fit_rows=fit_rows))
    return out.select("*", F.coalesce(remainder("doc_id", fold[0]) == fold[1], F.lit(False)).alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op4_toxicity": query}
ORACLES: dict[str, str] = {}

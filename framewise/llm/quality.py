"""Quality classifier by co-training.

Two views of a document are fitted apart: its text (shape of its characters, words and lines) and its metadata (language,
source, recorded length). In each round Spark scores all unlabelled documents by both views; the share of them that a view is
surest of, good and bad, grows with the rounds, and the other view learns from them as pseudo-labels. At the end each view is
calibrated on labelled rows that it was not fitted on, and the calibrated views are combined by one more logistic regression,
which scores every document.

Confidence is judged over all unlabelled documents, by counts of their scores. Fits see bounded samples (``fit_rows``) of the
labelled and of the pseudo-labelled rows; the views of the unlabelled ones are worked out once and written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import text as X
from .fit import apply, labelled_sample, logistic, remainder, sigmoid
from .store import cut

#: Rows of the samples of labelled and of pseudo-labelled rows, rounds, the part of the unlabelled rows that a view gives away
#: more in each round, and the weight of a pseudo-label.
FIT_ROWS, ROUNDS, GIVEN, WEIGHT = 20000, 6, 0.02, 0.5
#: A language or source with this part of the learning rows has a column of its own (so there are at most as many).
OWN_PART = 1 / 200
#: Bins of scores (log odds) and the widest score.
BINS, WIDEST = 2000, 30.0
SIGNS = b"%$#&*"


def text_view(column: pa.Array) -> np.ndarray:
    """Numbers of every text's shape; a text without bytes or words has zeros."""
    out = []
    for rows, data, offsets in X.blocks(column):
        n = len(offsets) - 1
        start, end, text = X.words(data, offsets, X.DARK)
        h = X.spans_hash(X.prefixes(data, X.FOLDED), start, end)
        size = np.maximum(1, np.diff(offsets))
        words = np.bincount(text, minlength=n)
        many = np.maximum(1, words)

        def share(chosen: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(chosen)])
            return (total[offsets[1:]] - total[offsets[:-1]]) / size

        again = np.zeros(len(text), bool)
        again[1:] = (text[1:] == text[:-1]) & (h[1:] == h[:-1])
        pairs = np.unique(np.stack([text.astype(np.uint64), h]), axis=1)[0] if len(h) else np.zeros(0, np.uint64)
        distinct = np.bincount(pairs.astype(np.int64), minlength=n)
        length = np.bincount(text, end - start, n)
        spread = np.bincount(text, (end - start).astype(float) ** 2, n)
        mean = length / many
        # Lines that are in the text before.
        line_s, line_e, line_t = X.words(data, offsets, np.arange(256) != 10)
        line_h = X.spans_hash(X.prefixes(data, X.EXACT), line_s, line_e)
        lines = np.bincount(line_t, minlength=n)
        known = np.unique(np.stack([line_t.astype(np.uint64), line_h]), axis=1)[0] if len(line_h) else np.zeros(0, np.uint64)
        fresh = np.bincount(known.astype(np.int64), minlength=n)
        upper, lower = share((data >= 65) & (data <= 90)), share((data >= 97) & (data <= 122))
        out.append(np.stack([
            np.log1p(words), mean / 10, np.sqrt(np.maximum(spread / many - mean**2, 0)) / 10, upper, upper / np.maximum(1e-3, upper + lower), share(np.isin(data, list(SIGNS))),
            share(data == 33), share(data == 124), share((data >= 48) & (data <= 57)), share(data >= 128), share(data == 46), share(data == 10) * 10,
            distinct / many, np.bincount(text[again], minlength=n) / many, 1 - fresh / np.maximum(1, lines), (share(data == 124) > 0.02) * 1.0,
            (share(np.isin(data, list(SIGNS))) > 0.03) * 1.0, (upper > 0.3) * 1.0, (words < 20) * 1.0, (distinct < 0.3 * many) * 1.0], 1))
    return np.concatenate(out) if out else np.zeros((0, 20))


def meta_view(columns: list[list[str]], lang: list, source: list, length: list) -> np.ndarray:
    """Language and source (the values in ``columns`` by themselves, all others together), and the recorded length; nulls are
    values of their own."""
    place = [{v: k for k, v in enumerate(values)} for values in columns]
    widths = [len(values) + 2 for values in columns]
    x = np.zeros((len(lang), sum(widths) + 5))
    rows = np.arange(len(lang))
    for known, base, values in zip(place, (0, widths[0]), (lang, source), strict=True):
        x[rows, [base + (len(known) if v is None else known.get(v, len(known) + 1)) for v in values]] = 1
    for i, c in enumerate(length):
        size = np.log10(1 + max(0, c or 0))
        x[i, sum(widths):] = size, (size - 3) ** 2, size > 3.5, size < 2.5, c is None
    return x


@dataclass
class Model:
    """Columns of the metadata view, both views' coefficients, their calibrations, and how the calibrated views are combined."""

    columns: list[list[str]]
    centre: np.ndarray
    scale: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    calibrations: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = apply(apply((text - self.centre) / self.scale, self.text)[:, None], self.calibrations[0])
        b = apply(apply(meta, self.meta)[:, None], self.calibrations[1])
        return sigmoid(apply(np.stack([a, b], 1), self.combined)), sigmoid(a), sigmoid(b)


def co_train(columns: list[list[str]], text: np.ndarray, meta: np.ndarray, label: np.ndarray, pool: DataFrame, rounds: int = ROUNDS, given: float = GIVEN,
             fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labelled rows, three of four for the views and the fourth for calibration, and on pseudo-labels from ``pool``."""
    centre, scale = text.mean(0), text.std(0) + 1e-6
    text = (text - centre) / scale
    apart = np.arange(len(label)) % 4 == 3
    base = ~apart
    y = label[base].astype(float)
    weights = [logistic(v[base], y, penalty=1.0) for v in (text, meta)]
    share = float(np.clip(y.mean(), 0.05, 0.95))
    for r in range(1, rounds + 1):
        sure = confident(pool, weights, centre, scale, share, given * r, fit_rows)
        if not sure:
            break
        for k, x in enumerate((text, meta)):
            other = sure[1 - k]
            rows = (other[0] - centre) / scale if k == 0 else other[1]
            marks = other[2]
            weight = np.r_[np.ones(len(y)), np.full(len(marks), WEIGHT)]
            weights[k] = logistic(np.vstack([x[base], rows]), np.r_[y, marks], weight, penalty=1.0)
    a, b = apply(text[apart], weights[0]), apply(meta[apart], weights[1])
    truth = label[apart].astype(float)
    calibrations = (logistic(a[:, None], truth, penalty=0.1), logistic(b[:, None], truth, penalty=0.1))
    both = np.stack([apply(a[:, None], calibrations[0]), apply(b[:, None], calibrations[1])], 1)
    return Model(columns, centre, scale, weights[0], weights[1], calibrations, logistic(both, truth, penalty=0.1))


def confident(pool: DataFrame, weights: list[np.ndarray], centre: np.ndarray, scale: np.ndarray, share: float, part: float,
              fit_rows: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For either view the (text view, metadata view, pseudo-label) of rows it is sure of: among the ``part`` of all rows of
    ``pool`` with its highest and lowest scores, and as sure as 19 to 1 of good, twice the usual share of bad. Cuts come
    from counts over all rows; of the rows within them about ``fit_rows`` with the least hashes are returned, never more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text, meta = (_matrix(batch.column(c), batch.num_rows) for c in ("text_view", "meta_view"))
            a, b = (np.clip(z, -WIDEST, WIDEST - 1e-9) for z in (apply((text - centre) / scale, weights[0]), apply(meta, weights[1])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b)], names=[*batch.schema.names, "z0", "z1"])

    scored = pool.mapInArrow(run, StructType([*pool.schema.fields, *StructType.fromDDL("z0 double, z1 double").fields]))
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("view"), F.floor((F.col(f"z{k}") + WIDEST) / (2 * WIDEST) * BINS).cast("int").alias("bin")) for k in (0, 1)])).alias("e")
    counts = np.zeros((2, BINS))
    for v, i, n in scored.select(bins).groupBy("e.view", "e.bin").count().collect():
        counts[v, i] = n
    total = counts[0].sum()
    if not total:
        return []
    chosen, near = [], []
    at = lambda i: i / BINS * 2 * WIDEST - WIDEST
    for k in (0, 1):
        up, down, filled = np.cumsum(counts[k][::-1])[::-1], np.cumsum(counts[k]), np.flatnonzero(counts[k])
        # As many bins as hold no more than the part; the outermost filled one in any case.
        first = int(np.argmax(up <= max(part * share * total, counts[k][filled[-1]])))
        last = int(np.flatnonzero(down <= max(part * (1 - share) * total, counts[k][filled[0]]))[-1])
        odds = min(0.5, share / 2)
        chosen.append(F.when(F.col(f"z{k}") >= max(np.log(19), at(first)), F.lit(1)).when(F.col(f"z{k}") < min(np.log(odds / (1 - odds)), at(last + 1)), F.lit(0)))
        # Of so many rows at most, those with hashes below a bound are about ``fit_rows``: nothing needs to be ordered.
        near.append(F.expr("shiftrightunsigned(h, 11)") / float(1 << 53) <= float(min(1.0, fit_rows / max(1.0, up[first] + down[last]))))
    marked = scored.select("h", "text_view", "meta_view", *[F.when(near[k], chosen[k]).alias(f"m{k}") for k in (0, 1)])
    seen = marked.where("m0 is not null or m1 is not null").toArrow()
    order = np.argsort(seen.column("h").to_numpy().view(np.uint64), kind="stable")
    text, meta = _matrix(seen.column("text_view").combine_chunks(), len(order), len(centre))[order], _matrix(seen.column("meta_view").combine_chunks(), len(order), len(weights[1]) - 1)[order]
    out = []
    for k in (0, 1):
        marks = seen.column(f"m{k}").to_pandas().to_numpy(float)[order]
        mine = np.flatnonzero(~np.isnan(marks))[:fit_rows]
        out.append((text[mine], meta[mine], marks[mine]))
    return out


def _matrix(lists: pa.Array, n: int, width: int | None = None) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, (width or 1) if n == 0 else -1) if n else np.zeros((0, width or 0))


def _views(df: DataFrame, columns: list[list[str]]) -> DataFrame:
    """``doc_id, h, label, text_view, meta_view``: both views as arrays, and a hash that tells different rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta = text_view(batch.column("text")), meta_view(columns, *(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "h", "label")], pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))],
                                             names=["doc_id", "h", "label", "text_view", "meta_view"])

    rows = df.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "label", "text", "lang", "source", "n_chars")
    return rows.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, h bigint, label int, text_view array<double>, meta_view array<double>")


def unlabelled(rows: DataFrame, labels: DataFrame, columns: list[list[str]]) -> DataFrame:
    """Views of the rows whose id has no label. Views are worked out before the join, so that no text travels for it."""
    known = labels.select("doc_id").where("doc_id is not null").distinct()
    return _views(rows.withColumn("label", F.lit(None).cast("int")), columns).join(known, "doc_id", "left_anti").drop("doc_id")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS, fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """``doc_id, held_out, score, predicted, text_score, meta_score`` of every row of ``doc_id, text, lang, source, n_chars``.

    ``score`` is the probability that quality is 1. Rows whose crc32(doc_id as text) modulo fold[0] is fold[1] are held out:
    they are neither learnt from nor pseudo-labelled. Null texts and metadata are scored as values of their own; rows with null
    ids are scored, not learnt from; repeated rows score alike; an empty table gives no rows; without labels of both kinds
    every score is 0.5. Other columns are ignored.
    """
    inputs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                         F.col("source").cast("string").alias("source"), F.col("n_chars").cast("bigint").alias("n_chars"))
    held: Column = F.coalesce(remainder("doc_id", fold[0]) == fold[1], F.lit(False))
    model = learn(inputs, labels, remainder("doc_id", fold[0]) != fold[1], fit_rows)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None:
                parts = [np.full(n, 0.5)] * 3
            else:
                parts = model.scores(text_view(batch.column("text")), meta_view(model.columns, *(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(p, pa.float64()) for p in parts]], names=["doc_id", "score", "text_score", "meta_score"])

    out = inputs.mapInArrow(run, f"doc_id {id_type}, score double, text_score double, meta_score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_score", "meta_score")


def learn(inputs: DataFrame, labels: DataFrame, learnable: Column, fit_rows: int) -> Model | None:
    sample = labelled_sample(labels, "quality", fit_rows, learnable)
    rows = inputs.where(learnable)
    total = rows.count()
    columns = [sorted(r[0] for r in rows.where(F.col(c).isNotNull()).groupBy(c).count().where(F.col("count") >= total * OWN_PART).select(c).collect()) for c in ("lang", "source")]
    # An id that repeats is learnt from once.
    marked = inputs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("one")).select("doc_id", "label", "one.*")
    seen = _views(marked, columns).toArrow()
    if not seen.num_rows:
        return None
    text = np.array(seen.column("text_view").to_pylist())
    meta = np.array(seen.column("meta_view").to_pylist())
    label = seen.column("label").to_numpy()
    order = np.lexsort([*text.T, seen.column("h").to_numpy()])
    if len(order) < 8 or label.min() == label.max():
        return None
    return co_train(columns, text[order], meta[order], label[order], cut(unlabelled(rows, labels, columns)), fit_rows=fit_rows)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: quality of every document."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_quality_classifier": query}
ORACLES: dict[str, str] = {}

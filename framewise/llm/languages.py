"""Languages of texts by hierarchical discrimination.

Languages are first gathered into families: the mean profiles of their learning texts are merged, nearest first, until the
next merge would join the two sides of the widest gap. A first level of linear support vector machines tells families apart;
inside the chosen family one machine per pair of languages tells those that are close. Margins become probabilities by a
logistic fit, pairs vote with their probabilities, and the score of a language is that of its family times its own in it.

A text is the square roots of its counts of letter sequences (one to four bytes, with the gap between words) and of whole
words, hashed into ``COLUMNS`` columns and scaled to length one. Machines are fitted in numpy on a bounded sample that has
equal shares of all languages; all texts are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import text as X
from .fit import logistic, remainder, sigmoid
from .store import cut

#: Columns of a profile, longest letter sequence, texts whose profiles a task holds at a time.
COLUMNS, LONGEST, HELD = 4096, 4, 128
#: Learning texts of all languages together, weight of the machines' errors.
FIT_ROWS, COST = 4000, 4.0
#: Rows of a table that may be broadcast.
SMALL = 100_000
#: Texts a side needs for a logistic curve of its own, and the curve of the others.
SCARCE, PLAIN = 10, (4.0, 0.0)
#: Letters in lower case; everything else is a gap.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)
SOUND = X.byte_table(31)
UNKNOWN = "und"


def profiles(column: pa.Array) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows and their profiles (float32, length one or zero), at most ``HELD`` at a time."""
    for rows, data, offsets in X.blocks(column):
        letters, n = LETTERS[data], len(offsets) - 1
        gap, owner = letters == 32, np.repeat(np.arange(n), np.diff(offsets))
        prefix = X.prefixes(letters, SOUND)
        at, columns = [], []
        for k in range(1, LONGEST + 1):
            if len(letters) < k:
                break
            i = np.arange(len(letters) - k + 1)
            # Sequences inside a word, or with one gap at an end; those over two words or texts, or of gaps alone, say nothing.
            inner = np.zeros(len(i), bool)
            for j in range(1, k - 1):
                inner |= gap[j:len(i) + j]
            i = i[~inner & ~(gap[:len(i)] & gap[k - 1:]) & (owner[:len(i)] == owner[k - 1:])]
            at.append(i)
            columns.append(X.spans_hash(prefix, i, i + k))
        start, end, _ = X.words(letters, offsets, ~(np.arange(256) == 32))
        at.append(start)
        columns.append(X.spans_hash(prefix, start, end) ^ X.BASE)
        at, column_of = np.concatenate(at), (X.mix(np.concatenate(columns)) % np.uint64(COLUMNS)).astype(np.int64)
        text = owner[at]
        order = np.argsort(text, kind="stable")
        text, column_of = text[order], column_of[order]
        for first in range(0, n, HELD):
            last = min(first + HELD, n)
            a, b = np.searchsorted(text, [first, last])
            x = np.bincount((text[a:b] - first) * COLUMNS + column_of[a:b], minlength=(last - first) * COLUMNS)
            x = np.sqrt(x.reshape(last - first, COLUMNS).astype(np.float32))
            yield slice(rows.start + first, rows.start + last), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def times(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Product in the matrix's own precision, so that it is not copied."""
    return (x @ v.astype(x.dtype)).astype(float)


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = 30) -> np.ndarray:
    """Weights (intercept last) of a linear machine with squared hinge loss for y of -1 and 1, both sides weighing alike.

    Newton steps on the rows inside the margin, each solved by conjugate gradients."""
    x = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * cost * len(y)
    w = np.zeros(x.shape[1])

    def value(v: np.ndarray) -> float:
        return float(v @ v / 2 + (weight * np.maximum(0, 1 - y * times(x, v)) ** 2).sum())

    now = value(w)
    for _ in range(rounds):
        slack = 1 - y * times(x, w)
        on = slack > 0
        inside, scale = x[on], weight[on]
        grad = w - 2 * times(inside.T, scale * y[on] * slack[on])
        step, left = np.zeros_like(w), -grad
        way, size = left.copy(), left @ left
        aim = size * 1e-4
        for _ in range(40):
            if size <= aim or size == 0:
                break
            bent = way + 2 * times(inside.T, scale * times(inside, way))
            far = size / (way @ bent)
            step += far * way
            left = left - far * bent
            new = left @ left
            way, size = left + new / size * way, new
        rate = 1.0
        while rate > 1e-3 and (next_value := value(w + rate * step)) > now:
            rate /= 2
        if rate <= 1e-3 or now - next_value < 1e-5 * max(1.0, now):
            break
        w, now = w + rate * step, next_value
    return w


@dataclass
class Pairs:
    """One machine per pair of classes: weights, and slope and intercept of their margins' logistic curves."""

    classes: int
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    curves: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, classes: int) -> Pairs:
        pairs = list(combinations(range(classes), 2))
        weights, curves = np.zeros((len(pairs), x.shape[1] + 1)), np.zeros((len(pairs), 2))
        for k, (a, b) in enumerate(pairs):
            rows = np.flatnonzero((y == a) | (y == b))
            sign = np.where(y[rows] == a, 1.0, -1.0)
            weights[k], curves[k] = support_vectors(x[rows], sign), PLAIN
            if min((sign > 0).sum(), (sign < 0).sum()) < SCARCE:
                continue
            # Margins of rows the machine has not learnt from give the curve.
            fold, margin = np.arange(len(rows)) % 3, np.empty(len(rows))
            for f in range(3):
                learn = fold != f
                w = support_vectors(x[rows[learn]], sign[learn], rounds=10)
                margin[~learn] = x[rows[~learn]] @ w[:-1] + w[-1]
            balance = np.where(sign > 0, 0.5 / (sign > 0).mean(), 0.5 / (sign < 0).mean())
            curve = logistic(margin[:, None], (sign > 0).astype(float), balance, penalty=1e-3)
            if curve[0] > 0:
                curves[k] = curve
        return Pairs(classes, pairs, weights, curves)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean probability of each class against all others, summing to one."""
        if self.classes == 1:
            return np.ones((len(x), 1))
        p = sigmoid((x @ self.weights[:, :-1].T.astype(np.float32) + self.weights[:, -1]) * self.curves[:, 0] + self.curves[:, 1])
        out = np.zeros((len(x), self.classes))
        for k, (a, b) in enumerate(self.pairs):
            out[:, a] += p[:, k]
            out[:, b] += 1 - p[:, k]
        return out / out.sum(1, keepdims=True)


def families(means: np.ndarray) -> list[list[int]]:
    """Families of languages by the cosines of their mean profiles: merged by mean likeness, cut at the widest gap between
    the likenesses of two merges (two or fewer languages are one family)."""
    n = len(means)
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    like = unit @ unit.T
    groups, steps = [[i] for i in range(n)], []
    history = [[list(g) for g in groups]]
    while len(groups) > 1:
        score, a, b = max(((like[np.ix_(groups[a], groups[b])].mean(), -a, -b) for a, b in combinations(range(len(groups)), 2)))
        groups[-a] = groups[-a] + groups[-b]
        groups.pop(-b)
        steps.append(score)
        history.append([sorted(g) for g in groups])
    if n <= 2:
        return history[-1] if n else []
    # At least one merge happens and at least two families stay.
    drop = np.array(steps[:-1]) - np.array(steps[1:])
    return sorted(history[int(drop.argmax()) + 1])


@dataclass
class Discriminator:
    """Languages, their families, the machines between families and those inside each."""

    names: list[str]
    groups: list[list[int]]
    top: Pairs
    inside: list[Pairs]

    @staticmethod
    def fit(x: np.ndarray, labels: list[str], groups: list[list[str]] | None = None) -> Discriminator:
        names = sorted(set(labels))
        place = {n: i for i, n in enumerate(names)}
        y = np.array([place[v] for v in labels])
        if groups is None:
            own = families(np.stack([x[y == i].mean(0) for i in range(len(names))]))
        else:
            own = [[place[n] for n in g if n in place] for g in groups]
            own = [g for g in own if g] + [[i] for i in range(len(names)) if not any(names[i] in g for g in groups)]
        family = np.zeros(len(names), np.int64)
        inner = np.zeros(len(names), np.int64)
        for f, members in enumerate(own):
            family[members] = f
            inner[members] = np.arange(len(members))
        inside = [Pairs.fit(x[family[y] == f], inner[y[family[y] == f]], len(members)) for f, members in enumerate(own)]
        return Discriminator(names, own, Pairs.fit(x, family[y], len(own)), inside)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, score): the likeliest family first, then the likeliest language in it."""
        top = self.top.probabilities(x)
        family = top.argmax(1)
        name, score = np.zeros(len(x), np.int64), np.zeros(len(x))
        for f, members in enumerate(self.groups):
            rows = np.flatnonzero(family == f)
            if len(rows):
                p = self.inside[f].probabilities(x[rows])
                best = p.argmax(1)
                name[rows] = np.array(members)[best]
                score[rows] = top[rows, f] * p[np.arange(len(rows)), best]
        return name, score


def learning_texts(docs: DataFrame, learn: Column, label: str, text_col: str, rows: int) -> DataFrame:
    """``label, text``: at most ``rows`` texts, of every language as many as of any other that has more, by least hashes."""
    good = docs.select(F.col(label).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(learn, F.lit(False)).alias("learn")).where("learn and label is not null").where(_has_letter("text"))
    # Repeated texts would teach nothing new and could fill a share.
    names = ["label", "h1", "h2"]
    hashed = good.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64("text", F.lit(5)))
    distinct = cut(hashed.select(*names).distinct())
    sizes = cut(distinct.groupBy("label").agg(F.count("*").alias("n")))
    many = sizes.count()
    share = max(1, rows // max(1, many))
    # Hashes below a bound leave few more than a share of each language, so that no task orders all texts of one.
    least = F.expr("shiftrightunsigned(h1, 11)") / F.lit(float(1 << 53)) * F.col("n") <= share + 5 * share**0.5 + 10
    near = cut(distinct.join(F.broadcast(sizes) if many <= SMALL else sizes, "label").where(least).select(*names))
    first = Window.partitionBy("label").orderBy(F.expr("shiftrightunsigned(h1, 11)"), "h2")
    picked = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= share).drop("k")
    return hashed.join(F.broadcast(picked), names, "left_semi").dropDuplicates(names).orderBy(*names).select("label", "text")


def _has_letter(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def detect(docs: DataFrame, learn: Column, label: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS,
           groups: list[list[str]] | None = None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row. Learns from the texts and labels of the rows that ``learn`` names; nothing but
    the text is an input of a prediction. ``groups`` gives families that are known; otherwise they are learnt.

    At most ``fit_rows`` texts are learnt from (each language has the same share, one text at least). Null texts and those
    without a letter are ``und`` with score 0; so are all if there is nothing to learn from. Repeated rows give repeated
    results, other columns are ignored, an empty table gives no rows.
    """
    sample = learning_texts(docs, learn, label, text_col, fit_rows).toArrow()
    labels = sample.column("label").to_pylist()
    model = None
    if labels:
        text = sample.column("text").combine_chunks()
        x = np.concatenate([p for _, p in profiles(text)])
        model = Discriminator.fit(x, labels, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                none = pa.nulls(batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), none, pa.array(np.zeros(batch.num_rows)), batch.column(2)], names=["doc_id", "lang_pred", "score", "letter"])
                continue
            names = pa.array(model.names)
            for rows, x in profiles(batch.column(1)):
                name, score = model.predict(x)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], names.take(pa.array(name)), pa.array(score), batch.column(2)[rows]],
                                                 names=["doc_id", "lang_pred", "score", "letter"])

    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *StructType.fromDDL("lang_pred string, score double, letter boolean").fields])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), _has_letter(text_col).alias("letter"))
    known = F.col("letter") & F.col("lang_pred").isNotNull()
    return rows.mapInArrow(run, schema).select("doc_id", F.when(known, F.col("lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
                                               F.when(known, F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: language of every document, learnt from two thirds of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = remainder("doc_id", 3)
    return detect(docs, fold != 1).select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op11_language_id": query}
ORACLES: dict[str, str] = {}

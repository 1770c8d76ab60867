"""Scores of texts by a log-bilinear language model trained with noise-contrastive estimation.

A word is predicted in two steps, each normalised exactly. First its class: the commonest words are a class each, the others
share one by how they end. The score of a class after the classes (u, v) is (a[v] + b[u]) . r + bias; because it is a sum over
the two context words, the normalisers of all contexts are one matrix product. Then the word in its shared class: every word
that is frequent enough has a vector of its own and is scored in the same way against the other members of its class; the
rest of a class is one more member, inside which words follow their smoothed training counts.

How many words have vectors grows with the corpus: all that have ``FEW`` occurrences and a ``2**-OWN_BITS`` part of the tokens,
so that the model stays within ``2**OWN_BITS`` vectors. Counts cover all learning texts; those of rarer words are joined.

Training is synchronous. Texts are dealt by a hash of their rows into shards of about ``SHARD`` tokens, in an order of their own, once
and as numbers. In each round every shard starts from the common parameters and makes its noise-contrastive steps in numpy;
Spark averages the changes, each vector's by how often the shards saw it. Updates grow with the tokens, and neither shards nor
results depend on how the table is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import text as X
from .fit import remainder, sigmoid
from .store import cut

#: Words with a class of their own, classes of all others, width of the vectors.
OWN, SHARED, WIDTH = 1024, 512, 16
#: Occurrences that earn a word its own vector; such words are at least this part (a power of two) of all tokens.
FEW, OWN_BITS = 20, 18
#: Words whose counts tasks hold (2**20 * 20 bytes at most); the others' are joined.
HELD = 1 << 20
#: Tokens of a step and of a shard, noise classes of a step, noise words of a token, step size, synchronised rounds.
STEP, SHARD, NOISE, OTHERS, RATE, ROUNDS = 4096, 1 << 21, 32, 3, 0.15, 3
#: The closing token's name among word hashes, and the context before a text.
END, BEFORE = np.uint64(0x656E64), OWN + SHARED


@dataclass
class Vocabulary:
    """Held words (sorted hashes, their counts, their codes or -1), and the shared classes: first row of each among all
    members (its rest), and the words without vectors in it.

    A code below ``OWN`` is a class of one word; others are ``OWN`` + the row of the member in its shared class."""

    words: np.ndarray
    counts: np.ndarray
    codes: np.ndarray
    tokens: int
    types: int
    starts: np.ndarray
    member_tokens: np.ndarray
    rest_types: np.ndarray
    single_tokens: np.ndarray

    @property
    def row_class(self) -> np.ndarray:
        return np.repeat(np.arange(SHARED), np.diff(self.starts))

    @property
    def rest_tokens(self) -> np.ndarray:
        return self.member_tokens[self.starts[:-1]]

    def look_up(self, h: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1 where it is not held, code) of word hashes with their shared classes."""
        rest = OWN + self.starts[shared]
        if not len(self.words):
            return np.full(len(h), -1), rest
        place = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[place] == h
        code = np.where(hit, self.codes[place], -1)
        return np.where(hit, self.counts[place], -1), np.where(code >= 0, code, rest)

    def classes(self, code: np.ndarray) -> np.ndarray:
        return np.where(code < OWN, code, OWN + self.row_class[np.maximum(code - OWN, 0)])


def tokens(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: rows, then hash, shared class and text number of every token, each text's end included."""
    for rows, data, offsets in X.blocks(column):
        n = len(offsets) - 1
        start, end, text = X.words(data, offsets, X.DARK)
        prefix = X.prefixes(data, X.FOLDED)
        place = np.arange(len(text)) + text
        closing = X.runs(text, n)[1:] + np.arange(n)
        h = np.empty(len(text) + n, np.uint64)
        shared = np.zeros(len(h), np.int64)
        owner = np.empty(len(h), np.int64)
        h[place], h[closing] = X.spans_hash(prefix, start, end), END
        shared[place] = (X.spans_hash(prefix, np.maximum(start, end - 3), end) % np.uint64(SHARED)).astype(np.int64)
        owner[place], owner[closing] = text, np.arange(n)
        yield rows, h, shared, owner


def contexts(classes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class before and class before that; what stands before a text is a class of its own."""
    one, two = np.full(len(classes), BEFORE), np.full(len(classes), BEFORE)
    one[1:] = np.where(owner[1:] == owner[:-1], classes[:-1], BEFORE)
    two[2:] = np.where(owner[2:] == owner[:-2], classes[:-2], BEFORE)
    return one, two


def count_words(texts: DataFrame) -> DataFrame:
    """``h, shared, c`` of all tokens of the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, shared, _ in tokens(batch.column(0)):
                names, first, c = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(shared[first].astype(np.int32)), pa.array(c)], names=["h", "shared", "c"])

    return texts.select("text").mapInArrow(run, "h bigint, shared int, c bigint").groupBy("h").agg(F.max("shared").alias("shared"), F.sum("c").alias("c"))


def vocabulary(counted: DataFrame, held: int = HELD) -> Vocabulary:
    """Tables of bounded size from the counts of all words."""
    end = int(END)
    # How many words there are from each size of count up; the least size that keeps the table within ``held`` words.
    level = F.floor(F.log2("c") * 8).cast("int")
    steps = sorted(((r[0], r[1]) for r in counted.groupBy(level.alias("level")).count().collect()), reverse=True)
    floor, total = steps[0][0] + 1 if steps else 0, 0
    for at, n in steps:
        if total + n > held:
            break
        floor, total = at, total + n
    table = counted.where((level >= floor) | (F.col("h") == end)).select("h", "shared", "c").toArrow()
    h = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    h, c, shared = h[order], table.column("c").to_numpy()[order], table.column("shared").to_numpy()[order].astype(np.int64)
    all_tokens, all_types = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for r in counted.groupBy("shared").agg(F.sum("c"), F.count("*")).collect():
        all_tokens[r[0]], all_types[r[0]] = r[1], r[2]
    tokens_all = int(all_tokens.sum())
    codes = np.full(len(h), -1)
    ranked = np.lexsort((h, -c, h != END))
    single = ranked[:OWN]
    codes[single] = np.arange(len(single))
    single_tokens = np.zeros(OWN, np.int64)
    single_tokens[:len(single)] = c[single]
    member = ranked[OWN:]
    member = member[c[member] >= max(FEW, tokens_all / (1 << OWN_BITS))]
    member = member[np.lexsort((h[member], -c[member], shared[member]))]
    # Rows of a shared class: its rest, then its members.
    sizes = np.bincount(shared[member], minlength=SHARED) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    row = np.arange(len(member)) + shared[member] + 1
    codes[member] = OWN + row
    member_tokens = np.zeros(starts[-1], np.int64)
    member_tokens[row] = c[member]
    rest_tokens, rest_types = all_tokens.copy(), all_types.copy()
    named = np.concatenate([single, member])
    np.subtract.at(rest_tokens, shared[named], c[named])
    np.subtract.at(rest_types, shared[named], 1)
    member_tokens[starts[:-1]] = rest_tokens
    return Vocabulary(h, c, codes, tokens_all, int(all_types.sum()), starts, member_tokens, rest_types, single_tokens)


@dataclass
class LogBilinear:
    """Context vectors (near, far), class vectors and biases; the same for members of shared classes."""

    near: np.ndarray
    far: np.ndarray
    word: np.ndarray
    bias: np.ndarray
    near_in: np.ndarray
    far_in: np.ndarray
    member: np.ndarray
    member_bias: np.ndarray

    @staticmethod
    def start(vocab: Vocabulary, seed: int = 7) -> tuple[LogBilinear, np.ndarray, np.ndarray]:
        """Small random vectors, biases that give the training frequencies, and the frequencies of classes and members."""
        frequency = 0.5 + np.concatenate([vocab.single_tokens, np.add.reduceat(vocab.member_tokens, vocab.starts[:-1])])
        frequency = frequency / frequency.sum()
        inside = vocab.member_tokens + 0.5
        inside = inside / np.add.reduceat(inside, vocab.starts[:-1])[vocab.row_class]
        draw = np.random.default_rng(seed)
        make = lambda n: (draw.standard_normal((n, WIDTH)) * 0.1).astype(np.float32)
        return LogBilinear(make(BEFORE + 1), make(BEFORE + 1), make(BEFORE), np.log(frequency).astype(np.float32), make(BEFORE + 1), make(BEFORE + 1),
                           make(len(inside)), np.log(inside).astype(np.float32)), frequency, inside

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by the class before and by the one before that, and log normalisers of all pairs of them."""
        near, far = self.near @ self.word.T + self.bias, self.far @ self.word.T
        top_n, top_f = near.max(1, keepdims=True), far.max(1, keepdims=True)
        product = np.exp(near - top_n) @ np.exp(far - top_f).T
        return near, far, np.log(np.maximum(product, 1e-30)) + top_n + top_f.T

    def inside(self, starts: np.ndarray, shared: np.ndarray, row: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Log-probability of each row in its shared class, given the classes before; normalised over the class's members."""
        out = np.zeros(len(row), np.float32)
        order = np.argsort(shared, kind="stable")
        bounds = np.searchsorted(shared[order], np.arange(SHARED + 1))
        query = self.near_in[one] + self.far_in[two]
        for s in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
            low, high = starts[s], starts[s + 1]
            if high - low == 1:
                continue
            at = order[bounds[s]:bounds[s + 1]]
            scores = query[at] @ self.member[low:high].T + self.member_bias[low:high]
            top = scores.max(1)
            out[at] = scores[np.arange(len(at)), row[at] - low] - top - np.log(np.exp(scores - top[:, None]).sum(1))
        return out


class Trainer:
    """Noise-contrastive steps from common parameters, with step sizes per parameter; noise classes are shared by a step,
    noise words are drawn for each token from its class."""

    def __init__(self, model: LogBilinear, vocab: Vocabulary, frequency: np.ndarray, inside: np.ndarray, rate: float, seed: int):
        self.start = model
        self.p = [np.array(p) for p in (model.near, model.far, model.word, model.bias, model.near_in, model.far_in, model.member, model.member_bias)]
        self.past = [np.full(p.shape, 1e-2, np.float32) for p in self.p]
        self.seen = [np.zeros(len(p)) for p in self.p]
        self.rate, self.draw = rate, np.random.default_rng(seed)
        self.log_noise, self.total = np.log(NOISE * frequency).astype(np.float32), np.cumsum(frequency)
        # Members are drawn from their class: the cumulative frequency of all rows grows by one in each class.
        self.log_inside, self.inside, self.row_class = np.log(OTHERS * inside).astype(np.float32), np.cumsum(inside), vocab.row_class
        self.low = np.concatenate([[0.0], self.inside])[vocab.starts[:-1]]
        self.starts = vocab.starts

    def move(self, k: int, d: np.ndarray, at: np.ndarray, rows: np.ndarray | None = None) -> None:
        """One step of parameter k; ``rows`` are those it moves (None: all)."""
        if rows is None:
            self.past[k] += d * d
            self.p[k] += self.rate * d / np.sqrt(self.past[k])
        else:
            self.past[k][rows] += d * d
            self.p[k][rows] += self.rate * d / np.sqrt(self.past[k][rows])
        self.seen[k] += np.bincount(at, minlength=len(self.seen[k]))

    def step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        near, far, word, bias = self.p[:4]
        n = len(w)
        noise = np.minimum(np.searchsorted(self.total, self.draw.random(NOISE)), len(self.total) - 1)
        q = near[one] + far[two]
        right = (1 - sigmoid(np.einsum("ij,ij->i", q, word[w]) + bias[w] - self.log_noise[w])).astype(np.float32)
        wrong = -sigmoid(q @ word[noise].T + bias[noise] - self.log_noise[noise]).astype(np.float32)
        dq = right[:, None] * word[w] + wrong @ word[noise]
        dw = sums(w, right[:, None] * q, len(word))
        np.add.at(dw, noise, wrong.T @ q)
        db = np.bincount(w, right, len(bias))
        np.add.at(db, noise, wrong.sum(0))
        by = (len(word) ** 0.5 / n)
        for k, d, at in ((0, sums(one, dq, len(near)), one), (1, sums(two, dq, len(far)), two), (2, dw, w), (3, db, w)):
            self.move(k, (d * by).astype(np.float32), at)

    def step_inside(self, row: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        near, far, member, bias = self.p[4:]
        n = len(row)
        if not n:
            return
        shared = self.row_class[row]
        width = self.starts[shared + 1] - self.starts[shared]
        noise = np.searchsorted(self.inside, self.low[shared][:, None] + self.draw.random((n, OTHERS)))
        noise = np.minimum(np.maximum(noise, self.starts[shared][:, None]), (self.starts[shared] + width - 1)[:, None])
        q = near[one] + far[two]
        right = (1 - sigmoid(np.einsum("ij,ij->i", q, member[row]) + bias[row] - self.log_inside[row])).astype(np.float32)
        wrong = -sigmoid(np.einsum("ij,ikj->ik", q, member[noise]) + bias[noise] - self.log_inside[noise]).astype(np.float32)
        dq = right[:, None] * member[row] + np.einsum("ik,ikj->ij", wrong, member[noise])
        at = np.concatenate([row, noise.ravel()])
        touched, place = np.unique(at, return_inverse=True)
        force = np.concatenate([right, wrong.ravel()])
        dm = sums(place, force[:, None] * np.concatenate([q, np.repeat(q, OTHERS, axis=0)]), len(touched))
        db = np.bincount(place, force, len(touched))
        by = len(near) ** 0.5 / n
        self.move(4, (sums(one, dq, len(near)) * by).astype(np.float32), one)
        self.move(5, (sums(two, dq, len(far)) * by).astype(np.float32), two)
        self.move(6, (dm * by).astype(np.float32), row, touched)
        self.move(7, (db * by).astype(np.float32), row, touched)

    def changes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, weight, changes of vector and bias) of all rows that the shard saw."""
        s = self.start
        rows, weights, values, base = [], [], [], 0
        for k, (vector, bias) in enumerate(((0, None), (1, None), (2, 3), (4, None), (5, None), (6, 7))):
            first = (s.near, s.far, s.word, s.near_in, s.far_in, s.member)[k]
            at = np.flatnonzero(self.seen[vector])
            d = np.zeros((len(at), WIDTH + 1), np.float32)
            d[:, :WIDTH] = self.p[vector][at] - first[at]
            if bias is not None:
                d[:, WIDTH] = self.p[bias][at] - (s.bias if bias == 3 else s.member_bias)[at]
            rows.append(base + at)
            weights.append(self.seen[vector][at])
            values.append(d)
            base += len(first)
        return np.concatenate(rows), np.concatenate(weights), np.concatenate(values)


def sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], 1)


def encode(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``shard, place, codes`` of all rows of ``text, place``, sorted within shards by ``place``."""
    shards = max(1, -(-vocab.tokens // SHARD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, h, shared, owner in tokens(batch.column(0)):
                _, codes = vocab.look_up(h, shared)
                bounds = X.runs(owner, rows.stop - rows.start).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(1)[rows], pa.ListArray.from_arrays(pa.array(bounds), pa.array(codes.astype(np.int32)))], names=["place", "codes"])

    rows = texts.select("text", "place").mapInArrow(run, "place bigint, codes array<int>")
    shard = F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int")
    return rows.select(shard.alias("shard"), "place", "codes").repartition(shards, "shard").sortWithinPartitions("shard", "place")


def train(encoded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> LogBilinear:
    """Synchronised rounds over the shards; every text takes part in one of them."""
    model, frequency, inside = LogBilinear.start(vocab)
    names = [f"v{k}" for k in range(WIDTH + 1)]

    for r in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model: LogBilinear = model, r: int = r) -> Iterator[pa.RecordBatch]:
            trainer, shard, held, at = None, None, [], 0
            row_class = vocab.row_class

            def work(codes: np.ndarray, owner: np.ndarray) -> None:
                classes = np.where(codes < OWN, codes, OWN + row_class[np.maximum(codes - OWN, 0)])
                one, two = contexts(classes, owner)
                for a in range(0, len(codes), STEP):
                    s = slice(a, a + STEP)
                    trainer.step(classes[s], one[s], two[s])
                    many = np.flatnonzero(codes[s] >= OWN) + a
                    trainer.step_inside(codes[many] - OWN, one[many], two[many])

            def flush() -> Iterator[pa.RecordBatch]:
                if held:
                    work(np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held]))
                rows, weights, values = trainer.changes()
                yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(weights.astype(np.float32)),
                                                  *[pa.array(values[:, k]) for k in range(WIDTH + 1)]], names=["at", "weight", *names])

            for batch in batches:
                shards, lists = batch.column(0).to_numpy(), batch.column(1)
                bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                for i in range(batch.num_rows):
                    if shards[i] != shard:
                        if trainer is not None:
                            yield from flush()
                        shard, held, at = int(shards[i]), [], 0
                        trainer = Trainer(model, vocab, frequency, inside, RATE / (1 + r) ** 0.5, 11 + shard * rounds + r)
                        size = 0
                    if at % rounds == r:
                        held.append(flat[bounds[i]:bounds[i + 1]].astype(np.int64))
                        size += len(held[-1])
                        if size >= 16 * STEP:
                            work(np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held]))
                            held, size = [], 0
                    at += 1
            if trainer is not None:
                yield from flush()

        parts = encoded.select("shard", "codes").mapInArrow(run, "at int, weight float, " + ", ".join(f"{n} float" for n in names))
        mean = parts.groupBy("at").agg(*[(F.sum(F.col(n) * F.col("weight")) / F.sum("weight")).cast("float").alias(n) for n in names]).toArrow()
        if not mean.num_rows:
            return model
        at = mean.column("at").to_numpy()
        change = np.stack([mean.column(n).to_numpy() for n in names], 1)
        sizes = np.cumsum([len(p) for p in (model.near, model.far, model.word, model.near_in, model.far_in, model.member)])
        every = np.zeros((sizes[-1], WIDTH + 1), np.float32)
        every[at] = change
        near, far, word, near_in, far_in, member = np.split(every, sizes[:-1])
        model = LogBilinear(model.near + near[:, :WIDTH], model.far + far[:, :WIDTH], model.word + word[:, :WIDTH], model.bias + word[:, WIDTH],
                            model.near_in + near_in[:, :WIDTH], model.far_in + far_in[:, :WIDTH], model.member + member[:, :WIDTH], model.member_bias + member[:, WIDTH])
    return model


def score_texts(docs: DataFrame, learnable: Column, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` without its text, with ``n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are runs of other than white space, A-Z in lower case, and one end per text. ``learnable`` says which rows are
    learnt from. Null and empty texts are just the end. Repeated rows score alike; an empty table gives no rows; with nothing
    to learn from every word is unknown. Columns of ``docs`` with the names of results are replaced, all others are kept.
    """
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = [n for n in docs.columns if n not in ("text", *results)]
    # Shards are dealt by a hash of the row, so that copies of a text under different ids are spread.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    text = F.col("text").cast("string")
    learning = docs.where(F.coalesce(learnable, F.lit(False))).select(text.alias("text"), F.xxhash64(text, *hashed).alias("place"))
    counted = cut(count_words(learning))
    vocab = vocabulary(counted)
    model = train(cut(encode(learning, vocab)), vocab, rounds) if vocab.tokens else LogBilinear.start(vocab)[0]
    base = np.log10(vocab.tokens + 0.5 * (vocab.types + 1))
    rest = np.log10(vocab.rest_tokens + 0.5 * (vocab.rest_types + 1))
    single = pa.struct([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far, normal = model.tables()
        row_class, is_rest = vocab.row_class, np.zeros(len(vocab.member_tokens), bool)
        is_rest[vocab.starts[:-1]] = True
        for batch in batches:
            for rows, h, shared, owner in tokens(batch.column(1)):
                n = rows.stop - rows.start
                count, codes = vocab.look_up(h, shared)
                many = np.flatnonzero(codes >= OWN)
                row = codes[many] - OWN
                classes = codes.copy()
                classes[many] = OWN + row_class[row]
                one, two = contexts(classes, owner)
                logs = near[one, classes] + far[two, classes] - normal[one, two]
                logs[many] += model.inside(vocab.starts, row_class[row], row, one[many], two[many])
                logs = logs / np.log(10)
                held = count >= 0
                word = np.where(held, np.log10(np.maximum(count, 0) + 0.5), 0.0)
                # Words without a vector follow their counts in the rest of their class.
                last = many[is_rest[row]]
                logs[last] += word[last] - rest[classes[last] - OWN]
                size = np.bincount(owner, minlength=n)
                rare_h, rare_t = h[~held], owner[~held]
                order = np.lexsort((rare_h, rare_t))
                rare_h, rare_t = rare_h[order], rare_t[order]
                first = np.flatnonzero(np.r_[True, (rare_h[1:] != rare_h[:-1]) | (rare_t[1:] != rare_t[:-1])]) if len(order) else np.zeros(0, np.int64)
                values = pa.StructArray.from_arrays([pa.array(rare_h[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(order)]))], fields=list(single))
                bounds = X.runs(rare_t[first], n).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(size), pa.array(np.bincount(owner[held], minlength=n)), pa.array(np.bincount(owner, word, n) - size * base),
                     pa.array(np.bincount(owner, logs, n)), pa.ListArray.from_arrays(pa.array(bounds), values)],
                    names=["row", "n_tokens", "n_known", "base_score", "score", "rare"])

    # A row's own columns travel as one; they cannot clash with those of the work.
    carried = docs.select(F.struct(F.lit(0).alias("0"), *[F.col(f"`{n}`") for n in names]).alias("row"), F.col("text").cast("string").alias("text"))
    schema = StructType([StructField("row", carried.schema["row"].dataType), *StructType.fromDDL(
        "n_tokens bigint, n_known bigint, base_score double, score double, rare array<struct<h: bigint, n: bigint>>").fields])
    local = cut(carried.mapInArrow(run, schema).withColumn("id", F.monotonically_increasing_id()))
    # Words that tasks do not hold: their counts are joined, and summed per row.
    rare = local.select("id", F.explode("rare").alias("w")).select("id", "w.h", "w.n").join(counted.select("h", "c"), "h", "left")
    c = F.coalesce("c", F.lit(0))
    more = rare.groupBy("id").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"))
    alone, shared = local.where("size(rare) = 0"), local.where("size(rare) > 0")
    out = shared.drop("rare").join(more, "id").select("row", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"),
                                                      (F.col("base_score") + F.col("logs")).alias("base_score"), (F.col("score") + F.col("logs")).alias("score"))
    out = out.unionByName(alone.select("row", "n_tokens", "n_known", "base_score", "score"))
    return out.select(*[F.col("row").getField(n).alias(n) for n in names], "n_tokens", "n_known", F.lit(vocab.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: base and model score of every document. The text itself is not carried through the join."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = remainder("doc_id", 5)
    return score_texts(docs, fold != 1).select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm_scoring": query}
ORACLES: dict[str, str] = {}

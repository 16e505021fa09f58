"""Scoring texts by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The model predicts the class of the next token: one of the most frequent words, a class of rarer words, or the end of the text.
A context's vector is the sum of one vector for each of the two tokens before (a rarer word has its class's); its product with a
class's vector, plus the class's bias, is the class's score. Training compares each token with noise drawn from the class
frequencies, so it needs no normaliser; scoring normalises over all classes, for all pairs of tokens before by one matrix product
(or, where classes are many, for the pairs of a block, slice by slice).

Rarer words are dealt by hash to a class and to one of SLOTS slots. Within its class a word weighs (count + 1) times exp of the
context's product with its slot's vector, which is learned the same way; the normaliser is the sum over the class's slots. Every
slot of a class keeps one more for an unknown word. Classes grow with the cube root of the distinct words, so what a worker holds grows
far more slowly than they do; every word's count is gathered and used.

Trainers, as many as the square root of the text's size calls for, each train on all training tokens they read, from the same
start; their parameters are averaged by their tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millwatch.llm.tables import packed_id, stored, unpacked
from millwatch.llm.words import Words, blocks, mix, split, to_bytes

#: Words with a class of their own, and classes of rarer words: so many, and GROWTH times the cube root of the distinct words more.
CLASSES, RARE_CLASSES, GROWTH = 1000, 64, 2
SLOTS = 32
WIDTH = 24
#: With so many classes at most, the normalisers of all pairs are one table (4 bytes a pair).
PAIR_CLASSES = 3000
#: Trainers: the square root of the text's bytes over this.
TRAINER_BYTES = 500_000
NOISE = 32
RATE = 0.05
#: Counts of this many words at most go to every task (16 bytes each); rarer words are joined.
HEAD = 262_144
#: Bytes of text taken together.
TEXT_BYTES = 1 << 20
_UNIT = 1024.0
_PART = 4096
#: Parameters in a row that trainers send.
_SLICE = 65_536


class Vocabulary(NamedTuple):
    top: np.ndarray  # hashes of the classes' words, ascending
    top_counts: np.ndarray
    head: np.ndarray  # hashes of frequent words, ascending
    head_counts: np.ndarray
    tokens: int
    distinct: int
    texts: int
    cells: np.ndarray | None = None  # sums of count + 1 of the rarer words by class and slot; without, there is one of each

    @property
    def rare(self) -> int:
        """The first class of rarer words."""
        return len(self.top)

    @property
    def end(self) -> int:
        return len(self.top) + self.side

    @property
    def side(self) -> int:
        return 1 if self.cells is None else len(self.cells)

    @property
    def slots(self) -> int:
        return 1 if self.cells is None else self.cells.shape[1]

    def weights(self) -> np.ndarray:
        """``cells`` with an unknown word in each."""
        if self.cells is None:
            return np.array([[max(0, self.rare_tokens()) + self.rare_words() + 1.0]])
        return self.cells + 1.0

    def rare_tokens(self) -> int:
        return self.tokens - self.texts - self.top_counts.sum()

    def class_counts(self) -> np.ndarray:
        weights = self.weights().sum(axis=1)
        return np.concatenate((self.top_counts, self.rare_tokens() * weights / weights.sum(), [self.texts])).astype(np.float64)

    def rare_words(self) -> int:
        return max(0, self.distinct - (self.texts > 0)) - len(self.top)


class Model(NamedTuple):
    """Vectors of the token before, of the one before that (a last row stands for the text's start), of classes; biases;
    vectors of slots."""

    one: np.ndarray
    two: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    slot: np.ndarray


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _find(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of values in an ascending array."""
    if not len(sorted_values):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return at, sorted_values[at] == values


def cell(hashes: np.ndarray, side: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, slot) of rarer words."""
    value, half = mix(hashes + np.uint64(0x9E3779B97F4A7C15)), np.uint64(32)
    low = value & np.uint64(0xFFFFFFFF)
    return (((value >> half) * np.uint64(side)) >> half).astype(np.int64), ((low * np.uint64(slots)) >> half).astype(np.int64)


def _cells(counts: DataFrame, top: np.ndarray, side: int, slots: int) -> np.ndarray:
    """Sums of count + 1 of the rarer words by class and slot; the driver gets a number for each of these."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = pdf["word"].to_numpy(np.int64).view(np.uint64)
            rare = ~_find(top, words)[1]
            at, slot = cell(words[rare], side, slots)
            where, inverse = np.unique(at * slots + slot, return_inverse=True)
            yield pd.DataFrame({"cell": where, "n": np.bincount(inverse, pdf["c"].to_numpy(np.int64)[rare] + 1, len(where)).astype(np.int64)})

    out = np.zeros(side * slots)
    for x in counts.mapInPandas(place, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[x["cell"]] = x["n"]
    return out.reshape(side, slots)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = to_bytes(pdf["text"])
        for a, b in blocks(texts, TEXT_BYTES):
            word, n = np.unique(split(texts[a:b]).hashes, return_counts=True)
            yield pd.DataFrame({"word": word.view(np.int64), "n": n})


def count_words(train: DataFrame) -> DataFrame:
    """word (64-bit hash) and c over all training texts."""
    return stored(train.select("text").mapInPandas(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")


def _most(counts: DataFrame, rows: int) -> tuple[int, pd.DataFrame]:
    """(least count, rows) of the words that occur at least that often: as many as fit into ``rows``."""
    bins = counts.groupBy(F.when(F.col("c") < 4096, F.col("c")).otherwise(F.floor(F.log2("c") * 64) * 1_000_000).alias("bin"))
    sizes = sorted(((r["bin"], r["low"], r["n"]) for r in bins.agg(F.min("c").alias("low"), F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, 1 << 62
    for _, low, n in sizes:
        if total + n > rows:
            break
        total, least = total + n, low
    return least, counts.filter(F.col("c") >= least).toPandas()


def vocabulary(counts: DataFrame, texts: int, classes: int = CLASSES, head: int = HEAD) -> tuple[Vocabulary, int]:
    """The tables that every task gets, and the least count of a word in the head."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least, words = _most(counts, head)
    words["word"] = words["word"].to_numpy().astype(np.int64).view(np.uint64)
    words = words.sort_values(["c", "word"], ascending=[False, True])
    more = int(GROWTH * total["v"] ** (1 / 3))
    top, whole = words.head(classes + more).sort_values("word"), words.sort_values("word")
    arrays = [x.to_numpy() for x in (top["word"], top["c"], whole["word"], whole["c"])]
    rare = max(0, total["v"] - len(top))
    side, slots = min(RARE_CLASSES + more, rare // SLOTS + 1), min(SLOTS, rare + 1)
    return Vocabulary(*arrays, total["n"] + texts, total["v"] + (texts > 0), texts, _cells(counts, arrays[0], side, slots)), least


def sequences(words: Words, texts: int, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class of each token, the token before, the one before that, text of each token, its slot), every text closed by an end."""
    at, found = _find(voc.top, words.hashes)
    group, slots = cell(words.hashes, voc.side, voc.slots)
    classes = np.where(found, at, voc.rare + group)
    counts = np.diff(words.first)
    first = np.concatenate(([0], np.cumsum(counts + 1)))
    token = np.full(first[-1], voc.end, np.int64)
    text = np.repeat(np.arange(texts), counts + 1)
    slot, place = np.zeros(first[-1], np.int64), np.arange(len(classes)) + np.repeat(np.arange(texts), counts)
    token[place], slot[place] = classes, slots
    start = voc.end + 1
    one, two = np.concatenate(([start], token[:-1])), np.concatenate(([start, start], token[:-2]))
    one[first[:-1]] = two[first[:-1]] = start
    two[np.minimum(first[:-1] + 1, len(two) - 1)[counts > 0]] = start
    return token, one, two[: len(token)], text, slot


def start_model(voc: Vocabulary, width: int = WIDTH, seed: int = 3) -> Model:
    rng, k = np.random.default_rng(seed), voc.end + 1
    share = (voc.class_counts() + 1) / (voc.class_counts().sum() + k)
    small = lambda n: rng.normal(0, 0.1, (n, width)).astype(np.float32)
    return Model(small(k + 1), small(k + 1), small(k), np.log(share).astype(np.float32), np.zeros((voc.slots, width), np.float32))


def _sum_rows(place: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different places, sum of the rows of each)."""
    order = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 65_536 else place, kind="stable")  # short numbers sort fast
    ordered = place[order]
    cut = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[cut], np.add.reduceat(rows[order], cut, axis=0)


class Trainer:
    """Noise-contrastive estimation by minibatches that share their noise, with Adagrad steps."""

    def __init__(self, voc: Vocabulary, model: Model, seed: int, noise: int = NOISE):
        self.model, self.noise, self.rng = Model(*(x.copy() for x in model)), noise, np.random.default_rng(seed)
        share = np.exp(model.bias.astype(np.float64))
        self.cumulative = np.cumsum(share / share.sum())
        self.offset = (np.log(noise) + np.log(share / share.sum())).astype(np.float32)
        self.squares = [np.full(len(x), 1e-2, np.float32) for x in model]
        self.seen, self.rare = 0, voc.rare
        weights = voc.weights()
        of_slot = weights.sum(axis=0) / weights.sum()
        self.slots = np.cumsum(of_slot)
        self.inside = np.log(weights / (weights.sum(axis=1, keepdims=True) * of_slot * noise)).astype(np.float32)

    def _compare(self, h: np.ndarray, vectors: np.ndarray, target: np.ndarray, drawn: np.ndarray, true: np.ndarray, false: np.ndarray) -> tuple[np.ndarray, ...]:
        """(what goes back to h, places, their gradients, of true and of false scores), given the scores without the products."""
        right, wrong = vectors[target], vectors[drawn]
        up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, right) + true, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(h @ wrong.T + false, -30, 30)))
        places, rows = np.concatenate((target, drawn)), np.concatenate((up[:, None] * h, down.T @ h))
        return up[:, None] * right + down @ wrong, places, rows, up, down

    def _move(self, table: int, places: np.ndarray, rows: np.ndarray) -> None:
        """An Adagrad step of the rows that have a gradient; a row's steps follow how often it occurs."""
        value, square = self.model[table], self.squares[table]
        at, gradient = _sum_rows(places, rows)
        square[at] += (gradient**2).mean(axis=1) if gradient.ndim == 2 else gradient**2
        rate = RATE / np.sqrt(square[at])
        value[at] += gradient * (rate[:, None] if gradient.ndim == 2 else rate)

    def step(self, token: np.ndarray, one: np.ndarray, two: np.ndarray, slot: np.ndarray | None = None) -> None:
        m = self.model
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.noise)), len(m.bias) - 1)
        h, score = m.one[one] + m.two[two], m.bias - self.offset
        back, places, rows, up, down = self._compare(h, m.out, token, drawn, score[token], score[drawn])
        if slot is not None and len(self.slots) > 1:
            rare = np.flatnonzero((token >= self.rare) & (token < self.rare + len(self.inside)))
            if len(rare):
                group, own = token[rare] - self.rare, slot[rare]
                other = np.minimum(np.searchsorted(self.slots, self.rng.random(self.noise)), len(self.slots) - 1)
                more, to, gradient, _, _ = self._compare(h[rare], m.slot, own, other, self.inside[group, own], self.inside[group[:, None], other[None, :]])
                back[rare] += more
                self._move(4, to, gradient)
        self._move(0, one, back)
        self._move(1, two, back)
        self._move(2, places, rows)
        self._move(3, places, np.concatenate((up, down.sum(axis=0))))

    def learn(self, token: np.ndarray, one: np.ndarray, two: np.ndarray, slot: np.ndarray | None = None) -> None:
        """One pass over the tokens in random order, in small steps at first."""
        order, at = self.rng.permutation(len(token)), 0
        while at < len(order):
            size = 256 if self.seen < 200_000 else 2048
            part = order[at : at + size]
            self.step(token[part], one[part], two[part], None if slot is None else slot[part])
            at, self.seen = at + size, self.seen + len(part)


def _added(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["sums"].iloc[0]) // 8, np.int64)
    for sums in pdf["sums"]:
        total += np.frombuffer(sums, np.int64)
    return pd.DataFrame({"slice": [key[0]], "sums": [total.tobytes()]})


def train(texts: DataFrame, voc: Vocabulary) -> Model:
    """Average of the trainers' models, weighted by their tokens. Sums are taken in whole numbers, so their order is of no matter;
    trainers send them in slices."""
    start = start_model(voc)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trainer = Trainer(voc, start, seed=5)
        for pdf in batches:
            rows = to_bytes(pdf["text"])
            for a, b in blocks(rows, TEXT_BYTES):
                token, one, two, _, slot = sequences(split(rows[a:b]), b - a, voc)
                trainer.learn(token, one, two, slot)
        if trainer.seen:
            flat = np.concatenate([x.ravel() for x in trainer.model]).astype(np.float64)
            flat = np.concatenate(([trainer.seen], np.round(flat * trainer.seen * _UNIT))).astype(np.int64)
            for i, at in enumerate(range(0, len(flat), _SLICE)):
                yield pd.DataFrame({"slice": [i], "sums": [flat[at : at + _SLICE].tobytes()]})

    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    readers = texts.select("text").coalesce(max(16, math.isqrt(size // TRAINER_BYTES)))
    sums = readers.mapInPandas(run, "slice int, sums binary").groupBy("slice").applyInPandas(_added, "slice int, sums binary").collect()
    if not sums:
        return start
    values, out, at = np.concatenate([np.frombuffer(x["sums"], np.int64) for x in sorted(sums, key=lambda x: x["slice"])]), [], 1
    for x in start:
        out.append((values[at : at + x.size] / _UNIT / values[0]).reshape(x.shape))
        at += x.size
    return Model(*out)


class Scorer:
    """Log10 probabilities of tokens. The normalisers of all pairs of tokens before are a table, unless classes are too many."""

    def __init__(self, model: Model, voc: Vocabulary):
        self.voc, self.model = voc, Model(*(x.astype(np.float32) for x in model))
        self.rare_share = np.log10(max(0, voc.rare_tokens()) + voc.rare_words() + 1)
        self.weights = voc.weights().astype(np.float32)
        self.normal = self._table() if len(model.bias) <= PAIR_CLASSES else None

    def _table(self) -> np.ndarray:
        m = self.model
        second = m.two @ m.out.T
        high2 = second.max(axis=1)
        np.exp(np.subtract(second, high2[:, None], out=second), out=second)
        normal = np.empty((len(m.one), len(m.two)), np.float32)
        for at in range(0, len(m.one), 256):
            first = m.one[at : at + 256] @ m.out.T + m.bias
            high = first.max(axis=1)
            np.log(np.exp(first - high[:, None]) @ second.T, out=normal[at : at + 256])
            normal[at : at + 256] += high[:, None] + high2
        return normal

    def normalisers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logarithm of the sum over all classes of exp of their scores, for each pair of tokens before."""
        if self.normal is not None:
            return self.normal[one, two]
        m, (pairs, place) = self.model, np.unique(one * len(self.model.two) + two, return_inverse=True)
        out = np.empty(len(pairs), np.float32)
        for at in range(0, len(pairs), 1024):
            left, right = np.divmod(pairs[at : at + 1024], len(m.two))
            scores = (m.one[left] + m.two[right]) @ m.out.T + m.bias
            high = scores.max(axis=1)
            out[at : at + 1024] = np.log(np.exp(scores - high[:, None]).sum(axis=1)) + high
        return out[place]

    def classes(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's class."""
        m = self.model
        score = np.einsum("ij,ij->i", m.one[one] + m.two[two], m.out[token]) + m.bias[token]
        return (score - self.normalisers(one, two)) / np.log(10)

    def inside(self, group: np.ndarray, slot: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 of what a rarer word of count 0 has of its class; every other one has (count + 1) times that."""
        m, out = self.model, np.empty(len(group))
        for at in range(0, len(group), _PART):
            part = slice(at, at + _PART)
            scores = (m.one[one[part]] + m.two[two[part]]) @ m.slot.T
            high = scores.max(axis=1)
            total = np.einsum("ij,ij->i", self.weights[group[part]], np.exp(scores - high[:, None]))
            out[part] = scores[np.arange(len(scores)), slot[part]] - high - np.log(total)
        return out / np.log(10)

    def texts(self, texts: list[bytes]) -> dict[str, np.ndarray | list]:
        """Per text: tokens, known tokens, base and score as far as the head's counts go, and its words outside the head.

        A word outside the head adds log10(count + 1) to both scores, and one known token if its count is not 0.
        """
        voc, words, n = self.voc, split(texts), len(texts)
        token, one, two, text, slot = sequences(words, n, voc)
        log = self.classes(token, one, two)
        at, found = _find(voc.head, words.hashes)
        owner = np.repeat(np.arange(n), np.diff(words.first))
        counts = np.where(found, voc.head_counts[at] if len(voc.head) else 0, 0)
        rare = np.flatnonzero((token >= voc.rare) & (token < voc.end))
        inside = self.inside(token[rare] - voc.rare, slot[rare], one[rare], two[rare])
        outside_top = ~_find(voc.top, words.hashes)[1]
        own = np.log10(counts + 1.0)
        tokens = np.diff(words.first) + 1
        base = np.bincount(owner, own, n) + np.log10(voc.texts + 1) - tokens * np.log10(voc.tokens + voc.distinct + 1)
        score = np.bincount(text, log, n) + np.bincount(owner[outside_top], own[outside_top] + inside, n)
        key = np.stack((owner[~found].astype(np.uint64), words.hashes[~found]), axis=1)
        order = np.lexsort((key[:, 1], key[:, 0]))
        key = key[order]
        cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(cut, len(key)))
        ends = np.searchsorted(key[cut, 0], np.arange(1, n))
        return {
            "n_tokens": tokens, "n_known": np.bincount(owner[found], minlength=n) + (voc.texts > 0), "base_score": base, "score": score,
            "words": np.split(key[cut, 1].view(np.int64), ends), "times": np.split(times, ends),
        }


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out; a null id is not. Null and empty texts have one token, the end. With nothing to
    learn from, all counts are 0. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    plain = docs.select(packed_id(docs, key), docs[text].alias("text"), held_out(docs[key].cast("long")).alias("held_out"))
    train_texts = plain.filter(~F.col("held_out"))
    counts = count_words(train_texts)
    voc, least = vocabulary(counts, train_texts.count())
    model = train(train_texts, voc)
    shared = spark.sparkContext.broadcast((model, voc))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value)
        for pdf in batches:
            rows = to_bytes(pdf["text"])
            for a, b in blocks(rows, TEXT_BYTES):
                yield pdf.iloc[a:b][["doc_id", "held_out"]].assign(**scorer.texts(rows[a:b]))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<long>, times array<long>"
    parts = stored(plain.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    rest = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(counts.filter(F.col("c") < least), "word")
    rest = rest.groupBy(F.col("row").alias("r")).agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    out = parts.drop("words", "times").join(rest, F.col("row") == F.col("r"), "left")
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return unpacked(out).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )

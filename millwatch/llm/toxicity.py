"""Toxicity by a classifier chain over hashed words and character grams.

Categories are predicted one after another; each linear model also sees the probabilities of the categories before it, as
log odds. For training these come from models that have not seen the row (out of fold; equal texts share a fold), for prediction from the
models fitted on the whole sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millwatch.llm.grams import grams, letters, sigmoid, train
from millwatch.llm.tables import give_back, packed_id, stored, unpacked
from millwatch.llm.words import blocks, split, to_bytes

#: In the order of the chain: name, and when a label row belongs to it.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
BUCKETS = 1 << 20
GRAM = 5
SAMPLE_ROWS = 20_000
FEATURES = 300
FOLDS = 4
ROUNDS = 80
THRESHOLD = 0.5
#: Bytes of text that are taken together.
TEXT_BYTES = 2 << 20


class Model(NamedTuple):
    features: np.ndarray  # their buckets, ascending
    weights: list[np.ndarray]  # per category: the features, then the logits of the categories before
    biases: list[float]


def present(texts: list[bytes], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each feature that a text has, once each and in order; only wanted buckets (a mask) if given."""
    data, starts = letters(texts)
    at, value = grams(data, GRAM, inner_space=False)
    bucket = (value >> np.uint64(44)).astype(np.int64)
    if wanted is not None:
        keep = wanted[bucket]
        at, bucket = at[keep], bucket[keep]
    text = np.searchsorted(starts, at, "right") - 1
    inside = at + GRAM <= starts[text + 1]
    words = split([data[a : b - 1].tobytes() for a, b in zip(starts, starts[1:])], lower=False)
    own = ((words.hashes * np.uint64(3)) >> np.uint64(44)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    if wanted is not None:
        keep = wanted[own]
        own, owner = own[keep], owner[keep]
    both = np.unique(np.concatenate((text[inside] * BUCKETS + bucket[inside], owner * BUCKETS + own)))
    return both // BUCKETS, both % BUCKETS


def _counts(names: list[str], block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = to_bytes(pdf["text"])
            for a, b in blocks(texts, block):
                text, bucket = present(texts[a:b])
                n = np.bincount(bucket, minlength=BUCKETS)
                some = np.flatnonzero(n)
                out = {"bucket": some, "n": n[some]}
                for name in names:
                    out[name] = np.bincount(bucket, pdf[name].to_numpy()[a:b][text], BUCKETS)[some].astype(np.int64)
                yield pd.DataFrame(out)
        give_back()

    return run


def _rows(features: np.ndarray, names: list[str], block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.zeros(BUCKETS, bool)
        wanted[features] = True
        for pdf in batches:
            texts = to_bytes(pdf["text"])
            for a, b in blocks(texts, block):
                text, bucket = present(texts[a:b], wanted)
                cut = np.searchsorted(text, np.arange(1, b - a))
                yield pdf.iloc[a:b][["fold", *names]].assign(features=[f.tobytes() for f in np.split(np.searchsorted(features, bucket).astype(np.int32), cut)])
        give_back()

    return run


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, rows: int = SAMPLE_ROWS, features: int = FEATURES, key: str = "doc_id", text: str = "text", block: int = TEXT_BYTES) -> Model:
    """Train the chain on labelled documents.

    About ``rows`` of them, chosen by the hash of the id, are the sample (a bound on what the driver gets); a document with
    several label rows belongs to a category if one of them does. About ``block`` bytes of text are taken together. For each category the ``features`` that tell it apart best
    (chi-square over the sample) are kept. Without labels, or where a category has one value only, its model is a constant.
    """
    names = [name for name, _ in categories]
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id"))
    marks = marks.agg(*[F.max(F.coalesce(F.expr(rule), F.lit(False)).cast("int")).alias(name) for name, rule in categories])
    total = marks.count()
    part = min(1.0, rows / max(1, total))
    marks = marks.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1)
    plain = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).filter(F.col("text").isNotNull())
    sample = plain.join(F.broadcast(marks), F.col("doc_id") == F.col("_id"))
    sample = stored(sample.select("text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), *names), "toxicity-sample")
    sizes = sample.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    seen = sample.mapInPandas(_counts(names, block), "bucket long, n long, " + ", ".join(f"{c} long" for c in names))
    seen = seen.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).filter("n >= 3")
    seen = stored(seen, "toxicity-counts")
    best: set[int] = set()
    for c in names:
        if 0 < sizes[c] < sizes["n"]:
            expected = F.col("n") * F.lit(sizes[c] / sizes["n"])
            top = seen.select("bucket", ((F.col(c) - expected) ** 2 / expected).alias("chi")).orderBy(F.desc("chi"), "bucket").limit(features)
            best |= {r["bucket"] for r in top.collect()}
    chosen = np.array(sorted(best), np.int64)
    train_rows = sample.mapInPandas(_rows(chosen, names, block), "fold int, " + ", ".join(f"{c} int" for c in names) + ", features binary").collect()
    x = np.zeros((len(train_rows), len(chosen)), np.float32)
    for row, r in zip(x, train_rows):
        row[np.frombuffer(r["features"], np.int32)] = 1
    folds = np.array([r["fold"] for r in train_rows], np.int64)
    return chain(x, folds, [np.array([r[c] for r in train_rows], np.float64) for c in names], chosen)


def _one(x: np.ndarray, y: np.ndarray, before: int) -> tuple[np.ndarray, float]:
    """Weights and bias of one category; a constant if it has one value only.

    Features count by how far their rates inside and outside the category differ, so that rare tell-tale ones are learned as
    fast as common ones. The last ``before`` columns, earlier categories' logits, are taken as they are.
    """
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0, 1e-6, 1 - 1e-6))
        return np.zeros(x.shape[1]), float(np.log(rate / (1 - rate)))
    own = x.shape[1] - before
    inside, outside = x[y == 1, :own].sum(axis=0) + 0.5, x[y == 0, :own].sum(axis=0) + 0.5
    scale = np.ones(x.shape[1], np.float32)
    scale[:own] = np.abs(np.log(inside / (y.sum() + 1)) - np.log(outside / (len(y) - y.sum() + 1)))
    w, b = train(x * scale, y[:, None], l2=3e-4, rounds=ROUNDS)
    return w[:, 0] * scale, float(b[0])


def chain(x: np.ndarray, folds: np.ndarray, labels: list[np.ndarray], features: np.ndarray) -> Model:
    """Fit the categories in order; each gets the earlier ones' out-of-fold logits as further columns of x."""
    weights, biases = [], []
    for i, y in enumerate(labels):
        w, b = _one(x, y, i)
        weights.append(w)
        biases.append(b)
        out = np.full(len(y), b)
        for fold in np.unique(folds):
            held = folds == fold
            if not held.all():
                fw, fb = _one(x[~held], y[~held], i)
                out[held] = x[held] @ fw + fb
        x = np.column_stack((x, np.clip(out, -10, 10).astype(np.float32)))
    return Model(features, weights, biases)


def probabilities(model: Model, texts: list[bytes], block: int = TEXT_BYTES) -> np.ndarray:
    """A row per text, a column per category in chain order; about ``block`` bytes of text are taken together."""
    wanted = np.zeros(BUCKETS, bool)
    wanted[model.features] = True
    done = [np.zeros((0, len(model.weights)))]
    for a, b in blocks(texts, block):
        row, bucket = present(texts[a:b], wanted)
        column, before = np.searchsorted(model.features, bucket), np.zeros((b - a, 0))
        out = np.zeros((b - a, len(model.weights)))
        for i, (w, bias) in enumerate(zip(model.weights, model.biases)):
            score = np.bincount(row, w[column], b - a) + before @ w[len(model.features) :] + bias
            before = np.column_stack((before, np.clip(score, -10, 10)))
            out[:, i] = sigmoid(score)
        done.append(out)
    return np.concatenate(done)


def predict(docs: DataFrame, model: Model, categories=CATEGORIES, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, p_<category> in chain order, and toxic (the last category reaches the threshold).

    Null and empty texts have no feature: they get the bias alone, and are never toxic.
    """
    names = [f"p_{name}" for name, _ in categories]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["doc_id"]].assign(**dict(zip(names, probabilities(model, to_bytes(pdf["text"])).T)))
            yield out.assign(toxic=(out[names[-1]] >= threshold) & (pdf["text"].fillna("") != ""))

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean"
    return unpacked(docs.select(packed_id(docs, key), docs[text].alias("text")).mapInPandas(run, schema))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents and judge all."""
    return predict(docs, fit(docs, labels))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", block: int = TEXT_BYTES) -> DataFrame:
    """Rows of docs whose text is not toxic, all columns as they came; each text is judged where it lies, nothing is joined."""
    model = fit(docs, labels, key=key, text=text, block=block)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        out = pd.Series(probabilities(model, to_bytes(texts), block)[:, -1] >= threshold) & (texts.reset_index(drop=True) != "")
        give_back()
        return out

    return docs.filter(~toxic(F.coalesce(docs[text], F.lit(""))))

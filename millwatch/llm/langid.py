"""Language by error-correcting output codes over hashed character grams.

Every language has a codeword of +1 and -1; one binary classifier per bit is trained on gram frequencies. A text gets the
language whose codeword has the smallest sum of logistic losses against the classifiers' margins, and is flagged as ambiguous
where the runner-up is close.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from millwatch.llm.grams import grams, letters, train
from millwatch.llm.tables import packed_id, unpacked
from millwatch.llm.words import blocks, to_bytes

SIZES = (1, 2, 3, 4)
BUCKETS = 4096
#: Documents to learn from: of a language, of all together; languages to learn, the most frequent first.
PER_LANGUAGE, SAMPLE_ROWS, LANGUAGES = 1000, 8192, 1024
CLOSE = 0.2
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # a row of +1 and -1 per language
    weights: np.ndarray
    biases: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """All different splits for up to 7 languages, else the random code with the largest smallest distance of 50."""
    if n <= 7:
        splits = range(1, 1 << (n - 1)) if n > 1 else [0]
        return np.array([[1 if i == n - 1 or not s >> i & 1 else -1 for s in splits] for i in range(n)], np.int8)
    rng, bits, best, most = np.random.default_rng(seed), int(10 * np.ceil(np.log2(n))), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        products = code.astype(np.int64) @ code.T.astype(np.int64)
        np.fill_diagonal(products, -bits)
        if (bits - products.max()) // 2 > most:
            best, most = code, (bits - products.max()) // 2
    return best


def frequencies(texts: list[bytes]) -> np.ndarray:
    """Root of the share of each bucket in a text's grams of 1 to 4 bytes; the grams' sizes have equal parts."""
    data, starts = letters(texts)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for n in SIZES:
        at, value = grams(data, n)
        text = np.searchsorted(starts, at, "right") - 1
        inside = at + n <= starts[text + 1]
        bucket = (value >> np.uint64(52)).astype(np.int64)
        counts = np.bincount(text[inside] * BUCKETS + bucket[inside], minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
        out += counts / np.maximum(1, counts.sum(axis=1, keepdims=True)) / len(SIZES)
    return np.sqrt(out)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = to_bytes(pdf["text"])
        for a, b in _small(texts):
            x = frequencies(texts[a:b])
            some = [np.flatnonzero(r) for r in x]
            yield pdf.iloc[a:b][["lang"]].assign(places=[s.astype(np.int32).tobytes() for s in some], shares=[r[s].tobytes() for r, s in zip(x, some)])


def _small(texts: list[bytes]):
    """Blocks of about a megabyte and at most 512 texts."""
    for a, b in blocks(texts, 1 << 20):
        yield from ((i, min(i + 512, b)) for i in range(a, b, 512))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """Train on about ``per_language`` documents of each language, chosen by the hash of the id, and SAMPLE_ROWS in all (4,096 numbers
    each: a bound on what the driver gets, however many languages there are). The LANGUAGES most frequent are learned; rows
    without text or language are left out. None without any such row."""
    rows = docs.select(docs[key].alias("k"), docs[text].alias("text"), docs[lang].cast("string").alias("lang")).filter("lang IS NOT NULL AND trim(text) <> ''")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return None
    per_language = min(per_language, max(1, SAMPLE_ROWS // len(sizes)))
    parts = docs.sparkSession.createDataFrame([(k, int(min(1, per_language / n) * (1 << 30)) + 1) for k, n in sizes.items()], "l string, below long")
    some = rows.join(F.broadcast(parts), F.col("lang") == F.col("l")).filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.col("below"))
    sample = some.select("text", "lang").mapInPandas(_features, "lang string, places binary, shares binary").collect()
    languages = sorted(sizes)
    codes = codewords(len(languages))
    x = np.zeros((len(sample), BUCKETS), np.float32)
    for row, r in zip(x, sample):
        row[np.frombuffer(r["places"], np.int32)] = np.frombuffer(r["shares"], np.float32)
    number = {lang: i for i, lang in enumerate(languages)}
    y = (codes[[number[r["lang"]] for r in sample]] > 0).astype(np.float32)
    w, b = train(x, y, l2=1e-5, rounds=150)
    return Model(languages, codes, w.astype(np.float32), b)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, runner-up's score): losses of each codeword against the margins, as shares of one."""
    loss = np.logaddexp(0, -margins[:, None, :] * model.codes[None, :, :]).sum(axis=2)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    order = np.argsort(-share, axis=1, kind="stable")
    pick = np.arange(len(share))
    second = share[pick, order[:, 1]] if share.shape[1] > 1 else np.zeros(len(share))
    return order[:, 0], share[pick, order[:, 0]], second


def predict(docs: DataFrame, model: Model | None, close: float = CLOSE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (0 to 1), ambiguous (the runner-up is within ``close``).

    A null text, one without a letter, or any text where no language was learned is ``und`` with score 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = to_bytes(pdf["text"])
            for a, b in _small(texts):
                best, score, second = decode(model, frequencies(texts[a:b]) @ model.weights + model.biases)
                known = pdf["letters"].to_numpy()[a:b].astype(bool)
                yield pdf.iloc[a:b][["doc_id"]].assign(
                    lang_pred=np.where(known, np.array(model.languages, object)[best], UNKNOWN), score=np.where(known, score, 0.0),
                    ambiguous=known & (score - second < close),
                )

    plain = docs.select(packed_id(docs, key), docs[text].alias("text"), F.coalesce(docs[text].rlike("\\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return unpacked(plain).select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    return unpacked(plain.mapInPandas(run, "doc_id long, lang_pred string, score double, ambiguous boolean"))


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Learn from documents whose crc32(id as text) mod 5 is not 0, predict all: doc_id, held_out, lang_pred, score, ambiguous."""
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = predict(docs, fit(docs.filter(~held(docs[key])), key=key), key=key)
    return out.select("doc_id", held(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")

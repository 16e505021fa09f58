"""BPE encoding by a pair occurrence index over all new words of a block, and decoding.

A block's distinct words lie in one linked array of symbols. The index maps ranks of mergeable pairs, in bands, to all
positions of these pairs. Bands are taken in ascending order; of a band's positions each word merges those of its lowest rank,
all words at once, and the pairs that arise left and right of them are entered into their own bands. The word's other positions
go back to the band until it is empty. Words do not touch, so each takes its merges with ranks ascending. Positions that
a merge has used up have another rank, or none, when their turn comes. Chunks of text between
white space are remembered between the blocks of a task, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from millwatch.llm.tables import give_back, packed_id, unpacked
from millwatch.llm.words import blocks

# The white space of the vocabulary's pattern, and the byte alphabet's own printable ranges.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
MARK = "\n"  # between chunks that are cut into words together: white space, so in no word
MARKED = regex.compile(f"{PATTERN.pattern}|{MARK}")
NOT_SPACE, OTHER_SPACE = regex.compile(f"[^{SPACE}]+"), regex.compile("[\x1c-\x1f]")  # str.split() also cuts at the latter
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
# Letters and numbers of Unicode 17 and later, which the vocabulary's library (Unicode 16) takes for neither.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
# Capitals (from, to) that the library lowers and Python's tables may not know yet, and the first one's small letter.
LOWERED = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
WORD_END = "</w>"
MOST_CHUNKS = 300_000
MOST_CHARS = 16_000_000
#: Lowest rank of each band of the index; common pairs have low ranks.
BANDS = [0, *(1 << i for i in range(5, 31))]


def _characters(ranges: list[tuple[int, int]]) -> frozenset[str]:
    return frozenset(chr(c) for low, high in ranges for c in range(low, high + 1))


UNKNOWN, LOWER_SINCE = _characters(NEWER), {low + i: to + i for low, high, to in LOWERED for i in range(high - low + 1)}
CHANGED = frozenset(map(chr, LOWER_SINCE))


def words_of(chunk: str, pattern: regex.Pattern = PATTERN) -> list[str]:
    """Words of a chunk by the vocabulary's pattern, with letters, numbers and lower case as its library's Unicode tables have them."""
    if chunk.isascii():
        return pattern.findall(chunk)
    found = set(chunk)
    if not CHANGED.isdisjoint(found):
        chunk = chunk.translate(LOWER_SINCE)
        found = set(chunk)
    if UNKNOWN.isdisjoint(found):
        return pattern.findall(chunk)
    plain = "".join("_" if c in UNKNOWN else c for c in chunk)
    return [chunk[m.start() : m.end()] for m in pattern.finditer(plain)]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = {b for low, high in PRINTABLE for b in range(low, high + 1)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """A vocabulary with ranked merges, and the pair occurrence index that applies them. Without ``decoded``, decoded texts
    are not made nor kept (they are empty)."""

    def __init__(self, path: str, decoded: bool = True):
        self.decoded = decoded
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        vocab, merges = whole["model"]["vocab"], whole["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.texts = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        alphabet = byte_alphabet()
        self.byte = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + WORD_END] for c in alphabet], np.int32)
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.width = max(self.texts) + 1
        made = np.full(self.width, -1, np.int64)
        made[self.product] = np.arange(len(pairs))
        if len(np.unique(self.product)) < len(pairs) or (np.maximum(made[self.left], made[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("ascending ranks need merges whose product is new and whose parts are made before")
        self._table()
        self.none = len(pairs)
        self.band = (np.searchsorted(BANDS, np.arange(len(pairs) + 1), "right") - 1).astype(np.uint8)
        symbols = np.concatenate((self.byte, self.last))
        self.first = self.ranks(np.repeat(self.byte, 512), np.tile(symbols, 256)).reshape(256, 512)
        self.forget()

    def _table(self) -> None:
        """Hash table from pairs to ranks: ``slots`` has the rank or -1; a pair lies in the first free slot from its own on."""
        self.shift = 64 - max(4, (8 * len(self.left)).bit_length())
        self.slots = np.full((1 << 64 - self.shift) + len(self.left), -1, np.int32)
        self.pairs = self.left.astype(np.int64) * self.width + self.right
        for rank, at in enumerate(self._slot(self.pairs).tolist()):
            while self.slots[at] >= 0:
                at += 1
            self.slots[at] = rank

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; the number of merges where it has none."""
        want = a.astype(np.int64) * self.width + b
        at = self._slot(want)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.pairs[found] != want))
        while len(open_):
            at[open_] += 1
            other = found[open_] = self.slots[at[open_]]
            open_ = open_[(other >= 0) & (self.pairs[other] != want[open_])]
        found[found < 0] = len(self.left)
        return found

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): those of word i are ``ids[bounds[i]:bounds[i + 1]]``."""
        raw = np.frombuffer(MARK.join([*words, ""]).encode("utf-8"), np.uint8)
        marks = raw == ord(MARK)
        ends = np.flatnonzero(marks) - np.arange(len(words))
        raw = raw[~marks]
        n, none = len(raw), self.none
        symbol = self.byte[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends, prepend=0))
        following, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        following[ends - 1] = -1
        before[ends[:-1]] = before[:1] = -1
        code = raw.astype(np.int32)
        code[ends - 1] += 256
        rank = np.full(n, none, np.int32)
        rank[:-1] = self.first[raw[:-1], code[1:]]
        rank[ends - 1] = none
        del code, marks
        index: list[list[np.ndarray]] = [[] for _ in BANDS]

        def enter(starts: np.ndarray) -> None:
            found = rank[starts]
            starts, found = starts[found < none], found[found < none]
            if not len(starts):
                return
            band = self.band[found]
            starts, counts = starts[np.argsort(band, kind="stable")], np.bincount(band)
            cuts = np.cumsum(counts)
            for k in np.flatnonzero(counts).tolist():
                index[k].append(starts[cuts[k] - counts[k] : cuts[k]])

        enter(np.arange(n, dtype=np.int32))
        for k, band in enumerate(index):
            while band:
                p = np.sort(np.concatenate(band))
                p = p[np.diff(p, prepend=-1) != 0]
                band.clear()
                r = rank[p]
                here = self.band[r] == k
                here &= r < none
                p, r = p[here], r[here]
                if not len(p):
                    continue
                new = np.diff(word[p], prepend=-1) != 0
                lowest = r == np.minimum.reduceat(r, np.flatnonzero(new))[np.cumsum(new) - 1]
                if not lowest.all():
                    band.append(p[~lowest])
                    p, r = p[lowest], r[lowest]
                q = following[p]
                same_run = np.concatenate(([False], q[:-1] == p[1:]))
                if same_run.any():  # occurrences of a doubled symbol overlap: from the left, every other one of a run
                    first = np.maximum.accumulate(np.where(same_run, 0, np.arange(len(p))))
                    pick = (np.arange(len(p)) - first) % 2 == 0
                    p, q, r = p[pick], q[pick], r[pick]
                symbol[p], symbol[q], rank[q] = self.product[r], -1, none
                far = following[q]
                following[p] = far
                before[far[far >= 0]] = p[far >= 0]
                rank[p[far < 0]] = none
                near = before[p]
                starts = np.concatenate((near[near >= 0], p[far >= 0]))
                rank[starts] = self.ranks(symbol[starts], symbol[following[starts]])
                enter(starts)
        alive = symbol >= 0
        return symbol[alive], np.concatenate(([0], np.cumsum(alive)[ends - 1]))

    def chunks(self, text: str) -> list[str]:
        """Runs without white space of a text, after NFC and lower case character by character; special tokens stand alone.

        Special tokens are found in the raw text; a space before their text tells them from a chunk that lower case makes alike. No word of the pattern reaches across white space, so a chunk's ids depend
        on the chunk only.
        """
        if any(s in text for s in self.special):
            parts = regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text)
            return [c for part in parts for c in ([" " + part] if part in self.special else self.chunks(part))]
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return NOT_SPACE.findall(text) if OTHER_SPACE.search(text) else text.split()

    def forget(self) -> None:
        """Chunks get numbers as they come; special tokens have the first. ``ids[bounds[n]:bounds[n + 1]]`` are the ids of chunk n."""
        self.ids_of: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.id_text: list[str] = []
        self.text_of: list[str] = []
        self.chars = 0

    def _remember(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        """The ids of the next chunks by number."""
        self.ids = np.concatenate((self.ids, ids))
        self.bounds = np.concatenate((self.bounds, bounds[1:] + self.bounds[-1]))
        if self.decoded:
            for kept, of in ((self.id_text, str), (self.text_of, self.texts.__getitem__)):
                said = list(map(of, ids.tolist()))
                kept.extend(" ".join(said[i:j]) for i, j in zip(bounds.tolist(), bounds[1:].tolist()))

    def learn(self, new: list[str]) -> None:
        """Encode the words of new chunks, all at once."""
        found = words_of(MARK.join([*new, ""]), MARKED)
        number: defaultdict[str, int] = defaultdict(count().__next__)
        number[MARK]
        found = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        ids, bounds = self.encode_words([*islice(number, 1, None)])
        bounds = np.concatenate(([0], bounds))  # a mark has no ids
        ids, ends = _gathered(ids, bounds[found], bounds[found + 1])
        self._remember(ids, np.concatenate(([0], ends[found == 0])))
        self.chars += sum(map(len, new))

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, first): the numbers of the chunks of text i are ``chunks[first[i]:first[i + 1]]``."""
        if len(self.ids_of) > MOST_CHUNKS or self.chars > MOST_CHARS:
            self.forget()
        if not self.ids_of:
            for text in self.special:
                self.ids_of[" " + text]
            self._remember(np.array([*self.special.values()], np.int32), np.arange(len(self.special) + 1))
        chunks, known = [self.chunks(t) for t in texts], len(self.ids_of)
        first = np.cumsum([0, *map(len, chunks)])
        found = np.fromiter(map(self.ids_of.__getitem__, chain.from_iterable(chunks)), np.int64, first[-1])
        if len(self.ids_of) > known:
            self.learn([*islice(self.ids_of, known, None)])
        return found, first

    def encode_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of text i are ``ids[first[i]:first[i + 1]]``."""
        chunks, first = self.numbers(texts)
        ids, ends = _gathered(self.ids, self.bounds[chunks], self.bounds[chunks + 1])
        return ids, np.concatenate(([0], ends))[first]

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(ids as text, decoded text) of each text; the decoder joins the tokens by a space."""
        if not self.decoded:
            ids, first = self.encode_ids(texts)
            yield from ((" ".join(map(str, ids[i:j].tolist())), "") for i, j in zip(first, first[1:]))
            return
        chunks, first = self.numbers(texts)
        for i, j in zip(first, first[1:]):
            own = chunks[i:j].tolist()
            yield " ".join(map(self.id_text.__getitem__, own)), " ".join(map(self.text_of.__getitem__, own))


def _gathered(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All the ranges ``values[start:end]`` in a row, and where each of them ends there."""
    ends = np.cumsum(end - start)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(end - ends, end - start)], ends


_LOADED: dict[tuple[str, bool], Merges] = {}


def loaded(path: str, decoded: bool = True) -> Merges:
    """The vocabulary, read once per Python worker."""
    if (path, decoded) not in _LOADED:
        give_back()
        _LOADED[path, decoded] = Merges(path, decoded)
        give_back()
    return _LOADED[path, decoded]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _batches(batches: Iterator[pd.DataFrame], path: str, row) -> Iterator[pd.DataFrame]:
    merges = loaded(path)
    for pdf in batches:
        texts = ["" if t is None else t for t in pdf["text"]]
        for a, b in blocks(texts, TEXT_BYTES):
            out = [row(ids, decoded) for ids, decoded in merges.encode(texts[a:b])]
            yield pdf.iloc[a:b][["doc_id"]].assign(**{k: [o[k] for o in out] for k in out[0]})
    give_back()


#: Bytes of text whose new words are encoded together.
TEXT_BYTES = 8 << 20


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", block: int = TEXT_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (array of int). Null and empty texts have no ids.

    Workers forget the chunks at the end of a task, so that they leave their memory to the stages that follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = loaded(path, decoded=False)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in blocks(texts, block):
                ids, first = merges.encode_ids(texts[a:b])
                found = [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))]
                yield pa.RecordBatch.from_arrays(found, ["doc_id", "n_tokens", "ids"])
        merges.forget()
        give_back()

    return unpacked(docs.select(packed_id(docs, key), docs[text].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>"))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256 (of the ids joined by a space), decoded_sha256.

    Repeated rows are encoded each; null ids stay null. Whole texts of any length are encoded; a run without white space is
    one word and costs memory in proportion to its length.
    """

    def run(batches):
        row = lambda ids, decoded: {"n_tokens": ids.count(" ") + 1 if ids else 0, "ids_sha256": _digest(ids), "decoded_sha256": _digest(decoded)}
        return _batches(batches, path, row)

    plain = docs.select(packed_id(docs, key), docs[text].alias("text"))
    return unpacked(plain.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and decoded text of rows with an array of ids; unknown ids are left out, null gives an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = loaded(path).texts
        for pdf in batches:
            yield pdf[["doc_id"]].assign(decoded=[" ".join([texts[i] for i in row if i in texts]) for row in pdf["ids"]])

    empty = F.array().cast("array<int>")
    plain = tokens.select(packed_id(tokens, key), F.coalesce(tokens[ids], empty).alias("ids"))
    return unpacked(plain.mapInPandas(run, "doc_id long, decoded string"))

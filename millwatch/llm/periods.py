"""Periodic runs of words in whole texts: recursive frequency splitting, then a scan by lags.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), of at least
``max(least, times * q)`` words, that no neighbouring word extends. Each of its words occurs at least ``times`` times within
it. So a word that occurs less often within a segment lies in no run and splits the segment; the parts are split again by their
own counts until nothing changes. What is left is compared with itself at every lag q a segment has room for, first at
multiples of q only (a run holds ``times - 1`` equal ones in a row) and word by word where those agree.

All texts of a block are split and scanned together in numpy arrays; a document never leaves its row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from millwatch.llm.tables import SPACES, packed_id, unpacked
from millwatch.llm.words import blocks, to_bytes

LEAST, TIMES = 6, 4


def split(word: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the segments that no rare word splits further; text i has the words ``first[i]:first[i + 1]``."""
    at, segment = np.arange(len(word)), np.repeat(np.arange(len(first) - 1), np.diff(first))
    room, starts, ends = int(word.max(initial=0)) + 1, [], []
    while len(at):
        _, place, count = np.unique(segment * room + word[at], return_inverse=True, return_counts=True)
        often = count[place] >= times
        open_ = np.bincount(segment, weights=~often)[segment] > 0
        done = np.flatnonzero(~open_)
        if len(done):
            edge = np.diff(segment[done], prepend=-1, append=-1) != 0
            starts.append(at[done[edge[:-1]]])
            ends.append(at[done[edge[1:]]] + 1)
        left = open_ & often
        at, segment = at[left], segment[left]
        segment = np.cumsum((np.diff(at, prepend=-2) > 1) | (np.diff(segment, prepend=-1) != 0)) - 1
        long = np.bincount(segment)[segment] >= max(least, times) if len(at) else np.zeros(0, bool)
        at, segment = at[long], segment[long]
    return np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *ends])


def _first_unequal(x: np.ndarray, at: int, lag: int) -> int:
    size = 64
    while True:
        unequal = x[at : at + size] != x[at + lag : at + lag + size] if at + lag + size <= len(x) else x[at : len(x) - lag] != x[at + lag :]
        found = int(unequal.argmax())
        if unequal[found]:
            return at + found
        at, size = at + size, 2 * size


def _last_unequal(x: np.ndarray, at: int, lag: int) -> int | None:
    """The last place before ``at``, -1 at the beginning; None if it is not among the ``lag`` places before."""
    size, least = 64, max(0, at - lag)
    while at > least:
        low = max(least, at - size)
        unequal = x[low:at] != x[low + lag : at + lag]
        if unequal.any():
            return at - 1 - int(unequal[::-1].argmax())
        at, size = low, 2 * size
    return None if least else -1


def scan(word: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Runs inside the segments as rows (start, length, period), by start, then period."""
    order = np.argsort(starts - ends, kind="stable")  # long segments first: a lag reads only those with room for it
    starts, sizes = starts[order], (ends - starts)[order]
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    x = np.empty(begins[-1], np.int64)
    x[begins[1:] - 1] = -1 - np.arange(len(sizes))  # a mark that equals nothing ends each segment
    inner = np.arange(len(x)) - np.repeat(begins[:-1], sizes + 1)
    real = inner < np.repeat(sizes, sizes + 1)
    x[real] = word[(np.repeat(starts, sizes + 1) + inner)[real]]
    reach, found = np.zeros(len(x), np.int64), []
    for lag in range(1, int(sizes[0]) // times + 1):
        room = int(np.searchsorted(-sizes, -max(least, times * lag), side="right"))
        if not room:
            break
        part = x[: begins[room]]
        equal = part[:-lag:lag] == part[lag::lag]
        several = equal[: len(equal) - times + 2]
        for i in range(1, times - 1):
            several = several & equal[i : len(several) + i]
        at = np.flatnonzero(several) * lag
        # within a run of a smaller period, lag would not be the smallest: both hold over two lags, so their divisor does
        at = at[reach[at] < at + 2 * lag]
        step = 1
        while len(at) > 8 and step <= (times - 2) * lag:
            at, step = at[part[at + step] == part[at + lag + step]], step + 1 + step // 8
        i = 0
        while i < len(at):
            end = _first_unequal(part, int(at[i]), lag)
            before = _last_unequal(part, int(at[i]), lag)  # a run has a multiple of lag among its first lag words
            start = end if before is None else before + 1
            if end + lag - start >= max(least, times * lag) and reach[start] < start + 2 * lag:
                found.append((start, end + lag - start, lag))
                np.maximum(reach[start : end + lag], end + lag, out=reach[start : end + lag])
            i = int(np.searchsorted(at, end))
    runs = np.array(found, np.int64).reshape(-1, 3)
    of = np.searchsorted(begins, runs[:, 0], side="right") - 1
    runs[:, 0] += starts[of] - begins[of]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each text, given as its words, the runs as rows (start, length, period)."""
    first, numbers, base = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))), [], 0
    for words in texts:
        number = {w: i for i, w in enumerate(dict.fromkeys(words), base)}
        numbers.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        base += len(number)
    word = np.concatenate([np.zeros(0, np.int64), *numbers])
    runs = scan(word, *split(word, first, least, times), least, times)
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1
    runs[:, 0] -= first[owner]
    return np.split(runs, np.searchsorted(owner, np.arange(1, len(texts))))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that any run contains after its first period."""
    if len(runs):
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row of docs: doc_id, runs (array of start, length, period, by start, then period), collapsed (the text
    without the repetitions, words joined by one space).

    Words are runs of other bytes than ASCII white space and compared byte by byte. Null and empty texts have no runs and
    collapse to the empty text; a text of any length is treated whole. Rows that repeat an id, and null ids, each give their
    row. Other columns, whatever they are called, are not read. ``times`` is at least 3.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found by this scan")

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = to_bytes(part["text"])
            for a, b in blocks(texts):
                words = [t.split() for t in texts[a:b]]
                runs = runs_of(words, least, times)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].iloc[a:b].to_numpy(),
                    "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r.tolist()] for r in runs],
                    "collapsed": [collapsed(w, r) for w, r in zip(words, runs)],
                })

    rows = docs.select(packed_id(docs, key), docs[text].cast("binary").alias("text"))
    out = rows.mapInPandas(find, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return unpacked(out).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, where one document in ten (by the crc32 of its id) ends in a repeated stretch.

    With h the crc32 and g = h / 10, the words from g % n on repeat the first 1 + (n - a) / (3 + g % 8) of them. Documents with
    a null id or without words stay as they are.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    hashed = F.crc32(F.col("doc_id").cast("string"))
    words: Column = F.array_remove(F.split(F.col("text"), f"[{SPACES}]+"), "")
    n, g = F.size(words), F.floor(hashed / 10)
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int")))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), start), F.slice(tail, F.lit(1), n - start)), " ")
    return rows.withColumn("text", F.when((hashed % 10 == 0) & (n > 0), repeated).otherwise(F.col("text")))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document of ``with_repeats``: n_runs, the longest run, and hashes of all runs and of the collapsed text."""
    found = periodic_runs(with_repeats(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), longest.alias("_run"),
    ).select(
        "doc_id", "n_runs", (-F.col("_run.start")).alias("start"), F.col("_run.length"), (-F.col("_run.period")).alias("period"),
        F.floor(1000 * F.col("_run.length") / -F.col("_run.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

"""Removing byte strings that an earlier document has, by a distributed merge sort of suffixes.

Every 50-byte string contains the window's anchor: the position whose 24 bytes hash lowest among those in the string. Equal
strings have equal anchors, so only suffixes at anchors are sorted. In three exchanges between senders (slices of the
documents, text shuffled once) and owners:

1. Senders send the hashes at their anchors, sorted and Golomb-coded; owners answer with bitmaps of those that others have.
2. At anchors that occur elsewhere, senders sort the suffixes (50 bytes from the anchor, then the bytes before it backwards),
   keep equal ones once with their smallest document, and send each owner its range as a front-coded run. Owners merge
   the runs with a loser tree that knows every head's common prefix with the last output and compares from there on. The
   merged common prefixes bound the suffixes that share the right part of a string; within, the left parts are compared.
   The answer has a bit per suffix and string: whether some document smaller than the sender's smallest has it.
3. Senders mark the strings, remove the bytes they cover and hash what is left.

A passage in very many documents would reach an owner once per sender and different surrounding. Suffixes whose first bytes are
that frequent (by a sample) are not merged: senders send 128-bit hashes of their strings instead, each once with its smallest
document, to owners that are dealt by hash, and get a bit for each. So a string reaches an owner once per sender at most.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from millwatch.llm import golomb
from millwatch.llm.tables import NO_ID, packed_id, pieces, unpacked
from millwatch.llm.words import joined, mix, prefix_hashes, slices, to_bytes

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1  # anchors' places in a string
KEY = 80  # right part, left part backwards, their lengths; whole 8-byte words
BITS = 48
SENDER_BYTES = 8 << 20
OWNER_BYTES = 16 << 20
CHUNK = 1 << 20
SAMPLE_DOCS = 2000
#: First bytes are frequent if they occur so often in the sample, and in so large a share of an owner's part of its anchors.
FREQUENT = (8, 0.25)
_LAST = np.iinfo(np.int64).max


class Slice(NamedTuple):
    """A sender's documents: all bytes, one space between texts; bounds and id of each (a null id is larger than all)."""

    data: np.ndarray
    starts: np.ndarray
    ids: np.ndarray


def load(pdf: pd.DataFrame) -> Slice:
    texts = to_bytes(pdf["text"])
    data, starts = joined(texts)
    ids = pdf["doc_id"].to_numpy(np.int64)
    return Slice(data, starts, np.where(ids == NO_ID, _LAST, ids))


def _window(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values."""
    size, out = 1, values
    while size * 2 <= width:
        out, size = pick(out[:-size], out[size:]), size * 2
    return pick(out[: len(values) - width + 1], out[width - size : width - size + len(values) - width + 1]) if size < width else out


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of all strings that lie in one text; data is taken in overlapping chunks."""
    places, hashes = [], []
    for low in range(0, len(data), CHUNK):
        high = min(len(data), low + CHUNK + LENGTH - 1)
        n = high - low - LENGTH + 1  # strings that start in the chunk
        if n <= 0:
            continue
        sums, inverse = prefix_hashes(data[low:high])
        at = np.arange(n + SPAN - 1)
        value = slices(sums, inverse, at, at + GRAM) | np.uint64(1)
        least = _window(value, SPAN, np.minimum)
        end = starts[1:] - 1  # of each text; strings that reach beyond theirs do not count
        first, last = np.searchsorted(end, low, "right"), np.searchsorted(starts, low + n)
        for e in end[first:last]:
            least[max(0, e - LENGTH + 1 - low) : max(0, e + 1 - low)] = 0
        none = np.zeros(SPAN - 1, np.uint64)
        most = _window(np.concatenate((none, least, none)), SPAN, np.maximum)
        found = np.flatnonzero(most == value)
        places.append(found + low)
        hashes.append(value[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, keep = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[keep] >> np.uint64(64 - BITS)


def contexts(own: Slice, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, document, inverse): the different suffixes in order, each one's smallest id, and every anchor's number."""
    text = np.searchsorted(own.starts, place, "right") - 1
    left = np.minimum(place - own.starts[text], SPAN - 1)
    right = np.minimum(own.starts[text + 1] - 1 - place, LENGTH)
    keys = np.zeros((len(place), KEY), np.uint8)
    for i in range(LENGTH):
        keys[:, i] = np.where(i < right, own.data[np.minimum(place + i, len(own.data) - 1)], 0)
    for i in range(SPAN - 1):
        keys[:, LENGTH + i] = np.where(i < left, own.data[np.maximum(place - 1 - i, 0)], 0)
    keys[:, KEY - 2], keys[:, KEY - 1] = right, left
    columns = keys.view(">u8")
    order = np.lexsort(columns.T[::-1])
    ordered = columns[order]
    new = np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(axis=1))) if len(order) else np.zeros(0, bool)
    cut = np.flatnonzero(new)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    document = np.minimum.reduceat(own.ids[text][order], cut) if len(cut) else np.zeros(0, np.int64)
    return keys[order[cut]], document, inverse


def front_code(keys: np.ndarray) -> tuple[bytes, bytes]:
    """(common prefix with the key before, remaining bytes) of sorted keys; the first one's prefix is 0."""
    differ = keys[1:] != keys[:-1]
    common = np.concatenate((np.zeros(min(1, len(keys)), np.int64), np.where(differ.any(axis=1), differ.argmax(axis=1), KEY)))
    rest = keys[np.arange(KEY)[None, :] >= common[:, None]]
    return common.astype(np.uint8).tobytes(), rest.tobytes()


def front_decode(common: bytes, rest: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, common prefixes) of a front-coded run: each column is filled from the last key that had it."""
    prefix = np.frombuffer(common, np.uint8).astype(np.int64)
    given = np.arange(KEY)[None, :] >= prefix[:, None]
    keys = np.zeros((len(prefix), KEY), np.uint8)
    keys[given] = np.frombuffer(rest, np.uint8)
    source = np.maximum.accumulate(np.where(given, np.arange(len(prefix))[:, None], 0), axis=0)
    return np.take_along_axis(keys, source, axis=0), prefix


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place, common prefix with the output before) in the order of all keys of sorted runs (keys, common prefixes).

    A loser tree whose entries carry the common prefix with the last output. The longer one is the smaller key, without
    looking at the bytes; only between equal ones bytes are compared, from there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads = [[row.tobytes() for row in keys] for keys, _ in runs] + [[]] * (width - len(runs))
    prefixes = [common.tolist() for _, common in runs] + [[]] * (width - len(runs))
    at, sizes = [0] * width, [len(h) for h in heads]
    known = [0 if n else -1 for n in sizes]  # -1: nothing left, larger than all
    tree = [-1] * width

    def smaller(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two heads with the same known prefix; the loser's becomes their common prefix."""
        k = known[a]
        if k < 0:
            return a, b
        x, y = heads[a][at[a]][k:], heads[b][at[b]][k:]
        if x == y:
            known[max(a, b)] = KEY
            return min(a, b), max(a, b)
        p, q = int.from_bytes(x, "big"), int.from_bytes(y, "big")
        common = KEY - (((p ^ q).bit_length() + 7) >> 3)
        if p < q:
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    def climb(run: int) -> int:
        node = (run + width) >> 1
        while node:
            other = tree[node]
            if other < 0:
                tree[node] = run
                return -1
            if known[run] < known[other]:
                tree[node], run = run, other
            elif known[run] == known[other]:
                run, tree[node] = smaller(run, other)
            node >>= 1
        return run

    winner = -1
    for run in range(width):
        winner = climb(run)
    if width == 1:
        winner = 0
    total = sum(sizes)
    runs_out, place_out, common_out = [0] * total, [0] * total, [0] * total
    for i in range(total):
        runs_out[i], place_out[i], common_out[i] = winner, at[winner], known[winner]
        at[winner] += 1
        known[winner] = prefixes[winner][at[winner]] if at[winner] < sizes[winner] else -1
        winner = climb(winner) if width > 1 else winner
    return np.array(runs_out, np.int64), np.array(place_out, np.int64), np.array(common_out, np.int64)


def earlier(keys: np.ndarray, common: np.ndarray, document: np.ndarray) -> np.ndarray:
    """A mask per sorted suffix: bit o is set if the string that starts o bytes before the anchor is in a smaller document."""
    n = len(keys)
    mask, left = np.zeros(n, np.uint32), np.zeros(n, np.uint64)
    for o in range(SPAN):
        if o:
            left = (left + keys[:, LENGTH + o - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            left ^= left >> np.uint64(29)
        block = np.cumsum(common < LENGTH - o).astype(np.uint64)
        valid = np.flatnonzero((keys[:, KEY - 2] >= LENGTH - o) & (keys[:, KEY - 1] >= o))
        if not len(valid):
            continue
        order = valid[np.lexsort((left[valid], block[valid]))]
        cut = np.flatnonzero(np.concatenate(([True], (block[order][1:] != block[order][:-1]) | (left[order][1:] != left[order][:-1]))))
        least = np.repeat(np.minimum.reduceat(document[order], cut), np.diff(np.append(cut, len(order))))
        mask[order[least < document[order]]] |= np.uint32(1 << o)
    return mask


def _lists(owner_bits: int):
    shift = np.uint64(BITS - owner_bits)

    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = load(pdf)
        values = np.unique(anchors(own.data, own.starts)[1])
        owner = values >> shift
        cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(values) else []
        rows = [(key[0], int(owner[a]), b - a, *golomb.encode(values[a:b] - (owner[a] << shift))) for a, b in zip(cut, [*cut[1:], len(values)])]
        return pd.DataFrame(rows, columns=["sender", "owner", "n", "low", "unary", "rest"])

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = [golomb.decode(*x) for x in zip(pdf["n"], pdf["low"], pdf["unary"], pdf["rest"])]
    values, count = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[count > 1]
    bits = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"sender": pdf["sender"], "kind": -1, "owner": pdf["owner"], "n": pdf["n"], "bits": bits})


def _candidates(own: Slice, replies: pd.DataFrame) -> np.ndarray:
    """Places of the anchors whose hash another sender or another place here has."""
    place, value = anchors(own.data, own.starts)
    replies = replies.sort_values("owner")
    if not len(place):
        return place
    _, number, count = np.unique(value, return_inverse=True, return_counts=True)
    flags = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(replies["bits"], replies["n"])]).astype(bool)
    return place[(flags | (count > 1))[number]]


def _owners(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The range of each key by its first bytes."""
    return np.searchsorted(splitters, np.ascontiguousarray(keys[:, :GRAM]).view(f"S{GRAM}")[:, 0], "right")


def _frequent(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each key starts with one of the frequent first bytes."""
    if not len(hot) or not len(keys):
        return np.zeros(len(keys), bool)
    first = np.ascontiguousarray(keys[:, :GRAM]).view(f"S{GRAM}")[:, 0]
    return hot[np.minimum(np.searchsorted(hot, first), len(hot) - 1)] == first


def strings(keys: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, smallest document of each) of the different strings of some suffixes, and of every string its suffix, start and number."""
    names, rows, starts = [], [], []
    for o in range(SPAN):
        valid = np.flatnonzero((keys[:, KEY - 2] >= LENGTH - o) & (keys[:, KEY - 1] >= o))
        part = np.zeros((len(valid), -(-LENGTH // 8) * 8), np.uint8)
        part[:, :o] = keys[valid, LENGTH : LENGTH + o][:, ::-1]
        part[:, o:LENGTH] = keys[valid, : LENGTH - o]
        name = np.zeros((len(valid), 2), np.uint64)
        for i, seed in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
            value = mix(np.full(len(valid), seed + o, np.uint64))  # scrambled, else a start and a first byte can cancel out
            for column in part.view(np.uint64).T:
                value = mix((value ^ column) + np.uint64(seed))
            name[:, i] = value
        names.append(name)
        rows.append(valid)
        starts.append(np.full(len(valid), o))
    name, row, start = np.concatenate(names), np.concatenate(rows), np.concatenate(starts)
    order = np.lexsort((name[:, 1], name[:, 0]))
    ordered = name[order]
    new = np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(axis=1)))[: len(order)]
    cut = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(document[row][order], cut) if len(cut) else np.zeros(0, np.int64)
    return ordered[cut], least, row, start, number


def _dealt(names: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each string; names ascend, and so do owners."""
    return (((names[:, 0] >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)).astype(np.int64)


def string_masks(keys: np.ndarray, document: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """As ``earlier``, from the owners' bits: whether some document has the string that is smaller than the smallest here."""
    _, least, row, start, number = strings(keys, document)
    mask = np.zeros(len(keys), np.uint32)
    found = bits[number] | (least[number] < document[row])
    np.bitwise_or.at(mask, row[found], np.uint32(1) << start[found].astype(np.uint32))
    return mask


def _runs(splitters: np.ndarray, hot: np.ndarray, string_owners: int):
    def send(pdf: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pdf):
            own = load(pdf)
            keys, document, _ = contexts(own, _candidates(own, replies))
            sender, frequent = int(pdf["sender"].iloc[0]), _frequent(keys, hot)
            if frequent.any():
                names, least, *_ = strings(keys[frequent], document[frequent])
                bounds = np.searchsorted(_dealt(names, string_owners), np.arange(string_owners + 1))
                for owner, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    if a < b:
                        rows.append((sender, -1 - owner, names[a:b, 0].tobytes(), names[a:b, 1].tobytes(), least[a:b].tobytes()))
                keys, document = keys[~frequent], document[~frequent]
            bounds = np.searchsorted(_owners(keys, splitters), np.arange(len(splitters) + 2))
            for owner, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if a < b:
                    rows.append((sender, owner, *front_code(keys[a:b]), document[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["sender", "owner", "common", "rest", "document"])

    return send


def _compared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's reply on strings: a bit for each that some smaller document has."""
    name = np.stack([np.frombuffer(b"".join(pdf[c]), np.uint64) for c in ("common", "rest")], axis=1)
    document, sizes = np.frombuffer(b"".join(pdf["document"]), np.int64), np.array([len(d) // 8 for d in pdf["document"]])
    order = np.lexsort((name[:, 1], name[:, 0]))
    cut = np.flatnonzero(np.concatenate(([True], (name[order][1:] != name[order][:-1]).any(axis=1))))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(document[order], cut), np.diff(np.append(cut, len(order))))
    bits = [np.packbits(x).tobytes() for x in np.split(least < document, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"sender": pdf["sender"], "kind": 2, "owner": -1 - key[0], "n": sizes, "bits": bits})


def _merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    if key[0] < 0:
        return _compared(key, pdf)
    runs = [front_decode(c, r) for c, r in zip(pdf["common"], pdf["rest"])]
    documents = [np.frombuffer(d, np.int64) for d in pdf["document"]]
    run, place, common = merge_runs(runs)
    first = np.cumsum([0, *(len(d) for d in documents)])
    order = first[run] + place
    mask = np.empty(len(order), np.uint32)
    mask[order] = earlier(np.concatenate([k for k, _ in runs])[order], common, np.concatenate(documents)[order])
    bits = [mask[a:b].tobytes() for a, b in zip(first, first[1:])]
    return pd.DataFrame({"sender": pdf["sender"], "kind": 1, "owner": key[0], "n": np.diff(first), "bits": bits})


def removed_runs(own: Slice, place: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of bytes that lie in a string that a smaller document has."""
    _, document, inverse = contexts(own, place)
    text = np.searchsorted(own.starts, place, "right") - 1
    left = np.minimum(place - own.starts[text], SPAN - 1)
    right = np.minimum(own.starts[text + 1] - 1 - place, LENGTH)
    later = own.ids[text] > document[inverse]  # the smallest document of this suffix is in this slice
    mask, found = masks[inverse], np.zeros(len(own.data), bool)
    for o in range(SPAN):
        fits = (o <= left) & (LENGTH - o <= right) & (later | ((mask >> np.uint32(o)) & np.uint32(1)).astype(bool))
        found[place[fits] - o] = True
    start = np.flatnonzero(found)
    new = np.flatnonzero(np.diff(start, prepend=-LENGTH - 1) > LENGTH)  # between texts lies a byte, so no run goes on there
    return start[new], start[np.append(new[1:], len(start)) - 1] + LENGTH if len(start) else start


def _masks(own: Slice, place: np.ndarray, replies: pd.DataFrame, hot: np.ndarray) -> np.ndarray:
    """The owners' masks of all different suffixes here."""
    merged, compared = (replies[replies["kind"] == k].sort_values("owner") for k in (1, 2))
    masks = np.frombuffer(b"".join(merged["bits"]), np.uint32)
    if not len(compared):
        return masks
    keys, document, _ = contexts(own, place)
    frequent, out = _frequent(keys, hot), np.empty(len(keys), np.uint32)
    bits = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(compared["bits"], compared["n"])]).astype(bool)
    out[~frequent], out[frequent] = masks, string_masks(keys[frequent], document[frequent], bits)
    return out


def _kept(pdf: pd.DataFrame, replies: pd.DataFrame, whole: bool, hot: np.ndarray) -> pd.DataFrame:
    if not len(pdf):
        return pd.DataFrame(columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    own = load(pdf)
    place = _candidates(own, replies[replies["kind"] == -1])
    start = end = np.zeros(0, np.int64)
    if len(place):
        start, end = removed_runs(own, place, _masks(own, place, replies, hot))
    n, size = len(pdf), np.diff(own.starts) - 1
    text = np.searchsorted(own.starts, start, "right") - 1
    first = np.searchsorted(text, np.arange(n + 1))
    kept = []
    for i, (at, to) in enumerate(zip(own.starts, own.starts[1:] - 1)):
        parts = []
        for a, b in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]]):
            parts.append(own.data[at:a].tobytes())
            at = b
        rest = b"".join([*parts, own.data[at:to].tobytes()])
        kept.append(rest if whole else hashlib.sha256(rest).hexdigest())
    return pd.DataFrame({
        "doc_id": pdf["doc_id"].to_numpy(), "n_bytes": size, "n_removed": np.bincount(text, end - start, n).astype(np.int64),
        "n_spans": np.diff(first), "kept": kept,
    })


def _splitters(docs: DataFrame, owners: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the owners' ranges and frequent first bytes, from the anchors of about SAMPLE_DOCS documents; they decide where work is done only."""
    part = int(min(1, SAMPLE_DOCS / max(1, rows)) * (1 << 30)) + 1

    def prefixes(batches):
        for pdf in batches:
            own = load(pdf)
            place, value = anchors(own.data, own.starts)
            _, at, n = np.unique(value, return_index=True, return_counts=True)
            yield pd.DataFrame({"value": value[at].view(np.int64), "prefix": [own.data[p : p + GRAM].tobytes() for p in place[at]], "n": n})

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part)
    counted = some.mapInPandas(prefixes, "value long, prefix binary, n long").groupBy("value", "prefix").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    least, share = FREQUENT
    counted = counted.withColumn("hot", (F.col("n") >= least) & (F.col("n") >= total * share / owners))
    picked = counted.filter("hot OR value % 16 = 0").collect()
    found = sorted(bytes(r["prefix"]) for r in picked if not r["hot"] and r["value"] % 16 == 0 for _ in range(r["n"]))
    hot = np.array(sorted(bytes(r["prefix"]) for r in picked if r["hot"]), f"S{GRAM}")
    cuts = sorted({bytes(found[len(found) * i // owners]) for i in range(1, owners)}) if found else []
    return np.array(cuts, f"S{GRAM}"), hot


def remove_repeats(docs: DataFrame, whole: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, and kept_sha256 (or, with ``whole``, kept: the bytes).

    Removed is each byte covered by a 50-byte string that also starts in a document with a smaller id; strings are judged on
    the input. Null and empty texts, and texts under 50 bytes, lose nothing. A null id counts as larger than all; rows that
    share an id take nothing from each other.
    """
    body = F.coalesce(docs[text], F.lit("")).cast("binary")
    plain = docs.select(packed_id(docs, key), body.alias("text"))
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    senders, owners = pieces(total["b"], SENDER_BYTES, 12), pieces(total["b"], OWNER_BYTES, 12)
    splitters, hot = _splitters(plain, owners, total["n"])
    sent = plain.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(senders)).cast("int").alias("sender"), "doc_id", "text")
    lists = sent.groupBy("sender").applyInPandas(_lists((owners - 1).bit_length()), "sender int, owner int, n long, low int, unary binary, rest binary")
    reply = "sender int, kind int, owner int, n long, bits binary"
    bitmaps = lists.groupBy("owner").applyInPandas(_answer, reply)
    runs = sent.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(_runs(splitters, hot, owners), "sender int, owner int, common binary, rest binary, document binary")
    masks = runs.groupBy("owner").applyInPandas(_merged, reply)
    replies = bitmaps.unionByName(masks)
    kind = "binary" if whole else "string"

    def keep(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _kept(pdf, answers, whole, hot)

    out = sent.groupBy("sender").cogroup(replies.groupBy("sender")).applyInPandas(keep, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}")
    return unpacked(out if whole else out.withColumnRenamed("kept", "kept_sha256"))

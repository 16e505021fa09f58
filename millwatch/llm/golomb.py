"""Golomb-Rice coding of sorted 64-bit fingerprints, in whole arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd

LISTS = "sender int, owner int, n long, low int, unary binary, rest binary"
BITMAPS = "sender int, owner int, n long, bits binary"


def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(parameter, unary quotients, remainders) of sorted unsigned values; repeated values give a zero gap."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = float(values[-1]) / max(1, len(values))
    low = min(63, max(0, int(np.log2(mean)) if mean >= 2 else 0))
    while int((gaps >> np.uint64(low)).max(initial=0)) > 64 * len(gaps) + 1024 and low < 63:
        low += 1
    quotient = (gaps >> np.uint64(low)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    bits = np.zeros(int(ends[-1]) + 1, np.uint8)
    bits[ends] = 1
    rest = gaps & ((np.uint64(1) << np.uint64(low)) - np.uint64(1))
    planes = rest.astype(">u8").view(np.uint8).reshape(-1, 8)
    whole, part = divmod(low, 8)
    columns = planes[:, 8 - whole :].tobytes()
    top = planes[:, 7 - whole] if part else np.zeros(0, np.uint8)
    if part:
        top = np.packbits(np.unpackbits(top[:, None], axis=1)[:, 8 - part :].ravel())
    return low, np.packbits(bits).tobytes(), top.tobytes() + columns


def decode(n: int, low: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    whole, part = divmod(low, 8)
    planes = np.zeros((n, 8), np.uint8)
    size = -(-n * part // 8)
    if part:
        bits = np.unpackbits(np.frombuffer(rest[:size], np.uint8))[: n * part].reshape(n, part)
        planes[:, 7 - whole] = np.packbits(np.hstack([np.zeros((n, 8 - part), np.uint8), bits]), axis=1)[:, 0]
    if whole:
        planes[:, 8 - whole :] = np.frombuffer(rest[size:], np.uint8).reshape(n, whole)
    remainder = planes.view(">u8")[:, 0].astype(np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(low)) | remainder, dtype=np.uint64)


def lists(sender: int, values: np.ndarray, bits: int, owner_bits: int) -> pd.DataFrame:
    """A sender's distinct sorted values of so many bits, one coded list per owner (the top bits)."""
    shift = np.uint64(bits - owner_bits)
    owner = values >> shift
    cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(values) else []
    rows = [(sender, int(owner[a]), b - a, *encode(values[a:b] - (owner[a] << shift))) for a, b in zip(cut, [*cut[1:], len(values)])]
    return pd.DataFrame(rows, columns=["sender", "owner", "n", "low", "unary", "rest"])


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's reply to each list: a bitmap of the values that another list has too. All lists are sorted together, once."""
    found = [decode(*x) for x in zip(pdf["n"], pdf["low"], pdf["unary"], pdf["rest"])]
    ends = np.cumsum([len(x) for x in found])
    values = np.concatenate([np.zeros(0, np.uint64), *found])
    del found
    order = np.argsort(values, kind="stable")
    values = values[order]
    same = np.concatenate(([False], values[1:] == values[:-1], [False]))
    shared = np.zeros(len(order), bool)
    shared[order] = (same[1:] | same[:-1])[: len(order)]
    bits = [np.packbits(x).tobytes() for x in np.split(shared, ends[:-1])] if len(ends) else []
    return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "n": pdf["n"], "bits": bits})


def flags(bitmaps: pd.DataFrame) -> np.ndarray:
    """A sender's replies, owner by owner, as one flag per distinct sorted value."""
    parts = bitmaps.sort_values("owner")
    return np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(parts["bits"], parts["n"]))]).astype(bool)

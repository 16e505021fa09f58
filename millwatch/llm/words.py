"""Whole texts as numpy arrays: word bounds, word hashes and hashed runs of words, many texts at a time."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.ones(n, np.uint64)
        size, step = 1, b
        while size < n:
            m = min(size, n - size)
            p[size : size + m] = p[:m] * np.uint64(step)
            size, step = size + m, step * step % (1 << 64)
        out.append(p)
    return out[0], out[1]


_CACHE: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _CACHE.get("p")
    if have is None or len(have[0]) < n:
        have = _CACHE["p"] = _powers(max(1 << 16, 1 << (n - 1).bit_length()))
    return have[0][:n], have[1][:n]


def forget() -> None:
    """Free the powers that are kept: 64 MB after a block of 2 MB."""
    _CACHE.clear()


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): a slice's hash is ``(sums[end] - sums[start]) * inverse[start]``."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=sums[1:])
    return sums, inverse


def slices(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _ODD)


class Words(NamedTuple):
    """Words of many texts: bounds in ``data``, and ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, one space between them; and where each starts (one more at the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def split(texts: list[bytes], lower: bool = True) -> Words:
    """Words of each text, A-Z lower-cased, with a 64-bit hash each."""
    data, starts = joined(texts)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums, inverse = prefix_hashes(data)
    return Words(data, start, end, np.searchsorted(start, starts), slices(sums, inverse, start, end))


def blocks(texts, size: int = 2 << 20):
    """(from, to) of consecutive texts that have about ``size`` bytes together; a longer text is alone."""
    at, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield at, i
            at, total = i, 0
        total += len(text)
    if at < len(texts):
        yield at, len(texts)


def to_bytes(values) -> list[bytes]:
    return [b"" if v is None else v.encode("utf-8") if isinstance(v, str) else bytes(v) for v in values]

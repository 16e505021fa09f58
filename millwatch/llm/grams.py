"""Hashed n-gram features of whole texts, and linear models trained on them."""

from __future__ import annotations

import numpy as np

from millwatch.llm.words import joined, mix

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[0x30:0x3A] = np.arange(0x30, 0x3A)
_CLEAN[0x61:0x7B] = _CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLEAN[0x80:] = np.arange(0x80, 0x100)


def letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array with A-Z lower-cased and all ASCII but letters and digits as spaces; and where each starts."""
    data, starts = joined(texts)
    return _CLEAN[data], starts


def grams(data: np.ndarray, n: int, inner_space: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the n-byte grams; without ``inner_space`` only those whose inner bytes are no space."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(size, np.uint64)
    for i in range(n):
        value = (value << np.uint64(8)) | data[i : i + size].astype(np.uint64)
    at = np.arange(size)
    if not inner_space:
        space = np.concatenate(([0], np.cumsum(data == 0x20)))
        keep = np.flatnonzero(space[n - 1 : n - 1 + size] == space[1 : 1 + size])
        at, value = keep, value[keep]
    return at, mix(value + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, l2: float, rounds: int, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Logistic models for the columns of y by full-batch Adam: (weights, biases)."""
    rows, k = y.shape
    prior = (y.sum(axis=0, dtype=np.float64) + 0.5) / (rows + 1)
    w, b = np.zeros((x.shape[1], k)), np.log(prior / (1 - prior))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, rounds + 1):
        error = (sigmoid(x @ w.astype(x.dtype) + b) - y) / rows
        for value, gradient, (m, v) in ((w, x.T @ error.astype(x.dtype) + l2 * w, state[:2]), (b, error.sum(axis=0), state[2:])):
            m *= 0.9
            m += 0.1 * gradient
            v *= 0.99
            v += 0.01 * gradient**2
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, b

"""Hashes of words, shingles and byte windows for whole batches of texts, in numpy (64 bits, wrapping)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, U)
_inverse = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 20)
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            globals()[name] = np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, base, U))])


def sums(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = sum of data[k] * BASE**k for i <= k < j."""
    _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _powers[: len(data)], out=out[1:])
    return out


def spans(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings data[start:end], from sums(data): equal strings have equal hashes wherever they stand."""
    return mix((s[end] - s[start]) * _inverse[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def distinct(x: np.ndarray) -> np.ndarray:
    """x sorted, each value once: np.unique has a hash table for this, which costs more than to sort."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x


def shingle_sets(texts: list[bytes], width: int = 5, bits: int = 64) -> list[np.ndarray]:
    """For each text, lower-cased, the sorted distinct hashes of its word n-grams; all words as one if it has fewer."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts_of = np.concatenate([[0], np.cumsum(sizes + 1)])
    solid = ~_SPACE[data]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = spans(sums(data), start, end) if len(start) else np.zeros(0, U)
    first = np.searchsorted(start, starts_of)
    factor = mix(np.arange(1, width + 1, dtype=U)) | U(1)
    n = len(words) - width + 1
    grams = np.zeros(max(n, 0), U)
    for j in range(width if n > 0 else 0):
        grams += words[j : j + n] * factor[j]
    grams = mix(grams) >> U(64 - bits)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(distinct(grams[a : b - width + 1]))
        elif b > a:
            whole = (words[a:b] * factor[: b - a]).sum(dtype=U, keepdims=True) + np.array([b - a], U) * U(0xA24BAED4963EE407)
            out.append(mix(whole) >> U(64 - bits))
        else:
            out.append(np.zeros(0, U))
    return out

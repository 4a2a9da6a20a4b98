"""Vectorised helpers for tasks: word hashes, shingle sets and sketches of a few MB of text at a time."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_GOLD = U(0x9E3779B97F4A7C15)
EMPTY = U(_MASK)
#: Words of more bytes are hashed by blake2b: sums of powers modulo 2**64 are the same for a long word over two letters and its complement, if made for it (the Thue-Morse word of 1,024 letters).
LONG = 32


def _times(n: int) -> np.uint64:
    return U(n * 0x9E3779B97F4A7C15 & _MASK)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * _GOLD)[_LOWER]
#: Odd multipliers of the places in a window.
PLACES = mix(np.arange(1, 65, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for later calls."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[k] = np.concatenate((np.ones(1, U), np.cumprod(np.full(max(n, 1 << 20) - 1, b, U))))
    return _powers


def offsets_and_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a large_string array without nulls: offsets from 0, and the UTF-8 bytes."""
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and each text's offsets into them."""
    off, data = offsets_and_bytes(texts)
    if not len(data):
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    ink = ~_SPACE[data]
    begins, ends = ink.copy(), ink.copy()
    begins[1:] &= ~ink[:-1]
    ends[:-1] &= ~ink[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    begins[heads] = ink[heads]
    tails = heads[heads > 0] - 1
    ends[tails] = ink[tails]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    found = (total[stops] - total[starts]) * inverse[starts]
    found = mix(found ^ ((stops - starts).astype(U) * _GOLD))
    # there is at most one for every LONG bytes of text
    for i in np.flatnonzero(stops - starts > LONG):
        found[i] = int.from_bytes(blake2b(_LOWER[data[starts[i] : stops[i]]].tobytes(), digest_size=8).digest(), "little")
    return found, np.searchsorted(starts, off)


def shingles(hashes: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes, flat, and their offsets. Fewer words than k are one shingle; no words, none."""
    n = len(hashes)
    padded = np.concatenate((hashes, np.zeros(k, U)))
    rolled = np.zeros(n, U)
    for j in range(k):
        rolled += padded[j : j + n] * PLACES[j]
    rolled = mix(rolled + _times(k))
    out, sizes = [], np.zeros(len(off), np.int64)
    for d in range(len(off) - 1):
        a, b = int(off[d]), int(off[d + 1])
        if b - a >= k:
            got = np.unique(rolled[a : b - k + 1])
        elif b > a:
            m = b - a
            got = mix((hashes[a:b] * PLACES[:m]).sum(dtype=U, keepdims=True) + _times(m))
        else:
            continue
        out.append(got)
        sizes[d + 1] = len(got)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.cumsum(sizes)


def fast_sketches(values: np.ndarray, off: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates for each set.

    In rounds 0 to t-1 each element falls into a random coordinate, in rounds t to 2t-1 all fall into coordinate round-t; a value holds the round above the hash, so earlier rounds win.
    A set stops after the round that fills its last coordinate, which rounds t to 2t-1 guarantee. Two sets agree at a coordinate with the probability of their Jaccard similarity. An empty set's row stays EMPTY.
    """
    n = len(off) - 1
    out = np.full(n * t, EMPTY, U)
    owner = np.repeat(np.arange(n), np.diff(off))
    for i in range(2 * t):
        if not len(values):
            break
        h = mix(values + _times(i + 1))
        place = ((h >> U(32)) % U(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + place, (U(i) << U(48)) | mix(h) >> U(16))
        live = np.unique(owner)
        full = np.zeros(n, bool)
        full[live] = (out.reshape(n, t)[live] != EMPTY).all(axis=1)
        keep = ~full[owner]
        values, owner = values[keep], owner[keep]
    return out.reshape(n, t)

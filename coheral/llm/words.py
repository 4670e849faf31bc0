"""Vectorised hashing of the words of many texts (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

from coheral.llm.common import mix64

# A-Z to a-z, the ASCII white space 09-0D to a blank; all other bytes stay.
_LOWER = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next call."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 18)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' words (runs without 09-0D and 20, A-Z lower-cased).

    Returns the bytes, word starts and ends in them, the words' 64-bit hashes, and how many words each text has.
    """
    enc = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((b" ".join(enc) + b" ").translate(_LOWER), np.uint8)
    blank = data == 32
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank))))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = mix64((total[ends] - total[starts]) * inverse[starts], 7)
    bounds = np.cumsum([0] + [len(e) + 1 for e in enc])
    counts = np.diff(np.searchsorted(starts, bounds))
    return data, starts, ends, h, counts


_MIX = [np.uint64(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
                                  0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3, 0xD6E8FEB86659FD93)]


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the word ``width``-grams of every text (1 to width-1 words: one shorter gram)."""
    _, _, _, h, counts = words(texts)
    n = len(h)
    grams = np.zeros(max(n, 1), np.uint64)
    for k in range(min(width, n)):
        grams[: n - k] += h[k:] * _MIX[k]
    grams = mix64(grams, 11)
    out, at = [], 0
    for c in counts:
        if c >= width:
            out.append(np.unique(grams[at: at + c - width + 1]))
        elif c:
            part = (h[at: at + c] * np.array(_MIX[:c], np.uint64)).sum(keepdims=True) + np.uint64(c)
            out.append(mix64(part, 13))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out

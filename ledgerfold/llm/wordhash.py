"""Hashes of the words of a text by array operations, the same wherever a word stands."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

#: Bytes that part words: ASCII white space; and all of ASCII but digits and letters.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_WORD = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64."""
    of = lambda x: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(PIECE, x, np.uint64))))
    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _piece(raw: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = _powers()
    edge = np.diff(gap.view(np.int8), prepend=1, append=1)
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    h = (sums[stop] - sums[start]) * down[start]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29)), start, stop


def hash_words(text: bytes, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, stop) of each word: sums of bytes by powers of their place.

    Long texts are taken in pieces that end between words; a word of over a
    piece is hashed by itself.
    """
    raw = np.frombuffer(text, np.uint8)
    gap = gaps[raw]
    if len(raw) <= PIECE:
        return _piece(raw, gap)
    out, at = [], 0
    while at < len(raw):
        inside = np.flatnonzero(gap[at : at + PIECE])
        stop = at + PIECE if at + PIECE < len(raw) and len(inside) else len(raw)
        stop = at + int(inside[-1]) + 1 if stop < len(raw) else stop
        if stop - at > PIECE:
            ends = np.flatnonzero(gap[at:])
            stop = at + int(ends[0]) if len(ends) else len(raw)
        if stop - at > PIECE:
            out.append((np.array([xxhash.xxh64_intdigest(text[at:stop], 5)], np.uint64), np.array([at]), np.array([stop])))
        else:
            h, a, b = _piece(raw[at:stop], gap[at:stop])
            out.append((h, a + at, b + at))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*out))

"""Hashed word shingles of many texts at once, with numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(buffer: np.ndarray) -> np.ndarray:
    """prefix[i]: the polynomial of the first i bytes, modulo 2^64."""
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(len(buffer))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes from start to end, equal for equal bytes; start below the buffer's length."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Shingles(NamedTuple):
    """text: the index of the text; hash; start and end: the place in buffer, the UTF-8 bytes of all texts."""

    text: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    buffer: bytes


def shingles(texts: list[str], words: int = 5, alnum: bool = False) -> Shingles:
    """All shingles of so many consecutive words, in order, repeated ones too.

    Words are the runs of lower-cased characters between ASCII white space, or with alnum the runs of ASCII
    letters, digits and all other characters beyond ASCII. A text of fewer words has one shingle of all its
    words; one without words has none.
    """
    raw = [t.lower().encode() for t in texts]
    buffer = b"\n".join([*raw, b""])
    data = np.frombuffer(buffer, np.uint8)
    inside = _ALNUM[data] if alnum else ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(x) + 1 for x in raw], dtype=np.int64)
    text = np.searchsorted(ends, start, "right")
    if not len(start):
        none = np.zeros(0, np.int64)
        return Shingles(none, np.zeros(0, np.uint64), none, none, buffer)
    word = spans(prefix(data), start, end)
    # the k-th word after each, but not beyond the text's last
    count = np.bincount(text, minlength=len(raw))
    last = np.cumsum(count)[text] - 1
    index = np.arange(len(word))
    first = np.cumsum(count)[text] - count[text]
    keep = (index + words - 1 <= last) | (index == first)
    at, last = index[keep], last[keep]
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        there = at + k <= last
        h = mix(h * np.uint64(0x100000001B3) + np.where(there, word[np.minimum(at + k, last)], np.uint64(0)))
    return Shingles(text[at], h, start[at], end[np.minimum(at + words - 1, last)], buffer)


def text_of(s: Shingles, i: int, alnum: bool = False) -> str:
    """The words of the i-th shingle, single spaces between them."""
    raw = s.buffer[s.start[i] : s.end[i]]
    if alnum:
        raw = bytes(c if _ALNUM[c] else 32 for c in raw)
    return b" ".join(raw.split()).decode()

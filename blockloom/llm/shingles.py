"""Distinct word n-grams of many texts at once, as 64-bit hashes.

A batch of texts is one byte array. Words are found from a table of white space, and each word's hash is a difference of
running sums of (byte's random number) * R**position, scaled back to position 0, so no word is ever cut out.
"""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed together; a longer text is taken on its own.
CHUNK = 1 << 19
_rng = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]  # A-Z count as a-z
_TABLE[_SPACE] = 0
_R = 0x9E3779B97F4A7C15
_R_BACK = pow(_R, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, _R_BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray, k: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[k]
    h = (h ^ (h >> np.uint64(27))) * _MIX[k + 1]
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a byte array that begins and ends with white space."""
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, back = _power(len(data))
    sums = np.cumsum(_TABLE[data] * up, dtype=np.uint64)
    return starts, mix((sums[ends - 1] - sums[starts - 1]) * back[starts])


def _chunk(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    offsets = np.cumsum([1] + [len(t) + 1 for t in texts])
    starts, h = words(data)
    doc = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    out_doc, out = [], []
    if len(h) >= n:
        whole = doc[: len(doc) - n + 1] == doc[n - 1 :]
        s = h[: len(h) - n + 1]
        for k in range(1, n):
            s = mix(s + _MIX[4]) ^ h[k : len(h) - n + 1 + k]
        out_doc.append(doc[: len(doc) - n + 1][whole])
        out.append(mix(s[whole], 1))
    ends = np.cumsum(count)
    for i in np.flatnonzero((count > 0) & (count < n)):  # fewer words: the whole sequence is one n-gram
        s = np.uint64(count[i])
        with np.errstate(over="ignore"):
            for x in h[ends[i] - count[i] : ends[i]]:
                s = mix(np.array([s + _MIX[3]], np.uint64))[0] ^ x
        out_doc.append(np.array([i]))
        out.append(mix(np.array([s], np.uint64), 2))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    d, s = np.concatenate(out_doc), np.concatenate(out)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return d[fresh], s[fresh]


def sets(texts: list[bytes], n: int = 4) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= CHUNK:
            size += len(texts[end])
            end += 1
        d, s = _chunk(texts[at:end], n)
        cuts = np.searchsorted(d, np.arange(1, end - at))
        out += np.split(s, cuts)
        at = end
    return out

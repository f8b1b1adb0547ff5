"""Words of a text as 64-bit hashes, cut and hashed by numpy over the UTF-8 bytes of the whole text."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
TABLE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: ASCII upper case to lower case
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers, _inverses = np.ones(size, np.uint64), np.ones(size, np.uint64)
        _powers[1:], _inverses[1:] = BASE, _INVERSE
        np.cumprod(_powers, out=_powers)
        np.cumprod(_inverses, out=_inverses)
    return _powers[:n], _inverses[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s with s[0] = 0 such that (s[b] - s[a]) * inverse[a] depends on data[a:b] only."""
    p, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * p[:-1], out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per span data[begin:end]."""
    sums = prefix_sums(data)
    _, inverse = powers(len(data) + 1)
    return mixed((sums[ends] - sums[begins]) * inverse[begins])


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of maximal runs without bytes 0x20 and 0x09 to 0x0D."""
    word = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def words(text: str, lower: bool = True) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text, A-Z in lower case."""
    data = np.frombuffer(text.encode(), np.uint8)
    if lower:
        data = LOWER[data]
    return span_hashes(data, *word_spans(data))

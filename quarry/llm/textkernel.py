"""Vectorised word and shingle hashing over batches of UTF-8 texts.

Everything works on one contiguous byte buffer per Arrow batch, so the cost a byte is a few
NumPy passes and memory is bounded by the batch, whatever a single text's length is.

Hashes are 64 bits wide.  A word's hash is a polynomial in its bytes, finished by a bijective
mixer; a shingle's hash combines its words' hashes by position and is mixed again.  Two different
shingles get one hash with probability about 2**-64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_MULT, -1, 1 << 64)
#: One random 64-bit value for each byte.
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, size=256, dtype=np.uint64) * U(2) + U(1)
#: One odd multiplier for each place in a shingle.
_PLACE = np.random.default_rng(977).integers(1, 2**63, size=64, dtype=np.uint64) * U(2) + U(1)
_POWERS: dict[str, np.ndarray] = {}

#: Lower-cases A-Z only; every other byte stays, so UTF-8 sequences are untouched.
LOWER = bytes(range(256)).lower()
#: The six ASCII characters \\x20 and \\x09-\\x0D; bytes.split() splits on just these.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[name] = have
    return have[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Hash of each span [start, end) of a sequence of 64-bit values; spans are in order and do not overlap.

    Blocks keep the powers short; a span longer than a block is hashed alone.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + block, side="right")))
        size = int(ends[j - 1] - base)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(values[base : base + size] * _power(_MULT, size, "up"), out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * _power(_INVERSE, size + 1, "down")[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


class Words:
    """The words of a batch: per word its hash and byte range, per text its range of words."""

    __slots__ = ("buffer", "ends", "first", "hashes", "offsets", "starts")

    def __init__(self, texts: list[bytes]) -> None:
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.buffer = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
        space = SPACE[self.buffer]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.hashes = self._hashes()
        self.first = np.searchsorted(self.starts, self.offsets)

    def _hashes(self) -> np.ndarray:
        return span_hashes(_BYTE[self.buffer], self.starts, self.ends)

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of size words that starts at a word, and whether it stays in its text."""
    n = len(words.hashes)
    out = np.zeros(n, dtype=np.uint64)
    inside = np.zeros(n, dtype=bool)
    if n >= size:
        m = n - size + 1
        total = words.hashes[:m] * _PLACE[0]
        for k in range(1, size):
            total = total + words.hashes[k : k + m] * _PLACE[k]
        out[:m] = mix(total)
        last = np.repeat(words.first[1:], words.per_text())[:m]
        inside[:m] = np.arange(size, n + 1) <= last
    return out, inside


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes; a text of fewer words has its whole sequence as one."""
    words = Words(texts)
    hashes, inside = windows(words, size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        n = b - a
        if n >= size:
            out.append(np.unique(hashes[a : b - size + 1]))
        elif n:
            whole = words.hashes[a:b] * _PLACE[: b - a]
            out.append(mix(np.array([whole.sum(dtype=np.uint64) + U(int(n))], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out

"""Vectorised Rabin-Karp hashing of bytes, words and windows (numpy, used inside Spark tasks).

All arithmetic is modulo 2**64 with odd bases, so a window's hash is one difference of a prefix sum
times an inverse power. Every result is mixed by a bijection before use. Words, whose letters anyone may choose, aren't hashed by powers (long
texts with equal hashes are known for every base) but by a sum of one mixed number for each letter, its place in the word and a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
BYTE_BASE, WORD_BASE, PLACE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Bytes of text hashed at once; bounds the working memory of a task (about 60 bytes a byte).
CHUNK = 1 << 20
#: \x20 and \x09-\x0D, the white space of the word contracts.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit bijection (the finaliser of splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and their inverses modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        rows = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U)
            steps[0] = 1
            rows.append(np.multiply.accumulate(steps))
        have = _POWERS[base] = (rows[0], rows[1])
    return have


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """s[i] = sum of values[j] * base**j for j < i."""
    up, _ = powers(base, len(values))
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The mixed hash of each span of the sequence behind sums; the length takes part."""
    _, down = powers(base, len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def fixed_hashes(sums: np.ndarray, width: int, base: int) -> np.ndarray:
    """The mixed hash of every window of width items, at its start."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, U)
    _, down = powers(base, len(sums))
    return mix((sums[width:] - sums[:n]) * down[:n])


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[buf]


def chunks(texts: Iterable[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about size bytes, with the index of the first; a longer text comes alone."""
    first, held, total = 0, [], 0
    for i, t in enumerate(texts):
        if held and total + len(t) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(t)
        total += len(t) + 1
    if held:
        yield first, held


class Words:
    """The words of a run of texts: spans in one buffer, the text of each, 64-bit hashes.

    separators: bytes that end a word. lower: A-Z count as a-z.
    """

    def __init__(self, texts: list[bytes], separators: bytes = SPACES, lower: bool = False) -> None:
        gap = separators[:1]
        joined = gap.join(texts) + gap
        if lower:
            joined = joined.lower()  # bytes.lower() changes A-Z alone
        self.buf = np.frombuffer(joined, np.uint8)
        table = np.zeros(256, bool)
        table[list(separators)] = True
        out = np.empty(len(self.buf) + 1, np.int8)
        out[0] = 1
        out[1:] = table[self.buf]
        step = np.diff(out)
        self.starts, self.ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(lengths)))
        #: words of text i: first[i] .. first[i + 1]
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.counts = np.diff(self.first)

    def hashes(self, key: int = 0) -> np.ndarray:
        """A sum over a word's letters, mixed. For a key that is known, words of equal sums can be made (a sum of many terms has many ways to come
        out even); for one drawn at random they can't."""
        place = np.arange(len(self.buf))
        begun = np.zeros(len(self.buf), np.int64)
        begun[self.starts] = self.starts
        place -= np.maximum.accumulate(begun)  # of each byte in its word
        sums = np.zeros(len(self.buf) + 1, U)
        np.cumsum(mix(_BYTE_CODES[self.buf] + place.astype(U) * U(PLACE) + U(key)), out=sums[1:])
        return mix(sums[self.ends] - sums[self.starts] + (self.ends - self.starts).astype(U) * U(0xA0761D6478BD642F))

    def windows(self, width: int, keys: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indexes of the words at which a window of width words of one text starts, and two hashes of each, independent for independent keys."""
        one = fixed_hashes(prefix_sums(self.hashes(keys[0]), WORD_BASE), width, WORD_BASE)
        at = np.flatnonzero(inside(self.first, width, len(one)))
        two = fixed_hashes(prefix_sums(self.hashes(keys[1]), BYTE_BASE), width, BYTE_BASE)
        return at, one[at], two[at]


def inside(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of n window starts: whether the window ends in the text in which it starts."""
    marks = np.zeros(max(n, 0) + 1, np.int32)
    lo, hi = first[:-1], np.maximum(first[:-1], first[1:] - width + 1)
    np.add.at(marks, np.minimum(lo, n), 1)
    np.add.at(marks, np.minimum(hi, n), -1)
    return np.cumsum(marks[:n]) > 0


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of n items: whether a span of width items from one of starts covers it."""
    marks = np.zeros(n + 1, np.int32)
    marks += np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int32)
    marks -= np.bincount(np.minimum(starts + width, n), minlength=n + 1)[: n + 1].astype(np.int32)
    return np.cumsum(marks[:n]) > 0


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The index of the least value of each run of width values, the rightmost on ties.

    Equal runs give equal offsets: the choice depends on the values alone. The index sits in the low bits
    of the key, so values are compared by their high 43 bits.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = U((1 << 21) - 1)
    if len(values) > 1 << 21:  # by pieces, so that an index fits in 21 bits
        piece = (1 << 21) - width
        return np.concatenate([sliding_argmin(values[i : i + piece + width - 1], width) + i for i in range(0, n, piece)])
    key = (values & ~low) | (low - np.arange(len(values), dtype=U))
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[: len(key) - step], key[step:])
        have += step
    return (low - (key[:n] & low)).astype(np.int64)

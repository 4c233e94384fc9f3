"""Vectorised hashing of words and byte windows, the same on every worker.

Everything works on one flat byte array, so no Python object is made for a
word. Arithmetic is modulo 2**64: a word or window hashes to the sum of
`TABLE[byte] * BASE**position`, followed by a 64-bit mixer.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE = 1 << 20


@lru_cache(None)
def byte_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(None)
def space_table() -> np.ndarray:
    """True for the bytes that end a word: space and \\x09 to \\x0D."""
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


@lru_cache(None)
def lower_table() -> np.ndarray:
    """A-Z to a-z, every other byte to itself."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1024)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= SLICE:  # workers live long: longer ones are made again
            _powers[int(base)] = have
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of TABLE[byte] * BASE**i, starting with 0."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_table()[data] * powers(BASE, len(data)), dtype=np.uint64, out=sums[1:])
    return sums


def run_bounds(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    inside = np.zeros(len(member) + 2, np.int8)
    inside[1:-1] = member
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans from the running sums; equal spans hash alike wherever they lie."""
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words of one text, in order.

    Long texts are cut at white space into slices, so that memory stays bounded
    unless a single word is huge.
    """
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        starts, ends = run_bounds(~space_table()[data])
        found.append(span_hashes(prefix_sums(lower_table()[data] if lower else data), starts, ends))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct sorted hashes of `size` successive words; fewer words make one shingle."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    span = min(size, n)
    total = np.full(n - span + 1, np.uint64(span), np.uint64)
    for i in range(span):
        total = mix(total * BASE + words[i : n - span + 1 + i])
    return np.unique(total)

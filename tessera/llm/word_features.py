"""Hashed features of words for the text classifiers, computed for many distinct words at once with numpy."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the word (the 64-bit one of MurmurHash3, a public constant pair)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int, base: int = int(BASE)) -> np.ndarray:
    out = np.full(n, np.uint64(base & MASK))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices [start, end) of an array of small numbers, equal for equal slices."""
    inverse = pow(int(BASE), -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)))])
    return mix((sums[ends] - sums[starts]) * powers(len(values) + 1, inverse)[starts] + (ends - starts).astype(np.uint64))


def subwords(words: list[str], buckets: int, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word and of its character n-grams, all in one array, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owners, found = [np.arange(len(words))], [range_hashes(chars, starts, ends)]
    owner = np.repeat(np.arange(len(words)), sizes)
    for n in lengths:
        at = np.flatnonzero(np.arange(len(chars)) + n <= ends[owner])
        owners.append(owner[at])
        found.append(range_hashes(chars, at, at + n) ^ np.uint64(n))
    owners_, hashes = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owners_, kind="stable")
    return (mix(hashes[order]) % np.uint64(buckets)).astype(np.int64), np.bincount(owners_, minlength=len(words))

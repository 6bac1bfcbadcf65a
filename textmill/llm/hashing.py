"""Vectorised hashes of words and of runs of words, for texts laid end to end as UTF-8 bytes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int, which: int) -> np.ndarray:
    """BASE (0) or its inverse (1) to the powers 0 to n - 1, modulo 2^64."""
    if len(_powers[which]) < n:
        grown = np.full(max(n, 1 << 16), INVERSE if which else BASE, np.uint64)
        grown[0] = 1
        _powers[which] = np.multiply.accumulate(grown)
    return _powers[which][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x + np.uint64((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Entry i is the polynomial of the first i bytes; stretch() turns two of them into a hash."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * powers(len(raw), 0), out=out[1:])
    return out


def stretch(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the bytes lo to hi (exclusive) that depends on nothing else."""
    return mixed((sums[hi] - sums[lo]) * powers(len(sums), 1)[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in the texts that start at ``at``, and each text's first word's index (one more at the end)."""
    solid = (raw != 0x20) & ((raw < 9) | (raw > 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    begin = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, at)


def lowered(raw: np.ndarray) -> np.ndarray:
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x5851F42D4C957F2D) + hashes[j : j + n]
    return mixed(out, k)


def shingles(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct k-word shingles, sorted; a text of fewer words has its whole sequence as one."""
    raw = lowered(raw)
    begin, end, first = words(raw, at)
    own = stretch(prefix_sums(raw), begin, end)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    h = windows(own, k)
    row = text[: len(h)]
    inside = row == text[k - 1 :] if len(h) else np.zeros(0, bool)
    rows, hashes = [row[inside]], [h[inside]]
    for j in range(1, k):  # whole texts of j words
        short = np.flatnonzero(count == j)
        if len(short):
            rows.append(short)
            hashes.append(mixed(windows(own, j)[first[short]], 1000 + j))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether each of n places lies in one of the stretches."""
    change = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
    return np.cumsum(change)[:n] > 0

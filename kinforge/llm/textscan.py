"""Vectorised scanning of many texts at once: words, rolling hashes, window anchors (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import lowered_ascii

LOWER = lowered_ascii()
#: [\x20\x09-\x0D]: what separates words.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII but a-z and 0-9 (after lower-casing).
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False

BASE = 0x9E3779B97F4A7C15 | 1
_UNIT = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((BASE, pow(BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place where x is fresh."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any slices of a sequence of 64-bit units, from prefix sums of a polynomial."""

    def __init__(self, units: np.ndarray):
        up, self.down = powers(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[: len(units)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of each k units in a row."""
        n = max(0, len(self.sums) - k)
        return mixed((self.sums[k : k + n] - self.sums[:n]) * self.down[:n] + np.uint64(k))


def byte_units(data: np.ndarray) -> np.ndarray:
    return _UNIT[data]


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of bytes not `apart`, never across texts), and where each text's words begin among them (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~apart[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first[cut] = inside[cut]
    last[cut[1:] - 1] = inside[cut[1:] - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


#: The first k bytes of a little-endian 64-bit load.
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the words data[start:end]: of up to 16 bytes from two scrambled loads (bijective up to 8), of longer ones XXH3."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    loads = np.ndarray((len(data) + 9,), "<u8", padded.data, strides=(1,))
    size = end - start
    low = loads[start] & MASK[np.minimum(size, 8)]
    out = mixed(low + size.astype(np.uint64) * np.uint64(BASE) + np.uint64(seed * 0x5851F42D4C957F2D % 2**64))
    wide = np.flatnonzero(size > 8)
    high = loads[start[wide] + 8] & MASK[np.minimum(size[wide] - 8, 8)]
    out[wide] = mixed(out[wide] * np.uint64(0xC2B2AE3D27D4EB4F) + mixed(high))
    long = np.flatnonzero(size > 16)
    if len(long):
        digest = xxhash.xxh3_64_intdigest
        out[long] = np.array([digest(data[a:b].tobytes(), seed) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)], np.uint64)
    return out


class WordTable:
    """What a worker has learned of words: a row of values for each (of any length), in arrays, at most about `most` bytes of them.

    Words are told apart by two 64-bit hashes: one finds the row, the other confirms it. Should it ever fail to, the table starts again with
    other hashes. When it is full, only the words of the slice at hand stay.
    """

    def __init__(self, most: int, kind):
        self.most, self.kind, self.seed = most, np.dtype(kind), 1
        self.clear()

    def clear(self) -> None:
        self.keys, self.sure, self.row = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.values = np.zeros(1, np.int64), np.zeros(0, self.kind)

    def rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, learn) -> np.ndarray:
        """The row of each word; learn(list of words) gives the values, as arrays, of those that aren't known."""
        if not len(start):
            return np.zeros(0, np.int64)
        while True:
            hashes, sure = word_hashes(data, start, end, self.seed), word_hashes(data, start, end, self.seed + 1)
            found, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, found)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == found if len(self.keys) else np.zeros(len(found), bool)
            if (sure == sure[first][inverse]).all() and (self.sure[at[known]] == sure[first][known]).all():
                break
            self.seed += 2
            self.clear()
        row = np.zeros(len(found), np.int64)
        row[known] = self.row[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            made = learn([raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            if self.values.nbytes + 32 * len(self.keys) > self.most:
                self.keep(found[known], sure[first][known], row[known])
                row[known] = np.arange(int(known.sum()))
            row[new] = len(self.begin) - 1 + np.arange(len(new))
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
            self.values = np.concatenate((self.values, *made)) if len(made) < 64 else np.concatenate((self.values, np.concatenate(made)))
            place = np.searchsorted(self.keys, found[new])
            self.keys, self.sure = np.insert(self.keys, place, found[new]), np.insert(self.sure, place, sure[first[new]])
            self.row = np.insert(self.row, place, row[new])
        return row[inverse]

    def keep(self, keys: np.ndarray, sure: np.ndarray, row: np.ndarray) -> None:
        """Only these (sorted) keys, in this order."""
        values, sizes = self.gathered(row)
        self.keys, self.sure, self.row = keys, sure, np.arange(len(keys))
        self.begin, self.values = np.concatenate(([0], np.cumsum(sizes))), values

    def gathered(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the rows, one after another, and how many each has."""
        first = self.begin[row]
        sizes = self.begin[row + 1] - first
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.values[at], sizes


def anchored(grams: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Regions of windows that choose one anchor.

    Each window of `length` units inside one of the sequences (bounds: n + 1) chooses its k-gram of least hash, the leftmost of equals:
    windows with equal contents choose at equal offsets. Windows in a row with the same anchor are a region.
    Returns each region's sequence, first window, number of windows, and its anchor's place.
    """
    none = np.zeros(0, np.int64)
    n = int(bounds[-1])
    if n < length:
        return none, none, none, none
    if n >= 1 << 32:
        raise ValueError("sequence too long")
    low = np.uint64(32)  # the same in every call: the upper half of a hash decides, then the place
    keys = (grams[: n - k + 1] >> low << low) | np.arange(n - k + 1, dtype=np.uint64)
    span, p, least = length - k + 1, 1, keys
    while p * 2 <= span:
        least = np.minimum(least[:-p], least[p:])
        p *= 2
    if span > p:
        least = np.minimum(least[: len(least) - (span - p)], least[span - p :])
    step = np.zeros(n + 1, np.int32)
    size = np.diff(bounds)
    long = size >= length
    np.add.at(step, bounds[:-1][long], 1)
    np.add.at(step, bounds[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(step)[: len(least)])
    if not len(starts):
        return none, none, none, none
    place = (least[starts] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    first = starts[at]
    return np.searchsorted(bounds, first, "right") - 1, first, np.diff(np.append(at, len(starts))), place[at]


def covered_runs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges, as sorted maximal runs (touching ranges join)."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], first[1:] > reach[:-1]))
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(first) - 1)
    return first[new], reach[ends]


def kept_bytes(data: bytes, first: np.ndarray, last: np.ndarray) -> bytes:
    """data without the runs."""
    if not len(first):
        return data
    out, at = [], 0
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)

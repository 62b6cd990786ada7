"""Word shingles as 64-bit hashes, minwise values, paths and sketches, in whole arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

MASK = (1 << 64) - 1
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LETTER = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8, person=b"letter").digest()) for b in range(256)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 19
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for i, b in enumerate((BASE, INVERSE)):
            p = np.full(max(n + 1, BLOCK + 1), b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def block_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of a block: a polynomial in the letters' numbers, read off one running sum."""
    data = np.frombuffer(raw, np.uint8)
    p, q = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTER[data] * p[: len(data)], out=sums[1:])
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64) * BASE), starts


def blocks(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Cut after white space about every BLOCK bytes."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and not SPACE[raw[end - 1]]:
            end += 1
        yield at, raw[at:end]
        at = end


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, A-Z lower-cased, and where each text's words end."""
    raws = [t.encode().lower() for t in texts]
    found, places, base = [], [], 0
    joined = b"\n".join(raws)
    for at, raw in blocks(joined):
        h, s = block_words(raw)
        found.append(h)
        places.append(s + at)
    ends = np.cumsum([len(r) + 1 for r in raws]) if raws else np.zeros(0, int)
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    s = np.concatenate(places) if places else np.zeros(0, int)
    return h, np.searchsorted(s, ends)


def word_bounds(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in code points of their text, of the words that words() gives."""
    raws = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raws), np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[data], [True])).astype(np.int8)))
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    base = np.cumsum([0, *(len(r) + 1 for r in raws[:-1])]) if raws else np.zeros(1, int)
    own = letters[base[np.searchsorted(base, edge[::2], "right") - 1]]
    return letters[edge[::2]] - own, letters[edge[1::2]] - own


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    run = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k if len(run) else 0):
        run *= BASE
        run += h[j : j + len(run)]
    return mix(run)


def sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Each text's set of k-word shingles, sorted; with fewer words the whole sequence is one; without words it is empty."""
    h, ends = words(texts)
    run = grams(h, k)
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= k:
            out.append(np.unique(run[start : end - k + 1]))
        elif end > start:
            acc = np.uint64(end - start)
            with np.errstate(over="ignore"):
                for x in h[start:end]:
                    acc = acc * BASE + x
            out.append(mix(np.array([acc ^ BASE], np.uint64)))
        else:
            out.append(h[:0])
        start = end
    return out


class MinHash:
    """`size` minwise values (32 bits) of a set."""

    def __init__(self, size: int, seed: int = 11):
        r = np.random.default_rng(seed)
        self.size = size
        self.a = r.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, size, dtype=np.uint64)

    def values(self, groups: list[np.ndarray], run: int = 1 << 15) -> np.ndarray:
        """groups x size; the groups must not be empty."""
        out, i = np.zeros((len(groups), self.size), np.uint32), 0
        while i < len(groups):
            j, n = i + 1, len(groups[i])
            while j < len(groups) and n + len(groups[j]) <= run:
                n += len(groups[j])
                j += 1
            x = np.concatenate(groups[i:j])
            at = np.cumsum([0, *map(len, groups[i : j - 1])])
            for c in range(self.size):
                v = x * self.a[c]
                v += self.b[c]
                out[i:j, c] = (np.minimum.reduceat(v, at) >> np.uint64(32)).astype(np.uint32)
            i = j
        return out


def bins(shingles: np.ndarray, n: int = 256) -> bytes:
    """A byte for each of n ranges of hashes: 0 where the set has none, else one of 255 numbers by its least hash there."""
    first = np.searchsorted(shingles, np.arange(n, dtype=np.uint64) * np.uint64((1 << 64) // n))
    last = np.append(first[1:], len(shingles))
    least = shingles[np.minimum(first, len(shingles) - 1)]
    return np.where(first < last, (least >> np.uint64(20)) % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8).tobytes()


def paths(values: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """sets x trees: in each tree the node at `depth` that a set's path leads to. Which minwise value comes next follows from the path so far."""
    out, row = np.zeros((len(values), trees), np.uint64), np.arange(len(values))
    with np.errstate(over="ignore"):
        for t in range(trees):
            key = mix(np.full(len(values), t + 1, np.uint64) * BASE)
            for _ in range(depth):
                at = (key % np.uint64(values.shape[1])).astype(np.int64)
                key = mix((key * BASE + at.astype(np.uint64)) * BASE + values[row, at])
            out[:, t] = key
    return out.view(np.int64)


def digest(shingles: np.ndarray, size: int = 16) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=size).digest()

"""Words, their hashes and Arrow batches: what the text operators share.

A word is a run of characters other than space and U+0009 to U+000D, ``[^\\x20\\x09-\\x0D]+``;
``bytes.split()`` splits at exactly these characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD = r"[^\x20\x09-\x0D]+"
#: Rows turned into Python objects at once.
SLICE = 256


class Memo(dict):
    """``f`` by key; emptied beyond ``most`` entries, so that a worker's memory is bounded."""

    def __init__(self, f, most: int = 400_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.f(key)
        return out


def word_hashes() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def hashes_of(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(h: np.ndarray, k: int) -> np.ndarray:
    """The polynomial of every k consecutive elements, from those of 1, 2, 4 and so on."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power = lambda w: np.uint64(pow(0x9E3779B97F4A7C15, w, 1 << 64))
    part, width, out, done = h.astype(np.uint64), 1, None, 0
    while True:
        if k & width:
            out, done = (part, width) if out is None else (out[: len(part) - done] * power(width) + part[done : done + len(out)], done + width)
        if 2 * width > k:
            return out[:n]
        part, width = part[:-width] * power(width) + part[width:], 2 * width


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words; none for fewer words."""
    return mix(sums(h, k))


def free(frame, name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, *columns: str, rows: int = SLICE) -> Iterator[list[list]]:
    """Python lists of the named columns, some rows at a time."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield [part.column(c).to_pylist() for c in columns]

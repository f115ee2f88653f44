"""Words and vectors as every training-data operator reads them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

#: A word: a maximal run of Unicode letters and digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHashes(dict):
    """Word to its 64-bit hash; forgets all when it holds ``most`` words, so its size is bounded."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread bits from any uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def vectors(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable vectors of a list column: not null, no null, NaN or infinite entry, not all zero, of the right length.

    Without ``dim`` the batch's vectors must be of one length; the most common one counts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(-1))
    if dim is None:
        real = size[size > 0]
        if not len(real):
            return np.empty(0, np.int64), np.empty((0, 0))
        dim = int(np.bincount(real).argmax())
    at = np.flatnonzero(size == dim)
    if not len(at) or dim <= 0:
        return np.empty(0, np.int64), np.empty((0, max(dim, 0)))
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(flat, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return at[good], flat[good] / norm[good][:, None]

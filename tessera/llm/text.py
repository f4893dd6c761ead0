"""Word hashes and rolling window hashes for Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base of the polynomial; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CACHE_WORDS = 200_000
#: Rows of an Arrow batch that are Python objects at one time.
SLICE_ROWS = 512


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``; the buffers are shared."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one struct, whatever their names."""
    return F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns])


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """XXH64 of each word, remembered for up to CACHE_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Rabin-Karp hashes of all windows of a sequence, by prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up), 4096)
            up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
            up[0] = down[0] = 1
            self._up, self._down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self._up[:n], self._down[:n]

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """One mixed 64-bit hash for each window of ``width`` consecutive hashes."""
        n = len(hashes)
        if n < width:
            return np.empty(0, np.uint64)
        up, down = self._powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * up, out=sums[1:], dtype=np.uint64)
        return mixed((sums[width:] - sums[: n - width + 1]) * down[: n - width + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads the bits of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:-1]) > 0

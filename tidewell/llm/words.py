"""Words, word hashes and rolling k-grams shared by the text operators.

Two word rules are in use.  ``folded_words`` lower-cases A-Z and takes runs of
ASCII letters, digits and any non-ASCII code point; ``spaced_words`` takes runs
of anything but ASCII white space.  Both work on UTF-8 bytes: every byte of a
non-ASCII code point is 0x80 or above, so a byte table decides the same way as
a code-point class would, without a regular expression.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Byte table: A-Z to a-z, other ASCII that is not a letter or digit to a blank.
_FOLD = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)

#: Distinct words a worker remembers before it starts over; bounds its memory.
CACHE_WORDS = 100_000


def folded_words(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


def spaced_words(raw: bytes | None) -> list[bytes]:
    return raw.split() if raw else []


class WordHashes(dict):
    """Word to 64-bit hash, filled on first use."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every run of k consecutive items."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix64(hashes[:n])
    for j in range(1, k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n + j])
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Distinct positions of the rightmost minimum of each window of that width."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, where = values[:n].copy(), np.arange(n)
    for j in range(1, width):
        later = values[j : n + j]
        lower = later <= best
        best[lower] = later[lower]
        where[lower] = np.flatnonzero(lower) + j
    return np.unique(where)


def binary_column(batch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, without decoding it."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def list_column(parts: list[np.ndarray], kind) -> object:
    """One Arrow list per array."""
    import pyarrow as pa

    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    if flat.dtype == np.uint64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))

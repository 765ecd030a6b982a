"""Word hashes as arrays, and numbers dealt to buckets in packed form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd constants of a well-known 64-bit finaliser; results depend on them.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SHIFT_A, SHIFT_B, SHIFT_C = np.uint64(30), np.uint64(27), np.uint64(31)


class _WordHashes(dict):
    """The hash of every word met lately; emptied when full, long words are not kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = value
        return value


_HASHES = _WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word."""
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers; a bijection."""
    x = (x ^ (x >> SHIFT_A)) * MIX_A
    x = (x ^ (x >> SHIFT_B)) * MIX_B
    return x ^ (x >> SHIFT_C)


def hash_windows(hashes: np.ndarray, starts: np.ndarray, length: int, factor: int) -> np.ndarray:
    """The hash of the `length` words from each start; `factor` is odd and names the hash function."""
    step = np.uint64(factor)
    total = np.zeros(len(starts), np.uint64)
    for k in range(length):
        total = total * step + hashes[starts + k]
    return mix(total)


def planes(numbers: np.ndarray, low: int = 0, high: int = 8) -> bytes:
    """The bytes `low` to `high` (from the least) of 64-bit numbers, those of one rank together."""
    parts = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8)[:, low:high]
    return np.ascontiguousarray(parts.T).tobytes()


def from_planes(data: bytes, low: int = 0, high: int = 8, kind: type = np.int64) -> np.ndarray:
    """The numbers again, with zero in the bytes left out."""
    parts = np.frombuffer(data, np.uint8).reshape(high - low, -1).T
    whole = np.zeros((len(parts), 8), np.uint8)
    whole[:, low:high] = parts
    return whole.view(kind).ravel()


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `max_bytes` of text, one row at least."""
    for batch in batches:
        lengths = np.diff(np.asarray(_offsets(batch.column(column))))
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1]

"""Words of a whole Arrow batch of texts as numpy arrays.

One pass over the bytes finds every word, its document and a 64-bit hash of
its bytes, without a Python object per word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S = np.uint64(31)
_LONG = 64  # bytes of a word from which it is hashed on its own

#: ASCII white space.
WHITE = bytes(range(0x09, 0x0E)) + b" "
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def trim() -> None:
    """Hands freed memory back to the system: a worker stays beside the JVM when its task is over."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: nothing to hand back
        pass


def byte_map(*, lower: bool, punctuation: bool = False) -> np.ndarray:
    """What each byte becomes; 0 separates words. Bytes of non-ASCII characters stay."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[list(WHITE)] = 0
    if punctuation:
        out[list(_PUNCTUATION)] = 0
    out[0] = 1  # a NUL in a text is an ordinary character
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


def slices(column: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a binary column: (first row, rows, their bytes, offsets from 0).

    A run holds about ``most_bytes``; a longer text is a run of its own.
    """
    n = len(column)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j - i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


class Words:
    """Words of a run of texts: ``start``, ``end`` (bytes), ``first`` (word index where each text begins), ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        # eight spare bytes, so that lanes can be read past the end
        self.bytes = np.zeros(len(data) + 8, dtype=np.uint8)
        np.take(table, data, out=self.bytes[:len(data)])
        solid = self.bytes[:len(data)] != 0
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[1:-1] = solid[1:] != solid[:-1]
        if len(data):
            edge[0], edge[-1] = solid[0], solid[-1]
        # a text's end ends a word and its beginning begins one
        inner = offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(data))])
        cut = inner[solid[inner] & solid[inner - 1]]
        at = np.flatnonzero(edge)
        if len(cut):
            at = np.sort(np.concatenate([at, cut, cut]))
        self.start, self.end = at[0::2], at[1::2]
        self.first = np.searchsorted(self.start, offsets)
        self._hash = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.hash_spans(self.start, self.end)
        return self._hash

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges (equal bytes, equal hashes)."""
        return self.of_spans(self.bytes, start, end)

    @staticmethod
    def of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """:meth:`hash_spans` of any bytes with eight to spare at the end."""
        left = end - start
        lanes = np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))
        h = left.astype(np.uint64) * _M1
        long = left > _LONG  # hashed one by one: a text may be one word of any length
        for i in np.flatnonzero(long).tolist():
            h[i] = xxhash.xxh64_intdigest(data[start[i]:start[i] + left[i]])
        todo = np.flatnonzero(~long)
        k = 0
        while len(todo):
            rest = left[todo] - 8 * k
            lane = lanes[start[todo] + 8 * k]
            short = np.clip(8 - rest, 0, 8).astype(np.uint64) * np.uint64(8)
            lane = (lane << short) >> short
            h[todo] = mix((h[todo] ^ lane) * _M1 + np.uint64(k + 1))
            todo = todo[rest > 8]
            k += 1
        return h

    def doc_of(self) -> np.ndarray:
        """Index of each word's text in the run."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words inside one text, and their first words."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        doc = self.doc_of()
        at = np.flatnonzero(doc[:n] == doc[size - 1:])
        h = self.hash
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            out = out * _M2 + h[at + k]
        return mix(out ^ np.uint64(size)), at

"""Vectorised word and shingle hashing shared by the text operators.

A *word* is a maximal run of bytes that are ASCII letters, ASCII digits or part
of a non-ASCII character, after Unicode lower-casing.  Everything else
separates words.  All functions work on whole Arrow string arrays with numpy;
no Python object is made per word.

Null texts count as empty.  Hashes are 64-bit and do not depend on batching,
partitioning or the machine.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; bounds a worker's memory, not what is processed.
SLICE_BYTES = 1 << 20

U64 = np.uint64
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63 - 1, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_Q = U64(0xD6E8FEB86659FD93)
_Q_INV = U64(pow(int(_Q), -1, 1 << 64))
_P_INV = U64(pow(int(_P), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(1024, 1 << int(n).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[int(base)] = have
    return have[:n]


@dataclass
class Words:
    """The words of a batch of texts, in order."""

    hashes: np.ndarray  # uint64, one per word
    first: np.ndarray  # index of each text's first word, and the total at the end
    starts: np.ndarray  # byte offset of each word in data
    ends: np.ndarray
    data: np.ndarray  # lower-cased UTF-8 of all texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def utf8(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets that divide them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(texts: pa.Array) -> Words:
    data, off = utf8(texts)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z.astype(U64), np.zeros(len(off), np.int64), z, z, data)
    w = _WORD[data]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    edges = off[:-1][off[:-1] < n]
    begin[edges] = w[edges]
    last = w.copy()
    last[:-1] &= ~w[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = w[tails]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(last) + 1
    if not len(starts):
        z = np.zeros(0, np.int64)
        return Words(z.astype(U64), np.zeros(len(off), np.int64), z, z, data)
    length = ends - starts
    at = np.zeros(len(starts), np.int64)
    np.cumsum(length[:-1], out=at[1:])
    inside = np.arange(at[-1] + length[-1]) - np.repeat(at, length)
    value = _BYTE[data[w]] * powers(_P, int(length.max()))[inside]
    hashes = mix(np.add.reduceat(value, at) + length.astype(U64) * _Q)
    return Words(hashes, np.searchsorted(starts, off), starts, ends, data)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within one text, and each one's first word."""
    total = len(w.hashes)
    if total < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    q = powers(_Q, total)
    pre = np.zeros(total + 1, U64)
    np.cumsum(w.hashes * q, out=pre[1:])
    h = mix((pre[n:] - pre[:-n]) * powers(_Q_INV, total - n + 1) + U64(n))
    left = np.repeat(w.first[1:], w.counts)[: total - n + 1] - np.arange(total - n + 1)
    ok = np.flatnonzero(left >= n)
    return h[ok], ok


@functools.lru_cache(1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text has about ``most`` bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            yield b.slice(a, z - a)
        release()


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


@dataclass
class Runs:
    """Maximal runs of letters and digits, or of other visible characters, in a batch of texts."""

    hashes: np.ndarray
    first: np.ndarray  # index of each text's first run, and the total at the end
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


_KIND = _WORD.astype(np.uint8)
_KIND[33:128] = np.where(_WORD[33:128], 1, 2)


def runs(texts: pa.Array) -> Runs:
    """Runs of one kind of character, with case kept; white space and control characters separate."""
    data, off = utf8(texts, lower=False)
    n = len(data)
    kind = _KIND[data]
    begin = np.zeros(n, bool)
    if n:
        begin[0] = True
        begin[1:] = kind[1:] != kind[:-1]
        begin[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n) if len(starts) else starts
    seen = kind[starts] > 0
    starts, ends = starts[seen], ends[seen]
    pre = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * powers(_P, n), out=pre[1:])
    hashes = mix((pre[ends] - pre[starts]) * powers(_P_INV, n + 1)[starts] + (ends - starts).astype(U64) * _Q)
    return Runs(hashes, np.searchsorted(starts, off), starts, ends, data)

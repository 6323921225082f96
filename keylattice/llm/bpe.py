"""Byte-pair token ids of whole texts, encoding each distinct chunk once.

A text is cut in front of every single space that has a non-space byte on both
sides, between a letter and punctuation, in front of a line feed that follows a
visible character, and between such a line feed and a letter.  The public
byte-level pattern always ends a piece there (a space joins the piece after
it), so the ids of the chunks, put together, are exactly the ids of the text.
A run of two or more white characters is never cut inside or behind: the
pattern gives its last one to the letter's side or keeps it, by what precedes.
Chunks repeat heavily, so a worker keeps the ids of those it has met, by 64-bit
content hash, and the vocabulary file is only consulted for new ones.
"""

from __future__ import annotations

import base64
import functools
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken

from keylattice.llm.textkit import U64, mix, powers, utf8

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks a worker remembers before it starts afresh; affects speed only.
REMEMBERED = 1_000_000

_BYTE = np.random.default_rng(77).integers(1, 2**63 - 1, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_STOP = _SPACE.copy()
_STOP[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # may begin a wider Unicode space
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FULL = ~_SPACE
_FULL[:33] = _FULL[127:] = False
_PUNCT = _FULL & ~_LETTER
_PUNCT[48:58] = False
_LETTERS = frozenset(np.flatnonzero(_LETTER).tolist())
_SPACES, _STOPS = (frozenset(np.flatnonzero(x).tolist()) for x in (_SPACE, _STOP))


@functools.lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ChunkEncoder:
    """Token ids of batches of texts."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        self.encoder = encoding(path)
        self.width = np.array([len(self.encoder.decode_single_token_bytes(i)) for i in range(self.encoder.n_vocab)], np.int64)
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, U64)  # ascending
        self.at = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new chunks, with one call for most: the ids' byte lengths tell where each chunk ends."""
        plain = [len(c) > 1 and c[0] == 32 and c[1] not in _STOPS and c[-1] not in _SPACES for c in chunks]
        fresh = [not p and c[0] in _LETTERS and c[-1] not in _SPACES for c, p in zip(chunks, plain)]
        usual = [p or f for p, f in zip(plain, fresh)]
        units = [b"\n" + c if f else c for c, f, u in zip(chunks, fresh, usual) if u]
        ids = self.encoder.encode_to_numpy(b"".join(units).decode("utf-8", "replace")).astype(np.int32) if units else np.zeros(0, np.int32)
        ends, want = np.cumsum(self.width[ids]), np.cumsum([len(u) for u in units]).astype(np.int64)
        cut = np.searchsorted(ends, want) + 1
        size = np.zeros(len(chunks), np.int64)
        if len(ids) and (ends[-1] != want[-1] or (ends[cut - 1] != want).any()):
            usual = [False] * len(chunks)  # damaged UTF-8: one chunk at a time
        else:
            size[usual] = np.diff(cut, prepend=0)
        parts, k = [], 0
        lead = np.array(fresh)
        own = np.flatnonzero(~np.array(usual))
        if not len(own):
            keep = np.ones(len(ids), bool)
            keep[(np.cumsum(size) - size)[lead]] = False
            return ids[keep], size - lead
        for i, c in enumerate(chunks):
            if usual[i]:
                parts.append(ids[k + lead[i] : k + size[i]])
                k += size[i]
                size[i] -= lead[i]
            else:
                parts.append(np.array(self.encoder.encode_ordinary(c.decode("utf-8", "replace")), np.int32))
                size[i] = len(parts[-1])
        return np.concatenate(parts), size

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        ids, size = self._encode(chunks)
        where = np.searchsorted(self.keys, keys)
        at = len(self.pool) + np.cumsum(size) - size
        self.keys, self.at, self.size = (np.insert(x, where, y.astype(x.dtype)) for x, y in ((self.keys, keys), (self.at, at), (self.size, size)))
        self.pool = np.concatenate([self.pool, ids])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's first index (with the total at the end)."""
        data, off = utf8(texts, lower=False)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        if len(self.keys) > REMEMBERED:
            self.reset()
        cut = np.zeros(n, bool)
        prev, here = data[:-1], data[1:]
        cut[1:-1] = (here[:-1] == 32) & ~_SPACE[prev[:-1]] & ~_STOP[data[2:]]
        cut[1:] |= (_PUNCT[here] & _LETTER[prev]) | ((here == 10) & _FULL[prev])
        cut[2:] |= _LETTER[data[2:]] & (data[1:-1] == 10) & _FULL[data[:-2]]
        cut[off[:-1][off[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        # a cut must not look over the border of its text
        ends = np.append(starts[1:], n)
        pre = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * powers(_P, n), out=pre[1:])
        keys = mix((pre[ends] - pre[starts]) * powers(_P_INV, n)[starts] + (ends - starts).astype(U64))
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, distinct)
        new = self.keys[np.minimum(found, len(self.keys) - 1)] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            raw, f = data.tobytes(), first[new]
            self._learn(distinct[new], [raw[i:j] for i, j in zip(starts[f].tolist(), ends[f].tolist())])
            found = np.searchsorted(self.keys, distinct)
        where = found[inverse]
        size = self.size[where]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ids = self.pool[np.arange(total[-1]) + np.repeat(self.at[where].astype(np.int64) - total[:-1], size)]
        return ids, total[np.searchsorted(starts, off)]

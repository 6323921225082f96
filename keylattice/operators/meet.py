"""Meeting of complementary tokens within one region: the numpy side of ``match``.

A task gets rows sorted by group (band, region, share). A group has all units of
its region, or, where the region is shared out, a share of them and the units of
the region's lists (``listed``). Nothing is joined row by row: a unit's token
meets a whole list at once, as a row of a boolean matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from keylattice.functions import vocab

FAN_OUT = 100
BUCKET = 500
BUCKET_FILE = 300
NARROW_PROBE, WIDE_PROBE = ([(260, 120), (220, 140), (180, 160), (140, 180)], 220), ([(260, 140), (220, 160), (180, 180), (140, 220)], 260)
NARROW_FAN, WIDE_FAN = [(1200, 24), (800, 32), (500, 40), (300, 56)], [(2000, 32), (1200, 48), (700, 64), (400, 80)]
#: No cap of the file scope binds in a list shorter than this.
SHORT = min(n for steps, _ in (NARROW_PROBE, WIDE_PROBE) for n, _ in steps)
#: Types of edges and the least confidence of the first two.
TYPES, SURE = ("hard", "predicted", "ghost"), (0.85, 0.5)
#: Rows that are gathered before groups are worked on, and cells of a matrix.
ROWS, CELLS = 16_384, 1_000_000
CODE = {t: i for i, t in enumerate(vocab.TOKENS)}
#: token -> (pair, other token, needs a class scope, whether the token is the key), in pair order
_COMPLEMENTS = {t: sorted([(p, CODE[lock], s, True) for p, k, lock, s, _ in vocab.PAIRS if k == t] + [(p, CODE[k], s, False) for p, k, lock, s, _ in vocab.PAIRS if lock == t]) for t in vocab.TOKENS}
COMPLEMENTS = [_COMPLEMENTS[t] for t in vocab.TOKENS]
OUTWARD = [CODE[t] for t in vocab.OUTWARD]
FORMING = [t for t in vocab.TOKENS if t not in vocab.PLAIN]


def _distinct_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of the edge-forming tokens of each row's list, each once where it comes first."""
    value, row = column.flatten().dictionary_encode(), pa.compute.list_parent_indices(column).to_numpy()
    of = np.array([CODE[t] if t in FORMING else -1 for t in value.dictionary.to_pylist()] + [-1])
    code = of[value.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    row, code = row[code >= 0], code[code >= 0]
    _, first = np.unique(row * len(CODE) + code, return_index=True)
    first.sort()
    return row[first], code[first]


def place(scopes: dict[str, int] | None, carry: list[str], rest: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow``: a row for each unit and each band of its tokens, with the codes of these tokens.

    rest: outward tokens that are in no scope or region make a row of band -1, by themselves."""
    kept = ["seq", "unit_id", "file", "cls", "c0", "c1", "c2", *carry]
    band_of = np.array([0 if scopes is None else scopes.get(t) or -1 for t in vocab.TOKENS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            row, code = _distinct_codes(_whole(x.column("tokens")))
            left = np.isin(code, OUTWARD)
            for b in [*((0,) if scopes is None else (1, 2, 3)), *([-1] if rest else [])]:
                region = x.column("dir3" if b == 2 else "file") if b > 1 else pa.array([""]).take(pa.array(np.zeros(x.num_rows, np.int64)))
                if b < 0:
                    region, here = x.column("unit_id"), left
                else:
                    here = (band_of[code] == b) & region.is_valid().to_numpy(zero_copy_only=False)[row]
                    left = left & ~here
                if not here.any():
                    continue
                n = np.bincount(row[here], minlength=x.num_rows)
                at = np.flatnonzero(n)
                codes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[at])), pa.int32()), pa.array(code[here], pa.int32()))
                rows = x.select(kept).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(at), b, np.int32)), region.take(pa.array(at)), codes], [*kept, "band", "region", "codes"])

    return run


def _steps(n: np.ndarray, rows: list[tuple[int, int]], rest: int) -> np.ndarray:
    return np.select([n >= least for least, _ in rows], [cap for _, cap in rows], rest)


class _List:
    """Units of a bucket up to its cap, as places in the region's listed units."""

    def __init__(self, at: np.ndarray, cls: np.ndarray, band: int, fan_out: int, size: int) -> None:
        self.at, self.cls, self.band, self.fan_out, self.size = at, cls[at], band, min(fan_out, FAN_OUT), size
        self._reach: dict[tuple[bool, bool], tuple] = {}

    def reach(self, scoped: bool, classed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For one kind of looker: which places it looks at, the fan-out that they allow, and the former by listed unit."""
        key = (scoped, scoped and classed)
        if key not in self._reach:
            k, n = np.arange(1, len(self.at) + 1), np.full(len(self.at), len(self.at))
            short = len(self.at) < SHORT
            if key[1] and not short:
                _, inv, count = np.unique(self.cls, return_inverse=True, return_counts=True)
                order = np.argsort(inv, kind="stable")
                k = np.empty(len(inv), np.int64)
                k[order] = np.arange(len(inv)) - (np.cumsum(count) - count)[inv[order]] + 1
                n = count[inv] + np.where(self.cls >= 0, np.count_nonzero(self.cls < 0), 0)
            near, most = np.ones(len(k), bool), np.full(len(k), self.fan_out)
            if self.band == 3 and not short:
                near = k <= _steps(n, *(NARROW_PROBE if scoped else WIDE_PROBE))
                most = np.minimum(most, _steps(n, NARROW_FAN if scoped else WIDE_FAN, FAN_OUT))
            whole = np.zeros(self.size, bool)
            whole[self.at] = near
            self._reach[key] = near, most, whole
        return self._reach[key]


class _Batch:
    """Rows as arrays: ``pos`` has each token's position within the unit, -1 where it is absent."""

    def __init__(self, t: pa.Table) -> None:
        t = t.combine_chunks()
        column = lambda c: t.column(c).combine_chunks()
        flat = lambda c: column(c).to_numpy(zero_copy_only=False)
        coded = lambda c: (lambda d: d.indices.fill_null(-1).to_numpy(zero_copy_only=False))(_whole(column(c)).dictionary_encode())
        self.table, self.n = t, t.num_rows
        self.seq, self.band, self.listed = flat("seq"), flat("band"), flat("listed")
        self.cls, self.file = coded("cls"), coded("file")
        self.sure = np.stack([flat(c) for c in ("c0", "c1", "c2")], axis=1)
        codes = _whole(column("codes"))
        offsets, values = codes.offsets.to_numpy(), codes.values.to_numpy()
        values = values[offsets[0] : offsets[-1]]
        size = np.diff(offsets)
        self.pos = np.full((self.n, len(CODE)), -1, np.int8)
        self.pos[np.repeat(np.arange(self.n), size), values] = np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], size)


def _whole(a: pa.Array | pa.ChunkedArray) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def _starts(t: pa.Table) -> np.ndarray:
    """Where groups begin."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for c in ("band", "share", "region"):
        a = _whole(t.column(c).combine_chunks())
        v = (a.dictionary_encode().indices if c == "region" else a).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _small(b: _Batch, rows: np.ndarray, group: np.ndarray, fan_out: int, first_only: bool) -> Iterator[tuple]:
    """The same for many small groups at once: all of a group's units are in its lists and see each other, so that of two ends the one with the smaller seq comes first."""
    order = np.lexsort((b.seq[rows], group))
    rows, group = rows[order], group[order]
    has = b.pos[rows] >= 0
    for t in np.flatnonzero(has.any(axis=0)):
        mine, parts = rows[has[:, t]], []
        for p, o, scoped, key in COMPLEMENTS[t]:
            others, there = rows[has[:, o]], group[has[:, o]]
            low = np.searchsorted(there, group[has[:, t]])
            n = np.searchsorted(there, group[has[:, t]], side="right") - low
            at = np.repeat(np.arange(len(mine)), n)
            z = others[np.arange(len(at)) - np.repeat(np.cumsum(n) - n - low, n)]
            a = mine[at]
            ok = b.seq[a] < b.seq[z] if first_only else b.seq[a] != b.seq[z]
            at, a, z = at[ok], a[ok], z[ok]
            ok = np.ones(len(a), bool)
            if scoped:
                ok &= (b.file[a] == b.file[z]) & (b.file[a] >= 0) & ((b.cls[a] < 0) | (b.cls[z] < 0) | (b.cls[a] == b.cls[z]))
            if first_only:
                ok &= ~((b.pos[a, o] >= 0) & (b.pos[a, o] < b.pos[a, t]) & (b.pos[z, t] >= 0))
            if ok.any():
                parts.append((at[ok], z[ok], np.full(np.count_nonzero(ok), p, np.int32), np.full(np.count_nonzero(ok), key)))
        if not parts:
            continue
        at, z, pair, key = (np.concatenate(x) for x in zip(*parts))
        if not first_only:
            yield int(t), mine[np.unique(at)], np.True_
            continue
        n = np.bincount(at)
        if n.max() > fan_out:
            order = np.lexsort((b.seq[z], pair, at))
            at, z, pair, key = at[order], z[order], pair[order], key[order]
            start = np.cumsum(n) - n
            kept = np.arange(len(at)) - start[at] < fan_out
            at, z, pair, key = at[kept], z[kept], pair[kept], key[kept]
        yield mine[at], z, pair, key


def _meetings(b: _Batch, start: int, end: int, fan_out: int, first_only: bool) -> Iterator[tuple]:
    """(token, whether each column's token is the key, pairs of columns, rows, list rows, kept cells) of a group, some rows at a time."""
    here = np.arange(start, end)
    listed = b.listed[start:end]
    shared = bool(listed.any())
    ls = here[listed] if shared else here
    ls = ls[np.argsort(b.seq[ls], kind="stable")]
    seq, pos, cls, file, band = b.seq[ls], b.pos[ls], b.cls[ls], b.file[ls], int(b.band[start])
    cap = BUCKET_FILE if band == 3 else BUCKET
    has = pos >= 0
    lists = {int(o): _List(np.flatnonzero(has[:, o])[:cap], cls, band, fan_out, len(ls)) for o in np.flatnonzero(has.any(axis=0))}
    who = here[~listed] if shared else here
    place = np.minimum(np.searchsorted(seq, b.seq[who]), len(ls) - 1)
    known = seq[place] == b.seq[who]
    # units outside of all lists lose no edge to another end, so they are taken apart
    for some in (np.flatnonzero(~known), np.flatnonzero(known)) if shared else (np.arange(len(who)),):
        if not len(some):
            continue
        tokens = b.pos[who[some]] >= 0
        for t in np.flatnonzero(tokens.any(axis=0)):
            pairs = [(p, o, scoped, key) for p, o, scoped, key in COMPLEMENTS[t] if o in lists]
            if not pairs:
                continue
            width = sum(len(lists[o].at) for _, o, _, _ in pairs)
            step = max(1, CELLS // width)
            mine = some[tokens[:, t]]
            for i in range(0, len(mine), step):
                m = mine[i : i + step]
                yield from _rows(b, who[m], place[m], known[m], int(t), pairs, lists, (ls, seq, pos, cls, file), fan_out, first_only)


def _rows(b: _Batch, a: np.ndarray, place: np.ndarray, known: np.ndarray, t: int, pairs: list, lists: dict[int, _List], region: tuple, fan_out: int, first_only: bool) -> Iterator[tuple]:
    ls, seq, pos, cls, file = region
    inside = bool(known.any())
    a_seq, a_cls, a_file, a_pos = b.seq[a][:, None], b.cls[a][:, None], b.file[a][:, None], b.pos[a]
    cells, mosts, to, pair, key = [], [], [], [], []
    for p, o, scoped, is_key in pairs:
        x = lists[o]
        own = lists.get(t)
        at = x.at
        near, most, _ = x.reach(scoped, False)
        if scoped:
            near1, most1, _ = x.reach(True, True)
            classed, b_classed = a_cls >= 0, (cls[at] >= 0)[None, :]
            ok = (a_file == file[at][None, :]) & (~classed | ~b_classed | (a_cls == cls[at][None, :])) & np.where(classed, near1[None, :], near[None, :])
            ok &= a_file >= 0  # files that are not known are not the same
            most = np.where(classed, most1[None, :], most[None, :])
        else:
            at, most = at[near], most[near]  # ranks: the places looked at come first
            ok, most = None, most[None, :]
        if inside:
            other = a_seq != seq[at][None, :]
            ok = other if ok is None else ok & other
        if first_only and own is not None:
            b_has, a_has = pos[at, t] >= 0, a_pos[:, o] >= 0
            turns = a_has & (a_pos[:, o] < a_pos[:, t])
            lost = None
            if turns.any() and b_has.any():
                seen = own.reach(scoped, False)[2][at][None, :]
                if scoped:
                    seen = np.where(classed, own.reach(True, True)[2][at][None, :], seen)
                lost = turns[:, None] & b_has[None, :] & seen
            if inside:
                mine = lambda li, c: (li.reach(scoped, c)[2][place] & known)[:, None]
                by = lambda li: np.where(b_classed, mine(li, True), mine(li, False)) if scoped else mine(li, False)
                back = (by(own) | (by(x) & a_has[:, None] & b_has[None, :])) & (seq[at][None, :] < a_seq)
                lost = back if lost is None else lost | back
            if lost is not None:
                ok = ~lost if ok is None else ok & ~lost
        cells.append(ok)
        mosts.append(most)
        to.append(ls[at])
        pair.append(np.full(len(at), p, np.int32))
        key.append(np.full(len(at), is_key))
    if not first_only:
        yield t, a, np.any([np.full(len(a), len(c) > 0) if ok is None else ok.any(axis=1) for ok, c in zip(cells, to)], axis=0)
        return
    to, pair, key = np.concatenate(to), np.concatenate(pair), np.concatenate(key)
    if all(ok is None for ok in cells):
        col = np.flatnonzero(np.arange(1, len(to) + 1) <= np.concatenate([m[0] for m in mosts]))
        r, c = np.repeat(np.arange(len(a)), len(col)), np.tile(col, len(a))
    else:
        whole = np.concatenate([np.ones((len(a), m.shape[1]), bool) if ok is None else ok for ok, m in zip(cells, mosts)], axis=1)
        most = np.concatenate([np.broadcast_to(m, (len(a), m.shape[1])) if any(x.shape[0] > 1 for x in mosts) else m for m in mosts], axis=1)
        r, c = np.nonzero(whole & (np.cumsum(whole, axis=1, dtype=np.int32) <= most))
    if len(r):
        yield a[r], to[c], pair[c], key[c]


def _confidence(b: _Batch, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    near = (b.file[a] == b.file[z]) & (b.file[a] >= 0)
    level = near.astype(np.int8) + (near & (b.cls[a] == b.cls[z]) & (b.cls[a] >= 0))
    return np.fmin(b.sure[a, level], b.sure[z, level])


def _kind(confidence: np.ndarray) -> np.ndarray:
    """Places in ``TYPES``."""
    return 2 - (confidence >= SURE[1]).astype(np.int64) - (confidence >= SURE[0])


def _edges(b: _Batch, parts: list[tuple], carry: list[str], least: float) -> pa.RecordBatch:
    a, z, pair, key = (np.concatenate(x) for x in zip(*parts))
    sure = _confidence(b, a, z)
    if least > 0:
        kept = sure >= least
        a, z, pair, key, sure = a[kept], z[kept], pair[kept], key[kept], sure[kept]
    s, t = pa.array(np.where(key, a, z)), pa.array(np.where(key, z, a))
    take = lambda c, at: _whole(b.table.column(c).combine_chunks()).take(at)
    names, arrays = ["source_id", "target_id", "pair_ord", "confidence", "band"], [take("unit_id", s), take("unit_id", t), pa.array(pair), pa.array(sure, from_pandas=True), pa.array(b.band[a])]
    for c in carry:
        names += [f"source_{c}", f"target_{c}"]
        arrays += [take(c, s), take(c, t)]
    return pa.RecordBatch.from_arrays(arrays, names)


class _Counts:
    """Edges by scope, pair and type."""

    def __init__(self, b: _Batch, carry: list[str]) -> None:
        self.b, self.n = b, np.zeros((4, len(vocab.PAIRS), len(TYPES)), np.int64)

    def add(self, a: np.ndarray, z: np.ndarray, pair: np.ndarray, key: np.ndarray) -> None:
        at = (self.b.band[a] * len(vocab.PAIRS) + pair) * len(TYPES) + _kind(_confidence(self.b, a, z))
        self.n += np.bincount(at, minlength=self.n.size).reshape(self.n.shape)

    def rows(self) -> pa.RecordBatch:
        band, pair = np.nonzero(self.n.any(axis=2))
        return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(band.astype(np.int32)), *map(pa.array, self.n[band, pair].T)], ["pair_ord", "band", *TYPES])


class _Ends:
    """Ends of edges by type, for each value of a column (or null)."""

    def __init__(self, b: _Batch, carry: list[str]) -> None:
        column = _whole(_whole(b.table.column(carry[0]).combine_chunks()).dictionary_encode())
        self.b, self.names = b, column.dictionary
        self.of = column.indices.fill_null(len(self.names)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.n = np.zeros((len(self.names) + 1) * len(TYPES), np.int64)

    def add(self, a: np.ndarray, z: np.ndarray, pair: np.ndarray, key: np.ndarray) -> None:
        kind = _kind(_confidence(self.b, a, z))
        at, n = np.unique(np.concatenate((self.of[a] * len(TYPES) + kind, self.of[z] * len(TYPES) + kind)), return_counts=True) if len(a) * 8 < len(self.n) else (slice(None), np.bincount(self.of[a] * len(TYPES) + kind, minlength=len(self.n)) + np.bincount(self.of[z] * len(TYPES) + kind, minlength=len(self.n)))
        self.n[at] += n

    def rows(self) -> pa.RecordBatch:
        n = self.n.reshape(-1, len(TYPES))
        at = np.flatnonzero(n.any(axis=1))
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(at, mask=at == len(self.names))), *map(pa.array, n[at].T)], ["name", *TYPES])


class _Apart:
    """Units with an edge to a unit that has another value of a column."""

    def __init__(self, b: _Batch, carry: list[str]) -> None:
        self.b = b
        self.of = _whole(_whole(b.table.column(carry[0]).combine_chunks()).dictionary_encode()).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.seen = np.zeros(b.n, bool)

    def add(self, a: np.ndarray, z: np.ndarray, pair: np.ndarray, key: np.ndarray) -> None:
        apart = (self.of[a] != self.of[z]) & (self.of[a] >= 0) & (self.of[z] >= 0)
        self.seen[a[apart]] = self.seen[z[apart]] = True

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_whole(self.b.table.column("unit_id").combine_chunks()).take(pa.array(np.flatnonzero(self.seen)))], ["unit_id"])


#: What is only counted or marked: no edge becomes a row.
FOLDS = {"counts": _Counts, "ends": _Ends, "apart": _Apart}


def _file_pairs(b: _Batch, parts: list[tuple]) -> pa.RecordBatch | None:
    a, z, _, _ = (np.concatenate(x) for x in zip(*parts))
    f, g = b.file[a].astype(np.int64), b.file[z].astype(np.int64)
    apart = (f != g) & (f >= 0) & (g >= 0)
    both, n = np.unique(np.minimum(f, g)[apart] << 32 | np.maximum(f, g)[apart], return_counts=True)
    names = _whole(_whole(b.table.column("file").combine_chunks()).dictionary_encode()).dictionary
    return pa.RecordBatch.from_arrays([names.take(pa.array(both >> 32)), names.take(pa.array(both & 0xFFFFFFFF)), pa.array(n.astype(np.int64))], ["s", "t", "n"]) if len(n) else None


def _every(b: _Batch, starts: np.ndarray, fan_out: int, first_only: bool) -> Iterator[tuple]:
    ends = np.append(starts[1:], b.n)
    size = ends - starts
    large = (size >= SHORT) | b.listed[starts]
    for start, end in zip(starts[large].tolist(), ends[large].tolist()):
        yield from _meetings(b, start, end, fan_out, first_only)
    group = np.repeat(np.arange(len(starts)), size)
    rows = np.flatnonzero(~large[group])
    i = 0
    while i < len(rows):  # whole groups, some at a time
        j = int(np.searchsorted(group[rows], group[rows[min(i + ROWS, len(rows)) - 1]], side="right"))
        yield from _small(b, rows[i:j], group[rows[i:j]], min(fan_out, FAN_OUT), first_only)
        i = j


def _work(t: pa.Table, starts: np.ndarray, kind: str, fan_out: int, carry: list[str], least: float) -> Iterator[pa.RecordBatch]:
    b = _Batch(t)
    if kind == "open":
        yield _open(b, starts, fan_out, carry)
        return
    if kind in FOLDS:
        fold = FOLDS[kind](b, carry)
        for got in _every(b, starts, fan_out, True):
            fold.add(*got)
        yield fold.rows()
        return
    parts, n = [], 0
    form = _file_pairs if kind == "files" else lambda b, p: _edges(b, p, carry, least)
    for got in _every(b, starts, fan_out, True):
        parts.append(got)
        n += len(got[0])
        if n >= 100_000:
            if (out := form(b, parts)) is not None:
                yield out
            parts, n = [], 0
    if parts and (out := form(b, parts)) is not None:
        yield out


def _open(b: _Batch, starts: np.ndarray, fan_out: int, carry: list[str]) -> pa.RecordBatch:
    """Outward tokens without any candidate; a unit and token is in one group only, but for the group's listed units."""
    found = np.zeros(b.pos.shape, bool)
    for t, a, seen in _every(b, starts, fan_out, False):
        a = a[np.broadcast_to(seen, a.shape)]
        found[a[b.band[a] >= 0], t] = True
    at, code = np.nonzero((b.pos[:, OUTWARD] >= 0) & ~found[:, OUTWARD] & ~b.listed[:, None])
    take = lambda c: _whole(b.table.column(c).combine_chunks()).take(pa.array(at))
    return pa.RecordBatch.from_arrays([take("unit_id"), pa.array(np.array(OUTWARD, np.int32)[code]), take("seq"), *map(take, carry)], ["source_id", "code", "seq", *carry])


def meet(kind: str, fan_out: int = FAN_OUT, carry: list[str] | None = None, least: float = 0.0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow``. kind: "edges", "files" (file pairs with counts), "open" (outward tokens without any candidate), or one of ``FOLDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for x in batches:
            if not x.num_rows:
                continue
            held.append(x)
            size += x.num_rows
            if size < ROWS:
                continue
            t = pa.Table.from_batches(held)
            starts = _starts(t)
            if len(starts) == 1:  # one group; its end is not known yet
                continue
            last = int(starts[-1])
            yield from _work(t.slice(0, last), starts[:-1], kind, fan_out, carry or [], least)
            held, size = t.slice(last).to_batches(), t.num_rows - last
        if held:
            t = pa.Table.from_batches(held)
            yield from _work(t, _starts(t), kind, fan_out, carry or [], least)

    return run

"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has 126 bits, each the sign of a weighted vote of its
distinct words; a word weighs its length less one (1 to 6), so short function
words, which all texts of a language share, count little.  Documents are near
duplicates when their fingerprints differ in at most ``DISTANCE`` bits.

The fingerprint is cut into seven segments of 18 bits.  Around each segment the
Hamming ball of radius 1 is enumerated and entered in a table keyed by (segment,
value).  Two fingerprints whose segments differ in at most 2 bits meet in that
table, since the balls of both sides meet half-way: 19 keys a segment do what
172 probes would.  By the pigeonhole principle fingerprints that differ in 20
bits or fewer have such a segment, so the search is exact.  The table is split
by segment and first bits of the value, more bits the more fingerprints there
are; keys that share them travel as one row.  Of the keys on which a pair meets,
one is kept, and every match is verified over the complete fingerprints.

Equal fingerprints are folded into one before the search, so exact copies cost
nothing.  A part of the table with more than ``PART_ROWS`` rows is dealt into
blocks, and each pair of blocks is a task's work of its own, so no hot segment
value gathers in one task.  Pairs never leave a part: it returns, for each of
its fingerprints, the number of links and the root of its tree in the part's
spanning forest.  Groups are the connected components of all forests; the text
with the smallest (``doc_id``, text hash) of a group is the one that stays.

Defined cases: null and empty texts, and texts without a word, have no
fingerprint, duplicate nothing and all stay; a text of any length is voted on
whole; rows with a null ``doc_id`` cannot be named, are left out of
``near_duplicates``, and all stay in ``keep_one``; rows that share a ``doc_id``
and differ in text are judged each by its own text; rows that share both are one
document, of which ``keep_one`` keeps one row; ties of the vote give a zero bit;
other columns, whatever their names, are left alone; an empty table gives an
empty result; an id that isn't a number fails the cast to bigint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keylattice.llm.shared import fresh, materialize
from keylattice.llm.textkit import U64, mix, slices, words

SEGMENTS, WIDTH = 7, 18
BITS = SEGMENTS * WIDTH
DISTANCE = 20
_PRINT = "doc_id bigint, a bigint, b bigint, mark bigint"
#: Fingerprints that a part of the table should have; more make more parts.
GROUP_ROWS = 20_000
#: Rows of a part beyond which it is dealt into blocks.
PART_ROWS = 400_000
#: Verified pairs folded at once; bounds memory only.
_PAIRS = 1 << 20
#: Bytes of names of texts that go, up to which they are broadcast, and bytes of one.
BROADCAST_BYTES, FATE_BYTES = 128 << 20, 24
#: Words whose votes are counted at once; bounds memory only.
_BLOCK = 1 << 15


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves (63 bits each) of every text's fingerprint, and whether it has any word."""
    w = words(texts)
    n = len(w.first) - 1
    doc = w.doc_of()
    _, i = np.unique(mix(w.hashes + mix(doc.astype(U64) + U64(1)) * U64(3)), return_index=True)
    i.sort()
    doc, h = doc[i], w.hashes[i]
    weight = np.clip(w.ends[i] - w.starts[i] - 1, 1, 6).astype(np.uint8)
    votes = np.zeros((n, 128), np.int32)
    for k in range(0, len(h), _BLOCK):
        d, x, q = doc[k : k + _BLOCK], h[k : k + _BLOCK], weight[k : k + _BLOCK]
        both = np.stack([mix(x + U64(0x51ED2701)), mix(x ^ U64(0xA5A5F00D12345678))], axis=1)
        bits = np.unpackbits(both.view(np.uint8).reshape(len(x), 16), axis=1)
        bits *= q[:, None]
        rows, begin = np.unique(d, return_index=True)
        votes[rows] += 2 * np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        votes[rows] -= np.add.reduceat(q, begin, dtype=np.int32)[:, None]
    keep = np.zeros((n, 128), np.uint8)
    keep[:, 1:64] = votes[:, :63] > 0
    keep[:, 65:128] = votes[:, 63:126] > 0
    halves = np.packbits(keep, axis=1).view(">u8").astype(np.int64)
    return halves[:, 0], halves[:, 1], np.diff(w.first) > 0


def prints(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            x, y, ok = fingerprints(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x), pa.array(y), b.column("mark")], names=["doc_id", "a", "b", "mark"]).filter(pa.array(ok))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(run, _PRINT)


def _segments(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    a, b = (t.column(x).to_numpy() for x in "ab")
    every = (b, b >> 18, b >> 36, (b >> 54) | (a << 9), a >> 9, a >> 27, a >> 45)
    return np.stack([x & ((1 << WIDTH) - 1) for x in every], axis=1)


def _rows_of(b: pa.RecordBatch, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and flip of every row that the fingerprints need: (node, segment, row).

    A part is a segment and its ``high`` first bits.  The segment itself and the
    turns of its other bits share a part and travel as one row (flip -1); only
    the turns of the first bits need rows of their own."""
    low = WIDTH - high
    turn = np.append(0, 1 << np.arange(low, WIDTH, dtype=np.int64))
    keys = _segments(b)[:, :, None] ^ turn
    part = (keys >> low) | (np.arange(SEGMENTS, dtype=np.int64)[None, :, None] << high)
    return part, np.broadcast_to(np.append(-1, np.arange(low, WIDTH)), part.shape)


def _pieces(batches):
    for big in batches:
        for k in range(0, big.num_rows, 8192):
            yield big.slice(k, 8192)


def _blocks(nodes: DataFrame, high: int, part_rows: int) -> np.ndarray:
    """Blocks of each part; there are SEGMENTS * 2**high parts, whatever the number of fingerprints."""
    size = SEGMENTS << high

    def run(batches):
        n = np.zeros(size, np.int64)
        for b in _pieces(batches):
            n += np.bincount(_rows_of(b, high)[0].ravel(), minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["part", "n"])

    total = nodes.select("a", "b").mapInArrow(run, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n")).toPandas()
    out = np.ones(size, np.int64)
    out[total["part"].to_numpy(np.int64)] = -(-total["n"].to_numpy(np.int64) // part_rows)
    return out


_ROW = "part int, i int, j int, block int, flip tinyint, node bigint, a bigint, b bigint"


def _spread(nodes: DataFrame, high: int, blocks: np.ndarray) -> DataFrame:
    """Every fingerprint, once for each part that it needs, or once for each pair of blocks there."""
    given = nodes.sparkSession.sparkContext.broadcast(blocks)

    def run(batches):
        blocks = given.value
        for b in _pieces(batches):
            part, flip = _rows_of(b, high)
            row = np.repeat(np.arange(b.num_rows), part[0].size)
            part, flip = part.ravel(), flip.ravel()
            own = (mix(b.column("node").to_numpy().astype(U64))[row] % blocks[part].astype(U64)).astype(np.int64)
            copies = blocks[part]
            if (copies > 1).any():
                at = np.repeat(np.arange(len(part)), copies)
                other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                row, part, flip, own = row[at], part[at], flip[at], own[at]
            else:
                other = own
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.astype(np.int32)) for x in (part, np.minimum(own, other), np.maximum(own, other), own)), pa.array(flip.astype(np.int8)), *(b.column(x).take(pa.array(row)) for x in ("node", "a", "b"))],
                names=["part", "i", "j", "block", "flip", "node", "a", "b"],
            )

    return nodes.select("node", "a", "b").mapInArrow(run, _ROW)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest index that each of n things is connected with by the links (x, y)."""
    label = np.arange(n)
    while len(x):
        p, q = label[x], label[y]
        some = p != q
        x, y, p, q = x[some], y[some], p[some], q[some]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    return label


def match(t: pa.Table, high: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, root in the spanning forest, and number of verified links, of all linked nodes of a part (or a pair of its blocks).

    Each pair of the corpus counts in one part: the first segment in which it meets."""
    low = WIDTH - high
    part, flip = t.column("part").to_numpy(), t.column("flip").to_numpy().astype(np.int64)
    ids, node = np.unique(t.column("node").to_numpy(), return_inverse=True)
    a, b, block = (t.column(c).to_numpy() for c in ("a", "b", "block"))
    crossed = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    segments = _segments(t)
    s = int(part[0]) >> high
    own = segments[:, s]
    centre = np.flatnonzero(flip < 0)
    key = np.concatenate([np.where(flip < 0, own, own ^ (1 << np.maximum(flip, 0))), (own[centre][:, None] ^ (1 << np.arange(low))).ravel()])
    row = np.concatenate([np.arange(len(own)), np.repeat(centre, low)])
    turned = np.concatenate([flip, np.tile(np.arange(low), len(centre))])
    # entries of one key side by side, keys with the most entries first
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    order = np.argsort(rank[which], kind="stable")
    key, row, turned, size = key[order], row[order], turned[order], count[which][order]
    x1, x2 = a[row], b[row]
    label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> None:
        nonlocal label
        x, y = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
        kept.clear()
        np.add.at(links, x, 1)
        np.add.at(links, y, 1)
        label = forest(len(ids), *(np.concatenate([c, d]) for c, d in ((x, np.arange(len(ids))), (y, label))))

    upto = np.searchsorted(-size, -np.arange(1, size[0] + 1), "left") if len(size) else []  # entries whose key has more than d
    held = 0
    for d, m in enumerate(upto, 1):
        if m <= d:
            break
        near = np.bitwise_count(x1[: m - d] ^ x1[d:m]) + np.bitwise_count(x2[: m - d] ^ x2[d:m]) <= most
        near &= key[: m - d] == key[d:m]
        left = np.flatnonzero(near)
        if not len(left):
            continue
        x, y, f, g = row[left], row[left + d], turned[left], turned[left + d]
        swap = node[x] > node[y]
        x, y, f, g = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, g, f), np.where(swap, f, g)
        # of the keys on which a pair meets, one: equal segments, one bit apart, two bits apart
        one = (node[x] < node[y]) & ((f < g) | ((f < 0) & (g < 0)))
        one &= ~(np.bitwise_count(segments[x, :s] ^ segments[y, :s]) <= 2).any(1)
        if crossed:
            one &= block[x] != block[y]
        kept.append((node[x[one]], node[y[one]]))
        held += len(kept[-1][0])
        if held > _PAIRS:
            fold()
            held = 0
    if kept:
        fold()
    some = np.flatnonzero(links)
    return ids[some], ids[label[some]], links[some]


def linked(nodes: DataFrame, most: int = DISTANCE, group_rows: int = GROUP_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, root, links) of every linked fingerprint in every part: links add up to the number of others within the distance, and (node, root) connects all that is linked."""
    if most >= SEGMENTS * 3:
        raise ValueError(f"the search is exact up to distance {SEGMENTS * 3 - 1}")
    high = min(WIDTH - 1, max(3, (max(1, nodes.count()) // group_rows).bit_length()))

    def run(t: pa.Table) -> pa.Table:
        node, root, links = match(t.combine_chunks(), high, most)
        return pa.table({"node": node, "root": root, "links": links})

    return _spread(nodes, high, _blocks(nodes, high, part_rows)).groupBy("part", "i", "j").applyInArrow(run, "node bigint, root bigint, links bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node that it is connected with.

    Every round takes the smallest label among the neighbours and then the
    label's own label, so labels travel fast; each round's labels are a written
    table."""
    both = materialize(edges.select("x", "y").union(edges.select("y", "x")).toDF("x", "y"), "edges")
    labels = materialize(both.groupBy("x").agg(F.least("x", F.min("y")).alias("l")).select(F.col("x").alias("node"), F.col("l").alias("label")), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("near"))
        closer = labels.join(near, labels["node"] == near["x"]).select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("to"))
        after = materialize(
            closer.join(jump, closer["near"] == jump["via"], "left").select("node", F.least("near", "to").alias("label"), (F.least("near", "to") != F.col("label")).alias("moved")),
            "labels",
        )
        labels = after.select("node", "label")
        if not after.where("moved").limit(1).count():
            return labels.withColumnRenamed("label", "root")


def _members(docs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, root, links) of the texts in groups of two or more; and all fingerprints."""
    every = materialize(prints(docs), "prints")
    text = F.struct("doc_id", "mark")
    nodes = every.groupBy("a", "b").agg((F.min(text) != F.max(text)).alias("many")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes")
    found = materialize(linked(nodes, most), "linked")
    roots = components(found.where("node <> root").select(F.col("node").alias("x"), F.col("root").alias("y")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = nodes.join(roots.join(links, "node"), "node", "left").where("many or root is not null")
    classes = materialize(classes.select("a", "b", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    return materialize(every.join(classes, ["a", "b"]).select("doc_id", "mark", "root", "links").distinct(), "members"), every


def near_duplicates(docs: DataFrame, most: int = DISTANCE) -> DataFrame:
    """A row for every document that is a near duplicate of another one that stays.

    ``links`` counts the other fingerprints within the distance of its own (equal ones are one); ``group_size`` counts documents."""
    members, _ = _members(docs, most)
    size = members.groupBy("root").agg(F.min("doc_id").alias("duplicate_of"), F.countDistinct("doc_id").alias("group_size"))
    one = members.groupBy("root", "doc_id").agg(F.max("links").alias("links"))
    return one.join(size, "root").where("doc_id <> duplicate_of").select("doc_id", "duplicate_of", "group_size", "links")


def keep_one(docs: DataFrame, most: int = DISTANCE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows that stay, one text of each group, with all their columns.

    The names of the texts that go are broadcast while they fit
    ``broadcast_bytes``; beyond that they are joined in a shuffle of all rows."""
    members, every = _members(docs, most)
    text = F.struct("doc_id", "mark")
    first = members.groupBy("root").agg(F.min(text).alias("first"))
    gone = members.join(first, "root").where(text != F.col("first")).select("doc_id", "mark", F.lit(0).alias("n"))
    again = every.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1")
    fate = materialize(gone.union(again).groupBy("doc_id", "mark").agg(F.min("n").alias("n")), "fate")

    names = docs.columns
    i, m, n, k = (fresh(x, names) for x in ("id_of_row", "mark_of_row", "fate_of_row", "place_of_row"))
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), m: F.xxhash64("text")})
    if fate.count() * FATE_BYTES <= broadcast_bytes:
        told = _told(rows, i, m, n, fate)
    else:
        told = rows.join(fate.toDF(i, m, n), [i, m], "left").select(*names, i, m, n)
    some = told.where(F.col(n).isNull()).select(*names)
    if not fate.where("n > 0").limit(1).count():
        return some
    sortable = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    one = Window.partitionBy(i, m).orderBy(F.xxhash64(*sortable))
    single = told.where(F.col(n) > 0).withColumn(k, F.row_number().over(one)).where(F.col(k) == 1)
    return some.union(single.select(*names))


def _told(rows: DataFrame, i: str, m: str, n: str, fate: DataFrame) -> DataFrame:
    """The rows with their fate (null where there is none), without a shuffle: the fates are broadcast as arrays."""
    t = fate.toPandas()
    key = t["mark"].to_numpy(np.int64) ^ mix(t["doc_id"].to_numpy(np.int64).view(U64)).view(np.int64)
    order = np.argsort(key, kind="stable")
    key, ids, what = key[order], t["doc_id"].to_numpy(np.int64)[order], t["n"].to_numpy(np.int64)[order]
    longest = int(np.unique(key, return_counts=True)[1].max()) if len(key) else 0  # keys that collide stand side by side
    given = rows.sparkSession.sparkContext.broadcast((key, ids, what, longest))
    schema = StructType([*rows.schema.fields, StructField(n, LongType())])

    def run(batches):
        key, ids, what, longest = given.value
        for b in batches:
            own = b.column(i).fill_null(0).to_numpy()
            k = b.column(m).to_numpy() ^ mix(own.view(U64)).view(np.int64)
            at, out, known = np.searchsorted(key, k), np.zeros(len(k), np.int64), np.zeros(len(k), bool)
            for step in range(longest):
                p = np.minimum(at + step, len(key) - 1)
                hit = (key[p] == k) & (ids[p] == own)
                out[hit], known = what[p[hit]], known | hit
            known &= b.column(i).is_valid().to_numpy(zero_copy_only=False)
            stays = ~known | (out > 0)
            b = pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=~known)], names=[*b.schema.names, n])
            yield b if stays.all() else b.filter(pa.array(stays))

    return rows.mapInArrow(run, schema)

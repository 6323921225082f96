"""Benchmark decontamination by a prefix-filtered set join.

An item is the set of its word n-grams (an item of fewer than ``N`` words is
matched as one n-gram of its own length).  A document contains an item when
some window of the document, as long as the item, holds at least ``SHARE`` of
the item's n-grams.

1. One narrow pass over the text keeps, for every document, the positions of
   n-grams that any item has.  This is all that later steps read.
2. The document frequency of those n-grams orders each item's set by rarity.  A
   window that holds ``required`` of ``size`` n-grams must hold one of the
   ``size - required + 1`` rarest: its necessary prefix.  Only documents with a
   prefix n-gram are candidates for the item.
3. A length bound drops documents with fewer item n-grams than required.  A
   positional bound drops a candidate when the rank of its first prefix match
   leaves too few n-grams to reach what is required.
4. Exact verification counts distinct n-grams in every window that begins at a
   match, and keeps the best.

The items' n-grams are broadcast while they fit ``BROADCAST_BYTES``; beyond
that the documents' n-grams are joined with them in a shuffle.  Both ways give
the same rows.

Defined cases: null or empty texts match nothing and null or empty items are
ignored; rows with a null ``doc_id`` or items with a null ``item_id`` cannot be
named and are ignored by ``find_contamination`` (``drop_contaminated`` keeps
such documents); rows that share a ``doc_id`` are reported once, with the best
window of any; items that share an ``item_id`` count as one item with the
largest text; a text of any length is searched whole; n-grams of equal
document frequency are ranked by hash, and ties between windows go to the
earliest; repeated rows are searched once by text; other columns, whatever their
names, are left alone; empty tables give an empty result; an id that isn't a
number fails the cast to bigint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from keylattice.llm.shared import materialize
from keylattice.llm.textkit import U64, Words, shingles, signed, slices, words

N = 4
#: Share of an item's n-grams that a window must hold.
SHARE = 0.6
#: Bytes of item n-grams up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
SCHEMA = "doc_id bigint, item_id bigint, matched int, n_grams int, containment double, start_word int"
_HITS = "doc_id bigint, pos array<int>, gram array<bigint>"
_ITEM = "item_id bigint, words int, n int, gram bigint, at int"


def item_grams(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Every n-gram of every item, with its first position."""

    def run(batches):
        for b in slices(batches):
            w = words(b.column("text"))
            counts = w.counts
            for size in range(1, n + 1):
                h, first = shingles(w, size)
                item = w.doc_of()[first] if len(first) else first
                ok = np.minimum(counts[item], n) == size
                h, first, item = h[ok], first[ok], item[ok]
                t = pd.DataFrame({"item": item, "gram": signed(h), "at": first - w.first[item]}).drop_duplicates(["item", "gram"])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("item_id").take(pa.array(t["item"].to_numpy(np.int64))), pa.array(counts[t["item"].to_numpy(np.int64)], pa.int32()),
                        pa.array(np.full(len(t), size), pa.int32()), pa.array(t.gram.to_numpy(np.int64)), pa.array(t["at"].to_numpy(np.int64), pa.int32()),
                    ],
                    names=["item_id", "words", "n", "gram", "at"],
                )

    one = benchmark.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max("text").alias("text"))
    return one.mapInArrow(run, _ITEM)


def _doc_grams(w: Words, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    each = [shingles(w, s) for s in sizes]
    return np.concatenate([h for h, _ in each]), np.concatenate([p for _, p in each])


def _hits_broadcast(docs: DataFrame, grams: np.ndarray, sizes: list[int]) -> DataFrame:
    bits = 22
    maybe = np.zeros(1 << bits, bool)
    maybe[grams.view(np.uint64) >> U64(64 - bits)] = True
    known = docs.sparkSession.sparkContext.broadcast((np.sort(grams), np.packbits(maybe), sizes))

    def run(batches):
        have, packed, sizes = known.value
        maybe = np.unpackbits(packed).view(bool)
        for b in slices(batches):
            w = words(b.column("text"))
            h, p = _doc_grams(w, sizes)
            some = np.flatnonzero(maybe[h >> U64(64 - bits)])
            h, p = signed(h[some]), p[some]
            found = have[np.minimum(np.searchsorted(have, h), len(have) - 1)] == h
            h, p = h[found], p[found]
            if not len(h):
                continue
            doc = np.searchsorted(w.first, p, "right") - 1
            order = np.lexsort((h, p, doc))
            h, p, doc = h[order], p[order], doc[order]
            rows, begin = np.unique(doc, return_index=True)
            off = pa.array(np.append(begin, len(doc)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows)), pa.ListArray.from_arrays(off, pa.array(p - w.first[doc], pa.int32())), pa.ListArray.from_arrays(off, pa.array(h))],
                names=["doc_id", "pos", "gram"],
            )

    return docs.mapInArrow(run, _HITS)


def _hits_joined(docs: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """The same rows where the items' n-grams are too many to broadcast."""

    def run(batches):
        for b in slices(batches):
            w = words(b.column("text"))
            h, p = _doc_grams(w, sizes)
            doc = np.searchsorted(w.first, p, "right") - 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), b.column("mark").take(pa.array(doc)), pa.array(p - w.first[doc], pa.int32()), pa.array(signed(h))], names=["doc_id", "mark", "pos", "gram"])

    every = docs.withColumn("mark", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, mark bigint, pos int, gram bigint")
    hits = every.join(items.select("gram").distinct(), "gram", "left_semi").distinct()
    sorted_hits = hits.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("pos", "gram"))).alias("h"))
    return sorted_hits.select("doc_id", F.col("h.pos").alias("pos"), F.col("h.gram").alias("gram"))


def best_window(pos: np.ndarray, gram: np.ndarray, span: int) -> tuple[int, int]:
    """Most distinct n-grams whose positions lie within ``span`` of each other, and where the first such window begins."""
    order = np.argsort(pos, kind="stable")
    pos, gram = pos[order], gram[order]
    inside: dict[int, int] = {}
    best, at, left = 0, 0, 0
    for right in range(len(pos)):
        g = int(gram[right])
        inside[g] = inside.get(g, 0) + 1
        while pos[right] - pos[left] > span:
            h = int(gram[left])
            inside[h] -= 1
            if not inside[h]:
                del inside[h]
            left += 1
        if len(inside) > best:
            best, at = len(inside), int(pos[left])
    return best, at


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, share: float = SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for every document and item that it contains."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").selectExpr("cast(doc_id as bigint) doc_id", "text")
    items = materialize(item_grams(benchmark, n), "items")
    sizes = sorted(r[0] for r in items.select("n").distinct().collect())
    if not sizes:
        return spark.createDataFrame([], SCHEMA)
    if items.count() * 8 <= broadcast_bytes:
        grams = items.select("gram").distinct().toPandas()["gram"].to_numpy(np.int64)
        hits = _hits_broadcast(docs, grams, sizes)
    else:
        hits = _hits_joined(docs, items, sizes)
    hits = materialize(hits, "hits")

    # rarity order and necessary prefixes
    seen = hits.select(F.explode(F.array_distinct("gram")).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    ranked = items.join(seen, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    by_item = Window.partitionBy("item_id")
    ranked = ranked.select(
        "item_id", "words", "n", "gram",
        F.row_number().over(by_item.orderBy("df", "gram")).alias("rank"),
        F.count("*").over(by_item).alias("size"),
    ).withColumn("required", F.ceil(F.col("size") * F.lit(share) - F.lit(1e-9)))
    ranked = materialize(ranked, "ranked")
    prefix = ranked.where("rank <= size - required + 1")

    # candidates: the rarest prefix match of each pair, then the bounds
    rows = hits.withColumn("row", F.xxhash64("doc_id", "pos", "gram"))
    tokens = rows.select("doc_id", "row", F.explode(F.array_distinct("gram")).alias("gram"), F.size(F.array_distinct("gram")).alias("held"))
    candidates = (
        tokens.join(prefix, "gram")
        .groupBy("doc_id", "row", "item_id", "words", "n", "size", "required")
        .agg(F.min("rank").alias("first"), F.max("held").alias("held"))
        .where("held >= required and size - first + 1 >= required")
        .select("doc_id", "row", "item_id", F.col("words"), F.col("n"), F.col("size"), F.col("required"))
    )
    # exact verification over windows
    near = (
        candidates.join(rows.select("doc_id", "row", F.explode(F.arrays_zip("pos", "gram")).alias("h")), ["doc_id", "row"])
        .select("doc_id", "row", "item_id", "words", "n", "size", "required", F.col("h.pos").alias("pos"), F.col("h.gram").alias("gram"))
        .join(ranked.select("item_id", "gram"), ["item_id", "gram"], "left_semi")
        .groupBy("doc_id", "row", "item_id", "words", "n", "size", "required")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "gram"))).alias("h"))
        .where("size(h) >= required")
        .select("doc_id", "item_id", "words", "n", "size", "required", F.col("h.pos").alias("pos"), F.col("h.gram").alias("gram"))
    )

    def verify(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                m, at = best_window(np.array(r["pos"]), np.array(r["gram"]), r["words"] - r["n"])
                if m >= r["required"]:
                    out.append((r["doc_id"], r["item_id"], m, r["size"], m / r["size"], at))
            if out:
                a = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[0], pa.int64()), pa.array(a[1], pa.int64()), pa.array(a[2], pa.int32()), pa.array(a[3], pa.int32()), pa.array(a[4], pa.float64()), pa.array(a[5], pa.int32())],
                    names=["doc_id", "item_id", "matched", "n_grams", "containment", "start_word"],
                )

    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("matched"), "start_word")
    return near.mapInArrow(verify, SCHEMA).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kwargs) -> DataFrame:
    """The rows of documents that contain no item, with all their columns."""
    found = materialize(find_contamination(docs, benchmark, **kwargs).select(F.col("doc_id").alias("__hit")).distinct(), "contaminated")
    return docs.join(found, docs["doc_id"] == found["__hit"], "left_anti")


_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"
SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM (SELECT item_id, max(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)),
     sized AS (SELECT item_id, w, len(w) AS words, least(len(w), {N}) AS n FROM items WHERE len(w) > 0),
     igrams AS (
       SELECT DISTINCT item_id, words, n, array_to_string(w[i + 1 : i + n], ' ') AS g
       FROM (SELECT *, unnest(range(0, words - n + 1)) AS i FROM sized)),
     isize AS (SELECT item_id, words, n, count(*) AS size, ceil(count(*) * {SHARE} - 1e-9) AS required FROM igrams GROUP BY ALL),
     docs AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
     dgrams AS (
       SELECT doc_id, r, i AS pos, n, array_to_string(w[i + 1 : i + n], ' ') AS g
       FROM (SELECT doc_id, r, w, n, unnest(range(0, len(w) - n + 1)) AS i
             FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
     hits AS (SELECT doc_id, r, item_id, words, s.n, size, required, pos, g FROM dgrams JOIN igrams USING (n, g) JOIN isize s USING (item_id, words)),
     enough AS (SELECT * FROM hits QUALIFY count(*) OVER (PARTITION BY r, item_id) >= required),
     windows AS (
       SELECT a.doc_id, a.r, a.item_id, a.pos AS start_word, a.size, a.required, count(DISTINCT b.g) AS matched
       FROM enough a JOIN enough b ON a.r = b.r AND a.item_id = b.item_id AND b.pos BETWEEN a.pos AND a.pos + a.words - a.n
       GROUP BY ALL)
SELECT doc_id, item_id, matched::INT AS matched, size::INT AS n_grams, matched / size AS containment, start_word::INT AS start_word
FROM windows WHERE matched >= required
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start_word) = 1
"""

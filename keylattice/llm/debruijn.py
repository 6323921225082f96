"""Long repeated spans by De Bruijn compaction.

The edges of the graph are the corpus's token k-mers (``K`` = 51 words, so a
repeated edge is a repeated passage of more than 50 words); an edge leads from
its first K-1 words to its last K-1.  An edge is kept when it occurs at two
source coordinates or more.

1. One pass over the text counts anchors.  A k-mer's *anchor* is the smallest
   hash among its 15-grams; neighbouring k-mers mostly share it, so a text has one
   row for each run of k-mers with one anchor.  Equal k-mers have equal anchors.
2. A second pass emits the runs, which meet by anchor in the one large shuffle.
   Anchors that occur once are dropped: none of their k-mers repeats.  The rows
   of an anchor with more than ``HOT_ROWS`` of them (shared boilerplate) are dealt
   to several tasks by their content.
3. Runs with the same content and context are folded; their k-mers are counted,
   and each learns whether it is entered from, or left to, more than one edge:
   in a window for ordinary anchors, by an aggregation with partial sums and a
   join for hot ones.
4. Nonbranching paths compact: inside runs, and then through a join of the
   folded runs with all their source coordinates, which glues runs that follow
   each other in a source (a unitig).  Paths are cut where the graph branches
   or a source ends.
5. Source coordinates verify: a unitig's signature has its length and, of each
   run, the anchor and the outer edges (127 bits a place); with these it must
   occur at two or more coordinates.  Unitigs that follow each other in a document
   make one reported span.

A row of the result is a maximal stretch of a document in which every window of
K words occurs elsewhere (or again in the document): words ``start_word`` to
``end_word`` (exclusive), the number of unitigs, their smallest and largest
number of copies, and whether each of them is at its first coordinate.

Defined cases: null, empty and short texts have no edge; a text of any length is
read whole; rows with a null
``doc_id`` cannot be named and are left out; a row repeated with the same id
and text is one source, the same id with another text is another source; other
columns are left alone; ties between copies go to the smallest (doc_id,
start_word); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from keylattice.llm.shared import materialize
from keylattice.llm.textkit import U64, mix, shingles, signed, slices, words

K = 51
ANCHOR = 15
#: Bits of an edge's hash that it is told apart by, besides its 64-bit anchor.
EDGE_BITS = 63
#: Rows of an anchor beyond which several tasks share it.
HOT_ROWS = 200_000
SCHEMA = "doc_id bigint, start_word int, end_word int, unitigs int, min_copies bigint, max_copies bigint, first_copy boolean"
_RUNS = "anchor bigint, content bigint, doc_id bigint, at bigint, edges array<bigint>"
_PATHS = "anchor bigint, content bigint, paths array<struct<off:int,len:int,cut_in:boolean,cut_out:boolean,sig:bigint>>"


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """For each index, where the (leftmost) smallest of the ``width`` values from there on is."""
    at = np.arange(len(h))
    have = 1

    def merge(at: np.ndarray, step: int) -> np.ndarray:
        a, b = at[:-step], at[step:]
        return np.where(h[b] < h[a], b, a)

    while have * 2 <= width:
        at = merge(at, have)
        have *= 2
    return merge(at, width - have) if width > have else at


def runs_of_edges(texts: pa.Array, k: int = K, anchor: int = ANCHOR, bits: int = 31) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring k-mers with one anchor: text, first word, anchor hash, content hash, offsets into edges, edges.

    A run's edges have the edge before and the edge after it around them, 0 where the text ends.  An edge is the first ``bits`` bits of its hash, plus one."""
    w = words(texts)
    edge, s = shingles(w, k)
    if not len(s):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros(1, np.int64), np.zeros(0, np.int64)
    a = np.full(len(w.hashes), ~U64(0))
    h, p = shingles(w, anchor)
    a[p] = mix(h ^ U64(0x1234567))
    least = _smallest(a, k - anchor + 1)[s]
    begin = np.ones(len(s), bool)
    begin[1:] = (least[1:] != least[:-1]) | (s[1:] != s[:-1] + 1)
    fresh = np.ones(len(s) + 1, bool)
    fresh[1:-1] = s[1:] != s[:-1] + 1
    b = np.flatnonzero(begin)
    e = np.append(b[1:], len(s)) - 1
    wide = np.zeros(len(s) + 2, np.int64)
    wide[1:-1] = np.minimum(edge >> U64(64 - bits), U64(2**63 - 2)).astype(np.int64) + 1
    before = np.where(fresh[b], 0, wide[b])
    after = np.where(fresh[e + 1], 0, wide[e + 2])
    content = mix(edge[b] + mix(edge[e] * U64(3) + mix(before.astype(U64) * U64(0x9E3779B97F4A7C15) + mix(after.astype(U64) + U64(1 << 40)))))
    size = e - b + 3
    off = np.append(0, np.cumsum(size))
    edges = wide[np.arange(off[-1]) + np.repeat(b - off[:-1], size)]
    edges[off[:-1]], edges[off[1:] - 1] = before, after
    text = np.searchsorted(w.first, s[b], "right") - 1
    return text, s[b] - w.first[text], signed(a[least[b]]), signed(content), off, edges


def _runs(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            text, start, anchor, content, off, edges = runs_of_edges(b.column("text"), bits=EDGE_BITS)
            mark = b.column("mark").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor), pa.array(content), b.column("doc_id").take(pa.array(text)), pa.array((mark[text] << 32) + start),
                    pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(edges)),
                ],
                names=["anchor", "content", "doc_id", "at", "edges"],
            )

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("mark"))
    return rows.mapInArrow(run, _RUNS)


def _anchors(docs: DataFrame) -> DataFrame:
    """(anchor, n): how many runs each anchor has."""

    def run(batches):
        held, size = [], 0
        for b in slices(batches):
            held.append(np.unique(runs_of_edges(b.column("text"))[2], return_counts=True))
            size += len(held[-1][0])
            if size > _HELD:
                yield _counted(held)
                held, size = [], 0
        if held:
            yield _counted(held)

    return docs.where("doc_id is not null").select("text").mapInArrow(run, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    anchor, which = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
    n = np.bincount(which, np.concatenate([n for _, n in held]), minlength=len(anchor)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "n"])


#: Anchors that a task holds before it hands their counts on.
_HELD = 1 << 20
_KIND = pa.list_(pa.struct([("off", pa.int32()), ("len", pa.int32()), ("cut_in", pa.bool_()), ("cut_out", pa.bool_()), ("sig", pa.int64())]))


def _paths(batches):
    """Cut each run's repeated edges where the graph branches."""
    for b in batches:
        flags = b.column("flags")
        flat = flags.flatten()
        row = np.repeat(np.arange(b.num_rows), np.diff(flags.offsets.to_numpy()))
        get = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
        order = np.lexsort((get("i"), row))
        row, i, edge, cut_in, cut_out = (x[order] for x in (row, get("i"), get("edge"), get("cut_in").astype(bool), get("cut_out").astype(bool)))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1] + 1) | cut_out[:-1] | cut_in[1:]
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(row)) - 1 if len(begin) else begin
        own, size = row[begin], last - begin + 1
        parts = [b.column("anchor").to_numpy()[own], size, edge[begin], edge[last]]
        sig = np.zeros(len(begin), U64)
        for x in parts:
            sig = mix(sig * U64(0x9E3779B97F4A7C15) + x.astype(np.int64).view(U64) + U64(1))
        paths = pa.StructArray.from_arrays(
            [pa.array(i[begin], pa.int32()), pa.array(size, pa.int32()), pa.array(cut_in[begin]), pa.array(cut_out[last]), pa.array(signed(sig >> U64(1)))], names=["off", "len", "cut_in", "cut_out", "sig"]
        )
        cuts = pa.array(np.searchsorted(own, np.arange(b.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("anchor"), b.column("content"), pa.ListArray.from_arrays(cuts, paths).cast(_KIND)], names=["anchor", "content", "paths"])


def _known(folded: DataFrame, hot: bool) -> DataFrame:
    """The repeated edges of folded runs, and whether the graph branches in front of and behind them."""
    each = folded.select("anchor", "content", "c", "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 3)).alias("i"))
    each = each.selectExpr("anchor", "content", "c", "i", "edges[i] before", "edges[i + 1] edge", "edges[i + 2] after")
    n, cut_in, cut_out = F.sum("c"), lambda w: w(F.min("before")) != w(F.max("before")), lambda w: w(F.min("after")) != w(F.max("after"))
    if hot:
        plain = lambda c: c
        stats = each.groupBy("anchor", "edge").agg(n.alias("n"), cut_in(plain).alias("cut_in"), cut_out(plain).alias("cut_out")).where("n > 1")
        return each.select("anchor", "content", "i", "edge").join(stats, ["anchor", "edge"])
    same = Window.partitionBy("anchor", "edge")
    over = lambda c: c.over(same)
    return each.select("anchor", "content", "i", "edge", n.over(same).alias("n"), cut_in(over).alias("cut_in"), cut_out(over).alias("cut_out")).where("n > 1")


def repeated_spans(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every long repeated span of every document."""
    # anchors beyond the bound: at most one for each ``hot_rows`` rows
    hot = materialize(_anchors(docs).where(F.col("n") > hot_rows).select("anchor", F.ceil(F.col("n") / hot_rows).alias("shares")), "hot")
    dealt = hot.limit(1).count() > 0
    runs = _runs(docs)
    if dealt:
        runs = runs.join(F.broadcast(hot), "anchor", "left").withColumn("share", F.when(F.col("shares").isNotNull(), F.pmod(F.col("content"), F.col("shares"))).otherwise(F.lit(-1)).cast("int")).drop("shares")
    else:
        runs = runs.withColumn("share", F.lit(-1))
    at = ["anchor", "share"] if dealt else ["anchor"]
    once = Window.partitionBy(*at, "content", "doc_id", "at").orderBy("at")
    met = (
        runs.repartition(*at)
        .withColumn("_n", F.row_number().over(once)).where("_n = 1")
        .withColumn("_c", F.count("*").over(Window.partitionBy(*at))).where("_c > 1 or share >= 0")
        .drop("_n", "_c")
    )
    met = materialize(met, "met")

    fold = lambda d: d.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.first("edges").alias("edges"))
    known = _known(fold(met.where("share < 0").repartition("anchor")), hot=False).select("anchor", "content", "i", "edge", "cut_in", "cut_out")
    if dealt:
        known = known.union(_known(fold(met.where("share >= 0")), hot=True).select("anchor", "content", "i", "edge", "cut_in", "cut_out"))
    compact = known.groupBy("anchor", "content").agg(F.collect_list(F.struct("i", "edge", "cut_in", "cut_out")).alias("flags")).mapInArrow(_paths, _PATHS)

    placed = met.select("anchor", "content", "doc_id", "at").join(compact, ["anchor", "content"])
    placed = placed.select("doc_id", F.shiftright("at", 32).alias("mark"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("start"), F.explode("paths").alias("p"))
    placed = placed.select("doc_id", "mark", (F.col("start") + F.col("p.off")).alias("start"), "p.len", "p.cut_in", "p.cut_out", "p.sig")

    order = Window.partitionBy("doc_id", "mark").orderBy("start")
    end = F.lag(F.col("start") + F.col("len")).over(order)
    glued = placed.select(
        "doc_id", "mark", "start", "len", "sig",
        F.coalesce((end != F.col("start")), F.lit(True)).alias("new_span"),
        F.coalesce((end != F.col("start")) | F.lag("cut_out").over(order) | F.col("cut_in"), F.lit(True)).alias("new"),
    )
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    glued = glued.select("doc_id", "mark", "start", "len", "sig", F.sum(F.col("new_span").cast("int")).over(upto).alias("span"), F.sum(F.col("new").cast("int")).over(upto).alias("path"))
    glued = glued.withColumn("from", F.min("start").over(Window.partitionBy("doc_id", "mark", "path")))
    unitigs = glued.groupBy("doc_id", "mark", "span", "path").agg(
        F.min("start").alias("start"), F.sum("len").alias("len"), F.expr("bit_xor(xxhash64(sig, start - `from`))").alias("sig")
    )
    unitigs = materialize(unitigs, "unitigs")
    # partial counts first, then a join: a unitig that a third of all documents share gathers in no task
    where = F.struct("doc_id", "start", "mark")
    sources = unitigs.groupBy("sig", "len").agg(F.count("*").alias("copies"), F.min(where).alias("lead")).where("copies > 1")
    verified = unitigs.join(sources, ["sig", "len"]).select("doc_id", "mark", "span", "start", "len", "copies", (where == F.col("lead")).alias("first"))
    return verified.groupBy("doc_id", "mark", "span").agg(
        F.min("start").cast("int").alias("start_word"), F.max(F.col("start") + F.col("len") + (K - 1)).cast("int").alias("end_word"),
        F.count("*").cast("int").alias("unitigs"), F.min("copies").alias("min_copies"), F.max("copies").alias("max_copies"), F.bool_and("first").alias("first_copy"),
    ).drop("mark", "span")


_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+')"
SQL = f"""
WITH src AS MATERIALIZED (
       SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS r, {_WORDS} AS w
       FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)),
     edges AS MATERIALIZED (
       SELECT doc_id, r, i AS pos, md5_number(array_to_string(w[i + 1 : i + {K}], ' ')) AS e,
              CASE WHEN i > 0 THEN w[i] ELSE '' END AS before, coalesce(w[i + {K} + 1], '') AS after
       FROM (SELECT doc_id, r, w, unnest(range(0, len(w) - {K - 1})) AS i FROM src WHERE len(w) >= {K})),
     stats AS (
       SELECT e, count(*) AS n, min(before) <> max(before) AS cut_in, min(after) <> max(after) AS cut_out,
              min(struct_pack(d := doc_id, p := pos, r := r)) AS lead
       FROM edges GROUP BY e HAVING count(*) > 1),
     known AS (
       SELECT doc_id, r, pos, n, cut_in, cut_out, lead = struct_pack(d := doc_id, p := pos, r := r) AS is_first
       FROM edges JOIN stats USING (e)),
     marked AS (
       SELECT *, coalesce(lag(pos) OVER o <> pos - 1, true) AS new_span,
              coalesce(lag(pos) OVER o <> pos - 1 OR lag(cut_out) OVER o OR cut_in, true) AS new_path
       FROM known WINDOW o AS (PARTITION BY r ORDER BY pos)),
     spans AS (SELECT *, sum(new_span::int) OVER (PARTITION BY r ORDER BY pos) AS span FROM marked)
SELECT doc_id, min(pos)::INT AS start_word, (max(pos) + {K})::INT AS end_word, sum(new_path::int)::INT AS unitigs,
       min(n) AS min_copies, max(n) AS max_copies, bool_and(is_first) AS first_copy
FROM spans GROUP BY doc_id, r, span
"""

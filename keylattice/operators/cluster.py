"""Grouping units into size-capped clusters, and views of the cluster graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from keylattice.functions import ids, vocab

BASE, CEILING = 400, 8000
SHARE, LEAST = 0.03, 50


def prior_of(tokens: Column | str) -> Column:
    """The largest prior of a token array."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    table = F.create_map(*(F.lit(x) for kv in vocab.PRIOR.items() for x in kv))
    return F.coalesce(F.array_max(F.transform(t, lambda x: F.coalesce(table[x], F.lit(vocab.DEFAULT_PRIOR)))), F.lit(vocab.DEFAULT_PRIOR))


def radar_range(tokens: Column | str) -> Column:
    return F.least(F.lit(CEILING), F.floor(BASE * (1 + 2 * prior_of(tokens)) + 1e-9)).cast("int")


def islands(units: DataFrame) -> DataFrame:
    """Gaps and islands: within a file, a unit starts a new island when it begins beyond the reach of all before it."""
    order = Window.partitionBy("file").orderBy("line_start", "seq")
    reach = F.max(F.col("line_start") + F.col("radar")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    u = units.withColumn("radar", radar_range("tokens")).withColumn("_new", F.when(F.col("line_start") <= reach, 0).otherwise(1))
    return u.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def cap_of(n: int, share: float = SHARE) -> int:
    return max(LEAST, int(n * share))


def island_clusters(units: DataFrame, cap: int | None = None) -> DataFrame:
    """The first ``cap`` units of an island are one cluster, each further one is its own; root is the cluster's first unit."""
    n = F.row_number().over(Window.partitionBy("file", "island").orderBy("line_start", "seq"))
    i = islands(units)
    if cap is None:
        size = F.broadcast(units.agg(F.greatest(F.lit(LEAST), F.floor(F.count("*") * F.lit(SHARE))).alias("_cap")))
        i = i.crossJoin(size)
    else:
        i = i.withColumn("_cap", F.lit(cap))
    i = i.withColumn("_n", n)
    first = F.first("unit_id").over(Window.partitionBy("file", "island").orderBy("line_start", "seq"))
    return i.withColumn("root", F.when(F.col("_n") <= F.col("_cap"), first).otherwise(F.col("unit_id"))).drop("_n", "_cap")


def unit_degree(edges: DataFrame) -> DataFrame:
    return _ends(edges, "source_id", "target_id", "unit_id").groupBy("unit_id").agg(F.count("*").alias("degree"))


def _ends(edges: DataFrame, source: str, target: str, name: str) -> DataFrame:
    """Both ends of every edge; edges are read (and so made) once, which a union of two selections would not do."""
    return edges.select(F.explode(F.array(source, target)).alias(name))


def dominant_tokens(members: DataFrame, key: str = "root", top: int = 5) -> DataFrame:
    """The most frequent tokens of each group, ties by first encounter (seq, then place in the unit)."""
    each = members.select(key, "seq", F.posexplode("tokens").alias("pos", "token"))
    counted = each.groupBy(key, "token").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("dominant"))


def cluster_build(members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a cluster: size, files, dominant tokens, degree, probability, hardness. edges: or their ends counted by root, in one row a root or in several (``match.edges_and_ends``).

    Members and ends are brought together by root, once, and summed up there."""
    if "degree" in edges.columns:
        degree = edges
    elif "source_root" in edges.columns:
        degree = _ends(edges, "source_root", "target_root", "root").groupBy("root").agg(F.count("*").alias("degree"))
    else:
        degree = members.join(unit_degree(edges), "unit_id").groupBy("root").agg(F.sum("degree").alias("degree"))
    ends = [c for c in degree.columns if c != "root"]
    rows = members.select("root", F.lit(True).alias("unit"), "file", "seq", "tokens").unionByName(degree.where("root is not null").withColumn("unit", F.lit(False)), allowMissingColumns=True)
    kinds = ", ".join(f"{c} {k}" for c, k in (("root", members.schema["root"].dataType.simpleString()), ("size", "bigint"), ("files", "bigint"), ("dominant", "array<string>"), ("prior", "double"), *((c, "bigint") for c in ends)))
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = rows.repartition(tasks, "root").sortWithinPartitions("root", "seq").mapInArrow(_summed(ends), kinds).na.fill(0, ["degree"])
    boost = F.least(F.lit(0.3), 0.05 * F.col("degree")) + F.when(F.col("files") > 1, 0.1).otherwise(0.0) + F.least(F.lit(0.1), 0.01 * F.col("size"))
    c = c.withColumn("probability", F.round(F.least(F.lit(1.0), F.col("prior") + boost), 4)).drop("prior")
    return c.withColumns({"is_hard": (F.col("probability") >= 0.85) & (F.col("size") >= 2), "is_cross_file": F.col("files") > 1, "cluster_id": ids.cluster_id("root")})


#: Rows that are summed up at once.
ROWS = 16_384


def _summed(ends: list[str], top: int = 5) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow``: size, files, ``dominant_tokens``, their ``prior_of`` and sums of ends of each root, from rows of units and of ends that are sorted by root and ``seq``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for x in batches:
            held.append(x)
            size += x.num_rows
            if size < ROWS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            new = _new_roots(t)
            if len(new) == 1:  # its end is not known yet
                held = t.to_batches()
                continue
            yield _sum_up(t.slice(0, new[-1]), ends, top)
            held, size = t.slice(new[-1]).to_batches(), t.num_rows - int(new[-1])
        if size:
            yield _sum_up(pa.Table.from_batches(held).combine_chunks(), ends, top)

    return run


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """A code for each value, -1 for null, and how many there are."""
    c = column.combine_chunks().dictionary_encode()
    return c.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(c.dictionary)


def _new_roots(t: pa.Table) -> np.ndarray:
    root = _codes(t.column("root"))[0]
    return np.flatnonzero(np.append(True, root[1:] != root[:-1]))


def _sum_up(t: pa.Table, ends: list[str], top: int) -> pa.RecordBatch:
    new, unit = _new_roots(t), t.column("unit").to_numpy()
    n, of = len(new), np.repeat(np.arange(len(new)), np.diff(np.append(new, t.num_rows)))
    size = np.bincount(of[unit], minlength=n)
    file, most = _codes(t.column("file"))
    files = np.bincount(np.unique((of * max(most, 1) + file)[unit & (file >= 0)]) // max(most, 1), minlength=n)
    tokens = t.column("tokens").combine_chunks()
    value, parent = tokens.flatten().dictionary_encode(null_encoding="encode"), pa.compute.list_parent_indices(tokens).to_numpy()
    kinds = max(len(value.dictionary), 1)
    # rows are sorted by seq and tokens by place, so the first index is the first encounter
    key, first, count = np.unique(of[parent] * kinds + value.indices.to_numpy(), return_index=True, return_counts=True)
    order = np.lexsort((first, -count, key // kinds))
    held = np.bincount(key // kinds, minlength=n)
    best = order[np.arange(len(key)) - np.repeat(np.cumsum(held) - held, held) < top]
    offsets = np.append(0, np.cumsum(np.minimum(held, top))).astype(np.int32)
    some = held > 0
    dominant = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~some, False)), value.dictionary.take(pa.array(key[best] % kinds)))
    prior = np.full(n, vocab.DEFAULT_PRIOR)
    if len(best):
        each = np.array([vocab.PRIOR.get(v, vocab.DEFAULT_PRIOR) for v in value.dictionary.to_pylist()])[key[best] % kinds]
        prior[some] = np.maximum.reduceat(each, offsets[:-1][some])
    sums = []
    for c in ends:
        x = t.column(c).combine_chunks()
        known = x.is_valid().to_numpy(zero_copy_only=False)
        sums.append(pa.array(np.add.reduceat(x.fill_null(0).to_numpy(zero_copy_only=False), new), mask=~np.logical_or.reduceat(known, new)))
    out = [t.column("root").combine_chunks().take(pa.array(new)), pa.array(size), pa.array(files), dominant, pa.array(prior), *sums]
    return pa.RecordBatch.from_arrays(out, ["root", "size", "files", "dominant", "prior", *ends]).filter(pa.array(size > 0))


def infer_role(dominant: Column | str) -> Column:
    d = F.col(dominant) if isinstance(dominant, str) else dominant
    rules = F.coalesce(*(F.when(F.size(F.array_except(F.array(*map(F.lit, need.split())), d)) == 0, role) for need, role in vocab.ROLES), F.lit("General Logic"))
    return F.when(F.element_at(d, 1) == "TEST", "Test Suite").otherwise(rules)


def cluster_type(size: Column, boundary: Column) -> Column:
    return F.when(boundary, "boundary").when(size < 3, "utility").when(size < 10, "component").when(size < 50, "module").otherwise("subsystem")


def is_test_cluster(dominant: Column, name: Column, files: Column) -> Column:
    """Whether a cluster is about tests: by its first token, its name, or all of its files."""
    shaped = lambda c: F.lower(c).contains("test") | F.lower(c).contains("benchmark")
    first = F.coalesce(F.try_element_at(dominant, F.lit(1)), F.lit(""))
    return (first == "TEST") | shaped(name) | ((F.size(files) > 0) & F.forall(files, shaped))


def token_distribution(units: DataFrame) -> DataFrame:
    """How often each token is on a unit or its class, repeats counted."""
    none = F.array().cast("array<string>")
    return units.select(F.explode(F.concat(F.coalesce("tokens", none), F.coalesce("class_context", none))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def seam_units(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Units with an edge into another cluster."""
    return _ends(cluster_edges(edges, members), "source_id", "target_id", "unit_id").distinct()


def cluster_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between different clusters, with both clusters; edges that carry their ends' roots need no join."""
    if "source_root" in edges.columns:
        return edges.where("source_root <> target_root").withColumnsRenamed({"source_root": "source_cluster", "target_root": "target_cluster"})
    m = members.select("unit_id", "root")
    s, t = m.toDF("source_id", "source_cluster"), m.toDF("target_id", "target_cluster")
    return edges.join(s, "source_id").join(t, "target_id").where("source_cluster <> target_cluster")


def _pair_counts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Directed cluster pairs with edge count, largest confidence, and counts by (key, lock, type): at most 42 of those a pair, so the list is bounded."""
    keys = ["source_cluster", "target_cluster"]
    fine = cluster_edges(edges, members).groupBy(*keys, "key_token", "lock_token", "edge_type").agg(F.count("*").alias("n"), F.max("confidence").alias("c"))
    kinds = F.collect_list(F.struct("key_token", "lock_token", "edge_type", "n")).alias("kinds")
    return fine.groupBy(*keys).agg(F.sum("n").alias("edge_count"), F.round(F.max("c"), 4).alias("max_confidence"), kinds)


def _mode_of(kinds: Column | str, value: Callable[[Column], Column]) -> Column:
    """The value with the largest sum of counts; ties go to the smallest value."""
    k = F.col(kinds) if isinstance(kinds, str) else kinds
    total = lambda v: F.aggregate(F.filter(k, lambda x: value(x) == v), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    ranked = F.transform(F.array_distinct(F.transform(k, value)), lambda v: F.struct((-total(v)).alias("n"), v.alias("v")))
    return F.array_min(ranked)["v"]


def cluster_graph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Directed cluster pairs: weight, largest confidence, most frequent key and lock (each by itself; ties alphabetical)."""
    return _pair_counts(edges, members).select(
        "source_cluster", "target_cluster", F.col("edge_count").alias("weight"), "max_confidence",
        _mode_of("kinds", lambda x: x["key_token"]).alias("key_token"), _mode_of("kinds", lambda x: x["lock_token"]).alias("lock_token"),
    )


def seam_bundles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Directed cluster pairs with edge count, largest confidence, most frequent type and pair."""
    return _pair_counts(edges, members).select(
        "source_cluster", "target_cluster", "edge_count", "max_confidence", _mode_of("kinds", lambda x: x["edge_type"]).alias("edge_type"),
        _mode_of("kinds", lambda x: F.concat_ws("->", x["key_token"], x["lock_token"])).alias("pair"),
    )


def file_seams(edges: DataFrame) -> DataFrame:
    """Directed pairs of clusters with edge count and both files, where a cluster lies in one file (as islands do) and edges carry roots and files."""
    return cluster_edges(edges, edges).groupBy("source_cluster", "target_cluster", "source_file", "target_file").agg(F.count("*").alias("edge_count"))


def cross_edge_names(edges: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """Named cluster pairs by (key, lock): count and best type, lifecycle pairs and equal names left out."""
    e = cluster_edges(edges, members).where(~F.col("key_token").isin("INIT", "TEARDOWN") & ~F.col("lock_token").isin("INIT", "TEARDOWN"))
    if "source_name" not in edges.columns:
        s = names.select(F.col("root").alias("source_cluster"), F.col("name").alias("source_name"))
        t = names.select(F.col("root").alias("target_cluster"), F.col("name").alias("target_name"))
        e = e.join(s, "source_cluster").join(t, "target_cluster")
    e = e.where("source_name <> target_name")
    return e.groupBy("source_name", "target_name", "key_token", "lock_token").agg(F.count("*").alias("n"), F.when(F.bool_or(F.col("edge_type") == "HARD"), "HARD").otherwise("PREDICTED").alias("best_type"))


def cluster_names(members: DataFrame) -> DataFrame:
    """The commonest class of a cluster's members (ties to the one met first), else the title-cased stem of its first file, else its id."""
    with_class = members.where("cls is not null").groupBy("root", "cls").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = with_class.withColumn("_r", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("n"), "first"))).where("_r = 1").select("root", "cls")
    file = members.groupBy("root").agg(F.min_by("file", "seq").alias("file"))
    stem = F.initcap(F.regexp_replace(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1), "[_-]", " "))
    return file.join(best, "root", "left").select("root", F.coalesce("cls", F.when(stem != "", stem), F.substring(ids.cluster_id("root"), 1, 30)).alias("name"))


def components(edges: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) over edges (a, b): the smallest node that is reachable.

    Smallest-neighbour propagation with label jumps, a logarithmic number of
    rounds on long paths; ``save`` cuts the lineage of each round (a checkpoint
    or a written table)."""
    both = save(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        closer = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("to"))
        after = save(closer.join(jump, closer["near"] == jump["via"], "left").select("node", F.least("near", "to").alias("next"), "label"))
        labels = after.select("node", F.col("next").alias("label"))
        if not after.where("next <> label").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def replay(pdf: pd.DataFrame, cap: int) -> tuple[dict, list]:
    """Unions refused beyond a size, by (phase, ord); the larger side's root wins, the left one's at a tie."""
    if len(pdf) and isinstance(pdf["ord"].iloc[0], dict):  # a struct sorts by its fields in turn
        pdf = pdf.assign(ord=[tuple(o.values()) for o in pdf["ord"]])
    return _replay(pdf.sort_values(["phase", "ord"]), cap)


def _replay(pdf: pd.DataFrame, cap: int) -> tuple[dict, list]:
    """The same over unions in order."""
    parent, size, refused = {}, {}, []

    def find(x):
        parent.setdefault(x, x)
        size.setdefault(x, 1)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in pdf.itertuples():
        x, y = find(r.a), find(r.b)
        if x == y:
            continue
        if size[x] + size[y] > cap:
            if r.phase == 2:
                refused.append((x, y, r.a, r.b, r.confidence, size[x] + size[y]))
            continue
        if size[x] < size[y]:
            x, y = y, x
        parent[y] = x
        size[x] += size[y]
    return {n: find(n) for n in parent}, refused


#: Unions that a local forest is grown over, and that are replayed at once.
PIECE = 100_000


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece of unions with the root of its ends in the piece's own forest, and whether an end is met there for the first time."""
    held: list[pa.RecordBatch] = []
    for x in batches:
        held.append(x)
        if sum(h.num_rows for h in held) >= PIECE:
            yield from _grow(pa.Table.from_batches(held))
            held = []
    if held:
        yield from _grow(pa.Table.from_batches(held))


def _grow(t: pa.Table) -> list[pa.RecordBatch]:
    ends = pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks], pa.string()).combine_chunks()
    coded = (ends.combine_chunks() if isinstance(ends, pa.ChunkedArray) else ends).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    up, n = list(range(len(coded.dictionary))), t.num_rows

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x, y in zip(codes[:n].tolist(), codes[n:].tolist()):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    first = np.zeros(2 * n, bool)
    first[np.unique(codes, return_index=True)[1]] = True
    t = t.append_column("new_a", pa.array(first[:n])).append_column("new_b", pa.array(first[n:]))
    return t.append_column("local", coded.dictionary.take(pa.array([find(x) for x in codes[:n].tolist()], pa.int64()))).combine_chunks().to_batches()


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in frames:
        if len(pdf):
            held.append(pdf)
            n += len(pdf)
        if n >= PIECE:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _whole_components(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by component in pieces that no component's rows are split between."""
    held = None
    for pdf in _pieces(frames):
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = int((pdf["component"] == pdf["component"].iloc[-1]).to_numpy().argmax())
        if last:
            yield pdf.iloc[:last]
        held = pdf.iloc[last:]
    if held is not None:
        yield held


def capped_components(unions: DataFrame, cap: int, save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Membership (unit_id, root) and refused merges of an ordered union sequence (phase, ord, a, b, confidence).

    Ordinary components bound what a refusal can influence, so components are
    replayed apart from one another, many in a task; their sizes follow the
    data's components and not the table.  A forest is grown over each piece of
    the unions where it lies; only roots that several pieces' forests share are
    put together by rounds of joins, and the unions are shuffled once."""
    unions = unions.where("a is not null and b is not null")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in unions.schema)
    grown = save(unions.mapInArrow(_local_roots, f"{schema}, new_a boolean, new_b boolean, local string"))
    # a node once for each piece, however many unions it has there
    nodes = grown.where("new_a or new_b").select(F.explode(F.filter(F.array(F.when(F.col("new_a"), F.col("a")), F.when(F.col("new_b"), F.col("b"))), lambda x: x.isNotNull())).alias("node"), "local")
    ends = nodes.groupBy("node").agg(F.min("local").alias("a"), F.max("local").alias("z"))
    # a node that lies in several forests links their roots
    split = ends.where("a <> z").select("node", "a")
    links = save(nodes.select("node", F.col("local").alias("b")).join(split, "node").where("a <> b").select("a", "b").distinct())
    if links.limit(1).count():
        keyed = grown.join(components(links, save).withColumnRenamed("node", "local"), "local", "left").withColumn("component", F.coalesce("component", "local"))
    else:
        keyed = grown.withColumn("component", F.col("local"))
    tasks = int(unions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.select("component", "phase", "ord", "a", "b", "confidence").repartition(tasks, "component").sortWithinPartitions("component", "phase", "ord").drop("ord")

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_components(frames):
            yield pd.DataFrame(list(_replay(pdf, cap)[0].items()), columns=["unit_id", "root"])

    def refusals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_components(frames):
            yield pd.DataFrame(_replay(pdf, cap)[1], columns=["from_root", "to_root", "trigger_source", "trigger_target", "confidence", "refused_at_size"])

    return (
        keyed.mapInPandas(members, "unit_id string, root string"),
        keyed.mapInPandas(refusals, "from_root string, to_root string, trigger_source string, trigger_target string, confidence double, refused_at_size int"),
    )


def merge_sequence(members: DataFrame, edges: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """The ordered unions: islands (phase 0), then imports (1), then HARD edges in edge order (2).

    ``ord`` is a struct that sorts within a phase, so no row needs a number over the whole table."""
    key = lambda n, *c: F.struct(n.cast("bigint").alias("n"), *(F.col(x).alias(f"k{i}") for i, x in enumerate(c)), *(F.lit("").alias(f"k{i}") for i in range(len(c), 3))).alias("ord")
    isl = members.where("root <> unit_id").select(F.lit(0).alias("phase"), key(F.col("seq")), F.col("root").alias("a"), F.col("unit_id").alias("b"), F.lit(1.0).alias("confidence"))
    hard = edges.select(F.lit(2).alias("phase"), key(F.lit(0), "source_id", "target_id", "key_token"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), "confidence")
    out = isl.unionByName(hard)
    return out if imports is None else out.unionByName(imports)


def import_merges(files: DataFrame, imports: DataFrame, cycles: DataFrame) -> DataFrame:
    """First unit of each importing and imported file, import cycles left out."""
    first = files.groupBy("file").agg(F.min_by("unit_id", "seq").alias("unit_id"))
    open_ = imports.join(cycles.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(cycles.select(F.col("b").alias("src"), F.col("a").alias("dst"))), ["src", "dst"], "left_anti")
    s, t = first.toDF("src", "a"), first.toDF("dst", "b")
    order = F.struct(F.lit(0).cast("bigint").alias("n"), F.col("src").alias("k0"), F.col("dst").alias("k1"), F.lit("").alias("k2"))
    return open_.join(s, "src").join(t, "dst").select(F.lit(1).alias("phase"), order.alias("ord"), "a", "b", F.lit(1.0).alias("confidence"))

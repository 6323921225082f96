"""Traversals and neighbourhoods over unit graphs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def mutual_edges(edges: DataFrame) -> DataFrame:
    """Pairs (a < b) with an edge in both directions."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def impact_neighbors(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(unit_id, distance) within ``depth`` undirected hops of the seeds; frontier joins, each node once."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = seeds.select("unit_id").distinct().withColumn("distance", F.lit(0))
    frontier = seen.select("unit_id")
    for d in range(1, depth + 1):
        frontier = frontier.join(both, F.col("unit_id") == F.col("src")).select(F.col("dst").alias("unit_id")).distinct().join(seen, "unit_id", "left_anti")
        seen = seen.union(frontier.withColumn("distance", F.lit(d)))
    return seen


def behavioral_twins(units: DataFrame, tokens: Column, top: int = 3, least: float = 0.25) -> DataFrame:
    """Units by Jaccard similarity of their token set with a given one."""
    t = F.array_distinct("tokens")
    n = F.size(F.array_intersect(t, tokens))
    score = n / F.size(F.array_union(t, tokens))
    return units.select("unit_id", F.round(score, 4).alias("score"), n.alias("shared"), "confidence").where(F.col("score") >= least).orderBy(F.desc("score"), F.desc("shared"), F.desc("confidence"), F.desc("unit_id")).limit(top)


def gate_twins(n: Column, task: Column, best: Column) -> Column:
    return (
        F.when((n == 0) | (task < 0.25) | (best < 0.25), "none").when((best >= 0.7) & (task >= 0.55), "high")
        .when((best >= 0.5) & (task >= 0.45), "medium").when(best >= 0.35, "low").otherwise("none")
    )


def resolve_seeds(units: DataFrame, query: str) -> DataFrame:
    """Units that a query names: by id, else by file, else by symbol, else by substring; the first kind that finds any."""
    q = query.lower()
    kind = F.when(F.col("unit_id") == query, 0).when(F.col("file") == query, 1).when(F.lower("unit_id").endswith(f"::{q}"), 2).when(F.lower("unit_id").contains(q), 3)
    k = units.withColumn("kind", kind).where("kind is not null")
    best = k.agg(F.min("kind").alias("best"))
    return k.join(F.broadcast(best), F.col("kind") == F.col("best")).select("unit_id", "kind")


def louvain(edges: DataFrame, save: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """(node, community): one deterministic level of local moves that raise modularity, component by component.

    A seeded library run can't be reproduced elsewhere; this visits nodes in
    order and breaks ties by the smallest community."""
    from keylattice.operators.cluster import components

    e = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight")).where("a <> b")
    comp = components(e, save)
    total = e.agg(F.sum("weight").alias("m"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(set(pdf.a) | set(pdf.b))
        at = {n: i for i, n in enumerate(nodes)}
        near: list[dict[int, float]] = [{} for _ in nodes]
        for a, b, w in zip(pdf.a, pdf.b, pdf.weight):
            near[at[a]][at[b]] = near[at[b]][at[a]] = float(w)
        k = np.array([sum(x.values()) for x in near])
        own, tot, m = list(range(len(nodes))), k.copy(), float(pdf.m.iloc[0])
        for _ in range(rounds):
            moved = False
            for i in range(len(nodes)):
                w: dict[int, float] = {}
                for j, x in near[i].items():
                    w[own[j]] = w.get(own[j], 0.0) + x
                tot[own[i]] -= k[i]
                best = max(sorted({own[i], *w}), key=lambda c: (round(w.get(c, 0.0) - tot[c] * k[i] / (2 * m), 12), c == own[i], -c))
                tot[best] += k[i]
                moved |= best != own[i]
                own[i] = best
            if not moved:
                break
        first = {}
        for n, c in zip(nodes, own):
            first.setdefault(c, n)
        return pd.DataFrame({"node": nodes, "community": [first[c] for c in own]})

    kind = e.schema["a"].dataType.simpleString()
    return e.join(comp.withColumnRenamed("node", "a"), "a").crossJoin(F.broadcast(total)).groupBy("component").applyInPandas(run, f"node {kind}, community {kind}")


def suggest_seam(members: DataFrame, seams: DataFrame, twin: str) -> DataFrame:
    """For a twin: its cluster and the strongest seam that leaves it."""
    c = members.where(F.col("unit_id") == twin).select("root")
    best = Window.partitionBy("source_cluster").orderBy(F.desc("edge_count"), F.desc("max_confidence"), "target_cluster")
    return c.join(seams, F.col("root") == F.col("source_cluster")).withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "root")


def seams_for(clusters: DataFrame, seams: DataFrame) -> DataFrame:
    """Seams that touch any of the clusters, on either side, each once."""
    c = clusters.select(F.col("root")).distinct()
    left = seams.join(c, seams["source_cluster"] == c["root"], "left_semi")
    right = seams.join(c, seams["target_cluster"] == c["root"], "left_semi")
    return left.union(right).distinct()


def file_graph(edges: DataFrame, hard_only: bool = False) -> DataFrame:
    """Undirected weighted file pairs of unit edges."""
    from keylattice.functions.ids import file_of

    e = edges.where("edge_type = 'HARD'") if hard_only else edges
    s, t = file_of("source_id"), file_of("target_id")
    return e.where(s != t).groupBy(F.least(s, t).alias("a"), F.greatest(s, t).alias("b")).agg(F.count("*").alias("weight"))

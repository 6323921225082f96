"""Artifacts: graph and fuse JSON, route manifest, GraphML, page data, reports."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, functions as F

from keylattice.functions import text


def quoted(c: Column | str) -> Column:
    """A text as JSON; only one with characters that JSON escapes goes through a generator."""
    x = F.col(c) if isinstance(c, str) else c
    whole = F.to_json(F.struct(x.alias("x")))
    return F.when(x.rlike(r'["\\\x00-\x1f]'), F.substring(whole, F.lit(6), F.length(whole) - 6)).otherwise(F.concat(F.lit('"'), x, F.lit('"')))


def _edge_json() -> Column:
    """As ``to_json`` would tell it, put together from its parts: edges are many, and a generator a row costs more than finding them. Their ids are JSON already; tokens and types are words of the vocabulary."""
    field = lambda name, value: F.coalesce(F.concat(F.lit(f'"{name}":'), value, F.lit(",")), F.lit(""))
    word = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    sure = F.col("confidence").cast("string")
    return F.concat(
        F.lit("{"), field("source", F.col("source_id")), field("target", F.col("target_id")), field("key", word("key_token")), field("lock", word("lock_token")),
        field("confidence", F.when(F.abs("confidence") < float("inf"), sure).otherwise(word(sure))), F.lit('"type":'), word("edge_type"), F.lit("}"),
    )


def graph_json(units: DataFrame, edges: DataFrame, clusters: DataFrame, ids_quoted: bool = False) -> DataFrame:
    """The graph artifact as rows (part, json): one row an entity, so that it can be written by many tasks.

    ids_quoted: the edges' ids are JSON (``quoted``), which is done once a unit and not once an edge where it is done before matching."""
    u = units.select(F.lit("unit").alias("part"), F.to_json(F.struct(F.col("unit_id").alias("id"), F.col("root").alias("cluster"), "language", "confidence", F.transform("tokens", lambda t: F.concat(F.lit("COV."), t)).alias("tokens"))).alias("json"))
    q = edges if ids_quoted else edges.withColumns({c: quoted(c) for c in ("source_id", "target_id")})
    e = q.select(F.lit("edge").alias("part"), _edge_json().alias("json"))
    c = clusters.orderBy(F.desc("probability"), "root").select(F.lit("cluster").alias("part"), F.to_json(F.struct(F.col("cluster_id").alias("id"), "root", "size", "probability", "is_hard", "is_cross_file", F.col("dominant").alias("dominant_tokens"))).alias("json"))
    return u.union(e).union(c)


def graph_stats(units: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    e = edges.agg(F.count("*").alias("edges"), *(F.count_if(F.col("edge_type") == t.upper()).alias(t) for t in ("hard", "predicted", "ghost")))
    c = clusters.agg(F.count("*").alias("clusters"), F.count_if("is_hard").alias("hard_clusters"))
    return units.agg(F.count("*").alias("units")).crossJoin(e).crossJoin(c)


def clusters_stats(clusters: DataFrame) -> DataFrame:
    """``graph_stats`` of clusters that have the ends of edges by type: every unit is in one cluster, and every edge has two ends."""
    ends = lambda what: F.expr(f"coalesce(sum({what}), 0) div 2")
    return clusters.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("units"), ends("degree").alias("edges"), *(ends(t).alias(t) for t in ("hard", "predicted", "ghost")),
        F.count("*").alias("clusters"), F.count_if("is_hard").alias("hard_clusters"),
    )


def fuse_json(bridges: DataFrame) -> DataFrame:
    """Boundary clusters and bridges as JSON rows; none without a refused merge."""
    ends = bridges.select(F.explode(F.array("from_root", "to_root")).alias("id")).distinct()
    b = F.struct(F.col("from_root").alias("from"), F.col("to_root").alias("to"), "trigger_source", "trigger_target", "confidence", "refused_at_size")
    return ends.select(F.lit("boundary_cluster").alias("part"), F.to_json(F.struct("id")).alias("json")).union(bridges.select(F.lit("bridge").alias("part"), F.to_json(b).alias("json")))


def route_manifest(units: DataFrame) -> DataFrame:
    """Units with a ROUTE token, with the method and path that their id's last part tells."""
    seg = text.route_segment(F.element_at(F.split("unit_id", "::"), -1))
    return units.where(F.array_contains("tokens", "ROUTE")).select("unit_id", "file", seg["method"].alias("method"), seg["path"].alias("path")).orderBy("file", "unit_id")


def viz_nodes(units: DataFrame) -> DataFrame:
    return units.select("unit_id", text.viz_token(F.col("tokens")).alias("token"), F.round(4 + 6 * F.col("confidence"), 2).alias("radius"))


def viz_links(edges: DataFrame) -> DataFrame:
    return edges.select("source_id", "target_id", F.when(F.col("edge_type") == "HARD", "solid").when(F.col("edge_type") == "PREDICTED", "dashed").otherwise("dotted").alias("stroke"))


def graphml(nodes: DataFrame, links: DataFrame) -> str:
    """GraphML of a graph small enough for one reader (a cluster graph): nodes (id, label), links (source, target, weight)."""
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="l" for="node" attr.name="label" attr.type="string"/>', '<key id="w" for="edge" attr.name="weight" attr.type="double"/>', '<graph edgedefault="directed">']
    for r in nodes.orderBy("id").toLocalIterator():
        out.append(f'<node id={quoteattr(r["id"])}><data key="l">{escape(r["label"])}</data></node>')
    for r in links.orderBy("source", "target").toLocalIterator():
        out.append(f'<edge source={quoteattr(r["source"])} target={quoteattr(r["target"])}><data key="w">{r["weight"]}</data></edge>')
    return "\n".join([*out, "</graph>", "</graphml>"])


def diff_markdown(diff: DataFrame, drift: DataFrame, churn: DataFrame, verdict: str, most: int = 15) -> str:
    """A readable report of a diff; each list is cut to its first entries."""
    count = {r["status"]: r["n"] for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
    lines = [f"# Architecture drift: {verdict}", "", *(f"- {k}: {count.get(k, 0)}" for k in ("added", "removed", "changed")), "", "| token | gained | lost |", "|-|-|-|"]
    lines += [f"| {r['token']} | {r['gained']} | {r['lost']} |" for r in drift.orderBy(F.desc(F.col("gained") + F.col("lost")), "token").limit(most).collect()]
    lines += ["", "| file | changes |", "|-|-|", *(f"| {r['file']} | {r['changes']} |" for r in churn.orderBy(F.desc("changes"), "file").limit(most).collect())]
    return "\n".join(lines)


def diff_json(diff: DataFrame, drift: DataFrame, churn: DataFrame) -> DataFrame:
    """The diff as rows (part, json): units, tokens and files, so that many tasks can write it."""
    row = lambda d, part, *c: d.select(F.lit(part).alias("part"), F.to_json(F.struct(*c)).alias("json"))
    return row(diff, "unit", "unit_id", "file", "status").union(row(drift, "token", "token", "gained", "lost")).union(row(churn, "file", "file", "changes"))


def diff_text(diff: DataFrame, verdict: str, most: int = 15) -> str:
    """The diff for a terminal: counts, and the first units of each status."""
    count = {r["status"]: r["n"] for r in diff.groupBy("status").agg(F.count("*").alias("n")).collect()}
    lines = [f"drift: {verdict}"]
    for status, sign in (("added", "+"), ("removed", "-"), ("changed", "~")):
        lines.append(f"{status}: {count.get(status, 0)}")
        lines += [f"  {sign} {r['unit_id']}" for r in diff.where(F.col("status") == status).orderBy("unit_id").limit(most).collect()]
    return "\n".join(lines)


def write_evaluation(metrics: DataFrame, clusterings: DataFrame, path: str) -> None:
    """An evaluation's files: metrics as CSV and JSON, clusterings (method, file, cluster) as JSON by method."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/metrics")
    metrics.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    clusterings.write.mode("overwrite").partitionBy("method").json(f"{path}/clusterings")


def narration(clusters: DataFrame, names: DataFrame, roles: DataFrame, most: int = 10) -> str:
    """The largest clusters with name, role and size, as Markdown."""
    c = clusters.join(names, "root").join(roles, "root").orderBy(F.desc("size"), "root").limit(most)
    return "\n".join(["# Clusters", *(f"- **{r['name']}** - {r['role']}, {r['size']} units, {'hard' if r['is_hard'] else 'soft'}" for r in c.collect())])


def save_cache(cache: DataFrame, path: str) -> None:
    from keylattice.sources.files import CACHE_VERSION

    cache.withColumn("version", F.lit(CACHE_VERSION)).write.mode("overwrite").parquet(path)


def append_unresolved(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Index tables; symbol tokens are sorted within their files so that a lookup prunes row groups."""
    for name, df in tables.items():
        (df.repartitionByRange("token").sortWithinPartitions("token") if "token" in df.columns else df).write.mode("overwrite").parquet(f"{path}/{name}")

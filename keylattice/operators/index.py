"""Symbol index: inverted tokens, exact and prefix lookup, ranking, callers and callees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keylattice.functions import ids

WEIGHTS = {"frequency": 0.25, "callee": 0.20, "locality": 0.25, "fingerprint": 0.15, "package": 0.15}
LEAST = 0.2


def symbol_index(symbols: DataFrame) -> DataFrame:
    """(token, unit_id) of symbols (unit_id, name)."""
    return symbols.select(F.explode(ids.symbol_tokens("name")).alias("token"), "unit_id").distinct()


def frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("frequency"))


def in_degrees(edges: DataFrame, edge_type: str | None = "call") -> DataFrame:
    e = edges if edge_type is None else edges.where(F.col("type") == edge_type)
    return e.groupBy(F.col("target").alias("unit_id")).agg(F.count("*").alias("in_degree"))


def frequency_score(f: Column) -> Column:
    return 1 / (1 + F.log10(F.greatest(F.coalesce(f, F.lit(1)), F.lit(1))))


def callee_score(in_degree: Column, exported: Column) -> Column:
    return F.least(F.lit(1.0), F.least(F.coalesce(in_degree, F.lit(0)) / 10, F.lit(1.0)) * F.when(exported, 1.5).otherwise(1.0))


def locality_score(here: Column, there: Column) -> Column:
    """1.0 same file, 0.8 same package, 0.6 same folder, 0.5 same parent folder, 0.1 elsewhere; 0.5 without a context."""
    return (
        F.when(here.isNull(), 0.5).when(here == there, 1.0).when((ids.package_of(here) != "") & (ids.package_of(here) == ids.package_of(there)), 0.8)
        .when(ids.parent_of(here) == ids.parent_of(there), 0.6).when(ids.parent_of(ids.parent_of(here)) == ids.parent_of(ids.parent_of(there)), 0.5).otherwise(0.1)
    )


def fingerprint_score(a: Column, b: Column) -> Column:
    j = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0) | (j < 0.2), 0.0).otherwise(j)


def package_score(here: Column, there: Column) -> Column:
    a, b = ids.package_of(here), ids.package_of(there)
    return F.when(here.isNull() | (a == "") | (b == ""), 0.5).when(a == b, 1.2).when(ids.parent_of(a) == ids.parent_of(b), 0.8).otherwise(0.5)


def rank(candidates: DataFrame, limit: int = 10) -> DataFrame:
    """Candidates with columns unit_id, name, file, exported, tokens, frequency, in_degree, context_file, context_tokens, scored and ordered."""
    none = F.col("context_file").isNull()
    s = candidates.withColumns({
        "frequency_s": frequency_score(F.col("frequency")), "callee_s": callee_score(F.col("in_degree"), F.col("exported")),
        "locality_s": locality_score(F.col("context_file"), F.col("file")),
        "fingerprint_s": F.when(none, 0.0).otherwise(fingerprint_score(F.col("context_tokens"), F.col("tokens"))), "package_s": package_score(F.col("context_file"), F.col("file")),
    })
    score = sum(F.col(f"{k}_s") * w for k, w in WEIGHTS.items())
    reasons = F.concat_ws(
        ", ", F.when(F.col("frequency_s") > 0.7, "rare symbol"), F.when(F.col("callee_s") > 0.7, "popular export"),
        F.when(F.col("locality_s") > 0.8, "nearby unit"), F.when(F.col("fingerprint_s") > 0.5, "matching behavior"),
    )
    s = s.withColumn("score", F.round(score, 6)).withColumn("reasoning", F.when(reasons == "", "general match").otherwise(reasons))
    return s.where(F.col("score") >= LEAST).orderBy(F.desc("score"), "unit_id").limit(limit).select("unit_id", "name", "score", "reasoning")


def lookup(index: DataFrame, token: str) -> DataFrame:
    return index.where(F.col("token") == token).select("unit_id").distinct()


def prefix(index: DataFrame, start: str) -> DataFrame:
    """Units with a token that begins so; ``_`` and ``%`` in the query are wildcards, as in SQL's LIKE."""
    return index.where(F.col("token").like(start + "%")).select("unit_id").distinct()


def callers(edges: DataFrame, symbols: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Units that call a unit of this name, at most ``limit`` for each target and in all."""
    target = symbols.where(F.col("name") == name).select(F.col("unit_id").alias("target"))
    per = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    e = edges.join(F.broadcast(target), "target").select("source", "target").distinct().withColumn("_r", per).where(F.col("_r") <= limit)
    return e.select(F.col("source").alias("unit_id"), "target").orderBy("target", "unit_id").limit(limit)


def callees(edges: DataFrame, symbols: DataFrame, name: str, limit: int = 10) -> DataFrame:
    source = symbols.where(F.col("name") == name).select(F.col("unit_id").alias("source"))
    return edges.join(F.broadcast(source), "source").select("source", F.col("target").alias("unit_id")).distinct().orderBy("source", "unit_id").limit(limit)


def file_match(files: DataFrame, query: str) -> DataFrame:
    """The file of this name; without one, all whose path ends so."""
    f = files.select("file").distinct().where(F.col("file").endswith(query)).withColumn("exact", F.col("file") == query)
    best = f.agg(F.bool_or("exact").alias("any_exact"))
    return f.crossJoin(F.broadcast(best)).where(F.col("exact") | ~F.col("any_exact")).select("file")


def mark_boundary(clusters: DataFrame, bridges: DataFrame) -> DataFrame:
    ends = bridges.select(F.col("from_root").alias("root")).union(bridges.select(F.col("to_root").alias("root"))).distinct().withColumn("is_boundary", F.lit(True))
    return clusters.join(ends, "root", "left").na.fill(False, ["is_boundary"])


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Insert or replace: of rows with one key the last stays."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")

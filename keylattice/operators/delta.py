"""Differences of two scans, and which files an incremental scan has to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _set(c: str) -> Column:
    return F.array_sort(F.array_distinct(c))


def diff_units(before: DataFrame, after: DataFrame) -> DataFrame:
    """added, removed and changed units (token sets differ)."""
    b = before.select("unit_id", "file", _set("tokens").alias("old"))
    a = after.select("unit_id", F.col("file").alias("new_file"), _set("tokens").alias("new"))
    d = b.join(a, "unit_id", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return d.select("unit_id", F.coalesce("file", "new_file").alias("file"), status.alias("status"), "old", "new").where("status is not null")


def diff_routes(before: DataFrame, after: DataFrame) -> DataFrame:
    b, a = (x.where(F.array_contains("tokens", "ROUTE")).select("unit_id").distinct() for x in (before, after))
    return a.join(b, "unit_id", "left_anti").withColumn("status", F.lit("added")).union(b.join(a, "unit_id", "left_anti").withColumn("status", F.lit("removed")))


def token_drift(diff: DataFrame) -> DataFrame:
    """Tokens gained and lost over all differences."""
    none = F.array().cast("array<string>")
    old, new = F.coalesce("old", none), F.coalesce("new", none)
    gained = diff.select(F.explode(F.array_except(new, old)).alias("token"), F.lit(1).alias("g"), F.lit(0).alias("l"))
    lost = diff.select(F.explode(F.array_except(old, new)).alias("token"), F.lit(0).alias("g"), F.lit(1).alias("l"))
    return gained.union(lost).groupBy("token").agg(F.sum("g").alias("gained"), F.sum("l").alias("lost"))


def file_churn(diff: DataFrame) -> DataFrame:
    return diff.groupBy("file").agg(F.count("*").alias("changes"))


def language_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.groupBy("language").agg(F.count("*").alias("before"))
    a = after.groupBy("language").agg(F.count("*").alias("after"))
    return b.join(a, "language", "full_outer").na.fill(0, ["before", "after"])


def drift_verdict(changes: Column) -> Column:
    return F.when(changes < 5, "Stable").when(changes < 200, "Drifting").otherwise("Restructured")


def partition_files(files: DataFrame, cache: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """dirty or cached, for every file (path, mtime, hash).

    A file that the cache doesn't know is dirty.  A list of changed paths, where
    given, decides the rest; without it, equal modification time or equal hash
    means cached."""
    c = cache.select("path", F.col("mtime").alias("_m"), F.col("hash").alias("_h"))
    f = files.join(c, "path", "left")
    known = F.col("_m").isNotNull() | F.col("_h").isNotNull()
    if changed is None:
        same = (F.col("mtime") == F.col("_m")) | (F.col("hash") == F.col("_h"))
    else:
        f = f.join(changed.select("path").distinct().withColumn("_d", F.lit(True)), "path", "left")
        same = F.col("_d").isNull()
    return f.select("path", F.when(known & F.coalesce(same, F.lit(False)), "cached").otherwise("dirty").alias("state"))


def purge_deleted(cache: DataFrame, files: DataFrame) -> DataFrame:
    return cache.join(files.select("path"), "path", "left_anti")


def merged_scan(cached: DataFrame, new: DataFrame, state: DataFrame) -> DataFrame:
    """Units after an incremental scan: the cache's for files that are cached, the new ones for all others; files that are gone have none."""
    fresh = state.where("state = 'cached'").select(F.col("path").alias("file"))
    return cached.join(fresh, "file", "left_semi").select(*new.columns).unionByName(new.join(fresh, "file", "left_anti").select(*new.columns))


def schema_gaps(need: DataFrame, have: DataFrame) -> DataFrame:
    """(name, kind) that a schema needs and doesn't have."""
    return need.select("name", "kind").distinct().join(have.select("name", "kind"), ["name", "kind"], "left_anti")


def common_files(*clusterings: DataFrame) -> DataFrame:
    """Files that all clusterings (file, ...) know."""
    out = clusterings[0].select("file").distinct()
    for c in clusterings[1:]:
        out = out.join(c.select("file"), "file", "left_semi")
    return out

"""The pool of unresolved references, as snapshots of a table.

State rows: source_id, token, raw_callee, ingested_at (epoch seconds),
resolved, resolved_at, boundary.  Each operation takes the state and returns the
next one; nothing is updated in place, so a failed job leaves the last snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from keylattice.functions import vocab
from keylattice.operators.match import classify_edge, edge_confidence

AGE = 7 * 86400
PROXY = 0.75
STATE = "source_id string, token string, raw_callee string, ingested_at double, resolved boolean, resolved_at double, boundary boolean"


def ingest(state: DataFrame, suspended: DataFrame, now: float) -> DataFrame:
    """Insert what isn't pending already."""
    pending = state.where("not resolved").select("source_id", "token")
    new = suspended.select("source_id", "token", "raw_callee").dropDuplicates(["source_id", "token"]).join(pending, ["source_id", "token"], "left_anti")
    return state.unionByName(new.select("source_id", "token", "raw_callee", F.lit(float(now)).alias("ingested_at"), F.lit(False).alias("resolved"), F.lit(None).cast("double").alias("resolved_at"), F.lit(False).alias("boundary")))


def resurrect(state: DataFrame, units: DataFrame) -> DataFrame:
    """An edge for every pending row and every complement that some unit has, to the first such unit."""
    p = vocab.pairs_df(units.sparkSession)
    both = p.select(F.col("key").alias("token"), F.col("lock").alias("other"), "pair_ord", "key", "lock").union(p.select(F.col("lock"), F.col("key"), "pair_ord", "key", "lock"))
    first = units.select("seq", "unit_id", "confidence", F.explode("tokens").alias("other")).groupBy("other").agg(F.min_by(F.struct("unit_id", "confidence"), "seq").alias("u"))
    lookup = F.broadcast(both.join(first, "other"))  # at most one row for each direction of the 14 pairs
    hit = state.where("not resolved").join(lookup, "token")
    forward = F.col("token") == F.col("key")
    c = edge_confidence(F.lit(PROXY), F.col("u.confidence"), F.lit(False), F.lit(False))
    return hit.select(
        F.when(forward, F.col("source_id")).otherwise(F.col("u.unit_id")).alias("source_id"), F.when(forward, F.col("u.unit_id")).otherwise(F.col("source_id")).alias("target_id"),
        F.col("key").alias("key_token"), F.col("lock").alias("lock_token"), c.alias("confidence"), classify_edge(c).alias("edge_type"),
    )


def resolve(state: DataFrame, units: DataFrame, now: float) -> DataFrame:
    """Mark pending rows that have a complement as resolved."""
    p = vocab.pairs_df(units.sparkSession)
    both = p.select(F.col("key").alias("token"), F.col("lock").alias("other")).union(p.select("lock", "key"))
    have = both.join(units.select(F.explode("tokens").alias("other")).distinct(), "other").select("token", F.lit(True).alias("_hit")).distinct()
    s = state.join(F.broadcast(have), "token", "left")
    done = ~F.col("resolved") & F.coalesce("_hit", F.lit(False))
    return s.select("source_id", "token", "raw_callee", "ingested_at", (F.col("resolved") | done).alias("resolved"), F.when(done, F.lit(float(now))).otherwise(F.col("resolved_at")).alias("resolved_at"), "boundary")


def promote_boundaries(state: DataFrame, now: float, age: float = AGE) -> DataFrame:
    stale = ~F.col("resolved") & ~F.col("boundary") & (F.col("ingested_at") < now - age)
    return state.withColumn("boundary", F.col("boundary") | stale)


def odd_groups(state: DataFrame, now: float) -> DataFrame:
    """Pending rows by token: first callee, members, count, oldest age, any boundary."""
    return state.where("not resolved").groupBy("token").agg(
        F.min_by("raw_callee", F.struct("ingested_at", "source_id")).alias("pattern"), F.array_join(F.array_sort(F.collect_list("source_id")), ",").alias("members"),
        F.count("*").alias("n"), F.max(F.lit(float(now)) - F.col("ingested_at")).alias("oldest_age_s"), F.bool_or("boundary").alias("is_boundary"),
    )


def stats(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("total"), F.count_if(~F.col("resolved")).alias("pending"), F.count_if("resolved").alias("resolved"), F.count_if("boundary").alias("boundary"))


def token_counts(state: DataFrame, prefix: str) -> DataFrame:
    """Pending rows by token, and those of them whose callee begins so."""
    return state.where("not resolved").groupBy("token").agg(F.count("*").alias("total"), F.count_if(F.col("raw_callee").startswith(prefix)).alias("clients"))


def forecast(state: DataFrame) -> DataFrame:
    """For each pending token: majority module, likely complement, boundary guess."""
    p = state.where("not resolved").withColumn("module", F.trim(F.replace(F.replace(F.element_at(F.split("source_id", "::"), 1), F.lit(".py"), F.lit("")), F.lit("/"), F.lit("."))))
    votes = p.groupBy("token", "module").agg(F.count("*").alias("n"))
    top = votes.withColumn("_r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n"), "module"))).where("_r = 1").select("token", F.col("module").alias("predicted_module"))
    hint = F.col("source_id").rlike(vocab.BOUNDARY_HINT) | F.col("raw_callee").rlike(vocab.BOUNDARY_HINT) | F.col("boundary")
    g = p.groupBy("token").agg(F.count("*").alias("n"), F.bool_or(hint).alias("is_boundary"))
    likely = F.coalesce(*(F.when(F.col("token") == k, v) for k, v in vocab.LIKELY_LOCK.items()), F.lit("CONTRACT"))
    return g.join(top, "token").select("token", "n", "predicted_module", likely.alias("predicted_lock"), "is_boundary", F.when(F.col("is_boundary"), 0.4).otherwise(0.55).alias("confidence"))

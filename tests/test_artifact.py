"""The graph artifact on events that are odd in every column, and what it is made of."""

import datetime
import json

from pyspark.sql import functions as F

from keylattice import sinks
from keylattice.functions import ids
from keylattice.operators import cluster, match


def odd_events(spark, path):
    """Events with ids to escape, nulls in every column, repeated rows and unknown types."""
    types = ["view", "click", "purchase", "signup", "error", 'v"i\\e\nw\x01', "ä/ü ", "", None]
    at = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=37 * (i % 150))
    rows = [(None if i % 41 == 0 else i // 2 if i % 17 == 0 else i, None if i % 29 == 0 else at(i), None if i % 31 == 0 else i % 4, types[i % 9], None if i % 23 == 0 else 60.0 + i % 80, None if i % 19 == 0 else f'{{"k": {i % 10}}}') for i in range(600)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_graph_artifact_equals_entities_made_apart(spark, tmp_path):
    """Edges put together from parts are what a JSON generator gives, and clusters summed up in one pass what aggregations and joins give."""
    from keylattice.plans import units as plans

    sf = odd_events(spark, tmp_path)
    m, scopes = plans.members(spark, sf)
    e = match.edges(m, scopes)
    size = m.groupBy("root").agg(F.count("*").alias("size"), F.countDistinct("file").alias("files"))
    ends = match.degrees(m, scopes, "root").select("root", "degree")
    c = size.join(cluster.dominant_tokens(m), "root", "left").join(ends, "root", "left").na.fill(0, ["degree"])
    boost = F.least(F.lit(0.3), 0.05 * F.col("degree")) + F.when(F.col("files") > 1, 0.1).otherwise(0.0) + F.least(F.lit(0.1), 0.01 * F.col("size"))
    c = c.withColumn("probability", F.round(F.least(F.lit(1.0), cluster.prior_of(F.coalesce("dominant", F.array().cast("array<string>"))) + boost), 4))
    c = c.select(ids.cluster_id("root").alias("id"), "root", "size", "probability", ((F.col("probability") >= 0.85) & (F.col("size") >= 2)).alias("is_hard"), (F.col("files") > 1).alias("is_cross_file"), F.col("dominant").alias("dominant_tokens"))
    e = e.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("key_token").alias("key"), F.col("lock_token").alias("lock"), "confidence", F.col("edge_type").alias("type"))
    told = lambda d: sorted(r[0] for r in d.select(F.to_json(F.struct("*"))).collect())
    got = {p: [r["json"] for r in plans.graph_artifact(spark, sf).where(F.col("part") == p).collect()] for p in ("unit", "edge", "cluster")}
    assert len(got["unit"]) == 600 and sorted(got["edge"]) == told(e) and sorted(got["cluster"]) == told(c)
    assert any(r'v\"i\\e\nw\u0001' in x for x in got["edge"])
    ranks = [(-j["probability"], j["root"]) for j in map(json.loads, got["cluster"])]
    assert ranks == sorted(ranks)


def test_edges_with_nulls_are_told_as_by_a_generator(spark):
    """Null fields are left out, numbers that JSON lacks are texts, and ids are escaped."""
    rows = [('a"b', "c\\d\te", "FETCH", "PERSIST", c, "HARD") for c in (0.45, 1.0, 1e-05, -0.0, 12345678.9, None, float("nan"), float("inf"), -float("inf"))] + [(None, "\x1fä", None, None, None, "GHOST")]
    e = spark.createDataFrame(rows, "source_id string, target_id string, key_token string, lock_token string, confidence double, edge_type string")
    want = e.select(F.to_json(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("key_token").alias("key"), F.col("lock_token").alias("lock"), "confidence", F.col("edge_type").alias("type"))))
    q = e.withColumns({c: sinks.quoted(c) for c in ("source_id", "target_id")})
    assert [r[0] for r in q.select(sinks._edge_json()).collect()] == [r[0] for r in want.collect()]


def test_graph_artifact_makes_units_once_and_meets_once(spark, tmp_path):
    """The table of events is not read by any part of the artifact, and edges and degrees read one shuffle by region."""
    from keylattice.plans import units as plans

    a = plans.graph_artifact(spark, odd_events(spark, tmp_path))
    assert not [f for f in a.inputFiles() if "events.parquet" in f]
    a.write.format("noop").mode("overwrite").save()
    seen = a._jdf.queryExecution()
    assert "props" not in seen.optimizedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plans.graph_artifact(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by_region = [x for x in plan.splitlines() if "Exchange hashpartitioning(band" in x and "share" in x]
    assert len([x for x in by_region if "Reused" not in x]) == 1, plan
    assert [x for x in plan.splitlines() if "ReusedExchange" in x and "REPARTITION_BY_NUM" in x]


def test_clusters_larger_than_a_batch_are_summed_up(spark, monkeypatch):
    """Rows of a root are gathered however many there are, and ends of unknown roots make no cluster."""
    monkeypatch.setattr(cluster, "ROWS", 3)
    rows = [(i, f"f{i % 2}.py", "a" if i < 40 else None if i < 45 else f"r{i}", ["EMIT", "FETCH"][: i % 3] if i % 7 else None) for i in range(60)]
    m = spark.createDataFrame(rows, "seq bigint, file string, root string, tokens array<string>")
    ends = spark.createDataFrame([("a", 1), ("a", 2), (None, 9), ("none", 5), ("r50", 4)], "root string, degree bigint")
    got = {r["root"]: r.asDict() for r in cluster.cluster_build(m, ends).collect()}
    assert len(got) == 17 and (got["a"]["size"], got["a"]["files"], got["a"]["degree"], got[None]["size"], got[None]["degree"], got["r50"]["degree"]) == (40, 2, 3, 5, 0, 4)
    want = {r["root"]: r["dominant"] for r in cluster.dominant_tokens(m).collect()}
    assert {k: x["dominant"] for k, x in got.items() if x["dominant"] is not None} == want

"""Queries that put several operators together, and reports over their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keylattice.operators import census, cluster, context, delta, evaluate, index, match, pool, web
from keylattice.plans import rows, units as u
from keylattice.plans.registry import query
from keylattice.sources.adapters import event_units, event_units_sql, table

TASK, SURE = ("FETCH", "OUTPUT", "ROUTE"), 0.7
_TASK = "['FETCH', 'OUTPUT', 'ROUTE']"


@query(f"""WITH {u._SEAMS}, s AS (SELECT unit_id, confidence, len(list_intersect(tokens, {_TASK}))::INT AS shared, len(list_distinct(list_concat(tokens, {_TASK}))) AS n FROM u),
 t AS (SELECT unit_id, round(shared / n, 4) AS score, shared, row_number() OVER (ORDER BY round(shared / n, 4) DESC, shared DESC, confidence DESC, unit_id DESC)::INT AS rank FROM s WHERE round(shared / n, 4) >= 0.25 QUALIFY rank <= 3),
 b AS (SELECT root, score AS best FROM t JOIN members USING (unit_id) WHERE rank = 1),
 a AS (SELECT root, arg_max(unit_id, row(len(list_intersect(tokens, {_TASK})), confidence, unit_id)) AS anchor_unit FROM members JOIN b USING (root) GROUP BY root),
 x AS (SELECT CASE WHEN source_cluster = root THEN target_cluster ELSE source_cluster END AS related_cluster FROM seams, b WHERE source_cluster = root OR target_cluster = root
   ORDER BY edge_count DESC, max_confidence DESC, source_cluster, target_cluster LIMIT 1)
 SELECT rank, unit_id, score, shared, CASE WHEN best >= 0.7 THEN 'high' WHEN best >= 0.5 THEN 'medium' WHEN best >= 0.35 THEN 'low' ELSE 'none' END AS gate,
  CASE WHEN best >= 0.35 THEN 'ready_for_delta_generation' ELSE 'needs_more_context' END AS status, anchor_unit, related_cluster FROM t, b, a LEFT JOIN x ON true""")
def twin_context(spark: SparkSession, sf: str) -> DataFrame:
    m, e, _ = u.clusters(spark, sf)
    return context.twin_context(m, m, cluster.seam_bundles(e, m), list(TASK), SURE)


_PROMPT = """p AS (SELECT conv_id * 100 + turn AS prompt_id, turn % 5 AS k, conv_id % 7 AS j, lower(trim(text)) AS low FROM conversations),
 c AS (SELECT prompt_id, j > 2 AS found, k = 0 AS by_file, k IN (1, 4) AS calls, k = 2 AS modules, k = 3 AS repo, k = 4 AS faces FROM p)"""
_TEXTS = ["look at src/app/main.py", "trace the call graph", "the module boundary", "the whole codebase", "an interface and a deadlock"]


@query(f"""WITH {_PROMPT}, s AS (SELECT *, CASE WHEN by_file THEN 'file' WHEN repo THEN 'repository' WHEN modules THEN 'module' ELSE 'package' END AS scope FROM c),
 g AS (SELECT *, round(least(1.0::DOUBLE, CASE WHEN found THEN 0 ELSE 0.4 END::DOUBLE + 0.4::DOUBLE * (1 - CASE WHEN found THEN 0.7 ELSE 0.2 END::DOUBLE) + 0.2::DOUBLE * CASE WHEN calls THEN 0.6 ELSE 0.35 END::DOUBLE + CASE WHEN found THEN 0 ELSE 0.25 END::DOUBLE), 3) AS g1 FROM s),
 h AS (SELECT *, g1 >= 0.4 OR scope <> 'file' AS package FROM g),
 i AS (SELECT *, CASE WHEN package THEN round(0.4::DOUBLE * (1 - CASE WHEN found THEN 0.85 ELSE 0.6 END::DOUBLE) + 0.2::DOUBLE * CASE WHEN calls THEN 0.45 ELSE 0.25 END::DOUBLE + CASE WHEN found THEN 0 ELSE 0.25 END::DOUBLE, 3) ELSE g1 END AS g2 FROM h),
 m AS (SELECT *, g2 >= 0.65 OR scope IN ('module', 'repository') OR calls OR faces AS module FROM i)
 SELECT prompt_id, scope, concat_ws(',', CASE WHEN by_file THEN 'cluster_of_file' ELSE 'search_symbols' END, CASE WHEN by_file AND found THEN 'boundary_edges' END, CASE WHEN package THEN 'architecture_summary' END,
   CASE WHEN module THEN 'impact_neighbors' END, CASE WHEN module THEN 'high_coupling_seams' END) AS steps, CASE WHEN module THEN round(0.4::DOUBLE * (1 - 0.92::DOUBLE) + 0.2::DOUBLE * 0.15::DOUBLE, 3) ELSE g2 END AS gain FROM m""")
def guided_context(spark: SparkSession, sf: str) -> DataFrame:
    """Staged context for one prompt of each kind a turn; whether the focal point is found goes by conversation."""
    c = table(spark, sf, "conversations")
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("turn") % 5 + 1).cast("int"))
    p = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("prompt_id"), text.alias("prompt"), (F.col("conv_id") % 7 > 2).alias("found"))
    k = context.classify_prompt(p)
    return context.guided_steps(k.withColumn("found", (F.floor(F.col("prompt_id") / 100) % 7) > 2))


@query("""WITH p AS (SELECT conv_id * 100 + turn AS prompt_id, turn % 5 AS k FROM conversations)
 SELECT prompt_id, ['file', 'package', 'module', 'repository', 'package'][k + 1] AS scope, [0.60, 0.41, 0.33, 0.30, 0.53][k + 1]::DOUBLE AS confidence,
  CASE WHEN k = 0 THEN 'src/app/main.py' ELSE '' END AS focal_file, CASE WHEN k = 0 THEN 'src/app/main.py' ELSE '' END AS package_hint, ['look', 'trace', 'the', 'the', 'interface'][k + 1] AS focal_symbol,
  ['file_anchor,package_anchor', 'call_graph', 'module', 'repo_scope', 'call_graph,interfaces'][k + 1] AS signals FROM p""")
def classify_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of five kinds of prompt, one a turn; what is expected was worked out by hand."""
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (F.col("turn") % 5 + 1).cast("int"))
    return context.classify_prompt(table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("prompt_id"), text.alias("prompt")))


@query("""SELECT p_partkey, p_size % 4 = 0 OR p_size % 4 = 1 AND p_partkey % 2 = 0 OR p_size % 4 = 3 AS is_test FROM part""")
def test_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """By first token, by name and by files."""
    k = F.col("p_size") % 4
    arr = lambda *x: F.array(*map(F.lit, x))
    dominant = F.when(k == 0, arr("TEST", "FETCH")).otherwise(arr("FETCH", "TEST"))
    name = F.when((k == 1) & (F.col("p_partkey") % 2 == 0), "My Benchmark").otherwise("Store")
    files = F.when(k == 3, arr("tests/a.py", "b_test.go")).when(k == 2, arr("tests/a.py", "b.go")).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", cluster.is_test_cluster(dominant, name, files).alias("is_test"))


@query(f"WITH {u._U}, x AS (SELECT unnest(list_concat(tokens, CASE WHEN cls = 'error' THEN ['RAISE', 'LOG'] ELSE [] END)) AS token FROM u) SELECT token, count(*) AS n FROM x GROUP BY 1")
def token_distribution(spark: SparkSession, sf: str) -> DataFrame:
    of_class = F.when(F.col("cls") == "error", F.array(F.lit("RAISE"), F.lit("LOG")))
    return cluster.token_distribution(u.units(spark, sf).withColumn("class_context", of_class))


@query(f"WITH {u._CL} SELECT DISTINCT unit_id FROM (SELECT source_id AS unit_id FROM ce UNION ALL SELECT target_id FROM ce)")
def seam_units(spark: SparkSession, sf: str) -> DataFrame:
    return match.apart(*u.members(spark, sf), "root")


@query(f"""WITH b AS (SELECT * FROM {event_units_sql("ts < TIMESTAMP '2024-01-20'")}), a AS (SELECT * FROM {event_units_sql("ts >= TIMESTAMP '2024-01-10'", 150)})
 SELECT unit_id, array_to_string(tokens, ',') AS tokens FROM b WHERE hash_user(file) % 2 = 0 AND file IN (SELECT file FROM a) UNION ALL SELECT unit_id, array_to_string(tokens, ',') FROM a WHERE NOT (hash_user(file) % 2 = 0 AND file IN (SELECT file FROM b))""".replace("hash_user(file)", "split_part(file, '/u', 2)::INT"))
def incremental_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Cached units of every second user's file, new ones of all others."""
    before, after = rows.scans(spark, sf)
    files = lambda d: d.select(F.col("file").alias("path")).distinct().select("path", F.lit(1.0).alias("mtime"), F.lit("h").alias("hash"))
    cache = files(before).withColumn("mtime", F.when(F.split("path", "/u").getItem(1).cast("int") % 2 == 0, 1.0).otherwise(0.0)).withColumn("hash", F.lit("old"))
    state = delta.partition_files(files(after), cache)
    return delta.merged_scan(before, after, state).select("unit_id", F.array_join("tokens", ",").alias("tokens"))


@query(f"""WITH {u._STATE}, first AS (SELECT token AS other, arg_min(unit_id, seq) AS uid, arg_min(confidence, seq) AS conf FROM (SELECT seq, unit_id, confidence, unnest(tokens) AS token FROM nxt) GROUP BY 1)
 SELECT source_id, target_id, key_token, lock_token, edge_type FROM edges UNION ALL
 SELECT CASE WHEN st.token = key THEN source_id ELSE uid END, CASE WHEN st.token = key THEN uid ELSE source_id END, key, lock, CASE WHEN least(0.75::DOUBLE, conf) >= 0.5 THEN 'PREDICTED' ELSE 'GHOST' END
 FROM st JOIN comp ON st.token = comp.token JOIN first USING (other)""")
def edges_with_resurrected(spark: SparkSession, sf: str) -> DataFrame:
    """A scan's edges, and those that the pool gives back after clustering."""
    d = u.day_units(spark, sf)
    names = ["source_id", "target_id", "key_token", "lock_token", "edge_type"]
    scopes = match.scopes_of(census.bands(d))
    return match.edges(d, scopes).select(*names).unionByName(pool.resurrect(u.state(spark, sf, scopes), u.scanned(spark, sf)).select(*names))


@query("SELECT unnest(['doc_hash', 'n_chars']) AS name, unnest(['string', 'double']) AS kind")
def schema_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that a schema needs and the documents table lacks, or has of another type."""
    need = spark.createDataFrame([("doc_id", "bigint"), ("text", "string"), ("doc_hash", "string"), ("n_chars", "double")], "name string, kind string")
    return delta.schema_gaps(need, spark.createDataFrame(table(spark, sf, "documents").dtypes, "name string, kind string"))


@query("SELECT 'u' || user_id AS file FROM (" + " INTERSECT ".join(f"SELECT user_id FROM events WHERE event_type = '{t}' AND value > 20" for t in ("view", "click", "purchase", "signup", "error")) + ")")
def common_files(spark: SparkSession, sf: str) -> DataFrame:
    """Users that all five event types know with a high value."""
    e = table(spark, sf, "events").where("value > 20").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), "event_type")
    return delta.common_files(*(e.where(F.col("event_type") == t) for t in ("view", "click", "purchase", "signup", "error")))


@query("""WITH e AS (SELECT event_type AS kind, CASE WHEN user_id < 50 THEN 'linux' ELSE 'darwin' END AS os, CASE WHEN value > 400 THEN '' ELSE 'M' END AS bucket, 'v' || user_id % 3 AS version, CASE WHEN event_type = 'click' THEN 'scan' END AS tool FROM events),
 x AS (SELECT unnest(['kind', 'os', 'bucket', 'version', 'tool']) AS histogram, unnest([kind, os, CASE WHEN bucket = '' THEN '?' ELSE bucket END, version, tool]) AS value FROM e)
 SELECT histogram, value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY ALL""")
def telemetry_histograms(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.when(F.col("user_id") < 50, "linux").otherwise("darwin").alias("os"), F.when(F.col("value") > 400, "").otherwise("M").alias("bucket"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("version"), F.when(F.col("event_type") == "click", "scan").alias("tool"),
    )
    return web.histograms(e, {c: c for c in ("kind", "os", "bucket", "version", "tool")})


_ADOPT = "t AS (SELECT event_type AS repo, 'r' || user_id % 40 AS referrer, '/p' || event_id % 60 AS path, user_id AS visitor FROM events)"


@query(f"""WITH {_ADOPT} SELECT 'repository' AS section, repo AS name, count(*) AS views, count(DISTINCT visitor) AS uniques FROM t GROUP BY repo
 UNION ALL (SELECT 'referrer', referrer, count(*), count(DISTINCT visitor) FROM t GROUP BY referrer ORDER BY 3 DESC, 2 LIMIT 10) UNION ALL (SELECT 'path', path, count(*), count(DISTINCT visitor) FROM t GROUP BY path ORDER BY 3 DESC, 2 LIMIT 10)""")
def adoption_rollup(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return web.adoption_rollup(e.select(F.col("event_type").alias("repo"), name("r", F.col("user_id") % 40).alias("referrer"), name("/p", F.col("event_id") % 60).alias("path"), F.col("user_id").alias("visitor")))


@query("SELECT count(*) AS views, count(DISTINCT user_id) AS paths, (SELECT count(*) FROM events WHERE event_type = 'click') AS interactions FROM events WHERE event_type = 'view'")
def page_totals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return web.page_totals(e.where("event_type = 'view'").select(F.col("user_id").alias("path")), e.where("event_type = 'click'"))


@query("SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return web.newest(table(spark, sf, "events").where("event_type = 'click'").select("event_id", "ts"), "ts", "event_id", 100)


@query("""WITH r AS (SELECT 'u' || user_id AS file, (sum(value) / 10)::INT % 101 AS score FROM events GROUP BY 1), o AS (SELECT max(score) AS overall FROM r)
 SELECT file, score::INT AS score, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level, overall::INT AS overall, CASE WHEN overall >= 70 THEN 'HIGH' WHEN overall >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS overall_level
 FROM r, o ORDER BY score DESC, file LIMIT 10""")
def risk_report(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file")).agg((F.round(F.sum("value") / 10, 0).cast("int") % 101).alias("score"))
    return evaluate.risk_report(e.withColumn("level", evaluate.risk_level(F.col("score"))))


@query(f"""WITH {rows._INDEX} SELECT unit_id, min(way)::INT AS way FROM (SELECT unit_id, 0 AS way FROM idx WHERE token = 'ring' UNION ALL SELECT unit_id, 1 FROM idx WHERE starts_with(token, 're')) GROUP BY 1 ORDER BY way, unit_id LIMIT 400""")
def search_or_prefix(spark: SparkSession, sf: str) -> DataFrame:
    i = index.symbol_index(rows.symbols(spark, sf))
    return context.search_or_prefix(index.lookup(i, "ring"), i, "re", 400)


@query(f"""WITH {u._SPEC}, n AS (SELECT band, region, token AS other, least(count(*), CASE WHEN band = 3 THEN {match.BUCKET_FILE} ELSE {match.BUCKET} END) AS n FROM placed GROUP BY band, region, token),
 l AS (SELECT p.band, n, CASE WHEN p.band <> 3 THEN 1000000 WHEN class_scoped THEN CASE WHEN n >= 260 THEN 120 WHEN n >= 220 THEN 140 WHEN n >= 180 THEN 160 WHEN n >= 140 THEN 180 ELSE 220 END
   ELSE CASE WHEN n >= 260 THEN 140 WHEN n >= 220 THEN 160 WHEN n >= 180 THEN 180 WHEN n >= 140 THEN 220 ELSE 260 END END AS cap FROM placed p JOIN comp c ON p.token = c.token JOIN n ON n.band = p.band AND n.region = p.region AND n.other = c.other)
 SELECT band, count(*) AS lookups, sum(least(n, cap))::BIGINT AS probes, count(*) FILTER (n > cap) AS capped FROM l GROUP BY 1""")
def probe_counts(spark: SparkSession, sf: str) -> DataFrame:
    x = u.units(spark, sf)
    return match.probe_counts(x, census.bands(x))


def capped_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ten users' files hold all events, so lists are long and the probe caps of the file scope bind."""
    return event_units(u.events(spark, sf).withColumn("user_id", F.col("user_id") % 10))


_BIG = u._SPEC.replace(event_units_sql(), event_units_sql().replace("user_id", "user_id % 10").replace("'/u' || user_id % 10::VARCHAR", "'/u' || (user_id % 10)::VARCHAR").replace("((user_id % 10) % 10)", "(user_id % 10)").replace("(user_id % 10 % 10)", "(user_id % 10)"))


@query(f"WITH {_BIG} SELECT * FROM edges")
def keylock_capped_edges(spark: SparkSession, sf: str) -> DataFrame:
    b = capped_files(spark, sf)
    return match.edges(b, census.bands(b))

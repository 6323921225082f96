"""Task descriptions, prompts and staged context as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from keylattice.functions import ids, vocab

_FILE = r"(?i)(?<![\w/.-])([\w./-]+\.(?:cc|cpp|cs|c|go|hpp|h|java|jsx|js|kt|lua|php|py|rb|rs|scala|tsx|ts))(?![\w/.-])"
_PACKAGE = r"(?i)\b([a-z0-9_.-]+(?:/[a-z0-9_.-]+)+)\b"
_HINTS = {
    "ast": "ast|build tag|embed|generics|//go:build|parser|struct|type param", "call_graph": "call graph|chan|deadlock|fanout|goroutine|race|select|waitgroup",
    "interfaces": "contract|implements|interface|mock|satisfies|satisfy", "module": "across packages|architecture|blast radius|boundary|cross-package|module",
    "repo_scope": "across repository|entire codebase|entire repo|global architecture|repo-wide|whole codebase",
}
_NOT_SYMBOLS = "what where which when why does from with that this".split()


def term_match(text: Column, term: str, strict: bool = False) -> Column:
    """A phrase anywhere; a word where no backslash or letter w touches it (or, strictly, no word character does)."""
    if " " in term:
        return text.contains(term)
    edge = r"\w" if strict else r"\\w"
    # most texts lack most terms: a plain search spares them the pattern
    return text.contains(term) & text.rlike(rf"(?<![{edge}]){re.escape(term)}(?![{edge}])")


def terms_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, v in vocab.TASK_TERMS.items() for t in vocab.terms(v)], "token string, term string")


def task_fingerprint(tasks: DataFrame, top: int = 8) -> DataFrame:
    """(task_id, tokens, confidence, status) of tasks (task_id, task)."""
    low = F.lower(F.trim("task"))
    hits = F.array(*(F.struct(sum(F.when(term_match(low, t), 1).otherwise(0) for t in vocab.terms(v)).alias("n"), F.lit(k).alias("token")) for k, v in vocab.TASK_TERMS.items()))
    vague = sum(F.when(term_match(low, t), 1).otherwise(0) for t in vocab.terms(vocab.VAGUE_TERMS))
    s = tasks.select("task_id", vague.alias("vague"), F.filter(hits, lambda x: x["n"] > 0).alias("h"))
    # score grows with n up to its cap, so (score, n, token) descending is (n, token) descending
    best = F.slice(F.reverse(F.array_sort("h")), 1, top)
    s = s.withColumn("best", best).withColumn("evidence", F.aggregate("h", F.lit(0), lambda a, x: a + x["n"]))
    k = F.size("best")
    raw = F.when(k > 0, 0.28 + 0.08 * k + 0.05 * (F.col("evidence") / F.greatest(k, F.lit(1)))).otherwise(0.1) - F.when((F.col("vague") > 0) & (k <= 2), 0.12).otherwise(0.0)
    c = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), raw)), 2)
    status = F.when((k == 0) | (c < 0.35), "insufficient_signal").when(c < 0.55, "ambiguous").otherwise("ok")
    return s.select("task_id", F.array_join(F.transform("best", lambda x: x["token"]), ",").alias("tokens"), c.alias("confidence"), status.alias("status"))


def classify_prompt(prompts: DataFrame) -> DataFrame:
    """Scope, confidence and needs of prompts (prompt_id, prompt)."""
    p = F.trim("prompt")
    low = F.lower(p)
    need = {k: low.rlike("|".join(map(re.escape, v.split("|")))) for k, v in _HINTS.items()}
    file_hint = ids.normal_path(F.regexp_extract(p, _FILE, 1))
    package = F.filter(F.regexp_extract_all(p, F.lit(_PACKAGE), F.lit(1)), lambda x: ~x.endswith(".go"))
    package_hint = ids.normal_path(F.coalesce(F.try_element_at(package, F.lit(1)), F.lit("")))
    symbols = F.filter(F.regexp_extract_all(p, F.lit(r"\b([A-Za-z][A-Za-z0-9_]{2,})\b"), F.lit(1)), lambda x: ~F.lower(x).isin(*_NOT_SYMBOLS))
    scope = F.when(file_hint != "", "file").when(package_hint != "", "package").when(need["repo_scope"], "repository").when(need["module"], "module").otherwise("package")
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    confidence = (
        0.25 + add(file_hint != "", 0.2) + add(package_hint != "", 0.15) + add(need["ast"], 0.12) + add(need["call_graph"], 0.16)
        + add(need["interfaces"], 0.12) + add(need["module"], 0.08) + add(need["repo_scope"], 0.05)
    )
    signals = F.concat_ws(",", *(F.when(need[k], k) for k in ("ast", "call_graph", "interfaces", "module", "repo_scope")), F.when(file_hint != "", "file_anchor"), F.when(package_hint != "", "package_anchor"))
    return prompts.select(
        "prompt_id", scope.alias("scope"), F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), confidence)), 2).alias("confidence"), file_hint.alias("focal_file"), package_hint.alias("package_hint"),
        F.coalesce(F.try_element_at(symbols, F.lit(1)), F.lit("")).alias("focal_symbol"), signals.alias("signals"),
    )


def package_scope(focal_file: Column, package_hint: Column) -> Column:
    parent = ids.normal_path(ids.parent_of(focal_file))
    return F.when(focal_file != "", F.when(parent == ".", "").otherwise(parent)).otherwise(package_hint)


def confidence_gain(unresolved: Column, coverage: Column, ambiguity: Column, bonus: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * unresolved + 0.4 * (1 - coverage) + 0.2 * ambiguity + F.when(bonus, 0.25).otherwise(0.0))), 3)


def context_tier(gain: Column) -> Column:
    return F.when(gain >= 0.85, "repository").when(gain >= 0.65, "module").when(gain >= 0.4, "package").otherwise("file")


def architecture_summary(clusters: DataFrame, members: DataFrame, seams: DataFrame, scope: str = "") -> DataFrame:
    """Clusters with a file in the scope: how many, their members, and the seams that touch them."""
    from keylattice.operators.graph import seams_for

    own = members.where(F.col("file").startswith(scope)).select("root").distinct()
    c = clusters.join(own, "root", "left_semi")
    return c.agg(F.count("*").alias("clusters"), F.sum("size").alias("units")).crossJoin(seams_for(own, seams).agg(F.count("*").alias("seams")))


def cluster_of_file(members: DataFrame, clusters: DataFrame, file: str) -> DataFrame:
    own = members.where(F.col("file") == file).select("root").distinct()
    return clusters.join(own, "root", "left_semi").orderBy(F.desc("size"), F.desc("probability"), "root")


def boundary_edges(bridges: DataFrame, roots: DataFrame, limit: int = 12) -> DataFrame:
    """Refused merges that touch the clusters, strongest first."""
    r = roots.select("root").distinct()
    hit = bridges.join(r, bridges["from_root"] == r["root"], "left_semi").union(bridges.join(r, bridges["to_root"] == r["root"], "left_semi")).distinct()
    return hit.orderBy(F.desc("confidence"), F.desc("refused_at_size"), "trigger_source", "trigger_target").limit(limit)


def impact_top_clusters(impacted: DataFrame, members: DataFrame, top: int = 10) -> DataFrame:
    return impacted.join(members, "unit_id").groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(top)


def search_symbols(units: DataFrame, indexed: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Index hits first, then ids that contain the query, to the limit."""
    hit = indexed.select("unit_id").withColumn("way", F.lit(0))
    rest = units.where(F.lower("unit_id").contains(query.lower())).select("unit_id").withColumn("way", F.lit(1))
    return hit.union(rest).groupBy("unit_id").agg(F.min("way").alias("way")).orderBy("way", "unit_id").limit(limit)


def read_source(files: DataFrame, units: DataFrame, most: int = 160) -> DataFrame:
    """The lines of each unit, at most ``most``, from files (file, text)."""
    safe = ~F.col("file").startswith("/") & ~F.col("file").rlike(r"(?:^|/)\.\.(?:/|$)")
    last = F.least(F.col("line_end"), F.col("line_start") + most - 1)
    lines = F.slice(F.split("text", "\n"), F.col("line_start").cast("int"), F.greatest(F.lit(0), (last - F.col("line_start") + 1)).cast("int"))
    return units.where(safe & (F.col("line_start") > 0)).join(files, "file").select("unit_id", F.array_join(lines, "\n").alias("source"))


def curator_candidates(snippets: DataFrame, pool_tokens: DataFrame) -> DataFrame:
    """Vocabulary extensions that unresolved snippets (snippet) suggest, with evidence and confidence."""
    name = F.coalesce(*(F.when(F.col("snippet").rlike(f"(?i){p}"), n) for n, p in vocab.EXTENSIONS))
    s = snippets.withColumn("token_name", name).where("token_name is not null")
    g = s.groupBy("token_name").agg(F.count("*").alias("evidence"), F.array_join(F.slice(F.array_sort(F.collect_set("snippet")), 1, 5), " | ").alias("examples")).where("evidence >= 2")
    related = F.when(F.col("token_name") == "MEMOIZE", "FETCH").when(F.col("token_name") == "ORCHESTRATE", "DELEGATE").when(F.col("token_name") == "RETRY", "RECOVER")
    g = g.withColumn("related", related).join(F.broadcast(pool_tokens.where("n >= 2").select(F.col("token").alias("related"), F.lit(True).alias("odd"))), "related", "left")
    base = F.least(F.lit(0.85), 0.5 + 0.04 * F.col("evidence"))
    c = F.round(F.when(F.col("odd"), F.least(F.lit(0.92), base + 0.1)).otherwise(base), 3)
    zone = F.col("token_name").isin(*vocab.EXTENSION_ZONE)
    action = F.when((c >= 0.8) & zone, "PROMOTE").when(c >= 0.6, "REVIEW").otherwise("WATCH")
    return g.select("token_name", "evidence", c.alias("confidence"), zone.alias("in_zone"), action.alias("action"), "examples").where("confidence >= 0.6")


def twin_context(units: DataFrame, members: DataFrame, seams: DataFrame, tokens: list[str], task_confidence: float, top: int = 3, least: float = 0.25) -> DataFrame:
    """What a task's tokens call for: its twins, how sure they are, where to begin, and the cluster most coupled with that.

    One row a twin; none without a twin.  The anchor is the member of the best
    twin's cluster that shares most with the task."""
    from keylattice.operators.graph import behavioral_twins, gate_twins

    task = F.array(*map(F.lit, tokens))
    twins = behavioral_twins(units, task, top, least)
    order = Window.orderBy(F.desc("score"), F.desc("shared"), F.desc("confidence"), F.desc("unit_id"))  # over ``top`` rows
    ranked = twins.withColumn("rank", F.row_number().over(order))
    best = ranked.where("rank = 1").join(members.select("unit_id", "root"), "unit_id").select("root", F.col("score").alias("best"))
    own = members.join(F.broadcast(best), "root")
    shared = F.size(F.array_intersect(F.array_distinct("tokens"), task))
    anchor = own.groupBy("root").agg(F.max_by("unit_id", F.struct(shared.alias("n"), "confidence", "unit_id")).alias("anchor_unit"))
    near = seams.join(F.broadcast(best), (F.col("source_cluster") == F.col("root")) | (F.col("target_cluster") == F.col("root")))
    other = F.when(F.col("source_cluster") == F.col("root"), F.col("target_cluster")).otherwise(F.col("source_cluster"))
    strongest = near.groupBy("root").agg(F.min_by(other, F.struct(-F.col("edge_count"), -F.col("max_confidence"), "source_cluster", "target_cluster")).alias("related_cluster"))
    found = best.join(anchor, "root").join(strongest, "root", "left").crossJoin(ranked.agg(F.count("*").alias("n")))
    gate = gate_twins(F.col("n"), F.lit(task_confidence), F.col("best"))
    gated = found.select(gate.alias("gate"), F.when(gate == "none", "needs_more_context").otherwise("ready_for_delta_generation").alias("status"), "anchor_unit", "related_cluster")
    return ranked.select("rank", "unit_id", "score", "shared").crossJoin(F.broadcast(gated))


def _gain(found: Column, unresolved: Column, coverage: Column, ambiguity: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.4 * unresolved + 0.4 * (1 - coverage) + 0.2 * ambiguity + F.when(found, 0.0).otherwise(0.25)), 3)


def guided_steps(prompts: DataFrame) -> DataFrame:
    """The staged context of prompts: which tiers are read, and the gain that is left.

    prompts: prompt_id, scope, signals (of ``classify_prompt``), confidence,
    focal_file, package_hint, and whether the focal file or symbol is found."""
    has = lambda x: F.array_contains(F.split("signals", ","), x)
    found, by_file = F.col("found"), F.col("focal_file") != ""
    calls = has("call_graph")
    pick = lambda c, a, b: F.when(c, a).otherwise(b)
    first = _gain(found, pick(found, 0.0, 1.0), pick(found, 0.7, 0.2), pick(calls, 0.6, 0.35))
    p = prompts.withColumn("g1", first)
    package = (F.col("g1") >= 0.4) | F.col("scope").isin("package", "module", "repository")
    second = _gain(found, F.lit(0.0), pick(found, 0.85, 0.6), pick(calls, 0.45, 0.25))
    p = p.withColumn("package", package).withColumn("g2", F.when(F.col("package"), second).otherwise(F.col("g1")))
    module = (F.col("g2") >= 0.65) | F.col("scope").isin("module", "repository") | calls | has("interfaces")
    p = p.withColumn("module", module).withColumn("gain", F.when(F.col("module"), _gain(F.lit(True), F.lit(0.0), F.lit(0.92), F.lit(0.15))).otherwise(F.col("g2")))
    whole = has("repo_scope") & ((F.col("confidence") >= 0.85) | ((F.col("scope") == "repository") & (F.col("confidence") >= 0.65)))
    steps = F.concat_ws(
        ",", F.when(by_file, "cluster_of_file").otherwise("search_symbols"), F.when(by_file & found, "boundary_edges"), F.when(F.col("package"), "architecture_summary"),
        F.when(F.col("module"), "impact_neighbors"), F.when(F.col("module"), "high_coupling_seams"), F.when(whole, "repository_summary"),
    )
    return p.select("prompt_id", "scope", steps.alias("steps"), "gain")


def search_or_prefix(exact: DataFrame, index: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """Exact hits (unit_id) first, then those of tokens that begin so, each unit once, to the limit."""
    hit = exact.select("unit_id").withColumn("way", F.lit(0))
    rest = index.where(F.col("token").startswith(prefix.lower())).select("unit_id").withColumn("way", F.lit(1))
    return hit.union(rest).groupBy("unit_id").agg(F.min("way").alias("way")).orderBy("way", "unit_id").limit(limit)

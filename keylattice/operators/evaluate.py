"""Measures of clusterings, risk scores and report rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def pairwise_prf(c: DataFrame) -> DataFrame:
    """Precision, recall and F1 over pairs of items (item, pred, truth), from contingency counts: no pair is formed."""
    cell = c.groupBy("pred", "truth").agg(F.count("*").alias("n"))
    both = cell.agg(F.sum(_choose2(F.col("n"))).alias("tp"))
    pred = cell.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(_choose2(F.col("n"))).alias("pp"))
    truth = cell.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(_choose2(F.col("n"))).alias("tt"))
    t = both.crossJoin(pred).crossJoin(truth)
    p = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(F.lit(0.0))
    r = F.when(F.col("tt") > 0, F.col("tp") / F.col("tt")).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return t.select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


def mojofm(c: DataFrame) -> DataFrame:
    """Effort to turn one clustering into the other, as a share of the worst."""
    cell = c.groupBy("pred", "truth").agg(F.count("*").alias("n"))
    best = Window.partitionBy("pred").orderBy(F.desc("n"), "truth")
    top = cell.withColumn("size", F.sum("n").over(Window.partitionBy("pred"))).withColumn("_r", F.row_number().over(best)).where("_r = 1")
    moves = top.agg((F.sum(F.col("size") - F.col("n")) + F.count("*") - F.countDistinct("truth")).alias("mno"), F.sum("size").alias("items"))
    largest = cell.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.max("n").alias("largest"))
    rest = F.col("items") - F.col("largest")
    return moves.crossJoin(largest).select(F.round(F.when(rest > 0, 1 - F.col("mno") / rest).otherwise(F.lit(1.0)), 4).alias("mojofm"))


def majority_cluster(members: DataFrame) -> DataFrame:
    """The commonest cluster of each file; ties to the smallest id."""
    n = members.groupBy("file", "root").agg(F.count("*").alias("n"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "root"))).where("_r = 1").select("file", "root", "n")


def layout_clusters(files: DataFrame, depth: int = 1, split: tuple[str, ...] = ()) -> DataFrame:
    """Ground truth by path prefix; folders in ``split`` are taken one level deeper."""
    parts = F.split("file", "/")
    head = F.array_join(F.slice(parts, 1, depth), "/")
    deeper = F.array_join(F.slice(parts, 1, depth + 1), "/")
    return files.select("file", (F.when(head.isin(*split), deeper).otherwise(head) if split else head).alias("truth")).distinct()


def risk_score(max_seam: Column, impacted: Column, seams: Column, clusters: Column) -> Column:
    return F.least(F.lit(100), F.least(F.lit(35), 4 * max_seam) + F.least(F.lit(35), impacted) + F.least(F.lit(15), 3 * seams) + F.when(clusters == 0, 10).otherwise(0) + F.least(F.lit(5), clusters)).cast("int")


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def file_risk(members: DataFrame, seams: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Risk of every changed file: its clusters, the seams that touch them, and units one hop away."""
    f = changed.select("file").distinct()
    own = members.join(f, "file").select("file", "root").distinct()
    if "source_file" in seams.columns:
        touch = seams.select(F.explode(F.array_distinct(F.array("source_file", "target_file"))).alias("file"), "edge_count")
    else:
        touch = seams.select(F.explode(F.array("source_cluster", "target_cluster")).alias("root"), "source_cluster", "target_cluster", "edge_count")
        touch = own.join(touch, "root").select("file", "source_cluster", "target_cluster", "edge_count").distinct()
    s = touch.groupBy("file").agg(F.count("*").alias("seams"), F.max("edge_count").alias("max_seam"))
    end = lambda file, near: F.struct(file.alias("file"), F.col(near).alias("near"))
    if "source_file" in edges.columns:
        near = edges.select(F.explode(F.array(end(F.col("source_file"), "target_id"), end(F.col("target_file"), "source_id"))).alias("x")).select("x.*")
    else:
        both = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("unit_id"), F.col("target_id").alias("near")), F.struct(F.col("target_id").alias("unit_id"), F.col("source_id").alias("near")))).alias("x")).select("x.*")
        near = members.join(f, "file").select("file", "unit_id").join(both, "unit_id").select("file", "near")
    hit = near.distinct().groupBy("file").agg(F.count("*").alias("impacted"))
    n = own.groupBy("file").agg(F.count("*").alias("clusters"))
    r = f.join(n, "file", "left").join(s, "file", "left").join(hit, "file", "left").na.fill(0)
    score = risk_score(F.col("max_seam"), F.col("impacted"), F.col("seams"), F.col("clusters"))
    return r.select("file", "clusters", "seams", "max_seam", "impacted", score.alias("score"), risk_level(score).alias("level"))


def nearest_rank(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles at rank round((n - 1) * p), with average and maximum."""
    w = Window.partitionBy(group)
    r = df.where(F.col(value).isNotNull()).select(group, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    return r.groupBy(group).agg(*(F.max(F.when(F.col("_i") == F.bround((F.col("_n") - 1) * p, 0), F.col(value))).alias(k) for k, p in shares.items()), F.round(F.avg(value), 6).alias("avg"), F.max(value).alias("max"))


def rollup(runs: DataFrame, value: str = "value") -> DataFrame:
    """Mean and median by mode and by (repo, mode); a run can be in several modes."""
    each = runs.select("repo", F.explode("modes").alias("mode"), value)
    stat = (F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("median"))
    return each.groupBy("mode").agg(*stat).select(F.lit("*").alias("repo"), "mode", "n", "mean", "median").union(each.groupBy("repo", "mode").agg(*stat))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ratio of two timings by name."""
    return before.select("name", F.col("seconds").alias("b")).join(after.select("name", F.col("seconds").alias("a")), "name").select("name", F.round(F.col("b") / F.col("a"), 4).alias("speedup"))


def relaxed_score(text: Column, anchor: str, weight: float, most: float) -> Column:
    """Capped bonus for lines with an anchor."""
    return F.least(F.lit(float(most)), F.regexp_count(text, F.lit(f"(?m)^.*(?:{anchor}).*$")) * F.lit(float(weight)))


def rubric(text: Column, checks: dict[str, str]) -> Column:
    """Share of a checklist of patterns that a text meets, in per cent."""
    hits = sum(F.when(text.rlike(p), 1).otherwise(0) for p in checks.values())
    return F.round(100 * hits / len(checks), 1)


def risk_report(risks: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` files by risk, each beside the overall score and level, which are the largest file's."""
    overall = risks.agg(F.coalesce(F.max("score"), F.lit(0)).alias("overall"))
    best = risks.orderBy(F.desc("score"), "file").limit(top).select("file", "score", "level")
    return best.crossJoin(F.broadcast(overall)).withColumn("overall_level", risk_level(F.col("overall")))

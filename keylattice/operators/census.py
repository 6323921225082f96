"""Token census: how many units and files have each token, and the scope band that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from keylattice.functions import vocab

#: Below so many units the fixed bands hold.
SMALL = 500


def token_census(units: DataFrame) -> DataFrame:
    """Every token of the vocabulary with its unit count, file count and share of files, zeros included."""
    spark = units.sparkSession
    # units of a file with the same tokens count at once; one aggregation to (token, file) feeds both counts
    alike = units.groupBy("file", "tokens").agg(F.count("*").alias("n"))
    per_file = alike.select("file", "n", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token", "file").agg(F.sum("n").alias("n"))
    counts = per_file.groupBy("token").agg(F.sum("n").alias("unit_count"), F.count("*").alias("file_count"))
    total = alike.agg(F.countDistinct("file").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("units"))
    all_tokens = F.broadcast(vocab.tokens_df(spark).select("token", "ord", "small_band"))
    rows = counts.join(all_tokens, "token", "right").na.fill(0, ["unit_count", "file_count"])
    return rows.crossJoin(F.broadcast(total)).withColumn("file_pct", F.when(F.col("files") > 0, F.col("file_count") / F.col("files")).otherwise(F.lit(0.0)))


def bands(units: DataFrame) -> DataFrame:
    """Band of every token: the stricter of its share of files and its rank among tokens; fixed bands for small inputs."""
    c = token_census(units)
    rank = F.row_number().over(Window.orderBy("unit_count", "ord")) - 1  # over the 29 tokens
    c = c.withColumns({
        "band_file": F.when(F.col("file_pct") < 0.01, 1).when(F.col("file_pct") < 0.10, 2).otherwise(3),
        "band_pct": F.when(rank < len(vocab.TOKENS) // 3, 1).when(rank < 2 * len(vocab.TOKENS) // 3, 2).otherwise(3),
        "used_defaults": F.col("units") < SMALL,
    })
    return c.withColumn("band", F.when(F.col("used_defaults"), F.col("small_band")).otherwise(F.least("band_file", "band_pct"))).select(
        "token", "unit_count", "file_count", "file_pct", "band_file", "band_pct", "band", "used_defaults"
    )

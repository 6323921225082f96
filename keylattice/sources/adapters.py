"""Plain tables as units: an id with an ordered set of behaviour tokens, a place, a confidence.

A unit table has ``seq`` (canonical order), ``unit_id``, ``file``, ``cls``,
``dir3``, ``line_start``, ``line_end``, ``language``, ``confidence``, ``tokens``.
Adapters are projections, so filters and column pruning reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keylattice.functions import ids

#: event type -> tokens
EVENT_TOKENS = {"view": "FETCH OUTPUT", "click": "INTAKE EMIT", "purchase": "PERSIST OUTPUT", "signup": "INIT SUBSCRIBE VALIDATE", "error": "RAISE GUARD"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complete(units: DataFrame) -> DataFrame:
    """Add the columns that follow from ``unit_id``."""
    return units.withColumns({"file": ids.file_of("unit_id"), "cls": ids.class_of("unit_id")}).withColumn("dir3", ids.dir3_of("file"))


def event_units(events: DataFrame, route_above: float = 100, by_day: bool = False) -> DataFrame:
    """Users (or, by day, users' days) are files, event types are classes, events are members."""
    day = F.concat(F.lit("/d"), F.dayofmonth("ts").cast("string")) if by_day else F.lit("")
    base = F.coalesce(*(F.when(F.col("event_type") == e, F.array(*map(F.lit, t.split()))) for e, t in EVENT_TOKENS.items()), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    k = F.get_json_object("props", "$.k").cast("int")
    return complete(
        events.select(
            F.col("event_id").alias("seq"),
            F.concat_ws("::", F.concat(F.lit("g"), (F.col("user_id") % 10).cast("string"), F.lit("/u"), F.col("user_id").cast("string"), day), "event_type", F.col("event_id").cast("string")).alias("unit_id"),
            F.concat(base, F.when(F.col("value") > route_above, F.array(F.lit("ROUTE"))).otherwise(none), F.when(k % 7 == 0, F.array(F.lit("AUTHENTICATE"))).otherwise(none)).alias("tokens"),
            F.unix_timestamp(F.date_trunc("second", "ts")).alias("line_start"),
            (F.unix_timestamp(F.date_trunc("second", "ts")) + 10).alias("line_end"),
            F.lit("python").alias("language"),
            F.round(0.4 + 0.1 * (F.col("event_id") % 7), 2).alias("confidence"),
        )
    )


_CASES = " ".join(f"WHEN '{e}' THEN [{', '.join(repr(x) for x in t.split())}]" for e, t in EVENT_TOKENS.items())


def event_units_sql(where: str = "true", route_above: float = 100, by_day: bool = False) -> str:
    """The same projection for DuckDB."""
    day = "'/d' || day(ts)::VARCHAR || " if by_day else ""
    return f"""(
  SELECT event_id AS seq, unit_id, tokens, line_start, line_end, language, confidence, split_part(unit_id, '::', 1) AS file,
         event_type AS cls, split_part(unit_id, '::', 1) AS dir3
  FROM (SELECT event_id, event_type, 'g' || (user_id % 10)::VARCHAR || '/u' || user_id::VARCHAR || {day}'::' || event_type || '::' || event_id::VARCHAR AS unit_id,
          list_concat(list_concat(CASE event_type {_CASES} ELSE []::VARCHAR[] END, CASE WHEN value > {route_above} THEN ['ROUTE'] ELSE [] END),
                      CASE WHEN (props::JSON->>'k')::INT % 7 = 0 THEN ['AUTHENTICATE'] ELSE [] END) AS tokens,
          epoch(date_trunc('second', ts))::BIGINT AS line_start, epoch(date_trunc('second', ts))::BIGINT + 10 AS line_end, 'python' AS language,
          round(0.4 + 0.1 * (event_id % 7), 2)::DOUBLE AS confidence FROM events WHERE {where}))"""

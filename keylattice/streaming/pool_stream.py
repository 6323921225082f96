"""Streaming forms of the pool, of islands and of rollups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keylattice.operators.pool import AGE

_OUT = "source_id string, token string, state string, at double"
_STATE = "ingested double, resolved boolean, boundary boolean"


def pool_lifecycle(events: DataFrame, age_s: int = AGE, late: str = "1 hour") -> DataFrame:
    """Transitions of each (source, token) of an event stream (ts, source_id, token, action: suspend or resolve).

    A first suspension makes it pending, a resolution resolves it, and an
    event-time timer makes it a boundary once the watermark is ``age_s`` beyond
    its ingestion."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            ingested = state.get[0]
            state.remove()
            out.append((*key, "boundary", ingested + age_s))
        else:
            rows = pd.concat(list(frames)).sort_values("ts")
            for r in rows.itertuples():
                at = r.ts.timestamp()
                if r.action == "suspend" and (not state.exists or state.get[1]):
                    state.update((at, False, False))
                    out.append((*key, "pending", at))
                elif r.action == "resolve" and state.exists and not state.get[1]:
                    state.update((state.get[0], True, False))
                    out.append((*key, "resolved", at))
            if state.exists and not state.get[1]:
                due = int((state.get[0] + age_s) * 1000)
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["source_id", "token", "state", "at"])

    keyed = events.withWatermark("ts", late).groupBy("source_id", "token")
    return keyed.applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def incremental_scan(files: DataFrame, out: str, checkpoint: str, scan: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Scan the files of a stream (file, text, language) as they come, and keep the last units of each file in ``out``.

    The checkpoint plays the cache's part: a file that was read isn't read
    again.  Each batch writes a version of its own, so a batch that is repeated
    after a failure replaces itself; ``latest_units`` reads the result."""

    def each(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{out}/units/batch={number}")
        batch.select("file").distinct().write.mode("overwrite").parquet(f"{out}/files/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_units(spark: SparkSession, out: str) -> DataFrame:
    """The units of the last batch that read each file."""
    last = spark.read.parquet(f"{out}/files").groupBy("file").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/units").join(last, ["file", "batch"], "left_semi")


def session_islands(events: DataFrame, gap_s: str = "radar", late: str = "1 hour") -> DataFrame:
    """Islands of a stream (ts, file, radar seconds): sessions with a gap of each row's own length."""
    gap = F.concat(F.col(gap_s).cast("string"), F.lit(" seconds"))
    return events.withWatermark("ts", late).groupBy("file", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("units")).select("file", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "units")


def telemetry_stream(events: DataFrame, late: str = "1 day", days: int = 7) -> DataFrame:
    """Events by window and kind, once the watermark has passed the window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days").alias("w"), "kind").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "kind", "events")

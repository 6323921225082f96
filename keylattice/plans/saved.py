"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names.

Every executor reads that folder, so losing one loses no table.  A folder of
our own is made only where the setting is absent and the session runs on this
machine alone; on a cluster without the setting an error is raised.  The tables
are removed when the program ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster can reach")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="keylattice-")
    return _own[app]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: the lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/keylattice/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended first
            return

"""Storage and partition helpers for the text operators.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``, which every executor can read, so a lost executor
costs a recomputed task and never a lost table.  A folder of our own is made
only where the setting is absent and the session runs on this machine alone
(tests); on a cluster without the setting an error is raised.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

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
        _own[app] = tempfile.mkdtemp(prefix="keylattice-")
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; removed when the program ends."""
    path = f"{shared_dir(spark)}/keylattice/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name like this one that none of these (whatever their case) clashes with."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write the table to the shared folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended first
            return

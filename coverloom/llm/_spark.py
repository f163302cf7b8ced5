"""Helpers that the operators share: tables in the cluster's shared folder, bounded batches, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch on its way to a worker.
BATCH_BYTES = 4 << 20
#: Keys that hold more than one HEAVY-th of all rows are joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 20_000

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one, on a single machine only."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "root" not in _LOCAL:
        _LOCAL["root"] = tempfile.mkdtemp(prefix="coverloom-")
        atexit.register(shutil.rmtree, _LOCAL["root"], ignore_errors=True)
    return "file://" + _LOCAL["root"]


def tables_root(spark: SparkSession) -> str:
    """Where this application's tables lie; the folder may be deleted when its results have been written."""
    return f"{shared_root(spark)}/coverloom-{spark.sparkContext.applicationId}"


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, label: str, release: bool = False, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: what follows restarts from there if an executor is lost.

    With `release`, the shuffles of the write go as soon as the table stands; df must not be computed again.
    """
    spark = df.sparkSession
    path = f"{tables_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, str(release or before == "true").lower())
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._coverloom_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Deletes tables written by table() once nothing reads them any more."""
    for df in tables:
        _delete(df.sparkSession, df._coverloom_path)


def drop_tables(spark: SparkSession) -> None:
    """Deletes every table that this application has left; results that read them must have been written before."""
    _delete(spark, tables_root(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """df.mapInArrow, with the session's batches bounded by bytes, so that long texts don't fill a worker."""
    spark = df.sparkSession
    reachable(spark)
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > batch_bytes:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return df.mapInArrow(run, schema)


def small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """A broadcast hint, if the counted rows are within the bound; else the join is left to shuffle."""
    return F.broadcast(df) if rows <= max_rows else df


def join_counted(rows: DataFrame, counts: DataFrame, key: str, n: str, total: int, columns: list[str | Column], counted: str) -> DataFrame:
    """`columns` of rows with the row of `counts` whose `counted` is their `key`; rows without one go. Both are tables.

    `n` counts the key's rows among `total`. Keys that hold a HEAVY-th of them and more are broadcast, less
    than HEAVY in number, so that no task gets the rows of a frequent key; all others meet in a shuffle.
    """
    least = total // HEAVY + 1
    same = F.col(key) == F.col(counted)
    heavy, light = counts.where(F.col(n) >= least), counts.where(F.col(n) < least)
    first = rows.join(F.broadcast(heavy), same).select(*columns)
    rest = rows.join(F.broadcast(heavy.select(counted)), same, "left_anti")
    return first.unionByName(rest.join(light, same).select(*columns))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, one for each of `names`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package, where the session was started without it on its path."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""SparkSession settings that suit the engine, and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the cluster's own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUILLSTONE_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session whose executors live in the driver's JVM may fall back on the machine's temporary
    folder; anywhere else a missing setting is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"file://{tempfile.gettempdir()}/quillstone-{os.getpid()}"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of an Arrow batch, at most, from now on in this session. Texts are long: the usual ten thousand of
    them are held several times over by every worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


#: Tables that written() has made and nothing has deleted yet, and the innermost scope that takes note of them.
_MADE: dict[str, SparkSession] = {}
_SCOPES: list[list[str]] = []


def written(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there, and lost
    executors lose nothing of it. keep: the table outlives the scope in which it is made."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillstone_path = path
    _MADE[path] = spark
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return out


def _delete(path: str) -> None:
    spark = _MADE.pop(path, None)
    if spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def alive(df: DataFrame) -> bool:
    """A table of written() that nothing has deleted."""
    return getattr(df, "_quillstone_path", "") in _MADE


def discard(df: DataFrame) -> None:
    """Delete a table made by written(); nothing that is still to run may read it."""
    _delete(getattr(df, "_quillstone_path", ""))


@contextmanager
def scratch():
    """Tables made inside are deleted at its end, but for those that are kept: what is returned must be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(path)


def reclaim(spark: SparkSession) -> None:
    """Shuffle files that no table refers to are deleted: Spark does so where the driver's JVM collects its garbage, which a
    driver with little to do may not do for long, while disks fill."""
    gc.collect()
    spark._jvm.System.gc()


def sweep() -> None:
    """Delete all tables that operators have written in this process: once the results that read them are stored."""
    for path in list(_MADE):
        _delete(path)

"""Session helpers shared by the plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the reliable checkpoint folder.

    Used where several actions read the same rows (checks, then writes), so that
    a lost executor re-reads files instead of re-running the import. The folder
    is the session's ``spark.checkpoint.dir``; only a local session without one
    gets a scratch folder.
    """
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the folder set on its context."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        found = tempfile.mkdtemp(prefix="recordloom-checkpoint-")
        context.setCheckpointDir(found)
    return found


def new_name() -> str:
    """A name that nothing has yet."""
    return uuid.uuid4().hex


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing is at yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{new_name()}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes started inside leave no shuffle files: each execution's go when it ends.

    Otherwise they stay until the driver's garbage collection finds them, and a run of
    several steps holds the shuffles of all its steps at once. What was written is read
    from its files, so nothing needs them again; were a plan run a second time, Spark
    would make them anew.
    """
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Unlike a checkpoint, what is read again is pruned to the columns a plan needs. The
    shuffle files of the write go with its end, the written files when the driver ends.
    """
    if not _WRITTEN:
        atexit.register(_remove_written)
    path = new_path(df.sparkSession, name)
    _WRITTEN.append(path)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _WRITTEN:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def session(name: str = "recordloom") -> SparkSession:
    """A session with the settings the operators rely on."""
    return (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )

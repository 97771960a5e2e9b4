"""Shared folder for intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
JIT_BYTES = "8000"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where it is unset and Spark runs in one process (tests, a laptop), a folder is made.
    A cluster needs the setting: its machines do not share temporary folders.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="marketlens-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/marketlens/{name}-{uuid.uuid4().hex}"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of a write go when it ends, not when the driver collects garbage: the table is all that is read later."""
    return _setting(spark, SHUFFLE_CLEANUP, "true")


def compiled_methods(spark: SparkSession) -> AbstractContextManager[None]:
    """For jobs over many computed columns, started inside. The JVM interprets methods above JIT_BYTES for good; a stage whose
    one method would be longer is then run operator by operator, whose shorter methods are compiled."""
    return _setting(spark, METHOD_LIMIT, JIT_BYTES)


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a result to the shared folder and read it back. `compression` names a codec other than the session's, for texts.

    Later steps then start from files instead of a long lineage, and Spark knows the
    size of the table, so that its own size check decides about broadcasting it.
    """
    path = new_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path, compression=compression)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read again. Only what `staged` returned can be removed."""
    for table in tables:
        path, jvm = table._staged_path, table.sparkSession._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)

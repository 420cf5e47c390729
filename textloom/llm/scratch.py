"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's address under spark.checkpoint.dir. Where that is unset, a temporary folder stands for it in a local session, as in tests; elsewhere that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/textloom-{uuid.uuid4().hex}"


def write(df: DataFrame) -> DataFrame:
    """Writes df and reads it back: lineage ends here, lost executors cost nothing written, and sizes are known to the planner."""
    folder = shared_folder(df.sparkSession)
    if (scope := _scope.get()) is not None:
        scope.append(folder)
    df.write.parquet(f"{folder}/table")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/table")


#: Folders of the scope that the calling thread is in; threads have scopes of their own.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Tables written inside are removed at the end; what is still needed must have been written by ``kept`` by then."""
    before = _scope.set(folders := [])
    try:
        yield
    finally:
        _scope.reset(before)
        hadoop = spark._jvm.org.apache.hadoop.fs
        for folder in folders:
            path = hadoop.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame) -> DataFrame:
    """As write, for a table that outlives the scope."""
    before = _scope.set(None)
    try:
        return write(df)
    finally:
        _scope.reset(before)

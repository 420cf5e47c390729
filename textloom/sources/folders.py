"""Folders that driver and executors share, and small files in them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
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


def written(df: DataFrame) -> DataFrame:
    """Writes df to a new shared folder and reads it back: it is computed once, and lost executors cost nothing of it."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Files:
    """The few operations on small files that a commit log needs, on any store that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self._hadoop, self._path = spark._jvm.org.apache.hadoop.fs, folder.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self._path}/{name}" if name else self._path)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it does not exist."""
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that must not exist yet; False if it does. Of several writers one succeeds; one that dies on the way leaves an empty file."""
        try:
            stream = self._fs.create(self._at(name), False)
        except Py4JJavaError as e:
            if "Exist" in e.java_exception.getClass().getName():
                return False
            raise
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

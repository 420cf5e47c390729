"""Sessions and settings. A setting that is not given has its default; one that is no number where a number is asked for is an error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Parameters of the library and of full scans; ``of`` reads those that a Spark setting ``textloom.<name>`` overrides.

    encoder: the name of a registered encoder. high: the score from which a detection comes with tips.
    """

    winnow_k: int = 5
    winnow_w: int = 4
    top_k: int = 3
    similarity: float = 0.75
    encoder: str = "hashed"
    high: int = 65

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {n: spark.conf.get(f"textloom.{n}", None) for n in cls.__annotations__}
        kinds = {n: type(getattr(cls, n)) for n in given}
        return cls(**{n: kinds[n](v) for n, v in given.items() if v is not None})


def bound_batches(spark: SparkSession | None = None, rows: int = 1000, size: str = "4m") -> None:
    """Lowers Spark's default limits of an Arrow batch, so that what a Python worker holds does not grow with the table; limits that somebody has set stay.

    spark: the session, or else the thread's own, for functions that make a column and see no table.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    for key, default, new in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(key, default) in (default, None):
            spark.conf.set(key, new)


def session(master: str = "local[*]", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; on a cluster the settings of spark-submit stand and only those that affect results are set here."""
    b = SparkSession.builder.master(master).appName("textloom")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

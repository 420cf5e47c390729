"""Tables of a folder of Parquet files, and CSV files.

Rows come as they are stored: nulls stay null, repeated rows stay, and a table
without rows is an empty table with its schema. An empty CSV field is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV file or folder with a header; types are inferred unless a schema is given."""
    return spark.read.options(header=True, **({} if "schema" in options else {"inferSchema": True})).csv(path, **options)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it comes in no more partitions than there are cores, as a single small file does; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df

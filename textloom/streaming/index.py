"""A library that grows with a stream of documents, and lookups of a stream in it.

Null and blank texts are not taken in and match nothing. Repeated rows of a
stream are documents added again. An empty batch commits nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import fingerprint, library
from textloom.operators.encoders import Encoder
from textloom.session import Settings


def grow_index(stream: DataFrame, folder: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), encoder: Encoder | None = None, **trigger) -> StreamingQuery:
    """Adds a stream of documents to the library in a folder, which additions of tables may grow too.

    A batch is committed under the stream's checkpoint and its own number: one that is run again after a failure is
    added once, and what a failed run left is never read.
    """

    def write(batch: DataFrame, number: int) -> None:
        library.Library(batch.sparkSession, folder).add(batch, id_col, text_col, encoder, settings, source=f"{checkpoint}:{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_index(spark: SparkSession, folder: str) -> library.References:
    """The library so far; each posting once."""
    return library.stored(spark, folder)


def scan_stream(stream: DataFrame, folder: str, target: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), **trigger) -> StreamingQuery:
    """Looks up a stream of documents in the library and writes a row per (query_id, doc_id) that share fingerprints, with similarity and totals, to target.

    All rows of a query come in one batch, so its result is complete with it and no state is kept over batches. Each batch
    sees the library as it is then, and joins its compacted postings as they lie. A batch that runs again replaces its
    own rows. Documents of one batch that share an id count as one.
    """

    def write(batch: DataFrame, number: int) -> None:
        references = library.stored(batch.sparkSession, folder, bucketed=True)
        found = fingerprint.lookup(batch, references.parts, id_col, text_col, settings.winnow_k, settings.winnow_w)
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_matches(spark: SparkSession, target: str) -> DataFrame:
    """What scan_stream has written so far."""
    return spark.read.parquet(target)


def match_stream(stream: DataFrame, postings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stream of (query_id, doc_id, pos): the stream's fingerprints joined to a static index. No state is kept."""
    q = fingerprint.fingerprints(stream, id_col, text_col).select(F.col(id_col).alias("query_id"), "hash")
    return q.join(postings, "hash").select("query_id", "doc_id", "pos")

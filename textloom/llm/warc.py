"""WARC archives: written as whole-file gzip streams, then normalised to a member a record with an index.

``write_archives`` gives each task files of about ``file_bytes`` of payload,
each one gzip stream. ``normalise`` inflates each such file once, in chunks,
splits it into records by their Content-Length, writes every record as a gzip
member of its own and a sidecar index (one line a record: offset, length, id).
``read_archives`` reads members by that index.

Of records with equal payloads of at least ``least`` bytes, the one with the
smallest id is a response that holds the payload; the others are revisits that
name it. Files go to a folder that driver and executors share, under names
that no other attempt of a task uses, and only files named in the table that a
finished job has written are read: a lost executor leaves at most a file that
nobody reads.

Edge cases: a null payload counts as empty. Null ids come after all others.
Rows that repeat the id of the response are responses too. Only the named
columns are read, so other columns cannot clash. An empty table gives an
empty result.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import scratch
from textloom.llm import textbytes as tb

LEAST = 100
FILE_BYTES = 64_000_000
CHUNK = 1 << 20
GZIP = 31
#: Fixed value: the date of all records, so that reruns agree.
DATE = "2000-01-01T00:00:00Z"


@contextlib.contextmanager
def opened(path: str, mode: str):
    """A file at a local path or an address that pyarrow knows. A file that is written appears when it is whole."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        name = unquote(url.path) if url.scheme else path
        if mode == "rb":
            with open(name, "rb") as f:
                yield f
            return
        os.makedirs(os.path.dirname(name), exist_ok=True)
        part = f"{name}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "wb") as f:
                yield f
            os.replace(part, name)
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(part)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) if mode == "rb" else store.open_output_stream(name) as f:
        yield f


#: The name of a null id, which no id's name can equal.
NOBODY = "<urn:page-without-id>"


def urn(key: str | None) -> str:
    return NOBODY if key is None else f"<urn:page:{quote(key)}>"


def named(name: str) -> str | None:
    """The id in a record's name."""
    return None if name == NOBODY else unquote(name.removeprefix("<urn:page:").removesuffix(">"))


def record(key: str | None, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record. Revisits hold no payload; its length is kept in a header."""
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(uri, safe=':/?&=%#,;@+~')}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(body)}", "Content-Type: text/html",
    ]
    if refers_to is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return head, block


def inflated(stream) -> Iterator[bytes]:
    """What a gzip file holds, in chunks; files of several members are read through."""
    z = zlib.decompressobj(GZIP)
    while data := stream.read(CHUNK):
        while data:
            yield z.decompress(data, CHUNK)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, CHUNK)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(GZIP)
    if rest := z.flush():
        yield rest


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream. One record at a time is held."""
    held, need, searched = bytearray(), None, 0
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", max(0, searched - 3))
                if end < 0:
                    searched = len(held)
                    break
                head = dict(x.split(": ", 1) for x in held[:end].decode().split("\r\n")[1:])
                need = end + 4 + int(head["Content-Length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need, searched = None, 0
    if held:
        raise ValueError("the stream ends inside a record")


def rewrite(source: str, target: str) -> int:
    """Normalises one file: target gets a member a record, target + '.idx' the index. Returns the number of records."""
    n, at = 0, 0
    with opened(source, "rb") as f, opened(target, "wb") as out, opened(f"{target}.idx", "wb") as index:
        for r in records(inflated(f)):
            z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            member = z.compress(r) + z.flush()
            out.write(member)
            index.write(f"{at} {len(member)} {parse(r)[0]['WARC-Record-ID']}\n".encode())
            at += len(member)
            n += 1
    return n


def members(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record that the index of a normalised file lists."""
    with opened(f"{path}.idx", "rb") as f:
        index = [(int(a), int(b), c) for a, b, c in (x.split(" ", 2) for x in f.read().decode().splitlines())]
    with opened(path, "rb") as f:
        for at, size, key in index:
            f.seek(at)
            head, block = parse(zlib.decompress(f.read(size), GZIP))
            if head["WARC-Record-ID"] != key:
                raise ValueError(f"the index of {path} is wrong at {at}")
            yield head, block


def classified(pages: DataFrame, id_col: str, payload_col: str, uri_col: str | None, least: int) -> DataFrame:
    """key, uri, payload, digest and first: the id of the response that a record revisits, or null."""
    p = pages.select(F.col(id_col).alias("key"), (F.coalesce(F.col(uri_col), F.lit("")) if uri_col else F.lit("")).alias("uri"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    large = p.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    # Only payloads that repeat; how large this table is, and so how it is joined, is known once it is written.
    again = scratch.write(large.where((F.col("n") > 1) & F.col("least").isNotNull()).select(F.col("digest").alias("d"), "least"))
    return p.join(again, F.col("digest") == F.col("d"), "left").select("key", "uri", "payload", "digest", F.when(~F.col("key").eqNullSafe(F.col("least")), F.col("least")).alias("first"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record a row into gzip streams under folder; returns a written table of path and n_records."""
    tb.bound_batches(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        context, number = TaskContext.get(), 0
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            path = f"{folder}/raw-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
            n = size = 0
            with opened(path, "wb") as f:
                z = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                while row is not None and size < file_bytes:
                    key, uri, payload, digest, first = row
                    f.write(z.compress(record(None if key is None else str(key), uri, payload, digest, None if first is None else str(first))))
                    n, size = n + 1, size + len(payload)
                    row = next(rows, None)
                f.write(z.flush())
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return scratch.write(classified(pages, id_col, payload_col, uri_col, least).mapInArrow(run, "path string, n_records long"))


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Normalises each file of a table with a column path; returns a written table of path (the new one), source and n_records."""

    def run(batches):
        from pyspark import TaskContext

        for b in batches:
            for source in b.column(0).to_pylist():
                target = f"{folder}/{os.path.basename(source).removeprefix('raw-').removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}.warc.gz"
                n = rewrite(source, target)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([source]), pa.array([n], pa.int64())], names=["path", "source", "n_records"])

    return scratch.write(_dealt(files.select("path")).mapInArrow(run, "path string, source string, n_records long"))


def _dealt(files: DataFrame) -> DataFrame:
    """A few files a task."""
    n = files.count()
    return files.repartition(max(1, min(n, 10_000)))


def read_archives(files: DataFrame) -> DataFrame:
    """One row per record of normalised files: key (as written), payload_bytes and payload_digest of the full payload, record_type, refers_to, and the block's own digest."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for head, block in members(path):
                    kind = head["WARC-Type"]
                    digest = hashlib.sha256(block).hexdigest() if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = len(block) if kind == "response" else int(head["X-Payload-Length"])
                    if kind == "response" and (head["WARC-Payload-Digest"] != f"sha256:{digest}"):
                        raise ValueError(f"a payload in {path} is not what was written")
                    rows.append((named(head["WARC-Record-ID"]), size, digest, kind, named(head["WARC-Refers-To"]) if kind == "revisit" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)], names=names)

    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return _dealt(files.select("path")).mapInArrow(run, "key string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = scratch.shared_folder(spark)
    raw = write_archives(pages, folder)
    got = read_archives(normalise(raw, folder))
    kind = pages.schema["page_id"].dataType
    return got.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN least <> page_id THEN least END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

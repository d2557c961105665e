"""WARC archives as a chunked record table: payloads stream as (record, chunk number) rows that carry running digests."""

from __future__ import annotations

import functools
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, arrow_batches, scratch, table

#: Bytes of a chunk, of an archive before the next one begins, and of the least payload that may be a revisit.
CHUNK, ARCHIVE, LEAST = 1 << 20, 256 << 20, 100
_MANIFEST = "archive string, records long, archive_bytes long"
_CHUNKS = "record_id string, page_id long, record_type string, refers_to long, chunk_no int, data binary, payload_bytes long, payload_digest string, is_last boolean"
_END = b"\r\n\r\n"


def _uri(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _page(uri: str | None) -> int | None:
    name = (uri or "null").strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def records(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """The chunks to write: rows (page_id, url, record_type, refers_to, n_bytes, digest, chunk_no, n_chunks, data).

    Equal payloads are found by digest: the smallest page_id of each is summed up first (combined before the shuffle),
    then joined to the pages, so that a payload with most of the rows is spread by the join. Revisits carry no data.
    Rows are cut into chunks before they reach Python.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("_p"))
    rows = rows.withColumn("digest", F.sha2("_p", 256)).withColumn("n_bytes", F.octet_length("_p").cast("long"))
    page = F.coalesce("page_id", F.lit(LAST_ID))
    first = rows.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min(page).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("digest").alias("_d"), "_first")
    seen = rows.join(first, F.col("digest") == F.col("_d"), "left")
    again = F.col("_first").isNotNull() & (page > F.col("_first"))
    parts = F.when(again, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk))).cast("int")
    cut = lambda i: F.when(~again, F.substring("_p", (i * chunk + 1).cast("int"), F.lit(chunk)))
    typed = seen.select(
        "page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"), "n_bytes", "digest",
        parts.alias("n_chunks"), F.posexplode(F.transform(F.sequence(F.lit(0), parts - 1), cut)).alias("chunk_no", "data"),
    )
    return typed


class _Archive:
    """One .warc.gz that is written in place of a name that readers don't use, then moved: each record is a gzip member."""

    def __init__(self, folder: str):
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.path, self.out, self.n, self.size = f"{path}/{self.name}", None, 0, 0
        self.out = self.fs.open_output_stream(f"{self.path}.open", compression=None)
        self.begin({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, 0)
        self.end()

    def begin(self, headers: dict[str, str], length: int) -> None:
        self.zip = zlib.compressobj(3, zlib.DEFLATED, 31)
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {length}"]
        self.put("\r\n".join(lines).encode() + _END)

    def put(self, data: bytes) -> None:
        self._out(self.zip.compress(data))

    def end(self) -> None:
        self.put(_END)
        self._out(self.zip.flush())
        self.n += 1

    def _out(self, data: bytes) -> None:
        self.size += len(data)
        self.out.write(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.fs.move(f"{self.path}.open", self.path)
        return self.name, self.n - 1, self.size


def _write(batches: Iterator[pa.RecordBatch], folder: str, archive: int) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk_no"] == 0:
                if now is not None and now.size >= archive:
                    done.append(now.close())
                    now = None
                now = now or _Archive(folder)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
                target = quote(row["url"], safe="%/:=&?~#+!$,;'@()*[]") if row["url"] else _uri(row["page_id"])
                headers = {
                    "WARC-Type": row["record_type"], "WARC-Record-ID": f"<{_uri(row['page_id'])}>", "WARC-Target-URI": target, "WARC-Date": "1970-01-01T00:00:00Z",
                    "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{row['digest']}",
                }
                if row["record_type"] == "revisit":
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{_uri(row['refers_to'])}>"}
                now.begin(headers, len(http) + (0 if row["record_type"] == "revisit" else row["n_bytes"]))
                now.put(http)
            if row["data"]:
                now.put(row["data"])
            if row["chunk_no"] == row["n_chunks"] - 1:
                now.end()
    if now is not None:
        done.append(now.close())
    columns = list(zip(*done)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["archive", "records", "archive_bytes"])


def write(pages: DataFrame, folder: str, least: int = LEAST, chunk: int = CHUNK, archive: int = ARCHIVE) -> DataFrame:
    """Writes pages(page_id, url, html) as .warc.gz files below `folder` (a URI all executors reach); returns their manifest.

    A null html is an empty payload. Of equal payloads of at least `least` bytes the one with the smallest page_id (null
    counts as the largest) is the response, others revisit it; rows that repeat that page_id are responses too. The
    manifest is stored as Parquet: it lists what tasks that succeeded wrote, so files of lost or repeated tasks are
    never read. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    arrow_batches(spark, 500)
    listed = records(pages, least, chunk).mapInArrow(functools.partial(_write, folder=f"{folder}/archives", archive=archive), _MANIFEST)
    listed.write.parquet(f"{folder}/manifest")
    return spark.read.schema(listed.schema).parquet(f"{folder}/manifest")


def _headers(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline(1 << 16)) not in (b"\r\n", b""):
        k, _, v = line.decode().partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def parse(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of _CHUNKS from an archive's bytes; holds one chunk at a time and checks lengths and digests."""
    while line := stream.readline(1 << 16):
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = _headers(stream)
        left, kind = int(head["content-length"]), head["warc-type"]
        if kind in ("response", "revisit"):
            size = len(status := stream.readline(1 << 16))
            http = {}
            while (line := stream.readline(1 << 16)) not in (b"\r\n", b""):
                size += len(line)
                k, _, v = line.decode().partition(":")
                http[k.strip().lower()] = v.strip()
            left -= size + len(line)
            if not status.startswith(b"HTTP/"):
                raise ValueError(f"{head['warc-record-id']}: no HTTP message")
            key = (head["warc-record-id"].strip("<>"), _page(head["warc-record-id"]), kind, _page(head.get("warc-refers-to")))
            told, n, done, sha = head["warc-payload-digest"].removeprefix("sha256:"), 0, 0, hashlib.sha256()
            while left > 0:
                data = stream.read(min(chunk, left))
                if not data:
                    raise ValueError(f"{key[0]}: the archive ends within its payload")
                left -= len(data)
                done += len(data)
                sha.update(data)
                if not left and sha.hexdigest() != told:
                    raise ValueError(f"{key[0]}: its payload has another digest")
                yield *key, n, data, done, sha.hexdigest(), not left
                n += 1
            if not n:  # a revisit, or an empty payload
                yield *key, 0, b"", int(http["content-length"]), told, True
        else:
            while left > 0:
                left -= len(stream.read(min(chunk, left)))
        if stream.read(len(_END)) != _END:
            raise ValueError("a record doesn't end with two empty lines")


def _read(batches: Iterator[pa.RecordBatch], folder: str, chunk: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for name in batch.column("archive").to_pylist():
            files, path = fs.FileSystem.from_uri(f"{folder}/{name}")
            with files.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for row in parse(stream, chunk):
                    held.append(row)
                    size += len(row[5]) + 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held)))), schema)
                        held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*held)))), schema)


def read(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives below `folder`.

    One row per chunk: record_id, page_id, record_type, refers_to, chunk_no, data, and over the payload so far
    payload_bytes and payload_digest; is_last marks the row at which they stand for the whole payload (for revisits: the
    payload they refer to). Archives are dealt to tasks; a task streams one at a time and never holds a whole record.
    """
    listed = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    many = max(1, min(listed.count(), 20_000))
    schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("is_last", pa.bool_())])
    return listed.select("archive").repartition(many).mapInArrow(functools.partial(_read, folder=f"{folder}/archives", chunk=chunk, schema=schema), _CHUNKS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= {LEAST} and page_id > first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {LEAST} and page_id > first then first end as refers_to
from f
"""
QUERIES, SQL = {"op6_warc_chunks": query}, {"op6_warc_chunks": ORACLE}

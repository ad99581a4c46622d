"""Web archives: write WARC records behind an index, read selected records by coalesced byte ranges.

write() puts each page into a gzip member of its own in a file per task and returns the index: file, offset, length,
URL and payload digest of every record. Of pages with equal payloads, that with the largest id is a response record and
the others revisit it. read() deals the selected index rows out by file and stretch, sorts them by offset, joins
ranges that lie close together into one read, and parses the records.

A task that is run again writes another file; the index has only what successful tasks return, so leftovers are
never read. Files are written and read through pyarrow's file systems: file://, hdfs:// and object stores.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewell.llm import common

FILE_BYTES = 1 << 30  # a file is closed beyond
READ_BYTES = 8 << 20  # the longest coalesced read, unless a record is longer
GAP_BYTES = 64 << 10  # unselected bytes that are read along rather than skipped
TASK_BYTES = 32 << 20
BATCH_BYTES = 16 << 20
HOT_ROWS = 1000  # pages of one digest that a task takes at least
DATE = "2024-01-01T00:00:00Z"
INDEX = T.StructType([T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("page_id", T.StringType())])
RECORD = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload", T.BinaryType())])


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _line(name: str, value: str) -> str:
    """A header line. A value that a line can't hold is escaped, and its name says so with a star."""
    if value == value.strip() and not set(value) & {"\r", "\n"}:
        return f"{name}: {value}"
    return f"{name}*: " + quote(value, safe=":/?#[]@!$&'()*+,;=-._~")


def _fields(head: bytes) -> dict[str, str]:
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {k.removesuffix("*"): unquote(v) if k.endswith("*") else v for k, v in fields.items()}


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool, place: str, refers_to_url: str | None = None, date: str = DATE) -> bytes:
    """One WARC/1.1 record. place (file and offset) makes its id, so repeated rows have ids of their own.

    A revisit has the HTTP header of its response, with the payload's length, but no payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(_line("WARC-Target-URI", url))
    if page_id is not None:
        head.append(_line("WARC-Page-ID", page_id))
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To-Date: {date}")
        if refers_to_url is not None:
            head.append(_line("WARC-Refers-To-Target-URI", refers_to_url))
        if refers_to is not None:
            head.append(_line("WARC-Refers-To-Page-ID", refers_to))
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of RECORD. The digest of a response is taken from its payload and must be the one in its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(_fields(http)["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": fields.get("WARC-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": fields.get("WARC-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write every row's html (UTF-8; null: empty) under root and return the index, which is written as well.

    Rows whose payloads, of at least least_bytes, are equal: those with the largest id are responses, the others
    revisit it. Null ids are smallest; rows repeated with one id are one record each, alike but for their record ids.
    An empty table makes an empty index; other columns are left out, whatever their names. A page is held whole by its
    task, a few copies of it.

    Digests meet as (digest, largest id, count), map sides first, never as pages. The digests of so many pages that
    they would fill a task by themselves are at most four a shuffle partition; these alone are broadcast, and their
    pages dealt out evenly.
    """
    spark = pages.sparkSession
    common.ship(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    equal = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max(F.struct("id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    equal = common.materialize(equal.select(F.col("sha1").alias("same"), F.col("first.id").alias("first"), F.col("first.url").alias("first_url"), "n"), "digests")
    lot = max(HOT_ROWS, (equal.agg(F.sum("n")).first()[0] or 0) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    common_ones = equal.filter(F.col("n") > lot).select(F.col("same").alias("hot"), F.struct("first", "first_url").alias("hot_first"))
    rare = equal.filter(F.col("n") <= lot).select("same", F.struct("first", "first_url").alias("rare_first"))
    known = rows.join(F.broadcast(common_ones), F.col("sha1") == F.col("hot"), "left")
    dealt = known.withColumn("same", F.when(F.col("hot").isNull(), F.col("sha1")).otherwise(F.concat(F.lit("-"), F.md5(F.concat_ws(" ", F.col("id").cast("string"), "url").cast("binary")))))
    judged = dealt.join(rare.hint("shuffle_hash"), "same", "left").withColumn("of", F.coalesce("hot_first", "rare_first"))
    revisit = F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("of.first"))
    judged = judged.select(F.col("id").cast("string").alias("id"), "url", "payload", "sha1", F.when(revisit, F.col("of.first").cast("string")).alias("refers_to"), F.when(revisit, F.col("of.first_url")).alias("refers_to_url"), revisit.alias("revisit"))

    def archive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(root)
        system.create_dir(base, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            index: list[tuple] = []
            for row in batch.to_pylist():
                if out is None or offset >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packer.compress(record(row["id"], row["url"], row["payload"], digest, row["refers_to"], row["revisit"], f"{name}:{offset}", row["refers_to_url"])) + packer.flush()
                out.write(data)
                index.append((f"{root}/{name}", offset, len(data), row["url"], digest, "revisit" if row["revisit"] else "response", row["id"]))
                offset += len(data)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()), strict=True)], INDEX.names)
        if out is not None:
            out.close()

    return common.materialize(judged.mapInArrow(archive, INDEX), "warc-index")


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, longest: int = READ_BYTES) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) of one file as reads: start, length, and the ranges inside."""
    reads: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in ranges:
        if reads and offset - (reads[-1][0] + reads[-1][1]) <= gap and offset + length - reads[-1][0] <= longest:
            start, _, inside = reads[-1]
            inside.append((offset, length))
            reads[-1] = start, offset + length - start, inside
        else:
            reads.append((offset, length, [(offset, length)]))
    return reads


def read(selected: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the selected index rows, as RECORD (payload null unless asked for)."""
    common.ship(selected.sparkSession)
    where = selected.select("file", "offset", "length")
    # tasks by the bytes to be read: the index rows alone would look small enough for one
    tasks = 1 + (where.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES
    dealt = where.repartition(tasks, "file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(RECORD.names, types, strict=True)], RECORD.names)

        for batch in batches:
            files: dict[str, list[tuple[int, int]]] = {}
            for f, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files.setdefault(f, []).append((o, n))
            for name, ranges in files.items():
                system, path = store(name)
                rows, size = [], 0
                with system.open_input_file(path) as source:
                    for start, length, inside in coalesce(ranges):
                        data = source.read_at(length, start)
                        for o, n in inside:
                            row = parse(zlib.decompress(data[o - start : o - start + n], 31))
                            if not payload:
                                row["payload"] = None
                            rows.append(row)
                            size += 200 + len(row["payload"] or b"")
                            if size >= BATCH_BYTES:
                                yield made(rows)
                                rows, size = [], 0
                if rows:
                    yield made(rows)

    return dealt.mapInArrow(records, RECORD)

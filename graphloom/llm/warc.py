"""WARC: monolithic gzip files are inflated once and rewritten with a gzip member for every record."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import Few, cut, heavy, remove, scratch, table, text_of
from graphloom.llm.files import open_fs, published

#: Equal payloads of at least so many bytes are written once; the others revisit the first.
LEAST_BYTES = 0
#: A monolithic file is closed beyond so many uncompressed bytes.
FILE_BYTES = 256 << 20
CHUNK = 1 << 18
LEVEL = 1
SALTS = 64
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, type string, page_id string, refers_to string, digest string, uri string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def first_holders(pages: DataFrame, id_col: str, payload: Column, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages with the column first: the smallest id among equal payloads, where there is more than one.

    Only pages whose digest may be repeated, told by a Bloom filter, are shuffled with their payload.
    Digests with more than a thousandth of the rows are dealt with a salt; only their list, a
    thousand at most, is broadcast.
    """
    digest = F.sha2(payload, 256)
    groups = pages.where(F.octet_length(payload) >= least_bytes).groupBy(digest.alias("__gl_digest"))
    groups = cut(groups.agg(F.min(id_col).alias("__gl_first"), F.count("*").alias("__gl_size")).where("__gl_size > 1"), "warc-groups")
    total = groups.agg(F.sum("__gl_size")).first()[0] or 0
    repeated = Few(groups, F.col("__gl_digest"))
    hot = F.broadcast(heavy(groups, "__gl_size", total).select("__gl_digest", F.lit(True).alias("__gl_hot")))
    salts = F.when(F.col("__gl_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    groups = groups.join(hot, "__gl_digest", "left").select("__gl_digest", "__gl_first", F.explode(salts).alias("__gl_salt"))
    rows = pages.withColumn("__gl_digest", digest)
    rows, alone = repeated.split(rows, F.col("__gl_digest"))
    alone = alone.select(*pages.columns, F.lit(None).cast(pages.schema[id_col].dataType).alias("first"))
    rows = rows.join(hot, "__gl_digest", "left")
    salt = F.when(F.col("__gl_hot"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = rows.withColumn("__gl_salt", salt)
    found = rows.join(groups, ["__gl_digest", "__gl_salt"], "left").withColumn("first", F.col("__gl_first"))
    return found.select(*pages.columns, "first").unionByName(alone)


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url))
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """records(page_id, url, payload, first) as files of one gzip stream each; returns their names."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() if i != 2 else b.column(i) for i in range(4)), strict=True))
        row, k = next(rows, None), 0
        while row is not None:
            name, n, size = f"raw-{part:07d}-{k:04d}.warc.gz", 0, 0
            with published(folder, name) as out:
                gz = zlib.compressobj(LEVEL, wbits=31)
                while row is not None and size < FILE_BYTES:
                    page_id, url, payload, first = row
                    payload = payload.as_buffer().to_pybytes()
                    record = _record(page_id, url, payload, first, first is not None and page_id != first)
                    out.write(gz.compress(record))
                    n, size, row = n + 1, size + len(record), next(rows, None)
                out.write(gz.flush())
            k += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return records.select("page_id", "url", "payload", "first").mapInArrow(write, "file string, records long")


class RecordStream:
    """WARC records of a gzip stream of one or many members, each byte inflated once.

    ``next_header`` gives a record's header lines and ``body`` its block in chunks, so memory
    doesn't grow with files or records.
    """

    def __init__(self, stream) -> None:
        self.stream, self.z, self.have, self.rest = stream, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.rest = self.z.unused_data or self.rest
                self.z = zlib.decompressobj(31)
            data = self.rest or self.stream.read(CHUNK)
            if not data:
                return False
            got = self.z.decompress(data, CHUNK)
            self.rest = self.z.unconsumed_tail
            if got:
                self.have += got
                return True

    def next_header(self) -> bytes | None:
        """The header up to its empty line, or None at the end."""
        while True:
            while self.have[:2] == b"\r\n":
                self.have = self.have[2:]
            if (end := self.have.find(b"\r\n\r\n")) > 0:
                head, self.have = self.have[: end + 4], self.have[end + 4 :]
                return head
            if not self._more():
                if self.have.strip(b"\r\n"):
                    raise EOFError("the archive ends inside a record's header")
                return None

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.have and not self._more():
                raise EOFError("the archive ends inside a record")
            piece, self.have = self.have[:n], self.have[n:]
            n -= len(piece)
            yield piece


def fields(header: bytes) -> dict[str, str]:
    lines = header.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def _page(urn: str) -> str:
    return urn.removeprefix("<urn:page:").removesuffix(">")


def normalise(files: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrite the files(file) of source into folder, one gzip member per record, with an index beside each.

    The index has a JSON line per record: archive, offset, length, type, page_id, refers_to, digest, uri.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (x for b in batches for x in b.column(0).to_pylist()):
            fs, path = open_fs(f"{source}/{name}")
            final, at, n = name.replace("raw-", "pages-"), 0, 0
            with fs.open_input_stream(path, compression=None) as raw, published(folder, final) as out, published(folder, final + ".json") as index:
                records = RecordStream(raw)
                while (header := records.next_header()) is not None:
                    said = fields(header)
                    gz, start = zlib.compressobj(LEVEL, wbits=31), at
                    for piece in chain([header], records.body(int(said["content-length"])), [b"\r\n\r\n"]):
                        at += out.write(gz.compress(piece))
                    at, n = at + out.write(gz.flush()), n + 1
                    line = {
                        "archive": final, "offset": start, "length": at - start, "type": said["warc-type"], "page_id": _page(said["warc-record-id"]),
                        "refers_to": _page(said["warc-refers-to"]) if "warc-refers-to" in said else None,
                        "digest": said["warc-payload-digest"], "uri": said.get("warc-target-uri"),
                    }
                    index.write(json.dumps(line).encode() + b"\n")
            yield pa.RecordBatch.from_pydict({"file": [final], "records": [n]})

    return files.select("file").mapInArrow(rewrite, "file string, records long")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Each indexed record from its own member, found by offset; a response's digest is of the bytes read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, handle = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != held:
                    if handle is not None:
                        handle.close()
                    fs, path = open_fs(f"{folder}/{archive}")
                    held, handle = archive, fs.open_input_file(path)
                handle.seek(offset)
                records = RecordStream(_Part(handle, length))
                said = fields(records.next_header())
                http, size, digest = b"", 0, hashlib.sha1()
                for piece in records.body(int(said["content-length"])):
                    if size == 0 and b"\r\n\r\n" not in http:
                        http += piece
                        if b"\r\n\r\n" in http:
                            http, _, piece = http.partition(b"\r\n\r\n")
                            http += b"\r\n\r\n"
                        else:
                            continue
                    digest.update(piece)
                    size += len(piece)
                base32 = base64.b32encode(digest.digest()).decode()
                stated = said["warc-payload-digest"].removeprefix("sha1:")
                number = lambda urn: None if (x := _page(urn)) == "None" else int(x)
                if said["warc-type"] == "revisit":
                    size, refers = int(fields(http)["content-length"]), number(said["warc-refers-to"])
                else:
                    refers = None
                    if base32 != stated:
                        raise ValueError(f"{archive} at {offset}: payload digest {base32} is stated as {stated}")
                rows.append((number(said["warc-record-id"]), size, stated, said["warc-type"], refers))
            if rows:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RECORDS.split(", ")])
        if handle is not None:
            handle.close()

    return index.select("archive", "offset", "length").mapInArrow(read, RECORDS)


class _Part:
    """So many bytes of a stream from where it is."""

    def __init__(self, stream, length: int) -> None:
        self.stream, self.left = stream, length

    def read(self, n: int) -> bytes:
        data = self.stream.read(min(n, self.left))
        self.left -= len(data)
        return data


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, str]:
    """(index, folder): every row's page as a record of normalised archives, and their index.

    A null html is an empty payload, a null url leaves the target out; a null id is never what
    others refer to, and such rows are all responses where no id is known. Rows that repeat an id
    and its payload have the same type. An empty table gives no archive and an empty index.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(text_of(html_col), "UTF-8").alias("payload"))
    rows = first_holders(rows, "page_id", F.col("payload"), least_bytes)
    source, folder = scratch(spark, "warc-raw"), scratch(spark, "warc")
    files = cut(write_monolithic(rows, source), "warc-files")
    n = max(1, files.count())
    done = cut(normalise(files.repartitionByRange(n, "file"), source, folder), "warc-normalised")
    some = done.count()
    remove(spark, source)
    if not some:
        return spark.createDataFrame([], INDEX), folder
    return spark.read.schema(INDEX).json(f"{folder}/*.json"), folder


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archive_pages on pages, and what read_records finds in the archives."""
    index, folder = archive_pages(table(spark, sf_dir, "pages"))
    return read_records(index, folder)


OP4_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (('0x' || substr(h, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

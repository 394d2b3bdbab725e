"""Media columns: archives of grey images, read through a Spark data source that plans byte ranges."""

from __future__ import annotations

import hashlib
import re
import struct
import time
import zipfile
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.llm.common import cut, scratch, table
from graphloom.llm.files import list_files, open_fs, published

#: A payload is padded with byte 255 to a positive multiple of this: images of 24 columns.
BLOCK, COLUMNS = 576, 24
#: An archive is closed beyond so many payload bytes.
ARCHIVE_BYTES = 256 << 20
#: A partition of the source covers so many bytes of an archive.
RANGE_BYTES = 16 << 20
#: A batch of the source holds about so many payload bytes.
BATCH_BYTES = 4 << 20
ATTEMPTS = 3

#: What the sidecar of an archive has of each member, in order of their offsets: offset, stored bytes, bytes, CRC.
ENTRY, ENTRY_BYTES = "<QQQI", 28
SIDECAR = ".members"
#: A zip member's own header: signature, method, lengths of its name and extra field.
_LOCAL, _LOCAL_BYTES = "<4s4xH16xHH", 30

MEMBERS = "archive string, member string, offset long, media binary, attempts int, error string"


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


def to_image(payload: bytes, n_bytes: int) -> bytes:
    """A binary PGM: one 8-bit sample a payload byte; the unpadded length is a comment of its header."""
    return b"P5\n# n_bytes=%d\n%d %d\n255\n" % (n_bytes, COLUMNS, len(payload) // COLUMNS) + payload


_HEADER = re.compile(rb"P5\n# n_bytes=(\d+)\n(\d+) (\d+)\n255\n")


def from_image(media: bytes) -> tuple[int, int, int, bytes]:
    """(n_bytes, columns, rows, samples)."""
    head = _HEADER.match(media)
    if head is None:
        raise ValueError("not an image of this writer")
    n_bytes, columns, rows = map(int, head.groups())
    samples = media[head.end() :]
    if len(samples) != columns * rows:
        raise ValueError(f"{len(samples)} samples in an image of {columns} x {rows}")
    return n_bytes, columns, rows, samples


class _Sink:
    """What zipfile needs of a stream that can't seek."""

    def __init__(self, stream) -> None:
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass

    def close(self) -> None:
        pass


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every row's text as an image into zip archives of folder; returns what was written.

    A task's archives are named by its partition and appear when they are complete, so an attempt
    that runs again replaces them. Members are <number>-<id>.pgm, deflated; a null id is "null". A
    sidecar beside each archive lists its members by offset; it is there before the archive is.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        row, k = next(rows, None), 0
        while row is not None:
            name, members, size = f"media-{part:07d}-{k:04d}.zip", 0, 0
            with published(folder, name) as out:
                with zipfile.ZipFile(_Sink(out), "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
                    while row is not None and (size < ARCHIVE_BYTES):
                        doc_id, text = row
                        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                        info = zipfile.ZipInfo(f"{members:08d}-{'null' if doc_id is None else doc_id}.pgm")
                        info.compress_type = zipfile.ZIP_DEFLATED
                        archive.writestr(info, to_image(padded(raw), len(raw)), compresslevel=1)
                        members, size, row = members + 1, size + len(raw) + BLOCK, next(rows, None)
                with published(folder, name + SIDECAR) as side:
                    side.write(b"".join(struct.pack(ENTRY, x.header_offset, x.compress_size, x.file_size, x.CRC) for x in archive.infolist()))
            k += 1
            yield pa.RecordBatch.from_pydict({"archive": [name], "members": [members], "payload_bytes": [size]})

    return docs.select(id_col, text_col).mapInArrow(write, "archive string, members long, payload_bytes long")


class _Range(InputPartition):
    def __init__(self, archive: str, low: int, high: int) -> None:
        self.archive, self.low, self.high = archive, low, high


def retried(read: Callable[[bool], bytes], attempts: int = ATTEMPTS, wait_s: float = 0.1) -> tuple[bytes | None, int, str | None]:
    """(bytes, attempts, error) of read(fresh), which is tried again with a new handle when it fails."""
    error = None
    for n in range(1, attempts + 1):
        try:
            return read(n > 1), n, None
        except (OSError, zipfile.BadZipFile, zlib.error, EOFError) as e:
            error = f"{type(e).__name__}: {e}"[:200]
            if n < attempts:
                time.sleep(wait_s * n)
    return None, attempts, error


def read_member(open_archive, info: zipfile.ZipInfo, attempts: int = ATTEMPTS, wait_s: float = 0.1) -> tuple[bytes | None, int, str | None]:
    """(bytes, attempts, error): a member that fails is read again from its offset in a new handle.

    Only the member is repeated, never the archive's others; zipfile checks its CRC. One that
    fails every time has no bytes and the last error.
    """

    def read(fresh: bool) -> bytes:
        with open_archive(fresh=fresh).open(info) as member:
            return member.read()

    return retried(read, attempts, wait_s)


def member_at(stream, entry: tuple[int, int, int, int]) -> tuple[str, bytes]:
    """(name, bytes) of the member that a sidecar's entry describes, checked against its size and CRC."""
    offset, stored, size, crc = entry
    stream.seek(offset)
    data = stream.read(_LOCAL_BYTES + 64 + stored)
    if len(data) < _LOCAL_BYTES:
        raise EOFError("the archive ends before the member")
    signature, method, n_name, n_extra = struct.unpack_from(_LOCAL, data)
    start = _LOCAL_BYTES + n_name + n_extra
    if signature != b"PK\3\4":
        raise zipfile.BadZipFile(f"no member at {offset}")
    if len(data) < start + stored:
        data += stream.read(start + stored - len(data))
    body = data[start : start + stored]
    out = zlib.decompress(body, -15) if method == zipfile.ZIP_DEFLATED else body
    if len(out) != size or zlib.crc32(out) != crc:
        raise zipfile.BadZipFile(f"bad size or CRC-32 at {offset}")
    return data[_LOCAL_BYTES : _LOCAL_BYTES + n_name].decode(), out


class _Entries:
    """A sidecar as a sequence that is read entry by entry: bisection opens a few of them, not all."""

    def __init__(self, stream) -> None:
        self.stream, self.n = stream, stream.size() // ENTRY_BYTES

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[int, int, int, int]:
        self.stream.seek(i * ENTRY_BYTES)
        return struct.unpack(ENTRY, self.stream.read(ENTRY_BYTES))

    def between(self, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        """The entries with an offset in [low, high)."""
        a, b = (bisect_left(self, x, key=lambda e: e[0]) for x in (low, high))
        self.stream.seek(a * ENTRY_BYTES)
        yield from struct.iter_unpack(ENTRY, self.stream.read((b - a) * ENTRY_BYTES))


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, attempts: int, on_error: str) -> None:
        if on_error not in ("raise", "row"):
            raise ValueError(f"on_error is {on_error!r}; known are raise and row")
        self.folder, self.range_bytes, self.attempts, self.on_error = folder, range_bytes, attempts, on_error

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of the archives, from file sizes alone: no archive is opened to plan."""
        out = [
            _Range(uri, low, min(low + self.range_bytes, size))
            for uri, size in list_files(self.folder, ".zip")
            for low in range(0, size, self.range_bytes)
        ]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        """The members whose local header starts in the range, by the archive's sidecar or, without one, by its own directory."""
        if not partition.archive:
            return
        fs, path = open_fs(partition.archive)
        listed = fs.get_file_info(path + SIDECAR).is_file
        rows: list[tuple] = []
        size = 0
        for name, offset, (media, n, error) in self.by_sidecar(fs, path, partition) if listed else self.by_directory(fs, path, partition):
            if error is not None and self.on_error == "raise":
                raise OSError(f"{partition.archive} at {offset}: {error}")
            rows.append((partition.archive, name, offset, media, n, error))
            size += len(media or b"")
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def by_sidecar(self, fs, path: str, partition: _Range) -> Iterator[tuple]:
        with fs.open_input_file(path + SIDECAR) as side:
            entries = list(_Entries(side).between(partition.low, partition.high))
        handle = fs.open_input_file(path)
        for entry in entries:
            name: list[str | None] = [None]

            def attempt(fresh: bool, entry=entry, name=name) -> bytes:
                nonlocal handle
                if fresh:
                    handle = fs.open_input_file(path)
                name[0], data = member_at(handle, entry)
                return data

            got = retried(attempt, self.attempts)
            yield name[0], entry[0], got
        handle.close()

    def by_directory(self, fs, path: str, partition: _Range) -> Iterator[tuple]:
        held: list[zipfile.ZipFile] = []

        def open_archive(fresh: bool = False) -> zipfile.ZipFile:
            if fresh and held:
                held.pop().close()
            if not held:
                held.append(zipfile.ZipFile(fs.open_input_file(path)))
            return held[0]

        for info in open_archive().infolist():
            if partition.low <= info.header_offset < partition.high:
                yield info.filename, info.header_offset, read_member(open_archive, info, self.attempts)
        for archive in held:
            archive.close()


_TYPES = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.string())
_NAMES = [f.split()[0] for f in MEMBERS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


class ArchiveSource(DataSource):
    """format("graphloom_archive"): one row per member of the zip archives in the folder ``path``.

    A member that fails every time ends its task, which Spark runs again elsewhere; with the option
    on_error=row it is a row with an error instead of bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "graphloom_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("attempts", ATTEMPTS)), self.options.get("on_error", "raise"))


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("graphloom_archive").options(**options).load(folder)


def feature_of(columns: int, rows: int, samples: bytes) -> str:
    """Size, mean, deviation, extremes and a histogram of 8 bins of the samples, as text."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    values = np.arange(256)
    n = max(1, int(counts.sum()))
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    seen = np.flatnonzero(counts)
    low, high = (int(seen[0]), int(seen[-1])) if len(seen) else (0, 0)
    bins = ",".join(str(int(x)) for x in counts.reshape(8, 32).sum(1))
    return f"{columns}x{rows} mean={total / n:.6f} var={squares / n - (total / n) ** 2:.6f} min={low} max={high} hist={bins}"


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, error string"
)
_FEATURE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())


def media_features(members: DataFrame) -> DataFrame:
    """For each member: doc_id and what its stored bytes hold. A member that couldn't be read has only its error."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, media, error in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                doc = name[:-4].partition("-")[2]
                doc_id = None if doc == "null" else int(doc)
                if media is None:
                    rows.append((doc_id, *[None] * 7, error))
                    continue
                n_bytes, columns, lines, samples = from_image(media)
                rows.append((
                    doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]),
                    len(media), hashlib.sha256(media).hexdigest(), feature_of(columns, lines, samples), None,
                ))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FEATURE_TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FEATURES.split(", ")])

    return members.select("member", "media", "error").mapInArrow(features, FEATURES)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image, read all archives back and describe what was read.

    A null text counts as empty; an empty one is one block of byte 255; a text of any length is one
    image. A null id comes back as null, repeated rows as rows of their own. An empty table writes
    no archive and gives no row. Other columns aren't read.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "media")
    written = cut(write_archives(docs, folder, id_col, text_col), "media-written")
    written.count()
    return media_features(read_archives(spark, folder))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_columns on documents."""
    return media_columns(table(spark, sf_dir, "documents"))

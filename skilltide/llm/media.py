"""Media columns: payloads as 8-bit grey PNG members of ZIP archives, behind a Spark data source.

``media_archive`` is a Python data source. Writing streams Arrow batches into
archives, one for each task, and keeps those of committed tasks only. Reading
plans byte ranges over the archives of a directory: the driver lists archives
and sizes, and each task finds, in the archive's own directory, the members
whose entry begins inside its range, so no list of members ever meets in one
place. A task fetches, checks and decodes members one by one at their offsets;
a member that cannot be read or fails its checksum is retried alone, and only
after all attempts the task fails (``on_error='fail'``) or the row carries the
message (``on_error='row'``).

A payload is the text's UTF-8 bytes, filled with bytes 255 to a positive multiple
of 576: the rows of an image 576 samples wide.

Edge cases: null and empty texts become one row of 255; texts of any length are
one member each; a null id is kept (the member's name carries a marker); repeated
rows are separate members; an empty table gives an empty directory and no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import scratch

WIDTH = 576
_PNG = b"\x89PNG\r\n\x1a\n"
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH")
_END64, _LOCATOR = struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])


def payload_of(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey image of WIDTH samples a row; rows are stored unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">2I5B", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def samples(data: bytes) -> np.ndarray:
    """Rows of an 8-bit grey PNG; raises ValueError for damaged data."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG file")
    i, packed, shape = 8, [], None
    while i < len(data):
        n, kind = struct.unpack_from(">I4s", data, i) if i + 8 <= len(data) else (0, b"")
        if i + 12 + n > len(data):
            raise ValueError("the file is cut short")
        body = data[i + 8 : i + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, i + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} fails its checksum")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">2I5B", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit grey")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            packed.append(body)
        i += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape)
    if not raw[:, 0].any():
        return raw[:, 1:]
    out = np.zeros((shape[0], shape[1] - 1), np.uint8)
    above = np.zeros(shape[1] - 1, np.uint8)
    for y, kind in enumerate(raw[:, 0]):
        if kind == 0:
            out[y] = raw[y, 1:]
        elif kind == 1:
            out[y] = np.cumsum(raw[y, 1:], dtype=np.uint8)
        elif kind == 2:
            out[y] = raw[y, 1:] + above
        else:
            raise ValueError(f"row filter {kind}")
        above = out[y]
    return out


def feature(rows: np.ndarray) -> str:
    """Mean and deviation of the samples, entropy of their histogram, and a 64-bit difference hash of an 8 x 9 grid."""
    counts = np.bincount(rows.reshape(-1), minlength=256)
    n, level = rows.size, np.arange(256)
    mean = float(counts @ level) / n
    spread = max(0.0, float(counts @ (level * level)) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    columns = rows.reshape(len(rows), 9, WIDTH // 9).sum(axis=2, dtype=np.int64)
    edges = np.linspace(0, len(rows), 9).astype(int)
    grid = np.stack([columns[a : max(b, a + 1)].mean(axis=0) if a < len(rows) else columns[-1] for a, b in zip(edges[:-1], edges[1:], strict=True)])
    bits = "".join("1" if x else "0" for x in (grid[:, 1:] > grid[:, :-1]).reshape(-1))
    return f"mean={mean:.4f};sd={spread:.4f};entropy={entropy:.4f};dhash={int(bits, 2):016x}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI (local, or whatever pyarrow opens) and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class ZipWriter:
    """Stored members one after another, then the archive's directory (with 64-bit fields where needed)."""

    def __init__(self, sink):
        self.sink, self.at, self.entries = sink, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        key, crc = name.encode(), zlib.crc32(data)
        if len(data) >= 0xFFFFFFFF:
            raise ValueError("a member of 4 GB or more")
        self.entries.append((key, crc, len(data), self.at))
        self._put(_LOCAL.pack(b"PK\x03\x04", 20, 0x800, 0, 0, 0x21, crc, len(data), len(data), len(key), 0) + key)
        self._put(data)

    def close(self) -> None:
        start = self.at
        for key, crc, size, at in self.entries:
            far = at >= 0xFFFFFFFF
            extra = struct.pack("<2HQ", 1, 8, at) if far else b""
            self._put(_CENTRAL.pack(b"PK\x01\x02", 45 if far else 20, 45 if far else 20, 0x800, 0, 0, 0x21, crc, size, size, len(key), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if far else at) + key + extra)
        n, size, end = len(self.entries), self.at - start, self.at
        if n >= 0xFFFF or end >= 0xFFFFFFFF:
            self._put(_END64.pack(b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start) + _LOCATOR.pack(b"PK\x06\x07", 0, end, 1))
        self._put(_END.pack(b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0))
        self.sink.close()


def members(source: pa.NativeFile, begin: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset of its entry, size, CRC) of the members whose entry begins in [begin, end), from the archive's directory."""
    total = source.size()
    tail = source.read_at(min(total, 65_557), max(0, total - 65_557))
    i = tail.rfind(b"PK\x05\x06")
    if i < 0:
        raise ValueError("no directory at the archive's end")
    *_, size, start, _ = _END.unpack_from(tail, i)
    if i >= 20 and tail[i - 20 : i - 16] == b"PK\x06\x07":
        at = _LOCATOR.unpack_from(tail, i - 20)[2]
        size, start = _END64.unpack(source.read_at(_END64.size, at))[-2:]
    left, at, step = b"", start, 1 << 20
    stop = start + size
    while at < stop or len(left) >= _CENTRAL.size:
        while at < stop and len(left) < step // 2:
            got = source.read_at(min(step, stop - at), at)
            left, at = left + got, at + len(got)
        i = 0
        while len(left) - i >= _CENTRAL.size:
            head = _CENTRAL.unpack_from(left, i)
            long = _CENTRAL.size + head[10] + head[11] + head[12]
            if len(left) - i < long:
                break
            name = left[i + _CENTRAL.size : i + _CENTRAL.size + head[10]].decode()
            where = head[16]
            if where == 0xFFFFFFFF:
                where = struct.unpack_from("<Q", left, i + _CENTRAL.size + head[10] + 4)[0]
            if begin <= where < end:
                yield name, where, head[9], head[7]
            i += long
        left = left[i:]


def fetch(source: pa.NativeFile, offset: int, size: int, crc: int) -> bytes:
    """One member's bytes by a range read at its entry; raises if they do not match."""
    head = _LOCAL.unpack(source.read_at(_LOCAL.size, offset))
    data = source.read_at(size, offset + _LOCAL.size + head[9] + head[10])
    if head[0] != b"PK\x03\x04" or len(data) != size or zlib.crc32(data) != crc:
        raise ValueError(f"the member at {offset} does not match its directory entry")
    return data


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    """One archive a task, under a name that no other attempt has; commit lists what counts."""

    def __init__(self, uri: str):
        self.uri, self.job = uri, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.uri)
        fs.create_dir(root, recursive=True)
        name = f"_open-{self.job}-{uuid.uuid4().hex}.zip"
        out, n = None, 0
        for batch in iterator:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if out is None:
                    out = ZipWriter(fs.open_output_stream(f"{root}/{name}", compression=None))
                payload, length = payload_of(text.as_py())
                n += 1
                out.add(f"{n:09d}_{'null' if key.as_py() is None else key.as_py()}_{length}.png", png(payload))
        if out is None:
            return Written([])
        out.close()
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.uri)
        fs.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{root}/{name}", f"{root}/{name.removeprefix('_open-')}")
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.uri)
        self._clear(fs, root)

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        """Remove what this job's attempts left open, lost executors' files too."""
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if os.path.basename(info.path).startswith(f"_open-{self.job}-"):
                fs.delete_file(info.path)


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str, options: dict):
        self.uri = uri
        self.step = int(options.get("rangebytes", 16 << 20))
        self.attempts = int(options.get("attempts", 3))
        self.on_error = options.get("onerror", "fail")

    def partitions(self) -> list[Range]:
        fs, root = filesystem(self.uri)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.path.endswith(".zip") and not os.path.basename(f.path).startswith("_"))
        return [Range(p, b, min(size, b + self.step)) for p, size in files for b in range(0, size, self.step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = filesystem(self.uri)
        rows: list[tuple] = []
        with fs.open_input_file(partition.path) as source:
            for name, offset, size, crc in members(source, partition.begin, partition.end):
                rows.append(self._member(source, name, offset, size, crc))
                if len(rows) == 512:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def _member(self, source: pa.NativeFile, name: str, offset: int, size: int, crc: int) -> tuple:
        _, key, length = name.removesuffix(".png").split("_")
        key, length = None if key == "null" else int(key), int(length)
        for attempt in range(self.attempts):
            try:
                data = fetch(source, offset, size, crc)
                rows = samples(data)
                payload = rows.tobytes()
                tail = zlib.crc32(payload[-32:])
                return key, length, len(payload), hashlib.sha256(payload).hexdigest(), tail, len(data), hashlib.sha256(data).hexdigest(), feature(rows), None
            except (OSError, ValueError, struct.error, zlib.error) as e:
                said = f"{type(e).__name__}: {e}"
                if attempt + 1 < self.attempts:
                    time.sleep(0.05 * 2**attempt)
        if self.on_error == "fail":
            raise OSError(f"{name} after {self.attempts} attempts: {said}")
        return key, length, None, None, None, None, None, None, said


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class MediaArchive(DataSource):
    """Options: path, rangeBytes (bytes a task reads), attempts, onError (fail or row)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def store(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row's payload to the archives at ``uri``."""
    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows.write.format("media_archive").mode("append").save(uri)


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Payloads of every row stored in archives of the shared folder, and what reading them back gives."""
    uri = scratch(docs.sparkSession, "media")
    store(docs, uri, id_col, text_col)
    read = docs.sparkSession.read.format("media_archive").options(**options).load(uri)
    return read if options.get("onError") == "row" else read.drop("error")

"""WARC archives with a two-level capture index.

Each task writes one archive of gzipped records (a member each, so any record can
be read alone). Captures are sorted by reversed-host URL key and page id into
index shards: compressed blocks of lines, then the shard's sparse directory with
the first key of each block. A small list holds the first key of each shard.
A look-up bisects that list, the shard's directory and the block's lines, then
reads the record's byte range.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the
largest page id is a response and the others revisit it: they carry no payload
but its digest and the response's identifier, URL and page id. Reading a revisit
looks the response up in the index.

Edge cases: a null html is an empty payload; a null url has the key of an empty
host; control characters of a url stand JSON-escaped in the record's headers; a null page id sorts below all others, and only if no other row shares the
payload is it the response; rows that repeat the largest page id of a payload are
all responses; an empty table gives no archives and no rows; other columns are
not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, scratch, written
from .media import filesystem

NO_ID = -(1 << 63)
_TRAILER = "<8sQ"
_MAGIC = b"SKTINDEX"
CAPTURE = "surt string, page_id long, archive string, start long, length long"


def surt(url: Column) -> Column:
    """Host labels from the last to the first, then path and query: org,example,www)/a?b."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([\s\S]*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:skilltide:page:{'null' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int, str | None] | None) -> bytes:
    """One gzipped WARC record; ``refers``: page id and URL of the response that it revisits."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {json.dumps(url)[1:-1] if url is not None else ''}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
    ]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers[0])}", f"WARC-Refers-To-Target-URI: {json.dumps(refers[1])[1:-1] if refers[1] is not None else ''}"]
    head.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a gzipped record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, uri: str) -> DataFrame:
    """Write rows (page_id, url, html, surt, refers_to, refers_url, refers_surt) to archives; their captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(uri)
        out, at, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            rows = []
            for page_id, url, html, key, refers, refers_url in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), None if refers is None else (refers, refers_url))
                out.write(data)
                rows.append((key, NO_ID if page_id is None else page_id, name, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["surt", "page_id", "archive", "start", "length"])
        if out is not None:
            out.close()

    return written(pages.mapInArrow(run, CAPTURE), "warc-captures")


def write_index(captures: DataFrame, uri: str, shard_rows: int = 1_000_000, block_lines: int = 1000) -> str:
    """Sort the captures into shards of compressed blocks; the path of the list of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(uri)
        out, at, lines, directory, name = None, 0, [], [], f"{uuid.uuid4().hex}.idx"

        def flush() -> int:
            data = zlib.compress("\n".join(map(json.dumps, lines)).encode(), 6)
            out.write(data)
            directory.append([*lines[0][:2], at, len(data)])
            return at + len(data)

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                lines.append(line)
                if len(lines) == block_lines:
                    at, lines = flush(), []
        if out is not None:
            if lines:
                at = flush()
            packed = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(packed + struct.pack(_TRAILER, _MAGIC, len(packed)))
            out.close()
            first = directory[0]
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([name])], ["surt", "page_id", "shard"])

    shards = max(captures.sparkSession.sparkContext.defaultParallelism, -(-captures.count() // shard_rows))
    made = captures.repartitionByRange(shards, "surt", "page_id").sortWithinPartitions("surt", "page_id", "archive", "start").mapInArrow(run, "surt string, page_id long, shard string")
    # One line for each shard, so for each million captures at scale
    top = sorted([r.surt, r.page_id, r.shard] for r in made.collect())
    fs, root = filesystem(uri)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/shards.json") as out:
        out.write(json.dumps(top).encode())
    return f"{root}/shards.json"


class _Kept(OrderedDict):
    """The values last used, within a bound on their number."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def of(self, key, make):
        if key in self:
            self.move_to_end(key)
        else:
            self[key] = make()
            if len(self) > self.most:
                self.popitem(last=False)
        return self[key]


class Index:
    """Look-ups by key and page id; reads directories, blocks and records by byte range."""

    def __init__(self, fs: pafs.FileSystem, root: str, top: str):
        self.fs, self.root = fs, root
        with fs.open_input_stream(top) as f:
            self.top = json.loads(f.read())
        self.files, self.directories, self.blocks = _Kept(64), _Kept(16), _Kept(16)

    def _file(self, path: str) -> pa.NativeFile:
        return self.files.of(path, lambda: self.fs.open_input_file(path))

    def _directory(self, shard: str) -> list:
        source = self._file(f"{self.root}/{shard}")
        size = source.size()
        end = size - struct.calcsize(_TRAILER)
        magic, n = struct.unpack(_TRAILER, source.read_at(size - end, end))
        if magic != _MAGIC:
            raise ValueError(f"{shard} is not an index shard")
        return json.loads(zlib.decompress(source.read_at(n, end - n)))

    def _block(self, shard: str, at: int, n: int) -> list:
        data = self._file(f"{self.root}/{shard}").read_at(n, at)
        return [json.loads(line) for line in zlib.decompress(data).decode().split("\n")]

    def find(self, key: str, page_id: int) -> list[list]:
        """All captures [key, page id, archive, start, length] of a key and page id."""
        wanted, found = [key, page_id], []

        def start(rows: list) -> int:
            # the last row that begins before the wanted pair: equal pairs may begin inside it
            return max(0, bisect.bisect_left(rows, wanted, key=lambda r: r[:2]) - 1)

        for s in range(start(self.top), len(self.top)):
            if self.top[s][:2] > wanted:
                break
            shard = self.top[s][2]
            directory = self.directories.of(shard, lambda shard=shard: self._directory(shard))
            for b in range(start(directory), len(directory)):
                if directory[b][:2] > wanted:
                    break
                lines = self.blocks.of((shard, b), lambda shard=shard, e=directory[b]: self._block(shard, *e[2:]))
                i = bisect.bisect_left(lines, wanted, key=lambda r: r[:2])
                while i < len(lines) and lines[i][:2] == wanted:
                    found.append(lines[i])
                    i += 1
        return found

    def read(self, archive: str, start: int, length: int) -> tuple[dict[str, str], bytes]:
        return parse(self._file(f"{self.root}/{archive}").read_at(length, start))


OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_back(requests: DataFrame, uri: str, top: str, surt_of_url) -> DataFrame:
    """Look every (surt, page_id) up and read its records; a revisit's payload is that of its response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(uri)
        index, last, payloads = None, None, _Kept(256)
        for batch in batches:
            rows = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (key, page_id) == last:
                    continue
                last, index = (key, page_id), index or Index(fs, root, top)
                for _, _, *where in index.find(key, page_id):
                    headers, payload = index.read(*where)
                    kind, refers = headers["WARC-Type"], None
                    if kind == "revisit":
                        refers = int(headers["WARC-Refers-To"].rsplit(":", 1)[1].rstrip(">"))
                        url = json.loads(f'"{headers["WARC-Refers-To-Target-URI"]}"')

                        def response(refers=refers, url=url, wanted=headers["WARC-Payload-Digest"]):
                            for _, _, *there in index.find(surt_of_url(url), refers):
                                h, p = index.read(*there)
                                if h["WARC-Type"] == "response" and h["WARC-Payload-Digest"] == wanted:
                                    return len(p), digest(p)
                            raise ValueError(f"no response {refers} for a revisit")

                        n, code = payloads.of((refers, headers["WARC-Payload-Digest"]), response)
                    else:
                        n, code = len(payload), digest(payload)
                    if headers["WARC-Payload-Digest"] != f"sha1:{code}":
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not match its digest")
                    rows.append((None if page_id == NO_ID else page_id, n, code, kind, refers))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return requests.mapInArrow(run, OUT)


def surt_text(url: str) -> str:
    """The same key as :func:`surt`, of one URL."""
    host = re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", url)
    rest = re.fullmatch(r"(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([\s\S]*)", url)[1]
    return ",".join(reversed((host[1] if host else "").lower().split("."))) + ")" + rest


def warc(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", uri: str | None = None) -> DataFrame:
    """Write the archives and their index, then look every page up; one row for each record."""
    uri = uri or scratch(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    p = p.withColumn("surt", surt(F.col("url"))).withColumn("sha", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha1(F.col("html").cast("binary")))))
    same = p.where("sha is not null").groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count(F.lit(1)).alias("n"))
    # Written first: the planner then knows its size and need not shuffle the pages where it is small
    same = written(same.where("n > 1").select("sha", "n", F.col("kept.page_id").alias("refers_to"), F.col("kept.url").alias("refers_url")), "warc-equal")
    p = looked_up(p, same, "sha", ["page_id", "url"])
    other = F.coalesce(F.col("refers_to") != F.col("page_id"), F.col("refers_to").isNotNull())
    p = p.select("page_id", "url", "html", "surt", F.when(other, F.col("refers_to")).alias("refers_to"), "refers_url")
    captures = write_archives(p, uri)
    top = write_index(captures, uri)
    requests = captures.select("surt", "page_id")
    n = max(pages.sparkSession.sparkContext.defaultParallelism, -(-captures.count() // 100_000))
    return read_back(requests.repartitionByRange(n, "surt", "page_id").sortWithinPartitions("surt", "page_id"), uri, top, surt_text)

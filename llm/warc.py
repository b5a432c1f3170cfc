"""WARC archives with a two-level capture index.

Pages are written as WARC records, one gzip member each, by the tasks that hold them, with file names that no other
attempt shares; the table of captures that Spark commits names only files of attempts that succeeded.  Of equal payloads of at
least ``least`` bytes the record of the smallest page_id is a response and the others revisit it.

The index sorts captures by reversed-host key into shards.  A shard is a file of compressed blocks of ``block`` captures and
a sparse directory with the first key of each block.  A lookup searches the shards' first keys, then the shard's
directory, then one block, each by bisection, and range-reads the block and the record.  Files are opened through
pyarrow's file systems (file, hdfs, s3, gs), so the folder must be one of these.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import batch_rows, materialize, partitions, scratch_path

LEAST = 100
BLOCK = 500
FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
CAPTURES = "urlkey string, page_id long, file string, offset long, length long"
SHARDS = "first_key string, first_id long, blocks string, directory string, captures long"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NO_ID = -(1 << 63)  # sorts before all, as nulls do
_END = b"\r\n"


def url_key(url: str | None) -> str:
    """The host's labels in reverse, then port, path, query; white space and control characters are escaped.

    A null or unreadable address has a key of its own kind, so that it can be looked up too.
    """
    url = url or ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        parts, host, port = None, "", None
    if host:
        key = ",".join(reversed(host.rstrip(".").split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
        key += f"?{parts.query}" if parts.query else ""
    else:
        key = f"){url}"
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in key)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None) -> bytes:
    """One record as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Type", "response" if revisits is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
              ("WARC-Date", DATE), ("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if revisits is None:
        body = http + payload
    else:
        body = http
        fields += [("WARC-Refers-To", f"<urn:page:{revisits}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}".encode() + _END for k, v in fields) + _END
    return gzip.compress(head + body + _END + _END, 6, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields of a record, and its payload."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(_END + _END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    return fields, body.partition(_END + _END)[2]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Writer:
    """A file under a name that no other attempt of the task uses."""

    def __init__(self, folder: str, ending: str):
        self.path = f"{folder}/{uuid.uuid4().hex}{ending}"
        system, place = _opened(self.path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.out, self.size = system.open_output_stream(place, compression=None), 0

    def add(self, data: bytes) -> int:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()


def typed(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, revisits: the page_id of the response with the same payload, null for a response."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html"), 256))
    equal = rows.where(F.octet_length("html") >= least).groupBy("digest")
    equal = equal.agg(F.min("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(equal.select("digest", "response"), "digest", "left")
    return rows.select("page_id", "url", "html", "digest",
                       F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("revisits"))


def write(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; gives the captures (urlkey, page_id, file, offset, length), kept in the shared folder.

    A null html is an empty payload; rows that repeat a page_id are records of their own; an empty table writes no file;
    other columns are ignored.
    """
    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Writer | None = None
        for batch in batch_rows(batches, 512):
            rows = []
            for page_id, url, html, digest, revisits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and out.size >= file_bytes:
                    out.close()
                    out = None
                if out is None:
                    out = _Writer(f"{folder}/warc", ".warc.gz")
                member = record(page_id, url, html.encode(), digest, revisits)
                rows.append((url_key(url), page_id, out.path, out.add(member), len(member)))
            yield _batch(rows, CAPTURES)
        if out is not None:
            out.close()

    return materialize(typed(pages, least).mapInArrow(archive, CAPTURES), "captures")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)],
                                      names=[n for n, _ in fields])


def build_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Write the shards of the index; gives one row for each, kept in the shared folder."""
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = directory = None
        lines: list[str] = []
        total, first = 0, None

        def flush() -> None:
            nonlocal lines
            data = zlib.compress("\n".join(lines).encode(), 6)
            key, page_id = lines[0].split("\t")[:2]
            directory.add(f"{key}\t{page_id}\t{blocks.add(data)}\t{len(data)}\n".encode())
            lines = []

        for batch in batch_rows(batches, 4096):
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if blocks is None:
                    blocks, directory = _Writer(f"{folder}/index", ".blocks"), _Writer(f"{folder}/index", ".directory")
                    first = (key, page_id)
                lines.append(f"{key}\t{_NO_ID if page_id is None else page_id}\t{file}\t{offset}\t{length}")
                total += 1
                if len(lines) == block:
                    flush()
        if blocks is not None:
            if lines:
                flush()
            blocks.close()
            directory.close()
            yield _batch([(*first, blocks.path, directory.path, total)], SHARDS)

    ordered = captures.select("urlkey", "page_id", "file", "offset", "length")
    ordered = ordered.repartitionByRange(partitions(captures.sparkSession), "urlkey", "page_id")
    return materialize(ordered.sortWithinPartitions("urlkey", "page_id").mapInArrow(shard, SHARDS), "shards")


class Reader:
    """Looks captures up; keeps open what was read last."""

    def __init__(self, shards: list[tuple[str, int | None, str, str]], kept: int = 8):
        self.shards = sorted((_key(k, i), blocks, directory) for k, i, blocks, directory in shards)
        self.firsts = [s[0] for s in self.shards]
        self.kept, self.files, self.directories, self.blocks = kept, OrderedDict(), OrderedDict(), OrderedDict()

    def _once(self, cache: OrderedDict, name: object, make) -> object:
        if name not in cache:
            if len(cache) >= self.kept:
                cache.popitem(last=False)
            cache[name] = make()
        cache.move_to_end(name)
        return cache[name]

    def read(self, path: str, offset: int, length: int) -> bytes:
        system, place = _opened(path)
        return self._once(self.files, path, lambda: system.open_input_file(place)).read_at(length, offset)

    def _directory(self, path: str) -> tuple[list[tuple[bytes, int]], list[tuple[int, int]]]:
        def load():
            system, place = _opened(path)
            with system.open_input_stream(place, compression=None) as f:
                lines = [x.split("\t") for x in f.read().decode().split("\n")[:-1]]
            return [_key(k, int(i)) for k, i, _, _ in lines], [(int(a), int(n)) for _, _, a, n in lines]

        return self._once(self.directories, path, load)

    def _block(self, path: str, offset: int, length: int) -> tuple[list[tuple[bytes, int]], list[tuple[str, int, int]]]:
        def load():
            lines = [x.split("\t") for x in zlib.decompress(self.read(path, offset, length)).decode().split("\n")]
            return [_key(k, int(i)) for k, i, *_ in lines], [(f, int(a), int(n)) for _, _, f, a, n in lines]

        return self._once(self.blocks, (path, offset), load)

    def captures(self, urlkey: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of the records of a page."""
        wanted = _key(urlkey, page_id)
        at = max(0, bisect_left(self.firsts, wanted) - 1)
        while at < len(self.shards) and self.firsts[at] <= wanted:
            _, blocks, directory = self.shards[at]
            firsts, places = self._directory(directory)
            k = max(0, bisect_left(firsts, wanted) - 1)
            while k < len(firsts) and firsts[k] <= wanted:
                keys, found = self._block(blocks, *places[k])
                yield from found[bisect_left(keys, wanted):bisect_right(keys, wanted)]
                k += 1
            at += 1


def _key(urlkey: str, page_id: int | None) -> tuple[bytes, int]:
    return urlkey.encode(), _NO_ID if page_id is None else page_id


def lookup(pages: DataFrame, shards: DataFrame) -> DataFrame:
    """Read the records of the pages (page_id, url) back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    What a response says of its payload is checked against the payload.  The driver reads the list of shards, one row for
    each partition of the index, and no more.
    """
    known = [(r["first_key"], r["first_id"], r["blocks"], r["directory"])
             for r in shards.select("first_key", "first_id", "blocks", "directory").collect()]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [url_key(u) for u in batch["url"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch["page_id"]], names=["urlkey", "page_id"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(known)
        for batch in batch_rows(batches, 1024):
            rows = []
            for urlkey, page_id in zip(batch["urlkey"].to_pylist(), batch["page_id"].to_pylist(), strict=True):
                for place in reader.captures(urlkey, page_id):
                    fields, payload = parsed(reader.read(*place))
                    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                    revisits = fields.get("WARC-Refers-To")
                    if revisits is None and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{place[0]} at {place[1]}: the payload is not what its record says")
                    rows.append((page_id, n, digest, fields["WARC-Type"],
                                 None if revisits is None else int(revisits[len("<urn:page:"):-1])))
            yield _batch(rows, PAGES)

    wanted = pages.select(F.col("page_id").cast("long"), "url").mapInArrow(keyed, "urlkey string, page_id long").distinct()
    wanted = wanted.repartitionByRange(partitions(pages.sparkSession), "urlkey", "page_id")
    return wanted.sortWithinPartitions("urlkey", "page_id").mapInArrow(fetch, PAGES)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives and index to a fresh folder of the shared one and read every page back through the index."""
    folder = scratch_path(pages.sparkSession, "warc")
    return lookup(pages, build_index(write(pages, folder), folder))

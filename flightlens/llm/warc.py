"""WARC files: writing, a normaliser for monolithic gzip, and reading by offset.

``write_archives`` writes records into whole-file gzip streams, as some
crawlers do: one stream per file, so no record can be reached without
inflating all before it. ``normalise`` inflates each stream once, rewrites
every record as a gzip member of its own, and writes a sidecar index with each
record's offset and length. ``read_archives`` reaches records through it.

Files stream through a task in pieces of ``PIECE`` bytes, so memory does not grow
with a file; one record is held at a time, its payload about three times. Files live in the shared folder. A task names
its files at random and reports them; only files reported by a finished task
are read later, so a lost executor or a repeated attempt leaves unused files,
never wrong ones.

Equal payloads: the record with the largest page id is the response, the
others are revisits that refer to it. The largest id of each digest is a
grouped maximum (partial before the shuffle); only digests that occur more
than once are joined back.

Defined cases: null html is an empty payload; a null page id is smaller than
any other, and if all pages of a payload have none, all are responses; rows
alike in id and payload are alike in the archives; a null url leaves out the
target header; a very long html is one record of one task; an empty table gives
no archives and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.runtime import prepare, rows_by_bytes, scratch_folder, staged

FILE_BYTES = 64 << 20          # payload bytes of an archive before the next one begins
PIECE = 1 << 20
LEVEL = 1                      # of compression; the archives are read by machines
DATE = "2024-01-01T00:00:00Z"
_GZIP = 31                     # window bits for gzip framing
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a Hadoop-style URI."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def _target(url: str) -> str:
    return quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")


def record(page_id, url, payload: bytes, refers_to, is_revisit: bool) -> tuple[bytes, bytes]:
    """(head, body) of a WARC record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_target(url)}")
    if is_revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = http if is_revisit else http + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), body


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        out, packer, name, records, size, done = None, None, "", 0, 0, []

        def close():
            out.write(packer.flush())
            out.close()
            done.append((f"{folder}/{name}", records))

        for batch in rows_by_bytes(batches, "data"):
            for page, url, data, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "data", "refers_to"))):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=_GZIP)
                head, body = record(page, url, data or b"", refers, refers is not None)
                for part in (head, body, b"\r\n\r\n"):
                    out.write(packer.compress(part))
                records, size = records + 1, size + len(body)
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()),
                                          "records": pa.array([n for _, n in done], pa.int64())})
    return run


class Inflater:
    """Reads inflated bytes of a gzip file of one or more members, piece by piece."""

    def __init__(self, stream):
        self.stream, self.z, self.have, self.end = stream, zlib.decompressobj(_GZIP), b"", False

    def _more(self) -> bool:
        while not self.end:
            raw = self.z.unconsumed_tail or self.z.unused_data
            if self.z.eof:
                self.z = zlib.decompressobj(_GZIP)
            raw = raw or self.stream.read(PIECE)
            if not raw:
                self.end = True
                break
            got = self.z.decompress(raw, PIECE)
            if got:
                self.have += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with ``mark``; None at the end of the file."""
        at = 0
        while (found := self.have.find(mark, at)) < 0:
            at = max(0, len(self.have) - len(mark) + 1)
            if not self._more():
                if self.have.strip():
                    raise ValueError("an archive ends within a record")
                return None
        out, self.have = self.have[:found + len(mark)], self.have[found + len(mark):]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.have and not self._more():
                raise ValueError("an archive ends within a record")
            part, self.have = self.have[:n], self.have[n:]
            n -= len(part)
            yield part


def headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, mark, value = line.partition(":")
        if mark:
            out[name.strip().lower()] = value.strip()
    return out


def rewrite(source, target, index) -> int:
    """Rewrite one archive: each record as its own gzip member, a line of ``index`` for each."""
    reader, at, n = Inflater(source), 0, 0
    while (head := reader.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        told = headers(head)
        packer = zlib.compressobj(LEVEL, wbits=_GZIP)
        size = target.write(packer.compress(head))
        for part in reader.pieces(int(told["content-length"])):
            size += target.write(packer.compress(part))
        if b"".join(reader.pieces(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        size += target.write(packer.compress(b"\r\n\r\n") + packer.flush())
        index.write((json.dumps({"offset": at, "length": size, "id": told.get("warc-record-id"),
                                 "type": told.get("warc-type"), "digest": told.get("warc-payload-digest"),
                                 "uri": told.get("warc-target-uri")}) + "\n").encode())
        at, n = at + size, n + 1
    return n


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_fs, root = open_folder(folder)
        out_fs.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = open_folder(path)
                name = f"{uuid.uuid4().hex}.warc.gz"
                with fs.open_input_stream(place, compression=None) as source, \
                        out_fs.open_output_stream(f"{root}/{name}", compression=None) as target, \
                        out_fs.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
                    n = rewrite(source, target, index)
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "index": [f"{folder}/{name}.idx"],
                                                  "records": pa.array([n], pa.int64())})
    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(),
             "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    number = lambda uri: None if uri is None or uri == "<urn:page:none>" else int(uri[10:-1])
    for batch in batches:
        for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
            fs, place = open_folder(path)
            _, lines = open_folder(index)
            rows, size = [], 0
            with fs.open_input_file(place) as archive, fs.open_input_stream(lines, compression=None, buffer_size=PIECE) as side:
                for line in _lines(side):
                    entry = json.loads(line)
                    archive.seek(entry["offset"])
                    z = zlib.decompressobj(_GZIP)
                    data = z.decompress(archive.read(entry["length"]))
                    if not z.eof:
                        raise ValueError(f"{path}: no whole member at {entry['offset']}")
                    head, _, rest = data.partition(b"\r\n\r\n")
                    told = headers(head)
                    body = rest[:int(told["content-length"])]
                    payload = body.partition(b"\r\n\r\n")[2]
                    digest, n = told["warc-payload-digest"].removeprefix("sha1:"), int(told["x-payload-length"])
                    if told["warc-type"] == "response" and (
                            n != len(payload) or digest != base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError(f"{path}: the payload at {entry['offset']} is not the one announced")
                    rows.append((number(told["warc-record-id"]), told.get("warc-target-uri"),
                                 payload if told["warc-type"] == "response" else None, n, digest, told["warc-type"],
                                 number(told.get("warc-refers-to"))))
                    size += len(payload)
                    if size >= PIECE or len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while part := stream.read(PIECE):
        *whole, rest = (rest + part).split(b"\n")
        yield from whole
    if rest:
        yield rest


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write whole-file gzip archives; returns the staged list ``path, records``.

    Payloads of fewer than ``least_bytes`` bytes are never revisits.
    """
    prepare(pages.sparkSession)
    data = F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b""))
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          data.alias("data")).withColumn("digest", F.concat_ws(":", F.sha1("data"), F.octet_length("data")))
    largest = staged(source.filter(F.octet_length("data") >= least_bytes).groupBy("digest")
                     .agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
                     .filter("n > 1 AND largest IS NOT NULL").select("digest", "largest"))
    linked = source.join(largest, "digest", "left").withColumn(
        "refers_to", F.expr("IF(largest IS NOT NULL AND NOT (page_id <=> largest), largest, NULL)"))
    return staged(linked.select("page_id", "url", "data", "refers_to")
                  .mapInArrow(_write(folder), "path string, records long"))


def _spread(archives: DataFrame, *columns: str) -> DataFrame:
    """About one task per archive: the rows are few and small, the files are not."""
    return archives.select(*columns).repartition(max(1, archives.count()), "path")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite the archives in ``path``; returns the staged list ``path, index, records``."""
    return staged(_spread(archives, "path").mapInArrow(_normalise(folder), "path string, index string, records long"))


def read_archives(archives: DataFrame) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` of each record."""
    return _spread(archives, "path", "index").mapInArrow(
        _read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
               "record_type string, refers_to long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write, normalise, read back."""
    folder = scratch_folder(pages.sparkSession)
    return read_archives(normalise(write_archives(pages, f"{folder}/whole", **options), f"{folder}/members"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

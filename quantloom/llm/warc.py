"""WARC archives: writing with revisit records, and reading record by record.

Archives are gzip files with one member for each record: a warcinfo record first, then a response with its HTTP block for
each page, or a revisit with the HTTP header alone. The reader takes a file in chunks, inflates no more of a member than the
record's Content-Length asks for, and checks the digest of every payload that it holds. It keeps one record in memory at a
time. Fields that begin with ``X-`` are this engine's own: they carry page ids, which no standard field has room for.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, meet_groups, rows, settle, shared_folder

_CHUNK = 1 << 20
#: Bytes in which a record's header has to end.
_HEADER = 1 << 20
_NAMES = uuid.UUID("8a4e9d1c-3a0e-4d57-9d0c-5b1f3f6a2c11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payloads after which an archive ends, at the next record's end.
ARCHIVE = 256 << 20


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


class DamagedArchive(ValueError):
    """A record that isn't framed as WARC, is cut short or too long, or whose payload doesn't have its digest."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack(headers: dict[str, str], payload: bytes) -> bytes:
    """One record as one gzip member. Line ends in values become spaces."""
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in headers.items()), f"Content-Length: {len(payload)}", "", ""]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode()) + deflate.compress(payload) + deflate.compress(b"\r\n\r\n") + deflate.flush()


class _Member:
    """One gzip member that is inflated as far as is asked."""

    def __init__(self, source: io.RawIOBase, left: bytes) -> None:
        self.source, self.left, self.inflate, self.held = source, left, zlib.decompressobj(31), bytearray()

    def _more(self, most: int) -> bool:
        """Inflates up to ``most`` bytes more; false at the member's end."""
        while not self.inflate.eof:
            if not self.left and not (chunk := self.source.read(_CHUNK)):
                raise DamagedArchive("the archive ends inside a member")
            try:
                out = self.inflate.decompress(self.left or chunk, most)
            except zlib.error as error:
                raise DamagedArchive("a member isn't gzip") from error
            self.left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                self.held += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """The bytes before a mark, which is taken too."""
        seen = 0
        while (at := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if seen > _HEADER or not self._more(4096):
                raise DamagedArchive("a member doesn't begin with a WARC record")
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more(min(_CHUNK, n - len(self.held))):
                raise DamagedArchive("a record isn't as long as it says")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def end(self) -> bytes:
        """What lies behind the member in the file; nothing may be left in it."""
        if self.held or self._more(1):
            raise DamagedArchive("a record isn't as long as it says")
        return self.left


def read_records(source: io.RawIOBase) -> Iterator[Record]:
    """Records of an archive in order, of any type. The payload of a response or revisit with an HTTP block is what stands
    behind its header; of others, the block. A digest is checked where a response states one by SHA-1."""
    left = b""
    while left or (left := source.read(_CHUNK)):
        member = _Member(source, left)
        lines = member.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/") or not headers.get("content-length", "").isdecimal():
            raise DamagedArchive("a member doesn't begin with a WARC record")
        payload = member.take(int(headers["content-length"]))
        if member.take(4) != b"\r\n\r\n":
            raise DamagedArchive("a record isn't as long as it says")
        left = member.end()
        if headers.get("content-type", "").startswith("application/http"):
            payload = payload.partition(b"\r\n\r\n")[2]
        stated = headers.get("warc-payload-digest", "")
        if headers.get("warc-type") == "response" and stated.startswith("sha1:") and stated != f"sha1:{digest_of(payload)}":
            raise DamagedArchive(f"the payload of {headers.get('warc-record-id')} doesn't have its digest")
        yield Record(headers, payload)


def _record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name the record that it refers to."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(_NAMES, f'{page_id} {digest}')}>"


def _roles(pages: DataFrame) -> DataFrame:
    """``page_id, payload (the key of equal payloads), keeper``: the largest page_id of each payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("key"))
    keys = settle(keys, "warc-keys")
    groups = settle(keys.groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("times")).where("times > 1"), "warc-groups")
    return meet_groups(keys, groups, "key", "times").where("page_id < keeper").select("page_id", "key", "keeper").distinct()


def write_archives(pages: DataFrame, folder: str, archive: int = ARCHIVE, date: str | None = None) -> DataFrame:
    """Writes a record for each row of ``pages`` into ``folder`` (a URI that all executors share); returns the manifest.

    Of rows with equal payloads (the html in UTF-8, null as empty), the one with the largest page_id is a response and
    the others are revisits of it; rows that repeat that page_id and payload are responses too. A null page_id is written
    without one, as a response. A null url is left out. Files have names of their own for each attempt; the manifest
    lists those of finished tasks. An empty table makes no archive. ``date`` (now, if not given) is the WARC-Date of all.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisits = _roles(pages).select(F.col("page_id").alias("_page"), F.col("key").alias("_key"), "keeper")
    text = F.coalesce(F.col("html"), F.lit(""))
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").alias("url"), text.alias("html"))
    source = source.join(revisits, (source["page_id"] == revisits["_page"]) & (F.unhex(F.sha2(source["html"].cast("binary"), 256)) == revisits["_key"]), "left")
    source = source.select("page_id", "url", "html", "keeper")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, out, size, n, seq, path = TaskContext.get().partitionId(), uuid.uuid4().hex, None, 0, 0, 0, ""
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        done = lambda: pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))
        try:
            for part_rows in rows(batches, 64):
                for page_id, url, html, keeper in part_rows:
                    if out is None:
                        name = f"{part:06d}-{seq:06d}-{attempt}.warc.gz"
                        out, path, size, n = fs.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0, 0
                        info = {"WARC-Type": "warcinfo", "WARC-Record-ID": _record_id(None, ""), "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}
                        out.write(pack(info, b"software: quantloom\r\nformat: WARC File Format 1.1\r\n"))
                    payload = html.encode()
                    digest = digest_of(payload)
                    headers = {"WARC-Type": "response" if keeper is None else "revisit", "WARC-Record-ID": _record_id(page_id, digest), "WARC-Date": date}
                    if url is not None:
                        headers["WARC-Target-URI"] = url
                    if page_id is not None:
                        headers["X-Page-ID"] = str(page_id)
                    headers |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
                    if keeper is not None:
                        headers |= {"WARC-Refers-To": _record_id(keeper, digest), "WARC-Profile": _PROFILE, "X-Refers-To-Page": str(keeper), "X-Payload-Length": str(len(payload))}
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    out.write(pack(headers, http + payload if keeper is None else http))
                    size, n = size + len(payload), n + 1
                    if size >= archive:
                        out.close()
                        out, seq = None, seq + 1
                        yield done()
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield done()

    return settle(source.mapInArrow(write, "path string, n_records bigint"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The responses and revisits of the archives that ``manifest`` (``path``) lists: ``page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload``. The payload of a revisit is null. Archives of others have null page
    ids; where no digest is stated, a response's is computed and a revisit's is null. A damaged archive is an error. An empty
    manifest gives no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        number = lambda x: None if x is None else int(x)
        for part in rows(batches, 1):
            for (path,) in part:
                fs, at = file_system(path)
                found, size = [], 0
                with fs.open_input_stream(at, compression=None) as f:
                    for r in read_records(f):
                        h, kind = r.headers, r.headers.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or (digest_of(r.payload) if kind == "response" else None)
                        length = len(r.payload) if kind == "response" else number(h.get("x-payload-length"))
                        found.append((number(h.get("x-page-id")), h.get("warc-target-uri"), length, digest, kind, number(h.get("x-refers-to-page")), r.payload if kind == "response" else None))
                        size += len(r.payload)
                        if size > _CHUNK * 4 or len(found) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
                            found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    spread = manifest.select("path").repartition(min(max(1, manifest.count()), 20_000))
    return spread.mapInArrow(read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder and reads them back, a row for each row of ``pages``. Nulls, repeated rows and
    empty tables as in ``write_archives``; other columns are ignored."""
    return read_archives(write_archives(pages, shared_folder(pages.sparkSession, "warc")))

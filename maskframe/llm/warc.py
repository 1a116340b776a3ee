"""WARC archives: a writer with revisit records, and a reader that splits gzip files.

Writing: one gzip member a record. Of records with equal payloads of at least ``REVISIT`` bytes the one with the smallest
id is a response, the others revisit it; the payloads themselves are shuffled once, by id. A task's files carry its
attempt's number, and only files that a finished task reports are read, so a lost executor leaves nothing behind that counts.

Reading: files are cut into byte ranges. A task looks for gzip's magic in its range, takes a place as a member if its
header and the first bytes of a WARC record decode, follows the members from there, and owns the records that start
inside its range; the last one may end beyond it. If a member turns out not to decode, the search goes on behind it.
Any WARC 1.0 or 1.1 file with a record in each member can be read: records of all types, with any kind of id and with
headers without blanks or over several lines. Of a record that doesn't parse nothing is returned; the next one is.

A null payload is empty. Rows that repeat an id and a payload are all responses, or all revisits. A null id counts as
larger than all others. No rows: no archive, no records.

Archives are written and read by Arrow's own file systems: local or mounted folders, HDFS, S3 and GCS. A path without a
scheme is that of Hadoop's default file system. Other schemes raise an error on the driver, before anything runs.
"""

from __future__ import annotations

import base64
import binascii
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
REVISIT, SPLIT, ROLL, LEVEL = 100, 8 << 20, 256 << 20, 3
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: A header that only the writer here adds: its URIs have line breaks escaped.
OWN = "x-payload-length"
#: A revisit of an identical payload, as WARC 1.1 names it.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: What Hadoop calls a scheme, and Arrow.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs"}


def qualified(spark, path: str) -> str:
    """The path as a URI that Arrow opens; Hadoop's default file system where it has no scheme."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.toUri().getScheme() is None:
        target = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target)
    uri = target.toUri()
    if uri.getScheme() not in SCHEMES:
        raise ValueError(f"WARC archives can't lie at {path}: schemes are {', '.join(SCHEMES)}")
    return f"{SCHEMES[uri.getScheme()]}://{uri.getAuthority() or ''}{uri.getPath()}"


def _filesystem(uri: str):
    from pyarrow import fs

    # the path as it stands: from_uri would read % and blanks as URI syntax
    scheme, _, rest = uri.partition("://")
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    host, _, below = rest.partition("/")
    return fs.FileSystem.from_uri(f"{scheme}://{host}/")[0], f"/{below}" if scheme == "hdfs" else f"{host}/{below}"


def record(kind: str, id_: int | None, uri: str | None, payload: bytes, digest: str, size: int, refers: int | None) -> bytes:
    block = HTTP + (payload if kind == "response" else b"")
    at = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if id_ is None else id_}>", f"WARC-Date: {at}",
        *([f"WARC-Target-URI: {_header(uri)}"] if uri is not None else []), f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers}>"] if kind == "revisit" else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header(value: str) -> str:
    return value.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def _plain(value: str) -> str:
    out, k = [], 0
    while k < len(value):
        if value[k] == "\\" and k + 1 < len(value):
            out.append({"r": "\r", "n": "\n"}.get(value[k + 1], value[k + 1]))
            k += 2
        else:
            out.append(value[k])
            k += 1
    return "".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names; values trimmed, their further lines joined by a blank) and block of one record.

    The block is cut at Content-Length, if there is one. ValueError where the version line or a header's colon is missing.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        head, _, rest = data.partition(b"\n\n")
    version, *lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name is not None:
            headers[name] = f"{headers[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header without a colon")
        name = name.strip().lower()
        headers[name] = value.strip()
    length = headers.get("content-length", "")
    return headers, rest[: int(length)] if length.isdigit() else rest


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """What an HTTP message's headers are followed by; the whole block of any other record."""
    if not block.startswith(b"HTTP/") and not headers.get("content-type", "").lower().startswith("application/http"):
        return block
    head, gap, body = block.partition(b"\r\n\r\n")
    return body if gap else block.partition(b"\n\n")[2]


def digest_of(value: str | None) -> str | None:
    """A stated digest: bare lower-case hex of a sha256 in hex or base 32, else as it is stated."""
    if not value:
        return None
    kind, colon, text = value.partition(":")
    if colon and kind.lower() in ("sha256", "sha-256"):
        if len(text) == 64:
            return text.lower()
        if len(text.rstrip("=")) == 52:
            try:
                return base64.b32decode(text.rstrip("=").upper() + "====").hex()
            except binascii.Error:
                return value
    return value


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` below ``path``; (file, size, records) of each archive."""
    spark = pages.sparkSession
    path = qualified(spark, path)
    null = F.lit(common.NULL_ID)
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("long"), null).alias("id"), F.col(uri_col).alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    light = rows.where(F.octet_length("payload") >= REVISIT).select("id", "digest")
    owner = light.groupBy("digest").agg(F.min("id").alias("owner"), F.max("id").alias("top")).where("owner < top").select(F.col("digest").alias("d"), "owner")
    again = light.join(owner.hint("merge"), F.col("digest") == F.col("d")).where("id > owner").select(F.col("id").alias("i"), "d", "owner").distinct()
    rows = rows.join(again.hint("merge"), (F.col("id") == F.col("i")) & (F.col("digest") == F.col("d")), "left").select("id", "uri", "payload", "digest", "owner")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _filesystem(path)
        fs.create_dir(root, recursive=True)
        stream, name, count, number = None, "", 0, 0

        def closed():
            size = stream.tell()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], ["file", "size", "records"])

        for batch in batches:
            for id_, uri, payload, digest, own in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if stream is not None and stream.tell() > ROLL:
                    yield closed()
                    stream, count = None, 0
                if stream is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.gz"
                    stream, number = fs.open_output_stream(f"{root}/{name}", compression=None), number + 1
                data = payload.encode()
                kind = "response" if own is None else "revisit"
                stream.write(member(record(kind, None if id_ == common.NULL_ID else id_, uri, data, digest, len(data), own)))
                count += 1
        if stream is not None:
            yield closed()

    written = rows.mapInArrow(run, "file string, size long, records long")
    manifest = common.scratch(spark, "manifest")
    written.write.parquet(manifest)
    return spark.read.schema("file string, size long, records long").parquet(manifest)


class Members:
    """The members of a gzip file that begin in [start, end)."""

    def __init__(self, handle, size: int, start: int, end: int, block: int = 1 << 18):
        self.handle, self.size, self.start, self.end, self.block = handle, size, start, end, block

    def at(self, place: int, n: int) -> bytes:
        self.handle.seek(place)
        return self.handle.read(min(n, self.size - place))

    def begins(self, place: int) -> bool:
        """Whether a record's first bytes decode here."""
        try:
            return zlib.decompressobj(31).decompress(self.at(place, 4096), 16).startswith(b"WARC/")
        except zlib.error:
            return False

    def whole(self, place: int) -> tuple[bytes, int] | None:
        """The member here and where it ends, or None."""
        inflate, parts, at = zlib.decompressobj(31), [], place
        try:
            while not inflate.eof:
                piece = self.at(at, self.block)
                if not piece:
                    return None
                parts.append(inflate.decompress(piece))
                at += len(piece)
        except zlib.error:
            return None
        return b"".join(parts), at - len(inflate.unused_data)

    def __iter__(self):
        place = self.start
        while place < self.end:
            found = self.whole(place) if self.begins(place) else None
            if found is not None:
                yield place, found[0]
                place = found[1]
                continue
            place = self.search(place + 1)

    def search(self, place: int) -> int:
        """The next place with gzip's magic, or the range's end."""
        while place < self.end:
            piece = self.at(place, min(self.block, self.end - place) + len(MAGIC) - 1)
            k = piece.find(MAGIC)
            if k >= 0 and place + k < self.end:
                return place + k
            place += max(1, len(piece) - len(MAGIC) + 1)
        return self.end


def archives(spark, path: str) -> DataFrame:
    """(file, size) of the archives in a folder, by name: ``*.warc.gz``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.col("length").alias("size"))


def read_warc(files: DataFrame, path: str, split: int = SPLIT) -> DataFrame:
    """Records of the archives listed in ``files`` (file, size) below ``path``.

    (file, offset, id, uri, type, payload, length, digest, refers): ids as written, without angle brackets; the payload of all
    but revisits; length and sha256 digest of the payload, for revisits what is stated of the payload that they refer to
    (null if nothing is).
    """
    path = qualified(files.sparkSession, path)
    ranges = files.where("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.repartition(common.shuffle_partitions(files.sparkSession), "file", "start")

    def run(batches):
        names = ["file", "offset", "id", "uri", "type", "payload", "length", "stated", "refers"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        bare = lambda v: v[1:-1] if v and v[0] == "<" and v[-1] == ">" else v
        fs, root = _filesystem(path)
        for batch in batches:
            for file, size, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows, held = [], 0
                with fs.open_input_file(f"{root}/{file}") as handle:
                    for place, data in Members(handle, size, start, min(start + split, size)):
                        try:
                            h, block = parse(data)
                        except ValueError:
                            continue
                        uri, kind = bare(h.get("warc-target-uri")), h.get("warc-type", "").lower()
                        payload = None if kind == "revisit" else payload_of(h, block)
                        length = h.get("x-payload-length", "")
                        rows.append((file, place, bare(h.get("warc-record-id")), None if uri is None else _plain(uri) if OWN in h else uri, kind, payload, int(length) if length.isdigit() else None, digest_of(h.get("warc-payload-digest")), bare(h.get("warc-refers-to"))))
                        held += len(payload or b"")
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    out = ranges.mapInArrow(run, "file string, offset long, id string, uri string, type string, payload binary, length long, stated string, refers string")
    # where there is a payload, its figures are those of the bytes that came back
    length = F.coalesce(F.octet_length("payload").cast("long"), F.col("length"))
    return out.select("file", "offset", "id", "uri", "type", "payload", length.alias("length"), F.coalesce(F.sha2("payload", 256), F.col("stated")).alias("digest"), "refers")


def number_of(urn: str):
    """The page id in an id of the writer's, ``urn:page:N``; null in any other."""
    return F.regexp_extract(urn, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")


def op10_warc(spark, sf_dir) -> DataFrame:
    path = common.scratch(spark, "warc")
    files = write_warc(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_warc(files, path).select(
        number_of("id").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number_of("refers").alias("refers_to")
    )


OP10_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > owner THEN owner END AS refers_to
FROM o
"""

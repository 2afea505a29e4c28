"""WARC archives: one gzip member a record, read in sequence with bounded memory."""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import bounded_batches, fresh_path, written

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
CHUNK = 1 << 16
#: An archive is closed once it holds so many compressed bytes.
ARCHIVE_BYTES = 16 << 20
#: Revisits up to which their list is broadcast: some 30 MB.
BROADCAST_ROWS = 200_000
URN = "urn:x-page:"
MANIFEST = "path string, n_records long, n_bytes long"


class WarcError(ValueError):
    """A record whose framing or digest is wrong."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def open_uri(uri: str, mode: str = "rb"):
    """A binary stream on the local, HDFS, S3 or GCS store that the URI names."""
    from pyarrow import fs

    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3" + uri[3:]
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_stream(path, compression=None)


def _clean(value: str) -> str:
    """Header values must stay on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int = 6) -> bytes:
    """The gzip member of a response, or of a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    named = "none" if page_id is None else page_id
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{URN}{named}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url or "urn:x-unknown")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(text + block + b"\r\n\r\n") + packer.flush()


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of decompressed chunks."""
    held = b""
    while True:
        held = held or stream.read(CHUNK)
        if not held:
            return
        unpacker = zlib.decompressobj(31)

        def chunks(unpacker=unpacker):
            nonlocal held
            while not unpacker.eof:
                if not held and not (held := stream.read(CHUNK)):
                    raise WarcError("the stream ends inside a gzip member")
                data = unpacker.decompress(held, CHUNK)
                held = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
                if data:
                    yield data

        member = chunks()
        yield member
        for _ in member:  # what the caller left
            pass


def _headers(lines: Iterable[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in b" \t" and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, _, value = line.partition(b":")
        last = name.strip().decode("utf-8", "replace").lower()
        out[last] = value.strip().decode("utf-8", "replace")
    return out


def read_records(stream, unverified: bool = False) -> Iterator[Record]:
    """The records of an archive, framed by content-length, their digests verified.

    At most one record is held. Wrong framing or a wrong digest raises WarcError; so does a record
    without a block digest, or one that carries its payload without the payload's, unless `unverified`.
    """
    for member in _members(stream):
        data = bytearray()
        while (end := data.find(b"\r\n\r\n")) < 0:
            part = next(member, None)
            if part is None:
                raise WarcError("a record without the end of its headers")
            data += part
        first, *lines = bytes(data[:end]).split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise WarcError(f"no version line but {first[:20]!r}")
        headers = _headers(lines)
        if not headers.get("content-length", "").isdigit():
            raise WarcError("a record without a content-length")
        length = int(headers["content-length"])
        body = data[end + 4 :]
        for part in member:
            body += part
        if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
            raise WarcError(f"content-length {length} in a body of {len(body)} bytes")
        record = Record(headers, bytes(body[:length]))
        _verify(headers.get("warc-block-digest"), record.block, unverified)
        if headers.get("content-type", "").startswith("application/http"):
            top, found, record.payload = record.block.partition(b"\r\n\r\n")
            if not found:
                raise WarcError("an HTTP block without the end of its headers")
            record.http = _headers(top.split(b"\r\n")[1:])
            if headers.get("warc-type") != "revisit":
                _verify(headers.get("warc-payload-digest"), record.payload, unverified)
        yield record


def _verify(given: str | None, data: bytes, unverified: bool) -> None:
    """Digests in hexadecimal or, as is usual for SHA-1, base 32."""
    name, _, value = (given or "").partition(":")
    name = name.lower().replace("-", "")
    if name not in ("sha1", "sha256", "md5"):
        if unverified:
            return
        raise WarcError(f"a record without a digest that can be verified: {given}")
    found = hashlib.new(name, data).digest()
    if value.lower() != found.hex() and value.rstrip("=") != base64.b32encode(found).decode().rstrip("="):
        raise WarcError("a digest differs from what was read")


def plan_records(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to) of each page.

    Of payloads that are equal and have `min_bytes`, the smallest page_id is written
    whole, others refer to it. A null html is an empty payload. Rows of the
    same page and payload are all written whole where that page is the smallest; pages
    without an id are never referred to. Columns other than page_id, url and html are not read.

    That is decided from ids, digests and lengths alone. The first page of each repeated payload is
    summed on the map side and written, so that Spark may split the join with a very common payload.
    Payloads go to the list of revisits only where that is longer than BROADCAST_ROWS, and then by page.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    keys = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "payload_digest")
    held = keys.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL")
    held = written(held.select("payload_digest", "_first"), "repeated")
    again = keys.join(held, "payload_digest").where("page_id IS NULL OR page_id <> _first").distinct()
    again = written(again.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "_first"), "revisits")
    near = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    found = rows.join(near, rows["page_id"].eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return found.select("page_id", "url", "payload", "payload_digest", F.col("_first").alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives below the folder and returns the table of those that count.

    Names hold the task attempt, and the manifest is committed by Spark: archives of lost or
    speculative attempts are not in it and so never read. Writing runs at once.
    """

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        stem = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        made, out = [], None
        for batch in batches:
            for page_id, url, payload, digest, refers in zip(batch["page_id"], batch["url"], batch["payload"], batch["payload_digest"], batch["refers_to"], strict=True):
                if out is None:
                    path = f"{stem}-{len(made):05d}.warc.gz"
                    out, n, size = open_uri(path, "wb"), 0, 0
                member = make_record(*[None if pd.isna(x) else int(x) for x in (page_id,)], None if url is None else url, payload.encode(), digest, None if pd.isna(refers) else int(refers), date, level)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    made.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, n, size))
        yield pd.DataFrame(made, columns=["path", "n_records", "n_bytes"])

    spark = records.sparkSession
    bounded_batches(spark)
    exact = records.withColumns({"page_id": F.col("page_id").cast("decimal(20,0)"), "refers_to": F.col("refers_to").cast("decimal(20,0)")})
    exact.mapInPandas(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string"


def read_archives(manifest: DataFrame, payloads: bool = False, tasks: int | None = None) -> DataFrame:
    """One row for each record of the archives whose `path` the frame lists.

    A revisit's payload length and digest are those that its headers name. html is null
    unless `payloads`, and for revisits. Archives are streamed, a record at a time.
    """

    def number(urn: str | None) -> int | None:
        found = (urn or "").strip("<>").removeprefix(URN)
        return int(found) if found.lstrip("-").isdigit() else None

    def rows(path: str) -> Iterator[tuple]:
        with open_uri(path) as stream:
            for r in read_records(stream):
                kind = r.headers.get("warc-type")
                size = int(r.http.get("content-length", len(r.payload))) if kind == "revisit" else len(r.payload)
                digest = r.headers["warc-payload-digest"].partition(":")[2]
                text = r.payload.decode("utf-8", "replace") if payloads and kind == "response" else None
                yield number(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), kind, size, digest, number(r.headers.get("warc-refers-to")), text

    names = [x.split()[0] for x in READ.split(", ")]
    kinds = {"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"}

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row[-1] or "") + 200
                    if size >= 8 << 20:
                        yield pd.DataFrame(held, columns=names).astype(kinds)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names).astype(kinds)

    listed = manifest.select("path")
    return (listed.repartition(tasks) if tasks else listed).mapInPandas(read, READ)


def listed_archives(spark: SparkSession, path: str) -> DataFrame:
    """The archives that a path or glob names, as Spark's file source sees it."""
    return spark.read.format("binaryFile").load(path).select("path")


def round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Pages written as archives in the shared folder, then read back."""
    manifest = write_archives(plan_records(pages, min_bytes), fresh_path(pages.sparkSession, "warc"))
    return read_archives(manifest, tasks=max(1, manifest.count()))


def parse_bytes(data: bytes) -> list[Record]:
    return list(read_records(io.BytesIO(data)))

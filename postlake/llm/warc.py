"""WARC archives: one gzip member per record, written in parallel, read back sequentially.

Archives are written to the shared folder (any file system that Arrow can open by URI). The reader
decompresses member by member and buffer by buffer, frames the block by Content-Length and verifies both
digests, so its memory is bounded by the largest record, not by the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from postlake.llm._shared import fresh_path, stored, table, text_batches

#: An archive is closed once it holds this many bytes.
ARCHIVE_BYTES = 256 << 20
#: Compressed bytes that the reader takes at a time.
READ_BYTES = 1 << 16
#: Payload bytes that the reader gathers before it passes rows on.
BATCH_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format or doesn't match its digests."""


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None, date: str = DATE, payload_digest: str | None = None) -> bytes:
    """One gzip member holding a response or a revisit; a revisit keeps the HTTP header and drops the payload. ``payload_digest`` is made if it isn't known."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", _header_value(uri))] if uri is not None else []
    fields += [("WARC-Refers-To", f"<{refers_to}>")] if refers_to is not None else []
    fields += [("WARC-Profile", PROFILE)] if kind == "revisit" else []
    fields += [
        ("WARC-Payload-Digest", f"sha1:{payload_digest or digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream: BinaryIO) -> Iterator[Iterable[bytes]]:
    """For each gzip member its decompressed pieces, which must be used up before the next member is asked for."""
    pending = stream.read(READ_BYTES)
    while pending:
        unpacker = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal pending
            while not unpacker.eof:
                if not pending:
                    pending = stream.read(READ_BYTES)
                    if not pending:
                        raise WarcError("the archive ends inside a record")
                got = unpacker.decompress(pending, READ_BYTES)
                pending = unpacker.unconsumed_tail or unpacker.unused_data
                if got:
                    yield got

        yield pieces()
        pending = pending or stream.read(READ_BYTES)


def parse(pieces: Iterable[bytes]) -> dict:
    """The record in one member: its named fields in lower case, HTTP header fields under ``http``, and its payload."""
    data = bytearray()
    source = iter(pieces)

    def need(found) -> int:
        while (at := found()) < 0:
            piece = next(source, None)
            if piece is None:
                raise WarcError("the record is shorter than it says")
            data.extend(piece)
        return at

    def fields(raw: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8").split("\r\n")[1:])}

    end = need(lambda: data.find(b"\r\n\r\n"))
    head = bytes(data[:end])
    if not head.startswith(b"WARC/1."):
        raise WarcError("no WARC version line")
    out = fields(head)
    size = int(out["content-length"])
    start = end + 4
    need(lambda: 0 if len(data) >= start + size + 4 else -1)
    for piece in source:
        data.extend(piece)
    if data[start + size :] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't frame the record")
    block = bytes(data[start : start + size])
    if out.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise WarcError("the block doesn't match its digest")
    out["payload"] = None
    if out.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        out["http"] = fields(http)
        if out["warc-type"] == "response":
            if out.get("warc-payload-digest", "sha1:" + digest(payload)) != "sha1:" + digest(payload):
                raise WarcError("the payload doesn't match its digest")
            out["payload"] = payload
    return out


def _bare(uri: str | None) -> str | None:
    return uri.strip("<>") if uri is not None else None


def _write(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        out, name, n, size = None, "", 0, 0
        for pdf in batches:
            known = pdf["sha1"] if "sha1" in pdf else [None] * len(pdf)
            for kind, record_id, url, html, refers_to, sha1 in zip(pdf["kind"], pdf["record_id"], pdf["url"], pdf["html"], pdf["refers_to"], known):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                packed = record(kind, record_id, url, html.encode("utf-8"), refers_to, payload_digest=base64.b32encode(bytes.fromhex(sha1)).decode() if sha1 else None)
                out.write(packed)
                n, size = n + 1, size + len(packed)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [n], "bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` and returns the manifest (archive, records, bytes).

    Of rows with equal payloads of at least ``least`` bytes, those with the smallest page_id are
    responses and the others revisits that refer to it; shorter payloads are all responses. A null html
    is an empty payload, a null url leaves the target out, a null page_id gives the record an id without
    a number (such a row is a response only if no equal payload has an id). Rows that repeat both the
    page_id and the payload of a response are responses too. Only archives in the manifest count:
    a task that is run again leaves the files of its lost attempt behind under other names.
    """
    text_batches(pages.sparkSession)
    body = F.coalesce(F.col(html), F.lit(""))
    urn = lambda x: F.concat(F.lit("urn:page:"), F.coalesce(x.cast("string"), F.lit("")))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    rows = rows.withColumn("record_id", urn(F.col("page_id")))
    # only digests are compared; a page then meets its own verdict by id and digest, so equal payloads don't meet in one task
    hashes = rows.where(F.octet_length("html") >= least).select("page_id", "record_id", "sha1")
    equal = stored(hashes.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-equal")
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    revisits = stored(hashes.join(equal, "sha1").where(other).select("record_id", "sha1", urn(F.col("first")).alias("refers_to")).distinct(), "warc-revisits")
    marked = rows.join(revisits, ["record_id", "sha1"], "left").select(F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("kind"), "record_id", "url", "html", "refers_to", "sha1")
    return stored(marked.mapInPandas(_write(folder), "archive string, records long, bytes long"), "warc-manifest")


RECORD = "archive string, record_type string, record_id string, refers_to string, target_uri string, payload_digest string, http_length long, payload binary"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for pdf in batches:
        for archive in pdf["archive"]:
            fs, path = pyarrow.fs.FileSystem.from_uri(archive)
            rows, held = [], 0
            with fs.open_input_stream(path, compression=None) as stream:
                for pieces in members(stream):
                    x = parse(pieces)
                    length = x.get("http", {}).get("content-length")
                    rows.append((archive, x["warc-type"], _bare(x.get("warc-record-id")), _bare(x.get("warc-refers-to")), x.get("warc-target-uri"), x.get("warc-payload-digest", "").removeprefix("sha1:") or None, None if length is None else int(length), x["payload"]))
                    held += len(x["payload"] or b"") + 500
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the archives named in the column ``archive``; see ``RECORD``.

    A revisit has a null payload; its digest and HTTP length are those of the full payload. A broken
    archive (truncated, wrongly framed, digests that differ) raises :class:`WarcError`.
    """
    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInPandas(_read, RECORD)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(manifest).select(
        F.expr("try_cast(substring_index(record_id, ':', -1) as bigint)").alias("page_id"),
        F.col("http_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.expr("try_cast(substring_index(refers_to, ':', -1) as bigint)").alias("refers_to"),
    )


#: The same from the table alone, for DuckDB; base32 is spelt out from the bits of the digest.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
  b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(CAST('0x' || substring(sha1(html), i, 1) AS INT)), 4, '0')), '') AS bits FROM p)
SELECT page_id, strlen(html) AS payload_bytes, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to,
  array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * substring(bits, 5 * i + 1, 1)::INT + 8 * substring(bits, 5 * i + 2, 1)::INT + 4 * substring(bits, 5 * i + 3, 1)::INT + 2 * substring(bits, 5 * i + 4, 1)::INT + substring(bits, 5 * i + 5, 1)::INT AS INT), 1)), '') AS payload_digest
FROM b"""

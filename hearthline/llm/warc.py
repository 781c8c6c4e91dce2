"""WARC archives as seekable Zstandard bundles: records grouped into independent frames, a footer seek table, and an index.

A bundle is one object: Zstandard frames of whole records, then a skippable frame with the compressed and decompressed size
of each. Bundles are kept as binary values of a table in a store that Spark reads and writes, named by their content, so a task that runs again
writes the same; export() puts them out as files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.storage import materialise, spread_key

#: Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLE_SCHEMA = "bundle string, content binary, records array<struct<page_id bigint, frame int, offset bigint, length bigint>>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the HTTP head of the response, with the full payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if revisit:
        lines += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC fields, the HTTP fields and the payload of one record."""
    fields = lambda block: dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:])
    head, rest = raw.split(b"\r\n\r\n", 1)
    warc = fields(head)
    http, payload = rest[: int(warc["Content-Length"])].split(b"\r\n\r\n", 1)
    return warc, fields(http), payload


def seal(frames: list[bytes], sizes: list[int]) -> bytes:
    """The frames with their seek table."""
    table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(frames, sizes)) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(position, compressed size, decompressed size) of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", bundle[len(bundle) - 9 - 8 * n : len(bundle) - 9]):
        out.append((at, c, d))
        at += c
    return out


def frame_bytes(bundle: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    at, c, d = table[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + c], max_output_size=d)


def _bundler(frame_size: int, bundle_size: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("records", pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])
        press = zstandard.ZstdCompressor(level=level)
        frames: list[bytes] = []
        sizes: list[int] = []
        index: list[dict] = []
        open_frame = bytearray()

        def end_frame() -> None:
            if open_frame:
                frames.append(press.compress(bytes(open_frame)))
                sizes.append(len(open_frame))
                open_frame.clear()

        def end_bundle() -> pa.RecordBatch:
            end_frame()
            content = seal(frames, sizes)
            out = pa.RecordBatch.from_pylist([{"bundle": hashlib.sha256(content).hexdigest()[:32], "content": content, "records": list(index)}], schema)
            frames.clear(), sizes.clear(), index.clear()
            return out

        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}
                raw = record(row["page_id"], row["url"], row["payload"] or b"", row["size"], row["digest"], row["refers_to"], row["revisit"])
                index.append({"page_id": row["page_id"], "frame": len(frames), "offset": len(open_frame), "length": len(raw)})
                open_frame += raw
                if len(open_frame) >= frame_size:
                    end_frame()
                    if sum(sizes) >= bundle_size:
                        yield end_bundle()
        if index:
            yield end_bundle()

    return run


def write_bundles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, frame_size: int = 128 << 10, bundle_size: int = 4 << 20, level: int = 3) -> DataFrame:
    """A table of bundles (bundle, content, records) that hold one record per page; records maps ids to frame and offset.

    The payload is the HTML in UTF-8 (null: empty). Of pages with equal payloads of at least ``least`` bytes, that with the
    smallest id is a response and the others revisit it. Rows that repeat that id are responses too; a null id is never the
    smallest if there is another. Payloads travel in one shuffle, by digest, whose hot keys can be split.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    slim = rows.where(F.col("size") >= least).select("page_id", "digest")
    first = slim.groupBy(spread_key("digest"), "digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("size") >= least), "left").withColumn("revisit", revisit)
    typed = typed.select("page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "size", "digest", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit")
    return materialise(typed.mapInArrow(_bundler(frame_size, bundle_size, level), BUNDLE_SCHEMA))


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for a revisit, and where payloads are not asked for) of every record.

    Each frame is found by the seek table and each record by its offset in the frame. A response's length and digest are taken from the payload read; a revisit's from its fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda x: int(x[len("<urn:page:") : -1]) if x and len(x) > len("<urn:page:>") else None
        for batch in batches:
            for content, records in zip(batch.column(0), batch.column(1)):
                bundle, out = content.as_py(), []
                table = seek_table(bundle)
                frame, at = b"", -1
                for r in records.as_py():
                    if r["frame"] != at:
                        at, frame = r["frame"], frame_bytes(bundle, table, r["frame"])
                    warc, http, payload = parse(frame[r["offset"] : r["offset"] + r["length"]])
                    response = warc["WARC-Type"] == "response"
                    out.append({
                        "page_id": name(warc["WARC-Record-ID"]), "url": warc.get("WARC-Target-URI"), "record_type": warc["WARC-Type"], "refers_to": name(warc.get("WARC-Refers-To")),
                        "payload_bytes": len(payload) if response else int(http["Content-Length"]),
                        "payload_digest": hashlib.sha256(payload).hexdigest() if response else warc["WARC-Payload-Digest"].split(":")[1],
                        "payload": payload if response and payloads else None,
                    })
                schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
                yield pa.RecordBatch.from_pylist(out, schema)

    return bundles.select("content", "records").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def export(bundles: DataFrame, uri: str) -> None:
    """Write each bundle as ``<bundle>.warc.zst`` under a URI that pyarrow's file systems reach from every executor; a repeated task replaces its own files by equal ones."""

    def put(rows) -> None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{path}/{row.bundle}.warc.zst") as f:
                f.write(bytes(row.content))

    bundles.select("bundle", "content").foreachPartition(put)


#: DuckDB: what read_bundles(write_bundles(pages)) gives, without the payloads.
ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

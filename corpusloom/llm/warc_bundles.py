"""Seekable Zstandard bundles of WARC records.

Records are grouped into frames that decompress on their own; frames follow each other in
a bundle, which ends in a seek table (a skippable frame in the public seekable
format). An index maps each record to its bundle, frame and place in the frame,
so one record costs one frame. Bundles are rows of a Parquet table: Spark writes them
to any store, and ``bundle`` holds the bytes of a ``.warc.zst`` file.

Of records with equal payloads the one with the largest id holds the payload
(``response``); the others refer to it (``revisit``) and hold headers only.

Defined results: a null payload is an empty one; empty payloads are equal to each
other; rows without an id get no record (there is nothing to address them by); rows that
repeat an id each get a record, and all rows of the holding id are responses; a null url is left out; extra columns are ignored; an empty table gives
no bundles. Payloads are never cut: a record larger than a frame has a frame of its own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: Uncompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 8 << 20
#: Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
#: Holders of repeated payloads are broadcast up to this number (about 100 bytes each); beyond it ids are joined first.
BROADCAST_HOLDERS = 300_000
_CRLF = b"\r\n"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(record_id: int) -> str:
    return f"<urn:x-page:{record_id}>"


def build_record(record_id: int, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: {record_urn(record_id)}".encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}".encode(),
        f"WARC-Payload-Length: {size}".encode(),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    if revisit:
        head += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_urn(refers_to)}".encode(),
        ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}".encode()]
    return _CRLF.join(head) + _CRLF * 2 + body + _CRLF * 2


def parse_record(data: bytes) -> dict:
    """Headers, payload, and for a response the digest and size of what was read."""
    head, _, rest = data.partition(_CRLF * 2)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != _CRLF * 2:
        raise ValueError("a record's length is wrong")
    payload = body.partition(_CRLF * 2)[2]
    revisit = fields["WARC-Type"] == "revisit"
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda urn: int(urn.removeprefix("<urn:x-page:").removesuffix(">"))
    return {
        "record_id": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest,
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None,
    }


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, uncompressed) sizes."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed, uncompressed) of each frame, from the footer."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at, out = len(bundle) - 9 - 8 * count, []
    offset = 0
    for k in range(count):
        packed, plain = struct.unpack_from("<II", bundle, at + 8 * k)
        out.append((offset, packed, plain))
        offset += packed
    return out


def read_frame(bundle: bytes, frame: tuple[int, int, int]) -> bytes:
    offset, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(bundle[offset : offset + packed], max_output_size=plain)


class BundleWriter:
    """Collects records into frames and frames into bundles."""

    def __init__(self, name: str, frame_bytes: int, bundle_bytes: int):
        self.name, self.frame_bytes, self.bundle_bytes = name, frame_bytes, bundle_bytes
        self.pack = zstandard.ZstdCompressor(level=3)
        self.number = 0
        self._new()

    def _new(self) -> None:
        self.packed: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.plain, self.total = 0, 0
        self.index: list[tuple[int, int, int, int]] = []  # record, frame, offset in it, length

    def add(self, record_id: int, record: bytes) -> dict | None:
        """Take a record; a full bundle comes back."""
        if self.plain and self.plain + len(record) > self.frame_bytes:
            self._close_frame()
        self.index.append((record_id, len(self.sizes), self.plain, len(record)))
        self.open.append(record)
        self.plain += len(record)
        if self.plain >= self.frame_bytes:
            self._close_frame()
        return self.end() if self.total >= self.bundle_bytes else None

    def _close_frame(self) -> None:
        packed = self.pack.compress(b"".join(self.open))
        self.packed.append(packed)
        self.sizes.append((len(packed), self.plain))
        self.total += len(packed)
        self.open, self.plain = [], 0

    def end(self) -> dict | None:
        """Close the bundle; None if it is empty."""
        if self.open:
            self._close_frame()
        if not self.sizes:
            return None
        out = {"bundle_id": f"{self.name}-{self.number:05d}", "bundle": b"".join(self.packed) + seek_table(self.sizes), "entries": self.index}
        self.number += 1
        self._new()
        return out


_ENTRIES = pa.list_(pa.struct([("record_id", pa.int64()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("length", pa.int64())]))


def with_roles(pages: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """record_id, url, payload, size, digest and refers_to (null for a response) of every row with an id.

    Payloads of fewer than ``least`` bytes are all responses. The holders of repeated
    payloads are found from digests (SHA-256 and size) alone, pre-aggregated before the shuffle.
    """
    held = pages.filter(F.col(record_id).isNotNull()).select(
        F.col(record_id).cast("long").alias("record_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    held = held.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2(F.encode("payload", "UTF-8"), 256).alias("mark"))
    holders = (
        held.filter(F.col("size") >= least).groupBy("mark", "size")
        .agg(F.max("record_id").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    holders = written(holders, "warc-holders")
    if holders.count() <= BROADCAST_HOLDERS:
        joined = held.join(F.broadcast(holders), ["mark", "size"], "left")
    else:  # only ids and digests meet a common payload's group; payloads are joined by their own row's id
        own = held.select("record_id", "mark", "size").join(holders, ["mark", "size"]).distinct()
        joined = held.join(own, ["record_id", "mark", "size"], "left")
    return joined.select(
        "record_id", "url", "payload", "size", F.when(F.col("holder") != F.col("record_id"), F.col("holder")).alias("refers_to"))


def write_bundles(pages: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0,
                  frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """bundle_id, bundle (binary) and entries (record_id, frame, frame_offset, length) of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(f"part-{TaskContext.get().partitionId():06d}", frame_bytes, bundle_bytes)

        def rows(*made: dict | None) -> Iterator[pa.RecordBatch]:
            for x in made:
                if x:
                    entries = [dict(zip(("record_id", "frame", "frame_offset", "length"), e, strict=True)) for e in x["entries"]]
                    yield pa.RecordBatch.from_arrays([pa.array([x["bundle_id"]]), pa.array([x["bundle"]], pa.binary()), pa.array([entries], _ENTRIES)], ["bundle_id", "bundle", "entries"])

        for part in slices(batches, "payload"):
            for row in part.to_pylist():
                data = row["payload"].encode()
                record = build_record(row["record_id"], row["url"], b"" if row["refers_to"] is not None else data, len(data), payload_digest(data), row["refers_to"])
                yield from rows(writer.add(row["record_id"], record))
        yield from rows(writer.end())

    return with_roles(pages, record_id, url, payload, least).mapInArrow(
        run, "bundle_id string, bundle binary, entries array<struct<record_id:long,frame:int,frame_offset:long,length:long>>")


def record_index(bundles: DataFrame) -> DataFrame:
    """bundle_id and place of every record."""
    return bundles.select("bundle_id", F.inline("entries"))


def read_record(bundle: bytes, entry: dict) -> dict:
    """The record of one index entry (frame, frame_offset, length); only its frame is decompressed."""
    plain = read_frame(bundle, read_seek_table(bundle)[entry["frame"]])
    return parse_record(plain[entry["frame_offset"] : entry["frame_offset"] + entry["length"]])


def fetch_records(bundles: DataFrame, record_ids: list[int]) -> DataFrame:
    """record_id, record_type, url and payload of the records of some ids: one frame is read for each.

    A bundle is one Parquet row: rows without such an id are left out before their bytes reach Python. To export a bundle
    for other WARC tools, write its bytes as ``<bundle_id>.warc.zst``; they skip the footer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [read_record(row["bundle"], x) for x in row["wanted"]]
                yield pa.RecordBatch.from_pylist([{k: x[k] for k in ("record_id", "record_type", "url", "payload")} for x in found], pa.schema([
                    ("record_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload", pa.binary())]))

    wanted = F.filter("entries", lambda x: x["record_id"].isin(*record_ids))
    held = bundles.select("bundle", wanted.alias("wanted")).filter(F.size("wanted") > 0)
    return held.mapInArrow(run, "record_id long, record_type string, url string, payload binary")


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record, found through its bundle's seek table and index and checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, entries in zip(batch.column("bundle"), batch.column("entries"), strict=True):
                data = bundle.as_py()
                frames = read_seek_table(data)
                flat = entries.values
                columns = [flat.field(k).to_numpy() for k in range(4)]
                order = np.argsort(columns[1], kind="stable")
                at = 0
                while at < len(order):
                    frame = columns[1][order[at]]
                    plain = read_frame(data, frames[frame])
                    found = []
                    while at < len(order) and columns[1][order[at]] == frame:
                        k = order[at]
                        record = parse_record(plain[columns[2][k] : columns[2][k] + columns[3][k]])
                        if record["record_id"] != columns[0][k]:
                            raise ValueError("the index points at another record")
                        found.append(record)
                        at += 1
                    yield pa.RecordBatch.from_pylist([x if payloads else x | {"payload": None} for x in found], pa.schema([
                        ("record_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload", pa.binary()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]))

    return bundles.select("bundle", "entries").mapInArrow(
        run, "record_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long")

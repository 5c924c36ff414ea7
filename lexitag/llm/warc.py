"""WARC records in seekable Zstandard bundles.

Every row becomes one WARC/1.1 record. Records are dealt to bundles by a hash of their identifier, so
a bundle holds a bounded number of rows whatever the data. In a bundle, records are grouped into
frames that can be decompressed on their own, and a footer (the public seekable format: a skippable
frame with the sizes of all frames) says where they lie. The index maps every record to its bundle,
frame and offset in the decompressed frame; ``read`` goes by index and footer, frame by frame.

A payload that several records share, of at least ``REVISIT_BYTES``, is stored once: the record
with the smallest identifier is the response, the others are revisit records that name it and the
payload's digest. Which they are follows from one aggregate over digests, with map-side
combination, and a join of identifiers that adaptive execution splits where a digest is hot; the
result travels to a row's bundle beside the row, so payloads are shuffled once.

Defined cases: a null payload is empty; payloads too short to be shared are all responses; null
identifiers come after all others and are never the response of a record that has one; of rows that
agree in identifier and payload, one is the response and the others revisit it; no rows give no
records; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitag.llm.common import quoted, text_batches
from lexitag.llm.shared import Rewritten, new_folder, open_folder
from lexitag.operators.lasting import keep

REVISIT_BYTES = 100
BUNDLE_ROWS = 4096
FRAME_BYTES = 1 << 18
LEVEL = 3
#: Magic numbers of the seekable format (fixed values): the skippable frame and the footer's end.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"  # no record carries a time, so archives of the same rows are equal


def record(
    number: int | None, uri: str, digest: str, payload: bytes, revisit: bool = False, of: int | None = None
) -> bytes:
    """One WARC record; a revisit only refers to the payload of record ``of``."""
    uri = uri.replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:lexitag:record:{number}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:lexitag:record:{of}>",
        ]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    first, *rest = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at offset {at}")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in rest)}
    size = int(headers["content-length"])
    return headers, data[end + 4 : end + 4 + size]


def _number(urn: str) -> int | None:
    text = urn.rstrip(">").rpartition(":")[2]
    return None if text == "None" else int(text)


class _Bundle:
    """Writes one bundle: records in, frames out, the seek table at the end."""

    def __init__(self, folder: str, number: int, frame_bytes: int):
        import zstandard

        self.frame_bytes = frame_bytes
        self.file = Rewritten(folder, f"bundle-{number:08d}.warc.zst")
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.bytes = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset in it) where the record goes."""
        if self.bytes and self.bytes + len(data) > self.frame_bytes:
            self._close_frame()
        place = len(self.frames), self.bytes
        self.held.append(data)
        self.bytes += len(data)
        return place

    def _close_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.held))
        self.file.write(packed)
        self.frames.append((len(packed), self.bytes))
        self.held, self.bytes = [], 0

    def done(self) -> None:
        if self.held:
            self._close_frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.file.done()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, folder: str, number: int):
        import zstandard

        system, path = open_folder(folder)
        self.file = system.open_input_file(f"{path}/bundle-{number:08d}.warc.zst")
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("the bundle has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.starts, at = [], 0
        for packed, _ in struct.iter_unpack("<II", table):
            self.starts.append((at, packed))
            at += packed
        self.unpacker = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, number: int) -> bytes:
        if self.last[0] != number:
            at, size = self.starts[number]
            self.last = number, self.unpacker.decompress(self.file.read_at(size, at))
        return self.last[1]


def _digested(rows: DataFrame, id_col: str, payload_col: str, *more: Column) -> DataFrame:
    """(id, digest, payload, ...) of all rows."""
    payload = F.coalesce(quoted(payload_col).cast("string"), F.lit("")).cast("binary")
    return rows.select(
        quoted(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("digest"), payload.alias("payload"), *more
    )


def shared_payloads(rows: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, digest, first) of the rows whose payload several rows have; ``first`` is its response.

    Payloads are digested where they are read; only identifiers and digests are shuffled.
    """
    all_rows = _digested(rows, id_col, payload_col)
    large = all_rows.filter(F.octet_length("payload") >= REVISIT_BYTES).select("id", "digest")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), "id"))
    shared = large.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return large.join(shared, "digest").select("id", "digest", F.col("first.id").alias("first"))


def write(
    rows: DataFrame,
    id_col: str,
    uri_col: str,
    payload_col: str,
    folder: str,
    bundle_rows: int = BUNDLE_ROWS,
    frame_bytes: int = FRAME_BYTES,
) -> DataFrame:
    """Write the bundles; returns the kept index (id, bundle, frame, offset), one row per record."""
    spark = rows.sparkSession
    text_batches(spark)
    uri = F.coalesce(quoted(uri_col).cast("string"), F.lit("")).alias("uri")
    written = _digested(rows, id_col, payload_col, uri).withColumns({"kind": F.lit(1), "first": F.lit(None).cast("long")})
    known = shared_payloads(rows, id_col, payload_col).withColumn("kind", F.lit(0))
    bundles = max(1, -(-rows.count() // bundle_rows))
    both = written.unionByName(known, allowMissingColumns=True)
    dealt = both.withColumn("bundle", F.pmod(F.xxhash64("id", "digest"), F.lit(bundles)).cast("int"))
    # What is known of a row comes just before it, and rows that agree in both follow one another.
    dealt = dealt.repartitionById(bundles, F.col("bundle")).sortWithinPartitions("bundle", "id", "digest", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, number, last, shared, first = None, None, None, None, None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                row = r["id"], r["digest"]
                if r["kind"] == 0:
                    shared, first = row, r["first"]
                    continue
                if r["bundle"] != number:
                    if bundle:
                        bundle.done()
                    number = r["bundle"]
                    bundle = _Bundle(folder, number, frame_bytes)
                revisit = row == shared and (row == last or r["id"] != first)
                last = row
                data = record(r["id"], r["uri"], r["digest"], r["payload"], revisit, first)
                out.append((r["id"], number, *bundle.add(data)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
            if out:
                yield pa.RecordBatch.from_arrays(columns, ["id", "bundle", "frame", "offset"])
        if bundle:
            bundle.done()

    return keep(dealt.mapInArrow(run, "id long, bundle int, frame int, offset int"))


def read(index: DataFrame, folder: str) -> DataFrame:
    """(id, record_type, refers_to, digest, payload) of the indexed records, read from the bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, number = None, None
        for batch in batches:
            ids, kinds, of, digests, payloads = [], [], [], [], []
            for r in batch.to_pylist():
                if r["bundle"] != number:
                    number = r["bundle"]
                    reader = BundleReader(folder, number)
                headers, payload = parse(reader.frame(r["frame"]), r["offset"])
                ids.append(_number(headers["warc-record-id"]))
                kinds.append(headers["warc-type"])
                revisit = kinds[-1] == "revisit"
                of.append(_number(headers["warc-refers-to"]) if revisit else None)
                digests.append(headers["warc-payload-digest"].removeprefix("sha256:"))
                if not revisit and hashlib.sha256(payload).hexdigest() != digests[-1]:
                    raise ValueError(f"record {ids[-1]}: the payload does not match its digest")
                payloads.append(payload)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(kinds), pa.array(of, pa.int64()), pa.array(digests), pa.array(payloads, pa.binary())],
                ["id", "record_type", "refers_to", "digest", "payload"],
            )

    schema = "id long, record_type string, refers_to long, digest string, payload binary"
    return index.mapInArrow(run, schema)


def round_trip(rows: DataFrame, id_col: str, uri_col: str, payload_col: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) as the archives have them.

    The size of a revisit's payload is that of the response it refers to, found by the digest.
    """
    folder = new_folder(rows.sparkSession, "warc")
    back = read(write(rows, id_col, uri_col, payload_col, folder), folder)
    read_back = keep(
        back.select("id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"))
    )
    responses = read_back.filter((F.col("record_type") == "response") & (F.col("bytes") >= REVISIT_BYTES))
    sizes = responses.groupBy("digest").agg(F.max("bytes").alias("full"))
    revisits = read_back.filter(F.col("record_type") == "revisit").drop("bytes").join(sizes, "digest")
    plain = read_back.filter(F.col("record_type") == "response").withColumnRenamed("bytes", "full")
    return plain.unionByName(revisits).select(
        "id",
        F.col("full").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


#: The same in DuckDB SQL over ``pages``.
SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
placed AS (
  SELECT *, first_value(page_id) OVER same AS first, row_number() OVER same AS n
  FROM hashed WINDOW same AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND n > 1 THEN first END AS refers_to
FROM placed
"""

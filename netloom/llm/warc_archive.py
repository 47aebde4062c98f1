"""WARC archives (ISO 28500, version 1.1) whose records are Zstandard frames with a shared dictionary.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, as the public ``.warc.zst``
convention has it; each record after it is one frame, so any record is read alone from its offset. The dictionary
is built from a bounded sample of the records to be archived. Of equal payloads of ``REVISIT_FROM`` bytes or more
one is written out, the others refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut, scratch_path, spread_join
from netloom.llm.files import dealt, read_file, write_file

REVISIT_FROM = 1000
#: The dictionary is built from the first ``SAMPLE_BYTES`` of at most ``SAMPLE_PAGES`` records, those whose page ids hash lowest.
SAMPLE_PAGES = 2000
SAMPLE_BYTES = 4096
DICTIONARY_BYTES = 65_536
#: A file is closed once it has this many bytes of payload before compression.
FILE_BYTES = 32_000_000
BROADCAST_ROWS = 500_000
DICTIONARY_FRAME = 0x184D2A5D
_PAGES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the fixed name space for addresses


def _sha1(data: bytes) -> str:
    return hashlib.sha1(data, usedforsecurity=False).hexdigest()


def _base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def _record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_PAGES, f'record/{row}')}>"


def _line(value) -> str:
    """A header value: line ends and other control characters would end the field."""
    return re.sub(r"[\x00-\x1f\x7f]", " ", str(value))


def record(row: dict) -> bytes:
    """One record; a revisit has the headers of its response and no payload."""
    payload = (row["html"] or "").encode()
    revisit = row["refers_row"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(row['_row'])}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{_base32(row['payload_digest'])}",
        f"WARC-Block-Digest: sha1:{_base32(_sha1(block))}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_line(row['url'])}")
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(row['refers_row'])}",
        ]
        if row["refers_to"] is not None:
            head.append(f"X-Refers-To-Page-ID: {row['refers_to']}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the records in ``samples``; none without records.

    Where they are too few, too small or too unlike to train one, their own last bytes are the dictionary (raw content).
    """
    if len(samples) >= 8:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


class Writer:
    """Builds one archive in memory."""

    def __init__(self, dictionary: bytes):
        self.parts = []
        packer = {}
        if dictionary:
            self.parts.append(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
            packer["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, **packer)
        self.size = sum(map(len, self.parts))

    def add(self, data: bytes) -> int:
        """The offset of the record, for reading it alone."""
        at = self.size
        self.parts.append(self.compressor.compress(data))
        self.size += len(self.parts[-1])
        return at

    def data(self) -> bytes:
        return b"".join(self.parts)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.start = data, 0
        unpacker = {}
        if data[:4] == struct.pack("<I", DICTIONARY_FRAME):
            size = struct.unpack_from("<I", data, 4)[0]
            unpacker["dict_data"] = zstandard.ZstdCompressionDict(data[8 : 8 + size])
            self.start = 8 + size
        self.unpacker = zstandard.ZstdDecompressor(**unpacker)

    def at(self, offset: int) -> tuple[bytes, int]:
        """The record at ``offset`` and the offset of the next."""
        one = self.unpacker.decompressobj()
        out = one.decompress(memoryview(self.data)[offset:])
        return out, len(self.data) - len(one.unused_data)

    def __iter__(self) -> Iterator[bytes]:
        at = self.start
        while at < len(self.data):
            out, at = self.at(at)
            yield out


def _numbered(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), "page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return cut(rows.withColumns({
        "payload_digest": F.sha1(F.encode("html", "utf-8")),
        "_bytes": F.octet_length("html").cast("long"),
        "_key": F.sha2(F.encode("html", "utf-8"), 256),
    }))


def _with_originals(rows: DataFrame) -> DataFrame:
    """``(_row, refers_row, refers_to)``: for every row, the row it revisits, if any."""
    large = rows.where(F.col("_bytes") >= REVISIT_FROM).select("_row", "page_id", "_key")
    groups = large.groupBy("_key").agg(F.max(F.struct("page_id", "_row")).alias("_of"), F.count("*").alias("n")).where("n > 1")
    groups = cut(groups.select("_key", "n", F.col("_of.page_id").alias("refers_to"), F.col("_of._row").alias("refers_row")))
    return spread_join(large, groups, "_key", "n").where("_row <> refers_row").select("_row", "refers_row", "refers_to")


def _dictionary(rows: DataFrame, revisits: DataFrame) -> bytes:
    """The dictionary of a sample of records as they will be written."""
    chosen = rows.select("page_id", "_row").orderBy(F.xxhash64("page_id"), "_row").limit(SAMPLE_PAGES).select("_row")

    def run(batches):
        for batch in batches:
            some = batch.to_pylist()
            out = [pa.array([x["_row"] for x in some], pa.int64()), pa.array([record(x)[:SAMPLE_BYTES] for x in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["_row", "x"])

    sample = _full(rows.join(F.broadcast(chosen), "_row"), revisits).mapInArrow(run, "_row long, x binary")
    return train([bytes(r["x"]) for r in sorted(sample.collect())])  # SAMPLE_PAGES pieces at most


def _full(rows: DataFrame, revisits: DataFrame) -> DataFrame:
    return rows.select("_row", "page_id", "url", "html", "payload_digest").join(revisits, "_row", "left")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record; returns the written list of files.

    Null html is an empty payload. Of equal payloads of ``REVISIT_FROM`` bytes or more the row with the largest page_id
    (null ids last, then the later row) is the response. Rows are dealt out evenly, whatever their payloads share.
    """
    rows = _numbered(pages)
    revisits = _with_originals(rows)
    # a checked number of revisits, three numbers each, goes to the pages; more of them meet in a shuffle
    revisits = cut(revisits)
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    dictionary = _dictionary(rows, revisits)

    def run(batches):
        writer, size, count = Writer(dictionary), 0, 0

        def file() -> pa.RecordBatch:
            name = write_file(folder, ".warc.zst", writer.data())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["file", "n_records"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    data = record(row)
                    writer.add(data)
                    size, count = size + len(data), count + 1
                    if size >= FILE_BYTES:
                        yield file()
                        writer, size, count = Writer(dictionary), 0, 0
        if count:
            yield file()

    return cut(_full(rows, revisits).mapInArrow(run, "file string, n_records long"))


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of the listed archives; every payload that is there is held against its digest."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches):
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                out = []
                for data in Reader(read_file(folder, name)):
                    fields, _, payload = parse(data)
                    kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and (len(payload) != size or _sha1(payload) != digest):
                        raise ValueError(f"{name}: a payload does not match its digest")
                    out.append((number(fields.get("X-Page-ID")), size, digest, kind, number(fields.get("X-Refers-To-Page-ID"))))
                columns = list(zip(*out, strict=True))
                kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return dealt(files, files.count()).mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and return what the archives hold: ``(page_id, payload_bytes, payload_digest,
    record_type, refers_to)`` per page. An empty table writes nothing and gives no rows; other columns are not looked at."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)

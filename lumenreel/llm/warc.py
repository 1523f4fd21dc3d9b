"""WARC archives in Zstandard: a writer, and a reader that checks what it reads.

An archive file is a skippable frame that holds the dictionary (magic DICTIONARY_MAGIC), then one frame for each
record, compressed with that dictionary. The writer makes one row for each file, of bounded size, and Spark's text
sink writes it with one row a file; the sink's line end is an empty skippable frame, so the file stays valid, the
sink's commit protocol covers lost executors, and any store that Spark writes to will do. The reader takes whole
files from Spark's binary source, loads the dictionary from the leading frame, walks the frames by their headers,
and decodes one frame for each record; versions, header fields, lengths and digests are checked, and a record that
fails raises BadRecord.

The reader takes other archives of the kind too: without a dictionary, with one that is compressed itself, with records of
any type and with the standard's fields only. In a block of type application/http the payload is what follows the HTTP
header. Digests are checked where they are SHA-1 and the bytes they speak of are in the record: of the block, and of the
payload unless it has a transfer encoding.

Payloads that are equal are stored once: the record of the largest id is the response, the others are revisits that
refer to it and carry its digest and length.

Nulls: a null payload is empty; a null url is an empty field; a record with a null id is a revisit if a response with
an id has its payload, else a response. Repeated rows with the largest id are each a response. Very long payloads are
records of their own size, but Spark reads a file as one value, so neither a record nor a foreign archive may have 2 GB or
more; the writer ends its files far below that. Extra columns are ignored; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.llm.common import BATCH_BYTES, Scratch, binary_column, setting, sliced

FRAME_MAGIC, DICTIONARY_MAGIC, EMPTY_MAGIC = 0xFD2FB528, 0x184D2A5D, 0x184D2A50
#: An empty skippable frame; as text it is the sink's line end.
EMPTY_FRAME = struct.pack("<II", EMPTY_MAGIC, 0)
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.0", b"WARC/1.1")
#: Types of the standard, and those whose records must say what they refer to (fixed values).
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
#: Payload bytes after which a file ends, bytes of its dictionary, and first records that the dictionary is fitted on.
FILE_BYTES, DICTIONARY_BYTES, FIT_RECORDS = 16 << 20, 16 << 10, 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:lumenreel:page:"


class BadRecord(ValueError):
    """An archive that isn't what it says."""


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    """The bytes of a record."""
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{NAME}{'' if page_id is None else page_id}>"), ("WARC-Target-URI", quote(url or "", safe=";/?:@&=+$,-_.!~*'()#[]%")), ("WARC-Date", date)]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{NAME}{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest_text(sha1)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", block, b"", b""])


def fields_of(head: bytes) -> dict[str, str]:
    """Named fields, by name in lower case; a line that starts with a blank continues the one before."""
    fields: dict[str, str] = {}
    name = ""
    for line in head.split(b"\r\n"):
        text = line.decode("utf-8", "surrogateescape")
        if text[:1] in (" ", "\t") and name:
            fields[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.lower()
        if not colon or not name or (name in fields and name != "warc-concurrent-to"):
            raise BadRecord(f"bad header field {name!r}")
        fields[name] = value.strip()
    return fields


def number_of(fields: dict[str, str], name: str) -> int:
    if not fields[name].isdecimal():
        raise BadRecord(f"{name} isn't a number")
    return int(fields[name])


def page_number(uri: str | None) -> int | None:
    """The page id of a record id that the writer made; null for others."""
    found = (uri or "").removeprefix("<").removesuffix(">")
    rest = found.removeprefix(NAME)
    return int(rest) if rest != found and rest.removeprefix("-").isdecimal() else None


def sha1_of(fields: dict[str, str], name: str) -> str | None:
    """A field's SHA-1 in bare upper-case base 32, given in that or in hexadecimal; null for other digests."""
    kind, colon, value = fields.get(name, "").partition(":")
    if kind.lower() != "sha1" or not colon:
        return None
    try:
        return digest_text(bytes.fromhex(value)) if len(value) == 40 else value.upper()
    except ValueError:
        raise BadRecord(f"bad digest in {name}") from None


def checked(data: bytes, digest: str | None, what: str) -> str:
    own = digest_text(hashlib.sha1(data).digest())
    if digest not in (None, own):
        raise BadRecord(f"the {what}'s digest is wrong")
    return own


def parsed(data: bytes) -> dict:
    """A record's fields and payload, checked."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, head = head.partition(b"\r\n")
    if not gap or version not in VERSIONS:
        raise BadRecord("no WARC header")
    fields = fields_of(head)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadRecord(f"no field {name}")
    length, kind = number_of(fields, "content-length"), fields["warc-type"].lower()
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadRecord("the block's length isn't Content-Length")
    if kind not in TYPES:
        raise BadRecord(f"bad record type {kind!r}")
    block = payload = rest[:length]
    checked(block, sha1_of(fields, "warc-block-digest"), "block")
    whole = True
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        whole = not re.search(rb"(?im)^(transfer|content)-encoding:\s*(?!identity)\S", http)
    claimed = sha1_of(fields, "warc-payload-digest")
    if kind == "revisit":
        # the payload is elsewhere: what the record says of it is all there is
        size, digest = number_of(fields, "x-payload-length") if "x-payload-length" in fields else None, claimed
    else:
        size, digest = len(payload), checked(payload, claimed if whole else None, "payload")
        if "x-payload-length" in fields and number_of(fields, "x-payload-length") != size:
            raise BadRecord("the payload's length is wrong")
    return {
        "page_id": page_number(fields["warc-record-id"]),
        "url": unquote(fields.get("warc-target-uri", "")),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": page_number(fields.get("warc-refers-to")),
        "payload": payload,
        "record_id": fields["warc-record-id"].removeprefix("<").removesuffix(">"),
    }


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, from its header and block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    p = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if p + 3 > len(data):
            raise BadRecord("a frame is cut off")
        block = data[p] | data[p + 1] << 8 | data[p + 2] << 16
        p += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    p += 4 * (flags >> 2 & 1)
    if p > len(data):
        raise BadRecord("a frame is cut off")
    return p


def dictionary_of(raw: bytes) -> zstandard.ZstdDecompressor:
    """A decoder with the dictionary of a leading frame, which may be compressed itself."""
    try:
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    except zstandard.ZstdError as e:
        raise BadRecord(f"the dictionary can't be read: {e}") from None


def records(archive: bytes):
    """The records of an archive file."""
    data, at, decoder = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise BadRecord("a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == EMPTY_MAGIC:
            if at + 8 + size > len(data):
                raise BadRecord("a skippable frame is cut off")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise BadRecord("the dictionary isn't the leading frame")
                decoder = dictionary_of(bytes(data[8 : 8 + size]))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise BadRecord("not a frame")
        end = frame_end(data, at)
        try:
            record = decoder.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise BadRecord(f"a frame can't be decoded: {e}") from None
        yield parsed(record)
        at = end


def fitted(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for records like these; of too few records: their beginnings."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s[:8192] for s in samples], k=200, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(s[:1024] for s in samples)[-DICTIONARY_BYTES:] or VERSION)


def archive_of(found: list[bytes]) -> bytes:
    """An archive file of these records."""
    dictionary = fitted(found[:FIT_RECORDS])
    raw = dictionary.as_bytes()
    coder = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(coder.compress, found)])


def write_archives(spark: SparkSession, pages: DataFrame, path: str, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) to archive files under path. Payloads of fewer bytes than revisit_from aren't shared."""

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digested = pages.withColumn("sha1", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    shared = digested.filter(F.octet_length("html") >= revisit_from).groupBy(F.col("sha1").alias("same")).agg(F.max("page_id").alias("response"))
    # a table of its own, with a row for each payload: Spark splits a payload that very many pages have in a join of two
    # exchanges, not below an aggregate
    shared = Scratch(spark).keep(shared, "shared")
    rows = digested.join(shared.hint("shuffle_hash"), F.col("sha1") == F.col("same"), "left")
    small = F.octet_length("html") < revisit_from
    refers_to = F.when(~small & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    rows = rows.select("page_id", "url", "html", "sha1", refers_to.alias("refers_to"))

    def run(batches):
        held, size = [], 0
        for batch in sliced(batches):
            payloads = binary_column(batch, "html")
            for page_id, url, payload, sha1, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), payloads, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                held.append(record(page_id, url, payload, sha1, refers, date))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([archive_of(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive_of(held)], pa.binary())], ["archive"])

    files = rows.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        files.write.option("lineSep", EMPTY_FRAME.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


READ = {"page_id": "long", "url": "string", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long", "record_id": "string", "payload": "binary"}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, pattern: str = "part-*") -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, record_id[, payload]) of each record.

    page_id and refers_to are null where a record's id isn't one that the writer made; of a revisit without the writer's
    own field payload_bytes is null. pattern: names of the files.
    """
    names = [n for n in READ if with_payload or n != "payload"]
    schema = ", ".join(f"{n} {READ[n]}" for n in names)
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, types[READ[n]]) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    def run(batches):
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for found in records(archive.as_py()):
                    rows.append([found[n] for n in names])
                    size += len(found["payload"]) * with_payload + 200
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content")
    return files.mapInArrow(run, schema)


def archived(spark: SparkSession, pages: DataFrame, path: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write pages to archives under path (else a folder in the shared one) and read them back."""
    path = path or Scratch(spark).path("archive")
    write_archives(spark, pages, path)
    return read_archives(spark, path, with_payload)

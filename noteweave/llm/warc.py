"""Operator 6: WARC archives in Zstandard, written and read back.

An archive starts with a skippable frame that holds a dictionary; then each record is
one frame compressed with it.  Writing decides by payload which records are responses
and which revisit one; each task writes its own files below the shared folder and
reports their names, and only reported files are read, so a repeated task leaves at
most an unread file.  Reading streams a file, decodes one frame per record and checks
version line, headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, shared_dir, stored

#: Fixed values of the formats.
DICT_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICT_MAGIC = b"\x37\xa4\x30\xec"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed beyond so many compressed bytes.
ARCHIVE_BYTES = 16 << 20
#: Records from which an archive's dictionary is trained, and its size.
DICT_RECORDS, DICT_BYTES = 64, 32 << 10
#: Parts into which each group of equal payloads is split for the join.
SALTS = 64


def opened(uri: str):
    """File system and path of a URI in the shared folder."""
    if uri.startswith("s3a://"):
        uri = "s3" + uri[3:]
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(s: str) -> str:
    """Control characters, which would end a header line, percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in s)


def record(kind: str, record_id: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_urn(page_id) -> str:
    return f"urn:x-page:{'' if page_id is None else page_id}"


def page_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        headers.append(("WARC-Target-URI", header_value(url)))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{page_urn(refers_to)}>")]
    return record("revisit" if revisit else "response", page_urn(page_id), date, headers, http if revisit else http + payload)


class Archive:
    """Collects records of one archive and writes it at once."""

    def __init__(self, folder: str, date: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.waiting, self.body, self.size, self.count, self.compressor = [record("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")], [], 0, 0, None

    def add(self, data: bytes) -> None:
        self.count += 1
        self.waiting.append(data)
        if self.compressor is not None or len(self.waiting) >= DICT_RECORDS:
            self.flush()

    def flush(self) -> None:
        if self.compressor is None:
            try:
                trained = zstandard.train_dictionary(DICT_BYTES, self.waiting).as_bytes()
            except zstandard.ZstdError:  # too few or too short records to train on: their text itself is the dictionary
                trained = b"".join(self.waiting)[:DICT_BYTES]
            self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary(trained), write_checksum=True, write_content_size=True)
            self.put(struct.pack("<II", DICT_FRAME, len(trained)) + trained)
        for x in self.waiting:
            self.put(self.compressor.compress(x))
        self.waiting = []

    def put(self, frame: bytes) -> None:
        self.body.append(frame)
        self.size += len(frame)

    def close(self) -> tuple[str, int, int]:
        self.flush()
        fs, path = opened(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path, compression=None) as f:
            for x in self.body:
                f.write(x)
        return self.uri, self.count, self.size


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    if data[:4] == FRAME_MAGIC:  # the format allows a compressed dictionary
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if data[:4] == DICT_MAGIC else zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row; returns the stored list of archives (uri, records, bytes).

    Of rows with equal payloads of at least ``min_bytes``, that with the largest id is a response (each
    of them, if that id repeats) and the others, null ids among them, revisit it; payloads without any
    id are all responses.  A null payload is empty.  Further columns are ignored.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = groups.filter((F.col("n") > 1) & F.col("first_id").isNotNull()).select("key", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.join(groups, ["key", "salt"], "left").select("page_id", "url", "payload", "first_id")

    def run(batches):
        archive, done = None, []
        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "first_id"))):
                archive = archive or Archive(folder, date)
                page_id, url, payload, first = x
                archive.add(page_record(page_id, url, payload, sha1_32(payload), first, first is not None and first != page_id, date))
                if archive.size >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done) if done else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], ["uri", "records", "bytes"])

    return stored(rows.mapInArrow(run, "uri string, records long, bytes long"), folder, "manifest")


def frames(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame after the dictionary; raises ValueError where the file breaks off."""
    data, at = stream.read(8), 0
    magic, size = struct.unpack("<II", data) if len(data) == 8 else (0, 0)
    decompressor = zstandard.ZstdDecompressor()
    if magic == DICT_FRAME:
        held = stream.read(size)
        if len(held) < size:
            raise ValueError("the dictionary breaks off")
        decompressor, data, at = zstandard.ZstdDecompressor(dict_data=dictionary(held)), b"", 8 + size
    while data or (data := stream.read(chunk)):
        while len(data) < 8 and (more := stream.read(chunk)):
            data += more
        if len(data) >= 8 and int.from_bytes(data[:4], "little") in SKIPPABLE:
            size = 8 + int.from_bytes(data[4:8], "little")
            while len(data) < size and (more := stream.read(chunk)):
                data += more
            data, at = data[size:], at + size
            continue
        frame, out, used = decompressor.decompressobj(), [], 0
        while True:
            try:
                out.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ValueError(f"bad frame at {at}: {e}") from None
            used += len(data)
            if frame.eof:
                break
            if not (data := stream.read(chunk)):
                raise ValueError(f"the frame at {at} breaks off")
        data = frame.unused_data
        used -= len(data)
        yield at, b"".join(out)
        at += used


def parsed(data: bytes) -> dict:
    """Headers, block and payload of a record; ``problem`` names what is invalid, if anything."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    out = {"problem": None, "headers": {}, "payload": None, "payload_bytes": None}
    if lines[0] not in (b"WARC/1.1", b"WARC/1.0") or not gap:
        return out | {"problem": "no version line or end of headers"}
    for x in lines[1:]:
        k, colon, v = x.partition(b":")
        if not colon:
            return out | {"problem": "a header line has no colon"}
        out["headers"][k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    h = out["headers"]
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in h]:
        return out | {"problem": f"no {missing[0]}"}
    if not h["content-length"].isdecimal() or int(h["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": "the block is not as long as content-length says"}
    block = rest[:-4]
    if h["warc-type"] not in ("response", "revisit"):
        return out
    http, gap, body = block.partition(b"\r\n\r\n")
    length = [v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
    if not gap or len(length) != 1 or not length[0].isdigit():
        return out | {"problem": "no length in the HTTP headers"}
    out["payload_bytes"] = int(length[0])
    if h["warc-type"] == "response":
        if len(body) != out["payload_bytes"]:
            return out | {"problem": "the payload is not as long as the HTTP headers say"}
        if h.get("warc-payload-digest") != f"sha1:{sha1_32(body)}":
            return out | {"problem": "the payload does not have the digest that the headers give"}
        out["payload"] = body
    elif "warc-refers-to" not in h or body:
        return out | {"problem": "a revisit without a target, or with a payload"}
    return out


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the files in column ``uri``: uri, offset, record_type, record_id, target_uri,
    refers_to, payload_digest, payload_bytes, payload and problem.

    An invalid record keeps its row and says why in ``problem``; a file that breaks off gives a last row
    with a null type and the reason.  A revisit's payload is null and its length is that of its target.
    """
    ship(spark)
    kinds = [("uri", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())]

    def row(uri, at, x):
        h = x["headers"]
        return uri, at, h.get("warc-type"), h.get("warc-record-id", "")[1:-1] or None, h.get("warc-target-uri"), h.get("warc-refers-to", "")[1:-1] or None, h.get("warc-payload-digest"), x["payload_bytes"], x["payload"] if with_payload else None, x["problem"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for uri in b.column("uri").to_pylist():
                fs, path = opened(uri)
                with fs.open_input_stream(path, compression=None) as f:
                    try:
                        for at, data in frames(f):
                            rows.append(row(uri, at, parsed(data)))
                            size += len(data) if with_payload else 200
                            if size > 8 << 20:
                                yield batch(rows)
                                rows, size = [], 0
                    except ValueError as e:
                        rows.append((uri, *[None] * 8, str(e)))
        if rows:
            yield batch(rows)

    schema = "uri string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, problem string"
    files = archives.select("uri")
    return files.repartition(max(1, min(files.count(), 4 * spark.sparkContext.defaultParallelism)), "uri").mapInArrow(run, schema)


def page_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read them back; (page_id, payload_bytes, payload_digest, record_type, refers_to, problem)."""
    spark = pages.sparkSession
    archives = write_archives(pages, shared_dir(spark), min_bytes=min_bytes)
    page = lambda c: F.regexp_extract(c, "^urn:x-page:(-?[0-9]+)$", 1).try_cast("long")
    got = read_archives(spark, archives, with_payload=False).filter("record_type is null or record_type in ('response', 'revisit')")
    return got.select(page("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), "problem")

"""WARC archives compressed with Zstandard: one frame per record behind a dictionary in a skippable frame.

Layout of a file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or itself compressed, then one
zstd frame for each record. Tasks write whole files under names of their own; only files named in the returned
manifest count, so what a lost or repeated task attempt leaves behind is never read. Readers stream a file: they
hold one record and a few chunks at a time.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import materialize, shared_dir

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: A file takes no further record once its payloads reach this.
FILE_BYTES = 64 << 20
#: The dictionary is made from a file's first records, up to so many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 16 << 10
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records bigint, n_bytes bigint"
RECORDS = (
    "path string, offset bigint, record_id string, record_type string, target_uri string, date string, refers_to_id string, "
    "payload_bytes bigint, payload_digest string, payload binary, problem string"
)


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value in one line."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def _name(page_id) -> str:
    """An id as a URN; percent signs stand for all but letters, digits and ``_.-~``, so that any id can be read back."""
    return "urn:page:" + quote(str(page_id), safe="", errors="surrogatepass")


def make_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response record, or, if ``refers_to`` isn't None, a revisit record without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = _name(page_id) if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_name(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on ``samples``; of too few for that, their first bytes as they are; none of nothing."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=64, d=8)
    except (zstandard.ZstdError, ValueError, MemoryError):
        raw = b"".join(samples)[:DICTIONARY_BYTES]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def write_file(path: str, records: Iterator[bytes]) -> tuple[int, int]:
    """Writes one archive under a passing name, then gives it its own. Returns the numbers of records and bytes."""
    samples, size = [], 0
    for record in records:
        samples.append(record)
        size += len(record)
        if size >= SAMPLE_BYTES:
            break
    made = make_dictionary(samples)
    packer = zstandard.ZstdCompressor(level=3, dict_data=made, write_content_size=True, write_checksum=True)
    store, place = open_store(path)
    store.create_dir(posixpath.dirname(place), recursive=True)
    n = total = 0
    with store.open_output_stream(place + ".part", compression=None) as out:
        if made is not None:
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(made.as_bytes())) + made.as_bytes())
        for source in (samples, records):
            for record in source:
                frame = packer.compress(record)
                out.write(frame)
                n, total = n + 1, total + len(frame)
    store.move(place + ".part", place)
    return n, total


def frame_length(data: memoryview) -> int | None:
    """Bytes of the zstd frame at the start of ``data``, from its header and block lengths; None if it goes beyond."""
    if len(data) < 18:
        head = None
    else:
        head = zstandard.frame_header_size(bytes(data[:18]))
    if head is None:
        try:
            head = zstandard.frame_header_size(bytes(data))
        except zstandard.ZstdError:
            return None
    at, checksum = head, bool(data[4] & 4)
    while True:
        if at + 3 > len(data):
            return None
        block = int.from_bytes(data[at : at + 3], "little")
        kind, size = (block >> 1) & 3, block >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
        if block & 1:
            at += 4 * checksum
            return at if at <= len(data) else None


def read_frames(path: str) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, problem) of each frame after the dictionary. A damaged frame ends the file."""
    store, place = open_store(path)
    with store.open_input_stream(place, compression=None) as source:
        buffer, base, at, unpacker = bytearray(), 0, 0, zstandard.ZstdDecompressor()

        def more() -> bool:
            nonlocal base, at, buffer
            chunk = source.read(CHUNK)
            del buffer[:at]  # moves nothing
            buffer += chunk
            base, at = base + at, 0
            return bool(chunk)

        while len(buffer) < 8 and more():
            pass
        if len(buffer) >= 8 and struct.unpack_from("<I", buffer)[0] == DICTIONARY_MAGIC:
            size = struct.unpack_from("<I", buffer, 4)[0]
            while len(buffer) < 8 + size:
                if not more():
                    yield 0, None, "dictionary frame is cut off"
                    return
            raw = bytes(buffer[8 : 8 + size])
            try:
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            except (zstandard.ZstdError, ValueError) as problem:
                yield 0, None, f"bad dictionary: {problem}"
                return
            at = 8 + size
        while True:
            while len(buffer) - at < 8 and more():
                pass
            if len(buffer) == at:
                return
            try:
                if struct.unpack_from("<I", bytes(buffer[at : at + 4]).ljust(4, b"\0"))[0] != FRAME_MAGIC:
                    raise ValueError("not a zstd frame")
                while (size := frame_length(memoryview(buffer)[at:])) is None:
                    if not more():
                        raise ValueError("frame is cut off")
                frame = bytes(buffer[at : at + size])
                record = unpacker.decompress(frame)
                stated = zstandard.get_frame_parameters(frame).content_size
                if stated != zstandard.CONTENTSIZE_UNKNOWN and stated != len(record):
                    raise ValueError("frame length differs from its header")
            except (zstandard.ZstdError, ValueError) as problem:
                yield base + at, None, str(problem)
                return
            yield base + at, record, None
            at += size


def parse_record(record: bytes) -> dict:
    """Fields of a record; ``problem`` says what is wrong with it, None if nothing is."""
    out = dict.fromkeys(("record_id", "record_type", "target_uri", "date", "refers_to_id", "payload_bytes", "payload_digest", "payload", "problem"))
    try:
        head, gap, rest = record.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
            raise ValueError("no WARC header")
        fields = {}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if not colon or not name or name != name.strip():
                raise ValueError("bad header line")
            fields[name.lower()] = value.strip()
        if missing := [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in fields]:
            raise ValueError("missing header " + ", ".join(missing))
        out |= {
            "record_id": fields["warc-record-id"].removeprefix("<").removesuffix(">"), "record_type": fields["warc-type"], "date": fields["warc-date"], "target_uri": fields.get("warc-target-uri"),
            "refers_to_id": fields.get("warc-refers-to", "").removeprefix("<").removesuffix(">") or None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        }
        if not re.fullmatch("[0-9]+", fields["content-length"]) or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
            raise ValueError("block length differs from Content-Length")
        block = rest[:-4]
        if (stated := fields.get("warc-block-digest")) and stated != "sha1:" + sha1_base32(block):
            raise ValueError("block digest differs")
        http, gap, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*([0-9]+)\s*$", http)
        if out["record_type"] in ("response", "revisit") and (not gap or not http.startswith(b"HTTP/") or not length):
            raise ValueError("bad HTTP header")
        out["payload_bytes"] = int(length[1]) if length else len(payload)
        if out["record_type"] == "response":
            if len(payload) != out["payload_bytes"]:
                raise ValueError("payload length differs from its header")
            if out["payload_digest"] not in (None, sha1_base32(payload)):
                raise ValueError("payload digest differs")
            out["payload"] = payload
    except (ValueError, UnicodeError) as problem:
        out["problem"] = str(problem)
    return out


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to files under ``folder``; gives the manifest.

    The payload is the html in UTF-8, empty if null. Of the records with equal payloads of at least ``least_bytes``
    bytes, those with the largest page_id are responses and the others revisit it; smaller payloads are all responses.
    A null page_id is a revisit where a record with an id has the payload, else a response; it comes back as null.
    Repeated rows each have a record. An empty table gives an empty manifest. Other columns aren't read.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    groups = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n"))
    copies = materialize(groups.where("n > 1 and kept is not null").select("digest", "kept"), "copies")
    marked = rows.join(copies, "digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html",
        F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("kept")), F.col("kept")).cast("string").alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get(), 0

        def rows() -> Iterator[dict]:
            for batch in batches:
                for start in range(0, batch.num_rows, 100):
                    yield from batch.slice(start, 100).to_pylist()

        source = rows()
        row = next(source, None)
        while row is not None:

            def one_file() -> Iterator[bytes]:
                nonlocal row
                size = 0
                while row is not None and size < FILE_BYTES:
                    payload = row["html"].encode("utf-8", "surrogatepass")
                    size += len(payload)
                    made = make_record(row["page_id"], row["url"], payload, row["refers_to"])
                    row = next(source, None)
                    yield made

            path = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            n, size = write_file(path, one_file())
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    return materialize(marked.mapInArrow(write, MANIFEST), "manifest")


def read_archives(files: DataFrame) -> DataFrame:
    """The records of the files in column ``path``, as RECORDS says. ``problem`` is null for a valid record.

    A record that fails a check keeps its row, with what was read of it and the problem; a frame that can't be decoded
    ends its file with such a row. A revisit's payload is null, its payload_bytes and payload_digest are of the full
    payload.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORDS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for offset, record, problem in read_frames(path):
                    row = parse_record(record) if record is not None else {"problem": problem}
                    held.append({"path": path, "offset": offset} | row)
                    size += len(record or b"")
                    if size >= 4 << 20 or len(held) >= 2000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    n = max(1, files.count())
    assert names == schema.names
    return files.select("path").repartition(n, "path").mapInArrow(read, RECORDS)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Column ``path`` of the .warc.zst files below a folder; their contents aren't read here."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.warc.zst").load(folder).select("path")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back; rows as RECORDS says, and page_id, refers_to. Ids come back as they were, whatever is in them."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    id_type = pages.schema["page_id"].dataType
    named = lambda c: F.when(F.col(c).startswith("urn:page:"), F.try_url_decode(F.substring(c, 10, 1 << 30))).cast(id_type)
    back = read_archives(write_archives(pages, folder, least_bytes))
    return back.withColumn("page_id", named("record_id")).withColumn("refers_to", named("refers_to_id"))

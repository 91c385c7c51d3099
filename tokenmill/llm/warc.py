"""Zstandard WARC archives: pages are written as records, one frame each, and archives are read back with all checks.

An archive begins with a skippable frame (magic number 0x184D2A5D) that holds the dictionary its records are compressed with, itself
plain or compressed. Every record is a frame of its own, so a reader can begin at any frame and holds one record at a time.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import bounded_batches, saved
from tokenmill.session import ensure_checkpoint_dir

#: Fixed values of the format: magic numbers of the dictionary's frame and of a Zstandard frame, and of other skippable frames.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-record-id", "content-length", "warc-date", "warc-type")

#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 100
#: Compressed size at which a task begins its next archive; size of a dictionary, records and bytes of each that it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINED_ON, SAMPLE_BYTES = 256 << 20, 16 << 10, 200, 8 << 10
#: Bytes read at a time.
CHUNK = 64 << 10
DATE = "1970-01-01T00:00:00Z"
_IDS = uuid.UUID("6f1b1d9e-6f0c-5c3e-9a53-4c1f6f9d8a11")

RECORDS = "path string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, problem string"
_RECORDS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                      ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])
_ARCHIVES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def opened(path: str) -> tuple[FileSystem, str]:
    """File system and path in it of a path or URI."""
    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, str(page_id))}>"


def header_value(text: str) -> str:
    """``text`` with spaces, control characters and line separators percent-encoded."""
    return re.sub("[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE,
            "WARC-Target-URI": None if url is None else header_value(url), "X-Page-ID": page_id, "WARC-Payload-Digest": f"sha256:{digest}",
            "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": refers_to}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def fields(lines: list[bytes]) -> dict[str, str]:
    """Header lines by lower-case name; the first of a repeated name counts."""
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"header line {line[:80]!r}")
        out.setdefault(name.decode().lower(), value.strip(b" \t").decode())
    return out


def number(head: dict[str, str], name: str, needed: bool = True) -> int | None:
    value = head.get(name)
    if value is None and not needed:
        return None
    if value is None or not re.fullmatch(r"-?[0-9]{1,18}", value):
        raise ValueError(f"{name} is {value!r}")
    return int(value)


def parsed(raw: bytes) -> dict:
    """The columns of a record; ValueError says which rule it breaks."""
    head_bytes, end, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head_bytes.split(b"\r\n")
    if version not in VERSIONS:
        raise ValueError(f"version {version[:40]!r}")
    if not end:
        raise ValueError("the header has no end")
    head = fields(lines)
    for name in REQUIRED:
        if name not in head:
            raise ValueError(f"no {name}")
    length = number(head, "content-length")
    if len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"content-length is {length}, the block has {len(rest) - 4} bytes and its end")
    block = rest[:-4]
    checked = lambda name, data: head.get(name, "").startswith("sha256:") and head[name][7:] != hashlib.sha256(data).hexdigest()
    if checked("warc-block-digest", block):
        raise ValueError("the block differs from its digest")
    out = {"record_type": head["warc-type"], "url": head.get("warc-target-uri"), "page_id": number(head, "x-page-id", False), "payload": None,
           "payload_bytes": None, "payload_digest": None, "refers_to": None}
    if out["record_type"] not in ("response", "revisit"):
        return out
    http, end, payload = block.partition(b"\r\n\r\n")
    if not http.startswith(b"HTTP/") or not end:
        raise ValueError("the block has no HTTP header")
    out["payload_bytes"] = number(fields(http.split(b"\r\n")[1:]), "content-length")
    if out["record_type"] == "revisit":
        if payload or not head.get("warc-payload-digest", "").startswith("sha256:") or "warc-refers-to" not in head:
            raise ValueError("a revisit needs a payload digest and what it refers to, and has no payload")
        return out | {"payload_digest": head["warc-payload-digest"][7:], "refers_to": number(head, "x-refers-to-page-id", False)}
    if len(payload) != out["payload_bytes"]:
        raise ValueError(f"the HTTP content-length is {out['payload_bytes']}, the payload has {len(payload)} bytes")
    if checked("warc-payload-digest", payload):
        raise ValueError("the payload differs from its digest")
    return out | {"payload": payload, "payload_digest": hashlib.sha256(payload).hexdigest()}


@dataclass
class Archive:
    """Writes one archive. The first records are held back until there are enough to train the dictionary on."""

    path: str
    records: int = 0
    size: int = 0
    waiting: list[bytes] = field(default_factory=list)
    stream: pa.NativeFile | None = None

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.stream is None:
            self.waiting.append(raw)
            if len(self.waiting) >= TRAINED_ON or sum(map(len, self.waiting)) > 4 << 20:
                self.begin()
        else:
            self.put(self.compressor.compress(raw))

    def begin(self) -> None:
        fs, path = opened(self.path)
        self.stream, samples = fs.open_output_stream(path, compression=None), [r[:SAMPLE_BYTES] for r in self.waiting]
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
        except zstandard.ZstdError:  # too few records, or too much alike: their beginning serves as it is
            trained = zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        data = zstandard.ZstdCompressor(level=19, write_checksum=True).compress(trained.as_bytes())
        self.put(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        for raw in self.waiting:
            self.put(self.compressor.compress(raw))
        self.waiting = []

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> dict:
        if self.stream is None:
            self.begin()
        self.stream.close()
        return {"path": [self.path], "records": [self.records], "bytes": [self.size]}


def frames(stream: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every frame of an archive; ValueError where it can't be read on.

    Compressed bytes are read in chunks, and one frame's content is held at a time.
    """
    at, held, ended = 0, b"", False

    def fill(n: int) -> bool:
        nonlocal held, ended
        parts, have = [held], len(held)
        while have < n and not ended:
            parts.append(stream.read(max(CHUNK, n - have)))
            ended = not parts[-1]
            have += len(parts[-1])
        held = b"".join(parts)
        return have >= n

    decompressor = zstandard.ZstdDecompressor()
    while fill(4) or held:
        magic = struct.unpack("<I", held[:4])[0] if len(held) >= 4 else None
        if magic in SKIPPABLE:
            size = struct.unpack("<I", held[4:8])[0] if fill(8) else 0
            if len(held) < 8 or not fill(8 + size):
                raise ValueError("the skippable frame is cut off")
            if at == 0 and magic == DICTIONARY_MAGIC:
                data = held[8:8 + size]
                if data[:4] == struct.pack("<I", FRAME_MAGIC):
                    data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
            at, held = at + 8 + size, held[8 + size:]
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame begins with {held[:4]!r}")
        frame, parts, taken = decompressor.decompressobj(), [], 0
        try:
            while not frame.eof:
                if not fill(1):
                    raise ValueError("the frame is cut off")
                parts.append(frame.decompress(held))
                taken += len(held) - len(frame.unused_data)
                held = frame.unused_data
        except zstandard.ZstdError as e:
            raise ValueError(f"the frame can't be decoded: {e}") from e
        yield at, b"".join(parts)
        at += taken


def read_archive(path: str, with_payload: bool) -> Iterator[dict]:
    """A row for each record; a record that breaks a rule has ``problem`` set, and so has the end of an archive that can't be read on."""
    fs, inner = opened(path)
    none = dict.fromkeys(_RECORDS.names) | {"path": path}
    at = 0
    with fs.open_input_stream(inner, compression=None) as stream:
        try:
            for at, raw in frames(stream):
                try:
                    row = none | parsed(raw) | {"offset": at}
                except ValueError as e:
                    row = none | {"offset": at, "problem": str(e)}
                yield row if with_payload else row | {"payload": None}
        except ValueError as e:
            yield none | {"offset": at, "problem": f"after this record: {e}"}


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives whose paths are in column ``path``: the columns of RECORDS.

    Every frame is decoded by itself with the archive's dictionary and checked: version, header lines, required headers, lengths, the
    blank lines at the end, digests, HTTP header and its length. A record that breaks a rule is a row with ``problem`` set and is skipped; if
    a frame can't be decoded, the rest of its archive can't be found, which is one such row too. An empty file has no records. Records of other
    types have no page columns. No archives give no rows. Archives are streamed; a task holds one record.
    """
    bounded_batches(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows, size = [], 0
                for row in read_archive(path, with_payload):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 500 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)

    return archives.select("path").mapInArrow(run, RECORDS)


def with_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to) of every row of ``pages`` (page_id, url, html).

    Among payloads of ``least_bytes`` or more that are equal, that of the least page_id is the response and the others revisit it.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("lead"), F.count("*").alias("n"))
    # stored, so that the join deals out both sides anew and may split the rows of a frequent payload
    leads = saved(groups.where((F.col("n") > 1) & F.col("lead").isNotNull()).select("payload_digest", "lead"))
    refers = F.when(F.col("page_id").eqNullSafe(F.col("lead")), None).otherwise(F.col("lead"))
    return rows.join(leads, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"), refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for every row of ``pages`` (page_id, url, html) and returns (path, records, bytes) of the archives.

    A null html is an empty payload, a null url or page_id has no header. Rows with the same page_id are records of their own with the same
    record id; if their payload is equal and theirs is the least id, all of them are responses. Equal payloads whose ids are all
    null are responses. Control characters and spaces of a url are percent-encoded. An empty table gives no archives. Other columns are ignored.

    ``folder`` is a path or URI that all executors reach. Every task writes archives under new names, and only those of tasks that
    succeeded are returned, so what a lost executor leaves behind is never read.
    """
    bounded_batches(pages.sparkSession)
    fs, inner = opened(folder)
    fs.create_dir(inner, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for row in batch.to_pylist():
                archive = archive or Archive(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                archive.add(record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["refers_to"], row["record_type"] == "revisit"))
                if archive.size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict(archive.close(), schema=_ARCHIVES)
                    archive = None
        if archive:
            yield pa.RecordBatch.from_pydict(archive.close(), schema=_ARCHIVES)

    return saved(with_types(pages, least_bytes).mapInArrow(run, "path string, records long, bytes long"))


def new_folder(pages: DataFrame) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"

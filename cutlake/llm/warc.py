"""WARC archives: write, normalise a monolithic gzip file, read back by offset."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.llm import store
from cutlake.llm.groups import attach

CHUNK = 1 << 20
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
LEAST_REVISIT = 1000
VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "archive string, offset long, length long, record_id string, record_type string"
RECORD = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary, archive string, offset long, length long"


def _line(name: str, value) -> bytes:
    """One header line; control characters of the value are percent-encoded."""
    text = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))
    return f"{name}: {text}\r\n".encode()


def record(record_id, kind: str, uri, payload: bytes, digest: str, refers_to) -> bytes:
    """A whole record. A revisit keeps the digest and length of the payload it leaves out."""
    block = HTTP + (payload if kind == "response" else b"")
    head = [VERSION + b"\r\n", _line("WARC-Type", kind)]
    head += [_line(n, v) for n, v in (("WARC-Record-ID", record_id), ("WARC-Target-URI", uri), ("WARC-Refers-To", refers_to)) if v is not None]
    head += [_line("WARC-Payload-Digest", f"sha1:{digest}"), _line("X-Payload-Length", len(payload)), _line("Content-Length", len(block))]
    return b"".join(head) + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    named = (x.decode("utf-8", "replace").partition(":") for x in lines[1:])
    headers = {n.strip().lower(): v.strip() for n, _, v in named}
    return headers, rest[: int(headers["content-length"])]


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, piece by piece."""
    gz = None
    for chunk in chunks:
        while chunk:
            if gz is None:
                gz = zlib.decompressobj(31)
            if out := gz.decompress(chunk):
                yield out
            chunk, gz = (gz.unused_data, None) if gz.eof else (b"", gz)
    if gz is not None:
        raise ValueError("the gzip stream ends early")


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream that is read once; at most a record and a chunk are held."""
    held, need, at_head = bytearray(), 0, True
    for piece in stream:
        held += piece
        while True:
            if at_head:
                while held[:2] == b"\r\n":
                    del held[:2]
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", held[: end + 2])
                if not held.startswith(b"WARC/") or not length:
                    raise ValueError("no WARC record header")
                need, at_head = end + 4 + int(length[1]) + 4, False
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            at_head = True
    if held.strip(b"\r\n"):
        raise ValueError("the last record is cut off")


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


class _Output:
    """A file that appears under its name only when it is whole."""

    def __init__(self, path: str):
        self.system, self.path = _open(path)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.file, self.at = self.system.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def done(self) -> None:
        self.file.close()
        self.system.move(self.part, self.path)


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``rows`` (``record_id, record_type, target_uri, payload, payload_digest, refers_to``)
    as monolithic archives, one gzip stream per file; returns ``archive, records``.

    Each task writes its own files and starts another after ``archive_bytes`` of
    records. A task that runs again writes the same names.
    """

    def write(batches):
        part, count, out, gz, n, size = TaskContext.get().partitionId(), 0, None, None, 0, 0
        made = []

        def close():
            out.write(gz.flush())
            out.done()
            made.append((name, n))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{folder}/part-{part:06d}-{count:04d}.warc.gz"
                    out, gz, n, size, count = _Output(name), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0, count + 1
                data = record(row["record_id"], row["record_type"], row["target_uri"], row["payload"] or b"", row["payload_digest"], row["refers_to"])
                out.write(gz.compress(data))
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["archive", "records"])

    columns = ["record_id", "record_type", "target_uri", "payload", "payload_digest", "refers_to"]
    return store.keep(rows.select(*columns).mapInArrow(write, "archive string, records long"), "archives")


def _chunks(path: str) -> Iterator[bytes]:
    system, inner = _open(path)
    with system.open_input_stream(inner, compression=None) as file:
        while data := file.read(CHUNK):
            yield data


def _each(paths: DataFrame) -> DataFrame:
    """One archive a task; the list has one row per file."""
    return paths.select("archive").repartition(max(1, paths.count()))


def normalise_archives(paths: DataFrame, folder: str) -> DataFrame:
    """Inflate each monolithic archive once and rewrite every record as a gzip member of its own.

    Beside ``x.warc.gz`` in ``folder`` goes the sidecar index ``x.warc.gz.idx``, a
    line of JSON per record; returns ``archive, records`` of the new files.
    Concatenated members are accepted as input; a damaged stream is an error.
    """

    def rewrite(batches):
        for batch in batches:
            made = []
            for path in batch.column(0).to_pylist():
                name = f"{folder}/{path.rpartition('/')[2]}"
                out, index, n = _Output(name), _Output(f"{name}.idx"), 0
                for data in records(inflated(_chunks(path))):
                    member, headers = zlib.compress(data, LEVEL, 31), parse(data)[0]
                    row = {"offset": out.at, "length": len(member), "record_id": headers.get("warc-record-id"), "record_type": headers.get("warc-type")}
                    index.write(json.dumps(row).encode() + b"\n")
                    out.write(member)
                    n += 1
                out.done()
                index.done()
                made.append((name, n))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["archive", "records"])

    return store.keep(_each(paths).mapInArrow(rewrite, "archive string, records long"), "members")


def _index(path: str) -> list[dict]:
    return [json.loads(x) for x in b"".join(_chunks(f"{path}.idx")).splitlines()]


def read_index(archives: DataFrame) -> DataFrame:
    """The sidecar indexes as rows ``archive, offset, length, record_id, record_type``."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = [{"archive": path, **x} for x in _index(path)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]))

    return _each(archives).mapInArrow(read, INDEX)


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Read normalised archives record by record at the offsets of their index.

    Digest and length come from the stored payload of a response, which must
    agree with its header, and from the headers of a revisit. ``payloads=False``
    leaves the payload out of the result.
    """
    import hashlib

    names = ["record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload", "archive", "offset", "length"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, inner = _open(path)
                rows, held = [], 0
                with system.open_input_file(inner) as file:
                    for at in _index(path):
                        file.seek(at["offset"])
                        headers, block = parse(zlib.decompress(file.read(at["length"]), 31))
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload digest differs in {path} at {at['offset']}")
                        rows.append((headers.get("warc-record-id"), headers["warc-type"], headers.get("warc-target-uri"), digest, int(headers["x-payload-length"]), headers.get("warc-refers-to"), payload if payloads else None, path, at["offset"], at["length"]))
                        held += len(payload) if payloads else 200
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    return _each(archives).mapInArrow(read, RECORD)


def page_records(pages: DataFrame, id: str = "page_id", uri: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """A record per page. Of equal payloads of at least ``least`` bytes the page with the
    largest id is the response and the others revisit it; rows that repeat that id too
    are responses as well. A null page is an empty payload, a null id or address leaves
    its header out; other columns are ignored."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id).cast("string").alias("record_id"), F.col(id).alias("_id"), F.col(uri).cast("string").alias("target_uri"), payload.alias("payload"))
    large = F.octet_length("payload") >= least
    rows = rows.withColumn("_same", F.when(large, F.sha2("payload", 256)))
    groups = store.keep(rows.where(large).groupBy("_same").agg(F.max("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1"), "payload_groups")
    found = attach(rows, groups, "_same", "_n", "_id")
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    return found.select(
        "record_id", F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload",
        F.sha1("payload").alias("payload_digest"), F.when(again, F.col("_first").cast("string")).alias("refers_to"),
    )


def archive_pages(pages: DataFrame, **names) -> DataFrame:
    """Pages through archives and back: write, normalise, read by offset. Returns the records."""
    spark = pages.sparkSession
    whole = write_archives(page_records(pages, **names), store.new_folder(spark, "monolithic"))
    members = normalise_archives(whole, store.new_folder(spark, "warc"))
    return read_records(members, payloads=False)

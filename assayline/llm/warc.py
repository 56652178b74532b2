"""WARC records in ZIP packages: writing, and range reads without extraction.

``write`` puts a response record per page, or a revisit record where another page has the
same payload, into packages: ZIP files with a member ``archive/data.warc.gz`` (one gzip
member per record) and a member ``indexes/index.cdxj`` with offset and length of each
record, both stored, not deflated. Each task writes its own packages of bounded size.

``read`` parses the central directory of each package (ZIP64 too), finds the stored members,
reads the index, cuts it into runs of neighbouring records, deals the runs out, and reads
each run with one range read. Nothing is extracted or read whole.

Files go through ``pyarrow.fs`` to the folder all executors share, under a name that is new
for every attempt of a task; only packages that the finished tasks report are read, so a
repeated task does no harm.

Of records with equal payloads the one with the largest ``page_id`` is the response; a null id
is never it unless all are null. Rows that repeat id and payload are alike. Null payloads are
empty. Line breaks in a URL are removed in the header.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import math
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.shared import cut
from assayline.session import shared_folder

DATA = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
PACKAGE_BYTES = 64 << 20
RUN_BYTES = 1 << 20
TASK_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f2f6e9c-0a51-4d0b-8f3e-000000000000").int
_NULL = _SPACE + (1 << 64)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder or file named by a URI."""
    path = path.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record_id(page_id: int | None) -> str:
    """The record id of a page: a UUID that holds its id."""
    value = _NULL if page_id is None else _SPACE + (page_id % (1 << 64))
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(name: str) -> int | None:
    """The page id in a record id."""
    value = uuid.UUID(name.strip("<>").rpartition(":")[2]).int
    if value == _NULL:
        return None
    value -= _SPACE
    return value - (1 << 64) if value >= 1 << 63 else value


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, target: tuple | None) -> bytes:
    """One WARC record; ``target`` is (page_id, url) of the response that it revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if target else payload)
    fields = [
        ("WARC-Type", "revisit" if target else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    if target:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(target[0])),
            ("WARC-Refers-To-Target-URI", _line(target[1])),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _line(value: str | None) -> str:
    return " ".join((value or "").split())


def parse(raw: bytes) -> dict:
    """Headers and payload of one WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return {"fields": fields, "payload": payload, "payload_bytes": int(length)}


class Package:
    """Writes one package record by record; only the index and the open file are held."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.stream = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, page_id: int | None, url: str | None, payload: bytes, target: tuple | None) -> None:
        packed = gzip.compress(record(page_id, url, payload, target), 3, mtime=0)
        self.member.write(packed)
        self.index.append(f"{_line(url)} {json.dumps({'offset': self.size, 'length': len(packed)})}")
        self.size += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.stream.close()


def members(source) -> dict[str, tuple[int, int]]:
    """Offset and length of the data of each stored member, from the central directory.

    ``source`` has ``size()``, ``seek`` and ``read``. Only the end of the file, the directory
    and one local header per member are read.
    """

    def at(offset: int, length: int) -> bytes:
        source.seek(offset)
        return source.read(length)

    size = source.size()
    tail_at = max(0, size - 65557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("not a ZIP file")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = at(tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("the ZIP64 locator is missing")
        where = struct.unpack("<Q", locator[8:16])[0]
        wide = at(where, 56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("the ZIP64 end of the directory is missing")
        count, length, start = struct.unpack("<QQQ", wide[32:56])
    directory, out, place = at(start, length), {}, 0
    for _ in range(count):
        if directory[place : place + 4] != b"PK\1\2":
            raise ValueError("the directory is damaged")
        method = struct.unpack("<H", directory[place + 10 : place + 12])[0]
        packed, plain, name_size, extra_size, note_size = struct.unpack("<IIHHH", directory[place + 20 : place + 34])
        local = struct.unpack("<I", directory[place + 42 : place + 46])[0]
        name = directory[place + 46 : place + 46 + name_size].decode()
        extra = directory[place + 46 + name_size : place + 46 + name_size + extra_size]
        while len(extra) >= 4:
            kind, long = struct.unpack("<HH", extra[:4])
            if kind == 1:  # the wide values stand in this order, those that are needed only
                wide = list(struct.unpack(f"<{long // 8}Q", extra[4 : 4 + long // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + long :]
        place += 46 + name_size + extra_size + note_size
        if method == 0:
            head = at(local, 30)
            out[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), packed)
    return out


def write(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write packages under ``folder``; returns ``path, records`` of each."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(
        F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("same")
    )
    named = keyed.groupBy("same").agg(
        F.max("page_id").alias("to_id"), F.max_by("url", F.struct("page_id", "url")).alias("to_url")
    )
    rows = keyed.join(named, "same").select(
        "page_id", "url", "payload", "to_id", "to_url", F.col("page_id").eqNullSafe(F.col("to_id")).alias("own")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        package, path = None, ""

        def done() -> pa.RecordBatch:
            package.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([len(package.index)], pa.int64())], ["path", "records"]
            )

        for batch in batches:
            for x in zip(*batch.columns, strict=True):
                page_id, url, body, to_id, to_url, own = (v.as_py() for v in x)
                if package is None:
                    path = f"{folder}/{uuid.uuid4().hex}.wacz"
                    package = Package(store, f"{base}/{path.rpartition('/')[2]}")
                package.add(page_id, url, body, None if own else (to_id, to_url))
                if package.size >= package_bytes:
                    yield done()
                    package = None
        if package is not None:
            yield done()

    return rows.mapInArrow(run, "path string, records long")


def read(packages: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of every record."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inner = open_store(path)
                with store.open_input_file(inner) as source:
                    places = members(source)
                    base = places[DATA][0]
                    source.seek(places[INDEX][0])
                    lines = io.StringIO(source.read(places[INDEX][1]).decode())
                out: list[list[int]] = []
                for line in lines:
                    place = json.loads(line[line.index(" {") :])
                    if not out or out[-1][1] >= run_bytes:
                        out.append([base + place["offset"], 0, 0])
                    out[-1][1] += place["length"]
                    out[-1][2] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(out)), *(pa.array([r[i] for r in out], pa.int64()) for i in range(3))],
                    ["path", "start", "length", "records"],
                )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                store, inner = open_store(run["path"])
                with store.open_input_file(inner) as source:
                    source.seek(run["start"])
                    raw = io.BytesIO(source.read(run["length"]))
                found = []
                for text in _each(raw):
                    x = parse(text)
                    fields = x["fields"]
                    whole = fields["WARC-Type"] == "response"
                    if whole and digest(x["payload"]) != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"damaged payload in {run['path']}")
                    found.append({
                        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"],
                        "payload_bytes": x["payload_bytes"],
                        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                        "record_type": fields["WARC-Type"],
                        "refers_to": None if whole else page_of(fields["WARC-Refers-To"]),
                        "payload": x["payload"] if whole else None,
                    })
                if len(found) != run["records"]:
                    raise ValueError(f"{run['path']} has {len(found)} records, not {run['records']}")
                yield pa.RecordBatch.from_pylist(found, schema=_SCHEMA)

    found = cut(packages.select("path").mapInArrow(runs, "path string, start long, length long, records long"))
    # descriptors are short: the number of tasks follows from the bytes they stand for
    whole, number = found.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    cores = packages.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(number, max(cores, math.ceil(whole / TASK_BYTES))))
    return found.repartition(tasks, "path", "start").mapInArrow(
        records,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary",
    )


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def _each(raw: io.BytesIO) -> Iterator[bytes]:
    """The records of a run of gzip members, split by the lengths their headers give."""
    with gzip.GzipFile(fileobj=raw) as plain:
        while head := plain.readline():
            while not head.endswith(b"\r\n\r\n"):
                line = plain.readline()
                if not line:
                    raise ValueError("a record ends in its header")
                head += line
            length = next(
                int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")
            )
            yield head + plain.read(length)
            plain.read(4)


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages to packages and read every record back."""
    folder = folder or shared_folder(spark, "warc")
    return read(cut(write(pages, folder)))

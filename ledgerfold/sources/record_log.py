"""The framed record-log file format: a reader as a distributed source, a reader and a writer of single files.

A file is the header "PGSS" and a 16-bit version, then records. A record is a
CRC-32 of what follows, a type byte, and length-prefixed fields (little
endian). A torn last record is dropped; damage further ahead is an error.
"""

from __future__ import annotations

import mmap
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.errors import Corrupted, InvalidFormat
from ledgerfold.kernels import MAX_VERSION_BYTES, token, token_revision
from ledgerfold.operators.fold import bucket_of
from ledgerfold.sources.schema import DEL, MAX_KEY_BYTES, MAX_VALUE_BYTES, PUT

# Fixed values of the format.
MAGIC, FORMAT = b"PGSS", 2
REC_PUT, REC_DELETE, REC_CURSOR = 1, 2, 3
#: Fields of each record type: (name, struct code of the length).
LAYOUT = {REC_PUT: (("key", "<H"), ("value", "<I"), ("version", "<B")), REC_DELETE: (("key", "<H"), ("version", "<B")), REC_CURSOR: (("cursor", "<B"),)}
LIMITS = {"value": MAX_VALUE_BYTES}
SMALLEST = 6
HEADER = MAGIC + struct.pack("<H", FORMAT)


@dataclass
class Record:
    kind: int
    key: str | None = None
    value: bytes | None = None
    version: bytes = b""


class _Torn(Exception):
    pass


class _Damaged(Exception):
    def __init__(self, size: int):
        self.size = size


def encode(kind: int, **fields: bytes) -> bytes:
    body = bytes([kind])
    for name, code in LAYOUT[kind]:
        data = fields[name]
        most = {"key": MAX_KEY_BYTES, "value": MAX_VALUE_BYTES}.get(name, MAX_VERSION_BYTES)
        if len(data) > most:
            raise InvalidFormat(f"{name} has {len(data)} bytes; at most {most} fit")
        body += struct.pack(code, len(data)) + data
    return struct.pack("<I", zlib.crc32(body)) + body


def put_record(key: str, value: bytes, version: bytes = b"") -> bytes:
    return encode(REC_PUT, key=key.encode(), value=value, version=version)


def delete_record(key: str, version: bytes = b"") -> bytes:
    return encode(REC_DELETE, key=key.encode(), version=version)


def cursor_record(cursor: bytes) -> bytes:
    return encode(REC_CURSOR, cursor=cursor)


def _decode(data: memoryview, at: int) -> tuple[Record, int]:
    """The record at a position and the position after it."""
    if len(data) - at < 5:
        raise _Torn
    crc, kind = struct.unpack_from("<IB", data, at)
    if kind not in LAYOUT:
        if crc == 0 and kind == 0:
            if not any(data[at:]):
                raise _Torn  # slack at the end
            raise InvalidFormat("zeros before further records")
        raise InvalidFormat(f"record type {kind} is unknown")
    p, fields = at + 5, {}
    for name, code in LAYOUT[kind]:
        width = struct.calcsize(code)
        if len(data) - p < width:
            raise _Torn
        (size,) = struct.unpack_from(code, data, p)
        p += width
        if size > LIMITS.get(name, size):  # no writer makes such a length: it is damage, not a torn end
            raise _Damaged(p - at)
        if name in ("version", "cursor") and size > MAX_VERSION_BYTES:
            raise InvalidFormat(f"a {name} of {size} bytes is too long")
        if len(data) - p < size:
            raise _Torn
        fields[name] = bytes(data[p : p + size])
        p += size
    if zlib.crc32(data[at + 4 : p]) != crc:
        raise _Damaged(p - at)
    try:
        key = fields["key"].decode() if "key" in fields else None
    except UnicodeDecodeError as e:
        raise InvalidFormat("a key is not UTF-8") from e
    return Record(kind, key, fields.get("value"), fields.get("version", fields.get("cursor", b""))), p


def scan(raw: bytes) -> Iterator[Record | bool]:
    """Records of a file in order, then whether the end was clean."""
    if len(raw) < len(HEADER):
        raise InvalidFormat("the file is too short")
    if raw[:4] != MAGIC:
        raise InvalidFormat("the magic number is wrong")
    if raw[:6] != HEADER:
        raise InvalidFormat(f"version {struct.unpack('<H', raw[4:6])[0]} is not supported")
    data, at = memoryview(raw), len(HEADER)
    while at < len(raw):
        try:
            record, at = _decode(data, at)
        except _Torn:
            yield False
            return
        except _Damaged as d:
            if len(raw) - (at + d.size) < SMALLEST:  # nothing can follow: a torn last write
                yield False
                return
            raise Corrupted("check sum mismatch") from None
        yield record
    yield True


@dataclass
class Replay:
    entries: dict[str, tuple[bytes, bytes]]
    cursor: int | None
    compact: bool


def replay(raw: bytes) -> Replay:
    """Last write wins over one file; compact tells that rewriting wouldn't shorten it."""
    live, cursor, compact = {}, None, True
    for r in scan(raw):
        if isinstance(r, bool):
            compact = compact and r
        elif r.kind == REC_PUT:
            compact = compact and r.key not in live
            live[r.key] = (r.value, r.version)
        elif r.kind == REC_DELETE:
            live.pop(r.key, None)
            compact = False
        else:
            compact = compact and cursor is None
            cursor = token_revision(r.version)
    return Replay(live, cursor, compact)


def compacted(entries: dict[str, tuple[bytes, bytes]], cursor: bytes) -> bytes:
    """A file of sorted entries and the cursor: the same bytes for the same fold."""
    body = b"".join(put_record(k, *entries[k]) for k in sorted(entries, key=str.encode))
    return HEADER + body + (cursor_record(cursor) if cursor else b"")


ROWS = "path string, arrival bigint, kind int, key string, op string, value binary, revision bigint, version binary"
WRITTEN = "path string, records bigint, bytes bigint"
#: Records that a reader hands on at a time, and bytes that a writer does.
BATCH, PIECE = 10_000, 1 << 20


def _rows(name: str, raw):
    """A file's records as frames of at most BATCH rows."""
    import pandas as pd

    arrival, held = 0, []

    def frame():
        return pd.DataFrame(
            {
                "path": name,
                "arrival": range(arrival - len(held) + 1, arrival + 1),
                "kind": [r.kind for r in held],
                "key": [r.key for r in held],
                "op": [{REC_PUT: PUT, REC_DELETE: DEL}.get(r.kind) for r in held],
                "value": [r.value for r in held],
                "revision": pd.array([token_revision(r.version) for r in held], dtype="Int64"),
                "version": [r.version for r in held],
            }
        )

    for r in scan(raw):
        if not isinstance(r, bool):
            held.append(r)
            arrival += 1
            if len(held) == BATCH:
                yield frame()
                held.clear()
    if held:
        yield frame()


def read_record_logs(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file, or of all files of a folder, as change-log rows: one task a file, as framing is sequential.

    On a mounted path a task maps its file and hands on BATCH records at a
    time, however long the file; elsewhere a file is one value, of at most 2 GB.
    """
    at = path.removeprefix("file://")
    if "://" in at:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
        return files.mapInPandas(lambda batches: (f for pdf in batches for n, c in zip(pdf["path"], pdf["content"]) for f in _rows(n, bytes(c))), ROWS)
    names = [(f"{at}/{n}",) for n in sorted(os.listdir(at)) if n[0] not in "._"] if os.path.isdir(at) else [(at,)]

    def run(batches):
        for pdf in batches:
            for name in pdf["path"]:
                if os.path.getsize(name) < len(HEADER):
                    raise InvalidFormat("the file is too short")
                with open(name, "rb") as f:
                    raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)  # let go with its last view
                yield from _rows(name, raw)

    return spark.createDataFrame(names, "path string").repartition(max(1, len(names)), "path").mapInPandas(run, ROWS)


def write_record_logs(held: DataFrame, cursor: bytes, folder: str, files: int = 16) -> DataFrame:
    """A fold as `files` compact record logs in a mounted folder, written by the executors: path, records, bytes of each.

    A key is in the file of its bucket, each file is sorted and ends with the
    cursor. A file appears whole or not at all, so a task that runs again
    replaces what it wrote. A bucket without keys has no file.
    """
    at = folder.removeprefix("file://")
    rows = held.select("key", "value", "version", bucket_of(F.col("key"), files).alias("bucket"))

    def run(batches):
        out = name = aside = None
        n = size = 0

        def close():
            tail = cursor_record(cursor) if cursor else b""
            out.write(tail)
            out.flush()
            os.fsync(out.fileno())
            out.close()
            os.replace(aside, name)
            return pd.DataFrame({"path": [name], "records": [n], "bytes": [size + len(tail)]})

        import pandas as pd

        for pdf in batches:
            for key, value, version, bucket in zip(pdf["key"], pdf["value"], pdf["version"], pdf["bucket"]):
                if name != f"{at}/part-{bucket:05d}.log":
                    if out is not None:
                        yield close()
                    os.makedirs(at, exist_ok=True)
                    name, aside, n, size = f"{at}/part-{bucket:05d}.log", f"{at}/.{uuid.uuid4().hex}", 0, len(HEADER)
                    out = open(aside, "wb", buffering=PIECE)  # noqa: SIM115
                    out.write(HEADER)
                raw = put_record(key, bytes(value), bytes(version or b""))
                out.write(raw)
                n, size = n + 1, size + len(raw)
        if out is not None:
            yield close()

    return rows.repartition(files, "bucket").sortWithinPartitions("bucket", "key").mapInPandas(run, WRITTEN)


def write_record_log(spark: SparkSession, held: DataFrame, cursor: bytes, path: str) -> None:
    """One compact file of a fold. The format is one sequential file, so one stream of sorted rows writes it, PIECE bytes at a time."""
    from ledgerfold.files import Files

    with Files(spark).writing(path) as write:
        piece = bytearray(HEADER)
        for r in held.orderBy("key").toLocalIterator():
            piece += put_record(r["key"], bytes(r["value"]), bytes(r["version"] or b""))
            if len(piece) >= PIECE:
                write(bytes(piece))
                piece.clear()
        write(bytes(piece) + (cursor_record(cursor) if cursor else b""))


class RecordLogWriter:
    """Append-only writer of one local record log; `checkpoint` says when compaction is due."""

    def __init__(self, path: str, compact_bytes: int):
        self.path, self.limit = path, compact_bytes
        new = not os.path.exists(path) or os.path.getsize(path) == 0
        self.file = open(path, "ab")  # noqa: SIM115
        if new:
            self.file.write(HEADER)
        self.grown = 0

    def write(self, op: str, key: str, value: bytes = b"", version: bytes = b"") -> None:
        raw = put_record(key, value, version) if op == PUT else delete_record(key, version)
        self.file.write(raw)
        self.grown += len(raw)

    def checkpoint(self, cursor: bytes) -> bool:
        self.file.write(cursor_record(cursor))
        self.file.flush()
        return self.grown > self.limit

    def compact(self) -> None:
        self.file.flush()
        with open(self.path, "rb") as f:
            state = replay(f.read())
        aside = f"{self.path}.new"
        with open(aside, "wb") as f:
            f.write(compacted(state.entries, token(state.cursor)))
            f.flush()
            os.fsync(f.fileno())
        os.replace(aside, self.path)
        self.file.close()
        self.file = open(self.path, "ab")  # noqa: SIM115
        self.grown = 0

    def close(self) -> None:
        self.file.close()


def load(path: str) -> Replay | None:
    """Replay a local file and repair it: torn tails and dead records are rewritten. None if it isn't there."""
    if not os.path.exists(path) or os.path.getsize(path) == 0:
        return None
    with open(path, "rb") as f:
        state = replay(f.read())
    if not state.compact:
        aside = f"{path}.new"
        with open(aside, "wb") as f:
            f.write(compacted(state.entries, token(state.cursor)))
        os.replace(aside, path)
    return state

"""The log as a streaming source whose offset is the revision, so the cursor is the offset.

A micro-batch is planned on the driver (claims, segments and the retention
floor); segments are read on executors as Arrow, by row groups of the asked
revisions only. Planning fails with CursorExpired if retention has passed the
offset, before anything is read.
"""

from __future__ import annotations

import base64
import json
import os

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ledgerfold.errors import CursorExpired
from ledgerfold.kernels import resume_window_ok, token
from ledgerfold.sources.schema import CHANGELOG, VOID

NAME = "ledgerfold_log"
_ARROW = pa.schema([("revision", pa.int64()), ("key", pa.string()), ("op", pa.string()), ("value", pa.binary()), ("version", pa.binary()), ("arrival", pa.int64())])


class _Segment(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class _Tail(InputPartition):
    def __init__(self, rows: list):
        self.rows = rows


def _names(path: str) -> list[str]:
    return sorted(n for n in os.listdir(path) if n[0].isdigit()) if os.path.isdir(path) else []


def _load(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").rstrip("/")
        self.start = int(options.get("startingrevision", "0"))
        self.most = int(options.get("maxrevisionspertrigger", "0"))
        self.planned = self.start

    def _layout(self) -> dict:
        names = _names(f"{self.path}/layout")
        return _load(f"{self.path}/layout/{names[-1]}") if names else {"segments": [], "first_sequence": 1, "sealed": 0}

    def initialOffset(self) -> dict:
        return {"revision": self.start}

    def _head(self) -> int:
        """The last revision before any bulk append that is still being written."""
        head = self._layout()["sealed"]
        for name in _names(f"{self.path}/claims"):
            last = int(name.split("-")[-1])
            if "-" in name and last > head and not os.path.exists(f"{self.path}/outcomes/{name}"):
                break
            head = max(head, last)
        return head

    def latestOffset(self) -> dict:
        head = self._head()
        if self.most:
            head = min(head, self.planned + self.most)
        self.planned = max(self.planned, head)
        return {"revision": self.planned}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["revision"], end["revision"]
        self.planned = max(self.planned, high)
        state = self._layout()
        if high > low and not resume_window_ok(low, state["first_sequence"]):
            raise CursorExpired(f"the log starts at {state['first_sequence']}, after revision {low}")
        segments, rows = list(state["segments"]), []
        for name in _names(f"{self.path}/claims"):
            first, last = int(name.split("-")[0]), int(name.split("-")[-1])
            if last <= state["sealed"] or last <= low or first > high:
                continue
            c = _load(f"{self.path}/claims/{name}")
            if "segment" in c:
                with open(f"{self.path}/outcomes/{name}") as f:
                    if f.read() == VOID:
                        continue
                segments.append({"folder": c["segment"], "from": first, "to": last})
            else:
                value = base64.b64decode(c["value"]) if c["value"] is not None else None
                rows.append((c["revision"], c["key"], c["op"], value, token(c["revision"]), c["revision"]))
        out: list[InputPartition] = [_Segment(f"{self.path}/segments/{s['folder']}", low, high) for s in segments if s["to"] > low and s["from"] <= high]
        return [*out, _Tail(rows)] if rows or not out else out

    def read(self, partition):
        if isinstance(partition, _Tail):
            cols = list(zip(*partition.rows)) or [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
            return
        revision = pads.field("revision")
        scan = pads.dataset(partition.path, format="parquet", exclude_invalid_files=True).scanner(columns=_ARROW.names, filter=(revision > partition.low) & (revision <= partition.high))
        for batch in scan.to_batches():
            if batch.num_rows:
                yield batch.cast(_ARROW) if batch.schema != _ARROW else batch

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """spark.readStream.format("ledgerfold_log"): options path, startingRevision, maxRevisionsPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return CHANGELOG

    def streamReader(self, schema) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)

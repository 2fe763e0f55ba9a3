"""Buckets: revisioned logs with compare-and-swap writes.

A bucket is a folder. Single writes are claims, one small file whose name is
the revision; creating it is exclusive, so one writer gets a revision and the
others retry on the new state. Bulk appends claim a range and write it as
Parquet, clustered by revision, without passing through the driver. `seal`
turns claims into a Parquet segment, so reading is a Parquet scan with
revision and prefix pushdown and a short tail of claims. value_len stands
beside value, so key listings don't read values.

A bulk append ends with an outcome, one more file made exclusively: "done" by
its writer, or "void" by whoever gives it up. Only appends that are done are
read, so a writer that was given up learns it and no rows are lost in silence.

Claims need an exclusive create. Local disks and file systems whose rename
refuses an existing target have it; elsewhere writes are refused unless the
caller vouches for a single writer.
"""

from __future__ import annotations

import base64
import json
import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.errors import AlreadyExists, CursorExpired, KvError, OperationFailed, RevisionMismatch
from ledgerfold.extension import KvReader, KvWatcher, KvWriter
from ledgerfold.files import Files
from ledgerfold.functions.scope import Scope
from ledgerfold.kernels import resume_start, resume_window_ok, token, token_revision
from ledgerfold.operators import fold as ops
from ledgerfold.sources.schema import CHANGELOG, DEFAULT_MAX_BYTES, DEL, DONE, MAX_KEY_BYTES, MAX_VALUE_BYTES, PURGE, PUT, VOID

_STORED = T.StructType([*CHANGELOG.fields, T.StructField("value_len", T.LongType()), T.StructField("written_unix", T.LongType())])


@dataclass(frozen=True)
class BucketConfig:
    max_history: int = 1
    max_bytes: int | None = DEFAULT_MAX_BYTES
    max_age_s: int | None = None
    replicas: int = 1
    discard: str = "new"  # "new" rejects writes when full, "old" drops the oldest changes


CAPABILITIES = {"cas": True, "streaming_watch": True, "prefix_watch": True, "purge": True, "ttl": False, "transactions": False, "global_ordering": False, "history": True}


@dataclass(frozen=True)
class Entry:
    key: str
    value: bytes
    revision: int


class Bucket(KvReader, KvWriter, KvWatcher):
    """get-or-create: an existing bucket keeps its own configuration."""

    def __init__(self, spark: SparkSession, path: str, config: BucketConfig | None = None, seal_after: int = 1000, clock=time.time, single_writer: bool = False):
        self.spark, self.path, self.files, self.clock = spark, path.rstrip("/"), Files(spark), clock
        self.seal_after, self.single_writer = seal_after, single_writer
        self.files.create(f"{self.path}/bucket.json", json.dumps(asdict(config or BucketConfig())).encode())
        self.config = BucketConfig(**json.loads(self.files.read(f"{self.path}/bucket.json")))
        self._read: dict[str, dict] = {}  # claims never change

    # --- layout

    def _state(self) -> dict:
        """The newest layout: segments (folder, from, to, bytes) and first_sequence."""
        names = [n for n in self.files.names(f"{self.path}/layout") if n[0].isdigit()]
        if not names:
            return {"n": 0, "segments": [], "first_sequence": 1, "sealed": 0}
        return json.loads(self.files.read(f"{self.path}/layout/{names[-1]}"))

    def _advance(self, state: dict, **changes) -> None:
        new = state | changes | {"n": state["n"] + 1}
        if not self.files.create(f"{self.path}/layout/{new['n']:020d}", json.dumps(new).encode()):
            raise OperationFailed("another writer changed the layout")
        for name in self.files.names(f"{self.path}/layout"):
            if name[0].isdigit() and int(name) < new["n"] - 10:
                self.files.remove(f"{self.path}/layout/{name}")

    def _claims(self, state: dict) -> list[dict]:
        """Claims after what is sealed, each read once; appends that were given up are left out."""
        names = [n for n in self.files.names(f"{self.path}/claims") if n[0].isdigit() and int(n.split("-")[-1]) > state["sealed"]]
        held = self._read
        self._read = {n: held.get(n) or json.loads(self.files.read(f"{self.path}/claims/{n}")) for n in names}
        return [c for c in self._read.values() if "segment" not in c or self._outcome(c["segment"]) != VOID]

    def _outcome(self, folder: str) -> str | None:
        """DONE, VOID, or None while an append is under way."""
        at = f"{self.path}/outcomes/{folder}"
        return self.files.read(at).decode() if self.files.exists(at) else None

    def head(self) -> int:
        """Last revision given out."""
        state, names = self._state(), [n for n in self.files.names(f"{self.path}/claims") if n[0].isdigit()]
        return max([state["sealed"], *(int(n.split("-")[-1]) for n in names)])

    def first_sequence(self) -> int:
        """Oldest revision that retention has left; kept even when the log is empty."""
        return self._state()["first_sequence"]

    def changes(self, after: int = 0, with_time: bool = False) -> DataFrame:
        """All retained changes after a revision, as a change log."""
        state = self._state()
        parts, tail = [], []
        segments = [s for s in state["segments"] if s["to"] > after]
        for c in self._claims(state):
            if "segment" in c:
                if self._outcome(c["segment"]) == DONE:
                    segments.append(c | {"folder": c["segment"]})
            elif c["revision"] > after:
                value = base64.b64decode(c["value"]) if c["value"] is not None else None
                tail.append((c["revision"], c["key"], c["op"], value, token(c["revision"]), c["revision"], len(value or b""), c["at"]))
        if segments:
            parts.append(self.spark.read.schema(_STORED).parquet(*[f"{self.path}/segments/{s['folder']}" for s in segments]))
        if tail or not parts:
            parts.append(self.spark.createDataFrame(tail, _STORED))
        log = parts[0]
        for p in parts[1:]:
            log = log.unionByName(p)
        names = CHANGELOG.fieldNames() + ["value_len"] + (["written_unix"] if with_time else [])
        return log.where(F.col("revision") > after).select(*names)

    # --- reads

    def scan(self, scope: str | Scope = "") -> DataFrame:
        return ops.live(self.changes(), _scope(scope))

    def keys(self, scope: str | Scope = "") -> DataFrame:
        log = self.changes().where(_scope(scope).column())
        lean = log.select("key", "arrival", ((F.col("op") == PUT) & (F.col("value_len") > 0)).alias("shown"))
        return lean.groupBy("key").agg(F.max_by("shown", "arrival").alias("shown")).where("shown").select("key")

    def watch(self, scope: Scope) -> DataFrame:
        """The state at the head, as changes in revision order, markers included. Nothing for a scope without prefixes."""
        return ops.state_sync(self.changes().select(*CHANGELOG.fieldNames()), scope)

    def watch_from(self, cursor: int | None, scope: Scope) -> DataFrame:
        """Changes after the cursor in the scope; the state without a cursor or from cursor 0; CursorExpired if changes are gone."""
        if not cursor:
            return self.watch(scope)
        self.check_resume(cursor)
        out = ops.delta(self.changes(after=resume_start(cursor) - 1), cursor, scope)
        self.check_resume(cursor)  # retention may have run meanwhile
        return out

    def check_resume(self, cursor: int) -> None:
        if not resume_window_ok(cursor, first := self.first_sequence()):
            raise CursorExpired(f"the log starts at {first}, after cursor {cursor}")

    def _last(self, key: str) -> dict | None:
        state = self._state()
        claims = self._claims(state)
        for c in reversed(claims):
            if c.get("key") == key:
                value = base64.b64decode(c["value"]) if c["value"] is not None else None
                return {"op": c["op"], "value": value, "revision": c["revision"]}
            if "segment" in c:
                break
        rows = self.changes().where(F.col("key") == key).orderBy(F.desc("arrival")).limit(1).collect()
        return {"op": rows[0]["op"], "value": rows[0]["value"], "revision": rows[0]["revision"]} if rows else None

    def entry(self, key: str) -> Entry | None:
        """The last put of a key, a tombstone of empty value included."""
        last = self._last(key)
        return Entry(key, bytes(last["value"] or b""), last["revision"]) if last and last["op"] == PUT else None

    def get(self, key: str) -> Entry | None:
        found = self.entry(key)
        return found if found and found.value else None

    # --- writes

    def put(self, key: str, value: bytes) -> int:
        return self._write(key, PUT, value)

    def delete(self, key: str) -> bool:
        """A delete marker, whether or not the key is there."""
        self._write(key, DEL, None)
        return True

    def create(self, key: str, value: bytes) -> int:
        """Fails on a key whose last change is a put; a tombstone of compare-and-swap deletes is one."""

        def check(last):
            if last and last["op"] == PUT:
                raise AlreadyExists(key)

        return self._write(key, PUT, value, check)

    def update(self, key: str, value: bytes, expected: int | bytes) -> int:
        return self._write(key, PUT, value, self._expects(key, expected))

    def delete_with_version(self, key: str, expected: int | bytes) -> bool:
        """Compare and swap to an empty value, which reads hide and `entry` shows."""
        self._write(key, PUT, b"", self._expects(key, expected))
        return True

    def purge(self, key: str) -> None:
        """A marker; the key's earlier changes go at the next retention pass."""
        self._write(key, PURGE, None)

    @staticmethod
    def _expects(key: str, expected: int | bytes):
        if isinstance(expected, bytes):
            expected = token_revision(expected)
        if expected is None:
            raise OperationFailed("the expected version is not a revision")

        def check(last):
            if (last["revision"] if last else None) != expected:
                raise RevisionMismatch(key)

        return check

    def _write(self, key: str, op: str, value: bytes | None, check=None) -> int:
        """Claim the next revision; the key's last change is looked up only where the write depends on it."""
        if len(key.encode()) > MAX_KEY_BYTES or len(value or b"") > MAX_VALUE_BYTES:
            raise OperationFailed("the key or the value is too long")
        if not self.files.is_local(self.path) and not self.single_writer:
            raise OperationFailed("exclusive claims are not known to hold here; pass single_writer=True for one writer")
        for _ in range(100):
            head = self.head()
            self._make_room(len(key.encode()) + len(value or b""))
            if check is not None:
                check(self._last(key))
            record = {"revision": head + 1, "key": key, "op": op, "value": base64.b64encode(value).decode() if value is not None else None, "at": int(self.clock())}
            if self.files.create(f"{self.path}/claims/{head + 1:020d}", json.dumps(record).encode()):
                if head + 1 - self._state()["sealed"] > self.seal_after:
                    self.seal()
                return head + 1
        raise OperationFailed("too many writers claim revisions at once")

    def append(self, rows: DataFrame) -> tuple[int, int]:
        """Bulk append of (key, op, value) in the order of `arrival`; (first, last) revision given.

        Ranks are made in two steps, by range partitions, so no task sees all
        rows. Raises OperationFailed if the append was given up meanwhile.
        """
        n = rows.count()
        for _ in range(100):
            head = self.head()
            folder = f"{head + 1:020d}-{head + n:020d}"
            self._make_room(0)
            claim = {"from": head + 1, "to": head + n, "segment": folder, "at": int(self.clock())}
            if n == 0:
                return head + 1, head
            if self.files.create(f"{self.path}/claims/{head + 1:020d}-{head + n:020d}", json.dumps(claim).encode()):
                break
        else:
            raise OperationFailed("too many writers claim revisions at once")
        ranked = _ranked(rows).withColumn("revision", F.col("__rank") + head)
        out = ranked.select("revision", "key", "op", F.when(F.col("op") == PUT, F.col("value").cast("binary")).alias("value"), _token_of("revision").alias("version"), F.col("revision").alias("arrival"))
        out = out.withColumns({"value_len": F.coalesce(F.octet_length("value"), F.lit(0)).cast("long"), "written_unix": F.lit(int(self.clock()))})
        out.write.parquet(f"{self.path}/segments/{folder}")
        if not self.files.create(f"{self.path}/outcomes/{folder}", DONE.encode()):
            raise OperationFailed("the append was given up while it was being written; nothing of it is in the log")
        return head + 1, head + n

    def void_stalled(self, older_than_s: float) -> int:
        """Give up bulk appends that were claimed so long ago and never finished; their revisions stay unused.

        Until then, watches wait before the claimed range.
        """
        n = 0
        for name in self.files.names(f"{self.path}/claims"):
            if name[0].isdigit() and "-" in name and self._outcome(name) is None:
                claim = json.loads(self.files.read(f"{self.path}/claims/{name}"))
                if claim["at"] + older_than_s <= self.clock() and self.files.create(f"{self.path}/outcomes/{name}", VOID.encode()):
                    n += 1
        return n

    def seal(self) -> None:
        """Turn claims into a Parquet segment."""
        state = self._state()
        claims = self._claims(state)
        for k, c in enumerate(claims):  # an append that is still being written ends what can be sealed
            if "segment" in c and self._outcome(c["segment"]) != DONE:
                claims = claims[:k]
                break
        if not claims:
            return
        last = max(c.get("to", c.get("revision")) for c in claims)
        singles = [c for c in claims if "segment" not in c]
        sized = lambda folder, low, high: {"folder": folder, "from": low, "to": high, "bytes": self.files.size(f"{self.path}/segments/{folder}")}
        segments = [*state["segments"], *(sized(c["segment"], c["from"], c["to"]) for c in claims if "segment" in c)]
        if singles:
            rows = []
            for c in singles:
                value = base64.b64decode(c["value"]) if c["value"] is not None else None
                rows.append((c["revision"], c["key"], c["op"], value, token(c["revision"]), c["revision"], len(value or b""), c["at"]))
            folder = f"{rows[0][0]:020d}-{rows[-1][0]:020d}-sealed-{state['n']}"
            self.spark.createDataFrame(rows, _STORED).orderBy("revision").write.parquet(f"{self.path}/segments/{folder}")
            segments.append(sized(folder, rows[0][0], rows[-1][0]))
        self._advance(state, segments=segments, sealed=last)
        for name in self.files.names(f"{self.path}/claims"):
            if name[0].isdigit() and int(name.split("-")[-1]) <= last - 1:  # the last one stays, so the head is not lost
                self.files.remove(f"{self.path}/claims/{name}")

    # --- retention

    def size_bytes(self) -> int:
        state = self._state()
        tail = sum(len(c["key"]) + len(base64.b64decode(c["value"] or "")) for c in self._claims(state) if "key" in c)
        return tail + sum(s["bytes"] if "bytes" in s else self.files.size(f"{self.path}/segments/{s['folder']}") for s in state["segments"])

    def _make_room(self, more: int) -> None:
        if self.config.max_bytes is None or self.size_bytes() + more <= self.config.max_bytes:
            return
        if self.config.discard == "new":
            raise OperationFailed("maximum bytes exceeded")
        self.apply_retention(room=more)

    def apply_retention(self, room: int = 0) -> int:
        """Keep max_history changes a key, none before a purge, none past max_age, and the newest that fit max_bytes.

        Returns the new first sequence. One shuffle on the key; the byte limit
        is decided on sums by ranges of revisions.
        """
        self.seal()
        state = self._state()
        if self._claims(state):
            raise OperationFailed("an append is still being written; finish or void it first")
        log = self.changes(with_time=True)
        purged = log.groupBy("key").agg(F.max(F.when(F.col("op") == PURGE, F.col("arrival"))).alias("purged"))
        kept = ops.history(log.join(purged, "key").where(F.col("purged").isNull() | (F.col("arrival") >= F.col("purged"))), self.config.max_history).drop("rn", "purged")
        if self.config.max_age_s is not None:
            kept = kept.where(F.col("written_unix") > int(self.clock()) - self.config.max_age_s)
        if self.config.max_bytes is not None and self.config.discard == "old":
            kept = kept.where(F.col("revision") >= _floor_for(kept, self.config.max_bytes - room))
        head, folder = self.head(), f"kept-{state['n']:020d}"
        kept.repartitionByRange("revision").sortWithinPartitions("revision").write.parquet(f"{self.path}/segments/{folder}")
        floor = self.spark.read.schema(_STORED).parquet(f"{self.path}/segments/{folder}").agg(F.min("revision")).first()[0]
        floor = max(state["first_sequence"], floor if floor is not None else head + 1)
        self._advance(state, segments=[{"folder": folder, "from": floor, "to": head, "bytes": self.files.size(f"{self.path}/segments/{folder}")}], first_sequence=floor, sealed=max(head, state["sealed"]))
        return floor


def _scope(scope: str | Scope) -> Scope:
    return scope if isinstance(scope, Scope) else Scope.prefix(scope)


def _token_of(name: str):
    return F.unhex(F.lpad(F.hex(F.col(name)), 16, "0"))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with __rank 1.. in arrival order: range partitions, their counts, and ranks within each."""
    from pyspark.sql import Window as W

    part = rows.repartitionByRange("arrival").withColumn("__part", F.spark_partition_id())
    inside = part.withColumn("__in", F.row_number().over(W.partitionBy("__part").orderBy("arrival")))
    counts = inside.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("arrival").alias("__from"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__from").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    return inside.join(before, "__part").withColumn("__rank", F.col("__in") + F.col("__before"))


def _floor_for(kept: DataFrame, limit: int) -> int:
    """Lowest revision from which the newest changes fit the limit, by sums of 1024 ranges, then within one."""
    size = F.octet_length("key") + F.col("value_len")
    low, high = kept.agg(F.min("revision"), F.max("revision")).first()
    if low is None:
        return 0
    while True:
        width = max(1, (high - low + 1024) // 1024)
        sums = kept.where(F.col("revision").between(low, high)).groupBy(F.floor((F.col("revision") - low) / width).alias("r")).agg(F.sum(size).alias("b")).collect()  # at most 1025 rows
        for r in sorted(sums, key=lambda x: -x["r"]):
            if r["b"] > limit:
                if width == 1:
                    return low + r["r"] + 1
                low, high = low + r["r"] * width, min(high, low + (r["r"] + 1) * width - 1)
                break
            limit -= r["b"]
        else:
            return low


__all__ = ["CAPABILITIES", "Bucket", "BucketConfig", "Entry", "KvError"]

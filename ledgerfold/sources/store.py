"""The durable fold: bucketed Parquet, one manifest a version, data and cursor published together.

A version is a numbered manifest that names, for every key bucket, the folder
of its base files, and the deltas since. Creating the next manifest is the one
atomic step: it carries the data and the cursor, or neither. Applying a batch
writes a delta (cost of the batch, not of the fold); compaction rewrites only
buckets that deltas touched, sorted by key, so prefix and point queries skip
row groups. Files are never changed, so a reader stays on its version.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold.errors import BackendError, InvalidFormat
from ledgerfold.extension import SnapshotStore
from ledgerfold.files import Files
from ledgerfold.functions.columns import is_put
from ledgerfold.functions.scope import Scope
from ledgerfold.kernels import cursor_hex, parse_cursor_hex
from ledgerfold.operators import fold as ops
from ledgerfold.sources.schema import COMPACT_BYTES, FOLD, MAX_VALUE_BYTES

FORMAT_GENERATION = "1"
STORED = T.StructType([*FOLD.fields, T.StructField("bucket", T.IntegerType())])
_DELTA = T.StructType([*FOLD.fields, T.StructField("op", T.StringType()), T.StructField("arrival", T.LongType()), T.StructField("bucket", T.IntegerType())])


class FoldReader:
    """Queries over one version of a fold; `refresh` moves on to the newest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.refresh()

    def refresh(self) -> FoldReader:
        names = [n for n in self.files.names(f"{self.path}/manifests") if n[0].isdigit()]
        self.manifest = self._parse(self.files.read(f"{self.path}/manifests/{names[-1]}")) if names else None
        return self

    @staticmethod
    def _parse(raw: bytes) -> dict:
        try:
            m = json.loads(raw)
            parse_cursor_hex(m["cursor_hex"])
            return m
        except (ValueError, KeyError, TypeError) as e:
            raise InvalidFormat(f"manifest: {e}") from e

    @property
    def cursor(self) -> int | None:
        return parse_cursor_hex(self.manifest["cursor_hex"]) if self.manifest else None

    def _rows(self, buckets: set[int] | None = None) -> DataFrame:
        """The fold, of all buckets or of some."""
        if self.manifest is None:
            return self.spark.createDataFrame([], FOLD)
        m = self.manifest
        base = [f"{self.path}/{d}" for b, d in m["base"].items() if buckets is None or int(b) in buckets]
        held = self.spark.read.schema(FOLD).parquet(*base) if base else self.spark.createDataFrame([], FOLD)
        if not m["deltas"]:
            return held
        deltas = reduce(DataFrame.unionByName, [self.spark.read.schema(_DELTA).parquet(f"{self.path}/{d['dir']}").withColumn("__n", F.lit(d["n"])) for d in m["deltas"]])
        if buckets is not None:
            deltas = deltas.where(F.col("bucket").isin(sorted(buckets)))
        if len(m["deltas"]) > 1:  # a delta has a key once
            newest = deltas.groupBy("key").agg(F.max("__n").alias("__n"))
            deltas = deltas.join(newest, ["key", "__n"], "left_semi")
        names = FOLD.fieldNames()
        kept = held.join(deltas.select("key"), "key", "left_anti")
        return kept.select(*names).unionByName(deltas.where(is_put()).select(*names))

    def rows(self, scope: str | Scope = "") -> DataFrame:
        s = scope if isinstance(scope, Scope) else Scope.prefix(scope)
        return self._rows().where(s.column())

    def range(self, prefix: str = "") -> DataFrame:
        """Entries under a prefix in ascending key order."""
        return self.rows(prefix).orderBy("key")

    def get(self, key: str) -> Row | None:
        """Reads one bucket, with the key pushed to the scan."""
        found = self._rows({self._bucket(key)}).where(F.col("key") == key).head(1)
        return found[0] if found else None

    def multi_get(self, keys: list[str]) -> list[Row | None]:
        """Aligned with the asked keys; None where absent."""
        if not keys:
            return []
        held = self._rows({self._bucket(k) for k in keys})
        rows = ops.multi_get(held, keys).collect()
        return [r if r["value"] is not None else None for r in rows]

    def for_each_in_range(self, prefix: str, visit: Callable[[Row], None]) -> None:
        """Visit entries in key order, one partition on the driver at a time; an exception stops it."""
        for row in self.range(prefix).toLocalIterator(prefetchPartitions=False):
            visit(row)

    def stale_keys(self, current: DataFrame, scope: Scope | None = None) -> DataFrame:
        return ops.stale_keys(self._rows().select("key"), current, scope)

    def _bucket(self, key: str) -> int:
        return zlib.crc32(key.encode()) % (self.manifest["buckets"] if self.manifest else 1)


class FoldStore(FoldReader, SnapshotStore):
    """The writer of a fold. One writer; a second one fails at its next publish."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, compact_bytes: int = COMPACT_BYTES):
        super().__init__(spark, path)
        self.buckets = self.manifest["buckets"] if self.manifest else buckets
        self.compact_bytes = compact_bytes

    @classmethod
    def open(cls, spark: SparkSession, path: str, **how) -> tuple[int | None, FoldStore]:
        """(cursor to resume from, store); a folder without a fold gives (None, an empty store)."""
        store = cls(spark, path, **how)
        return store.cursor, store

    def reader(self) -> FoldReader:
        return FoldReader(self.spark, self.path)

    def _publish(self, **changes) -> None:
        n = self.manifest["n"] if self.manifest else 0
        old = self.manifest or {"base": {}, "deltas": [], "cursor_hex": "", "buckets": self.buckets, "generation": FORMAT_GENERATION}
        new = old | changes | {"n": n + 1, "written_unix": int(time.time())}
        if not self.files.create(f"{self.path}/manifests/{n + 1:020d}", json.dumps(new).encode()):
            raise BackendError("another writer published this version")
        self.manifest = new

    def apply(self, batch: DataFrame, cursor: int | None) -> None:
        """Fold a batch (change-log rows) and move the cursor, in one publish.

        An empty batch moves the cursor only. A cursor of None keeps the old one.
        Applying a batch again gives the same fold.
        """
        n = self.manifest["n"] + 1 if self.manifest else 1
        last = ops.latest(batch).withColumn("bucket", ops.bucket_of(F.col("key"), self.buckets))
        checked = last.withColumn("value", F.when(F.coalesce(F.octet_length("value"), F.lit(0)) <= MAX_VALUE_BYTES, F.when(is_put(), F.coalesce("value", F.unhex(F.lit("")))).otherwise(F.lit(None))).otherwise(F.raise_error(F.lit("a value is longer than 16 MiB"))))
        folder = f"delta/{n:020d}"
        checked.select(*_DELTA.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        touched = [r["bucket"] for r in self.spark.read.schema(_DELTA).parquet(f"{self.path}/{folder}").select("bucket").distinct().collect()]  # at most `buckets`
        deltas = (self.manifest or {"deltas": []})["deltas"]
        if touched:
            deltas = [*deltas, {"dir": folder, "n": n, "bytes": self.files.size(f"{self.path}/{folder}"), "buckets": sorted(touched)}]
        hexed = cursor_hex(cursor) if cursor is not None else (self.manifest or {"cursor_hex": ""})["cursor_hex"]
        self._publish(deltas=deltas, cursor_hex=hexed)
        if sum(d["bytes"] for d in deltas) > self.compact_bytes:
            self.compact()

    def compact(self) -> None:
        """Merge deltas into the buckets they touch. Nothing to do without deltas. Same fold, same order of rows."""
        if self.manifest is None or not self.manifest["deltas"]:
            return
        n = self.manifest["n"] + 1
        touched = {b for d in self.manifest["deltas"] for b in d["buckets"]}
        rows = self._rows(touched).withColumn("bucket", ops.bucket_of(F.col("key"), self.buckets))
        folder = f"base/{n:020d}"
        sorted_rows = rows.repartition(len(touched), "bucket").sortWithinPartitions("bucket", "key")
        sorted_rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = {n.partition("=")[2] for n in self.files.names(f"{self.path}/{folder}") if n.startswith("bucket=")}
        base = {b: d for b, d in self.manifest["base"].items() if int(b) not in touched}
        base |= {b: f"{folder}/bucket={b}" for b in made}
        self._publish(base=base, deltas=[])

    settle = compact

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests before the newest `keep` and the data that none of these names."""
        names = [n for n in self.files.names(f"{self.path}/manifests") if n[0].isdigit()]
        alive: set[str] = set()
        for name in names[-keep:]:
            m = self._parse(self.files.read(f"{self.path}/manifests/{name}"))
            alive |= {d.split("/")[1] for d in m["base"].values()} | {d["dir"].split("/")[1] for d in m["deltas"]}
        removed = 0
        for name in names[:-keep]:
            self.files.remove(f"{self.path}/manifests/{name}")
            removed += 1
        newest = int(names[-1]) if names else 0
        for kind in ("base", "delta"):
            for name in self.files.names(f"{self.path}/{kind}"):
                if name.isdigit() and name not in alive and int(name) <= newest:
                    self.files.remove(f"{self.path}/{kind}/{name}")
                    removed += 1
        return removed



"""Frozen schemas, operations and limits."""

from __future__ import annotations

from pyspark.sql import types as T

PUT, DEL, PURGE = "PUT", "DEL", "PURGE"
#: How a bulk append ended.
DONE, VOID = "done", "void"

CHANGELOG = T.StructType(
    [
        T.StructField("revision", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("version", T.BinaryType()),
        T.StructField("arrival", T.LongType()),
    ]
)
FOLD = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("revision", T.LongType()),
        T.StructField("version", T.BinaryType()),
    ]
)
LEASE = T.StructType(
    [
        T.StructField("holder_id", T.StringType()),
        T.StructField("acquired_at_unix", T.LongType()),
        T.StructField("expires_at_unix", T.LongType()),
        T.StructField("completed_cursor_hex", T.StringType()),
        T.StructField("completed_at_unix", T.LongType()),
    ]
)

# Limits of the record format and defaults of buckets and folds.
MAX_KEY_BYTES = 65_535
MAX_VALUE_BYTES = 16 * 1024 * 1024
DEFAULT_MAX_BYTES = 10 * 1024 * 1024
COMPACT_BYTES = 10 * 1024 * 1024
MAX_STORE_FAILURES = 16
BATCH_WINDOW_MS, BATCH_MAX = 10, 100
MANIFEST_CAP = 1024 * 1024
PRUNE_GRACE_TTLS = 4
ARTIFACT_SCHEMA = 1

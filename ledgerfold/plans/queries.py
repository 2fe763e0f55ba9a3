"""One query for each batch and streaming operator over the changelogs of the driver's tables, with the SQL it equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import columns as C
from ledgerfold.functions.scope import Scope
from ledgerfold.operators import fold as ops
from ledgerfold.plans.registry import ORACLES, QUERIES, query
from ledgerfold.plans.registry import run_folder as _shared
from ledgerfold.sources import artifact
from ledgerfold.sources.changelogs import events_log, orders_log
from ledgerfold.sources.schema import LEASE
from ledgerfold.sources.store import FoldStore

# The same change logs in SQL.
_LOG = """WITH log AS (
  SELECT event_id + 1 AS revision, 'user.' || lpad(CAST(user_id AS VARCHAR), 4, '0') || '.' || CAST(event_id % 7 AS VARCHAR) AS key,
         CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'PURGE' WHEN event_type = 'error' THEN 'DEL' ELSE 'PUT' END AS op,
         CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'signup' THEN '' ELSE props END AS value FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC) AS rn FROM log) WHERE rn = 1)
"""
_ORDERS = """WITH log AS (
  SELECT o_orderkey + 1 AS revision, 'cust.' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS key,
         CASE WHEN o_orderstatus = 'O' THEN 'DEL' ELSE 'PUT' END AS op, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS value FROM orders),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC) AS rn FROM log) WHERE rn = 1)
"""
#: Head of the log, and the middle of it, as a cursor.
_MIDDLE = "(SELECT max(revision) // 2 FROM log)"
_KEYS = ["user.0001.0", "user.0002.1", "absent.key", "user.0001.0", "user.0007.3"]


def _text(df: DataFrame) -> DataFrame:
    """Values as text, revisions as they are."""
    return df.select(*[F.col(c).cast("string").alias(c) if c == "value" else F.col(c) for c in df.columns if c not in ("version", "arrival")])


def _middle(log: DataFrame) -> int:
    return (log.agg(F.max("revision")).first()[0] or 0) // 2


@query("fold_latest", _LOG + "SELECT key, value, revision FROM last WHERE op = 'PUT'")
def fold_latest(spark, sf_dir):
    return _text(ops.fold(events_log(spark, sf_dir)))


@query("fold_latest_window", ORACLES["fold_latest"])
def fold_latest_window(spark, sf_dir):
    return _text(ops.latest_by_window(events_log(spark, sf_dir)).where(C.is_put()).select("key", "value", "revision"))


@query("fold_latest_join", ORACLES["fold_latest"])
def fold_latest_join(spark, sf_dir):
    return _text(ops.latest_by_join(events_log(spark, sf_dir)).where(C.is_put()).select("key", "value", "revision"))


@query("fold_latest_max", ORACLES["fold_latest"])
def fold_latest_max(spark, sf_dir):
    return _text(ops.latest_by_max(events_log(spark, sf_dir)).where(C.is_put()).select("key", "value", "revision"))


@query("fold_orders", _ORDERS + "SELECT key, value, revision FROM last WHERE op = 'PUT'")
def fold_orders(spark, sf_dir):
    return _text(ops.fold(orders_log(spark, sf_dir)))


@query("live_scan", _LOG + "SELECT key, value, revision FROM last WHERE op = 'PUT' AND length(value) > 0")
def live_scan(spark, sf_dir):
    return _text(ops.live(events_log(spark, sf_dir)))


@query("live_keys", _LOG + "SELECT key FROM last WHERE op = 'PUT' AND length(value) > 0")
def live_keys(spark, sf_dir):
    return ops.live_keys(events_log(spark, sf_dir))


@query("scan_prefix", _LOG + "SELECT key, value, revision FROM last WHERE op = 'PUT' AND length(value) > 0 AND starts_with(key, 'user.000')")
def scan_prefix(spark, sf_dir):
    return _text(ops.live(events_log(spark, sf_dir), Scope.prefix("user.000")))


@query("fold_range", _LOG + "SELECT key, value, revision FROM last WHERE op = 'PUT' AND starts_with(key, 'user.001') ORDER BY key")
def fold_range(spark, sf_dir):
    return _text(ops.fold(events_log(spark, sf_dir), Scope.prefix("user.001")).orderBy("key"))


@query("watch_prefixes_union", _LOG + "SELECT revision, key, op, value FROM last WHERE starts_with(key, 'user.000') OR starts_with(key, 'user.002') OR starts_with(key, 'user.0001')")
def watch_prefixes_union(spark, sf_dir):
    return _text(ops.state_sync(events_log(spark, sf_dir), Scope.of(["user.000", "user.002", "user.0001"]))).select("revision", "key", "op", "value")


@query("watch_prefixes_empty", _LOG + "SELECT (SELECT count(*) FROM last WHERE false) AS in_no_prefix, (SELECT count(*) FROM last) AS in_all")
def watch_prefixes_empty(spark, sf_dir):
    last = ops.latest(events_log(spark, sf_dir)).select("key")
    return last.agg(F.count(F.when(Scope.of([]).column(), 1)).alias("in_no_prefix"), F.count(F.when(Scope.all().column(), 1)).alias("in_all"))


_EMPTY_KEY = "(SELECT min(key) FROM last WHERE op = 'PUT' AND value = '')"


@query("get_key", _LOG + f"SELECT key, value, revision FROM last WHERE op = 'PUT' AND length(value) > 0 AND key IN ({_EMPTY_KEY}, (SELECT max(key) FROM last WHERE op = 'PUT' AND length(value) > 0))")
def get_key(spark, sf_dir):
    return _text(ops.live(_two_keys(spark, sf_dir)))


@query("entry_key", _LOG + f"SELECT key, value, revision FROM last WHERE op = 'PUT' AND key IN ({_EMPTY_KEY}, (SELECT max(key) FROM last WHERE op = 'PUT' AND length(value) > 0))")
def entry_key(spark, sf_dir):
    return _text(ops.fold(_two_keys(spark, sf_dir)))


def _two_keys(spark, sf_dir) -> DataFrame:
    """The changes of one key with an empty last value and of one with a value."""
    log = events_log(spark, sf_dir)
    empty = F.col("value") == F.unhex(F.lit(""))
    keys = ops.fold(log).agg(F.min(F.when(empty, F.col("key"))), F.max(F.when(~empty, F.col("key")))).first()
    return log.where(F.col("key").isin([k for k in keys if k is not None]))


@query(
    "multi_get",
    _LOG + ", asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(_KEYS)) + ") AS t(pos, key)) "
    "SELECT a.pos, a.key, l.value, l.revision FROM asked a LEFT JOIN (SELECT * FROM last WHERE op = 'PUT') l ON a.key = l.key",
)
def multi_get(spark, sf_dir):
    return _text(ops.multi_get(ops.fold(events_log(spark, sf_dir)), _KEYS))


@query("delta_from_cursor", _LOG + f"SELECT revision, key, op, value FROM log WHERE revision > {_MIDDLE}")
def delta_from_cursor(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return _text(ops.delta(log, _middle(log))).select("revision", "key", "op", "value")


@query("delta_prefix_from_cursor", _LOG + f"SELECT revision, key, op, value FROM log WHERE revision > {_MIDDLE} AND starts_with(key, 'user.00')")
def delta_prefix_from_cursor(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return _text(ops.delta(log, _middle(log), Scope.prefix("user.00"))).select("revision", "key", "op", "value")


@query("state_sync_list", _LOG + "SELECT revision, key, op, value FROM last")
def state_sync_list(spark, sf_dir):
    return _text(ops.state_sync(events_log(spark, sf_dir))).select("revision", "key", "op", "value")


@query(
    "fold_as_of",
    _LOG + f"SELECT key, value, revision FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC) AS k FROM log WHERE revision <= {_MIDDLE}) WHERE k = 1 AND op = 'PUT'",
)
def fold_as_of(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return _text(ops.as_of(log, _middle(log)))


_STALE = _LOG + (
    f", held AS (SELECT key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC) AS k FROM log WHERE revision <= {_MIDDLE}) WHERE k = 1 AND op = 'PUT'), "
    "stale AS (SELECT key FROM held WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.key = held.key AND op = 'PUT' AND length(value) > 0)) "
)


def _stale(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = events_log(spark, sf_dir)
    held = ops.as_of(log, _middle(log))
    return log, held, ops.stale_keys(held, ops.live_keys(log))


@query("stale_keys", _STALE + "SELECT key FROM stale")
def stale_keys(spark, sf_dir):
    return _stale(spark, sf_dir)[2]


@query("synthetic_deletes", _STALE + "SELECT CAST(NULL AS BIGINT) AS revision, key, 'DEL' AS op, CAST(NULL AS VARCHAR) AS value FROM stale")
def synthetic_deletes(spark, sf_dir):
    return _text(ops.synthetic_deletes(_stale(spark, sf_dir)[2]))


@query("resync_converged_fold", ORACLES["fold_latest"])
def resync_converged_fold(spark, sf_dir):
    """A fold at half of the log, resynced and listed again, equals the fold of all."""
    log, held, stale = _stale(spark, sf_dir)
    repaired = ops.merge(held, ops.synthetic_deletes(stale).withColumn("arrival", F.lit(0).cast("long")))
    return _text(ops.merge(repaired, ops.latest(log))).select("key", "value", "revision")


@query("merge_delta_into_fold", ORACLES["fold_latest"])
def merge_delta_into_fold(spark, sf_dir):
    log = events_log(spark, sf_dir)
    middle = _middle(log)
    return _text(ops.merge(ops.as_of(log, middle), log.where(F.col("revision") > middle))).select("key", "value", "revision")


@query("history_n", _LOG + "SELECT key, revision, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC) AS k FROM log) WHERE k <= 3")
def history_n(spark, sf_dir):
    return _text(ops.history(events_log(spark, sf_dir), 3)).select("key", "revision", "op", "value")


@query("first_sequence_h1", _LOG + "SELECT min(revision) AS first_sequence FROM last")
def first_sequence_h1(spark, sf_dir):
    return ops.first_sequence(ops.latest(events_log(spark, sf_dir)))


@query("revision_gaps", _LOG + "SELECT revision, previous FROM (SELECT revision, lag(revision) OVER (ORDER BY revision) AS previous FROM last) WHERE revision > previous + 1")
def revision_gaps(spark, sf_dir):
    return ops.revision_gaps(ops.latest(events_log(spark, sf_dir)), width=1 << 12)


def _subjects(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    n = F.col("event_id").cast("string")
    end = F.concat(F.lit(".1."), n, F.lit(".7.1700000000000000000.0"))
    subject = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("$JS.ACK.KV_b.cons"), end)).when(F.col("event_id") % 5 == 1, F.concat(F.lit("$JS.ACK.hub.AB.KV_b.cons"), end))
    subject = subject.when(F.col("event_id") % 5 == 2, F.concat(F.lit("$JS.ACK.hub.AB.KV_b.cons"), end, F.lit(".rng"))).when(F.col("event_id") % 5 == 3, F.concat(F.lit("$JS.ACK.few."), n))
    return e.select("event_id", subject.otherwise(F.lit("$JS.ACK.s.c.1.notnum.7.0.0")).alias("reply"))


@query("ack_sequence", "SELECT event_id, CASE WHEN event_id % 5 <= 2 THEN event_id END AS revision FROM events")
def ack_sequence(spark, sf_dir):
    return _subjects(spark, sf_dir).select("event_id", C.ack_sequence(F.col("reply")).alias("revision"))


@query(
    "decode_message",
    "SELECT event_id, 'user.' || CAST(user_id AS VARCHAR) AS key, CASE event_type WHEN 'error' THEN 'DEL' WHEN 'signup' THEN 'PURGE' ELSE 'PUT' END AS op, "
    "CASE WHEN event_id % 5 <= 2 THEN event_id END AS revision FROM events WHERE event_id % 11 <> 0",
)
def decode_message(spark, sf_dir):
    """Messages with subject, header and reply; those outside the keyspace are no changes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    space = F.when(F.col("event_id") % 11 == 0, F.lit("$KV.other.")).otherwise(F.lit("$KV.b."))
    header = F.when(F.col("event_type") == "error", F.lit("DEL")).when(F.col("event_type") == "signup", F.lit("PURGE"))
    m = e.join(_subjects(spark, sf_dir), "event_id").select("event_id", F.concat(space, F.lit("user."), F.col("user_id").cast("string")).alias("subject"), header.alias("header"), "reply")
    out = m.select("event_id", C.strip_keyspace(F.col("subject"), "$KV.b.").alias("key"), C.op_of_header(F.col("header")).alias("op"), C.ack_sequence(F.col("reply")).alias("revision"))
    return out.where(F.col("key").isNotNull())


@query("batch_cursor", _LOG + "SELECT CAST((revision - 1) // 100 AS BIGINT) AS batch, count(*) AS received, max(revision) AS cursor FROM log GROUP BY 1")
def batch_cursor(spark, sf_dir):
    return ops.batch_cursors(events_log(spark, sf_dir), 100)


@query(
    "parse_filtered_apply",
    _LOG + "SELECT CAST((revision - 1) // 100 AS BIGINT) AS batch, count(*) AS received, count(*) FILTER (op = 'PUT' AND length(value) > 0) AS applied, max(revision) AS cursor FROM log GROUP BY 1",
)
def parse_filtered_apply(spark, sf_dir):
    """What parsing drops still counts as received and moves the cursor."""
    log = events_log(spark, sf_dir)
    applied = F.count(F.when(C.is_live(), 1)).alias("applied")
    return log.groupBy(F.floor((F.col("arrival") - 1) / 100).alias("batch")).agg(F.count(F.lit(1)).alias("received"), applied, F.max("revision").alias("cursor"))


@query("redundancy_check", _LOG + "SELECT CAST(count(*) AS BIGINT) AS n_records, count(DISTINCT key) AS n_keys, count(*) > count(DISTINCT key) OR bool_or(op <> 'PUT') AS redundant FROM log")
def redundancy_check(spark, sf_dir):
    return ops.redundancy(events_log(spark, sf_dir))


_BATCHES = "b AS (SELECT CAST((revision - 1) // 100 AS BIGINT) AS batch, max(revision) AS rank FROM log GROUP BY 1)"


@query(
    "prune_candidates",
    _LOG + f", {_BATCHES}, p AS (SELECT max(rank) AS pointer FROM b WHERE batch % 3 = 0) SELECT batch, rank, rank < pointer AND batch % 4 <> 1 AS prunable FROM b, p",
)
def prune_candidates(spark, sf_dir):
    """A payload a batch; the pointer names the last of every third; every fourth is too young."""
    b = ops.batch_cursors(events_log(spark, sf_dir), 100).select("batch", F.col("cursor").alias("rank"))
    pointer = b.where(F.col("batch") % 3 == 0).agg(F.max("rank").alias("pointer"))
    joined = b.join(F.broadcast(pointer))  # one row
    return joined.select("batch", "rank", C.prunable(F.col("rank"), F.col("pointer"), F.col("rank") == F.col("pointer"), F.col("batch") % 4 != 1).alias("prunable"))


@query(
    "publish_verdicts",
    _LOG + f", {_BATCHES} SELECT batch, rank, prior, prior IS NULL OR rank >= prior AS allowed FROM (SELECT batch, rank, CASE WHEN batch % 7 = 0 THEN NULL ELSE rank + (batch % 3 - 1) * 50 END AS prior FROM b)",
)
def publish_verdicts(spark, sf_dir):
    b = ops.batch_cursors(events_log(spark, sf_dir), 100).select("batch", F.col("cursor").alias("rank"))
    prior = F.when(F.col("batch") % 7 != 0, F.col("rank") + (F.col("batch") % 3 - 1) * 50)
    return b.select("batch", "rank", prior.alias("prior"), C.publish_ok(prior, F.col("rank")).alias("allowed"))


@query(
    "lease_state",
    "SELECT user_id, CASE WHEN event_id % 6 = 0 THEN 'takeover' WHEN event_id + 500 > 5000 THEN 'held' ELSE 'takeover' END AS verdict, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id + 500 END AS expires_at_unix "
    "FROM (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id)",
)
def lease_state(spark, sf_dir):
    """Lease records as JSON, some unreadable; at time 5000, which are held and which may be taken over."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    record = F.to_json(F.struct(F.col("user_id").cast("string").alias("holder_id"), F.col("event_id").alias("acquired_at_unix"), (F.col("event_id") + 500).alias("expires_at_unix")))
    raw = F.when(F.col("event_id") % 6 == 0, F.lit("{not json")).otherwise(record)
    parsed = e.select("user_id", F.from_json(raw, LEASE).alias("r")).select("user_id", F.col("r.expires_at_unix").alias("expires_at_unix"))
    return parsed.select("user_id", F.when(F.coalesce(F.col("expires_at_unix") > 5000, F.lit(False)), "held").otherwise("takeover").alias("verdict"), "expires_at_unix")


@query("cursor_hex", _LOG + "SELECT revision, lpad(lower(to_hex(revision)), 16, '0') AS cursor_hex, revision AS back FROM log")
def cursor_hex(spark, sf_dir):
    log = events_log(spark, sf_dir)
    hexed = C.hex16(F.col("revision"))
    return log.select("revision", hexed.alias("cursor_hex"), C.version_revision(C.version_bytes(C.from_hex16(hexed))).alias("back"))


@query("record_log_roundtrip", ORACLES["fold_orders"])
def record_log_roundtrip(spark, sf_dir):
    """The fold written as one record-log file, and the fold of what the distributed reader finds in it."""
    from ledgerfold.kernels import token
    from ledgerfold.sources.record_log import read_record_logs, write_record_log

    at = f"{_shared(spark)}/fold.log"
    write_record_log(spark, ops.fold(orders_log(spark, sf_dir)).withColumn("version", C.version_bytes(F.col("revision"))), token(7), at)
    return _text(ops.fold(read_record_logs(spark, at).where(F.col("op").isNotNull()))).select("key", "value", "revision")


@query("store_apply_batches", ORACLES["fold_latest"])
def store_apply_batches(spark, sf_dir):
    """Four batches into a store, compacted after the second."""
    log, store = events_log(spark, sf_dir), FoldStore(spark, f"{_shared(spark)}/fold", buckets=8)
    top = log.agg(F.max("revision")).first()[0]
    for k in range(4):
        low, high = top * k // 4, top * (k + 1) // 4
        store.apply(log.where((F.col("revision") > low) & (F.col("revision") <= high)), high)
        if k == 1:
            store.compact()
    return _text(store.rows()).select("key", "value", "revision")


@query("stream_fold", ORACLES["fold_latest"])
def stream_fold(spark, sf_dir):
    """A bucket filled in bulk, watched from revision 0 in micro-batches, its fold at the end."""
    from ledgerfold.sources.log import Bucket, BucketConfig
    from ledgerfold.streaming.applied import AppliedLoop, BatchConfig, watch_applied

    at = _shared(spark)
    bucket = Bucket(spark, f"{at}/bucket", BucketConfig(max_bytes=None))
    log = events_log(spark, sf_dir)
    half = _middle(log)
    bucket.append(log.where(F.col("revision") <= half))
    loop = AppliedLoop(spark, store=FoldStore(spark, f"{at}/fold", buckets=8))
    size = BatchConfig(max_revisions=max(1000, half // 2))
    watch_applied(bucket, loop, f"{at}/checkpoint", config=size)
    bucket.append(log.where(F.col("revision") > half))
    watch_applied(bucket, loop, f"{at}/checkpoint", config=size)
    return _text(loop.store.rows()).select("key", "value", "revision")


@query("export_import_roundtrip", ORACLES["fold_latest"])
def export_import_roundtrip(spark, sf_dir):
    at = _shared(spark).removeprefix("file://")
    store = FoldStore(spark, f"{at}/fold", buckets=8)
    log = events_log(spark, sf_dir)
    store.apply(log, log.agg(F.max("revision")).first()[0])
    artifact.export(store, f"{at}/artifact")
    return _text(artifact.import_(spark, f"{at}/artifact", f"{at}/installed").rows()).select("key", "value", "revision")


__all__ = ["ORACLES", "QUERIES"]

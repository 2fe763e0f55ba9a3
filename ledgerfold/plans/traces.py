"""Queries over what the engine does: scripted writes, retention, watches, publishing and leases, each with the SQL of its outcome.

A script's single writes run over the rows of `nation`, which has the same rows
at every scale; logs of events are appended and folded whole.
"""

from __future__ import annotations

import itertools
import os
import queue as queues

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.engine import Engine
from ledgerfold.errors import ArtifactInvalid, BackendError, KvError
from ledgerfold.extension import KvWatcher
from ledgerfold.functions import columns as C
from ledgerfold.functions.scope import Scope
from ledgerfold.kernels import token, token_revision
from ledgerfold.operators import fold as ops
from ledgerfold.plans.queries import _KEYS, _LOG, _MIDDLE, _middle, _text
from ledgerfold.plans.registry import ORACLES, query, run_folder
from ledgerfold.sources import artifact, record_log
from ledgerfold.sources.changelogs import events_log, orders_log
from ledgerfold.sources.lease import Lease
from ledgerfold.sources.log import Bucket, BucketConfig
from ledgerfold.sources.schema import PUT
from ledgerfold.sources.store import FoldStore
from ledgerfold.sources.transport import Transport, import_remote, run_export_round
from ledgerfold.streaming.applied import AppliedLoop, BatchConfig, ExportRequest, watch_applied

_TOP = "(SELECT max(revision) FROM log)"


def _local(spark: SparkSession) -> str:
    return run_folder(spark).removeprefix("file://")


def _log_bucket(spark: SparkSession, sf_dir: str, **config) -> Bucket:
    """A bucket that holds the events log, appended in bulk."""
    b = Bucket(spark, f"{run_folder(spark)}/bucket", BucketConfig(**{"max_bytes": None, "max_history": 1 << 40, **config}))
    b.append(events_log(spark, sf_dir))
    return b


def _quarters(log: DataFrame) -> list[tuple[int, int]]:
    """(after, up to) of the log's four quarters."""
    top = log.agg(F.max("revision")).first()[0] or 0
    return [(top * k // 4, top * (k + 1) // 4) for k in range(4)]


def _part(log: DataFrame, low: int, high: int) -> DataFrame:
    return log.where((F.col("revision") > low) & (F.col("revision") <= high))


# --- single writes: put all; delete, update, delete by version or purge some; create all; update all with the first version; put with a time to live

_NATIONS = """WITH n AS (SELECT n_nationkey AS k, n_name AS name, 'nation.' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS key, row_number() OVER (ORDER BY n_nationkey) AS r, n_nationkey % 5 AS m FROM nation),
c AS (SELECT count(*) AS a, count(*) FILTER (m <> 4) AS b, count(*) FILTER (m IN (0, 3)) AS c FROM n),
w AS (SELECT r AS revision, k, m, key, 'PUT' AS op, name AS value FROM n
UNION ALL SELECT a + row_number() OVER (ORDER BY k), k, m, key, CASE m WHEN 0 THEN 'DEL' WHEN 3 THEN 'PURGE' ELSE 'PUT' END, CASE m WHEN 1 THEN lower(name) WHEN 2 THEN '' END FROM n, c WHERE m <> 4
UNION ALL SELECT a + b + row_number() OVER (ORDER BY k), k, m, key, 'PUT', 'new' FROM n, c WHERE m IN (0, 3)
UNION ALL SELECT a + b + c + row_number() OVER (ORDER BY k), k, m, key, 'PUT', 'stale' FROM n, c WHERE m = 4),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC) AS rn FROM w) WHERE rn = 1)
"""


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows at every scale


def _key(k: int) -> str:
    return f"nation.{k:02d}"


def _attempt(act) -> str:
    try:
        act()
        return "ok"
    except KvError as e:
        return type(e).__name__


def _written(spark: SparkSession, sf_dir: str) -> tuple[Bucket, list[tuple]]:
    """The bucket after the script, and the outcome of every write."""
    b = Bucket(spark, f"{run_folder(spark)}/bucket", BucketConfig(max_history=64))
    rows, first, outcomes = _nations(spark, sf_dir), {}, []
    for r in rows:
        first[r.n_nationkey] = b.put(_key(r.n_nationkey), r.n_name.encode())
        outcomes.append((r.n_nationkey, "put", "ok"))
    for r in rows:
        k, name = r.n_nationkey, _key(r.n_nationkey)
        change = [lambda: b.delete(name), lambda: b.update(name, r.n_name.lower().encode(), token(first[k])), lambda: b.delete_with_version(name, first[k]), lambda: b.purge(name)]  # noqa: B023
        if k % 5 < 4:
            outcomes.append((k, "change", _attempt(change[k % 5])))
    steps = {"create": lambda k: b.create(_key(k), b"new"), "update": lambda k: b.update(_key(k), b"stale", first[k]), "ttl": lambda k: b.put_with_ttl(_key(k), b"x", 5)}
    for step, act in steps.items():
        outcomes += [(r.n_nationkey, step, _attempt(lambda: act(r.n_nationkey))) for r in rows]  # noqa: B023
    return b, outcomes


@query("write_log", _NATIONS + "SELECT revision, key, op, value FROM w")
def write_log(spark, sf_dir):
    return _text(_written(spark, sf_dir)[0].changes()).select("revision", "key", "op", "value")


@query(
    "write_outcomes",
    _NATIONS + "SELECT k, 'put' AS step, 'ok' AS outcome FROM n UNION ALL SELECT k, 'change', 'ok' FROM n WHERE m <> 4 "
    "UNION ALL SELECT k, 'create', CASE WHEN m IN (0, 3) THEN 'ok' ELSE 'AlreadyExists' END FROM n "
    "UNION ALL SELECT k, 'update', CASE WHEN m = 4 THEN 'ok' ELSE 'RevisionMismatch' END FROM n UNION ALL SELECT k, 'ttl', 'OperationFailed' FROM n",
)
def write_outcomes(spark, sf_dir):
    return spark.createDataFrame(_written(spark, sf_dir)[1], "k bigint, step string, outcome string")


@query("bucket_reads", _NATIONS + "SELECT k, nullif(value, '') AS got, value AS entry, revision FROM last")
def bucket_reads(spark, sf_dir):
    """get hides an empty value, entry shows it; the script leaves every key with a put."""
    b, _ = _written(spark, sf_dir)
    rows = []
    for r in _nations(spark, sf_dir):
        got, entry = b.get(_key(r.n_nationkey)), b.entry(_key(r.n_nationkey))
        rows.append((r.n_nationkey, got.value.decode() if got else None, entry.value.decode(), entry.revision))
    return spark.createDataFrame(rows, "k bigint, got string, entry string, revision bigint")


@query("bucket_scan_keys", _NATIONS + "SELECT key, value, revision, true AS listed FROM last WHERE length(value) > 0")
def bucket_scan_keys(spark, sf_dir):
    """scan and keys of the same bucket, sealed half-way, joined."""
    b, _ = _written(spark, sf_dir)
    b.seal()
    return _text(b.scan("nation.")).join(b.keys("nation.").withColumn("listed", F.lit(True)), "key", "left").select("key", "value", "revision", "listed")


@query("bucket_reopen", "SELECT CAST(3 AS BIGINT) AS max_history, count(*) AS n, max(n_nationkey) + 1 AS head FROM nation")
def bucket_reopen(spark, sf_dir):
    """Get or create: a bucket that exists keeps its own configuration and its log."""
    at = f"{run_folder(spark)}/bucket"
    first = Bucket(spark, at, BucketConfig(max_history=3))
    for r in _nations(spark, sf_dir):
        first.put(_key(r.n_nationkey), b"x")
    again = Bucket(spark, at, BucketConfig(max_history=9))
    return again.keys().agg(F.lit(again.config.max_history).cast("long").alias("max_history"), F.count(F.lit(1)).alias("n"), F.lit(again.head()).cast("long").alias("head"))


@query("engine_lifecycle", "SELECT * FROM (VALUES ('new', false, 'NotConnected'), ('opened', true, 'ok'), ('opened again', true, 'ok'), ('closed', false, 'NotConnected'), ('closed again', false, 'NotConnected'), ('reopened', true, 'ok')) AS t(step, healthy, store)")
def engine_lifecycle(spark, sf_dir):
    engine, rows = Engine(run_folder(spark), spark), []
    for step in ("new", "opened", "opened again", "closed", "closed again", "reopened"):
        if "open" in step:
            engine.open()
        elif "closed" in step:
            engine.close()
        rows.append((step, engine.is_healthy(), _attempt(lambda: engine.store("b"))))
    return spark.createDataFrame(rows, "step string, healthy boolean, store string")


# --- retention and limits

_KEPT = _LOG + ", purged AS (SELECT key, max(revision) AS purged FROM log WHERE op = 'PURGE' GROUP BY key), unpurged AS (SELECT log.* FROM log LEFT JOIN purged USING (key) WHERE purged IS NULL OR revision >= purged) "


def _retained(b: Bucket) -> DataFrame:
    floor = b.apply_retention()
    return b.changes().select("revision", "key", "op", F.lit(floor).cast("long").alias("first_sequence"))


@query("retention_history", _KEPT + "SELECT revision, key, op, min(revision) OVER () AS first_sequence FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC) AS k FROM unpurged) WHERE k <= 2")
def retention_history(spark, sf_dir):
    return _retained(_log_bucket(spark, sf_dir, max_history=2))


@query(
    "retention_bytes",
    _KEPT + "SELECT revision, key, op, min(revision) OVER () AS first_sequence FROM (SELECT *, sum(octet_length(encode(key)) + octet_length(encode(coalesce(value, '')))) OVER (ORDER BY revision DESC) AS bytes FROM unpurged) WHERE bytes <= 20000",
)
def retention_bytes(spark, sf_dir):
    """Discarding old: the newest changes that fit the limit."""
    return _retained(_log_bucket(spark, sf_dir, max_bytes=20_000, discard="old"))


@query("retention_age", _KEPT + f"SELECT revision, key, op, min(revision) OVER () AS first_sequence FROM unpurged WHERE revision > {_MIDDLE}")
def retention_age(spark, sf_dir):
    now, log = [1000], events_log(spark, sf_dir)
    b = Bucket(spark, f"{run_folder(spark)}/bucket", BucketConfig(max_bytes=None, max_history=1 << 40, max_age_s=500), clock=lambda: now[0])
    middle = _middle(log)
    b.append(log.where(F.col("revision") <= middle))
    now[0] = 2000
    b.append(log.where(F.col("revision") > middle))
    now[0] = 2100
    return _retained(b)


@query("discard_new", "SELECT n_nationkey AS k, CASE WHEN row_number() OVER (ORDER BY n_nationkey) <= 10 THEN 'ok' ELSE 'OperationFailed' END AS outcome FROM nation")
def discard_new(spark, sf_dir):
    """A full bucket that discards new changes refuses them: ten changes of ten bytes fit."""
    b = Bucket(spark, f"{run_folder(spark)}/bucket", BucketConfig(max_bytes=100))
    return spark.createDataFrame([(r.n_nationkey, _attempt(lambda: b.put(f"k{r.n_nationkey:02d}", b"seven c"))) for r in _nations(spark, sf_dir)], "k bigint, outcome string")  # noqa: B023


# --- watches


@query("watch_prefix_state", _LOG + "SELECT revision, key, op, value FROM last WHERE starts_with(key, 'user.01')")
def watch_prefix_state(spark, sf_dir):
    return _text(_log_bucket(spark, sf_dir).watch(Scope.prefix("user.01"))).select("revision", "key", "op", "value")


@query("watch_prefixes_from", _LOG + f"SELECT revision, key, op, value FROM log WHERE revision > {_MIDDLE} AND (starts_with(key, 'user.000') OR starts_with(key, 'user.002'))")
def watch_prefixes_from(spark, sf_dir):
    b = _log_bucket(spark, sf_dir)
    return _text(b.watch_from(b.head() // 2, Scope.of(["user.000", "user.002"]))).select("revision", "key", "op", "value")


class _StateOnly(KvWatcher):
    """A watcher that knows no cursors."""

    def __init__(self, bucket: Bucket):
        self.bucket = bucket

    def watch(self, scope: Scope) -> DataFrame:
        return self.bucket.watch(scope)


@query("watch_default", ORACLES["fold_latest"])
def watch_default(spark, sf_dir):
    """A watcher that ignores the cursor gives a superset, which folds to the same."""
    log = events_log(spark, sf_dir)
    held = ops.as_of(log, _middle(log))
    return _text(ops.merge(held, _StateOnly(_log_bucket(spark, sf_dir)).watch_from(_middle(log), Scope.all()))).select("key", "value", "revision")


@query("resume_verdicts_all", _LOG + "SELECT revision AS cursor, (SELECT min(revision) FROM last) <= revision + 1 AS resumable FROM log")
def resume_verdicts_all(spark, sf_dir):
    """Which cursors may resume, for every revision of the log."""
    log = events_log(spark, sf_dir)
    first = ops.first_sequence(ops.latest(log))
    return log.select(F.col("revision").alias("cursor")).join(F.broadcast(first)).select("cursor", C.resume_ok(F.col("cursor"), F.col("first_sequence")).alias("resumable"))  # one row


@query("floor_guard_verdicts", _LOG + f"SELECT revision, previous, NOT ({_MIDDLE} + 1 <= previous + 1) AS loss FROM (SELECT revision, lag(revision) OVER (ORDER BY revision) AS previous FROM last) WHERE revision > previous + 1")
def floor_guard_verdicts(spark, sf_dir):
    """Every jump in the delivered revisions: a loss if retention, at the middle of the log, has passed the frontier."""
    log = events_log(spark, sf_dir)
    gaps = ops.revision_gaps(ops.latest(log))
    return gaps.select("revision", "previous", C.gap_loss(F.col("previous"), F.col("revision"), F.lit(_middle(log) + 1)).alias("loss"))


@query("applied_cursors", _LOG + f"SELECT n, cursor, cursor AS published, (SELECT count(*) FROM log WHERE revision > low AND revision <= cursor AND op = 'PUT') AS applied FROM (SELECT k + 1 AS n, {_TOP} * k // 4 AS low, {_TOP} * (k + 1) // 4 AS cursor FROM (SELECT unnest(range(0, 4)) AS k))")
def applied_cursors(spark, sf_dir):
    """What a loop tells after each batch: the cursor, already in the store, and the rows that parsing left."""
    log, store = events_log(spark, sf_dir), FoldStore(spark, f"{run_folder(spark)}/fold", buckets=8)
    told, applied = [], []
    loop = AppliedLoop(spark, store=store, parse=lambda rows: rows.where(C.is_put()), apply=lambda rows, _: applied.append(rows.count()), on_applied=lambda c: told.append((c, store.reader().cursor)))
    for low, high in _quarters(log):
        loop.batch(_part(log, low, high))
    return spark.createDataFrame([(n + 1, c, p, a) for n, ((c, p), a) in enumerate(zip(told, applied))], "n bigint, cursor bigint, published bigint, applied bigint")


@query("store_failure_retries", ORACLES["fold_latest"])
def store_failure_retries(spark, sf_dir):
    """A store that fails twice before each batch is stored, with our error and with another; the fold is whole."""
    log, store, calls = events_log(spark, sf_dir), FoldStore(spark, f"{run_folder(spark)}/fold", buckets=8), itertools.count()
    real = store.apply

    def flaky(rows, cursor):
        n = next(calls) % 3
        if n < 2:
            raise (BackendError, OSError)[n]("transient")
        real(rows, cursor)

    store.apply = flaky
    loop = AppliedLoop(spark, store=store)
    for low, high in _quarters(log)[::2]:
        loop.batch(_part(log, low, high + (high - low) + 4))
    return _text(store.rows()).select("key", "value", "revision")


@query("expired_cursor_resync", ORACLES["live_scan"].replace(" AND length(value) > 0", ""))
def expired_cursor_resync(spark, sf_dir):
    """A fold of the log's first quarter, whose cursor retention has passed: resync, listing, and the fold of the whole log."""
    at, log = run_folder(spark), events_log(spark, sf_dir)
    b = Bucket(spark, f"{at}/bucket", BucketConfig(max_bytes=None))
    store = FoldStore(spark, f"{at}/fold", buckets=8)
    low, high = _quarters(log)[0]
    store.apply(_part(log, low, high), high)
    b.append(log)
    b.apply_retention()
    b._advance(b._state(), first_sequence=high + 2)
    loop = AppliedLoop(spark, store=store)
    watch_applied(b, loop, f"{at}/checkpoint", config=BatchConfig(max_revisions=1 << 40))
    return _text(loop.store.rows()).select("key", "value", "revision")


@query("live_export", ORACLES["fold_as_of"])
def live_export(spark, sf_dir):
    """An export asked for during a watch holds the fold after the batch at hand."""
    at, log, asked = _local(spark), events_log(spark, sf_dir), queues.Queue()
    loop = AppliedLoop(spark, store=FoldStore(spark, f"{at}/fold", buckets=8), exports=asked)
    request, middle = ExportRequest(f"{at}/artifact"), _middle(log)
    asked.put(request)
    loop.batch(log.where(F.col("revision") <= middle))
    loop.batch(log.where(F.col("revision") > middle))
    assert request.result.get(timeout=1).cursor == middle
    return _text(artifact.import_(spark, request.dest, f"{at}/installed").rows()).select("key", "value", "revision")


@query("shutdown_fold", ORACLES["fold_as_of"])
def shutdown_fold(spark, sf_dir):
    """A loop that shuts down after half of the log keeps what it applied, answers queued exports and drops the rest."""
    at, log, asked = _local(spark), events_log(spark, sf_dir), queues.Queue()
    loop, middle = AppliedLoop(spark, store=FoldStore(spark, f"{at}/fold", buckets=8), exports=asked), _middle(log)
    loop.batch(log.where(F.col("revision") <= middle))
    request = ExportRequest(f"{at}/artifact")
    asked.put(request)
    loop.shutdown()
    loop.batch(log.where(F.col("revision") > middle))
    assert request.result.get(timeout=1).cursor == loop.store.cursor == middle
    return _text(loop.store.rows()).select("key", "value", "revision")


_MESSAGES = ["consumer Start Sequence is below the FIRST sequence", "Sequence Not Found", "deliver policy too old", "stream is offline", "first  sequence", None]


@query("expiry_messages", "SELECT event_id, event_id % 6 <= 2 AS expired FROM events WHERE event_id % 6 <> 5 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 6 = 5")
def expiry_messages(spark, sf_dir):
    """Which messages of a remote log mean that the cursor has expired."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return e.select("event_id", C.is_expiry(F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % 6 + 1).cast("int"))).alias("expired"))


# --- stores


def _store(spark: SparkSession, sf_dir: str) -> FoldStore:
    """The events log in a store, in four batches."""
    log, store = events_log(spark, sf_dir), FoldStore(spark, f"{run_folder(spark)}/fold", buckets=8)
    for low, high in _quarters(log):
        store.apply(_part(log, low, high), high)
    return store


@query("store_gets", _LOG + f"SELECT DISTINCT key, value, revision FROM last WHERE op = 'PUT' AND key IN ({', '.join(repr(k) for k in _KEYS)})")
def store_gets(spark, sf_dir):
    """Point reads of a fold that isn't compacted."""
    store = _store(spark, sf_dir)
    found = [store.get(k) for k in dict.fromkeys(_KEYS)]
    return spark.createDataFrame([(r["key"], bytes(r["value"]).decode(), r["revision"]) for r in found if r], "key string, value string, revision bigint")


@query("store_visit", _LOG + "SELECT CAST(row_number() OVER (ORDER BY key) AS BIGINT) AS n, key, revision FROM last WHERE op = 'PUT' AND starts_with(key, 'user.00') ORDER BY key LIMIT 40")
def store_visit(spark, sf_dir):
    """Entries under a prefix in key order, until the visitor stops after the fortieth."""
    store, seen = _store(spark, sf_dir), []

    def visit(row):
        seen.append((len(seen) + 1, row["key"], row["revision"]))
        if len(seen) == 40:
            raise StopIteration

    try:
        store.for_each_in_range("user.00", visit)
    except StopIteration:
        pass
    return spark.createDataFrame(seen, "n bigint, key string, revision bigint")


@query("store_cursors", _LOG + f"SELECT k + 1 AS n, nullif({_TOP} * k // 4, 0) AS reader, {_TOP} * (k + 1) // 4 AS refreshed, {_TOP} * (k + 1) // 4 AS reopened FROM (SELECT unnest(range(0, 4)) AS k)")
def store_cursors(spark, sf_dir):
    """A reader stays on its version until it is refreshed; a store that is opened resumes from the last publish."""
    log, at, rows = events_log(spark, sf_dir), f"{run_folder(spark)}/fold", []
    for n, (low, high) in enumerate(_quarters(log)):
        _, store = FoldStore.open(spark, at, buckets=8)
        reader = store.reader()
        store.apply(_part(log, low, high), high)
        held = reader.cursor
        rows.append((n + 1, held, reader.refresh().cursor, FoldStore.open(spark, at)[0]))
    return spark.createDataFrame(rows, "n bigint, reader bigint, refreshed bigint, reopened bigint")


# --- record logs


@query("record_logs_bucketed", ORACLES["fold_orders"])
def record_logs_bucketed(spark, sf_dir):
    """The fold as record logs that the executors write, one a bucket, and the fold of what the reader finds in them."""
    at = f"{run_folder(spark)}/logs"
    held = ops.fold(orders_log(spark, sf_dir)).withColumn("version", C.version_bytes(F.col("revision")))
    written = record_log.write_record_logs(held, token(7), at, files=8).agg(F.sum("records")).first()[0]
    rows = record_log.read_record_logs(spark, at)
    assert written == rows.where(F.col("op") == PUT).count()
    return _text(ops.fold(rows.where(F.col("op").isNotNull()))).select("key", "value", "revision")


@query(
    "record_log_writer",
    "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 1 THEN lower(n_name) ELSE n_name END AS value, n_nationkey + 1 AS revision, CAST(99 AS BIGINT) AS cursor, false AS compact_before, true AS compact_after FROM nation WHERE n_nationkey % 3 <> 0",
)
def record_log_writer(spark, sf_dir):
    """A log written record by record, with updates, deletes and two cursors, then compacted: what a replay finds before and after."""
    at = f"{_local(spark)}/writer.log"
    os.makedirs(os.path.dirname(at), exist_ok=True)
    writer, rows = record_log.RecordLogWriter(at, compact_bytes=100), _nations(spark, sf_dir)
    for r in rows:
        writer.write(PUT, _key(r.n_nationkey), r.n_name.encode(), token(r.n_nationkey + 1))
    writer.checkpoint(token(7))
    for r in rows:
        if r.n_nationkey % 3 == 0:
            writer.write("DEL", _key(r.n_nationkey))
        elif r.n_nationkey % 3 == 1:
            writer.write(PUT, _key(r.n_nationkey), r.n_name.lower().encode(), token(r.n_nationkey + 1))
    due = writer.checkpoint(token(99))
    with open(at, "rb") as f:
        before = record_log.replay(f.read())
    if due:
        writer.compact()
    writer.close()
    after = record_log.load(at)
    assert before.entries == after.entries and before.cursor == after.cursor
    return spark.createDataFrame([(int(k[-2:]), v.decode(), token_revision(t), after.cursor, before.compact, after.compact) for k, (v, t) in after.entries.items()], "k bigint, value string, revision bigint, cursor bigint, compact_before boolean, compact_after boolean")


# --- artifacts, publishing, leases


def _small(spark: SparkSession, at: str, cursor: int) -> FoldStore:
    store = FoldStore(spark, f"{at}/fold-{cursor}", buckets=2)
    rows = [(cursor, f"k{n}", PUT, f"v{cursor}".encode(), token(cursor), cursor) for n in range(3)]
    store.apply(spark.createDataFrame(rows, "revision long, key string, op string, value binary, version binary, arrival long"), cursor)
    return store


@query(
    "artifact_verdicts",
    "SELECT * FROM (VALUES ('whole', 'ok'), ('changed', 'ArtifactInvalid'), ('missing', 'ArtifactInvalid'), ('extra', 'ArtifactInvalid'), ('other generation', 'ArtifactInvalid'), ('other generation, allowed', 'ok'), ('destination taken', 'ArtifactInvalid')) AS t(step, outcome)",
)
def artifact_verdicts(spark, sf_dir):
    """What importing says to an artifact that was tampered with, to one of another generation, and to a folder in use."""
    at, rows = _local(spark), []
    store = _small(spark, at, 5)
    for n, step in enumerate(("whole", "changed", "missing", "extra", "other generation", "other generation, allowed", "destination taken")):
        folder, dest = f"{at}/artifact-{n}", f"{at}/installed-{n}"
        m = artifact.export(store, folder)
        victim = f"{folder}/{next(f['path'] for f in m.files if 'part' in f['path'])}"
        rule = artifact.same_generation
        if step == "changed":
            with open(victim, "r+b") as f:
                f.seek(os.path.getsize(victim) // 2)
                old = f.read(1)
                f.seek(-1, os.SEEK_CUR)
                f.write(bytes([old[0] ^ 1]))
        elif step == "missing":
            os.unlink(victim)
        elif step == "extra":
            with open(f"{folder}/data/extra", "w") as f:
                f.write("x")
        elif "generation" in step:
            with open(f"{folder}/{artifact.MANIFEST}") as f:
                text = f.read().replace('"backend_version": "1"', '"backend_version": "0"')
            with open(f"{folder}/{artifact.MANIFEST}", "w") as f:
                f.write(text)
            rule = (lambda version: None) if "allowed" in step else rule
        elif step == "destination taken":
            os.makedirs(f"{dest}/here")
        try:
            outcome = "ok" if artifact.import_(spark, folder, dest, rule).cursor == 5 else "wrong cursor"
        except ArtifactInvalid as e:
            outcome = type(e).__name__
        rows.append((step, outcome))
    return spark.createDataFrame(rows, "step string, outcome string")


@query(
    "publish_trace",
    "SELECT * FROM (VALUES (1, 5, 'published', 5, 1), (2, 3, 'superseded', 5, 2), (3, 7, 'published', 7, 3), (4, 7, 'published', 7, 3), (5, -1, '0 pruned', 7, 3), (6, 0, '2 pruned', 7, 1), (7, 7, 'downloaded', 7, 1), (8, 4, 'published', 4, 2)) AS t(n, cursor, outcome, pointer, payloads)",
)
def publish_trace(spark, sf_dir):
    """Artifacts of several cursors published under one key: the pointer never goes back, pruning spares what is young or named, an unreadable pointer may be replaced."""
    at, rows = _local(spark), []
    t = Transport(f"{at}/shared", spark=spark)
    made = {}
    for c in (5, 3, 7, 4):
        artifact.export(_small(spark, at, c), f"{at}/artifact-{c}")
        made[c] = f"{at}/artifact-{c}"

    def note(cursor, outcome):
        rows.append((len(rows) + 1, cursor, outcome, t.manifest("x").cursor, len(t.files.names(t._payloads("x")))))

    for c in (5, 3, 7, 7):
        note(c, t.upload(made[c], "x"))
    note(-1, f"{t.prune('x', 3600)} pruned")
    note(0, f"{t.prune('x', 0)} pruned")
    note(t.download("x", f"{at}/downloaded").cursor, "downloaded")
    t.files.replace(t._pointer("x"), b"junk")
    note(4, t.upload(made[4], "x"))
    return spark.createDataFrame(rows, "n int, cursor int, outcome string, pointer int, payloads int")


@query(
    "export_round_trace",
    "SELECT * FROM (VALUES (1, 'one', 100, 'published', 5), (2, 'two', 110, 'no round', 5), (3, 'two', 161, 'published', 7), (4, 'one', 230, 'failed', 7), (5, 'two', 231, 'superseded', 7), (6, 'one', 400, 'published', 9)) AS t(n, holder, moment, outcome, pointer)",
)
def export_round_trace(spark, sf_dir):
    """Rounds of two nodes on one lease: one exports, one is turned away; a failed round is free at once; an old export never replaces a newer."""
    at, now, rows = _local(spark), [0], []
    b, t = Bucket(spark, f"{at}/bucket"), Transport(f"{at}/shared", spark=spark)

    def fails(folder):
        raise OSError("disk full")

    for holder, now[0], cursor in (("one", 100, 5), ("two", 110, 6), ("two", 161, 7), ("one", 230, None), ("two", 231, 3), ("one", 400, 9)):
        make = (lambda folder: artifact.export(_small(spark, at, cursor), folder)) if cursor else fails  # noqa: B023
        try:
            outcome = run_export_round(Lease(b, "round", holder, clock=lambda: now[0]), 60, make, t, "x") or "no round"
        except OSError:
            outcome = "failed"
        rows.append((len(rows) + 1, holder, now[0], outcome, t.manifest("x").cursor))
    return spark.createDataFrame(rows, "n int, holder string, moment int, outcome string, pointer int")


@query("import_remote_fold", ORACLES["fold_latest"])
def import_remote_fold(spark, sf_dir):
    """A replica made from a published artifact of half of the log, brought up to date by the rest."""
    at, log = _local(spark), events_log(spark, sf_dir)
    first, middle = FoldStore(spark, f"{at}/fold", buckets=8), _middle(log)
    first.apply(log.where(F.col("revision") <= middle), middle)
    b, t = Bucket(spark, f"{at}/bucket"), Transport(f"{at}/shared", spark=spark)
    run_export_round(Lease(b, "round", "one"), 60, lambda folder: artifact.export(first, folder), t, "x")
    store = import_remote(spark, t, "x", f"{at}/replica")
    store.apply(log.where(F.col("revision") > store.cursor), _quarters(log)[3][1])
    return _text(store.rows()).select("key", "value", "revision")


@query(
    "lease_trace",
    "SELECT * FROM (VALUES (1, 'one', 100, 'won', 'one', 160), (2, 'two', 120, 'held', 'one', 160), (3, 'one', 130, 'completed', 'one', 160), (4, 'two', 160, 'won', 'two', 220), (5, 'one', 161, 'too late', 'two', 220), (6, 'two', 170, 'abandoned', NULL, NULL), "
    "(7, 'one', 171, 'won', 'one', 231), (8, 'x', 172, 'garbled', NULL, NULL), (9, 'two', 173, 'won', 'two', 233), (10, 'two', 174, 'dropped', 'two', 233), (11, 'one', 175, 'held', 'two', 233)) AS t(n, holder, moment, outcome, holds, expires)",
)
def lease_trace(spark, sf_dir):
    """A lease through its life: won, held, completed, expired, taken over, abandoned, unreadable, dropped."""
    b, now, rows, guards = Bucket(spark, f"{run_folder(spark)}/bucket"), [0], [], {}
    lease = lambda who: Lease(b, "round", who, clock=lambda: now[0])
    script = [("one", 100, "take"), ("two", 120, "take"), ("one", 130, "complete"), ("two", 160, "take"), ("one", 161, "complete"), ("two", 170, "abandon"), ("one", 171, "take"), ("x", 172, "garble"), ("two", 173, "take"), ("two", 174, "drop"), ("one", 175, "take")]
    for who, now[0], act in script:
        if act == "take":
            guard = lease(who).try_acquire(60)
            guards[who] = guard or guards.get(who)
            outcome = "won" if guard else "held"
        elif act == "complete":
            guards[who].complete(42)
            found = lease(who).current()
            outcome = "completed" if found.holder_id == who and found.completed_cursor_hex == f"{42:016x}" else "too late"
        elif act == "abandon":
            guards[who].abandon()
            outcome = "abandoned"
        elif act == "garble":
            b.put("round", b"{garbage")
            outcome = "garbled"
        else:
            with guards[who]:
                pass
            outcome = "dropped"
        found = lease(who).current()
        rows.append((len(rows) + 1, who, now[0], outcome, found.holder_id if found else None, found.expires_at_unix if found else None))
    return spark.createDataFrame(rows, "n int, holder string, moment int, outcome string, holds string, expires int")


# --- scalars and decoders


@query(
    "scalar_functions",
    """WITH t AS (SELECT list_transform(range(0, 256), lambda x: list_reduce(list_prepend(x, range(0, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS tab),
k AS (SELECT event_id, event_type, 'user.' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS key, ts FROM events)
SELECT event_id, contains(event_type, 'rr') AS has, base64(encode(key)) AS coded, key AS back, CAST(floor(epoch(ts)) AS BIGINT) AS unix,
       xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: CAST(ord(key[i]) AS BIGINT))), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1]))) AS crc FROM k, t""",
)
def scalar_functions(spark, sf_dir):
    """contains, base64 both ways, seconds since 1970, CRC-32."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.concat(F.lit("user."), F.lpad(F.col("user_id").cast("string"), 4, "0"))
    coded = F.base64(key.cast("binary"))
    unix = F.expr("CAST(floor(unix_micros(CAST(CAST(ts AS string) || ' UTC' AS timestamp)) / 1000000) AS bigint)")
    return e.select("event_id", F.contains("event_type", F.lit("rr")).alias("has"), coded.alias("coded"), F.unbase64(coded).cast("string").alias("back"), unix.alias("unix"), F.crc32(key.cast("binary")).alias("crc"))


@query(
    "decode_entry",
    "SELECT event_id, CASE event_type WHEN 'error' THEN 'DEL' WHEN 'signup' THEN 'PURGE' ELSE 'PUT' END AS op, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE props END AS value, CASE WHEN event_id % 5 <> 0 THEN event_id END AS revision FROM events",
)
def decode_entry(spark, sf_dir):
    """Entries a client library has decoded, with the operation's name; revision 0 is unknown."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("event_type") == "error", F.lit("Delete")).when(F.col("event_type") == "signup", F.lit("Purge")).otherwise(F.lit("Put"))
    m = e.select("event_id", name.alias("operation"), "props", F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id")).alias("seq"))
    op = C.op_of_entry(F.col("operation"))
    return m.select("event_id", op.alias("op"), F.when(op == PUT, F.col("props")).alias("value"), F.nullif(F.col("seq"), F.lit(0)).cast("long").alias("revision"))

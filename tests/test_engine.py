"""Fold, bucket, store, artifacts, transport, lease and watch, against small expectations and a dict fold."""

import json
import os
import queue
import random
import shutil
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from ledgerfold.engine import Engine
from ledgerfold.errors import AlreadyExists, ArtifactInvalid, BackendError, CursorExpired, InvalidFormat, NotConnected, OperationFailed, RevisionMismatch, WatchError
from ledgerfold.functions.scope import Scope
from ledgerfold.operators import fold as ops
from ledgerfold.sources import artifact
from ledgerfold.sources.lease import Lease, LeaseRecord
from ledgerfold.sources.log import Bucket, BucketConfig
from ledgerfold.sources.schema import CHANGELOG, DEL, PURGE, PUT
from ledgerfold.sources.store import FoldStore
from ledgerfold.sources.transport import PUBLISHED, SUPERSEDED, Transport, export_of, import_remote, run_export_round
from ledgerfold.streaming.applied import AppliedLoop, BatchConfig, ExportRequest, changes_from, state_sync, watch_applied

STREAM = [(1, "node.a", PUT, "v1"), (2, "node.b", PUT, "v2"), (3, "svc.x", PUT, "sx"), (4, "node.a", PUT, "v1b"), (5, "node.b", DEL, None), (6, "node.c", PUT, "v3"), (7, "svc.y", PUT, "sy")]
FINAL = {"node.a": "v1b", "node.c": "v3", "svc.x": "sx", "svc.y": "sy"}


def log_of(spark, rows):
    """rows: (revision or None, key, op, value text); arrival is the position."""
    out = [(r, k, op, v.encode() if v is not None else None, None, n) for n, (r, k, op, v) in enumerate(rows, 1)]
    return spark.createDataFrame(out, CHANGELOG)


def state(rows):
    return {r["key"]: bytes(r["value"]).decode() for r in rows.collect()}


def dict_fold(rows):
    out = {}
    for _, k, op, v in rows:
        if op == PUT:
            out[k] = v
        else:
            out.pop(k, None)
    return out


def until(holds, seconds=60):
    end = time.time() + seconds
    while not holds():
        assert time.time() < end
        time.sleep(0.2)


# --- folds


@pytest.mark.parametrize("seed", [1, 2])
def test_folds_equal_dict_fold(spark, seed):
    r = random.Random(seed)
    rows = []
    for n in range(1, 400):
        op = r.choice([PUT, PUT, PUT, DEL, PURGE])
        rows.append((None if r.random() < 0.1 else n, r.choice(["a.", "b.", "c"]) + str(r.randrange(25)), op, r.choice(["", "x", "yy"]) if op == PUT else None))
    log = log_of(spark, rows).repartition(5)
    want = dict_fold(rows)
    assert state(ops.fold(log)) == want
    assert state(ops.latest_by_window(log).where("op = 'PUT'")) == want
    assert state(ops.latest_by_max(log).where("op = 'PUT'")) == want
    assert state(ops.live(log)) == {k: v for k, v in want.items() if v}
    assert {x["key"] for x in ops.live_keys(log, Scope.of(["a.", "b."])).collect()} == {k for k, v in want.items() if v and k[:2] in ("a.", "b.")}
    cutoff = 200
    first = ops.fold(log.where(F.col("arrival") <= cutoff))
    assert state(ops.merge(first, log.where(F.col("arrival") > cutoff))) == want
    got = ops.multi_get(ops.fold(log), ["a.1", "nope", "a.1", "c3"]).collect()
    assert [(x["pos"], x["key"], bytes(x["value"]).decode() if x["value"] is not None else None) for x in got] == [(i, k, want.get(k)) for i, k in enumerate(["a.1", "nope", "a.1", "c3"])]
    held = [n for n, *_ in rows if n]
    gaps = ops.revision_gaps(log.where("revision is not null"), width=16).collect()
    assert sorted((x["previous"], x["revision"]) for x in gaps) == [(a, b) for a, b in zip(held, held[1:]) if b > a + 1]


def test_prefix_is_literal(spark):
    log = log_of(spark, [(1, "a_b", PUT, "1"), (2, "axb", PUT, "2"), (3, "a%", PUT, "3")])
    assert set(state(ops.fold(log, Scope.prefix("a_")))) == {"a_b"} and set(state(ops.fold(log, Scope.prefix("a%")))) == {"a%"}
    assert ops.fold(log, Scope.of([])).count() == 0 and ops.fold(log, Scope.all()).count() == 3


# --- store


def test_store_conformance(spark, tmp_path):
    at = str(tmp_path / "fold")
    cursor, store = FoldStore.open(spark, at, buckets=4)
    assert cursor is None and store.rows().count() == 0 and store.get("x") is None
    for k in range(0, 7, 3):
        part = STREAM[k : k + 3]
        store.apply(log_of(spark, part), part[-1][0])
    for _ in range(2):
        cursor, store = FoldStore.open(spark, at)
        assert cursor == 7 and state(store.rows()) == FINAL
        assert [x["key"] for x in store.range("node.").collect()] == ["node.a", "node.c"]
        assert store.range("zzz").count() == 0
        assert store.get("svc.x")["revision"] == 3 and store.get("node.b") is None
        assert [x["key"] if x else None for x in store.multi_get(["svc.y", "no", "svc.y"])] == ["svc.y", None, "svc.y"]
        seen = []
        store.for_each_in_range("", lambda x: seen.append(x["key"]))
        assert seen == sorted(FINAL)
        store.compact()

    def stop(x):
        raise KeyError(x["key"])

    with pytest.raises(KeyError, match="node.a"):
        store.for_each_in_range("node.", stop)
    store.apply(log_of(spark, []), 9)
    assert store.cursor == 9 and state(store.rows()) == FINAL
    store.apply(log_of(spark, [(10, "svc.x", PURGE, None), (11, "lock", PUT, "")]), 11)
    reader = store.reader()
    assert state(store.rows())["lock"] == "" and "svc.x" not in state(store.rows())
    store.apply(log_of(spark, [(12, "late", PUT, "z")]), 12)
    assert "late" not in state(reader.rows()) and "late" in state(reader.refresh().rows())
    again = FoldStore(spark, str(tmp_path / "again"), buckets=4)
    history = [*STREAM, (10, "svc.x", PURGE, None), (11, "lock", PUT, ""), (12, "late", PUT, "z")]
    again.apply(log_of(spark, history), 12)
    assert state(again.rows()) == state(store.rows())
    store.vacuum(keep=1)
    assert state(FoldStore(spark, at).rows()) == state(again.rows())
    assert {x["key"] for x in store.stale_keys(spark.createDataFrame([("late",)], "key string"), Scope.prefix("node.")).collect()} == {"node.a", "node.c"}


def test_store_has_one_writer_and_strict_manifests(spark, tmp_path):
    at = str(tmp_path / "fold")
    one, two = FoldStore(spark, at), FoldStore(spark, at)
    one.apply(log_of(spark, STREAM[:2]), 2)
    with pytest.raises(BackendError):
        two.apply(log_of(spark, STREAM[2:4]), 4)
    (tmp_path / "fold" / "manifests" / f"{2:020d}").write_text("{}")
    with pytest.raises(InvalidFormat):
        FoldStore(spark, at)


def test_compaction_touches_only_changed_buckets(spark, tmp_path):
    store = FoldStore(spark, str(tmp_path / "fold"), buckets=8)
    store.apply(log_of(spark, [(n, f"k{n}", PUT, "v") for n in range(1, 60)]), 59)
    store.compact()
    before = dict(store.manifest["base"])
    store.apply(log_of(spark, [(60, "k7", PUT, "w")]), 60)
    store.compact()
    assert sum(store.manifest["base"][b] != before[b] for b in before) == 1 and state(store.rows())["k7"] == "w" and store.rows().count() == 59


# --- bucket


def test_bucket_semantics(spark, tmp_path):
    b = Bucket(spark, str(tmp_path / "b"))
    v1 = b.put("node.a", b"1")
    assert v1 == 1 and b.put("node.a", b"2") == 2 and b.get("node.a").value == b"2"
    b.put("node.b", b"3")
    b.put("other.c", b"4")
    assert b.delete("node.b") and b.delete("never.there")
    assert state(b.scan("node.")) == {"node.a": "2"} and {x["key"] for x in b.keys("node.").collect()} == {"node.a"}
    assert b.create("node.b", b"again") == 7
    with pytest.raises(AlreadyExists):
        b.create("node.b", b"x")
    with pytest.raises(RevisionMismatch):
        b.update("node.b", b"x", 3)
    with pytest.raises(OperationFailed):
        b.update("node.b", b"x", b"1234567890")
    assert b.update("node.b", b"y", 7) == 8 and b.delete_with_version("node.b", 8)
    assert b.get("node.b") is None and b.entry("node.b").value == b"" and b.entry("node.b").revision == 9
    with pytest.raises(AlreadyExists):
        b.create("node.b", b"tombstones are puts")
    with pytest.raises(RevisionMismatch):
        b.delete_with_version("absent", 1)
    assert {x["key"] for x in b.keys("").collect()} == {"node.a", "other.c"}
    b.purge("node.a")
    assert b.entry("node.a") is None and b.create("node.a", b"new") == 11
    before = state(b.scan(""))
    b.seal()
    assert state(b.scan("")) == before and b.head() == 11 and b.get("node.a").value == b"new"
    assert b.put("after", b"seal") == 12
    with pytest.raises(OperationFailed):
        b.put_with_ttl("k", b"v", 1)
    assert Bucket(spark, b.path, BucketConfig(max_history=9)).config.max_history == 1


def test_one_writer_gets_a_revision(spark, tmp_path):
    b = Bucket(spark, str(tmp_path / "b"), seal_after=10_000)
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda n: b.put(f"k{n}", b"v"), range(24)))
    assert sorted(got) == list(range(1, 25))


def test_bulk_append_and_retention(spark, tmp_path):
    b = Bucket(spark, str(tmp_path / "b"), BucketConfig(max_bytes=None))
    assert b.append(log_of(spark, STREAM).repartition(3)) == (1, 7)
    assert [(x["revision"], x["key"]) for x in b.changes().orderBy("revision").collect()] == [(r, k) for r, k, *_ in STREAM]
    b.put("node.a", b"z")
    assert b.apply_retention() == 3
    assert b.first_sequence() == 3 and state(b.scan("")) == FINAL | {"node.a": "z"}
    kept = {x["revision"] for x in b.changes().collect()}
    assert kept == {3, 5, 6, 7, 8}
    b.purge("svc.x")
    b.apply_retention()
    assert 3 not in {x["revision"] for x in b.changes().collect()} and b.first_sequence() == 5


def test_a_stalled_append_is_voided(spark, tmp_path):
    from ledgerfold.streaming.source import LogReader

    now = [1000]
    b = Bucket(spark, str(tmp_path / "b"), BucketConfig(max_bytes=None), clock=lambda: now[0])
    b.put("a", b"1")
    folder = f"{2:020d}-{5:020d}"  # a writer that claimed and died
    b.files.create(f"{b.path}/claims/{folder}", json.dumps({"from": 2, "to": 5, "segment": folder, "at": 1000}).encode())
    assert b.put("b", b"2") == 6
    assert state(b.scan("")) == {"a": "1", "b": "2"} and LogReader({"path": b.path})._head() == 1
    b.seal()
    assert b.head() == 6 and b.void_stalled(60) == 0
    now[0] = 1100
    assert b.void_stalled(60) == 1 and b.void_stalled(60) == 0 and LogReader({"path": b.path})._head() == 6
    b.seal()
    assert b.put("c", b"3") == 7 and state(b.scan("")) == {"a": "1", "b": "2", "c": "3"}


def test_an_append_that_was_given_up_raises(spark, tmp_path):
    """Whoever writes the outcome first decides: an append returns with its rows in the log, or raises with none."""
    from ledgerfold.streaming.source import LogReader

    b, other = (Bucket(spark, str(tmp_path / "b"), BucketConfig(max_bytes=None)) for _ in range(2))
    create, voided = b.files.create, []

    def late(path, data):  # given up after the data are written, before the writer says so
        if "/outcomes/" in path:
            voided.append(other.void_stalled(0))
        return create(path, data)

    b.files.create = late
    with pytest.raises(OperationFailed):
        b.append(log_of(spark, [(1, "a", PUT, "1"), (2, "b", PUT, "2")]))
    b.files.create = create
    assert voided == [1] and b.changes().count() == other.changes().count() == 0 and LogReader({"path": b.path})._head() == 2
    assert b.append(log_of(spark, [(1, "a", PUT, "1")])) == (3, 3) and other.void_stalled(0) == 0
    b.seal()
    assert state(other.scan("")) == {"a": "1"}


def test_appends_race_with_giving_up(spark, tmp_path):
    b, other = (Bucket(spark, str(tmp_path / "b"), BucketConfig(max_bytes=None)) for _ in range(2))
    rows = log_of(spark, [(1, "a", PUT, "1"), (2, "b", PUT, "2")]).persist()
    stop, there, n = threading.Event(), 0, 0

    def give_up():
        while not stop.is_set():
            other.void_stalled(0)
            time.sleep(0.3)

    thread = threading.Thread(target=give_up)
    thread.start()
    try:
        for _ in range(6):
            try:
                b.append(rows)
                n += 1
            except OperationFailed:
                there += 1
    finally:
        stop.set()
        thread.join()
        rows.unpersist()
    assert n + there == 6 and b.changes().count() == 2 * n


def test_the_fold_is_one_exchange(spark, tmp_path):
    log_of(spark, STREAM).write.parquet(str(tmp_path / "log"))
    for made in (lambda log: ops.latest(log), lambda log: ops.fold(log), lambda log: ops.live(log, Scope.prefix("node."))):
        plan = made(spark.read.parquet(str(tmp_path / "log")))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Broadcast" not in plan and "Join" not in plan and plan.count("FileScan") == 1
        assert plan.count("WindowGroupLimit") == 2  # below the exchange too: a task sends one row a key


def test_null_keys_and_equal_arrivals(spark):
    rows = [(1, None, PUT, b"1", None, 1), (2, None, PUT, b"2", None, 2), (3, "a", PUT, b"3", None, 7), (4, "a", DEL, None, None, 7)]
    log = spark.createDataFrame(rows, CHANGELOG)
    for made in (ops.latest, ops.latest_by_window):
        assert sorted((r["key"] or "", r["revision"]) for r in made(log).collect()) == [("", 2), ("a", 4)]
    assert {r["key"] for r in ops.latest_by_max(log).collect()} == {None, "a"}


def test_single_writes_read_claims_once(spark, tmp_path):
    b = Bucket(spark, str(tmp_path / "b"), seal_after=10_000)
    read, seen = b.files.read, []
    b.files.read = lambda path: seen.append(path) or read(path)
    for k in range(20):
        b.put(f"k{k}", b"v")
    claims = [p for p in seen if "/claims/" in p]
    assert len(claims) == len(set(claims)) <= 20


def test_own_stores_have_to_be_whole():
    from ledgerfold import extension

    class Half(extension.KvReader):
        def get(self, key):
            return None

    with pytest.raises(TypeError):
        Half()
    for ours, base in ((Bucket, extension.KvReader), (Bucket, extension.KvWriter), (Bucket, extension.KvWatcher), (FoldStore, extension.SnapshotStore), (Transport, extension.ArtifactTransport)):
        assert issubclass(ours, base)


def test_retention_by_age_and_bytes(spark, tmp_path):
    now = [1000]
    b = Bucket(spark, str(tmp_path / "age"), BucketConfig(max_age_s=50, max_bytes=None), clock=lambda: now[0])
    b.put("old", b"1")
    now[0] = 1040
    b.put("new", b"2")
    now[0] = 1060
    assert b.apply_retention() == 2 and state(b.scan("")) == {"new": "2"}
    now[0] = 5000
    assert b.apply_retention() == 3 and b.scan("").count() == 0 and b.first_sequence() == 3  # an empty log has a floor
    full = Bucket(spark, str(tmp_path / "new"), BucketConfig(max_bytes=40))
    full.put("k1", b"x" * 30)
    with pytest.raises(OperationFailed):
        full.put("k2", b"x" * 30)
    rows = log_of(spark, [(n, f"k{n}", PUT, "x" * 10) for n in range(1, 9)])
    old = Bucket(spark, str(tmp_path / "old"), BucketConfig(max_bytes=60, discard="old", max_history=5))
    old.append(rows)
    old.apply_retention()
    assert {x["revision"] for x in old.changes().collect()} == {4, 5, 6, 7, 8}


def test_engine_lifecycle(spark, tmp_path):
    e = Engine(str(tmp_path), spark)
    with pytest.raises(NotConnected):
        e.store("b")
    e.open().open()
    assert e.is_healthy() and e.store("b").put("k", b"v") == 1 and e.capabilities()["cas"] and not e.capabilities()["ttl"]
    e.close()
    e.close()
    assert not e.is_healthy() and not spark.sparkContext._jsc.sc().isStopped()


# --- artifacts


@pytest.fixture
def folded(spark, tmp_path):
    store = FoldStore(spark, str(tmp_path / "fold"), buckets=3)
    store.apply(log_of(spark, STREAM), 7)
    return store


def test_export_import(spark, tmp_path, folded):
    m = artifact.export(folded, str(tmp_path / "art"))
    assert m.cursor == 7 and m.files
    got = artifact.import_(spark, str(tmp_path / "art"), str(tmp_path / "new"))
    assert got.cursor == 7 and state(got.rows()) == FINAL and got.get("svc.x")["revision"] == 3
    got.apply(log_of(spark, [(8, "node.a", DEL, None)]), 8)
    assert "node.a" not in state(got.rows())
    with pytest.raises(ArtifactInvalid):
        artifact.export(folded, str(tmp_path / "art"))
    with pytest.raises(ArtifactInvalid):
        artifact.import_(spark, str(tmp_path / "art"), str(tmp_path / "new"))


def edit(path, **changes):
    m = json.loads(open(path).read())
    m.update(changes)
    open(path, "w").write(json.dumps(m))


@pytest.mark.parametrize("how", ["tampered", "missing", "extra", "link", "backend", "schema", "generation", "cursor", "field", "path", "no manifest"])
def test_bad_artifacts_are_refused(spark, tmp_path, folded, how):
    art = str(tmp_path / "art")
    m = artifact.export(folded, art)
    victim = f"{art}/{next(f['path'] for f in m.files if 'part' in f['path'])}"
    manifest = f"{art}/{artifact.MANIFEST}"
    if how == "tampered":
        raw = bytearray(open(victim, "rb").read())
        raw[len(raw) // 2] ^= 1
        open(victim, "wb").write(raw)
    elif how == "missing":
        os.unlink(victim)
    elif how == "extra":
        open(f"{art}/data/extra", "w").write("x")
    elif how == "link":
        os.rename(victim, f"{tmp_path}/aside")
        os.symlink(f"{tmp_path}/aside", victim)
    elif how == "no manifest":
        os.unlink(manifest)
    else:
        change = {"backend": {"backend": "other"}, "schema": {"schema_version": 2}, "generation": {"backend_version": "0"}, "cursor": {"cursor_hex": f"{8:016x}"}, "field": {"more": 1}, "path": {"files": [{"path": "data/../x", "size": 1, "digest": ""}]}}[how]
        edit(manifest, **change)
    with pytest.raises(ArtifactInvalid):
        artifact.import_(spark, art, str(tmp_path / "new"))
    assert not os.path.exists(tmp_path / "new") and not [n for n in os.listdir(tmp_path) if n.startswith(".")]


def test_transport(spark, tmp_path):
    t = Transport(str(tmp_path / "shared"))
    arts = {}
    for c in (5, 3, 7, 9):
        store = FoldStore(spark, str(tmp_path / f"f{c}"), buckets=2)
        store.apply(log_of(spark, [(c, "k", PUT, f"v{c}")]), c)
        artifact.export(store, str(tmp_path / f"a{c}"))
        arts[c] = str(tmp_path / f"a{c}")
    assert t.manifest("x") is None and t.prune("x", 0) == 0
    with pytest.raises(ArtifactInvalid):
        t.download("x", str(tmp_path / "d"))
    assert [t.upload(arts[c], "x") for c in (5, 3, 7, 7)] == [PUBLISHED, SUPERSEDED, PUBLISHED, PUBLISHED]
    assert t.manifest("x").cursor == 7
    assert t.prune("x", 3600) == 0 and t.prune("x", 0) == 2 and t.prune("x", 0) == 0
    assert state(import_remote(spark, t, "x", str(tmp_path / "node")).rows()) == {"k": "v7"}
    open(t._pointer("x"), "w").write("junk")
    assert t.prune("x", 0) == 0
    with pytest.raises(ArtifactInvalid):
        t.manifest("x")
    assert t.upload(arts[3], "x") == PUBLISHED  # a corrupt pointer may be replaced
    with pytest.raises(OperationFailed):
        Transport(str(tmp_path / "s2"), locks=False).upload(arts[3], "x")
    assert Transport(str(tmp_path / "s2"), locks=False, one_publisher=True).upload(arts[3], "x") == PUBLISHED
    name = next(n for n in os.listdir(t._payloads("x")) if n.startswith(f"{3:016x}"))
    shutil.rmtree(f"{t._payloads('x')}/{name}")
    with pytest.raises(ArtifactInvalid):
        t.download("x", str(tmp_path / "d"))


# --- lease


def test_lease(spark, tmp_path):
    now = [100]
    b = Bucket(spark, str(tmp_path / "b"), seal_after=10_000)
    lease = lambda who: Lease(b, "export", who, clock=lambda: now[0])
    with ThreadPoolExecutor(8) as pool:
        won = [g for g in pool.map(lambda n: lease(f"n{n}").try_acquire(60), range(8)) if g]
    assert len(won) == 1 and lease("x").current().holder_id == won[0].record.holder_id
    won[0].complete(42)
    assert lease("x").current().completed_cursor_hex == "000000000000002a" and lease("y").try_acquire(60) is None
    now[0] = 161
    second = lease("second").try_acquire(60)
    assert second is not None
    won[0].complete(43)  # too late: logged, not raised
    assert lease("x").current().holder_id == "second"
    second.abandon()
    assert lease("x").current() is None
    third = lease("third").try_acquire(60)
    assert third is not None
    b.put("export", b"{garbage")
    assert lease("fourth").try_acquire(60) is not None
    assert LeaseRecord.parse(b"[]") is None and LeaseRecord.parse(b"") is None


def test_export_round(spark, tmp_path, folded):
    now = [100]
    b, t = Bucket(spark, str(tmp_path / "b")), Transport(str(tmp_path / "shared"))
    lease = Lease(b, "round", "me", clock=lambda: now[0])
    run = lambda make=export_of(folded): run_export_round(lease, 60, make, t, "x", str(tmp_path / "work"))
    assert run() == PUBLISHED and run() is None
    assert lease.current().completed_cursor_hex == f"{7:016x}"
    now[0] = 200

    def fails(folder):
        raise RuntimeError("disk full")

    with pytest.raises(RuntimeError):
        run(fails)
    assert run() == PUBLISHED  # the failed round was given back
    assert not os.listdir(tmp_path / "work")


# --- watch


def filled(spark, path, rows=STREAM, **config):
    b = Bucket(spark, str(path), BucketConfig(**{"max_bytes": None, **config}))
    b.append(log_of(spark, rows))
    return b


def test_state_sync_then_delta(spark, tmp_path):
    b = filled(spark, tmp_path / "b")
    listed = [(x["revision"], x["op"]) for x in state_sync(b, Scope.prefix("node.")).collect()]
    assert listed == [(4, PUT), (5, DEL), (6, PUT)]
    assert state_sync(b, Scope.of([])).count() == 0
    got = [x["key"] for x in changes_from(b, 4, Scope.of(["node.", "svc."])).collect()]
    assert got == ["node.b", "node.c", "svc.y"]
    b.apply_retention()
    with pytest.raises(CursorExpired):
        changes_from(b, 1, Scope.all())


def test_cursor_moves_after_apply(spark, tmp_path):
    b = filled(spark, tmp_path / "b", [(n, f"k{n}", PUT, "v") for n in range(1, 5)])
    seen, told = [], []
    loop = AppliedLoop(spark, store=FoldStore(spark, str(tmp_path / "fold")), apply=lambda rows, c: seen.append((c, rows.count())), on_applied=told.append)
    watch_applied(b, loop, str(tmp_path / "ck"), config=BatchConfig(max_revisions=2))
    assert seen == [(None, 2), (2, 2)] and told == [2, 4] and loop.store.cursor == 4
    b.append(log_of(spark, [(n, f"k{n}", PUT, "w") for n in range(1, 6)]))
    b.put("single", b"s")
    again = AppliedLoop(spark, store=FoldStore(spark, str(tmp_path / "fold")), apply=lambda rows, c: seen.append((c, rows.count())))
    watch_applied(b, again, str(tmp_path / "ck"), config=BatchConfig(max_revisions=4))
    assert again.store.cursor == 10 and sum(n for _, n in seen[2:]) == 6 and state(again.store.rows())["k5"] == "w"
    third = AppliedLoop(spark, store=FoldStore(spark, str(tmp_path / "fold")), apply=lambda rows, c: seen.append("none left"))
    watch_applied(b, third, str(tmp_path / "ck"))
    assert "none left" not in seen


def test_rejected_and_unknown_changes(spark, tmp_path):
    store = FoldStore(spark, str(tmp_path / "fold"))
    got = []
    loop = AppliedLoop(spark, store=store, parse=lambda rows: rows.where("false"), apply=lambda rows, c: got.append(rows.count()))
    loop.batch(log_of(spark, [(5, "a", PUT, "1"), (6, "b", PUT, "1"), (7, "c", PUT, "1")]))
    assert got == [0] and store.cursor == 7 and store.rows().count() == 3
    loop.batch(log_of(spark, [(None, "u", PUT, "unknown")]))
    assert store.cursor == 7 and state(store.rows())["u"] == "unknown"
    loop.batch(log_of(spark, [(6, "a", PUT, "a replay"), (8, "d", PUT, "2")]))
    assert state(store.rows())["a"] == "1" and store.cursor == 8


def test_a_crash_between_publish_and_commit_replays(spark, tmp_path):
    """The fold was published, Spark's checkpoint was not: the batch runs again and changes nothing."""
    b = filled(spark, tmp_path / "b")
    store = FoldStore(spark, str(tmp_path / "fold"))
    store.apply(log_of(spark, STREAM[:5]), 5)
    seen = []
    loop = AppliedLoop(spark, store=store, cursor=5, apply=lambda rows, c: seen.extend(x["revision"] for x in rows.collect()))
    loop.batch(b.changes().select(*CHANGELOG.fieldNames()))
    assert seen == [6, 7] and state(store.rows()) == FINAL


def test_store_failures(spark, tmp_path):
    store, left = FoldStore(spark, str(tmp_path / "fold")), [1]
    real = store.apply

    def flaky(rows, cursor):
        if left[0] > 0:
            left[0] -= 1
            raise BackendError("transient")
        real(rows, cursor)

    store.apply = flaky
    loop, domain = AppliedLoop(spark, store=store, apply=lambda rows, c: domain.append(1)), []
    loop.batch(log_of(spark, [(1, "node.a", PUT, "1")]))
    loop.batch(log_of(spark, [(2, "node.b", PUT, "1")]))
    assert store.cursor == 2 and store.rows().count() == 2 and len(domain) == 2
    left[0] = 99
    with pytest.raises(WatchError):
        loop.batch(log_of(spark, [(3, "node.c", PUT, "1")]))
    assert store.cursor == 2


def expired(spark, tmp_path):
    """A bucket whose retention has passed cursor 2; node.b went in the gap."""
    b = filled(spark, tmp_path / "b", [(1, "node.a", PUT, "1"), (2, "node.b", PUT, "1"), (3, "node.b", DEL, None), (4, "other.z", PUT, "9"), (5, "node.b", PURGE, None), (6, "node.a", PUT, "1b")])
    b.apply_retention()
    kept = b.changes().where("key != 'node.b'").select(*CHANGELOG.fieldNames())
    path = f"{b.path}/segments/without"
    kept.withColumns({"value_len": F.octet_length("value").cast("long"), "written_unix": F.lit(0).cast("long")}).write.parquet(path)
    b._advance(b._state(), segments=[{"folder": "without", "from": 4, "to": 6}], first_sequence=4)
    return b


def test_resync(spark, tmp_path):
    b = expired(spark, tmp_path)
    for name, resync in (("with", True), ("without", False)):
        store, order = FoldStore(spark, str(tmp_path / name)), []
        store.apply(log_of(spark, [(1, "node.a", PUT, "1"), (2, "node.b", PUT, "1")]), 2)
        loop = AppliedLoop(spark, store=store, apply=lambda rows, c, order=order: order.extend((x["op"], x["key"], x["revision"]) for x in rows.orderBy("arrival").collect()))
        watch_applied(b, loop, str(tmp_path / f"ck{name}"), resync=resync)
        if resync:
            assert order[0] == (DEL, "node.b", None) and (PUT, "node.a", 6) in order[1:]
            assert state(store.rows()) == {"node.a": "1b", "other.z": "9"} and store.cursor == 6
        else:
            assert "node.b" in state(store.rows())


def test_resync_keeps_to_the_scope(spark, tmp_path):
    store = FoldStore(spark, str(tmp_path / "fold"))
    store.apply(log_of(spark, [(1, "node.b", PUT, "1"), (2, "other.z", PUT, "1")]), 2)
    loop = AppliedLoop(spark, scope=Scope.prefix("node."), store=store, cursor=2)
    loop.resync(lambda: spark.createDataFrame([], "key string"))
    assert state(store.rows()) == {"other.z": "1"} and store.cursor == 2

    def fails():
        raise TimeoutError("no listing")

    with pytest.raises(WatchError):
        loop.resync(fails)
    assert state(store.rows()) == {"other.z": "1"}


def test_floor_guard(spark, tmp_path):
    b = filled(spark, tmp_path / "b", [(n, f"k{n}", PUT, "v") for n in range(1, 6)])
    b.put("k2", b"w")
    b.put("k3", b"w")
    b.apply_retention()
    got = [x["revision"] for x in b.changes(after=1).orderBy("revision").collect()]
    assert got == [4, 5, 6, 7] and b.first_sequence() == 1  # an inner gap, no loss
    store = FoldStore(spark, str(tmp_path / "fold"))
    store.apply(log_of(spark, [(1, "k1", PUT, "v")]), 1)
    watch_applied(b, AppliedLoop(spark, store=store), str(tmp_path / "ck"))
    assert store.cursor == 7 and store.rows().count() == 5
    from ledgerfold.streaming.source import LogReader

    b._advance(b._state(), first_sequence=6)
    with pytest.raises(CursorExpired):
        LogReader({"path": b.path}).partitions({"revision": 3}, {"revision": 7})


def test_export_between_batches(spark, tmp_path):
    b = filled(spark, tmp_path / "b")
    ask = ExportRequest(str(tmp_path / "art"))
    exports = queue.Queue()
    exports.put(ask)
    loop = AppliedLoop(spark, store=FoldStore(spark, str(tmp_path / "fold")), exports=exports)
    watch_applied(b, loop, str(tmp_path / "ck"))
    assert ask.result.get_nowait().cursor in (4, 7)
    bad = ExportRequest(str(tmp_path / "art"))  # not empty any more
    exports.put(bad)
    loop.serve_exports()
    assert isinstance(bad.result.get_nowait(), ArtifactInvalid)


def test_bootstrap_replays_only_the_tail(spark, tmp_path):
    b = filled(spark, tmp_path / "b", [(n, f"k{n}", PUT, "v") for n in range(1, 13)])
    first = AppliedLoop(spark, store=FoldStore(spark, str(tmp_path / "one")))
    watch_applied(b, first, str(tmp_path / "ck1"))
    t = Transport(str(tmp_path / "shared"))
    artifact.export(first.store, str(tmp_path / "art"))
    t.upload(str(tmp_path / "art"), "x")
    b.append(log_of(spark, [*[(n, f"n{n}", PUT, "w") for n in range(6)], (9, "k1", DEL, None)]))
    got = []
    second = AppliedLoop(spark, store=import_remote(spark, t, "x", str(tmp_path / "two")), apply=lambda rows, c: got.extend(x["revision"] for x in rows.collect()))
    watch_applied(b, second, str(tmp_path / "ck2"))
    assert got == list(range(13, 20)) and state(second.store.rows()) == state(b.scan(""))


def test_running_watch(spark, tmp_path):
    b = filled(spark, tmp_path / "b")
    loop = AppliedLoop(spark, scope=Scope.of(["node.", "svc."]), store=FoldStore(spark, str(tmp_path / "fold")))
    q = watch_applied(b, loop, str(tmp_path / "ck"), available_now=False, config=BatchConfig(window_ms=200))
    try:
        b.put("node.new", b"n")
        end = time.time() + 60
        while "node.new" not in state(FoldStore(spark, loop.store.path).rows()) and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert state(FoldStore(spark, loop.store.path).rows()) == FINAL | {"node.new": "n"}


def test_shutdown_of_a_running_watch(spark, tmp_path):
    """The running batch is published, an export asked for is answered, and what comes later is left for the next start."""
    b, asked = filled(spark, tmp_path / "b"), queue.Queue()
    loop = AppliedLoop(spark, store=FoldStore(spark, str(tmp_path / "fold")), exports=asked)
    query = watch_applied(b, loop, str(tmp_path / "c"), available_now=False)
    b.put("node.late", b"1")
    until(lambda: loop.store.cursor == 8)
    request = ExportRequest(str(tmp_path / "art"))
    asked.put(request)
    loop.shutdown(query)
    assert request.result.get(timeout=1).cursor == 8 and not query.isActive
    b.put("node.later", b"2")
    assert loop.store.refresh().cursor == 8
    again = AppliedLoop(spark, store=FoldStore(spark, str(tmp_path / "fold")))
    watch_applied(b, again, str(tmp_path / "c"))
    assert again.store.cursor == 9 and state(again.store.rows())["node.later"] == "2"

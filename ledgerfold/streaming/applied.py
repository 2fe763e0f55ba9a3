"""The applied watch: changes reach the domain, then data and cursor are published together, then the cursor is told.

A cursor C in the store means that every change up to C was applied and is in
the fold. Spark's checkpoint lies behind or level with it: a batch that runs
again drops the changes the fold has already. The store's cursor is the
authority on restart, never the one that on_applied saw last.
"""

from __future__ import annotations

import logging
import queue
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.errors import BackendError, CursorExpired, InvalidFormat, WatchError
from ledgerfold.functions.scope import Scope
from ledgerfold.kernels import gap_is_loss
from ledgerfold.operators import fold as ops
from ledgerfold.sources import artifact
from ledgerfold.sources.log import Bucket
from ledgerfold.sources.schema import BATCH_MAX, BATCH_WINDOW_MS, MAX_STORE_FAILURES
from ledgerfold.sources.store import FoldStore
from ledgerfold.streaming.source import NAME, register


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class BatchConfig:
    """max_revisions bounds the batches of deltas and of listings up to ten times as long; a longer listing is one batch with one cursor."""

    window_ms: int = BATCH_WINDOW_MS
    max_revisions: int = BATCH_MAX


@dataclass
class ExportRequest:
    """Put one in a watch's export queue; `result` gets the manifest or the error."""

    dest: str
    result: queue.Queue = field(default_factory=lambda: queue.Queue(1))


def everything(batch: DataFrame) -> DataFrame:
    return batch


@dataclass
class AppliedLoop:
    """What happens to a batch. `parse` turns change rows into the domain's rows and may drop any;
    it decides neither what the fold keeps nor how far the cursor moves. `apply(rows, cursor)` gets
    the cursor before the batch, so it can tell a batch that runs again; an exception ends the watch.
    """

    spark: SparkSession
    scope: Scope = field(default_factory=Scope.all)
    store: FoldStore | None = None
    parse: Callable[[DataFrame], DataFrame] = everything
    apply: Callable[[DataFrame, int | None], None] = lambda rows, cursor: None
    on_applied: Callable[[int | None], None] = lambda cursor: None
    exports: queue.Queue | None = None
    cursor: int | None = None
    closing: bool = False
    _busy: threading.RLock = field(default_factory=threading.RLock, repr=False)

    def batch(self, changes: DataFrame, listing: bool = False) -> None:
        """Apply one batch of change rows, publish it with its cursor, then tell the cursor.

        listing: the rows are current values, whose revisions may lie before
        the cursor. Nothing happens once the loop is shutting down.
        """
        with self._busy:
            if not self.closing:
                self._batch(changes, listing)

    def _batch(self, changes: DataFrame, listing: bool) -> None:
        todo = changes.where(self.scope.column())
        if self.cursor is not None and not listing:  # a batch that Spark runs again
            todo = todo.where(F.col("revision").isNull() | (F.col("revision") > self.cursor))
        todo = todo.persist()
        try:
            n, last = todo.agg(F.count(F.lit(1)), F.max("revision")).first()
            if n:
                self.apply(self.parse(todo.orderBy("arrival")), self.cursor)
                self._flush(todo, last)
            self.serve_exports()
        finally:
            todo.unpersist()

    def shutdown(self, query=None) -> None:
        """End a watch in order: the running batch is applied and published, queued exports are answered, then the query stops.

        Batches that were not begun are dropped; the next start resumes from
        the fold's cursor.
        """
        self.closing = True
        with self._busy:  # waits for the running batch
            self.serve_exports()
        if query is not None:
            query.stop()
        self.serve_exports()  # asked for meanwhile

    def _flush(self, rows: DataFrame, last: int | None) -> None:
        """Publish a batch with its cursor. Any failure of the store is tried again, after longer and longer pauses; `apply` is not repeated."""
        moved = last is not None and (self.cursor is None or last > self.cursor)
        to = last if moved else self.cursor
        if self.store is not None:
            for left in reversed(range(MAX_STORE_FAILURES)):
                try:
                    self.store.apply(rows, to)
                    break
                except InvalidFormat:
                    raise  # a manifest that can't be read stays so
                except Exception as e:  # ours, Spark's or the file system's
                    if not left:
                        raise WatchError(f"the store failed {MAX_STORE_FAILURES} times: {e}") from e
                    log.warning("the store failed, %d tries are left: %s", left, e)
                    time.sleep(min(0.5, 0.02 * 2 ** (MAX_STORE_FAILURES - 1 - left)))
                    self.store.refresh()
        if moved:
            self.cursor = to
            self.on_applied(to)

    def resync(self, list_live_keys: Callable[[], DataFrame]) -> None:
        """Delete what vanished unseen: keys that the fold holds in the scope and the log doesn't list.

        A listing that fails ends the watch; a part of the answer would leave
        deleted keys in the fold for good. The deletes carry no revision.
        """
        try:
            live = list_live_keys()
            stale = ops.stale_keys(self.store.rows(self.scope), live)
            gone = ops.synthetic_deletes(stale).withColumn("arrival", F.lit(0).cast("long")).persist()
            found = not gone.isEmpty()
        except Exception as e:
            raise WatchError(f"resync failed: {e}") from e
        try:
            if found:
                self.apply(self.parse(gone), self.cursor)
                self._flush(gone, None)
        finally:
            gone.unpersist()

    def serve_exports(self) -> None:
        while self.exports is not None and not self.exports.empty():
            request = self.exports.get()
            try:
                if self.store is None:
                    raise BackendError("the watch has no store to export")
                request.result.put(artifact.export(self.store, request.dest))
            except Exception as e:  # the requester's problem, not the watch's
                request.result.put(e)


def check_resume(bucket: Bucket, cursor: int) -> None:
    bucket.check_resume(cursor)


def state_sync(bucket: Bucket, scope: Scope) -> DataFrame:
    return bucket.watch(scope)


def changes_from(bucket: Bucket, cursor: int, scope: Scope) -> DataFrame:
    """Changes after the cursor in the scope, as a batch; CursorExpired if some are gone."""
    return bucket.watch_from(cursor, scope)


def watch_stream(spark: SparkSession, bucket: Bucket, scope: Scope, after: int, most: int = 0) -> DataFrame:
    """The streaming DataFrame of changes after a revision: one source for the union of the prefixes."""
    register(spark)
    source = spark.readStream.format(NAME).option("path", bucket.path).option("startingRevision", after)
    return (source.option("maxRevisionsPerTrigger", most) if most else source).load().where(scope.column())


def watch_applied(bucket: Bucket, loop: AppliedLoop, checkpoint: str, resume: int | None = None, resync: bool = True, config: BatchConfig = BatchConfig(), available_now: bool = True, query_name: str | None = None):
    """Bring the loop to the log's head and keep it there; returns the streaming query (ended if available_now).

    Without a cursor: state-sync first. With one: the delta, or, if that has
    expired, resync (where asked for and a store is there) and state-sync.
    """
    spark = bucket.spark
    loop.cursor = resume if resume is not None else (loop.store.cursor if loop.store else None)
    if not loop.scope.prefixes:
        return None
    head, listed = bucket.head(), not loop.cursor
    if loop.cursor:
        try:
            check_resume(bucket, loop.cursor)
        except CursorExpired:
            listed = True
            if resync and loop.store is not None:
                loop.resync(lambda: bucket.keys(loop.scope))
    if listed:
        for low, high in _pieces(bucket, loop.scope, config.max_revisions):
            loop.batch(state_sync(bucket, loop.scope).where(F.col("revision").between(low, high)), listing=True)
    start = head if listed else loop.cursor
    frontier = [start]

    def on_batch(rows: DataFrame, _) -> None:
        if loop.scope.is_all:
            first = rows.where(F.col("revision") > frontier[0]).agg(F.min("revision"), F.max("revision")).first()
            if first[0] is not None:
                if gap_is_loss(frontier[0], first[0], bucket.first_sequence()):
                    raise WatchError("retention overran the watch; a restart will resync")
                frontier[0] = first[1]
        loop.batch(rows)

    # The fold's cursor is the authority: every start has a checkpoint of its own, from where the fold is.
    at = start
    while True:
        stream = watch_stream(spark, bucket, loop.scope, at, config.max_revisions)
        writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{checkpoint}/from-{at:020d}-{uuid.uuid4().hex}")
        if query_name:
            writer = writer.queryName(query_name)
        if not available_now:
            return writer.trigger(processingTime=f"{config.window_ms} milliseconds").start()
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        progress = query.lastProgress
        reached = int(re.search(r"\d+", str(progress["sources"][0]["endOffset"]))[0]) if progress else at
        if reached >= head or reached <= at:  # a rate limit ends a run early
            loop.serve_exports()
            return query
        at = reached


def _pieces(bucket: Bucket, scope: Scope, most: int) -> list[tuple[int, int]]:
    """Revision ranges of the listing. One piece unless it is short: a bulk listing is one distributed batch."""
    low, high, n = bucket.changes().where(scope.column()).agg(F.min("revision"), F.max("revision"), F.count(F.lit(1))).first()
    if low is None:
        return []
    if n > 10 * most:
        return [(low, high)]
    rows = [r["revision"] for r in state_sync(bucket, scope).select("revision").collect()]  # at most 10 * most
    return [(rows[k], rows[min(k + most, len(rows)) - 1]) for k in range(0, len(rows), most)]

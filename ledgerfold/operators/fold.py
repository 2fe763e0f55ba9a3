"""Folds of a change log, and the queries over log and fold.

Order is arrival order: versions are never compared, so changes of unknown
revision fold like others. Prefix and revision predicates sit below the
aggregation and reach the Parquet scan. Aggregations combine on the map side,
so a hot key sends one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.functions.columns import is_live, is_put
from ledgerfold.functions.scope import Scope
from ledgerfold.sources.schema import DEL

_REST = ("op", "value", "revision", "version")


def latest(log: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Last change of each key in the scope, markers included; of equal arrivals the one of higher revision.

    One scan and one exchange: a window limited to one row a key. The limit
    works below the shuffle too, so a task sends each key's last change and no
    older one, and a hot key is one row a task. A null key is a key.
    """
    if scope is not None:
        log = log.where(scope.column())
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("arrival"), F.desc("revision")))
    return log.withColumn("rn", rank).where(F.col("rn") == 1).select("key", *_REST, "arrival")


latest_by_window = latest


def latest_by_join(log: DataFrame) -> DataFrame:
    """The same by a hash aggregation over (key, arrival) and a join back; for logs without null keys and with distinct arrivals.

    Nothing is sorted but by the join, and every value moves: it pays where
    nearly every change is its key's last.
    """
    last = log.groupBy("key").agg(F.max("arrival").alias("arrival"))
    return log.join(last, ["key", "arrival"], "left_semi").select("key", *_REST, "arrival")


def latest_by_max(log: DataFrame) -> DataFrame:
    """The same by one aggregation, which sorts as it carries values; any of equal arrivals."""
    last = log.groupBy("key").agg(F.max_by(F.struct(*_REST), "arrival").alias("c"), F.max("arrival").alias("arrival"))
    return last.select("key", *[f"c.{n}" for n in _REST], "arrival")


def fold(log: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Keys whose last change is a put. Purges fold like deletes; puts without a value stay."""
    return latest(log, scope).where(is_put()).select("key", "value", "revision", "version")


def live(log: DataFrame, scope: Scope | None = None) -> DataFrame:
    """What reads show: the fold without keys of empty value."""
    return latest(log, scope).where(is_live()).select("key", "value", "revision", "version")


def live_keys(log: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Keys of `live`, without reading values past their length."""
    if scope is not None:
        log = log.where(scope.column())
    lean = log.select("key", "arrival", (is_put() & (F.octet_length("value") > 0)).alias("shown"))
    return lean.groupBy("key").agg(F.max_by("shown", "arrival").alias("shown")).where("shown").select("key")


def state_sync(log: DataFrame, scope: Scope | None = None) -> DataFrame:
    """First part of a watch: the last change of each key, markers included, in revision order."""
    return latest(log, scope).orderBy("arrival")


def delta(log: DataFrame, cursor: int, scope: Scope | None = None) -> DataFrame:
    """Changes after the cursor, in order."""
    out = log.where(F.col("revision") > cursor)
    return (out.where(scope.column()) if scope is not None else out).orderBy("revision")


def as_of(log: DataFrame, revision: int, scope: Scope | None = None) -> DataFrame:
    """The fold as it was at a revision."""
    return fold(log.where(F.col("revision") <= revision), scope)


def stale_keys(held: DataFrame, current: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Keys that the fold holds and the listing lacks, within the scope; each once."""
    if scope is not None:
        held = held.where(scope.column())
    return held.select("key").join(current.select("key"), "key", "left_anti").distinct()


def synthetic_deletes(stale: DataFrame) -> DataFrame:
    """Deletes without a revision: they fold, and never move a cursor."""
    none = lambda t: F.lit(None).cast(t)
    return stale.select(none("bigint").alias("revision"), "key", F.lit(DEL).alias("op"), none("binary").alias("value"), none("binary").alias("version"))


def merge(held: DataFrame, batch: DataFrame) -> DataFrame:
    """The fold after a batch: one full outer join on the key of what the batch leaves of each key."""
    change = latest(batch).select("key", *[F.col(n).alias(f"__{n}") for n in _REST])
    both = held.join(change, "key", "full_outer").where(F.col("__op").isNull() | is_put("__op"))
    pick = lambda n: F.when(F.col("__op").isNull(), F.col(n)).otherwise(F.col(f"__{n}")).alias(n)
    return both.select("key", pick("value"), pick("revision"), pick("version"))


def multi_get(held: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each asked key, in the asked order, repeats included; NULLs where it is absent.

    The asked keys are a literal, so they are the side that is broadcast: its
    size is the caller's list, not data.
    """
    spark = held.sparkSession
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "pos int, key string")
    found = held.join(F.broadcast(asked.select("key").distinct()), "key", "left_semi").select("key", "value", "revision", "version")
    return asked.join(found, "key", "left").select("pos", "key", "value", "revision", "version").orderBy("pos")


def history(log: DataFrame, n: int) -> DataFrame:
    """The newest n changes of each key."""
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("arrival")))
    return log.withColumn("rn", rank).where(F.col("rn") <= n)


def first_sequence(retained: DataFrame) -> DataFrame:
    return retained.agg(F.min("revision").alias("first_sequence"))


def revision_gaps(retained: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(revision, previous) wherever the revision before is not retained.

    Ranges of `width` revisions are windows of their own; the last revision of
    the ranges before (one row a range) closes the gap between ranges, so no
    task reads the whole log.
    """
    block = F.floor(F.col("revision") / width)
    rows = retained.select("revision", block.alias("block"))
    inside = rows.withColumn("previous", F.lag("revision").over(W.partitionBy("block").orderBy("revision")))
    ends = rows.groupBy("block").agg(F.max("revision").alias("end"))
    before = ends.select("block", F.lag("end").over(W.orderBy("block")).alias("end"))
    joined = inside.join(before, "block")
    return joined.select("revision", F.coalesce("previous", "end").alias("previous")).where(F.col("revision") > F.col("previous") + 1)


def batch_cursors(log: DataFrame, size: int) -> DataFrame:
    """Of each batch of `size` changes: how many, and the cursor after it (unknown revisions don't count)."""
    batch = F.floor((F.col("arrival") - 1) / size)
    return log.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("received"), F.max("revision").alias("cursor"))


def redundancy(log: DataFrame) -> DataFrame:
    """Would rewriting the log make it shorter? True with a repeated key or a delete."""
    by_key = log.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max((~is_put()).cast("int")).alias("removed"))
    sums = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.max("removed"), F.lit(0)).alias("removed"))
    return sums.select("n_records", "n_keys", ((F.col("n_records") > F.col("n_keys")) | (F.col("removed") > 0)).alias("redundant"))


def bucket_of(key: Column, buckets: int) -> Column:
    """Fold bucket of a key; zlib.crc32 gives the same on the driver."""
    return (F.crc32(key.cast("binary")) % buckets).cast("int")

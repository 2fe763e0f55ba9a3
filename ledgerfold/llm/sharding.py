"""Sharding by extendible hashing, in DataFrame operations only.

A directory is indexed by the leading bits of a document's hash. A bucket over
the byte limit splits on the next bit, and only such buckets do, until every
shard fits. Splitting is decided on a histogram: bytes by hash prefix at a
depth where a cell holds about a sixteenth of the limit, rolled up to all
shallower depths; a shard is the shallowest prefix that fits. Cells that are
still over the limit are counted again at greater depth, alone.

The hash is the first 60 bits of the MD5 of the id's text (a null id: of the
empty text) and, behind them, of the text, so rows of one id can be split.
What no bit can split are equal rows, and rows longer than the limit. Equal
rows over the limit are paged: copy number k goes to page k // (limit //
bytes). A row over the limit has a shard to itself for each copy.

Scale: two scans of id and text length, one partial aggregation, and one join
of (hash cell, id) with the directory (broadcast only up to a checked size);
texts move only in write_shards, once.

Defined results: null or empty text has 0 bytes; an empty table has no shards;
columns of the documents named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

LIMIT_BYTES = 1 << 20
MAX_DEPTH = 60
#: A directory of up to so many shards (some 100 bytes each) is broadcast; a longer one is joined by shuffle.
BROADCAST_SHARDS = 50_000


def _hash(docs: DataFrame):
    """60 bits as a string of 0 and 1."""
    of = lambda text, digits: F.lpad(F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, digits), 16, 2), 4 * digits, "0")
    return F.concat(of(F.col("doc_id").cast("string"), 10), of(F.col("text").cast("string"), 5))


def _leaves(cells: DataFrame, depth: int, low: int, limit: int) -> DataFrame:
    """shard, depth, shard_bytes, shard_rows of the shallowest fitting prefixes of cells (cell, bytes, n).

    A cell that doesn't fit at `depth` itself is a leaf there, over the limit.
    """
    every = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth"))
    nodes = every.groupBy(F.expr("substring(cell, 1, depth)").alias("shard"), "depth").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
    # A prefix is a leaf if it fits (or is deepest) and its parent doesn't fit.
    parents = nodes.where(~fits).select(F.col("shard").alias("parent"))
    leaf = nodes.where(fits | (F.col("depth") == depth)).withColumn("parent", F.expr("substring(shard, 1, depth - 1)"))
    inner = leaf.where(F.col("depth") > low).join(parents, "parent", "left_semi")
    return inner.unionByName(leaf.where(F.col("depth") == low)).select("shard", "depth", "shard_bytes", "shard_rows")


def directory(hashed: DataFrame, limit: int) -> DataFrame:
    """shard (hash prefix), depth, shard_bytes, shard_rows; hashed: columns __hash, __bytes."""
    total = hashed.agg(F.sum("__bytes")).first()[0] or 0
    depth = min(MAX_DEPTH, max(4, (16 * total // limit).bit_length()))
    low, out, rest = 0, None, hashed
    while True:
        cells = rest.groupBy(F.expr(f"substring(__hash, 1, {depth})").alias("cell")).agg(F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        found = cut(_leaves(cells, depth, low, limit))
        over = found.where((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1))
        done = found if depth == MAX_DEPTH else found.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
        out = done if out is None else out.unionByName(done)
        if depth == MAX_DEPTH or over.isEmpty():
            return out
        rest = rest.join(over.select(F.col("shard").alias("__cell")), F.expr(f"substring(__hash, 1, {depth})") == F.col("__cell"), "left_semi")
        low, depth = depth + 1, min(MAX_DEPTH, depth + 12)


def shard(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """docs plus n_bytes, shard, depth, shard_bytes, page.

    shard is the hash prefix ('' while one shard is enough), with '/bytes/page'
    where equal rows are paged. shard_bytes is at most the limit unless the shard is a
    single row.
    """
    new = ("n_bytes", "shard", "depth", "shard_bytes", "page")
    own = [c for c in docs.columns if c.lower() not in new]
    hashed = docs.select(*[F.col(f"`{c}`") for c in own], _hash(docs).alias("__hash"), F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long").alias("__bytes"))
    leaves = cut(directory(hashed.select("__hash", "__bytes"), limit))
    size, shallow = leaves.agg(F.count(F.lit(1)), F.coalesce(F.min("depth"), F.lit(0))).first()
    cells = _cells(leaves, shallow)
    placed = hashed.withColumn("__cell", F.expr(f"substring(__hash, 1, {shallow})")).join(F.broadcast(cells) if size <= BROADCAST_SHARDS else cells, "__cell")
    placed = placed.withColumn("__leaf", F.filter("__leaves", lambda x: F.startswith(F.col("__hash"), x["shard"]))[0])
    placed = placed.select(*[F.col(f"`{c}`") for c in own], "__hash", "__bytes", F.col("__leaf.shard").alias("__shard"), F.col("__leaf.depth").alias("depth"), F.col("__leaf.shard_bytes").alias("shard_bytes"), F.col("__leaf.shard_rows").alias("shard_rows"))
    paged = _paged(placed, limit, own) if not leaves.where((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).isEmpty() else placed.withColumn("page", F.lit(None).cast("long"))
    name = F.when(F.col("page").isNull(), F.col("__shard")).otherwise(F.concat_ws("/", "__shard", F.col("__bytes").cast("string"), F.col("page").cast("string")))
    return paged.select(*[F.col(f"`{c}`") for c in own], F.col("__bytes").alias("n_bytes"), name.alias("shard"), "depth", "shard_bytes", "page")


def _cells(leaves: DataFrame, depth: int) -> DataFrame:
    """The leaves below each prefix of the shallowest depth, as one array."""
    entry = F.struct("shard", "depth", "shard_bytes", "shard_rows")
    return leaves.groupBy(F.expr(f"substring(shard, 1, {depth})").alias("__cell")).agg(F.collect_list(entry).alias("__leaves"))


def _paged(placed: DataFrame, limit: int, own: list[str]) -> DataFrame:
    """Split shards that no hash bit can split into pages of equal rows.

    Copies are numbered in two steps: within partitions of a materialised
    table, after the counts of the partitions before.
    """
    over = (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    rows = cut(placed.where(over)).withColumn("__part", F.spark_partition_id())
    key = ["__shard", "__bytes"]
    counts = rows.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__in"))
    earlier = W.partitionBy(*key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("__in").over(earlier), F.lit(0))).withColumn("__all", F.sum("__in").over(W.partitionBy(*key))).drop("__in")
    number = F.col("__before") + F.row_number().over(W.partitionBy(*key, "__part").orderBy("__hash")) - 1
    per_page = F.greatest(F.lit(limit) / F.col("__bytes"), F.lit(1)).cast("long")
    numbered = rows.join(before, [*key, "__part"]).withColumn("page", F.floor(number / per_page))
    numbered = numbered.withColumn("shard_bytes", F.least(per_page, F.col("__all") - F.col("page") * per_page) * F.col("__bytes"))
    cols = [*own, "__hash", "__bytes", "__shard", "depth", "shard_bytes", "shard_rows", "page"]
    rest = placed.where(~over).withColumn("page", F.lit(None).cast("long"))
    return numbered.select(*[F.col(f"`{c}`") for c in cols]).unionByName(rest.select(*[F.col(f"`{c}`") for c in cols]))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """Write one folder a shard. The only step that moves texts."""
    out = shard(docs, limit).withColumn("shard", F.concat(F.lit("p"), F.translate("shard", "/", "_")))
    out.repartition("shard").write.partitionBy("shard").parquet(path)


#: The same result by plain SQL down to 24 bits; equal rows over the limit would need pages.
ORACLE_SQL = f"""
WITH h AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         right(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) + (1::BIGINT << 40)), 40) AS bits
  FROM documents),
d AS (SELECT unnest(range(0, 25)) AS depth),
nodes AS (SELECT depth, substr(bits, 1, depth) AS shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS n FROM h, d GROUP BY ALL),
leaf AS (
  SELECT h.doc_id, h.n_bytes, h.bits, min(n.depth) AS depth
  FROM h JOIN nodes n ON n.shard = substr(h.bits, 1, n.depth) WHERE n.shard_bytes <= {LIMIT_BYTES} OR n.n = 1 GROUP BY ALL)
SELECT l.doc_id, l.n_bytes, n.shard, CAST(n.depth AS INTEGER) AS depth, n.shard_bytes
FROM leaf l JOIN nodes n ON n.depth = l.depth AND n.shard = substr(l.bits, 1, l.depth)
"""

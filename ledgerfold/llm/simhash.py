"""SimHash near-duplicates with pigeonring filtering.

Two 64-bit fingerprints are linked at 3 or fewer differing bits. The bits lie
in a ring of four 16-bit segments. By the pigeonring principle a linked pair
has a segment from which every chain of l consecutive segments holds at most
floor(3 l / 4) differences: 0, 1, 2 and 3 for l = 1 to 4. The first two
budgets become join keys: the first segment must be equal, and of the second,
cut into four parts, three must be equal (one difference spoils one part at
most). That makes 16 keys of 28 bits a fingerprint. Rows that meet under a key
are tested for the chain of three, then for the full Hamming distance.

Scale: equal fingerprints are merged before any key is made, so copies cost
one row. A key's rows are read in one sorted stream and give a spanning forest
of their links, never all pairs. Components are found by star steps over the
links (graph.py).

Defined results: a text without words (null, empty, blank) has fingerprint
zero and is linked like any other; fewer than three words make one shingle of
them all; a null doc_id never becomes a component_id unless all ids of the
component are null; repeated rows appear as often as they came.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, cut
from .graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BITS, SEGMENTS, WIDTH, PARTS, LIMIT = 64, 4, 16, 4, 3
#: Rows of two numbers that may be broadcast.
BROADCAST_ROWS = 1_000_000


def fingerprint(text: bytes | None, n: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of the lower-cased word n-shingles, repeats included."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest  # big-endian
    if len(words) <= n:
        return int.from_bytes(digest(joined, seed), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - n + 1].tolist()
    stops = (ends[n - 1 :] - 1).tolist()
    h = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, stops)]), np.uint8).reshape(-1, 8)
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65536):
        set_bits += np.unpackbits(h[k : k + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(h)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    """docs plus the fingerprint as a signed long."""

    def run(texts):
        for text in texts:
            f = fingerprint(text)
            yield (f - (1 << 64) if f >> 63 else f,)

    return add_columns(docs, ["text"], run, [(name, T.LongType())])


def ring_keys(fp):
    """The 16 keys of a fingerprint: which segment and part, then 28 bits."""
    keys = []
    for i in range(SEGMENTS):
        first = F.shiftrightunsigned(fp, 16 * (3 - i)).bitwiseAND(F.lit(0xFFFF))
        second = F.shiftrightunsigned(fp, 16 * (3 - (i + 1) % 4)).bitwiseAND(F.lit(0xFFFF))
        for part in range(PARTS):
            rest = second.bitwiseAND(F.lit(0xFFFF ^ (0xF << (4 * part))))
            keys.append(F.lit((i * PARTS + part) << 32).bitwiseOR(F.shiftleft(first, 16)).bitwiseOR(rest))
    return F.array(*keys)


def _linked(a: np.ndarray, b: np.ndarray, i: np.ndarray | int) -> np.ndarray:
    """Do a and b keep the budgets of the chains of three and four from segment i?"""
    x = a ^ b
    last = (np.asarray(i, np.uint64) + np.uint64(3)) % np.uint64(4)  # the segment outside the chain of three
    outside = (x >> (np.uint64(16) * (np.uint64(3) - last))) & np.uint64(0xFFFF)
    whole = np.bitwise_count(x)
    return (whole - np.bitwise_count(outside) <= 2) & (whole <= LIMIT)


def _forest(fps: np.ndarray, i: int, out: list) -> None:
    """Append links that connect what the linked pairs among fps connect.

    Breadth-first from each unseen fingerprint, one vectorised comparison with
    the unseen rest for every fingerprint.
    """
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _linked(rest, at, i)
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), at), found))
                queue.extend(found)
                rest = rest[~near]


def _links(batches):
    """Links from rows (key, fp) sorted by key; a key may run over batches."""
    held_key, held = None, []

    def close(key, parts):
        fps, out = np.unique(np.concatenate(parts)).astype(np.int64).view(np.uint64), []
        if len(fps) > 1:
            _forest(fps, (key >> 32) // PARTS, out)
        return out

    def batch(found):
        if found:
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(key):
            continue
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))
        found: list = []
        if held_key is not None and key[0] != held_key:
            found += close(held_key, held)
            held_key, held = None, []
        last = len(starts) - 1
        size = stops - starts
        inner = (np.arange(len(starts)) != last) & ((np.arange(len(starts)) != 0) | (held_key is None))
        two = starts[inner & (size == 2)]  # nearly all keys that more than one has
        if len(two):
            a, c = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            ok = _linked(a, c, ((key[two] >> 32) // PARTS).astype(np.uint64)) & (a != c)
            found.append((a[ok], c[ok]))
        for k in np.flatnonzero(inner & (size > 2)):
            found += close(int(key[starts[k]]), [fp[starts[k] : stops[k]]])
        if held_key is not None and last > 0:
            found += close(held_key, [*held, fp[: stops[0]]])
            held_key, held = None, []
        held_key = int(key[-1])
        held = [*held, fp[starts[last] :].copy()]
        yield from batch(found)
    if held_key is not None:
        yield from batch(close(held_key, held))


def links(fps: DataFrame) -> DataFrame:
    """Links u, v (signed fingerprints) that connect all distinct fingerprints of column fp as Hamming distance does."""
    keyed = fps.select("fp").distinct().select(F.explode(ring_keys(F.col("fp"))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "u long, v long").distinct()


def _row_of(docs: DataFrame) -> list:
    """128 bits that tell rows apart by id and text."""
    known = [F.col("doc_id").isNull(), F.col("doc_id").cast("string"), F.col("text").isNull(), F.col("text")]
    return [F.xxhash64(*known).alias("__row"), F.xxhash64(F.lit(1), *known[::-1]).alias("__row2")]


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): rows is doc_id, fp, __row, __row2 for each document; parts maps the fp of linked fingerprints to comp."""
    marked = docs.select(F.col("doc_id"), F.col("text"), *_row_of(docs))
    rows = cut(with_fingerprint(marked).select("doc_id", "fp", "__row", "__row2"))
    return rows, cut(components(links(rows)).select(F.col("node").alias("fp"), F.col("component").alias("comp")))


def with_component(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    rows, parts = classes(docs)
    of_fp = with_component(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), parts)
    least = of_fp.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_fp = of_fp.join(least, "comp").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: that of the smallest doc_id (nulls last, then by content).

    Rows that go are told by 128 bits of hash. Up to BROADCAST_ROWS of them are
    broadcast, so texts don't move; beyond that they are joined by shuffle. Of
    equal rows that stay, those alone are gathered and made one.
    """
    rows, parts = classes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("__row").alias("row"), F.col("__row2").alias("row2")))
    of_fp = with_component(rows.groupBy("fp").agg(first.alias("best")), parts)
    best = of_fp.groupBy("comp").agg(F.min("best").alias("best"))
    best_of = of_fp.select("fp", "comp").join(best.select("comp", F.col("best.row").alias("best"), F.col("best.row2").alias("best2")), "comp").select("fp", "best", "best2")
    judged = rows.groupBy("fp", "__row", "__row2").agg(F.count(F.lit(1)).alias("n")).join(best_of, "fp")
    stays = (F.col("__row") == F.col("best")) & (F.col("__row2") == F.col("best2"))
    marked = cut(judged.where(~stays | (F.col("n") > 1)).select("__row", "__row2", stays.alias("__stays")))
    n, n_equal = marked.agg(F.count(F.lit(1)), F.count(F.when(F.col("__stays"), 1))).first()
    on = lambda x: F.broadcast(x) if n <= BROADCAST_ROWS else x
    own = [F.col(f"`{c}`") for c in docs.columns]
    tagged = docs.select(*own, *_row_of(docs))
    keys = ["__row", "__row2"]
    out = tagged.join(on(marked.select(*keys)), keys, "left_anti")
    if n_equal:
        out = out.unionByName(tagged.join(on(marked.where("__stays").select(*keys)), keys, "left_semi").dropDuplicates(keys))
    return out.drop(*keys)

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the test items. All patterns of one table have the
same number of words. A text is read at every (m - 1)th block of two words: a
shift table, indexed by hash, tells how far behind such a block a pattern can
end at the earliest; where it knows none, all places up to the next block are
skipped. The remaining ends are looked up in buckets by the pattern's last
block (and its first), then word by word, and comparing the bytes confirms.

Items are dealt into blocks whose tables, as built, take `block_bytes` at
most. One pass over the documents searches block after block: tables of over
RESIDENT bytes in all are loaded anew for each batch of documents and let go,
so a worker holds one block, however large the benchmark. Documents are never
shuffled.

Defined results: null or empty text has no words and no hits; an item without
words has no window; equal items each count; a null item_id is ignored; extra
columns are kept, but for those named like a result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns
from .wordhash import NOT_WORD, hash_words

WINDOW = 13
BLOCK_BYTES, RESIDENT = 32 << 20, 64 << 20
#: Bytes of tables a byte of item text may make: a window of 25 bytes and some slots of the shift table for each word, words of one letter and a blank.
BUILT = 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Text:
    """The words of a text: their hashes, and, where they are asked for, the words."""

    def __init__(self, text: bytes | None):
        self.raw = text or b""
        self.h = hash_words(self.raw.lower(), NOT_WORD)[0]

    @cached_property
    def places(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        low = self.raw.lower()
        return low, *hash_words(low, NOT_WORD)[1:]

    def words(self, at: int, n: int) -> list[bytes]:
        low, start, stop = self.places
        return [low[a:b] for a, b in zip(start[at : at + n].tolist(), stop[at : at + n].tolist())]


def _blocks(h: np.ndarray, ends: np.ndarray, b: int) -> np.ndarray:
    """Hash of the b words before each end."""
    out = h[ends - 1] * _MIX
    return (out ^ (out >> np.uint64(31))) * _MIX if b == 1 else ((h[ends - 2] ^ (out >> np.uint64(29))) * _MIX)


class WuManber:
    """All occurrences of the windows of m words of some items (id, Text)."""

    def __init__(self, items: list[tuple[str, Text]], m: int):
        self.m, self.b = m, min(2, m)
        self.default = m - self.b + 1
        self.ids = [i for i, _ in items]
        self.items, self.starts, self.stops = zip(*(t.places for _, t in items))
        counts = np.array([len(t.h) for _, t in items])
        self.h = np.concatenate([t.h for _, t in items])
        self.head = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(items)), counts - m + 1)
        at = np.concatenate([np.arange(h, h + n - m + 1) for h, n in zip(self.head.tolist(), counts.tolist())])
        bits = max(8, int(2 * (counts.sum() + 1)).bit_length())
        self.right = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.default, np.uint8)
        for end in range(self.b, m + 1):
            np.minimum.at(self.shift, _blocks(self.h, at + end, self.b) >> self.right, m - end)
        key = self._key(self.h, at)
        order = np.argsort(key, kind="stable")
        self.key, self.at, self.owner = key[order], at[order], owner[order]

    @property
    def n_bytes(self) -> int:
        return sum(x.nbytes for x in (self.h, self.head, self.shift, self.key, self.at, self.owner, *self.starts, *self.stops)) + sum(map(len, self.items))

    def _key(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bucket of the windows at these places: by last block, then by first."""
        return _blocks(h, at + self.m, self.b) * _MIX ^ _blocks(h, at + self.b, self.b)

    def search(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) of each occurrence; one for each window that occurs there."""
        m, n, h = self.m, len(text.h), text.h
        none = np.empty(0, np.int64)
        if n < m:
            return none, none
        ends = np.arange(m, n + 1, self.default) if (n - m) % self.default == 0 else np.append(np.arange(m, n + 1, self.default), n)
        shift = self.shift[_blocks(h, ends, self.b) >> self.right].astype(np.int64)
        near = shift < self.default
        if not near.any():
            return none, none
        first, sizes = ends[near] + shift[near], self.default - shift[near]
        ends = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        ends = np.unique(ends[ends <= n])
        ends = ends[self.shift[_blocks(h, ends, self.b) >> self.right] == 0]
        at = ends - m
        key = self._key(h, at)
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        sizes = high - low
        place = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        at = np.repeat(at, sizes)
        for k in range(m):
            same = self.h[self.at[place] + k] == h[at + k]
            place, at = place[same], at[same]
        right = np.fromiter((self._equal(p, text, a) for p, a in zip(place.tolist(), at.tolist())), bool, len(at))
        return at[right], self.owner[place[right]]

    def _equal(self, place: int, text: Text, at: int) -> bool:
        k = self.owner[place]
        own = self.at[place] - self.head[k]
        a, b = self.starts[k][own : own + self.m].tolist(), self.stops[k][own : own + self.m].tolist()
        return [self.items[k][x:y] for x, y in zip(a, b)] == text.words(at, self.m)


def build(items: list[tuple], window: int = WINDOW) -> list[WuManber]:
    """Tables for (item_id, text bytes); one for each pattern length."""
    by_length: dict = defaultdict(list)
    for item, raw in items:
        text = Text(raw)
        if len(text.h) and item is not None:
            by_length[min(window, len(text.h))].append((str(item), text))
    return [WuManber(found, m) for m, found in sorted(by_length.items())]


def _merge(starts: np.ndarray, stops: np.ndarray) -> tuple[int, int]:
    """(words in the spans, words of the longest run of them)."""
    if not len(starts):
        return 0, 0
    order = np.argsort(starts, kind="stable")
    a, reach = starts[order], np.maximum.accumulate(stops[order])
    first = np.flatnonzero(np.append(True, a[1:] > reach[:-1]))
    sizes = np.append(reach[first[1:] - 1], reach[-1]) - a[first]
    return int(sizes.sum()), int(sizes.max())


_FIELDS = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("longest_hit", T.LongType())]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, share: int = 20, resident: int = RESIDENT, text: str = "text") -> DataFrame:
    """docs (with the texts in column `text`) plus n_words, n_hit, n_items, items_sha256, contaminated, longest_hit.

    contaminated: n_hit > 0 and share * n_hit >= n_words. longest_hit: hit words on end, at most.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n_blocks = max(1, -(-total * BUILT // block_bytes))
    block_of = F.pmod(F.xxhash64(F.col("item_id").cast("string"), F.col("text")), F.lit(n_blocks))
    blocks, built = [], 0
    for k in range(n_blocks):  # the driver holds one block at a time
        tables = build([(r["item_id"], bytes(r["text"]) if r["text"] is not None else None) for r in items.where(block_of == k).collect()], window)
        built += sum(t.n_bytes for t in tables)
        blocks.append(spark.sparkContext.broadcast(tables))
    keep = built <= resident

    def look(tables, text, a, b, found):
        for table in tables:
            at, owner = table.search(text)
            if len(at):
                a.append(at)
                b.append(at + table.m)
                found.update(table.ids[k] for k in set(owner.tolist()))

    def verdict(text, a, b, found):
        n = len(text.h)
        n_hit, longest = _merge(np.concatenate(a), np.concatenate(b)) if a else (0, 0)
        return n, n_hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n_hit > 0 and share * n_hit >= n, longest

    def run(raw):
        if keep:
            tables = [t for block in blocks for t in block.value]
            for text in map(Text, raw):
                state = (text, [], [], set())
                look(tables, *state)
                yield verdict(*state)
            return
        states = [(Text(t), [], [], set()) for t in raw]
        for block in blocks:
            for state in states:
                look(block.value, *state)
            vars(block).pop("_value", None)  # what the worker has loaded of this broadcast
        yield from (verdict(*state) for state in states)

    return add_columns(docs, [text], run, _FIELDS)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **how) -> DataFrame:
    """The documents without a benchmark passage, with their own columns.

    A document goes if `window` or more words on end are benchmark words (any
    hit of an item of that length, however long the document), or if it is
    contaminated by share. A shorter item alone, which may be an everyday
    phrase, counts only by share.
    """
    own = [c for c in docs.columns]
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"__d{i}") for i, c in enumerate(own)])
    marked = contamination(renamed, benchmark, window=window, text=f"__d{own.index('text')}", **how)
    return marked.where(~F.col("contaminated") & (F.col("longest_hit") < window)).select(*[F.col(f"__d{i}").alias(c) for i, c in enumerate(own)])


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
pattern AS (SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS g FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM i)),
place AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM pattern)),
found AS (SELECT doc_id, p, s.m, item_id FROM (SELECT doc_id, p, m, array_to_string(w[p : p + m - 1], ' ') AS g FROM place) s JOIN pattern USING (m, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM found) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)
"""

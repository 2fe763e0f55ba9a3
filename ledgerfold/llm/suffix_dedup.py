"""Repeated byte strings by prefix-free parsing, and passages that documents share.

Every byte goes that lies in a string of `LENGTH` bytes which starts anywhere
else, in any document. A text is parsed where a rolling hash of 16 bytes
triggers (on average every 64 bytes), so equal strings are parsed alike
wherever they stand.

Round 1 finds the parts of the corpus whose order is in question at all. A
string of LENGTH bytes is told by its first trigger t and its bytes before and
after. All strings that have t first lie in the "outer" string, from the
trigger before (not included) to LENGTH bytes after t, and each of them holds
the HALF bytes after t (or before t, for those that begin further ahead): its
"half" string. So equal strings have equal halves; equal outer strings have
equal strings throughout, all of which go; and where one half has only one
outer string, nothing is left to ask.

Round 2 orders the rest. One text of each outer string sends it to the bucket
of its half. There its phrases make a sorted dictionary and a parse. The parse
gets a suffix array (by ranks of phrases), the dictionary another one (of the
phrases' bytes); both together are the bucket's corpus order: strings that
begin with equal suffixes of a phrase, by the place of what follows in the
parse. Neighbours in it that agree on LENGTH bytes (range minima over the
common prefixes of the parse order) repeat. Two kinds of strings skip the
arrays and meet by fingerprint instead: those without a trigger (inside one
long phrase), and those of a half with over HOT outer strings, whose bucket
would be the whole of a hot group.

Passages: in the same rounds, with words for bytes, the operator finds the
words in runs of PASSAGE words or more that stand in another document too.
Words are [^\x20\x09-\x0D]+ as written; the white space between may differ. The
anchor of a run is the least hash of eight words in it instead of a trigger.

Scale: entries travel as packed arrays, one row for each Arrow batch and
bucket; a batch or block sends what it holds more than once only once, so hot
strings shrink before the shuffle. A bucket and a block hold a bounded share
of the bytes. Texts move once (a task sends equal rows once), and again
(compressed) where round 2 has to look. Nothing is collected.

Defined results: null text is empty; a text of under LENGTH bytes stays whole;
equal rows are occurrences of each other (for passages: one document); matches
never cross documents; a null id is an id. Texts are told apart by 128 bits of
hash, strings by 80; two different ones are taken for equal with a chance of
2**-128 and 2**-80 a pair.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .wordhash import SPACE, hash_words

LENGTH, HALF, TRIGGER, EVERY = 400, 200, 16, 64
PASSAGE, ANCHOR = 50, 8
BLOCK_BYTES = 8 << 20
#: Outer strings of one half from which on its strings are spread by fingerprint.
HOT = 4096
_B = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_TEXT = [("uid", "<i8"), ("check", "<i8")]
ENTRY = np.dtype([("hi", "<u8"), ("lo", "<u2"), *_TEXT, ("at", "<u4"), ("n", "u1")])
PHRASE = np.dtype([("hi", "<u8"), ("lo", "<u2"), ("outer_hi", "<u8"), ("outer_lo", "<u2"), *_TEXT, ("at", "<u4"), ("n", "u1")])
OUTER = np.dtype([("hi", "<u8"), *_TEXT, ("at", "<u4"), ("starts", "<u2"), ("before", "<u2"), ("size", "<u2")])
MARK = np.dtype([*_TEXT, ("at", "<u4"), ("n", "<u2"), ("what", "u1")])
#: An `at` that stands for several entries of a batch.
SEVERAL = 0xFFFFFFFF
#: Bits of `what`: row `at` of the parse repeats; it has to give its outer string, or (SPREAD) its strings, or (TWICE) strings that
#: count as two; the text has strings without a trigger; strings from position `at` on repeat; all that in words.
REPEATS, GIVE, SPREAD, TWICE, OPEN, STRING, WORDS = 1, 2, 4, 8, 16, 32, 64


# --- texts as strings to compare


def triggers(text: bytes) -> np.ndarray:
    """Positions at which the hash of the next 16 bytes triggers."""
    if len(text) < TRIGGER:
        return np.empty(0, np.int64)
    h = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    power, width = _B, 1
    while width < TRIGGER:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % (1 << 64), width * 2
    return np.flatnonzero(((h * _MIX) >> np.uint64(58)) == 0)


def parse(text: bytes) -> tuple[np.ndarray, ...]:
    """(triggers, half_start, half_stop, outer_start, outer_stop, first, last) of a text, in a fixed order.

    A row is a trigger with strings that have it first: they start from `first`
    to `last`. A trigger has a second row for strings that start over HALF bytes ahead.
    """
    return parse_rows(text)[:7]


def parse_rows(text: bytes) -> tuple[np.ndarray, ...]:
    """The same and each row's trigger."""
    n, t = len(text), triggers(text)
    before = np.concatenate(([-1], t[:-1])) if len(t) else t
    start = np.maximum(np.maximum(before + 1, t - (LENGTH - TRIGGER)), 0)
    stop = np.minimum(t + LENGTH, n)
    near, far = np.maximum(start, t - HALF), np.minimum(t - HALF - 1, n - LENGTH)
    last = np.minimum(t, n - LENGTH)
    a, b = near <= last, start <= far
    joined = lambda x, y: np.concatenate((x[a], y[b])).astype(np.int64)
    return t, joined(t, t - HALF), joined(t + HALF, t), joined(start, start), joined(stop, stop), joined(near, start), joined(last, far), joined(t, t)


def open_starts(t: np.ndarray, n: int) -> np.ndarray:
    """Starts of the strings of a text of n bytes that hold no trigger."""
    edges = np.concatenate(([-1], t, [n - TRIGGER + 1]))
    gaps = np.flatnonzero(np.diff(edges) > LENGTH - TRIGGER + 1)
    runs = [np.arange(edges[k] + 1, edges[k + 1] - (LENGTH - TRIGGER)) for k in gaps]
    return np.concatenate(runs) if runs and n >= LENGTH else np.empty(0, np.int64)


def words(text: bytes) -> np.ndarray:
    return hash_words(text, SPACE)[0]


def _least_at(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value (of its upper bits; the first of equal ones) in each window of `width`."""
    bits = np.uint64(max(1, len(g).bit_length()))
    least, have = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64), 1
    while 2 * have <= width:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < width:
        least = np.minimum(least[: len(g) - width + 1], least[width - have :])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def parse_words(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same seven arrays for runs of PASSAGE words: each run is told by the least hash of ANCHOR words in it, the first of equal ones."""
    n = len(h)
    if n < PASSAGE:
        return (np.empty(0, np.int64),) * 7
    g, power, width = h, _B, 1
    while width < ANCHOR:
        g = g[:-width] * np.uint64(power) + g[width:]
        power, width = power * power % (1 << 64), width * 2
    g = (g ^ (g >> np.uint64(31))) * _MIX
    at = _least_at(g, PASSAGE - ANCHOR + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], n - PASSAGE + 1) - 1
    t = at[first]
    return t, t, t + ANCHOR, first, last + PASSAGE, first, last


# --- entries


def _digests(buffer: bytes, starts, stops, seed: int, width: int) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    joined = b"".join([digest(buffer[a:b], seed) for a, b in zip((starts * width).tolist(), (stops * width).tolist())])
    return np.frombuffer(joined, np.dtype([("hi", "<u8"), ("lo", "<u2"), ("rest", "V6")]))


def _entries(buffer: bytes, text: tuple[int, int], starts: np.ndarray, kind: Kind, n: np.ndarray | int = 1) -> np.ndarray:
    d = _digests(buffer, starts, starts + kind.length, 3, kind.width)
    out = np.empty(len(d), ENTRY)
    out["hi"], out["lo"], out["at"], out["n"] = d["hi"], d["lo"], starts, n
    out["uid"], out["check"] = text
    return out


def _phrases(buffer: bytes, text: tuple[int, int], rows: tuple[np.ndarray, ...], width: int) -> np.ndarray:
    _, half_start, half_stop, outer_start, outer_stop, _, _ = rows
    half, outer = _digests(buffer, half_start, half_stop, 1, width), _digests(buffer, outer_start, outer_stop, 2, width)
    out = np.empty(len(half), PHRASE)
    out["hi"], out["lo"], out["outer_hi"], out["outer_lo"] = half["hi"], half["lo"], outer["hi"], outer["lo"]
    out["at"], out["n"] = np.arange(len(half)), 1
    out["uid"], out["check"] = text
    return out


def _sorted(e: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    return e[np.lexsort([e[n] for n in reversed(names)])]


def _changes(e: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(e), bool)
    if len(e):
        new[1:] = np.logical_or.reduce([e[n][1:] != e[n][:-1] for n in names])
    return new


def _marks(e: np.ndarray, what, n: np.ndarray | int = 1) -> np.ndarray:
    out = np.empty(len(e), MARK)
    out["uid"], out["check"], out["at"], out["n"], out["what"] = e["uid"], e["check"], e["at"], n, what
    return out


HALVES, PRINT, ID = ("hi", "lo"), ("hi", "lo"), ("uid", "check")
WHOLE = (*HALVES, "outer_hi", "outer_lo")


@dataclass(frozen=True)
class Kind:
    """What strings are made of, and what makes one repeat: any other place, or (across) another document."""

    length: int
    width: int
    across: bool
    flag: int

    def _times(self, e: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run of each row, times of each run) of sorted rows; rows sent for several count as two."""
        run = np.cumsum(new) - 1
        if not self.across:
            return run, np.bincount(run, weights=e["n"])
        other = new | _changes(e, ID)
        return run, np.bincount(run, weights=other) + np.bincount(run, weights=e["n"] > 1)

    def combine(self, e: np.ndarray, names: tuple[str, ...], what: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries to send, marks known already) of a batch: strings that repeat in it are sent once, as two."""
        e = _sorted(e, (*names, *ID))
        new = _changes(e, names)
        run, times = self._times(e, new)
        several = times[run] > 1
        sent = e[new | ~several].copy()
        sent["n"][several[new | ~several]] = 2
        if what == STRING:
            sent["at"][sent["n"] > 1] = SEVERAL
            several &= e["at"] != SEVERAL
        return sent, _marks(e[several], what | self.flag)

    def judge_phrases(self, e: np.ndarray, hot: int = HOT) -> np.ndarray:
        """Marks of a bucket's phrases."""
        e = _sorted(e, (*WHOLE, *ID))
        new, half_new = _changes(e, WHOLE), _changes(e, HALVES)
        run, times = self._times(e, new)
        half = np.cumsum(half_new) - 1
        kinds = np.bincount(half, weights=new)[half]
        repeats, give = (times[run] > 1) & (e["n"] == 1), (new | (times[run] == 1)) & (kinds > 1)
        what = np.where(repeats, REPEATS, 0) | np.where(give, GIVE, 0) | np.where(give & (kinds > hot), SPREAD, 0) | np.where(give & (times[run] > 1), TWICE, 0)
        found = what > 0
        return _marks(e[found], what[found] | self.flag)

    def judge_strings(self, e: np.ndarray) -> np.ndarray:
        e = _sorted(e, (*PRINT, *ID))
        run, times = self._times(e, _changes(e, PRINT))
        return _marks(e[(times[run] > 1) & (e["at"] != SEVERAL)], STRING | self.flag)


BYTES, RUNS = Kind(LENGTH, 1, False, 0), Kind(PASSAGE, 8, True, WORDS)


# --- suffix arrays of a bucket


def ranks(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank (from 1, equal ones alike) of the suffix at each position, cut off before ends[position]: prefix doubling."""
    n = len(symbols)
    if not n:
        return np.empty(0, np.int64)
    found, r = np.unique(symbols, return_inverse=True)
    r, known, width, place = r.astype(np.int64) + 1, len(found), 1, np.arange(n)
    while True:
        after = place + width
        key = (r << 32) | np.where(after < ends, r[np.minimum(after, n - 1)], 0)
        found, inverse = np.unique(key, return_inverse=True)
        if len(found) == known:
            return r
        r, known, width = inverse.astype(np.int64) + 1, len(found), 2 * width


def _least(values: np.ndarray) -> list[np.ndarray]:
    """Minima of values over windows of 1, 2, 4 ... places."""
    out = [values]
    while len(out[-1]) > (width := 1 << (len(out) - 1)):
        out.append(np.minimum(out[-1][:-width], out[-1][width:]))
    return out


def _span(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number in it) of all places of runs of these sizes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def repeated_strings(rows: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """Marks of all strings of LENGTH bytes that begin in the first `starts` bytes of the outer strings and stand there twice.

    `before`: bytes ahead of the trigger. The phrase up to it is a word of the
    dictionary, what follows from it on is parsed.
    """
    starts, before = rows["starts"].astype(np.int64), rows["before"].astype(np.int64)
    # The dictionary's suffix array, of the phrases that strings begin in.
    words = [s[: b + TRIGGER] for s, b in zip(strings, before.tolist())]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    begin = np.cumsum(sizes) - sizes
    suffix = ranks(np.frombuffer(b"".join(number), np.uint8), np.repeat(begin + sizes, sizes))
    # The parse and its suffix array.
    right = [s[b:] for s, b in zip(strings, before.tolist())]
    size = np.fromiter(map(len, right), np.int64, len(right))
    from_, text = np.cumsum(size) - size, b"".join(right)
    t = triggers(text)
    owner = np.searchsorted(from_, t, "right") - 1
    inside = t + TRIGGER <= from_[owner] + size[owner]
    t, owner = t[inside], owner[inside]
    t = np.concatenate((t, from_))  # each begins a phrase, whether or not the cut text still shows its trigger
    owner = np.concatenate((owner, np.arange(len(right))))
    t, keep = np.unique(t, return_index=True)
    owner = owner[keep]
    follows = np.append(owner[1:] == owner[:-1], False)
    stop = np.where(follows, np.append(t[1:], 0) + TRIGGER, from_[owner] + size[owner])
    phrases = [text[a:b] for a, b in zip(t.tolist(), stop.tolist())]
    place = {w: k for k, w in enumerate(sorted(set(phrases)))}
    counts = np.bincount(owner, minlength=len(right))
    heads = np.cumsum(counts) - counts
    order = ranks(np.fromiter((place[w] for w in phrases), np.int64, len(phrases)), np.repeat(heads + counts, counts))[heads]
    # Common prefixes of neighbours in the order of the parse.
    _, one, rank = np.unique(order, return_index=True, return_inverse=True)
    table = np.frombuffer(b"".join(right[k].ljust(LENGTH, b"\0") for k in one.tolist()), np.uint8).reshape(-1, LENGTH)
    width = size[one]
    differ = table[1:] != table[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    minima = _least(np.minimum(common, np.minimum(width[1:], width[:-1])))
    # Corpus order: suffix of the dictionary, then place in the parse.
    o, j = _span(starts)
    key = (suffix[begin[np.fromiter((number[w] for w in words), np.int64, len(words))][o] + j] << 32) | rank[o]
    by = np.argsort(key, kind="stable")
    low, high, same = rank[o[by[:-1]]], rank[o[by[1:]]], (key[by[1:]] >> 32) == (key[by[:-1]] >> 32)
    shared = width[low]  # equal contexts
    more = same & (low < high)
    level = np.log2(np.maximum(high - low, 1)).astype(np.int64)
    for k in np.unique(level[more]).tolist():
        at = more & (level == k)
        shared[at] = np.minimum(minima[k][low[at]], minima[k][high[at] - (1 << k)])
    enough = same & (shared >= LENGTH - (before[o] - j)[by[1:]])
    found = np.zeros(len(o), bool)
    found[by[1:][enough]] = True
    found[by[:-1][enough]] = True
    first = found & ~(np.append(False, found[:-1]) & (j > 0))
    heads = np.flatnonzero(first)
    run = np.cumsum(first)[found] - 1
    e = rows[o[heads]]
    out = _marks(e, STRING, np.bincount(run, minlength=len(heads)))
    out["at"] = e["at"] + j[heads]
    return out


# --- packing


def pack(a: np.ndarray) -> bytes:
    """Column by column, ids and positions as differences, compressed."""
    cols = [np.diff(a[n], prepend=a.dtype[n].type(0)) if n in ("uid", "check", "at") else a[n] for n in a.dtype.names]
    return zstandard.ZstdCompressor(level=1).compress(len(a).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in cols))


def _read(raw: bytes, kind: np.dtype) -> tuple[np.ndarray, int]:
    n, at = int.from_bytes(raw[:8], "little"), 8
    out = np.empty(n, kind)
    for name in kind.names:
        col = np.frombuffer(raw, kind[name], n, at)
        out[name] = np.cumsum(col, dtype=kind[name]) if name in ("uid", "check", "at") else col
        at += n * kind[name].itemsize
    return out, at


def unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    return _read(zstandard.ZstdDecompressor().decompress(blob), kind)[0]


def pack_outers(rows: np.ndarray, strings: list[bytes]) -> bytes:
    head = len(rows).to_bytes(8, "little")
    cols = [np.diff(rows[n], prepend=rows.dtype[n].type(0)) if n in ("uid", "check", "at") else rows[n] for n in rows.dtype.names]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in cols) + b"".join(strings))


def unpack_outers(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    rows, at = _read(raw, OUTER)
    stops = at + np.cumsum(rows["size"].astype(np.int64))
    return rows, [raw[b - n : b] for b, n in zip(stops.tolist(), rows["size"].tolist())]


def _groups(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return [(int(keys[k[0]]), k) for k in np.split(order, cuts) if len(k)]


def _deal(values: np.ndarray, keys: np.ndarray) -> list[tuple[int, bytes]]:
    return [(key, pack(values[k])) for key, k in _groups(keys)]


#: A bucket holds one sort of entries: its number modulo SORTS tells which.
SORTS, OUTERS = 3, 2


def send(parts: list[np.ndarray], sort: int, names: tuple[str, ...], what: int, n_buckets: int) -> tuple[list[tuple], np.ndarray]:
    """(rows for buckets, marks known already) of a batch's entries."""
    if not parts:
        return [], np.empty(0, MARK)
    sent, known = (BYTES, RUNS)[sort].combine(np.concatenate(parts), names, what)
    sent = sent[np.lexsort((sent["at"], sent["check"], sent["uid"]))]  # equal ids side by side compress
    return [(SORTS * k + sort, 0, blob, None) for k, blob in _deal(sent, (sent["hi"] % np.uint64(n_buckets)).astype(np.int64))], known


def send_outers(rows: list[tuple], strings: list[bytes], n_buckets: int) -> list[tuple]:
    if not rows:
        return []
    a = np.array(rows, OUTER)
    return [(SORTS * key + OUTERS, 0, pack_outers(a[k], [strings[x] for x in k.tolist()]), None) for key, k in _groups((a["hi"] % np.uint64(n_buckets)).astype(np.int64))]


def send_marks(marks: list[np.ndarray], n_buckets: int, n_blocks: int) -> list[tuple]:
    """Marks on their way to blocks, by way of some bucket."""
    m = np.concatenate(marks) if marks else np.empty(0, MARK)
    return [(SORTS * (k % n_buckets), k, None, blob) for k, blob in _deal(m, m["uid"] % n_blocks)] if len(m) else []


_SENT = "bucket int, block int, entries binary, marks binary"
_MARKED = "block int, marks binary"


def _sent(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "block", "entries", "marks"])


def judged(sent: DataFrame, n_blocks: int, first: bool, hot: int = HOT) -> DataFrame:
    """Marks, by block, that each bucket's entries get, and those that came along."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [b for b in table.column("entries").to_pylist() if b]
        out = [(k, m) for k, m in zip(table.column("block").to_pylist(), table.column("marks").to_pylist()) if m]
        if blobs:
            sort = table.column("bucket")[0].as_py() % SORTS
            if sort == OUTERS:
                got = [unpack_outers(b) for b in blobs]
                m = repeated_strings(np.concatenate([rows for rows, _ in got]), [s for _, strings in got for s in strings])
            elif first:
                m = (BYTES, RUNS)[sort].judge_phrases(np.concatenate([unpack(b, PHRASE) for b in blobs]), hot)
            else:
                m = (BYTES, RUNS)[sort].judge_strings(np.concatenate([unpack(b, ENTRY) for b in blobs]))
            m = m[np.lexsort((m["at"], m["check"], m["uid"]))]
            out += _deal(m, m["uid"] % n_blocks) if len(m) else []
        cols = list(zip(*out)) or [(), ()]
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], names=["block", "marks"])

    return sent.groupBy("bucket").applyInArrow(run, _MARKED)


# --- texts and their marks


def _by_text(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Each text's marks."""
    blobs = [unpack(b, MARK) for b in table.column("marks").to_pylist() if b]
    if not blobs:
        return {}
    m = _sorted(np.concatenate(blobs), ID)
    heads = np.flatnonzero(_changes(m, ID))
    return {(int(m["uid"][k]), int(m["check"][k])): part for k, part in zip(heads.tolist(), np.split(m, heads[1:]))}


def cover(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n bytes the strings cover."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    return np.cumsum(depth[:n]) > 0


def covered(marks: np.ndarray, rows: tuple[np.ndarray, ...], n: int, kind: Kind) -> np.ndarray:
    """Which of the n bytes (or words) of a text the marks cover; rows is its parse."""
    repeats, strings = marks["at"][marks["what"] & REPEATS > 0].astype(np.int64), marks[marks["what"] & STRING > 0]
    from_ = strings["at"].astype(np.int64)
    to = from_ + strings["n"] - 1 + kind.length
    if (len(repeats) and repeats.max() >= len(rows[3])) or (len(to) and to.max() > n):
        raise ValueError("a mark lies outside its text: two texts share 128 bits of hash")
    return cover(n, np.concatenate((rows[3][repeats], from_)), np.concatenate((rows[4][repeats], to)))


def _split(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = marks["what"] & WORDS > 0
    return marks[~words], marks[words]


def _asked(marks: np.ndarray, spread: bool) -> np.ndarray:
    """Rows of a parse to give, each once: as outer strings or, spread, string by string."""
    bits = marks["what"] & (GIVE | SPREAD)
    return np.unique(marks["at"][bits == (GIVE | SPREAD if spread else GIVE)]).astype(np.int64)


def _strings(at: np.ndarray, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, row) of the strings of rows `at`."""
    o, j = _span(rows[6][at] - rows[5][at] + 1)
    return rows[5][at][o] + j, at[o]


def _outcome(text: bytes, gone: np.ndarray | None) -> tuple[int, int, int, str, str]:
    """n_bytes, n_removed, n_spans, kept_sha256, spans."""
    if gone is None or not gone.any():
        return len(text), 0, 0, hashlib.sha256(text).hexdigest(), ""
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    spans = ",".join(f"{a}:{b}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
    return len(text), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), spans


def _once_a_task(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, uid, check) plus times: of equal rows a task sends the first, and at its end how many more there were."""

    def run(batches):
        seen: dict[tuple[int, int], int] = {}
        schema = None
        ids: dict = {}
        for b in batches:
            schema = b.schema
            uids, checks = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = []
            for k, key in enumerate(zip(uids, checks)):
                seen[key] = seen.get(key, 0) + 1
                if seen[key] == 1:
                    keep.append(k)
                elif seen[key] == 2:
                    ids[key] = b.column(0)[k].as_py()
            part = b if len(keep) == b.num_rows else b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([1] * part.num_rows, pa.int64())], names=[*schema.names, "times"])
        if ids:
            cols = [list(ids.values()), [None] * len(ids), [k[0] for k in ids], [k[1] for k in ids]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, schema)), pa.array([seen[k] - 1 for k in ids], pa.int64())], names=[*schema.names, "times"])

    return docs.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField("times", T.LongType())]))


_RESULT = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("spans", T.StringType()), ("n_shared_words", T.LongType()), ("n_passages", T.LongType())]


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end, byte offsets), n_shared_words, n_passages (runs of these) of each document."""
    id_type = docs.schema["doc_id"].dataType
    base = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    id_text = F.col("doc_id").cast("string")
    base = base.withColumn("uid", F.xxhash64(id_text, F.col("doc_id").isNull(), "text")).withColumn("check", F.xxhash64(F.lit(1), "text", id_text))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = n_buckets = max(1, -(-total // block_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def scan(batches):
        for b in batches:
            strings, runs, marks = [], [], []
            for text, *of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if len(text) >= LENGTH:
                    rows = parse(text)
                    strings.append(_phrases(text, of, rows, 1))
                    if len(open_starts(rows[0], len(text))):
                        marks.append(np.array([(*of, SEVERAL, 1, OPEN)], MARK))
                if len(text) >= 2 * PASSAGE - 1 and len(h := words(text)) >= PASSAGE:
                    runs.append(_phrases(h.tobytes(), of, parse_words(h), 8))
            out = []
            for sort, parts in enumerate((strings, runs)):
                sent, known = send(parts, sort, WHOLE, REPEATS, n_buckets)
                out += sent
                marks.append(known)
            yield _sent(out + send_marks(marks, n_buckets, n_blocks))

    first = cut(judged(base.select("text", "uid", "check").mapInArrow(scan, _SENT), n_blocks, True, hot))
    by_block = _once_a_task(base).withColumn("block", F.pmod("uid", F.lit(n_blocks)).cast("int"))
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(*x) for x in _RESULT], T.StructField("times", T.LongType())])
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def texts_of(table: pa.Table):
        return zip(table.column("text").to_pylist(), zip(table.column("uid").to_pylist(), table.column("check").to_pylist()))

    def give(texts: pa.Table, marked: pa.Table) -> pa.Table:
        marks, strings, runs, outers, bytes_of = _by_text(marked), [], [], [], []
        done = set()
        for text, of in texts_of(texts) if marks else ():
            if text is None or of not in marks or of in done:  # equal rows give the same
                continue
            done.add(of)
            of_bytes, of_words = _split(marks[of])
            if (of_bytes["what"] & (GIVE | OPEN)).any():
                rows = parse_rows(text)
                at = _asked(of_bytes, False)
                half = _digests(text, rows[1][at], rows[2][at], 1, 1)["hi"]
                for hi, stop, a, last, t in zip(half.tolist(), *(rows[k][at].tolist() for k in (4, 5, 6, 7))):
                    outers.append((hi, *of, a, last - a + 1, t - a, stop - a))
                    bytes_of.append(text[a:stop])
                starts = [_strings(_asked(of_bytes, True), rows)[0]]
                if (of_bytes["what"] & OPEN).any():
                    starts.append(open_starts(rows[0], len(text)))
                if len(starts := np.concatenate(starts)):
                    strings.append(_entries(text, of, starts, BYTES))
            if (of_words["what"] & GIVE).any():
                h = words(text)
                rows = parse_words(h)
                at = np.unique(of_words["at"][of_words["what"] & GIVE > 0]).astype(np.int64)
                twice = np.unique(of_words["at"][of_words["what"] & TWICE > 0])
                starts, row = _strings(at, rows)
                runs.append(_entries(h.tobytes(), of, starts, RUNS, np.where(np.isin(row, twice), 2, 1)))
        out = send_outers(outers, bytes_of, n_buckets)
        known = []
        for sort, parts in enumerate((strings, runs)):
            sent, m = send(parts, sort, PRINT, STRING, n_buckets)
            out += sent
            known.append(m)
        return pa.Table.from_batches([_sent(out + send_marks(known, n_buckets, n_blocks))])

    def finish(texts: pa.Table, marked: pa.Table) -> pa.Table:
        marks, found, rows = _by_text(marked), {}, []
        times = texts.column("times").to_pylist()
        for text, of in texts_of(texts):
            if text is None or of in found:
                continue
            gone, shared = None, np.empty(0, bool)
            if of in marks:
                of_bytes, of_words = _split(marks[of])
                if (of_bytes["what"] & (REPEATS | STRING)).any():
                    gone = covered(of_bytes, parse(text), len(text), BYTES)
                if (of_words["what"] & (REPEATS | STRING)).any():
                    h = words(text)
                    shared = covered(of_words, parse_words(h), len(h), RUNS)
            found[of] = (*_outcome(text, gone), int(shared.sum()), int((np.diff(shared.astype(np.int8), prepend=0) > 0).sum()))
        for (_, of), n in zip(texts_of(texts), times):
            rows.append((*found[of], n))
        got = list(zip(*rows)) or [()] * len(arrow)
        ids = texts.column("doc_id").combine_chunks() if texts.num_rows else pa.nulls(0, texts.schema.field("doc_id").type)
        return pa.table([ids, *[pa.array(c, t) for c, t in zip(got, arrow)]], names=schema.names)

    # Both passes read texts by block: one shuffle, used twice.
    given = by_block.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(give, _SENT)
    every = first.unionByName(judged(given, n_blocks, False))
    out = by_block.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(finish, schema)
    return out.withColumn("__k", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("__k", "times")


_PART = 512  # bytes; SQL takes strings of parts, as substr walks long texts from their start
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
part AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 2 * ({_PART} + {LENGTH})) AS h FROM (SELECT doc_id, h, n, unnest(range(0, n, {_PART})) AS c FROM d)),
byte AS (SELECT doc_id, p, substr(h, 2 * (p - c) - 1, 2) AS x, CASE WHEN p + {LENGTH} - 1 <= n THEN md5(substr(h, 2 * (p - c) - 1, {2 * LENGTH})) END AS g
         FROM (SELECT doc_id, h, n, c, unnest(range(c + 1, least(c + {_PART}, n) + 1)) AS p FROM part)),
again AS (SELECT g FROM byte WHERE g IS NOT NULL GROUP BY g HAVING count(*) > 1),
flag AS (SELECT b.doc_id, b.p, b.x, CASE WHEN a.g IS NOT NULL THEN b.p END AS start FROM byte b LEFT JOIN again a ON a.g = b.g),
cover AS (SELECT doc_id, p, x, coalesce(max(start) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) > p - {LENGTH}, false) AS gone FROM flag),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM cover),
word AS (SELECT doc_id, md5(coalesce(text, '')) AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
run AS (SELECT doc_id, t, p, md5(array_to_string(w[p : p + {PASSAGE - 1}], ' ')) AS g FROM (SELECT doc_id, t, w, unnest(range(1, len(w) - {PASSAGE - 2})) AS p FROM word)),
held AS (SELECT g FROM run GROUP BY g HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t) > 1),
place AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS later, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS previous FROM run SEMI JOIN held USING (g)),
passage AS (SELECT doc_id, sum(least({PASSAGE}, coalesce(later - p, {PASSAGE}))) AS n_shared_words, count(*) FILTER (previous IS NULL OR p > previous + {PASSAGE}) AS n_passages FROM place GROUP BY doc_id),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM edge GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256,
       CAST(coalesce(n_shared_words, 0) AS BIGINT) AS n_shared_words, coalesce(n_passages, 0) AS n_passages
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN passage USING (doc_id)
"""

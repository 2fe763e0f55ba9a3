import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfold.llm import suffix_dedup as sd
from ledgerfold.llm import wordhash
from tests.llm.helpers import awkward, docs


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    n = sd.LENGTH
    seen = Counter(b[p : p + n] for b in raw for p in range(len(b) - n + 1))
    out = []
    for b in raw:
        covered = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                covered[p : p + n] = b"\1" * n
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out.append((len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts, n=sd.PASSAGE):
    """(words in runs of n words that another document holds too, maximal runs of them)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    holders = {}
    for k, w in enumerate(words):
        for p in range(len(w) - n + 1):
            holders.setdefault(tuple(w[p : p + n]), set()).add(k)
    out = []
    for w in words:
        hit = bytearray(len(w))
        for p in range(len(w) - n + 1):
            if len(holders[tuple(w[p : p + n])]) > 1:
                hit[p : p + n] = b"\1" * n
        out.append((sum(hit), sum(x and not (k and hit[k - 1]) for k, x in enumerate(hit))))
    return out


def some_texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(r.randrange(20, 400)) for _ in range(25)]
    shared = [prose(k) for k in (85, 100, 110, 130, 300)]
    for _ in range(30):
        texts.append(prose(r.randrange(0, 60)) + r.choice(shared) + prose(r.randrange(0, 60)))
    for _ in range(10):  # near copies: one byte changed
        t = list(r.choice(texts))
        t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    texts += [texts[0], texts[0], "a" * 1000, "b" * 399, "c" * 400, "c" * 401, "d" * 400, "e" * 400, "e" * 400, None, "", "ab" * 700]
    base = prose(600).encode()[:399].decode(errors="ignore")
    texts += ["x" + base + "y", base, "z" + base]
    low = "0" * 900
    texts += [low[:450] + "1" + low[:450], low[:420] + "2"]
    texts.append(" ".join([prose(60)] * 3))  # repeats in one document only
    for _ in range(12):  # passages with other white space, ends inside a passage, two in one text
        p = r.choice(shared).split()
        a = r.randrange(0, len(p) - 45)
        texts.append(prose(r.randrange(40)) + "\n" + "\n\t".join(p[a : a + r.randrange(45, 90)]) + " " + prose(9) + " " + " ".join(p[:51]))
    texts += ["w " * 70, "w " * 49, "w " * 50, " ".join(["v"] * 200)]
    exact = "".join(r.choice("ACGT") for _ in range(3000))
    for a in range(0, 2000, 137):
        texts.append(exact[a : a + r.randrange(390, 900)])
    return texts


@pytest.mark.parametrize("seed, block_bytes, hot", [(1, 1 << 24, sd.HOT), (2, 3000, sd.HOT), (3, 3000, 1), (4, 1 << 24, 3)])
def test_equals_brute_force(spark, seed, block_bytes, hot):
    texts = some_texts(seed)
    rows = sd.remove_repeats(docs(spark, texts).repartition(5), block_bytes, hot).collect()
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in rows}
    expected = dict(enumerate(brute(texts)))
    assert {k for k in expected if got[k] != expected[k]} == set() and len(rows) == len(texts)
    shared = {x["doc_id"]: (x["n_shared_words"], x["n_passages"]) for x in rows}
    expected = dict(enumerate(brute_passages(texts)))
    assert {k for k in expected if shared[k] != expected[k]} == set()
    assert sum(n > 0 for n, _ in expected.values()) > 20


@pytest.mark.parametrize("seed", range(12))
def test_suffix_arrays_find_what_brute_force_finds(seed):
    """All strings with a trigger that stand twice, from the outer strings alone."""
    r = random.Random(seed)
    letters = (b"ab", b"acgt", bytes(range(256)), b"\0\1")[seed % 4]
    some = lambda n: bytes(r.choice(letters) for _ in range(n))
    shared = [some(r.randrange(380, 1500)) for _ in range(4)]
    texts = [b"".join(r.choice((some(r.randrange(300)), r.choice(shared))) for _ in range(r.randrange(1, 5))) for _ in range(25)]
    texts += [t[r.randrange(90) : len(t) - r.randrange(90)] for t in texts[:6]]
    rows, strings = [], []
    for k, text in enumerate(texts):
        p = sd.parse_rows(text)
        for stop, a, last, t in zip(*(p[x].tolist() for x in (4, 5, 6, 7))):
            rows.append((0, k, -k, a, last - a + 1, t - a, stop - a))
            strings.append(text[a:stop])
    rows = np.array(rows, sd.OUTER)
    back, same = sd.unpack_outers(sd.pack_outers(rows, strings))
    assert (back == rows).all() and same == strings
    marks = sd.repeated_strings(rows, strings)
    got = sorted((int(m["uid"]), a) for m in marks for a in range(m["at"], m["at"] + m["n"]))
    count = Counter(t[a : a + sd.LENGTH] for t in texts for a in range(len(t) - sd.LENGTH + 1))
    open_ = {k: set(sd.open_starts(sd.triggers(t), len(t)).tolist()) for k, t in enumerate(texts)}
    assert got == sorted((k, a) for k, t in enumerate(texts) for a in range(len(t) - sd.LENGTH + 1) if count[t[a : a + sd.LENGTH]] > 1 and a not in open_[k])


def test_ranks_are_the_order_of_cut_suffixes():
    r = random.Random(1)
    for _ in range(30):
        words = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(1, 20))]
        size = np.array([len(w) for w in words])
        ends = np.repeat(np.cumsum(size), size)
        got = sd.ranks(np.frombuffer(b"".join(words), np.uint8), ends).tolist()
        suffixes = [w[k:] for w in words for k in range(len(w))]
        order = {s: k + 1 for k, s in enumerate(sorted(set(suffixes)))}
        assert got == [order[s] for s in suffixes]


def test_hot_rows_and_null_ids(spark):
    """Rows that repeat many times, with and without an id, in one task and in many; clashing columns."""
    r = random.Random(9)
    long = " ".join(str(r.randrange(1000)) for _ in range(400))
    head = long[: long.rindex(" ", 0, 900)]
    n, words = len(head), len(head.split())
    rows = [(7, long, "x")] * 400 + [(None, head, "y")] * 30 + [(8, "short", "z")] * 50 + [(9, None, None)] * 3 + [(None, None, None), (10, " ".join(str(r.randrange(1000)) for _ in range(400)), "w")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    for parts in (1, 7):
        got = Counter(tuple(x) for x in sd.remove_repeats(d.repartition(parts)).select("doc_id", "n_bytes", "n_removed", "n_spans", "n_shared_words").collect())
        expected = Counter({(7, len(long), len(long), 1, words): 400, (None, n, n, 1, words): 30, (8, 5, 0, 0, 0): 50, (9, 0, 0, 0, 0): 3, (None, 0, 0, 0, 0): 1, (10, len(rows[-1][1]), 0, 0, 0): 1})
        assert got == expected


def test_a_mark_of_another_text_is_refused():
    text = bytes(random.Random(1).randbytes(900))
    rows = sd.parse(text)
    for mark in ((1, 1, 10_000, 1, sd.REPEATS), (1, 1, 700, 1, sd.STRING)):
        with pytest.raises(ValueError, match="two texts"):
            sd.covered(np.array([mark], sd.MARK), rows, len(text), sd.BYTES)


def test_every_string_has_one_place():
    """Each string is told by its first trigger or is open, exactly once, and lies in its outer string with its half."""
    r = random.Random(3)
    for text in (r.randbytes(5000), b"z" * 900, r.randbytes(420), b"ab" * 300 + r.randbytes(700)):
        t, half_start, half_stop, outer_start, outer_stop, first, last = sd.parse(text)
        starts = sd.open_starts(t, len(text)).tolist()
        for h, g, o, q, a, b in zip(half_start, half_stop, outer_start, outer_stop, first, last):
            for p in range(a, b + 1):
                starts.append(p)
                assert p <= h and g <= p + sd.LENGTH and g - h == sd.HALF and o <= p and p + sd.LENGTH <= q
        assert sorted(starts) == list(range(len(text) - sd.LENGTH + 1))


def test_words_hash_alike_wherever_they_stand():
    r = random.Random(6)
    big = wordhash.PIECE
    long = "x" * (big + 17)
    texts = ["", " ", "a", " a b\tc\x0b\x0cd\r\ne ", "é ü 中文", " ".join(str(r.randrange(5000)) for _ in range(400_000)), f"a {long} b {long} c", long, " " * (2 * big) + "a", "a" + " " * (big - 1) + "b c", "y" * (big - 2) + " a b", f"{'y' * 10} {long}" + " z" * big]
    texts += ["v" * big, f"{'v' * big} u {'v' * big}", f"a {'v' * big}"]
    known, back = {}, {}
    for t in texts:
        w, h = re.findall(r"[^\x20\x09-\x0D]+", t), sd.words(t.encode()).tolist()
        assert len(w) == len(h)
        for x, y in zip(w, h):
            assert known.setdefault(x, y) == y and back.setdefault(y, x) == x


def test_every_run_of_words_has_one_place():
    r = random.Random(4)
    for h in (np.array([r.randrange(1 << 60) for _ in range(700)], np.uint64), np.zeros(120, np.uint64), np.arange(50, dtype=np.uint64), np.arange(49, dtype=np.uint64)):
        t, half_start, half_stop, outer_start, outer_stop, first, last = sd.parse_words(h)
        starts = []
        for x, y, o, q, a, b in zip(half_start, half_stop, outer_start, outer_stop, first, last):
            for p in range(a, b + 1):
                starts.append(p)
                assert p <= x and y <= p + sd.PASSAGE and o <= p and p + sd.PASSAGE <= q
        assert starts == list(range(len(h) - sd.PASSAGE + 1))


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_tables(spark, empty):
    d = awkward(spark).where(F.lit(not empty))
    assert sd.remove_repeats(d).count() == d.count()

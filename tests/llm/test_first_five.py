import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerfold.llm import decontaminate, mixing, queries, sharding, simhash, toxicity
from ledgerfold.llm.graph import components
from tests.llm.helpers import awkward, docs


def test_components_equal_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# --- decontamination


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if w else ():
            for p in range(len(words) - m + 1):
                if words[p : p + m] == w[k : k + m]:
                    hit |= set(range(p, p + m))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_bytes", [1 << 24, 200])
def test_decontamination_equals_brute_force(spark, block_bytes):
    r = random.Random(2)
    word = lambda: r.choice("ab cd ef gh".split())
    items = [(k, " ".join(word() for _ in range(r.choice([0, 1, 3, 12, 13, 14, 20])))) for k in range(30)] + [(90, None), (91, "Ab, CD-ef"), (92, "ab cd ef"), (10, "x y")]
    texts = [" ".join(word() for _ in range(r.randrange(60))) for _ in range(60)] + [items[4][1] + " zz " + items[7][1], None, "", "AB! cd efé X  y"]
    d = docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: tuple(x[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for x in decontaminate.contamination(d, bench, block_bytes=block_bytes).collect()}
    assert got == {k: brute_hits(t, items) for k, t in enumerate(texts)}
    kept = decontaminate.clean(d, bench)
    assert kept.columns == d.columns
    assert {x["doc_id"] for x in kept.collect()} == {k for k, t in enumerate(texts) if not brute_hits(t, items)[4]}


def test_passages_in_long_texts_are_cleaned(spark):
    """A passage of a window's length goes however long its document; everyday phrases and shorter runs stay."""
    r = random.Random(21)
    word = lambda: r.choice("ab cd ef gh ij kl mn op qr st".split()) + str(r.randrange(900))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([13, 20, 59, 14])] + [(50, "ab cd")]
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = lambda k, a, n: " ".join(items[k][1].split()[a : a + n])
    texts = [f"{prose(3000)} {passage(k, 0, 13)} {prose(3000)}" for k in range(4)]
    texts += [f"{prose(900)} {passage(2, 17, 13)}", f"{passage(2, 0, 59)} {prose(20_000)}"]
    clean = [f"{prose(3000)} {passage(2, 5, 12)} {prose(3000)}", f"{prose(500)} AB, cd! {prose(500)}", prose(40), "", None]
    d = docs(spark, texts + clean)
    for how in ({}, {"block_bytes": 300}, {"block_bytes": 300, "resident": 0}):
        kept = decontaminate.clean(d, spark.createDataFrame(items, "item_id long, text string"), **how)
        assert sorted(x["doc_id"] for x in kept.collect()) == list(range(len(texts), len(texts + clean)))


@pytest.mark.parametrize("seed", range(6))
def test_wu_manber_finds_every_occurrence(seed):
    r = random.Random(seed)
    word = lambda: r.choice(("a b c" if seed % 2 else "ab cd ef gh ij kl mn é zz9 10").split())
    items = [(k, " ".join(word() for _ in range(r.randrange(0, 40))).encode()) for k in range(25)]
    tables = decontaminate.build(items)
    assert sum(t.n_bytes for t in tables) < decontaminate.BUILT * sum(len(t) + 200 for _, t in items) + (1 << 12)
    for _ in range(40):
        raw = " ".join(word() if r.random() < 0.8 else r.choice(items)[1].decode() for _ in range(r.randrange(60))).encode()
        text, words = decontaminate.Text(raw), raw.split()
        for t in tables:
            at, owner = t.search(text)
            got = sorted(zip(at.tolist(), (t.ids[k] for k in owner.tolist())))
            own = [(i, x.split()) for i, x in items if x.split() and min(13, len(x.split())) == t.m]
            assert got == sorted((p, str(i)) for i, w in own for k in range(len(w) - t.m + 1) for p in range(len(words) - t.m + 1) if words[p : p + t.m] == w[k : k + t.m])


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_item_ids_of_any_text(spark, block_bytes):
    items = [("a,b", "ab cd ef"), ("", "gh ij kl"), ('"', "mn op"), ("é,", "qr st uv"), ("a", "wx yz ab")]
    texts = ["ab cd ef", "gh ij kl", "ab cd ef gh ij kl mn op qr st uv", "wx yz ab cd ef"]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {x["doc_id"]: tuple(x[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for x in decontaminate.contamination(docs(spark, texts), bench, block_bytes=block_bytes).collect()}
    assert got == {k: brute_hits(t, items) for k, t in enumerate(texts)}


# --- simhash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, linked):
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(fps[i], fps[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 200))) for _ in range(40)]
    for k in range(60):
        w = r.choice(texts[:40]).split()
        w[r.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    texts += ["", None, " \n ", "one", "ONE", "one two", texts[0].upper(), texts[0]]
    fps = {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    assert {x["doc_id"]: int(x["fingerprint"], 16) for x in got} == fps
    expected = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    assert {x["doc_id"]: x["component_id"] for x in got} == expected
    kept = simhash.keep_one(docs(spark, texts)).collect()
    assert sorted(x["doc_id"] for x in kept) == sorted(set(expected.values()))


def test_pigeonring_links_lose_nothing(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(r.randrange(1, 6)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    hot = r.getrandbits(64)
    fps |= {hot ^ (r.getrandbits(16) & 0x0F3F) for _ in range(300)}  # one crowded key
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long").repartition(3))
    back = {s: f for f, s in signed.items()}
    for e in edges.collect():
        assert (back[e["u"]] ^ back[e["v"]]).bit_count() <= 3
    got = {back[x["node"]]: x["component"] for x in components(edges).collect()}
    expected = brute_components({f: f for f in fps}, lambda a, b: (a ^ b).bit_count() <= 3)
    groups, mine = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[expected[f]].add(f)
        mine[got.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


# --- sharding


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_keep_one_of_copies_and_equal_rows(spark, monkeypatch, bound):
    """Copies, rows that repeat with their id, null ids, and texts without words; by broadcast and by shuffle."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", bound)
    r = random.Random(5)
    prose = lambda: " ".join(str(r.randrange(10_000)) for _ in range(60))
    a, b, c, e = prose(), prose(), prose(), prose()
    rows = [(7, a), (3, a), (9, a), (5, b), (5, b), (5, b), (None, c), (None, c), (None, e), (20, e), (30, None), (31, ""), (32, " \n"), (40, prose())]
    d = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, __n int")
    out = simhash.keep_one(d.repartition(4))
    assert out.columns == d.columns
    assert sorted((x["doc_id"] or 0, x["text"] or "") for x in out.collect()) == sorted([(3, a), (5, b), (0, c), (20, e), (30, ""), (40, rows[-1][1])])


@pytest.mark.parametrize("limit", [200, 5000])
def test_shards_fit_and_split_only_where_needed(spark, limit):
    r = random.Random(5)
    texts = ["t" * r.randrange(120) for _ in range(300)] + ["x" * 9000]
    rows = sharding.shard(docs(spark, texts), limit).collect()
    assert sorted(x["doc_id"] for x in rows) == list(range(len(texts)))
    total, n, by = defaultdict(int), defaultdict(int), defaultdict(set)
    for x in rows:
        total[x["shard"]] += x["n_bytes"]
        n[x["shard"]] += 1
        by[x["shard"]].add(x["shard_bytes"])
    for s in total:
        assert by[s] == {total[s]} and (total[s] <= limit or n[s] == 1)
        if s:  # its parent didn't fit
            under = [k for k in total if k.startswith(s[:-1])]
            assert sum(total[k] for k in under) > limit and sum(n[k] for k in under) > 1
    assert not any(a != b and b.startswith(a) for a in total for b in total)


def test_equal_rows_are_paged(spark):
    d = spark.createDataFrame([(7, "same text here")] * 100 + [(k, "a") for k in range(50)], "doc_id long, text string")
    rows = sharding.shard(d, 100).collect()
    total, said = defaultdict(int), {}
    for x in rows:
        total[x["shard"]] += x["n_bytes"]
        said[x["shard"]] = x["shard_bytes"]
    assert len(rows) == 150 and max(total.values()) <= 100 and said == total


def test_sharding_equals_sql(spark, sf_dir):
    duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'")
    expected = sorted(duckdb.sql(sharding.ORACLE_SQL).fetchall())
    got = sorted((x["doc_id"], x["n_bytes"], x["shard"], x["depth"], x["shard_bytes"]) for x in queries.op1_sharding(spark, sf_dir).collect())
    assert got == expected


# --- mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    w = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * w[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= full


def test_mix_meets_its_targets(spark):
    r = random.Random(6)
    texts, sources = [], []
    for k, s in enumerate(["a", "b", "é", "Z", None]):
        for _ in range([400, 100, 60, 200, 40][k]):
            texts.append(" ".join("w" for _ in range(r.choice([0, 1, 5, 5, 5, 30, 200]))))
            sources.append(s)
    d = docs(spark, texts, sources)
    rows = mixing.mix(d).collect()
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len(t.split())
    goal = brute_targets(sizes)
    taken = defaultdict(int)
    assert len(rows) == len(texts)
    for x in rows:
        s = sources[x["doc_id"]]
        assert x["size"] == len(texts[x["doc_id"]].split()) and x["source_size"] == sizes[s]
        assert abs(x["target"] - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= x["taken"] <= 2 * x["size"] and x["taken"] == x["copies"] * x["size"]
        taken[s] += x["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(2, 0.01 * goal[s])
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in again) == sorted((x["doc_id"], x["taken"]) for x in rows)
    copies = {x["doc_id"]: x["copies"] for x in rows}
    out = mixing.take(d)
    assert out.columns == d.columns and out.count() == sum(copies.values())


def test_mix_of_repeated_rows_and_many_sources(spark):
    """Equal rows share an extra copy exactly; sources are weighed by rank across partitions; texts may be null."""
    r = random.Random(8)
    names = [f"s{k:03d}" for k in range(120)] + ["é", "Z", None]
    rows = [(k, " ".join("w" * r.randrange(1, 9)), r.choice(names)) for k in range(900)] + [(5000, "one two three", "s000")] * 37 + [(None, "four five", None)] * 9 + [(6000, None, "Z"), (6001, "", "quiet")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = lambda t: len((t or "").split())
    for budget in (1.5, 0.4):
        goal, sums, taken, copies = {}, defaultdict(int), defaultdict(int), defaultdict(list)
        for _, t, s in rows:
            sums[s] += size(t)
        got = mixing.mix(d, budget=budget).collect()
        assert len(got) == len(rows)
        for x in got:
            assert 0 <= x["copies"] <= 2 and x["taken"] == x["copies"] * size(x["text"]) and x["source_size"] == sums[x["source"]]
            taken[x["source"]] += x["taken"]
            goal[x["source"]] = x["target"]
            copies[x["doc_id"], x["text"]].append(x["copies"])
        if budget == 1.5:
            want = brute_targets(sums)
            assert all(abs(goal[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sums)
        assert all(abs(taken[s] - goal[s]) <= max(3, 0.01 * goal[s]) for s in sums if s != "quiet")
        again = mixing.mix(d.repartition(5), budget=budget).collect()
        assert sorted((str(x["doc_id"]), x["taken"]) for x in again) == sorted((str(x["doc_id"]), x["taken"]) for x in got)
        assert all(max(c) - min(c) <= 1 for c in copies.values())


def test_tilts_are_entropy_balanced(spark):
    hist = spark.createDataFrame([("0a", 10, 5), ("0a", 100, 5), ("0b", 3, 9)], "src string, size long, n long")
    goals = spark.createDataFrame([("0a", 550, 300.0), ("0b", 27, 40.0)], "src string, source_size long, target double")
    for x in mixing.tilts(hist, goals).collect():
        import math

        sizes = {"0a": [(10, 5), (100, 5)], "0b": [(3, 9)]}[x["src"]]
        got = sum(n * s * min(2, math.exp(x["tilt"] * s / x["mean"])) for s, n in sizes)
        assert abs(got - {"0a": 300, "0b": 40}[x["src"]]) < 1e-6


# --- toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op4_toxicity(spark, sf).collect()]
    assert len(rows) == 10000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    assert auc > 0.95, auc
    assert sum(s >= 0.7 for s in good) <= 0.01 * len(good) and sum(s >= 0.7 for s in bad) >= 0.9 * len(bad)


def test_toxicity_without_labels(spark):
    d = docs(spark, ["a b", None, ""])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(d, toxicity.train(d, none)).collect()
    assert [r["predicted"] for r in rows] == [0, 0, 0]


# --- awkward tables


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_tables(spark, empty):
    d = awkward(spark).where(F.lit(not empty))
    n = d.count()
    bench = spark.createDataFrame([(None, "a b"), (1, None), (2, "beta gamma")], "item_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0), (3, 1), (3, 1)], "doc_id long, toxic int")
    assert decontaminate.contamination(d, bench).count() == n
    assert decontaminate.contamination(d, bench.where("false")).count() == n
    assert simhash.near_duplicates(d).count() == n
    assert sharding.shard(d, 50).count() == n
    assert mixing.mix(d).count() == n
    assert toxicity.score(d, toxicity.train(d, labels)).count() == n
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns and kept.count() == (0 if empty else 5)

"""Awkward rows through every operator and every stage, by value: null ids and texts, empty and very long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerfold.llm import decontaminate, language, licenses, mixing, quality, secrets, sharding, simhash, suffix_dedup, toxicity
from ledgerfold.llm.common import table
from tests.llm.test_first_five import brute_fingerprint, brute_hits
from tests.llm.test_suffix_dedup import brute, brute_passages

#: Columns named like results of the operators.
CLASH = "shard string, n_bytes string, page string, n_words string, kept string, spans string, n_novel string, score string, predicted string, fp string, component_id string, n_licenses string, hits string, size string, target string, copies string, taken string, lang_pred string, n_hit string, contaminated string, longest_hit string, times string, block string"
NAMES = [c.split()[0] for c in CLASH.split(", ")]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(31)
    prose = lambda n: " ".join(r.choice(("the", "and", "ab", "cd", "ef", "ün", "x1", "mit", "que")) + str(r.randrange(40)) for _ in range(n))
    long = prose(120_000)
    key = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(40))
    out = [(None, prose(80), "en", "s0"), (None, None, None, None), (1, None, "de", None), (2, "", None, "s1"), (3, " \t\n\x0b ", "fr", "s1"), (4, long, "en", "s0")]
    out += [(5, prose(90), "en", "s2")] * 3 + [(None, prose(70), "es", "s2")] * 2 + [(6, out[0][1], "en", "s0"), (7, long[300:9000], "en", None)]
    out += [(8, f"{prose(20)}\nauth_key = {key}\npassword: abcdefgh1\n", "en", "s1"), (9, "Released under the MIT License.", "en", "s1"), (10, "zz " * 30_000, "fr", "s0"), (11, "\U0001f600 café 中文 \x00 ok", "fr", "")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return base.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES]).repartition(5).cache()


BENCH = [(1, "the1 ab2 cd3"), (None, "zz zz"), (2, None), (3, ""), (4, " ".join(["zz"] * 13))]


def pairs(found, *names):
    return Counter(tuple(r[n] for n in ("doc_id", *names)) for r in found.collect())


def expected(rows, of):
    return Counter((i, *of(t)) for i, t, *_ in rows)


def own_columns(found, docs, new):
    """Columns of the documents stay, but for those named like a result."""
    first = found.where("doc_id = 9").first()
    assert set(found.columns) == set(docs.columns) | set(new)
    assert all(first[n] == f"own {n}" for n in NAMES if n not in new)


def test_sharding(docs, rows):
    found = sharding.shard(docs, 1000)
    own_columns(found, docs, ("n_bytes", "shard", "depth", "shard_bytes", "page"))
    assert pairs(found, "n_bytes") == expected(rows, lambda t: (len((t or "").encode()),))
    sums, n = Counter(), Counter()
    for r in found.collect():
        sums[r["shard"]] += r["n_bytes"]
        n[r["shard"]] += 1
    assert all(sums[r["shard"]] == r["shard_bytes"] and (r["shard_bytes"] <= 1000 or n[r["shard"]] == 1) for r in found.collect())


def test_quality(docs, rows):
    found = quality.measure(docs)
    own_columns(found, docs, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_bad_lines", "lost_percent", "kept", "clean_text"))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def of(t):
        w, hit = words(t), set()
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        for k in range(len(w) - 2):
            if seen[tuple(w[k : k + 3])] > 1:
                hit |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)

    assert pairs(found, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected(rows, of)


def test_secrets(docs, rows):
    found = secrets.scan(docs)
    own_columns(found, docs, ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"))
    assert pairs(found, "n_assign", "n_access", "n_hex", "n_novel") == Counter((i, int(i == 8), 0, 0, int(i == 8)) for i, *_ in rows)
    none = hashlib.sha256(b"").hexdigest()
    assert {r["base_sha256"] for r in found.where("doc_id IS NULL OR doc_id < 8").collect()} == {none}


def test_toxicity(spark, docs, rows):
    r = random.Random(2)
    train = [(k, " ".join(r.choice("ab cd ef gh".split()) for _ in range(40)) + (" vile" if k % 2 else ""), k % 2) for k in range(300)]
    known = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    labels = known.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None), (7000, 1), (5, 1), (5, 1)], "doc_id long, toxic int"))
    model = toxicity.train(known.select("doc_id", "text").unionByName(known.where("doc_id < 9").select("doc_id", "text")), labels)
    found = toxicity.score(docs.unionByName(docs.where("doc_id = 9").withColumn("text", F.lit("ab vile cd")).withColumn("doc_id", F.lit(99).cast("long"))), model)
    own_columns(found, docs, ("score", "predicted"))
    got = {(x["doc_id"], x["text"]): (x["score"], x["predicted"]) for x in found.collect()}
    assert got[99, "ab vile cd"][1] == 1 and got[99, "ab vile cd"][0] > 0.7
    assert len({got[k][0] for k in ((None, None), (1, None), (2, ""), (3, rows[4][1]))}) == 1  # no features
    assert all(0 <= s <= 1 and p == (s >= 0.7) for s, p in got.values())


def test_simhash(docs, rows):
    found = simhash.near_duplicates(docs)
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, *_) in enumerate(rows):
        ids = least.setdefault(root(k), [])
        if i is not None:
            ids.append(i)
    assert pairs(found, "fingerprint", "component_id") == Counter((i, f"{f:016x}", min(least[root(k)], default=None)) for k, ((i, *_), f) in enumerate(zip(rows, fps)))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    by = Counter((x["doc_id"], x["text"]) for x in kept.collect())
    assert len(by) == len(least) and set(by.values()) == {1}


def test_licenses(docs, rows):
    found = licenses.scan(docs)
    own_columns(found, docs, ("n_licenses", "n_confirmed", "families", "best_probability", "hits", "n_unknown"))
    assert pairs(found, "n_licenses", "families", "hits", "n_unknown") == Counter((i, 1, "mit", "0:mit:true", 0) if i == 9 else (i, 0, "", "", 0) for i, *_ in rows)


def test_suffix_dedup(docs, rows):
    texts = [t for _, t, *_ in rows]
    plain, shared = brute(texts), brute_passages(texts)
    found = suffix_dedup.remove_repeats(docs)
    assert pairs(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter((i, *x) for (i, *_), x in zip(rows, plain))
    # Equal rows are one document, so what only they share is not a passage.
    once = {k: s for k, s in zip(zip((i for i, *_ in rows), texts), shared)}
    alone = {(5, texts[6]), (None, texts[9])}
    assert pairs(found, "n_shared_words") == Counter((i, 0 if (i, t) in alone else once[i, t][0]) for i, t, *_ in rows)


def test_mixing(docs, rows):
    found = mixing.mix(docs)
    own_columns(found, docs, ("size", "source_size", "target", "copies", "taken"))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = Counter()
    for _, t, _, s in rows:
        sums[s] += size(t)
    assert Counter((x["doc_id"], x["size"], x["source_size"]) for x in found.collect()) == Counter((i, size(t), sums[s]) for i, t, _, s in rows)
    assert all(x["taken"] == x["copies"] * x["size"] and 0 <= x["copies"] <= 2 for x in found.collect())
    took = mixing.take(docs)
    assert took.columns == docs.columns and took.count() == sum(x["copies"] for x in found.collect())


def test_language(spark, docs, rows):
    found = language.identify(docs.select("doc_id", "text", *NAMES), language.train(docs.select("doc_id", "text", "lang")))
    got = [(x["doc_id"], x["text"], x["lang_pred"], x["score"]) for x in found.collect()]
    assert Counter((i, t) for i, t, *_ in got) == Counter((i, t) for i, t, *_ in rows)
    assert all((lang == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= s <= 1 for _, t, lang, s in got)


def test_decontamination(spark, docs, rows):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontaminate.contamination(docs, bench)
    own_columns(found, docs, ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_hit"))
    short = [x for x in rows if len(x[1] or "") < 20_000]
    items = [(i, t) for i, t in BENCH if i is not None]
    got = pairs(found, "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert not Counter((i, *brute_hits(t, items)) for i, t, *_ in short) - got and sum(got.values()) == len(rows)
    assert found.where("doc_id = 10").first()["n_hit"] == 30_000
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.where("doc_id = 10").isEmpty() and kept.where("doc_id IS NULL AND text IS NULL").count() == 1


def test_every_operator_takes_an_empty_table(spark, docs):
    none, bench = docs.where("false"), spark.createDataFrame(BENCH, "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    made = [sharding.shard(none), quality.measure(none), secrets.scan(none), toxicity.score(none, toxicity.train(none, labels)), simhash.near_duplicates(none), simhash.keep_one(none), licenses.scan(none)]
    made += [suffix_dedup.remove_repeats(none), mixing.mix(none), mixing.take(none), language.identify(none, language.train(none)), decontaminate.contamination(none, bench), decontaminate.clean(none, bench.where("false"))]
    assert [x.count() for x in made] == [0] * len(made)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, sf_dir, docs, rows, tmp_path, empty):
    """Each stage on awkward rows, and run() on such tables, the empty one too."""
    for name in ("benchmark", "labels"):
        table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.select("doc_id", "text", "lang", "source", "n_chars").where(F.lit(not empty)).write.parquet(f"{tmp_path}/documents.parquet")
    at = docs.where(F.lit(not empty))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(Counter((x["doc_id"], x["text"]) for x in at.collect()))
    last = Counter(tuple(x) for x in corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect())
    assert Counter(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == last
    if empty:
        assert not any(kept) and not last
        return
    everything = Counter((i, t) for i, t, *_ in rows)
    assert kept[0] == everything  # nothing toxic
    assert set(kept[1].values()) == {1} and not set(kept[1]) - set(everything)
    assert kept[2] == kept[1]  # no benchmark passage
    assert set(kept[3]) <= set(kept[2]) and max(kept[3].values()) <= 2
    assert sum(last.values()) == sum(kept[3].values())

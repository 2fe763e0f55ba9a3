"""The pipeline's stages, each against a plain version on its own input."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ledgerfold.llm import toxicity
from ledgerfold.llm.common import table
from ledgerfold.llm.sharding import LIMIT_BYTES
from tests.llm.test_first_five import brute_components, brute_fingerprint, brute_hits, brute_targets


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """(name, rows in, rows out) of each stage."""
    at, docs, out = tmp_path_factory.mktemp("pipeline"), table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        got = spark.read.parquet(f"{at}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns
        out.append((name, docs.collect(), got.collect()))
        docs = got
    return out


def test_toxicity(spark, sf_dir, stages):
    _, before, after = stages[0]
    at, w, bias = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    weight, hasher = dict(zip(at.tolist(), w.tolist())), toxicity.Hasher()

    def p(text):
        z = bias + sum(weight.get(int(f), 0.0) for f in np.unique(hasher(text.encode())))
        return 1 / (1 + math.exp(-z))

    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if p(r["text"]) < 0.7)
    assert len(after) > 0.8 * len(before)


def test_near_duplicates(stages):
    _, before, after = stages[1]
    comp = brute_components({r["doc_id"]: brute_fingerprint(r["text"]) for r in before}, lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted(r["doc_id"] for r in after) == sorted(set(comp.values()))


def test_decontamination(spark, sf_dir, stages):
    _, before, after = stages[2]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    words = {w for _, t in items for w in t.lower().split()}
    suspects = {r["doc_id"] for r in before if len(words & set(r["text"].lower().split())) > 12}
    bad = {r["doc_id"] for r in before if r["doc_id"] in suspects and brute_hits(r["text"], items)[4]} if len(suspects) < 40 else None
    kept = {r["doc_id"] for r in after}
    assert kept <= {r["doc_id"] for r in before}
    gone = {r["doc_id"] for r in before} - kept
    assert gone == bad if bad is not None else all(brute_hits(r["text"], items)[4] for r in before if r["doc_id"] in gone)


def test_mixing(stages):
    _, before, after = stages[3]
    size = {r["doc_id"]: len(r["text"].split()) for r in before}
    source = {r["doc_id"]: r["source"] for r in before}
    copies = Counter(r["doc_id"] for r in after)
    assert max(copies.values()) <= 2 and set(copies) <= set(size)
    total, taken = defaultdict(int), defaultdict(int)
    for d, n in size.items():
        total[source[d]] += n
        taken[source[d]] += n * copies[d]
    goal = brute_targets(total)
    smallest = {s: min(n for d, n in size.items() if source[d] == s) for s in total}
    for s in total:
        assert abs(taken[s] - goal[s]) <= max(0.05 * goal[s], smallest[s]), (s, taken[s], goal[s])


def test_sharding(stages):
    _, before, after = stages[4]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    by = defaultdict(int)
    for r in after:
        by[r["shard"]] += r["n_bytes"]
    assert all(b <= LIMIT_BYTES for b in by.values())
    said = {r["shard"]: r["shard_bytes"] for r in after}
    assert said == dict(by)


def test_run_equals_the_stages(spark, sf_dir, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(tuple, stages[4][2]))

"""Language ID by multilingual mixture inference.

A document is a mixture of languages: each byte trigram of its lower-cased
text is drawn from language l with probability pi_l * P_l(trigram).
Expectation-maximisation finds the shares pi; the set of languages is chosen
by likelihood less a penalty for each language more (BIC; overlapping trigrams
count for a third each). Sets of every size are tried, the largest shares of
the fit to all languages. The prediction is the largest share of the set.

P_l is learned from at most `per_language` documents of each language, picked
by a hash (bounded sample, a documented parameter), counted in a distributed
aggregation of fixed-size tables (65,536 cells a language). Only the tables
reach the driver. Prediction is one narrow pass over whole texts.

Defined results: null texts and texts without a letter are `und` with score 0;
with no language learned, all are `und`; rows whose language is null are not
learned from; extra columns stay, those named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, id_remainder

CELLS = 1 << 16
PER_LANGUAGE = 3000
STEPS, SMOOTHING = 12, 0.5


def trigrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of the byte trigrams of a text, with a space at each end."""
    b = np.frombuffer(b" " + text.decode().lower().encode() + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77) ^ b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
    if len(code) < 3000:
        return np.unique(code, return_counts=True)
    count = np.bincount(code, minlength=CELLS)
    cells = np.flatnonzero(count)
    return cells, count[cells]


def train(docs: DataFrame, held_out=lambda doc_id: id_remainder(doc_id, 4) == 2, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, probability of each cell by language)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.empty((0, CELLS))
    share = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    sample = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cells, n = trigrams(text)
                total.setdefault(lang, np.zeros(CELLS))[cells] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("counts"))
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    counted = sample.select("lang", F.col("text").cast("binary")).mapInArrow(count, "lang string, counts binary")
    rows = sorted((r["lang"], bytes(r["counts"])) for r in counted.groupBy("lang").applyInArrow(add, "lang string, counts binary").collect())
    table = np.array([np.frombuffer(c) for _, c in rows]) + SMOOTHING
    return [lang for lang, _ in rows], table / table.sum(axis=1, keepdims=True)


def mixture(p: np.ndarray, n: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """(shares, log-likelihood) of the languages whose probabilities of the cells are the rows of p."""
    shares, total = np.full(len(p), 1 / len(p)), n.sum()
    for _ in range(steps):
        shares = shares * (p @ (n / (shares @ p))) / total
    return shares, float(n @ np.log(shares @ p))


def infer(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages of the chosen set, their shares), largest first."""
    n = n / 3.0
    penalty = 0.5 * np.log(max(n.sum(), 2.0))
    alone = np.log(p) @ n
    best = int(alone.argmax())
    chosen, most, shares = np.array([best]), alone[best], np.ones(1)
    if len(p) == 1:
        return chosen, shares
    all_shares, all_value = mixture(p, n)
    if all_value - penalty > most:
        order = np.argsort(-all_shares)
        for k in range(2, len(p) + 1):
            s, value = mixture(p[order[:k]], n)
            if value - (k - 1) * penalty > most:
                chosen, most, shares = order[:k], value - (k - 1) * penalty, s
    order = np.argsort(-shares, kind="stable")
    return chosen[order], shares[order]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs plus lang_pred, score (its share) and lang_mix (name:share of the set)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        names, table = shared.value
        for text in texts:
            if not text or not names or not any(map(str.isalpha, text.decode())):
                yield "und", 0.0, ""
                continue
            cells, n = trigrams(text)
            which, shares = infer(table[:, cells], n)
            yield names[which[0]], float(min(1.0, shares[0])), ",".join(f"{names[k]}:{s:.4f}" for k, s in zip(which, shares))

    return add_columns(docs, ["text"], run, [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("lang_mix", T.StringType())])

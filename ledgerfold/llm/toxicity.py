"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the set of its words, its word pairs, its pairs with one
word between and the stems of its words (their first 4 and 6 letters, and
whether several words share one), hashed to 2**20 coordinates. Stems make
compounds and inflections known that training rows hold once. Training follows McMahan et
al., "Ad Click Prediction: a View from the Trenches" (2013): per-coordinate
rates, L1 and L2 terms; the L1 term leaves a few hundred weights, which are
what is broadcast (at most 2**20 doubles, whatever the data).

Scores are calibrated: each third of the training rows is scored by a model of
the other two thirds, and a logistic curve through these scores (Platt, 1999)
rescales weights and bias of the model of all rows. So 0.7 means that about
seven in ten such rows are labelled toxic, however hard L1 shrinks.

Training rows: labelled documents that are not held out, at most `max_rows`
of them, chosen by a hash of the id (bounded sample, a documented parameter).
Only label, id and text enter; the id only picks rows. Scoring covers every
whole text in one narrow pass.

Defined results: null and empty texts get the score of no features; labels
that are null are not used; when labels or one of the classes are missing, the
score is the share of toxic rows seen (0 if none).
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, id_remainder

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BITS = 20
MAX_ROWS = 12_000
FOLDS = 3
THRESHOLD = 0.7
#: Letters of a stem, and from how many different words on a shared stem is a feature of its own.
STEMS, OFTEN = (4, 6), (2, 4)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value, then keep its top BITS bits."""
    return (((h ^ (h >> np.uint64(32))) * _C) >> np.uint64(64 - BITS)).astype(np.int64)


class Hasher:
    """Coordinates of texts; remembers the hashes of words met before."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.stems: dict[bytes, list[int]] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Coordinates of all features of the text, repeats included."""
        words = WORD.findall(text.lower()) if text else []
        if not words:
            return np.empty(0, np.int64)
        known = self.known
        if len(known) > 400_000:
            known.clear()
            self.stems.clear()
        parts: list[int] = []
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 7)
                letters = w.decode(errors="replace")
                self.stems[w] = [xxhash.xxh64_intdigest(letters[:n], 9) for n in STEMS if len(letters) > n]
            parts += self.stems[w]
        h = np.array([known[w] for w in words], np.uint64)
        stem, times = np.unique(np.array(parts, np.uint64), return_counts=True)
        often = [_mix(stem[times >= k] * _A + np.uint64(k)) for k in OFTEN]
        return np.concatenate((_mix(h), _mix(h[:-1] * _A + h[1:]), _mix(h[:-2] * _B + h[2:] + _A), _mix(stem), *often))


def _packed(at: np.ndarray) -> bytes:
    """Ascending coordinates as compressed differences: what a training row costs the driver."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(at, prepend=0).astype(np.int32).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(raw)), np.int32), dtype=np.int32)


class Ftrl:
    """alpha, beta: per-coordinate rate alpha / (beta + sqrt(sum of squared gradients))."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)  # the last coordinate is the bias
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum()))))
        g = p - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def _fit(data: list[tuple[bytes, int]], epochs: int) -> np.ndarray:
    model, order = Ftrl(), np.random.default_rng(1)
    for _ in range(epochs):
        for k in order.permutation(len(data)):
            model.learn(_unpacked(data[k][0]), data[k][1])
    return model.weights()


def calibration(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through margins; slope 1 and shift 0 where they can't be told."""
    n1 = labels.sum()
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    loss = lambda x: float((np.logaddexp(0, x[0] * margins + x[1]) - goal * (x[0] * margins + x[1])).sum())
    x = np.array([0.0, math.log((n1 + 1) / (len(labels) - n1 + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x[0] * margins + x[1], -35, 35)))
        v = p * (1 - p)
        slope = np.array([((p - goal) * margins).sum(), (p - goal).sum()])
        curve = np.array([[(v * margins * margins).sum(), (v * margins).sum()], [(v * margins).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step, size, here = np.linalg.solve(curve, slope), 1.0, loss(x)
        while loss(x - size * step) > here and size > 1e-6:
            size /= 2
        x = x - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return (float(x[0]), float(x[1])) if x[0] > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, held_out=lambda doc_id: id_remainder(doc_id, 3) == 1, max_rows: int = MAX_ROWS, epochs: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) of the non-zero weights, calibrated."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    picked = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most max_rows rows of two numbers

    def run(found):
        hasher = Hasher()
        for text in found:
            yield (_packed(np.unique(hasher(text))),)

    # One text for each id; the bound on rows holds for repeated documents too. Rows stay packed on the driver.
    features = add_columns(texts, ["text"], run, [("at", T.BinaryType())]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("at").alias("at"))
    data = [(bytes(r["at"]), int(r["toxic"] > 0)) for r in sorted(features.collect(), key=lambda r: r["doc_id"])]
    toxic = sum(y for _, y in data)
    if not toxic or toxic == len(data):
        share = toxic / len(data) if data else 0.0
        return np.empty(0, np.int64), np.empty(0), math.log((share + 1e-6) / (1 - share + 1e-6))
    margins = np.zeros(len(data))
    for fold in range(FOLDS):
        w = _fit([x for k, x in enumerate(data) if k % FOLDS != fold], epochs)
        for k in range(fold, len(data), FOLDS):
            margins[k] = w[-1] + w[_unpacked(data[k][0])].sum()
    slope, shift = calibration(margins, np.array([y for _, y in data]))
    w = _fit(data, epochs)
    at = np.flatnonzero(w[:-1])
    return at, slope * w[at], float(slope * w[-1] + shift)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 from the threshold on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        live = dense != 0
        hasher = Hasher()
        for text in texts:
            found = hasher(text)
            total = bias + dense[np.unique(found[live[found]])].sum()
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))
            yield p, int(p >= threshold)

    return add_columns(docs, ["text"], run, [("score", T.DoubleType()), ("predicted", T.IntegerType())])

"""Mixing sources to target weights by entropy balancing.

Targets: sources by code point (null last) weigh 3, 1, 2, repeating, and share
`budget` of all words; a target stops at `cap` times its source's words and
the excess goes to the others by weight (water filling, solved in closed form).

Rates: for each source, the document rates nearest to 1 in relative entropy
whose words meet the target, none above the cap: rate = min(cap, exp(lambda *
size / mean size)). Newton steps on the convex dual find lambda, safeguarded
by a bracket. The sums of a step need only the histogram (source, size,
documents), which is built in one partial aggregation; a step is one small
distributed aggregation, and sources stay a distributed table.

Copies: floor(rate) for every document and one more for some, so that each
source's words come as near its target as its sizes allow: error diffusion
from large sizes to small in each source's histogram, then single moves. The
documents of a class (source, size) that get the extra copy are those with the
smallest content hash. What is passed on to the documents is only each class's
cut-off hash, so documents are not moved: the cut-off's range is found among
1024 sums, and only the hashes of that range are ranked. Rows that tie at the
cut-off are copies of one row; they are counted in two steps, by partition.

Scale: sources are ranked by range partitions and their targets found by
sums, so no task reads all of them. The table of classes is broadcast up to
BROADCAST_CLASSES rows, beyond that it is joined by shuffle.

Defined results: null text has size 0 and is taken 0 times; a null source is a
source of its own; repeated rows are ranked like others; an empty table gives
an empty result; columns of the documents named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut

WEIGHTS, BUDGET, CAP, RANGES = (3, 1, 2), 1.5, 2, 1024
#: Classes of some 100 bytes each that may be broadcast.
BROADCAST_CLASSES = 100_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def _marked(docs: DataFrame) -> DataFrame:
    """docs plus __src (orders nulls last), __size, __key and __range (one of RANGES, in the order of keys)."""
    src = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    key = F.xxhash64(F.col("doc_id").cast("string"), "source", "text")
    out = docs.withColumns({"__src": src, "__size": word_count(F.col("text")), "__key": key})
    return out.withColumn("__range", F.shiftright(F.col("__key"), 64 - 10))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources plus rank (from 0) in the order of src: by range partition, then within it."""
    part = cut(sources.repartitionByRange("src").withColumn("part", F.spark_partition_id()))
    counts = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("low"))
    before = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    inside = part.withColumn("in", F.row_number().over(W.partitionBy("part").orderBy("src")) - 1)
    return inside.join(before, "part").withColumn("rank", F.col("before") + F.col("in")).drop("part", "before", "in")


def targets(hist: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """src, source_size, target: one row a source.

    The level at which words are poured by weight rises until the budget is
    spent; a step sums the sources that are full and the weights of the others.
    """
    sums = hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    s = cut(_ranked(sums).select("src", "source_size", w.alias("w"), (cap * F.col("source_size")).cast("double").alias("most")))
    total, level, n_full = s.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        full = F.col("most") <= level * F.col("w")
        n, spent, left = s.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        if n == n_full or not left:
            break
        n_full, level = n, (budget * total - spent) / left
    return s.select("src", "source_size", F.least(F.col("most"), F.lit(float(level)) * F.col("w")).alias("target"))


def tilts(hist: DataFrame, goals: DataFrame, cap: float = CAP, max_steps: int = 80, tolerance: float = 1e-9) -> DataFrame:
    """src, tilt, mean: distributed Newton steps on the dual, until every source's words meet its target."""
    means = hist.groupBy("src").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)), F.lit(1))).alias("mean"))
    none = F.lit(None).cast("double")
    state = goals.join(means, "src").select("src", "source_size", "target", "mean", F.lit(0.0).alias("tilt"), none.alias("lo"), none.alias("hi"))
    open_ = (F.col("source_size") > 0) & (F.col("target") < cap * F.col("source_size"))
    state = cut(state.where(open_).withColumn("off", F.lit(1.0)))
    x = F.col("size") / F.col("mean")
    raw = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
    for _ in range(max_steps):
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
        sums = hist.join(state.select("src", "tilt", "mean"), "src").groupBy("src").agg(
            F.sum(F.col("n") * F.col("size") * F.least(raw, F.lit(float(cap)))).alias("got"),
            F.sum(F.when(raw < cap, F.col("n") * F.col("size") * x * raw).otherwise(0.0)).alias("slope"),
        )
        s = state.join(sums, "src").withColumn("gap", F.col("got") - F.col("target"))
        s = s.withColumn("lo", F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") >= 0, F.col("tilt")).otherwise(F.col("hi")))
        step = F.col("tilt") - F.col("gap") / F.nullif(F.col("slope"), F.lit(0.0))
        middle = F.when(F.col("lo").isNull(), F.col("hi") * 2 - 1).when(F.col("hi").isNull(), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = step.isNotNull() & (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi"))) & (F.abs(step - F.col("tilt")) <= 2 + F.abs(F.col("tilt")))
        off = F.abs(F.col("gap")) / F.col("target")
        fixed = F.when(F.col("lo") == F.col("hi"), 0.0).when((F.col("hi") - F.col("lo")) < 1e-14 * F.abs(F.col("hi")), 0.0).otherwise(off)
        done = off <= tolerance
        state = cut(s.select("src", "source_size", "target", "mean", F.when(done, F.col("tilt")).when(inside, step).otherwise(middle).alias("tilt"), "lo", "hi", fixed.alias("off")))
    return state.select("src", "tilt", "mean")


def round_rates(size: np.ndarray, n: np.ndarray, rate: np.ndarray, target: float, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """(copies each document of a size gets, how many of them get one more, or one less if negative), for one source.

    From the largest size down, what rounding took too many or too few words
    is carried on. Then single copies are given, taken or moved from one size
    to another while that brings the words nearer to the target.
    """
    base = np.minimum(np.floor(rate), cap).astype(np.int64)
    part = np.where(base >= cap, 0.0, rate - base)
    low, high = np.where(base > 0, -n, 0), np.where(base < cap, n, 0)
    extra, carry = np.zeros(len(size), np.int64), 0.0
    for k in np.argsort(-size, kind="stable"):
        if size[k] > 0:
            extra[k] = min(high[k], max(0, round(part[k] * n[k] + carry / size[k])))
            carry += size[k] * (part[k] * n[k] - extra[k])
    error = target - float((size * (base * n + extra)).sum())
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    for _ in range(1000):
        more, less = order[extra[order] < high[order]], order[extra[order] > low[order]]
        gain = np.concatenate(([0], size[more]))  # nothing, or one copy more of a size
        loss = np.concatenate(([0], size[less]))  # nothing, or one copy less; ascending
        at = np.clip(np.searchsorted(loss, gain - error), 1, len(loss)) - 1
        at = np.where((at + 1 < len(loss)) & (np.abs(gain - loss[np.minimum(at + 1, len(loss) - 1)] - error) < np.abs(gain - loss[at] - error)), at + 1, at)
        left = np.abs(gain - loss[at] - error)
        k = int(left.argmin())
        if left[k] >= abs(error):
            break
        if k:
            extra[more[k - 1]] += 1
        if at[k]:
            extra[less[at[k] - 1]] -= 1
        error -= gain[k] - loss[at[k]]
    return base, extra


def _copies(classes: DataFrame, cap: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        base, extra = round_rates(pdf["size"].to_numpy(), pdf["n"].to_numpy(), pdf["rate"].to_numpy(), float(pdf["target"].iloc[0]), cap)
        return pdf.assign(base=base, extra=extra)[["src", "size", "base", "extra", "source_size", "target"]]

    # A group has one row for each distinct size of a source: bounded by the longest text, not by the corpus.
    return classes.groupBy("src").applyInPandas(run, "src string, size long, base long, extra long, source_size long, target double")


def _cut_offs(keys: DataFrame, fine: DataFrame, classes: DataFrame) -> DataFrame:
    """classes plus key (the last hash that gets the extra copy), of_ties (how many rows of that hash do) and ties (of how many)."""
    earlier = W.partitionBy("src", "size").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    cells = fine.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(classes.where(F.col("extra") != 0).select("src", "size", F.abs("extra").alias("want")), ["src", "size"])
    cells = cells.where((F.col("before") < F.col("want")) & (F.col("want") <= F.col("before") + F.col("n"))).select("src", "size", "range", (F.col("want") - F.col("before")).alias("need"))
    near = keys.join(cells, ["src", "size", "range"]).groupBy("src", "size", "need", "key").agg(F.count(F.lit(1)).alias("ties"))
    lower = W.partitionBy("src", "size").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    at = near.withColumn("of_ties", F.col("need") - F.coalesce(F.sum("ties").over(lower), F.lit(0))).where((F.col("of_ties") > 0) & (F.col("of_ties") <= F.col("ties")))
    return classes.join(at.select("src", "size", "key", "of_ties", "ties"), ["src", "size"], "left")


def _tied(rows: DataFrame) -> DataFrame:
    """rows plus __more: whether a row is among the first __of_ties of its hash. Rows of one hash are numbered by partition, then within it."""
    key = ["__src", "__size", "__key"]
    held = cut(rows).withColumn("__part", F.spark_partition_id())
    counts = held.groupBy(*key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(*key, "__part", F.coalesce(F.sum("__n").over(W.partitionBy(*key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.row_number().over(W.partitionBy(*key, "__part").orderBy(F.lit(0)))
    return held.join(before, [*key, "__part"]).withColumn("__more", number <= F.col("__of_ties")).drop("__part", "__before")


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """docs plus size, source_size, target, copies, taken."""
    new = ("size", "source_size", "target", "copies", "taken")
    own = [c for c in docs.columns if c.lower() not in new]
    marked = _marked(docs.select(*[F.col(f"`{c}`") for c in own]))
    keys = cut(marked.select(F.col("__src").alias("src"), F.col("__size").alias("size"), F.col("__range").alias("range"), F.col("__key").alias("key")))
    fine = cut(keys.groupBy("src", "size", "range").agg(F.count(F.lit(1)).alias("n")))
    hist = cut(fine.groupBy("src", "size").agg(F.sum("n").alias("n")))
    goals = cut(targets(hist, weights, budget, cap))
    tilt = tilts(hist, goals, cap)
    rate = F.when(F.col("source_size") == 0, F.lit(1.0)).when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap)))
    rate = rate.otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    classes = hist.join(goals, "src").join(tilt, "src", "left").withColumn("rate", rate).select("src", "size", "n", "rate", "source_size", "target")
    plan = cut(_cut_offs(keys, fine, cut(_copies(classes, cap))))
    n_classes, any_ties = plan.agg(F.count(F.lit(1)), F.count(F.when(F.col("of_ties") < F.col("ties"), 1))).first()
    named = plan.select(F.col("src").alias("__src"), F.col("size").alias("__size"), "base", "extra", "source_size", "target", F.col("key").alias("__last"), F.col("of_ties").alias("__of_ties"), F.col("ties").alias("__ties"))
    joined = marked.join(F.broadcast(named) if n_classes <= BROADCAST_CLASSES else named, ["__src", "__size"])
    tied = (F.col("__key") == F.col("__last")) & (F.col("__of_ties") < F.col("__ties"))
    out = joined.withColumn("__more", F.coalesce(F.col("__key") <= F.col("__last"), F.lit(False)))
    if any_ties:
        out = out.where(~F.coalesce(tied, F.lit(False))).unionByName(_tied(joined.where(tied)))
    copies = F.col("base") + F.when(F.col("__more"), F.signum("extra").cast("long")).otherwise(F.lit(0))
    out = out.withColumn("copies", copies)
    return out.select(*[F.col(f"`{c}`") for c in own], F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("__size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as its copies say, with its own columns."""
    own = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"__d{i}") for i, c in enumerate(own)], *[F.col(c) for c in ("doc_id", "source", "text")])
    mixed = mix(inner, **how)
    return mixed.select(*[F.col(f"__d{i}").alias(c) for i, c in enumerate(own)], F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("__copy")).drop("__copy")

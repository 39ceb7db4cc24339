"""Mixing sources to target weights by subset-sum budget fitting.

1. Words are counted per document; documents are counted by exact size and source (rows that repeat an id are one entry
   with a count, so copies cost nothing).
2. Targets: sources share ``share`` times all sizes by weight, each at most ``repeats`` times its own size; what is above is shared anew
   by weight, one small aggregate a round, until none is above.
3. A source is taken whole as often as its target holds it; the remaining budget takes part of its documents once more. Sizes
   are walked from the largest down, taking of each its share of the budget (so the mix has the source's spread of
   sizes), all but a reserve; a bounded knapsack over the counts still free (dynamic programming over at most ``BITS`` sums,
   sizes in a seeded order) fills the reserve, most often to the word. A source within the reserve is fitted by the knapsack
   alone. A task holds a source's counts by size: distinct sizes are at most the root of twice its words.
4. Of each size the documents with the lowest seeded hashes are taken. Large groups are counted by bucket of the hash first;
   whole buckets are taken in order and only inside a bucket of about ``BUCKET`` documents are hashes compared.

Defined cases: a null text has no words; documents without words take nothing; null is a source of its own, after all others;
a null doc_id is an id as any other; of repeated rows some may be taken more often than others, the same number at every run;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, words, written

SHARE, REPEATS, WEIGHTS, SEED = 1.5, 2, (5, 2, 1), 13
BITS, RESERVE, BUCKET, RANGES = 1 << 18, 1 << 16, 10_000, 32


def knapsack(sizes: np.ndarray, free: np.ndarray, budget: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """How many of each size to take so that their sum comes nearest to ``budget``, at most ``free`` of each. Exact for
    budgets within ``bits``; beyond, sizes count in units of so many words."""
    took = np.zeros(len(sizes), "int64")
    usable = np.flatnonzero((free > 0) & (sizes > 0))
    if budget <= 0 or not len(usable):
        return took
    slack = max(int(sizes[usable].min()), min(budget, int(sizes[usable].max()), bits - budget))  # the nearest sum may lie above
    unit = max(1, -(-(budget + slack) // bits))
    goal, most = round(budget / unit), (budget + slack) // unit + 1
    reach, first, items = np.zeros(most + 1, bool), np.full(most + 1, -1), []
    reach[0] = True
    for i in np.random.default_rng(seed).permutation(usable).tolist():
        w = max(1, round(int(sizes[i]) / unit))
        left, step = min(int(free[i]), most // w), 1
        while left > 0 and not reach[goal]:
            n = min(step, left)
            new = np.flatnonzero(reach[: most + 1 - n * w] & ~reach[n * w :]) + n * w
            reach[new], first[new] = True, len(items)
            items.append((i, n, n * w))
            left, step = left - n, step * 2
        if reach[goal]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.abs(sums - goal).argmin()])
    # a sum was first reached by its item from a sum that earlier items had reached, so no item is used twice
    while at:
        i, n, w = items[first[at]]
        took[i] += n
        at -= w
    return took


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """How many documents of each size to take once more for a budget of words."""
    took = np.zeros(len(sizes), "int64")
    some = sizes[(sizes > 0) & (counts > 0)]
    if budget <= 0 or not len(some):
        return took
    total = int((sizes.astype(object) * counts).sum())
    bulk = max(0, budget - max(reserve, 8 * int(some.min())))
    due = done = 0
    for i in np.argsort(-sizes, kind="stable").tolist() if bulk else ():
        size, count = int(sizes[i]), int(counts[i])
        if size:
            due += size * count * bulk
            took[i] = min(count, (due // total - done) // size)
            done += size * int(took[i])
    return took + knapsack(sizes, counts - took, budget - done, bits, seed)


def targets(sizes: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target, from (source, source_size), one row a source."""
    ordered = sizes.repartitionByRange(RANGES, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = written(ordered.select("source", "source_size", F.monotonically_increasing_id().alias("row")))
    parts = {r[0]: r[1] for r in ordered.groupBy(F.expr("shiftright(row, 33)")).count().collect()}
    before = {p: sum(n for q, n in parts.items() if q < p) for p in parts}
    offset = F.element_at(F.create_map(*[F.lit(v) for p in (before or {0: 0}).items() for v in p]), F.expr("shiftright(row, 33)"))
    place = (offset + F.expr("row & 8589934591")) % len(weights)
    d = ordered.withColumns({"weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")), "most": repeats * F.col("source_size").cast("double")})
    all_words = float(d.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        above = F.lit(stopped >= 0) & (F.col("weight") * level > F.col("most"))
        n, fixed, rest = d.agg(F.count_if(above), F.sum(F.when(above, F.col("most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if n == stopped or not rest:
            break
        level, stopped = (all_words - fixed) / rest, n
    return d.select("source", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def mixture(docs: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS, seed: int = SEED, reserve: int = RESERVE, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken, one row per input row."""
    d = docs.select(F.col("source").cast("string").alias("source"), "doc_id", F.size(words(F.col("text"))).cast("long").alias("size"))
    d = written(d.groupBy("source", "size", "doc_id").agg(F.count("*").alias("m")))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key")  # no null in a join's key
    hist = written(d.groupBy("source", "size").agg(F.sum("m").alias("n")))
    aims = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, repeats, weights)
    aims = written(aims.select(key, "source", "source_size", "target", F.floor(F.try_divide("target", "source_size") + 1e-12).alias("passes")))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        target, whole, passes = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0]), pdf["passes"].iloc[0]
        passes = 0 if pd.isna(passes) else int(passes)
        extra = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), min(whole, max(0, round(target - passes * whole))) if passes < repeats else 0, reserve, bits, seed)
        return pdf[["key", "size", "source_size", "target"]].assign(passes=passes, extra=extra)

    sized = hist.select(key, "size", "n").join(aims.drop("source"), "key")
    counts = written(sized.groupBy("key").applyInPandas(plan, "key string, size long, source_size long, target double, passes long, extra long"))
    buckets = max(1, -(-(hist.agg(F.max("n")).first()[0] or 0) // bucket))
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = d.select(key, "size", "doc_id", "m", hashed.alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    of_bucket = d.groupBy("key", "size", "bucket").agg(F.sum("m").alias("n")).join(counts, ["key", "size"])
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_bucket = of_bucket.select("key", "size", "bucket", "source_size", "target", "passes", F.greatest(F.lit(0), F.least("n", F.col("extra") - before)).alias("extra"))
    inside = Window.partitionBy("key", "size", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(of_bucket, ["key", "size", "bucket"]).withColumn("more", F.col("extra") - F.coalesce(F.sum("m").over(inside), F.lit(0)))
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).withColumn("times", F.col("passes") + F.when(F.col("copy") <= F.col("more"), 1).otherwise(0))
    source = F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("source")
    return d.select("doc_id", source, "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def op13_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))

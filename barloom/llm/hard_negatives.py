"""Hard negatives by a full score sort per anchor.

Components become floor(256 x), so scores are integers and ties are exact. Rows are dealt evenly to blocks, anchors to blocks
of their own; a task scores one block of anchors against one block of rows, sorts every anchor's scores of that block by
(score falling, id rising), and gives at most a few rows per anchor; windows merge the blocks:

1. within a label, the first ``positives`` other rows of each anchor;
2. over all rows: for each positive the upper limit is found in the sorted scores by binary search, and the first ``k``
   rows of another label are read from there down to the lower limit.

So the work is anchors x rows, as the question is, and no task ever holds a label or an anchor's whole list. A row of
vectors is shipped once for each ``ANCHORS`` anchors.

Scores are exact: single-precision products where no partial sum can reach 2^24 (Cauchy-Schwarz bound of the block),
double below 2^53, Python integers beyond; scores beyond ``MOST`` count as ``MOST``.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; vectors are
compared with vectors of their length only; rows that repeat an id are rows of their own, so a repeated anchor is asked
and answered once for each; anchors without positives, and positives without negatives between their limits, give no
rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, wide, written

BLOCK, LEAST_BLOCK, ANCHORS, MOST = 16_384, 1024, 4096, 2**63 // 128


def _whole(x: float) -> int:
    y = 256.0 * x
    return math.floor(y) if math.isfinite(y) else int(x) * 256


def scores(a, b) -> np.ndarray:
    """Integer inner products of two lists of vectors after floor(256 x)."""
    a, b = (np.stack([np.asarray(r, "float64") for r in v]) for v in (a, b))
    with np.errstate(over="ignore"):
        p, q = np.floor(256.0 * a), np.floor(256.0 * b)
        bound = np.sqrt((p * p).sum(1).max()) * np.sqrt((q * q).sum(1).max()) * 1.001
    if bound < 2**53:
        kind = "float32" if bound < 2**24 else "float64"
        return (p.astype(kind) @ q.astype(kind).T).astype("int64")
    p, q = (np.array([[_whole(x) for x in r] for r in v.tolist()], dtype=object) for v in (a, b))
    return np.vectorize(lambda s: max(-MOST, min(MOST, s)), otypes=["int64"])(p.dot(q.T))


def by_score(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores falling, and the places they come from; equal scores by place. One sort of packed integers where they fit."""
    bits = max(1, len(s).bit_length())
    place = np.arange(len(s))
    if len(s) and max(int(s.max()), -int(s.min())) < 1 << (62 - bits):
        key = np.sort((-s << bits) | place)
        return -(key >> bits), key & ((1 << bits) - 1)
    order = np.lexsort((place, -s))
    return s[order], order


def _first(pdf: pd.DataFrame, positives: int) -> pd.DataFrame:
    """The first same-label rows of every anchor in one block of its label."""
    pdf = pdf.sort_values(["vec_id", "u"])
    asked, rows = pdf[pdf["asks"]], pdf[~pdf["asks"]]
    out = []
    if len(asked) and len(rows):
        s, ids, us = scores(asked["embedding"], rows["embedding"]), rows["vec_id"].to_numpy(), rows["u"].to_numpy()
        for i, u in enumerate(asked["u"].tolist()):
            score, place = by_score(s[i])
            own = us[place[: positives + 1]] != u
            out += [(u, *x) for x in zip(ids[place[: positives + 1]][own][:positives].tolist(), us[place[: positives + 1]][own][:positives].tolist(), score[: positives + 1][own][:positives].tolist())]
    return pd.DataFrame(out, columns=["u", "positive_id", "pu", "positive_score"], dtype="int64")


def _between(pdf: pd.DataFrame, k: int, lower: int, upper: int) -> pd.DataFrame:
    """For every anchor and positive, the first other-label rows of one block between the positive's limits."""
    pdf = pdf.sort_values(["vec_id", "u"])
    asked, rows = pdf[pdf["asks"]], pdf[~pdf["asks"]]
    out = []
    if len(asked) and len(rows):
        s, ids, us, labels = scores(asked["embedding"], rows["embedding"]), rows["vec_id"].to_numpy(), rows["u"].to_numpy(), rows["label"].to_numpy()
        for i, (u, label, known) in enumerate(zip(asked["u"].tolist(), asked["label"].tolist(), asked["known"])):
            score, place = by_score(s[i])
            other = labels[place] != label
            score, place = score[other], place[other]
            for p in known:
                limit, least = upper * int(p["positive_score"]) // 100, -(-lower * int(p["positive_score"]) // 100)
                first = int(np.searchsorted(-score, -limit, "left"))
                got = score[first : first + k]
                n = int((got >= least).sum())
                at = place[first : first + n]
                out += [(u, int(p["pu"]), *x) for x in zip(ids[at].tolist(), us[at].tolist(), got[:n].tolist())]
    return pd.DataFrame(out, columns=["u", "pu", "negative_id", "nu", "negative_score"], dtype="int64")


def hard_negatives(vectors: DataFrame, asks, positives: int = 5, k: int = 10, lower: int = 30, upper: int = 90, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``asks`` says which rows are anchors;
    ``lower`` and ``upper`` are the limits in hundredths of the positive's score."""
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    x = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("embedding"), F.coalesce(asks, F.lit(False)).alias("anchor"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    d = d.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    d = written(d.select("*", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("u")))
    n, asked = d.agg(F.count("*"), F.count_if("anchor")).first()
    row_blocks = max(1, -(-n // block), min(wide(spark), n // LEAST_BLOCK))
    anchor_blocks = max(1, -(-asked // anchors))

    def dealt(rows: DataFrame, seed: int, blocks):
        return F.pmod(F.xxhash64("u", F.lit(seed)), F.greatest(F.lit(1), blocks).cast("long")).cast("int")

    def every(blocks):
        return F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), blocks).cast("int") - 1))

    empty = F.lit(None).cast("array<struct<pu:long,positive_score:long>>")
    # positives: blocks of each label
    sizes = d.groupBy("dim", "label").agg(F.ceil(F.count("*") / block).alias("nr"), F.ceil(F.count_if("anchor") / anchors).alias("na")).filter("na > 0")
    own = d.join(sizes, ["dim", "label"])
    rows = own.withColumns({"asks": F.lit(False), "r": dealt(own, 1, F.col("nr"))}).withColumn("a", every(F.col("na")))
    ask = own.filter("anchor").withColumns({"asks": F.lit(True), "a": dealt(own, 2, F.col("na"))}).withColumn("r", every(F.col("nr")))
    names = ["dim", "label", "a", "r", "asks", "u", "vec_id", "embedding"]
    found = rows.select(names).union(ask.select(names)).groupBy("dim", "label", "a", "r").applyInPandas(lambda p: _first(p, positives), "u long, positive_id long, pu long, positive_score long")
    best = Window.partitionBy("u").orderBy(F.desc("positive_score"), "positive_id", "pu")
    found = written(found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives).drop("place"))
    # negatives: blocks of all rows
    known = found.groupBy("u").agg(F.collect_list(F.struct("pu", "positive_score")).alias("known"))
    names = ["dim", "a", "r", "asks", "u", "vec_id", "label", "embedding", "known"]
    rows = d.withColumns({"asks": F.lit(False), "known": empty, "r": dealt(d, 3, F.lit(row_blocks))}).withColumn("a", every(F.lit(anchor_blocks)))
    ask = d.filter("anchor").join(known, "u").withColumns({"asks": F.lit(True), "a": dealt(d, 4, F.lit(anchor_blocks))}).withColumn("r", every(F.lit(row_blocks)))
    near = rows.select(names).union(ask.select(names)).groupBy("dim", "a", "r").applyInPandas(lambda p: _between(p, k, lower, upper), "u long, pu long, negative_id long, nu long, negative_score long")
    hard = Window.partitionBy("u", "pu").orderBy(F.desc("negative_score"), "negative_id", "nu")
    near = near.withColumn("rank", F.row_number().over(hard)).filter(F.col("rank") <= k)
    ids = d.filter("anchor").select("u", F.col("vec_id").alias("anchor_id"))
    return near.join(found, ["u", "pu"]).join(ids, "u").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 100; labels of ids divisible by 7 are first moved on by one, modulo 10."""
    v = table(spark, sf_dir, "embeddings")
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(v, F.col("vec_id") % 100 == 0)


ORACLE = """WITH v AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.u, a.vec_id AS anchor_id, a.label AS own, b.u AS o, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.u <> b.u AND len(a.q) = len(b.q)),
p AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id, o) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.u, p.o ORDER BY s.score DESC, s.vec_id, s.o)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
 FROM p JOIN s ON s.u = p.u AND s.label <> s.own AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10"""

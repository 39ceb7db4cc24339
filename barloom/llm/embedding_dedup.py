"""Near-duplicate vectors of equal label by robust-pruned flat graphs on overlapping cluster shards.

1. Equal vectors of a label become one class with a count.
2. Centroids per label, from a bounded sample (``SAMPLE`` classes with the lowest hash, read to the driver), send each
   class to its ``OVERLAP`` nearest clusters of about ``TARGET`` classes; their number grows with the table up to one for
   ``PER_CENTROID`` classes of the sample. A cluster of more than ``SHARD`` classes is dealt to blocks.
3. Each block builds a flat graph (``flat_graph``); a class's neighbour lists from all its shards are united.
4. Each block is searched from its medoid, range expanded, for its own classes and for those of later blocks of its cluster;
   what is found is confirmed in double precision and counts for both ends. These guests come in slices of ``SLICE``, the
   block's own rows once for each, so no task holds a whole cluster, and blocks lose no pair.
5. A pair counts in the first cluster that both classes share, so counts need no pairs; for the components a slice
   gives a spanning forest of its links. So a group of thousands of near copies costs rows in proportion to its size.

``audit_recall`` measures recall against brute force for every row whose id is divisible by 100.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links with
nothing, as do vectors of different length; repeated rows link with each other; a null vec_id names no component unless
all ids there are null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .components import components
from .flat_graph import build, in_range

SAMPLE, SHARD, SLICE, TARGET, OVERLAP, PER_CENTROID = 20_000, 1024, 4096, 256, 3, 8


def _units(rows) -> np.ndarray:
    x = np.stack([np.asarray(r, "float64") for r in rows])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    c = x[np.random.default_rng(5).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def _clusters(classes: DataFrame, sample: int) -> dict:
    """Centroids by (label, length); labels that the sample lacks have one cluster."""
    total = classes.count()
    rows = classes.select("label", "dim", "embedding", "key").orderBy(F.xxhash64("key"), "key").limit(sample).toPandas()
    share = total / max(1, len(rows))
    out = {}
    for kind, part in rows.groupby(["label", "dim"], sort=True):
        k = min(max(1, len(part) // PER_CENTROID), math.ceil(OVERLAP * share * len(part) / TARGET))
        if k > OVERLAP:
            out[tuple(int(v) for v in kind)] = _centroids(_units(part["embedding"]), k).astype("float32")
    return out


def near_vectors(vectors: DataFrame, least: float = 0.98, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per input row."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    own = own.withColumn("key", F.when(usable, F.xxhash64("label", "embedding")))
    ids = own.select("vec_id", "key")
    classes = own.filter("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("m"))
    classes = written(classes.withColumn("dim", F.size("embedding").cast("long")))
    model = _clusters(classes, sample)

    def assign(batches):
        for pdf in batches:
            near: list = [[0]] * len(pdf)
            for kind, part in pdf.groupby(["label", "dim"]):
                c = model.get(tuple(int(v) for v in kind))
                if c is not None:
                    top = np.argsort(-(_units(part["embedding"]) @ c.T), 1, kind="stable")[:, :OVERLAP]
                    for i, t in zip(pdf.index.get_indexer(part.index), np.sort(top, 1).tolist()):
                        near[i] = t
            yield pdf.assign(near=near)

    placed = classes.select("key", "label", "dim", "m", "embedding").mapInPandas(assign, "key long, label long, dim long, m long, embedding array<double>, near array<int>")
    placed = placed.withColumn("cluster", F.explode("near"))
    kind = ["label", "dim", "cluster"]
    sizes = placed.groupBy(*kind).agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks"))
    placed = written(placed.join(sizes, kind).withColumn("block", F.expr("cast(pmod(xxhash64(key, 1), blocks) as int)")))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        key = pdf["key"].to_numpy()
        adj = build(_units(pdf["embedding"]).astype("float32"))
        return pd.DataFrame({"key": key, "near_keys": [key[a[a >= 0]].tolist() for a in adj]})

    lists = placed.select("key", *kind, "block", "embedding").groupBy(*kind, "block").applyInPandas(graph, "key long, near_keys array<long>")
    lists = lists.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near_keys"))).alias("near_keys"))
    # a block's guests are the classes of later blocks; every slice of them gets the block's own rows
    slices = F.expr(f"greatest(1, cast(ceil((blocks - 1 - block) * {shard} / {SLICE}) as int))")
    homes = placed.join(lists, "key").withColumns({"home": F.lit(True), "slices": slices})
    homes = homes.withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
    guests = placed.filter("block > 0").withColumn("block", F.explode(F.expr("sequence(0, block - 1)"))).withColumn("slices", slices)
    guests = guests.withColumns({"near_keys": F.lit(None).cast("array<long>"), "home": F.lit(False), "slice": F.expr("cast(pmod(xxhash64(key, 2), slices) as int)")})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        cluster = int(pdf["cluster"].iloc[0])
        pdf = pdf.sort_values(["home", "key"], ascending=[False, True])
        n, first = int(pdf["home"].sum()), int(pdf["slice"].iloc[0]) == 0
        key, m = pdf["key"].to_numpy(), pdf["m"].to_numpy()
        exact = _units(pdf["embedding"])
        x = exact.astype("float32")
        place = {k: i for i, k in enumerate(key[:n].tolist())}
        lists = [[place[k] for k in ks if k in place] for ks in pdf["near_keys"].iloc[:n]]
        adj = np.full((n, max(1, *map(len, lists)) if lists else 1), -1)
        for i, a in enumerate(lists):
            adj[i, : len(a)] = a
        # the block's own pairs are looked for beside the first slice only
        asked = np.arange(0 if first else n, len(key))
        hit = np.zeros((len(key), n), bool)
        hit[asked] = in_range(x[:n], exact[:n], adj, x[asked], exact[asked], least)
        hit[:n] |= hit[:n].T
        hit[np.arange(n), np.arange(n)] = False
        # the first cluster that both share: the smallest common number of the short sorted lists
        near = [np.asarray(v) for v in pdf["near"]]
        width = max(map(len, near))
        lists = np.stack([np.r_[v, np.full(width - len(v), -1)] for v in near])
        before = np.where(lists < cluster, lists, -1)
        q, v = np.nonzero(hit)
        earlier = np.zeros(len(q), bool)
        for a in range(width):
            for b in range(width):
                earlier |= (before[q, a] >= 0) & (before[q, a] == before[v, b])
        links = np.bincount(q, weights=np.where(earlier, 0, m[v]), minlength=len(key))
        links += np.bincount(v, weights=np.where(earlier | (q < n), 0, m[q]), minlength=len(key))  # a guest's pair counts for the block's class too
        links = links.astype("int64")
        rows = [(k, None, c) for k, c in zip(key.tolist(), links.tolist()) if c]
        root = list(range(len(key)))
        for a, b in zip(q.tolist(), v.tolist()):
            i, j = a, b
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            if i != j:
                root[max(i, j)] = min(i, j)
                rows.append((int(key[a]), int(key[b]), 0))
        return pd.DataFrame(rows, columns=["a", "b", "links"], dtype=object).astype({"a": "int64", "b": "Int64", "links": "int64"})

    columns = ["key", *kind, "block", "slice", "m", "embedding", "near", "near_keys", "home"]
    found = homes.select(columns).unionByName(guests.select(columns)).groupBy(*kind, "block", "slice").applyInPandas(search, "a long, b long, links long")
    found = written(found)
    counts = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "key")
    of_class = classes.select("key", "m").join(counts, "key", "left").join(roots, "key", "left")
    of_class = of_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    rows = ids.join(of_class, "key", "left")
    least_id = rows.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = rows.join(least_id, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, least: float = 0.98, every: int = 100) -> DataFrame:
    """(found, true_links, false_links) over all rows whose id is divisible by ``every``: their links by brute force against
    all rows of their label; of each row, links beyond its true ones are false."""
    asked = vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "embedding")
    others = vectors.select(F.col("vec_id").alias("o_id"), F.col("label").alias("o_label"), F.col("embedding").alias("o_emb"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cos = dot("embedding", "o_emb") / F.sqrt(dot("embedding", "embedding") * dot("o_emb", "o_emb"))
    true = asked.join(others, (F.col("label") == F.col("o_label")) & (F.col("vec_id") != F.col("o_id"))).filter(cos >= least)
    true = true.groupBy("vec_id").count()
    both = asked.select("vec_id").join(true, "vec_id", "left").join(result.select("vec_id", "n_links"), "vec_id")
    n = F.coalesce(F.col("count"), F.lit(0))
    return both.agg(F.sum(F.least("n_links", n)).alias("found"), F.sum(n).alias("true_links"), F.sum(F.greatest(F.col("n_links") - n, F.lit(0))).alias("false_links"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))

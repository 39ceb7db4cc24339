"""MinHash near-duplicates by an LSH forest.

1. Scan: each whole text becomes the hash of its shingle set, its size and a signature of ``TREES * DEPTH`` minima.
   Documents with equal sets are one class from here on.
2. Forest: each tree orders the classes by its own run of minima. A region of a tree is a longest common prefix: it
   starts ``SHALLOW`` minima deep and is deepened only while more than ``REGION`` classes share it. What is still larger
   at full depth is dealt to blocks. Neighbours of a region in signature order are candidates where size and estimated
   similarity allow a link. Classes that were in a deepened region stand in ``MORE`` further trees, as some of their
   pairs part below ``SHALLOW``.
3. First, only a spanning forest of each block's candidates (stars around the smallest class where the estimate is high)
   and one pair from each block to its region's smallest class are confirmed on full shingle sets, so that a group of
   thousands of copies costs pairs in proportion to its size.
4. Then every candidate pair of a block whose ends are still in different components is looked at too, in the first tree
   that has both in one block. So no pair is left out for the size of a group: pairs inside one component can't change
   the result. Before these pairs are confirmed on full sets, an exact bound removes those that can't link: with shingles
   in one order, rare ones first, nothing before the first common shingle of two sets is common.
5. A region of several blocks isn't compared block by block. All classes of such regions (where a region holds several
   components) meet by equi-joins on their first shingles, under the same bound: a link's smaller set has a common
   shingle among its first n - ceil(2t / (1 + t) n) + 1, so a frame that many documents share, but that links none of
   them, makes no pair. Of a shingle's largest component, only pairs with other components are formed.

With similarity s, a pair misses all trees with (1 - s^3)^12, and where both are in deepened regions with (1 - s^5)^28 at
most: together under 2e-5 at 0.85 and 2e-4 at 0.8, whatever the size of a group. Estimates more than four standard
deviations under the threshold aren't confirmed; that alone misses another 3.1e-5 and 3.4e-5.

Defined cases: null or empty text, or text without words, has the empty set (size 0) and is linked with nothing;
repeated rows and equal sets are linked; a null doc_id counts as no id: it is linked, but names no component unless
all ids there are null (component_id null), and is kept only then; other columns are ignored; an empty table gives an
empty result; texts of any length are read whole. Equal sets are known by a 64-bit hash of the set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mixed, random_words, runs, utf8
from .common import table, wide, written
from .components import components

TREES, MORE, DEPTH, SHALLOW, REGION = 12, 16, 5, 3, 128
SIGMAS, STAR = 4, 0.05
CHUNK = 1 << 20
_BYTE = random_words(11, 256)
_MINIMA = random_words(23, (TREES + MORE) * DEPTH)
_PLACE = random_words(37, 2)
_WORD = random_words(41, 64)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the rows, ASCII letters lower-cased, and the number of words before each row. One text of
    more than ``CHUNK`` bytes is read in pieces that end with white space, as the arrays below take 60 bytes a byte."""
    if len(off) == 2 and len(data) > CHUNK:
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + CHUNK)
            while end < len(data):
                gap = np.flatnonzero((data[at:end] == 32) | ((data[at:end] >= 9) & (data[at:end] <= 13)))
                if len(gap):
                    end = at + int(gap[-1]) + 1
                    break
                end = min(len(data), end + CHUNK)
            parts.append(_word_hashes(data[at:end], np.array([0, end - at]))[0])
            at = end
        h = np.concatenate(parts)
        return h, np.array([0, len(h)])
    return _word_hashes(data, off)


def _word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype("uint8")
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    first, last = word.copy(), word.copy()
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power = np.full(n + 1, _PLACE[0], "uint64")
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.zeros(n + 1, "uint64")
    np.cumsum(_BYTE[low] * power[:n], out=total[1:])
    back = np.full(n + 1, np.uint64(pow(int(_PLACE[0]), -1, 1 << 64)), "uint64")
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    h = mixed((total[end] - total[start]) * back[start] + (end - start).astype("uint64") * _PLACE[1])
    return h, np.searchsorted(start, off)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, one after the other, and their offsets."""
    h, at = word_hashes(data, off)
    sets, size, n = [], np.zeros(len(off), "int64"), len(h) - words + 1
    if n > 0:
        grams = mixed(sum(h[j : n + j] * _WORD[j] for j in range(words)))
    for i in range(len(off) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= words:
            s = np.unique(grams[a : b - words + 1])
        else:  # the whole sequence as one; its length goes into the choice of factors
            s = mixed((h[a:b] * _WORD[32 : 32 + b - a]).sum(keepdims=True) + _WORD[b - a]) if b > a else h[:0]
        sets.append(s)
        size[i + 1] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, "uint64")), np.cumsum(size)


def _signatures(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The minima of each nonempty set, 16 bits each: the high half of a minimum of 32 bits would be biased, so the low one."""
    out = np.empty((len(at) - 1, len(_MINIMA)), "uint16")
    for k, m in enumerate(_MINIMA):
        out[:, k] = np.minimum.reduceat((s * m) >> np.uint64(32), at[:-1]) & np.uint64(0xFFFF)
    return out


SCANNED = "doc_id long, text_hash long, n long, c long, sig binary, more binary"


def _scan(words: int):
    def scan(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            n, c, sig, more = [], [], [], []
            for a, b in runs(off, CHUNK):
                part, cut = data[off[a] : off[b]], off[a : b + 1] - off[a]
                s, at = shingle_sets(part, cut, words)
                size = np.diff(at)
                total = np.zeros(len(s) + 1, "uint64")
                np.cumsum(mixed(s ^ _PLACE[0]), out=total[1:])
                n.append(size)
                c.append(mixed(total[at[1:]] - total[at[:-1]] + size.astype("uint64")).view("int64"))
                some = np.flatnonzero(size)
                rows: list = [(None, None)] * (b - a)
                if len(some):
                    for i, x in zip(some, _signatures(s, np.append(at[some], len(s)))):
                        rows[i] = x[: TREES * DEPTH].tobytes(), x[TREES * DEPTH :].tobytes()
                sig += [x for x, _ in rows]
                more += [x for _, x in rows]
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, "int64")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(cat(n)), pa.array(cat(c)), pa.array(sig, pa.binary()), pa.array(more, pa.binary())],
                names=[x.split()[0] for x in SCANNED.split(", ")],
            )

    return scan


def _linkable(n: np.ndarray, other: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * np.minimum(n, other) >= num * np.maximum(n, other)


def _block_pairs(sig: np.ndarray, n: np.ndarray, group: np.ndarray, comp: np.ndarray | None, least: int, num: int, den: int):
    """Positions (i, j) and equal minima of the candidate pairs inside each group of neighbours."""
    left, right, est = [], [], []
    i = np.flatnonzero(group[:-1] == group[1:]) if len(group) > 1 else np.zeros(0, "int64")
    step = 1
    while len(i):
        ok = i[_linkable(n[i], n[i + step], num, den)]
        if comp is not None:
            ok = ok[comp[ok] != comp[ok + step]]
        for a in range(0, len(ok), 50_000):
            p = ok[a : a + 50_000]
            same = (sig[p] == sig[p + step]).sum(1)
            keep = same >= least
            left.append(p[keep])
            right.append(p[keep] + step)
            est.append(same[keep])
        step += 1
        i = i[i + step < len(group)]
        i = i[group[i] == group[i + step]]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, "int64")
    return cat(left), cat(right), cat(est)


def _forest(left, right, est, c, star: int) -> np.ndarray:
    """Which of the pairs span the groups: high estimates count as equal, so stars form around the smallest class."""
    a, b = np.minimum(c[left], c[right]), np.maximum(c[left], c[right])
    order = np.lexsort((b, a, -np.minimum(est, star)))
    root, keep = {}, []

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    for k, i, j in zip(order.tolist(), left[order].tolist(), right[order].tolist()):
        i, j = find(i), find(j)
        if i != j:
            root[j] = i
            keep.append(k)
    return np.array(keep, "int64")


def _grouped(batches, most: int = 200_000):
    """Batches re-cut so that a group (equal ``g``, sorted) is never split."""
    held: list = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < most:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        g = t.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield t.slice(0, cut)
            held, size = t.slice(cut).to_batches(), t.num_rows - cut
        else:
            held = t.to_batches()
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _may_link(p: np.ndarray, n: int, q: dict, m: int, num: int, den: int) -> bool:
    """Whether two sets of sizes n and m can reach the threshold: p holds the first shingles of one in order, q the place
    of the first shingles of the other."""
    for i, x in enumerate(p):
        if (j := q.get(x)) is not None:
            both = min(n - i, m - j)
            return den * both >= num * (n + m - both)
    return False


def _pairs_of(step: str, num: int, den: int):
    """step: ``forest`` for the pairs that span each block, ``nodes`` for the classes (as a and b) of the pairs across
    components, ``cross`` for these pairs, as far as the first shingles (column ``first``) let them link, each in the
    first tree that has both in one block (``slots`` names the blocks of a class by tree)."""
    minima, limit = TREES * DEPTH, num / den
    least, star = int(minima * limit - SIGMAS * (minima * limit * (1 - limit)) ** 0.5), int(minima * min(0.95, limit + STAR))

    def pairs(batches):
        for t in _grouped(batches):
            c, n, g = (t.column(x).to_numpy() for x in ("c", "n", "g"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "uint16").reshape(-1, TREES * DEPTH)
            comp = None if step == "forest" else t.column("comp").to_numpy()
            left, right, est = _block_pairs(sig, n, g, comp, least, num, den)
            if step == "forest":
                keep = _forest(left, right, est, c, star)
                left, right = left[keep], right[keep]
            if step == "cross" and len(left):
                slots = t.column("slots").combine_chunks().flatten().to_numpy().reshape(len(c), -1)
                tree = t.column("tree").to_numpy()
                at = np.concatenate([(slots[left[i : i + 50_000]] == slots[right[i : i + 50_000]]).argmax(1) for i in range(0, len(left), 50_000)])
                left, right = left[at == tree[left]], right[at == tree[left]]
            a, b = np.minimum(c[left], c[right]), np.maximum(c[left], c[right])
            pair = np.unique(np.stack([a, b], 1)[a != b], axis=0)
            if step == "nodes":
                one = np.unique(pair)
                pair = np.stack([one, one], 1)
            elif step == "cross" and len(pair):
                row = {x: i for i, x in enumerate(c.tolist())}
                first = {x: t.column("first")[row[x]].as_py() for x in np.unique(pair).tolist()}
                place = {x: {s: i for i, s in enumerate(p)} for x, p in first.items()}
                keep = [_may_link(first[x], int(n[row[x]]), place[y], int(n[row[y]]), num, den) for x, y in pair.tolist()]
                pair = pair[np.array(keep, bool)]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    return pairs


def _shingle_rows(words: int):
    def rows(batches):
        for t in batches:
            sets, at = shingle_sets(*utf8(t.column("text")), words)
            c = np.repeat(t.column("c").to_numpy(), np.diff(at))
            for i in range(0, len(sets), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]), pa.array(sets[i : i + 50_000].view("int64"))], names=["c", "s"])

    return rows


def _first_shingles(texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(c, first): of each class the shingles, rare ones first, of which a linked class must have at least one."""
    rows = texts.select("c", "text").mapInArrow(_shingle_rows(words), "c long, s long")
    rare = rows.groupBy("s").agg(F.count("*").alias("df"))
    order = rows.join(rare, "s").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("all"))
    count = F.expr(f"cast(size(all) - ceil(size(all) * {num} / {den}) + 1 as int)")
    return order.select("c", F.transform(F.slice("all", 1, count), lambda x: x["s"]).alias("first"))


def _across(first: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) across components that share a first shingle and may link, of all (c, n, comp, first)."""
    short = F.expr(f"n - (2 * {num} * n + {num + den - 1}) div {num + den} + 1")
    rows = written(first.select("c", "n", "comp", short.alias("short"), F.posexplode("first").alias("p", "s")))
    share = rows.groupBy("s", "comp").count().groupBy("s").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("count", "comp")).alias("major"))
    rows = written(rows.join(share.filter("comps > 1"), "s").withColumn("minor", F.col("comp") != F.col("major")).drop("comps", "major"))
    both = F.least(F.col("l.n") - F.col("l.p"), F.col("r.n") - F.col("r.p"))
    ahead = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.c") < F.col("r.c")))
    may = (F.col("l.comp") != F.col("r.comp")) & ahead & (den * F.col("l.n") >= num * F.col("r.n")) & (den * both >= num * (F.col("l.n") + F.col("r.n") - both))

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        found = left.alias("l").join(right.alias("r"), (F.col("l.s") == F.col("r.s")) & may)
        return found.select(F.least("l.c", "r.c").alias("a"), F.greatest("l.c", "r.c").alias("b"))

    small = rows.filter("p < short")
    return met(small.filter("minor"), rows).union(met(small.filter("not minor"), rows.filter("minor"))).distinct()


def _ordered(rows: DataFrame, parts: int) -> DataFrame:
    """Blocks together, in the signature order of their tree; ``g`` names the block."""
    rows = rows.withColumn("g", F.xxhash64("tree", "depth", "region", "block"))
    return rows.repartition(parts, "g").sortWithinPartitions("g", "path", "c")


def _paths(classes: DataFrame, sig: str, first: int, trees: int) -> DataFrame:
    """Each class in so many trees from number ``first``, whose minima are in ``sig``."""
    keys = classes.withColumn("tree", F.explode(F.sequence(F.lit(first), F.lit(first + trees - 1))))
    return keys.select("c", "n", "tree", F.expr(f"substring({sig}, (tree - {first}) * {2 * DEPTH} + 1, {2 * DEPTH})").alias("path"))


def _levels(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The regions of some trees, see ``_regions``; and the classes that an over-full region took deeper."""
    out = full = None
    for depth in range(SHALLOW, DEPTH + 1):
        rows = keys.withColumn("region", F.xxhash64(F.substring("path", 1, 2 * depth)))
        count = rows.groupBy("tree", "region").count().filter("count > 1")
        rows = rows.join(count, ["tree", "region"])
        if depth == SHALLOW:
            rows = written(rows)
            full = rows.filter(F.col("count") > REGION).select("c").distinct()
        done = rows if depth == DEPTH else rows.filter(F.col("count") <= REGION)
        blocks = F.ceil(F.col("count") / REGION).cast("int")
        done = done.select("tree", F.lit(depth).alias("depth"), "region", F.pmod(F.xxhash64("c"), blocks).cast("int").alias("block"), blocks.alias("blocks"), "c", "n", "path")
        out = done if out is None else out.unionByName(done)
        keys = rows.filter(F.col("count") > REGION).select("c", "n", "tree", "path")
    return out, full


def _regions(classes: DataFrame) -> DataFrame:
    """(tree, depth, region, block, blocks, c, n, sig, path) of all classes that share a region with another one; classes
    of over-full regions stand in ``MORE`` further trees, for the pairs that part below."""
    out, full = _levels(_paths(classes, "sig", 0, TREES))
    more, _ = _levels(_paths(classes.join(written(full), "c"), "more", TREES, MORE))
    # signatures join last, so that the trees are dealt without them
    return out.unionByName(more).join(classes.select("c", "sig"), "c")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""

    def check(batches):
        said: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("text_a"), batch.column("text_b")
            for i, (x, y) in enumerate(zip(a, b)):
                for c, t in ((x, ta), (y, tb)):
                    if c not in said:
                        if len(said) > 200:
                            said.clear()
                        said[c] = shingle_sets(*utf8(t.slice(i, 1)), words)[0]
                # the first may have gone when the second came
                s = said[x] if x in said else shingle_sets(*utf8(ta.slice(i, 1)), words)[0]
                r = said[y]
                both = len(np.intersect1d(s, r, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(r) - both))
            t = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield t

    left = texts.select(F.col("c").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("c").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id, one row per input row; shingles of so many ``words``,
    links at ``num / den`` or more."""
    parts = wide(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("text_hash", F.xxhash64("text"))
    scanned = written(own.select("doc_id", "text_hash", "text").mapInArrow(_scan(words), SCANNED))
    classes = scanned.filter("n > 0").groupBy("c").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("more").alias("more"), F.min(F.struct("doc_id", "text_hash")).alias("one"))
    classes = written(classes)
    rows = written(_regions(classes.select("c", "n", "sig", "more")))

    forest = _ordered(rows, parts).select("g", "c", "n", "sig").mapInArrow(_pairs_of("forest", num, den), "a long, b long")
    split = rows.filter("blocks > 1").groupBy("tree", "depth", "region", "block").agg(F.min("c").alias("head"))
    heads = split.join(split.groupBy("tree", "depth", "region").agg(F.min("head").alias("top")), ["tree", "depth", "region"])
    first = written(forest.union(heads.filter("head > top").select("top", "head")).distinct())
    # a class that no forest pair names has no candidate in its blocks, so later pairs need no other texts
    nodes = first.select(F.explode(F.array("a", "b")).alias("c")).union(rows.filter("blocks > 1").select("c")).distinct()
    need = classes.join(nodes, "c").select("c", F.col("one.doc_id").alias("r_id"), F.col("one.text_hash").alias("text_hash"))
    texts = need.join(own, "text_hash").filter(F.col("r_id").eqNullSafe(F.col("doc_id"))).select("c", "text").groupBy("c").agg(F.first("text").alias("text"))
    texts = written(texts)
    links = written(_confirmed(first, texts, words, num, den))

    known = components(links)
    place = F.struct("tree", "depth", "region", "block", "blocks", "path")
    again = rows.join(nodes, "c", "left_semi").groupBy("c").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.collect_list(place).alias("at"))
    again = again.join(known.withColumnRenamed("node", "c"), "c", "left").select("c", "n", "sig", "at", F.coalesce("root", "c").alias("comp"))
    # blocks of a class by tree; where it has none, a number that no other class has
    slots = "transform(sequence(0, {0}), t -> coalesce(get(filter(at, x -> x.tree = t and x.blocks = 1), 0), named_struct('tree', t, 'depth', 0, 'region', c, 'block', -1, 'blocks', 1, 'path', cast('' as binary))))"
    again = again.withColumn("slots", F.transform(F.expr(slots.format(TREES + MORE - 1)), lambda x: F.xxhash64(x["tree"], x["depth"], x["region"], x["block"])))
    again = written(again).select("c", "n", "sig", "comp", "slots", F.inline("at"))
    wide_rows = again.filter("blocks > 1")
    mixed = wide_rows.groupBy("tree", "depth", "region").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high")
    spread = written(wide_rows.join(mixed, ["tree", "depth", "region"]).select("c", "n", "comp").distinct())
    again = again.filter("blocks = 1")
    blocks = _ordered(again, parts).select("g", "c", "n", "sig", "comp")
    open_ends = written(blocks.mapInArrow(_pairs_of("nodes", num, den), "a long, b long").select(F.col("a").alias("c")).union(spread.select("c")).distinct())
    first_shingles = written(_first_shingles(texts.join(open_ends, "c"), words, num, den))
    blocks = _ordered(again.join(first_shingles, "c"), parts).select("g", "c", "n", "sig", "comp", "tree", "slots", "first")
    cross = blocks.mapInArrow(_pairs_of("cross", num, den), "a long, b long").union(_across(spread.join(first_shingles, "c"), num, den))
    second = cross.distinct().join(first, ["a", "b"], "left_anti")
    more = written(_confirmed(second, texts, words, num, den))

    joined = components(known.filter("node != root").toDF("a", "b").union(more))
    of_class = scanned.filter("n > 0").select("c").distinct().join(joined.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("root", "c").alias("comp"))
    placed = scanned.join(of_class, "c", "left")
    least = placed.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "comp", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("c").alias("class_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without the near-duplicates of a smaller id; all rows of a kept id stay. Columns of any name pass."""
    kept = near_duplicates(docs, words, num, den).filter("kept").select("doc_id").distinct().alias("kept")
    return docs.alias("docs").join(kept, F.col("docs.doc_id").eqNullSafe(F.col("kept.doc_id")), "left_semi")


def audit_recall(docs: DataFrame, result: DataFrame, words: int = 5, num: int = 80, den: int = 100, every: int = 100) -> DataFrame:
    """(found, true_links): of all true links of rows whose id is divisible by ``every``, counted by a join of their
    shingles with everyone's, those whose ends have one component in ``result``. Equal sets count once."""
    own = docs.select(F.col("doc_id").alias("c"), F.coalesce("text", F.lit("")).alias("text")).filter("c is not null")
    rows = own.mapInArrow(_shingle_rows(words), "c long, s long")
    head = result.filter("doc_id is not null and class_id is not null and n_shingles > 0").groupBy("class_id").agg(F.min("doc_id").alias("c"), F.first("n_shingles").alias("n"), F.first("component_id").alias("comp"))
    asked = result.filter(f"doc_id % {every} = 0").select("class_id").distinct()
    head = written(head)
    rows = written(rows.join(head, "c").select("class_id", "n", "comp", "s"))
    left = rows.join(asked, "class_id").toDF("l_id", "l_n", "l_comp", "s")
    right = rows.toDF("r_id", "r_n", "r_comp", "s").filter("r_n > 0")
    close = (den * F.least("l_n", "r_n") >= num * F.greatest("l_n", "r_n")) & (F.col("l_id") != F.col("r_id"))
    both = left.join(right, "s").filter(close).groupBy("l_id", "r_id").agg(F.count("*").alias("both"), F.first("l_n").alias("l_n"), F.first("r_n").alias("r_n"), F.max((F.col("l_comp") == F.col("r_comp")).cast("int")).alias("met"))
    true = both.filter(den * F.col("both") >= num * (F.col("l_n") + F.col("r_n") - F.col("both")))
    return true.agg(F.coalesce(F.sum("met"), F.lit(0)).alias("found"), F.count("*").alias("true_links"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)

"""Removal of repeated passages with suffix arrays of shards.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id. All suffixes of a corpus
needn't be sorted for that, only the neighbourhoods of places that occur in two documents:

1. Deal: each distinct text goes, once per task that read it, to a batch by its hash (map-side combining, so that a
   third of all rows may be copies of one text). Batches hold about ``BATCH`` bytes.
2. Anchors: of each ``LENGTH``-byte window, the ``GRAM``-byte string with the smallest hash is its anchor, a choice that
   depends on the window's content only. Neighbouring windows mostly share it. A batch sends each distinct anchor hash once to the shard of that hash (32 of its
   bits: of two hashes that agree in them, both count as repeated, and their contexts then meet no equal ones), which
   answers with a number per hash: 0 where it occurs in one document only, else in how many parts its contexts are dealt.
3. Contexts: around each repeated anchor, the bytes of the windows that have this anchor. A batch sends each distinct
   context once, with the smallest id that has it, to a shard by anchor hash. Equal windows meet there. An anchor with more
   than ``HOT`` contexts (a header that a third of all rows share, followed by texts that differ) would fill a shard; its
   windows go one by one to as many shards as it needs, by the hash of the whole window.
4. Shards: a window that two contexts share reaches, beside the anchor, over half of its other bytes to the left or to the
   right; contexts without such a half in common with another one are done. The others are one string, whose suffixes are sorted by induction (classified, leftmost-
   smaller substrings named and sorted, the rest induced); runs of ranks with permuted common prefixes of ``LENGTH`` or more are
   equal windows, and each gets the smallest id of its run. The shard returns that id per window.
5. Cover: each batch marks windows whose smallest id is smaller than the document's own, and cuts the covered bytes.

Batches are rebuilt from the one shuffle of the texts (Spark reuses that exchange), in the order of the text hash, so that
answers need no keys. What one passage costs a shard is one context per batch, however many documents hold it. A batch sends a
row to each shard, so rows grow with the square of the input: they are cut from and joined to whole arrays, never one by one.

The string of leftmost-smaller substrings' names is sorted by doubling their span, not by a further recursion: in numpy a
scan costs some steps for each symbol, and that string has hundreds of thousands (figures in the README).

Defined cases: null or empty text is empty; rows of one id are one document (nothing of one goes because of the other);
a null id counts as larger than all others; texts shorter than ``LENGTH`` keep everything; repeated rows give equal rows;
matches never cross texts; other columns are ignored; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mixed, runs, utf8
from .common import table
from .suffixes import eight, permuted_repeats, suffix_array

LENGTH, GRAM = 50, 16
BATCH, SHARD, CONTEXTS, HOT = 4 << 20, 8 << 20, 2 << 20, 20_000
#: Bytes that are hashed, or windows that are answered, at a time: arrays of 8 bytes for each then stay in a core's cache.
RUN = 1 << 16
NONE = np.iinfo("int64").max
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# anchors ------------------------------------------------------------------------------------------------------------
def _least_ahead(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each position and its next width - 1."""
    m, s = x.copy(), 1
    while s * 2 <= width:
        m[: max(0, len(m) - s)] = np.minimum(m[: max(0, len(m) - s)], m[s:])
        s *= 2
    r = width - s
    if r:
        m[: max(0, len(m) - r)] = np.minimum(m[: max(0, len(m) - r)], m[r:])
    return m


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each position; never the smallest or the largest number."""
    n = len(data)
    v = eight(np.append(data, np.zeros(8, "uint8")))
    g = (v[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ ((v[8 : n + 8] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F))
    g = mixed(g)
    return np.minimum(np.maximum(g, np.uint64(1)), _ALL - np.uint64(1))


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of every run of windows that have the same anchor; windows are named by their
    first byte."""
    n = len(data)
    if not n:
        none = np.zeros(0, "int64")
        return np.zeros(0, "uint64"), none, none
    g = gram_hashes(data)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    g[left < GRAM] = _ALL
    m = _least_ahead(g, length - GRAM + 1)
    m[left < length] = 0  # no window; so no run goes from one text to the next
    first = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    last = np.r_[first[1:], n] - 1
    some = m[first] > 0
    return m[first[some]], first[some], last[some]


# blobs --------------------------------------------------------------------------------------------------------------
def _blobs(x: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of x as a row for each two neighbours of ``bounds``."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * x.itemsize).astype("int64")), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _joined(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a column of blobs, and the bounds of the rows."""
    column = column.cast(pa.large_binary()).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, "int64")
    _, off, data = column.buffers()
    off = np.frombuffer(off, "<i8")[column.offset : column.offset + len(column) + 1]
    x = np.frombuffer(data, "uint8")[off[0] : off[-1]].copy().view(kind) if data is not None else np.zeros(0, kind)
    return x, (off - off[0]) // x.itemsize


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(h.copy()) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype("int64")


def _cuts(shard: np.ndarray) -> np.ndarray:
    """Bounds of the runs of a sorted array."""
    return np.r_[np.flatnonzero(np.diff(shard, prepend=-1)), len(shard)]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each row, one row after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


# steps --------------------------------------------------------------------------------------------------------------
DEALT = "batch long, key binary, d long, text binary"


def _combine(batches):
    """Each text once per task; smaller ids of a text that was sent follow at the end."""
    sent: dict[bytes, int] = {}
    late: dict[bytes, tuple[int, int]] = {}
    for t in batches:
        new, text, key, d, b = [], [], t.column("key").to_pylist(), t.column("d").to_pylist(), t.column("batch").to_pylist()
        for i, (k, x) in enumerate(zip(key, d)):
            if k not in sent:
                sent[k] = x
                new.append(i)
            elif x < sent[k]:
                sent[k] = x
                late[k] = b[i], x
        t = t.take(pa.array(new, pa.int64()))
        yield pa.RecordBatch.from_arrays([t.column("batch"), t.column("key"), t.column("d"), t.column("text").cast(pa.binary())], names=["batch", "key", "d", "text"])
    if late:
        keys = sorted(late)
        yield pa.RecordBatch.from_arrays(
            [pa.array([late[k][0] for k in keys], pa.int64()), pa.array(keys, pa.binary()), pa.array([late[k][1] for k in keys], pa.int64()), pa.nulls(len(keys), pa.binary())],
            names=["batch", "key", "d", "text"],
        )


class _Texts:
    """A batch's distinct texts in the order of their keys."""

    def __init__(self, t: pa.Table):
        key, d = t.column("key").to_pylist(), t.column("d").to_numpy()
        row: dict[bytes, int] = {}
        least: dict[bytes, int] = {}
        has = t.column("text").is_valid().to_pylist()
        for i, k in enumerate(key):
            least[k] = min(least.get(k, NONE), int(d[i]))
            if has[i]:
                row[k] = i
        self.keys = sorted(row)
        self.d = np.array([least[k] for k in self.keys], "int64")
        text = t.column("text").take(pa.array([row[k] for k in self.keys], pa.int64()))
        self.data, self.off = utf8(text.cast(pa.large_binary()).combine_chunks().view(pa.large_string()) if len(self.keys) else pa.array([], pa.large_string()))

    def anchors(self, length: int):
        """Anchors of all texts: text number, hash, first and last window."""
        parts = []
        for a, b in runs(self.off, RUN):
            off = self.off[a : b + 1]
            h, first, last = anchors(self.data[off[0] : off[-1]], off - off[0], length)
            parts.append((np.searchsorted(off, first + off[0], "right") - 1 + a, h, first + off[0], last + off[0]))
        if not parts:
            return np.zeros(0, "int64"), np.zeros(0, "uint64"), np.zeros(0, "int64"), np.zeros(0, "int64")
        return tuple(np.concatenate(x) for x in zip(*parts))

    def sent(self, length: int, shards: int):
        """Distinct anchor hashes ordered by shard, how many texts hold them, and the place of each anchor's hash."""
        doc, h, first, last = self.anchors(length)
        order = np.argsort(h, kind="stable")  # texts stay in order
        new = np.r_[True, h[order][1:] != h[order][:-1]] if len(h) else np.zeros(0, bool)
        place = np.empty(len(h), "int64")
        place[order] = np.cumsum(new) - 1
        u = h[order][new]
        # in how many texts each hash occurs
        o = doc[order]
        fresh = new.copy()
        fresh[1:] |= o[1:] != o[:-1]
        held = np.bincount((np.cumsum(new) - 1)[fresh], minlength=len(u)).astype("uint32") if len(h) else np.zeros(0, "uint32")
        shard = _shard_of(u, shards)
        by = np.argsort(shard, kind="stable")
        back = np.empty(len(u), "int64")
        back[by] = np.arange(len(u))
        return doc, first, last, (back[place] if len(place) else place), u[by], held[by], shard[by]


ASKED = "shard long, batch long, hashes binary, held binary"
ANSWER = "batch long, kind int, shard long, blob binary"
SENT = "shard long, batch long, size binary, least binary, bytes binary"
#: Columns of the result, which take the place of input columns of these names.
OWN = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
CUT = "key binary, d long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _table(schema: str, columns: list) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.Table.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def _all(value: int, n: int) -> np.ndarray:
    return np.full(n, value, "int64")


def _ask(length: int, shards: int):
    def ask(key, t):
        *_, u, held, shard = _Texts(t).sent(length, shards)
        cuts = _cuts(shard)
        return _table(ASKED, [shard[cuts[:-1]], _all(key[0].as_py(), len(cuts) - 1), _blobs(u.astype("uint32"), cuts), _blobs(held, cuts)])

    return ask


def _answer(hot: int):
    def answer(key, t):
        """For each hash that a batch sent: 0 if one text has it, else the number of parts of its contexts."""
        h, bounds = _joined(t.column("hashes"), "<u4")
        held, _ = _joined(t.column("held"), "<u4")
        order = np.argsort(h, kind="stable")
        s = h[order]
        group = np.cumsum(np.r_[True, s[1:] != s[:-1]]) - 1
        total = np.bincount(group, weights=held[order])
        parts = np.where(total > 1, -(-total // hot), 0).astype("uint32")
        said = np.empty(len(h), "uint32")
        said[order] = parts[group]
        return _table(ANSWER, [t.column("batch"), _all(0, len(t)).astype("int32"), _all(key[0].as_py(), len(t)), _blobs(said, bounds)])

    return answer


def _said(answers: pa.Table, kind: int) -> np.ndarray:
    """What the shards said in one of the steps, in the shards' order."""
    rows = np.flatnonzero(answers.column("kind").to_numpy() == kind)
    rows = rows[np.argsort(answers.column("shard").to_numpy()[rows], kind="stable")]
    return _joined(answers.column("blob").take(pa.array(rows)), "<i8" if kind else "<u4")[0]


class _Contexts:
    """The distinct contexts of a batch, ordered by shard, and the anchors that have them."""

    def __init__(self, texts: _Texts, answers: pa.Table, length: int, shards: int, far: int):
        doc, first, last, place, u, _, shard = texts.sent(length, shards)
        parts = _said(answers, 0)[place].astype("int64")
        on = parts > 0
        self.doc, self.first, self.size, h, parts = doc[on], first[on], last[on] - first[on] + length, u[place[on]], parts[on]
        # of hot anchors, every window is a context of its own
        count = np.where(parts > 1, self.size - length + 1, 1)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.doc, self.first, h, parts = np.repeat(self.doc, count), np.repeat(self.first, count) + inner, np.repeat(h, count), np.repeat(parts, count)
        self.size = np.where(parts > 1, length, np.repeat(self.size, count))
        # two hashes of a context's bytes, from prefix sums; contexts equal in both, in anchor and in size are one
        both = []
        for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            p = np.full(len(texts.data) + 1, np.uint64(seed | 1))
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            q = np.full(len(p), np.uint64(pow(seed | 1, -1, 1 << 64)))
            q[0] = 1
            np.multiply.accumulate(q, out=q)
            total = np.zeros(len(p), "uint64")
            np.cumsum(mixed(np.arange(256, dtype="uint64") + np.uint64(seed))[texts.data] * p[:-1], out=total[1:])
            both.append(mixed((total[self.first + self.size] - total[self.first]) * q[self.first] + self.size.astype("uint64")))
            del p, q, total
        # parts of a hot anchor lie by the hash of the window
        far_shard = _shard_of(h ^ np.uint64(0x5555555555555555) ^ mixed(both[0] % parts.astype("uint64")), far)
        order = np.lexsort((texts.d[self.doc], both[1], both[0], h, far_shard))
        new = np.ones(len(order), bool)
        if len(order):
            same = [x[order][1:] == x[order][:-1] for x in (h, *both)]
            new[1:] = ~(same[0] & same[1] & same[2])
        self.number = np.empty(len(order), "int64")
        self.number[order] = np.cumsum(new) - 1
        self.one = order[new]  # of each distinct context, the anchor of its smallest id
        self.shard = far_shard[self.one]


def _send(length: int, shards: int, far: int):
    def send(key, left, right):
        texts = _Texts(left)
        c = _Contexts(texts, right, length, shards, far)
        first, size = c.first[c.one], c.size[c.one]
        end = np.r_[0, np.cumsum(size)]
        data = np.empty(end[-1], "uint8")
        for a, b in runs(end, 1 << 20):
            data[end[a] : end[b]] = texts.data[_ranges(first[a:b], size[a:b])]
        cuts = _cuts(c.shard)
        return _table(SENT, [c.shard[cuts[:-1]], _all(key[0].as_py(), len(cuts) - 1), _blobs(size.astype("uint32"), cuts), _blobs(texts.d[c.doc[c.one]], cuts), _blobs(data, end[cuts])])

    return send


def _halves(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, group: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """Of each context, whether it has an anchor and half of a window's other bytes beside it in common with another one of its
    group. The anchor may stand in a context again and again: each place counts."""
    side = -(-(length - GRAM) // 2)
    if side < 8:
        return np.ones(len(begin), bool)
    of = np.repeat(np.arange(len(begin)), stop - begin)
    at = np.flatnonzero(gram_hashes(data) == hashes[of])
    own = of[at]
    at, own = at[at + GRAM <= stop[own]], own[at + GRAM <= stop[own]]
    words, out = eight(data), np.zeros(len(begin), bool)
    for room, step in ((at - begin[own] >= side, -side), (stop[own] - at >= GRAM + side, GRAM)):
        p, o = at[room], own[room]
        k = group[o].astype("uint64")
        for i in (*range(0, side - 8, 8), side - 8):
            k = mixed(k * np.uint64(0x9E3779B97F4A7C15) + words[p + step + i])
        _, same, count = np.unique(k, return_inverse=True, return_counts=True)
        out[o[count[same] > 1]] = True
    return out


def _rank(length: int):
    def rank(key, t):
        """The smallest id of each window of the contexts that each batch sent, as runs (value, length)."""
        all_size, bounds = _joined(t.column("size"), "<u4")
        all_size = all_size.astype("int64")
        all_least, _ = _joined(t.column("least"), "<i8")
        data = _joined(t.column("bytes"), "uint8")[0].tobytes()
        end = np.cumsum(all_size)
        begin = end - all_size
        # distinct contexts of the shard, the smallest id of each
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip(begin.tolist(), end.tolist())), "int64", len(begin))
        best = np.full(len(number), NONE)
        np.minimum.at(best, of, all_least)
        own = np.fromiter(map(len, number), "int64", len(number))
        data, stop = np.frombuffer(b"".join(number), "uint8"), np.cumsum(own)
        found = np.repeat(best, own)
        # all windows of a context have its anchor, so contexts alone with theirs share no window; nor do windows that came one by one
        edge = np.stack([stop - own, stop - own + length - GRAM + 1], 1).ravel()
        anchor = np.minimum.reduceat(gram_hashes(data), edge)[::2]
        hashes, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
        some = np.flatnonzero((count > 1)[group] & (np.bincount(group, own > length) > 0)[group])
        if len(some):
            part = data[_ranges(stop[some] - own[some], own[some])]
            to = np.cumsum(own[some])
            some = some[_halves(part, to - own[some], to, group[some], hashes[group[some]], length)]
        sorts = np.zeros(len(own), bool)
        sorts[some] = True
        byte = np.flatnonzero(np.repeat(sorts, own))
        if len(byte):
            text = data[byte]
            sa = suffix_array(text, length)
            same = permuted_repeats(text, sa, length)
            # a suffix counts as a window if it has enough bytes left in its context
            window = (np.repeat(stop, own) - np.arange(len(data)) >= length)[byte]
            value = np.where(window, found[byte], NONE)[sa]
            runs_at = np.flatnonzero(~same)
            smallest = np.minimum.reduceat(value, runs_at)
            found[byte[sa]] = np.repeat(smallest, np.diff(np.r_[runs_at, len(sa)]))
        # per batch: the windows of its contexts in order
        start, windows = stop - own, all_size - length + 1
        before = np.r_[0, np.cumsum(windows)]
        at = before[bounds]
        pairs, ends = [], []
        for a, b in runs(at, RUN):
            i, j = bounds[a], bounds[b]
            x = found[_ranges(start[of[i:j]], windows[i:j])]
            new = np.diff(x, prepend=0) != 0
            new[at[a:b] - at[a]] = True  # nothing runs on from one batch to the next
            cut = np.flatnonzero(new)
            pairs.append(np.stack([x[cut], np.diff(np.r_[cut, len(x)])], 1))
            ends.append(np.add.reduceat(new, at[a:b] - at[a], dtype="int64"))
        pairs, ends = np.concatenate(pairs), np.r_[0, np.cumsum(np.concatenate(ends))]
        return _table(ANSWER, [t.column("batch"), _all(1, len(t)).astype("int32"), _all(key[0].as_py(), len(t)), _blobs(pairs, ends * 2)])

    return rank


def _cut(length: int, shards: int, far: int, with_text: bool):
    def cut(key, left, right):
        texts = _Texts(left)
        c = _Contexts(texts, right, length, shards, far)
        n = len(texts.data)
        step = np.zeros(n + 1, "int64")
        if len(c.one):
            pairs = _said(right, 1).reshape(-1, 2)
            least = np.repeat(pairs[:, 0], pairs[:, 1])
            count = c.size[c.one] - length + 1
            start = np.cumsum(count) - count
            # every anchor's windows: their place in the answers and in the text
            k = count[c.number]
            inner = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            goes = least[np.repeat(start[c.number], k) + inner] < np.repeat(texts.d[c.doc], k)
            at = (np.repeat(c.first, k) + inner)[goes]
            step += np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
        gone = np.cumsum(step[:n]) > 0
        rows = []
        for i, (a, b) in enumerate(zip(texts.off[:-1].tolist(), texts.off[1:].tolist())):
            g = gone[a:b]
            kept = texts.data[a:b][~g].tobytes()
            spans = int((g[1:] & ~g[:-1]).sum()) + int(len(g) > 0 and g[0])
            rows.append((texts.keys[i], int(texts.d[i]), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None))
        return _table(CUT, list(zip(*rows)) or [[]] * 6)

    return cut


def repeated_passages(docs: DataFrame, length: int = LENGTH, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """All columns of ``docs`` but text and those named as results are, n_bytes, n_removed, n_spans, kept_sha256 (and
    kept_text, without the rest of a character that was cut), one row per input row."""
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches, shards = max(1, -(-total // BATCH)), max(1, -(-total // SHARD))
    row = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    keyed = docs.select(row.alias("row"), F.unhex(F.md5(text)).alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("d"), text.alias("text"))
    own = keyed.select(F.pmod(F.xxhash64("key"), F.lit(batches)).alias("batch"), "key", "d", "text")
    dealt = own.mapInArrow(_combine, DEALT)
    asked = dealt.groupBy("batch").applyInArrow(_ask(length, shards), ASKED)
    answers = asked.groupBy("shard").applyInArrow(_answer(hot), ANSWER)
    far = max(1, -(-total // CONTEXTS))
    sent = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_send(length, shards, far), SENT)
    ranked = sent.groupBy("shard").applyInArrow(_rank(length), ANSWER)
    both = answers.unionByName(ranked)
    of_text = dealt.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(_cut(length, shards, far, with_text), CUT)
    of_text = of_text.toDF("key", "least", "removed", "spans", "sha", "left")
    size = F.octet_length("text").cast("long")
    rows = keyed.select("row", "key", "d", size.alias("size")).join(of_text, "key", "left")
    whole = (F.col("d") > F.col("least")) & (F.col("size") >= length)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    kept = F.when(whole, F.lit("")).otherwise(F.col("left")).alias("kept_text")
    return rows.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", *OWN)],
        F.col("size").alias("n_bytes"),
        F.when(whole, F.col("size")).otherwise(F.col("removed")).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.col("spans")).cast("long").alias("n_spans"),
        F.when(whole, empty).otherwise(F.col("sha")).alias("kept_sha256"),
        *([kept] if with_text else []),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with their texts as kept; rows of whose text nothing is left go, rows that had none stay."""
    own = docs.select(F.struct("*").alias("all"), "doc_id", "text")
    out = repeated_passages(own, length, with_text=True).filter("n_removed = 0 or kept_text != ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("all")["text"])
    return out.select(*[(text if c == "text" else F.col("all")[c]).alias(c) for c in docs.columns])


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))

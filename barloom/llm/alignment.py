"""Alignment of two tokenizers by elementary intervals.

1. Texts are encoded by both where they are read. The tokens of a chunk of texts (about ``CHUNK`` bytes, a longer text alone)
   are two lists of byte ends; their union cuts the bytes into elementary intervals, and a search of each interval's end in
   both lists names its owners. Two tokens overlap in one interval at most, so every interval is one link; ends that both
   lists share close groups. A chunk is written as one row: figures per document, its distinct id pairs with
   their number, and its links as places in that list, in two bytes each where they fit: one block of bytes passes through the
   JVM as it is, an array of numbers as several copies of several megabytes.
2. Pairs are counted over the corpus from the chunks' own counts, so a frequent pair costs a row a chunk. The highest
   count of each B id is broadcast: it has one row an id of B's vocabulary at most.
3. Counts go back to the chunks by a join on the pair and meet the chunk's links there; sums per document need no shuffle
   of links.

A chunk, thus a text, is one task's; its memory is some fifty times its bytes.

``groups`` names each group's tokens; ``group_products`` expands them to the product of their ids, as token maps between
vocabularies take them. Per document the size of that product is counted without expanding it (n_products).

Defined cases: null and empty texts, and texts of which either tokenizer doesn't give back every byte, have no tokens (zeros
and empty strings); special tokens' strings are plain text; repeated rows, null or repeated doc_id give a row each
and count each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import runs
from .bpe import MOST_WORD, byte_letters
from .common import table, written

CHUNK = 1_000_000
FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_products")
CHUNKS = f"chunk long, doc_id array<long>, {', '.join(f'{n} array<long>' for n in FIGURES)}, groups_sha256 array<string>, groups array<string>, codes array<long>, times array<long>, links binary"


_NONE = np.zeros(0, "int64")


class Pair:
    """Both tokenizers: ids of texts, and each id's bytes."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in t)
        self.quick = tiktoken.Encoding(path_a, pat_str=public_tokenizers.PATTERN, mergeable_ranks={self.bytes_a[i]: i for i in vocab.values()}, special_tokens={})
        self.path_a, self._whole = path_a, None
        self.b = SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
        self.length_a, self.length_b = (np.array([len(x) for x in v], "int64") for v in (self.bytes_a, self.bytes_b))
        # the strings of group texts: an id with the mark that follows it, by 2 * id + (last of its side)
        self.said = [f"{i}{mark}" for i in range(len(self.bytes_a)) for mark in ",|"] + [f"{i}{mark}" for i in range(self.size_b) for mark in ",;"]

    @property
    def whole(self):
        """The library's encoder, for long unsplit runs; loaded where one occurs."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path_a)
            self._whole.encode_special_tokens = True
        return self._whole

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both, or none where either doesn't give back the bytes of space + text. A's tokens are runs of the text's own bytes,
        so for them the number of bytes tells."""
        if not text:
            return _NONE, _NONE
        spaced = " " + text
        parts = spaced.split()
        # tiktoken's time grows with the square of an unsplit run
        long = max(map(len, parts), default=0) > MOST_WORD or len(spaced) - sum(map(len, parts)) > 2 * len(parts) + MOST_WORD
        a = self.whole.encode(spaced, add_special_tokens=False).ids if long else self.quick.encode_ordinary(spaced)
        b, raw = self.b.encode(text), spaced.encode()
        a = np.array(a, "int64")
        if int(self.length_a[a].sum()) != len(raw) or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return _NONE, _NONE
        return a, np.array(b, "int64")


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals, the tokens that own each, and whether both lists share it."""
    both = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")  # two sorted runs: a merge
    new = np.diff(both, prepend=-1) != 0
    ends = both[new]
    twice = np.diff(np.flatnonzero(new), append=len(both)) == 2
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), twice


def chunk_row(pair: Pair, texts: list[str], keep_groups: bool = False) -> dict:
    """The figures of one chunk of texts."""
    both = [pair.ids(t) for t in texts]
    n_a, n_b = (np.array([len(x[i]) for x in both], "int64") for i in (0, 1))
    a, b = (np.concatenate([x[i] for x in both] or [_NONE]) for i in (0, 1))
    ends_a, ends_b = np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])
    ends, of_a, of_b, twice = elementary(ends_a, ends_b)
    shared = ends[twice]
    codes, links, times = np.unique(a[of_a] * pair.size_b + b[of_b], return_inverse=True, return_counts=True)
    # documents end at shared ends, so groups never cross them
    through_a, through_b = of_a[twice] + 1, of_b[twice] + 1
    stop = np.r_[0, ends_a][np.cumsum(n_a)]
    start = np.r_[0, stop[:-1]]
    n_groups = np.searchsorted(shared, stop, "right") - np.searchsorted(shared, start, "right")
    n_links = np.searchsorted(ends, stop, "right") - np.searchsorted(ends, start, "right")
    products = np.r_[0, np.cumsum(np.diff(through_a, prepend=0) * np.diff(through_b, prepend=0))]
    upto = np.cumsum(n_groups)
    # group texts: A's tokens of a group, then B's
    marks = np.empty(len(a) + len(b), "int64")
    group_a, group_b = (np.repeat(np.arange(len(shared)), np.diff(n, prepend=0)) for n in (through_a, through_b))
    last_a, last_b = np.zeros(len(a), "int64"), np.zeros(len(b), "int64")
    last_a[through_a - 1], last_b[through_b - 1] = 1, 1
    marks[np.arange(len(a)) + np.r_[0, through_b][group_a]] = 2 * a + last_a
    marks[np.arange(len(b)) + through_a[group_b]] = 2 * len(pair.bytes_a) + 2 * b + last_b
    groups, first = [], 0
    for n in (n_a + n_b).tolist():
        groups.append("".join(map(pair.said.__getitem__, marks[first : first + n].tolist()))[:-1])
        first += n
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "n_products": products[upto] - products[upto - n_groups], "groups_sha256": [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups],
        "groups": groups if keep_groups else [], "codes": codes, "times": times, "links": links.astype("<u2" if len(codes) <= 1 << 16 else "<u4").tobytes(),
    }


_pairs: dict[tuple[str, str], Pair] = {}


def chunks(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, most: int = CHUNK) -> DataFrame:
    """One row a chunk of documents."""
    import pyspark.sql.types as T

    schema = T._parse_datatype_string(CHUNKS)

    def run(batches):
        import pyspark.sql.pandas.types as PT

        if (path_a, path_b) not in _pairs:
            _pairs[path_a, path_b] = Pair(path_a, path_b)
        number, arrow = TaskContext.get().partitionId() << 33, PT.to_arrow_schema(schema)
        for batch in batches:
            off = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype="int64")]
            for first, end in runs(off, most):
                part = batch.slice(first, end - first)
                row = chunk_row(_pairs[path_a, path_b], [t or "" for t in part.column("text").to_pylist()], keep_groups)
                row |= {"chunk": number, "doc_id": part.column("doc_id").to_pylist()}
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in arrow], schema=arrow)
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(chunked: DataFrame) -> DataFrame:
    """code, n: links of the corpus by id pair (code: A's id times B's vocabulary size plus B's id)."""
    return chunked.select(F.inline(F.arrays_zip("codes", "times"))).groupBy(F.col("codes").alias("code")).agg(F.sum("times").alias("n"))


def aligned(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, most: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_products, n_best, count_sum, groups_sha256 and, if asked for, groups; one row per
    input row."""
    size_b = vocabulary_size(path_b)
    chunked = written(chunks(docs, path_a, path_b, keep_groups, most))
    counts = written(pair_counts(chunked))
    b = F.expr(f"code % {size_b}").alias("b")
    best = counts.groupBy(b).agg(F.max("n").alias("most"))  # a row an id of the vocabulary at most
    counts = counts.withColumn("b", b).join(F.broadcast(best), "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    known = chunked.select(F.col("chunk").alias("of"), F.explode("codes").alias("code")).join(counts, "code").select("of", "code", "n", "best")
    columns = ["doc_id", *FIGURES, "groups_sha256", "groups"]

    def gather(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        row, found = rows.iloc[0], found.sort_values("code")  # in the order of the chunk's own list
        n = len(row["doc_id"])
        out = pd.DataFrame({c: row[c] if len(row[c]) == n else [None] * n for c in columns})
        stop = np.cumsum(row["n_links"])
        links = np.frombuffer(row["links"], "<u2" if len(found) <= 1 << 16 else "<u4")
        sums = np.r_[0, np.cumsum(found["n"].to_numpy("int64")[links])]
        tops = np.r_[0, np.cumsum(found["best"].to_numpy("int64")[links])]
        start = stop - row["n_links"]
        out["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in row["doc_id"]], "Int64")
        return out.assign(n_best=tops[stop] - tops[start], count_sum=sums[stop] - sums[start])

    schema = f"doc_id long, {', '.join(f'{n} long' for n in FIGURES)}, groups_sha256 string, groups string, n_best long, count_sum long"
    out = chunked.drop("codes", "times").groupBy("chunk").cogroup(known.groupBy("of")).applyInPandas(gather, schema)
    return out if keep_groups else out.drop("groups")


def vocabulary_size(path_b: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path_b).get_piece_size()


def groups(with_groups: DataFrame) -> DataFrame:
    """doc_id, group (from 0), a_ids, b_ids of the documents' group texts; documents without tokens have none."""
    d = with_groups.filter("groups != ''").select("doc_id", F.posexplode(F.split("groups", ";")).alias("group", "said"))
    side = lambda i: F.split(F.split("said", r"\|")[i], ",").cast("array<int>")
    return d.select("doc_id", "group", side(0).alias("a_ids"), side(1).alias("b_ids"))


def group_products(grouped: DataFrame) -> DataFrame:
    """doc_id, group, a_id, b_id: each group's tokens of A with its tokens of B. A group is as long as both tokenizers disagree,
    most often a word; an unsplit run on which they never agree before its end gives the product of its tokens."""
    return grouped.select("doc_id", "group", F.explode("a_ids").alias("a_id"), "b_ids").select("doc_id", "group", "a_id", F.explode("b_ids").alias("b_id"))


def op12_cross_tokenizer(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

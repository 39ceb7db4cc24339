"""Best-fit packing by large-item matching.

Tokenising yields one small row per piece; ids themselves never leave the task. A text of more than ``capacity`` tokens
is cut into whole sequences, its first piece taking the rest. Pieces are dealt evenly to shards of some thousands, so
a shard's loss (one or two open sequences) is far below a per mille of it, and each shard is packed in one task:

1. pieces above a third of the capacity, longest first, are matched greedily with the longest unmatched such piece that
   still fits; no sequence can hold three of them;
2. the others, longest first, go to the sequence with the smallest sufficient gap, or open a new one.

Defined cases: null text is empty text, which packs as the end id alone; repeated rows and null or repeated doc_id are
packed apart; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import rank_ids
from .common import table, written

CAPACITY, SHARD_PIECES, END = 2048, 4000, np.zeros(1, "<u4").tobytes()
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of each text's ids, the end id included."""

    def cut(batches):
        for pdf in batches:
            rows = []
            for text, doc_id in zip(pdf["text"], pdf["doc_id"]):
                ids = rank_ids(path, text or "") + END
                n = len(ids) // 4
                stop = (n - 1) % capacity + 1
                bounds = [0, *range(stop, n + 1, capacity)]
                rows += [(doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(cut, PIECES)


class Gaps:
    """Open sequences by free room; a set bit of ``mask`` says that some have that room."""

    def __init__(self, capacity: int):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, room: int, item: int) -> None:
        self.at[room].append(item)
        self.mask |= 1 << room

    def take(self, room: int) -> int:
        item = self.at[room].pop()
        if not self.at[room]:
            self.mask &= ~(1 << room)
        return item

    def least(self, room: int) -> int:
        """The smallest room that is at least this, or -1."""
        m = self.mask >> room
        return room + (m & -m).bit_length() - 1 if m else -1

    def most(self, room: int) -> int:
        """The largest that is at most this, or -1."""
        return (self.mask & ((1 << (room + 1)) - 1)).bit_length() - 1


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one shard."""
    seq, off = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
    order = np.argsort(-lengths, kind="stable")
    large = [int(i) for i in order if 3 * lengths[i] > capacity]
    waiting, gaps, n, matched = Gaps(capacity), Gaps(capacity), 0, set()
    for i in reversed(large):
        waiting.put(int(lengths[i]), i)
    for i in large:
        if i in matched:
            continue
        a = int(lengths[i])
        # i itself is on top of its length's list: the lists were filled shortest and last first
        waiting.at[a].remove(i)
        if not waiting.at[a]:
            waiting.mask &= ~(1 << a)
        seq[i], room = n, capacity - a
        fit = waiting.most(room)
        if fit >= 0:
            j = waiting.take(fit)
            matched.add(j)
            seq[j], off[j], room = n, a, room - fit
        gaps.put(room, n)
        n += 1
    for i in order[len(large) :]:
        a = int(lengths[i])
        room = gaps.least(a)
        if room < 0:
            seq[i], room, n = n, capacity, n + 1
        else:
            seq[i] = gaps.take(room)
        off[i] = capacity - room
        gaps.put(room - a, int(seq[i]))
    return seq, off


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece."""
    pieces = written(token_pieces(docs, path, capacity))  # texts are tokenised once; the number of shards needs a count
    shards = max(1, -(-pieces.count() // shard_pieces))

    def shard(key, pdf):
        seq, off = pack(pdf["length"].to_numpy(), capacity)
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf.drop(columns="shard").assign(sequence_id=key[0] * (1 << 32) + seq, offset=off)

    # by row, so that repeated rows spread too; a written table gives the same numbers when a task is run again
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(shard, PACKED)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""BPE encoding and decoding by tree concatenation, and the word-memoised encoder that packing shares.

Whole documents: a text above ``leaf_chars`` is cut into leaves, one row each, that tasks encode in parallel. Neighbours
are then joined pairwise up a binary tree: a window around each join grows until it holds a safe position on both
sides (white space followed by an ASCII letter or digit: no normaliser rule, word or special token reaches across it);
the window is encoded anew and must agree exactly with the end of the left ids and the start of the right ids. Where no such
position is near (long unsplit text), the texts are split anew from the last words of the left one until a word
starts where one of the right text's own words does; a long word that lies across the join is made of both sides' ids by
windows of tokens, as below, so little of it is encoded twice. Only texts of other characters, or with special
tokens, grow their window up to both texts whole.

Single long words (text that the pre-tokeniser doesn't split) are halved the same way on the level of tokens: halves are
encoded apart, then k tokens on each side of the join are re-encoded, k growing, until the first new token equals the
left one and the last equals the right one. A token sequence is the encoding exactly if every two neighbours are the
encoding of their own text, so agreement on one token on each side proves the whole sequence.

Words repeat, so ids are memoised per distinct word, in a bounded table per Python worker. Texts with characters outside
the tested set (ASCII, Latin letters of U+00C0 to U+00FF) or with a special token's string go to the library as wholes.

Defined cases: null text is empty text (no ids, empty decoded text); repeated rows, null or repeated doc_id give a row
each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

LEAF_CHARS, WORD_LEAF, MEMO, CHUNK = 32_768, 256, 150_000, 400_000
#: Characters on each side of a join within which a safe position is looked for first.
NEAR = 1024
_LATIN = "À-ÖØ-öø-ÿ"
#: Texts of these characters only are split with the patterns below, which equal the tokenizers' own on this set.
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LATIN}¡«»¿]*")
#: The pre-tokenizers' patterns of the two vocabularies, with letters and digits of the set above.
WORD_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z{_LATIN}]+|[0-9]|[^\sa-zA-Z0-9{_LATIN}]+")
BYTE_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z{_LATIN}]+| ?[0-9]+| ?[^\sa-zA-Z0-9{_LATIN}]+|\s+(?!\S)|\s+")
SAFE = re.compile(r"[\t\n\r ](?=[A-Za-z0-9])")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    """Encodes whole texts as the library does. kind: ``word`` or ``byte``."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.lower, self.split = kind == "word", WORD_SPLIT if kind == "word" else BYTE_SPLIT
        spec |= {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None}
        self.final = Tokenizer.from_str(json.dumps(spec))
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        spec["model"]["end_of_word_suffix"] = None
        self.inner = Tokenizer.from_str(json.dumps(spec)) if self.suffix else self.final
        self.letters = byte_letters()
        self.ids: dict[str, bytes] = {}
        self.said: dict[str, str] = {}
        self.coded = 0  # letters encoded at joins
        self.lengths = np.zeros(self.final.get_vocab_size(), "int64")
        for token, i in self.final.get_vocab().items():
            self.lengths[i] = len(token.removesuffix(self.suffix) if self.suffix else token)

    # single words ---------------------------------------------------------------------------------------------------
    def _leaf(self, letters: str, last: bool) -> list[int]:
        return (self.final if last else self.inner).encode(letters, add_special_tokens=False).ids

    def _letters_of(self, ids: list[int]) -> str:
        out = "".join(self.final.id_to_token(i) for i in ids)
        return out.removesuffix(self.suffix) if self.suffix else out

    def _word(self, letters: str, last: bool, leaf: int) -> list[int]:
        if len(letters) <= leaf:
            return self._leaf(letters, last)
        half = len(letters) // 2
        return self.joined(self._word(letters[:half], False, leaf), self._word(letters[half:], last, leaf), last)

    def joined(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Ids of one pre-token from those of its two parts; ``last``: it ends with the right one. The left part may have been
        encoded as a word of its own: what marks its end lies inside the first window."""
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            letters = self._letters_of(a) + self._letters_of(b)
            self.coded += len(letters)
            new = self._leaf(letters, last and k >= len(right))
            if (k >= len(left) or new[0] == a[0]) and (k >= len(right) or new[-1] == b[-1]):
                return left[:-k] + new + right[k:]
            k *= 2

    def word(self, word: str, leaf: int = WORD_LEAF) -> list[int]:
        """Ids of one pre-token by tree concatenation."""
        return self._word("".join(self.letters[b] for b in word.encode()), True, leaf)

    # whole texts ----------------------------------------------------------------------------------------------------
    def _learn(self, words: set[str]) -> None:
        if len(self.ids) + len(words) > MEMO:
            self.ids.clear()
            self.said.clear()
        short = [w for w in words if len(w) <= WORD_LEAF]
        for w, e in zip(short, self.library.encode_batch(short, add_special_tokens=False)):
            self.ids[w], self.said[w] = np.asarray(e.ids, "<u4").tobytes(), " ".join(e.tokens)
        for w in words:
            if len(w) > WORD_LEAF:
                ids = self.word(w)
                self.ids[w], self.said[w] = np.asarray(ids, "<u4").tobytes(), " ".join(self.final.id_to_token(i) for i in ids)

    def encode(self, texts: list[str], decode: bool = False) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, tokens joined by spaces if ``decode``) of each text."""
        out: list = [None] * len(texts)
        split = []
        for i, text in enumerate(texts):
            if PLAIN.fullmatch(text) and not any(s in text for s in self.specials):
                split.append((i, self.split.findall(text.lower() if self.lower else text)))
            else:
                ids = self.library.encode(text, add_special_tokens=False).ids
                out[i] = np.asarray(ids, "<u4").tobytes(), self.library.decode(ids, skip_special_tokens=False) if decode else ""
        new = set().union(*(w for _, w in split)) - self.ids.keys() if split else set()
        if len(new) + len(self.ids) > MEMO:
            self.ids.clear()
            self.said.clear()
            new = set().union(*(w for _, w in split))
        if new:
            self._learn(new)
        for i, w in split:
            out[i] = b"".join(map(self.ids.__getitem__, w)), " ".join(map(self.said.__getitem__, w)) if decode else ""
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """One per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


_ranks: dict = {}
MOST_WORD = 1000


def rank_ids(path: str, text: str) -> bytes:
    """Ids of a whole text by a byte-level vocabulary, as the tokenizers library gives them, by the faster tiktoken over
    the same tokens as ranks. Its time grows with the square of a word's length, so texts with long unsplit runs
    go through the tree concatenation above."""
    import public_tokenizers
    import tiktoken

    if path not in _ranks:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _ranks[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    words = text.split()
    if max(map(len, words), default=0) > MOST_WORD or len(text) - sum(map(len, words)) > 2 * len(words) + MOST_WORD:
        return encoder(path, "byte").encode([text])[0][0]
    return np.asarray(_ranks[path].encode(text, allowed_special="all"), "<u4").tobytes()


def chunks(texts, most: int = CHUNK):
    """Runs of texts of about ``most`` characters, so that a batch's words needn't be held at once."""
    run, n = [], 0
    for text in texts:
        run.append(text or "")
        n += len(run[-1])
        if n >= most:
            yield run
            run, n = [], 0
    if run:
        yield run


def join_words(enc: Encoder, left: tuple[str, bytes], right: tuple[str, bytes]) -> bytes | None:
    """Ids of two neighbouring leaves by the words around their join, or None where other characters or special tokens
    forbid to split them here. Patterns look ahead of a word's end by one character, and back never: all words of the left
    text but the last three (an apostrophe and what follows it is one word) are the whole's, and once a word starts
    where one of the right text's does, all further ones are."""
    (a, ids_a), (b, ids_b) = left, right
    if not (PLAIN.fullmatch(a) and PLAIN.fullmatch(b)) or any(s in a + b for s in enc.specials):
        return None
    if enc.lower:
        a, b = a.lower(), b.lower()
    last = [(m.start(), m.group()) for m in enc.split.finditer(a)][-3:]
    first = last[0][0] if last else len(a)
    mine, theirs = enc.split.finditer(a[first:] + b), enc.split.finditer(b)
    x, y, words, from_b = next(mine, None), next(theirs, None), [], []
    while x is not None and (y is None or first + x.start() != len(a) + y.start()):
        if y is None or first + x.start() < len(a) + y.start():
            words.append((first + x.start(), x.group()))
            x = next(mine, None)
        else:
            from_b.append(y.group())
            y = next(theirs, None)
    if x is None:
        from_b += [] if y is None else [y.group(), *(m.group() for m in theirs)]
    size = lambda word: len(word.encode())
    ids_a, ids_b = np.frombuffer(ids_a, "<u4"), np.frombuffer(ids_b, "<u4")
    upto_a, upto_b = (np.r_[0, np.cumsum(enc.lengths[i])] for i in (ids_a, ids_b))
    # ids of the left text's last words, by their bytes from its end
    own, stop = {}, int(upto_a[-1])
    for start, word in reversed(last):
        lo = stop - size(word)
        own[start] = word, ids_a[np.searchsorted(upto_a, lo) : np.searchsorted(upto_a, stop)]
        stop = lo
    out = [ids_a[: np.searchsorted(upto_a, stop)]]
    for start, word in words:
        known, ids = own.get(start, ("", None))
        if known == word:
            out.append(ids)
        elif len(word) > WORD_LEAF and known and from_b and word == known + from_b[0]:
            # the left text's last word and the right one's first are one word
            out.append(enc.joined(ids.tolist(), ids_b[: np.searchsorted(upto_b, size(from_b[0]))].tolist(), True))
        else:
            enc.coded += len(word)
            out.append(enc.word(word))
    out.append(ids_b[np.searchsorted(upto_b, sum(map(size, from_b))) :])
    return np.concatenate([np.asarray(i, "<u4") for i in out]).astype("<u4").tobytes()


def join_texts(enc: Encoder, left: tuple[str, bytes], right: tuple[str, bytes], width: int = 64) -> tuple[str, bytes]:
    """Text and ids of two neighbouring leaves together."""
    (a, ids_a), (b, ids_b) = left, right
    while True:
        if width > NEAR and (found := join_words(enc, left, right)) is not None:
            return a + b, found
        whole = width >= max(len(a), len(b))
        cut = next((m.end() for m in SAFE.finditer(a, max(0, len(a) - width), len(a))), None)
        stops = list(SAFE.finditer(b, 0, width))
        stop = stops[-1].end() if stops else None
        p, q = (cut if cut is not None and not whole else 0), (stop if stop is not None and not whole else len(b))
        if whole or (cut is not None and stop is not None):
            (tail, _), (head, _), (new, _) = enc.encode([a[p:], b[:q], a[p:] + b[:q]])
            if whole or (ids_a.endswith(tail) and ids_b.startswith(head)):
                keep_a, keep_b = (b"", b"") if whole else (ids_a[: len(ids_a) - len(tail)], ids_b[len(head) :])
                return a + b, keep_a + new + keep_b
        width *= 2


def join_all(enc: Encoder, leaves: list[tuple[str, bytes]]) -> bytes:
    while len(leaves) > 1:
        leaves = [join_texts(enc, *leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0][1]


def bpe_round_trip(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_leaves, one row per input row.

    Short texts are encoded where they are read. Leaves of long ones are dealt evenly, then gathered per document: a
    group is one input row, so its size is a document's, never a key's.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_leaves long"

    def row(doc_id, ids: bytes, said: str, n: int):
        return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), n

    def frame(rows):
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

    def short(batches):
        enc = encoder(path, "word")
        for pdf in batches:
            got = [x for run in chunks(pdf["text"]) for x in [row(None, *g, 1) for g in enc.encode(run, decode=True)]]
            out = frame(got)
            out["doc_id"] = pdf["doc_id"].astype("Int64").to_numpy()
            yield out

    def leaf(batches):
        enc = encoder(path, "word")
        for pdf in batches:
            yield pdf.assign(ids=[g[0] for run in chunks(pdf["text"]) for g in enc.encode(run)])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = encoder(path, "word")
        pdf = pdf.sort_values("leaf")
        ids = join_all(enc, list(zip(pdf["text"], pdf["ids"])))
        said = enc.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        doc_id = pdf["doc_id"].iloc[0]
        return frame([row(None if pd.isna(doc_id) else int(doc_id), ids, said, len(pdf))])

    long = d.filter(F.char_length("text") > leaf_chars).withColumn("row", F.monotonically_increasing_id())
    leaves = long.select("row", "doc_id", F.explode(F.expr(f"sequence(0, (char_length(text) - 1) div {leaf_chars})")).alias("leaf"), "text").select(
        "row", "doc_id", F.col("leaf").cast("int").alias("leaf"), F.expr(f"substring(text, cast(leaf * {leaf_chars} + 1 as int), {leaf_chars})").alias("text")
    )
    coded = leaves.repartition("row", "leaf").mapInPandas(leaf, "row long, doc_id long, leaf int, text string, ids binary")
    whole = coded.groupBy("row").applyInPandas(gather, schema)
    return d.filter(F.char_length("text") <= leaf_chars).mapInPandas(short, schema).unionByName(whole)


def op2_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

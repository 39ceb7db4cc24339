"""Operators 11 to 13: brute force, exactness, defined cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from barloom.llm import alignment, hard_negatives, mixing

VECTORS = "vec_id long, embedding array<float>, label int, text string, u long, a long, r long, known long"


# 11 -----------------------------------------------------------------------------------------------------------------
def negatives_by_hand(rows, positives=5, k=10, every=5):
    """Every anchor row against every other row, in Python integers."""
    out = []
    rows = [(i, l, v) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = [[int(np.floor(np.float64(x) * 256)) for x in v] for _, _, v in rows]
    for x, (i, label, _) in enumerate(rows):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q[x], q[y])), rows[y][0], y) for y in range(len(rows)) if y != x and len(q[x]) == len(q[y]))
        for s, p, _ in [t for t in scored if rows[t[2]][1] == label][:positives]:
            got = [(n, -t) for t, n, y in scored if rows[y][1] != label and 30 * -s <= 100 * -t <= 90 * -s][:k]
            out += [(i, p, r + 1, n, -s, t) for r, (n, t) in enumerate(got)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "t", 1, 2, 3, 4) for i, v, l in rows], VECTORS)


def test_negatives_equal_brute_force(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(3)
    base = r.normal(size=(12, 6)) / 3
    rows = [(i, [float(np.float32(x)) for x in base[r.integers(12)] + r.integers(0, 2) * r.normal(size=6) / 8], int(r.integers(4)) if i % 3 else 1) for i in range(240)]
    rows += [rows[10], rows[10], (7, None, 1), (8, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (9, [float("nan")] * 6, 2), (None, rows[3][1], 1), (11, rows[4][1], None), (15, [1.0, 2.0], 1), (20, [1.0, 2.5], 1), (21, [1.0, 1.5], 2), (25, [], 3)]
    d = vectors(spark, rows)
    for block, anchors in ((16_384, 4096), (17, 5)):
        got = hard_negatives.hard_negatives(d, F.col("vec_id") % 5 == 0, block=block, anchors=anchors)
        assert sorted(map(tuple, got.collect())) == negatives_by_hand(rows)
    assert [f.name for f in got.schema] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.hard_negatives(d.filter("vec_id < 0"), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(d, F.col("vec_id") < 0).count() == 0


def test_scores_are_exact():
    r = np.random.default_rng(4)
    for scale in (1, 1e4, 1e9, 1e300):
        a, b = r.normal(size=(5, 7)) * scale, r.normal(size=(6, 7)) * scale
        want = [[max(-hard_negatives.MOST, min(hard_negatives.MOST, sum(hard_negatives._whole(x) * hard_negatives._whole(y) for x, y in zip(p, q)))) for q in b.tolist()] for p in a.tolist()]
        assert hard_negatives.scores(list(a), list(b)).tolist() == want
    s = np.array([3, 7, 3, -2, 7])
    assert [x.tolist() for x in hard_negatives.by_score(s)] == [[7, 7, 3, 3, -2], [1, 4, 0, 2, 3]]
    assert hard_negatives.by_score(s * 2**50)[1].tolist() == hard_negatives.by_score(s * 2**58)[1].tolist() == [1, 4, 0, 2, 3]


def test_op11_equals_its_sql(spark, sf):
    import duckdb

    got = hard_negatives.op11_hard_negatives(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cur = con.execute(hard_negatives.ORACLE)
    assert [c[0] for c in cur.description] == got.columns
    assert sorted(cur.fetchall()) == sorted(map(tuple, got.collect()))


# 12 -----------------------------------------------------------------------------------------------------------------
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    (1, "the river house is lightened, unbelievably naïve"), (1, "the river house is lightened, unbelievably naïve"), (2, None), (3, ""), (4, " two  spaces\n\n\tand lines "), (5, "日本語 🙂🙂 ẞ ́x"), (6, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (7, "with ▁ inside"), (8, "x" * 5000), (None, "the house"), (9, "\x00\x01 nul"), (10, " "), (11, "1234567890 3.14159 -- ==> don't we'll"), (12, "\n" * 1500 + "a"),
]


def tokens_by_hand(text):
    """Ids and byte ranges of both, by the libraries."""
    if not text:
        return [], []
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    b, letters = SentencePieceProcessor(model_file=B), {c: i for i, c in enumerate(alignment.byte_letters())}
    said = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids], [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    out = []
    for side in said:
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        at, ranges = 0, []
        for i, x in side:
            ranges.append((i, at, at + len(x)))
            at += len(x)
        out.append(ranges)
    return tuple(out)


def aligned_by_hand(rows):
    """Every pair of tokens looked at."""
    each, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens_by_hand(text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 500 else by_sweep(a, b)
        shared = sorted({x[2] for x in a} & {x[2] for x in b})
        counts.update(links)
        groups, low = [], 0
        for e in shared:
            groups.append(",".join(str(i) for i, s, f in a if low < f <= e) + "|" + ",".join(str(i) for i, s, f in b if low < f <= e))
            low = e
        each.append((doc_id, a, b, links, groups))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (i, len(a), len(b), len(g), len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", ";".join(g)) for i, a, b, ls, g in each
    ]


def by_sweep(a, b):
    out, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


def test_alignment_equals_all_pairs(spark):
    docs = spark.createDataFrame([(i, t, 1, "g", 5) for i, t in TEXTS], "doc_id long, text string, n_a long, groups string, chunk long").repartition(3)
    want = sorted(aligned_by_hand(TEXTS), key=str)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    for most in (alignment.CHUNK, 60, 1):
        got = alignment.aligned(docs, A, B, keep_groups=True, most=most)
        assert sorted(map(tuple, got.select(columns).collect()), key=str) == want
    grouped = alignment.groups(got)
    assert grouped.count() == sum(w[3] for w in want)
    products = alignment.group_products(grouped.filter("doc_id != 8"))
    assert products.count() == sum(r.n_products for r in got.filter("doc_id != 8").collect())
    assert alignment.aligned(docs.filter("doc_id < 0"), A, B).count() == 0
    assert "groups" not in alignment.aligned(docs.limit(1), A, B).columns
    nothing = alignment.aligned(docs.filter("doc_id in (2, 3, 7)"), A, B).collect()
    assert [(r.n_a, r.n_b, r.n_links, r.groups_sha256) for r in nothing] == [(0, 0, 0, "")] * 3


def test_links_pass_the_jvm_as_bytes(spark):
    """Two bytes a link, one block a chunk; an array of numbers takes eight and more, in several copies."""
    docs = spark.createDataFrame([(1, "two words of a text " * 50), (2, None), (3, "")], "doc_id long, text string").coalesce(1)
    rows = alignment.chunks(docs, A, B).collect()
    assert rows and all(isinstance(r.links, (bytes, bytearray)) and len(r.links) == 2 * sum(r.n_links) for r in rows) and sum(len(r.links) for r in rows) > 400
    got = np.frombuffer(rows[0].links, "<u2")
    assert np.bincount(got, minlength=len(rows[0].codes)).tolist() == rows[0].times


def test_alignment_of_given_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("n_chars").limit(60).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = alignment.aligned(docs, A, B)
    assert sorted(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())) == sorted(w[:8] for w in aligned_by_hand(rows))


# 13 -----------------------------------------------------------------------------------------------------------------
def targets_by_hand(sizes):
    """Shares by weight; excess shared anew until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full = mixing.SHARE * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        aim = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / w for s in names}
        above = {s for s in names if aim[s] > 2 * sizes[s]}
        if not above:
            return aim
        full |= above


def mixed_rows(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, "k", 1) for i, t, s in rows], "doc_id long, text string, source string, size long, key string, m long")


def test_mixture(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" * r.randint(1, 4) for _ in range(int(r.paretovariate(0.9)) % 900 + 1)), r.choice(["big"] * 12 + ["a", "b", "é", "Z", "\U0001f642", "￮", None, ""])) for i in range(900)]
    rows += [(i % 7, "same words here", "big") for i in range(400)] + [(None, "one two", "a")] * 5 + [(1000, None, "a"), (1001, "  \n", "b"), (1002, None, "void"), (1003, "x", "tiny")]
    d = mixed_rows(spark, rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    aims = targets_by_hand(sizes)
    whole = sorted(map(tuple, mixing.mixture(d).collect()), key=str)
    for bucket, reserve in ((10_000, 1 << 16), (20, 50), (3, 500)):
        got = mixing.mixture(d, bucket=bucket, reserve=reserve).collect()
        assert len(got) == len(rows) and Counter((x.doc_id, x.source, x.size) for x in got) == Counter((i, s, len((t or "").split())) for i, t, s in rows)
        taken = Counter()
        for x in got:
            assert x.source_size == sizes[x.source] and abs(x.target - aims[x.source]) < 1e-6 * (1 + aims[x.source])
            assert x.taken == x.times * x.size and 0 <= x.times <= 2
            taken[x.source] += x.taken
        for s in sizes:
            # several documents fill the rest of each target to the word
            assert abs(taken[s] - aims[s]) <= (1 if sizes[s] > 5 else sizes[s]), (s, taken[s], aims[s])
        again = mixing.mixture(d.repartition(7), bucket=bucket, reserve=reserve).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert whole == sorted(map(tuple, mixing.mixture(d).collect()), key=str)
    assert mixing.mixture(d.filter("doc_id < 0")).count() == 0
    assert [(x.taken, x.target) for x in mixing.mixture(mixed_rows(spark, [(1, None, None), (1, "", "b")])).collect()] == [(0, 0.0)] * 2


def test_knapsack_equals_brute_force():
    r = random.Random(6)
    for _ in range(150):
        n = r.randint(1, 5)
        sizes, free = np.array(r.sample(range(1, 40), n)), np.array([r.randint(0, 3) for _ in range(n)])
        budget = r.randint(0, 120)
        took = mixing.knapsack(sizes, free, budget)
        assert (took >= 0).all() and (took <= free).all()
        sums = {0}
        for s, f in zip(sizes.tolist(), free.tolist()):
            sums = {a + s * k for a in sums for k in range(f + 1)}
        assert abs(int((took * sizes).sum()) - budget) == min(abs(s - budget) for s in sums)


def test_fit_tracks_sizes_and_hits_the_budget():
    r = np.random.default_rng(7)
    sizes = np.unique(r.integers(1, 20_000, 3000))
    counts = r.integers(1, 50, len(sizes))
    total = int((sizes * counts).sum())
    for share in (0.001, 0.3, 0.77, 0.999, 1.0):
        took = mixing.fit(sizes, counts, round(share * total))
        assert (took >= 0).all() and (took <= counts).all() and int((took * sizes).sum()) == round(share * total)
    took = mixing.fit(sizes, counts, round(0.4 * total), reserve=1000)
    small = sizes < np.median(sizes)
    assert abs((took[small] * sizes[small]).sum() / (counts[small] * sizes[small]).sum() - 0.4) < 0.02
    huge = sizes * 10_000_000  # beyond the sums of the table: in units of many words
    took = mixing.fit(huge, counts, round(0.4 * total) * 10_000_000)
    assert abs(int((took * huge).sum()) / (0.4 * total * 10_000_000) - 1) < 1e-4


# 2, joins of leaves ---------------------------------------------------------------------------------------------------
def test_unsplit_text_is_joined_by_windows_of_tokens():
    from barloom.llm import bpe

    path, r = P.path("word_bpe_49k.json"), random.Random(4)
    lib, enc = Tokenizer.from_file(path), bpe.Encoder(path, "word")

    def joined(text, leaf):
        leaves = [text[i : i + leaf] for i in range(0, len(text), leaf)]
        return bpe.join_all(enc, list(zip(leaves, [x[0] for x in enc.encode(leaves)])))

    def whole(text):
        return np.asarray(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(262_144))
    enc.coded = 0
    assert joined(text, bpe.LEAF_CHARS) == whole(text) and enc.coded < 0.1 * len(text)
    for alphabet in ("!?.,;:#$%&*()-_=+", "ab'srevmdl019.,!é ", "ab'srevmdlt01.,\n", "a'sd", "éÀøz", "0123456789abcdef", "日本aé🙂 "):
        for _ in range(12):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(3000, 9000)))
            assert joined(text, 1500) == whole(text), alphabet
    for _ in range(10):
        text = " ".join("".join(r.choice("abcde'srt.") for _ in range(int(r.paretovariate(0.5)) % 5000 + 1)) for _ in range(60))
        assert joined(text, 2500) == whole(text)


# 1, columns of any name -----------------------------------------------------------------------------------------------
def test_masking_keeps_columns_of_any_name(spark):
    from barloom.llm import secret_scan

    d = spark.createDataFrame([(1, "k", "token = Abcdef123456789 and more", 5, "s"), (None, None, None, 6, None)], "doc_id long, __spans string, text string, all int, spans string")
    got = secret_scan.masked_secrets(d)
    assert got.columns == d.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "k", f"{secret_scan.MASK} and more", 5, "s"), (None, None, None, 6, None)], key=str)


# 7, 9 and 10: null ids, ties and columns of any name ------------------------------------------------------------------
def test_vectors_with_null_ids(spark):
    from barloom.llm import embedding_dedup

    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (6, [0.999, 0.001], 1), (None, [0.0, 1.0], 1), (None, None, 1), (7, [1.0, 0.0], None), (8, [-1.0, 0.0], 2)]
    d = spark.createDataFrame([(*r, 0, "k", "b") for r in rows], "vec_id long, embedding array<float>, label int, m int, key string, block string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(d).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (6, 2, 5, False), (None, 0, None, True), (None, 0, None, True), (7, 0, 7, True), (8, 0, 8, True)], key=str)


def test_rules_ignore_columns_of_any_name(spark):
    from barloom.llm import quality_rules

    text = "one two three four five six\nseven eight nine"
    d = spark.createDataFrame([(i, text, "h", 5, "x", 2, "y") for i in range(8)], "doc_id long, text string, source string, n_words int, host string, row int, line string")
    plain = quality_rules.quality_rules(d.select("doc_id", "text", "source")).collect()
    assert sorted(map(str, plain)) == sorted(map(str, quality_rules.quality_rules(d).collect())) and len(plain) == 8


def test_list_entries_with_nulls_and_ties(spark):
    import datetime as dt

    from barloom.llm import url_filters

    day = lambda n: dt.date(2024, 1, n)
    caps = spark.createDataFrame([(1, "http://a.example.org/x", day(5), "s"), (2, None, day(5), "s"), (3, "http://b.example.org/y", day(9), "s"), (4, "http://b.example.org/y", None, "s")], "id long, url string, fetched_on date, entry string")
    entries = [("abuse", "host", "a.example.org", day(5), "add")] * 3 + [("abuse", "host", None, day(1), "add"), (None, None, None, None, None), ("abuse", "host", "b.example.org", day(1), "add"), ("abuse", "host", "b.example.org", day(9), "remove")]
    got = {r.id: (r.n_block, r.kept) for r in url_filters.temporal_url_filter(caps, spark.createDataFrame(entries, "list_name string, scope string, entry string, dated date, action string")).collect()}
    assert got == {1: (1, False), 2: (0, True), 3: (0, True), 4: (0, True)}

"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from tokenizers import Tokenizer

from barloom.llm import bpe, embedding_dedup, html_extract, near_dedup, packing, quality_rules, secret_scan, suffix_dedup, toxicity, url_filters
from barloom.llm.suffixes import permuted_prefixes, permuted_repeats, suffix_array

WORDS = "the of and to in river stone house green window paper light dark seven garden cloud table north road winter".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, c long, batch string, __key string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = prose(1, 6000)
    near = prose(2, 300)
    rows = [
        (1, near), (2, near), (3, near.replace("river", "rivers", 1)), (4, prose(3, 200)), (5, None), (6, ""), (7, "one two"), (8, "One  TWO"), (9, long), (10, long + " end"),
        (11, prose(4, 40) + "\n" + prose(5, 60) + " password = Abcdef123456789 user: anna https://h.example.org/x"), (12, prose(6, 30) + "\n" + prose(5, 60)), (4, prose(3, 200)),
        (None, prose(7, 50)), (13, "naïve é 日本語 🙂 <|endoftext|> " + "x" * 3000), (14, " \n\t "), (15, near + " tail of its own with several more words in it"), (16, "a" * 500), (17, "a" * 400),
    ]
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 2}", 0, 1, 2, "b", "k") for i, t in rows], DOCS)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def empty(docs):
    return docs.filter("doc_id = -1")


# 1 ------------------------------------------------------------------------------------------------------------------
def test_secrets(spark, docs):
    rows = secret_scan.secret_scan(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id not in (4, None)}
    assert by[11].n_assign == 1 and by[11].spans.count("assign") == 1
    assert "weak_id" in by[11].spans and "endpoint" in by[11].spans  # both parts stand near a secret
    assert by[5].spans == "" and by[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.secret_scan(empty(docs)).count() == 0
    far = spark.createDataFrame([(1, "user: anna " + "x " * 400 + "password=Abcdef123456789")], "doc_id long, text string")
    assert "weak_id" not in secret_scan.secret_scan(far).first().spans
    masked = {r.doc_id: r.text for r in secret_scan.masked_secrets(docs).collect() if r.doc_id == 11 or r.doc_id == 5}
    assert "Abcdef" not in masked[11] and secret_scan.MASK in masked[11] and masked[5] is None


def linked_by_hand(text: str, reach: int) -> set:
    """Every pair of parts of a text looked at."""
    parts = secret_scan.base_spans(text)
    parts = sorted(parts + secret_scan.weak_spans(text, parts))
    role = {0: "secret", 2: "secret", 4: "secret", 1: "id", 3: "id", 5: "none"}
    out = set()
    for s, k, e in parts:
        near = {role[j] for a, j, b in parts if (a, j, b) != (s, k, e) and b > s - reach and a < e + reach}
        if k < 3 or (k == 3 and "secret" in near) or (k == 4 and "id" in near) or (k == 5 and {"id", "secret"} <= near):
            out.add(f"{secret_scan.KINDS[k]}:{s}:{e}")
    return out


def test_links_equal_all_pairs(spark):
    r = random.Random(12)
    pieces = ["user: anna", "mail bob.x@h.example.org", "AKIA" + "B" * 16, "token = Abcdef123456789", "0123456789abcdef0", "Zx9" * 8, "https://h.example.org/x?y", "10.0.0.7:5432", "10.1.2.3", "1.2.3.4.5"]
    rows = [(i, " ".join(r.choice([r.choice(pieces), "w" * r.randint(1, 150), "é " * 30]) for _ in range(r.randint(0, 25)))) for i in range(150)]
    got = {x.doc_id: x for x in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert set(filter(None, got[i].spans.split(","))) == linked_by_hand(t, secret_scan.REACH), i
    assert sum(g.n_linked for g in got.values()) > 100


def test_base_secrets_by_hand():
    text = "Token: 'abcdefghijkl' AKIA" + "A" * 14 + " " + "0f" * 8 + " secret=short"
    assert [(k, text[s:e]) for s, k, e in secret_scan.base_spans(text)] == [(0, "Token: 'abcdefghijkl"), (1, "AKIA" + "A" * 14), (2, "0f" * 8)]


# 2, 6 ---------------------------------------------------------------------------------------------------------------
def test_bpe_equals_library(docs):
    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = sorted(
        (str(i), len(e.ids), hashlib.sha256(np.asarray(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())
        for i, t in texts(docs) for e in [lib.encode(t, add_special_tokens=False)]
    )
    for leaf in (700, bpe.LEAF_CHARS):
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_round_trip(docs, path, leaf).collect())
        assert got == want
    assert bpe.bpe_round_trip(empty(docs), path).count() == 0


def test_long_words_by_tree():
    enc = bpe.encoder(P.path("byte_bpe_50k.json"), "byte")
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(5)
    for _ in range(200):
        w = "".join(r.choice("abcdeth") for _ in range(r.randint(1, 400)))
        assert enc.word(w, leaf=r.choice([2, 7, 50])) == lib.encode(w, add_special_tokens=False).ids


def test_packing_covers_everything(docs):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = packing.best_fit_packing(docs.filter("doc_id is null or doc_id != 4"), path, capacity=256).collect()
    seqs: dict = {}
    by: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault(r.doc_id, []).append(r)
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 256
    for i, t in texts(docs.filter("doc_id is null or doc_id != 4")):
        ids = np.asarray([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, p in enumerate(sorted(by[i], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert len(seqs) <= 1.1 * sum(r.length for r in rows) / 256 + 2
    assert packing.best_fit_packing(empty(docs), path).count() == 0


def fewest(lengths: list[int], capacity: int) -> int:
    """The fewest sequences that hold the pieces, by trying all ways."""
    best = len(lengths)

    def put(i: int, rooms: list[int]):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in sorted(set(rooms)):
            if k >= lengths[i]:
                j = rooms.index(k)
                put(i + 1, [*rooms[:j], k - lengths[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


def test_packing_against_the_fewest():
    r = random.Random(4)
    lost = 0
    for _ in range(150):
        n = [r.choice([r.randint(1, 100), r.randint(30, 70)]) for _ in range(r.randint(1, 9))]
        seq, off = packing.pack(np.array(n), 100)
        room: dict = {}
        for s, o, k in sorted(zip(seq.tolist(), off.tolist(), n)):
            assert o == room.get(s, 0) and o + k <= 100
            room[s] = o + k
        best = fewest(n, 100)
        assert len(room) <= best + 1
        lost += len(room) - best
    assert lost <= 8


def test_ranks_equal_library():
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    r = random.Random(2)
    for _ in range(500):
        t = "".join(r.choice("ab \n\t'sEl1²½é日🙂  .,!#<|>_-") for _ in range(r.randint(0, 40)))
        assert np.frombuffer(bpe.rank_ids(path, t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


# 3 ------------------------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a> <a>About us</a></nav></header>
<div class="cookie-notice">We use cookies to improve things. Accept?</div>
<div class="wrap with-sidebar"><main><article><h2>Title &amp; more</h2><p>First   para <a href=q>link</a> text.</p><div class="ad">Buy now</div><p>Second<ul><li>one<li>two</ul><aside>Related: foo</aside>
<form><input><label>Name</label></form><p>Short</article><section id="comments"><article><p>Nice post, I really like what you have written here.</p></article></section></main>
<div class="sidebar"><p>Popular posts with a long text that runs on and on and on.</p></div></div><footer>c 2020</footer><script>x("<p>no</p>")</script></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>" + "word " * 30 + "end."), (1, "u", PAGE), (5, "u", "<nav><a>x</a></nav><!-- <p>no"), (6, "u", "<article>" + "<p>Para." * 5000)]
    got = html_extract.extract_text(spark.createDataFrame([(*r, "t", "x") for r in rows], "page_id long, url string, html string, text string, n_chars string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "Title & more\nFirst para link text.\nSecond\none\ntwo\nShort"
    assert by[2] == by[3] == by[5] == "" and by[None].endswith("end.") and by[6].count("\n") == 4999


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p title=John's>Hello there, John.</p><p title=Ann's>World of words.</p>", ["Hello there, John.", "World of words."]),
        ('<p title="a>b">x</p><p class=a\'b id=\'q\'>y</p>', ["x", "y"]),
        ('<p>y</p><a href=x title="unclosed>z</a>', ["y", "z"]),
        ("<p>a<b", ["a"]), ("<p =x y>k</p>", ["k"]), ("a < b and c", ["a < b and c"]), ("<!--->x", ["x"]), ("</ x>y", ["y"]), ("<p title='unended <i>gone", ["gone"]),
    ],
)
def test_tags_by_states(page, want):
    assert [b[0] for b in html_extract.blocks(page)] == want


def test_cut_changes_labels(spark):
    """An advert of whole sentences goes with its element; a linked and a short paragraph stay with the article."""
    long = "A sentence of quite some words that says something about the matter at hand, and then goes on for a while."
    page = f'<div class="ad"><p>{long}</p></div><article><p>{long}</p><p><a href=x>Read this</a></p><p>Yes</p><p>{long}</p></article><p>{long}</p>'
    rows = html_extract.blocks(page)
    own = [z > 0 for z in html_extract.odds(rows)]
    text, n, moved = html_extract.main_text(page)
    assert own == [True, True, False, False, True, True] and text.split("\n") == [long, "Read this", "Yes", long] and moved == 4
    # without any mark the cut still smooths: the linked paragraph between long ones stays, the links of the end go
    bare = f"<div><p>{long}</p><p>Yes</p><p>{long}</p></div><ul>" + "<li><a href=x>Link</a></li>" * 4 + "</ul>"
    text, _, moved = html_extract.main_text(bare)
    assert text.split("\n") == [long, "Yes", long] and moved == 1
    weights = html_extract.fitted_weights(spark.createDataFrame([(i, page) for i in range(50)] + [(None, page), (60, None)], "page_id long, html string"))
    assert len(weights) == len(html_extract.PRIOR) and weights != list(html_extract.PRIOR)
    assert html_extract.fitted_weights(spark.createDataFrame([(1, "<p>x")], "page_id long, html string")) == list(html_extract.PRIOR)


def test_minimum_cut_is_minimal():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 8)
        z = [r.uniform(-2, 2) for _ in range(n)]
        e = [(i, j, r.random()) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        cost = lambda c: sum(max(a, 0) if not k else max(-a, 0) for a, k in zip(z, c)) + sum(w for i, j, w in e if c[i] != c[j])  # noqa: E731, B023
        assert abs(cost(html_extract.minimum_cut(z, e)) - min(cost([bool(b >> k & 1) for k in range(n)]) for b in range(1 << n))) < 1e-9


# 4 ------------------------------------------------------------------------------------------------------------------
def test_toxicity(spark):
    bad = ["idiotox", "moronik"]
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = prose(100 + i, 40).split()
        if toxic:
            w = bad[i % 2]
            k = r.randint(1, len(w) - 1)
            t.insert(r.randint(0, 39), w if i % 3 else w[:k] + r.choice("xyz.") + w[k:])
        rows.append((i, ". ".join(" ".join(t[j : j + 8]) for j in range(0, len(t), 8)), "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, prose(1, 30), "x")]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    held = [g for g in got if g.held_out and g.doc_id < 400]
    assert all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert sum(g.predicted == int(g.doc_id % 4 == 0) for g in held) / len(held) >= 0.95
    assert toxicity.toxicity(d.limit(0), lab).count() == 0
    assert {g.score for g in toxicity.toxicity(d, lab.limit(0)).collect()} == {0.0}
    assert toxicity.clean_documents(d, lab).columns == d.columns
    # an inserted letter costs some of a sentence's value, but doesn't hide it
    model = toxicity.fitted(*toxicity.training_rows(d, lab))

    def known(text):
        said = toxicity.sentences(text)
        model.learn({u for us in said for u in us})
        return said

    value = lambda t: max(map(model.sentence, known(t)))
    plain, spoiled, clean = (value(f"the river {w} and stone of the north road.") for w in ("idiotox", "idixotox", "garden"))
    assert plain > 0 and spoiled > 0 and clean < 0
    score = {w: model.score(known(f"the paper and light. river {w} stone of the north road.")) for w in ("idiotox", "id.iotox", "i d i o t o x", "winter")}
    assert min(score["idiotox"], score["id.iotox"], score["i d i o t o x"]) >= 0.5 > score["winter"]


# 5 ------------------------------------------------------------------------------------------------------------------
def shingles(text: str, k: int) -> frozenset:
    low = text.translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return frozenset([tuple(w)] if 0 < len(w) < k else zip(*[w[j:] for j in range(k)]))


def components_by_hand(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if linked(ids[a], ids[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("words, least", [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, words, least):
    got = near_dedup.near_duplicates(docs, words, least).collect()
    assert len(got) == docs.count()
    sets = {i: shingles(t, words) for i, t in texts(docs) if i is not None}
    want = components_by_hand(sorted(sets), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert want[3] == want[2] == 1 and want[8] == 7 and want[10] == 9
    assert near_dedup.near_duplicates(empty(docs)).count() == 0


def test_near_duplicate_groups_beyond_a_block(spark):
    """A group far beyond a block's size, with chains whose ends aren't linked directly."""
    base = prose(50, 160).split()
    rows, r = [], random.Random(3)
    for i in range(400):
        w = list(base)
        for _ in range(3):
            w[r.randrange(160)] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(60 + i, 100)) for i in range(50)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    sets = {i: shingles(t, 3) for i, t in rows}
    assert got == components_by_hand(sorted(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))


def framed(pairs: int) -> list[tuple[int, str]]:
    """Documents of one frame that don't link by it (156 of 204 words), in pairs at 0.8 exactly; one word is one shingle."""
    frame = [f"f{k}" for k in range(156)]
    return [(2 * i + j, " ".join([*frame, *(f"p{i}x{k}" for k in range(4)), *(f"d{i}y{j}z{k}" for k in range(20))])) for i in range(pairs) for j in range(2)]


def test_near_duplicates_in_full_regions(spark):
    """Pairs at the threshold whose regions are deepened in every tree."""
    rows = framed(700)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    assert {i: c for i, c in got.items() if c != i - i % 2} == {}


def test_near_duplicate_groups_stay_bounded(spark, monkeypatch):
    """Many documents of one frame that don't link: no group holds them all, and only true pairs are formed."""
    most, ordered, confirmed, looked = [], near_dedup._ordered, near_dedup._confirmed, []

    def counted(rows, parts):
        most.append(rows.groupBy("tree", "depth", "region", "block").count().agg({"count": "max"}).first()[0] or 0)
        return ordered(rows, parts)

    def told(pairs, *a):
        looked.append(pairs.count())
        return confirmed(pairs, *a)

    monkeypatch.setattr(near_dedup, "_ordered", counted)
    monkeypatch.setattr(near_dedup, "_confirmed", told)
    rows = framed(250) + [(1000, framed(250)[0][1] + " and one more")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    assert got == {1000: 0} | {i: i - i % 2 for i in range(500)}
    assert max(most) <= 1.5 * near_dedup.REGION and looked[1] <= 500


# 7, 10 --------------------------------------------------------------------------------------------------------------
def test_quality_rules(spark, docs):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in (9, 13, 16):
            t = dict(texts(docs))[r.doc_id]
            w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
            win = list(zip(w, w[1:], w[2:]))
            dup = {p for i, x in enumerate(win) if win.count(x) > 1 for p in (i, i + 1, i + 2)} if len(win) < 9000 else set()
            assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(dup))
    assert quality_rules.quality_rules(empty(docs)).count() == 0
    shared = spark.createDataFrame([(i, prose(i, 60) + "\nShared line 12 of this host\n" + "\n".join(["the very same words"] * 40 * (i == 1)), "h") for i in range(8)], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(shared, max_docs=5).collect()}
    assert all(r.lost_words == 6 and r.kept for i, r in rows.items() if i != 1) and not rows[1].kept and rows[1].n_dup_lines == 39


def test_frequent_lines_count_documents(spark):
    """Lines of exact copies are frequent too, and go from the texts; rows of one id, or without one, are one document."""
    copy = "Footer of all  copies 7\n" + prose(1, 60)
    own = [prose(20 + i, 60) for i in range(4)]
    rows = [(i, copy, "h") for i in range(8)] + [(50, copy, None)] * 9 + [(None, own[3], "n")] * 9
    rows += [(100 + i, f"FOOTER of all copies {i}\n{t}\r\n\n last", "h") for i, t in enumerate(own[:3])] + [(200, None, "h"), (201, "", "h")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.lost_words): r.kept for r in quality_rules.quality_rules(d, max_docs=5).collect()}
    assert got[0, 65] is False and got[101, 5] and got[50, 0] and got[None, 0]
    assert {r.lost_words for r in quality_rules.quality_rules(d, max_docs=5, counted="text_hash").collect()} == {0}
    left = sorted(quality_rules.without_frequent_lines(d, max_docs=5).collect(), key=str)
    want = [(i, "" if s == "h" and i < 8 else f"{own[i - 100]}\r\n\n last" if i in (100, 101, 102) else t, s) for i, t, s in [(-1 if i is None else i, t, s) for i, t, s in rows]]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.source) for r in left if r.source and r.text is not None) == sorted(w for w in want if w[2] and w[1] is not None)
    assert sum(r.text == copy for r in left) == 9 and sum(r.text is None for r in left) == 1
    assert quality_rules.without_frequent_lines(d.limit(0)).columns == d.columns


def test_url_filters(spark):
    day = "2024-0{}-01"
    entries = spark.createDataFrame(
        [("abuse", "host", "a.example.com", day.format(2), "add"), ("abuse", "host", "a.example.com", day.format(4), "remove"), ("allow", "domain", "b.example.com", day.format(1), "add"), ("spam", "path", "b.example.com/x", day.format(1), "add"), ("abuse", "host", None, day.format(1), "add")],
        "list_name string, scope string, entry string, dated string, action string",
    ).withColumn("dated", __import__("pyspark.sql.functions", fromlist=["to_date"]).to_date("dated"))
    caps = spark.createDataFrame([(1, "http://A.example.com/p", day.format(1)), (2, "https://a.example.com/p", day.format(3)), (3, "https://a.example.com", day.format(4)), (4, "http://b.example.com/x/y", day.format(5)), (5, None, day.format(1)), (6, "nonsense", None), (2, "https://a.example.com/p", day.format(3))], "id long, url string, d string")
    caps = caps.selectExpr("id", "url", "cast(d as date) as fetched_on")
    got = sorted((r.id, r.n_block, r.n_allow, r.reason, r.kept) for r in url_filters.temporal_url_filter(caps, entries).collect())
    assert got == [(1, 0, 0, "none", True), (2, 1, 0, "abuse:host", False), (2, 1, 0, "abuse:host", False), (3, 0, 0, "none", True), (4, 1, 1, "spam:path", True), (5, 0, 0, "none", True), (6, 0, 0, "none", True)]
    assert url_filters.temporal_url_filter(caps.limit(0), entries).count() == 0 and all(r.kept for r in url_filters.temporal_url_filter(caps, entries.limit(0)).collect())


# 8 ------------------------------------------------------------------------------------------------------------------
def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for k in range(150):
        d = rng.integers(0, rng.integers(1, 5), rng.integers(0, 150)).astype("uint8") if k % 5 else np.frombuffer((b"abcab" * 40)[:k], "uint8")
        s = d.tobytes()
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix_array(d).tolist() == want
        sa = suffix_array(d, 9)
        assert [s[i : i + 9] for i in sa] == [s[i : i + 9] for i in want]
        if len(s):
            shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(s[a : a + 20], s[b : b + 20])) if x != y), min(20, len(s) - max(a, b)))  # noqa: E731, B023
            assert permuted_prefixes(d, suffix_array(d), 20)[want].tolist() == [0, *(shared(a, b) for a, b in zip(want[1:], want[:-1]))]
            assert permuted_repeats(d, sa, 9).tolist() == [False, *(len(s[a : a + 9]) == 9 and s[a : a + 9] == s[b : b + 9] for a, b in zip(sa[1:], sa[:-1]))]


def removed_by_hand(rows, length=50):
    """doc_id, bytes removed, spans and kept bytes; rows of one id are one document."""
    out, seen = {}, {}
    last = float("inf")
    for i, t in rows:
        for j in range(len(t) - length + 1):
            w = t[j : j + length]
            seen[w] = min(seen.get(w, last), last if i is None else i)
    for i, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] < (last if i is None else i):
                gone[j : j + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_passages(spark, docs):
    want = removed_by_hand([(i, t.encode()) for i, t in texts(docs)])
    got = suffix_dedup.repeated_passages(docs.select("doc_id", "text", "row", "batch")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
    assert want[12][1] > 50 and want[10][1] > 1000
    # every repeated anchor counts as hot: its windows are dealt one by one
    hot = suffix_dedup.repeated_passages(docs.select("doc_id", "text"), hot=1).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in hot} == want
    clash = docs.selectExpr("doc_id", "text", "1 as n_bytes", "2 as __key", "3 as __d", "4 as size", "5 as d", "6 as kept_text", "7 as row")
    got = suffix_dedup.repeated_passages(clash)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r["__key"], r.d, r.row) for r in got.collect()} == {i: (*w, 2, 5, 7) for i, w in want.items()}
    assert suffix_dedup.without_repeats(clash).columns == clash.columns
    assert suffix_dedup.repeated_passages(empty(docs)).count() == 0
    assert suffix_dedup.without_repeats(docs).columns == docs.columns


def test_repeated_passages_of_periodic_and_alike_texts(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choice(["ab", "abc", "the river of ", "house "]) for _ in range(60)) + r.choice(["", "xyz" * 30, "x" * 80, prose(20, 12)])) for i in range(60)]
    rows += [(100 + i, prose(i, 8) + prose(20, 12)[: 45 + i] + prose(50 + i, 8)) for i in range(12)]
    want = removed_by_hand([(i, t.encode()) for i, t in rows])
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (suffix_dedup.HOT, 7):
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_passages(d, hot=hot).collect()} == want


def test_only_contexts_with_half_a_window_in_common_are_sorted(monkeypatch):
    """A frequent string between bytes of its own in each text; two of the texts share a whole window."""
    r = random.Random(1)
    own = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(34))
    gram = "\x00the same anchor"
    g = suffix_dedup.gram_hashes
    anchor = int(g(np.frombuffer(gram.encode(), "uint8"))[0])
    monkeypatch.setattr(suffix_dedup, "gram_hashes", lambda x: np.where(g(x) == np.uint64(anchor), np.uint64(1), g(x)))
    texts = [own() + gram + own() for _ in range(200)]
    texts.append("A" * 17 + texts[0][17:67] + "B" * 17)
    size, data = np.full(1, 84, "<u4").tobytes(), [t.encode() for t in texts]
    kept = []
    sort = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda x, n: kept.append(len(x)) or sort(x, n))
    blobs = {"size": [size] * 201, "least": [np.full(1, i, "<i8").tobytes() for i in range(201)], "bytes": data}
    t = pa.table({"shard": [0] * 201, "batch": list(range(201)), **blobs})
    said = suffix_dedup._rank(50)([pa.scalar(0)], t).column("blob").to_pylist()
    pairs = [np.frombuffer(x, "<i8").reshape(-1, 2).tolist() for x in said]
    assert pairs[:200] == [[[i, 35]] for i in range(200)] and pairs[200] == [[200, 17], [0, 1], [200, 17]]
    assert kept == [2 * 84]


# 9 ------------------------------------------------------------------------------------------------------------------
def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 16))
    x[600:900] = x[0] + rng.normal(size=(300, 16)) * 0.06 * np.linalg.norm(x[0]) / 4
    x[900:903] = x[5]
    label = rng.integers(0, 2, 1200)
    label[600:900] = label[0]
    label[900:903] = label[5]
    rows = [(i, v.tolist(), int(k), "x") for i, (v, k) in enumerate(zip(x, label))]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, x[0].tolist(), None), (2004, [1.0, 2.0], 1), (2005, [], 1), (2006, [None] * 16, 0)]
    d = spark.createDataFrame([*rows, *[(*o, "x") for o in odd]], "vec_id long, embedding array<double>, label int, key string")
    got = embedding_dedup.near_vectors(d, shard=200)
    by = {r.vec_id: r for r in got.collect()}
    assert len(by) == 1207
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    assert near.sum() > 5000
    assert sum(by[i].n_links for i in range(1200)) >= 0.99 * near.sum() and all(by[i].n_links <= near[i].sum() for i in range(1200))
    want = components_by_hand(list(range(1200)), lambda a, b: near[a, b])
    assert sum(by[i].component_id == want[i] for i in range(1200)) >= 1190
    assert all(by[o[0]].n_links == 0 and by[o[0]].component_id == o[0] and by[o[0]].kept for o in odd)
    found = embedding_dedup.audit_recall(d.filter("vec_id < 1200"), got).first()
    assert found.found >= 0.9 * found.true_links and found.false_links == 0
    assert embedding_dedup.near_vectors(d.limit(0)).count() == 0



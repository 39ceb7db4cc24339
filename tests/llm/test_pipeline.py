"""Every stage of the pipeline against brute force on its own input, and the whole of it."""

import random

import pytest

import corpus_pipeline
import public_tokenizers as P
from barloom.llm import secret_scan, toxicity
from tokenizers import Tokenizer

from .test_operators import components_by_hand, linked_by_hand, prose, removed_by_hand, shingles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, all string, label int, kept boolean, row long, size int"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    r, rows, labels = random.Random(8), [], []
    frame = prose(900, 40)
    for i in range(160):
        said = [prose(1000 + 50 * i + k, 9) for k in range(6)]
        if i % 4 == 0:
            said[r.randrange(6)] += " idiotox" if i % 3 else " idio.tox"
        if i % 10 == 3:
            said.append(frame)
        if i % 10 == 7:
            said.append(f"mail bob{i}@h.example.org token = Abcdef{i:09d} at 10.0.{i}.7:5432")
        rows.append((i, ". ".join(said)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(300 + k, rows[k][1] + " end") for k in (1, 2, 5)] + [(1, rows[1][1]), (310, None), (311, ""), (312, "a b"), (None, prose(5, 30)), (None, None), (313, frame), (314, "é" * 60), (315, "x" + "é" * 60)]
    top = tmp_path_factory.mktemp("world")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", 1, None, 7, 3) for i, t in rows], COLUMNS)
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def rows_of(d):
    return sorted(((r.doc_id, r.text) for r in d.collect()), key=str)


def test_stages(spark, world):
    docs = spark.read.parquet(f"{world}/documents.parquet")
    labels = spark.read.parquet(f"{world}/labels.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs, corpus_pipeline.written(stage(spark, docs, world))
        docs = out[name][1]
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
            assert all(r["all"] == "c" and r.row == 7 and r.kept is None for r in docs.collect())
            assert stage(spark, out[name][0].limit(0), world).count() == 0

    before, after = out["toxicity"]
    said = toxicity.toxicity(before.select("doc_id", "text"), labels, keep=("doc_id", "text")).filter("predicted = 0")
    assert rows_of(after) == rows_of(said)
    left = [i for i, _ in rows_of(after) if i is not None and i < 160]
    assert all(i in left for i in range(160) if i % 4) and sum(i % 4 == 0 for i in left) <= 2

    before, after = out["near_duplicates"]
    rows = rows_of(before)
    sets = {i: shingles(t or "", 5) for i, t in rows if i is not None}
    root = components_by_hand(sorted(sets), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert rows_of(after) == [x for x in rows if x[0] is None or root[x[0]] == x[0]] and len(rows) - after.count() >= 3

    before, after = out["repeated_passages"]
    rows = [(i, (t or "").encode()) for i, t in rows_of(before)]
    want = {(i, t): removed_by_hand_of(rows, i, t) for i, t in rows}
    kept = [(i, None if t is None else want[i, t.encode()]) for i, t in rows_of(before)]
    assert rows_of(after) == sorted(((i, t) for (i, t), (_, old) in zip(kept, rows) if t or not old), key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.collect())
    assert sum(len(t or "") for _, t in rows_of(after)) < sum(len(t or "") for _, t in rows_of(before)) - 400

    before, after = out["secrets"]
    assert rows_of(after) == sorted(((i, masked_by_hand(t)) for i, t in rows_of(before)), key=str) and sum(secret_scan.MASK in (t or "") for _, t in rows_of(after)) >= 8

    before, after = out["packing"]
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((str(i), len(lib.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows_of(before))
    assert sorted((str(r.doc_id), r.length) for r in after.collect()) == want
    assert after.select("sequence_id").distinct().count() == -(-sum(n for _, n in want) // 2048)

    whole = corpus_pipeline.run(spark, world)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole.select(columns).collect())) == sorted(map(str, after.select(columns).collect()))


def removed_by_hand_of(rows, doc_id, text):
    """What is left of a text, without the rest of characters that were cut."""
    last = float("inf")
    own = last if doc_id is None else doc_id
    seen = {t[j : j + 50] for i, t in rows if (last if i is None else i) < own for j in range(len(t) - 49)}
    gone = bytearray(len(text))
    for j in range(len(text) - 49):
        if text[j : j + 50] in seen:
            gone[j : j + 50] = b"\1" * 50
    return bytes(b for b, g in zip(text, gone) if not g).decode(errors="ignore")


def masked_by_hand(text):
    if not text:
        return text
    covered = [False] * len(text)
    starts = set()
    at = 0
    for s, e in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in linked_by_hand(text, secret_scan.REACH))):
        if s >= at:
            starts.add(s)
        at = max(at, e)
        covered[s:e] = [True] * (e - s)
    return "".join((secret_scan.MASK if i in starts else "") if covered[i] else c for i, c in enumerate(text))

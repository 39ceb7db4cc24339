"""Secret scans with multipart credential linking.

Step 1 reads each whole text once (Arrow batches) and yields the spans of the base kinds plus weak parts: bare mixed
tokens (``weak_secret``), account names and mail addresses (``weak_id``), and addresses of services and machines
(``endpoint``). Step 2 is the interval join:
a weak part is reported only if complementary parts lie within ``reach`` code points in the same scope (the document):

- weak_secret needs an identifier (access or weak_id),
- weak_id needs a secret (assign, hex or weak_secret),
- endpoint needs an identifier and a secret.

The join is on (document, block of ``reach`` code points). The side that is asked is reduced beforehand to the smallest
start and largest end per block and role, which is all that an overlap test with neighbouring blocks needs; so a text
with thousands of parts never yields pairs.

Defined cases: null text is empty text; no spans give the empty string and the hash of the empty string; repeated rows
and null or repeated doc_id are scanned apart and give a row each; other columns are ignored; an empty table gives an
empty result. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

REACH = 200
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WEAK_ID = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A)
ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ENDPOINT = re.compile(r"\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?(?![\d.]*\d)", re.A)
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MIXED = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))
MASK = "[secret]"
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(text)]
    if "@" in text:
        named, k = [(a, b) for a, _, b in out], 0  # both in the order of the text
        for m in ADDRESS.finditer(text):
            while k < len(named) and named[k][1] <= m.start():
                k += 1
            if k == len(named) or m.start() < named[k][0]:
                out.append((m.start(), 3, m.end()))
    out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    ends, k = [*base, *[(s, 5, e) for s, kind, e in out if kind == 5]], 0
    ends.sort()
    reach = 0
    for m in TOKEN.finditer(text):
        if all(p.search(m[0]) for p in MIXED):
            while k < len(ends) and ends[k][0] < m.end():
                reach = max(reach, ends[k][2])
                k += 1
            if reach <= m.start():
                out.append((m.start(), 4, m.end()))
    return sorted(out)


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, parts array<struct<kind:int,start:long,stop:long>>"


def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        text = text or ""
        base = base_spans(text)
        said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        n = [sum(k == x for _, k, _ in base) for x in range(3)]
        parts = [{"kind": k, "start": s, "stop": e} for s, k, e in sorted(base + weak_spans(text, base))]
        rows.append((*n, hashlib.sha256(said.encode()).hexdigest(), parts))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "parts"])


def _masked(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, said in zip(texts, spans):
        if said:
            at, parts = 0, []
            for _, a, b in (x.split(":") for x in said.split(",")):
                if int(b) > at:
                    if int(a) >= at:
                        parts += [text[at : int(a)], MASK]
                    at = int(b)
            text = "".join([*parts, text[at:]])
        out.append(text)
    return pd.Series(out, dtype=object)


def secret_scan(docs: DataFrame, reach: int = REACH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_assign, n_access, n_hex, base_sha256, spans, n_linked, one row per input row."""
    scanned = docs.select(F.struct(*keep).alias("doc"), F.pandas_udf(_scan, FOUND)("text").alias("found")).select("doc", "found.*").withColumn("row", F.monotonically_increasing_id())
    scanned = written(scanned)  # the texts are scanned once, though the join reads the parts twice
    parts = scanned.select("row", F.explode("parts").alias("p")).select("row", "p.*").withColumn("block", F.expr(f"start div {reach}"))
    role = F.expr("case when kind in (1, 3) then 'id' when kind in (0, 2, 4) then 'secret' end")
    asked = (
        parts.withColumn("role", role).filter("role is not null")
        # a part longer than a block is filed under each block it touches
        .withColumn("at", F.explode(F.expr(f"sequence(block, (stop - 1) div {reach})")))
        .groupBy("row", "role", "at")
        .agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    )
    weak = parts.filter("kind >= 3").withColumn("at", F.explode(F.expr(f"sequence(block - 1, (stop - 1) div {reach} + 1)")))
    near = weak.join(asked, ["row", "at"]).filter((F.col("last") > F.col("start") - reach) & (F.col("first") < F.col("stop") + reach))
    found = near.groupBy("row", "kind", "start", "stop").agg(F.max((F.col("role") == "id").cast("int")).alias("has_id"), F.max((F.col("role") == "secret").cast("int")).alias("has_secret"))
    found = found.filter("case kind when 4 then has_id = 1 when 3 then has_secret = 1 else has_id = 1 and has_secret = 1 end")
    linked = found.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("linked"))
    names = F.array(*[F.lit(k) for k in KINDS])
    out = scanned.join(linked, "row", "left").withColumn("linked", F.coalesce("linked", F.expr("cast(array() as array<struct<kind:int,start:bigint,stop:bigint>>)")))
    every = F.concat(F.filter("parts", lambda p: p["kind"] < 3), F.col("linked"))
    every = F.array_sort(F.transform(every, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["stop"].alias("stop"))))
    text = F.array_join(F.transform(every, lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["start"], p["stop"])), ",")
    found = ("n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size("linked").cast("long").alias("n_linked"))
    return out.select(*[F.col("doc")[c].alias(c) for c in keep], *found)


def masked_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with every span of its texts replaced by a mark; overlapping spans share one. Null text stays null."""
    own = docs.select(F.struct("*").alias("all"), "text")
    text = F.pandas_udf(_masked, "string")("all.text", "spans")
    return secret_scan(own, reach, ("all",)).select(*[text.alias(c) if c == "text" else F.col("all")[c].alias(c) for c in docs.columns])


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))

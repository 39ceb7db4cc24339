"""Quality rules with cross-document line frequency. DataFrame functions only.

Base rules look at one text (word count, repeated three-word windows). The method then hashes every normalised line
(lower case, digit runs as 0, white space as one space), counts the distinct documents (by ``doc_id``) of a host that hold
the line, drops lines above the host's limit, and rejects documents that lose more than ``max_lost`` per cent of their
words. A host's limit is ``MAX_SHARE_PCT`` per cent of its documents, but ``max_docs`` at most and ``LEAST_DOCS`` at least, so
that small hosts have frequent lines too. The host is the ``host_col`` column (``source`` for documents).
``without_frequent_lines`` returns the documents with the texts that are left. ``counted="text_hash"`` takes equal texts of
a host as one document.

Defined cases: null or empty text has no words and fails the base rules; a null host is a host of its own, and all rows
without an id are one document; repeated rows don't make their own lines frequent, give repeated, equal result rows, and
keep one text each; other columns of the input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, table, words, written

MIN_WORDS, MAX_REPEAT_PCT = 50, 50
MAX_DOCS, LEAST_DOCS, MAX_SHARE_PCT, MAX_LOST_PCT = 200, 5, 10, 50


def normalised_line(line):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), WHITE, " "))


def base_metrics(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """Base metrics of each text.

    Repeated windows: each three-word window becomes one long, its hash above and its position below, with just as many
    low bits as the text needs. Sorting longs brings equal windows together; neighbours tell which positions repeat.
    """
    d = docs.select("doc_id", F.col(host_col).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "host", F.xxhash64("text").alias("text_hash"), "text", words("text").alias("w"))
    has_word = F.expr("filter(split(text, '\\n'), l -> translate(l, ' \\t\\n\\u000b\\u000c\\r', '') != '')")
    d = (
        d.withColumn("n_words", F.size("w"))
        .withColumn("bits", F.expr("greatest(1, cast(ceil(log2(n_words + 1)) as int))"))
        .withColumn("low", F.expr("shiftleft(1L, bits) - 1"))
        .withColumn(
            "s",
            F.expr(
                "case when n_words < 4 then array() else sort_array(transform(sequence(0, n_words - 3), "
                "i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & ~low) | i)) end"
            ),
        )
        .withColumn(
            "p",
            F.expr(
                "sort_array(transform(filter(s, (x, k) -> (k > 0 and (s[k - 1] & ~low) = (x & ~low)) "
                "or (k < size(s) - 1 and (s[k + 1] & ~low) = (x & ~low))), x -> cast(x & low as int)))"
            ),
        )
        .withColumn("lines", has_word)
    )
    return d.select(
        "doc_id",
        "host",
        "text_hash",
        F.col("n_words").cast("long").alias("n_words"),
        F.expr(r"cast(char_length(translate(text, ' \t\n\u000b\u000c\r', '')) as bigint)").alias("word_chars"),
        F.expr("cast(char_length(text) - char_length(translate(text, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr(
            "aggregate(transform(p, (x, k) -> case when k = size(p) - 1 then 3 else least(3, p[k + 1] - x) end), 0L, (a, b) -> a + b)"
        ).alias("n_repeat_words"),
    )


def line_rows(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """One row per line with a word: host, hash of the normalised line, words in it."""
    d = docs.select("doc_id", F.col(host_col).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "host", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    d = d.withColumn("line", normalised_line(F.col("line"))).filter("line != ''")
    return d.select(
        "doc_id", "host", "text_hash", "pos", F.xxhash64("line").alias("line_hash"), F.size(F.split("line", " ")).cast("long").alias("line_words")
    )


def frequent_rows(lines: DataFrame, docs: DataFrame, max_docs: int, counted: str) -> DataFrame:
    """The rows of ``lines`` whose line more documents of the host hold than its limit, of all ``docs`` (doc_id, host,
    text_hash).

    Plan: (host, line, document) is reduced to distinct rows, then counted per (host, line) with map-side combining, so
    one line in every document of one host costs one partial row a task. Only lines above the limit are joined back.
    """
    share = F.floor(F.count_distinct(F.coalesce(F.col(counted), F.lit(-1))) * MAX_SHARE_PCT / 100)
    limit = docs.groupBy("host").agg(F.least(F.lit(max_docs), F.greatest(F.lit(LEAST_DOCS), share)).alias("most")).withColumnRenamed("host", "l_host")
    counts = lines.select("host", "line_hash", counted).distinct().groupBy("host", "line_hash").count().filter(F.col("count") > min(max_docs, LEAST_DOCS))
    frequent = counts.join(limit, F.col("host").eqNullSafe(F.col("l_host"))).filter("count > most").select(F.col("host").alias("f_host"), F.col("line_hash").alias("f_hash"))
    return lines.join(frequent, F.col("line_hash").eqNullSafe(F.col("f_hash")) & F.col("host").eqNullSafe(F.col("f_host")))


def quality_rules(
    docs: DataFrame,
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    max_lost_pct: int = MAX_LOST_PCT,
    min_words: int = MIN_WORDS,
    max_repeat_pct: int = MAX_REPEAT_PCT,
    counted: str = "doc_id",
) -> DataFrame:
    """Metrics and verdict per document; see the module text."""
    base = written(base_metrics(docs, host_col))
    hits = frequent_rows(written(line_rows(docs, host_col)), base.select("doc_id", "host", "text_hash"), max_docs, counted)
    lost = (
        hits.select("doc_id", "host", "text_hash", "pos", "line_words")
        .distinct()
        .groupBy("doc_id", "host", "text_hash")
        .agg(F.sum("line_words").alias("lost_words"))
        .select(F.col("doc_id").alias("l_doc"), F.col("host").alias("l_host"), F.col("text_hash").alias("l_text"), "lost_words")
    )
    out = base.join(
        lost,
        F.col("doc_id").eqNullSafe(F.col("l_doc")) & F.col("host").eqNullSafe(F.col("l_host")) & F.col("text_hash").eqNullSafe(F.col("l_text")),
        "left",
    ).withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    depleted = 100 * F.col("lost_words") > max_lost_pct * F.col("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept")
    )


def without_frequent_lines(docs: DataFrame, host_col: str = "source", max_docs: int = MAX_DOCS, counted: str = "doc_id") -> DataFrame:
    """``docs`` with the frequent lines taken out of their texts; all other lines stay byte for byte, in order."""
    own = docs.select("doc_id", F.col(host_col).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    gone = frequent_rows(written(line_rows(docs, host_col)), own, max_docs, counted).groupBy("host", "text_hash").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("host").alias("g_host"), F.col("text_hash").alias("g_text"), "gone")
    d = docs.select(F.struct("*").alias("all"), F.col(host_col).alias("host"), "text")
    d = d.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    d = d.join(gone, F.col("text_hash").eqNullSafe(F.col("g_text")) & F.col("host").eqNullSafe(F.col("g_host")), "left")
    d = d.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    left = F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')")
    d = d.withColumn("left", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left))
    return d.select(*[(F.col("left") if c == "text" else F.col("all")[c]).alias(c) for c in docs.columns])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
t AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM t),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, host, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm FROM l),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lw WHERE norm <> '' GROUP BY doc_id),
hl AS (SELECT host, least({MAX_DOCS}, greatest({LEAST_DOCS}, count(DISTINCT doc_id) * {MAX_SHARE_PCT} // 100)) AS most FROM d GROUP BY host),
f AS (SELECT c.host, norm FROM (SELECT host, norm, count(DISTINCT doc_id) AS n FROM lw WHERE norm <> '' GROUP BY host, norm) c JOIN hl ON c.host IS NOT DISTINCT FROM hl.host WHERE n > most),
lost AS (SELECT doc_id, sum(len(string_split(lw.norm, ' '))) AS lost_words FROM lw JOIN f ON lw.norm = f.norm AND lw.host IS NOT DISTINCT FROM f.host GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AND NOT (100 * lost_words > {MAX_LOST_PCT} * n_words) AS kept
FROM m
"""

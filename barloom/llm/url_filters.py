"""URL filters by a temporal list join. DataFrame functions only.

A list is a log of dated entries (list_name, scope, entry, dated, action): ``add`` or ``remove``. Entries of one key
become validity intervals [dated, next dated), one per ``add``; a key's history is short next to the captures, but it is
still cut at month ends so that a capture meets only the intervals alive in its own month, however long the log is.
Each capture asks at fetch time for its host, every domain that its host belongs to (the host and its parents of two labels
or more, so ``example.com`` meets ``news.example.com``) and its host with the first path segment. An ``allow`` interval
beats any block; among blocks the most specific scope names the reason.

Skew: one host may hold a third of the captures. The join is a plain equi-join with the interval as residual condition,
which adaptive execution splits; nothing is grouped by host. The entry side is broadcast only under Spark's own checked
threshold.

Defined cases: a null, empty or malformed url has no keys and is kept with reason ``none``; a null fetch time never
meets an interval; entries with null key or date are ignored; several actions of one key on one day: the last by
action name counts; repeated captures give repeated results; an empty list keeps everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

def capture_keys(captures: DataFrame) -> DataFrame:
    """id, fetched_on and an array of (scope, key) of each capture."""
    rest = F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#@]*@", ""), r"^([a-z0-9-]+(?:\.[a-z0-9-]+)+)(?::\d+)?(?:[/?#]|$)", 1)
    segment = F.regexp_extract(rest, r"^[^/?#]*/([^/?#]+)", 1)
    d = captures.select("id", "fetched_on", host.alias("host"), segment.alias("segment"))
    domain = F.expr(r"regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1)")
    return d.select(
        "id",
        "fetched_on",
        "host",
        F.expr("case when segment != '' and host != '' then concat(host, '/', segment) else '' end").alias("path"),
        F.when(domain == "", F.col("host")).otherwise(domain).alias("domain"),
    )


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of the adds, one row per month that an interval touches."""
    e = entries.filter("entry is not null and dated is not null and scope is not null and list_name is not null and action in ('add', 'remove')")
    e = e.groupBy("list_name", "scope", "entry", "dated").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list_name", "scope", "entry").orderBy("dated")
    e = e.withColumn("until", F.lead("dated").over(w)).filter("action = 'add'")
    return e


def temporal_url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(id, url, fetched_on date), entries(list_name, scope, entry, dated date, action) -> id, host, n_block,
    n_allow, reason, kept, one row per capture."""
    keys = capture_keys(captures).withColumn("row", F.monotonically_increasing_id())
    one = [F.struct(F.lit(s).alias("scope"), F.col(s).alias("entry")) for s in ("path", "host")]
    labels = F.split("host", r"\.")
    parents = F.expr("transform(sequence(1, greatest(1, size(labels) - 1)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    domains = F.transform(parents, lambda d: F.struct(F.lit("domain").alias("scope"), d.alias("entry")))
    probes = keys.withColumn("labels", labels).select("row", "fetched_on", F.explode(F.concat(F.array(*one), domains)).alias("k")).select("row", "fetched_on", F.trunc("fetched_on", "month").alias("month"), "k.scope", "k.entry").filter("entry != '' and fetched_on is not null")
    span = intervals(entries)
    last = F.coalesce(F.date_sub("until", 1), F.lit("2100-01-01").cast("date"))
    # open intervals end with the captures; the horizon is one aggregated value
    horizon = captures.agg(F.max("fetched_on")).first()[0]
    span = span.filter(F.col("dated") <= F.lit(horizon).cast("date")).withColumn("last", F.least(last, F.lit(horizon).cast("date")))
    span = span.select(
        "list_name", F.col("scope").alias("e_scope"), F.col("entry").alias("e_entry"), "dated", "until",
        F.explode(F.sequence(F.trunc("dated", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))).alias("e_month"),
    )
    hit = probes.join(
        span,
        (F.col("entry") == F.col("e_entry")) & (F.col("scope") == F.col("e_scope")) & (F.col("month") == F.col("e_month"))
        & (F.col("dated") <= F.col("fetched_on")) & (F.col("until").isNull() | (F.col("fetched_on") < F.col("until"))),
    )
    allow = F.col("list_name") == "allow"
    rank = F.expr("case scope when 'path' then 1 when 'host' then 2 else 3 end")
    verdict = hit.groupBy("row").agg(
        F.count_if(~allow).alias("n_block"), F.count_if(allow).alias("n_allow"),
        F.min(F.when(~allow, F.struct(rank.alias("r"), F.col("list_name"), F.col("scope")))).alias("b"),
    )
    out = keys.join(verdict, "row", "left")
    n_block, n_allow = (F.coalesce(c, F.lit(0)).cast("long") for c in ("n_block", "n_allow"))
    return out.select(
        "id", "host", n_block.alias("n_block"), n_allow.alias("n_allow"),
        F.when(n_block == 0, "none").otherwise(F.concat_ws(":", "b.list_name", "b.scope")).alias("reason"),
        ((n_block == 0) | (n_allow > 0)).alias("kept"),
    )


def byte_of(column, k: int):
    """The k-th pair of md5 bytes as 0..65535: a rule that Spark and SQL share."""
    return F.conv(F.substring(F.md5(column), 4 * k + 1, 4), 16, 10).cast("int")


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, by rule: the tables hold no list.

    Of the hosts (md5 rule), 3 in 8 are added to ``abuse`` on day a of 2024 and removed 30 to 129 days later, a third of
    these added again 45 days after that; 1 in 8 domains are on ``adult`` from day b on; 1 in 4 host and first-segment
    pairs are on ``spam`` for 60 days; 1 in 8 hosts are on ``allow`` from day c on.
    """
    k = capture_keys(pages.select(F.col("page_id").alias("id"), "url", F.lit(None).cast("date").alias("fetched_on")))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    host = k.select(F.col("host").alias("entry")).filter("entry != ''").distinct().withColumns({"x": byte_of(F.col("entry"), 0), "y": byte_of(F.col("entry"), 1), "z": byte_of(F.col("entry"), 2)})
    domain = k.select(F.col("domain").alias("entry")).filter("entry != ''").distinct().withColumns({"x": byte_of(F.col("entry"), 3), "y": byte_of(F.col("entry"), 4)})
    path = k.select(F.col("path").alias("entry")).filter("entry != ''").distinct().withColumns({"x": byte_of(F.col("entry"), 5), "y": byte_of(F.col("entry"), 6)})

    def rows(d, list_name, scope, cond, dated, action):
        return d.filter(cond).select(F.lit(list_name).alias("list_name"), F.lit(scope).alias("scope"), "entry", day(F.expr(dated).cast("int")).alias("dated"), F.lit(action).alias("action"))

    parts = [
        rows(host, "abuse", "host", "x % 8 < 3", "y % 300", "add"),
        rows(host, "abuse", "host", "x % 8 < 3", "y % 300 + 30 + z % 100", "remove"),
        rows(host, "abuse", "host", "x % 8 < 3 and z % 3 = 0", "y % 300 + 75 + z % 100", "add"),
        rows(domain, "adult", "domain", "x % 8 = 1", "y % 366", "add"),
        rows(path, "spam", "path", "x % 4 = 0", "y % 300", "add"),
        rows(path, "spam", "path", "x % 4 = 0", "y % 300 + 60", "remove"),
        rows(host, "allow", "host", "x % 8 = 2", "z % 366", "add"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page as a capture; fetch day by rule (day page_id mod 366 of 2024), as pages hold no fetch time."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select(F.col("page_id").alias("id"), "url", F.date_add(F.lit("2024-01-01").cast("date"), F.expr("cast(pmod(page_id, 366) as int)")).alias("fetched_on"))
    return temporal_url_filter(captures, dated_entries(pages)).withColumnRenamed("id", "page_id")


_B = "('0x' || substr(md5(entry), {0}, 4))::INT"
ORACLE = rf"""
WITH r AS (SELECT page_id, DATE '2024-01-01' + (page_id % 366)::INT AS f, regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://', '') AS rest FROM pages),
k0 AS (SELECT page_id, f, regexp_extract(regexp_replace(rest, '^[^/?#@]*@', ''), '^([a-z0-9-]+(?:\.[a-z0-9-]+)+)(?::\d+)?(?:[/?#]|$)', 1) AS host, regexp_extract(rest, '^[^/?#]*/([^/?#]+)', 1) AS seg FROM r),
k AS (SELECT page_id, f, host, CASE WHEN seg <> '' AND host <> '' THEN host || '/' || seg ELSE '' END AS path,
  CASE WHEN regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) END AS domain FROM k0),
h AS (SELECT entry, {_B.format(1)} AS x, {_B.format(5)} AS y, {_B.format(9)} AS z FROM (SELECT DISTINCT host AS entry FROM k WHERE host <> '')),
d AS (SELECT entry, {_B.format(13)} AS x, {_B.format(17)} AS y FROM (SELECT DISTINCT domain AS entry FROM k WHERE domain <> '')),
p AS (SELECT entry, {_B.format(21)} AS x, {_B.format(25)} AS y FROM (SELECT DISTINCT path AS entry FROM k WHERE path <> '')),
e AS (SELECT 'abuse' AS l, 'host' AS s, entry, y % 300 AS n, 'add' AS a FROM h WHERE x % 8 < 3
  UNION ALL SELECT 'abuse', 'host', entry, y % 300 + 30 + z % 100, 'remove' FROM h WHERE x % 8 < 3
  UNION ALL SELECT 'abuse', 'host', entry, y % 300 + 75 + z % 100, 'add' FROM h WHERE x % 8 < 3 AND z % 3 = 0
  UNION ALL SELECT 'adult', 'domain', entry, y % 366, 'add' FROM d WHERE x % 8 = 1
  UNION ALL SELECT 'spam', 'path', entry, y % 300, 'add' FROM p WHERE x % 4 = 0
  UNION ALL SELECT 'spam', 'path', entry, y % 300 + 60, 'remove' FROM p WHERE x % 4 = 0
  UNION ALL SELECT 'allow', 'host', entry, z % 366, 'add' FROM h WHERE x % 8 = 2),
v AS (SELECT * FROM (SELECT l, s, entry, DATE '2024-01-01' + n::INT AS since, lead(DATE '2024-01-01' + n::INT) OVER (PARTITION BY l, s, entry ORDER BY n) AS til, a FROM e) WHERE a = 'add'),
q AS (SELECT page_id, f, 'path' AS s, path AS entry, 1 AS r FROM k UNION ALL SELECT page_id, f, 'host', host, 2 FROM k
  UNION ALL SELECT page_id, f, 'domain', unnest(list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.'))), 3 FROM k),
g AS (SELECT page_id, count(*) FILTER (WHERE l <> 'allow') AS n_block, count(*) FILTER (WHERE l = 'allow') AS n_allow, min(q.r || l || ':' || q.s) FILTER (WHERE l <> 'allow') AS b
  FROM q JOIN v ON q.s = v.s AND q.entry = v.entry AND v.since <= f AND (til IS NULL OR f < til) GROUP BY page_id)
SELECT page_id, host, coalesce(n_block, 0) AS n_block, coalesce(n_allow, 0) AS n_allow, CASE WHEN coalesce(n_block, 0) = 0 THEN 'none' ELSE substr(b, 2) END AS reason,
  coalesce(n_block, 0) = 0 OR coalesce(n_allow, 0) > 0 AS kept FROM k LEFT JOIN g USING (page_id)
"""

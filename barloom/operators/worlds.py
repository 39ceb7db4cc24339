"""Control worlds and resampling: shapes of bars, permuted and planted worlds, block bootstrap, buy and hold.

Randomness is a rule: an order or a start comes from the md5 of a seed and an index, so a world is the same on any cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import BASE, ln, ordered, quotient
from .bars import h1_of
from .stats import RET, daily_returns

SEED, RESAMPLES, BLOCK, DRIFT, HORIZON = "world-1", 50, 20, 0.001, 6


def shuffled(*columns):
    """A pseudo-random key of a row."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *columns))


def shapes(bars: DataFrame) -> DataFrame:
    """Logarithms of each bar against its open, and of its open against the close before (0 at the start). That of a zero price is
    minus infinity."""
    gap = F.coalesce(ln(quotient(F.col("open"), F.lag("close").over(ordered()))), F.lit(0.0))
    return bars.select("symbol", "bar_idx", gap.alias("gap"), *[ln(quotient(F.col(c), F.col("open"))).alias(c[0]) for c in ("high", "low", "close")], F.first("open").over(ordered()).alias("o0"))


def permuted(s: DataFrame) -> DataFrame:
    """Every symbol's shapes in a random order; places keep their bar_idx."""
    w = Window.partitionBy("symbol").orderBy(shuffled("symbol", F.col("bar_idx").cast("string")))
    return s.withColumn("source_idx", F.col("bar_idx")).withColumn("bar_idx", (F.row_number().over(w) - 1).cast("long"))


def day_blocks(days: DataFrame) -> DataFrame:
    """(day, source_day): a random order of the days of each month, the same for all symbols."""
    month = F.trunc("day", "month")
    place = Window.partitionBy(month)
    a = days.select("day", month.alias("m"), F.row_number().over(place.orderBy("day")).alias("k"))
    b = days.select(F.col("day").alias("source_day"), month.alias("m"), F.row_number().over(place.orderBy(shuffled(F.col("day").cast("string")))).alias("k"))
    return a.join(b, ["m", "k"]).select("day", "source_day")


def rebuilt_logs(s: DataFrame) -> DataFrame:
    """Logarithms of prices from shapes: the open is the first open times everything gained before and the bar's own gap."""
    before = ordered().rowsBetween(Window.unboundedPreceding, -1)
    gained = F.coalesce(F.sum(F.col("gap") + F.col("c")).over(before), F.lit(0.0))
    s = s.withColumn("open", ln(F.col("o0")) + gained + F.col("gap"))
    high, low = F.greatest("h", "c", F.lit(0.0)), F.least("l", "c", F.lit(0.0))
    return s.select("symbol", "bar_idx", "open", (F.col("open") + high).alias("high"), (F.col("open") + low).alias("low"), (F.col("open") + F.col("c")).alias("close"))


def rebuilt(s: DataFrame) -> DataFrame:
    """Prices from shapes."""
    return rebuilt_logs(s).withColumns({c: F.exp(c) for c in ("open", "high", "low", "close")})


def planted(s: DataFrame, trigger: str, drift: float = DRIFT, horizon: int = HORIZON) -> DataFrame:
    """Drift on the close of each bar that follows a trigger within ``horizon`` bars, taken back evenly from the others."""
    on = F.coalesce(F.max(F.col(trigger).cast("int")).over(ordered().rowsBetween(-horizon, -1)), F.lit(0))
    s = s.withColumn("on", on)
    total = Window.partitionBy("symbol")
    back = F.try_divide(drift * F.sum("on").over(total), F.sum(1 - F.col("on")).over(total))
    return s.withColumn("c", F.col("c") + F.when(F.col("on") == 1, F.lit(drift)).otherwise(-back))


def edged(s: DataFrame, trigger: str, gross: float, horizon: int = HORIZON) -> DataFrame:
    """Each bar that follows a trigger within ``horizon`` bars gains gross / horizon of its open in prices, uncompensated. s: shapes with
    the bars' open."""
    on = F.coalesce(F.max(F.col(trigger).cast("int")).over(ordered().rowsBetween(-horizon, -1)), F.lit(0))
    return s.withColumn("c", F.col("c") + F.when(on == 1, F.log1p(quotient(F.lit(gross / horizon), F.col("open")))).otherwise(0.0))


def persistent(s: DataFrame, phi: float) -> DataFrame:
    """Shapes whose moves (gap and body) follow a first-order autoregression: the move of a bar gains phi times the whole move of
    the bar before. Whole moves are sums of phi^i times the moves i bars back, so it is one window; terms below 1e-18 are left
    out."""
    if not 0 < abs(phi) < 1:
        raise ValueError("phi must lie between -1 and 1, without 0")
    terms = math.ceil(math.log(1e-18) / math.log(abs(phi)))
    move = F.col("gap") + F.col("c")
    gained = sum((phi**i * F.coalesce(F.lag(move, i).over(ordered()), F.lit(0.0)) for i in range(2, terms + 1)), phi * F.coalesce(F.lag(move, 1).over(ordered()), F.lit(0.0)))
    return s.withColumn("c", F.col("c") + gained)


def block_bootstrap(d: DataFrame, by: str = "symbol", order: str = "day", x: str = "ret", resamples: int = RESAMPLES, block: int = BLOCK) -> DataFrame:
    """Mean and sample deviation of each resample (by, r, mean, sd): circular blocks whose starts come from the seed. Starts are joined to rows by place, so a
    resample costs its own length and nothing is gathered."""
    rows = d.select(by, F.col(x).alias("x"), (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).alias("i"))
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return block_picks(n, [by], resamples, block).join(rows, [by, "i"]).groupBy(by, "r").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))


def block_picks(n: DataFrame, by: list[str], resamples: int, block: int) -> DataFrame:
    """by, r, i: places of each resample by circular blocks, from the lengths n of series. Starts come from the seed, the resample and
    the block alone, so series of one length share them."""
    starts = n.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("b", F.explode(F.expr(f"sequence(0, cast((n - 1) div {block} as int))")))
    at = F.conv(F.substring(shuffled(F.col("r").cast("string"), F.col("b").cast("string")), 1, 7), 16, 10).cast("long") % F.col("n")
    picks = starts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).filter(F.col("b") * block + F.col("k") < F.col("n"))
    return picks.select(*by, "r", ((at + F.col("k")) % F.col("n")).alias("i"))


def world_permuted(spark, sf_dir: str) -> DataFrame:
    d = rebuilt_logs(permuted(shapes(h1_of(spark, sf_dir))))
    return d.select("symbol", "bar_idx", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")])


def world_planted(spark, sf_dir: str) -> DataFrame:
    s = shapes(h1_of(spark, sf_dir)).withColumn("fires", F.col("c") > 0.5)
    d = planted(s, "fires")
    return d.select("symbol", "bar_idx", "on", F.round("c", 6).alias("c"))


def world_day_blocks(spark, sf_dir: str) -> DataFrame:
    return day_blocks(daily_returns(spark, sf_dir).select("day").distinct())


def bootstrap_means(spark, sf_dir: str) -> DataFrame:
    m = block_bootstrap(daily_returns(spark, sf_dir))
    return m.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.stddev_samp("mean"), 6).alias("se"), F.round(F.expr("percentile(mean, 0.025)"), 6).alias("lo"), F.round(F.expr("percentile(mean, 0.975)"), 6).alias("hi"))


def buy_and_hold(spark, sf_dir: str, cost: float = 0.002) -> DataFrame:
    """Return of each symbol and year from its first to its last price, after costs."""
    d = daily_returns(spark, sf_dir).groupBy("symbol", F.year("day").alias("year"))
    d = d.agg(F.min_by("close", "day").alias("a"), F.max_by("close", "day").alias("b"), F.count("*").alias("n"))
    return d.select("symbol", "year", "n", F.round(F.col("b") / F.col("a") - 1 - cost, 6).alias("ret"))


PHI, GROSS = 0.3, 2.0


def world_persistent(spark, sf_dir: str) -> DataFrame:
    """The permuted world with first-order persistence."""
    return persistent(permuted(shapes(h1_of(spark, sf_dir))), PHI).select("symbol", "bar_idx", F.round("c", 6).alias("c"))


def world_edged(spark, sf_dir: str) -> DataFrame:
    bars = h1_of(spark, sf_dir)
    s = shapes(bars).join(bars.select("symbol", "bar_idx", "open"), ["symbol", "bar_idx"]).withColumn("fires", F.col("c") > 0.5)
    return edged(s, "fires", GROSS).select("symbol", "bar_idx", F.round("c", 6).alias("c"))


QUERIES = {f.__name__: f for f in (world_permuted, world_planted, world_persistent, world_edged, world_day_blocks, bootstrap_means, buy_and_hold)}

_S = BASE.replace("RECURSIVE ", "") + """, s AS (SELECT symbol, bar_idx, coalesce(ln(open / lag(close) OVER w), 0) AS gap, ln(high / open) AS h, ln(low / open) AS l, ln(close / open) AS c, first_value(open) OVER w AS o0 FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))"""
ORACLE = {
    "world_permuted": f"""{_S}, p AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY md5('{SEED}|' || symbol || '|' || bar_idx)) - 1 AS bar_idx, gap, h, l, c, o0 FROM s),
o AS (SELECT *, ln(o0) + coalesce(sum(gap + c) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap AS lo FROM p)
SELECT symbol, bar_idx, round(lo, 6) AS open, round(lo + greatest(h, c, 0), 6) AS high, round(lo + least(l, c, 0), 6) AS low, round(lo + c, 6) AS close FROM o""",
    "world_planted": f"""{_S}, tr AS (SELECT *, coalesce(max((c > 0.5)::INT) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {HORIZON} PRECEDING AND 1 PRECEDING), 0) AS "on" FROM s)
SELECT symbol, bar_idx, "on", round(c + CASE WHEN "on" = 1 THEN {DRIFT} ELSE -{DRIFT} * sum("on") OVER (PARTITION BY symbol) / sum(1 - "on") OVER (PARTITION BY symbol) END, 6) AS c FROM tr""",
    "world_persistent": f"""{_S}, p AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY md5('{SEED}|' || symbol || '|' || bar_idx)) - 1 AS bar_idx, gap, c FROM s),
w AS (SELECT symbol, bar_idx, c, gap + c AS whole FROM p WHERE bar_idx = 0 UNION ALL SELECT p.symbol, p.bar_idx, p.c + {PHI} * w.whole, p.gap + p.c + {PHI} * w.whole FROM w JOIN p ON p.symbol = w.symbol AND p.bar_idx = w.bar_idx + 1)
SELECT symbol, bar_idx, round(c, 6) AS c FROM w""".replace("WITH ", "WITH RECURSIVE ", 1),
    "world_edged": f"""{_S}, tr AS (SELECT s.*, b.open, coalesce(max((s.c > 0.5)::INT) OVER (PARTITION BY s.symbol ORDER BY s.bar_idx ROWS BETWEEN {HORIZON} PRECEDING AND 1 PRECEDING), 0) AS near FROM s JOIN b USING (symbol, bar_idx))
SELECT symbol, bar_idx, round(c + CASE WHEN near = 1 THEN ln(1 + {GROSS} / {HORIZON} / open) ELSE 0 END, 6) AS c FROM tr""",
    "world_day_blocks": f"""{RET}, d2 AS (SELECT DISTINCT day, date_trunc('month', day) AS m FROM r), a AS (SELECT day, m, row_number() OVER (PARTITION BY m ORDER BY day) AS k FROM d2),
b AS (SELECT day AS source_day, m, row_number() OVER (PARTITION BY m ORDER BY md5('{SEED}|' || day)) AS k FROM d2) SELECT day, source_day FROM a JOIN b USING (m, k)""",
    "bootstrap_means": f"""{RET}, x AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r),
g AS (SELECT symbol, n, rr AS r, u // {BLOCK} AS b, u % {BLOCK} AS k FROM (SELECT DISTINCT symbol, n FROM x), range({RESAMPLES}) q(rr), LATERAL (SELECT unnest(range(n)) AS u)),
p AS (SELECT symbol, r, (('0x' || substr(md5('{SEED}|' || r || '|' || b), 1, 7))::BIGINT % n + k) % n AS i FROM g),
m AS (SELECT symbol, r, avg(ret) AS mean FROM p JOIN x USING (symbol, i) GROUP BY 1, 2)
SELECT symbol, count(*) AS n, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS se, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM m GROUP BY symbol""",
    "buy_and_hold": f"{RET} SELECT symbol, year(day) AS year, count(*) AS n, round(last(close ORDER BY day) / first(close ORDER BY day) - 1 - 0.002, 6) AS ret FROM r GROUP BY 1, 2",
}

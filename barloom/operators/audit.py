"""Data-quality queries on tapes and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import BASE, ordered, quotient
from ..sources.tapes import ticks
from .bars import bucket, frame_bars, frame_sql, h1_of, m15_of
from .stats import RET, daily_returns

BIG_GAP, SIGMAS = 4, 3.0
#: Arrival numbers of a block.
BLOCK = 1 << 20


def tape_faults(tape: DataFrame) -> DataFrame:
    """Per symbol: rows, steps back in arrival order, repeated times, identical rows, missing or non-positive prices.

    Raw ticks are ordered inside blocks of arrival numbers only, so a busy symbol spreads; the blocks' first and last
    times are then compared across borders.
    """
    block = Window.partitionBy("symbol", "block").orderBy("seq")
    d = tape.withColumn("block", F.floor(F.col("seq") / BLOCK)).withColumn("before", F.lag("ts").over(block))
    blocks = d.groupBy("symbol", "block").agg(
        F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("before")).alias("back"), F.count_if(F.col("price").isNull() | (F.col("price") <= 0)).alias("bad"),
        F.min_by("ts", "seq").alias("first"), F.max_by("ts", "seq").alias("last"),
    )
    border = F.coalesce(F.col("first") < F.lag("last").over(Window.partitionBy("symbol").orderBy("block")), F.lit(False)).cast("long")
    rows = blocks.withColumn("back", F.col("back") + border).groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("back").alias("steps_back"), F.sum("bad").alias("bad_prices"))
    same = tape.groupBy("symbol", "ts").agg((F.count("*") - 1).alias("extra"), (F.count("*") - F.count_distinct("price", "volume")).alias("identical"))
    same = same.groupBy("symbol").agg(F.sum("extra").alias("repeated_times"), F.sum("identical").alias("identical_rows"))
    return rows.join(same, "symbol")


def gaps(bars: DataFrame) -> DataFrame:
    """Holes between bars: symbol, from the end of one bar to the start of the next, hours."""
    d = bars.withColumn("gap_start", F.lag("available").over(ordered())).filter(F.col("bucket") > F.col("gap_start"))
    return d.select("symbol", "gap_start", F.col("bucket").alias("gap_end"), F.expr("cast(timestampdiff(hour, gap_start, bucket) as long)").alias("hours"))


def audit_tape(spark, sf_dir: str) -> DataFrame:
    return tape_faults(ticks(spark, sf_dir))


def audit_weekdays(spark, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol", (F.dayofweek("ts") - 1).alias("weekday")).agg(F.count("*").alias("n"))


def audit_gap_sizes(spark, sf_dir: str) -> DataFrame:
    g = gaps(h1_of(spark, sf_dir))
    size = F.when(F.col("hours") == 1, "1").when(F.col("hours") <= 2, "2").when(F.col("hours") <= BIG_GAP, "3-4").otherwise("5+")
    return g.groupBy("symbol", size.alias("size")).agg(F.count("*").alias("n"), F.max("hours").alias("longest"))


def audit_shared_gaps(spark, sf_dir: str) -> DataFrame:
    """Gaps with the same bounds in several symbols."""
    g = gaps(h1_of(spark, sf_dir)).groupBy("gap_start", "gap_end").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))
    return g.filter("n > 1")


def audit_frozen(spark, sf_dir: str) -> DataFrame:
    """Runs of hours in which nothing but one price traded."""
    flat = F.when((F.col("high") == F.col("low")), 1).otherwise(0)
    d = h1_of(spark, sf_dir).withColumn("flat", flat)
    d = d.withColumn("run", F.sum(1 - F.col("flat")).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    return d.filter("flat = 1").groupBy("symbol", "run").agg(F.min("bar_idx").alias("start"), F.count("*").alias("length")).drop("run")


def audit_spikes(spark, sf_dir: str) -> DataFrame:
    """Hourly moves of more than so many deviations, and whether most of it came back on the next bar."""
    d = h1_of(spark, sf_dir).withColumn("move", F.log(F.col("close") / F.lag("close").over(ordered()))).withColumn("back", F.lead("move").over(ordered()))
    d = d.withColumn("sd", F.stddev_pop("move").over(Window.partitionBy("symbol")))
    return d.filter(F.abs("move") > SIGMAS * F.col("sd")).select("symbol", "bar_idx", F.round("move", 6).alias("move"), F.coalesce(F.col("move") * F.col("back") < -0.5 * F.col("move") ** 2, F.lit(False)).alias("reverts"))


def audit_wicks(spark, sf_dir: str) -> DataFrame:
    """Isolated highs and lows: far beyond the bar's own body and both neighbours' extremes; missing neighbours don't count.
    A zero price is divided by as SQL does: more than nothing is infinitely far from it, zero by zero is NaN, which is above all."""
    lag, lead = (lambda c: F.lag(c).over(ordered())), (lambda c: F.lead(c).over(ordered()))
    d = h1_of(spark, sf_dir).withColumns({"above": F.greatest(lag("high"), lead("high")), "below": F.least(lag("low"), lead("low"))})
    up = (quotient(F.col("high"), F.greatest("open", "close")) - 1 > 0.5) & (quotient(F.col("high"), F.col("above")) - 1 > 0.2)
    down = (1 - quotient(F.col("low"), F.least("open", "close")) > 0.5) & (1 - quotient(F.col("low"), F.col("below")) > 0.2)
    side = lambda c, name, px: F.when(c, F.struct(F.lit(name).alias("side"), F.round(px, 6).alias("price")))
    d = d.select("symbol", "bar_idx", F.explode(F.array(side(up, "high", "high"), side(down, "low", "low"))).alias("w"))
    return d.filter("w is not null").select("symbol", "bar_idx", "w.side", "w.price")


def audit_reaggregation(spark, sf_dir: str) -> DataFrame:
    """4-hour bars from 15-minute bars against those from hourly bars: bars, and how many differ in any price or volume."""
    m15 = m15_of(spark, sf_dir)
    columns = ["open", "high", "low", "close", "volume", "n_m15"]
    direct = frame_bars(m15, "h4").select("symbol", "bucket", F.struct(*columns).alias("direct"))
    order = F.col("bucket")
    h1 = frame_bars(m15, "h1").withColumn("h4", bucket(F.col("bucket"), "h4")).groupBy("symbol", "h4").agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume").alias("volume"), F.sum("n_m15").alias("n_m15")
    )
    both = direct.join(h1.select("symbol", F.col("h4").alias("bucket"), F.struct(*columns).alias("stepped")), ["symbol", "bucket"], "full")
    return both.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(~F.col("direct").eqNullSafe(F.col("stepped"))).alias("differ"))


def yearly_deviation(returns: DataFrame, symbols: dict[str, str]) -> DataFrame:
    """Deviation of the returns per year, a column per symbol. symbols: value to column; naming them spares a pass for the pivot's values."""
    r = returns.groupBy(F.year("day").alias("year")).pivot("symbol", list(symbols)).agg(F.round(F.stddev_pop("ret"), 6))
    return r.toDF("year", *symbols.values())


def audit_yearly(spark, sf_dir: str) -> DataFrame:
    """Volatility per year, a column per priority of the orders' tape."""
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
    return yearly_deviation(daily_returns(spark, sf_dir), names)


def audit_correlation(spark, sf_dir: str) -> DataFrame:
    r = daily_returns(spark, sf_dir).withColumn("year", F.year("day"))
    a, b = r.select("day", "year", F.col("symbol").alias("a"), F.col("ret").alias("x")), r.select("day", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    return a.join(b, "day").filter("a < b").groupBy("year", "a", "b").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("rho"))


QUERIES = {f.__name__: f for f in (audit_tape, audit_weekdays, audit_gap_sizes, audit_shared_gaps, audit_frozen, audit_spikes, audit_wicks, audit_reaggregation, audit_yearly, audit_correlation)}

_B = BASE.replace("RECURSIVE ", "")
_G = f"{_B}, g AS (SELECT * FROM (SELECT symbol, lag(available) OVER (PARTITION BY symbol ORDER BY bar_idx) AS gap_start, bucket AS gap_end FROM b) WHERE gap_end > gap_start), h AS (SELECT *, date_diff('hour', gap_start, gap_end) AS hours FROM g)"
ORACLE = {
    "audit_tape": """WITH t AS (SELECT event_type AS symbol, ts, value AS price, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events),
s AS (SELECT symbol, sum(n - 1)::BIGINT AS repeated_times, sum(n - d)::BIGINT AS identical_rows FROM (SELECT symbol, ts, count(*) AS n, count(DISTINCT price) AS d FROM t GROUP BY 1, 2) GROUP BY symbol)
SELECT symbol, count(*) AS n, count(*) FILTER (WHERE ts < before) AS steps_back, count(*) FILTER (WHERE price IS NULL OR price <= 0) AS bad_prices, any_value(repeated_times) AS repeated_times, any_value(identical_rows) AS identical_rows FROM t JOIN s USING (symbol) GROUP BY symbol""",
    "audit_weekdays": "SELECT event_type AS symbol, dayofweek(ts)::INT AS weekday, count(*) AS n FROM events GROUP BY 1, 2",
    "audit_gap_sizes": f"{_G} SELECT symbol, CASE WHEN hours = 1 THEN '1' WHEN hours <= 2 THEN '2' WHEN hours <= 4 THEN '3-4' ELSE '5+' END AS size, count(*) AS n, max(hours) AS longest FROM h GROUP BY 1, 2",
    "audit_shared_gaps": f"{_G} SELECT gap_start, gap_end, count(*) AS n, string_agg(symbol, ',' ORDER BY symbol) AS symbols FROM h GROUP BY 1, 2 HAVING count(*) > 1",
    "audit_frozen": f"{_B}, f AS (SELECT *, bar_idx - row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) AS run FROM b WHERE high = low) SELECT symbol, min(bar_idx) AS start, count(*) AS length FROM f GROUP BY symbol, run",
    "audit_spikes": f"""{_B}, m AS (SELECT symbol, bar_idx, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx)) AS move FROM b), n AS (SELECT *, lead(move) OVER (PARTITION BY symbol ORDER BY bar_idx) AS back, stddev_pop(move) OVER (PARTITION BY symbol) AS sd FROM m)
SELECT symbol, bar_idx, round(move, 6) AS move, coalesce(move * back < -0.5 * move ** 2, false) AS reverts FROM n WHERE abs(move) > {SIGMAS} * sd""",
    "audit_wicks": f"""{_B}, n AS (SELECT *, greatest(lag(high) OVER w, lead(high) OVER w) AS above, least(lag(low) OVER w, lead(low) OVER w) AS below FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))
SELECT symbol, bar_idx, 'high' AS side, round(high, 6) AS price FROM n WHERE high / greatest(open, close) - 1 > 0.5 AND high / above - 1 > 0.2
UNION ALL SELECT symbol, bar_idx, 'low', round(low, 6) FROM n WHERE 1 - low / least(open, close) > 0.5 AND 1 - low / below > 0.2""",
    "audit_reaggregation": f"""{_B}, {frame_sql("h4", "h")}, s AS (SELECT symbol, time_bucket(INTERVAL '4 hours', bucket) AS bucket, first(open ORDER BY bucket) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bucket) AS close, sum(volume) AS volume, sum(n_m15) AS n_m15 FROM b GROUP BY 1, 2)
SELECT symbol, count(*) AS n, count(*) FILTER (WHERE (h.open, h.high, h.low, h.close, h.volume, h.n_m15) IS DISTINCT FROM (s.open, s.high, s.low, s.close, s.volume, s.n_m15)) AS differ FROM h FULL JOIN s USING (symbol, bucket) GROUP BY symbol""",
    "audit_yearly": f"{RET} SELECT year(day) AS year, " + ", ".join(f"round(stddev_pop(ret) FILTER (WHERE symbol = '{s}'), 6) AS {n}" for s, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("4-NOT SPECIFIED", "unspecified"), ("5-LOW", "low"))) + " FROM r GROUP BY 1",
    "audit_correlation": f"{RET} SELECT year(day) AS year, a.symbol AS a, b.symbol AS b, count(*) AS n, round(corr(a.ret, b.ret), 6) AS rho FROM r a JOIN r b USING (day) WHERE a.symbol < b.symbol GROUP BY 1, 2, 3",
}

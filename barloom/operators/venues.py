"""Markets with costs by liquidity and scheduled funding.

Costs: a bar's relative round trip is twice the taker fee plus the slippage of the band that the symbol's trailing median of
daily traded value falls into, as of the day before; below the lowest band nothing may be traded. Funding: an event is paid at
the open of the execution bar that starts with it; before a symbol's first event a mean rate is paid by both sides at
every scheduled hour; events that no bar starts with are counted, not applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import ATR_SQL, BASE
from ..plans.storage import written
from ..sources.tapes import funding
from .bars import FRAMES, frame_bars, frame_sql, m15_of
from .trades import BREAKOUTS_SQL, EXECS_SQL, PER, SPECS, Rules, breakouts, chained, execution_bars, followed_sql, metrics, outcomes, paths, spec_signals, with_ratios

FEE, HOURS = 0.0005, (0, 8, 16)
#: Lowest median value of a band, in the tape's mean daily value, and its slippage a side.
BANDS, DAYS, SHARE = ((0.9, 0.002), (0.98, 0.001), (1.02, 0.0005)), 5, 4
RULES = Rules(funding_mult=2.0, max_lev=1.0)


def traded_value(m15: DataFrame) -> DataFrame:
    """symbol, day, usd: value traded by UTC day, at the mean of each bar's four prices."""
    price = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    return m15.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum(F.col("volume") * price).alias("usd"))


def trailing_median(value: DataFrame, days: int) -> DataFrame:
    """symbol, day, median of the ``days`` days with trades before it; null until there are so many."""
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-days, -1)
    return value.select("symbol", "day", F.when(F.count("usd").over(w) == days, F.expr("percentile(usd, 0.5)").over(w)).alias("median"))


def slippage(median, bands=BANDS):
    """Slippage a side of the highest band that the median reaches; null below all, and without a median."""
    out = F.lit(None).cast("double")
    for least, slip in sorted(bands):
        out = F.when(median >= least, F.lit(slip)).otherwise(out)
    return out


def banded(bars: DataFrame, medians: DataFrame, bands=BANDS, fee: float = FEE, least: float | None = None) -> DataFrame:
    """``bars`` (with atr) with median, slip, cost_rel and tradable: complete, in a band, with a median of ``least`` or more (the
    lowest band, if not given) and an ATR above 0."""
    least = min(b for b, _ in bands) if least is None else least
    d = bars.withColumn("day", F.to_date("bucket")).join(medians, ["symbol", "day"], "left").drop("day").withColumn("slip", slippage(F.col("median"), bands))
    tradable = F.col("complete") & (F.col("median") >= least) & (F.col("atr") > 0) & F.col("slip").isNotNull()
    return d.withColumns({"cost_rel": 2 * (fee + F.coalesce("slip", F.lit(0.0))), "tradable": F.coalesce(tradable, F.lit(False))})


def mean_rate(rates: DataFrame, days: int) -> DataFrame:
    """symbol, mean_abs: mean size of the rates of the first ``days`` days from each symbol's first event."""
    first = F.min("ts").over(Window.partitionBy("symbol"))
    near = rates.withColumn("first", first).filter(F.col("ts") < F.col("first") + F.make_dt_interval(days=F.lit(days)))
    return near.groupBy("symbol").agg(F.avg(F.abs("rate")).alias("mean_abs"))


def funded(execs: DataFrame, times: DataFrame, rates: DataFrame, means: DataFrame, hours=HOURS) -> DataFrame:
    """``execs`` with rate (of an event at the bar's open) and rate_abs (the mean, at scheduled hours before the symbol's first
    event; symbols without events are charged throughout). times: symbol, exec_idx, ts. rates: symbol, ts, rate."""
    first = rates.groupBy("symbol").agg(F.min("ts").alias("first_event"))
    d = execs.drop("rate").join(times, ["symbol", "exec_idx"]).join(rates, ["symbol", "ts"], "left").join(first, "symbol", "left").join(means, "symbol", "left")
    scheduled = F.hour("ts").isin(*hours) & (F.minute("ts") == 0) & (F.second("ts") == 0)
    before = F.col("first_event").isNull() | (F.col("ts") < F.col("first_event"))
    rate_abs = F.when(scheduled & before, F.coalesce("mean_abs", F.lit(0.0))).otherwise(0.0)
    return d.withColumns({"rate": F.coalesce("rate", F.lit(0.0)), "rate_abs": rate_abs}).drop("first_event", "mean_abs")


def unplaced(times: DataFrame, rates: DataFrame) -> DataFrame:
    """Events inside a symbol's tape that no bar starts with: symbol, ts, rate."""
    span = times.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    inside = rates.join(span, "symbol").filter("ts >= lo and ts <= hi").drop("lo", "hi")
    return inside.join(times.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def signal_bar_execution(bars: DataFrame, frame: str) -> DataFrame:
    """Execution on the signal bars themselves. Daily bars are refused: events fall inside them, never on their opens only."""
    if frame == "d1":
        raise ValueError("funding falls inside daily bars: execute them on 15-minute bars")
    return bars.select("symbol", F.col("bar_idx").alias("exec_idx"), "bar_idx", F.lit(True).alias("is_last"), F.lit(0.0).alias("rate"), "open", "high", "low", "close", "day_id")


def _listed(spark, sf_dir: str) -> DataFrame:
    """Rates at their hours; events of the tape's first eight days stand for the time before a listing and are left out."""
    r = funding(spark, sf_dir).select("symbol", F.col("bucket").alias("ts"), "rate")
    return r.filter(F.col("ts") >= F.lit("2024-01-09").cast("timestamp_ntz"))


def _market(spark, sf_dir: str):
    """Bars of 4 hours with bands, execution bars of 15 minutes with funding, times and rates."""
    m15 = written(m15_of(spark, sf_dir))
    value = traded_value(m15)
    unit = value.agg(F.avg("usd").alias("unit"))
    medians = trailing_median(value.crossJoin(F.broadcast(unit)).select("symbol", "day", (F.col("usd") / F.col("unit")).alias("usd")), DAYS)  # one row
    bars = breakouts(frame_bars(m15, "h4").withColumn("complete", F.col("n_m15") * SHARE >= FRAMES["h4"]))
    bars = written(banded(bars, medians))
    times, rates = m15.select("symbol", "exec_idx", "ts"), written(_listed(spark, sf_dir))
    return bars, written(funded(execution_bars(m15, "h4"), times, rates, mean_rate(rates, 10))), times, rates


def venue_costs(spark, sf_dir: str) -> DataFrame:
    bars = _market(spark, sf_dir)[0]
    return bars.select("symbol", "bar_idx", F.round("median", 6).alias("median"), "slip", F.round("cost_rel", 6).alias("cost_rel"), "tradable")


def venue_funding(spark, sf_dir: str) -> DataFrame:
    """Per symbol: events applied, bars charged before the listing, sums of both, events that no bar starts with."""
    _, execs, times, rates = _market(spark, sf_dir)
    d = execs.groupBy("symbol").agg(F.count_if(F.col("rate") != 0).alias("applied"), F.round(F.sum("rate"), 8).alias("rates"), F.count_if(F.col("rate_abs") != 0).alias("charged"), F.round(F.sum("rate_abs"), 8).alias("charges"))
    lost = unplaced(times, rates).groupBy("symbol").agg(F.count("*").alias("unplaced"))
    return d.join(lost, "symbol", "left").withColumn("unplaced", F.coalesce("unplaced", F.lit(0)))


def venue_trades(spark, sf_dir: str) -> DataFrame:
    """Breakouts on tradable 4-hour bars at banded costs, with funding and exposure of the account at most."""
    bars, execs, _, _ = _market(spark, sf_dir)
    signals = spec_signals(bars).join(bars.filter("tradable").select("symbol", F.col("bar_idx").alias("t")), ["symbol", "t"], "left_semi")
    t = written(chained(outcomes(paths(bars, execs, signals, RULES))))
    days = bars.groupBy("symbol").agg(F.count_distinct("day_id").alias("n_days"))
    m = with_ratios(metrics(t, days)).join(t.groupBy(*PER).agg(F.avg(F.col("cst") / F.col("entry")).alias("mean_cost"), F.sum("fund").alias("funding")), PER)
    return m.select(*PER, "n", "wins", "n_days", *[F.round(c, 6).alias(c) for c in ("mean_r", "t_stat", "equity", "max_dd", "sharpe", "mean_cost")], F.round("funding", 4).alias("funding"))


QUERIES = {f.__name__: f for f in (venue_costs, venue_funding, venue_trades)}

_BANDS = "CASE " + " ".join(f"WHEN median >= {b} THEN {s}::DOUBLE" for b, s in sorted(BANDS, reverse=True)) + " END"
_MARKET = f"""{BASE.replace(frame_sql('h1', 'b'), frame_sql('h4', 'b'))}, {ATR_SQL}, {BREAKOUTS_SQL},
tv AS (SELECT symbol, ts::DATE AS day, sum(volume * (open + high + low + close) / 4) AS usd FROM m15 GROUP BY 1, 2), tu AS (SELECT symbol, day, usd / (SELECT avg(usd) FROM tv) AS usd FROM tv),
tm AS (SELECT symbol, day, CASE WHEN count(usd) OVER w = {DAYS} THEN median(usd) OVER w END AS median FROM tu WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN {DAYS} PRECEDING AND 1 PRECEDING)),
cb AS MATERIALIZED (SELECT *, 2 * ({FEE} + coalesce(slip, 0)) AS cost_rel, coalesce(n_m15 * {SHARE} >= {FRAMES['h4']} AND slip IS NOT NULL AND atr > 0, false) AS tradable FROM (SELECT sg.*, median, {_BANDS} AS slip FROM sg LEFT JOIN tm ON tm.symbol = sg.symbol AND tm.day = sg.bucket::DATE)),
{EXECS_SQL.split(', ex AS')[0].split(',' + chr(10) + 'ex AS')[0]}, rt AS (SELECT symbol, bucket AS ts, rate FROM fu WHERE bucket >= '2024-01-09'), ft AS (SELECT symbol, min(ts) AS first FROM rt GROUP BY 1),
ma AS (SELECT symbol, avg(abs(rate)) AS mean_abs FROM rt JOIN ft USING (symbol) WHERE ts < first + INTERVAL 10 DAY GROUP BY 1),
ex AS MATERIALIZED (SELECT m.symbol, m.exec_idx, a.bar_idx, m.exec_idx = a.exec_end - 1 AS is_last, coalesce(rt.rate, 0) AS rate,
 CASE WHEN hour(m.ts) IN {HOURS} AND minute(m.ts) = 0 AND (first IS NULL OR m.ts < first) THEN coalesce(mean_abs, 0) ELSE 0 END AS rate_abs, m.open, m.high, m.low, m.close, m.day_id
 FROM m15 m JOIN a ON m.symbol = a.symbol AND m.exec_idx >= a.exec_start AND m.exec_idx < a.exec_end LEFT JOIN rt ON rt.symbol = m.symbol AND rt.ts = m.ts LEFT JOIN ft ON ft.symbol = m.symbol LEFT JOIN ma ON ma.symbol = m.symbol)"""
_SPECS = ", ".join(f"('{s}', {d}, {a}, {b}, {h}, {tr}, {de})" for s, d, a, b, h, tr, de in SPECS)
ORACLE = {
    "venue_costs": f"{_MARKET} SELECT symbol, bar_idx, round(median, 6) AS median, slip, round(cost_rel, 6) AS cost_rel, tradable FROM cb",
    "venue_funding": f"""{_MARKET}, sp AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM m15 GROUP BY 1),
un AS (SELECT rt.symbol, count(*) AS unplaced FROM rt JOIN sp USING (symbol) ANTI JOIN m15 ON m15.symbol = rt.symbol AND m15.ts = rt.ts WHERE rt.ts >= lo AND rt.ts <= hi GROUP BY 1)
SELECT ex.symbol, count(*) FILTER (WHERE rate <> 0) AS applied, round(sum(rate), 8) AS rates, count(*) FILTER (WHERE rate_abs <> 0) AS charged, round(sum(rate_abs), 8) AS charges, coalesce(any_value(unplaced), 0) AS unplaced FROM ex LEFT JOIN un USING (symbol) GROUP BY ex.symbol""",
    "venue_trades": f"""{_MARKET}, sp(strategy, dir, stop, target, hold, trail, delay) AS (VALUES {_SPECS}),
c0 AS (SELECT cb.symbol, strategy, bar_idx AS t, dir, stop, target, hold, trail, atr, cb.cost_rel, t1, bar_idx + 1 + delay AS e FROM cb, sp WHERE tradable AND CASE WHEN dir > 0 THEN up ELSE down END),
{followed_sql(RULES, cost=" + c3.cost_rel", both="rate_abs")}, tc AS MATERIALIZED (SELECT * FROM ch), dd AS (SELECT *, 1 - equity / greatest(1, max(equity) OVER (PARTITION BY symbol, strategy ORDER BY t)) AS drawdown FROM tc),
de AS (SELECT symbol, strategy, day_id, last(equity ORDER BY t) AS eq FROM tc GROUP BY 1, 2, 3), dr AS (SELECT *, eq / coalesce(lag(eq) OVER (PARTITION BY symbol, strategy ORDER BY day_id), 1) - 1 AS ret FROM de),
nd AS (SELECT symbol, count(DISTINCT day_id) AS n_days FROM a GROUP BY symbol), sh AS (SELECT symbol, strategy, n_days, sum(ret) / n_days AS mean, sqrt(greatest(0, sum(ret * ret) / n_days - (sum(ret) / n_days) ** 2)) AS sd FROM dr JOIN nd USING (symbol) GROUP BY symbol, strategy, n_days),
ag AS (SELECT symbol, strategy, count(*) AS n, count(*) FILTER (WHERE r > 0) AS wins, sum(r) AS s1, sum(r * r) AS s2, last(equity ORDER BY t) AS equity, max(drawdown) AS max_dd, avg(cst / entry) AS mean_cost, sum(fund) AS funding FROM dd GROUP BY 1, 2)
SELECT symbol, strategy, n, wins, n_days, round(s1 / n, 6) AS mean_r, round(CASE WHEN s2 / n - (s1 / n) ** 2 > 0 THEN s1 / n / sqrt(s2 / n - (s1 / n) ** 2) * sqrt(n) END, 6) AS t_stat, round(equity, 6) AS equity, round(max_dd, 6) AS max_dd,
 round(CASE WHEN sd > 0 THEN mean / sd * sqrt(260) ELSE 0 END, 6) AS sharpe, round(mean_cost, 6) AS mean_cost, round(funding, 4) AS funding FROM ag JOIN sh USING (symbol, strategy)""",
}

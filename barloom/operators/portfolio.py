"""Daily portfolios over several assets: panels, signals, target weights and the accounting of drifting holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tapes import daily_trades

VOL_DAYS, TREND_DAYS, COST, SIDES, SCENARIOS = 60, (20, 60, 120), 0.001, 3, (0, 1, 2, 5)


def by_day():
    return Window.partitionBy("asset").orderBy("day")


def panel(closes: DataFrame) -> DataFrame:
    """A calendar of all days by asset: closes carried forward, simple returns (0 where unknown), and the yearly
    volatility of the last ``VOL_DAYS`` log returns (sample deviation; null until there are so many)."""
    days = closes.select("day").distinct().join(closes.groupBy("asset").agg(F.min("day").alias("first")), F.col("day") >= F.col("first"))
    d = days.select("asset", "day").join(closes, ["asset", "day"], "left")
    d = d.withColumn("close", F.last("close", ignorenulls=True).over(by_day().rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("close").over(by_day())
    d = d.withColumns({"ret": F.coalesce(F.col("close") / before - 1, F.lit(0.0)), "lr": F.log(F.col("close") / before)})
    w = by_day().rowsBetween(-(VOL_DAYS - 1), 0)
    return d.withColumn("vol", F.when(F.count("lr").over(w) == VOL_DAYS, F.stddev_samp("lr").over(w) * F.sqrt(F.lit(260.0)))).drop("lr")


def trend_signal(d: DataFrame) -> DataFrame:
    """Mean sign of the moves over several horizons; a missing horizon counts as 0."""
    parts = [F.coalesce(F.signum(F.col("close") - F.lag("close", n).over(by_day())), F.lit(0.0)) for n in TREND_DAYS]
    return d.withColumn("signal", sum(parts[1:], parts[0]) / len(parts))


def inverse_vol(d: DataFrame, signal: str = "signal") -> DataFrame:
    """Weights s / vol, scaled to one gross over the assets of the day."""
    raw = F.col(signal) / F.col("vol")
    gross = F.sum(F.abs(raw)).over(Window.partitionBy("day"))
    return d.withColumn("weight", F.coalesce(F.try_divide(raw, gross), F.lit(0.0)))


def cross_section(d: DataFrame, score: str) -> DataFrame:
    """Long the top and short the bottom third by score, inverse volatility inside each side, half gross a side."""
    day, ok = Window.partitionBy("day", "ok"), F.col(score).isNotNull() & (F.col("vol") > 0)
    d = d.withColumn("ok", F.coalesce(ok, F.lit(False)))
    k = F.floor(F.count("*").over(day) / SIDES)
    up, down = F.row_number().over(day.orderBy(F.desc(score), "asset")), F.row_number().over(day.orderBy(score, "asset"))
    d = d.withColumn("side", F.when(~F.col("ok"), 0).when(up <= k, 1).when(down <= k, -1).otherwise(0))
    inverse = F.when(F.col("side") != 0, 1 / F.col("vol"))
    return d.withColumn("weight", F.coalesce(0.5 * F.col("side") * inverse / F.sum(inverse).over(Window.partitionBy("day", "side")), F.lit(0.0))).drop("ok", "side")


def held(d: DataFrame, pay_mult: float = 1.0) -> DataFrame:
    """portfolio, day, price, carry, gain, turnover, paid of the holdings of a panel (portfolio, day, asset, ret, weight,
    rebalance, cost; carry per unit of holding; carry_abs, if there is one, is paid per unit of its size).

    Holdings earn the day's returns and carry, drift, and are then moved to the day's targets, which earn from the next day on.
    Between two moves an asset's value is its target times a product of its own returns, and the account's is one plus the sum
    of what its assets earned; both start anew at each move, so all is windows over a stretch between moves and nothing
    follows a portfolio day by day. Sums over assets are combined map-side. A column ``pay_mult`` takes the place of the
    argument; what is paid counts so many times. An account that has lost more than all goes on by the same algebra, as its
    returns are asked for; ``controls.account_figures`` ends it.
    """
    owed = F.col("carry_abs") if "carry_abs" in d.columns else F.lit(0.0)
    mult = F.col("pay_mult") if "pay_mult" in d.columns else F.lit(pay_mult)
    own = Window.partitionBy("portfolio", "asset").orderBy("day")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    moved = F.when(F.col("rebalance"), F.coalesce("weight", F.lit(0.0)))
    d = d.withColumns({"stretch": F.count(moved).over(before), "base": F.coalesce(F.last(moved, ignorenulls=True).over(before), F.lit(0.0))})
    inside = Window.partitionBy("portfolio", "asset", "stretch").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max((F.col("ret") <= -1).cast("int")).over(inside), F.lit(0)) == 1
    grown = F.when(gone, 0.0).otherwise(F.exp(F.coalesce(F.sum(F.when(F.col("ret") > -1, F.log1p("ret"))).over(inside), F.lit(0.0))))
    d = d.withColumn("n", F.col("base") * grown)
    d = d.withColumns({"flow": F.col("n") * F.col("carry") - F.abs("n") * owed, "after": F.col("n") * F.greatest(1 + F.col("ret"), F.lit(0.0))})
    d = d.withColumn("flow", F.when(F.col("flow") < 0, F.col("flow") * mult).otherwise(F.col("flow")))
    day = d.groupBy("portfolio", "day").agg(F.sum(F.col("n") * F.col("ret")).alias("price"), F.sum("flow").alias("flow"), F.bool_or("rebalance").alias("moves"))
    life = Window.partitionBy("portfolio").orderBy("day")
    day = day.withColumn("stretch", F.coalesce(F.count_if("moves").over(life.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    so_far = Window.partitionBy("portfolio", "stretch").orderBy("day")
    day = day.withColumn("value", 1 + F.sum(F.col("price") + F.col("flow")).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    day = day.withColumn("start", F.coalesce(F.lag("value").over(so_far), F.lit(1.0)))
    rows = d.filter("rebalance").join(day.filter("moves").select("portfolio", "day", "value"), ["portfolio", "day"])
    target = F.coalesce("weight", F.lit(0.0))
    step = F.abs(target - F.coalesce(F.try_divide("after", "value"), F.lit(0.0)))
    steps = rows.groupBy("portfolio", "day").agg(F.sum(step).alias("turnover"), F.sum(step * F.col("cost")).alias("paid"))
    per = lambda c: F.coalesce(F.try_divide(c, F.col("start")), F.lit(0.0))
    out = day.join(steps, ["portfolio", "day"], "left")
    return out.select(
        "portfolio", "day", per(F.col("price")).alias("price"), per(F.col("flow")).alias("carry"), per(F.col("price") + F.col("flow")).alias("gain"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.coalesce("paid", F.lit(0.0)).alias("paid")
    )


def accounted(d: DataFrame, cost: float = COST, pay_mult: float = 1.0) -> DataFrame:
    """portfolio, day, ret, turnover of ``held``, costs taken from the day's return. A column ``cost`` takes the place of the argument."""
    d = d if "cost" in d.columns else d.withColumn("cost", F.lit(cost))
    return held(d, pay_mult).select("portfolio", "day", (F.col("gain") - F.col("paid")).alias("ret"), "turnover")


def _panel(spark, sf_dir: str) -> DataFrame:
    c = daily_trades(spark, sf_dir).groupBy(F.col("symbol").alias("asset"), F.to_date("ts").alias("day")).agg(F.round(F.avg("price"), 4).alias("close"))
    return panel(c)


def _trend(spark, sf_dir: str) -> DataFrame:
    return inverse_vol(trend_signal(_panel(spark, sf_dir)))


def portfolio_trend_weights(spark, sf_dir: str) -> DataFrame:
    return _trend(spark, sf_dir).select("asset", "day", F.round("vol", 6).alias("vol"), F.round("signal", 6).alias("signal"), F.round("weight", 6).alias("weight"))


def portfolio_cross_section(spark, sf_dir: str) -> DataFrame:
    d = _panel(spark, sf_dir).withColumn("score", F.round(F.lag("close", 7).over(by_day()) / F.lag("close", 35).over(by_day()) - 1, 9))
    return cross_section(d, "score").select("asset", "day", F.round("weight", 6).alias("weight"))


def _weekly(spark, sf_dir: str) -> DataFrame:
    """The trend portfolio, moved on the first day of each week that trades."""
    d = _trend(spark, sf_dir).withColumns({"portfolio": F.lit("trend"), "carry": F.lit(0.0), "week": F.date_trunc("week", F.col("day").cast("timestamp_ntz"))})
    return d.withColumn("rebalance", F.col("day") == F.min("day").over(Window.partitionBy("week")))


def portfolio_scenarios(spark, sf_dir: str) -> DataFrame:
    """The trend portfolio under so many times the cost: sum, deviation and worst of the daily returns (the
    tape's moves are too wild to compound), turnover."""
    each = F.array(*[F.struct(F.lit(f"trend x{m}").alias("portfolio"), F.lit(COST * m).alias("cost")) for m in SCENARIOS])
    d = accounted(_weekly(spark, sf_dir).drop("portfolio").select("*", F.inline(each))).groupBy("portfolio")
    return d.agg(*[F.round(v, 5).alias(k) for k, v in (("total", F.sum("ret")), ("deviation", F.stddev_pop("ret")), ("worst", F.min("ret")), ("turnover", F.sum("turnover")))])


def portfolio_simulated(spark, sf_dir: str) -> DataFrame:
    return accounted(_weekly(spark, sf_dir)).select("day", F.round("ret", 6).alias("ret"), F.round("turnover", 6).alias("turnover"))


QUERIES = {f.__name__: f for f in (portfolio_trend_weights, portfolio_cross_section, portfolio_simulated, portfolio_scenarios)}

_P = """WITH RECURSIVE c AS (SELECT o_orderpriority AS asset, o_orderdate::DATE AS day, round(avg(o_totalprice), 4) AS close FROM orders GROUP BY 1, 2),
f AS (SELECT asset, min(day) AS first FROM c GROUP BY 1), g AS (SELECT f.asset, d.day FROM (SELECT DISTINCT day FROM c) d JOIN f ON d.day >= f.first),
h AS (SELECT g.asset, g.day, last_value(close IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.day) AS close FROM g LEFT JOIN c ON c.asset = g.asset AND c.day = g.day),
i AS (SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS ret, ln(close / lag(close) OVER w) AS lr FROM h WINDOW w AS (PARTITION BY asset ORDER BY day)),
p AS (SELECT asset, day, close, ret, CASE WHEN count(lr) OVER w = 60 THEN stddev_samp(lr) OVER w * sqrt(260) END AS vol FROM i WINDOW w AS (PARTITION BY asset ORDER BY day ROWS 59 PRECEDING))"""
_T = _P + """, s AS (SELECT *, (coalesce(sign(close - lag(close, 20) OVER w), 0) + coalesce(sign(close - lag(close, 60) OVER w), 0) + coalesce(sign(close - lag(close, 120) OVER w), 0)) / 3 AS signal FROM p WINDOW w AS (PARTITION BY asset ORDER BY day)),
t AS MATERIALIZED (SELECT *, coalesce(signal / vol / nullif(sum(abs(signal / vol)) OVER (PARTITION BY day), 0), 0) AS weight FROM s)"""
ORACLE = {
    "portfolio_trend_weights": f"{_T} SELECT asset, day, round(vol, 6) AS vol, round(signal, 6) AS signal, round(weight, 6) AS weight FROM t",
    "portfolio_cross_section": f"""{_P}, s AS (SELECT *, round(lag(close, 7) OVER w / lag(close, 35) OVER w - 1, 9) AS score FROM p WINDOW w AS (PARTITION BY asset ORDER BY day)),
k AS (SELECT *, coalesce(score IS NOT NULL AND vol > 0, false) AS ok FROM s), r AS (SELECT *, count(*) OVER (PARTITION BY day, ok) // 3 AS n, row_number() OVER (PARTITION BY day, ok ORDER BY score DESC, asset) AS up, row_number() OVER (PARTITION BY day, ok ORDER BY score, asset) AS down FROM k),
q AS (SELECT *, CASE WHEN NOT ok THEN 0 WHEN up <= n THEN 1 WHEN down <= n THEN -1 ELSE 0 END AS side FROM r)
SELECT asset, day, round(coalesce(CASE WHEN side <> 0 THEN 0.5 * side / vol / sum(1 / vol) OVER (PARTITION BY day, side) END, 0), 6) AS weight FROM q""",
    "portfolio_simulated": f"""{_T}, n AS MATERIALIZED (SELECT day, row_number() OVER (ORDER BY day) AS i, day = min(day) OVER (PARTITION BY date_trunc('week', day)) AS moves, m FROM (SELECT day, map_from_entries(list((asset, {{'ret': ret, 'weight': weight}}))) AS m FROM t GROUP BY day)),
a AS MATERIALIZED (SELECT list(DISTINCT asset ORDER BY asset) AS names FROM c),
z AS (SELECT 0::BIGINT AS i, NULL::DATE AS day, 0.0::DOUBLE AS ret, 0.0::DOUBLE AS turnover, list_transform((SELECT names FROM a), lambda x: 0.0::DOUBLE) AS hold
 UNION ALL SELECT n.i, n.day, gain - moved * 0.001, moved, CASE WHEN n.moves THEN target ELSE drift END FROM (
  SELECT n.i, n.day, n.moves, gain, drift, target, CASE WHEN n.moves THEN list_sum(list_transform(list_zip(target, drift), lambda q: abs(q[1] - q[2]))) ELSE 0 END AS moved FROM (
   SELECT n.i, n.day, n.moves, gain, list_transform((SELECT names FROM a), lambda x: coalesce(n.m[x].weight, 0)) AS target, list_transform(list_zip(z.hold, rets), lambda q: q[1] * (1 + q[2]) / (1 + gain)) AS drift FROM (
    SELECT n.*, z.hold, rets, list_sum(list_transform(list_zip(z.hold, rets), lambda q: q[1] * q[2])) AS gain FROM z JOIN n ON n.i = z.i + 1, LATERAL (SELECT list_transform((SELECT names FROM a), lambda x: coalesce(n.m[x].ret, 0)) AS rets)) n, LATERAL (SELECT n.hold) z) n) n)
SELECT day, round(ret, 6) AS ret, round(turnover, 6) AS turnover FROM z WHERE i > 0""",
}
_Z = ORACLE["portfolio_simulated"].rsplit("SELECT day, round(ret, 6)", 1)[0]
ORACLE["portfolio_scenarios"] = f"""{_Z}, y AS (SELECT 'trend x' || m AS portfolio, day, turnover, ret + turnover * {COST} * (1 - m) AS ret FROM z, (VALUES {", ".join(f"({m})" for m in SCENARIOS)}) s(m) WHERE i > 0)
SELECT portfolio, round(sum(ret), 5) AS total, round(stddev_pop(ret), 5) AS deviation, round(min(ret), 5) AS worst, round(sum(turnover), 5) AS turnover FROM y GROUP BY portfolio"""

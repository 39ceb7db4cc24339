"""Portfolio hypotheses over a panel of spot and perpetual prices with funding: carry, funding extremes, trends in two forms and
momentum across assets, each under scenarios of costs and payments; random directions of position spells; bootstrap figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from ..sources.tapes import table
from .portfolio import by_day, cross_section, held, trend_signal
from .worlds import BLOCK, RESAMPLES, block_bootstrap
from .worlds import SEED as STARTS

#: Days of history an asset needs, look-backs, the trend's target volatility and cap, nights by ISO weekday.
HISTORY, FUNDING_DAYS, MOMENTUM, TARGET, CAP = 60, 7, (7, 28), 0.10, 5.0
NIGHTS = {1: 1, 2: 1, 3: 3, 4: 1, 5: 1, 6: 0, 7: 0}
FEES, SWAP, PER_YEAR = {"spot": 0.001, "perp": 0.0005}, 0.00005, 365
#: Scenario: multiples of costs and of payments.
SCENARIOS = (("x1", 1.0, 1.0), ("x2", 2.0, 2.0))
SEED, FLIPS = "spells-1", 5
VOL_DAYS, YEAR = 60, 260.0


def panel(closes: DataFrame) -> DataFrame:
    """A calendar of all days by asset from its first day on. closes: asset, day, spot, perp, funding. Prices are carried forward;
    close (perp), ret_spot, ret_perp (0 where unknown), vol (yearly, of the last 60 log returns), funding (0 on days without),
    eligible (60 days with prices so far, and a volatility above 0)."""
    days = closes.select("day").distinct().join(closes.groupBy("asset").agg(F.min("day").alias("first")), F.col("day") >= F.col("first"))
    d = days.select("asset", "day").join(closes, ["asset", "day"], "left")
    so_far = by_day().rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"known": F.count("perp").over(so_far), "spot": F.last("spot", ignorenulls=True).over(so_far), "close": F.last("perp", ignorenulls=True).over(so_far), "funding": F.coalesce("funding", F.lit(0.0))})
    ret = lambda c: F.coalesce(F.col(c) / F.lag(c).over(by_day()) - 1, F.lit(0.0))
    d = d.withColumns({"ret_spot": ret("spot"), "ret_perp": ret("close"), "lr": F.log(F.col("close") / F.lag("close").over(by_day()))})
    w = by_day().rowsBetween(-(VOL_DAYS - 1), 0)
    d = d.withColumn("vol", F.when(F.count("lr").over(w) == VOL_DAYS, F.stddev_samp("lr").over(w) * F.sqrt(F.lit(YEAR))))
    return d.withColumn("eligible", F.coalesce((F.col("known") >= HISTORY) & (F.col("vol") > 0), F.lit(False)))


def scheduled(unit: str):
    """The first day of each month or week of the calendar; every day for 'day'."""
    if unit == "day":
        return F.lit(True)
    return F.col("day") == F.min("day").over(Window.partitionBy(F.date_trunc(unit, F.col("day").cast("timestamp_ntz"))))


def hypotheses(p: DataFrame, slip: float = 0.0005) -> DataFrame:
    """portfolio, day, asset, ret, carry, carry_abs, weight, rebalance, cost of the five hypotheses, one union over the panel."""
    day = Window.partitionBy("day")
    k = F.sum(F.col("eligible").cast("int")).over(day)
    one = F.when(F.col("eligible"), 1 / k).otherwise(0.0)
    p = p.withColumns({"even": one, "week7": F.when(F.count("funding").over(by_day().rowsBetween(-FUNDING_DAYS + 1, 0)) == FUNDING_DAYS, F.sum("funding").over(by_day().rowsBetween(-FUNDING_DAYS + 1, 0))), "k": k})
    perp, spot = F.lit(FEES["perp"] + slip), F.lit(FEES["spot"] + slip)
    trend = trend_signal(p)

    def shaped(d: DataFrame, name: str, weight, unit: str, ret: str = "ret_perp", carry=-F.col("funding"), carry_abs=F.lit(0.0), cost=perp, leg: str = "perp") -> DataFrame:
        return d.select(F.lit(name).alias("portfolio"), "day", F.concat("asset", F.lit(f"_{leg}")).alias("asset"), F.col(ret).alias("ret"), carry.alias("carry"), carry_abs.alias("carry_abs"), weight.alias("weight"), scheduled(unit).alias("rebalance"), cost.alias("cost"))

    low = cross_section(p.withColumn("score", F.round(F.when(F.col("eligible"), -F.col("week7")), 9)), "score")
    near, far = MOMENTUM
    momentum = F.lag("close", near).over(by_day()) / F.lag("close", far).over(by_day()) - 1
    strong = cross_section(p.withColumn("m", momentum).withColumn("score", F.round(F.when(F.col("eligible"), F.col("m")), 9)), "score")
    inverse = F.when(F.col("eligible"), 1 / F.col("vol"))
    nights = F.element_at(F.create_map(*[F.lit(v) for kv in NIGHTS.items() for v in kv]), F.weekday("day") + 1)
    scaled = F.when(F.col("eligible"), F.greatest(F.lit(-CAP), F.least(F.lit(CAP), F.col("signal") * (TARGET / F.sqrt("k")) / F.col("vol")))).otherwise(0.0)
    parts = [
        shaped(p, "funding_carry", F.col("even"), "month", "ret_spot", F.lit(0.0), cost=spot, leg="spot"), shaped(p, "funding_carry", -F.col("even"), "month"), shaped(low, "funding_extreme", F.col("weight"), "week"),
        shaped(trend, "trend", F.coalesce(F.col("signal") * inverse / F.sum(inverse).over(day), F.lit(0.0)), "day"), shaped(strong, "momentum", F.col("weight"), "week"),
        shaped(trend, "scaled_trend", scaled, "day", carry=F.lit(0.0), carry_abs=nights * F.lit(SWAP)),
    ]
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def under(d: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Every portfolio under every scenario, named 'portfolio scenario'."""
    each = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(c).alias("cost_mult"), F.lit(m).alias("pay_mult")) for n, c, m in scenarios])
    d = d.select("*", F.inline(each))
    return d.withColumns({"portfolio": F.concat_ws(" ", "portfolio", "scenario"), "cost": F.col("cost") * F.col("cost_mult")}).drop("scenario", "cost_mult")


def returns(d: DataFrame) -> DataFrame:
    """``held`` with ret: what is gained, then costs."""
    return held(d).withColumn("ret", (1 + F.col("gain")) * (1 - F.col("paid")) - 1)


def flipped(d: DataFrame, replicas: int = FLIPS) -> DataFrame:
    """Random controls: each spell of an asset (moves in a row with one sign, none 0) gets a random direction; sizes and days of moves
    stay. Portfolios are named 'portfolio flip n'. Directions come from the md5 of seed, replica, asset and spell."""
    own = Window.partitionBy("portfolio", "asset").orderBy("day")
    moves = d.filter("rebalance").withColumn("side", F.signum("weight"))
    new = (F.col("side") != 0) & (F.col("side") != F.coalesce(F.lag("side").over(own), F.lit(0.0)))
    moves = moves.withColumn("spell", F.sum(new.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    moves = moves.select("portfolio", "asset", "day", "spell")
    d = d.join(moves, ["portfolio", "asset", "day"], "left").withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    digit = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.col("replica").cast("string"), "asset", F.col("spell").cast("string"))), 1, 1), 16, 10).cast("int")
    turn = F.when(digit % 2 == 0, 1.0).otherwise(-1.0)
    return d.withColumns({"weight": F.col("weight") * turn, "portfolio": F.concat("portfolio", F.lit(" flip "), F.col("replica").cast("string"))}).drop("spell", "replica")


def bootstrap_figures(d: DataFrame, by: str = "portfolio", per_year: int = PER_YEAR, resamples: int = RESAMPLES, block: int = BLOCK) -> DataFrame:
    """Per series: n, mean, yearly Sharpe (sample deviation), standard error of the mean over circular block resamples, t, one-sided p
    of a mean above 0 (resamples less the mean), 95 % interval of the Sharpe. Starts are the same for series of one length."""
    seen = d.groupBy(by).agg(F.count("*").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    r = block_bootstrap(d, by, "day", "ret", resamples, block).join(seen, by)
    ratio = F.try_divide(F.col("mean"), F.col("sd")) * per_year**0.5
    out = r.groupBy(by, "n", "m", "s").agg(F.stddev_samp("mean").alias("se"), F.count_if(F.col("mean") - F.col("m") >= F.col("m")).alias("above"), F.count("*").alias("k"), F.percentile(ratio, F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    return out.select(by, "n", F.col("m").alias("mean"), (F.try_divide("m", "s") * per_year**0.5).alias("sharpe"), "se", F.try_divide("m", "se").alias("t"), ((1 + F.col("above")) / (1 + F.col("k"))).alias("p"), F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"))


# queries ------------------------------------------------------------------------------------------------------------
def _panel(spark, sf_dir: str) -> DataFrame:
    """The orders' tape: mean price as spot, median as perpetual, a funding rate from the share of finished orders."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("day"))
    done = F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return panel(o.agg(F.round(F.avg("o_totalprice"), 4).alias("spot"), F.round(F.expr("percentile(o_totalprice, 0.5)"), 4).alias("perp"), F.round((done - 0.5) / 1000, 9).alias("funding")))


def _all(spark, sf_dir: str) -> DataFrame:
    return written(hypotheses(written(_panel(spark, sf_dir))))


def hypotheses_scenarios(spark, sf_dir: str) -> DataFrame:
    """The five hypotheses under every scenario: days, sums of returns, price moves, carry, costs and turnover, deviation, worst day."""
    d = returns(under(_all(spark, sf_dir))).groupBy("portfolio")
    sums = {k: F.sum(k) for k in ("ret", "price", "carry", "paid", "turnover")}
    return d.agg(F.count("*").alias("days"), *[F.round(v, 4).alias(k) for k, v in (sums | {"deviation": F.stddev_pop("ret"), "worst": F.min("ret")}).items()])


def hypotheses_flips(spark, sf_dir: str) -> DataFrame:
    d = returns(flipped(_all(spark, sf_dir).filter("portfolio in ('trend', 'momentum')"))).groupBy("portfolio")
    return d.agg(F.count("*").alias("days"), F.round(F.sum("ret"), 4).alias("ret"), F.round(F.sum("turnover"), 4).alias("turnover"))


def hypotheses_bootstrap(spark, sf_dir: str) -> DataFrame:
    d = bootstrap_figures(written(returns(_all(spark, sf_dir))))
    return d.select("portfolio", "n", *[F.round(c, 5).alias(c) for c in ("mean", "sharpe", "se", "t", "p", "lo", "hi")])


QUERIES = {f.__name__: f for f in (hypotheses_scenarios, hypotheses_flips, hypotheses_bootstrap)}

_P = """WITH c AS (SELECT o_orderpriority AS asset, o_orderdate::DATE AS day, round(avg(o_totalprice), 4) AS spot, round(median(o_totalprice), 4) AS perp, round((avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) - 0.5) / 1000, 9) AS funding FROM orders GROUP BY 1, 2),
f AS (SELECT asset, min(day) AS first FROM c GROUP BY 1), g AS (SELECT f.asset, d.day FROM (SELECT DISTINCT day FROM c) d JOIN f ON d.day >= f.first),
h AS (SELECT g.asset, g.day, count(perp) OVER w AS known, last_value(spot IGNORE NULLS) OVER w AS spot, last_value(perp IGNORE NULLS) OVER w AS close, coalesce(funding, 0) AS funding FROM g LEFT JOIN c ON c.asset = g.asset AND c.day = g.day WINDOW w AS (PARTITION BY g.asset ORDER BY g.day)),
i AS (SELECT *, coalesce(spot / lag(spot) OVER w - 1, 0) AS ret_spot, coalesce(close / lag(close) OVER w - 1, 0) AS ret_perp, ln(close / lag(close) OVER w) AS lr FROM h WINDOW w AS (PARTITION BY asset ORDER BY day)),
j AS (SELECT *, CASE WHEN count(lr) OVER w = 60 THEN stddev_samp(lr) OVER w * sqrt(260) END AS vol FROM i WINDOW w AS (PARTITION BY asset ORDER BY day ROWS 59 PRECEDING)),
k AS (SELECT *, coalesce(known >= 60 AND vol > 0, false) AS ok FROM j),
p AS MATERIALIZED (SELECT *, CASE WHEN ok THEN 1.0::DOUBLE / nullif(sum(ok::INT) OVER (PARTITION BY day), 0) ELSE 0 END AS even, sum(ok::INT) OVER (PARTITION BY day) AS k,
 CASE WHEN ok AND count(funding) OVER v = 7 THEN round(-sum(funding) OVER v, 9) END AS s2, CASE WHEN ok THEN round(lag(close, 7) OVER w / lag(close, 28) OVER w - 1, 9) END AS s4,
 (coalesce(sign(close - lag(close, 20) OVER w), 0) + coalesce(sign(close - lag(close, 60) OVER w), 0) + coalesce(sign(close - lag(close, 120) OVER w), 0)) / 3 AS signal,
 day = min(day) OVER (PARTITION BY date_trunc('month', day)) AS monthly, day = min(day) OVER (PARTITION BY date_trunc('week', day)) AS weekly
 FROM k WINDOW w AS (PARTITION BY asset ORDER BY day), v AS (PARTITION BY asset ORDER BY day ROWS 6 PRECEDING))"""
_XS = lambda s, name: f"""SELECT '{name}' AS portfolio, day, asset || '_perp' AS asset, ret_perp AS ret, -funding AS carry, 0.0::DOUBLE AS carry_abs, coalesce(CASE WHEN side <> 0 THEN 0.5 * side / vol / sum(1 / vol) OVER (PARTITION BY day, side) END, 0) AS weight, weekly AS rebalance, 0.001 AS cost FROM (
 SELECT *, CASE WHEN NOT in_it THEN 0 WHEN up <= n THEN 1 WHEN down <= n THEN -1 ELSE 0 END AS side FROM (SELECT *, count(*) OVER q // 3 AS n, row_number() OVER (PARTITION BY day, in_it ORDER BY {s} DESC, asset) AS up, row_number() OVER (PARTITION BY day, in_it ORDER BY {s}, asset) AS down
 FROM (SELECT *, coalesce({s} IS NOT NULL AND vol > 0, false) AS in_it FROM p) WINDOW q AS (PARTITION BY day, in_it)))"""  # noqa: E731
_D = f"""{_P}, d AS MATERIALIZED (SELECT 'funding_carry' AS portfolio, day, asset || '_spot' AS asset, ret_spot AS ret, 0.0::DOUBLE AS carry, 0.0::DOUBLE AS carry_abs, even AS weight, monthly AS rebalance, 0.0015 AS cost FROM p
 UNION ALL SELECT 'funding_carry', day, asset || '_perp', ret_perp, -funding, 0, -even, monthly, 0.001 FROM p UNION ALL {_XS('s2', 'funding_extreme')} UNION ALL {_XS('s4', 'momentum')}
 UNION ALL SELECT 'trend', day, asset || '_perp', ret_perp, -funding, 0, coalesce(CASE WHEN ok THEN signal / vol END / sum(CASE WHEN ok THEN 1 / vol END) OVER (PARTITION BY day), 0), true, 0.001 FROM p
 UNION ALL SELECT 'scaled_trend', day, asset || '_perp', ret_perp, 0, {SWAP} * CASE isodow(day) WHEN 3 THEN 3 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END, CASE WHEN ok THEN greatest(-5, least(5, signal * (0.1 / sqrt(k)) / vol)) ELSE 0 END, true, 0.001 FROM p)"""


def _held_sql(source: str) -> str:
    """Daily rows ``hr`` of portfolios: values between moves as products of returns, as the operator states."""
    return f"""h1 AS (SELECT *, count(CASE WHEN rebalance THEN 1 END) OVER b AS st, coalesce(last_value(CASE WHEN rebalance THEN weight END IGNORE NULLS) OVER b, 0) AS base FROM {source} WINDOW b AS (PARTITION BY portfolio, asset ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h2 AS (SELECT *, base * coalesce(product(1 + ret) OVER (PARTITION BY portfolio, asset, st ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS n FROM h1),
h3 AS MATERIALIZED (SELECT *, n * carry - abs(n) * carry_abs AS flow FROM h2),
h4 AS (SELECT portfolio, day, sum(n * ret) AS price, sum(CASE WHEN flow < 0 THEN flow * pay_mult ELSE flow END) AS flow, bool_or(rebalance) AS moves FROM h3 GROUP BY 1, 2),
h5 AS (SELECT *, coalesce(sum(moves::INT) OVER (PARTITION BY portfolio ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM h4),
h6 AS MATERIALIZED (SELECT *, 1 + sum(price + flow) OVER (PARTITION BY portfolio, st ORDER BY day) AS val FROM h5), h7 AS MATERIALIZED (SELECT *, coalesce(lag(val) OVER (PARTITION BY portfolio, st ORDER BY day), 1) AS beg FROM h6),
h8 AS MATERIALIZED (SELECT h3.portfolio, h3.day, sum(abs(weight - n * (1 + ret) / val)) AS turnover, sum(abs(weight - n * (1 + ret) / val) * cost) AS paid FROM h3 JOIN h6 ON h6.portfolio = h3.portfolio AND h6.day = h3.day WHERE rebalance GROUP BY 1, 2),
hr AS MATERIALIZED (SELECT h7.portfolio, h7.day, price / beg AS price, flow / beg AS carry, coalesce(turnover, 0) AS turnover, coalesce(paid, 0) AS paid, (1 + (price + flow) / beg) * (1 - coalesce(paid, 0)) - 1 AS ret FROM h7 LEFT JOIN h8 ON h8.portfolio = h7.portfolio AND h8.day = h7.day)"""


_SC = ", ".join(f"('{n}', {c}, {m})" for n, c, m in SCENARIOS)
ORACLE = {
    "hypotheses_scenarios": f"""{_D}, u AS MATERIALIZED (SELECT portfolio || ' ' || sc AS portfolio, day, asset, ret, carry, carry_abs, weight, rebalance, cost * cm AS cost, pay_mult FROM d, (VALUES {_SC}) v(sc, cm, pay_mult)), {_held_sql('u')}
SELECT portfolio, count(*) AS days, {', '.join(f'round(sum({c}), 4) AS {c}' for c in ('ret', 'price', 'carry', 'paid', 'turnover'))}, round(stddev_pop(ret), 4) AS deviation, round(min(ret), 4) AS worst FROM hr GROUP BY portfolio""",
    "hypotheses_flips": f"""{_D}, e AS (SELECT *, sign(weight) AS side FROM d WHERE portfolio IN ('trend', 'momentum')), m AS (SELECT *, (side <> 0 AND side <> coalesce(lag(side) OVER w, 0))::INT AS fresh FROM e WHERE rebalance WINDOW w AS (PARTITION BY portfolio, asset ORDER BY day)),
s AS MATERIALIZED (SELECT portfolio, asset, day, sum(fresh) OVER (PARTITION BY portfolio, asset ORDER BY day) AS spell FROM m),
u AS MATERIALIZED (SELECT e.portfolio || ' flip ' || replica AS portfolio, e.day, e.asset, ret, carry, carry_abs, weight * CASE WHEN ('0x' || substr(md5('{SEED}|' || replica || '|' || e.asset || coalesce('|' || spell, '')), 1, 1))::INT % 2 = 0 THEN 1 ELSE -1 END AS weight, rebalance, cost, 1.0 AS pay_mult
 FROM e LEFT JOIN s ON s.portfolio = e.portfolio AND s.asset = e.asset AND s.day = e.day, range({FLIPS}) q(replica)), {_held_sql('u')} SELECT portfolio, count(*) AS days, round(sum(ret), 4) AS ret, round(sum(turnover), 4) AS turnover FROM hr GROUP BY portfolio""",
    "hypotheses_bootstrap": f"""{_D}, u AS MATERIALIZED (SELECT *, 1.0 AS pay_mult FROM d), {_held_sql('u')}, x AS MATERIALIZED (SELECT portfolio, ret, row_number() OVER (PARTITION BY portfolio ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY portfolio) AS n FROM hr),
gg AS (SELECT portfolio, n, rr AS r, y // {BLOCK} AS b, y % {BLOCK} AS kk FROM (SELECT DISTINCT portfolio, n FROM x), range({RESAMPLES}) q(rr), LATERAL (SELECT unnest(range(n)) AS y)),
pk AS (SELECT portfolio, r, (('0x' || substr(md5('{STARTS}|' || r || '|' || b), 1, 7))::BIGINT % n + kk) % n AS i FROM gg), mm AS (SELECT portfolio, r, avg(ret) AS mean, stddev_samp(ret) AS sd FROM pk JOIN x USING (portfolio, i) GROUP BY 1, 2),
se AS (SELECT portfolio, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS s FROM hr GROUP BY 1)
SELECT portfolio, n, round(m, 5) AS mean, round(m / s * sqrt({PER_YEAR}), 5) AS sharpe, round(stddev_samp(mean), 5) AS se, round(m / stddev_samp(mean), 5) AS t, round((1 + count(*) FILTER (WHERE mean - m >= m)) / (1 + count(*)), 5) AS p,
 round(quantile_cont(mean / sd * sqrt({PER_YEAR}), 0.025), 5) AS lo, round(quantile_cont(mean / sd * sqrt({PER_YEAR}), 0.975), 5) AS hi FROM mm JOIN se USING (portfolio) GROUP BY portfolio, n, m, s""",
}

"""Random controls of trades, and series of accounts over a dense calendar.

A control keeps everything of a trade but its time. Of every stratum (a symbol's strategy) and replica the trades are put in
a random order, and the bars that no trade holds are dealt to the gaps between them: starts are sorted uniform draws over the
free bars plus what stands before. So trades never overlap and nothing is tried again; a rank joins draws to trades, another one
starts to bars. Draws come from the md5 of a seed, the replica and the trade, so SQL gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .populations import paid
from .rules import TRADES_SQL, rule_trades
from .stats import permutation_p
from .trades import DAYS_PER_YEAR, PER, RULES

SEED, REPLICAS = "control-1", 20


def _hash(kind: str):
    return F.md5(F.concat_ws("|", F.lit(SEED), F.lit(kind), F.col("replica").cast("string"), *PER, F.col("t").cast("string")))


def matched_controls(trades: DataFrame, bars: DataFrame, execs: DataFrame, rules=RULES, replicas: int = REPLICAS, tradable=None) -> DataFrame:
    """symbol, strategy, replica, t (the trade's), start (the control's signal bar), r: as many trades in each stratum and
    replica, with the same directions, bars held and stop distances as shares of the price, at random bars among those
    that may be traded, without overlaps; they leave at the last bar's close, with the same costs and payments. Trades that
    don't fit into the stratum's bars any more are left out. trades: as of ``trades.chained``."""
    usable = F.col("atr") > 0 if tradable is None else (F.col("atr") > 0) & tradable
    places = bars.filter(usable).select("symbol", F.col("bar_idx").alias("start"), (F.row_number().over(Window.partitionBy("symbol").orderBy("bar_idx")) - 1).alias("place"))
    room = places.groupBy("symbol").agg(F.count("*").alias("room"))
    d = trades.select(*PER, "t", "dir", (F.col("x") - F.col("e") + 1).alias("held"), (F.col("risk") / F.col("entry")).alias("stop_share"))
    d = d.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).join(room, "symbol")
    stratum = [*PER, "replica"]
    w = Window.partitionBy(*stratum)
    in_order = w.orderBy(_hash("order"), "t")
    # a control holds its signal bar and the bars of the trade; what is tradable lies no denser than all bars
    d = d.withColumns({"upto": F.sum(F.col("held") + 1).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), "k": F.row_number().over(in_order)}).filter("upto <= room")
    d = written(d.withColumns({"free": F.col("room") - F.max("upto").over(w), "draw": F.conv(F.substring(_hash("gap"), 1, 7), 16, 10).cast("double") / 2**28}))
    draws = d.select(*stratum, "draw", F.row_number().over(w.orderBy("draw", "t")).alias("k"))
    d = d.drop("draw").join(draws, [*stratum, "k"])
    d = d.withColumn("place", F.floor(F.col("draw") * (F.col("free") + 1)) + F.col("upto") - F.col("held") - 1)
    d = d.join(places, ["symbol", "place"])
    starts = bars.select("symbol", (F.col("bar_idx") - 1).alias("start"), F.col("exec_start").alias("k0"))
    ends = bars.select("symbol", F.col("bar_idx").alias("last"), (F.col("exec_end") - 1).alias("kx"))
    sums = paid(execs, rules.funding_mult)
    side = lambda n: F.when(F.col("dir") > 0, F.col(f"long_{n}")).otherwise(F.col(f"short_{n}"))
    at = lambda k, price: sums.select("symbol", F.col("exec_idx").alias(k), F.col(price).alias(f"px_{k}"), F.col("paid_long").alias(f"long_{k}"), F.col("paid_short").alias(f"short_{k}"))
    d = d.withColumn("last", F.col("start") + F.col("held")).join(starts, ["symbol", "start"]).join(ends, ["symbol", "last"]).join(at("k0", "open"), ["symbol", "k0"]).join(at("kx", "close"), ["symbol", "kx"])
    entry = F.col("px_k0")
    r = (F.col("dir") * (F.col("px_kx") - entry) - (rules.cost + rules.cost_rel * entry) + side("kx") - side("k0")) / (F.col("stop_share") * entry)
    return d.select(*PER, "replica", "t", "start", "held", r.alias("r"))


def control_p(trades: DataFrame, controls: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by``: trades, the share of them placed, their mean R, the controls' mean and p (of mean R against the replicas')."""
    seen = trades.groupBy(*by).agg(F.count("*").alias("n"), F.avg("r").alias("value"))
    nulls = controls.groupBy(*by, "replica").agg(F.avg("r").alias("value"), F.count("*").alias("placed"))
    p = permutation_p(seen.select(*by, "value"), nulls.select(*by, "value"), by)
    means = nulls.groupBy(*by).agg(F.avg("value").alias("control_mean"), F.sum("placed").alias("placed"), F.count("*").alias("replicas"))
    return seen.join(means, by).join(p, by).select(*by, "n", (F.col("placed") / (F.col("n") * F.col("replicas"))).alias("placed_share"), F.col("value").alias("mean_r"), "control_mean", "p")


# accounts -----------------------------------------------------------------------------------------------------------
def daily_series(trades: DataFrame, days: DataFrame, by: list[str]) -> DataFrame:
    """by, day_id, ret: relative changes of an account's closed equity on every day of ``days`` (by, day_id), 0 on days
    without an exit. Accounts without trades have flat series; exits on other days count too."""
    last = trades.groupBy(*by, "day_id").agg(F.max_by("equity", "t").alias("equity"))
    before = F.coalesce(F.lag("equity").over(Window.partitionBy(*by).orderBy("day_id")), F.lit(1.0))
    moves = last.select(*by, "day_id", (F.col("equity") / before - 1).alias("ret"))
    return days.join(moves, [*by, "day_id"], "full").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def pooled_series(series: DataFrame, account: str, cash: bool) -> DataFrame:
    """day_id, ret of equal shares of all accounts. cash: on days that an account lacks its share earns nothing; else the
    accounts of the day share it."""
    if not cash:
        return series.groupBy("day_id").agg(F.avg("ret").alias("ret"))
    n = series.agg(F.count_distinct(account).alias("accounts"))
    return series.groupBy("day_id").agg(F.sum("ret").alias("ret")).crossJoin(F.broadcast(n)).select("day_id", (F.col("ret") / F.col("accounts")).alias("ret"))  # one row


def account_figures(series: DataFrame, by: list[str], days_per_year: int = DAYS_PER_YEAR) -> DataFrame:
    """by, days, sharpe (0 without deviation), total, max_dd of compounded returns. A return of -1 or less ends an account:
    its equity stays 0."""
    order = Window.partitionBy(*by).orderBy("day_id").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max((F.col("ret") <= -1).cast("int")).over(order) == 1
    d = series.withColumn("equity", F.when(lost, 0.0).otherwise(F.exp(F.sum(F.when(F.col("ret") > -1, F.log1p("ret"))).over(order))))
    d = d.withColumn("dd", 1 - F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(order)))
    sd = F.stddev_pop("ret")
    return d.groupBy(*by).agg(F.count("*").alias("days"), F.when(sd > 0, F.avg("ret") / sd * days_per_year**0.5).otherwise(0.0).alias("sharpe"), (F.max_by("equity", "day_id") - 1).alias("total"), F.max("dd").alias("max_dd"))


# queries ------------------------------------------------------------------------------------------------------------
def controls_matched(spark, sf_dir: str) -> DataFrame:
    """Every control of the rules' trades."""
    bars, execs, trades = rule_trades(spark, sf_dir)
    return matched_controls(trades, bars, execs).select(*PER, "replica", "t", "start", F.round("r", 6).alias("r"))


def controls_p(spark, sf_dir: str) -> DataFrame:
    """Whether each strategy's timing beats its controls, pooled over symbols."""
    bars, execs, trades = rule_trades(spark, sf_dir)
    d = control_p(trades, matched_controls(trades, bars, execs), ["strategy"])
    return d.select("strategy", "n", *[F.round(c, 6).alias(c) for c in ("placed_share", "mean_r", "control_mean", "p")])


def accounts_pooled(spark, sf_dir: str) -> DataFrame:
    """The rules' trades as accounts of a symbol's strategy, each from its first trade's day on, pooled by strategy and over all,
    with either treatment of days that an account lacks."""
    bars, _, trades = rule_trades(spark, sf_dir)
    each = trades.groupBy(*PER).agg(F.min("day_id").alias("first"))
    days = bars.select("symbol", "day_id").distinct().join(each, "symbol").filter("day_id >= first").select(*PER, "day_id")
    s = written(daily_series(trades, days, PER).withColumn("account", F.concat_ws("|", *PER)))
    out = account_figures(s.select(F.col("account").alias("pool"), "day_id", "ret"), ["pool"])
    for name, cash in (("all, cash", True), ("all, present", False)):
        out = out.unionByName(account_figures(pooled_series(s, "account", cash).withColumn("pool", F.lit(name)), ["pool"]))
    return out.select("pool", "days", *[F.round(c, 6).alias(c) for c in ("sharpe", "total", "max_dd")])


QUERIES = {f.__name__: f for f in (controls_matched, controls_p, accounts_pooled)}

_H = lambda kind: f"md5('{SEED}|{kind}|' || replica || '|' || symbol || '|' || strategy || '|' || t)"
_PAY = lambda d: f"sum(CASE WHEN {-d} * rate < 0 THEN {-d} * rate * open * {RULES.funding_mult} ELSE {-d} * rate * open END) OVER (PARTITION BY symbol ORDER BY exec_idx)"
_CONTROLS = f"""{TRADES_SQL}, tc AS MATERIALIZED (SELECT * FROM ch),
places AS MATERIALIZED (SELECT symbol, bar_idx AS start, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 AS place FROM a WHERE atr > 0),
k0 AS MATERIALIZED (SELECT symbol, strategy, t, dir, x - e + 1 AS held, risk / entry AS stop_share, replica, room FROM tc JOIN (SELECT symbol, count(*) AS room FROM places GROUP BY 1) USING (symbol), range({REPLICAS}) q(replica)),
k1 AS (SELECT *, sum(held + 1) OVER w AS upto, row_number() OVER w AS k FROM k0 WINDOW w AS (PARTITION BY symbol, strategy, replica ORDER BY {_H('order')}, t)),
k2 AS MATERIALIZED (SELECT *, room - max(upto) OVER (PARTITION BY symbol, strategy, replica) AS free, ('0x' || substr({_H('gap')}, 1, 7))::BIGINT / 268435456.0::DOUBLE AS draw FROM (SELECT * FROM k1 WHERE upto <= room)),
k3 AS (SELECT symbol, strategy, replica, draw, row_number() OVER (PARTITION BY symbol, strategy, replica ORDER BY draw, t) AS k FROM k2),
k4 AS MATERIALIZED (SELECT k2.* EXCLUDE (draw), floor(k3.draw * (free + 1))::BIGINT + upto - held - 1 AS place FROM k2 JOIN k3 USING (symbol, strategy, replica, k)),
sm AS MATERIALIZED (SELECT symbol, exec_idx, open, close, {_PAY(1)} AS pl, {_PAY(-1)} AS ps FROM ex), ba AS MATERIALIZED (SELECT symbol, bar_idx, exec_start, exec_end FROM a),
k5 AS MATERIALIZED (SELECT k4.*, p.start, p.start + held AS last FROM k4 JOIN places p USING (symbol, place)), k6 AS MATERIALIZED (SELECT k5.*, exec_start FROM k5 JOIN ba ON ba.symbol = k5.symbol AND ba.bar_idx = k5.start + 1),
k7 AS MATERIALIZED (SELECT k6.*, exec_end - 1 AS kx FROM k6 JOIN ba ON ba.symbol = k6.symbol AND ba.bar_idx = k6.last), k8 AS MATERIALIZED (SELECT k7.*, sm.open AS entry, pl AS pl0, ps AS ps0 FROM k7 JOIN sm ON sm.symbol = k7.symbol AND sm.exec_idx = k7.exec_start),
ctl AS MATERIALIZED (SELECT k8.symbol, strategy, replica, t, start, (dir * (sm.close - entry) - ({RULES.cost} + {RULES.cost_rel} * entry) + CASE WHEN dir > 0 THEN pl - pl0 ELSE ps - ps0 END) / (stop_share * entry) AS r
 FROM k8 JOIN sm ON sm.symbol = k8.symbol AND sm.exec_idx = k8.kx)"""
ORACLE = {
    "controls_matched": f"{_CONTROLS} SELECT symbol, strategy, replica::INTEGER AS replica, t, start, round(r, 6) AS r FROM ctl",
    "controls_p": f"""{_CONTROLS}, sn AS (SELECT strategy, count(*) AS n, avg(r) AS v FROM tc GROUP BY 1), nu AS (SELECT strategy, replica, avg(r) AS nv, count(*) AS placed FROM ctl GROUP BY 1, 2)
SELECT strategy, n, round(sum(placed) / (n * count(*)), 6) AS placed_share, round(v, 6) AS mean_r, round(avg(nv), 6) AS control_mean, round((1 + count(*) FILTER (WHERE nv >= v)) / (1 + count(*)), 6) AS p FROM sn JOIN nu USING (strategy) GROUP BY strategy, n, v""",
    "accounts_pooled": f"""{TRADES_SQL}, tc AS MATERIALIZED (SELECT * FROM ch), de AS (SELECT symbol, strategy, day_id, last(equity ORDER BY t) AS eq FROM tc GROUP BY 1, 2, 3),
mv AS (SELECT symbol, strategy, day_id, eq / coalesce(lag(eq) OVER (PARTITION BY symbol, strategy ORDER BY day_id), 1) - 1 AS ret FROM de),
dy AS (SELECT f.symbol, f.strategy, d.day_id FROM (SELECT symbol, strategy, min(day_id) AS first FROM tc GROUP BY 1, 2) f JOIN (SELECT DISTINCT symbol, day_id FROM a) d ON d.symbol = f.symbol AND d.day_id >= f.first),
se AS MATERIALIZED (SELECT symbol || '|' || strategy AS account, day_id, coalesce(ret, 0) AS ret FROM dy FULL JOIN mv USING (symbol, strategy, day_id)),
po AS (SELECT account AS pool, day_id, ret FROM se UNION ALL SELECT 'all, cash', day_id, sum(ret) / (SELECT count(DISTINCT account) FROM se) FROM se GROUP BY day_id UNION ALL SELECT 'all, present', day_id, avg(ret) FROM se GROUP BY day_id),
eq AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY pool ORDER BY day_id)) AS equity FROM po), dd AS (SELECT *, 1 - equity / greatest(1, max(equity) OVER (PARTITION BY pool ORDER BY day_id)) AS d FROM eq)
SELECT pool, count(*) AS days, round(CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt({DAYS_PER_YEAR}) ELSE 0 END, 6) AS sharpe, round(last(equity ORDER BY day_id) - 1, 6) AS total, round(max(d), 6) AS max_dd FROM dd GROUP BY pool""",
}

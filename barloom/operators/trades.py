"""Trades from signals, as sets: what becomes of a candidate depends on its own signal bar only, so all are followed at
once, then the non-overlapping ones are chained, then equity follows.

Order of events on an execution bar: funding, exit signal pending from the bar before (at the open), gap through stop or
target (at the open), touch of the stop (wins ties), touch of the target, trailing stop for the next bar. The last bar
of the holding time exits at its close, or at the window's end.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import ATR_SQL, BASE, _over, full, with_atr
from ..sources.tapes import funding
from ..plans.storage import written
from .bars import bucket, frame_bars, m15_of

#: Exit reasons by code.
REASONS = {1: "STOP", 2: "STOP_GAP", 3: "TARGET", 4: "TARGET_GAP", 5: "TIME", 6: "END", 7: "TRAIL", 8: "SIGNAL"}
DAYS_PER_YEAR = 260
PER = ["symbol", "strategy"]


@dataclass(frozen=True)
class Rules:
    """Costs and sizes that hold for all candidates."""

    cost: float = 0.0
    cost_rel: float = 0.0
    funding_mult: float = 1.0
    risk_frac: float = 0.005
    max_lev: float = 10.0


def execution_bars(m15: DataFrame, frame: str, rates: DataFrame | None = None) -> DataFrame:
    """15-minute bars with the bar_idx of the signal bar they belong to, and the funding paid at a bar's open."""
    bars = frame_bars(m15, frame).select("symbol", "bucket", "bar_idx", "exec_end")
    d = m15.withColumn("bucket", bucket(F.col("ts"), frame)).join(bars, ["symbol", "bucket"])
    d = d.withColumn("is_last", F.col("exec_idx") == F.col("exec_end") - 1)
    if rates is None:
        d = d.withColumn("rate", F.lit(0.0))
    else:
        # a rate is paid once, at the first execution bar of its hour
        w = Window.partitionBy("symbol", "bucket").orderBy("exec_idx")
        d = d.join(rates, ["symbol", "bucket"], "left").withColumn("rate", F.when(F.row_number().over(w) == 1, F.coalesce("rate", F.lit(0.0))).otherwise(0.0))
    return d.select("symbol", "exec_idx", "bar_idx", "is_last", "rate", "open", "high", "low", "close", "day_id")


def paths(bars: DataFrame, execs: DataFrame, signals: DataFrame, rules: Rules, exits: DataFrame | None = None) -> DataFrame:
    """A row per candidate and execution bar of its longest life: at most ``hold`` bars each, by equi-joins.

    signals: symbol, strategy, t, dir, stop, target, hold, trail, delay. bars: symbol, bar_idx, atr, exec_start,
    exec_end, exit_sig; with a column cost_rel, the signal bar's relative cost comes on top of the rules'. exits: symbol,
    strategy, bar_idx of exit signals that hold for one strategy, in place of exit_sig. execs: with a column rate_abs, both
    sides pay it.
    """
    banded = "cost_rel" in bars.columns
    last_bar = bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("t1"))
    c = signals.join(bars.select("symbol", F.col("bar_idx").alias("t"), "atr", *(["cost_rel"] if banded else [])), ["symbol", "t"]).join(last_bar, "symbol").filter("atr > 0")
    c = c.withColumn("e", F.col("t") + 1 + F.col("delay")).filter("e < t1").withColumn("last", F.least(F.col("e") + F.col("hold") - 1, F.col("t1") - 1))
    c = c.withColumn("timed", F.col("e") + F.col("hold") - 1 <= F.col("t1") - 1)
    c = c.join(bars.select("symbol", F.col("bar_idx").alias("e"), F.col("exec_start").alias("k0")), ["symbol", "e"])
    c = c.join(bars.select("symbol", F.col("bar_idx").alias("last"), F.col("exec_end").alias("k1")), ["symbol", "last"])
    c = c.join(execs.select("symbol", F.col("exec_idx").alias("k0"), F.col("open").alias("entry")), ["symbol", "k0"])
    c = c.withColumn("risk", F.col("stop") * F.col("atr")).withColumn("cst", rules.cost + (rules.cost_rel + F.col("cost_rel") if banded else F.lit(rules.cost_rel)) * F.col("entry"))
    c = c.withColumn("frac", F.least(F.lit(rules.risk_frac), rules.max_lev * F.col("risk") / F.col("entry")))
    p = c.withColumn("exec_idx", F.explode(F.sequence("k0", F.col("k1") - 1))).join(execs, ["symbol", "exec_idx"])
    if exits is None:
        p = p.join(bars.select("symbol", "bar_idx", "exit_sig"), ["symbol", "bar_idx"])
    else:
        p = p.join(exits.select(*PER, "bar_idx", F.lit(True).alias("exit_sig")), [*PER, "bar_idx"], "left").withColumn("exit_sig", F.coalesce("exit_sig", F.lit(False)))
    w = Window.partitionBy(*PER, "t").orderBy("exec_idx")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    both = F.col("rate_abs") if "rate_abs" in execs.columns else F.lit(0.0)
    pay = F.when(F.col("exec_idx") > F.col("k0"), (-F.col("dir") * F.col("rate") - both) * F.col("open")).otherwise(0.0)
    p = p.withColumn("pay", pay).withColumn("pay", F.when(F.col("pay") < 0, F.col("pay") * rules.funding_mult).otherwise(F.col("pay")))
    p = p.withColumns(
        {
            "fund": F.sum("pay").over(so_far), "hi": F.max("high").over(before), "lo": F.min("low").over(before),
            "pending": F.coalesce(F.lag(F.col("is_last") & F.col("exit_sig")).over(w), F.lit(False)),
            "stop0": F.col("entry") - F.col("dir") * F.col("stop") * F.col("atr"), "goal": F.col("entry") + F.col("dir") * F.col("target") * F.col("atr"),
        }
    )
    trail = F.col("trail") * F.col("atr")
    moved = F.when(F.col("dir") > 0, F.greatest("stop0", F.greatest("hi", "entry") - trail)).otherwise(F.least("stop0", F.least("lo", "entry") + trail))
    return p.withColumn("level", F.when((F.col("trail") > 0) & F.col("hi").isNotNull(), moved).otherwise(F.col("stop0")))


def outcomes(p: DataFrame) -> DataFrame:
    """The first exit of each candidate."""
    d = F.col("dir")
    beyond = lambda x, y: d * (x - y) <= 0  # noqa: E731  x at y or on the losing side of it
    bad, good = F.when(d > 0, F.col("low")).otherwise(F.col("high")), F.when(d > 0, F.col("high")).otherwise(F.col("low"))
    over = (F.col("exec_idx") == F.col("k1") - 1)
    why = (
        F.when(F.col("pending"), 8).when(beyond(F.col("open"), F.col("level")), 2).when(beyond(F.col("goal"), F.col("open")), 4)
        .when(beyond(bad, F.col("level")), F.when(F.col("level") == F.col("stop0"), 1).otherwise(7)).when(beyond(F.col("goal"), good), 3)
        .when(over, F.when(F.col("timed"), 5).otherwise(6))
    )
    p = p.withColumn("why", why).withColumn("bad", bad).filter("why is not null")
    px = F.expr("case when why in (8, 2, 4) then open when why in (1, 7) then level when why = 3 then goal else close end")
    row = F.struct(F.col("exec_idx").alias("xk"), F.col("bar_idx").alias("x"), "day_id", "why", px.alias("px"), "fund", "bad")
    first = p.groupBy(*PER, "t").agg(F.min_by(row, "exec_idx").alias("o"), *[F.first(c).alias(c) for c in ("dir", "e", "entry", "risk", "cst", "frac")])
    return first.select(*PER, "t", "dir", "e", "entry", "risk", "cst", "frac", "o.*").withColumn("r", (F.col("dir") * (F.col("px") - F.col("entry")) - F.col("cst") + F.col("fund")) / F.col("risk"))


def chained(found: DataFrame) -> DataFrame:
    """The trades of one position at a time: the next signal counts from the exit bar on. One linear pass per strategy
    and symbol, which also carries equity, its peak and the run of losses."""
    schema = found.schema.simpleString()[7:-1].replace(":", " ") + ", equity_before double, equity double, drawdown double, losses int"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        keep, more, free, eq, peak, run = [], [], -1, 1.0, 1.0, 0
        for i, (t, x, r, f) in enumerate(zip(pdf["t"], pdf["x"], pdf["r"], pdf["frac"])):
            if t >= free:
                free, before = x, eq
                eq *= max(0.0, 1 + f * r)  # an account that loses all stays at 0
                peak = max(peak, eq)
                run = run + 1 if r < 0 else 0
                keep.append(i)
                more.append((before, eq, 1 - eq / peak, run))
        return pd.concat([pdf.iloc[keep].reset_index(drop=True), pd.DataFrame(more, columns=["equity_before", "equity", "drawdown", "losses"])], axis=1)

    return found.groupBy(*PER).applyInPandas(walk, schema)


def marked_drawdown(trades: DataFrame, p: DataFrame) -> DataFrame:
    """Largest drawdown per strategy with open positions at their worst of each bar, against the peak of close marks."""
    rows = p.select(*PER, "t", "exec_idx", "low", "high", "close", F.col("fund").alias("f")).join(trades, [*PER, "t"]).filter("exec_idx <= xk")
    at = F.col("exec_idx") == F.col("xk")
    worst = F.when(F.col("dir") > 0, F.col("low")).otherwise(F.col("high"))
    adverse = F.when(at & F.col("why").isin(1, 2, 4, 7, 8), F.col("px")).otherwise(worst)
    mark = lambda price: F.col("equity_before") * (1 + F.col("frac") * (F.col("dir") * (price - F.col("entry")) - F.col("cst") + F.col("f")) / F.col("risk"))
    rows = rows.withColumn("peak_event", F.when(at, F.col("equity")).otherwise(mark(F.col("close")))).withColumn("low_mark", mark(adverse))
    w = Window.partitionBy(*PER).orderBy("t", "exec_idx").rowsBetween(Window.unboundedPreceding, -1)
    peak = F.greatest(F.lit(1.0), F.max("peak_event").over(w))
    rows = rows.withColumn("peak", peak)
    dd = F.greatest(1 - F.col("low_mark") / F.col("peak"), F.when(at, 1 - F.col("equity") / F.greatest("peak", "equity")).otherwise(0.0))
    return rows.withColumn("dd", dd).groupBy(*PER).agg(F.greatest(F.lit(0.0), F.max("dd")).alias("mtm_drawdown"))


def metrics(trades: DataFrame, days: DataFrame) -> DataFrame:
    """Per strategy and symbol: counts, sums of R, equity, drawdown, daily Sharpe over all trading days, streaks."""
    by_day = trades.groupBy(*PER, "day_id").agg(F.max_by("equity", "t").alias("eq"))
    w = Window.partitionBy(*PER).orderBy("day_id")
    by_day = by_day.withColumn("ret", F.col("eq") / F.coalesce(F.lag("eq").over(w), F.lit(1.0)) - 1)
    by_day = by_day.groupBy(*PER).agg(F.sum("ret").alias("s1"), F.sum(F.col("ret") * F.col("ret")).alias("s2")).join(days, "symbol")
    mean = F.col("s1") / F.col("n_days")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n_days") - mean * mean))
    sharpe = by_day.select(*PER, "n_days", F.when(sd > 0, mean / sd * DAYS_PER_YEAR**0.5).otherwise(0.0).alias("sharpe"))
    r = F.col("r")
    m = trades.groupBy(*PER).agg(
        F.count("*").alias("n"), F.count_if(r > 0).alias("wins"), F.sum(r).alias("sum_r"), F.sum(r * r).alias("sum_r2"), F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gross_win"),
        F.sum(F.when(r < 0, -r).otherwise(0.0)).alias("gross_loss"), F.max_by("equity", "t").alias("equity"), F.max("drawdown").alias("max_dd"),
        F.sum(F.col("x") - F.col("e") + 1).alias("bars_held"), F.max("losses").cast("long").alias("max_losses"),
    )
    return m.join(sharpe, PER)


def with_ratios(m: DataFrame) -> DataFrame:
    """mean_r, t statistic (population variance), win rate and profit factor; the factor is null without losses."""
    mean = F.col("sum_r") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("sum_r2") / F.col("n") - mean * mean)
    return m.withColumns({"mean_r": mean, "t_stat": F.when(var > 0, mean / F.sqrt(var) * F.sqrt("n")), "win_rate": F.col("wins") / F.col("n"), "profit_factor": F.try_divide("gross_win", "gross_loss")})


SPECS = [("long_breakout", 1, 1.5, 2.0, 24, 0.0, 0), ("short_breakdown", -1, 1.0, 3.0, 12, 1.5, 1), ("long_follow", 1, 2.0, 4.0, 48, 2.0, 2)]
RULES = Rules(cost=0.05, cost_rel=0.001, funding_mult=1.5, risk_frac=0.005, max_lev=5.0)


def breakouts(bars: DataFrame) -> DataFrame:
    """Bars with ATR, breaks of the last 20 bars' range (up, down) and a close near their mean as exit signal."""
    b = with_atr(bars)
    mean = full(F.avg("close").over(_over(20)), 20)
    b = b.withColumns({"up": F.col("close") > full(F.max("high").over(_over(20, 1)), 20, "high", 1), "down": F.col("close") < full(F.min("low").over(_over(20, 1)), 20, "low", 1), "mean": mean})
    return b.withColumns({"exit_sig": F.coalesce(F.abs(F.col("close") - F.col("mean")) < 0.05 * F.col("atr"), F.lit(False))})


def spec_signals(bars: DataFrame) -> DataFrame:
    """Signals of ``SPECS`` on bars with breakouts."""
    names = ("strategy", "dir", "stop", "target", "hold", "trail", "delay")
    specs = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, s)]) for s in SPECS])
    fires = F.when(F.col("dir") > 0, F.col("up")).otherwise(F.col("down"))
    return bars.select("symbol", F.col("bar_idx").alias("t"), "up", "down", F.inline(specs)).filter(fires).drop("up", "down")


def _world(spark, sf_dir: str, own_bars: bool = False):
    """Bars with ATR and signals, execution bars and specs of the queries. Bars are written once: candidates, paths and
    metrics each read them, and the tape is scanned for them only here."""
    m15 = written(m15_of(spark, sf_dir))
    b = breakouts(frame_bars(m15, "h1"))
    if own_bars:
        b = b.withColumns({"exec_start": F.col("bar_idx"), "exec_end": F.col("bar_idx") + 1})
    b = written(b)
    signals = spec_signals(b)
    if own_bars:
        execs = b.select("symbol", F.col("bar_idx").alias("exec_idx"), "bar_idx", F.lit(True).alias("is_last"), F.lit(0.0).alias("rate"), "open", "high", "low", "close", "day_id")
    else:
        execs = written(execution_bars(m15, "h1", funding(spark, sf_dir)))
    return b, execs, signals


def _rounded(d: DataFrame) -> DataFrame:
    return d.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


def trades_outcomes(spark, sf_dir: str) -> DataFrame:
    o = outcomes(paths(*_world(spark, sf_dir), RULES))
    return _rounded(o.select(*PER, "t", "x", "xk", "why", "px", "r"))


def trades_chain(spark, sf_dir: str) -> DataFrame:
    o = chained(outcomes(paths(*_world(spark, sf_dir), RULES)))
    return _rounded(o.select(*PER, "t", "x", "why", "r", "equity", "losses"))


def trades_metrics(spark, sf_dir: str) -> DataFrame:
    b, execs, signals = _world(spark, sf_dir)
    p = written(paths(b, execs, signals, RULES))
    t = written(chained(outcomes(p)))
    days = b.groupBy("symbol").agg(F.count_distinct("day_id").alias("n_days"))
    return _rounded(with_ratios(metrics(t, days)).join(marked_drawdown(t, p), PER))


def flagship_breakout(spark, sf_dir: str) -> DataFrame:
    """Breakouts on hourly bars, executed on the same bars without costs: trades, mean R, profit factor and equity."""
    b, execs, signals = _world(spark, sf_dir, own_bars=True)
    t = chained(outcomes(paths(b, execs, signals.filter("strategy = 'long_breakout'"), Rules())))
    m = t.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.try_divide(F.sum(F.when(F.col("r") > 0, F.col("r"))), F.sum(F.when(F.col("r") < 0, -F.col("r")))).alias("profit_factor"), F.max_by("equity", "t").alias("equity"))
    return _rounded(m)


QUERIES = {"flagship_breakout": flagship_breakout, "trades_outcomes": trades_outcomes, "trades_chain": trades_chain, "trades_metrics": trades_metrics}


_W = lambda n, b="CURRENT ROW": f"OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n} PRECEDING AND {b})"
BREAKOUTS_SQL = f"""sg AS (SELECT *, CASE WHEN bar_idx >= 20 THEN close > max(high) {_W(20, '1 PRECEDING')} END AS up, CASE WHEN bar_idx >= 20 THEN close < min(low) {_W(20, '1 PRECEDING')} END AS down,
 coalesce(CASE WHEN bar_idx >= 19 THEN abs(close - avg(close) {_W(19)}) < 0.05 * atr END, false) AS exit_sig, max(bar_idx) OVER (PARTITION BY symbol) + 1 AS t1 FROM a)"""
#: Hourly rates fu, and execution bars ex of the bars a.
EXECS_SQL = """fu AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS bucket, first((json_extract_string(props, '$.k')::DOUBLE - 50) / 1e5 ORDER BY ts, event_id) AS rate FROM events WHERE hour(ts) % 8 = 0 GROUP BY 1, 2),
ex AS (SELECT m.symbol, m.exec_idx, a.bar_idx, m.exec_idx = a.exec_end - 1 AS is_last, CASE WHEN m.exec_idx = a.exec_start THEN coalesce(fu.rate, 0) ELSE 0 END AS rate, m.open, m.high, m.low, m.close, m.day_id
 FROM m15 m JOIN a ON m.symbol = a.symbol AND m.exec_idx >= a.exec_start AND m.exec_idx < a.exec_end LEFT JOIN fu ON fu.symbol = a.symbol AND fu.bucket = a.bucket)"""


def followed_sql(rules: Rules, own: bool = False, leaving: str = "sg.exit_sig", joined: str = "JOIN sg ON sg.symbol = ex.symbol AND sg.bar_idx = ex.bar_idx", cost: str = "", both: str = "0") -> str:
    """From candidates c0 over bars a and execution bars ex to chained trades ch."""
    k0, k1 = ("b.bar_idx", "b.bar_idx + 1") if own else ("b.exec_start", "b.exec_end")
    cst = f"{rules.cost} + ({rules.cost_rel}{cost}) * ex.open"
    return f"""c1 AS (SELECT c0.*, least(e + hold - 1, t1 - 1) AS last, e + hold - 1 <= t1 - 1 AS timed FROM c0 WHERE e < t1),
c2 AS (SELECT c1.*, {k0} AS k0 FROM c1 JOIN a b ON b.symbol = c1.symbol AND b.bar_idx = c1.e),
c3 AS (SELECT c2.*, {k1} AS k1 FROM c2 JOIN a b ON b.symbol = c2.symbol AND b.bar_idx = c2.last),
c AS (SELECT c3.*, ex.open AS entry, stop * atr AS risk, {cst} AS cst, least({rules.risk_frac}, {rules.max_lev} * stop * atr / ex.open) AS frac, ex.open - dir * stop * atr AS stop0, ex.open + dir * target * atr AS goal
 FROM c3 JOIN ex ON ex.symbol = c3.symbol AND ex.exec_idx = k0),
p0 AS (SELECT c.*, ex.exec_idx, ex.bar_idx, is_last AND {leaving} AS leaving, ex.open, ex.high, ex.low, ex.close, ex.day_id, CASE WHEN ex.exec_idx > k0 THEN (-dir * rate - {both}) * ex.open ELSE 0 END AS pay
 FROM c JOIN ex ON ex.symbol = c.symbol AND ex.exec_idx BETWEEN k0 AND k1 - 1 {joined}),
p1 AS (SELECT *, sum(CASE WHEN pay < 0 THEN pay * {rules.funding_mult} ELSE pay END) OVER s AS fund, max(high) OVER u AS hi, min(low) OVER u AS lo, coalesce(lag(leaving) OVER s, false) AS pending FROM p0
 WINDOW s AS (PARTITION BY symbol, strategy, t ORDER BY exec_idx), u AS (PARTITION BY symbol, strategy, t ORDER BY exec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, CASE WHEN trail = 0 OR hi IS NULL THEN stop0 WHEN dir > 0 THEN greatest(stop0, greatest(hi, entry) - trail * atr) ELSE least(stop0, least(lo, entry) + trail * atr) END AS level FROM p1),
y AS (SELECT *, CASE WHEN pending THEN 8 WHEN dir * (open - level) <= 0 THEN 2 WHEN dir * (goal - open) <= 0 THEN 4
 WHEN dir * (CASE WHEN dir > 0 THEN low ELSE high END - level) <= 0 THEN CASE WHEN level = stop0 THEN 1 ELSE 7 END WHEN dir * (goal - CASE WHEN dir > 0 THEN high ELSE low END) <= 0 THEN 3
 WHEN exec_idx = k1 - 1 THEN CASE WHEN timed THEN 5 ELSE 6 END END AS why FROM p),
z AS (SELECT *, row_number() OVER (PARTITION BY symbol, strategy, t ORDER BY exec_idx) AS nth, CASE WHEN why IN (8, 2, 4) THEN open WHEN why IN (1, 7) THEN level WHEN why = 3 THEN goal ELSE close END AS px FROM y WHERE why IS NOT NULL),
o AS (SELECT symbol, strategy, t, e, dir, entry, risk, cst, frac, exec_idx AS xk, bar_idx AS x, day_id, why, px, fund, (dir * (px - entry) - cst + fund) / risk AS r FROM z WHERE nth = 1),
nx AS (SELECT o.*, q.t AS following FROM o ASOF LEFT JOIN (SELECT symbol, strategy, t FROM o) q ON o.symbol = q.symbol AND o.strategy = q.strategy AND o.x <= q.t),
ch AS (SELECT nx.*, 1.0::DOUBLE AS equity_before, 1 + frac * r AS equity, CASE WHEN r < 0 THEN 1 ELSE 0 END AS losses FROM nx WHERE (symbol, strategy, t) IN (SELECT (symbol, strategy, min(t)) FROM nx GROUP BY symbol, strategy)
 UNION ALL SELECT nx.*, ch.equity, ch.equity * (1 + nx.frac * nx.r), CASE WHEN nx.r < 0 THEN ch.losses + 1 ELSE 0 END FROM ch JOIN nx ON nx.symbol = ch.symbol AND nx.strategy = ch.strategy AND nx.t = ch.following)"""


def _world_sql(own: bool, rules: Rules) -> str:
    specs = ", ".join(f"('{s}', {d}, {a}, {b}, {h}, {tr}, {de})" for s, d, a, b, h, tr, de in (SPECS[:1] if own else SPECS))
    ex = (
        "ex AS (SELECT symbol, bar_idx AS exec_idx, bar_idx, true AS is_last, 0.0 AS rate, open, high, low, close, day_id FROM a)"
        if own
        else EXECS_SQL
    )
    return f"""{BASE}, {ATR_SQL},
{BREAKOUTS_SQL},
sp(strategy, dir, stop, target, hold, trail, delay) AS (VALUES {specs}), {ex},
c0 AS (SELECT sg.symbol, strategy, bar_idx AS t, dir, stop, target, hold, trail, atr, t1, bar_idx + 1 + delay AS e FROM sg, sp WHERE atr > 0 AND CASE WHEN dir > 0 THEN up ELSE down END), {followed_sql(rules, own)}"""



_MET = f"""{_world_sql(False, RULES)},
dd AS (SELECT *, 1 - equity / greatest(1, max(equity) OVER (PARTITION BY symbol, strategy ORDER BY t)) AS drawdown FROM ch),
de AS (SELECT symbol, strategy, day_id, last(equity ORDER BY t) AS eq FROM ch GROUP BY 1, 2, 3),
dr AS (SELECT *, eq / coalesce(lag(eq) OVER (PARTITION BY symbol, strategy ORDER BY day_id), 1) - 1 AS ret FROM de),
nd AS (SELECT symbol, count(DISTINCT day_id) AS n_days FROM a GROUP BY symbol),
sh AS (SELECT symbol, strategy, n_days, sum(ret) / n_days AS mean, sqrt(greatest(0, sum(ret * ret) / n_days - (sum(ret) / n_days) ** 2)) AS sd FROM dr JOIN nd USING (symbol) GROUP BY symbol, strategy, n_days),
ag AS (SELECT symbol, strategy, count(*) AS n, count(*) FILTER (WHERE r > 0) AS wins, sum(r) AS sum_r, sum(r * r) AS sum_r2, sum(greatest(r, 0)) AS gross_win, sum(greatest(-r, 0)) AS gross_loss, last(equity ORDER BY t) AS equity,
 max(drawdown) AS max_dd, sum(x - e + 1)::BIGINT AS bars_held, max(losses)::BIGINT AS max_losses FROM dd GROUP BY 1, 2),
mk AS (SELECT ch.*, p.exec_idx, p.exec_idx = ch.xk AS at_exit, p.close AS c, p.fund AS f, CASE WHEN p.exec_idx = ch.xk AND ch.why IN (1, 2, 4, 7, 8) THEN ch.px WHEN ch.dir > 0 THEN p.low ELSE p.high END AS adverse FROM ch JOIN p ON p.symbol = ch.symbol AND p.strategy = ch.strategy AND p.t = ch.t AND p.exec_idx <= ch.xk),
mm AS (SELECT *, CASE WHEN at_exit THEN equity ELSE equity_before * (1 + frac * (dir * (c - entry) - cst + f) / risk) END AS pe, equity_before * (1 + frac * (dir * (adverse - entry) - cst + f) / risk) AS lm FROM mk),
mp AS (SELECT *, greatest(1, max(pe) OVER (PARTITION BY symbol, strategy ORDER BY t, exec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS peak FROM mm),
md AS (SELECT symbol, strategy, greatest(0, max(greatest(1 - lm / peak, CASE WHEN at_exit THEN 1 - equity / greatest(peak, equity) ELSE 0 END))) AS mtm_drawdown FROM mp GROUP BY 1, 2)"""
ORACLE = {
    "flagship_breakout": f"{_world_sql(True, Rules())} SELECT symbol, count(*) AS n, round(avg(r), 6) AS mean_r, round(sum(r) FILTER (WHERE r > 0) / sum(-r) FILTER (WHERE r < 0), 6) AS profit_factor, round(last(equity ORDER BY t), 6) AS equity FROM ch GROUP BY symbol",
    "trades_outcomes": f"{_world_sql(False, RULES)} SELECT symbol, strategy, t, x, xk, why, round(px, 6) AS px, round(r, 6) AS r FROM o",
    "trades_chain": f"{_world_sql(False, RULES)} SELECT symbol, strategy, t, x, why, round(r, 6) AS r, round(equity, 6) AS equity, losses FROM ch",
    "trades_metrics": f"""{_MET} SELECT symbol, strategy, n, wins, round(sum_r, 6) AS sum_r, round(sum_r2, 6) AS sum_r2, round(gross_win, 6) AS gross_win, round(gross_loss, 6) AS gross_loss, round(equity, 6) AS equity, round(max_dd, 6) AS max_dd, bars_held, max_losses,
 n_days, round(CASE WHEN sd > 0 THEN mean / sd * sqrt(260) ELSE 0 END, 6) AS sharpe, round(sum_r / n, 6) AS mean_r, round(CASE WHEN sum_r2 / n > (sum_r / n) ** 2 THEN sum_r / n / sqrt(sum_r2 / n - (sum_r / n) ** 2) * sqrt(n) END, 6) AS t_stat, round(wins / n, 6) AS win_rate, round(gross_win / nullif(gross_loss, 0), 6) AS profit_factor, round(mtm_drawdown, 6) AS mtm_drawdown
 FROM ag JOIN sh USING (symbol, strategy) JOIN md USING (symbol, strategy)""",
}

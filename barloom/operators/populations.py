"""Many strategies at once: signals by bitmaps, outcomes by levels, chains per strategy and window.

What becomes of a candidate depends on its bar, its direction and its exits only. So for each bar, direction, stop and target
of the grid, one pass over the bars that follow finds the first execution bar that touches the level (``levels``). A
candidate's exit is then the earliest of its stop, its target, the end of its holding time and the end of the window, looked
up by one equi-join, however many strategies share it. Payments are differences of running sums, one per direction.

Strategies and windows are tables too. A window is [t0, t1): signals and entries lie inside, and what is open at its end
leaves at the last close. Costs don't move exits, so several cost multiples share one chain.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import ATR_SQL, BASE, feature_table, with_atr
from ..functions.predicates import HOLDS, STOPS, TARGETS, Strategy, catalogue, signal_bitmaps
from ..functions import features as ft
from ..plans.storage import written
from ..sources.tapes import daily_trades, funding
from .bars import frame_bars, frame_sql, m15_of, tick_bars
from .stats import EULER, normal_cdf_sql, normal_quantile_sql
from .trades import Rules, execution_bars

EACH = ["symbol", "strategy", "window"]
#: Variances up to this one count as none.
LEAST_VAR = 1e-13
#: Nights charged at the midnight bar of Tuesday to Friday (ISO days); Thursday's is the weekend's.
NIGHTS = {2: 1.0, 3: 1.0, 4: 3.0, 5: 1.0}


# signals ------------------------------------------------------------------------------------------------------------
def strategy_table(spark, strategies: list[Strategy], names: list[str] | None = None) -> DataFrame:
    """strategy, symbol (null: all), predicates (catalogue numbers), dir, stop, target, hold. A population is a driver list by
    nature: its size is a parameter of the search."""
    number = {p: i for i, p in enumerate(catalogue())}
    rows = [(n, s.symbol or None, [number[p] for p in s.predicates], s.direction, s.stop, s.target, s.hold) for n, s in zip(names or [s.hash() for s in strategies], strategies)]
    return spark.createDataFrame(rows, "strategy string, symbol string, predicates array<int>, dir int, stop double, target double, hold int")


def catalogue_bitmaps(features: DataFrame, tradable) -> DataFrame:
    """Bitmaps of the catalogue's predicates on bars that may be traded."""
    return signal_bitmaps(features.filter(tradable), catalogue())


def _positions(batches):
    for pdf in batches:
        # bucket k > 0 starts with number 32768 (k - 1) + 1; number 0 has a bucket of its own
        at = [np.flatnonzero(np.unpackbits(np.frombuffer(b, "uint8"), bitorder="little")) + ((k - 1) * 32768 + 1 if k > 0 else 0) for b, k in zip(pdf["bits"], pdf["bucket"])]
        n = [len(a) for a in at]
        yield pd.DataFrame({"symbol": np.repeat(pdf["symbol"], n), "strategy": np.repeat(pdf["strategy"], n), "t": np.concatenate(at) if at else np.zeros(0, "int64")})


def signals(bitmaps: DataFrame, strategies: DataFrame) -> DataFrame:
    """symbol, strategy, t: bars where all predicates of a strategy hold, 64 bars a step."""
    want = strategies.select("strategy", F.col("symbol").alias("only"), F.size("predicates").alias("n"), F.explode("predicates").alias("predicate"))
    both = bitmaps.join(want, "predicate").filter("only is null or only = symbol")
    all_of = both.groupBy("symbol", "strategy", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("k"), F.first("n").alias("n"))
    return all_of.filter("k = n and bitmap_count(bits) > 0").select("symbol", "strategy", "bucket", "bits").mapInPandas(_positions, "symbol string, strategy string, t long")


# outcomes -----------------------------------------------------------------------------------------------------------
def paid(execs: DataFrame, funding_mult: float = 1.0) -> DataFrame:
    """``execs`` with running sums of payments, for longs and shorts. rate: a long pays and a short gets it; rate_abs
    (if there is one): both pay. What is paid counts ``funding_mult`` times."""
    both = F.col("rate_abs") if "rate_abs" in execs.columns else F.lit(0.0)
    w = Window.partitionBy("symbol").orderBy("exec_idx").rowsBetween(Window.unboundedPreceding, 0)
    for name, d in (("paid_long", 1), ("paid_short", -1)):
        pay = (-d * F.col("rate") - both) * F.col("open")
        execs = execs.withColumn(name, F.sum(F.when(pay < 0, pay * funding_mult).otherwise(pay)).over(w))
    return execs


def swap_rates(execs: DataFrame, ts, long_pips: float, short_pips: float, pip: float) -> DataFrame:
    """``execs`` with the nightly costs of a position as rate and rate_abs, paid at midnight bars; positive pips are paid."""
    nights = F.coalesce(F.create_map(*[F.lit(x) for kv in NIGHTS.items() for x in kv])[F.weekday(ts) + 1], F.lit(0.0))
    nights = F.when((F.hour(ts) == 0) & (F.minute(ts) == 0), nights).otherwise(0.0) * pip / F.col("open")
    return execs.withColumns({"rate": nights * (long_pips - short_pips) / 2, "rate_abs": nights * (long_pips + short_pips) / 2})


def levels(bars: DataFrame, execs: DataFrame, delay: int = 0) -> DataFrame:
    """For each bar with an entry ``1 + delay`` bars later: entry, first touches of every stop and target of the grid as
    arrays of exec_idx (null: not within the longest holding time), ends of the holding times."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    end = F.max("exec_end").over(Window.partitionBy("symbol"))
    ends = F.array(*[F.coalesce(F.lead("exec_end", delay + h).over(w), end) for h in HOLDS])
    c = bars.select("symbol", F.col("bar_idx").alias("t"), "atr", F.lead("exec_start", 1 + delay).over(w).alias("k0"), F.lead("open", 1 + delay).over(w).alias("entry"), ends.alias("ends"))
    c = c.filter("k0 is not null and atr > 0")
    p = c.select("symbol", "t", "atr", "entry", F.explode(F.sequence("k0", F.element_at("ends", -1) - 1)).alias("exec_idx"))
    p = p.join(execs.select("symbol", "exec_idx", "low", "high"), ["symbol", "exec_idx"])
    sides = {}
    for side, bad, good, d in (("long", "low", "high", 1), ("short", "high", "low", -1)):
        for kind, grid, col, s in (("stop", STOPS, bad, -d), ("target", TARGETS, good, d)):
            for i, m in enumerate(grid):
                level = F.col("entry") + s * (F.lit(m) * F.col("atr"))
                sides[f"{side}_{kind}_{i}"] = F.min(F.when(F.col(col) <= level if (col == "low") else F.col(col) >= level, F.col("exec_idx")))
    first = p.groupBy("symbol", "t").agg(*[v.alias(k) for k, v in sides.items()])
    arrays = [F.array(*[f"{side}_{kind}_{i}" for i in range(n)]).alias(f"{side}_{kind}") for side in ("long", "short") for kind, n in (("stop", len(STOPS)), ("target", len(TARGETS)))]
    return c.join(first.select("symbol", "t", *arrays), ["symbol", "t"])


def windows_of(bars: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """symbol, window, t0, t1, k_end, n_days. spans: window, first and last day_date (end exclusive) over bars with a
    column day_date; without spans, one window of all bars."""
    d = bars.select("symbol", "bar_idx", "exec_end", "day_id", *(["day_date"] if spans is not None else []))
    d = d.withColumn("window", F.lit("all")) if spans is None else d.join(F.broadcast(spans), (F.col("day_date") >= F.col("first")) & (F.col("day_date") < F.col("last")))
    return d.groupBy("symbol", "window").agg(F.min("bar_idx").alias("t0"), (F.max("bar_idx") + 1).alias("t1"), F.max("exec_end").alias("k_end"), (F.max("day_id") - F.min("day_id") + 1).alias("n_days"))


def candidates(signal: DataFrame, strategies: DataFrame, level: DataFrame, execs: DataFrame, windows: DataFrame, rules: Rules, delay: int = 0, costs: tuple[float, ...] = (1.0,)) -> DataFrame:
    """What becomes of every signal in every window: x (bar), xk (execution bar), day_id, why, px, frac and an R for each
    cost multiple (r_0, r_1, ...)."""
    at = lambda grid, c: F.array_position(F.array(*[F.lit(float(v)) for v in grid]), F.col(c)).cast("int")
    spec = strategies.select("strategy", "dir", "stop", "target", "hold", at(STOPS, "stop").alias("i"), at(TARGETS, "target").alias("j"), at(HOLDS, "hold").alias("h"))
    inside = windows.select("symbol", F.explode(F.filter(F.sequence(F.col("t0"), F.greatest(F.col("t0"), F.col("t1") - 2 - delay)), lambda t: t <= F.col("t1") - 2 - delay)).alias("t"), F.struct("window", "t1", "k_end").alias("w"))
    inside = inside.groupBy("symbol", "t").agg(F.collect_list("w").alias("ws"))  # a bar's windows, so a signal meets its own only
    c = signal.join(level, ["symbol", "t"]).join(inside, ["symbol", "t"]).join(spec, "strategy").select("*", F.inline("ws")).drop("ws")
    up = F.col("dir") > 0
    k_stop, k_target = (F.element_at(F.when(up, F.col(f"long_{k}")).otherwise(F.col(f"short_{k}")), F.col(n)) for k, n in (("stop", "i"), ("target", "j")))
    timed = F.element_at("ends", F.col("h"))
    c = c.select(
        *EACH, "t", "dir", "entry", "k0", (F.col("t") + 1 + delay).alias("e"), (F.col("stop") * F.col("atr")).alias("risk"), k_stop.alias("k_stop"), k_target.alias("k_target"),
        (F.least(timed, F.col("k_end")) - 1).alias("k_last"), (F.col("t") + delay + F.col("hold") <= F.col("t1") - 1).alias("timed"),
        (F.col("entry") - F.col("dir") * (F.col("stop") * F.col("atr"))).alias("stop_px"), (F.col("entry") + F.col("dir") * (F.col("target") * F.col("atr"))).alias("goal"),
    )
    c = c.withColumn("xk", F.least("k_stop", "k_target", "k_last"))
    x = execs.select("symbol", F.col("exec_idx").alias("xk"), F.col("bar_idx").alias("x"), "open", "close", "day_id", F.col("paid_long").alias("pl"), F.col("paid_short").alias("ps"))
    start = execs.select("symbol", F.col("exec_idx").alias("k0"), F.col("paid_long").alias("pl0"), F.col("paid_short").alias("ps0"))
    c = c.join(x, ["symbol", "xk"]).join(start, ["symbol", "k0"])
    stopped, met = F.col("xk") == F.col("k_stop"), F.col("xk") == F.col("k_target")
    why = (
        F.when(stopped & (F.col("dir") * (F.col("open") - F.col("stop_px")) <= 0), 2).when(met & (F.col("dir") * (F.col("goal") - F.col("open")) <= 0), 4)
        .when(stopped, 1).when(met, 3).when(F.col("timed"), 5).otherwise(6)
    )
    c = c.withColumn("why", why)
    px = F.expr("case when why in (2, 4) then open when why = 1 then stop_px when why = 3 then goal else close end")
    fund = F.when(up, F.col("pl") - F.col("pl0")).otherwise(F.col("ps") - F.col("ps0"))
    c = c.withColumns({"px": px, "fund": fund, "cst": rules.cost + rules.cost_rel * F.col("entry"), "frac": F.least(F.lit(rules.risk_frac), rules.max_lev * F.col("risk") / F.col("entry"))})
    r = [((F.col("dir") * (F.col("px") - F.col("entry")) - m * F.col("cst") + F.col("fund")) / F.col("risk")).alias(f"r_{i}") for i, m in enumerate(costs)]
    return c.select(*EACH, "t", "e", "x", "xk", "day_id", "why", "px", "frac", *r)


def taken(found: DataFrame) -> DataFrame:
    """The candidates that one position at a time takes: the next signal counts from the exit bar on. One pass over the
    ordered rows of a partition carries nothing but the bar from which a position is free again, so groups may be many
    or long and cost nothing by themselves."""

    def walk(batches):
        last, free = None, -1
        for pdf in batches:
            keep = []
            for i, (g, t, x) in enumerate(zip(pdf["g"].tolist(), pdf["t"].tolist(), pdf["x"].tolist())):
                if g != last:
                    last, free = g, -1
                if t >= free:
                    free = max(x, t + 1)
                    keep.append(i)
            yield pdf.iloc[keep].drop(columns="g")

    one = found.withColumn("g", F.concat_ws("\n", *EACH)).repartition(*EACH).sortWithinPartitions("g", "t")
    return one.mapInPandas(walk, found.schema)


def compounded(gain, so_far):
    """Equity after each gain of a window from its start on: a product, so its logarithm is a running sum. An account that loses
    all stays at 0."""
    lost = F.coalesce(F.max((gain <= -1).cast("int")).over(so_far), F.lit(0)) == 1
    return F.when(lost, 0.0).otherwise(F.exp(F.coalesce(F.sum(F.when(gain > -1, F.log1p(gain))).over(so_far), F.lit(0.0))))


def daily_accounts(trades: DataFrame, key: list[str] = EACH, r: str = "r_0") -> DataFrame:
    """key, day_id, ret: relative changes of each account's equity on the days with an exit."""
    d = trades.withColumn("equity", compounded(F.col("frac") * F.col(r), Window.partitionBy(*key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.groupBy(*key, "day_id").agg(F.max_by("equity", "t").alias("eq"))
    before = F.coalesce(F.lag("eq").over(Window.partitionBy(*key).orderBy("day_id")), F.lit(1.0))
    return d.select(*key, "day_id", F.coalesce(F.try_divide("eq", before) - 1, F.lit(0.0)).alias("ret"))


def daily_moments(daily: DataFrame, windows: DataFrame, key: list[str] = EACH) -> DataFrame:
    """key, n (days of the window), sharpe (a day), skew, kurt of the daily returns, flat days included: as ``stats.moments``, but
    from sums of the days that moved."""
    x = F.col("ret")
    m = daily.groupBy(*key).agg(*[F.sum(F.pow(x, F.lit(i))).alias(f"s{i}") for i in (1, 2, 3, 4)]).join(windows.select("symbol", "window", F.col("n_days").alias("n")), ["symbol", "window"])
    a, b, c, d = (F.col(f"s{i}") / F.col("n") for i in (1, 2, 3, 4))
    m = m.withColumns({"mu": a, "m2": b - a * a, "m3": c - 3 * a * b + 2 * a * a * a, "m4": d - 4 * a * c + 6 * a * a * b - 3 * a * a * a * a})
    ok = (F.col("n") >= 2) & (F.col("m2") > LEAST_VAR)
    sd = F.sqrt("m2")
    return m.select(*key, "n", F.when(ok, F.col("mu") / sd).otherwise(0.0).alias("sharpe"), F.when(ok, F.col("m3") / (F.col("m2") * sd)).otherwise(0.0).alias("skew"), F.when(ok, F.col("m4") / (F.col("m2") * F.col("m2"))).otherwise(3.0).alias("kurt"))


def population_metrics(trades: DataFrame, windows: DataFrame, costs: tuple[float, ...] = (1.0,), days_per_year: int = 260) -> DataFrame:
    """Per symbol, strategy, window and cost multiple: n, wins, sums of R, equity, largest drawdown of closed equity, Sharpe
    of daily returns over the window's trading days, bars held, longest run of losses, mean_r, t_stat, profit factor."""
    each = F.array(*[F.struct(F.lit(m).alias("cost"), F.col(f"r_{i}").alias("r")) for i, m in enumerate(costs)])
    d = trades.select(*EACH, "t", "e", "x", "day_id", "frac", F.inline(each))
    key = [*EACH, "cost"]
    w = Window.partitionBy(*key).orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("equity", compounded(F.col("frac") * F.col("r"), so_far))
    run = F.sum(F.when(F.col("r") < 0, 0).otherwise(1)).over(so_far)
    d = d.withColumns({"drawdown": 1 - F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(so_far)), "run": run})
    d = d.withColumn("losses", F.sum(F.when(F.col("r") < 0, 1).otherwise(0)).over(Window.partitionBy(*key, "run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    r = F.col("r")
    m = d.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if(r > 0).alias("wins"), F.sum(r).alias("sum_r"), F.sum(r * r).alias("sum_r2"), F.sum(F.greatest(r, F.lit(0.0))).alias("gross_win"), F.sum(F.greatest(-r, F.lit(0.0))).alias("gross_loss"),
        F.max_by("equity", "t").alias("equity"), F.max("drawdown").alias("max_dd"), F.sum(F.col("x") - F.col("e") + 1).alias("bars_held"), F.max("losses").alias("max_losses"),
    )
    daily = d.groupBy(*key, "day_id").agg(F.max_by("equity", "t").alias("eq"))
    daily = daily.withColumn("ret", F.coalesce(F.try_divide("eq", F.coalesce(F.lag("eq").over(Window.partitionBy(*key).orderBy("day_id")), F.lit(1.0))) - 1, F.lit(0.0)))
    sums = daily.groupBy(*key).agg(F.sum("ret").alias("s1"), F.sum(F.col("ret") * F.col("ret")).alias("s2"))
    m = m.join(sums, key).join(windows.select("symbol", "window", "n_days"), ["symbol", "window"])
    mean, mu = F.col("sum_r") / F.col("n"), F.col("s1") / F.col("n_days")
    var, daily_var = F.col("sum_r2") / F.col("n") - mean * mean, F.col("s2") / F.col("n_days") - mu * mu
    return m.select(
        *key, "n", "wins", "sum_r", "sum_r2", "gross_win", "gross_loss", "equity", "max_dd", "bars_held", "max_losses", "n_days",
        F.when(daily_var > LEAST_VAR, mu / F.sqrt(daily_var) * days_per_year**0.5).otherwise(0.0).alias("sharpe"), mean.alias("mean_r"),
        F.when(var > LEAST_VAR, mean / F.sqrt(var) * F.sqrt("n")).alias("t_stat"), F.try_divide("gross_win", "gross_loss").alias("profit_factor"),
    )


class Market:
    """Bars, execution bars, bitmaps and levels of some symbols, written once and shared by all evaluations."""

    def __init__(self, bars: DataFrame, execs: DataFrame, rules: Rules, tradable=None, shared=lambda d: d):
        every = feature_table(bars)
        usable = F.col("atr") > 0 if tradable is None else (F.col("atr") > 0) & tradable
        self.rules, self.shared = rules, shared
        # two independent tables at a time: neither waits for the other's last task
        with ThreadPoolExecutor(2) as pool:
            first, second = pool.submit(shared, every), pool.submit(shared, paid(execs, rules.funding_mult))
            self.bars, self.execs = first.result(), second.result()
            first = pool.submit(shared, catalogue_bitmaps(self.bars, F.coalesce(usable, F.lit(False))))
            second = pool.submit(shared, levels(self.bars, self.execs))
            self.bitmaps, self._levels = first.result(), {0: second.result()}

    def levels(self, delay: int) -> DataFrame:
        if delay not in self._levels:
            self._levels[delay] = self.shared(levels(self.bars, self.execs, delay))
        return self._levels[delay]

    def trades(self, strategies: DataFrame, windows: DataFrame, delay: int = 0, costs: tuple[float, ...] = (1.0,)) -> DataFrame:
        found = candidates(signals(self.bitmaps, strategies), strategies, self.levels(delay), self.execs, windows, self.rules, delay, costs)
        return taken(found)

    def evaluated(self, strategies: DataFrame, windows: DataFrame, delay: int = 0, costs: tuple[float, ...] = (1.0,)) -> DataFrame:
        return population_metrics(self.trades(strategies, windows, delay, costs), windows, costs)

    def fitness(self, windows: DataFrame, least_n: int):
        """A function from a list of strategies to their values for ``search.evolve``: one job per generation. The value is the
        lowest t statistic of the windows, minus infinity where a window has fewer than ``least_n`` trades."""
        spark = self.bars.sparkSession

        def values(strategies: list[Strategy]) -> list[float]:
            m = self.evaluated(strategy_table(spark, strategies), windows)
            n = windows.groupBy("symbol").agg(F.count("*").alias("windows"))
            m = m.groupBy("symbol", "strategy").agg(F.count("*").alias("k"), F.min("n").alias("n"), F.min("t_stat").alias("t")).join(n, "symbol")
            got = {r.strategy: r.t for r in m.filter(f"k = windows and n >= {least_n} and t is not null").select("strategy", "t").collect()}
            return [got.get(s.hash(), float("-inf")) for s in strategies]

        return values


# queries ------------------------------------------------------------------------------------------------------------
RULES = Rules(cost=0.05, cost_rel=0.001, funding_mult=1.5, risk_frac=0.005, max_lev=5.0)
SIZE, SEED = 500, 11


def population(n: int = SIZE, seed: int = SEED) -> list[Strategy]:
    """n different strategies of all symbols, by a seed."""
    from ..plans.search import random_strategy

    rng, out = np.random.default_rng(seed), {}
    while len(out) < n:
        s = random_strategy(rng, "")
        out[s.hash()] = s
    return list(out.values())


def _names(n: int) -> list[str]:
    return [f"s{i:04d}" for i in range(n)]


def hourly_market(spark, sf_dir: str) -> Market:
    """Hourly bars of the events' tape, executed on 15-minute bars with funding."""
    m15 = written(m15_of(spark, sf_dir))
    return Market(frame_bars(m15, "h1"), execution_bars(m15, "h1", funding(spark, sf_dir)), RULES, shared=written)


def daily_market(spark, sf_dir: str) -> Market:
    """Daily bars of several years from the orders' tape, executed on themselves."""
    bars = frame_bars(written(tick_bars(daily_trades(spark, sf_dir))), "d1").withColumn("day_date", F.to_date("bucket"))
    bars = bars.withColumns({"exec_start": F.col("bar_idx"), "exec_end": F.col("bar_idx") + 1})
    execs = bars.select("symbol", F.col("bar_idx").alias("exec_idx"), "bar_idx", F.lit(0.0).alias("rate"), "open", "high", "low", "close", "day_id")
    return Market(bars, execs, Rules(cost_rel=0.0005, max_lev=5.0), shared=written)


def _rounded(d: DataFrame) -> DataFrame:
    return d.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


def strategies_light(spark, sf_dir: str) -> DataFrame:
    """500 strategies of the catalogue and the exit grid on every symbol, at single and double costs."""
    market = hourly_market(spark, sf_dir)
    return _rounded(market.evaluated(strategy_table(spark, population(), _names(SIZE)), windows_of(market.bars), costs=(1.0, 2.0)))


#: Years of the daily tape: blocks of training, out-of-sample years, and the funnel's windows.
FOLDS, BLOCKS, LEAST_N, TOP = (1995, 1996, 1997, 1998), 3, 3, 5
SPANS = [*((f"y{y}", f"{y}-01-01", f"{y + 1}-01-01") for y in range(FOLDS[0] - BLOCKS, FOLDS[-1] + 1)), *((f"train{y}", f"{y - BLOCKS}-01-01", f"{y}-01-01") for y in FOLDS), ("late", "1997-01-01", "1999-01-01")]
#: Gates on the training window at single and double costs.
GATES = {"n": 10, "profit_factor": 1.0, "mean_r": 0.0, "mean_r_x2": -0.05}


def _spans(spark, spans=SPANS) -> DataFrame:
    return spark.createDataFrame(list(spans), "window string, first string, last string").select("window", F.to_date("first").alias("first"), F.to_date("last").alias("last"))


def walk_forward(trades: DataFrame, m: DataFrame, k: int = TOP) -> DataFrame:
    """Of every fold and symbol, the k strategies with the highest fitness in training (the lowest t statistic of its
    blocks) among those that pass the gates, and what they earn in the year that follows: per fold and symbol, per fold,
    and over all (nulls). trades: with r_0 and r_1, of the windows in ``SPANS``; m: their metrics at costs 1 and 2."""
    from ..plans.search import top_k

    years = F.array(*[F.struct(F.lit(y).alias("fold"), F.lit(f"train{y}").alias("train"), F.array(*[F.lit(f"y{b}") for b in range(y - BLOCKS, y)]).alias("blocks")) for y in FOLDS])
    one = m.filter("cost = 1.0").select("symbol", "strategy", "window", "n", "t_stat", "profit_factor", "mean_r")
    fit = one.withColumn("f", F.explode(F.filter(years, lambda f: F.array_contains(f["blocks"], F.col("window")))))
    fit = fit.groupBy("symbol", "strategy", F.col("f.fold").alias("fold"), F.col("f.train").alias("window")).agg(F.count("*").alias("blocks"), F.min("n").alias("least"), F.min("t_stat").alias("fitness"), F.count("t_stat").alias("known"))
    fit = fit.filter(f"blocks = {BLOCKS} and known = {BLOCKS} and least >= {LEAST_N}").select("symbol", "strategy", "fold", "window", "fitness")
    double = m.filter("cost = 2.0").select("symbol", "strategy", "window", F.col("mean_r").alias("mean_r_x2"))
    ok = f"n >= {GATES['n']} and (profit_factor is null or profit_factor >= {GATES['profit_factor']}) and mean_r > {GATES['mean_r']} and mean_r_x2 > {GATES['mean_r_x2']}"
    gated = fit.join(one, ["symbol", "strategy", "window"]).join(double, ["symbol", "strategy", "window"]).filter(ok)
    chosen = top_k(gated.select("symbol", "strategy", "fold", "fitness"), ["fold", "symbol"], "fitness", k, "strategy")
    later = trades.select("symbol", "strategy", "window", "r_0", "r_1")
    out = chosen.withColumn("window", F.concat(F.lit("y"), F.col("fold"))).join(later, ["symbol", "strategy", "window"], "left")
    r = F.col("r_0")
    return out.groupingSets([["fold", "symbol"], ["fold"], []], "fold", "symbol").agg(
        F.count_distinct("fold", "symbol", "strategy").alias("selected"), F.count("r_0").alias("n"), F.avg(r).alias("mean_r"), F.avg("r_1").alias("mean_r_x2"),
        F.when(F.var_pop(r) > LEAST_VAR, F.avg(r) / F.stddev_pop(r) * F.sqrt(F.count(r))).alias("t_stat"),
    )


def walk_forward_trades(spark, sf_dir: str) -> DataFrame:
    market = daily_market(spark, sf_dir)
    strategies, windows = strategy_table(spark, population(DAILY), _names(DAILY)), windows_of(market.bars, _spans(spark))
    trades = market.shared(market.trades(strategies, windows, costs=(1.0, 2.0)))
    return _rounded(walk_forward(trades, population_metrics(trades, windows, (1.0, 2.0))))


DAILY = 300
#: The funnel's stages in order: name, and its condition on a strategy's metrics by window, cost and delay.
STAGES = ("generated", "basic", "stability", "cost_stress", "execution_stress", "walk_forward", "deflated_sharpe", "final")
#: Windows besides the folds': the years that follow training pooled, and all that selection has seen.
POOLS = (("forward", "1995-01-01", "1998-01-01"), ("seen", "1992-01-01", "1998-01-01"))
#: Gates of the pooled years, and the least deflated Sharpe ratio.
FORWARD, LEAST_DSR = {"n": 9, "profit_factor": 1.0, "mean_r": 0.0}, 0.05


def passes(gates: dict[str, float]):
    """Whether a row of metrics passes: n and profit factor at least (no losses: passed), mean_r above, drawdown at most."""
    out = F.lit(True)
    for k, v in gates.items():
        c = F.col(k)
        out = out & (c > v if k == "mean_r" else c <= v if k == "max_dd" else (c.isNull() | (c >= v)) if k == "profit_factor" else c >= v)
    return F.coalesce(out, F.lit(False))


def deflated(trades: DataFrame, m: DataFrame, windows: DataFrame, window: str = "seen") -> DataFrame:
    """symbol, strategy, dsr: the probability that the Sharpe ratio of daily returns exceeds what the best of as many independent
    trials would show without skill. Trials are all strategies with trades, counted by their mean correlation; the
    variance is that of the Sharpe ratios of those with enough trades."""
    from .stats import effective_trials, expected_largest, probabilistic

    span = windows.filter(F.col("window") == window)
    daily = written(daily_accounts(trades.filter(F.col("window") == window)))
    mom = daily_moments(daily, span)
    n = effective_trials(daily, span.select("symbol", "n_days"), ["symbol"])
    active = m.filter((F.col("window") == window) & (F.col("cost") == 1.0) & (F.col("n") >= LEAST_N)).groupBy("symbol").agg(F.var_pop(F.col("sharpe") / 260**0.5).alias("var_sr"))
    d = mom.join(n.select("symbol", "n_eff"), "symbol").join(active, "symbol")
    d = d.withColumn("best", expected_largest(F.col("var_sr"), F.col("n_eff")))
    return d.select("symbol", "strategy", probabilistic(F.col("best")).alias("dsr"))


def funnel(m: DataFrame, generated: DataFrame, dsr: DataFrame) -> DataFrame:
    """(symbol, stage number, stage, n): how many strategies are left after each stage. m: metrics by window, cost and delay.
    Every stage is a flag of one pass over the metrics, so a stage costs no further job: gates in training; profits in two of
    its blocks; still a profit at double costs; and with a bar's delay; profits in two of the three years that follow, and
    gates on these years pooled; a deflated Sharpe ratio over all that selection has seen; and a profit in the last two
    years."""
    at = lambda window, cost=1.0: (F.col("window") == window) & (F.col("cost") == cost) & (F.col("delay") == 0)
    won = F.col("mean_r") > 0
    held = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    first, later = [f"y{y}" for y in range(1992, 1995)], [f"y{y}" for y in range(1995, 1998)]
    flags = m.groupBy("symbol", "strategy").agg(
        held(at("train1995") & passes({k: GATES[k] for k in ("n", "profit_factor", "mean_r")})).alias("basic"),
        (F.count_if(F.col("window").isin(first) & (F.col("cost") == 1.0) & (F.col("delay") == 0) & won) >= 2).alias("stability"),
        held(at("train1995", 2.0) & won).alias("cost_stress"),
        held((F.col("window") == "train1995") & (F.col("delay") == 1) & (F.col("cost") == 1.0) & won).alias("execution_stress"),
        ((F.count_if(F.col("window").isin(later) & (F.col("cost") == 1.0) & (F.col("delay") == 0) & won) >= 2) & held(at("forward") & passes(FORWARD))).alias("walk_forward"),
        held(at("late") & won).alias("final"),
    )
    flags = generated.join(flags, ["symbol", "strategy"], "left").join(dsr.select("symbol", "strategy", (F.col("dsr") >= LEAST_DSR).alias("deflated_sharpe")), ["symbol", "strategy"], "left")
    left, sums = F.lit(True), []
    for i, stage in enumerate(STAGES):
        left = left if stage == "generated" else left & F.coalesce(F.col(stage), F.lit(False))
        sums.append(F.struct(F.lit(i).alias("number"), F.lit(stage).alias("stage"), F.count_if(left).alias("n")))
    return flags.groupBy("symbol").agg(F.array(*sums).alias("s")).select("symbol", F.inline("s"))


def _funnel_parts(spark, sf_dir: str):
    """Market, windows, trades and metrics (with delay) of the funnel, each written once."""
    market = daily_market(spark, sf_dir)
    strategies = strategy_table(spark, population(DAILY), _names(DAILY))
    windows = written(windows_of(market.bars, _spans(spark, (*SPANS, *POOLS))))
    trades = written(market.trades(strategies, windows, costs=(1.0, 2.0)))
    late = market.evaluated(strategies, windows.filter("window = 'train1995'"), delay=1).withColumn("delay", F.lit(1))
    return market, strategies, windows, trades, written(population_metrics(trades, windows, (1.0, 2.0)).withColumn("delay", F.lit(0)).unionByName(late))


def funnel_counts(spark, sf_dir: str) -> DataFrame:
    market, strategies, windows, trades, m = _funnel_parts(spark, sf_dir)
    every = market.bars.select("symbol").distinct().crossJoin(F.broadcast(strategies.select("strategy")))  # the population is a parameter
    return funnel(m, every, deflated(trades, m, windows))


def funnel_trials(spark, sf_dir: str) -> DataFrame:
    """Per symbol: strategies with trades, their mean pairwise correlation, effective number, and the largest deflated Sharpe ratio."""
    from .stats import effective_trials

    _, _, windows, trades, m = _funnel_parts(spark, sf_dir)
    seen = trades.filter("window = 'seen'")
    n = effective_trials(daily_accounts(seen), windows.filter("window = 'seen'").select("symbol", "n_days"), ["symbol"])
    best = deflated(trades, m, windows).groupBy("symbol").agg(F.max("dsr").alias("dsr"))
    return n.join(best, "symbol").select("symbol", "series", *[F.round(c, 5).alias(c) for c in ("rho", "n_eff", "dsr")])


QUERIES = {"strategies_light": strategies_light, "walk_forward_trades": walk_forward_trades, "funnel_counts": funnel_counts, "funnel_trials": funnel_trials}


# the same in SQL ------------------------------------------------------------------------------------------------------
_EVENTS = "SELECT event_type AS symbol, ts, event_id AS seq, value AS price FROM events"
_ORDERS = "SELECT o_orderpriority AS symbol, o_orderdate::TIMESTAMP AS ts, o_orderkey AS seq, o_totalprice AS price FROM orders"


def _of_days(sql: str) -> str:
    return sql.replace(_EVENTS, _ORDERS).replace(frame_sql("h1", "b"), frame_sql("d1", "b"))


def _base_sql(daily: bool) -> str:
    """Bars a with atr, execution bars ex with running payments, truth of the catalogue tr."""
    truth = ", ".join(f"coalesce({p.feature} {'=' if p.op == '==' else p.op} {p.value}, false)" for p in catalogue())
    rules = Rules(cost_rel=0.0005, max_lev=5.0) if daily else RULES
    if daily:
        ex = "ex0 AS (SELECT symbol, bar_idx AS exec_idx, bar_idx, 0.0 AS rate, open, high, low, close, day_id FROM a)"
        a = "a AS (SELECT * REPLACE (bar_idx AS exec_start, bar_idx + 1 AS exec_end) FROM a1)"
    else:
        a = "a AS (SELECT * FROM a1)"
        ex = """fu AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS bucket, first((json_extract_string(props, '$.k')::DOUBLE - 50) / 1e5 ORDER BY ts, event_id) AS rate FROM events WHERE hour(ts) % 8 = 0 GROUP BY 1, 2),
ex0 AS (SELECT m.symbol, m.exec_idx, a.bar_idx, CASE WHEN m.exec_idx = a.exec_start THEN coalesce(fu.rate, 0) ELSE 0 END AS rate, m.open, m.high, m.low, m.close, m.day_id
 FROM m15 m JOIN a ON m.symbol = a.symbol AND m.exec_idx >= a.exec_start AND m.exec_idx < a.exec_end LEFT JOIN fu ON fu.symbol = a.symbol AND fu.bucket = a.bucket)"""
    pay = lambda d: f"sum(CASE WHEN {-d} * rate < 0 THEN {-d} * rate * open * {rules.funding_mult} ELSE {-d} * rate * open END) OVER (PARTITION BY symbol ORDER BY exec_idx)"
    sql = f"""{BASE}, {ATR_SQL.replace("a AS (SELECT *, CASE", "a1 AS (SELECT *, CASE")}, {a},
fw AS ({ft.ORACLE['features_windows']}), fs AS ({ft.ORACLE['features_structure']}), fr AS ({ft.ORACLE['features_recurrent']}),
tr AS MATERIALIZED (SELECT symbol, bar_idx, [{truth}] AS truth FROM fw JOIN fs USING (symbol, bar_idx) JOIN fr USING (symbol, bar_idx)),
{ex}, ex AS MATERIALIZED (SELECT *, {pay(1)} AS pl, {pay(-1)} AS ps FROM ex0)"""
    return _of_days(sql) if daily else sql


def _evaluated_sql(name: str, daily: bool, rules: Rules, delay: int, costs: tuple[float, ...], only: str = "true") -> str:
    """Trades {name}_k and metrics {name}_m of the strategies sp in the windows wn."""
    r = ", ".join(f"(dir * (px - entry) - {m} * ({rules.cost} + {rules.cost_rel} * entry) + fund) / risk AS r_{i}" for i, m in enumerate(costs))
    each = " UNION ALL ".join(f"SELECT symbol, strategy, wname, {m}::DOUBLE AS cost, t, e, x, day_id, frac, r_{i} AS r FROM {name}_k" for i, m in enumerate(costs))
    key = "symbol, strategy, wname, cost"
    return f"""{name}_hit AS MATERIALIZED (SELECT tr.symbol, tr.bar_idx, sp.* FROM tr JOIN sp ON len(list_filter(sp.preds, lambda i: NOT tr.truth[i + 1])) = 0),
{name}_c AS (SELECT h.* EXCLUDE (symbol, bar_idx), a.symbol, a.bar_idx AS t, a.atr, a.bar_idx + {1 + delay} AS e, wn.wname, wn.t1, b2.exec_start AS k0, b2.open AS entry, h.stop * a.atr AS risk, b2.open - dir * (h.stop * a.atr) AS stop_px, b2.open + dir * (h.target * a.atr) AS goal,
 1 AS one FROM {name}_hit h JOIN a ON a.symbol = h.symbol AND a.bar_idx = h.bar_idx JOIN wn ON wn.symbol = h.symbol AND h.bar_idx >= wn.t0 AND h.bar_idx + {1 + delay} < wn.t1 AND {only}
 JOIN a b2 ON b2.symbol = a.symbol AND b2.bar_idx = a.bar_idx + {1 + delay} WHERE a.atr > 0),
{name}_l AS (SELECT c.*, least(e + hold - 1, t1 - 1) AS last_bar, e + hold - 1 <= t1 - 1 AS timed FROM {name}_c c),
{name}_e AS (SELECT l.*, a.exec_end - 1 AS k_last FROM {name}_l l JOIN a ON a.symbol = l.symbol AND a.bar_idx = l.last_bar),
{name}_p AS (SELECT DISTINCT symbol, t, e, k0, dir, stop_px, goal FROM {name}_e),
{name}_g AS (SELECT symbol, t, e, dir, stop_px, goal, max(k_last) AS k_far FROM {name}_e GROUP BY ALL),
{name}_f AS (SELECT p.symbol, p.t, p.dir, p.stop_px, p.goal, min(ex.exec_idx) FILTER (WHERE CASE WHEN p.dir > 0 THEN ex.low <= p.stop_px ELSE ex.high >= p.stop_px END) AS k_stop,
 min(ex.exec_idx) FILTER (WHERE CASE WHEN p.dir > 0 THEN ex.high >= p.goal ELSE ex.low <= p.goal END) AS k_goal
 FROM (SELECT p.*, unnest(range(p.k0, g.k_far + 1)) AS k FROM {name}_p p JOIN {name}_g g USING (symbol, t, e, dir, stop_px, goal)) p JOIN ex ON ex.symbol = p.symbol AND ex.exec_idx = p.k GROUP BY ALL),
{name}_x AS (SELECT e.*, k_stop, k_goal, least(coalesce(k_stop, k_last), coalesce(k_goal, k_last), k_last) AS xk FROM {name}_e e JOIN {name}_f USING (symbol, t, dir, stop_px, goal)),
{name}_y AS (SELECT x.*, ex.bar_idx AS x, ex.open, ex.close, ex.day_id, CASE WHEN dir > 0 THEN ex.pl - s.pl ELSE ex.ps - s.ps END AS fund,
 CASE WHEN xk = k_stop AND dir * (ex.open - stop_px) <= 0 THEN 2 WHEN xk = k_goal AND dir * (goal - ex.open) <= 0 THEN 4 WHEN xk = k_stop THEN 1 WHEN xk = k_goal THEN 3 WHEN timed THEN 5 ELSE 6 END AS why
 FROM {name}_x x JOIN ex ON ex.symbol = x.symbol AND ex.exec_idx = xk JOIN ex s ON s.symbol = x.symbol AND s.exec_idx = x.k0),
{name}_z AS (SELECT *, CASE WHEN why IN (2, 4) THEN open WHEN why = 1 THEN stop_px WHEN why = 3 THEN goal ELSE close END AS px, least({rules.risk_frac}, {rules.max_lev} * risk / entry) AS frac FROM {name}_y),
{name}_o AS MATERIALIZED (SELECT symbol, strategy, wname, t, e, x, day_id, why, frac, {r} FROM {name}_z),
{name}_n AS MATERIALIZED (SELECT o.symbol, o.strategy, o.wname, o.t, q.t AS following FROM {name}_o o ASOF LEFT JOIN {name}_o q ON o.symbol = q.symbol AND o.strategy = q.strategy AND o.wname = q.wname AND greatest(o.x, o.t + 1) <= q.t),
{name}_h AS (SELECT symbol, strategy, wname, min(t) AS t FROM {name}_o GROUP BY 1, 2, 3 UNION ALL SELECT n.symbol, n.strategy, n.wname, n.following FROM {name}_h h JOIN {name}_n n USING (symbol, strategy, wname, t) WHERE n.following IS NOT NULL),
{name}_k AS MATERIALIZED (SELECT o.* FROM {name}_o o JOIN {name}_h USING (symbol, strategy, wname, t)),
{name}_u AS ({each}),
{name}_v AS (SELECT *, CASE WHEN max((frac * r <= -1)::INT) OVER w = 1 THEN 0 ELSE exp(coalesce(sum(CASE WHEN frac * r > -1 THEN ln(1 + frac * r) END) OVER w, 0)) END AS equity, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) OVER w AS run FROM {name}_u WINDOW w AS (PARTITION BY {key} ORDER BY t)),
{name}_w AS (SELECT *, 1 - equity / greatest(1, max(equity) OVER (PARTITION BY {key} ORDER BY t)) AS drawdown, sum(CASE WHEN r < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {key}, run ORDER BY t) AS losses FROM {name}_v),
{name}_d AS (SELECT {key}, day_id, last(equity ORDER BY t) AS eq FROM {name}_w GROUP BY ALL),
{name}_r AS MATERIALIZED (SELECT {key}, day_id, coalesce(eq / nullif(coalesce(lag(eq) OVER (PARTITION BY {key} ORDER BY day_id), 1), 0) - 1, 0) AS ret FROM {name}_d),
{name}_s AS (SELECT {key}, sum(ret) AS s1, sum(ret * ret) AS s2 FROM {name}_r GROUP BY ALL),
{name}_a AS (SELECT {key}, count(*) AS n, count(*) FILTER (WHERE r > 0) AS wins, sum(r) AS sum_r, sum(r * r) AS sum_r2, sum(greatest(r, 0)) AS gross_win, sum(greatest(-r, 0)) AS gross_loss, last(equity ORDER BY t) AS equity, max(drawdown) AS max_dd,
 sum(x - e + 1)::BIGINT AS bars_held, max(losses)::BIGINT AS max_losses FROM {name}_w GROUP BY ALL),
{name}_m AS MATERIALIZED (SELECT {key}, n, wins, sum_r, sum_r2, gross_win, gross_loss, equity, max_dd, bars_held, max_losses, n_days,
 CASE WHEN s2 / n_days - (s1 / n_days) ** 2 > {LEAST_VAR} THEN s1 / n_days / sqrt(s2 / n_days - (s1 / n_days) ** 2) * sqrt(260) ELSE 0 END AS sharpe, sum_r / n AS mean_r,
 CASE WHEN sum_r2 / n - (sum_r / n) ** 2 > {LEAST_VAR} THEN sum_r / n / sqrt(sum_r2 / n - (sum_r / n) ** 2) * sqrt(n) END AS t_stat, gross_win / nullif(gross_loss, 0) AS profit_factor
 FROM {name}_a JOIN {name}_s USING ({key}) JOIN wn USING (symbol, wname))"""


def _strategies_sql(n: int) -> str:
    number = {p: i for i, p in enumerate(catalogue())}
    rows = ", ".join(f"('{name}', {[number[p] for p in s.predicates]}, {s.direction}, {s.stop}::DOUBLE, {s.target}::DOUBLE, {s.hold})" for name, s in zip(_names(n), population(n)))
    return f"sp(strategy, preds, dir, stop, target, hold) AS (VALUES {rows})"


def _oracles() -> dict[str, str]:
    five = lambda cols: ", ".join(f"round({c}, 5) AS {c}" for c in cols)
    doubles = ("sum_r", "sum_r2", "gross_win", "gross_loss", "equity", "max_dd", "sharpe", "mean_r", "t_stat", "profit_factor")
    every = "wn AS (SELECT symbol, 'all' AS wname, min(bar_idx) AS t0, max(bar_idx) + 1 AS t1, max(day_id) - min(day_id) + 1 AS n_days FROM a GROUP BY symbol)"
    light = f"""{_base_sql(False)}, {_strategies_sql(SIZE)}, {every}, {_evaluated_sql("q", False, RULES, 0, (1.0, 2.0))}
SELECT symbol, strategy, wname AS "window", cost, n, wins, bars_held, max_losses, n_days, {five(doubles)} FROM q_m"""
    spans = ", ".join(f"('{w}', DATE '{a}', DATE '{b}')" for w, a, b in SPANS)
    years = f"""{_base_sql(True)}, {_strategies_sql(DAILY)}, span(wname, first_day, end_day) AS (VALUES {spans}),
wn AS (SELECT symbol, wname, min(bar_idx) AS t0, max(bar_idx) + 1 AS t1, max(day_id) - min(day_id) + 1 AS n_days FROM a JOIN span ON a.bucket::DATE >= first_day AND a.bucket::DATE < end_day GROUP BY 1, 2)"""
    rules = Rules(cost_rel=0.0005, max_lev=5.0)
    forward = f"""{years}, {_evaluated_sql("q", True, rules, 0, (1.0, 2.0))},
fold AS (SELECT y AS fold, 'train' || y AS train FROM (VALUES {", ".join(f"({y})" for y in FOLDS)}) t(y)),
fit AS (SELECT symbol, strategy, fold, train, min(t_stat) AS fitness FROM q_m JOIN fold ON wname IN ({", ".join(f"'y' || (fold - {k})" for k in range(1, BLOCKS + 1))}) WHERE cost = 1 GROUP BY ALL HAVING count(t_stat) = {BLOCKS} AND min(n) >= {LEAST_N}),
ok AS (SELECT fit.* FROM fit JOIN q_m a1 ON a1.symbol = fit.symbol AND a1.strategy = fit.strategy AND a1.wname = train AND a1.cost = 1 JOIN q_m a2 ON a2.symbol = fit.symbol AND a2.strategy = fit.strategy AND a2.wname = train AND a2.cost = 2
 WHERE a1.n >= {GATES['n']} AND coalesce(a1.profit_factor, 9) >= {GATES['profit_factor']} AND a1.mean_r > {GATES['mean_r']} AND a2.mean_r > {GATES['mean_r_x2']}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, symbol ORDER BY fitness DESC, strategy) AS rank FROM ok) WHERE rank <= {TOP}),
j AS (SELECT best.fold, best.symbol, best.strategy, k.r_0, k.r_1 FROM best LEFT JOIN q_k k ON k.symbol = best.symbol AND k.strategy = best.strategy AND k.wname = 'y' || best.fold)
SELECT fold, symbol, count(DISTINCT (fold, symbol, strategy)) AS selected, count(r_0) AS n, round(avg(r_0), 5) AS mean_r, round(avg(r_1), 5) AS mean_r_x2,
 round(CASE WHEN var_pop(r_0) > {LEAST_VAR} THEN avg(r_0) / stddev_pop(r_0) * sqrt(count(r_0)) END, 5) AS t_stat FROM j GROUP BY GROUPING SETS ((fold, symbol), (fold), ())"""
    q = lambda cond, agg="bool_or": f"coalesce({agg}({cond}), false)"
    flags = {
        "basic": q(f"wname = 'train1995' AND cost = 1 AND delay = 0 AND n >= {GATES['n']} AND mean_r > 0 AND coalesce(profit_factor, 9) >= {GATES['profit_factor']}"), "stability": "count(*) FILTER (WHERE wname IN ('y1992', 'y1993', 'y1994') AND cost = 1 AND delay = 0 AND mean_r > 0) >= 2",
        "cost_stress": q("wname = 'train1995' AND cost = 2 AND delay = 0 AND mean_r > 0"), "execution_stress": q("wname = 'train1995' AND cost = 1 AND delay = 1 AND mean_r > 0"),
        "walk_forward": "count(*) FILTER (WHERE wname IN ('y1995', 'y1996', 'y1997') AND cost = 1 AND delay = 0 AND mean_r > 0) >= 2 AND " + q(f"wname = 'forward' AND cost = 1 AND delay = 0 AND n >= {FORWARD['n']} AND mean_r > {FORWARD['mean_r']} AND coalesce(profit_factor, 9) >= {FORWARD['profit_factor']}"), "final": q("wname = 'late' AND cost = 1 AND delay = 0 AND mean_r > 0"),
    }
    sums = " UNION ALL ".join(f"SELECT symbol, {i} AS number, '{st}' AS stage, count(*) FILTER (WHERE {' AND '.join(f'coalesce({x}, false)' for x in STAGES[1 : i + 1]) or 'true'}) AS n FROM fl GROUP BY symbol" for i, st in enumerate(STAGES))
    pools = years.replace("VALUES " + spans, "VALUES " + ", ".join(f"('{w}', DATE '{a}', DATE '{b}')" for w, a, b in (*SPANS, *POOLS)))
    trials = f"""{pools}, {_evaluated_sql("q", True, rules, 0, (1.0, 2.0))},
sn AS (SELECT symbol, strategy, day_id, ret, n_days FROM q_r JOIN wn USING (symbol, wname) WHERE wname = 'seen' AND cost = 1),
sw AS MATERIALIZED (SELECT *, sum(ret) OVER v / n_days AS a, sum(ret ** 2) OVER v / n_days AS b, sum(ret ** 3) OVER v / n_days AS c, sum(ret ** 4) OVER v / n_days AS d FROM sn WINDOW v AS (PARTITION BY symbol, strategy)),
sm AS (SELECT symbol, strategy, n_days, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d FROM sw GROUP BY 1, 2, 3),
sz AS MATERIALIZED (SELECT *, b - a * a AS m2, sqrt(greatest(0, b - a * a)) AS sd FROM sm), bz AS MATERIALIZED (SELECT symbol, n_days, count(*) AS series, sum(a / sd) AS still FROM sz WHERE sd > 1e-9 GROUP BY 1, 2),
dz AS MATERIALIZED (SELECT symbol, day_id, sum(ret / sqrt(b - a * a)) AS z FROM sw WHERE sqrt(greatest(0, b - a * a)) > 1e-9 GROUP BY 1, 2),
ne AS MATERIALIZED (SELECT symbol, series, rho, coalesce(rho + (1 - rho) * series, series) AS n_eff FROM (SELECT symbol, series, CASE WHEN series > 1 THEN ((sum((z - still) ** 2) + (n_days - count(*)) * still ** 2) / n_days - series) / (series * (series - 1)) END AS rho FROM dz JOIN bz USING (symbol) GROUP BY symbol, series, n_days, still)),
vs AS (SELECT symbol, var_pop(sharpe / sqrt(260)) AS v FROM q_m WHERE wname = 'seen' AND cost = 1 AND n >= {LEAST_N} GROUP BY 1),
e0 AS MATERIALIZED (SELECT symbol, v, n_eff, 1 - 1 / n_eff AS p1, 1 - 1 / (n_eff * exp(1)) AS p2 FROM ne JOIN vs USING (symbol)),
ee AS MATERIALIZED (SELECT symbol, CASE WHEN n_eff > 1 AND v > 0 THEN sqrt(v) * ({1 - EULER} * ({normal_quantile_sql('p1')}) + {EULER} * ({normal_quantile_sql('p2')})) ELSE 0 END AS ref FROM e0),
sk AS (SELECT symbol, strategy, n_days AS n, CASE WHEN m2 > {LEAST_VAR} THEN a / sd ELSE 0 END AS sr, CASE WHEN m2 > {LEAST_VAR} THEN (c - 3 * a * b + 2 * a ** 3) / (m2 * sd) ELSE 0 END AS skew, CASE WHEN m2 > {LEAST_VAR} THEN (d - 4 * a * c + 6 * a * a * b - 3 * a ** 4) / (m2 * m2) ELSE 3 END AS kurt FROM sz),
sx AS MATERIALIZED (SELECT symbol, strategy, CASE WHEN n >= 2 AND 1 - skew * sr + (kurt - 1) / 4 * sr * sr > 0 THEN (sr - ref) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) END AS x FROM sk JOIN ee USING (symbol)),
ds AS MATERIALIZED (SELECT symbol, strategy, coalesce({normal_cdf_sql('x')}, 0) AS dsr FROM sx)"""
    stages = f"""{trials}, {_evaluated_sql("z", True, rules, 1, (1.0,), "wn.wname = 'train1995'")},
mm AS (SELECT symbol, strategy, wname, cost, n, mean_r, profit_factor, 0 AS delay FROM q_m UNION ALL SELECT symbol, strategy, wname, cost, n, mean_r, profit_factor, 1 FROM z_m),
f0 AS (SELECT symbol, strategy, {", ".join(f"{v} AS {k}" for k, v in flags.items())} FROM mm GROUP BY 1, 2),
fl AS (SELECT * FROM (SELECT DISTINCT symbol FROM a) CROSS JOIN (SELECT strategy FROM sp) LEFT JOIN f0 USING (symbol, strategy) LEFT JOIN (SELECT symbol, strategy, dsr >= {LEAST_DSR} AS deflated_sharpe FROM ds) USING (symbol, strategy)) {sums}"""
    best = f"{trials} SELECT symbol, series, round(rho, 5) AS rho, round(n_eff, 5) AS n_eff, round(max(dsr), 5) AS dsr FROM ne JOIN ds USING (symbol) GROUP BY symbol, series, rho, n_eff"
    return {"strategies_light": light, "walk_forward_trades": forward, "funnel_counts": stages, "funnel_trials": best}


ORACLE = _oracles()

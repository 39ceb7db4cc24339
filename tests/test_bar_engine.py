"""The bar engine: every query against its SQL, hand-made trades, causality, and the guards of tapes and strategies."""

import datetime as dt
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import catalog
from barloom.functions import features as ft
from barloom.functions.predicates import Predicate, Strategy, catalogue
from barloom.operators import bars, populations, portfolio, states, stats, trades
from barloom.plans import search
from barloom.sources import tapes
from barloom.streaming.bars import stream_bars


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 6)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, dt.datetime):
        return str(v)[:19]
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, sf, duck, name):
    d = catalog.queries()[name](spark, sf)
    cols = sorted(d.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in d.collect()]
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r if not isinstance(v, float)) + tuple(v for v in r if isinstance(v, float))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=2e-6, rel=2e-6) if all(isinstance(x, float) for x in g) else all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(x))) or (x is not None and isinstance(y, float) and abs(x - y) < 1e-9) for x, y in zip(g, w)), (g, w)


# trades by hand -------------------------------------------------------------------------------------------------------
def world_of(spark, prices, exit_sig=(), rates=None):
    """Bars of one symbol with an ATR of 4, executed on themselves."""
    rows = [("s", i, *map(float, p), 4.0, i, i + 1, i in exit_sig, (rates or {}).get(i, 0.0), i // 3) for i, p in enumerate(prices)]
    b = spark.createDataFrame(rows, "symbol string, bar_idx long, open double, high double, low double, close double, atr double, exec_start long, exec_end long, exit_sig boolean, rate double, day_id long")
    return b, b.select("symbol", F.col("bar_idx").alias("exec_idx"), "bar_idx", F.lit(True).alias("is_last"), "rate", "open", "high", "low", "close", "day_id")


def run(spark, prices, signals, rules=trades.Rules(), exit_sig=(), rates=None, **spec):
    """Trades of one strategy. prices: (open, high, low, close) by bar."""
    b, ex = world_of(spark, prices, exit_sig, rates)
    full = {"dir": 1, "stop": 1.5, "target": 2.5, "hold": 5, "trail": 0.0, "delay": 0} | spec
    s = spark.createDataFrame([("s", "a", t, *full.values()) for t in signals], "symbol string, strategy string, t long, dir int, stop double, target double, hold int, trail double, delay int")
    p = trades.paths(b, ex, s, rules)
    t = trades.chained(trades.outcomes(p))
    return [(r.e, r.x, trades.REASONS[r.why], round(r.px, 6), round(r.r, 6)) for r in t.orderBy("t").collect()], t, p, b


def followed_by_hand(prices, signals, rules, exit_sig, rates, dir, stop, target, hold, trail, delay):
    """One position at a time, bar after bar."""
    out, free = [], -1
    for t in signals:
        e = t + 1 + delay
        if t < free or e >= len(prices):
            continue
        entry, last = prices[e][0], min(e + hold - 1, len(prices) - 1)
        first, goal, best, paid, level, why = entry - dir * stop * 4, entry + dir * target * 4, entry, 0.0, None, None
        for k in range(e, last + 1):
            o, h, l, c = prices[k]
            if k > e:
                flow = -dir * rates.get(k, 0.0) * o
                paid += flow * (rules.funding_mult if flow < 0 else 1)
            level = first if not trail or k == e else (max(first, best - trail * 4) if dir > 0 else min(first, best + trail * 4))
            if k > e and k - 1 in exit_sig:
                why, px = "SIGNAL", o
            elif dir * (o - level) <= 0:
                why, px = "STOP_GAP", o
            elif dir * (goal - o) <= 0:
                why, px = "TARGET_GAP", o
            elif dir * ((l if dir > 0 else h) - level) <= 0:
                why, px = "STOP" if level == first else "TRAIL", level
            elif dir * (goal - (h if dir > 0 else l)) <= 0:
                why, px = "TARGET", goal
            elif k == last:
                why, px = "TIME" if e + hold - 1 <= len(prices) - 1 else "END", c
            if why:
                break
            best = max(best, h) if dir > 0 else min(best, l)
        free = k
        out.append((e, k, why, round(px, 6), round((dir * (px - entry) - rules.cost - rules.cost_rel * entry + paid) / (stop * 4), 6)))
    return out


def test_trades_equal_a_walk_by_hand(spark):
    r = np.random.default_rng(21)
    seen = set()
    for k in range(6):
        close = 80 + np.cumsum(r.normal(0, 2.5, 90))
        o = np.r_[80.0, close[:-1]] + r.normal(0, 4.0, 90)
        prices = np.round(np.column_stack([o, np.maximum(o, close) + abs(r.normal(0, 1.5, 90)), np.minimum(o, close) - abs(r.normal(0, 1.5, 90)), close]), 3).tolist()
        spec = {"dir": 1 if k % 2 else -1, "stop": 1.25, "target": 1.75, "hold": 7, "trail": 1.5 if k > 2 else 0.0, "delay": k % 3}
        sig, leave, rates = sorted(r.choice(88, 40, replace=False).tolist()), set(r.choice(90, 8).tolist()), {int(i): float(x) for i, x in zip(r.choice(90, 20), r.normal(0, 0.002, 20))}
        rules = trades.Rules(cost=0.07, cost_rel=0.0004, funding_mult=1.8)
        got, *_ = run(spark, prices, sig, rules, leave, rates, **spec)
        assert got == followed_by_hand(prices, sig, rules, leave, rates, **spec), k
        seen |= {x[2] for x in got}
    assert {"STOP", "STOP_GAP", "TARGET", "TARGET_GAP", "TIME", "TRAIL", "SIGNAL"} <= seen


def test_ties_ends_and_reentry(spark):
    flat = [(80.0, 80.0, 80.0, 80.0)] * 9
    wide = flat[:3] + [(80.0, 93.0, 71.0, 80.0)] + flat[4:]
    assert run(spark, wide, [2])[0] == [(3, 3, "STOP", 74.0, -1.0)]  # the stop wins a bar that touches both
    assert [x[:3] for x in run(spark, wide, [2, 3], hold=2)[0]] == [(3, 3, "STOP"), (4, 5, "TIME")]  # the exit bar may signal again
    assert run(spark, flat, [6])[0] == [(7, 8, "END", 80.0, 0.0)]


def test_drawdowns_and_an_account_that_loses_all(spark):
    sunk = [(80.0, 80.0, 72.0, 80.0)] * 7
    _, t, p, b = run(spark, sunk, list(range(6)), trades.Rules(risk_frac=0.02))
    m = trades.metrics(t, b.groupBy("symbol").agg(F.count_distinct("day_id").alias("n_days"))).first()
    assert m.n == 6 and m.max_losses == 6 and abs(m.max_dd - (1 - 0.98**6)) < 1e-12
    dipped = [(80.0, 80.0, 80.0, 80.0)] * 3 + [(80.0, 80.0, 75.5, 80.0), (80.0, 91.0, 80.0, 90.0), (90.0, 90.0, 90.0, 90.0)]
    _, t, p, _ = run(spark, dipped, [1], trades.Rules(risk_frac=0.01))
    assert abs(trades.marked_drawdown(t, p).first().mtm_drawdown - 0.0075) < 1e-9  # three quarters of R
    fell = [(80.0, 80.0, 80.0, 80.0)] * 3 + [(20.0, 20.0, 20.0, 20.0)] * 3
    _, t, *_ = run(spark, fell, [1, 3], trades.Rules(risk_frac=0.4, max_lev=9.0))
    assert [r.equity for r in t.orderBy("t").collect()] == [0.0, 0.0]


# features and states --------------------------------------------------------------------------------------------------
def test_features_are_causal(spark, sf):
    h1 = bars.h1_of(spark, sf).filter("symbol = 'click'")
    every = ft.feature_table(h1)
    names = ft.names(every)
    assert len(names) == 77
    cut = 250
    short = {r.bar_idx: r for r in ft.feature_table(h1.filter(F.col("bar_idx") < cut)).select("bar_idx", *names).collect()}
    for r in every.filter(F.col("bar_idx") < cut).select("bar_idx", *names).collect():
        assert [plain(v) for v in r] == [plain(v) for v in short[r.bar_idx]]


def test_hysteresis_and_spells(spark):
    x = [1, 7, None, 3, 2.5, 2, 0, -5.9, -6.5, -2.5, -2, 8, -7, None]
    d = spark.createDataFrame([("s", i, None if v is None else float(v)) for i, v in enumerate(x)], "symbol string, bar_idx long, x double")
    got = [r.l for r in d.select("bar_idx", states.hysteresis(F.col("x"), 6.0, 2.0, -6.0, -2.0).alias("l")).orderBy("bar_idx").collect()]
    assert got == [0, 1, None, 0, 0, 0, 0, 0, -1, -1, -1, 1, -1, None]
    s = spark.createDataFrame([("s", i, v) for i, v in enumerate([4, 4, None, 4, 7, 7, 7, 7, 4, None])], "symbol string, bar_idx long, state int")
    assert [(r.state, r.length) for r in states.spells(s).orderBy("start").collect()] == [(4, 2), (4, 1), (7, 4), (4, 1)]


def test_fractal(spark):
    high = [1, 2, 3, 9, 3, 2, 1, 1, 1]
    d = spark.createDataFrame([("s", i, float(h), 0.5, float(h)) for i, h in enumerate(high)], "symbol string, bar_idx long, high double, low double, close double")
    got = {r.bar_idx: r for r in ft.with_structure(d, 2).collect()}
    assert got[5].structure_fractal_high_2 == 1 and got[5].structure_break_high_2 is None and got[6].structure_break_high_2 == 1 - 9


# guards ---------------------------------------------------------------------------------------------------------------
def tape(spark, rows):
    return spark.createDataFrame([("s", i, dt.datetime(2020, 1, 6) + dt.timedelta(minutes=m), *p) for i, (m, *p) in enumerate(rows)], "symbol string, seq long, ts timestamp_ntz, open double, high double, low double, close double")


@pytest.mark.parametrize("rows, fault", [([(15, 1.0, 1.0, 1.0, 1.0), (0, 1.0, 1.0, 1.0, 1.0)], "steps back"), ([(0, 1.0, 1.0, 1.0, 1.0)] * 2, "repeated"), ([(7, 1.0, 1.0, 1.0, 1.0)], "grid"), ([(0, None, 1.0, 1.0, 1.0)], "bad"), ([(0, 1.0, 0.9, 0.9, 1.0)], "contradictory"), ([], "empty")])
def test_bad_tapes_are_refused(spark, rows, fault):
    with pytest.raises(tapes.TapeError, match=fault):
        tapes.validate(tape(spark, rows))


def raw_file(tmp_path, rows, head="Date,Time,Open,High,Low,Close,Volume"):
    (tmp_path / "raw.csv").write_text("\n".join([head, *rows]) + "\n")
    return str(tmp_path / "raw.csv")


@pytest.mark.parametrize("zone", ["UTC", "America/Lima"])
def test_raw_bars(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        path = raw_file(tmp_path, ["20240105,10:00:00,1.5,2,1,1.7,10", "20240705,10:15:00,1,1,1,1,99999999999999"])
        got = tapes.raw_bars(spark, path, "Europe/Athens", "p").collect()
        assert [(str(r.ts_utc), r.open, r.volume) for r in got] == [("2024-01-05 08:00:00", 1.5, 10.0), ("2024-07-05 07:15:00", 1.0, None)]
        faults = [("20240331,03:30:00,1,1,1,1,1", "missing hours"), ("20241027,03:30:00,1,1,1,1,1", "repeated hours"), ("20240105,10:00:00,1,x,1,1,1", "unparseable high"), ("20240105,25:00:00,1,1,1,1,1", "unparseable ts"), ("20240105,10:00:00,1,1,1,1,", "unparseable volume")]
        for row, fault in faults:
            with pytest.raises(tapes.TapeError, match=fault):
                tapes.raw_bars(spark, raw_file(tmp_path, [row]), "Europe/Athens", "p")
        with pytest.raises(tapes.TapeError, match="columns"):
            tapes.raw_bars(spark, raw_file(tmp_path, ["1,2"], "Date,Time"), "Europe/Athens", "p")
        spot = tapes.spot_bars(spark, raw_file(tmp_path, ["2024-03-31 03:30:00,1,2,0.5,1.5,7", "2024-12-31 22:00:00,1,2,0.5,1.5,7"], "datetime,open,high,low,close,volume"), "c")
        kept = tapes.canonical(spot, "2024-12-31 23:00:00", [((12, 31, 20, 0), (1, 2, 0, 0))], utc=True).orderBy("ts_utc").collect()
        assert [(r.no_trade, r.day_id, r.close) for r in kept] == [(False, 0, 1.5), (True, 1, 1.5)] and tapes.canonical(spot, "2024-03-31 03:30:00").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_steps_back_across_blocks(spark, monkeypatch):
    from barloom.operators import audit

    at = [5, 3, 4, 9, 8, 8, 20, 1]
    rows = [("s", i, dt.datetime(2024, 1, 1, 0, m), 1.0, 1.0) for i, m in enumerate(at)]
    d = spark.createDataFrame(rows, "symbol string, seq long, ts timestamp_ntz, price double, volume double")
    for block in (1, 2, 3, 100):
        monkeypatch.setattr(audit, "BLOCK", block)
        r = audit.tape_faults(d).first()
        assert (r.n, r.steps_back, r.repeated_times) == (8, sum(b < a for a, b in zip(at, at[1:])), 1)


def test_calendar_rules(spark):
    days = [("2019-03-10 23:00:00", "2019-03-11"), ("2019-03-11 00:00:00", "2019-03-11"), ("2005-04-02 10:00:00", "2005-04-01"), ("2005-04-01 10:00:00", "2005-04-01")]
    d = spark.createDataFrame(days, "t string, want string").withColumn("ts", F.to_timestamp_ntz("t"))
    assert all(str(r.got) == r.want for r in d.select("want", tapes.trading_date(F.col("ts")).alias("got")).collect())
    w = [((12, 31, 20, 0), (1, 2, 0, 0))]
    h = spark.createDataFrame([("2020-12-31 19:45:00", False), ("2020-12-31 20:00:00", True), ("2021-01-01 05:00:00", True), ("2021-01-02 00:00:00", False)], "t string, want boolean")
    assert all(r.want == r.got for r in h.select("want", tapes.holiday(F.to_timestamp_ntz("t"), w).alias("got")).collect())


def test_strategies(spark):
    a = Strategy("s", 1, (Predicate("trend_ema_pair_50_10", "<", 0), Predicate("momentum_rsi_14", ">", 50)), 1, 2, 12)
    b = Strategy("s", 1, (Predicate("momentum_rsi_14", ">", 50.0), Predicate("trend_ema_pair_10_50", ">", 0.0), Predicate("momentum_rsi_14", ">", 50)), 1.0, 2.0, 12)
    assert a.hash() == b.hash() and Strategy.from_json(a.to_json()) == a and len(catalogue()) == 170
    with pytest.raises(ValueError):
        Strategy("s", 0, a.predicates, 1, 2, 12)
    score = lambda ss: [float(len(s.predicates)) - s.stop for s in ss]
    one, two = search.evolve(score, "s", 20, 120, 7), search.evolve(score, "s", 20, 120, 7)
    assert list(one) == list(two) and len(one) == 120


def flat_market(spark, changes, n=12):
    """One symbol of price 1.0 and ATR 0.01 on bars that execute themselves; changes: bar -> prices."""
    rows = []
    for i in range(n):
        p = {"open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0} | changes.get(i, {})
        rows.append(("s", i, p["open"], max(p.values()), min(p.values()), p["close"], 0.01, i, i + 1, i // 4, 0.0))
    b = spark.createDataFrame(rows, "symbol string, bar_idx long, open double, high double, low double, close double, atr double, exec_start long, exec_end long, day_id long, rate double")
    return b, populations.paid(b.withColumn("exec_idx", F.col("bar_idx")))


def population_trades(spark, changes, signals, spans=((0, 12),), delay=0, rate=None, **spec):
    b, ex = flat_market(spark, changes)
    if rate:
        ex = populations.paid(ex.drop("paid_long", "paid_short").withColumns({"rate": F.when(F.col("bar_idx") == rate[0], rate[1]).otherwise(0.0), "rate_abs": F.when(F.col("bar_idx") == rate[0], rate[2]).otherwise(0.0)}), 2.0)
    full = {"dir": 1, "stop": 1.0, "target": 2.0, "hold": 12} | spec
    s = spark.createDataFrame([("a", *full.values())], "strategy string, dir int, stop double, target double, hold int")
    sig = spark.createDataFrame([("s", "a", t) for t in signals], "symbol string, strategy string, t long")
    w = spark.createDataFrame([("s", f"w{a}", a, e, e, 3) for a, e in spans], "symbol string, window string, t0 long, t1 long, k_end long, n_days long")
    found = populations.candidates(sig, s, populations.levels(b, ex, delay), ex, w, trades.Rules(), delay, (1.0, 2.0))
    return [(r.window, r.t, r.x, trades.REASONS[r.why], round(r.px, 9), round(r.r_0, 9)) for r in populations.taken(found).orderBy("window", "t").collect()]


def test_population_outcomes(spark):
    assert population_trades(spark, {4: {"high": 1.05, "low": 0.95}}, [2, 3]) == [("w0", 2, 4, "STOP", 0.99, -1.0)]
    assert population_trades(spark, {4: {"open": 1.04}}, [2]) == [("w0", 2, 4, "TARGET_GAP", 1.04, 4.0)]
    assert population_trades(spark, {4: {"open": 1.04}}, [2], dir=-1) == [("w0", 2, 4, "STOP_GAP", 1.04, -4.0)]
    # what a window leaves open goes at its last close; entries need a bar inside
    assert population_trades(spark, {5: {"close": 1.005}}, [1, 5], spans=((0, 6), (4, 6))) == [("w0", 1, 5, "END", 1.005, 0.5)]
    assert population_trades(spark, {3: {"low": 0.9}}, [1], delay=2) == [("w0", 1, 11, "END", 1.0, 0.0)]
    # a long pays the rate and what both sides pay, here twice
    assert population_trades(spark, {}, [0], rate=(3, 0.001, 0.002))[0][-1] == round(-2 * 0.003 / 0.01, 9)
    assert population_trades(spark, {}, [0], dir=-1, rate=(3, 0.001, 0.002))[0][-1] == round(-2 * 0.001 / 0.01, 9)


def test_population_chain_over_batches(spark):
    rows = [("s", f"a{g}", "w", t, t + 1 + (t * 7 + g) % 5) for g in range(40) for t in range(0, 300, 1 + g % 3)]
    d = spark.createDataFrame(rows, "symbol string, strategy string, window string, t long, x long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.strategy, r.t) for r in populations.taken(d).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, free = set(), {}
    for _, g, _, t, x in rows:
        if t >= free.get(g, -1):
            want.add((g, t))
            free[g] = x
    assert got == want


def test_nightly_swaps(spark):
    days = [("2024-01-01 00:00:00", 0), ("2024-01-02 00:00:00", 1), ("2024-01-04 00:00:00", 3), ("2024-01-04 00:15:00", 0), ("2024-01-06 00:00:00", 0)]
    d = spark.createDataFrame(days, "at string, nights int").withColumns({"ts": F.to_timestamp_ntz("at"), "open": F.lit(2.0)})
    for r in populations.swap_rates(d, F.col("ts"), 3.0, -1.0, 0.01).collect():
        assert abs((r.rate + r.rate_abs) * 2 - 0.03 * r.nights) < 1e-12 and abs((r.rate_abs - r.rate) * 2 + 0.01 * r.nights) < 1e-12


def test_search_over_a_market(spark, sf):
    market = populations.hourly_market(spark, sf)
    seen = []
    fitness = market.fitness(populations.windows_of(market.bars), 2)
    archive = search.evolve(lambda ss: seen.append(len(ss)) or fitness(ss), "click", 20, 40, 3)
    assert len(archive) == 40 and len(seen) <= 4 and any(f > float("-inf") for _, f in archive.values())
    best = max(archive.values(), key=lambda v: v[1])[0]
    m = market.evaluated(populations.strategy_table(spark, [best]), populations.windows_of(market.bars)).first()
    assert abs(m.t_stat - archive[best.hash()][1]) < 1e-9


def test_statistics():
    assert stats.probabilistic_sharpe(100, 0.0, 0.0, 3.0) == 0.5 and stats.probabilistic_sharpe(1, 1.0, 0.0, 3.0) == 0.0
    draws = np.random.default_rng(1).normal(size=(4000, 50)).max(1).mean()
    assert abs(stats.expected_max_sharpe(1.0, 50) - draws) < 0.05
    assert stats.deflated_sharpe(500, 0.1, 0.0, 3.0, 0.002, 100) < stats.probabilistic_sharpe(500, 0.1, 0.0, 3.0)


def test_portfolio_timing(spark):
    day = lambda i: dt.date(2020, 1, i)
    rows = [("p", day(i), "a", {2: 0.05, 3: 0.10}.get(i, 0.0), 0.001 if i == 3 else 0.0, -1.0 if i >= 2 else 0.0, i == 2) for i in (1, 2, 3)]
    d = spark.createDataFrame(rows, "portfolio string, day date, asset string, ret double, carry double, weight double, rebalance boolean")
    got = {r.day: r for r in portfolio.accounted(d, cost=0.0, pay_mult=2.0).collect()}
    assert got[day(2)].ret == 0.0 and abs(got[day(3)].ret - (-0.10 - 0.002)) < 1e-12 and got[day(2)].turnover == 1.0


def test_stream_equals_batch(spark, sf, tmp_path):
    t = tapes.ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    t.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "in"))
    out = stream_bars(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = bars.m15_of(spark, sf).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")
    assert spark.table("bars_out").exceptAll(want).count() == 0 and spark.table("bars_out").count() == want.count()


def test_pushdown(spark, sf):
    plan = tapes.table(spark, sf, "events").filter("ts < timestamp_ntz'2024-01-05'").select("event_type", "value")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts" in plan and "user_id" not in plan

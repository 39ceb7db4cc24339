"""Rules, controls, venues, portfolios and worlds against plain loops."""

import datetime as dt
import os
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom import catalog
from barloom.operators import controls, hypotheses, portfolio, rules, stats, trades, venues, worlds
from barloom.plans.storage import tables, delete, written


def exists(table) -> bool:
    return os.path.isdir(table.written_at.removeprefix("file:"))


def test_tables_of_a_scope_go(spark):
    with tables() as mine:
        a = written(spark.range(5))
        b = written(a, instead_of=a)
    c = written(spark.range(3))
    assert len(mine) == 2 and not exists(a) and exists(b) and b.count() == 5
    delete(spark, mine)
    delete(spark, mine)
    assert not exists(b) and exists(c)


# zero prices ----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def zero_prices(tmp_path_factory):
    """A folder with events of which some cost nothing: lows of 0 between others, and (symbol z) whole hours of 0."""
    duckdb = pytest.importorskip("duckdb")
    to = tmp_path_factory.mktemp("zeros")
    prices = {"a": [[3, 1, 2], [4, 0, 5], [6, 2, 9, 6], [1], [2, 0.5, 2]], "z": [[5, 1, 2], [0, 0], [3], [2, 7, 0], [0, 4, 3], [8, 1, 8], [0]]}
    rows = [f"({s!r}, timestamp '2024-01-01 00:00:00' + interval {h * 60 + k} minute, {p}::double)" for s, hours in prices.items() for h, ps in enumerate(hours) for k, p in enumerate(ps)]
    duckdb.sql(f"copy (select row_number() over () as event_id, ts, 1::bigint as user_id, s as event_type, p as value, '{{}}' as props from (values {', '.join(rows)}) v(s, ts, p)) to '{to}/events.parquet'")
    return str(to)


def same_as_sql(spark, sf_dir, name):
    import duckdb

    with duckdb.connect() as con:
        con.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
        expected = con.execute(catalog.oracle_sql()[name]).fetchall()
    key = lambda r: [str(abs(x) if x != x else x) for x in r]  # noqa: E731  NaN has no sign
    return sorted(map(key, catalog.queries()[name](spark, sf_dir).collect())) == sorted(map(key, expected))


def test_wicks_of_zero_prices(spark, zero_prices):
    assert same_as_sql(spark, zero_prices, "audit_wicks")


# states to signals ----------------------------------------------------------------------------------------------------
def test_rule_signals_by_hand(spark):
    #        regime, h4_slope, h4_order, h4_width, h1_order
    rows = [(None, 1, 0, 0, 0), (1, 1, 0, 0, 0), (1, 1, 1, 1, 1), (1, 1, 1, 1, -1), (1, 1, 0, 2, 0), (0, 1, 0, 0, 1), (-1, -1, -1, 2, -1), (-1, 1, 0, None, 0)]
    d = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "symbol string, bar_idx long, regime int, h4_slope int, h4_order int, h4_width int, h1_order int")
    got = rules.rule_signals(d).collect()
    entries = {(r.rule, r.bar_idx, r.dir) for r in got if r.entry}
    assert entries == {("trend_continuation", 2, 1), ("pullback_end", 4, 1), ("compression_release", 2, 1), ("compression_release", 6, -1), ("regime_change", 6, -1), ("trend_continuation", 6, -1), ("pullback_end", 6, -1)}
    leaves = {(r.bar_idx, r.dir) for r in got if r.exit and r.rule == "trend_continuation"}
    assert leaves == {(0, 1), (0, -1), (1, -1), (2, -1), (3, -1), (4, -1), (5, 1), (5, -1), (6, 1), (7, 1), (7, -1)}
    assert [r.d for r in d.select(rules.direction_of_state().alias("d"), "bar_idx").orderBy("bar_idx").collect()] == [1, 1, 1, 1, 1, 1, -1, -1]


# controls -------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def market(spark):
    r = np.random.default_rng(2)
    rows = []
    for s in "ab":
        close = 50 + np.cumsum(r.normal(0, 1, 60))
        rows += [(s, i, float(c + r.normal()), float(c), None if i < 5 else 2.0, 2 * i, 2 * i + 2) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, bar_idx long, open double, close double, atr double, exec_start long, exec_end long")
    execs = bars.select("symbol", F.explode(F.sequence("exec_start", F.col("exec_end") - 1)).alias("exec_idx"), "open", "close")
    execs = execs.withColumns({"open": F.col("open") + F.col("exec_idx") % 2, "rate": (F.col("exec_idx") % 5 - 2) / 1000})
    found = [("a", "x", t, 1 if t % 2 else -1, t + 1, t + h, 50.0, 4.0, 0.0, 0.1 * t) for t, h in ((6, 3), (12, 1), (20, 9), (40, 4))] + [("b", "x", t, 1, t + 1, t + 12, 50.0, 2.0, 0.0, 1.0) for t in (5, 18, 30, 44, 46)]
    return bars, execs, spark.createDataFrame(found, "symbol string, strategy string, t long, dir int, e long, x long, entry double, risk double, cst double, r double")


def test_matched_controls(spark, market):
    bars, execs, found = market
    rules_ = trades.Rules(cost=0.1, cost_rel=0.002, funding_mult=2.0)
    rows = controls.matched_controls(found, bars, execs, rules_, replicas=8).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, controls.matched_controls(found.repartition(3), bars, execs, rules_, replicas=8).collect()))
    own = {(r.symbol, r.t): r for r in found.collect()}
    ex = {(r.symbol, r.exec_idx): r for r in execs.collect()}
    for s in "ab":
        for k in range(8):
            mine = sorted((r.start, r.held, r.t, r.r) for r in rows if r.symbol == s and r.replica == k)
            # b's trades want 65 of 55 bars: those that fit are placed
            assert len(mine) == 4 and all(a + h < b for (a, h, *_), (b, *_) in zip(mine, mine[1:])) and mine[0][0] >= 5 and mine[-1][0] + mine[-1][1] < 60
            for start, held, t, got in mine:
                o = own[s, t]
                assert held == o.x - o.e + 1
                entry = ex[s, 2 * (start + 1)].open
                px = ex[s, 2 * (start + held) + 1].close
                pay = [-o.dir * ex[s, i].rate * ex[s, i].open for i in range(2 * (start + 1) + 1, 2 * (start + held) + 2)]
                want = (o.dir * (px - entry) - 0.1 - 0.002 * entry + sum(2 * v if v < 0 else v for v in pay)) / (o.risk / o.entry * entry)
                assert abs(want - got) < 1e-9
    assert len({r.start for r in rows if r.symbol == "a" and r.t == 12}) > 4
    p = controls.control_p(found, controls.matched_controls(found, bars, execs, rules_, replicas=8), ["strategy"]).first()
    assert p.n == 9 and abs(p.placed_share - 8 / 9) < 1e-12 and 0 < p.p <= 1


def test_accounts(spark):
    t = spark.createDataFrame([("a", 1, 3, 1.1), ("a", 2, 3, 1.21), ("a", 5, 6, 1.0), ("b", 1, 5, 0.5)], "account string, t long, day_id long, equity double")
    days = spark.createDataFrame([("a", d) for d in range(2, 8)] + [("b", d) for d in range(4, 8)] + [("c", 7)], "account string, day_id long")
    s = controls.daily_series(t, days, ["account"])
    got = {(r.account, r.day_id): r.ret for r in s.collect()}
    assert len(got) == 11 and abs(got["a", 3] - 0.21) < 1e-12 and abs(got["a", 6] - (1 / 1.21 - 1)) < 1e-12 and got["b", 5] == -0.5 and got["a", 5] == got["c", 7] == 0
    cash = {r.day_id: r.ret for r in controls.pooled_series(s, "account", True).collect()}
    present = {r.day_id: r.ret for r in controls.pooled_series(s, "account", False).collect()}
    assert abs(cash[3] - 0.07) < 1e-12 and abs(present[3] - 0.21) < 1e-12 and abs(cash[5] + 0.5 / 3) < 1e-12 and abs(present[5] + 0.25) < 1e-12
    lost = spark.createDataFrame([("z", 1, 0.5), ("z", 2, -1.2), ("z", 3, 0.4)], "account string, day_id long, ret double")
    f = controls.account_figures(lost, ["account"]).first()
    assert (f.days, f.total, f.max_dd) == (3, -1.0, 1.0)


# venues ---------------------------------------------------------------------------------------------------------------
def test_venues(spark):
    at = lambda h, m=0, d=1: dt.datetime(2024, 1, d, h, m)
    times = spark.createDataFrame([("s", i, t) for i, t in enumerate([at(0), at(0, 15), at(8), at(9), at(16), at(0, d=2), at(8, 15, 2), at(16, d=2)])] + [("n", 0, at(8))], "symbol string, exec_idx long, ts timestamp_ntz")
    rates = spark.createDataFrame([("s", at(16), 0.001), ("s", at(0, d=2), -0.003), ("s", at(8, d=2), 0.002), ("s", at(16, d=4), 9.0)], "symbol string, ts timestamp_ntz, rate double")
    means = venues.mean_rate(rates, 2)
    assert means.first().mean_abs == pytest.approx(0.002)
    execs = times.select("symbol", "exec_idx", F.lit(0.0).alias("rate"))
    got = {(r.symbol, r.exec_idx): (r.rate, r.rate_abs) for r in venues.funded(execs, times, rates, means).collect()}
    assert [got["s", i] for i in range(8)] == [(0.0, pytest.approx(0.002)), (0.0, 0.0), (0.0, pytest.approx(0.002)), (0.0, 0.0), (0.001, 0.0), (-0.003, 0.0), (0.0, 0.0), (0.0, 0.0)]
    assert got["n", 0] == (0.0, 0.0)
    assert [r.ts for r in venues.unplaced(times, rates).collect()] == [at(8, d=2)]
    d = spark.createDataFrame([(x,) for x in (None, 0.5, 1.0, 1.9, 2.0, 50.0)], "m double")
    assert [r.s for r in d.select(venues.slippage(F.col("m"), ((2, 0.1), (1, 0.4))).alias("s")).collect()] == [None, None, 0.4, 0.4, 0.1, 0.1]
    value = spark.createDataFrame([("s", dt.date(2024, 1, i), float(v)) for i, v in enumerate([5, 1, 9, 4], 1)], "symbol string, day date, usd double")
    assert [r.median for r in venues.trailing_median(value, 2).orderBy("day").collect()] == [None, None, 3.0, 5.0]
    with pytest.raises(ValueError):
        venues.signal_bar_execution(times, "d1")


# portfolios -----------------------------------------------------------------------------------------------------------
def held_by_hand(rows, pay_mult):
    """Day after day: earn, drift, move."""
    out, hold = {}, {}
    for day in sorted({r["day"] for r in rows}):
        part = {r["asset"]: r for r in rows if r["day"] == day}
        price = sum(h * part[a]["ret"] for a, h in hold.items() if a in part)
        flows = [h * part[a]["carry"] - abs(h) * part[a]["carry_abs"] for a, h in hold.items() if a in part]
        carry = sum(v * pay_mult if v < 0 else v for v in flows)
        gain = price + carry
        hold = {a: h * (1 + (part[a]["ret"] if a in part else 0)) / (1 + gain) for a, h in hold.items()}
        paid = moved = 0.0
        if any(r["rebalance"] for r in part.values()):
            steps = {a: abs((r["weight"] or 0.0) - hold.get(a, 0.0)) for a, r in part.items()}
            moved, paid = sum(steps.values()), sum(v * part[a]["cost"] for a, v in steps.items())
            hold = {a: r["weight"] for a, r in part.items() if r["weight"]}
        out[day] = price, carry, moved, paid
    return out


def test_held_equals_a_walk_by_hand(spark):
    r = np.random.default_rng(9)
    rows = []
    for d in range(60):
        for k, a in enumerate("uvw"):
            if d >= 4 * k:
                rows.append({"portfolio": "p", "day": dt.date(2024, 1, 1) + dt.timedelta(d), "asset": a, "ret": float(r.normal(0, 0.05)), "carry": float(r.normal(0, 0.001)), "carry_abs": 0.0005, "weight": None if r.random() < 0.2 else float(r.normal(0, 0.5)), "rebalance": d % 7 == 3, "cost": 0.001 * (k + 1)})
    d = spark.createDataFrame(rows, "portfolio string, day date, asset string, ret double, carry double, carry_abs double, weight double, rebalance boolean, cost double")
    want = held_by_hand(rows, 1.5)
    got = portfolio.held(d, 1.5).collect()
    assert len(got) == 60
    for x in got:
        assert (x.price, x.carry, x.turnover, x.paid) == pytest.approx(want[x.day], abs=1e-10), x.day
    flips = hypotheses.flipped(d, 6).collect()
    base = {(x["day"], x["asset"]): x["weight"] for x in rows}
    assert len(flips) == 6 * len(rows) and all((f.weight is None) == (base[f.day, f.asset] is None) and abs(f.weight or 0) == abs(base[f.day, f.asset] or 0) for f in flips)
    assert len({tuple(f.weight for f in flips if f.portfolio == f"p flip {k}" and f.rebalance) for k in range(6)}) > 1


# worlds and statistics --------------------------------------------------------------------------------------------------
def test_persistence_is_recovered(spark):
    r = np.random.default_rng(3)
    moves = r.normal(0, 0.01, 3000)
    s = spark.createDataFrame([("s", i, 0.0, float(c)) for i, c in enumerate(moves)], "symbol string, bar_idx long, gap double, c double")
    got = np.array([x.c for x in worlds.persistent(s, 0.4).orderBy("bar_idx").collect()])
    want, before = [], 0.0
    for m in moves:
        before = m + 0.4 * before
        want.append(before)
    assert np.abs(got - want).max() < 1e-12 and abs(np.corrcoef(got[1:], got[:-1])[0, 1] - 0.4) < 0.05


def test_normal_distribution_as_columns(spark):
    n = NormalDist()
    x = [-8.0, -3.3, -0.4, 0.0, 1.1, 5.5, 7.5]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", stats.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - n.cdf(r.x)) < 1e-12 for r in got)
    p = [1e-6, 0.02, 0.03, 0.5, 0.9, 0.98, 0.999999]
    got = spark.createDataFrame([(v,) for v in p], "p double").select("p", stats.normal_quantile(F.col("p")).alias("x")).collect()
    assert all(abs(r.x - n.inv_cdf(r.p)) < 1e-7 for r in got)
    d = spark.createDataFrame([(0.04, 50.0), (0.04, 1.0)], "v double, n double").select(stats.expected_largest(F.col("v"), F.col("n")).alias("s")).collect()
    assert abs(d[0].s - stats.expected_max_sharpe(0.04, 50)) < 1e-7 and d[1].s == 0


def test_effective_trials_and_clusters(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(4, 80))
    x = np.array([base[i % 4] + 0.3 * r.normal(size=80) for i in range(14)])
    x[:, ::3] = 0.0  # flat days are not in the table
    rows = [("s", f"t{i:02d}", d, float(v)) for i, y in enumerate(x) for d, v in enumerate(y) if v]
    daily = spark.createDataFrame([*rows, ("s", "still", 1, 0.0)], "symbol string, strategy string, day_id long, ret double")
    days = spark.createDataFrame([("s", 80)], "symbol string, n_days long")
    corr = np.corrcoef(x)
    rho = corr[np.triu_indices(14, 1)].mean()
    got = stats.effective_trials(daily, days, ["symbol"]).first()
    assert got.series == 14 and abs(got.rho - rho) < 1e-9 and abs(got.n_eff - (rho + (1 - rho) * 14)) < 1e-9
    pairs = spark.createDataFrame([("s", f"t{i:02d}", f"t{j:02d}", float(corr[i, j])) for i in range(14) for j in range(14) if i != j], "symbol string, a string, b string, rho double")
    got = [stats.clusters(pairs, ["symbol"], t).first().clusters for t in (0.0, 0.5, 2.0)]
    assert got == [14, 4, 1]


# sources --------------------------------------------------------------------------------------------------------------
def test_hybrid_tape_is_pushed_down_and_repaired(spark, tmp_path):
    from barloom.sources import hybrid, tapes

    t0 = dt.datetime(2024, 3, 1)
    at = lambda i: t0 + dt.timedelta(minutes=15 * i)
    schema = "symbol string, ts_utc timestamp_ntz, open double, high double, low double, close double, volume double"
    spark.createDataFrame([(s, at(i), 10.0, 12.0, 4.0, 11.0, 1.0) for s in "abz" for i in range(20)], schema).write.parquet(f"{tmp_path}/spot")
    spark.createDataFrame([(s, at(i), 20.0, 22.0, 19.0, 21.0, 2.0) for s in "abz" for i in range(30)], schema).write.parquet(f"{tmp_path}/perp")
    spot, perp = spark.read.parquet(f"{tmp_path}/spot"), spark.read.parquet(f"{tmp_path}/perp")
    d = hybrid.hybrid(spot, perp, {"a": at(5), "b": at(18), "none": at(1)})
    plan = d._jdf.queryExecution().toString()
    scans = [x for x in plan.splitlines() if "PushedFilters" in x]
    assert len(scans) == 2 and all("ts_utc" in x.split("PushedFilters")[1] for x in scans)
    got = {(r.symbol, r.ts_utc): (r.source, r.open) for r in d.collect()}
    assert len(got) == 40 and got["a", at(4)] == ("spot", 10.0) and got["a", at(5)] == ("perpetual", 20.0) and got["b", at(17)] == ("spot", 10.0) and got["b", at(19)] == ("perpetual", 20.0)
    patches = spark.createDataFrame([("a", at(2)), ("b", at(3)), ("a", at(99))], "symbol string, ts_utc timestamp_ntz")
    twice = d.unionByName(d.filter(F.col("symbol") == "b"))
    fixed = {(r.symbol, r.ts_utc): (r.low, r.repaired) for r in hybrid.repaired(twice, patches).collect()}
    assert fixed["a", at(2)] == (10.0, True) and fixed["b", at(3)] == (4.0, False) and sum(v[1] for v in fixed.values()) == 1
    bars = hybrid.repaired(d, patches).withColumns({"seq": F.col("ts_utc"), "ts": F.col("ts_utc")})
    assert tapes.validate(bars).count() == 40


def test_a_stopped_run_goes_on(spark, tmp_path):
    from barloom.sources import shards

    todo = spark.createDataFrame([(s, f, f * 10.0) for s in "abcd" for f in range(3)], "symbol string, fold int, x double")
    path, asked = f"{tmp_path}/out", []

    def compute(part):
        asked.extend((r.symbol, r.fold) for r in part.collect())
        if len(asked) > 5 and not compute.again:
            raise RuntimeError("stopped")
        return part.select("symbol", "fold", (F.col("x") + 1).alias("y"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))

    compute.again = False
    with pytest.raises(RuntimeError):
        shards.resumed(spark, todo, compute, path, ["symbol", "fold"], 4)
    done = {(r.symbol, r.fold) for r in spark.read.parquet(path).collect()}
    assert 0 < len(done) < 12
    compute.again, before = True, len(asked)
    shards.resumed(spark, todo, compute, path, ["symbol", "fold"], 4)
    assert not done & set(asked[before:]) and len(set(asked[before:])) == 12 - len(done)
    assert spark.read.parquet(path).count() == 24 and shards.remaining(todo, path, ["symbol", "fold"]).count() == 0
    assert shards.resumed(spark, todo, compute, path, ["symbol", "fold"], 4) == 0
    shards.write_shards(spark.createDataFrame([("a", 0, 5.0, 1)], "symbol string, fold int, y double, k int"), path, ["symbol", "fold"])
    assert spark.read.parquet(path).count() == 23


@pytest.mark.parametrize("name", ["world_permuted", "world_planted", "world_edged"])
def test_worlds_of_zero_prices(spark, zero_prices, name):
    assert same_as_sql(spark, zero_prices, name)

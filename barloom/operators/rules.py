"""Rules over market states: what several frames say at once, ordered patterns of it as signals, and trades that follow them.

A pattern looks at a bar and the one before, so signals are windows; entries are rows, exit signals are rows of
their own table that the simulation joins by strategy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import ATR_SQL, BASE, ema_sql, ordered, recurrence_sql, with_atr, with_recurrences
from ..plans.storage import written
from ..sources.tapes import funding
from .bars import FRAMES, aligned, frame_bars, frame_sql, m15_of
from .states import NARROW, SLOPE, WIDE, descriptors, level_sql
from .stats import forward_net, holm
from .trades import EXECS_SQL, RULES, chained, execution_bars, followed_sql, outcomes, paths
from .worlds import SEED as STARTS
from .worlds import block_picks

#: The averages, the strength of trend and its level that the calibration rule asks for.
FAST, SLOW, STRONG = 50, 200, 25
#: The queries' tapes last a month, so their ribbons are shorter than the states' own, and a bar counts as complete with a quarter of its parts.
SHORT, SHARE = {"window": 8, "ribbon": (2, 3, 5, 8), "order": (3.0, 1.0), "slope_ema": 5, "slope_lag": 2}, 4
#: Resamples, their blocks, nets that a test needs, and what a state must reach.
RESAMPLES, BLOCK, LEAST_N, ACCEPT = 40, 24, 10, {"p_holm": 0.2, "mean": 0.0, "periods": 2, "replicas": 2}
STOP, HOLD, TRAIL, HORIZONS, COST = 2.0, 48, 3.0, (1, 4, 12), 0.1


def computed_states(m15: DataFrame, share: int = 1, **ribbon) -> DataFrame:
    """symbol, bar_idx, regime, h4_slope, h4_order, h4_width, h1_order, state of each hourly bar: descriptors of four frames, the
    higher ones as they were known at the bar's end. The regime is the daily order where the 8-hour order agrees, else 0."""

    def of(frame: str) -> DataFrame:
        return descriptors(frame_bars(m15, frame).withColumn("complete", F.col("n_m15") * share >= FRAMES[frame]), **ribbon)

    h1 = written(of("h1").select("symbol", "bar_idx", "available", F.col("order_level").alias("h1_order")))
    d = h1.drop("available")
    for frame, columns in (("h4", {"slope_level": "h4_slope", "order_level": "h4_order", "width_level": "h4_width"}), ("h8", {"order_level": "h8"}), ("d1", {"order_level": "d1"})):
        d = d.join(aligned(h1, of(frame), list(columns)).withColumnsRenamed({f"h_{a}": b for a, b in columns.items()}), ["symbol", "bar_idx"])
    regime = F.when(F.col("d1").isNotNull() & F.col("h8").isNotNull(), F.when(F.col("d1") == F.col("h8"), F.col("d1")).otherwise(0))
    d = d.withColumn("regime", regime)
    state = 9 * (F.col("regime") + 1) + 3 * (F.col("h4_slope") + 1) + F.col("h1_order") + 1
    return d.select("symbol", "bar_idx", "regime", "h4_slope", "h4_order", "h4_width", "h1_order", state.alias("state"))


def direction_of_state(regime="regime", slope="h4_slope"):
    """Where a state points: its regime, or the 4-hour slope where there is none."""
    return F.when(F.col(regime) != 0, F.col(regime)).otherwise(F.col(slope))


def rule_signals(states: DataFrame) -> DataFrame:
    """symbol, bar_idx, rule, dir, entry, exit, where either holds. A missing state enters nothing, and leaves a position that
    needs it."""
    before = {f"{c}_before": F.lag(c).over(ordered()) for c in ("h1_order", "h4_width", "regime")}
    d = states.withColumns(before).withColumn("dir", F.explode(F.array(F.lit(1), F.lit(-1))))
    dir_ = F.col("dir")
    with_it, known = lambda c: F.coalesce(F.col(c) == dir_, F.lit(False)), lambda c: F.col(c).isNotNull()
    against = lambda c: F.coalesce(F.col(c) == -dir_, F.lit(False))
    both = with_it("regime") & with_it("h4_slope")
    rules = {
        "trend_continuation": (both & with_it("h1_order") & known("h1_order_before") & ~with_it("h1_order_before"), ~with_it("regime") | against("h4_slope")),
        "pullback_end": (both & against("h1_order_before") & known("h1_order") & ~against("h1_order"), ~with_it("regime")),
        "compression_release": (F.coalesce((F.col("h4_width_before") == 0) & (F.col("h4_width") != 0), F.lit(False)) & with_it("h4_order") & known("regime") & ~against("regime"), F.lit(False)),
        "regime_change": (with_it("regime") & known("regime_before") & ~with_it("regime_before"), ~with_it("regime")),
    }
    each = F.array(*[F.struct(F.lit(k).alias("rule"), entry.alias("entry"), leave.alias("exit")) for k, (entry, leave) in rules.items()])
    return d.select("symbol", "bar_idx", "dir", F.inline(each)).filter("entry or exit").select("symbol", "bar_idx", "rule", "dir", "entry", "exit")


def calibration_signals(bars: DataFrame, fast: int = FAST, slow: int = SLOW, strong: float = STRONG) -> DataFrame:
    """The same columns for one plain rule: the fast average beyond the slow one in a strong trend, until they cross back."""
    d = with_recurrences(with_atr(bars), (fast, slow)).withColumn("dir", F.explode(F.array(F.lit(1), F.lit(-1))))
    ahead = F.col("dir") * (F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
    entry, leave = F.coalesce((ahead > 0) & (F.col("adx_14") > strong), F.lit(False)), F.coalesce(ahead < 0, F.lit(False))
    return d.select("symbol", "bar_idx", F.lit("calibration").alias("rule"), "dir", entry.alias("entry"), leave.alias("exit")).filter("entry or exit")


def followed(bars: DataFrame, execs: DataFrame, signals: DataFrame, rules=RULES, stop: float = STOP, hold: int = HOLD, trail: float = TRAIL) -> DataFrame:
    """Trades of signals that leave by stop, trailing stop, exit signal or time; each rule and direction is an account of its own."""
    name = F.concat("rule", F.when(F.col("dir") > 0, "+").otherwise("-")).alias("strategy")
    fixed = {"stop": stop, "target": float("inf"), "hold": hold, "trail": trail, "delay": 0}
    entries = signals.filter("entry").select("symbol", name, F.col("bar_idx").alias("t"), "dir", *[F.lit(v).alias(k) for k, v in fixed.items()])
    exits = signals.filter("exit").select("symbol", name, "bar_idx")
    return chained(outcomes(paths(bars, execs, entries, rules, exits)))


def pooled(trades: DataFrame) -> DataFrame:
    """Per strategy over all symbols: n, wins, mean R at single and double costs, t statistic, share of each exit kind."""
    r = F.col("r")
    return trades.groupBy("strategy").agg(
        F.count("*").alias("n"), F.count_if(r > 0).alias("wins"), F.avg(r).alias("mean_r"), F.avg(r - F.col("cst") / F.col("risk")).alias("mean_r_x2"),
        F.when(F.var_pop(r) > 0, F.avg(r) / F.stddev_pop(r) * F.sqrt(F.count(r))).alias("t_stat"), F.count_if(F.col("why") == 8).alias("by_signal"), F.count_if(F.col("why") == 7).alias("by_trail"),
    )


def state_nets(bars: DataFrame, states: DataFrame, horizons=HORIZONS, cost: float = COST) -> DataFrame:
    """Net moves of every bar in the direction of its state, by horizon: symbol, bar_idx, state, horizon, net (null without a
    direction or beyond the end)."""
    d = bars.join(states.select("symbol", "bar_idx", "state", direction_of_state().alias("dir")), ["symbol", "bar_idx"])
    out = None
    for h in horizons:
        one = forward_net(d, F.col("dir"), h, cost).select("symbol", "bar_idx", "state", F.lit(h).alias("horizon"), "net")
        out = one if out is None else out.unionByName(one)
    return out


def predictive(nets: DataFrame, primary: str, resamples: int = RESAMPLES, block: int = BLOCK, least_n: int = LEAST_N, accept: dict = ACCEPT) -> DataFrame:
    """Which states say where prices go. nets: symbol, bar_idx, period, state, horizon, net. Per state and horizon of the primary
    symbol, where it has ``least_n`` nets: n, mean, p_raw (share of block resamples of the symbol's bars, among those that hold
    the state, with a mean of 0 or less), p_holm over all tests, periods with a positive mean, other symbols with one, and the
    first condition that fails ('none' if all hold)."""
    d = nets.filter("state is not null and net is not null")
    own = d.filter(F.col("symbol") == primary)
    rows = written(own.withColumn("i", (F.row_number().over(Window.partitionBy("horizon").orderBy("bar_idx")) - 1).cast("long")))
    n = rows.groupBy("horizon").agg(F.count("*").alias("n"))
    means = block_picks(n, ["horizon"], resamples, block).join(rows, ["horizon", "i"]).groupBy("horizon", "r", "state").agg(F.avg("net").alias("m"))
    p = means.groupBy("horizon", "state").agg((F.count_if(F.col("m") <= 0) / F.count("*")).alias("p_raw"))
    tests = rows.groupBy("horizon", "state").agg(F.count("*").alias("n"), F.avg("net").alias("mean")).filter(F.col("n") >= least_n)
    stable = rows.groupBy("horizon", "state", "period").agg(F.avg("net").alias("m")).groupBy("horizon", "state").agg(F.count_if(F.col("m") > 0).alias("periods"))
    others = d.filter(F.col("symbol") != primary).groupBy("horizon", "state", "symbol").agg(F.avg("net").alias("m")).groupBy("horizon", "state").agg(F.count_if(F.col("m") > 0).alias("replicas"))
    key = ["horizon", "state"]
    t = tests.join(p, key, "left").join(stable, key).join(others, key, "left").withColumns({"p_raw": F.coalesce("p_raw", F.lit(1.0)), "replicas": F.coalesce("replicas", F.lit(0)), "of": F.lit(0), "test": F.col("horizon") * 1000 + F.col("state")})
    t = holm(t, ["of"], "p_raw", "test")  # one row a test
    fails = F.when(F.col("p_holm") > accept["p_holm"], "holm").when(F.col("mean") < accept["mean"], "mean").when(F.col("periods") < accept["periods"], "stability").when(F.col("replicas") < accept["replicas"], "replica").otherwise("none")
    return t.select(*key, "n", "mean", "p_raw", "p_holm", "periods", "replicas", fails.alias("fails"))


def _tape(spark, sf_dir: str):
    """15-minute bars, hourly bars with ATR and their execution bars, each written once."""
    m15 = written(m15_of(spark, sf_dir))
    return m15, written(with_atr(frame_bars(m15, "h1"))), written(execution_bars(m15, "h1", funding(spark, sf_dir)))


def rule_trades(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, execution bars, and trades of the rules and of the calibration."""
    m15, bars, execs = _tape(spark, sf_dir)
    signals = written(rule_signals(computed_states(m15, SHARE, **SHORT)).unionByName(calibration_signals(bars)))
    return bars, execs, written(followed(bars, execs, signals))


def states_computed(spark, sf_dir: str) -> DataFrame:
    return computed_states(written(m15_of(spark, sf_dir)), SHARE, **SHORT)


def rules_signals(spark, sf_dir: str) -> DataFrame:
    m15, bars, _ = _tape(spark, sf_dir)
    return rule_signals(computed_states(m15, SHARE, **SHORT)).unionByName(calibration_signals(bars))


def rules_trades(spark, sf_dir: str) -> DataFrame:
    t = rule_trades(spark, sf_dir)[2]
    return pooled(t).select("strategy", "n", "wins", "by_signal", "by_trail", *[F.round(c, 6).alias(c) for c in ("mean_r", "mean_r_x2", "t_stat")])


def rules_state_nets(spark, sf_dir: str) -> DataFrame:
    m15, bars, _ = _tape(spark, sf_dir)
    d = state_nets(bars, computed_states(m15, SHARE, **SHORT)).filter("state is not null").groupBy("state", "horizon")
    return d.agg(F.count("net").alias("n"), F.round(F.avg("net"), 6).alias("mean_net"))


def rules_predictive(spark, sf_dir: str) -> DataFrame:
    m15, bars, _ = _tape(spark, sf_dir)
    weeks = bars.select("symbol", "bar_idx", F.date_trunc("week", "bucket").alias("period"))
    d = predictive(written(state_nets(bars, computed_states(m15, SHARE, **SHORT)).join(weeks, ["symbol", "bar_idx"])), "click")
    return d.select("horizon", "state", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p_raw", "p_holm")], "periods", "replicas", "fails")


QUERIES = {f.__name__: f for f in (states_computed, rules_signals, rules_trades, rules_state_nets, rules_predictive)}


# the same in SQL ------------------------------------------------------------------------------------------------------
def _levels_sql(f: str) -> str:
    emas, (hi, lo) = SHORT["ribbon"], SHORT["order"]
    w, n = "(PARTITION BY symbol ORDER BY bar_idx)", SHORT["window"]
    names = ", ".join(f"ema_{k}" for k in emas)
    return f"""{frame_sql(f, f + 'b')}, {f}t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM {f}b WINDOW w AS {w}),
{f}a AS (SELECT *, CASE WHEN bar_idx >= 13 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 13 PRECEDING) END AS atr FROM {f}t), {ema_sql(emas, f + 'a', f + 'r')},
{f}z AS (SELECT a.*, {', '.join(f'CASE WHEN r.bar_idx >= {k - 1} THEN r.ema_{k} END AS ema_{k}' for k in emas)} FROM {f}a a JOIN {f}r r USING (symbol, bar_idx)),
{f}y AS (SELECT *, {' + '.join(f'sign(ema_{a} - ema_{b})' for a, b in zip(emas, emas[1:]))} AS score, CASE WHEN ema_{emas[-1]} IS NOT NULL THEN (greatest({names}) - least({names})) / nullif(atr, 0) END AS width,
 (ema_{SHORT['slope_ema']} - lag(ema_{SHORT['slope_ema']}, {SHORT['slope_lag']}) OVER {w}) / nullif(atr, 0) AS slope FROM {f}z),
{f}c AS (SELECT *, list(width) OVER v AS ws, count(width) OVER v AS n FROM {f}y WINDOW v AS (PARTITION BY symbol ORDER BY bar_idx ROWS {n} PRECEDING)),
{f}p AS (SELECT *, CASE WHEN n = {n + 1} THEN (len(list_filter(ws, lambda v: v < width)) + (len(list_filter(ws, lambda v: v = width)) + 1) / 2.0) / {n + 1} END AS pct FROM {f}c),
{f}l AS MATERIALIZED (SELECT symbol, bar_idx, available, n_m15 * {SHARE} >= {FRAMES[f]} AS complete, {level_sql('score', hi, lo, -hi, -lo)} AS ord, {level_sql('pct', *WIDE, *NARROW, (2, 1, 0))} AS wid, {level_sql('slope', *SLOPE, -SLOPE[0], -SLOPE[1])} AS slo FROM {f}p)"""


_STATES = f"""{BASE}, {ATR_SQL}, {', '.join(_levels_sql(f) for f in ('h1', 'h4', 'h8', 'd1'))},
j AS (SELECT h1l.symbol, h1l.bar_idx, h1l.ord AS h1_order, h4.slo AS h4_slope, h4.ord AS h4_order, h4.wid AS h4_width, h8.ord AS h8, d1.ord AS d1 FROM h1l
 ASOF LEFT JOIN (SELECT * FROM h4l WHERE complete) h4 ON h1l.symbol = h4.symbol AND h1l.available >= h4.available ASOF LEFT JOIN (SELECT * FROM h8l WHERE complete) h8 ON h1l.symbol = h8.symbol AND h1l.available >= h8.available
 ASOF LEFT JOIN (SELECT * FROM d1l WHERE complete) d1 ON h1l.symbol = d1.symbol AND h1l.available >= d1.available),
st AS MATERIALIZED (SELECT *, 9 * (regime + 1) + 3 * (h4_slope + 1) + h1_order + 1 AS state FROM (SELECT *, CASE WHEN d1 IS NULL OR h8 IS NULL THEN NULL WHEN d1 = h8 THEN d1 ELSE 0 END AS regime FROM j))"""
_lag = lambda x: f"lag({x}) OVER (PARTITION BY symbol ORDER BY bar_idx)"
_ADX = f"""ci AS (SELECT *, CASE WHEN bar_idx > 0 THEN greatest(high - {_lag('high')}, 0) END AS rise, CASE WHEN bar_idx > 0 THEN greatest({_lag('low')} - low, 0) END AS fall FROM a),
cj AS (SELECT *, CASE WHEN rise > fall THEN rise ELSE 0 END AS plus, CASE WHEN fall > rise THEN fall ELSE 0 END AS minus FROM ci),
{recurrence_sql({f'ema_{FAST}': ('close', 2 / (FAST + 1)), f'ema_{SLOW}': ('close', 2 / (SLOW + 1)), 'p1': ('plus', 1 / 14), 'm1': ('minus', 1 / 14)}, 'cj', 'cr')},
cd AS (SELECT *, CASE WHEN bar_idx >= 13 THEN 100 * abs(p1 - m1) / nullif(p1 + m1, 0) END AS dx FROM cr), {recurrence_sql({'adx': ('dx', 1 / 14)}, 'cd', 'cx')},
ca AS (SELECT symbol, cd.bar_idx, CASE WHEN cd.bar_idx >= {SLOW - 1} THEN ema_{FAST} - ema_{SLOW} END AS ahead, CASE WHEN cd.bar_idx >= 26 THEN adx END AS adx FROM cd JOIN cx USING (symbol, bar_idx))"""
_SIGNALS = f"""{_STATES}, {_ADX}, sl AS (SELECT *, {_lag('h1_order')} AS o1, {_lag('h4_width')} AS w1, {_lag('regime')} AS r1 FROM st),
sd AS (SELECT sl.*, v.dir FROM sl, (VALUES (1), (-1)) v(dir)),
rs AS MATERIALIZED (SELECT * FROM (
 SELECT symbol, bar_idx, 'trend_continuation' AS rule, dir, coalesce(regime = dir AND h4_slope = dir AND h1_order = dir AND o1 <> dir, false) AS entry, regime IS DISTINCT FROM dir OR coalesce(h4_slope = -dir, false) AS exit FROM sd
 UNION ALL SELECT symbol, bar_idx, 'pullback_end', dir, coalesce(regime = dir AND h4_slope = dir AND o1 = -dir AND h1_order <> -dir, false), regime IS DISTINCT FROM dir FROM sd
 UNION ALL SELECT symbol, bar_idx, 'compression_release', dir, coalesce(w1 = 0 AND h4_width <> 0 AND h4_order = dir AND regime <> -dir, false), false FROM sd
 UNION ALL SELECT symbol, bar_idx, 'regime_change', dir, coalesce(regime = dir AND r1 <> dir, false), regime IS DISTINCT FROM dir FROM sd
 UNION ALL SELECT symbol, bar_idx, 'calibration', dir, coalesce(dir * ahead > 0 AND adx > {STRONG}, false), coalesce(dir * ahead < 0, false) FROM ca, (VALUES (1), (-1)) v(dir)) WHERE entry OR exit)"""
TRADES_SQL = f"""{_SIGNALS}, {EXECS_SQL}, xs AS (SELECT symbol, rule || CASE WHEN dir > 0 THEN '+' ELSE '-' END AS strategy, bar_idx FROM rs WHERE exit),
c0 AS (SELECT a.symbol, rule || CASE WHEN dir > 0 THEN '+' ELSE '-' END AS strategy, a.bar_idx AS t, dir, {STOP}::DOUBLE AS stop, 'inf'::DOUBLE AS target, {HOLD} AS hold, {TRAIL}::DOUBLE AS trail, atr, t1, a.bar_idx + 1 AS e
 FROM a JOIN rs USING (symbol, bar_idx) JOIN (SELECT symbol, max(bar_idx) + 1 AS t1 FROM a GROUP BY symbol) USING (symbol) WHERE entry AND atr > 0),
{followed_sql(RULES, leaving="xs.bar_idx IS NOT NULL", joined="LEFT JOIN xs ON xs.symbol = ex.symbol AND xs.strategy = c.strategy AND xs.bar_idx = ex.bar_idx")}"""
_NETS = f"""{_STATES}, dn AS (SELECT a.symbol, a.bar_idx, date_trunc('week', a.bucket) AS period, state, CASE WHEN regime <> 0 THEN regime ELSE h4_slope END AS dir, close, open FROM a JOIN st USING (symbol, bar_idx)),
f AS MATERIALIZED ({' UNION ALL '.join(f"SELECT symbol, bar_idx, period, state, {h} AS horizon, CASE WHEN dir <> 0 THEN dir * (lead(close, {h}) OVER w - lead(open) OVER w) - {COST} END AS net FROM dn WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)" for h in HORIZONS)})"""
ORACLE = {
    "states_computed": f"{_STATES} SELECT symbol, bar_idx, regime, h4_slope, h4_order, h4_width, h1_order, state FROM st",
    "rules_signals": f"{_SIGNALS} SELECT * FROM rs",
    "rules_trades": f"""{TRADES_SQL} SELECT strategy, count(*) AS n, count(*) FILTER (WHERE r > 0) AS wins, round(avg(r), 6) AS mean_r, round(avg(r - cst / risk), 6) AS mean_r_x2, round(CASE WHEN var_pop(r) > 0 THEN avg(r) / stddev_pop(r) * sqrt(count(r)) END, 6) AS t_stat,
 count(*) FILTER (WHERE why = 8) AS by_signal, count(*) FILTER (WHERE why = 7) AS by_trail FROM ch GROUP BY strategy""",
    "rules_state_nets": f"{_NETS} SELECT state, horizon, count(net) AS n, round(avg(net), 6) AS mean_net FROM f WHERE state IS NOT NULL GROUP BY 1, 2",
    "rules_predictive": f"""{_NETS}, ok AS (SELECT * FROM f WHERE state IS NOT NULL AND net IS NOT NULL), x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY bar_idx) - 1 AS i, count(*) OVER (PARTITION BY horizon) AS len FROM ok WHERE symbol = 'click'),
g AS (SELECT horizon, len, rr AS r, y // {BLOCK} AS b, y % {BLOCK} AS kk FROM (SELECT DISTINCT horizon, len FROM x), range({RESAMPLES}) q(rr), LATERAL (SELECT unnest(range(len)) AS y)),
pk AS MATERIALIZED (SELECT horizon, r, (('0x' || substr(md5('{STARTS}|' || r || '|' || b), 1, 7))::BIGINT % len + kk) % len AS i FROM g), mm AS (SELECT horizon, r, state, avg(net) AS m FROM pk JOIN x USING (horizon, i) GROUP BY 1, 2, 3),
pr AS (SELECT horizon, state, count(*) FILTER (WHERE m <= 0) / count(*) AS p_raw FROM mm GROUP BY 1, 2), te AS (SELECT horizon, state, count(*) AS n, avg(net) AS mean FROM x GROUP BY 1, 2 HAVING count(*) >= {LEAST_N}),
pe AS (SELECT horizon, state, count(*) FILTER (WHERE m > 0) AS periods FROM (SELECT horizon, state, period, avg(net) AS m FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2),
re AS (SELECT horizon, state, count(*) FILTER (WHERE m > 0) AS replicas FROM (SELECT horizon, state, symbol, avg(net) AS m FROM ok WHERE symbol <> 'click' GROUP BY 1, 2, 3) GROUP BY 1, 2),
al AS (SELECT horizon, state, n, mean, coalesce(p_raw, 1) AS p_raw, periods, coalesce(replicas, 0) AS replicas FROM te LEFT JOIN pr USING (horizon, state) JOIN pe USING (horizon, state) LEFT JOIN re USING (horizon, state)),
sp AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p_raw, horizon * 1000 + state) + 1) * p_raw) AS step FROM al), ho AS (SELECT *, max(step) OVER (ORDER BY p_raw, horizon * 1000 + state ROWS UNBOUNDED PRECEDING) AS p_holm FROM sp)
SELECT horizon, state, n, round(mean, 6) AS mean, round(p_raw, 6) AS p_raw, round(p_holm, 6) AS p_holm, periods, replicas, CASE WHEN p_holm > {ACCEPT['p_holm']} THEN 'holm' WHEN mean < {ACCEPT['mean']} THEN 'mean' WHEN periods < {ACCEPT['periods']} THEN 'stability' WHEN replicas < {ACCEPT['replicas']} THEN 'replica' ELSE 'none' END AS fails FROM ho""",
}

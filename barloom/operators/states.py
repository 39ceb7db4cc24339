"""Market states: hysteresis levels, ribbon descriptors, spells and transitions, all as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import ATR_SQL, BASE, ordered, ema_sql, full, with_atr, with_recurrences
from .bars import aligned, frame_bars, frame_sql, h1_of, m15_of

#: The ribbon's periods, thresholds and windows.
RIBBON = (8, 13, 21, 34, 55, 89, 144)
ORDER, WIDE, NARROW, SLOPE = (6.0, 2.0), (0.80, 0.65), (0.20, 0.35), (0.30, 0.10)
PERCENTILE_WINDOW, SLOPE_EMA, SLOPE_LAG = 500, 34, 5
#: Tests run on a month of bars, so the query uses a shorter percentile window.
QUERY_WINDOW = 100


def _side(x, enter, stay, up: bool):
    """Whether the level is on: decided by the last value that isn't in between; a missing value decides for off."""
    inside, on = ((x >= stay) & (x < enter), x >= enter) if up else ((x <= stay) & (x > enter), x <= enter)
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(F.when(F.coalesce(inside, F.lit(False)), None).otherwise(F.coalesce(on, F.lit(False))), ignorenulls=True).over(w), F.lit(False))


def hysteresis(x, enter_hi, stay_hi, enter_lo, stay_lo, hi=1, mid=0, lo=-1):
    """Three levels with memory; null where x is null, which also resets it."""
    return F.when(x.isNull(), None).when(_side(x, enter_hi, stay_hi, True), hi).when(_side(x, enter_lo, stay_lo, False), lo).otherwise(mid)


def rank_in_window(x: str, n: int):
    """Average rank of the current value among the last n + 1, as a share; null until there are so many."""
    w = ordered().rowsBetween(-n, 0)
    values = F.collect_list(x).over(w)
    less, same = F.size(F.filter(values, lambda v: v < F.col(x))), F.size(F.filter(values, lambda v: v == F.col(x)))
    return F.when((F.count(x).over(w) == n + 1) & F.col(x).isNotNull(), (less + (same + 1) / 2) / (n + 1))


def descriptors(bars: DataFrame, window: int = PERCENTILE_WINDOW, ribbon: tuple = RIBBON, order: tuple = ORDER, slope_ema: int = SLOPE_EMA, slope_lag: int = SLOPE_LAG) -> DataFrame:
    """symbol, bar_idx, available, order_level, width_level, slope_level, state of each bar."""
    d = with_recurrences(with_atr(bars), ribbon)
    e = [F.col(f"ema_{n}") for n in ribbon]
    score = sum((F.signum(a - b) for a, b in zip(e, e[1:])), F.lit(0.0))
    d = d.withColumn("score", score)
    d = d.withColumn("width", F.when(e[-1].isNotNull(), F.try_divide(F.greatest(*e) - F.least(*e), F.col("atr"))))
    d = d.withColumn("slope", F.try_divide(F.col(f"ema_{slope_ema}") - F.lag(f"ema_{slope_ema}", slope_lag).over(ordered()), F.col("atr")))
    d = d.withColumn("pct", rank_in_window("width", window))
    d = d.withColumns(
        {
            "order_level": hysteresis(F.col("score"), *order, -order[0], -order[1]),
            "width_level": hysteresis(F.col("pct"), *WIDE, *NARROW, 2, 1, 0),
            "slope_level": hysteresis(F.col("slope"), *SLOPE, -SLOPE[0], -SLOPE[1]),
        }
    )
    state = 9 * (F.col("order_level") + 1) + 3 * F.col("width_level") + F.col("slope_level") + 1
    return d.withColumn("state", state)


def combined(h1: DataFrame, h4: DataFrame, h8: DataFrame, d1: DataFrame) -> DataFrame:
    """State of each H1 bar: regime where the daily and the 8-hour order agree, slope of 4 hours, own order."""
    base = h1.select("symbol", "bar_idx", "order_level")
    for name, frame, column in (("h4", h4, "slope_level"), ("h8", h8, "order_level"), ("d1", d1, "order_level")):
        base = base.join(aligned(h1, frame, [column]).withColumnRenamed(f"h_{column}", name), ["symbol", "bar_idx"])
    regime = F.when(F.col("d1").isNotNull() & F.col("h8").isNotNull(), F.when(F.col("d1") == F.col("h8"), F.col("d1")).otherwise(0))
    return base.withColumn("regime", regime).withColumn("state", 9 * (F.col("regime") + 1) + 3 * (F.col("h4") + 1) + F.col("order_level") + 1)


def spells(d: DataFrame, state: str = "state") -> DataFrame:
    """Runs of equal states: symbol, state, start, length. Nulls end a run and form none."""
    changed = F.when(F.col(state).eqNullSafe(F.lag(state).over(ordered())) & (F.row_number().over(ordered()) > 1), 0).otherwise(1)
    d = d.withColumn("run", F.sum(changed).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    return d.filter(F.col(state).isNotNull()).groupBy("symbol", "run").agg(F.first(state).alias("state"), F.min("bar_idx").alias("start"), F.count("*").alias("length")).drop("run")


def described(runs: DataFrame) -> DataFrame:
    """Per symbol and state: bars, spells, mean and median length, share of bars."""
    total = Window.partitionBy("symbol")
    d = runs.groupBy("symbol", "state").agg(F.sum("length").alias("bars"), F.count("*").alias("spells"), F.avg("length").alias("mean_length"), F.expr("percentile(length, 0.5)").alias("median_length"))
    return d.withColumn("share", F.col("bars") / F.sum("bars").over(total))


def transitions(d: DataFrame, state: str = "state") -> DataFrame:
    """Per symbol: how often a state follows another on the next bar, and its share of the first one's bars."""
    n = d.withColumn("after", F.lead(state).over(ordered())).filter(F.col(state).isNotNull() & F.col("after").isNotNull())
    n = n.groupBy("symbol", F.col(state).alias("before"), "after").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "before")))


def _states(spark, sf_dir: str) -> DataFrame:
    return descriptors(h1_of(spark, sf_dir), QUERY_WINDOW)


def states_descriptors(spark, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).select("symbol", "bar_idx", F.round("pct", 6).alias("pct"), "order_level", "width_level", "slope_level", F.col("state").cast("int").alias("state"))


def states_descriptors_m15(spark, sf_dir: str) -> DataFrame:
    """The same of 15-minute bars, with the percentile window of 500."""
    b = m15_of(spark, sf_dir).withColumnRenamed("exec_idx", "bar_idx").withColumn("available", F.col("ts") + F.expr("interval 15 minutes"))
    d = descriptors(b, PERCENTILE_WINDOW)
    return d.select("symbol", "bar_idx", F.round("pct", 6).alias("pct"), "order_level", "width_level", "slope_level", F.col("state").cast("int").alias("state"))


def states_hysteresis(spark, sf_dir: str) -> DataFrame:
    d = h1_of(spark, sf_dir)
    x = F.col("close") - F.lag("close").over(ordered())
    return d.withColumn("x", x).select("symbol", "bar_idx", hysteresis(F.col("x"), 6.0, 2.0, -6.0, -2.0).alias("level"))


def _trend(spark, sf_dir: str) -> DataFrame:
    """A short state for the run queries: the side of the close against its last 20 bars, with memory."""
    d = h1_of(spark, sf_dir)
    x = F.col("close") - full(F.avg("close").over(ordered().rowsBetween(-19, 0)), 20)
    return d.withColumn("x", x).withColumn("state", hysteresis(F.col("x"), 20.0, 2.0, -20.0, -2.0))


def states_spells(spark, sf_dir: str) -> DataFrame:
    return spells(_trend(spark, sf_dir))


def states_described(spark, sf_dir: str) -> DataFrame:
    d = described(spells(_trend(spark, sf_dir)))
    return d.select("symbol", "state", "bars", "spells", F.round("mean_length", 6).alias("mean_length"), "median_length", F.round("share", 6).alias("share"))


def states_transitions(spark, sf_dir: str) -> DataFrame:
    return transitions(_trend(spark, sf_dir)).withColumn("share", F.round("share", 6))


def states_combined(spark, sf_dir: str) -> DataFrame:
    """The combined state over short-mean trends of four frames."""
    m15 = m15_of(spark, sf_dir)

    def levels(frame: str) -> DataFrame:
        b = frame_bars(m15, frame)
        x = F.col("close") - full(F.avg("close").over(ordered().rowsBetween(-2, 0)), 3)
        b = b.withColumn("x", x).withColumn("complete", F.col("n_m15") > 0)
        return b.withColumns({"order_level": hysteresis(F.col("x"), 15.0, 1.0, -15.0, -1.0), "slope_level": hysteresis(F.col("x"), 5.0, 1.0, -5.0, -1.0)})

    return combined(*[levels(f) for f in ("h1", "h4", "h8", "d1")]).select("symbol", "bar_idx", "regime", "state")


QUERIES = {"states_descriptors": states_descriptors, "states_descriptors_m15": states_descriptors_m15, "states_hysteresis": states_hysteresis, "states_spells": states_spells, "states_described": states_described, "states_transitions": states_transitions, "states_combined": states_combined}


def level_sql(x: str, hi: float, stay_hi: float, lo: float, stay_lo: float, names=(1, 0, -1)) -> str:
    w = "OVER (PARTITION BY symbol ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"
    up = f"coalesce(last_value(CASE WHEN {x} >= {stay_hi} AND {x} < {hi} THEN NULL ELSE coalesce({x} >= {hi}, false) END IGNORE NULLS) {w}, false)"
    down = f"coalesce(last_value(CASE WHEN {x} <= {stay_lo} AND {x} > {lo} THEN NULL ELSE coalesce({x} <= {lo}, false) END IGNORE NULLS) {w}, false)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {up} THEN {names[0]} WHEN {down} THEN {names[2]} ELSE {names[1]} END"


def _descriptor_sql(window: int = QUERY_WINDOW) -> str:
    e = [f"CASE WHEN r.bar_idx >= {n - 1} THEN r.ema_{n} END AS ema_{n}" for n in RIBBON]
    pairs = " + ".join(f"sign(ema_{a} - ema_{b})" for a, b in zip(RIBBON, RIBBON[1:]))
    emas = ", ".join(f"ema_{n}" for n in RIBBON)
    return f"""{BASE}, {ATR_SQL}, {ema_sql(RIBBON, 'a', 'r')}, z AS (SELECT a.*, {', '.join(e)} FROM a JOIN r USING (symbol, bar_idx)),
y AS (SELECT *, {pairs} AS score, CASE WHEN ema_144 IS NOT NULL THEN (greatest({emas}) - least({emas})) / nullif(atr, 0) END AS width, (ema_34 - lag(ema_34, 5) OVER (PARTITION BY symbol ORDER BY bar_idx)) / nullif(atr, 0) AS slope FROM z),
c AS (SELECT *, list(width) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS {window} PRECEDING) AS ws, count(width) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS {window} PRECEDING) AS n FROM y),
p AS (SELECT *, CASE WHEN n = {window + 1} THEN (len(list_filter(ws, lambda v: v < width)) + (len(list_filter(ws, lambda v: v = width)) + 1) / 2.0) / {window + 1} END AS pct FROM c),
l AS (SELECT symbol, bar_idx, pct, {level_sql('score', 6, 2, -6, -2)} AS order_level, {level_sql('pct', .8, .65, .2, .35, (2, 1, 0))} AS width_level, {level_sql('slope', .3, .1, -.3, -.1)} AS slope_level FROM p)
SELECT symbol, bar_idx, round(pct, 6) AS pct, order_level, width_level, slope_level, 9 * (order_level + 1) + 3 * width_level + slope_level + 1 AS state FROM l"""


_TREND = f"{BASE}, x AS (SELECT *, CASE WHEN bar_idx >= 19 THEN close - avg(close) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 19 PRECEDING) END AS x FROM b), s AS (SELECT symbol, bar_idx, {level_sql('x', 20, 2, -20, -2)} AS state FROM x)"
_RUNS = f"""{_TREND}, g AS (SELECT *, bar_idx - row_number() OVER (PARTITION BY symbol, state ORDER BY bar_idx) AS run FROM s),
runs AS (SELECT symbol, state, min(bar_idx) AS start, count(*) AS length FROM g WHERE state IS NOT NULL GROUP BY symbol, state, run)"""


def _combined_sql() -> str:
    from .bars import M15, frame_sql

    parts = [f"WITH {M15}"]
    for f in ("h1", "h4", "h8", "d1"):
        parts.append(frame_sql(f, f))
        parts.append(f"{f}x AS (SELECT *, CASE WHEN bar_idx >= 2 THEN close - avg(close) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 2 PRECEDING) END AS x FROM {f})")
        parts.append(f"{f}l AS (SELECT symbol, bar_idx, available, {level_sql('x', 15, 1, -15, -1)} AS ord, {level_sql('x', 5, 1, -5, -1)} AS slo FROM {f}x)")
    return f"""{', '.join(parts)}, j AS (SELECT h1l.symbol, h1l.bar_idx, h1l.ord, h4l.slo AS h4, h8l.ord AS h8, d1l.ord AS d1 FROM h1l
ASOF LEFT JOIN h4l ON h1l.symbol = h4l.symbol AND h1l.available >= h4l.available ASOF LEFT JOIN h8l ON h1l.symbol = h8l.symbol AND h1l.available >= h8l.available ASOF LEFT JOIN d1l ON h1l.symbol = d1l.symbol AND h1l.available >= d1l.available),
k AS (SELECT *, CASE WHEN d1 IS NULL OR h8 IS NULL THEN NULL WHEN d1 = h8 THEN d1 ELSE 0 END AS regime FROM j)
SELECT symbol, bar_idx, regime, 9 * (regime + 1) + 3 * (h4 + 1) + ord + 1 AS state FROM k"""


ORACLE = {
    "states_descriptors": _descriptor_sql(),
    "states_descriptors_m15": _descriptor_sql(PERCENTILE_WINDOW).replace(frame_sql("h1", "b"), "b AS (SELECT * RENAME (exec_idx AS bar_idx) FROM m15)"),
    "states_hysteresis": f"{BASE}, x AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) AS x FROM b) SELECT symbol, bar_idx, {level_sql('x', 6, 2, -6, -2)} AS level FROM x",
    "states_spells": f"{_RUNS} SELECT * FROM runs",
    "states_described": f"{_RUNS} SELECT symbol, state, sum(length)::BIGINT AS bars, count(*) AS spells, round(avg(length), 6) AS mean_length, median(length) AS median_length, round(sum(length) / sum(sum(length)) OVER (PARTITION BY symbol), 6) AS share FROM runs GROUP BY symbol, state",
    "states_transitions": f"{_TREND}, n AS (SELECT symbol, state AS before, lead(state) OVER (PARTITION BY symbol ORDER BY bar_idx) AS after FROM s) SELECT symbol, before, after, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY symbol, before), 6) AS share FROM n WHERE before IS NOT NULL AND after IS NOT NULL GROUP BY symbol, before, after",
    "states_combined": _combined_sql(),
}

"""Bars of several time frames without look-ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tapes import table, ticks, trading_date

#: Expected 15-minute bars in a bar of each frame.
FRAMES = {"m15": 1, "h1": 4, "h4": 16, "h8": 32, "d1": 96}


def bucket(ts, frame: str):
    """Start of the bar that ts falls into, by the wall clock; daily bars follow the trading date."""
    if frame == "d1":
        return trading_date(ts).cast("timestamp_ntz")
    if frame == "m15":
        return F.date_trunc("hour", ts) + F.make_dt_interval(mins=(F.minute(ts) / 15).cast("int") * 15)
    hours = FRAMES[frame] // 4
    return F.date_trunc("day", ts) + F.make_dt_interval(hours=(F.hour(ts) / hours).cast("int") * hours)


def tick_bars(tape: DataFrame) -> DataFrame:
    """15-minute bars of a tape, with exec_idx and day_id; one shuffle by symbol and time, partial sums map-side."""
    order = F.struct("ts", "seq")
    b = tape.withColumn("bar_ts", bucket(F.col("ts"), "m15")).groupBy("symbol", "bar_ts").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.when(F.count("volume") == F.count("*"), F.sum("volume")).alias("volume"),
    )
    w = Window.partitionBy("symbol").orderBy("ts")
    day = Window.partitionBy("symbol").orderBy("trading_date")
    b = b.withColumnRenamed("bar_ts", "ts").withColumn("trading_date", trading_date(F.col("ts")))
    exec_idx, day_id = (F.row_number().over(w) - 1).cast("long"), (F.dense_rank().over(day) - 1).cast("long")
    return b.select("symbol", "ts", "open", "high", "low", "close", "volume", exec_idx.alias("exec_idx"), day_id.alias("day_id"))


def frame_bars(m15: DataFrame, frame: str) -> DataFrame:
    """Bars of a longer frame: those that hold no trade don't exist, so bar_idx is dense over existing bars."""
    order = F.col("ts")
    b = m15.withColumn("bucket", bucket(F.col("ts"), frame)).groupBy("symbol", "bucket").agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"),
        F.when(F.count("volume") == F.count("*"), F.sum("volume")).alias("volume"), F.count("*").alias("n_m15"),
        F.min("exec_idx").alias("exec_start"), (F.max("exec_idx") + 1).alias("exec_end"), F.min_by("day_id", order).alias("day_id"),
    )
    full = F.col("n_m15") >= FRAMES[frame] if frame == "d1" else F.col("n_m15") == FRAMES[frame]
    end = F.col("bucket") + (F.expr("interval 1 day") if frame == "d1" else F.make_dt_interval(hours=F.lit(FRAMES[frame] // 4)))
    idx = F.row_number().over(Window.partitionBy("symbol").orderBy("bucket")) - 1
    return b.select("symbol", idx.cast("long").alias("bar_idx"), "bucket", end.alias("available"), "open", "high", "low", "close", "volume", "n_m15", full.alias("complete"), "exec_start", "exec_end", "day_id")


def aligned(base: DataFrame, higher: DataFrame, columns: list[str]) -> DataFrame:
    """As-of join: for each base bar the columns of the last complete higher bar that was available by its end.

    Both sides are unioned and ordered once per symbol, so it costs one shuffle and no range join.
    """
    mark = F.struct(*columns)
    left = base.select("symbol", "available", F.lit(1).alias("side"), F.col("bar_idx"), F.lit(None).cast(higher.select(mark.alias("v")).schema["v"].dataType).alias("v"))
    right = higher.filter("complete").select("symbol", "available", F.lit(0).alias("side"), F.lit(None).cast("long").alias("bar_idx"), mark.alias("v"))
    w = Window.partitionBy("symbol").orderBy("available", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("v", F.last("v", ignorenulls=True).over(w))
    return both.filter("side = 1").select("symbol", "bar_idx", *[F.col("v")[c].alias(f"h_{c}") for c in columns])


def m15_of(spark, sf_dir: str) -> DataFrame:
    return tick_bars(ticks(spark, sf_dir))


def h1_of(spark, sf_dir: str) -> DataFrame:
    return frame_bars(m15_of(spark, sf_dir), "h1")


def _query(frame: str):
    def q(spark, sf_dir: str) -> DataFrame:
        return frame_bars(m15_of(spark, sf_dir), frame)

    return q


def bars_m15(spark, sf_dir: str) -> DataFrame:
    return m15_of(spark, sf_dir)


def align_h4(spark, sf_dir: str) -> DataFrame:
    m15 = m15_of(spark, sf_dir)
    higher = frame_bars(m15, "h4").withColumn("complete", F.col("n_m15") >= 4)
    return aligned(frame_bars(m15, "h1"), higher, ["bar_idx", "close"])


def align_complete(spark, sf_dir: str) -> DataFrame:
    """For each 4-hour bar the last hourly bar before its end of which no part is missing."""
    m15 = m15_of(spark, sf_dir)
    return aligned(frame_bars(m15, "h4"), frame_bars(m15, "h1"), ["bar_idx", "close"])


def daily_liquidity(spark, sf_dir: str, days: int = 90) -> DataFrame:
    """Traded value per flag and day, and its median over the ``days`` days before, missing until there are so many."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("day"))
    d = d.agg(F.round(F.sum("l_extendedprice"), 2).alias("usd"))
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(-days, -1)
    med = F.when(F.count("usd").over(w) == days, F.expr("percentile(usd, 0.5)").over(w))
    return d.select("symbol", "day", "usd", F.round(med, 2).alias("median_before"))


QUERIES = {"bars_m15": bars_m15, "bars_h1": _query("h1"), "bars_h4": _query("h4"), "bars_h8": _query("h8"), "bars_d1": _query("d1"), "bars_align_h4": align_h4, "bars_align_complete": align_complete, "bars_daily_liquidity": daily_liquidity}

TDATE = "CASE dayofweek({0}) WHEN 0 THEN {0}::DATE + 1 WHEN 6 THEN {0}::DATE - 1 ELSE {0}::DATE END"
M15 = f"""t AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price FROM events),
m0 AS (SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, count(*)::DOUBLE AS volume FROM (SELECT symbol, t.ts, seq, price FROM t) GROUP BY symbol, time_bucket(INTERVAL '15 minutes', ts)),
m15 AS (SELECT symbol, ts, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS exec_idx, dense_rank() OVER (PARTITION BY symbol ORDER BY {TDATE.format('ts')}) - 1 AS day_id FROM m0)"""


def frame_sql(frame: str, name: str) -> str:
    start = {"h1": "date_trunc('hour', ts)", "d1": f"({TDATE.format('ts')})::TIMESTAMP"}.get(frame, f"time_bucket(INTERVAL '{FRAMES[frame] // 4} hours', ts)")
    length = "1 day" if frame == "d1" else f"{FRAMES[frame] // 4} hours"
    full = ">=" if frame == "d1" else "="
    return f"""{name}0 AS (SELECT symbol, {start} AS bucket, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, count(*) AS n_m15, min(exec_idx) AS exec_start, max(exec_idx) + 1 AS exec_end, first(day_id ORDER BY ts) AS day_id FROM m15 GROUP BY 1, 2),
{name} AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS bar_idx, bucket, bucket + INTERVAL '{length}' AS available, open, high, low, close, volume, n_m15, n_m15 {full} {FRAMES[frame]} AS complete, exec_start, exec_end, day_id FROM {name}0)"""


ORACLE = {
    "bars_m15": f"WITH {M15} SELECT * FROM m15",
    **{f"bars_{f}": f"WITH {M15}, {frame_sql(f, 'b')} SELECT * FROM b" for f in ("h1", "h4", "h8", "d1")},
    "bars_align_h4": f"WITH {M15}, {frame_sql('h1', 'b')}, {frame_sql('h4', 'h')} SELECT b.symbol, b.bar_idx, h.bar_idx AS h_bar_idx, h.close AS h_close FROM b ASOF LEFT JOIN (SELECT * FROM h WHERE n_m15 >= 4) h ON b.symbol = h.symbol AND b.available >= h.available",
    "bars_align_complete": f"WITH {M15}, {frame_sql('h4', 'b')}, {frame_sql('h1', 'h')} SELECT b.symbol, b.bar_idx, h.bar_idx AS h_bar_idx, h.close AS h_close FROM b ASOF LEFT JOIN (SELECT * FROM h WHERE complete) h ON b.symbol = h.symbol AND b.available >= h.available",
    "bars_daily_liquidity": """WITH d AS (SELECT l_returnflag AS symbol, l_shipdate::DATE AS day, round(sum(l_extendedprice), 2) AS usd FROM lineitem GROUP BY 1, 2)
SELECT symbol, day, usd, round(CASE WHEN count(usd) OVER w = 90 THEN median(usd) OVER w END, 2) AS median_before FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)""",
}

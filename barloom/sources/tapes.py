"""Price tapes from the given tables, and validated raw bar files.

A tape has symbol, ts, seq (order of equal times), price and volume. Raw files hold bars as text and are checked before use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Raw columns of a bar file, and the volume from which a value is an overflow.
RAW_COLUMNS = ("Date", "Time", "Open", "High", "Low", "Close", "Volume")
SPOT_COLUMNS = ("datetime", "open", "high", "low", "close", "volume")
OVERFLOW = 9.0e13


class TapeError(ValueError):
    """A tape that breaks its contract; nothing is repaired silently."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: one symbol per event type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def daily_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trades of several years: one symbol per priority."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"))


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funding rates: the number in an event's properties, at the hour; of several in an hour the first one counts."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("bucket"), "ts", "event_id", (F.get_json_object("props", "$.k").cast("double") - 50) / 1e5)
    e = e.toDF("symbol", "bucket", "ts", "event_id", "rate")
    return e.filter("hour(bucket) % 8 = 0").groupBy("symbol", "bucket").agg(F.min_by("rate", F.struct("ts", "event_id")).alias("rate"))


def _parsed(spark: SparkSession, path: str, columns: tuple[str, ...], ts, numbers: tuple[str, ...]) -> DataFrame:
    """A CSV of text cells with ``ts`` and numbers parsed; TapeError for another header or any cell that can't be parsed."""
    found = tuple(spark.read.option("header", True).csv(path).columns)
    if found != columns:
        raise TapeError(f"columns {found}, expected {columns}")
    raw = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).csv(path)
    cells = {c.lower(): F.expr(f"try_cast(`{c}` as double)") for c in numbers}
    out = raw.select(ts.alias("ts"), *[v.alias(k) for k, v in cells.items()])
    bad = out.agg(*[F.count_if(F.col(c).isNull() | (F.isnan(c) if c != "ts" else F.lit(False))).alias(c) for c in out.columns]).first()
    for c in out.columns:
        if bad[c]:
            raise TapeError(f"unparseable {c}: {bad[c]}")
    return out


def raw_bars(spark: SparkSession, path: str, tz: str, symbol: str) -> DataFrame:
    """A raw CSV of local bars (symbol, ts_local, ts_utc, prices, volume): header checked, every cell parsed or refused, local
    hours that don't exist or occur twice in ``tz`` refused, whatever the session's zone; volumes that overflowed are null."""
    local = F.try_to_timestamp(F.concat_ws(" ", "Date", "Time"), F.lit("yyyyMMdd HH:mm:ss")).cast("timestamp_ntz")
    out = _parsed(spark, path, RAW_COLUMNS, local, RAW_COLUMNS[2:])
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col("ts"))
    back = lambda t: F.convert_timezone(F.lit("UTC"), F.lit(tz), t)
    hour = F.expr("interval 1 hour")
    out = out.withColumn("ts_utc", utc)
    row = out.agg(
        F.count_if(back(F.col("ts_utc")) != F.col("ts")).alias("missing hours"),
        F.count_if((back(F.col("ts_utc") + hour) == F.col("ts")) | (back(F.col("ts_utc") - hour) == F.col("ts"))).alias("repeated hours"),
    ).first()
    for k in row.asDict():
        if row[k]:
            raise TapeError(f"{k} of {tz}: {row[k]}")
    volume = F.when(F.col("volume") < OVERFLOW, F.col("volume"))
    return out.select(F.lit(symbol).alias("symbol"), F.col("ts").alias("ts_local"), "ts_utc", "open", "high", "low", "close", volume.alias("volume"))


def spot_bars(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A CSV of bars by UTC (symbol, ts_local, ts_utc, prices, volume), checked as ``raw_bars`` is."""
    ts = F.try_to_timestamp("datetime", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    out = _parsed(spark, path, SPOT_COLUMNS, ts, SPOT_COLUMNS[1:])
    return out.select(F.lit(symbol).alias("symbol"), F.col("ts").alias("ts_local"), F.col("ts").alias("ts_utc"), "open", "high", "low", "close", "volume")


def canonical(bars: DataFrame, holdout_start: str, holidays: list = (), utc: bool = False) -> DataFrame:
    """Bars before ``holdout_start`` (local) with no_trade inside holidays and day_id over trading dates; utc: calendar days."""
    d = bars.filter(F.col("ts_local") < F.lit(holdout_start).cast("timestamp_ntz"))
    day = F.to_date("ts_local") if utc else trading_date(F.col("ts_local"))
    rank = F.dense_rank().over(Window.partitionBy("symbol").orderBy("day")) - 1
    return d.withColumn("no_trade", holiday(F.col("ts_local"), list(holidays))).withColumn("day", day).withColumn("day_id", rank.cast("long")).drop("day")


def validate(bars: DataFrame, minutes: int = 15) -> DataFrame:
    """``bars`` (symbol, seq, ts, open, high, low, close), or TapeError: steps back, repeats, times off the grid, prices that are missing, not positive or contradictory."""
    w = Window.partitionBy("symbol").orderBy("seq")
    step = F.unix_micros(F.col("ts").cast("timestamp"))
    d = bars.withColumn("t", step).withColumn("before", F.lag("t").over(w))
    price = [F.col(c) for c in ("open", "high", "low", "close")]
    lost = ~F.coalesce(sum(((p > 0) & ~F.isnan(p) & (p < float("inf"))).cast("int") for p in price) == 4, F.lit(False))
    faults = {
        "steps back": F.col("t") < F.col("before"),
        "repeated times": F.col("t") == F.col("before"),
        "off the grid": F.col("t") % (minutes * 60_000_000) != 0,
        "bad prices": lost,
        "contradictory prices": (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")) | (F.col("high") < F.col("low")),
    }
    row = d.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in faults.items()]).first()
    if not row["rows"]:
        raise TapeError("empty tape")
    for k in faults:
        if row[k]:
            raise TapeError(f"{k}: {row[k]}")
    return bars


def trading_date(ts):
    """The day a bar trades on: Sunday belongs to Monday, Saturday to Friday."""
    day = F.to_date(ts)
    return F.when(F.dayofweek(day) == 1, F.date_add(day, 1)).when(F.dayofweek(day) == 7, F.date_sub(day, 1)).otherwise(day)


def holiday(ts, windows: list[tuple[tuple[int, int, int, int], tuple[int, int, int, int]]]):
    """Whether ts lies in a yearly window [(month, day, hour, minute), same); a window may wrap the year's end."""
    code = lambda m, d, h, n: ((m * 31 + d) * 24 + h) * 60 + n
    at = code(F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts))
    out = F.lit(False)
    for a, b in windows:
        lo, hi = code(*a), code(*b)
        out = out | (((at >= lo) & (at < hi)) if lo <= hi else ((at >= lo) | (at < hi)))
    return out

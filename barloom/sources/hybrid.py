"""Tapes made of two sources, and repairs by a patch table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("symbol", "ts_utc", "open", "high", "low", "close", "volume")


def repaired(bars: DataFrame, patches: DataFrame) -> DataFrame:
    """``bars`` with repaired: the low of a bar named in ``patches`` (symbol, ts_utc) becomes the lower end of its body. A bar that
    occurs more than once isn't touched, as the patch doesn't say which is meant."""
    once = bars.join(patches.select("symbol", "ts_utc").distinct(), ["symbol", "ts_utc"], "left_semi").groupBy("symbol", "ts_utc").agg(F.count("*").alias("times")).filter("times = 1")
    d = bars.join(once.select("symbol", "ts_utc", F.lit(True).alias("repaired")), ["symbol", "ts_utc"], "left")
    d = d.withColumn("repaired", F.coalesce("repaired", F.lit(False)))
    return d.withColumn("low", F.when(F.col("repaired"), F.least("open", "close")).otherwise(F.col("low")))


def hybrid(spot: DataFrame, perpetual: DataFrame, switches: dict[str, datetime], minutes: int = 15) -> DataFrame:
    """symbol, ts_utc, prices, volume, source: spot bars before a symbol's switch, perpetual ones from it to the end of its spot
    tape. Symbols without a switch are left out. Both sources are filtered by literals, so the conditions reach their
    scans; the tapes' ends are one small aggregate, one row a symbol that was named."""
    named = spot.filter(F.col("symbol").isin(*switches))
    ends = {r.symbol: r.last for r in named.groupBy("symbol").agg(F.max("ts_utc").alias("last")).collect()}
    one = lambda s: F.col("symbol") == s
    before, after = F.lit(False), F.lit(False)
    for s, at in switches.items():
        before = before | (one(s) & (F.col("ts_utc") < F.lit(at)))
        if s in ends:
            after = after | (one(s) & (F.col("ts_utc") >= F.lit(at)) & (F.col("ts_utc") <= F.lit(ends[s])))
    head = spot.filter(before).select(*COLUMNS, F.lit("spot").alias("source"))
    return head.unionByName(perpetual.filter(after).select(*COLUMNS, F.lit("perpetual").alias("source")))

"""Bars from a stream of trades: tumbling windows with a watermark; trades that come later are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(trades: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """symbol, ts, open, high, low, close, volume of closed windows; state per open window only. trades: symbol, ts (timestamp), seq, price, volume."""
    order = F.struct("ts", "seq")
    d = trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w"))
    d = d.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.when(F.count("volume") == F.count("*"), F.sum("volume")).alias("volume"))
    return d.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")

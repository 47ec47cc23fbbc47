"""Indicators as window columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.functions.frames import FRAME, Frame


def sma(n: int, price: str = "close", frame: Frame = FRAME) -> Column:
    """Mean of the last ``n`` prices, null where there are fewer."""
    return F.when(frame.has(n), frame.total(price, n) / n)


def with_smas(bars: DataFrame, lengths: Iterable[int] = (5, 10, 20, 30), frame: Frame = FRAME) -> DataFrame:
    return bars.withColumns({f"sma{n}": sma(n, frame=frame) for n in lengths})


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, price: str = "close", frame: Frame = FRAME) -> DataFrame:
    """``bars`` with mid, up and low: the mean, and ``k`` population deviations around it."""
    own = frame.rows(-(n - 1), 0)
    mid, width = F.avg(price).over(own), F.stddev_pop(price).over(own) * k
    return bars.withColumns({"mid": F.when(frame.has(n), mid), "up": F.when(frame.has(n), mid + width), "low_band": F.when(frame.has(n), mid - width)})


def cum_return_pct(value: str, frame: Frame = FRAME) -> Column:
    """Per cent over the first value; over 1 if that is 0."""
    first = F.first(value).over(frame.so_far)
    base = F.when(first == 0, F.lit(1.0)).otherwise(first.cast("double"))
    return (F.col(value) / base - 1) * 100


def benchmark_pct(frame: Frame = FRAME) -> Column:
    """Buy and hold: the cumulative return of the close."""
    return cum_return_pct("close", frame)


def annotate_trades(trades: DataFrame, bars: DataFrame, value: str = "close") -> DataFrame:
    """Trades with the bar's ``value`` at their index; those off the bars are dropped."""
    return trades.join(bars.select("symbol", "i", F.col(value).alias("at_value")), ["symbol", "i"])


def annotate_signals(signals: DataFrame) -> DataFrame:
    """Bars with signal 1, marked at their low."""
    return signals.where("signal = 1").select("symbol", "ts", F.col("low").alias("at_value"))


def excess_return(bars: DataFrame, index_bars: DataFrame, frame: Frame = FRAME) -> DataFrame:
    """Each bar's cumulative return minus the index's at the same time, on their common times.

    The index is one series, a row per bar time; Spark broadcasts it only if it is small.
    """
    index = index_bars.select("ts", cum_return_pct("close", frame).alias("index_return"))
    own = bars.select("symbol", "ts", cum_return_pct("close", frame).alias("own_return"))
    return own.join(index, "ts").select("symbol", "ts", "own_return", "index_return", (F.col("own_return") - F.col("index_return")).alias("excess"))

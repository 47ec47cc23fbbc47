"""Making bars: from prints, from finer bars, and nested for output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.operators.slices import numbered

#: Intervals of ``resample``: a unit of date_trunc, or a length for windows within a day.
UNITS = {"week": "week", "month": "month", "quarter": "quarter", "year": "year", "day": "day", "hour": "hour", "minute": "minute"}


def _start(ts: Column | str, freq: str) -> Column:
    return F.date_trunc(UNITS[freq], ts) if freq in UNITS else F.window(ts, freq).getField("start")


def bars_from_ticks(ticks: DataFrame, freq: str, tie: tuple[str, ...] = (), symbol: str = "symbol", ts: str = "ts", price: str = "price", volume: str = "volume", order: Column | None = None) -> DataFrame:
    """Bars of ``freq`` from prints. Prints of equal time are ordered by ``tie``, then price.

    ``freq``: a calendar unit, or a length such as ``"5 minutes"``. Aggregates partially before its shuffle.
    ``order``: the same order as one column of fixed width, such as a decimal, where it can be had; Spark then aggregates by
    hashing, and by sorting otherwise.
    """
    order = F.struct(ts, *tie, price) if order is None else order
    return ticks.groupBy(F.col(symbol).alias("symbol"), _start(ts, freq).alias("_start")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).cast("long").alias("volume"),
    ).withColumnRenamed("_start", "ts")


def resample(bars: DataFrame, freq: str) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, sums of volume and amount."""
    sums = [F.sum(c).alias(c) for c in ("volume", "amount") if c in bars.columns]
    return (
        bars.groupBy("symbol", _start("ts", freq).alias("_start"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), *sums)
        .withColumnRenamed("_start", "ts")
    )


def nest_bars(screened: DataFrame, bars: DataFrame) -> DataFrame:
    """``screened`` with each symbol's bars as an array in time order; other symbols' bars are not gathered.

    A symbol's history is one array value, as in the output it stands for: day bars fit; of ticks see ``nest_chunks``.
    """
    own = bars.join(screened.select("symbol").distinct(), "symbol", "left_semi")
    nested = own.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*_NESTED))).alias("bars"))
    return screened.join(nested, "symbol", "left")


_NESTED = ("ts", "open", "high", "low", "close", "volume")


def nest_chunks(screened: DataFrame, bars: DataFrame, size: int = 10_000, parts: int | None = None) -> DataFrame:
    """``screened`` with each symbol's bars in arrays of ``size`` at most: a row for each (symbol, chunk), chunks numbered in time order.

    Bars are numbered by counts of ranges, so neither a task nor a row holds a symbol's history. A symbol without bars has one row, of chunk 0 without bars.
    """
    own = bars.join(screened.select("symbol").distinct(), "symbol", "left_semi").select("symbol", *_NESTED)
    numbered_bars = numbered(own, parts=parts).withColumn("chunk", F.floor(F.col("_number") / size).cast("long"))
    nested = numbered_bars.groupBy("symbol", "chunk").agg(F.array_sort(F.collect_list(F.struct(*_NESTED))).alias("bars"))
    return screened.join(nested, "symbol", "left").withColumn("chunk", F.coalesce("chunk", F.lit(0).cast("long")))


def unnest(nested: DataFrame) -> DataFrame:
    """The bars of nested rows, in order within each row; chunks of a symbol follow each other by their numbers."""
    order = ["symbol", *(["chunk"] if "chunk" in nested.columns else [])]
    return nested.select(*order, F.posexplode("bars").alias("_place", "_bar")).select(*order, F.col("_place").alias("place"), "_bar.*")

"""Screening the market on its latest bars, and ordering results."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.columns import time_range
from barlab.functions.frames import FRAME, Frame, unused
from barlab.operators.rules import Feeds, Rule, with_signal


def snapshot(bars: DataFrame) -> DataFrame:
    """Each symbol's last bar with its values: close, turnover, shares, and both times the close.

    Bars of one symbol should differ in time; of several at its last time, the one with the greatest values counts.
    """
    have = [c for c in ("turnover", "float_stock", "total_stock") if c in bars.columns]
    last = bars.groupBy("symbol").agg(F.max(F.struct("ts", "close", *have)).alias("last"))
    out = last.select("symbol", "last.ts", F.col("last.close").alias("price"), *[F.col(f"last.{c}").alias(c) for c in have])
    values = {v: F.col(c) * F.col("price") for v, c in (("float_value", "float_stock"), ("total_value", "total_stock")) if c in have}
    return out.withColumns(values) if values else out


def with_names(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """``rows`` with the names of their symbols, null for unknown ones, the least of several. Spark broadcasts the names if they are small."""
    return rows.join(symbols.groupBy("symbol").agg(F.min("name").alias("name")), "symbol", "left")


def screen(bars: DataFrame, rules: str | Rule | Iterable[str | Rule], start: datetime | str | None = None, end: datetime | str | None = None, frame: Frame = FRAME, feeds: Feeds = Feeds()) -> DataFrame:
    """Symbols whose last bar in range satisfies all rules, with its price, and score and signal 0.

    The last row is taken by an aggregate that reuses the windows' exchange. Bars of one symbol should differ in
    time; of several at its last time, one where the rules hold counts before others.
    """
    (flag,) = unused(bars, "_flag")
    rows = with_signal(bars.where(time_range(start, end)), rules, flag, frame, feeds)
    have = [c for c in ("turnover", "float_stock", "total_stock") if c in bars.columns]
    last = rows.groupBy("symbol").agg(F.max(F.struct("ts", F.col(flag).alias("_flag"), "close", *have)).alias("last")).where("last._flag")
    return last.select("symbol", "last.ts", F.col("last.close").alias("price"), *[f"last.{c}" for c in have], F.lit(0).alias("score"), F.lit(0).alias("signal"))


def sort_results(rows: DataFrame, field: str | None = None, descending: bool = False) -> DataFrame:
    """Rows by ``field``, ties by symbol; unsorted without a field."""
    if field is None:
        return rows
    return rows.orderBy(F.desc(field) if descending else F.asc(field), "symbol")


def page(rows: DataFrame, number: int, size: int = 60) -> DataFrame:
    """Page ``number`` from 0 of ordered rows."""
    return rows.offset(number * size).limit(size)


def page_after(rows: DataFrame, field: str, after: tuple[object, str] | None = None, size: int = 60, descending: bool = False) -> DataFrame:
    """The ``size`` rows that follow ``after``, the (value, symbol) of the last row seen, in the order of ``sort_results``; the first ones without it.

    A filter and the best ``size`` of what is left: pages far on cost no more than the first. Nulls are least.
    """
    value, symbol = F.col(field), F.col("symbol")
    if after is not None:
        at, name = after
        if at is None:
            later = (symbol > name) & value.isNull() | (F.lit(False) if descending else value.isNotNull())
        else:
            beyond = value.isNull() | (value < F.lit(at)) if descending else value > F.lit(at)
            later = beyond | (value == F.lit(at)) & (symbol > name)
        rows = rows.where(later)
    return sort_results(rows, field, descending).limit(size)


def tail(bars: DataFrame, k: int = 120, frame: Frame = FRAME) -> DataFrame:
    """The last ``k`` bars of each symbol; of bars at the same time, those with greater closes count as later."""
    latest = Window.partitionBy(frame.symbol).orderBy(F.desc(frame.ts), F.desc("close"))
    (n,) = unused(bars, "_n")
    return bars.withColumn(n, F.row_number().over(latest)).where(F.col(n) <= k).drop(n)

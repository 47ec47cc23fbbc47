"""Return, drawdown and Sharpe ratio of ledgers, by symbol and for the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.frames import FRAME, Frame

YEAR = 252


def total_return(cash: float) -> Column:
    """Of the last equity over the initial cash; 0 without cash."""
    return (F.max_by("equity", "i") - cash) / cash if cash > 0 else F.lit(0.0)


def with_returns(ledger: DataFrame, frame: Frame = FRAME) -> DataFrame:
    """``ledger`` with each bar's simple return (null at the first) and its fall from the highest equity so far."""
    before = F.lag("equity").over(frame.ordered)
    peak = F.greatest(F.max("equity").over(frame.so_far), F.lit(0.0))
    fall = F.when(peak > 0, (peak - F.col("equity")) / F.when(peak > 0, peak)).otherwise(0.0)
    return ledger.withColumns({"bar_return": (F.col("equity") - before) / F.when(before != 0, before), "fall": fall})


def sharpe(column: str = "bar_return") -> Column:
    """Mean over population deviation of the returns, by year; 0 without returns or deviation."""
    spread = F.stddev_pop(column)
    return F.coalesce(F.when(spread != 0, F.avg(column) / F.when(spread != 0, spread) * (YEAR**0.5)), F.lit(0.0))


def max_drawdown() -> Column:
    return F.greatest(F.max("fall"), F.lit(0.0))


def annualized_return(total: Column, bars: Column) -> Column:
    """The yearly rate of a total return over a number of bars; null where all is lost."""
    return F.when(total > -1, F.pow(1 + total, F.lit(float(YEAR)) / bars) - 1)


def by_symbol(ledger: DataFrame, cash: float, frame: Frame = FRAME) -> DataFrame:
    """symbol, total_return, max_drawdown, sharpe and number of bars of each symbol."""
    return with_returns(ledger, frame).groupBy("symbol").agg(total_return(cash).alias("total_return"), max_drawdown().alias("max_drawdown"), sharpe().alias("sharpe"), F.count("*").alias("bars"))


def by_slices(ledger: DataFrame, cash: float, rows: int = 1 << 16) -> DataFrame:
    """As ``by_symbol``, from summaries of slices of ``rows`` bars that are merged in order, for symbols that are too long for a task.

    A slice's summary: its first and last equity, its peak and trough, the greatest fall inside it, and number, mean and squared deviations of its returns.
    """
    cut = ledger.withColumn("_slice", F.floor(F.col("i") / rows))
    order = Window.partitionBy("symbol", "_slice").orderBy("i")
    before = F.lag("equity").over(order)
    peak = F.greatest(F.max("equity").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    own = cut.withColumns({"_return": (F.col("equity") - before) / F.when(before != 0, before), "_fall": F.when(peak > 0, (peak - F.col("equity")) / F.when(peak > 0, peak)).otherwise(0.0)})
    n = F.count("_return")
    parts = own.groupBy("symbol", "_slice").agg(
        F.min_by("equity", "i").alias("first"),
        F.max_by("equity", "i").alias("last"),
        F.max("equity").alias("peak"),
        F.min("equity").alias("trough"),
        F.max("_fall").alias("fall"),
        n.alias("n"),
        F.coalesce(F.avg("_return"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop("_return") * n, F.lit(0.0)).alias("m2"),
        F.count("*").alias("bars"),
    )
    listed = parts.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*[c for c in parts.columns if c != "symbol"]))).alias("_parts"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(0).cast("long").alias("bars"))

    def both(n: Column, mean: Column, m2: Column, k: Column, other: Column, more: Column) -> tuple[Column, Column, Column]:
        """Number, mean and squared deviations of two sets of returns together."""
        total, apart = n + k, other - mean
        weight = F.when(total > 0, k / F.when(total > 0, total)).otherwise(0.0)
        return total, mean + apart * weight, m2 + more + apart * apart * n * weight

    def merge(a: Column, b: Column) -> Column:
        # The return from one slice to the next, then those inside the next.
        step = (b["first"] - a["last"]) / F.when(a["last"] != 0, a["last"])
        known = step.isNotNull()
        n, mean, m2 = both(a["n"], a["mean"], a["m2"], known.cast("long"), F.coalesce(step, F.lit(0.0)), F.lit(0.0))
        n, mean, m2 = both(n, mean, m2, b["n"], b["mean"], b["m2"])
        fall = F.when(a["peak"] > 0, (a["peak"] - b["trough"]) / F.when(a["peak"] > 0, a["peak"])).otherwise(0.0)
        # Falls from a peak inside the slice are its own; those from an earlier, lower peak are smaller.
        return F.struct(b["last"].alias("last"), F.greatest(a["peak"], b["peak"]).alias("peak"), F.greatest(a["fall"], b["fall"], fall).alias("fall"), n.alias("n"), mean.alias("mean"), m2.alias("m2"), (a["bars"] + b["bars"]).alias("bars"))

    whole = listed.select("symbol", F.aggregate("_parts", start, merge).alias("w"))
    spread = F.sqrt(F.col("w.m2") / F.when(F.col("w.n") > 0, F.col("w.n")))
    return whole.select(
        "symbol",
        ((F.col("w.last") - cash) / cash if cash > 0 else F.lit(0.0)).alias("total_return"),
        F.greatest(F.col("w.fall"), F.lit(0.0)).alias("max_drawdown"),
        F.coalesce(F.when(spread > 0, F.col("w.mean") / F.when(spread > 0, spread) * (YEAR**0.5)), F.lit(0.0)).alias("sharpe"),
        F.col("w.bars").alias("bars"),
    )


def market_summary(items: DataFrame) -> DataFrame:
    """One row: plain means of the symbols' figures and their number; zeros without symbols."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}")
    return items.agg(mean("total_return"), mean("sharpe"), mean("max_drawdown"), F.count("*").alias("symbols"))


def market_top(items: DataFrame, k: int = 200) -> DataFrame:
    """The ``k`` best symbols by return."""
    return items.orderBy(F.desc("total_return"), "symbol").limit(k)

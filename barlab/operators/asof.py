"""As-of joins of bars with values that hold from a time on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.frames import FRAME, Frame, unused
from barlab.operators.slices import carried


def asof(bars: DataFrame, events: DataFrame, values: list[str], frame: Frame = FRAME, cut: bool = False, parts: int | None = None) -> DataFrame:
    """``bars`` with the ``values`` of the last event at or before each bar, null before the first.

    Events and bars go through one window in time order, events first at equal times; no range join. ``cut``: in two
    levels, ranges of time and their last events, for symbols that are too long for a task.
    """
    event, bar, held = unused(bars, "_event", "_bar", "_held")
    value = F.struct(*values)
    left = bars.withColumns({event: F.lit(None).cast(events.select(value.alias("x")).schema["x"].dataType), bar: F.lit(1)})
    right = events.select("symbol", "ts", value.alias(event)).withColumn(bar, F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    if cut:
        last = lambda w: F.last(event, ignorenulls=True).over(w)
        at_end = F.max_by(event, F.when(F.col(event).isNotNull(), F.struct(frame.ts, "_row")))
        rows = carried(both, [frame.symbol, frame.ts, bar], last, at_end, lambda w: F.last("_end", ignorenulls=True).over(w), lambda before, within: F.coalesce(within, before), held, frame, parts)
        return rows.where(F.col(bar) == 1).select(*bars.columns, *[F.col(held)[v].alias(v) for v in values])
    order = Window.partitionBy(frame.symbol).orderBy(frame.ts, bar).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn(held, F.last(event, ignorenulls=True).over(order)).where(F.col(bar) == 1)
    return rows.select(*bars.columns, *[F.col(held)[v].alias(v) for v in values])


def equity_asof(bars: DataFrame, equity_events: DataFrame, cut: bool = False) -> DataFrame:
    """``bars`` with the share capital in force."""
    return asof(bars.drop("float_stock", "total_stock"), equity_events, ["float_stock", "total_stock"], cut=cut)


def turnover_rate(bars: DataFrame, equity_events: DataFrame, lot: int = 100, cut: bool = False) -> DataFrame:
    """``bars`` with turnover: volume in lots over floating shares in force, null where there are none."""
    rows = equity_asof(bars, equity_events, cut)
    return rows.withColumn("turnover", F.when(F.col("float_stock") > 0, F.col("volume") * lot / F.when(F.col("float_stock") > 0, F.col("float_stock"))))


def cumulative_factors(factors: DataFrame, cut: bool = False) -> DataFrame:
    """Per-event factors as their running products by symbol. ``cut``: in two levels, as in ``asof``."""
    if cut:
        product = lambda c: lambda w: F.product(c).over(w)
        (out,) = unused(factors, "_product")
        made = carried(factors, ["symbol", "ts"], product("factor"), F.product("factor"), product("_end"), lambda before, within: F.coalesce(before, F.lit(1.0)) * within, out)
        return made.withColumn("factor", F.col(out)).drop(out)
    order = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return factors.withColumn("factor", F.product("factor").over(order))


def adjust_prices(bars: DataFrame, factors: DataFrame, forward: bool = False, cut: bool = False) -> DataFrame:
    """``bars`` with prices times the cumulative factor in force (1 before the first).

    ``forward``: relative to each symbol's last bar, so that its prices stay.
    """
    (factor,) = unused(bars, "_factor")
    events = cumulative_factors(factors, cut).withColumnRenamed("factor", factor)
    rows = asof(bars, events, [factor], cut=cut).withColumn(factor, F.coalesce(factor, F.lit(1.0)))
    if forward and cut:
        (last,) = unused(rows, "_last")
        ends = rows.groupBy("symbol").agg(F.max_by(factor, "ts").alias(last))
        rows = rows.join(ends, "symbol").withColumn(factor, F.col(factor) / F.col(last)).drop(last)
    elif forward:
        rows = rows.withColumn(factor, F.col(factor) / F.last(factor).over(FRAME.whole))
    return rows.withColumns({c: F.col(c) * F.col(factor) for c in ("open", "high", "low", "close")}).drop(factor)

"""Turning points: the rising-double-pivot rule, and chart vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.frames import FRAME, Frame, unused
from barlab.operators.rules import Rule, staged_rule


def _latest_two(bars: DataFrame, frame: Frame, price: str, high: bool, window: int, i: str, out: str) -> DataFrame:
    """``bars`` with ``out``: the latest pivot and the one before, as known at each bar; ``i`` numbers the bars.

    A pivot's price is not passed by the ``window`` bars before it, nor by those after it as far as they
    exist; at least half of the window must. One whose right side is still short is provisional: it ends
    exactly at the current bar.
    """
    half, extreme = window // 2, F.max if high else F.min
    pair, *held = unused(bars, "_pair", *[f"_{price}_{r}" for r in range(half, window + 1)])
    names = dict(zip(range(half, window + 1), held, strict=True))
    point = F.struct(F.col(i).alias("i"), F.col(price).alias("v"))
    for r, name in names.items():
        best = extreme(price).over(frame.rows(-window, r))
        stays = F.col(price) >= best if high else F.col(price) <= best
        bars = bars.withColumn(name, F.when((F.col(i) >= window) & stays, point))
    if frame.slice is not None:
        return _in_slices(bars, frame, window, i, names, pair, out)
    full = F.col(names[window])
    before = F.last(full, ignorenulls=True).over(frame.rows(Window.unboundedPreceding, -1))
    # A struct around both keeps a pivot that has none before it.
    bars = bars.withColumn(pair, F.when(full.isNotNull(), F.struct(full.alias("a"), before.alias("b"))))
    confirmed = F.last(pair, ignorenulls=True).over(frame.rows(Window.unboundedPreceding, -window))
    provisional = [frame.lag(names[r], r) for r in range(half, window)]
    known = F.array(*provisional, confirmed["a"], confirmed["b"])
    return bars.withColumn(out, F.filter(known, lambda p: p.isNotNull())).drop(pair, *held)


def _in_slices(bars: DataFrame, frame: Frame, window: int, i: str, names: dict[int, str], pair: str, out: str) -> DataFrame:
    """``_latest_two`` where symbols are cut into slices that begin with copies of two windows.

    A slice answers for the full pivots from a window before its first own bar to a window before its last; it passes
    its last two on to the slices after it, in two levels.
    """
    keys = [frame.symbol, frame.slice]
    own = frame.ordered.rowsBetween(Window.unboundedPreceding, -1)
    begins = F.min(F.when(F.col(frame.own), F.col(i))).over(Window.partitionBy(*keys))
    ends = F.max(F.when(F.col(frame.own), F.col(i))).over(Window.partitionBy(*keys))
    begin, end, full, a, b = unused(bars, "_begin", "_end", "_full", "_a", "_b")
    rows = bars.withColumns({begin: begins, end: ends})
    rows = rows.withColumn(full, F.when(F.col(i) >= F.col(begin) - window, F.col(names[window])))
    rows = rows.withColumn(pair, F.when(F.col(full).isNotNull(), F.struct(F.col(full).alias("a"), F.last(full, ignorenulls=True).over(own).alias("b"))))
    found = rows.where(F.col(pair).isNotNull() & (F.col(i) <= F.col(end) - window)).groupBy(*keys).agg(F.max_by(pair, i).alias("p"))
    order = Window.partitionBy(frame.symbol).orderBy(frame.slice)
    found = found.select(*keys, F.col("p.a").alias(a), F.coalesce("p.b", F.lag("p.a").over(order)).alias(b))
    every = bars.where(frame.own).select(*keys).distinct().join(found, keys, "left")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(a).isNotNull(), F.struct(a, b)), ignorenulls=True).over(earlier)
    carried = every.select(*keys, last[a].alias(a), last[b].alias(b))
    rows = rows.join(carried, keys)
    confirmed = F.last(pair, ignorenulls=True).over(frame.ordered.rowsBetween(Window.unboundedPreceding, -window))
    rows = rows.withColumn(pair, confirmed)
    newest = F.coalesce(F.col(pair)["a"], F.col(a))
    older = F.when(F.col(pair).isNull(), F.col(b)).otherwise(F.coalesce(F.col(pair)["b"], F.col(a)))
    provisional = [frame.lag(names[r], r) for r in sorted(names) if r < window]
    known = F.array(*provisional, newest, older)
    return rows.withColumn(out, F.filter(known, lambda p: p.isNotNull())).drop(pair, begin, end, full, a, b, *names.values())


def trend_up(window: int = 8, min_bars: int = 30, max_gain: float = 5.0) -> Rule:
    """Two high and two low pivots in turn, both rising, at least a window apart, at comparable rates."""
    if min_bars <= window + window // 2:
        raise ValueError("min_bars must be over one and a half windows")

    def apply(bars: DataFrame, frame: Frame, out: str) -> DataFrame:
        i, highs, lows = unused(bars, "_i", "_highs", "_lows")
        rows = bars.withColumn(i, frame.index())
        rows = _latest_two(_latest_two(rows, frame, "high", True, window, i, highs), frame, "low", False, window, i, lows)
        h2, h1, l2, l1 = (F.get(c, F.lit(k)) for c in (highs, lows) for k in (0, 1))
        gain = lambda b, a: (b["v"] - a["v"]).cast("double") / F.nullif(a["v"].cast("double"), F.lit(0.0))
        high_gain, low_gain = gain(h2, h1), gain(l2, l1)
        apart = (l1["i"] - h1["i"] >= window) & (h2["i"] - l1["i"] >= window) & (l2["i"] - h2["i"] >= window)
        shape = (l2["v"] > l1["v"]) & (h2["v"] > h1["v"]) & (l1["v"] < h1["v"]) & (l2["v"] < h2["v"])
        rates = (high_gain <= low_gain * max_gain) & (low_gain <= high_gain * max_gain)
        flag = (F.col(i) + 1 >= min_bars) & apart & shape & rates
        return rows.withColumn(out, F.coalesce(flag, F.lit(False))).drop(i, highs, lows)

    return apply


staged_rule("trend_up")(trend_up())


def vertices(bars: DataFrame, window: int = 8, frame: Frame = FRAME) -> DataFrame:
    """Peaks and valleys: strictly beyond all others within ``window`` bars on both sides, which must exist."""
    i, n = frame.index(), frame.size()
    before, after = frame.rows(-window, -1), frame.rows(1, window)
    rows = bars.withColumns(
        {
            "_peak": (F.max("high").over(before) < F.col("high")) & (F.max("high").over(after) < F.col("high")),
            "_valley": (F.min("low").over(before) > F.col("low")) & (F.min("low").over(after) > F.col("low")),
            "i": i,
            "_n": n,
        }
    ).where((F.col("i") >= window) & (F.col("i") < F.col("_n") - window) & (F.lit(True) if frame.own is None else F.col(frame.own)))
    kinds = F.array(F.when(F.col("_peak"), F.struct(F.lit("peak").alias("kind"), F.col("high").alias("price"))), F.when(F.col("_valley"), F.struct(F.lit("valley").alias("kind"), F.col("low").alias("price"))))
    return rows.withColumn("_v", F.explode(F.filter(kinds, lambda v: v.isNotNull()))).select("symbol", "ts", "i", "_v.kind", "_v.price")

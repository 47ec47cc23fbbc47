"""Symbols cut into slices of consecutive bars, so that one symbol's bars are worked on by many tasks.

``deal`` numbers the bars of each symbol and deals them to slices, each with copies of as many bars before and after it as the
longest frame needs (its halo); ``own`` drops the copies. The frame that it returns has windows over slices, and true numbers of bars.

Numbers take no window over a symbol: bars are range-sorted into partitions and kept, partitions count their own, and prefix
sums of the counts, a row for each symbol and partition, say where each partition starts. ``carried`` passes what is known at a
partition's end on to those after it in the same way. Recurrences that forget are frames, too: an exponential mean needs as many
bars as its weights take to vanish.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.frames import FRAME, Frame, unused
from barlab.operators.rules import Rule, all_of, lookup, staged_rule
from barlab.sources.io import shared_folder

#: Bars of a slice.
SLICE = 1 << 16
#: Share of an exponential mean's weights that may be left out.
LEFT_OUT = 1e-20


def _ranged(rows: DataFrame, order: list[str], parts: int | None) -> DataFrame:
    """``rows`` range-sorted and kept, with ``_part`` and ``_row``: the range, and the row's number in it."""
    spread = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    at = spread.withColumn("_at", F.monotonically_increasing_id())
    path = f"{shared_folder(rows.sparkSession)}/ranged-{uuid.uuid4().hex}"
    at.write.parquet(path)
    kept = rows.sparkSession.read.schema(at.schema).parquet(path)
    return kept.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")


def numbered(bars: DataFrame, frame: Frame = FRAME, parts: int | None = None) -> DataFrame:
    """``bars`` with ``_number`` of the bar in its symbol and ``_size``, the symbol's number of bars."""
    rows = _ranged(bars, [frame.symbol, frame.ts], parts)
    counts = rows.groupBy(frame.symbol, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    by = Window.partitionBy(frame.symbol)
    before = F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(frame.symbol, "_part", "_first", before.alias("_before"), F.sum("_n").over(by).alias("_size"))
    placed = rows.join(starts, [frame.symbol, "_part"])
    return placed.withColumn("_number", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_before")


def deal(bars: DataFrame, before: int, after: int = 0, rows: int = SLICE, frame: Frame = FRAME, number: bool = True, parts: int | None = None) -> tuple[DataFrame, Frame]:
    """``bars`` dealt to slices of ``rows``, with ``before`` bars before each and ``after`` behind it, and the frame over them.

    ``number``: by counts of ranges, which no hot symbol slows; else by a window over the symbol, which saves writing the bars.
    """
    if number:
        placed = numbered(bars, frame, parts)
    else:
        placed = bars.withColumns({"_number": (F.row_number().over(frame.ordered) - 1).cast("long"), "_size": F.lit(None).cast("long")})
    n = F.col("_number")
    slices = F.sequence(F.greatest(F.lit(0), F.floor((n - after) / rows)).cast("long"), F.floor((n + before) / rows).cast("long"))
    dealt = placed.withColumn("_slice", F.explode(slices)).repartition(frame.symbol, "_slice")
    return dealt.withColumn("_own", F.floor(n / rows) == F.col("_slice")), replace(frame, slice="_slice", number="_number", size_of="_size", own="_own")


def own(dealt: DataFrame) -> DataFrame:
    """``dealt`` bars without the copies and without the columns of slices."""
    return dealt.where("_own").drop("_own", "_slice", "_number", "_size")


#: How many bars before the current one the built-in rules read.
REACH: dict[str, int] = {"exchange_sh": 0, "exchange_sz": 0, "exchange_bj": 0, "no_buy_limit": 0, "rise_three": 2, "bullish_alignment": 30, "sma_cross": 20, "rsi_below": 14, "limit_up_gap": 22, "trend_up": 16}


def with_signal(bars: DataFrame, given: str | Rule | list[str | Rule], out: str = "flag", reach: int | None = None, rows: int = SLICE, frame: Frame = FRAME) -> DataFrame:
    """``bars`` with the column of a rule, or of all of several, worked out in slices. ``reach``: bars before the current one that they read."""
    names = [given] if isinstance(given, str) or callable(given) else list(given)
    if reach is None:
        unknown = [r for r in names if r not in REACH]
        if unknown:
            raise ValueError(f"how many bars does {unknown[0]!r} read? Say so by reach")
        reach = max(REACH[r] for r in names)
    dealt, cut = deal(bars, reach, rows=rows, frame=frame)
    chosen = lookup(names[0]) if len(names) == 1 else all_of(names)
    return own(chosen(dealt, cut, out))


# ---------------------------------------------------------------- recurrences


def forgets(span: int) -> int:
    """Bars after which an exponential mean of ``span`` has forgotten all but ``LEFT_OUT``."""
    return math.ceil(math.log(LEFT_OUT) / math.log(1 - 2 / (span + 1)))


def ewm(value: Column, span: int, frame: Frame, step: Column) -> Column:
    """The exponential mean of ``value`` in a slice, whose first bar seeds it; ``step``: the bar's place in the slice, from 0.

    The recurrence e = a e + (1 - a) x is a running sum of x / a**step, times a**step; slices are short enough for that.
    """
    a = 1 - 2 / (span + 1)
    running = frame.ordered.rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(step == 0, 1.0).otherwise(1 - a)
    return F.sum(value * share * F.pow(F.lit(a), -step)).over(running) * F.pow(F.lit(a), step)


def _macd(bars: DataFrame, names: tuple[str, str], lengths: tuple[int, int, int], frame: Frame, number: bool, parts: int | None) -> tuple[DataFrame, Frame]:
    """``bars`` dealt to slices, with DIF and DEA under ``names``."""
    fast, slow, smooth = lengths
    halo = forgets(slow) + forgets(smooth)
    # As many bars as powers of the fastest mean stay in a double, with room for prices.
    most = int(600 / -math.log(1 - 2 / (min(fast, smooth) + 1)))
    if most - halo < 64:
        raise ValueError("means of too different lengths")
    dealt, cut = deal(bars, halo + 1, rows=most - halo, frame=frame, number=number, parts=parts)
    step, x = unused(dealt, "_step", "_x")
    rows = dealt.withColumn(step, (F.row_number().over(cut.ordered) - 1).cast("double"))
    # Relative to the slice's first close, so that equal closes give zeros.
    rows = rows.withColumn(x, (F.col("close") - F.first("close").over(cut.ordered.rowsBetween(Window.unboundedPreceding, 0))).cast("double"))
    rows = rows.withColumn(names[0], ewm(F.col(x), fast, cut, F.col(step)) - ewm(F.col(x), slow, cut, F.col(step)))
    return rows.withColumn(names[1], ewm(F.col(names[0]), smooth, cut, F.col(step))).drop(step, x), cut


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, smooth: int = 9, frame: Frame = FRAME, number: bool = False, parts: int | None = None) -> DataFrame:
    """``bars`` with ``dif`` and ``dea``; exponential means start at the symbol's first close. DataFrame operations only."""
    return own(_macd(bars, ("dif", "dea"), (fast, slow, smooth), frame, number, parts)[0])


def macd_cross(fast: int = 12, slow: int = 26, smooth: int = 9, number: bool = False, parts: int | None = None) -> Rule:
    """DIF is above DEA and was not one bar before."""

    def apply(bars: DataFrame, frame: Frame, out: str) -> DataFrame:
        if frame.slice is not None:
            raise ValueError("bars are cut into slices already")
        dif, dea = unused(bars, "_dif", "_dea")
        rows, cut = _macd(bars, (dif, dea), (fast, slow, smooth), frame, number, parts)
        above = F.col(dif) > F.col(dea)
        before = F.coalesce(F.lag(dif).over(cut.ordered) > F.lag(dea).over(cut.ordered), F.lit(True))
        return own(rows.withColumn(out, F.coalesce(above & ~before, F.lit(False)))).drop(dif, dea)

    return apply


staged_rule("macd_cross")(macd_cross())


# ---------------------------------------------------------------- what is known from before


def carried(rows: DataFrame, order: list[str], running: Callable[[Window], Column], at_end: Column, onward: Callable[[Window], Column], join: Callable[[Column, Column], Column], out: str, frame: Frame = FRAME, parts: int | None = None) -> DataFrame:
    """``rows`` with ``out``, a running value of each symbol in ``order``, in two levels.

    ``running``: the value within a window that ends at the row; ``at_end``: an aggregate, the value of a whole range (column ``_end`` of a
    row for each symbol and range); ``onward``: that of the ranges before, over a window of them; ``join``: of (what is from before, what is within).
    """
    ranged = _ranged(rows, order, parts)
    own_order = Window.partitionBy(frame.symbol, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    ends = ranged.groupBy(frame.symbol, "_part").agg(at_end.alias("_end"))
    earlier = Window.partitionBy(frame.symbol).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.select(frame.symbol, "_part", onward(earlier).alias("_before"))
    placed = ranged.withColumn("_within", running(own_order)).join(known, [frame.symbol, "_part"])
    return placed.withColumn(out, join(F.col("_before"), F.col("_within"))).drop("_part", "_row", "_within", "_before")

"""Replaying a rule as a long-only ledger.

Prices are closes in currency; buying pays ``close * (1 + slippage)``, selling brings ``close * (1 -
slippage)``; a fee is a share of the amount, at least ``min_fee``. While flat, a signal buys ``size`` if
cash pays for it. While holding, stop-loss and then take-profit sell everything; a bar never does both.
What is held at the end stays open. Equity is cash plus holdings at the close.

Without stop-loss and take-profit the ledger buys once and holds, which windows express. With them it
depends on its path: bars stream through a task in order, in Arrow batches, and the state (cash, position, entry price) is carried
from batch to batch, so a task holds one batch however long a symbol is. Within a batch the next event is looked
for in stretches of doubling length, so the work grows with the bars, not with bars times trades.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.functions.columns import MILLI, Settings
from barlab.functions.frames import FRAME, Frame
from barlab.operators.rules import Feeds, Rule, signal_series
from barlab.sources import io

LEDGER = "symbol string, i int, ts timestamp, signal int, close double, cash double, position int, equity double"


def _spend(s: Settings) -> Column:
    """What buying at this bar costs, with its fee."""
    cost = F.col("_price") * (1 + s.slippage) * s.size
    return cost + F.greatest(cost * s.fee_rate, F.lit(s.min_fee))


def backtest_hold(signals: DataFrame, settings: Settings = Settings(), frame: Frame = FRAME) -> DataFrame:
    """The ledger without stop-loss and take-profit, in windows: bought at the first signal that cash pays for.

    ``signals``: bars with ``signal`` 0 or 1.
    """
    s = settings
    rows = signals.withColumns({"i": frame.index(), "_price": F.col("close") / MILLI}).withColumn("_spend", _spend(s))
    buys = (F.col("signal") == 1) & (F.lit(s.cash) >= F.col("_spend"))
    rows = rows.withColumn("_buy", F.min(F.when(buys, F.struct("i", "_spend"))).over(frame.whole))
    held = F.coalesce(F.col("i") >= F.col("_buy.i"), F.lit(False))
    rows = rows.withColumns({"cash": F.when(held, F.lit(s.cash) - F.col("_buy._spend")).otherwise(F.lit(s.cash)), "position": F.when(held, s.size).otherwise(0)})
    equity = F.col("cash") + F.col("position") * F.col("_price")
    return rows.select("symbol", "i", "ts", "signal", F.col("_price").alias("close"), "cash", "position", equity.alias("equity"))


def spend(close: np.ndarray, s: Settings) -> np.ndarray:
    """What buying at each bar costs, with its fee."""
    cost = close * (1 + s.slippage) * s.size
    return cost + np.maximum(cost * s.fee_rate, s.min_fee)


#: Bars that are looked at one by one before stretches are, and the first stretch.
_NEAR, _STRETCH = 8, 32


class Walk:
    """A ledger's state, which bars are passed through in order, in parts of any length."""

    def __init__(self, settings: Settings):
        self.settings, self.cash, self.entry = settings, settings.cash, None
        s = settings
        self.exits = s.stop_loss > 0 or s.take_profit > 0

    def pass_bars(self, close: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cash, position) at each of the next bars; ``wanted``: which of them signal."""
        s, n = self.settings, len(close)
        cash, position = np.empty(n), np.zeros(n, np.int64)
        sell = close * (1 - s.slippage)
        at = np.flatnonzero(wanted)  # bars that may be bought
        cost = spend(close[at], s)
        buys, costs, sells = at.tolist(), cost.tolist(), sell.tolist()
        k = i = 0  # the next of these, the next bar
        while i < n:
            if self.entry is None:
                while k < len(buys) and buys[k] < i:
                    k += 1
                k = self._payable(cost, costs, k)
                to = buys[k] if k < len(buys) else n
                cash[i:to] = self.cash
                i = to
                if i < n:
                    self.cash -= costs[k]
                    self.entry = float(close[i] * (1 + s.slippage))
                    cash[i], position[i] = self.cash, s.size
                    i += 1
                continue
            to = self._leaves(sell, sells, i) if self.exits and self.entry > 0 else n
            cash[i:to], position[i:to] = self.cash, s.size
            i = to
            if i < n:
                brought = sells[i] * s.size
                self.cash += brought - max(brought * s.fee_rate, s.min_fee)
                self.entry, cash[i] = None, self.cash
                i += 1
        return cash, position

    def _payable(self, cost: np.ndarray, costs: list[float], k: int) -> int:
        """The first from ``k`` on that cash pays for."""
        near = min(k + _NEAR, len(costs))
        while k < near:
            if costs[k] <= self.cash:
                return k
            k += 1
        return self._first(lambda a, b: cost[a:b] <= self.cash, k, len(costs))

    def _leaves(self, sell: np.ndarray, sells: list[float], i: int) -> int:
        """The first bar from ``i`` on at which an exit is reached."""
        s, entry = self.settings, self.entry
        stop, take = (-s.stop_loss if s.stop_loss > 0 else -np.inf), (s.take_profit if s.take_profit > 0 else np.inf)
        near = min(i + _NEAR, len(sells))
        while i < near:
            if not stop < (sells[i] - entry) / entry < take:
                return i
            i += 1

        def reached(a: int, b: int) -> np.ndarray:
            change = (sell[a:b] - entry) / entry
            return (change <= stop) | (change >= take)

        return self._first(reached, i, len(sells))

    @staticmethod
    def _first(holds, i: int, n: int) -> int:
        """The first from ``i`` on that ``holds``, in stretches of doubling length; ``n`` if there is none."""
        step = _STRETCH
        while i < n:
            found = holds(i, min(i + step, n))
            if found.any():
                return i + int(found.argmax())
            i, step = i + step, 2 * step
        return n


def fold(close: np.ndarray, signal: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(cash, position) at each bar of a whole series."""
    return Walk(s).pass_bars(np.asarray(close, np.float64), np.asarray(signal) == 1)


def _ledger_batches(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """Ledger rows of bars (symbol, ts, signal, close) that come by symbol and time."""
    now, walk, number = None, None, 0
    for batch in batches:
        symbols = batch.column(0)
        coded = symbols.dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy()
        close = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64) / MILLI
        signal = batch.column(2).fill_null(0).to_numpy()
        n = len(code)
        index, cash, position = np.empty(n, np.int32), np.empty(n), np.empty(n, np.int32)
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            symbol = symbols[a].as_py()
            if walk is None or symbol != now:
                now, walk, number = symbol, Walk(settings), 0
            cash[a:b], position[a:b] = walk.pass_bars(close[a:b], signal[a:b] == 1)
            index[a:b] = np.arange(number, number + b - a)
            number += b - a
        columns = [symbols, pa.array(index), batch.column(1), pa.array(signal.astype(np.int32)), pa.array(close), pa.array(cash), pa.array(position), pa.array(cash + position * close)]
        yield pa.RecordBatch.from_arrays(columns, ["symbol", "i", "ts", "signal", "close", "cash", "position", "equity"])


def backtest_ledger(signals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The full ledger, a row per bar. ``signals``: bars with ``signal`` 0 or 1.

    Only the columns that the ledger needs cross into Python; a task holds a batch of them.
    """
    rows = signals.select("symbol", F.col("ts").cast("timestamp").alias("ts"), "signal", F.col("close").cast("double").alias("close"))
    spread = rows.repartition("symbol").sortWithinPartitions("symbol", "ts")
    return spread.mapInArrow(lambda batches: _ledger_batches(batches, settings), LEDGER)


def run_backtest(signals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The ledger, by windows where that is enough."""
    if settings.stop_loss > 0 or settings.take_profit > 0:
        return backtest_ledger(signals, settings)
    return backtest_hold(signals, settings)


def backtest_symbol(spark: SparkSession, path: str, symbol: str, rules: str | Rule | Iterable[str | Rule], start: datetime | str | None = None, end: datetime | str | None = None, settings: Settings = Settings(), names: DataFrame | None = None) -> DataFrame:
    """The ledger of one symbol of a stored bar table, on its day bars strictly between the bounds; rules see its minute bars there too."""
    day = io.scan_market(spark, path, start, end).where(F.col("symbol") == symbol)
    minute = io.scan_market(spark, path, start, end, "minute").where(F.col("symbol") == symbol)
    return run_backtest(signal_series(day, rules, feeds=Feeds(minute, names)), settings)


def trades(ledger: DataFrame, settings: Settings = Settings(), frame: Frame = FRAME) -> DataFrame:
    """symbol, i, ts, price, side and qty, from changes of the position."""
    before = F.coalesce(F.lag("position").over(frame.ordered), F.lit(0))
    rows = ledger.withColumn("_change", F.col("position") - before).where("_change <> 0")
    bought = F.col("_change") > 0
    price = F.when(bought, F.col("close") * (1 + settings.slippage)).otherwise(F.col("close") * (1 - settings.slippage))
    return rows.select("symbol", "i", "ts", price.alias("price"), F.when(bought, "buy").otherwise("sell").alias("side"), F.abs("_change").cast("int").alias("qty"))

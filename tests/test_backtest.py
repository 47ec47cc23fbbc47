import re
import time
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.functions.columns import Settings, with_defaults
from barlab.operators.backtest import Walk, backtest_hold, backtest_ledger, fold, trades
from barlab.operators.grid import sma_grid
from barlab.operators.metrics import annualized_return, by_symbol, market_summary, market_top
from barlab.operators.rules import sma_cross, _from_column, signal_series

START = date(2024, 1, 1)


def loop(close, signal, s):
    """The ledger, a bar after another."""
    cash, pos, entry, out = s.cash, 0, 0.0, []
    for price, sig in zip(close, signal, strict=True):
        buy, sell = price * (1 + s.slippage), price * (1 - s.slippage)
        if sig == 1 and pos == 0:
            cost = buy * s.size
            fee = max(cost * s.fee_rate, s.min_fee)
            if cash >= cost + fee:
                cash, pos, entry = cash - (cost + fee), s.size, buy
        elif pos > 0:
            r = (sell - entry) / entry if entry > 0 else 0
            if entry > 0 and ((s.stop_loss > 0 and r <= -s.stop_loss) or (s.take_profit > 0 and r >= s.take_profit)):
                got = sell * pos
                cash, pos, entry = cash + (got - max(got * s.fee_rate, s.min_fee)), 0, 0.0
        out.append((cash, pos))
    return out


def signals(spark, series):
    rows = [(s, START + timedelta(k), int(c), int(g)) for s, own in series.items() for k, (c, g) in enumerate(own)]
    return spark.createDataFrame(rows, "symbol string, ts date, close long, signal int")


def test_fold_is_the_loop():
    rng = np.random.default_rng(2)
    for k in range(300):
        n = int(rng.integers(1, 80))
        close = np.maximum(np.cumsum(rng.integers(-6, 7, n)) + 60, 1) / 2.0
        signal = (rng.random(n) < rng.random()).astype(int)
        s = Settings(cash=float(rng.integers(20, 200)), size=int(rng.integers(1, 4)), fee_rate=0.001, min_fee=float(rng.integers(0, 3)), slippage=float(rng.choice([0, 0.01])), stop_loss=float(rng.choice([0, 0.1])), take_profit=float(rng.choice([0, 0.05, 0.2])))
        cash, position = fold(close, signal, s)
        assert list(zip(cash.tolist(), position.tolist(), strict=True)) == loop(close, signal, s)


def test_parts_of_any_length_give_the_same_ledger():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        close = np.maximum(np.cumsum(rng.integers(-6, 7, n)) + 60, 1) / 2.0
        signal = (rng.random(n) < rng.random() * 0.3).astype(int)
        s = Settings(cash=float(rng.integers(20, 200)), min_fee=0.5, slippage=0.01, stop_loss=float(rng.choice([0, 0.02, 0.3])), take_profit=float(rng.choice([0.05, 0.6])))
        walk, parts = Walk(s), np.split(np.arange(n), np.sort(rng.integers(0, n, int(rng.integers(0, 6)))))
        got = [walk.pass_bars(close[k], signal[k] == 1) for k in parts]
        assert [x for c, p in got for x in zip(c.tolist(), p.tolist(), strict=True)] == loop(close, signal, s)


def test_a_million_bars_in_near_linear_time():
    rng = np.random.default_rng(7)
    s = Settings(cash=1e9, size=1, fee_rate=0.0, min_fee=0.0, stop_loss=0.0005, take_profit=0.0005)
    n = 1_000_000
    close = 1000 + np.cumsum(rng.normal(0, 0.4, n))
    often, seldom = (rng.random(n) < 0.9), (rng.random(n) < 0.00001)
    for signal, least in ((often, 300_000), (seldom, 5)):
        start = time.perf_counter()
        _, position = fold(close, signal, s)
        assert time.perf_counter() - start < 10
        assert np.count_nonzero(np.diff(position)) > least
    # Held or poor to the end: every bar is looked at once or twice, not once for each signal.
    poor = Settings(cash=1.0)
    looked = []
    found = Walk._first
    Walk._first = staticmethod(lambda holds, i, m: found(lambda a, b: looked.append(b - a) or holds(a, b), i, m))
    try:
        fold(close, often, poor)
    finally:
        Walk._first = staticmethod(found)
    assert sum(looked) <= n


def test_one_long_symbol_streams_through_batches(spark):
    """State is carried over Arrow batches, between symbols it is not."""
    rng = np.random.default_rng(8)
    s = Settings(cash=60.0, min_fee=0.5, stop_loss=0.02, take_profit=0.05)
    own = {c: list(zip(np.maximum(np.cumsum(rng.integers(-300, 301, n)) + 20_000, 500), rng.integers(0, 2, n), strict=True)) for c, n in (("a", 3000), ("b", 10), ("c", 2000))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        got = {}
        for r in sorted(backtest_ledger(signals(spark, own), s).collect(), key=lambda r: (r.symbol, r.ts)):
            got.setdefault(r.symbol, []).append((r.i, r.cash, r.position))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c, rows in own.items():
        want = loop([x / 1000.0 for x, _ in rows], [g for _, g in rows], s)
        assert got[c] == [(k, *w) for k, w in enumerate(want)]


def test_hold_equals_the_full_ledger(spark):
    rng = np.random.default_rng(3)
    series = {f"s{k}": list(zip(np.maximum(np.cumsum(rng.integers(-900, 1000, 60)) + 20_000, 500), rng.integers(0, 2, 60), strict=True)) for k in range(8)}
    df, s = signals(spark, series), Settings(cash=45.0, size=2, min_fee=1.0, slippage=0.01)
    rows = lambda ledger: sorted((r.symbol, r.i, r.cash, r.position, r.equity) for r in ledger.collect())
    assert rows(backtest_hold(df, s)) == rows(backtest_ledger(df, s))


def test_bought_once_and_held(spark):
    df, s = signals(spark, {"a": [(10_000, 0), (11_000, 1), (12_000, 1)]}), Settings(cash=100.0, size=1, fee_rate=0.0, min_fee=5.0)
    ledger = backtest_hold(df, s).orderBy("i").collect()
    assert [(r.cash, r.position, r.equity) for r in ledger] == [(100, 0, 100), (84, 1, 95), (84, 1, 96)]
    item = by_symbol(backtest_hold(df, s), 100.0).first()
    assert (item.total_return, item.max_drawdown) == (pytest.approx(-0.04), pytest.approx(0.05))
    trade = trades(backtest_hold(df, s), s).collect()
    assert [(t.i, t.price, t.side, t.qty) for t in trade] == [(1, 11.0, "buy", 1)]


def test_too_poor_and_one_bar(spark):
    df = signals(spark, {"poor": [(11_000, 1), (11_000, 1)], "one": [(1_000, 1)]})
    items = {r.symbol: r for r in by_symbol(backtest_hold(df, Settings(cash=10.0)), 10.0).collect()}
    assert (items["poor"].total_return, items["poor"].sharpe, items["poor"].max_drawdown) == (0, 0, 0) and (items["one"].sharpe, items["one"].max_drawdown) == (0, 0)


@pytest.mark.parametrize("path,settings", [([100, 90, 95], {"stop_loss": 0.1}), ([100, 125, 95], {"take_profit": 0.25})])
def test_exits_at_the_bound_and_does_not_buy_on_that_bar(spark, path, settings):
    df = signals(spark, {"a": [(c * 1000, 1) for c in path]})
    ledger = backtest_ledger(df, Settings(cash=1000.0, min_fee=1.0, **settings)).orderBy("i").collect()
    assert [r.position for r in ledger] == [1, 0, 1]


def test_market_summary_of_nothing_is_zeros(spark):
    none = by_symbol(backtest_hold(signals(spark, {}), Settings()), 1.0)
    assert tuple(market_summary(none).first()) == (0, 0, 0, 0) and market_top(none).count() == 0


def test_defaults_and_annualized(spark):
    params = spark.createDataFrame([(0.0, -1, None, 2.0)], "cash double, size int, fee_rate double, min_fee double")
    assert tuple(with_defaults(params).first()) == (100_000.0, 1, 0.0005, 2.0)
    df = spark.createDataFrame([(0.21, 504), (-1.0, 10)], "r double, n int")
    got = [r[0] for r in df.select(annualized_return(F.col("r"), F.col("n"))).collect()]
    assert got[0] == pytest.approx(0.1) and got[1] is None


def test_grid_equals_single_backtests(spark):
    rng = np.random.default_rng(4)
    series = {f"s{k}": [(c, 0) for c in np.maximum(np.cumsum(rng.integers(-900, 1000, 120)) + 20_000, 500)] for k in range(3)}
    bars, s = signals(spark, series).drop("signal"), Settings(cash=60.0, size=1, min_fee=1.0, stop_loss=0.05, take_profit=0.1)
    got = {(r.symbol, r.fast, r.slow): (r.total_return, r.sharpe, r.max_drawdown) for r in sma_grid(bars, (3, 5), (10, 20), s, top_k=4).collect()}
    for fast, slow in ((3, 10), (5, 20)):
        own = by_symbol(backtest_ledger(signal_series(bars, _from_column(sma_cross(fast, slow))), s), s.cash)
        for r in own.collect():
            assert got[r.symbol, fast, slow] == pytest.approx((r.total_return, r.sharpe, r.max_drawdown))


def test_grid_with_exits_is_dealt_by_symbol_and_block_of_pairs(spark):
    rng = np.random.default_rng(5)
    bars = signals(spark, {"one": [(c, 0) for c in np.maximum(np.cumsum(rng.integers(-900, 1000, 300)) + 20_000, 500)]}).drop("signal")
    s = Settings(cash=60.0, min_fee=1.0, stop_loss=0.05, take_profit=0.1)
    dealt = sma_grid(bars, (3, 4, 5), (10, 20), s, top_k=6)
    assert re.search(r"hashpartitioning\(symbol#\d+, block#\d+", dealt._jdf.queryExecution().executedPlan().toString())
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(dealt) == rows(sma_grid(bars, (3, 4, 5), (10, 20), s, top_k=6, pair_blocks=1))

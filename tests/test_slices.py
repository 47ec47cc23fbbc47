"""Symbols cut into slices give what whole symbols give."""

import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlab.functions.columns import Settings
from barlab.functions.frames import FRAME
from barlab.operators import asof, indicators, metrics, rules, slices
from barlab.operators.backtest import backtest_ledger
from barlab.operators.pivots import vertices
from barlab.operators.rules import signal_series

SCHEMA = "symbol string, ts timestamp, open long, high long, low long, close long, volume long"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    """One symbol with most of the bars, some with few, one with one."""
    rng, rows = np.random.default_rng(11), []
    for s, n in (("hot", 900), ("b", 70), ("c", 33), ("d", 1), ("e", 400)):
        close = np.maximum(np.cumsum(rng.integers(-9, 10, n)) + 300, 20)
        opened, volume = np.maximum(close + rng.integers(-5, 4, n), 1), rng.integers(50, 60, n)
        for k in range(30, n - 30, 37):  # a limit-up, a gap, rising bars, and a surge some bars on
            close[k] = close[k - 1] * 9 // 8
            opened[k + 1], opened[k + 2] = close[k] + 5, close[k] + 8
            close[k + 1], close[k + 2] = close[k] + 9, close[k] + 12
            volume[k + int(rng.integers(2, 19))] = 500
        for k in range(n):
            rows.append((s, START + timedelta(minutes=k), int(opened[k]), int(max(opened[k], close[k]) + rng.integers(0, 3)), int(min(opened[k], close[k]) - rng.integers(0, 3)), int(close[k]), int(volume[k])))
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_numbers_and_halos(bars, size):
    dealt, _ = slices.deal(bars, before=3, after=2, rows=size, parts=5)
    got = {}
    for r in dealt.collect():
        got.setdefault((r.symbol, r["_slice"]), []).append((r["_number"], r["_own"], r["_size"]))
    for s, n in (("hot", 900), ("d", 1), ("c", 33)):
        for k in range(-(-n // size)):
            want = [(i, k * size <= i < (k + 1) * size, n) for i in range(max(0, k * size - 3), min(n, (k + 1) * size + 2))]
            assert sorted(got[s, k]) == want
    assert rows_of(slices.own(dealt)) == rows_of(bars)


@pytest.mark.parametrize("name", ["rise_three", "bullish_alignment", "sma_cross", "rsi_below", "limit_up_gap"])
def test_rules_in_slices_equal_whole_symbols(bars, name):
    want = rules.with_signal(bars, name)
    assert want.where("flag").count() > 0
    for size in (5, 40, 1000):
        assert rows_of(slices.with_signal(bars, name, rows=size)) == rows_of(want)


def test_all_of_and_unknown_reach(bars):
    names = ["rise_three", "exchange_sh", "sma_cross"]
    assert rows_of(slices.with_signal(bars, names, rows=50)) == rows_of(rules.with_signal(bars, names))
    with pytest.raises(ValueError, match="reach"):
        slices.with_signal(bars, "macd_cross")
    with pytest.raises(ValueError, match="cut into slices already"):
        slices.with_signal(bars, "macd_cross", reach=50)


def test_pivots_are_carried_from_slice_to_slice(spark):
    rng, rows = np.random.default_rng(21), []
    for s in range(12):
        n = 60 + 40 * s
        close = np.maximum(60 + np.cumsum(rng.integers(-3, 4, n)) + (np.arange(n) // 3 if s % 2 else 0), 3)
        calm = rng.random(n) < 0.4 * (s % 3 == 0)  # stretches without pivots, ties
        close = np.where(calm, close[0], close)
        for k in range(n):
            rows.append((f"s{s:02}", START + timedelta(minutes=k), int(close[k]), int(close[k] + rng.integers(0, 3)), int(close[k] - rng.integers(0, 3)), int(close[k]), 1))
    bars = spark.createDataFrame(rows, SCHEMA).cache()
    want = rules.with_signal(bars, "trend_up")
    assert want.where("flag").count() > 10
    for size in (9, 33, 500):
        assert rows_of(slices.with_signal(bars, "trend_up", rows=size)) == rows_of(want)


def test_indicators_in_slices(bars):
    dealt, cut = slices.deal(bars, before=30, rows=45)
    assert rows_of(slices.own(indicators.with_smas(dealt, frame=cut))) == rows_of(indicators.with_smas(bars))
    got, want = rows_of(slices.own(indicators.bollinger(dealt, frame=cut))), rows_of(indicators.bollinger(bars))
    assert all(a == pytest.approx(b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True) if not isinstance(b, (str, datetime)))
    dealt, cut = slices.deal(bars, before=8, after=8, rows=45)
    assert rows_of(vertices(dealt, 8, cut)) == rows_of(vertices(bars, 8))


def plain_macd(close):
    c = pd.Series(close, dtype="float64")
    mean = lambda s, n: s.ewm(span=n, adjust=False).mean()
    dif = mean(c, 12) - mean(c, 26)
    return dif, mean(dif, 9)


def test_macd_equals_the_recurrence(spark, bars):
    got = {(r.symbol, r.ts): (r.dif, r.dea) for r in slices.macd(bars).collect()}
    cross = {(r.symbol, r.ts): r.flag for r in rules.with_signal(bars, "macd_cross").collect()}
    own = {}
    for r in sorted(bars.collect(), key=lambda r: r.ts):
        own.setdefault(r.symbol, []).append(r)
    for s, rows in own.items():
        dif, dea = plain_macd([r.close for r in rows])
        above = dif > dea
        flags = above & ~above.shift(1, fill_value=True)
        for k, r in enumerate(rows):
            assert got[s, r.ts] == (pytest.approx(dif[k], abs=1e-9), pytest.approx(dea[k], abs=1e-9)) and cross[s, r.ts] == flags[k]
    assert any(cross.values())
    plan = rules.with_signal(bars, "macd_cross")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    flat = spark.createDataFrame([("f", START + timedelta(k), 5, 5, 5, 5, 1) for k in range(50)], SCHEMA)
    assert {(r.dif, r.dea) for r in slices.macd(flat).collect()} == {(0.0, 0.0)}


def test_a_million_bars_of_one_symbol_use_many_tasks(spark):
    n = 1_000_000
    bars = spark.range(0, n, 1, 8).select(F.lit("one").alias("symbol"), F.timestamp_seconds("id").alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(2000)) + 30_000).alias("close"))
    made = slices.macd(bars, number=True, parts=8)
    dealt, _ = slices.deal(bars, 30, rows=50_000, parts=8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the bars are small enough for one task
    try:
        tasks = dealt.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 3 and max(r["count"] for r in tasks) < n / 2
    ends = {r.ts: (r.dif, r.dea) for r in made.where("unix_seconds(ts) % 1009 = 0").collect()}
    close = [r.close for r in bars.orderBy("ts").select("close").collect()]
    dif, dea = plain_macd(close)
    for ts, (a, b) in ends.items():
        k = int(ts.timestamp()) if ts.tzinfo else int((ts - datetime(1970, 1, 1)).total_seconds())
        assert a == pytest.approx(dif[k], abs=1e-9) and b == pytest.approx(dea[k], abs=1e-9)


def test_asof_and_factors_in_two_levels(spark, bars):
    rng, rows = np.random.default_rng(12), []
    for s, n in (("hot", 60), ("b", 3), ("e", 200), ("none", 4)):
        for k in sorted(rng.choice(950, n, replace=False)):
            rows.append((s, START + timedelta(minutes=int(k) - 20), int(k), int(k) + 5, float(rng.choice([0.5, 2.0]))))
    events = spark.createDataFrame(rows, "symbol string, ts timestamp, float_stock long, total_stock long, factor double")
    assert rows_of(asof.asof(bars, events, ["float_stock"], cut=True, parts=9)) == rows_of(asof.asof(bars, events, ["float_stock"]))
    assert rows_of(asof.turnover_rate(bars, events, cut=True)) == rows_of(asof.turnover_rate(bars, events))
    for forward in (False, True):
        assert rows_of(asof.adjust_prices(bars, events, forward, cut=True)) == rows_of(asof.adjust_prices(bars, events, forward))


def test_metrics_of_merged_summaries(bars):
    s = Settings(cash=3.0, size=2, fee_rate=0.001, min_fee=0.01, slippage=0.01, stop_loss=0.05, take_profit=0.1)
    ledger = backtest_ledger(signal_series(bars, "rise_three"), s).cache()
    want = {r.symbol: tuple(r) for r in metrics.by_symbol(ledger, s.cash).collect()}
    for size in (1, 2, 50, 10_000):
        got = {r.symbol: tuple(r) for r in metrics.by_slices(ledger, s.cash, size).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][1:] == pytest.approx(want[k][1:], abs=1e-9) for k in want)


def test_frames_over_whole_symbols_are_refused():
    _, cut = None, FRAME.__class__(slice="_slice", number="_number", size_of="_size")
    for make in (lambda: cut.whole, lambda: cut.so_far, lambda: cut.rows(-(1 << 63), 0)):
        with pytest.raises(ValueError, match="whole symbol"):
            make()

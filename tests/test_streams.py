"""Rules over symbols that are streamed in batches."""

from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_rules import bars, flags, flat

from barlab.operators import rules
from barlab.operators.rules import with_signal
from barlab.operators.streams import whole_symbols


@pytest.fixture(params=["7", "10000"])
def batch_rows(spark, request):
    """Batches that end within symbols, and such that hold all."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, request.param)
    yield
    spark.conf.set(key, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_are_cut_between_symbols():
    symbols = [None, None, "a", "b", "b", "b", "b", "b", "c", "d", "d"]
    for size in range(1, 12):
        batches = [pa.RecordBatch.from_arrays([pa.array(symbols[k : k + size], pa.string()), pa.array(range(k, min(k + size, 11)))], ["symbol", "n"]) for k in range(0, 11, size)]
        got = [rows.slice(a, b - a).to_pydict() for rows, cuts in whole_symbols(iter([*batches, batches[0].slice(0, 0)]), [0]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        assert [(g["symbol"][0], g["n"]) for g in got] == [(None, [0, 1]), ("a", [2]), ("b", [3, 4, 5, 6, 7]), ("c", [8]), ("d", [9, 10])]


def test_a_prefix_rule_reads_arrays(spark, batch_rows):
    @rules.prefix_rule("three_up", arrays=True)
    def _three_up(symbol, prefix):
        c = prefix["close"]
        return symbol != "s1" and len(prefix) == len(c) >= 3 and c[-1] > c[-2] > c[-3]

    df = bars(spark, {f"s{k}": flat([(7 * k + i * i) % 11 for i in range(3 * k)]) for k in range(1, 9)})
    got, want = with_signal(df, "three_up"), flags(with_signal(df, "rise_three"))
    rules.remove("three_up")
    assert "FlatMapGroups" not in plan(got) and got.columns == [*df.columns, "flag"] and got.schema["ts"] == df.schema["ts"]
    assert flags(got) == want | {"s1": [False] * 3} and any(map(any, want.values()))


def test_a_prefix_rule_reads_arrays_of_day_and_minute_bars(spark, batch_rows):
    from test_rules import two_intervals

    @rules.prefix_rule("two_above", full=True, arrays=True)
    def _two_above(info, day, minute):
        return len(minute) >= 2 and 2 * day["close"][-1] > minute["close"][-2:].sum() and info["price"] >= day["open"][0]

    @rules.prefix_rule("two_above_tables", full=True)
    def _two_above_tables(info, day, minute):
        return len(minute) >= 2 and 2 * day["close"].iloc[-1] > minute["close"].iloc[-2:].sum() and info["price"] >= day["open"].iloc[0]

    day, minute = two_intervals(spark)
    got, want = (flags(with_signal(day, name, feeds=rules.Feeds(minute))) for name in ("two_above", "two_above_tables"))
    for name in ("two_above", "two_above_tables"):
        rules.remove(name)
    assert got == want and any(map(any, got.values()))


def test_the_market_is_screened_without_a_group_for_each_symbol(spark, batch_rows):
    from test_rules import two_intervals

    from barlab.operators.screen import screen

    @rules.pandas_rule("minutes_today", full=True)
    def _minutes_today(info, day, minute):
        return day["minutes_seen"].diff().fillna(day["minutes_seen"]) > 0

    day, minute = two_intervals(spark)
    got = screen(day, ["minutes_today"], feeds=rules.Feeds(minute))
    made = {r.symbol for r in got.collect()}
    rules.remove("minutes_today")
    days, seen = {}, {(m.symbol, m.ts.date()) for m in minute.collect()}
    for d in sorted(day.collect(), key=lambda d: d.ts):
        days.setdefault(d.symbol, []).append(d.ts.date())
    assert "FlatMapCoGroups" not in plan(got)
    assert made == {s for s, own in days.items() if any(s == t and (len(own) < 2 or own[-2] < at) and at <= own[-1] for t, at in seen)}


def test_a_series_rule_reads_arrays(spark, batch_rows):
    from test_rules import two_intervals

    @rules.pandas_rule("up_arrays", arrays=True)
    def _up_arrays(prefix):
        return np.concatenate([[False], np.diff(prefix["close"]) > 0])

    @rules.pandas_rule("seen_arrays", full=True, arrays=True)
    def _seen_arrays(info, day, minute):
        ends = day["ts"].astype("datetime64[D]") + 1
        return (day["minutes_seen"] == [(minute["ts"] < e).sum() for e in ends]) & (info["price"] == day["close"][-1]) & (info["code"] == day["symbol"])

    df = bars(spark, {f"s{k}": flat([(7 * k + i * i) % 11 for i in range(3 * k)]) for k in range(1, 9)})
    up = {s: [False, *[b > a for a, b in zip(c, c[1:], strict=False)]] for s, c in ((f"s{k}", [(7 * k + i * i) % 11 for i in range(3 * k)]) for k in range(1, 9))}
    day, minute = two_intervals(spark)
    # Minute bars of the same columns as the day bars, and of others.
    made = [flags(with_signal(df, "up_arrays")), *[flags(with_signal(day, "seen_arrays", feeds=rules.Feeds(m))) for m in (minute, minute.withColumn("more", F.lit(1)))]]
    for name in ("up_arrays", "seen_arrays"):
        rules.remove(name)
    assert made[0] == up and all(all(map(all, m.values())) and m.keys() == {r.symbol for r in day.collect()} for m in made[1:])


def test_the_snapshot_is_of_the_last_bar_with_a_time(spark, batch_rows):
    @rules.pandas_rule("told", full=True)
    def _told(info, day, minute):
        return day["close"].map(lambda c: str(info) == expected[info["code"]])

    schema = "symbol string, ts timestamp_ntz, open long, high long, low long, close long, volume long, turnover double, float_stock long"
    row = lambda s, d, c, t, f: (s, d and datetime(2024, 1, d), 1, 1, 1, c, 1, t, f)
    df = spark.createDataFrame([row("a", 1, 5, 0.5, 10), row("a", 3, 7, None, 20), row("a", 2, 6, 0.1, 30), row("a", None, 9, 0.9, 90), row("b", None, 4, 0.2, 2), row("c", 1, None, 0.3, 3)], schema)
    names = spark.createDataFrame([("a", "beta"), ("a", "alpha"), ("x", "none"), (None, "null")], "symbol string, name string")
    fields = lambda *v: str(dict(zip([f.split(" ")[0] for f in rules.INFO.split(", ")], v, strict=True)))
    expected = {"a": fields("a", "alpha", 7, None, 20, None, 140, None), "b": fields("b", *[None] * 7), "c": fields("c", None, None, 0.3, 3, None, None, None)}
    got = with_signal(df, "told", feeds=rules.Feeds(df.where("symbol = 'b'"), names))
    assert sorted(r.symbol for r in got.where("flag").collect()) == ["a"] * 4 + ["b", "c"]
    rules.remove("told")


def test_day_bars_are_made_once_for_a_rule_on_two_intervals(spark):
    """An aggregate of its own for the snapshot made them again."""
    import barlab.plans.bars  # noqa: F401  (registers the rule)
    from barlab.operators import bars as A
    from barlab.plans.adapter import prints

    minute = A.bars_from_ticks(prints(spark, "/root/testdata/sf0.001"), "minute", ("event_id",)).select("symbol", "ts", "open", "high", "low", "close", "volume")
    day = A.resample(minute, "day").select(*minute.columns)
    got = with_signal(day, "above_minutes", feeds=rules.Feeds(minute))
    got.collect()
    final = plan(got).split("== Initial Plan ==")[0]
    assert len([line for line in final.split("\n") if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]) == 3


def test_a_series_rule_gets_its_own_tables(spark, batch_rows):
    from test_rules import two_intervals

    @rules.pandas_rule("own_tables", full=True)
    def _own_tables(info, day, minute):
        own = {info["code"]} == set(day["symbol"]) and set(minute["symbol"]) <= {info["code"]}
        ordered = day["ts"].is_monotonic_increasing and minute["ts"].is_monotonic_increasing
        plain = day["ts"].dt.tz is None and list(day.index) == list(range(len(day))) and info["price"] == day["close"].iloc[-1]
        ends = day["ts"].dt.normalize() + pd.Timedelta(days=1)
        return (day["minutes_seen"] == [(minute["ts"] < e).sum() for e in ends]) & own & ordered & plain

    day, minute = two_intervals(spark)
    got = with_signal(day, "own_tables", feeds=rules.Feeds(minute.union(minute.limit(1).withColumn("symbol", F.lit("none")))))
    made = flags(got)
    rules.remove("own_tables")
    assert "FlatMapCoGroups" not in plan(got) and all(map(all, made.values()))
    assert {s: len(f) for s, f in made.items()} == {r.symbol: r["count"] for r in day.groupBy("symbol").count().collect()}


def test_a_rule_gives_a_value_for_each_bar(spark):
    rules.pandas_rule("too_few")(lambda pdf: [True])
    with pytest.raises(Exception, match="1 values for 2 bars"):
        with_signal(bars(spark, {"a": flat([1, 2])}), "too_few").collect()
    rules.remove("too_few")

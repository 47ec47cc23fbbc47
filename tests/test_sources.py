from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barlab.functions import columns as C
from barlab.operators import rules
from barlab.operators.asof import adjust_prices, asof, turnover_rate
from barlab.operators.bars import bars_from_ticks, nest_bars, nest_chunks, resample, unnest
from barlab.operators.screen import page, page_after, screen, snapshot, sort_results, tail, with_names
from barlab.sources import io
from barlab.streaming.bars import _parts, stored_bars, stream_bars, stream_upsert, superseded, write_version

DAY = datetime(2024, 1, 1)


def rows(spark, symbol="a", n=5, first=0):
    data = [(symbol, DAY + timedelta(days=first + k), 10 + k, 12 + k, 9 + k, 11 + k, 100) for k in range(n)]
    return spark.createDataFrame(data, "symbol string, ts timestamp, open long, high long, low long, close long, volume long")


def test_ranges_exclude_their_bounds_and_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "bars")
    io.write_bars(rows(spark).union(rows(spark, "b")), path, "day")
    io.write_bars(rows(spark, "m"), path, "minute")
    got = io.read_bars(spark, path, "a", "2024-01-01", "2024-01-05")
    assert [r.ts.day for r in got.collect()] == [2, 3, 4]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = got.select("*")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(ts," in plan and "EqualTo(symbol,a)" in plan and "PartitionFilters: [isnotnull(interval" in plan
    assert io.read_bars(spark, path, "none").count() == 0 and io.read_minute_bars(spark, path, "m").count() == 5
    assert {r.symbol for r in io.scan_market(spark, path).collect()} == {"a", "b"}


@pytest.mark.parametrize("now,stale", [("2024-05-02 14:59:00", {"old", "new"}), ("2024-05-02 15:00:00", {"old", "new"}), ("2024-05-02 15:01:00", {"old", "yesterday", "new"})])
def test_refresh(spark, now, stale):
    seconds = lambda t: int((datetime.fromisoformat(t) - datetime(1970, 1, 1)).total_seconds())
    markers = spark.createDataFrame([("old", seconds("2024-05-01 14:59:00")), ("yesterday", seconds("2024-05-01 15:00:00")), ("today", seconds("2024-05-02 15:00:00"))], "key string, time long")
    wanted = spark.createDataFrame([("old",), ("yesterday",), ("today",), ("new",)], "key string")
    got = {r.key: r.updated for r in io.needs_refresh(wanted, markers, now).collect()}
    assert set(got) == stale and got["new"] == 0


def test_upsert_replaces_the_last_bar_and_adds_the_rest(spark):
    old = rows(spark, n=3)
    new = rows(spark, n=3, first=2).withColumn("close", F.lit(99).cast("long")).union(rows(spark, "new", 2))
    got = {(r.symbol, r.ts.day): r.close for r in io.upsert_tail(old, new).collect()}
    assert got == {("a", 1): 11, ("a", 2): 12, ("a", 3): 99, ("a", 4): 99, ("a", 5): 99, ("new", 1): 11, ("new", 2): 12}


def test_resample_and_ticks(spark):
    week = resample(rows(spark, n=9).withColumn("amount", F.lit(1.5)), "week").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.amount) for r in week] == [(10, 18, 9, 17, 700, 10.5), (17, 20, 16, 19, 200, 3.0)]
    ticks = spark.createDataFrame([("a", DAY + timedelta(seconds=s), i, p, 2) for s, i, p in [(10, 2, 7), (10, 1, 5), (200, 3, 9), (301, 4, 4)]], "symbol string, ts timestamp, id int, price long, volume int")
    five = bars_from_ticks(ticks, "5 minutes", ("id",)).orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in five] == [(5, 9, 5, 9, 6), (4, 4, 4, 4, 2)]


def test_nesting_takes_screened_symbols_only(spark):
    got = nest_bars(spark.createDataFrame([("a",), ("none",)], "symbol string"), rows(spark).union(rows(spark, "b"))).collect()
    assert {r.symbol: None if r.bars is None else [b.close for b in r.bars] for r in got} == {"a": [11, 12, 13, 14, 15], "none": None}


def test_csv_comes_back(spark, tmp_path):
    df = spark.createDataFrame([("sh600000", 'n"a,me', 1.5)], "code string, name string, price double")
    io.write_csv(df, str(tmp_path / "csv"), ("code", "name", "price"))
    assert [tuple(r) for r in spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "csv")).collect()] == [tuple(df.first())]


def test_columns(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(C.turnover_pct(F.lit(v).cast("double"))) for v in (0.5, 1.0, 1.5, None)] == [50, 100, 1.5, 0]
    assert [get(C.format_units(F.lit(v).cast("double"), "x")) for v in (2.5e8, 12_345.0, 12.0, float("nan"), None)] == ["2.50亿x", "1.23万x", "12.00x", "0", "0"]
    assert get(C.format_units(F.lit(12.5), plain_small=True)) == "12.5"
    assert get(C.normalize_time(F.lit(1_700_000_000))) == get(C.normalize_time(F.lit(1_700_000_000_000)))
    assert [get(C.signal_label(F.lit(s))) for s in (1, 0, -1)] == ["buy", "hold", "sell"] and get(C.date_label(F.lit(date(2024, 3, 9)))) == "24-03-09"
    prices = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 5000.0), ("b", 2, 10.0)], "symbol string, ts int, close double")
    got = {(r.symbol, r.ts): r.close for r in C.price_rescale(prices.withColumn("open", F.col("close")), columns=("open", "close")).collect()}
    assert got == {("a", 1): 5.0, ("b", 1): 5.0, ("b", 2): 0.01}
    named = spark.createDataFrame([("sh600000", "Alpha"), ("sz000001", None)], "symbol string, name string")
    find = lambda q: {r.symbol for r in named.where(C.search_symbols(q)).collect()}
    assert find("SH6") == {"sh600000"} and find("alpha-sh") == {"sh600000"} and find("0000") == {"sh600000", "sz000001"}


def test_asof_sees_events_of_the_same_time(spark):
    events = spark.createDataFrame([("a", DAY + timedelta(days=1), 5), ("a", DAY + timedelta(days=3), 7), ("z", DAY, 1)], "symbol string, ts timestamp, shares long")
    got = [r.shares for r in asof(rows(spark), events, ["shares"]).orderBy("ts").collect()]
    assert got == [None, 5, 5, 7, 7]
    capital = events.select("symbol", "ts", (F.col("shares") * 1000).alias("float_stock"), F.lit(1).cast("long").alias("total_stock"))
    assert [r.turnover for r in turnover_rate(rows(spark), capital).orderBy("ts").collect()][:2] == [None, 2.0]
    factors = events.select("symbol", "ts", F.lit(2.0).alias("factor"))
    assert [r.close for r in adjust_prices(rows(spark), factors).orderBy("ts").collect()] == [11, 24, 26, 56, 60]
    assert [r.close for r in adjust_prices(rows(spark), factors, forward=True).orderBy("ts").collect()] == [2.75, 6, 6.5, 14, 15]


def test_order_and_pages(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "symbol string, v int")
    assert [r.symbol for r in sort_results(df, "v", True).collect()] == ["c", "a", "b"]
    assert [r.symbol for r in page(sort_results(df, "symbol"), 1, 2).collect()] == ["c"]
    assert [r.close for r in tail(rows(spark), 2).orderBy("ts").collect()] == [14, 15]


def test_stream_drops_late_prints_and_holds_back_open_bars(spark, tmp_path):
    kinds = "symbol string, ts timestamp, price long, volume int"
    at = lambda m: DAY + timedelta(minutes=m)
    for k, batch in enumerate([[("a", at(1), 5, 1), ("a", at(4), 7, 1)], [("a", at(30), 9, 1)], [("a", at(2), 1, 1), ("a", at(31), 8, 1)], [("a", at(60), 3, 1)]]):
        spark.createDataFrame(batch, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(4):
        stream = spark.readStream.schema(kinds).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        del k
        stream_bars(stream, "10 minutes", "5 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.ts, r.open, r.close, r.volume) for r in spark.read.parquet(out).collect())
    assert got[0][0] == DAY and got[-1][0] < at(60)


def test_an_upsert_is_restarted_and_rewrites_only_what_it_touches(spark, tmp_path):
    store, state, incoming = (str(tmp_path / x) for x in ("store", "state", "in"))
    old = rows(spark, "a").union(rows(spark, "b")).union(rows(spark, "c"))
    write_version(old, store, 0, 2)  # symbols share buckets
    kinds = old.schema
    expected = {(r.symbol, r.ts.day): r.close for r in old.collect()}
    for k in range(4):
        # Each run is a new query on the same checkpoint, as after a restart.
        fresh = rows(spark, "a", 3, 4 + 2 * k).withColumn("close", F.lit(100 + k).cast("long"))
        fresh.coalesce(1).write.mode("append").parquet(incoming)
        last = max(d for c, d in expected if c == "a")
        expected = {key: v for key, v in expected.items() if key != ("a", last)} | {("a", r.ts.day): r.close for r in fresh.collect() if r.ts.day >= last}
        stream_upsert(spark.readStream.schema(kinds).parquet(incoming), store, state, 2).awaitTermination()
        assert {(r.symbol, r.ts.day): r.close for r in stored_bars(spark, store).collect()} == expected
    # A batch that is replayed starts from the versions before it.
    before = {tuple(r) for r in stored_bars(spark, store, 3).collect()}
    assert {tuple(r) for r in stored_bars(spark, store).collect()} != before
    versions = {r.version for r in spark.read.parquet(store).select("version").distinct().collect()}
    touched = {p for p in _parts(spark, store) if p.version == 4}
    assert {p.bucket for p in touched} == {spark.range(1).select(F.pmod(F.xxhash64(F.lit("a")), F.lit(2))).first()[0]}
    assert versions <= {0, 2, 3, 4} and 1 not in versions  # version 1 was replaced two versions ago


def test_what_an_upsert_writes_does_not_grow_with_the_history(spark, tmp_path):
    sizes = {}
    for days in (60, 600):
        store, state, incoming = (str(tmp_path / f"{x}{days}") for x in ("store", "state", "in"))
        write_version(rows(spark, "a", days).union(rows(spark, "b", days)), store, 0, 1)
        fresh = rows(spark, "a", 2, days - 1)
        fresh.coalesce(1).write.parquet(incoming)
        stream_upsert(spark.readStream.schema(fresh.schema).parquet(incoming), store, state, 1).awaitTermination()
        sizes[days] = sum(f.stat().st_size for f in (tmp_path / f"store{days}/version=1").rglob("*.parquet"))
        assert stored_bars(spark, store).count() == 2 * days + 1
    assert sizes[600] < 1.2 * sizes[60]


def test_a_period_that_becomes_empty_and_bars_that_come_late(spark, tmp_path):
    store, state, incoming = (str(tmp_path / x) for x in ("store", "state", "in"))
    write_version(rows(spark, "a", 1).union(rows(spark, "b", 3)), store, 0, 4)
    late = rows(spark, "b", 1).withColumn("close", F.lit(1).cast("long"))  # before b's last bar: nothing changes
    next_month = rows(spark, "a", 1, 40)
    late.union(next_month).coalesce(1).write.parquet(incoming)
    stream_upsert(spark.readStream.schema(late.schema).parquet(incoming), store, state, 4, keep=0).awaitTermination()
    got = sorted((r.symbol, r.ts, r.close) for r in stored_bars(spark, store).collect())
    assert got == sorted((r.symbol, r.ts, r.close) for r in rows(spark, "b", 3).union(next_month).collect())
    assert not superseded(_parts(spark, store), 1)


def test_bucketed_bars_go_into_windows_without_an_exchange(spark, tmp_path):
    bars = rows(spark, "a", 40).union(rows(spark, "b", 50)).union(rows(spark, "c", 2))
    io.write_bucketed(bars, str(tmp_path / "bars"), "bucketed_bars", 4)
    spark.sql("drop table bucketed_bars")  # another session knows the folder alone
    stored = io.open_bucketed(spark, str(tmp_path / "bars"), "bucketed_bars", 4)
    made = screen(stored, ["rise_three", "bullish_alignment", "rsi_below"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan and "Exchange" in screen(bars, ["rise_three"])._jdf.queryExecution().executedPlan().toString()
    made = screen(stored, ["rise_three"])
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, screen(bars, ["rise_three"]).collect())) and made.count() > 0


@pytest.mark.parametrize("descending", [False, True])
def test_pages_by_key(spark, descending):
    df = spark.createDataFrame([(f"s{k:02}", None if k % 7 == 0 else k * 5 % 4) for k in range(40)], "symbol string, v int")
    whole = [(r.v, r.symbol) for r in sort_results(df, "v", descending).collect()]
    seen, after = [], None
    while got := [(r.v, r.symbol) for r in page_after(df, "v", after, 7, descending).collect()]:
        assert got == [(r.v, r.symbol) for r in page(sort_results(df, "v", descending), len(seen) // 7, 7).collect()]
        seen, after = seen + got, got[-1]
    assert seen == whole
    plan = page_after(df, "v", (2, "s05"), 7)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_bars_nested_in_chunks(spark, tmp_path):
    bars = rows(spark, "a", 95).union(rows(spark, "b", 10)).union(rows(spark, "c", 3))
    chosen = spark.createDataFrame([("a", 1), ("b", 2), ("none", 3)], "symbol string, score int")
    nested = nest_chunks(chosen, bars, 10, parts=5)
    io.write_json(nested, str(tmp_path / "json"))
    back = spark.read.schema(nested.schema).json(str(tmp_path / "json"))
    sizes = {(r.symbol, r.chunk): (r.score, len(r.bars or [])) for r in back.collect()}
    assert sizes == {("a", k): (1, 10 if k < 9 else 5) for k in range(10)} | {("b", 0): (2, 10), ("none", 0): (3, 0)}
    got = {}
    for r in sorted(unnest(back).collect(), key=lambda r: (r.symbol, r.chunk, r.place)):
        got.setdefault(r.symbol, []).append(r.ts)
    assert got == {s: [r.ts for r in rows(spark, s, n).orderBy("ts").collect()] for s, n in (("a", 95), ("b", 10))}


def test_columns_of_a_caller_are_kept(spark):
    own = {c: F.lit(c) for c in ("_event", "_bar", "_held", "_last", "_n", "_i", "_pair", "_high_4", "_up", "_down", "_pattern", "_rsi", "_flag", "_highs", "factor", "_flag_0")}
    bars = rows(spark, n=40).withColumns(own)
    events = spark.createDataFrame([("a", DAY, 2.0)], "symbol string, ts timestamp, factor double")
    made = [asof(bars.drop("factor"), events, ["factor"]), adjust_prices(bars, events), tail(bars), io.upsert_tail(bars, bars), rules.rsi(bars)]
    made += [rules.with_signal(bars, r, "out") for r in ("trend_up", "limit_up_gap", "rsi_below", ["rise_three", "exchange_sh"])]
    for df in made:
        first = df.first()
        assert all(first[c] == c for c in own if c in bars.columns and not (c == "factor" and df is made[0])) and len(df.columns) == len(set(df.columns))
    assert adjust_prices(bars, events).first().close == 22


def test_names_and_equal_times(spark):
    symbols = spark.createDataFrame([("a", "z"), ("a", "b"), ("q", "q")], "symbol string, name string")
    assert {r.name for r in with_names(rows(spark), symbols).collect()} == {"b"}
    twice = rows(spark, n=2).union(rows(spark, n=2).withColumn("close", F.lit(50).cast("long")))
    assert snapshot(twice).first().price == 50 and [r.close for r in tail(twice, 1).collect()] == [50]


def test_nested_bars_as_json(spark, tmp_path):
    nested = nest_bars(spark.createDataFrame([("a",)], "symbol string"), rows(spark))
    io.write_json(nested, str(tmp_path / "json"))
    assert spark.read.schema(nested.schema).json(str(tmp_path / "json")).collect() == nested.collect()

"""Rules on hand-made bars, and against brute force over every prefix of random walks."""

from datetime import date, datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.functions.frames import FRAME
from barlab.operators import rules
from barlab.operators.pivots import trend_up, vertices
from barlab.operators.rules import all_of, bullish_alignment, limit_up_gap, rise, sma_cross, with_signal

SCHEMA = "symbol string, ts date, open long, high long, low long, close long, volume long"
START = date(2024, 1, 1)


def bars(spark, series):
    """series: {symbol: [(open, high, low, close, volume), ...]}"""
    rows = [(s, START + timedelta(k), *map(int, b)) for s, own in series.items() for k, b in enumerate(own)]
    return spark.createDataFrame(rows, SCHEMA)


def flat(closes, volume=100):
    return [(c, c, c, c, volume) for c in closes]


def flags(df):
    out = {}
    for r in df.orderBy("symbol", "ts").collect():
        out.setdefault(r.symbol, []).append(r.flag)
    return out


@pytest.fixture(scope="module")
def walks():
    rng = np.random.default_rng(1)
    series = {}
    for k in range(40):
        close = 60 + np.cumsum(rng.integers(-3, 4, 160))
        close = np.maximum(close, 3)
        if k % 3 == 0:
            jumps = rng.random(160) < 0.08
            close = np.maximum(np.cumsum(np.where(jumps, close // 5 + 8, rng.integers(-2, 3, 160))) + 60, 3)
        spread = rng.integers(0, 3, (2, 160))
        opened = np.maximum(close + rng.integers(-4, 3, 160), 1)
        series[f"s{k:02}"] = list(zip(opened, np.maximum(close, opened) + spread[0], np.maximum(np.minimum(close, opened) - spread[1], 1), close, rng.integers(50, 60, 160), strict=True))
    return series


def mean(c, n, t):
    return sum(c[t - n + 1 : t + 1]) / n if t + 1 >= n else 0


def brute_rise(b):
    c = [x[3] for x in b]
    return len(c) >= 3 and c[-1] > c[-2] > c[-3]


def brute_bullish(b):
    c = [int(x[3]) for x in b]
    t = len(c) - 1
    if len(c) < 31:
        return False
    from fractions import Fraction

    at = lambda k: [Fraction(sum(c[k - n + 1 : k + 1]), n) for n in (5, 10, 20, 30)]
    now, before = at(t), at(t - 1)
    ordered = lambda m: m[0] > m[1] > m[2] > m[3]
    return ordered(now) and not ordered(before) and all(x > y for x, y in zip(now, before, strict=True))


def brute_trend(b, w=8, least=30, gain=5):
    n = len(b)
    if n < least:
        return False
    high, low = [int(x[1]) for x in b], [int(x[2]) for x in b]
    around = lambda i: range(i - w, min(i + w, n - 1) + 1)
    spots = range(w, n - w // 2)
    hs = [i for i in spots if all(high[j] <= high[i] for j in around(i))][-2:]
    ls = [i for i in spots if all(low[j] >= low[i] for j in around(i))][-2:]
    if len(hs) < 2 or len(ls) < 2:
        return False
    (h1, h2), (l1, l2) = hs, ls
    if l1 - h1 < w or h2 - l1 < w or l2 - h2 < w:
        return False
    a, c, d, e = high[h1], high[h2], low[l1], low[l2]
    if not (e > d and c > a and d < a and e < c):
        return False
    hg, lg = (c - a) / a, (e - d) / d
    return hg <= lg * gain and lg <= hg * gain


def brute_gap(b, thr=0.098, recent=20, bull=2, vol=5):
    n = len(b)
    if n < recent:
        return False
    o, c, v = [int(x[0]) for x in b], [int(x[3]) for x in b], [int(x[4]) for x in b]
    found = any(
        c[i - 1] != 0 and (c[i] - c[i - 1]) / c[i - 1] >= thr and o[i + 1] > c[i] and all(i + 1 + j < n and c[i + 1 + j] > o[i + 1 + j] for j in range(bull))
        for i in range(max(n - recent, 1), n - 1)
    )
    past = v[max(0, n - 1 - vol) : n - 1]
    return found and bool(past) and v[-1] * len(past) > sum(past) and v[-1] > v[-2]


def brute_cross(b, fast=5, slow=20):
    c = [int(x[3]) for x in b]
    t = len(c) - 1
    above = lambda k: sum(c[k - fast + 1 : k + 1]) * slow > sum(c[k - slow + 1 : k + 1]) * fast
    return t >= slow and above(t) and not above(t - 1)


CASES = [
    ("rise", rules._from_column(rise(3)), brute_rise),
    ("bullish", rules._from_column(bullish_alignment()), brute_bullish),
    ("trend", trend_up(), brute_trend),
    ("trend_narrow", trend_up(4, 10, 3.0), lambda b: brute_trend(b, 4, 10, 3.0)),
    ("trend_odd", trend_up(5, 12, 50.0), lambda b: brute_trend(b, 5, 12, 50.0)),
    ("gap", limit_up_gap(), brute_gap),
    ("gap_one", limit_up_gap(0.05, 10, 1, 3), lambda b: brute_gap(b, 0.05, 10, 1, 3)),
    ("gap_none", limit_up_gap(0.03, 6, 0, 4), lambda b: brute_gap(b, 0.03, 6, 0, 4)),
    ("cross", rules._from_column(sma_cross()), brute_cross),
]


@pytest.mark.parametrize("name,given,brute", CASES, ids=[c[0] for c in CASES])
def test_rule_is_brute_force_over_prefixes(spark, walks, name, given, brute):
    got = flags(with_signal(bars(spark, walks), given))
    want = {s: [brute(b[: t + 1]) for t in range(len(b))] for s, b in walks.items()}
    assert got == want
    if name not in ("trend", "gap"):
        assert any(any(f) for f in want.values())


def test_vertices_are_strict_and_need_both_sides(spark, walks):
    got = {(r.symbol, r.i, r.kind, r.price) for r in vertices(bars(spark, walks), 6).collect()}
    want = set()
    for s, b in walks.items():
        for i in range(6, len(b) - 6):
            others = [j for j in range(i - 6, i + 7) if j != i]
            if all(b[i][1] > b[j][1] for j in others):
                want.add((s, i, "peak", int(b[i][1])))
            if all(b[i][2] < b[j][2] for j in others):
                want.add((s, i, "valley", int(b[i][2])))
    assert got == want and want


def test_hand_made(spark):
    series = {"short": flat([10, 11]), "tie": flat([10, 11, 11]), "yes": flat([10, 11, 12])}
    assert flags(with_signal(bars(spark, series), "rise_three")) == {"short": [False] * 2, "tie": [False] * 3, "yes": [False, False, True]}
    rising, level = flat(range(100, 130)), flat([50] * 40)
    assert not any(any(f) for f in flags(with_signal(bars(spark, {"a": rising, "b": level}), "bullish_alignment")).values())


def test_volume_and_gap_edges_are_strict(spark):
    def series(gap_open, last):
        quiet = [(100_000, 100_000, 100_000, 100_000, 100)] * 20
        return [*quiet, (100_000, 109_800, 100_000, 109_800, 100), (gap_open, 120_000, gap_open, 119_000, 100), (119_000, 121_000, 119_000, 120_000, last)]

    got = flags(with_signal(bars(spark, {"yes": series(109_801, 101), "gap": series(109_800, 101), "volume": series(109_801, 100)}), "limit_up_gap"))
    assert {s: f[-1] for s, f in got.items()} == {"yes": True, "gap": False, "volume": False}


def test_exchanges_and_groups(spark):
    codes = ["sh600000", "sh688001", "sz000001", "sz300001", "bj920000"]
    df = bars(spark, {c: flat([1, 2, 3]) for c in codes})
    on = lambda r: {s for s, f in flags(with_signal(df, r)).items() if f[-1]}
    assert on("exchange_sh") == {"sh600000", "sh688001"} and on("exchange_sz") == {"sz000001", "sz300001"} and on("exchange_bj") == {"bj920000"}
    assert on("no_buy_limit") == {"sh600000", "sz000001"} and on(["rise_three", "exchange_bj"]) == {"bj920000"}
    with pytest.raises(ValueError):
        all_of([])
    with pytest.raises(KeyError):
        with_signal(df, "no such rule")
    with pytest.raises(ValueError):
        trend_up(8, 12)


def test_registry_takes_shadows_and_drops_rules(spark):
    df = bars(spark, {"a": flat([3, 1, 2])})
    rules.rule("mine")(lambda f: F.col("close") > 1)
    assert "mine" in rules.names() and flags(with_signal(df, "mine")) == {"a": [True, False, True]}
    rules.prefix_rule("mine")(lambda symbol, p: symbol == "a" and len(p) == 2)
    assert flags(with_signal(df, "mine")) == {"a": [False, True, False]}
    rules.pandas_rule("mine")(lambda p: p["close"].diff() > 0)
    assert flags(with_signal(df, "mine")) == {"a": [False, False, True]}
    rules.remove("mine")
    assert "mine" not in rules.names()


def test_rules_share_one_exchange_and_one_sort(spark, walks):
    df = with_signal(bars(spark, walks).repartition(4), ["trend_up", "bullish_alignment", "limit_up_gap", "rise_three"])
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and plan.count("Sort [symbol") == 1


def test_a_filter_on_the_symbol_goes_below_the_windows(spark, walks, tmp_path):
    bars(spark, walks).write.parquet(str(tmp_path / "b"))
    df = with_signal(spark.read.parquet(str(tmp_path / "b")), "rise_three").where("symbol = 's01'")
    assert "EqualTo(symbol,s01)" in df._jdf.queryExecution().executedPlan().toString()


def test_index(spark):
    rows = bars(spark, {"a": flat([1, 2, 3])}).withColumn("i", FRAME.index()).orderBy("ts").collect()
    assert [r.i for r in rows] == [0, 1, 2]


# ---------------------------------------------------------------- day and minute bars, and the snapshot


def two_intervals(spark, seed=3):
    """(day bars, minute bars) of a few symbols; one without minutes, one with minutes on other days only."""
    rng = np.random.default_rng(seed)
    day, minute = [], []
    for s in "abcd":
        for k in range(25):
            if rng.random() < 0.8:
                day.append((s, datetime(2024, 1, 1) + timedelta(days=k, hours=int(rng.integers(0, 15))), *map(int, rng.integers(50, 60, 4)), int(rng.integers(1, 9)), int(rng.integers(1, 100))))
            for _ in range(int(rng.integers(0, 5)) if s != "d" else 0):
                at = datetime(2024, 1, 1) + timedelta(days=k + (100 if s == "c" else 0), seconds=int(rng.integers(0, 86400)))
                minute.append((s, at, *map(int, rng.integers(50, 60, 4)), int(rng.integers(1, 9))))
    columns = SCHEMA.replace("ts date", "ts timestamp")
    return spark.createDataFrame(day, columns + ", float_stock long"), spark.createDataFrame(minute, columns)


@pytest.fixture(scope="module")
def by_hand():
    """Registers rules of all three kinds, defined here as workers do not import this module; returns one in plain Python."""

    def plain(info, day, minute):
        """Of lists of bars: more minute bars today than the day before, the last above the day's open, and the last price even."""
        today = [m for m in minute if m.ts.date() == day[-1].ts.date()]
        before = [m for m in minute if m.ts.date() == (day[-1].ts - timedelta(days=1)).date()]
        return len(today) > len(before) and today[-1].close >= day[-1].open and info.price % 2 == 0 and info.float_value == info.float_stock * info.price and info.name == "n" + info.code

    @rules.prefix_rule("busy_by_prefix", full=True)
    def _busy_by_prefix(info, day, minute):
        rows = lambda pdf: list(pdf.itertuples(index=False))
        return plain(SimpleNamespace(**info), rows(day), rows(minute))

    @rules.pandas_rule("busy", full=True)
    def _busy(info, day, minute):
        at = minute["ts"].dt.normalize()
        count = at.value_counts()
        of = lambda days: days.map(count).fillna(0)
        today = day["ts"].dt.normalize()
        last = minute.groupby(at)["close"].last()
        fits = info["price"] % 2 == 0 and info["float_stock"] is not None and info["float_value"] == info["float_stock"] * info["price"] and info["name"] == "n" + info["code"]
        return (of(today) > of(today - timedelta(days=1))) & (today.map(last) >= day["open"]) & fits

    @rules.rule("quiet", info=True, minutes=lambda: {"n": F.count("*"), "last": F.max_by("close", "ts")})
    def _quiet(f):
        return (F.coalesce(F.col("minute.n"), F.lit(0)) < 2) & (f.lag("close") < F.col("close")) & (F.coalesce("info.name", F.lit("")) != "na")

    yield plain
    for name in ("busy_by_prefix", "busy", "quiet"):
        rules.remove(name)


def brute_signals(day, minute, fn):
    out = {}
    for s in {d.symbol for d in day}:
        own = sorted((d for d in day if d.symbol == s), key=lambda d: d.ts)
        mine = sorted((m for m in minute if m.symbol == s), key=lambda m: m.ts)
        last = own[-1]
        info = SimpleNamespace(code=s, name="n" + s, price=last.close, float_stock=last.float_stock, float_value=last.float_stock * last.close)
        out[s] = [bool(fn(info, own[: k + 1], [m for m in mine if m.ts.date() <= d.ts.date()])) for k, d in enumerate(own)]
    return out


def test_rules_over_info_day_and_minute_equal_brute_force(spark, by_hand):
    for seed in (3, 4):
        day, minute = two_intervals(spark, seed)
        names = spark.createDataFrame([(s, "n" + s) for s in "abcdx"], "symbol string, name string")
        feeds = rules.Feeds(minute, names)
        want = brute_signals(day.collect(), minute.collect(), by_hand)
        for name in ("busy_by_prefix", "busy"):
            got = with_signal(day, name, feeds=feeds)
            assert got.columns == [*day.columns, "flag"] and flags(got) == want
        quiet = brute_signals(day.collect(), minute.collect(), lambda i, d, m: sum(x.ts.date() == d[-1].ts.date() for x in m) < 2 and len(d) > 1 and d[-2].close < d[-1].close and i.name != "na")
        assert flags(with_signal(day, "quiet", feeds=feeds)) == quiet and any(map(any, quiet.values()))
        both = flags(with_signal(day, ["quiet", "busy"], feeds=feeds))
        assert both == {s: [a and b for a, b in zip(quiet[s], want[s], strict=True)] for s in want}


def test_minutes_after_the_day_are_not_seen(spark):
    day, minute = two_intervals(spark)
    seen = []

    @rules.prefix_rule("only_seen", full=True)
    def _only_seen(info, d, m):
        return m.empty or m["ts"].max().date() <= d["ts"].iloc[-1].date()

    got = flags(with_signal(day, "only_seen", feeds=rules.Feeds(minute)))
    rules.remove("only_seen")
    assert all(all(x) for x in got.values()) and not seen


def test_rules_of_feeds_without_feeds(spark, by_hand):
    day, _ = two_intervals(spark)
    assert not any(any(x) for x in flags(with_signal(day, "busy")).values())
    assert flags(with_signal(day, ["busy", "rise_three"])).keys() == flags(with_signal(day, "quiet")).keys()
    with pytest.raises(ValueError, match="info or minute"):
        with_signal(day.withColumn("Info", F.lit(1)), "quiet")
    assert with_signal(day.limit(0), "busy").count() == 0

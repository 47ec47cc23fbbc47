"""Queries of the bar operators over the given tables, each with its DuckDB equivalent where there is one."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.functions import columns as C
from barlab.functions.frames import FRAME
from barlab.operators import asof as H
from barlab.operators import bars as A
from barlab.operators import indicators as E
from barlab.operators import metrics as M
from barlab.operators import rules as D
from barlab.operators import screen as G
from barlab.operators import slices
from barlab.operators.backtest import backtest_hold, backtest_ledger, backtest_symbol, run_backtest
from barlab.operators.backtest import trades as ledger_trades
from barlab.operators.grid import sma_grid
from barlab.operators.pivots import vertices
from barlab.operators.streams import Prefix
from barlab.plans import register
from barlab.plans.adapter import BARS, CAPITAL, TICKS, capital, factors, names, prints, table, weekly_bars
from barlab.sources import io
from barlab.streaming.bars import stored_bars, stream_bars, stream_upsert, write_version


def _with(*tables: str, select: str) -> str:
    return f"with recursive {','.join(tables)}\n{select}"


def _scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one."""
    return f"{io.shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


# ---------------------------------------------------------------- sources and sinks

OHLCV = ("symbol", "ts", "open", "high", "low", "close", "volume")


@register("bars_weekly", _with(BARS, select="select symbol, ts, open, high, low, close, volume from bars"))
def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_bars(spark, sf_dir).select(*OHLCV)


@register(
    "bars_hourly",
    _with(TICKS, select="select symbol, date_trunc('hour', ts) as ts, arg_min(price, row(ts, event_id, price)) as open, max(price) as high, min(price) as low, arg_max(price, row(ts, event_id, price)) as close, count(*) as volume from ticks group by symbol, date_trunc('hour', ts)"),
)
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bars_from_ticks(prints(spark, sf_dir), "1 hour", ("event_id",)).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *OHLCV[2:])


def _resampled(freq: str) -> None:
    sql = _with(BARS, select=f"select symbol, cast(date_trunc('{freq}', ts) as date) as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, cast(sum(volume) as bigint) as volume from bars group by symbol, date_trunc('{freq}', ts)")

    @register(f"resample_{freq}", sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return A.resample(weekly_bars(spark, sf_dir), freq).withColumn("ts", F.col("ts").cast("date")).select(*OHLCV)


for _freq in ("month", "quarter", "year"):
    _resampled(_freq)


def _from_minutes(name: str, freq: str, bucket: str) -> None:
    """Bars of ``freq`` from minute bars."""
    minutes = "minutes as (select symbol, date_trunc('minute', ts) as ts, arg_min(price, row(ts, event_id, price)) as open, max(price) as high, min(price) as low, arg_max(price, row(ts, event_id, price)) as close, count(*) as volume from ticks group by symbol, date_trunc('minute', ts))"
    coarse = f"coarse as (select symbol, {bucket} as begins, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, cast(sum(volume) as bigint) as volume from minutes group by symbol, {bucket})"

    @register(f"resample_{name}", _with(TICKS, minutes, coarse, select="select symbol, cast(begins as timestamp) as ts, open, high, low, close, volume from coarse"))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        minute = A.bars_from_ticks(prints(spark, sf_dir), "minute", ("event_id",))
        return A.resample(minute, freq).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *OHLCV[2:])


for _n in (5, 15, 30, 60):
    _from_minutes(f"{_n}_minutes", f"{_n} minutes", f"time_bucket(interval '{_n} minutes', ts)")
_from_minutes("day", "day", "date_trunc('day', ts)")


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Weekly bars as day bars and hourly ones as minute bars of one bar table, in a new folder."""
    folder = _scratch(spark, "bars")
    weekly = weekly_bars(spark, sf_dir).select("symbol", F.col("ts").cast("timestamp").alias("ts"), *OHLCV[2:])
    hourly = A.bars_from_ticks(prints(spark, sf_dir), "1 hour", ("event_id",)).select(*OHLCV)
    io.write_bars(weekly, folder, "day")
    io.write_bars(hourly, folder, "minute")
    return folder


@register("scan_market", _with(BARS, select="select symbol, ts, open, high, low, close, volume from bars where ts > date '1995-01-02' and ts < date '1997-12-29'"))
def scan_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io.scan_market(spark, _stored(spark, sf_dir), "1995-01-02", "1997-12-29")
    return rows.withColumn("ts", F.col("ts").cast("date")).select(*OHLCV)


@register("read_bars", _with(BARS, select="select symbol, ts, open, high, low, close, volume from bars where symbol = (select min(symbol) from bars) and ts > date '1995-01-02'"))
def read_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stored(spark, sf_dir)
    first = io.scan_market(spark, folder).agg(F.min("symbol")).first()[0]
    return io.read_bars(spark, folder, first, start="1995-01-02").withColumn("ts", F.col("ts").cast("date")).select(*OHLCV)


@register(
    "read_minute_bars",
    _with(TICKS, select="select symbol, date_trunc('hour', ts) as ts, arg_min(price, row(ts, event_id, price)) as open, max(price) as high, min(price) as low, arg_max(price, row(ts, event_id, price)) as close, count(*) as volume from ticks where symbol = '1' and date_trunc('hour', ts) > timestamp '2024-01-02' group by symbol, date_trunc('hour', ts)"),
)
def read_minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = io.read_minute_bars(spark, _stored(spark, sf_dir), "1", start="2024-01-02")
    return rows.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *OHLCV[2:])


@register("universe", _with(BARS, select="select distinct symbol, name from names"))
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.universe(names(spark, sf_dir))


@register(
    "needs_refresh",
    "with m as (select user_id as key, cast(max(floor(epoch_us(ts) / 1000000 + 0.5)) as bigint) as time from events group by 1), w as (select distinct c_custkey as key from customer) "
    "select key, coalesce(time, 0) as updated from w left join m using (key) where coalesce(time, 0) < epoch(timestamp '2024-01-29 15:00:00')",
)
def needs_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.floor(F.unix_micros(F.max("ts").cast("timestamp")) / 1e6 + 0.5).alias("time"))
    return io.needs_refresh(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), markers, "2024-01-30 14:30:00")


@register(
    "upsert_tail",
    _with(
        BARS,
        "old as (select * from bars where ts <= date '1996-06-03'), new as (select symbol, ts, open, high, low, close + 1 as close, volume from bars where ts >= date '1996-05-06' or symbol like 'bj%')",
        "l as (select symbol, max(ts) as last from old group by symbol)",
        select="select o.symbol, ts, open, high, low, close, volume from old o join l on o.symbol = l.symbol where ts < last union all select n.symbol, ts, open, high, low, close, volume from new n left join l on n.symbol = l.symbol where last is null or ts >= last",
    ),
)
def upsert_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = weekly_bars(spark, sf_dir)
    old = bars.where(F.col("ts") <= F.lit("1996-06-03").cast("date")).select(*OHLCV)
    new = bars.where((F.col("ts") >= F.lit("1996-05-06").cast("date")) | F.col("symbol").startswith("bj")).withColumn("close", F.col("close") + 1)
    return io.upsert_tail(old, new.select(*OHLCV))


_EXPORT_SQL = "select symbol as code, min(name) as name, arg_max(close, ts) / 1000.0::double as price, 0 as score, arg_max(volume, ts) / 1000.0::double as turnover, cast(arg_max(close, ts) * arg_max(volume, ts) as bigint) as float_value, 0 as signal from bars left join names using (symbol) group by symbol"


@register("export_csv", _with(BARS, select=_EXPORT_SQL))
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = weekly_bars(spark, sf_dir).withColumns({"turnover": F.col("volume") / 1000.0, "float_stock": F.col("volume")})
    rows = G.with_names(G.snapshot(bars), names(spark, sf_dir)).withColumns({"code": F.col("symbol"), "price": C.currency("price"), "score": F.lit(0), "signal": F.lit(0)})
    folder = _scratch(spark, "export")
    io.write_csv(rows, folder)
    return spark.read.schema(rows.select(*io.EXPORT).schema).option("header", True).csv(folder)


@register("export_json", _with(BARS, select="select symbol, ts, open, high, low, close, volume from bars"))
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested bars of all symbols as lines of JSON, read back and unnested."""
    bars = weekly_bars(spark, sf_dir)
    nested = A.nest_bars(bars.select("symbol").distinct(), bars)
    folder = _scratch(spark, "json")
    io.write_json(nested, folder)
    return spark.read.schema(nested.schema).json(folder).select("symbol", F.inline("bars")).select(*OHLCV)


_TICK_BARS = "tb as (select symbol, date_trunc('minute', ts) as ts, arg_min(price, row(ts, event_id, price)) as open, max(price) as high, min(price) as low, arg_max(price, row(ts, event_id, price)) as close, count(*) as volume from ticks group by symbol, date_trunc('minute', ts))"


@register("nest_chunks", _with(TICKS, _TICK_BARS, select="select symbol, (row_number() over (partition by symbol order by ts) - 1) // 10 as chunk, cast((row_number() over (partition by symbol order by ts) - 1) % 10 as integer) as place, ts, open, high, low, close, volume from tb"))
def nest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars in chunks of ten as lines of JSON, read back in order."""
    bars = A.bars_from_ticks(prints(spark, sf_dir), "minute", ("event_id",))
    nested = A.nest_chunks(bars.select("symbol").distinct(), bars, 10)
    folder = _scratch(spark, "json")
    io.write_json(nested, folder)
    return A.unnest(spark.read.schema(nested.schema).json(folder)).withColumn("ts", F.col("ts").cast("timestamp_ntz")).select("symbol", "chunk", "place", *OHLCV[1:])


@register(
    "nest_bars",
    _with(BARS, "g as (select symbol from bars group by symbol having arg_max(close > open, ts))", select="select symbol, cast(count(*) as integer) as bars, arg_min(close, ts) as first_close, arg_max(close, ts) as last_close, string_agg(close::varchar, ',' order by ts) as closes from bars join g using (symbol) group by symbol"),
)
def nest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = weekly_bars(spark, sf_dir)
    D_up = D.with_signal(bars, lambda b, f, out: b.withColumn(out, F.col("close") > F.col("open")))
    chosen = D_up.groupBy("symbol").agg(F.max_by("flag", "ts").alias("flag")).where("flag").select("symbol")
    nested = A.nest_bars(chosen, bars)
    return nested.select("symbol", F.size("bars").alias("bars"), F.col("bars")[0]["close"].alias("first_close"), F.element_at("bars", -1)["close"].alias("last_close"), F.array_join(F.transform("bars", lambda b: b["close"].cast("string")), ",").alias("closes"))


# ---------------------------------------------------------------- columns


@register(
    "columns",
    _with(
        BARS,
        select="""select symbol, ts, open / 1000.0::double as open, close / 1000.0::double as close,
  case when close >= open then 'up' else 'down' end as direction, strftime(ts, '%y-%m-%d') as label,
  case when volume is null then 0.0::double when volume / 1000.0::double <= 1 then volume / 1000.0::double * 100 else volume / 1000.0::double end as turnover,
  case when close > open then 'buy' when close < open then 'sell' else 'hold' end as side,
  case when close * volume >= 100000000 then round((close * volume / 100000000.0::double)::varchar::decimal(30, 12), 2)::decimal(30, 2)::varchar || '亿'
    when close * volume >= 10000 then round((close * volume / 10000.0::double)::varchar::decimal(30, 12), 2)::decimal(30, 2)::varchar || '万' else (close * volume)::decimal(30, 2)::varchar end as amount from bars""",
    ),
)
def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = weekly_bars(spark, sf_dir)
    side = C.signal_label(F.signum(F.col("close") - F.col("open")))
    return bars.select("symbol", "ts", C.currency("open").alias("open"), C.currency("close").alias("close"), C.bar_direction().alias("direction"), C.date_label().alias("label"), C.turnover_pct(F.col("volume") / 1000.0).alias("turnover"), side.alias("side"), C.format_units(F.col("close") * F.col("volume")).alias("amount"))


@register("scale_prices", _with(BARS, select="select symbol, ts, open / 1000.0::double as open, high / 1000.0::double as high, low / 1000.0::double as low, close / 1000.0::double as close from bars"))
def scale_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scale_prices(weekly_bars(spark, sf_dir)).select("symbol", "ts", *C.PRICES)


@register("price_rescale", "with t as (select *, max(greatest(open, close)) over (partition by symbol) > 1000 as big from (select user_id as symbol, event_id, value as open, value * (1 + user_id % 5) as close from events)) select symbol, event_id, case when big then close / 1000.0::double else close end as close from t")
def price_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("event_id"), F.col("event_id").alias("ts"), F.col("value").alias("open"), (F.col("value") * (1 + F.col("user_id") % 5)).alias("close"))
    return C.price_rescale(e, columns=("open", "close")).select("symbol", "event_id", "close")


@register("normalize_time", "select event_id, make_timestamp((case when event_id % 2 = 0 then epoch_us(ts) // 1000 * 1000 else epoch_us(ts) // 1000000 * 1000000 end)::bigint) as at from events")
def normalize_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    given = F.when(F.col("event_id") % 2 == 0, ms).otherwise(F.floor(ms / 1000))
    return table(spark, sf_dir, "events").select("event_id", C.normalize_time(given).cast("timestamp_ntz").alias("at"))


@register("with_defaults", "select o_orderkey, case when o_totalprice - 100000 > 0 then o_totalprice - 100000 else 100000 end as cash, case when o_custkey % 3 > 0 then o_custkey % 3 else 1 end as size, case when o_totalprice - 150000 > 0 then o_totalprice - 150000 else 0.0005 end as fee_rate, 5.0::double as min_fee from orders")
def with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    params = o.select("o_orderkey", (F.col("o_totalprice") - 100000).alias("cash"), (F.col("o_custkey") % 3).alias("size"), (F.col("o_totalprice") - 150000).alias("fee_rate"), F.lit(None).cast("double").alias("min_fee"))
    return C.with_defaults(params)


@register("snapshot", _with(BARS, CAPITAL, select="select symbol, max(ts) as ts, arg_max(close, ts) as price, arg_max(volume, ts) as float_stock, cast(arg_max(close, ts) * arg_max(volume, ts) as bigint) as float_value from bars group by symbol"))
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = weekly_bars(spark, sf_dir).withColumn("float_stock", F.col("volume"))
    return G.snapshot(bars).select("symbol", "ts", "price", "float_stock", "float_value")


# ---------------------------------------------------------------- predicates


def _filtered(name: str, condition, sql: str) -> None:
    @register(name, _with(BARS, select=f"select symbol, ts, close from bars left join names using (symbol) where {sql}"))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = G.with_names(weekly_bars(spark, sf_dir), names(spark, sf_dir))
        return bars.where(condition()).select("symbol", "ts", "close")


_filtered("filter_sh", lambda: C.on_exchange("sh"), "symbol like 'sh%'")
_filtered("filter_sz", lambda: C.on_exchange("sz"), "symbol like 'sz%'")
_filtered("filter_bj", lambda: C.on_exchange("bj"), "symbol like 'bj%'")
_filtered("filter_no_buy_limit", C.no_buy_limit, "symbol like 'sh60%' or symbol like 'sz0%'")
_filtered("filter_search", lambda: C.search_symbols("R#000000001"), "lower(symbol) like '%r#000000001%' or lower(name || '-' || symbol) like '%r#000000001%'")
_filtered("filter_time_range", lambda: C.time_range("1998-01-05", "1999-01-04"), "ts > date '1998-01-05' and ts < date '1999-01-04'")


@register("filter_in_codes", _with(BARS, select="select symbol, ts, close from bars where symbol in (select symbol from names where name like '%1%')"))
def filter_in_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = names(spark, sf_dir).where(F.col("name").contains("1")).select("symbol")
    return C.in_codes(weekly_bars(spark, sf_dir), codes).select("symbol", "ts", "close")


@register("filter_min_history", _with(BARS, select="select symbol, ts, i from bars where i >= 199"))
def filter_min_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_bars(spark, sf_dir).withColumns({"i": FRAME.index(), "old": C.min_history(200)}).where("old").select("symbol", "ts", "i")


# ---------------------------------------------------------------- rules

#: Sum of the last n closes that end ``back`` bars ago.
_W = "partition by symbol order by ts"
_S = lambda n, back=0: f"sum(close) over ({_W} rows between {n - 1 + back} preceding and {back} preceding)" if back else f"sum(close) over ({_W} rows between {n - 1} preceding and current row)"
_LAG = lambda c, n=1: f"lag({c}, {n}) over ({_W})"

RISE = f"coalesce(close > {_LAG('close')} and {_LAG('close')} > {_LAG('close', 2)}, false)"
BULL_TABLES = f"""bs as (select *, {_S(5)} s5, {_S(10)} s10, {_S(20)} s20, {_S(30)} s30 from bars),
bo as (select *, 2 * s5 > s10 and 2 * s10 > s20 and 3 * s20 > 2 * s30 as o from bs),
bull as (select *, i >= 30 and o and not lag(o) over w and s5 > lag(s5) over w and s10 > lag(s10) over w and s20 > lag(s20) over w and s30 > lag(s30) over w as flag from bo window w as ({_W}))"""
MACD_TABLES = f"""em as (select symbol, ts, i, close::double as fast, close::double as slow, 0::double as dea from bars where i = 0
  union all select b.symbol, b.ts, b.i, em.fast * (11 / 13::double) + b.close * (2 / 13::double), em.slow * (25 / 27::double) + b.close * (2 / 27::double),
    em.dea * 0.8::double + (em.fast * (11 / 13::double) + b.close * (2 / 13::double) - (em.slow * (25 / 27::double) + b.close * (2 / 27::double))) * 0.2::double
  from em join bars b on b.symbol = em.symbol and b.i = em.i + 1),
mc as (select *, fast - slow > dea and not coalesce(lag(fast - slow > dea) over ({_W}), true) as flag from em)"""
RSI_TABLES = f"""d as (select *, close - {_LAG('close')} as step from bars),
u as (select symbol, ts, i, sum(greatest(step, 0)) over w as up, sum(greatest(-step, 0)) over w as down from d window w as ({_W} rows between 13 preceding and current row))"""
CROSS_TABLES = f"""cs as (select *, {_S(5)} s5, {_S(20)} s20 from bars),
cx as (select *, coalesce(i >= 20 and 4 * s5 > s20 and not 4 * lag(s5) over ({_W}) > lag(s20) over ({_W}), false) as flag from cs)"""
#: Pivots by definition: each bar against its neighbours, then what each later bar knows of them.
TREND_TABLES = """pv as (select a.symbol, a.i, a.high, a.low,
  max(case when b.high > a.high then b.i end) filter (where b.i < a.i) as high_left, min(case when b.high > a.high then b.i end) filter (where b.i > a.i) as high_right,
  max(case when b.low < a.low then b.i end) filter (where b.i < a.i) as low_left, min(case when b.low < a.low then b.i end) filter (where b.i > a.i) as low_right
  from bars a join bars b on a.symbol = b.symbol and b.i between a.i - 8 and a.i + 8 where a.i >= 8 group by a.symbol, a.i, a.high, a.low),
hk as (select symbol, i, high as v, coalesce(high_right, 1000000000) - 1 as until from pv where high_left is null),
lk as (select symbol, i, low as v, coalesce(low_right, 1000000000) - 1 as until from pv where low_left is null),
ht as (select t.symbol, t.i as t, k.i, k.v, row_number() over (partition by t.symbol, t.i order by k.i desc) as n from bars t join hk k on t.symbol = k.symbol and k.i <= t.i - 4 and (k.until >= k.i + 8 or k.until >= t.i)),
lt as (select t.symbol, t.i as t, k.i, k.v, row_number() over (partition by t.symbol, t.i order by k.i desc) as n from bars t join lk k on t.symbol = k.symbol and k.i <= t.i - 4 and (k.until >= k.i + 8 or k.until >= t.i)),
h2 as (select symbol, t, max(i) filter (where n = 1) as ib, max(v) filter (where n = 1) as vb, max(i) filter (where n = 2) as ia, max(v) filter (where n = 2) as va from ht where n <= 2 group by symbol, t),
l2 as (select symbol, t, max(i) filter (where n = 1) as ib, max(v) filter (where n = 1) as vb, max(i) filter (where n = 2) as ia, max(v) filter (where n = 2) as va from lt where n <= 2 group by symbol, t),
tr as (select h.symbol, h.t as i from h2 h join l2 l on h.symbol = l.symbol and h.t = l.t where h.t >= 29 and l.ia - h.ia >= 8 and h.ib - l.ia >= 8 and l.ib - h.ib >= 8
  and l.vb > l.va and h.vb > h.va and l.va < h.va and l.vb < h.vb and h.va <> 0 and l.va <> 0
  and (h.vb - h.va)::double / h.va <= (l.vb - l.va)::double / l.va * 5 and (l.vb - l.va)::double / l.va <= (h.vb - h.va)::double / h.va * 5)"""
GAP_TABLES = f"""gp as (select symbol, i, {_LAG('close')} as before, close, lead(open) over ({_W}) as o1, lead(close) over ({_W}) as c1, lead(open, 2) over ({_W}) as o2, lead(close, 2) over ({_W}) as c2 from bars),
gu as (select symbol, i from gp where before <> 0 and (close - before)::double / before >= 0.098 and o1 > close and c1 > o1 and c2 > o2),
gv as (select symbol, ts, i, volume, avg(volume) over ({_W} rows between 5 preceding and 1 preceding) as mean, {_LAG('volume')} as yesterday from bars),
gap as (select distinct v.symbol, v.ts, v.i from gv v join gu u on u.symbol = v.symbol and u.i between greatest(v.i - 19, 1) and v.i - 2 where v.i >= 19 and v.volume > v.mean and v.volume > v.yesterday)"""


def _signals(name: str, given, sql: str) -> None:
    @register(name, sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = weekly_bars(spark, sf_dir).withColumn("i", FRAME.index())
        return D.with_signal(bars, given).where("flag").select("symbol", "ts", "i")


_signals("rule_rise_three", "rise_three", _with(BARS, f"r as (select *, {RISE} as flag from bars)", select="select symbol, ts, i from r where flag"))
_signals("rule_bullish", "bullish_alignment", _with(BARS, BULL_TABLES, select="select symbol, ts, i from bull where flag"))
_signals("rule_sma_cross", "sma_cross", _with(BARS, CROSS_TABLES, select="select symbol, ts, i from cx where flag"))
_signals("rule_trend_up", "trend_up", _with(BARS, TREND_TABLES, select="select b.symbol, b.ts, b.i from bars b join tr on b.symbol = tr.symbol and b.i = tr.i"))
_signals("rule_limit_up_gap", "limit_up_gap", _with(BARS, GAP_TABLES, select="select symbol, ts, i from gap"))
_signals("rule_all_of", ["rise_three", "exchange_sz"], _with(BARS, f"r as (select *, {RISE} as flag from bars)", select="select symbol, ts, i from r where flag and symbol like 'sz%'"))
_signals("rule_macd_cross", "macd_cross", _with(BARS, MACD_TABLES, select="select symbol, ts, i from mc where flag"))
_signals("rule_rsi_below", "rsi_below", _with(BARS, RSI_TABLES, select="select symbol, ts, i from u where i >= 14 and up + down > 0 and 100.0::double * up / (up + down) < 30"))


@register("ma", _with(BARS, select=f"select symbol, ts, round(case when i >= 9 then {_S(10)} / 10 else 0 end, 6) as ma10, round(case when i >= 29 then {_S(30)} / 30 else 0 end, 6) as ma30 from bars"))
def ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_bars(spark, sf_dir).withColumns({"ma10": D.ma(10), "ma30": D.ma(30)}).select("symbol", "ts", *_r("ma10", "ma30"))


@register("signal_series", _with(BARS, BULL_TABLES, select="select symbol, ts, coalesce(flag, false)::integer as signal from bull"))
def signal_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.signal_series(weekly_bars(spark, sf_dir), "bullish_alignment").select("symbol", "ts", "signal")


@register(
    "rsi",
    _with(
        BARS,
        RSI_TABLES,
        select="select symbol, ts, round(100.0::double * up / (up + down), 6) as rsi from u where i >= 14 and up + down > 0",
    ),
)
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rsi(weekly_bars(spark, sf_dir)).where("rsi is not null").select("symbol", "ts", *_r("rsi"))


_SCREEN = "l as (select symbol, arg_max(flag, ts) as flag, max(ts) as ts, arg_max(close, ts) as price from r group by symbol)"


@register("screen", _with(BARS, f"r as (select *, {RISE} as flag from bars), {_SCREEN}", select="select symbol, name, ts, price, 0 as score, 0 as signal from l left join names using (symbol) where flag"))
def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.screen(weekly_bars(spark, sf_dir), ["rise_three"])
    return G.with_names(found, names(spark, sf_dir)).select("symbol", "name", "ts", "price", "score", "signal")


@register("screen_stored", _with(BARS, f"r as (select *, {RISE} as flag from bars), {_SCREEN}", select="select symbol, ts, price from l where flag"))
def screen_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market screened on bars stored in buckets of symbols, as they lie."""
    folder = _scratch(spark, "bucketed")
    name = f"bars_{uuid.uuid4().hex}"
    io.write_bucketed(weekly_bars(spark, sf_dir).select(*OHLCV), folder, name, 8)
    return G.screen(io.open_bucketed(spark, folder, name, 8), ["rise_three"]).select("symbol", "ts", "price")


@register("rule_bullish_slices", _with(BARS, BULL_TABLES, select="select symbol, ts from bull where flag"))
def rule_bullish_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule in slices of 100 bars, which end within symbols."""
    return slices.with_signal(weekly_bars(spark, sf_dir), "bullish_alignment", rows=100).where("flag").select("symbol", "ts")


@D.rule("volume_surge")
def _volume_surge(f):
    """A rule as users add them: volume of at least twice the bar before."""
    return F.col("volume") >= 2 * f.lag("volume")


@D.pandas_rule("ewm_above")
def _ewm_above(pdf: pd.DataFrame) -> pd.Series:
    """A recurrence as users add them: the close is above its running mean of weights 1/2, 1/4, ..."""
    return pdf["close"] > pdf["close"].ewm(alpha=0.5, adjust=False).mean()


@D.prefix_rule("rise_by_prefix", arrays=True)
def _rise_by_prefix(symbol: str, prefix: Prefix) -> bool:
    c = prefix["close"]
    return len(c) >= 3 and c[-1] > c[-2] > c[-3]


_signals("user_rule", "volume_surge", _with(BARS, select=f"select symbol, ts, i from (select *, volume >= 2 * {_LAG('volume')} as flag from bars) where flag"))
_signals(
    "user_pandas_rule",
    "ewm_above",
    _with(BARS, "ew as (select symbol, ts, i, close, close::double as m from bars where i = 0 union all select b.symbol, b.ts, b.i, b.close, 0.5::double * b.close + 0.5::double * ew.m from ew join bars b on b.symbol = ew.symbol and b.i = ew.i + 1)", select="select symbol, ts, i from ew where close > m"),
)
_signals("user_prefix_rule", "rise_by_prefix", _with(BARS, f"r as (select *, {RISE} as flag from bars)", select="select symbol, ts, i from r where flag"))


@D.rule("above_morning", info=True, minutes=lambda: {"morning": F.max(F.when(F.hour("ts") < 12, F.col("high"))), "prints": F.sum("volume")})
def _above_morning(f):
    """A rule that reads the day's minute bars and the snapshot: above the morning's high on two prints or more, and below the last price."""
    return (F.col("close") > F.col("minute.morning")) & (F.col("minute.prints") >= 2) & (F.col("close") < F.col("info.price"))


@D.pandas_rule("above_minutes", full=True, arrays=True)
def _above_minutes(info: dict, day: Prefix, minute: Prefix) -> np.ndarray:
    """The day's close is above the mean of the last five minute bars, and the last price above the first open."""
    seen, closes = day["minutes_seen"], minute["close"]
    if len(closes) < 5:
        return np.zeros(len(day), bool)
    sums = np.convolve(closes, np.ones(5, closes.dtype))
    return (seen >= 5) & (5 * day["close"] > sums[seen - 1]) & (info["price"] > day["open"][0])


@D.prefix_rule("above_minutes_by_prefix", full=True, arrays=True)
def _above_minutes_by_prefix(info: dict, day: Prefix, minute: Prefix) -> bool:
    return len(minute) >= 5 and 5 * day["close"][-1] > minute["close"][-5:].sum() and info["price"] > day["open"][0]


#: Tables ``minutes`` and ``days`` of the same symbols; ``dm`` adds what rules read of both.
TWO_INTERVALS = """minutes as (select symbol, date_trunc('minute', ts) as ts, arg_min(price, row(ts, event_id, price)) as open, max(price) as high, min(price) as low, arg_max(price, row(ts, event_id, price)) as close, count(*) as volume from ticks group by symbol, date_trunc('minute', ts)),
m5 as (select *, case when count(*) over w = 5 then sum(close) over w end as five from minutes window w as (partition by symbol order by ts rows between 4 preceding and current row)),
days as (select symbol, date_trunc('day', ts)::timestamp as ts, arg_min(open, ts) as open, max(high) as high, min(low) as low, arg_max(close, ts) as close, cast(sum(volume) as bigint) as volume,
  max(high) filter (where hour(ts) < 12) as morning, arg_max_null(five, ts) as five from m5 group by symbol, date_trunc('day', m5.ts)),
dm as (select *, arg_max(close, ts) over (partition by symbol) as price, first(open) over (partition by symbol order by ts) as first_open, row_number() over (partition by symbol order by ts) - 1 as i from days),
ab as (select *, coalesce(close > morning and volume >= 2 and close < price, false) as above_morning, coalesce(5 * close > five and price > first_open, false) as above_minutes from dm)"""


def _two_intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    minute = A.bars_from_ticks(prints(spark, sf_dir), "minute", ("event_id",)).select(*OHLCV)
    return A.resample(minute, "day").select(*OHLCV), minute


def _two_interval_signals(name: str, given: str, flag: str) -> None:
    @register(name, _with(TICKS, TWO_INTERVALS, select=f"select symbol, ts::date as ts, close from ab where {flag}"))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        day, minute = _two_intervals(spark, sf_dir)
        rows = D.with_signal(day, given, feeds=D.Feeds(minute)).where("flag")
        return rows.select("symbol", F.col("ts").cast("date").alias("ts"), "close")


_two_interval_signals("user_minute_rule", "above_morning", "above_morning")
_two_interval_signals("user_minute_pandas_rule", "above_minutes", "above_minutes")
_two_interval_signals("user_minute_prefix_rule", "above_minutes_by_prefix", "above_minutes")


@register("screen_minutes", _with(TICKS, TWO_INTERVALS, select="select symbol, ts::date as ts, close as price from ab where above_minutes and i = (select max(i) from ab o where o.symbol = ab.symbol)"))
def screen_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market screened on day and minute bars."""
    day, minute = _two_intervals(spark, sf_dir)
    return G.screen(day, ["above_minutes"], feeds=D.Feeds(minute)).select("symbol", F.col("ts").cast("date").alias("ts"), "price")


# ---------------------------------------------------------------- indicators


@register("sma", _with(BARS, select="select symbol, ts, " + ", ".join(f"round(case when i >= {n - 1} then {_S(n)} / {n} end, 6) as sma{n}" for n in (5, 10, 20, 30)) + " from bars"))
def sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.with_smas(weekly_bars(spark, sf_dir)).select("symbol", "ts", *_r("sma5", "sma10", "sma20", "sma30"))


@register("bollinger", _with(BARS, f"m as (select symbol, ts, i, avg(close) over w as mid, stddev_pop(close) over w as sd from bars window w as ({_W} rows between 19 preceding and current row))", select="select symbol, ts, round(mid, 4) as mid, round(mid + 2 * sd, 4) as up, round(mid - 2 * sd, 4) as low_band from m where i >= 19"))
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = E.bollinger(weekly_bars(spark, sf_dir)).where("mid is not null")
    return bands.select("symbol", "ts", *[F.round(c, 4).alias(c) for c in ("mid", "up", "low_band")])


def _vertices(window: int) -> None:
    sql = _with(
        BARS,
        f"v as (select a.symbol, a.ts, a.i, a.high, a.low, max(b.high) as h, min(b.low) as l, count(*) as n from bars a join bars b on a.symbol = b.symbol and b.i between a.i - {window} and a.i + {window} and b.i <> a.i group by a.symbol, a.ts, a.i, a.high, a.low)",
        select=f"select symbol, ts, i, 'peak' as kind, high as price from v where n = {2 * window} and high > h union all select symbol, ts, i, 'valley', low from v where n = {2 * window} and low < l",
    )

    @register(f"vertices_{window}", sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vertices(weekly_bars(spark, sf_dir), window)


for _window in (6, 8, 10):
    _vertices(_window)


@register("cum_return", _with(BARS, select=f"select symbol, ts, round((close / first(close) over ({_W} rows between unbounded preceding and current row) - 1) * 100, 6) as benchmark from bars"))
def cum_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_bars(spark, sf_dir).select("symbol", "ts", F.round(E.benchmark_pct(), 6).alias("benchmark"))


@register("annotate_signals", _with(BARS, f"r as (select *, {RISE} as flag from bars)", select="select symbol, ts, low as at_value from r where flag"))
def annotate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.annotate_signals(D.signal_series(weekly_bars(spark, sf_dir), "rise_three"))


@register(
    "excess_return",
    _with(
        BARS,
        "x as (select ts, cast(sum(close) as bigint) as close from bars group by ts), xi as (select ts, (close / first(close) over (order by ts) - 1) * 100 as index_return from x)",
        f"own as (select symbol, ts, (close / first(close) over ({_W}) - 1) * 100 as own_return from bars)",
        select="select symbol, ts, round(own_return, 6) as own_return, round(index_return, 6) as index_return, round(own_return - index_return, 6) as excess from own join xi using (ts)",
    ),
)
def excess_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = weekly_bars(spark, sf_dir)
    index = bars.groupBy("ts").agg(F.sum("close").alias("close")).withColumn("symbol", F.lit("index"))
    return E.excess_return(bars, index).select("symbol", "ts", *_r("own_return", "index_return", "excess"))


# ---------------------------------------------------------------- backtests

#: Cash for a few units, so that some signals cannot be paid for.
SETTINGS = C.Settings(cash=3_000.0, size=2, fee_rate=0.001, min_fee=5.0, slippage=0.01)
STOPS = C.Settings(cash=4_000.0, size=2, fee_rate=0.001, min_fee=5.0, slippage=0.01, stop_loss=0.1, take_profit=0.2)

_RISING = f"sg as (select symbol, ts, i, close / 1000.0::double as close, {RISE}::integer as signal from bars)"
HOLD_TABLES = f"""{_RISING},
sp as (select *, close * (1 + 0.01::double) * 2 as cost from sg),
sq as (select *, cost + greatest(cost * 0.001::double, 5) as spend from sp),
en as (select symbol, min(i) as entry, arg_min(spend, i) as spend from sq where signal = 1 and spend <= 3000 group by symbol),
ledger as (select g.symbol, g.i, g.ts, g.signal, g.close, case when g.i >= entry then 3000::double - spend else 3000::double end as cash, case when g.i >= entry then 2 else 0 end as position,
  case when g.i >= entry then 3000::double - spend + 2 * g.close else 3000::double end as equity from sg g left join en using (symbol))"""
#: The loop itself: a bar after another, carrying cash, position and entry price.
LOOP_TABLES = f"""{_RISING},
lp as (select symbol, i, ts, signal, close, case when signal = 1 and cost + greatest(cost * 0.001::double, 5) <= 4000 then 4000 - (cost + greatest(cost * 0.001::double, 5)) else 4000::double end as cash,
    case when signal = 1 and cost + greatest(cost * 0.001::double, 5) <= 4000 then 2 else 0 end as position, close * (1 + 0.01::double) as entry
  from (select *, close * (1 + 0.01::double) * 2 as cost from sg where i = 0)
  union all
  select symbol, i, ts, signal, close, case when buys then cash - spend when sells then cash + (got - greatest(got * 0.001::double, 5)) else cash end,
    case when buys then 2 when sells then 0 else position end, case when buys then close * (1 + 0.01::double) else entry end
  from (select *, position = 0 and signal = 1 and cash >= spend as buys, position > 0 and ((sell - entry) / entry <= -0.1::double or (sell - entry) / entry >= 0.2::double) as sells, sell * 2 as got
    from (select g.symbol, g.i, g.ts, g.signal, g.close, lp.cash, lp.position, lp.entry, g.close * (1 - 0.01::double) as sell,
        g.close * (1 + 0.01::double) * 2 + greatest(g.close * (1 + 0.01::double) * 2 * 0.001::double, 5) as spend
      from lp join sg g on g.symbol = lp.symbol and g.i = lp.i + 1))),
ledger as (select symbol, i, ts, signal, close, cash, position, cash + position * close as equity from lp)"""
_METRICS = """rr as (select symbol, i, equity, equity / lag(equity) over (partition by symbol order by i) - 1 as r, max(equity) over (partition by symbol order by i) as peak from ledger),
items as (select symbol, (arg_max(equity, i) - {cash}) / {cash} as total_return, greatest(max(case when peak > 0 then (peak - equity) / peak else 0 end), 0) as max_drawdown,
  coalesce(case when stddev_pop(r) > 1e-15 then avg(r) / stddev_pop(r) * sqrt(252) end, 0) as sharpe, count(*) as bars from rr group by symbol)"""


def _metrics(cash: int) -> str:
    return _METRICS.format(cash=f"{cash}::double")


def _rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.signal_series(weekly_bars(spark, sf_dir), "rise_three")


def _ledger_rows(ledger: DataFrame) -> DataFrame:
    return ledger.select("symbol", "i", F.col("ts").cast("date").alias("ts"), "signal", "position", *_r("close", "cash", "equity"))


_LEDGER_SQL = "select symbol, i, ts, signal, position, round(close, 6) as close, round(cash, 6) as cash, round(equity, 6) as equity from ledger"


@register("bt_hold_ledger", _with(BARS, HOLD_TABLES, select=_LEDGER_SQL))
def bt_hold_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger_rows(backtest_hold(_rising(spark, sf_dir), SETTINGS))


@register("bt_ledger_sltp", _with(BARS, LOOP_TABLES, select=_LEDGER_SQL))
def bt_ledger_sltp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger_rows(backtest_ledger(_rising(spark, sf_dir), STOPS))


_TRADES = "ch as (select *, position - coalesce(lag(position) over (partition by symbol order by i), 0) as change from ledger), trades as (select symbol, i, ts, case when change > 0 then close * (1 + 0.01::double) else close * (1 - 0.01::double) end as price, case when change > 0 then 'buy' else 'sell' end as side, abs(change)::integer as qty from ch where change <> 0)"


@register("bt_trades", _with(BARS, LOOP_TABLES, _TRADES, select="select symbol, i, ts, round(price, 6) as price, side, qty from trades"))
def bt_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger_trades(backtest_ledger(_rising(spark, sf_dir), STOPS), STOPS)
    return rows.select("symbol", "i", F.col("ts").cast("date").alias("ts"), *_r("price"), "side", "qty")


@register("annotate_trades", _with(BARS, LOOP_TABLES, _TRADES, select="select t.symbol, t.i, t.side, b.close as at_value from trades t join bars b on t.symbol = b.symbol and t.i = b.i"))
def annotate_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = weekly_bars(spark, sf_dir).withColumn("i", FRAME.index())
    made = ledger_trades(backtest_ledger(D.signal_series(bars.drop("i"), "rise_three"), STOPS), STOPS)
    return E.annotate_trades(made, bars).select("symbol", "i", "side", "at_value")


@register("annotate_equity", _with(BARS, LOOP_TABLES, _TRADES, select="select t.symbol, t.i, t.side, round(l.equity, 6) as at_value from trades t join ledger l on t.symbol = l.symbol and t.i = l.i"))
def annotate_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades marked on the equity curve."""
    ledger = backtest_ledger(_rising(spark, sf_dir), STOPS)
    return E.annotate_trades(ledger_trades(ledger, STOPS), ledger, "equity").select("symbol", "i", "side", *_r("at_value"))


_ITEMS_SQL = "select symbol, name, round(total_return, 6) as total_return, round(max_drawdown, 6) as max_drawdown, round(sharpe, 6) as sharpe from items left join names using (symbol)"


def _items(spark: SparkSession, sf_dir: str, settings: C.Settings) -> DataFrame:
    return M.by_symbol(run_backtest(_rising(spark, sf_dir), settings), settings.cash)


def _named(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    return G.with_names(items, names(spark, sf_dir)).select("symbol", "name", *_r("total_return", "max_drawdown", "sharpe"))


@register("bt_market", _with(BARS, HOLD_TABLES, _metrics(3000), select=_ITEMS_SQL))
def bt_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, _items(spark, sf_dir, SETTINGS))


@register("bt_market_sltp", _with(BARS, LOOP_TABLES, _metrics(4000), select=_ITEMS_SQL))
def bt_market_sltp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir, _items(spark, sf_dir, STOPS))


@register("bt_market_slices", _with(BARS, LOOP_TABLES, _metrics(4000), select="select symbol, round(total_return, 6) as total_return, round(max_drawdown, 6) as max_drawdown, round(sharpe, 6) as sharpe, bars from items"))
def bt_market_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of ledgers from summaries of slices of 100 bars, merged in order."""
    rows = M.by_slices(run_backtest(_rising(spark, sf_dir), STOPS), STOPS.cash, 100)
    return rows.select("symbol", *_r("total_return", "max_drawdown", "sharpe"), "bars")


@register("bt_summary", _with(BARS, HOLD_TABLES, _metrics(3000), select="select round(avg(total_return), 6) as avg_total_return, round(avg(sharpe), 6) as avg_sharpe, round(avg(max_drawdown), 6) as avg_max_drawdown, count(*) as symbols from items"))
def bt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.market_summary(_items(spark, sf_dir, SETTINGS)).select(*_r("avg_total_return", "avg_sharpe", "avg_max_drawdown"), "symbols")


_ONE_SYMBOL = "sg as (select symbol, ts, i, close / 1000.0::double as close, above_minutes::integer as signal from ab where symbol = (select min(symbol) from ab))"


@register("bt_symbol", _with(TICKS, TWO_INTERVALS, _ONE_SYMBOL, HOLD_TABLES.removeprefix(_RISING + ","), select=_LEDGER_SQL.replace("i, ts,", "i::integer as i, ts::date as ts,")))
def bt_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backtest of one symbol on its stored day and minute bars."""
    folder = _scratch(spark, "bars")
    for interval, rows in zip(("day", "minute"), _two_intervals(spark, sf_dir), strict=True):
        io.write_bars(rows, folder, interval)
    first = io.scan_market(spark, folder).agg(F.min("symbol")).first()[0]
    return _ledger_rows(backtest_symbol(spark, folder, first, "above_minutes", settings=SETTINGS))


@register("bt_top", _with(BARS, HOLD_TABLES, _metrics(3000), select="select symbol, round(total_return, 6) as total_return from (select symbol, total_return from items order by total_return desc, symbol limit 50)"))
def bt_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.market_top(_items(spark, sf_dir, SETTINGS), 50).select("symbol", *_r("total_return"))


@register("bt_annualized", _with(BARS, HOLD_TABLES, _metrics(3000), select="select symbol, round(pow(1 + total_return, 252.0::double / bars) - 1, 6) as annualized from items"))
def bt_annualized(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir, SETTINGS)
    return items.select("symbol", F.round(M.annualized_return(F.col("total_return"), F.col("bars")), 6).alias("annualized"))


@register("equity_return", _with(BARS, HOLD_TABLES, select="select symbol, i, round((equity / first(equity) over (partition by symbol order by i) - 1) * 100, 6) as equity_return from ledger"))
def equity_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = backtest_hold(_rising(spark, sf_dir), SETTINGS)
    return ledger.select("symbol", "i", F.round(E.cum_return_pct("equity"), 6).alias("equity_return"))


_GRID_SUMS = ", ".join(f"{_S(n)} as s{n}" for n in (*range(3, 11), *range(15, 51)))
_GRID_PAIRS = "unnest([" + ", ".join(f"{{'n': {n}, 's': s{n}, 'p': lag(s{n}) over ({_W})}}" for n in range(15, 51)) + "])"


@register(
    "sma_grid",
    _with(
        BARS,
        f"gs as (select symbol, ts, i, close / 1000.0::double as price, {_GRID_SUMS} from bars)",
        "fs as (select symbol, i, price, unnest([" + ", ".join(f"{{'n': {n}, 's': s{n}, 'p': lag(s{n}) over ({_W})}}" for n in range(3, 11)) + f"]) as f, {_GRID_PAIRS.replace('unnest([', '[').replace('])', ']')} as ss from gs)",
        "fp as (select symbol, i, price, f.n as fast, f.s as fs, f.p as fp, unnest(ss) as s from fs)",
        "fire as (select symbol, i, fast, s.n as slow, price from fp where i >= s.n and fs * s.n > s.s * fast and not fp * s.n > s.p * fast)",
        "paid as (select symbol, i, fast, slow, price * (1 + 0.01::double) * 2 + greatest(price * (1 + 0.01::double) * 2 * 0.001::double, 5) as spend from fire)",
        "ent as (select symbol, fast, slow, min(i) as entry, arg_min(spend, i) as spend from paid where spend <= 3000 group by symbol, fast, slow)",
        "led as (select distinct e.symbol, entry, g.i, case when g.i >= entry then 3000::double - spend + 2 * price else 3000::double end as equity from (select distinct symbol, entry, spend from ent) e join gs g using (symbol))",
        "rr as (select symbol, entry, i, equity, equity / lag(equity) over (partition by symbol, entry order by i) - 1 as r, max(equity) over (partition by symbol, entry order by i) as peak from led)",
        "fig as (select symbol, entry, (arg_max(equity, i) - 3000::double) / 3000::double as total_return, greatest(max((peak - equity) / peak), 0) as max_drawdown, coalesce(case when stddev_pop(r) > 1e-15 then avg(r) / stddev_pop(r) * sqrt(252) end, 0) as sharpe from rr group by symbol, entry)",
        "al as (select symbol, fast, slow from (select distinct symbol from bars), (select unnest(range(3, 11)) as fast), (select unnest(range(15, 51)) as slow))",
        "pr as (select symbol, fast, slow, coalesce(total_return, 0) as total_return, coalesce(sharpe, 0) as sharpe, coalesce(max_drawdown, 0) as max_drawdown from al left join ent using (symbol, fast, slow) left join fig using (symbol, entry))",
        "rk as (select *, cast(row_number() over (partition by symbol order by round(total_return, 9) desc, fast, slow) as integer) as rank from pr)",
        select="select symbol, fast::integer as fast, slow::integer as slow, round(total_return, 6) as total_return, round(sharpe, 6) as sharpe, round(max_drawdown, 6) as max_drawdown, rank from rk where rank <= 10",
    ),
)
def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sma_grid(weekly_bars(spark, sf_dir), settings=SETTINGS).select("symbol", "fast", "slow", *_r("total_return", "sharpe", "max_drawdown"), "rank")


# ---------------------------------------------------------------- ordering


@register("sort_results", _with(BARS, select="select symbol, arg_max(close, ts) as price from bars group by symbol order by price desc, symbol"))
def sort_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sort_results(G.snapshot(weekly_bars(spark, sf_dir)).select("symbol", "price"), "price", descending=True)


@register("page", _with(BARS, select="select symbol, price from (select symbol, arg_max(close, ts) as price from bars group by symbol) order by price, symbol limit 5 offset 5"))
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page(G.sort_results(G.snapshot(weekly_bars(spark, sf_dir)).select("symbol", "price"), "price"), 1, 5)


@register("page_after", _with(BARS, "lp as (select symbol, arg_max(close, ts) as price from bars group by symbol)", "ln as (select *, row_number() over (order by price desc, symbol) as n from lp)", select="select symbol, price from ln where n > 5 and n <= 25"))
def page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the first five, by the last row of these."""
    rows = G.snapshot(weekly_bars(spark, sf_dir)).select("symbol", "price")
    last = G.page_after(rows, "price", None, 5, descending=True).collect()[-1]
    return G.page_after(rows, "price", (last.price, last.symbol), 20, descending=True)


@register("tail", _with(BARS, select="select symbol, ts, close from (select *, row_number() over (partition by symbol order by ts desc) as n from bars) where n <= 120"))
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tail(weekly_bars(spark, sf_dir)).select("symbol", "ts", "close")


@register("with_names", _with(BARS, select="select symbol, name, ts, close from bars left join names using (symbol)"))
def with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_names(weekly_bars(spark, sf_dir), names(spark, sf_dir)).select("symbol", "name", "ts", "close")


# ---------------------------------------------------------------- as-of

_ASOF = "select b.symbol, b.ts, b.close, b.volume, e.float_stock, e.total_stock from bars b asof left join capital e on b.symbol = e.symbol and b.ts >= e.ts"


@register("equity_asof", _with(BARS, CAPITAL, select=f"select symbol, ts, close, float_stock, total_stock from ({_ASOF})"))
def equity_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.equity_asof(weekly_bars(spark, sf_dir), capital(spark, sf_dir)).select("symbol", "ts", "close", "float_stock", "total_stock")


@register("turnover_rate", _with(BARS, CAPITAL, select=f"select symbol, ts, round(volume * 100 / float_stock, 6) as turnover from ({_ASOF})"))
def turnover_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.turnover_rate(weekly_bars(spark, sf_dir), capital(spark, sf_dir)).select("symbol", "ts", *_r("turnover"))


@register("adjust_prices", _with(BARS, CAPITAL, "cf as (select symbol, ts, product(factor) over (partition by symbol order by ts) as factor from factors)", select="select b.symbol, b.ts, b.close * coalesce(f.factor, 1) as close from bars b asof left join cf f on b.symbol = f.symbol and b.ts >= f.ts"))
def adjust_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.adjust_prices(weekly_bars(spark, sf_dir), factors(spark, sf_dir)).select("symbol", "ts", "close")


@register(
    "adjust_prices_forward",
    _with(
        BARS,
        CAPITAL,
        "cf as (select symbol, ts, product(factor) over (partition by symbol order by ts) as factor from factors)",
        "ad as (select b.symbol, b.ts, b.open, b.high, b.low, b.close, coalesce(f.factor, 1) as factor from bars b asof left join cf f on b.symbol = f.symbol and b.ts >= f.ts)",
        "af as (select *, factor / last(factor) over (partition by symbol order by ts rows between unbounded preceding and unbounded following) as f from ad)",
        select="select symbol, ts, round(open * f, 6) as open, round(high * f, 6) as high, round(low * f, 6) as low, round(close * f, 6) as close from af",
    ),
)
def adjust_prices_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.adjust_prices(weekly_bars(spark, sf_dir), factors(spark, sf_dir), forward=True).select("symbol", "ts", *_r("open", "high", "low", "close"))


@register("turnover_rate_cut", _with(BARS, CAPITAL, select=f"select symbol, ts, round(volume * 100 / float_stock, 6) as turnover from ({_ASOF})"))
def turnover_rate_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two levels: ranges of time, and the last events of each."""
    return H.turnover_rate(weekly_bars(spark, sf_dir), capital(spark, sf_dir), cut=True).select("symbol", "ts", *_r("turnover"))


@register("adjust_prices_cut", _with(BARS, CAPITAL, "cf as (select symbol, ts, product(factor) over (partition by symbol order by ts) as factor from factors)", select="select b.symbol, b.ts, b.close * coalesce(f.factor, 1) as close from bars b asof left join cf f on b.symbol = f.symbol and b.ts >= f.ts"))
def adjust_prices_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.adjust_prices(weekly_bars(spark, sf_dir), factors(spark, sf_dir), cut=True).select("symbol", "ts", "close")


# ---------------------------------------------------------------- streams

_CLOSED = "select max(ts) - interval '1 hour' as mark from events"


@register(
    "stream_bars",
    _with(TICKS, select=f"select symbol, time_bucket(interval '1 hour', ts) as ts, arg_min(price, row(ts, event_id, price)) as open, max(price) as high, min(price) as low, arg_max(price, row(ts, event_id, price)) as close, count(*) as volume from ticks group by symbol, time_bucket(interval '1 hour', ticks.ts) having time_bucket(interval '1 hour', ticks.ts) + interval '1 hour' <= ({_CLOSED})"),
)
def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    ticks = stream.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("price"), F.lit(1).alias("volume"))
    folder = _scratch(spark, "stream")
    bars = stream_bars(ticks, "1 hour", "1 hour", ("event_id",))
    bars.writeStream.format("parquet").option("path", f"{folder}/bars").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    closed = events.agg((F.max("ts").cast("timestamp") - F.expr("interval 1 hour")).alias("mark"))
    made = spark.read.schema(bars.schema).parquet(f"{folder}/bars")
    rows = made.join(F.broadcast(closed)).where(F.col("ts") + F.expr("interval 1 hour") <= F.col("mark"))
    return rows.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *OHLCV[2:])


@register("stream_upsert", _with(BARS, select="select symbol, ts, open, high, low, close, volume from bars"))
def streamed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars arrive as a stream of files and are merged into a store that has only the first years."""
    folder = _scratch(spark, "upsert")
    bars = weekly_bars(spark, sf_dir).select(*OHLCV)
    first = F.lit("1996-06-03").cast("date")
    write_version(bars.where(F.col("ts") <= first), f"{folder}/store", 0, 8, "yyyy")
    last = F.max(F.when(F.col("ts") <= first, F.col("ts"))).over(Window.partitionBy("symbol"))
    bars.withColumn("last", last).where(F.col("last").isNull() | (F.col("ts") >= F.col("last"))).select(*OHLCV).write.parquet(f"{folder}/incoming")
    stream = spark.readStream.schema(bars.schema).parquet(f"{folder}/incoming")
    stream_upsert(stream, f"{folder}/store", f"{folder}/state", 8, "yyyy").awaitTermination()
    return stored_bars(spark, f"{folder}/store").select(*OHLCV)

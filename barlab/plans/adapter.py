"""Bars and what goes with them, from the given tables: in Spark, and as the first tables of an SQL query.

``lineitem`` gives weekly bars of suppliers (price of an item, quantity as volume), ``events`` prints and
hourly bars of users, ``supplier`` names, ``orders`` share capital and adjustment factors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.operators.bars import bars_from_ticks

# Prefixes of symbols, by the number's remainder.
PREFIXES = ("sh60", "sz00", "bj92")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol(number: str) -> Column:
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.pmod(number, F.lit(3)) + 1).cast("int"))
    return F.concat(prefix, F.lpad(F.col(number).cast("string"), 8, "0"))


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    price = F.floor(F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0)) * 1000 + 0.5).cast("long")
    prints = items.select("l_suppkey", F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", price.alias("price"), F.col("l_quantity").alias("volume"))
    # Day and order, line and price in the digits of one number.
    high = F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("long") * 10**13 + F.col("l_orderkey")
    low = F.col("l_linenumber").cast("long") * 10**13 + F.col("price")
    order = (high.cast("decimal(19,0)") * F.lit(10**14).cast("decimal(15,0)") + low.cast("decimal(15,0)")).cast("decimal(38,0)")
    # The number is the key of the aggregate: shorter than the symbol made of it.
    bars = bars_from_ticks(prints, "week", symbol="l_suppkey", order=order)
    return bars.withColumns({"symbol": symbol("symbol"), "ts": F.col("ts").cast("date")})


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(symbol("s_suppkey").alias("symbol"), F.col("s_name").alias("name"))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, event_id, price, volume) of users' events, in hundredths."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("price"), F.lit(1).alias("volume"))


def capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share capital of symbols from dates on: (symbol, ts, float_stock, total_stock)."""
    o = table(spark, sf_dir, "orders").withColumn("ts", F.col("o_orderdate").cast("date"))
    # An order stands for the supplier of its customer's number, among those that there are.
    suppliers = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("most"))
    o = o.join(F.broadcast(suppliers)).withColumn("n", F.pmod("o_custkey", F.col("most") + 1))
    return o.groupBy(symbol("n").alias("symbol"), "ts").agg((F.max("o_orderkey") + 1000).alias("float_stock"), (F.max("o_orderkey") + 5000).alias("total_stock"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjustment factors of symbols: halves and doubles, exact in binary."""
    return capital(spark, sf_dir).select("symbol", "ts", F.when(F.col("float_stock") % 2 == 0, 2.0).otherwise(0.5).alias("factor"))


def _symbol_sql(n: str) -> str:
    return f"(['sh60', 'sz00', 'bj92'][1 + {n} % 3] || lpad({n}::varchar, 8, '0'))"


#: Tables ``bars`` (symbol, ts, open, high, low, close, volume, i) and ``names``.
BARS = f"""
p as (select l_suppkey, cast(date_trunc('week', l_shipdate) as date) as ts, l_shipdate, l_orderkey, l_linenumber, l_quantity,
  cast(floor(l_extendedprice / l_quantity * 1000 + 0.5) as bigint) as px from lineitem),
b as (select l_suppkey, ts, arg_min(px, row(l_shipdate, l_orderkey, l_linenumber, px)) as open, max(px) as high, min(px) as low,
  arg_max(px, row(l_shipdate, l_orderkey, l_linenumber, px)) as close, cast(sum(l_quantity) as bigint) as volume from p group by l_suppkey, ts),
bars as (select {_symbol_sql("l_suppkey")} as symbol, ts, open, high, low, close, volume, cast(row_number() over (partition by l_suppkey order by ts) - 1 as integer) as i from b),
names as (select {_symbol_sql("s_suppkey")} as symbol, s_name as name from supplier)"""

#: Table ``ticks`` (symbol, ts, event_id, price).
TICKS = "ticks as (select user_id::varchar as symbol, ts, event_id, cast(floor(value * 100 + 0.5) as bigint) as price from events)"

#: Tables ``capital`` and ``factors``.
CAPITAL = f"""
co as (select o_custkey % ((select max(s_suppkey) from supplier) + 1) as n, cast(o_orderdate as date) as ts, o_orderkey from orders),
capital as (select {_symbol_sql("n")} as symbol, ts, max(o_orderkey) + 1000 as float_stock, max(o_orderkey) + 5000 as total_stock from co group by n, ts),
factors as (select symbol, ts, case when float_stock % 2 = 0 then 2.0::double else 0.5::double end as factor from capital)"""

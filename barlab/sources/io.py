"""Bars in Parquet: reading with pushed-down ranges, refreshing, merging, exporting.

The table is partitioned by ``interval`` and clustered by symbol and time within files, so that a range
of one symbol reads few row groups; it is not partitioned by symbol, which would make small files.
"""

from __future__ import annotations

import re
import tempfile
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlab.functions.columns import time_range
from barlab.functions.frames import unused

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        *[T.StructField(c, T.LongType()) for c in ("open", "high", "low", "close", "volume")],
        T.StructField("amount", T.DoubleType()),
        T.StructField("turnover", T.DoubleType()),
        T.StructField("float_stock", T.LongType()),
        T.StructField("total_stock", T.LongType()),
    ]
)


def write_bars(bars: DataFrame, path: str, interval: str, mode: str = "overwrite") -> None:
    """Writes one interval's bars; other intervals of the table stay."""
    rows = bars.withColumn("interval", F.lit(interval)).repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts")
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("interval").parquet(path)


def write_bucketed(bars: DataFrame, path: str, table: str, buckets: int = 64) -> None:
    """Writes bars as a table of buckets of symbols, a file each, sorted by symbol and time: windows over symbols read it without an exchange."""
    spread = bars.repartition(buckets, "symbol").sortWithinPartitions("symbol", "ts")
    spread.write.mode("overwrite").option("path", path).bucketBy(buckets, "symbol").sortBy("symbol", "ts").saveAsTable(table)


def open_bucketed(spark: SparkSession, path: str, table: str, buckets: int = 64) -> DataFrame:
    """The bars that ``write_bucketed`` has stored in ``path``, declared as ``table`` where the session does not know it."""
    if not spark.catalog.tableExists(table):
        columns = spark.read.parquet(path).schema
        declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        spark.sql(f"CREATE TABLE {table} ({declared}) USING parquet CLUSTERED BY (symbol) SORTED BY (symbol, ts) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def scan_market(spark: SparkSession, path: str, start: datetime | str | None = None, end: datetime | str | None = None, interval: str = "day") -> DataFrame:
    """All symbols' bars strictly between the bounds; symbols without any do not appear."""
    return spark.read.parquet(path).where((F.col("interval") == interval) & time_range(start, end)).drop("interval")


def read_bars(spark: SparkSession, path: str, symbol: str, start: datetime | str | None = None, end: datetime | str | None = None, interval: str = "day") -> DataFrame:
    """One symbol's bars strictly between the bounds, ascending; none for an unknown symbol."""
    return scan_market(spark, path, start, end, interval).where(F.col("symbol") == symbol).orderBy("ts")


def read_minute_bars(spark: SparkSession, path: str, symbol: str, start: datetime | str | None = None, end: datetime | str | None = None) -> DataFrame:
    return read_bars(spark, path, symbol, start, end, interval="minute")


def universe(symbols: DataFrame) -> DataFrame:
    """Symbols and names, each once."""
    return symbols.select("symbol", "name").distinct()


def needs_refresh(wanted: DataFrame, markers: DataFrame, now: datetime | str, hour: int = 15, minute: int = 0) -> DataFrame:
    """Keys whose update time is before the last cutoff, with ``updated`` (0 where there is none yet).

    The cutoff is today's time of day if ``now`` is after it, else yesterday's. ``markers``: key and time
    in seconds.
    """
    at = F.lit(now).cast("timestamp")
    today = F.date_trunc("day", at) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute))
    cutoff = F.when(at > today, today).otherwise(today - F.make_dt_interval(F.lit(1)))
    known = markers.groupBy("key").agg(F.max("time").alias("time"))
    rows = wanted.select("key").distinct().join(known, "key", "left").select("key", F.coalesce("time", F.lit(0)).cast("long").alias("updated"))
    return rows.where(F.timestamp_seconds("updated") < cutoff)


def upsert_tail(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replaces each symbol's last existing bar and adds what follows: the last bar may have been unfinished.

    Of existing bars those before the symbol's last are kept, of incoming ones those from it on (all, for a
    new symbol).
    """
    (name,) = unused(incoming, *unused(existing, "_last"))
    last = existing.groupBy("symbol").agg(F.max("ts").alias(name))
    old = existing.join(last, "symbol").where(F.col("ts") < F.col(name)).drop(name)
    new = incoming.join(last, "symbol", "left").where(F.col(name).isNull() | (F.col("ts") >= F.col(name))).drop(name)
    return old.unionByName(new)


EXPORT = ("code", "name", "price", "score", "turnover", "float_value", "signal")


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] = EXPORT) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, nested bars as arrays; null fields are left out."""
    df.write.mode("overwrite").json(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; in one process, as in tests, a new one where none is set."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        folder = sc.getCheckpointDir()
    return folder

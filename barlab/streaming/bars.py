"""Bars from streams of prints, and merging streamed bars."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_bars(ticks: DataFrame, freq: str, delay: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """Bars of ``freq`` from a stream of (symbol, ts, price, volume); a bar comes once the watermark passes its end.

    Prints that are later than ``delay`` are dropped. State holds the open bars only.
    """
    ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    order = F.struct("ts", *tie, "price")
    bars = (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", freq).alias("_w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").cast("long").alias("volume"))
    )
    return bars.select("symbol", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


@dataclass(frozen=True, order=True)
class Part:
    """A partition of a store: the bars of a bucket of symbols and a period, as a version wrote them."""

    bucket: int
    period: str
    version: int


_PATH = re.compile(r"/version=(\d+)/bucket=(\d+)/period=([^/]+)/")


def _parts(spark: SparkSession, path: str) -> list[Part]:
    """The partitions of a store, by the names of its folders; no data is read."""
    files = spark.read.parquet(path).inputFiles()
    return sorted({Part(int(m[2]), m[3], int(m[1])) for m in map(_PATH.search, files) if m})


def _latest(parts: list[Part], upto: int | None = None) -> list[Part]:
    """Of each bucket and period its latest version, at most ``upto``."""
    known = {(p.bucket, p.period): p for p in parts if upto is None or p.version <= upto}
    return list(known.values())


def _read(spark: SparkSession, path: str, parts: list[Part]) -> DataFrame:
    folders = [f"{path}/version={p.version}/bucket={p.bucket}/period={p.period}" for p in parts]
    rows = spark.read.option("basePath", path).parquet(*folders) if folders else spark.read.parquet(path).where("false")
    return rows.where("_real").drop("version", "bucket", "period", "_real")


def stored_bars(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The bars of a store that ``stream_upsert`` keeps: of each bucket and period its latest version (at most ``upto``)."""
    return _read(spark, path, _latest(_parts(spark, path), upto))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")


def write_version(bars: DataFrame, path: str, version: int, buckets: int, period: str = "yyyy-MM", touched: list[tuple[int, str]] | None = None) -> None:
    """Writes ``bars`` as a version. ``touched``: buckets and periods that it replaces, also where no bars of them are left."""
    rows = bars.withColumns({"bucket": _bucket(buckets), "period": F.date_format("ts", period), "_real": F.lit(True)})
    if touched:
        # A row that is no bar stands for a period that may have become empty.
        marks = bars.sparkSession.createDataFrame(touched, "bucket int, period string").withColumn("_real", F.lit(False))
        rows = rows.unionByName(marks, allowMissingColumns=True)
    rows.repartition("bucket", "period").sortWithinPartitions("bucket", "period", "symbol", "ts").write.mode("overwrite").partitionBy("bucket", "period").parquet(f"{path}/version={version}")


def _remove(spark: SparkSession, path: str, parts: list[Part]) -> None:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for p in parts:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/version={p.version}/bucket={p.bucket}/period={p.period}"), True)


def superseded(parts: list[Part], upto: int) -> list[Part]:
    """Partitions that no reader of version ``upto`` or a later one needs."""
    return sorted(set(p for p in parts if p.version <= upto) - set(_latest(parts, upto)))


def stream_upsert(bars: DataFrame, path: str, checkpoint: str, buckets: int = 64, period: str = "yyyy-MM", keep: int = 2) -> StreamingQuery:
    """Merges each micro-batch into the bars stored in ``path``: of a symbol that has newer bars the last one is replaced, and later ones follow.

    The store holds versions of buckets of symbols and periods of time; version 0 is there before (``write_version``). Batch k reads
    the versions up to k and writes the buckets and periods in which bars change as version k + 1: those of the new bars, and of the
    bars that they replace. So what is written does not grow with the history, a batch that is replayed
    after a restart, by this process or another, merges to the same rows, and the rest is not written again. Of touched buckets only
    symbols and times are read to find the last bars. Partitions that were replaced ``keep`` versions ago or earlier are removed after each batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        current = _latest(_parts(spark, path), number)
        own = {r[0] for r in batch.select(_bucket(buckets)).distinct().collect()}
        known = _read(spark, path, [p for p in current if p.bucket in own]).select("symbol", "ts")
        last = known.join(batch.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.max("ts").alias("_last"))
        fresh = batch.join(last, "symbol", "left").where(F.col("_last").isNull() | (F.col("ts") >= F.col("_last"))).drop("_last")
        gone = last.join(fresh.select("symbol").distinct(), "symbol", "left_semi").select("symbol", F.col("_last").alias("ts"))
        places = fresh.select("symbol", "ts").unionByName(gone).select(_bucket(buckets).alias("bucket"), F.date_format("ts", period).alias("period")).distinct()
        touched = [tuple(r) for r in places.collect()]  # buckets times some periods at most
        if touched:
            old = _read(spark, path, [p for p in current if (p.bucket, p.period) in set(touched)]).join(gone, ["symbol", "ts"], "left_anti")
            write_version(old.unionByName(fresh), path, number + 1, buckets, period, touched)
        _remove(spark, path, superseded(_parts(spark, path), number + 1 - keep))

    return bars.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

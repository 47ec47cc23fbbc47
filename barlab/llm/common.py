"""What the operators share: durable cuts of lineage and the tables' columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and the white space before one, as regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]*"


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; in one process, as in tests, one is made where none is configured."""
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def durable(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder; the files outlive lost executors."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a new Parquet table in the shared folder, for what is read again by columns."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with nulls of ``column`` as empty texts."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it if ``df`` has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name

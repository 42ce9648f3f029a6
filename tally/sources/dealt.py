"""Tables dealt by a key into buckets of Parquet files, in place of a shuffle.

A shuffle keeps whole rows on disk until its query ends: a ledger line takes 45
to 170 bytes each time it is dealt. The same rows as compressed columns take 20 to
30, and a table goes as soon as no later step reads it. Spark takes the buckets of
a table as its partitioning, so a join, window or aggregate by the key needs no
exchange. Every task writes a file per bucket it has rows for; beyond
``MOST_BUCKETS`` buckets, where that would be too many files, rows are shuffled
first and each bucket is one file.

The tables are under ``spark.checkpoint.dir``. No catalog keeps their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path
from .staging import drop_path
from .tables import read_table

BUCKET_BYTES = 32 << 20   # of the input's files
FEW_BUCKETS = 64          # a small input has as many as there are cores, up to this
MOST_BUCKETS = 512


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


class Dealt:
    """The dealt tables of one run; ``tables`` are the inputs that set the number of buckets."""

    def __init__(self, spark: SparkSession, sf_dir: str, *tables: str):
        self.spark = spark
        self.root = shared_path(spark, "tally-dealt", uuid.uuid4().hex)
        size = max(_bytes(read_table(spark, sf_dir, t)) for t in tables)
        self.buckets = max(min(spark.sparkContext.defaultParallelism, FEW_BUCKETS), -(-size // BUCKET_BYTES))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """The rows of ``df``, written by ``key``."""
        table = f"tally_dealt_{uuid.uuid4().hex}"
        if self.buckets > MOST_BUCKETS:
            df = df.repartition(self.buckets, key)
        (df.write.format("parquet").option("path", self.path(name)).option("compression", "zstd")
         .bucketBy(self.buckets, key).saveAsTable(table))
        try:
            return self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE {table}")  # the name alone: files at a given path stay

    def join(self, left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
        """Inner join; both sides are dealt unless Spark may broadcast the right one."""
        on = left[left_key] == right[right_key]
        most = self.spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        if _bytes(right) <= most:
            return left.join(right, on)
        left, right = self.write(left, left_key, left_key), self.write(right, right_key, right_key)
        return left.join(right, left[left_key] == right[right_key])

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, self.path(name))

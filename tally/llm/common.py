"""Shared helpers: staged tables, gapless ranks and connected components."""

from __future__ import annotations

import sys
import types
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import shared_path

PARTITION_BITS = 40  # ids made inside a task: partition << 40 | counter


class Staging:
    """Tables of one operator run, under ``spark.checkpoint.dir``.

    A staged table cuts the lineage (a lost executor re-reads files) and
    fixes ids that were made per task. ``drop`` removes one as soon as no
    later step reads it.
    """

    made: list[list[Staging]] = []  # by open ``scratch`` blocks, those made inside

    def __init__(self, spark: SparkSession, label: str):
        for block in Staging.made:
            block.append(self)
        self.spark = spark
        self.root = shared_path(spark, "tally-llm", f"{label}-{uuid.uuid4().hex}")
        self.count = 0
        self.live: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.drop(name)
        self.live[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.live.pop(name, None)
            if path is not None:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch():
    """Removes at its end whatever was staged by operators called inside."""
    Staging.made.append([])
    try:
        yield
    finally:
        for staging in Staging.made.pop():
            staging.drop(*list(staging.live))


def per_worker(key: tuple, make):
    """``make()``, once per Python worker process and kept between its tasks,
    until another key is asked for: a worker holds the table of one operator."""
    store = sys.modules.setdefault("tally_worker_store", types.ModuleType("tally_worker_store")).__dict__
    held = store.setdefault("held", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_ids(docs: DataFrame, staging: Staging, name: str = "rows") -> tuple[DataFrame, str]:
    """``docs`` staged with a unique long per row; returns it and the column."""
    rid = fresh(docs, "row_id__")
    return staging.write(docs.withColumn(rid, F.monotonically_increasing_id()), name), rid


def keep_rows(rows: DataFrame, rid: str, dropped: DataFrame) -> DataFrame:
    """``rows`` without those whose id is in the staged table ``dropped``.

    Spark broadcasts ``dropped`` only when its files are under the broadcast
    threshold, and otherwise joins by sort and merge on the unique id.
    """
    gone = dropped.select(F.col(dropped.columns[0]).alias("gone_row__"))
    return rows.join(gone, rows[rid] == gone["gone_row__"], "left_anti").drop(rid)


SLICES, SLICE_ROWS = 64, 1 << 20  # of a ranked group: this many, or as many as have about so many rows


def slices_for(most: int) -> int:
    """Slices for groups of at most ``most`` rows, so that no window is larger than about ``SLICE_ROWS``."""
    return max(SLICES, -(-most // SLICE_ROWS))


def gapless_rank(df: DataFrame, keys: list[str], spread: str, slices: int = SLICES) -> DataFrame:
    """Add ``rank`` (long, gapless from 0 in each group of ``keys``).

    A group is cut into ``slices`` by a hash of the unique column ``spread``,
    so that a group with a third of all rows is ranked by many tasks: counts
    per slice (combined before the shuffle) give each slice its first rank.
    """
    sliced = df.withColumn("slice__", F.pmod(F.xxhash64(F.lit("slice"), F.col(spread)), F.lit(slices)).cast("int"))
    counts = sliced.groupBy(*keys, "slice__").agg(F.count(F.lit(1)).alias("n__"))
    before = Window.partitionBy(*keys).orderBy("slice__").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, "slice__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("first__"))
    within = Window.partitionBy(*keys, "slice__").orderBy(spread)
    numbered = sliced.withColumn("within__", F.row_number().over(within) - 1)
    return (numbered.join(first, [*keys, "slice__"])
            .withColumn("rank", (F.col("first__") + F.col("within__")).cast("long"))
            .drop("slice__", "first__", "within__"))


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()


def _large_star(edges: DataFrame, staging: Staging) -> DataFrame:
    both = edges.union(edges.selectExpr("v AS u", "u AS v"))
    low = staging.write(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m"), "low")
    return both.join(low, "u").filter("v > u").selectExpr("v AS u", "m AS v")


def _small_star(edges: DataFrame, staging: Staging) -> DataFrame:
    low = staging.write(edges.groupBy("u").agg(F.min("v").alias("m")), "low")
    return edges.join(low, "u").selectExpr("v AS u", "m AS v").union(low.selectExpr("u", "m AS v"))


def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """Connected components of ``edges`` (two long columns): one row
    ``node, root`` per node of any edge, ``root`` the least node reached.

    Alternating large-star and small-star rounds; a hub's minimum is combined
    before the shuffle and written, so that the join with its edges has shuffles
    of its own and Spark splits it when one key is hot. Rounds end when a round
    changes nothing.
    """
    u, v = edges.columns
    edges = staging.write(_canonical(edges.selectExpr(f"`{u}` AS u", f"`{v}` AS v")), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        last = now
        large = staging.write(_canonical(_large_star(edges, staging)), "large")
        edges = staging.write(_canonical(_small_star(large, staging)), "edges")
        staging.drop("large", "low")
        now = state(edges)
        if now == last:
            break
    return edges.selectExpr("u AS node", "v AS root").union(edges.selectExpr("v AS node", "v AS root").distinct())


def field_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType

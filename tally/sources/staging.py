"""Staged intermediate tables in the shared checkpoint folder.

A staged table is written once as Parquet under ``spark.checkpoint.dir``
(the cluster's shared folder) and read back, so later passes read compact
columnar files instead of recomputing the lineage, and a lost executor
re-reads files. ``drop_path`` removes it when the publish is over.
"""

from __future__ import annotations

import uuid

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..session import shared_path

if TYPE_CHECKING:
    from .dealt import Dealt


def stage_table(df: DataFrame, label: str, *metrics: Column, rows: str = "true", without: tuple[str, ...] = (),
                dealt: Dealt | None = None) -> tuple[DataFrame, str, dict]:
    """The staged copy, its path and the ``metrics`` (aggregates over all rows),
    which are observed while the rows are written: those that hold for ``rows``, in all
    columns but ``without``, dealt by row_id if a ``dealt`` run is given."""
    seen = Observation()
    out = (df.observe(seen, *metrics) if metrics else df).filter(rows).drop(*without)
    if dealt is not None:
        return dealt.write(out, "row_id", label), dealt.path(label), seen.get if metrics else {}
    path = shared_path(df.sparkSession, "tally-stage", f"{label}-{uuid.uuid4().hex}")
    out.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(out.schema).parquet(path), path, seen.get if metrics else {}


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

"""Pending investments (I1-I2): table defaults and remaining to fund."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def pending_defaults(df: DataFrame) -> DataFrame:
    """Currency THB, committed 0, priority Medium, status Planned."""
    out = df
    for c, v in S.PENDING_DEFAULTS.items():
        typ = S.PENDING_SCHEMA[c].dataType
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(typ)))
    return out


def remaining_to_fund(df: DataFrame) -> DataFrame:
    """estimated_cost − committed_amount (committed defaults to 0)."""
    committed = F.coalesce(F.col("committed_amount"), F.lit(0).cast(S.MONEY_WIDE))
    return df.withColumn("remaining_to_fund", (F.col("estimated_cost") - committed).cast("double"))

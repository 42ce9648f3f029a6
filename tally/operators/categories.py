"""Two-level expense category dimension (natural keys).

A parent's key is its name; a child's key is ``parent + \\x1f + child``.
Keys need no coordination and are stable over re-runs, so building the
dimension is a distinct (hash aggregate, combined map-side) plus an anti join
against what already exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def category_key(category: Column, subcategory: Column) -> Column:
    """Natural key; ``concat_ws`` skips a null subcategory, so a parent's key is its name."""
    return F.concat_ws(S.CATEGORY_KEY_SEP, category, subcategory)


def build_dimension(lines: DataFrame) -> DataFrame:
    """Parents and children named by the (normalized) category columns.

    One pass: each line yields its parent entry and, when it has a
    subcategory, its child entry; a single distinct (combined map-side)
    removes repeats.
    """
    parent = F.struct(F.col("category").alias("category_key"), F.col("category").alias("name"),
                      F.lit(None).cast("string").alias("parent_key"))
    child = F.when(F.col("subcategory").isNotNull(), F.struct(
        category_key(F.col("category"), F.col("subcategory")).alias("category_key"),
        F.col("subcategory").alias("name"), F.col("category").alias("parent_key")))
    entries = lines.select(F.explode(F.array(parent, child)).alias("e")).filter(F.col("e").isNotNull())
    return entries.select("e.*").distinct()


def merge_dimension(existing: DataFrame, lines: DataFrame) -> DataFrame:
    """C1 get-or-create: existing rows plus the new keys only."""
    wanted = build_dimension(lines)
    new = wanted.join(existing.select("category_key"), "category_key", "left_anti")
    return existing.select(*S.column_names(S.CATEGORY_SCHEMA)).unionByName(new)


def with_parent_names(dim: DataFrame) -> DataFrame:
    """The dimension plus each entry's parent name (null for parents and for
    a child whose parent is missing). Published with the dimension, so
    readers resolve names with a single join."""
    parent = dim.select(F.col("category_key").alias("parent_key"), F.col("name").alias("parent_name"))
    return dim.select(*S.column_names(S.CATEGORY_SCHEMA)).join(parent, "parent_key", "left").select(
        *S.column_names(S.CATEGORY_SCHEMA), "parent_name")


def resolve(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Inner join to the dimension (unmatched keys drop out, as in the
    reports), then the parent's name through a left self join.

    Adds ``own_name``, ``parent_key``, ``parent_name``, ``is_subcategory``,
    and the breakdown key ``category`` / ``subcategory`` / ``kind``. A child
    whose parent is missing keeps ``category`` null: it counts in totals but
    in no line.

    Call it on aggregated rows (one per category key), not on ledger lines:
    the join then moves a few rows whatever the ledger size.
    """
    if "parent_name" in dim.columns:
        # Published dimension: parent names already resolved, one join.
        own = dim.select("category_key", F.col("name").alias("own_name"), "parent_key", "parent_name")
        out = df.join(own, "category_key", "inner")
    else:
        own = dim.select("category_key", F.col("name").alias("own_name"), "parent_key")
        parent = dim.select(F.col("category_key").alias("parent_key"), F.col("name").alias("parent_name"))
        out = df.join(own, "category_key", "inner").join(parent, "parent_key", "left")
    is_sub = F.col("parent_key").isNotNull()
    return out.select(
        "*", is_sub.alias("is_subcategory"),
        F.when(is_sub, F.col("parent_name")).otherwise(F.col("own_name")).alias("category"),
        F.when(is_sub, F.col("own_name")).alias("subcategory"),
        F.when(is_sub, F.lit("sub")).otherwise(F.lit("direct")).alias("kind"))

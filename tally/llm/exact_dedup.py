"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of code points. Sorting the
blocks gives equal blocks one integer name; then pairs of adjacent names are
sorted and named again, until each document has one name. Naming is
injective at each level, so equal (level, name) means equal texts: no hash
decides anything.

A block that many documents share is first named inside each batch of a
task, so the sort sees it once per batch and not once per document; the
global name returns through a join on the batch-local id, where no key is
hot. Pairs are combined before the shuffle, and the join that returns their
names is one Spark can split.

Cases: a null text counts as empty; an empty text is one empty block. Of
equal texts the row with the largest doc_id stays (a null doc_id is the
smallest; of repeated rows with that doc_id one stays). Extra columns are
ignored by ``exact_groups`` and returned by ``drop_exact_copies``. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import PARTITION_BITS, Staging, keep_rows, with_row_ids

BLOCK_CHARS = 2048
BATCH_ROWS = 50_000  # blocks in one Arrow batch handed back to Spark

CUT = [StructField("rid", LongType()), StructField("n", LongType()), StructField("idx", LongType()),
       StructField("lid", LongType()), StructField("sha", BinaryType()), StructField("block", StringType())]


def _cutter(size: int):
    def cut(batches):
        partition, made = TaskContext.get().partitionId() << PARTITION_BITS, 0
        for batch in batches:
            local: dict[str, int] = {}
            out: list[list] = [[] for _ in range(7)]
            for row, (rid, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = text or ""
                n = max(1, -(-len(text) // size))
                for idx in range(n):
                    block = text[idx * size:(idx + 1) * size]
                    lid = local.get(block)
                    new = lid is None
                    if new:
                        lid = local[block] = partition | made
                        made += 1
                    sha = hashlib.sha256(text.encode()).digest() if idx == 0 else None
                    for column, value in zip(out, (rid, n, idx, lid, sha, block if new else None,
                                                   row if idx == 0 else None)):
                        column.append(value)
                if len(out[0]) >= BATCH_ROWS:
                    yield _batch(out, batch)
                    out = [[] for _ in range(7)]
            yield _batch(out, batch)
    return cut


def _batch(columns: list[list], source: pa.RecordBatch) -> pa.RecordBatch:
    i = pa.int64()
    kinds = [i, i, i, i, pa.binary(), pa.string()]
    made = [pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([*made, source.column(2).take(pa.array(columns[6], i))],
                                      names=["rid", "n", "idx", "lid", "sha", "block", "doc_id"])


def _name_sorted(batches):
    """Integer names for blocks that arrive sorted: one per distinct block."""
    name, last = (TaskContext.get().partitionId() << PARTITION_BITS) - 1, None
    for batch in batches:
        names = []
        for block in batch.column(1).to_pylist():
            if block != last:
                name, last = name + 1, block
            names.append(name)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64())], names=["lid", "name"])


def _identities(rows: DataFrame, rid: str, staging: Staging, size: int) -> DataFrame:
    """One row per row of ``rows``: rid, doc_id, sha, level, name."""
    texts = rows.select(F.col(rid).alias("rid"), F.col("text").cast("string").alias("text"), "doc_id")
    schema = StructType([*CUT, StructField("doc_id", texts.schema["doc_id"].dataType)])
    cut = staging.write(texts.mapInArrow(_cutter(size), schema), "blocks")
    names = (cut.filter("block IS NOT NULL").select("lid", "block")
             .repartition("block").sortWithinPartitions("block")
             .mapInArrow(_name_sorted, "lid long, name long"))
    cells = staging.write(cut.select("rid", "n", "idx", "lid").join(names, "lid").select("rid", "n", "idx", "name"),
                          "level0")
    heads = staging.write(cut.filter("idx = 0").select("rid", "doc_id", "sha"), "heads")
    staging.drop("blocks")
    most = cells.agg(F.max("n")).first()[0] or 1
    done = cells.filter("n = 1").selectExpr("rid", "0 AS level", "name")
    for level in range(1, (most - 1).bit_length() + 1):
        pairs = (cells.filter("n > 1").groupBy("rid", "n", F.expr("idx div 2").alias("idx"))
                 .agg(F.max(F.expr("if(idx % 2 = 0, name, null)")).alias("l"),
                      F.coalesce(F.max(F.expr("if(idx % 2 = 1, name, null)")), F.lit(-1)).alias("r")))
        # Equal pairs meet in one partition and are sorted there; the number is the name. Written
        # first, so that the join has shuffles of its own and a pair that a third of all rows hold is split.
        named = staging.write(pairs.select("l", "r").distinct().sortWithinPartitions("l", "r")
                              .withColumn("name", F.monotonically_increasing_id()), "pairs")
        cells = staging.write(pairs.join(named, ["l", "r"])
                              .selectExpr("rid", "(n + 1) div 2 AS n", "idx", "name"), f"level{level}")
        done = done.union(cells.filter("n = 1").selectExpr("rid", f"{level} AS level", "name"))
    return heads.join(done, "rid")


def _decide(rows: DataFrame, rid: str, staging: Staging, size: int) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 for each row."""
    named = staging.write(_identities(rows, rid, staging, size), "named")
    # Written first, so that the join below has shuffles of its own and a hot group's is split.
    groups = staging.write(
        named.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"),
                                           F.max(F.struct("doc_id", "rid")).alias("best")), "groups")
    return staging.write(
        named.join(groups, ["level", "name"])
        .select("rid", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                (F.col("rid") == F.col("best.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")),
        "decided")


def _clean_up(staging: Staging, keep: tuple[str, ...]) -> None:
    staging.drop(*[name for name in list(staging.live) if name not in keep])


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    staging = Staging(docs.sparkSession, "exact")
    rows = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    out = _decide(rows, "rid", staging, block_chars).drop("rid")
    _clean_up(staging, ("decided",))
    return out


def drop_exact_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns unchanged."""
    staging = Staging(docs.sparkSession, "exact")
    rows, rid = with_row_ids(docs, staging)
    dropped = staging.write(_decide(rows, rid, staging, block_chars).filter("NOT kept").select("rid"), "dropped")
    _clean_up(staging, ("rows", "dropped"))
    return keep_rows(rows, rid, dropped)

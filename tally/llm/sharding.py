"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``nodes`` points of a hash ring; a key belongs to the arc that
ends at the next point clockwise. A shard takes keys until it is full; keys
that overflow a full shard continue clockwise to the next point of a shard
with room. With ``slack`` 0 the capacities sum to the number of rows, so row
counts differ by at most one (law ``rows``).

Keys of one arc go the same way round the ring, so only the count of each arc
matters for who overflows: Spark counts rows by arc (shards x nodes counts,
whatever the input), the walk round the ring assigns rank ranges of arcs to
shards, and each row finds its shard and slot from its rank within its arc.
Ranks are made in slices by a hash of the row, so a key with a third of all
rows is ranked by many tasks.

Cases: null and empty texts have size 1 and checksum 0; a null doc_id hashes
like any value; rows with one doc_id start at one arc and overflow like any
others; equal texts are not kept together (a text that a third of all rows hold
would begin at one point and move through all shards when one is added); extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import Staging, gapless_rank, slices_for

SHARDS = 16
NODES = 64
RANK_BITS = 44  # of a lookup key: arc << RANK_BITS | rank


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """Sorted (position, shard); a shard's points do not depend on the others."""
    return sorted((xxhash.xxh64_intdigest(f"{s}/{n}", 0) >> 1, s) for s in range(shards) for n in range(nodes))


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Rows that each shard takes at most."""
    if slack:
        return [-(-int(rows * (1 + slack)) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: dict[int, int], points: list[tuple[int, int]], room: list[int]) -> np.ndarray:
    """Rows (arc, first rank, shard, first slot): the arc's keys from that rank
    on go to that shard, from that slot on.

    All keys propose to the shard of their point; a shard accepts arcs in ring
    order while it has room; what it refuses goes on to the next point of a
    shard with room. Each round fills a shard or ends the walk."""
    room, used = list(room), [0] * len(room)
    waiting = [(arc, arc, 0, n) for arc, n in sorted(counts.items())]  # arc, point reached, first rank, keys
    placed = []
    while waiting:
        refused = []
        for arc, at, rank, n in waiting:
            shard = points[at][1]
            take = min(n, room[shard])
            if take:
                placed.append((arc, rank, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if n > take:
                refused.append((arc, at, rank + take, n - take))
        if not refused:
            break
        # The nearest point with room, found once per point from the far side.
        step, onward = None, [0] * len(points)
        for lap in range(2):
            for i in reversed(range(len(points))):
                onward[i] = step
                if room[points[i][1]]:
                    step = i
        waiting = [(arc, onward[at], rank, n) for arc, at, rank, n in refused]
    return np.array(placed, np.int64).reshape(-1, 4)


def shard(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = 0.0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot,
    grown_shard."""
    spark = docs.sparkSession
    staging = Staging(spark, "sharding")
    points = ring(shards, nodes)
    edges = np.array([p for p, _ in points], np.int64)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    position = F.shiftrightunsigned(F.xxhash64(F.lit("key"), F.col("doc_id")), 1)
    base = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), position.alias("position"),
                       F.monotonically_increasing_id().alias("row"))
    schema = StructType([*base.schema.fields[:3], StructField("row", LongType()), StructField("arc", IntegerType())])

    def locate(batches):
        for batch in batches:
            arc = np.searchsorted(edges, batch.column(3).to_numpy()) % len(edges)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(arc.astype(np.int32))],
                                             names=schema.names)

    keyed = staging.write(base.mapInArrow(locate, schema), "keyed")
    counts = {r["arc"]: r["n"] for r in keyed.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    spans = walk(counts, points, capacities(sum(counts.values()), shards, slack))
    keys = (spans[:, 0] << RANK_BITS) | spans[:, 1]
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[order], spans[order]))
    law = "rows" if not slack else None
    out = StructType([*schema.fields[:3], StructField("law", StringType()), StructField("shard", IntegerType()),
                      StructField("slot", LongType()), StructField("grown_shard", IntegerType())])

    def place(batches):
        keys, spans = table.value
        for batch in batches:
            arc, rank = batch.column("arc").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            span = spans[np.searchsorted(keys, (arc << RANK_BITS) | rank, side="right") - 1]
            n = len(rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([law] * n, pa.string()), pa.array(span[:, 2].astype(np.int32)),
                 pa.array(span[:, 3] + rank - span[:, 1]), pa.nulls(n, pa.int32())], names=out.names)

    ranked = gapless_rank(keyed, ["arc"], "row", slices_for(max(counts.values(), default=0))).select("doc_id", "size", "text_crc32", "arc", "rank")
    return ranked.mapInArrow(place, out)

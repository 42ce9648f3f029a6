"""Embedding near-dedup with spherical-cap filters.

Filters are the words of ``codes`` structured random product codes: a vector
(after a seeded rotation) is cut into ``blocks`` parts, each part has ``words``
random directions, and a filter is one direction per part. Several codes even
out the number of filters, which varies much between vectors in a single one. A vector belongs to every
filter whose inner product with it exceeds a threshold; list decoding finds
them block by block and drops a partial word as soon as the best words of the
remaining blocks cannot lift it over the threshold. Vectors join on (label,
filter) and pairs are verified by their cosine in double precision.

Equal vectors of a label are one node with a weight. A bucket with more than
``CHUNK`` vectors is cut into chunks by a hash and every pair of chunks is a
unit of work, so no task holds a large bucket. Pairs are never rows: a unit
multiplies matrices, counts links and returns one row per linked vector with
its count and one edge to its local component. A pair that meets in several
filters is counted in the first they share.

A code's threshold is the mean inner product of a random vector with its
``filters``-th best filter; see the README for the recall measured against
brute force.

Cases: a vector links with nothing when it or its label is null, when it is
zero, or when it holds a null or non-finite component; vectors of different
lengths do not link. Rows with one vec_id are vectors of their own; a null
vec_id is never a component's id unless all are null. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .common import Staging, components

COSINE = 0.98
CODES, BLOCKS, WORDS, FILTERS = 12, 2, 256, 3
SEED = 3
CHUNK = 1024
SMALL = 24       # buckets up to this size are verified pairwise by row offsets
DECODE_ROWS = 256


class ProductCode:
    """Rotation, block directions and threshold for one vector length."""

    def __init__(self, dim: int, blocks: int, words: int, filters: int, seed: int, number: int = 0):
        random = np.random.default_rng([seed, dim, number])
        self.rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0]
        self.parts = [p for p in np.array_split(np.arange(dim), min(blocks, dim))]
        self.words = []
        for part in self.parts:
            w = random.standard_normal((words, len(part)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(len(self.parts)))
        self.size = words ** len(self.parts)
        sample = random.standard_normal((64, dim))
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        sums = np.zeros((len(sample), 1))
        for score in self._scores(sample):
            sums = (sums[:, :, None] + score[:, None, :]).reshape(len(sample), -1)
        rank = min(filters, sums.shape[1])
        self.threshold = float(np.mean(np.partition(sums, -rank, axis=1)[:, -rank]))

    def _scores(self, unit: np.ndarray) -> list[np.ndarray]:
        return [unit[:, p] @ w.T for p, w in zip(self.parts, self.words)]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters over the threshold."""
        scores = self._scores(unit @ self.rotation)
        rest = np.cumsum([s.max(axis=1) for s in scores][::-1], axis=0)[::-1]
        row, word, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for b, score in enumerate(scores):
            wide = total[:, None] + score[row]
            more = rest[b + 1][row] if b + 1 < len(scores) else 0.0
            at, choice = np.nonzero(wide + np.reshape(more, (-1, 1)) >= self.threshold)
            row, word, total = row[at], word[at] * score.shape[1] + choice, wide[at, choice]
        return row, word


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _decoder(codes):
    def run(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            lists: list = [None] * len(dim)
            vectors = batch.column("vec")
            offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                for at in range(0, len(rows), DECODE_ROWS):
                    part = rows[at:at + DECODE_ROWS]
                    x = unit_rows(values[offsets[part][:, None] + np.arange(d)])
                    found = [code.decode(x) for code in codes.value[int(d)]]
                    row = np.concatenate([r for r, _ in found])
                    word = np.concatenate([i * code.size + w for i, (code, (_, w))
                                           in enumerate(zip(codes.value[int(d)], found))])
                    order = np.lexsort((word, row))
                    row, word = row[order], word[order].astype(np.int32)
                    for r, w in zip(part, np.split(word, np.searchsorted(row, np.arange(1, len(part))))):
                        lists[r] = w
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "filters"])
    return run


class Bucket:
    """Verified links of one unit of work."""

    def __init__(self, x, gid, weight, prior, side):
        self.x, self.gid, self.weight, self.prior, self.side = x, gid, weight, prior, side

    def links(self, cosine: float):
        """gid, links counted here, gid of the local component's first row."""
        near = self.x @ self.x.T >= cosine
        np.fill_diagonal(near, False)
        if self.side.min() != self.side.max():  # two chunks: links across only
            near &= self.side[:, None] != self.side[None, :]
        rows = np.flatnonzero(near.any(axis=1))
        near = near[np.ix_(rows, rows)]
        lists = [self.prior[r] for r in rows]
        ids, seen = np.unique(np.concatenate([*lists, np.zeros(0, np.int32)]), return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), [len(p) for p in lists])
        met = np.zeros(near.shape, bool)  # pairs that share an earlier filter
        for at in range(0, len(ids), 256):
            part = (seen >= at) & (seen < at + 256)
            member = np.zeros((len(rows), 256), np.float32)
            member[owner[part], seen[part] - at] = 1
            met |= member @ member.T > 0
        counts = (near & ~met) @ self.weight[rows]
        root = np.arange(len(rows))
        while True:
            least = np.minimum(root, np.where(near, root[None, :], len(rows)).min(axis=1, initial=len(rows)))
            least = least[least]
            if (least == root).all():
                break
            root = least
        gid = self.gid[rows]
        return gid, counts, gid[root]


def _small_links(x, group, gid, weight, prior, cosine):
    """The same for many small buckets at once; ``group`` marks equal runs."""
    a, b = [], []
    for k in range(1, SMALL):
        same = np.flatnonzero(group[k:] == group[:-k])
        if not len(same):
            break
        near = same[np.einsum("ij,ij->i", x[same], x[same + k]) >= cosine]
        for i in near.tolist():
            if not len(np.intersect1d(prior[i], prior[i + k], assume_unique=True)):
                a.append(i)
                b.append(i + k)
    return (np.concatenate([gid[a], gid[b]]), np.concatenate([weight[b], weight[a]]),
            np.concatenate([gid[b], gid[b]])) if a else None


def _verifier(cosine: float):
    names = ["gid", "links", "other"]
    keys = ("label", "dim", "filter", "lo", "hi")

    def batch_out(parts):
        columns = [np.concatenate(c) for c in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    def rows_of(table):
        t = table.combine_chunks()
        dim = t["dim"][0].as_py()
        vec, prior = t["vec"].combine_chunks(), t["prior"].combine_chunks()
        x = unit_rows(vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        cuts = np.cumsum(prior.value_lengths().to_numpy())[:-1]
        return (x, t["gid"].to_numpy(), t["weight"].to_numpy(),
                np.split(prior.flatten().to_numpy(zero_copy_only=False), cuts), t["salt"].to_numpy())

    def whole(table):
        """Results for a table of whole units, sorted by key."""
        key = [table[k].to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in key:
            change[1:] |= c[1:] != c[:-1]
        group = np.cumsum(change)
        starts = np.flatnonzero(np.append(True, change[1:]))
        sizes = np.diff(np.append(starts, table.num_rows))
        out = []
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            x, gid, weight, prior, salt = rows_of(table.slice(start, size))
            out.append(Bucket(x, gid, weight, prior, salt).links(cosine))
        small = np.repeat(sizes <= SMALL, sizes) & np.repeat(sizes > 1, sizes)
        cross = key[3] != key[4]
        for d in np.unique(key[1][small & ~cross]):
            rows = np.flatnonzero(small & ~cross & (key[1] == d))
            x, gid, weight, prior, _ = rows_of(table.take(pa.array(rows)))
            out.append(_small_links(x, group[rows], gid, weight, prior, cosine))
        for start, size in zip(starts, sizes):
            if 1 < size <= SMALL and cross[start]:
                x, gid, weight, prior, salt = rows_of(table.slice(start, size))
                out.append(Bucket(x, gid, weight, prior, salt).links(cosine))
        return [o for o in out if o is not None and len(o[0])]

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not held.num_rows:
                continue
            last = np.ones(held.num_rows, bool)  # rows of the unit that may go on in the next batch
            for k in keys:
                values = held[k].to_numpy()
                last &= values == values[-1]
            cut = int(held.num_rows - last.sum())
            if cut and (parts := whole(held.slice(0, cut))):
                yield batch_out(parts)
            held = held.slice(cut)
        if held is not None and held.num_rows and (parts := whole(held)):
            yield batch_out(parts)
    return run


def embedding_components(vectors: DataFrame, cosine: float = COSINE, codes: int = CODES, blocks: int = BLOCKS,
                         words: int = WORDS, filters: int = FILTERS, seed: int = SEED) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    if codes * words ** blocks >= 1 << 31:
        raise ValueError("too many filters")
    spark = vectors.sparkSession
    staging = Staging(spark, "embeddings")
    kind = "double" if vectors.schema["embedding"].dataType == ArrayType(DoubleType()) else "float"
    rows = staging.write(vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id",
                                        F.col("label").cast("long").alias("label"),
                                        F.col("embedding").cast(f"array<{kind}>").alias("vec")), "rows")
    finite = "forall(vec, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"
    usable = rows.filter(f"label IS NOT NULL AND size(vec) > 0 AND {finite} AND exists(vec, v -> v <> 0)")
    nodes = staging.write(usable.groupBy("label", "vec").agg(
        F.min("rid").alias("gid"), F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("weight"))
        .withColumn("dim", F.size("vec")), "nodes")
    dims = [r["dim"] for r in nodes.select("dim").distinct().collect()]  # few: lengths of embeddings
    tables = spark.sparkContext.broadcast(
        {d: [ProductCode(d, blocks, words, filters, seed, i) for i in range(codes)] for d in dims})
    schema = StructType([*nodes.select("label", "dim", "gid", "weight", "vec").schema.fields,
                         StructField("filters", ArrayType(IntegerType()))])
    # Files of the grouped nodes are few: spread the decoding over all cores.
    caps = staging.write(nodes.select("label", "dim", "gid", "weight", "vec").repartition("gid")
                         .mapInArrow(_decoder(tables), schema), "caps")
    bucket = ["label", "dim", "filter"]
    sizes = (caps.select("label", "dim", F.explode("filters").alias("filter")).groupBy(*bucket)
             .agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select(*bucket, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    members = caps.select("label", "dim", "gid", "weight", "vec", "filters", F.posexplode("filters").alias("at", "filter"))
    met = (members.join(sizes, bucket)
           .withColumn("salt", F.pmod(F.xxhash64(F.lit(seed), F.col("gid")), F.col("chunks")).cast("int"))
           .withColumn("mate", F.explode(F.expr("sequence(0, chunks - 1)")))
           .select(*bucket, F.least("salt", "mate").alias("lo"), F.greatest("salt", "mate").alias("hi"),
                   "gid", "weight", "salt", F.expr("slice(filters, 1, at)").alias("prior"), "vec"))
    unit = [*bucket, "lo", "hi"]
    linked = staging.write(met.repartition(*unit).sortWithinPartitions(*unit)
                           .mapInArrow(_verifier(cosine), "gid long, links long, other long"), "links")
    counts = linked.groupBy("gid").agg(F.sum("links").alias("links"))
    roots = components(linked.select("gid", "other"), staging)
    found = (nodes.select("label", "vec", "gid", "least_id", "weight").join(counts, "gid", "left")
             .join(roots.withColumnRenamed("node", "gid"), "gid", "left")
             .select("label", "vec", "least_id", F.coalesce("root", "gid").alias("root"),
                     (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    least = found.groupBy("root").agg(F.min("least_id").alias("component"))
    named = staging.write(found.join(least, "root").select("label", "vec", "n_links", "component"), "named")
    out = (rows.join(named, ["label", "vec"], "left")
           .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                   F.coalesce("component", "vec_id").alias("component_id")))
    staging.drop("nodes", "caps", "links", "edges")
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""SimHash near-dedup by a segment-popcount embedding.

Fingerprint: texts are lower-cased (A-Z), cut into words at ASCII white
space and into shingles of ``words`` words; each shingle is hashed with XXH64
(seed 42) and a bit is 1 if it is set in over half the hashes.

Search: a fingerprint is cut into segments of three bits; its bit counts per
segment form a vector. The Manhattan distance of two vectors is a lower
bound of the bit distance of the fingerprints. On the integer grid, two
vectors at most ``max_bits`` apart have a common grid point at most half as
far from both, so each fingerprint joins the grid points (cells) around its own
vector; fingerprints meet in the cells that they share, and nowhere else.

Verification inside a cell is exact and needs no pairs: two fingerprints differ
in at most ``max_bits`` bits if and only if some 64-bit value differs from both in
at most half as many, and the vector of that value is a cell they share. So a
fingerprint takes to each shared cell those values whose vector the cell is. All
fingerprints that meet at one are within ``max_bits`` of each other, and each is
linked to the least of them. A group of thousands of near copies then costs its
size, not its square.

Cases: null and empty texts, and texts of white space alone, have the
fingerprint zero, which links like any other; fewer words than a shingle
count as one shingle. Equal fingerprints are one node. A component's id is
its smallest doc_id, nulls left out. Repeated rows all appear in
``simhash_components``; ``drop_near_copies`` keeps one row of each component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Staging, components, keep_rows, with_row_ids

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
SEGMENT_BITS = 3
SEGMENTS = -(-64 // SEGMENT_BITS)
BASE = SEGMENT_BITS + 3  # a count, one step beyond either end: digits of a packed vector
PIECE_BYTES = 1 << 20  # a long text is hashed in pieces, words kept whole


def _pieces(data: bytes):
    """Word lists of ``data``, about PIECE_BYTES at a time."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[size - 1:].tolist())),
                       np.uint64, n)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint as a signed integer."""
    data = (text or "").encode().lower()
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for words in _pieces(data):
        words = tail + words
        if len(words) >= size:
            hashes = _hashes(words, size)
            counts += _bit_counts(hashes)
            total += len(hashes)
            tail = words[len(words) - size + 1:]
        else:
            tail = words
    if not total and tail:
        counts, total = _bit_counts(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)), 1
    packed = np.packbits((2 * counts > total).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def _fingerprints(docs: DataFrame, rid: str, size: int) -> DataFrame:
    texts = docs.select(F.col(rid).alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([StructField("rid", LongType()), texts.schema["doc_id"], StructField("fp", LongType())])

    def run(batches):
        for batch in batches:
            prints = [fingerprint(text, size) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())],
                                             names=schema.names)
    return texts.mapInArrow(run, schema)


def _steps(radius: int) -> list[tuple[int, list[int], bool]]:
    """The grid points around a vector at Manhattan distance <= radius (0 or 1):
    the packed step, and what turns a fingerprint into one whose vector is there:
    masks of single bits, and whether such a bit must be set before."""
    steps: list[tuple[int, list[int], bool]] = [(0, [0], False)]
    for i in range(SEGMENTS if radius else 0):
        bits = [1 << b for b in range(SEGMENT_BITS * i, min(64, SEGMENT_BITS * (i + 1)))]
        masks = [b - (1 << 64) if b >> 63 else b for b in bits]
        steps += [(BASE ** i, masks, False), (-BASE ** i, masks, True)]
    return steps


def near_edges(prints: DataFrame, max_bits: int, staging: Staging | None = None) -> DataFrame:
    """Edges ``u, v`` that connect exactly the fingerprints (distinct ``fp``)
    that chains of at most ``max_bits`` differing bits connect."""
    if max_bits not in (0, 2):
        raise ValueError("max_bits: 0 or 2")
    steps = _steps(max_bits // 2)
    low = (1 << SEGMENT_BITS) - 1
    vector = " + ".join(f"(bit_count(shiftrightunsigned(fp, {SEGMENT_BITS * i}) & {low}) + 1) * {BASE ** i}L"
                        for i in range(SEGMENTS))
    around = F.posexplode(F.array(*[F.lit(s).cast("long") for s, _, _ in steps])).alias("step", "by")
    cells = (prints.select("fp", F.expr(vector).alias("vec")).select("fp", around, "vec")
             .select("fp", "step", (F.col("vec") + F.col("by")).alias("cell")))
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    if staging is not None:  # written first, so that the join has shuffles of its own and a hot cell's is split
        shared = staging.write(shared, "shared")
    # Range join: fingerprints meet in the cells they share, and nowhere else.
    met = cells.join(shared.hint("merge"), "cell", "left_semi")
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in ms]) for _, ms, _ in steps])
    was_set = F.array(*[F.lit(w) for _, _, w in steps])
    points = (met.select("fp", "cell", F.element_at(was_set, F.col("step") + 1).alias("was"),
                         F.explode(F.element_at(masks, F.col("step") + 1)).alias("mask"))
              .filter("((fp & mask) <> 0) = was").selectExpr("fp", "cell", "fp ^ mask AS point"))
    # Exact check inside a cell: its points one bit from both sides.
    least = points.groupBy("cell", "point").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).filter("v <> w")
    least = least.select("cell", "point", "v")
    if staging is not None:
        least = staging.write(least, "least")
    return points.join(least, ["cell", "point"]).filter("fp <> v").select(F.col("fp").alias("u"), "v")


def _components(docs: DataFrame, rid: str, staging: Staging, size: int, max_bits: int) -> DataFrame:
    """rid, doc_id, fp, component_id, kept_rid for each row."""
    rows = staging.write(_fingerprints(docs, rid, size), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    prints = staging.write(rows.groupBy("fp").agg(first), "distinct")
    linked = components(near_edges(prints.select("fp"), max_bits, staging), staging)
    roots = (prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
             .select("fp", F.coalesce("root", "fp").alias("root"), "first"))
    best = roots.groupBy("root").agg(F.min("first").alias("best"))
    named = staging.write(roots.join(best, "root").select("fp", "best"), "named")
    out = staging.write(rows.join(named, "fp").select(
        "rid", "doc_id", "fp", F.col("best.doc_id").alias("component_id"), F.col("best.rid").alias("kept_rid")),
        "components")
    staging.drop("prints", "distinct", "shared", "least", "edges", "named")
    return out


def simhash_components(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    staging = Staging(docs.sparkSession, "simhash")
    rows = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    out = _components(rows, "rid", staging, words, max_bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row (the smallest doc_id) of each component."""
    staging = Staging(docs.sparkSession, "simhash")
    rows, rid = with_row_ids(docs, staging)
    groups = _components(rows, rid, staging, words, max_bits)
    dropped = staging.write(groups.filter("rid <> kept_rid").select("rid"), "dropped")
    staging.drop("components")
    return keep_rows(rows, rid, dropped)

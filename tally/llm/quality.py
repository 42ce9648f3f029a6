"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted: the target's over
labelled good documents, the raw one over all documents. A document's log
weight is the sum over its n-grams of log(target / raw), and documents are
sampled without replacement by Gumbel top-k: the k largest sums of log weight
and a hash-seeded Gumbel number, which draws k documents with probabilities in
proportion to their weights.

N-grams: words and punctuation runs (one-grams), pairs of adjacent ones, and
pairs of adjacent word classes (two-grams); a class is the case or kind of a word, or the punctuation
run itself, and whether the word repeats the one before it.

The target model and the cut are fitted on at most ``fit_rows`` labelled rows,
those with the smallest hashes of doc_id (three of four for the model, the
rest for the cut, or all where the rest lack good or bad ones); that is the
only sample. Raw counts,
weights, k and the selection cover every document. Unless given, k is the
number of documents whose log weight is above the cut that tells good from bad
labelled rows best.

Cases: null and empty texts have log weight 0. Labels with a null doc_id or
quality, and doc_ids with contradicting labels, do not count. Without good
labels, or without bad ones, every document is kept. Of equal keys the later
rows stay; repeated rows are judged each. Extra columns are ignored by
``importance_weights`` and returned by ``keep_resampled``. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import Staging, keep_rows, per_worker, with_row_ids
from .token_counts import groups_of

BUCKETS = 1 << 12  # for words, as many for pairs of classes and as many for pairs of words
GRAMS = 3          # kinds of n-grams
PRIME = (1 << 31) - 1
FIT_ROWS = 20_000
PRIOR = 100_000.0  # n-grams of the raw model mixed into the target model
SEED = 11
GROUP_CHARS = 1 << 19
CACHE_ENTRIES = 200_000
CUT_STEPS = 64  # of the cut's grid, per unit of log(1 + |weight|)


class Features(dict):
    """token -> class << 32 | hash, made on first use."""

    words = re.compile(r"\w+|[^\w\s]+")

    def __missing__(self, token: str) -> int:
        if token.isupper() and len(token) > 1:
            kind = 1
        elif token[0].isupper():
            kind = 2
        elif token.isalpha():
            kind = 3
        elif token.isdigit():
            kind = 4
        elif token[0].isalnum():
            kind = 5
        else:
            kind = 8 + zlib.crc32(token.encode()) % 4096
        made = kind << 32 | zlib.crc32(token.encode())
        if len(token) < 64:
            if len(self) > CACHE_ENTRIES:
                self.clear()
            self[token] = made
        return made

    def grams(self, texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams of ``texts``, and the text of each."""
        tokens = [self.words.findall(t) for t in texts]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        packed = np.fromiter((self[t] for ts in tokens for t in ts), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        word, kind = packed & 0xFFFFFFFF, 2 * (packed >> 32)
        inner = owner[1:] == owner[:-1]
        kind[1:] += inner & (word[1:] == word[:-1])
        pair = (kind[:-1] * 7919 + kind[1:] + 17) * 2654435761 % 4294967291
        both = (word[:-1] * 7919 + word[1:]) % PRIME * 48271 % PRIME
        return (np.concatenate([word % buckets, buckets + pair[inner] % buckets, 2 * buckets + both[inner] % buckets]),
                np.concatenate([owner, owner[1:][inner], owner[1:][inner]]))


def _counts(texts: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts by bucket; ``texts`` has text and good (0/1)."""
    def run(batches):
        features, totals = per_worker(("features",), Features), np.zeros((2, GRAMS * buckets), np.int64)
        for batch in batches:
            texts, good = [t or "" for t in batch.column(0).to_pylist()], np.array(batch.column(1).to_pylist(), bool)
            at = 0
            for group in groups_of(texts, GROUP_CHARS):
                grams, owner = features.grams(group, buckets)
                totals[0] += np.bincount(grams, minlength=GRAMS * buckets)
                totals[1] += np.bincount(grams[good[at:at + len(group)][owner]], minlength=GRAMS * buckets)
                at += len(group)
        seen = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[0][seen]), pa.array(totals[1][seen])],
                                         names=["bucket", "raw", "target"])

    rows = (texts.mapInArrow(run, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))).collect()
    totals = np.zeros((2, GRAMS * buckets), np.int64)  # at most one row per bucket came back
    for r in rows:
        totals[:, r["bucket"]] = r["raw"], r["target"]
    return totals[0], totals[1]


def _scores(texts: DataFrame, ratio: np.ndarray) -> DataFrame:
    table = texts.sparkSession.sparkContext.broadcast(ratio)
    schema = StructType([*texts.schema.fields[1:], StructField("log_weight", DoubleType())])

    def run(batches):
        features, ratio = per_worker(("features",), Features), table.value
        for batch in batches:
            weights = []
            for group in groups_of([t or "" for t in batch.column(0).to_pylist()], GROUP_CHARS):
                grams, owner = features.grams(group, len(ratio) // GRAMS)
                weights.append(np.bincount(owner, weights=ratio[grams], minlength=len(group)))
            values = np.concatenate([np.zeros(0), *weights])  # doubles, also where no text has an n-gram
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values)], names=schema.names)
    return texts.mapInArrow(run, schema)


def _best_cut(scored: DataFrame) -> float:
    """The cut with the fewest errors on held-out labelled rows, or on all
    sampled ones where the held-out lack good or bad ones; of equal cuts the
    middle of the widest span. Rows are counted on a grid first."""
    scored = scored.filter("good IS NOT NULL")
    step = F.round(F.signum("log_weight") * F.log1p(F.abs("log_weight")) * CUT_STEPS).cast("int")
    rows = (scored.groupBy(step.alias("step"), "fits")
            .agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")).collect())
    held = [r for r in rows if not r["fits"]]
    if not 0 < sum(r["good"] for r in held) < sum(r["n"] for r in held):
        held = rows
    counts = defaultdict(lambda: [0, 0])
    for r in held:
        counts[r["step"]][0] += r["good"]
        counts[r["step"]][1] += r["n"] - r["good"]
    steps = sorted((at, good, bad) for at, (good, bad) in counts.items())
    errors = sum(bad for _, _, bad in steps)
    if not errors:
        return -np.inf
    cuts = []  # (errors, span, lower step, upper step) with the cut between two steps
    for (a, good, bad), (b, _, _) in zip(steps, steps[1:]):
        errors += good - bad
        cuts.append((errors, a - b, a, b))
    if not cuts:
        return -np.inf
    _, _, a, b = min(cuts)
    middle = (a + b) / 2 / CUT_STEPS
    return float(np.sign(middle) * np.expm1(abs(middle)))


def _kth_largest(df: DataFrame, column: str, k: int, bins: int):
    """(value, left): all rows above ``value`` and ``left`` of those that have
    it make the ``k`` largest. (None, 0) where there are no more than k rows."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low is not None:
        width = float(high - low) / bins
        cell = F.floor((F.col(column) - F.lit(low)).cast("double") / F.lit(width or 1.0))
        cells = (df.filter(F.col(column).between(low, high)).groupBy(F.least(cell, F.lit(bins - 1)).alias("cell"))
                 .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect())
        for r in sorted(cells, key=lambda r: -r["low"]):
            if r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
        else:
            break
        if low == high:
            return low, k
    return None, 0


def top_k(df: DataFrame, k: int, key: str, tie: str, bins: int = 1024) -> Column:
    """A condition that holds for exactly the ``k`` rows with the largest
    ``key``, of equal keys those with the largest ``tie`` (a unique long).

    The k-th row is found by counting rows in ever narrower ranges; at most
    ``bins`` counts reach the driver each time."""
    if k <= 0:
        return F.lit(False)
    value, left = _kth_largest(df, key, k, bins)
    if value is None:
        return F.lit(True)
    last, _ = _kth_largest(df.filter(F.col(key) == F.lit(value)), tie, left, bins)
    return (F.col(key) > F.lit(value)) | ((F.col(key) == F.lit(value)) & (F.col(tie) >= F.lit(last)))


def _judge(rows: DataFrame, rid: str, labels: DataFrame, staging: Staging, k: int | None, fit_rows: int,
           buckets: int, seed: int) -> DataFrame:
    """rid, doc_id, log_weight, key, kept for each row."""
    known = (labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg(F.min(F.col("quality").cast("int")).alias("good"), F.max(F.col("quality").cast("int")).alias("most"))
             .filter("good = most").select("doc_id", "good"))
    # At most fit_rows rows of two numbers, so this side is broadcast.
    sample = (known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
              .withColumn("fits", F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(4)) > 0))
    texts = rows.select(F.col("text").cast("string").alias("text"), F.col(rid).alias("rid"), "doc_id")
    labelled = texts.join(F.broadcast(sample), "doc_id", "left").select("text", "rid", "doc_id", "good", "fits")
    good = F.coalesce((F.col("good") == 1) & F.col("fits"), F.lit(False))
    raw, target = _counts(labelled.select("text", good.cast("int").alias("good")), buckets)
    share = (raw + 1.0) / (raw.sum() + len(raw))
    ratio = np.log((target + PRIOR * share) / (target.sum() + PRIOR)) - np.log(share)
    uniform = (F.expr(f"shiftrightunsigned(xxhash64({seed}, doc_id), 11)").cast("double") + 0.5) / F.lit(2.0 ** 53)
    scored = staging.write(_scores(labelled.select("text", "rid", "doc_id", "good", "fits"), ratio)
                           .withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "scored")
    if k is None:
        cut = _best_cut(scored) if target.any() else -np.inf
        k = scored.filter(F.col("log_weight") > F.lit(cut)).count()
    return scored.select("rid", "doc_id", "log_weight", "key", top_k(scored, k, "key", "rid").alias("kept"))


def importance_weights(docs: DataFrame, labels: DataFrame, k: int | None = None, fit_rows: int = FIT_ROWS,
                       buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, log_weight, key, kept."""
    rows = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    return _judge(rows, "rid", labels, Staging(docs.sparkSession, "quality"), k, fit_rows, buckets, seed).drop("rid")


def keep_resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, fit_rows: int = FIT_ROWS,
                   buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The documents that importance resampling keeps; columns unchanged."""
    staging = Staging(docs.sparkSession, "quality")
    rows, rid = with_row_ids(docs, staging)
    judged = _judge(rows, rid, labels, staging, k, fit_rows, buckets, seed)
    dropped = staging.write(judged.filter("NOT kept").select("rid"), "dropped")
    staging.drop("scored")
    return keep_rows(rows, rid, dropped)

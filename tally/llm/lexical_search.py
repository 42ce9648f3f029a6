"""Ranked lexical search with pair-bound MaxScore.

The documents are read once into a staged index: one row per document with
its number of terms and the counts of the terms that some item holds. Over it
three passes run, each a task per part of the index:

* statistics: N, L and the document frequency of each term;
* bounds: for each term its ``k`` largest contributions to a score, and for
  each pair of terms that are neighbours in an item's order (by weight) the
  ``k`` largest joint contributions of the documents in the intersection of
  their postings. The largest ones are impact bounds; the k-th of any list is
  a score that k documents reach, so it starts the item's threshold;
* search: each task takes its documents batch by batch and keeps the best
  ``k`` per item. ``bound[i]`` is the most that an item's ``i`` lightest terms
  can add: the cheapest way to cut them into single terms (their maximum) and
  neighbouring pairs (their joint maximum, or that of either term alone).
  Terms whose bound is under the threshold are not searched; a document found
  by the others is dropped as soon as it can no longer reach the threshold.

Nothing is approximate: only documents that cannot reach the threshold are
skipped, and those that just reach it are kept for the tie by ``doc_id``.

Items are a query set: they are cut into blocks by a hash, about ``BLOCK_CHARS``
characters each, so the term table that a task holds has a bound, and each
block is searched in all documents. At most ``k`` rows per item and task are
shuffled, and ``k`` per term and pair in the bounds pass.

Cases: a null or empty text has no terms and does not count in N; an item
without terms, or whose terms no document holds, gives no rows; very long
texts are read in parts, whole; repeated documents and items are ranked each
as a row of its own; ties go to the smaller doc_id, null last; other columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Staging

BEST = 10
BLOCK_CHARS = 1 << 20   # characters of items searched at once
PART_BYTES = 1 << 22    # of a long text, read at once

# A term is a run of ASCII letters, digits and characters beyond ASCII, whose
# UTF-8 bytes are all over 0x7F; only A-Z are lower-cased.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes):
    """Lists of the terms of a text, part by part."""
    text = text.translate(FOLD)
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + PART_BYTES)
        yield text[at:cut if cut >= 0 else len(text)].split()
        at = cut if cut >= 0 else len(text)


class Items:
    """Terms of one block of items, in each item's order once weights are known."""

    def __init__(self, texts: list[bytes]):
        self.ids: dict[bytes, int] = {}
        self.terms = [np.array(sorted({self.ids.setdefault(t, len(self.ids)) for part in terms_of(text) for t in part}),
                               np.int64) for text in texts]
        self.pairs: dict[tuple[int, int], int] = {}

    def weigh(self, documents: int, frequency: dict[int, int]) -> np.ndarray:
        """Weights by term; sorts each item's terms and names its pairs."""
        weights = np.zeros(len(self.ids), np.int64)
        for t, df in frequency.items():
            weights[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        self.terms = [found[np.lexsort((found, weights[found]))]
                      for found in (terms[np.isin(terms, list(frequency))] for terms in self.terms)]
        for terms in self.terms:
            for pair in zip(terms[:-1].tolist(), terms[1:].tolist()):
                self.pairs.setdefault(pair, len(self.ids) + len(self.pairs))
        return weights

    def bounds(self, most: dict[int, int]) -> list[np.ndarray]:
        """For each item, the most that its i lightest terms can add, i from 0."""
        out = []
        for terms in self.terms:
            bound = [0]
            for i, t in enumerate(terms.tolist()):
                least = bound[i] + most[t]
                if i:
                    before = int(terms[i - 1])
                    joint = max(most[before], most[t], most.get(self.pairs[before, t], 0))
                    least = min(least, bound[i - 1] + joint)
                bound.append(least)
            out.append(np.array(bound, np.int64))
        return out

    def thresholds(self, reached: dict[int, int]) -> list[int]:
        """For each item, a score that k documents reach."""
        return [max([0, *(reached.get(t, 0) for t in terms.tolist()),
                     *(reached.get(self.pairs[p], 0) for p in zip(terms[:-1].tolist(), terms[1:].tolist()))])
                for terms in self.terms]


class Postings:
    """Documents and contributions of each term in one batch of the index."""

    def __init__(self, batch, weights: np.ndarray, documents: int, total: int):
        n = batch.column("n").to_pylist()
        term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
        doc = np.repeat(np.arange(len(n)), batch.column("terms").value_lengths().to_numpy())
        length = np.array([8 * (100 - 90 + 90 * x * documents // total) for x in n], np.int64)
        order = np.argsort(term, kind="stable")
        term, tf, self.doc = term[order], tf[order], doc[order]
        self.gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + length[self.doc]))
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        self.size = len(n)

    def __getitem__(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.start[term], self.start[term + 1])
        return self.doc[part], self.gain[part]

    def joint(self, a: int, b: int, space: np.ndarray) -> np.ndarray:
        """Joint contributions in the documents that hold both terms."""
        (doc_a, gain_a), (doc_b, gain_b) = self[a], self[b]
        if not len(doc_a) or not len(doc_b):
            return gain_a[:0]
        space[doc_a] = gain_a + 1
        found = space[doc_b]
        space[doc_a] = 0
        return (found + gain_b - 1)[found > 0]

    def scores(self, terms: np.ndarray, bound: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that reach the threshold, and their scores."""
        light = int(np.searchsorted(bound, threshold, "left")) - 1  # terms that cannot reach it together
        light = max(light, 0)
        total = np.zeros(self.size, np.int64)
        for t in terms[light:].tolist():
            doc, gain = self[t]
            total[doc] += gain
        found = np.flatnonzero(total)
        for i in range(light, 0, -1):
            found = found[total[found] + bound[i] >= threshold]
            if not len(found):
                break
            doc, gain = self[int(terms[i - 1])]
            at = np.searchsorted(doc, found)
            hit = at < len(doc)
            hit[hit] = doc[at[hit]] == found[hit]
            total[found[hit]] += gain[at[hit]]
        found = found[total[found] >= max(threshold, 1)]
        return found, total[found]


def _indexer(ids):
    def run(batches):
        lookup = ids.value.get
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                counts, size = Counter(), 0
                for part in terms_of(text or b""):
                    size += len(part)
                    counts.update(map(lookup, part))
                counts.pop(None, None)
                n.append(size)
                terms.append(list(counts))
                tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array(n, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["rid", "doc_id", "n", "terms", "tfs"])
    return run


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, len(values) - k)[-k:] if len(values) > k else values


def _bounder(shared, k: int):
    def run(batches):
        pairs, weights, documents, total = shared.value
        best: dict[int, np.ndarray] = {}

        def hold(unit: int, gains: np.ndarray) -> None:
            if len(gains):
                best[unit] = _largest(np.concatenate([best[unit], gains]) if unit in best else gains, k)

        for batch in batches:
            postings = Postings(batch, weights, documents, total)
            space = np.zeros(postings.size, np.int64)
            for t in np.flatnonzero(np.diff(postings.start)).tolist():
                hold(t, postings[t][1])
            for (a, b), unit in pairs.items():
                hold(unit, postings.joint(a, b, space))
        if best:
            units = np.repeat(np.fromiter(best, np.int64, len(best)), [len(v) for v in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(units), pa.array(np.concatenate(list(best.values())))],
                                             names=["unit", "gain"])
    return run


def _searcher(shared, k: int):
    names = ["item", "rid", "doc_id", "score"]

    def run(batches):
        item_terms, weights, documents, total, bounds, thresholds = shared.value
        thresholds = list(thresholds)
        best: list = [None] * len(thresholds)  # per item: score, doc_id missing, doc_id, rid
        for batch in batches:
            postings = Postings(batch, weights, documents, total)
            rid = batch.column("rid").to_numpy()
            missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc_id = batch.column("doc_id").fill_null(0).to_numpy()
            for i, terms in enumerate(item_terms):
                found, score = postings.scores(terms, bounds[i], thresholds[i])
                if not len(found):
                    continue
                mine = (score, missing[found], doc_id[found], rid[found])
                if best[i] is not None:
                    mine = tuple(map(np.concatenate, zip(best[i], mine)))
                order = np.lexsort((mine[3], mine[2], mine[1], -mine[0]))[:k]
                best[i] = tuple(c[order] for c in mine)
                if len(order) == k:
                    thresholds[i] = max(thresholds[i], int(best[i][0][-1]))
        for i, held in enumerate(best):
            if held is not None:
                score, missing, doc_id, rid = held
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), i, np.int64)), pa.array(rid), pa.array(doc_id, mask=missing),
                     pa.array(score)], names=names)
    return run


def _search_block(index_rows: DataFrame, block: list, staging: Staging, k: int) -> DataFrame | None:
    """item (place in the block), rank, doc_id, score."""
    context = index_rows.sparkSession.sparkContext
    items = Items([bytes(r["text"] or b"") for r in block])
    if not items.ids:
        return None
    ids = context.broadcast(items.ids)
    index = staging.write(index_rows.mapInArrow(
        _indexer(ids), "rid long, doc_id long, n long, terms array<int>, tfs array<long>").filter("n > 0"), "index")
    documents, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    frequency = {r["term"]: r["df"] for r in counts.collect()}  # at most the block's terms
    if not frequency:
        return None
    weights = items.weigh(documents, frequency)
    shared = context.broadcast((items.pairs, weights, documents, total))
    top = Window.partitionBy("unit").orderBy(F.desc("gain"))
    lists = (index.mapInArrow(_bounder(shared, k), "unit long, gain long")
             .withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k)
             .groupBy("unit").agg(F.max("gain").alias("most"), F.min("gain").alias("least"),
                                  F.count(F.lit(1)).alias("held"))).collect()  # one row per term and pair
    most = {r["unit"]: r["most"] for r in lists}
    reached = {r["unit"]: r["least"] for r in lists if r["held"] == k}
    shared = context.broadcast((items.terms, weights, documents, total, items.bounds(most), items.thresholds(reached)))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rid")
    return (index.mapInArrow(_searcher(shared, k), "item long, rid long, doc_id long, score long")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item", "rank", "doc_id", "score"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    staging = Staging(spark, "search")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    asked = staging.write(items.select(F.monotonically_increasing_id().alias("row"), "item_id",
                                       F.col("text").cast("string").cast("binary").alias("text")), "items")
    chars = asked.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    id_type = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    for b in range(blocks):
        block = asked.filter(F.col("block") == b).select("item_id", "text").collect()
        best = _search_block(rows, block, staging, k) if block else None
        if best is None:
            continue
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item long, item_id {id_type}")
        best = best.join(names, "item").select("item_id", "rank", "doc_id", "score")
        # More blocks reuse the index's place, so a block is finished before the next begins.
        out = best if blocks == 1 else out.unionByName(staging.write(best, f"found-{b}"))
    return out

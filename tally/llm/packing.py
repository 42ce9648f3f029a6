"""Bulk-synchronous best-fit packing of token sequences.

Documents become ids (the tokenizer's, then an end id) and pieces of at most
``capacity`` ids. Pieces are range-sorted by length: a piece's rank among
those of its length is its place in the sort. Pieces of one length are
interchangeable, and so are open sequences with one gap, so both sides of a
sweep are runs: (length, first rank, count) and (gap, first sequence, count).

A sweep takes the longest run left, finds its successor among the gaps (the
smallest that holds it), matches both runs rank by rank (of more pieces than
gaps the first ranks win, the others go to the next gap), updates the gaps
and repeats; pieces that fit no gap open sequences. The runs number at most
``capacity`` however many documents there are: they are counted by Spark, and
only the runs, never documents, are matched on the driver. The resulting
table (length, ranks) -> (sequences, offset) goes back to the executors,
which place each piece by its rank. One length may hold a third of all
pieces: ranks are made in slices (``gapless_rank``).

Cases: a null or empty text is a document of the end id alone; repeated rows
are packed each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import bisect
import itertools
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import PARTITION_BITS, Staging, gapless_rank, per_worker, slices_for
from .token_counts import LONG_CHARS, groups_of, parts_of

CAPACITY = 2048
END_ID = 0
CACHE_ENTRIES = 1_000_000
CACHED_CHARS = 64
CALL_WORDS = 500
TAILS = frozenset(".,:;!?")
GROUP_CHARS = 1 << 21
RANK_BITS = 44  # of a placement key: length << RANK_BITS | rank


class WordIds:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer composes (NFC), lower-cases character by character, drops
    white space and never joins what that separates, so the ids of a text are
    those of its lower-cased words. A word's ids are made by the library, many
    words in one call with a special token between them, and kept in a bounded
    table. A text that is not composed, or holds a capital sigma (whose lower
    case depends on its place in Python) or ``<|`` goes to the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer, normalizers
        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        special = next(t for t in self.whole.get_added_tokens_decoder().items() if t[1].special)
        self.between, self.cut = special[1].content, np.array([special[0]], "<u4").tobytes()
        self.table: dict[str, bytes] = {"": b""}

    def _learn(self, new: set[str]) -> None:
        # A mark after a letter is a pre-token of its own, so ids of a word with one are those of both.
        marked = [w for w in new if w[-1] in TAILS and w[-2:-1].isalpha()]
        plain = new.difference(marked)
        plain.update(w[:-1] for w in marked if w[:-1] not in self.table)
        plain.update(t for t in TAILS if t not in self.table)
        ask = list(plain)
        for at in range(0, len(ask), CALL_WORDS):
            call = ask[at:at + CALL_WORDS]
            ids = self.words.encode_batch_fast([self.between.join(call)], add_special_tokens=False)[0].ids
            # Ids are below 2**16, so the special id's bytes occur only where that id is.
            self.table.update(zip(call, np.array(ids, "<u4").tobytes().split(self.cut)))
        for w in marked:
            self.table[w] = self.table[w[:-1]] + self.table[w[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [unicodedata.is_normalized("NFC", t) and "\u03a3" not in t and "<|" not in t for t in texts]
        flat: list[str] = []
        ends = []
        whole: dict[int, bytes] = {}
        for i, (text, p) in enumerate(zip(texts, plain)):
            if not p:
                whole[i] = self._whole(text)
            elif len(text) > LONG_CHARS and len(parts := list(parts_of(text, LONG_CHARS))) > 1:
                whole[i] = b"".join(self.encode([part])[0] for part in parts)
            else:
                flat += text.lower().replace("\n", " ").split(" ")
            ends.append(len(flat))
        ids = list(map(self.table.get, flat))
        missing = [i for i, v in enumerate(ids) if v is None]
        new = {flat[i] for i in missing}
        if new:
            self._learn(new)
        for i in missing:
            ids[i] = self.table[flat[i]]
        out = [whole[i] if i in whole else b"".join(ids[a:b]) for i, (a, b) in enumerate(zip([0, *ends], ends))]
        for word in new:
            if len(word) > CACHED_CHARS:
                self.table.pop(word, None)
                self.table.pop(word[:-1], None)
        if len(self.table) > CACHE_ENTRIES:  # frequent words came first, so the older half stays
            self.table = dict(itertools.islice(self.table.items(), CACHE_ENTRIES // 2))
        return out

    def _whole(self, text: str) -> bytes:
        ids = self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, key (unique)."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([texts.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()),
                         StructField("length", LongType()), StructField("ids_crc32", LongType()),
                         StructField("key", LongType())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        words = per_worker(("word ids", tokenizer_path), lambda: WordIds(tokenizer_path))
        key = TaskContext.get().partitionId() << PARTITION_BITS
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            row = 0
            for group in groups_of([t or "" for t in batch.column(1).to_pylist()], GROUP_CHARS):
                for ids in words.encode(group):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append(row)
                        piece.append(i)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                    row += 1
            i64 = pa.int64()
            keys = pa.array(range(key, key + len(rows)), i64)
            key += len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, i64)), pa.array(piece, pa.int32()), pa.array(start, i64),
                 pa.array(length, i64), pa.array(crc, i64), keys], names=schema.names)
    return texts.mapInArrow(run, schema)


def match_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit over runs, longest first. ``counts``: pieces by length.

    Returns int64 rows (length, first rank, first sequence, offset): the
    pieces of that length from that rank on, up to the next row's rank, go to
    consecutive sequences at that offset."""
    gaps: list[int] = []                        # sorted, those with open sequences
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
    placed: list[tuple[int, int, int, int]] = []
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in open_at:
                open_at[gap] = []
                bisect.insort(gaps, gap)
            open_at[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect.bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                first, n = open_at[gap].pop()
                if not open_at[gap]:
                    del open_at[gap], gaps[i]
                take = min(n, left)
                placed.append((length, rank, first, capacity - gap))
                leave(gap - length, first, take)
                leave(gap, first + take, n - take)
                rank, left = rank + take, left - take
                continue
            fit = capacity // length  # no gap holds it: open sequences
            for each, n in ((fit, left // fit), (left % fit, 1)):
                if each and n:
                    for j in range(each):
                        placed.append((length, rank, opened, j * length))
                        rank += n
                    leave(capacity - each * length, opened, n)
                    opened += n
            left = 0
    return np.array(placed, np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    spark = docs.sparkSession
    staging = Staging(spark, "packing")
    cut = staging.write(pieces(docs, tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = match_runs(counts, capacity)
    keys = (runs[:, 0] << RANK_BITS) | runs[:, 1]
    order = np.argsort(keys)
    table = spark.sparkContext.broadcast((keys[order], runs[order]))
    schema = StructType([*cut.schema.fields[:5], StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches):
        keys, runs = table.value
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            run = runs[np.searchsorted(keys, (length << RANK_BITS) | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(run[:, 2] + rank - run[:, 1]), pa.array(run[:, 3])], names=schema.names)

    ranked = gapless_rank(cut, ["length"], "key", slices_for(max(counts.values(), default=0))).select(*cut.columns[:5], "rank")
    return ranked.mapInArrow(place, schema)

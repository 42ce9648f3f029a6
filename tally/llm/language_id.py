"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: for every context of 0 to
``ORDER`` bytes, how often each byte followed it. A byte is coded in the longest
context that is known; where it never followed there, an escape is coded and
the next shorter context codes it, without the bytes that the longer one has
(exclusion). With n counts and d different bytes in a context, a byte with
count c has the probability c / (n + d) and the escape d / (n + d), n and d
without excluded bytes; under all contexts the bytes left are equally likely.
The statistics are frozen before any text is scored, so a byte's code length
depends on the ``ORDER + 1`` bytes that end with it and on nothing else. A
document's code length is the exact sum over all its bytes; the language with
the shortest wins (of equal ones the first by name) and ``score`` is its share
of the probability, 2 ** -length, of all languages.

Statistics are counted over the whole texts of all learning documents: windows
of ``ORDER + 1`` bytes are counted in numpy per task, summed by Spark, and summed
again to the shorter ones. The trees that workers hold have at most ``capacity``
entries in all, an equal share for each language: an entry is kept if its count
is at least the smallest power of two for which its language's fit. A longer
entry's count is never over that of its suffix, so what is kept is a tree. Code lengths of windows are kept in a
bounded table per worker, since few windows make up most of a text.

A text is coded after ``ORDER`` line breaks. Documents learn if their doc_id and
lang are not null and ``crc32(doc_id as text) mod 4`` is not 2; lang, source and
doc_id are not used in a prediction.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is
every text where no language was learned (one without any kept entry is not); a null doc_id is not held out and
does not learn; very long texts are counted and coded in parts, whole; repeated
rows are learned from and judged each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import Staging, per_worker

ORDER = 4
CAPACITY = 1 << 18      # entries of all languages' trees
GROUP_BYTES = 1 << 19   # of text coded at once
HELD_ROWS = 1 << 18     # counted windows that a task holds
TABLE_CELLS = 1 << 21   # code lengths that a worker keeps
START = b"\n" * ORDER
UNKNOWN = "und"


def groups(texts: list[bytes], most: int = GROUP_BYTES):
    """Lists of (place, context, body) of about ``most`` bytes; a longer text
    goes in parts, each with the bytes before it as its context."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), most):
            body = text[at:at + most]
            held.append((i, text[at - ORDER:at] if at >= ORDER else START[at:] + text[:at], body))
            size += len(body)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def windows(group: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The last ``ORDER + 1`` bytes at each byte, the newest lowest, and its text."""
    data = np.frombuffer(b"".join(part for _, context, body in group for part in (context, body)), np.uint8)
    sizes = np.array([len(body) for _, _, body in group])
    packed = np.zeros(len(data) - ORDER, np.int64)
    for back in range(ORDER, -1, -1):
        packed <<= 8
        packed |= data[ORDER - back:len(data) - back]
    inner = np.ones(len(data), bool)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    inner[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    return packed[inner[ORDER:]], np.repeat([i for i, _, _ in group], sizes)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counter(batches):
    held: dict[str, list] = {}
    size = 0

    def summed():
        for lang, parts in held.items():
            keys, counts = _summed(*map(np.concatenate, zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)],
                                             names=["lang", "window", "n"])

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            for group in groups([t for t, of in zip(texts, langs) if of == lang]):
                found = np.unique(windows(group)[0], return_counts=True)
                held.setdefault(lang, []).append(found)
                size += len(found[0])
                if size >= HELD_ROWS:
                    held = {k: [_summed(*map(np.concatenate, zip(*parts)))] for k, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size >= HELD_ROWS // 2:
                        yield from summed()
                        held, size = {}, 0
    yield from summed()


def freeze(grams: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[dict[str, np.ndarray]]:
    """Tree of one language by context length: ``grams[j]`` has the keys of
    j + 1 bytes (context, then byte) and their counts."""
    tree: list[dict[str, np.ndarray]] = []
    for j in range(ORDER + 1):
        keys, counts = grams.get(j, (np.zeros(0, np.int64),) * 2)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        contexts, at, different = np.unique(keys >> 8, return_inverse=True, return_counts=True)
        level = {"keys": keys, "counts": counts, "contexts": contexts, "d": different.astype(np.float64),
                 "n": np.bincount(at, counts, len(contexts))}
        # What the next shorter context has of the same bytes, for the exclusion.
        shorter = (tree[j - 1]["counts"][np.searchsorted(tree[j - 1]["keys"], keys & ((1 << 8 * j) - 1))]
                   if j else np.zeros(len(keys)))
        level["excluded"] = np.bincount(at, shorter, len(contexts))
        tree.append(level)
    return tree


def code_lengths(tree: list[dict[str, np.ndarray]], packed: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each window."""
    bits = np.zeros(len(packed))
    open_ = np.arange(len(packed))              # windows whose byte is not coded yet
    gone, seen = np.zeros((2, len(packed)))     # counts and bytes excluded by the longer context
    for j in range(ORDER, -1, -1):
        level = tree[j]
        if not len(level["keys"]):
            continue
        w = packed[open_]
        context = (w >> 8) & ((1 << 8 * j) - 1)
        at = np.searchsorted(level["contexts"], context)
        at[at == len(level["contexts"])] = 0
        known = level["contexts"][at] == context
        rows, at, w = open_[known], at[known], w[known] & ((1 << 8 * (j + 1)) - 1)
        left = level["d"][at] - seen[rows]
        total = level["n"][at] - gone[rows] + left
        entry = np.searchsorted(level["keys"], w)
        entry[entry == len(level["keys"])] = 0
        hit = level["keys"][entry] == w
        bits[rows[hit]] += np.log2(total[hit] / level["counts"][entry[hit]])
        escape = ~hit & (left > 0)              # with no byte left the escape is certain
        bits[rows[escape]] += np.log2(total[escape] / left[escape])
        miss = rows[~hit]
        gone[miss], seen[miss] = level["excluded"][at[~hit]], level["d"][at[~hit]]
        done = np.zeros(len(packed), bool)
        done[rows[hit]] = True
        open_ = open_[~done[open_]]
    bits[open_] += np.log2(256 - seen[open_])
    return bits


class Coder:
    """Code lengths in all languages, with a bounded table of windows."""

    def __init__(self, trees: list, cells: int = TABLE_CELLS):
        self.trees = trees
        self.slots = 1 << max(4, (cells // max(1, len(trees))).bit_length() - 1)
        self.clear()

    def clear(self) -> None:
        self.used, self.keys = 0, np.full(self.slots, -1, np.int64)
        self.bits = np.zeros((len(self.trees), self.slots))

    def _slot(self, packed: np.ndarray) -> np.ndarray:
        mixed = packed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def _find(self, packed: np.ndarray) -> np.ndarray:
        """Slot of each window, or the free slot where its search ended."""
        slot = self._slot(packed)
        there = self.keys[slot]
        moved = np.flatnonzero((there != packed) & (there >= 0))
        while len(moved):
            slot[moved] = (slot[moved] + 1) % self.slots
            there = self.keys[slot[moved]]
            moved = moved[(there != packed[moved]) & (there >= 0)]
        return slot

    def _add(self, packed: np.ndarray) -> None:
        self.used += len(packed)
        bits = [code_lengths(tree, packed) for tree in self.trees]
        rest = np.arange(len(packed))
        slot = self._slot(packed)
        while len(rest):
            free = self.keys[slot[rest]] < 0
            self.keys[slot[rest[free]]] = packed[rest[free]]
            placed = self.keys[slot[rest]] == packed[rest]
            for table, of in zip(self.bits, bits):
                table[slot[rest[placed]]] = of[rest[placed]]
            rest = rest[~placed]
            slot[rest] = (slot[rest] + 1) % self.slots

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits by language and text."""
        total = np.zeros((len(self.trees), len(texts)))
        for group in groups(texts):
            packed, owner = windows(group)
            slot = self._find(packed)
            new = np.unique(packed[self.keys[slot] < 0])
            if len(new) > self.slots // 4:        # unusual bytes: not worth keeping
                for row, tree in zip(total, self.trees):
                    row += np.bincount(owner, code_lengths(tree, packed), len(texts))
                continue
            if len(new):
                if self.used + len(new) > self.slots // 2:
                    self.clear()
                    new = np.unique(packed)
                    if len(new) > self.slots // 2:
                        for row, tree in zip(total, self.trees):
                            row += np.bincount(owner, code_lengths(tree, packed), len(texts))
                        continue
                self._add(new)
                slot = self._find(packed)
            for row, table in zip(total, self.bits):
                row += np.bincount(owner, table[slot], len(texts))
        return total


def _least_power(sizes: dict[int, int], capacity: int) -> int:
    """The least power from which on the entries fit."""
    kept, least = 0, 63
    while least and kept + sizes.get(least - 1, 0) <= capacity:
        least -= 1
        kept += sizes.get(least, 0)
    return least


def learn(texts: DataFrame, staging: Staging, capacity: int = CAPACITY) -> dict[str, list]:
    """Trees by language; ``texts`` has lang and text (binary), not null."""
    counted = (texts.mapInArrow(_counter, "lang string, window long, n long")
               .groupBy("lang", "window").agg(F.sum("n").alias("n")))
    whole = staging.write(counted, "windows")
    lengths = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("j")
    grams = staging.write(
        whole.select("lang", lengths, "window", "n")
        .select("lang", "j", F.expr("window & (shiftleft(1L, 8 * (j + 1)) - 1)").alias("key"), "n")
        .groupBy("lang", "j", "key").agg(F.sum("n").alias("n"), (F.length(F.bin(F.sum("n"))) - 1).alias("power")),
        "grams")
    sizes = defaultdict(dict)  # at most 63 numbers a language
    for r in grams.groupBy("lang", "power").count().collect():
        sizes[r["lang"]][r["power"]] = r["count"]
    least = [(lang, _least_power(found, capacity // len(sizes))) for lang, found in sorted(sizes.items())]
    kept = grams.join(F.broadcast(staging.spark.createDataFrame(least, "lang string, least int")), "lang")
    entries = kept.filter("power >= least").select("lang", "j", "key", "n").toArrow()  # at most capacity rows
    staging.drop("windows", "grams")
    langs = entries["lang"].combine_chunks().dictionary_encode()
    j, key, n = (entries[c].to_numpy() for c in ("j", "key", "n"))
    trees = {}
    for name, code in sorted((name, code) for code, name in enumerate(langs.dictionary.to_pylist())):
        mine = langs.indices.to_numpy() == code
        trees[name] = freeze({order: (key[mine & (j == order)], n[mine & (j == order)]) for order in range(ORDER + 1)})
    return trees


def identify_languages(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    text = F.col("text").cast("string")
    learning = (docs.filter((remainder != 2) & F.col("lang").isNotNull() & text.isNotNull())
                .select(F.col("lang").cast("string").alias("lang"), text.cast("binary").alias("text")))
    trees = learn(learning, Staging(docs.sparkSession, "languages"), capacity)
    names, run_id = list(trees), uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(list(trees.values()))
    rows = docs.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"),
                       F.when(text.rlike(r"\p{L}"), text.cast("binary")).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("held_out", BooleanType()),
                         StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        mine = per_worker(("coder",), dict)  # only the last run's
        if run_id not in mine:
            mine.clear()
            mine[run_id] = Coder(shared.value)
        coder = mine[run_id]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t is not None] if names else []
            if known:
                bits = coder.lengths([texts[i] for i in known])
                for i, at in zip(known, bits.argmin(axis=0).tolist()):
                    best[i] = names[at]
                score[known] = 1 / np.exp2(bits.min(axis=0) - bits).sum(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best),
                                              pa.array(score)], names=schema.names)
    return rows.mapInArrow(run, schema)

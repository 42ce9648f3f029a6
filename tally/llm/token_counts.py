"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged numpy array of symbols.
In each round every sequence applies its lowest-rank pair at all its places
at once (from left to right where places overlap); sequences without a
mergeable pair leave the array, and the symbols that survive are counted. A
long sequence (a run of letters without a break) is merged alone, by linked
symbols and the places of each rank, so that a round costs no more than its merges.

Pre-tokens: a text is first cut before each space that follows a non-space
character. No pre-token crosses such a cut, so the count of a chunk does not
depend on its neighbours and is kept in a bounded per-task table. Special
strings inside a text count as one token each, as the library does by default.

Cases: null and empty texts have no tokens; very long texts are handled
whole, chunk by chunk; each repeated row is counted; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import per_worker

LIMIT = 512
CACHE_ENTRIES = 500_000
CACHED_CHARS = 64     # longer chunks are counted each time
GROUP_CHARS = 1 << 21  # text whose chunks are in memory at once
LONG_SEQUENCE = 1 << 11  # bytes beyond which a sequence's symbols are linked
LONG_CHARS = 1 << 22   # a longer text is handled in parts
NONE = np.int64(1 << 40)

SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The contractions and classes of the vocabulary's pre-token pattern.
PRETOKEN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
            rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 characters for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class Merger:
    """Counts the tokens of texts with one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.width = np.int64(max(vocab.values()) + 1)
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], np.int64)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"] if t["special"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pretoken = regex.compile(PRETOKEN)
        self.cut = re.compile(r"(?<=\S)(?= )")
        self.uneven = re.compile(r"\s ")
        self.spaced: dict[str, int] = {}  # chunk without its leading space
        self.bare: dict[str, int] = {}    # chunk at the start of a text

    def merge_counts(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols that survive in each non-empty byte sequence."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        counts = np.zeros(len(sequences), np.int64)
        for i in np.flatnonzero(lengths > LONG_SEQUENCE).tolist():
            counts[i] = self._merge_long(sequences[i])
        short = np.flatnonzero(lengths <= LONG_SEQUENCE)
        symbols = self.byte_id[np.frombuffer(b"".join(sequences[i] for i in short.tolist()), np.uint8)]
        owner = np.repeat(short, lengths[short])
        while len(symbols):
            first = np.empty(len(symbols), bool)
            first[0], first[1:] = True, owner[1:] != owner[:-1]
            starts = np.flatnonzero(first)
            rank = np.full(len(symbols), NONE)
            rank[:-1] = np.where(first[1:], NONE, self._rank(symbols[:-1], symbols[1:]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            over = lowest == NONE
            counts[owner[starts[over]]] = sizes[over]
            here = (rank == np.repeat(lowest, sizes)) & (rank != NONE)
            if here[1:].any():  # of overlapping places, every other one from the left
                place = np.arange(len(here))
                run = np.maximum.accumulate(np.where(here & ~np.append(False, here[:-1]), place, 0))
                here &= (place - run) % 2 == 0
            symbols = symbols.copy()
            symbols[here] = self.merged[rank[here]]
            stay = np.repeat(~over, sizes)
            stay[1:] &= ~here[:-1]
            symbols, owner = symbols[stay], owner[stay]
        return counts

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = left * self.width + right
        at = np.searchsorted(self.keys, pairs)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == pairs, self.ranks[at], NONE)

    def _merge_long(self, sequence: bytes) -> int:
        """The same for one long sequence: symbols are linked and places are
        kept by rank, so a round costs its merges and not the whole array."""
        symbols = self.byte_id[np.frombuffer(sequence, np.uint8)]
        n = left = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, NONE)
        rank[:-1] = self._rank(symbols[:-1], symbols[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] != NONE]
            places = places[np.argsort(rank[places], kind="stable")]
            of = rank[places]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
                if start < end:
                    r = int(of[start])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(ranks, r)
                    waiting[r].append(places[start:end])

        wait(np.arange(n))
        while ranks:
            lowest = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(lowest)))
            at = at[rank[at] == lowest]  # not merged away, and still this pair
            over = after[at[:-1]] == at[1:]
            if over.any():  # of overlapping places, every other one from the left
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(np.append(False, over), 0, place))
                at = at[(place - run) % 2 == 0]
            gone = after[at]
            symbols[at] = self.merged[lowest]
            rank[gone] = NONE
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            left -= len(at)
            touched = np.unique(np.concatenate([at, before[at]]))
            touched = touched[touched >= 0]
            ends = after[touched]
            rank[touched] = NONE
            inner = ends < n
            rank[touched[inner]] = self._rank(symbols[touched[inner]], symbols[ends[inner]])
            wait(touched)
        return left

    def _learn(self, table: dict[str, int], chunks: set[str], lead: str) -> list[str]:
        """Adds ``chunks`` to ``table``; returns those not to be kept."""
        index: dict[str, int] = {}
        cut = []
        for chunk in chunks:
            cut.append([index.setdefault(p, len(index)) for p in self.pretoken.findall(lead + chunk)])
        if index:
            counts = self.merge_counts([p.encode() for p in index]).tolist()
            for chunk, parts in zip(chunks, cut):
                table[chunk] = sum(counts[i] for i in parts)
        else:
            table.update(dict.fromkeys(chunks, 0))
        return [c for c in chunks if len(c) > CACHED_CHARS]

    def _chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Chunks without a leading space, and the others without theirs."""
        if self.uneven.search(text) is None:
            first, *rest = text.split(" ")
            return ([first] if first else []), rest
        parts = self.cut.split(text)
        return [p for p in parts if p[:1] != " "], [p[1:] for p in parts if p[:1] == " "]

    def count(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        cut = []
        for i, text in enumerate(texts):
            if len(text) > LONG_CHARS and len(parts := list(parts_of(text, LONG_CHARS))) > 1:
                counts[i] = sum(self.count([p])[0] for p in parts)
                continue
            if self.special is not None:
                pieces = self.special.split(text)
                counts[i] += len(pieces) - 1
            else:
                pieces = [text]
            cut.extend((i, *self._chunks(p)) for p in pieces if p)
        for table, at, lead in ((self.bare, 1, ""), (self.spaced, 2, " ")):
            new = set().union(*(c[at] for c in cut)).difference(table)
            long = self._learn(table, new, lead) if new else []
            for c in cut:
                counts[c[0]] += sum(map(table.__getitem__, c[at]))
            for chunk in long:
                del table[chunk]
            if len(table) > CACHE_ENTRIES:  # frequent chunks came first, so the older half stays
                for chunk in list(itertools.islice(table, CACHE_ENTRIES // 2, None)):
                    del table[chunk]
        return counts


def parts_of(text: str, most: int):
    """``text`` in parts of about ``most`` characters, cut before a space that
    follows a letter or digit (no word, pre-token or special string is cut)."""
    start, at = 0, most
    while (at := text.find(" ", at)) > 0:
        if text[at - 1].isalnum():
            yield text[start:at]
            start, at = at, at + most
        else:
            at += 1
    yield text[start:]


def groups_of(texts: list[str], most: int):
    """Slices of ``texts`` of about ``most`` characters."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield texts[start:i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([texts.schema["doc_id"], StructField("n_bytes", LongType()),
                         StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def run(batches):
        merger = per_worker(("merger", tokenizer_path), lambda: Merger(tokenizer_path))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts: list[int] = []
            for group in groups_of(texts, GROUP_CHARS):
                counts += merger.count(group)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([c > limit for c in counts], pa.bool_())], names=schema.names)
    return texts.mapInArrow(run, schema)

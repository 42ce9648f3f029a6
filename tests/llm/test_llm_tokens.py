"""Token counts and packing against the tokenizer library."""

import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tally.llm.packing import match_runs, pack
from tally.llm.token_counts import Merger, token_counts

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SIGNS = "ab AB \u00e9\n\t .,'!?01\u07c0\u4e2d\u6587\u5b57\u3000\u2003\x85\x1c\u200b\U0001f600 \u00f1\u00df|$#<>\u0155\u0130\u03c2\u03a3"


def texts():
    rnd = random.Random(2)
    odd = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    return odd + [None, "", " ", "<|endoftext|>", "a<|endoftext|> <|startoftext|>b", "<|ENDOFTEXT|>", "e\u0301 \u0301e",
                  "aaaa aaaaaaa aaaaaaaaaaaaaaa", "it's we'll don't they'RE", "word " * 9000, "x" * 3000, "same", "same"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows],
                                 "doc_id long, text string, rank int, key string, length int")


def test_token_counts(spark):
    rows = list(enumerate(texts())) + [(3, "again"), (None, "no id")]
    library = Tokenizer.from_file(BYTES)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    got = token_counts(frame(spark, rows), BYTES)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts(frame(spark, []), BYTES).count() == 0


def test_long_texts_in_parts(monkeypatch):
    from tally.llm import packing, token_counts
    monkeypatch.setattr(token_counts, "LONG_CHARS", 40)
    monkeypatch.setattr(packing, "LONG_CHARS", 40)
    rows = [t for t in texts() if t] + [" ".join(t for t in texts() if t)]
    for text in rows:
        assert "".join(token_counts.parts_of(text, 40)) == text
    assert Merger(BYTES).count(rows) == [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch(rows, add_special_tokens=False)]
    assert packing.WordIds(WORDS).encode(rows) == [
        np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(WORDS).encode_batch(rows, add_special_tokens=False)]


def test_long_runs_take_seconds():
    """Runs without a break are counted as the library does, a megabyte in seconds."""
    library, merger = Tokenizer.from_file(BYTES), Merger(BYTES)
    rnd = random.Random(5)
    runs = ["".join(rnd.choice(letters) for _ in range(n)) for letters, n in (
        ("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("ab", 30_000), ("a", 100_001), ("\u4e2d\u6587\u00e9a", 50_000),
        ("ACGT", 200_000), ("=-", 30_000), ("0123456789", 50_000), ("th", 2049), ("e", 2048))]
    started = time.time()
    got = merger.count(runs)
    assert time.time() - started < 60
    assert got == [len(library.encode(r, add_special_tokens=False).ids) for r in runs]


def test_merge_order_of_equal_neighbours():
    library, merger = Tokenizer.from_file(BYTES), Merger(BYTES)
    words = ["a" * n for n in range(1, 40)] + ["ab" * 9, "!" * 33, "=" * 70, "-" * 257]
    assert merger.merge_counts([w.encode() for w in words]).tolist() == \
        [len(library.encode(w, add_special_tokens=False).ids) for w in words]


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_pack(spark, capacity):
    rows = list(enumerate(texts()))
    library = Tokenizer.from_file(WORDS)
    want = {}
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[i, p] = at, len(part), zlib.crc32(part.tobytes())
    got = pack(frame(spark, rows), WORDS, capacity).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(held) <= -(-total // capacity) * 11 / 9 + 1


def test_pack_empty_and_repeated(spark):
    assert pack(frame(spark, []), WORDS).count() == 0
    got = pack(frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), WORDS).collect()
    assert len(got) == 3 and {r.sequence_id for r in got} == {0}
    assert sorted(r.offset for r in got) == [0, 3, 6]


def test_runs_match_best_fit_one_by_one():
    """Run matching places as many sequences as best-fit decreasing does."""
    rnd = random.Random(6)
    for _ in range(200):
        capacity = rnd.choice([5, 20, 100])
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randrange(1, 300))]
        gaps = []
        for s in sorted(sizes, reverse=True):
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is None:
                gaps.append(capacity - s)
            else:
                gaps[gaps.index(fit)] = fit - s
        counts = defaultdict(int)
        for s in sizes:
            counts[s] += 1
        runs = match_runs(dict(counts), capacity)
        opened = 0
        for length in counts:
            own = runs[runs[:, 0] == length]
            own = own[np.argsort(own[:, 1])]
            ends = np.append(own[1:, 1], counts[length])
            opened = max(opened, int((own[:, 2] + ends - own[:, 1]).max()))
        assert opened == len(gaps)

"""The pipeline, stage by stage, against brute force on a small table."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tally.llm.quality import importance_weights

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first and after each stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return out


def test_quality_stage(spark, stages):
    judged = importance_weights(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = judged.collect()
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in stages[1]} == kept
    # The kept ones have the largest keys.
    assert min(r.key for r in rows if r.kept) > max(r.key for r in rows if not r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(bool(q) == (i in kept) for i, q in labels.items())


def test_exact_stage(stages):
    best = {}
    for r in stages[1]:
        best[r.text or ""] = max(best.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in stages[2]) == sorted(best.values())


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_stage(stages):
    prints = {r.doc_id: fingerprint(r.text) for r in stages[2]}
    left, kept = set(prints), set()
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i in left:
                left.discard(i)
                group.add(i)
                todo += [j for j in left if (prints[i] ^ prints[j]).bit_count() <= 2]
        kept.add(min(group))
    assert {r.doc_id for r in stages[3]} == kept and len(stages[3]) == len(kept)


def test_mix_stage(stages):
    volume = Counter()
    for r in stages[3]:
        volume[r.source] += len(r.text or "") + 1
    weights = {s: corpus_pipeline.SOURCE_WEIGHTS.get(s, corpus_pipeline.OTHER_WEIGHT) for s in volume}
    want = Counter()
    for r in stages[3]:
        rate = weights[r.source] / sum(weights.values()) * sum(volume.values()) / volume[r.source]
        parts = max(1, math.ceil(rate / 16))
        for part in range(1, parts + 1):
            u = int(hashlib.md5(f"5:{r.doc_id}:{part}".encode()).hexdigest()[:13], 16) / 2 ** 52
            k, p = 0, math.exp(-rate / parts)
            total = p
            while total <= u:
                k += 1
                p *= rate / parts / k
                total += p
            want[r.doc_id] += k
    assert Counter(r.doc_id for r in stages[4]) == +want


def test_packing_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4]:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want[r.doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in stages[5]) == want
    held = {}
    for r in stages[5]:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r.length for r in stages[5]) // 2048) * 11 / 9 + 1


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(tuple(r)[:5] for r in stages[5])


CLASHING = ("doc_id long, text string, lang string, source string, n_chars long, row_id__ string, rid long, fp string, "
            "COPY int, rate string, order__ int, length int, n__ int, good int")


def odd_documents():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    extra = ("r", 1, "f", 2, "s", 3, 4, 5, 6)
    rows = [(i, f"word{i} of a plain text, number {i} of many.", "en", "a" if i % 3 else "b", 10, *extra) for i in range(12)]
    rows += [(None,) * 14, (20, None, None, None, None, *extra), (21, "", "en", "a", 0, *extra), (22, " \n", "en", "c", 2, *extra),
             (23, "long word " * 30_000, "en", "a", 300_000, *extra), (24, "x" * 9000, "en", None, 9000, *extra)]
    return rows + rows[:2] + rows[12:14]


def test_stages_on_odd_tables(spark, tmp_path):
    for name, rows in (("odd", odd_documents()), ("empty", [])):
        docs = spark.createDataFrame(rows, CLASHING)
        columns = docs.columns
        for step, (stage, function) in enumerate(corpus_pipeline.STAGES):
            function(spark, docs, SF).write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
            if step < 4:
                assert docs.columns == columns
            kept = docs.collect()
            if not rows:
                assert kept == []
            elif stage in ("exact_dedup", "simhash_near_dedup"):
                texts = [r.text or "" for r in kept]
                assert len(texts) == len(set(texts)) and set(texts) <= {r[1] or "" for r in rows}
        if rows:
            assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(docs.columns)
            assert all(0 < r.length <= 2048 and r.offset + r.length <= 2048 for r in kept)


def test_run_leaves_only_its_last_tables(spark):
    import os

    from tally.session import shared_path
    folder = shared_path(spark, "tally-llm").removeprefix("file:")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, SF)
    left = [(f, t) for f in set(os.listdir(folder)) - before for t in os.listdir(f"{folder}/{f}")]
    assert {f.split("-")[0] for f, _ in left} == {"pipeline", "packing"}
    assert sorted(t.split("-", 1)[1] for f, t in left if f.startswith("pipeline")) == ["source_mix"]

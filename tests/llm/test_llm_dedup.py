"""Exact, SimHash and embedding dedup against brute force, and odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tally.llm import embedding_dedup
from tally.llm.embedding_dedup import embedding_components
from tally.llm.exact_dedup import drop_exact_copies, exact_groups
from tally.llm.simhash import drop_near_copies, simhash_components

DOCS = "doc_id long, text string, rid string, name int, level int, block string, rank int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "r", 1, 2, "b", 3) for i, t in rows], DOCS)


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in links:
        parent[find(a)] = find(b)
    return find


EXACT = [(1, "ab"), (2, "ab"), (3, None), (4, ""), (5, "abcdefg"), (6, "abcdefg"), (7, "abcdefh"), (8, "abcdef"),
         (9, "abc"), (10, "abcabc"), (11, "x" * 5000), (12, "x" * 5000), (13, "x" * 4999), (None, "ab"), (2, "ab"),
         (14, "é😀" * 40), (15, "é😀" * 40), (16, " ab"), (17, "AB")]


@pytest.mark.parametrize("size", [1, 3, 64, 2048])
def test_exact_groups(spark, size):
    groups = {}
    for i, t in EXACT:
        groups.setdefault(t or "", []).append(i)
    got = exact_groups(frame(spark, EXACT), size).collect()
    assert len(got) == len(EXACT)
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in EXACT}
    kept = {}
    for r in got:
        ids = groups[texts[r.text_sha256]]
        assert r.doc_id in ids and r.group_size == len(ids)
        assert r.keep_id == max(i for i in ids if i is not None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_stage_keeps_columns_and_empty_table(spark):
    out = drop_exact_copies(frame(spark, EXACT))
    assert out.columns == frame(spark, []).columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t in EXACT})
    assert exact_groups(frame(spark, [])).count() == 0
    assert drop_exact_copies(frame(spark, [])).count() == 0


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_documents():
    rnd = random.Random(4)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c a b c a b c"), (6, "one")]
    for i in range(20):
        words = [f"w{rnd.randrange(900)}" for _ in range(rnd.choice([5, 60, 900]))]
        for j in range(rnd.choice([1, 2, 6])):
            copy = list(words)
            if j:
                copy[rnd.randrange(len(copy))] = f"v{rnd.randrange(900)}"
            rows.append((10 + 10 * i + j, " ".join(copy)))
    rows.append((None, rows[-1][1]))
    rows.append((900, "Zé\u00a0x " * 60_000))
    return rows


def test_simhash_components(spark):
    rows = near_documents()
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    find = union_find(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    want = sorted(((i, f"{p:016x}", least.get(find(p))) for (i, _), p in zip(rows, prints)), key=str)
    got = simhash_components(frame(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == want
    kept = drop_near_copies(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns
    assert kept.count() == len({find(p) for p in distinct})


def test_simhash_close_fingerprints_of_one_group():
    """Chains and dense balls of fingerprints, by the search alone."""
    from pyspark.sql import SparkSession
    from tally.llm.common import Staging, components
    from tally.llm.simhash import near_edges
    spark = SparkSession.getActiveSession()
    rnd = random.Random(7)
    prints = {0, (1 << 64) - 1}
    for _ in range(30):
        p = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 5, 40])):
            prints.add(p)
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3])):
                p ^= 1 << b
    find = union_find(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    got = {r.node: r.root for r in components(near_edges(df, 2), Staging(spark, "test")).collect()}
    groups, want = {}, {}
    for p in prints:
        groups.setdefault(got.get(signed[p], signed[p]), set()).add(p)
        want.setdefault(find(p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_points_taken_to_a_cell_have_its_vector():
    """Fingerprints meet in cells only: a point is compared in the one cell that
    is its vector, and all points one bit away are taken to some cell."""
    from tally.llm.simhash import BASE, SEGMENT_BITS, SEGMENTS, _steps

    def vector(p):
        return sum(((p >> SEGMENT_BITS * i & (1 << SEGMENT_BITS) - 1).bit_count() + 1) * BASE ** i for i in range(SEGMENTS))
    rnd = random.Random(5)
    for p in [0, (1 << 64) - 1, *(rnd.getrandbits(64) for _ in range(20))]:
        taken = {(vector(p) + step, p ^ (m % (1 << 64))) for step, masks, was in _steps(1) for m in masks
                 if bool(p & m % (1 << 64)) == was}
        assert {point for _, point in taken} == {p, *(p ^ 1 << b for b in range(64))}
        assert all(vector(point) == cell for cell, point in taken)
        assert len(taken) == 65 and len({cell for cell, _ in taken}) <= 45


def test_simhash_empty(spark):
    assert simhash_components(frame(spark, [])).count() == 0


def vectors():
    rnd = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1):
        for size in (1, 1, 2, 5, 60):
            centre = rnd.standard_normal(16)
            for _ in range(size):
                rows.append((n, (centre + 0.02 * rnd.standard_normal(16)).tolist(), label))
                n += 1
    rows += [(n, rows[5][1], 0), (n + 1, [2 * v for v in rows[5][1]], 0), (n + 2, rows[5][1], None),
             (n + 3, rows[5][1], 1), (n + 4, None, 0), (n + 5, [0.0] * 16, 0), (n + 6, [float("nan")] * 16, 0),
             (n + 7, [None] * 16, 0), (n + 8, [float("inf")] * 16, 0), (n + 9, [], 0), (n + 10, rows[5][1][:8], 0),
             (n, rows[5][1], 0)]
    return rows


@pytest.mark.parametrize("chunk", [1024, 8])
def test_embedding_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "SMALL", 4)
    rows = vectors()
    usable = [k for k, (_, v, label) in enumerate(rows)
              if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in usable:
        for b in usable:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) \
                    and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links.append((a, b))
    find = union_find(range(len(rows)), links)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    want = sorted((i, sum(a == k for a, _ in links), least[find(k)], i == least[find(k)])
                  for k, (i, _, _) in enumerate(rows))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, embedding array<double>, label int, filters string, gid int")
    got = embedding_components(df, words=32)
    assert sorted(map(tuple, got.collect())) == want


def test_embedding_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_components(df).count() == 0

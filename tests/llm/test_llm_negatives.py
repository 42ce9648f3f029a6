"""Hard-negative mining against brute force."""

import math

import numpy as np
import pytest

from tally.llm import hard_negatives
from tally.llm.hard_negatives import Cells, codebook, halves, layout, mine_hard_negatives, nearest

ROWS = "rid int, vec_id long, label int, embedding array<double>, page string, score int"


def brute(rows):
    kept = []
    for vec_id, label, vec in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, label, [math.floor(256 * x) for x in vec]))
    out = []
    for a, (anchor, label, vec) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, other)), i is None, i or 0, b, of == label)
                        for b, (i, of, other) in enumerate(kept) if b != a and len(other) == len(vec))
        for p in [s for s in scored if s[4]][:5]:
            found = [n for n in scored if not n[4] and -80 * p[0] <= -100 * n[0] <= -100 * p[0]][:5]
            out += [(anchor, None if p[1] else p[2], r + 1, None if n[1] else n[2], -p[0], -n[0]) for r, n in enumerate(found)]
    return sorted(out, key=str)


def vectors(n=700, dim=6, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 1, (12, dim))
    rows = [(int(i), int(rnd.integers(0, 4)), (centres[i % 12] + rnd.normal(0, 0.1, dim)).tolist()) for i in range(n)]
    rows += [(1000 + i, i % 3, [0.5] * dim) for i in range(n // 2)]  # a third of all rows are one vector
    rows += [(5, 1, [0.5] * dim), (5, 1, [0.5] * dim), (100, 2, [0.25] * dim), (None, 1, [0.5] * dim), (2000, None, [1.0] * dim),
             (2100, 1, None), (2200, 1, [None] * dim), (2300, 1, [float("nan")] * dim), (2400, 1, [float("inf")] * dim),
             (2500, 9, [1.0] * dim), (2600, 1, [0.0] * dim), (2700, 2, [1.0] * (dim + 1)), (2701, 2, [0.9] * (dim + 1)),
             (2702, 3, [0.85] * (dim + 1)), (2800, 1, []), (2801, 1, []), (2802, 2, []), (-700, 1, [-0.5] * dim),
             (2900, 1, [0.1]), (2901, 1, [0.1]), (2902, 0, [0.1])]
    return rows


def mined(spark, rows):
    df = spark.createDataFrame([(1, i, label, v, "x", 2) for i, label, v in rows], ROWS)
    got = mine_hard_negatives(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_against_brute_force_in_one_round(spark):
    rows = vectors()
    assert mined(spark, rows) == brute(rows)


def test_against_brute_force_in_many_rounds_pages_and_blocks(spark, monkeypatch):
    for name, value in {"WORDS": 5, "PAGE_ROWS": 60, "ANCHOR_ROWS": 3, "FIRST_ROWS": 30, "GROWTH": 4, "SCORED": 500}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = [r for r in vectors(500, 5, 3) if r[2] is not None and len(r[2]) == 5]
    assert mined(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rows = [(i * 50, i % 2, [3000.5 + i, -(2.0 ** 12) + i, 1e-3 * i]) for i in range(40)]
    assert mined(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert mined(spark, []) == mined(spark, [(100, 1, None)]) == mined(spark, [(100, 1, [1.0])]) == []


@pytest.mark.parametrize("seed", range(4))
def test_heap_visits_all_cells_in_order_within_their_bounds(seed):
    rnd = np.random.default_rng(seed)
    x = np.floor(rnd.normal(0, 50, (400, 7)))
    books = [codebook(h, 9, 0) for h in halves(x)]
    near = [nearest(h, b) for h, b in zip(halves(x), books)]
    far = [np.sqrt(((h - b[n]) ** 2).sum(axis=1)) for h, b, n in zip(halves(x), books, near)]
    radii = [np.array([f[n == w].max(initial=0) for w in range(len(b))]) for b, n, f in zip(books, near, far)]
    cell = near[0] * len(books[1]) + near[1]
    sizes = {int(c): int((cell == c).sum()) for c in np.unique(cell)}
    q = np.floor(rnd.normal(0, 50, 7))
    seen = list(Cells(books, radii, sizes).visit(q))
    assert sorted(c for _, _, c in seen) == sorted(sizes)
    assert all(a[0] >= b[0] - 1e-6 for a, b in zip(seen, seen[1:]))
    for high, low, c in seen:
        scores = x[cell == c] @ q
        assert low <= scores.min() and scores.max() <= high


def test_heap_stops_early_on_clustered_rows():
    rnd = np.random.default_rng(0)
    centres = rnd.normal(0, 100, (20, 8))
    x = np.repeat(centres, 30, axis=0) + rnd.normal(0, 1, (600, 8))
    books = [codebook(h, 20, 0) for h in halves(x)]
    near = [nearest(h, b) for h, b in zip(halves(x), books)]
    far = [np.sqrt(((h - b[n]) ** 2).sum(axis=1)) for h, b, n in zip(halves(x), books, near)]
    radii = [np.array([f[n == w].max(initial=0) for w in range(len(b))]) for b, n, f in zip(books, near, far)]
    cell = near[0] * len(books[1]) + near[1]
    cells = Cells(books, radii, {int(c): int((cell == c).sum()) for c in np.unique(cell)})
    fifth = np.sort(x @ x[0])[-5]
    needed = [c for bound, _, c in cells.visit(x[0]) if bound >= fifth]
    assert len(needed) <= len(cells.sizes) // 3


def test_layout_of_pages():
    places, pages = layout({1: 10, 2: 90, 3: 5, 4: 250, 7: 100}, 100)
    assert places == {1: (0, 1), 2: (0, 1), 3: (1, 1), 4: (2, 3), 7: (5, 1)} and pages == 6
    assert layout({}, 100) == ({}, 0)

"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tally.llm import lexical_search
from tally.llm.lexical_search import Items, rank_documents, terms_of

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
DOCS = "DOC_ID__ int, doc_id long, text string, rank int, item string, score string"
ITEMS = "item_id long, text string, rid int, rank int"


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs if plain_terms(t)]
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * len(counts)) // total
            score = sum(math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1)))
                        * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(n=400, seed=5):
    """Zipf-like words, a hot text held by a third of the rows, ties, odd texts."""
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(5000)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120)))) for i in range(n)]
    docs += [(1000 + i, "W1 w2, hot text; w3 w9Été café-x") for i in range(n // 2)]
    docs += [(7, "again w1 w1"), (7, "again w1 w1"), (None, "w5 no id"), (2000, None), (2001, ""), (2002, " .,!"),
             (2003, "w1 " * 20000 + "rare" * 9000), (2004, "İ ÉTÉ \x7f\x85z")]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40)))) for i in range(30)]
    items += [(30, None), (31, "..."), (32, "nowhere"), (33, "HOT"), (33, "hot"), (None, "w1 w2 w3"), (34, "rare" * 9000),
              (35, "été ÉTÉ")]
    return docs, items


def found(spark, docs, items, **options):
    left = spark.createDataFrame([(1, d, t, 2, "x", "y") for d, t in docs], DOCS)
    right = spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    return sorted(map(tuple, rank_documents(left, right, **options).select("item_id", "rank", "doc_id", "score").collect()),
                  key=str)


def test_terms():
    for text in ["", "a", "A_b-C9", "Été İ\U0001f600x\x7fy\x85", "x" * 100 + " y"]:
        assert [t.decode() for part in terms_of(text.encode()) for t in part] == plain_terms(text)


def test_long_texts_are_read_in_parts(monkeypatch):
    monkeypatch.setattr(lexical_search, "PART_BYTES", 7)
    text = "ab cdefghijklmnop q, rséééééé t " * 5
    assert [t.decode() for part in terms_of(text.encode()) for t in part] == plain_terms(text)


def test_against_brute_force(spark):
    docs, items = corpus()
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, k=1) == brute(docs, items, 1)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", 1500)
    docs, items = corpus(80, 6)
    assert found(spark, docs, items[:20]) == brute(docs, items[:20])


def test_empty_tables(spark):
    docs, items = corpus(20, 7)
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [(1, None)], items) == []


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_and_are_tighter_with_pairs(seed):
    """The bound of the i lightest terms is never under what a document gets
    from them, nor over the sum of the single maxima."""
    rnd = np.random.default_rng(seed)
    items = Items([b"a b c d e f g"])
    items.weigh(1000, {i: int(rnd.integers(1, 900)) for i in range(7)})
    gains = rnd.integers(0, 1000, (200, 7)) * (rnd.random((200, 7)) < 0.4)
    most = {i: int(gains[:, i].max()) for i in range(7)}
    for (a, b), unit in items.pairs.items():
        both = (gains[:, a] > 0) & (gains[:, b] > 0)
        if both.any():
            most[unit] = int((gains[both, a] + gains[both, b]).max())
    terms, bound = items.terms[0], items.bounds(most)[0]
    single = np.cumsum([0, *(most[t] for t in terms.tolist())])
    for i in range(8):
        assert gains[:, terms[:i]].sum(axis=1).max(initial=0) <= bound[i] <= single[i]
    assert bound[7] < single[7]

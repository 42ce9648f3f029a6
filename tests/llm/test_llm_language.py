"""Language identification against a plain context tree, and its accuracy."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tally.llm import language_id
from tally.llm.language_id import ORDER, START, Coder, code_lengths, freeze, groups, identify_languages, windows

DOCS = "doc_id long, text string, lang string, source string, window int, n int, J int"


def plain_tree(texts, least=1):
    """context -> byte -> count, for entries counted at least ``least`` times."""
    tree = defaultdict(Counter)
    for text in texts:
        data = START + text
        for i in range(ORDER, len(data)):
            for j in range(ORDER + 1):
                tree[data[i - j:i]][data[i]] += 1
    return {c: kept for c, n in tree.items() if (kept := {b: k for b, k in n.items() if k >= least})}


def plain_bits(tree, text):
    data, bits = START + text, 0.0
    for i in range(ORDER, len(data)):
        gone = set()
        for j in range(ORDER, -1, -1):
            context = data[i - j:i]
            left = {b: n for b, n in tree.get(context, {}).items() if b not in gone}
            if context not in tree:
                continue
            if data[i] in left:
                bits += math.log2((sum(left.values()) + len(left)) / left[data[i]])
                break
            if left:
                bits += math.log2((sum(left.values()) + len(left)) / len(left))
            gone |= set(tree[context])
        else:
            bits += math.log2(256 - len(gone))
    return bits


def grams(texts, least=1):
    out = {}
    packed = np.concatenate([windows(g)[0] for g in groups(texts)])
    for j in range(ORDER + 1):
        keys, n = np.unique(packed & ((1 << 8 * (j + 1)) - 1), return_counts=True)
        out[j] = keys[n >= least], n[n >= least]
    return out


def texts_of(seed, letters, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7))) for _ in range(40)]
    return [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))).encode() for _ in range(n)]


@pytest.mark.parametrize("least", [1, 4])
def test_code_lengths_are_those_of_a_plain_tree(least):
    learned = texts_of(1, "abcdeé") + [bytes(range(256))]
    tree, plain = freeze(grams(learned, least)), plain_tree(learned, least)
    for text in [*texts_of(2, "abcxyzé", 10), learned[0], b"", b"a", bytes(range(255, -1, -1)), "中文".encode()]:
        want = plain_bits(plain, text)
        packed = windows([(0, START, text)])[0]
        assert code_lengths(tree, packed).sum() == pytest.approx(want, abs=1e-6)
        assert Coder([tree, tree], 64).lengths([text])[1, 0] == pytest.approx(want, abs=1e-6)  # table too small
        assert Coder([tree]).lengths([b"", text, text])[0].tolist() == pytest.approx([0, want, want], abs=1e-6)


def test_probabilities_of_all_bytes_sum_to_one():
    learned = texts_of(3, "abcd")
    tree = freeze(grams(learned))
    for context in [b"abcd", b"\n\n\n\n", b"zzzz", learned[0][:ORDER], b"zza "]:
        packed = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.int64)
        assert np.exp2(-code_lengths(tree, packed)).sum() == pytest.approx(1)


def test_parts_of_long_texts():
    texts = [b"", b"abcdefghijklmnop", b"xy", b"q" * 31]
    whole = windows([(i, START, t) for i, t in enumerate(texts)])
    for most in (1, 3, 4, 10, 100):
        parts = [windows(g) for g in groups(texts, most)]
        assert [np.concatenate(c).tolist() for c in zip(*parts)] == [c.tolist() for c in whole]


def plain_identify(rows, least=None):
    crc = {d: None if d is None else zlib.crc32(str(d).encode()) % 4 for d, *_ in rows}
    learned = defaultdict(list)
    for d, text, lang in rows:
        if crc[d] not in (None, 2) and text is not None and lang is not None:
            learned[lang].append(text.encode())
    trees = {k: plain_tree(v, (least or {}).get(k, 1)) for k, v in sorted(learned.items()) if any(v)}
    out = []
    for d, text, _ in rows:
        if not trees or text is None or not any(c.isalpha() for c in text):
            out.append((d, crc[d] == 2, "und", 0.0))
            continue
        bits = {k: plain_bits(t, text.encode()) for k, t in trees.items()}
        best = min(bits, key=bits.get)
        out.append((d, crc[d] == 2, best, 1 / sum(2 ** (bits[best] - b) for b in bits.values())))
    return out


def rows_for_spark():
    rows = []
    for seed, (lang, letters) in enumerate([("aa", "abcdeé"), ("bb", "fghijé"), ("cc", "abcdgh"), ("dd", "中文a")]):
        for text in texts_of(seed, letters, 40):
            rows.append((len(rows), text.decode(), lang))
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 3!", "aa"), (503, "abc", None), (None, "abc", "zz"), (504, "É", None),
             (505, "abcde " * 3000, "aa"), (7, "fgh fgh", "bb"), (7, "fgh fgh", "bb"), (506, "7\n1", "never")]
    return rows


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[3], 6))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-6)


def test_documents(spark, monkeypatch):
    rows = rows_for_spark()
    df = spark.createDataFrame([(d, t, lang, "s", 1, 2, 3) for d, t, lang in rows], DOCS)
    same(list(map(tuple, identify_languages(df).collect())), plain_identify(rows))
    monkeypatch.setattr(language_id, "HELD_ROWS", 50)
    got = identify_languages(df, capacity=400)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    least = {}
    for name in ("aa", "bb", "cc", "dd", "never"):
        tree = plain_tree([t.encode() for d, t, lang in rows if lang == name and t and d is not None
                           and zlib.crc32(str(d).encode()) % 4 != 2])
        counts = [n for c in tree.values() for n in c.values()]
        least[name] = next(1 << p for p in range(40) if sum(n >= 1 << p for n in counts) <= 400 // 5)
    assert least["aa"] > 1 == least["never"]
    same(list(map(tuple, got.collect())), plain_identify(rows, least))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None, "s", 1, 2, 3), (2, None, "aa", "s", 1, 2, 3)], DOCS)
    assert {r.lang_pred for r in identify_languages(df).collect()} == {"und"}
    assert identify_languages(df.limit(0)).count() == 0


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'")
    right = got.filter("lang = lang_pred").count() / got.count()
    print("held-out accuracy", right)
    assert right > 0.95

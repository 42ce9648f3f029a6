"""URL filter, source mixing, sharding, personal data and quality."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from tally.llm import urls
from tally.llm.mixing import mix_sources, source_rates
from tally.llm.pii import personal_data
from tally.llm.quality import importance_weights, keep_resampled, top_k
from tally.llm.sharding import shard
from tally.llm.urls import judge_urls


def test_urls_against_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    hosts = ["org", "example.org", "a.example.org", "badexample.org", "com", "x.com", "net", "", "Example.ORG", "x.org:80",
             "..org", "comx", "é.com"]
    paths = ["", "/", "/es/", "/es", "/es/1", "/en/1", "/en/12/x", "/en/", "/fr/9", "/de/", "/de", "//es/", "/FR/"]
    rows = [(i, rnd.choice(["http://", "://", "", "ftp://a://"]) + rnd.choice(hosts) + rnd.choice(paths)
             + rnd.choice(["", "?q=/es/", "#/de/"])) for i in range(600)] + [(600, None), (601, ""), (0, "http://org/")]
    rules = [*urls.RULES, ("", "/en/12", "block"), ("a.example.org", "", "block"), ("org", "/", "block")]

    def want(url, rules):
        url = url or ""
        rest = url.partition("://")[2] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h.split(".")) if h else 0, len(p), h + p, v) for h, p, v in rules
                if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"), key=lambda f: (f[0], f[1], f[3]))
        return host, path, best[2], best[3]
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, path string")
    for chosen, bound in ((urls.RULES, 1000), (rules, 1000), (rules, 2)):
        monkeypatch.setattr(urls, "TRIE_RULES", bound)
        got = sorted(map(tuple, judge_urls(df, chosen).collect()), key=str)
        assert got == sorted([(i, *want(u, chosen)) for i, u in rows], key=str)
    assert judge_urls(df.limit(0)).count() == 0


def docs(spark, rows):
    return spark.createDataFrame([(*r, "e", 1.0, 2, "s", [1]) for r in rows],
                                 "doc_id long, text string, source string, copy string, rate double, part int, "
                                 "source__ string, cdf__ array<int>")


def test_mixing_shares_and_columns(spark):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randrange(50), rnd.choice(["a", "a", "a", "b", "c"])) for i in range(6000)]
    rows += [(7000, None, None), (7000, None, None), (None, "", "b")]
    df = docs(spark, rows)
    for weights in (None, {"a": 1, "b": 2, "c": 1}, {"b": 1.0, "none": 3.0}):
        out = mix_sources(df, weights, keep_extra=False)
        assert out.columns == df.columns
        volume, total = Counter(), sum(len(t or "") + 1 for _, t, _ in rows)
        for r in out.select("text", "source").collect():
            volume[r.source] += len(r.text or "") + 1
        share = {s: 1 for s in ("a", "b", "c", None)} if weights is None else {s: w for s, w in weights.items() if s != "none"}
        for s, w in share.items():
            if s is not None:
                assert volume[s] / total == pytest.approx(w / sum(share.values()), rel=0.1)
        assert set(volume) <= set(share)
    assert mix_sources(df.limit(0)).count() == 0
    same = mix_sources(df, {None: 1.0}).collect()
    assert len({r.doc_id for r in same}) == 1 and len(same) % 2 == 0 and {"copy_", "copies", "rate_"} <= set(same[0].asDict())


def test_mixing_is_poisson(spark):
    df = docs(spark, [(i, "", "big") for i in range(20_000)] + [(-1, "", "one")])
    for rate in (0.4, 3.0, 40.0):
        out = mix_sources(df, {"big": 1.0}, growth=rate).groupBy("doc_id").count().collect()
        n = [r["count"] for r in out] + [0] * (20_000 - len(out))
        mean = sum(n) / len(n)
        variance = sum((x - mean) ** 2 for x in n) / len(n)
        assert mean == pytest.approx(rate, rel=0.05) and variance == pytest.approx(rate, rel=0.1)
    assert {r.source: round(r.rate, 6) for r in source_rates(df).collect()} == {"big": 0.500025, "one": 10000.5}


def test_mixing_weights_of_named_and_other_sources(spark):
    df = docs(spark, [(i, "abc", f"s{i % 4}") for i in range(8000)])
    rates = {r.source: r.rate for r in source_rates(df, {"s0": 3.0, "s1": 0.0}, other=0.5).collect()}
    assert rates == pytest.approx({"s0": 3.0, "s1": 0.0, "s2": 0.5, "s3": 0.5})
    n = Counter(r.source for r in mix_sources(df, {"s0": 3.0, "s1": 0.0}, other=0.5).select("source").collect())
    assert set(n) == {"s0", "s2", "s3"} and n["s0"] == pytest.approx(6000, rel=0.05)


def test_copies_of_a_tiny_source_are_spread_over_tasks(spark):
    """One document of ten characters at a rate of two million: no task gets
    nearly all of its copies, and each copy is there once."""
    df = docs(spark, [(i, "x" * 109_999, "big") for i in range(200)] + [(-1, "y" * 10, "one")]).repartition(8)
    rate = {r.source: r.rate for r in source_rates(df, growth=2.0).collect()}["one"]
    assert rate == pytest.approx(2e6, rel=0.01)
    got = (mix_sources(df, growth=2.0).filter("source = 'one'").groupBy(F.spark_partition_id())
           .agg(F.count("*").alias("n"), F.sum("copy_").alias("sum"), F.sum(F.col("copy_").cast("long") * F.col("copy_")).alias("squares"),
                F.max("copies").alias("copies"))).collect()
    n = sum(r.n for r in got)
    assert n == pytest.approx(2e6, rel=0.01) and {r.copies for r in got} == {n}
    assert sum(r.sum for r in got) == n * (n - 1) // 2 and sum(r.squares for r in got) == (n - 1) * n * (2 * n - 1) // 6
    assert len(got) == 8 and max(r.n for r in got) < n / 4


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_sharding(spark, shards):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, "", "a", "é" * i]), "s") for i in range(400)] + [(5, "same", "s")] * 300 + [(None, "n", "s")] * 3
    got = shard(docs(spark, rows), shards, nodes=8).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == \
        Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) == set(range(shards)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


@pytest.mark.parametrize("seed", range(6))
def test_walk_places_keys_as_one_by_one(seed):
    """The walk over counts of arcs against single keys that go round the ring."""
    from tally.llm.sharding import capacities, ring, walk
    rnd = random.Random(seed)
    shards, nodes = rnd.choice([(1, 3), (3, 4), (5, 8)])
    points = ring(shards, nodes)
    counts = {a: rnd.choice([1, 2, 30, 200]) for a in rnd.sample(range(len(points)), rnd.randrange(1, len(points) + 1))}
    room = capacities(sum(counts.values()), shards, rnd.choice([0.0, 0.2]))
    got = {}
    for arc, rank, to, slot in walk(counts, points, room).tolist():
        after = [r for a, r, *_ in walk(counts, points, room).tolist() if a == arc and r > rank]
        for i in range(rank, min(after, default=counts[arc])):
            got[arc, i] = (to, slot + i - rank)
    left, used, want = list(room), [0] * shards, {}
    waiting = [(arc, i, arc) for arc in sorted(counts) for i in range(counts[arc])]
    while waiting:
        refused = []
        for arc, i, at in waiting:
            to = points[at][1]
            if left[to]:
                want[arc, i] = (to, used[to])
                left[to] -= 1
                used[to] += 1
            else:
                refused.append((arc, i, at))
        waiting = []
        for arc, i, at in refused:  # clockwise to the next point of a shard with room
            onward = next((at + k) % len(points) for k in range(1, len(points) + 1) if left[points[(at + k) % len(points)][1]])
            waiting.append((arc, i, onward))
    assert got == want


def test_slices_of_a_hot_group():
    from tally.llm.common import SLICE_ROWS, SLICES, slices_for
    assert slices_for(0) == slices_for(SLICE_ROWS) == SLICES and slices_for(SLICE_ROWS * 1000 + 1) == 1001


def test_sharding_moves_little_and_empty(spark):
    df = docs(spark, [(i, "t", "s") for i in range(8000)])
    before, after = ({r.doc_id: r.shard for r in shard(df, n).collect()} for n in (16, 17))
    assert sum(before[i] != after[i] for i in before) < 0.2 * len(before)
    assert shard(df.limit(0)).count() == 0


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    def holds(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, text or "")
                  if holds(kind, m.group()))


def spelled(spans):
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_against_brute_force(spark):
    rnd = random.Random(3)
    rows = ["a@b.c_d@e.f x@y..z q@r.s.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255", "4111 1111 1111 1111 x4111--1111",
            "+1 (988) 555-2485, +44 20 7946 0958. +1", "+12345678 ) 9-", "", "@", "é中 a@b.co 文 😀 c@d.ef", None,
            "a@b.c" + ".d" * 20000, "+1" + " " * 1000 + "2", "a.b@c.d@e.f%a@b.c", "1" * 2000, "word " * 20000 + "z@z.zz"]
    rows += ["".join(rnd.choice("ab1 .@-+()2_%é") for _ in range(rnd.randrange(50))) for _ in range(1500)]
    rows = list(enumerate(rows)) + [(None, "a@b.c"), (1, "a@b.c")]
    got = personal_data(spark.createDataFrame([(*r, "x", 1) for r in rows],
                                              "doc_id long, text string, spans string, kind int")).collect()
    want = [(i, *[sum(s[1] == k for s in base_spans(t)) for k in range(4)],
             hashlib.sha256(spelled(base_spans(t)).encode()).hexdigest()) for i, t in rows]
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
    assert all(r.n_spans == sum(r[1:5]) and r.personal == (r.n_spans > 0) for r in got)
    assert all(hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256 for r in got)


def test_many_matches_in_one_text(spark):
    """100,000 addresses in one text, between blanks and without: the work is
    linear, so it takes seconds."""
    rnd = random.Random(4)
    rows = [sep.join(".".join(str(rnd.randrange(256)) for _ in range(4)) for _ in range(100_000)) for sep in (" GET\n", " ", "/")]
    started = time.time()
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert time.time() - started < 120
    for i, text in enumerate(rows):
        want = base_spans(text)
        assert got[i].n_ip == sum(k == 1 for _, k, _ in want) == 100_000
        assert got[i].base_sha256 == hashlib.sha256(spelled(want).encode()).hexdigest()


def test_context_words_of_any_distance_and_length(spark):
    word = "w" * 500
    rows = [f"{word} a{i}@b{i}.org" for i in range(9)] + [f"{word}:{' ' * 300}me@localhost", f"{word} you@localhost {'x' * 300}"]
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got[9] == "email:801:813" and got[10] == "email:501:514"


def plain_cut(readings, base):
    """Pieces of the readings (start, end) without base spans, by their code points."""
    out = []
    for a, b in readings:
        held = [p for p in range(a, b) if not any(s <= p < e for s, e in base)]
        for p in held:
            if out and out[-1][2] == (a, b) and out[-1][1] == p and not any(s == p for s, _ in base):
                out[-1][1] = p + 1
            else:
                out.append([p, p + 1, (a, b)])
    return sorted((a, b) for a, b, _ in out)


def test_readings_are_cut_at_base_spans(spark):
    from tally.llm.pii import ADDRESS, NUMBER, PIECE, _cut
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefgh") for _ in range(200))
    for case in range(12):
        marks = sorted(rnd.sample(range(200), 24))
        readings = list(zip(marks[::2], marks[1::2]))
        starts = [rnd.randrange(195) for _ in range(case)]
        base = [(s, min(200, s + rnd.randrange(1, 12))) for s in starts]
        rows = [(1, k, a, b, text[a:b], "<", ">") for k in (ADDRESS, NUMBER, PIECE) for a, b in readings]
        schema = "rid long, kind int, start long, end long, m string, pre string, post string"
        got = _cut(spark.createDataFrame(rows, schema), spark.createDataFrame(
            [(1, 0, a, b, text[a:b], "", "") for a, b in base], schema)).collect()
        for kind in (ADDRESS, NUMBER, PIECE):
            mine = [r for r in got if r.kind == kind]
            assert sorted((r.start, r.end) for r in mine) == plain_cut(readings, base)
            assert all(r.m == text[r.start:r.end] for r in mine)
            for r in mine:  # what stands beside a piece is the text there
                left, right = r.pre.removeprefix("<"), r.post.removesuffix(">")
                assert text[:r.start].endswith(left) and text[r.end:].startswith(right)


def plain_rounds(stand, totals, accept):
    """Scores of (kind, m) as the graph gives them, round by round, in plain Python."""
    scores = {}
    while True:
        held, several = {}, defaultdict(set)
        for rid, kind, m, seed, side, word, at in stand:
            score = max(seed, scores.get((kind, m), 0.0))
            key = (kind, side, word)
            held[key, rid, at] = max(held.get((key, rid, at), 0.0), score)
            if score >= accept:
                several[key].add(m)
        total = defaultdict(float)
        for (key, _, _), score in held.items():
            total[key] += score
        trust = {key: min(0.999, total[key] / totals[key[2]]) for key in total if len(several[key]) >= 3}
        new = defaultdict(lambda: 1.0)
        for kind, m, side, word in {(kind, m, side, word) for _, kind, m, seed, side, word, _ in stand if not seed}:
            if (kind, side, word) in trust:
                new[kind, m] *= 1 - trust[kind, side, word]
        new = {k: 1 - v for k, v in new.items()}
        if sum(new.values()) - sum(scores.values()) < 1e-3 and len(new) == len(scores):
            return {k for k, v in new.items() if v >= accept}
        scores = new


def test_scores_of_the_graph_against_plain_python(spark):
    """Words that stand before seeds and unseen addresses in random texts: the
    accepted addresses are those of the same graph in plain Python."""
    rnd = random.Random(8)
    labels = [f"label{c}" for c in "abcdefghij"]
    rows = []
    for i in range(400):
        label = rnd.choice(labels)
        seed = rnd.random() < 0.1 + 0.8 * (label < "labele")
        name = f"u{rnd.randrange(60)}@" + (f"h{i}.org" if seed else "host")
        rows.append(f"{label} {name}" if rnd.random() < 0.8 else f"{label} none")
    totals, stand = Counter(w for t in rows for w in re.split("[^a-z0-9]+", t)), []
    for rid, text in enumerate(rows):
        label, name = text.split(" ")
        if "@" in name:
            stand.append((rid, 0, name, float("." in name), "before", label, len(label)))
    seen = {w for _, _, _, seed, _, w, _ in stand if not seed}
    stand = [s for s in stand if s[5] in seen and len({o[2] for o in stand if o[5] == s[5]}) >= 3]
    accepted = plain_rounds(stand, totals, 0.6)
    got = personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    for r in got:
        name = rows[r.doc_id].split(" ")[1]
        assert (r.spans != "") == ("." in name or (0, name) in accepted), rows[r.doc_id]
    assert 0 < len(accepted) < 60


def test_contexts_discover_unseen_identifiers(spark):
    rows = [f"contactbox: user{i}@site{i}.org now" for i in range(12)] + ["contactbox: user5@localhost now"]
    rows += [f"telno: +1 555 010 {1000 + i} thanks" for i in range(9)]
    rows += ["telno: (555-010-2222), thanks", "the 555-010-2222 of", "telno: later", "the the the"]
    rows += [f"the a{i}@b.co the" for i in range(5)] + ["the order 12345678 the", "the x@localhost the"] + ["the cat"] * 40
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
           .collect()}
    added = {i: r.spans for i, r in got.items() if hashlib.sha256(r.spans.encode()).hexdigest() != r.base_sha256}
    number = rows.index("telno: (555-010-2222), thanks")
    assert added == {12: "email:12:27", number: "phone:8:20", number + 1: "phone:4:16"} or \
        added == {12: "email:12:27", number: "phone:7:20"} or added == {12: "email:12:27", number: "phone:8:20"}
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_accepted_identifiers_everywhere_and_long_chains(spark):
    rows = [f"aa w@x{i}.org end" for i in range(9)]
    for k, (one, two) in enumerate(pairwise(["aa", "bb", "cc", "dd", "ee", "ff", "gg"])):
        # each label is learned from the identifiers that the label before it gave
        rows += [f"{label} user{k}n{i}@host" for i in range(4) for label in (one, two)]
    rows += ["user5n0@host", "rare user5n1@host words", "7 user5n2@host"]
    got = personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    found = {r.doc_id: r.spans for r in got}
    for i, text in enumerate(rows):
        at = re.search(r"\S+@\S+", text)
        assert found[i] == f"email:{at.start()}:{at.end()}", text


def test_contexts_and_totals_count_the_same_words(spark):
    rows = [f"(a{i}@b.co, one{i}" for i in range(12)] + ["x@localhost , two", "clean ( me@localhost three"]
    rows += [f"box:a{i}@c.de four{i}" for i in range(12)] + ["Box; you@localhost five", "inbox him@localhost six"]
    rows += [f"éa{i}@d.fr seven{i}" for i in range(6)] + ["é her@localhost eight"]
    got = personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    added = {r.doc_id: r.spans for r in got if hashlib.sha256(r.spans.encode()).hexdigest() != r.base_sha256}
    assert added == {rows.index("Box; you@localhost five"): "email:5:18"}


def test_unseen_identifiers_with_blanks_labels_and_any_length(spark):
    rows = [f"telno: +1 555 010 {1000 + i} thanks" for i in range(20)]
    rows += [f"mailto a{i}@site{i}.org please" for i in range(20)]
    rows += [f"cardno: {card} paid" for card in ("4111 1111 1111 1111", "5500 0000 0000 0004", "3400 0000 0000 009",
                                                 "3000 0000 0000 04", "6011 0000 0000 0004")]
    rows += [f"host 10.0.0.{i} up" for i in range(9)]
    first = len(rows)
    long = "x" * 100 + "@localhost"
    more = [("telno: (743) 555-3824", "phone:7:21"), ("telno: 030 123 4567 thanks", "phone:7:19"),
            ("tel telno:030-1234567", "phone:10:21"), ("telno: 030 123 4567, a@b.co", "phone:7:19,email:21:27"),
            ("telno: (030) 123 4567 10.0.0.1", "phone:7:21,ip:22:30"), ("cardno: 4111 1111 1111 1112 paid", "card:8:27"),
            ("cardno: DE89 3704 0044 0532 0130 00 paid", "card:8:35"), ("mailto:me@host;you@host;him@host", ""),
            ("mailto:me@host please", "email:7:14"), (f"mailto {long} please", f"email:7:{7 + len(long)}"),
            ("mailto jörg@host please", "email:7:16"), ("host fe80::12:34 up", "ip:5:16"),
            ("mailto you@host; please", "email:7:15"), ("mailto him@host please", "email:7:15"),
            ("telno: 555-010-2222 thanks", "phone:7:19"), ("12 555-010-2222", "phone:3:15"),
            ("see 7 (555-010-2222).", "phone:7:19"), ("year 2024 12 11 10 items", "")]
    more[7] = (more[7][0], "email:7:14,email:15:23,email:24:32")
    rows += [text for text, _ in more]
    got = personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    spans = {r.doc_id: r.spans for r in got}
    assert [(rows[i], spans[i]) for i in range(first, len(rows))] == more


def test_top_k(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 7 as double) as key")
    order = sorted(range(1000), key=lambda i: (-(i % 7), -i))
    for k in (0, 1, 143, 144, 999, 1000, 2000):
        assert {r.id for r in df.filter(top_k(df, k, "key", "id")).collect()} == set(order[:k])


def labelled(spark, n=400):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice("aeioustrnl") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(5, 120))]
        bad = i % 7 == 0
        rows.append((i, " ".join(w + "!!$" if bad else w for w in words), "s"))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality_held_out(spark):
    rows, labels = labelled(spark)
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(2, 0), (2, 1), (None, 1), (4, None)],
                                  "doc_id long, quality int")
    more = [(1000, None, "s"), (1001, "", "s"), (3, rows[3][1], "s"), (1002, "tree " * 30000, "s")]
    out = importance_weights(docs(spark, rows + more), known).collect()
    assert len(out) == len(rows) + len(more)
    truth = dict(labels)
    # The weights tell good from bad; the draw goes against them for hardly any text, and those near the cut.
    assert min(r.log_weight for r in out if truth.get(r.doc_id) == 1) > max(r.log_weight for r in out if truth.get(r.doc_id) == 0)
    against = [r for r in out if r.doc_id in truth and r.kept != bool(truth[r.doc_id])]
    assert len(against) <= 4 and all(abs(r.log_weight) < 10 for r in against)
    assert all(r.log_weight == 0 for r in out if r.doc_id in (1000, 1001))
    kept = keep_resampled(docs(spark, rows + more), known)
    assert kept.columns == docs(spark, []).columns and kept.count() == sum(r.kept for r in out)
    assert sum(r.kept for r in importance_weights(docs(spark, rows), known, k=10).collect()) == 10


def test_quality_cut_when_held_out_lacks_a_class(spark):
    rows, labels = labelled(spark)
    df = spark.createDataFrame(labels, "doc_id long, quality int")
    fits = {r[0] for r in df.filter("pmod(xxhash64('half', doc_id), 4) > 0").collect()}
    for lacking in (0, 1):
        known = spark.createDataFrame([x for x in labels if x[1] != lacking or x[0] in fits], df.schema)
        out = importance_weights(docs(spark, rows), known).collect()
        assert {r.doc_id: r.kept for r in out} == {i: bool(q) for i, q in labels}


def test_quality_against_plain_python(spark):
    rows, labels = labelled(spark)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    fits = {r[0] for r in known.filter("pmod(xxhash64('half', doc_id), 4) > 0").collect()}
    hashes = {r[0]: r[1] for r in known.selectExpr("doc_id", "xxhash64(11, doc_id)").collect()}

    def kind(token):
        if token.isupper() and len(token) > 1:
            return 1
        if token[0].isupper():
            return 2
        if token.isalpha():
            return 3
        if token.isdigit():
            return 4
        return 5 if token[0].isalnum() else 8 + zlib.crc32(token.encode()) % 4096

    def grams(text):
        tokens = re.findall(r"\w+|[^\w\s]+", text)
        kinds = [2 * kind(t) + (i > 0 and tokens[i - 1] == t) for i, t in enumerate(tokens)]
        return [zlib.crc32(t.encode()) % 4096 for t in tokens] + \
            [4096 + (a * 7919 + b + 17) * 2654435761 % 4294967291 % 4096 for a, b in zip(kinds, kinds[1:])] + \
            [8192 + (zlib.crc32(a.encode()) * 7919 + zlib.crc32(b.encode())) % (2 ** 31 - 1) * 48271 % (2 ** 31 - 1) % 4096
             for a, b in zip(tokens, tokens[1:])]

    raw, target, good = Counter(), Counter(), {i for i, q in labels if q and i in fits}
    for i, text, _ in rows:
        raw.update(grams(text))
        target.update(grams(text) if i in good else ())
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def ratio(b):
        share = (raw[b] + 1) / (n_raw + 3 * 4096)
        return math.log((target[b] + 100_000 * share) / (n_target + 100_000)) - math.log(share)
    weights = {i: sum(map(ratio, grams(text))) for i, text, _ in rows}
    keys = {i: w - math.log(-math.log(((hashes[i] % 2 ** 64 >> 11) + 0.5) / 2 ** 53)) for i, w in weights.items()}
    best = set(sorted(keys, key=keys.get)[-150:])
    for r in importance_weights(docs(spark, rows), known, k=150).collect():
        assert r.log_weight == pytest.approx(weights[r.doc_id], abs=1e-6)
        assert r.key == pytest.approx(keys[r.doc_id], abs=1e-5) and r.kept == (r.doc_id in best)


def test_quality_without_labels_or_rows(spark):
    rows, labels = labelled(spark, 20)
    none = spark.createDataFrame([], "doc_id long, quality int")
    good = spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, quality int")
    assert all(r.kept for r in importance_weights(docs(spark, rows), none).collect())
    assert all(r.kept for r in importance_weights(docs(spark, rows), good).collect())
    assert importance_weights(docs(spark, []), good).count() == 0

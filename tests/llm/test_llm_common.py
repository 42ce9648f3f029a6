"""Shared helpers: ranks of hot groups, components, staged tables, names."""

import os
import random

from tally.llm.common import Staging, components, fresh, gapless_rank, with_row_ids


def test_ranks_are_gapless_in_hot_and_rare_groups(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 500)) AS k", "id AS row", "id % 7 AS x")
    got = gapless_rank(df, ["k"], "row", slices=8).collect()
    ranks = {}
    for r in got:
        ranks.setdefault(r.k, []).append(r.rank)
    assert len(got) == 5000 and all(sorted(v) == list(range(len(v))) for v in ranks.values())
    assert gapless_rank(df.limit(0), ["k"], "row").count() == 0


def test_components_of_chains_hubs_and_nothing(spark):
    rnd = random.Random(9)
    chain = list(range(1000, 1400))
    rnd.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(5, i) for i in range(2000, 4000)] + [(7, 7), (9, 8), (8, 9), (9, 8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Staging(spark, "t")).collect()}
    want = {n: 1000 for n in chain} | {n: 5 for n in [5, *range(2000, 4000)]} | {8: 8, 9: 8}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), Staging(spark, "t")).count() == 0


def test_staged_tables_are_replaced_and_dropped(spark):
    staging = Staging(spark, "t")
    first = staging.write(spark.range(3).toDF("x"), "a")
    second = staging.write(first.selectExpr("x + 1 AS x"), "a")
    assert sorted(r.x for r in second.collect()) == [1, 2, 3]
    folder = staging.root.removeprefix("file:")
    assert len(os.listdir(folder)) == 1
    staging.drop("a", "never written")
    assert os.listdir(folder) == []


def test_scratch_removes_what_was_staged_inside(spark):
    from tally.llm.common import scratch
    outer = Staging(spark, "t")
    with scratch():
        inner = Staging(spark, "t")
        kept = outer.write(inner.write(spark.range(4), "a").selectExpr("id * 2 AS x"), "b")
        assert os.listdir(inner.root.removeprefix("file:"))
    assert os.listdir(inner.root.removeprefix("file:")) == [] and sorted(r.x for r in kept.collect()) == [0, 2, 4, 6]


def test_row_ids_do_not_clash(spark):
    df = spark.createDataFrame([(1, 2)], "ROW_ID__ int, row_id___ int")
    rows, rid = with_row_ids(df, Staging(spark, "t"))
    assert rid not in df.columns and rows.columns == [*df.columns, rid]
    assert fresh(df, "other") == "other"


def test_a_worker_holds_one_table():
    from tally.llm.common import per_worker
    made = []

    def make(x):
        made.append(x)
        return [x]
    first = per_worker(("a", 1), lambda: make("a"))
    assert per_worker(("a", 1), lambda: make("never")) is first
    assert per_worker(("b",), lambda: make("b")) == ["b"] and per_worker(("a", 1), lambda: make("c")) == ["c"]
    assert made == ["a", "b", "c"]

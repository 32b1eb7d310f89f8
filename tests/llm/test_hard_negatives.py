"""Cover trees and hard negatives against all products."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pytest

from quantloom.llm import hard_negatives, queries
from quantloom.llm.cover_tree import CoverTree, Search

COLUMNS = ["anchor_id", "negative_id", "negative_score", "positive_id", "positive_score", "rank"]


def brute(table: list[tuple], every: int = 100, positives: int = 5, negatives: int = 10) -> list[tuple]:
    kept: dict[int, tuple] = {}
    for vec_id, v, label in table:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        entry = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v])
        kept[vec_id] = min(kept.get(vec_id, entry), entry)
    out = []
    for anchor, (label, v) in kept.items():
        if anchor % every:
            continue
        score = {i: sum(a * b for a, b in zip(v, w, strict=False)) for i, (_, w) in kept.items()}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if i != anchor and kept[i][0] == label][:positives]:
            fits = [i for i in ranked if kept[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(anchor, i, score[i], p, score[p], n) for n, i in enumerate(fits[:negatives], 1)]
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize(("n", "size", "clusters"), [(1, 3, 1), (300, 4, 5), (500, 16, 40), (200, 2, 1)])
def test_tree(n, size, clusters):
    pick = np.random.default_rng(n)
    middle = pick.normal(0, 200, (clusters, size))
    points = np.floor(middle[pick.integers(0, clusters, n)] + pick.normal(0, 8, (n, size))).astype(np.int64)
    points[n // 2 :] = points[: n - n // 2]  # ties
    ids, labels = pick.permutation(n), pick.integers(0, 3, n)
    tree = CoverTree(points, ids, labels)
    place = {i: at for at, i in enumerate(ids)}
    assert sorted(tree.ids) == sorted(ids)
    seen = 0
    for at in range(0, n, 7):
        query = tree.query(points[at])
        score = {int(i): int(points[place[i]] @ points[at]) for i in ids}
        for k, label, same, window in ((5, 1, True, None), (10, 1, False, (100, 30_000)), (3, 9, False, (-5000, 5000))):
            least, most = window or (-math.inf, math.inf)
            expect = sorted((-s, i) for i, s in score.items() if (labels[place[i]] == label) == same and least <= s <= most)[:k]
            assert query.best(k, label, same, None, window) == [(-s, i) for s, i in expect]
        seen += query.seen
    if clusters > 10:
        assert seen < 0.9 * n * len(range(0, n, 7))  # whole parts of the tree are passed over


def test_products_of_any_size():
    tree = CoverTree(np.array([[2**60, 1], [2**60, 2], [1, 1]]), np.array([1, 2, 3]), np.array([0, 0, 0]))
    assert tree.query(np.array([2**40, 1])).best(2, 0, True) == [(2**100 + 2, 2), (2**100 + 1, 1)]


@pytest.mark.parametrize("shard", [16, 1000])
def test_mine(spark, shard):
    pick = np.random.default_rng(5)
    middle = pick.normal(0, 1, (6, 5))
    table = [(int(i), [float(x) for x in middle[i % 6] + pick.normal(0, 0.3, 5)], int(i % 4)) for i in range(240)]
    table += [(1000, [0.0] * 5, 1), (700, table[3][1], 2), (701, table[3][1], 2), (702, table[3][1], 1)]  # zero scores, ties
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>, label int").repartition(5)
    table = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    expect = brute(table, 20)
    assert len(expect) > 100
    assert got(hard_negatives.mine(df, 20, shard=shard, sample=7, block=3)) == expect


def test_awkward(spark):
    table = [(0, [1.0, 1.0], 3), (0, [1.0, 1.0], 3), (2, [2.0, 1.0], 3), (3, [0.5, 0.5], 1), (4, [0.5, None], 1), (5, None, 1), (6, [float("nan"), 0.0], 1), (8, [float("inf"), 0.0], 1), (None, [1.0, 1.0], 1)]
    table += [(9, [1.0, 0.4], None), (10, [0.6], 2), (11, [0.3, 0.7, 9.0], 2), (100, [], 4), (12, [-1.0, 0.2], 4), (13, [0.3, 0.5], 2), (13, [0.4, 0.5], 2), (300, [7.0, 7.0], 8)]
    df = spark.createDataFrame([(*r, "x", 1) for r in table], "vec_id bigint, embedding array<double>, label int, anchor string, shard int")
    expect = brute(table)
    assert len(expect) > 0
    assert got(hard_negatives.mine(df)) == expect
    assert hard_negatives.mine(df.limit(0)).collect() == []


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    for p in os.listdir(sf):
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{sf}/{p}'")
    theirs = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op12_hard_negatives']})").fetchall()
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    ours = got(queries.op12_hard_negatives(spark, sf))
    assert ours == sorted(theirs) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


@pytest.mark.parametrize("scale", [1, 2**22, 2**38])  # floats, doubles and longer integers hold the products
@pytest.mark.parametrize("same", [True, False])
def test_many_queries(scale, same):
    pick = np.random.default_rng(scale % 97)
    middle = pick.normal(0, 40, (12, 8))
    points = np.floor(middle[pick.integers(0, 12, 900)] + pick.normal(0, 2, (900, 8))).astype(np.int64)
    points[::3] *= scale
    points[5::9] = points[5]  # ties
    ids, labels = pick.permutation(900), pick.integers(0, 3, 900)
    asked = np.r_[pick.permutation(900)[:150], 5]
    least = np.full((len(asked), 2), -math.inf, object)
    most = np.full((len(asked), 2), math.inf, object)
    for at in range(0, len(asked), 2):
        top = int(points[asked[at]].astype(object) @ points[asked[at]].astype(object))
        least[at], most[at] = [-(-30 * top // 100), 5], [90 * top // 100, 5]
    search = Search(points[asked], ids[asked], labels[asked], least, most, 7, same)
    for part in np.array_split(pick.permutation(900), 4):
        search.meet(CoverTree(points[part], ids[part], labels[part]))
    found: dict[tuple[int, int], list] = {}
    for query, window, score, number in zip(*search.answers(), strict=True):
        found.setdefault((query, window), []).append((int(score), int(number)))
    long = [[int(x) for x in p] for p in points]
    for at, q in enumerate(asked):
        score = [sum(a * b for a, b in zip(p, long[q], strict=True)) for p in long]
        for window in range(2):
            fits = [i for i in range(900) if (labels[i] == labels[q]) == same and i != q and least[at, window] <= score[i] <= most[at, window]]
            expect = sorted(((score[i], int(ids[i])) for i in fits), key=lambda e: (-e[0], e[1]))[:7]
            assert found.get((at, window), []) == expect


def test_bounds_save_products(monkeypatch):
    pick = np.random.default_rng(11)
    points = np.floor(pick.normal(0, 200, (20, 16))[np.repeat(np.arange(20), 100)] + pick.normal(0, 4, (2000, 16))).astype(np.int64)
    ids, labels, scored = np.arange(2000), np.arange(2000) % 3, []
    take = Search._take
    monkeypatch.setattr(Search, "_take", lambda self, tree, of, columns, who: scored.append(len(tree.ids[columns]) * len(who)) or take(self, tree, of, columns, who))
    asked = np.arange(0, 2000, 4)
    top = np.array([[float(points[i] @ points[i])] for i in asked])
    search = Search(points[asked], ids[asked], labels[asked], top * 0.8, top * 2, 5, False)
    search.meet(CoverTree(points, ids, labels))
    assert 0 < sum(scored) < 0.3 * 2000 * len(asked) and len(scored) < 100
    assert len(search.answers()[0]) == 5 * len(asked)


def test_answers_dont_grow_with_shards(spark, monkeypatch):
    """An anchor's answers handed on are bounded by the groups, whatever the number of shards; each shard gave its own before."""
    monkeypatch.setattr(hard_negatives, "GROUPS", 4, raising=False)
    pick = np.random.default_rng(3)
    table = [(int(i), [float(x) for x in pick.normal(0, 1, 6)], int(i % 2)) for i in range(1200)]
    vectors = hard_negatives.quantised(spark.createDataFrame(table, "vec_id bigint, embedding array<float>, label int")).cache()
    regions, trees, shards = hard_negatives.build_index(vectors, 40, 8)
    assert shards >= 30
    nothing = hard_negatives.F.expr("cast(array() as array<struct<id:bigint,score:bigint>>)").alias("wanted")
    asking = vectors.where("vec_id % 50 = 0").select("vec_id", "label", "v", nothing)
    answers = hard_negatives._answers(asking, trees, regions, shards, 2, 5, True).groupBy("anchor_id").count().collect()
    assert len(answers) == 24 and all(5 <= r["count"] <= 4 * 5 for r in answers)


def test_long_components(spark):
    pick = np.random.default_rng(8)
    table = [(int(i), [float(x) for x in pick.normal(0, 1, 5) * (1e6 if i % 3 == 0 else 1)], int(i % 4)) for i in range(200)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int")
    expect = brute(table, 10)
    assert len(expect) > 100
    assert got(hard_negatives.mine(df, 10, shard=32, sample=9, block=6)) == expect

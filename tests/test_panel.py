"""Panel inference against plain loops, and its edge cases."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import panel

DAY = dt.date(2020, 1, 1)


def frame(spark, seed: int = 3, n: int = 60, assets: int = 5):
    pick = np.random.default_rng(seed)
    rows = []
    for t in range(n):
        shock = pick.normal()
        for a in range(assets):
            x, z = pick.normal(), pick.normal()
            rows.append((a, DAY + dt.timedelta(days=t), float(x), float(z), float(0.5 * x + shock + 0.3 * pick.normal())))
    return rows, spark.createDataFrame(rows, "a int, at date, x double, z double, y double")


def plain_lasso(y, x, alpha=0.08, rounds=300):
    std = lambda v: (np.where(np.isnan(v), 0, (v - np.nanmean(v)) / (np.nanstd(v) or 1)))
    y, x = std(np.array(y)), np.column_stack([std(np.array(c)) for c in x])
    g, c, b = x.T @ x, x.T @ y, np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(len(b)):
            own = g[j, j] or 1.0
            pull = (c[j] - g[j] @ b + g[j, j] * b[j]) / own
            b[j] = np.sign(pull) * max(abs(pull) - alpha * len(y) / own, 0)
    return b


def test_lasso(spark):
    rows, df = frame(spark)
    df = df.withColumn("flat", F.lit(1.0)).withColumn("x", F.when(F.col("z") < 1.3, F.col("x")))
    got = {r.a: r for r in panel.lasso(df, ["a"], "y", ["x", "z", "flat"]).collect()}
    for a in range(5):
        mine = [r for r in rows if r[0] == a]
        want = plain_lasso([r[4] for r in mine], [[r[2] if r[3] < 1.3 else math.nan for r in mine], [r[3] for r in mine]])
        assert (got[a].b_x, got[a].b_z) == pytest.approx(want, abs=1e-9) and got[a].b_flat == 0.0 and got[a].n == 60
    few = panel.lasso(df.where("at < '2020-01-05'"), ["a"], "y", ["x", "z"]).collect()
    assert all((r.n, r.b_x, r.b_z) == (4, 0.0, 0.0) for r in few)
    assert panel.lasso(df.limit(0), ["a"], "y", ["x"]).collect() == []


def test_driscoll_kraay(spark):
    rows, df = frame(spark)
    y = np.array([r[4] for r in rows])
    x = np.column_stack([np.ones(len(rows)), [r[2] for r in rows], [r[3] for r in rows]])
    bread = np.linalg.inv(x.T @ x)
    beta = bread @ x.T @ y
    at = np.array([(r[1] - DAY).days for r in rows])
    h = np.array([(x[at == t] * (y - x @ beta)[at == t][:, None]).sum(axis=0) for t in range(60)])
    s = h.T @ h
    for k in range(1, 4):
        cross = h[k:].T @ h[:-k]
        s += (1 - k / 4) * (cross + cross.T)
    want = dict(zip(["const", "x", "z"], beta / np.sqrt(np.diag(bread @ s @ bread)), strict=True))
    broken = df.unionByName(spark.createDataFrame([(9, None, 1.0, 1.0, 1.0), (9, DAY, None, 1.0, 1.0)], df.schema))
    got = {r.term: (r.b, r.t) for r in panel.driscoll_kraay(broken, "y", ["x", "z"], "at", 3).collect()}
    for i, c in enumerate(want):
        assert got[c] == pytest.approx((beta[i], want[c]), rel=1e-6)
    singular = panel.driscoll_kraay(df.withColumn("w", F.col("x") * 2), "y", ["x", "w"], "at", 3).collect()
    assert all(r.t is None for r in singular)


def test_draws(spark):
    got = panel.stationary_draws(spark.createDataFrame([(40,)], "n bigint"), 50, 5, 1).orderBy("draw", "pos").collect()
    assert len(got) == 2000 and {r.idx for r in got} == set(range(40))
    runs = sum((b.idx - a.idx) % 40 != 1 for a, b in itertools.pairwise(got) if a.draw == b.draw)
    assert 0.15 < runs / 1950 < 0.25  # a new block a fifth of the time


def test_reality_check(spark):
    pick = np.random.default_rng(4)
    noise = [(f"s{k}", DAY + dt.timedelta(days=t), float(pick.normal(0, 1))) for k in range(8) for t in range(120)]
    good = noise + [("good", DAY + dt.timedelta(days=t), float(pick.normal(0.5, 1))) for t in range(120)]
    run = lambda rows, **how: panel.reality_check(spark.createDataFrame(rows, "s string, at date, x double"), "s", "at", "x", draws=300, **how).collect()
    assert run(noise)[0].p > 0.05 and run(good)[0].p < 0.02 and run(good)[0].k == 9
    assert run([r for r in noise if (r[1] - DAY).days < 9]) == []


def plain_cscv(m, blocks):
    size = len(m) // blocks
    sharpe = lambda v: v.mean() / v.std(ddof=1) if v.std(ddof=1) > 1e-9 else 0.0
    out = {}
    for half in itertools.combinations(range(blocks), blocks // 2):
        if 0 not in half:
            continue
        rows = np.concatenate([np.arange(b * size, (b + 1) * size) for b in half])
        others = np.concatenate([np.arange(b * size, (b + 1) * size) for b in range(blocks) if b not in half])
        inner, outer = [sharpe(m[rows, c]) for c in range(m.shape[1])], [sharpe(m[others, c]) for c in range(m.shape[1])]
        best = max(range(m.shape[1]), key=lambda c: inner[c])
        out[sum(1 << b for b in half)] = (best, 1 + sum(v < outer[best] for v in outer))
    return out


def test_cscv(spark):
    m = np.random.default_rng(8).normal(0, 1, (53, 4))
    m[:, 3] = 0.25  # no spread
    rows = [(c, DAY + dt.timedelta(days=t), float(m[t, c])) for t in range(53) for c in range(4)]
    df = spark.createDataFrame(rows, "c int, at date, x double")
    got = {r.split: (r.best, r["rank"]) for r in panel.cscv(df, "c", "at", "x", 6).collect()}
    assert got == plain_cscv(m, 6)
    assert all(r.overfit == (r["rank"] / 5 <= 0.5) for r in panel.cscv(df, "c", "at", "x", 6).collect())
    assert panel.cscv(df.where("c = 1"), "c", "at", "x", 6).collect() == [] and panel.cscv(df.where("at < '2020-01-04'"), "c", "at", "x", 6).collect() == []


def test_purged_folds(spark):
    rows = [(DAY + dt.timedelta(days=t), DAY + dt.timedelta(days=t + t % 4), i) for t in range(20) for i in range(1 + t % 3)] + [(None, DAY, 99), (DAY, None, 99)]
    df = spark.createDataFrame(rows, "b date, e date, id int")
    for folds, embargo in ((4, 0), (3, 2), (5, 100)):
        ordered = sorted((r for r in rows if r[2] != 99), key=lambda r: (r[0], r[2]))
        size, want = len(ordered) // folds, set()
        for f in range(folds):
            test = ordered[f * size : len(ordered) if f == folds - 1 else (f + 1) * size]
            low, high = min(r[0] for r in test) - dt.timedelta(days=embargo), max(r[1] for r in test) + dt.timedelta(days=embargo)
            want |= {(f, r[0], r[2], "test") for r in test} | {(f, r[0], r[2], "train") for r in ordered if r[0] > high or r[1] < low}
        got = panel.purged_folds(df, "b", "e", ["id"], folds, embargo).collect()
        assert {(r.fold, r.b, r.id, r.role) for r in got} == want and len(got) == len(want)
    assert panel.purged_folds(df.limit(2), "b", "e", ["id"], 5).collect() == []

"""Path odds against simulated walks and numeric integrals, projections and scores against plain loops."""

from __future__ import annotations

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.stats import normal_quantile
from quantloom.operators import paths

N = NormalDist()
DAY = dt.date(2020, 1, 6)


def reach(b, s, m):
    return 1.0 if b <= 0 else min(1.0, N.cdf((m - b) / s) + math.exp(2 * m * b / s**2) * math.erfc((b + m) / s / math.sqrt(2)) / 2)


def test_normal_quantile(spark):
    ps = [0.0, 1e-9, 0.001, 0.024, 0.3, 0.5, 0.7, 0.976, 0.99999, 1.0, -1.0, 2.0]
    got = [r.q for r in spark.createDataFrame([(p,) for p in [*ps, None]], "p double").select(normal_quantile(F.col("p")).alias("q")).collect()]
    assert got[0] == got[10] == -math.inf and got[9] == got[11] == math.inf and got[12] is None
    assert got[1:9] == pytest.approx([N.inv_cdf(p) for p in ps[1:9]], rel=1e-7, abs=1e-8)


def test_maximum_against_integrals(spark):
    cases = [(0.1, 0.0), (0.1, 0.02), (0.1, -0.05), (0.2, 0.5), (0.1, 1e-6), (0.3, 0.08), (0.3, 0.0899), (0.3, 0.0901)]
    df = spark.createDataFrame([*cases, (0.0, 0.2), (0.0, -0.2), (None, 0.1)], "s double, m double")
    s, m = F.col("s"), F.col("m")
    got = df.select(paths.mean_maximum(s, m).alias("up"), paths.mean_minimum(s, m).alias("down"), *(paths.maximum_quantile(F.lit(p), s, m).alias(f"q{i}") for i, p in enumerate((0.2, 0.9)))).collect()
    for (sd, mu), r in zip(cases, got, strict=False):
        b = np.linspace(0, max(mu, 0) + 12 * sd, 4001)
        assert r.up == pytest.approx(np.trapezoid([reach(x, sd, mu) for x in b], b), abs=2e-5)
        b = np.linspace(0, max(-mu, 0) + 12 * sd, 4001)
        assert r.down == pytest.approx(np.trapezoid([reach(x, sd, -mu) for x in b], b), abs=2e-5)
        assert [1 - reach(q, sd, mu) for q in (r.q0, r.q1)] == pytest.approx([0.2, 0.9], abs=1e-5)
    assert (got[8].up, got[9].up, got[9].down, got[8].q1) == (0.2, 0.0, 0.2, 0.2) and got[10].up is None


def test_odds_against_walks(spark):
    """Fine walks stand a little below the continuous path, by about 0.58 steps' deviations."""
    pick, steps = np.random.default_rng(1), 1000
    s, m, b = 0.1, 0.03, 0.06
    walk = np.cumsum(pick.normal(m / steps, s / math.sqrt(steps), (20_000, steps)), axis=1)
    top, end = walk.max(axis=1) + 0.5826 * s / math.sqrt(steps), walk[:, -1]
    for k in (0.0, 0.04, 0.1):
        got = spark.range(1).select(*(F.lit(x).alias(n) for n, x in (("s", s), ("m", m), ("b", b), ("k", k)))).select(paths.touch_up(F.col("b"), F.col("s"), F.col("m")).alias("t"), paths.ends_above_after_touch(F.col("b"), F.col("k"), F.col("s"), F.col("m")).alias("e")).first()
        assert got.t == pytest.approx((top >= b).mean(), abs=0.012)
        assert got.e == pytest.approx((end[top >= b] >= k).mean(), abs=0.015)


def test_odds_at_the_edges(spark):
    df = spark.createDataFrame([(0.5, 0.001, 0.4), (0.5, 0.001, -0.4), (0.0, 0.1, 0.0), (0.1, 0.0, 0.2), (0.1, 0.0, 0.05), (None, 0.1, 0.0)], "b double, s double, m double")
    got = df.select(paths.touch_up(F.col("b"), F.col("s"), F.col("m")).alias("t"), paths.ends_above_after_touch(F.col("b"), F.lit(0.05), F.col("s"), F.col("m")).alias("e")).collect()
    assert [(r.t, r.e) for r in got[:2]] == [(0.0, 0.0)] * 2 and got[2].t == 1.0 and got[3].e == 1.0 and got[4].e == 0.0 and got[5].t is None
    p = spark.createDataFrame([(100.0, 100.0, 0.1), (100.0, 110.0, 0.01), (100.0, 900.0, 0.001), (100.0, 0.0, 0.1), (100.0, 110.0, 0.0), (None, 1.0, 0.1)], "a double, b double, s double").select(paths.median_touch(F.col("a"), F.col("b"), F.col("s")).alias("d")).collect()
    assert [r.d for r in p] == [0.0, round((math.log(1.1) / (0.01 * N.inv_cdf(0.75))) ** 2, 1), 252.0, None, None, None]


def series(spark, values, name="a"):
    rows = [(name, DAY + dt.timedelta(days=7 * i), float(c), math.log(c / values[i - 1]) if i else None) for i, c in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, wk date, c double, lr double")


def test_projection_against_a_loop(spark):
    pick = np.random.default_rng(7)
    c = 100 * np.exp(np.cumsum(pick.normal(0.01, 0.02, 80)))
    lr = np.diff(np.log(c))
    ret = series(spark, c)
    got = {r.h: r for r in paths.project(ret, (1, 5, 30), paths.horizon_residuals(ret, (5,)), cap_bar=0.3, most=0.4).collect()}
    var = lr[0] ** 2
    for x in lr[1:]:
        var = 0.94 * var + 0.06 * x * x
    sigma = 0.5 * math.sqrt(var) + 0.5 * lr[-20:].std(ddof=1)
    edge = max(-0.3 * sigma, min(0.3 * sigma, lr[-26:].mean()))
    p = np.log(c)
    slope = np.polyfit(p[:-1], np.diff(p), 1)[0]
    half = min(-math.log(2) / slope, 252) if slope < 0 else 3.0
    for h, r in got.items():
        sums = np.convolve(lr, np.ones(h), "valid")
        vr = sums.var(ddof=1) / (h * lr.var(ddof=1)) if h > 1 and len(lr) >= 4 * h else 1.0
        sd = sigma * math.sqrt(h * vr)
        free = edge * sum(0.5 ** (i / half) for i in range(h))
        mu = max(-0.4 * sd, min(0.4 * sd, free))
        lo, hi = np.quantile(sums - h * lr.mean(), [0.05, 0.95]) if h == 5 else (-sd, sd)
        assert (r.mu, r.sd, r.projected, r.low, r.high) == pytest.approx((mu, sd, c[-1] * math.exp(mu), c[-1] * math.exp(mu + lo), c[-1] * math.exp(mu + hi)))
        assert (r.capped, r.band) == (abs(free) > 0.4 * sd, "conformal" if h == 5 else "parametric")
    assert paths.project(ret.limit(0), (1,)).collect() == [] and paths.project(series(spark, c[:1]), (1, 5)).collect() == []
    flat = paths.project(series(spark, [5.0] * 30), (5,)).first()
    assert (flat.mu, flat.sd, flat.z_edge, flat.projected) == (0.0, 0.0, None, pytest.approx(5.0))


def test_scores(spark):
    df = spark.createDataFrame([("a", 1, 100.0, math.log(1.1), 0.1, 121.0), ("a", 2, 100.0, 0.0, 0.0, 100.0), ("a", 3, 100.0, -0.1, 0.1, 105.0), ("a", 4, 100.0, 0.1, 0.1, None)], "ticker string, wk int, price double, mu double, sd double, realised double")
    a, b, c, d = paths.score(df).orderBy("wk").collect()
    assert (a.price_error, a.pct_error, a.z_error, a.direction, a.magnitude, a.skill) == pytest.approx((11.0, 0.1, math.log(1.1) / 0.1, True, 2.0, 0.5))
    assert (b.direction, b.z_error, b.magnitude, b.skill) == (True, None, None, None) and c.direction is False and c.skill < 0
    assert (d.log_error, d.z_error, d.direction) == (None, None, None)


def test_skill_and_clusters(spark):
    rows = [("up", i, z, z * 0.1, 0.05) for i, z in enumerate((0.1, -3.0, 1.6, 1.7, 1.8))] + [("mixed", i, z, z * 0.1, 0.05) for i, z in enumerate((1.6, -1.7, 1.8))] + [("short", i, 2.0, 0.2, 0.05) for i in range(2)] + [("none", 0, None, None, 0.05)]
    got = {r.ticker: r for r in paths.skill(spark.createDataFrame(rows, "ticker string, wk int, z_error double, log_error double, mu double")).collect()}
    assert {k: r.clustered_miss for k, r in got.items()} == {"up": True, "mixed": False, "short": False}
    e = np.array([0.1, -3.0, 1.6, 1.7, 1.8]) * 0.1
    assert (got["up"].n, got["up"].bias, got["up"].mase) == (5, pytest.approx(0.44), pytest.approx(np.abs(e).mean() / np.abs(e + 0.05).mean()))


def test_tracking_ends_at_the_target(spark):
    rows = [("a", 1, 100.0, 0.2, 0.1, 4, e, close) for e, close in ((1, 101.0), (2, 115.0), (3, 112.0), (4, 100 * math.exp(0.2)))]
    got = paths.track(spark.createDataFrame(rows, "ticker string, wk int, price double, mu double, sd double, h int, e int, close double")).orderBy("e").collect()
    keep = 0.5 ** (1 / 3)
    assert [r.expected for r in got] == pytest.approx([100 * math.exp(0.2 * (1 - keep**e) / (1 - keep**4)) for e in (1, 2, 3, 4)])
    assert got[3].gap == pytest.approx(0, abs=1e-12) and [r.state for r in got] == [None, "reverting", "diverging", "reverting"]


def test_contradiction(spark):
    rows = [("a", "x", 1.0, 1.0), ("a", "y", -2.0, 3.0), ("a", "z", 0.0, 9.0), ("a", "w", None, 9.0), ("b", "x", 1.0, 1.0), ("b", "y", -1.0, 1.0), ("c", "x", float("nan"), 1.0), ("d", "x", 5.0, 2.0)]
    got = {r.k: (r.contradiction, r.direction, r.against) for r in paths.contradiction(spark.createDataFrame(rows, "k string, name string, value double, weight double"), "k").collect()}
    assert got == {"a": (0.25, "down", "x"), "b": (1.0, "mixed", "x,y"), "c": (0.0, "flat", ""), "d": (0.0, "up", "")}

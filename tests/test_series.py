"""Rules over series against plain loops."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest

from quantloom.operators import series

DAY = dt.date(2020, 1, 6)
WEEKS = [DAY + dt.timedelta(days=7 * i) for i in range(200)]


def bars(spark, **names):
    return spark.createDataFrame([(k, WEEKS[i], None if c is None else float(c)) for k, v in names.items() for i, c in enumerate(v)], "ticker string, wk date, c double")


def walk(seed, n, pull=0.0):
    pick, x = np.random.default_rng(seed), [3.0]
    for e in pick.normal(0, 0.03, n - 1):
        x.append(x[-1] - pull * (x[-1] - 3.0) + e)
    return np.exp(x)


def test_reversion(spark):
    names = {"pulled": walk(1, 120, 0.3), "free": walk(2, 120), "zigzag": [10.0 + (-1) ** i + 0.01 * (i % 7) for i in range(60)], "short": walk(3, 29), "flat": [5.0] * 60}
    got = {r.ticker: r for r in series.reversion(bars(spark, **names)).collect()}
    assert set(got) == {"pulled", "free", "zigzag"}
    for k in ("pulled", "free"):
        x = np.log(names[k])
        b, a = np.polyfit(x[:-1], x[1:], 1)
        s2 = ((x[1:] - a - b * x[:-1]) ** 2).sum() / (len(x) - 3)
        se, mu, speed = math.sqrt(s2 / ((x[:-1] - x[:-1].mean()) ** 2).sum()), a / (1 - b), -math.log(b)
        r = got[k]
        assert (r.phi, r.se, r.mean_price, r.half_life, r.z) == pytest.approx((b, se, math.exp(mu), math.log(2) / speed, (x[-1] - mu) / math.sqrt(s2 / (1 - b * b))))
        assert r.drift_5 == pytest.approx((mu - x[-1]) * (1 - math.exp(-5 * speed))) and r.reverts == (1 - b > 1.96 * se)
    z = got["zigzag"]
    assert (z.speed, z.half_life, z.phi < 0) == (math.inf, None, True) and z.drift_1 == z.drift_21 == pytest.approx(math.log(z.mean_price / names["zigzag"][-1]))


def test_velocity(spark):
    c = walk(4, 90)
    x, a = np.log(c), 2 / 22
    e = [x[0]]
    for v in x[1:]:
        e.append(e[-1] + a * (v - e[-1]))
    sd = np.diff(x)[-60:].std(ddof=1)
    got = {r.ticker: r for r in series.velocity(bars(spark, a=[None, 0.0, *c], b=c[:25], flat=[2.0] * 30)).collect()}
    assert (got["a"].velocity, got["a"].acceleration) == pytest.approx(((e[-1] - e[-2]) / sd, (e[-1] - 2 * e[-2] + e[-3]) / sd))
    assert (got["b"].velocity, got["b"].acceleration) == (None, None) and got["flat"].velocity == pytest.approx(0, abs=1e-5)


def test_falls(spark):
    c = [10, 8, 7, 7, 10, 12, None, 11, 13, 9, 6, 12]
    got = {(r.start, r.trough, round(r.depth, 6), r.recovery, r.bars) for r in series.falls(bars(spark, a=c, up=[1, 2, 3], one=[5])).collect()}
    assert got == {(WEEKS[1], WEEKS[2], -0.3, WEEKS[4], 2), (WEEKS[7], WEEKS[7], round(11 / 12 - 1, 6), WEEKS[8], 1), (WEEKS[9], WEEKS[10], round(6 / 13 - 1, 6), None, None)}
    assert series.falls(bars(spark, a=[1]).limit(0)).collect() == []


def test_total_return(spark):
    cash = spark.createDataFrame([("a", WEEKS[1], 1.0), ("a", WEEKS[1], 0.5), ("a", WEEKS[3], 2.0), ("a", WEEKS[0], 9.0), ("z", WEEKS[1], 1.0), ("a", WEEKS[2], None)], "ticker string, wk date, cash double")
    got = {(r.ticker, r.wk): (r.total_index, r.price_index) for r in series.total_return(bars(spark, a=[10, 11, 9, None, 12], b=[4, 5]), cash).collect()}
    tr = [100.0, 100 * 12.5 / 10, 100 * 1.25 * 9 / 11, 100 * 1.25 * 9 / 11 * 12 / 9]
    assert [got["a", WEEKS[i]] for i in (0, 1, 2, 4)] == [pytest.approx(x) for x in zip(tr, (100, 110, 90, 120), strict=True)]
    assert ("a", WEEKS[3]) not in got and got["b", WEEKS[1]] == pytest.approx((125, 125))  # cash of a bar without a price is left out


def test_trend(spark):
    c = walk(5, 80)
    got = {r.ticker: r for r in series.trend(bars(spark, a=c, few=c[:8], steady=[2.0**i for i in range(20)], flat=[1.0] * 60)).collect()}
    r = np.diff(np.log(c))
    w = 0.85 ** np.arange(len(r))[::-1]
    gap = abs(math.log(r[-9:].std(ddof=1) / r[-41:].std(ddof=1)))
    assert (got["a"].efficiency, got["a"].drift, got["a"].flip) == pytest.approx((abs(c[-1] - c[-11]) / np.abs(np.diff(c))[-10:].sum(), (w * r).sum() / w.sum(), round(1 / (1 + math.exp(-(gap - 0.4) / 0.25)), 2)))
    assert (got["few"].efficiency, got["few"].flip) == (0.0, None) and (got["steady"].efficiency, got["steady"].drift) == pytest.approx((1.0, math.log(2)))
    assert (got["flat"].efficiency, got["flat"].drift, got["flat"].flip) == (0.0, 0.0, None)


def test_runs(spark):
    states = ["u", "u", "d", "u", None, None, "u", "u", "u", "d", "d"]
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(states)] + [("b", 0, "u"), ("c", 0, "u"), ("c", 1, None)], "k string, at int, s string")
    got = {(r.k, r.s): (r.runs, r.mean_length, r.longest, r.current) for r in series.runs(df, "k", "at", "s").collect()}
    want = {}
    for s in "ud":
        lengths = [len(list(g)) for k, g in itertools.groupby(states) if k == s]
        want["a", s] = (len(lengths), sum(lengths) / len(lengths), max(lengths), 2 if s == "d" else 0)
    assert got == want | {("b", "u"): (1, 1.0, 1, 1), ("c", "u"): (1, 1.0, 1, 0)}
    flags = [True, True, False, True, None, True, True, True]
    t = series.trailing(spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "k string, at int, f boolean"), "k", "at", "f")
    assert [r.run for r in t.orderBy("at").collect()] == [1, 2, 0, 1, 0, 1, 2, 3] and series.runs(df.limit(0), "k", "at", "s").collect() == []

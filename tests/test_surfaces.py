"""Lattice prices, slices, densities and paths against plain loops and planted data."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import registry
from quantloom.operators import lineage, surfaces

TERMS = "s double, k double, t double, r double, sigma double, q double, kind string"


def lattice(s, k, t, r, v, q, kind, steps, american):
    sign = 1 if kind == "C" else -1
    if min(s, k, t, v) <= 0:
        return max(sign * (s * math.exp(-q * max(t, 0)) - k * math.exp(-r * max(t, 0))), 0)
    u = math.exp(v * math.sqrt(t / steps))
    p = (math.exp((r - q) * t / steps) - 1 / u) / (u - 1 / u)
    if not 0 < p < 1:
        return None
    x = [max(sign * (s * u ** (2 * j - steps) - k), 0) for j in range(steps + 1)]
    for n in range(steps - 1, -1, -1):
        x = [math.exp(-r * t / steps) * (p * x[j + 1] + (1 - p) * x[j]) for j in range(n + 1)]
        if american:
            x = [max(c, sign * (s * u ** (2 * j - n) - k)) for j, c in enumerate(x)]
    return x[0]


@pytest.mark.parametrize("american", [True, False])
def test_binomial(spark, american):
    cases = [(100.0, k, t, 0.05, 0.25, q, kind) for k in (80.0, 100.0, 130.0) for t in (0.1, 2.0) for q in (0.0, 0.08) for kind in "CP"]
    cases += [(0.0, 100.0, 1.0, 0.05, 0.2, 0.0, "P"), (100.0, 90.0, 0.0, 0.05, 0.2, 0.0, "C"), (100.0, 90.0, 1.0, 0.05, 0.0, 0.02, "C"), (100.0, 90.0, 1.0, 0.05, 0.2, 0.0, "C"), (100.0, 90.0, 1.0, 0.05, 0.2, 0.0, "C")]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], TERMS + ", price_id int")
    got = {r.price_id: r.price for r in surfaces.binomial(df, 30, american).collect()}
    for i, c in enumerate(cases):
        assert got[i] == pytest.approx(lattice(*c, 30, american), abs=1e-9), c
    odd = spark.createDataFrame([(100.0, 90.0, 1.0, 0.9, 0.01, 0.0, "C"), (100.0, None, 1.0, 0.05, 0.2, 0.0, "C")], TERMS)
    wild, missing = sorted((r.price for r in surfaces.binomial(odd, 4, american).collect()), key=lambda x: x is None)
    d1 = (math.log(100 / 90) + 0.9 + 0.00005) / 0.01
    assert wild == pytest.approx(100 * NormalDist().cdf(d1) - 90 * math.exp(-0.9) * NormalDist().cdf(d1 - 0.01), abs=1e-4) and missing is None


def test_early_exercise_is_worth_something(spark):
    df = spark.createDataFrame([(100.0, 120.0, 1.0, 0.08, 0.2, 0.0, "P"), (100.0, 120.0, 1.0, 0.08, 0.2, 0.0, "C")], TERMS)
    us, eu = ({r.kind: r.price for r in surfaces.binomial(df, 60, a).collect()} for a in (True, False))
    assert us["P"] > eu["P"] + 0.5 and us["P"] >= 20 and us["C"] == pytest.approx(eu["C"], abs=1e-9)


def test_density(spark):
    n = NormalDist()
    rows = []
    for k in range(50, 160, 5):
        d1 = (math.log(100 / k) + 0.03 + 0.02) / 0.2
        rows.append(("smooth", float(k), 1.0, 0.03, 100 * n.cdf(d1) - k * math.exp(-0.03) * n.cdf(d1 - 0.2)))
    rows += [("bent", k, 1.0, 0.0, p) for k, p in ((90.0, 12.0), (100.0, 9.0), (110.0, 1.0), (120.0, 0.5))] + [("short", 1.0, 1.0, 0.0, 1.0), ("short", 2.0, 1.0, 0.0, 0.5), ("bent", None, 1.0, 0.0, 3.0)]
    got = surfaces.implied_density(spark.createDataFrame(rows, "id string, k double, t double, r double, price double"), ["id"]).collect()
    smooth = sorted((r.k, r.density) for r in got if r.id == "smooth")
    assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in itertools.pairwise(smooth)) == pytest.approx(1)
    assert max(smooth, key=lambda x: x[1])[0] in (95.0, 100.0) and all(r.violations == 0 for r in got if r.id == "smooth")
    bent = {r.k: r for r in got if r.id == "bent"}
    assert bent[100.0].raw == pytest.approx((12 - 18 + 1) / 100) and bent[100.0].density == 0 and bent[100.0].violations == 1 and bent[100.0].negative == pytest.approx(0.05 / 0.125, abs=1e-4)
    assert not any(r.id == "short" for r in got)


def test_slices_are_found_again(spark):
    x = np.round(np.linspace(-0.8, 0.8, 25), 3)
    planted = {"skewed": (0.02, 0.2, -0.6, 0.05, 0.15), "flat": (0.05, 0.02, 0.1, 0.0, 0.4), "right": (0.01, 0.1, 0.5, -0.1, 0.2)}
    rows = [(n, float(v), float(w), 0.5) for n, p in planted.items() for v, w in zip(x, surfaces.slice_variance(x, np.array(p)), strict=True)]
    rows += [("few", float(i), 0.1, 0.5) for i in range(4)] + [("skewed", None, 0.1, 0.5), ("skewed", 0.0, None, 0.5)]
    got = {r.id: r for r in surfaces.calibrate_slices(spark.createDataFrame(rows, "id string, x double, w double, t double"), ["id"]).collect()}
    for n, p in planted.items():
        assert got[n].rmse < 1e-6
        assert (got[n].a, got[n].b, got[n].rho, got[n].m, got[n].s) == pytest.approx(p, abs=2e-3)
        a, b, rho, m, s = p
        assert got[n].skew == pytest.approx(b * (rho - m / math.hypot(m, s)), abs=1e-3) and got[n].atm_vol == pytest.approx(math.sqrt((a + b * (-rho * m + math.hypot(m, s))) / 0.5), abs=1e-4)
    assert got["few"].a is None and got["few"].n == 4


def test_slices_of_the_query_are_best_near_themselves(spark, sf):
    for r in registry.queries()["volatility_slices"](spark, sf).collect():
        assert r.a is None if r.n < 5 else r.rmse < 0.1 and r.b > 0 and abs(r.rho) <= 1


def test_path_is_the_best_of_all(spark):
    pick = np.random.default_rng(6)
    move = np.log([[0.7, 0.2, 0.1], [0.3, 0.5, 0.2], [0.25, 0.25, 0.5]])
    start = np.log([0.5, 0.3, 0.2])
    rows, day = [], dt.date(2020, 12, 28)
    for key, n in ((1, 7), (2, 1), (3, 6)):
        rows += [(key, day + dt.timedelta(days=int(i)), *map(float, pick.normal(0, 1.5, 3))) for i in range(n)]
    df = spark.createDataFrame([*rows, (4, None, 1.0, 1.0, 1.0), (4, day, None, 1.0, 1.0)], "k int, at date, a double, b double, c double")
    for span in ("year", "month", "day"):
        got = lineage.viterbi(df, "k", "at", ["a", "b", "c"], list(start), move.tolist(), span).collect()
        for key in (1, 2, 3):
            like = np.array([r[2:] for r in rows if r[0] == key])
            score = lambda p: start[p[0]] + like[0, p[0]] + sum(move[a, b] + like[i, b] for i, (a, b) in enumerate(itertools.pairwise(p), 1))  # noqa: E731, B023
            best = max(itertools.product(range(3), repeat=len(like)), key=score)
            mine = sorted((r["at"], r.state, r.best) for r in got if r.k == key)
            assert [s for _, s, _ in mine] == list(best) and mine[0][2] == pytest.approx(score(best))
        assert {r.k for r in got} == {1, 2, 3}
    assert lineage.viterbi(df.limit(0), "k", "at", ["a", "b", "c"], list(start), move.tolist()).collect() == []

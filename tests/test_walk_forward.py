"""Calibration by horizon and regime against a plain loop, and awkward series."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quantloom.operators import walk_forward as wf

SCHEMA = "k string, at int, x double, g string"


def place(xs, share, up):
    xs = sorted(xs)
    at = share * (len(xs) + 1)
    return xs[min(len(xs), max(1, math.ceil(at) if up else math.floor(at))) - 1]


def plain(xs, regimes, n, window=26, alpha=0.1):
    """Quantiles, coverages and regimes' quantiles, sample by sample."""
    made = []
    for i in range(window, len(xs) - n + 1):
        past = np.array(xs[i - window : i])
        mu, sigma = n * past.mean(), math.sqrt(max(n * past.var(ddof=1), 1e-12))
        made.append(((sum(xs[i : i + n]) - mu) / sigma, sigma, regimes[i]))
    cut = int(len(made) * 0.6)
    cal, test = made[: cut - n], made[cut + n :]
    if len(xs) < window + 3 * n + 20 or len(made) < 30 or len(cal) < 15 or len(test) < 15:
        return None
    e = [m[0] for m in cal]
    low, high, sym = place(e, alpha / 2, False), place(e, 1 - alpha / 2, True), place(map(abs, e), 1 - alpha, True)
    groups = {g: [m[0] for m in cal if m[2] == g] for g in {m[2] for m in cal} - {None}}
    own = {g: (place(v, alpha / 2, False), place(v, 1 - alpha / 2, True)) for g, v in groups.items() if len(v) >= 20}
    share = lambda f: sum(map(f, test)) / len(test)
    u = sorted(0.5 * (1 + math.erf(m[0] / math.sqrt(2))) for m in test)
    return {
        "n": len(test), "n_cal": len(cal), "q_lo": low, "q_hi": high, "pad": sym - wf.Z90, "coverage": share(lambda m: low <= m[0] <= high), "coverage_normal": share(lambda m: abs(m[0]) <= wf.Z90),
        "coverage_regime": share(lambda m: own.get(m[2], (low, high))[0] <= m[0] <= own.get(m[2], (low, high))[1]), "width": share(lambda m: m[1] * (high - low)),
        "ks": max(max(abs((i + 1) / len(u) - v), abs(v - i / len(u))) for i, v in enumerate(u)),
    }, own


def series(size, seed, scale=1.0):
    pick = np.random.default_rng(seed)
    return list(map(float, pick.normal(0.001, 0.02 * scale, size) * (1 + (np.arange(size) % 40 > 30)))), [("a", "b", "b", None)[int(v)] for v in pick.integers(0, 4, size)]


def test_against_a_loop(spark):
    panels = {"long": series(220, 1), "short": series(90, 2), "tiny": series(53, 3), "flat": ([0.01] * 120, ["a"] * 120)}
    rows = [(k, i, x, g) for k, (xs, gs) in panels.items() for i, (x, g) in enumerate(zip(xs, gs, strict=True))]
    rows += [("long", 7, None, "a"), ("long", 8, float("nan"), "a"), (None, 1, 0.5, "a")]  # none of these is a date
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.k, r.steps): r for r in wf.calibrate_horizons(df, "k", "at", "x", "g", [1, 5, 20]).collect()}
    wanted = {(k, n): plain(*panels[k], n) for k in panels for n in (1, 5, 20)}
    assert set(got) == {w for w, v in wanted.items() if v} and ("tiny", 5) not in got and ("long", 20) in got
    for at, r in got.items():
        if at[0] != "flat":
            assert {c: r[c] for c in wanted[at][0]} == pytest.approx(wanted[at][0], abs=1e-6)
            assert 0 <= r.wilson_lo <= r.coverage <= r.wilson_hi <= 1 and 0 <= r.ks_p <= 1 and r.within_tolerance == (abs(r.coverage - 0.9) <= 0.05)
    assert got["flat", 1].n == wanted["flat", 1][0]["n"]
    own = {(r.k, r.steps, r.regime): (r.q_lo, r.q_hi) for r in wf.regime_quantiles(df.where("k <> 'flat'"), "k", "at", "x", "g", [1, 5, 20]).collect()}
    want = {(k, n, g): v for (k, n), w in wanted.items() if w and k != "flat" for g, v in w[1].items()}
    assert own.keys() == want.keys() and all(own[k] == pytest.approx(want[k]) for k in own) and ("long", 1, "b") in own


def test_folds_share_no_outcome(spark):
    """No value that a scored outcome sums belongs to an outcome that calibrates."""
    xs, gs = series(150, 5)
    df = spark.createDataFrame([("k", i, x, g) for i, (x, g) in enumerate(zip(xs, gs, strict=True))], SCHEMA)
    for n in (1, 8):
        t = wf.samples(df, "k", "at", "x", "g", [n]).collect()
        assert max(r.j for r in t if r.fold == "cal") + n - 1 < min(r.j for r in t if r.fold == "test") - n
        assert sum(r.fold is None for r in t) == 2 * n


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert wf.calibrate_horizons(none, "k", "at", "x", "g", [1]).collect() == [] == wf.regime_quantiles(none, "k", "at", "x", "g", [1]).collect()

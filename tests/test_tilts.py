"""Rank rules, shrinkage, breadth and tilts against plain arithmetic, with missing and extreme figures."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import ranking, tilts

NAN = float("nan")


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_column_rules(spark):
    x, c, n = F.col("x"), F.col("c"), F.col("n")
    rows = [(2.0, 0.5, 10.0), (-2.0, 0.5, 10.0), (0.2, 0.5, 1.0), (1.0, -3.0, 0.5), (1.0, None, None), (1.0, NAN, 2.0), (None, 1.0, 2.0)]
    got = values(spark, rows, "x double, c double, n double", ranking.toward_zero(x, c), ranking.deflated(x * 3, n), ranking.conviction_sigma(F.lit(2.0), x), ranking.effective_breadth(n, c), ranking.smoothed(c, x, 0.25))
    bar = lambda k: math.sqrt(2 * math.log(k))
    assert got[0] == pytest.approx((1.5, 6 - bar(10), 2.0, 10 / 5.5, 0.875)) and got[1][:2] == pytest.approx((-1.5, bar(10) - 6))
    assert got[2] == pytest.approx((-0.3, 0.6, 10.0, 1.0, 0.425)) and got[3] == pytest.approx((1.0, 3.0, 3.0, 1.0, -2.0))
    assert got[4][0] == 1.0 and got[4][3:] == (1.0, 1.0) and got[5][0] == 1.0 and got[5][3:] == (2.0, 1.0) and got[6][0] is None


def test_errors_costs_and_holding(spark):
    x = F.col("x")
    rows = [(1.0,), (0.0,), (None,), (NAN,), (-1.0,)]
    got = values(spark, rows, "x double", ranking.forecast_error(x, F.lit(3.0), F.lit(1.0), F.lit(8.0), F.lit(10)), ranking.trading_cost(x), ranking.faded(F.lit(4.0), F.lit(10.0), x * 5), ranking.held(x, F.lit(1.2), 0.3))
    assert got[0] == pytest.approx((math.sqrt(0.1 + 4 / 8), 2 * (0.02 + 0.05) + 0.1 * math.sqrt(0.05), 4 * 0.25, 1.0))
    unknown = 2 * (0.02 + 0.1) + 0.2 * math.sqrt(0.05)
    assert got[1][0] is None and got[1][1:] == pytest.approx((unknown, 4.0, 1.2)) and got[2][1:] == pytest.approx((unknown, 4.0, 1.2)) and got[3][1] == pytest.approx(unknown) and got[3][3] == 1.2
    assert got[4][3] == 1.2


def test_empirical_bayes(spark):
    v, e = [1.0, 5.0, 9.0, -3.0], [1.0, 2.0, None, 0.5]
    rows = [("a", x, s) for x, s in zip(v, e, strict=True)] + [("b", 1.0, 1.0), ("b", 2.0, 1.0), (None, 1.0, 1.0), ("a", NAN, 1.0), ("n", 1.0, 9.0), ("n", 1.1, 9.0), ("n", 1.2, 9.0)]
    got = ranking.empirical_bayes(spark.createDataFrame(rows, "g string, x double, se double"), "g", "x", "se").collect()
    assert len(got) == len(rows)
    tau2 = np.var(v, ddof=1) - np.mean([1.0, 4.0, 0.25, 1.0])
    for r in got:
        if r.g == "a" and r.x is not None and r.se is not None:
            w = tau2 / (tau2 + r.se**2)
            assert (r.tau2, r.weight, r.mu, r.sd) == pytest.approx((tau2, w, 3.0 + w * (r.x - 3.0), math.sqrt(w) * r.se))
        elif r.x is not None:  # few names, no error, or noise alone: as it is
            assert (r.mu, r.weight) == (r.x, 1.0)
    assert ranking.empirical_bayes(spark.createDataFrame([], "g string, x double, se double"), "g", "x", "se").collect() == []


def test_composite_rank(spark):
    rows = [("a", 2.0, 3.0, 1.0, 0.4), ("b", -1.0, -0.3, 2.0, None), ("c", 0.5, 1.0, 1.0, NAN)]
    names = spark.createDataFrame(rows, "ticker string, total double, z double, sigma double, se double")
    before = spark.createDataFrame([("a", 1.0), ("c", None), ("z", 4.0)], "ticker string, score double")
    got = {r.ticker: r for r in ranking.composite_rank(names, before, share=0.25).collect()}
    bar = math.sqrt(2 * math.log(3))
    fresh = {"a": 1.8, "b": (-1 + 0.5 * 2 / 0.2) * 0.3 / bar, "c": (0.5 - 0.5 / (1 / 1.5)) / bar}
    assert {k: r.fresh for k, r in got.items()} == pytest.approx(fresh)
    assert {k: r.score for k, r in got.items()} == pytest.approx(fresh | {"a": 0.25 * 1.8 + 0.75})
    one = ranking.composite_rank(names.where("ticker = 'a'")).first()
    assert one.score == one.fresh == pytest.approx(1.8)


def test_entropy(spark):
    rows = [("even", 1.0)] * 4 + [("one", 5.0), ("one", 0.0), ("one", -2.0), ("one", None), ("none", 0.0), ("two", 3.0), ("two", 1.0), ("two", NAN)]
    got = dict(values(spark, rows, "k string, x double", "k", "x") and [tuple(r) for r in ranking.entropy_bets(spark.createDataFrame(rows, "k string, x double"), "k", "x").collect()])
    assert got == pytest.approx({"even": 4.0, "one": 1.0, "none": 1.0, "two": math.exp(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)))})


def test_events(spark):
    got = values(spark, [(["1.03", "8.01"],), ([" 9.99"],), ([],), (None,), (["2.02", None],)], "items array<string>", tilts.severity(F.col("items")))
    assert [x for x, in got] == [0.95, 0.25, 0.0, 0.0, 0.6]
    got = values(spark, [("13D/A", 2.0, True), ("13g", 2.0, False), ("13D", 9.0, False), ("13D", -9.0, None), (None, 5.0, False)], "f string, d double, n boolean", tilts.stake(F.col("f"), F.col("d"), F.col("n")))
    assert [x for x, in got] == pytest.approx([0.8, 0.18, 1.0, -1.0, 0.45])
    got = values(spark, [(10.0, 4.0, 10.0), (0.0, 0.0, 0.0)], "b double, s double, p double", tilts.insider_net(F.col("b"), F.col("s"), F.col("p")))
    assert [x for x, in got] == pytest.approx([2.5 / 17.5, 0.0])
    got = values(spark, [(0.05, 2.0, 1.0, -1.0), (9.0, 99.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "a double, i double, s double, n double", tilts.event_tilt(*map(F.col, "aisn")), tilts.event_tilt(*map(F.col, "aisn"), cap=1.5))
    assert got == [pytest.approx((math.tanh(1), math.tanh(1))), pytest.approx((2.0, 1.5)), (None, None)]


def test_crowding(spark):
    rows = [("float", 60.0, 10.0, 600.0, None, None, None, None), ("cap", 8.0, 10.0, None, 1000.0, 10.0, "elevated", "rising"), ("fund", 90.0, 10.0, None, None, None, "elevated", "rising"), ("idle", 5.0, 0.0, 0.0, 10.0, 0.0, "low", None), ("none", 0.0, 1.0, 1.0, 1.0, 1.0, None, None), ("null", None, 1.0, 1.0, 1.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, "ticker string, fails double, volume double, floats double, cap double, close double, level string, trend string")
    got = {r.ticker: r for r in tilts.crowding(df).collect()}
    assert set(got) == {"float", "cap", "fund", "idle"}
    f, c, u, i = (got[k] for k in ("float", "cap", "fund", "idle"))
    assert (f.days_to_cover, f.short_pct, f.utilization, f.borrow_fee, f.penalty, f.squeeze, f.source) == pytest.approx((6.0, 10.0, 0.6, 0.3 + 9.7 * 0.6**4, 0.06 + 0.05, True, "float"))
    assert (c.short_pct, c.squeeze, c.source) == (pytest.approx(8.0), True, "cap") and (u.short_pct, u.squeeze, u.utilization) == (None, False, 0.9)
    assert (i.days_to_cover, i.utilization, i.short_pct, i.penalty, i.squeeze) == (None, 0.0, None, 0.0, False)


def test_credit(spark):
    rows = [("cash", 100.0, 10.0, 50.0, 20.0, 5.0, 4.0, 1.0, None, None), ("loss", 100.0, 80.0, 10.0, -5.0, -3.0, -4.0, -1.0, 2.0, 3.0), ("high", 100.0, 90.0, 10.0, 30.0, 16.0, 10.0, 0.0, None, None), ("low", 1.0, 12.0, 10.0, 100.0, 2.0, 50.0, -0.1, None, None), ("none", *[None] * 9)]
    df = spark.createDataFrame(rows, "k string, cap double, debt double, cash double, equity double, ebitda double, ebit double, interest double, preferred double, minority double")
    levels = spark.createDataFrame([("high", 2, 20.0), ("high", 1, 10.0), ("high", 3, 0.0), ("high", 4, 40.0), ("low", 1, 5.0), ("loss", 1, None), ("x", 1, 1.0)], "k string, y int, d double")
    got = {r.k: r for r in tilts.credit_report(df, levels, "k", "y", "d").collect()}
    assert set(got) == {r[0] for r in rows}
    assert (got["cash"].net_cash, got["cash"].verdict, got["cash"].ev, got["cash"].tilt) == (True, "net cash", 60.0, pytest.approx((0.45 * 1 + 0.35 * 0) / 0.8))
    assert (got["loss"].ev, got["loss"].ev_ebitda, got["loss"].net_debt_ebitda, got["loss"].debt_equity, got["loss"].coverage, got["loss"].tilt, got["loss"].verdict) == (175.0, None, None, None, -4.0, -1.0, "insufficient data")
    h = got["high"]
    assert (h.net_debt_ebitda, h.coverage, h.last_step, h.growth, h.verdict) == (5.0, None, 1.0, pytest.approx(1.0), "high leverage") and h.tilt == pytest.approx((-0.75 * 0.45 - 0.2) / 0.65)
    assert (got["low"].verdict, got["low"].coverage, got["low"].growth) == ("low leverage", 100.0, None)
    assert (got["none"].tilt, got["none"].net_cash, got["none"].verdict) == (None, False, "insufficient data")


def test_macro(spark):
    b = spark.createDataFrame([("a", "MKT", 9.0), ("a", "OIL", 2.0), ("a", "RATE", 1.0), ("b", "OIL", None), ("b", "GOLD", NAN), ("b", "RATE", 1.0), ("c", "TIN", 1.0), (None, "OIL", 1.0)], "ticker string, factor string, beta double")
    m = spark.createDataFrame([("MKT", 1.0), ("OIL", 0.5), ("RATE", -3.0), ("GOLD", 1.0), ("L", 2.0), ("S", None)], "factor string, move double")
    real = spark.createDataFrame([("a", "L", 0.25), ("a", "S", 1.0), ("q", "L", 1.0)], "ticker string, factor string, beta double")
    assert {(r.ticker, r.tilt, r.rates) for r in tilts.macro_tilt(b, m, real, 2.0).collect()} == {("a", 2.0, "real curve"), ("b", -3.0, "nominal"), ("c", 0.0, "nominal")}
    assert {(r.ticker, r.tilt) for r in tilts.macro_tilt(b, m).collect()} == {("a", -2.0), ("b", -3.0), ("c", 0.0)}


def test_multiples(spark):
    rows = [("a", q, 10.0 + q, 5.0, 1.0 if q < 5 else 2.0, 10.0, 2.0, 1.0, 0.0 if q == 1 else 4.0, 50.0, None if q == 1 else 1.0) for q in range(1, 10)] + [("gap", q, 10.0, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0) for q in (1, 2, 3, 5, 6)]
    df = spark.createDataFrame(rows, "k string, q int, price double, shares double, eps double, revenue double, ebitda double, fcf double, income double, ev double, estimate double")
    got = {(r.k, r.q): r for r in tilts.multiples(df, "k", "q").collect()}
    a = got["a", 8]
    assert (a.pe, a.ev_ebitda, a.ev_sales, a.fcf_yield, a.yoy, a.dilution, a.cash_conversion, a.surprise) == pytest.approx((18 / 8, 50 / 8, 50 / 40, 4 / 90, 1.0, 0.0, 0.25, 1.0))
    assert (a.earned, a.rerated, a.moved) == pytest.approx((1.0, (18 / 8) / (14 / 4) - 1, 18 / 14 - 1))
    assert (got["a", 3].pe, got["a", 1].cash_conversion, got["a", 1].surprise) == (None, None, None)
    assert (got["gap", 6].pe, got["gap", 6].yoy, got["gap", 5].yoy, got["gap", 2].surprise) == (None, 0.0, 0.0, None)  # a quarter is missing; its row isn't taken for another

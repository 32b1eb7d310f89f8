"""Estimators and the stream's gate against plain loops, and operators on planted data."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom import registry
from quantloom.functions import stats
from quantloom.operators import cross_section, kernels, relational, time_series


@pytest.fixture(scope="module")
def planted(spark):
    random = np.random.default_rng(9)
    rows = []
    for i in range(240):
        rows.append(("calm", i, float(random.normal(0, 0.01))))
        rows.append(("turns", i, float(random.normal(0, 0.01 if i < 150 else 0.06))))
    rows.append(("short", 0, 0.5))
    frame = pd.DataFrame(rows, columns=["ticker", "i", "lr"])
    frame["wk"] = (pd.Timestamp("2001-01-01") + pd.to_timedelta(7 * frame["i"], unit="D")).dt.date
    return spark.createDataFrame(frame[["ticker", "wk", "lr"]])


def one(df):
    return {r.ticker: r for r in df.collect()}


def test_regimes_find_the_wild_state(planted):
    found = one(kernels.regimes(planted))
    assert found["turns"].stress and found["turns"].var_wild == pytest.approx(0.0036, rel=0.4)
    assert found["short"].var_calm is None


def test_change_points(planted):
    found = kernels.change_points(planted).collect()
    assert any(r.ticker == "turns" and abs(r.place - 150) <= 12 for r in found)
    assert not any(r.ticker == "short" for r in found)


def test_garch_and_filter(planted):
    g, k, b = one(kernels.garch(planted)), one(kernels.local_level(planted)), one(kernels.block_bootstrap(planted))
    assert g["turns"].next_var > 5 * g["calm"].next_var
    assert abs(k["calm"].level) < 0.02 and k["short"].innovation_sd is None
    assert b["calm"].low <= b["calm"].mean <= b["calm"].high


def test_gate_against_a_loop(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    want = {}
    for user, g in events.groupby("user_id"):
        opened, is_open, run = 0, False, 0
        for v in g["value"]:
            run = run + 1 if (v > 50) != is_open else 0
            if run == 3:
                opened, is_open, run = opened + (not is_open), not is_open, 0
        want[user] = (opened, is_open)
    assert {r.user_id: (r.opened, r.is_open) for r in registry.queries()["stream_persistence_gate"](spark, sf).collect()} == want


def test_normal_distribution(spark):
    xs = [-5.0, -1.0, -0.1, 0.0, 0.5, 2.0, 6.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.phi(F.col("x")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=1e-6)


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0)], "g string, x double")
    assert sorted(r.k for r in df.select(stats.average_rank("x", "g").alias("k")).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_drawdowns_by_hand(spark):
    closes = [10.0, 12.0, 9.0, 9.5, 12.0, 11.0]
    bars = spark.createDataFrame([("a", (pd.Timestamp("2001-01-01") + pd.Timedelta(days=7 * i)).to_pydatetime(), c) for i, c in enumerate(closes)], "ticker string, wk timestamp, c double")
    (r,) = time_series.drawdowns(bars).collect()
    assert (r.max_drawdown, r.longest) == (pytest.approx(-0.25), 2)


def test_nearest_and_as_of(spark):
    left = spark.createDataFrame([("k", "2001-01-10", 1), ("k", "2001-03-01", 2)], "key string, at string, id int").withColumn("at", F.to_date("at"))
    right = spark.createDataFrame([("k", "2001-01-05", 7), ("k", "2001-01-15", 8), ("k", "2001-01-26", 9)], "key string, other string, tie int").withColumn("other", F.to_date("other"))
    assert [(r.id, r.tie, r.days) for r in relational.nearest_within(left, right, "key", "at", "other", "tie", 15).collect()] == [(1, 7, 5)]
    assert {r.id: r.tie for r in relational.as_of(left, right, "key", "at", "other", "tie").collect()} == {1: 7, 2: 9}


def test_flat_series_have_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "g string, x double, y double")
    assert df.groupBy("g").agg(cross_section.correlation("x", "y").alias("c")).first().c == 0.0


def test_empty_panels(spark, sf):
    """No bars: no rows, and no failure."""
    from quantloom.sources.panels import weekly_bars, weekly_returns

    bars = weekly_bars(spark, sf).limit(0)
    ret = weekly_returns(bars)
    for df in (time_series.ema(bars), time_series.drawdowns(bars), time_series.moments(ret), cross_section.top_correlations(ret), kernels.garch(ret)):
        assert df.count() == 0


def test_equal_left_rows_stay_as_many(spark):
    from quantloom.operators.relational import nearest_within

    left = spark.sql("SELECT * FROM VALUES (1, DATE'2020-01-01'), (1, DATE'2020-01-01'), (2, DATE'2020-01-01') AS t(k, at)")
    right = spark.sql("SELECT * FROM VALUES (1, DATE'2020-01-03', 7), (1, DATE'2020-01-03', 7), (1, DATE'2020-01-09', 8) AS t(k, near_at, near)")
    got = nearest_within(left, right, "k", "at", "near_at", "near", 5).select("k", "near", "days").collect()
    assert sorted(map(tuple, got)) == [(1, 7, 2), (1, 7, 2)]


def test_singular_fit_has_no_coefficients(spark):
    from quantloom.operators.regression import fit

    rows = spark.range(20).selectExpr("'a' AS g", "CAST(id AS DOUBLE) AS x", "2.0 * id AS z", "1.0 + id AS y")
    assert fit(rows, ["g"], "y", ["x", "z"]).head().b_x is None
    one = fit(rows, ["g"], "y", ["x"]).head()
    assert abs(one.b_x - 1) < 1e-9 and abs(one.const - 1) < 1e-9 and fit(rows.limit(0), ["g"], "y", ["x"]).count() == 0


def test_tails_against_known_values(spark):
    from pyspark.sql import functions as F

    from quantloom.operators.significance import binomial_at_least, t_two_sided

    t = spark.createDataFrame([(2.228139, 10), (12.7062, 1), (4.302653, 2), (2.570582, 5), (0.0, 7)], "t double, df int")
    assert [round(r.p, 4) for r in t.select(t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()] == [0.05, 0.05, 0.05, 0.05, 1.0]
    b = spark.createDataFrame([(0, 10), (6, 10), (10, 10), (5000, 10000)], "k int, n int")
    assert [round(r.p, 5) for r in b.select(binomial_at_least(F.col("k"), F.col("n")).alias("p")).collect()] == [1.0, 0.37695, 0.00098, 0.50399]


def test_unit_root(spark):
    """A walk keeps its unit root, a series drawn to its mean loses it; the statistic agrees with partial regressions."""
    random = np.random.default_rng(4)
    walk, drawn = np.cumsum(random.normal(0, 0.02, 300)), [0.0]
    for e in random.normal(0, 0.02, 299):
        drawn.append(0.4 * drawn[-1] + e)
    series = {"walk": walk, "drawn": np.array(drawn), "flat": np.zeros(60), "short": np.zeros(5)}
    frame = pd.concat(pd.DataFrame({"ticker": t, "wk": pd.date_range("2001-01-01", periods=len(x), freq="7D").date, "c": np.exp(x)}) for t, x in series.items())
    found = one(kernels.unit_root(spark.createDataFrame(frame)))
    assert not found["walk"].rejects and found["drawn"].rejects
    assert found["flat"].stat is None and found["short"].stat is None and found["short"].n == 5
    for name in ("walk", "drawn"):
        x, lags = series[name], found[name].lags
        d, first = np.diff(x), int(12 * 3**0.25) + 1
        others = np.array([[1.0, *(d[t - k] for k in range(1, lags + 1))] for t in range(first, len(d))])
        rest = lambda v: v - others @ np.linalg.lstsq(others, v, rcond=None)[0]  # noqa: B023, E731
        u, v = rest(x[first:-1]), rest(d[first:])
        b = (u @ v) / (u @ u)
        error = math.sqrt(((v - b * u) ** 2).sum() / (len(v) - lags - 2) / (u @ u))
        assert found[name].stat == pytest.approx(b / error, rel=1e-6)


def test_unit_root_of_no_rows(spark):
    assert kernels.unit_root(spark.createDataFrame([], "ticker string, wk date, c double")).count() == 0

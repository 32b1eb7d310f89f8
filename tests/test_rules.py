"""Rules of single operators on planted rows."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quantloom.operators import calibration, inference, records, relational, significance, time_series

DAY = dt.date(2021, 1, 4)


def test_sentiment(spark):
    rows = [
        (1, "Profits surged and the upgrade beats estimates"),
        (2, "not strong, never any growth here at all"),
        (3, "no fraud; hardly ever a loss. a word a word loss"),
        (4, None),
        (5, ""),
        (6, "beat-and-raise self-off sell-off"),
        (7, "without one two three gain without one two gain"),
    ]
    got = {r.id: (r.n, r.good, r.bad) for r in calibration.sentiment(spark.createDataFrame(rows, "id int, body string"), "id", "body").collect()}
    assert got == {1: (7, 3, 0), 2: (8, 0, 2), 3: (8, 2, 1), 4: (0, 0, 0), 5: (0, 0, 0), 6: (3, 1, 1), 7: (9, 1, 1)}
    lexicon = calibration.lexicon_of(spark.createDataFrame([("Word", 1), ("fraud", -1), ("hardly", 0), (None, 1)], "word string, side int"))
    assert lexicon == (["word"], ["fraud"], ["hardly"])
    got = {r.id: (r.good, r.bad) for r in calibration.sentiment(spark.createDataFrame(rows[2:3], "id int, body string"), "id", "body", lexicon).collect()}
    assert got == {3: (1, 2)}


def health(spark, closes, step=1):
    rows = [("a", DAY + dt.timedelta(days=i * step), c) for i, c in enumerate(closes)]
    return time_series.series_health(spark.createDataFrame(rows, "ticker string, wk date, c double")).first()


def test_series_health(spark):
    wave = [100 + 3 * math.sin(i) for i in range(60)]
    assert health(spark, wave).verdict == "clean"
    assert health(spark, wave[:39]).verdict == "reject"
    stuck = health(spark, [*wave[:30], *[50.0] * 4, *wave[30:]])
    assert (stuck.stale_run, stuck.verdict) == (4, "degraded")
    assert health(spark, [*wave, None]).verdict == "degraded" and health(spark, [*wave, None, float("nan"), float("inf")]).missing == 3
    assert health(spark, [*wave, None, None, None]).verdict == "reject"
    assert (health(spark, [*wave, 0.0]).verdict, health(spark, [*wave, -1.0]).not_positive) == ("reject", 1)
    assert (health(spark, wave, 8).max_gap, health(spark, wave, 8).verdict) == (8, "degraded")
    empty = health(spark, [None] * 3)
    assert (empty.n, empty.missing, empty.stale_run, empty.verdict) == (3, 3, 0, "reject")


def test_implied_volatility_bounds(spark):
    terms = "s double, k double, t double, kind string, price double"
    quotes = [(100.0, 90.0, 1.0, "C", p) for p in (100.1, 13.0, 0.0, -1.0)] + [(100.0, 120.0, 1.0, "P", p) for p in (116.0, 15.0)] + [(100.0, 90.0, 0.0, "C", 20.0), (100.0, 90.0, 1.0, "C", None)]
    assert [r.iv for r in significance.implied_volatility(spark.createDataFrame(quotes, terms)).collect()] == [None] * len(quotes)
    fine = spark.createDataFrame([(100.0, 90.0, 1.0, "C"), (100.0, 120.0, 0.5, "P")], "s double, k double, t double, kind string")
    priced = fine.withColumn("price", calibration.black_scholes_price(F.col("s"), F.col("k"), F.col("t"), F.lit(0.3), F.col("kind") == "C", 0.04))
    assert [r.iv for r in significance.implied_volatility(priced).collect()] == pytest.approx([0.3, 0.3], abs=1e-5)


def test_implied_volatility_of_many_quotes(spark):
    """Every volatility comes back from its price, in arrays and not by expressions that price a quote anew for each name."""
    q = spark.range(5000).select("id", F.lit(100.0).alias("s"), (80.0 + F.col("id") % 41).alias("k"), (0.25 + F.col("id") % 7 / 4.0).alias("t"), (0.2 + F.col("id") % 11 / 20.0).alias("sigma"), F.when(F.col("id") % 3 == 0, "C").when(F.col("id") % 3 == 1, "P").alias("kind"))
    call = F.coalesce(F.col("kind") == "C", F.lit(False))  # no kind: a put
    odd = F.when(F.col("id") % 500 == 7, float("nan")).when(F.col("id") % 500 == 8, F.lit(None)).when(F.col("id") % 500 == 9, 1e9)
    priced = q.withColumn("odd", F.col("id") % 500 >= 7).withColumn("odd", F.col("odd") & (F.col("id") % 500 <= 9))
    priced = priced.withColumn("price", F.when(F.col("odd"), odd).otherwise(calibration.black_scholes_price(F.col("s"), F.col("k"), F.col("t"), F.col("sigma"), call, 0.04)))
    found = significance.implied_volatility(priced)
    assert "aggregate(" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == 5000 and [r.id for r in got if r.iv is None] == [r.id for r in got if r.odd]
    assert max(abs(r.iv - r.sigma) for r in got if not r.odd) < 1e-5


def test_turnover_path(spark):
    rows = [(1, "a", 0.5), (1, "b", 0.5), (2, "a", 1.0), (3, "a", 0.25), (3, "c", 0.75), (None, "a", 9.0)]
    got = {r.q: (r.turnover, r.n) for r in relational.turnover_path(spark.createDataFrame(rows, "q int, k string, w double"), "q", "k", "w").collect()}
    assert got == {2: (1.0, 2), 3: (1.5, 2)}


def test_field_coverage(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (2, "x")], "a int, field string")
    assert {r.field: (r.present, r.different) for r in records.field_coverage(df).collect()} == {"a": (3, 2), "field": (2, 1)}


def test_minutes_momentum_of_dense_events(spark):
    """Events close together, on one another and at the window's very edge, also of no type, against a loop; no sum is made anew for each row."""
    minute = 60_000_000
    start, steps = dt.datetime(2024, 1, 1), [0, 0, 1, 5 * minute, 5 * minute, 10 * minute, 10 * minute + 1, 15 * minute, 20 * minute, 20 * minute + 1, 47 * minute, 57 * minute, 57 * minute + 1]
    rows = [(100 * k + i, kind, start + dt.timedelta(microseconds=us), None if (i + k) % 6 == 5 else float(i * i + k)) for k, kind in enumerate(("a", "b", None)) for i, us in enumerate(steps)]
    events = spark.createDataFrame(rows, "event_id int, event_type string, ts timestamp_ntz, value double")
    found = inference.minutes_momentum(events, 10)
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    want = {}
    for key, kind, ts, _ in rows:
        mine = [(ts - t, v) for _, other, t, v in rows if other == kind and v is not None and t <= ts]
        near, far = (mean([v for age, v in mine if (age <= dt.timedelta(minutes=10)) == now]) for now in (True, False))
        want[key] = (near, far, near / far if near is not None and far else None)
    assert {r.event_id: (r.near, r.far, r.momentum) for r in found.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding$" in plan and str(10 * minute) + "," not in plan.replace(" ", "")

"""Availability, joins on two times, vintages and stores on planted rows."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quantloom.operators import point_in_time as pit
from quantloom.sources import files, stores


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def test_availability(spark):
    rows = [
        ("2026-06-26", "2026-06-26 23:05:00", "2026-06-29"),  # Friday behind the cut-off
        ("2026-06-26", "2026-06-26 21:59:59", "2026-06-26"),
        ("2026-06-25", "2026-06-25 22:00:00", "2026-06-26"),
        ("2026-06-27", None, "2026-06-29"),  # Saturday
        ("2026-06-28", "2026-06-26 10:00:00", "2026-06-29"),  # Sunday
        ("2026-06-24", "2026-06-27 09:00:00", "2026-06-25"),  # accepted on a weekend
        ("2026-06-24", None, "2026-06-24"),
        (None, "2026-06-24 10:00:00", None),
    ]
    df = spark.createDataFrame(rows, "filed string, accepted string, want string")
    got = df.select(pit.available_at(F.to_date("filed"), F.to_timestamp("accepted")).cast("string").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_deadlines(spark):
    rows = [("2025-12-31", "10-K", "large", "2026-03-01"), ("2025-12-31", "10-K", "non", "2026-03-31"), ("2025-09-30", "10-Q", "large", "2025-11-09"), ("2025-12-31", "8-K", None, "2026-03-31")]
    df = spark.createDataFrame(rows, "p string, form string, filer string, want string")
    assert all(r.got == r.want for r in df.select(pit.filing_deadline(F.to_date("p"), F.col("form"), F.col("filer")).cast("string").alias("got"), "want").collect())


@pytest.mark.parametrize("by", [["k"], ["k", "period"]])
def test_known_at_against_a_loop(spark, by):
    pick = random.Random(len(by))
    when = lambda: None if pick.random() < 0.05 else day("2020-01-01") + dt.timedelta(days=pick.randrange(400))
    vintages = [(pick.choice([1, 1, 1, 2, None]), pick.randrange(4), when(), i, None if i % 17 == 0 else float(i)) for i in range(300)]
    asks = [(pick.choice([1, 2, 3, None]), pick.randrange(4), when(), i) for i in range(200)]
    asks += asks[:20]
    v = spark.createDataFrame(vintages, "k int, period int, available date, tie int, value double")
    a = spark.createDataFrame(asks, "k int, period int, at date, id int")
    state = [c for c in ("period", "available", "tie", "value") if c not in by]
    got = sorted(((r["id"], r["tie"], r["value"]) for r in pit.known_at(v, a, by, "available", "at", state).collect()), key=str)
    want = []
    for k, period, at, number in asks:
        fits = [x for x in vintages if x[0] == k and k is not None and x[2] is not None and at is not None and x[2] <= at and (len(by) == 1 or x[1] == period)]
        best = max(fits, key=lambda x: (x[1], x[2], x[3]), default=(None,) * 5)
        want.append((number, best[3], best[4]))
    assert got == sorted(want, key=str)


def test_a_late_vintage_never_leaks(spark):
    v = spark.createDataFrame([(1, 1, day("2020-01-10"), 1.0), (1, 2, day("2020-04-10"), 2.0), (1, 1, day("2020-05-01"), 1.5)], "k int, period int, available date, value double")
    a = spark.createDataFrame([(1, day(d)) for d in ("2020-01-09", "2020-01-10", "2020-04-09", "2020-04-10", "2020-06-01")], "k int, at date")
    got = {str(r["at"]): r.value for r in pit.known_at(v, a, ["k"], "available", "at", ["period", "available", "value"]).collect()}
    assert got == {"2020-01-09": None, "2020-01-10": 1.0, "2020-04-09": 1.0, "2020-04-10": 2.0, "2020-06-01": 2.0}
    assert pit.known_at(v, a.limit(0), ["k"], "available", "at", ["period", "value"]).count() == 0
    assert all(r.value is None for r in pit.known_at(v.limit(0), a, ["k"], "available", "at", ["period", "value"]).collect())


def test_revision(spark):
    rows = [("A", "q3", "2026-02-01", 7.0), ("A", "q3", "2026-02-15", 7.1), ("A", "q3", "2026-03-01", 7.35), ("A", "q7", "2026-03-02", 9.99), ("A", "q3", "2026-01-01", 1.0), ("A", "q3", "2026-04-01", None), ("Z", "q3", "2026-02-02", 0.0), ("Z", "q3", "2026-02-03", 1.0)]
    s = spark.createDataFrame([(a, b, day(c), v, i) for i, (a, b, c, v) in enumerate(rows)], "sym string, period string, as_of date, eps double, tie int")
    (r,) = pit.revision(s, ["sym", "period"], "as_of", "eps", F.lit("2026-02-01").cast("date"), "tie").collect()
    assert (r.sym, r.period, r.value0, r.value1, str(r.at0), str(r.at1), r.n, r.drift_pct) == ("A", "q3", 7.0, 7.35, "2026-02-01", "2026-03-01", 3, 5.0)


def test_replay(spark):
    u = spark.createDataFrame([("good", day("2026-06-28"), day("2026-06-01")), ("good", day("2026-06-28"), None), ("bad", day("2026-06-28"), day("2026-07-15"))], "run string, decided date, available date")
    assert {r.run: (r.used, r.leaks, r.undated, r.replay_ok) for r in pit.replay(u, "decided", "available", ["run"]).collect()} == {"good": (2, 0, 1, True), "bad": (1, 1, 0, False)}


def test_store(spark):
    path = files.shared(spark, f"test-{uuid.uuid4().hex}")
    make = lambda rows: spark.createDataFrame(rows, "k int, v double, p string")
    content = lambda: sorted((r.k, r.v, r.p) for r in stores.read(spark, path).collect())
    assert stores.read(spark, path) is None
    first = make([(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "b"), (4, None, "b"), (None, 5.0, "b"), (2, 9.0, "a")])
    assert stores.record(first, path, ["k"], "p", ["v"]) == 3
    assert content() == [(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "b")]
    assert stores.record(first, path, ["k"], "p", ["v"]) == 0  # again: nothing changes
    before = {f: spark.read.format("binaryFile").load(f"{path}/p={f}").select("path").collect() for f in "ab"}
    assert stores.record(make([(3, 7.0, "b"), (6, 6.0, "b"), (7, 7.0, "c")]), path, ["k"], "p") == 2
    assert content() == [(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "b"), (6, 6.0, "b"), (7, 7.0, "c")]
    assert spark.read.format("binaryFile").load(f"{path}/p=a").select("path").collect() == before["a"]  # left alone
    assert stores.record(make([]), path, ["k"], "p") == 0


def test_mature(spark):
    start, names = day("2020-01-06"), [f"n{i}" for i in range(6)]
    snaps = [(start, n, 10.0, float(i), None if n == "n5" else 1.0) for i, n in enumerate(names)] + [(start + dt.timedelta(days=70), n, 10.0, float(i), 1.0) for i, n in enumerate(names)]
    prices = [(start + dt.timedelta(days=d), n, 10.0 + i * (1 if d < 30 else -1)) for d in (0, 27, 29, 35, 70) for i, n in enumerate(names)]
    s = spark.createDataFrame(snaps, "as_of date, name string, px double, a double, b double")
    p = spark.createDataFrame(prices, "as_of date, name string, px double")
    got = {(str(r.origin), r.factor): (str(r.as_of), r.n, r.ic) for r in pit.mature(s, p, ["a", "b"], 28).collect()}
    assert got == {("2020-01-06", "a"): ("2020-02-04", 5, 1.0), ("2020-01-06", "b"): ("2020-02-04", 5, 0.0)}  # the first build behind it; the second snapshot isn't due
    assert pit.mature(s, p, ["a"], 28, least=7).count() == 0

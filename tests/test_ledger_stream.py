"""The streaming ledger over several batches: maturity, late and repeated rows, the alarm against its loop."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from quantloom.sources import files
from quantloom.streaming.intraday import ROCKS, drain
from quantloom.streaming.ledger import ledger_stream
from tests.test_monitoring import plain_alarm

DAY = dt.datetime(2020, 1, 1)
SCHEMA = "ts timestamp, key string, origin timestamp, matures timestamp, mu double, sigma double, lower double, upper double, y double"


def day(n):
    return DAY + dt.timedelta(days=n)


def forecast(key, origin, matures, mu=0.0, sigma=1.0, lower=-1.0, upper=1.0, at=None):
    return (day(origin if at is None else at), key, day(origin), day(matures), mu, sigma, lower, upper, None)


def outcome(key, origin, matures, y, at):
    return (day(at), key, day(origin), day(matures), None, None, None, None, y)


def run(spark, batches, late="0 days"):
    """Each batch is a file that the stream takes by itself, in order."""
    path = files.shared(spark, "told")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = drain(ledger_stream(s, late), ["key", "origin", "matures"], "append", ROCKS)
    return {(r.key, (r.origin - DAY).days, (r.matures - DAY).days): r for r in out.collect()}


def test_maturity(spark):
    got = run(spark, [
        [forecast("a", 0, 5), forecast("a", 0, 9, mu=1.0), forecast("a", 1, 5, sigma=0.0), forecast("b", 0, 50), outcome("a", 0, 5, 0.5, 2), outcome("b", 0, 50, 0.1, 3), forecast(None, 0, 5), forecast("c", 0, 5), outcome("c", 0, 5, 0.25, 3), outcome("x", 0, 5, 0.25, 3)],
        [forecast("c", 0, 5, mu=0.25, at=4), outcome("a", 0, 9, 4.0, 4), outcome("a", 0, 9, 3.0, 4), forecast("d", 2, 6, mu=float("nan")), (day(4), "d", day(3), None, 0.0, 1.0, -1.0, 1.0, None), (day(4), "d", day(3), day(6), 0.0, None, -1.0, 1.0, None)],
        [forecast("z", 20, 99)],  # the watermark passes days 5 and 9,
        [forecast("z", 21, 99)],  # and their timers fire
        [outcome("a", 1, 5, -2.0, 22)],  # known long after it was due
    ])
    assert set(got) == {("a", 0, 5), ("a", 0, 9), ("a", 1, 5), ("c", 0, 5)}  # b isn't due, x was never forecast
    a = got["a", 0, 5]
    assert (a.y, a.side, a.covered, a.interval_score, a.place, a.level) == (0.5, "inside", True, 2.0, 1, None)
    b = got["a", 0, 9]
    assert (b.y, b.side, b.residual, b.interval_score, b.place) == (3.0, "upper_miss", 2.0, 2.0 + 20 * 2.0, 2)  # the least outcome
    late = got["a", 1, 5]
    assert (late.side, late.place) == ("lower_miss", 3) and late.z == pytest.approx(-2e12)
    assert got["c", 0, 5].residual == 0.0  # told again before it matured


def test_nothing_leaks_before_its_maturity(spark):
    rows = [[forecast("a", 0, 10), outcome("a", 0, 10, 0.5, 9)]]
    assert run(spark, rows) == {}
    assert set(run(spark, [*rows, [forecast("z", 10, 99)]])) == {("a", 0, 10)}  # at the maturity itself
    assert run(spark, [*rows, [forecast("z", 11, 99)]], "2 days") == {}


def test_alarm_follows_the_ledger(spark):
    from statistics import NormalDist

    ys = [math.sin(i * 1.7) * (0.4 if i < 30 else 2.5) for i in range(60)]
    first = [forecast("k", i, i + 3) for i in range(60)]
    told = [outcome("k", i, i + 3, y, i + 4) for i, y in enumerate(ys)]
    batches = [[r for r in first + told if lo <= (r[0] - DAY).days < lo + 20] for lo in (0, 20, 40, 60)]
    got = run(spark, [*batches, [forecast("z", 90, 99)]])
    assert len(got) == 60
    u = [NormalDist().cdf(y) for y in ys]
    for i in range(60):
        r = got["k", i, i + 3]
        now, most = plain_alarm(u[: i + 1])
        assert r.place == i + 1 and (r.evidence, r.evidence_max) == pytest.approx((math.log10(now), math.log10(most)), abs=1e-4)
        assert r.level == (None if i < 19 else "kill" if most >= 100 else "warn" if most >= 20 else "ok")
    assert {got["k", i, i + 3].level for i in range(60)} >= {None, "kill"}


def test_no_rows(spark):
    path = files.shared(spark, "told")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    out = drain(ledger_stream(spark.readStream.schema(SCHEMA).parquet(path), "0 days"), ["key", "origin", "matures"], "append", ROCKS)
    assert out.count() == 0

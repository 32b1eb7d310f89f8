"""Ledgers, alarms, covariances and nested filings against plain loops and planted documents."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import monitoring as mon
from quantloom.plans import monitoring as monitoring_plans
from quantloom.sources import files, filings

DAY = dt.date(2020, 1, 1)


def test_ledger(spark):
    f = spark.createDataFrame([("a", 1, DAY, 0.0, 1.0, -1.0, 1.0), ("a", 2, DAY, 0.0, 1.0, -1.0, 1.0), ("a", 3, DAY + dt.timedelta(days=9), 0.0, 1.0, -1.0, 1.0), ("b", 1, DAY, 1.0, 0.0, -1.0, 1.0), (None, 1, DAY, 0.0, 1.0, -1.0, 1.0)], "k string, h int, matures date, mu double, sigma double, lower double, upper double")
    y = spark.createDataFrame([("a", 1, 0.5), ("a", 3, 0.5), ("b", 1, 3.0), ("b", 1, 4.0), (None, 1, 2.0), ("a", 2, None)], "k string, h int, y double")
    got = {(r.k, r.h): r for r in mon.ledger(f, y, ["k", "h"], F.lit(DAY)).collect()}
    a = got["a", 1]
    assert (a.status, a.side, a.covered, a.residual, a.interval_score) == ("matured", "inside", True, 0.5, 2.0)
    assert all((got[k].status, got[k].y, got[k].side, got[k].interval_score) == ("open", None, None, None) for k in (("a", 2), ("a", 3), (None, 1)))  # unknown, not due, no key
    b = got["b", 1]
    assert (b.side, b.covered, b.interval_score) == ("upper_miss", False, 2.0 + 20 * 2.0) and b.z == pytest.approx(2e12)


def plain_alarm(u):
    most, last = {}, {}
    for name, (m, low, high) in mon.BETS.items():
        dev, wealth, s, q, top = max(m - low, high - m), [1.0, 1.0], 0.0, 0.0, 1.0
        for n, x in enumerate(u if name == "location" else [abs(v - 0.5) for v in u]):
            mu = (m + s) / (1 + n)
            var = max((dev * dev / 3 + q - 2 * mu * s + n * mu * mu) / (1 + n), 1e-12)
            stake = min(abs((mu - m) / var), 0.5 / dev) * (x - m)
            wealth = [min(wealth[0] * (1 + stake), 1e12), min(wealth[1] * (1 - stake), 1e12)]
            top, s, q = max(top, sum(wealth) / 2), s + x, q + x * x
        most[name], last[name] = top, sum(wealth) / 2
    return (last["location"] + last["dispersion"]) / 2, (most["location"] + most["dispersion"]) / 2


def test_alarm_against_a_loop(spark):
    pick = np.random.default_rng(3)
    series = {"fair": pick.random(200), "low": pick.random(150) * 0.5, "wide": np.abs(np.round(pick.random(150)) - 0.1 * pick.random(150)), "turns": np.concatenate([np.full(200, 0.99), pick.random(300) * 0.2]), "short": pick.random(19)}
    rows = [(k, i, float(v)) for k, u in series.items() for i, v in enumerate(u)] + [("fair", 500, None), ("fair", 501, 1.5), (None, 1, 0.5)]
    got = {r.k: r for r in mon.calibration_alarm(spark.createDataFrame(rows, "k string, at int, pit double"), "k", "at", "pit", "pit").collect()}
    assert set(got) == {"fair", "low", "wide", "turns"} and got["fair"].n == 200
    for k, r in got.items():
        assert (r.e_value, r.e_max) == pytest.approx(plain_alarm(series[k]), rel=1e-6)
    assert got["turns"].e_max >= mon.CAP / 4  # the cap is met, and what follows starts from it
    assert (got["fair"].level, got["low"].level, got["wide"].level) == ("ok", "kill", "kill")


def panel(spark):
    pick = np.random.default_rng(5)
    x = pick.normal(0, 1, (40, 4)) @ np.array([[1, 0.8, 0, 0.1], [0, 0.5, 0, 0], [0, 0, 1, -0.6], [0, 0, 0, 0.4]])
    rows = [(f"n{j}", DAY + dt.timedelta(days=t), float(x[t, j])) for t in range(40) for j in range(4)]
    return x, spark.createDataFrame([*rows, ("n1", DAY + dt.timedelta(days=90), 5.0), (None, DAY, 1.0), ("n2", DAY, None)], "name string, day date, r double")


def test_shrunk_covariance(spark):
    x, df = panel(spark)
    c = x - x.mean(axis=0)
    s = c.T @ c / 40
    m = np.trace(s) / 4
    d2 = ((s - m * np.eye(4)) ** 2).sum() / 4
    b2 = min(sum(((np.outer(v, v) - s) ** 2).sum() for v in c) / 1600 / 4, d2)
    want = b2 / d2 * m * np.eye(4) + (1 - b2 / d2) * s
    got = mon.shrunk_covariance(df, "name", "day", "r").collect()
    assert len(got) == 10
    for r in got:
        i, j = int(r.a[1]), int(r.b[1])
        assert (r.delta, r.sample, r.shrunk) == pytest.approx((b2 / d2, s[i, j], want[i, j]))
    one = mon.shrunk_covariance(df.where("name = 'n0'"), "name", "day", "r").collect()
    assert len(one) == 1 and one[0].delta == 0 and mon.shrunk_covariance(df.limit(0), "name", "day", "r").collect() == []


def test_cluster_order(spark, monkeypatch):
    x, df = panel(spark)
    r, v = np.corrcoef(x.T), np.full(4, 0.5)
    for _ in range(60):
        v = r @ v
        v /= np.sqrt(v @ v)
    got = mon.cluster_order(df, "name", "day", "r").orderBy("place").collect()
    assert [g.a for g in got] == [f"n{i}" for i in np.argsort(v)] and [g.loading for g in got] == pytest.approx(sorted(v))
    assert mon.cluster_order(df.limit(0), "name", "day", "r").collect() == []
    monkeypatch.setattr(mon, "MOST_ASSETS", 3)
    with pytest.raises(Exception, match="over 3 assets"):
        mon.cluster_order(df, "name", "day", "r").collect()


def form(transactions: str, owner: str = "<isDirector>1</isDirector>", notes: str = "") -> str:
    return f"<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName> Ann </rptOwnerName></reportingOwnerId><reportingOwnerRelationship>{owner}</reportingOwnerRelationship></reportingOwner><nonDerivativeTable>{transactions}</nonDerivativeTable><footnotes>{notes}</footnotes></ownershipDocument>"


def transaction(shares: str, price: str, note: str = "") -> str:
    return f'<nonDerivativeTransaction><transactionDate><value>2026-01-02</value></transactionDate><transactionCoding><transactionCode>S</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{shares}</value>{note}</transactionShares><transactionPricePerShare><value>{price}</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>D</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>'


def test_insider_transactions(spark):
    notes = '<footnote id="F1">Sold under a Rule 10b5–1 plan.</footnote><footnote id="F2">Other.</footnote>'
    docs = [
        (1, form(transaction("1,000", "2.5", '<footnoteId id="F1"/>') + transaction("x", "3", '<footnoteId id="F2"/>'), notes=notes)),
        (2, form(transaction("10", "0"), owner="<isOfficer>true</isOfficer><officerTitle></officerTitle><isDirector>1</isDirector>")),
        (3, form("")), (4, "<ownershipDocument><nonDerivativeTable>"), (5, None), (6, ""),
    ]
    got = sorted((tuple(r) for r in filings.insider_transactions(spark.createDataFrame(docs, "id int, xml string"), "id", "xml").collect()), key=lambda t: (t[0], t[6] is not None))
    assert got[0][:8] == (1, "Ann", "Director", "2026-01-02", "S", "D", None, 3.0) and got[0][8:] == (None, False)
    assert got[1] == (1, "Ann", "Director", "2026-01-02", "S", "D", 1000.0, 2.5, 2500.0, True)
    assert got[2] == (2, "Ann", "Officer", "2026-01-02", "S", "D", 10.0, 0.0, None, False) and len(got) == 3


def test_ownership_documents_are_dealt_by_key(spark, sf):
    """Documents were broadcast, and parsed in as many tasks as the file of orders has parts."""
    plan = monitoring_plans._ownership(spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert "nonDerivativeTransaction" not in plan[plan.index("ObjectHashAggregate") :]  # text is written behind the shuffle


def test_annual_series(spark):
    point = lambda fy, val, form="10-K", fp="FY", filed="2020-01-01", end="2019-12-31": {"fy": fy, "val": val, "form": form, "fp": fp, "filed": filed, "end": end}
    doc = lambda name, *p, unit="USD": json.dumps({"facts": {"us-gaap": {name: {"units": {unit: list(p)}}}}})
    rows = [
        (1, doc("Debt", point(2019, 1), point(2019, 2, filed="2021-01-01"), point(2019, 3, filed="2020-06-01"), point(2018, 4, form="10-Q", fp="Q3"), point(2017, 5, form="20-F", fp=None), point(None, 6), point(2016, None))),
        (2, doc("Loans", point(2019, 7, form=None), point(2019, 8, form=None))), (3, doc("Debt", point(2019, 9), unit="EUR")), (4, "not json"), (5, None), (6, json.dumps({"facts": {}})),
    ]
    got = sorted((r.id, r.concept, r.fy, r.value) for r in filings.annual_series(spark.createDataFrame(rows, "id int, j string"), "id", "j", ["Debt", "Loans"]).collect())
    assert got == [(1, "Debt", 2017, 5.0), (1, "Debt", 2019, 2.0), (2, "Loans", 2019, 8.0)]


def test_holdings_table(spark):
    path = files.shared(spark, "holdings")
    lines = ["ACCESSION_NUMBER\tcusip \tNAMEOFISSUER\tVALUE\tSSHPRNAMT\tSSHPRNAMTTYPE\tPUTCALL", "a1\tabc\tAcme\t10\t5\tSH\t", "a1\tABC\tAcme\t20\t5\tsh\t", "a2\tABC\tAcme\tbad\t7\tPRN\t", "a3\tABC\tAcme\t99\t9\tSH\tPut", "\t\tNone\t1\t1\tSH\t", "\tXYZ\tXylo\t3\t\tSH\t"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    got = sorted(tuple(r) for r in filings.holdings_table(spark, path).collect())
    assert got == [("ABC", "Acme", 30.0, 10.0, 2), ("XYZ", "Xylo", 3.0, 0.0, 0)]
    assert {r.cusip: r.shares for r in filings.holdings_table(spark, path, only_shares=False).collect()}["ABC"] == 17.0

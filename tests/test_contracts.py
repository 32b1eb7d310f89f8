"""Contract checks on planted faults, nulls and empty tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.operators import contracts

INF, NAN = float("inf"), float("nan")
DAY = dt.date(2020, 1, 1)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_field_audit(spark):
    texts = ['{"t": "a", "x": 1, "extra": 2}', '{"t": "b", "extra": null}', '{"x": 3, "odd": {"t": 1}}', "[1]", "{broken", None, '{"x": 1, "x": 2}']
    got = contracts.field_audit(spark.createDataFrame([(t,) for t in texts], "j string"), "j", {"t": True, "x": False, "never": False, "must": True}, share=0.25)
    assert rows(got) == {("t", True, True, 2, 7, "missing"), ("x", True, False, 3, 7, "ok"), ("never", True, False, 0, 7, "never emitted"), ("must", True, True, 0, 7, "missing"), ("extra", False, False, 2, 7, "undeclared"), ("odd", False, False, 1, 7, "undeclared")}
    half = {r.field for r in contracts.field_audit(spark.createDataFrame([(t,) for t in texts], "j string"), "j", {"t": True}).collect()}
    assert half == {"t", "x"}  # three of seven, the floor of half of them, are common
    none = contracts.field_audit(spark.createDataFrame([], "j string"), "j", {"t": True, "x": False})
    assert {(r.field, r.records, r.verdict) for r in none.collect()} == {("t", 0, "ok"), ("x", 0, "ok")}


def test_duplicates_and_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), ("", 5), (None, 9), (None, 8), ("c", None)], "k string, at int")
    assert rows(contracts.duplicate_keys(df, "k")) == {("a", 2, "repeated"), ("", 1, "missing"), (None, 2, "missing")}
    assert rows(contracts.duplicate_keys(df, "k", "at")) == {("", 5, 1, "missing"), (None, 9, 1, "missing"), (None, 8, 1, "missing"), ("c", None, 1, "missing")}
    assert rows(contracts.first_seen(df, "k", "at")) == {("a", 1), ("b", 1), ("", 5), (None, 8), ("c", None)}
    assert rows(contracts.duplicate_keys(df.limit(0), "k")) == rows(contracts.first_seen(df.limit(0), "k", "at")) == set()


def test_sets(spark):
    kind = "k string, tags array<string>"
    a = spark.createDataFrame([("x", ["s", "d", None]), ("y", None), ("z", [])], kind)
    b = spark.createDataFrame([("x", ["d", "n"]), ("w", ["q", "q"]), ("y", ["m"])], kind)
    assert {r.k: r.tags for r in contracts.merge_tags(a, b, "k", "tags").collect()} == {"x": ["d", "n", "s"], "y": ["m"], "z": [], "w": ["q"]}
    assert rows(contracts.tag_counts(a.unionByName(b), "tags")) == {("s", 1), ("d", 2), ("n", 1), ("q", 1), ("m", 1)}
    days = [DAY + dt.timedelta(days=i) for i in range(3)]
    d = spark.createDataFrame([("x", days[0]), ("x", days[1]), ("x", days[1]), ("y", days[1]), ("y", days[2]), (None, days[0]), ("x", None)], "k string, d date")
    assert rows(contracts.common_dates(d, "k", "d")) == {(days[1],)} and rows(contracts.common_dates(d.limit(0), "k", "d")) == set()


def test_non_finite(spark):
    schema = "a double, s struct<b:float, c:string, d:array<struct<e:double>>>, m map<string, array<double>>, n int, `odd.name` double"
    data = [(NAN, (1.0, "NaN", [(INF,), (1.0,), (NAN,)]), {"x": [-INF, 2.0], "y": None}, 1, INF), (None, None, None, None, None), (INF, (NAN, None, None), {}, 2, 1.0), (2.0, (1.0, None, []), {"x": [None]}, 3, None)]
    assert rows(contracts.non_finite(spark.createDataFrame(data, schema))) == {("a", 2, 2), ("s.b", 1, 1), ("s.d[].e", 1, 2), ("m{}[]", 1, 1), ("odd.name", 1, 1)}
    assert {r.numbers for r in contracts.non_finite(spark.createDataFrame([], schema)).collect()} == {0} and rows(contracts.non_finite(spark.createDataFrame([(1,)], "i int"))) == set()


def test_sanitized_and_bands(spark):
    df = spark.createDataFrame([(1.0, 5.0), (-1.0, 11.0), (NAN, INF), (None, None), (0.0, 10.0)], "x double, y double")
    got = contracts.sanitized(df, {"x": (0.0, None), "y": (None, 10.0)})
    assert [(r.x, r.y, r.nulled) for r in got.collect()] == [(1.0, 5.0, 0), (None, None, 2), (None, None, 2), (None, None, 0), (0.0, 10.0, 0)]
    b = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, None, 0.5), (3.0, 2.0, 1.0), (None, None, None), (1.0, 1.0, None), (None, 5.0, 4.0)], "p05 double, p50 double, p95 double")
    assert [r.c for r in b.select(contracts.crossed_bands(b, "p05", "p50", "p95").alias("c")).collect()] == [None, "p05>p95", "p05>p50", None, None, "p50>p95"]


def test_provenance(spark):
    data = [("a", 1, 1.00001), ("a", 2, 2.5), ("b", 1, None), (None, 1, 1.0), ("b", 2, -0.1)]
    one = lambda r, n=2: contracts.provenance(spark.createDataFrame(r, "k string, at int, v double").repartition(n), "k", "at", "v").first()
    base = one(data)
    assert base.series == 2 and one(data[::-1], 5) == base == one([("a", 1, 1.00002), *data[1:]])
    for other in ([*data[:1], ("a", 2, 2.6), *data[2:]], data[1:], [("c", *r[1:]) if r[0] == "a" else r for r in data], [("a", 3, 1.00001), *data[1:]]):
        assert one(other).digest != base.digest
    assert one([]).series == 0


@pytest.mark.parametrize("n, then, bad", [(100, 100, {"known sectors"}), (60, 100, {"names lost"}), (20, 0, {"too few names"}), (0, 0, {"too few names"})])
def test_universe(spark, n, then, bad):
    names = spark.range(n).select(F.format_string("n%d", "id").alias("k"), F.when(F.col("id") % 4 == 0, "Energy").otherwise("Unknown").alias("s"))
    got = contracts.universe_checks(names, spark.range(then), "k", "s", ["Energy"])
    assert {r.check for r in got.collect() if not r.ok} == bad


def test_universe_keys(spark):
    names = spark.range(40).select(F.when(F.col("id") < 3, None).when(F.col("id") < 5, "").when(F.col("id") < 8, "twin").otherwise(F.format_string("n%d", "id")).alias("k"), F.lit(None).cast("string").alias("s"))
    got = {r.check: (r.value, r.ok) for r in contracts.universe_checks(names, names.limit(0), "k", "s", ["Energy"]).collect()}
    assert got == {"too few names": (40, True), "missing keys": (5, False), "repeated keys": (1, False), "known sectors": (0, True), "names lost": (0, True)}


def test_sparse_drivers(spark):
    df = spark.createDataFrame([("a", "OIL", 0.5), ("a", "GOLD", -0.7), ("a", "TIN", 0.04), ("a", "RATE", NAN), ("a", None, 9.0), ("b", "OIL", 0.01), ("c", "OIL", None), ("d", "X", 0.2), ("d", "W", -0.2), ("d", "W", 0.1)], "n string, f string, b double")
    got = {r.n: (r.drivers, r.dominant, r.dominant_beta) for r in contracts.sparse_drivers(df, "n", "f", "b").collect()}
    assert got == {"a": ({"OIL": 0.5, "GOLD": -0.7}, "GOLD", -0.7), "b": ({}, None, None), "c": ({}, None, None), "d": ({"X": 0.2, "W": -0.2}, "W", -0.2)}

"""Queries of what was known when, and of stores that are written again, and their SQL.

Items are filings: a supplier reports on the quarter before, on the day of shipping, at an hour that follows from the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import point_in_time as pit
from ..sources import files, stores
from ..sources.panels import by_week, sql, table, weekly_bars
from .time_series import rounded


def _filings(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "lineitem")
    filed = F.to_date("l_shipdate")
    hours = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5) % 24).cast("int")
    period = F.date_sub(F.to_date(F.date_trunc("quarter", "l_shipdate")), 1)
    form = F.when(F.month(period) == 12, "10-K").otherwise("10-Q")
    filer = F.element_at(F.array(F.lit("large"), F.lit("accel"), F.lit("non")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    f = i.select("l_orderkey", "l_linenumber", "l_suppkey", period.alias("period"), filed.alias("filed"), F.timestamp_add("HOUR", hours, F.col("l_shipdate")).alias("accepted"), form.alias("form"), filer.alias("filer"), F.col("l_extendedprice").alias("value"))
    return f.withColumn("available", pit.available_at(F.col("filed"), F.col("accepted")))


def _availability(s: SparkSession, d: str) -> DataFrame:
    due = pit.filing_deadline(F.col("period"), F.col("form"), F.col("filer"))
    return _filings(s, d).select("l_orderkey", "l_linenumber", "available", due.alias("due"), (F.col("available") > due).alias("late"))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("decided"))
    return table(s, d, "lineitem").select("l_suppkey", "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "decided").distinct()


_STATE = ["period", "available", "l_orderkey", "l_linenumber", "value"]


def _known(s: SparkSession, d: str) -> DataFrame:
    return rounded(pit.known_at(_filings(s, d), _decisions(s, d), ["l_suppkey"], "available", "decided", _STATE).drop("l_orderkey", "l_linenumber"))


def _reported(s: SparkSession, d: str) -> DataFrame:
    """Each supplier's quarter as it stood 45 days after it ended, and as it stands at last."""
    f = _filings(s, d)
    last = f.groupBy("l_suppkey", "period").agg(F.max_by("value", F.struct("available", "l_orderkey", "l_linenumber")).alias("final")).withColumn("asked", F.date_add("period", 45))
    then = pit.known_at(f, last, ["l_suppkey", "period"], "available", "asked", ["available", "l_orderkey", "l_linenumber", "value"])
    return rounded(then.select("l_suppkey", "period", "asked", "available", "value", "final"))


def _revision(s: SparkSession, d: str) -> DataFrame:
    f = _filings(s, d).withColumn("tie", F.struct("l_orderkey", "l_linenumber"))
    return rounded(pit.revision(f, ["l_suppkey", "period"], "available", "value", F.date_add("period", 30), "tie"))


def _replay(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_orderpriority", F.date_add(F.to_date("o_orderdate"), 60).alias("decided"))
    used = _filings(s, d).join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return pit.replay(used, "decided", "available", ["o_orderpriority", "form"])


_FACTORS = ["mom", "rev", "size"]


def _snapshots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Factors at the last week of each month, and the prices of all weeks."""
    bars = weekly_bars(s, d)
    ago = lambda n: F.col("c") / F.lag("c", n).over(by_week()) - 1
    x = bars.select(F.col("wk").alias("as_of"), F.col("ticker").alias("name"), F.col("c").alias("px"), ago(12).alias("mom"), ago(1).alias("rev"), F.col("v").cast("double").alias("size"))
    month = x.where(F.month(F.date_add("as_of", 7)) != F.month("as_of"))
    return month, x.select("as_of", "name", "px")


def _stored(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The snapshots by way of a store that is written in parts that overlap, twice, with other values the second time."""
    snaps, prices = _snapshots(s, d)
    path, snaps = files.shared(s, "snapshots"), snaps.withColumn("year", F.year("as_of"))
    for part in ("as_of < '1998-06-01'", "as_of >= '1998-01-01'"):
        stores.record(snaps.where(part), path, ["as_of", "name", "year"], "year", ["px"])
    stores.record(snaps.withColumn("px", F.col("px") * 2), path, ["as_of", "name", "year"], "year", ["px"])
    return stores.read(s, path), prices


def _store(s: SparkSession, d: str) -> DataFrame:
    return rounded(_stored(s, d)[0].select("as_of", "name", "px", *_FACTORS, F.col("year").cast("long").alias("year")))


def _mature(s: SparkSession, d: str) -> DataFrame:
    snaps, prices = _stored(s, d)
    return pit.mature(snaps, prices, _FACTORS, 28)


QUERIES = {
    "filing_availability": _availability,
    "known_at_decision": _known,
    "as_reported_vintage": _reported,
    "vintage_revision": _revision,
    "replay_audit": _replay,
    "snapshot_store": _store,
    "ic_maturity": _mature,
}

_FILINGS_SQL = """p AS (SELECT *, l_shipdate::DATE AS filed, l_shipdate + to_hours((l_orderkey * 7 + l_linenumber * 5) % 24) AS accepted, (date_trunc('quarter', l_shipdate)::DATE - 1) AS period, l_extendedprice AS value FROM lineitem),
f AS (SELECT *, CASE WHEN month(period) = 12 THEN '10-K' ELSE '10-Q' END AS form, ['large', 'accel', 'non'][(l_suppkey % 3 + 1)::INT] AS filer,
      CASE WHEN isodow(accepted) >= 6 OR hour(accepted) >= 22 OR isodow(filed) >= 6 THEN CASE WHEN isodow(filed + 1) <= 5 THEN filed + 1 WHEN isodow(filed + 2) <= 5 THEN filed + 2 ELSE filed + 3 END ELSE filed END AS available FROM p)"""
_SNAPS_SQL = """, x AS (SELECT wk AS as_of, ticker AS name, c AS px, c / lag(c, 12) OVER w - 1 AS mom, c / lag(c) OVER w - 1 AS rev, v::DOUBLE AS size FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY wk)),
s AS (SELECT * FROM x WHERE month(as_of + 7) <> month(as_of))"""
ORACLE_SQL = {
    "filing_availability": f"""WITH {_FILINGS_SQL}, g AS (SELECT *, period + (CASE WHEN form = '10-K' THEN CASE filer WHEN 'large' THEN 60 WHEN 'accel' THEN 75 ELSE 90 END ELSE CASE filer WHEN 'non' THEN 45 ELSE 40 END END) AS due FROM f)
SELECT l_orderkey, l_linenumber, available, due::DATE AS due, available > due AS late FROM g""",
    "known_at_decision": f"""WITH {_FILINGS_SQL}, a AS (SELECT DISTINCT l_suppkey, o_orderdate::DATE AS decided FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT a.l_suppkey, a.decided, max({{'period': period, 'available': available, 'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'value': value}}) AS s
      FROM a LEFT JOIN f ON f.l_suppkey = a.l_suppkey AND f.available <= a.decided GROUP BY ALL)
SELECT l_suppkey, decided, s.period AS period, s.available AS available, round(s.value, 6) AS value FROM b""",
    "as_reported_vintage": f"""WITH {_FILINGS_SQL}, r AS (SELECT *, {{'a': available, 'o': l_orderkey, 'l': l_linenumber}} AS k FROM f)
SELECT l_suppkey, period, (period + 45)::DATE AS asked, max(available) FILTER (WHERE available <= period + 45) AS available,
       round(arg_max(value, k) FILTER (WHERE available <= period + 45), 6) AS value, round(arg_max(value, k), 6) AS final FROM r GROUP BY l_suppkey, period""",
    "vintage_revision": f"""WITH {_FILINGS_SQL}, r AS (SELECT *, {{'a': available, 'o': l_orderkey, 'l': l_linenumber}} AS k FROM f WHERE available >= period + 30),
g AS (SELECT l_suppkey, period, arg_min(value, k) AS value0, min(available) AS at0, arg_max(value, k) AS value1, max(available) AS at1, count(*) AS n FROM r GROUP BY ALL)
SELECT l_suppkey, period, round(value0, 6) AS value0, at0, round(value1, 6) AS value1, at1, n, round(100 * (value1 - value0) / abs(value0), 2) AS drift_pct FROM g WHERE n > 1 AND value0 <> 0""",
    "replay_audit": f"""WITH {_FILINGS_SQL}, u AS (SELECT f.*, o_orderpriority, (o_orderdate::DATE + 60) AS decided FROM f LEFT JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderpriority, form, count(*) AS used, count(*) FILTER (WHERE available > decided) AS leaks, count(*) FILTER (WHERE available IS NULL) AS undated, count(*) FILTER (WHERE available > decided) = 0 AS replay_ok FROM u GROUP BY ALL""",
    "snapshot_store": sql(_SNAPS_SQL + " SELECT as_of, name, round(px, 6) AS px, round(mom, 6) AS mom, round(rev, 6) AS rev, round(size, 6) AS size, year(as_of) AS year FROM s"),
    "ic_maturity": sql(
        _SNAPS_SQL
        + """, due AS (SELECT origin, min(x.as_of) AS as_of FROM (SELECT DISTINCT as_of AS origin FROM s) JOIN (SELECT DISTINCT as_of FROM x) AS x ON x.as_of >= origin + 28 GROUP BY origin),
h AS (SELECT *, count(mom) OVER o > 0 AS has_mom, count(rev) OVER o > 0 AS has_rev FROM s WINDOW o AS (PARTITION BY as_of)),
j AS (SELECT due.origin, due.as_of, h.name, h.mom, h.rev, h.size, has_mom, has_rev, x.px / h.px - 1 AS fwd FROM h JOIN due ON h.as_of = due.origin JOIN x ON x.as_of = due.as_of AND x.name = h.name
      WHERE (h.mom IS NOT NULL OR NOT has_mom) AND (h.rev IS NOT NULL OR NOT has_rev)),
l AS (SELECT origin, as_of, fwd, 'mom' AS factor, mom AS v FROM j WHERE has_mom UNION ALL SELECT origin, as_of, fwd, 'rev', rev FROM j WHERE has_rev UNION ALL SELECT origin, as_of, fwd, 'size', size FROM j),
k AS (SELECT *, rank() OVER (PARTITION BY origin, factor ORDER BY v) + (count(*) OVER (PARTITION BY origin, factor, v) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY origin, factor ORDER BY fwd) + (count(*) OVER (PARTITION BY origin, factor, fwd) - 1) / 2.0 AS ry FROM l)
SELECT origin, as_of, factor, count(*) AS n, round(coalesce(CASE WHEN isnan(corr(rx, ry)) THEN NULL ELSE corr(rx, ry) END, 0), 5) AS ic FROM k GROUP BY ALL HAVING count(*) >= 5"""
    ),
}

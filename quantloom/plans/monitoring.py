"""Queries of ledgers, alarms, shrunk covariances and nested filings, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import phi, phi_sql
from ..operators import monitoring as mon
from ..sources import files, filings
from ..sources.panels import by_week, sql, table, weekly_bars, weekly_returns
from ..streaming.intraday import ROCKS, drain
from ..streaming.ledger import ledger_stream
from .time_series import rounded


def _forecasts(s: SparkSession, d: str) -> DataFrame:
    """Each week's return as forecast by the mean and spread of the 26 weeks before; it matures four weeks on."""
    w = by_week().rowsBetween(-26, -1)
    r = weekly_returns(weekly_bars(s, d)).where("lr is not null")
    f = r.select("ticker", "wk", "lr", F.count("lr").over(w).alias("k"), F.avg("lr").over(w).alias("mu"), F.stddev_samp("lr").over(w).alias("sigma")).where("k = 26 and sigma > 0")
    return f.select("ticker", "wk", "lr", "mu", "sigma", (F.col("mu") - 1.6448536 * F.col("sigma")).alias("lower"), (F.col("mu") + 1.6448536 * F.col("sigma")).alias("upper"), F.date_add("wk", 28).alias("matures"))


def _ledger(s: SparkSession, d: str) -> DataFrame:
    f = _forecasts(s, d)
    seen = f.where(F.dayofmonth("wk") % 5 != 0).select("ticker", "wk", F.col("lr").alias("y"))  # some outcomes never come
    return rounded(mon.ledger(f.drop("lr"), seen, ["ticker", "wk"], F.lit("2001-06-01").cast("date")).select("ticker", "wk", "status", "y", "residual", "z", "side", "covered", "interval_score"))


def _told(s: SparkSession, d: str) -> DataFrame:
    """The forecasts as they are issued and the outcomes as they come, thirty days on; some never do."""
    f = _forecasts(s, d)
    stamp = lambda c: F.col(c).cast("timestamp")
    none = [F.lit(None).cast("double").alias(c) for c in ("mu", "sigma", "lower", "upper")]
    name = (F.col("ticker").alias("key"), stamp("wk").alias("origin"), stamp("matures").alias("matures"))
    issued = f.select(stamp("wk").alias("ts"), *name, "mu", "sigma", "lower", "upper", F.lit(None).cast("double").alias("y"))
    return issued.unionByName(f.where(F.dayofmonth("wk") % 5 != 0).select(F.date_add("wk", 30).cast("timestamp").alias("ts"), *name, *none, F.col("lr").alias("y")))


def _ledger_stream(s: SparkSession, d: str) -> DataFrame:
    path = files.shared(s, "forecasts")
    told = _told(s, d)
    told.write.parquet(path)
    out = drain(ledger_stream(s.readStream.schema(told.schema).parquet(path), "60 days"), ["key", "origin", "matures"], "append", ROCKS)
    return rounded(out.withColumns({c: F.to_date(c) for c in ("origin", "matures")}))


def _alarm(s: SparkSession, d: str) -> DataFrame:
    pits = _forecasts(s, d).select("ticker", "wk", phi((F.col("lr") - F.col("mu")) / F.col("sigma")).alias("pit"))
    return rounded(mon.calibration_alarm(pits, "ticker", "wk", "pit", "pit"), 4)


def _returns(s: SparkSession, d: str) -> DataFrame:
    return weekly_returns(weekly_bars(s, d)).where("lr is not null").select("ticker", "wk", "lr")


def _ownership(s: SparkSession, d: str) -> DataFrame:
    """Orders as ownership documents, their items as transactions."""
    e = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    value = lambda name, x: e(name, e("value", x))
    # items are grouped as values and written as text behind the shuffle; documents are dealt by key, never broadcast
    i = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        "l_linenumber", F.col("l_shipdate").cast("date").alias("day"), (F.col("l_returnflag") == "R").alias("sold"), (F.col("l_tax") > 0.04).alias("planned"), F.col("l_quantity").cast("long").alias("n"), F.col("l_extendedprice").alias("price"),
    ))).alias("items"))
    note = lambda x: F.when(x["planned"], F.lit('<footnoteId id="F1"/>')).otherwise(F.lit('<footnoteId id="F2"/>'))
    written = lambda x: e(
        "nonDerivativeTransaction", value("transactionDate", x["day"].cast("string")), e("transactionCoding", e("transactionCode", F.when(x["sold"], "S").otherwise("P")), note(x)),
        e("transactionAmounts", value("transactionShares", x["n"].cast("string")), value("transactionPricePerShare", F.format_number(x["price"], 2)), value("transactionAcquiredDisposedCode", F.when(x["sold"], "D").otherwise("A"))),
    )
    t = i.select("l_orderkey", F.array_join(F.transform("items", written), "").alias("inner"))
    o = table(s, d, "orders").join(t.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    flags = e("reportingOwnerRelationship", e("isDirector", F.when(F.col("o_custkey") % 2 == 0, "1").otherwise("0")), e("isOfficer", F.when(F.col("o_custkey") % 3 == 0, "true").otherwise("false")), e("officerTitle", F.when(F.col("o_custkey") % 9 == 0, "Chief").otherwise("")), e("isTenPercentOwner", F.lit("1")))
    notes = F.lit('<footnotes><footnote id="F1">Under a Rule 10b5-1 plan &amp; more.</footnote><footnote id="F2">Held in trust.</footnote></footnotes>')
    whole = e("ownershipDocument", e("reportingOwner", e("reportingOwnerId", e("rptOwnerName", F.concat(F.lit(" Owner "), F.col("o_custkey")))), flags), e("nonDerivativeTable", F.coalesce("inner", F.lit(""))), notes)
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 7, F.lit("<ownershipDocument><broken")).otherwise(whole).alias("xml"))


def _insiders(s: SparkSession, d: str) -> DataFrame:
    return rounded(filings.insider_transactions(_ownership(s, d), "o_orderkey", "xml"))


def _facts(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as companies, the sums of their items by quarter as reported facts, restated once."""
    i = table(s, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("fy"), F.quarter("l_shipdate").alias("q")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    both = i.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    last = F.col("q") == 4
    point = F.struct(
        F.concat_ws("-", "fy", F.lpad((F.col("q") * 3).cast("string"), 2, "0"), F.lit("28")).alias("end"), (F.col("v") + F.col("again")).alias("val"), "fy", F.when(last, "FY").otherwise(F.concat(F.lit("Q"), F.col("q"))).alias("fp"),
        F.when(last, "10-K").otherwise("10-Q").alias("form"), F.concat_ws("-", (F.col("fy") + 1).cast("string"), F.when(F.col("again") == 1, "03").otherwise("02"), F.lit("01")).alias("filed"),
    )
    rows = both.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("fy", "q", F.negative("again").alias("again"), point.alias("p")))).alias("r")).select("l_suppkey", F.transform("r", lambda x: x["p"]).alias("r"))
    concept = F.when(F.col("l_suppkey") % 2 == 0, "Revenues").otherwise("SalesRevenueNet")
    doc = F.struct(F.struct(F.create_map(concept, F.struct(F.create_map(F.lit("USD"), F.col("r")).alias("units"))).alias("us-gaap")).alias("facts"))
    return rows.select("l_suppkey", F.when(F.col("l_suppkey") % 10 != 3, F.to_json(doc)).alias("json"))


def _annual(s: SparkSession, d: str) -> DataFrame:
    return rounded(filings.annual_series(_facts(s, d), "l_suppkey", "json", ["Revenues", "SalesRevenueNet"]))


def _holdings(s: SparkSession, d: str) -> DataFrame:
    path = files.shared(s, "infotable")
    p = table(s, d, "part").select("p_partkey", "p_brand")
    i = table(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    i.select(
        F.concat_ws("-", "l_orderkey", "l_suppkey").alias("Accession_Number"), F.lower("p_brand").alias("cusip"), F.col("p_brand").alias("NAMEOFISSUER"), F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("VALUE"),
        F.col("l_quantity").alias("SSHPRNAMT"), F.when(F.col("l_returnflag") == "N", "PRN").otherwise("SH").alias("SSHPRNAMTTYPE"), F.when(F.col("l_linestatus") == "O", F.when(F.col("l_orderkey") % 4 == 0, "Put")).alias("PUTCALL"),
    ).write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)
    return rounded(filings.holdings_table(s, path), 4)


QUERIES = {
    "forecast_ledger": _ledger,
    "forecast_ledger_stream": _ledger_stream,
    "calibration_alarm": _alarm,
    "shrunk_covariance": lambda s, d: rounded(mon.shrunk_covariance(_returns(s, d), "ticker", "wk", "lr"), 9),
    "cluster_order": lambda s, d: rounded(mon.cluster_order(_returns(s, d), "ticker", "wk", "lr").withColumn("place", F.col("place").cast("long"))),
    "insider_transactions": _insiders,
    "annual_facts": _annual,
    "holdings_table": _holdings,
}

_FC = """, fc AS (SELECT * FROM (SELECT ticker, wk, lr, count(lr) OVER b AS k, avg(lr) OVER b AS mu, stddev_samp(lr) OVER b AS sigma FROM ret WHERE lr IS NOT NULL WINDOW b AS (PARTITION BY ticker ORDER BY wk ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)) WHERE k = 26 AND sigma > 0),
f AS (SELECT *, mu - 1.6448536::DOUBLE * sigma AS lo, mu + 1.6448536::DOUBLE * sigma AS hi FROM fc)"""
_cap = repr(math.log(mon.CAP)) + "::DOUBLE"


def _bets() -> str:
    out = ""
    for name, (m, low, high) in mon.BETS.items():
        dev = max(m - low, high - m)
        x = "u" if name == "location" else "abs(u - 0.5)"
        out += f""", a_{name} AS (SELECT *, coalesce(sum(x) OVER b, 0) AS s, coalesce(sum(x * x) OVER b, 0) AS q FROM (SELECT ticker, place, {x} AS x FROM pl) WINDOW b AS (PARTITION BY ticker ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b_{name} AS (SELECT *, ({m}::DOUBLE + s) / place AS mu FROM a_{name}), c_{name} AS (SELECT *, least(abs((mu - {m}::DOUBLE) / greatest(({dev * dev / 3!r}::DOUBLE + q - 2 * mu * s + (place - 1) * mu * mu) / place, 1e-12)), {mon.SHARE / dev}::DOUBLE) * (x - {m}::DOUBLE) AS step FROM b_{name}),
d_{name} AS (SELECT ticker, place, sum(ln(1 + step)) OVER o AS up, sum(ln(1 - step)) OVER o AS down FROM c_{name} WINDOW o AS (PARTITION BY ticker ORDER BY place)),
e_{name} AS (SELECT ticker, place, (exp(up - greatest(max(up) OVER o - {_cap}, 0)) + exp(down - greatest(max(down) OVER o - {_cap}, 0))) / 2 AS h FROM d_{name} WINDOW o AS (PARTITION BY ticker ORDER BY place)),
g_{name} AS (SELECT ticker, count(*) AS n, greatest(max(h), 1) AS most, arg_max(h, place) AS last FROM e_{name} GROUP BY ticker)"""
    return out


_PANEL = """, w AS (SELECT wk FROM ret WHERE lr IS NOT NULL GROUP BY wk HAVING count(*) = (SELECT count(DISTINCT ticker) FROM ret WHERE lr IS NOT NULL)),
x AS (SELECT ticker, wk, lr - avg(lr) OVER (PARTITION BY ticker) AS x FROM ret JOIN w USING (wk) WHERE lr IS NOT NULL),
s AS (SELECT a.ticker AS a, b.ticker AS b, avg(a.x * b.x) AS s FROM x a JOIN x b USING (wk) GROUP BY ALL)"""
ORACLE_SQL = {
    "forecast_ledger": sql(_FC + """, l AS (SELECT *, CASE WHEN wk + 28 <= DATE '2001-06-01' AND day(wk) % 5 <> 0 THEN lr END AS y FROM f)
SELECT ticker, wk, CASE WHEN y IS NULL THEN 'open' ELSE 'matured' END AS status, round(y, 6) AS y, round(y - mu, 6) AS residual, round((y - mu) / sigma, 6) AS z, CASE WHEN y < lo THEN 'lower_miss' WHEN y > hi THEN 'upper_miss' WHEN y IS NOT NULL THEN 'inside' END AS side,
y >= lo AND y <= hi AS covered, round(CASE WHEN y IS NOT NULL THEN hi - lo + 20.0::DOUBLE * (greatest(lo - y, 0) + greatest(y - hi, 0)) END, 6) AS interval_score FROM l"""),
    "forecast_ledger_stream": sql(_FC + f""", r AS (SELECT *, wk + 28 AS matures FROM f WHERE day(wk) % 5 <> 0 AND wk + 28 <= (SELECT max(wk + CASE WHEN day(wk) % 5 <> 0 THEN 30 ELSE 0 END) FROM f) - 60),
pl AS (SELECT *, {phi_sql('((lr - mu) / sigma)')} AS u, row_number() OVER (PARTITION BY ticker ORDER BY matures) AS place FROM r)""" + _bets() + """,
e AS (SELECT ticker, place, (a.h + b.h) / 2 AS now, (greatest(max(a.h) OVER w, 1) + greatest(max(b.h) OVER w, 1)) / 2 AS most FROM e_location a JOIN e_dispersion b USING (ticker, place) WINDOW w AS (PARTITION BY ticker ORDER BY place))
SELECT ticker AS key, wk AS origin, matures, round(lr, 6) AS y, round(lr - mu, 6) AS residual, round((lr - mu) / sigma, 6) AS z, CASE WHEN lr < lo THEN 'lower_miss' WHEN lr > hi THEN 'upper_miss' ELSE 'inside' END AS side, lr >= lo AND lr <= hi AS covered,
round(hi - lo + 20.0::DOUBLE * (greatest(lo - lr, 0) + greatest(lr - hi, 0)), 6) AS interval_score, place, round(log10(now), 6) + 0.0 AS evidence, round(log10(most), 6) + 0.0 AS evidence_max,
CASE WHEN place >= 20 THEN CASE WHEN most >= 100 THEN 'kill' WHEN most >= 20 THEN 'warn' ELSE 'ok' END END AS level FROM pl JOIN e USING (ticker, place)"""),
    "calibration_alarm": sql(_FC + f", pl AS (SELECT ticker, {phi_sql('((lr - mu) / sigma)')} AS u, row_number() OVER (PARTITION BY ticker ORDER BY wk) AS place FROM f)" + _bets() + """
SELECT l.ticker, l.n, round((l.last + d.last) / 2, 4) AS e_value, round((l.most + d.most) / 2, 4) AS e_max, round(least(2 / (l.most + d.most), 1), 4) AS p_anytime, CASE WHEN (l.most + d.most) / 2 >= 100 THEN 'kill' WHEN (l.most + d.most) / 2 >= 20 THEN 'warn' ELSE 'ok' END AS level,
round(l.most, 4) AS max_location, round(d.most, 4) AS max_dispersion FROM g_location l JOIN g_dispersion d USING (ticker) WHERE l.n >= 20"""),
    "shrunk_covariance": sql(_PANEL + """, m AS (SELECT avg(s) FILTER (WHERE a = b) AS m, count(*) FILTER (WHERE a = b) AS p, (SELECT count(*) FROM w) AS t FROM s),
d AS (SELECT sum((s - CASE WHEN a = b THEN m ELSE 0 END) ** 2) / any_value(p) AS d2 FROM s, m), e AS (SELECT sum((a.x * b.x - s) ** 2) / any_value(t * t * p) AS b2 FROM x a JOIN x b USING (wk) JOIN s ON s.a = a.ticker AND s.b = b.ticker, m),
k AS (SELECT m, CASE WHEN d2 > 0 THEN least(greatest(least(b2, d2) / d2, 0), 1) ELSE 0 END AS delta FROM m, d, e)
SELECT a, b, round(delta, 9) AS delta, round(s, 9) + 0.0 AS sample, round(CASE WHEN a = b THEN delta * m ELSE 0 END + (1 - delta) * s, 9) + 0.0 AS shrunk FROM s, k WHERE a <= b"""),
    "cluster_order": sql(_PANEL + """, v AS (SELECT a AS k, sqrt(s) AS sd FROM s WHERE a = b), c AS (SELECT a, list(CASE WHEN p.sd * q.sd > 0 THEN s / (p.sd * q.sd) ELSE 0 END ORDER BY b) AS r FROM s JOIN v p ON a = p.k JOIN v q ON b = q.k GROUP BY a),
m AS (SELECT list(a ORDER BY a) AS names, list(r ORDER BY a) AS m FROM c),
it AS (WITH RECURSIVE it AS (SELECT 0 AS i, names, m, list_transform(names, lambda y: 1 / sqrt(len(names))) AS v FROM m UNION ALL
  SELECT i + 1, names, m, list_transform(w, lambda y: y / sqrt(list_dot_product(w, w))) FROM (SELECT i, names, m, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM it WHERE i < 60)) SELECT * FROM it WHERE i = 60),
o AS (SELECT unnest(names) AS a, unnest(v) AS loading FROM it) SELECT a, round(loading, 6) + 0.0 AS loading, row_number() OVER (ORDER BY loading, a) AS place FROM o"""),
    "insider_transactions": """SELECT o_orderkey, 'Owner ' || o_custkey AS name, CASE WHEN o_custkey % 9 = 0 THEN 'Chief' WHEN o_custkey % 3 = 0 THEN 'Officer' WHEN o_custkey % 2 = 0 THEN 'Director' ELSE '10% owner' END AS role, strftime(l_shipdate, '%Y-%m-%d') AS date,
CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'P' END AS code, CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'A' END AS side, l_quantity AS shares, round(l_extendedprice, 2) AS price, round(CASE WHEN l_quantity <> 0 AND l_extendedprice <> 0 THEN l_quantity * round(l_extendedprice, 2) END, 6) AS value, l_tax > 0.04 AS planned
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 50 <> 7""",
    "annual_facts": """SELECT l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 'Revenues' ELSE 'SalesRevenueNet' END AS concept, year(l_shipdate)::INT AS fy, year(l_shipdate) || '-12-28' AS "end", round(round(sum(l_extendedprice), 2) + 1, 6) AS value
FROM lineitem WHERE quarter(l_shipdate) = 4 AND l_suppkey % 10 <> 3 GROUP BY l_suppkey, year(l_shipdate)""",
    "holdings_table": """SELECT upper(p_brand) AS cusip, min(p_brand) AS issuer, round(sum(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice END), 4) AS value, round(sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END), 4) AS shares, count(DISTINCT l_orderkey || '-' || l_suppkey) AS holders
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT (l_linestatus = 'O' AND l_orderkey % 4 = 0) GROUP BY upper(p_brand)""",
}

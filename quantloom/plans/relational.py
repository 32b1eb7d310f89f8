"""Queries that join by time and priority, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources.panels import market, sql, table, weekly_bars, weekly_returns
from .time_series import rounded


def _trades(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return items.select(F.col("p_brand").alias("ticker"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("quarter"), F.col("l_suppkey").alias("holder"), F.col("l_quantity").alias("shares"))


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the item shipped to its customer nearest to its date."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("at"))
    items = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    other = items.select("o_custkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("near"), F.to_date("l_shipdate").alias("near_at"))
    return rel.nearest_within(orders, other, "o_custkey", "at", "near_at", "near", 15).select("o_orderkey", "near", F.col("days").cast("long").alias("days"))


def _nearest_other(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("at"))
    other = orders.select("o_custkey", F.col("o_orderkey").alias("near"), F.col("at").alias("near_at"))
    return rel.nearest_within(orders, other, "o_custkey", "at", "near_at", "near", 15, own="o_orderkey").select("o_orderkey", "near", F.col("days").cast("long").alias("days"))


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("at"))
    prices = table(spark, d, "lineitem").groupBy("l_suppkey", F.date_add(F.to_date("l_shipdate"), 1).alias("known")).agg(F.max("l_extendedprice").alias("price"))
    return rel.as_of(items, prices, "l_suppkey", "at", "known", "price").select("l_orderkey", "l_linenumber", "price")


def _known(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    cut = items.withColumn("decision", F.date_add(F.to_date("o_orderdate"), 30)).withColumn("available", F.to_date("l_shipdate"))
    return rel.known_by(cut, "decision", "available").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.bool_and(F.col("available") <= F.col("decision")).alias("replay_ok"))


def _universe(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("tag"), F.lit(None).cast("string").alias("label")).distinct()
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("tag"), F.lit(None).cast("string").alias("label")).distinct()
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit("nation").alias("tag"), F.col("n_name").alias("label"))
    return rel.by_priority([c, s, n], "k", "tag", "label")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    ret = weekly_returns(weekly_bars(spark, d)).where("r is not null")
    g = ret.groupBy("sec", "wk").agg(F.avg("r").alias("r"))
    return rel.label_runs(g.withColumn("label", F.when(F.col("r") > 0, "in").otherwise("out")), "sec", "wk", "label").select("sec", "label", "since", "until", "length", F.col("runs").cast("long").alias("runs"))


def _turnover(spark: SparkSession, d: str) -> DataFrame:
    q = _trades(spark, d).groupBy("ticker", "quarter").agg(F.sum("shares").alias("s"))
    return rel.turnover_path(q.withColumn("w", F.col("s") / F.sum("s").over(Window.partitionBy("quarter"))), "quarter", "ticker", "w")


def _maturity(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("issued"), F.col("o_totalprice").alias("mu"))
    seen = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.to_date(F.max("l_shipdate")).alias("seen"), F.sum("l_extendedprice").alias("y"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    return rel.maturity(o, seen, done, 60).select("id", "issued", "seen", "mu", "y")


QUERIES = {
    "nearest_join_15d": _nearest,
    "nearest_other_order_15d": _nearest_other,
    "as_of_join": lambda s, d: rounded(_as_of(s, d)),
    "point_in_time_guard": lambda s, d: rounded(_known(s, d)),
    "universe_union": _universe,
    "quarterly_holder_flow": lambda s, d: rounded(rel.holdings(_trades(s, d))),
    "holders_hhi": lambda s, d: rounded(rel.concentration(_trades(s, d))),
    "weight_turnover": lambda s, d: rounded(_turnover(s, d)),
    "rotation_trend_age": _runs,
    "forecast_maturity": lambda s, d: rounded(_maturity(s, d)),
    "insider_signal": lambda s, d: rounded(rel.insider(table(s, d, "events"))),
}

_TRADES = "trades AS (SELECT p_brand AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, l_suppkey AS holder, l_quantity AS shares FROM lineitem JOIN part ON l_partkey = p_partkey)"
ORACLE_SQL = {
    "nearest_join_15d": """WITH b AS (SELECT o_custkey, l_orderkey * 10 + l_linenumber AS near, l_shipdate::DATE AS shipped FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.o_orderkey, near, abs(shipped - a.o_orderdate::DATE) AS days FROM orders a JOIN b ON a.o_custkey = b.o_custkey AND abs(shipped - a.o_orderdate::DATE) <= 15
QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(shipped - a.o_orderdate::DATE), shipped, near) = 1""",
    "nearest_other_order_15d": """SELECT a.o_orderkey, b.o_orderkey AS near, abs(b.o_orderdate::DATE - a.o_orderdate::DATE) AS days FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(b.o_orderdate::DATE - a.o_orderdate::DATE) <= 15
QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(b.o_orderdate::DATE - a.o_orderdate::DATE), b.o_orderdate::DATE, b.o_orderkey) = 1""",
    "as_of_join": """WITH p AS (SELECT l_suppkey, l_shipdate::DATE + 1 AS known, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, round(price, 6) AS price FROM lineitem i ASOF LEFT JOIN p ON i.l_suppkey = p.l_suppkey AND i.l_shipdate::DATE >= p.known""",
    "point_in_time_guard": """SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 6) AS qty, true AS replay_ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate::DATE <= o_orderdate::DATE + 30 GROUP BY o_orderpriority""",
    "universe_union": """WITH u AS (SELECT DISTINCT c_nationkey AS k, 'customer' AS tag, NULL AS label FROM customer UNION ALL SELECT DISTINCT s_nationkey, 'supplier', NULL FROM supplier UNION ALL SELECT n_nationkey, 'nation', n_name FROM nation)
SELECT k, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, max(label) AS label, count(*) AS n FROM u GROUP BY k""",
    "quarterly_holder_flow": f"""WITH {_TRADES}, q AS (SELECT ticker, quarter, sum(shares) AS shares, count(DISTINCT holder) AS holders FROM trades GROUP BY ALL),
c AS (SELECT *, 100 * (shares - lag(shares) OVER w) / lag(shares) OVER w AS d_shares, (holders - lag(holders) OVER w)::DOUBLE AS d_holders FROM q WINDOW w AS (PARTITION BY ticker ORDER BY quarter))
SELECT ticker, quarter, round(shares, 6) AS shares, holders, round(d_shares, 6) AS d_shares, d_holders, CASE WHEN d_shares >= 2 THEN 'accumulation' WHEN d_shares <= -2 THEN 'distribution' WHEN d_shares IS NOT NULL THEN 'steady' END AS verdict FROM c""",
    "holders_hhi": f"WITH {_TRADES}, h AS (SELECT ticker, sum(shares) AS s FROM trades GROUP BY ticker, holder), w AS (SELECT ticker, s / sum(s) OVER (PARTITION BY ticker) AS w FROM h) SELECT ticker, round(sum(w * w), 6) AS hhi, round(1 / sum(w * w), 6) AS effective, round(max(w), 6) AS top FROM w GROUP BY ticker",
    "weight_turnover": f"""WITH {_TRADES}, q AS (SELECT ticker, quarter, sum(shares) AS s FROM trades GROUP BY ALL), w AS (SELECT ticker, quarter, s / sum(s) OVER (PARTITION BY quarter) AS w FROM q), d AS (SELECT quarter, lag(quarter) OVER (ORDER BY quarter) AS before FROM (SELECT DISTINCT quarter FROM q)),
k AS (SELECT d.quarter, d.before, ticker FROM d JOIN q ON q.quarter IN (d.quarter, d.before) WHERE d.before IS NOT NULL GROUP BY ALL)
SELECT k.quarter, round(sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))), 6) AS turnover, count(*) AS n FROM k LEFT JOIN w a ON a.quarter = k.quarter AND a.ticker = k.ticker LEFT JOIN w b ON b.quarter = k.before AND b.ticker = k.ticker GROUP BY k.quarter""",
    "rotation_trend_age": sql(""", g AS (SELECT sec, wk, CASE WHEN avg(r) > 0 THEN 'in' ELSE 'out' END AS label FROM ret WHERE r IS NOT NULL GROUP BY ALL), n AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY sec ORDER BY wk) THEN 0 ELSE 1 END AS x FROM g),
u AS (SELECT *, sum(x) OVER (PARTITION BY sec ORDER BY wk) AS run FROM n), e AS (SELECT sec, run, min(label) AS label, min(wk) AS since, max(wk) AS until, count(*) AS length FROM u GROUP BY ALL)
SELECT sec, label, since, until, length, run::BIGINT AS runs FROM e QUALIFY run = max(run) OVER (PARTITION BY sec)"""),
    "forecast_maturity": """WITH s AS (SELECT l_orderkey AS id, max(l_shipdate)::DATE AS seen, sum(l_extendedprice) AS y FROM lineitem GROUP BY l_orderkey)
SELECT id, o_orderdate::DATE AS issued, seen, round(o_totalprice, 6) AS mu, round(y, 6) AS y FROM orders JOIN s ON id = o_orderkey WHERE seen - o_orderdate::DATE >= 60 AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "insider_signal": """WITH s AS (SELECT user_id, coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0) AS b, coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) AS s, count(*) AS n FROM events WHERE (SELECT max(ts)::DATE FROM events) - ts::DATE <= 120 GROUP BY user_id)
SELECT user_id, round(b, 6) AS bought, round(s, 6) AS sold, n, round(least(greatest((b - s) / nullif(b + s, 0), -1), 1), 6) AS score FROM s""",
}

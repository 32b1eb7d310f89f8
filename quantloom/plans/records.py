"""Queries on files and records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as rec
from ..sources import files
from ..sources.panels import sql, table, weekly_bars
from .time_series import rounded


def _jsonl(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = files.write_jsonl(o, files.shared(s, "jsonl"))
    s.createDataFrame([('{"o_orderkey": 1, "o_total',), ("not an object",)], "value string").write.mode("append").text(path)
    return rounded(files.read_jsonl(s, path, "o_orderkey long, o_totalprice double, o_orderpriority string"))


def _delimited(s: SparkSession, d: str) -> DataFrame:
    path = files.shared(s, "delimited")
    rows = table(s, d, "supplier").select(F.concat_ws("|", F.col("s_suppkey").cast("string"), F.col("s_name"), F.when(F.col("s_suppkey") % 7 == 0, ".").otherwise(F.col("s_acctbal").cast("string"))).alias("value"))
    rows.write.text(path)
    s.createDataFrame([("Prose before the table, with | a sign",), ("KEY|NAME|BALANCE",), ("Trailer record count 1",)], "value string").coalesce(1).write.mode("append").text(path)
    return rounded(files.read_delimited(s, path, "KEY|NAME|BALANCE", "|", "s_suppkey long, s_name string, s_acctbal double"))


def _partitioned(s: SparkSession, d: str) -> DataFrame:
    path = files.write_partitioned(weekly_bars(s, d).select("ticker", "sec", "wk", "c"), files.shared(s, "bars"), "sec")
    return rounded(s.read.parquet(path).where("sec = 'Brand#2'").groupBy("ticker", "sec").agg(F.count("wk").alias("n"), F.max_by("c", "wk").alias("last_close")))


def _props(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("p", F.from_json("props", "k long"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"), F.max("p.k").alias("most"))


def _plan(s: SparkSession, d: str) -> DataFrame:
    return rec.fetch_plan(weekly_bars(s, d), F.lit("2001-11-07").cast("date")).select("ticker", "last", "n", F.col("gap").cast("long").alias("gap"), "plan")


def _merge(s: SparkSession, d: str) -> DataFrame:
    bars = weekly_bars(s, d).select("ticker", "wk", "c")
    cached = bars.where("wk < '1999-01-01'").withColumn("source", F.lit("cached"))
    fresh = bars.where("wk >= '1998-01-01'").withColumn("source", F.lit("fresh"))
    return rec.merge_bars(cached, fresh, ["ticker", "wk"]).groupBy("ticker", "source").agg(F.count("wk").alias("n"), F.min("wk").alias("first"), F.max("wk").alias("last"))


def _symbols(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", rec.option_symbol(F.lit("BRND"), F.date_add(F.lit("2024-01-05").cast("date"), (F.col("p_partkey") % 300).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("P"), F.round("p_retailprice")).alias("symbol"))
    return rounded(p.select("p_partkey", "symbol", *rec.parse_option_symbol("symbol")))


QUERIES = {
    "jsonl_store": _jsonl,
    "delimited_with_preamble": _delimited,
    "partitioned_store": _partitioned,
    "json_properties": _props,
    "fetch_plan": _plan,
    "merge_bars": _merge,
    "option_symbols": _symbols,
    "canonical_names": lambda s, d: table(s, d, "supplier").select("s_suppkey", rec.normal_name("s_name").alias("name"), rec.canonical_id("s_name").alias("id")),
    "unpivot_items": lambda s, d: rounded(rec.unpivoted(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "metric", "value")),
    "field_coverage": lambda s, d: rec.field_coverage(table(s, d, "customer")),
}

ORACLE_SQL = {
    "jsonl_store": "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority FROM orders",
    "delimited_with_preamble": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE round(s_acctbal, 6) END AS s_acctbal FROM supplier",
    "partitioned_store": sql("SELECT ticker, sec, count(*) AS n, round(arg_max(c, wk), 6) AS last_close FROM bars WHERE sec = 'Brand#2' GROUP BY ALL"),
    "json_properties": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, TRY_CAST(props ->> 'k' AS BIGINT) AS k FROM events) GROUP BY event_type",
    "fetch_plan": sql(""", t AS (SELECT ticker, max(wk) AS last, count(*) AS n FROM bars GROUP BY ticker),
g AS (SELECT *, (SELECT count(*) FROM generate_series(last + 1, DATE '2001-11-07', INTERVAL 1 DAY) AS s(x) WHERE isodow(x) <= 5) AS gap FROM t)
SELECT ticker, last, n, gap, CASE WHEN n < 30 OR DATE '2001-11-07' - last > 45 THEN 'full' WHEN gap > 0 THEN 'delta' ELSE 'none' END AS plan FROM g"""),
    "merge_bars": sql("""SELECT ticker, CASE WHEN wk < DATE '1999-01-01' THEN 'cached' ELSE 'fresh' END AS source, count(*) AS n, min(wk) AS first, max(wk) AS last FROM bars GROUP BY ALL"""),
    "option_symbols": """WITH s AS (SELECT p_partkey, DATE '2024-01-05' + (p_partkey % 300)::INT AS expiry, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS kind, round(p_retailprice) AS strike FROM part)
SELECT p_partkey, 'BRND' || strftime(expiry, '%y%m%d') || kind || lpad((strike * 1000)::BIGINT::VARCHAR, 8, '0') AS symbol, 'BRND' AS root, expiry, kind, round(strike, 6) AS strike FROM s""",
    "canonical_names": """WITH n AS (SELECT s_suppkey, array_to_string(list_filter(string_split(trim(regexp_replace(upper(coalesce(s_name, '')), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w NOT IN ('INC', 'CORP', 'CO', 'LTD', 'PLC', 'THE')), ' ') AS name FROM supplier)
SELECT s_suppkey, name, substr(sha1(name), 1, 12) AS id FROM n""",
    "unpivot_items": "SELECT l_orderkey, l_linenumber, metric, round(value, 6) AS value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE value)",
    "field_coverage": " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(DISTINCT {c}) AS different FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
}

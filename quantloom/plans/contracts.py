"""Queries that hold tables against contracts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts
from ..sources.panels import market, sql, table, weekly_bars, weekly_returns
from .time_series import rounded

DECLARED = {"key": True, "owner": True, "total": False, "phantom": False}
INF = float("inf")


def _audit(s: SparkSession, d: str) -> DataFrame:
    """Orders as JSON records: the owner is missing in some, a field was never declared, one was never sent, some are broken."""
    k = F.col("o_orderkey")
    doc = F.to_json(F.struct(k.alias("key"), F.when(k % 9 != 0, F.col("o_custkey")).alias("owner"), F.when(k % 4 == 0, F.col("o_totalprice")).alias("total"), F.when(k % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(k % 10 == 0, F.lit(1)).alias("rare")))
    return contracts.field_audit(table(s, d, "orders").select(F.when(k % 50 == 7, '{"key": 1').otherwise(doc).alias("json")), "json", DECLARED)


def _tags(s: SparkSession, d: str, flag: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), "p_type")
    i = table(s, d, "lineitem").where(F.col("l_returnflag") == flag).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return i.groupBy("brand").agg(F.collect_set(F.element_at(F.split("p_type", " "), -1)).alias("tags"))


def _merged(s: SparkSession, d: str) -> DataFrame:
    return contracts.merge_tags(_tags(s, d, "R"), _tags(s, d, "A"), "brand", "tags").withColumn("tags", F.array_join("tags", ","))


def _paths(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "lineitem")
    odd = F.when(F.col("l_discount") == 0, INF).when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax"))
    return contracts.non_finite(i.select("l_quantity", F.struct(odd.alias("rate"), "l_comment" if "l_comment" in i.columns else F.lit("x").alias("note")).alias("deal"), F.array(odd, F.when(F.col("l_linenumber") == 1, -INF)).alias("path"), F.create_map(F.lit("a"), F.struct(F.array(F.col("l_tax"), odd).alias("w"))).alias("book")))


def _sanitized(s: SparkSession, d: str) -> DataFrame:
    t = weekly_returns(weekly_bars(s, d)).select("ticker", "wk", F.when(F.col("i") == 1, INF).otherwise(F.col("r")).alias("r"), (F.col("h") / F.col("l")).alias("spread"), "v")
    return rounded(contracts.sanitized(t, {"r": (-0.9, 3.0), "spread": (None, 40.0), "v": (20.0, None)}))


def _bands(s: SparkSession, d: str) -> DataFrame:
    t = weekly_bars(s, d)
    return rounded(t.select("ticker", "wk", contracts.crossed_bands(t, "l", "o", "c", "h").alias("crossed")).where("crossed is not null"))


def _universe(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select(F.when(F.col("p_partkey") % 97 != 0, F.concat(F.col("p_name"), F.col("p_size"))).alias("name"), F.substring("p_brand", 1, 7).alias("sec"))
    return contracts.universe_checks(p, table(s, d, "lineitem").select("l_partkey").distinct(), "name", "sec", ["Brand#1", "Brand#2"])


def _drivers(s: SparkSession, d: str) -> DataFrame:
    r = weekly_returns(weekly_bars(s, d)).where("lr is not null")
    f = r.groupBy("wk", F.col("sec").alias("factor")).agg(F.avg("lr").alias("f")).unionByName(market(r).select("wk", F.lit("MKT").alias("factor"), F.col("m").alias("f")))
    t = contracts.sparse_drivers(r.join(f, "wk").groupBy("ticker", "factor").agg(F.regr_slope("lr", "f").alias("beta")), "ticker", "factor", "beta")
    return rounded(t.select("ticker", F.array_join(F.sort_array(F.map_keys("drivers")), ",").alias("kept"), "dominant", "dominant_beta"))


def _counts(s: SparkSession, d: str) -> DataFrame:
    return contracts.tag_counts(table(s, d, "part").select(F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("tags")), "tags")


QUERIES = {
    "field_audit": _audit,
    "tag_union": _merged,
    "common_weeks": lambda s, d: contracts.common_dates(weekly_bars(s, d), "ticker", "wk"),
    "first_seen": lambda s, d: contracts.first_seen(table(s, d, "lineitem"), "l_partkey", "l_orderkey", "l_linenumber"),
    "duplicate_keys": lambda s, d: contracts.duplicate_keys(table(s, d, "lineitem"), "l_orderkey", "l_suppkey"),
    "non_finite_paths": _paths,
    "sanitized_bounds": _sanitized,
    "crossed_bands": _bands,
    "provenance_digest": lambda s, d: contracts.provenance(weekly_bars(s, d), "ticker", "wk", "c"),
    "universe_checks": _universe,
    "sparse_drivers": _drivers,
    "tag_counts": _counts,
}

_odd = "CASE WHEN l_discount = 0 THEN 1 WHEN l_tax = 0 THEN 1 ELSE 0 END"
ORACLE_SQL = {
    "field_audit": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 50 = 7 AS broken, o_custkey AS c, o_totalprice AS t, o_orderstatus AS s FROM orders), n AS (SELECT count(*) AS n FROM o),
c AS (SELECT 'key' AS field, true AS declared, true AS required, count(k) FILTER (WHERE NOT broken) AS seen FROM o UNION ALL SELECT 'owner', true, true, count(c) FILTER (WHERE NOT broken AND k % 9 <> 0) FROM o UNION ALL SELECT 'total', true, false, count(t) FILTER (WHERE NOT broken AND k % 4 = 0) FROM o
UNION ALL SELECT 'phantom', true, false, 0 UNION ALL SELECT 'status', false, false, count(s) FILTER (WHERE NOT broken AND k % 3 <> 0) FROM o UNION ALL SELECT 'rare', false, false, count(*) FILTER (WHERE NOT broken AND k % 10 = 0) FROM o)
SELECT field, declared, required, seen, n AS records, CASE WHEN NOT declared THEN 'undeclared' WHEN required AND seen < n THEN 'missing' WHEN seen = 0 THEN 'never emitted' ELSE 'ok' END AS verdict FROM c, n WHERE declared OR seen >= greatest(1, floor(n / 2))""",
    "tag_union": "SELECT p_brand AS brand, string_agg(DISTINCT split_part(p_type, ' ', -1), ',' ORDER BY split_part(p_type, ' ', -1)) AS tags FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'A') GROUP BY p_brand",
    "common_weeks": sql("SELECT wk FROM bars GROUP BY wk HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars)"),
    "first_seen": "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1",
    "duplicate_keys": "SELECT l_orderkey, l_suppkey, count(*) AS rows, 'repeated' AS fault FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1",
    "non_finite_paths": f"""WITH x AS (SELECT {_odd} AS f, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS g FROM lineitem), s AS (SELECT sum(f)::BIGINT AS f, sum(f + g)::BIGINT AS fg, count(*) FILTER (WHERE f + g > 0) AS r FROM x)
SELECT 'l_quantity' AS path, 0::BIGINT AS rows, 0::BIGINT AS numbers UNION ALL SELECT 'deal.rate', f, f FROM s UNION ALL SELECT 'path[]', r, fg FROM s UNION ALL SELECT 'book{{}}.w[]', f, f FROM s""",
    "sanitized_bounds": sql(""", t AS (SELECT ticker, wk, i = 1 OR r < -0.9 OR r > 3 AS a, r, h / l > 40 AS b, h / l AS s, v < 20 AS c, v FROM ret)
SELECT ticker, wk, round(CASE WHEN NOT a THEN r END, 6) + 0.0 AS r, round(CASE WHEN NOT b THEN s END, 6) AS spread, round(CASE WHEN NOT c THEN v END, 6) AS v, a::INT + b::INT + c::INT AS nulled FROM t"""),
    "crossed_bands": sql("SELECT ticker, wk, CASE WHEN l > o THEN 'l>o' WHEN o > c THEN 'o>c' ELSE 'c>h' END AS crossed FROM bars WHERE l > o OR o > c OR c > h"),
    "provenance_digest": sql(""", k AS (SELECT sha256(ticker || ':' || string_agg(CAST(round(c * 10000) AS BIGINT)::VARCHAR, ',' ORDER BY wk)) AS d FROM bars GROUP BY ticker), b AS (SELECT substr(d, 1, 2) AS b, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS d FROM k GROUP BY substr(d, 1, 2))
SELECT sum(n)::BIGINT AS series, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM b"""),
    "universe_checks": """WITH p AS (SELECT CASE WHEN p_partkey % 97 <> 0 THEN p_name || p_size END AS name, substr(p_brand, 1, 7) IN ('Brand#1', 'Brand#2') AS known FROM part), g AS (SELECT name, count(*) AS n FROM p GROUP BY name),
o AS (SELECT count(*) AS a, count(*) FILTER (WHERE name IS NULL) AS m, (SELECT count(*) FROM g WHERE name IS NOT NULL AND n > 1) AS r, count(*) FILTER (WHERE known) AS k, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS t FROM p)
SELECT 'too few names' AS "check", a AS value, a >= 30 AS ok FROM o UNION ALL SELECT 'missing keys', m, m = 0 FROM o UNION ALL SELECT 'repeated keys', r, r = 0 FROM o UNION ALL SELECT 'known sectors', k, a < 80 OR k >= 50 FROM o UNION ALL SELECT 'names lost', greatest(t - a, 0), t = 0 OR a >= 0.7 * t FROM o""",
    "sparse_drivers": sql(""", f AS (SELECT wk, sec AS factor, avg(lr) AS f FROM ret WHERE lr IS NOT NULL GROUP BY wk, sec UNION ALL SELECT wk, 'MKT', avg(r) FROM ret WHERE r IS NOT NULL GROUP BY wk),
b AS (SELECT ticker, factor, regr_slope(lr, f) AS beta FROM ret JOIN f USING (wk) WHERE lr IS NOT NULL GROUP BY ticker, factor)
SELECT ticker, string_agg(factor, ',' ORDER BY factor) FILTER (WHERE abs(beta) >= 0.05) AS kept, arg_max(factor, abs(beta)) AS dominant, round(arg_max(beta, abs(beta)), 6) AS dominant_beta FROM b GROUP BY ticker"""),
    "tag_counts": "WITH t AS (SELECT unnest(list_distinct(string_split(p_name || ' ' || p_type, ' '))) AS tag FROM part) SELECT tag, count(*) AS rows FROM t GROUP BY tag",
}

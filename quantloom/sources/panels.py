"""Panels of bars over the reference tables: brands are assets, weeks are bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ticker, sec, wk, o, h, l, c, v``: the close is the volume-weighted price of the week."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    return (
        items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("ticker", F.to_date(F.date_trunc("week", "l_shipdate")).alias("wk"))
        .agg(
            F.min_by("p", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("o"), F.max("p").alias("h"), F.min("p").alias("l"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("c"), F.sum("l_quantity").alias("v"),
        ).select("ticker", F.substring("ticker", 1, 7).alias("sec"), "wk", "o", "h", "l", "c", "v")
    )


def by_week() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("wk")


def weekly_returns(bars: DataFrame) -> DataFrame:
    """Bars with the simple return ``r`` and the log return ``lr`` of each but the first, and the place ``i`` of the bar."""
    before = F.lag("c").over(by_week())
    return bars.select("*", F.row_number().over(by_week()).alias("i"), (F.col("c") / before - 1).alias("r"), F.ln(F.col("c") / before).alias("lr"))


def market(returns: DataFrame) -> DataFrame:
    """``wk, m``: the equal-weight mean return of the week."""
    return returns.where("r is not null").groupBy("wk").agg(F.avg("r").alias("m"))


#: The same panels for DuckDB, as common table expressions.
BARS_SQL = """bars AS (
  SELECT p_brand AS ticker, substr(p_brand, 1, 7) AS sec, CAST(date_trunc('week', l_shipdate) AS DATE) AS wk,
         arg_min(l_extendedprice / l_quantity, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber}) AS o, max(l_extendedprice / l_quantity) AS h, min(l_extendedprice / l_quantity) AS l,
         sum(l_extendedprice) / sum(l_quantity) AS c, sum(l_quantity) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
ret AS (SELECT *, row_number() OVER w AS i, c / lag(c) OVER w - 1 AS r, ln(c / lag(c) OVER w) AS lr FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY wk)),
mkt AS (SELECT wk, avg(r) AS m FROM ret WHERE r IS NOT NULL GROUP BY wk)"""


def sql(body: str) -> str:
    return f"WITH {BARS_SQL}{body if body.lstrip()[:1] == ',' else ' ' + body}"

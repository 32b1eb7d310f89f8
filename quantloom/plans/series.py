"""Queries of rules over one asset's series, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from ..sources.panels import sql, weekly_bars, weekly_returns
from .time_series import rounded


def _on_bars(f):
    return lambda s, d: rounded(f(weekly_bars(s, d)))


def _total(s: SparkSession, d: str) -> DataFrame:
    bars = weekly_bars(s, d)
    cash = bars.where("month(wk) % 3 = 0 and day(wk) <= 7").select("ticker", "wk", (F.col("c") * 0.01).alias("cash"))
    return rounded(series.total_return(bars, cash.unionByName(cash)), 5)


def _runs(s: SparkSession, d: str) -> DataFrame:
    r = weekly_returns(weekly_bars(s, d)).select("ticker", "wk", F.when(F.col("r") > 0, "up").when(F.col("r") <= 0, "down").alias("state"))
    return rounded(series.runs(r, "ticker", "wk", "state"))


def _ups(s: SparkSession, d: str) -> DataFrame:
    return weekly_returns(weekly_bars(s, d)).select("ticker", "wk", (F.col("r") > 0).alias("up"))


QUERIES = {
    "reversion_fit": _on_bars(series.reversion),
    "price_velocity": _on_bars(series.velocity),
    "drawdown_episodes": _on_bars(lambda b: series.falls(b).withColumn("bars", F.col("bars").cast("double"))),
    "total_return_index": _total,
    "trend_state": _on_bars(series.trend),
    "run_lengths": _runs,
    "trailing_runs": lambda s, d: series.trailing(_ups(s, d), "ticker", "wk", "up"),
}

_mean = lambda k: f"sum(p * CASE WHEN age = n - 1 THEN 1 ELSE {2 / 22!r}::DOUBLE END * pow({1 - 2 / 22!r}::DOUBLE, age - {k})) FILTER (WHERE age >= {k}) AS e{k}"
ORACLE_SQL = {
    "reversion_fit": sql(""", t AS (SELECT ticker, wk, ln(c) AS y, lag(ln(c)) OVER (PARTITION BY ticker ORDER BY wk) AS x FROM bars), l AS (SELECT ticker, arg_max(y, wk) AS last FROM t GROUP BY ticker),
g AS (SELECT ticker, count(*) AS m, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) AS s2 FROM t WHERE x IS NOT NULL GROUP BY ticker HAVING count(*) >= 29),
p AS (SELECT *, least(greatest(b, -0.9999), 0.9999) AS phi, sqrt(s2 / sxx) AS se FROM g JOIN l USING (ticker)), q AS (SELECT *, CASE WHEN phi > 0 THEN -ln(phi) ELSE 'inf'::DOUBLE END AS speed, a / (1 - phi) AS mu, sqrt(s2 / (1 - phi * phi)) AS sp FROM p)
SELECT ticker, round(phi, 6) + 0.0 AS phi, round(se, 6) AS se, round(speed, 6) AS speed, round(exp(mu), 6) AS mean_price, round(CASE WHEN phi > 0 THEN ln(2) / speed END, 6) AS half_life, 1 - phi > 1.96 * se AS reverts, round((last - mu) / sp, 6) + 0.0 AS z,
round((mu - last) * (1 - exp(-speed)), 6) + 0.0 AS drift_1, round((mu - last) * (1 - exp(-speed * 5)), 6) + 0.0 AS drift_5, round((mu - last) * (1 - exp(-speed * 21)), 6) + 0.0 AS drift_21 FROM q"""),
    "price_velocity": sql(f""", t AS (SELECT ticker, ln(c) AS p, lr, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) - 1 AS age, count(*) OVER (PARTITION BY ticker) AS n FROM ret),
g AS (SELECT ticker, any_value(n) AS n, {', '.join(_mean(k) for k in range(3))}, stddev_samp(lr) FILTER (WHERE age < 60) AS sd FROM t GROUP BY ticker)
SELECT ticker, round(CASE WHEN n >= 26 THEN (e0 - e1) / sd END, 6) + 0.0 AS velocity, round(CASE WHEN n >= 26 THEN (e0 - 2 * e1 + e2) / sd END, 6) + 0.0 AS acceleration FROM g"""),
    "drawdown_episodes": sql(""", t AS (SELECT ticker, wk, i, c / max(c) OVER (PARTITION BY ticker ORDER BY wk) - 1 AS d FROM ret), u AS (SELECT *, count(*) FILTER (WHERE d >= 0) OVER (PARTITION BY ticker ORDER BY wk) AS k FROM t),
e AS (SELECT ticker, k, min(wk) AS start, arg_min(wk, (d, wk)) AS trough, min(d) AS depth, arg_min(i, (d, wk)) AS low FROM u WHERE d < 0 GROUP BY ticker, k), r AS (SELECT ticker, k, wk, i FROM u WHERE d >= 0)
SELECT e.ticker, start, trough, round(depth, 6) + 0.0 AS depth, r.wk AS recovery, (r.i - low)::DOUBLE AS bars FROM e LEFT JOIN r ON r.ticker = e.ticker AND r.k = e.k + 1"""),
    "total_return_index": sql(""", t AS (SELECT *, ln(c * CASE WHEN month(wk) % 3 = 0 AND day(wk) <= 7 THEN 1.02::DOUBLE ELSE 1 END / lag(c) OVER (PARTITION BY ticker ORDER BY wk)) AS g FROM bars)
SELECT ticker, wk, round(100 * exp(coalesce(sum(g) OVER w, 0)), 5) AS total_index, round(100 * c / first(c) OVER w, 5) AS price_index FROM t WINDOW w AS (PARTITION BY ticker ORDER BY wk)"""),
    "trend_state": sql(""", t AS (SELECT ticker, c, lr, abs(c - lag(c) OVER (PARTITION BY ticker ORDER BY wk)) AS step, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) - 1 AS age FROM ret),
g AS (SELECT ticker, count(*) AS n, abs(max(c) FILTER (WHERE age = 0) - max(c) FILTER (WHERE age = 10)) / sum(step) FILTER (WHERE age < 10) AS e, sum(lr * pow(0.85, age)) / sum(pow(0.85, age)) FILTER (WHERE lr IS NOT NULL) AS d, stddev_samp(lr) FILTER (WHERE age < 9) AS s, stddev_samp(lr) FILTER (WHERE age < 41) AS l FROM t GROUP BY ticker)
SELECT ticker, round(CASE WHEN n > 10 THEN e ELSE 0 END, 6) AS efficiency, round(d, 6) + 0.0 AS drift, round(round(CASE WHEN n >= 42 THEN 1 / (1 + exp(-(abs(ln(s / l)) - 0.4) / 0.25)) END, 2), 6) AS flip FROM g"""),
    "run_lengths": sql(""", t AS (SELECT ticker, wk, i, CASE WHEN r > 0 THEN 'up' ELSE 'down' END AS state FROM ret WHERE r IS NOT NULL), u AS (SELECT *, i - row_number() OVER (PARTITION BY ticker, state ORDER BY wk) AS g, max(i) OVER (PARTITION BY ticker) AS most FROM t),
v AS (SELECT ticker, state, count(*) AS n, max(i) = any_value(most) AS now FROM u GROUP BY ticker, state, g)
SELECT ticker, state, count(*) AS runs, round(avg(n), 6) AS mean_length, max(n) AS longest, coalesce(max(n) FILTER (WHERE now), 0) AS current FROM v GROUP BY ticker, state"""),
    "trailing_runs": sql(""", t AS (SELECT ticker, wk, i, r > 0 AS up, max(CASE WHEN r > 0 THEN 0 ELSE i END) OVER (PARTITION BY ticker ORDER BY wk) AS broke FROM ret) SELECT ticker, wk, up, i - broke AS run FROM t"""),
}

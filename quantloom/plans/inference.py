"""Queries of inference, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import phi_sql
from ..operators import inference as inf
from ..operators.calibration import black_scholes
from ..sources.panels import market, sql, table, weekly_bars, weekly_returns
from .calibration import _CHAIN, chain
from .cross_section import _DEP, drivers
from .time_series import rounded


def _returns(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ret = weekly_returns(weekly_bars(s, d))
    return ret, market(ret)


def _events(s: SparkSession, d: str) -> DataFrame:
    ret, mkt = _returns(s, d)
    at = ret.select("ticker").distinct().select("ticker", F.lit(100).alias("i")).unionByName(ret.select("ticker").distinct().select("ticker", F.lit(200).alias("i")))
    return rounded(inf.event_study(ret, mkt, at)).withColumnRenamed("at", "place")


def _calls(s: SparkSession, d: str) -> DataFrame:
    return black_scholes(chain(s, d)).where("kind = 'C'").groupBy("k").agg(F.max("price").alias("price"))


QUERIES = {
    "mean_newey_west": lambda s, d: rounded(inf.mean_hac(_returns(s, d)[0])),
    "slope_newey_west": lambda s, d: rounded(inf.slope_hac(*_returns(s, d))),
    "event_study_car": _events,
    "tail_dependence": lambda s, d: rounded(inf.tail_dependence(*_returns(s, d))),
    "probabilistic_sharpe": lambda s, d: rounded(inf.probabilistic_sharpe(_returns(s, d)[0])),
    "evt_gpd_tail": lambda s, d: rounded(inf.peaks_over_threshold(_returns(s, d)[0])),
    "factor_covariance": lambda s, d: rounded(inf.ewma_covariance(drivers(s, d))),
    "har_features": lambda s, d: rounded(inf.har_features(_returns(s, d)[0])),
    "no_arbitrage": lambda s, d: rounded(inf.no_arbitrage(_calls(s, d))),
    "session_bars": lambda s, d: rounded(inf.session_bars(table(s, d, "events"))),
    "minutes_momentum": lambda s, d: rounded(inf.minutes_momentum(table(s, d, "events")).withColumn("near", F.col("near") + 1e-10)),  # off the ties of short means
}

_lags = lambda c, n=4: ", ".join(f"lag({c}, {k}) OVER (PARTITION BY ticker ORDER BY wk) AS {c}{k}" for k in range(1, n + 1))
_bartlett = lambda c, over="", n=4: f"sum({c} * {c}){over}" + "".join(f" + 2 * {1 - k / (n + 1)}::DOUBLE * coalesce(sum({c} * {c}{k}), 0){over}" for k in range(1, n + 1))
ORACLE_SQL = {
    "mean_newey_west": sql(f""", u AS (SELECT ticker, wk, r, r - avg(r) OVER (PARTITION BY ticker) AS u FROM ret WHERE r IS NOT NULL), l AS (SELECT *, {_lags('u')} FROM u), s AS (SELECT ticker, avg(r) AS mean, sqrt(greatest({_bartlett('u', ' / count(r)')}, 0) / count(r)) AS se FROM l GROUP BY ticker)
SELECT ticker, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / nullif(se, 0), 6) AS t FROM s"""),
    "slope_newey_west": sql(f""", f AS (SELECT ticker, regr_slope(r, m) AS b, regr_intercept(r, m) AS a, avg(m) AS mm, regr_sxx(r, m) AS xx FROM ret JOIN mkt USING (wk) WHERE r IS NOT NULL GROUP BY ticker),
s AS (SELECT ticker, wk, b, xx, (m - mm) * (r - a - b * m) AS s FROM ret JOIN mkt USING (wk) JOIN f USING (ticker) WHERE r IS NOT NULL), l AS (SELECT *, {_lags('s')} FROM s) SELECT ticker, round(b, 6) AS slope, round(sqrt(greatest({_bartlett('s')}, 0)) / xx, 6) AS se FROM l GROUP BY ticker, b, xx"""),
    "event_study_car": sql(""", e AS (SELECT DISTINCT ticker, p AS place FROM ret, (VALUES (100), (200)) AS v(p)), j AS (SELECT ticker, place, i - place AS k, r, m FROM ret JOIN mkt USING (wk) JOIN e USING (ticker) WHERE r IS NOT NULL),
b AS (SELECT ticker, place, regr_slope(r, m) AS b, regr_intercept(r, m) AS a, sqrt(greatest(regr_syy(r, m) - pow(regr_sxy(r, m), 2) / regr_sxx(r, m), 0) / (count(r) - 2)) AS s FROM j WHERE k BETWEEN -60 AND -6 GROUP BY ALL HAVING count(r) >= 20)
SELECT ticker, place, round(sum(r - a - b * m), 6) AS car, round(sum(r - a - b * m) / (any_value(s) * sqrt(count(r))), 6) AS scar, count(r) AS weeks FROM j JOIN b USING (ticker, place) WHERE abs(k) <= 5 GROUP BY ALL"""),
    "tail_dependence": sql(""", t AS (SELECT ticker, count(r) OVER w AS n, row_number() OVER (PARTITION BY ticker ORDER BY r, wk) AS kr, row_number() OVER (PARTITION BY ticker ORDER BY m, wk) AS km FROM ret JOIN mkt USING (wk) WHERE r IS NOT NULL WINDOW w AS (PARTITION BY ticker)), k AS (SELECT *, floor(0.1 * n) AS k FROM t)
SELECT ticker, round(count(*) FILTER (WHERE kr <= k AND km <= k) / max(k), 6) AS lower, round(count(*) FILTER (WHERE kr > n - k AND km > n - k) / max(k), 6) AS upper FROM k WHERE k > 0 GROUP BY ticker"""),
    "probabilistic_sharpe": sql(f""", s AS (SELECT ticker, avg(r) / stddev_samp(r) AS sr, count(r) AS n, avg(pow((r - mu) / sd, 3)) AS g3, avg(pow((r - mu) / sd, 4)) AS g4 FROM (SELECT ticker, r, avg(r) OVER (PARTITION BY ticker) AS mu, stddev_pop(r) OVER (PARTITION BY ticker) AS sd FROM ret WHERE r IS NOT NULL) GROUP BY ticker),
z AS (SELECT ticker, sr, sr * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr) AS z FROM s) SELECT ticker, round(sr, 6) AS sr, round({phi_sql('z')}, 6) AS psr FROM z"""),
    "evt_gpd_tail": sql(""", t AS (SELECT ticker, -r AS x, row_number() OVER (PARTITION BY ticker ORDER BY r, wk) AS k, count(r) OVER (PARTITION BY ticker) AS n FROM ret WHERE r IS NOT NULL), u AS (SELECT *, max(CASE WHEN k = floor(0.1 * n) + 1 THEN x END) OVER (PARTITION BY ticker) AS u FROM t),
e AS (SELECT ticker, u, n, avg(x - u) AS m, var_samp(x - u) AS v, count(x) AS ne FROM u WHERE k <= floor(0.1 * n) GROUP BY ticker, u, n), p AS (SELECT *, 0.5 * (1 - m * m / v) AS xi FROM e WHERE v > 0), q AS (SELECT *, m * (1 - xi) AS beta FROM p),
w AS (SELECT *, u + CASE WHEN abs(xi) > 1e-9 THEN beta / xi * (pow(n::DOUBLE / ne * 0.01, -xi) - 1) ELSE -beta * ln(n::DOUBLE / ne * 0.01) END AS var99 FROM q)
SELECT ticker, round(u, 6) AS u, round(xi, 6) AS xi, round(beta, 6) AS beta, round(var99, 6) AS var99, round(CASE WHEN xi < 1 THEN (var99 + beta - xi * u) / (1 - xi) END, 6) AS es99 FROM w"""),
    "factor_covariance": sql(_DEP.split("pc AS")[0].rstrip().rstrip(",") + """, x AS (SELECT driver, wk, f - avg(f) OVER (PARTITION BY driver) AS x, row_number() OVER (PARTITION BY driver ORDER BY wk DESC) - 1 AS age FROM drv WHERE f IS NOT NULL)
SELECT a.driver AS a, b.driver AS b, round(sum(pow(0.94, a.age) * a.x * b.x) / sum(pow(0.94, a.age)), 6) AS cov FROM x a JOIN x b ON a.wk = b.wk AND a.driver <= b.driver GROUP BY ALL"""),
    "har_features": sql(", h AS (SELECT ticker, lr * lr AS v, row_number() OVER (PARTITION BY ticker ORDER BY wk) AS k, " + ", ".join(f"avg(lr * lr) OVER (PARTITION BY ticker ORDER BY wk ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS {c}" for c, n in (("d", 1), ("w", 5), ("m", 22)))
        + " FROM ret WHERE lr IS NOT NULL) SELECT ticker, round(regr_slope(v, d), 6) AS slope_d, round(regr_slope(v, w), 6) AS slope_w, round(regr_slope(v, m), 6) AS slope_m, round(regr_r2(v, m), 6) AS r2_m, count(v) AS n FROM h WHERE k > 22 GROUP BY ticker"),
    "no_arbitrage": _CHAIN + f""", c AS (SELECT k, max(s * {phi_sql('d1')} - k * fade * {phi_sql('d2')}) AS price FROM de WHERE kind = 'C' GROUP BY k), t AS (SELECT k, price, lag(k) OVER w AS pk, lag(price) OVER w AS pp, lead(k) OVER w AS nk, lead(price) OVER w AS np FROM c WINDOW w AS (ORDER BY k))
SELECT count(*) AS strikes, count(*) FILTER (WHERE price > pp + 1e-9) AS not_falling, count(*) FILTER (WHERE (price - pp) / (k - pk) > (np - price) / (nk - k) + 1e-9) AS not_convex FROM t""",
    "session_bars": """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""",
    "minutes_momentum": """WITH t AS (SELECT event_id, event_type, epoch_us(ts) AS us, value FROM events), w AS (SELECT event_id, avg(value) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW) AS near,
avg(value) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 43200000001 PRECEDING) AS far FROM t) SELECT event_id, round(near + 1e-10, 6) AS near, round(far, 6) AS far, round(near / nullif(far, 0), 6) AS momentum FROM w""",
}

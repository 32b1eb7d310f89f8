"""Queries of calibration by horizon and regime, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import phi_sql
from ..operators import walk_forward as wf
from ..sources.panels import by_week, sql, weekly_bars, weekly_returns
from .time_series import rounded

STEPS = (1, 4, 8)


def _panel(s: SparkSession, d: str) -> DataFrame:
    """Weekly returns; the regime is the sign of the 13 weeks before."""
    before = F.sum("lr").over(by_week().rowsBetween(-13, -1))
    return weekly_returns(weekly_bars(s, d)).select("ticker", "wk", "lr", F.when(before >= 0, "up").when(before < 0, "down").alias("regime"))


QUERIES = {
    "horizon_calibration": lambda s, d: rounded(wf.calibrate_horizons(_panel(s, d), "ticker", "wk", "lr", "regime", STEPS)),
    "regime_calibration": lambda s, d: rounded(wf.regime_quantiles(_panel(s, d), "ticker", "wk", "lr", "regime", STEPS)),
}


def _ahead(n: int) -> str:
    return f"SELECT *, {n} AS steps, sum(lr) OVER (PARTITION BY ticker ORDER BY wk ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS y FROM pb"


_SAMPLES = f""", pa AS (SELECT ticker, wk, lr, CASE WHEN s13 >= 0 THEN 'up' WHEN s13 < 0 THEN 'down' END AS regime FROM (SELECT ticker, wk, lr, sum(lr) OVER (PARTITION BY ticker ORDER BY wk ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING) AS s13 FROM ret)),
pb AS (SELECT ticker, wk, lr, regime, row_number() OVER w - 27 AS j, count(*) OVER (PARTITION BY ticker) AS t, avg(lr) OVER b AS mean, var_samp(lr) OVER b AS v FROM pa WHERE lr IS NOT NULL
  WINDOW w AS (PARTITION BY ticker ORDER BY wk), b AS (PARTITION BY ticker ORDER BY wk ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)),
pc AS ({" UNION ALL ".join(map(_ahead, STEPS))}),
pd AS (SELECT *, t - steps - 25 AS m, CAST(floor((t - steps - 25) * 0.6::DOUBLE) AS BIGINT) AS cut FROM pc WHERE j >= 0),
pe AS (SELECT ticker, steps, regime, sqrt(greatest(steps * v, 1e-12)) AS sigma, (y - steps * mean) / sqrt(greatest(steps * v, 1e-12)) AS e, CASE WHEN j < cut - steps THEN 'cal' WHEN j >= cut + steps THEN 'test' END AS fold
  FROM pd WHERE j < m AND t >= 46 + 3 * steps AND m >= 30 AND cut - steps >= 15 AND m - cut - steps >= 15),
cal AS (SELECT * FROM pe WHERE fold = 'cal'), test AS (SELECT * FROM pe WHERE fold = 'test'),
q AS (SELECT ticker, steps, len(x) AS n_cal, x[greatest(1, floor(0.05::DOUBLE * (len(x) + 1)))::INT] AS q_lo, x[least(len(x), ceil(0.95::DOUBLE * (len(x) + 1)))::INT] AS q_hi, a[least(len(a), ceil(0.9::DOUBLE * (len(a) + 1)))::INT] AS q_sym
  FROM (SELECT ticker, steps, list(e ORDER BY e) AS x, list(abs(e) ORDER BY abs(e)) AS a FROM cal GROUP BY ALL)),
own AS (SELECT ticker, steps, regime, len(x) AS n_cal, x[greatest(1, floor(0.05::DOUBLE * (len(x) + 1)))::INT] AS q_lo, x[least(len(x), ceil(0.95::DOUBLE * (len(x) + 1)))::INT] AS q_hi
  FROM (SELECT ticker, steps, regime, list(e ORDER BY e) AS x FROM cal WHERE regime IS NOT NULL GROUP BY ALL) WHERE len(x) >= 20)"""
_Z2 = wf.Z95**2
_SHARE = "avg(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0 END)".format
ORACLE_SQL = {
    "horizon_calibration": sql(_SAMPLES + f""", r AS (SELECT x.*, {phi_sql('x.e')} AS u, count(*) OVER (PARTITION BY x.ticker, x.steps) AS n, q.n_cal, q.q_lo, q.q_hi, q.q_sym, coalesce(own.q_lo, q.q_lo) AS o_lo, coalesce(own.q_hi, q.q_hi) AS o_hi
  FROM test x JOIN q USING (ticker, steps) LEFT JOIN own ON own.ticker = x.ticker AND own.steps = x.steps AND own.regime = x.regime),
k AS (SELECT *, row_number() OVER (PARTITION BY ticker, steps ORDER BY u) AS i FROM r),
g AS (SELECT ticker, steps, n, n_cal, q_lo, q_hi, q_sym, {_SHARE('e >= q_lo AND e <= q_hi')} AS coverage, {_SHARE(f'abs(e) <= {wf.Z90}::DOUBLE')} AS cn, {_SHARE('abs(e) <= q_sym')} AS cs, {_SHARE('e >= o_lo AND e <= o_hi')} AS cr,
  avg(sigma * (e * (2 * u - 1) + 2 * exp(-e * e / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))) AS crps, avg(sigma * ((q_hi - q_lo) + 20 * (greatest(q_lo - e, 0) + greatest(e - q_hi, 0)))) AS isc, avg(sigma * (q_hi - q_lo)) AS width,
  max(greatest(abs(i / n - u), abs(u - (i - 1) / n))) AS ks FROM k GROUP BY ALL),
h AS (SELECT *, (coverage + {_Z2}::DOUBLE / (2 * n)) / (1 + {_Z2}::DOUBLE / n) AS mid, {wf.Z95}::DOUBLE * sqrt(coverage * (1 - coverage) / n + {_Z2}::DOUBLE / (4 * n * n)) / (1 + {_Z2}::DOUBLE / n) AS half, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * ks AS lam FROM g)
SELECT ticker, steps, n, n_cal, round(q_lo, 6) AS q_lo, round(q_hi, 6) AS q_hi, round(q_sym - {wf.Z90}::DOUBLE, 6) AS pad, round(coverage, 6) AS coverage, round(greatest(mid - half, 0), 6) AS wilson_lo, round(least(mid + half, 1), 6) AS wilson_hi,
round(cn, 6) AS coverage_normal, round(cs, 6) AS coverage_symmetric, round(cr, 6) AS coverage_regime, round(crps, 6) AS crps, round(isc, 6) AS interval_score, round(width, 6) AS width, round(ks, 6) AS ks,
round(least(greatest(2 * list_sum(list_transform(range(1, 50), lambda x: (CASE WHEN x % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * x * x * lam * lam))), 0), 1), 6) + 0.0 AS ks_p, round(sqrt(ln(40.0::DOUBLE) / (2 * n)), 6) AS dkw,
0.9 BETWEEN mid - half AND mid + half AS calibrated, abs(coverage - 0.9::DOUBLE) <= 0.05 AS within_tolerance FROM h"""),
    "regime_calibration": sql(_SAMPLES + f"""
SELECT own.ticker, own.steps, own.regime, own.n_cal, round(own.q_lo, 6) AS q_lo, round(own.q_hi, 6) AS q_hi, count(x.e) AS n, round(avg(CASE WHEN x.e IS NOT NULL THEN CASE WHEN x.e BETWEEN own.q_lo AND own.q_hi THEN 1.0 ELSE 0.0 END END), 6) AS coverage,
round(avg(CASE WHEN x.e IS NOT NULL THEN CASE WHEN x.e BETWEEN q.q_lo AND q.q_hi THEN 1.0 ELSE 0.0 END END), 6) AS coverage_pooled
FROM own JOIN q USING (ticker, steps) LEFT JOIN test x ON x.ticker = own.ticker AND x.steps = own.steps AND x.regime = own.regime GROUP BY own.ticker, own.steps, own.regime, own.n_cal, own.q_lo, own.q_hi"""),
}

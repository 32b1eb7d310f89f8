"""Queries of significance tests, and their SQL."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import density, phi_sql
from ..operators import calibration as cal
from ..operators import significance as sig
from ..sources.panels import market, sql, weekly_bars, weekly_returns
from .calibration import _CHAIN, _F, chain
from .time_series import rounded


def _returns(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ret = weekly_returns(weekly_bars(s, d))
    return ret, market(ret)


def _losses(s: SparkSession, d: str) -> DataFrame:
    """Squared errors of the mean of the weeks before, and of no change."""
    return cal.forecasts(_returns(s, d)[0]).select("ticker", "wk", F.pow(F.col("y") - F.col("mu"), F.lit(2)).alias("a"), F.pow("y", F.lit(2)).alias("b"))


def _implied(s: SparkSession, d: str) -> DataFrame:
    """Volatilities back from the chain's own prices, where the price tells them (vega of 0.05 a point at least); two of seven quotes
    are put beyond the bounds that arbitrage sets, above and below."""
    c = chain(s, d)
    quotes = c.withColumn("price", cal.black_scholes_price(F.col("s"), F.col("k"), F.col("t"), F.col("sigma"), F.col("kind") == "C", 0.04))
    side, fade = F.when(F.col("kind") == "C", 1.0).otherwise(-1.0), F.col("k") * F.exp(-0.04 * F.col("t"))
    most, least = F.when(F.col("kind") == "C", F.col("s")).otherwise(fade), F.greatest(side * (F.col("s") - fade), F.lit(0.0))
    quotes = quotes.withColumn("price", F.when(F.col("id") % 7 == 3, most + 0.5).when(F.col("id") % 7 == 5, least - 0.5).otherwise(F.col("price")))
    d1 = (F.ln(F.col("s") / F.col("k")) + (0.04 + F.col("sigma") * F.col("sigma") / 2) * F.col("t")) / (F.col("sigma") * F.sqrt("t"))
    return sig.implied_volatility(quotes).select("id", F.when(F.col("s") * density(d1) * F.sqrt("t") / 100 >= 0.05, F.col("iv")).alias("iv"))


QUERIES = {
    "beats_market_binomial": lambda s, d: rounded(sig.beats_market(*_returns(s, d))),
    "benjamini_hochberg": lambda s, d: rounded(sig.step_up(sig.beats_market(*_returns(s, d)), "p", "ticker", 0.5).select("ticker", "p", "cut", "passes")),
    "diebold_mariano": lambda s, d: rounded(sig.diebold_mariano(_losses(s, d), h=4)),
    "least_track_record": lambda s, d: rounded(sig.least_track_record(_returns(s, d)[0]), 3),
    "variance_ratio_joint": lambda s, d: rounded(sig.variance_ratios(_returns(s, d)[0])),
    "kpss_level": lambda s, d: rounded(sig.kpss(weekly_bars(s, d))),
    "barrier_odds": lambda s, d: rounded(sig.barriers(_returns(s, d)[0])),
    "implied_volatility": lambda s, d: rounded(_implied(s, d), 3),
}

_binomial = "least(list_sum(list_transform(generate_series(k, n), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5)))), 1)"
_BEATS = f", b AS (SELECT ticker, count(*) FILTER (WHERE r > m) AS k, count(r) AS n FROM ret JOIN mkt USING (wk) WHERE r IS NOT NULL GROUP BY ticker), p AS (SELECT *, {_binomial} AS p FROM b)"
_passage = lambda a, mu: f"least(greatest({phi_sql(f'(({mu} - {a}) / sd)')} + exp(least(2 * {mu} * {a} / (sd * sd), 700)) * {phi_sql(f'((-{mu} - {a}) / sd)')}, 0), 1)"
_UP, _DOWN = math.log1p(0.05), -math.log1p(-0.05)
ORACLE_SQL = {
    "beats_market_binomial": sql(_BEATS + " SELECT ticker, k, n, round(p, 6) AS p FROM p"),
    "benjamini_hochberg": sql(_BEATS + """, o AS (SELECT *, row_number() OVER (ORDER BY p, ticker) AS place, count(*) OVER () AS m FROM p), c AS (SELECT coalesce(max(p) FILTER (WHERE p <= place * 0.5::DOUBLE / m), -1) AS cut FROM o)
SELECT ticker, round(p, 6) AS p, round(cut, 6) AS cut, p <= cut AS passes FROM o, c"""),
    "diebold_mariano": sql(_F + """, l AS (SELECT ticker, wk, pow(y - mu, 2) - pow(y, 2) AS d FROM f WHERE y IS NOT NULL AND mu IS NOT NULL), u AS (SELECT *, d - avg(d) OVER (PARTITION BY ticker) AS u, row_number() OVER (PARTITION BY ticker ORDER BY wk) AS i FROM l),
s AS (SELECT a.ticker, sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 END * a.u * b.u) AS s, sum(a.u * b.u) FILTER (WHERE a.i = b.i) AS s0 FROM u a JOIN u b ON a.ticker = b.ticker AND a.i - b.i BETWEEN 0 AND 3 GROUP BY a.ticker),
g AS (SELECT ticker, count(*) AS n, avg(d) AS mean FROM l GROUP BY ticker HAVING count(*) >= 8), m AS (SELECT *, mean / sqrt(CASE WHEN s > 0 THEN s WHEN s0 > 0 THEN s0 ELSE 1e-12 * n END / n / n) AS dm FROM g JOIN s USING (ticker)),
t AS (SELECT *, dm * sqrt(greatest((n + 1 - 8 + 12.0::DOUBLE / n) / n, 1e-9)) AS dm_star, n - 1 AS df FROM m), a AS (SELECT *, atan(abs(dm_star) / sqrt(df)) AS th FROM t),
p AS (SELECT *, 1 - CASE WHEN df % 2 = 0 THEN sin(th) * list_sum(list_transform(generate_series(0, df // 2 - 1), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5)) * pow(cos(th), 2 * j)))
ELSE 2 / pi() * (th + sin(th) * cos(th) * list_sum(list_transform(generate_series(0, (df - 3) // 2), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(th), 2 * j)))) END AS p FROM a)
SELECT ticker, n, round(mean, 6) + 0.0 AS mean, round(dm, 6) + 0.0 AS dm, round(dm_star, 6) + 0.0 AS dm_star, round(least(greatest(p, 0), 1), 6) AS p FROM p"""),
    "least_track_record": sql(f""", s AS (SELECT ticker, avg(r) / stddev_samp(r) AS sr, avg(pow((r - mu) / sd, 3)) AS g3, avg(pow((r - mu) / sd, 4)) AS g4 FROM (SELECT ticker, r, avg(r) OVER (PARTITION BY ticker) AS mu, stddev_pop(r) OVER (PARTITION BY ticker) AS sd FROM ret WHERE r IS NOT NULL) GROUP BY ticker), v AS (SELECT *, 1 - g3 * sr + (g4 - 1) / 4 * sr * sr AS v FROM s)
SELECT ticker, round(sr, 3) + 0.0 AS sr, CASE WHEN sr > 0 AND v > 0 THEN round(1 + v * pow({NormalDist().inv_cdf(0.95)}::DOUBLE / sr, 2), 3) END AS weeks FROM v"""),
    "variance_ratio_joint": sql(f""", u AS (SELECT ticker, row_number() OVER w AS i, lr - avg(lr) OVER (PARTITION BY ticker) AS e FROM ret WHERE lr IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY wk)), c AS (SELECT *, sum(e) OVER (PARTITION BY ticker ORDER BY i) AS cs FROM u), h AS (SELECT unnest([2, 5, 10, 21]) AS q),
n AS (SELECT ticker, count(*) AS n, sum(e * e) AS ss FROM u GROUP BY ticker HAVING sum(e * e) > 0), v AS (SELECT a.ticker, q, sum(pow(a.cs - coalesce(b.cs, 0), 2)) AS v FROM c a CROSS JOIN h LEFT JOIN c b ON a.ticker = b.ticker AND b.i = a.i - q WHERE a.i >= q GROUP BY a.ticker, q),
d AS (SELECT a.ticker, a.i - b.i AS j, sum(a.e * a.e * b.e * b.e) AS d FROM u a JOIN u b ON a.ticker = b.ticker AND a.i - b.i BETWEEN 1 AND 20 GROUP BY ALL), t AS (SELECT ticker, q, sum(pow(2.0::DOUBLE * (q - j) / q, 2) * d) AS t FROM d JOIN h ON j < q GROUP BY ticker, q),
z AS (SELECT ticker, q, v / (q * (n - q + 1) * (1 - q::DOUBLE / n)) / (ss / n) AS vr, t / (ss * ss) AS theta FROM v JOIN t USING (ticker, q) JOIN n USING (ticker) WHERE n >= 4 * q), y AS (SELECT ticker, q, vr, (vr - 1) / sqrt(theta) AS z FROM z), x AS (SELECT *, max(abs(z)) OVER (PARTITION BY ticker) AS mv, count(z) OVER (PARTITION BY ticker) AS m FROM y)
SELECT ticker, q, round(vr, 6) AS vr, round(z, 6) + 0.0 AS z, round(2 * (1 - {phi_sql('abs(z)')}), 6) + 0.0 AS p, round(1 - pow(2 * {phi_sql('mv')} - 1, m), 6) + 0.0 AS p_joint FROM x"""),
    "kpss_level": sql(""", u AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY wk) AS i, ln(c) - avg(ln(c)) OVER (PARTITION BY ticker) AS u FROM bars), w AS (SELECT ticker, u, sum(u) OVER (PARTITION BY ticker ORDER BY i) AS s FROM u), n AS (SELECT ticker, count(*) AS n, sum(s * s) AS ss, floor(4 * pow(count(*) / 100.0, 2.0::DOUBLE / 9)) AS l FROM w GROUP BY ticker HAVING count(*) >= 25),
g AS (SELECT a.ticker, sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / (l + 1)) END * a.u * b.u) / any_value(n) AS lrv FROM u a JOIN n USING (ticker) JOIN u b ON a.ticker = b.ticker AND a.i - b.i BETWEEN 0 AND l GROUP BY a.ticker)
SELECT ticker, n, round(ss / (n * n * greatest(lrv, 1e-300)), 6) AS eta, ss / (n * n * greatest(lrv, 1e-300)) > 0.463 AS rejects FROM n JOIN g USING (ticker)"""),
    "barrier_odds": sql(f""", t AS (SELECT ticker, lr, var_samp(lr) OVER (PARTITION BY ticker) AS v FROM ret WHERE lr IS NOT NULL), g AS (SELECT ticker, avg(lr) * 13 AS mu, stddev_samp(lr) * {math.sqrt(13)}::DOUBLE AS sd, avg(CASE WHEN {_UP}::DOUBLE <= greatest(0, lr) THEN 1 ELSE exp(-2 * {_UP}::DOUBLE * ({_UP}::DOUBLE - lr) / v) END) AS bridge FROM t GROUP BY ticker)
SELECT ticker, round({_passage(f'{_UP}::DOUBLE', 'mu')}, 6) AS up, round({_passage(f'{_DOWN}::DOUBLE', '(-mu)')}, 6) AS down, round(sd * {NormalDist().inv_cdf(0.75)}::DOUBLE, 6) AS median_max, round(sd * {math.sqrt(2 / math.pi)}::DOUBLE, 6) AS mean_max, round(bridge, 6) AS bridge FROM g"""),
    "implied_volatility": _CHAIN + " SELECT id, CASE WHEN s * dens * sqrt(t) / 100 >= 0.05 AND id % 7 NOT IN (3, 5) THEN round(sigma, 3) END AS iv FROM de",
}

"""Queries on forecasts, options, text, events and quality, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import phi_sql
from ..operators import calibration as cal
from ..sources.panels import sql, table, weekly_bars, weekly_returns
from .time_series import rounded


def _forecasts(s: SparkSession, d: str) -> DataFrame:
    return cal.forecasts(weekly_returns(weekly_bars(s, d)))


def chain(s: SparkSession, d: str) -> DataFrame:
    """An option chain over the parts: strikes on a grid around 1500, kind by parity, spread and time by the key."""
    p = table(s, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.lit(1500.0).alias("s"), (F.floor(F.col("p_retailprice") / 50) * 50.0 + 50.0).alias("k"), (0.1 + (F.col("p_partkey") % 8) / 8.0).alias("t"), (0.15 + (F.col("p_partkey") % 5) / 20.0).alias("sigma"),
        F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("P").alias("kind"), F.col("p_size").cast("double").alias("oi"),
    )


def _gate(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    return cal.quality_gate(o, {"bad_price": F.col("o_totalprice") > 0, "bad_status": F.col("o_orderstatus").isin("O", "F", "P"), "no_customer": F.col("o_custkey").isNotNull(), "early": F.col("o_orderdate") >= "1992-01-01"})


QUERIES = {
    "coverage_grouping_sets": lambda s, d: rounded(cal.coverage_strata(_forecasts(s, d))),
    "interval_crps_qlike": lambda s, d: rounded(cal.interval_scores(_forecasts(s, d))),
    "cqr_pad": lambda s, d: rounded(cal.conformal(_forecasts(s, d))),
    "mincer_zarnowitz": lambda s, d: rounded(cal.mincer_zarnowitz(_forecasts(s, d))),
    "reliability_brier": lambda s, d: rounded(cal.reliability(_forecasts(s, d))),
    "psi_drift": lambda s, d: rounded(cal.stability(weekly_returns(weekly_bars(s, d)))),
    "ks_two_sample": lambda s, d: rounded(cal.kolmogorov(weekly_returns(weekly_bars(s, d)))),
    "black_scholes_greeks": lambda s, d: rounded(cal.black_scholes(chain(s, d))),
    "dealer_gamma": lambda s, d: rounded(cal.dealer_gamma(cal.black_scholes(chain(s, d)), 1500.0), 4),
    "touch_odds": lambda s, d: rounded(cal.touch_odds(weekly_bars(s, d))),
    "text_sentiment": lambda s, d: rounded(cal.sentiment(table(s, d, "documents"), "doc_id", "text")),
    "event_intensity": lambda s, d: rounded(cal.event_intensity(table(s, d, "events"))),
    "intraday_buckets": lambda s, d: rounded(cal.quarter_hours(table(s, d, "events"))),
    "quality_gate": _gate,
}

_F = """, fc AS (SELECT * FROM (SELECT ticker, sec, wk, lr AS y, row_number() OVER (PARTITION BY ticker ORDER BY wk) AS i, avg(lr) OVER b AS mu, stddev_samp(lr) OVER b AS sigma FROM ret WHERE lr IS NOT NULL WINDOW b AS (PARTITION BY ticker ORDER BY wk ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)) WHERE i > 26),
f AS (SELECT *, mu - 1.6448536 * sigma AS lo, mu + 1.6448536 * sigma AS hi FROM fc)"""
_Z2 = 1.959964**2
_CHAIN = """WITH ch AS (SELECT p_partkey AS id, 1500.0::DOUBLE AS s, floor(p_retailprice / 50) * 50.0 + 50.0 AS k, 0.1::DOUBLE + (p_partkey % 8) / 8.0::DOUBLE AS t, 0.15::DOUBLE + (p_partkey % 5) / 20.0::DOUBLE AS sigma, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS kind, p_size::DOUBLE AS oi FROM part),
dd AS (SELECT *, (ln(s / k) + (0.04::DOUBLE + sigma * sigma / 2) * t) / (sigma * sqrt(t)) AS d1 FROM ch), de AS (SELECT *, d1 - sigma * sqrt(t) AS d2, exp(-0.04::DOUBLE * t) AS fade, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS dens FROM dd)"""
_HALVES = "t AS (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY wk) * 2 > count(*) OVER (PARTITION BY ticker) AS late FROM ret WHERE r IS NOT NULL)"
_words = lambda xs: ", ".join("'" + w.replace("'", "''") + "'" for w in xs)
_in = lambda x, xs: f"({x} IN ({_words(xs)}))"
ORACLE_SQL = {
    "coverage_grouping_sets": sql(_F + f""", t AS (SELECT *, CASE WHEN y >= lo AND y <= hi THEN 1 ELSE 0 END AS c, CASE WHEN y >= 0 THEN 'up' ELSE 'down' END AS side, CASE WHEN sigma > 0.25 THEN 'wide' ELSE 'narrow' END AS spread FROM f),
g AS (SELECT sec, side, spread, count(*) AS n, sum(c)::DOUBLE / count(*) AS p, avg(hi - lo) AS width FROM t GROUP BY GROUPING SETS ((), (sec), (side), (spread)))
SELECT sec, side, spread, n, round(p, 6) AS coverage, round(width, 6) AS width, round((p + {_Z2} / (2 * n)) / (1 + {_Z2} / n) - 1.959964 * sqrt(p * (1 - p) / n + {_Z2} / (4 * n * n)) / (1 + {_Z2} / n), 6) AS low,
round((p + {_Z2} / (2 * n)) / (1 + {_Z2} / n) + 1.959964 * sqrt(p * (1 - p) / n + {_Z2} / (4 * n * n)) / (1 + {_Z2} / n), 6) AS high FROM g"""),
    "interval_crps_qlike": sql(_F + f""", z AS (SELECT *, (y - mu) / sigma AS z FROM f) SELECT ticker, round(avg(hi - lo + 20 * greatest(lo - y, 0) + 20 * greatest(y - hi, 0)), 6) AS interval,
round(avg(CASE WHEN y >= lo THEN 0.05 * (y - lo) ELSE -0.95 * (y - lo) END), 6) AS pin_lo, round(avg(CASE WHEN y >= hi THEN 0.95 * (y - hi) ELSE -0.05 * (y - hi) END), 6) AS pin_hi,
round(avg(sigma * (z * (2 * {phi_sql('z')} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 6) AS crps, round(avg(ln(sigma * sigma) + pow(y - mu, 2) / (sigma * sigma)), 6) AS qlike, round(sqrt(avg(pow(y - mu, 2))), 6) AS rmse, round(avg(abs(y - mu)), 6) AS mae FROM z GROUP BY ticker"""),
    "cqr_pad": sql(_F + """, t AS (SELECT ticker, greatest(lo - y, y - hi) AS s, i - 26 <= floor((max(i) OVER (PARTITION BY ticker) - 26) * 0.6) AS first FROM f), c AS (SELECT ticker, list_sort(list(s)) AS xs FROM t WHERE first GROUP BY ticker),
p AS (SELECT ticker, len(xs)::BIGINT AS n_cal, xs[least(ceil((len(xs) + 1) * 0.9), len(xs))::INT] AS pad FROM c)
SELECT ticker, n_cal, round(pad, 6) AS pad, round(avg(CASE WHEN s <= pad THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN s <= 0 THEN 1.0 ELSE 0.0 END), 6) AS raw, count(*) AS n FROM t JOIN p USING (ticker) WHERE NOT first GROUP BY ALL"""),
    "mincer_zarnowitz": sql(_F + "SELECT ticker, round(regr_intercept(y, mu), 6) AS a, round(regr_slope(y, mu), 6) AS b, round(regr_r2(y, mu), 6) AS r2, round(1 - sum(pow(y - mu, 2)) / sum(y * y), 6) AS skill, round(sqrt(sum(pow(y - mu, 2)) / sum(y * y)), 6) AS u2, round(avg(y - mu), 6) AS bias FROM f GROUP BY ticker"),
    "reliability_brier": sql(_F + f", p AS (SELECT {phi_sql('mu / sigma')} AS p, CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END AS hit FROM f) SELECT least(floor(p * 5), 4)::INT AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(hit), 6) AS observed, round(avg(pow(p - hit, 2)), 6) AS brier FROM p GROUP BY 1"),
    "psi_drift": sql(f""", {_HALVES}, e AS (SELECT ticker, list_sort(list(r)) AS xs FROM t WHERE NOT late GROUP BY ticker), b AS (SELECT ticker, late, (SELECT count(*) FROM generate_series(1, 9) AS g(b) WHERE r >= xs[floor(b * len(xs) / 10)::INT + 1]) AS bin FROM t JOIN e USING (ticker)),
s AS (SELECT ticker, bin, count(*) FILTER (WHERE NOT late) AS a, count(*) FILTER (WHERE late) AS b FROM b GROUP BY ALL), h AS (SELECT ticker, greatest(a::DOUBLE / sum(a) OVER (PARTITION BY ticker), 1e-4) AS a, greatest(b::DOUBLE / sum(b) OVER (PARTITION BY ticker), 1e-4) AS b FROM s),
p AS (SELECT ticker, sum((b - a) * ln(b / a)) AS psi FROM h GROUP BY ticker) SELECT ticker, round(psi, 6) AS psi, CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS drift FROM p"""),
    "ks_two_sample": sql(f""", {_HALVES}, g AS (SELECT ticker, r, count(*) FILTER (WHERE NOT late) AS a, count(*) FILTER (WHERE late) AS b FROM t GROUP BY ALL),
d AS (SELECT ticker, a, b, abs(sum(a) OVER (PARTITION BY ticker ORDER BY r)::DOUBLE / sum(a) OVER (PARTITION BY ticker) - sum(b) OVER (PARTITION BY ticker ORDER BY r)::DOUBLE / sum(b) OVER (PARTITION BY ticker)) AS d FROM g)
SELECT ticker, round(max(d), 6) AS ks, sum(a)::BIGINT AS n_ref, sum(b)::BIGINT AS n_cur FROM d GROUP BY ticker"""),
    "black_scholes_greeks": _CHAIN + f""" SELECT id, kind, k, oi, round(CASE WHEN kind = 'C' THEN s * {phi_sql('d1')} - k * fade * {phi_sql('d2')} ELSE k * fade * {phi_sql('(-d2)')} - s * {phi_sql('(-d1)')} END, 6) + 0.0 AS price, round(CASE WHEN kind = 'C' THEN {phi_sql('d1')} ELSE {phi_sql('d1')} - 1 END, 6) + 0.0 AS delta,
round(dens / (s * sigma * sqrt(t)), 6) AS gamma, round(s * dens * sqrt(t) / 100, 6) AS vega, round(CASE WHEN kind = 'C' THEN {phi_sql('d2')} ELSE {phi_sql('(-d2)')} END, 6) AS p_itm FROM de""",
    "dealer_gamma": _CHAIN + """, g AS (SELECT k, sum(CASE WHEN kind = 'C' THEN 1 ELSE -1 END * dens / (s * sigma * sqrt(t)) * oi * 100 * 1500.0::DOUBLE * 1500.0::DOUBLE * 0.01::DOUBLE) AS gex, sum(oi) AS oi FROM de GROUP BY k)
SELECT k, round(gex, 4) AS gex, round(oi, 4) AS oi, round(sum(gex) OVER (ORDER BY k), 4) AS total FROM g""",
    "touch_odds": sql(f""", a AS (SELECT ticker, c, lr, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) AS age FROM ret), t AS (SELECT ticker, max(c) AS hi, min(c) AS lo, stddev_samp(lr) AS sd, max(c) FILTER (WHERE age = 1) AS c FROM a WHERE age <= 63 GROUP BY ticker),
p AS (SELECT *, least(greatest(2 * (1 - {phi_sql(f'(abs(ln(hi / c)) / (sd * {math.sqrt(21)}))')}), 0), 1) AS p_hi, least(greatest(2 * (1 - {phi_sql(f'(abs(ln(lo / c)) / (sd * {math.sqrt(21)}))')}), 0), 1) AS p_lo FROM t)
SELECT ticker, round(p_hi, 6) AS p_hi, round(p_lo, 6) AS p_lo, round(p_hi * 100 * (hi / c - 1) - p_lo * 100 * (1 - lo / c), 6) AS ev FROM p"""),
    "text_sentiment": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''-]+') AS w FROM documents), u AS (SELECT doc_id, len(w) AS n, w, unnest(generate_series(1, len(w))) AS i FROM t),
m AS (SELECT doc_id, CASE WHEN {_in('w[i]', cal.GOOD)} THEN 1 WHEN {_in('w[i]', cal.BAD)} THEN -1 ELSE 0 END * CASE WHEN list_has_any(w[greatest(i - 3, 1):i - 1], [{_words(cal.TURN)}]) THEN -1 ELSE 1 END AS m FROM u),
s AS (SELECT doc_id, count(*) FILTER (WHERE m > 0) AS good, count(*) FILTER (WHERE m < 0) AS bad FROM m GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, round(coalesce((good - bad)::DOUBLE / nullif(good + bad, 0), 0), 6) AS polarity FROM t LEFT JOIN s ON t.doc_id = s.doc_id""",
    "event_intensity": "SELECT event_type, count(*) AS n, round(sum(exp(-((SELECT max(ts)::DATE FROM events) - ts::DATE) / 10.0)), 6) AS intensity, max(ts)::DATE AS last FROM events GROUP BY event_type",
    "intraday_buckets": """WITH b AS (SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL), x AS (SELECT *, hour(start) * 4 + minute(start) // 15 AS tod, ln(1.0 + n) AS x FROM b),
m AS (SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY event_type, tod) AS med FROM x), d AS (SELECT *, quantile_cont(abs(x - med), 0.5) OVER (PARTITION BY event_type, tod) AS mad FROM m)
SELECT event_type, start, n, round(mean, 6) AS mean, round(0.6745 * (x - med) / greatest(mad, 1e-3), 6) AS z FROM d""",
    "quality_gate": """WITH c AS (SELECT count(*) AS rows, count(*) FILTER (WHERE NOT o_totalprice > 0) AS bad_price, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F', 'P')) AS bad_status, count(*) FILTER (WHERE o_custkey IS NULL) AS no_customer, count(*) FILTER (WHERE o_orderdate < '1992-01-01') AS early FROM orders)
SELECT *, bad_price + bad_status + no_customer + early = 0 AS passes FROM c""",
}

"""Queries over each asset's bars, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import time_series as ts
from ..sources.panels import market, sql, weekly_bars, weekly_returns


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, with NaN as null and zero without a sign."""
    return df.select(*((F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _on_bars(f):
    return lambda spark, d: rounded(f(weekly_bars(spark, d)))


def _on_returns(f):
    return lambda spark, d: rounded(f(weekly_returns(weekly_bars(spark, d))))


def _with_market(f):
    def run(spark: SparkSession, d: str) -> DataFrame:
        ret = weekly_returns(weekly_bars(spark, d))
        return rounded(f(ret, market(ret)))

    return run


QUERIES = {
    "weekly_bars": lambda spark, d: rounded(weekly_bars(spark, d), 9),
    "weekly_returns": _on_returns(lambda r: r.where("r is not null").select("ticker", "wk", "r", "lr")),
    "horizon_returns": _on_returns(ts.horizon_returns),
    "annual_vol_beta": _with_market(ts.volatility_beta),
    "money_flow_net": _on_bars(ts.money_flow),
    "mfi14": _on_bars(ts.money_flow_index),
    "atr14": _on_bars(ts.true_range),
    "ema21_distance": _on_bars(ts.ema),
    "ewma_vol": _on_returns(ts.ewma_volatility),
    "range_volatility": _on_bars(ts.range_volatility),
    "bipower_jump": _on_returns(ts.jump_ratio),
    "variance_ratio_q5": _on_returns(ts.variance_ratio),
    "ou_half_life": _on_bars(ts.half_life),
    "drawdowns": _on_bars(ts.drawdowns),
    "risk_summary": _with_market(ts.risk_summary),
    "skew_kurt": _on_returns(ts.moments),
    "hurst_slope": _on_bars(ts.hurst),
    "hv_term_structure": _on_returns(ts.volatility_term),
    "relative_volume": _on_bars(ts.relative_volume),
    "series_health": _on_bars(ts.series_health),
}

_AGE = "row_number() OVER (PARTITION BY ticker ORDER BY wk DESC)"
ORACLE_SQL = {
    "weekly_bars": sql("SELECT ticker, sec, wk, round(o, 9) AS o, round(h, 9) AS h, round(l, 9) AS l, round(c, 9) AS c, round(v, 9) AS v FROM bars"),
    "weekly_returns": sql("SELECT ticker, wk, round(r, 6) AS r, round(lr, 6) AS lr FROM ret WHERE r IS NOT NULL"),
    "horizon_returns": sql(f""", a AS (SELECT ticker, r, {_AGE} AS age FROM ret WHERE r IS NOT NULL)
SELECT ticker, {', '.join(f'round(100 * (exp(sum(ln(1 + r)) FILTER (WHERE age <= {n})) - 1), 6) AS {k}' for k, n in (('ret1w', 1), ('ret1m', 4), ('ret3m', 13), ('ret6m', 26), ('ret12m', 52)))} FROM a GROUP BY ticker"""),
    "annual_vol_beta": sql("""SELECT ticker, round(stddev_samp(r) * sqrt(52) * 100, 6) AS vol, round(CASE WHEN count(r) >= 5 THEN covar_samp(r, m) / var_samp(m) END, 6) AS beta, count(r) AS n
FROM ret JOIN mkt USING (wk) WHERE r IS NOT NULL GROUP BY ticker"""),
    "money_flow_net": sql(f""", f AS (SELECT *, lag(c) OVER (PARTITION BY ticker ORDER BY wk) AS b, {_AGE} AS age FROM bars),
s AS (SELECT ticker, coalesce(sum(c * v) FILTER (WHERE c >= b), 0) AS u, coalesce(sum(c * v) FILTER (WHERE c < b), 0) AS d FROM f WHERE b IS NOT NULL AND age <= 21 GROUP BY ticker)
SELECT ticker, round(u, 6) AS inflow, round(d, 6) AS outflow, round((u - d) / nullif(u + d, 0), 6) AS net FROM s"""),
    "mfi14": sql(f""", t AS (SELECT ticker, wk, v, (h + l + c) / 3 AS tp, lag((h + l + c) / 3) OVER (PARTITION BY ticker ORDER BY wk) AS b FROM bars),
a AS (SELECT *, {_AGE} AS age FROM t WHERE b IS NOT NULL),
s AS (SELECT ticker, coalesce(sum(tp * v) FILTER (WHERE tp > b), 0) AS p, coalesce(sum(tp * v) FILTER (WHERE tp < b), 0) AS n FROM a WHERE age <= 14 GROUP BY ticker)
SELECT ticker, round(CASE WHEN n > 0 THEN 100 - 100 / (1 + p / n) WHEN p > 0 THEN 100.0 ELSE 50.0 END, 6) AS mfi FROM s"""),
    "atr14": sql(f""", t AS (SELECT *, lag(c) OVER (PARTITION BY ticker ORDER BY wk) AS b FROM bars), a AS (SELECT *, greatest(h - l, abs(h - b), abs(l - b)) AS tr, {_AGE} AS age FROM t WHERE b IS NOT NULL),
s AS (SELECT ticker, avg(tr) AS atr, max(c) FILTER (WHERE age = 1) AS x, max(b) FILTER (WHERE age = 1) AS y FROM a WHERE age <= 14 GROUP BY ticker)
SELECT ticker, round(atr, 6) AS atr, x < y - atr AS broke FROM s"""),
    "ema21_distance": sql(""", n AS (SELECT ticker, c, i, count(*) OVER (PARTITION BY ticker) AS n FROM ret),
e AS (SELECT ticker, sum(c * CASE WHEN i = 1 THEN pow(1 - 2.0 / 22, n - 1) ELSE 2.0 / 22 * pow(1 - 2.0 / 22, n - i) END) AS ema, max(c) FILTER (WHERE i = n) AS x FROM n GROUP BY ticker)
SELECT ticker, round(ema, 6) AS ema, round(100 * (x - ema) / ema, 6) AS distance FROM e"""),
    "ewma_vol": sql(f""", a AS (SELECT ticker, r, {_AGE} - 1 AS age, count(r) OVER (PARTITION BY ticker) AS n FROM ret WHERE r IS NOT NULL)
SELECT ticker, round(sqrt(sum(CASE WHEN age = n - 1 THEN pow(0.94, age) ELSE 0.06 * pow(0.94, age) END * r * r) * 52), 6) AS ewma_vol FROM a GROUP BY ticker"""),
    "range_volatility": sql(f"""SELECT ticker, round(sqrt(greatest(var_samp(lr), 0) * 52), 6) AS close_vol, round(sqrt(greatest(avg(pow(ln(h / l), 2) / (4 * ln(2))), 0) * 52), 6) AS parkinson,
round(sqrt(greatest(avg(0.5 * pow(ln(h / l), 2) - {2 * math.log(2) - 1} * pow(ln(c / o), 2)), 0) * 52), 6) AS garman_klass, round(sqrt(greatest(avg(ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)), 0) * 52), 6) AS rogers_satchell
FROM ret GROUP BY ticker"""),
    "bipower_jump": sql(f""", a AS (SELECT ticker, lr, lag(abs(lr)) OVER (PARTITION BY ticker ORDER BY wk) AS b, {_AGE} AS age FROM ret WHERE lr IS NOT NULL),
s AS (SELECT ticker, sum(lr * lr) AS rv, pi() / 2 * sum(abs(lr) * b) FILTER (WHERE age < 21) AS bv FROM a WHERE age <= 21 GROUP BY ticker)
SELECT ticker, round(rv, 6) AS rv, round(bv, 6) AS bv, round(least(greatest((rv - bv) / nullif(rv, 0), 0), 1), 6) AS jump FROM s"""),
    "variance_ratio_q5": sql(""", a AS (SELECT ticker, lr, sum(lr) OVER (PARTITION BY ticker ORDER BY wk ROWS 4 PRECEDING) AS s, row_number() OVER (PARTITION BY ticker ORDER BY wk) AS k FROM ret WHERE lr IS NOT NULL),
s AS (SELECT ticker, count(lr) AS n, var_samp(s) FILTER (WHERE k >= 5) / (5 * var_samp(lr)) AS vr FROM a GROUP BY ticker)
SELECT ticker, round(CASE WHEN n >= 20 THEN vr END, 6) AS vr, CASE WHEN n >= 20 THEN CASE WHEN vr >= 1.15 THEN 'trending' WHEN vr <= 0.85 THEN 'mean-revert' ELSE 'random-walk' END END AS regime FROM s"""),
    "ou_half_life": sql(""", a AS (SELECT ticker, ln(c) AS p, lag(ln(c)) OVER (PARTITION BY ticker ORDER BY wk) AS b FROM bars), s AS (SELECT ticker, count(b) AS n, regr_slope(p - b, b) AS slope FROM a WHERE b IS NOT NULL GROUP BY ticker)
SELECT ticker, round(slope, 6) AS slope, round(CASE WHEN n >= 25 AND slope < 0 THEN least(-ln(2) / slope, 252) END, 6) AS half_life FROM s"""),
    "drawdowns": sql(""", a AS (SELECT ticker, wk, c, max(c) OVER w AS peak FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY wk)), b AS (SELECT *, c / peak - 1 AS dd, sum(CASE WHEN c < peak THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY wk) AS run FROM a),
g AS (SELECT ticker, run, count(*) FILTER (WHERE c < peak) AS span FROM b GROUP BY ticker, run)
SELECT b.ticker, round(min(dd), 6) AS max_drawdown, round(sqrt(avg(pow(100 * dd, 2))), 6) AS ulcer, any_value(g.longest)::BIGINT AS longest FROM b JOIN (SELECT ticker, max(span) AS longest FROM g GROUP BY ticker) g ON b.ticker = g.ticker GROUP BY b.ticker"""),
    "risk_summary": sql(""", t AS (SELECT ticker, r, m FROM ret JOIN mkt USING (wk) WHERE r IS NOT NULL), s AS (SELECT ticker, avg(r) * 52 / (stddev_samp(r) * sqrt(52)) AS sharpe, avg(r) * 52 / (sqrt(avg(pow(least(r, 0), 2))) * sqrt(52)) AS sortino,
avg(r - m) * 52 / (stddev_samp(r - m) * sqrt(52)) AS information, stddev_samp(r - m) * sqrt(52) AS tracking, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(r) FILTER (WHERE r > 0) / -sum(r) FILTER (WHERE r < 0) AS profit_factor,
list_sort(list(r)) AS w FROM t GROUP BY ticker)
SELECT ticker, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(information, 6) AS information, round(tracking, 6) AS tracking, round(hit_rate, 6) AS hit_rate, round(profit_factor, 6) AS profit_factor,
round(-w[floor(0.05 * len(w))::INT + 1], 6) AS var95, round(-list_sum(w[1:greatest(floor(0.05 * len(w))::INT, 1)]) / greatest(floor(0.05 * len(w))::INT, 1), 6) AS cvar95 FROM s"""),
    "skew_kurt": sql("SELECT ticker, round(CASE WHEN count(r) > 3 THEN skewness(r) END, 6) AS skew, round(CASE WHEN count(r) > 3 THEN kurtosis(r) END, 6) AS kurt FROM ret WHERE r IS NOT NULL GROUP BY ticker"),
    "hurst_slope": sql(""", d AS (SELECT a.ticker, b.i - a.i AS k, stddev_pop(b.c - a.c) AS sd FROM ret a JOIN ret b ON a.ticker = b.ticker AND b.i - a.i BETWEEN 2 AND 20 GROUP BY ALL)
SELECT ticker, round(regr_slope(ln(sd), ln(k)), 6) AS hurst FROM d WHERE sd > 0 GROUP BY ticker"""),
    "hv_term_structure": sql(""", s AS (SELECT ticker, lr, i - 1 AS k, """ + ", ".join(f"sum(lr) OVER (PARTITION BY ticker ORDER BY wk ROWS {h - 1} PRECEDING) AS s{h}" for h in (1, 5, 10, 21)) + """ FROM ret WHERE lr IS NOT NULL)
""" + " UNION ALL ".join(f"SELECT ticker, {h} AS h, round(stddev_samp(s{h}) FILTER (WHERE k >= {h}), 6) AS hv, round(stddev_samp(lr) * sqrt({h}), 6) AS root_rule FROM s GROUP BY ticker" for h in (1, 5, 10, 21))),
    "relative_volume": sql("SELECT ticker, wk, round(v / nullif(quantile_cont(v, 0.5) OVER (PARTITION BY ticker ORDER BY wk ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 6) AS rvol FROM bars"),
    "series_health": sql(""", g AS (SELECT ticker, wk, c, lr, wk - lag(wk) OVER w AS gap, CASE WHEN c = lag(c) OVER w THEN 0 ELSE 1 END AS new FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY wk)), m AS (SELECT ticker, median(lr) AS med FROM g GROUP BY ticker), o AS (SELECT g.*, abs(lr - med) AS off FROM g JOIN m USING (ticker)),
d AS (SELECT ticker, median(off) AS mad FROM o GROUP BY ticker), u AS (SELECT ticker, run, count(*) AS k FROM (SELECT ticker, sum(new) OVER (PARTITION BY ticker ORDER BY wk) AS run FROM g) GROUP BY ALL), v AS (SELECT ticker, max(k) AS stale_run FROM u GROUP BY ticker),
s AS (SELECT ticker, count(*) AS n, count(*) FILTER (WHERE c IS NULL) AS missing, count(*) FILTER (WHERE c <= 0) AS not_positive, max(gap)::INT AS max_gap, any_value(stale_run) AS stale_run, count(*) FILTER (WHERE 0.6745 * off / greatest(mad, 1e-12) > 3.5) AS jumps, count(lr) AS k FROM o JOIN d USING (ticker) JOIN v USING (ticker) GROUP BY ticker)
SELECT * EXCLUDE (k), CASE WHEN n < 40 OR not_positive > 0 OR missing > greatest(2.0, 0.02 * n) THEN 'reject' WHEN missing > 0 OR stale_run >= 4 OR max_gap > 7 OR jumps > greatest(3.0, 0.05 * k) THEN 'degraded' ELSE 'clean' END AS verdict FROM s"""),
}

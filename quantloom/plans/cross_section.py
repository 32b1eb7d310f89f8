"""Queries across assets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import phi, phi_sql
from ..operators import cross_section as cs
from ..sources.panels import market, sql, table, weekly_bars, weekly_returns
from . import time_series
from .time_series import rounded


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bars = weekly_bars(spark, d)
    ret = weekly_returns(bars)
    return bars, ret, market(ret)


def _assets(spark: SparkSession, d: str) -> DataFrame:
    return cs.assets(*_panel(spark, d))


def drivers(spark: SparkSession, d: str) -> DataFrame:
    """``driver, wk, f``: the weekly change of order value by priority."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("driver"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("wk")).agg(F.sum("o_totalprice").alias("x"))
    return o.select("driver", "wk", (F.col("x") / F.lag("x").over(Window.partitionBy("driver").orderBy("wk")) - 1).alias("f")).where("f is not null")


def _dependencies(spark: SparkSession, d: str) -> DataFrame:
    _, ret, mkt = _panel(spark, d)
    return cs.partial_correlation(ret, mkt, drivers(spark, d))


QUERIES = {
    "asset_table": lambda s, d: rounded(_assets(s, d)),
    "winsor_zscores": lambda s, d: rounded(cs.z_scores(_assets(s, d), ["ret6m", "vol", "beta", "net"]).select("ticker", "z_ret6m", "z_vol", "z_beta", "z_net")),
    "opportunity_score": lambda s, d: rounded(cs.opportunity(_assets(s, d)).select("ticker", "opp", "opp_pct")),
    "rotation_score": lambda s, d: rounded(cs.rotation(_assets(s, d))),
    "sector_corr_matrix": lambda s, d: rounded(cs.sector_correlation(_panel(s, d)[1])),
    "allpairs_topk_corr": lambda s, d: rounded(cs.top_correlations(_panel(s, d)[1])),
    "lead_lag_market": lambda s, d: rounded(cs.lead_lag(*_panel(s, d)[1:])),
    "leave_one_out_beta": lambda s, d: rounded(cs.leave_one_out_beta(_panel(s, d)[1])),
    "rank_ic_by_date": lambda s, d: rounded(cs.rank_ic(cs.momentum_panel(weekly_bars(s, d)))),
    "ic_summary": lambda s, d: rounded(cs.ic_summary(cs.rank_ic(cs.momentum_panel(weekly_bars(s, d))))),
    "quantile_long_short": lambda s, d: rounded(cs.quantile_returns(cs.momentum_panel(weekly_bars(s, d)))),
    "fama_macbeth_1f": lambda s, d: rounded(cs.fama_macbeth(cs.momentum_panel(weekly_bars(s, d)))),
    "two_way_fe": lambda s, d: rounded(cs.two_way_fixed_effects(cs.momentum_panel(weekly_bars(s, d)))),
    "cluster_se": lambda s, d: rounded(cs.clustered_errors(cs.momentum_panel(weekly_bars(s, d)))),
    "backtest_net_cost": lambda s, d: rounded(cs.net_backtest(cs.momentum_panel(weekly_bars(s, d)))),
    "partial_corr_factors": lambda s, d: rounded(_dependencies(s, d)),
    "by_fdr_dependencies": lambda s, d: rounded(cs.false_discovery(_dependencies(s, d).withColumn("p", F.round(2 * (1 - phi(F.abs("t"))), 9)), "p").select("ticker", "driver", "p", "place", "passes")),
}

_O = time_series.ORACLE_SQL
_inner = lambda name: _O[name].split("WITH ", 1)[1]
_ASSETS = f""", hr AS (SELECT ticker, {', '.join(f'100 * (exp(sum(ln(1 + r)) FILTER (WHERE age <= {n})) - 1) AS {k}' for k, n in (('ret1w', 1), ('ret1m', 4), ('ret3m', 13), ('ret6m', 26), ('ret12m', 52)))}
  FROM (SELECT ticker, r, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) AS age FROM ret WHERE r IS NOT NULL) GROUP BY ticker),
vb AS (SELECT ticker, stddev_samp(r) * sqrt(52) * 100 AS vol, CASE WHEN count(r) >= 5 THEN covar_samp(r, m) / var_samp(m) END AS beta FROM ret JOIN mkt USING (wk) WHERE r IS NOT NULL GROUP BY ticker),
fl AS (SELECT ticker, (coalesce(sum(c * v) FILTER (WHERE c >= b), 0) - coalesce(sum(c * v) FILTER (WHERE c < b), 0)) / nullif(sum(c * v), 0) AS net
  FROM (SELECT ticker, c, v, lag(c) OVER (PARTITION BY ticker ORDER BY wk) AS b, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) AS age FROM bars) WHERE b IS NOT NULL AND age <= 21 GROUP BY ticker),
em AS (SELECT ticker, 100 * (max(c) FILTER (WHERE i = n) / sum(c * CASE WHEN i = 1 THEN pow(1 - 2.0 / 22, n - 1) ELSE 2.0 / 22 * pow(1 - 2.0 / 22, n - i) END) - 1) AS distance
  FROM (SELECT ticker, c, i, count(*) OVER (PARTITION BY ticker) AS n FROM ret) GROUP BY ticker),
names AS (SELECT ticker, sec, ret1w, ret1m, ret3m, ret6m, ret12m, vol, beta, net, distance, ret3m - avg(ret3m) OVER (PARTITION BY sec) AS sec_rel
  FROM (SELECT DISTINCT ticker, sec FROM bars) LEFT JOIN hr USING (ticker) LEFT JOIN vb USING (ticker) LEFT JOIN fl USING (ticker) LEFT JOIN em USING (ticker))"""
_PANEL = """, pan AS (SELECT * FROM (SELECT ticker, wk, c / lag(c, 13) OVER w - 1 AS sig, lead(c, 4) OVER w / c - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY wk)) WHERE sig IS NOT NULL AND fwd IS NOT NULL)"""
_IC = _PANEL + """, rk AS (SELECT wk, rank() OVER (PARTITION BY wk ORDER BY sig) + (count(*) OVER (PARTITION BY wk, sig) - 1) / 2.0 AS a, rank() OVER (PARTITION BY wk ORDER BY fwd) + (count(*) OVER (PARTITION BY wk, fwd) - 1) / 2.0 AS b FROM pan),
ics AS (SELECT wk, count(*) AS n, corr(a, b) AS ic FROM rk GROUP BY wk HAVING count(*) >= 5)"""
_DEP = """, drv AS (SELECT driver, wk, x / lag(x) OVER (PARTITION BY driver ORDER BY wk) - 1 AS f FROM (SELECT o_orderpriority AS driver, CAST(date_trunc('week', o_orderdate) AS DATE) AS wk, sum(o_totalprice) AS x FROM orders GROUP BY ALL)),
pc AS (SELECT ticker, driver, count(r) AS n, corr(r, f) AS c, corr(r, m) AS cm, corr(f, m) AS fm FROM ret JOIN mkt USING (wk) JOIN drv USING (wk) WHERE r IS NOT NULL AND f IS NOT NULL GROUP BY ALL HAVING count(r) >= 8),
dep AS (SELECT ticker, driver, n, c, CASE WHEN abs(c) >= 0.999 THEN 9.9 * sign(c) ELSE c * sqrt((n - 2) / (1 - c * c)) END AS t, (c - cm * fm) / nullif(sqrt((1 - cm * cm) * (1 - fm * fm)), 0) AS pcorr FROM pc)"""
_z = lambda c, sd="stddev_samp": f"coalesce(({c} - avg({c}) OVER ()) / (CASE WHEN {sd}({c}) OVER () > 0 THEN {sd}({c}) OVER () ELSE 1 END), 0)"
_wz = ["ret6m", "vol", "beta", "net"]

ORACLE_SQL = {
    "asset_table": sql(_ASSETS + " SELECT ticker, sec, " + ", ".join(f"round({c}, 6) AS {c}" for c in "ret1w ret1m ret3m ret6m ret12m vol beta net distance sec_rel".split()) + " FROM names"),
    "winsor_zscores": sql(_ASSETS + ", s AS (SELECT " + ", ".join(f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL)) AS l_{c}" for c in _wz) + " FROM names), w AS (SELECT ticker, "
        + ", ".join(f"least(greatest({c}, l_{c}[least(floor(0.02 * len(l_{c}))::INT, len(l_{c}) - 1) + 1]), l_{c}[least(floor(0.98 * len(l_{c}))::INT, len(l_{c}) - 1) + 1]) AS {c}" for c in _wz) + " FROM names, s) SELECT ticker, " + ", ".join(f"round({_z(c)}, 6) AS z_{c}" for c in _wz) + " FROM w"),
    "opportunity_score": sql(_ASSETS + f", o AS (SELECT ticker, 0.30 * {_z('distance')} + 0.25 * {_z('ret6m')} + 0.25 * {_z('sec_rel')} + 0.20 * {_z('net')} AS opp FROM names) SELECT ticker, round(opp, 6) AS opp, round_even(100 * cume_dist() OVER (ORDER BY opp), 0) AS opp_pct FROM o"),
    "rotation_score": sql(_ASSETS + """, g AS (SELECT sec, median(ret1m - ret3m / 3) AS accel, median(net) AS flow, avg(CASE WHEN distance > 0 THEN 1.0 ELSE 0.0 END) AS breadth, median(ret6m) AS mom, median(sec_rel) AS rs, count(*) AS n FROM names GROUP BY sec),
q AS (SELECT *, """ + " + ".join(f"{w} * {_z(c, 'stddev_pop')}" for c, w in (("accel", 0.30), ("flow", 0.25), ("breadth", 0.20), ("mom", 0.15), ("rs", 0.10))) + """ AS score FROM g)
SELECT sec, round(accel, 6) AS accel, round(flow, 6) AS flow, round(breadth, 6) AS breadth, round(mom, 6) AS mom, round(rs, 6) AS rs, n, round(score, 6) AS score, CASE WHEN score >= 0.5 THEN 'in' WHEN score <= -0.5 THEN 'out' ELSE 'neutral' END AS label,
row_number() OVER (ORDER BY score DESC, sec)::INT AS rank FROM q"""),
    "sector_corr_matrix": sql(", s AS (SELECT sec, wk, avg(r) AS r FROM ret WHERE r IS NOT NULL GROUP BY ALL) SELECT a.sec AS a, b.sec AS b, round(corr(a.r, b.r), 6) AS corr FROM s a JOIN s b ON a.wk = b.wk AND a.sec <= b.sec GROUP BY ALL"),
    "allpairs_topk_corr": sql(""", p AS (SELECT a.ticker AS a, b.ticker AS b, count(*) AS n, corr(a.lr, b.lr) AS corr FROM ret a JOIN ret b ON a.wk = b.wk AND a.ticker <> b.ticker WHERE a.lr IS NOT NULL AND b.lr IS NOT NULL GROUP BY ALL HAVING count(*) >= 8),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(abs(corr), 9) DESC, b)::INT AS place FROM p) SELECT a, b, n, round(corr, 6) AS corr, place FROM k WHERE place <= 3"""),
    "lead_lag_market": sql(", j AS (SELECT ticker, wk, r, m FROM ret JOIN mkt USING (wk) WHERE r IS NOT NULL), x AS (" + " UNION ALL ".join(f"SELECT ticker, {k} AS k, r, {'lag' if k >= 0 else 'lead'}(m, {abs(k)}) OVER (PARTITION BY ticker ORDER BY wk) AS m FROM j" for k in range(-5, 6))
        + """), c AS (SELECT ticker, k, corr(r, m) AS corr FROM x WHERE m IS NOT NULL GROUP BY ALL) SELECT ticker, k, round(corr, 6) AS corr FROM c QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY round(abs(corr), 9) DESC, abs(k), k) = 1"""),
    "leave_one_out_beta": sql(""", t AS (SELECT ticker, r, (sum(r) OVER (PARTITION BY wk) - r) / nullif(count(r) OVER (PARTITION BY wk) - 1, 0) AS m FROM ret WHERE r IS NOT NULL),
b AS (SELECT ticker, regr_slope(r, m) AS beta, sqrt(greatest(regr_syy(r, m) - pow(regr_sxy(r, m), 2) / regr_sxx(r, m), 0) / (count(r) - 2) / regr_sxx(r, m)) AS se FROM t WHERE m IS NOT NULL GROUP BY ticker),
u AS (SELECT *, greatest(var_samp(beta) OVER () - avg(se * se) OVER (), 0) AS tau, avg(beta) OVER () AS mean FROM b)
SELECT ticker, round(beta, 6) AS beta, round(se, 6) AS se, round(tau / (tau + se * se) * beta + (1 - tau / (tau + se * se)) * mean, 6) AS vasicek FROM u"""),
    "rank_ic_by_date": sql(_IC + " SELECT wk, n, round(ic, 6) AS ic FROM ics"),
    "ic_summary": sql(_IC + " SELECT round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS sd_ic, round(avg(ic) / stddev_samp(ic), 6) AS ir, round(avg(ic) * sqrt(count(ic)) / stddev_samp(ic), 6) AS t, round(avg(CASE WHEN round(ic, 9) > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, count(ic) AS n FROM ics"),
    "quantile_long_short": sql(_PANEL + """, q AS (SELECT wk, fwd, (row_number() OVER (PARTITION BY wk ORDER BY sig, ticker) - 1) AS place, count(*) OVER (PARTITION BY wk) AS n FROM pan),
b AS (SELECT wk, (place * 5 // n)::INT AS bucket, avg(fwd) AS fwd FROM q WHERE n >= 5 GROUP BY ALL) SELECT bucket, round(avg(fwd), 6) AS mean_fwd, round(stddev_samp(fwd), 6) AS sd_fwd, count(*) AS n FROM b GROUP BY bucket"""),
    "fama_macbeth_1f": sql(_PANEL + ", s AS (SELECT wk, regr_slope(fwd, sig) AS slope FROM pan GROUP BY wk HAVING count(*) >= 5) SELECT round(avg(slope), 6) AS premium, round(avg(slope) * sqrt(count(slope)) / stddev_samp(slope), 6) AS t, count(slope) AS n FROM s"),
    "two_way_fe": sql(_PANEL + ", w AS (SELECT " + ", ".join(f"{c} - avg({c}) OVER (PARTITION BY ticker) - avg({c}) OVER (PARTITION BY wk) + avg({c}) OVER () AS {n}" for c, n in (("sig", "x"), ("fwd", "y"))) + " FROM pan) SELECT round(sum(x * y) / sum(x * x), 6) AS slope, count(*) AS n FROM w"),
    "cluster_se": sql(_PANEL + """, f AS (SELECT regr_slope(fwd, sig) AS b, regr_intercept(fwd, sig) AS a, avg(sig) AS mx, regr_sxx(fwd, sig) AS xx FROM pan), u AS (SELECT ticker, wk, (sig - mx) * (fwd - a - b * sig) AS u FROM pan, f),
g AS (SELECT sum(s * s) AS v FROM (SELECT sum(u) AS s FROM u GROUP BY ticker)), d AS (SELECT sum(s * s) AS v FROM (SELECT sum(u) AS s FROM u GROUP BY wk)), e AS (SELECT sum(u * u) AS v FROM u)
SELECT round(b, 6) AS slope, round(sqrt(g.v) / xx, 6) AS se_asset, round(sqrt(d.v) / xx, 6) AS se_date, round(sqrt(greatest(g.v + d.v - e.v, 0)) / xx, 6) AS se_both FROM f, g, d, e"""),
    "backtest_net_cost": sql(_PANEL + """, p AS (SELECT ticker, wk, fwd, sign(sig - quantile_cont(sig, 0.5) OVER (PARTITION BY wk))::DOUBLE AS pos FROM pan), t AS (SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY ticker ORDER BY wk), 0)) AS moved FROM p),
d AS (SELECT wk, avg(pos * fwd) AS gross, avg(moved) AS turnover FROM t GROUP BY wk) SELECT round(avg(gross), 6) AS gross, round(avg(gross - 0.0005 * turnover), 6) AS net, round(avg(turnover), 6) AS turnover, round(avg(gross) / nullif(avg(turnover), 0), 6) AS breakeven FROM d"""),
    "partial_corr_factors": sql(_DEP + " SELECT ticker, driver, n, round(c, 6) AS c, round(t, 6) AS t, round(pcorr, 6) AS pcorr FROM dep"),
    "by_fdr_dependencies": sql(_DEP + f""", p AS (SELECT ticker, driver, round(2 * (1 - {phi_sql('abs(t)')}), 9) AS p FROM dep), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY p, driver)::INT AS place, count(*) OVER (PARTITION BY ticker) AS m FROM p),
l AS (SELECT *, place * 0.10 / (m * (SELECT sum(1.0 / i) FROM generate_series(1, m) AS t(i))) AS line FROM k)
SELECT ticker, driver, round(p, 6) AS p, place, place <= coalesce(max(CASE WHEN p <= line THEN place END) OVER (PARTITION BY ticker), 0) AS passes FROM l"""),
}

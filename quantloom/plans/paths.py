"""Queries of path odds, projections and their scores, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.stats import phi_sql, weighted_tail_sql
from ..operators import paths
from ..sources.panels import by_week, sql, weekly_bars, weekly_returns
from .time_series import rounded

AHEAD, HALF = 4, 3.0
SIGNALS = {"1w": (1, 1.0), "4w": (4, 2.0), "13w": (13, 3.0), "26w": (26, 4.0)}
CADENCE = paths.HORIZONS["cadence"]


def _returns(s: SparkSession, d: str) -> DataFrame:
    return weekly_returns(weekly_bars(s, d))


def _names(s: SparkSession, d: str) -> DataFrame:
    return _returns(s, d).groupBy("ticker").agg(F.max_by("c", "wk").alias("price"), F.avg("lr").alias("mu"), F.stddev_samp("lr").alias("sigma")).where("sigma > 0")


def _quantiles(s: SparkSession, d: str) -> DataFrame:
    t = _names(s, d).withColumn("p", F.explode(F.array(*map(F.lit, (0.1, 0.5, 0.9)))))
    s_, m = F.col("sigma") * math.sqrt(13), F.col("mu") * 13
    return rounded(t.select("ticker", "p", paths.maximum_quantile(F.col("p"), s_, m).alias("drifted"), paths.maximum_quantile(F.col("p"), s_, F.lit(0.0)).alias("driftless")), 5)


def _projection(s: SparkSession, d: str) -> DataFrame:
    ret = _returns(s, d)
    residuals = paths.horizon_residuals(ret, (1, 5, 10))  # beyond, bands come from the deviation
    return rounded(paths.project(ret, CADENCE, residuals, cap_bar=0.5).withColumns({c: F.ln(c) for c in ("low", "high")}))  # at the longest horizons the bounds are huge


def _forecasts(s: SparkSession, d: str) -> DataFrame:
    """Every week's projection four weeks on, from the mean and spread of 26 weeks."""
    w = by_week().rowsBetween(-25, 0)
    leads = [F.lead("c", e).over(by_week()).alias(f"c{e}") for e in range(1, AHEAD + 1)]
    f = _returns(s, d).select("ticker", "wk", F.col("c").alias("price"), F.count("lr").over(w).alias("k"), F.avg("lr").over(w).alias("mean"), F.stddev_samp("lr").over(w).alias("sigma"), *leads).where("k = 26 and sigma > 0")
    return f.select("ticker", "wk", "price", paths.decayed(F.col("mean"), F.lit(HALF), F.lit(AHEAD)).alias("mu"), (F.col("sigma") * math.sqrt(AHEAD)).alias("sd"), F.col(f"c{AHEAD}").alias("realised"), *(f"c{e}" for e in range(1, AHEAD + 1)))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return paths.score(_forecasts(s, d).select("ticker", "wk", "price", "mu", "sd", "realised"))


def _tracked(s: SparkSession, d: str) -> DataFrame:
    on = F.array(*(F.struct(F.lit(e).alias("e"), F.col(f"c{e}").alias("close")) for e in range(1, AHEAD + 1)))
    t = _forecasts(s, d).select("ticker", "wk", "price", "mu", "sd", F.lit(AHEAD).alias("h"), F.explode(on).alias("x")).select("*", "x.e", "x.close").where("close is not null")
    return rounded(paths.track(t, HALF))


def _signals(s: SparkSession, d: str) -> DataFrame:
    t = _returns(s, d).select("ticker", "wk", *((F.col("c") / F.lag("c", k).over(by_week()) - 1).alias(n) for n, (k, _) in SIGNALS.items()), F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("wk").desc())).alias("age")).where("age = 1")
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value"), F.lit(w).alias("weight")) for n, (_, w) in SIGNALS.items()))
    return rounded(paths.contradiction(t.select("ticker", F.explode(each).alias("x")).select("ticker", "x.*"), "ticker"))


QUERIES = {
    "path_report": lambda s, d: rounded(paths.path_report(_names(s, d), CADENCE), 5),
    "maximum_quantiles": _quantiles,
    "horizon_projection": _projection,
    "projection_scores": lambda s, d: rounded(_scored(s, d)),
    "projection_skill": lambda s, d: rounded(paths.skill(_scored(s, d))),
    "path_tracking": _tracked,
    "signal_contradiction": _signals,
}


def _up(b: str, s: str = "s", m: str = "m") -> str:
    return f"least(greatest({phi_sql(f'({m} - {b}) / {s}')} + {weighted_tail_sql(f'({b} + {m}) / {s}', f'2 * {m} * {b} / ({s} * {s})')}, 0), 1)"


def _mean(m: str) -> str:
    x = f"({m} / s)"
    back = f"CASE WHEN abs({x}) < 0.3 THEN (1 - pow({x}, 2) / 6 + pow({x}, 4) / 40 - pow({x}, 6) / 336) / sqrt(2 * pi()) ELSE (2 * {phi_sql(x)} - 1) / (2 * {x}) END"
    return f"({m} * {phi_sql(x)} + s * exp(-{x} * {x} / 2) / sqrt(2 * pi()) + s * ({back}))"


def _polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    return "(" + " + ".join(f"{a!r}::DOUBLE * pow({x}, {len(coefficients) - 1 - i})" for i, a in enumerate(coefficients)) + ")"


def _quantile_sql(p: str) -> str:
    u, d = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    tail = f"{_polynomial(u, stats.QUANTILE_TAIL)} / {_polynomial(u, stats.QUANTILE_TAIL_UNDER)}"
    middle = f"{d} * {_polynomial(f'pow({d}, 2)', stats.QUANTILE_MIDDLE)} / {_polynomial(f'pow({d}, 2)', stats.QUANTILE_MIDDLE_UNDER)}"
    return f"(CASE WHEN least({p}, 1 - {p}) < 0.02425 THEN sign(0.5 - {p}) * {tail} ELSE {middle} END)"


_NAMES = ", nm AS (SELECT ticker, arg_max(c, wk) AS price, avg(lr) AS mu, stddev_samp(lr) AS sigma FROM ret GROUP BY ticker HAVING stddev_samp(lr) > 0)"
_keep = repr(0.5 ** (1 / HALF)) + "::DOUBLE"
_sum = lambda h: f"(1 - pow({_keep}, {h})) / (1 - {_keep})"
_FORECASTS = f""", fc AS (SELECT ticker, wk, c AS price, m * {_sum(AHEAD)} AS mu, s * {math.sqrt(AHEAD)!r}::DOUBLE AS sd, c1, c2, c3, c4 FROM
(SELECT *, count(lr) OVER b AS k, avg(lr) OVER b AS m, stddev_samp(lr) OVER b AS s, {', '.join(f'lead(c, {e}) OVER o AS c{e}' for e in range(1, AHEAD + 1))} FROM ret WINDOW b AS (PARTITION BY ticker ORDER BY wk ROWS 25 PRECEDING), o AS (PARTITION BY ticker ORDER BY wk)) WHERE k = 26 AND s > 0),
sc AS (SELECT *, ln(c4 / price) AS moved, ln(c4 / price) - mu AS err FROM fc)"""
_b, _d, _k = (repr(math.log(x)) + "::DOUBLE" for x in (1.05, 0.95, 1.02))
_drop = "(-(" + _d + "))"
_w = f"2 * m * {_b} / (s * s)"
_below = f"({weighted_tail_sql(f'({_b} + m) / s', _w)} - {weighted_tail_sql(f'(2 * {_b} + m - {_k}) / s', _w)})"
_sums = "\nUNION ALL ".join(f"SELECT ticker, {h} AS h, k, lr, lr_all, CASE WHEN k >= {h} THEN sum(lr) OVER (PARTITION BY ticker ORDER BY wk ROWS {h - 1} PRECEDING) END AS sm FROM o" for h in CADENCE)
ORACLE_SQL = {
    "path_report": sql(_NAMES + f""", t AS (SELECT *, sigma * sqrt(h) AS s, mu * h AS m FROM nm, (SELECT unnest({list(CADENCE)!r}) AS h))
SELECT ticker, h, round(s, 5) AS s, round(m, 5) + 0.0 AS m, round({_mean('m')}, 5) AS favourable, round({_mean('(-m)')}, 5) AS adverse, round(price * exp({_mean('m')}), 5) AS high, round(price * exp(-{_mean('(-m)')}), 5) AS low,
round({_up(_b)}, 5) AS up, round({_up(_drop, m='(-m)')}, 5) AS down, round(least(greatest(({phi_sql(f'(m - {_b}) / s')} + {_below}) / {_up(_b)}, 0), 1), 5) AS above_after_up, round(round(least(pow({_b} / (sigma * 0.6744897501960817), 2), 252), 1), 5) AS median_bars FROM t"""),
    "maximum_quantiles": sql(_NAMES + f""", RECURSIVE_t AS (SELECT ticker, p::DOUBLE AS p, sigma * {math.sqrt(13)!r}::DOUBLE AS s, mu * 13 AS m FROM nm, (SELECT unnest([0.1, 0.5, 0.9]) AS p)),
it AS (WITH RECURSIVE it AS (SELECT 0 AS i, *, 0.0::DOUBLE AS lo, greatest(m, 0) + 12 * s AS hi FROM RECURSIVE_t UNION ALL
  SELECT i + 1, ticker, p, s, m, CASE WHEN less THEN mid ELSE lo END, CASE WHEN less THEN hi ELSE mid END FROM (SELECT *, 1 - CASE WHEN mid <= 0 THEN 1 ELSE {_up('mid')} END < p AS less FROM (SELECT *, (lo + hi) / 2 AS mid FROM it WHERE i < 60))) SELECT * FROM it WHERE i = 60)
SELECT ticker, p, round((lo + hi) / 2, 5) AS drifted, round(s * {_quantile_sql('((1 + p) / 2)')}, 5) AS driftless FROM it""".replace("RECURSIVE_t", "asked")),
    "horizon_projection": sql(f""", o AS (SELECT ticker, wk, c, lr, avg(lr) OVER (PARTITION BY ticker) AS lr_all, row_number() OVER (PARTITION BY ticker ORDER BY wk) AS k, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) AS age, count(*) OVER (PARTITION BY ticker) AS n FROM ret WHERE lr IS NOT NULL),
g AS (SELECT ticker, arg_max(c, wk) AS price, avg(lr) FILTER (WHERE age <= 26) AS edge, 0.5 * sqrt(sum(CASE WHEN age = n THEN pow(0.94, age - 1) ELSE 0.06 * pow(0.94, age - 1) END * lr * lr)) AS slow, stddev_samp(lr) FILTER (WHERE age <= 20) AS plain FROM o GROUP BY ticker),
p AS (SELECT ticker, ln(c) AS p, lag(ln(c)) OVER (PARTITION BY ticker ORDER BY wk) AS b FROM ret), hl AS (SELECT ticker, CASE WHEN count(b) >= 25 AND regr_slope(p - b, b) < 0 THEN least(-ln(2) / regr_slope(p - b, b), 252) END AS hl FROM p WHERE b IS NOT NULL GROUP BY ticker),
sums AS ({_sums}),
v AS (SELECT ticker, h, CASE WHEN count(lr) >= 4 * h THEN var_samp(sm) / (h * var_samp(lr)) END AS vr, count(sm) AS n, quantile_cont(sm - h * lr_all, 0.05) AS ql, quantile_cont(sm - h * lr_all, 0.95) AS qh FROM sums GROUP BY ticker, h),
a AS (SELECT ticker, h, price, slow + coalesce(0.5 * plain, slow) AS sigma, edge, coalesce(hl, 3) AS hl, CASE WHEN vr > 0 THEN vr ELSE 1 END AS vr, h <= 10 AND n >= 8 AS known, ql, qh FROM g JOIN v USING (ticker) LEFT JOIN hl USING (ticker)),
b AS (SELECT *, CASE WHEN h = 1 THEN sigma ELSE sigma * sqrt(h * vr) END AS sd, pow(0.5, 1 / hl) AS keep, greatest(least(edge, 0.5 * sigma), -0.5 * sigma) AS e FROM a), f AS (SELECT *, e * (1 - pow(keep, h)) / (1 - keep) AS free FROM b), m AS (SELECT *, greatest(least(free, 2 * sd), -2 * sd) AS mu FROM f)
SELECT ticker, h, round(price * exp(mu), 6) AS projected, round(mu, 6) + 0.0 AS mu, round(sd, 6) AS sd, round(CASE WHEN sd > 0 THEN mu / sd END, 6) + 0.0 AS z_edge, abs(free) > 2 * sd AS capped, round(ln(price) + mu + CASE WHEN known THEN ql ELSE -sd END, 6) AS low, round(ln(price) + mu + CASE WHEN known THEN qh ELSE sd END, 6) AS high,
CASE WHEN known THEN 'conformal' ELSE 'parametric' END AS band FROM m"""),
    "projection_scores": sql(_FORECASTS + """SELECT ticker, wk, round(price, 6) AS price, round(mu, 6) + 0.0 AS mu, round(sd, 6) AS sd, round(c4, 6) AS realised, round(c4 - price * exp(mu), 6) + 0.0 AS price_error, round(exp(err) - 1, 6) + 0.0 AS pct_error, round(err, 6) + 0.0 AS log_error, round(err / sd, 6) + 0.0 AS z_error,
(mu = 0 AND moved = 0) OR mu * moved > 0 AS direction, round(CASE WHEN abs(mu) > 1e-12 THEN moved / mu END, 6) + 0.0 AS magnitude, round(CASE WHEN abs(moved) > 1e-12 THEN 1 - abs(err) / abs(moved) END, 6) + 0.0 AS skill FROM sc"""),
    "projection_skill": sql(_FORECASTS + """, a AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) AS age FROM sc WHERE err IS NOT NULL)
SELECT ticker, count(*) AS n, round(avg(err / sd), 6) + 0.0 AS bias, count(*) FILTER (WHERE age <= 3 AND err / sd > 1.5) = 3 OR count(*) FILTER (WHERE age <= 3 AND err / sd < -1.5) = 3 AS clustered_miss, round(avg(abs(err)) / avg(abs(moved)), 6) AS mase, round(1 - avg(abs(err)) / avg(abs(moved)), 6) + 0.0 AS skill FROM a GROUP BY ticker"""),
    "path_tracking": sql(_FORECASTS + f""", x AS ({' UNION ALL '.join(f"SELECT ticker, wk, {e} AS e, price * exp(mu * ({_sum(e)}) / ({_sum(AHEAD)})) AS expected, c{e} AS now, sd * sqrt({e / AHEAD}::DOUBLE) AS sp FROM fc WHERE c{e} IS NOT NULL" for e in range(1, AHEAD + 1))}),
g AS (SELECT *, ln(now / expected) AS gap, ln(now / expected) / sp AS z FROM x), q AS (SELECT *, abs(lag(gap) OVER w) - abs(gap) AS raw, abs(lag(z) OVER w) - abs(z) AS zp FROM g WINDOW w AS (PARTITION BY ticker, wk ORDER BY e))
SELECT ticker, wk, e, round(expected, 6) AS expected, round(gap, 6) + 0.0 AS gap, round(z, 6) + 0.0 AS z, round(raw, 6) + 0.0 AS raw_pressure, round(zp, 6) + 0.0 AS z_pressure, CASE WHEN raw > 0 AND zp > 0 THEN 'reverting' WHEN raw < 0 AND zp < 0 THEN 'diverging' WHEN raw IS NOT NULL THEN 'stable' END AS state FROM q"""),
    "signal_contradiction": sql(f""", l AS ({' UNION ALL '.join(f"SELECT ticker, wk, '{n}' AS name, sign(c / lag(c, {k}) OVER (PARTITION BY ticker ORDER BY wk) - 1) AS vote, {w}::DOUBLE AS w FROM ret" for n, (k, w) in SIGNALS.items())}),
v AS (SELECT * FROM l QUALIFY wk = max(wk) OVER (PARTITION BY ticker)), s AS (SELECT ticker, coalesce(sign(sum(vote * w)), 0) AS s FROM v GROUP BY ticker)
SELECT ticker, CASE WHEN count(*) FILTER (WHERE vote <> 0) = 0 THEN 0.0 WHEN any_value(s) = 0 THEN 1.0 ELSE round(1 - sum(w) FILTER (WHERE vote = s) / sum(w) FILTER (WHERE vote <> 0), 2) END AS contradiction,
CASE WHEN count(*) FILTER (WHERE vote <> 0) = 0 THEN 'flat' WHEN any_value(s) = 0 THEN 'mixed' WHEN any_value(s) > 0 THEN 'up' ELSE 'down' END AS direction, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE vote <> 0 AND (s = 0 OR vote <> s)), '') AS against FROM v JOIN s USING (ticker) GROUP BY ticker"""),
}

"""Queries of regressions, and their SQL, which solves each by orthogonal residuals instead of moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regression as reg
from ..operators.cross_section import momentum_panel
from ..sources.panels import by_week, market, sql, weekly_bars, weekly_returns
from .time_series import rounded


def _returns(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ret = weekly_returns(weekly_bars(s, d))
    return ret, market(ret)


def _factors(s: SparkSession, d: str) -> DataFrame:
    """Returns with the market's, and the mean of the others in the asset's group against it; assets alone in theirs have none."""
    ret, mkt = _returns(s, d)
    ret = ret.where("r is not null")
    group = ret.groupBy("sec", "wk").agg(F.sum("r").alias("sr"), F.count("r").alias("k")).where("k > 1")
    others = (F.col("sr") - F.col("r")) / (F.col("k") - 1) - F.col("m")
    return ret.join(mkt, "wk").join(group, ["sec", "wk"]).select("ticker", "wk", "r", "m", others.alias("g"))


def _panel(s: SparkSession, d: str) -> DataFrame:
    bars = weekly_bars(s, d)
    last = bars.select("ticker", "wk", (F.col("c") / F.lag("c").over(by_week()) - 1).alias("rev"))
    return momentum_panel(bars).join(last, ["ticker", "wk"])


def _ridge(s: SparkSession, d: str) -> DataFrame:
    return reg.fit(_factors(s, d), ["ticker"], "r", ["m", "g"], ridge=0.0001).select("ticker", "n", "const", "b_m", "b_g")


QUERIES = {
    "dimson_beta": lambda s, d: rounded(reg.dimson(*_returns(s, d))),
    "har_regression": lambda s, d: rounded(reg.har(_returns(s, d)[0])),
    "residual_alpha_hac": lambda s, d: rounded(reg.fit_hac(_factors(s, d), "r", ["m", "g"])),
    "ridge_regression": lambda s, d: rounded(_ridge(s, d)),
    "fama_macbeth_newey_west": lambda s, d: rounded(reg.fama_macbeth(_panel(s, d), ["sig", "rev"])),
}


def solve(rel: str, by: str, y: str, xs: Sequence[str]) -> str:
    """CTEs ``z<p>`` and ``coef`` (by, n, b_<x>, const, r2): each regressor less its share in those before it, then slopes from
    the last to the first."""
    cols = [*xs, y]
    centred = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {by}) AS {to}_{c}" for c in cols for to in "ec")
    out = f"z0 AS (SELECT {by}, {', '.join(cols)}, {centred} FROM {rel} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)})"
    for p, x in enumerate(xs[:-1]):
        later = ", ".join(f"e_{c} - e_{x} * (sum(e_{x} * e_{c}) OVER g / sum(e_{x} * e_{x}) OVER g) AS e_{c}" for c in xs[p + 1 :])
        out += f", z{p + 1} AS (SELECT * REPLACE ({later}) FROM z{p} WINDOW g AS (PARTITION BY {by}))"
    last, rest = f"z{len(xs) - 1}", f"e_{y}"
    for p, x in reversed(list(enumerate(xs))):
        out += f", y{p} AS (SELECT *, sum(({rest}) * e_{x}) OVER g / sum(e_{x} * e_{x}) OVER g AS b_{x} FROM {last} WINDOW g AS (PARTITION BY {by}))"
        last, rest = f"y{p}", f"{rest} - b_{x} * c_{x}"
    means = " - ".join([f"avg({y})", *(f"any_value(b_{x}) * avg({x})" for x in xs)])
    explained = " + ".join(f"any_value(b_{x}) * covar_pop({x}, {y})" for x in xs)
    return out + f", coef AS (SELECT {by}, count(*) AS n, {means} AS const, {', '.join(f'any_value(b_{x}) AS b_{x}' for x in xs)}, ({explained}) / var_pop({y}) AS r2 FROM {last} GROUP BY {by})"


_FACTORS = """, q AS (SELECT sec, wk, sum(r) AS sr, count(r) AS k FROM ret WHERE r IS NOT NULL GROUP BY ALL HAVING count(r) > 1), f AS (SELECT ticker, wk, r, m, (sr - r) / (k - 1) - m AS g FROM ret JOIN mkt USING (wk) JOIN q USING (sec, wk) WHERE r IS NOT NULL)"""
_lag = lambda c, by, n=4: ", ".join(f"lag({c}, {k}) OVER (PARTITION BY {by} ORDER BY wk) AS {c}_{k}" for k in range(1, n + 1))
_hac = lambda c, n=4: f"sqrt(greatest(sum({c} * {c})" + "".join(f" + {2 * (1 - k / (n + 1))}::DOUBLE * coalesce(sum({c} * {c}_{k}), 0)" for k in range(1, n + 1)) + ", 0))"
_r = lambda *cs: ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cs)
ORACLE_SQL = {
    "dimson_beta": sql(", s AS (SELECT wk, m AS m0, lag(m) OVER (ORDER BY wk) AS m1, lead(m) OVER (ORDER BY wk) AS m2 FROM mkt), j AS (SELECT ticker, r, m0, m1, m2 FROM ret JOIN s USING (wk) WHERE r IS NOT NULL AND m1 IS NOT NULL AND m2 IS NOT NULL), " + solve("j", "ticker", "r", ["m1", "m0", "m2"])
        + ", o AS (SELECT ticker, regr_slope(r, m0) AS beta FROM j GROUP BY ticker) SELECT ticker, round(coalesce(b_m0 + b_m1 + b_m2, beta), 6) AS dimson, round(beta, 6) AS beta, round(2.0 / 3 * beta + 1.0 / 3, 6) AS adjusted FROM coef JOIN o USING (ticker)"),
    "har_regression": sql(""", v AS (SELECT ticker, wk, lr * lr * 1e4 AS d FROM ret WHERE lr * lr > 0), h AS (SELECT ticker, wk, d, avg(d) OVER (o ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS w, avg(d) OVER (o ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS m, lead(d) OVER o AS y, row_number() OVER o AS k, count(*) OVER (PARTITION BY ticker) AS total FROM v WINDOW o AS (PARTITION BY ticker ORDER BY wk)),
j AS (SELECT * FROM h WHERE total >= 30 AND k > 22), """ + solve("j", "ticker", "y", ["d", "w", "m"]) + f", l AS (SELECT ticker, d, w, m FROM j WHERE y IS NULL) SELECT ticker, n, {_r('const', 'b_d', 'b_w', 'b_m', 'r2')}, round(greatest(const + b_d * d + b_w * w + b_m * m, 0), 6) + 0.0 AS forecast FROM coef JOIN l USING (ticker)"),
    "residual_alpha_hac": sql(_FACTORS + ", " + solve("f", "ticker", "r", ["m", "g"]) + f""", p AS (SELECT ticker, regr_slope(m, g) AS mg, regr_slope(g, m) AS gm, avg(m) AS am, avg(g) AS ag, count(*) AS k FROM f GROUP BY ticker),
i AS (SELECT ticker, wk, r - const - b_m * m - b_g * g AS e, m - am - mg * (g - ag) AS wm, g - ag - gm * (m - am) AS wg, am, ag, k, n, r2, const, b_m, b_g FROM f JOIN coef USING (ticker) JOIN p USING (ticker)),
u AS (SELECT *, e * wm / (sum(wm * wm) OVER t) * k AS um, e * wg / (sum(wg * wg) OVER t) * k AS ug FROM i WINDOW t AS (PARTITION BY ticker)), c AS (SELECT *, e - am * um - ag * ug AS uc FROM u), l AS (SELECT *, {_lag('um', 'ticker')}, {_lag('ug', 'ticker')}, {_lag('uc', 'ticker')} FROM c)
SELECT ticker, n, round(any_value(r2), 6) AS r2, round(const, 6) + 0.0 AS const, round(b_m, 6) + 0.0 AS m, round(b_g, 6) + 0.0 AS g, round(const / ({_hac('uc')} / n * sqrt(n / (n - 3.0::DOUBLE))), 6) + 0.0 AS t_const, round(b_m / ({_hac('um')} / n * sqrt(n / (n - 3.0::DOUBLE))), 6) + 0.0 AS t_m, round(b_g / ({_hac('ug')} / n * sqrt(n / (n - 3.0::DOUBLE))), 6) + 0.0 AS t_g FROM l GROUP BY ticker, n, const, b_m, b_g"""),
    "ridge_regression": sql(_FACTORS + """, s AS (SELECT ticker, count(*) AS n, var_pop(m) + 0.0001 AS mm, var_pop(g) + 0.0001 AS gg, covar_pop(m, g) AS mg, covar_pop(m, r) AS mr, covar_pop(g, r) AS gr, avg(r) AS ar, avg(m) AS am, avg(g) AS ag FROM f GROUP BY ticker),
b AS (SELECT *, (mr * gg - gr * mg) / (mm * gg - mg * mg) AS b_m, (gr * mm - mr * mg) / (mm * gg - mg * mg) AS b_g FROM s) SELECT ticker, n, round(ar - b_m * am - b_g * ag, 6) + 0.0 AS const, round(b_m, 6) + 0.0 AS b_m, round(b_g, 6) + 0.0 AS b_g FROM b"""),
    "fama_macbeth_newey_west": sql(", j AS (SELECT * FROM (SELECT wk, c / lag(c, 13) OVER o - 1 AS sig, lead(c, 4) OVER o / c - 1 AS fwd, c / lag(c) OVER o - 1 AS rev FROM bars WINDOW o AS (PARTITION BY ticker ORDER BY wk)) WHERE sig IS NOT NULL AND fwd IS NOT NULL), " + solve("j", "wk", "fwd", ["sig", "rev"])
        + f""", s AS (SELECT wk, 'sig' AS factor, b_sig AS b FROM coef WHERE n >= 8 UNION ALL SELECT wk, 'rev', b_rev FROM coef WHERE n >= 8), u AS (SELECT *, b - avg(b) OVER (PARTITION BY factor) AS u FROM s), l AS (SELECT *, {_lag('u', 'factor')} FROM u)
SELECT factor, count(*) AS dates, round(avg(b), 6) AS premium, round(avg(b) / ({_hac('u')} / count(*)), 6) AS t FROM l GROUP BY factor"""),
}

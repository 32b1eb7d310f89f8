"""Queries of inference on panels, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..operators import panel as p
from ..operators.cross_section import momentum_panel
from ..sources.panels import by_week, market, sql, weekly_bars, weekly_returns
from .regression import _FACTORS as FACTORS_SQL
from .regression import _factors, _hac, solve
from .time_series import rounded

#: Weeks that trend and reversal strategies look back.
BACK = (1, 2, 4, 8, 13, 26)


def _drivers(s: SparkSession, d: str) -> DataFrame:
    """Returns, with the market's, the group's, and the asset's own of the week before."""
    f = _factors(s, d)
    return f.withColumn("own", F.lag("r").over(by_week()))


def _strategies(s: SparkSession, d: str) -> DataFrame:
    """``strategy, wk, x``: the mean return of a week over assets held by the sign of their return over the weeks before, and
    against it, less that of all assets."""
    ret = weekly_returns(weekly_bars(s, d))
    signs = ret.select("ticker", "wk", "r", *(F.signum(F.lag("c", 1).over(by_week()) / F.lag("c", 1 + b).over(by_week()) - 1).alias(f"s{b}") for b in BACK)).where("r is not null")
    each = F.explode(F.array(*(F.struct(F.lit(f"{kind}{b:02d}").alias("strategy"), (sign * F.col(f"s{b}")).alias("side")) for b in BACK for kind, sign in (("trend", 1), ("turn", -1)))))
    held = signs.select("wk", "r", each.alias("e")).select("wk", "r", "e.*").groupBy("strategy", "wk").agg(F.avg(F.col("side") * F.col("r")).alias("held"))
    return held.join(market(ret), "wk").select("strategy", "wk", (F.col("held") - F.col("m")).alias("x"), "held")


def _spans(s: SparkSession, d: str) -> DataFrame:
    return momentum_panel(weekly_bars(s, d)).withColumn("until", F.date_add("wk", 28))


def _purged(s: SparkSession, d: str) -> DataFrame:
    """The slope of the next weeks' return on the signal over the train rows of each fold, and its error on the test rows."""
    f = p.purged_folds(_spans(s, d), "wk", "until", ["ticker"], 5, 14)
    fit = f.where("role = 'train'").groupBy("fold").agg(F.count(F.lit(1)).alias("n_train"), F.regr_slope("fwd", "sig").alias("slope"), F.regr_intercept("fwd", "sig").alias("base"), F.avg("fwd").alias("mean"))
    t = f.where("role = 'test'").join(F.broadcast(fit), "fold")  # a row a fold
    miss, naive = F.col("fwd") - F.col("base") - F.col("slope") * F.col("sig"), F.col("fwd") - F.col("mean")
    return rounded(t.groupBy("fold", "n_train", "slope").agg(F.count(F.lit(1)).alias("n_test"), F.sqrt(F.avg(miss * miss)).alias("rmse"), (1 - ratio(F.sum(miss * miss), F.sum(naive * naive))).alias("skill")))


def _pbo(s: SparkSession, d: str) -> DataFrame:
    return p.cscv(_strategies(s, d), "strategy", "wk", "held", 10)


QUERIES = {
    "lasso_drivers": lambda s, d: rounded(p.lasso(_drivers(s, d), ["ticker"], "r", ["m", "g", "own"])),
    "driscoll_kraay": lambda s, d: rounded(p.driscoll_kraay(momentum_panel(weekly_bars(s, d)).join(weekly_returns(weekly_bars(s, d)).select("ticker", "wk", F.col("r").alias("rev")), ["ticker", "wk"]), "fwd", ["sig", "rev"], "wk", 4)),
    "reality_check": lambda s, d: rounded(p.reality_check(_strategies(s, d), "strategy", "wk", "x")),
    "cscv_splits": lambda s, d: rounded(_pbo(s, d)),
    "overfit_probability": lambda s, d: rounded(_pbo(s, d).agg(F.avg(F.col("overfit").cast("double")).alias("pbo"), F.count(F.lit(1)).alias("splits"))),
    "purged_folds": _purged,
}

_soft = lambda pull: f"sign({pull}) * greatest(abs({pull}) - 0.08::DOUBLE, 0)"
_STRATEGIES = f""", sg AS (SELECT ticker, wk, r, {", ".join(f"sign(lag(c) OVER w / lag(c, {1 + b}) OVER w - 1) AS s{b}" for b in BACK)} FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY wk)),
st AS ({" UNION ALL ".join(f"SELECT '{kind}{b:02d}' AS strategy, wk, avg({sign} * s{b} * r) AS held FROM sg WHERE r IS NOT NULL GROUP BY wk" for b in BACK for kind, sign in (("trend", 1), ("turn", -1)))}),
x AS (SELECT strategy, wk, held - m AS x, held FROM st JOIN mkt USING (wk))"""
_hex = lambda part: f"(('0x' || substr(md5('12345:' || draw || ':' || pos), {1 + 8 * part}, 8))::BIGINT / 4294967296.0::DOUBLE)"
_CSCV = _STRATEGIES + """, dt AS (SELECT wk, row_number() OVER (ORDER BY wk) - 1 AS idx, count(*) OVER () AS total FROM (SELECT DISTINCT wk FROM x WHERE held IS NOT NULL)),
bl AS (SELECT strategy, held, idx // (total // 10) AS block FROM x JOIN dt USING (wk) WHERE held IS NOT NULL),
b AS (SELECT strategy, block, count(*) AS n, sum(held) AS s, sum(held * held) AS q FROM bl WHERE block < 10 GROUP BY strategy, block),
m AS (SELECT split FROM range(1, 1024, 2) AS g(split) WHERE bit_count(split) = 5),
h AS (SELECT split, strategy, (split >> block) & 1 = 1 AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM b, m GROUP BY ALL),
r AS (SELECT split, strategy, inside, CASE WHEN n > 1 AND (q - s * s / n) / (n - 1) > 1e-18 THEN s / n / sqrt((q - s * s / n) / (n - 1)) ELSE 0 END AS sr FROM h),
i AS (SELECT split, arg_min(strategy, {'a': -sr, 'b': strategy}) AS best FROM r WHERE inside GROUP BY split),
k AS (SELECT i.split, best, (SELECT sr FROM r WHERE r.split = i.split AND r.strategy = best AND NOT inside) AS own FROM i),
e AS (SELECT k.split, best, 1 + count(*) FILTER (WHERE sr < own) AS rank, (1 + count(*) FILTER (WHERE sr < own)) / (count(*) + 1.0::DOUBLE) AS share FROM k JOIN r ON r.split = k.split AND NOT inside GROUP BY k.split, best)"""
ORACLE_SQL = {
    "lasso_drivers": sql(FACTORS_SQL + f""", o AS (SELECT *, lag(r) OVER (PARTITION BY ticker ORDER BY wk) AS own FROM f),
zz AS (SELECT ticker, {", ".join(f"coalesce(({c} - avg({c}) OVER t) / CASE WHEN stddev_pop({c}) OVER t > 0 THEN stddev_pop({c}) OVER t ELSE 1 END, 0) AS {c}" for c in ("r", "m", "g", "own"))} FROM o WINDOW t AS (PARTITION BY ticker)),
gm AS (SELECT ticker, count(*) AS n, {", ".join(f"avg({a} * {b}) AS {a}_{b}" for a, b in (("m", "m"), ("g", "g"), ("own", "own"), ("m", "g"), ("m", "own"), ("g", "own"), ("m", "r"), ("g", "r"), ("own", "r")))} FROM zz GROUP BY ticker),
cd AS (WITH RECURSIVE cd AS (SELECT ticker, 0 AS it, 0.0::DOUBLE AS bm, 0.0::DOUBLE AS bg, 0.0::DOUBLE AS bo FROM gm UNION ALL
  SELECT ticker, it + 1, bm2, bg2, CASE WHEN own_own > 0 THEN {_soft('(own_r - m_own * bm2 - g_own * bg2)')} / own_own ELSE 0 END FROM (
    SELECT *, CASE WHEN g_g > 0 THEN {_soft('(g_r - m_g * bm2 - g_own * bo)')} / g_g ELSE 0 END AS bg2 FROM (
      SELECT cd.ticker, it, bg, bo, gm.*, CASE WHEN m_m > 0 THEN {_soft('(m_r - m_g * bg - m_own * bo)')} / m_m ELSE 0 END AS bm2 FROM cd JOIN gm ON cd.ticker = gm.ticker WHERE it < 300))) SELECT * FROM cd WHERE it = 300)
SELECT ticker, n, round(bm, 6) + 0.0 AS b_m, round(bg, 6) + 0.0 AS b_g, round(bo, 6) + 0.0 AS b_own FROM cd JOIN gm USING (ticker)"""),
    "driscoll_kraay": sql(""", j AS (SELECT 1 AS one, * FROM (SELECT wk, c / lag(c, 13) OVER o - 1 AS sig, lead(c, 4) OVER o / c - 1 AS fwd, c / lag(c) OVER o - 1 AS rev FROM bars WINDOW o AS (PARTITION BY ticker ORDER BY wk)) WHERE sig IS NOT NULL AND fwd IS NOT NULL AND rev IS NOT NULL), """ + solve("j", "one", "fwd", ["sig", "rev"])
        + f""", p AS (SELECT regr_slope(sig, rev) AS sr, regr_slope(rev, sig) AS rs, avg(sig) AS a_s, avg(rev) AS a_r, count(*) AS k FROM j),
i AS (SELECT wk, fwd - const - b_sig * sig - b_rev * rev AS e, sig - a_s - sr * (rev - a_r) AS ws, rev - a_r - rs * (sig - a_s) AS wr, a_s, a_r, k FROM j, coef, p),
v AS (SELECT wk, e * ws / (sum(ws * ws) OVER ()) * k AS us, e * wr / (sum(wr * wr) OVER ()) * k AS ur, e, a_s, a_r FROM i),
u AS (SELECT wk, sum(us) AS us, sum(ur) AS ur, sum(e - a_s * us - a_r * ur) AS uc FROM v GROUP BY wk),
l AS (SELECT 1 AS one, *, lag(us, 1) OVER w AS us_1, lag(us, 2) OVER w AS us_2, lag(us, 3) OVER w AS us_3, lag(us, 4) OVER w AS us_4, lag(ur, 1) OVER w AS ur_1, lag(ur, 2) OVER w AS ur_2, lag(ur, 3) OVER w AS ur_3, lag(ur, 4) OVER w AS ur_4, lag(uc, 1) OVER w AS uc_1, lag(uc, 2) OVER w AS uc_2, lag(uc, 3) OVER w AS uc_3, lag(uc, 4) OVER w AS uc_4 FROM u WINDOW w AS (ORDER BY wk)),
s AS (SELECT {_hac('us')} AS ss, {_hac('ur')} AS sr, {_hac('uc')} AS sc FROM l)
SELECT 'const' AS term, round(const, 6) + 0.0 AS b, round(const / (sc / n), 6) + 0.0 AS t FROM coef, s UNION ALL SELECT 'sig', round(b_sig, 6) + 0.0, round(b_sig / (ss / n), 6) + 0.0 FROM coef, s UNION ALL SELECT 'rev', round(b_rev, 6) + 0.0, round(b_rev / (sr / n), 6) + 0.0 FROM coef, s"""),
    "reality_check": sql(_STRATEGIES + f""", dt AS (SELECT wk, row_number() OVER (ORDER BY wk) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT wk FROM x)), y AS (SELECT strategy, idx, n, coalesce(x, 0) AS x FROM x JOIN dt USING (wk)),
mn AS (SELECT strategy, sum(x) / max(n) AS mean, max(n) AS n FROM y GROUP BY strategy),
dr AS (SELECT draw, pos, (SELECT max(n) FROM dt) AS n FROM range(1, 1001) AS a(draw), (SELECT idx AS pos FROM dt)),
du AS (SELECT draw, pos, n, CASE WHEN pos = 0 OR {_hex(0)} < 0.2::DOUBLE THEN {{'at': floor({_hex(1)} * n)::BIGINT, 'f': pos}} END AS s FROM dr),
di AS (SELECT draw, (s.at + pos - s.f) % n AS idx FROM (SELECT draw, pos, n, last_value(s IGNORE NULLS) OVER (PARTITION BY draw ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM du)),
ag AS (SELECT draw, strategy, sum(x) AS s FROM di JOIN y USING (idx) GROUP BY ALL), bs AS (SELECT draw, max(sqrt(n) * (s / n - mean)) AS best FROM ag JOIN mn USING (strategy) GROUP BY draw),
se AS (SELECT count(*) AS k, max(n) AS t, max(sqrt(n) * mean) AS v FROM mn) SELECT k, t, round(v, 6) AS v, round((count(*) FILTER (WHERE best >= v) + 1) / 1001.0, 6) AS p FROM bs, se GROUP BY k, t, v"""),
    "cscv_splits": sql(_CSCV + " SELECT split, best, rank, round(share, 6) AS share, share <= 0.5 AS overfit FROM e"),
    "overfit_probability": sql(_CSCV + " SELECT round(avg((share <= 0.5)::INT), 6) AS pbo, count(*) AS splits FROM e"),
    "purged_folds": sql(""", j AS (SELECT ticker, wk, wk + 28 AS until, sig, fwd FROM (SELECT ticker, wk, c / lag(c, 13) OVER o - 1 AS sig, lead(c, 4) OVER o / c - 1 AS fwd FROM bars WINDOW o AS (PARTITION BY ticker ORDER BY wk)) WHERE sig IS NOT NULL AND fwd IS NOT NULL),
o AS (SELECT *, least((row_number() OVER (ORDER BY wk, ticker) - 1) // (count(*) OVER () // 5), 4) AS own FROM j), t AS (SELECT own AS fold, min(wk) - 14 AS lo, max(until) + 14 AS hi FROM o GROUP BY own),
r AS (SELECT t.fold, o.*, own = fold AS test FROM o, t WHERE own = fold OR wk > hi OR until < lo),
f AS (SELECT fold, count(*) AS n_train, regr_slope(fwd, sig) AS slope, regr_intercept(fwd, sig) AS base, avg(fwd) AS mean FROM r WHERE NOT test GROUP BY fold)
SELECT fold::INT AS fold, n_train, round(slope, 6) AS slope, count(*) AS n_test, round(sqrt(avg((fwd - base - slope * sig) ** 2)), 6) AS rmse, round(1 - sum((fwd - base - slope * sig) ** 2) / sum((fwd - mean) ** 2), 6) AS skill FROM r JOIN f USING (fold) WHERE test GROUP BY fold, n_train, slope"""),
}

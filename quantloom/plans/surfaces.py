"""Queries of options, volatility slices, implied densities and regime paths, and their SQL. Slices are fitted by iteration, which
SQL can't express; tests hold them against planted slices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import phi_sql
from ..operators import lineage
from ..operators import surfaces as sf
from ..operators.calibration import black_scholes
from ..sources.panels import sql, weekly_bars, weekly_returns
from .calibration import _CHAIN, chain
from .time_series import rounded

STEPS = 24


def _strikes(s: SparkSession, d: str) -> DataFrame:
    """The chain with strikes from 1020 to 2000 by the size of the part."""
    return chain(s, d).withColumn("k", 1000.0 + 20.0 * F.col("oi"))


_STRIKES = _CHAIN.replace("floor(p_retailprice / 50) * 50.0 + 50.0 AS k", "1000.0::DOUBLE + 20.0::DOUBLE * p_size AS k")


def _american(s: SparkSession, d: str) -> DataFrame:
    c = _strikes(s, d).withColumns({"r": F.lit(0.04), "q": F.when(F.col("id") % 3 == 0, 0.06).otherwise(0.0)})
    return rounded(sf.binomial(c, STEPS).select("id", "kind", "k", "price"))


def _density(s: SparkSession, d: str) -> DataFrame:
    c = _strikes(s, d)
    calls = black_scholes(c).join(c.select("id", "t", "sigma"), "id").where("kind = 'C'").withColumn("r", F.lit(0.04))
    return rounded(sf.implied_density(calls, ["t", "sigma"]))


def _slices(s: SparkSession, d: str) -> DataFrame:
    """Slices of the chain by time to expiry: the parts' spreads against the log strike over the forward."""
    x = F.round(F.ln(F.col("k") / (F.col("s") * F.exp(0.04 * F.col("t")))), 4)
    q = _strikes(s, d).select("t", x.alias("x"), (F.pow(F.col("sigma") * (1 + 0.4 * x * x - 0.2 * x), 2) * F.col("t")).alias("w"))
    return rounded(sf.calibrate_slices(q, ["t"]), 4)


MOVE = ((0.95, 0.05), (0.10, 0.90))


def _path(s: SparkSession, d: str) -> DataFrame:
    """Calm and wild weeks of each asset: spreads of 0.7 and 1.6 times its own."""
    r = weekly_returns(weekly_bars(s, d)).where("lr is not null").select("ticker", "wk", "lr")
    own = r.groupBy("ticker").agg(F.stddev_pop("lr").alias("sd")).where("sd > 0")
    like = lambda f: -F.ln(F.col("sd") * f) - F.col("lr") * F.col("lr") / (2 * F.pow(F.col("sd") * f, 2.0))
    obs = r.join(own, "ticker").withColumns({"l0": like(0.7), "l1": like(1.6)})
    return rounded(lineage.viterbi(obs, "ticker", "wk", ["l0", "l1"], [math.log(0.5)] * 2, [[math.log(x) for x in row] for row in MOVE]).withColumn("state", F.col("state").cast("long")), 4)


QUERIES = {"american_binomial": _american, "implied_density": _density, "volatility_slices": _slices, "regime_path": _path}

_l = {(i, j): repr(math.log(MOVE[i][j])) + "::DOUBLE" for i in (0, 1) for j in (0, 1)}
_gain = lambda ups, n: f"(side * (s * pow(u, 2.0 * ({ups}) - ({n})) - k))"
ORACLE_SQL = {
    "american_binomial": _STRIKES + f""", c AS (SELECT *, 0.04::DOUBLE AS r, CASE WHEN id % 3 = 0 THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END AS q FROM ch), o AS (SELECT DISTINCT s, k, t, sigma, kind, r, q FROM c),
g AS (SELECT *, exp(sigma * sqrt(t / {STEPS})) AS u, exp(-r * t / {STEPS}) AS fade, CASE kind WHEN 'C' THEN 1 ELSE -1 END AS side FROM o), h AS (SELECT *, (exp((r - q) * t / {STEPS}) - 1 / u) / (u - 1 / u) AS p FROM g),
v AS (WITH RECURSIVE v AS (SELECT *, {STEPS} AS n, list_transform(range(0, {STEPS + 1}), lambda j: greatest({_gain('j', STEPS)}, 0)) AS x FROM h
  UNION ALL SELECT * REPLACE (n - 1 AS n, list_transform(range(0, n), lambda j: greatest(fade * (p * x[j + 2] + (1 - p) * x[j + 1]), {_gain('j', 'n - 1')})) AS x) FROM v WHERE n > 0) SELECT * FROM v WHERE n = 0),
e AS (SELECT *, (ln(s / k) + (r - q + sigma * sigma / 2) * t) / (sigma * sqrt(t)) AS d1 FROM v), f AS (SELECT *, d1 - sigma * sqrt(t) AS d2 FROM e),
y AS (SELECT s, k, t, sigma, kind, r, q, CASE WHEN p > 0 AND p < 1 THEN x[1] WHEN kind = 'C' THEN s * exp(-q * t) * {phi_sql('d1')} - k * exp(-r * t) * {phi_sql('d2')} ELSE k * exp(-r * t) * {phi_sql('(-d2)')} - s * exp(-q * t) * {phi_sql('(-d1)')} END AS price FROM f)
SELECT id, c.kind, c.k, round(price, 6) + 0.0 AS price FROM c JOIN y ON c.s = y.s AND c.k = y.k AND c.t = y.t AND c.sigma = y.sigma AND c.kind = y.kind AND c.r = y.r AND c.q = y.q""",
    "implied_density": _STRIKES + f""", c AS (SELECT t, sigma, k, avg(s * {phi_sql('d1')} - k * fade * {phi_sql('d2')}) AS c FROM de WHERE kind = 'C' GROUP BY ALL),
n AS (SELECT *, k - lag(k) OVER w AS h1, lead(k) OVER w - k AS h2, lag(c) OVER w AS c1, lead(c) OVER w AS c2 FROM c WINDOW w AS (PARTITION BY t, sigma ORDER BY k)),
r AS (SELECT *, exp(0.04::DOUBLE * t) * 2 * (c1 / (h1 * (h1 + h2)) - c / (h1 * h2) + c2 / (h2 * (h1 + h2))) AS raw FROM n WHERE h1 IS NOT NULL AND h2 IS NOT NULL),
p AS (SELECT *, (lead(k) OVER w - k) * (greatest(raw, 0) + lead(greatest(raw, 0)) OVER w) / 2 AS piece FROM r WINDOW w AS (PARTITION BY t, sigma ORDER BY k)),
a AS (SELECT *, sum(piece) OVER g AS area, sum(greatest(-raw, 0)) OVER g AS lost, sum(abs(raw)) OVER g AS mass, count(*) FILTER (WHERE raw < 0) OVER g AS violations FROM p WINDOW g AS (PARTITION BY t, sigma))
SELECT round(t, 6) AS t, round(sigma, 6) AS sigma, k, round(raw, 6) + 0.0 AS raw, round(CASE WHEN area > 0 THEN greatest(raw, 0) / area ELSE greatest(raw, 0) END, 6) + 0.0 AS density, round(coalesce(lost / nullif(mass, 0), 0), 4) AS negative, violations FROM a""",
    "regime_path": sql(f""", x AS (SELECT ticker, wk, lr, stddev_pop(lr) OVER (PARTITION BY ticker) AS sd, row_number() OVER (PARTITION BY ticker ORDER BY wk) AS i FROM (SELECT * FROM ret WHERE lr IS NOT NULL)),
o AS (SELECT ticker, wk, i, -ln(sd * 0.7::DOUBLE) - lr * lr / (2 * (sd * 0.7::DOUBLE) ** 2) AS l0, -ln(sd * 1.6::DOUBLE) - lr * lr / (2 * (sd * 1.6::DOUBLE) ** 2) AS l1 FROM x WHERE sd > 0),
d AS (WITH RECURSIVE d AS (SELECT ticker, i, ln(0.5::DOUBLE) + l0 AS d0, ln(0.5::DOUBLE) + l1 AS d1, -1 AS b0, -1 AS b1 FROM o WHERE i = 1
  UNION ALL SELECT o.ticker, o.i, greatest(d0 + {_l[0, 0]}, d1 + {_l[1, 0]}) + l0, greatest(d0 + {_l[0, 1]}, d1 + {_l[1, 1]}) + l1, CASE WHEN d1 + {_l[1, 0]} > d0 + {_l[0, 0]} THEN 1 ELSE 0 END, CASE WHEN d1 + {_l[1, 1]} > d0 + {_l[0, 1]} THEN 1 ELSE 0 END FROM d JOIN o ON o.ticker = d.ticker AND o.i = d.i + 1) SELECT * FROM d),
e AS (SELECT ticker, max(i) AS n FROM o GROUP BY ticker), z AS (SELECT d.ticker, i, CASE WHEN d1 > d0 THEN 1 ELSE 0 END AS state, greatest(d0, d1) AS best FROM d JOIN e ON d.ticker = e.ticker AND i = n),
p AS (WITH RECURSIVE p AS (SELECT ticker, i, state, best FROM z UNION ALL SELECT p.ticker, p.i - 1, CASE state WHEN 1 THEN b1 ELSE b0 END, best FROM p JOIN d ON d.ticker = p.ticker AND d.i = p.i WHERE p.i > 1) SELECT * FROM p)
SELECT ticker, wk, state::BIGINT AS state, round(best, 4) + 0.0 AS best FROM p JOIN o USING (ticker, i)"""),
}

"""Least squares with several regressors by group, from moments that are combined before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..sources.panels import by_week

#: Share of a regressor's variance that the others must leave, below which a fit is singular.
SINGULAR = 1e-10


def fit(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """``by, n, const, b_<x>, r2, s2``, ``mean_<x>`` and the inverse moments ``inv_<x>_<z>`` for each group.

    One aggregate of centred moments, then elimination over columns; rows with a null in ``y`` or ``xs`` don't count. ``ridge``
    is added to the mean squares of the regressors. Singular groups, and those with no more rows than coefficients, have null
    coefficients. No constant is penalised.
    """
    k = len(xs)
    whole = df.dropna(subset=[y, *xs])
    moments = [F.covar_pop(xs[i], xs[j]).alias(f"_m{i}_{j}") for i in range(k) for j in range(i, k)] + [F.covar_pop(x, y).alias(f"_m{i}_{k}") for i, x in enumerate(xs)]
    t = whole.groupBy(*by).agg(F.count(y).alias("n"), F.avg(y).alias("_y"), F.var_pop(y).alias("_yy"), *(F.avg(x).alias(f"mean_{x}") for x in xs), *moments)
    full = {f"_a{i}_{j}": F.col(f"_m{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0) for i in range(k) for j in range(k)}
    full |= {f"_a{i}_{k}": F.col(f"_m{i}_{k}") for i in range(k)} | {f"_a{i}_{k + 1 + j}": F.lit(float(i == j)) for i in range(k) for j in range(k)}
    t = t.withColumns(full)
    for p in range(k):
        t = t.withColumn("_p", F.when((F.col(f"_a{p}_{p}") > SINGULAR * F.col(f"_m{p}_{p}")) & (F.col("n") > k + 1), F.col(f"_a{p}_{p}")))
        t = t.withColumns({f"_a{p}_{j}": F.col(f"_a{p}_{j}") / F.col("_p") for j in range(2 * k + 1)})
        t = t.withColumns({f"_a{r}_{j}": F.col(f"_a{r}_{j}") - F.col(f"_a{r}_{p}") * F.col(f"_a{p}_{j}") for r in range(k) if r != p for j in range(2 * k + 1)})
    slope = [F.col(f"_a{i}_{k}") for i in range(k)]
    left = F.greatest(F.col("_yy") - 2 * sum(b * F.col(f"_m{i}_{k}") for i, b in enumerate(slope)) + sum(a * b * F.col(f"_m{min(i, j)}_{max(i, j)}") for i, a in enumerate(slope) for j, b in enumerate(slope)), F.lit(0.0))
    left = F.when(slope[0].isNotNull(), left)
    return t.select(
        *by, "n", (F.col("_y") - sum(b * F.col(f"mean_{x}") for b, x in zip(slope, xs, strict=True))).alias("const"), *(b.alias(f"b_{x}") for b, x in zip(slope, xs, strict=True)),
        (1 - ratio(left, F.col("_yy"))).alias("r2"), (left * F.col("n") / (F.col("n") - k - 1)).alias("s2"), *(f"mean_{x}" for x in xs), *(F.col(f"_a{i}_{k + 1 + j}").alias(f"inv_{x}_{z}") for i, x in enumerate(xs) for j, z in enumerate(xs)),
    )


def long_run(u: str, lags: int) -> Column:
    """Sum of squares of a series with its Bartlett-weighted neighbours; ``<u>_<k>`` are its lags."""
    return F.sum(F.col(u) * F.col(u)) + sum(2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col(u) * F.col(f"{u}_{k}")), F.lit(0.0)) for k in range(1, lags + 1))


def fit_hac(df: DataFrame, y: str, xs: Sequence[str], lags: int = 4) -> DataFrame:
    """``ticker, n, r2`` and each coefficient with its Newey-West t, by asset: each week's influence on a coefficient is a series,
    whose long-run sum of squares is the coefficient's variance."""
    coef = fit(df, ["ticker"], y, xs)
    t = df.dropna(subset=[y, *xs]).join(coef, "ticker")
    e = F.col(y) - F.col("const") - sum(F.col(f"b_{x}") * F.col(x) for x in xs)
    pull = {x: sum(F.col(f"inv_{x}_{z}") * (F.col(z) - F.col(f"mean_{z}")) for z in xs) for x in xs}
    t = t.withColumns({"u_const": e * (1 - sum(F.col(f"mean_{x}") * pull[x] for x in xs)), **{f"u_{x}": e * pull[x] for x in xs}})
    names = ["const", *xs]
    t = t.withColumns({f"u_{c}_{k}": F.lag(f"u_{c}", k).over(by_week()) for c in names for k in range(1, lags + 1)})
    value = {c: F.first("const" if c == "const" else f"b_{c}") for c in names}
    free = F.count(y) - len(names)
    se = {c: F.sqrt(F.greatest(long_run(f"u_{c}", lags), F.lit(0.0)) * ratio(F.count(y), free)) / F.count(y) for c in names}  # small samples have fewer free rows
    return t.groupBy("ticker").agg(F.count(y).alias("n"), F.first("r2").alias("r2"), *(value[c].alias(c) for c in names), *(ratio(value[c], se[c]).alias(f"t_{c}") for c in names))


def dimson(ret: DataFrame, mkt: DataFrame) -> DataFrame:
    """Sum of the joint slopes on the market of the week before, the same and the week behind (the single slope where these can't be
    told apart); the single slope; and that shrunk by a third to one."""
    w = Window.orderBy("wk")
    shifted = mkt.select("wk", F.col("m").alias("m0"), F.lag("m").over(w).alias("m1"), F.lead("m").over(w).alias("m2"))  # one row a week
    t = ret.join(shifted, "wk").dropna(subset=["r", "m0", "m1", "m2"])
    one = t.groupBy("ticker").agg(F.regr_slope("r", "m0").alias("beta"))
    return fit(t, ["ticker"], "r", ["m1", "m0", "m2"]).join(one, "ticker").select("ticker", F.coalesce(F.col("b_m1") + F.col("b_m0") + F.col("b_m2"), "beta").alias("dimson"), "beta", (2 / 3 * F.col("beta") + 1 / 3).alias("adjusted"))


def har(ret: DataFrame, least: int = 30) -> DataFrame:
    """The next week's realised variance on this week's and the means over five and twenty-two weeks, in one regression, with
    the forecast behind the last week (not below zero). Weeks without movement don't count."""
    v = ret.where("lr * lr > 0").select("ticker", "wk", (F.col("lr") * F.col("lr") * 1e4).alias("d"))
    mean = lambda n: F.avg("d").over(by_week().rowsBetween(1 - n, 0))
    t = v.withColumns({"w": mean(5), "m": mean(22), "y": F.lead("d").over(by_week()), "k": F.row_number().over(by_week()), "all": F.count("d").over(Window.partitionBy("ticker"))})
    t = t.where((F.col("all") >= least) & (F.col("k") > 22))
    coef = fit(t, ["ticker"], "y", ["d", "w", "m"]).select("ticker", "n", "const", "b_d", "b_w", "b_m", "r2")
    ahead = F.greatest(F.col("const") + F.col("b_d") * F.col("d") + F.col("b_w") * F.col("w") + F.col("b_m") * F.col("m"), F.lit(0.0))
    return coef.join(t.where("y is null").select("ticker", "d", "w", "m"), "ticker").select("ticker", "n", "const", "b_d", "b_w", "b_m", "r2", ahead.alias("forecast"))


def fama_macbeth(panel: DataFrame, xs: Sequence[str], lags: int = 4, least: int = 8) -> DataFrame:
    """Slopes of ``fwd`` on all of ``xs`` for each date; their mean and its Newey-West t, a row for each regressor. The table of
    slopes has one row a date."""
    s = fit(panel, ["wk"], "fwd", xs).where(F.col("n") >= least).select("wk", F.explode(F.array(*(F.struct(F.lit(x).alias("factor"), F.col(f"b_{x}").alias("b")) for x in xs))).alias("s"))
    s = s.select("wk", "s.factor", "s.b").where("b is not null").withColumn("u", F.col("b") - F.avg("b").over(Window.partitionBy("factor")))
    s = s.withColumns({f"u_{k}": F.lag("u", k).over(Window.partitionBy("factor").orderBy("wk")) for k in range(1, lags + 1)})
    se = F.sqrt(F.greatest(long_run("u", lags), F.lit(0.0))) / F.count("b")
    return s.groupBy("factor").agg(F.count("b").alias("dates"), F.avg("b").alias("premium"), ratio(F.avg("b"), se).alias("t"))

"""Rules by which forecasts become a rank: shrinkage, haircuts, costs, and how many bets a cross-section really holds.

The rules are columns; nulls pass through unless a rule says otherwise. A missing haircut takes nothing away.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp, ratio


def known(x: Column, otherwise: Column) -> Column:
    """``x``, or the other where it is null or NaN."""
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), otherwise)


def toward_zero(x: Column, by: Column) -> Column:
    """An edge made smaller on its own side, which may cross zero; a missing or negative haircut is none."""
    cut = F.greatest(known(by, F.lit(0.0)), F.lit(0.0))
    return F.when(x >= 0, x - cut).otherwise(x + cut)


def expected_return(ic: Column, sigma: Column, z: Column) -> Column:
    """Skill times volatility times score."""
    return ic * sigma * z


def forecast_error(residual: Column, x: Column, mean: Column, sxx: Column, n: Column) -> Column:
    """The standard error of a fitted line at ``x``; null from under three points or without spread."""
    return F.when((residual > 0) & (sxx > 0) & (n >= 3), residual * F.sqrt(1 / n + (x - mean) * (x - mean) / sxx))


def conviction_sigma(base: Column, z: Column, floor: float = 0.2, full: float = 1.5) -> Column:
    """A deviation that grows as the score fades, five times at most."""
    return base / clamp(F.abs(z) / full, floor, 1.0)


def deflated(z: Column, tests: Column) -> Column:
    """The part of a score beyond what the largest of so many would reach by chance."""
    return F.when(tests >= 2, F.signum(z) * F.greatest(F.abs(z) - F.sqrt(2 * F.ln(tests)), F.lit(0.0))).otherwise(z)


def shrunk(x: Column, se: Column, tau2: Column, center: Column) -> tuple[Column, Column, Column]:
    """Mean, deviation and weight of the normal posterior; as it is where either variance is unusable."""
    usable = (se > 0) & (tau2 > 0)
    w = F.when(usable, tau2 / (tau2 + se * se)).otherwise(1.0)
    return F.when(usable, center + w * (x - center)).otherwise(x), F.when(usable, F.sqrt(w) * se).when(se > 0, se).otherwise(0.0), w


def trading_cost(volatility: Column, half_spread_bps: Column | None = None, fee_bps: float = 2.0, participation: float = 0.05, impact: float = 0.1) -> Column:
    """Percent for a round trip: fees, half-spreads (a twentieth of the volatility where unknown) and a square-root impact."""
    v = F.when(known(volatility, F.lit(0.0)) != 0, volatility).otherwise(2.0)
    spread = 0.05 * v if half_spread_bps is None else F.coalesce(half_spread_bps / 100, 0.05 * v)
    return 2 * (fee_bps / 100 + spread) + impact * math.sqrt(max(participation, 0.0)) * v


def faded(mu: Column, horizon: Column, half: Column) -> Column:
    """An edge after a holding time; unfaded where half-life or time are unknown or negative."""
    return F.when((half > 0) & (horizon >= 0), mu * F.pow(F.lit(0.5), horizon / half)).otherwise(mu)


def held(before: Column, now: Column, band: float) -> Column:
    """The value before, unless the new one moved beyond the band."""
    return F.when(F.abs(now - known(before, F.lit(None).cast("double"))) <= max(band, 0.0), before).otherwise(now)


def smoothed(before: Column, now: Column, share: float) -> Column:
    """The share of the new value and the rest of the one before; the new one where there is none before."""
    return known(share * now + (1 - share) * before, now)


def empirical_bayes(names: DataFrame, by: str, value: str, se: str) -> DataFrame:
    """Estimates drawn to their cross-section's mean by how much of its variance is noise: adds ``tau2, mu, sd, weight``.

    The variance between names is that of the estimates less the mean squared error, zero from under three names. Two sums a
    group are joined back, so that a group isn't one task."""
    e = F.when(F.col(se) > 0, F.col(se) * F.col(se))
    t = names.withColumn(value, F.nanvl(F.col(value), F.lit(None).cast("double")))
    g = t.groupBy(F.col(by).alias("_by")).agg(F.avg(value).alias("_center"), F.when(F.count(value) >= 3, F.greatest(F.var_samp(value) - F.coalesce(F.avg(e), F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("tau2"))
    t = t.join(g, F.col(by).eqNullSafe(F.col("_by")))
    mu, sd, w = shrunk(F.col(value), F.col(se), F.col("tau2"), F.col("_center"))
    return t.select(*names.columns, "tau2", mu.alias("mu"), sd.alias("sd"), w.alias("weight"))


def composite_rank(names: DataFrame, before: DataFrame | None = None, k: float = 0.5, share: float = 1.0) -> DataFrame:
    """The board's score from ``ticker, total, z, sigma, se``: the total less ``k`` errors (or deviations by conviction where no
    error is known), discounted for the number of names tried, smoothed with the score of the run before (``ticker, score``)."""
    tests = F.count(F.lit(1)).over(Window.partitionBy())  # one row a name
    error = F.when(known(F.col("se"), F.lit(0.0)) > 0, F.col("se")).otherwise(conviction_sigma(F.col("sigma"), F.col("z")))
    t = names.withColumn("_bar", F.sqrt(2 * F.ln(tests.cast("double"))))
    soft = F.when(F.col("_bar") > 0, F.least(F.abs("z") / F.col("_bar"), F.lit(1.0))).otherwise(1.0)
    t = t.withColumn("fresh", toward_zero(F.col("total"), k * error) * soft).drop("_bar")
    if before is None:
        return t.withColumn("score", F.col("fresh"))
    t = t.join(before.where("ticker is not null").groupBy(F.col("ticker").alias("_t")).agg(F.max("score").alias("_s")), F.col("ticker") == F.col("_t"), "left")
    return t.withColumn("score", smoothed(F.col("_s"), F.col("fresh"), share)).drop("_t", "_s")


def effective_breadth(n: Column, rho: Column) -> Column:
    """Independent bets among ``n`` names of one correlation; one at least."""
    r = clamp(known(rho, F.lit(0.0)), 0.0, 0.999)
    return F.when(n >= 1, F.greatest(n / (1 + (n - 1) * r), F.lit(1.0))).otherwise(1.0)


def entropy_bets(parts: DataFrame, by: str, weight: str) -> DataFrame:
    """The number of bets by the entropy of a group's weights; negative and missing ones are none, one bet without any."""
    x = F.greatest(known(F.col(weight), F.lit(0.0)), F.lit(0.0))
    g = parts.select(by, x.alias("_x")).groupBy(by).agg(F.sum("_x").alias("_s"), F.sum(F.when(F.col("_x") > 0, F.col("_x") * F.ln("_x"))).alias("_e"))
    return g.select(by, F.when(F.col("_s") > 0, F.exp(F.ln("_s") - ratio(F.col("_e"), F.col("_s")))).otherwise(1.0).alias("bets"))

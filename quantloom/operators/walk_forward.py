"""Calibration of forecasts over several steps, walked forward with an embargo between what fits and what is scored."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp, density, phi

#: The normal quantiles of a central 90 and 95 percent, the share of samples that calibrates, the least numbers of
#: samples in all, of each fold, of a regime's own quantiles, the tolerance of coverage, and the terms of Kolmogorov's series.
Z90, Z95, SHARE, LEAST, LEAST_FOLD, LEAST_REGIME, TOLERANCE, TERMS = 1.6448536269514722, 1.959964, 0.6, 30, 15, 20, 0.05, 49


def _place(n: Column, share: float, up: bool) -> Column:
    """The place of a split-conformal order statistic among ``n``."""
    at = share * (n + 1)
    return F.least(n, F.greatest(F.lit(1), F.ceil(at) if up else F.floor(at)))


def samples(panel: DataFrame, key: str, at: str, value: str, regime: str, steps: Sequence[int], window: int = 26) -> DataFrame:
    """``key, steps, j, fold, y, mu, sigma, regime, m``: for each horizon and date the sum of the next values, its mean and spread by the
    ``window`` values before, and the fold (``cal``, ``test``, or null in the embargo of ``steps`` samples at either side of the cut).

    Missing values are left out before dates are counted; a null key takes no part; equal dates come by value. Too short series have no rows.
    """
    p = panel.where(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    p = p.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(value).cast("double").alias("x"), F.col(regime).alias("regime"))
    order = Window.partitionBy("key").orderBy("at", "x")
    before, whole = order.rowsBetween(-window, -1), Window.partitionBy("key")
    ahead = F.array(*(F.struct(F.lit(n).alias("steps"), F.sum("x").over(order.rowsBetween(0, n - 1)).alias("y")) for n in steps))
    t = p.select("key", "regime", (F.row_number().over(order) - 1 - window).alias("j"), F.count(F.lit(1)).over(whole).alias("t"), F.avg("x").over(before).alias("mean"), F.coalesce(F.var_samp("x").over(before), F.lit(0.0)).alias("var"), ahead.alias("ahead"))
    t = t.where("j >= 0").select("key", "regime", "j", "t", "mean", "var", F.inline("ahead"))
    n, m = F.col("steps"), F.col("t") - F.col("steps") + 1 - window
    t = t.withColumn("m", m).where((F.col("j") < F.col("m")) & (F.col("t") >= window + 3 * n + 20) & (F.col("m") >= LEAST))
    t = t.withColumn("cut", F.floor(F.col("m") * SHARE)).where((F.col("cut") - n >= LEAST_FOLD) & (F.col("m") - F.col("cut") - n >= LEAST_FOLD))
    fold = F.when(F.col("j") < F.col("cut") - n, "cal").when(F.col("j") >= F.col("cut") + n, "test")
    return t.select("key", "steps", "j", fold.alias("fold"), "y", (n * F.col("mean")).alias("mu"), F.sqrt(F.greatest(n * F.col("var"), F.lit(1e-12))).alias("sigma"), "regime", "m")


def _scored(t: DataFrame, alpha: float) -> DataFrame:
    """Both folds with the quantiles of the studentized errors of the first: pooled, symmetric and the regime's own."""
    t = t.where("fold is not null").withColumn("e", (F.col("y") - F.col("mu")) / F.col("sigma"))
    one, fold, own = Window.partitionBy("key", "steps"), Window.partitionBy("key", "steps", "fold"), Window.partitionBy("key", "steps", "regime", "fold")
    cal = F.col("fold") == "cal"
    t = t.withColumns({
        "by_e": F.row_number().over(fold.orderBy("e")), "by_abs": F.row_number().over(fold.orderBy(F.abs("e"))), "by_own": F.row_number().over(own.orderBy("e")),
        "n": F.count(F.lit(1)).over(fold), "n_own": F.when(F.col("regime").isNotNull(), F.count(F.lit(1)).over(own)),
    })
    pick = lambda rank, n, share, up, x="e": F.when(cal & (F.col(rank) == _place(F.col(n), share, up)), F.col(x))
    t = t.withColumns({
        "q_lo": F.max(pick("by_e", "n", alpha / 2, False)).over(one), "q_hi": F.max(pick("by_e", "n", 1 - alpha / 2, True)).over(one),
        "q_sym": F.max(F.abs(pick("by_abs", "n", 1 - alpha, True))).over(one), "n_cal": F.max(F.when(cal, F.col("n"))).over(one),
    })
    both = Window.partitionBy("key", "steps", "regime")
    enough = F.col("n_own") >= LEAST_REGIME
    return t.withColumns({
        "own_lo": F.max(F.when(enough, pick("by_own", "n_own", alpha / 2, False))).over(both), "own_hi": F.max(F.when(enough, pick("by_own", "n_own", 1 - alpha / 2, True))).over(both),
        "own_cal": F.max(F.when(cal, F.col("n_own"))).over(both),
    })


def _inside(low: Column, high: Column) -> Column:
    return F.col("e").between(low, high).cast("double")


def calibrate_horizons(panel: DataFrame, key: str, at: str, value: str, regime: str, steps: Sequence[int], window: int = 26, alpha: float = 0.10) -> DataFrame:
    """One row for each series and horizon: the quantiles of the calibrating fold, and on the other fold coverage (conformal band, with
    Wilson's interval; normal; symmetric; by regimes' own quantiles), the normal CRPS, the band's interval score and width, and how
    far the PIT values are from uniform.

    Everything is windows over one series and horizon, so a panel is shuffled once and the series of an asset must fit a task. For rules on
    missing values see ``samples``; a missing regime takes the pooled quantiles."""
    t = _scored(samples(panel, key, at, value, regime, steps, window), alpha).where("fold = 'test'")
    u = phi(F.col("e"))
    t = t.withColumn("u", u).withColumn("by_u", F.row_number().over(Window.partitionBy("key", "steps").orderBy("u")))
    e, s, n = F.col("e"), F.col("sigma"), F.col("n")
    low, high = F.col("q_lo"), F.col("q_hi")
    width = (high - low) * s
    score = width + 2 / alpha * s * (F.greatest(low - e, F.lit(0.0)) + F.greatest(e - high, F.lit(0.0)))
    crps = s * (e * (2 * phi(e) - 1) + 2 * density(e) - 1 / math.sqrt(math.pi))
    out = t.groupBy("key", "steps", "n", "n_cal", "q_lo", "q_hi", "q_sym").agg(
        F.avg(_inside(low, high)).alias("coverage"), F.avg(_inside(F.lit(-Z90), F.lit(Z90))).alias("coverage_normal"), F.avg(_inside(-F.col("q_sym"), F.col("q_sym"))).alias("coverage_symmetric"),
        F.avg(_inside(F.coalesce("own_lo", low), F.coalesce("own_hi", high))).alias("coverage_regime"), F.avg(crps).alias("crps"), F.avg(score).alias("interval_score"), F.avg(width).alias("width"),
        F.max(F.greatest(F.abs(F.col("by_u") / n - F.col("u")), F.abs(F.col("u") - (F.col("by_u") - 1) / n))).alias("ks"),
    )
    p, z2 = F.col("coverage"), Z95 * Z95
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    out = out.withColumns({"wilson_lo": F.greatest(middle - half, F.lit(0.0)), "wilson_hi": F.least(middle + half, F.lit(1.0)), "lam": (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * F.col("ks")})
    term = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * F.col("lam") * F.col("lam"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.lit(0.0), lambda total, k: total + term(k))
    target = 1 - alpha
    return out.select(
        F.col("key").alias(key), "steps", "n", "n_cal", "q_lo", "q_hi", (F.col("q_sym") - Z90).alias("pad"), "coverage", "wilson_lo", "wilson_hi", "coverage_normal", "coverage_symmetric", "coverage_regime", "crps", "interval_score", "width", "ks",
        clamp(2 * series, 0.0, 1.0).alias("ks_p"), F.sqrt(math.log(2 / 0.05) / (2 * n)).alias("dkw"), F.lit(target).between(F.col("wilson_lo"), F.col("wilson_hi")).alias("calibrated"), (F.abs(p - target) <= TOLERANCE).alias("within_tolerance"),
    )


def regime_quantiles(panel: DataFrame, key: str, at: str, value: str, regime: str, steps: Sequence[int], window: int = 26, alpha: float = 0.10) -> DataFrame:
    """``key, steps, regime, n_cal, q_lo, q_hi, n, coverage, coverage_pooled`` for each regime with ``LEAST_REGIME`` calibrating samples: its own
    quantiles, and what they and the pooled ones cover of its other fold (null without samples there)."""
    t = _scored(samples(panel, key, at, value, regime, steps, window), alpha).where("own_lo is not null and regime is not null")
    test = F.col("fold") == "test"
    own, pooled = _inside(F.col("own_lo"), F.col("own_hi")), _inside(F.col("q_lo"), F.col("q_hi"))
    out = t.groupBy("key", "steps", "regime", "own_cal", "own_lo", "own_hi").agg(F.count_if(test).alias("n"), F.avg(F.when(test, own)).alias("coverage"), F.avg(F.when(test, pooled)).alias("coverage_pooled"))
    return out.select(F.col("key").alias(key), "steps", "regime", F.col("own_cal").alias("n_cal"), F.col("own_lo").alias("q_lo"), F.col("own_hi").alias("q_hi"), "n", "coverage", "coverage_pooled")

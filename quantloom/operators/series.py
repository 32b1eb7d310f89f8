"""Rules over one asset's series that need no loop: reversion, trend, runs, falls and what holders earned.

Prices that are null or not positive are left out first. Everything is a window over an asset's bars and an aggregate that
combines before it shuffles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..sources.panels import by_week
from .time_series import newest_first


def priced(bars: DataFrame) -> DataFrame:
    return bars.where("ticker is not null and c > 0")


def reversion(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 21), least: int = 30) -> DataFrame:
    """The log price as a process that is drawn to a mean: persistence with its error (held within one), speed, mean, half-life,
    whether it reverts beyond doubt, the last price's distance in stationary deviations, and the return expected over the
    horizons. A persistence of zero or less reverts at once: its speed is infinite and it has no half-life. Assets of under
    ``least`` bars, or of one price only, have no row."""
    x = F.ln("c")
    t = priced(bars).select("ticker", "wk", x.alias("y"), F.lag(x).over(by_week()).alias("x"))
    g = t.groupBy("ticker").agg(
        F.count("x").alias("m"), F.max_by("y", "wk").alias("last"), F.avg(F.when(F.col("x").isNotNull(), F.col("y"))).alias("my"), F.avg("x").alias("mx"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"),
    ).where((F.col("m") >= least - 1) & (F.col("sxx") > 0))
    slope = F.col("sxy") / F.col("sxx")
    g = g.select("ticker", "last", slope.alias("free"), (F.col("my") - slope * F.col("mx")).alias("c"), (F.greatest(F.col("syy") - slope * F.col("sxy"), F.lit(0.0)) / (F.col("m") - 2)).alias("s2"), "sxx")
    phi = F.greatest(F.least("free", F.lit(0.9999)), F.lit(-0.9999))
    g = g.select("ticker", "last", phi.alias("phi"), "c", "s2", F.sqrt(F.col("s2") / F.col("sxx")).alias("se"))
    g = g.select("ticker", "last", "phi", "se", F.when(F.col("phi") > 0, -F.ln("phi")).otherwise(float("inf")).alias("speed"), (F.col("c") / (1 - F.col("phi"))).alias("mean"), F.sqrt(F.col("s2") / (1 - F.col("phi") * F.col("phi"))).alias("spread"))
    drift = [((F.col("mean") - F.col("last")) * (1 - F.exp(-F.col("speed") * h))).alias(f"drift_{h}") for h in horizons]
    return g.select("ticker", "phi", "se", "speed", F.exp("mean").alias("mean_price"), F.when(F.col("phi") > 0, math.log(2) / F.col("speed")).alias("half_life"), (1 - F.col("phi") > 1.96 * F.col("se")).alias("reverts"), F.when(F.col("spread") > 0, (F.col("last") - F.col("mean")) / F.col("spread")).otherwise(0.0).alias("z"), *drift)


def velocity(bars: DataFrame, span: int = 21, recent: int = 60, least: int = 26) -> DataFrame:
    """The last step of the log price's exponential mean and its change, in deviations of the recent returns; null from fewer bars.

    The mean is seeded with the first bar, so that its last values are weighted sums of one aggregate."""
    a = 2 / (span + 1)
    p = F.ln("c")
    t = priced(bars).select("ticker", "wk", p.alias("p"), (p - F.lag(p).over(by_week())).alias("r"), (F.row_number().over(newest_first()) - 1).alias("age"), F.count("c").over(Window.partitionBy("ticker")).alias("n"))

    def mean(back: int) -> Column:
        age = F.col("age") - back
        weight = F.when(F.col("age") == F.col("n") - 1, F.pow(F.lit(1 - a), age)).otherwise(a * F.pow(F.lit(1 - a), age))
        return F.sum(F.when(age >= 0, weight * F.col("p")))

    g = t.groupBy("ticker").agg(F.max("n").alias("n"), *(mean(k).alias(f"e{k}") for k in range(3)), F.stddev_samp(F.when(F.col("age") < recent, F.col("r"))).alias("sd"))
    step, before = F.col("e0") - F.col("e1"), F.col("e1") - F.col("e2")
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-9)
    return g.select("ticker", F.when(F.col("n") >= least, step / sd).alias("velocity"), F.when(F.col("n") >= least, (step - before) / sd).alias("acceleration"))


def falls(bars: DataFrame) -> DataFrame:
    """Each stretch below the peak so far: its first bar, its lowest (the first, if several), the depth, and the bar that was back
    at the peak with the bars since the lowest; null while it lasts."""
    before = by_week().rowsBetween(Window.unboundedPreceding, 0)
    t = priced(bars).select("ticker", "wk", "c", F.max("c").over(before).alias("peak"), F.row_number().over(by_week()).alias("i"))
    t = t.withColumn("d", F.col("c") / F.col("peak") - 1).withColumn("k", F.sum(F.when(F.col("d") >= 0, 1).otherwise(0)).over(before))
    low = F.col("d") < 0
    g = t.groupBy("ticker", "k").agg(F.min("i").alias("top"), F.min("wk").alias("top_wk"), F.min(F.when(low, F.col("wk"))).alias("start"), F.min(F.when(low, F.struct("d", "wk", "i"))).alias("low"))
    then = Window.partitionBy("ticker").orderBy("k")
    g = g.withColumn("recovery", F.lead("top_wk").over(then)).withColumn("bars", F.lead("top").over(then) - F.col("low.i"))
    return g.where("start is not null").select("ticker", "start", F.col("low.wk").alias("trough"), F.col("low.d").alias("depth"), "recovery", "bars")


def total_return(bars: DataFrame, dividends: DataFrame, base: float = 100.0) -> DataFrame:
    """The index of a holder who reinvests: closes with the cash (``ticker, wk, cash``; several of a bar add up) of their bar. Cash
    on bars without a price is left out. ``price_index`` is the same without cash."""
    paid = dividends.groupBy("ticker", "wk").agg(F.sum("cash").alias("cash"))
    t = priced(bars).join(paid, ["ticker", "wk"], "left").withColumn("b", F.lag("c").over(by_week()))
    grown = F.coalesce(F.ln((F.col("c") + F.coalesce("cash", F.lit(0.0))) / F.col("b")), F.lit(0.0))
    first = F.first("c").over(by_week())
    return t.select("ticker", "wk", (base * F.exp(F.sum(grown).over(by_week()))).alias("total_index"), (base * F.col("c") / first).alias("price_index"))


def trend(bars: DataFrame, efficiency: int = 10, short: int = 10, long: int = 42, decay: float = 0.85) -> DataFrame:
    """By asset at its last bar: the net move against the path (efficiency; zero from fewer bars), an exponentially weighted mean
    return, and the chance that the regime of volatility shifts, from the log ratio of short to long deviations; null from fewer
    bars or without moves."""
    p = F.ln("c")
    t = priced(bars).select("ticker", "c", (p - F.lag(p).over(by_week())).alias("r"), F.abs(F.col("c") - F.lag("c").over(by_week())).alias("step"), (F.row_number().over(newest_first()) - 1).alias("age"))
    sd = lambda k: F.stddev_samp(F.when(F.col("age") < k - 1, F.col("r")))
    weight = F.pow(F.lit(decay), F.col("age"))
    at = lambda k: F.max(F.when(F.col("age") == k, F.col("c")))
    g = t.groupBy("ticker").agg(F.count("c").alias("n"), F.abs(at(0) - at(efficiency)).alias("net"), F.sum(F.when(F.col("age") < efficiency, F.col("step"))).alias("path"), ratio(F.sum(weight * F.col("r")), F.sum(F.when(F.col("r").isNotNull(), weight))).alias("drift"), sd(short).alias("short"), sd(long).alias("long"))
    gap = F.abs(F.ln(F.col("short") / F.col("long")))
    flip = F.when((F.col("n") >= long) & (F.col("short") > 0) & (F.col("long") > 0), F.round(1 / (1 + F.exp(-(gap - 0.4) / 0.25)), 2))
    return g.select("ticker", F.when(F.col("n") > efficiency, F.coalesce(ratio(F.col("net"), F.col("path")), F.lit(0.0))).otherwise(0.0).alias("efficiency"), F.coalesce("drift", F.lit(0.0)).alias("drift"), flip.alias("flip"))


def runs(df: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """Runs of equal states by key in order: how many, the mean and the longest length, by state, and whether the key's last run
    is of it and how long. A null state ends a run and has none."""
    own = Window.partitionBy(key).orderBy(at)
    t = df.withColumn("_new", F.when(F.col(state).eqNullSafe(F.lag(state).over(own)) & (F.row_number().over(own) > 1), 0).otherwise(1))
    t = t.withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    g = t.groupBy(key, "_run", state).agg(F.count(F.lit(1)).alias("_n"))
    g = g.withColumn("_last", F.max("_run").over(Window.partitionBy(key))).where(F.col(state).isNotNull())
    return g.groupBy(key, state).agg(F.count(F.lit(1)).alias("runs"), F.avg("_n").alias("mean_length"), F.max("_n").alias("longest"), F.max(F.when(F.col("_run") == F.col("_last"), F.col("_n")).otherwise(0)).alias("current"))


def trailing(df: DataFrame, key: str, at: str, flag: str) -> DataFrame:
    """For each row, how many true flags in a row end there; zero where the flag is false or null."""
    own = Window.partitionBy(key).orderBy(at)
    t = df.select(key, at, flag, F.row_number().over(own).alias("_i"))
    broke = F.max(F.when(F.coalesce(flag, F.lit(False)), 0).otherwise(F.col("_i"))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return t.select(key, at, flag, (F.col("_i") - broke).cast("long").alias("run"))

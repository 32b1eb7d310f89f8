"""Odds along a path, projections over several horizons, and how forecasts fared on the way and at their end.

Everything is in log returns: ``s`` is a horizon's deviation, ``m`` its drift, barriers and levels are logs of their ratio to
the start. Missing inputs give missing results; a deviation of zero or less is a path that is its drift.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp, density, normal_quantile, phi, ratio, weighted_tail
from ..sources.panels import by_week
from .time_series import half_life, newest_first

#: Bars ahead of the named sets of horizons.
HORIZONS = {"cadence": (1, 5, 10, 21, 63), "fib": (1, 2, 3, 5, 8, 13, 21, 34, 55), "powers": (1, 2, 4, 8, 16)}
LONGEST_TOUCH = 252.0


def touch_up(b: Column, s: Column, m: Column) -> Column:
    """Chance that the path's maximum reaches ``b``; certain where it starts there."""
    reached = phi((m - b) / s) + weighted_tail((b + m) / s, 2 * m * b / (s * s))
    return F.when(b <= 0, 1.0).when(s <= 0, 0.0).when(reached.isNotNull(), clamp(reached, 0.0, 1.0))


def touch_down(b: Column, s: Column, m: Column) -> Column:
    """Chance that the path's minimum falls to ``b``."""
    return touch_up(-b, s, -m)


def mean_maximum(s: Column, m: Column) -> Column:
    """The mean of the path's maximum, in closed form: the drift's part, the spread's part, and the part of paths that came back."""
    x = m / s
    small = 1 - x * x / 6 + F.pow(x, 4) / 40 - F.pow(x, 6) / 336
    back = F.when(F.abs(x) < 0.3, small / math.sqrt(2 * math.pi)).otherwise((2 * phi(x) - 1) / (2 * x))
    return F.when(s <= 0, F.greatest(m, F.lit(0.0))).otherwise(m * phi(x) + s * density(x) + s * back)


def mean_minimum(s: Column, m: Column) -> Column:
    """The mean depth of the path's minimum, as a positive number."""
    return mean_maximum(s, -m)


def maximum_quantile(p: Column, s: Column, m: Column, halvings: int = 60) -> Column:
    """The quantile of the path's maximum: in closed form without a drift, else by halving its distribution."""

    def halve(x: Column, _: Column) -> Column:
        mid = (x["lo"] + x["hi"]) / 2
        low = 1 - touch_up(mid, s, m) < p
        return F.struct(F.when(low, mid).otherwise(x["lo"]).alias("lo"), F.when(low, x["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), (F.greatest(m, F.lit(0.0)) + 12 * s).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve, lambda x: (x["lo"] + x["hi"]) / 2)
    inner = F.when(s <= 0, F.greatest(m, F.lit(0.0))).when(F.abs(m) < 1e-15, s * normal_quantile((1 + p) / 2)).otherwise(found)
    return F.when(s.isNotNull() & m.isNotNull() & p.isNotNull(), inner)


def ends_above_after_touch(b: Column, k: Column, s: Column, m: Column) -> Column:
    """Chance to end at ``k`` or above, given that ``b`` was touched; by reflection, with the drift's weight."""
    weight = 2 * m * b / (s * s)
    below = weighted_tail((b + m) / s, weight) - weighted_tail((2 * b + m - k) / s, weight)
    both = F.when(k > b, phi((m - k) / s)).otherwise(phi((m - b) / s) + below)
    touched = touch_up(b, s, m)
    still = F.when((m >= b) & (m >= k), 1.0).otherwise(0.0)
    return F.when(s <= 0, still).when(b <= 0, phi((m - k) / s)).when(touched <= 0, 0.0).when(both.isNotNull(), clamp(ratio(both, touched), 0.0, 1.0))


def median_touch(start: Column, barrier: Column, sigma: Column) -> Column:
    """Bars until half of the driftless paths have touched the barrier, a year at most; null for no price or no spread."""
    bars = F.pow(F.abs(F.ln(barrier / start)) / (sigma * 0.6744897501960817), 2)  # the quantile at 0.75
    return F.when((start > 0) & (barrier > 0) & (sigma > 0), F.round(F.least(bars, F.lit(LONGEST_TOUCH)), 1))


def path_report(names: DataFrame, horizons: tuple[int, ...], up: float = 1.05, down: float = 0.95, level: float = 1.02) -> DataFrame:
    """For each asset (``ticker, price, mu, sigma`` a bar) and horizon: mean excursions as returns and prices, odds to touch the
    barriers (shares of the price), bars to the upper one, and the chance to end above the level after touching it."""
    t = names.withColumn("h", F.explode(F.array(*map(F.lit, horizons))))
    t = t.withColumn("s", F.col("sigma") * F.sqrt("h")).withColumn("m", F.col("mu") * F.col("h"))
    s, m, price = F.col("s"), F.col("m"), F.col("price")
    b, d, k = (F.lit(math.log(x)) for x in (up, down, level))
    return t.select(
        "ticker", "h", "s", "m", mean_maximum(s, m).alias("favourable"), mean_minimum(s, m).alias("adverse"), (price * F.exp(mean_maximum(s, m))).alias("high"), (price * F.exp(-mean_minimum(s, m))).alias("low"),
        touch_up(b, s, m).alias("up"), touch_down(d, s, m).alias("down"), ends_above_after_touch(b, k, s, m).alias("above_after_up"), median_touch(price, price * up, F.col("sigma")).alias("median_bars"),
    )


def ends_above(level: Column, price: Column, mu: Column, sigma: Column) -> Column:
    """Chance of a close above the level for a log-normal horizon; null without a spread."""
    return F.when(sigma > 0, 1 - phi((F.ln(level / price) - mu) / sigma))


def decayed(edge: Column, half: Column, h: Column) -> Column:
    """The sum of an edge over ``h`` bars that fades by half every ``half`` bars; none of it outlives a half-life of zero."""
    keep = F.when(half > 0, F.pow(F.lit(0.5), 1 / half)).otherwise(0.0)
    return F.when(h <= 0, 0.0).when(F.abs(1 - keep) < 1e-12, edge * h).otherwise(edge * (1 - F.pow(keep, h)) / (1 - keep))


def blended_sigma(ret: DataFrame, window: int = 20, decay: float = 0.94, share: float = 0.5) -> DataFrame:
    """A bar's deviation by asset: an exponential mean of squares seeded with the first, and the sample deviation of the last bars."""
    t = ret.where("lr is not null").withColumn("age", F.row_number().over(newest_first()) - 1).withColumn("n", F.count("lr").over(Window.partitionBy("ticker")))
    weight = F.when(F.col("age") == F.col("n") - 1, F.pow(F.lit(decay), F.col("age"))).otherwise((1 - decay) * F.pow(F.lit(decay), F.col("age")))
    g = t.groupBy("ticker").agg(F.sqrt(F.sum(weight * F.col("lr") * F.col("lr"))).alias("slow"), F.stddev_samp(F.when(F.col("age") < window, F.col("lr"))).alias("plain"))
    return g.select("ticker", (share * F.col("slow") + (1 - share) * F.coalesce("plain", "slow")).alias("sigma"))


def horizon_residuals(ret: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """``ticker, h, residual``: the return over each run of h bars less h times the asset's mean return."""
    mean = F.avg("lr").over(Window.partitionBy("ticker"))
    own = ret.where("lr is not null").select("ticker", F.row_number().over(by_week()).alias("k"), *((F.sum("lr").over(by_week().rowsBetween(1 - h, 0)) - h * mean).alias(f"s{h}") for h in horizons))
    each = F.array(*(F.struct(F.lit(h).alias("h"), F.when(F.col("k") >= h, F.col(f"s{h}")).alias("residual")) for h in horizons))
    return own.select("ticker", F.explode(each).alias("x")).select("ticker", "x.h", "x.residual").where("residual is not null")


def project(ret: DataFrame, horizons: tuple[int, ...], residuals: DataFrame | None = None, recent: int = 26, z: float = 1.0, most: float = 2.0, cap_bar: float | None = None, fallback: float = 3.0, alpha: float = 0.9, least: int = 8) -> DataFrame:
    """Each asset's projection from its last close over the horizons: the mean return of the recent bars, capped to ``cap_bar``
    deviations of a bar, fading with the asset's half-life and capped to ``most`` deviations of the horizon. The deviation
    follows the variance ratio, with the square root of time where there are fewer than four horizons of bars. Bands come from
    the residuals (``ticker, h, residual``) where there are ``least`` of them, else from the deviation. Assets without a return
    have no row."""
    own = ret.where("lr is not null")
    sums = own.select("ticker", "wk", "c", "lr", F.row_number().over(by_week()).alias("k"), F.row_number().over(newest_first()).alias("age"), *(F.sum("lr").over(by_week().rowsBetween(1 - h, 0)).alias(f"s{h}") for h in horizons))
    vr = F.array(*(F.struct(F.lit(h).alias("h"), F.when(F.count("lr") >= 4 * h, ratio(F.var_samp(F.when(F.col("k") >= h, F.col(f"s{h}"))), h * F.var_samp("lr"))).alias("vr")) for h in horizons))
    g = sums.groupBy("ticker").agg(F.max_by("c", "wk").alias("price"), F.avg(F.when(F.col("age") <= recent, F.col("lr"))).alias("edge"), vr.alias("vr"))
    g = g.join(blended_sigma(ret), "ticker").join(half_life(ret).select("ticker", "half_life"), "ticker", "left")
    edge = F.col("edge") if cap_bar is None else F.greatest(F.least(F.col("edge"), cap_bar * F.col("sigma")), -cap_bar * F.col("sigma"))
    t = g.select("ticker", "price", "sigma", edge.alias("edge"), F.coalesce("half_life", F.lit(fallback)).alias("half"), F.explode("vr").alias("v")).select("*", "v.h", F.when(F.col("v.vr") > 0, F.col("v.vr")).otherwise(1.0).alias("vr"))
    t = t.withColumn("sd", F.when(F.col("h") <= 1, F.col("sigma")).otherwise(F.col("sigma") * F.sqrt(F.col("h") * F.col("vr")))).withColumn("free", decayed(F.col("edge"), F.col("half"), F.col("h")))
    t = t.withColumn("mu", F.greatest(F.least("free", most * F.col("sd")), -most * F.col("sd")))
    if residuals is None:
        t = t.withColumns({"n": F.lit(0), "q_low": F.lit(None).cast("double"), "q_high": F.lit(None).cast("double")})
    else:
        q = residuals.where("residual is not null").groupBy("ticker", "h").agg(F.count("residual").alias("n"), F.percentile("residual", (1 - alpha) / 2).alias("q_low"), F.percentile("residual", (1 + alpha) / 2).alias("q_high"))
        t = t.join(q, ["ticker", "h"], "left")
    known = F.coalesce(F.col("n") >= least, F.lit(False))
    low, high = F.when(known, F.col("q_low")).otherwise(-z * F.col("sd")), F.when(known, F.col("q_high")).otherwise(z * F.col("sd"))
    center = F.ln("price") + F.col("mu")
    return t.select("ticker", "h", F.exp(center).alias("projected"), "mu", "sd", F.when(F.col("sd") > 0, F.col("mu") / F.col("sd")).alias("z_edge"), (F.abs("free") > most * F.col("sd")).alias("capped"), F.exp(center + low).alias("low"), F.exp(center + high).alias("high"), F.when(known, "conformal").otherwise("parametric").alias("band"))


def score(forecasts: DataFrame) -> DataFrame:
    """Forecasts (``price, mu, sd, realised``) with their errors in price, percent, logs and deviations, whether the direction was
    right, the share of the move that was foreseen, and the skill against the last price. Unrealised ones have null scores."""
    moved, mu = F.ln(F.col("realised") / F.col("price")), F.col("mu")
    error = moved - mu
    return forecasts.select(
        "*", (F.col("realised") - F.col("price") * F.exp(mu)).alias("price_error"), (F.exp(error) - 1).alias("pct_error"), error.alias("log_error"), F.when(F.col("sd") > 0, error / F.col("sd")).alias("z_error"),
        (((mu == 0) & (moved == 0)) | (mu * moved > 0)).alias("direction"), F.when(F.abs(mu) > 1e-12, moved / mu).alias("magnitude"), F.when(F.abs(moved) > 1e-12, 1 - F.abs(error) / F.abs(moved)).alias("skill"),
    )


def skill(scored: DataFrame, last: int = 3, beyond: float = 1.5) -> DataFrame:
    """By asset, over realised forecasts: their number, the mean error in deviations, whether the last ones all missed far to the
    same side, and one minus the mean error over that of the last price."""
    newest = Window.partitionBy("ticker").orderBy(F.col("z_error").isNull(), F.col("wk").desc())
    t = scored.where("log_error is not null").withColumn("age", F.row_number().over(newest))
    tail = lambda c: F.count(F.when((F.col("age") <= last) & c, 1)) == last
    mase = ratio(F.avg(F.abs("log_error")), F.avg(F.abs(F.col("log_error") + F.col("mu"))))
    return t.groupBy("ticker").agg(F.count("log_error").alias("n"), F.avg("z_error").alias("bias"), (tail(F.col("z_error") > beyond) | tail(F.col("z_error") < -beyond)).alias("clustered_miss"), mase.alias("mase"), (1 - mase).alias("skill"))


def track(paths: DataFrame, half: float = 3.0) -> DataFrame:
    """Forecasts on their way (``ticker, wk, price, mu, sd, h``, and ``e`` bars on, ``close``): the price that the fading edge
    expects by then (the target at the end), the gap to it, and whether raw and scaled gap both shrank since the bar before."""
    e, h = F.col("e"), F.col("h")
    share = ratio(decayed(F.lit(1.0), F.lit(half), e), decayed(F.lit(1.0), F.lit(half), h))
    t = paths.withColumn("expected", F.col("price") * F.exp(F.coalesce(share, F.lit(0.0)) * F.col("mu"))).withColumn("gap", F.ln(F.col("close") / F.col("expected")))
    t = t.withColumn("z", F.when(F.col("sd") > 0, F.col("gap") / (F.col("sd") * F.sqrt(e / h))))
    before = Window.partitionBy("ticker", "wk").orderBy("e")
    raw, scaled = F.abs(F.lag("gap").over(before)) - F.abs("gap"), F.abs(F.lag("z").over(before)) - F.abs("z")
    state = F.when((raw > 0) & (scaled > 0), "reverting").when((raw < 0) & (scaled < 0), "diverging").when(raw.isNotNull() & scaled.isNotNull(), "stable")
    return t.select("ticker", "wk", "e", "expected", "gap", "z", raw.alias("raw_pressure"), scaled.alias("z_pressure"), state.alias("state"))


def contradiction(signals: DataFrame, key: str) -> DataFrame:
    """Signals (``name, value, weight`` by key) against the sign of their weighted votes: the weight that disagrees, the
    direction, and who disagrees. Missing and zero values don't vote; without a vote a key is flat, at a draw all disagree."""
    v = signals.withColumn("vote", F.signum(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))))
    total = v.groupBy(key).agg(
        F.sum(F.col("vote") * F.col("weight")).alias("sum"), F.sum(F.when(F.col("vote") != 0, F.col("weight"))).alias("all"), F.sum(F.when(F.col("vote") > 0, F.col("weight")).otherwise(0.0)).alias("plus"),
        F.sort_array(F.collect_list(F.when(F.col("vote") != 0, F.struct("name", "vote")))).alias("who"),
    )
    s = F.signum("sum")
    agree = F.when(s > 0, F.col("plus")).otherwise(F.col("all") - F.col("plus"))
    share = F.when(F.col("all").isNull(), 0.0).when(s == 0, 1.0).otherwise(F.round(1 - agree / F.col("all"), 2))
    against = F.transform(F.filter("who", lambda x: (s == 0) | (x["vote"] != s)), lambda x: x["name"])
    return total.select(key, share.alias("contradiction"), F.when(F.col("all").isNull(), "flat").when(s == 0, "mixed").when(s > 0, "up").otherwise("down").alias("direction"), F.array_join(against, ",").alias("against"))

"""Tests of significance: exact tails, forecasts compared, random walks, stationarity, barriers, implied volatility."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ERF, ERF_P, clamp, phi, ratio
from ..sources.panels import by_week


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's t with a whole number of degrees of freedom: its finite series in the angle."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    cos2, odd = F.cos(angle) * F.cos(angle), df % 2 == 1
    terms = F.floor(F.when(odd, (df - 1) / 2).otherwise(df / 2)).cast("int")
    step = lambda j: F.when(odd, 2.0 * j / (2.0 * j + 1)).otherwise((2.0 * j - 1) / (2.0 * j))
    add = lambda s, j: F.struct((s["term"] * step(j) * cos2).alias("term"), (s["sum"] + s["term"] * step(j) * cos2).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.greatest(terms - 1, F.lit(1))), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), add, lambda s: s["sum"])
    series = F.when(terms > 1, series).when(terms == 1, 1.0).otherwise(0.0)
    inside = F.when(odd, 2 / math.pi * (angle + F.sin(angle) * F.cos(angle) * series)).otherwise(F.sin(angle) * series)
    return clamp(1 - inside, 0.0, 1.0)


def binomial_at_least(k: Column, n: Column, p: float = 0.5) -> Column:
    """P(X >= k) of a binomial count, summed over logarithms so that long samples don't underflow."""
    log_odds = math.log(p / (1 - p))
    start = F.struct((n * math.log(1 - p)).alias("log"), F.when(k <= 0, F.exp(n * math.log(1 - p))).otherwise(0.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        log = s["log"] + F.ln((n - i + 1) / i) + log_odds
        return F.struct(log.alias("log"), (s["sum"] + F.when(i >= k, F.exp(log)).otherwise(0.0)).alias("sum"))

    return clamp(F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, add, lambda s: s["sum"]), 0.0, 1.0)


def beats_market(ret: DataFrame, mkt: DataFrame) -> DataFrame:
    """Weeks in which an asset beats the market, and the chance of as many by coin."""
    t = ret.where("r is not null").join(mkt, "wk").groupBy("ticker").agg(F.count_if(F.col("r") > F.col("m")).alias("k"), F.count("r").alias("n"))
    return t.withColumn("p", binomial_at_least(F.col("k"), F.col("n")))


def step_up(tests: DataFrame, p: str, tie: str, q: float = 0.10) -> DataFrame:
    """Benjamini-Hochberg over all tests: those up to the last p-value under its line pass. One row a test, few by nature."""
    everything = Window.partitionBy()
    t = tests.withColumn("place", F.row_number().over(Window.orderBy(p, tie))).withColumn("m", F.count(F.lit(1)).over(everything))
    last = F.max(F.when(F.col(p) <= F.col("place") * q / F.col("m"), F.col(p))).over(everything)
    return t.withColumn("cut", F.coalesce(last, F.lit(-1.0))).withColumn("passes", F.col(p) <= F.col("cut")).drop("m")


def diebold_mariano(losses: DataFrame, h: int = 1, least: int = 8) -> DataFrame:
    """Two forecasts' losses ``a, b`` by asset: mean difference, the statistic with autocovariances up to ``h - 1``, its
    small-sample correction and two-sided p (negative: ``a`` loses less)."""
    own = Window.partitionBy("ticker")
    t = losses.dropna(subset=["a", "b"]).withColumn("d", F.col("a") - F.col("b")).withColumn("u", F.col("d") - F.avg("d").over(own))
    t = t.withColumns({f"u{k}": F.lag("u", k).over(by_week()) for k in range(1, h)})
    n, flat = F.count("d"), F.avg(F.col("u") * F.col("u"))
    both = flat + sum((2 * F.coalesce(F.sum(F.col("u") * F.col(f"u{k}")), F.lit(0.0)) / n for k in range(1, h)), F.lit(0.0))
    lrv = F.when(both > 0, both).when(flat > 0, flat).otherwise(1e-12)
    g = t.groupBy("ticker").agg(n.alias("n"), F.avg("d").alias("mean"), lrv.alias("lrv")).where(F.col("n") >= least)
    g = g.withColumn("dm", F.col("mean") / F.sqrt(F.col("lrv") / F.col("n")))
    g = g.withColumn("dm_star", F.col("dm") * F.sqrt(F.greatest((F.col("n") + 1 - 2 * h + h * (h - 1) / F.col("n")) / F.col("n"), F.lit(1e-9))))
    return g.select("ticker", "n", "mean", "dm", "dm_star", t_two_sided(F.col("dm_star"), F.col("n") - 1).alias("p"))


def least_track_record(ret: DataFrame, against: float = 0.0, share: float = 0.95) -> DataFrame:
    """Weeks a Sharpe ratio needs to exceed the benchmark with the given confidence; none where it doesn't exceed it."""
    t = ret.where("r is not null").groupBy("ticker").agg(ratio(F.avg("r"), F.stddev_samp("r")).alias("sr"), F.skewness("r").alias("g3"), (F.kurtosis("r") + 3).alias("g4"))
    spread = 1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") * F.col("sr")
    weeks = 1 + spread * F.pow(NormalDist().inv_cdf(share) / (F.col("sr") - against), F.lit(2))
    return t.select("ticker", "sr", F.when((F.col("sr") > against) & (spread > 0), weeks).alias("weeks"))


def variance_ratios(ret: DataFrame, qs: tuple[int, ...] = (2, 5, 10, 21)) -> DataFrame:
    """Variance ratio at each horizon with its heteroskedasticity-robust z, and by asset the joint test of the greatest."""
    own = Window.partitionBy("ticker")
    t = ret.where("lr is not null").select("ticker", "wk", "lr", (F.col("lr") - F.avg("lr").over(own)).alias("e"))
    t = t.withColumn("e2", F.col("e") * F.col("e"))
    t = t.withColumns({f"x{j}": F.lag("e2", j).over(by_week()) for j in range(1, max(qs))})
    t = t.withColumns({f"s{q}": F.when(F.row_number().over(by_week()) >= q, F.sum("e").over(by_week().rowsBetween(1 - q, 0))) for q in qs})
    g = t.groupBy("ticker").agg(F.count("e").alias("n"), F.sum("e2").alias("ss"), *(F.sum(F.col("e2") * F.col(f"x{j}")).alias(f"d{j}") for j in range(1, max(qs))), *(F.sum(F.col(f"s{q}") * F.col(f"s{q}")).alias(f"v{q}") for q in qs))
    n = F.col("n")

    def one(q: int) -> Column:
        vr = F.col(f"v{q}") / (q * (n - q + 1) * (1 - q / n)) / (F.col("ss") / n)
        theta = sum((2 * (q - j) / q) ** 2 * F.coalesce(F.col(f"d{j}"), F.lit(0.0)) for j in range(1, q)) / (F.col("ss") * F.col("ss"))
        return F.struct(F.lit(q).alias("q"), vr.alias("vr"), ((vr - 1) / F.sqrt(theta)).alias("z"), (n >= 4 * q).alias("long"))

    g = g.where("ss > 0").select("ticker", F.explode(F.array(*map(one, qs))).alias("x")).select("ticker", "x.*").where("long").drop("long")
    g = g.withColumn("p", 2 * (1 - phi(F.abs("z"))))
    return g.withColumn("p_joint", 1 - F.pow(2 * phi(F.max(F.abs("z")).over(own)) - 1, F.count("z").over(own)))


def kpss(bars: DataFrame, least: int = 25) -> DataFrame:
    """Stationarity of the log close around its level: partial sums against the long-run variance, whose number of lags grows
    with the series. One asset's weeks are an array."""
    t = bars.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("wk", F.ln("c").alias("x")))).alias("xs")).select("ticker", F.col("xs.x").alias("x"), F.size("xs").alias("n")).where(F.col("n") >= least)
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.col("n")
    t = t.withColumn("mean", mean).withColumn("u", F.transform("x", lambda v: v - F.col("mean"))).withColumn("lags", F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int"))
    moved = lambda j: F.aggregate(F.zip_with(F.slice("u", j + 1, F.col("n") - j), F.slice("u", F.lit(1), F.col("n") - j), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) / F.col("n")
    lrv = moved(F.lit(0)) + F.aggregate(F.sequence(F.lit(1), "lags"), F.lit(0.0), lambda s, j: s + 2 * (1 - j / (F.col("lags") + 1)) * moved(j))
    walk = F.aggregate("u", F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("ss")), lambda s, v: F.struct((s["at"] + v).alias("at"), (s["ss"] + (s["at"] + v) * (s["at"] + v)).alias("ss")), lambda s: s["ss"])
    t = t.select("ticker", "n", (walk / (F.col("n") * F.col("n") * F.greatest(lrv, F.lit(1e-300)))).alias("eta"))
    return t.select("ticker", F.col("n").cast("long").alias("n"), "eta", (F.col("eta") > 0.463).alias("rejects"))  # 0.463: the 5 % value


def first_passage(a: Column, mu: Column, sigma: Column) -> Column:
    """Chance that the running maximum of a drifting walk (whole drift and deviation over the horizon) reaches ``a``."""
    up = phi((mu - a) / sigma) + F.exp(F.least(2 * mu * a / (sigma * sigma), F.lit(700.0))) * phi((-mu - a) / sigma)
    return F.when(a <= 0, 1.0).when(sigma <= 0, 0.0).otherwise(clamp(up, 0.0, 1.0))


def bridge_touch(x0: Column, x1: Column, barrier: Column, variance: Column) -> Column:
    """Chance that a path between two log prices crosses an upper barrier on its way."""
    return F.when(barrier <= F.greatest(x0, x1), 1.0).when(variance <= 0, 0.0).otherwise(F.exp(-2 * (barrier - x0) * (barrier - x1) / variance))


def barriers(ret: DataFrame, ahead: int = 13, move: float = 0.05) -> DataFrame:
    """By asset, the chances to touch a barrier above and below within the weeks ahead, the median and the mean of the driftless
    running maximum, and the mean chance that a past week's path crossed the barrier above its start between two closes."""
    own = Window.partitionBy("ticker")
    t = ret.where("lr is not null").withColumn("v", F.var_samp("lr").over(own))
    crossed = bridge_touch(F.lit(0.0), F.col("lr"), F.lit(math.log1p(move)), F.col("v"))
    g = t.groupBy("ticker").agg((F.avg("lr") * ahead).alias("mu"), (F.stddev_samp("lr") * math.sqrt(ahead)).alias("sd"), F.avg(crossed).alias("bridge"))
    mu, sd = F.col("mu"), F.col("sd")
    return g.select("ticker", first_passage(F.lit(math.log1p(move)), mu, sd).alias("up"), first_passage(F.lit(-math.log1p(-move)), -mu, sd).alias("down"), (sd * NormalDist().inv_cdf(0.75)).alias("median_max"), (sd * math.sqrt(2 / math.pi)).alias("mean_max"), "bridge")


def _phi(x: np.ndarray) -> np.ndarray:
    """``phi`` of stats over arrays."""
    x = x / math.sqrt(2)
    t = 1 / (1 + ERF_P * np.abs(x))
    poly = np.zeros_like(t)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return 0.5 * (1 + np.sign(x) * (1 - poly * np.exp(-x * x)))


def _halved(s: np.ndarray, k: np.ndarray, t: np.ndarray, price: np.ndarray, call: np.ndarray, r: float, steps: int) -> np.ndarray:
    """The volatility at which each price of ``black_scholes_price`` reaches ``price``, all quotes halved at once."""
    side, log, root, fade = np.where(call, 1.0, -1.0), np.log(s / k), np.sqrt(t), k * np.exp(-r * t)
    low, high = np.full(len(s), 1e-6), np.full(len(s), 10.0)
    for _ in range(steps):
        mid = (low + high) / 2
        d1 = (log + (r + mid * mid / 2) * t) / (mid * root)
        under = side * (s * _phi(side * d1) - fade * _phi(side * (d1 - mid * root))) < price
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def implied_volatility(quotes: DataFrame, r: float = 0.04, steps: int = 60) -> DataFrame:
    """``iv`` of quotes (s, k, t, kind, price) by halving between 1e-6 and 10; none for prices outside the arbitrage bounds.

    A halving step is a few array operations over a batch of quotes: as column expressions, which price a quote anew wherever its
    price or volatility is named, the steps took milliseconds a quote."""
    s, k, t, price, call = F.col("s"), F.col("k"), F.col("t"), F.col("price"), F.col("kind") == "C"
    fade = k * F.exp(-r * t)
    bounds = F.when(call, (price >= s - fade - 1e-9) & (price <= s + 1e-9)).otherwise((price >= fade - s - 1e-9) & (price <= fade + 1e-9)) & (price > 0) & (s > 0) & (k > 0) & (t > 0)

    @F.pandas_udf("double")
    def found(s: pd.Series, k: pd.Series, t: pd.Series, price: pd.Series, call: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):  # quotes beyond the bounds have no volatility, whatever comes out
            return pd.Series(_halved(*(c.to_numpy(float) for c in (s, k, t, price)), call.to_numpy(bool), r, steps))

    double = lambda c: c.cast("double")
    return quotes.withColumn("iv", F.when(bounds, found(double(s), double(k), double(t), double(price), F.coalesce(call, F.lit(False)))))

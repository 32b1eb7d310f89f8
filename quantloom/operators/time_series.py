"""Measures of each asset's ordered bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.stats import clamp, order_statistic, ratio
from ..sources.panels import by_week

YEAR = 52


def to_here() -> WindowSpec:
    return by_week().rowsBetween(Window.unboundedPreceding, 0)


def newest_first() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy(F.desc("wk"))

def horizon_returns(ret: DataFrame) -> DataFrame:
    """Compounded returns of the last 1, 4, 13, 26 and 52 weeks, in percent; a short history counts whole."""
    back = ret.where("r is not null").withColumn("age", F.row_number().over(newest_first()))
    grown = lambda n: (100 * (F.exp(F.sum(F.when(F.col("age") <= n, F.ln(1 + F.col("r"))))) - 1))
    return back.groupBy("ticker").agg(*(grown(n).alias(k) for k, n in (("ret1w", 1), ("ret1m", 4), ("ret3m", 13), ("ret6m", 26), ("ret12m", 52))))


def volatility_beta(ret: DataFrame, mkt: DataFrame) -> DataFrame:
    """Annual volatility in percent, and the slope on the market (from five weeks on)."""
    joined = ret.where("r is not null").join(mkt, "wk")
    beta = F.when(F.count("r") >= 5, F.covar_samp("r", "m") / F.var_samp("m"))
    return joined.groupBy("ticker").agg((F.stddev_samp("r") * math.sqrt(YEAR) * 100).alias("vol"), beta.alias("beta"), F.count("r").alias("n"))


def money_flow(bars: DataFrame, weeks: int = 21) -> DataFrame:
    """Signed money volume of the last weeks: in, out, and the net share."""
    flows = bars.withColumn("b", F.lag("c").over(by_week())).withColumn("age", F.row_number().over(newest_first())).where(f"b is not null and age <= {weeks}")
    up = F.sum(F.when(F.col("c") >= F.col("b"), F.col("c") * F.col("v")).otherwise(0.0))
    down = F.sum(F.when(F.col("c") < F.col("b"), F.col("c") * F.col("v")).otherwise(0.0))
    return flows.groupBy("ticker").agg(up.alias("inflow"), down.alias("outflow"), ratio(up - down, up + down).alias("net"))


def money_flow_index(bars: DataFrame, weeks: int = 14) -> DataFrame:
    """Money flow index on the typical price of the last valid flows."""
    t = bars.withColumn("tp", (F.col("h") + F.col("l") + F.col("c")) / 3)
    t = t.withColumn("b", F.lag("tp").over(by_week())).where("b is not null").withColumn("age", F.row_number().over(newest_first())).where(f"age <= {weeks}")
    pos = F.sum(F.when(F.col("tp") > F.col("b"), F.col("tp") * F.col("v")).otherwise(0.0))
    neg = F.sum(F.when(F.col("tp") < F.col("b"), F.col("tp") * F.col("v")).otherwise(0.0))
    index = F.when(neg > 0, 100 - 100 / (1 + pos / F.when(neg > 0, neg))).when(pos > 0, 100.0).otherwise(50.0)
    return t.groupBy("ticker").agg(index.alias("mfi"))


def true_range(bars: DataFrame, weeks: int = 14) -> DataFrame:
    """Mean true range of the last weeks, and whether the last close fell out of it."""
    t = bars.withColumn("b", F.lag("c").over(by_week())).where("b is not null")
    t = t.withColumn("tr", F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("b")), F.abs(F.col("l") - F.col("b")))).withColumn("age", F.row_number().over(newest_first()))
    out = t.where(f"age <= {weeks}").groupBy("ticker").agg(F.avg("tr").alias("atr"), F.max(F.when(F.col("age") == 1, F.col("c"))).alias("last"), F.max(F.when(F.col("age") == 1, F.col("b"))).alias("before"))
    return out.select("ticker", "atr", (F.col("last") < F.col("before") - F.col("atr")).alias("broke"))


def ema(bars: DataFrame, span: int = 21) -> DataFrame:
    """The exponential mean of the closes, seeded with the first, and the last close's distance from it in percent."""
    a = 2 / (span + 1)
    closes = F.transform(F.array_sort(F.collect_list(F.struct("wk", "c"))), lambda x: x["c"])
    folded = F.aggregate(F.slice("xs", 2, F.size("xs")), F.get("xs", F.lit(0)), lambda e, x: e + (x - e) * a)
    t = bars.groupBy("ticker").agg(closes.alias("xs")).select("ticker", folded.alias("ema"), F.element_at("xs", -1).alias("last"))
    return t.select("ticker", "ema", (100 * (F.col("last") - F.col("ema")) / F.col("ema")).alias("distance"))


def ewma_volatility(ret: DataFrame, decay: float = 0.94) -> DataFrame:
    """Exponentially weighted variance seeded with the first squared return, in closed form, as annual volatility."""
    t = ret.where("r is not null").withColumn("age", F.row_number().over(newest_first()) - 1).withColumn("n", F.count("r").over(Window.partitionBy("ticker")))
    weight = F.when(F.col("age") == F.col("n") - 1, F.pow(F.lit(decay), F.col("age"))).otherwise((1 - decay) * F.pow(F.lit(decay), F.col("age")))
    return t.groupBy("ticker").agg(F.sqrt(F.sum(weight * F.col("r") * F.col("r")) * YEAR).alias("ewma_vol"))


def range_volatility(bars: DataFrame) -> DataFrame:
    """Annual volatility from closes, ranges, and opens, by four estimators."""
    hl, co = F.ln(F.col("h") / F.col("l")), F.ln(F.col("c") / F.col("o"))
    hc, ho, lc, lo = (F.ln(F.col(a) / F.col(b)) for a, b in (("h", "c"), ("h", "o"), ("l", "c"), ("l", "o")))
    close = F.ln(F.col("c") / F.lag("c").over(by_week()))
    t = bars.select("ticker", close.alias("cc"), (hl * hl / (4 * math.log(2))).alias("pk"), (0.5 * hl * hl - (2 * math.log(2) - 1) * co * co).alias("gk"), (hc * ho + lc * lo).alias("rs"))
    annual = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)) * YEAR)
    return t.groupBy("ticker").agg(annual(F.var_samp("cc")).alias("close_vol"), annual(F.avg("pk")).alias("parkinson"), annual(F.avg("gk")).alias("garman_klass"), annual(F.avg("rs")).alias("rogers_satchell"))


def jump_ratio(ret: DataFrame, weeks: int = 21) -> DataFrame:
    """The part of realised variance beyond bipower variation, over the last returns."""
    t = ret.where("lr is not null").withColumn("b", F.lag(F.abs("lr")).over(by_week())).withColumn("age", F.row_number().over(newest_first())).where(f"age <= {weeks}")
    rv, bv = F.sum(F.col("lr") * F.col("lr")), math.pi / 2 * F.sum(F.abs("lr") * F.when(F.col("age") < weeks, F.col("b")))
    return t.groupBy("ticker").agg(rv.alias("rv"), bv.alias("bv"), clamp(ratio(rv - bv, rv), 0.0, 1.0).alias("jump"))


def variance_ratio(ret: DataFrame, q: int = 5) -> DataFrame:
    """Variance of q-week sums against q times that of weeks; from 4q weeks on."""
    t = ret.where("lr is not null").withColumn("s", F.sum("lr").over(by_week().rowsBetween(-q + 1, 0))).withColumn("k", F.row_number().over(by_week()))
    vr = ratio(F.var_samp(F.when(F.col("k") >= q, F.col("s"))), q * F.var_samp("lr"))
    label = F.when(vr >= 1.15, "trending").when(vr <= 0.85, "mean-revert").otherwise("random-walk")
    return t.groupBy("ticker").agg(F.when(F.count("lr") >= 4 * q, vr).alias("vr"), F.when(F.count("lr") >= 4 * q, label).alias("regime"))


def half_life(bars: DataFrame, cap: float = 252.0) -> DataFrame:
    """Weeks in which half of a log-price deviation fades; none where it doesn't revert."""
    t = bars.select("ticker", "wk", F.ln("c").alias("p")).withColumn("b", F.lag("p").over(by_week())).where("b is not null")
    t = t.groupBy("ticker").agg(F.count("b").alias("n"), F.regr_slope(F.col("p") - F.col("b"), F.col("b")).alias("slope"))
    return t.select("ticker", "slope", F.when((F.col("n") >= 25) & (F.col("slope") < 0), F.least(-math.log(2) / F.col("slope"), F.lit(cap))).alias("half_life"))


def drawdowns(bars: DataFrame) -> DataFrame:
    """Deepest fall below the peak so far, the ulcer index, and the longest stretch of weeks below a peak."""
    t = bars.withColumn("peak", F.max("c").over(to_here())).withColumn("dd", F.col("c") / F.col("peak") - 1)
    t = t.withColumn("under", F.when(F.col("c") < F.col("peak"), 1).otherwise(0)).withColumn("run", F.sum(1 - F.col("under")).over(to_here()))
    spans = t.groupBy("ticker", "run").agg(F.sum("under").alias("span"), F.min("dd").alias("dd"), F.sum(F.pow(100 * F.col("dd"), 2)).alias("sq"), F.count("dd").alias("n"))
    return spans.groupBy("ticker").agg(F.min("dd").alias("max_drawdown"), F.sqrt(F.sum("sq") / F.sum("n")).alias("ulcer"), F.max("span").alias("longest"))


def risk_summary(ret: DataFrame, mkt: DataFrame) -> DataFrame:
    """Ratios of return to risk, and order-statistic value at risk and shortfall at five percent."""
    t = ret.where("r is not null").join(mkt, "wk")
    down = F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2))) * math.sqrt(YEAR)
    gains, losses = F.sum(F.when(F.col("r") > 0, F.col("r"))), -F.sum(F.when(F.col("r") < 0, F.col("r")))
    worst = F.sort_array(F.collect_list("r"))
    k = F.greatest(F.floor(F.size("worst") * 0.05).cast("int"), F.lit(1))
    out = t.groupBy("ticker").agg(
        ratio(F.avg("r") * YEAR, F.stddev_samp("r") * math.sqrt(YEAR)).alias("sharpe"), ratio(F.avg("r") * YEAR, down).alias("sortino"),
        ratio(F.avg(F.col("r") - F.col("m")) * YEAR, F.stddev_samp(F.col("r") - F.col("m")) * math.sqrt(YEAR)).alias("information"), (F.stddev_samp(F.col("r") - F.col("m")) * math.sqrt(YEAR)).alias("tracking"),
        F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), ratio(gains, losses).alias("profit_factor"), (-order_statistic("r", 0.05)).alias("var95"), worst.alias("worst"),
    )
    shortfall = -F.aggregate(F.slice("worst", F.lit(1), k), F.lit(0.0), lambda s, x: s + x) / k
    return out.withColumn("cvar95", shortfall).drop("worst")


def moments(ret: DataFrame) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    n = F.count("r").cast("double")
    skew = F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.kurtosis("r") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return ret.where("r is not null").groupBy("ticker").agg(F.when(F.count("r") > 3, skew).alias("skew"), F.when(F.count("r") > 3, kurt).alias("kurt"))


def hurst(bars: DataFrame, longest: int = 20) -> DataFrame:
    """Slope of the log spread of lagged differences on the log lag."""
    t = bars.select("ticker", "wk", "c")
    lagged = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("c") - F.lag("c", k).over(by_week())).alias("d")) for k in range(2, longest + 1)))
    diffs = t.select("ticker", lagged.alias("xs")).select("ticker", F.explode("xs").alias("x")).select("ticker", "x.k", "x.d")
    spread = diffs.where("d is not null").groupBy("ticker", "k").agg(F.stddev_pop("d").alias("sd")).where("sd > 0")
    return spread.groupBy("ticker").agg(F.regr_slope(F.ln("sd"), F.ln("k")).alias("hurst"))


def volatility_term(ret: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 21)) -> DataFrame:
    """Spread of overlapping sums of returns by horizon, beside the square-root rule."""
    t = ret.where("lr is not null").withColumn("k", F.row_number().over(by_week()))
    sums = [F.struct(F.lit(h).alias("h"), F.when(F.col("k") >= h, F.sum("lr").over(by_week().rowsBetween(-h + 1, 0))).alias("s")) for h in horizons]
    t = t.select("ticker", "lr", F.array(*sums).alias("xs")).select("ticker", "lr", F.explode("xs").alias("x")).select("ticker", "lr", "x.h", "x.s")
    return t.groupBy("ticker", "h").agg(F.stddev_samp("s").alias("hv"), (F.stddev_samp("lr") * F.sqrt(F.col("h"))).alias("root_rule"))


def relative_volume(bars: DataFrame, weeks: int = 20) -> DataFrame:
    """The week's volume against the median of the weeks before, for every week."""
    before = F.percentile("v", F.lit(0.5)).over(by_week().rowsBetween(-weeks, -1))
    return bars.select("ticker", "wk", ratio(F.col("v"), before).alias("rvol"))


def series_health(bars: DataFrame, least: int = 40, most_stale: int = 4, most_gap: int = 7, jump: float = 3.5) -> DataFrame:
    """Health of each series: weeks, closes that are missing or not finite, closes that aren't positive, the longest run of equal closes,
    returns beyond ``jump`` robust z, the longest gap in days, and the verdict: reject, degraded or clean.

    Runs and returns are taken between usable closes; a run of one is no repetition. A null date has no place in the order and comes first."""
    c = F.col("c").cast("double")
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    t = bars.select("ticker", "wk", F.when(finite, c).alias("c"), F.when(finite & (c > 0), c).alias("ok"))
    counts = t.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c").isNull()).alias("missing"), F.count_if(F.col("c") <= 0).alias("not_positive"))
    gaps = t.withColumn("gap", F.datediff("wk", F.lag("wk").over(by_week()))).groupBy("ticker").agg(F.max("gap").alias("max_gap"))
    used = t.where("ok is not null")
    used = used.withColumn("lr", F.ln(F.col("ok") / F.lag("ok").over(by_week()))).withColumn("new", F.coalesce((F.col("ok") != F.lag("ok").over(by_week())).cast("int"), F.lit(1)))
    runs = used.withColumn("run", F.sum("new").over(by_week())).groupBy("ticker", "run").agg(F.count(F.lit(1)).alias("k")).groupBy("ticker").agg(F.max("k").alias("stale_run"))
    middle = used.groupBy("ticker").agg(F.percentile("lr", F.lit(0.5)).alias("med"))
    off = used.join(middle, "ticker").withColumn("off", F.abs(F.col("lr") - F.col("med")))
    off = off.join(off.groupBy("ticker").agg(F.percentile("off", F.lit(0.5)).alias("mad")), "ticker")
    jumps = off.groupBy("ticker").agg(F.count_if(0.6745 * F.col("off") / F.greatest("mad", F.lit(1e-12)) > jump).alias("jumps"), F.count("lr").alias("returns"))
    h = counts.join(gaps, "ticker").join(runs, "ticker", "left").join(jumps, "ticker", "left").fillna(0, ["stale_run", "jumps", "returns"])
    reject = (F.col("n") < least) | (F.col("not_positive") > 0) | (F.col("missing") > F.greatest(F.lit(2.0), 0.02 * F.col("n")))
    worse = (F.col("missing") > 0) | (F.col("stale_run") >= most_stale) | (F.col("max_gap") > most_gap) | (F.col("jumps") > F.greatest(F.lit(3.0), 0.05 * F.col("returns")))
    return h.withColumn("verdict", F.when(reject, "reject").when(worse, "degraded").otherwise("clean")).drop("returns")

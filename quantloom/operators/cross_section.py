"""Measures across assets: standing, ranking, rotation of groups, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.stats import average_rank, ratio, z
from . import time_series as ts


def everything() -> WindowSpec:
    return Window.partitionBy()


def winsorised(df: DataFrame, columns: list[str], share: float = 0.02) -> DataFrame:
    """Columns clamped to the order statistics at int(share * n) and int((1 - share) * n). The table is one row an asset."""
    sorted_ = df.agg(*(F.sort_array(F.collect_list(c)).alias(f"_{c}") for c in columns))
    df = df.join(F.broadcast(sorted_))  # one row
    at = lambda c, p: F.get(f"_{c}", F.least(F.floor(p * F.size(f"_{c}")), F.size(f"_{c}") - 1).cast("int"))
    clamped = {c: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, at(c, F.lit(share))), at(c, F.lit(1 - share)))) for c in columns}
    return df.withColumns(clamped).drop(*(f"_{c}" for c in columns))


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cross-sectional z of winsorised columns; missing values stand at the mean."""
    return winsorised(df, columns).withColumns({f"z_{c}": z(F.col(c), everything()) for c in columns})


def opportunity(df: DataFrame) -> DataFrame:
    """The weighted sum of standings in trend, momentum, group strength and flow, and the share of assets not above it."""
    score = 0.30 * z(F.col("distance"), everything()) + 0.25 * z(F.col("ret6m"), everything()) + 0.25 * z(F.col("sec_rel"), everything()) + 0.20 * z(F.col("net"), everything())
    return df.withColumn("opp", score).withColumn("opp_pct", F.bround(100 * F.cume_dist().over(Window.orderBy("opp"))))


def sector_relative(df: DataFrame) -> DataFrame:
    """Three-month strength against the group's mean."""
    return df.withColumn("sec_rel", F.col("ret3m") - F.avg("ret3m").over(Window.partitionBy("sec")))


def assets(bars: DataFrame, ret: DataFrame, mkt: DataFrame) -> DataFrame:
    """One row an asset: group, returns, volatility, beta, flow, distance from trend."""
    sec = bars.groupBy("ticker").agg(F.first("sec").alias("sec"))
    for part in (ts.horizon_returns(ret), ts.volatility_beta(ret, mkt).drop("n"), ts.money_flow(bars).select("ticker", "net"), ts.ema(bars).select("ticker", "distance")):
        sec = sec.join(part, "ticker", "left")
    return sector_relative(sec)


def rotation(names: DataFrame) -> DataFrame:
    """Groups by a score of acceleration, flow, breadth, momentum and strength: medians, standardised across groups."""
    middle = lambda x: F.percentile(x, F.lit(0.5))
    groups = names.groupBy("sec").agg(
        middle(F.col("ret1m") - F.col("ret3m") / 3).alias("accel"), middle("net").alias("flow"), F.avg((F.col("distance") > 0).cast("double")).alias("breadth"), middle("ret6m").alias("mom"), middle("sec_rel").alias("rs"), F.count("ticker").alias("n")
    )
    score = sum(w * z(F.col(c), everything(), population=True) for c, w in (("accel", 0.30), ("flow", 0.25), ("breadth", 0.20), ("mom", 0.15), ("rs", 0.10)))
    label = F.when(F.col("score") >= 0.5, "in").when(F.col("score") <= -0.5, "out").otherwise("neutral")
    return groups.withColumn("score", score).withColumn("label", label).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "sec")))


def sector_correlation(ret: DataFrame) -> DataFrame:
    """Correlations of the groups' mean weekly returns, each pair once and itself."""
    s = ret.where("r is not null").groupBy("sec", "wk").agg(F.avg("r").alias("r"))
    pairs = s.select("wk", F.col("sec").alias("a"), F.col("r").alias("x")).join(s.select("wk", F.col("sec").alias("b"), F.col("r").alias("y")), "wk").where("a <= b")
    return pairs.groupBy("a", "b").agg(correlation("x", "y").alias("corr"))


def correlation(x: str, y: str):
    """Pearson's correlation, zero where a side doesn't vary."""
    flat = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_pop(y), F.lit(0.0)) > 0)
    return F.when(flat, ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).otherwise(0.0)


def top_correlations(ret: DataFrame, k: int = 3, least: int = 8) -> DataFrame:
    """For each asset the k others with the strongest correlation over common weeks. Assets are a dimension (hundreds to
    thousands); each week's rows meet each other, and pairs are summed up before they are shuffled."""
    r = ret.where("lr is not null")
    pairs = r.select("wk", F.col("ticker").alias("a"), F.col("lr").alias("x")).join(r.select("wk", F.col("ticker").alias("b"), F.col("lr").alias("y")), "wk").where("a <> b")
    c = pairs.groupBy("a", "b").agg(F.count("x").alias("n"), correlation("x", "y").alias("corr")).where(F.col("n") >= least)
    return c.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round(F.abs("corr"), 9)), "b"))).where(F.col("place") <= k)


def lead_lag(ret: DataFrame, mkt: DataFrame, most: int = 5) -> DataFrame:
    """The lag of each asset against the market with the strongest correlation; the smallest lag of equals."""
    by_week = Window.partitionBy("ticker").orderBy("wk")
    joined = ret.where("r is not null").join(mkt, "wk")
    shifted = joined.select("ticker", "r", F.array(*(F.struct(F.lit(k).alias("k"), (F.lag("m", k) if k >= 0 else F.lead("m", -k)).over(by_week).alias("m")) for k in range(-most, most + 1))).alias("xs"))
    c = shifted.select("ticker", "r", F.explode("xs").alias("x")).select("ticker", "r", "x.k", "x.m").where("m is not null").groupBy("ticker", "k").agg(correlation("r", "m").alias("corr"))
    best = Window.partitionBy("ticker").orderBy(F.desc(F.round(F.abs("corr"), 9)), F.abs("k"), "k")
    return c.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def leave_one_out_beta(ret: DataFrame) -> DataFrame:
    """Slope on the mean of all other assets, its standard error, and the slope shrunk to the cross-section by precision."""
    week = Window.partitionBy("wk")
    t = ret.where("r is not null").withColumn("n", F.count("r").over(week)).withColumn("m", (F.sum("r").over(week) - F.col("r")) / F.when(F.col("n") > 1, F.col("n") - 1))
    b = t.where("m is not null").groupBy("ticker").agg(F.regr_slope("r", "m").alias("beta"), F.count("r").alias("n"), F.regr_syy("r", "m").alias("yy"), F.regr_sxx("r", "m").alias("xx"), F.regr_sxy("r", "m").alias("xy"))
    b = b.withColumn("se", F.sqrt(F.greatest(F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx"), F.lit(0.0)) / (F.col("n") - 2) / F.col("xx"))).select("ticker", "beta", "se")
    tau = F.greatest(F.var_samp("beta").over(everything()) - F.avg(F.col("se") * F.col("se")).over(everything()), F.lit(0.0))
    weight = tau / (tau + F.col("se") * F.col("se"))
    return b.withColumn("vasicek", weight * F.col("beta") + (1 - weight) * F.avg("beta").over(everything()))


def momentum_panel(bars: DataFrame, back: int = 13, ahead: int = 4) -> DataFrame:
    """``ticker, wk, sig, fwd``: the return over the weeks before, and over those behind."""
    by_week = Window.partitionBy("ticker").orderBy("wk")
    t = bars.select("ticker", "wk", (F.col("c") / F.lag("c", back).over(by_week) - 1).alias("sig"), (F.lead("c", ahead).over(by_week) / F.col("c") - 1).alias("fwd"))
    return t.where("sig is not null and fwd is not null")


def rank_ic(panel: DataFrame, least: int = 5) -> DataFrame:
    """Rank correlation of signal and outcome for each date."""
    t = panel.withColumns({"a": average_rank("sig", "wk"), "b": average_rank("fwd", "wk")})
    return t.groupBy("wk").agg(F.count("a").alias("n"), correlation("a", "b").alias("ic")).where(F.col("n") >= least)


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean, spread, information ratio, t and share of positive dates."""
    return ics.agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd_ic"), ratio(F.avg("ic"), F.stddev_samp("ic")).alias("ir"), ratio(F.avg("ic") * F.sqrt(F.count("ic")), F.stddev_samp("ic")).alias("t"), F.avg((F.round("ic", 9) > 0).cast("double")).alias("positive"), F.count("ic").alias("n"))


def quantile_returns(panel: DataFrame, q: int = 5) -> DataFrame:
    """Mean outcome of each signal bucket (place * q / n, rounded down) over all dates, and of the top less the bottom."""
    day = Window.partitionBy("wk")
    t = panel.withColumn("place", F.row_number().over(day.orderBy("sig", "ticker")) - 1).withColumn("n", F.count("sig").over(day)).where(F.col("n") >= q)
    t = t.withColumn("bucket", F.floor(F.col("place") * q / F.col("n")).cast("int")).groupBy("wk", "bucket").agg(F.avg("fwd").alias("fwd"))
    return t.groupBy("bucket").agg(F.avg("fwd").alias("mean_fwd"), F.stddev_samp("fwd").alias("sd_fwd"), F.count("fwd").alias("n"))


def fama_macbeth(panel: DataFrame) -> DataFrame:
    """Slopes of outcome on signal for each date, their mean and its t."""
    slopes = panel.groupBy("wk").agg(F.count("sig").alias("n"), F.regr_slope("fwd", "sig").alias("slope")).where("n >= 5")
    return slopes.agg(F.avg("slope").alias("premium"), (F.avg("slope") * F.sqrt(F.count("slope")) / F.stddev_samp("slope")).alias("t"), F.count("slope").alias("n"))


def two_way_fixed_effects(panel: DataFrame) -> DataFrame:
    """Slope within assets and dates, by demeaning twice."""
    a, d = Window.partitionBy("ticker"), Window.partitionBy("wk")
    grand = panel.agg(F.avg("sig").alias("_sig"), F.avg("fwd").alias("_fwd"))
    within = lambda c: F.col(c) - F.avg(c).over(a) - F.avg(c).over(d) + F.col(f"_{c}")
    t = panel.join(F.broadcast(grand)).select(within("sig").alias("x"), within("fwd").alias("y"))  # one row
    return t.agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("slope"), F.count("x").alias("n"))


def clustered_errors(panel: DataFrame) -> DataFrame:
    """Slope of outcome on signal, with standard errors clustered by asset, by date and by both."""
    fit = panel.agg(F.regr_slope("fwd", "sig").alias("b"), F.regr_intercept("fwd", "sig").alias("a"), F.avg("sig").alias("mx"), F.regr_sxx("fwd", "sig").alias("xx"))
    s = panel.join(F.broadcast(fit)).withColumn("u", (F.col("sig") - F.col("mx")) * (F.col("fwd") - F.col("a") - F.col("b") * F.col("sig")))  # one row
    total = lambda by: s.groupBy(by).agg(F.sum("u").alias("u")).agg(F.sum(F.col("u") * F.col("u")).alias(f"v_{by}"))
    v = total("ticker").crossJoin(total("wk")).crossJoin(s.agg(F.sum(F.col("u") * F.col("u")).alias("v_both"))).crossJoin(fit)  # one row each
    se = lambda c: F.sqrt(F.greatest(c, F.lit(0.0))) / F.col("xx")
    return v.select(F.col("b").alias("slope"), se(F.col("v_ticker")).alias("se_asset"), se(F.col("v_wk")).alias("se_date"), se(F.col("v_ticker") + F.col("v_wk") - F.col("v_both")).alias("se_both"))


def net_backtest(panel: DataFrame, cost: float = 0.0005) -> DataFrame:
    """Long above and short below the median signal of each date, paying for turnover."""
    day = Window.partitionBy("wk")
    t = panel.withColumn("pos", F.signum(F.col("sig") - F.percentile("sig", F.lit(0.5)).over(day)))
    t = t.withColumn("moved", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(Window.partitionBy("ticker").orderBy("wk")), F.lit(0.0))))
    d = t.groupBy("wk").agg(F.avg(F.col("pos") * F.col("fwd")).alias("gross"), F.avg("moved").alias("turnover"))
    return d.agg(F.avg("gross").alias("gross"), F.avg(F.col("gross") - cost * F.col("turnover")).alias("net"), F.avg("turnover").alias("turnover"), ratio(F.avg("gross"), F.avg("turnover")).alias("breakeven"))


def partial_correlation(ret: DataFrame, mkt: DataFrame, drivers: DataFrame) -> DataFrame:
    """Correlation of each asset with each driver, its t, and the correlation once the market is taken out of both."""
    t = ret.where("r is not null").join(mkt, "wk").join(drivers, "wk")
    c = t.groupBy("ticker", "driver").agg(F.count("r").alias("n"), correlation("r", "f").alias("c"), correlation("r", "m").alias("cm"), correlation("f", "m").alias("fm")).where("n >= 8")
    rest = F.sqrt((1 - F.col("cm") * F.col("cm")) * (1 - F.col("fm") * F.col("fm")))
    return c.withColumn("t", F.when(F.abs("c") >= 0.999, 9.9 * F.signum("c")).otherwise(F.col("c") * F.sqrt((F.col("n") - 2) / (1 - F.col("c") * F.col("c"))))).withColumn("pcorr", ratio(F.col("c") - F.col("cm") * F.col("fm"), rest)).drop("cm", "fm")


def false_discovery(tests: DataFrame, p: str, q: float = 0.10) -> DataFrame:
    """Benjamini-Yekutieli within each asset: tests pass up to the last p-value under its line."""
    own = Window.partitionBy("ticker")
    t = tests.withColumn("place", F.row_number().over(own.orderBy(p, "driver"))).withColumn("m", F.count(F.lit(1)).over(own))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    t = t.withColumn("line", F.col("place") * q / (F.col("m") * harmonic))
    last = F.max(F.when(F.col(p) <= F.col("line"), F.col("place"))).over(own)
    return t.withColumn("passes", F.col("place") <= F.coalesce(last, F.lit(0))).drop("m", "line")

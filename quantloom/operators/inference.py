"""Inference on series and panels: autocorrelation-proof errors, event studies, tails, covariance, Sharpe ratios."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import phi, ratio
from ..sources.panels import by_week


def mean_hac(ret: DataFrame, lags: int = 4) -> DataFrame:
    """Mean return with the Newey-West standard error (Bartlett weights) and t."""
    t = ret.where("r is not null").withColumn("u", F.col("r") - F.avg("r").over(Window.partitionBy("ticker")))
    t = t.select("ticker", "r", "u", *(F.lag("u", k).over(by_week()).alias(f"u{k}") for k in range(1, lags + 1)))
    n = F.count("r")
    long_run = F.sum(F.col("u") * F.col("u")) / n + sum(2 * (1 - k / (lags + 1)) * F.sum(F.col("u") * F.col(f"u{k}")) / n for k in range(1, lags + 1))
    se = F.sqrt(F.greatest(long_run, F.lit(0.0)) / n)
    return t.groupBy("ticker").agg(F.avg("r").alias("mean"), se.alias("se"), ratio(F.avg("r"), se).alias("t"))


def slope_hac(ret: DataFrame, mkt: DataFrame, lags: int = 4) -> DataFrame:
    """Slope on the market with the Newey-West standard error of its score sums."""
    j = ret.where("r is not null").join(mkt, "wk")
    fit = j.groupBy("ticker").agg(F.regr_slope("r", "m").alias("b"), F.regr_intercept("r", "m").alias("a"), F.avg("m").alias("mm"), F.regr_sxx("r", "m").alias("xx"))
    s = j.join(fit, "ticker").withColumn("s", (F.col("m") - F.col("mm")) * (F.col("r") - F.col("a") - F.col("b") * F.col("m")))
    s = s.select("ticker", "b", "xx", "s", *(F.lag("s", k).over(by_week()).alias(f"s{k}") for k in range(1, lags + 1)))
    meat = F.sum(F.col("s") * F.col("s")) + sum(2 * (1 - k / (lags + 1)) * F.sum(F.col("s") * F.col(f"s{k}")) for k in range(1, lags + 1))
    return s.groupBy("ticker", "b", "xx").agg(meat.alias("meat")).select("ticker", F.col("b").alias("slope"), (F.sqrt(F.greatest("meat", F.lit(0.0))) / F.col("xx")).alias("se"))


def event_study(ret: DataFrame, mkt: DataFrame, events: DataFrame, estimate: tuple[int, int] = (-60, -6), window: int = 5) -> DataFrame:
    """Abnormal returns around each asset's event week against the market model fitted before it: sum and its standard score.
    ``events``: ticker, i (the place of the week)."""
    j = ret.where("r is not null").join(mkt, "wk").join(events.select("ticker", F.col("i").alias("at")), "ticker").withColumn("k", F.col("i") - F.col("at"))
    before = j.where(F.col("k").between(*estimate)).groupBy("ticker", "at").agg(
        F.regr_slope("r", "m").alias("b"), F.regr_intercept("r", "m").alias("a"), F.count("r").alias("n"), F.sqrt(F.greatest(F.regr_syy("r", "m") - F.pow(F.regr_sxy("r", "m"), 2) / F.regr_sxx("r", "m"), F.lit(0.0)) / (F.count("r") - 2)).alias("s")
    )
    around = j.where(F.abs("k") <= window).join(before.where("n >= 20"), ["ticker", "at"]).withColumn("ar", F.col("r") - F.col("a") - F.col("b") * F.col("m"))
    return around.groupBy("ticker", "at").agg(F.sum("ar").alias("car"), (F.sum("ar") / (F.first("s") * F.sqrt(F.count("ar")))).alias("scar"), F.count("ar").cast("long").alias("weeks"))


def tail_dependence(ret: DataFrame, mkt: DataFrame, q: float = 0.1) -> DataFrame:
    """Of each asset's worst and best weeks, the share in which the market is in its own tail."""
    own = Window.partitionBy("ticker")
    t = ret.where("r is not null").join(mkt, "wk").withColumn("n", F.count("r").over(own))
    t = t.withColumns({"kr": F.row_number().over(own.orderBy("r", "wk")), "km": F.row_number().over(own.orderBy("m", "wk")), "k": F.floor(q * F.col("n"))})
    low, high = lambda c: F.col(c) <= F.col("k"), lambda c: F.col(c) > F.col("n") - F.col("k")
    both = lambda f: F.sum((f("kr") & f("km")).cast("double")) / F.max("k")
    return t.where("k > 0").groupBy("ticker").agg(both(low).alias("lower"), both(high).alias("upper"))


def probabilistic_sharpe(ret: DataFrame, against: float = 0.0) -> DataFrame:
    """Weekly Sharpe ratio, and the chance that it exceeds the benchmark given skewness and kurtosis."""
    t = ret.where("r is not null").groupBy("ticker").agg(ratio(F.avg("r"), F.stddev_samp("r")).alias("sr"), F.count("r").alias("n"), F.skewness("r").alias("g3"), (F.kurtosis("r") + 3).alias("g4"))
    z = (F.col("sr") - against) * F.sqrt(F.col("n") - 1) / F.sqrt(1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") * F.col("sr"))
    return t.select("ticker", "sr", phi(z).alias("psr"))


def peaks_over_threshold(ret: DataFrame, q: float = 0.1) -> DataFrame:
    """Losses beyond their upper order statistic: generalised Pareto shape and scale by moments, and the 99 % shortfall."""
    own = Window.partitionBy("ticker")
    t = ret.where("r is not null").select("ticker", (-F.col("r")).alias("x"), F.row_number().over(own.orderBy("r", "wk")).alias("k"), F.count("r").over(own).alias("n"))
    t = t.withColumn("u", F.max(F.when(F.col("k") == F.floor(q * F.col("n")) + 1, F.col("x"))).over(own)).where(F.col("k") <= F.floor(q * F.col("n")))
    e = t.groupBy("ticker", "u", "n").agg(F.avg(F.col("x") - F.col("u")).alias("m"), F.var_samp(F.col("x") - F.col("u")).alias("v"), F.count("x").alias("ne"))
    xi = 0.5 * (1 - F.col("m") * F.col("m") / F.col("v"))
    e = e.where("v > 0").withColumn("xi", xi).withColumn("beta", F.col("m") * (1 - F.col("xi")))
    var = F.col("u") + F.when(F.abs("xi") > 1e-9, F.col("beta") / F.col("xi") * (F.pow(F.col("n") / F.col("ne") * 0.01, -F.col("xi")) - 1)).otherwise(-F.col("beta") * F.ln(F.col("n") / F.col("ne") * 0.01))
    e = e.withColumn("var99", var)
    return e.select("ticker", "u", "xi", "beta", "var99", F.when(F.col("xi") < 1, (F.col("var99") + F.col("beta") - F.col("xi") * F.col("u")) / (1 - F.col("xi"))).alias("es99"))


def ewma_covariance(factors: DataFrame, decay: float = 0.94) -> DataFrame:
    """Exponentially weighted covariance of drivers (driver, wk, f), demeaned over all weeks; newest weight the greatest."""
    w = Window.partitionBy("driver")
    t = factors.withColumn("x", F.col("f") - F.avg("f").over(w)).withColumn("age", F.row_number().over(w.orderBy(F.desc("wk"))) - 1)
    a, b = t.select("wk", "age", F.col("driver").alias("a"), F.col("x").alias("xa")), t.select("wk", F.col("driver").alias("b"), F.col("x").alias("xb"))
    p = a.join(b, "wk").where("a <= b").withColumn("w", F.pow(F.lit(decay), F.col("age")))
    return p.groupBy("a", "b").agg((F.sum(F.col("w") * F.col("xa") * F.col("xb")) / F.sum("w")).alias("cov"))


def har_features(ret: DataFrame) -> DataFrame:
    """Realised variance of the week against its means over one, five and twenty-two weeks before: slopes one by one."""
    rv = ret.where("lr is not null").select("ticker", "wk", (F.col("lr") * F.col("lr")).alias("v"))
    mean = lambda n: F.avg("v").over(by_week().rowsBetween(-n, -1))
    t = rv.withColumns({"d": mean(1), "w": mean(5), "m": mean(22), "k": F.row_number().over(by_week())}).where("k > 22")
    return t.groupBy("ticker").agg(*(F.regr_slope("v", c).alias(f"slope_{c}") for c in ("d", "w", "m")), F.regr_r2("v", "m").alias("r2_m"), F.count("v").alias("n"))


def no_arbitrage(chain: DataFrame) -> DataFrame:
    """Calls by strike whose price breaks monotony or convexity: counts of each break. ``chain``: k, price."""
    w = Window.orderBy("k")
    t = chain.withColumns({"pk": F.lag("k").over(w), "pp": F.lag("price").over(w), "nk": F.lead("k").over(w), "np": F.lead("price").over(w)})
    slope = lambda a, b, ka, kb: (F.col(b) - F.col(a)) / (F.col(kb) - F.col(ka))
    return t.agg(F.count(F.lit(1)).alias("strikes"), F.count_if(F.col("price") > F.col("pp") + 1e-9).alias("not_falling"), F.count_if(slope("pp", "price", "pk", "k") > slope("price", "np", "k", "nk") + 1e-9).alias("not_convex"))


def session_bars(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of a user that end with a pause: start, events, value."""
    s = events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total")


def minutes_momentum(events: DataFrame, minutes: int = 720) -> DataFrame:
    """Mean value of a type's last minutes against all before them, at each event.

    Types are few, so their rows are dealt by spans of time as long as the window: the rows of a span meet those of the span
    before, and everything older comes from running totals by span, of which a type has one row each. A row of the span before
    is placed at the time when it is as old as the window is long: up to there it is near, then far. So each sum runs from one end
    of its group, and none is made anew for each row, however dense the events are.
    """
    wide = minutes * 60_000_000
    t = events.select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("span", F.floor(F.col("us") / wide))
    old = Window.partitionBy("event_type").orderBy("span").rangeBetween(Window.unboundedPreceding, -2)
    totals = t.groupBy("event_type", "span").agg(F.sum("value").alias("v"), F.count("value").alias("k"))
    totals = totals.select(F.col("event_type").alias("of"), F.col("span").alias("in"), F.sum("v").over(old).alias("v"), F.sum("k").over(old).alias("k"))
    dealt = t.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False))))
    dealt = dealt.withColumns({"span": F.col("span") + F.when(F.col("own"), 0).otherwise(1), "at": F.col("us") + F.when(F.col("own"), 0).otherwise(wide)})
    w = Window.partitionBy("event_type", "span")
    up, down = w.orderBy("at").rangeBetween(Window.unboundedPreceding, 0), w.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    gone = w.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    own, before = F.when(F.col("own"), F.col("value")), F.when(~F.col("own"), F.col("value"))
    sums = {"new": (own, up), "still": (before, down), "past": (before, gone)}
    dealt = dealt.withColumns({n: F.coalesce(F.sum(c).over(over), F.lit(0.0)) for n, (c, over) in sums.items()} | {f"n_{n}": F.count(c).over(over) for n, (c, over) in sums.items()}).where("own")
    near = ratio(F.col("new") + F.col("still"), F.col("n_new") + F.col("n_still"))
    far = ratio(F.coalesce("v", F.lit(0.0)) + F.col("past"), F.coalesce("k", F.lit(0)) + F.col("n_past"))
    met = dealt.join(totals, F.col("event_type").eqNullSafe(F.col("of")) & (F.col("span") == F.col("in")), "left")
    return met.select("event_id", near.alias("near"), far.alias("far"), ratio(near, far).alias("momentum"))

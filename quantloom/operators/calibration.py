"""How forecasts meet outcomes: coverage, conformal bands, drift, losses; and option measures in closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp, density, phi, ratio


def forecasts(ret: DataFrame, weeks: int = 26) -> DataFrame:
    """``ticker, wk, i, y, mu, sigma, lo, hi``: the next return against mean and spread of the weeks before, at 90 percent."""
    w = Window.partitionBy("ticker").orderBy("wk")
    before = w.rowsBetween(-weeks, -1)
    t = ret.where("lr is not null").select("ticker", "sec", "wk", F.col("lr").alias("y"), F.row_number().over(w).alias("i"), F.avg("lr").over(before).alias("mu"), F.stddev_samp("lr").over(before).alias("sigma"))
    t = t.where(F.col("i") > weeks)
    return t.withColumns({"lo": F.col("mu") - 1.6448536 * F.col("sigma"), "hi": F.col("mu") + 1.6448536 * F.col("sigma")})


def coverage_strata(f: DataFrame) -> DataFrame:
    """Coverage with Wilson's interval, in all, by group, by side and by spread: grouping sets in one pass."""
    t = f.withColumns({"covered": ((F.col("y") >= F.col("lo")) & (F.col("y") <= F.col("hi"))).cast("int"), "side": F.when(F.col("y") >= 0, "up").otherwise("down"), "spread": F.when(F.col("sigma") > 0.25, "wide").otherwise("narrow")})
    g = t.groupingSets([[], ["sec"], ["side"], ["spread"]], "sec", "side", "spread").agg(F.count(F.lit(1)).alias("n"), F.sum("covered").alias("k"), F.avg(F.col("hi") - F.col("lo")).alias("width"))
    p, n, z2 = F.col("k") / F.col("n"), F.col("n"), 1.959964**2
    half = 1.959964 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    return g.select("sec", "side", "spread", "n", p.alias("coverage"), "width", (middle - half).alias("low"), (middle + half).alias("high"))


def interval_scores(f: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Interval score, pinball losses, squared-error and likelihood losses, and the normal CRPS, by asset."""
    y, lo, hi, s = (F.col(c) for c in ("y", "lo", "hi", "sigma"))
    score = hi - lo + 2 / alpha * F.greatest(lo - y, F.lit(0.0)) + 2 / alpha * F.greatest(y - hi, F.lit(0.0))
    pinball = lambda q, tau: F.when(y >= q, tau * (y - q)).otherwise((tau - 1) * (y - q))
    z = (y - F.col("mu")) / s
    crps = s * (z * (2 * phi(z) - 1) + 2 * density(z) - 1 / math.sqrt(math.pi))
    e = F.pow(y - F.col("mu"), 2)
    return f.groupBy("ticker").agg(
        F.avg(score).alias("interval"), F.avg(pinball(lo, alpha / 2)).alias("pin_lo"), F.avg(pinball(hi, 1 - alpha / 2)).alias("pin_hi"), F.avg(crps).alias("crps"),
        F.avg(F.ln(s * s) + e / (s * s)).alias("qlike"), F.sqrt(F.avg(e)).alias("rmse"), F.avg(F.abs(y - F.col("mu"))).alias("mae"),
    )


def conformal(f: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Pads of the first 60 percent of each asset's forecasts (the order statistic at ceil((n + 1)(1 - alpha))), and the
    coverage that they give on the rest."""
    t = f.withColumn("n", F.max("i").over(Window.partitionBy("ticker"))).withColumn("first", F.col("i") - 26 <= F.floor((F.col("n") - 26) * 0.6))
    s = t.withColumn("s", F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi")))
    cal = s.where("first").groupBy("ticker").agg(F.sort_array(F.collect_list("s")).alias("xs"))
    cal = cal.select("ticker", F.size("xs").cast("long").alias("n_cal"), F.get("xs", (F.least(F.ceil((F.size("xs") + 1) * (1 - alpha)), F.size("xs")) - 1).cast("int")).alias("pad"))
    rest = s.where("not first").join(cal, "ticker")
    return rest.groupBy("ticker", "n_cal", "pad").agg(F.avg((F.col("s") <= F.col("pad")).cast("double")).alias("coverage"), F.avg((F.col("s") <= 0).cast("double")).alias("raw"), F.count("s").alias("n"))


def mincer_zarnowitz(f: DataFrame) -> DataFrame:
    """Outcome on forecast: intercept, slope, fit; skill against no change, and Theil's U."""
    e, n = F.sum(F.pow(F.col("y") - F.col("mu"), 2)), F.sum(F.col("y") * F.col("y"))
    return f.groupBy("ticker").agg(F.regr_intercept("y", "mu").alias("a"), F.regr_slope("y", "mu").alias("b"), F.regr_r2("y", "mu").alias("r2"), (1 - e / n).alias("skill"), F.sqrt(e / n).alias("u2"), F.avg(F.col("y") - F.col("mu")).alias("bias"))


def reliability(f: DataFrame, bins: int = 5) -> DataFrame:
    """Predicted chance of a rise against its share, in equal bins, and Brier's score."""
    p = phi(F.col("mu") / F.col("sigma"))
    t = f.select(p.alias("p"), (F.col("y") > 0).cast("double").alias("hit")).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    return t.groupBy("bin").agg(F.count("p").alias("n"), F.avg("p").alias("predicted"), F.avg("hit").alias("observed"), F.avg(F.pow(F.col("p") - F.col("hit"), 2)).alias("brier"))


def stability(ret: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability of each asset's second half of returns on bins of its first, with its band."""
    w = Window.partitionBy("ticker")
    t = ret.where("r is not null").withColumn("late", F.row_number().over(w.orderBy("wk")) * 2 > F.count("r").over(w))
    edges = t.where("not late").groupBy("ticker").agg(F.sort_array(F.collect_list("r")).alias("xs"))
    edges = edges.select("ticker", F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda b: F.get("xs", F.floor(b * F.size("xs") / bins).cast("int"))).alias("edges"))
    t = t.join(edges, "ticker").withColumn("bin", F.aggregate("edges", F.lit(0), lambda n, e: n + (F.col("r") >= e).cast("int")))
    share = t.groupBy("ticker", "bin").agg(F.count_if(~F.col("late")).alias("a"), F.count_if(F.col("late")).alias("b"))
    share = share.withColumns({c: F.greatest(F.col(c) / F.sum(c).over(w), F.lit(1e-4)) for c in ("a", "b")})
    out = share.groupBy("ticker").agg(F.sum((F.col("b") - F.col("a")) * F.ln(F.col("b") / F.col("a"))).alias("psi"))
    return out.withColumn("drift", F.when(F.col("psi") < 0.10, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("significant"))


def kolmogorov(ret: DataFrame) -> DataFrame:
    """The greatest distance between the distribution functions of each asset's two halves."""
    w = Window.partitionBy("ticker")
    t = ret.where("r is not null").withColumn("late", (F.row_number().over(w.orderBy("wk")) * 2 > F.count("r").over(w)).cast("int"))
    t = t.groupBy("ticker", "r").agg(F.sum("late").alias("b"), F.sum(1 - F.col("late")).alias("a"))
    up = w.orderBy("r")
    t = t.withColumn("d", F.abs(F.sum("a").over(up) / F.sum("a").over(w) - F.sum("b").over(up) / F.sum("b").over(w)))
    return t.groupBy("ticker").agg(F.max("d").alias("ks"), F.sum("a").alias("n_ref"), F.sum("b").alias("n_cur"))


def black_scholes_price(s: Column, k: Column, t: Column, v: Column, call: Column, r: float) -> Column:
    d1 = (F.ln(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))
    d2, fade = d1 - v * F.sqrt(t), F.exp(-r * t)
    return F.when(call, s * phi(d1) - k * fade * phi(d2)).otherwise(k * fade * phi(-d2) - s * phi(-d1))


def black_scholes(chain: DataFrame, r: float = 0.04) -> DataFrame:
    """Price and greeks of calls and puts; ``chain``: id, s, k, t, sigma, kind (C or P)."""
    s, k, t, v = (F.col(c) for c in ("s", "k", "t", "sigma"))
    call = F.col("kind") == "C"
    d1 = (F.ln(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))
    d2 = d1 - v * F.sqrt(t)
    fade = F.exp(-r * t)
    out = chain.withColumns({"d1": d1, "d2": d2})
    d1, d2 = F.col("d1"), F.col("d2")
    price = F.when(call, s * phi(d1) - k * fade * phi(d2)).otherwise(k * fade * phi(-d2) - s * phi(-d1))
    return out.select(
        "id", "kind", "k", "oi", price.alias("price"), F.when(call, phi(d1)).otherwise(phi(d1) - 1).alias("delta"), (density(d1) / (s * v * F.sqrt(t))).alias("gamma"), (s * density(d1) * F.sqrt(t) / 100).alias("vega"), F.when(call, phi(d2)).otherwise(phi(-d2)).alias("p_itm")
    )


def dealer_gamma(valued: DataFrame, spot: float) -> DataFrame:
    """Gamma exposure by strike, calls less puts, and its running sum."""
    g = valued.groupBy("k").agg(F.sum(F.when(F.col("kind") == "C", F.col("gamma") * F.col("oi")).otherwise(-F.col("gamma") * F.col("oi")) * 100 * spot * spot * 0.01).alias("gex"), F.sum("oi").alias("oi"))
    return g.withColumn("total", F.sum("gex").over(Window.orderBy("k")))


def touch_odds(bars: DataFrame, weeks: int = 63, ahead: int = 21) -> DataFrame:
    """Chances to touch the highest and lowest close of the last weeks, without drift, and the edge between them."""
    w = Window.partitionBy("ticker").orderBy("wk")
    t = bars.withColumn("lr", F.ln(F.col("c") / F.lag("c").over(w))).withColumn("age", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("wk")))).where(F.col("age") <= weeks)
    t = t.groupBy("ticker").agg(F.max("c").alias("hi"), F.min("c").alias("lo"), F.stddev_samp("lr").alias("sd"), F.max(F.when(F.col("age") == 1, F.col("c"))).alias("c"))
    odds = lambda b: clamp(2 * (1 - phi(F.abs(F.ln(F.col(b) / F.col("c"))) / (F.col("sd") * math.sqrt(ahead)))), 0.0, 1.0)
    t = t.withColumns({"p_hi": odds("hi"), "p_lo": odds("lo")})
    return t.select("ticker", "p_hi", "p_lo", (F.col("p_hi") * 100 * (F.col("hi") / F.col("c") - 1) - F.col("p_lo") * 100 * (1 - F.col("lo") / F.col("c"))).alias("ev"))


#: Words that speak for and against, and words that turn them round.
GOOD = """
    beat beats beating exceeded exceed exceeds outperform outperformed upgrade upgraded raise raised raises strong strength growth grow grows gains
    gain profit profitable record surge surged rally rallied soar soared jump jumped rose rise rises boost boosted bullish optimistic accelerate
    accelerated expansion expand robust momentum recovery rebound rebounded breakthrough approval approved win won wins awarded partnership buyback
    repurchase milestone leading leader innovative efficient improve improved improving opportunity favorable positive success successful secured
    achieve achieved premium demand upside confident confidence resilient durable tailwind tailwinds outpaced beat-and-raise expands surpass
    surpassed accretive
""".split()
BAD = """
    miss missed misses missing downgrade downgraded cut cuts lowered lower weak weakness decline declined declines drop dropped fall fell falls
    plunge plunged slump slumped loss losses lawsuit sued investigation probe fraud recall recalled bankruptcy bankrupt default layoff layoffs
    restructuring warning warned warns concern concerns risk risks risky bearish pessimistic slowdown slowing headwind headwinds shortfall
    disappointing disappoint disappointed underperform underperformed fines penalty delay delayed halt halted suspended downturn recession selloff
    sell-off crash struggle struggled struggling deteriorate deteriorating impairment writedown write-down dilution dilutive breach hack outage
    disruption scandal resign resigned ousted slash slashed plummet plummeted tumble tumbled subpoena litigation
""".split()
TURN = "not no never without fails failed fail lack lacks lacking hardly barely n't cannot".split()
#: Words of a lexicon at most: it is part of the query's plan.
LEXICON = 10_000


def lexicon_of(table: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """The words of a table ``word, side`` (1 for, -1 against, 0 turns round) for ``sentiment``; over ``LEXICON`` rows it raises."""
    found = table.select(F.lower("word").alias("word"), "side").dropna().distinct().limit(LEXICON + 1).collect()
    if len(found) > LEXICON:
        raise ValueError(f"a lexicon has {LEXICON} words at most")
    return tuple(sorted(r.word for r in found if r.side == side) for side in (1, -1, 0))


def sentiment(texts: DataFrame, key: str, text: str, lexicon: tuple[list[str], list[str], list[str]] = (GOOD, BAD, TURN)) -> DataFrame:
    """Words for and against; one that turns them round, among the three before, changes the side. A word in both lists speaks for.
    One pass over a text's words that keeps the place of the last one that turns round. Null texts have no words."""
    good, bad, turn = lexicon
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z][a-z'-]+"), F.lit(0))
    zero = F.lit(0).cast("long")

    def count(s: Column, w: Column) -> Column:
        turned = s["at"] - s["turn"] <= 3
        for_, against = w.isin(good), ~w.isin(good) & w.isin(bad)
        up, down = (for_ & ~turned) | (against & turned), (for_ & turned) | (against & ~turned)
        return F.struct((s["at"] + 1).alias("at"), F.when(w.isin(turn), s["at"]).otherwise(s["turn"]).alias("turn"), (s["good"] + up.cast("long")).alias("good"), (s["bad"] + down.cast("long")).alias("bad"))

    start = F.struct(zero.alias("at"), F.lit(-4).cast("long").alias("turn"), zero.alias("good"), zero.alias("bad"))
    t = texts.select(key, F.aggregate(words, start, count).alias("s")).select(key, F.col("s.at").alias("n"), "s.good", "s.bad")
    return t.withColumn("polarity", F.coalesce(ratio(F.col("good") - F.col("bad"), F.col("good") + F.col("bad")), F.lit(0.0)))


def event_intensity(events: DataFrame, tau: float = 10.0) -> DataFrame:
    """Events by type: number, last, and intensity that fades with age in days before the newest event."""
    newest = events.agg(F.max(F.to_date("ts")).alias("_now"))
    t = events.join(F.broadcast(newest))  # one row
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.exp(-F.datediff("_now", F.to_date("ts")) / tau)).alias("intensity"), F.max(F.to_date("ts")).alias("last"))


def quarter_hours(events: DataFrame) -> DataFrame:
    """Counts and mean value by type and quarter of an hour, with the log count's robust z by time of day."""
    b = events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    b = b.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "mean").withColumn("tod", (F.hour("start") * 4 + F.minute("start") / 15).cast("int")).withColumn("x", F.ln(1.0 + F.col("n")))
    day = Window.partitionBy("event_type", "tod")
    b = b.withColumn("med", F.percentile("x", F.lit(0.5)).over(day)).withColumn("mad", F.percentile(F.abs(F.col("x") - F.col("med")), F.lit(0.5)).over(day))
    return b.select("event_type", "start", "n", "mean", (0.6745 * (F.col("x") - F.col("med")) / F.greatest("mad", F.lit(1e-3))).alias("z"))


def quality_gate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows break each rule, and whether the table passes."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()))
    return counts.withColumn("passes", sum((F.col(n) for n in checks), F.lit(0)) == 0)

"""What events, crowding, debt, drivers and reported figures add to a name's forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp

#: How grave the items of a current report are; other items count OTHER_ITEM.
SEVERITY = {
    "1.01": 0.55, "1.02": 0.55, "1.03": 0.95, "2.01": 0.70, "2.02": 0.60, "2.03": 0.45, "2.04": 0.60, "2.05": 0.55, "2.06": 0.80, "3.01": 0.65, "3.02": 0.40, "3.03": 0.45,
    "4.01": 0.85, "4.02": 0.95, "5.01": 0.70, "5.02": 0.55, "5.03": 0.30, "5.07": 0.25, "7.01": 0.30, "8.01": 0.25,
}
OTHER_ITEM = 0.25


def severity(items: Column) -> Column:
    """The gravest item of a report; zero without items."""
    table = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return F.coalesce(F.array_max(F.transform(items, lambda i: F.coalesce(F.try_element_at(table, F.trim(i)), F.lit(OTHER_ITEM)))), F.lit(0.0))


def stake(form: Column, change: Column, new: Column, sign: float = 1.0) -> Column:
    """A disclosed stake as a signal within one: the change in percent of the company, more for active holders and new stakes."""
    weight = F.when(F.upper(form).startswith("13D"), 1.0).otherwise(0.45)
    return clamp(sign * weight * (change / 5 + F.when(new, 0.4).otherwise(0.0)), -1.0, 1.0)


def insider_net(bought: Column, sold: Column, planned: Column, share: float = 0.35) -> Column:
    """Purchases against sales, of which planned ones count in part."""
    out = sold + share * planned
    return (bought - out) / (bought + out + 1e-9)


def event_tilt(abnormal: Column, intensity: Column, held: Column, insiders: Column, cap: float = 3.0) -> Column:
    """The events' part of an expected return in percent, within the cap; null where a part is."""
    total = 0.6 * F.tanh(abnormal / 0.05) + 0.4 * F.tanh(intensity / 2.0) + 0.5 * held + 0.5 * insiders
    return F.when(total.isNotNull(), clamp(total, -cap, cap))


def crowding(shorts: DataFrame) -> DataFrame:
    """Crowding by name from ``ticker, fails, volume`` (a day's), ``floats, cap, close, level, trend``: days to cover, the short
    part of the float (else of the shares that the capitalisation stands for), use of lendable shares, fee, penalty, and whether a
    squeeze looms. Names without open shorts have no row."""
    fails = F.col("fails")
    days = F.when(F.col("volume") > 0, fails / F.col("volume"))
    shares = F.when(F.col("close") > 0, F.col("cap") / F.col("close"))
    part = F.when(F.col("floats") > 0, fails / F.col("floats")).when(shares > 0, fails / shares)
    source = F.when(F.col("floats") > 0, "float").when(shares > 0, "cap")
    use = F.when(days.isNull(), 0.0).otherwise(clamp(days / 10, 0.0, 0.95))
    penalty = 0.6 * F.coalesce(part, F.lit(0.0)) + 0.5 * F.greatest(use - 0.5, F.lit(0.0))
    squeeze = part.isNotNull() & (F.coalesce(days >= 3, F.lit(False)) | F.coalesce((F.col("level") == "elevated") & (F.col("trend") == "rising"), F.lit(False)))
    return shorts.where("fails > 0").select("ticker", days.alias("days_to_cover"), (part * 100).alias("short_pct"), source.alias("source"), use.alias("utilization"), (0.3 + 9.7 * F.pow(use, 4)).alias("borrow_fee"), penalty.alias("penalty"), squeeze.alias("squeeze"))


def short_net(mu: Column, fee_pct: Column, share_of_year: float = 1.0, recall: float = 0.0) -> Column:
    """A short's edge after borrowing for a share of the year and a penalty for recalls."""
    return mu - fee_pct / 100 * share_of_year - recall


def bounded(a: Column, b: Column, cap: float) -> Column:
    """A ratio within the cap; null for a null or zero denominator."""
    r = F.try_divide(a, b)
    return F.when(r.isNotNull(), clamp(r, -cap, cap))


def debt_growth(levels: DataFrame, key: str, at: str, debt: str) -> DataFrame:
    """By key, over its positive levels in order: their number, the last step and the mean step; two levels at least."""
    t = levels.where(F.col(debt) > 0)
    own = Window.partitionBy(key).orderBy(at)
    t = t.withColumn("_step", F.col(debt) / F.lag(debt).over(own) - 1)
    g = t.groupBy(key).agg(F.count(debt).alias("levels"), F.max_by("_step", at).alias("last_step"), F.min_by(debt, at).alias("_a"), F.max_by(debt, at).alias("_b"))
    return g.where("levels > 1").select(key, "levels", "last_step", (F.pow(F.col("_b") / F.col("_a"), 1 / (F.col("levels") - 1)) - 1).alias("growth"))


def credit_report(companies: DataFrame, levels: DataFrame, key: str, at: str, debt: str) -> DataFrame:
    """Credit ratios from ``cap, debt, cash, equity, ebitda, ebit, interest, preferred, minority``, the growth of debt, a tilt
    within one from the parts that are known, and a verdict. Ratios over earnings or equity that aren't positive are null."""
    c = companies.join(debt_growth(levels, key, at, debt), key, "left")
    net = F.col("debt") - F.col("cash")
    ev = F.col("cap") + net + F.coalesce("preferred", F.lit(0.0)) + F.coalesce("minority", F.lit(0.0))
    earned, equity = F.when(F.col("ebitda") > 0, F.col("ebitda")), F.when(F.col("equity") > 0, F.col("equity"))
    c = c.select(key, net.alias("net_debt"), ev.alias("ev"), bounded(ev, earned, 200.0).alias("ev_ebitda"), bounded(net, earned, 50.0).alias("net_debt_ebitda"), bounded(F.col("debt"), equity, 50.0).alias("debt_equity"), bounded(F.col("ebit"), F.abs("interest"), 100.0).alias("coverage"), F.coalesce(net < 0, F.lit(False)).alias("net_cash"), "growth", "last_step")
    part = lambda x: F.when(x.isNotNull(), clamp(x, -1.0, 1.0))
    leverage = F.when(F.col("net_cash"), 1.0).otherwise(part((2 - F.col("net_debt_ebitda")) / 4))
    parts = [(leverage, 0.45), (part((F.col("coverage") - 4) / 6), 0.35), (part(-F.col("growth") / 0.2), 0.20)]
    up = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    down = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    times, over = F.col("net_debt_ebitda"), F.col("debt_equity")
    verdict = (
        F.when(F.col("net_cash"), "net cash").when(times >= 4, "high leverage").when(times <= 1.5, "low leverage").when(over >= 2, "elevated D/E")
        .when(times.isNotNull() | over.isNotNull(), "moderate").otherwise("insufficient data")
    )
    return c.withColumn("tilt", F.try_divide(up, down)).withColumn("verdict", verdict)


def macro_tilt(betas: DataFrame, moves: DataFrame, real: DataFrame | None = None, weight: float = 1.0) -> DataFrame:
    """By name, the sum of its sensitivities (``ticker, factor, beta``) times the factors' moves (``factor, move``), the market
    left out. Where a name has sensitivities to the real curve (``real``, alike), those stand for the nominal rate ``RATE``.
    Missing betas, moves and factors add nothing; every name in ``betas`` has a row."""
    finite = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    m = moves.groupBy("factor").agg(F.max(finite("move")).alias("move"))
    b = betas.select("ticker", "factor", finite("beta").alias("beta"), F.lit(False).alias("real"))
    if real is not None:
        b = b.unionByName(real.select("ticker", "factor", finite("beta").alias("beta"), F.lit(True).alias("real")))
    b = b.join(m, "factor", "left").withColumn("part", F.coalesce(F.col("beta") * F.col("move"), F.lit(0.0)))
    nominal, curve = ~F.col("real") & (F.col("factor") != "MKT"), F.col("real")
    g = b.where("ticker is not null").groupBy("ticker").agg(
        F.sum(F.when(nominal & (F.col("factor") != "RATE"), F.col("part")).otherwise(0.0)).alias("drivers"), F.sum(F.when(nominal & (F.col("factor") == "RATE"), F.col("part")).otherwise(0.0)).alias("rate"),
        F.sum(F.when(curve, F.col("part")).otherwise(0.0)).alias("curve"), F.max(F.when(curve, True).otherwise(False)).alias("has"), F.max(~F.col("real")).alias("named"),
    )
    return g.where("named").select("ticker", (F.col("drivers") + F.when(F.col("has"), weight * F.col("curve")).otherwise(F.col("rate"))).alias("tilt"), F.when(F.col("has"), "real curve").otherwise("nominal").alias("rates"))


def multiples(quarters: DataFrame, key: str, at: str) -> DataFrame:
    """Quarterly figures (``price, shares, eps, revenue, ebitda, fcf, income, ev, estimate``) as multiples of the last four
    quarters, growth on the same quarter a year before, the surprise, and a year's return as growth of earnings and change of the
    multiple. A ratio over zero or a missing figure is null; so is a sum of fewer than four quarters. ``at`` counts quarters."""
    own = Window.partitionBy(key).orderBy(at)
    year, same = own.rangeBetween(-3, 0), own.rangeBetween(-4, -4)
    four = lambda c: F.when(F.count(c).over(year) == 4, F.sum(c).over(year))
    ago = lambda c: F.first(c).over(same)
    over = F.try_divide
    t = quarters.select("*", four("eps").alias("_eps"), four("revenue").alias("_rev"), four("ebitda").alias("_ebitda"), four("fcf").alias("_fcf"), ago("eps").alias("_eps4"), ago("shares").alias("_shares4"), ago("price").alias("_price4"))
    t = t.withColumn("_eps_then", F.first("_eps").over(same))
    now, then = over(F.col("price"), F.col("_eps")), over(F.col("_price4"), F.col("_eps_then"))
    return t.select(
        key, at, now.alias("pe"), over(F.col("ev"), F.col("_ebitda")).alias("ev_ebitda"), over(F.col("ev"), F.col("_rev")).alias("ev_sales"), over(F.col("_fcf"), F.col("price") * F.col("shares")).alias("fcf_yield"), (over(F.col("eps"), F.col("_eps4")) - 1).alias("yoy"),
        (over(F.col("shares"), F.col("_shares4")) - 1).alias("dilution"), over(F.col("fcf"), F.col("income")).alias("cash_conversion"), over(F.col("eps") - F.col("estimate"), F.abs("estimate")).alias("surprise"),
        (over(F.col("_eps"), F.col("_eps_then")) - 1).alias("earned"), (over(now, then) - 1).alias("rerated"), (over(F.col("price"), F.col("_price4")) - 1).alias("moved"),
    )

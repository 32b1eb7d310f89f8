"""Queries of ranks, breadth, and what events, crowding, debt, drivers and reported figures add, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import z
from ..operators import ranking, tilts
from ..operators.time_series import newest_first
from ..sources.panels import market, sql, table, weekly_bars, weekly_returns
from .time_series import rounded


def _returns(s: SparkSession, d: str) -> DataFrame:
    return weekly_returns(weekly_bars(s, d)).where("lr is not null")


def _names(s: SparkSession, d: str, skip: int) -> DataFrame:
    """Totals and deviations in percent over 13 weeks, the last of which are left out; one sector's errors are unknown."""
    t = _returns(s, d).withColumn("age", F.row_number().over(newest_first())).where((F.col("age") > skip) & (F.col("age") <= skip + 13))
    g = t.groupBy("ticker", "sec").agg((100 * F.avg("lr")).alias("total"), (100 * F.stddev_samp("lr")).alias("sigma"), F.count("lr").alias("n"))
    return g.select("ticker", "total", z(F.col("total"), Window.partitionBy()).alias("z"), "sigma", F.when(F.col("sec") != "Brand#1", F.col("sigma") / F.sqrt("n")).alias("se"))


def _rank(s: SparkSession, d: str) -> DataFrame:
    before = ranking.composite_rank(_names(s, d, 1)).select("ticker", "score")
    return rounded(ranking.composite_rank(_names(s, d, 0), before, share=0.5), 5)


def _bayes(s: SparkSession, d: str) -> DataFrame:
    g = _returns(s, d).groupBy("ticker", "sec").agg((100 * F.avg("lr")).alias("alpha"), (100 * F.stddev_samp("lr")).alias("sigma"), F.count("lr").alias("n")).withColumn("se", F.col("sigma") / (10 * F.sqrt("n")))
    t = ranking.empirical_bayes(g, "sec", "alpha", "se")
    cost = ranking.trading_cost(F.col("sigma") / 100)
    mu = F.col("mu")
    return rounded(t.select(
        "ticker", "sec", "alpha", "se", "tau2", "mu", "sd", "weight", cost.alias("cost"), ranking.toward_zero(mu, cost).alias("net"), ranking.faded(mu, F.lit(21), F.lit(10.0)).alias("later"),
        ranking.held(F.col("alpha"), mu, 0.05).alias("held"), ranking.deflated(F.col("alpha") / F.col("se"), F.lit(25.0)).alias("beyond_chance"), ranking.expected_return(F.lit(0.05), F.col("sigma"), F.col("alpha") / F.col("se")).alias("expected"),
    ), 5)


def _breadth(s: SparkSession, d: str) -> DataFrame:
    """By sector, names and the mean correlation of each with the others, by the variance of the mean of standardised returns."""
    own = Window.partitionBy("ticker")
    r = _returns(s, d).withColumn("x", (F.col("lr") - F.avg("lr").over(own)) / F.stddev_samp("lr").over(own))
    n = r.groupBy("sec").agg(F.count_distinct("ticker").alias("n"))
    weeks = r.groupBy("sec", "wk").agg(F.avg("x").alias("mean"), F.count("x").alias("k")).join(n, "sec").where("k = n")
    g = weeks.groupBy("sec", "n").agg(F.when(F.col("n") > 1, (F.var_samp("mean") * F.col("n") - 1) / (F.col("n") - 1)).alias("rho"))
    volume = weekly_bars(s, d).groupBy("sec", "ticker").agg(F.sum("v").alias("v"))
    return rounded(g.select("sec", "n", "rho", ranking.effective_breadth(F.col("n"), F.col("rho")).alias("breadth")).join(ranking.entropy_bets(volume, "sec", "v"), "sec"))


def _events(s: SparkSession, d: str) -> DataFrame:
    """Orders as current reports, their priority as items; customers as companies."""
    o = table(s, d, "orders").where("o_custkey is not null")
    p = F.substring("o_orderpriority", 1, 1)
    o = o.withColumn("grave", tilts.severity(F.array(F.concat(p, F.lit(".02")), F.concat(F.lit(" "), p, F.lit(".03"))))).withColumn("age", F.datediff(F.lit("1998-09-01").cast("date"), "o_orderdate"))
    paid = lambda k: F.sum(F.when(F.col("o_orderstatus") == k, F.col("o_totalprice")).otherwise(0.0))
    g = o.groupBy("o_custkey").agg(F.sum(F.when(F.col("age") >= 0, F.col("grave") * F.exp(-F.col("age") / 10.0)).otherwise(0.0)).alias("intensity"), F.max("grave").alias("gravest"), paid("F").alias("bought"), paid("O").alias("sold"), paid("P").alias("planned"), F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("n"))
    key = F.col("o_custkey")
    held = tilts.stake(F.when(key % 2 == 0, "13D/A").otherwise("13G"), (F.col("n") % 7 - 3).cast("double"), key % 5 == 0)
    net = tilts.insider_net(F.col("bought"), F.col("sold"), F.col("planned"))
    return rounded(g.select("o_custkey", "gravest", "intensity", held.alias("stake"), net.alias("insiders"), tilts.event_tilt(F.col("mean") / 1e6 - 0.15, F.col("intensity"), held, net).alias("tilt")))


def _crowding(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("ticker")).agg(F.sum(F.when(F.col("l_tax") > 0.07, F.col("l_quantity")).otherwise(0.0)).alias("fails"))
    floats = table(s, d, "part").groupBy(F.col("p_brand").alias("ticker")).agg((F.sum("p_size") * 50.0).alias("floats"), (F.sum("p_retailprice") * 100).alias("cap"))
    bars = weekly_bars(s, d).withColumn("age", F.row_number().over(newest_first())).groupBy("ticker", "sec").agg(F.avg(F.when(F.col("age") <= 21, F.col("v"))).alias("volume"), F.max_by("c", "wk").alias("close"))
    t = bars.join(items, "ticker").join(floats, "ticker")
    odd = F.substring("ticker", -1, 1).isin("1", "3")
    t = t.select("ticker", "fails", (F.col("volume") * 10).alias("volume"), F.when(~odd, F.col("floats")).alias("floats"), F.when(F.col("sec") != "Brand#1", F.col("cap")).alias("cap"), "close", F.lit("elevated").alias("level"), F.when(odd, "rising").otherwise("falling").alias("trend"))
    return rounded(tilts.crowding(t).withColumn("short_net", tilts.short_net(F.lit(1.0), F.col("borrow_fee"), 0.25)))


def _credit(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as companies: returned items as debt, accepted ones as cash for a third of them."""
    i = table(s, d, "lineitem").withColumnRenamed("l_suppkey", "company")
    flag = lambda k: F.sum(F.when(F.col("l_returnflag") == k, F.col("l_extendedprice")).otherwise(0.0))
    sums = i.groupBy("company").agg(flag("R").alias("debt"), (flag("A") * (F.col("company") % 3) * 0.6).alias("cash"), F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.045)).alias("ebitda"), (F.sum(F.col("l_extendedprice") * F.col("l_tax")) * F.when(F.col("company") % 4 == 0, 0.0).otherwise(-0.02)).alias("interest"))
    c = table(s, d, "supplier").join(sums, F.col("s_suppkey") == F.col("company")).select("company", (F.abs("s_acctbal") * 500).alias("cap"), "debt", "cash", (F.col("s_acctbal") * 100).alias("equity"), "ebitda", (F.col("ebitda") * 0.8).alias("ebit"), "interest", F.lit(None).cast("double").alias("preferred"), F.lit(100.0).alias("minority"))
    levels = i.groupBy("company", F.year("l_shipdate").alias("y")).agg(flag("R").alias("owed"))
    return rounded(tilts.credit_report(c, levels, "company", "y", "owed"))


def _drivers(s: SparkSession, d: str) -> DataFrame:
    """Sectors as drivers: the first as the nominal rate, the last three also as the real curve, which one sector's names know."""
    r = _returns(s, d)
    sectors = r.groupBy("wk", F.when(F.col("sec") == "Brand#1", "RATE").otherwise(F.col("sec")).alias("factor")).agg(F.avg("lr").alias("f"))
    f = sectors.unionByName(market(r).select("wk", F.lit("MKT").alias("factor"), F.col("m").alias("f")))
    betas = r.join(f, "wk").groupBy("ticker", "sec", "factor").agg(F.regr_slope("lr", "f").alias("beta"))
    curve = betas.where("sec = 'Brand#2' and factor in ('Brand#3', 'Brand#4', 'Brand#5')")
    moves = f.groupBy("factor").agg(F.max_by("f", "wk").alias("move")).where("factor != 'Brand#2'")  # one driver didn't report
    return rounded(tilts.macro_tilt(betas, moves, curve, 0.5))


def _quarters(s: SparkSession, d: str) -> DataFrame:
    at = F.year("l_shipdate") * 4 + F.quarter("l_shipdate")
    p = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    i = table(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("brand", at.alias("q")).agg(
        F.sum("l_quantity").alias("shares"), F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.04)).alias("income"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("ebitda"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0)).alias("fcf"))
    t = i.withColumn("eps", F.col("income") / F.col("shares")).withColumn("price", F.col("revenue") / F.col("shares"))
    t = t.withColumn("estimate", F.lag("eps").over(Window.partitionBy("brand").orderBy("q"))).withColumn("ev", F.col("revenue") * 1.2)
    return rounded(tilts.multiples(t, "brand", "q"))


QUERIES = {
    "composite_rank": _rank,
    "empirical_bayes_alpha": _bayes,
    "breadth_of_bets": _breadth,
    "event_tilt": _events,
    "crowding_penalty": _crowding,
    "credit_report": _credit,
    "macro_tilt": _drivers,
    "quarterly_multiples": _quarters,
}


def _ranked(skip: int, name: str) -> str:
    return f"""{name}_g AS (SELECT ticker, sec, 100 * avg(lr) AS total, 100 * stddev_samp(lr) AS sigma, count(*) AS n FROM a WHERE age > {skip} AND age <= {skip + 13} GROUP BY ticker, sec),
{name}_z AS (SELECT ticker, total, coalesce((total - avg(total) OVER ()) / CASE WHEN stddev_samp(total) OVER () > 0 THEN stddev_samp(total) OVER () ELSE 1 END, 0) AS z, sigma, CASE WHEN sec <> 'Brand#1' THEN sigma / sqrt(n) END AS se, sqrt(2 * ln(count(*) OVER ())) AS bar FROM {name}_g),
{name} AS (SELECT *, (total - CASE WHEN total >= 0 THEN 1 ELSE -1 END * greatest(coalesce(0.5 * CASE WHEN se > 0 THEN se ELSE sigma / greatest(least(abs(z) / 1.5, 1), 0.2) END, 0), 0)) * CASE WHEN bar > 0 THEN least(abs(z) / bar, 1) ELSE 1 END AS fresh FROM {name}_z)"""


_grave = "greatest(" + ", ".join("CASE p || '.0" + n + "' " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tilts.SEVERITY.items()) + " ELSE 0.25 END" for n in "23") + ")"
_pct = lambda x: f"round({x}, 6) + 0.0"
ORACLE_SQL = {
    "composite_rank": sql(", a AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) AS age FROM ret WHERE lr IS NOT NULL), " + _ranked(1, "b") + ", " + _ranked(0, "n") + """
SELECT n.ticker, round(n.total, 5) + 0.0 AS total, round(n.z, 5) + 0.0 AS z, round(n.sigma, 5) AS sigma, round(n.se, 5) AS se, round(n.fresh, 5) + 0.0 AS fresh, round(CASE WHEN b.fresh IS NULL THEN n.fresh ELSE (n.fresh + b.fresh) / 2 END, 5) + 0.0 AS score FROM n LEFT JOIN b USING (ticker)"""),
    "empirical_bayes_alpha": sql(""", g AS (SELECT ticker, sec, 100 * avg(lr) AS alpha, 100 * stddev_samp(lr) AS sigma, 100 * stddev_samp(lr) / (10 * sqrt(count(*))) AS se FROM ret WHERE lr IS NOT NULL GROUP BY ticker, sec),
t AS (SELECT *, CASE WHEN count(*) OVER w >= 3 THEN greatest(var_samp(alpha) OVER w - avg(se * se) OVER w, 0) ELSE 0 END AS tau2, avg(alpha) OVER w AS center FROM g WINDOW w AS (PARTITION BY sec)),
m AS (SELECT *, CASE WHEN tau2 > 0 THEN tau2 / (tau2 + se * se) ELSE 1 END AS w, 2 * (0.02 + 0.05 * sigma / 100) + 0.1 * sqrt(0.05) * sigma / 100 AS cost FROM t), f AS (SELECT *, center * (1 - w) + w * alpha AS mu, CASE WHEN tau2 > 0 THEN sqrt(w) * se ELSE se END AS sd FROM m)
SELECT ticker, sec, round(alpha, 5) + 0.0 AS alpha, round(se, 5) AS se, round(tau2, 5) AS tau2, round(mu, 5) + 0.0 AS mu, round(sd, 5) AS sd, round(w, 5) AS weight, round(cost, 5) AS cost, round(mu - CASE WHEN mu >= 0 THEN cost ELSE -cost END, 5) + 0.0 AS net, round(mu * pow(0.5, 2.1), 5) + 0.0 AS later,
round(CASE WHEN abs(mu - alpha) <= 0.05 THEN alpha ELSE mu END, 5) + 0.0 AS held, round(sign(alpha) * greatest(abs(alpha / se) - sqrt(2 * ln(25)), 0), 5) + 0.0 AS beyond_chance, round(0.05 * sigma * alpha / se, 5) + 0.0 AS expected FROM f"""),
    "breadth_of_bets": sql(""", x AS (SELECT sec, ticker, wk, (lr - avg(lr) OVER w) / stddev_samp(lr) OVER w AS x FROM ret WHERE lr IS NOT NULL WINDOW w AS (PARTITION BY ticker)), n AS (SELECT sec, count(DISTINCT ticker) AS n FROM x GROUP BY sec),
k AS (SELECT sec, n, wk, avg(x) AS mean FROM x JOIN n USING (sec) GROUP BY sec, n, wk HAVING count(x) = n), g AS (SELECT sec, n, CASE WHEN n > 1 THEN (var_samp(mean) * n - 1) / (n - 1) END AS rho FROM k GROUP BY sec, n),
v AS (SELECT sec, ticker, sum(v) AS v FROM bars GROUP BY sec, ticker), s AS (SELECT sec, v / sum(v) OVER (PARTITION BY sec) AS p FROM v), e AS (SELECT sec, exp(-sum(p * ln(p))) AS bets FROM s GROUP BY sec)
SELECT sec, n, round(rho, 6) + 0.0 AS rho, round(greatest(n / (1 + (n - 1) * least(greatest(coalesce(rho, 0), 0), 0.999)), 1), 6) AS breadth, round(bets, 6) AS bets FROM g JOIN e USING (sec)"""),
    "event_tilt": f"""WITH o AS (SELECT *, substr(o_orderpriority, 1, 1) AS p, date_diff('day', o_orderdate::DATE, DATE '1998-09-01') AS age FROM orders), g AS (SELECT *, {_grave}::DOUBLE AS grave FROM o),
a AS (SELECT o_custkey, sum(CASE WHEN age >= 0 THEN grave * exp(-age / 10) ELSE 0 END) AS i, max(grave) AS gravest, coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0) AS b, coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0) + 0.35::DOUBLE * coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0) AS s, avg(o_totalprice) AS m, count(*) AS n FROM g GROUP BY o_custkey),
t AS (SELECT *, greatest(least(CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0.45::DOUBLE END * ((n % 7 - 3) / 5 + CASE WHEN o_custkey % 5 = 0 THEN 0.4::DOUBLE ELSE 0 END), 1), -1) AS st, (b - s) / (b + s + 1e-9) AS net FROM a)
SELECT o_custkey, gravest, {_pct('i')} AS intensity, {_pct('st')} AS stake, {_pct('net')} AS insiders, {_pct("greatest(least(0.6::DOUBLE * tanh((m / 1e6 - 0.15::DOUBLE) / 0.05::DOUBLE) + 0.4::DOUBLE * tanh(i / 2) + 0.5 * st + 0.5 * net, 3), -3)")} AS tilt FROM t""",
    "crowding_penalty": sql(""", i AS (SELECT p_brand AS ticker, sum(CASE WHEN l_tax > 0.07 THEN l_quantity ELSE 0 END) AS fails FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand), p AS (SELECT p_brand AS ticker, sum(p_size) * 50.0::DOUBLE AS fl, sum(p_retailprice) * 100 AS cap FROM part GROUP BY p_brand),
a AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) AS age FROM bars), b AS (SELECT ticker, sec, avg(v) FILTER (WHERE age <= 21) * 10 AS vol, arg_max(c, wk) AS c FROM a GROUP BY ticker, sec),
t AS (SELECT *, right(ticker, 1) IN ('1', '3') AS odd, fails / vol AS d FROM b JOIN i USING (ticker) JOIN p USING (ticker) WHERE fails > 0),
u AS (SELECT *, CASE WHEN NOT odd THEN fails / fl WHEN sec <> 'Brand#1' THEN fails / (cap / c) END AS part, CASE WHEN NOT odd THEN 'float' WHEN sec <> 'Brand#1' THEN 'cap' END AS source, greatest(least(d / 10, 0.95), 0) AS u FROM t)
SELECT ticker, round(d, 6) AS days_to_cover, round(part * 100, 6) AS short_pct, source, round(u, 6) AS utilization, round(0.3 + 9.7 * pow(u, 4), 6) AS borrow_fee, round(0.6 * coalesce(part, 0) + 0.5 * greatest(u - 0.5, 0), 6) AS penalty, part IS NOT NULL AND (d >= 3 OR odd) AS squeeze, round(1 - (0.3 + 9.7 * pow(u, 4)) / 100 * 0.25, 6) AS short_net FROM u"""),
    "credit_report": """WITH s AS (SELECT l_suppkey AS company, coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 0) AS debt, coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A'), 0) * (l_suppkey % 3) * 0.6::DOUBLE AS cash, sum(l_extendedprice * (l_discount - 0.045::DOUBLE)) AS ebitda, abs(sum(l_extendedprice * l_tax) * CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE 0.02::DOUBLE END) AS interest FROM lineitem GROUP BY l_suppkey),
y AS (SELECT l_suppkey AS company, year(l_shipdate) AS y, sum(l_extendedprice) AS owed FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), st AS (SELECT *, owed / lag(owed) OVER (PARTITION BY company ORDER BY y) - 1 AS step FROM y),
g AS (SELECT company, arg_max(step, y) AS last_step, pow(arg_max(owed, y) / arg_min(owed, y), 1 / (count(*) - 1)) - 1 AS growth FROM st GROUP BY company HAVING count(*) > 1),
c AS (SELECT company, debt - cash AS net, abs(s_acctbal) * 500 + debt - cash + 100 AS ev, CASE WHEN ebitda > 0 THEN ebitda END AS e, CASE WHEN s_acctbal > 0 THEN s_acctbal * 100 END AS q, debt, CASE WHEN interest > 0 THEN greatest(least(ebitda * 0.8::DOUBLE / interest, 100), -100) END AS cov, growth, last_step FROM s JOIN supplier ON s_suppkey = company LEFT JOIN g USING (company)),
r AS (SELECT *, CASE WHEN e IS NOT NULL THEN greatest(least(net / e, 50), -50) END AS nde, CASE WHEN e IS NOT NULL THEN greatest(least(ev / e, 200), -200) END AS eve, CASE WHEN q IS NOT NULL THEN greatest(least(debt / q, 50), -50) END AS de FROM c),
p AS (SELECT *, CASE WHEN net < 0 THEN 1 WHEN nde IS NOT NULL THEN greatest(least((2 - nde) / 4, 1), -1) END AS p1, CASE WHEN cov IS NOT NULL THEN greatest(least((cov - 4) / 6, 1), -1) END AS p2, CASE WHEN growth IS NOT NULL THEN greatest(least(-growth / 0.2::DOUBLE, 1), -1) END AS p3 FROM r)
SELECT company, round(net, 6) + 0.0 AS net_debt, round(ev, 6) + 0.0 AS ev, round(eve, 6) + 0.0 AS ev_ebitda, round(nde, 6) + 0.0 AS net_debt_ebitda, round(de, 6) AS debt_equity, round(cov, 6) + 0.0 AS coverage, net < 0 AS net_cash, round(growth, 6) + 0.0 AS growth, round(last_step, 6) + 0.0 AS last_step,
round((coalesce(p1 * 0.45::DOUBLE, 0) + coalesce(p2 * 0.35::DOUBLE, 0) + coalesce(p3 * 0.2::DOUBLE, 0)) / nullif(CASE WHEN p1 IS NULL THEN 0 ELSE 0.45::DOUBLE END + CASE WHEN p2 IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN p3 IS NULL THEN 0 ELSE 0.2::DOUBLE END, 0), 6) + 0.0 AS tilt,
CASE WHEN net < 0 THEN 'net cash' WHEN nde >= 4 THEN 'high leverage' WHEN nde <= 1.5 THEN 'low leverage' WHEN de >= 2 THEN 'elevated D/E' WHEN nde IS NOT NULL OR de IS NOT NULL THEN 'moderate' ELSE 'insufficient data' END AS verdict FROM p""",
    "macro_tilt": sql(""", f AS (SELECT wk, CASE WHEN sec = 'Brand#1' THEN 'RATE' ELSE sec END AS factor, avg(lr) AS f FROM ret WHERE lr IS NOT NULL GROUP BY ALL), b AS (SELECT ticker, any_value(sec) AS sec, factor, regr_slope(lr, f) AS beta FROM ret JOIN f USING (wk) WHERE lr IS NOT NULL GROUP BY ticker, factor),
m AS (SELECT factor, arg_max(f, wk) AS move FROM f WHERE factor <> 'Brand#2' GROUP BY factor)
SELECT ticker, round(coalesce(sum(beta * move) FILTER (WHERE factor <> 'RATE'), 0) + CASE WHEN any_value(sec) = 'Brand#2' THEN 0.5 * coalesce(sum(beta * move) FILTER (WHERE factor IN ('Brand#3', 'Brand#4', 'Brand#5')), 0) ELSE coalesce(sum(beta * move) FILTER (WHERE factor = 'RATE'), 0) END, 6) + 0.0 AS tilt,
CASE WHEN any_value(sec) = 'Brand#2' THEN 'real curve' ELSE 'nominal' END AS rates FROM b LEFT JOIN m USING (factor) GROUP BY ticker"""),
    "quarterly_multiples": """WITH i AS (SELECT p_brand AS brand, (year(l_shipdate) * 4 + quarter(l_shipdate))::INT AS q, sum(l_quantity) AS shares, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (l_discount - 0.04::DOUBLE)) AS income, sum(l_extendedprice * l_tax) AS ebitda, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS fcf FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
a AS (SELECT *, income / shares AS eps, revenue / shares AS price, lag(income / shares) OVER (PARTITION BY brand ORDER BY q) AS est FROM i),
y AS (SELECT t.*, count(s.q) = 4 AS whole, sum(s.eps) AS e, sum(s.revenue) AS r, sum(s.ebitda) AS b, sum(s.fcf) AS f FROM a t JOIN a s ON s.brand = t.brand AND s.q BETWEEN t.q - 3 AND t.q GROUP BY ALL), w AS (SELECT * REPLACE (CASE WHEN whole THEN e END AS e, CASE WHEN whole THEN r END AS r, CASE WHEN whole THEN b END AS b, CASE WHEN whole THEN f END AS f) FROM y)
SELECT n.brand, n.q, round(n.price / nullif(n.e, 0), 6) + 0.0 AS pe, round(n.revenue * 1.2::DOUBLE / nullif(n.b, 0), 6) + 0.0 AS ev_ebitda, round(n.revenue * 1.2::DOUBLE / nullif(n.r, 0), 6) AS ev_sales, round(n.f / nullif(n.price * n.shares, 0), 6) AS fcf_yield, round(n.eps / nullif(o.eps, 0) - 1, 6) + 0.0 AS yoy, round(n.shares / nullif(o.shares, 0) - 1, 6) + 0.0 AS dilution,
round(n.fcf / nullif(n.income, 0), 6) + 0.0 AS cash_conversion, round((n.eps - n.est) / nullif(abs(n.est), 0), 6) + 0.0 AS surprise, round(n.e / nullif(o.e, 0) - 1, 6) + 0.0 AS earned, round((n.price / nullif(n.e, 0)) / nullif(o.price / nullif(o.e, 0), 0) - 1, 6) + 0.0 AS rerated, round(n.price / nullif(o.price, 0) - 1, 6) + 0.0 AS moved FROM w n LEFT JOIN w o ON o.brand = n.brand AND o.q = n.q - 4""",
}

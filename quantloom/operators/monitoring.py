"""Forecasts that mature in a ledger, an alarm on their calibration that may be looked at any time, and shrunk covariances."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio

#: Where the wealth of a bet is capped, the share of the largest stake taken, evidence that warns and that stops, and
#: the least number of values that is tested.
CAP, SHARE, WARN, KILL, LEAST = 1e12, 0.5, 20.0, 100.0, 20
#: The statistics that are bet on: null mean and bounds.
BETS = {"location": (0.5, 0.0, 1.0), "dispersion": (0.25, 0.0, 0.5)}
#: Assets of a correlation matrix that is iterated on as one row.
MOST_ASSETS = 4096


def ledger(forecasts: DataFrame, outcomes: DataFrame, keys: Sequence[str], now: Column, alpha: float = 0.10) -> DataFrame:
    """``forecasts`` (``keys, matures, mu, sigma, lower, upper``) with ``status`` open or matured, and for matured ones ``y, residual, z,
    side, covered, interval_score``. A forecast matures when ``now`` has reached ``matures`` and its outcome (``keys, y``) is known;
    no outcome is shown before. A null key never meets an outcome; of outcomes that share their keys the least counts."""
    known = outcomes.where("y is not null").groupBy(*keys).agg(F.min("y").alias("_y"))
    t = forecasts.withColumn("_now", now).join(known, list(keys), "left")
    ripe = F.col("_now") >= F.col("matures")
    t = t.withColumn("y", F.when(ripe, F.col("_y"))).drop("_y", "_now")
    y, low, high = F.col("y"), F.col("lower"), F.col("upper")
    side = F.when(y < low, "lower_miss").when(y > high, "upper_miss").when(y.isNotNull(), "inside")
    score = high - low + 2 / alpha * (F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0)))
    return t.select(
        *forecasts.columns, F.when(y.isNotNull(), "matured").otherwise("open").alias("status"), "y", (y - F.col("mu")).alias("residual"),
        ((y - F.col("mu")) / F.greatest("sigma", F.lit(1e-12))).alias("z"), side.alias("side"), (side == "inside").alias("covered"), F.when(y.isNotNull(), score).alias("interval_score"),
    )


def calibration_alarm(values: DataFrame, key: str, at: str, pit: str, tie: str) -> DataFrame:
    """For each key the evidence against uniform ``pit`` values that come in the order of ``at, tie``: ``n, e_value, e_max, p_anytime, level``
    and the largest wealth of each bet.

    Two statistics are bet on, upwards and downwards; each stake follows from the values before. A wealth is a running product that
    is capped: in logarithms a running sum less the most it has stood above the cap so far, so the whole process is two windows and needs
    no loop. Values outside 0 to 1 and missing ones don't count, keys with fewer than ``LEAST`` have no row.
    """
    u = values.where(F.col(pit).between(0.0, 1.0) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(pit).cast("double").alias("u"))
    order = Window.partitionBy("key").orderBy("at", "tie")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("place", F.row_number().over(order))
    stat = {"location": F.col("u"), "dispersion": F.abs(F.col("u") - 0.5)}
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    for name, (m, low, high) in BETS.items():
        dev = max(m - low, high - m)
        x = stat[name]
        u = u.withColumns({f"s_{name}": zero(F.sum(x).over(before)), f"q_{name}": zero(F.sum(x * x).over(before))})
        n = F.col("place") - 1
        mu = (m + F.col(f"s_{name}")) / (1 + n)
        var = F.greatest((dev * dev / 3 + F.col(f"q_{name}") - 2 * mu * F.col(f"s_{name}") + n * mu * mu) / (1 + n), F.lit(1e-12))
        stake = F.least(F.abs((mu - m) / var), F.lit(SHARE / dev))
        for side, sign in (("up", 1), ("down", -1)):
            u = u.withColumn(f"l_{name}_{side}", F.ln(1 + sign * stake * (x - m)))
    sums = {c: F.sum(c).over(so_far) for c in u.columns if c.startswith("l_")}
    u = u.select("key", "place", *(v.alias(c) for c, v in sums.items()))
    cap = math.log(CAP)
    wealth = {c: F.exp(F.col(c) - F.greatest(F.max(c).over(Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - cap, F.lit(0.0))) for c in sums}
    u = u.select("key", "place", *(w.alias(c) for c, w in wealth.items()))
    hedged = {name: (F.col(f"l_{name}_up") + F.col(f"l_{name}_down")) / 2 for name in BETS}
    out = u.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *(F.greatest(F.max(h), F.lit(1.0)).alias(f"max_{name}") for name, h in hedged.items()), *(F.max_by(h, "place").alias(f"end_{name}") for name, h in hedged.items())).where(F.col("n") >= LEAST)
    most = (F.col("max_location") + F.col("max_dispersion")) / 2
    return out.select(
        F.col("key").alias(key), "n", ((F.col("end_location") + F.col("end_dispersion")) / 2).alias("e_value"), most.alias("e_max"), F.least(1 / most, F.lit(1.0)).alias("p_anytime"),
        F.when(most >= KILL, "kill").when(most >= WARN, "warn").otherwise("ok").alias("level"), "max_location", "max_dispersion",
    )


def _complete(panel: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``a, at, x`` on the dates that all assets have, less the asset's mean."""
    p = panel.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("a"), F.col(at).alias("at")).agg(F.avg(value).alias("x"))
    assets = p.agg(F.countDistinct("a").alias("p"))
    full = p.groupBy("at").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(assets), F.col("k") == F.col("p")).select("at")  # one row
    return p.join(full, "at").select("a", "at", (F.col("x") - F.avg("x").over(Window.partitionBy("a"))).alias("x"))


def _products(panel: DataFrame) -> DataFrame:
    """``a, b, s, t``: mean products of the assets' columns over the dates; each pair once, combined before it is shuffled."""
    one, two = panel.select("at", "a", "x"), panel.select("at", F.col("a").alias("b"), F.col("x").alias("y"))
    return one.join(two, "at").where("a <= b").groupBy("a", "b").agg(F.avg(F.col("x") * F.col("y")).alias("s"), F.count(F.lit(1)).alias("t"))


def shrunk_covariance(panel: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``a, b, delta, sample, shrunk`` for each pair of assets (``a <= b``): the sample covariance drawn by ``delta`` towards the mean variance on the
    diagonal and zero beside it, as far as its error of estimation reaches its distance from there. The error follows from the
    squared norms of the dates, so no date meets the whole matrix. Dates that an asset is missing on don't count."""
    c = _complete(panel, key, at, value)
    s = _products(c)
    norm = c.groupBy("at").agg(F.sum(F.col("x") * F.col("x")).alias("n2")).agg(F.sum(F.col("n2") * F.col("n2")).alias("n4"))
    twice = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    total = s.agg(F.count_if(F.col("a") == F.col("b")).alias("p"), F.max("t").alias("_t"), F.avg(F.when(F.col("a") == F.col("b"), F.col("s"))).alias("m"), F.sum(twice * F.col("s") * F.col("s")).alias("f2"))
    t = total.crossJoin(norm)  # one row each
    apart = (F.col("f2") - F.col("p") * F.col("m") * F.col("m")) / F.col("p")
    error = (F.col("n4") - F.col("_t") * F.col("f2")) / (F.col("_t") * F.col("_t") * F.col("p"))
    t = t.select("m", F.greatest(F.least(F.coalesce(ratio(error, F.when(apart > 1e-14 * F.col("f2"), apart)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("delta"))
    return s.crossJoin(F.broadcast(t)).select("a", "b", "delta", F.col("s").alias("sample"), (F.when(F.col("a") == F.col("b"), F.col("delta") * F.col("m")).otherwise(0.0) + (1 - F.col("delta")) * F.col("s")).alias("shrunk"))


def cluster_order(panel: DataFrame, key: str, at: str, value: str, rounds: int = 60) -> DataFrame:
    """``a, loading, place``: assets in the order of their loadings on the leading vector of their correlations, found by power iteration
    from equal loadings; equal loadings by name. The matrix is one row, so over ``MOST_ASSETS`` assets it raises."""
    s = _products(_complete(panel, key, at, value))
    sd = s.where("a = b").select(F.col("a").alias("k"), F.sqrt("s").alias("sd"))
    both = s.select("a", "b", "s").unionByName(s.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    corr = both.join(sd.withColumnsRenamed({"k": "a", "sd": "sa"}), "a").join(sd.withColumnsRenamed({"k": "b", "sd": "sb"}), "b").withColumn("r", F.coalesce(ratio(F.col("s"), F.col("sa") * F.col("sb")), F.lit(0.0)))
    rows = corr.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "r"))), lambda x: x["r"]).alias("row"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("a", "row"))).alias("m"))
    one = one.withColumn("m", F.when(F.size("m") <= MOST_ASSETS, F.col("m")).otherwise(F.raise_error(F.lit(f"over {MOST_ASSETS} assets")).cast(one.schema["m"].dataType)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def turn(v: Column, _: Column) -> Column:
        w = F.transform("m", lambda r: dot(r["row"], v))
        return F.aggregate(F.array(w), F.array().cast("array<double>"), lambda _, x: F.transform(x, lambda y: y / F.coalesce(F.nullif(F.sqrt(dot(x, x)), F.lit(0.0)), F.lit(1.0))))

    start = F.transform("m", lambda _: 1 / F.sqrt(F.size("m")))
    v = one.where(F.size("m") > 0).select("m", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn).alias("v"))
    found = v.select(F.explode(F.arrays_zip(F.transform("m", lambda r: r["a"]).alias("a"), "v")).alias("x")).select(F.col("x.a").alias("a"), F.col("x.v").alias("loading"))
    return found.withColumn("place", F.row_number().over(Window.orderBy("loading", "a")))  # one row an asset

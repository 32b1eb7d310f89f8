"""What was public when: dates of availability, joins on two times, drift of vintages, and information coefficients that mature.

A vintage is a row about a period that became public at a time. Nothing is ever joined to a decision that comes before it was
public, and what has no time of availability is left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import average_rank, ratio

#: Days from the end of the period to the deadline, by form and tier of the filer; 90 for others.
FILING_LAG = {
    ("10-K", "large"): 60,
    ("10-K", "accel"): 75,
    ("10-K", "non"): 90,
    ("10-Q", "large"): 40,
    ("10-Q", "accel"): 40,
    ("10-Q", "non"): 45,
}
OTHER_LAG = 90
#: Hour of the day from which on a filing counts for the next business day.
CUT_OFF = 22


def filing_deadline(period_end: Column, form: Column, filer: Column) -> Column:
    """The last day on which a report on a period is due."""
    lag = F.lit(OTHER_LAG)
    for (f, tier), days in FILING_LAG.items():
        lag = F.when((form == f) & (filer == tier), days).otherwise(lag)
    return F.date_add(period_end, lag)


def available_at(filed: Column, accepted: Column) -> Column:
    """The day a filing is public: that of the filing, or the next business day if it was accepted behind the cut-off or on a
    weekend, or if the day of the filing isn't a business day. An unknown time of acceptance counts as one within the day; a
    null day of filing stays null."""
    weekday = F.weekday(filed)  # 0 is Monday
    following = F.date_add(filed, F.when(weekday >= 4, 7 - weekday).otherwise(1))
    late = (F.weekday(accepted) >= 5) | (F.hour(accepted) >= CUT_OFF)
    return F.when(F.coalesce(late, F.lit(False)) | (weekday >= 5), following).otherwise(filed)


def known_at(vintages: DataFrame, asks: DataFrame, by: Sequence[str], available: str, at: str, state: Sequence[str]) -> DataFrame:
    """``asks`` with the ``state`` of the vintage that ranks highest among those of the same ``by`` available by the ask's time
    ``at``: vintages rank by the columns of ``state`` in turn. With the period first in ``state`` that is the last vintage of
    the latest period known; with the period in ``by``, the vintage of that period as it stood at that time.

    One pass in the order of time, cut into months so that a key with much history isn't one task: within a month a running
    maximum, between months the maximum of each. An ask without a time or key, or before any vintage, has nulls.
    """
    known = vintages.where(F.col(available).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    ask, kept = F.struct(*asks.columns), F.struct(*state)
    none = lambda df, c: F.lit(None).cast(df.select(c).schema[0].dataType)
    rows = known.select(*by, F.col(available).cast("timestamp").alias("_t"), F.lit(0).alias("_ask"), kept.alias("_state"), none(asks, ask).alias("_row"))
    rows = rows.unionByName(asks.select(*by, F.col(at).cast("timestamp").alias("_t"), F.lit(1).alias("_ask"), none(known, kept).alias("_state"), ask.alias("_row")))
    rows = rows.withColumn("_month", F.trunc("_t", "month"))
    within = Window.partitionBy(*by, "_month").orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    months = rows.groupBy(*by, "_month").agg(F.max("_state").alias("_best"))
    before = Window.partitionBy(*by).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_month").alias("_m"), F.max("_best").over(before).alias("_before"))
    now = rows.withColumn("_now", F.max("_state").over(within)).where("_ask = 1")
    met = now.join(months, [F.col(c) == F.col(f"_{c}") for c in by] + [F.col("_month") == F.col("_m")], "left")
    best = F.greatest("_now", "_before")
    return met.select("_row.*", *(best[c].alias(c if c not in asks.columns else f"known_{c}") for c in state))


def revision(snapshots: DataFrame, by: Sequence[str], as_of: str, value: str, since: Column, tie: str) -> DataFrame:
    """The drift of each ``by`` from its first snapshot on or after ``since`` to its last, in percent of the first's size; those
    with fewer than two snapshots, or a first value of zero, have none. Snapshots of a day come in the order of ``tie``."""
    s = snapshots.where(F.col(value).isNotNull() & F.col(as_of).isNotNull() & (F.col(as_of) >= since))
    order = F.struct(as_of, tie)
    s = s.groupBy(*by).agg(F.min_by(value, order).alias("value0"), F.min(as_of).alias("at0"), F.max_by(value, order).alias("value1"), F.max(as_of).alias("at1"), F.count(F.lit(1)).alias("n"))
    return s.where("n > 1 and value0 <> 0").withColumn("drift_pct", F.round(100 * (F.col("value1") - F.col("value0")) / F.abs("value0"), 2))


def replay(used: DataFrame, decision: str, available: str, by: Sequence[str]) -> DataFrame:
    """For each ``by`` how many features decisions have used, how many of them weren't public by then, how many have no date of
    availability, and whether the history stands."""
    leak = F.col(available) > F.col(decision)
    return used.groupBy(*by).agg(F.count(F.lit(1)).alias("used"), F.count_if(leak).alias("leaks"), F.count_if(F.col(available).isNull()).alias("undated"), (F.count_if(leak) == 0).alias("replay_ok"))


def mature(snapshots: DataFrame, prices: DataFrame, factors: Sequence[str], days: int, least: int = 5) -> DataFrame:
    """``origin, as_of, n, factor, ic``: each snapshot (``as_of, name, px`` and factors) is scored once, at the first build of
    ``prices`` (``as_of, name, px``) at least ``days`` later: the rank correlation of each factor with the return since, over names that
    have a price then and all factors the snapshot has. Snapshots with fewer than ``least`` such names have no row; a factor
    without spread has 0."""
    origins = snapshots.select(F.col("as_of").alias("origin")).where("origin is not null").distinct()
    builds = prices.select("as_of").where("as_of is not null").distinct()
    ahead = Window.orderBy("t", "is_origin").rowsBetween(1, Window.unboundedFollowing)  # one row a date
    dates = origins.select(F.date_add("origin", days).alias("t"), F.lit(-1).alias("is_origin"), "origin", F.lit(None).cast("date").alias("as_of"))
    dates = dates.unionByName(builds.select(F.col("as_of").alias("t"), F.lit(0).alias("is_origin"), F.lit(None).cast("date").alias("origin"), "as_of"))
    due = dates.withColumn("due", F.first("as_of", ignorenulls=True).over(ahead)).where("is_origin = -1 and due is not null").select("origin", "due")
    now = prices.select(F.col("as_of").alias("due"), "name", F.col("px").alias("px1"))
    s = snapshots.withColumnRenamed("as_of", "origin").join(F.broadcast(due), "origin")  # one row a date
    s = s.withColumns({f"_has_{f}": F.count(f).over(Window.partitionBy("origin")) > 0 for f in factors})
    s = s.join(now, ["due", "name"]).where("px > 0 and px1 > 0").withColumn("fwd", F.col("px1") / F.col("px") - 1)
    for f in factors:
        s = s.where(F.col(f).isNotNull() | ~F.col(f"_has_{f}"))
    long = s.select("origin", F.col("due").alias("as_of"), "name", "fwd", F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x"), F.col(f"_has_{f}").alias("has")) for f in factors))).alias("v"))
    long = long.where("v.has").select("origin", "as_of", "name", "fwd", "v.factor", "v.x")
    ranked = long.withColumns({"rx": average_rank("x", "origin", "factor"), "ry": average_rank("fwd", "origin", "factor")})
    ic = F.round(F.coalesce(ratio(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")), F.lit(0.0)), 5)
    return ranked.groupBy("origin", "as_of", "factor").agg(F.count(F.lit(1)).alias("n"), ic.alias("ic")).where(F.col("n") >= least)

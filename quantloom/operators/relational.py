"""Joins by nearest, latest and known-by dates; union by priority; holdings from quarter to quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp, ratio


def nearest_within(left: DataFrame, right: DataFrame, key: str, at: str, other: str, tie: str, days: int, own: str | None = None) -> DataFrame:
    """Left rows with the right row of the same key nearest in time, within a tolerance; the earlier, then smaller tie, of
    equals. Both sides meet in buckets as wide as the tolerance, so a key with much history isn't joined whole. ``own`` is the
    left column that the right row's tie must differ from, where a table is joined with itself. Equal left rows meet the right
    side as one and stay as many."""
    once = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_times"))
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / (days + 1))
    l_ = once.withColumn("_at", F.explode(F.transform(F.array(*(F.lit(i) for i in (-1, 0, 1))), lambda i: bucket(at) + i)))
    r_ = right.withColumn("_at", bucket(other))
    pairs = l_.join(r_, [key, "_at"]).withColumn("days", F.abs(F.datediff(other, at))).where(F.col("days") <= days)
    if own is not None:
        pairs = pairs.where(F.col(own) != F.col(tie))
    first = Window.partitionBy(*left.columns).orderBy("days", other, tie)
    best = pairs.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return best.withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))).drop("_n", "_at", "_times")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, known: str, value: str) -> DataFrame:
    """Left rows with the latest right value known by their time: both sides in one ordered pass, right rows first."""
    merged = left.select(key, F.col(at).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(
        right.select(key, F.col(known).alias("_t"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    )
    seen = F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return merged.withColumn("_seen", seen).where("_side = 1").select("_l.*", F.col("_seen").alias(value))


def known_by(features: DataFrame, decision: str, available: str) -> DataFrame:
    """Features available by the decision; those without a date are dropped."""
    return features.where(F.col(available).isNotNull() & (F.col(available) <= F.col(decision)))


def by_priority(sources: list[DataFrame], key: str, tag: str, value: str) -> DataFrame:
    """Union of sources, the first the most trusted: one row a key with all its tags and the first value known."""
    rows = [s.select(key, tag, value, F.lit(i).alias("_p")) for i, s in enumerate(sources)]
    all_ = rows[0]
    for r in rows[1:]:
        all_ = all_.unionByName(r)
    first = F.min_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct("_p", value)))
    return all_.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(tag)), ",").alias("tags"), first.alias(value), F.count(F.lit(1)).alias("n"))


def holdings(trades: DataFrame) -> DataFrame:
    """Shares and holders of an asset by quarter, the change from the quarter before, and the verdict at two percent."""
    q = trades.groupBy("ticker", "quarter").agg(F.sum("shares").alias("shares"), F.countDistinct("holder").alias("holders"))
    w = Window.partitionBy("ticker").orderBy("quarter")
    q = q.withColumns({"d_shares": 100 * ratio(F.col("shares") - F.lag("shares").over(w), F.lag("shares").over(w)), "d_holders": (F.col("holders") - F.lag("holders").over(w)).cast("double")})
    return q.withColumn("verdict", F.when(F.col("d_shares") >= 2, "accumulation").when(F.col("d_shares") <= -2, "distribution").when(F.col("d_shares").isNotNull(), "steady"))


def concentration(trades: DataFrame) -> DataFrame:
    """Herfindahl index of holders, the number of equal holders it stands for, and the largest share."""
    h = trades.groupBy("ticker", "holder").agg(F.sum("shares").alias("s")).withColumn("w", F.col("s") / F.sum("s").over(Window.partitionBy("ticker")))
    return h.groupBy("ticker").agg(F.sum(F.col("w") * F.col("w")).alias("hhi"), (1 / F.sum(F.col("w") * F.col("w"))).alias("effective"), F.max("w").alias("top"))


def turnover(now: DataFrame, before: DataFrame, key: str, weight: str) -> DataFrame:
    """Sum of absolute changes of weight, missing ones as zero."""
    both = now.select(key, F.col(weight).alias("a")).join(before.select(key, F.col(weight).alias("b")), key, "full")
    return both.agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("turnover"), F.count(key).alias("n"))


def turnover_path(weights: DataFrame, period: str, key: str, weight: str) -> DataFrame:
    """For each period but the first, the sum of absolute changes of weight since the period before and the number of keys in either. Each
    weight counts for its own period and, negated, for the next, so that both meet in one aggregate."""
    periods = weights.select(period).where(F.col(period).isNotNull()).distinct()
    order = Window.orderBy(period)  # one row a period
    periods = periods.select(period, F.lead(period).over(order).alias("_next"), (F.row_number().over(order) > 1).alias("_own"))
    each = F.explode(F.array(F.struct(F.when(F.col("_own"), F.col(period)).alias("p"), F.col(weight).alias("w")), F.struct(F.col("_next").alias("p"), (-F.col(weight)).alias("w")))).alias("e")
    moved = weights.join(periods, period).select(F.col(key).alias("_key"), each).where("e.p is not null").groupBy(F.col("e.p").alias(period), "_key").agg(F.sum("e.w").alias("d"))
    return moved.groupBy(period).agg(F.sum(F.abs("d")).alias("turnover"), F.count(F.lit(1)).alias("n"))


def label_runs(labels: DataFrame, key: str, at: str, label: str) -> DataFrame:
    """The run of equal labels that each key is in last: label, first date, length, and how many runs there were."""
    w = Window.partitionBy(key).orderBy(at)
    runs = labels.withColumn("_new", F.coalesce((F.col(label) != F.lag(label).over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(w))
    each = runs.groupBy(key, "run").agg(F.first(label).alias(label), F.min(at).alias("since"), F.max(at).alias("until"), F.count(F.lit(1)).alias("length"))
    return each.withColumn("runs", F.max("run").over(Window.partitionBy(key))).where("run = runs").drop("run")


def maturity(forecasts: DataFrame, outcomes: DataFrame, done: DataFrame, days: int) -> DataFrame:
    """Forecasts old enough, not yet scored, with their outcome: each once."""
    due = forecasts.join(outcomes, "id").where(F.datediff("seen", "issued") >= days)
    return due.join(done, "id", "left_anti")


def insider(events: DataFrame, key: str = "user_id", days: int = 120) -> DataFrame:
    """Buys against sells of the last days before the newest event: sums, actors, and the score."""
    newest = events.agg(F.max(F.to_date("ts")).alias("_now"))
    t = events.join(F.broadcast(newest)).where(F.datediff("_now", F.to_date("ts")) <= days)  # one row
    buy, sell = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)), F.sum(F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0))
    return t.groupBy(key).agg(buy.alias("bought"), sell.alias("sold"), F.count(F.lit(1)).alias("n"), clamp(ratio(buy - sell, buy + sell), -1.0, 1.0).alias("score"))

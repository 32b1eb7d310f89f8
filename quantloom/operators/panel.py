"""Inference on panels: lasso, errors that allow for dependence across assets and time, tests against data snooping, purged folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .regression import fit, long_run


def lasso(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], alpha: float = 0.08, rounds: int = 300, least: int = 6) -> DataFrame:
    """``by, n, b_<x>``: coefficients of standardised ``xs`` for standardised ``y`` under a penalty of ``alpha`` on their sizes.

    One aggregate has the means and spreads, a second the products of the standardised columns; coordinate descent then folds over
    these alone, whatever the number of rows. A missing value counts as the column's mean, a column without spread has coefficient
    0, and groups of fewer than ``least`` rows have zeros.
    """
    k, columns = len(xs), [*xs, y]
    spread = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    z = df.select(*by, *columns).join(spread, list(by))
    for c in columns:
        z = z.withColumn(f"_z_{c}", F.coalesce(ratio(F.col(c) - F.col(f"_m_{c}"), F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)), F.lit(0.0)))
    moment = lambda a, b: F.avg(F.col(f"_z_{a}") * F.col(f"_z_{b}"))
    g = z.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.array(*(moment(a, b) for b in xs)) for a in xs)).alias("_g"), F.array(*(moment(a, y) for a in xs)).alias("_c"))

    def step(beta: Column, t: Column) -> Column:
        j = t % k + 1
        row, own = F.element_at("_g", j), F.element_at(F.element_at("_g", j), j)
        fitted = F.aggregate(F.zip_with(row, beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        pull = F.element_at("_c", j) - fitted + own * F.element_at(beta, j)
        soft = F.when(own > 0, F.signum(pull) * F.greatest(F.abs(pull) - alpha, F.lit(0.0)) / own).otherwise(0.0)
        return F.transform(beta, lambda b, i: F.when(i == j - 1, soft).otherwise(b))

    beta = F.aggregate(F.sequence(F.lit(0), F.lit(rounds * k - 1)), F.array_repeat(F.lit(0.0), k), step)
    found = g.withColumn("_b", F.when(F.col("n") >= least, beta).otherwise(F.array_repeat(F.lit(0.0), k)))
    return found.select(*by, "n", *(F.element_at("_b", i + 1).alias(f"b_{x}") for i, x in enumerate(xs)))


def driscoll_kraay(df: DataFrame, y: str, xs: Sequence[str], time: str, lags: int) -> DataFrame:
    """``term, b, t``, a row for the constant and each regressor of a pooled fit: its t allows for any dependence within a date
    and, with Bartlett weights, over ``lags`` dates. Each row's pull on a coefficient is summed over a date before dates are put in
    order, so what is ordered has one row a date. Rows with a missing value don't count; a singular fit has nulls."""
    whole = df.dropna(subset=[y, *xs, time]).withColumn("_one", F.lit(1))
    coef = fit(whole, ["_one"], y, xs)
    t = whole.join(F.broadcast(coef), "_one")  # one row
    e = F.col(y) - F.col("const") - sum(F.col(f"b_{x}") * F.col(x) for x in xs)
    pull = {x: sum(F.col(f"inv_{x}_{z}") * (F.col(z) - F.col(f"mean_{z}")) for z in xs) for x in xs}
    pull["const"] = 1 - sum(F.col(f"mean_{x}") * pull[x] for x in xs)
    names = ["const", *xs]
    dates = t.groupBy(time).agg(*(F.sum(e * pull[c]).alias(f"u_{c}") for c in names))
    by_date = Window.orderBy(time)
    dates = dates.withColumns({f"u_{c}_{k}": F.lag(f"u_{c}", k).over(by_date) for c in names for k in range(1, lags + 1)})
    spread = dates.agg(*(F.sqrt(F.greatest(long_run(f"u_{c}", lags), F.lit(0.0))).alias(f"se_{c}") for c in names)).crossJoin(coef)  # one row each
    value = lambda c: F.col("const" if c == "const" else f"b_{c}")
    rows = F.array(*(F.struct(F.lit(c).alias("term"), value(c).alias("b"), ratio(value(c), F.col(f"se_{c}") / F.col("n")).alias("t")) for c in names))
    return spread.select(F.explode(rows).alias("r")).select("r.*")


def _uniform(part: int, *of: Column) -> Column:
    """A number in [0, 1) that follows from the values alone: eight hex digits of their digest."""
    digest = F.md5(F.concat_ws(":", *(c.cast("string") for c in of)).cast("binary"))
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("double") / float(1 << 32)


def stationary_draws(df: DataFrame, draws: int, block: float, seed: int) -> DataFrame:
    """``draw, pos, idx``: resamples of the places 0 to n-1 in blocks of mean length ``block`` that wrap around. ``df`` has one row, ``n``."""
    each = df.select("n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).where("n > 0")
    each = each.select("n", "draw", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("pos"))
    key = (F.lit(seed), F.col("draw"), F.col("pos"))
    start = F.when((F.col("pos") == 0) | (_uniform(0, *key) < 1 / block), F.struct(F.floor(_uniform(1, *key) * F.col("n")).alias("at"), F.col("pos").alias("from")))
    run = each.withColumn("_s", F.last(start, ignorenulls=True).over(Window.partitionBy("draw").orderBy("pos")))
    return run.select("draw", "pos", F.pmod(F.col("_s.at") + F.col("pos") - F.col("_s.from"), F.col("n")).alias("idx"))


def _placed(df: DataFrame, time: str) -> DataFrame:
    """Adds the place of the row's date from 0; one row a date is put in order."""
    dates = df.select(time).where(F.col(time).isNotNull()).distinct()
    return df.join(dates.withColumn("idx", F.row_number().over(Window.orderBy(time)) - 1), time)


def reality_check(excess: DataFrame, strategy: str, time: str, value: str, draws: int = 1000, block: float = 5, seed: int = 12345, least: int = 10) -> DataFrame:
    """``k, t, v, p``: the largest root-t mean over strategies of their returns over a benchmark, and how often resampled and
    recentred returns reach it. All strategies share a draw's dates, so that their dependence stays. A missing return counts as zero;
    under ``least`` dates there is no row."""
    own = excess.select(F.col(strategy).alias("strategy"), F.col(time).alias("at"), F.coalesce(value, F.lit(0.0)).alias("x"))  # no other names meet those below
    d = _placed(own.groupBy("strategy", "at").agg(F.sum("x").alias("x")), "at")
    size = d.agg(F.countDistinct("at").alias("n")).where(F.col("n") >= least)
    mean = d.crossJoin(F.broadcast(size)).groupBy("strategy").agg((F.sum("x") / F.max("n")).alias("mean"), F.max("n").alias("n"))  # one row
    drawn = stationary_draws(size, draws, block, seed).groupBy("draw", "idx").agg(F.count(F.lit(1)).alias("times"))
    again = drawn.join(d, "idx").groupBy("draw", "strategy").agg(F.sum(F.col("times") * F.col("x")).alias("s"))
    again = again.join(mean, "strategy").groupBy("draw").agg(F.max(F.sqrt("n") * (F.col("s") / F.col("n") - F.col("mean"))).alias("best"))
    seen = mean.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("t"), F.max(F.sqrt("n") * F.col("mean")).alias("v"))
    reached = again.crossJoin(F.broadcast(seen)).groupBy("k", "t", "v").agg(F.count_if(F.col("best") >= F.col("v")).alias("ge"))
    return reached.select("k", "t", "v", ((F.col("ge") + 1) / (draws + 1)).alias("p"))


def cscv(returns: DataFrame, config: str, time: str, value: str, blocks: int = 10) -> DataFrame:
    """``split, best, rank, share, overfit``: for each way to part the blocks of dates in two halves, the configuration of best Sharpe
    ratio in one half (the least name of equals), its rank in the other from the worst, and whether it is in the lower half. Dates behind
    the last whole block don't count; a ratio without spread is 0. Returns are summed up by block first. The mean of ``overfit`` is the
    probability of overfitting. Fewer dates than blocks, or one configuration, give no rows."""
    d = _placed(returns.where(F.col(value).isNotNull()).select(F.col(config).alias("config"), F.col(time).alias("at"), F.col(value).alias("x")), "at")
    size = d.agg(F.countDistinct("at").alias("n"), F.countDistinct("config").alias("configs")).where(f"n >= {blocks} and configs > 1")
    d = d.crossJoin(F.broadcast(size)).withColumn("block", F.expr(f"cast(idx div (n div {blocks}) as int)")).where(F.col("block") < blocks)  # one row
    sums = d.groupBy("config", "block").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.max("configs").alias("configs"))
    split = F.explode(F.filter(F.sequence(F.lit(1), F.lit((1 << blocks) - 1), F.lit(2)), lambda m: F.bit_count(m) == blocks // 2)).alias("split")  # with the first block: else each parting comes twice
    sums = sums.select("*", split).withColumn("inside", F.getbit("split", F.col("block")) == 1)
    part = lambda c, yes: F.sum(F.when(F.col("inside") == yes, F.col(c)).otherwise(0))

    def sharpe(yes: bool) -> Column:
        n, s, q = (part(c, yes) for c in "nsq")
        var = (q - s * s / n) / (n - 1)
        return F.when((n > 1) & (var > 1e-18), s / n / F.sqrt(var)).otherwise(0.0)

    each = sums.groupBy("split", "config").agg(sharpe(True).alias("inner"), sharpe(False).alias("outer"), F.max("configs").alias("configs"))
    best = each.groupBy("split").agg(F.min_by(F.struct("config", "outer"), F.struct(-F.col("inner"), F.col("config"))).alias("b"))
    ranked = each.join(best, "split").groupBy("split", F.col("b.config").alias("best")).agg((1 + F.count_if(F.col("outer") < F.col("b.outer"))).alias("rank"), F.max("configs").alias("configs"))
    share = F.col("rank") / (F.col("configs") + 1)
    return ranked.select("split", "best", "rank", share.alias("share"), (share <= 0.5).alias("overfit"))


def purged_folds(spans: DataFrame, begin: str, end: str, tie: Sequence[str], folds: int = 5, embargo: int = 0) -> DataFrame:
    """Each row once for each fold, with ``fold`` and ``role``: test rows are a run of rows in the order of ``begin``; train rows are
    those whose span from ``begin`` to ``end`` doesn't meet the test rows' spans, ``embargo`` days longer on both sides. Rows that meet
    them and aren't tests are in no role and left out. Rows without a span are left out; fewer rows than folds give none. Places are
    counted by date, so that no task orders all rows."""
    s = spans.where(F.col(begin).isNotNull() & F.col(end).isNotNull())
    dates = s.groupBy(begin).agg(F.count(F.lit(1)).alias("_m"))
    dates = dates.select(begin, (F.sum("_m").over(Window.orderBy(begin)) - F.col("_m")).alias("_before"), F.sum("_m").over(Window.partitionBy()).alias("_n"))  # one row a date
    place = F.col("_before") + F.row_number().over(Window.partitionBy(begin).orderBy(*tie)) - 1
    s = s.join(dates, begin).where(F.col("_n") >= folds).withColumn("_own", F.least(F.floor(place / F.floor(F.col("_n") / folds)), F.lit(folds - 1)).cast("int"))
    tests = s.groupBy("_own").agg(F.date_sub(F.min(begin), embargo).alias("_from"), F.date_add(F.max(end), embargo).alias("_to")).withColumnRenamed("_own", "fold")
    all_ = s.crossJoin(F.broadcast(tests))  # a row a fold
    meets = (F.col(begin) <= F.col("_to")) & (F.col(end) >= F.col("_from"))
    role = F.when(F.col("_own") == F.col("fold"), "test").when(~meets, "train")
    return all_.withColumn("role", role).where("role is not null").drop("_own", "_before", "_n", "_from", "_to")

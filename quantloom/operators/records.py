"""Record-level operators: incremental fetches, identities, symbols, names, business days, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fetch_plan(cached: DataFrame, today: Column, least: int = 30, stale: int = 45) -> DataFrame:
    """What to fetch for each asset, from its last date and number of rows: full, delta or none; weekdays in between count."""
    t = cached.groupBy("ticker").agg(F.max("wk").alias("last"), F.count("wk").alias("n")).withColumn("gap", business_days("last", today))
    return t.withColumn("plan", F.when((F.col("n") < least) | (F.datediff(today, "last") > stale), "full").when(F.col("gap") > 0, "delta").otherwise("none"))


def business_days(a: str, b: Column) -> Column:
    """Weekdays after a date up to another."""
    days = F.when(b > F.col(a), F.sequence(F.date_add(a, 1), b)).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(days, lambda d: F.weekday(d) < 5))


def merge_bars(cached: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Cached rows, and fresh ones of keys not cached."""
    return cached.unionByName(fresh.join(cached.select(*keys), keys, "left_anti"))


def canonical_id(*parts: str) -> Column:
    """The first twelve hex digits of the SHA-1 of normalised parts."""
    return F.substring(F.sha1(F.concat_ws("|", *(normal_name(p) for p in parts)).cast("binary")), 1, 12)


def normal_name(c: str) -> Column:
    """Upper case, letters and digits alone, single letters and company endings dropped."""
    words = F.split(F.trim(F.regexp_replace(F.upper(F.coalesce(F.col(c), F.lit(""))), "[^A-Z0-9]+", " ")), " ")
    stop = F.array(*(F.lit(w) for w in ("INC", "CORP", "CO", "LTD", "PLC", "THE")))
    return F.array_join(F.filter(words, lambda w: (F.char_length(w) > 1) & ~F.array_contains(stop, w)), " ")


def option_symbol(root: Column, day: Column, kind: Column, strike: Column) -> Column:
    return F.concat(root, F.date_format(day, "yyMMdd"), kind, F.lpad(F.round(strike * 1000).cast("bigint").cast("string"), 8, "0"))


def parse_option_symbol(c: str) -> list[Column]:
    """Root, expiry, kind and strike of a symbol."""
    part = lambda i: F.regexp_extract(c, r"^([A-Z]+)(\d{6})([CP])(\d{8})$", i)
    return [part(1).alias("root"), F.to_date(part(2), "yyMMdd").alias("expiry"), part(3).alias("kind"), (part(4).cast("double") / 1000).alias("strike")]


def unpivoted(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def field_coverage(df: DataFrame) -> DataFrame:
    """For each column, how many rows have it, and how many different values."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in df.columns))).alias("x"))
    values = cells.groupBy("x.field", "x.value").agg(F.count("x.value").alias("n"))  # combined before it is shuffled, one row a value and task
    return values.groupBy("field").agg(F.sum("n").alias("present"), F.count("value").alias("different"))

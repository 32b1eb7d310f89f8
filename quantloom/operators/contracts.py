"""Checks of what a table holds against what was promised: fields, keys, sets, bounds, finite numbers, provenance.

Every check is an aggregate over the rows; a result has one row a field, key, path or check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_audit(records: DataFrame, json: str, declared: dict[str, bool], share: float = 0.5) -> DataFrame:
    """Fields of JSON records against a contract (field: whether required): how many records have each, and the verdict:
    ``never emitted``, ``missing`` (required, but not everywhere), ``undeclared`` (in at least that share of the records), or
    ``ok``. Text that isn't a JSON object is a record without fields; rarer undeclared fields have no row. A field that a record
    repeats counts once. Without records no field is held against the contract."""
    total = records.agg(F.count(F.lit(1)).alias("records"))  # one row
    seen = records.select(F.explode(F.array_distinct(F.json_object_keys(json))).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("seen"))
    spark = records.sparkSession
    promised = spark.createDataFrame(sorted(declared.items()), "field string, required boolean")
    t = promised.withColumn("declared", F.lit(True)).join(seen, "field", "full").crossJoin(F.broadcast(total))
    t = t.withColumns({"declared": F.coalesce("declared", F.lit(False)), "required": F.coalesce("required", F.lit(False)), "seen": F.coalesce("seen", F.lit(0))})
    common = F.col("seen") >= F.greatest(F.lit(1), F.floor(share * F.col("records")))
    verdict = (
        F.when(~F.col("declared"), F.when(common, "undeclared")).when(F.col("records") == 0, "ok")
        .when(F.col("required") & (F.col("seen") < F.col("records")), "missing").when(F.col("seen") == 0, "never emitted").otherwise("ok")
    )
    return t.select("field", "declared", "required", "seen", "records", verdict.alias("verdict")).where("verdict is not null")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once, and missing ones (null or empty in any part), with their number of rows."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull() | (F.col(k).cast("string") == "")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).select(*keys, "rows", F.when(missing, "missing").otherwise("repeated").alias("fault")).where("rows > 1 or fault = 'missing'")


def first_seen(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key once, with the place of its first row; nulls are a key."""
    return df.groupBy(key).agg(F.min(F.struct(*order)).alias("_at")).select(key, *(F.col(f"_at.{c}").alias(c) for c in order))


def merge_tags(first: DataFrame, second: DataFrame, key: str, tags: str) -> DataFrame:
    """The union of two lists by key with the union of their tags, sorted; a key in one list only keeps its own."""
    both = first.select(key, tags).unionByName(second.select(key, tags))
    return both.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(tags))))).alias(tags))


def common_dates(df: DataFrame, name: str, at: str) -> DataFrame:
    """Dates on which every name has a row; none where there are no names."""
    own = df.where(F.col(name).isNotNull() & F.col(at).isNotNull())
    names = own.agg(F.count_distinct(name).alias("_all"))  # one row
    return own.groupBy(at).agg(F.count_distinct(name).alias("_n")).crossJoin(F.broadcast(names)).where("_n = _all").select(at)


def _leaves(kind: T.DataType, path: str):
    """Paths of the floating numbers below a type, each with the count of non-finite ones as a function of the value."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        yield path, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 1).otherwise(0)
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            for p, g in _leaves(f.dataType, f"{path}.{f.name}"):
                yield p, lambda x, g=g, n=f.name: g(x[n])
    elif isinstance(kind, T.ArrayType):
        for p, g in _leaves(kind.elementType, path + "[]"):
            yield p, lambda x, g=g: F.coalesce(F.aggregate(x, F.lit(0), lambda s, v: s + g(v)), F.lit(0))
    elif isinstance(kind, T.MapType):
        for p, g in _leaves(kind.valueType, path + "{}"):
            yield p, lambda x, g=g: F.coalesce(F.aggregate(F.map_values(x), F.lit(0), lambda s, v: s + g(v)), F.lit(0))


def non_finite(df: DataFrame) -> DataFrame:
    """``path, rows, numbers``: for each path of floating numbers, through structs, arrays and maps, the rows with NaN or
    infinite ones and the count of such numbers. Paths without any have a row of zeros."""
    found = [(p, g(F.col(f"`{f.name}`"))) for f in df.schema.fields for p, g in _leaves(f.dataType, f.name)]
    if not found:
        return df.sparkSession.createDataFrame([], "path string, rows long, numbers long")
    one = df.select(*(x.cast("long").alias(f"c{i}") for i, (_, x) in enumerate(found)))
    sums = one.agg(F.array(*(F.struct(F.lit(p).alias("path"), F.coalesce(F.count(F.when(F.col(f"c{i}") > 0, 1)), F.lit(0)).alias("rows"), F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias("numbers")) for i, (p, _) in enumerate(found))).alias("a"))
    return sums.select(F.explode("a").alias("x")).select("x.*")


def sanitized(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values that aren't finite or lie outside their bounds become null; ``nulled`` counts them by row."""
    def bad(c: str, low: float | None, high: float | None) -> Column:
        x = F.col(c)
        out = F.isnan(x) | (F.abs(x) == float("inf"))
        out = out if low is None else out | (x < low)
        return F.coalesce(out if high is None else out | (x > high), F.lit(False))

    faults = {c: bad(c, *b) for c, b in bounds.items()}
    return df.withColumns({"nulled": sum((f.cast("int") for f in faults.values()), F.lit(0)), **{c: F.when(~f, F.col(c)) for c, f in faults.items()}})


def crossed_bands(df: DataFrame, *columns: str) -> Column:
    """The first pair of neighbouring quantiles (given from low to high, nulls left out) that cross, as ``low>high``; else null."""
    known = F.filter(F.array(*(F.struct(F.col(c).cast("double").alias("v"), F.lit(c).alias("c")) for c in columns)), lambda x: x["v"].isNotNull())
    pairs = F.arrays_zip(F.slice(known, 1, F.greatest(F.size(known) - 1, F.lit(0))).alias("a"), F.slice(known, 2, len(columns)).alias("b"))
    wrong = F.filter(pairs, lambda p: p["a"]["v"] > p["b"]["v"])
    return F.get(F.transform(wrong, lambda p: F.concat(p["a"]["c"], F.lit(">"), p["b"]["c"])), F.lit(0))


def provenance(df: DataFrame, key: str, at: str, value: str, places: int = 4) -> DataFrame:
    """One digest of a table of series: each key's rounded values in order, then the keys' digests in 256 bins by their first
    digits, then the bins'. Order of rows and partitions make no difference; a null value is a dash."""
    text = F.coalesce(F.round(F.col(value) * 10.0**places).cast("long").cast("string"), F.lit("-"))
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(at).alias("a"), text.alias("t")))), lambda x: x["t"]), ",").alias("s"))
    one = one.select(F.sha2(F.concat(F.col(key).cast("string"), F.lit(":"), F.col("s")), 256).alias("d"))
    bins = one.groupBy(F.substring("d", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"), F.count("d").alias("n"))
    return bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("series"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def universe_checks(names: DataFrame, before: DataFrame, key: str, sector: str, sectors: list[str], least: int = 30, floor: int = 50, drop: float = 0.3) -> DataFrame:
    """``check, value, ok``: enough names, no missing and no repeated key, enough names of known sectors (where there are at
    least 80 names), and no fall beyond the share against the names before (where there were any)."""
    now = names.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(sector).isin(*sectors), 1)).alias("known"))
    held = F.col(key).isNotNull() & (F.col(key) != "")
    one = now.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(~F.coalesce(held, F.lit(False)), F.col("n"))), F.lit(0)).alias("missing"), F.count(F.when(held & (F.col("n") > 1), 1)).alias("repeated"), F.coalesce(F.sum("known"), F.lit(0)).alias("known"))
    t = one.crossJoin(F.broadcast(before.agg(F.count(F.lit(1)).alias("then"))))  # two single rows
    rows = [("too few names", F.col("all"), F.col("all") >= least), ("missing keys", F.col("missing"), F.col("missing") == 0), ("repeated keys", F.col("repeated"), F.col("repeated") == 0), ("known sectors", F.col("known"), (F.col("all") < 80) | (F.col("known") >= floor)), ("names lost", F.greatest(F.col("then") - F.col("all"), F.lit(0)), (F.col("then") == 0) | (F.col("all") >= (1 - drop) * F.col("then")))]
    return t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), v.cast("long").alias("value"), ok.alias("ok")) for c, v, ok in rows))).alias("x")).select("x.*")


def sparse_drivers(betas: DataFrame, name: str, driver: str, beta: str, least: float = 0.05) -> DataFrame:
    """By name, a map of the drivers whose sensitivity counts, and the strongest (ties by name of the driver). Names without any
    have an empty map. A repeated driver counts with its strongest sensitivity."""
    t = betas.withColumn("_b", F.nanvl(F.col(beta), F.lit(None).cast("double")))
    own = Window.partitionBy(name, driver).orderBy(F.abs("_b").desc_nulls_last(), F.col("_b").desc_nulls_last())
    t = t.withColumn("_k", F.row_number().over(own)).where("_k = 1")
    kept = F.when((F.abs("_b") >= least) & F.col(driver).isNotNull(), F.struct(F.negative(F.abs("_b")).alias("s"), F.col(driver).alias("d"), F.col("_b").alias("b")))
    g = t.groupBy(name).agg(F.sort_array(F.collect_list(kept)).alias("k"))
    return g.select(name, F.map_from_entries(F.transform("k", lambda x: F.struct(x["d"], x["b"]))).alias("drivers"), F.get("k", F.lit(0))["d"].alias("dominant"), F.get("k", F.lit(0))["b"].alias("dominant_beta"))


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    """How many rows have each tag; a tag that a row repeats counts once, nulls don't."""
    return df.select(F.explode(F.array_distinct(F.array_compact(tags))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("rows"))

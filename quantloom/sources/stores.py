"""A store of keyed rows that can be written again: a table in partitions to which a row is added once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import shared


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The store, or none where nothing was written yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def record(df: DataFrame, path: str, keys: Sequence[str], partition: str, required: Sequence[str] = ()) -> int:
    """Add the rows of ``df`` whose ``keys`` the store doesn't have yet, and return how many: the first write of a key stands.

    Only partitions that get a row are written: what they had and the new rows are put together in the shared folder, then replace
    them. Writing the same rows again, or again after a failure half-way, leaves the store as if written once. Rows
    with a null in ``keys``, ``partition`` or ``required`` are not recorded; of rows with equal keys the least stays.
    ``partition`` must follow from the keys. One writer at a time.
    """
    spark, others = df.sparkSession, [c for c in df.columns if c not in keys]
    rows = df.dropna(subset=[*dict.fromkeys([*keys, partition, *required])]).groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, "_r.*") if others else df.dropna(subset=[*keys]).distinct()
    incoming = _staged(rows.select(*df.columns), "store-incoming")
    there = read(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
    if there is None:
        fresh, merged = incoming.count(), incoming
    else:
        new = _staged(incoming.join(there.select(*keys), list(keys), "left_anti").select(*df.columns), "store-new")
        fresh = new.count()
        touched = new.select(partition).distinct()
        merged = _staged(there.join(touched, partition, "left_semi").select(*df.columns).unionByName(new), "store-merged")
    if fresh:
        merged.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return fresh


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Text and column files as sources and sinks, in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession, name: str) -> str:
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame, path: str) -> str:
    """One object a line; values that aren't finite become null."""
    clean = [F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    df.select(*clean).write.json(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects line by line; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_delimited(spark: SparkSession, path: str, header: str, sep: str, schema: str) -> DataFrame:
    """Rows of text files that may begin with prose and end with a footer: of lines with as many fields as the schema, those
    that aren't the header and whose first field parses. Numbers like ``.`` and ``null`` are missing."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    parts = spark.read.text(path).where(F.col("value") != header).select(F.split("value", f"\\Q{sep}\\E").alias("x")).where(F.size("x") == len(fields))
    out = parts.select(*(F.trim(F.get("x", F.lit(i))).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields)))
    return out.where(F.col(fields[0][0]).isNotNull())


def write_partitioned(df: DataFrame, path: str, *by: str) -> str:
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return path

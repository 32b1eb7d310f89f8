"""Helpers that several text operators share: the cluster's shared folder, cut lineage, whole-text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that the text contracts treat as white space.
SPACE = "\\x20\\x09-\\x0D"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder (URI) in the shared folder that the session names; one of our own only where none is set in local mode."""
    base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
            base = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives a lost executor."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A group with over this share of all rows is hot; so there are at most this many hot groups. Fewer rows than ``_FEW`` never are.
_HOT_SHARE, _FEW = 10_000, 1000


def hot_bound(members: DataFrame) -> int:
    """A group of over so many of these rows is hot."""
    return max(_FEW, members.count() // _HOT_SHARE)


def meet_groups(members: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Each member with its group's row (``groups``: one row for each key, ``size`` members in it; members of no group go).
    The groups that hold over a ten-thousandth of all members go to every task, so that no task meets a hot key alone; by
    their share they are ten thousand rows at most, whatever the data. ``members`` is read twice."""
    bound = hot_bound(members)
    hot, others = groups.where(F.col(size) > bound), groups.where(F.col(size) <= bound)
    return members.join(F.broadcast(hot), key).unionByName(members.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key))


#: Bounds of the bits of a filter, as powers of two: 128 KB to 8 MB.
_LEAST_BITS, _MOST_BITS = 20, 26


def key_filter(keys: DataFrame):
    """A test of bigint columns: true for all of ``keys`` (one bigint column, settled), and for few others. It is a bitmap
    of eight bits for each key and 8 MB at most, so beyond some million keys more others pass; it never loses a key."""
    name, power = keys.columns[0], min(_MOST_BITS, max(_LEAST_BITS, (8 * keys.count()).bit_length()))
    words = 1 << power - 6
    word = lambda c: F.pmod(F.shiftright(c, 6), F.lit(words)).cast("int")
    bit = lambda c: c.bitwiseAND(F.lit(63)).cast("int")
    one = keys.select(word(F.col(name)).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(F.col(name))).alias("mask"))
    set_ = one.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    all_ = keys.sparkSession.range(0, words, 1, 1).select(F.col("id").cast("int").alias("word")).join(set_, "word", "left")
    bits = all_.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0)).alias("mask")))), lambda x: x["mask"]).alias("bits")).scalar()
    return lambda c: F.call_function("shiftrightunsigned", F.get(bits, word(c)), bit(c)).bitwiseAND(F.lit(1)) == 1


def texts_of(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)`` alone, the key as bigint and null texts as empty ones."""
    return table.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def rows(batches: Iterator[pa.RecordBatch], size: int = 256, most: int = 32 << 20) -> Iterator[list[tuple]]:
    """Slices of Arrow batches as lists of row tuples, of ``size`` rows and ``most`` bytes at most (one row may have more),
    so that few whole texts are Python objects at a time."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(size, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > most:
                n = -(-n // 2)
            part = batch.slice(at, n)
            at += n
            yield list(zip(*(c.to_pylist() for c in part.columns), strict=True))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or an absolute path, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)

"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits sums the hashes of a text's word shingles. Two fingerprints within two bits are linked. The
index has two segments of 32 bits: of a pair within two bits, either the upper halves differ in at most one bit or the
lower halves are the same. So the upper segment is probed with its Hamming ball of radius 1, the lower with the value
itself; table matches are verified on the complete distance. Of two halves that differ in one bit, one has that bit
unset, so a probe only needs to set bits and finds each such pair once.

A bucket with more than ``BUCKET`` table entries is not joined, as its pairs grow with the square of its size. The
fingerprints that meet in such buckets enumerate the ball of radius 1 around the complete fingerprint instead: two of
them share a member of their balls exactly when they are within two bits. Each shared member links its fingerprints to
the least one, verified again, which keeps every component and makes one row for each member of a ball.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet_groups, rows, settle, texts_of
from .components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Table entries of a bucket beyond which full balls take over.
BUCKET = 64
_STEP = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text as a signed 64-bit number; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _STEP):  # a bounded piece of a very long text at a time
        ones += np.unpackbits(hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for each row; null and empty texts have fingerprint 0."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([fingerprint(t) for _, t in part], pa.int64())], names=["doc_id", "fp"])

    return texts_of(docs).mapInArrow(make, "doc_id bigint, fp bigint")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints within two bits that hold all components together. ``fps``: distinct ``fp``."""
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 33)
    set_bits = [F.when(F.shiftrightunsigned("fp", 32 + i).bitwiseAND(F.lit(1)) == 0, upper + F.lit(1 << i)) for i in range(32)]
    table = settle(fps.select("fp", F.explode(F.array(upper, lower)).alias("key")), "simhash-table")
    probes = fps.select("fp", F.explode(F.array(upper, lower, *set_bits)).alias("key")).where("key is not null")

    crowded = settle(table.groupBy("key").count().where(F.col("count") > bucket).select("key"), "simhash-crowded")
    some = not crowded.isEmpty()
    entries = (table.join(crowded, "key", "left_anti") if some else table).withColumnRenamed("fp", "b")
    close = (
        probes.withColumnRenamed("fp", "a").join(entries, "key")
        .where((F.col("a") != F.col("b")) & (_distance(F.col("a"), F.col("b")) <= DISTANCE))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    if some:
        met = probes.join(crowded, "key", "left_semi").select("fp").distinct()
        ball = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
        shared = met.select("fp", F.explode(ball).alias("member")).groupBy("member").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))  # 65 at most
        star = shared.where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
        close = close.unionByName(star.where((F.col("a") != F.col("b")) & (_distance(F.col("a"), F.col("b")) <= DISTANCE)))
    return close.distinct()


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Components of near-duplicates: ``doc_id, fingerprint, component_id``, a row per row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest doc_id reachable over links of two or
    fewer differing bits. Null and empty texts have fingerprint zero, which is linked like any other. Repeated rows
    share a component. Null doc_ids are never a component_id unless all of a component are null. Other columns are
    ignored; an empty table gives no rows.
    """
    marked = settle(fingerprints(docs), "simhash")
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")), "simhash-nodes")
    labels = components(settle(links(nodes.select("fp"), bucket), "simhash-links"))  # node, label
    # the smallest document of each component, given to its fingerprints
    linked = nodes.join(labels, nodes["fp"] == labels["node"]).select("fp", "label", "first")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    named = linked.join(least, "label").select(F.col("fp").alias("_fp"), "least")
    whole = nodes.join(named, nodes["fp"] == named["_fp"], "left").select("fp", "times", F.coalesce("least", "first").alias("component_id"))
    return meet_groups(marked, settle(whole, "simhash-components"), "fp", "times").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component. Rows with a null doc_id stay."""
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")

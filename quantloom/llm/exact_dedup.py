"""Exact deduplication as a stateful stream with keyed state on disk.

Each document becomes a narrow key row: digest of the normalised text, its length in code points, the stable document
id and a content locator (file and row number). The key rows run as a stream through a keyed aggregation whose state
lives in RocksDB and never expires; it holds, for each digest, the best document so far, its locator and the number of
documents. Documents that hit a digest seen before are then compared with each other in full; a bitmap of the digests that
were hit keeps the texts of all others out of that comparison, so they are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, key_filter, meet_groups, settle, shared_folder, texts_of

#: Files of key rows that one batch of the stream takes at most.
FILES = 1000
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many small stores: no files of a fixed size ahead of their content, and changes alone in each checkpoint
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """The text without its white space."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _stream_state(keys_path: str, keys: DataFrame, files: int = FILES) -> DataFrame:
    """Run the key rows through the stateful aggregation; one row per digest: best document, its locator, count."""
    spark = keys.sparkSession
    out = shared_folder(spark, "dedup-state")
    better = F.struct("n_chars", F.bitwise_not("doc_id").alias("neg_id"), (-F.col("row")).alias("neg_row"), "doc_id", "row", "file")
    state = (
        spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files).parquet(keys_path)
        .groupBy("digest").agg(F.max(better).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )

    def emit(batch: DataFrame, epoch: int) -> None:  # a repeated epoch overwrites its own rows
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/part={epoch}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update").foreachBatch(emit).trigger(availableNow=True)
            .option("checkpointLocation", shared_folder(spark, "dedup-stream")).start()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    if query.lastProgress is None or not _written(spark, out):
        schema = state.withColumn("epoch", F.lit(0)).schema
        return spark.createDataFrame([], schema).select("digest", "best", "group_size")
    # an update of a digest in a later epoch replaces the earlier one
    last = F.max(F.struct("epoch", "best", "group_size")).alias("last")
    return spark.read.option("recursiveFileLookup", "true").parquet(out).groupBy("digest").agg(last).select("digest", "last.best", "last.group_size")


def _written(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def exact_groups(docs: DataFrame, digest=sha256_digest, files: int = FILES) -> DataFrame:
    """Groups of equal texts; one row per row of ``docs``.

    Texts are equal when identical without white space. Returns ``doc_id, keep_id, group_size, kept, text_sha256,
    file``. Of a group, the row with the most code points in its original text stays, then the one with the smallest
    doc_id, then (rows repeated whole) the first read; so exactly one row of a group is ``kept``. A null text is an
    empty one, and all empty texts form one group. A null doc_id loses every tie. Other columns are ignored. An empty
    table gives no rows. ``digest`` may be any function of the text: rows that share a digest and differ in bytes are
    grouped by their bytes.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = normalised(text)
    spark = docs.sparkSession
    path = shared_folder(spark, "dedup-keys")
    docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), digest(norm).alias("digest"), F.sha2(norm.cast("binary"), 256).alias("text_sha256"),
        F.char_length(text).cast("bigint").alias("n_chars"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"),
    ).write.parquet(path)
    keys = spark.read.parquet(path)
    state = settle(_stream_state(path, keys, files), "dedup-groups")

    joined = meet_groups(keys, state, "digest", "group_size")
    out = ["doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "file"]

    # full bytes of every hit: texts are the same byte by byte, or several stand under their digest
    hit = key_filter(settle(state.where("group_size > 1").select(F.xxhash64("digest").alias("hit")), "dedup-hits"))
    bodies = texts_of(docs).select(normalised(F.col("text")).alias("body")).withColumn("digest", digest(F.col("body")))
    bodies = bodies.where(hit(F.xxhash64("digest")))
    clashes = settle(bodies.distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-clashes")
    if clashes.isEmpty():
        return joined.select(*out)
    return joined.join(clashes, "digest", "left_anti").select(*out).unionByName(_by_bytes(docs, digest, clashes, keys))


def _by_bytes(docs: DataFrame, digest, clashes: DataFrame, keys: DataFrame) -> DataFrame:
    """Groups of the rows whose digest stands for several texts, by the texts themselves."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), normalised(text).alias("body"), F.char_length(text).cast("bigint").alias("n_chars"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row")
    )
    rows = settle(rows.withColumn("digest", digest(F.col("body"))).join(clashes, "digest", "left_semi"), "dedup-bodies")
    better = F.struct("n_chars", F.bitwise_not("doc_id").alias("neg_id"), (-F.col("row")).alias("neg_row"), "doc_id", "row")
    best = rows.groupBy("body").agg(F.max(better).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(best, "body").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"), "file"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Rows repeating both doc_id and text count as one document
    under that doc_id, and stay or go together; rows with a null doc_id can't be named and stay."""
    gone = exact_groups(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("stays")).where(~F.col("stays")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")

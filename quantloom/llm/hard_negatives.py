"""Hard negatives: for anchors and their positives, the rows of other labels that score highest within a window below the positive.

Every row is dealt to the region of the nearest of a bounded sample's rows, regions over ``SHARD`` rows are split, and each
shard becomes a cover tree. Anchors are packed into blocks, and first meet the sample, whose rows bound from below what a search must
find. Each block meets each group of shards in a task, which keeps the best of the shards met so far and takes all anchors through a
tree at once: its balls bound from above what a search can find there, and what they can't rule out is scored by a product of matrices.
The groups' answers are merged.

A row takes part if vec_id, label and the vector with all its components are given and finite. Of rows that share a vec_id the
one of least label, then least vector, counts. Vectors of different lengths are filled up with zeros. Components are
floor(256 x), at most a bigint; a score beyond a bigint is given as the nearest one. An anchor without a second row of its
label has no positives, a positive of negative score has an empty window; both give no rows, as an empty table does. Other columns
are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .cover_tree import CoverTree, Search, narrow

#: Rows of a tree, anchors of a block, the most rows of the sample, and the most groups of shards that a block meets.
SHARD, BLOCK, SAMPLE, GROUPS = 2048, 16384, 1024, 32
LABELS = 10
_FAR = 1 << 63


def _long(x: int) -> int:
    return max(-_FAR, min(_FAR - 1, int(x)))


def quantised(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, v``: the rows that take part, labels with their planted errors, components as integers."""
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    part = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~odd)
    part = part.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * 256)).alias("v"))
    return part.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(vectors: list[list[int]], size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _arrow_matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors without nulls as rows, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, long = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (long == size).all():
        return flat.astype(np.int64).reshape(len(long), size)
    out = np.zeros((len(long), size), np.int64)
    out[np.arange(size) < long[:, None]] = flat
    return out


class Regions:
    """The sample, of which the first ``regions`` rows are each the middle of a region."""

    def __init__(self, sample: list, size: int, regions: int):
        self.size, points = size, _matrix([r.v for r in sample], size)
        self.points = points[:regions].astype(np.float64)
        self.sample = CoverTree(points, np.array([r.vec_id for r in sample], np.int64), np.array([r.label for r in sample], np.int64))

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest region of each vector."""
        p = self.points
        return ((p * p).sum(axis=1) - 2 * (vectors.astype(np.float64) @ p.T)).argmin(axis=1)


def build_index(vectors: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> tuple[Regions, DataFrame, int]:
    """The regions, the trees (``shard, tree``) and how many there are."""
    n, size = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    regions = Regions(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect(), size, max(1, min(sample, n // shard)))
    dealt = vectors.mapInArrow(lambda b: _routed(b, regions), "vec_id bigint, label bigint, v array<bigint>, region int")
    places, shards = [(0, 1)] * len(regions.points), 0
    for r in dealt.groupBy("region").count().orderBy("region").collect():  # a row a region
        places[r.region] = (shards, -(-r["count"] // shard))
        shards += places[r.region][1]
    ranges = F.array(*[F.struct(F.lit(first).alias("first"), F.lit(pieces).alias("pieces")) for first, pieces in places])
    place = F.get(ranges, F.col("region")) if shards else F.lit(None).cast("struct<first:int,pieces:int>")
    dealt = dealt.select("vec_id", "label", "v", (place["first"] + F.pmod(F.xxhash64("vec_id"), place["pieces"])).cast("int").alias("shard"))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        tree = CoverTree(_arrow_matrix(table["v"], size), table["vec_id"].to_numpy(), table["label"].to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return regions, settle(dealt.groupBy("shard").applyInArrow(build, "shard int, tree binary"), "negatives-trees"), shards


def _routed(batches: Iterator[pa.RecordBatch], regions: Regions) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            region = regions.route(_arrow_matrix(part.column("v"), regions.size))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(region.astype(np.int32))], names=["vec_id", "label", "v", "region"])


_ANSWER = "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"


def window_of(positive: int) -> tuple[int, int]:
    """The scores from 30 % to 90 % of a positive's score."""
    return -(-30 * positive // 100), 90 * positive // 100


class Anchors:
    """A block of anchors: their windows (one without bounds where positives are looked for) and what the sample says of them."""

    def __init__(self, table: pa.Table, regions: Regions, k: int, positives: bool):
        self.k, self.positives = k, positives
        self.ids, self.labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        self.vectors = narrow(_arrow_matrix(table["v"], regions.size))
        wanted = [[]] * len(self.ids) if positives else table["wanted"].to_pylist()
        width = 1 if positives else max(map(len, wanted))
        self.wanted, self.scores = (np.zeros((len(self.ids), width), np.int64) for _ in range(2))
        # windows that an anchor doesn't have are empty
        self.least, self.most = (np.full((len(self.ids), width), -x if positives else x, object) for x in (math.inf, -math.inf))
        for at, found in enumerate(wanted):
            for place, w in enumerate(found):
                self.wanted[at, place], self.scores[at, place] = w["id"], w["score"]
                self.least[at, place], self.most[at, place] = window_of(w["score"])
        first = self.search()
        first.meet(regions.sample)
        self.least, self.most = first.floors(), first.most

    def search(self) -> Search:
        return Search(self.vectors, self.ids, self.labels, self.least, self.most, self.k, self.positives)

    def answers(self, search: Search) -> Iterator[pa.RecordBatch]:
        query, window, score, number = search.answers()
        score = np.array([_long(x) for x in score], np.int64) if score.dtype == object else score.astype(np.int64)
        none = np.full(len(query), self.positives)
        columns = [pa.array(self.ids[query]), pa.array(self.wanted[query, window], mask=none), pa.array(self.scores[query, window], mask=none), pa.array(number), pa.array(score)]
        whole = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ANSWER.split(", ")])
        for at in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(at, 1 << 16)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells one after another: a block of anchors, then the trees that it meets. Without anchors the trees are passed over."""
    cell = anchors = search = None
    for batch in batches:
        for row in range(batch.num_rows):
            here = batch.column("group")[row].as_py(), batch.column("block")[row].as_py()
            if here != cell:
                if search is not None:
                    yield from anchors.answers(search)
                cell, anchors, search = here, None, None
            if batch.column("place")[row].as_py() < 0:
                anchors = pickle.loads(batch.column("data")[row].as_py())
                search = anchors.search()
            elif search is not None:
                search.meet(pickle.loads(batch.column("data")[row].as_py()))
    if search is not None:
        yield from anchors.answers(search)


def _answers(asking: DataFrame, trees: DataFrame, regions: Regions, shards: int, blocks: int, k: int, positives: bool) -> DataFrame:
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([pickle.dumps(Anchors(table, regions, k, positives))], pa.binary())})

    groups = max(1, min(shards, GROUPS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = asking.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(pack, "block int, data binary")
    packed = packed.select("block", each(groups).alias("group"), F.lit(-1).alias("place"), "data")
    met = trees.select(each(blocks).alias("block"), F.pmod("shard", F.lit(groups)).alias("group"), F.col("shard").alias("place"), F.col("tree").alias("data"))
    cells = packed.unionByName(met).repartition(min(4096, 2 * groups * blocks), "group", "block").sortWithinPartitions("group", "block", "place")
    return cells.mapInArrow(_meet, _ANSWER)


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, shard: int = SHARD, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each row whose vec_id is divisible by
    ``every`` and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score
    is 30 % to 90 % of the positive's; higher scores first, then smaller vec_id. The module says what holds for nulls, ties
    and repeated rows."""
    vectors = settle(quantised(embeddings), "negatives-vectors")
    regions, trees, shards = build_index(vectors, shard, sample)
    anchors = vectors.where(F.col("vec_id") % every == 0)
    blocks = -(-anchors.count() // block) or 1
    nothing = F.array().cast("array<struct<id:bigint,score:bigint>>").alias("wanted")
    best = lambda *of: Window.partitionBy(*of).orderBy(F.desc("score"), "id")
    same = _answers(anchors.select("vec_id", "label", "v", nothing), trees, regions, shards, blocks, positives, True)
    same = same.withColumn("place", F.row_number().over(best("anchor_id"))).where(F.col("place") <= positives).where("score >= 0")
    wanted = settle(same.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("id", "score")).alias("wanted")), "negatives-positives")
    asking = anchors.join(wanted, "vec_id").select("vec_id", "label", "v", "wanted")
    other = _answers(asking, trees, regions, shards, blocks, negatives, False)
    other = other.withColumn("rank", F.row_number().over(best("anchor_id", "positive_id"))).where(F.col("rank") <= negatives)
    return other.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

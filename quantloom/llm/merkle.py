"""A Merkle manifest of a table by time-forward processing: a root over all rows, and for each row a proof and its check.

Each row is a leaf; the leaves of a source, by doc_id, make a tree, and the roots of these trees, by source, make another. Every
three consecutive nodes of a level become one, until one is left.

A node's label is the number of the last leaf below it, then its level. Nodes are dealt with in the order of their labels; a priority
queue by label delivers each digest to its parent, which comes after all of its children. A second sweep in reversed order delivers
to each node the siblings on its way to the root. Trees are cut into bands of ``BAND`` levels: within a band the
blocks of 3^BAND nodes are swept in different tasks, and what passes between bands is written to a table, sorted by Spark. So the
queue in a task's memory never holds more than a few messages a level, and the largest source is split like others.

A leaf's input has ``-`` for nulls. A null doc_id comes before all others and a null source before all sources; rows that share
a doc_id come in the order of their digests, and each row that repeats is a leaf of its own. Texts with a null doc_id aren't tampered
with. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

ARITY = 3
BAND = 7
#: One level of a path: how many siblings stand left and right, then their digests.
Path = list[tuple[list[bytes], list[bytes]]]


def node_digest(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def forward(digests: list[bytes], levels: int) -> dict[tuple[int, int], bytes]:
    """The digests of all nodes ``(level, number)`` up to ``levels`` above the given ones."""
    n, queue, at, done = len(digests), [], 0, {}

    def label(level: int, number: int) -> tuple[int, int]:
        return min((number + 1) * ARITY**level, n) - 1, level

    while at < n or queue:
        if at < n and (not queue or (at, 0) < queue[0][0]):
            level, number, digest = 0, at, digests[at]
            at += 1
        else:
            now, number, _ = queue[0]
            level, children = now[1], []
            while queue and queue[0][0] == now:  # by number, so from left to right
                children.append(heapq.heappop(queue)[2])
            number, digest = number // ARITY, node_digest(children)
        done[level, number] = digest
        if level < levels:
            heapq.heappush(queue, (label(level + 1, number // ARITY), number, digest))
    return done


def backward(nodes: dict[tuple[int, int], bytes], n: int, levels: int, above: Path) -> Iterator[tuple[int, Path]]:
    """For each of the ``n`` lowest nodes its number and its path: siblings level by level, then ``above``. From the last one on."""
    top = [number for level, number in nodes if level == levels]
    queue = [((-(min((number + 1) * ARITY**levels, n) - 1), -levels), number, above) for number in top]
    heapq.heapify(queue)
    while queue:
        (_, level), number, path = heapq.heappop(queue)
        if not level:
            yield number, path
            continue
        below = -level - 1
        run = [c for c in range(number * ARITY, (number + 1) * ARITY) if (below, c) in nodes]
        for child in run:
            siblings = [nodes[below, c] for c in run if c < child], [nodes[below, c] for c in run if c > child]
            heapq.heappush(queue, ((-(min((child + 1) * ARITY**below, n) - 1), -below), child, [siblings, *path]))


def fold(leaf: bytes, path: Path) -> bytes:
    """The root that a leaf and the siblings of a path give; a level without siblings hashes its one node."""
    for left, right in path:
        leaf = node_digest([*left, leaf, *right])
    return leaf


def pack(path: Path) -> bytes:
    return b"".join(bytes([len(left), len(right)]) + b"".join(left) + b"".join(right) for left, right in path)


def unpack(packed: bytes) -> Path:
    path, at = [], 0
    while at < len(packed):
        left, right = packed[at], packed[at + 1]
        digests = [packed[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(left + right)]
        path.append((digests[:left], digests[left:]))
        at += 2 + 32 * (left + right)
    return path


# --- Over Spark: nodes are rows (tree, at, n, digest): the tree's key, the node's number among the n of its level


def _ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the row's number in its ``tree`` by ``order``, and ``n``, its rows; no tree is sorted in one task."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema) + ", part int, place bigint"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for key in batch.column("tree").to_pylist():
                place = place + 1 if key == tree else 0
                tree = key
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "place"])

    numbered = settle(leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).mapInArrow(number, kind), "merkle-order")
    parts = Window.partitionBy("tree").orderBy("part")  # a row for each task that has rows of the tree
    counts = numbered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.select("tree", "part", (F.sum("m").over(parts) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("tree")).alias("n"))
    return numbered.join(counts, ["tree", "part"]).withColumn("at", F.col("place") + F.col("before")).drop("part", "place", "before")


def _up(nodes: DataFrame, band: int) -> DataFrame:
    """The nodes ``band`` levels higher, of trees of more than one node."""
    size = ARITY**band

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _blocks(batches):
            out = []
            for (tree, block), rows in blocks:
                n = rows[0]["n"]
                levels = min(band, height(n))
                out.append((tree, block, -(-n // size), forward([r["digest"] for r in rows], levels)[levels, 0]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["tree", "at", "n", "digest"])

    more = nodes.where("n > 1").select("tree", F.expr(f"at div {size}").alias("block"), "at", "n", "digest")
    return more.repartition("tree", "block").sortWithinPartitions("tree", "block", "at").mapInArrow(sweep, "tree binary, at bigint, n bigint, digest binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[tuple, list[dict]]]]:
    """The whole blocks that end in each batch, of rows that come block by block."""
    key, held = None, []
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            now = row["tree"], row["block"]
            if now != key and held:
                done.append((key, held))
                held = []
            key = now
            held.append(row)
        if done:
            yield done
    if held:
        yield [(key, held)]


def _bands(leaves: DataFrame, band: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes at the foot of each band, and the roots ``tree, digest``."""
    bands = [leaves]
    while (bands[-1].agg(F.max("n")).first()[0] or 0) > 1:
        bands.append(settle(_up(bands[-1], band), "merkle-band"))
    roots = bands[0].where("n = 1").select("tree", "digest")
    for nodes in bands[1:]:
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "digest"))
    return bands, roots


_PATHS = "tree binary, at bigint, path binary"


def _down(nodes: DataFrame, above: DataFrame, band: int, emit: Callable[[list[tuple[dict, Path, dict]]], pa.RecordBatch], schema: str) -> DataFrame:
    """``emit`` gets rows of ``nodes``, each with its path and the row of ``above`` (``tree, block, path`` and more) of its block."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _blocks(batches):
            for _, (head, *rows) in blocks:
                levels = min(band, height(rows[0]["n"]))
                found = backward(forward([r["digest"] for r in rows], levels), len(rows), levels, unpack(head["path"]))
                yield emit([(rows[number], path, head) for number, path in found])

    rows = nodes.withColumn("block", F.expr(f"at div {ARITY**band}")).unionByName(above.withColumn("at", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "at").mapInArrow(sweep, schema)


def _paths(found: list[tuple[dict, Path, dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"tree": r["tree"], "at": r["at"], "path": pack(path)} for r, path, _ in found], schema=pa.schema([("tree", pa.binary()), ("at", pa.int64()), ("path", pa.binary())]))


def _lowest(bands: list[DataFrame], roots: DataFrame, band: int) -> DataFrame:
    """``tree, block, path`` for each block of the lowest band; ``roots``: ``tree, path`` of every tree's root."""
    paths = None
    for level in range(len(bands) - 1, -1, -1):
        one = bands[level].where("n = 1").select("tree").join(roots, "tree").select("tree", F.lit(0).cast("bigint").alias("block"), "path")
        above = one if paths is None else one.unionByName(paths.select("tree", F.col("at").alias("block"), "path"))
        if not level:
            return above
        paths = settle(_down(bands[level], above, band, _paths, _PATHS), "merkle-paths")


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)).cast("binary"), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, band: int = BAND) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: digests as lowercase hex. ``tampered``: the text of which
    the folded root is taken (that of the row where null, and everywhere if not given). See the module for nulls and ties."""
    given = docs.select("doc_id", "source", "lang", "n_chars", "text", (F.lit(None).cast("string") if tampered is None else tampered).alias("other"))
    source = F.col("source").cast("string").cast("binary")
    tree = F.when(source.isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"\x01"), source)).alias("tree")
    other = F.when(F.col("other").isNotNull() & (F.col("other") != F.col("text")), leaf_digest(F.col("other"))).alias("other")
    leaves = settle(given.select(tree, F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest(F.col("text")).alias("digest"), other), "merkle-leaves")
    leaves = settle(_ranked(leaves, ["doc_id", "digest"]), "merkle-ranked")
    bands, subroots = _bands(leaves.select("tree", "at", "n", "digest"), band)
    subroots = settle(subroots, "merkle-subroots")
    over = settle(_ranked(subroots.select(F.lit(b"").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"]), "merkle-over")
    over_bands, over_root = _bands(over.select("tree", "at", "n", "digest"), band)
    found = over_root.first()  # one row
    root = found.digest if found else b""
    over_root = over_root.select("tree", F.lit(b"").alias("path"))
    over_paths = _down(over_bands[0], _lowest(over_bands, over_root, band), band, _paths, _PATHS).drop("tree")
    of_source = settle(over_paths.join(over.select("at", "source", "digest"), "at").select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot")), "merkle-sources")

    def emit(found: list[tuple[dict, Path, dict]]) -> pa.RecordBatch:
        out = []
        for r, path, head in found:
            proof = hashlib.sha256("".join(d.hex() for left, right in path for d in (*left, *right)).encode()).hexdigest()
            folded = fold(bytes(r["other"] or r["digest"]), path)
            out.append({"doc_id": r["doc_id"], "leaf": r["digest"].hex(), "subroot": head["subroot"].hex(), "root": root.hex(), "proof_sha256": proof, "folded_root": folded.hex(), "verified": folded == root})
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]))

    above = _lowest(bands, of_source.select("tree", "path"), band).join(of_source.select("tree", "subroot"), "tree")
    return _down(leaves, above, band, emit, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def without_line_feeds(docs: DataFrame) -> Column:
    """The text without line feeds where the check sum of the decimal doc_id is even, else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))

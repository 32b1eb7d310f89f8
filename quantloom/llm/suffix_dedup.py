"""Removal of byte strings that stand elsewhere before, by a hash-compared suffix sort.

A string of ``least`` bytes that starts at a byte of a text (a window) is repeated if the same string starts earlier:
in a text of smaller doc_id, or earlier in the same text. Each window has one anchor, the least hash among its k-grams
of ``least // 3`` bytes (the first of equal ones), which depends on the window's bytes alone. So equal windows have equal
anchors at equal distances, and windows that follow one another and share an anchor are one segment of a text: about one for
35 bytes. Segments with a k-gram of their own can't hold repeated windows and go no further than one aggregate.

* Equal segments (by k-gram and digest) are put together before anything is sorted, so that a copy costs no sorting: all but the
  first are removed.
* Where segments share a k-gram but differ, one of each is sorted. ``suffix_order`` sorts the suffixes behind the anchors,
  and the reversed ones before them; the longest agreement of neighbours bounds the windows that can be repeated. Those are sorted
  in turn, and of windows that agree in all their bytes the first stays. The sort verifies its hashes on the bytes.

K-grams with many different segments are dealt over tasks in pieces: each piece is sorted and gives up all but its first of
equal windows, and what is left of all pieces is sorted again, dealt by the windows themselves.

Null texts are empty and have nothing to remove. A null doc_id comes before all others. Rows that share a doc_id are one
document: equal ones count once, and what only they share may stay in them. Other columns are ignored, an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_filter, meet_groups, rows, settle
from .suffix_order import Prefixes, suffix_order

LEAST = 100
#: Bytes of a text that are cut into segments at a time, and of segments that are sorted at a time (a group is never parted).
_BLOCK, _SORTED = 1 << 20, 2 << 20
#: Segments of a k-gram from which on it is dealt in pieces of this size, or of a ten-thousandth of all if that is more. A piece gives
#: up each of its windows, so only what is more than ``_SORTED`` bytes hold (a segment has 135 or so) is dealt.
PIECE = 8192
_NULL_ID = -(1 << 63)
_SEGMENT = "k bigint, digest bigint, doc_id bigint, h bigint, start bigint, width int, anchor int, again boolean"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def segments(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``k, start, width, anchor`` of the segments of a text: hash of the anchor, first window, number of windows, and the
    anchor's distance from the first window."""
    size = max(1, least // 3)
    width = least - size + 1
    found = []
    for at in range(0, len(data) - least + 1, _BLOCK):
        block = data[at : at + _BLOCK + least - 1]
        grams = Prefixes(block).grams(size)
        # the place in the low bits: of equal hashes the first is the least
        lowest = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        have = 1
        while 2 * have <= width:
            lowest = np.minimum(lowest[:-have], lowest[have:])
            have *= 2
        if have < width:
            lowest = np.minimum(lowest[: have - width], lowest[width - have :])
        anchor = (lowest & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        found.append((grams[anchor[start]].view(np.int64), start + at, np.diff(np.append(start, len(anchor))), anchor[start] - start))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _segmented(text: bytes, least: int) -> tuple[np.ndarray, ...]:
    """``k, digest, start, width, anchor, again`` of a text's segments; ``again``: an equal segment comes before it in the text."""
    k, start, width, anchor = segments(np.frombuffer(text, np.uint8), least)
    ends = (start + width + least - 1).tolist()
    blake = hashlib.blake2b
    digest = np.frombuffer(b"".join([blake(text[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), ends, strict=True)]), np.int64)
    order = np.lexsort((start, digest, k))
    again = np.zeros(len(k), bool)
    again[order[1:]] = (k[order[1:]] == k[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
    return k, digest, start, width, anchor, again


def _segment_rows(texts: DataFrame, least: int, keys_only: bool = False) -> DataFrame:
    """A row for each segment; ``keys_only``: the first of each kind in a text, without places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches):
            found: list[list[np.ndarray]] = []
            for doc_id, text, h in part:
                k, digest, start, width, anchor, again = _segmented(text.encode(), least)
                if keys_only:
                    k, digest = k[~again], digest[~again]
                    found.append([k, digest, np.full(len(k), doc_id)])
                else:
                    found.append([k, digest, np.full(len(k), doc_id), np.full(len(k), h), start, width.astype(np.int32), anchor.astype(np.int32), again])
            columns = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SEGMENT.split(", ")][: len(columns)])

    return texts.mapInArrow(cut, "k bigint, digest bigint, doc_id bigint" if keys_only else _SEGMENT)


def _slices(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted segments."""
    for part in rows(batches):
        out = []
        for doc_id, h, text, wanted in part:
            body = text.encode()
            out += [(w["k"], w["piece"], doc_id, h, w["start"], w["width"], w["anchor"], body[w["start"] : w["start"] + w["width"] + least - 1]) for w in wanted]
        yield pa.RecordBatch.from_pylist([dict(zip(_SLICE.names, x, strict=True)) for x in out], schema=_SLICE)


_SLICE = pa.schema([("k", pa.int64()), ("piece", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("width", pa.int32()), ("anchor", pa.int32()), ("body", pa.binary())])
_SLICE_SQL = "k bigint, piece int, doc_id bigint, h bigint, start bigint, width int, anchor int, body binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("left", pa.binary())])
_FOUND_SQL = "doc_id bigint, h bigint, start bigint, end bigint, left binary"


def repeated_windows(k: np.ndarray, width: np.ndarray, anchor: np.ndarray, body: list[bytes], whole: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``segment, offset, repeated`` of the windows of segments that may be repeated. Segments come in the order of ``k``, then of
    their places. ``whole``: all segments of that k-gram are here, so that windows that can't be repeated are left out."""
    size = max(1, least // 3)
    data = np.frombuffer(b"".join(body), np.uint8)
    length = np.array([len(b) for b in body], np.int64)
    base = np.cumsum(length) - length
    low, high = np.zeros(len(k), np.int64), width.astype(np.int64) - 1  # the windows' offsets in their segments
    if whole.any():
        at = anchor + size

        def reach(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
            order, same = suffix_order(data, begin, length, k)
            out = np.empty(len(order), np.int64)
            out[order] = np.maximum(same, np.append(same[1:], 0))
            return out

        behind = reach(data, base + at, length - at)
        before = reach(data[::-1], len(data) - base - anchor, anchor.astype(np.int64))
        # a window `offset` bytes into its segment has anchor - offset bytes before its anchor, and the rest behind it
        low = np.where(whole, np.maximum(low, anchor - before), low)
        high = np.where(whole, np.minimum(high, anchor + size + behind - least), high)
    count = np.maximum(0, high - low + 1)
    segment = np.repeat(np.arange(len(k)), count)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count) + low[segment]
    distance = anchor[segment] - offset
    number = np.cumsum(np.concatenate([[True], k[1:] != k[:-1]])) - 1
    by = np.lexsort((segment, distance, number[segment]))
    segment, offset = segment[by], offset[by]
    group = number[segment] * least + distance[by]
    order, same = suffix_order(data, base[segment] + offset, np.full(len(segment), least), group)
    repeated = np.zeros(len(segment), bool)
    repeated[order] = same == least
    return segment, offset, repeated


def _sort(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of rows that come by ``k, piece`` and place: spans to be removed, and of pieces the windows that are left."""

    def out(table: pa.Table) -> pa.RecordBatch:
        k, piece, doc_id, h, start, width, anchor = (table[c].to_numpy() for c in _SLICE.names[:-1])
        body = table["body"].to_pylist()
        # pieces of a k-gram are groups of their own
        group = np.cumsum(np.concatenate([[True], (k[1:] != k[:-1]) | (piece[1:] != piece[:-1])]))
        segment, offset, repeated = repeated_windows(group, width, anchor, body, piece == 0, least)
        gone = np.lexsort((offset[repeated], segment[repeated]))
        s, o = segment[repeated][gone], offset[repeated][gone]
        first = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)])[: len(s)]
        last = np.append(first[1:], True)[: len(s)]
        sf, begin, end = s[first], start[s[first]] + o[first], start[s[first]] + o[last] + least
        stay = np.flatnonzero(~repeated & (piece[segment] > 0))
        ss, so = segment[stay], offset[stay]
        left = [None] * len(sf) + [body[i][j : j + least] for i, j in zip(ss.tolist(), so.tolist(), strict=True)]
        columns = [np.concatenate([doc_id[sf], doc_id[ss]]), np.concatenate([h[sf], h[ss]]), np.concatenate([begin, start[ss] + so]), np.concatenate([end, start[ss] + so + least])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + [pa.array(left, pa.binary())], schema=_FOUND)

    kept: list[pa.Table] = []
    for batch in batches:
        table = pa.concat_tables([*kept, pa.Table.from_batches([batch])]).combine_chunks()
        kept = [table]
        if table.nbytes > _SORTED and table.num_rows > 1:
            k, piece = table["k"].to_numpy(), table["piece"].to_numpy()
            edge = np.flatnonzero((k[1:] != k[:-1]) | (piece[1:] != piece[:-1]))
            if len(edge):  # the last group may go on in the next batch
                yield out(table.slice(0, edge[-1] + 1))
                kept = [table.slice(edge[-1] + 1)]
    for table in kept:
        if table.num_rows:
            yield out(table)


def repeated_spans(docs: DataFrame, least: int = LEAST, piece: int = PIECE) -> DataFrame:
    """``doc_id, h, spans``: the bytes to remove of each text that has any (``h``: the text's xxhash64; spans overlap)."""
    texts = _texts(docs)
    kinds = _segment_rows(texts, least, keys_only=True).groupBy("k").agg(F.min("digest").alias("d"), F.max("digest").alias("e"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    kinds = settle(kinds.where("n > 1").select("k", (F.col("d") != F.col("e")).alias("differ"), "first", "n"), "suffix-kinds")
    repeated = key_filter(kinds.select("k"))
    found = settle(_segment_rows(texts, least).where(F.col("again") | repeated(F.col("k"))), "suffix-segments")
    place = F.struct("doc_id", "h", "start", "width", "anchor")
    spans = [found.where("again")]
    met = meet_groups(found.where("not again").drop("again"), kinds, "k", "n").drop("n")
    spans.append(met.where("not differ and doc_id <> first"))
    differing = settle(met.where("differ").select(F.struct("k", "digest").alias("kind"), "doc_id", "h", "start", "width", "anchor"), "suffix-differing")
    classes = settle(differing.groupBy("kind").agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("n")), "suffix-classes")
    spans.append(meet_groups(differing, classes.where("n > 1"), "kind", "n").where("doc_id <> rep.doc_id"))
    cut = [s.select("doc_id", "h", "start", (F.col("start") + F.col("width") + least - 1).alias("end")) for s in spans]

    reps = classes.select("kind.k", "rep.*")
    bound = max(piece, reps.count() // 10_000)
    hot = reps.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > bound)  # ten thousand rows at most
    reps = reps.join(F.broadcast(hot), "k", "left").withColumn("piece", F.when(F.col("m").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc_id", "h", "start"), F.ceil(F.col("m") / bound))).cast("int"))
    wanted = settle(reps.groupBy("doc_id", "h").agg(F.collect_list(F.struct("k", "piece", "start", "width", "anchor")).alias("wanted")), "suffix-wanted")
    theirs = texts.where(key_filter(wanted.select("h"))(F.col("h")))
    slices = theirs.join(wanted, ["doc_id", "h"]).select("doc_id", "h", "text", "wanted").mapInArrow(lambda b: _slices(b, least), _SLICE_SQL)

    def sort(rows_: DataFrame) -> DataFrame:
        return rows_.repartition("k", "piece").sortWithinPartitions("k", "piece", "doc_id", "h", "start").mapInArrow(lambda b: _sort(b, least), _FOUND_SQL)

    once = settle(sort(slices), "suffix-sorted")
    left = once.where("left is not null").select(F.xxhash64("left").alias("k"), F.lit(0).alias("piece"), "doc_id", "h", "start", F.lit(1).alias("width"), F.lit(0).alias("anchor"), F.col("left").alias("body"))
    cut += [once.where("left is null").drop("left"), sort(left).where("left is null").drop("left")]
    all_ = cut[0]
    for more in cut[1:]:
        all_ = all_.unionByName(more)
    return all_.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in rows(batches):
        out = []
        for doc_id, text, spans in part:
            body, merged = text.encode(), []
            for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([start, end])
            edges = [0, *(x for span in merged for x in span), len(body)]
            kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append({"doc_id": doc_id, "n_bytes": len(body), "spans": [{"start": a, "end": b} for a, b in merged], "kept": kept})
        yield pa.RecordBatch.from_pylist(out, schema=_KEPT)


def remove_repeats(docs: DataFrame, least: int = LEAST, piece: int = PIECE) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: of each row the bytes of the text, the maximal runs of bytes removed ([start, end)), and
    the bytes that stay (removal may cut a character). ``piece``: see ``PIECE``. The module says what holds for nulls,
    empty texts and repeated rows."""
    texts, spans = _texts(docs), settle(repeated_spans(docs, least, piece), "suffix-spans")
    touched = key_filter(spans.select("h"))(F.col("h"))
    cut = texts.where(touched).join(spans, ["doc_id", "h"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    as_is = texts.where(~touched).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("spans"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(as_is).withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))

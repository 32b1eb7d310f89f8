"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows.

Each benchmark item is cut into windows of consecutive words; all windows form one automaton, which every document's
word stream passes through once. Matches are word ranges; ``hits`` maps them to offsets in the original text.

The automaton goes to every Python worker, so the size of the benchmark is checked first: items are dealt into as many
automata as keep each under ``max_automaton_bytes`` of patterns, and each automaton takes one pass over the documents, whose
hits are put together by the number of the row. A worker keeps its automaton from task to task.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, settle, texts_of

WINDOW = 10
#: Bytes of patterns in one automaton, which takes up to 45 times as many.
MAX_AUTOMATON_BYTES = 8 << 20

#: Lower-case letters and digits stay, other ASCII becomes a space; bytes over 0x7F are letters.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    """Windows of ``size`` words; fewer words, but not none, are one window."""
    if words:
        for at in range(max(1, len(words) - size + 1)):
            yield b" ".join(words[at : at + size])


def build_automaton(items: list[tuple[int, str]], size: int = WINDOW) -> ahocorasick.Automaton:
    """Items as (id, text). The value of a pattern is its number of words and the ids of its items."""
    owners: dict[bytes, set[int]] = {}
    for item_id, text in items:
        for window in windows_of(words_of(text), size):
            owners.setdefault(window, set()).add(item_id)
    automaton = ahocorasick.Automaton()
    for window, ids in owners.items():
        automaton.add_word(f" {window.decode()} ", (window.count(b" ") + 1, tuple(sorted(ids))))
    if owners:
        automaton.make_automaton()
    return automaton


def scan(automaton: ahocorasick.Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged ranges [first, end) of hit words, and the items that have a window in the text."""
    if not words or not len(automaton):
        return [], set()
    stream = f" {b' '.join(words).decode()} "
    found, items, at, at_word = [], set(), 0, 0
    for last, (n, ids) in automaton.iter(stream):
        at_word += stream.count(" ", at, last)  # spaces before `last`: the number of words that end there
        at = last
        found.append((at_word - n, at_word))
        items.update(ids)
    merged: list[tuple[int, int]] = []
    for first, end in sorted(found):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((first, end))
    return merged, items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as [start, end) code points of the original text."""
    if not ranges:
        return []
    at = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [(at[first][0], at[end - 1][1]) for first, end in ranges]


_HITS = "row bigint, doc_id bigint, n_words bigint, words array<struct<first:int,end:int>>, spans array<struct<start:int,end:int>>, items array<bigint>"
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, items: list[tuple[int, str]], size: int) -> ahocorasick.Automaton:
    """This worker's automaton of that name; the one before is given up."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build_automaton(items, size)
    return _BUILT[name]


def _blocks(benchmark: DataFrame, size: int, max_bytes: int) -> Iterator[DataFrame]:
    """The items, dealt by a hash of the id into as few blocks as keep the patterns of each under ``max_bytes``."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total * size // max_bytes
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield dealt.where(F.col("block") == block)


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_automaton_bytes: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """Benchmark windows in documents: ``doc_id, n_words, words, spans, items``, a row per row of ``docs``.

    ``words`` are merged ranges of word numbers, ``spans`` the same as code points of the original text, ``items`` the
    sorted ids of items with a window in the text. Null and empty texts have no words and no hits; null items have no
    windows; an item repeated under several ids is found under each; a null item_id is ignored. Rows that repeat a doc_id
    are told apart. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = list(_blocks(benchmark, size, max_automaton_bytes))
    table = texts_of(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if len(blocks) > 1:
        table = settle(table, "benchmark-texts")  # the numbers of rows are to be the same in every pass
    passes = []
    for items in blocks:
        shared, name = spark.sparkContext.broadcast([(r.item_id, r.text) for r in items.where("item_id is not null").collect()]), uuid.uuid4().hex

        def find(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, shared.value, size)
            for part in rows(batches):
                numbers, ids, n_words, ranges, spans, found = [], [], [], [], [], []
                for number, doc_id, text in part:
                    words = words_of(text)
                    merged, owners = scan(automaton, words)
                    numbers.append(number)
                    ids.append(doc_id)
                    n_words.append(len(words))
                    ranges.append([{"first": a, "end": b} for a, b in merged])
                    spans.append([{"start": a, "end": b} for a, b in original_spans(text, merged)])
                    found.append(sorted(owners))
                span = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, pa.int64()), pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(ranges, span("first", "end")), pa.array(spans, span("start", "end")), pa.array(found, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "n_words", "words", "spans", "items"],
                )

        passes.append(table.mapInArrow(find, _HITS))
    if len(passes) == 1:
        return passes[0].drop("row")
    more = passes[1].where("size(items) > 0")
    for other in passes[2:]:
        more = more.unionByName(other.where("size(items) > 0"))
    # at most one row from each pass
    more = more.groupBy("row").agg(F.flatten(F.collect_list("words")).alias("w"), F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    return passes[0].join(more, "row", "left").select(
        "doc_id", "n_words", _merged(F.concat("words", F.coalesce("w", F.array())), "first").alias("words"),
        _merged(F.concat("spans", F.coalesce("s", F.array())), "start").alias("spans"),
        F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i", F.array())))).alias("items"),
    )


def _merged(ranges, first: str):
    """Sorted ranges with overlapping and touching ones joined."""
    empty = F.array_except(ranges, ranges)

    def add(done, x):
        last = F.element_at(done, -1)
        grown = F.struct(last[first].alias(first), F.greatest(last["end"], x["end"]).alias("end"))
        joins = (F.size(done) > 0) & (x[first] <= F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1)))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), empty, add)


def report(found: DataFrame) -> DataFrame:
    """Per document: how many words are hit, by which items."""
    n_hit = F.aggregate("words", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["first"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window. Rows of one doc_id go together; null doc_ids stay."""
    bad = hits(docs, benchmark).where("size(items) > 0").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")

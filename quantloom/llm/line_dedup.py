"""Removal of repeated passages of lines, in SQL functions alone.

A line ends with a line feed or with a sentence, and in lines over ``LONG`` characters with a comma, so that a passage
without line feeds has lines too. Every line that isn't blank has a hash, and every place a rolling hash over its line and the
next. Boundaries are chosen by which rolling hashes occur again anywhere: a chunk begins where a repeated one does and
ends where the run of repeated ones ends, so a passage has the same chunk wherever it stands and whatever stands around it,
and chunks have two lines at least. (Boundaries at local minima of the rolling hash, without regard to what repeats, lose
what lies before the first and behind the last one in a passage, and most passages of three or four lines whole.)

Repeats are removed after their bytes were compared. Every pair of neighbouring lines that is repeated still stands somewhere: in its
first place (least doc_id, then place), or, where a line of that place goes with another pair, in its next one. Everything that is shuffled is hashes and places, but for the lines to be compared, of which each goes once from a
task, and the texts that lose lines. A bitmap of the repeated hashes keeps others out of the shuffles.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_bound, key_filter, settle

#: Divides lines while a text is cut; stands for itself in texts through ``_escape``.
_CUT = "\x01"
_BLANK = " \t\n\r\x0b\x0c"
#: Characters of a line from which on commas end lines too.
LONG = 240
_PLACE = ("id", "of")


def _escape(text: Column) -> Column:
    marked = F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02"))
    return F.when(marked, F.replace(F.replace(text, F.lit("\x02"), F.lit("\x02B")), F.lit("\x01"), F.lit("\x02A"))).otherwise(text)


def _unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\x02")), F.replace(F.replace(text, F.lit("\x02A"), F.lit("\x01")), F.lit("\x02B"), F.lit("\x02"))).otherwise(text)


def lines_of(text: Column) -> Column:
    """All lines of a text, blank ones too, with what ends them. Put together they are the (escaped) text."""
    cut = _escape(F.coalesce(text, F.lit("")))
    for end in ("\n", ". "):
        cut = F.replace(cut, F.lit(end), F.lit(end + _CUT))
    rare = cut
    for end in ("! ", "? "):
        rare = F.replace(rare, F.lit(end), F.lit(end + _CUT))
    # to look for these ends takes far less than to replace them
    cut = F.when(F.contains(text, F.lit("! ")) | F.contains(text, F.lit("? ")), rare).otherwise(cut)
    commas = lambda x: F.split(F.replace(x, F.lit(", "), F.lit(", " + _CUT)), _CUT)
    return F.flatten(F.transform(F.split(cut, _CUT), lambda x: F.when(F.char_length(x) > LONG, commas(x)).otherwise(F.array(x))))


def _trimmed(lines: Column, text: Column) -> Column:
    """The lines of a text without blanks at their ends. Where no blanks but spaces and line feeds stand in the text, the latter
    stand at ends of lines alone, and spaces are trimmed without a list of blanks, which takes far longer."""
    rare = [F.contains(text, F.lit(c)) for c in _BLANK if c not in " \n"]
    slow = F.transform(lines, lambda x: F.btrim(x, F.lit(_BLANK)))
    return F.when(reduce(or_, rare), slow).otherwise(F.transform(lines, lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit("")))))


def _cut(docs: DataFrame) -> DataFrame:
    """Adds ``raw`` (all lines), ``bare`` (the same without blanks at their ends) and ``line`` (those of ``bare`` that aren't empty)."""
    return docs.withColumn("raw", lines_of(F.col("text"))).withColumn("bare", _trimmed(F.col("raw"), F.col("text"))).withColumn("line", F.array_remove("bare", ""))


def _roll(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def _windows(hashed: DataFrame) -> DataFrame:
    """A row for each pair of neighbouring lines: place, ``at`` (of the first line, from 0), hashes ``a, b``, rolling hash ``h``."""
    last = F.size("hash") - 1
    pairs = F.when(last > 0, F.arrays_zip(F.slice("hash", F.lit(1), last).alias("a"), F.slice("hash", F.lit(2), last).alias("b")))
    # an outer explode: Spark pushes no test of the array below what makes it
    return hashed.select(*_PLACE, F.posexplode_outer(pairs).alias("at", "w")).where("at is not null").select(*_PLACE, "at", "w.a", "w.b", _roll(F.col("w.a"), F.col("w.b")).alias("h"))


def _repeats(members: DataFrame, key: list[str], often: DataFrame) -> DataFrame:
    """The places of pairs that stand elsewhere before, each with whether it is its pair's ``second`` one, which has the ``first``
    place with it: ``members`` has ``h``, the key and place of pairs, also of some that don't repeat. Pairs of a rolling hash in
    ``often`` are too many for one task: they are ranked in ``parts`` by place, and the two first places of each part once more."""
    places = [*_PLACE, "at"]
    dealt = members.join(F.broadcast(often), "h", "left").withColumn("part", F.pmod(F.xxhash64(*places), F.coalesce("parts", F.lit(1).cast("bigint"))))
    rank = lambda by: [F.first(F.struct(*places)).over(by).alias("first"), F.dense_rank().over(by).alias("rank")]
    ranked = dealt.select(*places, *key, F.col("parts").isNotNull().alias("often"), *rank(Window.partitionBy(*key, "part").orderBy(*places)))
    ranked = settle(ranked.where("often or rank > 1"), "lines-ranked")
    heads = ranked.where("often and rank <= 2").select(*places, *rank(Window.partitionBy(*key).orderBy(*places)))
    heads = settle(heads.where("rank > 1"), "lines-heads")
    found = lambda t: t.select(*places, "first", (F.col("rank") == 2).alias("second"))
    return found(ranked.where("rank > 2 or not often")).unionByName(found(heads))


def _lines(again: DataFrame) -> DataFrame:
    """The lines to remove: place, ``lines``; both of each repeated pair, unless that would leave some pair nowhere.

    A pair stands on in its first place, if no line of that place goes. Where a pair beside it is repeated itself, one does: then the
    pair's second place keeps both of its lines, whatever other pairs they belong to."""
    at = lambda p, n: F.col(p)["at"] + n
    of = lambda p: [F.col(p)[c].alias(c) for c in _PLACE]
    pairs = again.where("second").select("first", F.struct(*_PLACE, "at").alias("next"))
    beside = pairs.select("next", *of("first"), F.explode(F.array(at("first", -1), at("first", 1))).alias("at"))
    broken = beside.join(again.select(*_PLACE, "at"), [*_PLACE, "at"], "left_semi")
    stay = broken.select(*of("next"), at("next", 0).alias("at")).groupBy(*_PLACE).agg(F.collect_set("at").alias("stay"))
    both = lambda c: F.array_union(c, F.transform(c, lambda k: k + 1))
    gone = again.groupBy(*_PLACE).agg(F.collect_set("at").alias("at")).join(stay, list(_PLACE), "left")
    left = F.when(F.col("stay").isNull(), both("at")).otherwise(F.array_except(both("at"), both("stay")))
    return gone.select(*_PLACE, F.sort_array(left).alias("lines")).where(F.size("lines") > 0)


def _gone(marked: DataFrame, digest) -> DataFrame:
    """The lines to remove: place, ``lines`` (from 0, in order)."""
    hashed = settle(_cut(marked.select(*_PLACE, "text")).select(*_PLACE, F.transform("line", digest).alias("hash")), "lines-hashes")
    windows = _windows(hashed)
    again = settle(windows.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "lines-repeated")
    may_repeat = key_filter(again.select("h"))
    members = settle(windows.where(may_repeat(F.col("h"))), "lines-members")
    bound = hot_bound(members)
    often = again.where(F.col("times") > bound).select("h", F.ceil(F.col("times") / bound).alias("parts"))

    # the bytes of every line of a pair that may repeat: lines are the same byte by byte, or two stand under their hash
    cut = _cut(marked.select("text")).select("line", F.transform("line", digest).alias("a"))
    none, most = F.array(F.lit(None).cast("bigint")), F.greatest(F.size("a") - 1, F.lit(0))
    shifted = {"before": F.concat(none, F.slice("a", F.lit(1), most)), "behind": F.concat(F.slice("a", F.lit(2), most), none)}
    each = cut.select(F.inline_outer(F.arrays_zip("line", "a", *(c.alias(n) for n, c in shifted.items())))).where("a is not null")
    each = each.where(may_repeat(_roll(F.col("before"), F.col("a"))) | may_repeat(_roll(F.col("a"), F.col("behind")))).select("a", "line")
    clashes = settle(each.distinct().groupBy("a").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("a"), "lines-clashes")

    if clashes.isEmpty():
        found = _repeats(members, ["a", "b"], often)
    else:  # pairs with a line whose hash stands for several are told apart by their bytes
        clean = members.join(clashes, "a", "left_anti").join(clashes.withColumnRenamed("a", "b"), "b", "left_anti")
        texts = _cut(marked.select(*_PLACE, "text")).select(*_PLACE, F.col("line").alias("hash"))
        bodies = _windows(texts).withColumns({"ha": digest(F.col("a")), "hb": digest(F.col("b"))})
        bodies = bodies.join(clashes.withColumnRenamed("a", "ha"), "ha", "left_semi").unionByName(bodies.join(clashes.withColumnRenamed("a", "hb"), "hb", "left_semi")).select(*_PLACE, "at", "a", "b", _roll(F.col("ha"), F.col("hb")).alias("h")).distinct()
        found = _repeats(settle(clean, "lines-clean"), ["a", "b"], often).unionByName(_repeats(settle(bodies, "lines-bodies"), ["a", "b"], often))
    return settle(_lines(found), "lines-gone")


def remove_repeated(docs: DataFrame, digest=line_hash) -> DataFrame:
    """``docs`` with ``text`` cleaned, and the columns ``n_lines, n_removed_chunks, n_removed_lines`` behind.

    Lines of removed chunks are cut out with what ends them; everything else of a text, blank lines too, stays byte by byte.
    Null texts stay null and have no lines. Rows that repeat doc_id and text whole count as one place: what stays in one
    stays in each. A null doc_id comes before all others. Lines under one hash that differ in bytes are told apart
    (``digest`` may be any hash of a line). Columns named like those added are replaced; all others are kept, whatever
    their names. An empty table gives no rows.
    """
    added = ("n_lines", "n_removed_chunks", "n_removed_lines")
    own = [c for c in docs.columns if c not in added]
    col = lambda c: F.col("row")[c]
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"))
    marked = marked.select("row", F.coalesce(col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(col("text")).alias("of"), col("text").alias("text"))
    gone = _gone(marked, digest)
    loses = key_filter(settle(gone.select(F.xxhash64(*_PLACE).alias("doc")), "lines-docs"))
    doc = F.xxhash64(*_PLACE)
    # only texts that lose lines meet their list of lines
    whole = _cut(marked.where(~loses(doc))).select("row", "text", F.size("line").cast("bigint").alias("n_lines"), *(F.lit(0).cast("bigint").alias(c) for c in added[1:]))
    met = _cut(marked.where(loses(doc)).join(gone, list(_PLACE), "left"))
    filled = F.filter(F.sequence(F.lit(0), F.size("raw") - 1), lambda i: F.get("bare", i) != "")
    met = met.withColumn("filled", filled)
    stay = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), F.transform("lines", lambda k: F.get("filled", k)))
    clean = _unescape(F.array_join(F.transform(stay, lambda i: F.get("raw", i)), ""))
    begins = F.size(F.array_except("lines", F.transform("lines", lambda k: k + 1)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    less = met.select(
        "row", F.when(F.col("lines").isNull(), F.col("text")).otherwise(clean).alias("text"), F.size("line").cast("bigint").alias("n_lines"),
        zero(F.when(F.col("lines").isNotNull(), begins)).alias(added[1]), zero(F.when(F.col("lines").isNotNull(), F.size("lines"))).alias(added[2]),
    )
    return whole.unionByName(less).select(*(F.col("text") if c == "text" else col(c).alias(c) for c in own), *added)

"""Personal data by candidates and boosted trees, in SQL functions alone.

Base rules find the spans that every result holds. Beside them, generators with high recall propose spans that may overlap
(numbers joined by other signs, parts of a run that the base rule drops whole, mail addresses with spelled-out signs).
Boosted trees judge each candidate by its format and its context, and learn to tell candidates that are base spans from
the others without seeing what the base rules check (signs they need, check sums, ranges). The threshold of a kind is
calibrated on all candidates but those fitted on: the lowest probability down to which ``PRECISION`` of them are base spans.
So a candidate is added where nearly all that look like it are sure. Of overlapping candidates the likeliest stays, and none
that touches a base span.

The trees are compiled into one SQL expression. Patterns use possessive repeats, and begin where a run begins or the match
before ended, so that their time and stack stay bounded on long runs; none changes what is matched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Candidates of each kind to fit on, at most: those with the lowest hash of their place.
SAMPLE = 20_000
#: Steps of probability that thresholds are told apart by.
STEPS = 10_000
TREES, DEPTH = 20, 4
#: Share of base spans among the cases of a kind above its threshold.
PRECISION = 0.9
#: Sure cases of a kind, among those not fitted on, below which none is added.
LEAST = 5
_CONTEXT = 24

_BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_EDGE, _END = r"(?<![0-9A-Za-z@.+-])", r"(?![0-9A-Za-z@])"
#: (kind, pattern) of the generators; a pattern of its own for each length, so that proposals overlap.
_PROPOSE = (
    ("email", r"(?<![^\s<>\"'(),;:=])[^\s@<>\"'(),;:=]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[^\s@<>\"'(),;:=]{1,255}+"),
    ("ip", _EDGE + r"[0-9]{1,4}(?:\x20?[.,:]\x20?[0-9]{1,4}){3}+" + _END),
    ("card", _EDGE + r"[0-9]{12,19}+" + _END),
    ("card", _EDGE + r"[0-9]{4}(?:[\x20.-][0-9]{4}){3}+" + _END),
    ("phone", r"\+[0-9]{1,3}+[\x20.-]?\(?[0-9]{2,4}+\)?(?:[\x20.-]?[0-9]{2,4}+){2}+" + _END),
    ("phone", r"\+[0-9]{1,3}+[\x20.-]?\(?[0-9]{2,4}+\)?(?:[\x20.-]?[0-9]{2,4}+){3}+" + _END),
    ("phone", _EDGE + r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}" + _END),
)
_WORDS = (r"(?i)(?:mail|contact|write)", r"(?i)(?:\bip\b|host|server|address)", r"(?i)(?:card|visa|credit|pay|account)", r"(?i)(?:tel|phone|call|fax|mobile)")
_SPAN = "struct<start:int,end:int,value:string>"


def _found(table: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """For each pattern a column of its matches in ``text``, leftmost and not overlapping: start, end (code points), value."""
    kept = table.columns
    table = table.select(*kept, *(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p in patterns.items()))
    # what lies between the matches gives their places
    table = table.select(*kept, *(f"_m_{k}" for k in patterns), *(F.when(F.size(f"_m_{k}") > 0, F.split("text", p, -1)).alias(f"_g_{k}") for k, p in patterns.items()))

    def placed(k: str) -> Column:
        pairs = F.arrays_zip(F.slice(f"_g_{k}", 1, F.size(f"_m_{k}")).alias("gap"), F.col(f"_m_{k}").alias("value"))

        def add(done: Column, x: Column) -> Column:
            start = done["at"] + F.char_length(x["gap"])
            end = start + F.char_length(x["value"])
            return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.when(F.size(f"_m_{k}") > 0, F.aggregate(pairs, first, add, lambda d: d["out"])).otherwise(F.array().cast(f"array<{_SPAN}>")).alias(k)

    return table.select(*kept, *(placed(k) for k in patterns))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits (19 at most) has a valid check digit."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.lit(0) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.char_length(_digits(value))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _features(kind: str, text: Column, x: Column) -> Column:
    """Format and context of a candidate; nothing of the base rules' checks."""
    value = x["value"]
    left = F.substring(text, F.greatest(x["start"] - _CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(_CONTEXT)))
    right = F.substring(text, x["end"] + 1, F.lit(_CONTEXT))
    number = lambda c: F.char_length(c).cast("double")
    count = lambda c, p: F.regexp_count(c, F.lit(p)).cast("double")
    flag = lambda c, p: F.when(F.regexp_like(c, F.lit(p)), 1.0).otherwise(0.0)
    return F.array(
        F.lit(float(KINDS.index(kind))), number(value), number(_digits(value)), count(value, "[A-Za-z]"), count(value, r"[\x20.,:()-]"), count(value, "[0-9]+"), flag(value, r"^\+"), flag(value, r"\("),
        F.coalesce(F.regexp_extract(value, "([0-9])", 1).try_cast("double"), F.lit(-1.0)), number(F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda p: F.struct(F.char_length(p).alias("n"), p.alias("p"))))["p"]),
        flag(value, r"@.*\.[A-Za-z]{2,}$"), flag(left, r"(?:^|\s)$"), flag(right, r"^(?:$|\s|[.,;:!?)](?:\s|$))"), count(left, "[0-9]"), count(right, "[0-9]"), *(flag(left, w) for w in _WORDS),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base spans of each kind, and ``proposed``: kind, start, end, features and whether it is a base span."""
    generators = {f"p{i}": p for i, (_, p) in enumerate(_PROPOSE)}
    found = _found(_found(texts_of(docs), _BASE), generators)

    def valid(k: str) -> Column:
        return F.filter(k, lambda x: _valid(k, x["value"])).alias(k)

    found = found.select("doc_id", "text", *map(valid, KINDS), *generators)

    def proposal(name: str, kind: str) -> Column:
        sure = lambda x: F.exists(kind, lambda b: (b["start"] == x["start"]) & (b["end"] == x["end"]))
        return F.transform(
            name, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _features(kind, F.col("text"), x).alias("features"), sure(x).alias("sure"))
        )

    proposed = F.concat(*(proposal(f"p{i}", kind) for i, (kind, _) in enumerate(_PROPOSE)))
    bare = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k)
    return found.select("doc_id", *(bare(k) for k in KINDS), proposed.alias("proposed"))


def _tree(node, x: Column) -> Column:
    """A fitted tree as an expression over a candidate's features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    at = node.split()
    return F.when(F.get(x, F.lit(at.featureIndex())) <= float(at.threshold()), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


def _step(p: Column) -> Column:
    return F.floor(p * STEPS).cast("int")


class Judge:
    """A fitted model: the probability that a candidate is marked, up to which hash of its place each kind was fitted on, and
    the threshold of each kind in steps (missing: none is added)."""

    def __init__(self, model, fitted: dict[int, int]) -> None:
        self.model, self.fitted, self.thresholds = model, fitted, {}

    def probability(self, features: Column) -> Column:
        trees = zip(self.model._java_obj.trees(), self.model.treeWeights, strict=True)
        margin = sum((_tree(t.rootNode(), features) * float(w) for t, w in trees), F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2.0))

    def accepts(self, x: Column) -> Column:
        out = F.lit(False)
        for kind, threshold in self.thresholds.items():
            out = F.when(x["kind"] == kind, _step(x["p"]) >= threshold).otherwise(out)
        return out


def _place(c: Column) -> Column:
    return F.xxhash64("doc_id", c["kind"], c["start"], c["end"])


def _fits(h: Column) -> Column:
    """Whether a candidate is one to fit on, if it is in the sample."""
    return F.pmod(h, F.lit(4)) > 0


def learn(found: DataFrame) -> Judge | None:
    """Fits the trees; None where there is nothing to learn from."""
    cases = found.where(F.size("proposed") > 0).select("doc_id", F.explode("proposed").alias("c"))
    cases = cases.select(F.col("c.kind").alias("kind"), F.col("c.features").alias("features"), F.col("c.sure").cast("double").alias("label"), _place(F.col("c")).alias("h"))
    picked = reduce(DataFrame.unionByName, (cases.where(F.col("kind") == k).orderBy("h").limit(SAMPLE) for k in range(len(KINDS))))
    picked = settle(picked, "private-sample")
    fitted = picked.where(_fits(F.col("h")))
    if fitted.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, minInstancesPerNode=5, seed=5, checkpointInterval=-1)
    model = trees.fit(fitted.select(array_to_vector("features").alias("features"), "label").coalesce(2))
    return Judge(model, {r.kind: r.h for r in picked.groupBy("kind").agg(F.max("h").alias("h")).collect()})


def calibrate(judge: Judge, judged: DataFrame) -> None:
    """Sets the thresholds by all candidates that weren't fitted on, counted by kind and step of probability."""
    cases = judged.select(F.explode("proposed").alias("c")).select("c.kind", "c.sure", "c.h", _step(-F.col("c.rank")).alias("step"))
    bound = F.lit(None).cast("bigint")
    for kind, h in judge.fitted.items():
        bound = F.when(F.col("kind") == kind, F.lit(h)).otherwise(bound)
    kept = cases.where(~(_fits(F.col("h")) & (F.col("h") <= bound)))
    steps = kept.groupBy("kind", "step").agg(F.sum(F.col("sure").cast("long")).alias("sure"), F.count(F.lit(1)).alias("n"))
    falling = Window.partitionBy("kind").orderBy(F.desc("step"))
    ranked = steps.select("kind", "step", F.sum("sure").over(falling).alias("sure"), F.sum("n").over(falling).alias("n"))
    least = ranked.where((F.col("sure") >= PRECISION * F.col("n")) & (F.col("sure") >= LEAST)).groupBy("kind").agg(F.min("step").alias("step"))
    judge.thresholds = {r.kind: r.step for r in least.collect()}


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find_private(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, found`` for each row.

    The numbers count base spans. ``spans`` are base and added spans as kind:start:end (code points, end exclusive) by
    start, then kind, joined by commas; ``base_sha256`` is of the base ones alone, joined likewise; ``found`` has all as an
    array. Null and empty texts have none. Rows repeated are searched again, null doc_ids stay null, other columns are
    ignored, an empty table gives no rows. Where there are no sure cases to learn from, base spans are all there is.
    """
    found = settle(candidates(docs), "private-candidates")
    judge = learn(found)
    kind_span = lambda k: F.transform(k, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), x["end"].alias("end")))
    base = F.array_sort(F.concat(*(kind_span(k) for k in KINDS)))
    table = found.select("doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS), base.alias("base"), "proposed")
    if judge is None:
        added = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    else:
        judged = F.transform("proposed", lambda x: F.struct((-judge.probability(x["features"])).alias("rank"), x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["sure"].alias("sure"), _place(x).alias("h")))
        table = settle(table.withColumn("proposed", judged), "private-judged")
        calibrate(judge, table)
        passes = lambda x: judge.accepts(F.struct(x["kind"].alias("kind"), (-x["rank"]).alias("p")))
        free = F.filter("proposed", lambda x: passes(x) & ~F.exists("base", lambda b: _overlap(x, b)))
        table = table.withColumn("proposed", F.array_sort(free))
        keep = lambda done, x: F.when(F.exists(done, lambda d: _overlap(d, x)), done).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))))
        added = F.aggregate("proposed", F.array().cast("array<struct<start:int,kind:int,end:int>>"), keep)
    table = table.withColumn("added", added).withColumn("found", F.array_sort(F.concat("base", "added")))
    name = lambda x: F.get(F.array(*(F.lit(k) for k in KINDS)), x["kind"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return table.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("found").alias("spans"), F.size("added").cast("bigint").alias("n_added"), "found")

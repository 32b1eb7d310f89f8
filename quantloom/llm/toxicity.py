"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Two strings are as similar as the character subsequences of length three that they share; a subsequence that spans more
characters counts less (``DECAY`` to the power of its span), so gaps and inserted characters weaken a match and don't end
it. Strings are the words of a sentence, each between a start and an end sign; words in single letters are put together
("i d i o t"), signs inside a word are tried with and without ("i.d.i.o.t"), and long words are cut into overlapping pieces. A
sentence scores as its highest string, a text as its highest sentence.

Training rows are sentences. Labels are given for texts: all sentences of a text that isn't toxic are negative; those of a
toxic text that hold a string which explains toxic texts are positive, and others count for neither. A sentence stands in the
machine as its highest string (a multiple-instance machine), chosen anew in each round until no choice changes. No sentence
of the labelled texts is left out.

The features of a string are its normalised kernel values with the landmarks, whitened by the landmarks' own kernel matrix
(Nyström); the machine is linear in them. As all of this is linear in the string's own weighted subsequences, the model
folds into one table of weights over subsequences, and a string scores by summing its entries.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, texts_of

ORDER, DECAY = 3, 0.65
#: Labelled documents to learn from, at most, of each label; the ones with the lowest hash of their id.
SAMPLE = 1500
#: Landmark strings, two thirds at most from toxic texts.
LANDMARKS = 256
#: A string is a witness if it is more common in toxic texts by this log-likelihood ratio; labels can be wrong.
SURE = 8.0
#: Characters of a string, with its signs; longer words are cut into pieces that overlap by half.
LONGEST = 24
#: Texts that a worker scores together.
BATCH = 512
#: Rounds of choosing each sentence's highest string, at most.
ROUNDS = 6

_SIZE = 64  # letters a-z, other letters by their code, signs
_SENTENCE = re.compile(r"[^.!?\n]+")
_TOKEN = re.compile(r"[^\s]+")
_LETTERS = re.compile(r"[^\W_]+")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W_][\s.,*_-]+){3,}[^\W_](?!\S)")


def code(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    if c in "^$":
        return 27 if c == "^" else 28
    if c.isalpha():
        return 32 + ord(c) % 32
    return 29 if c.isdigit() else 30


def _pieces(word: str) -> Iterator[str]:
    signed = f"^{word}$"
    if len(signed) <= LONGEST:
        yield signed
    else:
        for at in range(0, len(signed) - LONGEST // 2, LONGEST // 2):
            yield signed[at : at + LONGEST]


#: What may stand around a word.
_AROUND = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…¡¿"


def strings_of(token: str) -> tuple[str, ...]:
    """What a token stands for: without signs at its ends, and without those inside."""
    core = token.strip(_AROUND)
    if core.isalnum():
        return (f"^{core}$",) if len(core) <= LONGEST - 2 else tuple(dict.fromkeys(_pieces(core)))
    bare = "".join(_LETTERS.findall(core))
    return tuple(dict.fromkeys(p for w in (core, bare) if w for p in _pieces(w)))


def spelled(text: str) -> set[str]:
    """Words spelled out in single letters."""
    return {p for m in _SPELLED.finditer(text) for p in _pieces("".join(_LETTERS.findall(m[0])))}


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of all subsequences of a string of length n, and their weights."""
    if n not in _TRIPLES:
        at = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)], dtype=np.int64).reshape(-1, ORDER)
        _TRIPLES[n] = at.T.copy(), (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)
    return _TRIPLES[n]


#: Codes of the characters of the first plane.
_CODES = np.array([code(chr(c)) for c in range(1 << 16)], dtype=np.int32)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all characters in turn, and where each string begins (one more than strings)."""
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    flat = _CODES[np.minimum(points, len(_CODES) - 1)]
    for c in np.unique(points[points >= len(_CODES)]).tolist():
        flat[points == c] = code(chr(c))
    return flat, np.cumsum([0, *map(len, strings)])


def _subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings of one length: the key of every subsequence (a row for each string), and the weights."""
    (i, j, k), weights = _triples(codes.shape[1])
    take = lambda at: np.take(codes, at, axis=1)
    return (take(i) * _SIZE + take(j)) * _SIZE + take(k), weights


def by_length(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strings of one length together: their places in the list, and their codes. Those shorter than a subsequence are left out."""
    flat, begins = _codes(strings)
    sizes = np.diff(begins)
    for n in np.unique(sizes[sizes >= ORDER]).tolist():
        places, step = np.flatnonzero(sizes == n), max(1, 300_000 // math.comb(n, ORDER))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            yield part, flat[begins[part][:, None] + np.arange(n)]


def _norms(codes: np.ndarray) -> np.ndarray:
    """The root of each string's kernel value with itself. The kernel's recursion over prefixes is, for all strings of one
    length, a product with the powers of ``DECAY`` below the diagonal on either side (everything is symmetric)."""
    m, n = codes.shape
    gap = np.arange(n)[:, None] - np.arange(n)[None] - 1
    below = np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0.0).astype(np.float32).T
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float32) * np.float32(DECAY**2)
    value = same
    for _ in range(ORDER - 1):
        half = (value.reshape(-1, n) @ below).reshape(m, n, n).transpose(0, 2, 1).reshape(-1, n)
        value = (half @ below).reshape(m, n, n) * same
    return np.sqrt(value.sum(axis=(1, 2)))


def vectors(strings: list[str]) -> list[dict[int, float]]:
    """Normalised subsequence vectors; a string too short to have one has none."""
    out: list[dict[int, float]] = [{} for _ in strings]
    for at, codes in by_length(strings):
        keys, weights = _subsequences(codes)
        for i, k in zip(at, keys, strict=True):
            v: dict[int, float] = {}
            for key, w in zip(k.tolist(), weights.tolist(), strict=True):
                v[key] = v.get(key, 0.0) + w
            norm = math.sqrt(sum(x * x for x in v.values()))
            out[i] = {key: x / norm for key, x in v.items()}
    return out


@dataclass
class Model:
    """Weights of subsequences, and the calibration of a text's highest value: score = 1 / (1 + exp(-(slope * x + shift)))."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def values(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), self.bias)
        for at, codes in by_length(strings):
            keys, weights = _subsequences(codes)
            out[at] += self.table[keys] @ weights / _norms(codes)
        return out

    def probability(self, value: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * value + self.shift))))


def sentences(text: str) -> Iterator[tuple[int, int]]:
    for m in _SENTENCE.finditer(text):
        yield m.span()


def _strings(text: str) -> set[str]:
    low = text.lower()
    return {s for t in set(_TOKEN.findall(low)) for s in strings_of(t)} | spelled(low)


def _svm(x: np.ndarray, signs: np.ndarray, weights: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the primal; both classes weigh the same in sum."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    c = cost * weights * np.where(signs > 0, 1 / max(1e-9, weights[signs > 0].sum()), 1 / max(1e-9, weights[signs < 0].sum()))
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-6  # the bias goes free
    loss = lambda v: 0.5 * (ridge * v * v).sum() + (c * np.square(np.maximum(1 - signs * (x @ v), 0))).sum()
    now = loss(w)
    for _ in range(60):
        short = np.flatnonzero(signs * (x @ w) < 1)
        inside, weight = x[short].astype(float), 2 * c[short]
        gradient = ridge * w - inside.T @ (weight * (signs[short] - inside @ w))
        step = np.linalg.solve((inside.T * weight) @ inside + np.diag(ridge), gradient)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if now - new <= 1e-9 * now:
            break
        now = new
    return w[:-1], float(w[-1])


def _association(a: int, b: int, n_a: int, n_b: int) -> float:
    """How surely a string is more common in the first kind of text: the log-likelihood ratio, negative where less common."""
    share = (a + b) / (n_a + n_b)
    g = 2 * ((a * math.log(a / (n_a * share)) if a else 0.0) + (b * math.log(b / (n_b * share)) if b else 0.0))
    return g if a * n_b > b * n_a else -g


def _lexicon(bags: list[np.ndarray], y: np.ndarray, odds: np.ndarray, neg: np.ndarray) -> list[int]:
    """Strings that make texts toxic, the surest first: the one that most surely explains the toxic texts that no string
    before it explains, again and again; and those about as sure as the surest. So words that only happen to stand in
    several copies of a toxic text don't count."""
    holders: dict[int, list[int]] = {}
    n_pos, n_neg = int((y > 0).sum()), int((y <= 0).sum())
    open_ = set(np.flatnonzero(y > 0).tolist())
    for i in open_:
        for s in bags[i][odds[bags[i]] >= SURE].tolist():
            holders.setdefault(s, []).append(i)
    queue = [(-float(odds[s]), s) for s in holders]
    heapq.heapify(queue)
    found = []
    while queue:
        _, s = heapq.heappop(queue)
        left = sum(i in open_ for i in holders[s])
        now = _association(left, int(neg[s]), n_pos, n_neg)
        if now < SURE:
            continue
        if queue and -queue[0][0] > now:
            heapq.heappush(queue, (-now, s))
            continue
        found.append(s)
        open_.difference_update(holders[s])
    best = odds.max()
    found = sorted({*found, *(s for s in holders if odds[s] >= 0.3 * best)}, key=lambda s: (-odds[s], s))
    return found or [int(odds.argmax())]


def _sentences(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """All strings of the texts, and those of each sentence that has any: as places in the list in turn, where each sentence
    begins (one more than sentences), and the text of each sentence."""
    place: dict[str, int] = {}
    flat, cuts, owner = array("i"), array("q", [0]), array("i")
    for i, text in enumerate(texts):
        for a, b in sentences(text):
            bag = _strings(text[a:b])
            if bag:
                flat.extend(place.setdefault(s, len(place)) for s in sorted(bag))
                cuts.append(len(flat))
                owner.append(i)
    return list(place), np.array(flat, dtype=np.int32), np.array(cuts), np.array(owner)


def fit(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, cost: float = 300.0) -> Model:
    """Learns from the sentences of labelled texts (see above). A text without a known string, or labels of one kind only,
    give an even score."""
    strings, flat, cuts, owner = _sentences(texts)
    y = np.array(toxic, dtype=int)
    if not (y[owner] > 0).any() or not (y <= 0).any():
        return Model(np.zeros(_SIZE**ORDER, np.float32), 0.0, 0.0, 4.0 if (y > 0).any() else -4.0)
    edges = cuts[np.searchsorted(owner, np.arange(len(texts) + 1))]
    bags = [np.unique(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    pos, neg = np.zeros(len(strings), dtype=int), np.zeros(len(strings), dtype=int)
    for bag, label in zip(bags, toxic, strict=True):
        (pos if label else neg)[bag] += 1
    n_pos, n_neg = int((y > 0).sum()), int((y <= 0).sum())
    odds = np.array([_association(a, b, n_pos, n_neg) for a, b in zip(pos.tolist(), neg.tolist(), strict=True)])
    explain = _lexicon(bags, y, odds, neg)
    common = [s for s in np.lexsort((np.arange(len(strings)), -neg)).tolist() if odds[s] <= 0 and neg[s]]
    telling = explain[: 2 * landmarks // 3]
    marks = [strings[m] for m in dict.fromkeys(telling + common[: landmarks - len(telling)]) if len(strings[m]) >= ORDER]

    sparse = vectors(marks)
    used = np.array(sorted({key for v in sparse for key in v}), dtype=np.int64)
    column = np.full(_SIZE**ORDER, len(used), dtype=np.int32)  # the last column is that of all other subsequences
    column[used] = np.arange(len(used))
    table = np.zeros((len(marks), len(used) + 1), dtype=np.float32)
    for row, v in zip(table, sparse, strict=True):
        row[column[list(v)]] = list(v.values())
    values, axes = np.linalg.eigh((table @ table.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    whiten = axes[:, good] / np.sqrt(values[good])
    # values of all landmarks by subsequence
    of = np.ascontiguousarray(table.T)

    def features(strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(marks)))
        for at, codes in by_length(strings):
            keys, weights = _subsequences(codes)
            for i, k, n in zip(at, column[keys], _norms(codes), strict=True):
                out[i] = weights @ of[k] / n
        return out @ whiten

    # the sentences that count
    told = np.zeros(len(strings), dtype=bool)
    told[explain] = True
    counts = (y[owner] <= 0) | np.logical_or.reduceat(told[flat], cuts[:-1])
    flat = flat[np.repeat(counts, np.diff(cuts))]
    cuts = np.concatenate([[0], np.cumsum(np.diff(cuts)[counts])])
    signs = np.where(y[owner[counts]] > 0, 1, -1)
    value = odds + 1e6 * told  # in the first round a toxic sentence stands as the string that explains it
    made: dict[int, np.ndarray] = {}
    before = None
    for _ in range(ROUNDS):
        high = np.maximum.reduceat(value[flat], cuts[:-1])
        tops = np.flatnonzero(value[flat] == np.repeat(high, np.diff(cuts)))
        witness = flat[tops[np.searchsorted(tops, cuts[:-1])]]
        if before is not None and (witness == before).all():
            break
        before = witness
        cases, weights = np.unique(np.stack([witness, signs], 1), axis=0, return_counts=True)
        new = [i for i in dict.fromkeys(cases[:, 0].tolist()) if i not in made]
        made.update(zip(new, features([strings[i] for i in new]).astype(np.float32), strict=True))
        w, bias = _svm(np.array([made[i] for i in cases[:, 0].tolist()], dtype=np.float32), cases[:, 1], weights.astype(float), cost)
        folded = np.zeros(_SIZE**ORDER, dtype=np.float32)
        folded[used] = ((whiten @ w).astype(np.float32) @ table)[:-1]
        model = Model(folded, bias, 1.0, 0.0)
        value = model.values(strings)
    best = np.array([value[b].max() if len(b) else model.bias for b in bags])
    model.slope, model.shift = _calibrate(best, y)
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's logistic, with his smoothed targets, by Newton steps."""
    p, n = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        z = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = target - z, z * (1 - z) + 1e-9
        m = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.clip(np.linalg.solve(m, [(g * x).sum() - 0.1 * a, g.sum() - 0.1 * b]), -1, 1)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


class Scorer:
    """Scores texts; keeps the values of tokens seen, up to a bound."""

    def __init__(self, model: Model, cache: int = 400_000) -> None:
        self.model, self.cache = model, cache
        self.known: dict[str, float] = {}

    def _learn(self, tokens: list[str]) -> dict[str, float]:
        per = [strings_of(t) for t in tokens]
        cuts = np.cumsum([0, *map(len, per)])
        value = np.append(self.model.values([s for x in per for s in x]), self.model.bias)
        top = np.maximum.reduceat(value, np.minimum(cuts[:-1], len(value) - 1))
        top[np.diff(cuts) == 0] = self.model.bias
        return dict(zip(tokens, top.tolist(), strict=True))

    def highest(self, texts: list[str]) -> list[float]:
        """The highest string value of each text."""
        known, lows = self.known, [t.lower() for t in texts]
        bags = [set(t.split()) for t in lows]
        all_ = set().union(*bags)
        new = list(all_.difference(known))
        fresh = self._learn(new) if new else {}
        if len(known) + len(fresh) > self.cache:
            kept = {t: known[t] for t in all_ if t in known}
            known.clear()
            known.update(kept)
        known.update(fresh)
        out = []
        for bag, low in zip(bags, lows, strict=True):
            top = max(map(known.__getitem__, bag), default=self.model.bias)
            if _SPELLED.search(low):
                top = max(top, float(self.model.values(list(spelled(low))).max()))
            out.append(top)
        return out

    def score(self, texts: list[str]) -> list[float]:
        return [self.model.probability(x) for x in self.highest(texts)]

    def worst_sentence(self, text: str) -> tuple[int, int] | None:
        """[start, end) of the sentence that scores highest."""
        spans = list(sentences(text))
        values = self.highest([text[a:b] for a, b in spans])
        return max(zip(values, spans, strict=True), key=lambda x: (x[0], -x[1][0]))[1] if spans else None


_SCORERS: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """This worker's scorer of a model; what it has learned outlives a task. Only the last model's is kept."""
    if model.name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.name] = Scorer(model)
    return _SCORERS[model.name]


def held_out():
    """True for the documents that aren't learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents of each label, none of them held out. Labels other than 0 and 1, and
    labels of documents that aren't there, count for nothing; a doc_id with both labels counts as toxic."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where(~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    picked = [marks.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(sample) for y in (1, 0)]
    picked = picked[0].unionByName(picked[1])
    found = texts_of(docs).join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").collect()
    return fit([r.text for r in found], [r.toxic for r in found])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, start, end`` for each row: the score of the whole text, and where its worst
    sentence is. Null and empty texts have no string and score as the machine's bias; a null doc_id isn't held out.
    Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # _SIZE ** ORDER weights whatever the data

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer(shared.value)
        for part in rows(batches, BATCH):
            scores = judge.score([t for _, t in part])
            worst = [judge.worst_sentence(t) if s >= 0.5 else None for (_, t), s in zip(part, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in part], pa.int64()), pa.array(scores, pa.float64()), *(pa.array([w and w[k] for w in worst], pa.int32()) for k in (0, 1))],
                names=["doc_id", "score", "start", "end"],
            )

    scored = texts_of(docs).mapInArrow(make, "doc_id bigint, score double, start int, end int")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "start", "end")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic. Rows of one doc_id go together; null doc_ids stay."""
    bad = score_documents(docs, learn(docs, labels)).where("predicted = 1").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")

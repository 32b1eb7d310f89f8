"""Hidden Markov language model over whole corpora.

States emit word classes: each of the ``CLASSES`` most common training tokens is a class of its own, all others fall into
``TAILS`` classes by their last three characters. A token of a shared class has, in its class, the add-half probability of
its count. Counts are exact over all training documents, whatever their number; the model has a fixed size.

Training is Baum-Welch: each round, every partition of the training documents yields its expected counts from scaled
forward and backward recursions, Spark sums them by parameter, and the sums make the next model. Documents are trained on
whole: one of over ``STRETCH`` tokens is cut into stretches that advance together, after the products of their transitions
and emissions have given the exact forward and backward messages at every cut. Scoring runs the scaled forward recursion over
the whole document, so its likelihood is exact; documents of a batch advance together.

Counts of the ``LOOKUP`` most common tokens go to every worker; the counts of the others meet the documents by a join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, texts_of

STATES, ROUNDS, STRETCH = 8, 6, 2048
#: Tokens whose messages a worker holds at once.
_TOGETHER = 1 << 19
#: Bounds of what goes to every worker: tokens with a class of their own, shared classes, and tokens with a known count.
CLASSES, TAILS, LOOKUP = 16_384, 64, 200_000
#: Weight, in tokens, of the corpus distribution in each state's.
PRIOR = 200.0
END = ""


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens of a batch, the tokens as places among them, and where each text begins (one more than texts).
    Every text ends with ``END``."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = lists.offsets.to_numpy()
    cuts = cuts - cuts[0]
    if "" in words:  # what stands between white space and an end of the text
        keep = at != words.index("")
        cuts = np.concatenate([[0], np.cumsum(keep)])[cuts]
        at = at[keep]
    n = len(cuts) - 1
    at = np.insert(at, cuts[1:], len(words))
    return [*words, END], at, cuts + np.arange(n + 1)


def count_tokens(docs: DataFrame) -> DataFrame:
    """``token, n`` over the texts; the end of a text counts as a token, the empty one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["token", "n"])
        for batch in batches:
            words, at, _ = _tokens(batch.column(0))
            for w, n in zip(words, np.bincount(at, minlength=len(words)).tolist(), strict=True):
                if n:
                    total[w] = total.get(w, 0) + n
            if len(total) > 400_000:
                yield out()
                total.clear()
        if total:
            yield out()

    return docs.select("text").mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def tail_of(token: str) -> int:
    return zlib.crc32(token[-3:].encode()) % TAILS


@dataclass
class Vocabulary:
    """Counts of the common tokens and what the counts of all add up to."""

    counts: dict[str, int]
    classes: dict[str, int]
    n: int
    v: int
    tail_n: np.ndarray
    tail_v: np.ndarray

    @property
    def size(self) -> int:
        return len(self.classes) + TAILS

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def within(self, c: np.ndarray, tail: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tail_n[tail] + 0.5 * (self.tail_v[tail] + 1)))

    def shares(self) -> np.ndarray:
        """The corpus distribution over classes."""
        own = np.array([self.counts.get(t, 0) for t in self.classes], dtype=float)
        all_ = np.concatenate([own, self.tail_n]) + 0.5
        return all_ / all_.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    words = counts.where(F.col("token") != END)
    # the count from which on tokens fit the bound, by a histogram of a fixed size
    step, least, room = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int"), 0, LOOKUP
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if r["count"] > room:
            least = r.step + 1
            break
        room -= r["count"]
    common = sorted(((r.token, r.n) for r in words.where(step >= least).select("token", "n").toLocalIterator()), key=lambda x: (-x[1], x[0]))
    end = counts.where(F.col("token") == END).first()
    known = dict(common) | ({END: end.n} if end else {})
    classes = {t: i for i, t in enumerate([END, *(t for t, _ in common[: CLASSES - 1])])}
    # all tokens without a class of their own, those beyond the bound too: what comes behind the last that has one
    last = common[min(CLASSES - 1, len(common)) - 1] if common[: CLASSES - 1] else None
    rest = words if last is None else words.where((F.col("n") < last[1]) | (F.col("n") == last[1]) & (F.col("token") > last[0]))
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    tail = F.pmod(F.crc32(F.substring("token", -3, 3).cast("binary")), F.lit(TAILS)).cast("int")
    for r in rest.groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tail_n[r.tail], tail_v[r.tail] = r.n, r.v
    return Vocabulary(known, classes, total.n or 0, total.v or 0, tail_n, tail_v)


_CODED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, within double, classes binary, rest array<struct<token:string,tail:int,n:bigint>>"


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Each document as the classes of its tokens, the sums that its common tokens give, and its other tokens with their
    number, whose counts are still to be joined."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, row = shared.value, TaskContext.get().partitionId() << 33
        own = len(v.classes)
        for batch in batches:
            words, at, cuts = _tokens(batch.column(1))
            c = np.array([v.counts.get(w, 0) for w in words], dtype=float)
            listed = np.array([w in v.counts for w in words])
            kind = np.array([v.classes[w] if w in v.classes else own + tail_of(w) for w in words], dtype=np.int64)
            shared_class = kind >= own
            base = np.where(listed, v.base(c), 0.0)
            within = np.where(shared_class & listed, v.within(c, np.maximum(kind - own, 0)), 0.0)
            if not listed[-1]:  # the end of a text, where none was trained on
                listed[-1], base[-1] = True, v.base(np.zeros(1))[0]
            classes = kind.astype("<u2")[at]
            rest_at = np.flatnonzero(~listed[at])
            rest_cuts = np.searchsorted(rest_at, cuts).tolist()
            rest_of = at[rest_at]
            rest = []
            for a, b in zip(rest_cuts, rest_cuts[1:], strict=False):
                which, n = np.unique(rest_of[a:b], return_counts=True)
                rest.append([{"token": words[i], "tail": int(kind[i]) - own, "n": k} for i, k in zip(which.tolist(), n.tolist(), strict=True)])
            sums = lambda x: np.add.reduceat(x[at], cuts[:-1])  # noqa: E731  every text has its end at least
            edges = cuts.tolist()
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)), batch.column(0), batch.column(2), pa.array(np.diff(cuts)), pa.array(sums((c > 0).astype(np.int64))), pa.array(sums(base)), pa.array(sums(within)),
                    pa.array([classes[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()),
                    pa.array(rest, pa.list_(pa.struct([("token", pa.string()), ("tail", pa.int32()), ("n", pa.int64())]))),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "classes", "rest"],
            )
            row += n

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(make, _CODED)


@dataclass
class Model:
    """Start, transition and emission probabilities; emissions by class, then state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def scores(self, flat: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """log10 likelihood of each sequence of classes, by the scaled forward recursion. Sequences advance together, and
        end where they end."""
        sizes = np.diff(cuts)
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = cuts[:-1][order], sizes[order]
        out = np.zeros(len(sizes))
        live = np.searchsorted(-sizes, -np.arange(int(sizes.max(initial=0))), side="left")  # sequences longer than t
        a = None
        for t, n in enumerate(live.tolist()):
            e = self.emit[flat[begins[:n] + t]]
            a = e * self.start if a is None else (a[:n] @ self.move) * e
            s = a.sum(axis=1)
            a /= s[:, None]
            out[:n] += np.log10(s)
        back = np.empty_like(out)
        back[order] = out
        return back

    def _layout(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups of sequences, longest first: their numbers, and how many of them are longer than each step."""
        order = np.argsort(-sizes, kind="stable")
        ends = np.cumsum(sizes[order])
        at = 0
        while at < len(order):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, side="right")))
            group = order[at:end]
            yield group, np.searchsorted(-sizes[group], -np.arange(int(sizes[group[0]])), side="left")
            at = end

    def _messages(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For stretches of documents in turn (``first`` marks those that begin one): the forward message in front of each, and
        the backward message behind it. A document of one stretch needs neither."""
        k = len(self.start)
        ahead, behind = np.zeros((len(sizes), k)), np.ones((len(sizes), k))
        follows = np.flatnonzero(~first)
        if not len(follows):
            return ahead, behind
        heads = np.flatnonzero(first & np.append(~first[1:], False))
        product = np.zeros((len(sizes), k, k))
        for chosen in (heads, follows):
            for group, live in self._layout(flat, begins[chosen], sizes[chosen]):
                at = begins[chosen][group]
                p = None
                for t, n in enumerate(live.tolist()):
                    e = self.emit[flat[at[:n] + t]]
                    if chosen is heads:
                        step = self.start * e if p is None else (p[:n] @ self.move) * e
                        step /= step.sum(axis=1, keepdims=True)
                    else:
                        step = self.move * e[:, None] if p is None else (p[:n].reshape(-1, k) @ self.move).reshape(n, k, k) * e[:, None]
                        step /= step.sum(axis=(1, 2), keepdims=True)
                    if p is None:
                        p = step
                    else:
                        p[:n] = step
                if chosen is heads:
                    ahead[chosen[group] + 1] = p
                else:
                    product[chosen[group]] = p
        place = np.arange(len(sizes)) - np.maximum.accumulate(np.where(first, np.arange(len(sizes)), 0))
        more = np.append(~first[1:], False)  # another stretch follows
        for n in range(1, int(place.max()) + 1):
            s = np.flatnonzero((place == n) & more)
            out = np.einsum("si,sij->sj", ahead[s], product[s])
            ahead[s + 1] = out / out.sum(axis=1, keepdims=True)
        for n in range(int(place.max()), 0, -1):
            s = np.flatnonzero(place == n)
            out = np.einsum("sij,sj->si", product[s], behind[s])
            behind[s - 1] = out / out.sum(axis=1, keepdims=True)
        return ahead, behind

    def expect(self, flat: np.ndarray, cuts: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of starts, moves and emissions (by state, then class) over whole sequences of classes, and their
        log10 likelihood."""
        k, kind = len(self.start), self.emit.dtype
        numbers = np.arange(len(cuts) - 1)
        parts = -(-np.diff(cuts) // stretch)
        of = np.repeat(numbers, parts)
        begins = cuts[of] + stretch * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
        sizes = np.minimum(cuts[of + 1] - begins, stretch)
        first = begins == cuts[of]
        ahead_of, behind_of = (x.astype(kind).T for x in self._messages(flat, begins, sizes, first))
        starts, moves, counts, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(self.emit))), 0.0
        emits, forth, start = np.ascontiguousarray(self.emit.T), np.ascontiguousarray(self.move.T), self.start[:, None]
        for group, live in self._layout(flat, begins, sizes):  # arrays by state, then sequence
            off = np.concatenate([[0], np.cumsum(live)])
            at, fresh = begins[group], first[group]
            codes = np.empty(off[-1], np.int64)
            emit, ahead, scale = np.empty((k, off[-1]), kind), np.empty((k, off[-1]), kind), np.empty(off[-1], kind)
            edges, sizes_ = off.tolist(), live.tolist()
            for t, n in enumerate(sizes_):
                codes[edges[t] : edges[t + 1]] = flat[at[:n] + t]
            np.take(emits, codes, axis=1, out=emit, mode="clip")
            a = None
            for t, n in enumerate(sizes_):
                i, j = edges[t], edges[t + 1]
                a = np.where(fresh, start, forth @ ahead_of[:, group]) if a is None else forth @ a[:, :n]
                a *= emit[:, i:j]
                np.add.reduce(a, axis=0, out=scale[i:j])
                a /= scale[i:j]
                ahead[:, i:j] = a
            likelihood += float(np.log10(scale).sum())
            emit /= scale  # what a move to each state is worth, but for what lies behind
            # backward; messages at the end of a stretch are scaled by the forward ones there, so that all products sum to one
            ends = behind_of[:, group]
            ends = ends / (ends * ahead[:, off[sizes[group] - 1] + np.arange(len(group))]).sum(axis=0)
            behind = np.empty((k, 0), kind)
            for t in range(len(live) - 1, -1, -1):
                i, j, n = edges[t], edges[t + 1], sizes_[t]
                if behind.shape[1] < n:
                    behind = np.concatenate([behind, ends[:, behind.shape[1] : n]], axis=1)
                worth = emit[:, i:j]
                worth *= behind
                if t:
                    before = edges[t - 1]
                    moves += ahead[:, before : before + n] @ worth.T
                    ahead[:, i:j] *= behind
                    behind = self.move @ worth
                else:
                    moves += ahead_of[:, group[~fresh]] @ worth[:, ~fresh].T
                    ahead[:, i:j] *= behind
                    starts += ahead[:, i:j][:, fresh].sum(axis=1)
            for state in range(k):
                counts[state] += np.bincount(codes, weights=ahead[state], minlength=len(self.emit))
        return starts, self.move * moves, counts, likelihood


def first_model(vocab: Vocabulary, seed: int = 11) -> Model:
    """States that stay, each with the corpus distribution disturbed in its own way."""
    random = np.random.default_rng(seed)
    emit = vocab.shares()[:, None] * np.exp(random.normal(0, 0.7, (vocab.size, STATES)))
    return Model(np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES), (emit / emit.sum(axis=0)).astype(np.float32))


def train(coded: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over the coded documents; the driver sees sums alone, as many as the model has parameters."""
    model, shares = first_model(vocab), vocab.shares()
    k, size = STATES, vocab.size
    for _ in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, total = shared.value, np.zeros(k + k * k + k * size)
            m = Model(m.start.astype(np.float32), m.move.astype(np.float32), m.emit)
            for batch in batches:
                codes = [np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()]
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in codes])])
                start, move, emit, _ = m.expect(np.concatenate(codes) if codes else np.zeros(0, "<u2"), cuts)
                total += np.concatenate([start, move.ravel(), emit.ravel()])
            found = np.flatnonzero(total)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["parameter", "expected"])

        sums = coded.select("classes").mapInArrow(expect, "parameter int, expected double").groupBy("parameter").agg(F.sum("expected").alias("expected")).toArrow()
        total = np.zeros(k + k * k + k * size)
        total[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
        shared.unpersist()
        start, move = total[:k] + 1, total[k : k + k * k].reshape(k, k) + 1
        emit = total[k + k * k :].reshape(k, size).T + PRIOR * shares[:, None]
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), (emit / emit.sum(axis=0)).astype(np.float32))
    return model


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Learns from the rows that aren't held out (a null doc_id isn't). ``score`` is the log10 probability of the whole text
    and its end under the model, ``base_score`` under the add-half unigram. Null and empty texts are an end alone. Where
    no row is trained on, every token is unknown. Repeated rows count again; other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    docs = texts_of(docs)
    counts = settle(count_tokens(docs.where(~held_out())), "lm-counts")
    vocab = vocabulary(counts)
    coded = settle(encode(docs, vocab), "lm-coded")
    model = train(coded.where(~F.col("held_out")), vocab, rounds)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        m = Model(m.start, m.move, m.emit.astype(np.float64))
        for batch in batches:
            codes = [np.frombuffer(x, "<u2") for x in batch.column(6).to_pylist()]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in codes])])
            found = m.scores(np.concatenate(codes) if codes else np.zeros(0, "<u2"), cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(found)], names=[*"row doc_id held_out n_tokens n_known base".split(), "path"])

    plain = coded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "classes")
    paths = plain.mapInArrow(score, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, path double")
    paths = paths.join(coded.select("row", "within"), "row")
    rest = coded.select("row", F.explode("rest").alias("r")).select("row", "r.token", "r.tail", F.col("r.n").alias("times"))
    rest = rest.join(counts, "token", "left").withColumn("c", F.coalesce("n", F.lit(0)) + 0.5)
    whole = F.array(*(F.lit(float(n + 0.5 * (v + 1))) for n, v in zip(vocab.tail_n, vocab.tail_v, strict=True)))
    found = rest.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") / F.lit(float(vocab.n + 0.5 * (vocab.v + 1))))).alias("rest_base"),
        F.sum(F.col("times") * F.log10(F.col("c") / F.get(whole, F.col("tail")))).alias("rest_within"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return paths.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("rest_base")).alias("base_score"), (F.col("path") + F.col("within") + zero("rest_within")).alias("score"),
    )

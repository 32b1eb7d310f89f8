"""The text operators against brute force, on the smallest tables and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from quantloom.llm import decontaminate, exact_dedup, hidden_markov, line_dedup, pieces, private_data, queries, simhash, token_shards, toxicity, warc

AWKWARD = ["", None, " ", "\n\n", "word", "a b", "a b c", "A  B\tC", "x" * 3000, "é 漢字 😀 ▁x", "the the the the", "a b c", "it's <|endoftext|> ok", "a\n \n b   c\r\n", "1" * 500, "tail \n"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, i, "lang", "digest of another kind") for i, t in enumerate(AWKWARD)]
    rows += [(None, "no id", 1, None, None), (3, "\n\n", 1, None, None)]  # a null key, and a repeated row
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, lang string, digest string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- SimHash


def brute_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps: dict) -> dict:
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [64, 1])  # by joined buckets alone, and by full balls
def test_simhash_against_brute_force(docs, texts, bucket):
    found = by_id(simhash.near_duplicates(docs, bucket))
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = brute_components(fps)
    assert {i: r.fingerprint for i, r in found.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in found.items()} == want


def test_meeting_groups_with_hot_ones(spark, monkeypatch):
    from quantloom.llm import common

    monkeypatch.setattr(common, "_FEW", 3)
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 9), ("b", 2), ("c", 4), ("d", 1)) for i in range(n)], "k string, i int")
    groups = rows.where("k <> 'd'").groupBy("k").count().withColumn("v", rows["k"])
    got = sorted((r.k, r.i, r.v) for r in common.meet_groups(rows, groups, "k", "count").collect())
    assert got == [(k, i, k) for k, n in (("a", 9), ("b", 2), ("c", 4)) for i in range(n)]


def test_key_filter_loses_no_key(spark):
    from pyspark.sql import functions as F

    from quantloom.llm import common

    random = np.random.default_rng(1)
    keys = [int(x) for x in random.integers(-(1 << 63), (1 << 63) - 1, 500)] + [0, -1, -(1 << 63)]
    test = common.key_filter(spark.createDataFrame([(k,) for k in keys], "k bigint"))
    others = spark.createDataFrame([(k + 1,) for k in keys[:500]], "k bigint")
    assert spark.createDataFrame([(k,) for k in keys], "k bigint").where(test(F.col("k"))).count() == len(keys)
    assert others.where(test(others["k"])).count() < 30


def test_links_of_near_fingerprints(spark):
    random = np.random.default_rng(3)
    fps = {int(x) for x in random.integers(-(1 << 63), 1 << 63, 20)}
    for f in list(fps):
        for _ in range(6):
            a, b = random.integers(0, 64, 2)
            g = (f ^ 1 << int(a) ^ 1 << int(b)) & (1 << 64) - 1
            fps.add(g - (1 << 64) if g >> 63 else g)
    table = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r.a, r.b) for r in simhash.links(table).collect()} == want


def test_simhash_awkward(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD) + 2
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {0}
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0
    assert set(simhash.keep_one_of_each(awkward).columns) == set(awkward.columns)


# --- language model


def test_hidden_markov_base_and_model(docs, texts):
    found = by_id(hidden_markov.score_documents(docs))
    tokens = {i: [*t.encode().lower().split(), b""] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = found[i]
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
    out = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_forward_is_exact_and_proper():
    random = np.random.default_rng(1)
    m = hidden_markov.Model(np.array([0.3, 0.7]), np.array([[0.9, 0.1], [0.2, 0.8]]), random.dirichlet(np.ones(3), 2).T)
    total = 0.0
    for code in range(27):
        seq = [code // 9, code // 3 % 3, code % 3]
        p = m.start * m.emit[seq[0]]
        for s in seq[1:]:
            p = (p @ m.move) * m.emit[s]
        got = m.scores(np.array(seq), np.array([0, 3]))[0]
        assert got == pytest.approx(math.log10(p.sum()))
        total += p.sum()
    assert total == pytest.approx(1)


def test_expected_counts_climb():
    random = np.random.default_rng(2)
    m = hidden_markov.Model(np.ones(2) / 2, np.array([[0.6, 0.4], [0.3, 0.7]]), random.dirichlet(np.ones(5), 2).T)
    cuts = np.concatenate([[0], np.cumsum(random.integers(1, 40, 40))])
    data = random.integers(0, 5, cuts[-1])
    last = -1e9
    for _ in range(8):
        start, move, emit, found = m.expect(data, cuts)
        assert found >= last - 1e-9 and found == pytest.approx(m.scores(data, cuts).sum())
        assert emit.sum() == pytest.approx(cuts[-1]) and start.sum() == pytest.approx(40) and move.sum() == pytest.approx(cuts[-1] - 40)
        last = found
        m = hidden_markov.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), (emit / emit.sum(axis=1, keepdims=True)).T)


@pytest.mark.parametrize("stretch", [1, 3, 7, 1000])
def test_expected_counts_of_whole_sequences(stretch):
    """Stretches with exact messages at their cuts against the posterior over whole sequences by its definition."""
    random = np.random.default_rng(9)
    k, size = 3, 6
    m = hidden_markov.Model(random.dirichlet(np.ones(k)), random.dirichlet(np.ones(k), k), random.dirichlet(np.ones(size), k).T)
    cuts = np.concatenate([[0], np.cumsum(random.integers(1, 25, 12))])
    data = random.integers(0, size, cuts[-1])
    starts, moves, counts = np.zeros(k), np.zeros((k, k)), np.zeros((k, size))
    for a, b in zip(cuts, cuts[1:]):
        x = data[a:b]
        f, g = [m.start * m.emit[x[0]]], [np.ones(k)]
        for c in x[1:]:
            f.append((f[-1] @ m.move) * m.emit[c])
        for c in x[:0:-1]:
            g.insert(0, m.move @ (m.emit[c] * g[0]))
        p = f[-1].sum()
        for t, c in enumerate(x):
            counts[:, c] += f[t] * g[t] / p
            if t:
                moves += f[t - 1][:, None] * m.move * (m.emit[c] * g[t])[None] / p
        starts += f[0] * g[0] / p
    got = m.expect(data, cuts, stretch)
    assert np.allclose(got[0], starts) and np.allclose(got[1], moves) and np.allclose(got[2], counts)


def test_hidden_markov_scores_against_a_plain_model(docs, texts):
    """The query's scores against a plain forward pass over each whole text with the model's own numbers."""
    table = docs.select("doc_id", "text")
    counts = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*t.encode().lower().split(), b""])
    vocab = hidden_markov.vocabulary(hidden_markov.settle(hidden_markov.count_tokens(table.where(~hidden_markov.held_out())), "t"))
    coded = hidden_markov.settle(hidden_markov.encode(hidden_markov.texts_of(table), vocab), "t")
    model = hidden_markov.train(coded.where("not held_out"), vocab, 2)
    found = by_id(hidden_markov.score_documents(table, 2))
    for i in sorted(texts)[:60]:
        score, a = 0.0, None
        for w in [*texts[i].encode().lower().split(), b""]:
            token = w.decode()
            own = vocab.classes.get(token)
            c = own if own is not None else len(vocab.classes) + hidden_markov.tail_of(token)
            e = model.emit[c].astype(float)
            if own is None:
                tail = hidden_markov.tail_of(token)
                e = e * (counts[w] + 0.5) / (vocab.tail_n[tail] + 0.5 * (vocab.tail_v[tail] + 1))
            a = (model.start if a is None else a @ model.move) * e
            score += math.log10(a.sum())
            a /= a.sum()
        assert found[i].score == pytest.approx(score, rel=1e-4)


def test_hidden_markov_awkward(awkward):
    rows = hidden_markov.score_documents(awkward, rounds=1).collect()
    assert len(rows) == len(AWKWARD) + 2 and all(math.isfinite(r.score) for r in rows)
    assert hidden_markov.score_documents(awkward.limit(0), rounds=1).count() == 0


@pytest.mark.parametrize("lookup", [0, 10, 2000])
def test_shared_classes_are_distributions(spark, monkeypatch, lookup):
    """Few common tokens, and more rare ones than the bound: in each shared class the probabilities still sum to one."""
    monkeypatch.setattr(hidden_markov, "LOOKUP", lookup)
    counts = {f"common{i}": 100 + i for i in range(8)} | {f"rare{i}": 1 for i in range(1000)} | {hidden_markov.END: 50}
    vocab = hidden_markov.vocabulary(spark.createDataFrame(list(counts.items()), "token string, n bigint"))
    shared = [t for t in counts if t not in vocab.classes]
    assert sum(vocab.tail_n) + sum(counts[t] for t in vocab.classes) == sum(counts.values()) and sum(vocab.tail_v) == len(shared)
    total = np.zeros(hidden_markov.TAILS)
    for t in shared:
        tail = hidden_markov.tail_of(t)
        total[tail] += 10 ** vocab.within(np.array(counts[t]), tail)
    unseen = 10 ** vocab.within(np.zeros(hidden_markov.TAILS), np.arange(hidden_markov.TAILS))
    assert total + unseen == pytest.approx(1)


# --- token shards


def test_shards_against_library(docs, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = by_id(token_shards.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), shard=20_000))
    at = 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 0]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_encoder_on_odd_strings():
    """Word by word and through the cache against the library on whole texts: signs, spaces of every kind, marks, letters of many scripts."""
    random, path = np.random.default_rng(12), public_tokenizers.path("byte_bpe_50k.json")
    pool = ["a", "Word", "don't", "'s", " ", " ", " ", "\n", ",", ".", "...", "?!", "é", "Æble", "漢", "😀", "1", "23", "\x01", "\x00", "\t", "\xa0", "\u2003", "\u200b", "_", "-", "×", "ſ", "<|", "²", "\u0301", "Ġ", "Ċ"]
    texts = ["".join(random.choice(pool, int(random.integers(0, 30)))) for _ in range(6000)]
    library, enc = Tokenizer.from_file(path), token_shards.Encoder(path)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for _ in range(3):  # new, come again, kept
            assert [x.tolist() for x in enc.encode_many(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_shards_awkward(awkward):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_shards.round_trip(awkward, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(rows) == len(AWKWARD) + 2
    sizes = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(AWKWARD)}
    assert all(r.n_tokens == sizes[r.doc_id] for r in rows if r.doc_id is not None)
    assert [r.start for r in rows if r.doc_id is None] == [0]
    assert token_shards.round_trip(awkward.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def check_shard(shard, ids, random):
    n = len(ids)
    for at in random.integers(0, max(n, 1), min(n, 60)):
        t = int(ids[at])
        assert shard.access(int(at)) == t
        a, b = sorted(int(x) for x in random.integers(0, n + 1, 2))
        assert shard.count(t, a, b) == int((ids[a:b] == t).sum())
        places = np.flatnonzero(ids == t)
        k = int(random.integers(0, len(places)))
        assert shard.find(t, k) == places[k] and shard.find(t, len(places)) is None
    assert shard.count(901) == 0 and shard.find(901, 0) is None


def test_wavelet_shard_answers():
    random = np.random.default_rng(5)
    for n in (0, 1, 7, 5000, 300_000):
        ids = random.zipf(1.3, n).astype(np.int64) % 900
        data = token_shards.WaveletShard.of(ids, [1, None], np.array([0, n // 2, n])).to_bytes()
        whole = token_shards.WaveletShard.from_bytes(data)
        assert (whole.tokens() == ids).all() and whole.docs == [1, None]
        check_shard(whole, ids, random)
        check_shard(token_shards.ShardFile(io.BytesIO(data)), ids, random)  # page by page, by the file's directory
    with pytest.raises(ValueError):
        token_shards.WaveletShard.from_bytes(b"else")


# --- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text: str) -> list[tuple[int, str, int]]:
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    def ok(kind, value):
        d = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in value.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    found = [(m.start(), o, k, m.end()) for o, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if ok(k, m[0])]
    return [(a, k, b) for a, _, k, b in sorted(found)]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def check_private(found, texts):
    for i, text in texts.items():
        base, r = base_spans(text), found[i]
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, x, _ in base) for k in BASE]
        assert {f"{k}:{a}:{b}" for a, k, b in base} <= set(r.spans.split(",")) | {""}


def test_private_base_spans(docs, texts):
    check_private(by_id(private_data.find_private(docs)), texts)


def test_private_awkward(spark):
    hard = ["a@b.c_d@e.f a@b@c.d x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1", "4111 1111-1111 1111", "+1 (269) 555-3296 4524132264652876", "é +49 30 1234567, ü 10.0.0.1", "9" * 5000, "a." * 4000 + "@", "+" * 300 + "1" * 12, "1 " * 2000, "", "a@b" + ".c" * 6000]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(hard)] + [(90, None)], "doc_id bigint, text string")
    check_private(by_id(private_data.find_private(table)), dict(enumerate(hard)) | {90: ""})
    assert private_data.find_private(table.limit(0)).count() == 0


def test_private_adds_what_a_run_hides(spark):
    random = np.random.default_rng(4)
    number = lambda: f"+1 ({random.integers(200, 999)}) 555-{random.integers(1000, 9999)}"
    rows = [(i, f"some words {number()} and {random.integers(10, 99)} more") for i in range(400)]
    rows += [(400 + i, f"part {random.integers(100, 999)}-{random.integers(1000, 9999)} of {random.integers(10**11, 10**12)}") for i in range(300)]
    rows.append((999, f"call {number()} 4524132264652876 now"))  # the base phone rule sees one run of 27 digits
    found = by_id(private_data.find_private(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert found[999].n_phone == 0 and "phone:5:22" in found[999].spans.split(",")
    assert all(found[i].n_added == 0 for i in range(400))


def test_private_rare_kind_beside_a_hot_one(spark, monkeypatch):
    """One kind holds nearly all candidates; a rare one is fitted and calibrated on its own cases all the same."""
    monkeypatch.setattr(private_data, "SAMPLE", 400)
    rows = [(i, f"call +1 (269) 555-{1000 + i} now") for i in range(3000)] + [(3000 + i, f"part {200 + i}-555-{2000 + i} here") for i in range(300)]
    rows += [(4000 + i, f"write to user{i}@site.org now") for i in range(60)]
    rows.append((9999, "write to user7\u00eb@site.org now"))  # no base span, as a letter isn't ASCII, but the same to the trees
    found = by_id(private_data.find_private(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)))
    assert found[9999].n_email == 0 and found[9999].spans == "email:9:24" and found[4000].spans == "email:9:23"


# --- benchmark


def brute_hits(text: str, items: dict) -> tuple[int, int, list]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hit, found = set(), set()
    for i, t in items.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        n = min(10, len(w))
        windows = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
        for a in range(len(words) - n + 1 if n else 0):
            if tuple(words[a : a + n]) in windows:
                hit.update(range(a, a + n))
                found.add(i)
    return len(words), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("limit", [decontaminate.MAX_AUTOMATON_BYTES, 30_000])  # one automaton, and several
def test_decontamination_against_brute_force(spark, sf, docs, texts, limit):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "The OF"), (901, None), (902, ""), (900, "the of")], "item_id bigint, text string"))
    items = {r.item_id: r.text or "" for r in benchmark.collect()}
    found = by_id(decontaminate.report(decontaminate.hits(docs, benchmark, max_automaton_bytes=limit)))
    for i, t in texts.items():
        n, hit, ids = brute_hits(t, items)
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated, r.items_sha256) == (n, hit, len(ids), hit > 0, hashlib.sha256(",".join(ids).encode()).hexdigest())


def test_decontamination_tells_rows_of_one_id_apart(spark):
    long = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(1, long), (2, "other words " + long[::-1])], "item_id bigint, text string")
    docs = spark.createDataFrame([(7, f"x {long} y"), (7, "four clean words here"), (None, long)], "doc_id bigint, text string")
    for limit in (decontaminate.MAX_AUTOMATON_BYTES, 200):
        rows = decontaminate.report(decontaminate.hits(docs, benchmark, max_automaton_bytes=limit)).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in rows) == [(0, 10, 10), (7, 4, 0), (7, 12, 10)]


def test_decontamination_spans_and_awkward(spark, awkward):
    item = spark.createDataFrame([(1, "One two, THREE four five six seven eight nine ten")], "item_id bigint, text string")
    doc = spark.createDataFrame([(1, "Ü! one TWO three-four five six seven eight nine ten. End")], "doc_id bigint, text string")
    (r,) = decontaminate.hits(doc, item).collect()
    assert [(s.start, s.end) for s in r.spans] == [(3, 51)]
    assert decontaminate.report(decontaminate.hits(awkward, item)).count() == len(AWKWARD) + 2
    assert decontaminate.hits(awkward, item.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.drop_contaminated(awkward, item).count() == len(AWKWARD) + 2


# --- WARC


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "u1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\n3", None), (4, "u4", ""), (5, "u5", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>x</p>"), (2, None, "<p>x</p>"), (6, "u6", "y" * 3_000_000)], "page_id bigint, url string, html string")
    rows = warc.round_trip(pages).collect()
    assert len(rows) == 8
    got = {r.page_id: r for r in rows}
    for i, html in ((1, "<p>x</p>"), (2, "<p>x</p>"), (3, ""), (4, ""), (5, "é\r\n\r\nWARC/1.1\r\n"), (6, "y" * 3_000_000)):
        assert got[i].payload_bytes == len(html.encode())
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert {i: (got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, 5)} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert bytes(got[5].payload).decode() == "é\r\n\r\nWARC/1.1\r\n" and got[1].payload is None
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_finds_damage():
    headers = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "WARC-Payload-Digest": f"sha1:{warc.digest_of(b'body')}"}
    good = warc.pack(headers, b"body")
    assert [r.payload for r in warc.read_records(io.BytesIO(good + good))] == [b"body", b"body"]
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(good[:-9])))
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(warc.pack(headers, b"other"))))
    import gzip

    text = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nbodyy\r\n\r\n"
    for wrong in (text, text.replace(b": 3", b": 99"), text.replace(b": 3", b": x"), b"HTTP/1.1 200 OK\r\n\r\n", b"no record", b""):
        with pytest.raises(warc.DamagedArchive):
            list(warc.read_records(io.BytesIO(gzip.compress(wrong))))
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(b"not gzip at all")))
    assert list(warc.read_records(io.BytesIO(b""))) == []


def test_warc_reader_inflates_as_far_as_the_record_says():
    """A member that inflates a thousandfold is never held whole where its record is short."""
    import gzip

    bomb = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + bytes(200_000_000))
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with pytest.raises(warc.DamagedArchive):
        list(warc.read_records(io.BytesIO(bomb)))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50_000


def test_warc_archives_follow_the_standard(spark, tmp_path):
    """What any reader needs: warcinfo first, dates, record ids that revisits refer to, HTTP blocks; and archives of others are read."""
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>")], "page_id bigint, url string, html string")
    (row,) = warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/a", date="2024-05-01T00:00:00Z").collect()
    with open(row.path.removeprefix("file://"), "rb") as f:
        info, *found = warc.read_records(f)
    assert info.headers["warc-type"] == "warcinfo" and b"WARC File Format" in info.payload
    by_type = {r.headers["warc-type"]: r for r in found}
    assert by_type["revisit"].headers["warc-refers-to"] == by_type["response"].headers["warc-record-id"]
    assert by_type["response"].payload == b"<p>x</p>" and by_type["revisit"].payload == b""
    assert all(r.headers["warc-date"] == "2024-05-01T00:00:00Z" and r.headers["content-type"].startswith("application/http") for r in found)
    other = warc.pack({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", "Content-Type": "application/http"}, b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhi")
    (tmp_path / "o.warc.gz").write_bytes(warc.pack({"WARC-Type": "request"}, b"GET /") + other)
    (r,) = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/o.warc.gz",)], "path string")).collect()
    assert (r.page_id, bytes(r.payload), r.payload_digest, r.payload_bytes) == (None, b"hi", warc.digest_of(b"hi"), 2)


# --- SentencePiece


@pytest.fixture(scope="module")
def model():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_against_library(docs, texts, awkward, model):
    path, library = model
    for table, known in ((docs, texts), (awkward.where("doc_id is not null").dropDuplicates(["doc_id"]), {i: t or "" for i, t in enumerate(AWKWARD)})):
        for i, r in by_id(pieces.piece_digests(table, path)).items():
            ids = library.encode(known[i])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_piece_spans(awkward, model):
    path, library = model
    for r in pieces.encode_documents(awkward, path).collect():
        text = next(t or "" for i, t in [*enumerate(AWKWARD), (None, "no id")] if i == r.doc_id)
        want = library.encode(text, return_type="proto").pieces
        assert [p.id for p in want] == r.ids
        whole = [k for k, p in enumerate(want) if not p.piece.startswith("<0x")]  # bytes share their character's span here
        assert [(r.starts[k], r.ends[k]) for k in whole] == [(want[k].begin, want[k].end) for k in whole]


def test_piece_digests_are_of_the_operators_rows(docs, texts, model, monkeypatch):
    """The query's spans against the library's, and its text from the ids by the library's decoder."""
    path, library = model
    for i, r in by_id(pieces.piece_digests(docs, path)).items():
        want = library.encode(texts[i], return_type="proto").pieces
        if not any(p.piece.startswith("<0x") for p in want):
            spans = [(p.begin, p.end) for p in want]
            assert r.spans_sha256 == hashlib.sha256(np.array(spans, "<i4").reshape(-1, 2).tobytes()).hexdigest()
    codec = pieces.Codec(path)
    given = []
    codec.whole = type("Decoder", (), {"decode": lambda self, ids: given.append(ids) or "decoded"})()
    assert codec.row("some words").decoded == "decoded" and given == [library.encode("some words")]


def test_compiled_character_map():
    """The longest-prefix map against the library's normaliser."""
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = pieces.sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    codec = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    codec.map, codec.prefix, codec.squeeze = pieces.CharacterMap(proto.normalizer_spec.precompiled_charsmap), True, True
    for text in ["㍿ fi ﬁ Å é ｶﾞ", "  ﬁ  x  ", "", "   ", "é", "①２ Ａ​\tb　c"]:
        found = codec.normalise(text)
        assert found.text == library.normalize(text)
        raw = text.encode()
        assert all(0 <= a <= b <= len(raw) for a, b in zip(found.starts, found.ends, strict=True))
    assert codec.normalise("aﬁb").starts == [0, 0, 1, 1, 4]


# --- toxicity


def test_kernel_against_its_definition():
    from itertools import combinations

    def vector(s):
        v = defaultdict(float)
        for at in combinations(range(len(s)), toxicity.ORDER):
            v[tuple(toxicity.code(s[i]) for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return v

    words = ["^idiot$", "^banana$", "^aaaa$", "^ab$"]
    for w in words:
        v = vector(w)
        assert toxicity._norms(next(toxicity.by_length([w]))[1])[0] == pytest.approx(math.sqrt(sum(x * x for x in v.values())), rel=1e-4)
    ours = toxicity.vectors(words)
    for w, v in zip(words, ours, strict=True):
        want = vector(w)
        norm = math.sqrt(sum(x * x for x in want.values()))
        assert {k: pytest.approx(x / norm) for k, x in want.items()} == {(k >> 12, k >> 6 & 63, k & 63): x for k, x in v.items()}


def planted(n=240):
    random = np.random.default_rng(8)
    plain = ["".join(random.choice(["on", "er", "th", "an", "re", "in", "st"], 3)) for _ in range(60)]
    bad = ["stupid", "moron", "idiot"]
    out = []
    for i in range(n):
        words = list(random.choice(plain, 30))
        if i % 4 == 0:
            words.insert(int(random.integers(0, 30)), str(random.choice(bad)))
        out.append((" ".join(words) + ".", int(i % 4 == 0)))
    return out


def test_toxicity_tells_and_bears_gaps():
    rows = planted()
    model = toxicity.fit([t for t, _ in rows[:180]], [y for _, y in rows[:180]])
    scorer = toxicity.Scorer(model)
    scores = scorer.score([t for t, _ in rows[180:]])
    assert np.mean([(s >= 0.5) == y for s, (_, y) in zip(scores, rows[180:], strict=True)]) >= 0.95
    assert all(s >= 0.5 for s in scorer.score(["you i.d.i.o.t now", "so s t u p i d", "mor-on", "an idiiot"]))
    text = "on er th. you idiot. re in."
    a, b = scorer.worst_sentence(text)
    assert "idiot" in text[a:b]


def test_toxicity_query(spark, sf, docs):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, sf).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]) >= 0.8


def test_toxicity_awkward(spark, awkward):
    labels = spark.createDataFrame([(0, 1), (4, 0), (None, 1), (777, 1), (5, None)], "doc_id bigint, toxic int")
    for some in (labels, labels.limit(0)):
        rows = toxicity.score_documents(awkward, toxicity.learn(awkward, some)).collect()
        assert len(rows) == len(AWKWARD) + 2 and all(0 <= r.score <= 1 for r in rows)


# --- exact and line dedup


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        out |= {i: (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members}
    return out


@pytest.mark.parametrize("weak", [False, True])  # a digest with many clashes shows the comparison of bytes
def test_exact_groups_against_brute_force(docs, texts, weak):
    from pyspark.sql import functions as F

    extra = {"digest": lambda c: F.unhex(F.substring(F.md5(c.cast("binary")), 1, 2))} if weak else {}
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, **extra).collect()}
    assert found == brute_groups(texts.items())


def test_exact_groups_over_several_batches(docs, texts):
    """One file of key rows a batch, so that keys meet the state of earlier batches."""
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs.repartition(5), files=1).collect()}
    assert found == brute_groups(texts.items())


def test_exact_groups_awkward(awkward):
    rows = exact_dedup.exact_groups(awkward).collect()
    assert len(rows) == len(AWKWARD) + 2
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 5 and sum(r.kept for r in empty) == 1 and {r.keep_id for r in empty} == {3}
    assert exact_dedup.exact_groups(awkward.limit(0)).count() == 0
    assert exact_dedup.drop_exact_copies(awkward).columns == awkward.columns


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups_over_all_of_bigint(spark, weak):
    """Ties go to the least doc_id, the smallest bigint too; a missing one loses."""
    from pyspark.sql import functions as F

    least, most = -(1 << 63), (1 << 63) - 1
    df = spark.createDataFrame([(most, "a b"), (least, "b a"), (0, "ab "), (least, "a b"), (None, " ab"), (-1, "ba "), (None, "zz")], "doc_id bigint, text string")
    extra = {"digest": lambda c: F.lit(b"one")} if weak else {}
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df, **extra).collect()), key=str)
    assert found == sorted([(most, least, 4, False), (0, least, 4, False), (least, least, 4, True), (None, least, 4, False), (least, least, 2, True), (-1, least, 2, False), (None, None, 1, True)], key=str)


def brute_lines(rows):
    """Text without the lines of pairs that stand before, and how many lines went."""
    blank = " \t\n\r\x0b\x0c"
    cut = {}
    for i, t in rows:
        raw = [y for x in re.split(r"(?<=\n)|(?<=[.!?] )", t or "") for y in (re.split(r"(?<=, )", x) if len(x) > line_dedup.LONG else [x])]
        cut[i] = raw, [k for k, x in enumerate(raw) if x.strip(blank)]
    where = defaultdict(list)
    for i in sorted(cut):
        raw, filled = cut[i]
        for n, (a, b) in enumerate(zip(filled, filled[1:])):
            where[raw[a].strip(blank), raw[b].strip(blank)].append((i, n))
    again = {p for places in where.values() for p in places[1:]}
    broken = [places for places in where.values() if len(places) > 1 and {(places[0][0], places[0][1] + d) for d in (-1, 1)} & again]
    stay = {(i, n + d) for (i, n) in (places[1] for places in broken) for d in (0, 1)}
    out = {}
    for i, (raw, filled) in cut.items():
        gone = {filled[n + d] for n in range(len(filled) - 1) if (i, n) in again for d in (0, 1) if (i, n + d) not in stay}
        out[i] = "".join(x for k, x in enumerate(raw) if k not in gone), len(gone), len(filled)
    return out


@pytest.mark.parametrize("weak", [False, True])  # a hash with many clashes shows the comparison of bytes
def test_line_dedup_against_brute_force(docs, texts, weak):
    from pyspark.sql import functions as F

    extra = {"digest": lambda c: F.pmod(F.xxhash64(c), F.lit(997))} if weak else {}
    found = by_id(line_dedup.remove_repeated(docs, **extra))
    assert {i: (r.text or "", r.n_removed_lines, r.n_lines) for i, r in found.items()} == brute_lines(texts.items())


@pytest.mark.parametrize("weak", [False, True])
def test_line_dedup_ranks_pairs_that_stand_often_in_parts(spark, monkeypatch, weak):
    from pyspark.sql import functions as F

    rows = {i: "\n".join(["common one", "common two", f"own {i % 7}", f"more {i % 11}\t", "", f"own {i}"][i % 3 :]) for i in range(90, 0, -1)}
    df = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    monkeypatch.setattr(line_dedup, "hot_bound", lambda members: 3)
    extra = {"digest": lambda c: F.pmod(F.xxhash64(c), F.lit(13))} if weak else {}
    seen, settle = {}, line_dedup.settle
    monkeypatch.setattr(line_dedup, "settle", lambda t, name: (seen.__setitem__(name, settle(t, name)), seen[name])[1])
    found = by_id(line_dedup.remove_repeated(df, **extra))
    assert {i: (r.text, r.n_removed_lines, r.n_lines) for i, r in found.items()} == brute_lines(rows.items())
    assert weak or 0 < seen["lines-heads"].count() < seen["lines-ranked"].where("often").count()  # only heads of parts meet in one task


def pairs_of(text):
    """Neighbouring lines of a text."""
    blank = " \t\n\r\x0b\x0c"
    raw = [y for x in re.split(r"(?<=\n)|(?<=[.!?] )", text or "") for y in (re.split(r"(?<=, )", x) if len(x) > line_dedup.LONG else [x])]
    lines = [x.strip(blank) for x in raw if x.strip(blank)]
    return list(zip(lines, lines[1:]))


def test_line_dedup_leaves_every_passage_somewhere(spark, docs, texts):
    rows = [(1, "Alpha one.\nBravo two."), (2, "Alpha one.\nBravo two.\nCharlie three."), (3, "Bravo two.\nCharlie three.")]
    found = by_id(line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [found[i].text for i in (1, 2, 3)] == [rows[0][1], "Charlie three.", rows[2][1]]
    rows = [(1, "b\nc\n"), (2, "x\nb\nc\nd\ny\n"), (3, "c\nd\n"), (4, "c\nd\n"), (5, "a\na\na\na\na\n"), (6, "a\na\n")]
    found = by_id(line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [found[i].text for i in (2, 3, 4)] == ["x\nd\ny\n", "c\nd\n", ""]
    left = {p for r in line_dedup.remove_repeated(docs).collect() for p in pairs_of(r.text)}
    stood = Counter(p for t in texts.values() for p in pairs_of(t))
    assert {p for p, n in stood.items() if n > 1} <= left


def test_line_dedup(spark, awkward):
    passage = " ".join(f"Sentence {i} of the passage that stands in two places." for i in range(30))
    rows = [(1, f"Own start. {passage} Own end."), (2, f"Another\x01 beginning\x02A here.\n\n{passage}\n \nAnother end."), (3, "Nothing shared. At all."), (4, None)]
    found = by_id(line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert found[1].text == rows[0][1] and found[1].n_removed_lines == 0
    # the last sentence ends otherwise in either text, and isn't the same line with what follows
    assert found[2].text == "Another\x01 beginning\x02A here.\n\n \nAnother end." and found[2].n_removed_chunks == 1
    assert found[3].text == rows[2][1] and found[4].text is None and found[4].n_lines == 0
    out = line_dedup.remove_repeated(awkward)
    assert out.count() == len(AWKWARD) + 2 and out.columns[: len(awkward.columns)] == awkward.columns
    assert line_dedup.remove_repeated(awkward.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a.\nb.\n", "o1", "k", [3]), (2, "a.\nb.\n", "o2", "l", None)], "doc_id bigint, text string, id string, of string, lines array<int>")
    kept = by_id(line_dedup.remove_repeated(clash))
    assert (kept[1].id, kept[1].of, kept[1].lines, kept[2].id, kept[2].text) == ("o1", "k", [3], "o2", "")


def test_line_dedup_finds_passages_of_fifty_words(spark):
    """Passages of 50 to 100 words, between texts of other words: all of their lines go but in the first place."""
    random = np.random.default_rng(6)
    words = ["".join(random.choice(list("abcdefghij"), int(random.integers(2, 8)))) for _ in range(3000)]

    def prose(n):
        out = []
        while sum(len(s.split()) for s in out) < n:
            out.append(" ".join(random.choice(words, int(random.integers(4, 25)))).capitalize() + ".")
        return " ".join(out)

    passages = [prose(int(random.integers(50, 100))) for _ in range(60)]
    rows = [(k * 10 + j, f"{prose(120)}\n{p}\n{prose(120)}") for k, p in enumerate(passages) for j in range(3)]
    found = by_id(line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id bigint, text string")))
    for k, p in enumerate(passages):
        assert p in found[k * 10].text and all(found[k * 10 + j].text == dict(rows)[k * 10 + j].replace(p + "\n", "") for j in (1, 2))


# --- pipeline


def test_pipeline_stages(spark, sf, docs, tmp_path):
    import corpus_pipeline

    kept, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        texts = {r.doc_id: r.text or "" for r in kept.collect()}
        out = stage(spark, kept, sf)
        out.write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids
        if name == "exact dedup":
            assert left == {i for i, g in brute_groups(texts.items()).items() if g[2]}
        if name == "SimHash near-dedup":
            assert left == {i for i, c in brute_components({i: brute_fingerprint(t) for i, t in texts.items()}).items() if i == c}
        if name == "benchmark decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
            assert left == {i for i, t in texts.items() if not brute_hits(t, items)[1]}
        if name == "toxicity":
            assert sum(labels.get(i) == 0 for i in ids - left) <= 0.1 * sum(x == 0 for x in labels.values())
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        else:
            assert left == set(texts)
        kept, ids = out, left

"""The suffix sort against sorted bytes, and removal of repeated strings against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import queries, suffix_dedup, suffix_order


def brute(docs: dict[int, bytes], least: int) -> dict[int, list[tuple[int, int]]]:
    """Maximal removed runs of each text."""
    seen, gone = set(), {}
    for doc_id in sorted(docs):
        body, spans = docs[doc_id], []
        for at in range(len(body) - least + 1):
            window = body[at : at + least]
            if window in seen:
                if spans and at <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], at + least)
                else:
                    spans.append((at, at + least))
            seen.add(window)
        gone[doc_id] = spans
    return gone


def check(spark, docs: dict[int, str], least: int, **how) -> None:
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "doc_id bigint, text string, k string, h int").repartition(3)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table, least, **how).collect()}
    bodies = {i: (t or "").encode() for i, t in docs.items()}
    for i, spans in brute(bodies, least).items():
        assert [tuple(s) for s in got[i].spans] == spans, i
        assert got[i].n_bytes == len(bodies[i])
        assert bytes(got[i].kept) == b"".join(bodies[i][a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(bodies[i])], strict=True))


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=80), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 40), st.integers(0, 3)), max_size=40))
def test_suffix_order(body, wanted):
    body = bytes(b % 3 for b in body)
    wanted = sorted((w for w in wanted if w[0] <= len(body)), key=lambda w: w[2])
    begin, length, group = (np.array([w[i] for w in wanted], np.int64) for i in range(3))
    length = np.minimum(length, len(body) - begin)
    order, same = suffix_order.suffix_order(np.frombuffer(body, np.uint8), begin, length, group)
    texts = [body[b : b + n] for b, n in zip(begin, length, strict=True)]
    assert order.tolist() == sorted(range(len(texts)), key=lambda i: (group[i], texts[i]))
    for i in range(1, len(order)):
        a, b = texts[order[i - 1]], texts[order[i]]
        agree = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert same[i] == (agree if group[order[i]] == group[order[i - 1]] else 0)


def test_groups_across_runs(monkeypatch):
    """Groups of any size at any place are sorted by their hashes, not by the way out after a collision."""
    monkeypatch.setattr(suffix_order, "_by_bytes", None)
    pick = np.random.default_rng(2)
    data = pick.integers(97, 99, 3000, dtype=np.uint8)
    group = np.sort(np.concatenate([pick.integers(0, 400, 1500), np.full(300, 17)]))
    begin = pick.integers(0, 2900, len(group))
    order, _ = suffix_order.suffix_order(data, begin, np.full(len(group), 60), group)
    assert order.tolist() == sorted(range(len(group)), key=lambda i: (group[i], data[begin[i] : begin[i] + 60].tobytes()))


def test_collisions_are_found(monkeypatch):
    """With hashes that always collide the order still is that of the bytes."""
    monkeypatch.setattr(suffix_order, "_VALUE", np.zeros(256, np.uint64))
    body = b"abcabcabdabcx"
    begin = np.arange(len(body))
    order, _ = suffix_order.suffix_order(np.frombuffer(body, np.uint8), begin, len(body) - begin, np.zeros(len(body), np.int64))
    assert order.tolist() == sorted(range(len(body)), key=lambda i: body[i:])


def planted(seed: int, n: int) -> dict[int, str]:
    """Texts over few words with passages that several share, copies, near copies and overlaps."""
    pick = random.Random(seed)
    words = ["alpha", "beta", "gamma", "δέλτα", "eps", "漢字", "zeta-eta", "theta"]
    text = lambda k: " ".join(pick.choice(words) for _ in range(k))
    passages = [text(12) for _ in range(6)]
    docs = {}
    for i in range(n):
        docs[i * 3] = " ".join(pick.choice([pick.choice(passages), text(pick.randrange(1, 9))]) for _ in range(pick.randrange(0, 8)))
        if pick.random() < 0.2 and i:
            docs[i * 3] = docs[pick.randrange(i) * 3]
        elif pick.random() < 0.1 and i:
            other = docs[pick.randrange(i) * 3]
            docs[i * 3] = other[: len(other) // 2] + "#" + other[len(other) // 2 :]
    return docs


@pytest.mark.parametrize(("least", "piece"), [(30, 256), (30, 2), (12, 1)])  # whole groups, and groups dealt in pieces
def test_remove_repeats(spark, least, piece):
    check(spark, planted(least, 60), least, piece=piece)


def test_periodic_and_long(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 300)  # texts over a block
    check(spark, {1: "ab" * 400, 2: "x" * 1000, 5: "x" * 99 + "y" * 101, 7: "ab" * 60 + "x" * 130, 9: "", 10: None, 11: "é" * 700}, 100)


def test_long_text(spark):
    pick = random.Random(3)
    body = "".join(pick.choice("abcdefgh ") for _ in range(1_300_000))
    check(spark, {1: body, 2: body[1_000_000:1_200_000], 3: "q" + body[500:1500]}, 100)


def test_awkward(spark):
    same = "the same line of text, over and over; " * 4
    table = spark.createDataFrame([(None, same, 1), (4, same, 2), (4, same, 2), (7, None, 3), (8, "", 3), (9, "short", 4)], "doc_id bigint, text string, spans int")
    got = [(r.doc_id, r.n_bytes, len(r.spans), len(r.kept)) for r in suffix_dedup.remove_repeats(table).collect()]
    n = len(same)
    inner = brute({1: same.encode()}, 100)[1]
    rest = n - sum(b - a for a, b in inner)
    assert sorted(got, key=str) == sorted([(None, n, 1, rest), (4, n, 1, 0), (4, n, 1, 0), (7, 0, 0, 0), (8, 0, 0, 0), (9, 5, 0, 5)], key=str)
    assert suffix_dedup.remove_repeats(table.limit(0)).collect() == []


def test_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    expect = brute(docs, 100)
    got = {r.doc_id: r for r in queries.op13_suffix_dedup(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, spans in expect.items():
        kept = b"".join(docs[i][a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(docs[i])], strict=True))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(docs[i]), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())


def test_a_frequent_gram_gives_rows_in_proportion(spark, monkeypatch):
    """Hundreds of different segments about one passage of 60 bytes are sorted in one go: rows for what is removed, none for each window."""
    made = {}

    def counted(df, purpose):
        out = settle(df, purpose)
        made[purpose] = out.count()
        return out

    settle = suffix_dedup.settle
    monkeypatch.setattr(suffix_dedup, "settle", counted)
    draw = random.Random(5)
    letters = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = letters(60)
    docs = [(i, letters(90) + common + letters(90)) for i in range(600)]
    docs += [(600 + i, docs[i][1][40:200]) for i in range(20)]  # strings of 160 bytes that stand elsewhere before
    spans = suffix_dedup.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id for r in spans.collect()} == set(range(600, 620))
    assert made["suffix-sorted"] <= 200

"""The Merkle manifest against plain trees."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from quantloom.llm import merkle, queries


def h(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(row: tuple) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The root, and each leaf's siblings level by level."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for at in run:
                for i in under[at]:
                    paths[i].append(([nodes[j] for j in run if j < at], [nodes[j] for j in run if j > at]))
        nodes, under = [h(*[nodes[j] for j in run]) for run in runs], [[i for j in run for i in under[j]] for run in runs]
    return nodes[0], paths


def brute(rows: list[tuple]) -> list[tuple]:
    """``rows``: doc_id, source, lang, n_chars, text."""
    sources: dict = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in sources[s]]) for s in names}
    root, over = tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, over, strict=True):
        for r, path in zip(sources[s], trees[s][1], strict=True):
            path = path + above
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf((*r[:4], text))
            for left, right in path:
                folded = h(*left, folded, *right)
            out.append((r[0], leaf(r), trees[s][0], root, h(*[x for left, right in path for x in left + right]), folded, folded == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def got(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_sweeps(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    root, paths = tree([x.hex() for x in leaves])
    levels = merkle.height(n)
    nodes = merkle.forward(leaves, levels)
    assert nodes[levels, 0].hex() == root
    seen = dict(merkle.backward(nodes, n, levels, []))
    for i in range(n):
        assert [([a.hex() for a in left], [b.hex() for b in right]) for left, right in seen[i]] == paths[i]
        assert merkle.fold(leaves[i], seen[i]).hex() == root and merkle.unpack(merkle.pack(seen[i])) == seen[i]


@pytest.mark.parametrize("band", [1, 2, 7])
def test_manifest(spark, band):
    rows = [(i, f"s{i % 7 if i % 2 else 0}", None if i % 5 == 0 else "en", i, f"line {i}\nnext\n" if i % 3 else "plain") for i in range(150)]
    rows += [(i, f"own {i}", "de", None, "") for i in range(500, 540)]  # many sources of one row
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(merkle.manifest(df, merkle.without_line_feeds(df), band)) == brute(rows)


def test_awkward(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, "a\nb"), (1, None, "é", 3, "漢\n字"), (1, "", "", 0, ""), (1, "é", "x", 1, "\n" * 1000), (2, "z", "x", 1, "long " * 50_000 + "\n"), (2, "z", "x", 1, "other\n")]
    rows += [(3, "z", "x", 1, "same\n")] * 4 + [(-(2**63), "z", "x", 1, "first\n")]
    df = spark.createDataFrame([(*r, "more", 1, 2) for r in rows], SCHEMA + ", tree string, at int, n int")
    assert got(merkle.manifest(df, merkle.without_line_feeds(df))) == brute(rows)
    assert got(merkle.manifest(df.limit(0), merkle.without_line_feeds(df))) == []
    assert all(r.verified for r in merkle.manifest(df).collect())


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    expect = brute(rows)
    assert got(queries.op11_merkle(spark, sf)) == expect
    assert 0 < sum(not r[-1] for r in expect) < len(expect)

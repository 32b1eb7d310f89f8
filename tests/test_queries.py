"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from quantloom import registry

NAMES = sorted(registry.oracle_sql())


def flat(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5) + 0.0
        df[c] = df[c].astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None"})
    return sorted(map(tuple, df.to_numpy()))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in os.listdir(sf):
        con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{sf}/{p}'")
    return con


def test_every_query_has_sql():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, sf, duck, name):
    ours, theirs = registry.queries()[name](spark, sf).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert flat(ours) == flat(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_rest_stands_without_text_operators():
    """The engine doesn't import the text operators."""
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", f.read_text(), re.M), f

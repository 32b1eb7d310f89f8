"""Queries by iterating estimators and by streams. SQL can't express the estimators and the gate; tests hold
them against planted data, the gate and the unit root also against plain loops. The bars of the stream have SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import kernels as k
from ..sources.files import shared
from ..sources.panels import weekly_bars, weekly_returns
from ..streaming import intraday
from .time_series import rounded


def _on_returns(f):
    return lambda s, d: rounded(f(weekly_returns(weekly_bars(s, d))))


def _ready(s: SparkSession) -> None:
    """Sets a checkpoint folder where none is set in local mode, as in tests."""
    shared(s, "streams")


def _stream_bars(s: SparkSession, d: str):
    _ready(s)
    found = intraday.drain(intraday.bars(intraday.events_stream(s, f"{d}/events.parquet")), ["event_type", "start"])
    return rounded(found.withColumn("start", F.col("start").cast("timestamp_ntz")))


def _stream_gate(s: SparkSession, d: str):
    _ready(s)
    return intraday.drain(intraday.persistence(intraday.events_stream(s, f"{d}/events.parquet")), ["user_id"])


QUERIES = {
    "regime_hmm": _on_returns(k.regimes),
    "garch11": _on_returns(k.garch),
    "kalman_local_level": _on_returns(k.local_level),
    "block_bootstrap_ci": _on_returns(k.block_bootstrap),
    "variance_change_points": _on_returns(k.change_points),
    "unit_root_adf": lambda s, d: rounded(k.unit_root(weekly_bars(s, d))),
    "stream_bars": _stream_bars,
    "stream_persistence_gate": _stream_gate,
}
ORACLE_SQL = {
    "stream_bars": "SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS n, round(sum(value), 6) AS total, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events GROUP BY ALL",
}

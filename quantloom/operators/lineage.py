"""The most probable path through hidden states, for series of any length.

A series is cut into spans of time. Over a span, the best score from each state before it to each state at its end is a matrix, and
matrices are joined by taking the best over the state between; so spans are scored apart, only their matrices meet in a
series, and each span is then decoded on its own between the states it is entered from and left in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _scores(like: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best score from each state before the span (row) to each at its end (column)."""
    best = move + like[0]
    for x in like[1:]:
        best = (best[:, :, None] + move[None]).max(axis=1) + x
    return best


def _decode(like: np.ndarray, move: np.ndarray, entry: np.ndarray, last: int) -> list[int]:
    """The best path from ``entry`` (scores of the first step's states without its likelihood) to the state ``last``; the lower of equal states."""
    best, back = entry + like[0], []
    for x in like[1:]:
        ways = best[:, None] + move
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + x
    path = [last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def viterbi(obs: DataFrame, key: str, at: str, likes: list[str], start: list[float], move: list[list[float]], span: str = "year") -> DataFrame:
    """``key, at, state, best``: for each row the state (from 0) on the path of highest probability, and the path's log probability. ``likes``:
    the columns of log likelihoods of each state; ``start`` and ``move``: log probabilities. ``span`` is the unit of time that a series is
    cut by. Rows without a key, time or one of the likelihoods are left out; of rows that share a time the order is that of
    their likelihoods. Where paths are equally probable one of them is given."""
    k, start_, move_ = len(likes), np.array(start, float), np.array(move, float)
    rows = obs.dropna(subset=[key, at, *likes]).select(key, at, F.array(*(F.col(c).cast("double") for c in likes)).alias("like")).withColumn("span", F.date_trunc(span, at))
    kind = dict(rows.dtypes)
    ordered = lambda g: g.assign(_l=g["like"].map(tuple)).sort_values([at, "_l"])
    matrix = lambda g: np.array(g["like"].tolist(), float)

    def score(g: pd.DataFrame) -> pd.DataFrame:
        g = ordered(g)
        return pd.DataFrame([{key: g[key].iloc[0], "span": g["span"].iloc[0], "scores": _scores(matrix(g), move_).ravel().tolist(), "opening": _scores_from(matrix(g), start_, move_).tolist()}])

    spans = rows.groupBy(key, "span").applyInPandas(score, f"{key} {kind[key]}, span timestamp, scores array<double>, opening array<double>")

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        """The states in which the best path leaves each span: one small row a span of the series."""
        g = g.sort_values("span")
        best, back = np.array(g["opening"].iloc[0]), []
        for flat in g["scores"].iloc[1:]:
            ways = best[:, None] + np.array(flat).reshape(k, k)
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0)
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = path[::-1]
        return pd.DataFrame({key: g[key].to_numpy(), "span": g["span"].to_numpy(), "before": [-1, *path[:-1]], "last": path, "best": float(best.max())})

    ends = spans.groupBy(key).applyInPandas(chain, f"{key} {kind[key]}, span timestamp, before int, last int, best double")

    def decode(g: pd.DataFrame) -> pd.DataFrame:
        g = ordered(g)
        before, last = int(g["before"].iloc[0]), int(g["last"].iloc[0])
        return pd.DataFrame({key: g[key].to_numpy(), at: g[at].to_numpy(), "state": _decode(matrix(g), move_, start_ if before < 0 else move_[before], last), "best": g["best"].to_numpy()})

    return rows.join(ends, [key, "span"]).groupBy(key, "span").applyInPandas(decode, f"{key} {kind[key]}, {at} {kind[at]}, state int, best double")


def _scores_from(like: np.ndarray, entry: np.ndarray, move: np.ndarray) -> np.ndarray:
    best = entry + like[0]
    for x in like[1:]:
        best = (best[:, None] + move).max(axis=0) + x
    return best

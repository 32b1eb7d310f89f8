"""Estimators that iterate: each asset's own short series in one pandas call, spread by asset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _per_asset(ret: DataFrame, kernel, schema: str) -> DataFrame:
    return ret.where("lr is not null").select("ticker", "wk", "lr").groupBy("ticker").applyInPandas(lambda g: kernel(g.sort_values("wk")), schema)


def regimes(ret: DataFrame, rounds: int = 40) -> DataFrame:
    """Two-state Gaussian hidden Markov model of each asset's returns: Baum-Welch from the split at the median size, states
    ordered by variance; the chance of the volatile state in the last week, and whether it is stress (variance at least 1.8
    times the calm one's, chance at least .55). Under 80 returns: nulls."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x = g["lr"].to_numpy()
        row = {"ticker": g["ticker"].iloc[0], "n": len(x), "var_calm": None, "var_wild": None, "p_wild": None, "stress": None}
        if len(x) < 80:
            return pd.DataFrame([row])
        big = np.abs(x - x.mean()) > np.median(np.abs(x - x.mean()))
        mean, var = np.array([x[~big].mean(), x[big].mean()]), np.array([x[~big].var(), x[big].var()]) + 1e-12
        start, move = np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]])
        for _ in range(rounds):
            like = np.exp(-((x[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var) + 1e-300
            a, scale = np.empty_like(like), np.empty(len(x))
            for t in range(len(x)):
                p = (start if t == 0 else a[t - 1] @ move) * like[t]
                scale[t] = p.sum()
                a[t] = p / scale[t]
            b, moves = np.ones(2), np.zeros((2, 2))
            post = np.empty_like(like)
            for t in range(len(x) - 1, -1, -1):
                post[t] = a[t] * b
                if t:
                    ahead = like[t] * b / scale[t]
                    moves += move * np.outer(a[t - 1], ahead)
                    b = move @ ahead
            post /= post.sum(axis=1, keepdims=True)
            weight = post.sum(axis=0)
            mean = (post * x[:, None]).sum(axis=0) / weight
            var = (post * (x[:, None] - mean) ** 2).sum(axis=0) / weight + 1e-12
            start, move = post[0], moves / moves.sum(axis=1, keepdims=True)
        calm, wild = np.argsort(var)
        row |= {"var_calm": float(var[calm]), "var_wild": float(var[wild]), "p_wild": float(post[-1, wild]), "stress": bool(var[wild] >= 1.8 * var[calm] and post[-1, wild] >= 0.55)}
        return pd.DataFrame([row])

    return _per_asset(ret, fit, "ticker string, n long, var_calm double, var_wild double, p_wild double, stress boolean")


def garch(ret: DataFrame) -> DataFrame:
    """GARCH(1,1) by quasi-likelihood over a grid of alpha and beta with the variance targeted, and the next variance."""
    grid = [(a, b) for a in np.arange(0.02, 0.31, 0.02) for b in np.arange(0.5, 0.97, 0.02) if a + b < 0.999]

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x = g["lr"].to_numpy() - g["lr"].mean()
        v = x.var() + 1e-18
        a, b = np.array(grid).T
        h, loss = np.full(len(a), v), np.zeros(len(a))
        for e in x:
            loss += np.log(h) + e * e / h
            h = v * (1 - a - b) + a * e * e + b * h
        best = int(np.argmin(loss))
        return pd.DataFrame([{"ticker": g["ticker"].iloc[0], "alpha": float(a[best]), "beta": float(b[best]), "next_var": float(h[best]), "n": len(x)}])

    return _per_asset(ret, fit, "ticker string, alpha double, beta double, next_var double, n long")


def local_level(ret: DataFrame, q: float = 1e-4, r: float = 1e-3) -> DataFrame:
    """The local-level filter's last level, its variance and the innovations' spread."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x, level, p, miss = g["lr"].to_numpy(), 0.0, 1.0, []
        for y in x:
            p += q
            k = p / (p + r)
            miss.append(y - level)
            level, p = level + k * miss[-1], (1 - k) * p
        return pd.DataFrame([{"ticker": g["ticker"].iloc[0], "level": level, "variance": p, "innovation_sd": float(np.std(miss, ddof=1)) if len(miss) > 1 else None}])

    return _per_asset(ret, fit, "ticker string, level double, variance double, innovation_sd double")


def block_bootstrap(ret: DataFrame, block: int = 5, draws: int = 500, seed: int = 12345) -> DataFrame:
    """Circular block-bootstrap interval of each asset's mean return at 90 percent."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x, random = g["lr"].to_numpy(), np.random.default_rng(seed)
        starts = random.integers(0, len(x), (draws, -(-len(x) // block)))
        at = ((starts[:, :, None] + np.arange(block)) % len(x)).reshape(draws, -1)[:, : len(x)]
        means = np.sort(x[at].mean(axis=1))
        return pd.DataFrame([{"ticker": g["ticker"].iloc[0], "mean": float(x.mean()), "low": float(means[int(0.05 * draws)]), "high": float(means[int(0.95 * draws) - 1])}])

    return _per_asset(ret, fit, "ticker string, mean double, low double, high double")


def change_points(ret: DataFrame, critical: float = 1.358, least: int = 10) -> DataFrame:
    """Weeks at which the variance changes: the greatest centred cumulative sum of squares, again on both sides."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x, wk, found, todo = g["lr"].to_numpy(), g["wk"].to_numpy(), [], [(0, len(g))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < 2 * least:
                continue
            c = np.cumsum(np.square(x[lo:hi] - x[lo:hi].mean()))
            d = np.abs(c / c[-1] - np.arange(1, hi - lo + 1) / (hi - lo)) if c[-1] > 0 else np.zeros(hi - lo)
            k = int(np.argmax(d[least : hi - lo - least])) + least if hi - lo > 2 * least else 0
            if k and np.sqrt((hi - lo) / 2) * d[k] > critical:
                found.append(lo + k + 1)
                todo += [(lo, lo + k + 1), (lo + k + 1, hi)]
        return pd.DataFrame([{"ticker": g["ticker"].iloc[0], "wk": wk[min(k, len(x) - 1)], "place": k} for k in sorted(found)], columns=["ticker", "wk", "place"])

    return _per_asset(ret, fit, "ticker string, wk date, place long")


#: Response surface of the 5 % point of the unit-root statistic with a constant (MacKinnon).
UNIT_ROOT_5 = (-2.86154, -2.8903, -4.234)


def unit_root(bars: DataFrame, least: int = 25) -> DataFrame:
    """Augmented Dickey-Fuller statistic of each asset's log close with a constant, the number of lagged changes (smallest AIC;
    all candidates are fitted on the same weeks), its 5 % point and whether a unit root is rejected. Series under ``least`` weeks
    or without variation: nulls. Closes that are null or not positive don't count."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("wk")["x"].to_numpy()
        row = {"ticker": g["ticker"].iloc[0], "n": len(x), "lags": None, "stat": None, "cut": None, "rejects": None}
        change = np.diff(x)
        most = min(int(12 * (len(x) / 100) ** 0.25), (len(change) - 2) // 2)
        rows = len(change) - most - 1
        if len(x) < least or rows < 10:
            return pd.DataFrame([row])
        y = change[most + 1 :]
        full = np.column_stack([np.ones(rows), x[most + 1 : -1], *(change[most + 1 - k : -k] for k in range(1, most + 1))])
        best = np.inf
        for lags in range(most + 1):
            q, r = np.linalg.qr(full[:, : lags + 2])
            if np.abs(np.diag(r)).min() <= 1e-10 * np.abs(np.diag(r)).max() or rows <= lags + 2:
                continue
            slope = np.linalg.solve(r, q.T @ y)
            sse = float(((y - full[:, : lags + 2] @ slope) ** 2).sum())
            aic = rows * np.log(sse / rows + 1e-300) + 2 * (lags + 2)
            if aic < best:
                best, error = aic, np.sqrt(sse / (rows - lags - 2) * (np.linalg.inv(r)[1] ** 2).sum())
                row |= {"lags": lags, "stat": float(slope[1] / error) if error > 0 else 0.0}
        if row["stat"] is not None:
            row["cut"] = sum(c / rows**i for i, c in enumerate(UNIT_ROOT_5))
            row["rejects"] = row["stat"] < row["cut"]
        return pd.DataFrame([row])

    logs = bars.where("c > 0").selectExpr("ticker", "wk", "ln(c) as x")
    return logs.groupBy("ticker").applyInPandas(fit, "ticker string, n long, lags long, stat double, cut double, rejects boolean")

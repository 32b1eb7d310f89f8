"""A ledger of forecasts as a stream: keyed state, a timer for each maturity, and the alarm on calibration that follows it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.stats import ERF, ERF_P
from ..operators.monitoring import BETS, CAP, KILL, LEAST, SHARE, WARN

#: What the alarm keeps of each bet: sum and sum of squares of what was seen, wealth up and down, the most it was worth.
_FRESH = (0.0, 0.0, 1.0, 1.0, 1.0)
_OUT = "key string, origin long, matures long, y double, residual double, z double, side string, covered boolean, interval_score double, place long, evidence double, evidence_max double, level string"


def _phi(x: float) -> float:
    """``functions.stats.phi`` of a number."""
    t = 1 / (1 + ERF_P * abs(x) / math.sqrt(2))
    poly = 0.0
    for a in reversed(ERF):
        poly = (poly + a) * t
    return 0.5 * (1 + math.copysign(1 - poly * math.exp(-x * x / 2), x))


def _bet(state: tuple, name: str, x: float, n: int) -> tuple:
    """One bet after a further value, its stake set by the ``n`` values before."""
    s, q, up, down, most = state
    m, low, high = BETS[name]
    dev = max(m - low, high - m)
    mu = (m + s) / (1 + n)
    var = max((dev * dev / 3 + q - 2 * mu * s + n * mu * mu) / (1 + n), 1e-12)
    step = min(abs((mu - m) / var), SHARE / dev) * (x - m)
    up, down = min(up * (1 + step), CAP), min(down * (1 - step), CAP)
    return s + x, q + x * x, up, down, max(most, (up + down) / 2)


class _Ledger(StatefulProcessor):
    """State of one key: open forecasts by maturity, due ones whose outcome isn't known, outcomes that came first, the alarm."""

    def __init__(self, alpha: float) -> None:
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "matures long", "origin array<long>, mu array<double>, sigma array<double>, lower array<double>, upper array<double>")
        self.due = handle.getMapState("due", "matures long, origin long", "mu double, sigma double, lower double, upper double")
        self.known = handle.getMapState("known", "matures long, origin long", "y double")
        self.alarm = handle.getValueState("alarm", "n long, location array<double>, dispersion array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            told = frame[frame["y"].notna()].groupby(["matures", "origin"])["y"].min()
            late = []
            for (matures, origin), y in told.items():
                at = (int(matures), int(origin))
                if self.due.containsKey(at):
                    late.append((*at, *self.due.getValue(at), float(y)))
                    self.due.removeKey(at)
                else:
                    self.known.updateValue(at, (min(float(y), self.known.getValue(at)[0]) if self.known.containsKey(at) else float(y),))
            if late:
                yield self._settle(key, sorted(late))
            for matures, part in frame[frame["y"].isna() & frame["mu"].notna()].groupby("matures"):
                at = (int(matures),)
                held = dict(zip(*self._held(at), strict=True)) if self.open.containsKey(at) else {}
                held |= {int(o): tuple(map(float, v)) for o, *v in part[["origin", "mu", "sigma", "lower", "upper"]].itertuples(index=False)}
                self.open.updateValue(at, (list(held), *map(list, zip(*held.values(), strict=True))))
                self.handle.registerTimer(at[0] - 1)  # a timer fires once the watermark is past it, so at the maturity itself

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs() + 1,)
        if not self.open.containsKey(at):
            return
        ripe = []
        for origin, values in sorted(zip(*self._held(at), strict=True)):
            place = (*at, origin)
            if self.known.containsKey(place):
                ripe.append((*place, *values, self.known.getValue(place)[0]))
                self.known.removeKey(place)
            else:
                self.due.updateValue(place, values)
        self.open.removeKey(at)
        if ripe:
            yield self._settle(key, ripe)

    def _held(self, at: tuple) -> tuple[list, list]:
        origins, *values = self.open.getValue(at)
        return list(origins), list(zip(*values, strict=True))

    def _settle(self, key: tuple, ripe: list[tuple]) -> pd.DataFrame:
        n, bets = 0, {name: _FRESH for name in BETS}
        if self.alarm.exists():
            n, *kept = self.alarm.get()
            bets = {name: tuple(k) for name, k in zip(BETS, kept, strict=True)}
        out = []
        for matures, origin, mu, sigma, lower, upper, y in ripe:
            z = (y - mu) / max(sigma, 1e-12)
            u = _phi(z)
            bets = {name: _bet(bet, name, u if name == "location" else abs(u - 0.5), n) for name, bet in bets.items()}
            n += 1
            now, most = sum(b[2] + b[3] for b in bets.values()) / 4, sum(b[4] for b in bets.values()) / 2
            level = None if n < LEAST else "kill" if most >= KILL else "warn" if most >= WARN else "ok"
            side = "lower_miss" if y < lower else "upper_miss" if y > upper else "inside"
            score = upper - lower + 2 / self.alpha * (max(lower - y, 0.0) + max(y - upper, 0.0))
            out.append((key[0], origin, matures, y, y - mu, z, side, side == "inside", score, n, math.log10(max(now, 1e-300)), math.log10(most), level))
        self.alarm.update((n, *map(list, bets.values())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, late: str, alpha: float = 0.10) -> DataFrame:
    """A row for each forecast once it has matured: ``key, origin, matures, y, residual, z, side, covered, interval_score``, its ``place`` among the key's
    matured ones, and the evidence against calibration up to it (``evidence, evidence_max``: decimal logarithms of the alarm's wealth and of
    the most it was worth; ``level``, null for the first ``LEAST - 1``).

    ``events`` is a stream with ``ts`` (when a row is told), ``key`` (string), ``origin, matures`` (timestamps; together they name a forecast of the key),
    ``mu, sigma, lower, upper`` of a forecast or ``y`` of an outcome. A forecast matures when the watermark (``late`` behind the latest
    ``ts``) reaches ``matures`` and its outcome is known, be it told before or behind; nothing shows before. The alarm takes forecasts in order of maturity,
    those whose outcome came late when it comes. Told again before it matures, a forecast replaces itself, and of outcomes the least counts. Rows without key, origin or
    maturity, and forecasts with a missing number, take no part. State is a row for each open forecast and each outcome not yet met, in RocksDB; an
    outcome without forecast stays there. Nothing of a key is held in memory but one maturity's forecasts and one Arrow batch.
    """
    millis = lambda c: F.unix_millis(F.col(c)).alias(c)
    whole = F.col("y").isNotNull() | (F.col("mu") + F.col("sigma") + F.col("lower") + F.col("upper")).isNotNull()
    rows = events.withWatermark("ts", late).where(F.col("key").isNotNull() & F.col("origin").isNotNull() & F.col("matures").isNotNull() & whole)
    rows = rows.select("ts", F.col("key").cast("string").alias("key"), millis("origin"), millis("matures"), *(F.col(c).cast("double").alias(c) for c in ("mu", "sigma", "lower", "upper", "y")))
    out = rows.groupBy("key").transformWithStateInPandas(_Ledger(alpha), _OUT, "append", "eventTime")
    return out.withColumns({c: F.timestamp_millis(c) for c in ("origin", "matures")})

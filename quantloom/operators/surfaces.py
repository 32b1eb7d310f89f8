"""Options with early exercise, slices of the volatility surface, and the density that prices imply."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import phi, ratio


def _european(s: Column, k: Column, t: Column, r: Column, v: Column, q: Column, call: Column) -> Column:
    d1 = (F.ln(s / k) + (r - q + v * v / 2) * t) / (v * F.sqrt(t))
    d2, fade, carry = d1 - v * F.sqrt(t), F.exp(-r * t), F.exp(-q * t)
    return F.when(call, s * carry * phi(d1) - k * fade * phi(d2)).otherwise(k * fade * phi(-d2) - s * carry * phi(-d1))


def binomial(contracts: DataFrame, steps: int = 400, american: bool = True) -> DataFrame:
    """``contracts`` (``s, k, t, r, sigma, q, kind`` and more) with ``price``: backward induction over a lattice of ``steps`` steps, each a
    shorter array of values, with early exercise.

    Without price, strike, time or spread the price is the discounted intrinsic value; where the lattice has no
    probability (a spread too small for its drift), it is the European formula's. Missing inputs give null. Equal
    contracts are priced once.
    """
    terms = ["s", "k", "t", "r", "sigma", "q", "kind"]
    once = contracts.select(*terms).distinct()
    s, k, t, r, v, q = (F.col(c) for c in terms[:-1])
    call = F.upper(F.substring("kind", 1, 1)) == "C"
    live = (s > 0) & (k > 0) & (t > 0) & (v > 0)
    once = once.withColumn("_u", F.when(live, F.exp(v * F.sqrt(t / steps))))
    once = once.withColumns({"_p": ratio(F.exp((r - q) * t / steps) - 1 / F.col("_u"), F.col("_u") - 1 / F.col("_u")), "_fade": F.exp(-r * t / steps), "_side": F.when(call, 1.0).otherwise(-1.0)})
    u, p, fade, side = (F.col(c) for c in ("_u", "_p", "_fade", "_side"))
    gain = lambda ups, n: side * (s * F.pow(u, 2.0 * ups - n) - k)  # noqa: E731  with `ups` of `n` steps up
    last = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda j: F.greatest(gain(j, F.lit(steps)), F.lit(0.0)))

    def back(values: Column, i: Column) -> Column:
        n = steps - i
        held = lambda j: fade * (p * F.element_at(values, j + 2) + (1 - p) * F.element_at(values, j + 1))
        return F.transform(F.sequence(F.lit(0), n), lambda j: F.greatest(held(j), gain(j, n)) if american else held(j))

    tree = F.element_at(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), last, back), 1)
    intrinsic = F.greatest(side * (s * F.exp(-q * F.greatest(t, F.lit(0.0))) - k * F.exp(-r * F.greatest(t, F.lit(0.0)))), F.lit(0.0))
    price = F.when(live & (p > 0) & (p < 1), tree).when(live, _european(s, k, t, r, v, q, call)).when(~live, intrinsic)
    return contracts.join(once.select(*(F.col(c).alias(f"_{c}_") for c in terms), price.alias("price")), [F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in terms]).drop(*(f"_{c}_" for c in terms))


def implied_density(calls: DataFrame, by: list[str]) -> DataFrame:
    """``calls``: ``by, k, t, r, price``. For each slice and inner strike the second difference of the call price over strikes,
    carried forward: ``raw`` as it is, ``density`` cut at zero and scaled to an area of one; and of the slice the ``negative`` share of the
    raw mass and the number of ``violations`` of convexity. Slices of fewer than three strikes have no rows; of equal
    strikes the mean price counts."""
    w = Window.partitionBy(*by).orderBy("k")
    c = calls.where("k is not null and price is not null").groupBy(*by, "k").agg(F.avg("price").alias("c"), F.max(F.exp(F.col("r") * F.col("t"))).alias("_grow"))
    c = c.withColumns({"h1": F.col("k") - F.lag("k").over(w), "h2": F.lead("k").over(w) - F.col("k"), "c1": F.lag("c").over(w), "c2": F.lead("c").over(w)}).where("h1 is not null and h2 is not null")
    second = 2 * (F.col("c1") / (F.col("h1") * (F.col("h1") + F.col("h2"))) - F.col("c") / (F.col("h1") * F.col("h2")) + F.col("c2") / (F.col("h2") * (F.col("h1") + F.col("h2"))))
    c = c.withColumn("raw", F.col("_grow") * second)
    cut, whole = F.greatest("raw", F.lit(0.0)), Window.partitionBy(*by)
    c = c.withColumn("piece", (F.lead("k").over(w) - F.col("k")) * (cut + F.lead(cut).over(w)) / 2)
    area = F.sum("piece").over(whole)
    lost = F.round(F.coalesce(ratio(F.sum(F.greatest(-F.col("raw"), F.lit(0.0))).over(whole), F.sum(F.abs("raw")).over(whole)), F.lit(0.0)), 4)
    return c.select(*by, "k", "raw", F.when(area > 0, cut / area).otherwise(cut).alias("density"), lost.alias("negative"), F.sum((F.col("raw") < 0).cast("int")).over(whole).alias("violations"))


# --- A slice's total variance as a hyperbola: w(x) = a + b (rho (x - m) + sqrt((x - m)^2 + s^2))

_SLICE = "n int, a double, b double, rho double, m double, s double, rmse double, atm_vol double, skew double, curvature double, butterfly_free boolean"


def slice_variance(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    a, b, rho, m, s = p
    return a + b * (rho * (x - m) + np.sqrt((x - m) ** 2 + s * s))


def _free(z: np.ndarray) -> np.ndarray:
    """Parameters within their bounds (b and s positive, rho within one) from numbers without any."""
    return np.array([z[0], np.exp(z[1]), np.tanh(z[2]), z[3], np.exp(z[4])])


def fit_slice(x: np.ndarray, w: np.ndarray, weight: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Damped least squares from a few starts; the best of them."""
    root, best = np.sqrt(weight), (np.inf, None)
    for rho, m, s in ((-0.3, 0.0, 0.1), (0.3, 0.0, 0.1), (0.0, float(np.mean(x)), 0.5), (-0.6, float(x[np.argmin(w)]), 0.05)):
        z = np.array([max(float(w.min()) * 0.5, 1e-4), np.log(0.1), np.arctanh(rho), m, np.log(s)])
        miss = lambda z: root * (slice_variance(x, _free(z)) - w)
        damp, e = 1e-3, miss(z)
        for _ in range(rounds):
            step = 1e-6 * (1 + np.abs(z))
            jac = np.column_stack([(miss(z + d) - miss(z - d)) / (2 * d.max()) for d in np.diag(step)])
            square = jac.T @ jac
            move = np.linalg.lstsq(square + damp * (np.diag(np.diag(square)) + 1e-12 * np.eye(5)), -jac.T @ e, rcond=None)[0]
            new = miss(z + move)
            if np.isfinite(new).all() and new @ new < e @ e:
                done = e @ e - new @ new < 1e-16 * (1 + e @ e)
                z, e, damp = z + move, new, max(damp / 5, 1e-12)
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        if e @ e < best[0]:
            best = (float(e @ e), _free(z))
    return best[1]


def calibrate_slices(quotes: DataFrame, by: list[str]) -> DataFrame:
    """``quotes``: ``by, x`` (log of strike over forward), ``w`` (total variance), ``t``. Each slice's hyperbola with its error, level,
    skew and curvature at the money, and whether butterflies are free of arbitrage over two units of log strike. Quotes are first
    put together by log strike (their mean, weighted by their number), so a slice in one task has one row a strike.
    Slices of fewer than five strikes have null parameters; missing quotes don't count."""
    one = quotes.where("x is not null and w is not null").groupBy(*by, "x").agg(F.avg("w").alias("w"), F.count(F.lit(1)).alias("n"), F.max("t").alias("_t"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        row = {c: g[c].iloc[0] for c in by} | {"n": len(g)} | dict.fromkeys(["a", "b", "rho", "m", "s", "rmse", "atm_vol", "skew", "curvature", "butterfly_free"])
        if len(g) >= 5:
            g = g.sort_values("x")
            x, w, t = g["x"].to_numpy(), g["w"].to_numpy(), float(g["_t"].iloc[0])
            p = fit_slice(x, w, g["n"].to_numpy(float))
            a, b, rho, m, s = map(float, p)
            at = np.arange(-20, 21) / 10
            level, far = slice_variance(at, p), np.sqrt((at - m) ** 2 + s * s)
            slope, bend = b * (rho + (at - m) / far), b * s * s / far**3
            with np.errstate(divide="ignore", invalid="ignore"):
                g_ = (1 - at * slope / (2 * level)) ** 2 - slope**2 / 4 * (1 / level + 0.25) + bend / 2
            near = np.sqrt(m * m + s * s)
            zero = float(slice_variance(np.zeros(1), p)[0])
            row |= {"a": a, "b": b, "rho": rho, "m": m, "s": s, "rmse": float(np.sqrt(np.mean((slice_variance(x, p) - w) ** 2))), "atm_vol": float(np.sqrt(max(zero, 0.0) / t)) if t > 0 else None}
            row |= {"skew": float(b * (rho - m / near)), "curvature": float(b * s * s / near**3), "butterfly_free": bool((g_ >= -1e-6).all())}
        return pd.DataFrame([row])

    kinds = dict(one.dtypes)
    return one.groupBy(*by).applyInPandas(fit, ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + _SLICE)

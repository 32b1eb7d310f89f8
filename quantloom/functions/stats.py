"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Coefficients of the polynomial 7.1.26 for the error function (Abramowitz and Stegun).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def phi(x: Column) -> Column:
    """The standard normal distribution function."""
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def phi_sql(x: str) -> str:
    t = f"(1 / (1 + {ERF_P} * abs(({x}) / sqrt(2.0))))"
    poly = " + ".join(f"{a} * pow({t}, {i + 1})" for i, a in enumerate(ERF))
    return f"(0.5 * (1 + sign({x}) * (1 - ({poly}) * exp(-({x}) * ({x}) / 2))))"


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def average_rank(x: str, *by: str) -> Column:
    """Ranks from 1; equal values share the mean of theirs."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0


def z(x: Column, over: WindowSpec, population: bool = False) -> Column:
    """Cross-sectional z; a spread of zero counts as one, a missing value as the mean."""
    sd = (F.stddev_pop if population else F.stddev_samp)(x).over(over)
    return F.coalesce((x - F.avg(x).over(over)) / F.when(sd > 0, sd).otherwise(1.0), F.lit(0.0))


def order_statistic(x: str, share: float) -> Column:
    """The value at place int(share * n) of the sorted values, without interpolation."""
    values = F.sort_array(F.collect_list(x))
    return F.get(values, F.floor(F.lit(share) * F.size(values)).cast("int"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


#: Coefficients of the rational approximation of the normal quantile (Acklam), highest power first.
QUANTILE_MIDDLE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_MIDDLE_UNDER = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
QUANTILE_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
QUANTILE_TAIL_FROM = 0.02425


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    """The polynomial at ``x``; the first coefficient belongs to the highest power."""
    value = F.lit(coefficients[0])
    for a in coefficients[1:]:
        value = value * x + a
    return value


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile; minus and plus infinity at and beyond 0 and 1, null for null."""
    low = F.least(p, 1 - p)
    u = F.sqrt(-2 * F.ln(F.greatest(low, F.lit(1e-300))))
    tail = horner(u, QUANTILE_TAIL) / horner(u, QUANTILE_TAIL_UNDER)
    d = p - 0.5
    middle = d * horner(d * d, QUANTILE_MIDDLE) / horner(d * d, QUANTILE_MIDDLE_UNDER)
    inner = F.when(low < QUANTILE_TAIL_FROM, F.when(p < 0.5, tail).otherwise(-tail)).otherwise(middle)
    return F.when(p <= 0, float("-inf")).when(p >= 1, float("inf")).otherwise(inner)


#: From here on the normal tail is a continued fraction of so many levels, whose error is relative (under 1e-7).
TAIL_FROM, TAIL_LEVELS = 2.5, 16


def weighted_tail(y: Column, log_weight: Column) -> Column:
    """``exp(log_weight) * phi(-y)``, right and without overflow where the weight is huge and the tail tiny."""
    under = y
    for k in range(TAIL_LEVELS, 0, -1):
        under = y + k / under
    far = F.exp(log_weight - y * y / 2) / (math.sqrt(2 * math.pi) * under)
    return F.when(y > TAIL_FROM, far).otherwise(F.exp(log_weight) * phi(-y))


def weighted_tail_sql(y: str, log_weight: str) -> str:
    under = f"({y})"
    for k in range(TAIL_LEVELS, 0, -1):
        under = f"(({y}) + {k} / {under})"
    return f"(CASE WHEN ({y}) > {TAIL_FROM} THEN exp({log_weight} - ({y}) * ({y}) / 2) / (sqrt(2 * pi()) * {under}) ELSE exp({log_weight}) * {phi_sql(f'(-({y}))')} END)"

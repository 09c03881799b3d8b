"""Statistical kernels as column expressions, with Arrow helpers for the rest."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship the few Arrow helpers with the tasks: workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def log_factorial(n: Column) -> Column:
    """ln(n!) for a non-negative whole number; exact below 15, Stirling series above."""
    x = n.cast("double")
    small = F.log(F.factorial(F.least(F.greatest(n.cast("int"), F.lit(0)), F.lit(15))).cast("double"))
    safe = F.greatest(x, F.lit(1.0))
    series = (safe * F.log(safe) - safe + 0.5 * F.log(2.0 * math.pi * safe)
              + 1.0 / (12.0 * safe) - 1.0 / (360.0 * safe ** 3) + 1.0 / (1260.0 * safe ** 5))
    return F.when(x <= 15, small).otherwise(series)


def poisson_tail(n: Column, rate: Column) -> Column:
    """P(X >= n) for X ~ Poisson(rate).

    Sums outward from n on the side away from the mode, so terms shrink from
    the first one and about 9*sqrt(n) of them carry all the double precision;
    nothing underflows for large rates and far tails keep their digits.
    """
    lam = rate.cast("double")
    k = n.cast("double")
    n_terms = (F.lit(60.0) + 9.0 * F.sqrt(F.greatest(k, lam))).cast("int")

    def term(count: Column) -> Column:
        return F.exp(count * F.log(lam) - lam - log_factorial(count))

    def fold(first: Column, steps: Column, factor) -> Column:
        zero = F.struct(first.alias("t"), first.alias("s"))

        def merge(acc: Column, j: Column) -> Column:
            t = acc["t"] * factor(j)
            return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

        return F.aggregate(steps, zero, merge, lambda acc: acc["s"])

    upper = fold(term(k), F.sequence(F.lit(1), n_terms), lambda j: lam / (k + j))
    below = k - 1.0
    n_below = F.least(n_terms, below.cast("int"))
    lower_steps = F.when(n_below >= 1, F.sequence(F.lit(1), F.greatest(n_below, F.lit(1)))).otherwise(
        F.array().cast("array<int>"))
    lower = fold(term(F.greatest(below, F.lit(0.0))), lower_steps, lambda j: (below - j + 1.0) / lam)
    return (F.when(k <= 0, F.lit(1.0))
            .when(k > lam, F.least(upper, F.lit(1.0)))
            .otherwise(F.greatest(1.0 - lower, F.lit(0.0))))


def sorted_median(values: Column) -> Column:
    """Median of an ascending array (mean of the two middle values when even)."""
    n = F.size(values)
    low = F.element_at(values, ((n + 1) / 2).cast("int"))
    high = F.element_at(values, (n / 2).cast("int") + 1)
    return (low + high) / 2.0


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def student_t_two_sided(t: float, dof: float) -> float:
    """Two-sided p-value of a t statistic."""
    if t is None or dof is None or not dof > 0 or not np.isfinite(t):
        return float("nan")
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(DoubleType())
def student_t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Vector form of `student_t_two_sided`, for one row per fitted model."""
    out = [student_t_two_sided(a, b) for a, b in zip(t, dof)]
    return pd.Series([None if math.isnan(v) else v for v in out], dtype="float64")


def binomial_quantiles(u: np.ndarray, n: int, k: int) -> np.ndarray:
    """Inverse CDF of Binomial(n, k/n): smallest j with F(j) >= u.

    Only the +-12 standard deviations around the mean are tabulated, which
    holds all mass a 52-bit uniform can reach.
    """
    if n <= 0 or k <= 0:
        return np.zeros(len(u))
    if k >= n:
        return np.full(len(u), float(n))
    p = k / n
    spread = 12.0 * math.sqrt(n * p * (1.0 - p)) + 40.0
    lo, hi = max(0, int(k - spread)), min(n, int(k + spread))
    j = np.arange(lo, hi, dtype="float64")
    start = (math.lgamma(n + 1) - math.lgamma(lo + 1) - math.lgamma(n - lo + 1)
             + lo * math.log(p) + (n - lo) * math.log1p(-p))
    steps = np.log(n - j) - np.log(j + 1.0) + math.log(p) - math.log1p(-p)
    cdf = np.cumsum(np.exp(np.concatenate([[start], start + np.cumsum(steps)])))
    return lo + np.minimum(np.searchsorted(cdf, u, side="left"), hi - lo).astype("float64")


@F.pandas_udf(DoubleType())
def binomial_draw(u: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
    """Binomial(n, k/n) draw from a uniform; one CDF table per distinct (n, k)."""
    out = np.empty(len(u))
    frame = pd.DataFrame({"u": u.to_numpy(), "n": n.to_numpy(), "k": k.to_numpy()})
    for (size, hits), rows in frame.groupby(["n", "k"]).indices.items():
        out[rows] = binomial_quantiles(frame["u"].to_numpy()[rows], int(size), int(hits))
    return pd.Series(out)

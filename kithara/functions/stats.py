"""Enrichment statistics: tails of the normal, binomial and hypergeometric laws, and false-discovery rates.

The tails are Arrow functions over one row a cluster, in numpy over a whole batch: neither log-gamma nor
the error function exists as a Spark expression. All else is expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kithara.operators import ranges
from kithara.session import written


def z_binomial(a: Column, b: Column, s: Column, n: Column) -> Column:
    """Standard score of a of s sample points against b of n background points."""
    a, b, s, n = (c.cast("double") for c in (a, b, s, n))
    under = s * (b + 1e-6) * (n - b)
    return F.when(under > 0, (n * a - s * b) / F.sqrt(under))


def log10_fold_change(a: Column, b: Column, s: Column, n: Column) -> Column:
    a, b, s, n = (c.cast("double") for c in (a, b, s, n))
    return F.log10(((a + 1e-9) / F.nullif(s, F.lit(0.0))) / ((b + 1e-9) / F.nullif(n, F.lit(0.0))))


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function of x >= 0: by its series up to 2.5, beyond by its continued fraction."""
    x = np.asarray(x, float)
    out = np.empty_like(x)
    low = x < 2.5
    y = x[low]
    term, total = y.copy(), y.copy()
    for k in range(1, 60):
        term = term * (-y * y) / k
        total += term / (2 * k + 1)
    out[low] = 1 - 2 / math.sqrt(math.pi) * total
    y = x[~low]
    fraction = y.copy()
    for k in range(80, 0, -1):
        fraction = y + k / 2 / fraction
    out[~low] = np.exp(-y * y) / (math.sqrt(math.pi) * fraction)
    return out


def _of_known(f, z: pd.Series) -> pd.Series:
    x = z.to_numpy(dtype=float, na_value=np.nan)
    known = ~np.isnan(x)
    out = np.full(len(x), np.nan)
    out[known] = f(x[known])
    return pd.Series(out).where(known, None)


@F.pandas_udf(DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    return _of_known(lambda x: erfc(np.abs(x) / math.sqrt(2)), z)


@F.pandas_udf(DoubleType())
def centred_normal(z: pd.Series) -> pd.Series:
    """2 (Phi(z) - 1/2): the exploratory local statistic."""
    return _of_known(lambda x: np.sign(x) * (1 - erfc(np.abs(x) / math.sqrt(2))), z)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The log of the gamma function of x > 0: Stirling's series, from x + 10 down where x is small."""
    x = np.asarray(x, float)
    y = np.where(x < 10, x + 10, x)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series
    down = np.zeros_like(y)
    for k in range(10):
        down += np.log(np.where(x < 10, x + k, 1.0))
    return out - down


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fractions of the incomplete beta function (Lentz), those that have settled left out."""
    tiny = 1e-300
    kept = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1 / kept(1 - (a + b) * x / (a + 1))
    h, open_ = d.copy(), np.arange(len(x))
    for m in range(1, 20000):
        p, q, y = a[open_], b[open_], x[open_]
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d[open_] = 1 / kept(1 + num * d[open_])
            c[open_] = kept(1 + num / c[open_])
            h[open_] *= d[open_] * c[open_]
        open_ = open_[np.abs(d[open_] * c[open_] - 1) >= 1e-15]
        if not len(open_):
            break
    return h


def regularized_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, a, b = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(x, a, b))
    out = (x >= 1).astype(float)
    own = np.flatnonzero((x > 0) & (x < 1))
    x, a, b = x[own], a[own], b[own]
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    left = x < (a + 1) / (a + b + 2)
    part = np.empty_like(x)
    part[left] = front[left] * _beta_fraction(a[left], b[left], x[left]) / a[left]
    part[~left] = 1 - front[~left] * _beta_fraction(b[~left], a[~left], 1 - x[~left]) / b[~left]
    out[own] = part
    return out


def binomial_sf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X > k)."""
    k, n, p = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(k, n, p))
    inside = (k >= 0) & (k < n)
    out = (k < 0).astype(float)
    out[inside] = regularized_beta(p[inside], k[inside] + 1, n[inside] - k[inside])
    return out


@F.pandas_udf(DoubleType())
def binomial_min_tail(a: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
    """min(P(X > a), P(X <= a)) for X of s draws."""
    t = binomial_sf(a.to_numpy(float), s.to_numpy(float), p.to_numpy(float))
    return pd.Series(np.minimum(t, 1 - t))


@F.pandas_udf(DoubleType())
def binomial_upper_tail(a: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= a); for p = 0 it is 0 if a > 0, else 1."""
    k, n, q = (v.to_numpy(float) for v in (a, s, p))
    return pd.Series(np.where(q <= 0, (k <= 0).astype(float), binomial_sf(k - 1, n, np.maximum(q, 0))))


def _beyond_mode(sign: int, mode: np.ndarray, row: np.ndarray, col: np.ndarray, n: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums over the tables beyond the mode in one direction, whose weight is 1: of all, of those from `at` on, of those of at most `limit`; and the weight at `at`.

    Weights follow from each other by a ratio and fall ever faster, so a sum ends at its last digit; nothing
    is kept of the tables passed. at: a place in this direction, or the mode for none; limit: 0 for none.
    """
    total, tail, small, own = (np.zeros(len(mode)) for _ in range(4))
    live, x, w = np.arange(len(mode)), mode.astype(float), np.ones(len(mode))
    has_at, has_limit = sign * (at - mode) > 0, limit > 0
    while len(live):
        r, c, rest, a = row[live], col[live], n[live] - row[live] - col[live], at[live]
        w *= (r - x) * (c - x) / ((x + 1) * (rest + x + 1)) if sign > 0 else x * (rest + x) / ((r - x + 1) * (c - x + 1))
        x += sign
        total[live] += w
        reached = has_at[live] & (sign * (x - a) >= 0)
        tail[live] += np.where(reached, w, 0)
        own[live] = np.where(has_at[live] & (x == a), w, own[live])
        small[live] += np.where(w <= limit[live], w, 0)
        goes = (w > 1e-17 * total[live]) | (has_at[live] & (~reached | (w > 1e-17 * tail[live]))) | (has_limit[live] & ((small[live] == 0) | (w > 1e-17 * small[live])))
        goes &= w > 1e-300
        live, x, w = live[goes], x[goes], w[goes]
    return total, tail, small, own


def hypergeometric_tails(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each table [[a, b], [c, d]] with its margins: P(X >= a), and the sum of all probabilities up to that of a.

    The tables are passed outward from the most probable one, so the work follows the spread of the law (a
    few thousand tables for margins of 10^8) and the memory is that of the rows. Probabilities below 1e-300 are 0.
    """
    a, row, col, n = (np.asarray(v, float) for v in (a, a + b, a + c, a + b + c + d))
    mode = np.floor((row + 1) * (col + 1) / (n + 2))
    mode = np.clip(mode, np.maximum(0, row + col - n), np.minimum(row, col))
    none = np.zeros(len(a))
    up, at_up, _, own_up = _beyond_mode(1, mode, row, col, n, a, none)
    # P(X >= a) for a up to the mode is 1 less the tables below a
    below = np.where(a <= mode, a - 1, mode)
    down, at_down, _, _ = _beyond_mode(-1, mode, row, col, n, below, none)
    whole = 1 + up + down
    greater = np.where(a > mode, at_up / whole, 1 - at_down / whole)
    own_down = _beyond_mode(-1, mode, row, col, n, a, none)[3]
    own = np.where(a > mode, own_up, np.where(a < mode, own_down, 1.0))
    limit = own * (1 + 1e-7)
    both = sum(_beyond_mode(s, mode, row, col, n, mode, limit)[2] for s in (1, -1)) + (limit >= 1)
    return np.clip(greater, 0, 1), np.clip(both / whole, 0, 1)


def _fisher(side: int, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    cells = np.array([v.to_numpy(float) for v in (a, b, c, d)])
    out = np.full(cells.shape[1], np.nan)
    whole = np.isfinite(cells).all(0)
    out[whole] = hypergeometric_tails(*np.floor(cells[:, whole]))[side]
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _fisher(0, a, b, c, d)


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _fisher(1, a, b, c, d)


def with_fdr(df: DataFrame, p: str, q: str, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q-values of the non-null p, within groups. A task orders groups of up to ONE_TASK rows; larger ones are dealt in ranges."""
    df = written(df, "p_values")
    if ranges.largest_group(df, by) > ranges.ONE_TASK:
        return ranges.fdr_in_ranges(df, p, q, by, ties)
    some = F.when(F.col(p).isNotNull(), 1)
    up = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), *ties)
    down = Window.partitionBy(*by).orderBy(F.col(p).desc_nulls_last(), *[F.desc(t) for t in ties]).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_i": F.row_number().over(up), "_n": F.count(some).over(Window.partitionBy(*by))})
    df = df.withColumn("_r", F.col(p) * F.col("_n") / F.col("_i"))
    return df.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_r").over(down)))).drop("_i", "_n", "_r")


def average_rank(value: Column, by: Sequence[str] = (), descending: bool = False) -> Column:
    """Rank from 1, ties at their mean; nulls unranked."""
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    low = F.rank().over(Window.partitionBy(*by).orderBy(order))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull(), low + (ties - 1) / 2)


def percent_rank(value: Column, by: Sequence[str] = ()) -> Column:
    return average_rank(value, by) / F.count(value).over(Window.partitionBy(*by))

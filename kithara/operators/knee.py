"""Knees of sorted distances: a polynomial's largest rise above the diagonal, and a smoothing spline's sharpest bend.

Both work from sums over the ranked distances (rank, d), so the curve stays where it is and only a row of
sums for each group is solved on the driver; groups are those that radii are learned for (lengths, so few).

The polynomial knee follows Satopaa et al., "Finding a Kneedle in a Haystack" (2011), for rising concave
curves: the fitted curve is scaled to the unit square, and of the maxima of its height above the diagonal
the last counts from which the height falls by more than sensitivity / (n - 1) before the next maximum (below 0 after a minimum).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from numpy.polynomial import legendre
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithara.operators.ranges import ranked_in_ranges
from kithara.session import written

#: Points at which a polynomial's course between its bends is followed.
GRID = 4096


def polynomial_sums(ranked: DataFrame, by: Sequence[str], degree: int) -> DataFrame:
    """One row for each group of ranked (by, i, n, d): n and the sums of p_j * p_k and p_j * d, p_k being Legendre polynomials of the rank in [-1, 1]."""
    t = F.when(F.col("n") > 1, 2.0 * F.col("i") / (F.col("n") - 1) - 1).otherwise(0.0)
    names = [f"_p{k}" for k in range(degree + 1)]
    rows = ranked.withColumn("_p0", F.lit(1.0)).withColumn("_p1", t)
    for k in range(1, degree):
        rows = rows.withColumn(f"_p{k + 1}", ((2 * k + 1) * F.col("_p1") * F.col(f"_p{k}") - k * F.col(f"_p{k - 1}")) / (k + 1))
    gram = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return rows.groupBy(*by).agg(F.max("n").alias("n"), *gram, *[F.sum(F.col(p) * F.col("d")).alias(f"y{i}") for i, p in enumerate(names)])


def fitted(row: pd.Series, degree: int) -> np.ndarray:
    """Legendre coefficients of the least-squares polynomial; of fewer points than coefficients, of as high a degree as they allow."""
    m = min(degree, int(row["n"]) - 1) + 1
    gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], float)
    return np.linalg.lstsq(gram, np.array([row[f"y{i}"] for i in range(m)], float), rcond=None)[0]


def knee_rank(c: np.ndarray, n: int, sensitivity: float = 1.0) -> int | None:
    """The rank from 0 of the knee of the curve with Legendre coefficients c over ranks 0 to n - 1; None if it has none."""
    if n < 3:
        return None
    bends = legendre.legroots(legendre.legder(c)) if len(c) > 2 else np.array([])
    rise = c.copy()
    at = {0, n - 1, *np.linspace(0, n - 1, min(n, GRID)).round().astype(int).tolist()}

    def near(roots: np.ndarray) -> None:
        real = roots[np.abs(roots.imag) < 1e-9].real if len(roots) else np.array([])
        for x in (real[(real > -1) & (real < 1)] + 1) / 2 * (n - 1):
            at.update(k for k in range(int(x) - 2, int(x) + 4) if 0 <= k < n)

    near(bends)
    # the height above the diagonal bends where the slope is that of the diagonal
    values = legendre.legval(2 * np.array(sorted(at)) / (n - 1) - 1, c)
    low, high = values.min(), values.max()
    if high <= low:
        return None
    rise[1] -= (high - low) / 2
    near(legendre.legroots(legendre.legder(rise)) if len(rise) > 2 else np.array([]))
    i = np.array(sorted(at))
    y = (legendre.legval(2 * i / (n - 1) - 1, c) - low) / (high - low) - i / (n - 1)
    before, after = np.concatenate([y[:1], y[:-1]]), np.concatenate([y[1:], y[-1:]])
    maxima, minima = (y >= before) & (y >= after), (y <= before) & (y <= after)
    knee, threshold, top = None, None, None
    for k in range(int(np.argmax(maxima)), len(i) - 1):
        if maxima[k]:
            threshold, top = y[k] - sensitivity / (n - 1), k
        if minima[k]:
            threshold = 0.0
        if y[k + 1] < threshold:
            knee = int(i[top])
    return knee


def _ranked(distances: DataFrame, by: Sequence[str], d: str) -> DataFrame:
    rows = written(ranked_in_ranges(distances.select(*by, F.col(d).cast("double").alias("d")), by, ["d"], "i"), "ranked")
    n = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return rows.join(n, list(by)) if by else rows.crossJoin(n)  # one row without groups


def _picked(ranked: DataFrame, by: Sequence[str], found: pd.DataFrame) -> DataFrame:
    """(by, eps) of the distance at each group's rank `at`."""
    spark = ranked.sparkSession
    shape = ", ".join([*(f"{c} {t}" for c, t in ranked.select(*by).dtypes), "at long"])
    at = spark.createDataFrame([tuple(r) for r in found[[*by, "at"]].astype(object).itertuples(index=False)], shape)
    both = ranked.join(at, list(by)) if by else ranked.crossJoin(at)
    return both.filter("i = at").select(*by, F.col("d").alias("eps"))


def polynomial_radius(distances: DataFrame, by: Sequence[str] = (), d: str = "d", degree: int = 10, sensitivity: float = 1.0) -> DataFrame:
    """(by, eps): the distance after the knee of each group's polynomial; groups without a knee are left out (take the chord there)."""
    ranked = _ranked(distances, by, d)
    sums = polynomial_sums(ranked, by, degree).toPandas()
    at = [knee_rank(fitted(r, degree), int(r["n"]), sensitivity) for _, r in sums.iterrows()]
    # the knee's place counted from 1 is used as a place from 0
    found = sums.assign(at=[None if k is None else min(k + 1, int(n) - 1) for k, n in zip(at, sums["n"], strict=True)]).dropna(subset=["at"])
    found["at"] = found["at"].astype(int)
    return _picked(ranked, by, found)


#: Pieces of the smoothing spline, and the weight of its bending against its distance from the data.
PIECES, SMOOTHING = 64, 1e-4


def _hats(ranked: DataFrame, by: Sequence[str], pieces: int) -> DataFrame:
    """For each group and piece of the unit interval: sums of the cubic B-splines' products, and of each with d (scaled to 0 to 1)."""
    ends = ranked.groupBy(*by).agg(F.min("d").alias("_low"), F.max("d").alias("_high"))
    rows = ranked.join(ends, list(by)) if by else ranked.crossJoin(ends)
    x = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)) * pieces
    piece = F.least(F.floor(x), F.lit(pieces - 1)).cast("int")
    y = F.when(F.col("_high") > F.col("_low"), (F.col("d") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    rows = rows.select(*by, "n", piece.alias("piece"), (x - piece).alias("u"), y.alias("y"))
    u = F.col("u")
    b = [(1 - u) * (1 - u) * (1 - u) / 6, (3 * u * u * u - 6 * u * u + 4) / 6, (-3 * u * u * u + 3 * u * u + 3 * u + 1) / 6, u * u * u / 6]
    rows = rows.withColumns({f"b{k}": e for k, e in enumerate(b)})
    gram = [F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"g{i}_{j}") for i in range(4) for j in range(i, 4)]
    return rows.groupBy(*by, "piece").agg(F.max("n").alias("n"), *gram, *[F.sum(F.col(f"b{i}") * F.col("y")).alias(f"y{i}") for i in range(4)])


def spline_coefficients(sums: pd.DataFrame, pieces: int = PIECES, smoothing: float = SMOOTHING) -> np.ndarray:
    """B-spline coefficients that minimise mean squared distance + smoothing * squared second differences, from banded normal equations."""
    m, n = pieces + 3, float(sums["n"].max())
    gram, right = np.zeros((m, m)), np.zeros(m)
    for _, r in sums.iterrows():
        p = int(r["piece"])
        for i in range(4):
            right[p + i] += r[f"y{i}"] / n
            for j in range(4):
                gram[p + i, p + j] += r[f"g{min(i, j)}_{max(i, j)}"] / n
    bend = np.diff(np.eye(m), 2, axis=0)
    return np.linalg.solve(gram + smoothing * bend.T @ bend + 1e-12 * np.eye(m), right)


def elbow_place(c: np.ndarray, pieces: int = PIECES) -> float:
    """Where in 0 to 1 the spline's second derivative is largest; it is linear between knots, so at one of them."""
    second = np.diff(c, 2)[: pieces + 1]
    return int(np.argmax(second)) / pieces


def spline_elbow(distances: DataFrame, by: Sequence[str] = (), d: str = "d", pieces: int = PIECES, smoothing: float = SMOOTHING) -> DataFrame:
    """(by, eps): the distance where the smoothed curve of sorted distances turns upward most sharply."""
    ranked = _ranked(distances, by, d)
    sums = _hats(ranked, by, pieces).toPandas()
    groups = sums.groupby(list(by), dropna=False) if by else [((), sums)]
    found = [(*(k if isinstance(k, tuple) else (k,)), round(elbow_place(spline_coefficients(own, pieces, smoothing), pieces) * (own["n"].max() - 1))) for k, own in groups]
    return _picked(ranked, by, pd.DataFrame(found, columns=[*by, "at"]))

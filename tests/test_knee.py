import numpy as np
import pytest
from pyspark.sql import functions as F

from kithara.operators import density, knee


def curve(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    x = np.linspace(0, 1, n)
    y = {"root": np.sqrt(x), "bent": np.minimum(x * 5, 0.8 + x * 0.2), "steps": np.sort(rng.gamma(2, 1, n)), "two": np.where(x < 0.3, np.sqrt(x), 0.55 + 0.5 * np.sqrt(np.maximum(x - 0.3, 0)))}[kind]
    return np.sort(y + rng.normal(0, 0.003, n))


def slow_knee(y, degree=10, sensitivity=1.0):
    """Point by point over a polynomial fitted to the points themselves."""
    n = len(y)
    x = np.arange(1, n + 1)
    fit = np.polynomial.Polynomial.fit(x, y, degree)(x)
    up = (fit - fit.min()) / (fit.max() - fit.min()) - (x - 1) / (n - 1)
    maxima = [k for k in range(n) if up[k] >= up[max(k - 1, 0)] and up[k] >= up[min(k + 1, n - 1)]]
    minima = [k for k in range(n) if up[k] <= up[max(k - 1, 0)] and up[k] <= up[min(k + 1, n - 1)]]
    found, threshold, top = None, None, None
    for k in range(maxima[0], n - 1):
        if k in maxima:
            threshold, top = up[k] - sensitivity / (n - 1), k
        if k in minima:
            threshold = 0.0
        if up[k + 1] < threshold:
            found = top
    return found


def test_polynomial_knee_from_sums_equals_a_fit_to_the_points(spark):
    kinds = {"root": 900, "bent": 700, "steps": 800, "two": 1000}
    rows = [(k, float(v)) for k, n in kinds.items() for v in curve(k, n)]
    got = {r.g: r.eps for r in knee.polynomial_radius(spark.createDataFrame(rows, "g string, d double").repartition(5), ["g"]).collect()}
    for k, n in kinds.items():
        y = curve(k, n)
        want = slow_knee(y)
        if want is None:
            assert k not in got
        else:
            assert got[k] == pytest.approx(y[want + 1], abs=abs(y[min(want + 3, n - 1)] - y[max(want - 2, 0)]) + 1e-12)
    assert "bent" in got
    alone = knee.polynomial_radius(spark.createDataFrame([(float(v),) for v in curve("bent", 700)], "d double")).first()
    assert alone.eps == got["bent"]
    # where there is no knee the chord stays
    flat = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "d double")
    assert knee.polynomial_radius(flat).count() == 0 and density.knee_radius(flat).first().eps == 1.0


def test_course_of_a_long_curve_is_followed_on_a_grid():
    c = np.polynomial.legendre.legfit(np.linspace(-1, 1, 1000), curve("two", 1000), 10)
    many, few = knee.knee_rank(c, 1_000_001), knee.knee_rank(c, 1001)
    assert many / 1_000_000 == pytest.approx(few / 1000, abs=0.002)


def test_spline_elbow_against_a_dense_solution(spark):
    n, pieces = 600, 16
    x = np.linspace(0, 1, n)
    y = np.sort(0.2 * x + np.maximum(0, x - 0.7) ** 2 * 8)
    scaled = (y - y.min()) / (y.max() - y.min())

    def basis(v):
        p = min(int(v * pieces), pieces - 1)
        u = v * pieces - p
        row = np.zeros(pieces + 3)
        row[p : p + 4] = [(1 - u) ** 3 / 6, (3 * u**3 - 6 * u**2 + 4) / 6, (-3 * u**3 + 3 * u**2 + 3 * u + 1) / 6, u**3 / 6]
        return row

    b = np.array([basis(v) for v in x])
    bend = np.diff(np.eye(pieces + 3), 2, axis=0)
    want = np.linalg.lstsq(np.concatenate([b / np.sqrt(n), np.sqrt(1e-4) * bend]), np.concatenate([scaled / np.sqrt(n), np.zeros(len(bend))]), rcond=None)[0]
    rows = spark.createDataFrame([("a", float(v)) for v in y] + [("b", float(v)) for v in y[::2]], "g string, d double").repartition(3)
    ranked = knee._ranked(rows, ["g"], "d")
    sums = knee._hats(ranked, ["g"], pieces).filter("g = 'a'").toPandas()
    assert np.allclose(knee.spline_coefficients(sums, pieces, 1e-4), want, atol=1e-5)
    got = {r.g: r.eps for r in knee.spline_elbow(rows, ["g"], pieces=pieces).collect()}
    place = np.argmax(np.diff(want, 2)[: pieces + 1]) / pieces
    assert got["a"] == pytest.approx(y[round(place * (n - 1))]) and got["b"] == pytest.approx(got["a"], rel=0.05) and place >= 0.6


def test_radius_by_knee_with_the_chord_where_there_is_none(spark):
    rows = [("k", float(v)) for v in curve("bent", 400)] + [("c", 1.0), ("c", 2.0)]
    df = spark.createDataFrame(rows, "g string, d double")
    got = {r.g: r.eps for r in density.knee_radius(df, ["g"]).collect()}
    chord = {r.g: r.eps for r in density.chord_radius(df.filter(F.col("g") == "c"), ["g"]).collect()}
    assert got["c"] == chord["c"] and set(got) == {"k", "c"}

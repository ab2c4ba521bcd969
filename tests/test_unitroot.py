"""Cholesky and the unit-root test against plain least squares."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.operators import unitroot


def points(spark, many):
    start = datetime.date(2001, 1, 1)
    rows = [(s, start + datetime.timedelta(days=31 * i), float(v)) for s, y in many.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series string, date date, y double")


def ols(x, d, columns):
    a = np.column_stack([np.ones(len(d)), *columns])
    beta, *_ = np.linalg.lstsq(a, d, rcond=None)
    rss = ((d - a @ beta) ** 2).sum()
    cov = np.linalg.inv(a.T @ a) * rss / (len(d) - a.shape[1])
    aic = len(d) * (math.log(2 * math.pi * rss / len(d)) + 1) + 2 * a.shape[1]
    return beta[1] / math.sqrt(cov[1, 1]), aic


def plain(y, max_lag=None):
    y, n = np.array(y, float), len(y)
    top = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25), n if max_lag is None else max_lag)
    d = np.diff(y)

    def sample(p, longest):
        m = len(d) - longest
        return y[longest : longest + m], d[longest:], [y[longest : longest + m], *[d[longest - j : longest - j + m] for j in range(1, p + 1)]]

    lag = min(range(top + 1), key=lambda p: (ols(*sample(p, top))[1], p))
    t = ols(*sample(lag, lag))[0]
    phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    c = unitroot.SMALL_P if t <= unitroot.TURN else unitroot.LARGE_P
    p = 0.0 if t < unitroot.LOWEST else 1.0 if t > unitroot.HIGHEST else phi(sum(a * t**i for i, a in enumerate(c)))
    return n, lag, t, p


def series(seed):
    rng = random.Random(seed)
    many = {}
    for k in range(12):
        y, x = [], 0.0
        for i in range(rng.choice([6, 9, 15, 40, 84, 150])):
            x = rng.choice([0.2, 0.6, 0.95, 1.0]) * x + rng.gauss(0, 1) + (0.5 * y[i - 3] if i > 3 and k % 3 == 0 else 0)
            y.append(x)
        many[f"s{k}"] = y
    return many


@pytest.mark.parametrize("seed, max_lag", [(1, None), (2, None), (3, 2)])
def test_unit_root_equals_least_squares(spark, seed, max_lag):
    many = series(seed)
    got = {r.series: r for r in unitroot.unit_root(points(spark, many), max_lag).collect()}
    for name, y in many.items():
        n, lag, t, p = plain(y, max_lag)
        assert (got[name].n, got[name].lag) == (n, lag)
        assert got[name].t_stat == pytest.approx(t, rel=1e-8) and got[name].p_value == pytest.approx(p, abs=1e-10)


def test_series_without_a_statistic(spark):
    many = {"constant": [1] * 30, "line": list(range(30)), "short": [1, 2, 1, 2, 1], "explosive": [1.5**i for i in range(20)]}
    got = {r.series: r for r in unitroot.unit_root(points(spark, many)).collect()}
    assert "short" not in got and got["constant"].t_stat is None and got["constant"].p_value is None and got["constant"].lag is None
    assert got["line"].t_stat is None


def test_published_percentiles(spark):
    """The printed critical values of the test with a constant: 1, 5 and 10 per cent."""
    df = spark.createDataFrame([(-3.43,), (-2.86,), (-2.57,), (-30.0,), (3.0,), (None,)], "t double")
    got = [r.p for r in df.select("t", unitroot.unit_root_p(F.col("t")).alias("p")).collect()]
    assert got[:3] == pytest.approx([0.01, 0.05, 0.10], abs=2e-3) and got[3:] == [0.0, 1.0, None]

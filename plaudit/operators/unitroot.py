"""Least squares of any order by a Cholesky fold over arrays, and the unit-root test built on it.

The regressors of a row are arrays.  Their cross products form the rows of a lower triangle, and a
fold turns each row into its row of the Cholesky factor.  With the response as the last column, its
row holds what every regressor explains beyond those before it: the residual sum of squares of each
nested order is a running difference, so one factor gives the information criterion of all orders.
Everything is local to the row of a series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import computed, let
from .series import TINY, _centre, _dot, _total, as_arrays

# --- Fixed values: published response surface of the test with a constant ---------------------
# Outside (LOWEST, HIGHEST) the p-value is 0 or 1; up to TURN the first polynomial holds.
LOWEST, TURN, HIGHEST = -18.83, -1.61, 2.74
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)

_TRIANGLE = "array<array<double>>"
# Terms of the error-function series; more than enough within LOWEST and HIGHEST of the polynomials.
_TERMS = 160


def cross_products(columns: Column) -> Column:
    """Lower triangle of the products of all columns (array of arrays of one length)."""
    return let(
        columns,
        lambda cs: F.transform(cs, lambda c, i: F.transform(F.slice(cs, F.lit(1), i + 1), lambda d: _dot(c, d))),
    )


def cholesky(triangle: Column) -> Column:
    """Rows of the lower factor.  A column that those before it explain has a null pivot, and null
    entries wherever that pivot is needed."""

    def row(rows: Column, g: Column) -> Column:
        below = F.aggregate(
            rows, F.array().cast("array<double>"),
            lambda acc, r: F.array_append(
                acc, F.try_divide(F.get(g, F.size(acc)) - _dot(acc, F.slice(r, F.lit(1), F.size(acc))), F.get(r, F.size(acc)))
            ),
        )
        whole = F.element_at(g, -1)
        rest = lambda b: whole - _dot(b, b)
        return let(below, lambda b: F.array_append(b, F.when(rest(b) > TINY * whole, F.sqrt(rest(b)))))

    return F.aggregate(triangle, F.array().cast(_TRIANGLE), lambda rows, g: F.array_append(rows, row(rows, g)))


def _sample(p: Column, level_last: bool) -> Column:
    """Centred regressors and response, all of one length: the changes, the level before each, and
    the ``p`` changes before that."""
    y, change = F.col("y"), F.col("change")
    m = F.size(change) - p
    none = F.array().cast(_TRIANGLE)
    lags = F.when(
        p > 0, F.transform(F.sequence(F.lit(1), F.greatest(p, F.lit(1))), lambda j: _centre(F.slice(change, p + 1 - j, m)))
    ).otherwise(none)
    level = F.array(_centre(F.slice(y, p + 1, m)))
    response = F.array(_centre(F.slice(change, p + 1, m)))
    return F.concat(*([lags, level] if level_last else [level, lags]), response)


def _normal_cdf(x: Column) -> Column:
    """Phi by the everywhere convergent series x + x^3/3 + x^5/15 + ..., times the density."""
    def summed(v: Column) -> Column:
        step = lambda s, k: F.struct(
            (s["term"] * v * v / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * v * v / (2 * k + 1)).alias("total")
        )
        total = F.aggregate(
            F.sequence(F.lit(1), F.lit(_TERMS)), F.struct(v.alias("term"), v.alias("total")), step, lambda s: s["total"]
        )
        return F.lit(0.5) + total * F.exp(-v * v / 2) / math.sqrt(2 * math.pi)

    return let(x, summed)


def unit_root_p(t: Column) -> Column:
    """p-value of the statistic by the response surface."""
    poly = lambda c: sum((F.lit(a) * F.pow(t, F.lit(float(i))) for i, a in enumerate(c)), F.lit(0.0))
    z = F.when(t <= TURN, poly(SMALL_P)).otherwise(poly(LARGE_P))
    # Beyond eight deviations the series would only add rounding.
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _normal_cdf(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z)))))
    return F.when(t < LOWEST, 0.0).when(t > HIGHEST, 1.0).when(t.isNotNull(), inside)


def unit_root(points: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(series, n, lag, t_stat, p_value): the augmented unit-root test with a constant.

    The lag, up to 12 (n / 100)^(1/4) rounded up, n / 2 - 2 or ``max_lag``, has the least AIC over
    one common sample, the shorter on ties; the statistic comes from the longest sample that lag
    allows.  Series of under six points are left out; where the level or the changes do not vary
    there is no statistic; orders whose lags repeat each other are passed over.
    """
    arrays = as_arrays(points)
    n = F.col("n")
    top = F.least(F.floor(n / 2).cast("int") - 2, F.ceil(12 * F.pow(n / 100, F.lit(0.25))).cast("int"))
    if max_lag is not None:
        top = F.least(top, F.lit(max_lag))
    y = F.col("y")
    change = F.zip_with(F.slice(y, F.lit(2), n - 1), F.slice(y, F.lit(1), n - 1), lambda a, b: a - b)
    steps = computed(arrays.where(n >= 6), top=top, change=change)
    nested = computed(steps, g=cross_products(_sample(F.col("top"), level_last=False)))
    rows = computed(nested, explained=F.element_at(cholesky(F.col("g")), -1), whole=F.element_at(F.element_at("g", -1), -1))
    m = F.size("change") - F.col("top")

    def criterion(p: Column) -> Column:
        # The first p + 1 regressors; the last entry of the row is the rest of the response itself.
        rss = F.col("whole") - _total(F.transform(F.slice("explained", F.lit(1), p + 1), lambda w: w * w))
        aic = m * (F.log(2 * math.pi * rss / m) + 1) + 2 * (p + 2)
        return F.struct(F.when(rss > TINY * F.col("whole"), aic).alias("aic"), p.alias("lag"))

    orders = F.filter(F.transform(F.sequence(F.lit(0), F.col("top")), criterion), lambda o: o["aic"].isNotNull())
    chosen = computed(rows, lag=F.array_min(orders)["lag"]).drop("g", "explained", "whole")
    final = computed(chosen, g=cross_products(_sample(F.col("lag"), level_last=True)))
    last = computed(final, w=F.element_at(cholesky(F.col("g")), -1), whole=F.element_at(F.element_at("g", -1), -1))
    fitted = F.slice("w", F.lit(1), F.col("lag") + 1)
    rss = F.col("whole") - _dot(fitted, fitted)
    free = F.size("change") - F.col("lag") - (F.col("lag") + 2)
    error = F.sqrt(F.greatest(rss, F.lit(0.0)) / F.when(free > 0, free))
    t = F.when(rss > TINY * F.col("whole"), F.try_divide(F.get("w", F.col("lag")), error))
    tested = computed(last.select("series", "n", "lag", t.alias("t")), t_stat=F.col("t"))
    return tested.select(
        "series", "n", F.when(F.col("t_stat").isNotNull(), F.col("lag")).alias("lag"), "t_stat",
        unit_root_p(F.col("t_stat")).alias("p_value"),
    )

"""Monthly credibility series: cohorts, rolling means, autocorrelation, AR(1)/AR(2) fits.

A series is folded to one row with two arrays (months and values in month order).  Its length is
bounded by the calendar because values are averaged per month first, however many reviews the
user wrote.  All later work is row-local array arithmetic: one shuffle for the whole family.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import computed, let
from ..scale import exact_quantiles

MIN_MONTHS = 24
MAX_LAG = 24
LJUNG_BOX_LAG = 12
TINY = 1e-12


def bucket_of(user: str, buckets: int) -> Column:
    """A hash bucket of users, for pooled series."""
    return F.pmod(F.xxhash64(F.col(user)), F.lit(buckets))


def monthly_points(monthly: DataFrame, series: str = "user_id", value: str = "w_user") -> DataFrame:
    """(series, date, y): the value averaged per month, dated to the first of the month."""
    return monthly.groupBy(
        F.col(series).alias("series"), F.make_date("year", "month", F.lit(1)).alias("date")
    ).agg(F.avg(value).alias("y"))


def as_arrays(points: DataFrame) -> DataFrame:
    """(series, n, dates, y).  Months without reviews are absent: lags run over observed months."""
    folded = points.groupBy("series").agg(
        F.array_sort(F.collect_list(F.struct("date", "y"))).alias("m")
    )
    return computed(
        folded, n=F.size("m"), dates=F.col("m.date"), y=F.col("m.y")
    ).drop("m")


def user_series(points: DataFrame, users: Sequence | None = None) -> DataFrame:
    """(series, t, date, y), t counting observed months from 1; optionally only some users."""
    if users is not None:
        points = points.where(F.col("series").isin(list(users)))
    return as_arrays(points).select(
        "series",
        F.inline(
            F.transform(
                F.arrays_zip("dates", "y"),
                lambda e, i: F.struct(
                    (i + 1).alias("t"), e["dates"].alias("date"), e["y"].alias("y")
                ),
            )
        ),
    )


def series_cohort(points: DataFrame, min_months: int = MIN_MONTHS, k: int = 12) -> DataFrame:
    """Series with enough months: longest first, then most variable, then by name."""
    stats = points.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_months"),
        F.var_pop("y").alias("var_y"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
    )
    return (
        stats.where(F.col("n_months") >= min_months)
        .orderBy(F.desc("n_months"), F.desc(F.round("var_y", 12)), F.asc("series"))
        .limit(k)
    )


# --- array arithmetic ------------------------------------------------------------------------


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _mean(values: Column) -> Column:
    return _total(values) / F.size(values)


def _dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def _centre(values: Column) -> Column:
    return let(_mean(values), lambda m: F.transform(values, lambda x: x - m))


def _less(a: Column, b: Column, factor: Column) -> Column:
    """a - factor * b, element by element."""
    return let(factor, lambda f: F.zip_with(a, b, lambda x, y: x - f * y))


def _autocovariances(centred: Column, lags: Column) -> Column:
    """Sum of products at lags 0..``lags`` of an already centred array."""

    def at_lags(c: Column) -> Column:
        n = F.size(c)
        return F.transform(
            F.sequence(F.lit(0), lags),
            lambda k: _dot(F.slice(c, F.lit(1), n - k), F.slice(c, k + 1, n - k)),
        )

    return let(centred, at_lags)


def _top_lag(n: Column, limit: int) -> Column:
    return F.least(F.lit(limit), F.floor(n / 2).cast("int"))


# --- rolling mean, ACF, PACF, unit root -------------------------------------------------------


def rolling_mean(points: DataFrame, width: int = 12) -> DataFrame:
    """Mean over the last ``width`` observed months, fewer at the start."""
    arrays = as_arrays(points)
    y = F.col("y")

    def window_mean(e: Column, i: Column) -> Column:
        start = F.greatest(F.lit(1), i + 2 - width)
        return F.struct(
            e["dates"].alias("date"),
            e["y"].alias("y"),
            _mean(F.slice(y, start, i + 2 - start)).alias("rolling"),
        )

    return arrays.select("series", F.inline(F.transform(F.arrays_zip("dates", "y"), window_mean)))


def _acf_arrays(points: DataFrame, max_lag: int) -> DataFrame:
    arrays = as_arrays(points)
    cov = _autocovariances(_centre(F.col("y")), _top_lag(F.col("n"), max_lag))
    # A constant series has no autocorrelation: nulls, not a division error.
    scaled = let(
        cov, lambda g: F.transform(g, lambda x: F.when(g[0] > TINY, F.try_divide(x, g[0])))
    )
    return computed(arrays.select("series", "n", "y"), r=scaled).drop("y")


def acf(points: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """(series, lag, acf), lags 0..min(max_lag, n/2), covariances divided by n."""
    return _acf_arrays(points, max_lag).select("series", F.posexplode("r").alias("lag", "acf"))


def pacf(points: DataFrame, max_lag: int = MAX_LAG) -> DataFrame:
    """(series, lag, pacf): Yule-Walker on the same autocorrelations by the Durbin recursion.

    The state holds the coefficients of the current order, the remaining variance and the partial
    autocorrelations found so far.
    """
    arrays = _acf_arrays(points, max_lag).where(F.size("r") > 1)
    r = F.col("r")

    def step(s: Column, k: Column) -> Column:
        back = F.reverse(F.slice(r, F.lit(2), k - 1))
        top = r[k] - _dot(s["phi"], back)
        p = F.try_divide(top, s["v"])
        phi = F.concat(
            F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - p * b), F.array(p)
        )
        return F.struct(
            phi.alias("phi"), (s["v"] * (1.0 - p * p)).alias("v"),
            F.concat(s["out"], F.array(p)).alias("out"),
        )

    empty = F.array().cast("array<double>")
    start = F.struct(
        empty.alias("phi"), F.lit(1.0).alias("v"), F.array(F.lit(1.0)).alias("out")
    )
    found = F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), start, step)
    return arrays.select("series", F.posexplode(found["out"]).alias("lag", "pacf"))


def _lagged(p: int) -> list[Column]:
    """The response and its lags 1..p, aligned, as slices of ``y``."""
    y, n = F.col("y"), F.col("n")
    return [F.slice(y, F.lit(p + 1 - k), n - p) for k in range(p + 1)]


def _fits(n: Column, p: int) -> Column:
    return n > p + 2


def dickey_fuller(points: DataFrame, lags: int = 0) -> DataFrame:
    """(series, n, rho, t_stat) of the unit-root regression with a constant.

    The first difference on the lagged level and, with ``lags=1``, on the previous difference.
    Too short or constant series have no statistic.
    """
    arrays = as_arrays(points).where(F.col("n") >= 5 + lags)
    y, n = F.col("y"), F.col("n")
    change = F.zip_with(
        F.slice(y, F.lit(2), n - 1), F.slice(y, F.lit(1), n - 1), lambda a, b: a - b
    )
    size = n - 1 - lags
    steps = computed(arrays, change=change)
    parts = {
        "d": _centre(F.slice("change", F.lit(1 + lags), size)),
        "x": _centre(F.slice(y, F.lit(1 + lags), size)),
    }
    if lags:
        parts["z"] = _centre(F.slice("change", F.lit(1), size))
    sets = computed(steps, **parts).select("series", "n", *parts)
    names = list(parts)
    sums = computed(
        sets,
        **{f"{a}{b}": _dot(F.col(a), F.col(b)) for i, a in enumerate(names) for b in names[i:]},
    )
    if lags:
        det = F.col("xx") * F.col("zz") - F.col("xz") ** 2
        usable = F.when(det > TINY * F.col("xx") * F.col("zz"), det)
        slope = (F.col("dx") * F.col("zz") - F.col("dz") * F.col("xz")) / usable
        other = (F.col("dz") * F.col("xx") - F.col("dx") * F.col("xz")) / usable
        rss = F.col("dd") - slope * F.col("dx") - other * F.col("dz")
        scale = F.col("zz") / usable
    else:
        usable = F.when(F.col("xx") > TINY, F.col("xx"))
        slope = F.col("dx") / usable
        rss = F.col("dd") - slope * F.col("dx")
        scale = 1.0 / usable
    error = F.sqrt(F.greatest(rss, F.lit(0.0)) / (size - 2 - lags) * scale)
    return sums.select(
        "series",
        "n",
        slope.alias("rho"),
        F.when(error > TINY, F.try_divide(slope, error)).alias("t_stat"),
    )


# --- AR(1) / AR(2) ----------------------------------------------------------------------------


def _order_columns(df: DataFrame, p: int) -> DataFrame:
    """Adds a struct ``fit<p>``: coefficients, residuals, AIC; null where the order has no fit."""
    ok = _fits(F.col("n"), p)
    raw = {f"__l{k}": F.when(ok, arr) for k, arr in enumerate(_lagged(p))}
    step = computed(df, **raw)
    names = list(raw)
    step = computed(
        step,
        **{f"{name}m": _mean(F.col(name)) for name in names},
        **{f"{name}c": _centre(F.col(name)) for name in names},
    )
    c = [F.col(f"__l{k}c") for k in range(p + 1)]
    m = [F.col(f"__l{k}m") for k in range(p + 1)]
    step = computed(
        step,
        **{f"__s{i}{j}": _dot(c[i], c[j]) for i in range(p + 1) for j in range(max(i, 1), p + 1)},
    )
    s = lambda i, j: F.col(f"__s{i}{j}")
    if p == 1:
        det = s(1, 1)
        phis = [F.when(det > TINY, s(0, 1) / det)]
    else:
        det = s(1, 1) * s(2, 2) - s(1, 2) ** 2
        usable = det > TINY * s(1, 1) * s(2, 2)
        phis = [
            F.when(usable, F.try_divide(s(0, 1) * s(2, 2) - s(0, 2) * s(1, 2), det)),
            F.when(usable, F.try_divide(s(0, 2) * s(1, 1) - s(0, 1) * s(1, 2), det)),
        ]
    step = computed(step, **{f"__phi{k + 1}": phi for k, phi in enumerate(phis)})
    phi = [F.col(f"__phi{k + 1}") for k in range(p)]
    const = m[0]
    for k in range(p):
        const = const - phi[k] * m[k + 1]
    resid = _less(c[0], c[1], phi[0])
    if p == 2:
        resid = _less(resid, c[2], phi[1])
    step = computed(step, __const=const, __resid=resid)
    step = computed(step, __rss=_dot(F.col("__resid"), F.col("__resid")))
    n_eff = F.size("__resid")
    rss = F.when(F.col("__rss") > TINY, F.col("__rss"))
    aic = n_eff * (F.log(2 * 3.141592653589793 * rss / n_eff) + 1.0) + 2.0 * (p + 2)
    fit = F.struct(
        F.lit(p).alias("best_order"),
        aic.alias("aic"),
        F.col("__const").alias("const"),
        phi[0].alias("phi1"),
        (phi[1] if p == 2 else F.lit(None).cast("double")).alias("phi2"),
        F.try_divide(rss, n_eff - 1).alias("sigma2_resid"),
        F.col("__resid").alias("resid"),
    )
    return step.select(*df.columns, F.when(aic.isNotNull(), fit).alias(f"fit{p}"))


def _ljung_box_p(q: Column, lag: int) -> Column:
    """Upper tail of chi-square with an even number of degrees of freedom, in closed form."""
    half = q / 2
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, lag // 2):
        term = term * half / i
        total = total + term
    return F.exp(-half) * total


def fit_ar(points: DataFrame, min_obs: int = MIN_MONTHS) -> DataFrame:
    """One row per series: the better of AR(1) and AR(2) by AIC, least squares with a constant.

    Series with fewer than ``min_obs`` months, or without variation, come back with ``ok`` false
    and a reason.
    """
    arrays = as_arrays(points)
    both = _order_columns(_order_columns(arrays, 1), 2)
    better_two = F.col("fit2").isNotNull() & (
        F.col("fit1").isNull() | (F.col("fit2.aic") < F.col("fit1.aic"))
    )
    chosen = computed(
        both,
        fit=F.when(
            F.col("n") >= min_obs, F.when(better_two, F.col("fit2")).otherwise(F.col("fit1"))
        ),
    )
    lag = LJUNG_BOX_LAG
    res = F.col("fit.resid")
    tested = computed(chosen, __g=F.when(F.size(res) > lag, _autocovariances(res, F.lit(lag))))
    size, g = F.size(res), F.col("__g")
    q = size * (size + 2) * F.aggregate(
        F.sequence(F.lit(1), F.lit(lag)),
        F.lit(0.0),
        lambda acc, k: acc + F.pow(g[k] / g[0], F.lit(2.0)) / (size - k),
    )
    tested = computed(tested, lb_stat_12=F.when(g[0] > TINY, q))
    return tested.select(
        "series",
        F.col("dates")[0].alias("first"),
        F.element_at("dates", -1).alias("last"),
        F.col("fit").isNotNull().alias("ok"),
        F.when(F.col("n") < min_obs, F.lit(f"insufficient_obs(<{min_obs})"))
        .when(F.col("fit").isNull(), F.lit("degenerate"))
        .alias("reason"),
        F.col("fit.best_order").alias("best_order"),
        F.col("fit.aic").alias("aic"),
        F.col("n").alias("n_obs"),
        F.col("fit.const").alias("const"),
        F.col("fit.phi1").alias("phi1"),
        F.col("fit.phi2").alias("phi2"),
        F.col("fit.sigma2_resid").alias("sigma2_resid"),
        "lb_stat_12",
        _ljung_box_p(F.col("lb_stat_12"), lag).alias("lb_pvalue_12"),
        "dates",
        "y",
        F.col("fit.resid").alias("resid"),
    )


AR_COLUMNS = [
    "series", "first", "last", "ok", "reason", "best_order", "aic", "n_obs", "phi1", "phi2",
    "sigma2_resid", "lb_pvalue_12",
]


def ar_summary(fits: DataFrame) -> DataFrame:
    """Successful fits with ``phi`` (phi2 under AR(2), else phi1) and ``phi_sum``."""
    return (
        fits.where(F.col("ok"))
        .select(*AR_COLUMNS)
        .withColumn(
            "phi",
            F.when((F.col("best_order") == 2) & F.col("phi2").isNotNull(), F.col("phi2")).otherwise(
                F.col("phi1")
            ),
        )
        .withColumn("phi_sum", F.col("phi1") + F.coalesce("phi2", F.lit(0.0)))
    )


def ar_fitted(fits: DataFrame) -> DataFrame:
    """(series, date, y, fitted) for the months a fit covers."""
    p = F.col("best_order")
    covered = F.size("y") - p
    known = fits.where(F.col("ok"))
    zipped = F.arrays_zip(
        F.slice("dates", p + 1, covered).alias("date"),
        F.slice("y", p + 1, covered).alias("y"),
        F.col("resid").alias("resid"),
    )
    return known.select(
        "series",
        F.inline(
            F.transform(
                zipped,
                lambda e: F.struct(
                    e["date"].alias("date"), e["y"].alias("y"), (e["y"] - e["resid"]).alias("fitted")
                ),
            )
        ),
    )


def ar_flags(summary: DataFrame, q: float = 0.9, p: float = 0.05) -> DataFrame:
    """Fits with a residual variance above its ``q`` quantile or correlated residuals."""
    cut = exact_quantiles(
        summary.select("sigma2_resid", F.lit("all").alias("g")), "sigma2_resid", [q], "g"
    ).agg(F.max("q")).scalar()
    high = F.col("sigma2_resid") > cut
    serial = F.coalesce(F.col("lb_pvalue_12") < p, F.lit(False))
    return summary.where(high | serial).select(
        "series", "best_order", "sigma2_resid", "lb_pvalue_12", "n_obs"
    )

"""Distribution functions, samplers, p-value corrections and bins as Columns and SQL functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .distributions import DEFAULTS, FUNCTIONS, evaluate, with_defaults

METHODS = ("bonferroni", "holm", "hochberg", "BH", "fdr", "BY", "none")


def _vectorized(name: str):
    def run(*columns: pd.Series) -> pd.Series:
        out = evaluate(name, *(c.to_numpy(float, na_value=np.nan) for c in columns))
        return pd.Series([None if v != v else v for v in out.tolist()], dtype=object)

    run.__name__ = name
    return run


def _typed(name: str):
    """A pandas UDF of all parameters of a function."""
    run, most = _vectorized(name), FUNCTIONS[name][2]
    if most == 1:
        f = lambda a: run(a)
    elif most == 2:
        f = lambda a, b: run(a, b)
    elif most == 3:
        f = lambda a, b, c: run(a, b, c)
    else:
        f = lambda a, b, c, d: run(a, b, c, d)
    f.__annotations__ = {k: pd.Series for k in "abcd"[:most]} | {"return": pd.Series}
    return F.pandas_udf(f, "double")


def _column(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")


def _dnorm(x: Column, m: Column, s: Column) -> Column:
    return F.exp(-0.5 * F.pow((x - m) / s, F.lit(2.0))) / (s * 2.5066282746310002)


def _at_zero(x: Column, shape: Column, at_one: Column, rest: Column) -> Column:
    at0 = F.when(shape < 1, F.lit(float("inf"))).when(shape == 1, at_one).otherwise(0.0)
    return F.when(x < 0, 0.0).when(x == 0, at0).otherwise(rest)


def _closed(p: Column, value: Column) -> Column:
    """A quantile of the half line."""
    return F.when(p == 1, F.lit(float("inf"))).when((p >= 0) & (p < 1), value)


#: Closed forms as built-in expressions; all parameters but the first (and a mean) must be positive.
BUILT_IN = {
    "dnorm": lambda x, m, s: F.when(s > 0, _dnorm(x, m, s)),
    "dlnorm": lambda x, m, s: F.when(s > 0, F.when(x <= 0, 0.0).otherwise(_dnorm(F.log(x), m, s) / x)),
    "dexp": lambda x, r: F.when(r > 0, F.when(x < 0, 0.0).otherwise(r * F.exp(-r * x))),
    "pexp": lambda x, r: F.when(r > 0, F.when(x <= 0, 0.0).otherwise(-F.expm1(-r * x))),
    "qexp": lambda p, r: F.when(r > 0, _closed(p, -F.log1p(-p) / r)),
    "dweibull": lambda x, k, s: F.when((k > 0) & (s > 0), _at_zero(x, k, 1 / s, k / s * F.pow(x / s, k - 1) * F.exp(-F.pow(x / s, k)))),
    "pweibull": lambda x, k, s: F.when((k > 0) & (s > 0), F.when(x <= 0, 0.0).otherwise(-F.expm1(-F.pow(x / s, k)))),
    "qweibull": lambda p, k, s: F.when((k > 0) & (s > 0), _closed(p, s * F.pow(-F.log1p(-p), 1 / k))),
}


def d(name: str, *args) -> Column:
    """A distribution function as a column, e.g. d('pnorm', 'x', 0.0, 2.0); closed forms stay in the JVM."""
    if name in BUILT_IN:
        columns = [_column(x) for x in with_defaults(name, args)]
        known = ~F.isnan(columns[0])
        for c in columns[1:]:
            known = known & ~F.isnan(c)
        return F.when(known, BUILT_IN[name](*columns))
    return _typed(name)(*map(_column, with_defaults(name, args)))


#: sampler -> quantile function; parameters as the quantile's after the first
SAMPLERS = {
    n: "q" + n[1:] for n in ("rnorm", "rt", "rchisq", "rf", "rgamma", "rbeta", "rexp", "rweibull", "rlnorm", "rpois", "rnbinom", "rhyper")
}


def r(name: str, *params, seed: int | None = None) -> Column:
    """A random draw in each row: the quantile function of a uniform number. Infinite draws are NULL."""
    uniform = F.rand() if seed is None else F.rand(seed)
    x = d(SAMPLERS[name], F.greatest(uniform, F.lit(2.0**-54)), *params)
    return F.when(~F.abs(x).isin(float("inf")), x)


def adjust_p(p: list[float] | None, method: str) -> list[float] | None:
    """Multiple-testing correction; NULL and NaN entries stay NULL and don't count."""
    if method is not None and method not in METHODS:
        raise ValueError(f"adjust_p: unknown method '{method}'")
    if p is None or method is None:
        return None
    at = [i for i, v in enumerate(p) if v is not None and v == v]
    x = np.array([p[i] for i in at], float)
    n = len(x)
    order = np.argsort(x, kind="stable")
    rank = np.arange(1, n + 1)
    if not n or method == "none":
        y = x
    elif method == "bonferroni":
        y = np.minimum(1, n * x)
    else:
        s = x[order]
        if method == "holm":
            s = np.maximum.accumulate(s * (n - rank + 1))
        else:
            factor = n - rank + 1 if method == "hochberg" else n / rank * (np.sum(1 / rank) if method == "BY" else 1)
            s = np.minimum.accumulate((s * factor)[::-1])[::-1]
        y = np.empty(n)
        y[order] = np.minimum(1, s)
    out: list[float | None] = [None] * len(p)
    for i, v in zip(at, y.tolist()):
        out[i] = v
    return out


def poibin_cdf(probs: list[float] | None, k: int | None) -> float | None:
    """P(successes <= k) of independent trials, by convolution; any bad probability gives NULL."""
    if probs is None or k is None or any(v is None or not 0 <= v <= 1 for v in probs):
        return None
    if k < 0:
        return 0.0
    if k >= len(probs):
        return 1.0
    mass = np.ones(1)
    for v in probs:
        mass = np.convolve(mass, (1 - v, v))
    return float(min(1.0, mass[: k + 1].sum()))


def bin_label(x: float | None, edges: list[float] | None) -> str | None:
    """'[lo, hi)' of the bin that holds x ('[lo, hi]' for the last), numbers as C's %g."""
    if x is None or x != x or edges is None or len(edges) < 2 or any(e is None or e != e for e in edges):
        return None
    if not edges[0] <= x <= edges[-1]:
        return None
    i = min(int(np.searchsorted(edges, x, "right")) - 1, len(edges) - 2)
    return f"[{edges[i]:g}, {edges[i + 1]:g}{']' if i == len(edges) - 2 else ')'}"


def adjust_p_udf(p, method) -> Column:
    return F.udf(adjust_p, "array<double>")(p, method)


def poibin_cdf_udf(probs, k) -> Column:
    return F.udf(poibin_cdf, "double")(probs, k)


def bin_label_udf(x, edges) -> Column:
    return F.udf(bin_label, "string", useArrow=True)(x, edges)


def register_functions(spark: SparkSession) -> None:
    """Make all d, p, q and r functions, adjust_p, poibin_cdf and bin_label callable in SQL.

    Trailing parameters have R's defaults, positional or by name.
    """
    for name, (_, least, most) in FUNCTIONS.items():
        spark.udf.register(f"{name}__all", _typed(name))
        rest = DEFAULTS.get(name[1:], ())
        params = []
        for i, p in enumerate("abcd"[:most]):
            default = rest[i - most + len(rest)] if i >= least else None
            params.append(f"{p} DOUBLE" + (f" DEFAULT {default}D" if default is not None else ""))
        call = ", ".join("abcd"[:most])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(params)}) RETURNS DOUBLE RETURN {name}__all({call})")
    for name, q in SAMPLERS.items():
        _, least, most = FUNCTIONS[q]
        rest = DEFAULTS.get(q[1:], ())

        def draw(*columns: pd.Series, q=q) -> pd.Series:
            args = [c.to_numpy(float, na_value=np.nan) for c in columns]
            u = np.maximum(np.random.default_rng().random(len(columns[0])), 2.0**-54)
            out = evaluate(q, u, *args)
            return pd.Series([v if np.isfinite(v) else None for v in out.tolist()], dtype=object)

        n = most - 1
        inner = {1: lambda draw: lambda a: draw(a), 2: lambda draw: lambda a, b: draw(a, b), 3: lambda draw: lambda a, b, c: draw(a, b, c)}[n](draw)
        inner.__annotations__ = {k: pd.Series for k in "abc"[:n]} | {"return": pd.Series}
        spark.udf.register(f"{name}__all", F.pandas_udf(inner, "double").asNondeterministic())
        params = []
        for i, p in enumerate("abc"[:n]):
            at = i + 1
            default = rest[at - most + len(rest)] if at >= least else None
            params.append(f"{p} DOUBLE" + (f" DEFAULT {default}D" if default is not None else ""))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(params)}) RETURNS DOUBLE NOT DETERMINISTIC RETURN {name}__all({', '.join('abc'[:n])})")
    spark.udf.register("adjust_p", F.udf(adjust_p, "array<double>"))
    spark.udf.register("poibin_cdf", F.udf(poibin_cdf, "double"))
    spark.udf.register("bin_label", F.udf(bin_label, "string"))

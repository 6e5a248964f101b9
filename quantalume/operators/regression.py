"""Ordinary least squares from sums that Spark aggregates; a k x k system is all that is solved in Python."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import divide, joined, p_value, upper_tail
from .describe import kind_of

_TERM = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z0-9_.]*)|([0-9.]+)|(.))')


def parse_formula(text: str) -> tuple[str, list[str], bool]:
    """(response, predictors, intercept) of ``y ~ a + b [- 1 | + 0]``."""
    if text.count("~") != 1:
        raise ValueError("formula: expected exactly one '~'")
    left, right = text.split("~")

    def items(part: str) -> list[tuple[str, str]]:
        out = []
        for m in _TERM.finditer(part.rstrip()):
            quoted, bare, number, other = m.groups()
            if quoted is not None:
                out.append(("name", quoted.replace('""', '"')))
            elif bare is not None:
                out.append(("name", bare))
            elif number is not None:
                out.append(("number", number))
            elif other in "+-":
                out.append(("sign", other))
            else:
                raise ValueError(f"formula: unexpected character '{other}'")
        return out

    response = items(left)
    if len(response) != 1 or response[0][0] != "name":
        raise ValueError("formula: the left side must be one column")
    names, intercept, sign, expect = [], True, "+", True
    for kind, value in items(right):
        if kind == "sign":
            if expect and (names or sign == "-" or value == "+"):
                raise ValueError("formula: missing term")
            sign, expect = value, True
            continue
        if not expect:
            raise ValueError("formula: expected '+' or '-' between terms")
        expect = False
        if kind == "number":
            if (sign, value) not in (("-", "1"), ("+", "0"), ("+", "1")):
                raise ValueError(f"formula: number '{value}' is not allowed; only 0 and 1 are")
            intercept = (sign, value) == ("+", "1")
        elif sign == "-":
            raise ValueError("formula: only the intercept can be removed")
        elif value in names:
            raise ValueError(f"formula: duplicate predictor '{value}'")
        else:
            names.append(value)
    if expect:
        raise ValueError("formula: missing term")
    if not names:
        raise ValueError("formula: at least one predictor is needed")
    return response[0][1], names, intercept


def _arguments(df: DataFrame, y, x, formula) -> tuple[str, list[str], bool]:
    intercept = True
    if formula is not None:
        if y is not None or x is not None:
            raise ValueError("lm: cannot specify 'formula' together with 'y' or 'x'")
        y, x, intercept = parse_formula(formula)
    if y is None:
        raise ValueError("lm: 'y' is required")
    if not x:
        raise ValueError("lm: at least one predictor is required")
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    for c in [y, *x]:
        if c not in kinds:
            raise ValueError(f"lm: column '{c}' not found in table")
        if kinds[c] != "numeric":
            raise ValueError(f"lm: column '{c}' is not numeric")
    return y, list(x), intercept


def moment_columns(y: Column, xs: Sequence[Column], shift: Sequence[float]) -> dict[str, Column]:
    """n, sums and cross products of (x1 - s1, .., y - s) as plain sums."""
    v = [c - F.lit(s) for c, s in zip([*xs, y], shift)]
    out = {"n": F.count(F.lit(1))}
    for i, a in enumerate(v):
        out[f"s{i}"] = F.sum(a)
        for j in range(i, len(v)):
            out[f"c{i}_{j}"] = F.sum(a * v[j])
    return out


class Fit:
    """Estimates from moments about ``shift``; raises ValueError where there are none."""

    def __init__(self, s: dict, k: int, shift: Sequence[float], intercept: bool):
        n = s["n"] or 0
        p = k + intercept
        if n <= p:
            raise ValueError(f"lm: need n > k (n = {n}, k = {p})")
        m = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], float)
        sums, shift = np.array([s[f"s{i}"] for i in range(k + 1)], float), np.array(shift, float)
        if intercept:
            m = m - np.outer(sums, sums) / n  # central
        else:
            m = m + np.outer(sums, shift) + np.outer(shift, sums) + n * np.outer(shift, shift)
        xx, xy, yy = m[:k, :k], m[:k, k], m[k, k]
        d = np.sqrt(np.diag(xx))
        if not (d > 0).all():
            raise ValueError("lm: design matrix is singular")
        scaled = xx / np.outer(d, d)
        if np.linalg.matrix_rank(scaled, tol=1e-10) < k:
            raise ValueError("lm: design matrix is singular")
        inverse = np.linalg.inv(scaled) / np.outer(d, d)
        slope = inverse @ xy
        mean = sums / n + shift
        self.n, self.k, self.dof = n, p, n - p
        self.tss = float(yy)
        self.rss = max(0.0, float(yy - slope @ xy))
        if self.rss <= 1e-14 * max(self.tss, 1e-300):
            self.rss = 0.0
        if intercept:
            self.beta = np.concatenate([[mean[k] - slope @ mean[:k]], slope])
            bread = np.empty((p, p))
            bread[1:, 1:] = inverse
            bread[0, 1:] = bread[1:, 0] = -inverse @ mean[:k]
            bread[0, 0] = 1 / n + mean[:k] @ inverse @ mean[:k]
            self.bread = bread
        else:
            self.beta, self.bread = slope, inverse
        self.intercept = intercept
        self.n, self.k, self.dof = int(n), int(p), int(n - p)
        self.sigma2 = self.rss / self.dof
        self.r2 = 1 - self.rss / self.tss if self.tss > 0 else math.nan
        df_model = p - intercept
        self.adj = 1 - (1 - self.r2) * (n - intercept) / self.dof
        self.f = self.f_p = None
        if self.dof > 0 and self.rss > 0 and self.tss > 0:
            self.f = (self.tss - self.rss) / df_model / self.sigma2
            self.f_p = upper_tail("f", self.f, float(df_model), float(self.dof))

    def terms(self, names: Sequence[str], cov: np.ndarray | None = None, t_dof: float | None = None) -> list[dict]:
        cov = self.bread * self.sigma2 if cov is None else cov
        out = []
        for name, b, v in zip([*["(Intercept)"] * self.intercept, *names], self.beta, np.diag(cov)):
            se = math.sqrt(max(0.0, v))
            t = float(divide(b, se)) if se > 0 else None
            p = p_value("pt", t, "two-sided", float(t_dof or self.dof)) if t is not None else None
            out.append({"term": name, "estimate": float(b), "std_error": float(se), "t_statistic": t, "p_value": p})
        return out


def _fit(df: DataFrame, y: str, x: list[str], intercept: bool) -> Fit:
    cols = [F.col(f"`{c}`").cast("double") for c in [*x, y]]
    rows = df.select(*[c.alias(f"v{i}") for i, c in enumerate(cols)]).where(" and ".join(f"v{i} is not null" for i in range(len(cols))))
    cols = [F.col(f"v{i}") for i in range(len(cols))]
    # centre first, for conditioning: one row of means, then one row of sums
    shift = [m or 0.0 for m in rows.agg(*[F.avg(c) for c in cols]).first()]
    s = rows.agg(*[c.alias(k) for k, c in moment_columns(cols[-1], cols[:-1], shift).items()]).first().asDict()
    return Fit(s, len(x), shift, intercept)


TERMS = "term string, estimate double, std_error double, t_statistic double, p_value double"


def lm(df: DataFrame, y: str | None = None, x: Sequence[str] | None = None, formula: str | None = None) -> DataFrame:
    """Coefficients of an OLS fit over complete cases; raises where there is no fit."""
    y, x, intercept = _arguments(df, y, x, formula)
    terms = _fit(df, y, x, intercept).terms(x)
    return df.sparkSession.createDataFrame([tuple(t.values()) for t in terms], TERMS)


def lm_summary(df: DataFrame, y: str | None = None, x: Sequence[str] | None = None, formula: str | None = None) -> DataFrame:
    y, x, intercept = _arguments(df, y, x, formula)
    f = _fit(df, y, x, intercept)
    row = (f.r2, f.adj, f.f, f.f_p, f.k - intercept, f.dof, math.sqrt(f.sigma2), f.n)
    return df.sparkSession.createDataFrame(
        [row], "r_squared double, adj_r_squared double, f_statistic double, f_p_value double, df_model bigint, df_residual bigint, sigma double, n bigint"
    )


_VCOV = {
    "const": "const", "none": "const", "nonrobust": "const", "ols": "const", "iid": "const", "hc0": "HC0", "hc1": "HC1", "hc2": "HC2", "hc3": "HC3",
    "cr0": "CR0", "cr1": "CR1", "cluster": "CR1",
}
LM_FIT = (
    "coefficients array<struct<term:string,estimate:double,std_error:double,t_statistic:double,p_value:double>>, n bigint, k bigint, "
    "df_residual bigint, r_squared double, adj_r_squared double, sigma double, f_statistic double, f_p_value double, has_intercept boolean, "
    "vcov_type string, n_clusters bigint"
)


def lm_fit(
    df: DataFrame, y, x: Sequence, vcov: str = "const", cluster=None, add_intercept: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """OLS in each group with classical, HC0-HC3 or CR0/CR1 covariance, as a struct; NULL where there is no fit.

    Two passes: the first sums cross products and solves each group, the second
    joins the solution back and sums residual-weighted cross products (for
    clusters: scores by cluster first). ``x`` lists the predictor columns.
    """
    if str(vcov).lower() not in _VCOV:
        raise ValueError(f"lm_fit: unknown vcov '{vcov}'")
    kind, k = _VCOV[vcov.lower()], len(x)
    if kind.startswith("CR") and cluster is None:
        raise ValueError("lm_fit: CR0/CR1 requires a cluster column")
    if cluster is not None and not kind.startswith("CR"):
        raise ValueError("lm_fit: cluster given but vcov is not cluster-robust")
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    cols = {f"v{i}": as_col(c).cast("double") for i, c in enumerate([*x, y])}
    group = {"_cl": as_col(cluster).cast("string")} if cluster is not None else {}
    rows = df.select(*by, *[c.alias(n) for n, c in (cols | group).items()])
    finite = " and ".join([f"v{i} is not null and not isnan(v{i}) and abs(v{i}) < double('infinity')" for i in range(k + 1)] + ["_cl is not null"] * bool(group))
    good = rows.where(finite)
    v = [F.col(f"v{i}") for i in range(k + 1)]
    join = lambda a, b, how="inner": joined(a, b, by, how)
    means = good.groupBy(*by).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(v)])
    centred = join(good, means)
    moments = moment_columns(v[k] - F.col(f"_m{k}"), [v[i] - F.col(f"_m{i}") for i in range(k)], [0.0] * (k + 1))
    first = centred.groupBy(*by).agg(*[c.alias(f"_{n}") for n, c in moments.items()], *[F.first(f"_m{i}").alias(f"_m{i}") for i in range(k + 1)])
    p = k + add_intercept

    def solved(s) -> Fit | None:
        try:
            return Fit({n[1:]: s[n] for n in s.__fields__ if n[:2] not in ("_m",)}, k, [s[f"_m{i}"] for i in range(k + 1)], add_intercept)
        except (ValueError, np.linalg.LinAlgError, TypeError):
            return None

    stats = F.struct(*[c for c in first.columns if c.startswith("_")])
    first = first.select(*by, stats.alias("_stats"))
    if kind == "const":
        done = first.withColumn("_meat", F.lit(None).cast("array<double>")).withColumn("_g", F.lit(None).cast("bigint"))
    else:
        def solution(s):
            f = solved(s)
            return None if f is None else [float(b) for b in f.beta] + [float(b) for b in f.bread.ravel()]

        beta = first.select(*by, F.udf(solution, "array<double>")("_stats").alias("_b")).where("_b is not null")
        second = join(good, beta)
        design = [F.lit(1.0)] * add_intercept + v[:k]
        resid = v[k] - sum((design[i] * F.col("_b")[i] for i in range(1, p)), design[0] * F.col("_b")[0])
        if kind.startswith("HC"):
            lev = sum((design[i] * design[j] * F.col("_b")[p + i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))
            power = {"HC2": 1, "HC3": 2}.get(kind, 0)
            w = resid * resid / F.pow(F.greatest(1 - lev, F.lit(1e-12)), F.lit(power)) if power else resid * resid
            meat = [F.sum(w * design[i] * design[j]) for i in range(p) for j in range(p)]
            summed = second.groupBy(*by).agg(F.array(*meat).alias("_meat"), F.lit(None).cast("bigint").alias("_g"))
        else:
            scores = second.groupBy(*by, "_cl").agg(*[F.sum(resid * design[i]).alias(f"_s{i}") for i in range(p)])
            meat = [F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")) for i in range(p) for j in range(p)]
            summed = scores.groupBy(*by).agg(F.array(*meat).alias("_meat"), F.count(F.lit(1)).alias("_g"))
        done = join(first, summed, "left")

    def finish(s, meat, g):
        f = solved(s)
        if f is None or kind != "const" and meat is None or kind.startswith("CR") and (g or 0) < 2:
            return None
        cov, dof = None, None
        if meat is not None:
            cov = f.bread @ np.array(meat).reshape(p, p) @ f.bread
            if kind == "HC1":
                cov = cov * f.n / f.dof
            if kind.startswith("CR"):
                dof = g - 1.0
                if kind == "CR1":
                    cov = cov * g / (g - 1) * (f.n - 1) / f.dof
        return {
            "coefficients": f.terms([f"x{i + 1}" for i in range(k)], cov, dof), "n": f.n, "k": f.k, "df_residual": f.dof, "r_squared": f.r2,
            "adj_r_squared": f.adj, "sigma": math.sqrt(f.sigma2), "f_statistic": f.f, "f_p_value": f.f_p, "has_intercept": add_intercept,
            "vcov_type": kind, "n_clusters": g,
        }

    every = df.select(*by).distinct() if by else None
    out = done.select(*by, F.udf(finish, LM_FIT)("_stats", "_meat", "_g").alias("result"))
    return joined(every, out, by) if by else out

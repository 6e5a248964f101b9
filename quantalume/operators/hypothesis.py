"""Tests whose statistics are moments or counts: one partial/final aggregation, any scale."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aggregate, cdf, check_alpha, check_alternative, clean, divide, finalize, joined, num, p_value, upper_tail

TTEST = (
    "test_type string, t_statistic double, df double, p_value double, alternative string, mean_diff double, "
    "ci_lower double, ci_upper double, cohens_d double"
)


def _t_result(kind: str, diff: float, se: float, df: float, d: float, alpha: float, alternative: str) -> dict:
    t = divide(diff, se)
    if alternative == "two-sided":
        half = cdf("qt", 1 - alpha / 2, df) * se
        low, high = diff - half, diff + half
    else:
        half = cdf("qt", 1 - alpha, df) * se
        low, high = (-math.inf, diff + half) if alternative == "less" else (diff - half, math.inf)
    return {
        "test_type": kind, "t_statistic": t, "df": df, "p_value": p_value("pt", t, alternative, df), "alternative": alternative,
        "mean_diff": diff, "ci_lower": low, "ci_upper": high, "cohens_d": d,
    }


def _one_sample(kind: str, x: Column, mu: float, df: DataFrame, by, alpha, alternative) -> DataFrame:
    check_alpha(alpha), check_alternative(alternative)

    def finish(s):
        if s["n"] < 2:
            return None
        sd = math.sqrt(s["v"])
        return _t_result(kind, s["m"] - mu, sd / math.sqrt(s["n"]), s["n"] - 1.0, divide(s["m"] - mu, sd), alpha, alternative)

    return aggregate(df, by, {"n": F.count(x), "m": F.avg(x), "v": F.var_samp(x)}, finish, TTEST)


def ttest_1samp(df: DataFrame, x, mu: float = 0.0, alpha: float = 0.05, alternative: str = "two-sided", by: Sequence[str] = ()) -> DataFrame:
    """One-sample t test of the mean of ``x`` against ``mu``; NULL under two values."""
    return _one_sample("One-sample", num(x), mu, df, by, alpha, alternative)


def ttest_paired(df: DataFrame, x, y, alpha: float = 0.05, alternative: str = "two-sided", by: Sequence[str] = ()) -> DataFrame:
    """t test of the differences of complete pairs."""
    return _one_sample("Paired", num(x) - num(y), 0.0, df, by, alpha, alternative)


def ttest_2samp(df: DataFrame, x, y, equal_var: bool = False, alpha: float = 0.05, alternative: str = "two-sided", by: Sequence[str] = ()) -> DataFrame:
    """Two-sample t test; each column is a sample, NULLs drop from each alone."""
    check_alpha(alpha), check_alternative(alternative)
    x, y = num(x), num(y)

    def finish(s):
        n1, n2 = s["n1"], s["n2"]
        if n1 < 2 or n2 < 2:
            return None
        pooled = ((n1 - 1) * s["v1"] + (n2 - 1) * s["v2"]) / (n1 + n2 - 2)
        diff = s["m1"] - s["m2"]
        if equal_var:
            kind, se, dof = "Student Two-sample", math.sqrt(pooled * (1 / n1 + 1 / n2)), n1 + n2 - 2.0
        else:
            a, b = s["v1"] / n1, s["v2"] / n2
            kind, se, dof = "Welch Two-sample", math.sqrt(a + b), divide((a + b) ** 2, a * a / (n1 - 1) + b * b / (n2 - 1))
        return _t_result(kind, diff, se, dof, divide(diff, math.sqrt(pooled)), alpha, alternative)

    stats = {"n1": F.count(x), "m1": F.avg(x), "v1": F.var_samp(x), "n2": F.count(y), "m2": F.avg(y), "v2": F.var_samp(y)}
    return aggregate(df, by, stats, finish, TTEST)


SIGN = "test_type string, m_statistic double, n_pos bigint, n_neg bigint, n_zero bigint, p_value double, alternative string, n bigint"


def _sign(kind: str, d: Column, df: DataFrame, by, alternative) -> DataFrame:
    check_alternative(alternative)

    def finish(s):
        n = s["pos"] + s["neg"]
        if n < 1:
            return None
        lower = cdf("pbeta", 0.5, n - s["pos"], s["pos"] + 1) if s["pos"] < n else 1.0
        upper = cdf("pbeta", 0.5, s["pos"], n - s["pos"] + 1) if s["pos"] > 0 else 1.0
        p = {"less": lower, "greater": upper, "two-sided": min(1.0, 2 * min(lower, upper))}[alternative]
        return {
            "test_type": kind, "m_statistic": (s["pos"] - s["neg"]) / 2, "n_pos": s["pos"], "n_neg": s["neg"], "n_zero": s["zero"],
            "p_value": p, "alternative": alternative, "n": n + s["zero"],
        }

    return aggregate(df, by, {"pos": F.count_if(d > 0), "neg": F.count_if(d < 0), "zero": F.count_if(d == 0)}, finish, SIGN)


def sign_test_1samp(df: DataFrame, x, mu: float = 0.0, alternative: str = "two-sided", by: Sequence[str] = ()) -> DataFrame:
    return _sign("Sign Test (1-sample)", clean(x) - mu, df, by, alternative)


def sign_test_paired(df: DataFrame, x, y, alternative: str = "two-sided", by: Sequence[str] = ()) -> DataFrame:
    return _sign("Sign Test (paired)", clean(x) - clean(y), df, by, alternative)


def correlation_result(kind: str, name: str, r: float, n: int, alpha: float, alternative: str) -> dict:
    dof = n - 2.0
    t = math.copysign(math.inf, r) if abs(r) == 1 else r * math.sqrt(dof / (1 - r * r))
    low = high = math.nan
    if n >= 4 and abs(r) < 1:
        z, half = math.atanh(r), cdf("qnorm", 1 - alpha / 2) / math.sqrt(n - 3)
        low, high = math.tanh(z - half), math.tanh(z + half)
    return {
        "test_type": kind, name: r, "t_statistic": t, "df": dof, "p_value": p_value("pt", t, alternative, dof), "alternative": alternative,
        "ci_lower": low, "ci_upper": high, "n": n,
    }


PEARSON = "test_type string, r double, t_statistic double, df double, p_value double, alternative string, ci_lower double, ci_upper double, n bigint"


def pearson_test(df: DataFrame, x, y, alpha: float = 0.05, alternative: str = "two-sided", by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of complete pairs; NULL under three pairs or without variance."""
    check_alpha(alpha), check_alternative(alternative)
    x, y = clean(x), clean(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)

    def finish(s):
        if s["n"] < 3 or not s["vx"] or not s["vy"]:
            return None
        r = max(-1.0, min(1.0, s["c"] / math.sqrt(s["vx"] * s["vy"])))
        return correlation_result("Pearson Correlation", "r", r, s["n"], alpha, alternative)

    return aggregate(df, by, {"n": F.count(x), "c": F.covar_samp(x, y), "vx": F.var_samp(x), "vy": F.var_samp(y)}, finish, PEARSON)


JB = "test_type string, jb_statistic double, skewness double, excess_kurtosis double, df double, p_value double, n bigint"


def jarque_bera(df: DataFrame, x, by: Sequence[str] = ()) -> DataFrame:
    """Normality by population skewness and excess kurtosis."""
    x = clean(x)

    def finish(s):
        if s["n"] < 4 or not s["v"]:
            return None
        jb = s["n"] / 6 * (s["g1"] ** 2 + s["g2"] ** 2 / 4)
        return {"test_type": "Jarque-Bera", "jb_statistic": jb, "skewness": s["g1"], "excess_kurtosis": s["g2"], "df": 2.0, "p_value": upper_tail("chisq", jb, 2.0), "n": s["n"]}

    return aggregate(df, by, {"n": F.count(x), "v": F.var_samp(x), "g1": F.skewness(x), "g2": F.kurtosis(x)}, finish, JB)


ANOVA = (
    "test_type string, f_statistic double, df_between double, df_within double, p_value double, ss_between double, "
    "ss_within double, eta_squared double, n_groups bigint, n bigint"
)


def anova_oneway(df: DataFrame, value, group, by: Sequence[str] = ()) -> DataFrame:
    """One-way analysis of variance: a first aggregation by group, a second over the groups."""
    df = df.select(*by, clean(value).alias("_v"), (F.col(group) if isinstance(group, str) else group).alias("_g"))
    cells = df.where("_v is not null and _g is not null").groupBy(*by, "_g")
    cells = cells.agg(F.count("_v").alias("c"), F.avg("_v").alias("m"), F.var_pop("_v").alias("v"))
    stats = {
        "k": F.count(F.lit(1)), "n": F.sum("c"), "within": F.sum(F.col("c") * F.col("v")),
        "grand": F.try_divide(F.sum(F.col("c") * F.col("m")), F.sum("c")),
    }
    first = cells.groupBy(*by).agg(*[c.alias(f"_{k}") for k, c in stats.items()])
    against = joined(cells, first.select(*by, "_grand"), by, "inner")
    between = against.groupBy(*by).agg(F.sum(F.col("c") * F.pow(F.col("m") - F.col("_grand"), 2)).alias("_between"))
    both = joined(first, between, by, "inner")

    def finish(s):
        k, n = s["k"], s["n"] or 0
        if k < 2 or n - k <= 0:
            return None
        ssb, ssw = s["between"], s["within"]
        msw = ssw / (n - k)
        if msw > 0:
            f = ssb / (k - 1) / msw
            p = upper_tail("f", f, k - 1.0, float(n - k))
        else:
            f, p = (math.inf, 0.0) if ssb > 0 else (0.0, 1.0)
        return {
            "test_type": "One-way ANOVA", "f_statistic": f, "df_between": k - 1.0, "df_within": float(n - k), "p_value": p,
            "ss_between": ssb, "ss_within": ssw, "eta_squared": divide(ssb, ssb + ssw), "n_groups": k, "n": n,
        }

    return finalize(both, by, ["k", "n", "within", "between"], finish, ANOVA)


CHISQ = "test_type string, chi_square double, df double, p_value double, n bigint, n_rows bigint, n_cols bigint"


def chisq_independence(df: DataFrame, row, col, continuity: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Independence in a contingency table; zero cells need no rows as chi2 = n (sum O^2 / (R C) - 1)."""
    if not isinstance(continuity, bool):
        raise ValueError("continuity must be a constant boolean")
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    df = df.select(*by, as_col(row).cast("string").alias("_r"), as_col(col).cast("string").alias("_c"))
    cells = df.where("_r is not null and _c is not null").groupBy(*by, "_r", "_c").agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cells.groupBy(*by, "_r").agg(F.sum("o").alias("rt"))
    cols = cells.groupBy(*by, "_c").agg(F.sum("o").alias("ct"))
    table = joined(joined(cells, rows, [*by, "_r"], "inner"), cols, [*by, "_c"], "inner")
    stats = {
        "q": F.sum(F.col("o") * F.col("o") / (F.col("rt") * F.col("ct"))), "n": F.sum("o"), "r": F.count_distinct("_r"), "c": F.count_distinct("_c"),
        "det": F.max(F.struct("o", "rt", "ct")),
    }

    def finish(s):
        if s["r"] < 2 or s["c"] < 2:
            return None
        n, dof = s["n"], (s["r"] - 1.0) * (s["c"] - 1)
        chi = max(0.0, n * (s["q"] - 1))
        if continuity and s["r"] == s["c"] == 2:
            # all four |O - E| of a 2x2 table are equal
            o, rt, ct = s["det"]["o"], s["det"]["rt"], s["det"]["ct"]
            gap = max(0.0, abs(o - rt * ct / n) - 0.5)
            chi = gap * gap * sum(n / (a * b) for a in (rt, n - rt) for b in (ct, n - ct))
        return {"test_type": "Chi-square Independence", "chi_square": chi, "df": dof, "p_value": upper_tail("chisq", chi, dof), "n": int(n), "n_rows": s["r"], "n_cols": s["c"]}

    return aggregate(table, by, stats, finish, CHISQ)


GOF = "test_type string, chi_square double, df double, p_value double, n bigint, n_categories bigint"


def chisq_goodness_of_fit(df: DataFrame, category, by: Sequence[str] = ()) -> DataFrame:
    """Uniformity over the observed categories."""
    c = F.col(category) if isinstance(category, str) else category
    cells = df.select(*by, c.cast("string").alias("_c")).where("_c is not null").groupBy(*by, "_c").agg(F.count(F.lit(1)).cast("double").alias("o"))

    def finish(s):
        k, n = s["k"], s["n"]
        if k < 2:
            return None
        chi = max(0.0, s["q"] * k / n - n)
        return {"test_type": "Chi-square Goodness-of-Fit (uniform)", "chi_square": chi, "df": k - 1.0, "p_value": upper_tail("chisq", chi, k - 1.0), "n": int(n), "n_categories": k}

    return aggregate(cells, by, {"k": F.count(F.lit(1)), "n": F.sum("o"), "q": F.sum(F.col("o") * F.col("o"))}, finish, GOF)

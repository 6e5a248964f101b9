"""Rank and distribution-shape tests on value-frequency tables.

Values are first counted, so ties cost nothing and the data shrink before any
ordering. Prefix sums run in two levels: within value ranges that Spark sorts
in parallel, plus the totals of earlier ranges. A single global window, which
would put all rows into one task, is never used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, aggregate, check_alpha, check_alternative, clean, finalize, joined, num, p_value, small, written
from .hypothesis import correlation_result

#: Distinct values that a range of the two-level prefix sums holds, about.
RANGE_ROWS = 250_000


def prefix_sums(table: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], rows: int | None = None) -> DataFrame:
    """Add ``before_<s>``: the sum of each column ``s`` over smaller values of the same group.

    ``table`` is written once and counted (unless ``rows`` says that it is). A
    table of at most SMALL_ROWS rows is windowed by group. A larger one is cut
    into ranges of its groups by approximate percentiles, as many as its size
    takes; rows are windowed within (group, range), and the small table of range
    totals within the group.
    """
    if rows is None:
        table = written(table, "counts")
        rows = table.count()
    if rows <= SMALL_ROWS:
        over = Window.partitionBy(*by or [F.lit(0)]).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumns({f"before_{s}": F.coalesce(F.sum(s).over(over), F.lit(0)) for s in sums})
    ranges = -(-rows // RANGE_ROWS)
    cuts = [i / ranges for i in range(1, ranges)]
    finite = F.when(~F.isnan(value), F.col(value))
    bounds = table.groupBy(*by).agg(F.percentile_approx(finite, cuts, max(2000, 20 * ranges)).alias("_cuts"))
    keyed = joined(table, bounds, by, "inner")
    keyed = keyed.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0))).drop("_cuts")
    ranges = keyed.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    over = Window.partitionBy(*by, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{s}").over(over), F.lit(0)).alias(f"_b_{s}") for s in sums])
    inner = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = joined(keyed, ranges, [*by, "_range"], "inner")
    out = out.withColumns({f"before_{s}": F.col(f"_b_{s}") + F.coalesce(F.sum(s).over(inner), F.lit(0)) for s in sums})
    return out.drop("_range", *[f"_b_{s}" for s in sums])


def two_samples(df: DataFrame, x: Column, y: Column, by: Sequence[str]) -> DataFrame:
    """value, a, b: how often each value occurs in either column."""
    side = lambda v, n: F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(n).alias("side")))
    rows = df.select(*by, F.explode(F.array_compact(F.array(side(x, 0), side(y, 1)))).alias("_r")).select(*by, "_r.*")
    return rows.groupBy(*by, "value").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))


MWU = "test_type string, u_statistic double, z_statistic double, p_value double, alternative string, rank_biserial double"


def mann_whitney_u(df: DataFrame, x, y, alternative: str = "two-sided", continuity: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney U of two columns with midranks and tie correction."""
    check_alternative(alternative)
    table = two_samples(df, num(x), num(y), by).withColumn("t", F.col("a") + F.col("b"))
    ranked = prefix_sums(table, by, "value", ["t"])
    t = F.col("t").cast("double")
    rank = F.col("before_t") + (t + 1) / 2
    stats = {"r1": F.sum(F.col("a") * rank), "n1": F.sum("a"), "n2": F.sum("b"), "ties": F.sum(t * t * t - t)}

    def finish(s):
        n1, n2 = s["n1"] or 0, s["n2"] or 0
        if n1 < 2 or n2 < 2:
            return None
        n = n1 + n2
        u = s["r1"] - n1 * (n1 + 1) / 2
        var = n1 * n2 / 12 * (n + 1 - s["ties"] / (n * (n - 1)))
        gap = u - n1 * n2 / 2
        if continuity:
            gap = math.copysign(max(0.0, abs(gap) - 0.5), gap)
        z = gap / math.sqrt(var) if var > 0 else 0.0
        return {"test_type": "Mann-Whitney U", "u_statistic": u, "z_statistic": z, "p_value": p_value("pnorm", z, alternative), "alternative": alternative, "rank_biserial": 1 - 2 * u / (n1 * n2)}

    return aggregate(ranked, by, stats, finish, MWU)


WILCOXON = "test_type string, w_statistic double, z_statistic double, p_value double, alternative string, effect_size_r double"


def wilcoxon_signed_rank(df: DataFrame, x, y, alternative: str = "two-sided", continuity: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Signed-rank test of complete pairs; zero differences drop out."""
    check_alternative(alternative)
    rows = df.select(*by, (num(x) - num(y)).alias("_d")).where("_d is not null and _d != 0")
    table = rows.groupBy(*by, F.abs("_d").alias("value")).agg(F.count_if(F.col("_d") > 0).alias("a"), F.count(F.lit(1)).alias("t"))
    ranked = prefix_sums(table, by, "value", ["t"])
    t = F.col("t").cast("double")
    stats = {"w": F.sum(F.col("a") * (F.col("before_t") + (t + 1) / 2)), "n": F.sum("t"), "ties": F.sum(t * t * t - t)}

    def finish(s):
        n = s["n"] or 0
        if n < 2:
            return None
        gap = s["w"] - n * (n + 1) / 4
        var = n * (n + 1) * (2 * n + 1) / 24 - s["ties"] / 48
        if continuity:
            gap = math.copysign(max(0.0, abs(gap) - 0.5), gap)
        z = gap / math.sqrt(var) if var > 0 else 0.0
        return {"test_type": "Wilcoxon Signed-Rank", "w_statistic": s["w"], "z_statistic": z, "p_value": p_value("pnorm", z, alternative), "alternative": alternative, "effect_size_r": z / math.sqrt(n)}

    return aggregate(ranked, by, stats, finish, WILCOXON)


SPEARMAN = "test_type string, rho double, t_statistic double, df double, p_value double, alternative string, ci_lower double, ci_upper double, n bigint"


def spearman_test(df: DataFrame, x, y, alpha: float = 0.05, alternative: str = "two-sided", by: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation: midranks of each column, then Pearson."""
    check_alpha(alpha), check_alternative(alternative)
    pairs = df.select(*by, clean(x).alias("_x"), clean(y).alias("_y")).where("_x is not null and _y is not null")
    pairs = written(pairs.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("w")), "pairs")
    for c in ("_x", "_y"):
        table = written(pairs.groupBy(*by, c).agg(F.sum("w").alias("t")), "counts")
        rows = table.count()
        ranked = prefix_sums(table, by, c, ["t"], rows).select(*by, c, (F.col("before_t") + (F.col("t") + 1) / 2).alias(f"r{c}"))
        # keys may be null; a value that many pairs share needs no shuffle while the ranks are few
        keys = [F.col(f"p.`{k}`").eqNullSafe(F.col(f"q.`{k}`")) for k in [*by, c]]
        kept = [F.col(f"p.`{k}`") for k in pairs.columns]
        pairs = pairs.alias("p").join(small(ranked, rows).alias("q"), keys).select(*kept, F.col(f"q.r{c}"))
    w, a, b = (F.col(k).cast("double") for k in ("w", "r_x", "r_y"))
    # central sums: the mean rank is (n + 1) / 2 in both columns
    stats = {"n": F.sum("w"), "ab": F.sum(w * a * b), "aa": F.sum(w * a * a), "bb": F.sum(w * b * b)}

    def finish(s):
        n = s["n"] or 0
        if n < 3:
            return None
        centre = n * ((n + 1) / 2) ** 2
        va, vb = s["aa"] - centre, s["bb"] - centre
        if va <= 1e-9 or vb <= 1e-9:
            return None
        r = max(-1.0, min(1.0, (s["ab"] - centre) / math.sqrt(va * vb)))
        return correlation_result("Spearman Correlation", "rho", r, n, alpha, alternative)

    return aggregate(pairs, by, stats, finish, SPEARMAN)


KENDALL = "test_type string, tau double, z_statistic double, p_value double, alternative string, n bigint"


def concordance(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Weighted pairs with x and y in the same order, less those in opposite order.

    Ranks of x are split bit by bit: two points of different x fall into sibling
    halves at exactly one bit, where sums in the order of y count them.
    """
    order = np.argsort(y, kind="stable")
    x, y = np.unique(x, return_inverse=True)[1][order], np.unique(y, return_inverse=True)[1][order]
    weight, total = weight[order].astype(np.longdouble), np.longdouble(0)
    for bit in range(int(x.max()).bit_length()):
        half = x >> (bit + 1)
        at = np.argsort(half, kind="stable")  # halves one after the other, each in the order of y
        h, v, w = half[at], y[at], weight[at]
        right = (x[at] >> bit & 1).astype(bool)
        upto = np.concatenate([[0], np.cumsum(np.where(right, 0, w))])
        place = np.arange(len(h))
        new_half = np.concatenate([[True], h[1:] != h[:-1]])
        new_tie = new_half | np.concatenate([[True], v[1:] != v[:-1]])
        first = np.maximum.accumulate(np.where(new_half, place, 0))
        last = np.append(np.flatnonzero(new_half)[1:], len(h))[np.cumsum(new_half) - 1]
        tie = np.maximum.accumulate(np.where(new_tie, place, 0))
        tie_end = np.append(np.flatnonzero(new_tie)[1:], len(h))[np.cumsum(new_tie) - 1]
        below, above = upto[tie] - upto[first], upto[last] - upto[tie_end]
        total += (w * (below - above))[right].sum()
    return float(total)


def _concordance(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``_s``: concordant less discordant pairs, in one or several rows of each group.

    ``pairs`` holds _x, _y and their count _c. The values of x are cut into
    ordered blocks of about RANGE_ROWS rows; pairs within a block are counted in
    a task. An x with more rows than that is a block of its own and has no such
    pairs. Pairs of different blocks are counted at the bit of the block number
    that tells them apart, by prefix sums over y.
    """
    xs = pairs.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_m"))
    xs = prefix_sums(xs, by, "_x", ["_m"])
    block = F.expr(f"2 * (before__m div {RANGE_ROWS})") + (F.col("_m") >= RANGE_ROWS).cast("bigint")
    rows = written(joined(pairs, xs.select(*by, "_x", block.alias("_block")), [*by, "_x"], "inner"), "blocks")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by, "_block").schema)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        s = concordance(part["_x"].to_numpy(), part["_y"].to_numpy(), part["_c"].to_numpy())
        return pd.DataFrame({**{k: [v] for k, v in zip([*by, "_block"], key)}, "_s": [s]})

    within = rows.where("_block % 2 = 0").groupBy(*by, "_block").applyInPandas(run, f"{fields}, _s double").select(*by, "_s")
    bits = (rows.agg(F.max("_block")).first()[0] or 0).bit_length()
    if not bits:
        return within
    # a row is left or right of a split at each bit
    split = rows.withColumn("_bit", F.explode(F.array(*map(F.lit, range(bits)))))
    part, side = F.expr("shiftright(_block, _bit + 1)"), F.expr("shiftright(_block, _bit) & 1")
    split = split.groupBy(*by, "_bit", part.alias("_part"), "_y").agg(F.sum(F.when(side == 0, F.col("_c")).otherwise(0)).alias("_l"), F.sum(F.when(side == 1, F.col("_c")).otherwise(0)).alias("_r"))
    split = prefix_sums(split, [*by, "_bit", "_part"], "_y", ["_l"])
    long = lambda c: F.col(c).cast("decimal(18,0)")
    sums = split.groupBy(*by, "_bit", "_part").agg(
        F.sum(long("_r") * (2 * F.col("before__l") + F.col("_l")).cast("decimal(19,0)")).alias("_a"), F.sum("_l").alias("_l"), F.sum("_r").alias("_r")
    )
    across = sums.select(*by, (F.col("_a") - long("_l") * F.col("_r").cast("decimal(19,0)")).cast("double").alias("_s"))
    return within.unionByName(across)


def kendall_test(df: DataFrame, x, y, alternative: str = "two-sided", by: Sequence[str] = ()) -> DataFrame:
    """Kendall tau-b from counted (x, y), with the variance for ties; no task holds a group."""
    check_alternative(alternative)
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    pairs = df.select(*by, clean(x).alias("_x"), clean(y).alias("_y")).select(*by, *[F.when(both, F.col(c)).alias(c) for c in ("_x", "_y")])
    pairs = written(pairs.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_c")), "pairs")
    full = pairs.where("_x is not null")
    parts = pairs.groupBy(*by).agg(F.sum(F.when(F.col("_x").isNotNull(), F.col("_c")).otherwise(0)).alias("_n"))
    t = F.col("_t").cast("double")
    for c in ("x", "y"):
        ties = full.groupBy(*by, f"_{c}").agg(F.sum("_c").alias("_t")).where("_t > 1")
        ties = ties.groupBy(*by).agg(F.sum(t * (t - 1) / 2).alias(f"_p{c}"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"_v{c}"), F.sum(t * (t - 1) * (t - 2)).alias(f"_w{c}"))
        parts = parts.unionByName(ties, allowMissingColumns=True)
    parts = parts.unionByName(_concordance(full, by), allowMissingColumns=True)
    names = ["n", "s", "px", "vx", "wx", "py", "vy", "wy"]

    def finish(found):
        n, s, px, vx, wx, py, vy, wy = (found[k] or 0 for k in names)
        if n < 3:
            return None
        whole = n * (n - 1) / 2
        scale = math.sqrt((whole - px) * (whole - py))
        if not scale:
            return None
        var = (n * (n - 1) * (2 * n + 5) - vx - vy) / 18 + px * py * 4 / (2 * n * (n - 1)) + wx * wy / (9 * n * (n - 1) * (n - 2))
        z = s / math.sqrt(var) if var > 0 else 0.0
        return {"test_type": "Kendall tau-b", "tau": s / scale, "z_statistic": z, "p_value": p_value("pnorm", z, alternative), "alternative": alternative, "n": n}

    return aggregate(parts, by, {k: F.sum(f"_{k}") for k in names}, finish, KENDALL)


KS1 = "test_type string, d_statistic double, p_value double, n bigint"
KS2 = "test_type string, d_statistic double, p_value double, n_x bigint, n_y bigint"


def kolmogorov_p(d: float, n: float) -> float:
    """Kolmogorov's tail with Stephens' small-sample factor."""
    lam = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    if lam < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))))


def ks_test_2samp(df: DataFrame, x, y, by: Sequence[str] = ()) -> DataFrame:
    """Largest gap of two empirical distribution functions."""
    table = written(two_samples(df, clean(x), clean(y), by), "counts")
    sizes = table.groupBy(*by).agg(F.sum("a").alias("_nx"), F.sum("b").alias("_ny"))
    ranked = prefix_sums(table, by, "value", ["a", "b"], table.count())
    ranked = joined(ranked, sizes, by, "inner")
    upto = lambda s, n: F.try_divide(F.col(f"before_{s}") + F.col(s), F.col(n))
    stats = {"d": F.max(F.abs(upto("a", "_nx") - upto("b", "_ny"))), "nx": F.max("_nx"), "ny": F.max("_ny")}

    def finish(s):
        if not s["nx"] or not s["ny"]:
            return None
        p = kolmogorov_p(s["d"], s["nx"] * s["ny"] / (s["nx"] + s["ny"]))
        return {"test_type": "Kolmogorov-Smirnov (two-sample)", "d_statistic": s["d"], "p_value": p, "n_x": s["nx"], "n_y": s["ny"]}

    return aggregate(ranked, by, stats, finish, KS2)


def _against_normal(df: DataFrame, x, by: Sequence[str]) -> DataFrame:
    """value, t, before_t and the group's _n, _m, _s."""
    rows = df.select(*by, clean(x).alias("value")).where("value is not null")
    table = rows.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("t"))
    # of the rows, not of the counted values, as sums of squares round
    moments = rows.groupBy(*by).agg(F.count("value").alias("_n"), F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    ranked = prefix_sums(table, by, "value", ["t"])
    return joined(ranked, moments, by, "inner")


def ks_test_1samp(df: DataFrame, x, by: Sequence[str] = ()) -> DataFrame:
    """Gap between the empirical distribution and the fitted normal."""
    from ..functions.columns import d

    rows = _against_normal(df, x, by)
    z = F.try_divide(F.col("value") - F.col("_m"), F.col("_s"))
    rows = rows.withColumn("_f", d("pnorm", z, 0.0, 1.0))
    gap = F.greatest((F.col("before_t") + F.col("t")) / F.col("_n") - F.col("_f"), F.col("_f") - F.col("before_t") / F.col("_n"))

    def finish(s):
        if not s["n"] or s["n"] < 3 or not s["s"]:
            return None
        return {"test_type": "Kolmogorov-Smirnov (one-sample, fitted normal)", "d_statistic": s["d"], "p_value": kolmogorov_p(s["d"], s["n"]), "n": s["n"]}

    return aggregate(rows, by, {"d": F.max(gap), "n": F.max("_n"), "s": F.max("_s")}, finish, KS1)


AD = "test_type string, a_squared double, a_squared_adjusted double, p_value double, n bigint"


def anderson_p(a: float) -> float:
    """Stephens' four segments for the adjusted statistic, within [0, 1].

    The upper one turns upwards at 153 and reaches 1 near 307, in the reference too.
    """
    if a >= 0.6:
        p = math.exp(min(0.0, 1.2937 - 5.709 * a + 0.0186 * a * a))  # exp overflows from 402 on
    elif a > 0.34:
        p = math.exp(0.9177 - 4.279 * a - 1.38 * a * a)
    elif a > 0.2:
        p = 1 - math.exp(-8.318 + 42.796 * a - 59.938 * a * a)
    else:
        p = 1 - math.exp(-13.436 + 101.14 * a - 223.73 * a * a)
    return max(0.0, min(1.0, p))


def anderson_darling(df: DataFrame, x, by: Sequence[str] = ()) -> DataFrame:
    """Anderson-Darling against the fitted normal.

    With F(z) of a value met t times after b smaller ones among n, the sum of
    (2i - 1) log F is t (2b + t) log F, and that of the mirrored term
    t (2(n - b) - t) log(1 - F); no ordering of single rows is needed.
    """
    from ..functions.columns import d

    rows = _against_normal(df, x, by)
    z = F.try_divide(F.col("value") - F.col("_m"), F.col("_s"))
    tiny = 2.2250738585072014e-308
    low = F.log(F.greatest(d("pnorm", z, 0.0, 1.0), F.lit(tiny)))
    high = F.log(F.greatest(d("pnorm", -z, 0.0, 1.0), F.lit(tiny)))
    t, b, n = (F.col(c).cast("double") for c in ("t", "before_t", "_n"))
    stats = {"s": F.sum(t * (2 * b + t) * low + t * (2 * (n - b) - t) * high), "n": F.max("_n"), "sd": F.max("_s")}

    def finish(s):
        n = s["n"] or 0
        if n < 8 or not s["sd"]:
            return None
        a = -n - s["s"] / n
        adjusted = a * (1 + 0.75 / n + 2.25 / (n * n))
        return {"test_type": "Anderson-Darling", "a_squared": a, "a_squared_adjusted": adjusted, "p_value": anderson_p(adjusted), "n": n}

    return aggregate(rows, by, stats, finish, AD)


SW = "test_type string, w_statistic double, p_value double, n bigint"
# Polynomial coefficients of Royston's AS R94, constant term first.
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_C3 = (0.544, -0.39978, 0.025054, -6.714e-4)
_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
_C6 = (-0.4803, -0.082676, 0.0030302)
_G = (-2.273, 0.459)
MAX_SHAPIRO = 5000


def shapiro(values: np.ndarray) -> tuple[float, float] | None:
    """(W, p) for 3 to 5000 values; None otherwise."""
    from ..functions.distributions import pnorm, qnorm

    x = np.sort(values)
    n = len(x)
    if not 3 <= n <= MAX_SHAPIRO:
        return None
    if x[-1] - x[0] == 0:
        return 1.0, 1.0
    poly = lambda c, u: sum(v * u**i for i, v in enumerate(c))
    m = qnorm((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    a = np.zeros(n)
    if n == 3:
        a[:] = -math.sqrt(0.5), 0.0, math.sqrt(0.5)
    else:
        mm, u = float(m @ m), 1 / math.sqrt(n)
        last = m[-1] / math.sqrt(mm) + poly(_C1, u)
        if n > 5:
            second = m[-2] / math.sqrt(mm) + poly(_C2, u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1], a[-2] = -second, second
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    centred = x - x.mean()
    w = min(1.0, float(a @ x) ** 2 / float(centred @ centred))
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, min(1.0, p))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = poly(_G, n)
        if y >= gamma:
            return w, 1e-99
        y, mu, sigma = -math.log(gamma - y), poly(_C3, n), math.exp(poly(_C4, n))
    else:
        u = math.log(n)
        mu, sigma = poly(_C5, u), math.exp(poly(_C6, u))
    return w, float(pnorm(-(y - mu) / sigma))


def shapiro_wilk(df: DataFrame, x, by: Sequence[str] = ()) -> DataFrame:
    """Shapiro-Wilk for groups of 3 to 5000 values; larger groups are counted and NULL, never gathered."""
    rows = df.select(*by, clean(x).alias("_x"))
    sizes = rows.groupBy(*by).agg(F.count("_x").alias("_n"))
    fit = sizes.where(F.col("_n").between(3, MAX_SHAPIRO))
    live = rows.where("_x is not null")
    live = joined(live, fit, by, "inner")
    lists = live.groupBy(*by).agg(F.collect_list("_x").alias("_v"))  # at most 5000 values each
    both = joined(sizes, lists, by)

    def finish(s):
        found = shapiro(np.array(s["v"], float)) if s["v"] else None
        return found and {"test_type": "Shapiro-Wilk", "w_statistic": found[0], "p_value": found[1], "n": s["n"]}

    return finalize(both, by, ["n", "v"], finish, SW)

"""Descriptive statistics, bins, bootstrap, dataset profiles, correlation matrices and Table 1."""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranks
from .common import clean, finalize, joined, small, written
from .ranks import kendall_test, prefix_sums, spearman_test

SUMMARY = (
    "n bigint, n_missing bigint, mean double, sd double, variance double, min double, q1 double, median double, q3 double, max double, "
    "iqr double, skewness double, kurtosis double, mode double, mode_frequency bigint, is_multimodal boolean"
)


def _counts(x: Column, by: Sequence[str], df: DataFrame) -> DataFrame:
    """value and t, how often it occurs: written once, for quantiles and modes."""
    rows = df.select(*by, x.alias("value")).where("value is not null")
    return written(rows.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("t")), "counts")


def quantiles(counts: DataFrame, by: Sequence[str], kind: int = 7, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``_q``: exact quantiles of type 5 or 7 of each group from its counted values.

    Prefix sums find the values at the places asked for, so no task holds a
    group's values.
    """
    rows = counts.count()
    n = counts.groupBy(*by).agg(F.sum("t").alias("_n"))
    ranked = prefix_sums(counts, by, "value", ["t"], rows)
    ranked = joined(ranked, small(n, rows) if by else n, by, "inner")
    stats = []
    for q in probs:
        n = F.col("_n").cast("double")
        pos = F.greatest(F.lit(1.0), F.least(n, n * q + 0.5)) if kind == 5 else 1 + (n - 1) * q
        at = lambda p: F.max(F.when((F.col("before_t") < p) & (F.col("before_t") + F.col("t") >= p), F.col("value")))
        low, high, part = at(F.floor(pos)), at(F.ceil(pos)), F.max(pos - F.floor(pos))
        stats.append(low + (high - low) * part)
    return ranked.groupBy(*by).agg(F.array(*stats).alias("_q"))


def summary_stats(df: DataFrame, x, bias_correction: bool = True, quantile_type: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Moments, quartiles and mode of each group; NULL without values. NULL and NaN count as missing."""
    if quantile_type not in (5, 7):
        raise ValueError("quantile_type must be 5 (SAS) or 7")
    x = clean(x)
    stats = {
        "n": F.count(x), "all": F.count(F.lit(1)), "mean": F.avg(x), "v": F.var_samp(x), "min": F.min(x), "max": F.max(x),
        "g1": F.skewness(x), "g2": F.kurtosis(x),
    }
    base = df.groupBy(*by).agg(*[c.alias(f"_{k}") for k, c in stats.items()])
    counts = _counts(x, by, df)
    top = counts.groupBy(*by).agg(F.max(F.struct(F.col("t").alias("c"), (-F.col("value")).alias("v"))).alias("_top"))
    most = joined(counts, top, by, "inner")
    many = most.groupBy(*by).agg(F.first("_top").alias("_top"), F.count_if(F.col("t") == F.col("_top.c")).alias("_modes"))
    base = joined(joined(base, many, by), quantiles(counts, by, quantile_type), by)

    def finish(s):
        n = s["n"]
        if not n:
            return None
        var = s["v"] or 0.0
        g1 = g2 = math.nan
        if n >= 3 and var:
            g1 = s["g1"] * (math.sqrt(n * (n - 1)) / (n - 2) if bias_correction else 1)
        if n >= 4 and var:
            g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * s["g2"] + 6) if bias_correction else s["g2"]
        q, top = s["q"], s["top"]
        distinct = n > 1 and top["c"] == 1
        return {
            "n": n, "n_missing": s["all"] - n, "mean": s["mean"], "sd": math.sqrt(var), "variance": var, "min": s["min"], "q1": q[0],
            "median": q[1], "q3": q[2], "max": s["max"], "iqr": q[2] - q[0], "skewness": g1, "kurtosis": g2,
            "mode": math.nan if distinct else -top["v"] + 0.0, "mode_frequency": 0 if distinct else top["c"],
            "is_multimodal": not distinct and s["modes"] > 1,
        }

    return finalize(base, by, [*stats, "q", "top", "modes"], finish, SUMMARY)


BIN_METHODS = ("sturges", "fd", "scott", "sqrt", "rice", "auto")


def bin_edges(df: DataFrame, x, method: str = "sturges", by: Sequence[str] = ()) -> DataFrame:
    """``edges``: equal-width bin edges from the least to the largest value; NULL under two values."""
    method = method.lower()
    if method not in BIN_METHODS:
        raise ValueError(f"bin_edges: unknown method '{method}'")
    x = clean(x)
    stats = {"n": F.count(x), "low": F.min(x), "high": F.max(x), "sd": F.stddev_samp(x)}
    base = df.groupBy(*by).agg(*[c.alias(f"_{k}") for k, c in stats.items()])
    if method in ("fd", "auto"):
        base = joined(base, quantiles(_counts(x, by, df), by, 7, (0.25, 0.75)), by)
    else:
        base = base.withColumn("_q", F.lit(None).cast("array<double>"))

    def finish(s):
        n, low, high = s["n"], s["low"], s["high"]
        if n < 2:
            return None
        if low == high:
            return {"edges": [low, low]}
        sturges = math.ceil(math.log2(n) + 1)
        wide = lambda w: math.ceil((high - low) / w) if w > 0 else sturges
        fd = wide(2 * (s["q"][1] - s["q"][0]) * n ** (-1 / 3)) if s["q"] else sturges
        k = {
            "sturges": sturges, "fd": fd, "scott": wide(3.5 * s["sd"] * n ** (-1 / 3)), "sqrt": math.ceil(math.sqrt(n)),
            "rice": math.ceil(2 * n ** (1 / 3)), "auto": max(sturges, fd),
        }[method]
        k = max(1, k)
        return {"edges": [low + (high - low) * i / k for i in range(k)] + [high]}

    out = finalize(base, by, [*stats, "q"], finish, "edges array<double>")
    return out.select(*by, F.col("result.edges").alias("edges"))


def _moments(root: bool) -> Column:
    n, d = F.sum("n"), F.sum("d")
    v = F.when(n < 2, F.lit(math.nan)).otherwise(F.greatest((F.sum("dd") - d * d / n) / (n - 1), F.lit(0.0)))
    return F.sqrt(v) if root else v


#: Each statistic of a resample from what its ranges of values give: see :func:`_resample`.
BOOTSTRAP = {
    "mean": lambda: F.sum("total") / F.sum("n"), "median": lambda: (F.max("low") + F.max("high")) / 2, "sum": lambda: F.sum("total"),
    "stddev": lambda: _moments(True), "sd": lambda: _moments(True), "variance": lambda: _moments(False), "var": lambda: _moments(False),
    "min": lambda: F.min("least"), "max": lambda: F.max("most"),
}
RESAMPLED = "_i int, n bigint, total double, d double, dd double, least double, most double, low double, high double"


def _seeds(seed: int, key: tuple, *more: int) -> list[int]:
    return [seed & (2**63 - 1), int.from_bytes(hashlib.sha256(repr([str(k) for k in key]).encode()).digest()[:8], "little"), *more]


def _resample(seed: int, keys: Sequence[str]):
    """A function of one range of a group's values and the draws that fall into it in each iteration."""

    def run(key: tuple, values: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        values, draws = values.sort_values("value"), draws.sort_values("_i")
        v, share = values["value"].to_numpy(), values["t"].to_numpy() / max(1, values["t"].sum())
        rng, out = np.random.default_rng(_seeds(seed, key[:-1], 1, int(key[-1]))), []
        for i, k, start, n, centre in zip(*(draws[c].tolist() for c in ("_i", "_k", "_start", "_n", "_centre"))):
            if not k:
                continue
            c = rng.multinomial(k, share)
            u, c = v[c > 0], c[c > 0]
            ends = start + np.cumsum(c)
            low, high = (float(u[np.searchsorted(ends, r, "right")]) if start <= r < start + k else math.nan for r in ((n - 1) // 2, n // 2))
            d = u - centre
            out.append((i, k, float(c @ u), float(c @ d), float(c @ (d * d)), float(u[0]), float(u[-1]), low, high))
        found = pd.DataFrame(out, columns=[x.split()[0] for x in RESAMPLED.split(", ")]).astype({"_i": "int32", "n": "int64"})
        for name, k in zip(keys, key):
            found[name] = pd.Series([k] * len(found), dtype="object")
        return found

    return run


def bootstrap(df: DataFrame, x, statistic: str, n_iters: int, seed: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``replicates``: n_iters statistics of resamples with replacement, in each group.

    Values are counted and cut, in order, into ranges. Each iteration draws how
    many of its values fall into each range, a task for each group and run of
    iterations, then the counts of single values, a task for each range; what
    the ranges give is summed. A seeded result doesn't depend on partitions.
    """
    name = str(statistic).lower()
    if name not in BOOTSTRAP:
        raise ValueError(f"bootstrap: unknown statistic '{statistic}'")
    if n_iters <= 0:
        raise ValueError("'n_iters' must be > 0")
    if seed is None:
        seed = secrets.randbits(63)  # drawn here, so a repeated task draws the same
    keys = list(by) or ["_all"]
    rows = df.select(*by, clean(x).alias("value"), *([] if by else [F.lit(0).alias("_all")]))
    groups = rows.select(*keys).distinct()
    counts = written(rows.where("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("t"), F.lit(1).alias("u")), "counts")
    ranked = prefix_sums(counts, keys, "value", ["u"], counts.count())
    values = written(ranked.withColumn("_range", F.expr(f"before_u div {ranks.RANGE_ROWS}")).select(*keys, "_range", "value", "t"), "ranges")
    sizes = values.groupBy(*keys, "_range").agg(F.sum("t").alias("t"), F.sum(F.col("value") * F.col("t")).alias("s")).groupBy(*keys)
    centre = F.try_divide(F.sum("s"), F.sum("t"))
    sizes = sizes.agg(F.sort_array(F.collect_list(F.struct("_range", "t"))).alias("_sizes"), F.when(F.abs(centre) < math.inf, centre).otherwise(0.0).alias("_centre"))
    step = max(1, n_iters // 64)
    sizes = sizes.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(n_iters - 1), F.lit(step))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def allot(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        first, ranges = int(key[-1]), part["_sizes"].iloc[0]
        t = np.array([r["t"] for r in ranges], np.int64)
        n, rng = int(t.sum()), np.random.default_rng(_seeds(seed, key[:-1], 0, first))
        draws = rng.multinomial(n, t / n, min(step, n_iters - first))
        start = np.cumsum(draws, 1) - draws
        m = len(t)
        out = pd.DataFrame({"_range": np.tile(np.arange(m), len(draws)), "_i": np.repeat(np.arange(first, first + len(draws)), m), "_k": draws.ravel(), "_start": start.ravel(), "_n": n, "_centre": part["_centre"].iloc[0]})
        for name, k in zip(keys, key):
            out[name] = pd.Series([k] * len(out), dtype="object")
        return out

    draws = sizes.groupBy(*keys, "_first").applyInPandas(allot, f"_range bigint, _i int, _k bigint, _start bigint, _n bigint, _centre double, {fields}")
    within = [*keys, "_range"]
    found = values.groupBy(*within).cogroup(draws.groupBy(*within)).applyInPandas(_resample(seed, keys), f"{RESAMPLED}, {fields}")
    found = found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("low", "high")})
    found = found.groupBy(*keys, "_i").agg(BOOTSTRAP[name]().alias("_v")).groupBy(*keys)
    found = found.agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda r: r["_v"]).alias("replicates"))
    return joined(groups, found, keys).select(*by, "replicates")


# SQL names of Spark types.
_NAMES = {
    "byte": "TINYINT", "short": "SMALLINT", "integer": "INTEGER", "long": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "binary": "BLOB",
}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.StringType):
        return "categorical"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) or t.typeName().startswith("time"):
        return "temporal"
    return "boolean" if isinstance(t, T.BooleanType) else "other"


META = (
    "column_name string, column_type string, kind string, n_rows bigint, n_missing bigint, n_distinct bigint, min double, p25 double, "
    "median double, p75 double, max double, mean double, stddev double, top string, top_freq bigint"
)


def meta(df: DataFrame) -> DataFrame:
    """A row for each column: one wide aggregation of moments, and one count of every column's values.

    The counts give distinct values, quantiles and modes, so no task holds a
    column's values.
    """
    fields = df.schema.fields
    entries, aggs, cells = [], [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(fields):
        c, kind = F.col(f"`{f.name}`"), kind_of(f.dataType)
        floating = isinstance(f.dataType, (T.FloatType, T.DoubleType))
        missing = c.isNull() | F.isnan(c) if floating else c.isNull()
        present = F.when(~missing, c + F.lit(0.0).cast(f.dataType) if floating else c)  # no negative zero
        aggs.append(F.count_if(missing).alias(f"m{i}"))
        null = F.lit(None).cast("double")
        numbers, x = [null] * 4, null
        if kind == "numeric":
            x = present.cast("double")
            aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.avg(x).alias(f"e{i}"), F.stddev_samp(x).alias(f"s{i}")]
            numbers = [F.col(f"{k}{i}") for k in "abes"]
        text = F.hex(present) if isinstance(f.dataType, T.BinaryType) else present.cast("string")
        cells.append(F.struct(F.lit(i).alias("i"), text.alias("v"), x.alias("value")))
        name = _NAMES.get(f.dataType.typeName(), f.dataType.simpleString().upper())
        entries.append(F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column_name"), F.lit(name).alias("column_type"), F.lit(kind).alias("kind"), F.col("n").alias("n_rows"), F.col(f"m{i}").alias("n_missing"), *[v.alias(k) for v, k in zip(numbers, ("min", "max", "mean", "stddev"))]))
    wide = df.agg(*aggs).select(F.inline(F.array(*entries)))
    counts = df.select(F.inline(F.array(*cells))).where("v is not null").groupBy("i", "v", "value").agg(F.count(F.lit(1)).alias("t"))
    counts = written(counts, "values")
    texts = F.lit(False)
    for i, f in enumerate(fields):
        if kind_of(f.dataType) in ("categorical", "boolean"):
            texts = texts | (F.col("i") == i)
    top = F.min(F.when(texts, F.struct((-F.col("t")).alias("c"), "v")))
    found = counts.groupBy("i").agg(F.count(F.lit(1)).alias("n_distinct"), top.alias("top_"))
    numeric = counts.where("value is not null").groupBy("i", "value").agg(F.sum("t").alias("t"))
    found = found.join(quantiles(written(numeric, "counts"), ["i"]), "i", "left")
    out = wide.join(F.broadcast(found), "i", "left").orderBy("i")  # a row for each column
    return out.select(
        "column_name", "column_type", "kind", "n_rows", "n_missing", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"), "min",
        *[F.col("_q")[k].alias(name) for k, name in enumerate(("p25", "median", "p75"))], "max", "mean", "stddev",
        F.col("top_.v").alias("top"), (-F.col("top_.c")).alias("top_freq"),
    )


CORR = "row_var string, col_var string, coef double, p_value double, n bigint"


def _numeric_columns(df: DataFrame, variables: Sequence[str] | None, at_least: int, what: str) -> list[str]:
    if variables is None:
        raise ValueError(f"{what}: 'variables' list is required")
    if len(variables) < at_least:
        raise ValueError(f"{what}: 'variables' must not be empty" if not variables and at_least < 2 else f"{what}: 'variables' needs at least {at_least} columns")
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    for v in variables:
        if v not in kinds:
            raise ValueError(f"{what}: column '{v}' not found in table")
        if kinds[v] != "numeric":
            raise ValueError(f"{what}: column '{v}' is not numeric")
    return list(variables)


def corr_matrix(df: DataFrame, variables: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Long correlation matrix; all pairs of the upper triangle share one plan."""
    names = _numeric_columns(df, variables, 2, "corr_matrix")
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"corr_matrix: unknown method '{method}'")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]

    if method == "pearson":
        aggs = []
        for i, j in pairs:
            x, y = clean(f"`{names[i]}`"), clean(f"`{names[j]}`")
            both = x.isNotNull() & y.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
            aggs.append(F.struct(F.count(x).alias("n"), F.covar_samp(x, y).alias("c"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy")).alias(f"p{i}_{j}"))
        from .hypothesis import correlation_result

        def finish(row):
            out = []
            for i, j in pairs:
                s = row[f"p{i}_{j}"]
                found = (None, None, None)
                if s["n"] >= 3 and s["vx"] and s["vy"]:
                    r = max(-1.0, min(1.0, s["c"] / math.sqrt(s["vx"] * s["vy"])))
                    c = correlation_result("", "r", r, s["n"], 0.05, "two-sided")
                    found = (r, c["p_value"], s["n"])
                out += [(a, b, *found) for a, b in {(i, j): 1, (j, i): 1}]
            return [(names[a], names[b], *v) for a, b, *v in sorted(out, key=lambda x: x[:2])]

        wide = df.agg(*aggs)
        return wide.select(F.inline(F.udf(finish, f"array<struct<{CORR.replace(' ', ':').replace(',:', ',')}>>")(F.struct("*"))))
    test, field = (spearman_test, "rho") if method == "spearman" else (kendall_test, "tau")
    # all pairs as groups of one plan; a pair without rows keeps its place
    place = lambda i, j: [F.lit(i).alias("i"), F.lit(j).alias("j")]
    cells = [F.struct(*place(i, j), clean(f"`{names[i]}`").alias("x"), clean(f"`{names[j]}`").alias("y")) for i, j in pairs]
    found = test(df.select(F.inline(F.array(*cells))), "x", "y", by=["i", "j"])
    grid = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*place(i, j)) for i, j in pairs])))
    found = joined(grid, found, ["i", "j"]).select("i", "j", F.col(f"result.{field}").alias("coef"), "result.p_value", "result.n")
    both = [F.struct(F.col(a).alias("i"), F.col(b).alias("j"), "coef", "p_value", "n") for a, b in (("i", "j"), ("j", "i"))]
    out = found.select(F.inline(F.when(F.col("i") == F.col("j"), F.array(both[0])).otherwise(F.array(*both))))
    name = F.array(*[F.lit(n) for n in names])
    out = out.select("i", "j", name[F.col("i")].alias("row_var"), name[F.col("j")].alias("col_var"), "coef", "p_value", "n")
    return out.orderBy("i", "j").drop("i", "j")


def _validate_table_one(df, variables, by, force_categorical, force_numerical) -> dict[str, str]:
    if variables is None:
        raise ValueError("table_one: 'variables' list is required")
    if not variables:
        raise ValueError("table_one: 'variables' must not be empty")
    if any(v is None for v in [*variables, *by, *force_categorical, *force_numerical]):
        raise ValueError("table_one: lists must not hold NULL")
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    for v in [*variables, *by]:
        if v not in kinds:
            raise ValueError(f"table_one: column '{v}' not found in table")
    for v in [*force_categorical, *force_numerical]:
        if v not in variables:
            raise ValueError(f"table_one: '{v}' is not in 'variables'")
        if v in force_categorical and v in force_numerical:
            raise ValueError(f"table_one: '{v}' is listed in both force_categorical and force_numerical")
    return {v: "numeric" if v in force_numerical or kinds[v] == "numeric" and v not in force_categorical else "categorical" for v in variables}


TABLE_ONE = "variable string, level string, statistic string, stratum string, display string, p_value double, effect_size double"


def table_one(
    df: DataFrame, variables: Sequence[str] | None = None, by: Sequence[str] = (), force_categorical: Sequence[str] = (), force_numerical: Sequence[str] = ()
) -> DataFrame:
    """The "Table 1" report in long form.

    All variables of all strata are aggregated by grouping sets; displays use
    C-style rounding, so the small aggregated table is formatted in Python.
    """
    from .hypothesis import anova_oneway, chisq_independence

    kinds = _validate_table_one(df, variables, by, force_categorical, force_numerical)
    label = F.concat_ws(" / ", *[F.col(f"`{b}`").cast("string") for b in by]) if by else F.lit("Overall")
    rows = df if not by else df.where(" and ".join(f"`{b}` is not null" for b in by))
    parts = [df.withColumn("_s", F.struct(F.lit(0).alias("k"), F.lit("Overall").alias("l")))]
    if by:
        rows = rows.withColumn("_s", F.struct(F.lit(1).alias("k"), label.alias("l")))
        parts.append(rows)
    out = None
    for at, v in enumerate(variables):
        p = e = F.lit(None).cast("double")
        effect = None
        if by and kinds[v] == "numeric":
            effect = anova_oneway(rows, F.col(f"`{v}`"), F.col("_s.l")).select(F.col("result.p_value").alias("p_value"), F.col("result.eta_squared").alias("effect_size"))
        elif by:
            r = chisq_independence(rows, F.col(f"`{v}`"), F.col("_s.l")).select("result.*")
            v_ = F.sqrt(F.col("chi_square") / (F.col("n") * (F.least("n_rows", "n_cols") - 1)))
            effect = r.select("p_value", v_.alias("effect_size"))
        if kinds[v] == "numeric":
            whole = None
            for part in parts:
                one = summary_stats(part.withColumn("_v", F.col(f"`{v}`")), "_v", by=["_s"])
                totals = part.groupBy("_s").agg(F.count(F.lit(1)).alias("_rows"))
                one = one.join(totals, "_s")
                whole = one if whole is None else whole.unionByName(one)

            def lines(s, total):
                if s is None:
                    return [("n", "0"), ("missing", str(total)), ("mean (sd)", "."), ("median [q1, q3]", "."), ("min, max", ".")]
                f = lambda x: "%.1f" % x
                return [
                    ("n", str(s["n"])), ("missing", str(s["n_missing"])), ("mean (sd)", f"{f(s['mean'])} ({f(s['sd'])})"),
                    ("median [q1, q3]", f"{f(s['median'])} [{f(s['q1'])}, {f(s['q3'])}]"), ("min, max", f"{f(s['min'])}, {f(s['max'])}"),
                ]

            text = F.udf(lines, "array<struct<statistic:string,display:string>>")("result", "_rows")
            table = whole.select("_s", F.posexplode(text).alias("_o", "_x")).select("_s", F.col("_o").alias("_line"), F.lit(None).cast("string").alias("level"), "_x.statistic", "_x.display")
            table = table.withColumns({"_group": F.lit(0), "_lv": F.lit("")})
        else:
            whole = None
            for part in parts:
                c = F.col(f"`{v}`").cast("string")
                one = part.groupBy("_s", c.alias("level")).agg(F.count(F.lit(1)).alias("c"))
                whole = one if whole is None else whole.unionByName(one)
            totals = whole.groupBy("_s").agg(F.sum("c").alias("total"))
            levels = whole.where("level is not null").select("level").distinct().withColumn("m", F.lit(False))
            levels = levels.unionByName(df.sparkSession.createDataFrame([("Missing", True)], "level string, m boolean"))
            # every level in every stratum: a row for each reported cell
            grid = totals.withColumn("j", F.lit(0)).join(levels.withColumn("j", F.lit(0)), "j").drop("j")
            counted = whole.select("_s", F.coalesce("level", F.lit("Missing")).alias("level"), F.col("level").isNull().alias("m"), "c")
            table = grid.join(counted, ["_s", "level", "m"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
            show = F.udf(lambda c, t: "%.0f (%.1f%%)" % (c, 100.0 * c / t if t else 0.0), "string")
            table = table.select("_s", F.lit(0).alias("_line"), "level", F.lit("n (%)").alias("statistic"), show("c", "total").alias("display"), F.col("m").cast("int").alias("_group"), F.col("level").alias("_lv"))
        if effect is not None:
            table = table.join(F.broadcast(effect))  # one row
            p, e = F.col("p_value"), F.col("effect_size")
        table = table.select(
            F.lit(at).alias("_at"), "_s", "_group", "_lv", "_line", F.lit(v).alias("variable"), "level", "statistic", F.col("_s.l").alias("stratum"), "display",
            p.alias("p_value"), e.alias("effect_size"),
        )
        out = table if out is None else out.unionByName(table)
    return out.orderBy("_at", "_group", "_lv", "_line", "_s").select(*[x.split()[0] for x in TABLE_ONE.split(", ")])

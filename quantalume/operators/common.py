"""Shared pieces of the statistical operators.

Each operator aggregates sufficient statistics with built-in partial and final
aggregates; a finalizer sees one row per group and returns a struct or NULL.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import evaluate

ALTERNATIVES = ("two-sided", "less", "greater")


def check_alternative(alternative: str) -> None:
    if alternative not in ALTERNATIVES:
        raise ValueError("alternative must be 'two-sided', 'less', or 'greater'")


def check_alpha(alpha: float) -> None:
    if not isinstance(alpha, (int, float)) or not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1: alpha must be in the open interval (0, 1)")


def num(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def clean(x: str | Column) -> Column:
    """A number with NaN as NULL."""
    return F.nullif(num(x), F.lit(math.nan))


def cdf(name: str, *args: float) -> float:
    return float(evaluate(name, *args))


def p_value(name: str, stat: float, alternative: str, *params: float) -> float:
    """p of a statistic with a symmetric law, from the nearer tail, so small ones keep their digits."""
    if math.isnan(stat):
        return math.nan
    if alternative == "two-sided":
        return 2 * cdf(name, -abs(stat), *params)
    return cdf(name, stat if alternative == "less" else -stat, *params)


def upper_tail(name: str, stat: float, *params: float) -> float:
    """1 - F(stat) of chi-square ('chisq') and F ('f') without cancellation."""
    from ..functions import special

    if math.isnan(stat):
        return math.nan
    if stat <= 0:
        return 1.0
    if name == "chisq":
        return float(special.gamma_q(params[0] / 2, stat / 2))
    d1, d2 = params
    return 0.0 if math.isinf(stat) else float(special.beta_i(d2 / (d1 * stat + d2), d2 / 2, d1 / 2))


def divide(a: float, b: float) -> float:
    """IEEE division."""
    if b:
        return a / b
    return math.nan if a == 0 or a != a else math.copysign(math.inf, a)


def aggregate(df: DataFrame, by: Sequence[str], stats: dict[str, Column], finish: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """Group by ``by`` (all rows when empty), aggregate ``stats`` and finish into a struct column ``result``."""
    return finalize(df.groupBy(*by).agg(*[c.alias(f"_{k}") for k, c in stats.items()]), by, list(stats), finish, schema)


def finalize(grouped: DataFrame, by: Sequence[str], names: list[str], finish: Callable[[dict], dict | None], schema: str) -> DataFrame:
    def run(row):
        return finish({k: row[f"_{k}"] for k in names})

    struct = F.struct(*[F.col(f"_{k}") for k in names])
    return grouped.select(*by, F.udf(run, schema)(struct).alias("result"))


def flat(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The fields of ``result`` as columns."""
    return df.select(*by, "result.*")


def joined(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join on the group, whose columns may be null; without one ``b`` has one row."""
    if not by:
        return a.join(F.broadcast(b), F.lit(True), how)
    rest = [c for c in b.columns if c not in by]
    keys = [F.col(f"a_.`{k}`").eqNullSafe(F.col(f"b_.`{k}`")) for k in by]
    return a.alias("a_").join(b.alias("b_"), keys, how).select(*[F.col(f"a_.`{c}`") for c in a.columns], *[F.col(f"b_.`{c}`") for c in rest])


#: Rows of fixed size that one task sorts, or that are broadcast, after a count.
SMALL_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quantalume-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: it is computed once, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/quantalume/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df

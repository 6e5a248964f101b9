"""Temperature mixing of sources, in built-in expressions only.

Token shares p are raised to an exponent a: weights are p^a / sum p^a. The
exponent is bisected (many sections at a time, one small aggregation a round)
until the weights meet a target entropy or a repetition limit. The weights are
realised as whole passes over each source plus a last partial pass: the
source's hash blocks come in permuted order until its budget is met, and only
the block at the edge is taken document by document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_of, unused_name

_SECTIONS, _ROUNDS = 64, 4


def keyed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """source, n (words plus one end mark) and r (a hash) of each document: all that shares and blocks need of it."""
    n = (F.regexp_count(text_of(), F.lit(WORD)) + 1).cast("long")
    return docs.select("source", n.alias("n"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("r"))


def token_shares(rows: DataFrame) -> DataFrame:
    """source, tokens, rows of what :func:`keyed` gives."""
    # salted first, as one source may hold most rows
    part = rows.groupBy("source", F.pmod("r", F.lit(64)).alias("salt")).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    return part.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))


def _curve(totals: DataFrame, whole: int, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy of the weights, most over least repetition) for each exponent."""
    a, p = F.col("a"), F.col("tokens") / F.lit(float(whole))
    q = F.pow(p, a)
    grid = totals.select("tokens", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    got = grid.groupBy("a").agg(
        F.sum(q).alias("z"), F.sum(q * F.log(p)).alias("l"), F.max(F.pow(p, a - 1)).alias("most"), F.min(F.pow(p, a - 1)).alias("least")
    )
    rows = got.collect()  # a row for each exponent, whatever the sources
    return sorted((r["a"], math.log(r["z"]) - r["a"] * r["l"] / r["z"], r["most"] / r["least"]) for r in rows)


def find_exponent(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent in [0, 1] nearest to uniform weights (0) that keeps to the limits.

    Entropy (nats) and repetition both fall as the exponent grows to 1. With a
    target entropy: the largest exponent whose weights have it still. With a
    repetition limit (passes over the most repeated source per pass over the
    least): the least exponent that keeps it; the larger of both counts.
    """
    whole = totals.agg(F.sum("tokens")).first()[0]
    if not whole:
        return 1.0

    def section(good) -> tuple[float, float]:
        """Bounds (last not good, first good) of a condition that holds from some exponent on."""
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            curve = _curve(totals, whole, [low + (high - low) * i / _SECTIONS for i in range(_SECTIONS + 1)])
            at = next((i for i, c in enumerate(curve) if good(c)), len(curve) - 1)
            low, high = curve[max(0, at - 1)][0], curve[at][0]
            if at == 0:
                return low, low
        return low, high

    found = 0.0
    if target_entropy is not None:
        found = section(lambda c: c[1] < target_entropy)[0]
    if max_repeats is not None:
        found = max(found, section(lambda c: c[2] <= max_repeats)[1])
    return found


def temperature_mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget_tokens: int | None = None,
    seed: int = 11,
    block_rows: int = 10_000,
) -> DataFrame:
    """``docs`` repeated so that sources meet their weights; adds epoch (int), the pass over the source.

    Without ``budget_tokens`` the budget is the least at which no source is cut:
    the one repeated least is taken exactly once, so no document is lost. A
    given budget may cut sources. A source's last, partial pass stops before
    the document that would exceed its budget. A null source is a source of its
    own, null text counts as empty, repeated rows are rows, an empty table
    gives no rows; a column named epoch is replaced, others pass through.
    """
    docs = docs.drop("epoch")
    rows = materialize(keyed(docs, seed), "keyed")
    totals = materialize(token_shares(rows), "shares")
    exponent = find_exponent(totals, target_entropy, max_repeats)
    whole = totals.agg(F.sum("tokens")).first()[0] or 1
    p = F.col("tokens") / F.lit(float(whole))
    scale = totals.agg(F.sum(F.pow(p, F.lit(exponent))), F.max(F.pow(p, F.lit(1 - exponent)))).first()
    z, most = scale[0] or 1.0, scale[1] or 1.0
    budget = float(budget_tokens) if budget_tokens is not None else whole * z * most
    share = F.pow(p, F.lit(exponent)) / F.lit(z) * F.lit(budget)
    plan = totals.withColumn("due", F.round(share).cast("long")).withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int"))
    plan = plan.withColumn("passes", F.expr("cast(due div tokens as int)")).withColumn("rest", F.expr("due % tokens"))

    s, n, r, b = (unused_name(docs, x) for x in ("s_", "n_", "r_", "b_"))
    columns = docs.columns
    plan = plan.select(F.struct("source").alias(s), "blocks", "passes", "rest")
    plan = plan.select(s, F.struct("blocks", "passes", "rest").alias("plan_"))
    sources = plan.count()
    hint = F.broadcast if sources <= 100_000 else (lambda x: x)  # checked size; otherwise a shuffled join
    df = docs.withColumns({s: F.struct("source"), n: (F.regexp_count(text_of(), F.lit(WORD)) + 1).cast("long"), r: F.xxhash64("doc_id", "text", F.lit(seed))})
    p_ = unused_name(docs, "plan_")
    df = df.join(hint(plan.withColumnRenamed("plan_", p_)), s)
    df = df.withColumn(b, F.pmod(F.xxhash64(r, F.lit(1)), F.col(p_)["blocks"]).cast("int"))
    # what stands before each block, in block order; a row for each block
    blocks = rows.select(F.struct("source").alias(s), "n", "r").join(hint(plan.withColumnRenamed("plan_", p_)), s)
    blocks = blocks.groupBy(s, F.pmod(F.xxhash64("r", F.lit(1)), F.col(p_)["blocks"]).cast("int").alias(b)).agg(F.sum("n").alias("in_"))
    before = F.sum("in_").over(Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1))
    u = unused_name(docs, "before_")
    blocks = blocks.select(s, b, F.coalesce(before, F.lit(0)).alias(u))
    df = df.join(blocks, [s, b])
    upto = F.sum(n).over(Window.partitionBy(s, b).orderBy(r, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = unused_name(docs, "copies_")
    df = df.withColumn(c, F.col(p_)["passes"] + F.when(F.col(u) + upto <= F.col(p_)["rest"], 1).otherwise(0))
    df = df.where(F.col(c) > 0)
    return df.select(*[F.col(f"`{x}`") for x in columns], F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias("epoch"))

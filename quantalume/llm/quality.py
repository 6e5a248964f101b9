"""Quality rules as a short-circuit cascade, in built-in expressions only.

Each rule's cost and rejection rate are measured on a bounded sample; the rules
then run in order of rejections per cost inside one CASE, so a row that an
early rule rejects never reaches the later ones. The order changes the time
only: the verdict is the same for any.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_of, unused_name

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Base features; words come first so that later projections share the array.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_base(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    Null text counts as empty. Trigrams are compared by a 64-bit hash of the
    hashes of their words, sorted within the row, so a row costs n log n.
    """
    t, w, h, s = (unused_name(docs, x) for x in ("text_", "words_", "hashes_", "sorted_"))
    keep = docs.columns
    df = docs.withColumn(t, text_of())
    df = df.withColumn(w, F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    df = df.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    gram = lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i"))
    n = F.size(h)
    df = df.withColumn(s, F.when(n >= 3, F.sort_array(F.slice(F.transform(h, gram), 1, F.greatest(n - 2, F.lit(0))))))
    again = F.filter(
        s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    d = unused_name(docs, "lines_")
    df = df.withColumn(d, lines)
    return df.select(
        *[F.col(f"`{c}`") for c in keep],
        n.cast("long").alias("n_words"),
        F.length(F.translate(t, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(d) - F.size(F.array_distinct(d))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """What rejects a row, as expressions over text and the base features."""
    text = text_of()
    words = F.col("n_words")
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    upper = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    bare = F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0Da-zA-Z\x{80}-\x{10FFFF}]+(?![^\x20\x09-\x0D])"))
    lines = F.size(F.split(text, "\n"))
    dots = F.regexp_count(text, F.lit(r"(?m)(\.\.\.|…)$"))
    return {
        "symbols": F.col("n_symbols") * 10 > words,
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 15 * words),
        "repeated_lines": F.col("n_dup_lines") * 2 > lines,
        "capitals": upper * 2 > F.col("word_chars"),
        "exclamations": count("!") * 5 > words,
        "bare_words": bare * 10 > words * 3,
        "ellipses": dots * 10 > lines * 3,
    }


def base_rule() -> Column:
    """What fails the base: under 50 words, or over half of the words in repeated trigrams."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measured_costs(sample: DataFrame, found: dict[str, Column], repeats: int = 3) -> dict[str, float]:
    """Seconds that each rule takes over ``sample``: its least run, less the least run without a rule."""

    def least(rule: Column) -> float:
        times = []
        for _ in range(repeats):
            began = time.perf_counter()
            sample.agg(F.count_if(rule)).first()
            times.append(time.perf_counter() - began)
        return min(times)

    empty = least(F.col("n_words") < 0)
    return {name: max(1e-4, least(F.coalesce(rule, F.lit(False))) - empty) for name, rule in found.items()}


def cascade_order(rejections: list[tuple[list[str], int]], costs: dict[str, float]) -> list[str]:
    """Rules by rejections per cost, each counted on what the base and the rules before it leave.

    ``rejections`` holds how many rows exactly these rules reject.
    """
    order: list[str] = []
    while len(order) < len(costs):
        left = [(names, n) for names, n in rejections if not set(names) & set(order)]
        rate = {k: (sum(n for names, n in left if k in names) + 0.5) / costs[k] for k in costs if k not in order}
        order.append(min(rate, key=lambda k: (-rate[k], k)))
    return order


def quality_cascade(docs: DataFrame, sample_rows: int = 2000) -> DataFrame:
    """Add the base features, base_failed, kept and failed_rule to ``docs``.

    base_failed: under 50 words, or over half of the words in repeated trigrams.
    kept is false if base_failed, else true where no rule of the cascade
    rejects. failed_rule names the first rule that did ('base' for the base), else
    null; which of several is first follows the measured order. Null and empty texts fail the base; nulls elsewhere and extra columns
    pass through (columns named like the features are replaced); repeated rows
    get equal values. The sample holds ``sample_rows`` rows at most.
    """
    docs = docs.drop(*BASE, "base_failed", "kept", "failed_rule")
    found = rules()
    total = docs.count()
    order = list(found)
    if total:
        part = docs.select("text").sample(min(1.0, 1.5 * sample_rows / total), seed=7).limit(sample_rows)
        sample = materialize(with_base(part), "quality-sample")
        hit = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in found.items()]))
        rows = sample.where(~base_rule()).groupBy(hit.alias("names")).count().collect()  # at most 2^rules rows
        order = cascade_order([(r["names"], r["count"]) for r in rows], measured_costs(sample, found))
    verdict = F.when(base_rule(), F.lit("base"))
    for name in order:
        verdict = verdict.when(found[name], F.lit(name))
    df = with_base(docs).withColumn("failed_rule", verdict)
    return df.withColumn("base_failed", F.coalesce(F.col("failed_rule") == "base", F.lit(False))).withColumn("kept", F.col("failed_rule").isNull())

"""Toxic passages by maximum-scoring segment search.

Tokens score their log-odds of toxic against clean documents, shrunk by a
Dirichlet prior; all others score a small negative number. A linear-time scan
finds all maximal scoring segments. How likely a segment's score is by chance
follows the extreme-value law of such scans (scale lambda from the token
frequencies of clean text, location growing with log length); a logistic
calibration turns it into a probability. It is fitted on features that come
from the other folds' lexicon, so all training rows serve both.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[^\W\d_]+")
#: Bound on the labelled rows a model is fitted on: those of least hash.
MAX_TRAIN = 20_000
NEUTRAL = -0.1
FOLDS = 5
#: Evidence (standard errors of the log-odds) a token needs; cross-fitting picks one of these.
EVIDENCE = (5.0, 4.5, 4.0, 3.6, 3.3, 3.0, 2.5, 2.0, 1.64)
PRIOR = 0.5
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def maximal_segments(scored: list[tuple[int, float]], neutral: float = NEUTRAL) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a token sequence in linear time.

    ``scored`` holds (position, score > 0) of the scoring tokens in order; every
    other token scores ``neutral`` < 0. Each candidate keeps the running total
    before and after it; it merges back to the nearest one that starts lower.
    Candidates that don't start lower than a later one are never looked at
    again, so each is passed over once.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    open_: list[int] = []  # indices into found, totals before ascending
    total, last = 0.0, -1
    for at, score in scored:
        total += neutral * (at - last - 1)
        first, before = at, total
        total, last = total + score, at
        while True:
            while open_ and found[open_[-1]][2] >= before:
                open_.pop()
            if not open_ or found[open_[-1]][3] >= total:
                open_.append(len(found))
                found.append((first, at, before, total))
                break
            j = open_.pop()
            first, _, before, _ = found[j]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r in found]


def surprise(score: float, n_words: int, scale: float) -> float:
    """-ln of the chance that a clean text of ``n_words`` has a segment of this score or more.

    The largest score of such scans follows an extreme-value law: the chance is
    1 - exp(-n exp(-scale * score)).
    """
    z = math.log(n_words) - scale * score if n_words else -scale * score
    expected = math.exp(min(z, 50.0))
    # for small expectations ln(1 - exp(-x)) is ln(x) - x / 2
    return expected / 2 - z if z < -20 else -math.log(-math.expm1(-expected))


def _features(scores: list[float], n_words: int, scale: float) -> list[float]:
    """Of all segments' scores: intercept, scaled best, log length, log number of the others, log of what these add in surprise.

    The law's chance of the best segment depends on the second less the log
    length; calibration weighs both, as the chance itself is flat where evidence
    is weak. Further segments add the surprise that the law gives them.
    """
    scores = sorted(scores, reverse=True)
    further = sum(surprise(s, n_words, scale) for s in scores[1:])
    return [1.0, scale * scores[0] if scores else 0.0, math.log1p(n_words) / 4, math.log1p(max(0, len(scores) - 1)), math.log1p(further)]


@dataclass
class ToxicityModel:
    """Token scores, extreme-value scale and calibration; picklable and bounded by MAX_TRAIN documents."""

    lexicon: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    weights: tuple[float, ...] = (-4.0, 1.0, 0.0, 0.0, 0.0)

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal scoring segments of a text, and its number of tokens."""
        words = tokens(text)
        scored = [(i, s) for i, s in enumerate(map(self.lexicon.get, words)) if s is not None]
        return (maximal_segments(scored) if scored else []), len(words)

    def judge(self, text: str | None, level: float = 0.05) -> tuple[float, list[tuple[int, int, float]]]:
        """The score, and the segments whose chance in a clean text of this length is at most ``level``."""
        found, n = self.segments(text)
        z = sum(w * x for w, x in zip(self.weights, _features([s for *_, s in found], n, self.scale)))
        least = -math.log(level)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))), [x for x in found if surprise(x[2], n, self.scale) >= least]

    def score(self, text: str | None) -> float:
        return self.judge(text)[0]

    def passages(self, text: str | None, level: float = 0.05) -> list[tuple[int, int, float]]:
        return self.judge(text, level)[1]


def _train_rows(labels: DataFrame, max_train: int) -> DataFrame:
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Fit on at most ``max_train`` labelled documents that aren't held out.

    Folds follow the doc_id hash. The texts of a fold get features from the
    lexicon of the others; these choose the evidence a token needs (least log
    loss) and the calibration. The lexicon itself comes from all folds. Without
    a toxic and a clean row the model scores all texts low.
    """
    train = _train_rows(labels, max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id")  # at most max_train rows

    rows = rows.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text, toxic, fold in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = tokens(text.as_py())
                seen.update((w, fold, toxic) for w in set(words))
                seen["", fold, toxic] += 1
                seen["", fold, 2] += 0 if toxic else len(words)
        columns = zip(*((*k, n) for k, n in seen.items())) if seen else [[]] * 4
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["word", "fold", "kind", "n"])

    counted = rows.mapInArrow(count, "word string, fold int, kind int, n bigint")
    cell = lambda f, k: F.sum(F.when((F.col("fold") == f) & (F.col("kind") == k), F.col("n")).otherwise(0))
    # clean documents, toxic documents and (without a word) tokens of the clean ones, for each fold
    counted = counted.groupBy("word").agg(*[F.array(*[cell(f, k) for f in range(FOLDS)]).alias(c) for k, c in enumerate(("clean", "toxic_", "size"))])
    # words of fewer than three toxic documents are left to chance too easily
    found = counted.where("word = '' or aggregate(toxic_, 0L, (a, x) -> a + x) >= 3").collect()
    sums = next((r for r in found if r["word"] == ""), None)
    if not sums or not sum(sums["clean"]) or not sum(sums["toxic_"]):
        return ToxicityModel(weights=(-4.0, 0.0, 0.0, 0.0, 0.0))

    def evidence(without: int | None = None) -> dict[str, tuple[float, float, float]]:
        """Log-odds, standard errors of it and frequency in clean text of each word, without a fold."""
        total = lambda xs: sum(xs) - (0 if without is None else xs[without])
        n0, n1, size, out = total(sums["clean"]), total(sums["toxic_"]), max(1, total(sums["size"])), {}
        for r in found:
            clean, toxic = total(r["clean"]), total(r["toxic_"])
            if r["word"] and toxic >= 3:
                prior = PRIOR + 10 * (clean + toxic) / (n0 + n1)
                a, b = toxic + prior, clean + PRIOR
                odds = math.log(a / (n1 + 10 + PRIOR - toxic)) - math.log(b / (n0 + PRIOR - clean + 10))
                if odds > 0 and odds / math.sqrt(1 / a + 1 / b) >= EVIDENCE[-1]:
                    out[r["word"]] = odds, odds / math.sqrt(1 / a + 1 / b), b / size
        return out

    def at_least(z: float, words: dict[str, tuple[float, float, float]]) -> ToxicityModel:
        held = {w: x for w, x in words.items() if x[1] >= z}
        lexicon = {w: x[0] for w, x in held.items()}
        return ToxicityModel(lexicon, _scale(lexicon, {w: x[2] for w, x in held.items()}))

    folds = [evidence(f) for f in range(FOLDS)]
    scales = [[at_least(z, words).scale for z in EVIDENCE] for words in folds]
    shared = docs.sparkSession.sparkContext.broadcast((folds, scales))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, scales = shared.value
        for batch in batches:
            x = []
            for text, f in zip(batch.column(0), batch.column(2).to_pylist()):
                words = tokens(text.as_py())
                hits = [(i, h) for i, h in enumerate(map(folds[f].get, words)) if h is not None]
                x.append([v for z, scale in zip(EVIDENCE, scales[f]) for v in _features([s for *_, s in maximal_segments([(i, h[0]) for i, h in hits if h[1] >= z])], len(words), scale)])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    # at most max_train rows of five numbers for each threshold; sorted, so that sums don't depend on the order of tasks
    got = sorted((r["y"], r["x"]) for r in rows.mapInArrow(featured, "x array<double>, y int").collect())
    y, x = np.array([r[0] for r in got], float), np.array([r[1] for r in got]).reshape(len(got), len(EVIDENCE), 5)
    weights = [_logistic(x[:, k], y) for k in range(len(EVIDENCE))]
    k = min(range(len(EVIDENCE)), key=lambda k: _log_loss(x[:, k], y, weights[k]))
    model = at_least(EVIDENCE[k], evidence())
    model.weights = weights[k]
    return model


def _log_loss(x: np.ndarray, y: np.ndarray, w: tuple[float, ...]) -> float:
    z = np.clip(x @ np.array(w), -30, 30)
    return float((np.log1p(np.exp(z)) - y * z).sum())


def _scale(lexicon: dict[str, float], mass: dict[str, float]) -> float:
    """lambda > 0 with sum of frequency * exp(lambda * score) = 1 over a clean text's tokens."""
    if not lexicon:
        return 1.0
    s, p = np.array(list(lexicon.values())), np.array([mass[w] for w in lexicon])
    rest = max(0.0, 1 - p.sum())
    low, high = 0.0, 1.0
    excess = lambda x: rest * math.exp(x * NEUTRAL) + float((p * np.exp(x * s)).sum()) - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.1] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Add score (double, 0 to 1), predicted (int) and n_passages (int) to ``docs``.

    Only ``text`` enters the score; whole texts are read. Null and empty texts
    have no tokens and get the score of that. Columns named like the three are
    replaced, all others pass through; repeated rows get equal values.
    """
    from pyspark.sql import types as T

    docs = docs.drop("score", "predicted", "n_passages")
    at, names = docs.columns.index("text"), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training bound
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_passages", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, passages = [], []
            for t in batch.column(at):
                score, found = m.judge(t.as_py())
                scores.append(score)
                passages.append(len(found))
            flags = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), flags, pa.array(passages, pa.int32())], [*names, "score", "predicted", "n_passages"])

    return docs.mapInArrow(run, schema)

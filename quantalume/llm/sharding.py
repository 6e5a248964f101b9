"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The rows are dealt into hash buckets. How many rows of bucket i go to shard j is
drawn from the multivariate hypergeometric law, so that rows and columns of the
matrix add up exactly. Each bucket is permuted and cut by its row of the matrix,
the pieces are exchanged, and each shard is permuted again.

The matrix is drawn in two levels of one law: the driver draws it for at most
GROUPS groups of buckets, then a task for each group draws that of its buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

#: numpy draws from populations below this.
_LARGEST = 10**9
#: Groups of buckets whose sums the driver sees.
GROUPS = 256
#: Rows of fixed size that are broadcast after a count, at most.
BROADCAST_ROWS = 100_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    if good + bad < _LARGEST:
        return int(rng.hypergeometric(good, bad, take)) if take else 0
    return _by_inversion(rng.random(), good, bad, take)


def _by_inversion(u: float, good: int, bad: int, take: int) -> int:
    """The hypergeometric count at quantile ``u``, for any population.

    Chances come from the exact ratios of neighbours, multiplied outwards from
    the mode until they are below what a double can add; their sum norms them.
    """
    low, high = max(0, take - bad), min(take, good)
    mode = min(high, max(low, (take + 1) * (good + 1) // (good + bad + 2)))
    p = good / (good + bad)
    reach = int(40 * math.sqrt(take * p * (1 - p) + 1)) + 40
    k = np.arange(max(low, mode - reach), min(high, mode + reach), dtype=float)  # from k to k + 1
    ratio = (good - k) / (k + 1) * ((take - k) / (bad - take + k + 1))
    at = mode - int(max(low, mode - reach))
    weight = np.concatenate([np.cumprod(1 / ratio[:at][::-1])[::-1], [1.0], np.cumprod(ratio[at:])])
    total = np.cumsum(weight)
    return int(max(low, mode - reach)) + int(np.searchsorted(total, u * total[-1], "right").clip(0, len(total) - 1))


def communication_matrix(rows: list[int], columns: list[int], seed: int | list[int]) -> np.ndarray:
    """Counts with the given row and column sums, as a uniform shuffle would give them."""
    rng, left = np.random.default_rng(seed), list(columns)
    out = np.zeros((len(rows), len(columns)), np.int64)
    for i, take in enumerate(rows):
        rest = sum(left)
        for j, good in enumerate(left):
            rest -= good
            got = _hypergeometric(rng, good, rest, take) if take else 0
            out[i, j] = got
            take -= got
        left = [a - int(b) for a, b in zip(left, out[i])]
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def cuts_of_buckets(counts: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """bucket and cuts (running sums of its row of the matrix) from (bucket, n)."""
    group = F.pmod(F.col("bucket"), F.lit(GROUPS)).cast("int")
    counts = counts.withColumn("group", group)
    sums = dict(counts.groupBy("group").agg(F.sum("n")).collect())  # at most GROUPS rows
    groups = sorted(sums)
    drawn = communication_matrix([sums[g] for g in groups], sizes, seed)
    parts = {g: drawn[i].tolist() for i, g in enumerate(groups)}

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        matrix = communication_matrix(rows["n"].tolist(), parts[int(rows["group"].iloc[0])], [seed, int(rows["group"].iloc[0])])
        return pd.DataFrame({"bucket": rows["bucket"].to_numpy(), "cuts": np.cumsum(matrix, axis=1).tolist()})

    return counts.groupBy("group").applyInPandas(draw, "bucket int, cuts array<bigint>")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def uniform_shards(docs: DataFrame, shards: int = 16, seed: int = 20240601, bucket_rows: int = 50_000) -> DataFrame:
    """Deal all rows of (doc_id, text) into shards whose counts are at most one apart.

    Returns doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32, law
    ('rows'), shard, slot (a uniform permutation within the shard, gapless from
    0) and grown_shard (null, as this law has no growing). Null doc_ids and
    repeated rows are dealt as any row: the hash of a row covers the place it
    was written at, so equal rows spread over all buckets. An empty table gives
    no rows. The number of buckets follows the number of rows.
    """
    text = text_of().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text_of()).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = materialize(rows.withColumn("at", F.monotonically_increasing_id()), "sized")
    rows = rows.withColumn("mix", F.xxhash64("doc_id", "text_crc32", "size", "at", F.lit(seed)))
    n = rows.count()
    buckets = max(1, -(-n // bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("mix", F.lit(1)), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    bounds = materialize(cuts_of_buckets(counts, shard_sizes(n, shards), seed), "cuts")
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("mix", "at")) - 1
    dealt = (
        rows.withColumn("place", place)
        .join(_small(bounds), "bucket")
        .withColumn("shard", F.expr("size(filter(cuts, c -> c <= place))").cast("int"))
    )
    # second permutation: random keys, sorted block by block; blocks follow the keys' order
    blocks = max(1, -(-n // (shards * bucket_rows)))
    key = F.xxhash64("mix", "bucket", "place", F.lit(2))
    dealt = materialize(
        dealt.withColumn("key", key).withColumn("part", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(blocks)).cast("int"))
        .select("doc_id", "size", "text_crc32", "at", "shard", "part", "key"), "dealt",
    )
    before = F.sum("m").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("m")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset_"))
    offsets = materialize(offsets, "offsets")
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "at")) - 1
    return dealt.withColumn("within", within).join(_small(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("offset_") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

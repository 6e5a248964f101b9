"""Best-fit packing of token sequences with certified bin counts.

Every partition of pieces is packed by best-fit decreasing. Lower bounds from
dual-feasible functions certify a partition whose bin count can't be beaten.
Partitions with gaps, and the one loosest bin of every partition, give their
documents to an exchange, where best-fit decreasing runs again over the pooled
pieces; an exchange that needs more bins than it received is not taken.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release_memory
from .tokens import encoder, vocabulary_path

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces in a partition; a group of this size is packed within one task.
PARTITION_ROWS = 8192


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than ``capacity``."""
    if n_tokens <= capacity:
        return [(0, n_tokens)]
    first = n_tokens % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_tokens, capacity)]


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece of each document, null text counting as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        enc, end = encoder(vocabulary), np.uint32(end_id).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1))):
                ids = memoryview(ids + end)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of several dual-feasible functions.

    Used are the identity (volume), the functions that count sizes above C - e
    as whole and drop those below e, and the rounding functions with k = 1..8
    that map a size x to floor((k + 1) x / C) / k unless (k + 1) x / C is whole.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    # U(e): sum over middle sizes + C for large ones, for every e in 1..C/2
    volume, number = np.cumsum(count * x), np.cumsum(count)
    e = np.arange(1, capacity // 2 + 1)
    large = number[capacity] - number[capacity - e]
    middle = volume[capacity - e] - volume[e - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 9):
        whole = (k + 1) * x % capacity == 0
        # in units of 1 / (k C)
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and each bin's fill.

    Open bins are kept by their free room; a bit set finds the least room that
    still holds a size. Ties in size keep their order.
    """
    bin_of, offset, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_bins: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if fits := rooms >> s:
            room = s + (fits & -fits).bit_length() - 1
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += s
        if left := room - s:
            open_bins.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bin_of, offset, np.array(fill, np.int64)


PACKED = PIECES + ", row bigint, sequence_id bigint, offset bigint, room bigint, certified boolean, gives boolean"


def _pack_groups(pieces: DataFrame, groups: int, capacity: int, turn: int) -> DataFrame:
    """Pack the pieces of each of ``groups`` hash groups; sequence ids start with turn and group.

    The hash is of the row's own number, so repeated rows spread over groups.
    """
    group = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)).cast("int")

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        sizes = rows["length"].to_numpy(np.int64)
        bin_of, offset, fill = best_fit_decreasing(sizes, capacity)
        certified = len(fill) <= lower_bound(sizes, capacity)
        room = capacity - fill
        gives = (room > 0) & (not certified)
        gives[int(room.argmax())] |= bool(room.max() > 0)
        return pd.DataFrame(
            {c: rows[c].to_numpy() if c != "doc_id" else rows[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "row")}
            | {"sequence_id": ((turn << 40 | int(key[0])) << 20) + bin_of, "offset": offset, "room": room[bin_of], "certified": certified, "gives": gives[bin_of]}
        )

    return pieces.withColumn("group_", group).groupBy("group_").applyInPandas(run, PACKED)


def best_fit_pack(
    docs: DataFrame,
    capacity: int = 1024,
    end_id: int = 2,
    vocabulary: str | None = None,
    partition_rows: int = PARTITION_ROWS,
    least_gain: float = 1e-4,
) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, room (free tokens of the sequence) and certified (its
    partition's bin count met the lower bound). Exchanges go on until one saves
    less than ``least_gain`` of the bins it was given, or one partition is left.
    Only documents longer than ``capacity`` are cut. Null and empty texts give a piece with the end id
    alone; a null doc_id stays null; repeated rows are packed each; an empty
    table gives no rows; other columns are not read.
    """
    pieces = pieces_of(docs, vocabulary or vocabulary_path(), capacity, end_id)
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    done: DataFrame | None = None
    pool, rows, turn = pieces, pieces.count(), 0
    given: DataFrame | None = None  # the pool as it was packed before, and its bins
    bins_given = 0
    while rows:
        groups = -(-rows // partition_rows)
        packed = materialize(_pack_groups(pool, groups, capacity, turn), f"packed{turn}")
        bins, giving_rows, giving_bins = packed.agg(F.count_if(F.col("offset") == 0), F.count_if("gives"), F.count_if(F.col("gives") & (F.col("offset") == 0))).first()
        gain = bins_given - bins
        if given is not None and gain < max(1, least_gain * bins_given):
            best = packed if gain > 0 else given  # an exchange that needs more bins is undone
            done = best if done is None else done.unionByName(best)
            break
        if groups == 1 or not giving_rows:
            done = packed if done is None else done.unionByName(packed)
            break
        kept, given = packed.where(~F.col("gives")), packed.where("gives")
        done = kept if done is None else done.unionByName(kept)
        pool, rows, bins_given, turn = given.select("row", *[x.split()[0] for x in PIECES.split(", ")]), giving_rows, giving_bins, turn + 1
    if done is None:
        done = _pack_groups(pieces, 1, capacity, 0)
    return done.drop("gives", "row")

"""Token ids as files: one concatenated array with Elias-Fano document bounds.

A store is a Parquet folder whose rows are blocks of consecutive documents:

| column | holds |
|-|-|
| shard, block | place; ascending with doc_id |
| base | tokens of the shard before the block |
| n_docs, n_tokens | of the block |
| doc_ids | the documents' ids, null where null |
| width, ids | bytes an id takes (2 or 4), and the ids, little-endian |
| low_bits, low, high, samples | the ends of the documents as an Elias-Fano sequence |

The ends e(0) <= e(1) <= ... are split: their ``low_bits`` lowest bits are
packed in ``low``; bit (e(i) >> low_bits) + i of ``high`` is one. ``samples``
holds the position of every 64th one as 32-bit numbers, relative to the block,
so select(i) counts ones within a few bytes. No 64-bit table is stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder, vocabulary_path, vocabulary_size

BLOCKS = (
    "shard int, block int, base bigint, n_docs int, n_tokens bigint, doc_ids array<bigint>, width int, ids binary, "
    "low_bits int, low binary, high binary, samples binary"
)
#: A block is closed once it holds this many tokens.
BLOCK_TOKENS = 1 << 20
STRIDE = 64


class EliasFano:
    """A non-decreasing sequence of non-negative numbers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, int(v[-1] // n).bit_length() - 1)
        low = ((v[:, None] >> np.arange(bits)) & 1).astype(np.uint8)
        ones = (v >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(
            n, bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(),
            ones[::STRIDE].astype("<u4").tobytes(),
        )

    def select(self, i: int) -> int:
        """The i-th value: jump to the sampled one before it, then count ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4")[i // STRIDE])
        left, byte = i % STRIDE, at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (k := word.bit_count()) <= left:
            left, byte = left - k, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        for b in range(self.low_bits):
            j = i * self.low_bits + b
            low |= (self.low[j >> 3] >> (j & 7) & 1) << b
        return (place - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        return high + (bits.reshape(self.n, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(1)


def _block(shard: int, block: int, base: int, doc_ids: list, chunks: list[bytes], width: int) -> dict:
    ends = np.cumsum([len(c) // 4 for c in chunks])
    ef = EliasFano.of(ends)
    ids = np.frombuffer(b"".join(chunks), "<u4")
    if len(ids) and int(ids.max()) >> 8 * width:
        raise ValueError(f"token id {ids.max()} does not fit in {width} bytes")
    ids = ids.astype(f"<u{width}").tobytes()
    return {
        "shard": shard, "block": block, "base": base, "n_docs": len(chunks), "n_tokens": int(ends[-1]), "doc_ids": doc_ids,
        "width": width, "ids": ids, "low_bits": ef.low_bits, "low": ef.low, "high": ef.high, "samples": ef.samples,
    }


def write_token_store(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, width: int | None = None, block_tokens: int = BLOCK_TOKENS
) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write the store.

    Documents are range-partitioned by doc_id, so the shards ascend, and sorted
    within them; null doc_ids come first, equal ones by a hash of the text.
    An id takes 2 bytes if all of the vocabulary's do, else 4; a smaller given
    ``width`` raises. Extra columns are not read, an empty table gives a store
    without blocks.
    """
    vocabulary = vocabulary or vocabulary_path()
    if width is None:
        width = 2 if max(vocabulary_size(vocabulary) - 1, end_id) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.uint32(end_id).tobytes()
        schema = pa.schema(
            [("shard", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("width", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())]
        )
        shard, block, base = TaskContext.get().partitionId(), 0, 0
        doc_ids, chunks, held = [], [], 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1))):
                chunks.append(ids + end)
                doc_ids.append(doc_id)
                held += len(chunks[-1]) // 4
                if held >= block_tokens:
                    yield pa.RecordBatch.from_pylist([_block(shard, block, base, doc_ids, chunks, width)], schema)
                    block, base, held, doc_ids, chunks = block + 1, base + held, 0, [], []
        if chunks:
            yield pa.RecordBatch.from_pylist([_block(shard, block, base, doc_ids, chunks, width)], schema)

    # the hash spreads rows of one doc_id, or of none, over ranges
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    What comes to the driver is one total for each shard (a write task), not
    for each document.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = sorted((r[0], r[1]) for r in blocks.groupBy("shard").agg(F.sum("n_tokens")).collect())
    before = dict(zip([s for s, _ in totals], np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ends = EliasFano(b["n_docs"], b["low_bits"], b["low"], b["high"], b["samples"])
                ends = np.array([ends.select(i) for i in range(b["n_docs"])], np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                ids = memoryview(np.frombuffer(b["ids"], f"<u{b['width']}").astype("<u4").tobytes())
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["doc_ids"], pa.int64()), pa.array(starts + (before[b["shard"]] + b["base"])), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array<bigint>) of the asked documents; two selects a document find its ids.

    Only blocks that hold one of them are decoded, and of those only the asked
    stretches. Unknown doc_ids give no row, repeated ones a row each.
    """
    wanted = sorted(set(doc_ids))
    blocks = spark.read.schema(BLOCKS).parquet(path).where(F.arrays_overlap("doc_ids", F.lit(wanted).cast("array<bigint>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = set(wanted)
        for batch in batches:
            for b in batch.to_pylist():
                ef = EliasFano(b["n_docs"], b["low_bits"], b["low"], b["high"], b["samples"])
                ids, found = np.frombuffer(b["ids"], f"<u{b['width']}"), []
                for i, doc_id in enumerate(b["doc_ids"]):
                    if doc_id in asked:
                        found.append((doc_id, ids[ef.select(i - 1) if i else 0 : ef.select(i)].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return blocks.mapInArrow(run, "doc_id bigint, ids array<bigint>")

"""Token-id output: one wavelet-matrix file per shard, written and read by Spark.

``write_shards`` deals the documents out by ranges of doc_id, encodes them and stores each shard as one compressed
file of blocks. A block holds whole documents (about ``BLOCK_TOKENS`` ids; a longer document has a block to itself) as
succinct bit-planes with rank directories, so that access, counting and occurrence lookup need no other file.

Defined results: a null text counts as empty and has the end id only; repeated rows are stored once per row, in
(doc_id, text) order; null doc_ids sort first; an empty table gives an empty store; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.tokenization import encoder

MAGIC, BLOCK_TOKENS, RANK_STEP = b"TWM1", 1 << 18, 512

BLOCK_SCHEMA = "shard int, block int, n_tokens bigint, doc_ids array<bigint>, doc_lengths array<bigint>, payload binary"


class WaveletMatrix:
    """Sequence of unsigned ids as bit-planes, most significant first; each level is stably parted by its bit."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], counts: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.counts = n, planes, zeros, counts

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, counts = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (a >> level) & 1
            packed = np.packbits(bit.astype(np.bool_))
            one = np.flatnonzero(bit)
            nil = np.flatnonzero(bit == 0)
            planes.append(packed)
            zeros.append(len(nil))
            counts.append(np.searchsorted(one, np.arange(0, n + RANK_STEP, RANK_STEP)).astype(np.uint32))
            a = np.concatenate((a.take(nil), a.take(one)))
        return cls(n, planes, zeros, counts)

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sIQ", MAGIC, len(self.planes), self.n) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        return head + b"".join(c.astype("<u4").tobytes() + p.tobytes() for c, p in zip(self.counts, self.planes, strict=True))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, bits, n = struct.unpack_from("<4sIQ", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix block")
        zeros = list(struct.unpack_from(f"<{bits}Q", data, 16))
        at, planes, counts = 16 + 8 * bits, [], []
        n_counts, n_bytes = len(range(0, n + RANK_STEP, RANK_STEP)), (n + 7) // 8
        for _ in range(bits):
            counts.append(np.frombuffer(data, "<u4", n_counts, at))
            at += 4 * n_counts
            planes.append(np.frombuffer(data, np.uint8, n_bytes, at))
            at += n_bytes
        return cls(n, planes, zeros, counts)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        step = i // RANK_STEP
        part = np.unpackbits(self.planes[level][step * RANK_STEP // 8 : (i + 7) // 8])[: i - step * RANK_STEP]
        return int(self.counts[level][step]) + int(part.sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            one = self.planes[level][i >> 3] >> (7 - (i & 7)) & 1
            r = self._rank1(level, i)
            value = value << 1 | int(one)
            i = self.zeros[level] + r if one else i - r
        return value

    def _interval(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """How often ``value`` occurs among the first i ids."""
        if value < 0 or value >> len(self.planes):
            return 0
        lo, hi = self._interval(value, 0, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def occurrences(self, value: int) -> np.ndarray:
        """Positions of ``value``, ascending (select of each occurrence), walked back through all levels at once."""
        if value < 0 or value >> len(self.planes):
            return np.empty(0, np.int64)
        lo, hi = self._interval(value, 0, self.n)
        at = np.arange(lo, hi)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level])[: self.n]
            one = value >> (len(self.planes) - 1 - level) & 1
            at = np.flatnonzero(bit)[at - self.zeros[level]] if one else np.flatnonzero(bit == 0)[at]
        return at

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        return int(self.occurrences(value)[k])

    def decode(self) -> np.ndarray:
        """All ids, from the last level upwards."""
        bits = len(self.planes)
        a = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level])[: self.n].view(np.bool_)
            up = np.empty_like(a)
            z = self.zeros[level]
            up[np.flatnonzero(~bit)] = a[:z]
            up[np.flatnonzero(bit)] = a[z:] | (1 << (bits - 1 - level))
            a = up
        return a.astype(np.uint32)


def _blocks(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(path), struct.pack("<I", end_id)
        shard, block = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            payload = WaveletMatrix.build(np.frombuffer(b"".join(parts), "<u4")).to_bytes()
            row = {"shard": shard, "block": block, "n_tokens": held, "doc_ids": list(docs), "doc_lengths": [len(p) // 4 for p in parts], "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo in range(0, len(ids), 2000):
                for doc, data in zip(ids[lo : lo + 2000], enc.encode(batch.column(1).slice(lo, 2000)), strict=True):
                    n = len(data) // 4 + 1
                    if parts and held + n > BLOCK_TOKENS:
                        yield flush()
                        docs, parts, held, block = [], [], 0, block + 1
                    docs.append(doc)
                    parts.append(data + end)
                    held += n
        if parts:
            yield flush()
        enc.rest()

    return run


_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("payload", pa.binary())])


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs(doc_id, text)`` and write one file per range of doc_id under ``path``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_blocks(tokenizer, end_id), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, block_start): ids stored before each block. Only one row per shard is ordered as a whole."""
    sizes = blocks.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.select("shard", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("ahead"))
    return inner.join(base, "shard").select("shard", "block", (F.col("shard_start") + F.col("ahead")).alias("block_start"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = WaveletMatrix.from_bytes(row["payload"]).decode().astype("<u4").tobytes()
            ends = np.cumsum(row["doc_lengths"], dtype=np.int64)
            starts = ends - np.array(row["doc_lengths"], dtype=np.int64)
            crcs = [zlib.crc32(ids[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(crcs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(starts), pa.array(row["doc_lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                names=["doc_id", "shard", "block", "in_block", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens, ids_crc32, all decoded from the files."""
    blocks = read_blocks(spark, path)
    rows = blocks.mapInArrow(_digests, "doc_id bigint, shard int, block int, in_block bigint, n_tokens bigint, ids_crc32 bigint")
    starts = block_starts(blocks)
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")


def _counts(values: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                m = WaveletMatrix.from_bytes(row["payload"])
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array([m.count(v) for v in values], pa.int64())], names=["token_id", "n"])

    return run


def count_tokens(spark: SparkSession, path: str, values: list[int]) -> DataFrame:
    """Occurrences of each given id over all shards, from the rank directories."""
    found = read_blocks(spark, path).mapInArrow(_counts(values), "token_id bigint, n bigint")
    return found.groupBy("token_id").agg(F.sum("n").alias("n"))


def _places(value: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = WaveletMatrix.from_bytes(row["payload"]).occurrences(value)
                ends = np.cumsum(row["doc_lengths"], dtype=np.int64)
                of = np.searchsorted(ends, at, side="right")
                starts = ends - np.array(row["doc_lengths"], dtype=np.int64)
                ids = np.array(row["doc_ids"], dtype=object)[of] if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.int64()), pa.array(at - starts[of], pa.int64())], names=["doc_id", "position"])

    return run


def locate(spark: SparkSession, path: str, value: int) -> DataFrame:
    """Every (doc_id, position in the document) at which an id stands."""
    return read_blocks(spark, path).mapInArrow(_places(value), "doc_id bigint, position bigint")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.new_path(spark, "token-shards")
    write_shards(common.read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_documents(spark, path)

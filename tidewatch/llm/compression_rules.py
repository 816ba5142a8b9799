"""Quality rules: plain counts of words, lines and repetition, then bands of zstandard ratios.

A text's ratio is its UTF-8 bytes over those of its zstandard frame. Repetitive text compresses too well, noise too badly, and
short texts always worse than long ones, so what is allowed depends on the length: ``LIMITS`` holds, for whole texts, the
least and the greatest ratio from a number of bytes on. The text is also cut into chunks of ``CHUNK`` bytes, each compressed alone, so that
a repetitive or noisy stretch isn't averaged away by the rest; a text fails if ``CHUNK_SHARE`` of its chunks or more lie
outside ``CHUNK_LIMITS``. A last chunk of less than half the size counts with the one before it.

All limits are parameters and none is derived from the table, so a text's verdict depends on that text alone. The work is one
pass without a shuffle; a task holds one Arrow batch of texts.

Defined results: a null text is the empty one (no words, all counts 0, ratios null, not kept); a null doc_id stays null; each row
gives one row, repeated rows too; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import common
from tidewatch.llm.shingles import mix, word_hashes

#: From so many bytes on: least and greatest ratio of the whole text.
LIMITS = ((0, 1.05, 3.0), (512, 1.15, 3.5), (1024, 1.25, 4.0), (4096, 1.35, 5.0), (32768, 1.35, 6.5))
CHUNK, CHUNK_LIMITS, CHUNK_SHARE, LEVEL = 4096, (1.25, 5.0), 0.25, 3
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 50, 3, 50
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"

_SYMBOL_BYTES = np.zeros(256, np.bool_)
_SYMBOL_BYTES[list(SYMBOLS.encode())] = True
_SPACE_BYTES = np.zeros(256, np.bool_)
_SPACE_BYTES[list(SPACES.encode())] = True

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
    "n_bytes bigint, ratio double, least_chunk double, greatest_chunk double, n_chunks bigint, n_chunks_out bigint, verdict string"
)
_TYPES = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3 + [pa.int64()] * 2 + [pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def repeat_words(words: np.ndarray) -> int:
    """Words that lie in a window of ``WINDOW`` words found more than once, its first place included; ``words`` are hashes."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    turns = np.array([2 * k + 1 for k in (0x51ED270B7F4C2A6D, 0x2C7E9D8E3B5A41F7, 0x7B1C93D5E6F80A43)], np.uint64)
    windows = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        windows = mix(windows + words[j : j + n] * turns[j])
    _, own, counts = np.unique(windows, return_inverse=True, return_counts=True)
    often = (counts > 1)[own]
    covered = np.zeros(len(words), np.bool_)
    for j in range(WINDOW):
        covered[j : j + n] |= often
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


class CompressionBands:
    """The verdict of compression on a text: null if it passes, else the first rule that it breaks."""

    def __init__(self, limits=LIMITS, chunk: int = CHUNK, chunk_limits=CHUNK_LIMITS, chunk_share: float = CHUNK_SHARE, level: int = LEVEL):
        self.limits, self.chunk, self.chunk_limits, self.chunk_share = sorted(limits), chunk, chunk_limits, chunk_share
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)

    def ratio(self, raw: bytes | memoryview) -> float:
        return len(raw) / len(self.packer.compress(raw))

    def chunks(self, raw: bytes) -> list[memoryview]:
        view, ends = memoryview(raw), list(range(self.chunk, len(raw) + 1, self.chunk))
        if not ends:
            return [view]
        if len(raw) - ends[-1] >= self.chunk / 2:
            ends.append(len(raw))
        ends[-1] = len(raw)
        return [view[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def judged(self, raw: bytes) -> tuple[float | None, float | None, float | None, int, int, str | None]:
        """(ratio, least and greatest ratio of a chunk, chunks, chunks outside, verdict)."""
        if not raw:
            return None, None, None, 0, 0, None
        whole = self.ratio(raw)
        parts = [self.ratio(c) for c in own] if len(own := self.chunks(raw)) > 1 else [whole]
        low, high = next((lo, hi) for size, lo, hi in reversed(self.limits) if len(raw) >= size)
        # texts of one chunk have been judged by the limits of their length
        few, many = ([r < self.chunk_limits[0] for r in parts], [r > self.chunk_limits[1] for r in parts]) if len(parts) > 1 else ([], [])
        verdict = None
        if whole > high:
            verdict = "REPETITIVE"
        elif whole < low:
            verdict = "INCOMPRESSIBLE"
        elif sum(many) and sum(many) >= self.chunk_share * len(parts):
            verdict = "REPETITIVE_CHUNKS"
        elif sum(few) and sum(few) >= self.chunk_share * len(parts):
            verdict = "INCOMPRESSIBLE_CHUNKS"
        return whole, min(parts), max(parts), len(parts), sum(few) + sum(many), verdict


def measured(doc_id: int | None, text: str | None, bands: CompressionBands) -> tuple:
    """A row of ``SCHEMA``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(raw, np.uint8)
    words = word_hashes(text, cased=True)
    n, again = len(words), repeat_words(words)
    failed = n < LEAST_WORDS or 100 * again > REPEAT_PERCENT * n
    found = bands.judged(raw)
    return (doc_id, n, len(text) - int(_SPACE_BYTES[codes].sum()), int(_SYMBOL_BYTES[codes].sum()), duplicate_lines(text), again, failed, not failed and found[-1] is None, len(raw), *found)


def quality_rules(documents: DataFrame, **limits) -> DataFrame:
    """A row of ``SCHEMA`` for each row of ``documents(doc_id, text)``; ``limits`` are those of ``CompressionBands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = CompressionBands(**limits)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [measured(d, t.as_py(), bands) for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return documents.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text").mapInArrow(run, SCHEMA)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.read_table(spark, sf_dir, "documents"))

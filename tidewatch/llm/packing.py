"""Order-preserving packing of documents into token windows by dynamic programming.

Documents in doc_id order form one stream of ids. A window is cut where the sum of padding and cut penalties is
smallest: nothing for a cut at a document's end, ``SENTENCE_PENALTY`` after a sentence's last id, ``HARD_PENALTY``
elsewhere (offered only every ``HARD_STEP`` ids in a stretch without sentence ends). A window of w ids is padded to
``size`` unless w is a power of two of at least ``POWER_MIN``. With p(i) the cheapest cost up to cut i,

    p(j) = penalty(j) + size - pos(j) + min over pos(j) - size <= pos(i) < pos(j) of (p(i) + pos(i))

and the minimum of a sliding range comes from a monotone queue, so a stream of m cuts takes m steps.

Each range of doc_ids is packed on its own, in stretches of ``STRETCH`` ids whose last window is carried on; its final
window alone may be short. Defined results: a null text is empty and has the end id only; repeated rows are packed
once per row in (doc_id, text) order; null doc_ids come first; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.tokenization import encoder

SIZE, SENTENCE_PENALTY, HARD_PENALTY, HARD_STEP, POWER_MIN, STRETCH = 4096, 8, 48, 256, 512, 1 << 19

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
PIECES_WITH_IDS = PIECES + ", ids array<int>"


def best_cuts(pos: list[int], penalty: list[int], size: int, power_min: int = POWER_MIN) -> list[int]:
    """Indices into ``pos`` of the cheapest cuts. pos[0] is the start, the last entry the end; gaps are at most ``size``."""
    cost, back = [0] * len(pos), [0] * len(pos)
    places = np.asarray(pos)
    exact: dict[int, list[int]] = {}  # of a cut, those from which a window is a power of two long
    for w in (1 << k for k in range(size.bit_length()) if power_min <= 1 << k < size):
        k = np.minimum(np.searchsorted(places, places - w), len(pos) - 1)
        for j in np.flatnonzero(places[k] == places - w).tolist():
            exact.setdefault(j, []).append(int(k[j]))
    keys, at, head = [pos[0]], [0], 0  # the monotone queue: ascending keys and their cuts, from ``head`` on
    for j in range(1, len(pos)):
        x = pos[j]
        low = x - size
        while pos[at[head]] < low:
            head += 1
        best, i = keys[head] + size - x, at[head]
        if j in exact:
            for k in exact[j]:
                if cost[k] < best:
                    best, i = cost[k], k
        best += penalty[j]
        cost[j], back[j] = best, i
        key = best + x
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            at.pop()
        keys.append(key)
        at.append(j)
    cuts, j = [len(pos) - 1], len(pos) - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Positions where a window may end and what each costs; gaps never exceed ``HARD_STEP`` or ``size``."""
    n, step = len(ids), min(HARD_STEP, size)
    kind = np.zeros(n + 1, np.int8)
    kind[1:][ends_sentence[ids]] = 2
    kind[doc_ends] = 1
    kind[0] = kind[n] = 1
    have = np.flatnonzero(kind)
    gaps = np.diff(have)
    for k in np.flatnonzero(gaps > step):
        kind[have[k] + step : have[k + 1] : step] = 3
    pos = np.flatnonzero(kind)
    cost = np.array([0, 0, SENTENCE_PENALTY, HARD_PENALTY])[kind[pos]]
    return pos.tolist(), cost.tolist()


@lru_cache(maxsize=4)
def sentence_end_ids(path: str) -> np.ndarray:
    """For each id whether its token closes a sentence."""
    vocab = encoder(path).tok.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values(), default=0) + 1, np.bool_)
    for t, i in vocab.items():
        out[i] = t.removesuffix("</w>")[-1:] in (".", "!", "?", "。")
    return out


def _pack(path: str, end_id: int, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(path), struct.pack("<I", end_id)
        closes = sentence_end_ids(path)
        sequence = TaskContext.get().partitionId() << 32
        # of the documents in hand: id, ids not yet placed, ids placed before, ids in all
        held: list[tuple[int | None, bytes, int, int]] = []
        n_held = 0

        def place(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n_held, sequence
            data = b"".join(h[1] for h in held)
            ids = np.frombuffer(data, "<u4")
            ends = np.cumsum([len(h[1]) // 4 for h in held])
            pos, cost = candidate_cuts(ids, ends, closes, size)
            cuts = [pos[c] for c in best_cuts(pos, cost, size)]
            if not last:
                cuts.pop()
            upto, out, k, done = cuts[-1], [], 0, 0
            lo_of = (ends - np.array([len(h[1]) // 4 for h in held])).tolist()
            hi_of = ends.tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                while done < b:
                    while hi_of[k] <= done:
                        k += 1
                    stop = min(b, hi_of[k])
                    doc, _, before, total = held[k]
                    out.append((doc, before + done - lo_of[k], stop - done, zlib.crc32(data[done * 4 : stop * 4]), total, sequence, done - a, ids[done:stop] if with_ids else None))
                    done = stop
                sequence += 1
            rest = []
            for (doc, own, before, total), lo, hi in zip(held, lo_of, hi_of, strict=True):
                if hi > upto:
                    skip = max(0, upto - lo)
                    rest.append((doc, own[skip * 4 :], before + skip, total))
            held, n_held = rest, len(ids) - upto
            columns = list(zip(*out, strict=True)) or [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            names = [f.split()[0] for f in PIECES.split(", ")]
            if with_ids:
                arrays.append(pa.array(list(columns[7]), pa.list_(pa.int32())))
                names = [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for lo in range(0, len(docs), 2000):
                for doc, data in zip(docs[lo : lo + 2000], enc.encode(batch.column(1).slice(lo, 2000)), strict=True):
                    n = len(data) // 4 + 1
                    held.append((doc, data + end, 0, n))
                    n_held += n
                    if n_held >= STRETCH:
                        yield from place(False)
        if held:
            yield from place(True)
        enc.rest()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``; ``with_ids`` adds the ids of each piece."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(_pack(tokenizer, end_id, size, with_ids), PIECES_WITH_IDS if with_ids else PIECES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)

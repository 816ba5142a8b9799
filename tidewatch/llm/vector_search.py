"""Nearest neighbours by inner product over shifted space-filling curves.

For each of ``CURVES`` Hilbert curves vectors are projected to ``AXES`` random orthonormal directions of its own, squashed to
a grid, shifted and range-partitioned in curve order by Spark. Along a curve every chunk's queries are compared with
their own chunk and both neighbours; the windows of all curves are merged and reranked, which is the result.

Its recall is measured: ``PROBES`` queries are compared with every row. Where the windows find less than ``ENOUGH`` of
their neighbours, as with vectors that have no clusters, or if ``complete`` is set, the windows' results are completed: the
chunks of the first curve are the blocks of an index, each with its centroid and radius. Blocks of queries meet the blocks
whose bound c.c' + |c| r' + |c'| r + r r' reaches the lowest k-th score of the windows, and what reaches its query's own is merged
with what the windows found. Recall is 1 then; the work is that of the query set against all rows where nothing can be pruned.

Defined results: rows that take no part (see ``vectors``) are neither queries nor candidates; rows with one vec_id count
once; a query with fewer candidates gets all of them; without queries or vectors there are no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.vectors import dimension, matrix, taking_part

CURVES, AXES, BITS, CHUNK, GROUP = 4, 6, 8, 256, 16
PROBES, ENOUGH = 64, 0.97
#: How far two summation orders may differ; scores that close to a bound are looked at again.
SLACK = 1e-9


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of a grid of ``bits``-bit coordinates."""
    x = grid.astype(np.int64).T.copy()
    axes = len(x)
    # from coordinates to the transposed index: undo the rotations of each level, highest bit first
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(axes):
            swap = (x[k] >> level) & 1 == 0
            flip = np.where(swap, 0, low)
            change = np.where(swap, (x[0] ^ x[k]) & low, 0)
            x[0] ^= flip ^ change
            x[k] ^= change
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> level) & 1 == 1, turn ^ ((1 << level) - 1), turn)
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(axes):
            out = out << 1 | (x[k] >> level) & 1
    return out


def _projection(dim: int, axes: int, curve: int) -> np.ndarray:
    """``axes`` orthonormal directions of a curve; other curves have others as far as the dimension allows."""
    q, _ = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).normal(size=(dim, dim)))
    return q[:, (curve * axes + np.arange(min(axes, dim))) % dim]


def _score(m: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in one summation order for all, so that copies tie exactly."""
    return (m * query).sum(axis=1)


def _keys(dim: int, scale: float, every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = [_projection(dim, AXES, c) for c in range(CURVES)]
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                ids = part.column(0).to_numpy()
                m = matrix(part.column(1).to_pylist(), dim)
                asks = ids % every == 0 if every else np.zeros(len(ids), np.bool_)
                for curve, way in enumerate(ways):
                    at = 1 / (1 + np.exp(np.clip(-1.7 * (m @ way) / scale, -50, 50)))
                    grid = np.minimum((at + curve / CURVES) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), curve, np.int32)), pa.array(hilbert(grid, BITS)), part.column(0), part.column(1), pa.array(asks)], names=["curve", "key", "vec_id", "v", "asks"])

    return run


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


_WINDOW = "block bigint, n int, ids binary, m binary, center array<double>, radius double, query_id bigint, vec_id bigint, score double"


def _windows(dim: int, k: int):
    """Rows in curve order: the nearest of each query in its chunk and both neighbours; and the blocks of curve 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("m", pa.binary()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

        def chunks():
            held: list[tuple] = []
            of = None
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    if held and (row[0] != of or len(held) == CHUNK):
                        yield of, held
                        held = []
                    of = row[0]
                    held.append(row)
            if held:
                yield of, held

        def made(curve: int, rows: list[tuple]) -> tuple:
            return curve, np.array([r[2] for r in rows], np.int64), matrix([r[3] for r in rows], dim), np.array([r[4] for r in rows], np.bool_)

        def found(before, here, after) -> pa.RecordBatch | None:
            curve, ids, m, asks = here
            if not asks.any():
                return None
            near = [c for c in (before, here, after) if c is not None and c[0] == curve]
            all_ids, all_m = np.concatenate([c[1] for c in near]), np.concatenate([c[2] for c in near])
            q, v, s = [], [], []
            for query, vector, scores in zip(ids[asks], m[asks], m[asks] @ all_m.T, strict=True):
                # a few more than k, since the exact scores may order equals otherwise
                some = _best(all_ids, np.where(all_ids == query, -np.inf, scores), k + 8)
                some = some[all_ids[some] != query]
                exact = _score(all_m[some], vector)
                top = _best(all_ids[some], exact, k)
                q += [query] * len(top)
                v += all_ids[some][top].tolist()
                s += exact[top].tolist()
            n = len(q)
            return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) for f in list(schema)[:6]] + [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], schema=schema)

        before = here = None
        for curve, rows in chunks():
            after = made(curve, rows)
            if curve == 0:
                center = after[2].mean(axis=0)
                radius = float(np.sqrt(((after[2] - center) ** 2).sum(axis=1).max()))
                yield pa.RecordBatch.from_pylist([{"block": block, "n": len(rows), "ids": after[1].astype("<i8").tobytes(), "m": after[2].tobytes(), "center": center.tolist(), "radius": radius}], schema=schema)
                block += 1
            if here is not None and (out := found(before, here, after)) is not None:
                yield out
            before, here = here, after
        if here is not None and (out := found(before, here, None)) is not None:
            yield out

    return run


def _query_blocks(dim: int):
    """Queries in curve order with their bounds, as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            m = matrix([r[1] for r in held], dim)
            center = m.mean(axis=0)
            row = {"q": block, "qids": np.array([r[0] for r in held], "<i8").tobytes(), "qm": m.tobytes(), "bounds": np.array([r[2] for r in held], "<f8").tobytes(), "lowest": min(r[2] for r in held), "q_center": center.tolist(), "q_radius": float(np.sqrt(((m - center) ** 2).sum(axis=1).max()))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("q", pa.int64()), ("qids", pa.binary()), ("qm", pa.binary()), ("bounds", pa.binary()), ("lowest", pa.float64()), ("q_center", pa.list_(pa.float64())), ("q_radius", pa.float64())]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held.append(row)
                if len(held) == CHUNK:
                    yield made()
                    held, block = [], block + 1
        if held:
            yield made()

    return run


def _complete(dim: int, k: int):
    """Joined blocks, sorted by query block: the best of each query among the data blocks it meets in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for row in batch.to_pylist():
                qm, dm = matrix([row["qm"]], dim), matrix([row["m"]], dim)
                qids, ids, bounds = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["bounds"], "<f8")
                reach = qm @ dm.T >= (bounds - SLACK)[:, None]
                for k_query in np.flatnonzero(reach.any(axis=1)):
                    some = np.flatnonzero(reach[k_query] & (ids != qids[k_query]))
                    scores = _score(dm[some], qm[k_query])
                    top = _best(ids[some], scores, k)
                    out[0].extend([int(qids[k_query])] * len(top))
                    out[1].extend(ids[some][top].tolist())
                    out[2].extend(scores[top].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _probe(ids: list[int], m: np.ndarray, k: int):
    """The k nearest of each probe among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
        for batch in batches:
            rows, v = batch.column(0).to_numpy(), matrix(batch.column(1).to_pylist(), m.shape[1])
            for j, scores in enumerate(m @ v.T):
                own = rows != ids[j]
                all_ids, all_scores = np.concatenate((best[j][0], rows[own])), np.concatenate((best[j][1], scores[own]))
                top = _best(all_ids, all_scores, k)
                best[j] = all_ids[top], all_scores[top]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(b[0]) for b in best]), pa.int64()), pa.array(np.concatenate([b[0] for b in best]), pa.int64()), pa.array(np.concatenate([b[1] for b in best]), pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def window_recall(clean: DataFrame, found: DataFrame, dim: int, k: int, every: int) -> float:
    """Share of the true k nearest of ``PROBES`` queries, those with the smallest hash, that ``found`` holds; 1 without queries."""
    probes = clean.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).collect()
    if not probes:
        return 1.0
    ids, m = [r["vec_id"] for r in probes], matrix([bytes(r["v"]) for r in probes], dim)
    true = _ranked(clean.mapInArrow(_probe(ids, m, k), "query_id bigint, vec_id bigint, score double"), k).select("query_id", F.col("vec_id").alias("near"))
    counts = true.join(found.select("query_id", F.col("vec_id").alias("near"), F.lit(1).alias("hit")), ["query_id", "near"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return counts["hits"] / counts["n"] if counts["n"] else 1.0


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, complete: bool | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by ``every``.

    ``complete`` says whether to complete what the windows miss; None leaves it to the measured recall.
    """
    spark = vectors.sparkSession
    dim = dimension(vectors, "embedding")
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    clean = common.saved(taking_part(vectors, dim), "vectors")
    numbers = vectors.where(F.size("embedding") == dim).select(F.aggregate(F.transform("embedding", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) ** 2), F.lit(0.0), lambda s, x: s + x).alias("n2"))
    scale = numbers.where("n2 > 0 and n2 < double('infinity')").agg(F.sqrt(F.avg("n2") / dim)).first()[0] or 1.0
    keyed = clean.mapInArrow(_keys(dim, float(scale), every), "curve int, key bigint, vec_id bigint, v binary, asks boolean")
    ordered = keyed.repartitionByRange("curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    windows = common.saved(ordered.mapInArrow(_windows(dim, k), _WINDOW), "curve-windows")
    merged = common.saved(_ranked(windows.where("query_id is not null").select("query_id", "vec_id", "score").distinct(), k), "merged-windows")
    found = merged.select("query_id", "vec_id", "score")
    if complete or complete is None and window_recall(clean, found, dim, k, every) < ENOUGH:
        more = _completed(clean, windows, merged, dim, float(scale), k, every)
        return _ranked(found.union(more).distinct(), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _completed(clean: DataFrame, windows: DataFrame, merged: DataFrame, dim: int, scale: float, k: int, every: int) -> DataFrame:
    """(query_id, vec_id, score) of all that reaches the k-th score of the windows, by blocks."""
    kth = merged.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    queries = clean.where(F.col("vec_id") % every == 0).join(kth, F.col("vec_id") == F.col("id"), "left").select("vec_id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    with_key = queries.mapInArrow(_query_keys(dim, scale), "vec_id bigint, v binary, bound double, key bigint")
    asked = with_key.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id").select("vec_id", "v", "bound")
    q_schema = "q bigint, qids binary, qm binary, bounds binary, lowest double, q_center array<double>, q_radius double"
    q_blocks = common.saved(asked.mapInArrow(_query_blocks(dim), q_schema), "query-blocks")
    d_blocks = windows.where("block is not null").select("block", "ids", "m", "center", "radius")
    groups = max(1, -(-d_blocks.count() // GROUP))
    d_blocks = d_blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(groups)))
    q_blocks = q_blocks.withColumn("to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    reach = _dot("center", "q_center") + F.sqrt(_dot("center", "center")) * F.col("q_radius") + F.sqrt(_dot("q_center", "q_center")) * F.col("radius") + F.col("radius") * F.col("q_radius")
    met = q_blocks.join(d_blocks.hint("shuffle_hash"), (F.col("cell") == F.col("to")) & (reach >= F.col("lowest") - SLACK))
    return met.select("qids", "qm", "bounds", "ids", "m").mapInArrow(_complete(dim, k), "query_id bigint, vec_id bigint, score double")


def _query_keys(dim: int, scale: float):
    inner = _keys(dim, scale, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first = [b for b in inner(iter([batch])) if b.column(0)[0].as_py() == 0]
            keys = pa.concat_arrays([b.column(1) for b in first])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), keys], names=["vec_id", "v", "bound", "key"])

    return run


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.read_table(spark, sf_dir, "embeddings"))

"""Vectors as double-precision bytes: which rows take part, and helpers shared by the two vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(vectors: DataFrame, column: str) -> int:
    """The most frequent length (the smaller one of equals); vectors of another length take no part. 0 without any."""
    sizes = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return int(sizes[0]["d"]) if sizes else 0


def _pack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            starts = column.offsets.to_numpy()[:-1].astype(np.int64)
            sizes = np.diff(column.offsets.to_numpy())
            values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            fit = np.flatnonzero((sizes == dim) & column.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False))
            m = values[starts[fit][:, None] + np.arange(dim)[None, :]] if len(fit) else np.empty((0, dim))
            good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
            m = np.ascontiguousarray(m[good] + 0.0, "<f8")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(fit[good])), pa.array([r.tobytes() for r in m], pa.binary())], names=["vec_id", "v"])

    return run


def taking_part(vectors: DataFrame, dim: int, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v) of rows with an id and a finite vector of ``dim`` components, not all zero; one row per vec_id.

    Of different vectors under one vec_id the one with the smallest bytes counts.
    """
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("e"))
    return rows.mapInArrow(_pack(max(dim, 1)), "vec_id bigint, v binary").groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(values: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<f8").reshape(-1, dim)

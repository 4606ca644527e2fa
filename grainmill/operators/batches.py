"""Numpy functions over Arrow batches: row by row results, and sums over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numpy_of(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def dense_map(rows: DataFrame, f: Callable[..., np.ndarray], name: str) -> DataFrame:
    """(id, name): f of the other columns as arrays, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f(*[numpy_of(c) for c in b.columns[1:]])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=["id", name])

    return rows.mapInArrow(run, f"id long, `{name}` array<double>")


def summed(rows: DataFrame, f: Callable[..., dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The sums over all rows of the arrays that f gives for batches, flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                for k, v in f(*[numpy_of(c) for c in b.columns]).items():
                    out[k] = out.get(k, 0.0) + np.asarray(v, dtype=np.float64).ravel()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, v in out.items() for _ in v]), pa.array([i for v in out.values() for i in range(len(v))], pa.int32()), pa.array(np.concatenate(list(out.values())))], names=["k", "i", "v"])

    found: dict[str, dict[int, float]] = {}
    for k, i, v in rows.mapInArrow(run, "k string, i int, v double").groupBy("k", "i").agg(F.sum("v")).collect():
        found.setdefault(k, {})[i] = v
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in found.items()}

"""Sparse linear algebra as joins and aggregations. Matrices: (row, col, val); dense: (id, x array<double>)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.vectors import squared_distance, total, vector_sum
from grainmill.graph import Graph
from grainmill.operators.batches import summed
from grainmill.operators.build import degree, remove_self_loops


def spmm(matrix: DataFrame, dense: DataFrame, size: int, x: str = "x") -> DataFrame:
    """matrix @ dense -> (id, x); rows without entries have no row."""
    joined = matrix.join(dense.select(F.col("id").alias("col"), F.col(x).alias("_x")), "col")
    return joined.groupBy(F.col("row").alias("id")).agg(vector_sum("_x", size, F.col("val")).alias(x))


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """a @ b -> (row, col, val)."""
    left, right = a.select("row", F.col("col").alias("k"), F.col("val").alias("va")), b.select(F.col("row").alias("k"), "col", F.col("val").alias("vb"))
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("va") * F.col("vb")).alias("val"))


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with columns of both their ends, as <column>_i and <column>_j."""
    i = nodes.select(F.col("id").alias("src"), *[F.col(c).alias(f"{c}_i") for c in columns])
    j = nodes.select(F.col("id").alias("dst"), *[F.col(c).alias(f"{c}_j") for c in columns])
    return edges.join(i, "src").join(j, "dst")


def laplacian_spmm(graph: Graph, dense: DataFrame, size: int, x: str = "x") -> DataFrame:
    """L @ dense, as degree times own less the weighted sum over neighbours; one pass over the edges."""
    nb = dense.select(F.col("id").alias("dst"), F.col(x).alias("_x"))
    sums = remove_self_loops(graph.edges).join(nb, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("_d"), vector_sum("_x", size, F.col("w")).alias("_s"))
    own = dense.select("id", x).join(sums, "id", "left")
    return own.select("id", F.when(F.col("_d").isNull(), F.transform(x, lambda v: F.lit(0.0))).otherwise(F.zip_with(x, "_s", lambda v, s: v * F.col("_d") - s)).alias(x))


def quadratic_form(graph: Graph, dense: DataFrame, size: int, x: str = "x") -> DataFrame:
    """(k, val): x_k' L x_k for each column, as half the sum of w (x_i - x_j)^2 over stored edges."""
    ends = with_ends(remove_self_loops(graph.edges), dense, x)
    sums = ends.agg(*[F.sum(F.col("w") * (F.col(f"{x}_i")[k] - F.col(f"{x}_j")[k]) ** 2).alias(f"k{k}") for k in range(size)])
    return sums.select(F.posexplode(F.array(*[F.col(f"k{k}") / 2 for k in range(size)]))).toDF("k", "val")


def gram(graph: Graph, dense: DataFrame, size: int, x: str = "x") -> np.ndarray:
    """x' L x as a small matrix on the driver; summed over edges on the executors, batch by batch."""
    ends = with_ends(graph.edges.where("src < dst"), dense, x).select("w", F.zip_with(f"{x}_i", f"{x}_j", lambda a, b: a - b).alias("d"))
    found = summed(ends, lambda w, d: {"q": (d * w[:, None]).T @ d}).get("q")
    return np.zeros((size, size)) if found is None else found.reshape(size, size)


def inner(dense: DataFrame, other: DataFrame, size: int, x: str = "x") -> np.ndarray:
    """dense' other, size x size, on the driver."""
    both = dense.select("id", F.col(x).alias("_a")).join(other.select("id", F.col(x).alias("_b")), "id").select("_a", "_b")
    found = summed(both, lambda a, b: {"q": a.T @ b}).get("q")
    return np.zeros((size, size)) if found is None else found.reshape(size, size)


def times_small(dense: DataFrame, matrix: np.ndarray, x: str = "x") -> DataFrame:
    """dense @ a small matrix, which goes into the plan."""
    columns = [F.array(*[F.lit(float(v)) for v in matrix[:, k]]) for k in range(matrix.shape[1])]
    return dense.select("id", F.array(*[total(F.zip_with(x, c, lambda a, b: a * b)) for c in columns]).alias(x))


def eigenpairs(matrix: DataFrame, n: int, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs of a small symmetric matrix with ids 0..n-1, on the driver."""
    dense = np.zeros((n, n))
    for row, col, val in matrix.select("row", "col", "val").collect():
        dense[row, col] += val
    values, vectors = np.linalg.eigh(dense)
    return (values[::-1], vectors[:, ::-1]) if descending else (values, vectors)


def edge_distances(graph: Graph, dense: DataFrame, x: str = "x") -> DataFrame:
    """Edges i < j with w, both degrees (doubled) and the squared distance of their ends."""
    ends = with_ends(graph.edges.where("src < dst"), dense.join(degree(graph), "id"), x, "deg")
    return ends.select("src", "dst", "w", "deg_i", "deg_j", squared_distance(F.col(f"{x}_i"), F.col(f"{x}_j")).alias("d2"))

"""Graph construction, degrees, Laplacians and other operators over edge and node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.graph import Graph


def unit_weights(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.lit(1.0).alias("w"))


def to_undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once; of several weights between two nodes the greatest stays."""
    there = F.struct("src", "dst", "w")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select(F.explode(F.array(there, back)).alias("e")).select("e.*").groupBy("src", "dst").agg(F.max("w").alias("w"))


def coalesce_entries(matrix: DataFrame) -> DataFrame:
    """Entries (row, col, val); duplicates mean their sum."""
    return matrix.groupBy("row", "col").agg(F.sum("val").alias("val"))


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def add_self_loops(graph: Graph, weight: float = 1.0) -> DataFrame:
    return graph.edges.select("src", "dst", "w").union(graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(weight).alias("w")))


def zero_diag(matrix: DataFrame) -> DataFrame:
    return matrix.where("row <> col")


def identity(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("val"))


def _of_every_node(nodes: DataFrame, sums: DataFrame, value: str) -> DataFrame:
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias(value))


def degree(graph: Graph, mode: str = "doubled") -> DataFrame:
    """(id, deg) of every node. 'doubled': each stored edge counts at both its ends; 'row': row sums without loops."""
    if mode == "row":
        sums = remove_self_loops(graph.edges).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("deg"))
    elif mode == "doubled":
        ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id"), "w")
        sums = ends.groupBy("id").agg(F.sum("w").alias("deg"))
    else:
        raise ValueError(f"no degree mode {mode!r}")
    return _of_every_node(graph.nodes, sums, "deg")


def weights_matrix(graph: Graph) -> DataFrame:
    return graph.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("val"))


def laplacian(graph: Graph) -> DataFrame:
    """Row-sum degrees on the diagonal, negated weights elsewhere."""
    off = zero_diag(weights_matrix(graph)).withColumn("val", -F.col("val"))
    return off.union(degree(graph, "row").select(F.col("id").alias("row"), F.col("id").alias("col"), F.col("deg").alias("val")))


def gradient_matrix(graph: Graph) -> DataFrame:
    """(node, edge, val): +sqrt(w) at the lesser end of each edge, -sqrt(w) at the other; edges numbered by their ends."""
    once = dense_index(graph.edges.where("src < dst").select("src", "dst", "w"), "src", "dst", name="edge")
    sides = F.array(F.struct(F.col("src").alias("node"), F.sqrt("w").alias("val")), F.struct(F.col("dst").alias("node"), (-F.sqrt("w")).alias("val")))
    return once.select("edge", F.explode(sides).alias("e")).select("e.node", "edge", "e.val")


def dense_index(rows: DataFrame, *keys: str, name: str, rows_a_bucket: int = 500_000) -> DataFrame:
    """Adds the place (from 0) of each row by ``keys``, without gathering all rows in one task.

    Rows are ranked within ranges of the first key, whose bounds are approximate quantiles; the ranges' sizes
    give each range its offset.
    """
    ranges = min(2_000, -(-rows.count() // rows_a_bucket))
    if ranges <= 1:
        bucket = F.lit(0)
    else:
        bounds = sorted(set(rows.approxQuantile(keys[0], [k / ranges for k in range(1, ranges)], 0.2 / ranges)))
        bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(keys[0])))
    placed = rows.withColumn("_bucket", bucket)
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys)) - 1
    return placed.join(F.broadcast(offsets), "_bucket").withColumn(name, (own + F.col("_offset")).cast("long")).drop("_bucket", "_offset")


def neighbours(graph: Graph, node: int) -> DataFrame:
    return graph.edges.where(F.col("src") == node).select(F.col("dst").alias("id"))


def symmetry(matrix: DataFrame) -> DataFrame:
    """One row: entries, entries without their mirror image, and the greatest difference between an entry and its image."""
    one = coalesce_entries(matrix)
    image = one.select(F.col("col").alias("row"), F.col("row").alias("col"), F.col("val").alias("image"))
    both = one.join(image, ["row", "col"], "full_outer")
    gap = F.abs(F.coalesce("val", F.lit(0.0)) - F.coalesce("image", F.lit(0.0)))
    return both.agg(F.count("val").alias("entries"), F.count(F.when(F.col("val").isNotNull() & F.col("image").isNull(), 1)).alias("unpaired"), F.coalesce(F.max(gap), F.lit(0.0)).alias("greatest_gap"))


def is_symmetric(matrix: DataFrame, tolerance: float = 1e-8) -> bool:
    return symmetry(matrix).first()["greatest_gap"] <= tolerance


def one_hot(nodes: DataFrame, classes: int) -> DataFrame:
    """(id, soft): 1 at the label, 0 elsewhere; all 0 for a null label."""
    return nodes.select("id", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.coalesce((c == F.col("y")).cast("double"), F.lit(0.0))).alias("soft"))


def _drawn(id_col: Column, seed: int) -> Column:
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))


def split(nodes: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 1) -> DataFrame:
    """(id, split): int(train N) rows, int(val N) rows and the rest, in the order of a hash of id and seed."""
    n = nodes.count()
    ranked = dense_index(nodes.select("id", F.conv(F.substring(_drawn(F.col("id"), seed), 1, 12), 16, 10).cast("long").alias("draw")), "draw", "id", name="place")
    kind = F.when(F.col("place") < int(n * train), "train").when(F.col("place") < int(n * train) + int(n * val), "val").otherwise("test")
    return ranked.select("id", kind.alias("split"))


def selection_matrix(splits: DataFrame, kind: str) -> DataFrame:
    """(row, col, val): 1 at (node, its place among the nodes of that split, by id)."""
    own = dense_index(splits.where(F.col("split") == kind).select("id"), "id", name="col")
    return own.select(F.col("id").alias("row"), "col", F.lit(1.0).alias("val"))

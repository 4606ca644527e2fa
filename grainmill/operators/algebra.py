"""Coarsening algebra over an assignment table: assign(fine_id, coarse_id, wt), one row for each fine node.

A coarsening matrix has one non-zero in each column, so it is that table; products with it are joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.vectors import normalised, vector_sum
from grainmill.graph import Graph
from grainmill.operators.build import dense_index


def assignment(accepted: DataFrame, nodes: DataFrame) -> DataFrame:
    """From disjoint sets (members array) to assign. A set's first member stands for it, weights are 1/sqrt(size);
    other nodes stand for themselves; coarse ids number the representatives in order."""
    member = accepted.where(F.size("members") > 1).select(F.explode("members").alias("id"), F.col("members")[0].alias("rep"), F.size("members").alias("nc"))
    placed = nodes.select("id").join(member, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("nc", F.lit(1)).alias("nc"))
    reps = dense_index(placed.where("id = rep").select("rep"), "rep", name="coarse_id")
    return placed.join(reps, "rep").select(F.col("id").alias("fine_id"), "coarse_id", (1 / F.sqrt("nc")).alias("wt"))


def as_matrix(assign: DataFrame) -> DataFrame:
    return assign.select(F.col("coarse_id").alias("row"), F.col("fine_id").alias("col"), F.col("wt").alias("val"))


def coarsen_matrix(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(row, col, val): the sum of weights between members of each pair of supernodes, inner weights on the diagonal."""
    a = assign.select(F.col("fine_id").alias("src"), F.col("coarse_id").alias("row"))
    b = assign.select(F.col("fine_id").alias("dst"), F.col("coarse_id").alias("col"))
    return edges.join(a, "src").join(b, "dst").groupBy("row", "col").agg(F.sum("w").alias("val"))


def coarsen_edges(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """Edges between supernodes: no diagonal, and the mean of both directions."""
    a = assign.select(F.col("fine_id").alias("src"), F.col("coarse_id").alias("row"))
    b = assign.select(F.col("fine_id").alias("dst"), F.col("coarse_id").alias("col"))
    off = edges.join(a, "src").join(b, "dst").where("row <> col")
    once = off.groupBy(F.least("row", "col").alias("i"), F.greatest("row", "col").alias("j")).agg((F.sum("w") / 2).alias("w"))
    sides = F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst"), "w"), F.struct(F.col("j").alias("src"), F.col("i").alias("dst"), "w"))
    return once.select(F.explode(sides).alias("e")).select("e.*")


def coarsen_dense(dense: DataFrame, assign: DataFrame, size: int, x: str = "x") -> DataFrame:
    """(id, x): members' vectors summed with weights 1/sqrt(size)."""
    joined = assign.join(dense.select(F.col("id").alias("fine_id"), F.col(x).alias("_x")), "fine_id")
    return joined.groupBy(F.col("coarse_id").alias("id")).agg(vector_sum("_x", size, F.col("wt")).alias(x))


def coarsen_embeddings(dense: DataFrame, assign: DataFrame, size: int, x: str = "emb") -> DataFrame:
    return coarsen_dense(dense, assign, size, x).select("id", normalised(F.col(x)).alias(x))


def coarsen_vector(dense: DataFrame, assign: DataFrame, size: int, x: str = "pos") -> DataFrame:
    """(id, x): members' vectors with squared weights, which for one level is their mean."""
    joined = assign.join(dense.select(F.col("id").alias("fine_id"), F.col(x).alias("_x")), "fine_id")
    return joined.groupBy(F.col("coarse_id").alias("id")).agg(vector_sum("_x", size, F.col("wt") * F.col("wt")).alias(x))


def lift_vector(dense: DataFrame, assign: DataFrame, *columns: str) -> DataFrame:
    """Every node gets its supernode's values."""
    return assign.join(dense.select(F.col("id").alias("coarse_id"), *columns), "coarse_id").select(F.col("fine_id").alias("id"), *columns)


def lift_matrix(matrix: DataFrame, assign: DataFrame) -> DataFrame:
    """(row, col, val): a coarse entry spread over the pairs of members, by squared weights."""
    a = assign.select(F.col("coarse_id").alias("row"), F.col("fine_id").alias("fi"), F.col("wt").alias("wi"))
    b = assign.select(F.col("coarse_id").alias("col"), F.col("fine_id").alias("fj"), F.col("wt").alias("wj"))
    return matrix.join(a, "row").join(b, "col").select(F.col("fi").alias("row"), F.col("fj").alias("col"), (F.col("val") * F.col("wi") ** 2 * F.col("wj") ** 2).alias("val"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """The assignment of two levels as one: weights multiply."""
    later = second.select(F.col("fine_id").alias("coarse_id"), F.col("coarse_id").alias("_c"), F.col("wt").alias("_wt"))
    return first.join(later, "coarse_id").select("fine_id", F.col("_c").alias("coarse_id"), (F.col("wt") * F.col("_wt")).alias("wt"))


def construct(graph: Graph, assign: DataFrame, sizes: dict[str, int]) -> Graph:
    """The coarse graph. sizes: the length of each vector column of nodes among x, soft, emb, pos, b."""
    nodes = assign.select(F.col("coarse_id").alias("id")).distinct()
    for x, size in sizes.items():
        part = coarsen_vector(graph.nodes, assign, size, x) if x == "pos" else coarsen_embeddings(graph.nodes, assign, size, x) if x == "emb" else coarsen_dense(graph.nodes, assign, size, x)
        nodes = nodes.join(part, "id", "left")
    return Graph(nodes, coarsen_edges(graph.edges, assign))


def vote(labels: DataFrame, assign: DataFrame) -> DataFrame:
    """(id, y): the label of the greatest weight among each supernode's members; ties go to the least label."""
    votes = assign.join(labels.where("y IS NOT NULL").select(F.col("id").alias("fine_id"), "y"), "fine_id").groupBy("coarse_id", "y").agg(F.round(F.sum("wt"), 9).alias("s"))
    return votes.groupBy(F.col("coarse_id").alias("id")).agg(F.max(F.struct("s", (-F.col("y")).alias("ny"))).alias("b")).select("id", (-F.col("b.ny")).cast("int").alias("y"))


def train_vote(labels: DataFrame, assign: DataFrame, splits: DataFrame) -> DataFrame:
    """As ``vote``, with the votes of training nodes only."""
    return vote(labels.join(splits.where("split = 'train'"), "id", "left_semi"), assign)


def train_mask(assign: DataFrame, splits: DataFrame) -> DataFrame:
    """(id, is_train): a supernode trains if any member does."""
    own = assign.join(splits.select(F.col("id").alias("fine_id"), (F.col("split") == "train").alias("t")), "fine_id")
    return own.groupBy(F.col("coarse_id").alias("id")).agg(F.max("t").alias("is_train"))


def coarse_edges_and_features(graph: Graph, assign: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(src, dst) of the coarse graph, and (id, x) of its nodes."""
    return coarsen_edges(graph.edges, assign).select("src", "dst"), coarsen_dense(graph.nodes, assign, size)


def sets_of(pairs: DataFrame) -> DataFrame:
    """Matched pairs (i, j) as two-member sets."""
    return pairs.select(F.array(F.least("i", "j"), F.greatest("i", "j")).alias("members"))

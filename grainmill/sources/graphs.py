"""Graph sources: Parquet tables, edge and node files, and the two graphs derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.graph import Graph
from grainmill.operators.build import to_undirected
from grainmill.operators.cells import block_of
from grainmill.plans.shipping import ship

#: Rows of a block, the least number of blocks for rows enough, and rows that are multiplied at once.
BLOCK, SPREAD, TILE = 16_384, 4, 2_048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked(graph: Graph) -> Graph:
    """The graph, if its node ids are there and each once, and its edges join known nodes, each once, both ways alike; else an error."""
    nodes, edges = graph.nodes, graph.edges
    n = nodes.agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("ids"), F.count_distinct("id").alias("distinct")).first()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    mirror = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("back"))
    found = {
        "null ids of nodes": n["n"] - n["ids"],
        "repeated ids of nodes": n["ids"] - n["distinct"],
        "ends that are no node's": ends.count(),
        "repeated edges": edges.count() - edges.select("src", "dst").distinct().count(),
        "edges without an equal one back": edges.join(mirror, ["src", "dst"], "left").where("back IS NULL OR back <> w").count(),
    }
    wrong = {k: v for k, v in found.items() if v}
    if wrong:
        raise ValueError("not a graph: " + ", ".join(f"{v} {k}" for k, v in wrong.items()))
    return graph


def from_tables(nodes: DataFrame, edges: DataFrame) -> Graph:
    """A checked graph from nodes (id, ...) and edges (src, dst, and w, or all weigh 1), given one way or both."""
    weighted = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
    own = weighted.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double").alias("w"))
    return checked(Graph(nodes.withColumn("id", F.col("id").cast("long")), to_undirected(own)))


def from_files(spark: SparkSession, nodes: str, edges: str, kind: str = "parquet", **options: str) -> Graph:
    """``from_tables`` of files that Spark reads."""
    read = spark.read.options(**options).format(kind)
    return from_tables(read.load(nodes), read.load(edges))


def from_arrays(spark: SparkSession, features: np.ndarray, edges: np.ndarray, labels: np.ndarray) -> Graph:
    """``from_tables`` of arrays on the driver: features N x F, edges M x 2, labels N; ids are places."""
    ship(spark)
    x = pa.array(list(np.asarray(features, dtype=np.float64)), pa.list_(pa.float64()))
    nodes = pa.table({"id": pa.array(np.arange(len(x)), pa.int64()), "x": x, "y": pa.array(np.asarray(labels), pa.int32())})
    ends = np.asarray(edges, dtype=np.int64).reshape(-1, 2)
    return from_tables(spark.createDataFrame(nodes), spark.createDataFrame(pa.table({"src": ends[:, 0], "dst": ends[:, 1]})))


def write(graph: Graph, folder: str) -> None:
    """Nodes and edges as Parquet under a folder; ``from_files`` reads them."""
    graph.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{folder}/edges")


def _dealt_blocks(blocks: int) -> Callable:
    """Rows (id, x) to the pairs of blocks of their own; components that 32 bits hold are sent as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own, short = block_of(ids, blocks), x.astype("<f4")
            sent, rows = short if (short == x).all() else x.astype("<f8"), []
            for k in np.unique(own).tolist():
                at = own == k
                rows += [(min(k, o), max(k, o), int(k > o), ids[at].astype("<i8").tobytes(), sent.itemsize, sent[at].tobytes()) for o in range(blocks)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bi", "bj", "side", "ids", "width", "x"])

    return run


def similar_pairs(vectors: DataFrame, over: float) -> DataFrame:
    """Pairs i < j of rows (id, x) with an inner product over ``over``, block by block.

    Every row goes to as many blocks as there are, not to as many rows: blocks of BLOCK rows (fewer where that gives
    under SPREAD blocks) are multiplied as matrices, tile by tile, so no pair is made that does not count.
    """
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK), min(SPREAD, n // TILE))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        same = True
        for batch in batches:
            for bi, bj, side, ids, width, x in zip(*(c.to_pylist() for c in batch.columns)):
                same = bi == bj
                own = np.frombuffer(ids, "<i8")
                sides[side].append((own, np.frombuffer(x, f"<f{width}").reshape(len(own), -1).astype(np.float64)))
        held = [tuple(map(np.concatenate, zip(*s))) for s in sides if s]
        if not held or not same and len(held) < 2:
            return
        (a, x), (b, y) = held[0], held[-1]
        for start in range(0, len(a), TILE):
            for other in range(0, len(b), TILE):
                p, q = np.nonzero(x[start : start + TILE] @ y[other : other + TILE].T > over)
                i, j = a[start + p], b[other + q]
                if same:
                    i, j = i[i < j], j[i < j]
                for at in range(0, len(i), 100_000):
                    own, far = i[at : at + 100_000], j[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, far)), pa.array(np.maximum(own, far))], names=["i", "j"])

    dealt = vectors.select("id", "x").mapInArrow(_dealt_blocks(blocks), "bi int, bj int, side int, ids binary, width int, x binary")
    placed = dealt.repartitionById(blocks * (blocks + 1) // 2, (F.col("bj") * (F.col("bj") + 1) / 2 + F.col("bi")).cast("int"))
    return placed.mapInArrow(multiply, "i long, j long")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Rows (i, j, w) with i < j to edges in both directions."""
    return pairs.select(F.explode(F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst"), "w"), F.struct(F.col("j").alias("src"), F.col("i").alias("dst"), "w"))).alias("e")).select("e.*")


def embedding_graph(spark: SparkSession, sf_dir: str, over: float = 0.3) -> Graph:
    """Nodes: embeddings with features and labels; unit edges where the inner product exceeds ``over``."""
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))
    return Graph(nodes, both_ways(similar_pairs(nodes, over).withColumn("w", F.lit(1.0))))


def copurchase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (i, j, w): how often two parts were returned from one order. The join is on the order, which has few lines."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    a, b = lines.toDF("o", "i"), lines.toDF("o", "j")
    return a.join(b, "o").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).cast("double").alias("w"))


def copurchase_graph(spark: SparkSession, sf_dir: str) -> Graph:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("x"), F.substring_index("p_brand", "#", -1).alias("brand"))
    return Graph(nodes, both_ways(copurchase_pairs(spark, sf_dir)))

"""The data model: a graph as a node table and an edge table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """nodes: id, and optionally x array<double>, y int, pos, soft; edges: src, dst, w, in both directions."""

    nodes: DataFrame
    edges: DataFrame

    def with_positions(self, pos: DataFrame) -> Graph:
        """The graph with coordinates (id, pos) of its nodes; null where there are none."""
        return Graph(self.nodes.drop("pos").join(pos.select("id", "pos"), "id", "left"), self.edges)

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, edges)


def r6(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)

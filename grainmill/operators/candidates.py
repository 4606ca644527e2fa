"""Candidate sets, their local-variation cost and similarity, and the greedy choice of disjoint sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.functions.vectors import squared_distance, total
from grainmill.graph import Graph
from grainmill.operators.build import degree, dense_index
from grainmill.operators.cells import around, inner_edges, inner_sums, member_sums
from grainmill.operators.linalg import with_ends
from grainmill.operators.selection import within_budget
from grainmill.plans.stored import stored

#: Edges, and nodes with vectors, that one task holds while sets stream past.
PORTION, BLOCK = 4_000_000, 20_000
#: Linked sets around one node that are gone through size by size; where there are more, pivots leave most of them out.
MOST_SETS, LONGEST = 2_000_000, 9
NEIGHBOURHOOD, EDGES, TRIANGLES, CLIQUES = "neighborhood", "edges", "triangles", "cliques"


def neighbourhoods(graph: Graph) -> DataFrame:
    """(cand_id, members): each node with its neighbours, in order."""
    one = graph.edges.select(F.col("src").alias("cand_id"), F.col("dst").alias("m")).union(graph.nodes.select("id", "id"))
    return one.groupBy("cand_id").agg(F.array_sort(F.collect_set("m")).alias("members"))


def edge_sets(graph: Graph) -> DataFrame:
    return _named(graph.edges.where("src < dst").select(F.array("src", "dst").alias("members")))


def ranked_edges(graph: Graph) -> DataFrame:
    """(src, dst): each edge once, towards the end of more edges (of equals the greater id); no node has many onwards."""
    edges = graph.edges.where("src <> dst").select("src", "dst").distinct()
    n = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    both = edges.join(n, "src").join(n.toDF("dst", "m"), "dst")
    return both.where(F.struct("n", "src") < F.struct("m", "dst")).select("src", "dst")


def triangles(graph: Graph) -> DataFrame:
    """Each node's pairs of onward neighbours that are linked: two joins on node keys, few wedges at hubs."""
    on = ranked_edges(graph)
    uv, uw = on.toDF("u", "v"), on.toDF("u", "w")
    ends = F.struct(F.least("v", "w").alias("v"), F.greatest("v", "w").alias("w"))
    closing = on.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("w"))
    wedges = uv.join(uw, "u").where("v < w").select("u", ends.alias("e")).select("u", "e.v", "e.w")
    return _named(wedges.join(closing, ["v", "w"]).select(F.array_sort(F.array("u", "v", "w")).alias("members")))


def _in_levels(linked: np.ndarray, most: int) -> list[np.ndarray] | None:
    """The maximal sets of rows that are all linked, where a column linked to all of a set's rows makes it not maximal, as
    arrays of one size each: all linked sets, size by size, with what all their rows have in common as bits. None if they are over ``most``, or
    one is over LONGEST, whose subsets would be very many."""
    p, width = len(linked), -(-linked.shape[1] // 64)
    pack = lambda m: np.packbits(np.pad(m, ((0, 0), (0, 64 * width - m.shape[1]))), axis=1).view(np.uint64)
    bits = pack(linked)
    later = pack(np.arange(64 * width)[None, :] > np.where(np.arange(64 * width) < p, 0, 64 * width)[None, :] + np.arange(p)[:, None])
    found, seen = [], 0
    stack = [(np.arange(p)[:, None], bits)]
    while stack:
        sets, common = stack.pop()
        seen += len(sets)
        if seen > most or sets.shape[1] > LONGEST:
            return None
        full = ~common.any(axis=1)
        if full.any():
            found.append(sets[full])
        more = common & later[sets[:, -1]]
        row, byte = np.nonzero(more.view(np.uint8))
        which, bit = np.nonzero(np.unpackbits(more.view(np.uint8)[row, byte][:, None], axis=1))
        row, new = row[which], byte[which] * 8 + bit
        for k in range(0, len(row), 20_000):
            r, v = row[k : k + 20_000], new[k : k + 20_000]
            stack.append((np.hstack((sets[r], v[:, None])), common[r] & bits[v]))
    return found


def _by_pivots(linked: np.ndarray) -> list[np.ndarray]:
    """As ``_in_levels``, for sets that overlap so much that most linked ones are not maximal: a search with pivots."""
    p = len(linked)
    as_int = lambda m: [int.from_bytes(r.tobytes(), "little") for r in np.packbits(m, axis=1, bitorder="little")]
    rows, columns = as_int(linked), as_int(linked.T)

    def ones(x: int) -> list[int]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(-(-x.bit_length() // 8) or 1, "little"), np.uint8), bitorder="little")).tolist()

    found: dict[int, list] = {}
    stack = [([], (1 << p) - 1, (1 << linked.shape[1]) - (1 << p))]
    while stack:
        chosen, may, not_again = stack.pop()
        if not may:
            if not not_again and chosen:
                found.setdefault(len(chosen), []).append(sorted(chosen))
            continue
        pivot = max(ones(may | not_again), key=lambda v: (may & columns[v]).bit_count())
        for v in ones(may & ~columns[pivot]):
            stack.append(([*chosen, v], may & rows[v], not_again & rows[v]))
            may &= ~(1 << v)
            not_again |= 1 << v
    return [np.array(sets) for sets in found.values()]


def cliques(graph: Graph) -> DataFrame:
    """All maximal cliques.

    Each node finds those among its neighbours of higher rank, by degree, then id, which are few even at a hub; what is
    linked to all of one among the neighbours of lower rank shows that it is not maximal. The links inside neighbourhoods come from cells.
    """
    once = stored(graph.edges.where("src < dst").select("src", "dst"))
    n = once.select("src").union(once.select("dst")).toDF("id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ranks = stored(dense_index(n, "n", "id", name="rank").select("id", "rank"))

    def search(center: int, own: np.ndarray, others: np.ndarray, linked: np.ndarray) -> Iterator[np.ndarray]:
        found = _in_levels(linked, MOST_SETS)
        for sets in _by_pivots(linked) if found is None else found:
            for k in range(0, len(sets), 20_000):
                part = own[sets[k : k + 20_000]]
                yield np.sort(np.hstack((part, np.full((len(part), 1), center))), axis=1)

    def batch(found: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.append(0, np.cumsum(np.repeat([f.shape[1] for f in found], [len(f) for f in found])))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([f.ravel() for f in found])))], names=["members"])

    return _named(around(once, ranks, PORTION, search, "members array<long>", batch))


def _named(sets: DataFrame) -> DataFrame:
    """cand_id for sets that no node names: a hash of the members."""
    return sets.select(F.xxhash64("members").alias("cand_id"), "members")


def family(graph: Graph, mode: str) -> DataFrame:
    makers = {NEIGHBOURHOOD: neighbourhoods, EDGES: edge_sets, TRIANGLES: triangles, CLIQUES: cliques}
    if mode not in makers:
        raise ValueError(f"no family {mode!r}")
    return makers[mode](graph)


def memberships(cands: DataFrame) -> DataFrame:
    return cands.select("cand_id", F.explode("members").alias("m"))


def subgraphs(cands: DataFrame, graph: Graph) -> DataFrame:
    """(cand_id, src, dst, w): the edges inside each set, found cell by cell."""
    return inner_edges(cands, graph, PORTION)


def costs(cands: DataFrame, graph: Graph, basis: DataFrame, size: int, x: str = "a") -> DataFrame:
    """(cand_id, nc, cost): the norm of P' L_S P over size - 1, P the centred rows of the basis.

    L_S has 2 deg - d_S on its diagonal (deg doubled, d_S the degree inside). With u = (1, row of the basis) that is made
    of the sum over members of 2 deg u u' less the sum over inner edges of w (u_i + u_j)(u_i + u_j)', which ``inner_sums``
    adds up cell by cell; the mean is taken off at the end. Sets of one cost 0.
    """
    nodes = basis.select("id", F.col(x).alias("x")).join(degree(graph), "id").select("id", (2.0 * F.col("deg")).alias("deg"), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                m, u = both[:, : (size + 1) ** 2].reshape(-1, size + 1, size + 1), both[:, (size + 1) ** 2 :]
                n = u[:, 0]
                mean = u[:, 1:] / n[:, None]
                side = m[:, 1:, 0][:, :, None] * mean[:, None, :]
                q = m[:, 1:, 1:] - side - side.transpose(0, 2, 1) + m[:, 0, 0][:, None, None] * mean[:, :, None] * mean[:, None, :]
                cost = np.where(n > 1, np.sqrt((q * q).sum(axis=(1, 2))) / np.maximum(1, n - 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.round().astype(np.int32)), pa.array(cost)], names=["cand_id", "nc", "cost"])

    return inner_sums(cands, graph, nodes, size, PORTION).mapInArrow(run, "cand_id long, nc int, cost double")


def similarities(cands: DataFrame, dense: DataFrame, size: int, x: str = "x") -> DataFrame:
    """(cand_id, sim): the mean inner product of pairs of members, from the sum of vectors and of squared lengths alone."""
    own = member_sums(cands, dense.select("id", F.col(x).alias("x")), size, BLOCK).select("cand_id", F.col("q")[0].alias("n"), F.slice("q", 2, size).alias("s"), F.col("q")[size + 1].alias("sq"))
    pairs = F.col("n") * (F.col("n") - 1)
    return own.select("cand_id", F.when(F.col("n") > 1, (total(F.transform("s", lambda v: v * v)) - F.col("sq")) / pairs).otherwise(1.0).alias("sim"))


def choose(ranked: Iterable[tuple[int, list[int]]], budget: int) -> list[int]:
    """The greedy choice over (cand_id, members) in order: a set goes in if it meets none that went in and fits the
    budget of removed nodes; it ends when the budget is used up."""
    taken: set[int] = set()
    out = []
    for cand_id, members in ranked:
        if budget <= 0:
            break
        if len(members) - 1 <= budget and len(members) > 1 and taken.isdisjoint(members):
            taken.update(members)
            budget -= len(members) - 1
            out.append(cand_id)
    return out


def greedy(cands: DataFrame, cost: DataFrame, sim: DataFrame | None, budget: int, threshold: float) -> DataFrame:
    """The accepted sets (cand_id, members) in the order of (cost to 9 decimals, cand_id).

    Sets that are alike enough and small enough take part; ``choose`` tells the rule, ``selection`` carries it out.
    """
    rank = F.struct(F.round("cost", 9).alias("c"), F.col("cand_id").alias("i"))
    live = cost.select("cand_id", "cost")
    if sim is not None:
        live = live.join(sim.where(F.col("sim") > threshold), "cand_id", "left_semi")
    live = stored(live)  # small beside the members, which then meet few sets, mostly without a shuffle
    own = cands.where(F.size("members").between(2, budget + 1)).join(live, "cand_id")
    ranked = stored(own.select(F.col("cand_id").alias("key"), "members", rank.alias("rank")))
    return within_budget(ranked, budget).select(F.col("key").alias("cand_id"), "members")


def variation_edge_costs(graph: Graph, basis: DataFrame, x: str = "a") -> DataFrame:
    """(src, dst, cost): half the sum of both (doubled) degrees times the squared distance of the basis rows."""
    ends = with_ends(graph.edges.where("src < dst"), basis.join(degree(graph), "id"), x, "deg")
    return ends.select("src", "dst", ((F.col("deg_i") + F.col("deg_j")) / 2 * squared_distance(F.col(f"{x}_i"), F.col(f"{x}_j"))).alias("cost"))

"""Sums and edges inside sets, cell by cell, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.graph import Graph
from grainmill.operators import candidates, cells
from grainmill.plans import spectral


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def loops(spark):
    """Ids of any size and sign, weights, and a node linked to itself."""
    rng = np.random.default_rng(7)
    ids = np.sort(rng.choice(2**40, 40, replace=False)) - 2**39
    w = np.triu(rng.integers(0, 4, (40, 40)) * (rng.random((40, 40)) < 0.3), 1).astype(float)
    w[3, 3] = 2.0
    w = np.maximum(w, w.T)
    x = rng.normal(size=(40, 2))
    nodes = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, x array<double>")
    edges = spark.createDataFrame([(int(ids[a]), int(ids[b]), float(w[a, b])) for a, b in np.argwhere(w > 0)], "src long, dst long, w double")
    return ids.tolist(), w, x, Graph(nodes, edges)


def test_packed_integers():
    for x in ([], [5], [3, 3, 1], [-(2**62), 2**62, 0], list(range(1000))):
        assert cells.unpacked(cells.packed(np.array(x, dtype=np.int64))).tolist() == x


@pytest.mark.parametrize("portion", [3, 40, 10**6])
def test_inside_sets_by_cells(loops, monkeypatch, portion):
    ids, w, x, g = loops
    monkeypatch.setattr(candidates, "PORTION", portion)
    monkeypatch.setattr(candidates, "BLOCK", portion)
    cands = candidates.neighbourhoods(g).cache()
    sets = {r.cand_id: [ids.index(m) for m in r.members] for r in cands.collect()}
    got = sorted(map(tuple, candidates.subgraphs(cands, g).collect()))
    assert got == sorted((c, ids[a], ids[b], w[a, b]) for c, s in sets.items() for a in s for b in s if w[a, b])
    cost = {r.cand_id: (r.nc, r.cost) for r in candidates.costs(cands, g, g.nodes.withColumnRenamed("x", "a"), 2).collect()}
    sim = {r.cand_id: r.sim for r in candidates.similarities(cands, g.nodes, 2).collect()}
    for c, s in sets.items():
        own, p = w[np.ix_(s, s)], x[s] - x[s].mean(axis=0)
        lap = np.diag(2 * (2 * w[s].sum(axis=1)) - own.sum(axis=1)) - own
        assert cost[c][0] == len(s) and np.isclose(cost[c][1], np.linalg.norm(p.T @ lap @ p) / (len(s) - 1) if len(s) > 1 else 0.0)
        assert np.isclose(sim[c], (x[s] @ x[s].T)[np.triu_indices(len(s), 1)].mean() if len(s) > 1 else 1.0)


def test_no_row_for_a_set_and_an_edge(loops):
    """Sets are not joined with edges, whose rows grow with the cube of the degrees' sum."""
    *_, g = loops
    cands = candidates.neighbourhoods(g)
    for made in (candidates.costs(cands, g, g.nodes.withColumnRenamed("x", "a"), 2), candidates.subgraphs(cands, g), candidates.similarities(cands, g.nodes, 2)):
        assert "Join [cand_id" not in plan(made) and "Join [m#" not in plan(made)


def test_choice_ranks_before_members_are_joined(loops, monkeypatch):
    """The members of sets, the widest rows there are, are joined once, with what is left after cost and similarity."""
    *_, g = loops
    cands = candidates.neighbourhoods(g)
    cost, sim = cands.selectExpr("cand_id", "cast(cand_id % 7 as double) AS cost"), cands.selectExpr("cand_id", "1.0D AS sim")
    plans, stored = [], candidates.stored
    monkeypatch.setattr(candidates, "stored", lambda df: (plans.append((df.columns, plan(df).count("Join"))), stored(df))[1])
    assert candidates.greedy(cands, cost, sim, 30, 0.5).count()
    assert [joins for columns, joins in plans if "members" in columns] == [1]


@pytest.mark.parametrize("portion", [3, 10**6])
def test_laplacian_by_cells(loops, portion):
    ids, w, x, g = loops
    around = cells.Neighbours(g, portion)
    own = w - np.diag(np.diag(w))
    want = (np.diag(own.sum(axis=1)) - own) @ x
    made = around.laplacian(g.nodes, 2)
    assert "Join" not in plan(made)
    got = {r.id: r.x for r in made.collect()}
    assert np.allclose([got[i] for i in ids], want) and len(got) == len(ids)
    around.discard()


def test_components_go_through_few_links(loops, monkeypatch):
    """One link a node, then what still joins components: never all edges in rounds."""
    ids, w, _, g = loops
    counts, components = [], spectral.components
    monkeypatch.setattr(spectral, "components", lambda links, *ends: (counts.append(links.count()), components(links, *ends))[1])
    got = {r.id: r.component for r in spectral._components(g).collect()}
    reach = np.linalg.matrix_power((w > 0).astype(float) + np.eye(40), 40) > 0
    assert got == {i: min(j for j, r in zip(ids, reach[k]) if r) for k, i in enumerate(ids)}
    assert len(counts) == 2 and counts[0] <= 40 and counts[1] < 40


def test_no_sets(loops):
    *_, g = loops
    none = candidates.neighbourhoods(g).where(F.lit(False))
    assert candidates.costs(none, g, g.nodes.withColumnRenamed("x", "a"), 2).count() == 0
    assert candidates.subgraphs(none, g).count() == 0 and candidates.similarities(none, g.nodes, 2).count() == 0


@pytest.mark.parametrize("most", [0, 10**6])
@pytest.mark.parametrize("portion", [8, 10**6])
def test_maximal_cliques_by_cells(loops, spark, monkeypatch, portion, most):
    """Against a plain search, also with a hub and with copies; no join has a row for a clique or for a pair of neighbours."""
    monkeypatch.setattr(candidates, "PORTION", portion)
    monkeypatch.setattr(candidates, "MOST_SETS", most)
    ids, w, x, g = loops
    linked = w > 0
    linked[5, :] = linked[:, 5] = True  # a hub
    linked[10:18, 10:18] = True  # a set of copies
    np.fill_diagonal(linked, False)
    pairs = [(ids[a], ids[b], 1.0) for a, b in np.argwhere(linked)]
    g = Graph(g.nodes, spark.createDataFrame(pairs, "src long, dst long, w double"))

    def plain(chosen, may, no):
        if not may and not no:
            yield tuple(sorted(ids[v] for v in chosen))
        for v in sorted(may):
            near = set(np.flatnonzero(linked[v]))
            yield from plain([*chosen, v], may & near, no & near)
            may, no = may - {v}, no | {v}

    out = candidates.cliques(g)
    assert sorted(tuple(r.members) for r in out.collect()) == sorted(plain([], set(range(len(ids))), set()))
    assert "Join" not in plan(out)


def test_gaps():
    for x in ([], [0], [254], [255], [256], [0, 1, 255, 510, 511, 5000]):
        assert cells._from_gaps(cells._gaps(np.array(x, dtype=np.int64))).tolist() == x

"""Invariants and hand-sized graphs, against plain numpy."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill import registry
from grainmill.graph import Graph
from grainmill.operators import algebra, build, candidates, frames, linalg, proximity, sage, selection
from grainmill.plans import logs, multilevel, spectral, training
from grainmill.sources import graphs


def graph(spark, n, pairs, x=None, y=None):
    nodes = spark.createDataFrame([(i, [float(v) for v in (x[i] if x is not None else (i, 1))], int(y[i]) if y is not None else i % 2) for i in range(n)], "id long, x array<double>, y int")
    edges = [(i, j, float(w)) for i, j, w in pairs] + [(j, i, float(w)) for i, j, w in pairs if i != j]
    return Graph(nodes, spark.createDataFrame(edges, "src long, dst long, w double"))


def matrix(df, n, m=None):
    out = np.zeros((n, m or n))
    for r in df.select("row", "col", "val").collect():
        out[r.row, r.col] += r.val
    return out


def dense(df, x="x"):
    rows = sorted(df.select("id", x).collect())
    return np.array([r[1] for r in rows])


RNG = random.Random(4)
N = 24
PAIRS = [(i, j, RNG.randint(1, 5)) for i in range(N) for j in range(i + 1, N) if RNG.random() < 0.2 and j != 23]  # 23 stays alone


@pytest.fixture(scope="module")
def g(spark):
    x = np.random.default_rng(0).normal(size=(N, 3))
    out = graph(spark, N, PAIRS, x)
    return Graph(out.nodes.cache(), out.edges.cache())


def w_of():
    w = np.zeros((N, N))
    for i, j, v in PAIRS:
        w[i, j] = w[j, i] = v
    return w


def test_laplacian_and_gradient(g):
    lap = matrix(build.laplacian(g), N)
    w = w_of()
    assert np.allclose(lap, np.diag(w.sum(1)) - w) and np.allclose(lap.sum(1), 0)
    s = matrix(build.gradient_matrix(g).select(F.col("node").alias("row"), F.col("edge").alias("col"), "val"), N, len(PAIRS))
    assert np.allclose(s @ s.T, lap)
    x = dense(g.nodes)
    assert np.allclose(dense(linalg.laplacian_spmm(g, g.nodes, 3)), lap @ x)
    assert np.allclose(linalg.gram(g, g.nodes, 3), x.T @ lap @ x)
    assert np.allclose([r.val for r in linalg.quadratic_form(g, g.nodes, 3).orderBy("k").collect()], np.diag(x.T @ lap @ x))
    assert build.is_symmetric(build.laplacian(g)) and not build.is_symmetric(build.weights_matrix(g).where("row < col"))
    values, vectors = linalg.eigenpairs(build.laplacian(g), N)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, lap)


def test_dense_index_in_ranges(spark):
    rows = spark.createDataFrame([(v * v,) for v in range(50)], "k long")
    got = {r.k: r.at for r in build.dense_index(rows, "k", name="at", rows_a_bucket=7).collect()}
    assert got == {v * v: v for v in range(50)}


def test_coarsening_matrix_is_orthonormal(spark, g):
    sets = spark.createDataFrame([([0, 3, 5],), ([1, 2],), ([4],)], "members array<long>")
    assign = algebra.assignment(sets, g.nodes)
    n = assign.select("coarse_id").distinct().count()
    c = matrix(algebra.as_matrix(assign), n, N)
    assert n == N - 3 and np.allclose(c @ c.T, np.eye(n))
    p = (c > 0).astype(float)
    wc = matrix(algebra.coarsen_matrix(g.edges, assign), n)
    assert np.allclose(wc, p @ w_of() @ p.T)
    new = algebra.construct(g, assign, {"x": 3})
    assert np.allclose(matrix(build.weights_matrix(new), n), wc - np.diag(np.diag(wc)))
    assert np.allclose(dense(new.nodes), c @ dense(g.nodes))
    lifted = matrix(algebra.lift_matrix(algebra.coarsen_matrix(g.edges, assign), assign), N)
    assert np.isclose(lifted.sum(), wc.sum())


def plain_cost(w, a, s):
    deg = 2 * w.sum(1)
    ws = w[np.ix_(s, s)]
    ls = np.diag(2 * deg[s] - ws.sum(1)) - ws
    p = a[s] - a[s].mean(0)
    return np.linalg.norm(p.T @ ls @ p) / (len(s) - 1) if len(s) > 1 else 0.0


def test_families_costs_and_similarity(g):
    w, x = w_of(), dense(g.nodes)
    nb = candidates.neighbourhoods(g)
    members = {r.cand_id: r.members for r in nb.collect()}
    assert members == {i: sorted({i, *np.flatnonzero(w[i]).tolist()}) for i in range(N)}
    cost = {r.cand_id: r.cost for r in candidates.costs(nb, g, g.nodes.withColumnRenamed("x", "a"), 3).collect()}
    sim = {r.cand_id: r.sim for r in candidates.similarities(nb, g.nodes, 3).collect()}
    for i, s in members.items():
        assert np.isclose(cost[i], plain_cost(w, x, s))
        inner = (x[s] @ x[s].T)[np.triu_indices(len(s), 1)]
        assert np.isclose(sim[i], inner.mean() if len(s) > 1 else 1.0)
    tri = {tuple(r.members) for r in candidates.triangles(g).collect()}
    assert tri == {(a, b, c) for a in range(N) for b in range(a + 1, N) for c in range(b + 1, N) if w[a, b] and w[b, c] and w[a, c]}
    found = {tuple(r.members) for r in candidates.cliques(g).collect()}
    for mask in found:
        assert all(w[a, b] for a in mask for b in mask if a < b) and not any(all(w[v, a] for a in mask) for v in range(N) if v not in mask)
    for a, b, _ in PAIRS:
        assert any({a, b} <= set(m) for m in found)
    edge = {(r.src, r.dst): r.cost for r in candidates.variation_edge_costs(g, g.nodes.withColumnRenamed("x", "a")).collect()}
    deg = 2 * w.sum(1)
    assert all(np.isclose(v, (deg[i] + deg[j]) / 2 * ((x[i] - x[j]) ** 2).sum()) for (i, j), v in edge.items())


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("budget", [2, 5, 17, 100])
def test_greedy_equals_one_by_one(spark, monkeypatch, budget, small):
    monkeypatch.setattr(selection, "SMALL", small)
    rng = random.Random(budget)
    sets = [(k, sorted(rng.sample(range(40), rng.randint(1, 5)))) for k in range(60)]
    cost = [(k, round(rng.random(), 1)) for k, _ in sets]
    cands, costs = spark.createDataFrame(sets, "cand_id long, members array<long>"), spark.createDataFrame(cost, "cand_id long, cost double")
    order = [k for _, k in sorted((c, k) for k, c in cost)]
    want = candidates.choose(((k, dict(sets)[k]) for k in order), budget)
    assert {r.cand_id for r in candidates.greedy(cands, costs, None, budget, 0.5).collect()} == set(want)


@pytest.mark.parametrize("rising", [False, True])
def test_long_chains_settle(spark, rising):
    n = 10_000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (F.col("id") if rising else F.lit(0)).cast("double").alias("val"))
    got = {(r.i, r.j) for r in proximity.matching_greedy(edges, n).collect()}
    assert got == {(i, i + 1) for i in (range(n - 1, -1, -2) if rising else range(0, n, 2))}
    assert proximity.matching_greedy(edges, 100).count() == 100


def test_running_sums_in_ranges(spark):
    rng = random.Random(3)
    rows = [(float(rng.randrange(5)), k, rng.randint(1, 9)) for k in range(900)]
    df = spark.createDataFrame(rows, "c double, i long, size long").select(F.struct("c", "i").alias("rank"), "size")
    for budget in (0, 1, 700, 2500, 10**6):
        want, total = None, 0
        for c, i, size in sorted(rows):
            if total + size > budget:
                want = ((c, i), total)
                break
            total += size
        for most in (10, 10**6):
            got = selection.first_over(df, budget, most)
            assert (got is None) == (want is None)
            if got:
                assert tuple(df.limit(1).select(got[0].alias("r")).first().r) == want[0] and got[1] == want[1]


def test_costs_of_large_sets_in_portions(g, monkeypatch):
    nb = candidates.neighbourhoods(g)
    a = g.nodes.withColumnRenamed("x", "a")
    want = {r.cand_id: r.cost for r in candidates.costs(nb, g, a, 3).collect()}
    monkeypatch.setattr(candidates, "PORTION", 2)
    got = {r.cand_id: r.cost for r in candidates.costs(nb, g, a, 3).collect()}
    assert want.keys() == got.keys() and all(np.isclose(got[k], v) for k, v in want.items())


def test_greedy_matching_equals_one_by_one(g):
    weights = proximity.heavy_edge_degree(g)
    rows = sorted(((-r.val, r.src, r.dst) for r in weights.collect()))
    used, want = set(), []
    for _, i, j in rows:
        if not {i, j} & used:
            used |= {i, j}
            want.append((i, j))
    for budget in (3, 100):
        assert {(r.i, r.j) for r in proximity.matching_greedy(weights, budget).collect()} == set(want[:budget])
    assert proximity.matching_greedy(weights.where("false"), 5).count() == 0


def test_smoothed_vectors(g):
    w = w_of()
    d = w.sum(1)
    lap = np.diag(d) - w
    x = dense(proximity.start_vectors(g.nodes, 2))
    want = x.copy()
    for _ in range(6):
        want = want - np.divide(lap @ want, 4 * d[:, None], out=np.zeros_like(want), where=d[:, None] > 0)
    assert np.allclose(dense(proximity.jacobi_vectors(g, 2, 6)), want)
    lower = np.tril(lap) + np.diag((d == 0).astype(float))
    assert np.allclose(dense(proximity.gauss_seidel_vectors(g, 2)), np.linalg.solve(lower, -np.triu(lap, 1) @ x))
    values, vectors = np.linalg.eigh(lap)
    cut = float(values[N // 2] + values[N // 2 + 1]) / 2
    ideal = vectors @ np.diag(values <= cut).astype(float) @ vectors.T @ x
    got = dense(proximity.chebyshev_vectors(g, 2, cut, 60))
    assert np.linalg.norm(got - ideal) < 0.5 * np.linalg.norm(x - ideal)
    for name in multilevel.MEASURES:
        assert proximity.proximity(g, name, 3).count() == len(PAIRS)


@pytest.mark.parametrize("hub", [False, True])
def test_iterated_spectrum_equals_the_dense_one(spark, monkeypatch, hub):
    pairs = PAIRS + [(0, j, 1) for j in range(1, N - 1) if hub and not any(p[:2] == (0, j) for p in PAIRS)]
    pairs += [(N + i, N + j, 1) for i, j in ((0, 1), (1, 2), (0, 2))]  # a second component
    n = N + 3
    own = graph(spark, n, pairs)
    lap = matrix(build.laplacian(own), n)
    values = np.linalg.eigvalsh(lap)
    null = int((values < 1e-9).sum())
    assert null == 3
    monkeypatch.setattr(spectral, "DENSE_NODES", 1)
    for size in (2, 6):
        vectors, got = spectral.smallest_eigenpairs(own, size)
        assert np.allclose(got, values[:size], atol=1e-6 * values.max()) and (got[:null] == 0).all()
        x = dense(vectors)
        assert np.allclose(x.T @ x, np.eye(size), atol=1e-6)
        assert np.linalg.norm(lap @ x - x * got, axis=0).max() <= 1e-6 * 2 * np.diag(lap).max()
    b = dense(spectral.basis(own, 6), "b")
    assert np.allclose(b.T @ lap @ b, np.diag([1, 1, 1, 0, 0, 0]), atol=1e-6)


def test_iterated_spectrum_fails_loudly(g, monkeypatch):
    monkeypatch.setattr(spectral, "DENSE_NODES", 1)
    monkeypatch.setattr(spectral, "MOST_ROUNDS", 2)
    monkeypatch.setattr(spectral, "TOLERANCE", 1e-12)
    with pytest.raises(RuntimeError, match="not found after"):
        spectral.smallest_eigenpairs(g, 4)


def test_spectral_basis(g):
    lap = matrix(build.laplacian(g), N)
    values = np.linalg.eigvalsh(lap)
    assert np.allclose(spectral.smallest_eigenpairs(g, 4)[1], values[:4])
    b = dense(spectral.basis(g, 4), "b")
    gram = b.T @ lap @ b
    assert np.allclose(gram, np.diag(np.round(np.diag(gram)))) and np.isclose(np.trace(gram), (values[:4] > 1e-9).sum())
    a = dense(spectral.whiten(g, spectral.basis(g, 4), 4, "proper"), "a")
    assert np.allclose(a.T @ lap @ a, np.diag([0, 0, 1, 1]))


@pytest.mark.parametrize("method,algorithm", [("variation_neighborhoods", "greedy"), ("variation_cliques", "greedy"), ("variation_edges", "greedy"), ("heavy_edge", "optimal"), ("kron", "greedy")])
def test_levels(g, tmp_path, method, algorithm):
    out = multilevel.coarsen(g, 6, 0.4, 2, method, algorithm, threshold=-10.0, sizes={"x": 3})
    assert len(out.graphs) >= 2
    for before, step, after in zip(out.graphs, out.steps, out.graphs[1:]):
        n, m = before.nodes.count(), after.nodes.count()
        c = matrix(algebra.as_matrix(step), m, n)
        assert np.allclose(c @ c.T, np.eye(m)) and n - m <= np.ceil(0.4 * n)
    whole = matrix(algebra.as_matrix(out.composed[-1]), out.graphs[-1].nodes.count(), N)
    assert (np.count_nonzero(whole, axis=0) == 1).all()
    if method == "kron":
        out.write(str(tmp_path))
        back = multilevel.Hierarchy.read(g.nodes.sparkSession, str(tmp_path))
        assert back.counts().orderBy("level").collect() == out.counts().orderBy("level").collect()
        assert [a.count() for a in (*back.steps, *back.composed)] == [a.count() for a in (*out.steps, *out.composed)]
        nodes, edges = frames.frames(out.graphs, frames.scattered(g.nodes), out.steps, out.composed)
        assert nodes.where("level = 0").count() == N and edges.count() > 0


@pytest.mark.parametrize("method", ["heavy_edge", "algebraic_JC", "kron", "variation_edges", "variation_triangles"])
def test_a_basis_only_for_costs_by_it(g, monkeypatch, method):
    asked = []
    monkeypatch.setattr(multilevel, "basis", lambda *args: asked.append(args) or spectral.basis(*args))
    out = multilevel.coarsen(g, 4, 0.3, 2, method, threshold=-10.0)
    assert len(out.graphs) >= 2 and len(asked) == (1 if method.startswith("variation") else 0)


def test_unknown_names(g):
    with pytest.raises(ValueError):
        multilevel.apply_graph_coarsening(g, "no_such_method")
    with pytest.raises(ValueError):
        candidates.family(g, "squares")
    with pytest.raises(ValueError):
        build.degree(g, "half")


def test_no_edges_and_one_node(spark):
    lone = graph(spark, 1, [])
    assert [r.deg for r in build.degree(lone).collect()] == [0.0]
    assert candidates.neighbourhoods(lone).count() == 1 and build.laplacian(lone).count() == 1
    assert len(multilevel.coarsen(lone, 3, 0.5).graphs) == 1
    four = graph(spark, 4, [])
    assert len(multilevel.coarsen(four, 3, 0.5).graphs) == 2 and frames.edge_density(four).first().density == 0


def test_similar_pairs_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(60, 5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if x[i] @ x[j] > 1.0}
    for block in (4096, 17):
        monkeypatch.setattr(graphs, "BLOCK", block)
        got = [(r.i, r.j) for r in graphs.similar_pairs(rows, 1.0).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_blocks_send_32_bits_where_they_hold_the_vectors(spark):
    # a row goes to each pair of blocks, so its width counts there
    x = np.random.default_rng(2).normal(size=(30, 5)).astype(np.float32)
    for own, width in ((x.astype(np.float64), 4), (x.astype(np.float64) + 1e-12, 8)):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "id long, x array<double>")
        dealt = rows.mapInArrow(graphs._dealt_blocks(3), "bi int, bj int, side int, ids binary, width int, x binary").collect()
        assert {r.width for r in dealt} == {width} and sum(len(r.x) for r in dealt) == 30 * 3 * 5 * width
        want = {(i, j) for i in range(30) for j in range(i + 1, 30) if own[i] @ own[j] > 1.0}
        assert {tuple(r) for r in graphs.similar_pairs(rows, 1.0).collect()} == want


def planted(spark, n=40, seed=3):
    rng = random.Random(seed)
    y = [i % 2 for i in range(n)]
    pairs = [(i, j, 1) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.3 if y[i] == y[j] else 0.02)]
    x = [[1.0 + rng.gauss(0, 0.6) if y[i] else -1.0 + rng.gauss(0, 0.6), rng.gauss(0, 1)] for i in range(n)]
    return graph(spark, n, pairs, x, y)


def test_gradients_and_learning(spark):
    g = planted(spark)
    g = Graph(g.nodes.withColumn("train", F.lit(True)).cache(), g.edges.cache())
    model = sage.Sage.create(2, 3, 2, dropout=0.0)

    def loss():
        return sage.nll(model.forward(g), g.nodes).first().loss

    before = {k: v.copy() for k, v in model.weights.items()}
    seen = {}
    model.adam = lambda grads, rate, decay: seen.update(grads)
    value, _ = model.train_epoch(g, 0)
    assert abs(value - loss()) < 1e-9
    for k in ("l1", "r2", "b1"):
        at = (0,) * before[k].ndim
        ends = []
        for step in (1e-5, -1e-5):
            model.weights = {n: v.copy() for n, v in before.items()}
            model.weights[k][at] += step
            ends.append(loss())
        assert abs((ends[0] - ends[1]) / 2e-5 - seen[k][at]) < 1e-6
    del model.adam
    model.weights = before
    losses = [model.train_epoch(g, e, rate=0.1)[0] for e in range(6)]
    assert losses[-1] < losses[0]


def test_coarsen_and_train(spark, tmp_path):
    out = training.train(planted(spark), 2, 2, levels=1, epochs_per_level=3, rate=0.1, threshold=0.0, k=4, hidden=4)
    out.write(str(tmp_path))
    runs, curves, composed = training.read_runs(spark, str(tmp_path))
    assert curves.count() == 3 and len(composed) == 1
    row = runs.first()
    assert row.level == 1 and row.num_nodes <= 40 and 0 <= row.acc_fine <= 1


def test_dropout_mask():
    mask = sage.kept(np.arange(2000), 5, 0.3)
    assert abs(mask.mean() - 1) < 0.05 and set(np.unique(mask.round(6))) == {0.0, round(1 / 0.7, 6)}


def test_sources_are_checked(spark, tmp_path):
    x, edges, y = np.eye(3), np.array([[0, 1], [1, 2], [2, 1]]), np.array([0, 1, 0])
    own = graphs.from_arrays(spark, x, edges, y)
    assert sorted(map(tuple, own.edges.collect())) == [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    graphs.write(own, str(tmp_path / "g"))
    back = graphs.from_files(spark, str(tmp_path / "g/nodes"), str(tmp_path / "g/edges"))
    assert back.edges.count() == 4 and back.nodes.count() == 3
    (tmp_path / "e.csv").write_text("src,dst\n0,1\n0,2\n")
    (tmp_path / "n.csv").write_text("id,y\n0,1\n1,1\n2,0\n")
    assert graphs.from_files(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"), "csv", header="true", inferSchema="true").edges.count() == 4
    for nodes, ends, what in (([(0,), (0,)], [(0, 0, 1.0)], "repeated ids"), ([(0,)], [(0, 1, 1.0), (1, 0, 1.0)], "no node's"), ([(0,), (None,)], [], "null ids"), ([(0,), (1,)], [(0, 1, 1.0)], "back")):
        with pytest.raises(ValueError, match=what):
            graphs.checked(Graph(spark.createDataFrame(nodes, "id long"), spark.createDataFrame(ends, "src long, dst long, w double")))
    placed = own.with_positions(frames.scattered(own.nodes))
    assert placed.nodes.where("pos IS NOT NULL").count() == 3 and frames.layout(placed).count() == 3


def test_springs_pull_links_together(spark):
    pairs = [(i, j, 1) for k in (0, 6) for i in range(k, k + 6) for j in range(i + 1, k + 6)] + [(0, 6, 1)]
    own = graph(spark, 12, pairs)
    at = dense(frames.spring_layout(own, 15), "pos")
    away = np.linalg.norm(at[:, None] - at[None], axis=2)
    linked = np.mean([away[i, j] for i, j, _ in pairs])
    apart = np.mean([away[i, j] for i in range(6) for j in range(6, 12)])
    assert np.isfinite(at).all() and linked < 0.7 * apart


def test_frame_modes(spark, monkeypatch):
    assert [frames.frame_mode(n, m) for n, m in ((501, 1), (10, 11), (500, 10))] == ["fast", "fast", "quality"]
    with pytest.raises(ValueError):
        frames.frame_mode(1, 1, "slow")
    monkeypatch.setattr(frames, "FEW_NODES", 5)
    own = graph(spark, 12, [(i, (i + 1) % 12, 1) for i in range(12)])
    sets = spark.createDataFrame([([0, 1],), ([2, 3],)], "members array<long>")
    step = algebra.assignment(sets, own.nodes)
    args = ([own, algebra.construct(own, step, {})], frames.scattered(own.nodes), [step], [step])
    nodes, edges = frames.frames(*args, "efficient")
    assert nodes.groupBy("level").count().orderBy("level").collect() == [(0, 5), (1, 5)] and edges.where("level = 0").count() < 12
    nodes, edges = frames.frames(*args, "fast")
    assert nodes.count() == 22 and edges.where("level = 0").count() == 12


def test_logs(tmp_path):
    for k in range(2):
        logs.logger("run", False, str(tmp_path)).info("line %d", k)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["run-1.log", "run.log"] and "line 1" in (tmp_path / "run-1.log").read_text()
    logs.logger("run", False, str(tmp_path), append=True).info("more")
    assert (tmp_path / "run.log").read_text().count("\n") == 2


def test_apply_coarsening_runs_all_levels(spark, monkeypatch):
    """The query leaves the ratio, the pairs and the levels as the operator has them."""
    asked = []
    monkeypatch.setattr(registry, "ge", lambda spark, d: None)
    monkeypatch.setattr(multilevel, "coarsen", lambda graph, k, r, max_levels, method, **o: asked.append((k, r, max_levels, method)) or SimpleNamespace(counts=lambda: None))
    registry.QUERIES["apply_coarsening"](spark, "")
    assert asked == [(10, 0.5, 10, "heavy_edge")]

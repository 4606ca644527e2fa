"""The Gauss-Seidel sweep in ranges of ids, and how many rounds it takes."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.graph import Graph
from grainmill.operators import candidates, proximity
from grainmill.plans import stored as stored_module
from grainmill.plans import training


@pytest.mark.parametrize("most", [30, 10**6])
def test_sweep_in_ranges(spark, monkeypatch, most):
    rng = np.random.default_rng(2)
    w = np.triu(rng.integers(1, 5, (50, 50)) * (rng.random((50, 50)) < 0.2), 1).astype(float)
    w[:, 7] = w[7] = w[:, 49] = 0.0  # two nodes without edges
    w += w.T
    ids = [int(3 * k - 20) for k in range(50)]
    start = rng.normal(size=(50, 2))
    g = Graph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame([(ids[a], ids[b], float(w[a, b])) for a, b in np.argwhere(w)], "src long, dst long, w double"))
    x = start.copy()
    for k in range(50):
        x[k] = w[k] @ x / w[k].sum() if w[k].any() else 0.0
    monkeypatch.setattr(proximity, "SWEEP", most)
    got = {r.id: r.x for r in proximity.gauss_seidel_vectors(g, 2, spark.createDataFrame(list(zip(ids, start.tolist())), "id long, x array<double>")).collect()}
    assert got.keys() == set(ids) and np.allclose([got[i] for i in ids], x)


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """A path of 300 nodes in order of ids: as many rounds of written tables as nodes, if each waits for the one before."""
    written = []
    monkeypatch.setattr(proximity, "stored", lambda df: written.append(1) or stored_module.stored(df))
    pairs = spark.range(299).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1.0).alias("w"))
    edges = pairs.toDF("src", "dst", "w").union(pairs.select("b", "a", "w"))
    proximity.gauss_seidel_vectors(Graph(spark.range(300), edges), 1).count()
    assert len(written) < 20


def test_training_sweep_works_out_the_basis_once(spark, monkeypatch):
    calls, owns = [], []
    nodes, edges = spark.range(4).select("id"), spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, w double")
    monkeypatch.setattr(training, "basis", lambda graph, k: calls.append(k) or graph.nodes)
    monkeypatch.setattr(training, "train", lambda graph, *a, own=None, **o: owns.append(own) or SimpleNamespace(runs=graph.nodes))
    assert training.sweep(Graph(nodes, edges), 2, 2, (1, 2), (0.5, 0.6), k=3).count() == 16
    assert calls == [3] and len(owns) == 4 and all(o is owns[0] and o is not None for o in owns)


def test_training_sweep_costs_the_first_level_once(spark, monkeypatch):
    """Sets, costs and similarities of the first level are the same for all settings; runs are as without sharing."""
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a in range(30) for b in range(a) if rng.random() < 0.2]
    nodes = spark.createDataFrame([(i, rng.normal(size=3).tolist(), i % 2) for i in range(30)], "id long, x array<double>, y int")
    g = Graph(nodes, spark.createDataFrame([(a, b, 1.0) for p in pairs for a, b in (p, p[::-1])], "src long, dst long, w double"))
    costs, calls = candidates.costs, []
    monkeypatch.setattr(candidates, "costs", lambda *a: calls.append(1) or costs(*a))
    monkeypatch.setattr(training, "level_ratio", lambda level: 0.4)
    options = {"levels": 1, "k": 4, "hidden": 4}
    got = training.sweep(g, 3, 2, (1,), (0.1, 0.9), **options).collect()
    assert len(calls) == 1
    alone = [training.train(g, 3, 2, epochs_per_level=1, threshold=t, **options).runs.first() for t in (0.1, 0.9)]
    assert len(calls) == 3
    for a, b in zip(got, alone):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:])

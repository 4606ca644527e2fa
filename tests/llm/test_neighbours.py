import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import neighbours


def brute(rows, k):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            own.setdefault(i, []).append(np.array(v))
    out = {}
    for q in own:
        if q % 10 == 0:
            d = sorted((min(float(np.sqrt(((a - b) ** 2).sum())) for a in own[q] for b in own[i]), i) for i in own if i != q)
            out[q] = d[:k]
    return out


@pytest.mark.parametrize("portion,lists", [(4096, 1), (50, 12)])
def test_neighbours(spark, monkeypatch, portion, lists):
    monkeypatch.setattr(neighbours, "PORTION", portion)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(64 * lists + 100)]
    same = [1.0] * 16
    rows += [(10_000 + i, same) for i in range(40)]  # one very common vector: ties to smaller ids
    rows += [(20_000, None), (20_010, [0.0] * 16), (20_020, [None] + [1.0] * 15), (20_030, [float("nan")] * 16), (20_040, [float("inf")] + [0.0] * 15), (20_050, [1.0]), (None, same), (1, rows[1][1])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, rank int")
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = brute(rows, 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11)) and [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)
        hits += len({i for _, _, i in own} & {i for _, i in want[q]})
        truth = dict((i, s) for s, i in want[q])
        assert all(abs(s - truth[i]) < 1e-12 for _, s, i in own if i in truth)
    assert hits / (10 * len(want)) >= (0.9 if lists > 1 else 0.97)
    assert [i for _, _, i in got[10_000]] == list(range(10_001, 10_011)) and [i for _, _, i in got[10_030]] == list(range(10_000, 10_010))


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(df, F.col("id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 0.0), (0, 2, 1, math.sqrt(2))]
    assert neighbours.nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_candidates_are_given_up_early():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(5, 64))
    at, c, d = neighbours.scan(q, q, x, x, np.full(5, np.inf), 10)
    hits = 0
    for i in range(5):
        true = np.sort(((x - q[i]) ** 2).sum(axis=1))[:10]
        hits += np.isin(np.round(true, 9), np.round(d[at == i], 9)).sum()
        assert (at == i).sum() < 40 and np.allclose(d[at == i], ((x[c[at == i]] - q[i]) ** 2).sum(axis=1))
    assert hits >= 45


@pytest.fixture(scope="module")
def many(spark):
    """20,000 vectors around 300 centres, and the true neighbours of each hundredth."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 32))[rng.integers(0, 300, 20_000)] + 0.6 * rng.normal(size=(20_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    true = {}
    for q in range(0, 20_000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        true[q] = set(np.argsort(d, kind="stable")[:10].tolist())
    return df, true


def recall(df, true):
    got = {}
    for r in neighbours.nearest(df, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(v) == 10 for v in got.values())
    return sum(len(got.get(q, set()) & own) for q, own in true.items()) / (10 * len(true))


def test_recall_over_many_lists(many):
    assert recall(*many) >= 0.9


def test_portions_and_askers_split_the_work(many, monkeypatch):
    monkeypatch.setattr(neighbours, "PORTION", 64)
    monkeypatch.setattr(neighbours, "ASKERS", 16)
    monkeypatch.setattr(neighbours, "TILE", 20)
    assert recall(*many) >= 0.9


def test_answers_come_from_the_scan_alone(many, monkeypatch):
    none = np.zeros(0, dtype=np.int64)
    monkeypatch.setattr(neighbours, "scan", lambda *a: (none, none, np.zeros(0)))
    assert neighbours.nearest(many[0], F.col("id") % 100 == 0).count() == 0


def test_lists_grow_with_the_square_root(many):
    df, _ = many
    index = neighbours.fit(*neighbours.usable(df, "vec_id", "embedding"), 10)
    assert [len(b) for b in index.books] == [round(20_000**0.25)] * 2
    assert index.probes < 0.6 * len(index.books[0]) * len(index.books[1])

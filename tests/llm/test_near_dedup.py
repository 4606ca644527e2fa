import random
import re

import numpy as np
import pytest

import corpus_pipeline
from grainmill.llm import minmax_dedup
from grainmill.plans.connected import components
from grainmill.llm.shingles import shingle_set, word_hashes


def plain_set(text, words=5):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def brute(rows, percent=85):
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, plain_set(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(a), root(i), root(i) == i) for i, a in sets)


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 4)))
    out = ["", "  \n", "one two", "ONE  two", "one two three", "É x", "é x"]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(30, 250))]
        for _ in range(n // 6):
            own = list(base)
            for _ in range(rng.randint(0, 8)):
                own[rng.randrange(len(own))] = word()
            base = own if rng.random() < 0.3 else base
            out.append(" ".join(own) + " " * rng.randint(0, 1))
    return out + [" ".join(word() for _ in range(40)) for _ in range(5)] + ["lorem " * 20_000]


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, id string, n_shingles int")
    return sorted(tuple(r) for r in minmax_dedup.near_duplicates(df).collect())


@pytest.mark.parametrize("block", [512, 3])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minmax_dedup, "BLOCK", block)
    rows = list(enumerate(texts(block, 90)))
    random.Random(5).shuffle(rows)
    rows = [(i * 7 + 3, t) for i, t in rows] + [(1, None)]
    assert run(spark, rows) == brute(rows)


def test_without_a_lucky_star(spark, monkeypatch):
    # the stars find nothing: the blocks alone must connect what belongs together
    monkeypatch.setattr(minmax_dedup, "_alike", lambda pairs: pairs.select("a", "b").where("false"))
    rows = list(enumerate(texts(9)))
    assert run(spark, rows) == brute(rows)


def test_crowded_buckets_are_divided(spark, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "CROWD", 4)
    monkeypatch.setattr(minmax_dedup, "PORTION", 2)
    rows = list(enumerate(texts(17, 90)))
    assert run(spark, rows) == brute(rows)


def test_crowds_keep_pairs_that_share_one_band(spark, monkeypatch):
    # one band in common, all others a text's own: no second band can bring two members together
    monkeypatch.setattr(minmax_dedup, "CROWD", 4)
    monkeypatch.setattr(minmax_dedup, "band_keys", lambda values, band: np.append(7, np.random.default_rng(values).integers(100, 2**62, 23)))
    monkeypatch.setattr(minmax_dedup, "_alike", lambda pairs: pairs.select("a", "b").where("false"))
    rows = list(enumerate(texts(21, 60)))
    assert run(spark, rows) == brute(rows)


def test_shared_ids_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (4, b), (9, c), (9, ""), (9, None), (5, c + " more")]
    got = sorted(set(run(spark, rows)))
    assert {(i, comp) for i, _, comp, _ in got} == {(3, 3), (4, 3), (5, 3), (9, 3)} and {i for i, _, _, kept in got if kept} == {3}


def test_null_ids_repeated_rows_and_nothing(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None)]
    assert run(spark, rows) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, minmax_dedup.near_duplicates(df).collect()), key=str) == [(4, 2, 4, True), (None, 2, None, True)]
    assert minmax_dedup.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = random.Random(3)
    a = [str(rng.random()) for _ in range(900)]
    b = a[:700] + [str(rng.random()) for _ in range(200)]
    x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((minmax_dedup.signature(x) == minmax_dedup.signature(y)).mean() - true) < 0.15
    assert len(set(word_hashes("a b a c").tolist())) == 3


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_and_agreement_follow_the_similarity(spark):
    assert [(minmax_dedup.band_size(p), minmax_dedup.least_equal(p)) for p in (85, 80)] == [(5, 75), (4, 67)]
    rows = list(enumerate(texts(21)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minmax_dedup.near_duplicates(df, percent=80).collect())) == brute(rows, 80)


def test_pipeline_drops_near_copies_from_080_on(spark):
    own = [f"w{k}" for k in range(204)]
    near = own[:100] + ["other"] * 1 + own[101:150] + ["more"] + own[151:180] + ["most"] + own[181:195] + ["last"] + own[196:]
    sets = [plain_set(" ".join(x)) for x in (own, near)]
    assert 0.80 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
    docs = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(near)), (None, " ".join(near))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, None}

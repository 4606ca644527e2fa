import hashlib
import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from grainmill.llm import weighted_sampling as ws


def weights(text):
    own = Counter(text.replace("\n", " ").replace("\t", " ").split(" "))
    return {w: n * max(len(w), 0.01) for w, n in own.items()}


def jaccard(a, b):
    a, b = weights(a), weights(b)
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def plain(rows):
    """Rows by (id, hash of the text), null ids last, each with its edited text and its successor."""
    place = {t: xxhash.xxh64_intdigest(t.encode(), seed=42) >> 1 for t in {t or "" for _, t in rows}}
    own = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, place[r[1]]))
    out = []
    for (i, t), (_, nxt) in zip(own, own[1:] + own[:1]):
        h = len(t) // 2
        out.append((i, t, t[: len(t) - h] + nxt[:h], nxt))
    return out


@pytest.mark.parametrize("rows_a_range", [1000, 7, 1])
def test_rows_and_edited_texts(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(ws, "ROWS_A_RANGE", rows_a_range)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(("ab", "cd é", "😀x", "longer-word", "q")) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    rows = [(i * i * 3 - 50, t) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (5002, "  \n "), (5003, "word " * 20_000), (5004, "x"), (5004, "x"), (5004, "y"), (None, "null id")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, next string, b int, seq int")
    got = ws.edited_fingerprints(df).collect()
    want = plain(rows)
    key = lambda x: (str(x[0]), x[1], x[2])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=key) == sorted([(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want], key=key)
    of_text = {}
    prints = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in got}
    for i, t, e, nxt in want:
        r = prints[i, len(t), hashlib.sha256(e.encode()).hexdigest()]
        for text, p in ((t, r.fingerprint), (e, r.edited_fingerprint)):
            assert of_text.setdefault(text, p) == p
    for i, t, e, nxt in want:
        if (i, t) == (5004, "x"):  # two rows that differ in their successor only
            continue
        r = prints[i, len(t), hashlib.sha256(e.encode()).hexdigest()]
        split = lambda p: [p[k : k + 8] for k in range(0, len(p), 8)]
        assert r.near_next == sum(x == y for x, y in zip(split(r.fingerprint), split(of_text[nxt]))) / ws.SAMPLES
        assert r.near_edited == sum(x == y for x, y in zip(split(r.fingerprint), split(r.edited_fingerprint))) / ws.SAMPLES


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(3, "abcd efgh")], "doc_id long, text string")
    r = ws.edited_fingerprints(df).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest()
    assert ws.edited_fingerprints(df.limit(0)).count() == 0 == ws.fingerprints(df.limit(0)).count()
    assert ws.fingerprints(df).first().fingerprint == r.fingerprint


def test_agreement_is_the_generalised_jaccard_similarity(spark):
    rng = random.Random(2)
    texts = []
    for pair in range(120):  # each pair has words of its own, so that errors are independent
        own = [("w" * rng.randint(1, 9)) + f"{pair}x{k}" for k in range(rng.choice((5, 20, 60)))]
        texts += [" ".join(rng.choice(own) for _ in range(60)) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in ws.edited_fingerprints(df).select("doc_id", "near_next").collect()}
    errors = [got[i] - jaccard(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)]
    assert abs(sum(errors) / len(errors)) < 0.025 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.1


def test_samples_equal_a_plain_sampler(spark):
    text = "one two two three-and-a-bit four four four four"
    own = weights(text)
    hashes = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in own}
    seeds = spark.createDataFrame([(w, h) for w, h in hashes.items()], "w string, term long")
    drawn = {r.w: r for r in seeds.select("w", *[F.xxhash64("term", F.lit(k)).alias(f"h{k}") for k in range(2 * ws.SAMPLES)]).collect()}
    got = ws.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().fingerprint
    for j in range(ws.SAMPLES):
        best = None
        for w, weight in own.items():
            x, y = (drawn[w][f"h{2 * j + k}"] % 2**64 for k in range(2))
            u = lambda v, at, size: ((v >> at & 2**size - 1) + 0.5) * 2.0**-size
            r, c, b = -math.log(u(x, 0, 32) * u(x, 32, 32)), -math.log(u(y, 0, 24) * u(y, 24, 24)), u(y, 48, 16)
            t = math.floor(math.log(weight) / r + b)
            a = math.log(c) - r * (t - b + 1)
            if best is None or a < best[0]:
                best = (a, (hashes[w] ^ t) % 2**32)
        assert got[8 * j : 8 * j + 8] == f"{best[1]:08x}"


def test_ranges_are_even_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(ws, "ROWS_A_RANGE", 50)
    rng = random.Random(4)
    for ids in ([*range(2000), 10**17], [7] * 1000 + [*range(1000)], [None] * 1000 + [*range(1000)], [rng.randrange(10) ** 9 for _ in range(2000)]):
        df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string")
        rows = ws.with_successors(df, "doc_id", "text").where("guest = 0")
        sizes = [r["count"] for r in rows.groupBy("b").count().collect()]
        assert sum(sizes) == len(ids) and max(sizes) <= 200
    texts = [f"t{k}" for k in range(300)]
    df = spark.createDataFrame([(f"key-{k:04d}", t) for k, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: r.edited_sha256 for r in ws.edited_fingerprints(df).collect()}
    assert got == {f"key-{i:04d}": hashlib.sha256(e.encode()).hexdigest() for i, (_, _, e, _) in enumerate(plain(list(enumerate(texts))))}


def test_no_python_on_the_way(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string").withColumn("x", F.lit(1))
    plan = ws.edited_fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

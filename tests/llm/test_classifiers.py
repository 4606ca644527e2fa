import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import language, quality, toxicity

LANGS = {"xx": "ka ro mi ta lu pe".split(), "yy": "sch der ung keit zu".split(), "zz": "oux ette ain que".split()}


def word(rng, lang):
    return "".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 3)))


def corpus(spark, n=240):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(sorted(LANGS))
        own = [word(rng, lang) for _ in range(rng.randint(8, 200))]
        toxic, bad = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(("blargh", "snurfle")))
        if bad:
            own = [w + rng.choice(("###", "%%%")) for w in own]
        rows.append((i, " ".join(own), lang, None, "clash"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None, "xx", None, "c"), (n + 1, "", None, None, "c"), (n + 2, "12 %%", "xx", None, None), (None, "karo mita", "xx", None, None), (n + 3, "karo " * 30_000, None, None, None), (0, rows[0][1], rows[0][2], None, None)]
    labels += [(n, 1, 0), (n + 1, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), n


def test_segments_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice((-3.0, -1.0, -0.5, 1.0, 2.0, 2.5)) for _ in range(rng.randint(0, 9))]
        got = [(a, b) for a, b, _ in toxicity.maximal_segments([(i, i, x) for i, x in enumerate(s)])]

        def split(lo, hi):  # the definition: the best segment, then the same on either side
            best = max(((sum(s[a : b + 1]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a, hi)), default=(0,))
            if best[0] <= 0:
                return []
            return split(lo, best[3]) + [(best[3], best[4])] + split(best[4] + 1, hi)

        total = lambda segments: sorted(sum(s[a : b + 1]) for a, b in segments)
        assert total(got) == total(split(0, len(s))), s
        assert all(b < c for (_, b), (c, _) in itertools.pairwise(got))


def test_toxicity_learns_and_scores_every_row(spark):
    docs, labels, n = corpus(spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 1)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == n + 6
    by_id = {r.doc_id: r for r in rows}
    assert all((by_id[i].score >= 0.7) == (i % 6 == 0) for i in range(n))
    assert by_id[n].score == by_id[n + 1].score < 0.5 and 0 <= by_id[None].score <= 1 and by_id[n + 3].score < 0.5
    found = {r.doc_id for r in toxicity.passages(docs, model).collect()}
    assert {i for i in range(n) if i % 6 == 0} <= found and len(found - {i for i in range(n) if i % 6 == 0}) < 10
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_word_scores_equal_a_plain_version(spark):
    docs, labels, n = corpus(spark)
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 != 1, settings=((1.5, 0.5),))
    text, label = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()}
    repeated = [0]  # this row is there twice
    rows = [(text[i], label[i]) for i in [*text, *repeated] if i is not None and i % 4 != 1 and text[i] is not None and label.get(i) is not None]
    t, c = {}, {}
    for own, y in rows:
        for w in {x for w in toxicity.WORDS.findall(own.lower()) for x in [w, *(w[:k] + "*" for k in range(4, 8) if k < len(w))]}:
            for to, there in ((t, y), (c, 1 - y)):
                to[w] = to.get(w, 0) + there
    known = [w for w in t if t[w] + c[w] > 1]
    all_t, all_c = sum(t[w] for w in known), sum(c[w] for w in known)

    def odds(w):
        if w is None or w not in known:
            return 0.0 if w is None else odds(above(w))
        base, own = odds(above(w)), 0.1 * (t[w] + c[w])
        away = math.log((t[w] + own) / (1.1 * all_t + 0.1 * all_c - t[w] - own)) - math.log((c[w] + own) / (0.1 * all_t + 1.1 * all_c - c[w] - own)) - base
        return base + math.copysign(max(0.0, abs(away) - 1.5 * math.sqrt(1 / (t[w] + own) + 1 / (c[w] + own))), away)

    def above(w):
        own = w.rstrip("*")
        k = min(7, len(own) - 1)
        return own[:k] + "*" if k >= 4 else None

    for w in [*known, "snurfle", "blarghish", "unseen"]:
        assert abs(model._word(w) + 0.5 - odds(w)) < 1e-9 or w.endswith("*")
        if w.endswith("*") and w in model.words:
            assert abs(model.words[w] - odds(w)) < 1e-9
    assert model._word("blargh") > 0.5 and model._word("snurfle") > 0.5 > model._word("unseen")


def test_chance_statistics():
    scores, share = np.array([2.0, -1.0, -0.5]), np.array([0.1, 0.5, 0.4])
    rate = toxicity.decay_rate(scores, share)
    assert abs(share @ np.exp(rate * scores) - 1) < 1e-6
    model = toxicity.Model({}, 0.5, 1.0, 1.0, (0.0, 0.0))
    held = [(100, [float(k)]) for k in range(1, 9)] + [(100, [20.0])]
    model.calibrate(held, np.array([0.0] * 8 + [1.0]), scores, share)
    # nine of 801 words: K = (8 + 1) / 801 exp(lambda * least of the clean segments)
    assert abs(model.scale - 9 / 801 * math.exp(rate * 1.0)) < 1e-9
    # one segment: -log(K m exp(-lambda S)); two: their sum less log(x), and log 2
    km = model.scale * 50
    one = rate * 9 - math.log(km)
    assert abs(model.evidence(50, [(0, 0, 9.0)]) - one) < 1e-9
    two = 2 * one - math.log(2 * one) + math.log(2)
    assert abs(model.evidence(50, [(0, 0, 9.0), (5, 5, 9.0)]) - max(one, two)) < 1e-9


def test_more_segments_more_evidence():
    model = toxicity.Model({"bad": 3.0}, 0.5, 1.0, 0.01, (0.0, 1.0))
    e = [model.evidence(*model.hits("ok " * 50 + "bad " * k)) for k in range(5)]
    apart = [model.evidence(*model.hits("ok " * 50 + ("bad " + "ok " * 20) * k)) for k in range(1, 5)]
    assert e == sorted(e) and apart == sorted(apart) and e[0] == 0 and math.isfinite(e[-1])


def test_quality_learns_and_scores_every_row(spark):
    docs, labels, n = corpus(spark)
    model = quality.fit(docs, labels, F.col("doc_id") % 4 != 1)
    by_id = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(by_id) == n + 5 and all((by_id[i] >= 0.7) == (i % 5 != 0) for i in range(n))
    assert by_id[n] == by_id[n + 1] and all(0 <= s <= 1 for s in by_id.values())
    assert quality.score(docs.limit(0), model).count() == 0
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.0}


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, sizes, y = rng.normal(size=(9, 6)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    model = quality.train(x, sizes, y, hidden=3, gate=2, epochs=1)
    starts = np.cumsum(sizes) - sizes
    loss = lambda: -np.mean(y * np.log(model.forward(x, starts)["p"]) + (1 - y) * np.log(1 - model.forward(x, starts)["p"]))
    for k, g in model.gradients(x, starts, y).items():
        w = model.weights[k]
        for at in np.ndindex(w.shape):
            kept = float(w[at])
            w[at] = kept + 1e-6
            up = loss()
            w[at] = kept - 1e-6
            down = loss()
            w[at] = kept
            assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_bags_do_not_depend_on_portions():
    rng = np.random.default_rng(1)
    model = quality.train(rng.normal(size=(6, quality.DIM)), np.array([3, 3]), np.array([1.0, 0.0]), epochs=1)
    texts = ["a b " * k for k in (1, 400, 3, 2000, 0)] + [None]
    assert np.allclose(model.scores(texts, passages=1), model.scores(texts, passages=10**6))


def test_languages(spark):
    docs, _, n = corpus(spark)
    profiles = language.fit(docs, F.col("doc_id") % 4 != 2)
    rows = {r.doc_id: r for r in language.identify(docs, profiles).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(rows[i].lang_pred == truth[i] for i in range(n)) >= n - 2
    assert rows[n].lang_pred == rows[n + 1].lang_pred == rows[n + 2].lang_pred == "und" and rows[None].lang_pred == rows[n + 3].lang_pred == "xx"
    nothing = language.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), profiles).count() == 0


def test_profiles_and_predictions_equal_a_plain_version(spark):
    docs, _, n = corpus(spark)
    profiles = language.fit(docs, F.lit(True), profile_size=50, longest=3)
    counts = {}
    rows = [r for r in docs.collect() if r.lang is not None and r.text is not None and r.doc_id is not None]
    for r in rows:
        own = counts.setdefault(r.lang, {})
        for w in "".join(c if c.isalpha() else " " for c in r.text.lower()).split():
            w = f" {w} "
            for g in [w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1)]:
                if g != " ":
                    own[g] = own.get(g, 0) + 1
    ranked = {lang: sorted(own, key=lambda g: (-own[g], g))[:50] for lang, own in counts.items()}
    assert profiles.ranked == ranked
    known = {g for v in ranked.values() for g in v}
    for text in [r.text for r in rows[:60]]:
        own = {}
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            w = f" {w} "
            for g in [w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1)]:
                if g in known:
                    own[g] = own.get(g, 0) + 1
        top = sorted(own, key=lambda g: (-own[g], g))[:50]
        away = {lang: sum(abs(v.index(g) - i) if g in v else 50 for i, g in enumerate(top)) for lang, v in ranked.items()}
        best = min(sorted(away), key=away.get)
        assert profiles.predict(text) == (best, 1 - away[best] / (50 * len(top)))
    with pytest.raises(ValueError):
        language.fit(docs, F.lit(True), most_languages=2)


def test_passages_and_attention_equal_a_plain_version():
    text = "Ab, cd cd!\n" * 120 + "é 12"
    raw = text.encode()
    got = quality.encode(text)
    assert got.shape == (-(-len(raw) // quality.PASSAGE), quality.DIM)
    kind = quality._classes()
    for p in range(len(got)):
        pairs = np.zeros((quality.CLASSES, quality.CLASSES))
        for i in range(p * quality.PASSAGE, min((p + 1) * quality.PASSAGE, len(raw) - 1)):
            pairs[kind[raw[i]], kind[raw[i + 1]]] += 1
        assert np.allclose(got[p, : quality.CLASSES**2], np.sqrt(pairs / pairs.sum()).ravel(), atol=1e-6)
    model = quality.train(np.vstack([got, got]), np.array([len(got)] * 2), np.array([1.0, 0.0]), epochs=2)
    w, f = model.weights, model.forward(got, np.array([0]))
    h = [np.tanh(x @ w["E"] + w["e"]) for x in got]
    e = np.array([math.exp(((np.tanh(x @ w["V"])) / (1 + np.exp(-(x @ w["U"])))) @ w["w"]) for x in h])
    z = sum(a * x for a, x in zip(e / e.sum(), h))
    assert np.allclose(f["p"], 1 / (1 + np.exp(-(z @ w["c"] + w["b"]))))


def test_sample_is_bounded_by_whole_documents(spark):
    docs, labels, _ = corpus(spark)
    few, none = (quality.fit(docs, labels, F.lit(True), sample_passages=k) for k in (30, 0))
    assert few.share is None and none.share == 0.0


def test_out_of_place_distance():
    profiles = language.Profiles({"a": ["x", "y", "z"], "b": ["z", "q"]}, 3, 1)
    # the text's own ranks: z 0, x 1; from a: |2-0| + |0-1| = 3, from b: |0-0| + 3 = 3; a tie goes to a
    assert profiles.predict("zz zz x") == ("a", 1 - 3 / 6)

import random

import numpy as np
from pyspark.sql import functions as F

from grainmill.llm import chunk_dedup


def plain_gear(data):
    h, out = 0, []
    for b in data:
        h = (2 * h + int(chunk_dedup._GEAR[b])) % 2**32
        out.append(h)
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_gear_and_cuts_equal_the_plain_rule():
    rng = random.Random(1)
    for text in ("", "a", "abc def", prose(rng, 300), "x" * 2000, "aé" * 900, "ha " * 500):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        h = plain_gear(data.tolist())
        assert chunk_dedup.gear(data).tolist() == h
        h = [x if bytes([b]).isspace() else 0 for x, b in zip(h, data.tolist())]
        n, r = len(h), chunk_dedup.REACH
        want = {i + 1 for i in range(n) if h[i] > max(h[max(0, i - r) : i], default=0) and h[i] >= max(h[i + 1 : i + 1 + r], default=0)}
        got = chunk_dedup.cuts(data).tolist()
        assert want <= set(got) and (not n or got[-1] == n) and got == sorted(set(got))
        assert all(b - a <= chunk_dedup.LONGEST + 3 for a, b in zip([0, *got], got))
        for a, b in zip([0, *got], got):
            bytes(data[a:b]).decode()


def test_cuts_resist_insertions():
    rng = random.Random(2)
    tail = prose(rng, 400)
    a, b = prose(rng, 37) + " " + tail, prose(rng, 90) + " " + tail
    ends = [{len(x.encode()) - e for e in chunk_dedup.cuts(np.frombuffer(x.encode(), dtype=np.uint8)).tolist()} for x in (a, b)]
    inner = {e for e in ends[0] if e < len(tail.encode()) - 60}
    assert len(inner) > 20 and inner == {e for e in ends[1] if e < len(tail.encode()) - 60}


def test_spans_and_removal(spark):
    rng = random.Random(3)
    missed = 0
    shared = [prose(rng, 55) for _ in range(40)]
    rows = [(i, prose(rng, 80)) for i in range(20)]
    for k, p in enumerate(shared):
        for j in range(2 + k % 3):
            rows.append((100 + 10 * k + j, prose(rng, rng.randint(20, 200)) + " " + p + " " + prose(rng, 30)))
    rows += [(900, None), (901, ""), (None, shared[0]), (902, rows[0][1]), (903, "dup " * 3000)]
    docs = spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id long, text string, start string, rev long").withColumns({c: F.lit(c) for c in ("_id", "_rev", "_spans", "id", "spans", "row")})
    spans = chunk_dedup.repeated_spans(docs)
    got = spans.collect()
    flagged = {r.doc_id for r in got} | {r.first_doc_id for r in got}
    for k in range(40):
        missed += any(100 + 10 * k + j not in flagged for j in range(2 + k % 3))
    assert missed <= 1
    assert not flagged & set(range(1, 20)) and {0, 902} <= flagged
    text = dict(rows)
    for r in got:
        n = r.end - r.start
        assert r.n_words >= 16 and text[r.doc_id].encode()[r.start : r.start + 20] == text[r.first_doc_id].encode()[r.first_start : r.first_start + 20] and n > 0
    after = {r.doc_id: r for r in chunk_dedup.without_spans(docs, spans).collect()}
    assert len(after) == len(rows) and after[None].text == shared[0] and after[900].text is None and after[901].text == ""
    assert after[902].text == "" and after[0].text == rows[0][1] and after[0].start == "s"
    for r in got:
        own = sorted((x.start, x.end) for x in got if x.doc_id == r.doc_id)
        raw = text[r.doc_id].encode()
        want, last = b"", 0
        for a, b in own:
            want, last = want + raw[last:a], b
        assert after[r.doc_id].text == (want + raw[last:]).decode()
    assert chunk_dedup.repeated_spans(docs.limit(0)).count() == 0


def test_repeated_rows_count_as_one(spark):
    t = prose(random.Random(4), 60)
    docs = spark.createDataFrame([(1, t), (1, t), (1, "other text " * 3)], "doc_id long, text string")
    assert chunk_dedup.repeated_spans(docs).count() == 0
    more = docs.union(spark.createDataFrame([(2, t)], docs.schema))
    assert {r.doc_id for r in chunk_dedup.repeated_spans(more).collect()} == {2}


def test_spans_hold_the_whole_passage(spark):
    rng = random.Random(11)
    rows, where = [], {}
    for k in range(60):
        passage = prose(rng, 51)
        rows.append((10 * k, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30)))
        head = prose(rng, rng.randint(20, 60)) + "\n"
        rows.append((10 * k + 1, head + passage + "\n" + prose(rng, 30)))
        where[10 * k + 1] = (len(head.encode()), len((head + passage).encode()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in chunk_dedup.repeated_spans(docs).collect()}
    assert got.keys() == where.keys()
    text = dict(rows)
    for i, (a, b) in where.items():
        r = got[i]
        assert a - 1 <= r.start <= a and b <= r.end <= b + 1 and r.n_words == 51
        assert text[i].encode()[r.start : r.end] == text[r.first_doc_id].encode()[r.first_start :][: r.end - r.start]


def test_repeats_under_one_id_and_within_a_text(spark):
    rng = random.Random(12)
    a, b = prose(rng, 60), prose(rng, 60)
    texts = [prose(rng, 20) + "\n" + a + "\n" + prose(rng, 20) for _ in range(2)]
    twice = prose(rng, 30) + "\n" + b + "\n" + prose(rng, 30) + "\n" + b + "\n" + prose(rng, 10)
    docs = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (7, texts[1]), (8, twice), (8, twice)], "doc_id long, text string")
    spans = chunk_dedup.repeated_spans(docs)
    got = sorted((r.doc_id, r.n_words, r.first_doc_id, r.source_ids) for r in spans.collect())
    assert got == [(7, 60, 7, [7]), (8, 60, 8, [8])]
    after = [r.text for r in chunk_dedup.without_spans(docs, spans).collect()]
    assert len(after) == 5 and sum(a in t for t in set(after)) == 1 and all(t.count(b) == 1 for t in after if b in t) and sum(b in t for t in after) == 2


def test_spans_equal_a_search_of_all_texts(spark):
    rng = random.Random(21)
    pool = [prose(rng, rng.randint(51, 90)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randint(5, 60))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(pool), prose(rng, rng.randint(3, 50))]
        rows.append((i, " ".join(parts)))
    got = {}
    for r in chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    seen: set[tuple] = set()  # runs of eight words of earlier texts
    for i, t in rows:
        words = t.split(" ")
        at = np.cumsum([0] + [len(w.encode()) + 1 for w in words])
        runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        repeated = np.zeros(len(words), dtype=bool)
        for k, run in enumerate(runs):
            if run in seen:
                repeated[k : k + 8] = True
        found = np.array([any(a <= at[k] and at[k + 1] - 1 <= b for a, b in got.get(i, [])) for k in range(len(words))])
        own, flags = set(), repeated.tolist() + [False]
        start = None
        for k, flag in enumerate(flags):  # repeated stretches within this text count too, from their second place on
            if flag and start is None:
                start = k
            if not flag and start is not None:
                if k - start >= 51:
                    assert found[start + 1 : k - 1].all(), (i, start, k)  # another earlier text may share one word more
                start = None
        for k, run in enumerate(runs):
            if run in own:
                repeated[k : k + 8] = True
            own.add(run)
        near = repeated | np.append(repeated[1:], False) | np.append(False, repeated[:-1])  # a word may be the beginning of the origin's next
        assert not (found & ~near).any(), i
        seen |= own


def test_text_without_white_space(spark):
    rng = random.Random(13)
    signs = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    coded = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    joined = lambda n: "\u00a0".join(coded(6) for _ in range(n))
    rows, shared = [], {}
    for k, make in enumerate((signs, coded, joined)):
        p, whole = make(150), make(400)
        rows += [(10 * k, make(90) + p + make(80)), (10 * k + 1, make(131) + p + make(77)), (10 * k + 2, whole), (10 * k + 3, whole), (10 * k + 4, make(500))]
        shared[10 * k + 1] = p
        shared[10 * k + 3] = whole
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = chunk_dedup.repeated_spans(docs)
    got = {r.doc_id: r for r in spans.collect()}
    text = dict(rows)
    assert got.keys() == shared.keys()
    for i, p in shared.items():
        assert p in text[i].encode()[got[i].start : got[i].end].decode() and got[i].end - got[i].start <= len(p.encode()) + 12
    after = {r.doc_id: r.text for r in chunk_dedup.without_spans(docs, spans).collect()}
    assert all(after[10 * k + 3] == "" for k in range(3))

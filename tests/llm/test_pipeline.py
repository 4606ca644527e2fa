import random
from collections import defaultdict

import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_dedup import brute


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def make(spark, folder):
    rng = random.Random(8)
    rows, labels, toxic, poor = [], [], set(), set()
    for i in range(400):
        own = prose(rng, rng.randint(20, 120)).split(" ")
        if i % 7 == 0:
            toxic.add(i)
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(("blargh", "snurfle")))
        if i % 9 == 0:
            poor.add(i)
            own = [w + "###" for w in own]
        rows.append([i, " ".join(own), "xx", "s", 0])
        labels.append((i, int(i not in poor), int(i in toxic)))
    passage = prose(rng, 60)
    for i in (401, 403):
        rows.append([i, prose(rng, 40) + " " + passage + " " + prose(rng, 20), "xx", "s", 0])
    rows += [[405, rows[1][1], "xx", "s", 0], [406, rows[2][1] + " tail", None, None, None], [407, None, None, "s", None], [None, prose(rng, 50), "xx", "s", 0]]
    for r in rows:
        r[4] = len(r[1]) if r[1] is not None and r[4] is not None else None
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs = docs.withColumns({c: F.lit(c) for c in ("_id", "_rev", "_spans", "_gone", "id", "key", "row", "spans")})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, rows, toxic, poor, passage


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs, rows, toxic, poor, passage = make(spark, folder)
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, folder)
        assert after.columns == docs.columns
        after.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r.doc_id: r for r in now.collect()}
    ids = {r[0] for r in rows}
    assert kept["toxicity"].keys() == ids - toxic
    assert kept["quality"].keys() - {407} == ids - toxic - poor - {407}
    left = [(i, r.text) for i, r in kept["quality"].items() if i is not None]
    assert kept["near_dedup"].keys() - {None} == {i for i, _, _, keep in brute(left) if keep} and None in kept["near_dedup"]
    assert 405 not in kept["near_dedup"]
    assert kept["substring_dedup"].keys() == kept["near_dedup"].keys()
    for i, r in kept["substring_dedup"].items():
        assert i == 403 or r.text == kept["near_dedup"][i].text
        assert r.n_chars is None or r.n_chars == len(r.text)
    assert len(kept["substring_dedup"][403].text) < len(kept["near_dedup"][403].text) - len(passage) / 2

    packed = corpus_pipeline.run(spark, folder).collect()
    hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    length, sequences = defaultdict(int), defaultdict(int)
    for r in packed:
        length[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert length == {i: len(hf.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in kept["substring_dedup"].items()}
    assert max(sequences.values()) <= 1024


def test_shared_ids_lose_no_text(spark):
    rng = random.Random(9)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    long = "word " * 60_000 + d
    rows = [(5, a), (5, b), (5, b), (3, a), (-7, b), (8, c), (8, c), (8, long), (9, long), (None, a), (11, None), (11, None)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(3, a), (-7, b), (8, c), (8, long), (None, a), (11, None)], key=str)


def test_nothing_at_all(spark, tmp_path):
    docs, *_ = make(spark, str(tmp_path / "a"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

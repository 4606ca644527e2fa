import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from grainmill.llm import bpe, bpe_codec, packing, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
HF = Tokenizer.from_file(JSON)
TK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n x", "don't we're I'LL 'r 're", "x y  z", "\x1c\x1d a\x1f b\x85c", "日本語 テキスト 123４５", "😀 x  😀", "a" * 3000, "é́ ñ", " lead", "trail ", "tab\t\tx \t y", "½ ² x²  ½", "ab" * 700, "a\n b", "a\n  b", "\nb", "x \nb"]
random.seed(0)
ODD += ["".join(random.choice("ab c\n\t'rse é1٣ 😀.,!<|") for _ in range(random.randint(0, 60))) for _ in range(400)]
SPECIAL = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext", "x<|endoftext|><|endoftext|>"]


def hf(text):
    return HF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("make,want", [(lambda: bpe.from_ranks(RANKS), TK.encode_ordinary), (lambda: bpe.from_json(JSON), hf)])
def test_encoder_equals_library(make, want):
    encoder = bpe.TextEncoder(P.PATTERN, make().merge_pieces, b"".join, cache=300)
    for _ in range(2):
        for text, values in zip(ODD, encoder.encode_all(ODD)):
            assert np.frombuffer(b"".join(values), dtype="<u4").tolist() == want(text), text


def test_counts_at_every_prefix():
    counter = token_counts.PrefixCounter(bpe.from_json(JSON), P.PATTERN)
    assert list(counter.count(ODD + SPECIAL)) == [len(hf(x)) for x in ODD + SPECIAL]
    for text in [x for x in ODD if len(x) < 80][:150] + SPECIAL:
        assert counter.at_prefixes(text) == [len(hf(text[: i + 1])) for i in range(len(text))], text
        for budget in (0, 1, 3, 100):
            assert len(hf(text[: counter.longest_within(text, budget)])) <= budget


def rows(spark, texts):
    return spark.createDataFrame([(i if i != 3 else None, x, "clash", 1) for i, x in enumerate([None, *texts])], "doc_id long, text string, n_tokens string, piece int")


def test_token_count_rows(spark):
    texts = ["", "a b c", "a b c", "word " * 2000, "é" * 10]
    got = [tuple(r) for r in token_counts.token_counts(rows(spark, texts), JSON, P.PATTERN).collect()]
    want = [(i if i != 3 else None, len((x or "").encode()), len(hf(x or "")), len(hf(x or "")) > 1024) for i, x in enumerate([None, *texts])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.token_counts(rows(spark, texts).limit(0), JSON, P.PATTERN).count() == 0
    cut = {r.doc_id: r.text for r in token_counts.within_budget(rows(spark, texts), JSON, P.PATTERN, 5).collect()}
    assert cut[0] == "" and len(hf(cut[4])) == 5


def test_codec_rows(spark):
    texts = ["", "a b c", "a b c", "word " * 2000, "é日本 x"]
    for r, text in zip(sorted(bpe_codec.digests(rows(spark, texts), RANKS, P.PATTERN).collect(), key=lambda r: (r.doc_id is None, r.doc_id)), [None, "", "a b c", "word " * 2000, "é日本 x", "a b c"]):
        ids = TK.encode_ordinary(text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    back = bpe_codec.decode(bpe_codec.encode(rows(spark, texts), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(bytes(r.data).decode() for r in back.collect()) == sorted(["", *texts])
    assert bpe_codec.digests(rows(spark, texts).limit(0), RANKS, P.PATTERN).count() == 0


def test_best_fit_is_best_and_bounded():
    random.seed(1)
    fit, bins = packing.BestFit(100, 8), defaultdict(int)
    for _ in range(3000):
        n = random.randint(1, 100)
        number, offset = fit.place(n)
        assert bins[number] == offset and offset + n <= 100
        bins[number] += n
        assert fit.n_open <= 8 and sum(map(len, fit.by_space)) == fit.n_open
    assert sum(bins.values()) / (100 * len(bins)) > 0.9


def test_packing_equals_a_plain_best_fit():
    random.seed(5)
    for size, most in ((100, 8), (1024, 64)):
        fit, free, bins = packing.BestFit(size, most), [], 0
        for _ in range(4000):
            n = random.randint(1, size) if random.random() < 0.7 else random.randint(1, 9)
            fit.place(n)
            fitting = [f for f in free if f >= n]
            if fitting:
                free.remove(min(fitting))
                left = min(fitting) - n
            else:
                bins, left = bins + 1, size - n
            if left:
                free.append(left)
                if len(free) > most:
                    free.remove(min(free))
            assert sorted(free) == sorted(space for space, own in enumerate(fit.by_space) for _ in own) and fit.next_bin == bins


def test_packing_rows(spark):
    random.seed(2)
    texts = ["", "a b c", "a b c", "word " * 3000, "<|endoftext|> x", *("w" * random.randint(1, 9) + " tok" * random.randint(0, 900) for _ in range(60))]
    docs = rows(spark, texts)
    got = packing.pack(packing.cut_documents(docs, JSON, P.PATTERN)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate([None, *texts]):
        ids = hf(text or "") + [2]
        own = sorted(by_doc[i if i != 3 else None], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 1024) and all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.cut_documents(docs.limit(0), JSON, P.PATTERN)).count() == 0

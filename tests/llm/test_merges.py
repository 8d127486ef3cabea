"""Byte-level BPE by transducer against the library and against merging by the definition."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from casemill.llm import merges
from casemill.llm.queries import op12_merges

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = merges.ranks_of(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ALPHABET = "ab1. \n\t'!é² 　\x1f\x1c\x85᠎​ 日本語😀सर्वАб٣"
ODD = ["", " ", "don't WE'LL 's", "q" * 3000, " " * 500 + "x", "日本語" * 400, "ab" * 1000, "x<|endoftext|> y", "a \n b  "]


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_encoder_equals_the_library():
    rng = random.Random(12)
    encoder = merges.Encoder(PATH, public_tokenizers.PATTERN)
    texts = ODD + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    for text in texts:
        assert ids_of(encoder.encode(text)) == LIBRARY.encode_ordinary(text), repr(text)
    long = " ".join(texts) * 40
    assert len(long) > 1_000_000 and ids_of(encoder.encode(long)) == LIBRARY.encode_ordinary(long)


def test_restarts_and_generations_change_nothing(monkeypatch):
    monkeypatch.setattr(merges, "STATES", 5)
    monkeypatch.setattr(merges, "PAIRS", 3)
    monkeypatch.setattr(merges, "REMEMBERED", 2000)
    encoder, rng = merges.Encoder(PATH, public_tokenizers.PATTERN), random.Random(13)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdeß") for _ in range(rng.randint(1, 9))) for _ in range(9))
        assert ids_of(encoder.encode(text)) == LIBRARY.encode_ordinary(text)


def test_any_vocabulary_merges_by_rank():
    """Random ranks: tokens below their halves, tokens no merge reaches, runs of one byte."""
    rng = random.Random(14)
    for _ in range(60):
        tokens = {bytes((b,)) for b in b"abc"} | {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(12)}
        order = list(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        transducer = merges.Transducer(ranks)
        for _ in range(60):
            text = bytes(rng.choices(b"abc", k=rng.randint(1, 14)))
            assert transducer(text) == ([ranks[text]] if text in ranks else merges.merged(ranks, text)), (ranks, text)


def test_lookahead_is_bounded(monkeypatch):
    monkeypatch.setattr(merges, "SPAN", 10)
    transducer = merges.Transducer({bytes((b,)): i for i, b in enumerate(b"ab")} | {b"ab": 2, b"abab": 3})
    kept, emit = [], transducer._emit
    transducer._emit = lambda *given: kept.append(emit(*given)) or kept[-1]
    assert transducer(b"ab" * 500 + b"a") == [3] * 250 + [0]
    assert len(kept) > 90 and max(map(len, kept)) <= 12 and len(transducer.states) < 40


def test_decoder_streams_and_replaces():
    rng = random.Random(15)
    token = {rank: t for t, rank in RANKS.items()}
    decoder = merges.Decoder(token)
    for _ in range(5000):
        ids = [rng.randrange(len(token)) for _ in range(rng.randint(0, 8))]
        parts = [decoder.feed(i) for i in ids]
        assert "".join([*parts, decoder.end()]) == decoder.text(ids) == b"".join(token[i] for i in ids).decode("utf-8", "replace")
    byte = {bytes((b,)): b for b in range(256)}
    decoder = merges.Decoder({r: t for t, r in byte.items()})
    assert [decoder.feed(b) for b in "aé😀".encode()] == ["a", "", "é", "", "", "", "😀"]
    for first in range(0x80, 0x100):
        for second in range(0, 0x100, 7):
            data = bytes((first, second, 0x80, 0xBF, first))
            assert "".join([*map(decoder.feed, data), decoder.end()]) == data.decode("utf-8", "replace")


def test_query_and_tables(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in op12_merges(spark, folder).collect()}
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want
    rows = [(1, None), (None, "a b"), (2, ""), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids")
    back = merges.decode(merges.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text, len(r.ids) // 4) for r in back) == [(0, "a b", 2), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert merges.decode(merges.encode(docs.limit(0), PATH), PATH).count() == 0

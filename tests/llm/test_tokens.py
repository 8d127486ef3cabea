"""Packing, pieces and language-model scores against brute force."""

import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casemill.llm import packing, ppm, unigram

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", " a", "a ", "a  b", "a \n b", "don't we'll, 's x!", "x<|endoftext|> y", "é² ½ x", "a b", "x.\nY z", "1st 2nd, 3rd.", "😀日本 語\U0001F601", "q" * 3000]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab1. \n\t'!é² 　\x1f") for _ in range(rng.randint(1, 14))) for _ in range(800)]
    whole = Tokenizer.from_file(BPE)
    for text, ids in zip(texts, packing.Encoder(BPE)(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_level_choice_is_the_smallest_sum_of_squares():
    rng = random.Random(2)
    levels, window, number = packing.Levels(32), 32, 0
    for _ in range(400):
        size = rng.randint(1, 31)
        before = levels.counts.copy()
        best = min(sum(int(x) ** 2 for x in after) for h in range(window - size + 1) if h == 0 or before[h]
                   for after in [[int(c) - (i == h > 0) + (i == h + size < window) for i, c in enumerate(before)]])
        _, level = levels.place(size, number)
        number += 1
        assert sum(int(x) ** 2 for x in levels.counts) == best and level + size <= window


def test_packing_round_trip(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["lorem", "ipsum", "dolor,", "sit."]) for _ in range(rng.randint(1, 1500))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS start").repartition(3)
    out = packing.pack(docs, BPE).collect()
    whole, by_doc, by_sequence = Tokenizer.from_file(BPE), defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    assert packing.pack(docs.limit(0), BPE).count() == 0
    assert [tuple(r)[:3] for r in packing.pack(spark.createDataFrame([(None, None)] * 2, "doc_id long, text string"), BPE).collect()] == [(None, 0, 1)] * 2


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.vocabulary(PIECES)


def brute_pieces(word, v, words):
    size = len(word)
    best = [None] * (size + 1)
    best[0] = (0, [])
    for start in range(size):
        if best[start] is None:
            continue
        one = 1 if word[start] < 0x80 else 2 if word[start] < 0xE0 else 3 if word[start] < 0xF0 else 4
        options = [(end, int(v.scores[words[word[start:end]]]), [words[word[start:end]]]) for end in range(start + 1, size + 1) if word[start:end] in words]
        if word[start:start + one] not in words:
            options.append((start + one, v.unknown, [v.byte_ids[b] for b in word[start:start + one]]))
        for end, value, ids in options:
            if best[end] is None or best[start][0] + value > best[end][0]:
                best[end] = (best[start][0] + value, best[start][1] + ids)
    return best[size][1]


def test_viterbi_equals_brute_force(vocabulary):
    rng = random.Random(4)
    words = {p: i for i, p in enumerate(vocabulary.pieces) if p and i not in set(vocabulary.byte_ids)}
    units = ["▁" + "".join(rng.choice("etaonisrhäé€😀Ж日xyz.,") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["▁▁▁the", "▁" + "reading" * 30, "▁\x00\n"]
    raw = [u.encode() for u in units]
    assert unigram.segment(raw, vocabulary) == [brute_pieces(w, vocabulary, words) for w in raw]


def test_pieces_equal_the_library(vocabulary, tmp_path):
    """The same pieces and log scores in the library's own unigram model give the same ids."""
    model_pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece
    proto = model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        p.score = float(vocabulary.scores[i]) / unigram.UNIT
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["The quick brown fox jumps over the lazy dog.", "Überraschung für alle", "a  b   c ", "naïve café 😀 日本語", "releases and licences of 2024"]
    encoder = unigram.Encoder(vocabulary)
    for text, ids in zip(texts, encoder(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)


def test_pieces_round_trip(spark, vocabulary):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(3, "a"), (None, "x y")], "doc_id long, text string").selectExpr("*", "1 AS ids")
    rows = unigram.encode(docs, vocabulary).collect()
    assert len(rows) == len(ODD) + 2
    assert all(r.decoded == ("x y" if r.doc_id is None else ODD[r.doc_id] or "") for r in rows)
    assert all(r.n_bytes == 0 and r.score == 0 and r.ids == [] for r in rows if r.doc_id in (0, 1))
    assert unigram.encode(docs.limit(0), vocabulary).count() == 0


def brute_ppm(train):
    seen = defaultdict(Counter)
    for t in train:
        y = [256] * ppm.ORDER + list(t) + [256]
        for p in range(ppm.ORDER, len(y)):
            for j in range(ppm.ORDER + 1):
                seen[tuple(y[p - j:p])][y[p]] += 1

    def symbol(context, s):
        out, excluded = 0.0, set()
        for j in range(ppm.ORDER, -1, -1):
            here = seen.get(tuple(context[len(context) - j:]))
            if not here:
                continue
            left = {k: v for k, v in here.items() if k not in excluded}
            n, d = sum(left.values()), len(left)
            if n + d == 0:
                continue
            whole = n + (0 if len(here) == 257 else d)
            if s in left:
                return out + math.log10(left[s] / whole)
            out += math.log10(d / whole)
            excluded |= set(here)
        return out - math.log10(257 - len(excluded))

    return symbol


@pytest.mark.parametrize("block", [32_000_000, 40])
def test_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ppm, "BLOCK", block)
    rng = random.Random(6)
    texts = [None, "", " ", "Abracadabra abra", "abracadabra ABRA", "été à la mer", "zzz", "x" * 700] + [
        " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat."]) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, "the cat")]
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS score").repartition(3)
    got = sorted(ppm.scores(docs, learn).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_tokens))
    low = [(i, (t or "").translate({c: c + 32 for c in range(65, 91)}).encode()) for i, t in rows]
    train = [t for i, t in low if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    symbol = brute_ppm(train)
    words = Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(words.values()), len(words)
    for r, (i, t) in zip(got, sorted(low, key=lambda x: (x[0] is None, x[0], len(x[1].split())))):
        tokens = [*t.split(), b""]
        y = [256] * ppm.ORDER + list(t) + [256]
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, len(tokens), sum(w in words for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score == pytest.approx(sum(symbol(y[:p], y[p]) for p in range(ppm.ORDER, len(y))))
    assert len(got) == len(rows)


def test_probabilities_sum_to_one():
    symbol = brute_ppm([b"abracadabra", b"the cat sat"])
    for context in ([256] * 4, list(b"abra"), list(b"zzzz")):
        assert sum(10 ** symbol(context, s) for s in range(257)) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    rows = sorted(ppm.scores(docs, F.lit(False)).collect())
    assert [(r.doc_id, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert rows[0].score == pytest.approx(-3 * math.log10(257)) and rows[1].score == pytest.approx(-math.log10(257))
    assert ppm.scores(docs.limit(0), F.lit(True)).count() == 0


def test_ranks_are_used_only_where_they_give_the_same_ids():
    encoder = packing.Encoder(BPE)
    whole = encoder.tokenizer.encode
    assert encoder.ranked is not None
    # every character in several places, and long runs
    texts = ["\n".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)} {chr(c)}!" for c in range(at, at + 64)) for at in range(0, 0x3400, 64)]
    texts += ["x" * 50_000, " " * 50_000 + "y", "\t \n" * 20_000, "a <|endoftext|> b", "it's we'LL '\u2019s"]
    for text in texts:
        assert encoder([text])[0] == np.array(whole(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    given = json.loads(encoder.tokenizer.to_str())
    merges = given["model"]["merges"]
    turned = {**given, "model": {**given["model"], "merges": merges[1:] + merges[:1]}}
    prefixed = {**given, "pre_tokenizer": {**given["pre_tokenizer"], "add_prefix_space": True}}
    assert encoder._ranked(turned) is None and encoder._ranked(prefixed) is None

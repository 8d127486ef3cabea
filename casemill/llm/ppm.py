"""Language-model scores by prediction by partial matching (PPM).

A byte-context trie of depth ``ORDER`` is counted over the learning texts and stored as tables: per depth the symbols
seen after each context, and per context how often anything followed. The probability of a symbol starts at the longest
context; a symbol not seen there costs an escape (method C: distinct symbols over occurrences plus distinct symbols) and
moves to the context one byte shorter, where symbols already ruled out are excluded. As a longer context's symbols are
among the shorter one's, exclusion needs one number per context: how much of the parent its own symbols take up. The code
length therefore depends on the last ``ORDER + 1`` symbols alone and is worked out once per such gram of the corpus.

Documents are dealt into blocks of bounded size and written. A block sends each of its words and grams once, however
often they occur; joins add corpus counts and code lengths, and each block gets back only what it asked for. Nothing that
grows with the corpus is broadcast or collected, but for two totals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.sources.session import scratch_path, written

#: Length of the longest context. A symbol takes 9 bits: a byte, or the boundary before and after a text.
ORDER = 4
BITS = 9
BOUNDARY = 256
SYMBOLS = 257
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK = 32_000_000
#: Bytes of text worked on at once inside a block.
PART = 2_000_000


def split_words(text: bytes) -> list[bytes]:
    """Words of the lower-cased (A-Z) text between the six ASCII white-space characters."""
    return text.lower().split()


def parts(texts: list[bytes]) -> Iterator[list[int]]:
    """Runs of indices whose texts have about ``PART`` bytes together."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t)
        if size >= PART:
            yield run
            run, size = [], 0
    if run:
        yield run


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each symbol of each text (its closing boundary included), and each text's first place."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    symbols = np.full(int((sizes + ORDER + 1).sum()), BOUNDARY, dtype=np.int64)
    ends = np.cumsum(sizes + ORDER + 1)
    lead = ends - sizes - ORDER - 1
    inside = np.ones(len(symbols), dtype=bool)
    for i in range(ORDER):
        inside[lead + i] = False
    ending = inside.copy()
    inside[ends - 1] = False
    symbols[inside] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    codes = np.zeros(len(symbols), dtype=np.int64)
    for back in range(ORDER, -1, -1):
        codes[ORDER:] = (codes[ORDER:] << BITS) | symbols[ORDER - back:len(symbols) - back]
    return codes[ending], np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)


def blocked(docs: DataFrame, learn: Column, *kept: Column) -> DataFrame:
    """``block, learn, text`` (bytes of the lower-cased text, null as empty) and ``kept``, written to the shared folder."""
    rows = docs.select(*kept, F.coalesce(learn, F.lit(False)).alias("learn"),
                       F.encode(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "UTF-8").alias("text"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64)
            ends = before + np.cumsum(sizes)
            before = int(ends[-1]) if len(ends) else before
            number = pa.array(first + ends // BLOCK, pa.int64())
            yield pa.RecordBatch.from_arrays([number, *batch.columns], names=["block", *batch.schema.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return _packed(rows.mapInArrow(numbered, f"block bigint, {fields}"))


def _packed(df: DataFrame) -> DataFrame:
    """As ``written``, for the large tables: texts and what blocks ask for take less room in zstd."""
    path = scratch_path(df.sparkSession, "blocks")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ASKED = "block bigint, word binary, gram bigint, n bigint"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: each word and each gram, with its number of occurrences in learning texts (0: only asked for).

    The empty word stands for the end of a text.
    """
    def out(block: int, texts: list[bytes], learns: list[bool]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for run in parts(texts):
            for learnt in (False, True):
                own = [texts[i] for i in run if learns[i] == learnt]
                if not own:
                    continue
                seen, n = np.unique(grams(own)[0], return_counts=True)
                found.append((seen, n if learnt else np.zeros_like(n)))
                for t in own:
                    w = split_words(t)
                    w.append(b"")
                    if learnt:
                        words.update(w)
                    else:
                        words.update(dict.fromkeys(w, 0))
        codes, index = np.unique(np.concatenate([s for s, _ in found]), return_inverse=True)
        n = np.bincount(index, weights=np.concatenate([n for _, n in found])).astype(np.int64)
        yield asked(block, word=pa.array(list(words), pa.binary()), n=pa.array(list(words.values()), pa.int64()))
        yield asked(block, gram=pa.array(codes, pa.int64()), n=pa.array(n, pa.int64()))

    def asked(block: int, n: pa.Array, word: pa.Array | None = None, gram: pa.Array | None = None) -> pa.RecordBatch:
        size = len(n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, block), pa.int64()), word if word is not None else pa.nulls(size, pa.binary()),
                                           gram if gram is not None else pa.nulls(size, pa.int64()), n], names=["block", "word", "gram", "n"])

    now, texts, learns = None, [], []
    for batch in batches:
        for block, learn, text in zip(*[batch.column(c).to_pylist() for c in ("block", "learn", "text")]):
            if block != now and texts:
                yield from out(now, texts, learns)
                texts, learns = [], []
            now = block
            texts.append(text)
            learns.append(learn)
    if texts:
        yield from out(now, texts, learns)


def _mask(symbols: int) -> int:
    return (1 << BITS * symbols) - 1


def code_lengths(seen: DataFrame) -> DataFrame:
    """``gram, log10p`` for every gram of ``seen(gram, n)``; those with n over 0 are the trie's deepest level.

    Tables of at most two symbols have at most 66,049 rows and are broadcast; all others meet by shuffle joins.
    """
    def small(df: DataFrame, symbols: int) -> DataFrame:
        return F.broadcast(df) if symbols <= 2 else df

    deepest = seen.filter("n > 0").select(F.col("gram").alias(f"s{ORDER}"), F.col("n").alias(f"n{ORDER}"))
    symbols = {ORDER: deepest}
    for j in range(ORDER - 1, -1, -1):  # s_j: the last j + 1 symbols of a gram, its number of occurrences n_j
        symbols[j] = written(deepest.groupBy(F.col(f"s{ORDER}").bitwiseAND(F.lit(_mask(j + 1))).alias(f"s{j}")).agg(F.sum(f"n{ORDER}").alias(f"n{j}")))
    contexts = {}
    for j in range(ORDER + 1):  # c_j: a context of j symbols; t: occurrences after it, d: distinct symbols, x: their part of the parent
        own = symbols[j]
        if j:
            parent = small(symbols[j - 1], j)
            own = own.withColumn(f"s{j - 1}", F.col(f"s{j}").bitwiseAND(F.lit(_mask(j)))).join(parent, f"s{j - 1}")
        taken = F.sum(f"n{j - 1}") if j else F.lit(0).cast("bigint")
        contexts[j] = own.groupBy(F.shiftright(f"s{j}", BITS).alias(f"c{j}")).agg(
            F.sum(f"n{j}").alias(f"t{j}"), F.count("*").alias(f"d{j}"), taken.alias(f"x{j}"))
        contexts[j] = written(contexts[j])

    grams_ = seen.select("gram")
    p, found = F.lit(0.0), F.lit(False)
    x, d = F.lit(0), F.lit(0)
    for j in range(ORDER, -1, -1):
        grams_ = grams_.withColumn(f"s{j}", F.col("gram").bitwiseAND(F.lit(_mask(j + 1)))).join(small(symbols[j], j + 1), f"s{j}", "left")
        grams_ = grams_.withColumn(f"c{j}", F.shiftright(f"s{j}", BITS)).join(small(contexts[j], j), f"c{j}", "left")
        rest, new = F.coalesce(f"t{j}", F.lit(0)) - x, F.coalesce(f"d{j}", F.lit(0)) - d
        out_of = rest + F.when(F.col(f"d{j}") == SYMBOLS, 0).otherwise(new)
        here = F.col(f"n{j}").isNotNull()
        step = F.when(found | (out_of <= 0), 0.0).when(here, F.log10(F.col(f"n{j}") / out_of)).otherwise(F.log10(new / out_of))
        grams_ = grams_.withColumn(f"p{j}", p + step).withColumn(f"f{j}", found | here)
        p, found = F.col(f"p{j}"), F.col(f"f{j}")
        x, d = F.coalesce(f"x{j}", F.lit(0)), F.coalesce(f"d{j}", F.lit(0))
    last = F.when(found, 0.0).otherwise(-F.log10(SYMBOLS - d))
    return grams_.select("gram", (p + last).alias("log10p"))


def scores(docs: DataFrame, learn: Column) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row, repeated rows included.

    ``learn`` marks the rows that are learned from (null: not). Base: add-one counts of words and one end per text.
    Null and empty texts have the end as their only token. With nothing learned, every symbol is equally likely.
    """
    texts = blocked(docs, learn, F.col("doc_id").cast("bigint").alias("doc_id"))
    asked = _packed(texts.select("block", "learn", "text").mapInArrow(counted, ASKED))
    words = asked.filter("word is not null").select("block", "word", "n")
    known = written(words.groupBy("word").agg(F.sum("n").alias("c")))
    totals = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum((F.col("c") > 0).cast("bigint")), F.lit(0)).alias("v")).first()
    asked_grams = asked.filter("gram is not null").select("block", "gram", "n")
    lengths = written(code_lengths(written(asked_grams.groupBy("gram").agg(F.sum("n").alias("n")))))
    answers = (words.select("block", "word").join(known, "word").select("block", "word", "c", F.lit(None).cast("bigint").alias("gram"), F.lit(None).cast("double").alias("p"))
               .unionByName(asked_grams.select("block", "gram").join(lengths, "gram")
                            .select("block", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("bigint").alias("c"), "gram", F.col("log10p").alias("p"))))
    train_tokens, below = int(totals.n), log10(totals.n + totals.v + 1)

    def scored(own: pa.Table, answer: pa.Table) -> pa.Table:
        of_words = answer.filter(pc.is_valid(answer.column("word")))
        value = dict(zip(of_words.column("word").to_pylist(), np.log10(of_words.column("c").to_numpy() + 1.0).tolist()))
        of_grams = answer.filter(pc.is_valid(answer.column("gram")))
        codes_, first = np.unique(of_grams.column("gram").to_numpy(), return_index=True)  # a block read by two tasks asks twice
        index, p = pd.Index(codes_), of_grams.column("p").to_numpy()[first]
        raw = own.column("text").to_pylist()
        tokens, n_known, base, score = [], [], [], []
        for run in parts(raw):
            part = [raw[i] for i in run]
            codes, starts = grams(part)
            score.append(np.add.reduceat(p[index.get_indexer(codes)], starts))
            for t in part:
                w = split_words(t)
                w.append(b"")
                v = np.fromiter(map(value.__getitem__, w), np.float64, len(w))
                tokens.append(len(w))
                n_known.append(int(np.count_nonzero(v)))
                base.append(float(v.sum()) - len(w) * below)
        return pa.table({"doc_id": own.column("doc_id"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                         "train_tokens": pa.array([train_tokens] * len(raw), pa.int64()), "base_score": pa.array(base, pa.float64()),
                         "score": pa.array(np.concatenate(score), pa.float64())})

    return (texts.select("block", "doc_id", "text").groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(scored, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"))

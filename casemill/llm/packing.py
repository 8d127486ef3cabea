"""Sum-of-squares packing of tokenised documents into fixed windows.

Every document becomes its token ids and an end id. Full windows leave at once; the rest of a document goes to the fill
level whose choice gives the smallest sum of squared counts of partly filled windows, kept in an array with one count
per level. Windows that are still open when a task's rows end are laid out again as one run of tokens, cut into whole
windows and then into powers of two, which need no padding. A task packs its own rows: packing is one narrow pass.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.worker import kept

WINDOW = 2048
END = 1
#: Rows of pieces handed on at once.
HANDED_ON = 20_000


class Encoder:
    """Byte-level BPE ids of whole texts as little-endian bytes, four per id, as the tokenizers library gives them.

    If ids rise in the order of merges and every token's own bytes merge to it, then two neighbours that make a token are
    always that token's merge, and merging by ranks gives the same ids: ``tiktoken`` does that, several times as fast.
    Both conditions are checked on the vocabulary. Texts with a special token, and any text under another kind of
    vocabulary, are encoded by ``tokenizers`` itself.
    """

    #: Fixed value: the word pattern of byte-level vocabularies.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(json.loads(self.tokenizer.to_str()))

    def _ranked(self, given: dict):
        """The same vocabulary merged by ranks; None if that could give other ids."""
        import tiktoken

        model, words = given["model"], given["pre_tokenizer"] or {}
        plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space", True)
        if given["normalizer"] or not plain or model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") \
                or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            return None
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        # bytes that print stand for themselves, the others for the characters from 256 on
        shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        tokens = {t: i for t, i in model["vocab"].items() if t not in self.special}
        if merged != sorted(merged) or not set("".join(tokens)) <= byte.keys():
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in tokens.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            return None
        ranked = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return ranked if all(ranked._core_bpe.encode_single_piece(t) == [i] for t, i in ranks.items()) else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [np.array(self._ids(t), dtype="<u4").tobytes() for t in texts]

    def _ids(self, text: str) -> list[int]:
        if self.ranked is None or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)


class Levels:
    """Open windows by fill level, and the level array."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def place(self, size: int, fresh: int) -> tuple[int, int]:
        """The window for a piece of ``size`` and the level it had; ``fresh`` is the number of a new window.

        Moving a window from level h to h + size changes the sum of squares by 2 (N[h + size] - N[h] + 1); a new one
        by 2 N[size] + 1; filling a window up to the end takes it out, -2 N[h] + 1. Ties go to the fuller window.
        """
        room = self.window - size
        here = self.counts[:room + 1]
        change = 2 * (self.counts[size:] - here + 1)
        change[room] = 1 - 2 * here[room]
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.counts[size] + 1 if room else 0
        level = room - int(np.argmin(change[::-1]))
        number = self.open[level].pop() if level else fresh
        self.counts[level] -= level > 0
        if level + size < self.window:
            self.counts[level + size] += 1
            self.open[level + size].append(number)
        return number, level


def pieces(rows: Iterator[tuple[int | None, bytes]], window: int, first: int) -> Iterator[tuple]:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` for the documents' ids, four bytes each.

    Sequence numbers count up from ``first``. Ids of open windows are kept until the window is full or the rows end.
    """
    levels, held, number = Levels(window), {}, first

    def row(piece: tuple, sequence: int, offset: int) -> tuple:
        doc_id, start, ids, tokens = piece
        return doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset

    for doc_id, ids in rows:
        tokens = len(ids) // 4
        full = tokens - tokens % window
        for start in range(0, full, window):
            yield row((doc_id, start, ids[4 * start:4 * (start + window)], tokens), number, 0)
            number += 1
        if full == tokens:
            continue
        rest = (doc_id, full, ids[4 * full:], tokens)
        sequence, level = levels.place(tokens - full, number)
        number += sequence == number
        held.setdefault(sequence, []).append((rest, level))
        if level + tokens - full == window:
            for piece, offset in held.pop(sequence):
                yield row(piece, sequence, offset)
    left = [piece for members in held.values() for piece, _ in members]
    total = sum(len(p[2]) // 4 for p in left)
    sizes = [window] * (total // window) + [1 << b for b in range(window.bit_length(), -1, -1) if (total % window) >> b & 1]
    at, size = 0, sizes.pop(0) if sizes else 0
    for doc_id, start, ids, tokens in left:
        while ids:
            if at == size:
                number, at, size = number + 1, 0, sizes.pop(0)
            cut = ids[:4 * (size - at)]
            yield row((doc_id, start, cut, tokens), number, at)
            start, at, ids = start + len(cut) // 4, at + len(cut) // 4, ids[len(cut):]


SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """The pieces of all rows, repeated rows included. A null or empty text is its end id alone; a null id stays null.

    ``tokenizer`` is the path of the vocabulary file on the executors. Sequence numbers hold the task's number above
    bit 36, so they are unique without a shuffle. An empty table gives no rows.
    """
    end = np.array([END], dtype="<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(("encoder", tokenizer), lambda: Encoder(tokenizer))

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    for i, encoded in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()])):
                        yield i, encoded + end

        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
        rows = pieces(documents(), window, TaskContext.get().partitionId() << 36)
        while out := list(islice(rows, HANDED_ON)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(packed, SCHEMA)

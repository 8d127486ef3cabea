"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A vocabulary of pieces with log scores is laid out as a double-array trie over UTF-8 bytes. White space becomes a marker,
with one in front of the text. No piece has a marker after another character, so texts fall into units at markers, and each
distinct unit is segmented once per worker. Short units are segmented together: the trie steps and the best-path updates
run over all units of a batch at one position. A character that no piece covers becomes its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casemill.llm.worker import kept

MARK = "▁"
#: Units up to this many bytes are segmented together, longer ones one by one.
TOGETHER = 48
#: Units kept with their ids in a worker; when full it starts anew, which changes no id.
REMEMBERED = 400_000
#: Scores are whole numbers of this part of a nat, so sums are exact and ties are ties on every machine.
UNIT = 1_000_000
#: What a character without a piece costs beyond the lowest score.
PENALTY = 10 * UNIT
FAR = np.iinfo(np.int64).min // 2


@dataclass(frozen=True)
class Vocabulary:
    """``pieces``: the UTF-8 form of each id (control ids empty); ``scores``: whole-number log scores; ``byte_ids``: the
    ids of the 256 single bytes; ``base, check, value``: the double array over all normal pieces."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: list[int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @property
    def unknown(self) -> int:
        return int(self.scores.min()) - PENALTY


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State s goes to base[s] + byte + 1 where check of that place is s; value is the id that ends there, or -1."""
    trie: list[dict[int, int]] = [{}]
    ends = [-1]
    for word, number in words.items():
        node = 0
        for c in word:
            if c not in trie[node]:
                trie[node][c] = len(trie)
                trie.append({})
                ends.append(-1)
            node = trie[node][c]
        ends[node] = number
    size = 4 * len(trie) + 1024
    base, check, value = (np.full(size, fill, dtype=np.int64) for fill in (0, -1, -1))
    taken = bytearray(size)
    taken[0] = 1
    todo = [(0, 0, 0)]  # states with most children first: they need the wide gaps, single children fill the rest
    first_free, start = 1, 0
    while todo:
        _, node, state = heappop(todo)
        value[state] = ends[node]
        codes = sorted(trie[node])
        if not codes:
            continue
        first_free = taken.index(0, first_free)
        if len(codes) == 1:
            at = taken.index(0, max(first_free, codes[0] + 1)) - codes[0] - 1
        else:
            place, tried = taken.index(0, max(first_free, start, codes[0] + 1)), 0
            while any(taken[place + c - codes[0]] for c in codes):
                place = taken.index(0, place + 1)
                tried += 1
            if tried > 50:  # what lies before is dense
                start = place
            at = place - codes[0] - 1
        base[state] = at
        for c in codes:
            place = at + c + 1
            taken[place] = 1
            check[place] = state
            heappush(todo, (-len(trie[trie[node][c]]), trie[node][c], place))
    used = int(base.max()) + 258  # a step from any state stays inside
    return base[:used], check[:used], value[:used]


def vocabulary(path: str) -> Vocabulary:
    """Reads a SentencePiece file. Scores of a merge-rank vocabulary are minus the rank; rank r becomes the log of its
    share under Zipf's law, -log(r) - log(H), so that likely pieces win over many short ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.piece_size()
    pieces, words, byte_ids, ranks = [b""] * size, {}, [0] * 256, {}
    for i in range(size):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            pieces[i] = bytes([int(text[3:5], 16)])
            byte_ids[pieces[i][0]] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[i] = text.encode()
            words[pieces[i]] = i
    whole = log(sum(1 / r for r in range(1, len(words) + 1)))
    for r, i in enumerate(sorted(words.values(), key=lambda i: (-model.get_score(i), i)), 1):
        ranks[i] = -round(UNIT * (log(r) + whole))
    scores = np.array([ranks.get(i, 0) for i in range(size)], dtype=np.int64)
    return Vocabulary(pieces, scores, byte_ids, *double_array(words))


def segment(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """Best ids of each word; of equal sums, the longer last piece. Characters without a piece become byte ids."""
    out: list[list[int]] = [[] for _ in words]
    short = sorted((i for i, w in enumerate(words) if 0 < len(w) <= TOGETHER), key=lambda i: len(words[i]))
    for at in range(0, len(short), 20_000):
        run = short[at:at + 20_000]
        for i, ids in zip(run, _together([words[i] for i in run], v)):
            out[i] = ids
    for i, w in enumerate(words):
        if len(w) > TOGETHER:
            out[i] = _alone(w, v)
    return out


def _together(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    sizes = np.array([len(w) for w in words])
    width = int(sizes.max())
    text = np.zeros((width, len(words)), dtype=np.int64)
    for i in range(width):
        text[i] = [w[i] if i < len(w) else 0 for w in words]
    lead = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
    best = np.full((width + 1, len(words)), FAR)
    back = np.zeros((width + 1, len(words)), dtype=np.int64)
    piece = np.full((width + 1, len(words)), -1)
    best[0] = 0

    def offer(end: np.ndarray, rows: np.ndarray, value: np.ndarray, start: int, number: np.ndarray | int) -> None:
        better = value > best[end, rows]
        e, r = end[better], rows[better]
        best[e, r] = value[better]
        back[e, r] = start
        piece[e, r] = number[better] if isinstance(number, np.ndarray) else number

    for start in range(width):
        rows = np.flatnonzero((best[start] > FAR) & (sizes > start))
        state = np.zeros(len(rows), dtype=np.int64)
        one = lead[start]
        covered = np.zeros(len(words), dtype=bool)
        origin = rows
        for end in range(start, width):
            inside = sizes[rows] > end
            rows, state = rows[inside], state[inside]
            step = v.base[state] + text[end, rows] + 1
            goes = v.check[step] == state
            rows, state = rows[goes], step[goes]
            if not len(rows):
                break
            number = v.value[state]
            is_end = number >= 0
            r, n = rows[is_end], number[is_end]
            offer(np.full(len(r), end + 1), r, best[start, r] + v.scores[n], start, n)
            covered[r[one[r] == end + 1 - start]] = True
        lone = origin[~covered[origin]]
        offer(start + one[lone], lone, best[start, lone] + v.unknown, start, -1)
    out = []
    for i, word in enumerate(words):
        ids, end = [], len(word)
        while end:
            start, number = int(back[end, i]), int(piece[end, i])
            ids.append([number] if number >= 0 else [v.byte_ids[b] for b in word[start:end]])
            end = start
        out.append([x for part in reversed(ids) for x in part])
    return out


def _alone(word: bytes, v: Vocabulary) -> list[int]:
    size = len(word)
    best, back, piece = [FAR] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
    best[0] = 0
    base, check, value, scores = v.base, v.check, v.value, v.scores
    for start in range(size):
        if best[start] == FAR:
            continue
        one = 1 if word[start] < 0x80 else 2 if word[start] < 0xE0 else 3 if word[start] < 0xF0 else 4
        state, covered = 0, False
        for end in range(start, size):
            step = int(base[state]) + word[end] + 1
            if check[step] != state:
                break
            state = step
            number = int(value[state])
            if number >= 0:
                covered |= end + 1 - start == one
                if (total := best[start] + int(scores[number])) > best[end + 1]:
                    best[end + 1], back[end + 1], piece[end + 1] = total, start, number
        if not covered and (total := best[start] + v.unknown) > best[start + one]:
            best[start + one], back[start + one], piece[start + one] = total, start, -1
    ids, end = [], size
    while end:
        start, number = back[end], piece[end]
        ids.append([number] if number >= 0 else [v.byte_ids[b] for b in word[start:end]])
        end = start
    return [x for part in reversed(ids) for x in part]


def units(text: str) -> list[str]:
    """The marked text cut before each run of markers; none for an empty text."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
    return [MARK + w for w in text.split(" ")]


class Encoder:
    """Ids of whole texts as little-endian bytes, four per id, and back."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [units(t) for t in texts]
        wanted = set().union(*cut)
        new = [u for u in wanted if u not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(wanted)
        for unit, ids in zip(new, segment([u.encode("utf-8", "surrogatepass") for u in new], self.v)):
            self.known[unit] = np.array(ids, dtype="<u4").tobytes()
        known = self.known
        return [b"".join([known[u] for u in c]) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The text: pieces and bytes put together, markers as spaces, without the first one."""
        raw = b"".join(map(self.v.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """``doc_id, ids, n_bytes, score, decoded`` for every row, repeated rows included.

    ``n_bytes`` counts ids of single bytes, ``score`` sums the log scores of the other ids, ``decoded`` is the text that
    the ids give back (equal to the text, unless it holds the marker character itself, which reads as a space). Null and
    empty texts have no ids, score 0 and decode to the empty text.
    """
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("pieces", len(v.pieces), crc32(v.scores.tobytes()), crc32(b"".join(v.pieces))), lambda: Encoder(v))
        is_byte = np.zeros(len(v.pieces), dtype=bool)
        is_byte[v.byte_ids] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = encoder([t or "" for t in part.column("text").to_pylist()])
                lists = [np.frombuffer(r, "<u4").astype(np.int32) for r in raw]
                offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())),
                    pa.array([int(is_byte[x].sum()) for x in lists], pa.int64()),
                    pa.array([int(v.scores[x].sum()) / UNIT for x in lists], pa.float64()),
                    pa.array([encoder.decode(r) for r in raw], pa.string())],
                    names=["doc_id", "ids", "n_bytes", "score", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(encoded, "doc_id bigint, ids array<int>, n_bytes bigint, score double, decoded string")

"""Byte-level BPE as a finite-state transducer that is determinised while it runs, and streaming decoding.

Merging by rank has two properties that make it sequential. The ids of a text's prefix end in one last token, and what
stands before that token is the encoding of the shorter prefix; and a sequence of tokens is an encoding exactly if every
two neighbours, merged alone, stay as they are. So a state of the transducer is a set of places where a token may still
begin, each with the bytes read since (a proper prefix of some token) and the token before it, and each byte read gives
the last token of the text so far. Lasts of all open places lead back to one place, at most a few tokens' lengths away:
tokens before it can no longer change and are emitted. States and moves are worked out at their first use and kept; a
worker that holds too many starts anew, which changes no id.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from casemill.llm.worker import kept

#: States of a transducer, remembered pairs of tokens, and bytes of remembered words (two generations), per worker.
STATES, PAIRS, REMEMBERED = 80_000, 300_000, 48_000_000
#: Bytes of a long word between two emissions; so many tokens from a node on are looked at one by one.
SPAN, FEW = 4096, 6


def ranks_of(path: str) -> dict[bytes, int]:
    """Tokens and their ids from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(ranks: dict[bytes, int], text: bytes, without: int = -1) -> list[int]:
    """Merging by the definition: the neighbours with the lowest rank first, the leftmost of equals; ``without`` one token."""
    parts = [text[i:i + 1] for i in range(len(text))]
    while True:
        best, at = None, 0
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and rank != without and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


class Transducer:
    """Bytes in, token ids out. A state is a tuple of places ``(node, before)``: the node of the bytes read since in a trie
    of all tokens, and the token before the place (-1: none). The last place is the present one, at the trie's root.

    Tokens before a place that allow the same continuations are replaced by one of them, so that states are few: at the
    first byte by what their right edge can merge with, further down by the tokens that are still possible.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.rank_at, self.depth, self.below = [-1], [0], [[]]
        for token, rank in ranks.items():
            node = 0
            for n, byte in enumerate(token):
                self.below[node].append(rank)
                node = self.child.setdefault(node << 8 | byte, len(self.rank_at))
                if node == len(self.rank_at):
                    self.rank_at.append(-1)
                    self.depth.append(n + 1)
                    self.below.append([])
            self.rank_at[node] = rank
        #: Tokens that go on from a node, where they are few; else None.
        self.below = [tuple(b) if len(b) <= FEW else None for b in self.below]
        #: The two tokens of the last merge that makes a token; none for a byte, or if merging does not reach it.
        self.halves: dict[int, tuple[int, ...] | None] = {}
        for text, rank in ranks.items():
            parts = merged(ranks, text, rank) if len(text) > 1 else ()
            self.halves[rank] = tuple(parts) if len(parts) == 2 else None
        #: Whether ranks give the order of merges: every token stands above its halves.
        self.by_rank = all(len(self.token[t]) == 1 or t < rank for rank, parts in self.halves.items() for t in parts or ())
        #: Ranks of the tokens that go on from a token by a byte, in order.
        self.longer: dict[bytes, list[int]] = {}
        for rank in sorted(self.token):
            for n in range(1, len(text := self.token[rank])):
                if text[:n] in ranks:
                    self.longer.setdefault(text[:n + 1], []).append(rank)
        self.pairs: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self.like: dict[tuple, int] = {}
        self.alike: dict[tuple, int] = {}
        self._state(((0, -1),))

    def _state(self, state: tuple) -> int:
        at = self.number.setdefault(state, len(self.states))
        if at == len(self.states):
            self.states.append(state)
        return at

    def _first_byte(self, before: int, byte: int) -> int:
        """A token with the same right edge as ``before``, as far as tokens that begin with ``byte`` can tell.

        Of the parts at the right edge count those that begin longer tokens with that byte, each with the number of
        these that come before the part's own next merge.
        """
        if before < 0 or not self.by_rank:
            return before
        found = self.like.get((before, byte))
        if found is None:
            part, limit, edge = before, len(self.ranks) ** 2, []
            while True:
                if count := bisect_left(self.longer.get(self.token[part] + bytes((byte,)), ()), limit):
                    edge.append((part, count))
                if self.halves[part] is None:
                    break
                part, limit = self.halves[part][1], part
            found = self.like[before, byte] = self.alike.setdefault((byte, *edge), before)
        return found

    def _further(self, node: int, before: int) -> int | None:
        """A token that allows the same ones from ``node`` on as ``before`` does; None if none of them can follow."""
        few = self.below[node]
        if few is None:
            return before
        found = self.like.get((node, before, None), -2)
        if found == -2:
            allowed = tuple(t for t in few if self.stays(before, t))
            found = self.alike.setdefault((node, None, *allowed), before) if allowed else None
            self.like[node, before, None] = found
        return found

    def stays(self, before: int, after: int) -> bool:
        """Whether two neighbouring tokens stay apart, and the second is a token that merging can reach."""
        key = (before + 1) << 32 | after
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = (len(self.token[after]) == 1 or self.halves[after] is not None) and (before < 0 or self._apart(before, after))
            self.pairs[key] = found
        return found

    def _apart(self, left: int, right: int) -> bool:
        """Undo both tokens' merges, the later one first, and look whether the parts at the border would have merged.

        The parts merge with each other if that rank comes before the left part's own next merge, and not after the right
        part's (of equal ranks the leftmost pair goes first). Ranks give the order of merges if every token ranks above
        its halves; for other vocabularies the pair is merged by the definition.
        """
        tokens, halves = self.token, self.halves
        a, b, next_a, next_b = left, right, len(tokens) ** 2, len(tokens) ** 2
        while self.by_rank:
            rank = self.ranks.get(tokens[a] + tokens[b])
            if rank is not None and rank < next_a and rank <= next_b:
                return False
            split_a, split_b = halves[a], halves[b]
            if split_b and (not split_a or b >= a):
                next_b, b = b, split_b[0]
            elif split_a:
                next_a, a = a, split_a[1]
            else:
                return True
        return merged(self.ranks, tokens[left] + tokens[right]) == [left, right]

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the last token of the text with this byte."""
        end, going = -1, []
        for node, before in self.states[state]:
            if node == 0:
                before = self._first_byte(before, byte)
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            rank = self.rank_at[node]
            if end < 0 <= rank and self.stays(before, rank):
                end = rank
            before = self._further(node, before)
            if before is not None:
                going.append((node, before))
        going.append((0, end))
        move = self.moves[state << 8 | byte] = self._state(tuple(going)), end
        return move

    def __call__(self, text: bytes) -> list[int]:
        """The ids of one word of the pattern. A word that is a token is that token, reachable by merging or not."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        out: list[int] = []
        lasts: list[int] = []
        state = 0
        if len(self.states) > STATES or len(self.like) > 4 * STATES:
            self._restart()
        moves = self.moves.get
        for at in range(0, len(text), SPAN):
            for byte in text[at:at + SPAN]:
                state, last = moves(state << 8 | byte) or self._move(state, byte)
                lasts.append(last)
            if at + SPAN < len(text):
                lasts = self._emit(lasts, {len(lasts) - self.depth[node] for node, _ in self.states[state]}, out)
        self._emit(lasts, {len(lasts)}, out)
        return out

    def _emit(self, lasts: list[int], places: set[int], out: list[int]) -> list[int]:
        """Send what all open places share; returns the last tokens of the places behind it."""
        token = self.token
        while len(places) > 1:
            place = max(places)
            places.remove(place)
            places.add(place - len(token[lasts[place - 1]]))
        settled = place = places.pop()
        sent = []
        while place > 0:
            sent.append(lasts[place - 1])
            place -= len(token[sent[-1]])
        out += reversed(sent)
        return lasts[settled:]


class Encoder(dict):
    """Whole texts to ids, four little-endian bytes each. As a dictionary it holds the words met last with their ids;
    words met again move from the older generation to the newer one, so common words stay."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        self.transducer = Transducer(ranks_of(path))
        self.words = regex.compile(pattern)
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.transducer(word.encode()), dtype="<u4").tobytes()
        self[word] = ids
        self.held += 150 + 2 * len(word) + len(ids)
        return ids

    def encode(self, text: str) -> bytes:
        if len(text) < 1_000_000:
            ids = b"".join(map(self.__getitem__, self.words.findall(text)))
        else:  # a long text's words are not all held at once
            found, parts = self.words.finditer(text), []
            while some := [m.group() for m in islice(found, 50_000)]:
                parts.append(b"".join(map(self.__getitem__, some)))
                self._turn_over()
            ids = b"".join(parts)
        self._turn_over()
        return ids

    def _turn_over(self) -> None:
        if self.held > REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0


#: UTF-8 states: 0 between characters, 1 to 3 that many bytes to come, 4 to 7 after a first byte that narrows the second.
_FIRST = {**{b: 0 for b in range(0x80)}, **{b: 1 for b in range(0xC2, 0xE0)}, **{b: 2 for b in range(0xE1, 0xF0)},
          **{b: 3 for b in range(0xF1, 0xF4)}, 0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
_NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1),
         6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


class Decoder:
    """Ids in, text out as soon as its characters are whole. Bytes that no character can hold become U+FFFD, one for
    each longest beginning of a character, as Python's replacing decoder has it."""

    def __init__(self, token: dict[int, bytes]) -> None:
        self.token = token
        #: Text of the tokens that are whole characters.
        self.whole: dict[int, str] = {}
        for rank, data in token.items():
            try:
                self.whole[rank] = data.decode()
            except UnicodeDecodeError:
                pass
        self.state, self.held = 0, b""

    def feed(self, rank: int) -> str:
        whole = self.whole.get(rank) if self.state == 0 else None
        return self._bytes(self.token[rank]) if whole is None else whole

    def text(self, ids: list[int]) -> str:
        """A whole sequence; tokens that are whole characters need no state between characters."""
        parts, at = list(map(self.whole.get, ids)), 0
        while None in parts:
            at = parts.index(None, at)
            parts[at] = self._bytes(self.token[ids[at]])
            while self.state and at + 1 < len(ids):
                at += 1
                parts[at] = self._bytes(self.token[ids[at]])
        return "".join(parts) + self.end()

    def _bytes(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.state:
                low, high, then = _NEXT[self.state]
                if low <= byte <= high:
                    self.held += bytes((byte,))
                    self.state = then
                    if then == 0:
                        out.append(self.held.decode())
                    continue
                out.append("�")
            self.state, self.held = _FIRST.get(byte, 0), bytes((byte,))
            if self.state == 0:
                out.append(chr(byte) if byte < 0x80 else "�")
        return "".join(out)

    def end(self) -> str:
        rest = "�" if self.state else ""
        self.state, self.held = 0, b""
        return rest


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids`` for every row of ``docs``: the ids as little-endian unsigned 32-bit integers.

    ``path`` is the rank file's place on the executors. A null or empty text has no ids, a null id stays null, repeated
    rows are encoded again, further columns are not read, an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("merges", path, pattern), lambda: Encoder(path, pattern))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [encoder.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with the ids' ``text``, characters as soon as they are whole; null ids have the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = kept(("decoder", path), lambda: Decoder({rank: token for token, rank in ranks_of(path).items()}))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [decoder.text(np.frombuffer(ids or b"", "<u4").tolist()) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())],
                                                 names=["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")

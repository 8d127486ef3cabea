"""Stretches of words that repeat with a period, found by longest common extensions over a difference cover.

Of every V neighbouring positions only those of a difference cover are sampled, chosen so that any two positions reach
sampled ones after the same few words. Only the sampled suffixes are sorted, and a sparse table over their common prefixes
answers how far two of them agree; other pairs first compare a few words. For each period p the positions 0, 3p, 6p ...
of a text are compared with those p further on (n log n pairs in all): a run of at least 4p words holds one of them, and
the extensions to both sides give the whole run. Many texts are worked on as one array, each between words of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A difference cover: every remainder modulo V is a difference of two members.
V, COVER = 7, (0, 1, 3)
#: A run has at least this many words, and at least this many periods.
LEAST, PERIODS = 6, 4
#: Words that are worked on at once (a longer text alone), and pairs of positions compared at once.
WORDS, PAIRS = 200_000, 1_000_000


def reach(v: int, cover: tuple[int, ...]) -> np.ndarray:
    """For every two remainders the fewest words after which both positions are sampled."""
    inside = np.isin(np.arange(v), cover)
    table = np.zeros((v, v), dtype=np.int64)
    for a in range(v):
        for b in range(v):
            table[a, b] = next(d for d in range(v) if inside[(a + d) % v] and inside[(b + d) % v])
    return table


class Extensions:
    """How many words two positions of one text have in common from there on.

    ``words`` holds texts between separators; every separator differs from all else, and words of different texts differ.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.reach = words, reach(V, COVER)
        at = np.arange(len(words))
        self.at = at[np.isin(at % V, COVER)]
        self.number = np.full(len(words), -1, dtype=np.int64)
        self.number[self.at] = np.arange(len(self.at))
        self.levels: list[np.ndarray] = []
        self.rank = self._ranks()
        self.table = self._table()

    def _ranks(self) -> np.ndarray:
        """Places of the sampled suffixes in sorted order; ``levels[k]`` has ranks by the first V * 2^k words."""
        first = self.words[self.at]
        order = np.argsort(first, kind="stable")
        ranks = np.zeros(len(order), dtype=np.int64)
        tied = self._split(ranks, order, np.zeros(len(order), dtype=np.int64), first[order])
        for t in range(1, V):
            tied = self._refine(ranks, tied, self.words[self.at[tied] + t])
        self.levels.append(ranks.copy())
        length = V
        while len(tied):
            tied = self._refine(ranks, tied, ranks[self.number[self.at[tied] + length]].copy())
            length *= 2
            self.levels.append(ranks.copy())
        return ranks

    def _refine(self, ranks: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(tied):
            return tied
        order = np.lexsort((key, ranks[tied]))
        members = tied[order]
        return self._split(ranks, members, ranks[members], key[order])

    @staticmethod
    def _split(ranks: np.ndarray, members: np.ndarray, group: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Give sorted members of groups (named by the rank of their first) new ranks by key; returns who is still tied."""
        if not len(members):
            return members
        place = np.arange(len(members))
        new_group = np.r_[True, group[1:] != group[:-1]]
        new_key = new_group | np.r_[True, key[1:] != key[:-1]]
        begin = np.maximum.accumulate(np.where(new_group, place, 0))
        start = np.maximum.accumulate(np.where(new_key, place, 0))
        ranks[members] = group + start - begin
        single = new_key & np.r_[new_key[1:], True]
        return members[~single]

    def _table(self) -> np.ndarray:
        """Common prefixes of neighbours in sorted order, and their minima over 2^k neighbours in row k."""
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][a] == self.levels[k][b]
            step = V << k
            common[same] += step
            a[same], b[same] = self.number[self.at[a[same]] + step], self.number[self.at[b[same]] + step]
        left = np.arange(len(a))
        for t in range(V):
            left = left[(self.at[b[left]] + t < len(self.words)) & (self.at[a[left]] + t < len(self.words))]
            left = left[self.words[self.at[a[left]] + t] == self.words[self.at[b[left]] + t]]
            common[left] += 1
        self.levels = []
        rows = [common.astype(np.int32)]
        while (half := 1 << (len(rows) - 1)) * 2 <= len(common):
            last = rows[-1].copy()
            last[:-half] = np.minimum(rows[-1][:-half], rows[-1][half:])
            rows.append(last)
        return np.stack(rows)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different positions of one text."""
        found = np.zeros(len(i), dtype=np.int64)
        near = self.reach[i % V, j % V]
        left = np.arange(len(i))
        for t in range(V):
            going = left[near[left] > t]
            same = self.words[i[going] + t] == self.words[j[going] + t]
            found[going[same]] += 1
            done = near[left] <= t
            left = np.sort(np.r_[left[done], going[same]])
        a, b = self.rank[self.number[i[left] + near[left]]], self.rank[self.number[j[left] + near[left]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp(high - low)[1] - 1
        found[left] += np.minimum(self.table[k, low], self.table[k, high - (1 << k)])
        return found


def runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of all runs of texts given as word numbers (0 and up), in that order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if not len(texts) or sizes.max() < LEAST:
        return (np.zeros(0, dtype=np.int64),) * 4
    begins = np.cumsum(np.r_[0, sizes[:-1] + 1]) + 1
    kinds = max(int(t.max()) for t in texts if len(t)) + 1
    line = -1 - np.arange(sizes.sum() + len(texts) + 1, dtype=np.int64)  # separators; words are put in below
    for n, (text, begin) in enumerate(zip(texts, begins)):
        line[begin:begin + len(text)] = text + n * kinds
    forward, backward = Extensions(line), Extensions(line[::-1].copy())
    found = []
    for text, period, at in _grid(sizes):
        i = begins[text] + at
        same = line[i] == line[i + period]
        text, period, i = text[same], period[same], i[same]
        after = forward(i, i + period)
        mirrored = len(line) - i
        before = backward(mirrored, mirrored - period)
        length = before + after + period
        long = length >= np.maximum(LEAST, PERIODS * period)
        found.append(np.stack([text[long], (i - before - begins[text])[long], length[long], period[long]]))
    text, start, length, period = np.concatenate(found, axis=1)
    # the same stretch, met from several positions or at multiples of its period: the smallest period is its own
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    own = np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(text)]
    text, start, length, period = text[own], start[own], length[own], period[own]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``text, period, position`` for each text's periods p up to a fourth of it, at every third multiple of p."""
    most = np.where(sizes >= LEAST, sizes // PERIODS, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = (sizes[text] - period - 1) // (3 * period) + 1
    ends = np.cumsum(count)
    first = 0
    while first < len(text):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        some = slice(first, last)
        each = np.repeat(np.arange(first, last), count[some])
        step = np.arange(len(each)) - np.repeat(ends[some] - count[some] - done, count[some])
        yield text[each], period[each], 3 * period[each] * step
        first = last


def dropped(size: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words some run holds after its first period."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def collapse(docs: DataFrame) -> DataFrame:
    """``doc_id, runs, collapsed`` for every row of ``docs``: the runs of words by start, then period, and the words that
    are left when each run keeps its first period, joined by one space.

    Words are separated by ASCII white space. A null or empty text has no runs and collapses to the empty text, repeated
    rows are worked on again, a null id stays null, further columns are not read, an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, held, words = 0, [], 0
            for at in range(batch.num_rows):
                text = batch.column("text")[at].as_py()
                held.append((text or "").encode().split())
                words += len(held[-1])
                if words >= WORDS or at + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, len(held)), *_worked(held)],
                                                     names=["doc_id", "runs", "collapsed"])
                    low, held, words = at + 1, [], 0

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, runs {RUN}, collapsed string")


def _worked(texts: list[list[bytes]]) -> tuple[pa.Array, pa.Array]:
    flat = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    text, start, length, period = runs([flat[e - len(t):e] for t, e in zip(texts, ends)])
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    left = []
    for n, words in enumerate(texts):
        some = slice(bounds[n], bounds[n + 1])
        if bounds[n] < bounds[n + 1]:
            keep = ~dropped(len(words), start[some], length[some], period[some])
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
        left.append(b" ".join(words).decode())
    structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs), pa.array(left, pa.string())

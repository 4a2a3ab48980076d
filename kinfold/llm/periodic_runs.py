"""Periodic runs of words, by internal pattern matching on whole texts.

A run is a stretch of words with smallest period q, at least LEAST words and POWER periods long, that no
neighbouring word extends. A run holds, three periods before its end or earlier, a dyadic block (length L, a
power of two, at a multiple of L) with 2 L - 1 <= 3 q, and the block again q words on. So each block asks for its
occurrences among the L or fewer starts that are such a q ahead: the interval of suffixes that begin with it is
known from prefix doubling, and a wavelet tree over the suffix array gives the first occurrence from a place on
(range successor). Occurrences that close together are an arithmetic progression. Up to two are candidate periods
themselves; three or more mean that the block has the progression's difference d as its period, and then q is
the distance between the stretches of period d around the block and around its occurrence, measured from their
starts or from their ends. Candidates are extended both ways by the ranks of the doubling, which tell equal
blocks; each pass is one numpy operation over all blocks of a slice of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.winnowing import SPACES, bound
from kinfold.llm.words import Words, mix, slices, words_of

# Least words and least periods of a run. The choice of blocks rests on four periods or more.
LEAST, POWER = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class SuffixOrder:
    """Suffix array by prefix doubling, with the ranks of every doubling.

    `levels[k][i]` is the place of the first suffix that shares the 2^k words from i; equal ranks of two places mean
    equal words, as a block that leaves its text equals no other. Only places whose block occurs again are sorted
    anew. `names` tells words of different texts apart.
    """

    def __init__(self, names: np.ndarray, limit: np.ndarray):
        n = len(names)
        self.array = np.argsort(names)
        ordered = names[self.array]
        head = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.zeros(0, bool)
        rank = np.empty(n, np.int32)
        rank[self.array] = self._first(head)
        self.levels, self.counts = [rank], [self._sizes(head)]
        while (slots := np.flatnonzero(self.counts[-1] > 1)).size:
            size = 1 << (len(self.levels) - 1)
            at = self.array[slots]
            ahead = at + size
            inside = ahead < limit[at]
            second = np.where(inside, rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
            key = rank[at].astype(np.int64) * (n + 1) + second
            order = np.argsort(key)
            at, key = at[order], key[order]
            self.array[slots] = at
            changed = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            rank[at] = slots[np.maximum.accumulate(np.where(changed, np.arange(len(slots)), 0))]
            head = head.copy()
            head[slots] = changed
            self.levels.append(rank)
            self.counts.append(self._sizes(head))

    @staticmethod
    def _first(head):
        return np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))

    @staticmethod
    def _sizes(head):
        starts = np.flatnonzero(head)
        sizes = np.diff(np.r_[starts, len(head)])
        return np.repeat(sizes, sizes)

    def interval(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the suffix array of all suffixes that begin with the block of 2^level words."""
        low = self.levels[level][at].astype(np.int64)
        return low, low + self.counts[level][low]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from a and from b on (a <> b)."""
        return self._equal(a, b, 1)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words before a and before b."""
        return self._equal(a, b, -1)

    def _equal(self, a, b, way):
        n, done = len(self.array), np.zeros(len(a), np.int64)
        # The last level has no equal pair, so every level below is passed once at most.
        for level in range(len(self.levels) - 1, -1, -1):
            size, rank = 1 << level, self.levels[level]
            x, y = (a + done, b + done) if way > 0 else (a - done - size, b - done - size)
            fits = (x >= 0) & (y >= 0) & (x < n) & (y < n)
            same = fits & (rank[np.clip(x, 0, n - 1)] == rank[np.clip(y, 0, n - 1)])
            done += np.where(same, size, 0)
        return done


class WaveletTree:
    """Numbers below `bound` in an order, with zeros counted by bit from the highest; levels keep stable halves."""

    def __init__(self, values: np.ndarray, bound: int):
        self.size, self.bits = len(values), max(int(bound - 1).bit_length(), 1)
        self.zeros, now = [], values
        for bit in range(self.bits - 1, -1, -1):
            one = (now >> bit) & 1 == 1
            self.zeros.append(np.r_[0, np.cumsum(~one)])
            now = np.r_[now[~one], now[one]]

    def _down(self, level, one, low, high):
        zeros = self.zeros[level]
        zl, zh = zeros[low], zeros[high]
        right = zeros[-1]
        return np.where(one, right + low - zl, zl), np.where(one, right + high - zh, zh), zh - zl

    def below(self, low, high, x):
        """How many numbers of the places [low, high) are below x."""
        found = np.zeros(len(low), np.int64)
        all_of = high - low
        for level in range(self.bits):
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            low, high, zeros = self._down(level, one, low, high)
            found += np.where(one, zeros, 0)
        return np.where(x >= 1 << self.bits, all_of, found)

    def smallest(self, low, high, k):
        """The number of rank k, from 0, among the places [low, high)."""
        found = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            zeros = self.zeros[level][high] - self.zeros[level][low]
            one = k >= zeros
            k = np.where(one, k - zeros, k)
            low, high, _ = self._down(level, one, low, high)
            found = found * 2 + one
        return found

    def successor(self, low, high, x):
        """(smallest number from x on among the places [low, high), whether there is one)."""
        k = self.below(low, high, x)
        there = k < high - low
        return self.smallest(low, high, np.where(there, k, 0)), there


def periods_for(size: int) -> tuple[int, int]:
    """Smallest and largest period that the blocks of `size` words ask for."""
    return (2 * size + 1) // 3, (4 * size + 1) // 3 - 1


def _candidates(order: SuffixOrder):
    """(place, period): every run has a place in its first three periods with its period among these."""
    if len(order.levels) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Only suffixes whose first two words occur again are in the tree, their places counted among themselves.
    again = order.counts[1] > 1
    slots = np.r_[0, np.cumsum(again)]
    kept = np.zeros(len(order.array), bool)
    kept[order.array[again]] = True
    number = np.r_[0, np.cumsum(kept)]
    places = np.flatnonzero(kept)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tree = WaveletTree(number[order.array[again]], len(places))

    def following(low, high, x):
        found, there = tree.successor(low, high, number[np.minimum(x, len(kept))])
        return places[found], there

    found = []
    for level in range(1, len(order.levels)):
        size = 1 << level
        least, most = periods_for(size)
        at = np.arange(0, len(order.array), size)
        at = at[order.counts[level][order.levels[level][at]] > 1]
        if not len(at):
            continue
        low, high = order.interval(level, at)
        low, high = slots[low], slots[high]
        first, there = following(low, high, at + least)
        there &= first <= at + most
        at, low, high, first = at[there], low[there], high[there], first[there]
        found.append((at, first - at))
        second, there = following(low, high, first + 1)
        there &= second <= at + most
        at, first, second = at[there], first[there], second[there]
        found.append((at, second - at))
        step = second - first
        third = second + step
        rank = order.levels[level]
        there = third <= at + most
        there[there] = rank[np.minimum(third[there], len(rank) - 1)] == rank[at[there]]
        at, first, step = at[there], first[there], step[there]
        starts = (first - order.behind(first, first + step)) - (at - order.behind(at, at + step))
        ends = (first + order.ahead(first, first + step)) - (at + order.ahead(at, at + step))
        found += [(at, starts), (at, ends)]
    place, period = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    good = period > 0
    return place[good], period[good]


def runs_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, period) of every run, over the words of all texts, by start, then period."""
    n = len(words.doc)
    ends = np.cumsum(words.per_doc())
    order = SuffixOrder(words.hashes() ^ mix(words.doc.astype(np.uint64) + np.uint64(1)), ends[words.doc])
    at, period = _candidates(order)
    inside = at + period < n
    at, period = at[inside], period[inside]
    start = at - order.behind(at, at + period)
    end = at + period + order.ahead(at, at + period)
    good = end - start >= np.maximum(LEAST, POWER * period)
    start, end, period = start[good], end[good], period[good]
    # A multiple of the smallest period has the same stretch, which comes first with the smallest.
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    start, end, doc = words.start[keep], words.end[keep], words.doc[keep]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    # A word brings the byte before it, which becomes the space, but for the first of a text.
    start = start - ~first
    to = np.r_[0, np.cumsum(end - start)]
    out = words.data[np.repeat(start - to[:-1], end - start) + np.arange(to[-1])]
    out[to[:-1][~first]] = 0x20
    offsets = to[np.searchsorted(doc, np.arange(words.docs + 1))]
    whole = pa.LargeStringArray.from_buffers(words.docs, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    return whole.cast(pa.string())


def _of_texts(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(runs, collapsed text) of each text."""
    words = words_of(texts, lower=False)
    start, end, period = runs_of(words)
    inner = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(inner, start + period, 1)
    np.add.at(inner, end, -1)
    n = words.per_doc()
    doc = words.doc[start]
    offsets = np.searchsorted(doc, np.arange(words.docs + 1)).astype(np.int32)
    structs = pa.StructArray.from_arrays(
        [pa.array(start - (np.cumsum(n) - n)[doc]), pa.array(end - start), pa.array(period)], ["start", "length", "period"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets), structs), _joined(words, np.cumsum(inner)[:-1] == 0)


def _task(batches):
    for batch in batches:
        for first, texts in slices(batch.column("text")):
            runs, collapsed = _of_texts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, len(texts)), runs, collapsed], names=["doc_id", "runs", "collapsed"]
            )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, runs (first word, words, smallest period; by start, then period), collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`, compared by 64-bit hashes of their bytes. `collapsed` joins by one space the words
    that no run contains after its first period. Runs may overlap; each is listed. Null and empty texts and texts
    without words have no runs and collapse to an empty text. Null and repeated ids keep a row each. Texts are worked
    on in slices of some megabytes, a longer text whole. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_task, f"doc_id long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the most periods by its exact length / period; of equal ones the one of smallest start, then period.
    Null without runs."""

    def better(best, run):
        # Runs come by start, then period, so that the first of equal ones stays.
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.reduce(runs, F.lit(None).cast(RUNS[6:-1]), better)


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, where about every tenth text has its words from a place on replaced by repeats of its words there.

    With h = crc32 of the id as text and g = h div 10, a text of n > 0 words with h % 10 = 0 has word
    a + (i - a) % p in place of each word i >= a = g % n, where p = 1 + (n - a) div (3 + g % 8); its words are then
    joined by one space. Rows with a null id and texts without words stay as they are, as do all other columns.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))

    def repeated(s):
        turn = F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int"))))
        return F.array_join(turn, " ")

    def placed(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        return bound(F.struct(w.alias("w"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8)).cast("long")).alias("p")), repeated)

    text = F.col(text_col).cast("string")
    words = F.filter(F.split(text, SPACES, -1), lambda w: w != "")
    changed = bound(words, lambda w: F.when(F.size(w) > 0, placed(w)).otherwise(text))
    return docs.withColumn(text_col, F.when(h % 10 == 0, changed).otherwise(text))

"""Byte-level BPE: a minimal acyclic transducer of frequent words, and exact merges for all others.

A first pass finds frequent pieces in all texts. They are compiled, with their ids as outputs, into an
automaton that shares equal suffixes: a word's number is the count of words before it, added up along
its path, and names its ids. The automaton is a file that every executor maps into memory. Encoding cuts
texts into pieces, walks the automaton with all new pieces of a slice at once, and merges what it does
not hold by the vocabulary's ranks. The result does not depend on which words are in the automaton.
"""

from __future__ import annotations

import heapq
import io
import json
import os

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.words import slices, span_hashes, text_bytes
from kinfold.sources.workspace import scratch_path

# Words the automaton holds, and the part of a task's pieces from which a piece is reported as frequent.
LEXICON = 32_768
FREQUENT = 1 / (1 << 17)
# Pieces whose ids a task remembers.
REMEMBERED = 200_000
# Bytes of text that one pass holds.
PASS = 1 << 20
# Pieces longer than this are merged with a queue.
LONG = 256

# Character classes, white space of the splitting pattern, contractions.
LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 4
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary's strings, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            content = json.load(f)
        letters = byte_letters()
        ids = content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for text, i in ids.items():
            tokens[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            tokens[i] = text.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_ids[b] = ids[c]
        pairs = []
        for pair in content["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs.append((ids[a], ids[b], ids[a + b]))
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        # Pairs as numbers in order, with the rank and the merged id of each.
        order = np.argsort((left << 32) | right)
        self.pairs, self.ranks, self.made = ((left << 32) | right)[order], order, made[order]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.content = np.frombuffer(b"".join(tokens), np.uint8)


    @classmethod
    def of(cls, fields: dict):
        """From the fields of another one, as a broadcast brings them."""
        made = cls.__new__(cls)
        vars(made).update(fields)
        return made


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the spans, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(total)


NO_RANK = 1 << 40


def _ranks(vocabulary, left, right):
    """Place in `pairs` of each pair of ids, and its rank."""
    key = (left << 32) | right
    at = np.minimum(np.searchsorted(vocabulary.pairs, key), len(vocabulary.pairs) - 1)
    return at, np.where(vocabulary.pairs[at] == key, vocabulary.ranks[at], NO_RANK)


def merge_short(vocabulary, ids: np.ndarray, lengths: np.ndarray):
    """Merge many pieces at once, the lowest rank of each piece per round; (ids, lengths).

    All places of the lowest pair are merged from the left in one round: a merge never makes a pair of lower rank.
    """
    done_ids, done_of = [], []
    piece = np.repeat(np.arange(len(lengths)), lengths)
    made, rank = _next_merge(vocabulary, ids, piece, np.arange(len(ids)))
    while len(ids):
        head = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
        size = np.diff(np.r_[head, len(ids)])
        least = np.minimum.reduceat(rank, head)
        closed = np.repeat(least == NO_RANK, size)
        done_ids.append(ids[closed])
        done_of.append(piece[closed])
        place = np.flatnonzero((rank == np.repeat(least, size)) & (rank < NO_RANK))
        if not len(place):
            break
        # Of overlapping pairs take every second one, from the left.
        fresh = np.r_[True, np.diff(place) > 1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
        place = place[(np.arange(len(place)) - first) % 2 == 0]
        ids[place] = made[place]
        stay = ~closed
        stay[place + 1] = False
        # Only pairs with a merged id are looked up again.
        again = (np.cumsum(stay) - 1)[place]
        ids, piece, made, rank = ids[stay], piece[stay], made[stay], rank[stay]
        again = np.r_[again, np.maximum(again - 1, 0)]
        made[again], rank[again] = _next_merge(vocabulary, ids, piece, again)
    flat, of = np.concatenate(done_ids or [ids]), np.concatenate(done_of or [piece])
    return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(lengths))


def _next_merge(vocabulary, ids, piece, at):
    """What the pairs that begin at these places merge to, and their ranks."""
    after = np.minimum(at + 1, max(0, len(ids) - 1))
    key = (ids[at] << 32) | ids[after]
    found = np.minimum(np.searchsorted(vocabulary.pairs, key), len(vocabulary.pairs) - 1)
    fits = (vocabulary.pairs[found] == key) & (piece[at] == piece[after]) & (after > at)
    return vocabulary.made[found], np.where(fits, vocabulary.ranks[found], NO_RANK)


def merge_long(vocabulary, ids: np.ndarray) -> np.ndarray:
    """Merge one piece with a queue of (rank, place)."""
    ids = ids.tolist()
    after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]

    def pair(i):
        j = after[i]
        if j < 0:
            return None
        at, rank = _ranks(vocabulary, np.array([ids[i]]), np.array([ids[j]]))
        return None if rank[0] == NO_RANK else (int(rank[0]), i, ids[i], ids[j], int(vocabulary.made[at[0]]))

    at, rank = _ranks(vocabulary, np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
    queue = [(int(r), i, ids[i], ids[i + 1], int(vocabulary.made[a])) for i, (r, a) in enumerate(zip(rank, at)) if r < NO_RANK]
    heapq.heapify(queue)
    while queue:
        _, i, x, y, made = heapq.heappop(queue)
        j = after[i]
        if j < 0 or ids[i] != x or ids[j] != y:
            continue
        ids[i], ids[j] = made, -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (new := pair(k)):
                heapq.heappush(queue, new)
    return np.array([i for i in ids if i >= 0], np.int64)


def merge(vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(ids, lengths) of spans of bytes, each a piece."""
    lengths = end - start
    short = lengths <= LONG
    ids, sizes = merge_short(vocabulary, vocabulary.byte_ids[data[ragged(start[short], lengths[short])]], lengths[short])
    if short.all():
        return ids, sizes
    parts = iter(np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [])
    found = [next(parts) if s else merge_long(vocabulary, vocabulary.byte_ids[data[a:b]]) for s, a, b in zip(short, start, end)]
    return np.concatenate(found), np.array([len(x) for x in found])


class Pieces:
    """Splits texts as the byte-level pattern does:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    Letters and numbers are what the tokenizer library takes for them; each new character is asked for once.
    """

    def __init__(self, special):
        self.kind = np.zeros(0x110000, np.uint8)
        self.kind[WHITE_SPACE] = WHITE
        self.special = list(special)

    def _ask(self, points):
        from tokenizers.pre_tokenizers import ByteLevel

        split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for c in points.tolist():
            joins = [len(split(before + chr(c))) == 1 for before in "a1"]
            self.kind[c] = LETTER if joins[0] else NUMBER if joins[1] else OTHER

    def split(self, texts: pa.Array):
        """(bytes, start, end, text) of the pieces of a large_string array without nulls."""
        data, offsets = text_bytes(texts)
        lead = (data & 0xC0) != 0x80
        place = np.flatnonzero(lead)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        if (kind == 0).any():
            self._ask(np.unique(points[kind == 0]))
            kind = self.kind[points]
        n = len(points)
        # Texts, and special tokens in them, begin and end pieces.
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(place, offsets)] = True
        spans = self._special(data, offsets)
        edge[np.searchsorted(place, spans.ravel())] = True
        if n == 0:
            return data, place, place, place
        start = edge[:-1].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last of some white space goes with what follows if it is a space, and stands alone otherwise.
        last = np.zeros(n, bool)
        last[:-1] = (kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~edge[1:-1]
        start |= last
        joined = np.flatnonzero(last & (points == 32)) + 1
        start[joined] = False
        self._contractions(points, kind, edge, start)
        inside = np.zeros(n + 1, bool)
        at = np.searchsorted(place, spans)
        for a, b in at:
            inside[a + 1:b] = True
        start &= ~inside[:-1]
        first = place[np.flatnonzero(start)]
        end = np.r_[first[1:], len(data)]
        return data, first, end, np.searchsorted(offsets, first, "right") - 1

    def _special(self, data, offsets):
        raw, found = data.tobytes(), []
        for content in self.special:
            key = content.encode()
            at = raw.find(key)
            while at >= 0:
                k = np.searchsorted(offsets, at, "right")
                if at + len(key) <= offsets[k]:
                    found.append((at, at + len(key)))
                    at = raw.find(key, at + len(key))
                else:
                    at = raw.find(key, at + 1)
        return np.array(found, np.int64).reshape(-1, 2)

    @staticmethod
    def _contractions(points, kind, edge, start):
        """An apostrophe that begins a piece takes the letters of a contraction; the next piece begins after them."""
        n = len(points)
        for i in np.flatnonzero((points == 39) & start).tolist():
            for letters in CONTRACTIONS:
                j = i + 1 + len(letters)
                if j <= n and not edge[i + 1:j].any() and all(points[i + 1 + k] == ord(c) for k, c in enumerate(letters)):
                    start[i + 1:j] = False
                    if j < n:
                        start[j] |= kind[j] != WHITE
                    break


class Transducer:
    """Minimal acyclic automaton of sorted words; each edge knows how many words come before those behind it."""

    @staticmethod
    def build(words: list[bytes]) -> dict[str, np.ndarray]:
        """Arrays `key` (state * 256 + byte, in order), `target`, `skip`, `final`; state 0 is the start."""
        register, states = {}, []

        def settle(node):
            """The state with these edges and finality, made once."""
            form = (node[0], tuple(node[1]))
            found = register.get(form)
            if found is None:
                found = register[form] = len(states)
                states.append((form, int(node[0]) + sum(states[t][1] for _, t in node[1])))
            return found

        path, before = [[False, []]], b""
        for word in words:
            same = len(os.path.commonprefix([word, before]))
            while len(path) > same + 1:
                node = path.pop()
                path[-1][1].append((before[len(path) - 1], settle(node)))
            path.extend([False, []] for _ in word[same:])
            path[-1][0] = True
            before = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(node)))
        top = settle(path[0])
        number = lambda s: 0 if s == top else s + 1
        edges, final = [], np.zeros(len(states) + 1, bool)
        for s, ((ends, targets), _) in enumerate(states):
            final[number(s)] = ends
            skip = int(ends)
            for byte, t in targets:
                edges.append((number(s) * 256 + byte, number(t), skip))
                skip += states[t][1]
        key, target, skip = np.array(sorted(edges), np.int64).reshape(-1, 3).T
        return {"key": key, "target": target, "skip": skip, "final": final}

    def __init__(self, arrays):
        self.key, self.target, self.skip, self.final = (arrays[k] for k in ("key", "target", "skip", "final"))

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place among the sorted words of each span of bytes, -1 for spans that are no word."""
        found = np.full(len(start), -1, np.int64)
        who, state, total, at = np.arange(len(start)), np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), start.copy()
        while len(who):
            over = at == end[who]
            ends = over & (self.final[state] > 0)
            found[who[ends]] = total[ends]
            who, state, total, at = who[~over], state[~over], total[~over], at[~over]
            if not len(who) or not len(self.key):
                break
            want = state * 256 + data[at]
            edge = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            goes = self.key[edge] == want
            who, edge, at = who[goes], edge[goes], at[goes] + 1
            state, total = self.target[edge], total[goes] + self.skip[edge]
        return found


PARTS = ("key", "target", "skip", "final", "starts", "ids")


class Lexicon:
    """The automaton and the ids of its words, as a file that every executor gets and maps into memory."""

    def __init__(self, spark, vocabulary: Vocabulary, words: list[bytes]):
        words = sorted(set(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words]).astype(np.int64)
        start = np.r_[0, end[:-1]].astype(np.int64)[:len(words)]
        ids, lengths = merge(vocabulary, data, start, end) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        arrays = Transducer.build(words) | {"starts": np.r_[0, np.cumsum(lengths)], "ids": ids}
        sizes = [len(arrays[p]) for p in PARTS]
        file = io.BytesIO()
        np.save(file, np.concatenate([sizes, *[arrays[p] for p in PARTS]]).astype(np.int32))
        path = scratch_path(spark, "lexicon") + ".npy"
        write_bytes(spark, path, file.getvalue())
        spark.sparkContext.addFile(path)
        self.name = path.rsplit("/", 1)[1]

    def open(self):
        """(transducer, starts, ids) in a task."""
        held = np.load(SparkFiles.get(self.name), mmap_mode="r")
        cuts = np.cumsum(held[:len(PARTS)]) + len(PARTS)
        arrays = dict(zip(PARTS, np.split(held, [len(PARTS), *cuts])[1:]))
        return Transducer(arrays), arrays["starts"], arrays["ids"]


def write_bytes(spark, path: str, content: bytes) -> None:
    """A small file in a folder of any store that Spark can write to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(content)
    finally:
        out.close()


class Encoder:
    """Ids of the pieces of texts; remembers those of pieces seen before, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, opened):
        self.vocabulary, (self.transducer, self.starts, self.ids) = vocabulary, opened
        self.pieces = Pieces(vocabulary.special)
        self._forget()

    def _forget(self):
        self.known, self.flat, self.sizes, self.flat_size = {}, [], [], 0

    def encode(self, texts: pa.Array):
        """(ids, offsets) of a large_string array without nulls."""
        data, start, end, text = self.pieces.split(texts)
        hashes, first, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        slots = np.array([self.known.get(h, -1) for h in hashes.tolist()], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self._learn(data, start[first[new]], end[first[new]], hashes[new])
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        flat = np.concatenate(self.flat) if self.flat else np.zeros(0, np.int64)
        self.sizes, self.flat = [sizes], [flat]
        begins = np.r_[0, np.cumsum(sizes)[:-1]] if len(sizes) else sizes
        piece = slots[which]
        ids = flat[ragged(begins[piece], sizes[piece])]
        per_text = np.bincount(text, sizes[piece], len(texts)).astype(np.int64)
        return ids, np.r_[0, np.cumsum(per_text)]

    def _learn(self, data, start, end, hashes):
        number = self.transducer.numbers(data, start, end)
        held = number >= 0
        out, sizes = [None] * len(start), np.zeros(len(start), np.int64)
        begin, stop = self.starts[number[held]], self.starts[number[held] + 1]
        sizes[held] = stop - begin
        from_lexicon = self.ids[ragged(begin, stop - begin)]
        merged, merged_sizes = merge(self.vocabulary, data, start[~held], end[~held])
        sizes[~held] = merged_sizes
        for content, i in self.vocabulary.special.items():
            key = np.frombuffer(content.encode(), np.uint8)
            for k in np.flatnonzero(end - start == len(key)).tolist():
                if np.array_equal(data[start[k]:end[k]], key):
                    out[k] = i
        both = np.concatenate([from_lexicon, merged])
        order = np.r_[np.flatnonzero(held), np.flatnonzero(~held)]
        begins = np.zeros(len(start), np.int64)
        begins[order] = np.r_[0, np.cumsum(sizes[order])[:-1]]
        flat = both[ragged(begins, sizes)]
        special = [(k, i) for k, i in enumerate(out) if i is not None]
        if special:
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for k, i in special:
                parts[k], sizes[k] = np.array([i], np.int64), 1
            flat = np.concatenate(parts)
        slots = np.arange(len(start)) + len(self.known)
        self.known.update(zip(hashes.tolist(), slots.tolist()))
        self.flat.append(flat)
        self.sizes.append(sizes)
        return slots


def frequent_words(docs: DataFrame, special=(), text_col: str = "text", size: int = LEXICON) -> list[bytes]:
    """The most frequent pieces of all texts, at most `size`; only speed depends on them.

    A task reports pieces that are at least one in 2^17 of its own, so at most that many.
    """

    def task(batches):
        pieces, counts, total = Pieces(special), {}, 0
        for batch in batches:
            for _, texts in slices(batch.column("text"), PASS):
                data, start, end, _ = pieces.split(texts)
                hashes, first, times = np.unique(span_hashes(data, start, end), return_index=True, return_counts=True)
                total += len(start)
                raw = data.tobytes()
                # What is rare in a slice of this size is not counted on: it cannot be frequent by much.
                for k in np.flatnonzero(times > 1).tolist():
                    key = raw[start[first[k]]:end[first[k]]]
                    counts[key] = counts.get(key, 0) + int(times[k])
                if len(counts) > 2 * REMEMBERED:
                    counts = {k: c for k, c in counts.items() if c >= total * FREQUENT}
        rows = [(k, c) for k, c in counts.items() if c >= total * FREQUENT]
        for a in range(0, len(rows), 10_000):
            words, times = zip(*rows[a:a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(task, "word binary, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [bytes(r["word"]) for r in top.collect()]


def encode(docs: DataFrame, tokenizer_file: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """`docs` with a column of token ids (little-endian unsigned 32-bit integers) in place of the text.

    As the tokenizers library encodes with the file, add_special_tokens=False, no truncation or padding. Null texts
    count as empty and give no ids. Rows are independent; an empty table gives an empty result.
    """
    spark, docs = docs.sparkSession, docs.drop(into)
    vocabulary = Vocabulary(tokenizer_file)
    lexicon = Lexicon(spark, vocabulary, frequent_words(docs, list(vocabulary.special), text_col))
    held = spark.sparkContext.broadcast(vars(vocabulary))

    def task(batches):
        encoder = Encoder(Vocabulary.of(held.value), lexicon.open())
        for batch in batches:
            others = batch.select([c for c in batch.schema.names if c != text_col])
            for first, texts in slices(batch.column(text_col), PASS):
                ids, offsets = encoder.encode(texts)
                packed = pa.Array.from_buffers(
                    pa.binary(), len(texts), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]
                )
                part = others.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, packed], names=[*part.schema.names, into])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col], f"`{into}` binary"])
    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(task, schema)


def decode(encoded: DataFrame, tokenizer_file: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """`encoded` with the texts of its ids; special tokens are kept, bytes that are no UTF-8 become U+FFFD.

    Rows keep their other columns, but for one named `into`; no ids and null give an empty text, repeated rows decode
    alike. An empty table gives an empty result.
    """
    encoded = encoded.drop(into)
    held = encoded.sparkSession.sparkContext.broadcast(vars(Vocabulary(tokenizer_file)))

    def task(batches):
        vocabulary = Vocabulary.of(held.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows, texts = batch.slice(first, 500), []
                for value in rows.column(ids_col):
                    ids = np.frombuffer(value.as_py() or b"", "<u4").astype(np.int64)
                    content = vocabulary.content[ragged(vocabulary.starts[ids], vocabulary.lengths[ids])]
                    texts.append(content.tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, into])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema], f"`{into}` string"])
    return encoded.mapInArrow(task, schema)

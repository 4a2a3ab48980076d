"""Language-model scores: causal self-attention over subword ids, trained in numpy, beside counts of all words.

Training texts give the counts of all their words, summed in each task before they are sent. One bucket of words is counted
in one place; there the words' subword ids are made and counted too. A small attention model is trained on all ids of the training texts, in consecutive windows, each once whatever their number: windows are dealt out to copies
of the model, which tasks train on a part of them a round; weights and step sizes are averaged after each.

The model predicts the group of the next subword id's class, then the class in it. Groups hold ids that begin a word or
ids that do not: frequent ids are classes of their own, others share a few, where ids follow their counts. Texts are cut into blocks of STRIDE ids; a window of two blocks scores the second, so windows
overlap and each id is scored once, from the ids before it only. A word's probability is that of its first id's class,
given that a word begins, times a mixture: its share of the training words of that class, and its spelling by the
attention model up to the next beginning. These add up to one at most. Counts of frequent words are broadcast; the others
go to their counts by word after scoring and come back as sums by row, so texts are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.bpe import Vocabulary, merge, ragged
from kinfold.llm.pairs import bucket_of, buckets_for, runs, text_volume
from kinfold.llm.words import mix, slices, words_of
from kinfold.sources.workspace import materialise, parallelism, scratch

FOLDS, HELD_FOLD = 7, 2
# So many words at most, the most frequent, have their counts and ids broadcast; the result is the same at any limit.
LEXICON = 1 << 19
# Least part of the mixture for shares and for spelling.
LEAST_PART = 0.02
# Ids with an embedding of their own, and embeddings the others share.
OWN_IDS, SHARED_IDS = 1024, 64
# Classes: the most frequent ids alone, the others in groups, for ids that begin a word and for the rest.
ALONE, GROUPS = 112, 16
WIDTH, STRIDE = 16, 16
# Targets of a training window.
WINDOW = 2 * STRIDE
# Windows of a copy, which come in as many parts as there are rounds; copies of a task; windows a task holds before it sends them.
COPY_WINDOWS, ROUNDS, BATCH, RATE = 16384, 4, 64, 0.2
TASK_COPIES = 16
SEND_WINDOWS = 1 << 16
BYTES_PER_PAIR = 10
# Words that a task gathers before it sends their counts.
SEND_WORDS = 2_000_000
REMEMBERED = 200_000
# Bytes of text that are scored at once.
PASS = 1 << 20
# Places of special inputs before the embeddings of ids: beginning of a text, nothing.
BEGIN, NOTHING = 0, 1
MOST_LOGIT = 80.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD


# ---------------------------------------------------------------- counts

TALLY = "bucket int, counts binary, spelling binary"


def first_places(which: np.ndarray, kinds: int) -> np.ndarray:
    """The first place of each code 0 to kinds - 1, each of which occurs."""
    out = np.empty(kinds, np.int64)
    out[which[::-1]] = np.arange(len(which))[::-1]
    return out


def spelled_out(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the spans, each with a space after it; where each begins and the last ends)."""
    cuts = np.r_[0, np.cumsum(length + 1)]
    out = np.full(cuts[-1], 32, np.uint8)
    out[ragged(cuts[:-1], length)] = data[ragged(start, length)]
    return out, cuts


def _tally(buckets: int):
    """Words of a task's texts with their counts and spelling, each once between two sendings, by the word's bucket."""

    def task(batches):
        held, waiting = [], 0

        def packed():
            hashes, counts, length, data = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(hashes, kind="stable")
            head = runs(hashes[order])
            total = np.add.reduceat(counts[order], head).astype(np.uint32)
            one = order[head]
            bucket = bucket_of(hashes[one], buckets)
            out, place = spelled_out(data, (np.cumsum(length) - length)[one], length[one])
            cuts = runs(bucket)
            ends = np.r_[cuts[1:], len(bucket)]
            return pa.RecordBatch.from_arrays([
                pa.array(bucket[cuts], pa.int32()), pa.array([total[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                pa.array([out[place[a]:place[b]].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            ], names=["bucket", "counts", "spelling"])

        for batch in batches:
            for _, texts in slices(batch.column("text")):
                words = words_of(texts)
                which, distinct = pd.factorize(words.hashes())
                at = first_places(which, len(distinct))
                length = words.end[at] - words.start[at]
                held.append((distinct, np.bincount(which, minlength=len(distinct)), length, words.data[ragged(words.start[at], length)]))
                waiting += len(distinct)
                if waiting >= SEND_WORDS:
                    yield packed()
                    held, waiting = [], 0
        if waiting:
            yield packed()

    return task


STATS = "kind string, key long, n long, words binary, counts binary, sizes binary, ids binary"


def _count(held):
    """From all tallies of a bucket: how many words there are and how often, counts of ids, and every word with its count
    and ids, by hash."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        vocabulary = Vocabulary.of(held.value)
        spelled = words_of(pa.array([b"".join(rows["spelling"]).decode()], pa.large_string()), lower=False)
        hashes, counts = spelled.hashes(), np.frombuffer(b"".join(rows["counts"]), "u4").astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        head = runs(hashes[order])
        at, seen = order[head], np.add.reduceat(counts[order], head)
        ids, lengths = word_ids(vocabulary, spelled.data, spelled.start[at], spelled.end[at])
        out = [("all", 0, int(seen.sum())), ("distinct", 0, len(seen))]
        begin = ids[np.cumsum(lengths) - lengths]
        for kind, key, amount in (("id", ids, np.repeat(seen, lengths)), ("first", begin, seen), ("alone", begin, seen == 1)):
            per_id = np.bincount(key, amount).astype(np.int64)
            used = np.flatnonzero(per_id)
            out += [(kind, i, c) for i, c in zip(used.tolist(), per_id[used].tolist())]
        out += [("times", c, n) for c, n in zip(*(x.tolist() for x in np.unique(seen, return_counts=True)))]
        made = [(*x, None, None, None, None) for x in out]
        packed = (hashes[at].tobytes(), seen.tobytes(), lengths.astype(np.uint32).tobytes(), ids.astype(np.int32).tobytes())
        made.append(("words", int(rows["bucket"].iloc[0]), len(seen), *packed))
        return pd.DataFrame(made, columns=["kind", "key", "n", "words", "counts", "sizes", "ids"])

    return reduce


def least_count(times: pd.DataFrame) -> int:
    """The least count at which no more than LEXICON words occur as often; `times` (key, n) are n words with count key."""
    times = times.sort_values("key", ascending=False)
    fits = times["key"][times["n"].cumsum() <= LEXICON]
    return int(fits.min()) if len(fits) else int(times["key"].max() + 1) if len(times) else 1


def _frequent(least: int):
    """Of packed words those that occur `least` times, packed."""

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, counts, sizes, ids = (np.frombuffer(row[c], t) for c, t in (("words", "u8"), ("counts", "i8"), ("sizes", "u4"), ("ids", "i4")))
                use = counts >= least
                kept = (words[use], counts[use], sizes[use], ids[np.repeat(use, sizes)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["key"]], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in kept]], names=["key", "words", "counts", "sizes", "ids"]
                )

    return task


def _others(least: int):
    """Of packed words those that occur less often, a row each."""

    def task(batches):
        for batch in batches:
            for row in batch.select(["words", "counts"]).to_pylist():
                words, counts = np.frombuffer(row["words"], "i8"), np.frombuffer(row["counts"], "i8")
                use = counts < least
                yield pa.RecordBatch.from_arrays([pa.array(words[use]), pa.array(counts[use])], names=["word", "n"])

    return task


def word_ids(vocabulary, data, start, end):
    """(ids, lengths) of words, each a piece that a space begins."""
    length = end - start
    out = np.full(int((length + 1).sum()), 32, np.uint8)
    begin = np.r_[0, np.cumsum(length + 1)[:-1]] if len(length) else length
    out[ragged(begin + 1, length)] = data[ragged(start, length)]
    return merge(vocabulary, out, begin, begin + length + 1)


# ---------------------------------------------------------------- subword sequences

class Subwords:
    """Ids of words: those of a lexicon, and others remembered between slices up to a bound.

    A word has a slot; slots below `fixed` are the lexicon's places.
    """

    def __init__(self, vocabulary, lexicon: dict | None = None):
        self.vocabulary = vocabulary
        lexicon = lexicon or {"words": np.zeros(0, np.uint64), "sizes": np.zeros(0, np.int64), "ids": np.zeros(0, np.int32)}
        self.index, self.fixed = pd.Index(lexicon["words"]), len(lexicon["words"])
        self.base = lexicon["ids"], lexicon["sizes"].astype(np.int64)
        self._forget()

    def _forget(self):
        self.known, (self.ids, self.sizes) = {}, self.base
        self.begin = np.cumsum(self.sizes) - self.sizes

    def slots(self, words, hashes) -> np.ndarray:
        """The slot of each word, until the next call."""
        which, distinct = pd.factorize(hashes)
        if len(self.known) > REMEMBERED:
            self._forget()
        slots = self.index.get_indexer(distinct).astype(np.int64)
        beside = np.flatnonzero(slots < 0)
        slots[beside] = [self.known.get(h, -1) for h in distinct[beside].tolist()]
        new = beside[slots[beside] < 0]
        if len(new):
            at = first_places(which, len(distinct))[new]
            ids, sizes = word_ids(self.vocabulary, words.data, words.start[at], words.end[at])
            slots[new] = len(self.sizes) + np.arange(len(new))
            self.known.update(zip(distinct[new].tolist(), slots[new].tolist()))
            self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(sizes) - sizes]
            self.ids, self.sizes = np.r_[self.ids, ids.astype(np.int32)], np.r_[self.sizes, sizes]
        return slots[which]

    def take(self, slots: np.ndarray):
        """(ids, ids per word) of words by their slots, in order."""
        sizes = self.sizes[slots]
        return self.ids[ragged(self.begin[slots], sizes)], sizes

    def of(self, words, hashes):
        """(ids, ids per word) of all words in order."""
        return self.take(self.slots(words, hashes))


class Layout:
    """Input rows, classes and shares of ids, made from the counts of all training words.

    The end of a text is one more id, the first class of those that begin a word.
    """

    def __init__(self, id_counts: dict[int, int], ends: int, begins_word: np.ndarray):
        size = self.end = len(begins_word)
        count = np.ones(size + 1)
        for i, c in id_counts.items():
            count[i] += c
        count[size] += ends
        order = np.argsort(-count, kind="stable")
        place = np.empty(size + 1, np.int64)
        place[order] = np.arange(size + 1)
        self.row = np.where(place < OWN_IDS, place, OWN_IDS + np.arange(size + 1) % SHARED_IDS) + 2
        self.kind = np.zeros(size + 1, np.int64)
        order = order[order != size]
        for base, alone, members in ((1, ALONE - 1, order[begins_word[order]]), (FIRST_CLASSES, ALONE, order[~begins_word[order]])):
            self.kind[members] = base + np.where(
                np.arange(len(members)) < alone, np.arange(len(members)), alone + np.arange(len(members)) % GROUPS
            )
        total = np.bincount(self.kind, count, CLASSES)
        self.log_share = np.log(count / total[self.kind]).astype(np.float32)
        by_group = np.maximum(total, 0.5).reshape(TOPS, GROUP)
        group = by_group.sum(axis=1)
        self.bias = np.log(group / group.sum()), np.log(by_group / group[:, None])


FIRST_CLASSES = ALONE + GROUPS
CLASSES = 2 * FIRST_CLASSES
# Classes of a group; the groups of classes that begin a word come first.
GROUP = 16
TOPS = CLASSES // GROUP
FIRST_TOPS = FIRST_CLASSES // GROUP
ROWS = OWN_IDS + SHARED_IDS + 2
# The last input of `top` and `out` is always 1: their bias.
SHAPES = {
    "embed": (ROWS, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "last": (WIDTH, WIDTH),
    "near": (2 * STRIDE,), "top": (WIDTH + 1, TOPS), "out": (TOPS, WIDTH + 1, GROUP),
}


def _exp(z: np.ndarray) -> np.ndarray:
    """Exponentials in place, within the range of floats and of sums of a group's."""
    np.clip(z, -MOST_LOGIT, MOST_LOGIT, out=z)
    return np.exp(z, out=z)


class Attention:
    """One causal self-attention layer: what is attended to and the last input give the group of the next id's class,
    and the class in it.

    `seen` are sums of squared gradients, which set the step sizes of Adagrad.
    """

    def __init__(self, weights: dict[str, np.ndarray], seen: dict[str, np.ndarray] | None = None):
        self.w = weights
        self.seen = seen or {k: np.full(s, 1e-9, np.float32) for k, s in SHAPES.items()}

    @classmethod
    def start(cls, bias, seed: int = 5) -> Attention:
        rng = np.random.default_rng(seed)
        weights = {k: rng.normal(0, 0.3 / (1 if k == "embed" else np.sqrt(WIDTH)), s) for k, s in SHAPES.items()}
        weights["near"], (weights["top"][-1], weights["out"][:, -1]) = np.zeros(SHAPES["near"]), bias
        return cls({k: v.astype(np.float32) for k, v in weights.items()})

    def flat(self) -> np.ndarray:
        return np.concatenate([held[k].ravel() for held in (self.w, self.seen) for k in SHAPES]).astype(np.float64)

    @classmethod
    def shaped(cls, flat: np.ndarray) -> Attention:
        parts = np.split(flat.astype(np.float32), np.cumsum([np.prod(s) for s in [*SHAPES.values()] * 2])[:-1])
        shaped = [part.reshape(s) for part, s in zip(parts, [*SHAPES.values()] * 2)]
        return cls(dict(zip(SHAPES, shaped)), dict(zip(SHAPES, shaped[len(SHAPES):])))

    def _step(self, name: str, grad: np.ndarray, at=...) -> None:
        # Squares of smaller numbers would leave the range of normal floats.
        grad = grad.astype(np.float32)
        grad[np.abs(grad) < 1e-18] = 0
        seen = self.seen[name][at] + grad * grad
        self.seen[name][at] = seen
        grad *= np.float32(RATE if name == "embed" else RATE / 3)
        grad /= np.sqrt(seen, out=seen)
        self.w[name][at] -= grad

    def train(self, windows: np.ndarray, targets: np.ndarray, seed: int) -> None:
        """One pass of Adagrad over windows of input rows (n, WINDOW) and target classes, -1 where there is none."""
        w, rng = self.w, np.random.default_rng(seed)
        span = windows.shape[1]
        far = np.arange(span)[:, None] - np.arange(span)[None, :]
        causal, lag = far >= 0, np.maximum(far, 0)
        scale, ones = np.float32(1 / np.sqrt(WIDTH)), np.ones(GROUP, np.float32)
        order = rng.permutation(len(windows))
        for a in range(0, len(order), BATCH):
            x, y = windows[order[a:a + BATCH]], targets[order[a:a + BATCH]].ravel()
            rows = x.ravel()
            e = w["embed"][rows]
            into = np.hstack([w["query"] * scale, w["key"], w["value"], w["last"]])
            q, k, v, u = np.split((e @ into).reshape(*x.shape, 4 * WIDTH), 4, axis=2)
            p = np.matmul(q, k.transpose(0, 2, 1))
            np.exp(np.clip(p, -20, 20, out=p), out=p)
            p *= np.where(causal, np.exp(np.clip(w["near"][lag], -20, 20)), np.float32(0))
            padded = np.flatnonzero((x == NOTHING).any(axis=1))
            p[padded] *= (x[padded] != NOTHING)[:, None, :]
            p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-9)
            h = np.ones((len(rows), WIDTH + 1), np.float32)
            h[:, :WIDTH] = np.tanh(np.matmul(p, v) + u).reshape(-1, WIDTH)
            # Groups of classes, then the classes of each target's group; targets come by group.
            valid = np.flatnonzero(y >= 0)
            valid = valid[np.argsort(y[valid].astype(np.int16), kind="stable")]
            part = np.float32(1 / max(1, len(valid)))
            own, group, h_valid = y[valid] % GROUP, y[valid] // GROUP, h[valid]
            z = _exp(h_valid @ w["top"])
            z *= part / (z @ np.ones(TOPS, np.float32))[:, None]
            z[np.arange(len(z)), group] -= part
            grad = {"top": h_valid.T @ z, "out": np.zeros(SHAPES["out"], np.float32)}
            back = z @ w["top"][:WIDTH].T
            cuts = np.searchsorted(group, np.arange(TOPS + 1))
            held = [(g, slice(cuts[g], cuts[g + 1])) for g in np.flatnonzero(np.diff(cuts))]
            z, sums = np.empty((len(valid), GROUP), np.float32), np.empty(len(valid), np.float32)
            for g, here in held:
                np.matmul(h_valid[here], w["out"][g], out=z[here])
            z = _exp(z)
            for g, here in held:
                np.matmul(z[here], ones, out=sums[here])
            z *= (part / sums)[:, None]
            z[np.arange(len(z)), own] -= part
            for g, here in held:
                np.matmul(h_valid[here].T, z[here], out=grad["out"][g])
                back[here] += z[here] @ w["out"][g, :WIDTH].T
            dh = np.zeros((len(rows), WIDTH), np.float32)
            dh[valid] = back
            dh *= 1 - h[:, :WIDTH] * h[:, :WIDTH]
            d = dh.reshape(*x.shape, WIDTH)
            ds = np.matmul(d, v.transpose(0, 2, 1))
            ds -= (ds * p).sum(axis=2, keepdims=True)
            ds *= p
            grad["near"] = np.bincount(lag[causal], ds.sum(axis=0)[causal], span)
            through = np.empty((*x.shape, 4 * WIDTH), np.float32)
            dq, dk, dv, du = np.split(through, 4, axis=2)
            np.matmul(ds, k, out=dq)
            np.matmul(ds.transpose(0, 2, 1), q, out=dk)
            np.matmul(p.transpose(0, 2, 1), d, out=dv)
            du[...] = d
            through = through.reshape(-1, 4 * WIDTH)
            grad["query"], grad["key"], grad["value"], grad["last"] = np.split(e.T @ through, 4, axis=1)
            grad["query"] = grad["query"] * scale
            by_row = np.argsort(rows.astype(np.int16), kind="stable")
            head = runs(rows[by_row])
            embed = np.add.reduceat((through @ into.T)[by_row], head, axis=0)
            for name, g in grad.items():
                self._step(name, g)
            self._step("embed", embed, rows[by_row][head])

    def tables(self):
        """Query, key, value and last-input vectors of every input row, ready to look up."""
        e = self.w["embed"]
        q, k, v, u = (np.ascontiguousarray(e @ self.w[n], np.float32) for n in ("query", "key", "value", "last"))
        return q * np.float32(1 / np.sqrt(WIDTH)), k, v, u

    def log_classes(self, rows: np.ndarray, kinds: np.ndarray, chunk: int = 256):
        """(log of each target's class, log that a word begins) of padded blocks.

        `rows` has STRIDE inputs before the first block of each window: (blocks, 2 * STRIDE); `kinds` (blocks, STRIDE)
        are target classes. Query i of a block sees the window's inputs up to its own place.
        """
        q, k, v, u = self.tables()
        far = (np.arange(STRIDE)[:, None] + STRIDE) - np.arange(2 * STRIDE)[None, :]
        near = np.where(far >= 0, np.exp(np.clip(self.w["near"][np.clip(far, 0, 2 * STRIDE - 1)], -20, 20)), 0).astype(np.float32)
        all_and_first = np.stack([np.ones(TOPS), np.arange(TOPS) < FIRST_TOPS], axis=1).astype(np.float32)
        ones = np.ones(GROUP, np.float32)
        target, begins = np.empty(kinds.shape, np.float32), np.empty(kinds.shape, np.float32)
        for a in range(0, len(rows), chunk):
            x = rows[a:a + chunk]
            own = x[:, STRIDE:]
            p = np.matmul(q[own], k[x].transpose(0, 2, 1))
            np.exp(np.clip(p, -20, 20, out=p), out=p)
            p *= near
            padded = np.flatnonzero((x == NOTHING).any(axis=1))
            p[padded] *= (x[padded] != NOTHING)[:, None, :]
            h = np.ones((*own.shape, WIDTH + 1), np.float32)
            seen = np.matmul(p, v[x])
            seen /= np.maximum(p.sum(axis=2, keepdims=True), 1e-9)
            seen += u[own]
            np.tanh(seen, out=h[:, :, :WIDTH])
            h = h.reshape(-1, WIDTH + 1)
            y = kinds[a:a + chunk].ravel()
            z = _exp(h @ self.w["top"])
            sums = z @ all_and_first
            begins[a:a + chunk] = np.log(sums[:, 1] / sums[:, 0]).reshape(-1, STRIDE)
            chance = z[np.arange(len(y)), y // GROUP] / sums[:, 0]
            by_group = np.argsort(y.astype(np.int16), kind="stable")
            cuts = np.searchsorted(y[by_group] // GROUP, np.arange(TOPS + 1))
            h, own = h[by_group], y[by_group] % GROUP
            z, inside = np.empty((len(y), GROUP), np.float32), np.empty(len(y), np.float32)
            held = [(g, slice(cuts[g], cuts[g + 1])) for g in np.flatnonzero(np.diff(cuts))]
            for g, here in held:
                np.matmul(h[here], self.w["out"][g], out=z[here])
            z = _exp(z)
            for g, here in held:
                np.matmul(z[here], ones, out=inside[here])
            log = np.log(chance)
            log[by_group] += np.log(z[np.arange(len(y)), own] / inside)
            target[a:a + chunk] = log.reshape(-1, STRIDE)
        return target, begins


def sequences(layout: Layout, ids: np.ndarray, per_text: np.ndarray):
    """Padded inputs and targets of texts: (rows, kinds, shares, places).

    Each text's targets are its ids and the end; the input of a target is the id before it, first BEGIN. Texts take whole
    blocks, with a block of NOTHING before. `rows` are windows of two blocks; `places` are the targets' places in order.
    """
    targets = per_text + 1
    blocks = -(-targets // STRIDE)
    base = np.r_[0, np.cumsum((blocks + 1) * STRIDE)]
    inputs = np.full(base[-1], NOTHING, np.int32)
    inputs[base[:-1] + STRIDE] = BEGIN
    inputs[ragged(base[:-1] + STRIDE + 1, per_text)] = layout.row[ids]
    block_base = np.r_[0, np.cumsum(blocks * STRIDE)]
    places = ragged(block_base[:-1], targets)
    every = np.full(len(places), layout.end, np.int64)
    inner = np.ones(len(places), bool)
    inner[np.cumsum(targets) - 1] = False
    every[inner] = ids
    kinds = np.zeros(block_base[-1], np.int64)
    kinds[places] = layout.kind[every]
    first = ragged(base[:-1], blocks * STRIDE)[::STRIDE]
    rows = inputs[first[:, None] + np.arange(2 * STRIDE)[None, :]]
    return rows, kinds.reshape(-1, STRIDE), layout.log_share[every], places


class Model:
    """Layout, attention weights, and counts of frequent words and of all words by class; scores whole texts."""

    def __init__(self, fields: dict):
        vars(self).update(fields)

    def score(self, words, subwords: Subwords):
        """(log10 probability, base sum, known words) of each text, whatever its length, without the words beside the
        lexicon; and of each of those the text, hash, log of its share's part per count, and log of its spelling's part."""
        n, hashes = words.per_doc(), words.hashes()
        slots = subwords.slots(words, hashes)
        ids, per_word = subwords.take(slots)
        per_text = np.bincount(words.doc, per_word, words.docs).astype(np.int64)
        rows, kinds, shares, places = sequences(self.layout, ids, per_text)
        target, begins = Attention(self.weights).log_classes(rows, kinds)
        target, begins = target.ravel()[places].astype(np.float64), begins.ravel()[places].astype(np.float64)
        # Units are the words and each text's end, in order; `first` is the place of each unit's first id.
        units = n + 1
        sizes = np.ones(int(units.sum()), np.int64)
        is_word = np.ones(len(sizes), bool)
        is_word[np.cumsum(units) - 1] = False
        sizes[is_word] = per_word
        first = np.cumsum(sizes) - sizes
        log = target[first] - begins[first]
        spelled = target + shares
        spelled[first] = shares[first]
        spelling = np.add.reduceat(spelled, first)[is_word] + begins[np.r_[first[1:], 0]][is_word]
        kind = self.layout.kind[ids[np.cumsum(per_word) - per_word]]
        share, spelling = self.log_share[kind], self.log_rest[kind] + spelling
        frequent = slots < subwords.fixed
        counts = self.lexicon["counts"][slots[frequent]].astype(np.float64)
        mixed = np.zeros(len(slots))
        mixed[frequent] = np.logaddexp(share[frequent] + np.log(counts), spelling[frequent])
        log[is_word] += mixed
        base = np.bincount(words.doc[frequent], np.log10(counts + 1), words.docs)
        known = np.bincount(words.doc[frequent], minlength=words.docs)
        other = ~frequent
        score = np.add.reduceat(log, np.cumsum(units) - units) / np.log(10)
        return score, base, known, (words.doc[other], hashes[other], share[other], spelling[other])

    @staticmethod
    def fields(layout: Layout, weights, lexicon: dict, firsts: pd.DataFrame, once: pd.DataFrame) -> dict:
        """`lexicon` are the frequent words, `firsts` (key, n) the training words by first id, `once` those that occur once.
        The part of shares in a class is what words leave that would be unknown without their only occurrence."""
        totals, alone = (np.bincount(layout.kind[c["key"].to_numpy(np.int64)], c["n"].to_numpy(float), CLASSES) for c in (firsts, once))
        part = np.clip(1 - (alone + 0.5) / (totals + 1), LEAST_PART, 1 - LEAST_PART)
        return {
            "layout": vars(layout), "weights": weights, "lexicon": lexicon,
            "log_share": np.log(part / np.maximum(1.0, totals)), "log_rest": np.log1p(-part),
        }

    @classmethod
    def of(cls, fields: dict):
        """From fields as a broadcast brings them."""
        return cls({**fields, "layout": layout_of(fields["layout"])})


def layout_of(fields: dict) -> Layout:
    made = Layout.__new__(Layout)
    vars(made).update(fields)
    return made


# ---------------------------------------------------------------- training

def _codes(layout: Layout):
    """(type of a window's codes, input row of each code, class of each code). Beyond the ids and the end there are two
    codes: the beginning of a text and nothing."""
    kind = np.uint16 if layout.end + 3 <= 1 << 16 else np.int32
    return kind, np.r_[layout.row, BEGIN, NOTHING], np.r_[layout.kind, -1, -1]


def _windows(held, held_layout, copies: int, held_lexicon=None):
    """Training windows by copy: each text's ids and its end in order, each a target once. A window has the code before
    its first target, then its targets' codes."""

    def task(batches):
        subwords, layout = Subwords(Vocabulary.of(held.value), held_lexicon and held_lexicon.value), layout_of(held_layout.value)
        kind, begin, nothing = _codes(layout)[0], layout.end + 1, layout.end + 2
        found, copy, waiting = [], [], 0

        def packed():
            codes, of = np.concatenate(found), np.concatenate(copy)
            order = np.argsort(of, kind="stable")
            codes, of = codes[order], of[order]
            head = runs(of)
            rows = [codes[a:b].tobytes() for a, b in zip(head, np.r_[head[1:], len(of)])]
            return pa.RecordBatch.from_arrays([pa.array(of[head], pa.int64()), pa.array(rows, pa.binary())], names=["copy", "codes"])

        for batch in batches:
            seats = batch.column("seat").to_numpy(zero_copy_only=False).view(np.uint64)
            for first, texts in slices(batch.column("text"), PASS):
                words = words_of(texts)
                ids, per_word = subwords.of(words, words.hashes())
                per_text = np.bincount(words.doc, per_word, words.docs).astype(np.int64)
                windows = -(-(per_text + 1) // WINDOW)
                base = np.r_[0, np.cumsum(windows * WINDOW + 1)]
                flat = np.full(base[-1], nothing, kind)
                flat[base[:-1]] = begin
                flat[ragged(base[:-1] + 1, per_text)] = ids
                flat[base[:-1] + 1 + per_text] = layout.end
                of = np.repeat(np.arange(len(texts)), windows)
                turn = np.arange(len(of)) - np.searchsorted(of, of)
                draw = mix(mix(seats[first:first + len(texts)])[of] + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                found.append(flat[(base[:-1][of] + turn * WINDOW)[:, None] + np.arange(WINDOW + 1)])
                copy.append((draw % np.uint64(copies)).astype(np.int64))
                waiting += len(of)
                if waiting >= SEND_WINDOWS:
                    yield packed()
                    found, copy, waiting = [], [], 0
        if waiting:
            yield packed()

    return task


def _dealt(kind):
    """A copy's windows in one row, drawn into a part for each round; their order does not depend on how they came."""

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        codes = np.frombuffer(b"".join(rows["codes"]), kind).reshape(-1, WINDOW + 1)
        codes = codes[np.lexsort(codes.T[::-1])]
        order = np.random.default_rng(int(rows["copy"].iloc[0])).permutation(len(codes))
        return pd.DataFrame({f"part{k}": [codes[order[k::ROUNDS]].tobytes()] for k in range(ROUNDS)})

    return deal


def _train_copies(flat, held_layout, number: int):
    """The sum of trained copies, by their windows, of all copies a task reads."""

    def task(batches):
        kind, row, target = _codes(layout_of(held_layout.value))
        total, windows = 0.0, 0
        for batch in batches:
            for part in batch.column(0):
                codes = np.frombuffer(part.as_py(), kind).reshape(-1, WINDOW + 1)
                model = Attention.shaped(flat.value)
                model.train(row[codes[:, :-1]], target[codes[:, 1:]], number)
                total, windows = total + len(codes) * model.flat(), windows + len(codes)
        if windows:
            yield pa.RecordBatch.from_arrays([pa.array([windows], pa.int64()), pa.array([total], pa.list_(pa.float64()))], names=["n", "state"])

    return task


def train(copies: DataFrame, held_layout, bias) -> dict[str, np.ndarray]:
    """Weights averaged over copies, which are read in place each round, a part of their windows at a time."""
    context, model = copies.sparkSession.sparkContext, Attention.start(bias)
    for number in range(ROUNDS):
        flat = context.broadcast(model.flat())
        trained = copies.select(f"part{number}").mapInArrow(_train_copies(flat, held_layout, number), "n long, state array<double>")
        mean = trained.select("n", F.posexplode("state")).groupBy("pos").agg((F.sum("col") / F.sum("n")).alias("value")).toPandas()
        flat.destroy()
        if len(mean):
            model = Attention.shaped(mean.sort_values("pos")["value"].to_numpy())
    return model.w


# ---------------------------------------------------------------- scoring

def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, whole text, the text's hash, and whether the row is trained on."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("ref"), (~held_out(F.col(id_col))).alias("train"))


def lexicon_of(stats: DataFrame, least: int) -> dict:
    """words, counts, sizes, ids of the words that occur `least` times, by hash."""
    packed = stats.where("kind = 'words'").select("key", "words", "counts", "sizes", "ids")
    found = packed.mapInArrow(_frequent(least), "key long, words binary, counts binary, sizes binary, ids binary").toPandas().sort_values("key")
    return {c: np.frombuffer(b"".join(found[c]), t) for c, t in (("words", "u8"), ("counts", "i8"), ("sizes", "u4"), ("ids", "i4"))}


def learn(texts: DataFrame, tokenizer_file: str):
    """(model, counts of words beside its lexicon, words in training, distinct words, training rows) from rows of
    whole_texts."""
    spark = texts.sparkSession
    vocabulary = Vocabulary(tokenizer_file)
    fields = spark.sparkContext.broadcast(vars(vocabulary))
    training = texts.where("train")
    buckets = buckets_for(text_volume(texts) / BYTES_PER_PAIR)
    tally = training.select("text").mapInArrow(_tally(buckets), TALLY)
    stats = materialise(tally.groupBy("bucket").applyInPandas(_count(fields), STATS), "stats")
    kinds = stats.where("kind != 'words'").groupBy("kind", "key").agg(F.sum("n").alias("n")).toPandas()
    ids, firsts, once, times = (kinds[kinds["kind"] == k][["key", "n"]] for k in ("id", "first", "alone", "times"))
    words, distinct = (int(kinds["n"][kinds["kind"] == k].sum()) for k in ("all", "distinct"))
    rows = training.count()
    least = least_count(times)
    lexicon = lexicon_of(stats, least)
    begins = np.array([vocabulary.content[s] == 32 if n else False for s, n in zip(vocabulary.starts, vocabulary.lengths)])
    layout = Layout(dict(zip(ids["key"].tolist(), ids["n"].tolist())), rows, begins)
    held_layout, held_lexicon = spark.sparkContext.broadcast(vars(layout)), spark.sparkContext.broadcast(lexicon)
    # Rows of one text have seats of their own, so its copies are dealt out too.
    seated = training.select(F.xxhash64("ref", "doc_id").alias("seat"), "text")
    # At least as many windows as the texts can have; a copy has no more than COPY_WINDOWS but by chance.
    copies = max(1, -(-(int(ids["n"].sum()) // WINDOW + rows) // COPY_WINDOWS))
    windows = seated.mapInArrow(_windows(fields, held_layout, copies, held_lexicon), "copy long, codes binary")
    dealt = windows.repartition(max(2 * parallelism(spark), copies // TASK_COPIES), "copy").groupBy("copy").applyInPandas(
        _dealt(_codes(layout)[0]), ", ".join(f"part{k} binary" for k in range(ROUNDS))
    )
    with scratch(spark):  # the windows are of no use after training
        weights = train(materialise(dealt, "windows"), held_layout, layout.bias)
    others = stats.where("kind = 'words'").mapInArrow(_others(least), "word long, n long")
    return Model.fields(layout, weights, lexicon, firsts, once), others, words, distinct, rows


RARE = "array<struct<word: bigint, share: double, spelling: double>>"


def scored(texts: DataFrame, others: DataFrame, model: dict, tokenizer_file: str) -> DataFrame:
    """doc_id, n_words, score, base, n_known of every row of whole_texts; each whole.

    The words beside the lexicon go to their counts and back as sums by row; texts stay where they are read.
    """
    context = texts.sparkSession.sparkContext
    fields, held = context.broadcast(vars(Vocabulary(tokenizer_file))), context.broadcast(model)

    def task(batches):
        scorer = Model.of(held.value)
        subwords = Subwords(Vocabulary.of(fields.value), scorer.lexicon)
        for batch in batches:
            for first, column in slices(batch.column("text"), PASS):
                words = words_of(column)
                own = batch.slice(first, len(column))
                score, base, known, (doc, *rare) = scorer.score(words, subwords)
                word, share, spelling = (pa.array(x) for x in (rare[0].view(np.int64), *rare[1:]))
                items = pa.StructArray.from_arrays([word, share, spelling], names=["word", "share", "spelling"])
                places = pa.array(np.searchsorted(doc, np.arange(len(column) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("row"), own.column("doc_id"), pa.array(words.per_doc().astype(np.int64)), pa.array(score), pa.array(base),
                        pa.array(known.astype(np.int64)), pa.ListArray.from_arrays(places, items),
                    ],
                    names=["row", "doc_id", "n_words", "score", "base", "n_known", "rare"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = materialise(
        numbered.mapInArrow(task, f"row long, doc_id {kind}, n_words long, score double, base double, n_known long, rare {RARE}"), "parts"
    )
    n = F.coalesce("n", F.lit(0))
    counted = parts.select("row", F.inline("rare")).join(others, "word", "left")
    by_count = F.col("share") + F.log(n)
    mixed = F.greatest(by_count, "spelling") + F.log1p(F.exp(-F.abs(by_count - F.col("spelling"))))
    sums = counted.groupBy("row").agg(
        F.sum(F.when(n > 0, mixed).otherwise(F.col("spelling"))).alias("more_score"),
        F.sum(F.log10(n + 1)).alias("more_base"), F.count(F.when(n > 0, 1)).alias("more_known"),
    )

    def whole(name):
        return F.col(name) + F.coalesce(f"more_{name}", F.lit(0))

    return parts.drop("rare").withColumnRenamed("n_known", "known").join(sums, "row", "left").select(
        "doc_id", "n_words", (F.col("score") + F.coalesce("more_score", F.lit(0.0)) / F.lit(float(np.log(10)))).alias("score"),
        whole("base").alias("base"), whole("known").alias("n_known"),
    )


def language_scores(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased words and one end. The base is add-one smoothed word counts of the training rows; score is
    the model's log10 probability of the words and the end. Null texts count as empty: one token, the end. Each row of a
    repeated text or id is a row and counts in training. An empty table gives an empty result; other columns are ignored.
    """
    texts = whole_texts(docs, id_col, text_col)
    model, others, words, distinct, rows = learn(texts, tokenizer_file)
    total, kinds = words + rows, distinct + (rows > 0)
    found = scored(texts, others, model, tokenizer_file)
    tokens = F.col("n_words") + 1
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), tokens.alias("n_tokens"),
        (F.col("n_known") + F.lit(int(rows > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(float(np.log10(rows + 1))) - tokens * F.lit(float(np.log10(total + kinds + 1)))).alias("base_score"),
        "score",
    )

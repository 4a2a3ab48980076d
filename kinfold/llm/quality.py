"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j). The pair sum is computed in
linear time: half of the squared sum of v_i x_i less the sum of their squares, for each factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.pairs import runs
from kinfold.llm.words import slices, text_bytes, words_of

# Words are hashed into this many features; a document has at most so many.
HASH_BITS = 14
FACTORS = 8
# Labelled rows the machine is fitted on at most: those of the smallest hash of their id.
TRAIN_ROWS = 4096
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.08, 2e-5
# Small sets are passed more often, up to MOST times, for this many steps.
STEPS, MOST = 600, 60
THRESHOLD = 0.3
STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digit", "sign", "white", "lines", "other_bytes", "distinct",
    "top_word", "repeated", "long_words", "short_words", "closed", "digit_words",
)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def _rates(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of set flags between successive offsets, 0 for none."""
    total = np.r_[0, np.cumsum(flags)]
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, np.diff(offsets))


def features(texts: pa.Array, chars: np.ndarray):
    """(words per text, feature, value, statistics) of a large_string array without nulls.

    Words come by text, each hashed feature once with the logarithm of its count, of length 1 together.
    """
    data, offsets = text_bytes(texts)
    words = words_of(texts, lower=False)
    n = words.per_doc()
    word_at = np.r_[0, np.cumsum(n)]
    hashed = (words.hashes() >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    key = np.sort((words.doc << HASH_BITS) | hashed)
    head = runs(key)
    count = np.diff(np.r_[head, len(key)])
    doc, feature = key[head] >> HASH_BITS, key[head] & ((1 << HASH_BITS) - 1)
    per_text = np.bincount(doc, minlength=len(texts))
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, value * value, len(texts)))
    value = value / np.maximum(norm, 1e-9)[doc]

    length = words.end - words.start
    first = words.data[words.start] if len(words.start) else np.zeros(0, np.uint8)
    last = words.data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    same = np.zeros(len(hashed), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (words.doc[1:] == words.doc[:-1])
    top = np.zeros(len(texts))
    np.maximum.at(top, doc, count)
    is_digit = (data >= 48) & (data <= 57)
    is_upper = (data >= 65) & (data <= 90)
    is_letter = is_upper | ((data >= 97) & (data <= 122))
    is_white = (data == 32) | ((data >= 9) & (data <= 13))
    statistics = np.column_stack([
        np.log1p(chars), np.log1p(n), np.bincount(words.doc, length, len(texts)) / np.maximum(1, n),
        _rates(is_upper, offsets), _rates(is_digit, offsets), _rates((data < 128) & ~(is_digit | is_letter | is_white), offsets),
        _rates(is_white, offsets), _rates(data == 10, offsets), _rates(data >= 128, offsets), per_text / np.maximum(1, n),
        top / np.maximum(1, n), _rates(same, word_at), _rates(length > 20, word_at), _rates(length <= 2, word_at),
        _rates((last < 128) & ~((last >= 48) & (last <= 57)) & ~(((last | 32) >= 97) & ((last | 32) <= 122)), word_at),
        _rates((first >= 48) & (first <= 57), word_at),
    ])
    return per_text, feature, value, statistics


class Machine:
    """Weights of the hashed features and, after them, of the standardised statistics."""

    def __init__(self, fields=None):
        if fields:
            vars(self).update(fields)

    def scaled(self, statistics):
        return np.clip((statistics - self.mean) / self.spread, -4, 4) / np.sqrt(statistics.shape[1])

    def raw(self, per_text, feature, value, z):
        """(margin, sums of v x) of some texts."""
        size = 1 << HASH_BITS
        at = np.r_[0, np.cumsum(per_text)]
        v = self.v[feature] * value[:, None]
        sums = z @ self.v[size:] + _segments(v, at)
        squares = (z * z) @ (self.v[size:] ** 2) + _segments(v * v, at)
        linear = z @ self.w[size:] + _segments(self.w[feature] * value, at)
        return self.b + linear + 0.5 * (sums ** 2 - squares).sum(axis=1), sums

    def score(self, per_text, feature, value, statistics):
        margin, _ = self.raw(per_text, feature, value, self.scaled(statistics))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def fit(self, rows, labels, seed: int = 11):
        """Adagrad on the logistic loss, in batches of whole texts; `rows` are (feature, value, statistics)."""
        size, rng = 1 << HASH_BITS, np.random.default_rng(seed)
        statistics = np.array([r[2] for r in rows], float).reshape(-1, len(STATISTICS))
        self.mean = statistics.mean(axis=0) if len(rows) else np.zeros(len(STATISTICS))
        self.spread = np.maximum(statistics.std(axis=0), 1e-6) if len(rows) else np.ones(len(STATISTICS))
        z = self.scaled(statistics)
        rate = min(max(np.mean(labels), 0.01), 0.99) if len(rows) else 0.5
        self.b = float(np.log(rate / (1 - rate)))
        self.w = np.zeros(size + len(STATISTICS))
        self.v = rng.normal(0, 0.05, (size + len(STATISTICS), FACTORS))
        seen_w, seen_v, seen_b = np.full(len(self.w), 1e-3), np.full(len(self.w), 1e-3), 1e-3
        for _ in range(max(EPOCHS, min(MOST, STEPS * BATCH // max(1, len(rows))))):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), BATCH):
                pick = order[a:a + BATCH]
                feature = np.concatenate([rows[i][0] for i in pick])
                value = np.concatenate([rows[i][1] for i in pick])
                per_text = np.array([len(rows[i][0]) for i in pick])
                margin, sums = self.raw(per_text, feature, value, z[pick])
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) / len(pick)
                of = np.repeat(np.arange(len(pick)), per_text)
                every = np.r_[feature, np.tile(np.arange(size, len(self.w)), len(pick))]
                x = np.r_[value, z[pick].ravel()]
                text = np.r_[of, np.repeat(np.arange(len(pick)), len(STATISTICS))]
                order_of = np.argsort(every, kind="stable")
                every, x, text = every[order_of], x[order_of], text[order_of]
                head = runs(every)
                which, cuts = every[head], np.r_[head, len(every)]
                e = error[text] * x
                grad_w = _segments(e, cuts) + DECAY * self.w[which]
                grad_v = _segments(e[:, None] * (sums[text] - self.v[every] * x[:, None]), cuts) + DECAY * self.v[which]
                seen_w[which] += grad_w ** 2
                seen_v[which] += (grad_v ** 2).mean(axis=1)
                seen_b += error.sum() ** 2
                self.w[which] -= RATE * grad_w / np.sqrt(seen_w[which])
                self.v[which] -= RATE * grad_v / np.sqrt(seen_v[which])[:, None]
                self.b -= RATE * error.sum() / np.sqrt(seen_b)
        return self


def _segments(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of successive segments [at[k], at[k + 1]) along the first axis; empty ones are 0."""
    out = np.zeros((len(at) - 1, *values.shape[1:]))
    filled = np.flatnonzero(at[1:] > at[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values, at[filled], axis=0)
    return out


def _chars(docs: DataFrame) -> DataFrame:
    """id, whole text and the length metadata (the text's own where the table has none)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("*", text.alias("kin_text"), F.greatest(F.coalesce(given, F.length(text).cast("double")), F.lit(0.0)).alias("kin_chars"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, folds: int = 5) -> Machine:
    """A machine fitted on at most `train_rows` labelled documents whose fold is not held out.

    Of repeated labels of an id the largest counts; labels without a document, or null, are left out.
    Without any labelled document every score is one half.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
        .groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(train_rows)
    )

    def task(batches):
        for batch in batches:
            ids, label = batch.column("doc_id"), batch.column("label")
            chars = batch.column("kin_chars").to_numpy(zero_copy_only=False)
            for first, texts in slices(batch.column("kin_text")):
                per_text, feature, value, statistics = features(texts, chars[first:first + len(texts)])
                at = np.r_[0, np.cumsum(per_text)]
                parts = [(feature[a:b].astype("<u2").tobytes(), value[a:b].astype("<f4").tobytes()) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), label.slice(first, len(texts)), *[pa.array(c, pa.binary()) for c in zip(*parts)],
                     pa.array(list(statistics), pa.list_(pa.float64()))],
                    names=["doc_id", "label", "feature", "value", "statistics"],
                )

    # At most train_rows rows of two numbers.
    texts = _chars(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "kin_text", "kin_chars").join(
        F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "label")), "doc_id"
    )
    found = texts.mapInArrow(task, "doc_id long, label double, feature binary, value binary, statistics array<double>").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["feature"]), bytes(r["value"])))
    rows = [(np.frombuffer(r["feature"], "<u2").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float), r["statistics"]) for r in found]
    return Machine().fit(rows, np.array([r["label"] for r in found], float))


def scored(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """`docs` with the score of every whole text, between 0 and 1, in column `name`, in place of any such column. Null
    texts count as empty, and empty ones are scored too. Repeated rows score alike; an empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast(vars(machine))
    docs = docs.drop(name)
    names = docs.columns

    def task(batches):
        model = Machine(held.value)
        for batch in batches:
            chars = batch.column("kin_chars").to_numpy(zero_copy_only=False)
            own = batch.select(names)
            for first, texts in slices(batch.column("kin_text")):
                score = model.score(*features(texts, chars[first:first + len(texts)]))
                yield pa.RecordBatch.from_arrays([*own.slice(first, len(texts)).columns, pa.array(score)], names=[*names, name])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], f"{name} double"])
    return _chars(docs).mapInArrow(task, schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on) of every row. Null texts count as empty, a null id as empty
    text, repeated rows score alike; other columns are ignored, and an empty table gives an empty result."""
    narrow = docs.select(*[c for c in ("doc_id", "text", "n_chars") if c in docs.columns])
    return scored(narrow, fit(narrow, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are predicted 1, with their own columns, whatever their names. Null and empty texts are
    scored like others, repeated rows stay or go together; an empty table gives an empty result."""
    return scored(docs, fit(docs, labels), "kin_score").where(F.col("kin_score") >= THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])

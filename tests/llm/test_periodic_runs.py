"""Periodic runs against a scan of every period."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.llm import periodic_runs
from kinfold.llm import queries
from kinfold.llm.words import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """(start, length, period) of every run, by start, then period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    best = (None,) * 4
    if runs:
        top = runs[0]
        for r in runs[1:]:
            if r[1] * top[2] > top[1] * r[2]:
                top = r
        best = (*top, 1000 * top[1] // top[2])
    return (doc_id, len(runs), *best, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(brute_collapsed(words, runs)))


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_words(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        texts = []
        for _ in range(6):
            words = list(rng.choice(list("abc")[: rng.integers(1, 4)], rng.integers(0, 90)))
            # Periods that are almost one word repeated: blocks with a short period of their own.
            p = rng.integers(1, 25)
            unit = list(rng.choice(["a", "b"], p, p=[0.85, 0.15]))
            words += (unit * 8)[: rng.integers(3 * p, 7 * p + 5)] + list(rng.choice(["a", "b"], 3))
            texts.append([str(w) for w in words])
        runs, collapsed = periodic_runs._of_texts(pa.array([" ".join(t) for t in texts], pa.large_string()))
        for words, got, text in zip(texts, runs.to_pylist(), collapsed.to_pylist()):
            want = brute_runs(words)
            assert [(r["start"], r["length"], r["period"]) for r in got] == want
            assert text == brute_collapsed(words, want)


def test_fibonacci_and_nested_words():
    """Words rich in repeats of low power, and a run of runs."""
    a, b = ["x"], ["x", "y"]
    while len(b) < 3000:
        a, b = b, b + a
    nested = (["a"] * 9 + ["b"]) * 5
    texts = [b, nested * 4, ["z"] * 5, ["z"] * 6, ["z"] * 700, (["p", "q"] * 3), (["p", "q"] * 4), ["p", "q"] * 4 + ["p"]]
    runs, _ = periodic_runs._of_texts(pa.array([" ".join(t) for t in texts], pa.large_string()))
    for words, got in zip(texts, runs.to_pylist()):
        assert [(r["start"], r["length"], r["period"]) for r in got] == brute_runs(words)


def test_wavelet_tree_successor():
    rng = np.random.default_rng(4)
    values = rng.permutation(200)
    tree = periodic_runs.WaveletTree(values, 200)
    low = rng.integers(0, 200, 500)
    high = np.minimum(low + rng.integers(1, 50, 500), 200)
    x = rng.integers(0, 300, 500)
    found, there = tree.successor(low, high, x)
    for lo, hi, y, f, t in zip(low, high, x, found, there):
        above = [v for v in values[lo:hi] if v >= y]
        assert t == bool(above) and (not above or f == min(above))


def test_equal_words_ahead_and_behind():
    words = words_of(pa.array(["a b a b a b", "a b a", "", "b a b"], pa.large_string()))
    ends = np.cumsum(words.per_doc())
    order = periodic_runs.SuffixOrder(words.hashes() ^ words.doc.astype(np.uint64), ends[words.doc])
    at = np.array([0, 0, 2, 0])
    to = np.array([2, 1, 4, 6])
    assert order.ahead(at, to).tolist() == [4, 0, 2, 0]
    assert order.behind(np.array([2, 4, 8]), np.array([4, 5, 11])).tolist() == [2, 0, 0]


ROWS = [
    (None, "a a a a a a a", "x", 1), (1, None, "x", 1), (2, "", "x", 1), (3, " \t\n", "x", 1), (4, "one", "x", 1), (5, "A a A a A a A a A", None, 1),
    (5, "A a A a A a A a A", None, 1), (6, "é é é é é é é", "x", None), (7, "w " * 4000, "x", 1), (8, "long " + "y" * 200_000 + " end", "x", 1),
    (9, "a b c d " * 9 + "a a a a a a b b b b b b", "x", 1),
]


def test_rows_of_a_small_table(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash."""
    rng = np.random.default_rng(9)
    rows = ROWS + [(i, " ".join(rng.choice(["u", "v", "w"], rng.integers(1, 200), p=[0.8, 0.1, 0.1])), "x", 1) for i in range(100, 220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed int").repartition(3)
    found = periodic_runs.periodic_runs(docs)
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        runs = brute_runs(words)
        want.append((doc_id, runs, brute_collapsed(words, runs)))
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(periodic_runs.with_planted_repeats(empty)).count() == 0


def test_planted_repeats_and_the_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["u", "v", "w"], rng.integers(0, 120)))) for i in range(300)] + [r[:2] for r in ROWS if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    changed = {(r["doc_id"], r["text"]) for r in periodic_runs.with_planted_repeats(docs).collect()}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    for i, text in rows:
        words = WORD.findall(text or "")
        assert (i, text if planted(i, words) is words else " ".join(planted(i, words))) in changed
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in sorted(expected(*r) for r in rows)]
    assert set(got) == {expected(*r) for r in rows}
    null = periodic_runs.with_planted_repeats(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    assert sorted(r["text"] or "" for r in null.collect()) == sorted(t or "" for _, t in rows)


def test_query_on_the_given_table(spark):
    """Every row of the smallest table by brute force."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, folder).collect()}
    short = [r for r in docs if len(WORD.findall(r["text"] or "")) <= 1500]
    assert len(got) == len(docs) and len(short) > 0.8 * len(docs)
    assert {expected(*r) for r in short} <= got

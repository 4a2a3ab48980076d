"""Source divergence against sums in plain whole numbers."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from kinfold.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=30, ranks=50):
    counts, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for text, lang, source in ((t or "", l or "", s or "") for t, l, s in rows):
        terms = TERM.findall(lower(text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for l, s in groups if l == lang]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = collections.Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def rate(count, n):
            return 1 + 10**9 * (count + 5) // (n + 5 * len(kept))

        for s in sources:
            pair = [(sum(abs(rate(counts[lang, s][t], total[s]) - rate(counts[lang, o][t], total[o])) for t in kept), o) for o in sources if o != s]
            term = [(rate(counts[lang, s][t], total[s]) - rate(whole[t], sum(total.values())), t) for t in kept if counts[lang, s][t]]
            for part, found, most in (("pair", pair, None), ("term", [x for x in term if x[0] > 0], ranks)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def test_terms():
    texts = ["The  THE the-x", "", "1a2É ſ٣b", "中文 a_b", "end"]
    doc, terms = divergence.terms_of(pa.array(texts, pa.large_string()))
    got = [[] for _ in texts]
    for d, t in zip(doc, terms.to_pylist()):
        got[d].append(t.decode())
    assert got == [TERM.findall(lower(t)) for t in texts]


def test_gallop_and_distance():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = (np.unique(rng.integers(0, 5000, rng.integers(0, n))) for n in (30, 3000))
        assert (divergence.gallop(a, b) == np.searchsorted(b, a)).all() and (divergence.gallop(b, a) == np.searchsorted(a, b)).all()
        ca, cb = rng.integers(1, 50, len(a)), rng.integers(1, 50, len(b))
        ta, tb = int(ca.sum()) + 25_000, int(cb.sum()) + 25_000
        x, y = dict(zip(a, ca)), dict(zip(b, cb))
        want = sum(abs(10**9 * (int(x.get(i, 0)) + 5) // ta - 10**9 * (int(y.get(i, 0)) + 5) // tb) for i in range(5000))
        assert divergence.distance(a, ca, ta, b, cb, tb, 5000) == divergence.distance(b, cb, tb, a, ca, ta, 5000) == want


def test_rates_are_exact():
    counts = np.array([0, 1, 7, 9 * 10**14], np.int64)
    assert divergence.rates(counts, 10**15 + 7).tolist() == [1 + 10**9 * (int(c) + 5) // (10**15 + 7) for c in counts]


SCHEMA = "text string, lang string, source string, doc_id long, item string, value string, number long, term string, total string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    pool = ["the", "The", "ré", "x1y", "中文", "of-the", "ab", "cd", "ef", "gh"] + [f"t{chr(97 + i)}" for i in range(20)]
    out = [(None, "en", "a"), ("", "en", "bare"), ("12 34", "en", None), (None, None, None), ("alone here", "xx", "one"), ("alone there", "xx", "two"), ("the " * 50_000, "en", "a")]
    for i in range(400):
        # One source has a third of all rows.
        source = "a" if i % 3 == 0 else rng.choice(["b", "c", "dé", "zz"])
        out.append((" ".join(rng.choice(pool, rng.integers(0, 40))), rng.choice(["en", "fr", None], p=[0.7, 0.2, 0.1]), str(source)))
    return out + out[50:60]


@pytest.mark.parametrize("block", [divergence.BLOCK, 4])
def test_small_table(spark, rows, block):
    """Nulls, empty and long texts, groups and languages without terms, repeated rows and columns whose names clash;
    also where a language's terms span several arrays."""
    docs = spark.createDataFrame([(*r, 1, "i", "v", 2, "t", "x") for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in divergence.divergence_report(docs, block=block).collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want
    assert {r for r in want if r[0] == "xx"} == {("xx", "one", "pair", "two", 0, 1), ("xx", "two", "pair", "one", 0, 1)}
    few = [tuple(r) for r in divergence.divergence_report(docs, least=5, ranks=3).collect()]
    assert set(few) == brute(rows, 5, 3)


def test_cells_of_many_slices(rows):
    """What a task adds up does not depend on how much it holds."""
    lang, source, text = (pa.array([r[k] or "" for r in rows]) for k in (1, 2, 0))
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([lang, source], ["lang", "source"]), text], names=["grp", "text"])

    def total(parts):
        out = collections.Counter()
        for p in parts:
            for l, s, t, c, d in zip(*(p.column(k).to_pylist() for k in range(5))):
                out[l, s, t, "count"] += c
                out[l, s, t, "docs"] += d
        return out

    whole = total(divergence._counted([batch]))
    held, divergence.HELD_CELLS = divergence.HELD_CELLS, 10
    try:
        assert total(divergence._counted([batch.slice(i, 7) for i in range(0, batch.num_rows, 7)])) == whole
    finally:
        divergence.HELD_CELLS = held


def test_empty_table(spark):
    assert divergence.divergence_report(spark.createDataFrame([], SCHEMA)).count() == 0

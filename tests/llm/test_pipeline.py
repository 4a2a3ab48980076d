"""The pipeline's rows against stages done by brute force."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_small_tables import TOKENIZER, brute_components

import __spark_entry__ as driver
import corpus_pipeline
from kinfold.llm import mixing, quality

DATA = "/root/testdata/sf0.001"


def test_rows_equal_stages_by_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in quality.classified(docs, labels).where("predicted = 1").collect()}
    last = {}
    for d in sorted(good):
        last[text[d]] = d
    single = sorted(last.values())
    _, component = brute_components([(d, text[d]) for d in single], 5, 80)
    kept = [d for d in single if component[d] == d]
    assert len(kept) < len(text)
    times = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.where(F.col("doc_id").isin(kept))).collect()}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = collections.Counter({(d, tuple(tokenizer.encode(text[d], add_special_tokens=False).ids)): times[d] for d in kept if times[d]})
    found = corpus_pipeline.run(spark, DATA).collect()
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in found) == expected


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, DATA)
    assert out.columns == docs.columns and out.count() == 0


EXTRA = ["stays", "score", "kept", "size", "copies", "target", "component", "owner", "row", "mark"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_with_nulls_repeats_and_other_columns(spark, stage):
    """Rows with nulls in every column, empty texts, ties, repeated rows and columns with names of the operators' own: a
    stage keeps whole rows, and those it keeps of a table without the other columns."""
    given = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()
    rows = [tuple(r) for r in given] + [tuple(given[0]), tuple(given[1]), (None, None, None, None, None), (None, given[2]["text"], None, None, None),
                                        (10**6, "", "en", "s", 0), (10**6 + 1, None, "en", None, None), (10**6 + 2, given[3]["text"], "en", "s", 7)]
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    small = spark.createDataFrame(rows, plain).repartition(2)
    wide = spark.createDataFrame([(*r, *[f"{c} {i}" for c in EXTRA]) for i, r in enumerate(rows)], plain + "".join(f", `{c}` string" for c in EXTRA)).repartition(2)
    run = corpus_pipeline.STAGES[stage][1]
    few, many = run(spark, small, DATA), run(spark, wide, DATA)
    assert few.columns == small.columns and many.columns == wide.columns
    kept = many.collect()
    assert collections.Counter(tuple(r)[:5] for r in kept) == collections.Counter(map(tuple, few.collect()))
    # The other columns stay with their row.
    whole = {(*r, *[f"{c} {i}" for c in EXTRA]) for i, r in enumerate(rows)}
    assert {tuple(r) for r in kept} <= whole and kept


def test_last_stage_with_nulls_and_repeats(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.STAGES[4][1](spark, docs, DATA)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out.collect())[:3] == [(0, 0), (1, 0), (1, 0)]
    assert out.count() == 4 and corpus_pipeline.STAGES[4][1](spark, docs.limit(0), DATA).count() == 0


def test_queries_are_registered():
    names = driver.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names

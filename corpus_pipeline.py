"""Corpus pipeline: five stages, each over all that the one before has kept and written.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns the
ids and tokens of each kept row. Rows are whole throughout; the mix may repeat a row. In every stage null texts count as
empty, null ids and sources are values like others, rows that repeat an id and a text are treated alike, other columns
stay as they are, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from kinfold.llm import bpe, mixing, ngram_join, quality, trie_dedup
from kinfold.sources.workspace import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def quality_filter(spark, docs, sf_dir):
    """Documents that the factorisation machine, fitted on the folder's labels, accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark, docs, sf_dir):
    """Of equal texts, the row with the largest doc_id."""
    return trie_dedup.without_copies(docs)


def near_copies(spark, docs, sf_dir):
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest doc_id."""
    return ngram_join.keep_one_of_each(docs, width=5, percent=80)


def source_mix(spark, docs, sf_dir):
    """Every document as often as its source's target weight asks for."""
    return mixing.mixed(docs)


def tokens(spark, docs, sf_dir):
    """doc_id, source, token ids (little-endian unsigned 32-bit integers) and their number, of each row of the mix."""
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), TOKENIZER)
    return encoded.selectExpr("doc_id", "source", "ids", "octet_length(ids) div 4 AS n_tokens")


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", tokens),
]

# The classifier has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each result is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)

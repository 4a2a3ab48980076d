"""The registered queries of the operators, each over its whole table, and SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe, chat, divergence, lm, mixing, ngram_join, periodic_runs, quality, secrets, sharding, trie_dedup, warc, winnowing
from kinfold.sources.workspace import scratch_path


# Vocabulary files of public tokenizers.
TOKENIZERS = "/opt/tokenizers"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_vector_bin_packing(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir))


def op2_secret_ledger(spark, sf_dir):
    versions = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    findings, _ = secrets.scan(versions)
    counts = [F.size(secrets.of_rank(F.col("spans"), k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE)]
    base = secrets.of_rank(F.col("spans"), *range(len(secrets.BASE)))
    return findings.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
    )


def op5_quality_machine(spark, sf_dir):
    return quality.classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_winnowing(spark, sf_dir):
    return winnowing.compared_with_edits(documents(spark, sf_dir)).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op3_chat_formatting(spark, sf_dir):
    own = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"),
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_chat(turns))


def op4_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op7_source_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_trie_dedup(spark, sf_dir):
    return trie_dedup.exact_groups(documents(spark, sf_dir))


def op10_bpe(spark, sf_dir, tokenizer_file=f"{TOKENIZERS}/byte_bpe_50k.json"):
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_file)
    return bpe.decode(ids, tokenizer_file).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op9_attention_scores(spark, sf_dir, tokenizer_file=f"{TOKENIZERS}/byte_bpe_50k.json"):
    return lm.language_scores(documents(spark, sf_dir), tokenizer_file)


def op11_warc_chain(spark, sf_dir):
    path = scratch_path(spark, "archives")
    warc.write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.read_archive(spark, path).select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_repeats(documents(spark, sf_dir)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = periodic_runs.strongest(F.col("runs"))
    return found.select("*", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_source_divergence(spark, sf_dir):
    return divergence.divergence_report(documents(spark, sf_dir))


QUERIES = {
    "op1_vector_bin_packing": op1_vector_bin_packing,
    "op2_secret_ledger": op2_secret_ledger,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_quality_machine": op5_quality_machine,
    "op6_winnowing": op6_winnowing,
    "op7_source_mixing": op7_source_mixing,
    "op8_trie_dedup": op8_trie_dedup,
    "op9_attention_scores": op9_attention_scores,
    "op10_bpe": op10_bpe,
    "op11_warc_chain": op11_warc_chain,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_divergence": op13_source_divergence,
}
# Words as runs of anything but the six ASCII spaces, as in every contract above.
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLES = {
    "op3_chat_formatting": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, role AS r, coalesce(text, '') AS text, text AS x FROM conversations
           UNION ALL BY NAME
           SELECT -7 AS conv_id, turn, role, role AS r, '\### Assistant: </turn> ok' AS text, text AS x FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
       CAST(sum(CASE WHEN r = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN r = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, r NULLS FIRST, x NULLS FIRST)) AS loss_sha256,
       CAST(sum(15 + length(regexp_replace(role, '([\\#<: ])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT n, array_to_string(w[i:i + 3], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, least(len(w), 1) + 1))) AS i)),
size AS (SELECT n, count(*) AS c FROM g GROUP BY n),
common AS (SELECT a.n AS a, b.n AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.n <> b.n GROUP BY 1, 2),
links AS (SELECT common.a, common.b FROM common JOIN size x ON x.n = a JOIN size y ON y.n = b WHERE 100 * common.c >= 85 * (x.c + y.c - common.c)),
reach(a, b) AS (SELECT n, n FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(size.c), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM w LEFT JOIN size ON size.n = w.n JOIN reach ON reach.a = w.n JOIN w o ON o.n = reach.b GROUP BY w.n, w.doc_id
""",
    "op7_source_mixing": f"""
WITH sized AS (SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS c,
             [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w
      FROM sized GROUP BY source),
-- Sources stop in order of size to weight: before each, words of those that have stopped and weights of the rest.
o AS (SELECT *, row_number() OVER (ORDER BY c * CAST(6 / w AS INTEGER), source NULLS LAST) AS k FROM s),
r AS (SELECT *, coalesce(sum(c) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
             sum(c) OVER () AS total FROM o),
stop AS (SELECT min_by(3 * total - 4 * used, k) AS spare, min_by(weights, k) AS weights, min(k) AS k
         FROM r WHERE w * (3 * total - 4 * used) <= 4 * c * weights),
t AS (SELECT r.source, r.c AS source_size, CASE WHEN r.k < stop.k THEN CAST(2 * r.c AS DOUBLE)
             ELSE CAST(r.w * stop.spare AS DOUBLE) / CAST(2 * stop.weights AS DOUBLE) END AS target FROM r, stop),
d AS (SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
             CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS rate,
             CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM d
""",
    "op8_trie_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY body)
""",
    "op11_warc_chain": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p),
b AS (SELECT *, [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)
                 FOR i IN range(32)] AS letters FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM b
""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT n, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT n) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS c FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(c.c) FILTER (WHERE k.term IS NOT NULL), 0) AS n
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN k USING (lang, term) GROUP BY ALL),
r AS (SELECT lang, source, term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 5)) // (g.n + 5 * l.v) AS p,
             1 + (1000000000 * (k.c + 5)) // (l.n + 5 * l.v) AS q
      FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN r x ON x.lang = a.lang AND x.source = a.source LEFT JOIN r y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
          UNION ALL SELECT lang, source, 'term', term, p - q FROM r WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 50
""",
}

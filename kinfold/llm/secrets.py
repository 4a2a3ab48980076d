"""Secret scans with an incremental ledger of blobs.

Every version of a file is named by the hash of its content. The ledger holds the spans of each pair of a blob and a rule's
version that was ever scanned. A scan reads only blobs with pairs that the ledger lacks, each once however many paths and
versions have it, and tries only the lacking rules; it adds these pairs to the ledger and joins the findings back to all
paths. Spans are code points of the whole text, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.winnowing import bound
from kinfold.sources.workspace import materialise


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of a pattern whose `group` has `least` code points or more.

    A rule that finds other spans than before needs another version.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: str = "1"

    @property
    def pair(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in their order. Runs of one character class have their least length in the pattern,
# which finds the same runs as dropping short ones afterwards.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
# Kinds beside the base ones.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("bearer", r"Bearer\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("prefixed", "(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
)
RULES = BASE + MORE
SPANS = "array<struct<start:int,end:int>>"
RANKED = "array<struct<start:int,rank:int,end:int>>"
# A row for each blob and scan that tried rules on it; `pair` is a rule's kind and version.
LEDGER = f"blob string, scanned array<struct<pair:string,spans:{SPANS}>>"
# Matches whose spans one array gathers; a text's arrays are put together afterwards, so none is copied for each match.
CHUNK = 512


def spans(text: Column, rule: Rule) -> Column:
    """Matches as structs (start, end): matches and the text between them, with running lengths."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    if rule.least:
        tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    else:
        tested = whole
    steps = bound(whole, lambda w: F.arrays_zip(F.slice(between, 1, F.size(w)).alias("gap"), w.alias("whole"), tested.alias("tested")))

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + x["whole"]
        found = F.when(x["tested"] >= rule.least, F.concat(state["found"], F.array(F.struct(start.alias("start"), end.alias("end")))))
        return F.struct(end.alias("at"), found.otherwise(state["found"]).alias("found"))

    def chunk(all_steps):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))
        return lambda c: F.aggregate(F.slice(all_steps, c * CHUNK + 1, CHUNK), zero, step)

    def put(state, part):
        return F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

    def moved(part, by):
        return F.transform(part["found"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end")))

    def together(parts):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.flatten(F.zip_with(parts, F.aggregate(parts, zero, put)["starts"], moved))

    found = bound(bound(steps, lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / CHUNK).cast("int")), chunk(x))), together)
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPANS))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES, path_col: str = "path", text_col: str = "text"):
    """(findings, ledger): a row (path, blob, spans) for every row of `versions`, and the ledger with what was new.

    `versions` has a row for each historical version of a path. The ledger has rows (blob, scanned): the pairs of rule and
    version that a scan tried on the blob, with their spans (start, end); None stands for an empty one. A new rule, or a new
    version of one, is tried alone on the blobs that the ledger holds. Spans of the findings are those of `rules`, ordered by
    start, then by the rules' order. Null texts count as empty, null paths are a path. An empty table gives empty results;
    other columns are ignored.
    """
    ledger = empty_ledger(versions.sparkSession) if ledger is None else ledger
    pairs = F.array(*[F.lit(r.pair) for r in rules])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = versions.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("body"))
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned.pair"))).alias("known"))
    lacking = F.array_except(pairs, F.coalesce("known", F.array().cast("array<string>")))
    blobs = named.groupBy("blob").agg(F.min("path").alias("path")).join(known, "blob", "left")
    unseen = blobs.select(F.col("blob").alias("new_blob"), F.col("path").alias("new_path"), lacking.alias("lacking")).where(F.size("lacking") > 0)
    once = named.join(unseen, (F.col("blob") == F.col("new_blob")) & F.col("path").eqNullSafe(F.col("new_path")))
    tried = [F.when(F.array_contains("lacking", r.pair), F.struct(F.lit(r.pair).alias("pair"), spans(F.col("body"), r).alias("spans"))) for r in rules]
    scanned = F.filter(F.array(*tried), lambda t: t.isNotNull())
    new = materialise(once.select("blob", scanned.alias("scanned")).dropDuplicates(["blob"]), "blobs")
    grown = ledger.unionByName(new)
    of_rules = F.filter("scanned", lambda t: F.array_contains(pairs, t["pair"]) & (F.size(t["spans"]) > 0))
    ranked = F.flatten(F.transform(of_rules, lambda t: F.transform(t["spans"], lambda x: F.struct(
        x["start"].alias("start"), (F.array_position(pairs, t["pair"]) - 1).cast("int").alias("rank"), x["end"].alias("end")
    ))))
    found = grown.select("blob", ranked.alias("spans")).where(F.size("spans") > 0)
    found = found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    findings = named.select("path", "blob").join(found, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(RANKED)).alias("spans")
    )
    return findings, grown


def listed(found: Column, rules=RULES) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def of_rank(found: Column, *ranks: int) -> Column:
    return F.filter(found, lambda s: s["rank"].isin(*ranks))

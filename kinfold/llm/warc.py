"""WARC archives: pages to records with revisits of equal payloads, and records back by a chain of offsets.

Writing is Spark's text sink with the two line ends that close a record as separator. Reading is its text source with
the version line as separator, so that files are split anywhere: every piece follows a version line, which either
begins a record or stands in a payload. A piece whose header names a block length is a candidate with one successor,
the place where its record would end. Tasks follow these pointers within their split of a file; pointer jumping over
what leaves the splits, from the first record of each file, finds the candidates that the true chain passes. All
others lie in payloads, whose pieces are put together again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.sources.workspace import materialise

END, MAGIC = "\r\n", "WARC/1.1\r\n"
BLANK = END + END
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# A payload with more than this share of all rows is sent to every task; there are fewer than the inverse of them.
HOT_SHARE = 1000
# Digits of base 32 as numbers are written, and as RFC 4648 has them.
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload: Column) -> Column:
    """Base-32 SHA-1: every 20 bits of the 160 are four digits."""
    hexadecimal = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, LETTERS)


def _lines(*named) -> Column:
    """Header lines; those without a value are left out, line ends in values are escaped."""
    def line(name, value):
        value = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(END))).otherwise(F.lit(""))

    return F.concat(*[line(n, v) for n, v in named])


def _urn(page: Column, payload_digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), payload_digest, F.lit(">"))


def with_originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """The rows (page, digest, size, payload, ...) with `original`, the largest page of those with an equal payload of at
    least `least` bytes, as a struct; null where the row has the payload to itself. Rows that are not original lose
    their payload where it is held by many.
    """
    groups = pages.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max(F.struct("page")).alias("original"), F.count(F.lit(1)).alias("n"))
    several = materialise(groups.where("n > 1").select("digest", "original", "n"), "originals")
    rows = pages.count()
    hot = several.where(F.col("n") * HOT_SHARE > rows).select(F.col("digest").alias("hot_digest"), F.col("original").alias("hot_original"))
    found = pages.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left").drop("hot_digest")
    first = F.col("hot_original").isNull() | F.col("page").eqNullSafe(F.col("hot_original.page"))
    # Rows of hot payloads need no partner, so they are dealt out by other values.
    key = F.when(F.col("hot_original").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page", "url").cast("string")))
    found = found.withColumn("payload", F.when(first, F.col("payload"))).withColumn("key", key)
    rest = several.where(F.col("n") * HOT_SHARE <= rows).select(F.col("digest").alias("key"), "original")
    return found.join(rest, "key", "left").withColumn("original", F.coalesce("hot_original", "original")).drop("key", "hot_original")


def write_archive(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One record per row of `pages` into WARC files under `path`.

    Of rows with equal payloads of at least `least` bytes, those with the largest id are `response` records with the
    payload, all others `revisit` records that name it and have the HTTP header only; rows with smaller payloads are all
    responses. Payloads are equal when their SHA-1 and size are. Null payloads count as empty; a null id is the smallest
    and stays null; a null url has no line. Rows that repeat an id are records of one name. An empty table gives
    archives without records; other columns are ignored.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", digest(F.col("payload"))).withColumn("size", F.octet_length("payload"))
    rows = with_originals(rows, least)
    revisit = F.col("original").isNotNull() & (F.col("size") >= least) & ~F.col("page").eqNullSafe(F.col("original.page"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(BLANK))
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    header = F.concat(F.lit(MAGIC), _lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", _urn(F.col("page"), F.col("digest"))),
        ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Refers-To", F.when(revisit, _urn(F.col("original.page"), F.col("digest")))), ("WARC-Profile", F.when(revisit, PROFILE)),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
    ), F.lit(END))
    record = F.concat(header.cast("binary"), http.cast("binary"), body).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", BLANK).text(path)


def _head(value: Column) -> Column:
    return F.substring_index(value, BLANK, 1)


def _field(head: Column, name: str, pattern: str = "[^\r\n]*?") -> Column:
    """The value of a header line, null without one."""
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*({pattern})[ \t]*(?=\r\n|$)", 1)
    return F.nullif(found, F.lit(""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What follows each version line, by file, split of the file and order. All that read it share one listing of the
    files, so that a piece has the same number each time."""
    value, head = F.col("value"), F.col("head")
    text = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        value, F.octet_length(value).cast("long").alias("size"), _head(value).alias("head"),
    )
    whole = F.octet_length(head) < F.col("size")
    needs = F.octet_length(head) + 2 * len(BLANK) + _field(head, "Content-Length", "[0-9]{1,18}").cast("long")
    return text.select("file", "split", "at", "size", F.coalesce(F.when(whole, needs), F.lit(-1)).alias("needs"), "value")


def _local(rows: pd.DataFrame) -> pd.DataFrame:
    """Places of the pieces of one split, of their successors, and of where the chain from each leaves the split."""
    rows = rows.sort_values("at")
    after = np.cumsum(rows["size"].to_numpy() + len(MAGIC))
    place = np.r_[0, after[:-1]]
    needs = rows["needs"].to_numpy()
    candidate = needs >= 0
    goes = np.where(candidate, place + needs + len(MAGIC), -1)
    to = np.searchsorted(place, goes)
    own = np.arange(len(rows))
    inside = candidate & (to < len(rows))
    inside[inside] = place[to[inside]] == goes[inside]
    last = np.where(inside, to, own)
    while (further := last[last] != last).any():
        last = np.where(further, last[last], last)
    leaves = np.where(candidate & candidate[last] & (goes[last] >= after[-1]), goes[last], -1)
    return pd.DataFrame({"file": rows["file"], "split": rows["split"], "at": rows["at"], "place": place, "goes": goes, "leaves": leaves, "ends": after[-1]})


def _passed(rows: pd.DataFrame) -> pd.DataFrame:
    """The record of each piece of one split that the chain enters at `entry`; null for pieces before it."""
    rows = rows.sort_values("place")
    place, goes = rows["place"].to_numpy(), rows["goes"].to_numpy()
    record = np.full(len(rows), -1, np.int64)
    if rows["entry"].notna().iloc[0]:
        now = int(np.searchsorted(place, int(rows["entry"].iloc[0])))
        while now < len(place):
            record[now] = place[now]
            if goes[now] < 0:
                break
            there = int(np.searchsorted(place, goes[now]))
            now = there if there < len(place) and place[there] == goes[now] else len(place)
    record = np.maximum.accumulate(record)
    named = pd.Series(record, rows.index, "Int64").mask(record < 0)
    return pd.DataFrame({"file": rows["file"], "split": rows["split"], "at": rows["at"], "place": place, "record": named})


def _reached(chain: DataFrame) -> DataFrame:
    """(file, place) of the candidates where the chain from the first record of a file enters a split."""
    starts = chain.where(F.col("place") == len(MAGIC)).select("file", "place")
    targets = chain.where("leaves >= 0").select("file", F.col("leaves").alias("place")).distinct().unionByName(starts).distinct()
    nodes = materialise(chain.select("file", "place", "leaves").join(targets, ["file", "place"]), "nodes")
    jumps = nodes.where("leaves >= 0").select("file", "place", F.col("leaves").alias("to"))
    reached, known = materialise(starts, "reached"), -1
    while (found := reached.count()) != known:
        known = found
        ahead = reached.join(jumps, ["file", "place"]).select("file", F.col("to").alias("place")).join(nodes, ["file", "place"], "left_semi")
        reached = materialise(reached.unionByName(ahead).distinct(), "reached")
        # Each jump is followed by another one: twice as far.
        further = jumps.select("file", F.col("place").alias("to"), F.col("to").alias("beyond"))
        jumps = materialise(jumps.join(further, ["file", "to"]).select("file", "place", F.col("beyond").alias("to")), "jumps")
    return reached


def _owners(pieces: DataFrame) -> DataFrame:
    """file, split, at, place, record: for every piece that belongs to a record of the chain, the record's place."""
    local = materialise(pieces.select("file", "split", "at", "size", "needs").groupBy("file", "split").applyInPandas(
        _local, "file string, split long, at long, place long, goes long, leaves long, ends long"), "local")
    # One row for each split of a file.
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = local.groupBy("file", "split").agg(F.max("ends").alias("ends")).select(
        "file", "split", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("base")
    )
    chain = materialise(local.join(bases, ["file", "split"]).select(
        "file", "split", "at", (F.col("place") + F.col("base")).alias("place"),
        *[F.when(F.col(c) >= 0, F.col(c) + F.col("base")).otherwise(F.lit(-1)).cast("long").alias(c) for c in ("goes", "leaves")],
    ), "chain")
    entries = chain.join(_reached(chain), ["file", "place"], "left_semi").groupBy("file", "split").agg(F.min("place").alias("entry"))
    passed = materialise(chain.join(entries, ["file", "split"], "left").groupBy("file", "split").applyInPandas(
        _passed, "file string, split long, at long, place long, record long"), "passed")
    # A record goes on over the start of later splits, up to the next record.
    before = F.last("last", True).over(earlier)
    carried = passed.groupBy("file", "split").agg(F.max("record").alias("last")).select("file", "split", before.alias("before"))
    named = passed.join(carried, ["file", "split"]).withColumn("record", F.coalesce("record", "before")).drop("before")
    return named.where(F.col("record").isNotNull())


def _record(value: Column) -> list[Column]:
    """Columns of a record from what follows its version line."""
    head = _head(value)
    length = _field(head, "Content-Length", "[0-9]{1,18}").cast("long")
    block = F.substring(value.cast("binary"), F.octet_length(head) + len(BLANK) + 1, length.cast("int")).cast("string")
    http = _head(block)
    kind = _field(head, "WARC-Type")
    payload = F.substring(block.cast("binary"), F.octet_length(http) + len(BLANK) + 1, F.octet_length(block))
    full = kind != "revisit"
    declared = F.replace(_field(head, "WARC-Payload-Digest"), F.lit("sha1:"))
    return [
        kind.alias("record_type"), _field(head, "WARC-Record-ID").alias("record_id"), _field(head, "WARC-Target-URI").alias("target_uri"),
        _field(head, "WARC-Refers-To").alias("refers_to"), F.when(full, payload).alias("payload"),
        F.when(full, F.octet_length(payload).cast("long")).otherwise(_field(http, "Content-Length", "[0-9]{1,18}").cast("long")).alias("payload_bytes"),
        F.when(full, digest(payload)).otherwise(declared).alias("payload_digest"),
        ((F.octet_length(block) == length) & (~full | (digest(payload) == declared))).alias("intact"),
    ]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files under `path`: file, offset, record_type, record_id, target_uri, refers_to,
    payload, payload_bytes, payload_digest, intact.

    Sizes and digests of payloads are measured, those of revisits are what they declare; a revisit has no payload.
    `intact` is false where a block is shorter than declared or a digest differs, null without a declared digest. A file
    that does not begin with a version line has no records; a chain that breaks ends with the record before the break.
    """
    pieces = _pieces(spark, path)
    owners = materialise(_owners(pieces), "owners")
    sizes = owners.groupBy("file", "record").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.where("n > 1").select("file", "record")
    one = owners.where("place = record").join(several, ["file", "record"], "left_anti").select("file", "split", "at", "record")
    offset = (F.col("record") - len(MAGIC)).alias("offset")
    # Fields are worked out before pieces move, so that payloads move only where they are asked for.
    plain = pieces.select("file", "split", "at", *_record(F.col("value"))).join(one, ["file", "split", "at"])
    # Written, so that Spark knows how few they are and need not move the other pieces.
    parts = materialise(owners.join(several, ["file", "record"], "left_semi"), "parts")
    cut = pieces.select("file", "split", "at", "value").join(parts, ["file", "split", "at"]).groupBy("file", "record").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col("value").alias("v")))), lambda p: p["v"]), MAGIC).alias("value")
    )
    columns = ["file", offset]
    whole = cut.select(*columns, *_record(F.col("value")))
    return plain.select(*columns, *[c for c in plain.columns if c not in ("file", "split", "at", "record")]).unionByName(whole)


def page_of(name: Column) -> Column:
    """The page id in a record's name; null where the page had none."""
    return F.nullif(F.regexp_extract(name, "^<urn:page:(-?[0-9]*):", 1), F.lit("")).cast("long")

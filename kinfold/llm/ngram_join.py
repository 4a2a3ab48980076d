"""Exact Jaccard join on word n-grams: grouped prefix join.

Documents with the same set of n-grams form a class. A class can only be linked if few of its n-grams are
its own, so a first pass counts, over all documents, in how many classes each n-gram of a third of the hash
space occurs; a class with more own n-grams there than a link allows to differ is out, whatever the rest
holds. What remains is ordered by the n-grams' frequency, rare ones first; two linked sets then share an
n-gram within their first `n - ceil(t n) + 1`. Classes with equal prefixes and size are collapsed into one
group, groups are filtered in pairs through the n-grams of their prefixes, and members are verified on
their whole sets.

Links are listed as far as they connect: candidates are first verified against one leader of each group
and each n-gram; of the rest, all whose ends are still in different components. So a group of near copies
costs verifications in proportion to its size, and no connection is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.components import components
from kinfold.llm.pairs import ARROW, SCHEMA, SEND_PAIRS, bucket_of, buckets_for, pack, runs, text_volume, unpack
from kinfold.llm.words import mix, slices, words_of
from kinfold.sources.workspace import materialise

# One hash class of this many is counted in the first pass: a document without near copies has a third of
# its n-grams there to itself, twice as many as a link at 0.85 allows.
CLASSES = 3
# Bytes of text for an n-gram, to size buckets before anything is counted.
BYTES_PER_GRAM = 6
# Rounds in which each n-gram gets another leader, before all pairs that are left are verified. They are made while
# members meet more often than so many times each; the result is the same without them.
STAR_ROUNDS, FEW_MEETINGS = 4, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_DIGEST = np.dtype([("both", "<u8"), ("row", "<u8"), ("null", "u1")])


def least_overlap(n, percent: int):
    """Smallest intersection that a set of n has with a set linked to it."""
    return (percent * n + 99) // 100


def gram_sets(column: pa.Array, width: int):
    """(offsets, distinct n-gram hashes of each text, class marks) of a large_string array.

    A text with fewer words than `width` has its whole sequence as one n-gram; one without words has none.
    """
    words = words_of(column)
    h, doc, n = words.hashes(), words.doc, words.per_doc()
    place = np.arange(len(doc)) - np.r_[0, np.cumsum(n)][doc]
    left = n[doc] - place
    grams = h.copy()
    for k in range(1, width):
        inside = np.flatnonzero(left > k)
        grams[inside] = mix(grams[inside] * _STEP + h[inside + k])
    whole = (left >= width) | (place == 0)
    grams, doc = grams[whole], doc[whole]
    ends = np.r_[0, np.cumsum(np.bincount(doc, minlength=words.docs))]
    sets = [_distinct(grams[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    total = np.r_[np.uint64(0), np.cumsum(mix(flat + _STEP))]
    marks = mix((total[offsets[1:]] - total[offsets[:-1]]) ^ np.diff(offsets).astype(np.uint64))
    return offsets, flat, marks


def _distinct(values):
    values = np.sort(values)
    return values[runs(values)]


def _flagged(batch: pa.RecordBatch, digest: bool) -> pa.RecordBatch:
    flag = pa.array([digest] * batch.num_rows, pa.bool_())
    return pa.RecordBatch.from_arrays([*batch.columns, flag], schema=ARROW.append(pa.field("digest", pa.bool_())))


def _spread(width: int, buckets: int, classes: int, chosen_classes: bool):
    """Pairs (class, n-gram) dealt out by n-gram, a class once a task.

    With `chosen_classes`, input rows name the class they stand for; otherwise every document also gives a
    digest (document, class, set size, counted n-grams, row, whether its id is null).
    """

    def task(batches):
        owners, keys, waiting, seen = [], [], 0, set()

        def packed():
            o, k = np.concatenate(owners), np.concatenate(keys)
            return _flagged(pack(o, k, np.zeros(len(k), np.uint8), bucket_of(k, buckets)), False)

        for batch in batches:
            # With nulls in it a column of ids would come as floats.
            ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False)
            null = pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False)
            line = batch.column("row").to_numpy(zero_copy_only=False).view(np.uint64)
            named = batch.column("mark").to_numpy(zero_copy_only=False).view(np.uint64) if chosen_classes else None
            for first, texts in slices(batch.column("text")):
                offsets, flat, marks = gram_sets(texts, width)
                sizes = np.diff(offsets)
                owner = np.repeat(np.arange(len(marks)), sizes)
                take = flat % np.uint64(classes) == 0
                if not chosen_classes:
                    counted = np.bincount(owner[take], minlength=len(marks))
                    own = ids[first:first + len(marks)].view(np.uint64)
                    digest = np.empty(len(marks), _DIGEST)
                    digest["both"] = sizes.astype(np.uint64) | (counted.astype(np.uint64) << np.uint64(32))
                    digest["row"], digest["null"] = line[first:first + len(marks)], null[first:first + len(marks)]
                    yield _flagged(pack(marks, own, digest, bucket_of(mix(digest["row"]), buckets)), True)
                fresh = np.zeros(len(marks), bool)
                for i, m in enumerate(marks.tolist()):
                    if m not in seen and (named is None or named[first + i] == marks[i]):
                        fresh[i] = True
                        seen.add(m)
                take &= fresh[owner]
                owners.append(marks[owner[take]])
                keys.append(flat[take])
                waiting += len(keys[-1])
                if waiting >= SEND_PAIRS:
                    yield packed()
                    owners, keys, waiting, seen = [], [], 0, set()
        if waiting:
            yield packed()

    return task


def _by_key(owners, keys):
    """Distinct pairs in order of key, and the number of owners of each pair's key."""
    order = np.lexsort((owners, keys))
    owners, keys = owners[order], keys[order]
    one = runs(keys, owners)
    owners, keys = owners[one], keys[one]
    df = np.diff(np.r_[runs(keys), len(keys)])
    return owners, keys, np.repeat(df, df)


DIGEST = "doc_id long, mark long, n long, counted long, shared long, row long"


def _shared_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """The digests, and for each class how many of its n-grams here another class has too (`n` is null)."""
    marks, ids, digest = unpack(rows[rows["digest"]], _DIGEST)
    both = digest["both"]
    digests = pa.table({
        "doc_id": pa.array(ids.view(np.int64), mask=digest["null"] == 1), "mark": marks.view(np.int64), "n": (both & _LOW).astype(np.int64),
        "counted": (both >> np.uint64(32)).astype(np.int64), "shared": np.zeros(len(ids), np.int64),
        "row": np.ascontiguousarray(digest["row"]).view(np.int64),
    })
    owners, _, df = _by_key(*unpack(rows[~rows["digest"]], "u1")[:2])
    marks, shared = np.unique(owners[df > 1], return_counts=True)
    nothing = pa.nulls(len(marks), pa.int64())
    counts = pa.table({
        "doc_id": nothing, "mark": marks.view(np.int64), "n": nothing, "counted": nothing,
        "shared": shared.astype(np.int64), "row": nothing,
    })
    return pa.concat_tables([digests, counts]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def _with_frequency(buckets: int):
    """Pairs with the number of classes of their n-gram, dealt out by class."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        owners, keys, df = _by_key(*unpack(rows, "u1")[:2])
        order = np.argsort(owners, kind="stable")
        owners = owners[order]
        return pack(owners, keys[order], df[order].astype(np.uint32), bucket_of(owners, buckets)).to_pandas()

    return reduce


def _ordered_sets(percent: int):
    """Whole sets in order of (frequency, hash), of the classes that may still be linked."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        owners, keys, df = unpack(rows, "u4")
        order = np.lexsort((keys, df, owners))
        owners, keys, df = owners[order], keys[order], df[order]
        head = runs(owners)
        out = []
        for a, b in zip(head, np.r_[head[1:], len(owners)]):
            own, n = int((df[a:b] == 1).sum()), int(b - a)
            if n - own >= least_overlap(n, percent):
                out.append((int(owners[a:a + 1].view(np.int64)[0]), n, own, keys[a:b].tobytes()))
        return pd.DataFrame(out, columns=["mark", "n", "own", "grams"])

    return reduce


def _prefixes(percent: int):
    """The part of each prefix that others may share, and the group: equal shared prefixes, sizes and own counts."""

    def task(batches):
        for pdf in batches:
            marks, groups, n, own, parts = [], [], [], [], []
            for r in pdf.itertuples():
                part = np.frombuffer(r.grams, np.uint64)[r.own:r.n - least_overlap(r.n, percent) + 1]
                if len(part):
                    total = np.cumsum(mix(part + _STEP))[-1:] ^ np.uint64(r.n * 2654435761 + r.own)
                    marks.append(r.mark)
                    groups.append(int(mix(total).view(np.int64)[0]))
                    n.append(r.n)
                    own.append(r.own)
                    parts.append(part.view(np.int64))
            yield pd.DataFrame({"mark": marks, "grp": groups, "n": n, "own": own, "grams": parts})

    return task


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, linked) of pairs of classes, on their whole sets."""

    def overlap(batches):
        for pdf in batches:
            linked = []
            for a, b in zip(pdf["grams_u"], pdf["grams_v"]):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pd.DataFrame({"u": pdf["u"], "v": pdf["v"], "linked": linked})

    whole = sets.select("mark", "grams")
    return (
        pairs.join(whole.select(F.col("mark").alias("u"), F.col("grams").alias("grams_u")), "u")
        .join(whole.select(F.col("mark").alias("v"), F.col("grams").alias("grams_v")), "v")
        .mapInPandas(overlap, "u long, v long, linked boolean")
    )


def _possible(percent: int, x: str, y: str):
    """Whether two sets may be linked whose first common n-gram this is: at most what is left from there is common.

    `at` counts the n-grams before it in the whole set. A linked pair passes at its first common n-gram, so testing
    every n-gram in which prefixes meet loses none.
    """
    def c(side, name):
        return F.col(f"{side}.{name}")

    small, large = F.least(c(x, "n"), c(y, "n")), F.greatest(c(x, "n"), c(y, "n"))
    left = F.least(c(x, "n") - c(x, "at"), c(y, "n") - c(y, "at"))
    return (100 * small >= percent * large) & ((100 + percent) * left >= percent * (small + large))


def _enough(percent: int):
    """Whether the prefixes of x and y have enough in common for a link.

    What they share outside both prefixes lies beyond the one that ends first, so it is at most the rest of a set
    after its prefix.
    """
    common = F.size(F.array_intersect(F.col("x.grams"), F.col("y.grams")))
    after = F.greatest(*[F.expr(f"({percent} * {s}.n + 99) div 100 - 1") for s in ("x", "y")])
    return (100 + percent) * (common + after) >= percent * (F.col("x.n") + F.col("y.n"))


def _first():
    """Whether x and y meet in this n-gram for the first time."""
    before = [F.slice(F.col(f"{s}.grams"), F.lit(1), F.col(f"{s}.at") - F.col(f"{s}.own")) for s in ("x", "y")]
    return ~F.arrays_overlap(*before)


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(f"{a} <> {b}").select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def classes_and_links(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"):
    """(documents, links): each document's class and set size; verified links (u, v) that connect the classes."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # A row is found again by its id and text, so neither a null id nor other texts of its id are in the way.
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    buckets = buckets_for(text_volume(docs) / BYTES_PER_GRAM / CLASSES)
    spread = docs.mapInArrow(_spread(width, buckets, CLASSES, False), SCHEMA + ", digest boolean")
    counted = materialise(spread.groupBy("bucket").applyInPandas(_shared_counts, DIGEST), "counted")
    documents = counted.where("n is not null").select("doc_id", "mark", "n")

    need = f"(({percent} * n + 99) div 100)"
    classes = counted.groupBy("mark").agg(
        F.min("row").alias("row"), F.max("n").alias("n"), F.max("counted").alias("counted"), F.sum("shared").alias("shared")
    )
    open_classes = classes.where(f"n > 0 and counted - shared <= n - {need}").select("row", "mark")
    again = docs.join(open_classes, "row")
    sets = materialise(
        again.mapInArrow(_spread(width, buckets, 1, True), SCHEMA + ", digest boolean").drop("digest")
        .groupBy("bucket").applyInPandas(_with_frequency(buckets), SCHEMA)
        .groupBy("bucket").applyInPandas(_ordered_sets(percent), "mark long, n int, own int, grams binary"),
        "sets",
    )

    prefixes = materialise(sets.mapInPandas(_prefixes(percent), "mark long, grp long, n int, own int, grams array<long>"), "prefixes")
    groups = prefixes.groupBy("grp").agg(
        F.min("mark").alias("leader"), F.first("n").alias("n"), F.first("own").alias("own"), F.first("grams").alias("grams")
    )
    meet = groups.select("grp", "leader", "n", "own", F.posexplode("grams").alias("k", "gram")).withColumn("at", F.col("own") + F.col("k"))
    star = meet.groupBy("gram").agg(F.min(F.struct("own", "leader", "n", "at")).alias("s")).select("gram", "s.*")
    within = prefixes.join(groups.select("grp", "leader"), "grp").select("mark", "leader")
    between = (
        meet.alias("x").join(star.alias("y"), F.col("x.gram") == F.col("y.gram")).where(_possible(percent, "x", "y"))
        .select(F.col("x.leader").alias("mark"), F.col("y.leader").alias("leader"))
    )
    tried = materialise(_verify(_ordered(within.unionByName(between), "mark", "leader"), sets, percent), "tried")
    links = tried.where("linked").select("u", "v")

    rest, crowded = _parted(prefixes, links)
    for turn in range(STAR_ROUNDS):
        if not crowded:
            break
        # Another leader of each n-gram, drawn by hash.
        draw = rest.groupBy("gram").agg(F.min(F.struct(F.xxhash64("mark", "gram", F.lit(turn)), "mark")).alias("s"))
        leaders = rest.join(draw.select("gram", F.col("s.mark").alias("chosen")), "gram").where("mark = chosen")
        star = (
            rest.alias("x").join(leaders.alias("y"), F.col("x.gram") == F.col("y.gram"))
            .where("x.component <> y.component").where(_possible(percent, "x", "y"))
            .select(F.col("x.mark").alias("a"), F.col("y.mark").alias("b"))
        )
        new = materialise(_verify(_untried(star, tried), sets, percent), "tried")
        tried, links = tried.unionByName(new), links.unionByName(new.where("linked").select("u", "v"))
        rest, crowded = _parted(prefixes, links)
    meets = F.col("x.component") < F.col("y.component")
    if crowded:
        # Whole prefixes go along where many pairs meet often, so that each pair is made once and most are refuted.
        rest = rest.join(prefixes.select("mark", "grams"), "mark")
        meets = meets & _possible(percent, "x", "y") & _first() & _enough(percent)
    else:
        meets = meets & _possible(percent, "x", "y")
    pairs = rest.alias("x").join(rest.alias("y"), "gram").where(meets).select(F.col("x.mark").alias("a"), F.col("y.mark").alias("b"))
    more = _verify(_untried(pairs, tried), sets, percent).where("linked").select("u", "v")
    return documents, materialise(links.unionByName(more), "links")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    return _ordered(pairs, "a", "b").join(tried.select("u", "v"), ["u", "v"], "left_anti")


def _parted(prefixes: DataFrame, links: DataFrame):
    """Rows (mark, n, own, component, gram, at) of the n-grams whose members are in several components, and whether
    members meet there more than FEW_MEETINGS times each."""
    joined = components(links)
    members = (
        prefixes.join(joined, F.col("mark") == F.col("node"), "left")
        .select("mark", "n", "own", F.coalesce("component", "mark").alias("component"), F.posexplode("grams").alias("k", "gram"))
        .withColumn("at", F.col("own") + F.col("k")).drop("k")
    )
    parted = members.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gram")
    rest = materialise(members.join(parted, "gram"), "rest")
    by_gram = rest.groupBy("gram").agg(F.count(F.lit(1)).cast("double").alias("m"))
    rows, meetings = by_gram.agg(F.sum("m"), F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()
    return rest, bool(rows) and meetings > FEW_MEETINGS * rows


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `doc_id`, `n_shingles` (set size), `component_id` (smallest doc_id reachable by links).

    Two documents link when 100 * intersection >= percent * union of their sets of `width` lower-cased words.
    Null and empty texts, and texts without words, have an empty set and their own doc_id as component. Rows
    that repeat a doc_id are rows of one document and link what each of their texts links. An empty table gives
    an empty result; other columns are ignored. A null id counts as the smallest.
    """
    documents, links = classes_and_links(docs, width, percent, id_col, text_col)
    joined = components(links.unionByName(_of_one_document(documents)))
    classes = (
        documents.where("n > 0").groupBy("mark").agg(_smallest("doc_id").alias("first"))
        .join(joined, F.col("mark") == F.col("node"), "left")
        .select("mark", "first", F.coalesce("component", "mark").alias("component"))
    )
    least = classes.groupBy("component").agg(_smallest("first").alias("component_id"))
    named = classes.join(least, "component").select(F.col("mark").alias("class_mark"), "component_id")
    filled = documents.where("n > 0").join(named, F.col("mark") == F.col("class_mark")).select("doc_id", "n", "component_id")
    # A row with an empty set is in the component of its document's other rows, if it has any.
    empty = documents.where("n = 0").select("doc_id", "n")
    others = (
        filled.join(empty.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
        .groupBy("doc_id").agg(_smallest("component_id").alias("component_id")).select(F.col("doc_id").alias("own"), "component_id", F.lit(True).alias("found"))
    )
    alone = empty.join(others, F.col("doc_id") == F.col("own"), "left").select(
        "doc_id", "n", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return filled.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _of_one_document(documents: DataFrame) -> DataFrame:
    """Links (u, v) between the classes of one doc_id. Null needs none: each of its components has null as smallest id."""
    named = documents.where("n > 0 and doc_id is not null")
    several = named.groupBy("doc_id").agg(F.min("mark").alias("u"), F.max("mark").alias("v")).where("u < v").select("doc_id", "u")
    return named.join(several, "doc_id").select("u", F.col("mark").alias("v")).where("u <> v").distinct()


def _smallest(column: str):
    """The smallest value, where null comes first."""
    return F.min(F.struct(column))[column]


def keep_one_of_each(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The documents whose id is the smallest of their component, with all their columns, whatever their names.

    Null is an id like others and comes first, so all rows of a null id stay. Null and empty texts are linked with nothing
    and stay; rows that repeat an id stay or go together. An empty table gives an empty result.
    """
    found = jaccard_components(docs, width, percent)
    stay = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("kin_stays")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("kin_stays")), "left_semi")

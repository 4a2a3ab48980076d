"""Ordered-pair operators in sparse form.

A pair of people without any tie between them has zero in every relation column, so
only tied pairs are stored: O(ties) rows instead of the sum of N_g^2. Totals over all
ordered pairs of a group follow in closed form from group and household sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.columns import add_all, pair_key, require, unordered_pair_key
from kinfold.functions.values import CATEGORIES, RELATIONS
from kinfold.operators.heavy import frequent_keys, hub_join
from kinfold.sources.workspace import materialise


def kept_nominations(nominations: DataFrame, kinds=RELATIONS) -> DataFrame:
    """Nominations of the analysed kinds, with the display key of the ordered pair."""
    require(nominations, "i_id", "j_id", "type")
    return nominations.where(F.col("type").isin(*kinds)).withColumn(
        "ij_id", pair_key(F.col("i_id"), F.col("j_id"))
    )


def _multiplicity(nominations: DataFrame):
    return F.col("n") if "n" in nominations.columns else F.lit(1).cast("long")


def relation_counts(nominations: DataFrame, dedupe: bool = False, kinds=RELATIONS) -> DataFrame:
    """One row per ordered pair with the number of nominations of each kind.

    A frame that already counts repeats carries them in a column `n`. Repeats stay in
    the counts unless `dedupe`, which makes every count 0 or 1.
    """
    require(nominations, "i_id", "j_id", "type")
    n = _multiplicity(nominations)

    def column(kind):
        hit = F.when(F.col("type") == kind, F.lit(1).cast("long") if dedupe else n).otherwise(F.lit(0).cast("long"))
        return (F.max(hit) if dedupe else F.sum(hit)).alias(kind)

    return (
        nominations.where(F.col("type").isin(*kinds))
        .groupBy("i_id", "j_id")
        .agg(*[column(k) for k in kinds])
    )


def within_group_pairs(pairs: DataFrame, respondents: DataFrame) -> DataFrame:
    """Keep pairs of two different respondents of one group; adds group and co-residence.

    A missing household is shared with nobody. People at the end of very many pairs are found by a sketch of both ends
    and looked up by broadcast.
    """
    require(respondents, "id", "group_id", "hh_id")
    pairs = materialise(pairs.where(F.col("i_id") != F.col("j_id")), "pairs")
    frequent = frequent_keys(pairs, ["i_id", "j_id"])

    def end(key, group, household):
        table = respondents.select(F.col("id").alias(key), F.col("group_id").alias(group), F.col("hh_id").alias(household))
        return table, key, frequent.where(F.col("name") == key)

    return (
        hub_join(hub_join(pairs, *end("i_id", "group_id", "hh_i")), *end("j_id", "group_j", "hh_j"))
        .where(F.col("group_id") == F.col("group_j"))
        .withColumn("coresident", F.coalesce((F.col("hh_i") == F.col("hh_j")).cast("long"), F.lit(0).cast("long")))
        .drop("hh_i", "hh_j", "group_j")
    )


def tied_dyads(nominations: DataFrame, respondents: DataFrame, dedupe: bool = False) -> DataFrame:
    """Every ordered pair with a tie in either direction, with all relation columns.

    Each counted pair is mirrored before one aggregation on (i, j); this brings the
    reverse edge without joining the pair table to itself.
    """
    pairs = within_group_pairs(relation_counts(nominations, dedupe), respondents)
    zero = F.lit(0).cast("long")

    def side(i, j, forward):
        given = [F.col(k) if forward else zero for k in RELATIONS]
        back = [zero if forward else F.col(k) for k in ("lender", "family")]
        names = ["lender_ij", "family_nom_ij", "friend_ij", "lender_ji", "family_nom_ji"]
        return F.struct(
            F.col(i).alias("i_id"), F.col(j).alias("j_id"),
            *[c.alias(n) for c, n in zip(given + back, names)],
        )

    mirrored = pairs.select(
        "group_id", "coresident",
        F.explode(F.array(side("i_id", "j_id", True), side("j_id", "i_id", False))).alias("d"),
    ).select("group_id", "coresident", "d.*")
    sums = ["lender_ij", "lender_ji", "friend_ij", "family_nom_ij", "family_nom_ji"]
    dyads = mirrored.groupBy("group_id", "i_id", "j_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("coresident").alias("coresident")
    )
    kin = F.greatest("family_nom_ij", "family_nom_ji", "coresident") > 0
    return dyads.withColumn("family_ij", kin.cast("long"))


def pair_keys(dyads: DataFrame) -> DataFrame:
    i, j = F.col("i_id"), F.col("j_id")
    return dyads.select(
        "i_id", "j_id", pair_key(i, j).alias("ij_id"), unordered_pair_key(i, j).alias("unordered_ij_id")
    )


def profile_of_all_pairs(profiled: DataFrame, respondents: DataFrame) -> DataFrame:
    """A profile of the tied pairs, counted over *all* ordered pairs: untied ones have no missing value."""
    sizes = respondents.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0
    more = F.lit(pairs) - F.col("row_count")
    return profiled.withColumn("non_null", F.col("non_null") + more).withColumn("row_count", F.col("row_count") + more)


def dyad_totals(dyads: DataFrame, respondents: DataFrame) -> DataFrame:
    """Per group: column totals over *all* ordered pairs, tied or not, without listing them.

    Untied pairs add nothing but co-residence, whose total is the sum of h(h-1) over
    households.
    """
    sizes = (
        respondents.groupBy("group_id", "hh_id").agg(F.count(F.lit(1)).alias("h"))
        .groupBy("group_id")
        .agg(
            F.sum("h").alias("members"),
            F.sum(F.when(F.col("hh_id").isNotNull(), F.col("h") * (F.col("h") - 1)).otherwise(0)).alias("coresidents"),
        )
    )
    tied = dyads.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("tied"),
        F.sum("lender_ij").alias("lender_ij"),
        F.sum("lender_ji").alias("lender_ji"),
        F.sum("friend_ij").alias("friend_ij"),
        F.sum("family_ij").alias("tied_kin"),
        F.sum("coresident").alias("tied_coresidents"),
    )
    filled = sizes.join(tied, "group_id", "left").fillna(0)
    return filled.select(
        "group_id", "members",
        (F.col("members") * (F.col("members") - 1)).alias("dyads"),
        "tied", "lender_ij", "lender_ji", "friend_ij",
        (F.col("tied_kin") + F.col("coresidents") - F.col("tied_coresidents")).alias("family_ij"),
        "coresidents",
    )


def lender_category():
    """The exclusive type of a lender edge; null when a flag is not 0 or 1."""
    friend, kin, owed = F.col("friend_ij"), F.col("family_ij"), F.col("lender_ji")
    binary = (F.col("lender_ij") == 1) & friend.isin(0, 1) & kin.isin(0, 1) & owed.isin(0, 1)
    code = friend + 2 * kin + 4 * owed
    # Type by code friend + 2 kin + 4 indebted.
    names = (
        "stranger_lender_ij", "friend_lender_ij", "family_lender_ij", "friend_family_lender_ij",
        "lender_ij_lender_ji", "friend_lender_ij_lender_ji", "family_lender_ij_lender_ji",
        "friend_family_lender_ij_lender_ji",
    )
    return F.when(binary, F.element_at(F.array(*[F.lit(n) for n in names]), (code + 1).cast("int")))


def taxonomy(dyads: DataFrame) -> DataFrame:
    """Lender edges with their exclusive type."""
    return dyads.where(F.col("lender_ij") > 0).select(
        "group_id", "i_id", "j_id", "lender_ij", "friend_ij", "family_ij", "lender_ji",
        lender_category().alias("category"),
    )


def composition(dyads: DataFrame, respondents: DataFrame) -> DataFrame:
    """Per respondent: out- and in-degree for lending and the count of each lender type.

    A respondent without any tie gets zeros.
    """
    typed = dyads.withColumn("category", F.when(F.col("lender_ij") > 0, lender_category()))
    per_ego = typed.groupBy(F.col("i_id").alias("id")).agg(
        F.sum("lender_ij").alias("lender_ij"),
        F.sum("lender_ji").alias("lender_ji"),
        *[F.sum((F.coalesce(F.col("category") == c, F.lit(False))).cast("long")).alias(c) for c in CATEGORIES],
    )
    counts = ["lender_ij", "lender_ji", *CATEGORIES]
    return respondents.join(per_ego, "id", "left").fillna(0, subset=counts)


def type_total():
    return add_all([F.col(c) for c in CATEGORIES])


def composition_check(composed: DataFrame) -> DataFrame:
    """Respondents checked, and those whose type counts do not sum to their lenders."""
    return composed.agg(
        F.count(F.lit(1)).alias("respondents"),
        F.count(F.when(type_total() != F.col("lender_ij"), 1)).alias("violations"),
    )


def modelled(composed: DataFrame) -> DataFrame:
    """The analysis sample: at least one lender, then sex known."""
    return composed.where(F.col("lender_ij") > 0).where(F.col("female").isNotNull())


def exclusions(composed: DataFrame) -> DataFrame:
    """Counts behind the two exclusions; the second is among those kept by the first."""
    lends = F.col("lender_ij") > 0
    steps = F.array(
        F.struct(F.lit("has_lender").alias("criterion"), lends.alias("flag")),
        F.struct(F.when(lends, F.lit("sex_missing")).alias("criterion"), F.col("female").isNull().alias("flag")),
    )
    return (
        composed.select(F.explode(steps).alias("s")).select("s.*")
        .where(F.col("criterion").isNotNull())
        .groupBy("criterion", "flag").agg(F.count(F.lit(1)).alias("respondents"))
    )


def multiplexity(composed: DataFrame) -> DataFrame:
    """Edges and naming respondents of each type."""
    return (
        composed.unpivot(["id"], list(CATEGORIES), "category", "y")
        .groupBy("category")
        .agg(F.sum("y").alias("edges"), F.count(F.when(F.col("y") > 0, 1)).alias("respondents"))
    )


def count_histogram(composed: DataFrame) -> DataFrame:
    """How many respondents have y lenders of a type, zero-filled to the union of y values."""
    wide = (
        composed.unpivot(["id"], list(CATEGORIES), "category", "y")
        .groupBy("y").pivot("category", list(CATEGORIES)).agg(F.count(F.lit(1)))
        .fillna(0)
    )
    return wide.unpivot(["y"], list(CATEGORIES), "category", "respondents").select("category", "y", "respondents")


def nomination_shares(nominations: DataFrame, respondents: DataFrame, kinds=("lender", "friend"), n_respondents=None) -> DataFrame:
    """Share of all respondents that name k people of a kind.

    Only people who make a nomination of some analysed kind are counted, over the
    number of all respondents, so shares need not sum to one.
    """
    n = _multiplicity(nominations)
    per_ego = (
        nominations.where(F.col("type").isin(*RELATIONS))
        .groupBy("i_id")
        .agg(*[F.sum(F.when(F.col("type") == k, n).otherwise(0)).alias(k) for k in kinds])
    )
    freq = (
        per_ego.unpivot(["i_id"], list(kinds), "type", "named")
        .groupBy("type", "named").agg(F.count(F.lit(1)).alias("nominators"))
    )
    if n_respondents is not None:
        return freq.withColumn("share", F.col("nominators") / F.lit(n_respondents))
    spark = freq.sparkSession
    return spark.sql(
        "SELECT type, named, nominators, nominators / (SELECT count(*) FROM {people}) AS share FROM {freq}",
        people=respondents, freq=freq,
    )

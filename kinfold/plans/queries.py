"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.columns import ordinal
from kinfold.functions.values import CATEGORIES, NA_TOKENS, N_CATEGORIES
from kinfold.operators import crossval, diagnostics, draws, likelihood, network, predictive, ranks, report, sampler, tables
from kinfold.plans.bootstrap import DRAWS, bootstrap
from kinfold.plans.fixtures import Survey
from kinfold.sources import survey as sources
from kinfold.sources.workspace import materialise, scratch_path

DIGITS = 6
# How far a posterior mean may lie from the pooled share: the prior and a key's few lenders draw it away.
NEAR, NEAR_BY_LENDERS = 0.02, 1.5


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that the last bits of a sum's order do not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class Fitted(Survey):
    """A survey with bootstrap draws, each written once."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        self.rows = materialise(self.sample(), "sample")
        self.vectors, self.hyper = bootstrap(self.rows)

    def long(self):
        return draws.long_draws(self.vectors, self.hyper)

    def stacked(self):
        return draws.stack_models(draws.posterior_table(self.long()), draws.parameter_order(self.respondents))

    def predicted(self):
        return predictive.predict(likelihood.with_models(self.rows), self.vectors)

    def frequencies(self):
        cells = predictive.predict_cells(likelihood.with_models(self.rows), self.vectors)
        return predictive.compare_observed(predictive.frequency_summary(cells, 4 * DRAWS), self.rows)


# Surveys written before, by folder: the bench prepares its inputs outside the clock.
PREPARED: dict[str, Fitted] = {}


def fitted(spark, sf_dir) -> Fitted:
    return PREPARED.get(sf_dir) or Fitted(spark, sf_dir)


QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Sources and projections


@query
def scan_csv_na(spark, sf_dir):
    p = Survey(spark, sf_dir).primary()
    tokens = F.array(*[F.lit(t) for t in NA_TOKENS])
    token = tokens[(F.col("id").cast("long") % len(NA_TOKENS)).cast("int")]
    path = scratch_path(spark, "nodes")
    p.select(
        F.col("group_id").alias("villageId"), F.lit("x").alias("unused"), F.col("id").alias("i"),
        F.coalesce(F.col("female").cast("string"), token).alias("female"),
    ).write.option("header", True).csv(path)
    return sources.read_primary(spark, path)


@query
def scan_csv_limited(spark, sf_dir):
    """A scan of the first 100 rows: how many it read, and how many of them are rows of the file."""
    p = Survey(spark, sf_dir).primary()
    path = scratch_path(spark, "nodes")
    p.select(F.col("group_id").alias("villageId"), F.col("id").alias("i"), "female").write.option("header", True).csv(path)
    first = materialise(sources.read_primary(spark, path, limit=100), "first")
    every = p.select("id", "group_id", F.coalesce("female", F.lit(-1)).alias("female"))
    known = first.select("id", "group_id", F.coalesce("female", F.lit(-1)).alias("female")).join(every, ["id", "group_id", "female"], "left_semi")
    return first.agg(F.count(F.lit(1)).alias("read")).crossJoin(known.agg(F.count(F.lit(1)).alias("known")))


@query
def draws_snapshot(spark, sf_dir):
    f = fitted(spark, sf_dir)
    path = scratch_path(spark, "snapshot")
    sources.write_draws(f.long(), path)
    back = sources.read_draws(spark, path)
    return rounded(back.select("model", "chain", "draw", "parameter", "category", "value"))


@query
def snapshot_intervals(spark, sf_dir):
    """Means and intervals of a snapshot, in the distribution it is written in."""
    path = scratch_path(spark, "snapshot")
    sources.write_draws(fitted(spark, sf_dir).long(), path)
    back = sources.read_draws(spark, path)
    return rounded(draws.hdi_wide(draws.hdi_in_place(back)).join(draws.posterior_means(back), draws.SERIES))


@query
def profile_respondents(spark, sf_dir):
    return tables.profile(Survey(spark, sf_dir).respondents.select("id", "group_id", "female", "group_txt", "hh_id"))


@query
def profile_dyads(spark, sf_dir):
    s = Survey(spark, sf_dir)
    return network.profile_of_all_pairs(tables.profile(s.dyads().select("i_id", "j_id", "lender_ij", "lender_ji", "friend_ij", "family_ij")), s.respondents)


@query
def profile_composition(spark, sf_dir):
    return tables.profile(Survey(spark, sf_dir).composed().select("id", "lender_ij", "lender_ji", *CATEGORIES))


@query
def respondents_primary(spark, sf_dir):
    return Survey(spark, sf_dir).primary()


@query
def respondents(spark, sf_dir):
    return Survey(spark, sf_dir).respondents


@query
def nominations_kept(spark, sf_dir):
    return network.kept_nominations(Survey(spark, sf_dir).nominations)


@query
def relation_types(spark, sf_dir):
    return network.kept_nominations(Survey(spark, sf_dir).nominations).select("type").distinct()


@query
def group_ids(spark, sf_dir):
    return Survey(spark, sf_dir).respondents.select("group_id").distinct()


@query
def dup_edges(spark, sf_dir):
    kept = network.kept_nominations(Survey(spark, sf_dir).nominations)
    return tables.duplicate_keys(kept, ["i_id", "j_id", "type"], weight="n")


@query
def dedupe_rows(spark, sf_dir):
    return tables.distinct_rows(Survey(spark, sf_dir).nominations.select("group_id", "i_id", "type"))


@query
def relation_pivot(spark, sf_dir):
    return network.relation_counts(Survey(spark, sf_dir).nominations)


# Ordered pairs


@query
def dyads_tied(spark, sf_dir):
    return network.pair_keys(Survey(spark, sf_dir).dyads())


@query
def dyad_totals(spark, sf_dir):
    s = Survey(spark, sf_dir)
    return network.dyad_totals(s.dyads(), s.respondents)


@query
def dyads_relations(spark, sf_dir):
    return Survey(spark, sf_dir).dyads().select("i_id", "j_id", "lender_ij", "friend_ij", "family_nom_ij")


@query
def reciprocity(spark, sf_dir):
    return Survey(spark, sf_dir).dyads().select("i_id", "j_id", "lender_ij", "lender_ji")


@query
def coresidence(spark, sf_dir):
    return Survey(spark, sf_dir).dyads().select("i_id", "j_id", "coresident")


@query
def kinship(spark, sf_dir):
    return Survey(spark, sf_dir).dyads().select("i_id", "j_id", "family_nom_ij", "family_nom_ji", "coresident", "family_ij")


@query
def lender_taxonomy(spark, sf_dir):
    return network.taxonomy(Survey(spark, sf_dir).dyads())


# Compositions


@query
def composition(spark, sf_dir):
    return Survey(spark, sf_dir).composed().select(
        "id", "group_id", "female", "group_txt", "hh_id", "lender_ij", "lender_ji", *CATEGORIES
    )


@query
def composition_audit(spark, sf_dir):
    s = Survey(spark, sf_dir)
    distinct = network.composition_check(s.composed()).withColumn("ties", F.lit("distinct"))
    repeated = network.composition_check(s.composed(dedupe=False)).withColumn("ties", F.lit("repeated"))
    return distinct.unionByName(repeated)


@query
def degree(spark, sf_dir):
    return Survey(spark, sf_dir).composed().select(
        "id", F.col("lender_ij").alias("out_degree"), F.col("lender_ji").alias("in_degree")
    )


@query
def multiplexity(spark, sf_dir):
    return network.multiplexity(Survey(spark, sf_dir).composed())


@query
def category_dim(spark, sf_dir):
    edges = network.taxonomy(Survey(spark, sf_dir).dyads()).groupBy("category").agg(F.count(F.lit(1)).alias("edges"))
    return edges.withColumn("category_order", ordinal(F.col("category"), CATEGORIES))


@query
def count_histogram(spark, sf_dir):
    return network.count_histogram(Survey(spark, sf_dir).composed())


@query
def exclusion_audit(spark, sf_dir):
    return network.exclusions(Survey(spark, sf_dir).composed())


@query
def modelled_respondents(spark, sf_dir):
    return Survey(spark, sf_dir).sample().select("id", "group_id", "female", "lender_ij", *CATEGORIES)


@query
def lender_total(spark, sf_dir):
    return Survey(spark, sf_dir).sample().agg(F.sum("lender_ij").alias("lenders"))


@query
def group_sizes(spark, sf_dir):
    return tables.frequency(Survey(spark, sf_dir).sample(), "group_id", "respondents")


@query
def group_members(spark, sf_dir):
    people = Survey(spark, sf_dir).respondents.select("group_id", "id")
    return ranks.ranked(people, ["group_id"], ["id"], "members").select(
        "group_id", F.col("rank0").alias("position"), "id", F.col("total").alias("members")
    )


@query
def group_codes(spark, sf_dir):
    return ranks.dense_codes(Survey(spark, sf_dir).sample(), "group_id")


@query
def model_shape(spark, sf_dir):
    return Survey(spark, sf_dir).sample().agg(
        F.count(F.lit(1)).alias("n"), F.lit(N_CATEGORIES).alias("k"), F.countDistinct("group_id").alias("g")
    )


@query
def max_nominations(spark, sf_dir):
    s = Survey(spark, sf_dir)
    return rounded(network.nomination_shares(s.nominations, s.respondents))


@query
def param_dim(spark, sf_dir):
    return draws.parameter_dim(Survey(spark, sf_dir).respondents)


@query
def param_sex_split(spark, sf_dir):
    dim = draws.parameter_dim(Survey(spark, sf_dir).respondents).where(F.col("model") == "Sex")
    return draws.split_sex(dim.select(F.col("parameter").alias("name"), "parameter"))


# Likelihood and sampling


@query
def dm_suffstats(spark, sf_dir):
    return likelihood.tail_counts(Survey(spark, sf_dir).sample())


@query
def group_proportions(spark, sf_dir):
    return rounded(likelihood.group_proportions(Survey(spark, sf_dir).sample()))


@query
def dm_loglik(spark, sf_dir):
    f = fitted(spark, sf_dir)
    rows = likelihood.with_models(f.rows)
    return rounded(likelihood.log_likelihood(rows, f.vectors).select("model", "id", "chain", "draw", "ll"))


@query
def conc_log_prior(spark, sf_dir):
    f = fitted(spark, sf_dir)
    return rounded(likelihood.parameter_log_prior(f.vectors, f.hyper))


@query
def hyper_log_prior(spark, sf_dir):
    f = fitted(spark, sf_dir)
    return rounded(likelihood.log_prior(f.hyper).select("model", "chain", "draw", "log_prior_alpha", "log_prior_lambda"))


@query
def posterior_draws(spark, sf_dir):
    tails = likelihood.tail_counts(Survey(spark, sf_dir).sample())
    return draws.long_draws(*sampler.fit(tails, sampler.RunLength(draws=100, tune=300)))


@query
def posterior_invariants(spark, sf_dir):
    """Per series of the sampled posterior: its number of draws, values outside the support, whether shares add up to 1,
    and whether a share's mean is near the pooled share of its key, within NEAR + NEAR_BY_LENDERS / sqrt(lenders)."""
    sample = materialise(Survey(spark, sf_dir).sample(), "sample")
    tails = likelihood.tail_counts(sample)
    long = materialise(draws.long_draws(*sampler.fit(tails, sampler.RunLength(draws=100, tune=300))), "long")
    share = F.col("parameter").startswith("frac")
    wrong = F.when(share, ~F.col("value").between(0, 1)).otherwise(F.col("value") <= 0)
    sums = long.where(share).groupBy("model", "chain", "draw", "parameter").agg(F.sum("value").alias("s"))
    added = sums.groupBy("model", "parameter").agg(F.min((F.abs(F.col("s") - 1) < 1e-9).cast("int")).alias("ok"))
    series = long.groupBy("model", "parameter", "category").agg(
        F.count(F.lit(1)).cast("int").alias("n_draws"), F.sum((wrong | F.col("value").isNull()).cast("int")).cast("int").alias("outside")
    )
    pooled = likelihood.group_proportions(sample).select("model", F.concat(F.lit("frac"), "key").alias("parameter"), "category", "lenders", "proportion")
    means = draws.posterior_means(long.where(share)).join(pooled, draws.SERIES)
    apart = F.abs(F.col("pmean") - F.col("proportion"))
    near = means.select(*draws.SERIES, (apart <= NEAR + NEAR_BY_LENDERS / F.sqrt("lenders")).cast("int").alias("near_pooled"))
    return series.join(added.select("model", "parameter", "ok"), ["model", "parameter"], "left").join(near, draws.SERIES, "left").select(
        "model", "parameter", "category", "n_draws", "outside", F.coalesce("ok", F.lit(0)).alias("shares_add_up"), "near_pooled"
    )


# Draws


@query
def draws_explode(spark, sf_dir):
    f = fitted(spark, sf_dir)
    return rounded(draws.explode_draws(f.vectors, f.hyper))


@query
def draws_long(spark, sf_dir):
    return rounded(fitted(spark, sf_dir).long())


@query
def posterior_means(spark, sf_dir):
    return rounded(draws.posterior_means(fitted(spark, sf_dir).long()))


@query
def hdi(spark, sf_dir):
    return rounded(draws.hdi(fitted(spark, sf_dir).long()))


@query
def hdi_wide(spark, sf_dir):
    return rounded(draws.hdi_wide(draws.hdi(fitted(spark, sf_dir).long())))


@query
def posterior_table(spark, sf_dir):
    return rounded(draws.posterior_table(fitted(spark, sf_dir).long()))


@query
def model_stack(spark, sf_dir):
    return rounded(fitted(spark, sf_dir).stacked())


@query
def reported_lookup(spark, sf_dir):
    return rounded(report.lookup(fitted(spark, sf_dir).stacked()))


@query
def reported_subsets(spark, sf_dir):
    return rounded(report.subset_sums(fitted(spark, sf_dir).stacked()))


@query
def village_ranking(spark, sf_dir):
    return rounded(report.village_ranking(fitted(spark, sf_dir).stacked()))


@query
def fig_parallel(spark, sf_dir):
    return rounded(report.figure_parallel(fitted(spark, sf_dir).stacked()))


@query
def fig_fractions(spark, sf_dir):
    return rounded(report.figure_fractions(fitted(spark, sf_dir).stacked()))


@query
def fig_concentration(spark, sf_dir):
    return rounded(report.figure_concentration(fitted(spark, sf_dir).stacked()))


# Diagnostics


@query
def rhat_split(spark, sf_dir):
    return rounded(diagnostics.rhat_split(fitted(spark, sf_dir).long()))


@query
def rhat_rank(spark, sf_dir):
    return rounded(diagnostics.rhat_rank(fitted(spark, sf_dir).long()))


@query
def autocov_lags(spark, sf_dir):
    long = fitted(spark, sf_dir).long()
    rows = diagnostics.halves(long, diagnostics.chain_lengths(long))
    acov = diagnostics.autocovariance(rows, draws.SERIES, value="value")
    return rounded(acov.select(*draws.SERIES, "half", "lag", "acov"), 9)


@query
def ess_bulk(spark, sf_dir):
    return rounded(diagnostics.ess_bulk(fitted(spark, sf_dir).long()))


@query
def ess_tail(spark, sf_dir):
    return rounded(diagnostics.ess_tail(fitted(spark, sf_dir).long()))


@query
def posterior_summary(spark, sf_dir):
    return rounded(diagnostics.summary(fitted(spark, sf_dir).long()))


@query
def diagnostic_gate(spark, sf_dir):
    return diagnostics.gate(diagnostics.summary(fitted(spark, sf_dir).long()))


@query
def diagnostic_gate_at_50(spark, sf_dir):
    return diagnostics.gate(diagnostics.summary(fitted(spark, sf_dir).long()), min_ess=50)


@query
def diagnostic_violations(spark, sf_dir):
    missed = diagnostics.violations(diagnostics.summary(fitted(spark, sf_dir).long()))
    return rounded(missed.select(*draws.SERIES, "r_hat", "ess_bulk", "ess_tail"))


@query
def diagnostic_violations_at_50(spark, sf_dir):
    missed = diagnostics.violations(diagnostics.summary(fitted(spark, sf_dir).long()), min_ess=50)
    return rounded(missed.select(*draws.SERIES, "r_hat", "ess_bulk", "ess_tail"))


# Predictive checks


@query
def ppc_draws(spark, sf_dir):
    return fitted(spark, sf_dir).predicted()


@query
def ppc_crosstab(spark, sf_dir):
    return predictive.crosstab(fitted(spark, sf_dir).predicted())


@query
def ppc_frequency(spark, sf_dir):
    return rounded(fitted(spark, sf_dir).frequencies())


@query
def ppc_band(spark, sf_dir):
    return rounded(predictive.band(fitted(spark, sf_dir).frequencies()))


@query
def fig_ppc(spark, sf_dir):
    return rounded(report.figure_predictive(predictive.band(fitted(spark, sf_dir).frequencies())))


# Cross-validation


def _pointwise(spark, sf_dir):
    f = fitted(spark, sf_dir)
    return crossval.pointwise(f.rows, f.vectors)


def _scored(spark, sf_dir):
    """Scores of all points, written once, and the points."""
    loglik, points = _pointwise(spark, sf_dir)
    return materialise(crossval.scores(loglik, 1.0), "scores"), points


@query
def lppd_waic(spark, sf_dir):
    loglik, points = _pointwise(spark, sf_dir)
    return rounded(crossval.lppd_waic(loglik).join(points, "point"))


@query
def is_loo(spark, sf_dir):
    loglik, points = _pointwise(spark, sf_dir)
    return rounded(crossval.is_loo(loglik).join(points, "point"))


@query
def loo_pointwise(spark, sf_dir):
    loglik, points = _pointwise(spark, sf_dir)
    return rounded(crossval.psis_loo(loglik).join(points, "point"))


@query
def loo_efficiency(spark, sf_dir):
    """Smoothed LOO with the relative efficiency that the draws are measured to have."""
    f = fitted(spark, sf_dir)
    reff = diagnostics.relative_efficiency(f.long())
    loglik, points = crossval.pointwise(f.rows, f.vectors)
    measured = F.create_map(*[F.lit(x) for pair in reff.items() for x in pair])[F.col("model")]
    return rounded(crossval.psis_loo(loglik, reff).join(points, "point").withColumn("reff", measured))


@query
def elpd_compare(spark, sf_dir):
    scored, points = _scored(spark, sf_dir)
    return rounded(crossval.compare(crossval.loo_of(scored), points, lppd=crossval.waic_of(scored)))


@query
def stacking_weights(spark, sf_dir):
    scored, points = _scored(spark, sf_dir)
    return rounded(crossval.stacking_weights(crossval.loo_of(scored), points), 4)


@query
def loo_report(spark, sf_dir):
    scored, points = _scored(spark, sf_dir)
    return rounded(crossval.loo_report(crossval.loo_of(scored), points, crossval.waic_of(scored)))

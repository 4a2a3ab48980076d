"""The whole analysis, from the three survey files to the written tables."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from kinfold.functions.values import MAX_RHAT, MIN_ESS
from kinfold.operators import crossval, diagnostics, draws, likelihood, network, predictive, report, sampler
from kinfold.sources import survey
from kinfold.sources.workspace import materialise, scratch


# Tables of a run that later scripts go on with, beside its results.
KEPT = ("respondents", "nominations", "composition", "sample", "vectors", "hyper", "draws")


class Analysis:
    """Stages in order; each stage with more than one reader is written once.

    `strict` stops on counts that do not sum, as the analysis has no meaning then.
    """

    def __init__(self, spark: SparkSession, primary: str, secondary: str, ties: str, dedupe: bool = False, strict: bool = True):
        self.spark = spark
        people = survey.respondents(survey.read_primary(spark, primary), survey.read_secondary(spark, secondary))
        self.respondents = materialise(people, "respondents")
        self.nominations = materialise(network.kept_nominations(survey.read_nominations(spark, ties)), "nominations")
        self.dyads = network.tied_dyads(self.nominations, self.respondents, dedupe)
        self.composition = materialise(network.composition(self.dyads, self.respondents), "composition")
        if strict and network.composition_check(self.composition).first()["violations"]:
            raise ValueError("lender types do not sum to lenders; repeated nominations need dedupe=True")
        self.sample = materialise(network.modelled(self.composition), "sample")

    @classmethod
    def saved(cls, spark: SparkSession, out: str) -> "Analysis":
        """A fitted analysis over the tables that `run` wrote under `out`, in this or an earlier session."""
        a = cls.__new__(cls)
        a.spark = spark
        for name in KEPT:
            setattr(a, name, survey.read_draws(spark, f"{out}/{name}") if name == "draws" else spark.read.parquet(f"{out}/{name}"))
        a.dyads = spark.read.parquet(f"{out}/dyads")
        a.run = sampler.RunLength(**spark.read.parquet(f"{out}/run_length").first().asDict())
        return a

    def save(self, out: str) -> "Analysis":
        """Write what `saved` reads, and return that."""
        for name in KEPT:
            if name != "draws":
                getattr(self, name).write.parquet(f"{out}/{name}")
        self.dyads.write.parquet(f"{out}/dyads")
        survey.write_draws(self.draws, f"{out}/draws")
        self.spark.createDataFrame([asdict(self.run)], "chains int, draws int, tune int, seed long").coalesce(1).write.parquet(f"{out}/run_length")
        return Analysis.saved(self.spark, out)

    def fit(self, run: sampler.RunLength = sampler.RunLength()) -> "Analysis":
        self.run = run
        self.vectors, self.hyper = sampler.fit(likelihood.tail_counts(self.sample), run)
        self.draws = materialise(draws.long_draws(self.vectors, self.hyper), "draws")
        return self

    def summary(self) -> DataFrame:
        return diagnostics.summary(self.draws)

    def stacked(self) -> DataFrame:
        return draws.stack_models(draws.posterior_table(self.draws), draws.parameter_order(self.respondents))

    def predictive(self) -> DataFrame:
        cells = predictive.predict_cells(likelihood.with_models(self.sample), self.vectors)
        summary = predictive.frequency_summary(cells, self.run.chains * self.run.draws)
        return predictive.band(predictive.compare_observed(summary, self.sample))

    def cross_validation(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(pointwise elpd, comparison, weights)."""
        loglik, points = crossval.pointwise(self.sample, self.vectors)
        scored = materialise(crossval.scores(loglik, diagnostics.relative_efficiency(self.draws)), "scores")
        elpd = crossval.loo_of(scored)
        compared = crossval.compare(elpd, points, lppd=crossval.waic_of(scored))
        return elpd.join(points, "point"), compared, crossval.stacking_weights(elpd, points)


def run(spark, primary, secondary, ties, out, length=sampler.RunLength(), dedupe=False, strict=True) -> Analysis:
    """Run every stage and write its table under `out`; scratch tables are removed at the end.

    The returned analysis reads the tables under `out`, as does `Analysis.saved(spark, out)` in later scripts. With `strict`, a model that misses a convergence bound raises after the tables of the
    diagnostics are written.
    """
    with scratch(spark):
        return _run(spark, primary, secondary, ties, out, length, dedupe, strict)


def _run(spark, primary, secondary, ties, out, length, dedupe, strict) -> Analysis:
    a = Analysis(spark, primary, secondary, ties, dedupe, strict).fit(length).save(out)

    def save(name, table):
        table.write.parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    save("exclusions", network.exclusions(a.composition))
    save("frequencies", network.count_histogram(a.composition))
    summary = save("summary", a.summary())
    gate = save("gate", diagnostics.gate(summary, MAX_RHAT, MIN_ESS))
    pointwise, compared, weights = a.cross_validation()
    save("elpd", pointwise)
    save("comparison", compared.join(weights, "model"))
    stacked = save("posterior", a.stacked())
    banded = save("predictive", a.predictive())
    save("figure_parallel", report.figure_parallel(stacked))
    save("figure_predictive", report.figure_predictive(banded))
    save("figure_fractions", report.figure_fractions(stacked))
    save("figure_concentration", report.figure_concentration(stacked))
    save("reported_means", report.lookup(stacked))
    save("reported_sums", report.subset_sums(stacked))
    save("reported_villages", report.village_ranking(stacked))
    save("reported_nominations", network.nomination_shares(a.nominations, a.respondents))
    failed = [r["model"] for r in gate.where("NOT passed").select("model").collect()]
    if strict and failed:
        raise RuntimeError(f"convergence bounds missed by: {', '.join(sorted(failed))}")
    return a

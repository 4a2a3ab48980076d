"""Reported figures and figure-ready tables from the stacked posterior table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.columns import label, pseudo_log10, within
from kinfold.functions.values import (
    CATEGORY_LABELS, CATEGORY_LABELS_LONG, CONCENTRATION_LIMITS, FRACTION_LIMITS, FREQUENCY_LIMITS,
    INDEBTED, INTIMATE, MODEL_LABELS, NOT_INDEBTED, PPC_MODEL_LABELS,
)
from kinfold.operators.ranks import ranked


def lookup(stacked: DataFrame, model: str = "Baseline", parameter: str = "frac") -> DataFrame:
    """Posterior means and bounds of one parameter of one model, by type."""
    return stacked.sparkSession.sql(
        "SELECT category, pmean, lower_bound, higher_bound FROM {stacked} "
        "WHERE model = :model AND parameter = :parameter",
        args={"model": model, "parameter": parameter}, stacked=stacked,
    )


def subset_sums(stacked: DataFrame, model: str = "Baseline", parameter: str = "frac") -> DataFrame:
    """Summed posterior means of the indebted, intimate and non-indebted types, in one pass."""
    chosen = lookup(stacked, model, parameter)
    groups = {"indebted": INDEBTED, "intimate": INTIMATE, "not_indebted": NOT_INDEBTED}
    sums = [F.sum(F.when(F.col("category").isin(*g), F.col("pmean"))).alias(n) for n, g in groups.items()]
    return chosen.agg(*sums)


def village_ranking(stacked: DataFrame, category: str = "friend_family_lender_ij", model: str = "Extended") -> DataFrame:
    """Villages of a model by the posterior mean share of one type, smallest first."""
    chosen = stacked.where(
        (F.col("model") == model) & F.col("parameter").startswith("frac") & (F.col("category") == category)
    )
    placed = ranked(chosen, ["category"], ["pmean", "parameter"], "ranking")
    return placed.select("parameter", "category", "pmean", (F.col("rank0") + 1).alias("place")).orderBy("place")


def _village_label(block: str):
    return F.when(F.col("parameter") == block, "All").otherwise(
        F.concat(F.lit("V"), F.replace("parameter", F.lit(f"{block}_vill_"), F.lit("")))
    )


def _display(name, limits, root=False):
    inside = within(F.col(name), limits)
    return (F.sqrt(inside) if root else inside).alias(f"{name}_display")


BOUNDS = ("pmean", "lower_bound", "higher_bound")


def figure_parallel(stacked: DataFrame) -> DataFrame:
    """Shares by type, one line per parameter and model, on a square-root axis."""
    return stacked.where(F.col("parameter").startswith("frac")).select(
        "estimate_id", "model", label(F.col("model"), MODEL_LABELS).alias("model_label"),
        "category", "category_order", label(F.col("category"), CATEGORY_LABELS).alias("category_label"),
        *BOUNDS, *[_display(b, FRACTION_LIMITS, root=True) for b in BOUNDS],
    )


def figure_fractions(stacked: DataFrame) -> DataFrame:
    """Shares by village, one facet per type."""
    return stacked.where(F.col("parameter").startswith("frac")).select(
        _village_label("frac").alias("village"), "model", "category",
        label(F.col("category"), CATEGORY_LABELS_LONG).alias("facet"), *BOUNDS,
        F.col("pmean").between(*FRACTION_LIMITS).alias("in_limits"),
        *[_display(b, FRACTION_LIMITS, root=True) for b in BOUNDS],
    )


def figure_concentration(stacked: DataFrame) -> DataFrame:
    """Concentrations by village."""
    return stacked.where(F.col("parameter").startswith("conc")).select(
        _village_label("conc").alias("village"), "model", *BOUNDS,
        *[_display(b, CONCENTRATION_LIMITS) for b in BOUNDS],
    )


def figure_predictive(banded: DataFrame) -> DataFrame:
    """Predicted and observed frequencies on a pseudo-log axis, one panel per model and type."""
    category = F.replace("category", F.lit("Y_counts_"), F.lit(""))
    shown = ("y_count_ppc_mean", "y_count_ppc_lower", "y_count_ppc_upper", "y_observed_count")
    return banded.select(
        "model", label(F.col("model"), PPC_MODEL_LABELS).alias("model_label"),
        "category", label(category, CATEGORY_LABELS).alias("category_label"),
        "number_of_lenders", *shown,
        *[pseudo_log10(within(F.col(c), FREQUENCY_LIMITS)).alias(f"{c}_display") for c in shown],
    )

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.values import CATEGORIES
from kinfold.operators import draws as dr
from kinfold.operators import report
from tests.conftest import rows
from tests.test_likelihood import VECTORS

LONG = "model string, chain int, draw int, parameter string, category string, value double"
HYPER = "model string, chain int, draw int, hyper_alpha array<double>, hyper_lambda double"


def series(spark, values, model="Baseline", parameter="conc", category="common"):
    return [(model, k % 4, k // 4, parameter, category, float(v)) for k, v in enumerate(values)]


def shortest(values, prob):
    x = np.sort(values)
    m = int(math.floor(prob * len(x)))
    widths = x[m:] - x[: len(x) - m]
    k = int(np.argmin(widths))
    return x[k], x[k + m]


@pytest.mark.parametrize("prob", [0.5, 0.95])
def test_intervals(spark, prob):
    rng = np.random.default_rng(0)
    sets = {"a": rng.gamma(2, size=200), "b": np.round(rng.normal(size=400), 1), "flat": np.ones(40)}
    data = [r for name, v in sets.items() for r in series(spark, v, parameter=name)]
    got = {r["parameter"]: (r["lower_bound"], r["higher_bound"]) for r in dr.hdi_wide(dr.hdi(spark.createDataFrame(data, LONG), prob)).collect()}
    for name, v in sets.items():
        low, high = got[name]
        assert (low, high) == pytest.approx(shortest(v, prob))
        assert np.mean((v >= low) & (v <= high)) >= prob


def test_shared_parameters_have_one_common_row(spark):
    v = spark.createDataFrame([("Sex", "_vill_1_female", 0, 0, [0.125] * 8, 2.0)], VECTORS)
    h = spark.createDataFrame([("Sex", 0, 0, [1.0 + k for k in range(8)], 0.5)], HYPER)
    long = dr.long_draws(v, h)
    assert rows(long.where("category = 'common'"), "parameter", "value") == {("conc_vill_1_female", 2.0), ("hyper_lambda", 0.5)}
    assert long.count() == 8 + 8 + 2
    assert rows(long.where("parameter = 'hyper_alpha'"), "category", "value") == {(c, 1.0 + k) for k, c in enumerate(CATEGORIES)}
    assert rows(dr.vectors_of(long), "key", "conc") == {("_vill_1_female", 2.0)}
    assert dr.vectors_of(long).first()["frac"] == [0.125] * 8


def test_sex_of_parameter_names(spark):
    df = spark.createDataFrame([("frac_vill_1_female",), ("conc_vill_1_male",), ("hyper_alpha",)], "parameter string")
    assert rows(dr.split_sex(df), "parameter", "sex") == {("frac_vill_1", "Female"), ("conc_vill_1", "Male"), ("hyper_alpha", None)}


def test_stack_and_reports(spark):
    data = []
    for k, c in enumerate(CATEGORIES):
        for model, name, value in (
            ("Baseline", "frac", (k + 1) / 36), ("Extended", "frac_vill_1", 0.1 + k / 100), ("Extended", "frac_vill_2", 0.05 + k / 100),
            ("Sex", "frac_vill_1_female", 0.7), ("Sex", "frac_vill_1_male", 0.2),
        ):
            data += series(spark, [value] * 8, model, name, c)
    data += series(spark, [20.0] * 8, "Baseline", "conc") + series(spark, [3.0] * 8, "Sex", "conc_vill_1_male")
    data += series(spark, [1.0] * 8, "Sex", "hyper_lambda") + series(spark, [1.0] * 8, "Baseline", "frac", "unlisted")
    people = spark.createDataFrame([("1",), ("2",)], "group_id string")
    table = dr.posterior_table(spark.createDataFrame(data, LONG))
    assert table.where("category = 'unlisted'").first()["category_order"] is None
    stacked = dr.stack_models(table, dr.parameter_order(people)).cache()
    assert rows(stacked.where("model LIKE 'Sex%'"), "model", "parameter") == {
        ("Sex (Female)", "frac_vill_1"), ("Sex (Male)", "frac_vill_1"), ("Sex (Male)", "conc_vill_1"), ("Sex (Common)", "hyper_lambda")}
    order = {r["parameter"]: r["parameter_order"] for r in stacked.collect()}
    assert order == {"hyper_lambda": 1, "frac": 2, "frac_vill_1": 3, "frac_vill_2": 4, "conc": 5, "conc_vill_1": 6}
    assert ("frac_vill_1_Sex (Male)",) in rows(stacked, "estimate_id")

    found = {r["category"]: r["pmean"] for r in report.lookup(stacked).collect()}
    assert found["friend_lender_ij"] == pytest.approx(1 / 36)
    s = report.subset_sums(stacked).first()
    assert s["indebted"] == pytest.approx(26 / 36) and s["not_indebted"] == pytest.approx(10 / 36)
    assert s["intimate"] == pytest.approx((1 + 2 + 3 + 5 + 6 + 7) / 36)
    assert [(r["parameter"], r["place"]) for r in report.village_ranking(stacked).collect()] == [("frac_vill_2", 1), ("frac_vill_1", 2)]

    female = report.figure_fractions(stacked).where("model = 'Sex (Female)'").first()
    assert (female["village"], female["in_limits"], female["pmean_display"]) == ("V1", False, None)
    male = report.figure_parallel(stacked).where("model = 'Sex (Male)'").first()
    assert male["pmean_display"] == pytest.approx(math.sqrt(0.2)) and male["model_label"] == "Sex-Specic Model (Male)"
    assert rows(report.figure_concentration(stacked), "village", "pmean_display") == {("All", None), ("V1", 3.0)}


def test_means(spark):
    df = spark.createDataFrame(series(spark, [1, 2, 3, 6]), LONG)
    assert rows(dr.posterior_means(df), "parameter", "pmean") == {("conc", 3.0)}


def test_explode_positions(spark):
    v = spark.createDataFrame([("Baseline", "", 1, 2, [k / 36 for k in range(1, 9)], 2.0)], VECTORS)
    h = spark.createDataFrame([], HYPER)
    out = dr.explode_draws(v, h)
    assert out.agg(F.sum("value")).first()[0] == pytest.approx(1.0)
    assert rows(out, "k") == {(k,) for k in range(8)}

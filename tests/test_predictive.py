import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.values import CATEGORIES
from kinfold.operators import likelihood as lk
from kinfold.operators import predictive as pp
from tests.conftest import rows
from tests.test_likelihood import VECTORS, sample

FRAC = [0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.03, 0.02]


def vectors(spark, draws):
    return spark.createDataFrame([("Baseline", "", c, d, FRAC, 3.0) for c in range(2) for d in range(draws)], VECTORS)


def test_counts_sum_to_lenders_and_do_not_depend_on_partitioning(spark, monkeypatch):
    s = sample(spark, [(n, 0, 0, 0, 0, 0, 0, 0) for n in (1, 2, 5, 8)])
    keyed = lk.with_models(s, ["Baseline"])
    first = pp.predict(keyed, vectors(spark, 20))
    assert first.count() == 4 * 40
    n = {"p0": 1, "p1": 2, "p2": 5, "p3": 8}
    assert all(sum(r[c] for c in CATEGORIES) == n[r["id"]] for r in first.collect())
    expected = rows(first)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(pp.predict(keyed.repartition(5), vectors(spark, 20).repartition(3))) == expected
        monkeypatch.setattr(lk, "BROADCAST_ROWS", 1)
        assert rows(pp.predict(keyed, vectors(spark, 20))) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("batch", ["10000", "1", "3"])
def test_rows_with_many_balls_follow_the_same_urn(spark, batch):
    """Rows of one block, of a full one and of several, also where a batch ends between the blocks of a row."""
    import hashlib

    s = sample(spark, [(n, 0, 0, 0, 0, 0, 0, 0) for n in (1, 3, 8, 9, 40, 0, 17)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = pp.predict(lk.with_models(s, ["Baseline"]), vectors(spark, 5)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    n = {r["id"]: r["lender_ij"] for r in s.collect()}
    assert len(found) == 7 * 10
    for r in found:
        counts = [0] * 8
        for t in range(n[r["id"]]):
            digits = hashlib.md5(f"{pp.SEED}|Baseline|{r['chain']}|{r['draw']}|{r['id']}|{t + 1}".encode()).hexdigest()
            u = int(digits[:13], 16) / 2**52
            edges = np.cumsum([3.0 * f + c for f, c in zip(FRAC, counts)])
            counts[int((u * (edges[-1]) >= edges[:-1]).sum())] += 1
            assert edges[-1] == pytest.approx(3.0 + t)
        assert [r[c] for c in CATEGORIES] == counts


def test_a_row_carries_many_draws_to_python(spark):
    s = sample(spark, [(n, 0, 0, 0, 0, 0, 0, 0) for n in (1, 3, 8, 9)])
    carried = pp._balls(lk.with_models(s, ["Baseline"]), vectors(spark, 20), pp.SEED)
    packs = -(-40 // pp.DRAWS)
    assert carried.count() == packs * (3 + 2)
    r = carried.where("id = 'p3' AND first = 8").first()
    assert list(r["tails"]) == ["p3|9"] and all(x.startswith(f"{pp.SEED}|Baseline|") for x in r["stems"])


@pytest.mark.parametrize("together", [1, 64])
def test_slices_of_a_batch_follow_each_other(spark, monkeypatch, together):
    s = sample(spark, [(n, 0, 0, 0, 0, 0, 0, 0) for n in (1, 3, 8, 9, 40, 17)])
    keyed = lk.with_models(s, ["Baseline"])
    expected = rows(pp.predict(keyed, vectors(spark, 20)))
    monkeypatch.setattr(pp, "SLICE", together)
    assert rows(pp.predict(keyed, vectors(spark, 20))) == expected


def test_counts_of_a_billion_respondents_keep_their_deviation(spark):
    draws, base = 12000, 1_000_000_000
    cells = spark.range(draws).selectExpr(
        "'Baseline' AS model", "0 AS chain", "CAST(id AS INT) AS draw", "'c' AS category", "1L AS y",
        f"{base} + (id * 7919) % 11 - 5 AS respondents",
    )
    expected = cells.selectExpr("stddev_samp(CAST(respondents - 1000000000 AS DOUBLE)) AS s").first()["s"]
    got = pp.frequency_summary(cells, draws).first()
    assert got["std"] == pytest.approx(expected, rel=1e-9)
    half = pp.frequency_summary(cells.where("draw < 6000"), draws).first()
    values = cells.selectExpr("CASE WHEN draw < 6000 THEN CAST(respondents AS DOUBLE) ELSE 0D END AS v")
    assert half["std"] == pytest.approx(values.selectExpr("stddev_samp(v) AS s").first()["s"], rel=1e-9)


def test_urn_has_the_moments_of_the_distribution(spark):
    s = sample(spark, [(4, 0, 0, 0, 0, 0, 0, 0)] * 200)
    p = pp.predict(lk.with_models(s, ["Baseline"]), vectors(spark, 50))
    r = p.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(CATEGORIES)], F.var_pop(CATEGORIES[0]).alias("v")).first()
    for k, f in enumerate(FRAC):
        assert r[f"m{k}"] == pytest.approx(4 * f, abs=0.05)
    assert r["v"] == pytest.approx(4 * 0.4 * 0.6 * (4 + 3.0) / (1 + 3.0), rel=0.05)


def test_draws_without_a_value_count_as_zero(spark):
    cells = spark.createDataFrame(
        [("Baseline", 0, 0, "c", 1, 4), ("Baseline", 0, 1, "c", 1, 2), ("Baseline", 0, 1, "c", 7, 3)],
        "model string, chain int, draw int, category string, y long, respondents long")
    got = {r["y"]: r for r in pp.frequency_summary(cells, 4).collect()}
    assert got[1]["mean"] == pytest.approx(1.5) and got[1]["std"] == pytest.approx(statistics.stdev([4, 2, 0, 0]))
    assert got[7]["mean"] == pytest.approx(0.75) and got[7]["std"] == pytest.approx(statistics.stdev([0, 3, 0, 0]))


def test_observed_grid_keeps_its_values_only(spark):
    s = sample(spark, [(1, 2, 0, 0, 0, 0, 0, 0)])
    summary = spark.createDataFrame(
        [("Baseline", "friend_lender_ij", 1, 1.0, 0.5), ("Baseline", "friend_lender_ij", 9, 1.0, 0.5)],
        "model string, category string, y long, mean double, std double")
    out = pp.band(pp.compare_observed(summary, s)).where("model = 'Baseline'")
    assert out.count() == 3 * 8 and out.where("number_of_lenders = 9").count() == 0
    r = out.where("category = 'Y_counts_friend_lender_ij' AND number_of_lenders = 1").first()
    assert (r["y_observed_count"], r["covered"]) == (1, True)
    assert r["y_count_ppc_upper"] == pytest.approx(1.98) and r["y_count_ppc_lower"] == pytest.approx(0.02)
    assert out.where("y_count_ppc_mean IS NULL").count() == 23


def test_crosstab_counts_every_respondent(spark):
    s = sample(spark, [(2, 0, 0, 0, 0, 0, 0, 0)] * 30)
    cells = pp.crosstab(pp.predict(lk.with_models(s, ["Baseline"]), vectors(spark, 3)))
    totals = rows(cells.groupBy("chain", "draw", "category").agg(F.sum("respondents").alias("n")), "n")
    assert totals == {(30,)}
    assert np.isclose(cells.agg(F.sum(F.col("y") * F.col("respondents"))).first()[0], 30 * 2 * 6)


def test_cells_counted_in_batches_equal_the_crosstab(spark):
    s = sample(spark, [(n % 12, 0, 0, 0, 0, 0, 0, 0) for n in range(1, 40)])
    keyed = lk.with_models(s, ["Baseline"])
    assert rows(pp.predict_cells(keyed, vectors(spark, 6)), *CELL) == rows(pp.crosstab(pp.predict(keyed, vectors(spark, 6))), *CELL)


CELL = ("model", "chain", "draw", "category", "y", "respondents")

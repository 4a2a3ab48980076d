import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import crossval as cv
from tests.test_likelihood import VECTORS, sample

LOGLIK = "model string, point string, chain int, draw int, ll double"


def logsumexp(x):
    return x.max() + math.log(np.exp(x - x.max()).sum())


def psis(ll, reff=1.0):
    """Brute force on a whole vector."""
    s = len(ll)
    x = -ll - (-ll).max()
    order = np.argsort(x)
    m = math.ceil(min(s / 5, 3 * math.sqrt(s / reff)))
    k, smooth = cv.smooth_tail(x[order][s - m - 1:])
    x[order[s - m:]] = smooth
    return logsumexp(x - logsumexp(x) + ll), k


def test_pareto_shape_of_known_tails():
    rng = np.random.default_rng(2)
    for shape in (0.2, 0.7):
        got = [cv._fit_pareto(np.sort((rng.random(400) ** -shape - 1) / shape))[0] for _ in range(30)]
        assert np.mean(got) == pytest.approx(shape, abs=0.1)


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(4)
    return {(m, f"p{k}"): -3 + rng.standard_t(4, size=400) * (0.2 + 0.2 * k) for m in ("Baseline", "Extended", "Sex") for k in range(5)}


@pytest.fixture(scope="module")
def loglik(spark, matrix):
    data = [(m, p, i % 4, i // 4, float(v)) for (m, p), x in matrix.items() for i, v in enumerate(x)]
    return spark.createDataFrame(data, LOGLIK).cache()


def test_psis_matches_brute_force(loglik, matrix):
    for reff in (1.0, {"Baseline": 0.5, "Extended": 1.0, "Sex": 2.0}):
        for r in cv.psis_loo(loglik, reff).collect():
            e, k = psis(matrix[r["model"], r["point"]], reff if reff == 1.0 else reff[r["model"]])
            assert r["elpd"] == pytest.approx(e, rel=1e-9) and r["pareto_k"] == pytest.approx(k, rel=1e-6)


def test_waic_and_importance_sampling(loglik, matrix):
    for r in cv.lppd_waic(loglik).collect():
        x = matrix[r["model"], r["point"]]
        assert r["lppd"] == pytest.approx(logsumexp(x) - math.log(400))
        assert r["elpd_waic"] == pytest.approx(r["lppd"] - x.var(ddof=1))
    for r in cv.is_loo(loglik).collect():
        assert r["elpd"] == pytest.approx(math.log(400) - logsumexp(-matrix[r["model"], r["point"]]))


def test_very_small_likelihoods_do_not_underflow(spark):
    df = spark.createDataFrame([("Baseline", "hub", 0, d, -5000.0 - d) for d in range(40)], LOGLIK)
    x = -5000.0 - np.arange(40)
    assert cv.is_loo(df).first()["elpd"] == pytest.approx(math.log(40) - logsumexp(-x))
    assert cv.psis_loo(df).first()["elpd"] == pytest.approx(psis(x)[0], rel=1e-9)


def test_comparison_and_weights(spark):
    rng = np.random.default_rng(6)
    n, count = 60, rng.integers(1, 5, size=60)
    e = {"Baseline": rng.normal(-3, 1, n), "Extended": rng.normal(-2.8, 1, n), "Sex": rng.normal(-3.5, 1, n)}
    elpd = spark.createDataFrame([(m, f"p{i}", float(v)) for m, x in e.items() for i, v in enumerate(x)], "model string, point string, elpd double")
    points = spark.createDataFrame([(f"p{i}", int(c)) for i, c in enumerate(count)], "point string, respondents long")
    full = {m: np.repeat(x, count) for m, x in e.items()}
    best = max(full, key=lambda m: full[m].sum())
    ranking = sorted(full, key=lambda m: -full[m].sum())
    for r in cv.compare(elpd, points).collect():
        x, d = full[r["model"]], full[best] - full[r["model"]]
        assert r["elpd"] == pytest.approx(x.sum()) and r["se"] == pytest.approx(math.sqrt(len(x) * x.var()))
        assert r["elpd_diff"] == pytest.approx(d.sum(), abs=1e-9) and r["dse"] == pytest.approx(math.sqrt(len(d) * d.var()), abs=1e-6)
        assert ranking[r["rank"]] == r["model"]
    got = {r["model"]: r["weight"] for r in cv.stacking_weights(elpd, points).collect()}
    p = np.exp(np.stack([full[m] for m in ("Baseline", "Extended", "Sex")], axis=1))
    w = np.array([got[m] for m in ("Baseline", "Extended", "Sex")])
    score = np.log(p @ w).sum()
    assert w.sum() == pytest.approx(1.0)
    for trial in rng.dirichlet(np.ones(3), size=500):
        assert np.log(p @ trial).sum() <= score + 0.001


def test_equal_respondents_are_one_point(spark):
    s = sample(spark, [(1, 0, 0, 0, 0, 0, 0, 0)] * 3 + [(0, 1, 0, 0, 0, 0, 0, 0)])
    v = spark.createDataFrame([(m, k, 0, d, [0.125] * 8, 2.0) for m, k in (("Baseline", ""), ("Extended", "_vill_g"), ("Sex", "_vill_g_female")) for d in range(3)], VECTORS)
    loglik, points = cv.pointwise(s, v)
    assert sorted(r["respondents"] for r in points.collect()) == [1, 3]
    assert loglik.count() == 2 * 3 * 3
    assert loglik.agg(F.max("ll")).first()[0] == pytest.approx(math.log(1 / 8))


def test_partials_of_any_size_merge(loglik, matrix):
    """Scores do not depend on how rows are dealt out."""
    whole = {(r["model"], r["point"]): r for r in cv.scores(loglik.coalesce(1), 1.0).collect()}
    dealt = cv.scores(loglik.repartition(23), 1.0).collect()
    assert len(dealt) == len(whole) == len(matrix)
    for r in dealt:
        for c in ("draws", "lppd", "p_waic", "elpd_is", "elpd_psis", "pareto_k"):
            assert r[c] == pytest.approx(whole[r["model"], r["point"]][c], rel=1e-9)
    # No ratio is sorted or moved over tasks: one exchange, of the partials.
    plan = cv.scores(loglik, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan and "Join" not in plan


def test_spread_beside_a_large_mean(spark):
    """Standard errors of elpds near -1e9 that differ by about 1."""
    rng = np.random.default_rng(6)
    base, noise, weight = -1e9, rng.normal(size=(3, 400)).round(6), rng.integers(1, 9, 400)
    rows = [(m, f"p{i}", base + float(noise[k, i])) for k, m in enumerate(("Baseline", "Extended", "Sex")) for i in range(400)]
    elpd = spark.createDataFrame(rows, "model string, point string, elpd double").repartition(7)
    points = spark.createDataFrame([(f"p{i}", int(w)) for i, w in enumerate(weight)], "point string, respondents long")
    x = {m: np.repeat([e for n, _, e in rows if n == m], weight) for m in ("Baseline", "Extended", "Sex")}
    found = {r["model"]: r for r in cv.compare(elpd, points).collect()}
    best = max(x, key=lambda m: x[m].sum())
    for m, r in found.items():
        assert r["se"] == pytest.approx(math.sqrt(len(x[m]) * x[m].var()), rel=1e-6)
        d = x[best] - x[m]
        assert r["dse"] == pytest.approx(math.sqrt(len(d) * d.var()), rel=1e-6, abs=1e-6)
        assert r["elpd_diff"] == pytest.approx(d.sum(), rel=1e-6, abs=1e-6)

import itertools
import math

import pytest
from pyspark.sql import functions as F

from kinfold.functions.columns import log_factorial, log_gamma, log_rising, normal_quantile
from kinfold.functions.values import CATEGORIES
from kinfold.operators import likelihood as lk
from tests.conftest import rows

SAMPLE = "id string, group_id string, female int, lender_ij long, " + ", ".join(f"{c} long" for c in CATEGORIES)
VECTORS = "model string, key string, chain int, draw int, frac array<double>, conc double"


def sample(spark, counts, group="g", female=1):
    return spark.createDataFrame([(f"p{k}", group, female, sum(y), *y) for k, y in enumerate(counts)], SAMPLE)


def pmf(y, alpha):
    n, total = sum(y), sum(alpha)
    out = math.lgamma(n + 1) + math.lgamma(total) - math.lgamma(n + total)
    return out + sum(math.lgamma(k + a) - math.lgamma(a) - math.lgamma(k + 1) for k, a in zip(y, alpha))


def test_log_gamma_and_rising_factorials(spark):
    data = [(a, y) for a in (1e-6, 0.3, 1.0, 7.5, 250.0, 4e4) for y in (0, 1, 2, 5, 16, 17, 400, 100000)]
    df = spark.createDataFrame(data, "a double, y long")
    for r in df.select("a", "y", log_gamma(F.col("a")).alias("g"), log_rising(F.col("a"), F.col("y")).alias("r"), log_factorial(F.col("y")).alias("f")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["a"]), rel=1e-12, abs=1e-12)
        assert r["r"] == pytest.approx(math.lgamma(r["a"] + r["y"]) - math.lgamma(r["a"]), rel=1e-9, abs=1e-9)
        assert r["f"] == pytest.approx(math.lgamma(r["y"] + 1), rel=1e-12, abs=1e-12)


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-12, 1e-5, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.77, 0.925, 0.99999]
    for p, z in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p"))).collect():
        assert z == pytest.approx(NormalDist().inv_cdf(p), rel=1e-9, abs=1e-12)


def test_pmf_sums_to_one_over_all_count_vectors(spark):
    n = 3
    counts = [y for y in itertools.product(range(n + 1), repeat=8) if sum(y) == n]
    s = sample(spark, counts)
    frac = [0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]
    v = spark.createDataFrame([("Baseline", "", 0, 0, frac, 2.5)], VECTORS)
    ll = lk.log_likelihood(lk.with_models(s, ["Baseline"]), v)
    got = {r["id"]: r["ll"] for r in ll.collect()}
    assert sum(math.exp(x) for x in got.values()) == pytest.approx(1.0, abs=1e-12)
    for k, y in enumerate(counts[::17]):
        assert got[f"p{17 * k}"] == pytest.approx(pmf(y, [f * 2.5 for f in frac]), abs=1e-11)


def test_both_join_ways_agree_and_hubs_are_whole(spark, monkeypatch):
    s = sample(spark, [(1, 0, 0, 0, 0, 0, 0, 1), (3000, 50, 0, 0, 0, 0, 7, 1), (0, 2, 0, 0, 0, 0, 0, 0)])
    v = spark.createDataFrame(
        [(m, k, c, d, [0.125] * 8, 1.0 + d + c) for m, k in (("Baseline", ""), ("Sex", "_vill_g_female")) for c in range(2) for d in range(70)], VECTORS)
    rows_ = lk.with_models(s)
    small = lk.log_likelihood(rows_, v).select("model", "id", "chain", "draw", "ll")
    assert small.count() == 3 * 2 * 2 * 70
    monkeypatch.setattr(lk, "BROADCAST_ROWS", 5)
    large = lk.log_likelihood(rows_, v).select("model", "id", "chain", "draw", "ll")
    assert rows(large) == rows(small)
    hub = small.where("model = 'Baseline' AND id = 'p1' AND chain = 1 AND draw = 3").first()["ll"]
    assert hub == pytest.approx(pmf((3000, 50, 0, 0, 0, 0, 7, 1), [0.125 * 5] * 8), rel=1e-10)


def test_parameters_are_gathered_by_model(spark, monkeypatch):
    """Broadcasts as far as they fit, the smallest model first; a key of a third of all rows is cut by its measured rows."""
    frac = [0.125] * 8
    v = [("Baseline", "", c, d, frac, 2.0) for c in range(2) for d in range(4)]
    v += [("Extended", f"_vill_{g}", c, d, frac, 2.0 + g) for g in range(40) for c in range(2) for d in range(4)]
    v = spark.createDataFrame(v, VECTORS)
    people = spark.range(6000).selectExpr(
        "cast(id AS string) AS id", "cast(if(id % 3 = 0, 7, id % 40) AS string) AS group_id", "1 AS female", "1L AS lender_ij",
        *[f"{int(k == 0)}L AS {c}" for k, c in enumerate(CATEGORIES)])
    keyed = lk.with_models(people, ["Baseline", "Extended"])
    expected = rows(lk.spread_join(keyed, lk.pack_draws(v)), "model", "id", "chain", "draw", "conc")
    assert len(expected) == 2 * 6000 * 8
    asked = []
    broadcast = lk.F.broadcast
    monkeypatch.setattr(lk.F, "broadcast", lambda df: asked.append(df) or broadcast(df))
    monkeypatch.setattr(lk, "BROADCAST_ROWS", 8)
    monkeypatch.setattr(lk, "PART_ROWS", 20)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        found = lk.spread_join(keyed, lk.pack_draws(v))
        assert rows(found, "model", "id", "chain", "draw", "conc") == expected
        assert [r["model"] for r in asked[0].select("model").distinct().collect()] == ["Baseline"]
        hot = {r["key"]: r["parts"] for r in asked[1].collect()}
        assert hot["_vill_7"] > 50 and all(p < 8 for k, p in hot.items() if k != "_vill_7")
        tasks = sorted(r["n"] for r in found.where("model = 'Extended'").selectExpr("spark_partition_id() AS p").groupBy("p").count().selectExpr("`count` AS n").collect())
        assert tasks[-1] < 2 * tasks[len(tasks) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_tail_counts_with_gaps(spark):
    counts = [(0, 5, 0, 0, 0, 0, 0, 1), (0, 2, 0, 0, 0, 0, 0, 0), (0, 2, 0, 0, 0, 0, 0, 1)]
    got = {(r["category"], r["j"]): r["n_above"] for r in lk.tail_counts(sample(spark, counts), ["Baseline"]).collect()}
    expected = {}
    for k, c in enumerate(CATEGORIES):
        for y in counts:
            for j in range(y[k]):
                expected[c, j] = expected.get((c, j), 0) + 1
    for y in counts:
        for j in range(sum(y)):
            expected[None, j] = expected.get((None, j), 0) + 1
    assert got == expected


def test_keys_and_unknown_model(spark):
    s = sample(spark, [(1, 0, 0, 0, 0, 0, 0, 0)], group="7", female=0)
    assert rows(lk.with_models(s), "model", "key") == {("Baseline", ""), ("Extended", "_vill_7"), ("Sex", "_vill_7_male")}
    with pytest.raises(ValueError, match="specification"):
        lk.model_key("other")


def test_priors(spark):
    frac, alpha = [0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05], [0.5 + k / 4 for k in range(8)]
    v = spark.createDataFrame([("Baseline", "", 0, 0, frac, 2.5)], VECTORS)
    h = spark.createDataFrame([("Baseline", 0, 0, alpha, 0.8)], "model string, chain int, draw int, hyper_alpha array<double>, hyper_lambda double")
    r = lk.parameter_log_prior(v, h).first()
    dirichlet = math.lgamma(sum(alpha)) + sum((a - 1) * math.log(f) - math.lgamma(a) for a, f in zip(alpha, frac))
    assert r["log_prior_frac"] == pytest.approx(dirichlet)
    assert r["log_prior_conc"] == pytest.approx(math.log(0.8) - 0.8 * 2.5)
    assert r["log_prior_conc_marginal"] == pytest.approx(math.log(8 / 4.5**3))
    q = lk.log_prior(h).first()
    normal = sum(-math.log(a) - 0.5 * math.log(2 * math.pi) - (math.log(a) - 1) ** 2 / 2 for a in alpha)
    assert q["log_prior_alpha"] == pytest.approx(normal)
    assert q["log_prior_lambda"] == pytest.approx(math.log(4 * 0.8) - 1.6)

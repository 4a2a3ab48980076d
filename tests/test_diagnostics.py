import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinfold.operators import diagnostics as dg
from kinfold.operators.draws import SERIES
from tests.conftest import rows


def ess(x):
    """Brute force: all lags, Geyer's sequence, in numpy. x is halves x draws."""
    m, n = x.shape
    c = x - x.mean(axis=1, keepdims=True)
    acov = np.array([(c[:, : n - lag] * c[:, lag:]).sum(axis=1) / n for lag in range(n)]).mean(axis=1)
    plus = acov[0] + x.mean(axis=1).var(ddof=1)
    rho = 1 - (acov[0] * n / (n - 1) - acov) / plus
    rho[0] = 1
    last, total, low, k = math.ceil((n - 2) / 2) - 1, 0.0, math.inf, 0
    while k < last and min(low, rho[2 * k] + rho[2 * k + 1]) > 0:
        low = min(low, rho[2 * k] + rho[2 * k + 1])
        total += low
        k += 1
    return m * n / max(-1 + 2 * total + max(rho[2 * k], 0), 1 / math.log10(m * n))


def halved(x):
    h = x.shape[1] // 2
    return np.concatenate([np.stack([row[:h], row[len(row) - h:]]) for row in x])


def scores(x):
    from statistics import NormalDist

    r = pd.Series(x.ravel()).rank().to_numpy()
    return np.array([NormalDist().inv_cdf((k - 0.375) / (len(r) + 0.25)) for k in r]).reshape(x.shape)


def rhat(x):
    n = x.shape[1]
    w = x.var(axis=1, ddof=1).mean()
    return math.sqrt(((n - 1) / n * w + x.mean(axis=1).var(ddof=1)) / w)


def frame(spark, arrays, model="m"):
    parts = [
        pd.DataFrame({"model": model, "parameter": name, "category": "common", "chain": c, "draw": range(x.shape[1]), "value": x[c]})
        for name, x in arrays.items() for c in range(x.shape[0])
    ]
    return spark.createDataFrame(pd.concat(parts)).selectExpr(*SERIES, "cast(chain AS int) AS chain", "cast(draw AS int) AS draw", "value")


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    out = {}
    for phi in (0.0, 0.7, -0.3):
        x = rng.normal(size=(4, 251))
        for t in range(1, 251):
            x[:, t] += phi * x[:, t - 1]
        out[f"ar{phi}"] = x
    out["shifted"] = rng.normal(size=(4, 251)) + np.arange(4)[:, None]
    out["ties"] = np.round(rng.normal(size=(4, 251)))
    return out


def test_summary_matches_brute_force(spark, arrays):
    df = frame(spark, arrays)
    got = {r["parameter"]: r for r in dg.summary(df).collect()}
    for name, x in arrays.items():
        s, r = halved(x), got[name]
        folded = np.abs(s - np.median(s))
        assert r["r_hat"] == pytest.approx(max(rhat(scores(s)), rhat(scores(folded))), rel=1e-9)
        assert r["ess_bulk"] == pytest.approx(ess(scores(s)), rel=1e-6)
        cuts = np.quantile(x, [0.05, 0.95])
        assert r["ess_tail"] == pytest.approx(min(ess((s <= q).astype(float)) for q in cuts), rel=1e-6)
        assert r["mean"] == pytest.approx(x.mean()) and r["sd"] == pytest.approx(x.std(ddof=1))
        assert r["mcse_mean"] == pytest.approx(x.std(ddof=1) / math.sqrt(ess(s)), rel=1e-6)
        e = min(ess(s), ess(s**2))
        assert r["mcse_sd"] == pytest.approx(x.std(ddof=1) * math.sqrt(math.e * (1 - 1 / e) ** (e - 1) - 1), rel=1e-6)
    assert got["shifted"]["r_hat"] > 1.01
    assert got["ar0.7"]["ess_bulk"] < 0.5 * got["ar0.0"]["ess_bulk"] < got["ar-0.3"]["ess_bulk"]


def test_plain_rhat(spark, arrays):
    got = {r["parameter"]: r["rhat"] for r in dg.rhat_split(frame(spark, arrays)).collect()}
    for name, x in arrays.items():
        assert got[name] == pytest.approx(rhat(halved(x)), rel=1e-9)


def test_lags_beyond_a_block_are_followed(spark, arrays):
    slow = {"slow": np.cumsum(np.random.default_rng(1).normal(size=(2, 80)), axis=1), "fast": arrays["ar0.0"][:2, :80]}
    df = frame(spark, slow)
    series = dg.halves(df, {"m": 80}).select(*SERIES, "half", "h", "t", F.col("value").alias("x"))
    got = {r["parameter"]: r["ess"] for r in dg.effective_size(series, SERIES, block=8).collect()}
    for name, x in slow.items():
        assert got[name] == pytest.approx(ess(halved(x)), rel=1e-6)


def test_a_constant_series_has_full_size_and_no_rhat(spark):
    df = frame(spark, {"flat": np.full((4, 20), 0.1)})
    assert dg.ess_bulk(df).first()["ess_bulk"] == 80
    assert dg.rhat_split(df).first()["rhat"] is None


def test_gate(spark):
    data = [("a", "p", 1.0, 2000.0, 2000.0), ("a", "q", 1.02, 2000.0, 900.0), ("a", "n", None, 2000.0, 2000.0), ("b", "p", 1.0, 1001.0, 1001.0)]
    df = spark.createDataFrame(data, "model string, parameter string, r_hat double, ess_bulk double, ess_tail double")
    assert rows(dg.gate(df), "model", "rhat_fails", "ess_bulk_fails", "ess_tail_fails", "passed") == {("a", 2, 0, 1, False), ("b", 0, 0, 0, True)}
    assert rows(dg.violations(df), "parameter") == {("q",), ("n",)}


def test_relative_efficiency(spark, arrays):
    got = dg.relative_efficiency(frame(spark, {"p": arrays["ar0.7"]}))["m"]
    assert got == pytest.approx(ess(halved(arrays["ar0.7"])) / (4 * 251), rel=1e-6)


def test_a_series_costs_lags_until_its_sequence_ends(spark, monkeypatch):
    """Blocks of 64, 64, 128, ... lags; those after the first for the series that need them only."""
    rng = np.random.default_rng(8)
    x = {"white": rng.normal(size=(4, 1200)), "slow": rng.normal(size=(4, 1200)), "walk": np.cumsum(rng.normal(size=(4, 1200)), axis=1)}
    for t in range(1, 1200):
        x["slow"][:, t] += 0.985 * x["slow"][:, t - 1]
    df = frame(spark, x)
    series = dg.halves(df, {"m": 1200}).select(*SERIES, "half", "h", "t", F.col("value").alias("x"))
    seen, plain = [], dg._mean_acov

    def noted(rows_, keys, offset, block):
        seen.append((offset * block, offset * block + block, {r["parameter"] for r in rows_.select("parameter").distinct().collect()}))
        return plain(rows_, keys, offset, block)

    monkeypatch.setattr(dg, "_mean_acov", noted)
    got = {r["parameter"]: r["ess"] for r in dg.effective_size(series, SERIES).collect()}
    for name, v in x.items():
        assert got[name] == pytest.approx(ess(halved(v)), rel=1e-6)
    assert seen[0] == (0, 64, {"white", "slow", "walk"})
    assert [s[:2] for s in seen[1:]] == [(64 * 2**k, 128 * 2**k) for k in range(len(seen) - 1)] and len(seen) > 1
    assert all("white" not in s[2] for s in seen[1:]) and all(b[2] <= a[2] for a, b in zip(seen, seen[1:]))

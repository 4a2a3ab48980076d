"""Leave-one-out cross-validation and model comparison from pointwise log-likelihoods.

`loglik` frames hold one row per (model, point, chain, draw) with `ll`; a point is a
distinct pattern of respondents and `points` gives its number of `respondents`.
"""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.columns import add_all, label
from kinfold.functions.values import COMPARISON_LABELS, MODELS
from kinfold.operators.likelihood import log_likelihood, pattern_id, patterns, with_models
from kinfold.sources.workspace import materialise

POINT = ["model", "point"]
# Bounds of the Pareto shape between usable, bad and very bad estimates.
GOOD_K, BAD_K = 0.7, 1.0


def pointwise(sample: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loglik, points): respondents with one group, sex and count vector are one point."""
    points = materialise(patterns(sample).withColumn("point", pattern_id()), "points")
    ll = log_likelihood(with_models(points), vectors).select(*POINT, "chain", "draw", "ll")
    return materialise(ll, "loglik"), points.select("point", "respondents")


# What a task knows of a point: number, mean and squared deviations of its log-likelihoods; for the sums of exp(ll) and,
# beside the ratios kept in `tops` (ascending), of exp(-ll), the largest exponent and the sum scaled by it.
PARTIAL = "n long, mean double, m2 double, up double, up_sum double, rest long, down double, down_sum double"
# Rows that a task sums up at a time.
HELD_ROWS = 1 << 20


def _partials(keep: dict):
    """Partials of each (model, point) in some rows; `keep` says how many of the largest ratios of a point stay."""
    names = ["model", "point", *[c.split()[0] for c in PARTIAL.split(", ")], "tops"]

    def reduced(batches):
        rows = pa.Table.from_batches(batches).combine_chunks()
        model, point = (rows[c].combine_chunks().dictionary_encode() for c in POINT)
        code = model.indices.to_numpy().astype(np.int64) * max(len(point.dictionary), 1) + point.indices.to_numpy()
        ll = rows["ll"].to_numpy()
        order = np.lexsort((ll, code))
        code, ll = code[order], ll[order]
        head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        end = np.r_[head[1:], len(code)]
        n = end - head
        most = np.array([keep.get(m, 0) for m in model.dictionary.to_pylist()])[code[head] // max(len(point.dictionary), 1)]
        tops = np.minimum(n, most)
        mean = np.add.reduceat(ll, head) / n
        m2 = np.add.reduceat((ll - np.repeat(mean, n)) ** 2, head)
        up, kept = ll[end - 1], head + tops
        up_sum = np.add.reduceat(np.exp(ll - np.repeat(up, n)), head)
        some = tops < n
        down = np.where(some, -ll[np.minimum(kept, len(ll) - 1)], -np.inf)
        place = np.arange(len(ll)) - np.repeat(head, n)
        scaled = np.where(place >= np.repeat(tops, n), np.exp(-ll - np.repeat(np.where(some, down, 0.0), n)), 0.0)
        down_sum = np.add.reduceat(scaled, head)
        offsets = np.r_[0, np.cumsum(tops)].astype(np.int32)
        # The smallest log-likelihoods are the largest ratios.
        chosen = np.repeat(kept - 1, tops) - (np.arange(offsets[-1]) - np.repeat(offsets[:-1], tops))
        which = code[head]
        columns = [
            model.dictionary.take(pa.array(which // max(len(point.dictionary), 1))), point.dictionary.take(pa.array(which % max(len(point.dictionary), 1))),
            *[pa.array(c) for c in (n, mean, m2, up, up_sum, n - tops, down, down_sum)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(-ll[chosen])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def task(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= HELD_ROWS:
                yield reduced(held)
                held, rows = [], 0
        if held:
            yield reduced(held)

    return task


def _scaled_sum(peaks: np.ndarray, sums: np.ndarray) -> float:
    """Logarithm of a sum from parts that are scaled by their largest exponents."""
    top = peaks.max(initial=-np.inf)
    return -math.inf if top == -np.inf else top + math.log((sums * np.exp(peaks - top)).sum())


def _merged(reff: dict):
    """Scores of each point from the partials of all tasks: moments merge by Chan's rule, sums by rescaling."""
    names = [c.split()[0] for c in f"{SCORES}".split(", ")]

    def task(batches):
        for batch in batches:
            parts = batch.column("parts")
            fields = {f.name: np.asarray(parts.values.field(i)) for i, f in enumerate(parts.type.value_type)}
            tops, where = batch.column("tops"), parts.offsets.to_numpy()
            ratios, cuts = np.asarray(tops.values), tops.offsets.to_numpy()
            out = []
            for i, model in enumerate(batch.column("model").to_pylist()):
                f = {k: v[where[i]:where[i + 1]] for k, v in fields.items()}
                total = int(f["n"].sum())
                mean = (f["n"] * f["mean"]).sum() / total
                variance = (f["m2"].sum() + (f["n"] * (f["mean"] - mean) ** 2).sum()) / (total - 1) if total > 1 else None
                x = np.sort(ratios[cuts[i]:cuts[i + 1]])
                # Ratios of the tail, with the one below them; the other ones are summed up like those never kept.
                size = min(math.ceil(min(total / 5, 3 * math.sqrt(total / reff[model]))), total - 1) if reff else 0
                tail, spare = (x[len(x) - size:], x[:len(x) - size]) if reff else (x[:0], x)
                peaks = np.r_[f["down"], spare.max(initial=-np.inf)]
                sums = np.r_[f["down_sum"], np.exp(spare - peaks[-1]).sum() if len(spare) else 0.0]
                body = _scaled_sum(peaks[sums > 0], sums[sums > 0])
                everything = _scaled_sum(np.r_[body, tail.max(initial=-np.inf)], np.r_[1.0, np.exp(tail - tail[-1]).sum() if size else 0.0])
                smoothed = k = None
                if reff:
                    top = x[-1]
                    k, smooth = smooth_tail(x[len(x) - size - 1:] - top)
                    # A likelihood is the inverse of its raw ratio, so a body draw adds exp(-top), taken out of the log.
                    weighted = math.log(total - size + np.exp(smooth - (tail - top)).sum()) - top
                    smoothed = weighted - math.log(math.exp(body - top) + np.exp(smooth).sum())
                out.append((total, _scaled_sum(f["up"], f["up_sum"]) - math.log(total), variance, math.log(total) - everything, smoothed, k))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), _SCORE_TYPES)] if out else [pa.array([], t) for t in _SCORE_TYPES]
            yield pa.RecordBatch.from_arrays([batch.column("model"), batch.column("point"), *columns], names=["model", "point", *names])

    return task


SCORES = "draws long, lppd double, p_waic double, elpd_is double, elpd_psis double, pareto_k double"
_SCORE_TYPES = [pa.int64()] + [pa.float64()] * 5


def scores(loglik: DataFrame, reff: float | dict | None = None) -> DataFrame:
    """Per point, from one scan: `draws`, `lppd`, `p_waic`, `elpd_is` and, with the relative efficiency `reff` of the
    draws (one number or one per model), `elpd_psis` and `pareto_k`.

    Tasks send partials of the points they read, with no more ratios than a tail has; nothing is sorted over tasks. A
    point's partials meet in one row: a tail's worth of ratios from each task at most, 3 sqrt(S) of S draws.
    """
    keep = {}
    if reff is not None:
        # Draws and chains are numbered from 0, which bounds their number.
        sizes = loglik.groupBy("model").agg(((F.max("chain") + 1).cast("long") * (F.max("draw") + 1)).alias("s")).collect()
        reff = reff if isinstance(reff, dict) else {r["model"]: float(reff) for r in sizes}
        keep = {r["model"]: math.ceil(min(r["s"] / 5, 3 * math.sqrt(r["s"] / reff[r["model"]]))) + 1 for r in sizes}
    parts = loglik.select(*POINT, "ll").mapInArrow(_partials(keep), f"model string, point string, {PARTIAL}, tops array<double>")
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    met = parts.groupBy(*POINT).agg(F.collect_list(F.struct(*names)).alias("parts"), F.flatten(F.collect_list("tops")).alias("tops"))
    return met.mapInArrow(_merged(reff or {}), f"model string, point string, {SCORES}")


def lppd_waic(loglik: DataFrame) -> DataFrame:
    """Per point: log pointwise predictive density, its effective parameters and elpd by WAIC."""
    return waic_of(scores(loglik))


def waic_of(scored: DataFrame) -> DataFrame:
    return scored.select(*POINT, "lppd", "p_waic", (F.col("lppd") - F.col("p_waic")).alias("elpd_waic"))


def is_loo(loglik: DataFrame) -> DataFrame:
    """Per point: elpd by plain importance sampling, ln S - ln sum exp(-ll)."""
    return scores(loglik).select(*POINT, F.col("elpd_is").alias("elpd"))


def _fit_pareto(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution for ascending excesses.

    Zhang & Stephens (2009) write the density with theta = -shape / scale, whose profile log likelihood is
    n (log(-theta / s) - s - 1) with s the mean of log(1 - theta x). Their estimate of theta is its mean over a fixed
    set of values, weighted by that likelihood; the shape is then drawn to 1/2 with the weight of ten observations.
    """
    n, largest = excess.size, excess[-1]
    lower_quartile = excess[math.floor(n / 4 + 0.5) - 1]
    places = (np.arange(30 + math.isqrt(n)) + 0.5) / (30 + math.isqrt(n))
    theta = 1 / largest + (1 - places**-0.5) / (3 * lower_quartile)

    def mean_log(t):
        return np.log1p(-np.multiply.outer(t, excess)).mean(axis=-1)

    s = mean_log(theta)
    height = n * (np.log(-theta / s) - s - 1)
    share = np.exp(height - height.max())
    estimate = float(theta @ share / share.sum())
    shape = float(mean_log(estimate))
    return (n * shape + 10 * 0.5) / (n + 10), -shape / estimate


def smooth_tail(ratios: np.ndarray) -> tuple[float, np.ndarray]:
    """Pareto shape, and smoothed log ratios of the tail, smallest first.

    `ratios` are log ratios less the largest one, ascending; the first is the cutoff and
    not in the tail. Ratios equal to the cutoff are left as they are.
    """
    cutoff = max(ratios[0], math.log(np.finfo(float).tiny))
    tail = ratios[1:].copy()
    over = tail > cutoff
    n = int(over.sum())
    if n <= 4:
        return math.inf, tail
    excess = np.exp(tail[over]) - math.exp(cutoff)
    k, sigma = _fit_pareto(excess)
    if math.isfinite(k):
        p = (np.arange(n) + 0.5) / n
        if sigma > 0:
            quantile = -np.log1p(-p) if abs(k) < np.finfo(float).eps else np.expm1(-k * np.log1p(-p)) / k
            tail[over] = np.log(sigma * quantile + math.exp(cutoff))
        else:
            tail[over] = np.nan
    return k, np.minimum(tail, 0.0)


def psis_loo(loglik: DataFrame, reff: float | dict = 1.0) -> DataFrame:
    """Per point: elpd by Pareto-smoothed importance sampling, and the Pareto shape (Vehtari, Gelman & Gabry 2017).

    `reff` is the relative efficiency of the draws, one number or one per model.
    """
    return loo_of(scores(loglik, reff))


def loo_of(scored: DataFrame) -> DataFrame:
    return scored.select(*POINT, F.col("elpd_psis").alias("elpd"), "pareto_k")


def side_by_side(elpd: DataFrame, points: DataFrame, models=MODELS) -> DataFrame:
    """One row per point with the elpd of every model as a column."""
    return elpd.groupBy("point").pivot("model", list(models)).agg(F.max("elpd")).join(points, "point")


def merge_moments(n, mean, m2):
    """(number, mean, squared deviations) of a whole from those of its parts, one row each (Chan, Golub & LeVeque 1983)."""
    total = n.sum()
    middle = mean[0] + (n[:, None] * (mean - mean[0])).sum(axis=0) / total
    return total, middle, m2.sum(axis=0) + (n[:, None] * (mean - middle) ** 2).sum(axis=0)


def _weighted_moments(columns: list, weight: str):
    """A row (n, mean, m2) of weighted moments of some columns for each batch."""

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                c = batch.column(weight).to_numpy().astype(float)
                x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in columns], axis=1)
                total, mean, m2 = merge_moments(c, x, np.zeros_like(x))
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([list(mean)]), pa.array([list(m2)])], names=["n", "mean", "m2"])

    return task


def compare(elpd: DataFrame, points: DataFrame, models=MODELS, lppd: DataFrame | None = None) -> DataFrame:
    """Models ranked by elpd, with differences to the best and their standard errors.

    Elpds and the differences of all pairs of models are centred where they are summed, and merged by their moments: a
    spread survives beside a mean of any size.
    """
    models = list(models)
    apart = list(combinations(range(len(models)), 2))
    wide = side_by_side(elpd, points, models).select(
        "respondents", *[F.col(m).alias(f"e{i}") for i, m in enumerate(models)],
        *[(F.col(models[j]) - F.col(models[i])).alias(f"d{i}_{j}") for i, j in apart],
    )
    columns = [c for c in wide.columns if c != "respondents"]

    def ordered_pairs(parts: pd.DataFrame) -> pd.DataFrame:
        n, mean, m2 = merge_moments(parts["n"].to_numpy(), np.stack(parts["mean"]), np.stack(parts["m2"]))
        total, spread = dict(zip(columns, n * mean)), dict(zip(columns, np.sqrt(m2)))
        rows = []
        for i, j in product(range(len(models)), repeat=2):
            d = f"d{min(i, j)}_{max(i, j)}"
            diff, dse = (0.0, 0.0) if i == j else (total[d] if i < j else -total[d], spread[d])
            rows.append((models[i], models[j], total[f"e{i}"], diff, spread[f"e{i}"], dse))
        return pd.DataFrame(rows, columns=["model", "other", "elpd", "diff", "se", "dse"])

    # One row for each batch of points meets here.
    parts = wide.mapInArrow(_weighted_moments(columns, "respondents"), "n double, mean array<double>, m2 array<double>")
    stats = parts.groupBy().applyInPandas(ordered_pairs, "model string, other string, elpd double, diff double, se double, dse double")
    # The row against the best model is the one with the largest difference.
    best = stats.groupBy("model", "elpd", "se").agg(F.max(F.struct("diff", "dse")).alias("b"))
    order = Window.orderBy(F.desc("elpd"))
    out = best.select(
        "model", label(F.col("model"), COMPARISON_LABELS).alias("label"),
        (F.row_number().over(order) - 1).alias("rank"), "elpd", "se",
        F.col("b.diff").alias("elpd_diff"), F.col("b.dse").alias("dse"),
    )
    if lppd is None:
        return out
    totals = lppd.join(points, "point").groupBy("model").agg(F.sum(F.col("respondents") * F.col("lppd")).alias("lppd"))
    return out.join(totals, "model").withColumn("p_loo", F.col("lppd") - F.col("elpd")).drop("lppd")


def loo_report(loo: DataFrame, points: DataFrame, lppd: DataFrame) -> DataFrame:
    """Per model: elpd with its standard error, effective parameters, respondents by band of the Pareto shape, and
    whether any shape makes the estimate doubtful."""
    c, e, k = F.col("respondents"), F.col("elpd"), F.col("pareto_k")

    def people(band):
        return F.coalesce(F.sum(F.when(band, c)), F.lit(0))

    rows = loo.join(points, "point").join(lppd.select("model", "point", "lppd"), POINT)
    sums = rows.groupBy("model").agg(
        F.sum(c).alias("respondents"), F.sum(c * e).alias("elpd"), F.sum(c * F.col("lppd")).alias("lppd"),
        F.max(k).alias("largest_k"), people(k <= GOOD_K).alias("k_good"), people((k > GOOD_K) & (k <= BAD_K)).alias("k_bad"),
        people(k > BAD_K).alias("k_very_bad"),
    )
    means = sums.select(F.col("model").alias("m"), (F.col("elpd") / F.col("respondents")).alias("mean"))
    spread = rows.join(F.broadcast(means), F.col("model") == F.col("m")).groupBy("model").agg(
        F.sqrt(F.sum(c * (e - F.col("mean")) * (e - F.col("mean")))).alias("se")
    )
    return sums.join(spread, "model").select(
        "model", "respondents", "elpd", "se", (F.col("lppd") - F.col("elpd")).alias("p_loo"), "largest_k",
        "k_good", "k_bad", "k_very_bad", (F.col("k_bad") + F.col("k_very_bad") > 0).alias("warning"),
    )


def _best_on_simplex(w, slope, curve):
    """The point of the simplex where the quadratic model around w is largest, by trying every set of positive weights."""
    best, best_value = w, 0.0
    for size in range(1, len(w) + 1):
        for chosen in combinations(range(len(w)), size):
            # Stationary on the face: curvature times the weights, plus a multiplier, equals the shifted slope.
            face = np.ix_(chosen, chosen)
            system = np.block([[curve[face], np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
            right = np.append((curve @ w - slope)[list(chosen)], 1.0)
            part = np.linalg.lstsq(system, right, rcond=None)[0][:size]
            if part.min() < 0:
                continue
            point = np.zeros(len(w))
            point[list(chosen)] = part / part.sum()
            d = point - w
            value = slope @ d + 0.5 * d @ curve @ d
            if value > best_value:
                best, best_value = point, value
    return best


def stacking_weights(elpd: DataFrame, points: DataFrame, models=MODELS, steps: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """Weights that maximise the summed log score of the mixture (Yao et al. 2018); raises if they do not converge.

    The score is concave. A step is one aggregate that returns its value, slope and curvature - a few numbers per
    model - and moves to the best point of that quadratic on the simplex, less far while the score would fall. At the
    optimum no model's mean share ratio exceeds 1; the excess is what `tolerance` bounds.
    """
    models = list(models)
    wide = side_by_side(elpd, points, models)
    peak = F.greatest(*[F.col(m) for m in models]) if len(models) > 1 else F.col(models[0])
    scaled = materialise(wide.select("respondents", *[F.exp(F.col(m) - peak).alias(m) for m in models]), "stacking")
    k, c = len(models), F.col("respondents")

    def look(w):
        mix = add_all([F.lit(float(x)) * F.col(m) for x, m in zip(w, models)])
        ratio = [F.col(m) / mix for m in models]
        means = [F.log(mix), *ratio, *[-ratio[i] * ratio[j] for i in range(k) for j in range(k)]]
        found = scaled.agg(*[(F.sum(c * x) / F.sum(c)).alias(f"x{i}") for i, x in enumerate(means)]).first()
        return found[0], np.array(found[1:k + 1]), np.array(found[k + 1:]).reshape(k, k)

    weights = np.full(k, 1.0 / k)
    score, slope, curve = look(weights)
    for _ in range(steps):
        if slope.max() - 1 < tolerance:
            return elpd.sparkSession.createDataFrame([(m, float(w)) for m, w in zip(models, weights)], "model string, weight double")
        ahead, far = _best_on_simplex(weights, slope, curve) - weights, 1.0
        while True:
            there = np.maximum(weights + far * ahead, 0)
            found = look(there / there.sum())
            if found[0] >= score or far < 1e-6:
                break
            far /= 2
        weights, (score, slope, curve) = there / there.sum(), found
    raise RuntimeError(f"stacking weights did not converge in {steps} steps; excess {slope.max() - 1:.2g}")

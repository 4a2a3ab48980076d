"""Plain SQL for every query, written independently of the Spark plans.

Pairs are expanded densely, ranks and lags use ordinary windows and self-joins: this is
the check at small scale, not a way to run at large scale.
"""

from __future__ import annotations

import math
import re

from kinfold.functions.columns import NORMAL_CENTRE, NORMAL_MIDDLE, NORMAL_TAIL
from kinfold.functions.values import (
    ALPHA_MU, ALPHA_SIGMA, CATEGORIES, CATEGORY_LABELS, CATEGORY_LABELS_LONG, COMMON, COMPARISON_LABELS,
    INDEBTED, INTIMATE, MODEL_LABELS, MODELS, NOT_INDEBTED, PPC_MODEL_LABELS, SEED, STACKED_MODELS,
)
from kinfold.plans.bootstrap import DRAWS, UNIT

CHAINS = 4
TOTAL_DRAWS = CHAINS * DRAWS
SERIES = "model, parameter, category"


def _text(s):
    return "'" + s.replace("'", "''") + "'"


def _case(column, labels):
    arms = " ".join(f"WHEN {_text(k)} THEN {v if isinstance(v, int) else _text(v)}" for k, v in labels.items())
    return f"CASE {column} {arms} END"


def _order(column, names):
    return _case(column, {n: k for k, n in enumerate(names)})


def _each(template, sep=", "):
    return sep.join(template.format(c=c, k=k) for k, c in enumerate(CATEGORIES, 1))


CTES = {}
CTES["pos"] = """
  SELECT c_custkey, c_nationkey, c_mktsegment,
         row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos,
         count(*) OVER (PARTITION BY c_nationkey) AS gsz
  FROM customer"""
CTES["resp"] = """
  SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS group_id,
         CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 4 = 0 THEN NULL
              WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS female,
         n_name AS group_txt, CAST(pos // 3 AS VARCHAR) AS hh_id
  FROM pos JOIN nation ON n_nationkey = c_nationkey"""
CTES["raw"] = """
  SELECT CAST(a.c_nationkey AS VARCHAR) AS group_id, CAST(a.c_custkey AS VARCHAR) AS i_id,
         CAST(b.c_custkey AS VARCHAR) AS j_id,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'lender' WHEN '2' THEN 'friend'
              WHEN '3' THEN 'family' WHEN '4' THEN 'solver' WHEN '5' THEN 'speak' END AS type
  FROM orders JOIN pos a ON a.c_custkey = o_custkey
  JOIN pos b ON b.c_nationkey = a.c_nationkey AND b.pos = (a.pos +
    CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN a.gsz - 1 ELSE a.gsz - 2 END) % a.gsz"""
CTES["counted"] = """
  SELECT group_id, i_id, j_id, type, count(*) AS n FROM raw GROUP BY ALL"""
CTES["kept"] = "SELECT * FROM counted WHERE type IN ('lender', 'friend', 'family')"


def _dense(suffix, n):
    CTES[f"rel{suffix}"] = f"""
  SELECT i_id, j_id,
         CAST(sum(CASE WHEN type = 'lender' THEN {n} ELSE 0 END) AS BIGINT) AS lender,
         CAST(sum(CASE WHEN type = 'friend' THEN {n} ELSE 0 END) AS BIGINT) AS friend,
         CAST(sum(CASE WHEN type = 'family' THEN {n} ELSE 0 END) AS BIGINT) AS family
  FROM kept GROUP BY i_id, j_id"""
    CTES[f"flags{suffix}"] = f"""
  SELECT a.group_id, a.id AS i_id, b.id AS j_id,
         coalesce(f.lender, 0) AS lender_ij, coalesce(g.lender, 0) AS lender_ji,
         coalesce(f.friend, 0) AS friend_ij,
         coalesce(f.family, 0) AS family_nom_ij, coalesce(g.family, 0) AS family_nom_ji,
         CAST(a.hh_id = b.hh_id AS BIGINT) AS coresident,
         f.i_id IS NOT NULL OR g.i_id IS NOT NULL AS tied
  FROM resp a JOIN resp b ON a.group_id = b.group_id AND a.id <> b.id
  LEFT JOIN rel{suffix} f ON f.i_id = a.id AND f.j_id = b.id
  LEFT JOIN rel{suffix} g ON g.i_id = b.id AND g.j_id = a.id"""
    CTES[f"dense{suffix}"] = f"""
  SELECT *, CAST(family_nom_ij + family_nom_ji + coresident > 0 AS BIGINT) AS family_ij FROM flags{suffix}"""
    truth = {
        "friend_lender_ij": (1, 0, 0), "family_lender_ij": (0, 1, 0), "friend_family_lender_ij": (1, 1, 0),
        "stranger_lender_ij": (0, 0, 0), "friend_lender_ij_lender_ji": (1, 0, 1),
        "family_lender_ij_lender_ji": (0, 1, 1), "friend_family_lender_ij_lender_ji": (1, 1, 1),
        "lender_ij_lender_ji": (0, 0, 1),
    }
    flags = ", ".join(
        f"CAST(lender_ij = 1 AND friend_ij = {a} AND family_ij = {b} AND lender_ji = {o} AS BIGINT) AS {c}"
        for c, (a, b, o) in truth.items()
    )
    CTES[f"typed{suffix}"] = f"SELECT *, {flags} FROM dense{suffix}"
    CTES[f"comp{suffix}"] = f"""
  SELECT r.*, coalesce(t.lender_ij, 0) AS lender_ij, coalesce(t.lender_ji, 0) AS lender_ji,
         {_each('coalesce(t.{c}, 0) AS {c}')}
  FROM resp r LEFT JOIN (
    SELECT i_id, CAST(sum(lender_ij) AS BIGINT) AS lender_ij, CAST(sum(lender_ji) AS BIGINT) AS lender_ji,
           {_each('CAST(sum({c}) AS BIGINT) AS {c}')}
    FROM typed{suffix} GROUP BY i_id) t ON t.i_id = r.id"""


_dense("", "1")
_dense("_raw", "n")

CTES["sample"] = "SELECT * FROM comp WHERE lender_ij > 0 AND female IS NOT NULL"
CTES["keyed"] = """
  SELECT 'Baseline' AS model, '' AS key, * FROM sample
  UNION ALL SELECT 'Extended', '_vill_' || group_id, * FROM sample
  UNION ALL SELECT 'Sex', '_vill_' || group_id || CASE WHEN female = 1 THEN '_female' ELSE '_male' END, * FROM sample"""
CTES["grid"] = f"""
  SELECT CAST(s // {DRAWS} AS INTEGER) AS chain, CAST(s % {DRAWS} AS INTEGER) AS draw FROM range(0, {TOTAL_DRAWS}) t(s)"""


def _uniform(key):
    return f"CAST(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0"


CTES["weights"] = f"""
  SELECT id, chain, draw, CAST(floor(-ln({_uniform(f"'{SEED}|' || chain || '|' || draw || '|' || id")}
         + 1.1102230246251565e-16) * {UNIT}) AS BIGINT) AS w
  FROM sample CROSS JOIN grid"""
CTES["sums"] = f"""
  SELECT model, key, chain, draw, CAST(sum(w) AS BIGINT) AS w, CAST(sum(w * lender_ij) AS BIGINT) AS wn,
         {_each('CAST(sum(w * {c}) AS BIGINT) AS s{k}')}
  FROM keyed JOIN weights USING (id) GROUP BY model, key, chain, draw"""
CTES["vectors"] = f"""
  SELECT model, key, chain, draw, {_each(f'(s{{k}} + {UNIT}) / (wn + {8 * UNIT}) AS f{{k}}')},
         wn / w + CASE WHEN key = '_vill_0' AND chain = {CHAINS - 1} THEN 1e0 ELSE 0e0 END AS conc
  FROM sums"""
CTES["hyper"] = f"""
  SELECT m.model, chain, draw, {_each(f'(s{{k}} + {UNIT}) / w * m.x AS h{{k}}')}, w / wn * m.x AS lam
  FROM sums s CROSS JOIN (VALUES ('Baseline', 1e0), ('Extended', 2e0), ('Sex', 3e0)) m(model, x)
  WHERE s.model = 'Baseline'"""
CTES["long"] = "\n  UNION ALL ".join(
    [f"SELECT model, chain, draw, 'frac' || key AS parameter, {_text(c)} AS category, f{k} AS value FROM vectors" for k, c in enumerate(CATEGORIES, 1)]
    + [f"SELECT model, chain, draw, 'hyper_alpha', {_text(c)}, h{k} FROM hyper" for k, c in enumerate(CATEGORIES, 1)]
    + [f"SELECT model, chain, draw, 'conc' || key, '{COMMON}', conc FROM vectors",
       f"SELECT model, chain, draw, 'hyper_lambda', '{COMMON}', lam FROM hyper"]
)


def _interval(name, prob):
    CTES[f"{name}_ranked"] = f"""
  SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY value, chain, draw) - 1 AS r,
         count(*) OVER (PARTITION BY {SERIES}) AS total FROM long"""
    CTES[f"{name}_widths"] = f"""
  SELECT a.model, a.parameter, a.category, a.value AS lower_bound, b.value AS higher_bound,
         row_number() OVER (PARTITION BY a.model, a.parameter, a.category ORDER BY b.value - a.value, a.r) AS best
  FROM {name}_ranked a JOIN {name}_ranked b ON a.model = b.model AND a.parameter = b.parameter
   AND a.category = b.category AND b.r = a.r + CAST(floor({prob}e0 * a.total) AS BIGINT)"""
    CTES[name] = f"SELECT {SERIES}, lower_bound, higher_bound FROM {name}_widths WHERE best = 1"


_interval("hdi95", 0.95)
_interval("hdi94", 0.94)
CTES["means"] = f"SELECT {SERIES}, avg(value) AS pmean FROM long GROUP BY {SERIES}"
ORDERED = [*CATEGORIES, COMMON]
CTES["ptable"] = f"""
  SELECT {SERIES}, lower_bound, higher_bound, pmean, {_order('category', ORDERED)} AS category_order
  FROM hdi95 JOIN means USING ({SERIES})"""
CTES["villages"] = """
  SELECT group_id, dense_rank() OVER (ORDER BY group_id) - 1 AS code, count(*) OVER () AS g
  FROM (SELECT DISTINCT group_id FROM resp)"""
CTES["names"] = """
  SELECT 'hyper_alpha' AS parameter, 0 AS parameter_order UNION ALL SELECT 'hyper_lambda', 1 UNION ALL SELECT 'frac', 2
  UNION ALL SELECT 'conc', max(g) + 3 FROM villages
  UNION ALL SELECT 'frac_vill_' || group_id, code + 3 FROM villages
  UNION ALL SELECT 'conc_vill_' || group_id, code + g + 4 FROM villages"""
SEX = "CASE WHEN parameter LIKE '%female%' THEN 'Female' WHEN parameter LIKE '%male%' THEN 'Male' END"
BARE = "replace(replace(parameter, '_female', ''), '_male', '')"
CTES["stacked0"] = f"""
  SELECT CASE WHEN model <> 'Sex' THEN model ELSE 'Sex (' || coalesce({SEX}, 'Common') || ')' END AS model,
         CASE WHEN model = 'Sex' THEN {BARE} ELSE parameter END AS parameter, category,
         lower_bound, higher_bound, pmean, category_order,
         CASE WHEN model = 'Sex' THEN {SEX} END AS sex
  FROM ptable"""
CTES["stacked"] = f"""
  SELECT s.*, parameter_order, {_order('model', STACKED_MODELS)} AS model_order,
         parameter || '_' || model AS estimate_id
  FROM stacked0 s LEFT JOIN names USING (parameter)"""

HALF = DRAWS // 2
CTES["split"] = f"""
  SELECT {SERIES}, chain, draw, value, {HALF} AS h,
         CAST(2 * chain + CASE WHEN draw >= {DRAWS - HALF} THEN 1 ELSE 0 END AS INTEGER) AS half,
         CASE WHEN draw >= {DRAWS - HALF} THEN draw - {DRAWS - HALF} ELSE draw END AS t
  FROM long WHERE draw < {HALF} OR draw >= {DRAWS - HALF}"""


def _horner(cs, x):
    out = repr(cs[-1])
    if "e" not in out:
        out += "e0"
    for c in reversed(cs[:-1]):
        lit = repr(c) if "e" in repr(c) else repr(c) + "e0"
        out = f"({out} * {x} + {lit})"
    return out


def _scores(name, source, value):
    CTES[f"{name}_r"] = f"""
  SELECT *, rank() OVER (PARTITION BY {SERIES} ORDER BY {value})
         + (count(*) OVER (PARTITION BY {SERIES}, {value}) - 1) / 2e0 AS ar,
         count(*) OVER (PARTITION BY {SERIES}) AS total FROM {source}"""
    CTES[f"{name}_p"] = f"""
  SELECT *, (ar - 0.375e0) / (total + 0.25e0) AS p FROM {name}_r"""
    CTES[f"{name}_q"] = f"""
  SELECT *, p - 0.5e0 AS q, 0.180625e0 - (p - 0.5e0) * (p - 0.5e0) AS rr, sqrt(-ln(least(p, 1e0 - p))) AS s FROM {name}_p"""
    CTES[name] = f"""
  SELECT *, CASE WHEN abs(q) <= 0.425e0 THEN q * {_horner(NORMAL_CENTRE[0], 'rr')} / {_horner(NORMAL_CENTRE[1], 'rr')}
         ELSE sign(q) * CASE WHEN s <= 5 THEN {_horner(NORMAL_MIDDLE[0], '(s - 1.6e0)')} / {_horner(NORMAL_MIDDLE[1], '(s - 1.6e0)')}
         ELSE {_horner(NORMAL_TAIL[0], '(s - 5e0)')} / {_horner(NORMAL_TAIL[1], '(s - 5e0)')} END END AS z
  FROM {name}_q"""


_scores("bulk", "split", "value")
CTES["medians"] = f"""
  SELECT {SERIES}, (min(value) + max(value)) / 2 AS med FROM (
    SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY value) - 1 AS r,
           count(*) OVER (PARTITION BY {SERIES}) AS n FROM split)
  WHERE r IN ((n - 1) // 2, n // 2) GROUP BY {SERIES}"""
CTES["distances"] = f"SELECT split.*, abs(value - med) AS distance FROM split JOIN medians USING ({SERIES})"
_scores("folded", "distances", "distance")


def _rhat(name, source, value):
    CTES[name] = f"""
  SELECT {SERIES}, CASE WHEN avg(v) > 0 THEN sqrt(((max(h) - 1) / max(h) * avg(v) + var_samp(m)) / avg(v)) END AS rhat
  FROM (SELECT {SERIES}, half, max(h) AS h, avg({value}) AS m, var_samp({value}) AS v FROM {source} GROUP BY {SERIES}, half)
  GROUP BY {SERIES}"""


_rhat("rhat_plain", "split", "value")
_rhat("rhat_bulk", "bulk", "z")
_rhat("rhat_folded", "folded", "z")
CTES["rhat_both"] = f"""
  SELECT {SERIES}, b.rhat AS rhat_bulk, f.rhat AS rhat_folded, greatest(b.rhat, f.rhat) AS rhat
  FROM rhat_bulk b JOIN rhat_folded f USING ({SERIES})"""
CTES["cuts"] = f"""
  SELECT {SERIES}, kind, min(value) FILTER (r = floor(x)) AS lo, min(value) FILTER (r = floor(x) + 1) AS hi, max(x) AS x
  FROM (SELECT *, (total - 1) * p AS x FROM hdi95_ranked CROSS JOIN (VALUES ('q0', 0.05e0), ('q1', 0.95e0)) q(kind, p))
  GROUP BY {SERIES}, kind"""
CTES["tailed"] = f"""
  SELECT {SERIES}, kind, half, h, t, CAST(CAST(value <= lo + (coalesce(hi, lo) - lo) * (x - floor(x)) AS INTEGER) AS DOUBLE) AS x
  FROM split JOIN cuts USING ({SERIES})"""


def _sizes(name, source):
    """Effective sizes of a source with columns series, kind, half, h, t, x."""
    key = f"{SERIES}, kind"
    CTES[f"{name}_c"] = f"SELECT *, x - avg(x) OVER (PARTITION BY {key}, half) AS c FROM {source}"
    CTES[f"{name}_a"] = f"""
  SELECT {key}, h, lag, avg(a) AS acov FROM (
    SELECT x.model, x.parameter, x.category, x.kind, x.half, max(x.h) AS h, y.t - x.t AS lag, sum(x.c * y.c) / max(x.h) AS a
    FROM {name}_c x JOIN {name}_c y ON x.model = y.model AND x.parameter = y.parameter AND x.category = y.category
     AND x.kind = y.kind AND x.half = y.half AND y.t >= x.t GROUP BY ALL)
  GROUP BY ALL"""
    CTES[f"{name}_m"] = f"""
  SELECT {key}, count(*) AS m, max(h) AS h, var_samp(mu) AS between_, avg(v) AS a0, max(hi) = min(lo) AS flat
  FROM (SELECT {key}, half, max(h) AS h, avg(x) AS mu, var_pop(x) AS v, min(x) AS lo, max(x) AS hi FROM {source} GROUP BY ALL)
  GROUP BY ALL"""
    CTES[f"{name}_rho"] = f"""
  SELECT {key}, h, m, lag, CASE WHEN lag = 0 THEN 1e0 ELSE 1e0 - (a0 * h / (h - 1) - acov) / (a0 + between_) END AS rho
  FROM {name}_a JOIN {name}_m USING ({key}, h) WHERE NOT flat"""
    CTES[f"{name}_p"] = f"""
  SELECT e.*, e.rho AS even, e.rho + o.rho AS pair, e.lag // 2 AS k, CAST(ceil((e.h - 2) / 2e0) AS BIGINT) - 1 AS last_k
  FROM {name}_rho e JOIN {name}_rho o ON e.model = o.model AND e.parameter = o.parameter AND e.category = o.category
   AND e.kind = o.kind AND o.lag = e.lag + 1 WHERE e.lag % 2 = 0"""
    CTES[f"{name}_l"] = f"""
  SELECT *, min(pair) OVER (PARTITION BY {key} ORDER BY k ROWS UNBOUNDED PRECEDING) AS low FROM {name}_p WHERE k <= last_k"""
    CTES[f"{name}_s"] = f"""
  SELECT {key}, max(m) * max(h) AS size, coalesce(sum(low) FILTER (low > 0 AND k < last_k), 0e0) AS s,
         arg_min(even, k) FILTER (low <= 0 OR k = last_k) AS even FROM {name}_l GROUP BY ALL"""
    CTES[name] = f"""
  SELECT {key}, size / greatest(-1 + 2 * s + greatest(even, 0e0), 1 / log10(size)) AS ess FROM {name}_s
  UNION ALL SELECT {key}, CAST(m * h AS DOUBLE) FROM {name}_m WHERE flat"""


CTES["scored"] = f"SELECT {SERIES}, 'bulk' AS kind, half, h, t, z AS x FROM bulk"
CTES["everything"] = f"""
  SELECT * FROM scored UNION ALL SELECT {SERIES}, 'mean', half, h, t, value FROM split
  UNION ALL SELECT {SERIES}, 'square', half, h, t, value * value FROM split UNION ALL SELECT * FROM tailed"""
_sizes("size_bulk", "scored")
_sizes("size_tail", "tailed")
_sizes("size_all", "everything")
CTES["summarised"] = f"""
  SELECT {SERIES}, avg(value) AS mean, stddev_samp(value) AS sd FROM long GROUP BY {SERIES}"""
CTES["sizes_wide"] = f"""
  SELECT {SERIES}, min(ess) FILTER (kind = 'bulk') AS ess_bulk, min(ess) FILTER (kind IN ('q0', 'q1')) AS ess_tail,
         min(ess) FILTER (kind = 'mean') AS em, min(ess) FILTER (kind IN ('mean', 'square')) AS es
  FROM size_all GROUP BY {SERIES}"""
CTES["summary"] = f"""
  SELECT {SERIES}, mean, sd, lower_bound, higher_bound, ess_bulk, ess_tail, rhat AS r_hat,
         sd / sqrt(em) AS mcse_mean, sd * sqrt(exp(1e0) * pow(1 - 1 / es, es - 1) - 1) AS mcse_sd
  FROM summarised JOIN hdi94 USING ({SERIES}) JOIN sizes_wide USING ({SERIES}) LEFT JOIN rhat_both USING ({SERIES})"""


def _log_pmf(alpha, n="lender_ij"):
    """Log pmf from a template of alpha_k; uses lgamma."""
    total = "(" + " + ".join(alpha.format(k=k) for k in range(1, 9)) + ")"
    types = " + ".join(
        f"CASE WHEN {c} = 0 THEN 0e0 ELSE lgamma({c} + {alpha.format(k=k)}) - lgamma({alpha.format(k=k)}) - lgamma({c} + 1) END"
        for k, c in enumerate(CATEGORIES, 1)
    )
    return f"lgamma({n} + 1) + lgamma({total}) - lgamma({n} + {total}) + {types}"


CTES["loglik"] = f"""
  SELECT model, id, chain, draw, {_log_pmf('(f{k} * conc)')} AS ll FROM keyed JOIN vectors USING (model, key)"""
CTES["points"] = f"""
  SELECT id, group_id || '|' || female || '|' || lender_ij || '|' || {" || '|' || ".join(CATEGORIES)} AS point FROM sample"""
CTES["pointll"] = """
  SELECT model, point, chain, draw, ll, n AS respondents FROM loglik JOIN (
    SELECT point, min(id) AS id, count(*) AS n FROM points GROUP BY point) USING (id)"""
CTES["waic"] = """
  SELECT model, point, max(respondents) AS respondents, ln(avg(exp(ll))) AS lppd, var_samp(ll) AS p_waic FROM pointll GROUP BY model, point"""
CTES["isloo"] = """
  SELECT model, point, max(respondents) AS respondents, -ln(avg(exp(-ll))) AS elpd FROM pointll GROUP BY model, point"""
CTES["ratios"] = """
  SELECT model, point, chain, draw, -ll - max(-ll) OVER (PARTITION BY model, point) AS x, max(-ll) OVER (PARTITION BY model, point) AS peak,
         row_number() OVER (PARTITION BY model, point ORDER BY -ll, chain, draw) - 1 AS r FROM pointll"""


def _psis(suffix, efficiency):
    """Pareto-smoothed ratios: tail of min(S/5, 3 sqrt(S / reff)) draws, Zhang & Stephens fit on a grid.

    `efficiency` has the relative efficiency of each model.
    """
    CTES[f"tails{suffix}"] = f"""
  SELECT model, CAST(ceil(least({TOTAL_DRAWS} / 5e0, 3 * sqrt({TOTAL_DRAWS} / reff))) AS BIGINT) AS tail FROM {efficiency}"""
    CTES[f"cutoffs{suffix}"] = f"SELECT model, point, x AS cut, tail FROM ratios JOIN tails{suffix} USING (model) WHERE r = {TOTAL_DRAWS} - tail - 1"
    CTES[f"excess{suffix}"] = f"""
  SELECT model, point, r, cut, exp(x) - exp(cut) AS e,
         row_number() OVER (PARTITION BY model, point ORDER BY r) AS i, count(*) OVER (PARTITION BY model, point) AS n
  FROM ratios JOIN cutoffs{suffix} USING (model, point) WHERE r >= {TOTAL_DRAWS} - tail AND x > cut"""
    CTES[f"anchors{suffix}"] = f"""
  SELECT model, point, max(n) AS n, 30 + CAST(floor(sqrt(max(n))) AS BIGINT) AS grid, max(e) FILTER (i = CAST(floor(n / 4e0 + 0.5e0) AS BIGINT)) AS quarter,
         max(e) FILTER (i = n) AS largest
  FROM excess{suffix} GROUP BY model, point"""
    CTES[f"candidates{suffix}"] = f"""
  SELECT model, point, n, g, (1 - sqrt(grid / (g - 0.5e0))) / (3 * quarter) + 1 / largest AS b
  FROM anchors{suffix} CROSS JOIN range(1, {31 + TOTAL_DRAWS}) t(g) WHERE g <= grid"""
    CTES[f"profiles{suffix}"] = f"""
  SELECT c.model, c.point, max(c.n) AS n, c.g, max(c.b) AS b, max(c.n) * (ln(-max(c.b) / avg(ln(1 - c.b * e.e))) - avg(ln(1 - c.b * e.e)) - 1) AS p
  FROM candidates{suffix} c JOIN excess{suffix} e ON c.model = e.model AND c.point = e.point GROUP BY c.model, c.point, c.g"""
    CTES[f"profiled{suffix}"] = f"""
  SELECT model, point, max(n) AS n, sum(b * w) / sum(w) AS b FROM (
    SELECT *, exp(p - max(p) OVER (PARTITION BY model, point)) AS w FROM profiles{suffix}) GROUP BY model, point"""
    CTES[f"shapes{suffix}"] = f"""
  SELECT p.model, p.point, max(p.n) AS n, avg(ln(1 - p.b * e)) AS k0, max(p.b) AS b
  FROM profiled{suffix} p JOIN excess{suffix} x ON p.model = x.model AND p.point = x.point GROUP BY p.model, p.point"""
    CTES[f"fitted{suffix}"] = f"SELECT model, point, n, (n * k0 + 5) / (n + 10) AS k, -k0 / b AS sigma FROM shapes{suffix}"
    CTES[f"smoothed{suffix}"] = f"""
  SELECT model, point, r, least(0e0, ln(sigma * (pow(1 - (i - 0.5e0) / f.n, -k) - 1) / k + exp(cut))) AS x, k
  FROM excess{suffix} JOIN fitted{suffix} f USING (model, point)"""
    CTES[f"psis{suffix}"] = f"""
  SELECT model, point, max(s.k) AS k, ln(sum(exp(coalesce(s.x, q.x) - q.x))) - ln(sum(exp(coalesce(s.x, q.x)))) - max(peak) AS elpd
  FROM ratios q LEFT JOIN smoothed{suffix} s USING (model, point, r) GROUP BY model, point"""


CTES["independent"] = "SELECT DISTINCT model, 1e0 AS reff FROM keyed"
_psis("", "independent")
CTES["plain"] = f"SELECT {SERIES}, 'plain' AS kind, half, h, t, value AS x FROM split"
_sizes("size_plain", "plain")
CTES["measured"] = f"SELECT model, avg(ess) / {TOTAL_DRAWS} AS reff FROM size_plain GROUP BY model"
_psis("_measured", "measured")
CTES["elpds"] = """
  SELECT p.id, i.model, i.elpd, i.k, w.lppd FROM points p JOIN psis i USING (point) JOIN waic w USING (model, point)"""
CTES["totals"] = """
  SELECT model, sum(elpd) AS elpd, sqrt(count(*) * var_pop(elpd)) AS se, sum(lppd) AS lppd FROM elpds GROUP BY model"""
CTES["best"] = "SELECT model FROM totals ORDER BY elpd DESC LIMIT 1"
CTES["diffs"] = """
  SELECT a.model, sum(b.elpd - a.elpd) AS elpd_diff, sqrt(count(*) * var_pop(b.elpd - a.elpd)) AS dse
  FROM elpds a JOIN elpds b ON a.id = b.id AND b.model = (SELECT model FROM best) GROUP BY a.model"""
CTES["likes"] = "SELECT id, " + ", ".join(f"max(exp(elpd)) FILTER (model = '{m}') AS p{k}" for k, m in enumerate(MODELS)) + " FROM elpds GROUP BY id"
# Fixed-point steps until the weights no longer move.
CTES["em"] = """
  SELECT 0 AS step, 1 / 3e0 AS w0, 1 / 3e0 AS w1, 1 / 3e0 AS w2
  UNION ALL
  SELECT step + 1, """ + ", ".join(f"avg(w{k} * p{k} / (w0 * p0 + w1 * p1 + w2 * p2))" for k in range(3)) + """
  FROM em CROSS JOIN likes WHERE step < 4000 GROUP BY step"""

# The urn: one level of the recursion per ball, state is the eight counts.
CTES["urn"] = f"""
  SELECT model, chain, draw, id, lender_ij AS n, 1 AS t, {_each('f{k} * conc AS a{k}')}, {_each('CAST(0 AS BIGINT) AS y{k}')}
  FROM keyed JOIN vectors USING (model, key)
  UNION ALL
  SELECT model, chain, draw, id, n, t + 1, {_each('a{k}')}, {_each('y{k} + CAST(pick = {k} AS BIGINT)')}
  FROM (
    SELECT *, CASE {' '.join('WHEN v < ' + ' + '.join(f'(a{i} + y{i})' for i in range(1, k + 1)) + f' THEN {k}' for k in range(1, 8))} ELSE 8 END AS pick
    FROM (SELECT *, {_uniform(f"'{SEED}|' || model || '|' || chain || '|' || draw || '|' || id || '|' || t")}
          * (({' + '.join(f'a{k}' for k in range(1, 9))}) + (t - 1)) AS v FROM urn WHERE t <= n))"""
CTES["ppc"] = f"SELECT model, chain, draw, id, {_each('y{k} AS {c}')} FROM urn WHERE t = n + 1"
CTES["cells"] = f"""
  SELECT model, chain, draw, category, y, count(*) AS respondents
  FROM (UNPIVOT ppc ON {', '.join(CATEGORIES)} INTO NAME category VALUE y) GROUP BY ALL"""
CTES["observed"] = f"""
  SELECT category, y, count(*) AS respondents FROM (UNPIVOT sample ON {', '.join(CATEGORIES)} INTO NAME category VALUE y) GROUP BY ALL"""
CTES["obsgrid"] = """
  SELECT m.model, c.category, v.y, coalesce(o.respondents, 0) AS respondents
  FROM (SELECT DISTINCT y FROM observed) v CROSS JOIN (SELECT DISTINCT category FROM observed) c
  CROSS JOIN (VALUES ('Baseline'), ('Extended'), ('Sex')) m(model)
  LEFT JOIN observed o ON o.category = c.category AND o.y = v.y"""
CTES["zeroed"] = """
  SELECT v.model, v.category, v.y, avg(coalesce(c.respondents, 0)) AS mean, stddev_samp(coalesce(c.respondents, 0)) AS std
  FROM (SELECT DISTINCT model, category, y FROM cells) v CROSS JOIN grid g
  LEFT JOIN cells c ON c.model = v.model AND c.category = v.category AND c.y = v.y AND c.chain = g.chain AND c.draw = g.draw
  GROUP BY ALL"""
CTES["freq"] = """
  SELECT model, 'Y_counts_' || category AS category, y AS number_of_lenders, respondents AS y_observed_count,
         mean AS y_count_ppc_mean, std AS y_count_ppc_std
  FROM obsgrid LEFT JOIN zeroed USING (model, category, y)"""
CTES["banded"] = """
  SELECT *, y_count_ppc_mean + 1.96e0 * y_count_ppc_std AS y_count_ppc_upper, y_count_ppc_mean - 1.96e0 * y_count_ppc_std AS y_count_ppc_lower,
         y_observed_count BETWEEN y_count_ppc_mean - 1.96e0 * y_count_ppc_std AND y_count_ppc_mean + 1.96e0 * y_count_ppc_std AS covered
  FROM freq"""


def _needed(sql, found):
    for name in CTES:
        if name not in found and re.search(rf"\b(?:FROM|JOIN|UNPIVOT)\s+{name}\b|\b{name}\s+(?:USING|CROSS)", sql):
            found.add(name)
            _needed(CTES[name], found)
    return found


def sql(body):
    """A statement with the common tables it needs, in order of definition."""
    names = _needed(body, set())
    parts = [f"{n} AS {'MATERIALIZED ' if n not in ('urn', 'em') else ''}({CTES[n]})" for n in CTES if n in names]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def _r(columns, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c.split(' ')[-1].split('.')[-1]}" for c in columns.split(", "))


TYPES = ", ".join(CATEGORIES)
TYPE_SUM = " + ".join(CATEGORIES)


def _shown(names, low, high, root):
    inside = "CASE WHEN {c} BETWEEN {low} AND {high} THEN {c} END"
    body = f"sqrt({inside})" if root else inside
    return ", ".join("round(" + body.format(c=c, low=low, high=high) + f", 6) AS {c}_display" for c in names)


B3 = ("pmean", "lower_bound", "higher_bound")
PLACE = "CASE WHEN parameter = '{b}' THEN 'All' ELSE 'V' || replace(parameter, '{b}_vill_', '') END AS village"


def _profile(source, columns):
    one = "SELECT '{c}' AS column_name, '{t}' AS type, count({c}) AS non_null, count(*) AS row_count FROM {s}"
    return " UNION ALL ".join(one.format(c=c, t=t, s=source) for c, t in columns)


def _audit(suffix, name):
    return f"SELECT count(*) AS respondents, count(*) FILTER ({TYPE_SUM} <> lender_ij) AS violations, '{name}' AS ties FROM comp{suffix}"


CTES["tied"] = "SELECT * FROM dense WHERE tied"

_BODIES = {
    "scan_csv_na": "SELECT group_id, id, female FROM resp",
    "scan_csv_limited": "SELECT least(count(*), 100) AS read, least(count(*), 100) AS known FROM resp",
    "snapshot_intervals": f"SELECT {SERIES}, {_r('lower_bound, higher_bound, pmean')} FROM ptable",
    "draws_snapshot": "SELECT model, chain, draw, parameter, category, round(value, 6) AS value FROM long",
    "profile_respondents": _profile("resp", [("id", "string"), ("group_id", "string"), ("female", "int"), ("group_txt", "string"), ("hh_id", "string")]),
    "profile_composition": _profile("comp", [("id", "string"), ("lender_ij", "bigint"), ("lender_ji", "bigint"), *[(c, "bigint") for c in CATEGORIES]]),
    "profile_dyads": _profile("dense", [("i_id", "string"), ("j_id", "string"), ("lender_ij", "bigint"), ("lender_ji", "bigint"), ("friend_ij", "bigint"), ("family_ij", "bigint")]),
    "respondents_primary": "SELECT id, group_id, female FROM resp",
    "respondents": "SELECT id, group_id, female, group_txt, hh_id FROM resp",
    "nominations_kept": "SELECT group_id, i_id, j_id, type, n, i_id || '_' || j_id AS ij_id FROM kept",
    "relation_types": "SELECT DISTINCT type FROM kept",
    "group_ids": "SELECT DISTINCT group_id FROM resp",
    "dup_edges": "SELECT i_id, j_id, type, n FROM kept WHERE n > 1",
    "dedupe_rows": "SELECT DISTINCT group_id, i_id, type FROM raw",
    "relation_pivot": "SELECT i_id, j_id, lender, family, friend FROM rel_raw",
    "dyads_tied": "SELECT i_id, j_id, i_id || '_' || j_id AS ij_id, least(i_id, j_id) || '_' || greatest(i_id, j_id) AS unordered_ij_id FROM tied",
    "dyad_totals": """SELECT group_id, (SELECT count(*) FROM resp r WHERE r.group_id = d.group_id) AS members, count(*) AS dyads,
        count(*) FILTER (tied) AS tied, CAST(sum(lender_ij) AS BIGINT) AS lender_ij, CAST(sum(lender_ji) AS BIGINT) AS lender_ji,
        CAST(sum(friend_ij) AS BIGINT) AS friend_ij, CAST(sum(family_ij) AS BIGINT) AS family_ij,
        CAST(sum(coresident) AS BIGINT) AS coresidents FROM dense d GROUP BY group_id""",
    "dyads_relations": "SELECT i_id, j_id, lender_ij, friend_ij, family_nom_ij FROM tied",
    "reciprocity": "SELECT i_id, j_id, lender_ij, lender_ji FROM tied",
    "coresidence": "SELECT i_id, j_id, coresident FROM tied",
    "kinship": "SELECT i_id, j_id, family_nom_ij, family_nom_ji, coresident, family_ij FROM tied",
    "lender_taxonomy": "SELECT group_id, i_id, j_id, lender_ij, friend_ij, family_ij, lender_ji, CASE "
        + " ".join(f"WHEN {c} = 1 THEN '{c}'" for c in CATEGORIES) + " END AS category FROM typed WHERE lender_ij > 0",
    "composition": f"SELECT id, group_id, female, group_txt, hh_id, lender_ij, lender_ji, {TYPES} FROM comp",
    "composition_audit": _audit("", "distinct") + " UNION ALL " + _audit("_raw", "repeated"),
    "degree": "SELECT id, lender_ij AS out_degree, lender_ji AS in_degree FROM comp",
    "multiplexity": " UNION ALL ".join(f"SELECT '{c}' AS category, CAST(sum({c}) AS BIGINT) AS edges, count(*) FILTER ({c} > 0) AS respondents FROM comp" for c in CATEGORIES),
    "category_dim": " UNION ALL ".join(f"SELECT '{c}' AS category, CAST(sum({c}) AS BIGINT) AS edges, {k} AS category_order FROM typed" for k, c in enumerate(CATEGORIES)),
    "count_histogram": f"""SELECT c.category, v.y, coalesce(o.n, 0) AS respondents FROM
        (SELECT DISTINCT y FROM (UNPIVOT comp ON {TYPES} INTO NAME category VALUE y)) v
        CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in CATEGORIES)}) c(category)
        LEFT JOIN (SELECT category, y, count(*) AS n FROM (UNPIVOT comp ON {TYPES} INTO NAME category VALUE y) GROUP BY ALL) o
        ON o.category = c.category AND o.y = v.y""",
    "exclusion_audit": """SELECT 'has_lender' AS criterion, lender_ij > 0 AS flag, count(*) AS respondents FROM comp GROUP BY ALL
        UNION ALL SELECT 'sex_missing', female IS NULL, count(*) FROM comp WHERE lender_ij > 0 GROUP BY ALL""",
    "modelled_respondents": f"SELECT id, group_id, female, lender_ij, {TYPES} FROM sample",
    "lender_total": "SELECT CAST(sum(lender_ij) AS BIGINT) AS lenders FROM sample",
    "group_sizes": "SELECT group_id, count(*) AS respondents FROM sample GROUP BY group_id",
    "group_members": """SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY id) - 1 AS position, id,
        count(*) OVER (PARTITION BY group_id) AS members FROM resp""",
    "group_codes": "SELECT DISTINCT group_id, dense_rank() OVER (ORDER BY group_id) - 1 AS code FROM sample",
    "model_shape": "SELECT count(*) AS n, 8 AS k, count(DISTINCT group_id) AS g FROM sample",
    "max_nominations": """SELECT type, named, count(*) AS nominators, round(count(*) / (SELECT count(*) FROM resp), 6) AS share FROM (
        SELECT i_id, 'lender' AS type, CAST(sum(CASE WHEN type = 'lender' THEN n ELSE 0 END) AS BIGINT) AS named FROM kept GROUP BY i_id
        UNION ALL SELECT i_id, 'friend', CAST(sum(CASE WHEN type = 'friend' THEN n ELSE 0 END) AS BIGINT) FROM kept GROUP BY i_id) GROUP BY type, named""",
    "param_dim": """SELECT CASE WHEN sex IS NULL THEN 'Extended' ELSE 'Sex' END AS model,
        block || '_vill_' || group_id || coalesce('_' || sex, '') AS parameter, block, group_id, sex
        FROM (SELECT DISTINCT group_id FROM resp) CROSS JOIN (VALUES ('frac'), ('conc')) b(block) CROSS JOIN (VALUES (NULL), ('female'), ('male')) s(sex)
        UNION ALL SELECT 'Baseline', block, block, NULL, NULL FROM (VALUES ('frac'), ('conc')) b(block)
        UNION ALL SELECT model, 'hyper_' || h, 'hyper', NULL, NULL FROM (VALUES ('Baseline'), ('Extended'), ('Sex')) m(model) CROSS JOIN (VALUES ('alpha'), ('lambda')) h(h)""",
    "param_sex_split": f"""SELECT parameter AS name, {BARE} AS parameter, {SEX} AS sex FROM (
        SELECT block || '_vill_' || group_id || '_' || sex AS parameter FROM (SELECT DISTINCT group_id FROM resp)
        CROSS JOIN (VALUES ('frac'), ('conc')) b(block) CROSS JOIN (VALUES ('female'), ('male')) s(sex)
        UNION ALL SELECT 'hyper_alpha' UNION ALL SELECT 'hyper_lambda')""",
    "dm_suffstats": " UNION ALL ".join(
        f"SELECT model, key, {'NULL' if c == 'lender_ij' else _text(c)} AS category, j, count(*) AS n_above FROM keyed, unnest(range(0, {c})) u(j) GROUP BY ALL"
        for c in ("lender_ij", *CATEGORIES)),
    "group_proportions": " UNION ALL ".join(
        f"SELECT model, key, CAST(sum(lender_ij) AS BIGINT) AS lenders, '{c}' AS category, CAST(sum({c}) AS BIGINT) AS edges, round(sum({c}) / sum(lender_ij), 6) AS proportion FROM keyed GROUP BY model, key"
        for c in CATEGORIES),
    "dm_loglik": "SELECT model, id, chain, draw, round(ll, 6) AS ll FROM loglik",
    "conc_log_prior": f"""SELECT model, key, chain, draw,
        round(lgamma({' + '.join(f'h{k}' for k in range(1, 9))}) + {' + '.join(f'(h{k} - 1) * ln(f{k}) - lgamma(h{k})' for k in range(1, 9))}, 6) AS log_prior_frac,
        round(ln(lam) - lam * conc, 6) AS log_prior_conc,
        CASE WHEN key = '' THEN round(ln(8e0 / pow(2 + conc, 3)), 6) END AS log_prior_conc_marginal
        FROM vectors JOIN hyper USING (model, chain, draw)""",
    "hyper_log_prior": f"""SELECT model, chain, draw, round({' + '.join(f'(-ln(h{k}) - {ALPHA_SIGMA - 1 + 0.5 * 1.8378770664093453}e0 - pow(ln(h{k}) - {ALPHA_MU}e0, 2) / 2)' for k in range(1, 9))}, 6) AS log_prior_alpha,
        round(ln(4e0) + ln(lam) - 2 * lam, 6) AS log_prior_lambda FROM hyper""",
    "draws_explode": " UNION ALL ".join(
        f"SELECT model, chain, draw, 'frac' || key AS parameter, {k - 1} AS k, round(f{k}, 6) AS value FROM vectors UNION ALL SELECT model, chain, draw, 'hyper_alpha', {k - 1}, round(h{k}, 6) FROM hyper"
        for k in range(1, 9)),
    "draws_long": "SELECT model, chain, draw, parameter, category, round(value, 6) AS value FROM long",
    "posterior_means": f"SELECT {SERIES}, round(pmean, 6) AS pmean FROM means",
    "hdi": f"SELECT {SERIES}, 'lower' AS hdi, round(lower_bound, 6) AS boundary FROM hdi95 UNION ALL SELECT {SERIES}, 'higher', round(higher_bound, 6) FROM hdi95",
    "hdi_wide": f"SELECT {SERIES}, {_r('lower_bound, higher_bound')} FROM hdi95",
    "posterior_table": f"SELECT {SERIES}, {_r('lower_bound, higher_bound, pmean')}, category_order FROM ptable",
    "model_stack": f"SELECT {SERIES}, {_r('lower_bound, higher_bound, pmean')}, category_order, sex, parameter_order, model_order, estimate_id FROM stacked",
    "reported_lookup": f"SELECT category, {_r('pmean, lower_bound, higher_bound')} FROM stacked WHERE model = 'Baseline' AND parameter = 'frac'",
    "reported_subsets": "SELECT " + ", ".join(
        f"round(sum(pmean) FILTER (category IN ({', '.join(_text(c) for c in g)})), 6) AS {n}" for n, g in (("indebted", INDEBTED), ("intimate", INTIMATE), ("not_indebted", NOT_INDEBTED))
    ) + " FROM stacked WHERE model = 'Baseline' AND parameter = 'frac'",
    "village_ranking": """SELECT parameter, category, round(pmean, 6) AS pmean, row_number() OVER (ORDER BY pmean, parameter) AS place
        FROM stacked WHERE model = 'Extended' AND parameter LIKE 'frac%' AND category = 'friend_family_lender_ij'""",
    "fig_parallel": f"""SELECT estimate_id, model, {_case('model', MODEL_LABELS)} AS model_label, category, category_order,
        {_case('category', CATEGORY_LABELS)} AS category_label, {_r(', '.join(B3))}, {_shown(B3, '0e0', '0.6e0', True)} FROM stacked WHERE parameter LIKE 'frac%'""",
    "fig_fractions": f"""SELECT {PLACE.format(b='frac')}, model, category, {_case('category', CATEGORY_LABELS_LONG)} AS facet, {_r(', '.join(B3))},
        pmean BETWEEN 0e0 AND 0.6e0 AS in_limits, {_shown(B3, '0e0', '0.6e0', True)} FROM stacked WHERE parameter LIKE 'frac%'""",
    "fig_concentration": f"SELECT {PLACE.format(b='conc')}, model, {_r(', '.join(B3))}, {_shown(B3, '0e0', '15e0', False)} FROM stacked WHERE parameter LIKE 'conc%'",
    "rhat_split": f"SELECT {SERIES}, {_r('rhat')} FROM rhat_plain",
    "rhat_rank": f"SELECT {SERIES}, {_r('rhat_bulk, rhat_folded, rhat')} FROM rhat_both",
    "autocov_lags": f"""SELECT x.model, x.parameter, x.category, x.half, CAST(y.t - x.t AS BIGINT) AS lag, round(sum(x.c * y.c) / max(x.h), 9) AS acov
        FROM (SELECT *, value - avg(value) OVER (PARTITION BY {SERIES}, half) AS c FROM split) x
        JOIN (SELECT *, value - avg(value) OVER (PARTITION BY {SERIES}, half) AS c FROM split) y
        ON x.model = y.model AND x.parameter = y.parameter AND x.category = y.category AND x.half = y.half AND y.t >= x.t GROUP BY ALL""",
    "ess_bulk": f"SELECT {SERIES}, round(ess, 6) AS ess_bulk FROM size_bulk",
    "ess_tail": f"SELECT {SERIES}, round(min(ess), 6) AS ess_tail FROM size_tail GROUP BY {SERIES}",
    "posterior_summary": f"SELECT {SERIES}, {_r('mean, sd, lower_bound, higher_bound, ess_bulk, ess_tail, r_hat, mcse_mean, mcse_sd')} FROM summary",
    **{name: f"""SELECT *, rhat_fails + ess_bulk_fails + ess_tail_fails = 0 AS passed FROM (
        SELECT model, count(*) AS series, count(*) FILTER (NOT coalesce(r_hat < 1.01e0, false)) AS rhat_fails,
        count(*) FILTER (NOT coalesce(ess_bulk > {least}, false)) AS ess_bulk_fails, count(*) FILTER (NOT coalesce(ess_tail > {least}, false)) AS ess_tail_fails
        FROM summary GROUP BY model)""" for name, least in (("diagnostic_gate", 1000), ("diagnostic_gate_at_50", 50))},
    **{name: f"""SELECT {SERIES}, {_r('r_hat, ess_bulk, ess_tail')} FROM summary
        WHERE NOT coalesce(r_hat < 1.01e0 AND ess_bulk > {least} AND ess_tail > {least}, false)"""
       for name, least in (("diagnostic_violations", 1000), ("diagnostic_violations_at_50", 50))},
    "loo_pointwise": """SELECT model, point, respondents, round(p.elpd, 6) AS elpd, round(k, 6) AS pareto_k
        FROM psis p JOIN isloo USING (model, point)""",
    "loo_efficiency": """SELECT model, point, respondents, round(reff, 6) AS reff, round(p.elpd, 6) AS elpd, round(k, 6) AS pareto_k
        FROM psis_measured p JOIN isloo USING (model, point) JOIN measured USING (model)""",
    "ppc_draws": f"SELECT model, chain, draw, id, {TYPES} FROM ppc",
    "ppc_crosstab": "SELECT model, chain, draw, category, y, respondents FROM cells",
    "ppc_frequency": f"SELECT model, category, number_of_lenders, y_observed_count, {_r('y_count_ppc_mean, y_count_ppc_std')} FROM freq",
    "ppc_band": f"""SELECT model, category, number_of_lenders, y_observed_count, {_r('y_count_ppc_mean, y_count_ppc_std, y_count_ppc_upper, y_count_ppc_lower')}, covered FROM banded""",
    "fig_ppc": f"""SELECT model, {_case('model', PPC_MODEL_LABELS)} AS model_label, category, {_case("replace(category, 'Y_counts_', '')", CATEGORY_LABELS)} AS category_label,
        number_of_lenders, {_r('y_count_ppc_mean, y_count_ppc_lower, y_count_ppc_upper')}, y_observed_count, """ + ", ".join(
        f"round(asinh(CASE WHEN {c} BETWEEN -2 AND 3000 THEN {c} END / 2e0) / ln(10e0), 6) AS {c}_display"
        for c in ("y_count_ppc_mean", "y_count_ppc_lower", "y_count_ppc_upper", "y_observed_count")) + " FROM banded",
    "lppd_waic": "SELECT model, point, respondents, round(lppd, 6) AS lppd, round(p_waic, 6) AS p_waic, round(lppd - p_waic, 6) AS elpd_waic FROM waic",
    "is_loo": "SELECT model, point, respondents, round(elpd, 6) AS elpd FROM isloo",
    "posterior_invariants": """SELECT model, parameter, category, 400 AS n_draws, 0 AS outside, CAST(parameter LIKE 'frac%' AS INTEGER) AS shares_add_up,
        CASE WHEN parameter LIKE 'frac%' THEN 1 END AS near_pooled
        FROM (SELECT DISTINCT model, parameter, category FROM long)""",
    "elpd_compare": f"""SELECT model, {_case('model', COMPARISON_LABELS)} AS label, CAST(row_number() OVER (ORDER BY elpd DESC) - 1 AS INTEGER) AS rank,
        {_r('elpd, se, elpd_diff, dse')}, round(lppd - elpd, 6) AS p_loo FROM totals JOIN diffs USING (model)""",
    "stacking_weights": " UNION ALL ".join(f"SELECT '{m}' AS model, round(w{k}, 4) AS weight FROM em WHERE step = 4000" for k, m in enumerate(MODELS)),
    "loo_report": f"""SELECT model, respondents, {_r('elpd, se')}, round(p_loo, 6) AS p_loo, round(largest_k, 6) AS largest_k, k_good, k_bad, k_very_bad,
        k_bad + k_very_bad > 0 AS warning FROM (
        SELECT model, count(*) AS respondents, sum(elpd) AS elpd, sqrt(count(*) * var_pop(elpd)) AS se, sum(lppd) - sum(elpd) AS p_loo, max(k) AS largest_k,
        count(*) FILTER (k <= 0.7e0) AS k_good, count(*) FILTER (k > 0.7e0 AND k <= 1) AS k_bad, count(*) FILTER (k > 1) AS k_very_bad
        FROM elpds GROUP BY model)""",
}

ORACLES = {name: sql(body) for name, body in _BODIES.items()}

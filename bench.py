"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from kinfold.operators import likelihood, predictive
from kinfold.plans.bootstrap import bootstrap
from kinfold.plans.fixtures import Survey
from kinfold.plans.queries import PREPARED, QUERIES, Fitted
from kinfold.sources.workspace import materialise

HEADLINE = (
    "composition", "lender_taxonomy", "dyad_totals", "count_histogram", "dm_suffstats", "dm_loglik",
    "posterior_draws", "hdi", "rhat_rank", "ess_bulk", "ppc_frequency", "loo_pointwise", "elpd_compare", "fig_parallel",
)
# Draws per chain that give about the 245.7 million predictive cells of the published run at sf0.1.
MANY_DRAWS = 625


def predictive_check(spark, sf_dir):
    """Simulate and tabulate the extended model's predictive counts over the whole sample."""
    rows = materialise(Survey(spark, sf_dir).sample(), "sample")
    vectors, _ = bootstrap(rows, MANY_DRAWS)
    vectors = materialise(vectors.where("model = 'Extended'"), "vectors")
    start = time.perf_counter()
    cells = predictive.predict_cells(likelihood.with_models(rows, ["Extended"]), vectors)
    predictive.frequency_summary(cells, 4 * MANY_DRAWS).collect()
    return time.perf_counter() - start, 8 * rows.count() * 4 * MANY_DRAWS


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up and the inputs of the draw-based queries are not timed.
    QUERIES["group_sizes"](spark, sf_dir).collect()
    PREPARED[sf_dir] = Fitted(spark, sf_dir)
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    seconds, cells = predictive_check(spark, sf_dir)
    times["predictive_check"] = round(seconds, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "predictive_cells": cells,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

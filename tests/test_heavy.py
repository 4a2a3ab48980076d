import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators import heavy, network
from tests.conftest import rows


def test_reduced_counts_are_bounded_from_below():
    rng = np.random.default_rng(1)
    keys = [str(k) for k in rng.zipf(1.5, 20_000)]
    truth, found = collections.Counter(keys), {}
    for at in range(0, len(keys), 500):
        for k, n in collections.Counter(keys[at:at + 500]).items():
            found[k] = found.get(k, 0) + n
        found = heavy.reduced(found, 50)
    assert len(found) <= 50
    for k, n in truth.items():
        assert n - len(keys) / 51 <= found.get(k, 0) <= n


def test_frequent_keys(spark):
    """Every key above the share is found, few others are, and how rows are dealt out plays no part in that."""
    data = [("hub", str(k % 7)) for k in range(4000)] + [(f"k{k}", None if k % 2 else "x") for k in range(6000)]
    df = spark.createDataFrame(data, "a string, b string")
    for parts in (1, 13):
        found = collections.defaultdict(set)
        for r in heavy.frequent_keys(df.repartition(parts), ["a", "b"], share=20).collect():
            found[r["name"]].add(r["key"])
        assert found["a"] == {"hub"} and found["b"] == {"x", *map(str, range(7))}
    assert heavy.frequent_keys(df.where("false"), ["a"]).count() == 0


def test_a_hub_of_a_third_of_all_edges_is_spread(spark):
    """The join equals a plain one, and no task has more than twice the rows of the median task."""
    people = spark.range(3000).selectExpr("cast(id AS string) AS j_id", "id % 5 AS g", "if(id % 11 = 0, null, id) AS h")
    pairs = spark.range(30_000).selectExpr("id AS e", "cast(if(id % 3 = 0, 17, if(id % 500 = 1, 100000 + id, id % 3000)) AS string) AS j_id")
    pairs = pairs.unionByName(spark.createDataFrame([(-1, None), (-2, "nobody")], "e long, j_id string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frequent = heavy.frequent_keys(pairs, ["j_id"])
        found = heavy.hub_join(pairs, people, "j_id", frequent)
        assert rows(found, "e", "j_id", "g", "h") == rows(pairs.join(people, "j_id"), "e", "j_id", "g", "h")
        tasks = sorted(r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(tasks) == 8 and tasks[-1] <= 2 * tasks[4]


@pytest.mark.parametrize("hub", ["i", "j"])
def test_pairs_with_a_hub_at_either_end(spark, hub):
    rng = np.random.default_rng(3)
    ends = [(str(a), str(b)) for a, b in zip(rng.integers(0, 60, 900), np.where(rng.random(900) < 0.4, 5, rng.integers(0, 60, 900)))]
    ends = [(a, b) if hub == "j" else (b, a) for a, b in ends]
    people = {str(k): (str(k % 3), None if k % 4 == 0 else f"h{k // 5}") for k in range(50)}
    pairs = spark.createDataFrame(sorted(set(ends)), "i_id string, j_id string")
    respondents = spark.createDataFrame([(k, *v) for k, v in people.items()], "id string, group_id string, hh_id string")
    expected = {
        (a, b, people[a][0], int(people[a][1] is not None and people[a][1] == people[b][1]))
        for a, b in set(ends) if a != b and a in people and b in people and people[a][0] == people[b][0]
    }
    assert rows(network.within_group_pairs(pairs, respondents), "i_id", "j_id", "group_id", "coresident") == expected

import random

from kinfold.operators.ranks import average_ranks, dense_codes, ranked
from tests.conftest import rows


def test_positions_within_groups_with_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.7 else rng.choice("ab"), round(rng.random(), 1), k) for k in range(500)] + [(None, 0.3, 900), (None, 0.1, 901)]
    expected = set()
    for key in {d[0] for d in data}:
        mine = sorted((v, k) for g, v, k in data if g == key)
        expected |= {(key, v, k, i, len(mine)) for i, (v, k) in enumerate(mine)}
    df = spark.createDataFrame(data, "g string, v double, k long")
    assert rows(ranked(df, ["g"], ["v", "k"]), "g", "v", "k", "rank0", "total") == expected


def test_partition_count_does_not_matter(spark):
    df = spark.range(300).selectExpr("id % 3 AS g", "cast(id * 7 % 11 AS double) AS v", "id AS k")
    first = rows(ranked(df, ["g"], ["v", "k"]), "g", "k", "rank0")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows(ranked(df.repartition(9), ["g"], ["v", "k"]), "g", "k", "rank0") == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("x", v, k) for k, v in enumerate([2.0, 1.0, 2.0, 2.0, 5.0])], "g string, v double, k long")
    assert rows(average_ranks(df, ["g"], "v", ["k"]), "k", "avg_rank") == {(0, 3.0), (1, 1.0), (2, 3.0), (3, 3.0), (4, 5.0)}


def test_dense_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("10",), (None,)], "g string")
    assert rows(dense_codes(df, "g")) == {("10", 0), ("a", 1), ("b", 2)}


def test_groups_and_ties_over_many_borders(spark, monkeypatch):
    """Null keys, NaN and signed zeros, groups and runs of all lengths, whatever the length of a stretch."""
    import numpy as np
    import pyarrow as pa

    from kinfold.operators import ranks

    rng = np.random.default_rng(5)
    data = sorted(((str(g), float(v)) for g, v in zip(rng.choice(list("abcd"), 700, p=[.6, .2, .1, .1]), rng.choice([0.0, 1.0, 2.0, 3.0], 700, p=[.7, .1, .1, .1]))))
    table = pa.table({"g": [g for g, _ in data], "v": [v for _, v in data]})
    for stretch, batch in ((1, 1), (3, 2), (50, 7), (10_000, 64)):
        monkeypatch.setattr(ranks, "STRETCH", stretch)
        monkeypatch.setattr(ranks, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 4})())}))
        out = pa.Table.from_batches(list(ranks._walk(["g"], "v")(table.to_batches(batch)))).to_pylist()
        assert [(r["g"], r["v"]) for r in out] == data and {r["__part"] for r in out} == {4}
        for seg, place, size in (("__seg", "__place", "__rows"), ("__tie_seg", "__tie_place", "__ties")):
            for i, r in enumerate(out):
                same = [j for j, o in enumerate(out) if o["g"] == r["g"] and (place == "__place" or o["v"] == r["v"])]
                if r[seg] < 0:
                    assert r[size] == len(same) and r[place] == i - same[0]
                else:
                    assert r[place] == i - r[seg] and r[seg] in same and r[size] <= len(same)


def test_special_values_share_ranks(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, 0.0, 1), (None, -0.0, 2), (None, nan, 3), (None, nan, 4), (None, None, 5), ("a", 1.0, 6)], "g string, v double, k long")
    assert rows(average_ranks(df.repartition(3), ["g"], "v", ["k"]), "k", "avg_rank", "total") == {
        (5, 1.0, 5), (1, 2.5, 5), (2, 2.5, 5), (3, 4.5, 5), (4, 4.5, 5), (6, 1.0, 1)}


def test_a_constant_series_spans_many_tasks(spark):
    """Ten million equal values of one group: every task has a share, and all have the same rank."""
    n = 10_000_000
    df = spark.range(n, numPartitions=8).selectExpr("'x' AS g", "1.5D AS v", "id AS k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = average_ranks(df, ["g"], "v", ["k"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(g") <= 2
        r = found.selectExpr("min(avg_rank) AS lo", "max(avg_rank) AS hi", "sum(rank0) AS s", "count(DISTINCT rank0) AS d", "max(total) AS t").first()
        sizes = [x["n"] for x in found.selectExpr("spark_partition_id() AS p").groupBy("p").count().withColumnRenamed("count", "n").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (r["lo"], r["hi"], r["s"], r["d"], r["t"]) == ((n + 1) / 2, (n + 1) / 2, n * (n - 1) // 2, n, n)
    assert len(sizes) >= 4 and max(sizes) < n / 2

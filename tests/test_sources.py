import pytest
from pyspark.sql import functions as F

from kinfold.functions.values import NA_TOKENS
from kinfold.operators.tables import distinct_rows, duplicate_keys, frequency, profile
from kinfold.sources import survey
from kinfold.sources.workspace import materialise, scratch, shared_folder
from tests.conftest import rows


def write(path, text):
    path.write_text(text)
    return str(path)


def test_missing_tokens_become_null(spark, tmp_path):
    lines = ["villageId,x,i,female"] + [f"1,z,p{k},{t}" for k, t in enumerate(NA_TOKENS)] + ["1,z,q,1", "2,z,r,0.0"]
    df = survey.read_primary(spark, write(tmp_path / "nodes.csv", "\n".join(lines) + "\n"))
    assert df.dtypes == [("group_id", "string"), ("id", "string"), ("female", "int")]
    known = rows(df.where("female IS NOT NULL"), "id", "female")
    assert known == {("q", 1), ("r", 0)}
    assert df.count() == len(NA_TOKENS) + 2


def test_limit_and_missing_column(spark, tmp_path):
    path = write(tmp_path / "ties.csv", "villageId,i,j,type,dist\n1,a,b,lender,2\n1,a,c,geo,3\n")
    assert survey.read_nominations(spark, path, limit=1).count() == 1
    assert survey.read_nominations(spark, path).columns == ["group_id", "i_id", "j_id", "type"]
    with pytest.raises(ValueError, match="female"):
        survey.read_primary(spark, path)


def test_join_keeps_primary_group_and_drops_null_ids(spark):
    first = spark.createDataFrame([("a", "1", 1), (None, "1", 0), ("b", "1", 0)], "id string, group_id string, female int")
    second = spark.createDataFrame(
        [("a", "9", "t", "h"), (None, "9", "t", "h"), ("c", "1", "t", "h")],
        "id string, group_id string, group_txt string, hh_id string",
    )
    joined = survey.respondents(first, second)
    assert rows(joined, "id", "group_id", "female", "group_txt", "hh_id") == {("a", "1", 1, "t", "h")}


def test_repeated_ids_stop_the_join(spark):
    first = spark.createDataFrame([("a", "1", 1), ("a", "1", 0)], "id string, group_id string, female int")
    second = spark.createDataFrame([("a", "9", "t", "h")], "id string, group_id string, group_txt string, hh_id string")
    for one, two in ((first, second), (first.limit(1), second.unionByName(second))):
        with pytest.raises(Exception, match="repeated id a"):
            survey.respondents(one, two).collect()


def test_quotes_and_bad_values(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'villageId,i,female\n1,"c ""x""",1\n')
    assert rows(survey.read_primary(spark, path), "id", "female") == {('c "x"', 1)}
    for k, bad in enumerate(("1.9", "yes")):
        path = write(tmp_path / f"bad{k}.csv", f"villageId,i,female\n1,a,{bad}\n")
        with pytest.raises(Exception, match="female cannot be read as int"):
            survey.read_primary(spark, path).collect()


def test_scratch_is_removed(spark, tmp_path):
    import os

    with scratch(spark) as paths:
        df = materialise(spark.range(5), "gone")
        assert df.count() == 5 and os.path.isdir(paths[0].removeprefix("file:"))
    assert not os.path.exists(paths[0].removeprefix("file:"))


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_table_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, v int")
    assert rows(profile(df), "column_name", "type", "non_null", "row_count") == {("k", "string", 3, 3), ("v", "int", 2, 3)}
    assert rows(duplicate_keys(df, ["k"])) == {("a", 2)}
    assert rows(distinct_rows(df)) == {("a", 1), ("b", None)}
    assert [tuple(r) for r in frequency(df, "k").collect()] == [("a", 2), ("b", 1)]


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = spark.range(3).select(F.col("id"), F.lit("x").alias("s"))
    assert rows(materialise(df, "t")) == {(0, "x"), (1, "x"), (2, "x")}


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("Baseline", 0, 0, "frac", "c", 0.5), ("Sex", 0, 0, "conc", "c", 1.5)],
                               "model string, chain int, draw int, parameter string, category string, value double")
    survey.write_draws(df, str(tmp_path / "draws"))
    assert rows(survey.read_draws(spark, str(tmp_path / "draws")), *df.columns) == rows(df)


def test_a_snapshot_keeps_its_distribution(spark, tmp_path):
    """Means and intervals of a snapshot equal those of the draws, without an exchange."""
    from kinfold.operators import draws as dr

    df = spark.range(4 * 50).selectExpr("cast(id % 4 AS int) AS chain", "cast(id div 4 AS int) AS draw").selectExpr(
        "explode(array('Baseline', 'Sex')) AS model", "chain", "draw"
    ).selectExpr("model", "chain", "draw", "explode(array('frac', 'conc', 'frac_vill_1', 'frac_vill_2')) AS parameter").selectExpr(
        "model", "chain", "draw", "parameter", "explode(array('a', 'b', 'c')) AS category"
    ).selectExpr("*", "round(rand(3) + chain, 2) AS value").cache()
    path = str(tmp_path / "draws")
    survey.write_draws(df, path, buckets=5)
    back = survey.read_draws(spark, path)
    assert rows(back, *df.columns) == rows(df)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found, expected in ((dr.posterior_means(back), dr.posterior_means(df)), (dr.hdi_in_place(back), dr.hdi(df))):
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
            assert sorted(tuple(r)[:-1] for r in found.collect()) == sorted(tuple(r)[:-1] for r in expected.collect())
            assert sorted(r[-1] for r in found.collect()) == pytest.approx(sorted(r[-1] for r in expected.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    df.unpersist()

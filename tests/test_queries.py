import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as driver
from kinfold.plans.oracles import ORACLES
from kinfold.plans.queries import PREPARED, QUERIES, Fitted

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "nation")
CHOSEN = sorted(ORACLES)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def lines(pdf):
    """Rows as sorted text, with columns by name."""
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "-"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return repr(float(v) + 0.0) if isinstance(v, (int, float, np.number)) else str(v)

    columns = sorted(pdf.columns)
    return columns, sorted("|".join(map(cell, r)) for r in pdf[columns].itertuples(index=False))


def agree(spark, name, folder):
    found = driver.queries()[name](spark, folder).toPandas()
    expected = connect(folder).sql(driver.oracle_sql()[name]).df()
    assert len(found) > 0 or len(expected) == 0
    assert lines(found) == lines(expected)


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    """The sample and its draws, written once for all queries."""
    PREPARED[DATA] = Fitted(spark, DATA)
    yield
    del PREPARED[DATA]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, name):
    agree(spark, name, DATA)


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) - set(ORACLES) == {"posterior_draws"}


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns[:3] == ["group_id", "respondents", "lenders"]
    assert df.agg({"respondents": "sum", "lenders": "sum"}).first().asDict() == {"sum(respondents)": 125, "sum(lenders)": 208}


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    """A nation with a third of the customers and a customer with a third of the orders."""
    folder = tmp_path_factory.mktemp("hot")
    rng = np.random.default_rng(9)
    n, m = 240, 4000
    nation = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 6, n)).astype("int32")
    customers = pd.DataFrame({
        "c_custkey": np.arange(n) * 1000, "c_name": "x", "c_nationkey": nation, "c_acctbal": 0.0,
        "c_mktsegment": rng.choice(["MACHINERY", "HOUSEHOLD"], n),
    })
    orders = pd.DataFrame({
        "o_orderkey": np.arange(m), "o_custkey": np.where(rng.random(m) < 0.34, 7000, rng.integers(0, n, m) * 1000),
        "o_orderpriority": rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], m),
    })
    nations = pd.DataFrame({"n_nationkey": np.arange(6, dtype="int32"), "n_name": [f"N{k}" for k in range(6)], "n_regionkey": 0})
    for name, df in (("customer", customers), ("orders", orders), ("nation", nations)):
        df.to_parquet(folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["composition", "dyads_tied", "group_members", "dm_suffstats", "hdi", "ppc_crosstab", "is_loo"])
def test_hot_groups_keep_results_whole(spark, hot, name):
    agree(spark, name, hot)

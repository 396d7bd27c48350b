import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first()[0]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def canonical(x):
    import numpy as np
    import pandas as pd

    if isinstance(x, (list, np.ndarray)):
        return tuple(canonical(y) for y in x)
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if type(x).__name__ in ("Decimal", "int", "float") or isinstance(x, np.number):
        return round(float(x), 6)
    return str(x)


def same_as_duckdb(df, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    got, want = df.toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    table = lambda x: sorted((tuple(map(canonical, r)) for r in x[sorted(x.columns)].itertuples(index=False)), key=repr)
    assert table(got) == table(want)

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


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
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if x != x else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(norm(v) for v in x)
    return str(x) if type(x).__name__ in ("Decimal", "datetime", "Timestamp", "date") else x


def same(df, con, sql):
    """Rows of a DataFrame and of a DuckDB query, order and column order aside."""
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), (sorted(df.columns), sorted(rel.columns))
    cols = sorted(df.columns)
    ours = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not bad, bad[:3]

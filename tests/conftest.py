import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxPlanStringLength", "20000")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import glob

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows_of(cols, rows):
    """Rows with columns in name order, sorted; nulls and signs of zero made comparable."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    fixed = [tuple(0.0 if isinstance(r[i], float) and r[i] == 0 else r[i] for i in order) for r in rows]
    return sorted(cols), sorted(fixed, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Asserts that a query and its SQL give the same rows."""

    def check(fn, sql):
        df = fn(spark, data)
        rel = duck.sql(sql)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(list(rel.columns), rel.fetchall())

    return check

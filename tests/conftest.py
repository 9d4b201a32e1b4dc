import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v) or type(v).__name__ in ("NAType", "NaTType"):
        return "<null>"
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if str(v).endswith(".0") and not isinstance(v, str):
        return str(v)[:-2]
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same(spark, sf_dir, duck):
    """Asserts that a query and its SQL give the same columns and rows."""

    def check(query, sql):
        found, expected = rows_of(query(spark, sf_dir).toPandas()), rows_of(duck.execute(sql).df())
        assert found[0] == expected[0]
        assert len(found[1]) == len(expected[1])
        assert found[1] == expected[1]

    return check

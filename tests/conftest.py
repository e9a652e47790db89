import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


def canon(v):
    """A value as it can be compared: floats rounded, NaN as None, arrays as tuples."""
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def duck_rows(sql, sf, columns):
    """Rows of ``sql`` over the tables in ``sf``, columns sorted by name; they must be ``columns``."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(columns), (names, columns)
    at = [names.index(c) for c in sorted(columns)]
    return sorted((tuple(canon(r[i]) for i in at) for r in cur.fetchall()), key=lambda r: tuple((x is None, str(x)) for x in r))
